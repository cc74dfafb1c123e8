import pytest

from sparsequery.llm.endings import BROKEN, KINDS, NAMES, WHOLE, ending
from sparsequery.llm.truncation import find_truncated, learn_breaks, length_limits, truncation_rates

WHOLE_TEXTS = [
    None, "", "  \n", "A finished sentence.", "Is it?\n\n", "It holds at 616.1~K.", "As Sect.~3 says (see Sect.~3).", "\\begin{a}\nText.\n\\end{a}", "Text.\n\\end{document}\n",
    "Text.\n\\input{sections/x}", "Text.\n\\bibliography{a_b}\n", "So\n\\[ x = 1 \\]\n", "So\n$$ x $$", "@article{a,\n  title = {B},\n}\n", "Done.\n% vim: set tw=80:", "Done.\n%====", "\\begin{quote}\nLeft open, but done.",
    "文章结束。", "Text.\n% A finished comment.", "Text. [...]",
]
BROKEN_TEXTS = [
    "It was cut in the mid", "Cut in the mid\n\\end{document}\n", "Cut in the mid\n%=====\n", "The value $x = ", "As Fig.", "See \\cite{ab", "We thank C.", "Some \\textbf{bold words", "It is\n\\section{Introducti", "Cut\n% a comment that sto",
    "@article{a,\n  title = {B},\n  journal = {C},", "\\begin{equation}\n x = \\frac{a}{b}", "\\begin{thebibliography}{9}\n\\bibitem{a} B.", "Word brok ...", "Word [...]", "cut \ufffd", "Does it\\footnote{The thing is low.", "a   ",
]


@pytest.mark.parametrize("text", WHOLE_TEXTS)
def test_whole(text):
    assert KINDS[NAMES[ending(text)[0]]] == WHOLE


@pytest.mark.parametrize("text", BROKEN_TEXTS)
def test_broken(text):
    assert KINDS[NAMES[ending(text)[0]]] == BROKEN


def docs(spark):
    own = [(i, "w " * 49 + "en" if i % 3 else "Good " * (i % 40 + 5) + "end.", "a", 1) for i in range(300)]
    return spark.createDataFrame([*own, (900, None, None, 2), (901, "", "b", 2), (902, "cut in mid", None, 2), (902, "cut in mid", None, 2)], "doc_id bigint, text string, source string, state int")


def test_limit_is_found_and_rates_are_reported(spark):
    cut, ends, lim = find_truncated(docs(spark))
    assert {(r.source, r.unit, r.length) for r in lim.collect()} >= {("a", "chars", 100), ("a", "bytes", 100)}
    rows = cut.collect()
    assert len(rows) == 202 and sum(r.at_limit for r in rows) == 200 and ends.count() == 304
    rates = {r.source: (r.n_texts, r.n_cut, r.n_at_limit) for r in truncation_rates(docs(spark)).collect()}
    assert rates == {"a": (300, 200, 200), None: (2, 2, 0)}


def test_lengths_decide_what_is_a_break(spark):
    """A kind that looks broken but is no commoner at limits than elsewhere is whole; a whole look that is commoner there is cut."""
    rows = [(i, "w " * 49 + "w." if i % 2 else "w " * 30 + "x" * (i % 97) + " a \\ref{b}%" + "\n% note", "a") for i in range(2000)]
    rows += [(5000 + i, "y" * (i % 83 + 1) + " w.", "a") for i in range(20)]
    cut, ends, _ = find_truncated(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    kinds = {r.name: r for r in learn_breaks(ends).collect()}
    assert kinds["sentence"].limited and kinds["sentence"].lift > 1 and not kinds["open comment"].limited
    assert {r.doc for r in cut.filter("at_limit").collect()} >= {i for i in range(2000) if i % 2} and not any(r.doc < 2000 and r.doc % 2 == 0 for r in cut.collect())


def test_empty(spark):
    empty = docs(spark).limit(0)
    assert find_truncated(empty)[0].count() == 0 and truncation_rates(empty).count() == 0
    assert length_limits(find_truncated(empty)[1]).count() == 0
