"""How a text in typesetting markup ends: the kind of its ending, and whether such an ending looks whole or broken off."""

from __future__ import annotations

import re

WHOLE, DOUBTFUL, BROKEN = 0, 1, 2

# Kinds of endings and how each looks by itself; truncation.py learns from the lengths which of them are breaks.
KINDS: dict[str, int] = {
    "blank": WHOLE, "sentence": WHOLE, "environment": WHOLE, "entry": WHOLE, "command": WHOLE, "display": WHOLE, "comment": WHOLE, "comment command": WHOLE,
    "number": DOUBTFUL,
    "odd character": BROKEN, "open comment": BROKEN, "open comment command": BROKEN, "open entry": BROKEN, "bare command": BROKEN, "open display": BROKEN,
    "open formula": BROKEN, "no stop": BROKEN, "stop in formula": BROKEN, "stop in reference": BROKEN, "stop in word": BROKEN, "initial": BROKEN,
}
NAMES = list(KINDS)
CODES = {k: i for i, k in enumerate(NAMES)}

# Commands that stand on their own, so a text may end with one.
BLOCK_COMMANDS = (
    "input include subfile bibliography bibliographystyle printbibliography maketitle tableofcontents appendix newpage clearpage "
    "section subsection subsubsection paragraph chapter part title author date label caption documentclass usepackage newcommand "
    "renewcommand providecommand def let DeclareMathOperator newtheorem begin end graphicspath includegraphics centering hline "
    "toprule midrule bottomrule keywords address affiliation email thanks pagestyle setlength vspace hspace noindent bigskip medskip "
    "smallskip listoffigures listoftables addbibresource nocite endinput import"
).split()
# Those of them that take no argument.
BARE_COMMANDS = set("maketitle appendix tableofcontents printbibliography newpage clearpage centering hline noindent bigskip medskip smallskip listoffigures listoftables endinput toprule midrule bottomrule".split())
# Shortened words whose full stop ends no sentence.
SHORTENED = set("fig figs sect sec eq eqs ref refs tab no vol pp ed eds al cf vs ca approx resp dr prof st e.g i.e e.g.\\ bzw vgl z.b d.h abb gl rus p".split())
SENTENCE_END = re.compile(r"[.!?。！？…؟।][\"'’”»)\]}]*$")
STOPPED = re.compile(r"(\S+?)\.[\"'’”»)\]}]*$")
FILL_LINE = re.compile(r"[ \t]*%+[ \t%]*([=\-*#~_.+]{2,})?[ \t]*$")
EDITOR_LINE = re.compile(r"[ \t]*%+[ \t]*(vim?: ?set?\b.*:|-\*-.*-\*-|Local Variables:|mode: ?[\w-]+|TeX-[\w-]+: ?.*|coding: ?.*|End:)[ \t]*$", re.I)
COMMENT_LINE = re.compile(r"[ \t]*%")
BLOCK_LINE = re.compile(r"[ \t}\]]*\\(" + "|".join(BLOCK_COMMANDS) + r")\*?(?![A-Za-z])[ \t]*((\[[^\[\]]*\]|\{([^{}]|\{([^{}]|\{[^{}]*\})*\})*\}|\\[A-Za-z]+|[ \t]|\([^()]*\))*)$")
END_DOCUMENT = "\\end{document}"
# Marks that feeds put behind a text they have cut.
CUT_MARK = re.compile(r"[ \t]*(\[?\(?(\.\.\.+|…+)\)?\]?|[\[(<]+ ?(more|cont(inued|\.)?|truncated|cut|snip|read more|gekürzt|suite)\.* ?[\])>]+)$", re.I)
ENVIRONMENT = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}")
MATH_ENVIRONMENTS = {"equation", "equation*", "align", "align*", "gather", "gather*", "multline", "multline*", "eqnarray", "eqnarray*", "displaymath", "math"}
ESCAPED = re.compile(r"\\[\\$%{}]")
BARE_COMMENT = re.compile(r"(?m)(?<!\\)%[^\n]*$")


def _last_line(s: str) -> tuple[int, str]:
    i = max(s.rfind("\n"), s.rfind("\r")) + 1
    return i, s[i:]


def strip_fill(text: str) -> str:
    """The text without what may stand behind a break: white space, rulers, editor lines and the closing command."""
    s = text.rstrip(" \t\r\n\f\v\x00\u00a0\u3000")
    while s:
        i, line = _last_line(s)
        if FILL_LINE.match(line) or EDITOR_LINE.match(line):
            s = s[:i]
        elif line.rstrip().endswith(END_DOCUMENT):
            s = s[: s.rfind(END_DOCUMENT)]
        elif m := CUT_MARK.search(line):
            s = s[: i + m.start()]
        else:
            break
        s = s.rstrip(" \t\r\n\f\v\x00\u00a0\u3000")
    return s


def _open_environments(s: str) -> list[str]:
    stack: list[str] = []
    for kind, name in ENVIRONMENT.findall(s):
        if kind == "begin":
            stack.append(name)
        elif name in stack:
            while stack.pop() != name:
                pass
    return stack


def _comment_kind(line: str) -> str:
    body = line.strip().lstrip("%").strip()
    if not body or SENTENCE_END.search(body):
        return "comment"
    if BLOCK_LINE.match(body) or re.match(r"\\[A-Za-z]+\*?(\{[^{}]*\}|\[[^\[\]]*\])*$", body):
        return "comment command" if body.count("{") == body.count("}") else "open comment command"
    return "open comment"


def kind_of(core: str) -> str:
    """Kind (of ``KINDS``) of a text that :func:`strip_fill` has been applied to."""
    if not core:
        return "blank"
    _, line = _last_line(core)
    if core[-1] == "\ufffd":
        return "odd character"
    if COMMENT_LINE.match(line):
        return _comment_kind(line)
    tail = line.rstrip()
    clean = ESCAPED.sub("", BARE_COMMENT.sub("", core))
    own = ESCAPED.sub("", BARE_COMMENT.sub("", tail))  # formulas and arguments are looked for in the last line alone
    if re.search(r"\\end\{[A-Za-z]+\*?\}$", tail):
        return "environment"
    if re.fullmatch(r"[ \t]*\}", tail):
        entry = clean[clean.rfind("\n@") + 1 :]
        return "entry" if entry.count("{") <= entry.count("}") or not entry.startswith("@") else "open entry"
    block = BLOCK_LINE.match(tail)
    if block:
        return "command" if block[2].strip() or block[1] in BARE_COMMANDS else "bare command"
    displays, shown = own.count("$$"), core.rfind("\\[") > core.rfind("\\]")
    if tail.endswith("\\]"):
        return "display"
    if tail.endswith("$$"):
        before = clean[: clean.rfind("$$")].rstrip()
        return "display" if displays % 2 == 0 or clean.count("$$") % 2 == 0 and before else "open display"
    if displays % 2 or own.replace("$$", "").count("$") % 2 or own.count("{") > own.count("}"):
        return "open formula"
    words = len(re.findall(r"[^\W\d_]{2,}", re.sub(r"\$[^$]*\$|\\[A-Za-z]+", " ", own)))
    if not SENTENCE_END.search(tail):
        return "no stop"
    opened = _open_environments(core)
    inner = opened[-1] if opened else ""
    if words < 4 and (shown or inner in MATH_ENVIRONMENTS):
        return "stop in formula"
    # a full stop or the like at the end: still inside an entry, or after a shortened word?
    if "\\bibitem" in core[max(core.rfind("\n\n"), core.rfind("\n\\bibitem"), 0) :] and inner == "thebibliography" and not re.search(r"\(\d{4}\)\.$", tail):
        return "stop in reference"
    stop = STOPPED.search(tail)
    if stop:
        if re.split(r"[\s~({\[\"]", stop[1])[-1].lower() in SHORTENED:
            return "stop in word"
        if re.search(r"(^|[\s{])[A-Z]\.$", tail):
            return "initial"
        if re.search(r"(?<![~\d.])\b\d+\.$", tail):
            return "number"
    return "sentence"


def ending(text: str | None) -> tuple[int, int, int]:
    """(code of the kind, length in characters, length in bytes) of the text before any fill; null and blank texts are blank."""
    core = strip_fill(text or "")
    if not core:
        return CODES["blank"], 0, 0
    return CODES[kind_of(core)], len(core), len(core.encode("utf-8"))
