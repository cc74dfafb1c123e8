"""Texts cut off by field limits or broken transfers, and how often each source cuts.

Lengths (of the text before any fill, in characters and in bytes) give per source a discrete hazard: of the texts at
least ``l`` long, the share that is exactly ``l`` long. A field limit is a length whose hazard stands far above that of
the neighbouring lengths; the tail probability is a Chernoff bound on a Poisson count, and false discoveries are
controlled over all lengths tested (Benjamini-Hochberg).

Nearly every text at a significant length was cut there, so these lengths show which kinds of endings are breaks: a kind
that is commoner there than chance has it (its share of all other endings) is incomplete. Incomplete endings are flagged
at the significant lengths. A transfer stops at any length; elsewhere an incomplete ending is flagged if by the same
figures more of its kind are breaks than not. A kind with fewer than ``ENOUGH`` texts at the limits, seen or expected by
chance, is taken as it looks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage, workers
from .endings import BROKEN, KINDS, WHOLE, ending

ENOUGH = 5.0  # texts of a kind at significant lengths, seen or expected, from which on they decide


def text_ends(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, ``kind``, ``chars``, ``bytes``), one narrow row per row of ``docs``; reads whole texts.

    ``kind`` is a number in ``endings.NAMES``. Null, empty and blank texts are blank, with length 0; a null source stays null.
    """

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            e = [ending(t) for t in b.column(2).to_pylist()]
            cols = [pa.array([x[i] for x in e], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc", "source", "kind", "chars", "bytes"])

    workers(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc {dict(src.dtypes)['doc']}, source string, kind int, chars int, bytes int")


def length_limits(ends: DataFrame, near: int = 50, fdr: float = 1e-4, least: int = 5) -> DataFrame:
    """(source, unit, length, n, expected, p): lengths at which a source ends texts far more often than nearby.

    ``near``: lengths on either side that make up the neighbourhood. ``least``: fewest texts at a limit. Only counts
    per (source, unit, length) are shuffled, so a source with a third of all texts costs one row per length.
    """
    long = ends.filter(F.col("chars") > 0).select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("u"))
    counts = long.groupBy("source", "u.unit", "u.length").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("source", "unit").orderBy("length")
    down = Window.partitionBy("source", "unit").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = counts.withColumn("at_risk", F.sum("n").over(down))
    h = h.withColumn("others", F.sum("n").over(by.rangeBetween(-near, near)) - F.col("n")).withColumn("steps", F.lit(2.0 * near))
    # the hazard of a neighbouring length: those that end nearby, over those at risk there, lengths without a text included
    h = h.withColumn("hazard0", (F.col("others") + 0.5) / (F.col("steps") * (F.col("at_risk") + F.col("others"))))
    h = h.withColumn("expected", F.col("hazard0") * F.col("at_risk"))
    over = (F.col("n") > F.col("expected")) & (F.col("n") >= least)
    h = h.withColumn("p", F.when(over, F.exp(F.greatest(F.lit(-700.0), F.col("n") - F.col("expected") - F.col("n") * F.log(F.col("n") / F.col("expected"))))).otherwise(F.lit(1.0)))
    tests = stage(h.select("source", "unit", "length", "n", "expected", "p"), "hazards")
    m = tests.count()
    # the largest rejected set whose every p is at most fdr * (its size) / m, reached from above without a sort
    size, cut = m, fdr
    while size and (now := tests.filter(F.col("p") <= F.lit(cut := fdr * size / m)).count()) < size:
        size = now
    return tests.filter(F.col("p") <= F.lit(cut if size else -1.0))


def learn_breaks(ends: DataFrame) -> DataFrame:
    """(kind, name, ``at``, ``off``, ``lift``, ``limited``, ``anywhere``): what the significant lengths say of each kind of ending.

    ``ends``: with ``at_limit``. ``lift`` is the number of texts of the kind at limits over the number that chance would
    put there; above 1 the kind is incomplete (``limited``). If all incomplete kinds have a joint lift of L, a share of
    1 / L of the texts elsewhere is broken as well (all of their incomplete endings), and a kind's own share of breaks there
    is its lift / L; ``anywhere`` from one half. A doubtful look without evidence counts at limits only. One row per kind.
    """
    n = {r["kind"]: r for r in ends.filter("chars > 0").groupBy("kind").agg(F.sum(F.col("at_limit").cast("bigint")).alias("at"), F.count(F.lit(1)).alias("n")).collect()}  # at most a row per kind
    at = [n[i]["at"] if i in n else 0 for i in range(len(KINDS))]
    off = [n[i]["n"] - n[i]["at"] if i in n else 0 for i in range(len(KINDS))]
    chance = [sum(at) * o / max(sum(off), 1) for o in off]
    lift = [(a + 0.5) / (c + 0.5) for a, c in zip(at, chance)]
    enough = [max(a, c) >= ENOUGH for a, c in zip(at, chance)]
    broken = [i for i in range(len(KINDS)) if enough[i] and lift[i] > 1]
    joint = (sum(at[i] for i in broken) + 0.5) / (sum(chance[i] for i in broken) + 0.5)
    rows = []
    for i, (name, look) in enumerate(KINDS.items()):
        limited, anywhere = (lift[i] > 1, i in broken and lift[i] / joint >= 0.5) if enough[i] else (look != WHOLE, look == BROKEN)
        rows.append((i, name, at[i], off[i], lift[i], limited, anywhere))
    return ends.sparkSession.createDataFrame(rows, "kind int, name string, at bigint, off bigint, lift double, limited boolean, anywhere boolean")


def find_truncated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flagged texts, all ends, limits). Flagged: (doc, source, kind, chars, bytes, ``at_limit``).

    Empty tables give empty results; repeated rows are judged one by one; a text whose ending is of a kind that the
    lengths don't show to be a break is never flagged, whatever its length.
    """
    ends = stage(text_ends(docs, id_col, text_col, source_col), "ends")
    lim = length_limits(ends, **limits)
    flat = lim.groupBy(F.col("source").alias("s")).agg(F.collect_set(F.struct("unit", "length")).alias("l"))  # a row per source
    hit = F.coalesce(F.array_contains("l", F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length"))) | F.array_contains("l", F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))), F.lit(False))
    ends = ends.join(flat, ends["source"].eqNullSafe(flat["s"]), "left").withColumn("at_limit", hit).drop("s", "l")
    breaks = learn_breaks(ends).collect()
    anywhere, limited = [r["kind"] for r in breaks if r["anywhere"]], [r["kind"] for r in breaks if r["limited"]]
    out = ends.filter((F.col("chars") > 0) & (F.col("kind").isin(anywhere) | F.col("at_limit") & F.col("kind").isin(limited)))
    return out.select("doc", "source", "kind", "chars", "bytes", "at_limit"), ends, lim


def truncation_rates(docs: DataFrame, **kw) -> DataFrame:
    """Per source: ``n_texts`` (not blank), ``n_cut``, ``n_at_limit``, ``cut_rate`` and the limits found."""
    cut, ends, lim = find_truncated(docs, **kw)
    per = ends.filter(F.col("chars") > 0).groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"))
    c = cut.groupBy("source").agg(F.count(F.lit(1)).alias("n_cut"), F.sum(F.col("at_limit").cast("bigint")).alias("n_at_limit"))
    li = lim.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", F.format_string("%09d", F.col("length")), "unit"))), ", ").alias("limits"))
    name = lambda d, s: d.withColumnRenamed("source", s)
    c, li = name(c, "s1"), name(li, "s2")
    j = per.join(c, per["source"].eqNullSafe(c["s1"]), "left").join(li, per["source"].eqNullSafe(li["s2"]), "left")
    return j.select(
        "source", "n_texts", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), F.coalesce("n_at_limit", F.lit(0)).alias("n_at_limit"),
        (F.coalesce("n_cut", F.lit(0)) / F.col("n_texts")).alias("cut_rate"), F.regexp_replace(F.coalesce("limits", F.lit("")), "(^|, )0+", "$1").alias("limits"),
    )
