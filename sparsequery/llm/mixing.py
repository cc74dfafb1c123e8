"""Mixing sources to target token shares by cube-method balanced sampling.

Every source should contribute ``target_weight`` of all tokens of listed sources. A source with too few tokens is
repeated: each document is taken ``floor(r)`` times for the needed repetition ``r`` (at most ``max_repeats``) and once
more with probability ``r - floor(r)``. Which documents get the extra copy is drawn with the cube method: inclusion
probabilities are moved along the null space of the constraints (token total and document total of the source) until
they are 0 or 1. Blocks of a source fly in parallel; what each leaves undecided (at most two documents) flies again
with that of the other blocks, until one small landing problem per source is left.
"""

from __future__ import annotations

import random
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, workers
from .tokenize import DEFAULT_VOCABULARY, count_tokens

EPS = 1e-9


def source_sizes(docs: DataFrame, source_col: str = "source", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(source, n_docs, n_tokens) of every source, null included; partial sums are formed before the shuffle."""
    t = count_tokens(docs, [source_col], vocabulary=vocabulary)
    return t.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").cast("bigint").alias("n_tokens"))


def plan(sizes: DataFrame, targets: DataFrame, shrink: bool = False) -> DataFrame:
    """Per listed source: tokens, documents, wanted tokens and the repetition, capped at ``max_repeats``.

    ``wanted`` is the weight times the tokens of all documents of listed sources; ``short`` sources can't reach it. With
    ``shrink`` that total shrinks until every source that has documents reaches its weight (``short`` stays what it is).
    A source listed twice counts once (largest weight); a null weight or cap counts as 0; a source without documents
    has 0 tokens and is short unless its weight is 0.
    """
    t = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.coalesce(F.col("target_weight"), F.lit(0.0))).alias("target_weight"), F.max(F.coalesce(F.col("max_repeats"), F.lit(0))).cast("bigint").alias("max_repeats"))
    s = sizes.withColumnRenamed("source", "s")
    j = t.join(s, t["source"] == s["s"], "left").drop("s").na.fill(0, ["n_docs", "n_tokens"])
    j = stage(j, "sources")  # one row per listed source
    most = F.col("max_repeats") * F.col("n_tokens")
    sums = j.agg(F.sum("n_tokens").alias("all"), F.min(F.when((most > 0) & (F.col("target_weight") > 0), most / F.col("target_weight"))).alias("met")).first()
    total = float(sums["all"] or 0)
    short = most < F.col("target_weight") * F.lit(total)
    want = F.col("target_weight") * F.lit(min(total, sums["met"] or 0.0) if shrink else total)
    return j.withColumn("wanted", want).withColumn("short", short).withColumn("repeats", F.when(F.col("n_tokens") == 0, F.lit(0.0)).otherwise(F.least(F.col("max_repeats").cast("double"), want / F.col("n_tokens"))))


def flight(sizes: list[float], probs: list[float], rng: random.Random) -> list[float]:
    """The flight phase under two constraints, token total and count: at most two entries stay between 0 and 1.

    Three undecided units at a time span a null space of one dimension; a step along it in either direction, chosen
    so that expectations are kept, decides at least one of them.
    """
    p = list(probs)
    todo = [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
    todo.reverse()
    live: list[int] = []
    while True:
        while len(live) < 3 and todo:
            live.append(todo.pop())
        if len(live) < 3:
            if len(live) == 2 and sizes[live[0]] == sizes[live[1]]:
                live = _step(p, live, [1.0, -1.0], rng)
                continue
            return p
        a, b, c = live
        u = [sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b]]  # orthogonal to sizes and to ones
        if not any(u):
            u = [1.0, -1.0, 0.0]
        live = _step(p, live, u, rng)


def _step(p: list[float], live: list[int], u: list[float], rng: random.Random) -> list[int]:
    up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(live, u) if v)
    down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(live, u) if v)
    move = up if rng.random() * (up + down) < down else -down
    rest = []
    for i, v in zip(live, u):
        x = p[i] + move * v
        p[i] = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x
        if 0.0 < p[i] < 1.0:
            rest.append(i)
    return rest


def land(sizes: list[float], probs: list[float]) -> list[float]:
    """Decide the last few units: of all roundings the one nearest in tokens, then in count."""
    left = [i for i, x in enumerate(probs) if 0.0 < x < 1.0]
    scale = max([1.0, *(sizes[i] for i in left)])
    best = min(range(1 << len(left)), key=lambda m: (abs(sum(sizes[i] * ((m >> k & 1) - probs[i]) for k, i in enumerate(left))) / scale, abs(sum((m >> k & 1) - probs[i] for k, i in enumerate(left)))))
    out = list(probs)
    for k, i in enumerate(left):
        out[i] = float(best >> k & 1)
    return out


def _fly(seed: int, last: bool):
    def run(pdf):
        pdf = pdf.sort_values(["doc", "n_tokens"], kind="stable").reset_index(drop=True)
        if len(pdf):
            rng = random.Random(zlib.crc32(f"{seed}|{pdf.source[0]}|{pdf.block[0]}".encode()))
            sizes = pdf.n_tokens.astype(float).tolist()
            p = flight(sizes, pdf.p.tolist(), rng)
            pdf["p"] = land(sizes, p) if last else p
        return pdf

    return run


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, block_rows: int = 50_000, seed: int = 0, shrink: bool = False) -> tuple[DataFrame, DataFrame]:
    """(drawn, report). drawn: (doc_id, source, n_tokens, copies >= 1); report: one row per listed source.

    ``share_of_all`` is what a source contributes of the tokens of all listed documents, the total that weights refer to;
    ``actual_share`` is its part of the tokens drawn. While sources are short the other sources' parts exceed their
    weights, as shares add up to 1; with ``shrink`` (see :func:`plan`) only absent sources cause that.

    ``block_rows``: about so many documents fly in one task; a source of any size is cut into blocks. Documents of
    unlisted or null sources take no part; texts without tokens are drawn like others of size 0. Empty tables give
    empty results. The draw depends only on the ids, sizes and ``seed``.
    """
    workers(docs.sparkSession)
    tokens = stage(count_tokens(docs, ["doc_id", "source"], vocabulary=vocabulary), "tokens")
    sizes = tokens.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").cast("bigint").alias("n_tokens"))
    plans = stage(plan(sizes, targets, shrink), "plan")
    listed = tokens.join(plans.select("source", "repeats", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block_rows)).cast("bigint").alias("blocks")), "source")
    base = F.floor(F.col("repeats") + EPS)
    units = listed.select(
        F.col("doc_id").alias("doc"), "source", "n_tokens", base.cast("bigint").alias("base"), F.greatest(F.col("repeats") - base, F.lit(0.0)).alias("p"),
        F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("block"), "blocks",
    )
    settled, width = [], 1 << 30
    blocks = plans.agg(F.max(F.ceil(F.col("n_docs") / block_rows))).first()[0] or 1
    while True:
        last = blocks <= 1
        flown = stage(units.groupBy("source", "block").applyInPandas(_fly(seed + len(settled), last), units.schema), "flight")
        if last:
            settled.append(flown)
            break
        settled.append(flown.filter(F.col("p").isin(0.0, 1.0)))
        # at most two undecided documents a block: thousands of blocks fit into one of the next round
        units = flown.filter(~F.col("p").isin(0.0, 1.0)).withColumn("block", F.floor(F.col("block") / F.lit(block_rows // 2)).cast("bigint"))
        blocks = -(-blocks // (block_rows // 2))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    drawn = out.select(F.col("doc").alias("doc_id"), "source", "n_tokens", (F.col("base") + F.col("p").cast("bigint")).alias("copies")).filter(F.col("copies") > 0)
    got = drawn.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).cast("bigint").alias("drawn_tokens"), F.sum("copies").cast("bigint").alias("drawn_docs"), F.max("copies").cast("bigint").alias("most_copies"))
    r = stage(plans.join(got, "source", "left").na.fill(0, ["drawn_tokens", "drawn_docs", "most_copies"]), "report")
    sums = r.agg(F.sum("drawn_tokens"), F.sum("n_tokens")).first()
    share = lambda c, n: (F.col(c) / F.lit(float(n)) if n else F.lit(0.0))
    return drawn, r.select("source", "target_weight", "max_repeats", "n_docs", "n_tokens", "short", "drawn_docs", "drawn_tokens", "most_copies", share("drawn_tokens", sums[1]).alias("share_of_all"), share("drawn_tokens", sums[0]).alias("actual_share"))
