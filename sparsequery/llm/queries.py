"""The queries pN_... of the problems tagged llm, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from . import clusters, frequency, mixing, neighbours, percentiles, splits, tokenize, topn, truncation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query()
def p8_ids(spark, d):
    """Every document's ids of byte_bpe_50k."""
    return tokenize.encode_texts(table(spark, d, "documents"))


@query()
def p9_found(spark, d):
    """Sources too small for their weight even when repeated as often as allowed, from the report of the drawn mixture."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mixtargets"))[1].filter("short").select("source")


@query()
def p9_shares(spark, d):
    """The shares of all tokens that the sources reach."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mixtargets"))[1]


@query()
def p9_met(spark, d):
    """The shares when the total shrinks until every source that has documents meets its weight."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mixtargets"), shrink=True)[1]


@query("""SELECT true AS ok""")
def p9_checked(spark, d):
    """Whether the draw keeps its promises: no document above its source's cap, and every source within one document of the tokens wanted."""
    drawn, report = mixing.mix(table(spark, d, "documents"), table(spark, d, "mixtargets"))
    top = drawn.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    r = report.join(top, "source", "left")
    want = F.col("target_weight") * F.lit(float(report.agg(F.sum("n_tokens")).first()[0] or 0))
    reach = F.least(want, F.col("max_repeats") * F.col("n_tokens"))
    fair = (F.col("most_copies") <= F.col("max_repeats")) & (F.abs(F.col("drawn_tokens") - reach) <= F.coalesce("largest", F.lit(0)))
    return r.agg(F.min(F.coalesce(fair, F.lit(False))).alias("ok"))


@query()
def p9_drawn(spark, d):
    """The documents drawn, with their copies."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mixtargets"))[0]


@query()
def p10_found(spark, d):
    """Documents whose text breaks off."""
    return truncation.find_truncated(table(spark, d, "documents"))[0].select(F.col("doc").alias("doc_id"))


@query()
def p10_rates(spark, d):
    """How often each source cuts, and at which lengths."""
    return truncation.truncation_rates(table(spark, d, "documents"))


# The usable values of expression and each pair's current one, as SQL.
CURRENT = """current_pairs AS (SELECT cell_integer_id, gene_integer_id, value FROM (SELECT *, row_number() OVER (PARTITION BY cell_integer_id, gene_integer_id ORDER BY loaded_at DESC NULLS LAST, value DESC) k
  FROM expression WHERE value IS NOT NULL AND NOT isnan(value) AND value > 0) WHERE k = 1)"""
CELL_BATCH = """cell_batch AS (SELECT cell_integer_id, lower(trim(any_value(batch))) batch, any_value(donor) donor, any_value(total_counts)::DOUBLE total_counts FROM cells GROUP BY 1)"""


def cell_rows(cells: DataFrame) -> DataFrame:
    """(cell_integer_id, batch, donor, total_counts) once per cell: the latest delivery, batch trimmed and in lower case."""
    b = F.lower(F.trim(F.col("batch")))
    one = cells.filter(F.col("cell_integer_id").isNotNull()).groupBy("cell_integer_id").agg(F.max(F.struct("loaded_at", b.alias("batch"), "donor", F.col("total_counts").cast("double").alias("total_counts"))).alias("c"))
    return one.select("cell_integer_id", "c.batch", "c.donor", "c.total_counts")


def usable(c: str):
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0)


@query(f"WITH {CURRENT} SELECT cell_integer_id, gene_integer_id FROM (SELECT *, row_number() OVER (PARTITION BY cell_integer_id ORDER BY value DESC, gene_integer_id) r FROM current_pairs) WHERE r <= 5")
def p3_found(spark, d):
    """Per cell its first five genes by current value."""
    now = topn.current_values(table(spark, d, "expression"))
    return topn.top_n(now, "cell_integer_id", "gene_integer_id", "value", 5).select("cell_integer_id", "gene_integer_id")


@query(f"WITH {CURRENT} SELECT gene_integer_id, cell_integer_id, value, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY gene_integer_id ORDER BY value DESC, cell_integer_id) r FROM current_pairs) WHERE r <= 10")
def p3_gene_cells(spark, d):
    """Per gene its first ten cells by current value; one gene holds a tenth of the rows."""
    now = topn.current_values(table(spark, d, "expression"))
    return topn.top_n(now, "gene_integer_id", "cell_integer_id", "value", 10)


@query(f"""WITH {CELL_BATCH}, u AS (SELECT * FROM cell_batch WHERE batch IS NOT NULL AND total_counts > 0 AND NOT isnan(total_counts)),
  q AS (SELECT batch, quantile_cont(total_counts, 0.1) q10, quantile_cont(total_counts, 0.9) q90 FROM u GROUP BY 1)
  SELECT cell_integer_id FROM u JOIN q USING (batch) WHERE total_counts > 3 * q90 OR total_counts < q10 / 3""")
def p5_found(spark, d):
    """Cells whose total lies far outside the usual range of their batch."""
    cells = stage(cell_rows(table(spark, d, "cells")).filter(F.col("batch").isNotNull() & usable("total_counts")).select("cell_integer_id", "batch", "total_counts"), "totals")
    q = percentiles.multi_select(cells, ["batch"], "total_counts", [0.1, 0.9])
    wide = q.groupBy("batch").agg(F.max(F.when(F.col("p") == 0.1, F.col("percentile"))).alias("q10"), F.max(F.when(F.col("p") == 0.9, F.col("percentile"))).alias("q90"))
    out = (F.col("total_counts") > 3 * F.col("q90")) | (F.col("total_counts") < F.col("q10") / 3)
    return cells.join(wide, "batch").filter(out).select("cell_integer_id")


@query(f"""WITH {CELL_BATCH}, u AS (SELECT * FROM cell_batch WHERE total_counts > 0 AND NOT isnan(total_counts)), q AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE p)
  SELECT batch, p, count(*) n, round(CASE p WHEN 0.1 THEN quantile_cont(total_counts, 0.1) WHEN 0.25 THEN quantile_cont(total_counts, 0.25) WHEN 0.5 THEN quantile_cont(total_counts, 0.5) WHEN 0.75 THEN quantile_cont(total_counts, 0.75) ELSE quantile_cont(total_counts, 0.9) END, 4) percentile
  FROM u, q GROUP BY batch, p""")
def p5_total_counts(spark, d):
    """Percentiles of usable total_counts per batch; cells without a batch are a group of their own."""
    cells = cell_rows(table(spark, d, "cells")).filter(usable("total_counts")).select("batch", "total_counts")
    return percentiles.multi_select(cells, ["batch"], "total_counts", [0.1, 0.25, 0.5, 0.75, 0.9]).withColumn("percentile", F.round("percentile", 4))


@query(f"""WITH {CURRENT}, {CELL_BATCH} SELECT batch, count(*) n, 0.5::DOUBLE p, round(median(value), 4) percentile FROM current_pairs LEFT JOIN cell_batch USING (cell_integer_id) GROUP BY 1""")
def p5_expression(spark, d):
    """Median current value of expression per batch of the cell."""
    now = topn.current_values(table(spark, d, "expression"))
    b = cell_rows(table(spark, d, "cells")).select("cell_integer_id", "batch")
    j = now.join(b, "cell_integer_id", "left").select("batch", "value")
    return percentiles.multi_select(j, ["batch"], "value", [0.5]).withColumn("percentile", F.round("percentile", 4))


@query("SELECT true AS within")
def p5_bounded(spark, d):
    """Whether the ranks of all combined percentiles are within n / 64 plus one per load of those asked for."""
    c = table(spark, d, "cells").filter(F.col("cell_integer_id").isNotNull())
    v = cell_rows(c).filter(usable("total_counts")).select(F.col("batch").alias("b"), "total_counts")
    loads = c.agg(F.countDistinct("source_file")).first()[0] + 1
    j = p5_combined(spark, d).join(v, F.col("batch").eqNullSafe(F.col("b"))).groupBy("batch", "p", "n", "percentile").agg(F.sum((F.col("total_counts") < F.col("percentile")).cast("bigint")).alias("lo"), F.sum((F.col("total_counts") <= F.col("percentile")).cast("bigint")).alias("hi"))
    room = F.col("n") / 64 + F.lit(loads)
    fits = (F.col("lo") <= F.col("p") * F.col("n") + room) & (F.col("hi") >= F.col("p") * F.col("n") - room)
    return j.agg(F.min(fits).alias("within"))


@query()
def p5_combined(spark, d):
    """Percentiles per batch from summaries of each source file, combined; the rank is off by at most n / 64 plus one per file."""
    c = table(spark, d, "cells").filter(F.col("cell_integer_id").isNotNull())
    one = c.groupBy("cell_integer_id").agg(F.max(F.struct("loaded_at", "source_file", F.lower(F.trim("batch")).alias("batch"), F.col("total_counts").cast("double").alias("total_counts"))).alias("c"))
    one = one.select("c.source_file", "c.batch", "c.total_counts").filter(usable("total_counts"))
    return percentiles.combine(percentiles.summarize(one, "source_file", ["batch"], "total_counts"), ["batch"], [0.1, 0.5, 0.9])


def _batches(spark, d) -> tuple[DataFrame, DataFrame]:
    cells = stage(cell_rows(table(spark, d, "cells")).select("cell_integer_id", "batch", "donor"), "batches")
    return cells, splits.tied_groups(cells, "batch", "donor")


@query("""WITH RECURSIVE c AS (SELECT DISTINCT lower(trim(batch)) b, donor t FROM cells WHERE batch IS NOT NULL AND donor IS NOT NULL), e AS (SELECT DISTINCT x.b a, y.b b FROM c x JOIN c y USING (t)),
  r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS batch_a, b AS batch_b FROM r WHERE a < b""")
def p6_found(spark, d):
    """Pairs of batches that must share a split."""
    _, comp = _batches(spark, d)
    a = comp.select(F.col("node").alias("batch_a"), "component")
    b = comp.select(F.col("node").alias("batch_b"), "component")
    return a.join(b, "component").filter("batch_a < batch_b").select("batch_a", "batch_b")


@query()
def p6_splits(spark, d):
    """Every cell's split."""
    cells, comp = _batches(spark, d)
    # a cell without a batch is tied to nothing
    unit = F.coalesce(F.concat(F.lit("batch "), "component"), F.concat(F.lit("cell "), F.col("cell_integer_id").cast("string")))
    members = cells.join(comp, cells["batch"] == comp["node"], "left").select("cell_integer_id", unit.alias("unit"))
    return splits.assign_splits(members, table(spark, d, "splittargets")).select("cell_integer_id", "split_name")


@query()
def p6_shares(spark, d):
    """Cells, batches and share of each split."""
    s = p6_splits(spark, d)
    b = cell_rows(table(spark, d, "cells")).select("cell_integer_id", "batch")
    t = stage(s.join(b, "cell_integer_id").groupBy("split_name").agg(F.count(F.lit(1)).alias("n_cells"), F.countDistinct("batch").alias("n_batches")), "shares")
    n = t.agg(F.sum("n_cells")).first()[0] or 1
    return t.withColumn("share", F.col("n_cells") / F.lit(float(n)))


@query("SELECT true AS together, true AS close")
def p6_checked(spark, d):
    """Whether no batch and no tied batches are in two splits, and every share is within half the largest tied group of its target."""
    cells, comp = _batches(spark, d)
    s = p6_splits(spark, d)
    j = stage(s.join(cells.withColumnRenamed("cell_integer_id", "c"), F.col("cell_integer_id") == F.col("c")).join(comp, F.col("batch") == F.col("node"), "left").select("split_name", "batch", "component"), "splits")
    t = table(spark, d, "splittargets").groupBy(F.col("split_name").alias("n")).agg(F.max("target_share").alias("target_share"))
    apart = j.filter("component is not null").groupBy("component").agg(F.countDistinct("split_name").alias("k")).agg(F.coalesce(F.max("k"), F.lit(1)) == 1).first()[0]
    n, largest = j.count(), j.filter("component is not null").groupBy("component").count().agg(F.max("count")).first()[0] or 0
    share = t.join(j.groupBy("split_name").count(), F.col("n") == F.col("split_name"), "left").select(F.abs(F.coalesce("count", F.lit(0)) - F.col("target_share") * F.lit(n)).alias("off"))
    return share.agg(F.lit(apart).alias("together"), (F.max("off") <= F.lit(largest / 2 + 1)).alias("close"))


def _genes(spark, d) -> DataFrame:
    return table(spark, d, "genes").select("gene_integer_id").filter("gene_integer_id is not null").distinct()


def _n_cells(spark, d) -> int:
    return table(spark, d, "cells").agg(F.countDistinct("cell_integer_id")).first()[0]


def _terms(rows: DataFrame) -> DataFrame:
    f = frequency.ngram_frequencies(rows, "cell_integer_id", "gene_integer_id")
    return f.select(F.col("gram")[0].alias("gene_integer_id"), "n_occurrences", "n_records")


def _falling(rows: DataFrame) -> DataFrame:
    """A cell's genes as a record: by value descending, then gene."""
    return rows.select("cell_integer_id", "gene_integer_id", (-F.col("value").cast("double")).alias("falling"))


@query("""WITH {0}, o AS (SELECT cell_integer_id c, gene_integer_id g, lead(gene_integer_id) OVER w g2, lead(gene_integer_id, 2) OVER w g3 FROM current_pairs WINDOW w AS (PARTITION BY cell_integer_id ORDER BY value DESC, gene_integer_id)),
  n AS (SELECT count(DISTINCT cell_integer_id) n FROM cells), x AS (SELECT c, CAST(g AS VARCHAR) gram FROM o UNION ALL SELECT c, concat_ws(',', g, g2) FROM o WHERE g2 IS NOT NULL UNION ALL SELECT c, concat_ws(',', g, g2, g3) FROM o WHERE g3 IS NOT NULL)
  SELECT gram, count(*) n_occurrences, count(DISTINCT c) n_records FROM x, n GROUP BY gram HAVING count(DISTINCT c) >= 0.001 * any_value(n)""".format(CURRENT))
def p7_ngrams(spark, d):
    """Runs of up to three genes in the order of their value, with their occurrences and cells, those too rare to be useful left out."""
    f = frequency.ngram_frequencies(_falling(topn.current_values(table(spark, d, "expression"))), "cell_integer_id", "gene_integer_id", ["falling"], 3)
    f = frequency.mark(f, _n_cells(spark, d)).filter("mark <> 'rare'")
    return f.select(F.array_join(F.transform("gram", lambda x: x.cast("string")), ",").alias("gram"), "n_occurrences", "n_records")


@query("""WITH n AS (SELECT count(DISTINCT cell_integer_id) n FROM cells), c AS (SELECT gene_integer_id, count(DISTINCT cell_integer_id) k FROM expression WHERE value > 0 AND NOT isnan(value) GROUP BY 1)
  SELECT DISTINCT g.gene_integer_id FROM genes g LEFT JOIN c USING (gene_integer_id), n WHERE g.gene_integer_id IS NOT NULL AND (coalesce(k, 0) < 0.001 * n OR coalesce(k, 0) > 0.5 * n)""")
def p7_found(spark, d):
    """Genes too rare or too common by their current values: the intervals of depth 1 in the suffix array of the cells' genes."""
    f = frequency.ngram_frequencies(_falling(topn.current_values(table(spark, d, "expression"))), "cell_integer_id", "gene_integer_id", ["falling"], 2)
    t = _genes(spark, d).join(f.filter(F.size("gram") == 1).select(F.col("gram")[0].alias("gene_integer_id"), "n_records"), "gene_integer_id", "left")
    return frequency.mark(t, _n_cells(spark, d)).filter("mark <> 'useful'").select("gene_integer_id")


@query("""WITH n AS (SELECT count(DISTINCT cell_integer_id) n FROM cells), g AS (SELECT DISTINCT gene_integer_id FROM genes WHERE gene_integer_id IS NOT NULL),
  c AS (SELECT gene_integer_id, count(*) rows, count(DISTINCT cell_integer_id) cells, count(DISTINCT CASE WHEN value > 0 AND NOT isnan(value) THEN cell_integer_id END) k FROM expression GROUP BY 1)
  SELECT gene_integer_id, coalesce(rows, 0) n_rows, coalesce(cells, 0) n_cells, coalesce(k, 0) n_current, CASE WHEN coalesce(k, 0) < 0.001 * n THEN 'rare' WHEN coalesce(k, 0) > 0.5 * n THEN 'common' ELSE 'useful' END mark
  FROM g LEFT JOIN c USING (gene_integer_id), n""")
def p7_genes(spark, d):
    """Rows and cells of every gene, those without rows included, and its mark."""
    e = table(spark, d, "expression")
    rows = _terms(e).withColumnsRenamed({"n_occurrences": "n_rows", "n_records": "n_cells"})
    now = _terms(e.withColumn("value", F.col("value").cast("double")).filter(usable("value"))).select("gene_integer_id", F.col("n_records").alias("n_current"))
    t = _genes(spark, d).join(rows, "gene_integer_id", "left").join(now, "gene_integer_id", "left").na.fill(0)
    return frequency.mark(t, _n_cells(spark, d), column="n_current")


@query("SELECT coalesce(CAST(highly_variable AS VARCHAR), 'null') state, count(*) n_rows, count(DISTINCT gene_integer_id) n_genes FROM genes GROUP BY 1")
def p7_states(spark, d):
    """Rows and genes of each state of highly_variable, null included."""
    g = table(spark, d, "genes").select("gene_integer_id", F.coalesce(F.col("highly_variable").cast("string"), F.lit("null")).alias("state"))
    f = frequency.ngram_frequencies(g, "gene_integer_id", "state")
    return f.select(F.col("gram")[0].alias("state"), F.col("n_occurrences").alias("n_rows"), F.col("n_records").alias("n_genes"))


# All pairs of usable vectors that are similar enough, the pair of a cell with itself included.
SIMILAR = """WITH v AS (SELECT cell_integer_id id, any_value(key)::DOUBLE[] k FROM cells WHERE len(key) = 64 AND len(list_filter(key, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(key, lambda x: x <> 0)) > 0 GROUP BY 1),
  s AS (SELECT a.id ia, b.id ib, CASE WHEN a.id = b.id THEN 1 ELSE list_cosine_similarity(a.k, b.k) END c FROM v a, v b WHERE a.id = b.id OR list_cosine_similarity(a.k, b.k) >= {0})"""


@query(SIMILAR.format(0.99) + """, r AS (SELECT *, row_number() OVER (PARTITION BY ia ORDER BY c DESC, ib) k FROM s WHERE ia <> ib)
  SELECT DISTINCT least(ia, ib) id_a, greatest(ia, ib) id_b FROM r WHERE k <= 10""")
def p1_found(spark, d):
    """Pairs with a cosine of at least 0.99 of which one is among the ten most similar of the other."""
    near = neighbours.nearest_vectors(table(spark, d, "cells"), "cell_integer_id", "key", k=10, least=0.99)
    return neighbours.similar_pairs(near, 0.99).select("id_a", "id_b")


@query()
def p1_neighbours(spark, d):
    """The ten most similar cells of every cell."""
    return neighbours.nearest_vectors(table(spark, d, "cells"), "cell_integer_id", "key", k=10)


@query(SIMILAR.replace("WHERE a.id = b.id OR list_cosine_similarity(a.k, b.k) >= {0}", "WHERE a.id % 50 = 0 AND a.id <> b.id") + """ SELECT ia id, ib neighbour FROM (SELECT ia, ib, row_number() OVER (PARTITION BY ia ORDER BY c DESC, ib) r FROM s) WHERE r <= 10""")
def p1_exact(spark, d):
    """The ten most similar of all cells for every cell whose id is divisible by 50, by brute force."""
    return neighbours.exact_neighbours(table(spark, d, "cells"), "cell_integer_id", "key", F.col("cell_integer_id") % 50 == 0).select("id", "neighbour")


@query("SELECT true AS enough")
def p1_recall(spark, d):
    """Whether p1_neighbours finds at least 0.9 of the exact neighbours of the cells whose id is divisible by 50."""
    cells = table(spark, d, "cells")
    exact = neighbours.exact_neighbours(cells, "cell_integer_id", "key", F.col("cell_integer_id") % 50 == 0)
    found = p1_neighbours(spark, d).filter(F.col("id") % 50 == 0)
    return neighbours.recall(found, exact).select((F.col("recall") >= 0.9).alias("enough"))


def cell_type():
    """The type in one spelling."""
    return F.regexp_replace(F.lower(F.trim("cell_type")), "[ _]+", "-")


@query(SIMILAR.format(0.86) + """, n AS (SELECT ia, list_sort(list(ib)) l FROM s GROUP BY 1), g AS (SELECT l, list(ia) ids, min(ia) cluster_id FROM n GROUP BY 1 HAVING count(*) = len(l) AND len(l) >= 3)
  SELECT unnest(ids) cell_integer_id, cluster_id FROM g""")
def p2_found(spark, d):
    """Groups of cells all similar (cosine 0.86) to one another and to no cell outside: of the records in a chosen cluster of
    the hierarchy, the groups that its cut at 0.86 leaves, checked exactly."""
    g = clusters.density_groups(table(spark, d, "cells"), "cell_integer_id", "key", eps=0.14, reach=0.5)
    g["labels"] = g["labels"].filter("cluster is not null")
    out = stage(clusters.closed_groups(g, 64, 0.86).select(F.col("id").alias("cell_integer_id"), "base"), "closed")
    name = out.groupBy("base").agg(F.min("cell_integer_id").alias("cluster_id"))
    return out.join(name, "base").select("cell_integer_id", "cluster_id")


@query()
def p2_clusters(spark, d):
    """Size, exemplars and cell types of every chosen cluster of the hierarchy."""
    cells = table(spark, d, "cells")
    g = clusters.density_groups(cells, "cell_integer_id", "key", eps=0.14, reach=0.5)
    lab = g["labels"].filter("cluster is not null")
    w = Window.partitionBy("cluster").orderBy(F.desc("density"), "id")
    best = lab.withColumn("r", F.row_number().over(w)).filter("r <= 3").groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"].cast("string")), ",").alias("exemplars"))
    kinds = cells.groupBy("cell_integer_id").agg(F.max(cell_type()).alias("kind")).withColumnRenamed("cell_integer_id", "cid")
    per = lab.join(kinds, lab["id"] == kinds["cid"], "left").groupBy("cluster", "kind").agg(F.count(F.lit(1)).alias("n"))
    types = per.groupBy("cluster").agg(F.sum("n").cast("bigint").alias("n_cells"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.coalesce("kind", F.lit("(none)")).alias("kind")))), lambda x: F.concat(x["kind"], F.lit(":"), (-x["m"]).cast("string"))), ", ").alias("cell_types"))
    return types.join(best, "cluster").select(F.col("cluster").alias("cluster_id"), "n_cells", "exemplars", "cell_types")


@query("SELECT true AS sound")
def p2_checked(spark, d):
    """Whether the clusters have at least three cells, no cell is in two, sizes and types add up, and exemplars are members."""
    g = clusters.density_groups(table(spark, d, "cells"), "cell_integer_id", "key", eps=0.14, reach=0.5)
    lab = stage(g["labels"].filter("cluster is not null").select("id", F.col("cluster").alias("c")), "labelled")
    out = stage(p2_clusters(spark, d), "described")
    size = lab.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.countDistinct("id").alias("m"))
    ok = out.join(size, F.col("cluster_id") == F.col("c"), "full").agg(F.min(F.coalesce((F.col("k") == F.col("n_cells")) & (F.col("k") == F.col("m")) & (F.col("k") >= 3), F.lit(False))).alias("a"))
    best = out.select("cluster_id", F.explode(F.split("exemplars", ",")).alias("e")).withColumn("e", F.col("e").cast("bigint"))
    strange = best.join(lab, (F.col("e") == F.col("id")) & (F.col("cluster_id") == F.col("c")), "left_anti")
    kinds = F.aggregate(F.split("cell_types", ", "), F.lit(0).cast("bigint"), lambda a, x: a + F.regexp_extract(x, ":(\\d+)$", 1).cast("bigint"))
    sums = out.agg(F.min(kinds == F.col("n_cells")).alias("b"))
    sound = bool(ok.first()["a"]) and bool(sums.first()["b"]) and strange.isEmpty()
    return spark.createDataFrame([(sound,)], "sound boolean")
