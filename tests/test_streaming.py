from collections import Counter

from pyspark.sql import functions as F

from sparsequery.streaming import groups

FILES = [[20, 20, 20, 21], [21, 22, 21], [23], [23, 24, 21, 24]]  # groups of each file's rows; 21 spans three files, 23 two
COUNTS = Counter(c for f in FILES for c in f)


def test_groups_split_over_files_come_out_whole(spark, tmp_path):
    for cells in FILES:
        spark.createDataFrame([(c, j, 1.0) for j, c in enumerate(cells)], "c bigint, i bigint, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    need = spark.createDataFrame(list(COUNTS.items()), "c bigint, n bigint")
    s = groups.complete_groups(groups.file_stream(spark, str(tmp_path / "in"), schema), need, "c", "i", "v")
    out = groups.run_to_table(s).collect()
    assert {r.c: len(r["items"]) for r in out} == COUNTS and len(out) == 5


def test_groups_by_position_need_no_counts(spark, tmp_path):
    for cells in ([1, 1, 2], [2, 2, 3], [3, 5]):
        spark.createDataFrame([(c, 10 * c + j, 1.0) for j, c in enumerate(cells)], "c bigint, i bigint, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    out = groups.groups_by_position(groups.file_stream(spark, str(tmp_path / "in"), schema), "c", "i", "v", str(tmp_path / "out"), str(tmp_path / "mark")).collect()
    assert {r.c: len(r["items"]) for r in out} == {1: 2, 2: 3, 3: 2, 5: 1} and len(out) == 4


def test_event_time_windows(spark, tmp_path):
    spark.createDataFrame([(1, "2025-01-01 00:10:00"), (2, "2025-01-01 00:50:00"), (3, "2025-01-01 01:10:00")], "id int, t string").select("id", F.col("t").cast("timestamp").alias("t")).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    out = groups.run_to_table(groups.windowed_counts(groups.file_stream(spark, str(tmp_path / "in"), schema), "t"), "complete")
    assert sorted(r.n for r in out.collect()) == [1, 2]
