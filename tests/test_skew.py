from collections import Counter, defaultdict

from sparsequery.operators.skew import frequent_keys, heavy_keys, salt_column, salted_aggregate

SCHEMA = "k int, d bigint, v double, __sq_n int"
DATA = [(1, i % 7, float(i % 5), 0) for i in range(400)] + [(None, i % 3, None, 1) for i in range(100)] + [(5, 1, float("nan"), 2), (5, None, -1.0, 2), (6, 2, 3.0, 3)]


def test_against_a_model(spark):
    got = {r.k: r for r in salted_aggregate(spark.createDataFrame(DATA, SCHEMA).repartition(4), "k", "v", "d", heavy_share=0.1, salts=4).collect()}
    own = defaultdict(list)
    for k, d, v, _ in DATA:
        own[k].append((d, v))
    assert set(got) == set(own)
    for k, x in own.items():
        u = [v for _, v in x if v is not None and v > 0]
        r = got[k]
        assert (r.n_rows, r.n_distinct, r.n_usable) == (len(x), len({d for d, _ in x if d is not None}), len(u))
        assert (r.sum_value, r.min_value, r.max_value) == ((sum(u), min(u), max(u)) if u else (None, None, None))


def test_frequent_keys_and_empty_input(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    want = {k for k, n in Counter(x[0] for x in DATA).items() if n >= 0.1 * len(DATA)}
    assert {r.k for r in frequent_keys(df, "k", 0.1).collect()} == want
    assert frequent_keys(df.limit(0), "k", 0.1).count() == 0 and salted_aggregate(df.limit(0), "k", "v", "d").count() == 0


def test_rows_of_a_heavy_key_are_spread(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    heavy = [r.k for r in heavy_keys(df, "k", 0.1).collect()]
    assert set(heavy) == {1, None}
    for distinct in (None, "d"):
        salts = df.select("k", salt_column(df, "k", heavy, distinct, 8).alias("salt")).distinct().toPandas()
        per = salts.fillna(-1).groupby("k").salt.nunique()
        assert per[1] > 1 and per[5] == 1 and per[6] == 1
    wide = df.select("k", "d", "v")
    got = {r.k: r.n_rows for r in salted_aggregate(wide, "k", heavy_share=0.1).collect()}
    assert got == Counter(x[0] for x in DATA)
