import random

from sparsequery.llm.mixing import flight, land, mix, plan, source_sizes


def test_flight_keeps_totals_and_decides_all_but_two():
    rng = random.Random(0)
    sizes = [float(rng.randint(1, 500)) for _ in range(400)]
    p = [rng.random() for _ in sizes]
    out = flight(sizes, p, random.Random(1))
    assert sum(0 < x < 1 for x in out) <= 2 and abs(sum(out) - sum(p)) < 1e-6
    assert abs(sum(a * b for a, b in zip(sizes, out)) - sum(a * b for a, b in zip(sizes, p))) < 1e-3
    done = land(sizes, out)
    assert set(done) <= {0.0, 1.0} and abs(sum(done) - sum(p)) <= 2
    assert flight([3.0] * 5, [0.4] * 5, rng).count(1.0) == 2 and flight([], [], rng) == []


def test_expectation_is_kept():
    hits = sum(flight([1.0, 2.0, 5.0, 9.0, 4.0], [0.3] * 5, random.Random(i))[0] for i in range(4000))
    assert abs(hits / 4000 - 0.3) < 0.03


def docs(spark):
    r = random.Random(2)
    rows = [(i, "word " * r.randint(1, 60), "big" if i % 3 else "mid", 0) for i in range(900)] + [(2000 + i, "word " * 10, "tiny", 0) for i in range(10)]
    return spark.createDataFrame([*rows, (5000, None, "mid", 1), (5001, "x", None, 1), (5002, "x", "unlisted", 1)], "doc_id bigint, text string, source string, copies int")


def targets(spark):
    return spark.createDataFrame([("big", 0.5, 2), ("mid", 0.4, 3), ("tiny", 0.1, 4), ("absent", 0.0, 2), ("absent", 0.0, 2), (None, 0.3, 1)], "source string, target_weight double, max_repeats int")


def test_mix(spark):
    drawn, report = mix(docs(spark), targets(spark), block_rows=100)
    rows = {r.source: r for r in report.collect()}
    assert set(rows) == {"big", "mid", "tiny", "absent"} and rows["tiny"].short and not rows["big"].short and rows["tiny"].most_copies == 4
    total = sum(r.n_tokens for r in rows.values())
    for s, w in (("big", 0.5), ("mid", 0.4)):
        assert abs(rows[s].drawn_tokens - w * total) < 80 and abs(rows[s].drawn_docs - rows[s].n_docs * w * total / rows[s].n_tokens) <= 2
    d = drawn.toPandas()
    assert d.doc_id.is_unique and d.copies.min() >= 1 and not d.source.isin(["unlisted"]).any()


def test_shrunk_total_meets_the_weights(spark):
    rows = {r.source: r for r in mix(docs(spark), targets(spark), shrink=True)[1].collect()}
    for s, w in (("big", 0.5), ("mid", 0.4), ("tiny", 0.1)):
        assert abs(rows[s].actual_share - w) < 0.1 * w and rows[s].most_copies <= rows[s].max_repeats


def test_short_sources_and_empty_tables(spark):
    p = plan(source_sizes(docs(spark)), targets(spark))
    assert {r.source for r in p.filter("short").collect()} == {"tiny"}
    drawn, report = mix(docs(spark).limit(0), targets(spark))
    assert drawn.count() == 0 and all(r.drawn_tokens == 0 for r in report.collect())
    assert mix(docs(spark), targets(spark).limit(0))[1].count() == 0
