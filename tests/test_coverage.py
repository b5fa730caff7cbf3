"""Files that cover spans, against trying every file and every greedy chain."""

import random

from pyspark.sql import functions as F

from quillstone.operators import coverage

FILE, REQUEST = "`group` string, first long, last long, file string", "`group` string, first long, last long, request long"


def brute_containing(files, requests):
    out = {}
    for g, a, b, r in requests:
        held = [f for f in files if None not in (g, a, b, *f) and f[0] == g and f[1] <= a and f[2] >= b and f[1] <= f[2] and a <= b]
        out[r] = min(held, key=lambda f: (-f[2], -f[1], f[3]))[3] if held else None
    return out


def brute_cover(files, requests, step):
    """The number of files of the smallest cover, by breadth-first search over reachable ends."""
    out = {}
    for g, a, b, r in requests:
        if None in (g, a, b) or a > b:
            continue
        own = [f for f in files if None not in f and f[0] == g and f[1] <= f[2]]
        ends, n = {f[2] for f in own if f[1] <= a <= f[2]}, 1
        seen = set(ends)
        while ends and max(ends) < b and n < 500:
            ends = {f[2] for f in own for e in ends if f[1] <= e + step and f[2] > e} - seen
            seen |= ends
            n += 1
        if ends and max(ends) >= b:
            out[r] = n
    return out


def test_covers_against_search(spark):
    for seed, n, span, step in ((1, 120, 400, 1), (2, 60, 60, 0), (3, 200, 3000, 1)):
        rng = random.Random(seed)
        files = []
        for i in range(n):
            a = rng.randrange(span)
            files.append((rng.choice("ab"), a, a + rng.randrange(-2, 40), f"f{i % 50}"))
        files += files[:5] + [(None, 1, 2, "x"), ("a", None, 2, "y")]
        requests = [(rng.choice("abc"), a, a + rng.randrange(-1, 90), r) for r, a in enumerate(rng.randrange(span) for _ in range(80))] + [(None, 1, 2, 900), ("a", 1, None, 901)]
        f, q = spark.createDataFrame(files, FILE).repartition(4), spark.createDataFrame(requests, REQUEST)
        assert {r["request"]: r["file"] for r in coverage.containing(f, q).collect()} == brute_containing(files, requests)
        got = coverage.smallest_cover(f, q, step).collect()
        want = brute_cover(files, requests, step)
        assert {r["request"]: r["n_files"] for r in got} == want
        chains = {}
        for r in sorted(got, key=lambda r: r["nth"]):
            chains.setdefault(r["request"], []).append(r["file"])
        assert {r: len(c) for r, c in chains.items()} == want


def test_long_chain_and_no_files(spark):
    files = [("a", 10 * i, 10 * i + 9, f"{i:04d}") for i in range(300)]
    f = spark.createDataFrame(files, FILE)
    q = spark.createDataFrame([("a", 5, 2995, 1), ("a", 0, 9, 2), ("a", 0, 3000, 3)], REQUEST)
    got = sorted((r["request"], r["nth"], r["file"]) for r in coverage.smallest_cover(f, q).collect())
    assert got == [(1, i + 1, f"{i:04d}") for i in range(300)] + [(2, 1, "0000")]
    assert coverage.smallest_cover(f.where("false"), q).count() == 0 and coverage.containing(f.where("false"), q).where("file is null").count() == 3


def _same_as_sql(spark, folder, name, rows):
    """A registered query and its SQL over events (event_id, ts, user_id, event_type, value)."""
    import duckdb
    from oracle import assert_same

    from quillstone.plans import coverage as plans

    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    got = plans.Q[name](spark, str(folder)).toPandas()
    assert_same(got, con.sql(plans.O[name]).df())
    return got


def test_containing_takes_the_nearest_second(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:10.4", 1, "error", 0.0), (2, "2024-01-01 00:00:10.6", 1, "click", 99.0), (3, "2024-01-01 00:00:20.5", 2, "error", 0.0), (4, "2024-01-01 00:00:20.4", 2, "view", 12.0), (5, "2024-01-01 00:00:21.5", 3, "error", 0.0), (6, "2024-01-01 00:00:21.9", 3, "view", 12.0)]
    got = _same_as_sql(spark, tmp_path, "span_containing", rows)
    assert {r.request: r.file for r in got.itertuples()} == {1: None, 3: "view4", 5: "view6"}


def test_cover_takes_the_nearest_second(spark, tmp_path):
    rows = [(1, "2024-01-01 00:01:40.4", 1, "error", 0.0), (2, "2024-01-01 00:01:40.4", 1, "click", 5.0), (3, "2024-01-01 05:01:41.6", 1, "view", 9.0)]
    rows += [(4, "2024-01-01 00:01:40.4", 2, "error", 0.0), (5, "2024-01-01 00:01:40.4", 2, "click", 5.0), (6, "2024-01-01 05:01:41.4", 2, "view", 9.0)]
    got = _same_as_sql(spark, tmp_path, "span_cover", rows)
    assert {(r.request, r.n_files, r.nth, r.file) for r in got.itertuples()} == {(4, 2, 1, "click5"), (4, 2, 2, "view6")}
