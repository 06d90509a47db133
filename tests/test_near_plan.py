"""Plans of near-duplicate joins: rows that grow with the hashes never pass through the driver."""

import random

from tagloom.operators import neardup as nd


def joins_after(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_band_rows_are_not_broadcast(spark):
    draw = random.Random(5)
    base = [(draw.getrandbits(32), draw.getrandbits(32)) for _ in range(150)]
    distinct = spark.createDataFrame(base + [(a ^ 3, b) for a, b in base], "h1 bigint, h2 bigint")
    for distance, bands in ((7, 4), (9, 5)):
        plan = joins_after(nd.hash_pairs(distinct, distance=distance, bands=bands))
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_merged_bands_find_all_pairs(spark):
    draw = random.Random(6)
    base = [(draw.getrandbits(32), draw.getrandbits(32)) for _ in range(40)]
    near = [(a ^ (1 << draw.randrange(32)) ^ (1 << draw.randrange(32)), b ^ (1 << draw.randrange(32))) for a, b in base]
    rows = sorted(set(base + near))
    gap = lambda x, y: (x[0] ^ y[0]).bit_count() + (x[1] ^ y[1]).bit_count()
    expected = {(*x, *y, gap(x, y)) for x in rows for y in rows if x < y and gap(x, y) <= 7}
    df = spark.createDataFrame(rows, "h1 bigint, h2 bigint")
    for hot_bucket in (nd.HOT_BUCKET, 1):
        assert {tuple(r) for r in nd.hash_pairs(df, hot_bucket=hot_bucket).collect()} == expected
