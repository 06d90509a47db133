"""Joins with heavy keys: equal to the plain join, and even without run-time skew handling."""

from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from tagloom.operators import dictionary as dc
from tagloom.operators.heavy import heavy_keys, join_heavy


@pytest.fixture
def no_adaptive(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(spark, n=60_000):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 30 == 1, F.lit(None)).otherwise(F.concat(F.lit("t"), F.col("id") % 5003))
    return spark.range(0, n, 1, 6).select("id", key.alias("tag"))


def table(spark):
    return spark.range(0, 5003, 2).select(F.concat(F.lit("t"), "id").alias("tag"), F.col("id").alias("value")).union(spark.createDataFrame([("hot", -1)], "tag string, value long"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_same_rows_and_even_tasks(spark, no_adaptive, how):
    left, right = rows(spark), table(spark)
    assert heavy_keys(left, "tag") == ["hot"]
    joined = join_heavy(left, right, "tag", how)
    want = left.join(right, "tag", how)
    assert joined.columns == want.columns and joined.exceptAll(want).count() == want.exceptAll(joined).count() == 0
    tasks = lambda df: {r["task"]: r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()}
    stayed, shuffled = ([n for t, n in tasks(joined).items() if (t < 6) == own] for own in (True, False))
    assert len(stayed) == 6 and len(shuffled) >= 4 and all(max(x) <= 3 * median(x) for x in (stayed, shuffled))
    plain = list(tasks(want).values())
    assert max(plain) > 1.5 * max(stayed + shuffled) and max(plain) > 2 * median(plain)


def test_dictionaries_with_a_hot_tag(spark, no_adaptive):
    records = rows(spark, 3000).select(F.concat(F.lit("k"), "id").alias("image_key"), F.array("tag", F.lit("hot")).alias("tags"))
    kinds = table(spark).select(F.lit("artist").alias("kind"), "tag")
    both = [{r.image_key: r.typed for r in dc.with_typed_tags(records, kinds, inline_limit=n).collect()} for n in (0, 10**6)]
    assert both[0] == both[1] and len(both[0]) == 3000
    tags = records.select("image_key", F.explode("tags").alias("tag"))
    values = table(spark).withColumn("value", F.col("value").cast("string"))
    found = Counter(r.value for r in dc.lookup_tag_table(tags, values, default="none").collect())
    assert found["-1"] == 3000 + 1000 and sum(found.values()) == 6000


def test_nothing_to_join(spark):
    assert join_heavy(rows(spark, 0), table(spark), "tag").count() == 0
    assert join_heavy(rows(spark, 100), table(spark).limit(0), "tag", "left").count() == 100
