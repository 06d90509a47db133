"""DataFrame helpers shared by the operators: tables, components of a graph, ranks within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..runtime import materialise

#: Rows that one task ranks within a group; larger groups are cut into buckets of about this many.
RANK_BUCKET = 4000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)``: the smallest node of each connected component, for every node that has an edge.

    Alternates hooking (smallest label among the neighbours, a map-side combined minimum) with pointer jumping, so
    chains take a logarithmic number of rounds.  Each round's labels are written to the shared folder; only the
    number of changed labels reaches the driver.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a != b")
    both = materialise(pairs.union(pairs.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("seen")), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        hooked = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = hooked.join(jump, "label", "left").select("node", "was", F.least("label", "next").alias("label"))
        new = materialise(new, "labels")
        changed = new.filter("label != was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def rank_in_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sizes: DataFrame, spread: Column) -> DataFrame:
    """Add ``rank`` (0-based, bigint) of every row within its group, also when one group holds most rows.

    ``sizes(keys…, group_rows)`` gives the number of rows of each group.  A group is cut by ``spread`` (a hash of the
    row) into buckets of about ``RANK_BUCKET`` rows; ranks run within a bucket and start after the rows of the buckets
    before it.  So the order of ranks is by bucket first, then by ``order``: reproducible, but not sorted by ``order``.
    """
    cut = F.pmod(spread, F.ceil(F.col("group_rows") / F.lit(float(RANK_BUCKET))).cast("long"))
    joined = df.join(sizes, list(keys), "left") if len(keys) else df
    bucketed = joined.withColumn("__bucket", cut)
    counts = bucketed.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order)) - 1
    return bucketed.withColumn("__at", inner).join(starts, [*keys, "__bucket"]).withColumn("rank", F.col("__before") + F.col("__at")).drop("__at", "__before", "__bucket", "group_rows")
