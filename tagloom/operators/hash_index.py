"""The nearest hashes of many targets by multi-index hashing.

Hashes are cut into bands, and a table holds every distinct hash under each of its band values.  Probing all bands with up
to r flipped bits finds every hash within ``bands * (r + 1) - 1`` bits.  So each target's radius grows until its k-th
distance is no larger than that; the few targets that no small radius proves are compared with all hashes, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import hashes
from ..runtime import explode_rows, materialise
from .neardup import _bands, _flipped, _widths

BANDS = 4
#: Hashes of one band value in one piece, flipped bits a band before the rest is scanned, and targets of one scan.
BUCKET, RADIUS, SCANNED = 2000, 2, 256


def write_hash_index(df: DataFrame, path: str, most: int = 100, key: str = "vec_id", bucket: int = BUCKET) -> None:
    """Store the band tables of ``df(key, h1, h2)`` in a new folder, for searches of up to ``most`` neighbours.

    Of a hash that more than ``most`` records share only the smallest ``most`` keys can ever be among the nearest; these
    are kept.  Band values of very many hashes are dealt out in pieces.  Records without a hash are left out.
    """
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(key))
    ranked = df.filter("h1 is not null and h2 is not null").select("h1", "h2", key, rank.alias("__n")).filter(F.col("__n") <= most)
    folded = materialise(ranked.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(key)).alias("keys")), "folded-hashes")
    values = F.array(*[F.struct(F.lit(i).alias("band"), v.alias("value")) for i, v in enumerate(_bands(F.col("h1"), F.col("h2"), BANDS))])
    rows = explode_rows(folded, ["h1", "h2"], values, "b").select("h1", "h2", "b.*")
    sizes = rows.groupBy("band", "value").agg(F.ceil(F.count(F.lit(1)) / bucket).alias("pieces"))
    sizes.write.parquet(f"{path}/sizes")
    sizes = df.sparkSession.read.parquet(f"{path}/sizes")
    split = sizes.filter("pieces > 1")  # values of more than ``bucket`` hashes
    piece = F.pmod(F.xxhash64("h1", "h2"), F.coalesce("pieces", F.lit(1)))
    rows.join(split, ["band", "value"], "left").select("band", "value", piece.alias("piece"), "h1", "h2").write.parquet(f"{path}/bands")
    folded.write.parquet(f"{path}/hashes")


def _probes(targets: DataFrame, bits: int) -> DataFrame:
    """``(target, t1, t2, band, value)``: every band with every ``bits`` of its bits flipped."""
    bands = _bands(F.col("t1"), F.col("t2"), BANDS)

    def one(band: int, value: Column) -> Column:
        masks = [sum(1 << b for b in chosen) for chosen in combinations(range(_widths(BANDS)[band]), bits)]
        return F.transform(_flipped(value, masks), lambda x: F.struct(F.lit(band).alias("band"), x.alias("value")))

    rows = F.flatten(F.array(*[one(i, v) for i, v in enumerate(bands)]))
    return explode_rows(targets, ["target", "t1", "t2"], rows, "b").select("target", "t1", "t2", "b.band", "b.value")


def _best(found: DataFrame, k: int, key: str) -> DataFrame:
    """The ``k`` smallest by distance and key of every target; Spark cuts before the shuffle, too."""
    order = Window.partitionBy("target").orderBy("distance", key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _scan(spark: SparkSession, path: str, targets: DataFrame, k: int, key: str, key_type: str) -> list[DataFrame]:
    """Top lists of targets against all hashes: every task keeps ``k`` hashes of each target of a block."""
    numbered = materialise(targets.withColumn("__block", F.floor((F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("target"), F.lit(64))).orderBy("target")) - 1) / (SCANNED // 64))), "scanned-targets")
    distinct, out = spark.read.parquet(f"{path}/hashes"), []
    for block in sorted(r[0] for r in numbered.select("__block").distinct().collect()):
        rows = numbered.filter(F.col("__block") == block).select("target", "t1", "t2").collect()  # at most SCANNED
        names, points = [r["target"] for r in rows], np.array([(r["t1"] << 32 | r["t2"]) & (2**64 - 1) for r in rows], np.uint64)

        def run(batches: Iterator[pa.RecordBatch], names=names, points=points) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column("h1").to_numpy().astype(np.uint64) << np.uint64(32) | batch.column("h2").to_numpy().astype(np.uint64)
                at, of, gaps = [], [], []
                for i, point in enumerate(points):
                    gap = np.bitwise_count(own ^ point)
                    near = np.flatnonzero(gap <= np.partition(gap, k - 1)[k - 1]) if len(gap) > k else np.arange(len(gap))
                    at.append(near)
                    of.append(np.full(len(near), i))
                    gaps.append(gap[near])
                rows = batch.take(pa.array(np.concatenate(at)))
                target = pa.array([names[i] for i in np.concatenate(of)], target_type)
                yield pa.RecordBatch.from_arrays([target, pa.array(np.concatenate(gaps).astype(np.int32)), rows.column("keys")], names=["target", "distance", "keys"])

        target_type = pa.int64() if key_type == "bigint" else pa.string()
        found = distinct.mapInArrow(run, f"target {key_type}, distance int, keys {distinct.schema['keys'].dataType.simpleString()}")
        near = found.select("target", "distance", F.explode("keys").alias(key))
        out.append(_best(near, k, key))
    return out


def nearest_of_each(spark: SparkSession, path: str, targets: DataFrame, k: int, key: str = "vec_id", radius: int = RADIUS) -> DataFrame:
    """``(target, rank, key, distance)``: the ``k`` nearest records of each of ``targets(target, t1, t2)``, ties by key.

    ``path`` holds a ``write_hash_index`` for at least ``k`` neighbours; ``target`` is a unique bigint or text.  Exact: a
    target is done when its k-th distance is within what the radius covers; after ``radius`` rounds the others are scanned.
    Fewer than ``k`` records give all of them.
    """
    sizes, bands, distinct = (spark.read.parquet(f"{path}/{n}") for n in ("sizes", "bands", "hashes"))
    key_type = targets.schema["target"].dataType.simpleString()
    open_ = materialise(targets.filter("t1 is not null and t2 is not null").select("target", "t1", "t2"), "targets")
    best, done = None, []
    for bits in range(radius + 1):
        pieces = _probes(open_, bits).join(sizes, ["band", "value"])  # band values that no hash has end here
        dealt = explode_rows(pieces, ["target", "t1", "t2", "band", "value"], F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1), "piece")
        met = dealt.join(bands, ["band", "value", "piece"])
        distance = hashes.hamming(F.col("h1"), F.col("h2"), F.col("t1"), F.col("t2"))
        # A hash and its distance once a target, then only what can still be among the nearest gets its keys.
        near = met.select("target", "h1", "h2", distance.alias("distance")).distinct()
        cut = near.withColumn("__n", F.row_number().over(Window.partitionBy("target").orderBy("distance", "h1", "h2")))
        bound = cut.filter(F.col("__n") <= k).groupBy("target").agg(F.max("distance").alias("__most"))
        keyed = near.join(bound, "target").filter("distance <= __most").join(distinct, ["h1", "h2"])
        found = keyed.select("target", "distance", F.explode("keys").alias(key))
        found = (found if best is None else found.union(best.join(open_.select("target"), "target", "left_semi").select("target", "distance", key))).distinct()
        best = materialise(_best(found, k, key), "nearest-so-far")
        proven = best.filter((F.col("rank") == k) & (F.col("distance") <= BANDS * (bits + 1) - 1)).select("target")
        done.append(best.join(proven, "target", "left_semi"))
        open_ = materialise(open_.join(proven, "target", "left_anti"), "targets")
    out = [*done, *_scan(spark, path, open_, k, key, key_type)]
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole.select("target", "rank", key, "distance")
