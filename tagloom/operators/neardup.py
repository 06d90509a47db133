"""Nearest hashes and near-duplicate removal on 64-bit perceptual hashes.

Candidates come from the pigeonhole principle: cut a hash into bands; two hashes within ``distance`` bits agree in
at least one band up to ``distance // bands`` bits, so probing each band with all flips of so many bits finds every
pair.  Equal hashes are folded into one row before that, and bands shared by very many distinct hashes are refined
by a second band, so no bucket emits all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hashes
from ..runtime import explode_rows, materialise

BITS = 64
BANDS = 4
HOT_BUCKET = 2000
#: Band rows of one task; more rows get more tasks, so that none sorts more however many hashes there are.
TASK_ROWS = 2_000_000


def nearest(df: DataFrame, t1: int, t2: int, k: int, key: str = "vec_id") -> DataFrame:
    """The ``k`` records nearest to a target hash, by distance and key: a merged top-n."""
    distance = hashes.hamming(F.col("h1"), F.col("h2"), F.lit(t1).cast("bigint"), F.lit(t2).cast("bigint"))
    return df.select(key, distance.alias("distance")).orderBy("distance", key).limit(k)


def _widths(bands: int) -> list[int]:
    """Bits of each band; they add up to all bits, whatever the number of bands."""
    if not 2 <= bands <= 16:
        raise ValueError("bands must be 2 to 16")
    return [BITS * (i + 1) // bands - BITS * i // bands for i in range(bands)]


def _bands(h1: Column, h2: Column, bands: int) -> list[Column]:
    whole = F.shiftleft(h1.cast("bigint"), 32).bitwiseOR(h2.cast("bigint"))
    out, end = [], 0
    for width in _widths(bands):
        end += width
        out.append(F.shiftrightunsigned(whole, BITS - end).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")))
    return out


def _flips(width: int, radius: int) -> list[int]:
    """All bit masks of the width with at most ``radius`` bits set."""
    masks = []
    for r in range(radius + 1):
        for bits in combinations(range(width), r):
            masks.append(sum(1 << b for b in bits))
    return masks


def _flipped(value: Column, masks: Sequence[int]) -> Column:
    return F.transform(
        F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: value.bitwiseXOR(m)
    )


def _band_rows(columns: Sequence[Column], radius: int) -> Column:
    """``array<struct<band, value>>``: every band with all flips of at most ``radius`` bits."""
    widths = _widths(len(columns))

    def one(band: int, value: Column) -> Column:
        return F.transform(
            _flipped(value, _flips(widths[band], radius)), lambda x: F.struct(F.lit(band).alias("band"), x.alias("value"))
        )

    return F.flatten(F.array(*[one(band, value) for band, value in enumerate(columns)]))


def _second_rows(columns: Sequence[Column], band: int, radii: Sequence[int]) -> Column:
    """``array<struct<band2, value2>>``: the bands but one, each with all flips up to its radius; a negative one leaves its band out."""
    widths = _widths(len(columns))
    others = [i for i in range(len(columns)) if i != band]

    def one(i: int, radius: int) -> Column:
        return F.transform(_flipped(columns[i], _flips(widths[i], radius)), lambda x: F.struct(F.lit(i).alias("band2"), x.alias("value2")))

    return F.flatten(F.array(*[one(i, radius) for i, radius in zip(others, radii) if radius >= 0]))


def _radii(distance: int, bands: int) -> list[int]:
    """Radii of bands one of which must be kept by two hashes within the distance.

    If every band were missed by a bit at least, the bits missed would add up to the sum of the radii and the number of
    bands, so radii that add up to ``distance - bands + 1`` are enough.
    """
    total = distance - bands + 1
    return [max((total + i) // bands, -1) for i in reversed(range(bands))] if total >= -bands + 1 else []


def _dealt(df: DataFrame, rows: float, keys: list[str]) -> DataFrame:
    """``df`` over so many tasks that each has about ``TASK_ROWS`` of ``rows``; as it is if a shuffle has enough."""
    tasks = -(-int(rows) // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _near(index: DataFrame, probes: DataFrame, distance: int, bands: int, hot_bucket: int) -> DataFrame:
    """``(h1, h2, k, p1, p2, pk)`` within the distance, of ``index(h1, h2, k)`` and ``probes(p1, p2, pk)``; may repeat.

    Bands whose value is shared by more than ``hot_bucket`` hashes also match on one of the other bands: those differ by
    what the first band's flips have left of ``distance`` in total, so one of them is within its radius of ``_radii``.
    Both sides flip half of these, which needs far fewer rows than one side flipping all.  The result is exact either way.
    ``index`` and ``probes`` are counted and read several times, so they should be stored.

    Band rows meet in sort-merge joins: Spark reckons exploded rows by the stored hashes' size, so it would take a side of
    dozens of rows per hash for a small one and broadcast it through the driver.
    """
    radius, half = distance // bands, distance // (bands - 1) // 2
    own, other = ["h1", "h2", "k"], ["p1", "p2", "pk"]
    indexed = explode_rows(index, own, _band_rows(_bands(F.col("h1"), F.col("h2"), bands), 0), "b").select(*own, "b.band", "b.value")
    probed = explode_rows(probes, other, _band_rows(_bands(F.col("p1"), F.col("p2"), bands), radius), "b").select(*other, "b.band", "b.value")
    sizes = indexed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"))
    hot = materialise(sizes.filter(F.col("n") > hot_bucket), "hot-bands")
    mark = hot.select("band", "value", F.lit(True).alias("hot"))
    is_hot = F.coalesce("hot", F.lit(False))
    indexed = indexed.join(mark, ["band", "value"], "left").withColumn("hot", is_hot)
    probed = probed.join(mark, ["band", "value"], "left").withColumn("hot", is_hot)

    each = [len(_flips(width, radius)) for width in _widths(bands)]
    n_index, n_probed = index.count() * bands, probes.count() * sum(each)
    rows, first = n_index + n_probed, ["band", "value"]
    cool = _dealt(indexed.filter(~F.col("hot")), rows, first).join(_dealt(probed.filter(~F.col("hot")), rows, first).hint("merge"), first)

    def deep(df: DataFrame, columns: list[str], radii: Callable[[int], list[int]]) -> DataFrame:
        """Rows of the other bands; ``radii`` by how many bits the band was flipped."""
        cut = _bands(F.col(columns[0]), F.col(columns[1]), bands)
        flipped, second = F.bit_count(F.get(F.array(*cut), F.col("band")).bitwiseXOR(F.col("value"))), None
        for band in range(bands):
            for flips in range(radius + 1):
                here = (F.col("band") == band) & (flipped == flips)
                rows_of = _second_rows(cut, band, radii(flips))
                second = F.when(here, rows_of) if second is None else second.when(here, rows_of)
        rows = explode_rows(df.filter("hot"), [*columns, "band", "value"], second, "s")
        return rows.select(*columns, "band", "value", "s.band2", "s.value2")

    left_over = lambda flips: [r if r < 0 else max(r - half, 0) for r in _radii(distance - flips, bands - 1)]
    flips = (bands - 1) * len(_flips(max(_widths(bands)), half))
    rows, both = rows * flips * (hot.agg(F.sum("n").alias("n")).first()["n"] or 0) / max(n_index, 1), [*first, "band2", "value2"]
    warm = _dealt(deep(indexed, own, lambda _: [half] * (bands - 1)), rows, both).join(_dealt(deep(probed, other, left_over), rows, both).hint("merge"), both)
    gap = hashes.hamming(F.col("h1"), F.col("h2"), F.col("p1"), F.col("p2"))
    return cool.select(*own, *other).unionByName(warm.select(*own, *other)).withColumn("distance", gap).filter(F.col("distance") <= distance)


def hash_pairs(distinct: DataFrame, distance: int = 7, bands: int = BANDS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Pairs ``(a1, a2, b1, b2, distance)`` of different hashes within the distance, each once with a < b.

    ``distinct`` has one row per hash (``h1, h2``).
    """
    distinct = materialise(distinct, "distinct-hashes")
    left = distinct.select("h1", "h2", F.lit(0).alias("k"))
    right = distinct.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.lit(0).alias("pk"))
    smaller = (F.col("h1") < F.col("p1")) | ((F.col("h1") == F.col("p1")) & (F.col("h2") < F.col("p2")))
    found = _near(left, right, distance, bands, hot_bucket).filter(smaller)
    return found.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("p1").alias("b1"), F.col("p2").alias("b2"), "distance").distinct()


def fold(df: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row per distinct hash with its smallest key and number of copies; folded map-side."""
    return df.groupBy("h1", "h2").agg(F.min(key).alias("min_key"), F.count(F.lit(1)).alias("copies"))


def drop_near_duplicates(
    df: DataFrame, distance: int = 7, key: str = "vec_id", bands: int = BANDS, hot_bucket: int = HOT_BUCKET
) -> DataFrame:
    """Drop a record if a record with a smaller key is within the distance.

    Copies of a hash fold to its smallest key.  First every hash is compared with the smallest key of each of its bands
    only, which decides nearly all members of a dense cluster without pairing them.  Hashes that are not decided then
    look at all smaller keys near them.  Records without a hash or a key are near to nothing and stay.
    """
    whole = F.col("h1").isNotNull() & F.col("h2").isNotNull() & F.col(key).isNotNull()
    bare, df = df.filter(~whole), df.filter(whole)
    folded = materialise(fold(df, key), "folded-hashes").select("h1", "h2", F.col("min_key").alias("k"))
    probes = folded.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("k").alias("pk"))
    rows = lambda a, b: _band_rows(_bands(F.col(a), F.col(b), bands), 0)
    firsts = explode_rows(folded, ["h1", "h2", "k"], rows("h1", "h2"), "b").groupBy("b").agg(F.min(F.struct("k", "h1", "h2")).alias("first"))
    banded = explode_rows(probes, ["p1", "p2", "pk"], rows("p1", "p2"), "b")
    gap = hashes.hamming(F.col("first.h1"), F.col("first.h2"), F.col("p1"), F.col("p2"))
    decided = banded.join(firsts, "b").filter((F.col("first.k") < F.col("pk")) & (gap <= distance)).select("pk").distinct()
    open_ = materialise(probes.join(decided, "pk", "left_anti"), "undecided-hashes")
    late = _near(folded, open_, distance, bands, hot_bucket).filter(F.col("k") < F.col("pk")).select("pk").distinct()
    kept = open_.join(late, "pk", "left_anti").select(F.col("pk").alias(key))
    return df.join(kept, key, "left_semi").unionByName(bare)
