"""The trie of all conversations' prefixes, with exact member, child, leaf and token counts of every node.

A prefix is known by a 128-bit digest: the exclusive or of hashes of its turns with their places.  A count-min sketch of all
digests screens them: an estimate of one proves that a prefix belongs to a single conversation, and so does everything
below it, so these tails are emitted where they are.  Only prefixes that may be shared are shuffled and grouped exactly.

The nodes whose smallest member is the same conversation form a chain down the trie.  Sums over subtrees are sums over the
tree of chains (by doubling, a logarithmic number of rounds) and running sums along each chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import materialise

#: Cells of each of the sketch's two rows, at least and at most: a bit a cell is broadcast, so 16 MB for both at most.
LEAST_CELLS, MOST_CELLS = 1 << 15, 1 << 26
#: Turns of one conversation or chain in one window, and ids in one piece of a list of ends.
BLOCK, PIECE = 1024, 256
#: Keys that hold more than this part of a table's rows are looked up by broadcast: so many rows at most.
HOT_KEYS = 1000
_BITMAP = 1 << 15  # bits of one of Spark's bitmaps
_WORD = r"[^\x20\x09-\x0D]+"


def look_up(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join with a table whose keys are unique; keys that many rows of ``df`` share are no burden to one task.

    ``df`` should be a written table, as it is read several times.
    """
    total = df.count()
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") * HOT_KEYS > total).drop("__n")
    hot = F.broadcast(hot.join(other, list(keys), "left").withColumn("__hot", F.lit(True)))
    added = [c for c in other.columns if c not in keys]
    marked = df.join(hot, list(keys), "left")
    rest = marked.filter("__hot is null").drop("__hot", *added).join(other, list(keys), "left")
    return marked.filter("__hot").drop("__hot").unionByName(rest)


def running(df: DataFrame, key: str, place: str, fold, combine, columns: dict[str, str], down: bool = True) -> DataFrame:
    """Add running folds of ``columns`` (new name: column) along ``place`` within a key, from the front or from the end.

    Windows see ``BLOCK`` places at most; the folds of whole blocks are carried on between them.
    """
    blocks = df.withColumn("__block", F.floor((F.col(place) - 1) / BLOCK))
    order = (lambda c: F.col(c).asc()) if down else (lambda c: F.col(c).desc())
    inside = Window.partitionBy(key, "__block").orderBy(order(place)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy(order("__block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = blocks.groupBy(key, "__block").agg(*(fold(F.col(c)).alias(f"__{n}") for n, c in columns.items()))
    carried = whole.select(key, "__block", *(fold(F.col(f"__{n}")).over(earlier).alias(f"__{n}") for n in columns))
    run = blocks.select("*", *(fold(F.col(c)).over(inside).alias(n) for n, c in columns.items())).join(carried, [key, "__block"])
    return run.withColumns({n: combine(F.col(n), F.coalesce(F.col(f"__{n}"), F.lit(0))) for n in columns}).drop("__block", *(f"__{n}" for n in columns))


def rebuilt(talk: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """``(turns(conv_id, place, length, a, b, words), conversations(conv_id, length))`` of the rebuilt conversations.

    Conversation c begins with the first h turns of conversation ``c - c % group``, h being crc32 of c modulo ``heads``, and
    goes on with its own turns after its first h.  Turns of equal number follow role, then MD5 of the text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = talk.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    narrow = materialise(narrow, "turns")
    numbered = materialise(narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "numbered-turns")
    numbered = numbered.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rows = numbered.join(F.broadcast(starts), "__part").withColumn("at", F.col("__start") + F.col("__at")).drop("__id", "__part", "__at", "__start", "turn")

    own = rows.groupBy("conv_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = own.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    kept = F.least("h", F.coalesce("n_base", F.lit(0)))
    conversations = own.join(bases, "base", "left").withColumn("kept", kept).withColumn("length", F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    conversations = materialise(conversations.drop("n_base"), "conversations")

    rows = look_up(rows, conversations.select("conv_id", "first", "h", "kept", "length"), ["conv_id"]).withColumn("j", F.col("at") - F.col("first"))
    rows = materialise(rows, "placed-turns")
    after = rows.filter("j >= h").select("conv_id", (F.col("kept") + F.col("j") - F.col("h") + 1).alias("place"), "length", "role", "digest", "words")
    copied = rows.filter((F.col("conv_id") % group == 0) & (F.col("j") < heads - 1)).select(F.col("conv_id").alias("base"), "j", "role", "digest", "words")
    front = copied.join(conversations.select("conv_id", "base", "h", "length"), "base").filter("j < h").select("conv_id", (F.col("j") + 1).alias("place"), "length", "role", "digest", "words")
    hashed = after.union(front).select(
        "conv_id", "place", "length", F.xxhash64("place", "role", "digest").alias("a"), F.xxhash64(F.lit(7), "digest", "role", "place").alias("b"), "words"
    )
    return hashed, conversations.select("conv_id", "length")


def sketch(prefixes: DataFrame, cells: int) -> np.ndarray:
    """Two rows of a count-min sketch, one bit a cell: whether it was counted twice or more."""
    places = prefixes.select(F.explode(F.array(*(F.struct(F.lit(i).alias("line"), c.alias("cell")) for i, c in enumerate(_cells(cells))))).alias("at")).select("at.*")
    twice = places.groupBy("line", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    maps = twice.groupBy("line", F.floor(F.col("cell") / _BITMAP).alias("part")).agg(F.bitmap_construct_agg(F.col("cell") % _BITMAP).alias("bits"))
    seen = np.zeros((2, cells // 8), np.uint8)
    size = _BITMAP // 8
    for r in maps.collect():  # at most 2 * cells / 8 bytes, or one bitmap a line
        line = seen[r["line"], r["part"] * size : (r["part"] + 1) * size]
        line[:] = np.frombuffer(r["bits"], np.uint8)[: len(line)]
    return seen


def _cells(cells: int) -> tuple[Column, Column]:
    return F.col("x").bitwiseAND(F.lit(cells - 1)), F.col("y").bitwiseAND(F.lit(cells - 1))


def screened(prefixes: DataFrame, seen: np.ndarray) -> DataFrame:
    """Add ``shared``, whether the sketch lets a prefix have more than one member, and ``below_shared``, that of its parent."""
    mask, sent = np.int64(seen.shape[1] * 8 - 1), prefixes.sparkSession.sparkContext.broadcast(seen)

    def more_than_one(batch: pa.RecordBatch, *names: str) -> np.ndarray:
        out = np.ones(batch.num_rows, dtype=bool)
        for line, name in zip(sent.value, names, strict=True):
            cell = batch.column(name).to_numpy() & mask
            out &= (line[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
        return out

    def run(batches):
        for batch in batches:
            own, above = more_than_one(batch, "x", "y"), more_than_one(batch, "p", "q") | (batch.column("place").to_numpy() == 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(above)], names=[*batch.schema.names, "shared", "below_shared"])

    return prefixes.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in prefixes.schema)}, shared boolean, below_shared boolean")


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """``(place, x, y, ends_sha256)``: SHA-256 of the sorted, comma-joined ids of each node's ``ends(place, x, y, conv_id)``.

    Sorted ids are joined in pieces wherever they lie; a node's task then only hashes its pieces in order, one at a time, as
    the digest is a chain.
    """

    def pieces(batches):
        key, ids = None, []

        def row():
            return {"place": [key[0]], "x": [key[1]], "y": [key[2]], "first": [ids[0]], "ids": [",".join(map(str, ids))]}

        for batch in batches:
            out = {name: [] for name in ("place", "x", "y", "first", "ids")}
            for *new, conv in zip(*(batch.column(c).to_pylist() for c in ("place", "x", "y", "conv_id")), strict=True):
                if ids and (new != key or len(ids) == PIECE):
                    for name, value in row().items():
                        out[name] += value
                    ids = []
                key = new
                ids.append(conv)
            yield pa.RecordBatch.from_pydict(out, schema=cut)
        if ids:
            yield pa.RecordBatch.from_pydict(row(), schema=cut)

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            out = {name: [] for name in ("place", "x", "y", "ends_sha256")}
            for *new, ids in zip(*(batch.column(c).to_pylist() for c in ("place", "x", "y", "ids")), strict=True):
                if new == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    for name, value in zip(out, [*key, state.hexdigest()], strict=True):
                        out[name].append(value)
                key, state = new, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pydict(out, schema=done)
        if key:
            yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(("place", "x", "y", "ends_sha256"), [*key, state.hexdigest()], strict=True)}, schema=done)

    node = [pa.field("place", pa.int64()), pa.field("x", pa.int64()), pa.field("y", pa.int64())]
    cut, done = pa.schema([*node, pa.field("first", pa.int64()), pa.field("ids", pa.string())]), pa.schema([*node, pa.field("ends_sha256", pa.string())])
    order = ["place", "x", "y", "conv_id"]
    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "place long, x long, y long, first long, ids string")
    by_node = joined.repartition("place", "x", "y").sortWithinPartitions("place", "x", "y", "first")
    return by_node.mapInArrow(hashed, "place long, x long, y long, ends_sha256 string")


def subtree_sums(chains: DataFrame, *names: str) -> DataFrame:
    """``(conv_id, names…)``: the columns of ``chains(conv_id, up, names…)`` summed over each chain and all below it."""
    state = materialise(chains.select("conv_id", F.col("up").alias("above"), *names), "chain-sums")
    while state.filter("above is not null").limit(1).count():
        add = state.filter("above is not null").groupBy(F.col("above").alias("conv_id")).agg(*(F.sum(n).alias(f"__{n}") for n in names))
        further = state.select(F.col("conv_id").alias("above"), F.col("above").alias("__next"))
        summed = state.join(add, "conv_id", "left").select("conv_id", "above", *((F.col(n) + F.coalesce(f"__{n}", F.lit(0))).alias(n) for n in names))
        state = materialise(look_up(materialise(summed, "chain-sums"), further, ["above"]).select("conv_id", F.col("__next").alias("above"), *names), "chain-sums")
    return state.select("conv_id", *names)


def trie(talk: DataFrame, group: int = 20, heads: int = 4, most_cells: int = MOST_CELLS) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations of ``talk(conv_id, turn, role, text)``, the root included.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``.  Null roles and texts are empty; rows without ``conv_id`` are left out; null turns come
    first and equal ones are ordered by role and MD5 of the text, so repeated rows are turns of their own.  Remainders have
    the sign of the id.  An empty table has no root and gives no rows.  Other columns are ignored.  However small the sketch
    (``most_cells``), the result is the same; only more prefixes are grouped exactly.
    """
    turns, conversations = rebuilt(talk, group, heads)
    either = lambda a, b: a.bitwiseXOR(b)
    digests = running(turns, "conv_id", "place", F.bit_xor, either, {"x": "a", "y": "b"})
    prefixes = digests.select("conv_id", "place", "length", "x", "y", either(F.col("x"), F.col("a")).alias("p"), either(F.col("y"), F.col("b")).alias("q"), "words")
    prefixes = materialise(prefixes, "prefixes")
    cells = min(max(1 << (4 * prefixes.count()).bit_length(), LEAST_CELLS), max(most_cells, LEAST_CELLS))
    marked = screened(prefixes, sketch(prefixes, cells))

    maybe = materialise(marked.filter("shared").drop("shared", "below_shared"), "shared-prefixes")
    nodes = maybe.groupBy("place", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("conv_id", "length")).alias("least"), F.min("p").alias("p"), F.min("q").alias("q"), F.max("words").alias("words"))
    nodes = materialise(nodes.select("place", "x", "y", "n", "least.*", "p", "q", "words"), "nodes")
    alone = marked.filter("not shared")
    tops = materialise(alone.filter("below_shared").select("conv_id", "place", "length", "p", "q"), "tops-of-tails")

    # chains: where each begins, and which chain it hangs on at which depth
    root = materialise(conversations.agg(F.min(F.struct("conv_id", "length")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 0").select("least.*", "n"), "root")
    begun = nodes.select("conv_id", "place", "length", "p", "q").union(tops).groupBy("conv_id").agg(F.min(F.struct("place", "length", "p", "q")).alias("top"))
    smallest = F.lit((root.first() or [None])[0]).cast("long")
    begun = begun.filter(F.col("conv_id") != smallest).select("conv_id", "top.*")
    begun = materialise(begun.select("conv_id", "length", (F.col("place") - 1).alias("at"), F.col("p").alias("x"), F.col("q").alias("y")), "chains")
    parents = nodes.select(F.col("place").alias("at"), "x", "y", F.col("conv_id").alias("__up"))
    hung = look_up(begun, parents, ["at", "x", "y"]).select("conv_id", "length", "at", F.when(F.col("at") == 0, smallest).otherwise(F.col("__up")).alias("up"))
    none = F.lit(None).cast("long")
    chains = materialise(hung.union(root.select("conv_id", "length", none, none)), "chains")

    at_ends = chains.filter("up is not null").select(F.col("up").alias("conv_id"), F.col("at").alias("length")).distinct().withColumn("__more", F.lit(True))
    saved = nodes.groupBy("conv_id").agg(F.sum((F.col("n") - 1) * F.col("words")).alias("saved"))
    own = chains.join(at_ends, ["conv_id", "length"], "left").join(saved, "conv_id", "left")
    own = materialise(own.select("conv_id", "up", "at", F.col("__more").isNull().cast("long").alias("leaf"), F.coalesce("saved", F.lit(0)).alias("saved")), "chains")
    sums = subtree_sums(own.withColumnRenamed("leaf", "leaves"), "leaves", "saved")
    hanging = own.filter("up is not null").select("conv_id", "up", "at").join(sums, "conv_id").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("place"))
    hanging = hanging.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count(F.lit(1)).alias("chains"))

    # every node that may be shared, and the root: what hangs on it and below it on its own chain
    zero = F.lit(0).cast("long")
    every = nodes.select("conv_id", "place", "length", "x", "y", "n", "words").union(root.select("conv_id", zero, "length", zero, zero, "n", zero))
    deepest = every.groupBy("conv_id").agg(F.max("place").alias("place")).join(own.select("conv_id", "leaf"), "conv_id")
    every = every.join(hanging, ["conv_id", "place"], "left").join(deepest, ["conv_id", "place"], "left")
    amount = lambda c: F.coalesce(c, F.lit(0))
    every = every.select("*", (amount("leaves") + amount("leaf")).alias("new_leaves"), (amount("saved") + (F.col("n") - 1) * F.col("words")).alias("new_saved"))
    every = running(every, "conv_id", "place", F.sum, lambda a, b: a + b, {"n_leaves": "new_leaves", "saved_tokens": "new_saved"}, down=False)

    nothing = F.sha2(F.lit("").cast("binary"), 256)
    ends = maybe.filter("place = length").select("place", "x", "y", "conv_id").union(conversations.filter("length = 0").select(zero, zero, zero, "conv_id"))
    ups = own.filter("up is not null").select("conv_id", (F.col("at") + 1).alias("place"), F.col("up").alias("parent_conv_id"))
    every = every.join(digests_of_ends(ends), ["place", "x", "y"], "left").join(ups, ["conv_id", "place"], "left")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    children = (F.col("place") < F.col("length")).cast("long")
    parent = F.when(F.col("place") > 0, F.coalesce("parent_conv_id", "conv_id"))
    shared = every.select("conv_id", "place", parent, "n", children + amount("chains"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing))

    end = F.when(F.col("place") == F.col("length"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nothing)
    single = lambda df, parent: df.select("conv_id", "place", parent, F.lit(1).cast("long"), children, F.lit(1).cast("long"), zero, end)
    tails = single(alone.filter("not below_shared"), F.col("conv_id"))
    heads_of_tails = single(tops.join(ups, ["conv_id", "place"], "left"), F.coalesce("parent_conv_id", "conv_id"))
    return shared.union(heads_of_tails).union(tails).toDF(*names)
