"""Record datasets that Spark derives from the given tables (see ``FIXTURES.md``)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import hashes, tags as tg
from ..functions.rules import QUALITY_WORDS
from ..operators.dictionary import with_typed_tags
from ..operators.records import with_caption_attrs
from ..runtime import gather

STYLE_TAGS = ("cold gear", "hot gear", "old gear", "red gear")


class Tables:
    """Lazily derived DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- records -------------------------------------------------------------------------------

    def _line_lists(self, extra: list[str], condition: Column | None = None) -> DataFrame:
        """``(l_orderkey, items)``: each order's lines in a fixed order; a record's caption is one row by nature."""
        lines = self.table("lineitem")
        if condition is not None:
            lines = lines.filter(condition)
        fields = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", *extra]
        joined = lines.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        return gather(joined.select("l_orderkey", *fields), "l_orderkey", F.sort_array(F.collect_list(F.struct(*fields))).alias("items"))

    @cached_property
    def records(self) -> DataFrame:
        def tag(x: Column, i: Column) -> Column:
            pos = i + 1
            return (
                F.when((pos == 1) & (x["p_size"] <= 40), F.concat(F.lit("artist: "), F.lower(x["p_brand"])))
                .when(pos == 1, F.concat(F.lit("by "), x["p_name"]))
                .when(x["p_type"] == "PROMO", F.concat(F.lit("character: "), x["p_name"]))
                .when((x["p_type"] == "SMALL") & (pos % 2 == 0), F.concat(F.lit("style: "), x["p_name"]))
                .when((x["p_type"] == "STANDARD") & (pos % 2 == 0), F.concat(x["p_name"], F.lit(r" \(std\)")))
                .when(pos % 3 == 0, F.replace(x["p_name"], F.lit(" "), F.lit("_")))
                .otherwise(x["p_name"])
            )

        captions = self._line_lists(["p_name", "p_brand", "p_type", "p_size"]).select(
            "l_orderkey", F.array_join(F.transform("items", tag), ", ").alias("caption")
        )
        key, turn = F.col("o_orderkey"), F.col("o_orderkey") % 7
        suffix = F.when(turn == 0, ", best quality").when(turn == 1, ", low quality").when(turn == 2, ", high_quality")
        image_key = F.concat(F.lit("img"), key.cast("string"))
        status = F.col("o_orderstatus")
        return (
            self.table("orders")
            .join(captions, key == F.col("l_orderkey"), "left")
            .select(
                key.alias("ord"),
                image_key.alias("image_key"),
                F.concat(
                    F.lit("/data/"), F.substring("o_orderpriority", 1, 1), F.lit("/"), status, F.lit("/"), image_key,
                    F.when(key % 3 == 0, ".png").otherwise(".jpg"),
                ).alias("image_path"),
                F.concat("caption", F.coalesce(suffix, F.lit(""))).alias("caption"),
                F.concat("o_orderpriority", F.lit(" "), status).alias("description"),
                F.struct(
                    (256 + 64 * (F.col("o_custkey") % 16)).cast("int").alias("width"),
                    (256 + 64 * (key % 11)).cast("int").alias("height"),
                ).alias("original_size"),
                F.when(key % 10 != 0, F.round(F.col("o_totalprice") / 50000.0, 3)).alias("aesthetic_score"),
                F.when(status == "P", "g").when(status == "F", "s").otherwise("q").alias("safe_level"),
                F.round(F.col("o_totalprice") / 600000.0, 3).alias("safe_rating"),
                F.when(status != "P", F.substring(F.md5(key.cast("string")), 1, 16)).alias("perceptual_hash"),
            )
            .withColumn("tags", tg.parse(F.col("caption")))
        )

    @cached_property
    def other(self) -> DataFrame:
        """A second dataset: returned lines per order, and one record per part."""
        returned = self._line_lists(["p_name", "l_linestatus", "l_discount"], F.col("l_returnflag") == "R").select(
            F.col("l_orderkey").alias("ord"),
            F.concat(F.lit("img"), F.col("l_orderkey").cast("string")).alias("image_key"),
            F.concat(F.lit("/backup/2/"), F.array_max(F.transform("items", lambda x: x["l_linestatus"])), F.lit("/img"),
                     F.col("l_orderkey").cast("string"), F.lit(".png")).alias("image_path"),
            F.transform("items", lambda x: x["p_name"]).alias("tags"),
            F.round(F.array_max(F.transform("items", lambda x: x["l_discount"])) * 100, 2).alias("aesthetic_score"),
        )
        parts = self.table("part").select(
            F.col("p_partkey").alias("ord"),
            F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("image_key"),
            F.concat(F.lit("/backup/parts/"), F.col("p_type"), F.lit("/part"), F.col("p_partkey").cast("string"),
                     F.lit(".jpg")).alias("image_path"),
            F.array("p_name", F.lower("p_type")).alias("tags"),
            F.round(F.col("p_size") / 5.0, 2).alias("aesthetic_score"),
        )
        return returned.unionByName(parts)

    @cached_property
    def slim(self) -> DataFrame:
        """Records with the columns of the second dataset."""
        return self.records.select("ord", "image_key", "image_path", "tags", "aesthetic_score")

    @cached_property
    def listing(self) -> DataFrame:
        """File listing: files of orders that have lines; text labels lie beside half-shipped ones."""
        return self.records.filter(F.col("caption").isNotNull()).select("image_path")

    # -- dictionaries ----------------------------------------------------------------------------

    @cached_property
    def tag_dict(self) -> DataFrame:
        name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
        part = self.table("part")
        rows = part.select(
            F.explode(
                F.array_compact(
                    F.array(
                        F.when(F.col("p_size") <= 25, F.struct(F.lit("artist").alias("kind"), F.lower("p_brand").alias("tag"))),
                        F.when((F.col("p_type") == "ECONOMY") & (F.col("p_size") == 1), F.struct(F.lit("artist").alias("kind"), name.alias("tag"))),
                        F.when((F.col("p_type") == "PROMO") & (F.col("p_size") <= 3), F.struct(F.lit("character").alias("kind"), name.alias("tag"))),
                        F.when((F.col("p_type") == "MEDIUM") & (F.col("p_size") <= 2), F.struct(F.lit("style").alias("kind"), name.alias("tag"))),
                        F.when((F.col("p_type") == "LARGE") & (F.col("p_size") <= 5), F.struct(F.lit("copyright").alias("kind"), name.alias("tag"))),
                    )
                )
            ).alias("d")
        ).select("d.kind", "d.tag")
        quality = F.transform(
            tg.lit_tags([f"{w}_quality" for w in QUALITY_WORDS]),
            lambda q: F.struct(F.lit("quality").alias("kind"), q.alias("tag")),
        )
        words = self.table("region").select(F.explode(quality).alias("d")).select("d.kind", "d.tag")
        return rows.unionByName(words)

    @cached_property
    def typed(self) -> DataFrame:
        return with_typed_tags(self.records, self.tag_dict)

    def retype(self, df: DataFrame) -> DataFrame:
        return with_typed_tags(df, self.tag_dict)

    @cached_property
    def full(self) -> DataFrame:
        return with_caption_attrs(self.typed, STYLE_TAGS)

    @cached_property
    def part_names(self) -> DataFrame:
        return self.table("part").groupBy("p_name").agg(
            F.min("p_partkey").alias("id"), F.count(F.lit(1)).alias("count"), F.min("p_size").alias("size")
        )

    @cached_property
    def priority_table(self) -> DataFrame:
        return self.part_names.select(
            F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("tag"), F.col("size").cast("int").alias("priority")
        )

    @cached_property
    def ladder(self) -> DataFrame:
        """``(level, category, pattern)``: prefixes first, then one level for each first word of a part's name, quality last."""
        words = self.part_names.select(F.substring_index("p_name", " ", 1).alias("word")).groupBy().agg(F.sort_array(F.collect_set("word")).alias("words"))
        rows = F.concat(
            F.array(*[F.struct(F.lit(i).alias("level"), F.lit(c).alias("category"), F.lit(f"{c}:.*").alias("pattern")) for i, c in enumerate(("artist", "character", "style"))]),
            F.transform("words", lambda w, i: F.struct((i + 3).alias("level"), w.alias("category"), F.concat(w, F.lit(" .*")).alias("pattern"))),
            F.array(F.struct(F.lit(500).alias("level"), F.lit("quality").alias("category"), F.lit(r"\w+ quality\b").alias("pattern"))),
        )
        return words.select(F.explode(rows).alias("r")).select("r.*")

    @cached_property
    def feature_patterns(self) -> DataFrame:
        """``(pattern)``: tags with one of the first words that mark features here."""
        words = self.part_names.select(F.substring_index("p_name", " ", 1).alias("word")).filter(F.col("word").isin("red", "old", "hot")).distinct()
        return words.select(F.concat(F.lit(r".*\b"), "word", F.lit(r"\b.*")).alias("pattern"))

    @cached_property
    def tag_table(self) -> DataFrame:
        return self.part_names.select(
            F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("tag"), F.col("count").cast("string").alias("value")
        )

    @cached_property
    def overlap(self) -> DataFrame:
        """A name covers the alphabetically smaller names of the same noun."""
        noun = F.substring_index("p_name", " ", -1)
        form = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
        families = self.part_names.groupBy(noun.alias("noun")).agg(F.sort_array(F.collect_set(form)).alias("names"))
        return families.select(
            F.explode(
                F.transform(
                    "names",
                    lambda q: F.struct(
                        q.alias("query"),
                        F.filter("names", lambda n: n > q).alias("parents"),
                        F.filter("names", lambda n: n < q).alias("children"),
                    ),
                )
            ).alias("o")
        ).select("o.*")

    @cached_property
    def features(self) -> DataFrame:
        """Feature table: names of the same adjective as a PROMO part are that character's features."""
        adjective = lambda c: F.substring_index(c, " ", 1)
        promo = self.table("part").filter(F.col("p_type") == "PROMO").select(
            F.col("p_name").alias("character"), adjective("p_name").alias("adj")
        ).distinct()
        names = self.part_names.select(F.col("p_name").alias("feature"), adjective("p_name").alias("adj"))
        return promo.join(names, "adj").filter(F.col("character") != F.col("feature")).select("character", "feature")

    # -- predictions, hashes, edits, posts ----------------------------------------------------------

    @cached_property
    def predictions(self) -> DataFrame:
        return (
            self.table("lineitem")
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(
                F.concat(F.lit("img"), F.col("l_orderkey").cast("string")).alias("image_key"),
                F.col("p_name").alias("tag"),
                F.when(F.col("p_type") == "PROMO", 4).otherwise(0).alias("category"),
            )
            .agg(F.max(F.round(F.col("l_discount") * 10, 2)).alias("prob"))
        )

    @cached_property
    def hashes(self) -> DataFrame:
        """Sign-bit hashes of the embeddings, each with a copy two bits away."""
        base = self.table("embeddings").select(
            "vec_id", hashes.sign_bits(F.col("embedding"), 1).alias("h1"), hashes.sign_bits(F.col("embedding"), 33).alias("h2")
        )
        copies = base.select(
            (F.col("vec_id") + 1000000).alias("vec_id"), F.col("h1").bitwiseXOR(F.lit(3).cast("bigint")).alias("h1"), "h2"
        )
        return base.unionByName(copies)

    @cached_property
    def edits(self) -> DataFrame:
        return self.table("events").select(
            F.concat(F.lit("img"), F.col("user_id").cast("string")).alias("image_key"),
            F.col("event_id").alias("seq"),
            F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op"),
            F.concat(F.col("event_type"), F.lit(", k"), F.get_json_object("props", "$.k")).alias("caption"),
        )

    @cached_property
    def tag_rows(self) -> DataFrame:
        """Tag dimension as stored: ``(id, name, type_id, count)``."""
        return self.part_names.select(
            "id", F.col("p_name").alias("name"), (F.col("id") % 5).cast("int").alias("type_id"), "count"
        )

    @cached_property
    def posts(self) -> DataFrame:
        """Posts with tag ids; ids of returned lines are unknown to the dimension."""
        ids = self.table("part").select("p_partkey", "p_name").join(
            self.part_names.select("p_name", "id"), "p_name"
        )
        lines = self.table("lineitem").join(ids, F.col("l_partkey") == F.col("p_partkey"))
        tag_id = F.when(F.col("l_returnflag") == "R", -F.col("l_suppkey")).otherwise(F.col("id"))
        lists = gather(
            lines,
            "l_orderkey",
            F.transform(
                F.sort_array(
                    F.collect_list(
                        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", tag_id.alias("tag_id"))
                    )
                ),
                lambda x: x["tag_id"],
            ).alias("tag_ids"),
        )
        orders = self.table("orders")
        return orders.join(lists, orders["o_orderkey"] == lists["l_orderkey"]).select(
            F.col("o_orderkey").alias("id"),
            (F.col("o_custkey") % 4).cast("int").alias("rating"),
            (F.col("o_custkey") % 2).cast("int").alias("has_children"),
            (F.col("o_custkey") % 3).cast("int").alias("has_large"),
            "tag_ids",
        )

    @cached_property
    def wiki(self) -> DataFrame:
        """Wiki texts; names of old and cold things have none."""
        return self.tag_rows.filter(~F.col("name").contains("old ")).select(
            "id", "name", F.concat(F.lit("about "), F.col("name")).alias("description")
        )
