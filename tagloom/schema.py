"""Record schema and small coercions shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])

#: Attributes of a record in the fixed order of the tabular view (caption as text at the edges).
RECORD = T.StructType(
    [
        T.StructField("image_path", T.StringType()),
        T.StructField("caption", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("original_size", SIZE),
        T.StructField("aesthetic_score", T.DoubleType()),
        T.StructField("safe_level", T.StringType()),
        T.StructField("safe_rating", T.DoubleType()),
        T.StructField("perceptual_hash", T.StringType()),
    ]
)
CAPTION_ATTRS = ("artist", "quality", "characters", "styles")
TABULAR = ("image_key", *RECORD.fieldNames(), *CAPTION_ATTRS)

#: The metadata sidecar of a post (space-separated tag strings).
BOORU_META = T.StructType(
    [
        T.StructField("tag_string", T.StringType()),
        T.StructField("tag_string_artist", T.StringType()),
        T.StructField("tag_string_character", T.StringType()),
        T.StructField("tag_string_meta", T.StringType()),
        T.StructField("rating", T.StringType()),
        T.StructField("image_width", T.IntegerType()),
        T.StructField("image_height", T.IntegerType()),
    ]
)


def round3(value: Column) -> Column:
    """Scores given as something other than a float are cast and rounded to three places."""
    return F.round(value.cast("double"), 3)


def parse_size(text: Column) -> Column:
    """``(w, h)``, ``[w, h]`` or ``{"width": w, "height": h}`` as text to a size struct; null when unreadable."""
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    return F.when(
        F.size(numbers) == 2,
        F.struct(numbers[0].try_cast("int").alias("width"), numbers[1].try_cast("int").alias("height")),
    )


def list_to_text(tags: Column) -> Column:
    """A list attribute is dumped as ``', '``-joined text."""
    return F.array_join(tags, ", ")
