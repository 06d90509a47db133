"""Model outputs to captions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tags as tg
from ..runtime import gather

KEY = "image_key"
GENERAL, CHARACTER = 0, 4


def predicted_tags(
    predictions: DataFrame,
    general_threshold: float = 0.35,
    character_threshold: float = 0.35,
    key: str = KEY,
) -> DataFrame:
    """``predictions(key, tag, category, prob)`` to one tag list per record.

    Probabilities strictly above the threshold of their class; characters first, then general, each by falling
    probability (ties by tag name).  Rows below the thresholds are dropped before the one shuffle on the key; what
    is gathered per record is its own caption.
    """
    passing = predictions.filter(
        ((F.col("category") == GENERAL) & (F.col("prob") > general_threshold))
        | ((F.col("category") == CHARACTER) & (F.col("prob") > character_threshold))
    )
    entry = F.struct(
        (F.col("category") != CHARACTER).cast("int").alias("rank"),
        (-F.col("prob")).alias("fall"),
        F.col("tag"),
    )
    names = F.transform(
        F.sort_array(F.collect_list(entry)), lambda x: F.replace(x["tag"], F.lit("_"), F.lit(" "))
    )
    return gather(passing, key, names.alias("predicted"))


def merge_predictions(tags: Column, predicted: Column, mode: str = "overwrite") -> Column:
    """Combine a caption with a predicted one; a record without a prediction keeps its caption."""
    merged = {
        "overwrite": lambda: predicted,
        "ignore": lambda: F.coalesce(tags, predicted),
        "append": lambda: tg.union(tg.or_empty(tags), predicted),
        "prepend": lambda: tg.union(predicted, tg.or_empty(tags)),
    }[mode]()
    return F.when(predicted.isNull(), tags).otherwise(merged)


def apply_predictions(df: DataFrame, predicted: DataFrame, mode: str = "overwrite", key: str = KEY) -> DataFrame:
    return (
        df.join(predicted, key, "left")
        .withColumn("tags", merge_predictions(F.col("tags"), F.col("predicted"), mode))
        .drop("predicted")
    )


def clamp_score(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(10.0))


def merge_score(current: Column, predicted: Column, mode: str = "overwrite") -> Column:
    """Clamped predicted score; ``ignore`` keeps a score that is there."""
    clamped = F.when(predicted.isNotNull(), clamp_score(predicted))
    return F.coalesce(current, clamped) if mode == "ignore" else F.coalesce(clamped, current)
