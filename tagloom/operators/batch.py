"""User functions over records, the named edit registry and the labelling job."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import derived as dv, paths, tags as tg
from ..functions.rules import TYPE_PREFIXES, Regex
from .dictionary import ladder_priority, sort_by_priority
from .merge import first_source_wins, subtract
from .records import rekey

KEY = "image_key"


def map_batches(
    df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str | None = None
) -> DataFrame:
    """Apply an arbitrary pandas function to Arrow batches of records; keys stay as they are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield func(frame)

    return df.mapInPandas(run, schema or df.schema)


def map_to_new(
    df: DataFrame,
    func: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str | None = None,
    condition: Column | None = None,
    order: str | None = "ord",
) -> DataFrame:
    """Map to a new dataset: keys recomputed from paths, then one record per key that meets the condition."""
    mapped = rekey(map_batches(df, func, schema))
    return first_source_wins([mapped if condition is None else mapped.filter(condition)], order)


def filter_by(df: DataFrame, predicate: Column | Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Keep records by a Column, or by a pandas predicate over Arrow batches."""
    if isinstance(predicate, Column):
        return df.filter(predicate)
    return map_batches(df, lambda frame: frame[predicate(frame)])


def run_model(
    df: DataFrame,
    model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: T.StructType | str,
    batch_size: int = 64,
) -> DataFrame:
    """Run a model over records in batches of at most ``batch_size``.

    ``model`` is a loader: it runs once per task and returns the function that is given each batch.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = None
        for frame in frames:
            predict = predict or model()
            for start in range(0, len(frame), batch_size):
                yield predict(frame.iloc[start : start + batch_size])

    return df.mapInPandas(run, schema)


def to_label(
    source: DataFrame, labelled: DataFrame | None = None, overwrite: bool = False, key: str = KEY
) -> DataFrame:
    """Records a labelling job still has to do: without a caption (unless ``overwrite``) and not in the output."""
    todo = source if overwrite else source.filter(F.col("tags").isNull())
    return todo if labelled is None else subtract(todo, labelled, key)


# -- named edits -----------------------------------------------------------------------------------------


def split_markers(names: Sequence[str]) -> tuple[list[str], list[str]]:
    """Type markers such as ``%artist%`` (as types) and the remaining tags."""
    marks = {f"%{kind}%": kind for kind in TYPE_PREFIXES}
    return [marks[n] for n in names if n in marks], [n for n in names if n not in marks]


def remove_tags(df: DataFrame, names: Sequence[str], regex: bool = False) -> DataFrame:
    """Remove tags by type marker (uses ``typed``), by literal with templates, or by regex."""
    kinds, rest = split_markers(names)
    column = F.col("tags")
    if kinds:
        hit = lambda x: x["kind"].isin(kinds) | tg.matches(x["tag"], [Regex(f"{k}:") for k in kinds])
        column = dv.plain(F.filter("typed", lambda x: ~F.coalesce(hit(x), F.lit(False))))
    if rest and regex:
        column = tg.remove(column, [Regex(n) for n in rest])
    elif rest:
        path = F.col("image_path")
        column = tg.remove(column, tg.fill_templates(rest, paths.category(path), paths.stem(path)))
    return df.withColumn("tags", column)


def _tags(function: Callable[..., Column]) -> Callable[..., DataFrame]:
    return lambda df, **options: df.withColumn("tags", function(F.col("tags"), **options))


def _typed(function: Callable[..., Column]) -> Callable[..., DataFrame]:
    return lambda df, **options: df.withColumn("tags", function(F.col("typed"), **options))


def _add(df: DataFrame, new: Sequence[str], append: bool = False) -> DataFrame:
    path = F.col("image_path")
    return df.withColumn("tags", tg.add(F.col("tags"), new, append, paths.category(path), paths.stem(path)))


#: Edits by name.  Each takes the current subset and returns it edited, in one narrow ``select``.
EDITS: dict[str, Callable[..., DataFrame]] = {
    "write_caption": lambda df, caption: df.withColumn("tags", tg.parse(F.lit(caption))),
    "add_tags": _add,
    "remove_tags": remove_tags,
    "replace_tag": _tags(tg.replace_any),
    "change_quality": _tags(dv.with_quality),
    "parse": _typed(dv.prefix_metatags),
    "formalise": _typed(dv.formalise),
    "format": _tags(dv.apply_formats),
    "sort": _tags(lambda tags, **o: sort_by_priority(tags, ladder_priority(**o))),
    "unique": _tags(tg.unique),
    "quality_from_score": lambda df, mode="overwrite": df.withColumn(
        "tags", dv.quality_from_score(F.col("tags"), F.col("aesthetic_score"), mode)
    ),
    "set_score": lambda df, score=None: df.withColumn(
        "aesthetic_score", F.lit(score).cast("double")
    ),
}


def edit(df: DataFrame, name: str, where: Column | None = None, **options) -> DataFrame:
    """Apply one named edit to the whole dataset, or to the records that meet ``where``; the rest is unchanged."""
    if where is None:
        return EDITS[name](df, **options)
    touched = [c for c in ("tags", "aesthetic_score") if c in df.columns]
    old = df.withColumns({"__hit": F.coalesce(where, F.lit(False)), **{f"__old_{c}": F.col(c) for c in touched}})
    edited = EDITS[name](old, **options)
    chosen = {c: F.when(F.col("__hit"), F.col(c)).otherwise(F.col(f"__old_{c}")) for c in touched}
    return edited.withColumns(chosen).select(*df.columns)
