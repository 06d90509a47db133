"""Readers.  All of them return unexecuted plans; files are listed by Spark and read on the executors."""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import batched, islice
from pathlib import Path
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import metadata as md, normal, paths, tags as tg
from ..functions.rules import IMAGE_SUFFIXES
from ..operators.merge import cache_override, first_source_wins
from ..operators.stats import Patterns, features_from_counts, features_from_freqs
from ..runtime import explode_rows, materialise
from ..schema import BOORU_META, CAPTION_ATTRS, RECORD, parse_size
from . import quoted

#: Columns of the tabular text form; sizes are text there.
CSV_FIELDS = {"aesthetic_score": "double", "safe_rating": "double"}


def plain_path(uri: Column) -> Column:
    """``file:`` URIs as plain paths; other schemes keep theirs."""
    return F.regexp_replace(uri, r"\Afile:(?://)?(?=/)", "")


class Mount(NamedTuple):
    """How tasks reach a file system: ``scan`` gives ``(name, is folder, length)`` of a folder's entries, ``read`` a file's bytes."""

    scan: Callable[[str], Iterator[tuple[str, bool, int]]]
    read: Callable[[str], bytes | None]


def _mounted(path: str) -> str:
    """The path; one with a scheme is refused: taken as a local file it would find nothing."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        raise ValueError(f"{path} is no mounted path; give a fetch function for its file system")
    return path


def mounted_entries(path: str) -> Iterator[tuple[str, bool, int]]:
    """The entries of a folder of a file system that all executors mount, one after the other."""
    with os.scandir(_mounted(path)) as entries:
        for entry in entries:
            try:
                folder = entry.is_dir()
                yield entry.name, folder, 0 if folder else entry.stat().st_size
            except FileNotFoundError:  # gone meanwhile, or a link to nothing
                continue


def mounted_bytes(path: str) -> bytes | None:
    """The content at a path of a file system that all executors mount; null if there is no such file."""
    try:
        file = os.open(_mounted(path), os.O_RDONLY)
    except FileNotFoundError:
        return None
    try:
        return b"".join(iter(lambda: os.read(file, 65536), b""))
    finally:
        os.close(file)


MOUNTED = Mount(mounted_entries, mounted_bytes)

#: Entries that a task hands over at a time.
LISTED = 10_000

#: Entries of a folder that the task which has found it lists as well, and how many such folders it lists for a row.
SMALL, NEAR = 1000, 100


def _spread(df: DataFrame) -> DataFrame:
    """Few short rows that each mean work, over as many tasks as a shuffle has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def scan_files(spark: SparkSession, directory: str | Sequence[str], mount: Mount, recursive: bool = True) -> DataFrame:
    """``(path, length)`` of the files below directories, listed in the tasks, one level of folders after the other.

    Neither files nor folders reach the driver, a task holds ``LISTED`` entries of one folder at a time.  Small folders are
    listed by the task that finds them, others in the next round.  Like Spark's own listing it shows neither hidden entries
    nor empty files.
    """

    def shown(folder: str) -> Iterator[tuple[str, bool, int]]:
        for name, is_folder, length in mount.scan(folder):
            if (is_folder or length > 0) and not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")):
                yield f"{folder.rstrip('/')}/{name}", is_folder, length

    def entries(root: str) -> Iterator[tuple[str, bool, int]]:
        near, todo = 0, deque([(root, True)])
        while todo:
            folder, whole = todo.popleft()
            some = shown(folder) if whole else list(islice(shown(folder), SMALL + 1))
            if not whole and len(some) > SMALL:
                yield folder, True, 0
                continue
            for entry in some:
                if entry[1] and recursive and near < NEAR:
                    near += 1
                    todo.append((entry[0], False))
                else:
                    yield entry

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for folder in frame["path"]:
                for some in batched(entries(folder), LISTED):
                    yield pd.DataFrame(some, columns=["path", "folder", "length"])

    roots = [directory] if isinstance(directory, str) else list(directory)
    level = spark.createDataFrame([(re.sub(r"\Afile:(?://)?(?=/)", "", root),) for root in roots], "path string")
    found = None
    while True:
        listed = materialise(level.mapInPandas(run, "path string, folder boolean, length bigint"), "listing")
        files, level = listed.filter(~F.col("folder")).select("path", "length"), _spread(listed.filter("folder").select("path"))
        found = files if found is None else found.unionByName(files)
        if not recursive or level.isEmpty():
            return found


def list_images(
    spark: SparkSession,
    directory: str | Sequence[str],
    recursive: bool = True,
    suffixes: Sequence[str] = IMAGE_SUFFIXES,
    mount: Mount | None = None,
) -> DataFrame:
    """``(image_key, image_path, length)`` of the image files below a directory; contents are never read.

    Suffixes are case-sensitive.  Spark's own listing holds all files on the driver; with ``mount`` the tasks list them.
    """
    if mount is not None:
        files = scan_files(spark, directory, mount, recursive).withColumnRenamed("path", "image_path")
    else:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", str(recursive).lower())
            .load(directory if isinstance(directory, str) else list(directory))
            .select(plain_path(F.col("path")).alias("image_path"), "length")
        )
    return files.filter(paths.suffix(F.col("image_path")).isin(list(suffixes))).select(
        paths.stem(F.col("image_path")).alias("image_key"), "image_path", "length"
    )


_TEXTS = T.StructType([T.StructField(n, T.StringType()) for n in (*RECORD.fieldNames(), *CAPTION_ATTRS)])


def _record_map(text: Column) -> Column:
    """``map<key, record of texts>``; null if the text is no such object, also if it breaks off."""
    return F.when(F.json_object_keys(text).isNotNull(), F.from_json(text, T.MapType(T.StringType(), _TEXTS)))


def _rows_of(documents: DataFrame, parsed: Column, keep: Sequence[str]) -> DataFrame:
    rows = explode_rows(documents, keep, parsed, "image_key", "r")

    def typed(name: str) -> Column:
        value = F.col(f"r.{name}")
        if name == "original_size":
            return parse_size(value).alias(name)
        kind = RECORD[name].dataType if name in RECORD.fieldNames() else T.StringType()
        return (value if isinstance(kind, T.StringType) else value.try_cast(kind)).alias(name)

    return rows.select(*keep, "image_key", *[typed(n) for n in _TEXTS.fieldNames()])


def explode_record_json(documents: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Rows of texts that each hold one object ``{key: record}``; numbers may be written as text."""
    return _rows_of(documents, _record_map(F.col(column)), keep)


def _json_parts(spark: SparkSession, path: str | Sequence[str], indent: int | None) -> DataFrame:
    """``(file, value, parsed)`` of the parts that files split into at the ends of records."""
    where = path if isinstance(path, str) else list(path)
    if indent is None:
        lines = spark.read.text(where).select(F.col("_metadata.file_path").alias("file"), "value")
        return lines.withColumn("parsed", _record_map(F.col("value")))
    pad = " " * indent
    parts = spark.read.option("lineSep", f"\n{pad}}},\n").text(where).select(F.col("_metadata.file_path").alias("file"), "value")
    opened = F.regexp_replace("value", r"\A\s*\{?\s*(?=\")", "")
    body = F.regexp_replace(opened, r"\n" + pad + r"\}\s*\}\s*\z", "")
    return parts.withColumn("parsed", F.coalesce(_record_map(F.col("value")), _record_map(F.concat(F.lit("{"), body, F.lit("}}")))))


def read_record_json(spark: SparkSession, path: str | Sequence[str], indent: int | None = 4, damaged: str = "skip") -> DataFrame:
    """JSON databases holding one object ``{key: record}`` per file.

    Files dumped with this indent split at the ends of records and are parsed record by record (line breaks inside
    strings are escaped in JSON, and deeper objects are indented further); a file written in another way is one part.
    Without ``indent`` every line holds an object, the form that ``write_record_json`` writes.
    ``damaged="fail"`` stops at a part that can't be parsed, ``"skip"`` leaves it out: ``damaged_parts`` counts them.
    """
    parts = _json_parts(spark, path, indent)
    if damaged == "fail":
        message = F.concat(F.lit("damaged JSON in "), F.col("file"))
        broken = F.col("parsed").isNull() & (F.trim("value") != "")
        parts = parts.withColumn("parsed", F.when(broken, F.raise_error(message).cast(parts.schema["parsed"].dataType)).otherwise(F.col("parsed")))
    return _rows_of(parts, F.col("parsed"), [])


def damaged_parts(spark: SparkSession, path: str | Sequence[str], indent: int | None = 4) -> DataFrame:
    """``(file, n)``: parts of each file that hold no readable record."""
    broken = _json_parts(spark, path, indent).filter(F.col("parsed").isNull() & (F.trim("value") != ""))
    return broken.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def read_record_lines(spark: SparkSession, path: str) -> DataFrame:
    """The splittable JSON form: one record per line."""
    schema = T.StructType(
        [T.StructField("image_key", T.StringType()), *RECORD.fields, *[T.StructField(n, T.StringType()) for n in CAPTION_ATTRS]]
    )
    return spark.read.schema(schema).json(path)


def read_record_csv(spark: SparkSession, path: str | Sequence[str], sep: str = ",", multi_line: bool = True) -> DataFrame:
    """CSV databases with an ``image_key`` column; known columns only, empty cells are null.

    Cells may hold line breaks; files split all the same (``quoted.read_csv``).  Without ``multi_line`` every line break
    ends a record, which is right only if no cell holds one, and saves counting quotes.
    """
    if multi_line:
        raw = quoted.read_csv(spark, path, sep)
    else:
        raw = spark.read.options(header="true", sep=sep, quote='"', escape='"').csv(path if isinstance(path, str) else list(path))
    known = [n for n in ("image_key", *RECORD.fieldNames(), *CAPTION_ATTRS) if n in raw.columns]

    def typed(name: str) -> Column:
        if name == "original_size":
            return parse_size(F.col(name)).alias(name)
        return F.col(name).cast(CSV_FIELDS.get(name, "string")).alias(name)

    return raw.select(*[typed(n) for n in known])


def _texts(spark: SparkSession, directory: str | Sequence[str], suffix: str, mount: Mount | None = None) -> DataFrame:
    """``(path, value)`` of small text files; paths come unencoded.  Both listings leave out empty files."""
    if mount is not None:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = frame.assign(content=[mount.read(p) for p in frame["path"]])
                yield out[out["content"].notna()]

        named = scan_files(spark, directory, mount).filter(F.col("path").endswith(suffix)).select("path")
        files = _spread(named).mapInPandas(run, "path string, content binary")
    else:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", f"*{suffix}")
            .load(directory if isinstance(directory, str) else list(directory))
        )
    return files.select(plain_path(F.col("path")).alias("path"), F.decode("content", "UTF-8").alias("value"))


def read_captions(spark: SparkSession, directory: str | Sequence[str], mount: Mount | None = None) -> DataFrame:
    """``(label_path, caption)`` of the non-empty ``.txt`` sidecars below a directory, by listing."""
    return _texts(spark, directory, ".txt", mount).select(
        F.col("path").alias("label_path"), F.nullif("value", F.lit("")).alias("caption")
    )


def mounted_text(path: str) -> str | None:
    """The text at a path of a file system that all executors mount; null if there is no such file.

    Paths with a scheme are refused: reading them as local files would find nothing.
    """
    content = mounted_bytes(path)
    if content is None:
        return None
    text = content.decode("utf-8")
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def fetch_files(df: DataFrame, path: Column, fetch: Callable[[str], str | None]) -> DataFrame:
    """``(path, value)`` for the paths at which ``fetch`` finds a text, asked for in the tasks.

    For files that Spark's listing does not show: empty ones and dot-files.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame.assign(value=[fetch(p) for p in frame["path"]])
            yield out[out["value"].notna()]

    return df.select(path.alias("path")).mapInPandas(run, "path string, value string")


def fetch_captions(images: DataFrame, fetch: Callable[[str], str | None]) -> DataFrame:
    """``(label_path, caption)`` of the text sidecar of every image that has one; empty files give null."""
    found = fetch_files(images, paths.label_path(F.col("image_path")), fetch)
    return found.select(F.col("path").alias("label_path"), F.nullif("value", F.lit("")).alias("caption"))


def read_hidden_meta(images: DataFrame, fetch: Callable[[str], str | None]) -> DataFrame:
    """Metadata of ``.{stem}_meta.json`` files, payload under ``danbooru``."""
    path = F.col("image_path")
    hidden = paths.with_name(path, F.concat(F.lit("."), paths.stem(path), F.lit("_meta.json")))
    nested = T.StructType([T.StructField("danbooru", BOORU_META)])
    return fetch_files(images, hidden, fetch).select(
        F.regexp_replace("path", r"/[^/]*\z", "").alias("image_dir"),
        F.regexp_extract(paths.name(F.col("path")), r"\A\.(.+)_meta\.json\z", 1).alias("stem"),
        F.lit(None).cast("string").alias("image_name"),
        F.from_json("value", nested)["danbooru"].alias("meta"),
    )


def read_booru_meta(spark: SparkSession, directory: str, mount: Mount | None = None) -> DataFrame:
    """``(image_dir, stem, image_name, meta)`` of ``{name}.json`` sidecars."""
    path = F.col("path")
    return _texts(spark, directory, ".json", mount).select(
        F.regexp_replace(path, r"/[^/]*\z", "").alias("image_dir"),
        F.lit(None).cast("string").alias("stem"),
        F.regexp_extract(paths.name(path), r"\A(.+)\.json\z", 1).alias("image_name"),
        F.from_json("value", BOORU_META).alias("meta"),
    )


def attach_sidecars(images: DataFrame, captions: DataFrame | None, meta: DataFrame | None = None) -> DataFrame:
    """Add ``tags``, ``safe_level`` and ``original_size`` to listed images.

    A text sidecar wins even when empty; metadata is used only for images without one.
    """
    path = F.col("image_path")
    out = images.withColumn("label_path", paths.label_path(path))
    if captions is not None:
        out = out.join(captions.withColumn("__txt", F.lit(True)), "label_path", "left")
    else:
        out = out.withColumns({"caption": F.lit(None).cast("string"), "__txt": F.lit(None).cast("boolean")})
    tags, level, size = tg.parse(F.col("caption")), F.lit(None).cast("string"), F.lit(None).cast(RECORD["original_size"].dataType)
    if meta is not None:
        out = out.withColumns(
            {"__dir": F.regexp_replace(path, r"/[^/]*\z", ""), "__stem": paths.stem(path), "__name": paths.name(path)}
        )
        by_stem = meta.filter(F.col("stem").isNotNull()).select(
            F.col("image_dir").alias("__dir"), F.col("stem").alias("__stem"), F.col("meta").alias("__m1")
        )
        by_name = meta.filter(F.col("image_name").isNotNull()).select(
            F.col("image_dir").alias("__dir"), F.col("image_name").alias("__name"), F.col("meta").alias("__m2")
        )
        out = out.join(by_stem, ["__dir", "__stem"], "left").join(by_name, ["__dir", "__name"], "left")
        found = F.when(F.col("__txt").isNull(), F.coalesce("__m1", "__m2"))
        out = out.withColumn("__meta", found)
        tags = F.coalesce(tags, md.booru_tags(F.col("__meta")))
        level = F.col("__meta.rating")
        size = F.when(
            F.col("__meta").isNotNull(),
            F.struct(F.col("__meta.image_width").alias("width"), F.col("__meta.image_height").alias("height")),
        )
    return out.select(
        *images.columns, "label_path", tags.alias("tags"), level.alias("safe_level"), size.alias("original_size")
    )


def read_folder(
    spark: SparkSession,
    directory: str,
    recursive: bool = True,
    read_types: Sequence[str] = ("txt", "danbooru"),
    fetch: Callable[[str], str | None] | None = None,
    mount: Mount | None = None,
) -> DataFrame:
    """Image records of a folder with captions from their sidecars.

    Sidecars come from Spark's listing, on any file system; it shows neither empty nor hidden files.  ``fetch`` asks for
    these in the tasks: ``mounted_text`` on a file system that all executors mount, or a function for another one.
    Spark's listing holds every file on the driver; with ``mount`` (``MOUNTED`` likewise) the tasks list folders.
    """
    images = list_images(spark, directory, recursive, mount=mount)
    captions = None
    if "txt" in read_types:
        captions = read_captions(spark, directory, mount) if fetch is None else fetch_captions(images, fetch)
    meta = None
    if "danbooru" in read_types:
        meta = read_booru_meta(spark, directory, mount)
        if fetch is not None:
            meta = meta.unionByName(read_hidden_meta(images, fetch))
    return attach_sidecars(images, captions, meta)


def load(
    sources: Sequence[DataFrame],
    cache: DataFrame | None = None,
    key_condition: Column | None = None,
    order: str | None = None,
) -> DataFrame:
    """Several sources as one dataset: key filter before anything else, first source wins, then cached records.

    Keys are unique afterwards, also those of a single source.
    """
    scoped = [s.filter(key_condition) if key_condition is not None else s for s in sources]
    merged = first_source_wins(scoped, order)
    return merged if cache is None else cache_override(merged, cache)


IMAGE_PATH_FIELDS = "image_key string, image_path string"


def read_source(spark: SparkSession, path: str, fetch: Callable[[str], str | None] | None = None, **options) -> DataFrame:
    """A source by its path: a JSON or CSV database, one image file, or a folder of images."""
    suffix = Path(path).suffix
    if suffix == ".json":
        return read_record_json(spark, path, **options)
    if suffix == ".csv":
        return read_record_csv(spark, path, **options)
    if suffix in IMAGE_SUFFIXES:
        image = spark.createDataFrame([(Path(path).stem, path)], IMAGE_PATH_FIELDS)
        captions = None if fetch is None else fetch_captions(image, fetch)
        return attach_sidecars(image, captions, None if fetch is None else read_hidden_meta(image, fetch))
    return read_folder(spark, path, fetch=fetch, **options)


def load_paths(
    spark: SparkSession, sources: Sequence[str], cache: DataFrame | None = None, key_condition: Column | None = None,
    fetch: Callable[[str], str | None] | None = None, options: Mapping[str, Mapping[str, object]] | None = None,
) -> DataFrame:
    """Sources of any kind by path as one dataset, as ``load`` merges them; captions are tag lists throughout.

    ``options`` has, by path, what the reader of a source takes besides.
    """

    def tagged(df: DataFrame) -> DataFrame:
        return df if "tags" in df.columns else df.withColumn("tags", tg.parse(F.col("caption"))).drop("caption")

    return load([tagged(read_source(spark, s, fetch, **(options or {}).get(s, {}))) for s in sources], cache, key_condition)


# -- post database and statistic tables ---------------------------------------------------------------------


def read_tables(spark: SparkSession, path: str, names: Sequence[str] = ("post", "tag", "tag_wikis")) -> dict[str, DataFrame]:
    """Post database tables exported as Parquet, one folder per table; the header is the table's own schema."""
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in names}


def statistic_rows(documents: DataFrame, column: str = "value", table: str | None = None) -> DataFrame:
    """Texts of statistic tables to ``(character, tag, cnt, freq)``.

    ``{character: {tag: [count, frequency]}}`` has both and ``{character: [tag]}`` neither.  Single numbers are
    frequencies if any number of the same table is written with a fraction, else counts.  Texts with the same value of
    ``table`` are parts of one table; without it each text is one.
    """
    source = F.col(table) if table else F.xxhash64(column)
    outer = explode_rows(
        documents, [source.alias("__table")], F.from_json(F.col(column), "map<string,string>"), "character", "body"
    )
    none = F.lit(None).cast("string")
    listed = F.transform(F.from_json("body", "array<string>"), lambda t: F.struct(t.alias("tag"), none.alias("value")))
    valued = F.transform(
        F.map_entries(F.from_json("body", "map<string,string>")), lambda e: F.struct(e["key"].alias("tag"), e["value"].alias("value"))
    )
    entries = F.when(F.col("body").startswith("["), listed).otherwise(valued)
    rows = explode_rows(outer, ["__table", "character"], entries, "e").select("__table", "character", "e.tag", "e.value")
    pair = F.when(F.col("value").startswith("["), F.from_json("value", "array<double>"))
    single = F.when(~F.col("value").startswith("["), F.col("value"))
    fraction = F.coalesce(single.rlike("[.eE]"), F.lit(False))
    shapes = rows.groupBy("__table").agg(F.max(fraction).alias("__freqs"))
    return rows.join(shapes, "__table").select(
        "character",
        "tag",
        F.coalesce(F.get(pair, 0).cast("bigint"), F.when(~F.col("__freqs"), single.try_cast("bigint"))).alias("cnt"),
        F.coalesce(F.get(pair, 1), F.when(F.col("__freqs"), single.try_cast("double"))).alias("freq"),
    )


def read_statistics(spark: SparkSession, path: str, indent: int = 4, lists: bool = False) -> DataFrame:
    """Statistic tables, one per file; files dumped with this indent split at the ends of characters.

    ``lists`` says that characters hold lists of tags, else objects; a file of the other kind is one part.
    """
    pad, end = " " * indent, "]" if lists else "}"
    parts = spark.read.option("lineSep", f"\n{pad}{end},\n").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    opened = F.regexp_replace("value", r"\A\s*\{?\s*(?=\")", "")
    body = F.regexp_replace(opened, r"\n" + pad + rf"\{end}\s*\}}\s*\z", "")
    whole = F.from_json("value", "map<string,string>").isNotNull()
    texts = parts.select("file", F.when(whole, F.col("value")).otherwise(F.concat(F.lit("{"), body, F.lit(f"{end}}}"))).alias("value"))
    return statistic_rows(texts, table="file")


def feature_table(
    statistics: DataFrame, patterns: Patterns, freq_threshold: float = 0.3, count_threshold: int = 1, least_sample_size: int = 50
) -> DataFrame:
    """``(character, feature)`` from statistics, whatever their shape; both sides in the form with blanks.

    Frequencies decide where there are any, counts where a character has its own total, and plain lists as they are.
    """
    normed = statistics.select(normal.space_form(F.col("character")).alias("character"), normal.space_form(F.col("tag")).alias("tag"), "cnt", "freq")
    by_freq = features_from_freqs(normed.filter("freq is not null and coalesce(cnt, 1e9) >= " + str(int(count_threshold))), patterns, freq_threshold)
    counts = normed.filter("freq is null and cnt is not null")
    by_count = features_from_counts(counts, patterns, freq_threshold, count_threshold, least_sample_size)
    plain = normed.filter("freq is null and cnt is null").select("character", F.col("tag").alias("feature"))
    return by_freq.select("character", "feature").union(by_count.select("character", "feature")).union(plain).distinct()
