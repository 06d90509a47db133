"""Separated values that split into tasks although cells hold line breaks.

A line break ends a record where an even number of quotes stands before it in its file; a doubled quote changes nothing.
So quotes are counted per split first, one row a split; running sums tell each split whether it begins inside a cell.
Then every split puts its lines together to records.  Only what crosses the border of two splits is joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_FRAGMENTS = "file string, start long, at int, begins boolean, whole boolean, text string"


def _lines(spark: SparkSession, path: Sequence[str]) -> DataFrame:
    """Lines with their file and the start of their split; a carriage return stays with its line."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return spark.read.option("lineSep", "\n").text(list(path)).select(*place, "value")


def _inside(lines: DataFrame, quote: str) -> DataFrame:
    """``(file, start, inside)``: whether a split begins within quotes; one row a split."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quotes = pc.count_substring(batch.column("value"), quote).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("start"), quotes], names=["file", "start", "quotes"])

    counted = lines.mapInArrow(count, "file string, start long, quotes long").groupBy("file", "start").agg(F.sum("quotes").alias("quotes"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("file", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _assembled(lines: DataFrame, quote: str) -> DataFrame:
    """Runs of lines: whole records, and the parts of records at either end of a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, begins, odd, at, out = None, [], True, False, 0, []

        def flush(whole: bool) -> None:
            nonlocal at
            if held:
                out.append((key[0], key[1], at, begins, whole and begins, "\n".join(held)))
                at += 1
                held.clear()

        for batch in batches:
            for file, start, inside, line in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "inside", "value")), strict=True):
                if (file, start) != key:
                    flush(False)
                    key, begins, odd, at = (file, start), not inside, inside, 0
                elif not held:
                    begins = True
                held.append(line)
                odd ^= line.count(quote) % 2 == 1
                if not odd:
                    flush(True)
            yield rows(out)
        flush(False)
        yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(schema)
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        out.clear()
        return batch

    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("at", pa.int32()), ("begins", pa.bool_()), ("whole", pa.bool_()), ("text", pa.string())])
    return lines.mapInArrow(run, _FRAGMENTS)


def read_records(spark: SparkSession, path: str | Sequence[str], quote: str = '"') -> DataFrame:
    """``(file, start, at, text)``: the text of every record, without the line break that ends it.

    ``start`` and ``at`` give the order within a file.  A quote that is never closed takes in the rest of its file, as one
    row.  Blank lines between records are records without text.
    """
    lines = _lines(spark, [path] if isinstance(path, str) else path)
    inside = _inside(lines, quote)
    found = _assembled(lines.join(F.broadcast(inside), ["file", "start"]), quote)  # one row a split is broadcast
    order = Window.partitionBy("file").orderBy("start", "at")
    number = F.sum(F.col("begins").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = found.filter("not whole").withColumn("__record", number)  # two rows a split at most
    joined = parts.groupBy("file", "__record").agg(F.sort_array(F.collect_list(F.struct("start", "at", "text"))).alias("p"))
    whole = found.filter("whole").select("file", "start", "at", "text")
    crossing = joined.select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["at"].alias("at"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return whole.union(crossing)


def read_csv(spark: SparkSession, path: str | Sequence[str], sep: str = ",", quote: str = '"') -> DataFrame:
    """Text columns of files with a header each, as Spark's multi-line reader gives them, from splits.

    Columns are named by the first file's header.  Quotes within cells are doubled.  In a file whose header ends with a
    carriage return and a line feed these two are one line break, also within cells.
    """
    options = {"header": "true", "sep": sep, "quote": quote, "escape": quote}
    names = spark.read.options(**options, multiLine="true").csv(path if isinstance(path, str) else list(path)).schema
    records = read_records(spark, path, quote)
    first = records.filter("text != '' and text != '\\r'").groupBy("file").agg(F.min(F.struct("start", "at", "text")).alias("head"))
    body = records.join(F.broadcast(first), "file").filter(F.struct("start", "at") != F.struct("head.start", "head.at"))  # one row a file
    text = F.when(F.col("head.text").endswith("\r"), F.regexp_replace(F.regexp_replace("text", "\\r\\z", ""), "\\r\\n", "\n")).otherwise(F.col("text"))
    schema = ", ".join(f"`{n}` string" for n in names.fieldNames())
    parsed = body.select(text.alias("text")).filter("text != ''").select(F.from_csv("text", schema, {**options, "header": "false", "multiLine": "true"}).alias("r"))
    return parsed.select("r.*")
