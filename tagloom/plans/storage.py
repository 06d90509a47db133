"""Queries of stored datasets: indexes with runs, partial saves, labelling that resumes, pages and hash tables; odd keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import paths, tags as tg
from ..operators import batch, dictionary as dc, hash_index as hi, lookup as lk, merge as mg, neardup as nd, ordinal as od, vocabulary as vc
from ..runtime import materialise, scratch_path
from ..sources import index_runs, pages, readers as rd, saves
from ..streaming import labelling
from . import sqltext as q
from .ordering import GAP
from .registry import query
from .relations import FIRST, SEARCHES, TERMS, TYPED_NAMES, both, event_records, keys, plain, stored_index
from .tables import Tables

# -- values with line breaks ------------------------------------------------------------------------------------------------


def broken_cells(t: Tables) -> DataFrame:
    """Captions with line breaks and quotes in a separated file, read again in splits."""
    path = scratch_path(t.spark, "broken-cells")
    cells = t.records.select("image_key", F.replace("caption", F.lit(", "), F.lit(',\n"x" ')).alias("caption"), "description")
    cells.write.options(header="true", escape='"').csv(path)
    return rd.read_record_csv(t.spark, path)


query(
    "s04_csv_cells_with_breaks",
    "SELECT image_key, replace(caption, ', ', ',' || chr(10) || '\"x\" ') AS caption, description FROM records",
)(lambda t: broken_cells(t).select("image_key", "caption", "description"))

# -- index with runs --------------------------------------------------------------------------------------------------------


def forms(df: DataFrame) -> DataFrame:
    """The index rows that ``index_delta`` speaks of: an edit from nothing."""
    return mg.index_delta(df.limit(0), df).select("tag", "image_key")


def edited_index(t: Tables) -> str:
    """The first dataset's index, edited to the second's, then to both with the first one's records winning."""
    path = scratch_path(t.spark, "index-runs")
    first, second = (materialise(df.select("image_key", "tags"), "records") for df in (t.slim, t.other))  # derived once, read by all edits
    index_runs.create(forms(first), path)
    index_runs.add_run(path, mg.index_delta(first, second))
    index_runs.add_run(path, mg.index_delta(second, mg.union(first, second)))
    return path


def compacted(t: Tables, whole: bool) -> DataFrame:
    path = edited_index(t)
    index_runs.compact(t.spark, path, whole=whole)
    return index_runs.load(t.spark, path)


FINAL = f"""final AS (SELECT image_key, tags FROM records UNION ALL SELECT image_key, tags FROM other WHERE image_key NOT IN (SELECT image_key FROM records)),
  idx AS (SELECT unnest(list_distinct(list_transform(coalesce(tags, []), lambda x: {q.norm('x')}))) AS tag, image_key FROM final)"""
query("o12_index_runs", f"WITH {FINAL} SELECT tag, image_key FROM idx", *both)(lambda t: index_runs.load(t.spark, edited_index(t)))
query("o12_index_runs_search", f"WITH {FINAL} SELECT tag, image_key FROM idx WHERE tag IN ('red_ring', 'old_bolt', 'promo')", *both)(
    lambda t: index_runs.load(t.spark, edited_index(t)).filter(F.col("tag").isin("red_ring", "old_bolt", "promo"))
)
query("o12_index_merged_runs", f"WITH {FINAL} SELECT tag, image_key FROM idx", *both)(lambda t: compacted(t, False))
query("o12_index_compacted", f"WITH {FINAL} SELECT tag, image_key FROM idx", *both)(lambda t: compacted(t, True))

# -- saves ------------------------------------------------------------------------------------------------------------------


def partly_saved(t: Tables) -> DataFrame:
    """The buffer saved over the second dataset: only the files that hold an edited key are written anew."""
    path = scratch_path(t.spark, "partly-saved")
    saves.create(t.other.select("image_key", "image_path", tg.render(F.col("tags")).alias("caption")), path)
    edited = mg.latest_edits(t.edits).select("image_key", F.concat(F.lit("/edited/"), "image_key", F.lit(".jpg")).alias("image_path"), "caption", "op")
    saves.save(t.spark, path, edited)
    return saves.load(t.spark, path)


query(
    "s15_partial_save",
    """WITH buffer AS (SELECT e.image_key, op, '/edited/' || e.image_key || '.jpg' AS image_path, e.caption FROM last_edits e)
    SELECT image_key, image_path, caption FROM buffer WHERE op = 'U'
    UNION ALL SELECT image_key, image_path, array_to_string(tags, ', ') FROM other WHERE image_key NOT IN (SELECT image_key FROM buffer)""",
    "other", "edits",
)(partly_saved)


def labelled_in_runs(t: Tables) -> DataFrame:
    """A labelling job that ends after two saves and is started again."""
    source, output, checkpoint = (scratch_path(t.spark, f"labelling-{x}") for x in ("source", "output", "progress"))
    todo = batch.to_label(t.records, t.edits).select("image_key", "description")
    todo.repartition(12, "image_key").write.parquet(source)
    model = lambda df: batch.run_model(df, lambda: lambda frame: frame[["image_key"]].assign(caption="seen " + frame["description"]), LABELS)
    for most in (2, None):
        labelling.label_files(t.spark, source, todo.schema, model, output, checkpoint, files_per_save=2, most_saves=most)
    return labelling.labelled(t.spark, output, LABELS)


LABELS = "image_key string, caption string"
query(
    "s17_saved_labelling_job",
    """SELECT r.image_key, 'seen ' || description AS caption FROM records r WHERE caption IS NULL
       AND NOT EXISTS (SELECT 1 FROM last_edits e WHERE e.image_key = r.image_key)""",
    "records", "edits",
)(labelled_in_runs)

# -- searches and pages ----------------------------------------------------------------------------------------------------


def vocabulary_search(t: Tables, **options) -> DataFrame:
    records = materialise(t.slim.select("image_key", "tags"), "records")  # derived once, for the index and the search
    index = stored_index(records)
    words = materialise(vc.vocabulary(index), "vocabulary")
    return keys(vc.by_vocabulary(records, index, words, materialise(vc.gram_postings(words), "grams"), **options))


REGEX, REGEX_SQL = SEARCHES["f03_tags_regex"]
for name, listed in (("f03_tags_regex_by_vocabulary", vc.LISTED), ("f03_tags_regex_by_joined_vocabulary", 1)):
    query(name, f"WITH {TERMS} SELECT image_key FROM terms WHERE {REGEX_SQL}")(
        lambda t, listed=listed: vocabulary_search(t, listed=listed, **{k: v for k, v in REGEX.items() if k != "regex"})
    )


def stored_pages(t: Tables) -> DataFrame:
    """Two pages from one stored order."""
    path = scratch_path(t.spark, "pages")
    pages.write_order(t.records, ["ord"], path)
    numbered = [pages.read_page(t.spark, path, i, 80).select("image_key", "ord", F.lit(i).alias("page")) for i in (2, 5)]
    return numbered[0].union(numbered[1])


query("w01_stored_pages", "SELECT image_key, ord, ((row_number() OVER (ORDER BY ord) - 1) // 80)::INTEGER AS page FROM records QUALIFY page IN (2, 5)")(stored_pages)


def nearest_of_each(t: Tables) -> DataFrame:
    """The two nearest hashes of every embedding's hash, and of a hash of every nation's name."""
    path = scratch_path(t.spark, "hash-index")
    hi.write_hash_index(t.hashes, path, most=10)
    half = lambda start: F.conv(F.substring(F.md5("n_name"), start, 8), 16, 10).cast("long")
    far = t.table("nation").select((F.col("n_nationkey") - 100).cast("long").alias("target"), half(1).alias("t1"), half(9).alias("t2"))
    targets = t.hashes.select(F.col("vec_id").alias("target"), F.col("h1").alias("t1"), F.col("h2").alias("t2")).union(far)
    return hi.nearest_of_each(t.spark, path, targets, 2)


query(
    "x01_nearest_of_each",
    f"""WITH a AS (SELECT vec_id AS target, h1, h2 FROM hashes UNION ALL
      SELECT n_nationkey - 100, ('0x' || substr(md5(n_name), 1, 8))::BIGINT, ('0x' || substr(md5(n_name), 9, 8))::BIGINT FROM nation)
    SELECT target, vec_id, ({GAP})::INTEGER AS distance, row_number() OVER (PARTITION BY target ORDER BY {GAP}, vec_id)::INTEGER AS rank FROM a, hashes b QUALIFY rank <= 2""",
    "hashes",
)(nearest_of_each)

# -- records without a key, or with one that others have -----------------------------------------------------------------------


def with_gaps(t: Tables) -> DataFrame:
    """The hashes, and one for every nation: without hash, without half of it, or without id."""
    key, none = F.col("n_nationkey"), F.lit(None).cast("long")
    id_ = F.when(key % 3 < 2, key + 9000000)
    gaps = t.table("nation").select(id_.alias("vec_id"), F.when(key % 3 > 0, F.lit(7)).otherwise(none).cast("long").alias("h1"), F.when(key % 3 > 1, F.lit(7)).otherwise(none).cast("long").alias("h2"))
    return t.hashes.unionByName(gaps)


query(
    "x02_drop_with_missing_hashes",
    f"""SELECT vec_id, h1, h2 FROM hashes a WHERE NOT EXISTS (SELECT 1 FROM hashes b WHERE b.vec_id < a.vec_id AND {GAP} <= 7)
    UNION ALL SELECT CASE WHEN n_nationkey % 3 < 2 THEN n_nationkey + 9000000 END, CASE WHEN n_nationkey % 3 > 0 THEN 7 END, CASE WHEN n_nationkey % 3 > 1 THEN 7 END FROM nation""",
    "hashes",
)(lambda t: nd.drop_near_duplicates(with_gaps(t)).select("vec_id", "h1", "h2"))


def odd_keys(df: DataFrame, key: str, number: str) -> DataFrame:
    """A third of the records share a key, and a third have none."""
    return df.withColumn(key, F.when(F.col(number) % 3 == 0, F.lit(0).cast(df.schema[key].dataType)).when(F.col(number) % 3 == 1, F.col(key)))


ODD = "CASE {0} % 3 WHEN 0 THEN {1} WHEN 1 THEN {2} END"
for name, limit in (("j08_defeature_odd_keys", 500), ("j08_defeature_odd_keys_joined", 0)):
    query(
        name,
        f"""WITH cs AS (SELECT ord, tags, unnest({q.chars()}) AS c FROM typed),
        f AS (SELECT ord, list(DISTINCT {q.space('feature')}) AS fs FROM cs JOIN features ON {q.space('c')} = {q.space('character')} GROUP BY ord)
        SELECT t.ord, {ODD.format('t.ord', "'0'", 'image_key')} AS image_key, array_to_string(list_filter(tags, lambda x: NOT list_contains(coalesce(fs, []), {q.space('x')})), ', ') AS caption
        FROM typed t LEFT JOIN f ON f.ord = t.ord""",
        "typed", "features",
    )(
        lambda t, limit=limit: dc.defeature(odd_keys(t.full, "image_key", "ord"), t.features, inline_limit=limit).select("ord", "image_key", tg.render(F.col("tags")).alias("caption"))
    )
query(
    "j05_post_tags_odd_ids",
    f"""SELECT {ODD.format('p.id', '0', 'p.id')} AS id, array_to_string(coalesce(list(name ORDER BY pos) FILTER (name IS NOT NULL), []), ', ') AS tags, {TYPED_NAMES}
    FROM posts p LEFT JOIN (SELECT post_ids.id, pos, name, type FROM post_ids JOIN dim ON tag_id = dim.id) x ON x.id = p.id GROUP BY p.id""",
    "posts",
)(
    lambda t: lk.post_tags(odd_keys(t.posts.withColumn("number", F.col("id")), "id", "number"), lk.tag_dimension(t.tag_rows)).select(
        "id", *[tg.render(F.col(c)).alias(c) for c in ("tags", "tags_general", "tags_artist", "tags_character", "tags_copyright", "tags_meta")]
    )
)
query(
    "w07_cap_with_gen_info",
    "SELECT image_key, category FROM records QUALIFY row_number() OVER (PARTITION BY category ORDER BY ord) <= 100",
)(
    lambda t: od.cap_per_group(
        t.records.select("image_key", "ord", paths.category(F.col("image_path")).alias("category"), F.create_map(F.lit("Seed"), F.col("ord").cast("string")).alias("gen_info")),
        "category", ["ord"], 100,
    ).select("image_key", "category")
)


def keyless(t: Tables) -> DataFrame:
    """Records without a key: one a nation."""
    return t.table("nation").select(
        F.lit(None).cast("string").alias("image_key"), F.concat(F.lit("/no/key/"), F.col("n_nationkey").cast("string"), F.lit(".png")).alias("image_path"),
        F.array("n_name").alias("tags"), F.lit(None).cast("double").alias("aesthetic_score"), F.lit(0).cast("long").alias("ord"),
    )


query(
    "s08_records_without_key",
    f"""WITH {FIRST} SELECT image_key, image_path, caption, aesthetic_score FROM ranked WHERE rn = 1
    UNION ALL SELECT NULL, '/no/key/' || n_nationkey || '.png', n_name, NULL FROM nation""",
    "records", "other", "edits",
)(lambda t: plain(mg.first_source_wins([t.other.unionByName(keyless(t)), event_records(t), t.slim], "ord")))
