"""Queries of searches, lookups, statistics, set operators and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import derived as dv, paths, tags as tg
from ..functions.rules import Regex
from ..operators import dictionary as dc, lookup as lk, merge as mg, predictions as pr, search as sr, stats as st
from ..operators.features import remove_character_features
from ..runtime import explode_rows, materialise, scratch_path
from ..sources import writers as wr
from . import sqltext as q
from .captions import out, repeated, rows
from .recordset import P
from .registry import query
from .tables import STYLE_TAGS, Tables


def keys(df: DataFrame) -> DataFrame:
    return df.select("image_key")


# -- filters ----------------------------------------------------------------------------------------------------

query("f01_subset", "SELECT image_key FROM records WHERE width > height AND aesthetic_score < 5")(
    lambda t: keys(
        sr.query(t.records, (F.col("original_size.width") > F.col("original_size.height")) & (F.col("aesthetic_score") < 5))
    )
)
query("f02_categories", "SELECT image_key FROM records WHERE category IN ('F', 'P')")(
    lambda t: keys(sr.by_category(t.records, ["F", "P"]))
)
query("f02_all_categories", "SELECT image_key FROM records")(lambda t: keys(sr.by_category(t.records, [])))

TERMS = f"""terms AS (SELECT image_key, ord, aesthetic_score, safe_level, image_path, coalesce(list_concat(
    list_transform(tags, lambda t: {q.norm('t')}),
    CASE WHEN {q.artist(q.join('tags'))} IS NOT NULL THEN [{q.norm(q.artist(q.join('tags')))}] ELSE [] END,
    list_transform(coalesce({q.styles()}, []), lambda t: {q.norm('t')})), []) AS terms FROM records)"""


def terms(t: Tables) -> DataFrame:
    return t.records.withColumn("terms", dv.search_terms(F.col("tags"), STYLE_TAGS))


def any_of(names) -> str:
    return "(" + " OR ".join(f"list_contains(terms, '{n}')" for n in names) + ")"


def all_of(names) -> str:
    return "(" + " AND ".join(f"list_contains(terms, '{n}')" for n in names) + ")"


def regex_hit(pattern: str) -> str:
    return f"len(list_filter(terms, lambda x: regexp_matches(x, '(?i)^(?:{pattern})'))) > 0"


SEARCHES = {
    "f03_tags_any": (dict(include=["red ring", "Old Bolt"], exclude=["cold gear"]), f"{any_of(['red_ring', 'old_bolt'])} AND NOT {any_of(['cold_gear'])}"),
    "f03_tags_all": (dict(include=["best quality", "artist: brand#2"], include_condition="all"), all_of(["best_quality", "brand#2"])),
    "f03_tags_all_absent": (dict(include=["red ring", "no such tag"], include_condition="all"), all_of(["red_ring", "no such tag"])),
    "f03_tags_exclude_only": (dict(exclude=["red ring", "old bolt"], joiner="or"), f"NOT {any_of(['red_ring', 'old_bolt'])}"),
    "f03_tags_exclude_all": (
        dict(include=["style: red plate"], exclude=["best quality", "old bolt"], exclude_condition="all", joiner="or"),
        f"list_contains(terms, 'red_plate') OR NOT {all_of(['best_quality', 'old_bolt'])}",
    ),
    "f03_tags_empty_include": (dict(exclude=["red ring"], joiner="and"), "false"),
    "f03_tags_regex": (
        dict(include=["RED .*", "(old|new) bolt"], include_condition="all", exclude=["best .*"], regex=True),
        f"{regex_hit('RED_.*')} AND {regex_hit('(old|new)_bolt')} AND NOT {regex_hit('best_.*')}",
    ),
}
for search_name, (options, condition_sql) in SEARCHES.items():
    query(search_name, f"WITH {TERMS} SELECT image_key FROM terms WHERE {condition_sql}")(
        lambda t, options=options: keys(sr.by_tags(terms(t), **options))
    )
query(
    "f03_search_page",
    f"""WITH {TERMS} SELECT image_key, aesthetic_score, safe_level FROM terms WHERE {any_of(['red_ring', 'old_bolt', 'hot_gear'])}
      AND NOT {any_of(['cold_gear', 'low_quality'])} ORDER BY aesthetic_score DESC NULLS LAST, ord LIMIT 80""",
)(
    lambda t: sr.by_tags(terms(t), include=["red ring", "old bolt", "hot gear"], exclude=["cold gear", "low quality"])
    .orderBy(F.col("aesthetic_score").desc_nulls_last(), "ord").limit(80)
    .select("image_key", "aesthetic_score", "safe_level")
)


def stored_index(records: DataFrame) -> DataFrame:
    path = scratch_path(records.sparkSession, "index")
    wr.write_index(st.term_index(records, STYLE_TAGS), path)
    return records.sparkSession.read.parquet(path)


def searched(t: Tables, options: dict) -> DataFrame:
    """A search by a stored index of records that are derived once, for the index and the search."""
    records = materialise(t.slim.select("image_key", "tags"), "records")
    return keys(sr.by_index(records, stored_index(records), **options))


for search_name in ("f03_tags_any", "f03_tags_exclude_all", "f03_tags_regex"):
    options, condition_sql = SEARCHES[search_name]
    query(f"{search_name}_by_index", f"WITH {TERMS} SELECT image_key FROM terms WHERE {condition_sql}")(
        lambda t, options=options: searched(t, options)
    )
QUALITY_OF = q.quality(q.join("tags"))
query("f04_quality", f"SELECT image_key FROM records WHERE {QUALITY_OF} IN ('best', 'low')")(
    lambda t: keys(sr.by_quality(t.records, ["Best", "low"]))
)
query("f04_no_quality", f"SELECT image_key FROM records WHERE tags IS NOT NULL AND {QUALITY_OF} IS NULL")(
    lambda t: keys(sr.by_quality(t.records, []))
)
query("f05_score_range", "SELECT image_key FROM records WHERE aesthetic_score BETWEEN 2.5 AND 6")(
    lambda t: keys(sr.by_score(t.records, 2.5, 6))
)
query("f05_score_empty_range", "SELECT image_key FROM records WHERE aesthetic_score >= 6 AND aesthetic_score <= 2")(
    lambda t: keys(sr.by_score(t.records, 6, 2))
)
query("f06_keys", "SELECT image_key FROM records WHERE image_key IN ('img1', 'img77', 'img900', 'nothing')")(
    lambda t: keys(sr.by_key(t.records, ["img1", "img77", "img900", "nothing"]))
)
query("f06_keys_regex", "SELECT image_key FROM records WHERE regexp_matches(image_key, '^(?:img1+|.*77)')")(
    lambda t: keys(sr.by_key(t.records, ["img1+", ".*77"], regex=True))
)
query("f06_keys_table", "SELECT image_key FROM records WHERE image_key IN (SELECT image_key FROM edits)", "records", "edits")(
    lambda t: keys(sr.by_key(t.records, t.edits))
)
query(
    "f07_complement",
    "SELECT image_key FROM records WHERE category = 'F' AND NOT coalesce(aesthetic_score > 5, false)",
)(lambda t: keys(sr.query(sr.by_category(t.records, ["F"]), F.col("aesthetic_score") > 5, negate=True)))
query(
    "f07_complement_of_result",
    "SELECT image_key FROM records WHERE category = 'F' AND image_key NOT IN (SELECT image_key FROM edits)",
    "records", "edits",
)(lambda t: keys(sr.complement(sr.by_category(t.records, ["F"]), t.edits)))
query(
    "f08_contains",
    "SELECT image_key, coalesce(list_contains(tags, 'red ring'), false) AS literal, "
    "coalesce(len(list_filter(tags, lambda x: regexp_matches(x, '^(?:ring|gear|red)'))) > 0, false) AS pattern FROM records",
)(
    lambda t: t.records.select(
        "image_key", tg.contains(F.col("tags"), "red ring").alias("literal"),
        tg.contains(F.col("tags"), Regex("ring|gear|red")).alias("pattern"),
    )
)
HAS = "coalesce(list_contains(tags, '{0}'), false)"
query(
    "f09_conditions",
    "SELECT image_key, {a} OR {b} AS any_in, {a} AND {b} AS all_in, NOT {a} OR NOT {b} AS any_out, NOT {a} AND NOT {b} AS all_out FROM records".format(
        a=HAS.format("red ring"), b=HAS.format("best quality")
    ),
)(
    lambda t: t.records.select(
        "image_key",
        *[
            tg.satisfies(F.col("tags"), ["red ring", "best quality"], condition, relation).alias(name)
            for name, condition, relation in (
                ("any_in", "any", "include"), ("all_in", "all", "include"), ("any_out", "any", "exclude"), ("all_out", "all", "exclude"),
            )
        ],
    )
)
query("f10_existing_files", "SELECT image_key FROM records WHERE caption IS NOT NULL")(
    lambda t: keys(sr.existing_files(t.records, t.listing))
)
query(
    "f11_posts_tags_with_two_ids",
    """WITH twice AS (SELECT id, name FROM dim UNION ALL SELECT id, 'red ring' FROM dim WHERE name = 'old bolt')
    SELECT DISTINCT p.id FROM post_ids p WHERE tag_id IN (SELECT id FROM twice WHERE name = 'red ring')
       AND p.id IN (SELECT id FROM post_ids WHERE tag_id IN (SELECT id FROM dim WHERE name = 'new bolt'))""",
    "posts",
)(
    lambda t: sr.posts_with_all_tags(
        t.posts, t.tag_rows.select("id", "name").union(t.tag_rows.filter("name = 'old bolt'").select("id", F.lit("red ring"))), ["red ring", "new bolt"]
    ).select("id")
)
query(
    "f11_posts_all_tags",
    """SELECT id FROM post_ids WHERE tag_id IN (SELECT id FROM dim WHERE name IN ('red ring', 'old bolt'))
       GROUP BY id HAVING count(DISTINCT tag_id) = 2""",
    "posts",
)(lambda t: sr.posts_with_all_tags(t.posts, t.tag_rows, ["red ring", "old bolt"]).select("id"))

# -- lookups ---------------------------------------------------------------------------------------------------------

TYPES = "SELECT image_key, i - 1 AS pos, x.tag AS tag, x.type AS type FROM (SELECT image_key, unnest(typed) AS x, generate_subscripts(typed, 1) AS i FROM typed)"


def typed_rows(df: DataFrame) -> DataFrame:
    return dc.tag_types(df).withColumn("pos", F.col("pos").cast("bigint"))


query("j01_tag_types", TYPES, "typed")(lambda t: typed_rows(t.typed))
query("j01_tag_types_joined", TYPES, "typed")(
    lambda t: typed_rows(dc.with_typed_tags(t.records, t.tag_dict, inline_limit=0))
)
for joined_name, joined_limit in (("j01_tag_types_repeated", dc.INLINE_LIMIT), ("j01_tag_types_repeated_joined", 0)):
    query(joined_name, TYPES, "typed")(
        lambda t, limit=joined_limit: typed_rows(dc.with_typed_tags(t.records, repeated(t.tag_dict), inline_limit=limit))
    )
J02 = f"""SELECT image_key, x AS tag, coalesce(CAST(cnt AS VARCHAR), 'none') AS value
    FROM (SELECT image_key, unnest(tags) AS x FROM records) LEFT JOIN names ON replace(p_name, ' ', '_') = trim({q.prio_key('x')}, '_')"""
query("j02_tag_table_spellings", J02, "records", "names")(
    lambda t: dc.lookup_tag_table(
        explode_rows(t.records, ["image_key"], F.col("tags"), "tag"), repeated(t.tag_table, tag=F.initcap(F.replace("tag", F.lit("_"), F.lit(" ")))), default="none"
    ).select("image_key", "tag", "value")
)
query("j02_tag_table", J02, "records", "names")(
    lambda t: dc.lookup_tag_table(explode_rows(t.records, ["image_key"], F.col("tags"), "tag"), t.tag_table, default="none")
    .select("image_key", "tag", "value")
)
query("j03_semi_join", "SELECT image_key FROM records WHERE image_key IN (SELECT image_key FROM other)", "records", "other")(
    lambda t: keys(mg.intersect(t.slim, t.other))
)
query("j04_anti_join", "SELECT image_key FROM records WHERE image_key NOT IN (SELECT image_key FROM other)", "records", "other")(
    lambda t: keys(mg.subtract(t.slim, t.other))
)
TYPED_NAMES = ", ".join(
    f"array_to_string(coalesce(list(name ORDER BY pos) FILTER (type = '{k}'), []), ', ') AS tags_{k}"
    for k in ("general", "artist", "character", "copyright", "meta")
)
query(
    "j05_post_tags",
    f"""SELECT p.id, array_to_string(coalesce(list(name ORDER BY pos) FILTER (name IS NOT NULL), []), ', ') AS tags, {TYPED_NAMES}
    FROM posts p LEFT JOIN (SELECT post_ids.id, pos, name, type FROM post_ids JOIN dim ON tag_id = dim.id) x ON x.id = p.id GROUP BY p.id""",
    "posts",
)(
    lambda t: lk.post_tags(t.posts, lk.tag_dimension(t.tag_rows)).select(
        "id", *[tg.render(F.col(c)).alias(c) for c in ("tags", "tags_general", "tags_artist", "tags_character", "tags_copyright", "tags_meta")]
    )
)
query(
    "j06_tag_wiki",
    """SELECT p_partkey, part.p_name AS name, CASE WHEN NOT contains(part.p_name, 'old ') THEN 'about ' || part.p_name END AS description
    FROM part JOIN names ON names.p_name = part.p_name""",
    "names",
)(
    lambda t: lk.wiki_text(t.table("part").select("p_partkey", F.col("p_name").alias("name")), t.tag_rows, t.wiki).select(
        "p_partkey", "name", "description"
    )
)
DIFF = r"""WITH j AS (SELECT r.image_key, r.image_path, r.category, r.safe_level = 'g' AS labelled, o.category AS other_category, o.image_key IS NOT NULL AS there
    FROM records r LEFT JOIN other o ON o.image_key = r.image_key),
  ops AS (SELECT *, CASE WHEN there AND category <> other_category THEN 'move' WHEN NOT there THEN 'remove' END AS op,
    regexp_replace(image_path, '/[^/]+/[^/]+$', '') || '/' || other_category || '/' || regexp_extract(image_path, '[^/]+$') AS dst FROM j)
  SELECT image_key AS op_key, op, image_path AS src, CASE WHEN op = 'move' THEN dst END AS dst FROM ops WHERE op IS NOT NULL
  UNION ALL SELECT image_key || '_cap', op, regexp_replace(image_path, '\.[^./]*$', '.txt'),
    CASE WHEN op = 'move' THEN regexp_replace(dst, '\.[^./]*$', '.txt') END FROM ops WHERE op IS NOT NULL AND labelled"""
query("j07_diff", DIFF, "records", "other")(
    lambda t: lk.diff(t.records.withColumn("labelled", F.col("safe_level") == "g"), t.other, "labelled")
)
query(
    "j08_defeature",
    f"""WITH cs AS (SELECT image_key, tags, unnest({q.chars()}) AS c FROM typed),
    f AS (SELECT image_key, list(DISTINCT {q.space('feature')}) AS fs FROM cs JOIN features ON {q.space('c')} = {q.space('character')} GROUP BY image_key)
    SELECT t.image_key, array_to_string(list_filter(tags, lambda x: NOT list_contains(coalesce(fs, []), {q.space('x')})), ', ') AS caption
    FROM typed t LEFT JOIN f ON f.image_key = t.image_key""",
    "typed", "features",
)(lambda t: out(dc.defeature(t.full, t.features), F.col("tags")))

# -- statistics ---------------------------------------------------------------------------------------------------------

INDEX = f"""e AS (
  SELECT image_key, {q.norm('x')} AS tag, false AS is_artist, false AS is_character, false AS is_style FROM (SELECT image_key, unnest(tags) AS x FROM full_records)
  UNION ALL SELECT image_key, {q.norm('x')}, false, true, false FROM (SELECT image_key, unnest(characters) AS x FROM full_records)
  UNION ALL SELECT image_key, {q.norm('x')}, false, false, true FROM (SELECT image_key, unnest(styles) AS x FROM full_records)
  UNION ALL SELECT image_key, {q.norm('artist')}, true, false, false FROM full_records WHERE artist IS NOT NULL),
  idx AS (SELECT tag, image_key, bool_or(is_artist) AS is_artist, bool_or(is_character) AS is_character, bool_or(is_style) AS is_style FROM e GROUP BY 1, 2)"""


def index(t: Tables) -> DataFrame:
    return st.inverted_index(t.typed, STYLE_TAGS)


query("a01_inverted_index", f"WITH {INDEX} SELECT * FROM idx", "full")(index)
query("a01_term_index", f"WITH {INDEX} SELECT tag, image_key FROM idx", "full")(lambda t: st.term_index(t.records, STYLE_TAGS))
query("a01_keys_per_tag", f"WITH {INDEX} SELECT tag, image_key FROM idx WHERE tag IN ('red_ring', 'old_bolt')", "full")(
    lambda t: st.keys_per_tag(index(t), ["red_ring", "old_bolt"])
)
query("a02_tag_frequency", f"WITH {INDEX} SELECT tag, count(*) AS n FROM idx GROUP BY tag HAVING count(*) >= 20", "full")(
    lambda t: st.tag_frequency(st.term_index(t.records, STYLE_TAGS), 20)
)
for kind in ("artist", "character", "style"):
    query(
        f"a02_tag_frequency_{kind}",
        f"WITH {INDEX} SELECT tag, count(*) AS n FROM idx GROUP BY tag HAVING count(*) >= 5 AND bool_or(is_{kind})",
        "full",
    )(lambda t, kind=kind: st.tag_frequency(index(t), 5, kind))
query(
    "a02_tag_list",
    f"WITH {INDEX} SELECT tag, count(*) AS n FROM idx GROUP BY tag ORDER BY n DESC, tag LIMIT 50",
    "full",
)(lambda t: st.tag_frequency(st.term_index(t.records, STYLE_TAGS)).orderBy(F.desc("n"), "tag").limit(50))

COUNTS = f"""pairs AS (SELECT {q.space("trim(string_split(c, ':')[2])")} AS character, {q.space('x')} AS tag
    FROM (SELECT c, unnest(tags) AS x FROM (SELECT tags, unnest(list_filter(tags, lambda y: starts_with(y, 'character:'))) AS c FROM records))),
  counts AS (SELECT character, tag, count(*) AS cnt FROM pairs GROUP BY 1, 2)"""
query("a03_co_occurrence", f"WITH {COUNTS} SELECT * FROM counts")(lambda t: st.co_occurrence(t.records))
FEATURE_SQL = r"regexp_matches(tag, '^(?:.*\b(?:red|old|hot)\b.*)')"
query(
    "a04_features_from_counts",
    f"""WITH {COUNTS}, totals AS (SELECT character, cnt AS total FROM counts WHERE character = tag)
    SELECT c.character, tag AS feature, cnt, round(cnt / total, 9) AS freq FROM counts c JOIN totals t ON t.character = c.character
    WHERE total >= 5 AND cnt >= 2 AND cnt / total >= 0.02 AND {FEATURE_SQL}""",
)(
    lambda t: st.features_from_counts(st.co_occurrence(t.records), t.feature_patterns, 0.02, 2, 5).withColumn("freq", F.round("freq", 9))
)
query(
    "a05_features_from_freqs",
    f"""WITH {COUNTS}, freqs AS (SELECT character, tag, cnt / sum(cnt) OVER (PARTITION BY character) AS freq FROM counts)
    SELECT character, tag AS feature, round(freq, 9) AS freq FROM freqs WHERE freq >= 0.02 AND {FEATURE_SQL}""",
)(
    lambda t: st.features_from_freqs(
        (lambda c: c.join(c.groupBy("character").agg(F.sum("cnt").alias("s")), "character").select("character", "tag", (F.col("cnt") / F.col("s")).alias("freq")))(
            st.co_occurrence(t.records)
        ),
        t.feature_patterns, 0.02,
    ).withColumn("freq", F.round("freq", 9))
)
query(
    "a06_character_features",
    rf"""WITH s AS (SELECT image_key, list_transform(list_filter(list_transform(tags, lambda x: trim(replace(x, '_', ' '))), lambda x: x <> ''), lambda x: {q.escape('x')}) AS tags FROM records),
    w AS (SELECT s.*, {q.typed_list('tags')} AS typed FROM s CROSS JOIN kinds),
    c AS (SELECT image_key, tags, unnest({q.chars()}) AS character FROM w),
    totals AS (SELECT character, count(*) AS total FROM c GROUP BY 1),
    f AS (SELECT character, feature, count(*) AS cnt FROM (SELECT character, unnest(list_filter(tags, lambda x: regexp_matches({q.space('x')}, '^(?:.*\b(?:red|old|hot)\b.*)'))) AS feature FROM c) GROUP BY 1, 2)
    SELECT f.character, feature, cnt, round(cnt / total, 9) AS freq FROM f JOIN totals t ON t.character = f.character""",
    "records", "dict",
)(lambda t: st.character_features(t.records, t.retype, t.feature_patterns).withColumn("freq", F.round("freq", 9)))
query(
    "j08_remove_character_features",
    rf"""WITH s AS (SELECT ord, image_key, tags AS plain, list_transform(list_filter(list_transform(tags, lambda x: trim(replace(x, '_', ' '))), lambda x: x <> ''), lambda x: {q.escape('x')}) AS tags FROM records),
    w AS (SELECT s.*, {q.typed_list('tags')} AS typed FROM s CROSS JOIN kinds),
    c AS (SELECT image_key, tags, unnest({q.chars()}) AS character FROM w),
    totals AS (SELECT character, count(*) AS total FROM c GROUP BY 1),
    f AS (SELECT character, feature, count(*) AS cnt FROM (SELECT character, unnest(list_filter(tags, lambda x: regexp_matches({q.space('x')}, '^(?:.*\b(?:red|old|hot)\b.*)'))) AS feature FROM c) GROUP BY 1, 2),
    usual AS (SELECT DISTINCT {q.space('f.character')} AS character, {q.space('feature')} AS feature FROM f JOIN totals t ON t.character = f.character WHERE cnt >= 2 AND cnt / total >= 0.02),
    own AS (SELECT image_key, list(DISTINCT feature) AS fs FROM (SELECT image_key, unnest({q.chars()}) AS c FROM typed) JOIN usual ON {q.space('c')} = character GROUP BY image_key)
    SELECT r.image_key, array_to_string(list_filter(tags, lambda x: NOT list_contains(coalesce(fs, []), {q.space('x')})), ', ') AS caption FROM records r LEFT JOIN own ON own.image_key = r.image_key""",
    "records", "dict", "typed",
)(
    # statistics and edits both read the records, which are derived once
    lambda t: out(
        remove_character_features(materialise(t.full.select("image_key", "tags", "characters"), "records"), t.retype, t.feature_patterns, 0.02, 2),
        F.col("tags"),
    )
)

REPORT = """report AS (SELECT 'missing_caption' AS kind, image_key FROM records WHERE caption IS NULL
    UNION ALL SELECT 'missing_image_file', image_key FROM records WHERE caption IS NULL)"""
query("a07_quality_report", f"WITH {REPORT} SELECT * FROM report")(lambda t: st.quality_report(t.records, t.listing))
query("a07_quality_counts", f"WITH {REPORT} SELECT kind, count(*) AS n FROM report GROUP BY kind")(
    lambda t: st.quality_counts(st.quality_report(t.records, t.listing))
)
query(
    "a08_summary",
    """SELECT count(*) AS n_records, count(DISTINCT category) AS n_categories,
       array_to_string(list_sort(list(DISTINCT category))[1:5], ', ') || CASE WHEN count(DISTINCT category) > 5 THEN ', ...' ELSE '' END AS first_categories FROM other""",
    "other",
)(lambda t: st.summary(t.other).withColumn("first_categories", tg.render(F.col("first_categories"))))
query("a09_categories", "SELECT DISTINCT category FROM other", "other")(lambda t: st.categories(t.other))
query(
    "a10_counts",
    "SELECT (SELECT count(*) FROM records) AS n_records UNION ALL SELECT (SELECT count(*) FROM posts)",
    "records", "posts",
)(
    lambda t: t.records.agg(F.count(F.lit(1)).alias("n_records")).unionByName(t.posts.agg(F.count(F.lit(1)).alias("n_records")))
)

# -- sets and merges ---------------------------------------------------------------------------------------------------------


def plain(df: DataFrame) -> DataFrame:
    return df.select("image_key", "image_path", tg.render(F.col("tags")).alias("caption"), "aesthetic_score")


SLIM = "SELECT image_key, image_path, array_to_string(tags, ', ') AS caption, aesthetic_score FROM {0}"
NOT_IN = " WHERE image_key NOT IN (SELECT image_key FROM {0})"
both = ("records", "other")
query("o04_upsert", SLIM.format("other") + " UNION ALL " + SLIM.format("records") + NOT_IN.format("other"), *both)(
    lambda t: plain(mg.upsert(t.slim, t.other))
)
query("o06_union", SLIM.format("records") + " UNION ALL " + SLIM.format("other") + NOT_IN.format("records"), *both)(
    lambda t: plain(mg.union(t.slim, t.other))
)
query("o07_intersect", SLIM.format("records") + " WHERE image_key IN (SELECT image_key FROM other)", *both)(
    lambda t: plain(mg.intersect(t.slim, t.other))
)
query("o08_difference", SLIM.format("other") + NOT_IN.format("records"), *both)(
    lambda t: plain(mg.subtract(t.other, t.slim))
)
query("o09_delete_keys", SLIM.format("records") + NOT_IN.format("edits"), "records", "edits")(
    lambda t: plain(mg.delete_keys(t.slim, t.edits))
)
query(
    "o09_lookup_keys",
    "SELECT e.image_key, r.image_key IS NOT NULL AS found, r.image_path FROM last_edits e LEFT JOIN records r ON r.image_key = e.image_key",
    "records", "edits",
)(
    lambda t: mg.lookup_keys(t.slim, mg.latest_edits(t.edits)).select("image_key", "found", "image_path")
)
query("o10_new_records", SLIM.format("records") + NOT_IN.format("other"), *both)(
    lambda t: plain(mg.new_records(t.slim, t.other))
)
query("o11_compact_edits", "SELECT image_key, seq, caption FROM last_edits WHERE op <> 'D'", "edits")(
    lambda t: mg.compact_edits(t.edits).select("image_key", "seq", "caption")
)
query(
    "o05_apply_changes",
    "SELECT image_key, caption FROM last_edits WHERE op <> 'D' UNION ALL SELECT image_key, array_to_string(tags, ', ') FROM records WHERE image_key NOT IN (SELECT image_key FROM last_edits)",
    "records", "edits",
)(
    lambda t: mg.apply_changes(
        t.records.select("image_key", tg.render(F.col("tags")).alias("caption")), mg.latest_edits(t.edits).select("image_key", "caption", "op")
    )
)
query(
    "o12_index_delta",
    f"""WITH b AS (SELECT image_key, list_distinct(list_transform(coalesce(tags, []), lambda x: {q.norm('x')})) AS f FROM records),
    a AS (SELECT image_key, list_distinct(list_transform(coalesce(tags, []), lambda x: {q.norm('x')})) AS f FROM other)
    SELECT unnest(list_filter(coalesce(a.f, []), lambda x: NOT list_contains(coalesce(b.f, []), x))) AS tag, coalesce(a.image_key, b.image_key) AS image_key, 1 AS delta
      FROM a FULL JOIN b ON a.image_key = b.image_key
    UNION ALL SELECT unnest(list_filter(coalesce(b.f, []), lambda x: NOT list_contains(coalesce(a.f, []), x))), coalesce(a.image_key, b.image_key), -1
      FROM a FULL JOIN b ON a.image_key = b.image_key""",
    *both,
)(lambda t: mg.index_delta(t.slim, t.other))

# -- sources ---------------------------------------------------------------------------------------------------------------------


def event_records(t: Tables) -> DataFrame:
    """A source in which keys repeat: one record per event, in event order."""
    return t.edits.select(
        F.col("seq").alias("ord"), "image_key", F.concat(F.lit("/events/"), "op", F.lit("/"), "image_key", F.lit(".jpg")).alias("image_path"),
        tg.parse(F.col("caption")).alias("tags"), F.lit(None).cast("double").alias("aesthetic_score"),
    )


FIRST = """all_rows AS (
    SELECT 0 AS src, ord, image_key, image_path, array_to_string(tags, ', ') AS caption, aesthetic_score FROM other
    UNION ALL SELECT 1, seq, image_key, '/events/' || op || '/' || image_key || '.jpg', caption, NULL FROM edits
    UNION ALL SELECT 2, ord, image_key, image_path, array_to_string(tags, ', '), aesthetic_score FROM records),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY image_key ORDER BY src, ord) AS rn FROM all_rows)"""
query(
    "s08_first_source_wins",
    f"WITH {FIRST} SELECT image_key, image_path, caption, aesthetic_score FROM ranked WHERE rn = 1",
    "records", "other", "edits",
)(lambda t: plain(mg.first_source_wins([t.other, event_records(t), t.slim], "ord")))
query(
    "s09_cache_override",
    "SELECT r.image_key, CASE WHEN o.image_key IS NULL THEN r.image_path ELSE o.image_path END AS image_path, "
    "array_to_string(CASE WHEN o.image_key IS NULL THEN r.tags ELSE o.tags END, ', ') AS caption, "
    "CASE WHEN o.image_key IS NULL THEN r.aesthetic_score ELSE o.aesthetic_score END AS aesthetic_score FROM records r LEFT JOIN other o ON o.image_key = r.image_key",
    *both,
)(lambda t: plain(mg.cache_override(t.slim, t.other)))
query(
    "s15_buffered_save",
    """WITH buffer AS (SELECT e.image_key, CASE WHEN op = 'D' THEN 'D' ELSE 'U' END AS op, '/edited/' || e.image_key || '.jpg' AS image_path, e.caption FROM last_edits e)
    SELECT image_key, image_path, caption FROM buffer WHERE op = 'U'
    UNION ALL SELECT image_key, image_path, array_to_string(tags, ', ') FROM other WHERE image_key NOT IN (SELECT image_key FROM buffer)""",
    "other", "edits",
)(
    lambda t: saved(t)
)


def saved(t: Tables) -> DataFrame:
    """The buffer saved over the second dataset, and read again."""
    path = scratch_path(t.spark, "saved")
    wr.save_changes(
        t.other.select("image_key", "image_path", tg.render(F.col("tags")).alias("caption")),
        mg.latest_edits(t.edits).select(
            "image_key", F.concat(F.lit("/edited/"), "image_key", F.lit(".jpg")).alias("image_path"), "caption", "op"
        ),
        path,
    )
    return t.spark.read.parquet(path)
