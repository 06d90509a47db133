"""Queries of the tag-list functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import derived as dv, normal, tags as tg
from ..functions.rules import Regex
from ..operators import batch, dictionary as dc
from . import sqltext as q
from .registry import query
from .tables import STYLE_TAGS, Tables


def out(df: DataFrame, tags: Column) -> DataFrame:
    return df.select("image_key", tg.render(tags).alias("caption"))


def rows(expression: str, source: str = "records") -> str:
    return f"SELECT image_key, {q.join(expression)} AS caption FROM {source}"


def T() -> Column:
    """The tag list (a function, because columns need a running session)."""
    return F.col("tags")


ADDED = ["red ring", "zinc plate", "old bolt", "zinc plate"]
ADDED_SQL = "['red ring', 'zinc plate', 'old bolt', 'zinc plate']"

query("c01_parse_caption", "SELECT image_key, len(tags) AS n_tags, tags[1] AS first_tag, tags[-1] AS last_tag FROM records")(
    lambda t: t.records.select(
        "image_key", tg.length(T()).cast("bigint").alias("n_tags"), tg.pick(T(), 0).alias("first_tag"), tg.pick(T(), -1).alias("last_tag")
    )
)
query(
    "c01_parse_caption_typos",
    """SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(replace(text, ' ', '，'), '，', ','), ','),
       lambda t: trim(t, E' \\n\\t\\r')), lambda t: t <> ''), ', ') AS caption FROM documents""",
)(
    lambda t: t.table("documents").select(
        "doc_id",
        tg.render(tg.parse(F.replace(F.col("text"), F.lit(" "), F.lit("，")), sep=",")).alias("caption"),
    )
)
query("c02_render_caption", "SELECT image_key, array_to_string(tags, ' | ') AS caption FROM records")(
    lambda t: t.records.select("image_key", tg.render(T(), " | ").alias("caption"))
)

query(
    "c03_unique",
    rows("list_transform(list_filter(list_transform(d, lambda x, i: struct_pack(x := x, i := i)), "
         "lambda s: list_position(d, s.x) = s.i), lambda s: s.x)",
         "(SELECT image_key, list_concat(tags, list_reverse(tags)) AS d FROM records WHERE tags IS NOT NULL)")
    + " UNION ALL SELECT image_key, NULL FROM records WHERE tags IS NULL",
)(lambda t: out(t.records, tg.unique(F.concat(T(), F.reverse(T())))))
query("c04_append_all", rows(f"CASE WHEN tags IS NOT NULL THEN list_concat(tags, {ADDED_SQL}) END"))(
    lambda t: out(t.records, tg.append_all(T(), ADDED))
)
query("c05_remove", rows("list_filter(tags, lambda x: x <> 'red ring' AND NOT regexp_matches(x, '^(?:old|.*gear)'))"))(
    lambda t: out(t.records, tg.remove(T(), ["red ring", Regex("old|.*gear")]))
)
query("c06_keep", rows("list_filter(tags, lambda x: x = 'red ring' OR regexp_matches(x, '^(?:old|.*gear)'))"))(
    lambda t: out(t.records, tg.keep(T(), ["red ring", Regex("old|.*gear")]))
)
query(
    "c07_union",
    rows(f"CASE WHEN tags IS NOT NULL THEN list_concat(tags, list_filter({ADDED_SQL}, lambda x: NOT list_contains(tags, x))) END"),
)(lambda t: out(t.records, tg.union(T(), ADDED)))
query(
    "c08_prioritise",
    rows(
        "CASE WHEN tags IS NOT NULL THEN list_concat(list_filter(tags, lambda x: regexp_matches(x, '^(?:character:)')), "
        "list_filter(tags, lambda x: regexp_matches(x, '^(?:.*quality)') AND NOT regexp_matches(x, '^(?:character:)')), "
        "list_filter(tags, lambda x: NOT regexp_matches(x, '^(?:character:)') AND NOT regexp_matches(x, '^(?:.*quality)'))) END"
    ),
)(lambda t: out(t.records, tg.prioritise(T(), ["character:", ".*quality"])))
query("c09_underscore_form", rows(f"list_transform(tags, lambda t: {q.norm('t')})"))(
    lambda t: out(t.records, F.transform(T(), lambda x: normal.underscore_form(x)))
)
query("c10_space_form", rows(f"list_transform(tags, lambda t: {q.space('t')})"))(
    lambda t: out(t.records, F.transform(T(), lambda x: normal.space_form(x)))
)
query("c11_priority_form", rows(f"list_transform(tags, lambda t: {q.prio_key('t')})"))(
    lambda t: out(t.records, F.transform(T(), lambda x: normal.priority_form(x)))
)
query("c12_strip_prefix", rows(f"list_transform(tags, lambda t: {q.strip_prefix('t', by_artist=True)})"))(
    lambda t: out(t.records, F.transform(T(), lambda x: normal.strip_prefix(x, by_artist=True)))
)
query("c13_escape", rows(f"list_transform(tags, lambda t: {q.escape('t')})"))(lambda t: out(t.records, tg.escaped(T())))
query("c13_unescape", rows(f"list_transform(tags, lambda t: {q.unescape('t')})"))(
    lambda t: out(t.records, tg.unescaped(T()))
)
query("c14_underlined", rows("list_transform(tags, lambda t: replace(t, ' ', '_'))"))(
    lambda t: out(t.records, tg.underlined(T()))
)
query("c14_spaced", rows("list_transform(tags, lambda t: replace(t, '_', ' '))"))(lambda t: out(t.records, tg.spaced(T())))
query(
    "c15_lower_strip",
    rows("list_filter(list_transform(tags, lambda t: trim(trim(lower(t), 'rg'))), lambda t: t <> '')"),
)(lambda t: out(t.records, tg.stripped(tg.lowered(T()), "rg")))
query("c16_replace_text", rows("list_transform(tags, lambda t: replace(t, 'ring', 'band'))"))(
    lambda t: out(t.records, tg.replace_text(T(), "ring", "band"))
)
query(
    "c16_replace_text_first",
    """WITH hit AS (SELECT image_key, tags, list_position(list_transform(tags, lambda x: contains(x, 'r')), true) AS spot FROM records)
    SELECT image_key, array_to_string(list_transform(tags, lambda x, i: CASE WHEN i = spot THEN replace(x, 'r', 'R') ELSE x END), ', ')
      AS caption FROM hit""",
)(lambda t: out(t.records, tg.replace_text(T(), "r", "R", count=1)))
query("c17_replace_tag", rows("list_transform(tags, lambda t: CASE WHEN t = 'red ring' THEN 'blue hoop' ELSE t END)"))(
    lambda t: out(t.records, tg.replace_tag(T(), "red ring", "blue hoop"))
)
query(
    "c17_replace_tag_regex",
    rows(r"list_transform(tags, lambda t: CASE WHEN regexp_matches(t, '^(?:(\w+) gear)') "
         r"THEN regexp_replace(t, '(\w+) gear', 'gear of \1', 'g') ELSE t END)"),
)(lambda t: out(t.records, tg.replace_tag(T(), Regex(r"(\w+) gear"), r"gear of \1")))
query("c18_substitute", rows(r"list_transform(tags, lambda t: regexp_replace(t, '(\w+) (ring|bolt)', '\2 \1', 'g'))"))(
    lambda t: out(t.records, tg.substitute(T(), r"(\w+) (ring|bolt)", r"\2 \1"))
)
query(
    "c19_unweighted",
    rows("list_transform(tags, lambda t: t)"),
)(
    lambda t: out(
        t.records,
        tg.unweighted(
            F.transform(T(), lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("("), x, F.lit(":1.2)"))).otherwise(x))
        ),
    )
)

# -- priorities ---------------------------------------------------------------------------------------

LADDER_SQL = (
    "CASE WHEN starts_with(x, 'artist:') THEN 0 WHEN starts_with(x, 'character:') THEN 1 WHEN starts_with(x, 'style:') THEN 2 ELSE "
    r"coalesce((SELECT list_position(list_sort(list(DISTINCT split_part(p_name, ' ', 1))), nullif(regexp_extract(x, '^([^\s_]+)[\s_].*', 1), '')) + 2 FROM part), "
    r"CASE WHEN regexp_matches(x, '^(?:\w+[\s_]quality\b)') THEN 500 ELSE 999 END) END"
)


def sorted_rows(level: str, extra: str = "", parts: str = "") -> str:
    """Stable sort by level, checked by exploding and aggregating in order."""
    return (
        f"SELECT r.image_key, c.caption FROM records r LEFT JOIN (SELECT image_key, string_agg(x, ', ' ORDER BY {level}, i) AS caption "
        f"FROM (SELECT image_key, unnest(tags) AS x, generate_subscripts(tags, 1) AS i FROM records) u {extra} "
        "GROUP BY image_key) c ON c.image_key = r.image_key"
    )


query("c20_sort_by_ladder", sorted_rows(LADDER_SQL))(
    lambda t: out(t.records, dc.sort_by_priority(T(), dc.ladder_priority(t.ladder)))
)
query("c20_sort_by_ladder_reverse", sorted_rows(f"-({LADDER_SQL})"))(
    lambda t: out(t.records, dc.sort_by_priority(T(), dc.ladder_priority(t.ladder), reverse=True))
)
TABLE_SQL = (
    "CASE WHEN starts_with(x, 'artist:') THEN 0 WHEN starts_with(x, 'character:') THEN 1 WHEN starts_with(x, 'style:') THEN 2 "
    "WHEN contains(x, 'quality') THEN 500 ELSE coalesce(size, 999) END"
)
TABLE_QUERY = sorted_rows(TABLE_SQL, f"LEFT JOIN names ON replace(p_name, ' ', '_') = {q.prio_key('x')}")
query("c20_sort_by_table", TABLE_QUERY, "records", "names")(
    lambda t: out(
        dc.with_table_priorities(t.records, t.priority_table, t.ladder), dc.sort_by_priority(T(), F.col("priorities"))
    )
)
query("c20_sort_by_table_joined", TABLE_QUERY, "records", "names")(
    lambda t: out(
        dc.with_table_priorities(t.records, t.priority_table, t.ladder, inline_limit=0), dc.sort_by_priority(T(), F.col("priorities"))
    )
)


def repeated(table: DataFrame, **changed) -> DataFrame:
    """A table with every row twice, a second version of it, and a row of nulls."""
    nulls = table.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields]).limit(1)
    return table.union(table).union(table.withColumns(changed).select(*table.columns)).union(nulls)


for suffix, limit in (("", dc.INLINE_LIMIT), ("_joined", 0)):
    query(f"c20_sort_by_repeated_table{suffix}", TABLE_QUERY, "records", "names")(
        lambda t, limit=limit: out(
            dc.with_table_priorities(t.records, repeated(t.priority_table, priority=F.col("priority") + 7), t.ladder, inline_limit=limit),
            dc.sort_by_priority(T(), F.col("priorities")),
        )
    )

# -- overlap --------------------------------------------------------------------------------------------


def deoverlap_sql(tags: str, source: str) -> str:
    """Distinct forms in caption order are folded into the list of suppressed forms."""
    return f"""WITH forms AS (
      SELECT image_key, {tags} AS tags, list_transform({tags}, lambda t: {q.norm('t')}) AS f FROM {source}),
    firsts AS (
      SELECT image_key, tags, f, list_transform(list_filter(list_transform(f, lambda x, i: struct_pack(x := x, i := i)),
        lambda s: list_position(f, s.x) = s.i), lambda s: [s.x]) AS d FROM forms),
    gone AS (
      SELECT image_key, tags, f, list_reduce(list_concat([[]::VARCHAR[]], d), lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc
        ELSE list_concat(acc, coalesce(child_map[x[1]], [])) END) AS gone FROM firsts CROSS JOIN covers)
    SELECT image_key, array_to_string(list_filter(tags, lambda t, i: NOT list_contains(gone, f[i])), ', ') AS caption FROM gone"""


query("c21_deoverlap", deoverlap_sql("tags", "records"), "records", "overlap")(
    lambda t: out(dc.deoverlap(t.records, t.overlap), T())
)
query("c21_deoverlap_joined", deoverlap_sql("tags", "records"), "records", "overlap")(
    lambda t: out(dc.deoverlap(t.records, t.overlap, inline_limit=0), T())
)
for suffix, limit in (("", dc.INLINE_PAIRS), ("_joined", 0)):
    query(f"c21_deoverlap_repeated{suffix}", deoverlap_sql("tags", "records"), "records", "overlap")(
        lambda t, limit=limit: out(dc.deoverlap(t.records, repeated(t.overlap, children=F.slice("children", 1, 1)), inline_limit=limit), T())
    )

# -- types --------------------------------------------------------------------------------------------------

PARSE_SQL = """WITH p AS (
    SELECT image_key, typed, tags, list_position(tags, list_filter(typed, lambda x: x.kind = 'artist')[-1].tag) AS spot FROM typed)
  SELECT image_key, array_to_string(list_transform(typed, lambda x, i:
    CASE WHEN x.kind = 'artist' AND i = spot AND NOT starts_with(x.tag, 'artist:') THEN 'artist: ' || x.tag
         WHEN x.kind IN ('character', 'style') AND NOT starts_with(x.tag, x.kind || ':') THEN x.kind || ': ' || x.tag
         ELSE x.tag END), ', ') AS caption FROM p"""
query("c22_parse_metatags", PARSE_SQL, "typed")(lambda t: out(t.typed, dv.prefix_metatags(F.col("typed"))))

FORMALISE = (
    "CASE WHEN {x}.type IN ('artist', 'character', 'style') THEN {x}.type || ': ' || "
    "CASE WHEN {x}.type = 'artist' AND regexp_matches(trim(string_split({x}.tag, ':')[-1], '_ '), '^by[\\s_]\\w') "
    "THEN trim(substr(trim(string_split({x}.tag, ':')[-1], '_ '), 4), '_ ') ELSE trim(string_split({x}.tag, ':')[-1], '_ ') END "
    "ELSE {x}.tag END"
)
query("c23_formalise", rows(f"list_transform(typed, lambda x: {FORMALISE.format(x='x')})", "typed"), "typed")(
    lambda t: out(t.typed, dv.formalise(F.col("typed")))
)
query(
    "c23_formalise_joined", rows(f"list_transform(typed, lambda x: {FORMALISE.format(x='x')})", "typed"), "typed"
)(lambda t: out(dc.with_typed_tags(t.records, t.tag_dict, inline_limit=0), dv.formalise(F.col("typed"))))
query("c23_deformalise", rows(f"list_transform(tags, lambda t: {q.strip_prefix('t', by_artist=True)})"))(
    lambda t: out(t.records, dv.deformalise(T()))
)
for kind in ("artist", "character", "style", "quality", "copyright"):
    query(
        f"c24_remove_{kind}",
        rows(
            f"list_transform(list_filter(typed, lambda x: NOT (coalesce(x.kind = '{kind}', false) OR starts_with(x.tag, '{kind}:'))), lambda x: x.tag)",
            "typed",
        ),
        "typed",
    )(lambda t, kind=kind: out(t.typed, dv.remove_type(F.col("typed"), kind)))

query("c25_artist", f"SELECT image_key, {q.artist(q.join('tags'))} AS artist FROM records")(
    lambda t: t.records.select("image_key", dv.artist(T()).alias("artist"))
)
query(
    "c25_with_artist",
    f"""WITH a AS (SELECT *, {q.artist(q.join('tags'))} AS old, 'studio ' || category AS new,
      list_position(list_transform(typed, lambda x: x.type), 'artist') AS spot FROM typed)
    SELECT image_key, array_to_string(CASE WHEN tags IS NULL THEN NULL WHEN old IS NOT NULL THEN
        list_transform(tags, lambda x, i: CASE WHEN i = spot THEN replace(x, old, new) ELSE x END)
      ELSE list_concat(['artist: ' || new], tags) END, ', ') AS caption FROM a""",
    "typed",
)(
    lambda t: out(
        t.typed, dv.with_artist(F.col("typed"), F.concat(F.lit("studio "), F.substring_index("description", " ", -1)))
    )
)
query("c26_quality", f"SELECT image_key, {q.quality(q.join('tags'))} AS quality FROM records")(
    lambda t: t.records.select("image_key", dv.quality(T()).alias("quality"))
)


def with_quality_sql(tags: str, new: str, old: str) -> str:
    swapped = rf"list_transform({tags}, lambda t: regexp_replace(t, '{q.QUALITY}', {new} || '\2', 'g'))"
    return (
        f"CASE WHEN {new} IS NOT DISTINCT FROM {old} THEN {tags} WHEN {old} IS NOT NULL THEN {swapped} "
        f"ELSE list_concat([{new} || ' quality'], {tags}) END"
    )


query(
    "c26_with_quality",
    f"""WITH a AS (SELECT image_key, coalesce(tags, []) AS tags, {q.quality(q.join('tags'))} AS old FROM records)
    SELECT image_key, array_to_string({with_quality_sql('tags', "'best'", 'old')}, ', ') AS caption FROM a""",
)(lambda t: out(t.records, dv.with_quality(T(), "best")))
query("c27_characters", f"SELECT image_key, {q.join(q.chars())} AS characters FROM typed", "typed")(
    lambda t: t.typed.select("image_key", tg.render(dv.characters(F.col("typed"))).alias("characters"))
)
query("c28_styles", f"SELECT image_key, {q.join(q.styles())} AS styles FROM typed", "typed")(
    lambda t: t.typed.select("image_key", tg.render(dv.styles(F.col("typed"), STYLE_TAGS)).alias("styles"))
)
query(
    "c29_copyrights",
    f"""SELECT image_key, {q.join("list_transform(list_filter(typed, lambda x: coalesce(x.kind = 'copyright', false)), lambda x: x.tag)")} AS copyrights
    FROM typed""",
    "typed",
)(lambda t: t.typed.select("image_key", tg.render(dv.copyrights(F.col("typed"))).alias("copyrights")))
query(
    "c30_positions",
    """SELECT image_key, tags[2] AS second, tags[-1] AS last, array_to_string(tags[2:4], ', ') AS middle,
       array_to_string(tags[1:greatest(len(tags) - 1, 0)], ', ') AS without_last, len(tags) AS n,
       array_to_string(list_reverse(tags), ', ') AS backwards,
       tags = ['red ring'] AS is_red_ring FROM records""",
)(
    lambda t: t.records.select(
        "image_key",
        tg.pick(T(), 1).alias("second"),
        tg.pick(T(), -1).alias("last"),
        tg.render(tg.cut(T(), 1, 4)).alias("middle"),
        tg.render(tg.cut(T(), None, -1)).alias("without_last"),
        tg.length(T()).cast("bigint").alias("n"),
        tg.render(tg.reversed_tags(T())).alias("backwards"),
        tg.equals(T(), ["red ring"]).alias("is_red_ring"),
    )
)

# -- edits -----------------------------------------------------------------------------------------------------

NEW_SQL = "[category || ' file', 'red ring', image_key]"
query(
    "c31_add_front",
    f"""SELECT image_key, array_to_string(list_concat({NEW_SQL}, list_filter(coalesce(tags, []), lambda x: NOT list_contains({NEW_SQL}, x))), ', ')
    AS caption FROM records""",
)(lambda t: out(batch.edit(t.records, "add_tags", new=["%cat% file", "red ring", "%stem%"]), T()))
query(
    "c31_add_end",
    f"""SELECT image_key, array_to_string(list_concat(list_filter(coalesce(tags, []), lambda x: NOT list_contains({NEW_SQL}, x)), {NEW_SQL}), ', ')
    AS caption FROM records""",
)(lambda t: out(batch.edit(t.records, "add_tags", new=["%dirname% file", "red ring", "%filename%"], append=True), T()))
query(
    "c32_remove_tags",
    rows(
        "list_transform(list_filter(typed, lambda x: NOT (coalesce(x.kind IN ('artist', 'quality'), false) OR starts_with(x.tag, 'artist:') "
        "OR starts_with(x.tag, 'quality:') OR x.tag = 'red ring')), lambda x: x.tag)",
        "typed",
    ),
    "typed",
)(lambda t: out(batch.edit(t.typed, "remove_tags", names=["%artist%", "red ring", "%quality%"]), T()))
query("c32_remove_tags_regex", rows("list_filter(tags, lambda x: NOT regexp_matches(x, '^(?:.*ring|old)'))"))(
    lambda t: out(batch.edit(t.records, "remove_tags", names=[".*ring", "old"], regex=True), T())
)
query(
    "c33_replace_dispatch",
    rows(r"list_transform(tags, lambda t: CASE WHEN replace(regexp_replace(t, '^old (.*)', 'aged \1'), 'bolt', 'screw') = 'red screw' THEN 'nut' "
         r"ELSE replace(regexp_replace(t, '^old (.*)', 'aged \1'), 'bolt', 'screw') END)"),
)(
    lambda t: out(
        batch.edit(
            batch.edit(
                batch.edit(t.records, "replace_tag", old=r"^old (.*)", new=r"aged \1", regex=True),
                "replace_tag", old="bolt", new="screw",
            ),
            "replace_tag", old="red screw", new="nut", whole=True,
        ),
        T(),
    )
)
query(
    "c34_format_chain",
    rows(f"list_transform(list_transform(tags, lambda t: {q.strip_prefix('t', by_artist=True)}), lambda t: replace({q.unescape('t')}, ' ', '_'))"),
)(lambda t: out(t.records, dv.apply_formats(T(), ["standard", "unescape", "space", "underline"])))

OPTIMISED = f"""o1 AS (SELECT image_key, list_transform(typed, lambda x: {FORMALISE.format(x='x')}) AS t1 FROM typed),
  o2 AS (SELECT image_key, list_filter(list_transform(list_filter(list_transform(t1, lambda x, i: struct_pack(x := x, i := i)),
      lambda s: list_position(t1, s.x) = s.i), lambda s: s.x), lambda x: NOT x IN ('low quality', 'red ring')) AS t2 FROM o1),
  o3 AS (SELECT image_key, list(x ORDER BY {LADDER_SQL}, i) AS t3
      FROM (SELECT image_key, unnest(t2) AS x, generate_subscripts(t2, 1) AS i FROM o2) GROUP BY image_key),
  o4 AS (SELECT o2.image_key, CASE WHEN t2 IS NULL THEN NULL ELSE coalesce(t3, []) END AS t4 FROM o2 LEFT JOIN o3 ON o2.image_key = o3.image_key)"""
query(
    "c36_optimise",
    "WITH " + OPTIMISED + ",\n" + deoverlap_sql("t4", "o4")[5:],
    "typed",
    "overlap",
)(lambda t: out(dc.optimise(t.records, t.tag_dict, t.overlap, t.ladder, ["low quality", "red ring"]), T()))
query("c37_ascii_only", r"SELECT doc_id, regexp_replace(text, '[^\x00-\x7f]', '', 'g') AS text FROM documents")(
    lambda t: t.table("documents").select("doc_id", normal.ascii_only(F.col("text")).alias("text"))
)

SCORE_WORD = (
    "CASE WHEN aesthetic_score >= 9 THEN 'amazing' WHEN aesthetic_score >= 7.5 THEN 'best' WHEN aesthetic_score >= 6 THEN 'high' "
    "WHEN aesthetic_score >= 4 THEN 'normal' WHEN aesthetic_score >= 2.5 THEN 'low' WHEN aesthetic_score >= 1 THEN 'worst' "
    "WHEN aesthetic_score IS NOT NULL THEN 'horrible' END"
)
for mode in ("overwrite", "ignore"):
    keep = "aesthetic_score IS NULL" + (" OR old IS NOT NULL" if mode == "ignore" else "")
    query(
        f"c38_quality_from_score_{mode}",
        f"""WITH a AS (SELECT image_key, tags AS t0, coalesce(tags, []) AS tags, aesthetic_score, {q.quality(q.join('tags'))} AS old,
          {SCORE_WORD} AS word FROM records)
        SELECT image_key, array_to_string(CASE WHEN {keep} THEN t0 ELSE {with_quality_sql('tags', 'word', 'old')} END, ', ') AS caption FROM a""",
    )(lambda t, mode=mode: out(batch.edit(t.records, "quality_from_score", mode=mode), T()))
