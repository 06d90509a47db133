"""SQL text for the checks: the derived datasets as CTEs and the tag functions as expressions."""

from __future__ import annotations

QUALITY = r"\b(amazing|best|high|normal|low|worst|horrible)([\s_]quality)\b"

RECORDS = r"""
lines AS (
  SELECT l_orderkey, p_name, p_brand, p_type, p_size,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos
  FROM lineitem JOIN part ON l_partkey = p_partkey),
line_tags AS (
  SELECT l_orderkey, pos,
         CASE WHEN pos = 1 AND p_size <= 40 THEN 'artist: ' || lower(p_brand)
              WHEN pos = 1 THEN 'by ' || p_name
              WHEN p_type = 'PROMO' THEN 'character: ' || p_name
              WHEN p_type = 'SMALL' AND pos % 2 = 0 THEN 'style: ' || p_name
              WHEN p_type = 'STANDARD' AND pos % 2 = 0 THEN p_name || ' \(std\)'
              WHEN pos % 3 = 0 THEN replace(p_name, ' ', '_')
              ELSE p_name END AS tag
  FROM lines),
captions AS (SELECT l_orderkey, string_agg(tag, ', ' ORDER BY pos) AS caption FROM line_tags GROUP BY l_orderkey),
base_records AS (
  SELECT o_orderkey AS ord, 'img' || o_orderkey AS image_key,
         '/data/' || substr(o_orderpriority, 1, 1) || '/' || o_orderstatus || '/img' || o_orderkey
           || CASE WHEN o_orderkey % 3 = 0 THEN '.png' ELSE '.jpg' END AS image_path,
         caption || CASE o_orderkey % 7 WHEN 0 THEN ', best quality' WHEN 1 THEN ', low quality'
                                        WHEN 2 THEN ', high_quality' ELSE '' END AS caption,
         o_orderpriority || ' ' || o_orderstatus AS description,
         CAST(256 + 64 * (o_custkey % 16) AS INT) AS width, CAST(256 + 64 * (o_orderkey % 11) AS INT) AS height,
         CASE WHEN o_orderkey % 10 <> 0 THEN round(o_totalprice / 50000.0, 3) END AS aesthetic_score,
         CASE o_orderstatus WHEN 'P' THEN 'g' WHEN 'F' THEN 's' ELSE 'q' END AS safe_level,
         round(o_totalprice / 600000.0, 3) AS safe_rating,
         CASE WHEN o_orderstatus <> 'P' THEN substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 16) END AS perceptual_hash,
         o_orderstatus AS category
  FROM orders LEFT JOIN captions ON l_orderkey = o_orderkey),
records AS (
  SELECT *, list_filter(list_transform(string_split(caption, ', '), lambda t: trim(t)), lambda t: t <> '') AS tags
  FROM base_records)"""

OTHER = r"""
other AS (
  SELECT l_orderkey AS ord, 'img' || l_orderkey AS image_key,
         '/backup/2/' || max(l_linestatus) || '/img' || l_orderkey || '.png' AS image_path,
         list(p_name ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS tags,
         round(max(l_discount) * 100, 2) AS aesthetic_score, max(l_linestatus) AS category
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY l_orderkey
  UNION ALL
  SELECT p_partkey, 'part' || p_partkey, '/backup/parts/' || p_type || '/part' || p_partkey || '.jpg',
         [p_name, lower(p_type)], round(p_size / 5.0, 2), p_type FROM part)"""

DICT = r"""
tag_dict AS (
  SELECT 'artist' AS kind, lower(p_brand) AS tag FROM part WHERE p_size <= 25
  UNION SELECT 'artist', replace(p_name, ' ', '_') FROM part WHERE p_type = 'ECONOMY' AND p_size = 1
  UNION SELECT 'character', replace(p_name, ' ', '_') FROM part WHERE p_type = 'PROMO' AND p_size <= 3
  UNION SELECT 'style', replace(p_name, ' ', '_') FROM part WHERE p_type = 'MEDIUM' AND p_size <= 2
  UNION SELECT 'copyright', replace(p_name, ' ', '_') FROM part WHERE p_type = 'LARGE' AND p_size <= 5
  UNION SELECT 'quality', unnest(['amazing_quality', 'best_quality', 'high_quality', 'normal_quality', 'low_quality',
                                  'worst_quality', 'horrible_quality'])),
kinds AS (
  SELECT map_from_entries(list((tag, kind))) AS kind_map FROM (
    SELECT tag, min_by(kind, CASE kind WHEN 'artist' THEN 0 WHEN 'character' THEN 1 WHEN 'style' THEN 2
                                       WHEN 'copyright' THEN 3 ELSE 4 END) AS kind FROM tag_dict GROUP BY tag))"""

NAMES = r"""
names AS (SELECT p_name, min(p_partkey) AS id, count(*) AS cnt, min(p_size) AS size FROM part GROUP BY p_name)"""

OVERLAP = r"""
overlap AS (
  SELECT replace(a.p_name, ' ', '_') AS query,
         list(replace(b.p_name, ' ', '_')) AS children
  FROM names a JOIN names b ON split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2) AND b.p_name < a.p_name
  GROUP BY a.p_name),
covers AS (SELECT map_from_entries(list((query, children))) AS child_map FROM overlap)"""

FEATURES = r"""
features AS (
  SELECT c.p_name AS character, n.p_name AS feature
  FROM (SELECT DISTINCT p_name FROM part WHERE p_type = 'PROMO') c
  JOIN names n ON split_part(c.p_name, ' ', 1) = split_part(n.p_name, ' ', 1) AND c.p_name <> n.p_name)"""

PREDICTIONS = r"""
predictions AS (
  SELECT 'img' || l_orderkey AS image_key, p_name AS tag, CASE WHEN p_type = 'PROMO' THEN 4 ELSE 0 END AS category,
         max(round(l_discount * 10, 2)) AS prob
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
predicted AS (
  SELECT image_key, list(tag ORDER BY category DESC, prob DESC, tag) AS predicted
  FROM predictions WHERE prob > 0.35 GROUP BY image_key)"""

HASHES = r"""
base_hashes AS (
  SELECT vec_id,
    list_reduce(list_transform(embedding[1:32], lambda x: CASE WHEN x > 0 THEN 1::BIGINT ELSE 0::BIGINT END), lambda a, x: a * 2 + x) AS h1,
    list_reduce(list_transform(embedding[33:64], lambda x: CASE WHEN x > 0 THEN 1::BIGINT ELSE 0::BIGINT END), lambda a, x: a * 2 + x) AS h2
  FROM embeddings),
hashes AS (SELECT * FROM base_hashes UNION ALL SELECT vec_id + 1000000, xor(h1, 3::BIGINT), h2 FROM base_hashes)"""

EDITS = r"""
edits AS (
  SELECT 'img' || user_id AS image_key, event_id AS seq, CASE event_type WHEN 'error' THEN 'D' ELSE 'U' END AS op,
         event_type || ', k' || json_extract_string(props, '$.k') AS caption FROM events),
last_edits AS (SELECT image_key, max_by(op, seq) AS op, max_by(caption, seq) AS caption, max(seq) AS seq FROM edits GROUP BY 1)"""

POSTS = r"""
dim AS (SELECT id, p_name AS name, ['general', 'artist', 'character', 'copyright', 'meta'][(id % 5) + 1] AS type, cnt FROM names),
post_ids AS (
  SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos,
         CASE WHEN l_returnflag = 'R' THEN -l_suppkey ELSE names.id END AS tag_id
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN names ON part.p_name = names.p_name),
posts AS (
  SELECT o_orderkey AS id, CAST(o_custkey % 4 AS INT) AS rating, CAST(o_custkey % 2 AS INT) AS has_children,
         CAST(o_custkey % 3 AS INT) AS has_large
  FROM orders WHERE o_orderkey IN (SELECT id FROM post_ids))"""

_counter = [0]


def _let(value: str, body) -> str:
    """Evaluate a scalar expression once."""
    _counter[0] += 1
    name = f"v{_counter[0]}"
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def strip_prefix(x: str, by_artist: bool = False) -> str:
    artist = "'by ' || trim(substr({0}, 8), '_ ')" if by_artist else "trim(substr({0}, 8), '_ ')"
    return _let(
        x,
        lambda v: f"CASE WHEN starts_with({v}, 'artist:') THEN {artist.format(v)} "
        f"WHEN starts_with({v}, 'character:') THEN trim(substr({v}, 11), '_ ') "
        f"WHEN starts_with({v}, 'style:') THEN trim(substr({v}, 7), '_ ') ELSE {v} END",
    )


def unescape(x: str) -> str:
    return rf"regexp_replace({x}, '\\([(){{}}\[\]])', '\1', 'g')"


def escape(x: str) -> str:
    return rf"regexp_replace({unescape(x)}, '([(){{}}\[\]])', '\\\1', 'g')"


def norm(x: str) -> str:
    return strip_prefix(unescape(f"replace(trim(replace(lower({x}), ' ', '_'), '_'), ':_', ':')"))


def space(x: str) -> str:
    return strip_prefix(escape(f"replace(trim(replace(lower({x}), '_', ' '), ' '), ': ', ':')"))


def prio_key(x: str) -> str:
    return rf"replace(replace(lower(trim({x})), '\', ''), ' ', '_')"


def tag_type(tag: str, kind: str) -> str:
    return (
        f"CASE WHEN starts_with({tag}, 'artist:') THEN 'artist' WHEN starts_with({tag}, 'character:') THEN 'character' "
        f"WHEN starts_with({tag}, 'style:') THEN 'style' WHEN starts_with({tag}, 'quality:') THEN 'quality' "
        f"WHEN starts_with({tag}, 'copyright:') THEN 'copyright' "
        f"WHEN NOT contains({tag}, ':') AND contains({tag}, 'quality') THEN 'quality' "
        rf"WHEN NOT contains({tag}, ':') AND regexp_matches({tag}, '^by \w') THEN 'artist' "
        f"ELSE coalesce({kind}, 'general') END"
    )


def typed_list(tags: str) -> str:
    return (
        f"list_transform(list_transform({tags}, lambda t0: struct_pack(tag := t0, norm := {norm('t0')})), "
        f"lambda s0: struct_pack(tag := s0.tag, norm := s0.norm, kind := kind_map[s0.norm], "
        f"type := {tag_type('s0.tag', 'kind_map[s0.norm]')}))"
    )


TYPED = f"\ntyped AS (SELECT r.*, {typed_list('tags')} AS typed FROM records r CROSS JOIN kinds)"

ARTIST = (
    r"coalesce(nullif(regexp_extract({c}, 'artist:[\s_]*([^,]+)', 1), ''), "
    r"nullif(regexp_extract({c}, '(?:^|,\s)by[\s_](\w[\w\-.\s()\\]*)', 1), ''))"
)


def artist(caption: str) -> str:
    return ARTIST.format(c=caption)


def quality(caption: str) -> str:
    return f"nullif(regexp_extract({caption}, '{QUALITY}', 1), '')"


def join(tags: str) -> str:
    return f"array_to_string({tags}, ', ')"


def chars(typed: str = "typed") -> str:
    return _let(
        f"list_transform(list_filter({typed}, lambda x: x.type = 'character'), lambda x: {strip_prefix('x.tag')})",
        lambda v: f"CASE WHEN len({v}) > 0 THEN {v} END",
    )


STYLE_LIST = "['cold gear', 'hot gear', 'old gear', 'red gear']"


def styles(tags: str = "tags") -> str:
    return _let(
        rf"list_concat(regexp_extract_all({join(tags)}, 'style:[\s_]*([^,]+)', 1), "
        f"list_filter({tags}, lambda y: list_contains({STYLE_LIST}, y)))",
        lambda v: f"CASE WHEN len({v}) > 0 THEN {v} END",
    )


FULL = (
    f"\nfull_records AS (SELECT *, {artist(join('tags'))} AS artist, {quality(join('tags'))} AS quality, "
    f"{chars()} AS characters, {styles()} AS styles FROM typed)"
)

PARTS = {
    "records": RECORDS,
    "other": OTHER,
    "dict": DICT,
    "typed": TYPED,
    "full": FULL,
    "names": NAMES,
    "overlap": OVERLAP,
    "features": FEATURES,
    "predictions": PREDICTIONS,
    "hashes": HASHES,
    "edits": EDITS,
    "posts": POSTS,
}
NEEDS = {
    "typed": ("records", "dict"),
    "full": ("typed",),
    "overlap": ("names",),
    "features": ("names",),
    "posts": ("names",),
}


def build(body: str, *parts: str) -> str:
    """A query with the CTEs it needs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for part in parts or ("records",):
        add(part)
    ctes = ",".join(PARTS[p] for p in ordered)
    body = body.strip()
    return f"WITH {ctes},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {ctes}\n{body}"
