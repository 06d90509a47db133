"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import round_trip
from .common import table
from .chat import context_messages, format_tool_chat, tool_messages
from .filter_audit import audit
from .fingerprints import fingerprint_documents
from .licenses import TEMPLATES, scan
from .mixing import mix
from .mtree import top_k
from .ngram_join import ngram_components
from .packing import pack
from .prefix_trie import trie
from .quality import quality
from .substrings import removal_summary
from .toxicity import toxicity

#: Where the public tokenizers lie; a parameter of every operator that uses one.
WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), k=5, percent=75)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_summary(table(spark, sf_dir, "documents"), length=400)


def op6_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), every=100, k=10, scale=1024)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER), capacity=4096, end_id=1)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    return format_tool_chat(*tool_messages(talk), context=context_messages(talk))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"), group=20, heads=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_mtree_search": op6_mtree_search,
    "op7_packing": op7_packing,
    "op8_fingerprints": op8_fingerprints,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_license_scan": op10_license_scan,
    "op11_bpe_codec": op11_bpe_codec,
    "op12_filter_audit": op12_filter_audit,
    "op13_prefix_trie": op13_prefix_trie,
}

def _license_sql() -> str:
    """Every line against every template, by plain counting."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    templates = ", ".join(f"({i}, '{label}', list_distinct(string_split('{text}', ' ')))" for i, (label, text) in enumerate(TEMPLATES))
    return f"""
WITH d AS (SELECT doc_id, {lower} AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w FROM d),
p AS (SELECT doc_id, t, len(w)::BIGINT AS n_words,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS mit,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS apache,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS gpl FROM w),
b AS (SELECT doc_id, n_words, list_concat(mit, apache, gpl) AS every, list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END,
    CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL) AS base FROM p),
templates(number, label, words) AS (VALUES {templates}),
lines AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), '{word}')) AS words FROM d),
common AS (SELECT doc_id, label, len(list_intersect(templates.words, lines.words)) AS n, len(templates.words) AS size FROM lines, templates),
m AS (SELECT doc_id, list(DISTINCT label) AS more, max(n / size) AS containment FROM common WHERE n >= greatest(1, ceil(0.8 * size - 1e-9)) GROUP BY doc_id)
SELECT b.doc_id, n_words, len(every)::BIGINT AS n_base, list_min(every)::BIGINT AS first_word, list_max(every)::BIGINT AS last_word,
    array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
    CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0)::DOUBLE END AS score
FROM b LEFT JOIN m USING (doc_id)"""


_CHAT_SQL = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS chars FROM conversations
    WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
calls AS (SELECT conv_id, turn, md5(conv_id || ':' || turn) AS call_id,
    CASE WHEN turn >= 2 THEN md5(conv_id || ':' || (turn - 2 * ceil(turn / 4)::BIGINT)) END AS after,
    CASE chars % 3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'measure' ELSE 'quote' END AS name, text, chars,
    len(list_filter(string_split_regex(text, '[ \n]'), lambda w: w <> '')) AS words FROM t WHERE role = 'user'),
levels AS (SELECT call_id, 0::BIGINT AS level FROM calls WHERE after IS NULL OR after NOT IN (SELECT call_id FROM calls)
    UNION ALL SELECT c.call_id, l.level + 1 FROM calls c JOIN levels l ON c.after = l.call_id),
results AS (SELECT md5(conv_id || ':' || (turn - 1)) AS call_id, text AS content FROM t WHERE role = 'assistant'),
checked AS (SELECT c.*, level, r.content, r.call_id IS NOT NULL AS linked, CASE name
    WHEN 'lookup' THEN CASE WHEN chars > 1000 THEN 'first too large; ' ELSE '' END || CASE WHEN chars > 64 THEN 'query too long; ' ELSE '' END
    WHEN 'measure' THEN CASE WHEN chars > 1500 THEN 'chars too large; ' ELSE '' END || CASE WHEN chars > 2000 THEN 'text too long; ' ELSE '' END
      || CASE WHEN words > 250 THEN 'words too large; ' ELSE '' END
    ELSE CASE WHEN chars > 2000 THEN 'text too long; ' ELSE '' END END AS f,
    CASE name WHEN 'lookup' THEN '{"first":' || chars || ',"query":' || to_json(text)
    WHEN 'measure' THEN '{"chars":' || chars || ',"text":' || to_json(text) || ',"words":' || words ELSE '{"text":' || to_json(text) END || '}' AS arguments
    FROM calls c LEFT JOIN levels USING (call_id) LEFT JOIN results r ON c.call_id = r.call_id),
messages AS (SELECT conv_id, turn, call_id, level, linked, rtrim(f, '; ') AS faults,
    '{"arguments":' || arguments || ',"id":"' || call_id || '","name":"' || name || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS message FROM checked
    UNION ALL SELECT DISTINCT conv_id, turn, md5(concat_ws(':', conv_id, turn, coalesce(role, ''), text)), 0, false, '',
    '{"content":' || to_json(text) || ',"id":"' || md5(concat_ws(':', conv_id, turn, coalesce(role, ''), text)) || '","role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}'
    FROM t WHERE coalesce(role, '') NOT IN ('user', 'assistant'))
SELECT conv_id, turn, call_id, level, row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, turn, call_id) - 1 AS position, linked,
    faults = '' AS valid, faults, message FROM messages"""

_SEARCH_SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

_JACCARD_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 75 * (na + nb - c)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS r FROM s UNION SELECT ends.b, reach.r FROM reach JOIN ends ON ends.a = reach.d),
least AS (SELECT d, min(r) AS r FROM reach GROUP BY d)
SELECT doc_id, len(s)::BIGINT AS n_shingles, r AS component_id,
    CASE WHEN len(s) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY md5(array_to_string(list_sort(s), chr(10)))) END AS copies
FROM s JOIN least ON d = doc_id"""

_REPEATS_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, len(h) // 2 AS n FROM h),
places AS (SELECT doc_id, h, unnest(range(n - 399)) AS i FROM n WHERE n >= 400),
windows AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM places),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY k) > 1),
steps AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM again),
runs AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM steps),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 400 AS e FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS f FROM spans),
cut AS (SELECT doc_id, sum(e - s) AS gone, count(*) AS spans, max(e) AS last, string_agg(substr(h, 2 * f + 1, 2 * (s - f)), '' ORDER BY s) AS kept
    FROM gaps JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM n LEFT JOIN cut USING (doc_id)"""

_AUDIT_SQL = """
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM w LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
f AS (SELECT unnest(range(1, 6)) AS f),
orders AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, f AS step FROM orders, f),
walk AS (SELECT part, array_to_string(list_transform(o, lambda i: chr(64 + i::INTEGER)), '') AS filter_order, step::INTEGER AS step, o[step] AS filter, n, good, toxic,
    len(list_filter(o[1:step - 1], lambda i: fails[i])) > 0 AS gone, fails[o[step]] AS failing, len(list_filter(fails, lambda x: x)) = 1 AS once FROM cells, steps),
s AS (SELECT part, filter_order, step, chr(64 + filter::INTEGER) AS filter, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept,
    coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed, coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant,
    coalesce(sum(n) FILTER (failing AND once), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND failing), 0) AS toxic_lost FROM walk GROUP BY ALL)
SELECT part, filter_order, step, filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM s"""

_TRIE_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS j FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, count(*) AS n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''),
    lambda x: ascii(x)::BIGINT)), lambda crc, x: list_reduce(list_prepend(xor(crc, x), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 4 AS h
    FROM t GROUP BY conv_id),
k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS kept FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT k.conv_id, t.j + 1 AS i, role, text FROM k JOIN t ON t.conv_id = k.base AND t.j < k.h
    UNION ALL SELECT k.conv_id, kept + t.j - h + 1, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.j >= k.h),
p AS (SELECT conv_id, i, text, md5(string_agg(md5(role) || md5(text), '' ORDER BY i) OVER (PARTITION BY conv_id ORDER BY i)) AS p FROM r
    UNION ALL SELECT conv_id, 0, '', '' FROM k),
len AS (SELECT conv_id, max(i) AS size FROM p GROUP BY conv_id),
up AS (SELECT p.*, q.p AS above, size FROM p JOIN len USING (conv_id) LEFT JOIN p q ON q.conv_id = p.conv_id AND q.i = p.i - 1),
nodes AS (SELECT p, any_value(i) AS depth, min(conv_id) AS conv_id, any_value(above) AS above, count(*) AS n, any_value(text) AS text,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (i = size) AS ends FROM up GROUP BY p),
kids AS (SELECT above AS p, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above),
own AS (SELECT nodes.*, coalesce(kids.n, 0) AS children, CASE WHEN depth = 0 THEN 0 ELSE (nodes.n - 1) * len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS saved
    FROM nodes LEFT JOIN kids USING (p)),
sums AS (SELECT a.p, count(*) FILTER (v.children = 0) AS leaves, sum(v.saved) AS saved FROM own v JOIN p a ON a.conv_id = v.conv_id AND a.i <= v.depth GROUP BY a.p)
SELECT own.conv_id, own.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, own.n AS n_convs, own.children AS n_children, leaves AS n_leaves,
    sums.saved::BIGINT AS saved_tokens, sha256(coalesce(own.ends, '')) AS ends_sha256
FROM own JOIN sums USING (p) LEFT JOIN nodes up ON up.p = own.above"""

ORACLES: dict[str, str] = {"op12_filter_audit": _AUDIT_SQL, "op13_prefix_trie": _TRIE_SQL, "op1_ngram_jaccard_join": _JACCARD_SQL, "op5_suffix_array_dedup": _REPEATS_SQL, "op6_mtree_search": _SEARCH_SQL, "op9_chat_formatting": _CHAT_SQL, "op10_license_scan": _license_sql()}
