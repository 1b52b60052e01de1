"""The registered queries of this subpackage and their DuckDB counterparts.

Of seven operators what SQL can express is put in SQL too: three whole results, and what it can of four under
names of their own.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplescope.llm.bpe import op4_byte_bpe
from ripplescope.llm.filter_audit import op12_filter_audit
from ripplescope.llm.html_extraction import op8_html_extraction
from ripplescope.llm.jaccard_join import op1_jaccard_join
from ripplescope.llm.lm_scoring import op9_lm_scoring
from ripplescope.llm.media import op5_media_columns
from ripplescope.llm.near_dup import op10_near_dup
from ripplescope.llm.packing import op7_packing
from ripplescope.llm.pii import op6_pii
from ripplescope.llm.sharding import op11_sharding
from ripplescope.llm.token_counts import op3_token_counts
from ripplescope.llm.toxicity import op2_toxicity


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and checksums of the payloads that op5 reads back."""
    return op5_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def pii_base_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of op6's spans of the base kinds."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base score of op9."""
    return op9_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def shard_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and places of op11."""
    return op11_sharding(spark, sf_dir).drop("text_crc32")


_QUERIES = (
    op1_jaccard_join, op2_toxicity, op3_token_counts, op4_byte_bpe, op5_media_columns, op6_pii, op7_packing, op8_html_extraction, op9_lm_scoring, op10_near_dup,
    op11_sharding, op12_filter_audit, media_payloads, pii_base_kinds, lm_base_scores, shard_places,
)

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_CRC = """crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x::UBIGINT], range(8)::UBIGINT[]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t)"""


def _crc32(bytes_list: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {bytes_list}), lambda c, b: xor(t[((xor(c, b) & 255) + 1)::INT], c >> 8)), 4294967295::UBIGINT)"


_REACH = """links AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
r(id, root) AS (SELECT id, id FROM nodes UNION SELECT r.id, links.b FROM r JOIN links ON links.a = r.root),
named AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)"""

_JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
 ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s), e AS (SELECT doc_id, unnest(s) AS x FROM s), nodes AS (SELECT doc_id AS id FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)), {_REACH}
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN named ON id = doc_id"""

_NEAR = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS able FROM embeddings),
nodes AS (SELECT vec_id AS id FROM v),
linked AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND a.able AND b.able AND len(a.e) = len(b.e)
 WHERE list_cosine_similarity(a.e, b.e) >= 0.98), {_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM named"""

_MEDIA = f"""WITH {_CRC}, p AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, encode(coalesce(text, '')) AS raw FROM documents),
q AS (SELECT doc_id, n, raw || unhex(repeat('00', (CASE WHEN n = 0 THEN 64 ELSE (64 - n % 64) % 64 END)::INT)) AS payload FROM p),
h AS (SELECT *, right(hex(payload), 128) AS tail FROM q)
SELECT doc_id, n AS n_bytes, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_sha256,
 {_crc32("list_transform(range(64), lambda i: ((instr('0123456789ABCDEF', tail[(2 * i + 1)::INT]) - 1) * 16 + instr('0123456789ABCDEF', tail[(2 * i + 2)::INT]) - 1)::UBIGINT)")}::BIGINT AS tail_crc32 FROM h, crc"""

_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (ltrim(p, '0') <> '' AND length(ltrim(p, '0')) <= 3 AND ltrim(p, '0')::INT > 255))) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", "length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN substr(d, (length(d) - i)::INT, 1)::INT "
     "WHEN substr(d, (length(d) - i)::INT, 1)::INT > 4 THEN 2 * substr(d, (length(d) - i)::INT, 1)::INT - 9 ELSE 2 * substr(d, (length(d) - i)::INT, 1)::INT END)) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 10 AND 15"),
)
_FOUND = " UNION ALL ".join(
    f"""SELECT doc_id, {k} AS rank, '{name}' AS kind, first, first + length(x) AS last FROM (
 SELECT *, regexp_replace(x, '[^0-9]', '', 'g') AS d, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x) AS first FROM (
  SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '{pattern}', concat(chr(57344), '\\0', chr(57344)), 'g'), chr(57344)) AS parts FROM t))) WHERE i % 2 = 0 AND {valid}"""
    for k, (name, pattern, valid) in enumerate(_KINDS)
)
_PII = f"""WITH t AS (SELECT doc_id, replace(coalesce(text, ''), chr(57344), chr(65533)) AS text FROM documents), s AS ({_FOUND})
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{name}') AS n_{name}" for name, _, _ in _KINDS)},
 sha256(coalesce(string_agg(concat(kind, ':', first::BIGINT, ':', last::BIGINT), ',' ORDER BY first, rank) FILTER (kind IS NOT NULL), '')) AS base_sha256 FROM t LEFT JOIN s USING (doc_id) GROUP BY doc_id"""

_LM = f"""WITH {_CRC}, w AS (SELECT doc_id, {_WORDS} AS w, {_crc32("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)")} % 7 = 2 AS held_out FROM documents, crc),
k AS (SELECT doc_id, held_out, unnest(list_append(w, ' ')) AS token FROM w),
c AS (SELECT token, count(*) AS c FROM k WHERE NOT held_out GROUP BY token), z AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(z.n) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 1)::DOUBLE / (z.n + z.v + 1))), 3) AS base_score
FROM k LEFT JOIN c USING (token), z GROUP BY doc_id, held_out"""

# One step of the bisection a row: shards left to fill, where they start, between which capacities the least one lies.
_SHARDS = """WITH RECURSIVE t AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, encode(coalesce(text, '')) AS raw, sha256(coalesce(text, '')) AS digest FROM documents),
g AS (SELECT digest, sum(size)::BIGINT AS b FROM t GROUP BY digest),
ranked AS (SELECT *, row_number() OVER w AS k, sum(b) OVER w - b AS before, (SELECT sum(b) FROM g) AS total FROM g WINDOW w AS (ORDER BY b DESC, digest ROWS UNBOUNDED PRECEDING)),
alone AS (SELECT digest, (k - 1)::INT AS shard FROM ranked WHERE k < coalesce((SELECT min(k) FROM ranked WHERE k > 7 OR b * (9 - k) <= total - before), 8)),
ends AS (SELECT digest, (sum(b) OVER (ORDER BY digest ROWS UNBOUNDED PRECEDING))::BIGINT AS e FROM g WHERE digest NOT IN (SELECT digest FROM alone)),
line AS (SELECT list_prepend(0::BIGINT, coalesce(list(e ORDER BY e), [])) AS es, coalesce(max(e), 0)::BIGINT AS total FROM ends),
r(shards, start, low, high, cut) AS (SELECT 8 - (SELECT count(*) FROM alone), 0::BIGINT, 0::BIGINT, total, NULL::BIGINT FROM line
 UNION ALL SELECT CASE WHEN low = high THEN shards - 1 ELSE shards END, CASE WHEN low = high THEN first ELSE start END,
  CASE WHEN low = high THEN 0 WHEN enough THEN low ELSE middle + 1 END, CASE WHEN low = high THEN total - first WHEN enough THEN middle ELSE high END, CASE WHEN low = high THEN first END
 FROM (SELECT *, list_max(list_filter(es, lambda e: e <= start + low)) AS first,
  list_reduce(list_concat([start], range(shards)), lambda p, i: list_max(list_filter(es, lambda e: e <= p + middle))) >= total AS enough FROM (SELECT r.*, (low + high) // 2 AS middle, es, total FROM r, line)) WHERE shards > 0),
placed AS (SELECT digest, shard FROM alone UNION ALL SELECT digest, ((SELECT count(*) FROM alone) + (SELECT count(*) FROM r WHERE cut < e))::INT FROM ends)
SELECT doc_id, size, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY t.digest, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard FROM t JOIN placed USING (digest)"""

_AUDIT = """WITH RECURSIVE f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), o(o) AS (SELECT '' UNION ALL SELECT o || f FROM o, f WHERE NOT contains(o, f) AND length(o) < 5),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic FROM t LEFT JOIN l USING (doc_id)),
s AS (SELECT o, i::INT AS step, substr(o, 1, (i - 1)::INT) AS before, substr(o, i::INT, 1) AS f FROM o, range(1, 6) r(i) WHERE length(o) = 5),
x AS (SELECT part, o, step, f, contains(fails, f) AS failed, translate(fails, before, '') = fails AS here, fails = f AS only_this, good, toxic FROM d, s),
y AS (SELECT part, o, step, f, count(*) FILTER (here AND NOT failed) AS kept, count(*) FILTER (here AND failed) AS removed, count(*) FILTER (failed AND NOT here) AS redundant, count(*) FILTER (only_this) AS unique_fails,
 count(*) FILTER (here AND failed AND good) AS good_lost, count(*) FILTER (here AND failed AND toxic) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, o AS filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM y"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": _JACCARD, "op10_near_dup": _NEAR, "op12_filter_audit": _AUDIT, "media_payloads": _MEDIA, "pii_base_kinds": _PII, "lm_base_scores": _LM, "shard_places": _SHARDS}
