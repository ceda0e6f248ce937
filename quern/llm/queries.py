"""The queries of the operators: each applied to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_pieces

    return pack(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary("byte_bpe_50k.json")))


#: fixed values of the contract: conversation -7
PLANTED_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_conversations

    planted = spark.createDataFrame(PLANTED_TURNS, "conv_id bigint, turn bigint, role string, text string")
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(given.unionByName(planted)))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import token_output

    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary("word_bpe_49k.json"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import sharded

    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import hits, report

    return report(hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


#: fixed values of the contract: host, path, verdict
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlrules import judge

    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import classes

    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import report

    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctw import scored

    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngramjoin import linked

    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import trie

    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_OP2 = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '<', ''), '|', ''), chr(92), ''))
      + length(role) + length(role) - length(replace(replace(replace(role, '<', ''), '|', ''), chr(92), '')) + 25 AS written
  FROM turns
), spoken AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w - 1 AS k FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), checked AS (
  SELECT conv_id, k, role, before, CASE coalesce(before, '')
      WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant'
      WHEN 'assistant' THEN role = 'user' ELSE false END AS fits FROM spoken
), state AS (
  SELECT conv_id, CASE WHEN bool_and(fits) THEN CASE WHEN max_by(role, k) = 'assistant' THEN 'ok' ELSE 'ends after ' || max_by(role, k) END
      ELSE (min_by('turn ' || k || ': ' || CASE role WHEN '' THEN '(none)' ELSE role END || ' after ' || coalesce(nullif(before, ''), 'start'), k) FILTER (NOT fits)) END AS state
  FROM checked GROUP BY conv_id
), learned AS (
  SELECT conv_id, string_agg(text, '' ORDER BY turn, role, text) AS loss FROM turns WHERE role = 'assistant' GROUP BY conv_id
), formatted AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256 FROM turns GROUP BY conv_id
), chars AS (
  SELECT conv_id, CAST(sum(written) + 16 AS BIGINT) AS formatted_chars FROM sized GROUP BY conv_id
)
SELECT f.conv_id, f.n_turns, f.turns_sha256, CAST(length(coalesce(l.loss, '')) AS BIGINT) AS loss_chars, sha256(coalesce(l.loss, '')) AS loss_sha256,
    c.formatted_chars, s.state
FROM formatted f JOIN chars c USING (conv_id) JOIN state s USING (conv_id) LEFT JOIN learned l USING (conv_id)
"""

_OP7 = """
WITH rules(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
), best AS (
  SELECT page_id, host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(rverdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM parts p LEFT JOIN best b USING (page_id)
"""


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
_OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, k, k + least(len(w), 10) - 1) AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, k, list_slice(w, k, k + n - 1) AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes)),
found AS (SELECT doc_id, n, k, item_id FROM places JOIN windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP11 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, k, k + 2), ' ')) AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
sized AS (SELECT * FROM grams JOIN sizes USING (doc_id)),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS c FROM sized x JOIN sized y ON x.g = y.g AND x.doc_id <> y.doc_id AND 100 * x.n >= 90 * y.n AND 100 * y.n >= 90 * x.n GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 90 * (n + m - c)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM classes LEFT JOIN sizes USING (doc_id)
"""

# CRC-32 of decimal digits, bit by bit: after each character eight steps.
_CRC = """(xor(list_reduce(flatten(list_transform(string_split({0}, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, (c & 1) * 3988292384) END, 4294967295::BIGINT), 4294967295::BIGINT))"""
_OP12 = rf"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS k FROM rows_),
convs AS (SELECT conv_id, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM rows_)),
whole AS (
  SELECT c.conv_id, 0 AS part, t.k, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.k < c.h
  UNION ALL SELECT c.conv_id, 1, t.k, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k >= c.h
), steps AS (
  SELECT conv_id, list(sha256(length(role) || ':' || role || text)) OVER w AS path, len(regexp_extract_all(text, '[^ 	-]+')) AS words FROM whole WINDOW w AS (PARTITION BY conv_id ORDER BY part, k)
  UNION ALL SELECT conv_id, CAST([] AS VARCHAR[]), 0 FROM convs
), nodes AS (
  SELECT path, min(conv_id) AS conv_id, len(path) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM steps GROUP BY path
), children AS (
  SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), above AS (
  SELECT list_slice(n.path, 1, k) AS path, count(*) FILTER (c.n_children IS NULL) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM nodes) n LEFT JOIN children c ON c.path = n.path GROUP BY 1
), ends AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(path, len(path)) AS path FROM steps GROUP BY conv_id) GROUP BY path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, a.n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN above a USING (path) LEFT JOIN children c USING (path) LEFT JOIN ends e USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = list_slice(n.path, 1, n.depth - 1)
"""

_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_OP13 = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, sha256({_LEAF} || {_FIELD.format("text")}) AS leaf,
    CASE WHEN {_CRC.format("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN sha256({_LEAF} || {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS changed FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashed
), nodes AS (
  SELECT lang, 0 AS d, i, leaf AS h, n FROM leaves
  UNION ALL SELECT lang, d + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, d, i // 8, n
), subroots AS (
  SELECT lang, d AS depth, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS d, i, subroot AS h, n FROM subroots
  UNION ALL SELECT d + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM upper WHERE n > 1 GROUP BY d, i // 8, n
), around AS (
  SELECT x.lang, x.d, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS before, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS after
  FROM nodes x JOIN nodes y ON x.lang IS NOT DISTINCT FROM y.lang AND x.d = y.d AND x.i // 8 = y.i // 8 WHERE x.n > 1 GROUP BY x.lang, x.d, x.i
), over_ AS (
  SELECT x.d, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS before, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS after
  FROM upper x JOIN upper y ON x.d = y.d AND x.i // 8 = y.i // 8 WHERE x.n > 1 GROUP BY x.d, x.i
), ways AS (
  SELECT l.doc_id, l.lang, l.leaf, s.subroot, a.d, a.before, a.after FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN around a ON a.lang IS NOT DISTINCT FROM l.lang AND a.i = l.i // CAST(pow(8, a.d) AS BIGINT)
  UNION ALL SELECT l.doc_id, l.lang, l.leaf, s.subroot, s.depth + o.d, o.before, o.after FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN over_ o ON o.i = s.i // CAST(pow(8, o.d) AS BIGINT)
), proofs AS (
  SELECT doc_id, lang, leaf, string_agg(before || after, '' ORDER BY d) AS proof FROM ways GROUP BY doc_id, lang, leaf
), folds AS (
  SELECT doc_id, lang, leaf, 0 AS d, coalesce(changed, leaf) AS h FROM leaves
  UNION ALL SELECT f.doc_id, f.lang, f.leaf, f.d + 1, sha256(w.before || f.h || w.after) FROM folds f JOIN ways w ON f.doc_id = w.doc_id AND f.lang IS NOT DISTINCT FROM w.lang AND f.leaf = w.leaf AND f.d = w.d
), ended AS (
  SELECT doc_id, lang, leaf, arg_max(h, d) AS folded_root FROM folds GROUP BY doc_id, lang, leaf
)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = r.h AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT h FROM upper WHERE n = 1) r ON true
LEFT JOIN proofs p ON l.doc_id = p.doc_id AND l.lang IS NOT DISTINCT FROM p.lang AND l.leaf = p.leaf LEFT JOIN ended e ON l.doc_id = e.doc_id AND l.lang IS NOT DISTINCT FROM e.lang AND l.leaf = e.leaf
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_formatting": _OP2, "op6_benchmark_decontamination": _OP6, "op7_url_filters": _OP7, "op11_ngram_jaccard_join": _OP11, "op12_conversation_trie": _OP12,
        "op13_merkle_manifest": _OP13,
    }  # fmt: skip
