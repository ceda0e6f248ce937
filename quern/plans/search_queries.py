"""Queries of searches made of others, over documents and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import searches as X
from ..operators.retrieval import bm25, bm25_lists
from ..sources.stored import stored
from ..sources.tables import table
from .index_queries import _FTS, _RANKED, _TOKENS, _index as _fts_index, _words
from .registry import Fixture, query
from .retrieval_queries import _INDEX, _bm25_sql, _queries
from .retrieval_queries import _index as _plain_index

# --- spellings: as it is, the longer words alone, every word without its last letter ---

_SPELLINGS = r"""spellings AS (
  SELECT item_id AS query_id, 0 AS spelling, coalesce(text, '') AS text FROM benchmark
  UNION ALL SELECT item_id, 1, array_to_string(list_filter(string_split(coalesce(text, ''), ' '), lambda x: length(x) >= 6), ' ') FROM benchmark
  UNION ALL SELECT item_id, 2, array_to_string(list_transform(string_split(coalesce(text, ''), ' '), lambda x: left(x, greatest(length(x) - 1, 0))), ' ') FROM benchmark)"""
_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 1)"


def _spellings(spark, sf):
    words = F.split(F.coalesce("text", F.lit("")), " ")
    forms = [F.coalesce("text", F.lit("")), F.array_join(F.filter(words, lambda x: F.length(x) >= 6), " "), F.array_join(F.transform(words, lambda x: F.left(x, F.greatest(F.length(x) - 1, F.lit(0)))), " ")]
    rows = F.posexplode(F.array(*forms)).alias("spelling", "text")
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), rows)


@query(f"""WITH {_INDEX}, {_SPELLINGS},
words_ AS (SELECT query_id, spelling, unnest({_WORDS.format("text")}) AS term FROM spellings),
counted AS (SELECT query_id, spelling, term, count(*) AS qtf FROM words_ GROUP BY ALL),
scored AS (SELECT query_id, spelling, doc_id, round(sum(c.qtf * ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM counted c JOIN terms USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), totals GROUP BY query_id, spelling, doc_id),
first AS (SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, spelling ORDER BY score DESC, doc_id) <= 20),
best AS (SELECT query_id, doc_id, max(score) AS score, arg_min(spelling, (-score, spelling)) AS spelling FROM first GROUP BY ALL)
SELECT query_id, doc_id, score, CAST(spelling AS INTEGER) AS spelling, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM best) WHERE rank <= 10""")
def multi_query_search(spark, sf):
    return X.multi_query(_words(spark, sf), _spellings(spark, sf))


# --- a drafter for each source, a date for each document ---

FX_NAMES = Fixture("fx_names", "n int, drafter string", [(k, a + b) for k, (a, b) in enumerate((a, b) for a in "김이박최정" for b in ("철수", "영희", "민호 부장", "새름"))])
_PAPERS = f"""{FX_NAMES.sql()}, papers AS (
  SELECT doc_id, source || '_' || lang || '_' || (doc_id // 3) || '.pdf' AS filename, drafter, CAST(2015 + doc_id // 20 % 10 AS VARCHAR) || '-0' || (1 + doc_id % 9) || '-11' AS date, coalesce(text, '') AS text, lang, source
  FROM documents JOIN fx_names ON n = CAST(substr(source, 4) AS INTEGER) % 20)"""


def _papers(spark, sf):
    date = F.concat((F.lit(2015) + F.expr("doc_id div 20") % 10).cast("string"), F.lit("-0"), (1 + F.col("doc_id") % 9).cast("string"), F.lit("-11"))
    name = F.concat("source", F.lit("_"), "lang", F.lit("_"), F.expr("doc_id div 3").cast("string"), F.lit(".pdf"))
    docs = table(spark, sf, "documents").withColumn("n", F.substring("source", 4, 9).cast("int") % 20)
    return docs.join(F.broadcast(FX_NAMES.df(spark)), "n").select("doc_id", name.alias("filename"), "drafter", date.alias("date"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source")  # twenty names


@query(f"""WITH {_PAPERS},
asked AS (SELECT item_id AS query_id, CAST(2014 + item_id % 12 AS VARCHAR) AS year, left(drafter, 3) AS name FROM benchmark JOIN fx_names ON n = item_id % 20),
met AS (SELECT query_id, doc_id, filename, row_number() OVER (PARTITION BY query_id ORDER BY date DESC, doc_id) AS turn FROM asked JOIN papers ON left(date, 4) = year AND contains(drafter, name)),
once AS (SELECT *, row_number() OVER (PARTITION BY query_id, filename ORDER BY turn) AS copy FROM met WHERE turn <= 200)
SELECT query_id, doc_id, CAST(3.0 AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY turn) AS rank FROM once WHERE copy = 1) WHERE rank <= 20""")
def metadata_stage(spark, sf):
    asked = table(spark, sf, "benchmark").withColumn("n", (F.col("item_id") % 20).cast("int")).join(F.broadcast(FX_NAMES.df(spark)), "n")
    text = F.concat((F.lit(2014) + F.col("item_id") % 12).cast("string"), F.lit("년 "), F.left("drafter", F.lit(3)), F.lit(" "), F.coalesce("text", F.lit("")))
    return X.metadata_stage(_papers(spark, sf), asked.select(F.col("item_id").alias("query_id"), text.alias("query")))


_LISTS = "WITH " + _bm25_sql("robertson").replace("WHERE rank <= 10", "WHERE rank <= 50") + f""", lucene AS (SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.6 / (tf + 1.6 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM asked JOIN terms USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL) WHERE score > 0) WHERE rank <= 50), {_PAPERS}"""


def _lists(spark, sf):
    return bm25_lists(_plain_index(spark, sf), _queries(spark, sf), [{}, {"k1": 1.6, "idf": "lucene"}], 50)


@query(f"""{_LISTS},
target AS (SELECT query_id, filename AS name FROM (SELECT query_id, filename, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS turn FROM bm25 JOIN papers USING (doc_id)) WHERE turn = 1),
one AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS r FROM bm25 JOIN papers USING (doc_id) JOIN target USING (query_id) WHERE filename = name),
two AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS r FROM lucene JOIN papers USING (doc_id) JOIN target USING (query_id) WHERE filename = name),
fused AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM one WHERE r <= 10 UNION ALL SELECT * FROM two WHERE r <= 10) GROUP BY ALL)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM fused""")
def specific_document_search(spark, sf):
    """Each item's search kept to the file of its first hit, whose name is asked for in other letters."""
    first, second = _lists(spark, sf)
    docs = _papers(spark, sf).select("doc_id", "filename")
    top = first.join(docs, "doc_id").groupBy("query_id").agg(F.upper(F.min_by("filename", "rank")).alias("target"))
    return X.in_document(first, second, docs, top)


@query(f"""{_LISTS},
got AS (SELECT query_id, doc_id, rank FROM bm25 WHERE rank <= query_id % 7),
short AS (SELECT item_id AS query_id FROM benchmark LEFT JOIN got ON item_id = query_id GROUP BY item_id HAVING count(doc_id) < 5),
rows_ AS (SELECT query_id, doc_id, 'got' AS source, 0 AS turn, rank FROM got
  UNION ALL SELECT query_id, doc_id, 'bm25', 1, rank FROM bm25 JOIN short USING (query_id) WHERE rank <= 10
  UNION ALL SELECT query_id, doc_id, 'vector', 2, rank FROM lucene JOIN short USING (query_id) WHERE rank <= 10),
first AS (SELECT query_id, doc_id, min(turn) AS turn, arg_min(rank, turn) AS rank, arg_min(source, turn) AS source FROM rows_ GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, rank, doc_id) AS place FROM first)
SELECT query_id, doc_id, source, CAST(place AS INTEGER) AS place FROM placed WHERE turn = 0 OR place <= 5""")
def backfill_results(spark, sf):
    """Lists of nought to six hits filled up to five, from BM25 and then from the other list."""
    first, second = _lists(spark, sf)
    got = first.filter(F.col("rank") <= F.col("query_id") % 7).select("query_id", "doc_id", "rank")
    return X.backfilled(got, [("bm25", first), ("vector", second)], _queries(spark, sf), 5)


_NAMED = "asked AS (SELECT item_id AS query_id, 'SRC' || (item_id % 23) || '_  ' || left(coalesce(text, ''), 2) || ' _' || item_id || '. src' AS query FROM benchmark)"
_BY_NAME = """words AS (SELECT query_id, word, count(*) AS times FROM (SELECT query_id, unnest(regexp_split_to_array(lower(query), '[ \\t\\n\\r\\x0B\\f]+')) AS word FROM {0}) WHERE word <> '' GROUP BY ALL),
named AS (SELECT query_id, doc_id, CAST(sum(times) AS DOUBLE) AS score FROM words JOIN papers ON contains(lower(filename), word) GROUP BY ALL)"""


def _asked_by_name(spark, sf):
    text = F.concat(F.lit("SRC"), (F.col("item_id") % 23).cast("string"), F.lit("_  "), F.left(F.coalesce("text", F.lit("")), F.lit(2)), F.lit(" _"), F.col("item_id").cast("string"), F.lit(". src"))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("query"))


@query(f"""WITH {_PAPERS}, {_NAMED}, {_BY_NAME.format("asked")}
SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM named) WHERE rank <= 20""")
def filename_search(spark, sf):
    return X.filename_search(_papers(spark, sf).select("doc_id", "filename"), _asked_by_name(spark, sf))


# Items with an even number ask with their last four words, the others for a file.
_CONTENT = f"""both_ AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN array_to_string(list_slice(string_split(trim(coalesce(text, '')), ' '), -4, -1), ' ') ELSE 'zzqx src' || item_id % 23 END AS query FROM benchmark),
phrases AS (SELECT query_id, {_TOKENS.format("word")} AS terms FROM (SELECT query_id, unnest(regexp_split_to_array(query, '[ \\t\\n\\r\\x0B\\f]+')) AS word FROM both_)),
asked AS (SELECT query_id, array_to_string(terms, ' ') AS key, terms, count(*) AS times FROM phrases WHERE len(terms) > 0 GROUP BY ALL),
parts AS (SELECT DISTINCT key, len(terms) AS n, unnest(list_zip(terms, range(len(terms)))) AS t FROM asked),
begins AS (SELECT key, doc_id, n, place - t[2] AS place FROM parts JOIN places ON term = t[1] GROUP BY key, doc_id, n, place - t[2] HAVING count(DISTINCT t[2]) = n),
hits AS (SELECT key, doc_id, count(*) AS f FROM begins GROUP BY ALL)"""


@query(f"""WITH {_PAPERS}, {_FTS.replace("words AS", "texts AS", 1).replace("FROM words", "FROM texts")}, {_CONTENT}, found AS (WITH {_RANKED.format(where="").replace("rank <= 10", "rank <= 20")}),
rest AS (SELECT * FROM both_ WHERE query_id NOT IN (SELECT query_id FROM found)), {_BY_NAME.format("rest")}
SELECT query_id, doc_id, 'text' AS source, score, rank FROM found
UNION ALL SELECT query_id, doc_id, 'filename', score, CAST(rank AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM named) WHERE rank <= 20""")
def content_search(spark, sf):
    words = F.split(F.trim(F.coalesce("text", F.lit(""))), " ")
    last = F.array_join(F.slice(words, F.greatest(F.size(words) - 3, F.lit(1)), 4), " ")
    text = F.when(F.col("item_id") % 2 == 0, last).otherwise(F.concat(F.lit("zzqx src"), (F.col("item_id") % 23).cast("string")))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("query"))
    return X.content_search(_fts_index(spark, sf), _papers(spark, sf).select("doc_id", "filename"), asked)


# Pages end with every fourth line, for the documents have no form feeds.
_PAGED = "paged AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '((?:[^\\n]*\\n){4})', '\\1' || chr(12), 'g') AS text FROM documents)"


def _paged(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"((?:[^\n]*\n){4})", "$1\f").alias("text"))


@query("WITH " + _bm25_sql("robertson") + f""", {_PAGED}, cut AS (SELECT doc_id, string_split(text, chr(12)) AS p FROM paged),
first AS (SELECT doc_id, left(p[1], 1200) AS lite, p[1:5] AS p FROM cut),
whole AS (SELECT doc_id, lite, array_to_string(list_transform(list_filter(list_zip(p, range(len(p))), lambda x: x[2] = 0 OR list_sum(list_transform(p[1:x[2]], lambda y: length(y) + 2)) <= 15000), lambda x: x[1] || chr(10) || chr(10)), '') AS whole FROM first)
SELECT query_id, doc_id, rank, md5(lite) AS lite, md5(whole) AS whole, CAST(length(whole) AS BIGINT) AS chars FROM bm25 JOIN whole USING (doc_id)""")
def enriched_hits(spark, sf):
    hits, docs = stored(bm25(_plain_index(spark, sf), _queries(spark, sf))), _paged(spark, sf)
    lite = X.with_contents(hits.select("query_id", "doc_id", "rank"), docs).withColumnRenamed("content", "lite")
    both = X.with_contents(lite, docs, "full")
    return both.select("query_id", "doc_id", "rank", F.md5("lite").alias("lite"), F.md5("content").alias("whole"), F.length("content").cast("bigint").alias("chars"))


# Chunks are paragraphs (lines) of papers; of a file that three documents share each has a tenth of its lines under the heading of a section.
_CHUNKS = f"""{_PAPERS}, chunks AS (SELECT filename, doc_id * 100000 + k AS chunk_id, CASE WHEN k % 10 = 3 THEN '결론 ' ELSE '' END || lines[k] AS text
  FROM (SELECT filename, doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM (SELECT filename, doc_id, string_split(text, chr(10)) AS lines FROM papers))),
targets AS (SELECT DISTINCT doc_id AS query_id, filename FROM papers WHERE doc_id % 20 = 0),
found AS (SELECT query_id, chunk_id, text FROM targets JOIN chunks USING (filename) WHERE trim(text) <> '')"""


def _chunks(spark, sf):
    papers = _papers(spark, sf)
    rows = papers.select("filename", "doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    k = F.col("k") + 1
    chunks = rows.select("filename", (F.col("doc_id") * 100000 + k).alias("chunk_id"), F.concat(F.when(k % 10 == 3, F.lit("결론 ")).otherwise(F.lit("")), "line").alias("text"))
    return chunks, papers.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "filename")


@query(f"WITH {_CHUNKS} SELECT query_id, chunk_id, md5(text) AS text, CAST(1.0 AS DOUBLE) AS score FROM found")
def document_chunks(spark, sf):
    return X.document_chunks(*_chunks(spark, sf)).withColumn("text", F.md5("text"))


@query(f"""WITH {_CHUNKS}, placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN contains(text, '결론') THEN 0 ELSE 1 END, chunk_id) AS k FROM found)
SELECT query_id, CAST(count(*) AS INTEGER) AS n_chunks, md5(left(string_agg('=== [문서 청크 ' || k || '] ===' || chr(10) || left(text, 5000), chr(10) || chr(10) ORDER BY k), 6000)) AS context FROM placed WHERE k <= 10 GROUP BY query_id""")
def summary_context(spark, sf):
    return X.summary_context(X.document_chunks(*_chunks(spark, sf))).withColumn("context", F.md5("context"))
