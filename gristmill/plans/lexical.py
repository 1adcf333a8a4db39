"""Queries of the inverted index and the vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, pieces, tokens
from ..operators import bm25, dense, hits

K = 10
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOKENS = f"list_filter(regexp_extract_all(strip_accents(replace(lower(coalesce(text, '')), 'ß', 'ss')), '[\\p{{L}}\\p{{N}}]+'), lambda t: len(t) <= 64 AND t NOT IN ({_STOP}))"
_READ = f"toks AS (SELECT doc_id AS doc, {_TOKENS} AS tokens FROM documents)"
_COUNTED = f"""{_READ},
each AS (SELECT doc, len(tokens) AS len, unnest(tokens) AS term FROM toks),
tf AS (SELECT doc, len, term, count(*) AS n FROM each GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
stats AS (SELECT count(*) AS documents, avg(len(tokens)) AS average FROM toks),
postings AS (SELECT term, doc, least(n, 65535) AS tf, ln(1 + (documents - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * least(n, 65535) * 1.9::DOUBLE / (least(n, 65535) + 0.9::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * len / average)) AS impact FROM tf JOIN terms USING (term), stats)"""
_ASKED = f"asked AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark)"
_SCORED = f"""{_COUNTED}, {_ASKED},
scores AS (SELECT query_id, doc, sum(impact) AS score FROM asked JOIN postings USING (term) GROUP BY ALL),
ranks AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM scores WHERE round(score, 9) > 0)"""
#: A date for each document, of any precision: full, month, year or none.
_DATE = "CASE doc % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(2000 + doc % 25 AS VARCHAR) WHEN 2 THEN CAST(2000 + doc % 25 AS VARCHAR) || '-' || lpad(CAST(1 + doc % 12 AS VARCHAR), 2, '0') ELSE CAST(2000 + doc % 25 AS VARCHAR) || '-' || lpad(CAST(1 + doc % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + doc % 28 AS VARCHAR), 2, '0') END"
_FIRST = "CASE WHEN date = '' THEN NULL ELSE CAST(date || CASE len(date) WHEN 4 THEN '-01-01' WHEN 7 THEN '-01' ELSE '' END AS DATE) END"
_LAST = "CASE WHEN date = '' THEN NULL WHEN len(date) = 4 THEN CAST(date || '-12-31' AS DATE) WHEN len(date) = 7 THEN last_day(CAST(date || '-01' AS DATE)) ELSE CAST(date AS DATE) END"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("doc_id", "doc")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumnRenamed("item_id", "query_id")


def dated(rows: DataFrame) -> DataFrame:
    n = lambda k: F.lpad((F.col("doc") % k + 1).cast("string"), 2, "0")
    year = (F.col("doc") % 25 + 2000).cast("string")
    return rows.withColumn("date", F.when(F.col("doc") % 5 == 0, "").when(F.col("doc") % 5 == 1, year).when(F.col("doc") % 5 == 2, F.concat_ws("-", year, n(12))).otherwise(F.concat_ws("-", year, n(12), n(28))))


def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = bm25.tokenised(_documents(spark, sf_dir))
    return read.select("doc", F.array_join("tokens", " ").alias("terms"), F.size("tokens").cast("long").alias("n"))


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.frequencies(bm25.counted(_documents(spark, sf_dir))).select("doc", "term", F.least("n", F.lit(bm25.MOST_TF)).alias("tf"))


def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = bm25.counted(_documents(spark, sf_dir)).select(F.explode("terms").alias("term"))
    return read.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.corpus(bm25.counted(_documents(spark, sf_dir))).select("documents", F.round("average", 6).alias("average"), "terms")


def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = bm25.build(_documents(spark, sf_dir))
    return index.postings.select("term", "doc", F.col("tf").cast("long").alias("tf"), F.round("impact", 6).alias("impact"))


def posting_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each term's postings begin in the order of terms: prefix sums in blocks of terms by their first letters, whose totals are few."""
    from pyspark.sql import Window

    terms = document_frequencies(spark, sf_dir).withColumn("block", F.substring("term", 1, 2))
    totals = terms.groupBy("block").agg(F.sum("df").alias("size"))
    starts = totals.select("block", F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("df").over(Window.partitionBy("block").orderBy("term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return terms.withColumn("start", inside).join(starts, "block").select("term", "df", (F.col("start") + F.col("base")).alias("start"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.search_once(_documents(spark, sf_dir), _benchmark(spark, sf_dir), K)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "doc", F.round("score", 6).alias("score"))


def _hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return dated(bm25.search_once(_documents(spark, sf_dir), _benchmark(spark, sf_dir), k))


def bm25_asof_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits.as_of(_hits(spark, sf_dir, 40), "2012-06-15", 5, keep_undated=False, limit=40)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "doc", "date", F.round("score", 6).alias("score"))


def newest_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.newest(_hits(spark, sf_dir, K)).select("query_id", F.col("rank").cast("long").alias("rank"), "date")


def render_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _hits(spark, sf_dir, 3).join(_documents(spark, sf_dir).select("doc", "source", "text"), "doc")
    shown = found.select("query_id", "rank", F.concat(F.lit("Document "), F.col("doc").cast("string")).alias("title"), F.concat(F.lit("https://User@"), F.col("source"), F.lit(".Example.org:443/x?y")).alias("url"), "date", "text")
    return hits.render_all(shown)


def hit_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults planted among hits: scores that rise at every seventh document, texts blank at every eleventh."""
    found = bm25.search_once(_documents(spark, sf_dir), _benchmark(spark, sf_dir), K)
    broken = found.select("query_id", "rank", F.col("doc").alias("id"), F.when(F.col("doc") % 7 == 0, 1000.0 + F.col("rank")).otherwise(F.round("score", 9)).alias("score"), F.when(F.col("doc") % 11 == 0, " \t ").otherwise("x").alias("text"))
    return hits.faults(broken, 8).select("query_id", F.col("rank").cast("long").alias("rank"), "fault")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are all vectors whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    found = dense.search(vectors, vectors.where("doc % 20 = 0").withColumnRenamed("doc", "query_id"), K)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "doc", F.round("score", 6).alias("score"))


def dense_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    broken = F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 10 == 0, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("inf")).cast("float")))).otherwise(F.col("embedding"))
    return vectors.select("vec_id", dense.sound(broken, 64).alias("sound"))


def dense_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label in groups of about ten as tokens, those of odd id masked out."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    grouped = vectors.groupBy((F.col("vec_id") - F.col("vec_id") % 10).alias("g")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("t"))
    found = grouped.select("g", dense.pooled(F.transform("t", lambda x: x["embedding"]), F.transform("t", lambda x: (x["vec_id"] + 1) % 2), 64).alias("v"))
    return found.select("g", F.posexplode("v").alias("pos", "x")).select("g", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def split_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _documents(spark, sf_dir).select("doc", pieces(F.col("text")).alias("p"))
    return found.select("doc", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "").cast("binary")).alias("joined"))


QUERIES = {f.__name__: f for f in (tokenize_documents, term_frequencies, document_frequencies, corpus_stats, bm25_postings, posting_offsets, bm25_topk, bm25_asof_topk, newest_hit, render_hits, hit_faults, dense_topk, dense_sound, dense_mean_pool, split_pieces)}
ORACLE_SQL = {
    "tokenize_documents": f"WITH {_READ} SELECT doc, array_to_string(tokens, ' ') AS terms, len(tokens) AS n FROM toks",
    "term_frequencies": f"WITH {_COUNTED} SELECT doc, term, least(n, 65535) AS tf FROM tf",
    "document_frequencies": f"WITH {_COUNTED} SELECT term, df FROM terms",
    "corpus_stats": f"WITH {_READ} SELECT count(*) AS documents, round(avg(len(tokens)), 6) AS average, CAST(sum(len(tokens)) AS BIGINT) AS terms FROM toks",
    "bm25_postings": f"WITH {_COUNTED} SELECT term, doc, tf, round(impact, 6) AS impact FROM postings",
    "posting_offsets": f"WITH {_COUNTED} SELECT term, df, CAST(sum(df) OVER (ORDER BY term) - df AS BIGINT) AS start FROM terms",
    "bm25_topk": f"WITH {_SCORED} SELECT query_id, rank, doc, round(score, 6) AS score FROM ranks WHERE rank <= {K}",
    "bm25_asof_topk": f"WITH {_SCORED}, dated AS (SELECT query_id, rank, doc, score, {_DATE} AS date FROM ranks WHERE rank <= 40), able AS (SELECT query_id, doc, date, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM dated WHERE {_FIRST} <= DATE '2012-06-15') SELECT query_id, rank, doc, date, round(score, 6) AS score FROM able WHERE rank <= 5",
    "newest_hit": f"""WITH {_SCORED}, dated AS (SELECT query_id, rank, {_DATE} AS date FROM ranks WHERE rank <= {K}),
sides AS (SELECT query_id, rank, date, {_FIRST} AS f, {_LAST} AS l FROM dated),
listed AS (SELECT query_id, list({{'rank': rank, 'date': date, 'f': f, 'l': l}} ORDER BY rank) AS a FROM sides GROUP BY query_id),
best AS (SELECT query_id, list_reduce(a, lambda b, h: CASE WHEN h.f > b.l THEN h ELSE b END) AS b FROM listed)
SELECT query_id, b.rank AS rank, b.date AS date FROM best""",
    "render_hits": f"""WITH {_SCORED}, dated AS (SELECT query_id, rank, doc, {_DATE} AS date FROM ranks WHERE rank <= 3)
SELECT query_id, string_agg('[' || rank || '] Document ' || doc || ' (' || source || '.example.org' || CASE WHEN date = '' THEN '' ELSE ', ' || date END || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS rendered
FROM dated JOIN documents ON doc_id = doc GROUP BY query_id""",
    "hit_faults": f"""WITH {_SCORED}, broken AS (SELECT query_id, rank, doc, CASE WHEN doc % 7 = 0 THEN 1000.0 + rank ELSE round(score, 9) END AS score FROM ranks WHERE rank <= {K}),
seen AS (SELECT *, lag(score) OVER (PARTITION BY query_id ORDER BY rank) AS before FROM broken),
judged AS (SELECT query_id, rank, CASE WHEN rank > 8 THEN 'too many hits' WHEN doc % 11 = 0 THEN 'no text' WHEN score > before THEN 'score higher than the hit before' END AS fault FROM seen)
SELECT * FROM judged WHERE fault IS NOT NULL""",
    "dense_topk": f"""WITH scores AS (SELECT q.vec_id AS query_id, e.vec_id AS doc, list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM scores)
SELECT query_id, rank, doc, round(score, 6) AS score FROM ranks WHERE rank <= {K}""",
    "dense_sound": "SELECT vec_id, vec_id % 9 <> 0 AND vec_id % 10 <> 0 AS sound FROM embeddings",
    "dense_mean_pool": """WITH each AS (SELECT vec_id - vec_id % 10 AS g, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id % 2 = 0),
mean AS (SELECT g, pos, avg(x) AS m FROM each GROUP BY ALL),
norm AS (SELECT g, sqrt(sum(m * m)) AS n FROM mean GROUP BY g)
SELECT g, pos, round(m / greatest(n, 1e-12), 6) AS x FROM mean JOIN norm USING (g)""",
}
