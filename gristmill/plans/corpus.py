"""Queries of web pages, dates, passages, selection and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, urls
from ..functions.text import collapsed, sentences, words
from ..operators import articles, evaluation, passages, selection, sequences, vocabulary, web
from ..streaming import incremental


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Dates: texts of many shapes made from row numbers.
_SHAPES = ("{y}", "{y}-{m}", "{y}{m}", "{y}-{m}-{d}", "{y}{m}{d}", " {y}-{m}-{d}T10:20:30Z ", "{y}-{m}-{d} 23:59", "{y}-{m}-{d}T24:00", "{y}/{m}", "{d}-{m}-{y}", "", "0000-{m}", "{y}-{m}-{d}T01:02:03.5+05:30")
_PARSED = """shaped AS (SELECT k, trim(said) AS t FROM texts),
cut AS (SELECT k, t, regexp_extract(t, '^([0-9]{4})(?:-?([0-9]{2})(?:-?([0-9]{2})(?:[T ](?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:[.][0-9]+)?)?(?:Z|[+-](?:[01][0-9]|2[0-3])(?::?[0-5][0-9])?)?)?)?)?$', ['y', 'm', 'd']) AS p FROM shaped),
dated AS (SELECT k, p, CASE WHEN p.y IN ('', '0000') THEN NULL ELSE try_cast(p.y || '-' || CASE p.m WHEN '' THEN '01' ELSE p.m END || '-' || CASE p.d WHEN '' THEN '01' ELSE p.d END AS DATE) END AS first FROM cut),
moments AS (SELECT k, first, CASE WHEN first IS NULL THEN NULL WHEN p.m = '' THEN make_date(year(first), 12, 31) WHEN p.d = '' THEN last_day(first) ELSE first END AS last, CASE WHEN first IS NULL THEN '' ELSE p.y || CASE p.m WHEN '' THEN '' ELSE '-' || p.m END || CASE p.d WHEN '' THEN '' ELSE '-' || p.d END END AS text FROM dated)"""


def _shape_sql(number: str) -> str:
    parts = {"{y}": f"CAST(1990 + {number} % 40 AS VARCHAR)", "{m}": f"lpad(CAST({number} % 14 AS VARCHAR), 2, '0')", "{d}": f"lpad(CAST({number} % 32 AS VARCHAR), 2, '0')"}
    cases = []
    for i, shape in enumerate(_SHAPES):
        sql = "'" + shape + "'"
        for mark, value in parts.items():
            sql = sql.replace(mark, f"' || {value} || '")
        cases.append(f"WHEN {i} THEN {sql}")
    return f"CASE {number} % {len(_SHAPES)} {' '.join(cases)} END"


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").selectExpr("doc_id AS k", *(f"{_shape_sql(n)} AS {c}".replace("VARCHAR", "STRING") for n, c in (("doc_id", "said"), ("(doc_id * 7 + 3)", "other"))))


def dates_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = dates.moment(F.col("said"))
    return _dates(spark, sf_dir).select("k", m["first"].alias("first"), m["last"].alias("last"), dates.normalized(F.col("said")).alias("text"), dates.exact(F.col("said")).alias("exact"))


def dates_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir).select("k", dates.compared(F.col("said"), F.col("other")).cast("long").alias("sign"))


def dates_extreme(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _dates(spark, sf_dir).groupBy((F.col("k") % 50).alias("g")).agg(F.array_sort(F.collect_list(F.struct("k", "said"))).alias("a"))
    said = F.transform("a", lambda x: x["said"])
    return listed.select("g", F.coalesce(dates.extreme(said, False), F.lit("")).alias("first"), F.coalesce(dates.extreme(said, True), F.lit("")).alias("last"))


def crawl_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _read(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "CASE WHEN doc_id % 3 = 0 THEN 's3://x/CC-MAIN-20' || lpad(CAST(10 + doc_id % 15 AS STRING), 2, '0') || lpad(CAST(doc_id % 14 AS STRING), 2, '0') || lpad(CAST(doc_id % 32 AS STRING), 2, '0') || '010203-1.warc' ELSE 'none' END AS file_path",
        "CASE WHEN doc_id % 4 = 1 THEN NULL ELSE 'CC-MAIN-' || CAST(2008 + doc_id % 18 AS STRING) || '-' || lpad(CAST(doc_id % 55 AS STRING), 2, '0') END AS dump",
    )
    return made.select("doc_id", dates.crawl_date(F.col("file_path"), F.col("dump")).alias("crawled"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with what the raw table lacks: repeated, empty and excluded urls, dates in urls."""
    made = _read(spark, sf_dir, "pages").selectExpr(
        "page_id AS pos",
        """CASE WHEN page_id % 11 = 0 THEN '' WHEN page_id % 13 = 0 THEN 'https://en.Wikipedia.org/wiki/' || page_id
           WHEN page_id % 7 = 0 THEN 'http://host' || (page_id % 5) || '.example.com/a/b' WHEN page_id % 5 = 0 THEN 'https://News.example.org/20' || lpad(CAST(page_id % 26 AS STRING), 2, '0') || '/0' || (1 + page_id % 9) || '/some-old_story.html'
           ELSE url END AS url""",
        r"trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' '), '[ \\t\\n\\r]+', ' ')) AS text",
        "CASE WHEN page_id % 3 = 0 THEN '' ELSE '2014-0' || (1 + page_id % 9) || '-11' END AS crawled",
    )
    return made.withColumn("date", dates.page_date(urls.path(F.col("url")), F.col("crawled")))


_PAGES = r"""pages_ AS (SELECT page_id AS pos,
CASE WHEN page_id % 11 = 0 THEN '' WHEN page_id % 13 = 0 THEN 'https://en.Wikipedia.org/wiki/' || page_id
WHEN page_id % 7 = 0 THEN 'http://host' || (page_id % 5) || '.example.com/a/b' WHEN page_id % 5 = 0 THEN 'https://News.example.org/20' || lpad(CAST(page_id % 26 AS VARCHAR), 2, '0') || '/0' || (1 + page_id % 9) || '/some-old_story.html'
ELSE url END AS url,
trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text,
CASE WHEN page_id % 3 = 0 THEN '' ELSE '2014-0' || (1 + page_id % 9) || '-11' END AS crawled FROM pages),
parts AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1)) AS host,
regexp_extract(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/((?:19|20)[0-9]{2})/(0[1-9]|1[0-2])(?:/|$)', ['y', 'm']) AS ym FROM pages_),
judged0 AS (SELECT *, CASE WHEN ym.y <> '' AND (crawled = '' OR CAST(ym.y || '-' || ym.m || '-01' AS DATE) <= CAST(crawled AS DATE)) THEN ym.y || '-' || ym.m ELSE crawled END AS date,
host = 'wikipedia.org' OR ends_with(host, '.wikipedia.org') AS outside, len(list_filter(string_split(text, ' '), lambda w: w <> '')) < 50 AS short FROM parts),
able AS (SELECT url, min(pos) AS first FROM judged0 WHERE url <> '' AND NOT outside AND NOT short GROUP BY url),
judged AS (SELECT judged0.*, CASE WHEN judged0.url = '' THEN 'no_url' WHEN first < pos THEN 'duplicate_url' WHEN outside THEN 'excluded_domain' WHEN short THEN 'too_short' END AS reason FROM judged0 LEFT JOIN able ON able.url = judged0.url)"""


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _pages(spark, sf_dir).select("pos", urls.hostname(url).alias("host"), urls.path(url).alias("path"), urls.domain(F.concat(F.when(F.col("pos") % 2 == 0, "file:///").otherwise(""), url)).alias("domain"), urls.clean_id(F.concat(F.lit(" <urn:uuid:a:b "), F.col("pos").cast("string"), F.lit("> "))).alias("id"))


def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("pos", "date")


def web_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.judged(_pages(spark, sf_dir)).select("pos", "url", F.coalesce("reason", F.lit("")).alias("reason"))


def web_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.judged(_pages(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def web_kept_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, read = web.kept_limit(web.judged(_pages(spark, sf_dir)), 20)
    return first.select("pos", "url", F.lit(read).cast("long").alias("read"))


def web_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.manifest(web.judged(_pages(spark, sf_dir)))


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept pages as articles; lines are made at sentence ends, which the raw table lacks."""
    kept = web.judged(_pages(spark, sf_dir)).where("reason is null").select(F.col("pos").cast("string").alias("id"), "url", F.replace("text", F.lit(". "), F.lit(".\n")).alias("text"), "date")
    made = web.articles(kept)
    return made.select("id", "title", F.size(F.col("sections")[0]["blocks"]).cast("long").alias("blocks"), F.array_join(F.transform(F.col("sections")[0]["blocks"], lambda b: b["text"]), "|").alias("body"))


def _parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of articles: documents in twenties."""
    return _read(spark, sf_dir, "documents").select(F.concat(F.lit("art:"), (F.col("doc_id") - F.col("doc_id") % (F.col("doc_id") % 7 + 3)).cast("string"), F.lit(":"), F.col("doc_id").cast("string")).alias("id"), "text")


_PARTED = "passages AS (SELECT 'art:' || (doc_id - doc_id % (doc_id % 7 + 3)) || ':' || doc_id AS id, text FROM documents), counts AS (SELECT regexp_extract(id, '^(.*):', 1) AS article, count(*) AS n FROM passages GROUP BY 1)"
_REQUIRED = ("art:12", "art:nowhere", "art:30", "art:12", "art:gone")
_SIZE = 60
_RANKED = f"""{_PARTED}, wanted AS (SELECT DISTINCT unnest({list(_REQUIRED)}) AS article),
listed AS (SELECT list({{'article': article, 'n': n}} ORDER BY sha256('3' || chr(0) || article)[1:16], article) AS a FROM counts WHERE article NOT IN (SELECT article FROM wanted)),
begun AS (SELECT coalesce(sum(n), 0) AS t FROM counts JOIN wanted USING (article)),
walk AS (SELECT list_reduce(a, lambda s, x: {{'t': CASE WHEN s.t < {_SIZE} AND s.t + x.n <= {_SIZE} THEN s.t + x.n ELSE s.t END, 'c': CASE WHEN s.t < {_SIZE} AND s.t + x.n <= {_SIZE} THEN list_append(s.c, x.article) ELSE s.c END, 'n': x.n, 'article': ''}}, {{'t': CAST(t AS BIGINT), 'c': CAST([] AS VARCHAR[]), 'n': CAST(0 AS BIGINT), 'article': ''}}) AS w FROM (SELECT list_transform(a, lambda x: {{'t': CAST(0 AS BIGINT), 'c': CAST([] AS VARCHAR[]), 'n': x.n, 'article': x.article}}) AS a FROM listed), begun),
chosen AS (SELECT article, n, true AS required FROM counts JOIN wanted USING (article) UNION ALL SELECT article, n, false FROM counts WHERE article IN (SELECT unnest(w.c) FROM walk))"""


def article_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.passage_counts(_parted(spark, sf_dir))


def hash_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article_counts(spark, sf_dir).select("article", selection.hash_rank(3, F.col("article")).alias("key"))


def _chosen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    counts = article_counts(spark, sf_dir)
    return counts, *selection.budget_fill(counts, _SIZE, _REQUIRED, 3)


def subset_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir)[1]


def subset_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = _chosen(spark, sf_dir)[2]
    return spark.createDataFrame([(k, a) for k, a in enumerate(missing)], "pos long, article string")


def subset_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.passages_of(_parted(spark, sf_dir), _chosen(spark, sf_dir)[1]).select("id")


def subset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, chosen, missing = _chosen(spark, sf_dir)
    made = selection.subset_manifest(counts, chosen, missing, _SIZE, 3)
    return made.select("articles", "passages", "required_articles", "required_passages", "source_articles", "source_passages", F.col("missing_count").cast("long").alias("missing_count"))


def source_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.available(_read(spark, sf_dir, "documents"))


_SHARES = (selection.Share("src0", 0.5), selection.Share("src1", 0.3), selection.Share("src2", 0.2))
_TOTAL = 60_000


def sample_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of three sources in fixed shares of bytes; texts of this query are cut at 8,192 characters like any others."""
    texts = _read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), "text")
    kept, _ = selection.byte_share_sample(texts, _SHARES, _TOTAL, 5)
    return kept.select("source", "id", F.col("part").cast("long").alias("part"), F.md5(F.col("text").cast("binary")).alias("text"))


def sample_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same draw over whole documents: seed, source and id decide."""
    draw = selection.chance(F.lit("5"), F.col("source"), F.col("doc_id").cast("string"))
    return _read(spark, sf_dir, "documents").where(draw < 0.25).select("source", "doc_id", F.round(draw, 9).alias("draw"))


def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.systematic(_read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_name", 7, 11).select("s_name")


def sample_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"))
    return selection.sample_per_group(rows, ["source"], "path", 3, 4)


def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, ties by event number; every tenth stamp is NULL, every ninth user negative."""
    made = _read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, -F.col("user_id")).otherwise(F.col("user_id")).alias("identifier"), F.when(F.col("event_id") % 10 != 0, F.date_trunc("day", F.col("ts").cast("timestamp_ntz"))).alias("date_modified"), (F.col("event_id") % 3).alias("file_idx"), F.col("event_id").alias("row_idx"))
    return articles.latest_rows(made).select("identifier", "event_id")


def packed_document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), F.col("event_id").alias("pos"), F.col("event_type"))
    return sequences.document_numbers(rows, "seq", "pos", F.col("event_type") == "signup").select("seq", "pos", "doc")


def document_mask_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of turns of a conversation's stretches, which end at every fourth turn, counted for each conversation."""
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"))
    numbered = sequences.document_numbers(rows, "seq", "pos", F.col("pos") % 4 == 3)
    return sequences.mask_pairs(numbered).groupBy("seq").agg(F.count("*").alias("pairs"), F.sum("j").alias("sum_j"))


def running_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), F.col("event_id").alias("pos"), F.col("value"))
    return sequences.running_positions(rows, "seq", "pos", F.col("value") > 20).select("seq", "pos", "position")


def cache_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), (F.col("role") == "user").alias("valid"))
    return sequences.cache_mask(rows, "seq", "pos", "valid").groupBy("seq").agg(F.count("*").alias("pairs"), F.sum("j").alias("sum_j"))


def line_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 100").alias("part"), (F.octet_length("text") + 1).cast("long").alias("size"))
    return sequences.line_starts(rows, "doc_id", "part", F.col("size")).select("doc_id", "start")


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _read(spark, sf_dir, "part").select((F.col("p_partkey") % 200).alias("step")).distinct()
    return steps.select("step", F.round(sequences.rate_factor(F.col("step"), 200, 20, 50, 0.1), 9).alias("factor"), sequences.due(F.col("step"), 25, F.lit(199)).alias("due"))


def loss_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _read(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10).alias("loss"), F.when(F.col("l_linenumber") == 3, -100).otherwise(F.col("l_linenumber")).alias("target"))
    row = evaluation.mean_loss(tokens)
    return row.select("tokens", F.round("total", 4).alias("total"), F.round("mean", 9).alias("mean"))


def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("token"), F.col("l_linenumber").alias("option"), (F.col("l_quantity") / 10).alias("logit"), F.when(F.col("l_orderkey") % 5 == 0, -100).otherwise(1).alias("target"))
    return evaluation.cross_entropy(logits).select("token", F.round("loss", 6).alias("loss"), F.round("z", 6).alias("z"))


def _options(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_linenumber") % 3).alias("option"), (-F.col("l_quantity") / 10).alias("logprob"))
    return evaluation.option_scores(tokens)


def option_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _options(spark, sf_dir).select("item", "option", F.round("score", 6).alias("score"), "tokens")


def choice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = _options(spark, sf_dir).withColumn("score", F.round("score", 6)).withColumn("correct", F.lit(1))
    row = evaluation.choice_metrics(options)
    return row.select("items", F.round("mean_prob", 6).alias("mean_prob"), F.round("accuracy", 9).alias("accuracy"), F.round("answer_log_prob", 6).alias("answer_log_prob"))


def bytes_per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _read(spark, sf_dir, "documents").select("text", words(F.col("text")).alias("tokens"))
    return evaluation.bytes_per_token(texts).select(F.round("bytes_per_token", 6).alias("bytes_per_token"))


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = incremental.windowed_counts(_read(spark, sf_dir, "events"), "1 day")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.sessions(_read(spark, sf_dir, "events"), "6 hours").select("user_id", F.unix_timestamp("start").alias("start"), "n")


def scan_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns and a predicate: both reach the scan."""
    return _read(spark, sf_dir, "documents").where((F.col("lang") == "de") & (F.col("n_chars") > 2000)).select("doc_id", "n_chars")


def source_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").where(~F.coalesce("source", F.lit("")).isin("src1", "src3")).groupBy("source").agg(F.count("*").alias("n"))


def union_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts in one shape, in order of their inputs."""
    a = _read(spark, sf_dir, "documents").select(F.lit(0).alias("file_idx"), F.col("doc_id").alias("row_idx"), F.col("n_chars").alias("score"), F.sha2("text", 256).alias("digest"))
    b = _read(spark, sf_dir, "benchmark").select(F.lit(1).alias("file_idx"), F.col("item_id").alias("row_idx"), F.sha2("text", 256).alias("digest"))
    return a.unionByName(b, allowMissingColumns=True)


def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sources in the order they are first met."""
    first = _read(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first"))
    return first.select("source", F.row_number().over(Window.orderBy("first")).cast("long").alias("place"))


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties read from JSON without a schema."""
    rows = _read(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return rows.select("event_id", F.size(F.json_object_keys(F.to_json("v"))).cast("long").alias("fields"))


def collapsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(collapsed(F.col("text")).cast("binary")).alias("digest"), F.size(words(F.col("text"))).cast("long").alias("words"))


def line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept lines of a text and their words, as pages are judged by."""
    lines = web.lines(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("lines"), web.word_count(lines).cast("long").alias("words"))


def _as_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = web.lines(F.col("text"))
    blocks = F.transform(lines, lambda x: F.struct(x.alias("text"), F.lit(False).alias("item")))
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("").alias("title"), F.lit("").alias("url"), F.lit("").alias("date"), F.array(F.struct(F.lit("").alias("name"), blocks.alias("blocks"))).alias("sections"))


def passages_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(_as_articles(spark, sf_dir)).select("id", "text")


def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences("text")).alias("n", "sentence"))


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariant that SQL can check too: chunks of a text joined are the text, each is short enough, all but the last end a line or are full."""
    parts = _read(spark, sf_dir, "documents").select("doc_id", selection.chunked("text").alias("p"))
    return parts.select("doc_id", F.md5(F.array_join("p", "").cast("binary")).alias("joined"), F.forall("p", lambda x: F.length(x) <= 8192).alias("short"))


def wikitext_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents marked up as wiki pages: lines are headings, items or paragraphs by turns."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 2, F.concat(F.lit("== "), F.substring(x, 1, 12), F.lit(" =="))).when(i % 5 == 3, F.concat(F.lit("* [[File:a|b]]'''"), x, F.lit("'''{{x|{{y}}}}"))).otherwise(F.concat(x, F.lit("<ref name=a>z</ref>"))))
    pages = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("Page "), F.col("doc_id").cast("string")).alias("title"), F.array_join(line, "\n").alias("text"))
    found = articles.wikitext_articles(pages, "2024-01-01")
    return found.select("id", "url", F.posexplode("sections").alias("n", "s")).select("id", "url", "n", "s.name", F.size("s.blocks").alias("blocks"))


def vocabulary_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 merges over all texts."""
    merges, _ = vocabulary.train_spread(vocabulary.piece_counts(_read(spark, sf_dir, "documents")), 256 + 100 + 15, 15)
    return spark.createDataFrame([(k, a.hex(), b.hex()) for k, (a, b) in enumerate(merges)], "n long, first string, second string")


def piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.piece_counts(_read(spark, sf_dir, "documents"))


def disambiguations(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _as_articles(spark, sf_dir).withColumn("title", F.when(F.col("id").cast("long") % 9 == 0, "X (disambiguation)").otherwise("X"))
    return made.select("id", passages.disambiguation(F.col("title"), F.col("sections")).alias("found"))


_FUNCTIONS = (dates_normalized, dates_compared, dates_extreme, crawl_dates, url_parts, page_dates, web_drop_reasons, web_reason_counts, web_kept_limit, web_manifest, page_articles, article_counts, hash_rank, subset_select, subset_missing, subset_passages, subset_manifest, source_bytes, sample_bernoulli, sample_documents, systematic_sample, sample_groups, latest_rows, packed_document_ids, document_mask_pairs, running_positions, cache_mask, line_starts, lr_schedule, loss_mean, cross_entropy, option_scores, choice_metrics, bytes_per_token, window_counts, user_sessions, scan_projection, source_exclusion, union_texts, distinct_first, json_fields, collapsed_lines, line_words, passages_chunked, split_sentences, chunk_texts, wikitext_sections, vocabulary_merges, piece_counts, disambiguations)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
_CHANCE = "CAST(('0x' || substr(sha256({x}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"
ORACLE_SQL = {
    "dates_normalized": f"WITH texts AS (SELECT doc_id AS k, {_shape_sql('doc_id')} AS said FROM documents), {_PARSED} SELECT k, first, last, text, coalesce(first = last, false) AS exact FROM moments",
    "dates_compared": f"""WITH texts AS (SELECT doc_id * 2 AS k, {_shape_sql('doc_id')} AS said FROM documents UNION ALL SELECT doc_id * 2 + 1, {_shape_sql('(doc_id * 7 + 3)')} FROM documents), {_PARSED}
SELECT a.k // 2 AS k, CAST(CASE WHEN a.first > b.last THEN 1 WHEN a.last < b.first THEN -1 ELSE 0 END AS BIGINT) AS sign FROM moments a JOIN moments b ON a.k % 2 = 0 AND b.k = a.k + 1""",
    "dates_extreme": f"""WITH texts AS (SELECT doc_id AS k, {_shape_sql('doc_id')} AS said FROM documents), {_PARSED},
listed AS (SELECT k % 50 AS g, list({{'t': text, 'f': first, 'l': last}} ORDER BY k) FILTER (text <> '') AS a FROM moments GROUP BY 1)
SELECT g, coalesce(list_reduce(a, lambda b, x: CASE WHEN x.l < b.f THEN x ELSE b END).t, '') AS first, coalesce(list_reduce(a, lambda b, x: CASE WHEN x.f > b.l THEN x ELSE b END).t, '') AS last FROM listed""",
    "crawl_dates": """WITH made AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN try_cast('20' || lpad(CAST(10 + doc_id % 15 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 32 AS VARCHAR), 2, '0') AS DATE) END AS stamp,
CASE WHEN doc_id % 4 = 1 THEN NULL ELSE 2008 + doc_id % 18 END AS y, doc_id % 55 AS w FROM documents),
weeks AS (SELECT *, CASE WHEN y IS NOT NULL AND w BETWEEN 1 AND weekofyear(make_date(y, 12, 28)) THEN date_trunc('week', make_date(y, 1, 4)) + to_days(CAST(7 * (w - 1) + 3 AS INTEGER)) END AS thursday FROM made)
SELECT doc_id, coalesce(strftime(stamp, '%Y-%m-%d'), strftime(thursday, '%Y-%m'), '') AS crawled FROM weeks""",
    "url_parts": f"WITH {_PAGES} SELECT pos, host, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path, CASE WHEN pos % 2 = 0 THEN 'local' ELSE host END AS domain, 'a-b-' || pos AS id FROM judged",
    "page_dates": f"WITH {_PAGES} SELECT pos, date FROM judged",
    "web_drop_reasons": f"WITH {_PAGES} SELECT pos, url, coalesce(reason, '') AS reason FROM judged",
    "web_reason_counts": f"WITH {_PAGES} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM judged GROUP BY 1",
    "web_kept_limit": f"WITH {_PAGES}, first AS (SELECT pos, url FROM judged WHERE reason IS NULL ORDER BY pos LIMIT 20) SELECT pos, url, (SELECT count(*) FROM judged WHERE pos <= (SELECT max(pos) FROM first)) AS read FROM first",
    "web_manifest": f"""WITH {_PAGES}, kept AS (SELECT * FROM judged WHERE reason IS NULL),
walk AS (SELECT list({{'t': date, 'f': CAST(date || CASE len(date) WHEN 7 THEN '-01' ELSE '' END AS DATE), 'l': CASE len(date) WHEN 7 THEN last_day(CAST(date || '-01' AS DATE)) ELSE CAST(date AS DATE) END}} ORDER BY pos) AS a FROM kept WHERE date <> '')
SELECT (SELECT count(*) FROM judged) AS read, (SELECT count(*) FROM kept) AS kept, (SELECT count(*) FROM judged WHERE reason = 'no_url') AS no_url, (SELECT count(*) FROM judged WHERE reason = 'duplicate_url') AS duplicate_url, (SELECT count(*) FROM judged WHERE reason = 'excluded_domain') AS excluded_domain, (SELECT count(*) FROM judged WHERE reason = 'too_short') AS too_short,
(SELECT count(DISTINCT host) FROM kept) AS domains, (SELECT count(*) FROM kept WHERE date = '') AS undated, (SELECT count(*) FROM kept WHERE date <> '' AND date <> crawled) AS from_url,
list_reduce(a, lambda b, x: CASE WHEN x.l < b.f THEN x ELSE b END).t AS first_date, list_reduce(a, lambda b, x: CASE WHEN x.f > b.l THEN x ELSE b END).t AS last_date FROM walk""",
    "article_counts": f"WITH {_PARTED} SELECT article, n FROM counts",
    "hash_rank": f"WITH {_PARTED} SELECT article, sha256('3' || chr(0) || article)[1:16] AS key FROM counts",
    "subset_select": f"WITH {_RANKED} SELECT article, n, required FROM chosen",
    "subset_missing": f"WITH {_PARTED}, w AS (SELECT unnest({list(dict.fromkeys(_REQUIRED))}) AS article, unnest(range({len(set(_REQUIRED))})) AS p) SELECT row_number() OVER (ORDER BY p) - 1 AS pos, article FROM w WHERE article NOT IN (SELECT article FROM counts)",
    "subset_passages": f"WITH {_RANKED} SELECT id FROM passages WHERE regexp_extract(id, '^(.*):', 1) IN (SELECT article FROM chosen)",
    "subset_manifest": f"WITH {_RANKED} SELECT count(*) AS articles, CAST(sum(n) AS BIGINT) AS passages, count(*) FILTER (required) AS required_articles, CAST(coalesce(sum(n) FILTER (required), 0) AS BIGINT) AS required_passages, (SELECT count(*) FROM counts) AS source_articles, (SELECT CAST(sum(n) AS BIGINT) FROM counts) AS source_passages, (SELECT count(*) FROM wanted WHERE article NOT IN (SELECT article FROM counts)) AS missing_count FROM chosen",
    "source_bytes": "SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS available, count(*) AS documents FROM documents GROUP BY source",
    "sample_documents": f"SELECT source, doc_id, round({_CHANCE.format(x=chr(39) + '5/' + chr(39) + ' || source || ' + chr(39) + '/' + chr(39) + ' || doc_id')}, 9) AS draw FROM documents WHERE {_CHANCE.format(x=chr(39) + '5/' + chr(39) + ' || source || ' + chr(39) + '/' + chr(39) + ' || doc_id')} < 0.25",
    "sample_groups": "SELECT source, path FROM (SELECT source, CAST(doc_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY source ORDER BY sha256('4' || chr(0) || source || '/' || doc_id)[1:16], CAST(doc_id AS VARCHAR)) AS n FROM documents) WHERE n <= 3",
    "latest_rows": "SELECT identifier, event_id FROM (SELECT CASE WHEN event_id % 9 = 0 THEN -user_id ELSE user_id END AS identifier, event_id, row_number() OVER (PARTITION BY CASE WHEN event_id % 9 = 0 THEN -user_id ELSE user_id END ORDER BY CASE WHEN event_id % 10 <> 0 THEN date_trunc('day', ts) ELSE TIMESTAMP '1970-01-01' END DESC, event_id % 3 DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND identifier >= 0",
    "packed_document_ids": "SELECT user_id AS seq, event_id AS pos, CAST(coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS doc FROM events",
    "document_mask_pairs": """WITH n AS (SELECT conv_id AS seq, turn AS pos, coalesce(sum(CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS doc FROM conversations)
SELECT a.seq, count(*) AS pairs, CAST(sum(b.pos) AS BIGINT) AS sum_j FROM n a JOIN n b ON a.seq = b.seq AND a.doc = b.doc AND b.pos <= a.pos GROUP BY a.seq""",
    "running_positions": "SELECT user_id AS seq, event_id AS pos, CAST(greatest(coalesce(sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id), 0) - 1, 0) AS BIGINT) AS position FROM events",
    "cache_mask": "SELECT a.conv_id AS seq, count(*) AS pairs, CAST(sum(b.turn) AS BIGINT) AS sum_j FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND ((b.role = 'user' AND b.turn <= a.turn) OR a.turn = b.turn) GROUP BY 1",
    "line_starts": "SELECT doc_id, CAST(coalesce(sum(strlen(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents",
    "lr_schedule": "SELECT DISTINCT p_partkey % 200 AS step, round(CASE WHEN p_partkey % 200 < 20 THEN (p_partkey % 200 + 1) / 20.0::DOUBLE WHEN p_partkey % 200 < 150 THEN 1 ELSE 0.1::DOUBLE + 0.9::DOUBLE * (1 - sqrt((p_partkey % 200 - 150) / 50.0::DOUBLE)) END, 9) AS factor, p_partkey % 25 = 0 OR p_partkey % 200 = 199 AS due FROM part",
    "loss_mean": "SELECT count(*) AS tokens, round(sum(l_quantity / 10), 4) AS total, round(sum(l_quantity / 10) / count(*), 9) AS mean FROM lineitem WHERE l_linenumber <> 3",
    "cross_entropy": "WITH s AS (SELECT l_orderkey AS token, ln(sum(exp(l_quantity / 10))) AS z, max(l_quantity / 10) FILTER (l_linenumber = 1) AS own FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1) SELECT token, round(z - own, 6) AS loss, round(z * z, 6) AS z FROM s",
    "option_scores": "SELECT l_orderkey AS item, l_linenumber % 3 AS option, round(sum(-l_quantity / 10), 6) AS score, count(*) AS tokens FROM lineitem GROUP BY 1, 2",
    "choice_metrics": """WITH o AS (SELECT l_orderkey AS item, l_linenumber % 3 AS option, round(sum(-l_quantity / 10), 6) AS score, count(*) AS tokens FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, exp(score - max(score) OVER (PARTITION BY item)) AS w, row_number() OVER (PARTITION BY item ORDER BY score DESC, option) AS r FROM o),
i AS (SELECT item, sum(w) FILTER (option = 1) / sum(w) AS p, max(CASE WHEN r = 1 AND option = 1 THEN 1 ELSE 0 END) AS ok, sum(score / tokens) FILTER (option = 1) AS a FROM w GROUP BY item)
SELECT count(*) AS items, round(avg(p), 6) AS mean_prob, round(avg(ok), 9) AS accuracy, round(avg(a), 6) AS answer_log_prob FROM i""",
    "bytes_per_token": "SELECT round(sum(strlen(text)) / sum(len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> ''))), 6) AS bytes_per_token FROM documents",
    "window_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "user_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM n GROUP BY user_id, s",
    "scan_projection": "SELECT doc_id, n_chars FROM documents WHERE lang = 'de' AND n_chars > 2000",
    "source_exclusion": "SELECT source, count(*) AS n FROM documents WHERE coalesce(source, '') NOT IN ('src1', 'src3') GROUP BY source",
    "union_texts": "SELECT 0 AS file_idx, doc_id AS row_idx, n_chars AS score, sha256(text) AS digest FROM documents UNION ALL SELECT 1, item_id, NULL, sha256(text) FROM benchmark",
    "distinct_first": "SELECT source, row_number() OVER (ORDER BY min(doc_id)) AS place FROM documents GROUP BY source",
    "json_fields": "SELECT event_id, CAST(len(json_keys(props)) AS BIGINT) AS fields FROM events",
    "collapsed_lines": "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) AS digest, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) AS words FROM documents",
    "line_words": "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) AS words FROM documents",
    "chunk_texts": "SELECT doc_id, md5(text) AS joined, true AS short FROM documents",
    "disambiguations": "SELECT CAST(doc_id AS VARCHAR) AS id, doc_id % 9 = 0 OR regexp_matches(text[1:300], '(?i)\\bmay (also )?refer to\\b') AS found FROM documents",
}
