"""Registered queries that write and read back, stream, or chunk by pages, each over a whole table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import markup
from quarry.functions import text as X
from quarry.operators import analytics, chunking
from quarry.plans import answer
from quarry.session import scratch_path, spread, table
from quarry.sources import files
from quarry.sources.tables import DocumentTables
from quarry.streaming import cache, lookback, requests

SHARDS, TTL = 7, 3600


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


def _pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), F.col("url").alias("title"), "html")


def _lines(spark, sf_dir):
    """Documents whose pages are their lines."""
    return _docs(spark, sf_dir).select("doc_id", F.col("source").alias("title"), F.split(F.coalesce("text", F.lit("")), "\n").alias("pages"))


# Caches and look-backs ---------------------------------------------------------------------------------------------------


def _times(frame):
    return frame.select("id", "query", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


def exact_cache_misses(spark, sf_dir):
    return _times(cache.misses(analytics.request_log(table(spark, sf_dir, "events")), TTL))


def exact_cache_stream(spark, sf_dir):
    return _times(requests.run_to_end(cache.misses(requests.read_log(spark, sf_dir), TTL), "append"))


def semantic_cache_stream(spark, sf_dir):
    """Vectors as questions, a minute apart, of the scope of their label."""
    vectors = requests.read_stream(spark, sf_dir, "embeddings.parquet").where("vec_id is not null and embedding is not null")
    asked = vectors.select(F.col("label").cast("string").alias("scope"), F.col("vec_id").alias("id"), F.timestamp_seconds(F.col("vec_id") * 60).alias("at"), "embedding")
    asked = asked.withColumn("vec", F.col("embedding").cast("array<double>")).drop("embedding")
    return requests.run_to_end(cache.semantic_cache(asked, 0.25, 86_400, 500), "append")


def look_backs(spark, sf_dir):
    path = scratch_path(spark, "hourly")
    lookback.keep_hourly(requests.read_log(spark, sf_dir), path, scratch_path(spark, "hourly-state"))
    return lookback.look_backs(lookback.read_hourly(spark, path))


# Shards, vectors, tables -------------------------------------------------------------------------------------------------


def shard_files(spark, sf_dir):
    """Documents with their lines as chunks, written in shards, one of them again after a write that broke off."""
    path, shard = scratch_path(spark, "shards"), F.pmod("doc_id", F.lit(SHARDS)).cast("int").alias("shard")
    docs = _docs(spark, sf_dir).where("doc_id is not null")
    chunks = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("chunk_index", "text"), shard)
    files.write_shards_of(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", shard), chunks, path)
    files.write_shard(docs.where("doc_id % 7 = 3").select(F.col("doc_id").cast("string").alias("doc_id")), chunks.where("shard = 3").drop("shard"), path, 3)
    done = files.finished_shards(spark, path)
    counts = files.read_shard_chunks(spark, path).groupBy("shard").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("letters"))
    documents = files.read_shard_docs(spark, path).groupBy("shard").agg(F.count(F.lit(1)).alias("documents"))
    return done.join(documents, "shard").join(counts, "shard")


def vector_files(spark, sf_dir):
    path = scratch_path(spark, "vectors")
    vectors = table(spark, sf_dir, "embeddings").where("embedding is not null")
    files.write_vectors(vectors.select(F.col("vec_id").cast("string").alias("doc_id"), F.coalesce("label", F.lit(0)).alias("chunk_index"), F.col("embedding").alias("vec")), path)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return files.read_vectors(spark, path).select("doc_id", "chunk_index", F.size("vec").alias("size"), F.round(total, 6).alias("total"))


def replaced_documents(spark, sf_dir):
    """All documents stored with their lines as chunks; then every third replaced by its first line."""
    docs = _docs(spark, sf_dir).where("doc_id is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tables = DocumentTables(spark, scratch_path(spark, "tables"), "doc_id string, sha256 string", "doc_id string, chunk_index int, text string", buckets=16)
    rows = lambda frame: (frame.select("doc_id", F.sha2("text", 256).alias("sha256")), frame.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text")))
    tables.replace(*rows(docs))
    tables.replace(*rows(docs.where("doc_id % 3 = 0").withColumn("text", F.substring_index("text", "\n", 1))))
    chunks = tables.chunks().groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("letters"))
    return tables.docs().join(chunks, "doc_id")


# Pages -------------------------------------------------------------------------------------------------------------------


def page_bytes(spark, sf_dir):
    """Pages as bytes under an XML declaration of another charset, read back as markup."""
    declared = F.concat(F.lit(" <?xml version='1.0' encoding='iso-8859-1'?>"), "html")
    return _pages(spark, sf_dir).select("doc_id", F.sha2(files.page_of(F.encode(declared, "UTF-8")), 256).alias("sha256"))


def ingested_pages(spark, sf_dir):
    """Pages as a stream into bucketed tables, and the same pages again, which are found unchanged."""
    pages = requests.read_stream(spark, sf_dir, "pages.parquet").select(F.col("page_id").cast("string").alias("doc_id"), F.col("url").alias("title"), "html")
    docs, chunks = "doc_id string, title string, sha256 string, status string, chunk_count long", "doc_id string, chunk_index int, section string, label string, text string, tokens int"
    tables = DocumentTables(spark, scratch_path(spark, "ingested"), docs, chunks, buckets=16)
    for _ in range(2):
        answer.ingest_stream(pages, tables, scratch_path(spark, "ingest-state"))
    stored = tables.chunks().groupBy("doc_id").agg(F.count(F.lit(1)).alias("stored"))
    joined = tables.docs().join(stored, "doc_id", "left")
    return joined.select("doc_id", "sha256", (F.coalesce("stored", F.lit(0)) == F.col("chunk_count")).alias("whole"))


def marked_pages(spark, sf_dir):
    """Pages marked up by element ids: of each text of the table of pages, a recital, an article and an annex."""
    page = F.format_string(
        f"<div class='{markup.MARKER_CLASS}'><div id='rct_1'><p>(1) %s</p></div><div id='art_1'><p>Article 1</p><p>%s</p></div><div id='anx_I'><p>ANNEX I</p><p>Some of it</p><p>1 2 3</p></div></div>",
        "title", F.regexp_replace("title", "[^a-zA-Z]+", " "),
    )
    return markup.pieces(_pages(spark, sf_dir).where("title is not null").select("doc_id", page.alias("html")))


def paged_chunks(spark, sf_dir):
    return chunking.paged_chunks(_lines(spark, sf_dir))


def passage_ranges(spark, sf_dir):
    """Where a quote of 80 letters from the middle of each text stands in it."""
    docs = _docs(spark, sf_dir)
    quote = F.substring("text", F.floor(F.length("text") / 2).cast("int") + 1, F.lit(80))
    return docs.select("doc_id", X.passage_range(F.col("text"), quote).alias("r")).select("doc_id", "r.from", "r.to")


QUERIES = {
    f.__name__: f
    for f in (
        exact_cache_misses, exact_cache_stream, semantic_cache_stream, look_backs, shard_files, vector_files, replaced_documents, page_bytes, ingested_pages, marked_pages,
        paged_chunks, passage_ranges,
    )
}

_MISSES_SQL = f"""WITH RECURSIVE log AS (SELECT event_id AS id, 'q' || user_id AS query, ts AS created_at FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  m AS (SELECT query, min(created_at) AS stored FROM log GROUP BY 1
    UNION ALL SELECT m.query, min(l.created_at) FROM m JOIN log l ON l.query = m.query AND l.created_at >= m.stored + INTERVAL {TTL} SECOND GROUP BY m.query, m.stored)
  SELECT min(id) AS id, query, created_at FROM log JOIN m USING (query) WHERE created_at = stored GROUP BY query, created_at"""
_EDGE_SQL = "round(CASE WHEN {0} > 0 THEN pow(2.0, ({0} - 100000 + 1) / 64.0) WHEN {0} < 0 THEN -pow(2.0, (-{0} - 100000) / 64.0) ELSE 0 END, 2)"

ORACLES = {
    "exact_cache_misses": _MISSES_SQL,
    "exact_cache_stream": _MISSES_SQL,
    "look_backs": f"""WITH log AS (SELECT date_trunc('hour', ts) AS hour, event_type, value AS v, json_extract_string(props, '$.k')::BIGINT AS k,
          CASE WHEN value > 0 THEN floor(log2(value) * 64)::BIGINT + 100000 WHEN value < 0 THEN -floor(log2(-value) * 64)::BIGINT - 100000 WHEN value = 0 THEN 0 END AS bin FROM events),
        b AS (SELECT hours, l.* FROM log l, (VALUES (1), (24), (168)) h(hours) WHERE hour > (SELECT max(hour) FROM log) - hours * INTERVAL 1 HOUR),
        t AS (SELECT hours, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS cache_hits, round(avg(v), 1) AS avg_ms,
          round(min(v), 1) AS min_ms, round(max(v), 1) AS max_ms, coalesce(sum(k), 0)::BIGINT AS tokens_input, coalesce(sum(2 * k), 0)::BIGINT AS tokens_output FROM b GROUP BY 1),
        r AS (SELECT hours, bin, row_number() OVER (PARTITION BY hours ORDER BY v) AS n, count(*) OVER (PARTITION BY hours) AS c FROM b WHERE v IS NOT NULL),
        p AS (SELECT hours, min(bin) FILTER (n >= ceil(c * 0.5)) AS b50, min(bin) FILTER (n >= ceil(c * 0.95)) AS b95 FROM r GROUP BY 1)
        SELECT hours, requests, errors, cache_hits, avg_ms, min_ms, max_ms, {_EDGE_SQL.format("b50")} AS p50_ms, {_EDGE_SQL.format("b95")} AS p95_ms, tokens_input, tokens_output,
          round(tokens_input / 1e6 * {X.PRICE_IN} + tokens_output / 1e6 * {X.PRICE_OUT}, 6) AS cost_usd FROM t LEFT JOIN p USING (hours)""",
    "shard_files": f"""WITH c AS (SELECT (doc_id % {SHARDS})::INTEGER AS shard, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL)
        SELECT shard, count(*) AS documents, sum(len(lines))::BIGINT AS chunks, sum(list_sum(list_transform(lines, lambda x: length(x))))::BIGINT AS letters FROM c GROUP BY 1""",
    "vector_files": """SELECT vec_id::VARCHAR AS doc_id, coalesce(label, 0) AS chunk_index, len(embedding)::INTEGER AS size, round(list_reduce(embedding::DOUBLE[], lambda a, x: a + x, 0.0::DOUBLE), 6) AS total
        FROM embeddings WHERE embedding IS NOT NULL""",
    "replaced_documents": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN string_split(coalesce(text, ''), chr(10))[1] ELSE coalesce(text, '') END AS t FROM documents WHERE doc_id IS NOT NULL)
        SELECT doc_id::VARCHAR AS doc_id, sha256(t) AS sha256, len(string_split(t, chr(10)))::BIGINT AS chunks, list_sum(list_transform(string_split(t, chr(10)), lambda x: length(x)))::BIGINT AS letters FROM d""",
    "page_bytes": "SELECT page_id AS doc_id, sha256(html) AS sha256 FROM pages",
    "ingested_pages": "SELECT page_id::VARCHAR AS doc_id, sha256('chunker-1' || coalesce('|' || html, '')) AS sha256, true AS whole FROM pages",
    "marked_pages": """WITH u AS (SELECT page_id AS doc_id, regexp_replace(trim(url), '\\s+', ' ', 'g') AS url, trim(regexp_replace(url, '[^a-zA-Z]+', ' ', 'g')) AS words FROM pages WHERE url IS NOT NULL)
        SELECT doc_id, 0 AS place, 'preamble' AS section, 'Recitals' AS label, '(1) ' || url AS body FROM u UNION ALL
        SELECT doc_id, 1, 'article', '', 'Article 1' || chr(10) || words FROM u UNION ALL SELECT doc_id, 2, 'annex', 'ANNEX I Some of it', '1 2 3' FROM u""",
}
