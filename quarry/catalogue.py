"""Registered queries of the engine, each over a whole table, and the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import catalogue_lists, catalogue_sinks
from quarry.functions import text as X
from quarry.functions import vectors as V
from quarry.operators import analytics, catalog, chunking, evaluation, ingest, search
from quarry.session import materialize, spread, table
from quarry.streaming import requests

HOURS = 168
#: Questions are the vectors whose id this divides.
EVERY = 50
K = 10


# Stand-ins for the tables of a live system -------------------------------------------------------------------------------


def _log(spark, sf_dir):
    return analytics.last_hours(analytics.request_log(table(spark, sf_dir, "events")), HOURS)


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _questions(spark, sf_dir):
    chosen = _vectors(spark, sf_dir).where(F.col("id") % EVERY == 0)
    return chosen.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"), F.col("label").alias("q_label"))


LOG_SQL = f"""log AS (SELECT event_id AS id, ts AS created_at, 'q' || user_id AS query, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
  value AS latency_ms, event_type = 'view' AS cache_hit, json_extract_string(props, '$.k')::BIGINT AS tokens_input,
  json_extract_string(props, '$.k')::BIGINT * 2 AS tokens_output, props AS stages FROM events
  WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {HOURS} HOURS)"""
CATALOGUE_SQL = """cat AS (SELECT doc_id::VARCHAR AS doc_id, string_split(text, chr(10))[1] AS title, source AS collection, lang AS document_type,
  DATE '2020-01-01' + (doc_id % 365)::INTEGER AS publication_date, greatest(1, ceil(n_chars / 2000.0))::BIGINT AS page_count,
  greatest(1, ceil(n_chars / 1600.0))::BIGINT AS chunk_count FROM documents)"""
SCORES_SQL = f"""q AS (SELECT vec_id AS q_id, embedding AS q_vec, label AS q_label FROM embeddings WHERE vec_id % {EVERY} = 0),
scored AS (SELECT q_id, q_label, vec_id AS id, label, round(list_dot_product(embedding::DOUBLE[], q_vec::DOUBLE[]), 6) AS score FROM embeddings, q WHERE vec_id <> q_id),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id))::INTEGER AS rank FROM scored)"""


# Analytics ---------------------------------------------------------------------------------------------------------------


def latency_totals(spark, sf_dir):
    return analytics.totals(_log(spark, sf_dir))


def hourly_series(spark, sf_dir):
    return analytics.hourly(_log(spark, sf_dir))


def stage_percentiles(spark, sf_dir):
    return analytics.stages(_log(spark, sf_dir))


def cache_summary(spark, sf_dir):
    return analytics.cache_summary(_log(spark, sf_dir))


def slowest_requests(spark, sf_dir):
    return analytics.slowest(_log(spark, sf_dir))


def repeated_questions(spark, sf_dir):
    return analytics.repeated_questions(_log(spark, sf_dir))


def rate_limit(spark, sf_dir):
    return analytics.rate_limited(analytics.request_log(table(spark, sf_dir, "events")), 3)


def request_outcomes(spark, sf_dir):
    return analytics.outcomes(_log(spark, sf_dir))


def date_buckets(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("now"))
    bucket = X.date_bucket(F.col("ts"), F.col("now"))
    return events.join(F.broadcast(newest)).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def cache_eviction(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("scope"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    now = events.agg((F.max("at") + F.expr("INTERVAL 1 SECOND")).alias("now"))
    return search.evict(events.join(F.broadcast(now)), F.col("now"), 7 * 86400, 200).select("scope", "id")


def stream_hourly(spark, sf_dir):
    out = requests.run_to_end(requests.hourly_stream(requests.read_log(spark, sf_dir)))
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


# Catalogue and ingest ----------------------------------------------------------------------------------------------------


def corpus_overview(spark, sf_dir):
    return catalog.corpus_overview(catalog.catalogue(_docs(spark, sf_dir)), table(spark, sf_dir, "embeddings"))


def document_page(spark, sf_dir):
    return catalog.page(catalog.catalogue(_docs(spark, sf_dir)), "the on", None, 20, 10).select("doc_id", "title", "collection", F.col("publication_date").cast("string").alias("publication_date"))


def collection_counts(spark, sf_dir):
    return catalog.collections(catalog.catalogue(_docs(spark, sf_dir)))


def document_detail(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    return catalog.detail(catalog.catalogue(_docs(spark, sf_dir)), "7", labels).select("doc_id", "collection", "has_file")


def content_hash_dupes(spark, sf_dir):
    return ingest.content_classes(_docs(spark, sf_dir))


def change_detection(spark, sf_dir):
    new = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"))
    stored = new.where("doc_id % 2 = 0").withColumn("sha256", F.when(F.col("doc_id") % 6 == 0, F.lit("old")).otherwise(F.col("sha256")))
    return ingest.changed(new, stored)


def replace_by_key(spark, sf_dir):
    old = _docs(spark, sf_dir).select("doc_id", "lang", "n_chars")
    new = old.where("doc_id % 3 = 0").withColumn("n_chars", F.col("n_chars") + 1)
    return ingest.replace_by_key(old, new, "doc_id")


def status_counts(spark, sf_dir):
    return ingest.status_counts(_docs(spark, sf_dir).select(X.text_status(F.col("text"), F.lit(1)).alias("status")))


def topic_lists(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    found = docs.select(F.col("source").alias("celex"), F.concat(F.lit("http://x/"), "lang").alias("type"), F.col("doc_id").alias("date"), F.lit("t").alias("title"), F.lit("u").alias("pdf_url"))
    topics = docs.select(F.col("source").alias("celex"), F.col("lang").alias("topic"))
    return ingest.act_list(found, topics).select("celex", "type", "date", F.array_join("topics", "|").alias("topics"))


def chunk_stats(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    chunks = docs.select(X.token_count(F.col("text")).alias("tokens"))
    return ingest.chunk_statistics(docs.select(X.text_status(F.col("text"), F.lit(1)).alias("status")), chunks, 512)


# Text --------------------------------------------------------------------------------------------------------------------


def letters_normalise(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.letters(F.col("text")), 256).alias("digest"))


def text_clean(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.clean_page(F.col("text")), 256).alias("digest"))


def text_quality(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.text_status(F.col("text"), F.lit(1)).alias("status"), X.mostly_numbers(F.col("text")).alias("mostly_numbers"))


def pii_mask(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.mask_pii(F.col("text")), 256).alias("digest"), *(c.alias(f"n_{k}") for k, c in X.count_pii(F.col("text")).items()))


def guard_flags(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", X.looks_injected(F.col("text")).alias("injected"), X.looks_harmful(F.col("text")).alias("harmful"), F.sha2(X.sanitise(F.col("text")), 256).alias("digest")
    )


def probe_slices(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(X.probes(X.letters(F.col("text"))), "|").alias("probes"))


def conversation_titles(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", X.conversation_title(F.col("text")).alias("title"))


def citation_parse(spark, sf_dir):
    answer = F.concat(F.lit("See ["), F.col("doc_id") % 5, F.lit("] and ["), F.col("doc_id") % 3, F.lit(", "), F.col("doc_id") % 5, F.lit("]."))
    cited = _docs(spark, sf_dir).select("doc_id", F.posexplode(X.cited_numbers(answer)).alias("place", "n"))
    return cited.select("doc_id", F.col("place").cast("long").alias("place"), F.col("n").cast("long").alias("n"))


def pack_lines(spark, sf_dir):
    packed = chunking.pack(F.filter(F.split("text", "\n"), lambda x: x != ""), 1600)
    groups = _docs(spark, sf_dir).select("doc_id", F.posexplode(packed).alias("place", "text"))
    return groups.select("doc_id", F.col("place").cast("long").alias("place"), F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("digest"))


def fixed_chunks(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("pages"))
    return chunking.fixed_chunks(docs)


def act_pieces(spark, sf_dir):
    return chunking.pieces(_docs(spark, sf_dir).select("doc_id", "text"))


def html_chunks(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), F.col("url").alias("title"), "html")
    return chunking.html_chunks(pages)


# Retrieval and its evaluation ------------------------------------------------------------------------------------------------


def knn_exact(spark, sf_dir):
    return search.search_native(_vectors(spark, sf_dir), _questions(spark, sf_dir), K)


def knn_blocks(spark, sf_dir):
    return search.search_exact(_vectors(spark, sf_dir), _questions(spark, sf_dir), K)


def knn_capped(spark, sf_dir):
    found = search.search_capped(_vectors(spark, sf_dir), _questions(spark, sf_dir), F.col("label") < 5, 1, 6)
    return found.select("q_id", "id", "score", "rank", "label")


def hit_mrr(spark, sf_dir):
    questions = _questions(spark, sf_dir)
    ranked = search.search_exact(_vectors(spark, sf_dir), questions, 100).join(_vectors(spark, sf_dir).select("id", "label"), "id")
    both = ranked.join(F.broadcast(questions.select("q_id", "q_label")), "q_id")
    return evaluation.hit_and_mrr(evaluation.first_ranks(questions, both, F.col("label") == F.col("q_label")), (6, 20, 50, 100), 6)


def recall_at_10(spark, sf_dir):
    """Recall of both indexes by their setting; for graphs also the share of vectors that a search scores."""
    vectors, questions = _vectors(spark, sf_dir).select("id", "vec"), _questions(spark, sf_dir)
    truth = materialize(search.search_exact(vectors, questions, 10), "truth")
    lists, graphs = search.InvertedLists(vectors, lists=16), search.GraphIndex(vectors)
    each = []
    for probes in (1, 4, 16):
        found = evaluation.recall_at(lists.search(questions, 10, probes), truth, 10)
        each.append(found.select(F.lit("lists").alias("kind"), F.lit(probes).alias("setting"), "recall", F.lit(None).cast("double").alias("scored")))
    for ef in (10, 20, 40):
        scored = graphs.work(questions, ef).agg(F.round(F.avg(F.col("scored") / F.col("vectors")), 4).alias("scored"))
        found = evaluation.recall_at(graphs.search(questions, 10, ef), truth, 10).crossJoin(scored)  # one row by one
        each.append(found.select(F.lit("graphs").alias("kind"), F.lit(ef).alias("setting"), "recall", "scored"))
    return reduce(DataFrame.union, each)


def semantic_cache_hits(spark, sf_dir):
    vectors = _vectors(spark, sf_dir).withColumn("scope", F.col("label"))
    newest = search.evict(vectors.where("id % 2 = 0").withColumn("at", F.timestamp_seconds("id")), F.timestamp_seconds(F.lit(0)), 3600, 2000)
    return search.cache_hits(vectors.where("id % 2 = 1"), newest, 0.25)


def rerank_lexical(spark, sf_dir):
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("p_id"), "text")
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    found = evaluation.shared_runs(passages, docs).join(docs, "doc_id").join(passages.withColumnRenamed("text", "question"), "p_id")
    # Candidates stand in order of their ids, as if a search had ranked them so.
    ranked = evaluation.ranked_by(found.select(F.col("p_id").alias("q_id"), F.col("doc_id").alias("id"), "text", "question", F.lit(0.0).alias("score")))
    best = search.rerank(ranked, search.lexical_overlap(F.col("question"), F.col("text")), 6)
    return best.select("q_id", "id", F.col("new_rank").alias("rank"))


def span_match(spark, sf_dir):
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("p_id"), "text")
    return evaluation.shared_runs(passages, _docs(spark, sf_dir).select("doc_id", "text"))


def pile_union(spark, sf_dir):
    questions = _questions(spark, sf_dir)
    ranked = search.search_exact(_vectors(spark, sf_dir), questions, 50)
    labelled = ranked.join(_vectors(spark, sf_dir).select("id", "label"), "id").join(questions.select("q_id", "q_label"), "q_id")
    return evaluation.pile(ranked.where("rank <= 10"), labelled.where("label = q_label"))


def vector_norms(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", F.round(V.norm(F.col("vec")), 6).alias("norm"), V.has_dimension(F.col("vec"), 64).alias("fits"))


QUERIES = {
    f.__name__: f
    for f in (
        latency_totals, hourly_series, stage_percentiles, cache_summary, slowest_requests, repeated_questions, rate_limit, request_outcomes, date_buckets,
        cache_eviction, stream_hourly, corpus_overview, document_page, collection_counts, document_detail, content_hash_dupes, change_detection, replace_by_key,
        status_counts, topic_lists, chunk_stats, letters_normalise, text_clean, text_quality, pii_mask, guard_flags, probe_slices, conversation_titles,
        citation_parse, pack_lines, fixed_chunks, act_pieces, html_chunks, knn_exact, knn_blocks, knn_capped, hit_mrr, recall_at_10, semantic_cache_hits,
        rerank_lexical, span_match, pile_union, vector_norms,
    )
}
QUERIES |= catalogue_lists.QUERIES | catalogue_sinks.QUERIES

_COMMON = ", ".join(f"'{w}'" for w in X.COMMON_WORDS)
STATUS_SQL = f"""CASE WHEN text IS NULL OR length(text) < {X.MIN_CHARS_PER_PAGE} THEN 'no_text'
  WHEN len(regexp_extract_all(text, '[A-Za-z]{{2,}}')) = 0
    OR len(list_filter(regexp_extract_all(text, '[A-Za-z]{{2,}}'), lambda w: lower(w) IN ({_COMMON}))) < {X.MIN_COMMON_SHARE} * len(regexp_extract_all(text, '[A-Za-z]{{2,}}'))
  THEN 'garbled' ELSE 'ok' END"""


def _rounded(expr: str, digits: int) -> str:
    return f"round({expr}, {digits})"


def _sql_any(patterns) -> str:
    return " OR ".join(f"regexp_matches(text, '(?i){p.replace(chr(39), chr(39) * 2)}')" for p in patterns)


def _sql_clean() -> str:
    furniture = "(?m)^\\s*(" + "|".join(X.PAGE_FURNITURE) + ")\\s*$"
    out = "text"
    for a, b in (
        ("\\x00", ""), ("\u00ad\\s*", ""), ("([a-z])-\\n([a-z])", "\\1\\2"), (furniture, ""), ("[ \\t\u00a0]+", " "),
        (X.LINE_ENDS, "\n"), (f"(?m)^[{X.BLANKS}]+|[{X.BLANKS}]+$", ""), ("\\n{3,}", "\n\n"), (f"^[\n{X.BLANKS}]+|[\n{X.BLANKS}]+$", ""),
    ):
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return out


def _sql_mask() -> str:
    out = "text"
    for kind, p in X.PII.items():
        out = f"regexp_replace({out}, '{p}', '[{kind.upper()}]', 'g')"
    return out


ORACLES = {
    "latency_totals": f"""WITH {LOG_SQL}, t AS (SELECT count(*) AS requests, round(avg(latency_ms), 1) AS avg_ms, round(min(latency_ms), 1) AS min_ms, round(max(latency_ms), 1) AS max_ms,
        round(round(quantile_cont(latency_ms, 0.5), 6), 1) AS p50_ms, round(round(quantile_cont(latency_ms, 0.9), 6), 1) AS p90_ms, round(round(quantile_cont(latency_ms, 0.95), 6), 1) AS p95_ms,
        round(round(quantile_cont(latency_ms, 0.99), 6), 1) AS p99_ms, count(*) FILTER (status_code >= 400) AS errors, count(*) FILTER (cache_hit) AS cache_hits,
        sum(tokens_input)::BIGINT AS tokens_input, sum(tokens_output)::BIGINT AS tokens_output FROM log)
        SELECT *, round(errors::DOUBLE / requests, 4) AS error_rate, round(tokens_input / 1e6 * 0.3::DOUBLE + tokens_output / 1e6 * 2.5::DOUBLE, 6) AS cost_usd,
        round((tokens_input / 1e6 * 0.3::DOUBLE + tokens_output / 1e6 * 2.5::DOUBLE) / requests, 6) AS cost_per_request FROM t""",
    "hourly_series": f"""WITH {LOG_SQL} SELECT date_trunc('hour', created_at) AS hour, count(*) AS requests, round(round(quantile_cont(latency_ms, 0.95), 6), 1) AS p95_ms,
        round(count(*) FILTER (status_code >= 400)::DOUBLE / count(*), 4) AS error_rate, round(count(*) FILTER (cache_hit)::DOUBLE / count(*), 4) AS cache_hit_rate FROM log GROUP BY 1""",
    "stage_percentiles": f"""WITH {LOG_SQL}, s AS (SELECT unnest(json_keys(stages)) AS stage, stages FROM log WHERE stages IS NOT NULL),
        p AS (SELECT stage, quantile_cont(json_extract_string(stages, stage)::DOUBLE, 0.5) AS p50, quantile_cont(json_extract_string(stages, stage)::DOUBLE, 0.95) AS p95, count(*) AS samples FROM s GROUP BY 1)
        SELECT stage, round(round(p50, 6), 1) AS p50_ms, round(round(p95, 6), 1) AS p95_ms, samples, round(p50 / sum(p50) OVER (), 4) AS share FROM p""",
    "cache_summary": f"""WITH {LOG_SQL}, t AS (SELECT count(*) FILTER (cache_hit) AS hits, count(*) AS lookups FROM log WHERE status_code < 400)
        SELECT hits, lookups, round(hits::DOUBLE / lookups, 4) AS hit_rate FROM t""",
    "slowest_requests": f"WITH {LOG_SQL} SELECT id, query, round(latency_ms) AS latency_ms, status_code FROM log ORDER BY log.latency_ms DESC, id LIMIT 5",
    "repeated_questions": f"WITH {LOG_SQL} SELECT query, count(*) AS asked FROM log GROUP BY 1 HAVING count(*) >= 2",
    "rate_limit": """WITH t AS (SELECT event_id AS id, 'q' || user_id AS query, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS recent FROM events)
        SELECT id, query, recent, recent <= 3 AS allowed FROM t""",
    "request_outcomes": f"WITH {LOG_SQL} SELECT CASE WHEN status_code < 400 THEN 'ok' ELSE 'failed' END AS outcome, count(*) AS n FROM log GROUP BY 1",
    "date_buckets": """WITH d AS (SELECT date_diff('day', ts::DATE, (SELECT max(ts)::DATE FROM events)) AS d FROM events)
        SELECT CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d <= 7 THEN 'Previous 7 days' WHEN d <= 30 THEN 'Previous 30 days' ELSE 'Older' END AS bucket, count(*) AS n FROM d GROUP BY 1""",
    "cache_eviction": """WITH f AS (SELECT event_type AS scope, event_id AS id, ts AS t FROM events WHERE ts > (SELECT max(ts) FROM events) + INTERVAL 1 SECOND - INTERVAL 7 DAYS),
        r AS (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY t DESC, id DESC) AS n FROM f) SELECT scope, id FROM r WHERE n <= 200""",
    "stream_hourly": """SELECT date_trunc('hour', ts) AS hour, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS cache_hits,
        round(max(value), 1) AS max_ms FROM events GROUP BY 1""",
    "corpus_overview": f"""WITH {CATALOGUE_SQL} SELECT count(*) AS documents, sum(chunk_count)::BIGINT AS chunks, (SELECT count(embedding) FROM embeddings) AS vectors, sum(page_count)::BIGINT AS pages FROM cat""",
    "document_page": f"""WITH {CATALOGUE_SQL} SELECT doc_id, title, collection, publication_date::VARCHAR AS publication_date FROM cat
        WHERE (title ILIKE '%the%' OR doc_id ILIKE '%the%') AND (title ILIKE '%on%' OR doc_id ILIKE '%on%')
        ORDER BY coalesce(nullif(strpos(lower(title), 'the on'), 0), 1000000), cat.publication_date DESC NULLS LAST, doc_id LIMIT 20 OFFSET 10""",
    "collection_counts": f"WITH {CATALOGUE_SQL} SELECT collection, count(*) AS n FROM cat GROUP BY 1",
    "document_detail": f"WITH {CATALOGUE_SQL} SELECT doc_id, collection, doc_id IN (SELECT doc_id::VARCHAR FROM labels) AS has_file FROM cat WHERE doc_id = '7'",
    "content_hash_dupes": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "change_detection": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 2 = 1 OR doc_id % 6 = 0",
    "replace_by_key": "SELECT doc_id, lang, n_chars + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n_chars FROM documents",
    "status_counts": f"SELECT {STATUS_SQL} AS status, count(*) AS n FROM documents GROUP BY 1",
    "topic_lists": """SELECT source AS celex, arg_min(lang, doc_id) AS type, min(doc_id) AS date, array_to_string(list_sort(list_distinct(list(lang))), '|') AS topics FROM documents GROUP BY 1""",
    "chunk_stats": f"""WITH t AS (SELECT len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS tokens, {STATUS_SQL} AS status FROM documents),
        s AS (SELECT count(*) AS documents, count(*) FILTER (status = 'ok') AS usable, count(*) AS chunks, quantile_cont(tokens, 0.5)::DOUBLE AS tokens_median, max(tokens)::BIGINT AS tokens_max,
        count(*) FILTER (tokens > 512) AS too_long, list_sort(list(tokens)) AS l FROM t)
        SELECT documents, usable, chunks, tokens_median, tokens_max, too_long, l[greatest(1, floor(chunks * 0.95::DOUBLE)::BIGINT)]::BIGINT AS tokens_p95, round(chunks::DOUBLE / usable, 1) AS chunks_per_document FROM s""",
    "letters_normalise": "SELECT doc_id, sha256(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS digest FROM documents",
    "text_clean": f"SELECT doc_id, sha256({_sql_clean()}) AS digest FROM documents",
    "text_quality": f"""SELECT doc_id, {STATUS_SQL} AS status, length(regexp_replace(text, '\\P{{Nd}}+', '', 'g')) > length(regexp_replace(text, '\\P{{L}}+', '', 'g')) AS mostly_numbers FROM documents""",
    "pii_mask": f"""SELECT doc_id, sha256({_sql_mask()}) AS digest, {", ".join(f"len(regexp_extract_all(text, '{p}'))::BIGINT AS n_{k}" for k, p in X.PII.items())} FROM documents""",
    "guard_flags": f"""SELECT doc_id, {_sql_any(X.INJECTION)} AS injected, {_sql_any(X.HARMFUL)} AS harmful,
        sha256(trim(replace(replace(regexp_replace(regexp_replace(text, '-{{3,}}', '', 'g'), '={{3,}}', '', 'g'), '{{{{', '{{ {{'), '}}}}', '}} }}'))) AS digest FROM documents""",
    "probe_slices": f"""WITH l AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t FROM documents), n AS (SELECT *, length(t) AS n FROM l)
        SELECT doc_id, CASE WHEN n = 0 THEN '' WHEN n <= {X.PROBE} THEN t ELSE substring(t, 1, {X.PROBE}) || '|' || substring(t, n // 4 + 1, {X.PROBE}) || '|' || substring(t, n // 2 + 1, {X.PROBE}) || '|' ||
        substring(t, 3 * n // 4 + 1, {X.PROBE}) || '|' || substring(t, n - {X.PROBE} + 1, {X.PROBE}) END AS probes FROM n""",
    "conversation_titles": """WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user')
        SELECT conv_id, turn, CASE WHEN length(t) > 48 THEN rtrim(substring(t, 1, 45)) || '…' ELSE t END AS title FROM c""",
    "citation_parse": """WITH n AS (SELECT doc_id, doc_id % 5 AS a, doc_id % 3 AS b FROM documents)
        SELECT doc_id, 0::BIGINT AS place, a AS n FROM n UNION ALL SELECT doc_id, 1, b FROM n WHERE a <> b""",
    "pack_lines": """WITH RECURSIVE u AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents),
        f AS (SELECT doc_id, l, 1 AS i, 0::BIGINT AS place, l[1] AS now FROM u WHERE len(l) > 0
          UNION ALL SELECT doc_id, l, i + 1, CASE WHEN length(now) + 1 + length(l[i + 1]) > 1600 THEN place + 1 ELSE place END,
            CASE WHEN length(now) + 1 + length(l[i + 1]) > 1600 THEN l[i + 1] ELSE now || chr(10) || l[i + 1] END FROM f WHERE i < len(l)),
        g AS (SELECT doc_id, place, arg_max(now, i) AS t FROM f GROUP BY 1, 2)
        SELECT doc_id, place, length(t)::BIGINT AS chars, sha256(t) AS digest FROM g""",
    "knn_exact": f"WITH {SCORES_SQL} SELECT q_id, id, score, rank FROM ranked WHERE rank <= {K}",
    "knn_blocks": f"WITH {SCORES_SQL} SELECT q_id, id, score, rank FROM ranked WHERE rank <= {K}",
    "knn_capped": f"""WITH {SCORES_SQL}, c AS (SELECT *, sum((label < 5)::INT) OVER (PARTITION BY q_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS n FROM ranked WHERE rank <= 18),
        k AS (SELECT q_id, id, score, label, (row_number() OVER (PARTITION BY q_id ORDER BY rank))::INTEGER AS rank FROM c WHERE label >= 5 OR n <= 1) SELECT q_id, id, score, rank, label FROM k WHERE rank <= 6""",
    "hit_mrr": f"""WITH {SCORES_SQL}, f AS (SELECT q.q_id, min(rank) AS first FROM q LEFT JOIN (SELECT * FROM ranked WHERE rank <= 100 AND label = q_label) r ON q.q_id = r.q_id GROUP BY 1)
        SELECT count(*) AS questions, {", ".join(f"round(avg((coalesce(first, 1000) <= {d})::INT::DOUBLE), 6) AS hit_{d}" for d in (6, 20, 50, 100))},
        round(avg(CASE WHEN first <= 6 THEN 1::DOUBLE / first ELSE 0::DOUBLE END), 6) AS mrr_6 FROM f""",
    "semantic_cache_hits": """WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS n FROM embeddings WHERE vec_id % 2 = 0) WHERE n <= 2000),
        p AS (SELECT a.vec_id AS id, s.vec_id AS hit, round(list_dot_product(a.embedding::DOUBLE[], s.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN s ON a.label = s.label WHERE a.vec_id % 2 = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, hit) AS n FROM p) SELECT id, hit, score FROM r WHERE n = 1 AND score >= 0.25""",
    "rerank_lexical": """WITH l AS (SELECT item_id AS p_id, text AS q, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t FROM benchmark),
        d AS (SELECT doc_id, text, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t FROM documents),
        g AS (SELECT DISTINCT p_id, q, substring(t, i, 120) AS g FROM l, unnest(range(1, length(t) - 118)) AS r(i) WHERE length(t) >= 120),
        e AS (SELECT DISTINCT doc_id, substring(t, i, 120) AS g FROM d, unnest(range(1, length(t) - 118)) AS r(i) WHERE length(t) >= 120),
        p AS (SELECT DISTINCT p_id, q, doc_id FROM g JOIN e USING (g)),
        s AS (SELECT p_id AS q_id, p.doc_id AS id, len(list_intersect(list_distinct(list_filter(string_split_regex(lower(q), '[^a-z0-9]+'), lambda w: w <> '')),
          list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')))) AS s FROM p JOIN documents USING (doc_id)),
        r AS (SELECT q_id, id, (row_number() OVER (PARTITION BY q_id ORDER BY s DESC, id))::INTEGER AS rank FROM s) SELECT q_id, id, rank FROM r WHERE rank <= 6""",
    "span_match": """WITH p AS (SELECT item_id AS p_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t FROM benchmark), d AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t FROM documents),
        g AS (SELECT DISTINCT p_id, substring(t, i, 120) AS g FROM p, unnest(range(1, length(t) - 118)) AS r(i) WHERE length(t) >= 120),
        e AS (SELECT DISTINCT doc_id, substring(t, i, 120) AS g FROM d, unnest(range(1, length(t) - 118)) AS r(i) WHERE length(t) >= 120) SELECT DISTINCT p_id, doc_id FROM g JOIN e USING (g)""",
    "pile_union": f"""WITH {SCORES_SQL} SELECT q_id, id FROM ranked WHERE rank <= 10 UNION SELECT q_id, id FROM ranked WHERE rank <= 50 AND label = q_label""",
    "vector_norms": "SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, len(embedding) = 64 AS fits FROM embeddings",
}
ORACLES |= catalogue_lists.ORACLES | catalogue_sinks.ORACLES
