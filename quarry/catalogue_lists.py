"""Registered queries over lists, lifecycle, labels and evaluation tables, each over a whole table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import vectors as V
from quarry.operators import analytics, catalog, evaluation, ingest, search
from quarry.session import spread, table

# Stand-ins for the tables of a live system: acts are documents, gold passages are embeddings of the same label, judged answers are requests. ---------------


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _acts(spark, sf_dir):
    day = F.date_format(F.date_add(F.to_date(F.lit("1990-01-01")), (F.col("doc_id") * 7 % 12000).cast("int")), "yyyy-MM-dd")
    topics = F.when(F.col("doc_id") % 3 > 0, F.array_distinct(F.array("lang", "source"))).otherwise(F.array().cast("array<string>"))
    return _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("celex"), F.when(F.col("doc_id") % 7 > 0, F.col("source")).alias("type"), day.alias("date"), topics.alias("topics"))


def _files(spark, sf_dir):
    return _docs(spark, sf_dir).where("doc_id % 4 <> 0").select("doc_id")


def _times(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("q_id"), F.col("value").alias("ms"))


def _golden(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("n"))
    ids = F.array((F.col("item_id") * 3).cast("long"), (F.col("item_id") * 5 + 1).cast("long"), F.col("item_id") * 1_000_000)
    return asked.select(F.col("item_id").alias("id"), (F.col("n") % 5 > 0).alias("answerable"), ids.alias("doc_ids"), ids.alias("chunk_ids"))


def _ranked(spark, sf_dir):
    """Vectors of a label in order of id, as if a question for each label had ranked them so."""
    return evaluation.ranked_by(_vectors(spark, sf_dir).select(F.col("label").alias("q_id"), "id", (-F.col("id")).cast("double").alias("score")))


ACTS_SQL = """acts AS (SELECT doc_id::VARCHAR AS celex, CASE WHEN doc_id % 7 > 0 THEN source END AS type, strftime(DATE '1990-01-01' + (doc_id * 7 % 12000)::INTEGER, '%Y-%m-%d') AS date,
  CASE WHEN doc_id % 3 > 0 THEN list_distinct([lang, source]) ELSE [] END AS topics FROM documents)"""
GOLDEN_SQL = """gold AS (SELECT item_id AS id, length(text) % 5 > 0 AS answerable, [item_id * 3, item_id * 5 + 1, item_id * 1000000] AS ids FROM benchmark)"""
RANKED_SQL = "ranked AS (SELECT label AS q_id, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings)"


# Lists and lifecycle -----------------------------------------------------------------------------------------------------


def act_formats(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    kind = F.when(F.col("n_chars") % 3 == 0, "xhtml").when(F.col("n_chars") % 3 == 1, "html").otherwise("pdfa2a")
    formats = docs.where("doc_id % 5 > 0").select(F.floor(F.col("doc_id") / 4).alias("celex"), kind.alias("format"))
    found = ingest.formats_of(docs.select(F.col("doc_id").alias("celex")), formats)
    return found.select("celex", F.array_join("formats", "|").alias("formats"), "html_kind")


def document_urls(spark, sf_dir):
    urls = ingest.candidate_urls(F.concat(F.lit("http://x/"), F.col("doc_id")), 4)
    return _docs(spark, sf_dir).select("doc_id", F.array_join(urls, " ").alias("urls"), catalog.source_url(F.col("doc_id").cast("string")).alias("source_url"))


def files_to_fetch(spark, sf_dir):
    return ingest.not_done(_docs(spark, sf_dir), _files(spark, sf_dir), "doc_id").select("doc_id", "source")


def files_on_disk(spark, sf_dir):
    return ingest.on_disk(_docs(spark, sf_dir), _files(spark, sf_dir), "doc_id").select("doc_id", "source")


def first_sources(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", F.lit("page").alias("origin"), "n_chars")
    judged = _labels(spark, sf_dir).select("doc_id", F.lit("label").alias("origin"), F.lit(0).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    return ingest.first_source(judged, docs, "doc_id")


def matching_counts(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return ingest.require_matching_counts(docs.select("doc_id", "source"), docs.select("source", "lang"), "source")


def vectors_checked(spark, sf_dir):
    return ingest.require_dimension(_vectors(spark, sf_dir), "vec", 64).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def chunk_vectors(spark, sf_dir):
    chunks = _docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 3).alias("chunk_index"), "lang")
    vectors = _vectors(spark, sf_dir).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("chunk_index"), "label")
    return ingest.join_vectors(chunks, vectors, ["doc_id", "chunk_index"], _labels(spark, sf_dir)).select("doc_id", "chunk_index", "lang", "label")


def _placed(spark, sf_dir):
    chunks = _docs(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("chunk_index"))
    chunks = chunks.select("doc_id", "chunk_index", F.lit(0).alias("page_start"), F.lit(0).alias("page_end"))
    page = lambda i: F.when((F.col("doc_id") + i) % 4 == 0, 0).otherwise((F.col("doc_id") % 90).cast("int") + i)
    pages = F.array(*(F.struct(page(i).alias("start"), (page(i) + i).alias("end")) for i in range(2)))
    return ingest.fill_pages(chunks, _docs(spark, sf_dir).where("doc_id % 10 > 0").select("doc_id", pages.alias("pages")))


def filled_pages(spark, sf_dir):
    return _placed(spark, sf_dir).select("doc_id", "chunk_index", "page_start", "page_end")


def placed_chunks(spark, sf_dir):
    return ingest.placed_share(_placed(spark, sf_dir))


def ingest_progress(spark, sf_dir):
    docs = catalog.catalogue(_docs(spark, sf_dir))
    embedded = _vectors(spark, sf_dir).select(F.col("id").cast("string").alias("doc_id"))
    return ingest.progress(_acts(spark, sf_dir), _files(spark, sf_dir), docs, embedded)


def acts_summary(spark, sf_dir):
    acts = _acts(spark, sf_dir)
    return catalog.acts_summary(acts).join(catalog.distinct_topics(acts), F.lit(True)).select("acts", "first_year", "last_year", "with_topics", "gigabytes", F.col("topics").alias("distinct_topics"))


def common_types(spark, sf_dir):
    return catalog.most_common(_acts(spark, sf_dir), F.col("type"))


def common_failures(spark, sf_dir):
    failed = _docs(spark, sf_dir).where("doc_id % 4 = 0").select(F.concat_ws(": ", F.when(F.col("doc_id") % 3 > 0, F.col("source")), "doc_id").alias("error"))
    return catalog.failure_reasons(failed)


def acts_of_topic(spark, sf_dir):
    return catalog.with_topic(_acts(spark, sf_dir), "E").select("celex", "date")


def acts_by_id_part(spark, sf_dir):
    return catalog.with_id_part(_acts(spark, sf_dir), "17").select("celex", "type")


def first_acts(spark, sf_dir):
    return catalog.first_acts(_acts(spark, sf_dir), 25).select("celex", "date")


def page_total(spark, sf_dir):
    return catalog.total(catalog.catalogue(_docs(spark, sf_dir)), "the on")


def log_72h(spark, sf_dir):
    return analytics.hourly(analytics.last_hours(analytics.request_log(table(spark, sf_dir, "events")), 72))


# Labels and formats ------------------------------------------------------------------------------------------------------


def chunk_labels(spark, sf_dir):
    text = F.col("text")
    header = X.chunk_header(text, F.when(F.col("doc_id") % 2 == 0, F.lit("Recitals (1)")).otherwise(""))
    chunk = F.concat_ws("\n", header, text)
    return _docs(spark, sf_dir).select(
        "doc_id", X.is_recital(chunk).alias("recital"), F.sha2(X.body_of(chunk), 256).alias("body"), F.sha2(header, 256).alias("header"), X.collection_of(F.upper(F.substring(text, 1, 3))).alias("collection")
    )


def section_titles(spark, sf_dir):
    titled = X.heading_title(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", titled["title"].alias("title"), F.sha2(titled["rest"], 256).alias("rest"))


def scanned_pages(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.clean_scan(F.col("text")), 256).alias("digest"))


def output_guard(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.checked_output(F.col("text")), 256).alias("digest"))


def display_formats(spark, sf_dir):
    ms, n = F.col("value"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", X.format_ms(F.round(ms, 1)).alias("ms"), X.format_percent(F.round(n % 1000 / 1000, 3)).alias("share"), X.format_number(n * 37).alias("n"), X.format_usd(F.round(n % 300 / 1000, 3)).alias("usd")
    )


def cache_keys(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("text is not null and role is not null")
    return turns.select("conv_id", "turn", X.cache_key(F.col("role"), F.col("text")).alias("key"), X.cache_scope(F.col("role"), F.lit("v1")).alias("scope"), X.valid_question(F.col("text")).alias("valid"))


def linked_citations(spark, sf_dir):
    answer = F.concat(F.lit("See ["), F.col("doc_id") % 7, F.lit("] and [2](x), "), F.substring("text", 1, 40))
    return _docs(spark, sf_dir).select("doc_id", X.link_citations(answer).alias("answer"))


def prompts(spark, sf_dir):
    page = (F.col("doc_id") % 9).cast("int")
    source = X.source_passage(F.lit(1), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("doc_id").cast("string"), page, page + (F.col("doc_id") % 2).cast("int"), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.prompt("Answer from the sources.", source, F.substring("text", 1, 30)), 256).alias("digest"))


def answer_blocks(spark, sf_dir):
    kind = lambda k, text: F.struct(F.lit(k).alias("type"), text.alias("text"))
    blocks = F.array(kind("thinking", F.col("lang")), kind("text", F.col("source")), kind("text", F.substring("text", 1, 20)))
    cited = F.array(*(F.struct(F.when(F.col("doc_id") % k > 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % (k + 1) > 0, F.lit(k)).alias("page")) for k in (2, 3, 5)))
    return _docs(spark, sf_dir).select("doc_id", X.text_blocks(blocks).alias("said"), F.size(X.usable_citations(cited)).cast("long").alias("usable"))


def conversation_list(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("at", F.timestamp_seconds(F.col("turn") * 60))
    found = catalog.conversations(turns, X.title_holds(F.coalesce("title", F.lit("")), " An "))
    return found.select("conv_id", "title", F.unix_timestamp("updated").alias("updated"))


# Retrieval and evaluation ------------------------------------------------------------------------------------------------


def reachable_questions(spark, sf_dir):
    return evaluation.reachable(_golden(spark, sf_dir), _docs(spark, sf_dir))


def gold_passages(spark, sf_dir):
    chunks = _docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("text"))
    return evaluation.gold_texts(_golden(spark, sf_dir), chunks)


def pile_scores(spark, sf_dir):
    ranked = _ranked(spark, sf_dir).where("rank <= 30")
    golden = evaluation.pile(ranked.where("rank <= 10"), ranked.where("id % 3 = 0")).join(_vectors(spark, sf_dir).select("id"), "id")
    placed = evaluation.ranked_by(golden.withColumn("score", (F.col("id") * 31 % 101).cast("double")))
    questions = _vectors(spark, sf_dir).select(F.col("label").alias("q_id"))
    return evaluation.hit_and_mrr(evaluation.first_ranks(questions, placed, F.col("id") % 4 == 0), (1, 3, 10), 5)


def pile_documents(spark, sf_dir):
    chunks = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 3).alias("doc_id"))
    return evaluation.pile_documents(_ranked(spark, sf_dir).where("rank <= 30"), chunks)


def first_candidates(spark, sf_dir):
    ranked = _ranked(spark, sf_dir).select("q_id", (F.col("id") % 40).alias("id"), "rank")
    return evaluation.first_seen(ranked)


def search_latency(spark, sf_dir):
    return evaluation.latency_summary(_times(spark, sf_dir))


def context_lengths(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return evaluation.context_length(_ranked(spark, sf_dir).join(docs, "id"), 6)


def judged_means(spark, sf_dir):
    judged = _labels(spark, sf_dir).select(F.col("quality").cast("double").alias("faithfulness"), F.when(F.col("doc_id") % 2 == 0, F.col("toxic").cast("double")).alias("relevancy"))
    return evaluation.score_means(judged, ["faithfulness", "relevancy"])


def cited_passages(spark, sf_dir):
    answers = _docs(spark, sf_dir).select(F.col("source").alias("q_id"), F.concat(F.lit("["), F.col("doc_id") % 8, F.lit("] "), F.substring("text", 1, 60)).alias("answer"), F.col("doc_id").alias("answer_id"))
    passages = _ranked(spark, sf_dir).select(F.concat(F.lit("s"), F.col("q_id") % 4).alias("q_id"), "id", "rank").where("rank <= 6").groupBy("q_id", "rank").agg(F.min("id").alias("id"))
    numbered = answers.select(F.col("answer_id").alias("q_id"), "answer")
    of_answer = answers.select("answer_id", F.concat(F.lit("s"), F.col("answer_id") % 4).alias("s")).join(passages.withColumnRenamed("q_id", "s"), "s")
    return search.citations(numbered, of_answer.select(F.col("answer_id").alias("q_id"), "rank", "id")).select("q_id", F.col("place").cast("long").alias("place"), F.col("n").cast("long").alias("n"), "id")


def cosine_to_first(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    first = vectors.where("id = 0").orderBy("vec").limit(1).select(F.col("vec").alias("first"))
    unit = V.normalised(F.col("vec"))
    return vectors.join(F.broadcast(first)).select("id", F.round(V.cosine(F.col("vec"), F.col("first")), 6).alias("cosine"), F.round(V.norm(unit), 4).alias("norm"))


def word_vectors(spark, sf_dir):
    counted = _docs(spark, sf_dir).select("doc_id", V.hashed_words(F.col("text"), 16).alias("v"))
    return counted.select("doc_id", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).cast("long").alias("words"), F.size("v").alias("size"))


QUERIES = {
    f.__name__: f
    for f in (
        act_formats, document_urls, files_to_fetch, files_on_disk, first_sources, matching_counts, vectors_checked, chunk_vectors, filled_pages, placed_chunks, ingest_progress,
        acts_summary, common_types, common_failures, acts_of_topic, acts_by_id_part, first_acts, page_total, log_72h, chunk_labels, section_titles, scanned_pages, output_guard,
        display_formats, cache_keys, linked_citations, prompts, answer_blocks, conversation_list, reachable_questions, gold_passages, pile_scores, pile_documents,
        first_candidates, search_latency, context_lengths, judged_means, cited_passages, cosine_to_first, word_vectors,
    )
}

_HEADER_SQL = (
    "CASE WHEN length(trim(text)) > 250 THEN regexp_replace(substring(trim(text), 1, 250), '(?s) [^ ]*$', '') || '...' ELSE trim(text) END"
    " || CASE WHEN doc_id % 2 = 0 THEN ' | Recitals (1)' ELSE '' END"
)
_STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _sql_masked() -> str:
    out = "text"
    for kind, p in X.PII.items():
        out = f"regexp_replace({out}, '{p}', '[{kind.upper()}]', 'g')"
    return out


_HARM = " OR ".join(f"regexp_matches(text, '(?i){p.replace(chr(39), chr(39) * 2)}')" for p in X.HARMFUL)

ORACLES = {
    "act_formats": """WITH f AS (SELECT doc_id // 4 AS celex, CASE n_chars % 3 WHEN 0 THEN 'xhtml' WHEN 1 THEN 'html' ELSE 'pdfa2a' END AS format FROM documents WHERE doc_id % 5 > 0),
        s AS (SELECT celex, list_sort(list_distinct(list(format))) AS formats FROM f GROUP BY 1)
        SELECT doc_id AS celex, array_to_string(coalesce(formats, []), '|') AS formats, CASE WHEN list_contains(formats, 'xhtml') THEN 'xhtml' WHEN list_contains(formats, 'html') THEN 'html' END AS html_kind
        FROM documents LEFT JOIN s ON doc_id = celex""",
    "document_urls": """SELECT doc_id, array_to_string([ 'http://x/' || doc_id || '/DOC_' || i FOR i IN range(1, 5)], ' ') AS urls,
        'https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:' || doc_id AS source_url FROM documents""",
    "files_to_fetch": "SELECT doc_id, source FROM documents WHERE doc_id % 4 = 0",
    "files_on_disk": "SELECT doc_id, source FROM documents WHERE doc_id % 4 <> 0",
    "first_sources": "SELECT doc_id, 'label' AS origin, 0 AS n_chars FROM labels UNION ALL SELECT doc_id, 'page', n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "matching_counts": "SELECT source, count(*) AS left_n, count(*) AS right_n FROM documents GROUP BY 1",
    "vectors_checked": "SELECT label, count(*) AS n FROM embeddings GROUP BY 1",
    "chunk_vectors": "SELECT doc_id, doc_id % 3 AS chunk_index, lang, label FROM documents JOIN embeddings ON doc_id = vec_id AND doc_id % 3 = vec_id % 2 WHERE doc_id IN (SELECT doc_id FROM labels)",
    "filled_pages": """WITH c AS (SELECT doc_id, unnest(range(0, doc_id % 3 + 1))::INTEGER AS i FROM documents)
        SELECT doc_id, i AS chunk_index, CASE WHEN i < 2 AND doc_id % 10 > 0 AND (doc_id + i) % 4 > 0 THEN doc_id % 90 + i ELSE 0 END::INTEGER AS page_start,
        CASE WHEN i < 2 AND doc_id % 10 > 0 AND (doc_id + i) % 4 > 0 AND doc_id % 90 + i > 0 THEN doc_id % 90 + 2 * i ELSE 0 END::INTEGER AS page_end FROM c""",
    "placed_chunks": """WITH c AS (SELECT doc_id, unnest(range(0, doc_id % 3 + 1)) AS i FROM documents)
        SELECT round(avg((i < 2 AND doc_id % 10 > 0 AND (doc_id + i) % 4 > 0 AND doc_id % 90 + i > 0)::INT::DOUBLE), 4) AS placed FROM c""",
    "ingest_progress": """WITH n AS (SELECT doc_id, greatest(1, ceil(n_chars / 1600.0))::BIGINT AS c FROM documents) SELECT count(*) AS acts, count(*) FILTER (doc_id % 4 <> 0) AS files, count(*) AS documents,
        sum(c)::BIGINT AS chunks, coalesce(sum(c) FILTER (doc_id IN (SELECT vec_id FROM embeddings)), 0)::BIGINT AS embedded_chunks FROM n""",
    "acts_summary": f"""WITH {ACTS_SQL} SELECT count(*) AS acts, min(date[1:4]) AS first_year, max(date[1:4]) AS last_year, round(100.0::DOUBLE * count(*) FILTER (len(topics) > 0) / count(*), 1) AS with_topics,
        round(count(*) * 0.56::DOUBLE / 1024, 1) AS gigabytes, (SELECT count(DISTINCT t) FROM (SELECT unnest(topics) AS t FROM acts)) AS distinct_topics FROM acts""",
    "common_types": f"WITH {ACTS_SQL} SELECT coalesce(nullif(type, ''), '?') AS value, count(*) AS n FROM acts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "common_failures": """SELECT coalesce(nullif(string_split(CASE WHEN doc_id % 3 > 0 THEN source || ': ' || doc_id ELSE doc_id::VARCHAR END, ':')[1], ''), '?') AS value, count(*) AS n
        FROM documents WHERE doc_id % 4 = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
    "acts_of_topic": f"WITH {ACTS_SQL} SELECT celex, date FROM acts WHERE len(list_filter(topics, lambda t: contains(lower(t), 'e'))) > 0",
    "acts_by_id_part": f"WITH {ACTS_SQL} SELECT celex, type FROM acts WHERE contains(celex, '17')",
    "first_acts": f"WITH {ACTS_SQL} SELECT celex, date FROM acts ORDER BY celex LIMIT 25",
    "page_total": """WITH c AS (SELECT doc_id::VARCHAR AS i, string_split(text, chr(10))[1] AS t FROM documents) SELECT count(*) AS total FROM c
        WHERE (t ILIKE '%the%' OR i ILIKE '%the%') AND (t ILIKE '%on%' OR i ILIKE '%on%')""",
    "log_72h": """WITH l AS (SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 72 HOURS) SELECT date_trunc('hour', ts) AS hour, count(*) AS requests,
        round(round(quantile_cont(value, 0.95), 6), 1) AS p95_ms, round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 4) AS error_rate,
        round(count(*) FILTER (event_type = 'view')::DOUBLE / count(*), 4) AS cache_hit_rate FROM l GROUP BY 1""",
    "chunk_labels": f"""WITH h AS (SELECT doc_id, text, {_HEADER_SQL} AS header FROM documents), c AS (SELECT *, header || chr(10) || text AS chunk FROM h)
        SELECT doc_id, starts_with(regexp_replace(string_split(chunk, chr(10))[1], '^.* \\| ', ''), 'Recitals') AS recital, sha256(substring(chunk, strpos(chunk, chr(10)) + 1)) AS body, sha256(header) AS header,
        CASE string_split(upper(substring(text, 1, 3)), '_')[1] WHEN 'REG' THEN 'Regulation' WHEN 'DIR' THEN 'Directive' WHEN 'DEC' THEN 'Decision' WHEN 'RECO' THEN 'Recommendation' ELSE 'Other' END AS collection FROM c""",
    "section_titles": f"""WITH p AS (SELECT doc_id, text, trim(string_split(text, chr(10))[1], ' ') AS first,
          {_STRIPPED.format("CASE WHEN strpos(text, chr(10)) > 0 THEN substring(text, strpos(text, chr(10)) + 1) ELSE text END")} AS rest FROM documents),
        j AS (SELECT *, contains(text, chr(10)) AND first <> '' AND rest <> '' AND length(first) <= 120 AND NOT regexp_matches(first, '^[\\p{{Nd}}(]') AND NOT regexp_matches(first, '[.;:,]$')
          AND lower(regexp_extract(first, '(\\S+)$', 1)) NOT IN ({", ".join(f"'{w}'" for w in X.CONTINUATION_WORDS)}) AND regexp_matches(rest, '^[\\p{{Lu}}\\p{{Nd}}(]') AS ok FROM p)
        SELECT doc_id, CASE WHEN ok THEN first ELSE '' END AS title, sha256(CASE WHEN ok THEN rest ELSE text END) AS rest FROM j""",
    "output_guard": f"SELECT doc_id, sha256(CASE WHEN {_HARM} THEN 'Response removed due to harmful content.' ELSE {_sql_masked()} END) AS digest FROM documents",
    "cache_keys": """SELECT conv_id, turn, sha256(role || ':' || text) AS key, substring(sha256(role || ':v1'), 1, 16) AS scope, length(text) BETWEEN 1 AND 1000 AS valid FROM conversations
        WHERE text IS NOT NULL AND role IS NOT NULL""",
    "linked_citations": """SELECT doc_id, 'See [' || doc_id % 7 || '](#cite-' || doc_id % 7 || ') and [2](x), ' || regexp_replace(substring(text, 1, 40), '\\[(\\d+)\\]', '[\\1](#cite-\\1)', 'g') AS answer FROM documents""",
    "prompts": """SELECT doc_id, sha256('Answer from the sources.' || chr(10) || chr(10) || 'Sources:' || chr(10) || chr(10) || '[1] ' || CASE WHEN doc_id % 2 = 0 THEN source ELSE doc_id::VARCHAR END || ' (' ||
        CASE WHEN doc_id % 2 = 0 THEN 'page ' || doc_id % 9 ELSE 'pages ' || doc_id % 9 || '-' || (doc_id % 9 + 1) END || ')' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || substring(text, 1, 30)) AS digest
        FROM documents""",
    "answer_blocks": """SELECT doc_id, source || substring(text, 1, 20) AS said, ((doc_id % 2 > 0 AND doc_id % 3 > 0)::INT + (doc_id % 3 > 0 AND doc_id % 4 > 0)::INT + (doc_id % 5 > 0 AND doc_id % 6 > 0)::INT)::BIGINT AS usable
        FROM documents""",
    "conversation_list": """WITH q AS (SELECT conv_id, arg_min(trim(regexp_replace(text, '\\s+', ' ', 'g')), turn) FILTER (role = 'user') AS t, max(turn) * 60 AS updated FROM conversations GROUP BY 1),
        c AS (SELECT conv_id, CASE WHEN length(t) > 48 THEN rtrim(substring(t, 1, 45)) || '…' ELSE t END AS title, updated FROM q) SELECT * FROM c WHERE contains(lower(title), 'an')""",
    "reachable_questions": f"WITH {GOLDEN_SQL}, g AS (SELECT id, unnest(ids) AS doc_id FROM gold WHERE answerable) SELECT DISTINCT id FROM g WHERE doc_id IN (SELECT doc_id FROM documents)",
    "gold_passages": f"WITH {GOLDEN_SQL}, g AS (SELECT id, unnest(ids) AS chunk_id FROM gold) SELECT id, chunk_id, sha256(text) AS text FROM g JOIN documents ON chunk_id = doc_id",
    "pile_scores": f"""WITH {RANKED_SQL}, p AS (SELECT q_id, id FROM ranked WHERE rank <= 10 UNION SELECT q_id, id FROM ranked WHERE rank <= 30 AND id % 3 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY id * 31 % 101 DESC, id) AS rank FROM p),
        f AS (SELECT q.label AS q_id, min(rank) AS first FROM (SELECT DISTINCT label FROM embeddings) q LEFT JOIN (SELECT * FROM r WHERE id % 4 = 0) r ON q.label = r.q_id GROUP BY 1)
        SELECT count(*) AS questions, {", ".join(f"round(avg((coalesce(first, 1000) <= {d})::INT::DOUBLE), 6) AS hit_{d}" for d in (1, 3, 10))},
        round(avg(CASE WHEN first <= 5 THEN 1::DOUBLE / first ELSE 0::DOUBLE END), 6) AS mrr_5 FROM f""",
    "pile_documents": f"WITH {RANKED_SQL} SELECT DISTINCT doc_id // 3 AS doc_id FROM documents WHERE doc_id IN (SELECT id FROM ranked WHERE rank <= 30)",
    "first_candidates": f"""WITH {RANKED_SQL}, n AS (SELECT id % 40 AS id, q_id, rank, row_number() OVER (PARTITION BY id % 40 ORDER BY q_id, rank) AS n FROM ranked)
        SELECT id, q_id, rank::INTEGER AS rank FROM n WHERE n = 1""",
    "search_latency": """WITH m AS (SELECT quantile_cont(value, 0.5) AS m FROM events GROUP BY user_id)
        SELECT round(quantile_cont(m, 0.5), 3) AS p50_ms, round(quantile_cont(m, 0.95), 3) AS p95_ms, round(min(m), 3) AS min_ms, round(max(m), 3) AS max_ms, round(avg(m), 3) AS mean_ms FROM m""",
    "context_lengths": f"""WITH {RANKED_SQL}, s AS (SELECT q_id, sum(length(text)) AS n FROM ranked JOIN documents ON id = doc_id WHERE rank <= 6 GROUP BY 1) SELECT round(avg(n), 2) AS context_chars FROM s""",
    "judged_means": "SELECT round(avg(quality::DOUBLE), 4) AS faithfulness, round(avg(CASE WHEN doc_id % 2 = 0 THEN toxic::DOUBLE END), 4) AS relevancy FROM labels",
    "cited_passages": f"""WITH {RANKED_SQL}, p AS (SELECT 's' || q_id % 4 AS s, rank, min(id) AS id FROM ranked WHERE rank <= 6 GROUP BY 1, 2),
        a AS (SELECT doc_id, list_distinct([(doc_id % 8)::BIGINT] ) AS first, [try_cast(trim(x) AS INTEGER)::BIGINT FOR x IN list_concat([(doc_id % 8)::VARCHAR],
          flatten([string_split(g, ',') FOR g IN regexp_extract_all(substring(text, 1, 60), '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1)]))] AS ns FROM documents),
        u AS (SELECT doc_id, unnest(ns) AS n, generate_subscripts(ns, 1) AS i FROM a), d AS (SELECT doc_id, n, min(i) AS i FROM u WHERE n IS NOT NULL GROUP BY 1, 2),
        o AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place FROM d)
        SELECT doc_id AS q_id, place, n, id FROM o JOIN p ON s = 's' || doc_id % 4 AND rank = n""",
    "cosine_to_first": """WITH f AS (SELECT embedding::DOUBLE[] AS f FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
        SELECT vec_id AS id, round(list_dot_product(e, f) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f))), 6) AS cosine, 1.0::DOUBLE AS norm FROM e, f""",
    "word_vectors": "SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))::BIGINT AS words, 16 AS size FROM documents",
}
