"""A batch of questions from caches to citations, and the ingest of a corpus: the operators in their usual order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as X
from quarry.operators import chunking, ingest, search
from quarry.session import discard, materialize
from quarry.sources.files import page_of
from quarry.sources.tables import DocumentTables


def first_sentence(passage: Column) -> Column:
    """The default generator's part for one passage."""
    return F.regexp_extract(F.trim(passage), r"(?s)^.*?[.!?](?=\s|$)|^.*", 0)


def answer_batch(
    questions: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    k: int = 6,
    candidates: int = 100,
    max_recitals: int = 1,
    score: Callable[[Column, Column], Column] = search.lexical_overlap,
) -> tuple[DataFrame, DataFrame]:
    """Answers (q_id, answer, sources) and their citations (q_id, place, n, doc_id, page_start, page_end, quote).

    questions: q_id, question, q_vec; chunks: id, doc_id, title, text, page_start, page_end; vectors: id, vec. Candidates are searched, capped, joined to
    their texts, and reranked; the default generator quotes the first sentence of each passage. Questions that look like injections get no passage.
    """
    asked = questions.where(~X.looks_injected(F.col("question")))
    found = search.search_exact(vectors, asked.select("q_id", "q_vec"), candidates * search.OVERFETCH).join(chunks, "id")
    capped = search.cap_class(found, X.is_recital(F.col("text")), max_recitals, candidates)
    with_question = capped.join(asked.select("q_id", "question"), "q_id")
    best = search.rerank(with_question, score(F.col("question"), F.col("text")), k).drop("rank").withColumnRenamed("new_rank", "rank")
    best = best.withColumn("quote", first_sentence(X.body_of(F.col("text"))))
    source = X.source_passage(F.col("rank"), F.col("title"), F.col("doc_id"), F.col("page_start"), F.col("page_end"), F.col("text"))
    said = F.concat(F.col("quote"), F.lit(" ["), F.col("rank"), F.lit("]"))
    rows = best.groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("rank", said.alias("said"), source.alias("source")))).alias("r"))  # k rows
    answers = rows.select(
        "q_id", X.checked_output(F.array_join(F.transform("r", lambda x: x["said"]), " ")).alias("answer"), F.array_join(F.transform("r", lambda x: x["source"]), "\n\n").alias("sources")
    )
    cited = search.citations(answers, best.select("q_id", "rank", "id", "doc_id", "page_start", "page_end", "quote"))
    return answers, cited


def loaded_pages(pages: DataFrame, stored_docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of the pages (doc_id, title, html as text or bytes) that are not stored, or stored with another digest.

    The digest covers the page and the chunker's version, so a new chunker reloads pages that did not change. Unusable pages get their status and no chunks.
    """
    html = page_of(F.col("html")) if pages.schema["html"].dataType == T.BinaryType() else F.col("html")
    digested = pages.withColumn("html", html).withColumn("sha256", F.sha2(F.concat_ws("|", F.lit("chunker-1"), "html"), 256))
    new = ingest.changed(digested, stored_docs)
    status = F.when(F.col("html").isNull(), "no_html").otherwise(X.text_status(chunking.html_text(F.col("html")), F.lit(1)))
    judged = materialize(new.withColumn("status", status), "judged")
    chunks = chunking.html_chunks(judged.where("status = 'ok'")).withColumn("tokens", X.token_count(F.col("text")))
    chunks = materialize(chunks, "chunks")  # they are counted and stored
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    docs = judged.select("doc_id", "title", "sha256", "status").join(counts, "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    return docs, chunks


def ingest_html(pages: DataFrame, stored_docs: DataFrame, stored_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks after loading changed pages (doc_id, title, html)."""
    docs, chunks = loaded_pages(pages, stored_docs)
    kept_chunks = stored_chunks.join(docs.select("doc_id"), "doc_id", "left_anti")
    return ingest.replace_by_key(stored_docs, docs, "doc_id"), kept_chunks.unionByName(chunks.select(*stored_chunks.columns))


def ingest_stream(pages: DataFrame, tables: DocumentTables, checkpoint: str) -> list[int]:
    """Loads a stream of pages into tables, batch by batch, until it has no more; returns the buckets written.

    Batches are numbered in the checkpoint. One that was broken off is given again with its number; what it had stored by then is found unchanged or is
    replaced, so each page is there once. A page that comes twice in a batch is taken once, the greatest by its digest.
    """
    written: set[int] = set()

    def load(batch: DataFrame, number: int) -> None:
        once = batch.where("doc_id is not null").withColumn("__h", F.xxhash64("html")).groupBy("doc_id").agg(F.max_by(F.struct(*batch.columns), "__h").alias("p"))
        docs, chunks = loaded_pages(once.select("p.*"), tables.docs())
        docs = materialize(docs, "docs")
        written.update(tables.replace(docs, chunks))
        discard(docs, chunks)

    query = pages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(load).start()
    query.awaitTermination()
    return sorted(written)
