"""The ingest lifecycle: listing, change detection, replacement by key, page filling, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key in the order given."""
    first = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def act_list(found: DataFrame, topics: DataFrame) -> DataFrame:
    """Acts (celex, type uri, date, title, pdf_url) once each, with their sorted topics (celex, topic)."""
    labels = topics.groupBy("celex").agg(F.sort_array(F.collect_set("topic")).alias("topics"))
    named = first_per_key(found, "celex", "date", "title", "pdf_url").withColumn("type", F.substring_index("type", "/", -1))
    return named.join(labels, "celex", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


def formats_of(acts: DataFrame, formats: DataFrame) -> DataFrame:
    """Each act's formats, sorted, and which HTML to fetch: xhtml, else html, else none."""
    sets = formats.groupBy("celex").agg(F.sort_array(F.collect_set("format")).alias("formats"))
    joined = acts.join(sets, "celex", "left").withColumn("formats", F.coalesce("formats", F.array().cast("array<string>")))
    kind = F.when(F.array_contains("formats", "xhtml"), "xhtml").when(F.array_contains("formats", "html"), "html")
    return joined.withColumn("html_kind", kind)


def candidate_urls(pdf_url: Column, n: int = 4) -> Column:
    """The URLs of an act's documents DOC_1 to DOC_n."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(pdf_url, F.lit("/DOC_"), i))


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def on_disk(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    return rows.join(files.select(key).distinct(), key, "left_semi")


def changed(new: DataFrame, stored: DataFrame, key: str = "doc_id", digest: str = "sha256", force: bool = False) -> DataFrame:
    """Usable rows of `new` that are not stored, or stored with another digest."""
    if "status" in new.columns:
        new = new.where("status = 'ok'")
    old = stored.select(F.col(key).alias("__k"), F.col(digest).alias("__d"))
    joined = new.join(old, new[key] == old["__k"], "left")
    return joined.where(F.lit(force) | F.col("__k").isNull() | ~F.col(digest).eqNullSafe(F.col("__d"))).drop("__k", "__d")


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with all rows of new's keys replaced by new's rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def first_source(preferred: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Rows of the preferred table, and of the fallback those of keys that the preferred one lacks."""
    return preferred.unionByName(fallback.join(preferred.select(key).distinct(), key, "left_anti"))


def require_matching_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Row counts of both tables by key; fails where they differ."""
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("left_n")).join(right.groupBy(key).agg(F.count(F.lit(1)).alias("right_n")), key, "full_outer")
    same = F.coalesce("left_n", F.lit(0)) == F.coalesce("right_n", F.lit(0))
    return counts.where(F.assert_true(same, F.concat(F.lit("counts differ for "), F.col(key).cast("string"))).isNull())


def require_dimension(vectors: DataFrame, column: str, size: int) -> DataFrame:
    fits = F.coalesce(F.size(column) == size, F.lit(False))
    return vectors.where(F.assert_true(fits, F.lit(f"{column} must have {size} components")).isNull())


def join_vectors(chunks: DataFrame, vectors: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Chunks of the wanted documents with their vectors, by key."""
    return chunks.join(vectors, keys).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")


def fill_pages(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks with the pages found for them: `found` has doc_id and pages, an array of (start, end) by chunk index; start 0 is not found."""
    at = found.select("doc_id", F.posexplode("pages").alias("chunk_index", "p"))
    joined = chunks.join(at, ["doc_id", "chunk_index"], "left")
    placed = F.col("p.start") > 0
    return joined.withColumns({f"page_{e}": F.when(placed, F.col(f"p.{e}")).otherwise(F.col(f"page_{e}")) for e in ("start", "end")}).drop("p")


def placed_share(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.round(F.coalesce(F.avg((F.col("page_start") > 0).cast("double")), F.lit(0.0)), 4).alias("placed"))


def chunk_statistics(docs: DataFrame, chunks: DataFrame, max_tokens: int) -> DataFrame:
    """Documents and their statuses, chunks per usable document, and median, nearest-rank 95th percentile and maximum of tokens.

    The percentile is the value at place int(0.95 n) in ascending order. It is read from counts by token number, which are few, not from a sorted table.
    """
    of_docs = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "ok").alias("usable"))
    counts = chunks.where("tokens is not null").groupBy("tokens").agg(F.count(F.lit(1)).alias("c"))
    run = Window.orderBy("tokens").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(run)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = F.greatest(F.lit(1), F.floor(F.col("n") * 0.95))
    # The median's two places, the same for an odd number.
    low, high = F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)
    least = lambda place: F.min(F.when(F.col("upto") >= place, F.col("tokens")))
    p95 = ranked.agg(least(at).cast("long").alias("tokens_p95"), ((least(low) + least(high)) / 2).alias("tokens_median"))
    of_chunks = chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.max("tokens").cast("long").alias("tokens_max"),
        F.count_if(F.col("tokens") > max_tokens).alias("too_long"),
    )
    one = of_docs.crossJoin(of_chunks).crossJoin(p95)  # one row each
    per = F.round(F.coalesce(F.col("chunks") / F.nullif(F.col("usable"), F.lit(0)), F.lit(0.0)), 1)
    return one.withColumn("chunks_per_document", per)


def status_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def progress(acts: DataFrame, files: DataFrame, docs: DataFrame, embedded: DataFrame) -> DataFrame:
    """How many acts, files, documents, chunks and embedded chunks there are. Embedded chunks are counted by the documents' chunk counts."""
    one = acts.agg(F.count(F.lit(1)).alias("acts"))
    one = one.crossJoin(files.agg(F.count(F.lit(1)).alias("files")))
    one = one.crossJoin(docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks")))
    with_vectors = docs.join(embedded.select("doc_id").distinct(), "doc_id", "left_semi")
    return one.crossJoin(with_vectors.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("embedded_chunks")))


def content_classes(docs: DataFrame) -> DataFrame:
    """Texts that several documents share, by digest."""
    return docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
