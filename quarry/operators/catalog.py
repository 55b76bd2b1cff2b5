"""The document catalogue: filtered, paged listings and corpus figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WORDS, MAX_QUERY, MAX_LIMIT = 8, 200, 100


def catalogue(documents: DataFrame) -> DataFrame:
    """The catalogue that the documents table stands for: title is the first line, collection the source."""
    return documents.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("collection"),
        F.col("lang").alias("document_type"),
        F.date_add(F.to_date(F.lit("2020-01-01")), (F.col("doc_id") % 365).cast("int")).alias("publication_date"),
        F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 2000)).cast("long").alias("page_count"),
        F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 1600)).cast("long").alias("chunk_count"),
    )


def source_url(doc_id: Column) -> Column:
    """Where an act of this number is published."""
    return F.concat(F.lit("https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:"), doc_id)


def _like(word: str) -> str:
    return "%" + word.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def matching(query: str | None, collection: str | None) -> Column:
    """Rows that hold each of the query's first words in title or id, and are of the collection."""
    if query and len(query) > MAX_QUERY:
        raise ValueError(f"a query has at most {MAX_QUERY} characters")
    good = F.lit(True)
    for word in (query or "").split()[:MAX_WORDS]:
        good = good & (F.coalesce(F.col("title").ilike(_like(word)), F.lit(False)) | F.col("doc_id").ilike(_like(word)))
    return good & (F.col("collection") == collection) if collection else good


def page(docs: DataFrame, query: str | None = None, collection: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page: titles that hold the query early come first, then newest, then by id."""
    if not (1 <= limit <= MAX_LIMIT and offset >= 0):
        raise ValueError(f"limit must be from 1 to {MAX_LIMIT} and offset not negative")
    place = F.coalesce(F.nullif(F.instr(F.lower("title"), (query or "").lower()), F.lit(0)), F.lit(1_000_000))
    return docs.where(matching(query, collection)).orderBy(place, F.desc_nulls_last("publication_date"), "doc_id").offset(offset).limit(limit)


def total(docs: DataFrame, query: str | None = None, collection: str | None = None) -> DataFrame:
    """How many documents the filter of a page takes, in all."""
    return docs.where(matching(query, collection)).agg(F.count(F.lit(1)).alias("total"))


def detail(docs: DataFrame, doc_id: str, files: DataFrame) -> DataFrame:
    """The document of this id, with whether it has a file; files has a column doc_id."""
    has = files.select(F.col("doc_id").alias("__f")).distinct()
    one = docs.where(F.col("doc_id") == doc_id)
    return one.join(has, one["doc_id"] == has["__f"], "left").withColumn("has_file", F.col("__f").isNotNull()).drop("__f")


def collections(docs: DataFrame) -> DataFrame:
    """Over the whole corpus, most documents first, then by name."""
    return docs.groupBy("collection").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "collection")


def corpus_size(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))


def corpus_overview(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents, chunks, vectors and pages, in one row."""
    held = docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"))
    return held.crossJoin(vectors.agg(F.count("embedding").alias("vectors"))).select("documents", "chunks", "vectors", "pages")  # one row by one


def with_topic(acts: DataFrame, part: str) -> DataFrame:
    """Acts that have a topic holding `part`, in any case."""
    return acts.where(F.exists("topics", lambda t: F.contains(F.lower(t), F.lit(part.lower()))))


def with_id_part(acts: DataFrame, part: str, id_col: str = "celex") -> DataFrame:
    return acts.where(F.contains(F.lower(id_col), F.lit(part.lower())))


def acts_summary(acts: DataFrame, megabytes: float = 0.56) -> DataFrame:
    """Counts, years, topic coverage in percent, and size estimate in GB, of acts (celex, type, date, topics)."""
    year = F.substring("date", 1, 4)
    return acts.agg(
        F.count(F.lit(1)).alias("acts"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.round(F.coalesce(100 * F.count_if(F.size("topics") > 0) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)), 1).alias("with_topics"),
        F.round(F.count(F.lit(1)) * megabytes / 1024, 1).alias("gigabytes"),
    )


def distinct_topics(acts: DataFrame) -> DataFrame:
    return acts.select(F.explode("topics").alias("topic")).agg(F.count_distinct("topic").alias("topics"))


def first_acts(acts: DataFrame, n: int, order: str = "celex") -> DataFrame:
    """The first n acts in a stated order."""
    return acts.orderBy(order).limit(n)


def conversations(turns: DataFrame, wanted: Column | None = None) -> DataFrame:
    """(conv_id, title, updated) of turns (conv_id, turn, role, text, at): titled by their first question, last updated first, then by id."""
    from quarry.functions.text import conversation_title

    asked = F.when(F.col("role") == "user", F.struct("turn", "text"))
    listed = turns.groupBy("conv_id").agg(F.min(asked).alias("q"), F.max("at").alias("updated")).select("conv_id", conversation_title(F.col("q.text")).alias("title"), "updated")
    return (listed if wanted is None else listed.where(wanted)).orderBy(F.desc("updated"), "conv_id")


def most_common(frame: DataFrame, value: Column, n: int = 5) -> DataFrame:
    """The n commonest values; blank and null count as '?'."""
    named = F.coalesce(F.nullif(value, F.lit("")), F.lit("?")).alias("value")
    return frame.groupBy(named).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def failure_reasons(failures: DataFrame, n: int = 5) -> DataFrame:
    return most_common(failures, F.substring_index("error", ":", 1), n)
