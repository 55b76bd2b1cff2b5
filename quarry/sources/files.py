"""Files in and out: act lists, formats, questions, shards, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTS = "celex string, type string, date string, title string, topics array<string>, pdf_url string"
DOCUMENTS = (
    "doc_id string, title string, source_url string, source_organization string, document_type string, celex_number string, collection string, "
    "publication_date date, topics array<string>, sha256 string, page_count int, chunk_count int, ingested_at timestamp"
)
CHUNKS = "doc_id string, chunk_index int, text string, page_start int, page_end int, tokens int"
FAILURES = "celex string, error string"


def read_acts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ACTS).json(path)


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FAILURES).json(path)


def read_formats(spark: SparkSession, path: str) -> DataFrame:
    """(celex, format) from one JSON object of arrays."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("celex", "formats")).select("celex", F.explode("formats").alias("format"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One question a line; blank lines and those that start with # are left out."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("question")).where((line != "") & ~line.startswith("#"))


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(doc_id, sha256, content) of files; the id is the name without its ending."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select(stem.alias("doc_id"), F.sha2("content", 256).alias("sha256"), "content")


def page_of(content: Column) -> Column:
    """The markup in the bytes of a page: UTF-8, whatever a page declares, with U+FFFD for what is none, and without an XML declaration."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"^\s*<\?xml[^>]*\?>", "")


def write_shards(frame: DataFrame, path: str, rows_per_file: int = 500) -> None:
    """Files of at most so many rows; readers see all of them or none."""
    frame.write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path)


def write_json_shards(frame: DataFrame, path: str, rows_per_file: int = 500) -> None:
    frame.write.option("maxRecordsPerFile", rows_per_file).option("compression", "gzip").mode("overwrite").json(path)


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, which may be one that only Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _parts_of(spark: SparkSession, path: str, column: str) -> list[int]:
    """The numbers of the folders column=n of a table."""
    fs, at = _file_system(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()] if fs.exists(at) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{column}="))


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        fs, at = _file_system(spark, path)
        fs.delete(at, True)


def write_shards_of(docs: DataFrame, chunks: DataFrame, path: str) -> list[int]:
    """All shards of these documents and chunks, which name theirs in the column `shard`, in one job each; returns their numbers.

    A shard counts by its documents. So those of shards written before go first, then chunks take the place of older ones, then documents are written: a
    write that breaks off leaves shards unfinished, never mixed, and the next one replaces what it left.
    """
    spark = docs.sparkSession
    wanted = sorted(r["shard"] for r in docs.select("shard").union(chunks.select("shard")).distinct().collect())  # a number for each shard
    _remove(spark, [f"{path}/docs/shard={n}" for n in wanted])
    # A shard without chunks keeps none of an older write.
    _remove(spark, [f"{path}/chunks/shard={n}" for n in wanted])
    for frame, name, codec in ((chunks, "chunks", "gzip"), (docs, "docs", "none")):
        frame.repartition("shard").write.option("compression", codec).option("partitionOverwriteMode", "dynamic").partitionBy("shard").mode("overwrite").json(f"{path}/{name}")
    return wanted


def write_shard(docs: DataFrame, chunks: DataFrame, path: str, shard: int) -> None:
    """One shard of the ingest: its chunks, then its documents, in place of what an earlier write left of it."""
    write_shards_of(docs.withColumn("shard", F.lit(shard)), chunks.withColumn("shard", F.lit(shard)), path)


def finished_shards(spark: SparkSession, path: str) -> DataFrame:
    """The numbers of the shards that have their documents, in order. Chunks of others, which a broken-off write left, are removed."""
    done = _parts_of(spark, f"{path}/docs", "shard")
    _remove(spark, [f"{path}/chunks/shard={n}" for n in set(_parts_of(spark, f"{path}/chunks", "shard")) - set(done)])
    return spark.createDataFrame([(n,) for n in done], "shard int")


def read_shard_docs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{DOCUMENTS}, shard int").json(f"{path}/docs")


def read_shard_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of finished shards; those of shards whose writing broke off are passed over."""
    chunks = spark.read.schema(f"{CHUNKS}, shard int").json(f"{path}/chunks")
    return chunks.where(F.col("shard").isin(_parts_of(spark, f"{path}/docs", "shard")))


def done_documents(spark: SparkSession, path: str) -> DataFrame:
    return read_shard_docs(spark, path).select("doc_id").distinct()


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors (doc_id, chunk_index, vec) by key, as arrays of 32-bit floats; readers see all of them or none."""
    vectors.select("doc_id", "chunk_index", F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id string, chunk_index int, vec array<float>").parquet(path)


def write_report(frame: DataFrame, path: str) -> None:
    """A small table as CSV with a header."""
    frame.coalesce(1).write.option("header", True).mode("overwrite").csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends requests, with an error text for statuses from 400 on."""
    error = F.when(F.col("status_code") >= 400, F.concat(F.lit("HTTP "), F.col("status_code")))
    rows.withColumn("error", error).write.mode("append").parquet(path)
