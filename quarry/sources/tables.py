"""Tables of documents and their chunks in hash buckets of the document, of which a write replaces only what it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import ingest
from quarry.sources.files import _file_system
from quarry.session import discard, materialize

BUCKETS = 64


class DocumentTables:
    """path/docs and path/chunks, each in folders bucket=n by a hash of doc_id.

    A replacement reads and overwrites only the buckets of its documents: chunks first, then documents. If it breaks off in between, the documents still have
    their old digests, so the next ingest finds them changed and replaces both. Choose the number of buckets once, so that one fits a few tasks.
    """

    def __init__(self, spark: SparkSession, path: str, docs: T.StructType | str, chunks: T.StructType | str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schemas = {"docs": self._schema(docs), "chunks": self._schema(chunks)}

    @staticmethod
    def _schema(given: T.StructType | str) -> T.StructType:
        return T.StructType.fromDDL(given) if isinstance(given, str) else given

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        schema, at = self.schemas[name], f"{self.path}/{name}"
        fs, place = _file_system(self.spark, at)
        if not fs.exists(place):
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(at)
        return (found if buckets is None else found.where(F.col("bucket").isin(buckets))).drop("bucket")

    def docs(self) -> DataFrame:
        return self._read("docs")

    def chunks(self) -> DataFrame:
        return self._read("chunks")

    def _overwrite(self, name: str, rows: DataFrame, buckets: list[int]) -> None:
        # Written apart first: the folders that are read are those that are replaced.
        kept = materialize(rows.withColumn("bucket", self._bucket()), name)
        writer = kept.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").mode("overwrite")
        writer.parquet(f"{self.path}/{name}")
        # Overwriting replaces buckets that have rows; one that has none left is removed.
        empty = set(buckets) - {r["bucket"] for r in kept.select("bucket").distinct().collect()}
        for n in empty:
            fs, at = _file_system(self.spark, f"{self.path}/{name}/bucket={n}")
            fs.delete(at, True)
        discard(kept)

    def replace(self, docs: DataFrame, chunks: DataFrame) -> list[int]:
        """These documents, and of the chunks those of them, in place of what is stored of the same ids. Returns the buckets that were written."""
        docs = docs.where("doc_id is not null").select(*self.schemas["docs"].names)
        chunks = ingest.on_disk(chunks.select(*self.schemas["chunks"].names), docs, "doc_id").select(*self.schemas["chunks"].names)
        # As many numbers as there are buckets, at most.
        touched = sorted(r[0] for r in docs.select(self._bucket()).distinct().collect())
        for name, new in (("chunks", chunks), ("docs", docs)):
            old = ingest.not_done(self._read(name, touched), docs, "doc_id")
            self._overwrite(name, old.select(*self.schemas[name].names).unionByName(new), touched)
        return touched
