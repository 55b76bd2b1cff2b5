"""Shards, bucketed tables, bytes of pages and the resumed ingest, with writes that break off."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.plans import answer
from quarry.sources import files
from quarry.sources.tables import DocumentTables

DOCS = "doc_id string, title string, sha256 string, status string, chunk_count long"
CHUNKS = "doc_id string, chunk_index int, section string, label string, text string, tokens int"
LAW = "<p>" + "the law of the union and of its members " * 12 + "</p>"


def test_a_shard_written_again_counts_once(spark, tmp_path):
    path = str(tmp_path / "work")
    docs = spark.createDataFrame([("d1",)], "doc_id string")
    chunks = spark.createDataFrame([("d1", 0, "x")], "doc_id string, chunk_index int, text string")
    # Broken off after its chunks; then retried; then written anew.
    chunks.withColumn("shard", F.lit(3)).write.partitionBy("shard").mode("append").json(f"{path}/chunks")
    for _ in range(2):
        files.write_shard(docs, chunks, path, 3)
        assert files.read_shard_chunks(spark, path).count() == files.read_shard_docs(spark, path).count() == 1
    both = docs.withColumn("shard", F.lit(4)).union(docs.withColumn("shard", F.lit(5)))
    assert files.write_shards_of(both, chunks.withColumn("shard", F.lit(4)), path) == [4, 5]
    chunks.withColumn("shard", F.lit(9)).write.partitionBy("shard").mode("append").json(f"{path}/chunks")
    assert (tmp_path / "work" / "chunks" / "shard=9").exists()
    assert [r["shard"] for r in files.finished_shards(spark, path).collect()] == [3, 4, 5]
    assert not (tmp_path / "work" / "chunks" / "shard=9").exists() and files.read_shard_chunks(spark, path).count() == 2
    assert files.finished_shards(spark, str(tmp_path / "none")).count() == 0


def test_bytes_of_pages(spark):
    pages = [b"\xef\xbb\xbf<p>GR\xc3\x89GOIRE</p>", b"  <?xml version='1.0' encoding='iso-8859-1'?><p>GR\xc3\x89GOIRE</p>", b"<p>GR\xc9GOIRE \xff\xfe \xe2\x82</p>", b"", None]
    frame = spark.createDataFrame([(i, bytearray(p) if p is not None else None) for i, p in enumerate(pages)], "i int, content binary")
    got = [r["p"] for r in frame.orderBy("i").select(files.page_of(F.col("content")).alias("p")).collect()]
    import re

    want = [None if p is None else re.sub(r"^\s*<\?xml[^>]*\?>", "", p.decode("utf-8", errors="replace")) for p in pages]
    assert got == want


def contents(folder):
    return {p.name: sorted((f.name, f.stat().st_mtime_ns) for f in p.iterdir()) for p in folder.iterdir() if p.is_dir()}


def tables_at(spark, path):
    return DocumentTables(spark, str(path), DOCS, CHUNKS, buckets=8)


def test_only_touched_buckets_are_replaced(spark, tmp_path):
    tables = tables_at(spark, tmp_path)
    docs = spark.createDataFrame([(f"d{i}", "t", "h1", "ok", 2) for i in range(40)], DOCS)
    chunks = spark.createDataFrame([(f"d{i}", k, "", "", "x", 1) for i in range(40) for k in (0, 1)], CHUNKS)
    assert tables.docs().count() == 0
    tables.replace(docs, chunks)
    before = contents(tmp_path / "chunks")
    new = spark.createDataFrame([("d7", "t", "h2", "ok", 1)], DOCS)
    written = tables.replace(new, spark.createDataFrame([("d7", 0, "", "", "new", 1), ("other", 0, "", "", "stray", 1)], CHUNKS))
    after = contents(tmp_path / "chunks")
    assert len(written) == 1 and {n for n in before if before[n] != after[n]} == {f"bucket={written[0]}"}
    assert tables.docs().count() == 40 and tables.chunks().count() == 79
    assert [r["text"] for r in tables.chunks().where("doc_id = 'd7'").collect()] == ["new"]
    # A document without chunks leaves none.
    tables.replace(spark.createDataFrame([("d7", "t", "h3", "no_text", 0)], DOCS), spark.createDataFrame([], CHUNKS))
    assert tables.chunks().where("doc_id = 'd7'").count() == 0 and tables.chunks().count() == 78


def test_a_replacement_broken_off_is_repaired_by_the_next(spark, tmp_path, monkeypatch):
    tables = tables_at(spark, tmp_path)
    pages = lambda word: spark.createDataFrame([(f"d{i}", "T", LAW.replace("union", word if i == 2 else "union")) for i in range(6)], "doc_id string, title string, html string")
    tables.replace(*answer.loaded_pages(pages("union"), tables.docs()))
    overwrite = DocumentTables._overwrite

    def stop(self, name, rows, buckets):
        if name == "docs":
            raise RuntimeError("broken off")
        overwrite(self, name, rows, buckets)

    monkeypatch.setattr(DocumentTables, "_overwrite", stop)
    with pytest.raises(RuntimeError):
        tables.replace(*answer.loaded_pages(pages("community"), tables.docs()))
    monkeypatch.undo()
    docs, chunks = answer.loaded_pages(pages("community"), tables.docs())
    assert [r["doc_id"] for r in docs.collect()] == ["d2"]
    assert len(tables.replace(docs, chunks)) == 1
    stored = {r["doc_id"]: r["chunk_count"] for r in tables.docs().collect()}
    assert stored == {r["doc_id"]: r["count"] for r in tables.chunks().groupBy("doc_id").count().collect()} and len(stored) == 6
    assert "community" in tables.chunks().where("doc_id = 'd2'").first()["text"]
    assert answer.loaded_pages(pages("community"), tables.docs())[0].count() == 0


def test_ingest_resumes_where_it_was_broken_off(spark, tmp_path, monkeypatch):
    tables = tables_at(spark, tmp_path / "out")
    schema = "doc_id string, title string, html binary"
    for n in range(3):
        rows = [(f"d{n}{i}", "T", bytearray(LAW.replace("law", f"law{n}{i}").encode())) for i in range(4)] + [("d00", "T", bytearray(LAW.encode()))] * n
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    replace, calls = DocumentTables.replace, []

    def broken(self, docs, chunks):
        out = replace(self, docs, chunks)
        calls.append(out)
        if len(calls) == 2:
            raise RuntimeError("broken off")
        return out

    monkeypatch.setattr(DocumentTables, "replace", broken)
    with pytest.raises(Exception):
        answer.ingest_stream(stream(), tables, str(tmp_path / "state"))
    assert 0 < tables.docs().count() < 12
    monkeypatch.undo()
    answer.ingest_stream(stream(), tables, str(tmp_path / "state"))
    ids = [r["doc_id"] for r in tables.docs().collect()]
    assert sorted(ids) == sorted(f"d{n}{i}" for n in range(3) for i in range(4))
    counts = tables.chunks().groupBy("doc_id", "chunk_index").count().where("count > 1")
    assert counts.count() == 0 and tables.chunks().select("doc_id").distinct().count() == 12
    assert answer.ingest_stream(stream(), tables, str(tmp_path / "state")) == []


def test_passages_without_title_or_pages(spark):
    one = spark.range(1)
    passage = lambda title, a, b: one.select(X.source_passage(F.lit(1), F.lit(title).cast("string"), F.lit("D"), F.lit(a).cast("int"), F.lit(b).cast("int"), F.lit("x")).alias("p")).first()["p"]
    assert passage("T", 2, 2) == "[1] T (page 2)\nx" and passage("T", 2, 3) == "[1] T (pages 2-3)\nx"
    assert passage("", 2, 2) == "[1] D (page 2)\nx" == passage(None, 2, 2) and passage("T", None, None) == "[1] T\nx"
