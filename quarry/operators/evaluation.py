"""Retrieval quality: first correct ranks, Hit and MRR, recall, piles, and passages matched by shared runs of letters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import letters
from quarry.operators import kernels
from quarry.operators.analytics import percentiles
from quarry.session import materialize

RUN = 120


def first_ranks(questions: DataFrame, ranked: DataFrame, correct: Column) -> DataFrame:
    """(q_id, first): the first correct rank of every question, null where there is none."""
    found = ranked.where(correct).groupBy("q_id").agg(F.min("rank").alias("first"))
    return questions.select("q_id").distinct().join(found, "q_id", "left")


def hit_and_mrr(ranks: DataFrame, depths: tuple[int, ...], k: int) -> DataFrame:
    """Hit at each depth and MRR at k over all questions."""
    hits = [F.round(F.coalesce(F.avg((F.coalesce(F.col("first"), F.lit(2**30)) <= d).cast("double")), F.lit(0.0)), 6).alias(f"hit_{d}") for d in depths]
    reciprocal = F.when(F.col("first") <= k, F.lit(1.0) / F.col("first")).otherwise(F.lit(0.0))
    return ranks.agg(F.count(F.lit(1)).alias("questions"), *hits, F.round(F.coalesce(F.avg(reciprocal), F.lit(0.0)), 6).alias(f"mrr_{k}"))


def recall_at(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Mean share of each question's true top k that was found."""
    ids = lambda f, n: f.where(F.col("rank") <= k).groupBy("q_id").agg(F.collect_set("id").alias(n))  # noqa: E731  k ids at most
    both = ids(truth, "t").join(ids(found, "f"), "q_id", "left")
    share = F.size(F.array_intersect("t", F.coalesce("f", F.array().cast("array<bigint>")))) / F.size("t")
    return both.agg(F.round(F.avg(share), 6).alias("recall"))


def pile(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Candidates of each question (q_id, id): those ranked and those that are gold, once each."""
    return ranked.select("q_id", "id").union(gold.select("q_id", "id")).distinct()


def pile_documents(piles: DataFrame, chunks: DataFrame) -> DataFrame:
    return chunks.join(piles.select("id").distinct(), "id", "left_semi").select("doc_id").distinct()


def first_seen(piles: DataFrame) -> DataFrame:
    """Distinct candidates with the place where each occurs first."""
    return piles.groupBy("id").agg(F.min(F.struct("q_id", "rank")).alias("at")).select("id", "at.q_id", "at.rank")


def reachable(golden: DataFrame, documents: DataFrame) -> DataFrame:
    """Answerable questions (id, answerable, doc_ids) of which some gold document is in the corpus."""
    gold = golden.where("answerable").select("id", F.explode("doc_ids").alias("doc_id"))
    return gold.join(documents.select("doc_id").distinct(), "doc_id", "left_semi").select("id").distinct()


def gold_texts(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, chunk_id, text) of the gold chunks of each question."""
    return golden.select("id", F.explode("chunk_ids").alias("chunk_id")).join(chunks, "chunk_id").select("id", "chunk_id", "text")


#: Bits of the bitmap of the passages' anchors at most (8 MB), and rows of an anchor that meet in one place.
FILTER_BITS, SALT = 1 << 26, 2_000


def _anchored(frame: DataFrame, key: str, run: int, fill: int, bits=None) -> DataFrame:
    """(key, g, near): the anchors of each text and their surroundings, once each a text. bits: a bitmap of the anchors that count."""
    kind = frame.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if bits is None else bits.value
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                letters_of = text.encode()
                at, h = kernels.anchors(letters_of, run)
                g = h.view(np.int64)
                if held is not None:
                    place = g & (8 * len(held) - 1)
                    good = (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                    at, g = at[good], g[good]
                for a in range(0, len(at), 10_000):
                    near = {(int(x), row.tobytes()) for x, row in zip(g[a : a + 10_000], kernels.surroundings(letters_of, at[a : a + 10_000], run, fill), strict=True)}
                    own = batch.column(0).slice(k, 1).take(pa.array(np.zeros(len(near), np.int64)))
                    yield pa.RecordBatch.from_arrays([own, pa.array([x for x, _ in near], pa.int64()), pa.array([x for _, x in near], pa.binary())], [key, "g", "near"])

    texts = frame.where(f"{key} is not null").select(key, letters(F.col("text")).alias("t")).where(F.length("t") >= run)
    return texts.mapInArrow(rows, f"{key} {kind}, g long, near binary")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes g, about eight for each, FILTER_BITS at most."""
    bits = min(FILTER_BITS, 1 << max(15, (8 * hashes.count()).bit_length()))
    place = hashes.select(F.col("g").bitwiseAND(bits - 1).alias("at")).select(F.floor(F.col("at") / 32768).alias("row"), F.col("at").bitwiseAND(32767).alias("bit"))
    out = np.zeros(bits // 8, np.uint8)
    for r in place.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("map")).collect():
        out[4096 * r["row"] : 4096 * (r["row"] + 1)] = np.frombuffer(r["map"], np.uint8)
    return out


def shared_runs(passages: DataFrame, documents: DataFrame, run: int = RUN) -> DataFrame:
    """(p_id, doc_id): pairs of passage (p_id, text) and document (doc_id, text) that share `run` letters in a row.

    Letters are lower-case ASCII letters and digits. A run has an anchor, its letters of least hash, the same in both texts; so texts meet by their anchors,
    about one for each fifty letters, with all that a run over one can hold, and are compared there letter by letter. Documents send only anchors that passages
    may have, by a bitmap. An anchor of many documents is dealt to several places, to each of which its passages go; equal surroundings are compared once.
    """
    spark = documents.sparkSession
    asked = materialize(_anchored(passages, "p_id", run, 0), "passage-anchors")
    bits = spark.sparkContext.broadcast(_bitmap(asked.select("g").distinct()))
    held = materialize(_anchored(documents, "doc_id", run, 1, bits), "document-anchors")
    texts = held.groupBy("g", "near").agg(F.count(F.lit(1)).alias("n"))
    salts = texts.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / SALT).alias("salts"))
    dealt = texts.join(salts, "g").select("g", F.pmod(F.xxhash64("near"), "salts").alias("salt"), "near")
    wanted = asked.select("g", F.col("near").alias("p")).distinct().join(salts, "g")
    wanted = wanted.select("g", "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 * run - kernels.GRAM
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, width) for i in (1, 2))
            yield batch.filter(pa.array(kernels.runs_over(a, b, run)))

    # Sizes are estimated before the texts are cut, so a broadcast would go unchecked.
    alike = dealt.hint("merge").join(wanted, ["g", "salt"]).select("g", "p", F.col("near").alias("d")).mapInArrow(compare, "g long, p binary, d binary")
    alike = materialize(alike, "alike")
    of_passage = alike.join(asked.withColumnRenamed("near", "p"), ["g", "p"]).select("g", "d", "p_id").distinct()
    pairs = of_passage.join(held.withColumnRenamed("near", "d"), ["g", "d"]).select("p_id", "doc_id").distinct()
    return pairs


def latency_summary(times: DataFrame) -> DataFrame:
    """p50, p95, min, max and mean over questions of the median of each one's repeats (q_id, ms)."""
    of_question = percentiles(times, ["q_id"], "ms", (0.5,)).select(F.lit(0).alias("all"), F.get("p", F.lit(0)).alias("m"))
    p = percentiles(of_question, ["all"], "m", (0.5, 0.95))
    rest = of_question.agg(F.min("m").alias("min_ms"), F.max("m").alias("max_ms"), F.avg("m").alias("mean_ms"))
    return rest.join(p, F.lit(True), "left").select(  # one row by one
        F.round(F.col("p")[0], 3).alias("p50_ms"), F.round(F.col("p")[1], 3).alias("p95_ms"), *(F.round(f"{n}_ms", 3).alias(f"{n}_ms") for n in ("min", "max", "mean"))
    )


def context_length(ranked: DataFrame, k: int) -> DataFrame:
    """Mean over questions of the characters in the first k texts."""
    sums = ranked.where(F.col("rank") <= k).groupBy("q_id").agg(F.sum(F.length("text")).alias("n"))
    return sums.agg(F.round(F.avg("n"), 2).alias("context_chars"))


def score_means(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """Means of judged metrics, nulls left out."""
    return scores.agg(*(F.round(F.avg(m), 4).alias(m) for m in metrics))


def ranked_by(scores: DataFrame) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "id")))
