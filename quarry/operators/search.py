"""Batch retrieval: exact and approximate top-k, caps, reranking, citations, semantic cache.

A batch of questions is a DataFrame (q_id, q_vec). Its size is checked before it is broadcast; beyond `MAX_BROADCAST` questions, blocks of questions meet
blocks of vectors in tiles, and neither side is ever held whole. All scoring is by matrix products over blocks; no row is made for a pair,
except in `search_native` for up to `MAX_PAIRS` pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import cited_numbers
from quarry.functions.vectors import dot
from quarry.operators.kernels import DIGITS, Graph, TopK, matrix
from quarry.session import materialize

MAX_BROADCAST = 10_000
#: Pairs that may stand as rows.
MAX_PAIRS = 1_000_000
BLOCK = 2048
TILE = 16
OVERFETCH = 3
#: Vectors of a graph, links of a vector, and candidates for its links.
GRAPH_PART, DEGREE, POOL = 16_384, 32, 64
FOUND = "q_id long, id long, score double"

#: Adds what a packed row (ids, vecs, links) has for some questions to their best so far.
Visit = Callable[[TopK, np.ndarray, bytes, bytes, bytes | None], None]


def _few(questions: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and vectors of the questions, or None if there are too many to send to every task."""
    rows = questions.select("q_id", "q_vec").limit(MAX_BROADCAST + 1).collect()
    if len(rows) > MAX_BROADCAST:
        return None
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)


def _packed(frame: DataFrame, size: int) -> DataFrame:
    """Blocks (ids, vecs, links) of up to `size` rows of an id and a vector, as doubles; links are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                row = [pa.array([x], pa.binary()) for x in (part.column(0).to_numpy().astype(np.int64).tobytes(), matrix(part.column(1)).tobytes(), None)]
                yield pa.RecordBatch.from_arrays(row, ["ids", "vecs", "links"])

    return frame.mapInArrow(run, "ids binary, vecs binary, links binary")


def _scan(best: TopK, q: np.ndarray, ids: bytes, vecs: bytes, links: bytes | None) -> None:
    own = np.frombuffer(ids, np.int64)
    best.add(q, own, np.frombuffer(vecs).reshape(len(own), -1))


def _search_tiles(rows: DataFrame, questions: DataFrame, k: int, visit: Visit, per_tile: int) -> DataFrame:
    """Packed rows meet blocks of questions in tiles of about TILE blocks of questions by per_tile rows, each tile a key of its own.

    A block moves once for each tile of the other side. A tile's questions are held, its rows stream past them, and k rows a question leave it.
    """
    across, down = max(1, -(-questions.count() // (BLOCK * TILE))), max(1, -(-rows.count() // per_tile))

    def dealt(frame: DataFrame, kind: int, own: str, tiles: int, other: str, others: int) -> DataFrame:
        number, copies = F.pmod(F.xxhash64("ids"), F.lit(tiles)), F.sequence(F.lit(0), F.lit(others - 1))
        spread = frame.select(number.cast("int").alias(own), "ids", "vecs", "links", F.lit(kind).alias("kind"), F.explode(copies).alias(other))
        return spread.select("down", "across", "kind", "ids", "vecs", "links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[:2] != tile:
                    yield from (best.batch() for best, _ in held)
                    tile, held = row[:2], []
                if row[2] == 0:
                    ids = np.frombuffer(row[3], np.int64)
                    held.append((TopK(ids, k), np.frombuffer(row[4]).reshape(len(ids), -1)))
                    continue
                for best, q in held:
                    visit(best, q, *row[3:])
        yield from (best.batch() for best, _ in held)

    asked = dealt(_packed(questions.select("q_id", "q_vec"), BLOCK), 0, "across", across, "down", down)
    searched = dealt(rows.select("ids", "vecs", "links"), 1, "down", down, "across", across)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = asked.union(searched).repartition(parts, "down", "across").sortWithinPartitions("down", "across", "kind")
    return tiles.mapInArrow(run, FOUND)


def top_k(candidates: DataFrame, k: int) -> DataFrame:
    """The k best rows of each question by score, ties by id, with their rank."""
    best = Window.partitionBy("q_id").orderBy(F.desc("score"), "id")
    return candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search_exact(vectors: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(q_id, id, score, rank) for unit vectors (id, vec), without the question's own id.

    Each task keeps the k best of each question while its vectors stream past, so the shuffle sees k rows for each task and question.
    """
    usable = vectors.where("id is not null and vec is not null").select("id", "vec")
    few = _few(questions)
    if few is None:
        return top_k(_search_tiles(_packed(usable, BLOCK), questions, k, _scan, TILE), k)
    q_ids, q = few

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = TopK(q_ids, k)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                best.add(q, part.column(0).to_numpy().astype(np.int64), matrix(part.column(1)))
        yield best.batch()

    return top_k(usable.mapInArrow(run, FOUND), k)


def search_native(vectors: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The same with JVM expressions only, a row for each pair, for up to MAX_PAIRS pairs. Beyond them blocks meet questions, as in search_exact.

    Questions without a vector have no score with any vector and keep to pairs at every size.
    """
    if vectors.count() * questions.count() <= MAX_PAIRS:
        return _search_pairs(vectors, questions, k)
    known = search_exact(vectors, questions.where("q_id is not null and q_vec is not null"), k)
    return known.unionByName(_search_pairs(vectors, questions.where("q_vec is null"), k))


def _search_pairs(vectors: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    pairs = vectors.join(F.broadcast(questions), F.col("id") != F.col("q_id"))
    return top_k(pairs.select("q_id", "id", F.round(dot(F.col("vec"), F.col("q_vec")), DIGITS).alias("score")), k)


def cap_class(ranked: DataFrame, in_class: Column, most: int, k: int) -> DataFrame:
    """Of each question's rows in rank order, at most `most` of a class; then the first k, ranked anew."""
    so_far = Window.partitionBy("q_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = ranked.withColumn("__n", F.sum(in_class.cast("int")).over(so_far)).where(~in_class | (F.col("__n") <= most))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("rank"))).where(F.col("rank") <= k).drop("__n")


def search_capped(vectors: DataFrame, questions: DataFrame, in_class: Column, most: int, k: int) -> DataFrame:
    """Top-k with a cap: k * OVERFETCH rows are fetched, so a question may get fewer than k. Attributes join after the top-k."""
    best = search_exact(vectors, questions, k * OVERFETCH)
    return cap_class(best.join(vectors.drop("vec"), "id"), in_class, most, k)


def rerank(ranked: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best by another score, ties keeping the earlier rank. Null scores count as 0."""
    best = Window.partitionBy("q_id").orderBy(F.coalesce(score, F.lit(0.0)).desc(), "rank")
    return ranked.withColumn("new_rank", F.row_number().over(best)).where(F.col("new_rank") <= k)


def lexical_overlap(question: Column, passage: Column) -> Column:
    """The default reranker: how many of the question's distinct words the passage has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(question), words(passage))).cast("double")


def citations(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(q_id, place, n, ...): passages cited in answers (q_id, answer), in order of first mention; numbers without a passage drop out."""
    cited = answers.select("q_id", F.posexplode(cited_numbers(F.col("answer"))).alias("place", "n"))
    return cited.join(passages.withColumnRenamed("rank", "n"), ["q_id", "n"])


def evict(entries: DataFrame, now: Column, ttl_seconds: int, size: int) -> DataFrame:
    """Entries (scope, id, at) not older than the limit, and of these the newest `size` of each scope."""
    fresh = entries.where(F.col("at") > now - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    newest = Window.partitionBy("scope").orderBy(F.desc("at"), F.desc("id"))
    return fresh.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= size).drop("place")


def grouped_blocks(frame: DataFrame, size: int | None = None) -> DataFrame:
    """Rows (g, id, vec) as blocks (g, ids, vecs) of about `size` rows of one group; a large group is many blocks, dealt by their own numbers."""
    size = size or BLOCK
    kind = frame.schema["g"].dataType
    pieces = frame.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / size).alias("pieces"))
    placed = frame.join(pieces, "g").select("g", F.pmod(F.xxhash64("id"), "pieces").alias("piece"), "id", F.col("vec").cast("array<double>").alias("vec"))
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField("g", kind), T.StructField("ids", T.BinaryType()), T.StructField("vecs", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def block() -> pa.RecordBatch:
            ids, vecs = (np.concatenate(c).tobytes() for c in zip(*(x[1:] for x in held), strict=True))
            return pa.RecordBatch.from_arrays([held[0][0], pa.array([ids], pa.binary()), pa.array([vecs], pa.binary())], ["g", "ids", "vecs"])

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and keys[a] != key:
                    yield block()
                    held = []
                key, part = keys[a], batch.slice(a, b - a)
                held.append((part.column(0).slice(0, 1), part.column(2).to_numpy().astype(np.int64), matrix(part.column(3))))
        if held:
            yield block()

    return placed.repartition(parts, "g", "piece").sortWithinPartitions("g", "piece").mapInArrow(run, schema)


def search_groups(asked: DataFrame, stored: DataFrame, k: int, own: bool = False) -> DataFrame:
    """(q_id, id, score): the k best ids of a question's group from each pair of blocks (g, ids, vecs) that meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q, ids, vecs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                best = TopK(np.frombuffer(q_ids, np.int64), k, own)
                _scan(best, np.frombuffer(q).reshape(len(best.q_ids), -1), ids, vecs, None)
                yield best.batch()

    pairs = asked.select("g", F.col("ids").alias("q_ids"), F.col("vecs").alias("q")).join(stored.select("g", "ids", "vecs"), "g")
    return pairs.select("q_ids", "q", "ids", "vecs").mapInArrow(run, FOUND)


def cache_hits(lookups: DataFrame, stored: DataFrame, threshold: float) -> DataFrame:
    """(id, hit, score): for each lookup (id, scope, vec) the most similar stored question of its scope, if similar enough.

    Lookups and stored questions of a scope meet in blocks, so a scope of any size is many tasks, and a lookup leaves a row for each block it met.
    """
    asked, held = (grouped_blocks(f.where("scope is not null and vec is not null").select(F.col("scope").alias("g"), "id", "vec")) for f in (lookups, stored))
    best = search_groups(asked, held, 1, own=True).groupBy("q_id").agg(F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("b"))
    return best.where(F.col("b.score") >= threshold).select(F.col("q_id").alias("id"), (-F.col("b.neg")).alias("hit"), F.col("b.score").alias("score"))


class InvertedLists:
    """Approximate search: vectors are kept by nearest centroid, and a question looks into its `probes` nearest lists.

    Centroids are fitted on at most `sample` vectors by hash order; their number follows the table's size unless it is given. Every vector is indexed,
    once, in blocks; a long list is many blocks.
    """

    def __init__(self, vectors: DataFrame, lists: int | None = None, sample: int = 20_000, seed: int = 7):
        lists = lists or max(8, min(4096, int(vectors.count() ** 0.5 / 2)))
        drawn = vectors.orderBy(F.xxhash64("id")).limit(sample).select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
        self.centroids = np.array(KMeans(k=lists, seed=seed, maxIter=10).fit(drawn).clusterCenters())
        self.indexed = materialize(grouped_blocks(self._listed(vectors.select("id", "vec"), 1)), "lists")

    def _listed(self, frame: DataFrame, probes: int) -> DataFrame:
        """(g, id, vec): a row for each of the nearest lists."""
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(start, BLOCK)
                    lists = np.argsort((centroids**2).sum(1)[None, :] - 2 * matrix(part.column(1)) @ centroids.T, axis=1, kind="stable")[:, :probes]
                    rows = pa.array(np.repeat(np.arange(part.num_rows), lists.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(lists.reshape(-1).astype(np.int32)), part.column(0).take(rows), part.column(1).take(rows)], ["g", "id", "vec"])

        named = frame.toDF("id", "vec").where("id is not null and vec is not null")
        return named.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "g int, id long, vec array<double>")

    def search(self, questions: DataFrame, k: int, probes: int) -> DataFrame:
        """(q_id, id, score, rank): exact scores within the `probes` lists nearest to each question."""
        asked = grouped_blocks(self._listed(questions.select("q_id", "q_vec"), probes))
        return top_k(search_groups(asked, self.indexed, k), k)


class GraphIndex:
    """Approximate search in navigable neighbour graphs, one for each part of about `part` vectors, merged over parts.

    Parts are dealt by a hash of the id, so each looks like the whole and a question takes a short walk in each. A part's graph is built in one task, which
    compares the vectors of the part only, so building grows with the table. Graphs are written once and read by each search.
    """

    def __init__(self, vectors: DataFrame, part: int = GRAPH_PART, degree: int = DEGREE, pool: int = POOL):
        usable = vectors.where("id is not null and vec is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec"))
        parts = max(1, -(-usable.count() // part))

        def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
            graph = Graph.build(x, degree, pool)
            links = np.concatenate((np.array([degree], np.int32), graph.neighbours.reshape(-1), graph.entries))
            return pa.RecordBatch.from_arrays([pa.array([b.tobytes()], pa.binary()) for b in (ids, graph.x, links)], ["ids", "vecs", "links"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                for start in range(0, batch.num_rows, part):
                    own = batch.slice(start, part)
                    held.append((own.column(0).to_numpy().astype(np.int64), matrix(own.column(1))))
                    n += own.num_rows
                    if n >= 2 * part:
                        yield packed(held)
                        held, n = [], 0
            if held:
                yield packed(held)

        dealt = usable.repartition(parts, F.xxhash64("id"))
        self.indexed = materialize(dealt.mapInArrow(run, "ids binary, vecs binary, links binary"), "graphs")

    @staticmethod
    def _open(ids: bytes, vecs: bytes, links: bytes) -> tuple[np.ndarray, Graph]:
        own, flat = np.frombuffer(ids, np.int64), np.frombuffer(links, np.int32)
        end = 1 + len(own) * int(flat[0])
        return own, Graph(np.frombuffer(vecs, np.float32).reshape(len(own), -1), flat[1:end].reshape(len(own), -1), flat[end:])

    def search(self, questions: DataFrame, k: int, ef: int) -> DataFrame:
        """(q_id, id, score, rank): the best met by walks that hold the `ef` best so far in each part. Scores are exact."""
        few, opened = _few(questions), self._open

        def visit(best: TopK, q: np.ndarray, ids: bytes, vecs: bytes, links: bytes | None) -> None:
            own, graph = opened(ids, vecs, links)
            places, scores, _ = graph.search(q, max(ef, k + 1))
            rows, cols = np.nonzero(places >= 0)
            at = places[rows, cols]
            step = max(1, (1 << 22) // q.shape[1])
            exact = [np.einsum("rd,rd->r", q[rows[a : a + step]], graph.x[at[a : a + step]].astype(np.float64)) for a in range(0, len(rows), step)]
            best.offer_lists(rows, own[at], np.concatenate(exact) if exact else np.zeros(0))

        if few is None:
            return top_k(_search_tiles(self.indexed, questions, k, visit, 1), k)
        q_ids, q = few

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = TopK(q_ids, k)
            for batch in batches:
                for row in zip(*(batch.column(i) for i in range(3)), strict=True):
                    visit(best, q, *(x.as_py() for x in row))
            yield best.batch()

        return top_k(self.indexed.mapInArrow(run, FOUND), k)

    def work(self, questions: DataFrame, ef: int) -> DataFrame:
        """(q_id, scored, vectors): how many vectors a search scores for each of a few questions, of how many."""
        few, opened = _few(questions), self._open
        if few is None:
            raise ValueError(f"at most {MAX_BROADCAST} questions")
        q_ids, q = few

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in zip(*(batch.column(i) for i in range(3)), strict=True):
                    own, graph = opened(*(x.as_py() for x in row))
                    scored = graph.search(q, ef)[2]
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(scored), pa.array(np.full(len(q_ids), len(own)))], ["q_id", "scored", "vectors"])

        return self.indexed.mapInArrow(run, "q_id long, scored long, vectors long").groupBy("q_id").agg(F.sum("scored").alias("scored"), F.sum("vectors").alias("vectors"))
