"""Compression of vectors to codes of their parts, with codebooks by dual-tree Lloyd rounds.

Components become integers, floor(SCALE * x). A vector is cut into PARTS equal parts; each part position has a codebook of up to ENTRIES entries, which
starts as that part of the vectors of least id. A round assigns each part to its nearest entry and moves each entry to the mean of its parts, rounded down.

Rows stay where they are stored. In a block of rows each part position gets a tree: parts in the order of their interleaved leading bits, runs of LEAF parts
as leaves and runs of FAN nodes as parents, each with its bounding box, sum and count. The entries get such a tree too. Both are descended at once: a pair
of nodes is dropped if the least distance of its boxes exceeds the largest distance that some other pair of the same parts allows. Where one entry is
left, the whole node is assigned through its cached sum; parts of leaves with several left are compared with these in integers, ties to the lower index.
Bounds are integers and only strictly worse pairs are dropped, so every assignment is exact.

A round leaves sums and counts of PARTS * ENTRIES entries a task, added up by Spark; only those reach the driver. Sums by label are joined back as a
table, so a label of very many vectors is only counted in each task and never moved to one.

Defined results: vectors that are null, empty or hold null or non-finite components are left out, and so are those whose length is no multiple of PARTS
or other than that of the first vector kept, and those with a component of LARGEST or more, whose distances would leave 64 bits; repeated rows, and
rows of one id, are vectors of their own, and those of least id are taken by their components where ids are equal; vectors without an id come last;
fewer vectors than ENTRIES give as many entries; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Parts of a leaf, entries of a leaf, and children of a node.
LEAF, ENTRY_LEAF, FAN = 16, 4, 4
#: Integers of a block at most, so that its trees take some tens of megabytes.
BLOCK_VALUES = 1 << 20
LARGEST = float(1 << 18)
_BITS = 60


def _usable(v: Column) -> Column:
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    return F.coalesce(fits & (F.size(v) > 0) & (F.size(v) % PARTS == 0), F.lit(False))


class Tree:
    """Runs of points in the order of their interleaved leading bits.

    order: rows in that order. lo, hi, total, count: of the nodes of each level, the leaves first and the fewest nodes last.
    """

    def __init__(self, x: np.ndarray, leaf: int):
        self.order = np.argsort(_interleaved(x), kind="stable")
        self.leaf, ordered = leaf, x[self.order]
        starts = np.arange(0, len(x), leaf)
        self.lo, self.hi = [np.minimum.reduceat(ordered, starts)], [np.maximum.reduceat(ordered, starts)]
        self.total, self.count = [np.add.reduceat(ordered, starts)], [np.diff(np.append(starts, len(x)))]
        while len(self.count[-1]) > FAN:
            starts = np.arange(0, len(self.count[-1]), FAN)
            for levels, join in ((self.lo, np.minimum), (self.hi, np.maximum), (self.total, np.add), (self.count, np.add)):
                levels.append(join.reduceat(levels[-1], starts))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes one level below, and which of `nodes` each comes from."""
        found = nodes[:, None] * FAN + np.arange(FAN)
        of, _ = np.nonzero(valid := found < len(self.count[level - 1]))
        return found[valid], of


def _interleaved(x: np.ndarray) -> np.ndarray:
    """A number of each row whose bits are the leading bits of its components in turn."""
    used = x[:, :_BITS]
    bits = min(12, _BITS // used.shape[1])
    lo, span = used.min(0), np.maximum(1, used.max(0) - used.min(0))
    cell = (used - lo) * ((1 << bits) - 1) // span
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for k in range(used.shape[1]):
            out = out << 1 | (cell[:, k] >> b & 1)
    return out


def assign(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower index; and the sums and counts of the rows of each entry."""
    parts, book = Tree(x, LEAF), Tree(entries, ENTRY_LEAF)
    codes = np.empty(len(x), np.int64)
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    level, below = len(parts.count) - 1, len(book.count) - 1
    p, e = (a.reshape(-1) for a in np.meshgrid(np.arange(len(parts.count[level])), np.arange(len(book.count[below])), indexing="ij"))
    while True:
        single = below < 0
        e_lo, e_hi = (entries[e], entries[e]) if single else (book.lo[below][e], book.hi[below][e])
        lo, hi = parts.lo[level][p], parts.hi[level][p]
        gap = np.maximum(0, np.maximum(lo - e_hi, e_lo - hi))
        reach = np.maximum(e_hi - lo, hi - e_lo)
        least, most = (gap * gap).sum(1), (reach * reach).sum(1)
        # Pairs come sorted by part node.
        first = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else p
        width = np.diff(np.append(first, len(p)))
        bound = np.repeat(np.minimum.reduceat(most, first), width) if len(p) else most
        kept = least <= bound
        p, e = p[kept], e[kept]
        if single:
            alone = np.append(True, p[1:] != p[:-1]) & np.append(p[1:] != p[:-1], True) if len(p) else kept[:0]
            span = LEAF * FAN**level
            for node, entry in zip(p[alone].tolist(), e[alone].tolist(), strict=True):
                codes[parts.order[node * span : (node + 1) * span]] = entry
            np.add.at(sums, e[alone], parts.total[level][p[alone]])
            np.add.at(counts, e[alone], parts.count[level][p[alone]])
            p, e = p[~alone], e[~alone]
            if level == 0:
                break
        if not single:
            e, of = _below(book, below, e)
            p, below = p[of], below - 1
        if level and len(p):
            p, of = parts.children(level, p)
            e = e[of]
        level = max(0, level - 1)
        order = np.lexsort((e, p))
        p, e = p[order], e[order]
    _compare(x, entries, parts.order, p, e, codes, sums, counts)
    return codes, sums, counts


def _below(book: Tree, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry nodes one level below, or, of leaves, their entries; and which of `nodes` each comes from."""
    if level:
        return book.children(level, nodes)
    at = nodes[:, None] * ENTRY_LEAF + np.arange(ENTRY_LEAF)
    of, _ = np.nonzero(valid := at < len(book.order))
    return book.order[at[valid]], of


def _compare(x: np.ndarray, entries: np.ndarray, order: np.ndarray, p: np.ndarray, e: np.ndarray, codes: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Assigns the rows of leaves p, each with several entries e left, by integer distances. Sorted by leaf, then entry."""
    first = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else p
    ends = np.append(first[1:], len(p))
    step = max(1, BLOCK_VALUES // (LEAF * x.shape[1] * len(entries)))
    for k in range(0, len(first), step):
        a, b = int(first[k]), int(ends[min(len(first), k + step) - 1])
        own, starts = p[a:b], first[k : k + step] - a
        places = own[:, None] * LEAF + np.arange(LEAF)
        rows = order[np.minimum(places, len(order) - 1)]
        off = x[rows] - entries[e[a:b]][:, None, :]
        distance = (off * off).sum(2)
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, b - a)))
        nearest = distance == np.minimum.reduceat(distance, starts)[of]
        best = np.minimum.reduceat(np.where(nearest, e[a:b][:, None], len(entries)), starts)
        real = places[starts] < len(order)
        rows, best = rows[starts][real], best[real]
        codes[rows] = best
        np.add.at(sums, best, x[rows])
        counts += np.bincount(best, minlength=len(entries))


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of rows with their integers, by row, part and component."""
    step = max(LEAF, BLOCK_VALUES // dims)
    for k in range(0, batch.num_rows, step):
        part = batch.slice(k, step)
        column = part.column(part.schema.get_field_index("q"))
        yield part, column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, PARTS, -1)


def _moved(stored: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round. PARTS * ENTRIES sums and counts reach the driver."""
    shared, dims = stored.sparkSession.sparkContext.broadcast(books), PARTS * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        total = np.zeros((*held.shape[:2], held.shape[2] + 1), np.int64)
        for batch in batches:
            for _, x in _blocks(batch, dims):
                for k in range(PARTS):
                    _, sums, counts = assign(x[:, k], held[k])
                    total[k, :, :-1] += sums
                    total[k, :, -1] += counts
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.reshape(-1)[cells])], ["cell", "total"])

    found = stored.select("q").mapInArrow(run, "cell long, total long").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
    for r in found:
        total.reshape(-1)[r["cell"]] = r["total"]
    sums, counts = total[:, :, :-1], total[:, :, -1:]
    return np.where(counts > 0, sums // np.maximum(1, counts), books)


def _coded(stored: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error."""
    shared, dims = stored.sparkSession.sparkContext.broadcast(books), PARTS * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for part, x in _blocks(batch, dims):
                codes = np.empty((len(x), PARTS), np.uint8)
                error = np.zeros(len(x), np.int64)
                for k in range(PARTS):
                    codes[:, k] = assign(x[:, k], held[k])[0]
                    off = x[:, k] - held[k][codes[:, k]]
                    error += (off * off).sum(1)
                digits = [c.tobytes().hex() for c in codes]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digits, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    label = stored.schema["label"].dataType.simpleString()
    return stored.select("vec_id", "label", "q").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of every vector kept; and the codebooks, integers by part, entry and component."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = own.where(_usable(F.col("v"))).select("vec_id", "label", F.transform("v", lambda x: F.floor(x * SCALE).cast("int")).alias("q"))
    stored = materialize(kept, "integers")
    order = [F.col("vec_id").asc_nulls_last(), F.col("q")]
    first = stored.orderBy(*order).limit(1).select(F.size("q").alias("n")).collect()
    if not first:
        return stored.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((PARTS, 0, 0), np.int64)
    alike = stored.where(F.size("q") == first[0]["n"])
    start = [r["q"] for r in alike.orderBy(*order).limit(ENTRIES).select("q").collect()]
    books = np.array(start, np.int64).reshape(len(start), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS):
        books = _moved(alike, books)
    return _coded(alike, books), books


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes with the vector that each code stands for, in the components' own scale, as `decoded`. The codebooks are a few kilobytes."""
    entries = [F.array(*(F.lit((book / SCALE).tolist()[i]) for i in range(len(book)))) for book in books]
    at = lambda k: F.conv(F.substring("code", 2 * k + 1, 2), 16, 10).cast("int")
    return codes.withColumn("decoded", F.concat(*(F.get(entries[k], at(k)) for k in range(PARTS))))


def code_report(vectors: DataFrame) -> DataFrame:
    coded, books = compress(vectors)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    coded = materialize(coded, "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = coded.join(by_label, coded["label"].eqNullSafe(by_label["of"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """The contract in DuckDB: all distances of each part to all entries."""
    near = lambda cb, name: f"""
{name}d AS (SELECT r, part, entry, sum((x - v) * (x - v))::BIGINT AS dist FROM p JOIN {cb} USING (part, pos) GROUP BY ALL),
{name} AS (SELECT r, part, min(dist) AS dist, arg_min(entry, dist * {ENTRIES} + entry) AS entry FROM {name}d GROUP BY ALL)"""  # noqa: E731
    moved = lambda cb, a, name: f"""
{name}s AS (SELECT part, pos, entry, sum(x)::BIGINT AS s, count(*) AS n FROM p JOIN {a} USING (r, part) GROUP BY ALL),
{name} AS (SELECT part, entry, pos, CASE WHEN n IS NULL THEN v ELSE (s - (s % n + n) % n) // n END AS v FROM {cb} LEFT JOIN {name}s USING (part, entry, pos))"""  # noqa: E731
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {PARTS} = 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= {LARGEST})) = 0),
o AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS r FROM k),
p AS (SELECT r, i // (len(q) // {PARTS}) AS part, i % (len(q) // {PARTS}) AS pos, q[i + 1] AS x FROM (SELECT r, q, unnest(range(len(q))) AS i FROM o)),
c0 AS (SELECT part, r AS entry, pos, x AS v FROM p WHERE r < {ENTRIES}),{near("c0", "a0")},{moved("c0", "a0", "c1")},{near("c1", "a1")},{moved("c1", "a1", "c2")},{near("c2", "a2")},
d AS (SELECT r, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a2 GROUP BY r),
h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN d USING (r), h"""
