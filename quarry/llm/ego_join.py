"""Embedding near-duplicates by the epsilon grid order join.

Unit vectors within cosine c of each other lie within epsilon = sqrt(2 - 2c). Vectors are sorted by their epsilon-wide grid cells
on the leading principal dimensions and cut into a sequence of equal blocks. Starting from the whole sequence joined with itself, intervals
of the sequence are split and joined recursively, level by level, leaving out pairs of intervals whose bounding boxes lie further
apart than epsilon; what is left are pairs of blocks, and each is joined by one matrix product in double precision.

What the recursion leaves is dealt in tiles of neighbouring blocks, a few for each partition, so a block moves to the tiles of its row and column
and not to each of its partners. Equal vectors are joined once, as a class with a number of its own and a count. A pair of blocks returns link counts per class and a spanning forest of its links,
both linear in the block size, so a large group of near copies yields no table of all its pairs. The principal dimensions are fitted on at most
`SAMPLE` vectors; they only steer the pruning, as any orthonormal projection shortens distances. Blocks, boxes and interval pairs stay in DataFrames.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without an id, link with nothing and are
their own component; vectors of different lengths never link; repeated rows, and rows of one id, count as vectors of their own; an empty table gives
an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected_components
from quarry.session import discard, materialize

COSINE = 0.9
BLOCK = 2048
SAMPLE = 4096
#: Leading principal dimensions: for grid cells, and for bounding boxes.
GRID_DIMS, BOX_DIMS = 4, 16
#: Bits of the block number that one level of the recursion splits by; blocks along the side of a tile at most.
STEP_BITS, TILE = 3, 16


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _axes(classes: DataFrame) -> np.ndarray:
    """Principal axes, as columns, of a bounded sample by hash; vectors of the commonest length in it."""
    rows = classes.orderBy(F.xxhash64("c_id")).limit(SAMPLE).select("v").collect()
    if not rows:
        return np.zeros((1, 0))
    sizes = [len(r["v"]) for r in rows]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s))
    x = np.array([r["v"] for r in rows if len(r["v"]) == size], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(x.T @ x)
    return axes[:, ::-1][:, :BOX_DIMS]


def _packed(classes: DataFrame, axes: np.ndarray, epsilon: float) -> DataFrame:
    """Blocks of the grid order: block, size, ids, counts, vectors (unit, doubles), lo and hi of the bounding box."""
    spark = classes.sparkSession
    grid = [f"g{i}" for i in range(GRID_DIMS)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy()
            values, starts = batch.column(2).flatten().to_numpy(), np.cumsum(sizes) - sizes
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                v = values[starts[rows][:, None] + np.arange(size)]
                # Scaled first, so that squares of very large or small components stay in range.
                v = v / np.abs(v).max(1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                y = v @ axes if size == len(axes) else np.zeros((len(rows), axes.shape[1]))
                cells = np.zeros((len(rows), GRID_DIMS), np.int64)
                cells[:, : y.shape[1]] = np.floor(y[:, :GRID_DIMS] / epsilon)
                at = pa.array(rows)
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(rows), size, np.int64)), *map(pa.array, cells.T.copy())]
                unit = pa.array([x.tobytes() for x in v], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, unit], ["c_id", "n", "dim", *grid, "unit"])

    cells = ", ".join(f"{g} long" for g in grid)
    placed = classes.select("c_id", "n", "v").mapInArrow(project, f"c_id long, n long, dim long, {cells}, unit binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["dim", *grid, "c_id"]
    ordered = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    in_order = materialize(ordered.select("c_id", "n", "dim", "unit", F.monotonically_increasing_id().alias("place")), "grid-order")
    ordered = in_order.withColumn("part", F.shiftright("place", 33)).withColumn("own", F.col("place").bitwiseAND((1 << 33) - 1))
    # One row per partition.
    sizes = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    before = spark.createDataFrame(offsets, "part long, before long")
    numbered = ordered.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("own"))
    numbered = numbered.withColumn("block", F.floor(F.col("rank") / BLOCK).cast("long"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0], row[1]) != (held[0][0], held[0][1]):
                    yield packed(held)
                    held = []
                held.append(row)
        if held:
            yield packed(held)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(r[4] for r in rows)).reshape(len(rows), -1)
        y = x @ axes if x.shape[1] == len(axes) else np.zeros((len(rows), axes.shape[1]))
        return pa.RecordBatch.from_pylist(
            [
                {
                    "block": rows[0][0],
                    "dim": rows[0][1],
                    "ids": np.array([r[2] for r in rows], np.int64).tobytes(),
                    "counts": np.array([r[3] for r in rows], np.int64).tobytes(),
                    "unit": x.tobytes(),
                    "lo": y.min(0).tolist(),
                    "hi": y.max(0).tolist(),
                }
            ],
            pa.schema([("block", pa.int64()), ("dim", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("unit", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))]),
        )

    rows = numbered.repartition(max(1, min(parts, -(-total // BLOCK))), "block").sortWithinPartitions("block", "dim", "rank")
    schema = "block long, dim long, ids binary, counts binary, unit binary, lo array<double>, hi array<double>"
    out = materialize(rows.select("block", "dim", "c_id", "n", "unit").mapInArrow(pack, schema), "blocks")
    discard(in_order)
    return out


def _near_pairs(blocks: DataFrame, dims: int, epsilon: float) -> DataFrame:
    """Pairs (left, right) of block numbers, left <= right, whose bounding boxes may lie within epsilon."""
    spark = blocks.sparkSession
    boxes = blocks.select("block", *(F.col("lo")[i].alias(f"lo{i}") for i in range(dims)), *(F.col("hi")[i].alias(f"hi{i}") for i in range(dims)))
    top = blocks.agg(F.max("block")).first()[0] or 0
    level = -(-int(top).bit_length() // STEP_BITS) * STEP_BITS

    def nodes(bits: int, suffix: str) -> DataFrame:
        """Boxes of the intervals of 2 ** bits blocks."""
        least = [F.min(f"lo{i}").alias(f"lo{i}{suffix}") for i in range(dims)]
        most = [F.max(f"hi{i}").alias(f"hi{i}{suffix}") for i in range(dims)]
        return boxes.groupBy(F.shiftright("block", bits).alias(f"node{suffix}")).agg(*least, *most)

    pairs = spark.createDataFrame([(0, 0)], "left long, right long")
    while level:
        level -= STEP_BITS
        children = F.sequence(F.lit(0), F.lit((1 << STEP_BITS) - 1))
        split = pairs.select(F.explode(F.transform(children, lambda k: F.col("left") * (1 << STEP_BITS) + k)).alias("left"), "right").select(
            "left", F.explode(F.transform(children, lambda k: F.col("right") * (1 << STEP_BITS) + k)).alias("right")
        )
        a, b = nodes(level, "a"), nodes(level, "b")
        joined = split.where("left <= right").join(a, F.col("left") == F.col("nodea")).join(b, F.col("right") == F.col("nodeb"))
        gaps = [F.greatest(F.lit(0.0), F.col(f"lo{i}a") - F.col(f"hi{i}b"), F.col(f"lo{i}b") - F.col(f"hi{i}a")) for i in range(dims)]
        apart = sum((g * g for g in gaps), F.lit(0.0))
        pairs = joined.where(apart <= (epsilon * 1.000001) ** 2).select("left", "right")
    return pairs


def _forest(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of the two-sided graph."""
    seen_row, seen_col = ~link.any(1), ~link.any(0)
    out: list[tuple[int, int]] = []
    for first in np.flatnonzero(~seen_row):
        if seen_row[first]:
            continue
        seen_row[first] = True
        rows = [int(first)]
        while rows:
            row = rows.pop()
            cols = np.flatnonzero(link[row] & ~seen_col)
            seen_col[cols] = True
            out += [(row, int(c)) for c in cols]
            for c in cols:
                more = np.flatnonzero(link[:, c] & ~seen_row)
                seen_row[more] = True
                out += [(int(r), int(c)) for r in more]
                rows += more.tolist()
    return out


def _links(pairs: DataFrame, blocks: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): n links of class a to other classes, counted by vectors, with b null; or an edge a, b of a spanning forest with n null."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = max(1, min(TILE, int(blocks.count() / (6 * parts) ** 0.5)))
    tiled = pairs.select(F.floor(F.col("left") / side).alias("tl"), F.floor(F.col("right") / side).alias("tr"), "left", "right")
    held = tiled.groupBy("tl", "tr", F.col("left").alias("block")).agg(F.lit(None).cast("array<long>").alias("lefts"))
    # At most TILE numbers for each block of a tile.
    met = tiled.groupBy("tl", "tr", F.col("right").alias("block")).agg(F.collect_list("left").alias("lefts"))
    dealt = held.union(met).join(blocks.select("block", "dim", "ids", "counts", "unit"), "block")
    work = dealt.withColumn("meets", F.col("lefts").isNotNull()).repartition(parts, "tl", "tr").sortWithinPartitions("tl", "tr", "meets", "block", "dim")

    def joined(same: bool, a: tuple, b: tuple) -> pa.RecordBatch | None:
        (ids_a, counts_a, x), (ids_b, counts_b, y) = a, b
        link = x @ y.T >= cosine
        if same:
            np.fill_diagonal(link, False)
        rows, cols = link.any(1), link.any(0)
        if not rows.any():
            return None
        small = link[np.ix_(rows, cols)]
        ids_a, ids_b = ids_a[rows], ids_b[cols]
        counted = [(ids_a, small @ counts_b[cols])]
        if not same:
            counted.append((ids_b, counts_a[rows] @ small))
        edges = _forest(small)
        first = np.concatenate([c[0] for c in counted] + [ids_a[[e[0] for e in edges]]])
        n_counts = sum(len(c[0]) for c in counted)
        second = np.concatenate([np.zeros(n_counts, np.int64), ids_b[[e[1] for e in edges]]])
        number = np.concatenate([c[1] for c in counted] + [np.zeros(len(edges), np.int64)])
        is_edge = np.arange(len(first)) >= n_counts
        return pa.RecordBatch.from_arrays([pa.array(first), pa.array(second, mask=~is_edge), pa.array(number, mask=is_edge)], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if (row["tl"], row["tr"]) != tile:
                    tile, held = (row["tl"], row["tr"]), {}
                ids = np.frombuffer(row["ids"], np.int64)
                own = ids, np.frombuffer(row["counts"], np.int64), np.frombuffer(row["unit"]).reshape(len(ids), -1)
                if row["lefts"] is None:
                    # A block with vectors of several lengths comes in a row for each.
                    held.setdefault((row["block"], row["dim"]), own)
                    continue
                for left in row["lefts"]:
                    if (left, row["dim"]) in held and (found := joined(left == row["block"], held[left, row["dim"]], own)):
                        yield found

    return materialize(work.select("tl", "tr", "block", "dim", "lefts", "ids", "counts", "unit").mapInArrow(run, "a long, b long, n long"), "links")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """A row per vector: vec_id, n_links (other vectors within the cosine), component_id (least id reachable), kept."""
    epsilon = float(np.sqrt(2 - 2 * cosine))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    own = own.withColumn("usable", _usable(F.col("v")) & F.col("vec_id").isNotNull())
    grouped = own.where("usable").groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = materialize(grouped.withColumn("c_id", F.monotonically_increasing_id()), "classes")
    axes = _axes(classes)
    if axes.shape[1]:
        blocks = _packed(classes, axes, epsilon)
        links = _links(_near_pairs(blocks, axes.shape[1], epsilon), blocks, cosine)
        discard(blocks)
    else:
        links = classes.sparkSession.createDataFrame([], "a long, b long, n long")
    parts = connected_components(links.where("b is not null").select("a", "b"), "ego")
    least = parts.join(classes.select("c_id", "least"), F.col("node") == F.col("c_id")).groupBy("component").agg(F.min("least").alias("part"))
    reached = parts.join(least, "component").select("node", "part")
    counts = links.where("n is not null").groupBy("a").agg(F.sum("n").alias("more"))
    known = (
        classes.join(counts, classes["c_id"] == counts["a"], "left")
        .join(reached, classes["c_id"] == reached["node"], "left")
        .select(F.col("v").alias("cv"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("part", "least").alias("part"))
    )
    joined = own.join(known, own["usable"] & (own["v"] == known["cv"]), "left")
    component = F.coalesce("part", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
