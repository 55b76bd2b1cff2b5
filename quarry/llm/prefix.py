"""Ranks and running sums over a whole table in one order, without a window over all its rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize


def running(df: DataFrame, order: list[Column], sums: tuple[str, ...] = (), label: str = "running") -> DataFrame:
    """df with `place`, from 0, in this order, and for each of `sums` (bigint, not null) the sum of all rows before, as `<name>_before`.

    Rows are range-partitioned and sorted; each task numbers its own, which are written, so that a lost executor changes no number. What the partitions before
    add up to, a row each, is added through a small table.
    """
    spark, names = df.sparkSession, df.columns
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = ["place", *(f"{c}_before" for c in sums)]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carried = TaskContext.get().partitionId(), np.zeros(len(made), np.int64)
        for batch in batches:
            values = [np.ones(batch.num_rows, np.int64), *(batch.column(names.index(c)).to_numpy() for c in sums)]
            columns = []
            for i, v in enumerate(values):
                total = np.cumsum(v) + carried[i]
                columns.append(pa.array(total - v))
                carried[i] = total[-1] if len(total) else carried[i]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part)), *columns], [*names, "__part", *made])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    schema = f"{kinds}, __part long, " + ", ".join(f"`{c}` long" for c in made)
    placed = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, schema), label)
    totals = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("place"), *(F.sum(c).alias(f"{c}_before") for c in sums)).collect()
    offsets, before = [], [0] * len(made)
    for r in sorted(totals, key=lambda r: r["__part"]):
        offsets.append((r["__part"], *before))
        before = [b + r[c] for b, c in zip(before, made, strict=True)]
    table = spark.createDataFrame(offsets, "__part long, " + ", ".join(f"`__{c}` long" for c in made))
    joined = placed.join(F.broadcast(table), "__part")
    return joined.select(*names, *((F.col(c) + F.col(f"__{c}")).alias(c) for c in made))
