"""The answer caches: exact, by query with a time to live, in batch and as a stream; and semantic, by the most similar stored question of a scope."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MISSES = "id long, query string, created_at timestamp"
HITS = "scope string, id long, hit long, score double"
SECOND = 1_000_000
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Typed state with timers needs a store that can look up by prefix."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def stored_at(at: np.ndarray, stored: int | None, ttl: int) -> tuple[list[int], int | None]:
    """Places of the misses among these ascending times, and when the last answer was stored. An answer lives `ttl`; hits do not renew it."""
    misses, i = [], 0
    while True:
        if stored is not None:
            i += int(np.searchsorted(at[i:], stored + ttl))
        if i >= len(at):
            return misses, stored
        misses.append(i)
        stored = int(at[i])


def misses(log: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """(id, query, created_at) of the requests that no answer stored within the time to live serves: the misses of the exact cache.

    Requests of a query are taken in order of time and id; each miss stores an answer, which serves all until it is older than the time to live. As a stream,
    requests are taken batch by batch, late ones as they come, and a query's state ends with its answer's life. In batch, requests are sorted by query and
    time and folded as they stream past, so a query of any number of requests takes no memory.
    """
    rows = log.where("query is not null and created_at is not null")
    rows = rows.select("id", "query", F.col("created_at").cast("timestamp").alias("created_at"))
    ttl = ttl_seconds * SECOND
    if log.isStreaming:
        keep_state_in_rocksdb(log.sparkSession)
        timed = rows.withWatermark("created_at", f"{ttl_seconds} seconds")
        return timed.groupBy("query").transformWithStateInPandas(ExactCache(ttl), outputStructType=MISSES, outputMode="Append", timeMode="EventTime")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, stored = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(1).dictionary_encode()
            numbers, at = coded.indices.to_numpy(), batch.column(3).to_numpy()
            starts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
            found: list[int] = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
                own = coded.dictionary[int(numbers[a])].as_py()
                if own != query:
                    query, stored = own, None
                new, stored = stored_at(at[a:b], stored, ttl)
                found += [a + i for i in new]
            yield batch.take(pa.array(found, pa.int64())).select(["id", "query", "created_at"])

    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.withColumn("at", F.unix_micros("created_at")).repartition(parts, "query").sortWithinPartitions("query", "at", "id")
    return ordered.mapInArrow(run, MISSES)


class ExactCache(StatefulProcessor):
    """When the answer to a query was stored, until a timer of event time ends it."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.stored = handle, handle.getValueState("stored", "at long")

    def _ends(self, stored: int) -> int:
        return -(-(stored + self.ttl) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(rows).sort_values(["created_at", "id"])
        at = held["created_at"].to_numpy("datetime64[us]").astype(np.int64)
        before = self.stored.get()[0] if self.stored.exists() else None
        found, stored = stored_at(at, before, self.ttl)
        if stored != before:
            if before is not None:
                self.handle.deleteTimer(self._ends(before))
            self.stored.update((stored,))
            self.handle.registerTimer(self._ends(stored))
        yield held.iloc[found][["id", "query", "created_at"]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.stored.clear()
        yield pd.DataFrame({"id": pd.Series(dtype="int64"), "query": pd.Series(dtype="str"), "created_at": pd.Series(dtype="datetime64[ns, UTC]")})

    def close(self) -> None:
        pass


def semantic_cache(questions: DataFrame, threshold: float = 0.95, ttl_seconds: int = 3600, size: int = 2000, width: int = 64) -> DataFrame:
    """(scope, id, hit, score) for a stream of questions (scope, id, at, vec of unit vectors).

    Within a batch the questions of a scope are taken in order of time and id. A stored question older than the time to live, or beyond the newest `size`
    of its scope, is forgotten, so a scope's state is bounded; a timer of event time ends the state of scopes that fall idle. A miss has a null hit and
    is stored. Each answer depends on those before it, so a scope is one task; in batch, `search.cache_hits` deals a scope to many.
    """
    keep_state_in_rocksdb(questions.sparkSession)
    chosen = questions.where("scope is not null").select("scope", "id", F.col("at").cast("timestamp").alias("at"), "vec").withWatermark("at", f"{ttl_seconds} seconds")
    cache = SemanticCache(threshold, ttl_seconds * SECOND, size, width)
    return chosen.groupBy("scope").transformWithStateInPandas(cache, outputStructType=HITS, outputMode="Append", timeMode="EventTime")


class SemanticCache(StatefulProcessor):
    """The stored questions of a scope, oldest first."""

    def __init__(self, threshold: float, ttl: int, size: int, width: int):
        self.threshold, self.ttl, self.size, self.width = threshold, ttl, size, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entries = handle, handle.getListState("entries", "id long, at long, vec binary")

    def _held(self) -> list[tuple[int, int, bytes]]:
        return [tuple(e) for e in self.entries.get()] if self.entries.exists() else []

    def _keep(self, held: list[tuple[int, int, bytes]]) -> None:
        """Stores what is held, and a timer for the end of its oldest."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not held:
            self.entries.clear()
            return
        self.entries.put(held)
        self.handle.registerTimer(-(-(min(at for _, at, _ in held) + self.ttl) // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, asked = self._held(), pd.concat(rows).sort_values(["at", "id"])
        n, room = len(held), len(held) + len(asked)
        ids, times, vectors = np.zeros(room, np.int64), np.zeros(room, np.int64), np.zeros((room, self.width))
        if n:
            ids[:n], times[:n] = [e[0] for e in held], [e[1] for e in held]
            vectors[:n] = np.frombuffer(b"".join(e[2] for e in held)).reshape(n, self.width)
        live, out = np.zeros(room, bool), []
        live[:n] = True
        for row_id, now, vec in zip(asked["id"].tolist(), asked["at"].to_numpy("datetime64[us]").astype(np.int64).tolist(), asked["vec"], strict=True):
            v = np.asarray(vec, np.float64)
            live[:n] &= times[:n] > now - self.ttl
            scores = np.where(live[:n], vectors[:n] @ v, -np.inf)
            best = int(np.argmax(scores)) if n else -1
            if best >= 0 and scores[best] >= self.threshold:
                out.append((key[0], row_id, int(ids[best]), round(float(scores[best]), 6)))
                continue
            out.append((key[0], row_id, None, None))
            ids[n], times[n], vectors[n], live[n] = row_id, now, v, True
            n += 1
            if int(live[:n].sum()) > self.size:
                live[int(np.argmax(live[:n]))] = False
        self._keep([(int(ids[i]), int(times[i]), vectors[i].tobytes()) for i in np.flatnonzero(live).tolist()])
        yield pd.DataFrame(out, columns=["scope", "id", "hit", "score"]).astype({"hit": "Int64", "score": "Float64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        self._keep([e for e in self._held() if e[1] + self.ttl > now])
        yield pd.DataFrame({"scope": pd.Series(dtype="str"), "id": pd.Series(dtype="int64"), "hit": pd.Series(dtype="Int64"), "score": pd.Series(dtype="Float64")})

    def close(self) -> None:
        pass
