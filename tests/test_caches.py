"""The exact and the semantic cache, in batch and as streams over several batches, against a plain fold."""

import datetime as dt
import math
import random

import pytest

from quarry.streaming import cache, requests

START = dt.datetime(2026, 1, 1)


def fold(rows, ttl):
    """Ids of the misses: rows of (id, query, seconds)."""
    stored, out = {}, []
    for i, query, at in sorted(rows, key=lambda r: (r[2], r[0])):
        if query not in stored or at >= stored[query] + ttl:
            stored[query] = at
            out.append(i)
    return sorted(out)


def requests_of(n, seed=4):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 1, 30, 900])
        rows.append((i, "hot" if rng.random() < 0.4 else f"q{rng.randrange(9)}", at))
    return rows


def log(spark, rows):
    return spark.createDataFrame([(i, q, START + dt.timedelta(seconds=s)) for i, q, s in rows], "id long, query string, created_at timestamp")


def streamed(spark, batches, folder, schema):
    """A stream that takes each of these frames as a batch, in turn."""
    for n, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(f"{folder}/{n:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_four_requests_three_hours_apart_are_four_misses(spark):
    assert cache.misses(log(spark, [(i, "same", i * 3 * 3600) for i in range(4)])).count() == 4
    exact = [(0, "q", 0), (1, "q", 3599), (2, "q", 3600), (3, "q", 7199), (4, "q", 7200), (5, "q", 7200)]
    assert sorted(r["id"] for r in cache.misses(log(spark, exact)).collect()) == [0, 2, 4] == fold(exact, 3600)


@pytest.mark.parametrize("batches", [1, 5])
def test_misses_in_batch_and_as_a_stream(spark, tmp_path, batches):
    rows = requests_of(400)
    want = fold(rows, 3600)
    whole = log(spark, rows)
    assert sorted(r["id"] for r in cache.misses(whole).collect()) == want
    size = -(-len(rows) // batches)
    stream = streamed(spark, [log(spark, rows[k : k + size]) for k in range(0, len(rows), size)], str(tmp_path / "in"), whole.schema)
    assert sorted(r["id"] for r in requests.run_to_end(cache.misses(stream), "append").collect()) == want


def test_misses_of_odd_tables(spark):
    whole = log(spark, [(1, "q", 0)])
    assert cache.misses(whole.limit(0)).collect() == []
    odd = spark.createDataFrame([(1, None, START), (2, "q", None), (3, "", START), (3, "", START)], whole.schema)
    assert [r["id"] for r in cache.misses(odd).collect()] == [3]


def similar(rows, threshold, ttl, size):
    held, out = {}, {}
    for scope, i, at, v in sorted(rows, key=lambda r: (r[2], r[1])):
        own = [e for e in held.get(scope, []) if e[1] > at - ttl]
        best = max(own, key=lambda e: sum(a * b for a, b in zip(e[2], v)), default=None)
        score = sum(a * b for a, b in zip(best[2], v)) if best else -1
        out[i] = best[0] if score >= threshold else None
        if out[i] is None:
            own = (own + [(i, at, v)])[-size:]
        held[scope] = own
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_semantic_cache_stream(spark, tmp_path, batches):
    rng = random.Random(5)
    rows, at = [], 0
    for i in range(160):
        at += rng.choice([1, 20, 1500])
        angle = rng.uniform(0, 2 * math.pi)
        rows.append((f"s{i % 3}", i, at, [math.cos(angle), math.sin(angle)]))
    schema = "scope string, id long, at timestamp, vec array<double>"
    frames = [spark.createDataFrame([(s, i, START + dt.timedelta(seconds=t), v) for s, i, t, v in rows[k::1][: -(-160 // batches)]], schema) for k in range(0, 160, -(-160 // batches))]
    stream = streamed(spark, frames, str(tmp_path / "in"), schema)
    got = {r["id"]: r["hit"] for r in requests.run_to_end(cache.semantic_cache(stream, width=2, size=4), "append").collect()}
    assert got == similar(rows, 0.95, 3600, 4)
