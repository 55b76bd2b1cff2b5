"""Importance resampling against brute force, with nulls, ties, long words, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = ["Hello wOrld foo", None, "", "ünï cödé " * 3 + "x" * 200 + " yy " + "z" * 64 + " q " + "y" * 63, "a", "a b", "...", "日本語 Ä z", "w\x00v\tu", "a b " * 3000]


def buckets(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(" ".join(words[j : j + k]).encode()) % 10_000 for k in (1, 2, 3) for j in range(len(words) - k + 1)], len(words)


def brute(docs, target):
    """Rows of (doc_id, n_features, weight, score, rank) in any order."""
    s, t = (Counter(b for x in texts for b in buckets(x)[0]) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    rows = []
    for i, x in docs:
        found, n = buckets(x)
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    drawn = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    wanted = 5 * len(drawn) // 100
    ranked = [(*r[:4], k + 1 if k < wanted else None) for k, r in enumerate(drawn)]
    return ranked + [(*r[:4], None) for r in rows if r[4] < 20]


def test_features_and_planes():
    owner, bucket, words = resampling.features(pa.array(TEXTS))
    want = [buckets(x) for x in TEXTS]
    assert words.tolist() == [n for _, n in want]
    assert Counter(zip(owner.tolist(), bucket.tolist())) == Counter((i, b) for i, (found, _) in enumerate(want) for b in found)
    gain = np.random.default_rng(1).integers(-9000, 9000, 10_000)
    got = resampling.sliced_weights(owner, bucket, len(TEXTS), resampling.gain_planes(gain))
    assert got.tolist() == [int(sum(gain[b] for b in found)) for found, _ in want]


@pytest.mark.parametrize("count", [1, 19, 20, 230])
def test_against_brute_force(spark, count):
    texts = [*TEXTS, *(f"word{i % 7} " * 25 + f"own{i}" for i in range(count))]
    docs = [(None if i == 12 else i // 2, x) for i, x in enumerate(texts)] + [(3, texts[-1]), (3, texts[-1])]
    target = ["word3 word3 own5", None, "", "hello"]
    frame = spark.createDataFrame([(i, x, 1) for i, x in docs], "doc_id long, text string, weight int")
    got = resampling.resample_report(frame, spark.createDataFrame([(x,) for x in target], "text string"))
    assert Counter(map(tuple, got.collect())) == Counter(brute(docs, target))


def test_empty_tables_and_the_draw(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample_report(none, none).collect() == []
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("the word "), 12), F.col("id").cast("string")).alias("text"), F.lit("x").alias("rank"))
    drawn = resampling.resample(docs, none)
    assert drawn.columns == docs.columns and drawn.count() == 20
    report = resampling.resample_report(docs, none)
    assert sorted(r["rank"] for r in report.where("rank is not null").collect()) == list(range(1, 21))
    assert {r["doc_id"] for r in drawn.collect()} == {r["doc_id"] for r in report.where("rank is not null").collect()}
