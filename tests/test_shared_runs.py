"""Passages met by shared runs of letters, against brute force, with boilerplate, periods and few rows moved."""

import random
import re

import numpy as np
import pytest

from quarry.operators import evaluation, kernels


def letters(text):
    return re.sub("[^a-z0-9]", "", (text or "").lower())


def brute(passages, documents, run):
    out = set()
    for p, x in passages:
        own = letters(x)
        runs = {own[i : i + run] for i in range(len(own) - run + 1)}
        out |= {(p, d) for d, y in documents if any(r in letters(y) for r in runs)}
    return out


@pytest.mark.parametrize("run", [40, 120])
def test_shared_runs_equal_brute_force(spark, run, monkeypatch):
    monkeypatch.setattr(evaluation, "SALT", 5)
    rng = random.Random(run)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = text(60)
    passages = [(f"p{i}", text(rng.randint(10, 120))) for i in range(15)] + [("c", common + text(9)), ("x", "x" * 300), ("y", "ab" * 200), ("none", None), ("", "short"), (None, common)]
    documents = []
    for i in range(60):
        cut = letters(rng.choice(passages[:15])[1])
        a = rng.randrange(max(1, len(cut) - run))
        piece = cut[a : a + run + rng.randint(-2, 2)]
        documents.append((i, text(20) + "." + piece.upper() + "!" + text(20) + (" " + common if i % 2 else "")))
    documents += [(100, "x" * (run - 1)), (101, "x" * run + "!"), (102, "ba" * 90), (103, None), (104, ""), (105, documents[1][1]), (None, common)]
    got = evaluation.shared_runs(spark.createDataFrame(passages, "p_id string, text string"), spark.createDataFrame(documents, "doc_id long, text string"), run)
    want = brute([p for p in passages if p[0] is not None], [d for d in documents if d[0] is not None], run)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_anchors_are_few_and_the_same_in_every_run():
    rng = random.Random(2)
    data = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(20_000))
    at, h = kernels.anchors(data, 120)
    assert len(at) < 0.03 * len(data)
    for start in range(0, len(data) - 120, 37):
        inner, hashes = kernels.anchors(data[start : start + 120], 120)
        assert set((inner + start).tolist()) <= set(at.tolist()) and hashes.tolist() == h[np.searchsorted(at, inner + start)].tolist()
