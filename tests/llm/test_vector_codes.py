"""Vector codes against brute force, with nulls, ties, repeated rows, odd lengths, empty tables and clashing columns."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def nearest(x, entries):
    return ((x[:, None, :] - entries[None]) ** 2).sum(2).argmin(1)


@pytest.mark.parametrize("n", [1, 15, 16, 17, 65, 300, 3000])
@pytest.mark.parametrize("entries", [1, 5, 64])
def test_assignment_is_exact(n, entries):
    rng = np.random.default_rng(n)
    for dims, scale in ((4, 50), (1, 3), (4, 2), (70, 9)):
        x, e = rng.integers(-scale, scale + 1, (n, dims)), rng.integers(-scale, scale + 1, (entries, dims))
        want = nearest(x, e)
        codes, sums, counts = vector_codes.assign(x, e)
        assert (codes == want).all() and (counts == np.bincount(want, minlength=entries)).all()
        held = np.zeros_like(e)
        np.add.at(held, want, x)
        assert (sums == held).all()


def brute(rows):
    good = lambda v: v and len(v) % 16 == 0 and all(x is not None and math.isfinite(x) and abs(x) < 2**18 for x in v)
    q = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if good(v)]
    q.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    q = [r for r in q if len(r[1]) == len(q[0][1])]
    x = np.array([r[1] for r in q]).reshape(len(q), 16, -1)
    books = x[:64].transpose(1, 0, 2).copy()
    for _ in range(2):
        for k in range(16):
            codes = nearest(x[:, k], books[k])
            for j in range(len(books[k])):
                if (own := x[codes == j, k]).size:
                    books[k, j] = own.sum(0) // len(own)
    codes = np.array([nearest(x[:, k], books[k]) for k in range(16)]).T
    error = [int(sum(((x[i, k] - books[k, codes[i, k]]) ** 2).sum() for k in range(16))) for i in range(len(x))]
    of_label = defaultdict(int)
    for r, e in zip(q, error):
        of_label[r[2]] += e
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in cs), e, of_label[r[2]], digest) for r, cs, e in zip(q, codes.tolist(), error)]


@pytest.mark.parametrize("count", [1, 40, 200])
def test_against_brute_force(spark, count):
    rng = np.random.default_rng(count)
    vectors = np.round(rng.normal(0, 0.2, (count, 32)), 2).astype(np.float32).tolist()
    rows = [(i + 10, v, None if i % 5 == 0 else i % 3) for i, v in enumerate(vectors)] + [(10, vectors[0], 1)] * 3 + [(11, vectors[-1], None), (None, vectors[0], 2)]
    rows += [(90, None, 1), (91, [], 1), (92, [0.5, None] * 16, 1), (93, [float("nan")] * 32, 1), (94, [float("inf")] * 32, 1), (95, [0.1] * 48, 1), (96, [0.1] * 20, 1), (97, [1e30] * 32, 1)]
    frame = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], SCHEMA)
    got = vector_codes.code_report(frame)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows))


def test_empty_table_and_decoding(spark):
    assert vector_codes.code_report(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(i, [float(i % 7)] * 32, None, None) for i in range(50)]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA))
    # Seven different vectors, each an entry of every codebook.
    assert {r["vec_id"]: r["decoded"] for r in vector_codes.decode(coded, books).collect()} == {r[0]: r[1] for r in rows}
