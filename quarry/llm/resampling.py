"""Importance resampling towards a target corpus, with weights summed over bit planes.

Features are runs of one to three words, hashed to BUCKETS buckets. Two sums over all texts, one of the corpus and one of the target, give each
bucket an integer gain: the log ratio of its shares, in thousandths. A document's weight is the sum of the gains of its features. It is taken bit-sliced:
the counts of a document become planes of BUCKETS bits, one for each binary digit; the gains become planes too, apart for positive and negative ones; the
ones that a count plane i and a gain plane j have in common number popcount(AND), each worth 2 ** (i + j). All are integers, so weights are exact.

Hashes are unsigned CRC-32. That of joined words follows from those of its parts: appending n bytes shifts a CRC by n zero bytes, which is linear,
so a batch of texts is hashed by table lookups and no joined word is built, but for words of more than LONGEST bytes.

The texts are read twice, for the counts and for the weights, and never shuffled. The draw adds Gumbel noise from a hash of the id and takes the highest scores. Ranks
come from a range partitioning: places inside a partition, plus the sizes of those before it. Only documents above a quantile that is surely below
the last one drawn take part.

Defined results: a null text has no words; rows of one id, and repeated rows, are documents of their own with equal noise, ranked by weight and then
n_features; a document without an id has the noise of an empty one and comes last among equal scores; an empty target gives every bucket the gain
of no occurrence; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.prefix import running
from quarry.session import materialize

BUCKETS, RUN = 10_000, 3
MIN_WORDS, PERCENT, SEED = 20, 5, 42
#: Bytes of text that are hashed together, and documents whose counts are held together.
BYTES_AT_ONCE, DOCS_AT_ONCE = 1_000_000, 200
#: Bytes of a word up to which shifts are looked up.
LONGEST = 63
#: Accuracy of the quantile that bounds the draw: it errs by a share of 1 / ACCURACY of the rows at most.
ACCURACY = 10_000
#: Bits of a plane: BUCKETS, rounded up to whole 64-bit words.
_WIDTH = -(-BUCKETS // 64) * 64
_ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


def _shift_tables() -> np.ndarray:
    """[n, k, b]: byte b at place k of a CRC, shifted by n zero bytes."""
    out = np.empty((LONGEST + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, LONGEST + 1):
        out[n] = _BYTE[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


_BYTE = _byte_table()
_SHIFT = _shift_tables().reshape(-1)
#: Lower case of A to Z, and which bytes belong to words: digits, a to z, and all of characters beyond ASCII.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True


def _step(crc: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    """The CRC of one more byte."""
    inner = crc ^ _ONES
    return _BYTE[(inner ^ byte) & 255] ^ (inner >> 8) ^ _ONES


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    at = n.astype(np.int64) << 10
    out = _SHIFT[at + (crc & 255)]
    for k in range(1, 4):
        out ^= _SHIFT[at + (k << 8) + ((crc >> np.uint32(8 * k)) & 255)]
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text (index) and the bucket of each feature of these texts, and the number of words of each text."""
    raw = [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    data = _LOWER[np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _IN_WORD[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    start, length = edges[::2], edges[1::2] - edges[::2]
    owner = np.searchsorted(np.cumsum(sizes), start, "right")
    words = np.bincount(owner, minlength=len(raw))
    if not len(start):
        return owner, owner, words

    order = np.argsort(-np.minimum(length, LONGEST + 1), kind="stable")
    long = int((length > LONGEST).sum())
    fit = order[long:]
    crc, own_start = np.zeros(len(fit), np.uint32), start[fit]
    ends_at = np.searchsorted(-length[fit], -np.arange(1, LONGEST + 1), "right")
    for place, k in enumerate(ends_at.tolist()):
        if not k:
            break
        crc[:k] = _step(crc[:k], data[own_start[:k] + place])
    single = np.empty(len(start), np.uint32)
    single[fit] = crc
    bytes_of = lambda i: data[start[i] : start[i] + length[i]].tobytes()
    for i in order[:long].tolist():
        single[i] = zlib.crc32(bytes_of(i))

    found, owners, run = [single], [owner], single
    for n in range(1, RUN):
        same = owner[n:] == owner[:-n] if n < len(owner) else np.zeros(0, bool)
        next_word = np.arange(n, max(n, len(start)))
        short = length[next_word] <= LONGEST
        spaced = _step(run[: len(next_word)], 0x20)
        joined = np.zeros(len(next_word), np.uint32)
        joined[short] = _shifted(spaced[short], length[next_word[short]]) ^ single[next_word[short]]
        for i in np.flatnonzero(~short).tolist():
            joined[i] = zlib.crc32(bytes_of(next_word[i]), int(spaced[i]))
        found.append(joined[same])
        owners.append(owner[:-n][same] if n < len(owner) else owner[:0])
        # A run that leaves its text is hashed too and left out here, as all longer ones are then.
        run = joined
    return np.concatenate(owners), np.concatenate(found).astype(np.int64) % BUCKETS, words


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Starts and ends of slices of at most DOCS_AT_ONCE texts, and about BYTES_AT_ONCE bytes unless a text is longer."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while start < len(texts):
        done = int(ends[start - 1]) if start else 0
        end = max(start + 1, min(start + DOCS_AT_ONCE, int(np.searchsorted(ends, done + BYTES_AT_ONCE, "right"))))
        yield start, end
        start = end


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts each bucket holds: BUCKETS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for start, end in _slices(batch.column(0)):
                total += np.bincount(features(batch.column(0).slice(start, end - start))[1], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths, from the counts of both."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _planes(values: np.ndarray) -> list[np.ndarray]:
    """The binary digits of each row of non-negative values, lowest first: a plane of 64-bit words a digit."""
    wide = np.zeros((*values.shape[:-1], _WIDTH), values.dtype)
    wide[..., : values.shape[-1]] = values
    top = int(values.max(initial=0)).bit_length()
    return [np.packbits((wide >> i & 1).astype(bool), axis=-1).view(np.uint64) for i in range(top)]


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(worth of a bit, plane) of positive and of negative gains."""
    return [(sign << j, plane) for sign, part in ((1, np.maximum(gain, 0)), (-1, np.maximum(-gain, 0))) for j, plane in enumerate(_planes(part))]


def sliced_weights(owner: np.ndarray, bucket: np.ndarray, texts: int, by_gain: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The weight of each text: powers of two times the popcounts of count planes under gain planes."""
    counts = np.bincount(owner * BUCKETS + bucket, minlength=texts * BUCKETS).reshape(texts, BUCKETS)
    out = np.zeros(texts, np.int64)
    for i, plane in enumerate(_planes(counts)):
        held = np.flatnonzero(plane.any(1))
        own = plane[held]
        for worth, gain in by_gain:
            out[held] += np.bitwise_count(own & gain).sum(1, dtype=np.int64) * (worth << i)
    return out


def _weighed(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_features, n_words, weight of every document."""
    by_gain = gain_planes(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in _slices(batch.column(1)):
                owner, bucket, words = features(batch.column(1).slice(start, end - start))
                weight = sliced_weights(owner, bucket, len(words), by_gain)
                n = np.bincount(owner, minlength=len(words))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), *map(pa.array, (n, words, weight))], ["doc_id", "n_features", "n_words", "weight"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def _ranked(rows: DataFrame, wanted: int) -> DataFrame:
    """rows with rank: 1, 2, 3... by falling score up to wanted, null beyond."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    return running(rows, order, label="ranked").select(*rows.columns, F.when(F.col("place") < wanted, F.col("place") + 1).alias("rank"))


def importance(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those that are not drawn."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0))).cast("long")
    scored = materialize(_weighed(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + gumbel), "weights")
    eligible = F.col("n_words") >= min_words
    share = 1 - percent / 100
    low = scored.where(eligible).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("score", max(0.0, share - 2 / ACCURACY), ACCURACY).alias("low")).first()
    wanted = percent * low["n"] // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    bound = low["low"]
    if scored.where(eligible & (F.col("score") >= bound)).count() < wanted:  # an error of the quantile beyond its promise costs work only
        bound = -(2**63)
    taking_part = eligible & (F.col("score") >= bound)
    ranked = _ranked(scored.where(taking_part).select(*columns), wanted)
    return ranked.unionByName(scored.where(~taking_part).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents drawn, columns as given. All rows of an id that is drawn are taken; rows without an id are not."""
    drawn = importance(docs, target, id_col, **options).where("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(drawn, docs[id_col].cast("long") == drawn["__drawn"], "left_semi")


def resample_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    return importance(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def oracle_sql() -> str:
    """The contract in DuckDB. CRCs are folded over the bytes of each distinct feature, by a table of bytes."""
    table = ",".join(str(int(x)) for x in _BYTE)
    return rf"""
WITH texts AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, r, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
f AS (SELECT side, r, unnest(list_transform(range(1, len(ws) + 2 - n), lambda i: array_to_string(ws[i:i+n-1], ' '))) AS f FROM w, (VALUES (1), (2), (3)) v(n) WHERE len(ws) >= n),
u AS (SELECT f, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::UBIGINT) AS b FROM (SELECT DISTINCT f FROM f)),
k AS (SELECT f, (xor(list_reduce(b, lambda c, x: xor(list_extract([{table}]::UBIGINT[], (xor(c, x) & 255)::BIGINT + 1), c >> 8), 4294967295::UBIGINT), 4294967295::UBIGINT) % {BUCKETS})::BIGINT AS bucket FROM u),
c AS (SELECT side, r, bucket, count(*) AS n FROM f JOIN k USING (f) GROUP BY ALL),
s AS (SELECT bucket, (sum(n) FILTER (side = 0))::BIGINT AS s, (sum(n) FILTER (side = 1))::BIGINT AS t FROM c GROUP BY bucket),
tot AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM s),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (ss + {BUCKETS})) / ((coalesce(s, 0) + 1)::DOUBLE * (tt + {BUCKETS}))))::BIGINT AS gain FROM s, tot),
wt AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM c JOIN g USING (bucket) WHERE side = 0 GROUP BY r),
d AS (SELECT w.r, id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
      FROM w LEFT JOIN wt USING (r) WHERE side = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {MIN_WORDS} ORDER BY score DESC, doc_id ASC NULLS LAST, weight DESC, n_features DESC) AS place,
        count(*) OVER (PARTITION BY n_words >= {MIN_WORDS}) AS n FROM d)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= {MIN_WORDS} AND place <= {PERCENT} * n // 100 THEN place END::BIGINT AS rank FROM o"""
