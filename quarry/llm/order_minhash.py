"""Near-duplicate documents by Order MinHash.

A document is a sequence of words (maximal runs of characters other than space and U+0009 to U+000D) and of its five-word windows, each labelled with the
number of its earlier occurrences, so that repeats count as other windows do. Each sketch takes the `PICKED` labelled windows of least hash and keeps them
in text order; so it is equal for two texts only if they share those windows in the same order, and the more edits part them, the rarer that is. Texts
with an equal sketch are candidates; this holds for texts of every length. Of texts of at most `EXACT` windows few sketches differ, so they have further keys, an
exact prefix filter: of two window sets of similarity 0.8 or more, each has a common window among its n - ceil(0.8 n) + 1 of least hash.

Candidates are verified by banded alignment of the same labelled windows: two texts are linked if a common subsequence of L windows gives
L / (m + n - L) >= 0.8. That needs shared windows in order, so it never exceeds the Jaccard similarity of the sets of labelled windows.

No table of all pairs is made. Equal texts are one class. In a bucket of equal sketches each text is first compared with the bucket's most central
one (of the largest buckets over all sketches). Only where a bucket still holds several components afterwards do its remaining texts meet those of
other components, through an exact prefix filter, so every pair of candidates ends up connected, compared, or proven too different. A pair of similarity 0.8 of which
one text has at most EXACT windows is always a candidate. Others, with L windows aligned of U in all, share a sketch with probability of at least
1 - (1 - C(L, PICKED) / C(U, PICKED)) ** SKETCHES: 0.99995 at the least, for L = 32 and U = 40, and 0.99997 for long texts.

Whole texts are not shuffled: those with a candidate are picked out, as they are read, by a bitmap of eight bits for each; a false hit costs a row. Only
beyond FILTER_BITS / 8 texts with candidates, which would make a larger bitmap, a join by their hashes picks them.
A pair is compared at the side that has more partners, whose windows move once for each SALT partners.

Defined results: a text of one to four words has one window, all its words; a text without words, or null, equals other texts only if the text is the
same, null never; rows of one id whose texts differ are documents of their own; rows without an id are classes of their own; an empty table gives
an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.components import connected_components
from quarry.session import discard, materialize

WORDS = 5
PICKED = 4
SKETCHES = 20
#: Up to so many windows a text has prefix keys besides its sketches, which alone would miss more pairs than the stated share.
EXACT = 32
BYTES_AT_ONCE = 1_000_000
#: Bits of the bitmap that picks texts at most (32 MB), and partners of one text that are compared in one place.
FILTER_BITS, SALT = 1 << 28, 500

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, np.uint64)
_BASE = np.uint64(int(_rng.integers(2**62)) * 2 + 1)
_SEEDS = _rng.integers(0, 2**62, SKETCHES, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(0, 2**62, PICKED, np.uint64) * np.uint64(2) + np.uint64(1)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, reversibly."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0 to n, and to -0 to -n, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) <= n:
        back = np.uint64(pow(int(_BASE), -1, 2**64))
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, b, np.uint64))), dtype=np.uint64) for b in (_BASE, back)]
    return _powers[0], _powers[1]


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every five-word window of these texts, in order, and how many each text has."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    data = np.frombuffer(b"".join([x or b"" for x in texts.cast(pa.binary()).to_pylist()]), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    gap = _GAP[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    before_gap = np.concatenate(([True], gap[:-1]))
    starts = np.flatnonzero(~gap & (before_gap | first[:-1]))
    after_gap = np.concatenate((gap[1:], [True]))
    ends = np.flatnonzero(~gap & (after_gap | first[1:])) + 1
    power, back = _power_tables(len(data))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)))
    words = _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    per_text = np.diff(np.searchsorted(starts, bounds))
    total = len(words)
    rolled = np.zeros(max(0, total - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(rolled)]
    ends_at = np.cumsum(per_text)
    text_of = np.repeat(np.arange(len(texts)), per_text)
    n = np.where(per_text >= WORDS, per_text - WORDS + 1, np.minimum(per_text, 1))
    place = np.arange(total)
    inside = place + WORDS <= ends_at[text_of]
    full = np.flatnonzero(inside)
    out = np.zeros(int(n.sum()), np.uint64)
    is_full = np.repeat(per_text >= WORDS, n)
    out[is_full] = rolled[full]
    last = np.cumsum(n) - 1
    for i in np.flatnonzero((per_text > 0) & (per_text < WORDS)):
        value = int(per_text[i])
        for w in words[ends_at[i] - per_text[i] : ends_at[i]].tolist():
            value = (value * 0x9E3779B97F4A7C15 + w) & (2**64 - 1)
        out[last[i]] = np.uint64(value)
    return _mix(out), n


def _occurrences(hashes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """How many times a window has occurred earlier in its text."""
    key = hashes + _mix(text_of.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    place = np.arange(len(key))
    out = np.empty(len(key), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return out


def labelled(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The hash of each window and its label; distinct within a text."""
    if not len(hashes):
        return hashes
    return _mix(hashes + _occurrences(hashes, np.repeat(np.arange(len(n)), n)).astype(np.uint64) * _BASE)


def sketches(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(texts, SKETCHES) sketch keys of texts, by their labelled windows. Texts without windows have keys of 0."""
    texts = len(n)
    keys = np.zeros((texts, SKETCHES), np.uint64)
    if not len(hashes):
        return keys
    text_of = np.repeat(np.arange(texts), n)
    spread = _mix(hashes)
    # Enough of the least hashes to hold the PICKED least, nearly always; texts with too few below the bound take all.
    share = np.minimum(1.0, (PICKED + 20) / np.maximum(1, n))
    bound = np.where(share >= 1, np.float64(2**64 - 2048), share * 2.0**64).astype(np.uint64)
    bounds = np.repeat(bound, n)
    for j in range(SKETCHES):
        values = spread * _SEEDS[j]
        low = values <= bounds
        few = (np.bincount(text_of[low], minlength=texts) < np.minimum(n, PICKED)) & (n > 0)
        if few.any():
            low |= few[text_of]
        chosen = np.flatnonzero(low)
        order = np.lexsort((chosen, values[chosen], text_of[chosen]))
        owner = text_of[chosen][order]
        start = np.concatenate(([True], owner[1:] != owner[:-1]))
        rank = np.arange(len(owner)) - np.maximum.accumulate(np.where(start, np.arange(len(owner)), 0))
        picked = np.sort(chosen[order[rank < PICKED]])
        owner = text_of[picked]
        start = np.concatenate(([True], owner[1:] != owner[:-1]))
        place = np.arange(len(owner)) - np.maximum.accumulate(np.where(start, np.arange(len(owner)), 0))
        folded = np.add.reduceat(_mix(hashes[picked] * _PLACES[place]), np.flatnonzero(start))
        keys[owner[start], j] = _mix(folded)
    return keys


def _text_keys(hashes: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The keys of each text: SKETCHES sketches, then the prefix of a text that may be 0.8 similar to one of at most EXACT windows."""
    hashes, out = labelled(hashes, n), []
    for keys, end, size in zip(sketches(hashes, n), np.cumsum(n).tolist(), n.tolist(), strict=True):
        if 0 < size <= EXACT * 5 // 4:
            keys = np.concatenate((keys, np.sort(hashes[end - size : end])[: size - -(-4 * size // 5) + 1]))
        out.append(keys.view(np.int64))
    return out


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + BYTES_AT_ONCE, "right")))
        yield batch.slice(start, end - start)
        start = end


def _sketched(docs: DataFrame) -> DataFrame:
    """d_id, print (hash of the whole text, null for null), n (windows), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "text"):
                hashes, n = windows(batch.column(2).fill_null(""))
                keys = _text_keys(hashes, n)
                ends = np.cumsum([0, *map(len, keys)])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), lists], ["d_id", "print", "n", "keys"])
        pa.default_memory_pool().release_unused()

    return docs.select("d_id", _print(), "text").mapInArrow(run, "d_id long, print binary, n long, keys array<long>")


def _print(text: str = "text"):
    return F.unhex(F.sha2(text, 256)).alias("print")


def _bitmap(chosen: DataFrame, most: int = 1 << 26) -> np.ndarray:
    """Bits of hash values of chosen (h long), about eight for each, `most` at most; so at most `most` / 8 bytes reach the driver."""
    bits = min(most, 1 << max(15, (8 * chosen.count()).bit_length()))
    # One bitmap of Spark's aggregate has 32768 bits.
    place = chosen.select(F.col("h").bitwiseAND(bits - 1).alias("at")).select(F.floor(F.col("at") / 32768).alias("row"), F.col("at").bitwiseAND(32767).alias("bit"))
    rows = place.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("map")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[4096 * r["row"] : 4096 * (r["row"] + 1)] = np.frombuffer(r["map"], np.uint8)
    return out


def _window_table(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """print and labelled windows, in order, as 64-bit integers in one binary value: of the chosen (h long) texts, and a few others."""
    known = docs.where("d_id is not null and text is not null").select("d_id", _print(), "text").select(F.xxhash64("d_id", "print").alias("h"), "print", "text")
    bits = None
    if chosen.count() <= FILTER_BITS // 8:
        bits = docs.sparkSession.sparkContext.broadcast(_bitmap(chosen, FILTER_BITS))
    else:
        known = known.join(chosen, "h", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if bits is None else bits.value
        for wanted in batches:
            if held is not None:
                at = wanted.column(0).to_numpy(zero_copy_only=False) & (8 * len(held) - 1)
                wanted = wanted.filter(pa.array((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for batch in _slices(wanted, "text"):
                hashes, n = windows(batch.column(2))
                hashes, ends = labelled(hashes, n), np.cumsum(n)
                out = [hashes[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], ["print", "windows"])

    return known.mapInArrow(run, "print binary, windows binary")


def aligned(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether a common subsequence of L of these labelled windows reaches L / (m + n - L) >= 0.8."""
    size = len(x) + len(y)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if 9 * len(i) < 4 * size:
        return False
    # In such an alignment at most size - 2 L windows are unmatched, so matches lie in a band of that width.
    order = np.argsort(i)
    i, j = i[order], j[order]
    j = j[np.abs(i - j) <= size - 2 * -(-4 * size // 9)]
    if len(j) and (np.diff(j) > 0).all():
        return 9 * len(j) >= 4 * size
    tails: list[int] = []
    for v in j.tolist():
        at = bisect_left(tails, v)
        if at == len(tails):
            tails.append(v)
        else:
            tails[at] = v
    return 9 * len(tails) >= 4 * size


def _verified(pairs: DataFrame, table: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of text numbers whose windows align.

    Windows of a text go, once for each SALT partners, to where its pairs are compared; those of a partner once for each pair.
    """
    numbered = pairs.select("a", "b", F.xxhash64("a", "b").alias("h"))
    tasks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).alias("salts"))
    partners = numbered.join(tasks, "a").select("a", F.pmod("h", "salts").alias("salt"), F.col("b").alias("t"))
    heads = partners.select("a", "salt").distinct().withColumn("t", F.col("a"))
    placed = heads.union(partners).join(texts.select("t", "print"), "t").join(table, "print")
    dealt = placed.select("a", "salt", (F.col("t") != F.col("a")).alias("partner"), "t", "windows")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x = None, None
        for batch in batches:
            good, key = [], batch.column(0).to_pylist()
            for a, partner, blob in zip(key, batch.column(1).to_pylist(), batch.column(3), strict=True):
                if not partner:
                    at, x = a, np.frombuffer(blob.as_py(), np.uint64)
                # A text stands before its partners.
                good.append(partner and at == a and aligned(x, np.frombuffer(blob.as_py(), np.uint64)))
            found = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(2)], ["a", "b"])

    ordered = dealt.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "partner")
    return ordered.select("a", "partner", "t", "windows").mapInArrow(run, "a long, b long")


def _prefix_pairs(among: DataFrame, table: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts of different parts, one of which asks, that may reach a similarity of 0.8; none that does is left out.

    Two window sets of that similarity share one of the n - ceil(0.8 n) + 1 windows that come first in any common order. In order of their counts among
    these texts, windows of one text alone come first, so a text of which a fifth is its own has no candidate, however many others share the rest.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                blobs = part.column(1).to_pylist()
                owner = np.repeat(part.column(0).to_numpy(), [len(x) // 8 for x in blobs])
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.frombuffer(b"".join(blobs), np.int64))], ["t", "window"])

    wanted = among.select("t").join(texts.select("t", "print"), "t").join(table.dropDuplicates(["print"]), "print")
    rows = wanted.select("t", "windows").mapInArrow(spread, "t long, window long")
    shared = rows.groupBy("window").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    placed = rows.join(shared, "window").join(among, "t")
    own = Window.partitionBy("t")
    rank = F.row_number().over(own.orderBy("texts", "window")) + F.col("n") - F.count(F.lit(1)).over(own)
    prefix = placed.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1)
    # What a text has from a window on bounds what it can share if that is the first one shared: at least 4 / 9 of both sizes is needed.
    prefix = materialize(prefix.select("t", "window", "n", "part", "asks", (F.col("n") - F.col("rank") + 1).alias("left")), "prefixes")
    asking = prefix.where("asks").select("window", F.col("t").alias("r"), F.col("n").alias("r_n"), F.col("part").alias("r_part"), F.col("left").alias("r_left"))
    met = asking.join(prefix, "window").where("part <> r_part and 5 * least(n, r_n) >= 4 * greatest(n, r_n) and 9 * least(left, r_left) >= 4 * (n + r_n)")
    return met.select(F.least("t", "r").alias("a"), F.greatest("t", "r").alias("b")).distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d_id, print, class_id and class_print of every row: those of the first text, by id and print, that links reach."""
    own = docs.select(F.col(id_col).cast("long").alias("d_id"), F.col(text_col).alias("text"))
    sketched = materialize(_sketched(own), "sketches")
    known = sketched.where("d_id is not null and print is not null")
    of_print = known.groupBy("print").agg(F.min("d_id").alias("c"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    texts = materialize(of_print.withColumn("t", F.monotonically_increasing_id()), "distinct-texts")
    placed = texts.where("n > 0").select("t", "n", F.posexplode("keys").alias("at", "key"))
    rows = placed.select("t", "n", F.least("at", F.lit(SKETCHES)).alias("j"), "key")
    several = rows.groupBy("j", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(rows.join(several, ["j", "key"]).select("j", "key", "t", "n", "size"), "buckets")
    weight = members.groupBy("t").agg(F.sum("size").alias("w"))
    centres = members.join(weight, "t").groupBy("j", "key").agg(F.max(F.struct("w", (-F.col("t")).alias("neg"), "n")).alias("top"))
    centres = centres.select("j", "key", (-F.col("top.neg")).alias("centre"), F.col("top.n").alias("centre_n"))
    near = lambda x, y: 5 * F.least(x, y) >= 4 * F.greatest(x, y)  # noqa: E731  else too few windows could match
    starred = members.join(centres, ["j", "key"])
    compared = starred.where((F.col("t") != F.col("centre")) & near(F.col("n"), F.col("centre_n")))
    first = materialize(compared.select(F.col("centre").alias("a"), F.col("t").alias("b")).distinct(), "star-pairs")
    candidates = members.select("t").distinct().join(texts.select("t", "c", "print"), "t").select(F.xxhash64("c", "print").alias("h"))
    table = materialize(_window_table(own, candidates), "windows", "zstd")
    links = materialize(_verified(first, table, texts), "star-links")
    parts = connected_components(links, "star")
    part_of = lambda frame, col, out: frame.join(
        parts.select(F.col("node").alias(col), F.col("component").alias("p")), col, "left"
    ).withColumn(out, F.coalesce("p", col)).drop("p")
    parted = part_of(starred, "t", "part")
    apart = part_of(parted, "centre", "centre_part").where("part <> centre_part")
    # What the star left apart, against all others of its buckets outside its own component.
    rest = apart.select("t").distinct().withColumn("asks", F.lit(True))
    others = parted.join(apart.select("j", "key").distinct(), ["j", "key"], "left_semi").select("t", "n", "part").distinct()
    among = others.join(rest, "t", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    either_way = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = _prefix_pairs(among, table, texts).join(either_way, ["a", "b"], "left_anti")
    more = materialize(_verified(second, table, texts), "more-links")
    discard(table, members, first)
    final = connected_components(links.union(more), "near")
    discard(links, more)
    place = F.struct(F.col("c").alias("class_id"), F.col("print").alias("class_print"))
    linked = texts.select("t", "c", "print").join(final, F.col("t") == F.col("node"))
    least = linked.groupBy("component").agg(F.min(place).alias("least"))
    of_text = final.join(least, "component").select("node", "least")
    classes = texts.select("t", "print", place.alias("own")).join(of_text, F.col("t") == F.col("node"), "left").select("print", F.coalesce("least", "own").alias("of"))
    joined = sketched.select("d_id", "print").join(classes, "print", "left")
    alone = F.col("d_id").isNull() | F.col("of").isNull()
    return joined.select(
        "d_id", "print", F.when(alone, F.col("d_id")).otherwise(F.col("of.class_id")).alias("class_id"), F.when(alone, F.col("print")).otherwise(F.col("of.class_print")).alias("class_print")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, class_id (least id that links reach), kept (it is that one)."""
    return _classes(docs, id_col, text_col).select(F.col("d_id").alias("doc_id"), "class_id", F.coalesce(F.col("d_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class, that of the least id, and of its texts the first by hash. Rows without an id stay. Columns as given.

    A null text is no copy of anything: one row of each id without a text stays.
    """
    first = _classes(docs, id_col, text_col).where("d_id is not null and d_id = class_id and print <=> class_print")
    kept = first.select(F.col("d_id").alias("__k_id"), F.coalesce("print", F.lit(b"")).alias("__k_print")).distinct()
    marked = docs.withColumn("__print", F.coalesce(_print(text_col), F.lit(b""))).withColumn("__id", F.col(id_col).cast("long"))
    joined = marked.join(kept, (F.col("__id") == F.col("__k_id")) & (F.col("__print") == F.col("__k_print")), "left_semi").dropDuplicates(["__id", "__print"])
    return joined.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
