"""Removal of repeated byte strings by longest-previous-factor arrays over suffix order.

A byte goes if a string of LENGTH bytes over it also starts in a document of smaller id; strings are judged on the input. Suffixes are sorted, the longest
common prefix of neighbours is taken, and for each suffix the previous and the next suffix of a smaller document in that order give its longest previous
factor (over documents): a string goes exactly where that factor reaches LENGTH. Factors are capped at LENGTH, which is all that this asks.

One suffix order of a whole corpus would move LENGTH bytes for each of its bytes. So it is built in shares, none of which can miss a match:

1. Store. Texts are packed once into chunks, a row each, so that every later pass sees the same chunks whatever order or task they were read in.
2. Filter. Every string has one anchor, its GRAM-byte substring of least hash, the same wherever the string occurs. A chunk asks about the anchors it
   holds; an answer is two bits for each: met anywhere else, and met with very many surroundings. Anchors met once have no match.
3. Segments. The strings of one anchor lie together, in a segment of at most LENGTH + SPAN - 2 bytes. Equal segments of a chunk (compared byte by byte)
   are sent once, for the least document; so a passage of a third of all documents costs a segment a chunk. Segments are dealt by anchor; strings
   of an anchor with more than HOT surroundings are dealt one by one, by their own hash, so no anchor makes a large share.
4. Factors. In a share, equal segments are one class of its least document. Suffix order, common prefixes, previous and next smaller documents and
   the longest previous factors are worked out over the classes; a later copy's longest previous factor is the whole segment.
5. Each string's verdict goes back to its chunk, where covered bytes are united and cut.

Anchors and segments travel packed, a row for each chunk and each share. Beyond FAN shares that would be more rows than the text has room for, so they
then go by way of crossings: a chunk sends a row to each of its FAN groups of shares at most, a crossing takes the rows of FAN chunks for one group, unites equal
anchors and equal segments, and sends a row to each share of the group, FAN at most. So rows grow with the text and no faster, up to FAN * FAN shares (64 TB),
and an anchor or segment that is in every chunk reaches its share once from each crossing, not from each chunk. Replies come back the same way.

Defined results: a null text counts as empty; rows of one id (repeats too) never remove from each other; rows without an id are kept whole and remove
nothing; an empty table gives an empty result. Bytes that remain are hashed as they are, even where a cut splits a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.order_minhash import _BYTE, _mix, _power_tables
from quarry.session import discard, materialize

LENGTH = 50
GRAM = 26
#: Grams in a string, and so strings of one anchor at most.
SPAN = LENGTH - GRAM + 1
#: Bytes of text in a chunk and, on average, behind a share; bytes whose anchors are worked out together.
CHUNK, SHARE, BYTES_AT_ONCE = 8_000_000, 4_000_000, 1_000_000
#: Destinations that one sender has rows for at most.
FAN = 4096
#: Different surroundings of an anchor, summed over chunks, from which its strings are dealt one by one.
HOT = 2_000
#: Bits of an anchor's hash that are sent. Chance matches only cost work, as strings are compared byte by byte.
HASH_BITS = 48
_BLOCK_BITS = 16
_PLACE_BITS = 20
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Texts:
    """The bytes of some documents, laid end to end."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray):
        self.ids, self.sizes, self.data = ids, sizes, data
        self.starts = np.cumsum(sizes) - sizes


def _sums(data: np.ndarray) -> np.ndarray:
    power, _ = _power_tables(len(data))
    return np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)))


def _digests(sums: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """64-bit hashes of substrings, by prefix sums. They only bring equal strings together: equality is always checked on the bytes."""
    _, back = _power_tables(len(sums))
    return _mix((sums[start + size] - sums[start]) * back[start])


def hashes_of(data: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """_digests of substrings of data, short ones, by ascending starts."""
    out, sizes, k = np.empty(len(start), np.uint64), np.broadcast_to(size, len(start)), 0
    while k < len(start):
        base = int(start[k])
        j = int(np.searchsorted(start, base + BYTES_AT_ONCE))
        sums = _sums(data[base : int((start[k:j] + sizes[k:j]).max())])
        out[k:j] = _digests(sums, start[k:j] - base, sizes[k:j])
        k = j
    return out


def _leftmost_least(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string start, the place of its leftmost gram of least hash; and that hash. Worked out in blocks that fit the processor's cache."""
    n = len(data) - LENGTH + 1
    at, hashes = np.empty(n, np.int64), np.empty(n, np.uint64)
    for a in range(0, n, 1 << _BLOCK_BITS):
        b = min(n, a + (1 << _BLOCK_BITS))
        sums = _sums(data[a : b + LENGTH - 1])
        grams = _digests(sums, np.arange(b - a + SPAN - 1), GRAM)
        keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        least, width = keys, 1
        while width < SPAN:
            step = min(width, SPAN - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        place = (least & _PLACE).astype(np.int64)
        at[a:b], hashes[a:b] = place + a, grams[place]
    return at, hashes


def anchors(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: document (index), first string start, number of strings, anchor hash, hash of the segment. Starts are in t.data.

    Texts are worked on BYTES_AT_ONCE bytes at a time wherever documents end, so a run may come in two parts.
    """
    found, ends = [], t.starts + t.sizes
    closed = np.maximum(t.starts, ends - LENGTH + 1)
    for a in range(0, len(t.data) - LENGTH + 1, BYTES_AT_ONCE):
        b = min(len(t.data) - LENGTH + 1, a + BYTES_AT_ONCE)
        at, hashes = _leftmost_least(t.data[a : b + LENGTH - 1])
        # Strings that would leave their document are none: its last LENGTH - 1 places start no string.
        shut, opened = (np.bincount(np.clip(x, a, b) - a, minlength=b - a + 1) for x in (closed, ends))
        inside = np.cumsum(shut - opened)[:-1] == 0
        joined = np.zeros(b - a + 1, bool)
        joined[1:-1] = inside[1:] & inside[:-1] & (at[1:] == at[:-1])
        first = np.flatnonzero(inside & ~joined[:-1])
        n = np.flatnonzero(inside & ~joined[1:]) + 1 - first
        found.append((np.searchsorted(t.starts, first + a, "right") - 1, first + a, n, hashes[first] >> np.uint64(64 - HASH_BITS)))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64), np.empty(0, np.uint64)
    doc, first, n, h = (np.concatenate(c) for c in zip(*found, strict=True))
    return doc, first, n, h, hashes_of(t.data, first, n + LENGTH - 1)


# Packing ----------------------------------------------------------------------------------------------------------------


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _stretch(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, each as planes of its bytes: equal high bytes then lie together and compress away."""
    parts = []
    for x in columns:
        raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)
        parts.append(np.ascontiguousarray(raw.T).tobytes())
    return _squeeze(b"".join(parts))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    blob = _stretch(blob)
    widths = [np.dtype(k).itemsize for k in kinds]
    n = len(blob) // sum(widths)
    out, at = [], 0
    for kind, width in zip(kinds, widths, strict=True):
        planes = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * width
    return out


def _first_rows(*keys: np.ndarray) -> np.ndarray:
    """Whether each row (sorted by keys) differs from the row before."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    return new


def _runs(ordered: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    starts = np.flatnonzero(_first_rows(ordered)) if len(ordered) else ordered
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(ordered)).tolist(), strict=len(ordered) > 0):
        yield int(ordered[a]), a, b


#: A packed row: its destination (`key`, a share or a chunk), its kind, the other end (`peer`, a chunk or a share), and the data.
ROWS = "key long, kind int, peer long, blob binary"
ARROW = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("peer", pa.int64()), ("blob", pa.binary())])
ANSWERS, VERDICTS, TEXTS, SEGMENTS, REPLIES = range(5)


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """(kind, peer, blob) of the rows of each key; rows come sorted by key, kind and peer."""
    key, held = None, []
    for batch in batches:
        for k, kind, peer, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            if key is not None and k != key:
                yield key, held
                held = []
            key = k
            held.append((kind, peer, blob.as_py()))
    if key is not None:
        yield key, held


def _share_of(hashes: np.ndarray, shares: int) -> np.ndarray:
    """Least hashes are small ones; mixed again, they spread evenly."""
    return (((_mix(hashes * _MULTIPLIER) >> np.uint64(32)) * np.uint64(shares)) >> np.uint64(32)).astype(np.int64)


class Route:
    """Where the rows of a chunk go: to shares, or, if these are more than `fan`, to crossings of a group of shares and a block of chunks."""

    def __init__(self, chunks: int, shares: int, fan: int):
        self.shares, self.crossed = shares, shares > fan
        self.groups = min(fan, -(-shares // fan)) if self.crossed else shares
        self.per_group = -(-shares // self.groups)
        self.blocks = max(1, -(-chunks // fan))

    def cut(self, chunk: int, share: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(key, start, end) of the rows that these shares, ascending, make."""
        if not self.crossed:
            yield from _runs(share)
            return
        block = int(_mix(np.array([chunk], np.uint64))[0] % np.uint64(self.blocks))
        for group, a, b in _runs(share // self.per_group):
            yield block * self.groups + group, a, b


# 1. Store ---------------------------------------------------------------------------------------------------------------


def _pack_texts(ids: list[np.ndarray], texts: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return _squeeze(np.array([len(sizes)], "<i8").tobytes() + np.concatenate(ids).astype("<i8").tobytes() + sizes.tobytes() + b"".join(texts))


def _unpack_texts(blob: bytes) -> Texts:
    raw = _stretch(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ids, sizes = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(2, n)
    return Texts(ids, sizes, np.frombuffer(raw, np.uint8, offset=8 + 16 * n))


def _to_chunks(limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, seq = TaskContext.get().partitionId() << 32, 0
    ids, texts, size = [], [], 0

    def chunk() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([task + seq]), pa.array([size]), pa.array([_pack_texts(ids, texts)], pa.binary())], ["chunk", "size", "blob"])

    for batch in batches:
        raw = batch.column(1).fill_null(b"")
        own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while start < len(own):
            done = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + max(1, limit - size), "right")))
            ids.append(own[start:end])
            texts += raw.slice(start, end - start).to_pylist()
            size += int(ends[end - 1]) - done
            start = end
            if size >= limit:
                yield chunk()
                ids, texts, size, seq = [], [], 0, seq + 1
    if texts:
        yield chunk()


# 2. Filter --------------------------------------------------------------------------------------------------------------


def _questions(t: Texts, shares: int) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """The anchors of a chunk; their order by share and hash; and the first of each hash in that order. The same each time it is asked."""
    found = anchors(t)
    h = found[3]
    order = np.lexsort((found[4], h, _share_of(h, shares)))
    return found, order, _first_rows(h[order]) if len(h) else np.zeros(0, bool)


def _ask(route: Route):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = _unpack_texts(blob.as_py())
                (doc, _, _, h, digest), order, first = _questions(t, route.shares)
                starts = np.flatnonzero(first)
                if not len(starts):
                    continue
                ids, ordered = t.ids[doc[order]], h[order]
                around = np.add.reduceat(_first_rows(ordered, digest[order]), starts, dtype=np.uint32)
                several = np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts)
                ordered = ordered[starts]
                yield _batch([(s, ANSWERS, chunk, _pack(ordered[a:b], around[a:b], several[a:b])) for s, a, b in route.cut(chunk, _share_of(ordered, route.shares))])

    return run


def _answer(kind: int, hot_from: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each question in its order: 0 if its anchor is met in one document, 1 if in several, 2 if with very many surroundings too."""
    for share, asked in _groups(batches):
        held = [_unpack(blob, "<u8", "<u4", "?") for *_, blob in asked]
        h, around, several = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(_first_rows(h[order]))
        size = np.diff(np.append(starts, len(h)))
        met = (size > 1) | np.logical_or.reduceat(several[order], starts)
        hot = np.add.reduceat(around[order].astype(np.int64), starts) > hot_from
        verdict = np.empty(len(h), np.uint8)
        verdict[order] = np.repeat(met.astype(np.uint8) + (met & hot), size)
        ends = np.cumsum([len(x[0]) for x in held]).tolist()
        out = [(chunk, kind, share, _squeeze(verdict[b - len(x[0]) : b].tobytes())) for (_, chunk, _), x, b in zip(asked, held, ends, strict=True)]
        for k in range(0, len(out), 1000):
            yield _batch(out[k : k + 1000])


class Crossing:
    """The questions of a block of chunks for a group of shares: equal ones are one. The same each time it is asked."""

    def __init__(self, held: list[tuple[int, int, bytes]], shares: int):
        self.asked = [(chunk, _unpack(blob, "<u8", "<u4", "?")) for kind, chunk, blob in held if kind == ANSWERS]
        self.h, self.around, self.several = (np.concatenate(c) for c in zip(*(x for _, x in self.asked), strict=True))
        self.order = np.lexsort((self.h, _share_of(self.h, shares)))
        self.first = _first_rows(self.h[self.order])


def _cross_questions(shares: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in _groups(batches):
            c = Crossing(held, shares)
            starts = np.flatnonzero(c.first)
            h = c.h[c.order][starts]
            around = np.minimum(np.add.reduceat(c.around[c.order].astype(np.int64), starts), 2**32 - 1).astype(np.uint32)
            several = np.logical_or.reduceat(c.several[c.order], starts) | (np.diff(np.append(starts, len(c.h))) > 1)
            yield _batch([(s, ANSWERS, key, _pack(h[a:b], around[a:b], several[a:b])) for s, a, b in _runs(_share_of(h, shares))])

    return run


def _cross_answers(route: Route):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in _groups(batches):
            c = Crossing(held, route.shares)
            united = np.frombuffer(b"".join(_stretch(x) for x in _blobs(held, REPLIES)), np.uint8)
            verdict = np.empty(len(c.h), np.uint8)
            verdict[c.order] = united[np.cumsum(c.first) - 1]
            ends = np.cumsum([len(x[0]) for _, x in c.asked]).tolist()
            yield _batch([(chunk, ANSWERS, key % route.groups, _squeeze(verdict[b - len(x[0]) : b].tobytes())) for (chunk, x), b in zip(c.asked, ends, strict=True)])

    return run


# 3. Segments ------------------------------------------------------------------------------------------------------------


def _classes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, digest: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each segment (`size` bytes from `begin` on) the index of an equal segment of the least document. Equality is that of the bytes."""
    order = np.lexsort((doc, size, digest))
    new = _first_rows(digest[order], size[order]) if len(order) else np.zeros(0, bool)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out = np.arange(len(order))
    for width in np.unique(size).tolist():
        rows = np.lib.stride_tricks.sliding_window_view(data, width)
        own = np.flatnonzero((size[order] == width) & ~new)
        for k in range(0, len(own), 100_000):
            at, of = order[own[k : k + 100_000]], head[own[k : k + 100_000]]
            same = (rows[begin[at]] == rows[begin[of]]).all(1)
            out[at[same]] = of[same]
    return out


def _gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> bytes:
    if not len(begin):
        return b""
    out, total = np.empty(int(size.sum()), np.uint8), np.cumsum(size)
    at = total - size
    for width in np.unique(size).tolist():
        own = np.flatnonzero(size == width)
        rows = np.lib.stride_tricks.sliding_window_view(data, width)
        into = np.lib.stride_tricks.sliding_window_view(out, width, writeable=True)
        into[at[own]] = rows[begin[own]]
    return out.tobytes()


def _pack_segments(owner: np.ndarray, count: np.ndarray, share: np.ndarray, body: bytes) -> bytes:
    head = _pack(owner.astype("<i8"), count.astype(np.uint8), share.astype("<u4"))
    return len(head).to_bytes(8, "little") + head + _squeeze(body)


class Received:
    """Segments that came together, from several rows: document, number of strings, share, and where each begins in data."""

    def __init__(self, held: list[tuple[int, int, bytes]]):
        heads, bodies = [], []
        self.rows = [(peer, blob) for kind, peer, blob in held if kind == SEGMENTS]
        for _, blob in self.rows:
            m = 8 + int.from_bytes(blob[:8], "little")
            heads.append(_unpack(blob[8:m], "<i8", "u1", "<u4"))
            bodies.append(_stretch(blob[m:]))
        self.owner, n, self.share = (np.concatenate(c) for c in zip(*heads, strict=True))
        self.n, self.data = n.astype(np.int64), np.frombuffer(b"".join(bodies), np.uint8)
        self.size = self.n + LENGTH - 1
        self.begin = np.cumsum(self.size) - self.size
        self.lead = _classes(self.data, self.begin, self.size, hashes_of(self.data, self.begin, self.size), self.owner)
        self.ends = np.cumsum([len(x[0]) for x in heads]).tolist()
        self.starts = [0, *self.ends[:-1]]
        # One of each class, by share.
        alone = np.flatnonzero(self.lead == np.arange(len(self.lead)))
        self.sent = alone[np.argsort(self.share[alone], kind="stable")]

    def masks(self, of_lead: np.ndarray) -> np.ndarray:
        """The masks of all segments, by those of their leads. A copy in a larger document recurs as a whole; one in the class's own document as its first does."""
        return np.where(self.owner > self.owner[self.lead], np.uint32(2**SPAN - 1), of_lead[self.lead]).astype("<u4")

    def replies(self, kind: int, peer: int, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = [(to, kind, peer, _pack(mask[a:b])) for (to, _), a, b in zip(self.rows, self.starts, self.ends, strict=True)]
        for k in range(0, len(out), 1000):
            yield _batch(out[k : k + 1000])


def _cross_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, held in _groups(batches):
        r = Received(held)
        out = []
        for share, a, b in _runs(r.share[r.sent]):
            rows = r.sent[a:b]
            out.append((share, SEGMENTS, key, _pack_segments(r.owner[rows], r.n[rows], r.share[rows], _gather(r.data, r.begin[rows], r.size[rows]))))
        yield _batch(out)


def _cross_verdicts(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in _groups(batches):
            r = Received(held)
            of_lead = np.zeros(len(r.lead), np.uint32)
            of_lead[r.sent] = np.concatenate([_unpack(blob, "<u4")[0] for blob in _blobs(held, REPLIES)])
            yield from r.replies(VERDICTS, key % groups, r.masks(of_lead))

    return run


class Segments:
    """The segments of a chunk, worked out anew from its texts and answers wherever they are needed: the same each time.

    begin, count: first string and number of strings. lead: an equal segment of the least document. sent: those that are sent, by share; number:
    their place among these. later: whether a segment's document is larger than that of its lead, so that all its strings recur.
    """

    def __init__(self, t: Texts, answers: list[bytes], route: Route):
        self.route, shares = route, route.shares
        (doc, first, n, h, digest), order, new = _questions(t, shares)
        verdict = np.frombuffer(b"".join(_stretch(x) for x in answers), np.uint8)
        of = np.zeros(len(order), np.uint8)
        of[order] = verdict[np.cumsum(new) - 1] if len(order) else verdict
        whole, split = np.flatnonzero(of == 1), np.flatnonzero(of == 2)
        # Of anchors with very many surroundings each string is a segment, dealt by its own bytes.
        total = np.cumsum(n[split])
        single = np.repeat(first[split] - (total - n[split]), n[split]) + np.arange(total[-1] if len(split) else 0)
        hashes = hashes_of(t.data, single, LENGTH)
        self.begin, self.count = np.concatenate((first[whole], single)), np.concatenate((n[whole], np.ones(len(single), np.int64)))
        self.owner = np.concatenate((t.ids[doc[whole]], np.repeat(t.ids[doc[split]], n[split])))
        share = _share_of(np.concatenate((h[whole], hashes)), shares)
        self.lead = _classes(t.data, self.begin, self.count + LENGTH - 1, np.concatenate((digest[whole], hashes)), self.owner)
        sent = np.flatnonzero(self.lead == np.arange(len(self.lead)))
        self.sent = sent[np.argsort(share[sent], kind="stable")]
        self.share = share[self.sent]
        self.number = np.zeros(len(self.lead), np.int64)
        self.number[self.sent] = np.arange(len(sent))
        self.later = self.owner > self.owner[self.lead]

    def packed(self, t: Texts, chunk: int) -> Iterator[tuple[int, int, int, bytes]]:
        for key, a, b in self.route.cut(chunk, self.share):
            rows = self.sent[a:b]
            yield key, SEGMENTS, chunk, _pack_segments(self.owner[rows], self.count[rows], self.share[a:b], _gather(t.data, self.begin[rows], self.count[rows] + LENGTH - 1))

    def starts(self, verdicts: np.ndarray) -> np.ndarray:
        """Starts of all strings that recur, from the masks of the segments sent."""
        mask = np.where(self.later, np.uint32(2**SPAN - 1), verdicts[self.number[self.lead]]) if len(verdicts) else np.zeros(0, np.uint32)
        hit = np.flatnonzero(mask)
        begin, n, mask = self.begin[hit], self.count[hit], mask[hit]
        total = np.cumsum(n)
        inner = np.arange(total[-1] if len(total) else 0) - np.repeat(total - n, n)
        on = (np.repeat(mask, n) >> inner.astype(np.uint32)) & np.uint32(1) == 1
        return (np.repeat(begin, n) + inner)[on]


def _blobs(held: list[tuple[int, int, bytes]], wanted: int) -> list[bytes]:
    return [blob for kind, _, blob in held if kind == wanted]


def _send_segments(route: Route):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, held in _groups(batches):
            t = _unpack_texts(_blobs(held, TEXTS)[0])
            rows = list(Segments(t, _blobs(held, ANSWERS), route).packed(t, chunk))
            for k in range(0, len(rows), 1000):
                yield _batch(rows[k : k + 1000])

    return run


# 4. Factors -------------------------------------------------------------------------------------------------------------


def suffix_order(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The order of the suffixes at these starts by their first LENGTH bytes: sorted by eight bytes, then, among equal ones, by the next eight."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    word = lambda at: np.ascontiguousarray(words[at]).view(">u8").reshape(-1).astype(np.uint64)
    order = np.argsort(word(starts))
    group = np.cumsum(_first_rows(word(starts[order]))) if len(order) else order
    for depth in (*range(8, LENGTH - 8, 8), LENGTH - 8):
        alone = _first_rows(group) & np.append(_first_rows(group)[1:], True) if len(group) else group.astype(bool)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        next_word = word(starts[order[tied]] + depth)
        inner = np.lexsort((next_word, group[tied]))
        order[tied] = order[tied][inner]
        split = _first_rows(group[tied], next_word[inner])
        new = _first_rows(group)
        new[tied] |= split
        group = np.cumsum(new)
    return order


def common_prefixes(data: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Bytes, at most LENGTH, that each suffix has in common with the one before it in suffix order; 0 for the first."""
    rows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    out = np.zeros(len(ordered), np.int64)
    for k in range(1, len(ordered), 100_000):
        same = rows[ordered[k : k + 100_000]] == rows[ordered[k - 1 : min(len(ordered), k + 100_000) - 1]]
        out[k : k + 100_000] = np.where(same.all(1), LENGTH, same.argmin(1))
    return out


def _towards_smaller(common: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """What each suffix has in common with the nearest one before it of a smaller document; below LENGTH it may be more than that.

    at[r] is a place before r such that no suffix in between has a smaller document than r; least[r] is what all from at[r] to r have in common. Where
    the document there is not smaller, its own place takes over, which doubles the reach each time.
    """
    at, least = np.arange(len(doc)) - 1, common.copy()
    going = np.flatnonzero((at >= 0) & (least >= LENGTH))
    going = going[doc[at[going]] >= doc[going]]
    while len(going):
        via = at[going]
        at_next, least_next = at[via], np.minimum(least[going], least[via])
        at[going], least[going] = at_next, least_next
        on = (at_next >= 0) & (least_next >= LENGTH)
        going, at_next = going[on], at_next[on]
        going = going[doc[at_next] >= doc[going]]
    return np.where(at >= 0, least, 0)


def previous_factors(data: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix: bytes, at most LENGTH, from its start that occur in a smaller document. Exact where it is LENGTH."""
    order = suffix_order(data, starts)
    common, ordered = common_prefixes(data, starts[order]), doc[order]
    before = _towards_smaller(common, ordered)
    after = _towards_smaller(np.concatenate(([0], common[:0:-1])) if len(common) else common, ordered[::-1])[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(before, after)
    return out


def _factors(kind: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for share, held in _groups(batches):
        r = Received(held)
        n, first, begin, data = r.n, r.sent, r.begin, r.data
        total = np.cumsum(n[first])
        inner = np.arange(total[-1]) - np.repeat(total - n[first], n[first])
        starts, owner = np.repeat(begin[first], n[first]) + inner, np.repeat(r.owner[first], n[first])
        # Strings whose hash no other of the share has cannot recur; the others are put in suffix order.
        hashes = hashes_of(data, starts, LENGTH)
        order = np.argsort(hashes)
        new = _first_rows(hashes[order])
        again = np.sort(order[~(new & np.append(new[1:], True))])
        gone = np.zeros(len(starts), bool)
        gone[again] = previous_factors(data, starts[again], owner[again]) >= LENGTH
        mask = np.zeros(len(n), np.uint32)
        mask[first] = np.bitwise_or.reduceat(gone.astype(np.uint32) << inner.astype(np.uint32), total - n[first])
        yield from r.replies(kind, share, r.masks(mask))


# 5. Cut -----------------------------------------------------------------------------------------------------------------


def covered(n_bytes: int, starts: np.ndarray) -> np.ndarray:
    """Which bytes strings of LENGTH at these starts cover."""
    change = np.zeros(n_bytes + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def _cut(route: Route):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _groups(batches):
            t = _unpack_texts(_blobs(held, TEXTS)[0])
            verdicts = [_unpack(blob, "<u4")[0] for blob in _blobs(held, VERDICTS)]
            gone = covered(len(t.data), Segments(t, _blobs(held, ANSWERS), route).starts(np.concatenate(verdicts))) if verdicts else np.zeros(len(t.data), bool)
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            edges = t.starts[(t.sizes > 0) & (t.starts < len(gone))]
            opens[edges] = gone[edges]
            removed, spans = (np.concatenate(([0], np.cumsum(x)))[np.stack((t.starts, t.starts + t.sizes))] for x in (gone, opens))
            removed, spans = removed[1] - removed[0], spans[1] - spans[0]
            digests = []
            for a, size, r in zip(t.starts.tolist(), t.sizes.tolist(), removed.tolist(), strict=True):
                own = t.data[a : a + size]
                digests.append(hashlib.sha256((own[~gone[a : a + size]] if r else own).tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(t.ids), pa.array(t.sizes), pa.array(removed), pa.array(spans), pa.array(digests, pa.string())], names)

    return run


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, share: int = SHARE, fan: int = FAN, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document. chunk and share: bytes of text; fan: rows of a sender; hot: surroundings."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    by_key = lambda frame: frame.repartition(parts, "key").sortWithinPartitions("key", "kind", "peer")

    stored = materialize(own.where("doc_id is not null").mapInArrow(partial(_to_chunks, chunk), "chunk long, size long, blob binary"), "texts", "none")
    texts = stored.select(F.col("chunk").alias("key"), F.lit(TEXTS).alias("kind"), F.lit(0).cast("long").alias("peer"), "blob")
    size, chunks = stored.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    route = Route(chunks, max(1, -(-size // share)), fan)

    asked = stored.select("chunk", "blob").mapInArrow(_ask(route), ROWS)
    if route.crossed:
        asked = materialize(asked, "asked", "none")
        crossed = by_key(asked).mapInArrow(_cross_questions(route.shares), ROWS)
        replies = by_key(crossed).mapInArrow(partial(_answer, REPLIES, hot), ROWS)
        answers = materialize(by_key(asked.union(replies)).mapInArrow(_cross_answers(route), ROWS), "answers", "none")
        discard(asked)
    else:
        answers = materialize(by_key(asked).mapInArrow(partial(_answer, ANSWERS, hot), ROWS), "answers", "none")
    segments = by_key(answers.union(texts)).mapInArrow(_send_segments(route), ROWS)
    if route.crossed:
        segments = materialize(segments, "segments", "none")
        crossed = by_key(segments).mapInArrow(_cross_segments, ROWS)
        replies = by_key(crossed).mapInArrow(partial(_factors, REPLIES), ROWS)
        verdicts = by_key(segments.union(replies)).mapInArrow(_cross_verdicts(route.groups), ROWS)
    else:
        verdicts = by_key(segments).mapInArrow(partial(_factors, VERDICTS), ROWS)
    # Texts and answers are read again rather than carried along: what is known of each segment would take more room than working it out anew.
    last = by_key(verdicts.union(answers).union(texts))
    done = last.mapInArrow(_cut(route), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    alone = own.where("doc_id is null").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")
    )
    return done.union(alone)
