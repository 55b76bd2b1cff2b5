"""Byte-level BPE encoding and decoding with a public tokenizer file.

A text is cut where a merge can never reach across, each distinct piece is encoded once per worker and kept in a bounded
memo, and the pieces' ids are joined. The merges of a piece follow the segment-tree method: leaves hold (rank, place) of
each adjacent pair, the root is the leftmost pair of lowest rank, and each merge updates three leaves and the nodes above
them. Many pieces of similar length are merged at once, a numpy row per piece; long pieces are merged one by one.

Defined results: a null text counts as empty and has no ids; rows that repeat are encoded row by row; other columns
pass through. Nothing is shuffled: each partition is read, encoded and passed on in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words in a worker's memo, and bytes of text encoded at a time.
MEMO_ENTRIES = 600_000
BYTES_AT_ONCE = 3_000_000

# Fixed value: the pattern that byte-level BPE vocabularies of this family split text with.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
CUT = "\x01"
NONE = np.iinfo(np.int64).max
#: Pieces of more ids than this are merged one by one.
ROW_LIMIT = 64


def printable_bytes() -> dict[int, str]:
    """The character that stands for each byte in such vocabularies: itself where printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    rest = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairRanks:
    """Ranks of adjacent pairs in an open-addressed table that numpy can probe for many pairs at once."""

    def __init__(self, pairs: np.ndarray):
        self.bits = max(10, int(len(pairs) * 5).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, -1, np.int64)
        left = np.arange(len(pairs))
        at = self._slot(pairs)
        while len(left):
            free = self.keys[at[left]] < 0
            slots, first = np.unique(at[left][free], return_index=True)
            placed = left[free][first]
            self.keys[slots], self.ranks[slots] = pairs[placed], placed
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] = np.where(self.keys[at[left]] >= 0, (at[left] + 1) & ((1 << self.bits) - 1), at[left])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        while len(left):
            got = self.keys[at[left]]
            hit = got == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (got >= 0)]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        return out


class Bpe:
    """Vocabulary, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        by_char = {c: b for b, c in printable_bytes().items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.byte_ids = np.array([vocab[c] for _, c in sorted(printable_bytes().items())], np.int64)
        a, b = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.ranks = PairRanks((a << 32) | b)
        self.rank_of = {(int(x) << 32) | int(y): r for r, (x, y) in enumerate(zip(a, b, strict=True))}
        self.merged = np.array([vocab["".join(m)] for m in merges], np.int64)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        texts = {i: bytes(by_char[c] for c in t) for t, i in vocab.items() if t not in self.specials}
        texts |= {i: t.encode() for t, i in self.specials.items()}
        ordered = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.token_lengths = np.array([len(t) for t in ordered], np.int64)
        self.token_starts = np.concatenate(([0], np.cumsum(self.token_lengths)[:-1]))
        self.token_bytes = np.frombuffer(b"".join(ordered), np.uint8)
        self.split_specials = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None

    # Merging -------------------------------------------------------------------------------------------------------

    def _pair_keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        rank = self.ranks.find((left << 32) | right)
        return np.where(rank >= 0, (rank << 32) | place, NONE)

    def merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """rows: (pieces, width) ids, -1 behind the end, width a power of two. Returns them merged, -1 in each gap."""
        n, width = rows.shape
        tok = rows.copy()
        place = np.arange(width)
        nxt = np.tile(place + 1, (n, 1))
        prv = np.tile(place - 1, (n, 1))
        length = (rows >= 0).sum(1)
        tree = np.full((n, 2 * width), NONE, np.int64)
        r, p = np.nonzero(rows[:, 1:] >= 0)
        tree[r, width + p] = self._pair_keys(tok[r, p], tok[r, p + 1], p)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            at, rank = root & 0xFFFFFFFF, root >> 32
            gone = nxt[live, at]
            after, before = nxt[live, gone], prv[live, at]
            tok[live, at] = self.merged[rank]
            tok[live, gone] = -1
            nxt[live, at] = after
            inner = after < length[live]
            prv[live[inner], after[inner]] = at[inner]
            tree[live, width + gone] = NONE
            tree[live, width + at] = NONE
            tree[live[inner], width + at[inner]] = self._pair_keys(tok[live[inner], at[inner]], tok[live[inner], after[inner]], at[inner])
            back = before >= 0
            tree[live[back], width + before[back]] = self._pair_keys(tok[live[back], before[back]], tok[live[back], at[back]], before[back])
            for leaf in (at, gone, np.maximum(before, 0)):
                node = (width + leaf) >> 1
                while node[0]:
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                    node = node >> 1
            live = live[tree[live, 1] < NONE]
        return tok

    def merge_long(self, ids: list[int]) -> list[int]:
        """One piece, by the same tree in plain lists."""
        n = len(ids)
        width = 1 << max(1, (n - 1).bit_length())
        tok, nxt, prv = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        keys = self._pair_keys(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64), np.arange(n - 1))
        tree = [NONE] * width + keys.tolist() + [NONE] * (width - n + 1)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(leaf: int, value: int) -> None:
            i = width + leaf
            tree[i] = value
            i >>= 1
            while i:
                tree[i] = min(tree[2 * i], tree[2 * i + 1])
                i >>= 1

        def key(left: int, right: int, place: int) -> int:
            rank = self.rank_of.get((left << 32) | right)
            return NONE if rank is None else (rank << 32) | place

        while tree[1] < NONE:
            at, rank = tree[1] & 0xFFFFFFFF, tree[1] >> 32
            gone = nxt[at]
            after, before = nxt[gone], prv[at]
            tok[at], tok[gone], nxt[at] = int(self.merged[rank]), -1, after
            put(gone, NONE)
            if after < n:
                prv[after] = at
            put(at, key(tok[at], tok[after], at) if after < n else NONE)
            if before >= 0:
                put(before, key(tok[before], tok[at], before))
        return [t for t in tok if t >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, merged as far as they go, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(lengths > ROW_LIMIT):
            ids = self.byte_ids[np.frombuffer(pieces[i], np.uint8)]
            out[i] = np.array(self.merge_long(ids.tolist()), "<u4").tobytes()
        low, width = 0, 2
        while width <= ROW_LIMIT:
            chosen = np.flatnonzero((lengths > low) & (lengths <= width))
            for part in (chosen[k : k + 200_000 // width] for k in range(0, len(chosen), 200_000 // width)):
                rows = np.full((len(part), width), -1, np.int64)
                inside = np.arange(width) < lengths[part][:, None]
                rows[inside] = self.byte_ids[np.frombuffer(b"".join([pieces[i] for i in part.tolist()]), np.uint8)]
                done = self.merge_rows(rows)
                kept = done >= 0
                flat, ends = done[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
                start = 0
                for i, end in zip(part.tolist(), ends, strict=True):
                    out[i] = flat[start:end]
                    start = end
            low, width = width, 2 * width
        return out

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, special tokens included, as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            parts = self.split_specials.split(text) if self.split_specials else [text]
            ids = []
            for k, part in enumerate(parts):
                if k % 2:
                    ids.append(np.array([self.specials[part]], "<u4").tobytes())
                else:
                    ids += self.encode_pieces([p.encode() for p in PIECES.findall(part)])
            out.append(b"".join(ids))
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that hold no newline and no special token, split all at once with newlines between them: all ids, and how many each word has."""
        pieces = PIECES.findall("\n".join(words))
        index: dict[str, int] = {}
        code = np.fromiter((index.setdefault(p, len(index)) for p in pieces), np.int64, len(pieces))
        between = code == index.get("\n", -1)
        coded = self.encode_pieces([b"" if p == "\n" else p.encode() for p in index])
        sizes = np.fromiter((len(x) // 4 for x in coded), np.int64, len(coded))
        starts, held = np.cumsum(sizes) - sizes, sizes[code]
        ends = np.append(np.cumsum(held)[between], held.sum())
        return gathered(np.frombuffer(b"".join(coded), "<u4"), starts[code], held), np.diff(ends, prepend=0)

    # Decoding ------------------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, one after another."""
        lengths = self.token_lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.token_starts[ids] - (ends - lengths), lengths)
        return self.token_bytes[shift + np.arange(total)].tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of flat, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class TextEncoder:
    """Encodes whole texts by words, remembering the ids of words met.

    A cut is made before each space and around each newline. A text in which such a cut could split white space that belongs together, or
    that holds a special token, is encoded as a whole. When the memo is full it starts anew from the words of the slice at hand. It is held in
    Arrow and numpy arrays, and words are looked up many at a time.
    """

    def __init__(
        self,
        encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
        encode_texts: Callable[[list[str]], list[bytes]],
        specials: Iterable[str],
        memo_entries: int = MEMO_ENTRIES,
        bytes_at_once: int = BYTES_AT_ONCE,
    ):
        self.memo_entries, self.bytes_at_once = memo_entries, bytes_at_once
        self.encode_words, self.encode_texts, self.specials = encode_words, encode_texts, list(specials)
        self.words = pa.array([], pa.string())
        self.sizes = np.empty(0, np.int64)  # -1: cannot stand alone
        self.flat = np.empty(0, np.uint32)

    def _encode_new(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these words, and how many each has: -1 if it can't stand alone."""
        # White space that a cut could tear from its like stands at a word's end, or at its start behind the space that the cut is made at.
        body = pc.utf8_ltrim(words, " ")
        torn = pc.not_equal(pc.binary_length(pc.utf8_trim_whitespace(body)), pc.binary_length(body)).to_numpy(zero_copy_only=False)
        filled = pc.binary_length(body).to_numpy() > 0
        newline = pc.equal(words, "\n").to_numpy(zero_copy_only=False)
        sizes = np.where(torn | (~filled & (pc.binary_length(words).to_numpy() > 0)), -1, 0)
        coded = np.flatnonzero(filled & ~torn)
        flat, sizes[coded] = self.encode_words(words.take(pa.array(coded)).to_pylist())
        for i in np.flatnonzero(newline):
            own = np.frombuffer(self.encode_texts(["\n"])[0], "<u4")
            at, sizes[i] = int(np.maximum(sizes[:i], 0).sum()), len(own)
            flat = np.concatenate((flat[:at], own, flat[at:]))
        return flat, sizes

    def _ids_of(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct words, where the ids of each begin in self.flat and how many there are; -1 if it can't stand alone."""
        found = pc.index_in(words, value_set=self.words)
        missing = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        if len(missing):
            new = words.take(pa.array(missing))
            flat, sizes = self._encode_new(new)
            at[missing] = len(self.words) + np.arange(len(missing))
            self.words = pa.concat_arrays([self.words, new])
            self.sizes, self.flat = np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, flat))
        held = np.maximum(self.sizes, 0)
        starts = np.cumsum(held) - held
        if len(self.words) > self.memo_entries:
            self.words, self.flat, self.sizes = words, gathered(self.flat, starts[at], held[at]), self.sizes[at]
            held = np.maximum(self.sizes, 0)
            return np.cumsum(held) - held, self.sizes
        return starts[at], self.sizes[at]

    def _slice_ids(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these texts, and the bounds of each."""
        # Spark may send 64-bit offsets; a slice fits 32.
        n, texts = len(texts), texts.cast(pa.string())
        whole = np.zeros(n, bool)
        places = np.frombuffer(texts.buffers()[1], np.int32, n + 1, 4 * texts.offset)
        raw = memoryview(texts.buffers()[2] or b"")[places[0] : places[-1]].tobytes()
        for held in (CUT, *self.specials):
            if held.encode() in raw:
                whole |= pc.match_substring(texts, held).to_numpy(zero_copy_only=False)
        cut = pc.replace_substring(pc.replace_substring(texts, " ", CUT + " "), "\n", CUT + "\n" + CUT)
        lists = pc.split_pattern(cut, CUT)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        starts, sizes = self._ids_of(coded.dictionary)
        # An empty word is one between two cuts; at either end of a text it means nothing.
        unsafe = sizes[at] < 0
        if (empty := pc.index(coded.dictionary, "").as_py()) >= 0:
            inner = at == empty
            inner[bounds[:-1]] = False
            inner[bounds[1:] - 1] = False
            unsafe |= inner
        whole |= np.logical_or.reduceat(unsafe, bounds[:-1])
        sizes = np.maximum(sizes, 0)[at]
        ids = gathered(self.flat, starts[at], sizes)
        ends = np.concatenate(([0], np.cumsum(sizes)))[bounds]
        if not whole.any():
            return ids, ends
        parts = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        rows = np.flatnonzero(whole).tolist()
        for i, own in zip(rows, self.encode_texts([texts[i].as_py() for i in rows]), strict=True):
            parts[i] = np.frombuffer(own, "<u4")
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def flat_slices(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All ids and the bounds of each text, in slices of about `bytes_at_once` of text. A null text has none."""
        texts = texts.fill_null("") if texts.null_count else texts
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
        start = 0
        while start < len(texts):
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + self.bytes_at_once, "right")))
            yield self._slice_ids(texts.slice(start, end - start))
            start = end

    def encode(self, texts: pa.Array) -> Iterator[pa.Array]:
        """The same as binary values of little-endian unsigned 32-bit integers."""
        for ids, ends in self.flat_slices(texts):
            offsets, data = pa.py_buffer((4 * ends).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
            yield pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, offsets, data]).cast(pa.binary())


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """This worker's encoder by segment trees."""
    bpe = load(path)
    return TextEncoder(bpe.encode_words, bpe.encode_texts, bpe.specials)


def _decoded(ids: pa.Array, bpe: Bpe) -> pa.Array:
    return pa.array((bpe.decode(np.frombuffer(x.as_py() or b"", "<u4")).decode("utf-8", "replace") for x in ids), pa.string())


def _encoded(batches: Iterator[pa.RecordBatch], path: str, text_col: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches, each with the ids of its texts."""
    encoder = text_encoder(path)
    for batch in batches:
        start = 0
        for ids in encoder.encode(batch.column(batch.schema.get_field_index(text_col))):
            yield batch.slice(start, len(ids)), ids
            start += len(ids)
    pa.default_memory_pool().release_unused()


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with `ids_col` in place of the text: the ids as little-endian unsigned 32-bit integers, in one binary value.

    A column of docs that already has this name is replaced.
    """
    rest = [c for c in docs.columns if c not in (text_col, ids_col)]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(ids_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _encoded(batches, path, text_col):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], [*rest, ids_col])

    return docs.select(*rest, text_col).mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """coded with a column `text_col` more, or in place of one of this name: the text of its ids, invalid UTF-8 replaced. Null ids give an empty text."""
    rest = [c for c in coded.columns if c != text_col]
    schema = T.StructType([*(coded.schema[c] for c in rest), T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = _decoded(batch.column(batch.schema.get_field_index(ids_col)), load(path))
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*rest, text_col])

    return coded.select(*rest).mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """encode, with the text replaced by what its ids decode to, in one pass and so in one Python worker for each task."""
    rest = [c for c in docs.columns if c not in (text_col, ids_col)]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(ids_col, T.BinaryType()), T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _encoded(batches, path, text_col):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, _decoded(ids, load(path))], [*rest, ids_col, text_col])

    return docs.select(*rest, text_col).mapInArrow(run, schema)
