"""Toxicity by a learned lexicon, met through Levenshtein automata over its trie, with scores of context windows.

Lexicon. Every word and every word beginning of STEM_LENGTHS letters of the labelled texts is counted by documents, in all of them. Entries are those that
stand in MIN_DOCS toxic documents at least, before many different next words (a third as many as documents, up to MANY_CONTEXTS; copies of one document
have the same ones, so they make no entry), and that are likelier in toxic than in clean documents by MIN_WEIGHT (a smoothed log ratio, the entry's weight) and by a likelihood ratio of MIN_RATIO.

Matching. The entries make a trie; the automaton that accepts whatever is within one edit of a word of FUZZY_LENGTH letters is walked over it. Its states are
sets of (trie node, edits so far), made when a word first needs them and kept in one table, so that all different words of a batch step through it
together, a letter at a time, and most reach the dead state after three. A word counts by its best exact entry (as a whole, or by its beginning), else by
its best entry within one edit, unless it is a word of its own: one of KNOWN_DOCS clean documents at least, and no likelier in toxic ones.

Context. Matches inside quotation marks count apart from others, each word once a document. Further evidence: the highest sum of weights in a window of WINDOW words, in which quoted
matches count by QUOTED; sums by length; the strongest single match. A logistic model joins these. It is fitted on SAMPLE labelled documents at most, by
hash; each is scored by the lexicon of the other half of the labelled documents, and coefficients are drawn towards PRIOR, so that few labels, or none of
some kind (such as no quotations), leave sensible ones.

Texts with labels, picked out by a bitmap of 8 MB at most, are shuffled once, by the join with the labels; the texts that are scored never are.

Defined results: a null or empty text has no evidence, and the score of such; an id with several labels is toxic if one says so; labels that are null, or
of no document, teach nothing; rows of one id, and repeated rows, are scored alike; a row without an id has held_out null; without a toxic label the
lexicon is empty; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.order_minhash import _bitmap
from quarry.session import discard, materialize

FOLDS = 5
STEM_LENGTHS = range(4, 9)
MIN_DOCS, MIN_CONTEXTS, MANY_CONTEXTS, MIN_WEIGHT, MIN_RATIO = 3, 3, 10, 2.0, 24.0
#: Entries of the lexicon at most, those of the highest likelihood ratio; labelled documents that the last step is fitted on at most.
LEXICON, SAMPLE = 20_000, 20_000
#: Letters of a word from which one edit is forgiven, and the weight it needs.
FUZZY_LENGTH, FUZZY_WEIGHT = 5, 5.0
#: Clean documents that make a word within an edit one of its own, and such words at most, those of most clean documents.
KNOWN_DOCS, KNOWN = 2, 100_000
#: Words of a window; what a match within an edit and one in quotation marks count of another.
WINDOW, NEAR, QUOTED = 20, 0.7, 0.3
#: Intercept, then coefficients of: matches outside quotation marks, matches inside, best window, weight by length, strongest match.
PRIOR = np.array([-4.0, 0.8, 0.2, 0.5, 0.3, 0.8])
PULL = 1.0
LONGEST, BYTES_AT_ONCE, MAX_STATES = 40, 2_000_000, 40_000

TOKEN = re.compile(r"""[^\s,.;:!?/|\\()\[\]{}<>"“”„«»‹›…—–]+""")
QUOTE = re.compile(r'"[^"\n]*"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|‹[^›\n]*›')
_EDGE = "#*$%&'’‘-_@+=~`^"


class Words:
    """The words of some texts: their texts (index) and numbers in `distinct`, the different ones in lower case."""

    def __init__(self, texts: list[str | None]):
        found = [TOKEN.findall((t or "").lower()) for t in texts]
        self.sizes = np.fromiter(map(len, found), np.int64, len(found))
        coded = pa.array([w for words in found for w in words], pa.large_string()).dictionary_encode()
        own: dict[str, int] = {}
        numbers = [own.setdefault(w.strip(_EDGE), len(own)) for w in coded.dictionary.to_pylist()]
        self.distinct = list(own)
        self.at = np.array(numbers, np.int64)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)


def _terms(word: str) -> list[str]:
    """A word as a whole, and its beginnings."""
    if not 3 <= len(word) <= LONGEST or not any(map(str.isalpha, word)):
        return []
    return ["=" + word, *("^" + word[:k] for k in STEM_LENGTHS if k <= len(word))]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while start < len(texts):
        done = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + BYTES_AT_ONCE, "right")))
        yield start, end
        start = end


def _counted(labelled: DataFrame, bits=None) -> DataFrame:
    """term, half, docs, contexts (bits of hashes of the next words): summed over the texts of a slice. bits: a bitmap of the terms that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if bits is None else bits.value
        for batch in batches:
            half = batch.column(0).to_numpy()
            for start, end in _slices(batch.column(1)):
                words = Words(batch.column(1).slice(start, end - start).to_pylist())
                if not len(words.at):
                    continue
                own: dict[str, int] = {}
                terms = [_terms(w) for w in words.distinct]
                if held is not None:
                    terms = [[t for t in ts if held[(at := zlib.crc32(t.encode()) & (8 * len(held) - 1)) >> 3] >> (at & 7) & 1] for ts in terms]
                flat = np.array([own.setdefault(t, len(own)) for ts in terms for t in ts], np.int64)
                size = np.fromiter(map(len, terms), np.int64, len(terms))
                # A word's place in a text, and the hash of the word after it.
                hashed = np.array([zlib.crc32(w.encode()) & 63 for w in words.distinct], np.uint64)
                mask = np.ones(len(words.at), np.uint64)
                mask[:-1] = np.where(words.owner[1:] == words.owner[:-1], np.uint64(1) << hashed[words.at[1:]], np.uint64(1))
                n = size[words.at]
                total = np.cumsum(n)
                if not total[-1]:
                    continue
                base = np.cumsum(size) - size
                term = flat[np.repeat(base[words.at], n) + np.arange(total[-1]) - np.repeat(total - n, n)]
                owner = np.repeat(words.owner, n)
                key = term * 2 + np.repeat(half[start:end].astype(np.int64), words.sizes).repeat(n)
                order = np.lexsort((owner, key))
                key, owner = key[order], owner[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))
                docs = np.add.reduceat(new.astype(np.int64), first)
                contexts = np.bitwise_or.reduceat(np.repeat(mask, n)[order], first).view(np.int64)
                names = pa.array(list(own), pa.string()).take(pa.array(key[first] >> 1))
                yield pa.RecordBatch.from_arrays([names, *map(pa.array, (key[first] & 1, docs, contexts))], ["term", "half", "docs", "contexts"])

    return labelled.select("half", "text").mapInArrow(run, "term string, half long, docs long, contexts long")


@dataclass
class Entry:
    """Documents with a term among toxic and among clean ones, and bits of next words, of each half of the labelled documents."""

    term: str
    toxic: np.ndarray
    clean: np.ndarray
    contexts: np.ndarray


def _by_half(name: str, made: str, how=F.sum) -> list[Column]:
    return [how(F.when(F.col("half") == h, F.col(made)).otherwise(0)).alias(f"{name}{h}") for h in (0, 1)]


def _log_ratio(k: Column, expected: Column) -> Column:
    return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)


def _entries(labelled: DataFrame) -> tuple[list[Entry], np.ndarray]:
    """Terms that may enter a lexicon, LEXICON at most; and documents by class (clean, toxic) and half."""
    sizes = np.zeros((2, 2), np.int64)
    for r in labelled.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["toxic"], r["half"]] = r["n"]
    spark = labelled.sparkSession
    toxic = _counted(labelled.where("toxic = 1")).groupBy("term").agg(*_by_half("t", "docs"), *_by_half("m", "contexts", F.bit_or))
    enough = F.greatest(F.lit(MIN_CONTEXTS), F.least(F.lit(MANY_CONTEXTS), (F.col("t0") + F.col("t1")) / 3))
    often = (F.col("t0") + F.col("t1") >= MIN_DOCS) & (F.bit_count(F.col("m0").bitwiseOR(F.col("m1"))) >= enough)
    candidates = materialize(toxic.where(often), "toxic-terms")
    bits = spark.sparkContext.broadcast(_bitmap(candidates.select(F.crc32("term").alias("h"))))
    clean = _counted(labelled.where("toxic = 0"), bits).groupBy("term").agg(*_by_half("c", "docs"))
    both = candidates.join(clean, "term", "left").fillna(0, ["c0", "c1"])
    t, c = F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1")
    n, of_toxic = int(sizes.sum()), int(sizes[1].sum())
    share, seen = of_toxic / max(1, n), t + c
    ratio = 2 * sum(
        (_log_ratio(k, seen_or_not * p) for k, seen_or_not, p in ((t, seen, share), (c, seen, 1 - share), (of_toxic - t, n - seen, share), (n - of_toxic - c, n - seen, 1 - share))),
        F.lit(0.0),
    )
    likelier = t * (n - of_toxic) > c * of_toxic
    rows = both.where(likelier & (ratio >= MIN_RATIO)).orderBy(ratio.desc(), "term").limit(LEXICON).collect()
    found = [Entry(r["term"], np.array([r["t0"], r["t1"]]), np.array([r["c0"], r["c1"]]), np.array([r["m0"], r["m1"]])) for r in rows]
    discard(candidates)
    return found, sizes


def lexicon(entries: list[Entry], sizes: np.ndarray, halves: list[int]) -> dict[str, float]:
    """The weight of each term that the labelled documents of these halves bear out."""
    clean, toxic = (float(sizes[k, halves].sum()) for k in (0, 1))
    out = {}
    for e in entries:
        t, c = float(e.toxic[halves].sum()), float(e.clean[halves].sum())
        contexts = int(np.bitwise_or.reduce(e.contexts[halves])) & (2**64 - 1)
        weight = float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)))
        if t >= MIN_DOCS and contexts.bit_count() >= max(MIN_CONTEXTS, min(MANY_CONTEXTS, t / 3)) and weight >= MIN_WEIGHT:
            out[e.term] = weight
    return out


def known_words(labelled: DataFrame, weights: dict[str, float], sizes: np.ndarray) -> list[frozenset[str]]:
    """Words within an edit of an entry that are words of their own: by the first half of the labelled documents, by the second, and by both."""
    shared = labelled.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value)
        for batch in batches:
            side = 2 * batch.column(0).to_numpy() + batch.column(1).to_numpy()
            for start, end in _slices(batch.column(2)):
                words = Words(batch.column(2).slice(start, end - start).to_pylist())
                if not words.distinct:
                    continue
                near = automaton.evidence(words.distinct)[1] > 0
                found = near[words.at]
                pairs = np.unique(np.stack((words.at[found], words.owner[found])), axis=1)
                keys, docs = np.unique(pairs[0] * 4 + side[start:end][pairs[1]], return_counts=True)
                names = pa.array([words.distinct[k] for k in (keys >> 2).tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(keys & 3), pa.array(docs)], ["word", "side", "docs"])

    counted = labelled.select(F.col("half"), F.col("toxic").cast("long"), "text").mapInArrow(run, "word string, side long, docs long")
    by_side = [F.sum(F.when(F.col("side") == 2 * h + k, F.col("docs")).otherwise(0)).alias(f"{name}{h}") for h in (0, 1) for k, name in enumerate("ct")]
    rows = counted.groupBy("word").agg(*by_side).where(F.col("c0") + F.col("c1") >= KNOWN_DOCS).orderBy((F.col("c0") + F.col("c1")).desc(), "word").limit(KNOWN).collect()
    out = []
    for halves in ([0], [1], [0, 1]):
        clean, toxic = (float(sizes[k, halves].sum()) for k in (0, 1))
        count = lambda r, name: sum(r[f"{name}{h}"] for h in halves)  # noqa: B023, E731
        out.append(frozenset(r["word"] for r in rows if (c := count(r, "c")) >= KNOWN_DOCS and np.log((count(r, "t") + 0.5) / (toxic + 1) / ((c + 0.5) / (clean + 1))) < MIN_WEIGHT))
    return out


class Automaton:
    """The trie of a lexicon, and the states of the Levenshtein automata over it that words have needed so far."""

    DEAD, START = 0, 1

    def __init__(self, weights: dict[str, float], known: frozenset[str] = frozenset()):
        self.known = known
        self.children: list[dict[int, int]] = [{}]
        self.word, self.stem, self.fuzzy = [0.0], [0.0], [0.0]
        letters = sorted({ch for term in weights for ch in term[1:]})
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(ch) for ch in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        self.forgiving = [False]
        for term, weight in weights.items():
            node, word = 0, term[1:]
            forgiving = term[0] == "=" and len(word) >= FUZZY_LENGTH and weight >= FUZZY_WEIGHT
            path = [0]
            for ch in self.classes[[ord(x) for x in word]].tolist():
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    for values in (self.word, self.stem, self.fuzzy):
                        values.append(0.0)
                    self.forgiving.append(False)
                node = self.children[node][ch]
                path.append(node)
            if forgiving:
                self.fuzzy[node] = weight
                for x in path:
                    self.forgiving[x] = True
            values = self.word if term[0] == "=" else self.stem
            values[node] = weight
        self._forget()

    def _forget(self) -> None:
        self.number: dict[frozenset[tuple[int, int]], int] = {frozenset(): self.DEAD}
        self.states: list[frozenset[tuple[int, int]]] = [frozenset()]
        self.next = np.full((1024, self.width), -1, np.int32)
        self.next[self.DEAD] = self.DEAD
        self.values = np.zeros((1024, 3))
        self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The number of a state; reached: edits by trie node. A missing letter is an edit that reads nothing."""
        for node in [n for n, edits in reached.items() if not edits]:
            for child in self.children[node].values():
                if self.forgiving[child]:
                    reached.setdefault(child, 1)
        key = frozenset(reached.items())
        if key not in self.number:
            self.number[key] = at = len(self.states)
            self.states.append(key)
            if at == len(self.next):
                self.next = np.concatenate((self.next, np.full_like(self.next, -1)))
                self.values = np.concatenate((self.values, np.zeros_like(self.values)))
            exact, near = [n for n, e in key if not e], [n for n, e in key if e]
            self.values[at] = [max((v[n] for n in own), default=0.0) for v, own in ((self.word, exact), (self.stem, exact), (self.fuzzy, near))]
        return self.number[key]

    def _step(self, state: int, letter: int) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if (not edits or self.forgiving[node]) and reached.get(node, 2) > edits:
                reached[node] = edits

        for node, edits in self.states[state]:
            if letter in self.children[node]:
                reach(self.children[node][letter], edits)
            if not edits:
                reach(node, 1)
                for child in self.children[node].values():
                    reach(child, 1)
        return self._state(reached)

    def evidence(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word, the weight of its best exact entry, and that of the best one within an edit if there is no exact one."""
        if len(self.states) > MAX_STATES:
            self._forget()
        size = np.fromiter(map(len, words), np.int64, len(words))
        letters = self.classes[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        start = np.cumsum(size) - size
        state = np.full(len(words), self.START, np.int64)
        exact, near = np.zeros(len(words)), np.zeros(len(words))
        going, place = np.flatnonzero(size > 0), 0
        while len(going):
            at, read = state[going], letters[start[going] + place]
            after = self.next[at, read]
            if (unknown := after < 0).any():
                for key in np.unique(at[unknown] * self.width + read[unknown]).tolist():
                    made = self._step(*divmod(key, self.width))
                    self.next[key // self.width, key % self.width] = made
                after = self.next[at, read]
            state[going] = after
            values, place = self.values[after], place + 1
            ended = size[going] == place
            exact[going] = np.maximum(exact[going], np.maximum(values[:, 1], np.where(ended, values[:, 0], 0)))
            near[going] = np.where(ended, values[:, 2], 0)
            going = going[~ended & (after != self.DEAD)]
        near[exact > 0] = 0
        for i in np.flatnonzero(near).tolist():
            if words[i] in self.known:
                near[i] = 0
        return exact, near


def _quoted(text: str, places: np.ndarray) -> np.ndarray:
    """Whether the words at these places stand in quotation marks."""
    spans = [m.span() for m in QUOTE.finditer(text)]
    if not spans:
        return np.zeros(len(places), bool)
    at = np.array([m.start() for m in TOKEN.finditer(text)])[places]
    begins, ends = np.array(spans).T
    span = np.searchsorted(begins, at, "right") - 1
    return (span >= 0) & (at < ends[np.maximum(span, 0)])


def _best_window(owner: np.ndarray, place: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """The highest sum of weights of words that stand within WINDOW words, of each text. By text, then place."""
    out = np.zeros(texts)
    if len(owner):
        line = owner * (1 << 40) + place
        sums = np.concatenate(([0.0], np.cumsum(weight)))
        np.maximum.at(out, owner, sums[np.searchsorted(line, line + WINDOW)] - sums[np.arange(len(line))])
    return out


def features(automaton: Automaton, texts: list[str | None]) -> np.ndarray:
    """A row of evidence, as PRIOR names it, of each text."""
    words, n = Words(texts), len(texts)
    exact, near = automaton.evidence(words.distinct) if words.distinct else (np.zeros(0), np.zeros(0))
    found = np.flatnonzero((exact + near)[words.at] > 0)
    owner = words.owner[found]
    place = found - (np.cumsum(words.sizes) - words.sizes)[owner]
    weight = (exact + NEAR * near)[words.at[found]]
    quoted = np.zeros(len(found), bool)
    for text in np.unique(owner).tolist():
        a, b = np.searchsorted(owner, [text, text + 1])
        quoted[a:b] = _quoted(texts[text].lower(), place[a:b])
    counted = np.where(quoted, QUOTED, 1.0) * weight
    once = np.zeros(len(found), bool)
    once[np.unique(np.stack((owner, words.at[found], quoted)), axis=1, return_index=True)[1]] = True
    total = lambda of: np.bincount(owner[once], of[once], n)
    strongest = np.zeros(n)
    np.maximum.at(strongest, owner, counted)
    columns = (total(weight * ~quoted), total(weight * quoted), _best_window(owner, place, counted, n), 100 * total(counted) / (words.sizes + 20), strongest)
    return np.column_stack([np.ones(n), *map(np.log1p, columns)])


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of the logistic model by Newton's steps, drawn towards PRIOR. Evidence never lowers a score: coefficients that would are held at 0."""
    w, free = PRIOR.copy(), np.ones(len(PRIOR), bool)
    while True:
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = (x.T @ (y - p) - PULL * (w - PRIOR))[free]
            curve = (x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + PULL * np.eye(int(free.sum()))
            change = np.linalg.solve(curve, slope)
            w[free] += change * min(1.0, 2.0 / max(1e-9, float(np.abs(change).max())))
            if np.abs(change).max() < 1e-6:
                break
        below = free & (w < 0)
        below[0] = False
        if not below.any():
            return w
        least = int(np.argmin(np.where(below, w, 0)))
        free[least], w[least] = False, 0.0


@dataclass
class Model:
    weights: dict[str, float]
    known: frozenset[str]
    coefficients: np.ndarray


def learn(docs: DataFrame, labels: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of the documents with a label for whose id (t_id) `teaches` holds."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1) and l_id is not null")
    known = known.groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    own = docs.select(F.col(id_col).cast("long").alias("t_id"), F.col(text_col).cast("string").alias("text")).where(teaches & F.col("text").isNotNull())
    half = F.xxhash64("t_id").bitwiseAND(1)
    bits = spark.sparkContext.broadcast(_bitmap(known.select(F.xxhash64("l_id").alias("h"))))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for batch in batches:
            at = batch.column(0).to_numpy() & (8 * len(held) - 1)
            yield batch.filter(pa.array((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

    own = own.select(F.xxhash64("t_id").alias("h"), "t_id", "text").mapInArrow(likely, "h long, t_id long, text string")
    # One way of joining at every size: the sides are estimated before the bitmap thins them.
    labelled = materialize(own.hint("merge").join(known, own["t_id"] == known["l_id"]).select(F.xxhash64("t_id", "text").alias("key"), half.alias("half"), "toxic", "text"), "labelled", "zstd")
    entries, sizes = _entries(labelled)
    weights = lexicon(entries, sizes, [0, 1])
    first, second, known = known_words(labelled, weights, sizes)
    # Each half is scored by what the other one teaches.
    shared = spark.sparkContext.broadcast([(lexicon(entries, sizes, [1]), second), (lexicon(entries, sizes, [0]), first)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Automaton(*x) for x in shared.value]
        for whole in batches:
            for h in (0, 1):
                batch = whole.filter(pc.equal(whole.column(1), h))
                for start, end in _slices(batch.column(3)):
                    part = batch.slice(start, end - start)
                    rows = features(automata[h], part.column(3).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(rows), pa.list_(pa.float64()))], ["key", "toxic", "x"])

    rows = labelled.select("key", "half", "toxic", "text").mapInArrow(run, "key long, toxic int, x array<double>").orderBy("key", "toxic").limit(SAMPLE).collect()
    discard(labelled)
    if not rows:
        return Model(weights, known, PRIOR)
    return Model(weights, known, fit(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], np.float64)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        automaton = Automaton(held.weights, held.known)
        for batch in batches:
            for start, end in _slices(batch.column(1)):
                part = batch.slice(start, end - start)
                x = features(automaton, part.column(1).to_pylist()) @ held.coefficients
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(x, -700, 700))))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % FOLDS == 0


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(docs, labels, F.coalesce(~held_out("t_id"), F.lit(False)))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
