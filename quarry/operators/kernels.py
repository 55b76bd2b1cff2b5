"""Numpy kernels of the search operators: matrices from Arrow columns, a running top k, navigable neighbour graphs, and anchors of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

DIGITS = 6
#: Scores that are held at a time.
SCORES_AT_ONCE = 1 << 22


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length, without nulls, as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


class TopK:
    """The k best ids of each question so far, ties by id; scores are rounded to DIGITS. A question does not find its own id, unless `own` is set.

    Vectors are scored against slices of questions, and only scores that reach a question's k-th best so far are looked at.
    """

    def __init__(self, q_ids: np.ndarray, k: int, own: bool = False):
        self.q_ids, self.k, self.own = q_ids, k, own
        self.scores = np.full((len(q_ids), k), -np.inf)
        self.ids = np.full((len(q_ids), k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(ids) or not len(q):
            return
        step = max(1, SCORES_AT_ONCE // len(ids))
        for a in range(0, len(q), step):
            scores = np.round(q[a : a + step] @ x.T, DIGITS)
            if not self.own:
                scores[self.q_ids[a : a + step, None] == ids[None, :]] = -np.inf
            least = self.scores[a : a + step, -1:]
            if len(ids) > self.k:
                least = np.maximum(least, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k, None])
            rows, cols = np.nonzero((scores >= least) & (scores > -np.inf))
            self._offer(rows + a, ids[cols], scores[rows, cols])

    def _offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows of the same id count apart."""
        own = np.unique(rows)
        at = np.concatenate((rows, np.repeat(own, self.k)))
        ids, scores = np.concatenate((ids, self.ids[own].reshape(-1))), np.concatenate((scores, self.scores[own].reshape(-1)))
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        best = place < self.k
        self.scores[at[best], place[best]], self.ids[at[best], place[best]] = scores[best], ids[best]

    def offer_lists(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Ids found for the question in row `rows`, in any order."""
        good = np.isfinite(scores) & (self.own | (self.q_ids[rows] != ids))
        self._offer(rows[good], ids[good], np.round(scores[good], DIGITS))

    def batch(self) -> pa.RecordBatch:
        rows, cols = np.nonzero(self.scores > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.q_ids[rows]), pa.array(self.ids[rows, cols]), pa.array(self.scores[rows, cols])], ["q_id", "id", "score"])


class Graph:
    """A navigable neighbour graph over unit vectors.

    Each vector is linked to near ones of different directions: its nearest candidates in turn, without those that lie nearer to a neighbour already taken
    than to itself. Links are kept in both directions, up to `degree`. Searches start from `entries`, vectors spread over the set by farthest choice, and one
of each part of the graph that these would not reach.
    """

    def __init__(self, x: np.ndarray, neighbours: np.ndarray, entries: np.ndarray):
        self.x, self.neighbours, self.entries = x, neighbours, entries

    @classmethod
    def build(cls, x: np.ndarray, degree: int, pool: int) -> Graph:
        n = len(x)
        x = x.astype(np.float32)
        near, score = cls._nearest(x, min(pool, max(0, n - 1)))
        taken = np.full((n, degree), -1, np.int32)
        step = max(1, SCORES_AT_ONCE * 2 // max(1, pool * max(pool, x.shape[1])))
        for a in range(0, n, step):
            taken[a : a + step] = cls._spread(x, near[a : a + step], score[a : a + step], degree // 2)
        neighbours, entries = cls._both_ways(x, taken, degree), cls._far_apart(x, max(1, int(n**0.5)))
        part = cls._parts(neighbours)
        return cls(x, neighbours, np.concatenate((entries, np.setdiff1d(part, part[entries]))).astype(np.int32))

    @staticmethod
    def _parts(neighbours: np.ndarray) -> np.ndarray:
        """For each place the least one connected to it, whichever way links point."""
        rows, cols = np.nonzero(neighbours >= 0)
        a, b = rows, neighbours[rows, cols]
        least = np.arange(len(neighbours))
        while True:
            before = least.copy()
            np.minimum.at(least, a, least[b])
            np.minimum.at(least, b, least[a])
            least = least[least]
            if (least == before).all():
                return least

    @staticmethod
    def _nearest(x: np.ndarray, pool: int) -> tuple[np.ndarray, np.ndarray]:
        near, score = np.empty((len(x), pool), np.int32), np.empty((len(x), pool), np.float32)
        step = max(1, SCORES_AT_ONCE // max(1, len(x)))
        for a in range(0, len(x), step):
            scores = x[a : a + step] @ x.T
            scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -np.inf
            best = np.argpartition(-scores, min(pool, len(x) - 1) - 1, axis=1)[:, :pool] if pool else near[a : a + step]
            own = np.take_along_axis(scores, best, 1)
            order = np.argsort(-own, axis=1, kind="stable")
            near[a : a + step], score[a : a + step] = np.take_along_axis(best, order, 1), np.take_along_axis(own, order, 1)
        return near, score

    @staticmethod
    def _spread(x: np.ndarray, near: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those that no candidate taken before is nearer to; then the nearest left, up to `most`."""
        rows, pool = near.shape
        out = np.full((rows, 2 * most), -1, np.int32)
        held, count = np.zeros((rows, pool), bool), np.zeros(rows, np.int64)
        between = np.einsum("rpd,rqd->rpq", x[near], x[near], optimize=True) if pool else np.zeros((rows, 0, 0))
        for p in range(pool):
            clear = (count < most) & ~((between[:, p, :] > score[:, p, None]) & held).any(1)
            held[:, p] = clear
            count += clear
        for p in range(pool):
            more = (count < most) & ~held[:, p]
            held[:, p] |= more
            count += more
        r, c = np.nonzero(held)
        out[r, np.arange(len(r)) - np.searchsorted(r, r)] = near[r, c]
        return out

    @staticmethod
    def _both_ways(x: np.ndarray, taken: np.ndarray, degree: int) -> np.ndarray:
        rows, cols = np.nonzero(taken >= 0)
        a, b = rows, taken[rows, cols].astype(np.int64)
        pairs = np.unique(np.stack((np.concatenate((a, b)), np.concatenate((b, a)))), axis=1)
        own = np.zeros(len(pairs[0]), bool)
        own[np.searchsorted(pairs[0] * len(x) + pairs[1], a * len(x) + b)] = True
        score = np.einsum("ed,ed->e", x[pairs[0]], x[pairs[1]])
        # A vector's own choices first, then those of others that chose it, nearest first.
        order = np.lexsort((-score, ~own, pairs[0]))
        a, b = pairs[0][order], pairs[1][order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        out = np.full((len(x), degree), -1, np.int32)
        kept = place < degree
        out[a[kept], place[kept]] = b[kept]
        return out

    @staticmethod
    def _far_apart(x: np.ndarray, n: int) -> np.ndarray:
        if not len(x):
            return np.zeros(0, np.int32)
        chosen = [0]
        closest = x @ x[0]
        while len(chosen) < min(n, len(x)):
            chosen.append(int(np.argmin(closest)))
            closest = np.maximum(closest, x @ x[chosen[-1]])
        return np.array(chosen, np.int32)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each question the places and scores of the `ef` best met (-1 where fewer are), and how many vectors were scored.

        All questions of a slice go forward together: each takes its best place not yet left, scores that one's neighbours not yet met, and ends when the
        best place left is worse than all `ef` held.
        """
        found, scores, work = np.full((len(q), ef), -1, np.int64), np.full((len(q), ef), -np.inf, np.float32), np.zeros(len(q), np.int64)
        q = q.astype(np.float32)
        widest = max(1, len(self.entries), self.neighbours.shape[1]) * self.x.shape[1]
        step = max(1, min(SCORES_AT_ONCE * 4 // max(1, len(self.x)), SCORES_AT_ONCE * 2 // widest))
        for a in range(0, len(q), step):
            found[a : a + step], scores[a : a + step], work[a : a + step] = self._walk(q[a : a + step], ef)
        return found, scores, work

    def _walk(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(q)
        places = np.full((n, ef), -1, np.int64)
        scores, left = np.full((n, ef), -np.inf, np.float32), np.zeros((n, ef), bool)
        met = np.zeros((n, len(self.x) + 1), bool)
        met[:, -1] = True
        work, going = np.zeros(n, np.int64), np.arange(n)
        offered = np.broadcast_to(self.entries.astype(np.int64), (n, len(self.entries)))
        while len(going):
            fresh = ~met[going[:, None], offered]
            met[going[:, None], offered] = True
            work[going] += fresh.sum(1)
            new = np.where(fresh, np.einsum("qmd,qd->qm", self.x[offered], q[going]), -np.inf).astype(np.float32)
            all_scores = np.concatenate((scores[going], new), axis=1)
            best = np.argsort(-all_scores, axis=1, kind="stable")[:, :ef]
            pick = lambda held, more: np.take_along_axis(np.concatenate((held, more), axis=1), best, 1)  # noqa: B023, E731
            places[going] = pick(places[going], offered)
            left[going] = pick(left[going], np.zeros(offered.shape, bool))
            scores[going] = np.take_along_axis(all_scores, best, 1)
            open_ones = ~left[going] & np.isfinite(scores[going])
            going = going[open_ones.any(1)]
            at = open_ones[open_ones.any(1)].argmax(1)
            left[going, at] = True
            # -1 is the place past the last vector, which counts as met.
            offered = self.neighbours[places[going, at]].astype(np.int64)
        places[~np.isfinite(scores)] = -1
        return places, scores, work


#: Letters of an anchor: three 64-bit words.
GRAM = 24
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest value of each `width` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def anchors(letters: bytes, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the GRAM letters of least hash in each `run` letters, all of them where several are equal: the same wherever the run occurs."""
    data, width = np.frombuffer(letters, np.uint8), run - GRAM + 1
    if len(data) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    n = len(data) - GRAM + 1
    h = words[:n] * _ODD[0] + words[8 : 8 + n] * _ODD[1] + words[16 : 16 + n] * _ODD[2]
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    h ^= h >> np.uint64(29)
    least = _sliding(h, width, np.minimum)
    # A gram is least in some run if the greatest of the least hashes of the runs that hold it is its own.
    ends = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate((ends, least, ends)), width, np.maximum) == h)
    return at, h[at]


def surroundings(letters: bytes, at: np.ndarray, run: int, fill: int) -> np.ndarray:
    """A row of 2 * run - GRAM letters around each place, all that a run over it can hold; beyond the text `fill`."""
    reach = run - GRAM
    edge = np.full(reach, fill, np.uint8)
    data = np.concatenate((edge, np.frombuffer(letters, np.uint8), edge))
    return np.lib.stride_tricks.sliding_window_view(data, 2 * reach + GRAM)[at]


def runs_over(a: np.ndarray, b: np.ndarray, run: int) -> np.ndarray:
    """Whether rows of surroundings, anchor on anchor, have `run` equal letters in a row over it."""
    reach, differ = run - GRAM, a != b
    before, after = differ[:, :reach][:, ::-1], differ[:, reach:]
    left = np.where(before.any(1), before.argmax(1), reach)
    right = np.where(after.any(1), after.argmax(1), reach + GRAM)
    return (right >= GRAM) & (left + right >= run)
