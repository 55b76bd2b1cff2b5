"""Chat formatting with minimum-cost role repair.

A legal conversation has at most one system turn, first, and then user and assistant turns in alternation, the user first.
Dynamic programming over the automaton of the last role chooses, turn by turn, to keep it, to merge it into the turn before, to relabel it,
or to insert empty turns ahead of it, at the least total cost. The repaired turns are rendered as one marked-up sequence.

Scale. Turns are range-partitioned by (conversation, turn, hash of the text), so one conversation may span many partitions. A partition sees
its first and last conversations only in part: for those it gives a 4 by 4 matrix of least costs from state to state, whose min-plus
products along the partitions fix the state at each border. There are two such matrices at most for each partition, which is all that the driver gets.
Turns stream through both passes: a turn is rendered as soon as the cheapest ways to all states agree on what became of it, so what is held
are the turns since then, a few, and not a conversation or a partition.

Defined results: rows of one conversation are ordered by turn (null first), role, then hash of the text; a null text renders as an empty one;
roles other than the known ones and their aliases, null included, must be relabelled; rows with a null conversation are one conversation; equal
costs prefer keep, merge, insert, relabel in this order; repeated rows are turns of their own; an empty table gives an empty result; further columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarry.session import materialize

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
START = 0
#: States: 0 at the start, then 1 + the index of the last role. Which roles may follow each state.
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
MERGE, INSERT, RELABEL = 1, 2, 3
STATES = range(4)
INF = float("inf")
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"


def role_state(role: str | None) -> int:
    """1 + the role's index, or 0 for a role that must be relabelled."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return 1 + ROLES.index(name) if name in ROLES else 0


@cache
def steps(role: int) -> dict[tuple[int, int], tuple[int, bool, tuple[int, ...]]]:
    """For a turn of this role: (state before, state after) -> (cost, merged, roles inserted ahead), at the least cost."""
    best: dict[tuple[int, int], tuple] = {}
    for before, inserted, after, merged in product(STATES, [(), *((a,) for a in (1, 2, 3)), *product((1, 2, 3), repeat=2)], (1, 2, 3), (False, True)):
        state, legal = before, True
        for x in inserted:
            legal &= x in LEGAL[state]
            state = x
        legal &= state == after if merged else after in LEGAL[state]
        if not legal or (merged and inserted):
            continue
        cost = MERGE * merged + INSERT * len(inserted) + RELABEL * (after != role)
        found = (cost, after != role, len(inserted), merged, inserted)
        if (before, after) not in best or found < best[before, after]:
            best[before, after] = found
    return {k: (c, merged, inserted) for k, (c, _, _, merged, inserted) in best.items()}


def identity() -> list[list[float]]:
    return [[0.0 if a == b else INF for b in STATES] for a in STATES]


def product_with(m: list[list[float]], role: int) -> list[list[float]]:
    """m, least costs from state to state, with a turn of this role behind."""
    table = steps(role)
    return [[min((row[k] + table[k, b][0] for k in STATES if (k, b) in table), default=INF) for b in STATES] for row in m]


@cache
def _advance(costs: tuple[float, ...], role: int) -> tuple[tuple[float, ...], tuple[int, ...]]:
    """Least costs, less the least of them, of each state after a turn of this role, and the states that they come from. Few costs occur."""
    table = steps(role)
    options = [min(((costs[m] + table[m, b][0], m) for m in STATES if (m, b) in table), default=(INF, 0)) for b in STATES]
    least = min(c for c, _ in options)
    return tuple(c - least for c, _ in options), tuple(m for _, m in options)


class Viterbi:
    """The cheapest way through one run of turns that come one by one; add() and end() return the turns (item, state, merged, inserted, cost) that are settled."""

    LOOK = 64

    def __init__(self, enter: int):
        self.costs = tuple(0.0 if s == enter else INF for s in STATES)
        self.items: list = []
        self.roles: list[int] = []
        self.back: list[tuple[int, ...]] = []
        self.look = self.LOOK

    def _trace(self, last: int, state: int) -> list[tuple]:
        """What became of the first `last` turns held, of which the last ends in this state; they are held no more."""
        out = []
        for i in range(last - 1, -1, -1):
            before = self.back[i][state]
            cost, merged, inserted = steps(self.roles[i])[before, state]
            out.append((self.items[i], state, merged, inserted, cost))
            state = before
        del self.items[:last], self.roles[:last], self.back[:last]
        return out[::-1]

    def add(self, item, role: int) -> list[tuple]:
        self.costs, back = _advance(self.costs, role)
        self.items.append(item)
        self.roles.append(role)
        self.back.append(back)
        if len(self.items) < self.look:
            return []
        states = {s for s in STATES if self.costs[s] < INF}
        for i in range(len(self.back) - 1, -1, -1):
            states = {self.back[i][s] for s in states}
            if len(states) == 1 and i:
                settled = self._trace(i, states.pop())
                self.look = len(self.items) + self.LOOK
                return settled
        self.look *= 2
        return []

    def end(self, leave: int | None) -> list[tuple]:
        """The rest, ending in `leave` (None: any state) at the least cost."""
        state = leave if leave is not None else min(STATES, key=lambda s: (self.costs[s], s))
        return self._trace(len(self.items), state)


def _borders(found: list) -> dict[int, dict[str, tuple[int, int | None, bool, bool]]]:
    """For each partition, of its first and last conversation: (state before, state after, begun earlier, goes on)."""
    out: dict[int, dict[str, tuple]] = {}
    runs: list[list] = []
    for row in sorted(found, key=lambda r: (r["part"], r["which"] == "last")):
        if runs and runs[-1][-1]["conv"] == row["conv"] and runs[-1][-1]["part"] < row["part"]:
            runs[-1].append(row)
        else:
            runs.append([row])
    for run in runs:
        costs, back = [0.0 if s == START else INF for s in STATES], []
        for row in run:
            m = [row["m"][4 * a : 4 * a + 4] for a in STATES]
            options = [min((costs[a] + m[a][b], a) for a in STATES) for b in STATES]
            back.append([a for _, a in options])
            costs = [c for c, _ in options]
        state = min(STATES, key=lambda s: (costs[s], s))
        for i in range(len(run) - 1, -1, -1):
            before = back[i][state]
            places = ["first", "last"] if run[i]["which"] == "both" else [run[i]["which"]]
            for w in places:
                out.setdefault(run[i]["part"], {})[w] = (before, state, i > 0, i < len(run) - 1)
            state = before
    return out


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, bool]]:
    """Each row, with whether it begins and ends a run: rows of one part and one conversation. Rows start with part, place, conversation, role."""
    held, begins = None, True
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is not None:
                ends = (held[0], held[2]) != (row[0], row[2])
                yield held, begins, ends
                begins = ends
            held = row
    if held is not None:
        yield held, begins, True


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per turn: conv_id, turn, role_in, role_out, merged, inserted (roles of empty turns ahead), cost, part, place, piece.

    The pieces of a conversation, in order of (part, place), make its rendered sequence. A merged turn's piece goes on where the turn before ended.
    """
    spark = turns.sparkSession
    chosen = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role_in"),
        F.col(text_col).alias("text"),
    ).withColumn("h", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "turn", "role_in", "h"]
    placed = chosen.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    held = materialize(placed.withColumn("place", F.monotonically_increasing_id()), "turns")
    # A part's rows are one file's; they are brought together again by part, in their order.
    rows = held.repartition(parts, "part").sortWithinPartitions("part", "place")

    schema = T.StructType(
        [
            T.StructField("conv_id", turns.schema[conv_col].dataType),
            *(T.StructField(n, t) for n, t in (("turn", T.LongType()), ("role_in", T.StringType()), ("role_out", T.StringType()), ("merged", T.BooleanType()))),
            *(T.StructField(n, t) for n, t in (("inserted", T.StringType()), ("cost", T.LongType()), ("part", T.IntegerType()), ("place", T.LongType()), ("piece", T.StringType()))),
        ]
    )
    names_out, types = schema.names, [to_arrow_type(f.dataType) for f in schema]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        part, m = None, []
        for row, begins, ends in _turns(batches):
            m = product_with(identity() if begins else m, role_state(row[3]))
            if ends:
                of = {"part": row[0], "which": "last", "conv": str(row[2]), "m": [x for r in m for x in r]}
                if row[0] != part:
                    part = row[0]
                    out.append(of | {"which": "both"})
                elif out[-1]["which"] == "both":
                    out[-1]["which"] = "first"
                    out.append(of)
                else:
                    out[-1] = of
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("which", pa.string()), ("conv", pa.string()), ("m", pa.list_(pa.float64()))]))

    found = rows.select("part", "place", "conv_id", "role_in").mapInArrow(matrices, "part int, which string, conv string, m array<double>").collect()
    borders = _borders(found)
    lasts = {r["part"]: r["conv"] for r in found if r["which"] == "last"}

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        part, whole, run = None, (START, None, False, False), None
        for row, begins, ends in _turns(batches):
            if begins:
                at = borders.get(row[0], {})
                # The last run of a part is told from the others by its conversation alone.
                first, part = row[0] != part, row[0]
                enter, leave, begun, goes_on = at["first"] if first else at["last"] if lasts.get(row[0]) == str(row[2]) else whole
                run, n = Viterbi(enter), 0
            settled = run.add(row, role_state(row[3]))
            if ends:
                settled += run.end(leave)
            for i, ((_, place, conv, role, turn, text), state, merged, inserted, cost) in enumerate(settled):
                if merged:
                    piece = "\n"
                else:
                    piece = CLOSE if begun or n else ""
                    piece += "".join(OPEN.format(ROLES[x - 1]) + CLOSE for x in inserted) + OPEN.format(ROLES[state - 1])
                n += 1
                piece += (text or "") + (CLOSE if ends and i == len(settled) - 1 and not goes_on else "")
                out.append((conv, turn, role, ROLES[state - 1], merged, ",".join(ROLES[x - 1] for x in inserted), cost, row[0], place, piece))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names_out)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names_out)

    return rows.select("part", "place", "conv_id", "role_in", "turn", "text").mapInArrow(render, schema)
