"""Best-fit packing by a configuration linear program over the length histogram.

Documents become ids and an end id; only documents longer than a sequence
are cut, into full pieces with a shorter first one.  The number of pieces of
each length (at most CAPACITY numbers) is all that the driver sees.

The program covers the histogram by configurations (multisets of lengths that
fit one sequence) at the least sum of amounts.  It is solved by multiplicative
weights: a length's weight falls exponentially with the part of its demand
that is covered; a knapsack dynamic program over any number of copies prices
all configurations under these weights and yields, for each length, the best
one that holds it; those close to the best are taken together, each at an
amount that raises no length's covered part by more than a step.  The weights
over the best price are a dual solution, so each step bounds the sequences
from below; smaller steps follow until the plan is within GAP of the bound.
The fractional plan is then rounded: whole parts of amounts first, one more of
each configuration while its pieces last, those without waste before others.
Best fit places what is left, after some or all of the rounding, whichever is
shortest (ties: after most of it); while the plan is more than one sequence
above the bound, the program is solved anew for what is left.  ``program``
returns the fractional value, the bound and the number of rounded sequences
beside the plan.

The plan lists, per length, ranges of piece ranks and the sequences they go
to.  A piece's rank among its length is its rank within its part (counted
while encoding) plus the pieces of that length in earlier parts, so no group
is gathered anywhere.

Defined results: a null or empty text is one piece that holds the end id; very
long texts are encoded whole, slice by slice; repeated rows and rows with a
null id are packed one by one; ties between configurations go to the longer
first piece; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import fresh_path
from .common import map_arrow
from .tokenfile import FORMAT, MODEL, crc_of_lists, list_array, with_end
from .tokens import Ranges, column_bytes, library_encoder, library_ranges

CAPACITY = 1024
END_ID = 2
#: Part of a demand that one step may cover: the first, and smaller ones while the gap is larger than GAP.
STEPS, GAP = (0.1, 0.03), 0.005
#: Fall of a weight's logarithm from nothing covered to all; configurations taken besides the best: within this part of its price.
SLOPE, CLOSE = 3.0, 0.002
DUAL_SLOPE = 1.0
#: Bounds of the iterations for the plan and for the bound.
ROUNDS, DUAL_ROUNDS = 2500, 150

Plan = list[tuple[int, dict[int, int]]]


@dataclass
class Program:
    """A plan [(number of sequences, {length: copies})] with the fractional program's value and lower
    bound, and how many sequences were rounded from it (the others were placed by best fit)."""

    plan: Plan
    value: float
    bound: int
    rounded: int

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.plan)


def _priced(profit: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack over any number of copies: the best sum for every room, and a length to take there (0: none pays)."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    gain = profit[1:]
    for room in range(1, capacity + 1):
        taken = best[room - 1 :: -1] + gain[:room]
        k = int(taken.argmax())
        best[room] = best[room - 1]
        if taken[k] > best[room]:
            best[room], choice[room] = taken[k], k + 1
    return best, choice


def _holding(lengths: np.ndarray, choice: np.ndarray, capacity: int) -> np.ndarray:
    """For each of ``lengths`` the best configuration that holds it: rows of lengths, falling, with zeros."""
    down = np.maximum.accumulate(np.where(choice > 0, np.arange(capacity + 1), 0))  # the next smaller room in which a length is taken
    parts, room = [lengths], down[capacity - lengths]
    while room.any():
        parts.append(choice[room])
        room = down[room - choice[room]]
    return np.unique(-np.sort(-np.stack(parts, axis=1), axis=1), axis=0)


def _steps(demand: np.ndarray, value: np.ndarray, left: np.ndarray, alive: np.ndarray, capacity: int, step: float):
    """One step under the values of lengths: its price, configurations (rows) and amounts."""
    best, choice = _priced(value, capacity)
    rows = _holding(alive, choice, capacity)
    worth = np.where(rows > 0, value[rows], 0.0).sum(axis=1)
    rows = rows[worth >= min(1 - CLOSE, worth.max() / best[capacity]) * best[capacity]]
    use = np.bincount(rows.ravel(), minlength=capacity + 1)
    use[0] = 0
    may = np.where(use > 0, np.minimum(step * demand, left) / np.maximum(use, 1), np.inf)
    return best[capacity], rows, may[rows].min(axis=1)


def _values(lengths: np.ndarray, part: np.ndarray, of: np.ndarray, capacity: int, slope: float = SLOPE) -> np.ndarray:
    """Values of all lengths under multiplicative weights: ``of`` those at the start, falling with the covered part."""
    value = np.full(capacity + 1, -np.inf)
    value[lengths] = of[lengths] * np.exp(-slope * (part - part.min()))
    return value


def dual(demand: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The best values of lengths found (a dual solution, but for its scale), and the bound that they prove."""
    some = np.flatnonzero(demand)
    start = np.arange(capacity + 1, dtype=float)
    cover, most, found = np.zeros(capacity + 1), 0.0, start
    for _ in range(DUAL_ROUNDS):
        value = _values(some, cover[some] / demand[some], start, capacity, DUAL_SLOPE)
        price, rows, amount = _steps(demand, value, demand, some, capacity, STEPS[0])
        if (proved := float((value[some] * demand[some]).sum()) / price) > most:
            most, found = proved, np.where(demand > 0, value, 0.0)
        np.add.at(cover, rows.ravel(), np.repeat(amount, rows.shape[1]))
        cover[0] = 0
    return found, most


def fractional(counts: dict[int, int], capacity: int = CAPACITY, step: float = STEPS[0], start: np.ndarray | None = None) -> dict[tuple[int, ...], float]:
    """Amounts of configurations (tuples of lengths) that cover ``counts`` exactly; ``start``: values of the lengths to begin with."""
    demand = np.zeros(capacity + 1)
    for length, n in counts.items():
        demand[length] = n
    some = np.flatnonzero(demand)
    start = np.arange(capacity + 1, dtype=float) if start is None else start
    left, plan = demand.copy(), {}
    for _ in range(ROUNDS):
        alive = some[left[some] > 0]
        if not len(alive):
            break
        value = _values(alive, 1 - left[alive] / demand[alive], start, capacity)
        _, rows, amount = _steps(demand, value, left, alive, capacity, step)
        np.subtract.at(left, rows.ravel(), np.repeat(amount, rows.shape[1]))
        left[0] = 0
        left[left < 1e-9 * demand] = 0
        for row, x in zip(rows.tolist(), amount.tolist()):
            key = tuple(v for v in row if v)
            plan[key] = plan.get(key, 0.0) + x
    for length in some[left[some] > 0].tolist():  # rounds ran out
        key = (length,) * (capacity // length)
        plan[key] = plan.get(key, 0.0) + left[length] / len(key)
    return plan


def _rounded(plan: dict[tuple[int, ...], float], left: dict[int, int], full: float) -> Plan:
    """Whole numbers of the configurations of ``plan`` that fill at least ``full``; takes their pieces from ``left``."""
    out = []
    ranked = sorted((k for k in plan if sum(k) >= full), key=lambda k: (-plan[k], k))
    for more in (0, 1):  # whole parts, then one more where pieces are left
        for key in ranked:
            copies = Counter(key)
            times = min(more or int(plan[key]), *(left.get(x, 0) // n for x, n in copies.items()))
            if times > 0:
                for x, n in copies.items():
                    left[x] -= times * n
                out.append((times, dict(copies)))
    return out


def _without(left: dict[int, int], plan: Plan) -> dict[int, int]:
    """What ``plan`` leaves of the histogram ``left``."""
    out = dict(left)
    for times, content in plan:
        for x, n in content.items():
            out[x] -= times * n
    return {x: n for x, n in out.items() if n}


def program(counts: dict[int, int], capacity: int = CAPACITY) -> Program:
    """The plan that covers the histogram ``counts`` exactly."""
    whole = [(counts[capacity], {capacity: 1})] if counts.get(capacity) else []
    start = {x: n for x, n in sorted(counts.items()) if n and x < capacity}
    size = lambda plan: sum(n for n, _ in plan)
    if not start:
        return Program(whole, size(whole), size(whole), size(whole))
    demand = np.zeros(capacity + 1)
    demand[list(start)] = list(start.values())
    values, bound = dual(demand, capacity)
    for step in STEPS:
        plan = fractional(start, capacity, step, values)
        if (value := sum(plan.values())) <= (1 + GAP) * bound:
            break
    least = int(np.ceil(bound * (1 - 1e-9)))
    done: Plan = []
    left = dict(start)
    best: tuple[Plan, Plan] = ([], [(n, {x: 1}) for x, n in start.items()])
    for full in (1.0, 1.0, 0.99):  # first configurations that waste nothing
        taken = _rounded(plan, dict(left), full * capacity)
        for part in (8, 6, 4, 2, 1, 0):  # eighths of the rounding
            head = done + taken[: -(-len(taken) * part // 8)]
            tail = _best_fit(_without(start, head), capacity)
            if size(head) + size(tail) < size(best[0]) + size(best[1]):
                best = head, tail
        done += taken
        left = _without(start, done)
        if not left or size(best[0]) + size(best[1]) <= least + 1:
            break
        if taken:
            plan = fractional(left, capacity, STEPS[0] * 5, values)
    return Program(whole + best[0] + best[1], size(whole) + value, size(whole) + least, size(whole) + size(best[0]))


def configurations(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """(number of sequences, {length: copies}) that cover the histogram ``counts`` exactly."""
    return program(counts, capacity).plan


def _best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over a histogram: sequences with the same gap and content stay one entry."""
    open_: dict[int, list[list]] = {}  # room -> entries [number, content]
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                fit = capacity // length
                entry, times = {length: 0}, max(1, n // fit)
                each = min(fit, n)
                entry[length] = each
                used = times * each
                left = capacity - each * length
            else:
                stack = open_[room]
                number, content = stack.pop()
                if not stack:
                    del open_[room]
                each = min(room // length, n)
                times = min(number, n // each)
                if times < number:
                    open_.setdefault(room, []).append([number - times, content])
                entry = dict(content)
                entry[length] = entry.get(length, 0) + each
                used = times * each
                left = room - each * length
            n -= used
            open_.setdefault(left, []).append([times, entry])
    return [(number, content) for stack in open_.values() for number, content in stack]


def slots(plan: Plan) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, copies in a sequence, offset of the first copy)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, content in plan:
        offset = 0
        for length, copies in sorted(content.items(), reverse=True):
            begin = ranks.get(length, 0)
            out.setdefault(length, []).append((begin, sequence, copies, offset))
            ranks[length] = begin + times * copies
            offset += length * copies
        sequence += times
    return {x: np.array(rows, np.int64) for x, rows in out.items()}


def _pieces(model: str, end: int, capacity: int, ranges: Ranges):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), library_encoder(model, ranges)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            done = 0
            for n, ids, sizes in encoder.texts(column_bytes(batch.column(1))):
                ids, sizes = with_end(ids, sizes, end)
                number = -(-sizes // capacity)
                doc = np.repeat(np.arange(n), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                first = sizes - (number - 1) * capacity
                length = np.where(piece == 0, first[doc], capacity)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                order = np.argsort(length, kind="stable")
                sorted_ = length[order]
                within = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
                rank = np.empty(len(order), np.int64)
                rank[order] = within + seen[sorted_]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, n).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), list_array(ids, length), pa.array([part] * len(doc), pa.int32()), pa.array(rank, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids", "part", "rank"],
                )
                done += n

    return run


def pieces(docs: DataFrame, model: str = MODEL, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of ``docs`` with their ids, staged: doc_id, piece, start, length, ids, part, rank."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, piece int, start long, length long, ids array<int>, part int, rank long"
    path = fresh_path(spark, "pieces")
    map_arrow(docs.select("doc_id", "text"), _pieces(model, end_id, capacity, library_ranges(model)), shape).write.options(**FORMAT).parquet(path)
    return spark.read.parquet(path)


def _placed(table: dict[int, np.ndarray], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy() + b.column("before").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length).tolist():
                rows, at = table[x], np.flatnonzero(length == x)
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + nth // row[:, 2]
                offset[at] = row[:, 3] + nth % row[:, 2] * x
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def place(rows: DataFrame, histogram: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (pieces, with or without ids) with sequence_id and offset; ``histogram``: the
    pieces' (part, length)."""
    per_part = histogram.groupBy("part", "length").count()
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.select("part", "length", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("before"))
    total = {r[0]: r[1] for r in histogram.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = slots(configurations(total, capacity))
    names = [c for c in rows.columns if c not in ("part", "rank")]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    joined = rows.join(before, ["part", "length"])
    return map_arrow(joined, _placed(table, names), f"{shape}, sequence_id long, offset long")


def pack(docs: DataFrame) -> DataFrame:
    """Every piece with its ids, sequence_id and offset."""
    rows = pieces(docs)
    return place(rows, rows.select("part", "length"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = [c for c in b.schema.names if c != "ids"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(crc_of_lists(b.column("ids")), pa.int64())], names=[*names, "ids_crc32"])


def op5(docs: DataFrame) -> DataFrame:
    rows = pieces(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    light = map_arrow(rows, _digests, f"doc_id {kind}, piece int, start long, length long, part int, rank long, ids_crc32 long")
    placed = place(light, rows.select("part", "length"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
