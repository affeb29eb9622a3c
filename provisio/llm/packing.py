"""Best-fit packing of token sequences, by bin completion with branch and bound.

Only the lengths decide how pieces fit, and there are at most ``capacity`` of them.  So the
search works on the counts of the lengths, which are at most ``capacity`` numbers for any
input, and its plan is a list of (filling, number of sequences) which the pieces look up by
their rank within their length.  Texts are never shuffled and nothing but the counts is
collected.

The search: one largest remaining length must lie in some sequence, so around it the undominated
fillings of the rest are enumerated, least waste first, and each is taken for as many sequences as
the counts allow, then for fewer.  A filling is dominated if another length still fits, or if one
or two of its parts could be exchanged for a larger remaining length.  A branch is pruned if its
waste, or the lower bound of what remains, can't lead to fewer sequences than the incumbent.  The
incumbents are best-fit decreasing solutions: of all lengths at first, then of what remains at
each node.  The search ends when an incumbent meets the lower bound, when all branches are done,
or after ``most_nodes`` nodes.  Without limits its result is the optimum.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provisio.llm import storage, tokenizer
from provisio.llm.words import slices, strings, trim

Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound of the number of sequences (Martello and Toth's L2)."""
    if not counts:
        return 0
    x = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in x.tolist()], np.int64)
    many, total = (np.concatenate(([0], np.cumsum(c))) for c in (n, n * x))
    half = int(np.searchsorted(x, capacity // 2, "right"))
    k = np.concatenate(([0], x[:half]))
    # longer than half, but with room for k; those of half or less that are at least k
    upto, low = np.searchsorted(x, capacity - k, "right"), np.searchsorted(x, k, "left")
    free = capacity * (many[upto] - many[half]) - (total[upto] - total[half])
    over = np.maximum(0, total[half] - total[low] - free)
    return int((many[-1] - many[half] - (-over // capacity)).max())


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing: the longest pieces first, each into the fullest sequence that still takes it; equal sequences at once."""
    held: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}  # by what is free: (filling, sequences)
    order: list[int] = []  # what is free somewhere, sorted

    def put(free: int, filling: tuple[tuple[int, int], ...], times: int) -> None:
        if not times:
            return
        if free not in held:
            held[free] = []
            insort(order, free)
        held[free].append((filling, times))

    for k in sorted((k for k, n in counts.items() if n), reverse=True):
        n = counts[k]
        while n:
            i = bisect_left(order, k)
            if i == len(order):
                free, filling, times = capacity, (), n
            else:
                free = order[i]
                filling, times = held[free].pop()
                if not held[free]:
                    del held[free]
                    order.pop(i)
            # a sequence that took one is the fullest that fits, until it is full
            each = free // k
            full = min(times, n // each)
            put(free - each * k, (*filling, (k, each)), full)
            n -= each * full
            if n and full < times:
                put(free - n * k, (*filling, (k, n)), 1)
                full, n = full + 1, 0
            if filling:
                put(free, filling, times - full)
    return [x for free in order for x in held[free]]


def fillings(left: dict[int, int], free: int, most: int | None = None) -> tuple[list[tuple[tuple[int, int], ...]], bool]:
    """Undominated fillings of ``free`` by the remaining lengths, least waste first, and whether these are all; up to ``most`` are looked at."""
    order = sorted(k for k, n in left.items() if n)
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    seen = 0

    def dominated(rest: int, taken: tuple[tuple[int, int], ...]) -> bool:
        used = dict(taken)

        def unused(least: int) -> int | None:
            """The smallest length of ``least`` or more of which one is left."""
            for i in range(bisect_left(order, least), len(order)):
                if left[order[i]] > used.get(order[i], 0):
                    return order[i]
            return None

        k = unused(0)
        if k is not None and k <= rest:
            return True
        # one part, or two, for a larger length that is left
        parts = [k for k, c in taken for _ in range(min(c, 2))]
        sums = [(k, k + 1) for k in used] + [(a + b, a + b) for i, a in enumerate(parts) for b in parts[i + 1 :]]
        return any((k := unused(least)) is not None and k - size <= rest for size, least in sums)

    # (next place in ``order``, what is free, lengths taken)
    stack: list[tuple[int, int, tuple[tuple[int, int], ...]]] = [(len(order) - 1, free, ())]
    while stack:
        at, rest, taken = stack.pop()
        at = min(at, bisect_right(order, rest) - 1)
        if at < 0:
            seen += 1
            if not dominated(rest, taken):
                found.append((rest, taken))
            if most is not None and seen >= most:
                break
            continue
        k = order[at]
        for c in range(0, min(rest // k, left[k]) + 1):  # the most is looked at first
            stack.append((at - 1, rest - c * k, (*taken, (k, c)) if c else taken))
    found.sort(key=lambda x: (x[0], tuple((-k, -c) for k, c in x[1])))
    return [x for _, x in found], not stack


class Packed(NamedTuple):
    """A plan, the lower bound of its sequences, and whether it is known to be the best."""

    plan: Plan
    least: int
    proven: bool


def complete(counts: dict[int, int], capacity: int, most_nodes: int | None = 500, looked_at: int | None = 256) -> Packed:
    """A plan with as few sequences as the search finds: {length: count} -> [(((length, how many), ...), sequences)].

    ``looked_at``: most fillings that are looked at in a node; None for both limits finds the optimum.
    """
    counts = {int(k): int(n) for k, n in counts.items() if n}
    if any(k < 1 or k > capacity for k in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    best, goal = best_fit(counts, capacity), least_bins(counts, capacity)
    size = lambda plan: sum(n for _, n in plan)
    most, nodes, whole, total = size(best), 0, True, sum(k * n for k, n in counts.items())
    known: dict[tuple, int] = {}

    def below(left: dict[int, int], plan: Plan, used: int, waste: int) -> Iterator[tuple[dict[int, int], Plan, int, int]]:
        """What remains after each filling around the largest length, taken as often as possible, then less often."""
        nonlocal whole
        top = max(left)
        rest = {**left, top: left[top] - 1}
        tried, every = fillings(rest, capacity - top, looked_at)
        whole &= every
        for filling in tried:
            own = dict(filling)
            own[top] = own.get(top, 0) + 1
            lost = capacity - sum(k * c for k, c in own.items())
            for times in range(min(left[k] // c for k, c in own.items()), 0, -1):
                after = {k: n - own.get(k, 0) * times for k, n in left.items() if n > own.get(k, 0) * times}
                yield after, [*plan, (tuple(sorted(own.items(), reverse=True)), times)], used + times, waste + lost * times

    # depth first: each entry is what remains to be tried of a node
    stack = [iter([(counts, [], 0, 0)])]
    while stack and most > goal:
        if most_nodes is not None and nodes >= most_nodes:
            whole = False
            break
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            continue
        left, plan, used, waste = child
        if not left:
            if used < most:
                best, most = plan, used
            continue
        if -(-(total + waste) // capacity) >= most:
            continue
        key = tuple(sorted(left.items()))
        if known.get(key, used + 1) <= used or used + least_bins(left, capacity) >= most:
            continue
        known[key] = used
        nodes += 1
        rest = best_fit(left, capacity)
        if used + size(rest) < most:
            best, most = [*plan, *rest], used + size(rest)
        stack.append(below(left, plan, used, waste))
    return Packed(best, goal, most == goal or (whole and not stack))


class Places:
    """Where the piece of a given length and rank lies: the plan as sorted arrays."""

    def __init__(self, plan: Plan, spread: int = 1 << 44):
        self.spread = spread
        rows, used, sequence = [], {}, 0
        for filling, times in plan:
            offset = 0
            for length, each in filling:
                rank = used.get(length, 0)
                rows.append((length * spread + rank, sequence, each, offset))
                used[length] = rank + each * times
                offset += length * each
            sequence += times
        rows.sort()
        self.key, self.sequence, self.each, self.offset = np.array(rows, np.int64).reshape(-1, 4).T

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence numbers and offsets."""
        if not len(length):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = length.astype(np.int64) * self.spread + rank
        i = np.searchsorted(self.key, key, "right") - 1
        nth, slot = np.divmod(key - self.key[i], self.each[i])
        return self.sequence[i] + nth, self.offset[i] + slot * length


PIECES = "id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Each document's ids and one ``end_id``, cut if longer than ``capacity``: then the first piece takes what full ones leave.

    ``part``: the task that cut the piece; ``rank``: earlier pieces of its length in that task.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, part_id, seen = tokenizer.encoder(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part, _ in slices(batch, "text"):
                doc, rows = part.column(0).to_pylist(), []
                for d, t in zip(doc, strings(part, "text"), strict=True):
                    held = ids.encode(t) + end
                    n, start, piece = len(held) // 4, 0, 0
                    stop = n % capacity or capacity
                    while start < n:
                        rows.append((d, piece, start, stop - start, zlib.crc32(held[4 * start : 4 * stop])))
                        start, stop, piece = stop, stop + capacity, piece + 1
                d, piece, start, length, crc = zip(*rows, strict=True)
                length = np.array(length, np.int64)
                order = np.argsort(length, kind="stable")
                first = np.flatnonzero(np.diff(length[order], prepend=-1))
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.repeat(first, np.diff(first, append=len(length)))
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(d), part_id, np.int32)), pa.array(rank)],
                    names=["id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )
        ids.forget()
        trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, most_nodes: int | None = 500, looked_at: int | None = 256) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and becomes a piece of one token; a null id stays null; repeated rows
    are packed as often as they come; an empty table gives an empty one.  Other columns,
    whatever their names, are not read.

    The cut pieces are written once.  A piece's rank within its length is its rank in the task
    that cut it plus the pieces of that length in earlier tasks, so no length, however common,
    is gathered in one task.
    """
    spark = docs.sparkSession
    cut = storage.written(pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id), "pieces")
    per_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    # one row for each length and task; a window holds those of one length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = storage.written(per_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))), "piece-counts")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = spark.sparkContext.broadcast(Places(complete(counts, capacity, most_nodes, looked_at).plan))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = places.value.find(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return (
        cut.join(per_part.drop("n"), ["length", "part"])
        .select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
        .mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
        .withColumnRenamed("id", id_col)
    )
