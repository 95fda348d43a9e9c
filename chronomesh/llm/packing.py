"""Best-fit decreasing packing of token pieces into sequences (operator 9).

Pieces of one length are interchangeable, so best-fit decreasing over all
pieces of the corpus needs only the histogram of lengths: at most ``capacity``
numbers. A segment tree over remaining capacities finds the tightest open bin;
bins with the same remaining room form runs of consecutive numbers, and a run
takes many equal pieces at a time. The plan has a bounded number of rows; each
piece finds its place from its rank among the pieces of its length, which comes
from ranks within chunks plus prefix sums over chunks.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.llm.common import arrow_map, materialize, texts
from chronomesh.llm.tokens import encoder_for

CAPACITY = 2048


class OpenBins:
    """Runs of open bins by remaining room, under a segment tree."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)
        self.runs: dict[int, deque[tuple[int, int]]] = {}

    def _mark(self, room: int, value: bool) -> None:
        i = room + self.size
        self.tree[i] = value
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def add(self, room: int, first: int, n: int) -> None:
        """``n`` bins numbered from ``first`` have ``room`` left."""
        if room > 0 and n > 0:
            runs = self.runs.setdefault(room, deque())
            if not runs:
                self._mark(room, True)
            runs.append((first, n))

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open bin has."""
        i = need + self.size
        if self.tree[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Remove up to ``most`` bins of this room: the first number and how many."""
        first, n = self.runs[room].popleft()
        if n > most:
            self.runs[room].appendleft((first + most, n - most))
            n = most
        if not self.runs[room]:
            self._mark(room, False)
        return first, n


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing on a histogram of lengths.

    Rows ``(length, rank, n, bin, per_bin, offset)``: the pieces of that length
    with ranks ``rank .. rank + n - 1`` go to bins from ``bin`` on, ``per_bin``
    to each, the first at ``offset``.
    """
    bins, plan, opened = OpenBins(capacity), [], 0
    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = bins.tightest(length)
            if room is None:
                room, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            else:
                first, n = bins.take(room, -(-left // (room // length)))
            per = room // length
            full = min(n, left // per)
            if full:
                plan.append((length, rank, full * per, first, per, capacity - room))
                bins.add(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if n > full:  # the last bin takes what is left, fewer than per
                if left:
                    plan.append((length, rank, left, first + full, left, capacity - room))
                bins.add(room - left * length, first + full, 1)
                rank, left = rank + left, 0
                bins.add(room, first + full + 1, n - full - 1)
    return plan


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each text, end it with id 0 and cut it into pieces of ``capacity``.

    Columns: ``keys``, piece, start, length, ids_crc32, (ids,) chunk, local. Chunk
    and local are a task's number and the rank among its pieces of that length.
    """
    types = dict(docs.dtypes)

    class Cut:
        def __init__(self):
            self.seen: dict[int, int] = {}

        def __call__(self, batch: pa.RecordBatch) -> dict:
            encoder, rows, seen = encoder_for(tokenizer), [], self.seen
            chunk = TaskContext.get().partitionId()
            for at, t in enumerate(texts(batch, text)):
                ids = np.concatenate([encoder.ids(t and t.decode()), np.zeros(1, np.uint32)]).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    n = len(part)
                    rows.append((at, k, start, n, zlib.crc32(part.tobytes()), part if with_ids else None, chunk, seen.get(n, 0)))
                    seen[n] = seen.get(n, 0) + 1
            at, k, start, n, crc, ids, chunks, local = zip(*rows)
            out = {c: batch.column(c).take(pa.array(at)) for c in keys}
            return out | {"piece": k, "start": start, "length": n, "ids_crc32": crc, "chunk": chunks, "local": local} | ({"ids": list(ids)} if with_ids else {})

    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", chunk int, local long"
    return arrow_map(docs.select(*keys, text), Cut(), schema)


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    One row per piece: ``keys``, piece, start, length, ids_crc32, sequence_id,
    offset, and ``ids`` if asked for (a sequence is its pieces' ids by offset).
    A null or empty text is one piece of the end id alone; repeated rows are
    packed each; an empty table gives no row; other columns are left out; any
    length of text is cut, never shortened.
    """
    cut = materialize(pieces(docs, tokenizer, capacity, keys, text, with_ids), "pieces")
    per_chunk = cut.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = per_chunk.select("length", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = best_fit_plan(counts, capacity)
    table = _by_length(plan)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    ranked = cut.join(base, ["length", "chunk"])
    names = [*keys, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    types = dict(cut.dtypes)

    def place(batch: pa.RecordBatch) -> dict:
        length = batch.column("length").to_numpy()
        rank = batch.column("local").to_numpy() + batch.column("base").to_numpy()
        seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            rows = shared.value[int(n)]
            row = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
            j = rank[own] - row[:, 0]
            seq[own], offset[own] = row[:, 2] + j // row[:, 3], row[:, 4] + j % row[:, 3] * n
        return {c: batch.column(c) for c in names} | {"sequence_id": seq, "offset": offset}

    return arrow_map(ranked, place, ", ".join(f"`{c}` {types[c]}" for c in names) + ", sequence_id long, offset long")


def _by_length(plan: list[tuple[int, int, int, int, int, int]]) -> dict[int, np.ndarray]:
    rows: dict[int, list] = {}
    for length, *rest in plan:
        rows.setdefault(length, []).append(rest)
    return {n: np.array(x) for n, x in rows.items()}
