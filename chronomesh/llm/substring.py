"""Removal of repeated substrings by distributed prefix doubling (operator 8).

A byte goes if some ``length``-byte string that covers it also starts earlier in
the corpus. Suffixes are sorted by prefix doubling, but only those that can
matter are; two steps before it drop or merge windows without deciding a repeat
of their own:

1. *Anchors.* Each window of ``length`` bytes names the position of its least
   hashed ``GRAM``-gram. Equal windows name equal grams at equal offsets, and
   consecutive windows mostly name the same position, so a document has about
   one anchor for ``(length - GRAM) / 2`` bytes. Anchors, not bytes, are shuffled.
   Windows whose gram occurs once are unique.
2. *Contexts.* Runs of windows with one gram and equal bytes throughout are one
   symbol: its first run stands for all, the others are repeats of it. A passage
   that was copied a million times so enters the sort once.
3. *Prefix doubling* ranks the windows of the runs that are left. The rank at
   ``GRAM`` bytes is their name. In each round Spark sorts pairs (rank at k bytes,
   name of the next k bytes), equal pairs get equal new ranks, and windows of a
   unique rank leave; the offset k doubles until it is past the threshold.
   Windows of equal last rank are equal strings; all but the first are repeats.

Equal windows share a gram, so they are dealt out by it and ranks need hold in a
partition only. A gram with many surroundings is noticed in the tasks that read
it; its runs are dealt out by their surroundings and its windows by all their names,
after each task has put aside what repeats within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.llm.common import arrow_map, frugal, materialize, partitions_for, texts

GRAM = 32
#: Bytes of a document looked at in one go.
STRIDE = 1 << 20
#: Surroundings of one gram among a task's FLUSH_ROWS anchors beyond which its windows are dealt out singly.
HOT_RUNS = 16
#: Anchors that a task holds before it sends them on.
FLUSH_ROWS = 120_000
LAST = (1 << 63) - 1
_RUN = np.dtype([("gram", "<i8"), ("context", "<i8"), ("doc", "<i8"), ("hash", "<i8"), ("start", "<i4"), ("n", "<i4")])


def anchors(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(gram, context, start, n) of the runs of windows that share an anchor, in order."""
    parts = []
    for at in range(0, max(0, len(text) - length + 1), STRIDE):
        part = text[at : at + STRIDE + length - 1]
        parts.append(_anchors(part, at, length))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchors(part: bytes, at: int, length: int) -> tuple[np.ndarray, ...]:
    h = (np.frombuffer(part, np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    base, step = 0xC2B2AE3D27D4EB4F, 1
    while step < GRAM:
        h = h[:-step] * np.uint64(base) + h[step:]
        base, step = base * base % (1 << 64), 2 * step
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    width, step = length - GRAM + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if width > step:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    n = np.diff(np.append(starts, len(place)))
    spot = place[starts]
    digest = xxhash.xxh3_64_intdigest
    context = np.fromiter(
        (digest(part[a:b], s) for a, b, s in zip(starts.tolist(), (starts + n + length - 1).tolist(), (spot - starts).tolist())),
        np.uint64, len(starts),
    )
    return h[spot].view(np.int64), context.view(np.int64), starts + at, n


def _rows(found: list[np.ndarray]) -> np.ndarray:
    """Sorted by gram, context, document and start."""
    rows = np.concatenate(found) if found else np.zeros(0, _RUN)
    return rows[np.lexsort((rows["start"], rows["hash"], rows["doc"], rows["context"], rows["gram"]))]


def _new(*keys: np.ndarray) -> np.ndarray:
    """For sorted rows: whether a row begins a new group of equal keys."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: the first of each (gram, context), and all that start later than it."""
    if not len(rows):
        return rows, rows
    first = _new(rows["gram"], rows["context"])
    leader = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    later = np.logical_or.reduce([rows[c] != rows[c][leader] for c in ("doc", "hash", "start")])
    return rows[first], rows[later]


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, hash, text: a document's place in the order is its id (none: LAST), then the hash of its text."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))


def _anchor_blobs(docs: DataFrame, length: int, shards: int) -> DataFrame:
    """(shard, kind, runs): kind 0 first of their context in the task, 1 repeats of those, 2 first ones of hot grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for doc, mark, text in zip(batch.column("doc").to_pylist(), batch.column("hash").to_pylist(), texts(batch)):
                gram, context, start, n = anchors(text or b"", length)
                rows = np.zeros(len(gram), _RUN)
                rows["gram"], rows["context"], rows["doc"], rows["hash"], rows["start"], rows["n"] = gram, context, doc, mark, start, n
                held.append(rows)
            if sum(map(len, held)) > FLUSH_ROWS:
                yield _sent(held, shards)
                held = []
        yield _sent(held, shards)

    return docs.mapInArrow(frugal(run), "shard int, kind int, runs binary")


def _sent(held: list[np.ndarray], shards: int) -> pa.RecordBatch:
    first, later = _firsts(_rows(held))
    gram = _new(first["gram"])
    group = np.cumsum(gram) - 1
    hot = np.bincount(group)[group] > HOT_RUNS if len(first) else gram
    # the shard of a hot gram learns of it by one row without windows
    mark = first[hot & gram].copy()
    mark["n"] = 0
    blobs = []
    for kind, rows in ((0, np.concatenate([first[~hot], mark])), (2, first[hot])):
        key = rows["gram"].view(np.uint64) ^ (rows["context"].view(np.uint64) if kind else np.uint64(0))
        shard = (key >> np.uint64(20)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        blobs += [(k, kind, rows[order[cuts[k] : cuts[k + 1]]].tobytes()) for k in range(shards) if cuts[k] < cuts[k + 1]]
    if len(later):
        blobs.append((TaskContext.get().partitionId() % shards, 1, later.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*blobs) if blobs else ([], [], []), (pa.int32(), pa.int32(), pa.binary()))], ["shard", "kind", "runs"])


def _settled(blobs: DataFrame, shards: int) -> DataFrame:
    """Runs that matter: repeats (gram null) and those to be ranked (gram, hot)."""

    def out(rows: np.ndarray, gram: np.ndarray | None, hot: np.ndarray | None) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(rows[c]) for c in ("doc", "hash", "start", "n")), pa.nulls(n, pa.int64()) if gram is None else pa.array(gram), pa.nulls(n, pa.bool_()) if hot is None else pa.array(hot)],
            ["doc", "hash", "start", "n", "gram", "hot"],
        )

    def shard_rows(held: list[np.ndarray], kind: int) -> Iterator[pa.RecordBatch]:
        rows = _rows(held)
        marked = np.unique(rows["gram"][rows["n"] == 0])
        first, later = _firsts(rows[rows["n"] > 0])
        yield out(later, None, None)
        if len(first):
            group = np.cumsum(_new(first["gram"])) - 1
            hot = np.full(len(first), True) if kind else np.isin(first["gram"], marked)
            left = hot | (np.bincount(group)[group] > 1)
            yield out(first[left], first["gram"][left].copy(), hot[left])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for shard, kind, blob in zip(batch.column("shard").to_pylist(), batch.column("kind").to_pylist(), batch.column("runs")):
                rows = np.frombuffer(blob.as_buffer(), _RUN)
                if kind == 1:
                    yield out(rows, None, None)
                    continue
                if (shard, kind) != now:
                    if held:
                        yield from shard_rows(held, now[1])
                    held, now = [], (shard, kind)
                held.append(rows.copy())  # a view would keep the whole batch
        if held:
            yield from shard_rows(held, now[1])

    dealt = blobs.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(frugal(run), "doc long, hash long, start int, n int, gram long, hot boolean")


def rounds(length: int) -> list[tuple[int, int]]:
    """(offset, bytes) by which the ranks grow from GRAM bytes to ``length``."""
    out, k = [], GRAM
    while k < length:
        out.append((k, min(k, length - k)))
        k += out[-1][1]
    return out


def _span(names: np.ndarray, at: np.ndarray, offset: int, size: int) -> np.ndarray:
    """Names of ``size`` bytes (or GRAM, reaching back) at an offset of windows, from those of GRAM bytes."""
    out = np.zeros(len(at), np.uint64)
    for k in sorted({*range(offset, offset + size - GRAM, GRAM), offset + size - GRAM}):
        out = (out ^ names[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def _windows(contexts: DataFrame, length: int, combine: bool) -> DataFrame:
    """A row per window of the runs: doc, hash, place, its first rank and the name of each round.

    With ``combine`` what repeats within a block of the task comes with a null
    rank, as a repeat, and one window stands for its equals.
    """
    steps = rounds(length)
    named = [f"name{k}" for k in range(len(steps))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part").to_pylist()
            n, start, doc, mark = (batch.column(c).to_numpy() for c in ("n", "start", "doc", "hash"))
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            names = _names(b"".join(parts))
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at, place = np.repeat(np.cumsum(sizes) - sizes, n) + inside, np.repeat(start, n) + inside
            doc, mark = np.repeat(doc, n), np.repeat(mark, n)
            for k in range(0, len(at), 1 << 16):
                cut = slice(k, k + (1 << 16))
                keys = [names[at[cut]], *(_span(names, at[cut], offset, size) for offset, size in steps)]
                rows = [doc[cut], mark[cut], place[cut].astype(np.int32), *(x.view(np.int64) for x in keys)]
                repeat = np.zeros(len(rows[0]), bool)
                if combine:
                    order = np.lexsort((*rows[2::-1], *rows[3:]))
                    rows = [x[order] for x in rows]
                    first = _new(*rows[3:])
                    leader = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
                    repeat = np.logical_or.reduce([x != x[leader] for x in rows[:3]])
                yield pa.RecordBatch.from_arrays([*map(pa.array, rows[:3]), pa.array(rows[3], mask=repeat), *map(pa.array, rows[4:])], ["doc", "hash", "place", "rank", *named])

    return contexts.mapInArrow(frugal(run), "doc long, hash long, place int, rank long, " + ", ".join(f"{c} long" for c in named))


def _names(data: bytes) -> np.ndarray:
    """Names of all GRAM-byte strings, by doubling: a name of 2k bytes is made of two of k."""
    h = (np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    base, step = 0xFF51AFD7ED558CCD, 1
    while step < GRAM:
        h = h[:-step] * np.uint64(base) + h[step:]
        base, step = base * base % (1 << 64), 2 * step
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def reranked(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """New ranks of rows sorted by (rank, name); rows of a unique one leave.

    A row is held back until the next one is known, so no group is gathered.
    """
    held, rank, open_ = None, 0, False  # open_: the held row has an equal before it
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
        new = _new(rows["rank"], rows[name])
        new[0] = False
        ranks = rank + np.cumsum(new)
        equal_before = ~new
        equal_before[0] = open_
        some = equal_before[:-1] | ~new[1:]
        yield _batch({c: x[:-1][some] for c, x in rows.items() if c not in ("rank", name)} | {"rank": ranks[:-1][some]})
        held, rank, open_ = {c: x[-1:] for c, x in rows.items()}, int(ranks[-1]), bool(equal_before[-1])
    if held is not None and open_:
        yield _batch({c: x for c, x in held.items() if c not in ("rank", name)} | {"rank": np.array([rank])})


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def _doubled(windows: DataFrame, length: int) -> DataFrame:
    """Repeated windows (doc, hash, start, n) by rounds of sorting rank pairs; equal windows lie in one partition."""

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader: tuple | None = None
        for batch in batches:
            rows = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            if not batch.num_rows:
                continue
            new = _new(rows["rank"])
            if leader is not None and leader[0] == rows["rank"][0]:
                new[0] = False
            at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            first = [np.where(at < 0, leader[k + 1] if leader else 0, rows[c][at]) for k, c in enumerate(("doc", "hash", "place"))]
            later = np.logical_or.reduce([rows[c] != x for c, x in zip(("doc", "hash", "place"), first)])
            leader = (rows["rank"][-1], *(x[-1] for x in first))
            yield _batch({c: rows[c][later] for c in ("doc", "hash", "place")})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark, place = (batch.column(c).to_numpy() for c in ("doc", "hash", "place"))
            if not len(doc):
                continue
            begin = np.flatnonzero(_new(doc, mark) | np.append(True, place[1:] > place[:-1] + 1))
            end = np.append(begin[1:], len(doc)) - 1
            yield _batch({"doc": doc[begin], "hash": mark[begin], "start": place[begin], "n": (place[end] - place[begin] + 1).astype(np.int32)})

    ranked = windows.where("rank is not null")
    for k in range(len(rounds(length))):
        name, rest = f"name{k}", [c for c in ranked.columns if c not in ("rank", f"name{k}")]
        schema = ", ".join(f"{c} {'int' if c == 'place' else 'long'}" for c in [*rest, "rank"])
        ranked = ranked.sortWithinPartitions("rank", name).mapInArrow(frugal(lambda batches, name=name: reranked(batches, name)), schema)
    if not rounds(length):
        ranked = ranked.select("doc", "hash", "place", "rank")
    found = ranked.sortWithinPartitions("rank", "doc", "hash", "place").mapInArrow(frugal(repeats), "doc long, hash long, place int")
    return found.sortWithinPartitions("doc", "hash", "place").mapInArrow(frugal(merged), "doc long, hash long, start int, n int")


def repeated_spans(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, spans): ``doc, hash, text``, and ``doc, hash, spans`` (start, n) of repeated windows.

    A span of n windows from start covers ``n + length - 1`` bytes. Spans of a
    document may overlap and come in no order. Documents without any are absent.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    numbered = _numbered(docs, key, text)
    shards = max(partitions_for(docs.sparkSession), docs.rdd.getNumPartitions())
    runs = materialize(_settled(_anchor_blobs(numbered, length, shards), shards), "runs")
    open_runs = runs.where("gram is not null")
    n, hot = open_runs.agg(F.count("*"), F.coalesce(F.bool_or("hot"), F.lit(False))).first()
    spans = runs.where("gram is null").select("doc", "hash", "start", "n")
    if n:
        per_doc = open_runs.groupBy("doc", "hash").agg(F.collect_list(F.struct("start", "n", "gram", "hot")).alias("open"))  # within one document

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, kinds = ["gram", "hot", "doc", "hash", "start", "n", "part"], (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            for batch in batches:
                out = []
                for doc, mark, t, todo in zip(batch.column("doc").to_pylist(), batch.column("hash").to_pylist(), texts(batch), batch.column("open").to_pylist()):
                    out += [(r["gram"], r["hot"], doc, mark, r["start"], r["n"], t[r["start"] : r["start"] + r["n"] + length - 1]) for r in todo]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 7, kinds)], names)

        contexts = numbered.join(per_doc, ["doc", "hash"]).mapInArrow(frugal(cut), "gram long, hot boolean, doc long, hash long, start int, n int, part binary")
        contexts = materialize(contexts, "contexts") if hot else contexts
        spans = spans.union(_doubled(_windows(contexts.where("not hot").repartition(shards, "gram"), length, False), length))
        if hot:  # a gram in very many surroundings: deal out its windows
            windows = materialize(_windows(contexts.where("hot"), length, True), "windows")
            spans = spans.union(windows.where("rank is null").select("doc", "hash", F.col("place").alias("start"), F.lit(1).alias("n")))
            spans = spans.union(_doubled(windows.where("rank is not null").repartition(shards, *windows.columns[3:]), length))
    return numbered, spans.groupBy("doc", "hash").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def _cover(spans: list[dict], length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of covered bytes."""
    start = np.array([s["start"] for s in spans], np.int64)
    end = start + np.array([s["n"] for s in spans], np.int64) + length - 1
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.minimum(np.maximum.accumulate(end[order]), size)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def remove_repeats(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, removed (array of begin and end), kept (binary, what is left).

    Texts count as UTF-8 bytes; null ones are empty and shorter ones keep all.
    Rows that repeat an id and its text are the same document and share its
    result; another text under the same id is a document of its own, and such
    documents are in the order of the hashes of their texts. Rows without an id
    come last. An empty table gives no row; other columns are not read.
    """
    kind = dict(docs.dtypes)[key]
    numbered, spans = repeated_spans(docs, length, key, text)
    joined = numbered.join(spans, ["doc", "hash"], "left")

    def run(batch: pa.RecordBatch) -> dict:
        size, removed, kept = [], [], []
        for t, found in zip(texts(batch), batch.column("spans").to_pylist()):
            t = t or b""
            begin, end = _cover(found, length, len(t)) if found else (np.zeros(0, int), np.zeros(0, int))
            b, e = begin.tolist(), end.tolist()
            size.append(len(t))
            removed.append([{"begin": i, "end": j} for i, j in zip(b, e)])
            kept.append(b"".join(t[i:j] for i, j in zip([0, *e], [*b, len(t)])))
        return {"doc": batch.column("doc"), "n_bytes": size, "removed": removed, "kept": kept}

    out = arrow_map(joined, run, "doc long, n_bytes long, removed array<struct<begin: long, end: long>>, kept binary")
    return out.select(F.when(F.col("doc") < LAST, F.col("doc")).cast(kind).alias(key), "n_bytes", "removed", "kept")


def digest(docs: DataFrame, length: int = 100, key: str = "doc_id") -> DataFrame:
    """Per document: key, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs, length, key).select(
        key,
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["begin"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
