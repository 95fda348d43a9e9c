"""Language-model scores from a log-frequency Bloom filter (operator 4).

Words and pairs of words of the training documents are counted exactly. A pair
with count c is put into a Bloom filter once for each level up to its quantised
count ``1 + floor(log_BASE(c))``. A lookup probes level after level until one is
missing, which gives the count's magnitude. The probability of a word
interpolates the pair's relative frequency with the word's own, which comes from
the exact counts; over all words of a history these sum to 1, but for the
quantisation of the pairs.

Counting is distributed: tasks count what they read, send sorted runs to shards
by ranges of hashes, and each shard merges its runs and fills its own segment of
the filter. Filter and word counts grow with the corpus. Up to ``max_broadcast``
bytes they are broadcast. Beyond, only the HOT most frequent words and pairs are;
of all others, each block of rows asks the shards once, and the scores are the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.llm.common import LOWER, arrow_map, frugal, give_back, materialize, partitions_for, texts

#: Base of the quantised counts.
BASE = 1.5
#: Weight of the pair's relative frequency.
PAIR_WEIGHT = 0.5
#: Bits and probes of the filter for each entry.
ENTRY_BITS, PROBES = 12, 7
#: Largest filter and table together that go to every worker.
MAX_BROADCAST = 32 << 20
#: Frequent words, and pairs, that every worker holds where the filter itself is too large.
HOT = 1 << 20
END, BEGIN = 0x8A5CD789635D2DFF, 0x121FD2155C472F96
CACHE_WORDS = 500_000
#: Counts of one task, which are below its FLUSH_TOKENS, and of the corpus.
_COUNT, _TOTAL = np.dtype([("h", "<u8"), ("c", "<u4")]), np.dtype([("h", "<u8"), ("c", "<u8")])
FLUSH_TOKENS = 8_000_000
#: Bytes of rows that look up together at the shards.
UNIT_BYTES = 8 << 20


def quantise(c: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(np.maximum(c, 1)) / np.log(BASE) + 1e-9)).astype(np.int64)


#: Count that a level stands for: the geometric middle of its range (0: unseen).
MIDDLE = np.concatenate([[0.0], [max(1.0, np.sqrt(np.ceil(BASE ** (q - 1)) * max(np.ceil(BASE**q) - 1, 1))) for q in range(1, 80)]])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mix(v * np.uint64(0x9E3779B97F4A7C15) + w)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of hashes, in order."""
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


class Words:
    """Numbers of words in the order in which this process met them, and their hashes; 0 is the end, 1 the begin."""

    def __init__(self):
        self.index: dict[bytes, int] = {b"": 0, b" ": 1}
        self.hashes = np.zeros(1 << 16, np.uint64)
        self.hashes[:2] = END, BEGIN

    def codes(self, text: bytes | None) -> np.ndarray:
        """Numbers of the words of a text, and of its end."""
        words = (text or b"").translate(LOWER).split()
        words.append(b"")
        try:
            return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = list({w: 0 for w in words if w not in self.index})
            n = len(self.index)
            while n + len(new) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[n : n + len(new)] = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
            self.index.update(zip(new, range(n, n + len(new))))
            return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


def _tokens(words: Words, batch: Iterable[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of tokens with each text's end, token counts of the texts) of up to about half a million tokens."""
    held, sizes, n = [], [], 0
    for text in batch:
        if len(words.index) > CACHE_WORDS and not held:
            words.__init__()
        held.append(words.codes(text))
        sizes.append(len(held[-1]))
        n += sizes[-1]
        if n > 500_000:
            yield np.concatenate(held), np.array(sizes)
            held, sizes, n = [], [], 0
    if held:
        yield np.concatenate(held), np.array(sizes)


def _pairs(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number for the word before and the word at each token."""
    before = np.roll(codes, 1)
    before[np.cumsum(sizes) - sizes] = 1
    return before << 32 | codes


def _pair_hashes(words: Words, pairs: np.ndarray) -> np.ndarray:
    return pair_hash(words.hashes[pairs >> 32], words.hashes[pairs & 0xFFFFFFFF])


def _sums(parts: list[np.ndarray], kind: np.dtype) -> np.ndarray:
    """Sum of counts by hash, sorted."""
    rows = np.concatenate([p.astype(kind) for p in parts]) if parts else np.zeros(0, kind)
    rows = rows[np.argsort(rows["h"], kind="stable")]
    if not len(rows):
        return rows
    first = np.flatnonzero(np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]]))
    out = rows[first].copy()
    out["c"] = np.add.reduceat(rows["c"], first)
    return out


def _counts_of(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), _COUNT)
    out["h"], out["c"] = h, n
    return out


def _find(known: np.ndarray, values: np.ndarray, h: np.ndarray, missing: int = 0) -> np.ndarray:
    """Values of hashes by a sorted table."""
    if not len(known):
        return np.full(len(h), missing, np.int64)
    slot = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[slot] == h, values[slot].astype(np.int64), missing)


def _count_blobs(docs: DataFrame, text: str, shards: int) -> DataFrame:
    def send(words: list[np.ndarray], pairs: list[np.ndarray]) -> pa.RecordBatch:
        w, p = _sums(words, _COUNT), _sums(pairs, _COUNT)
        wc, pc = (np.searchsorted(shard_of(x["h"], shards), np.arange(shards + 1)) for x in (w, p))
        rows = []
        for k in range(shards):
            a, b = w[wc[k] : wc[k + 1]], p[pc[k] : pc[k + 1]]
            once = b["c"] == 1
            rows.append((k, a.tobytes(), _packed(b["h"][once]), b[~once].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["shard", "words", "once", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, words, pairs, n = Words(), [], [], 0
        for batch in batches:
            for codes, sizes in _tokens(cache, texts(batch, text)):
                met = np.bincount(codes)
                own = np.flatnonzero(met)
                words.append(_counts_of(cache.hashes[own], met[own]))
                both, m = np.unique(_pairs(codes, sizes), return_counts=True)
                pairs.append(_counts_of(_pair_hashes(cache, both), m))
                n += len(codes)
                if n > FLUSH_TOKENS:
                    yield send(words, pairs)
                    words, pairs, n = [], [], 0
        if n:
            yield send(words, pairs)

    return docs.select(text).mapInArrow(frugal(run), "shard int, words binary, once binary, pairs binary")


def _merged(blobs: DataFrame, shards: int) -> DataFrame:
    """Per shard: exact word counts, levels of the pairs, and how much the filter must hold."""

    def close(shard: int, words: list, pairs: list) -> tuple:
        w, p = _sums(words, _TOTAL), _sums(pairs, _TOTAL)
        levels = quantise(p["c"])
        return shard, w.tobytes(), _packed(p["h"]), levels.astype(np.uint8).tobytes(), int(w["c"].sum(dtype=np.int64)), len(w), int(levels.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(row: tuple) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], ["shard", "words", "pairs", "levels", "tokens", "types", "entries"])

        now, words, pairs = None, [], []
        for batch in batches:
            for shard, a, b, c in zip(*(batch.column(k).to_pylist() for k in ("shard", "words", "once", "pairs"))):
                if now is not None and shard != now:
                    yield emit(close(now, words, pairs))
                    words, pairs = [], []
                now = shard
                words.append(np.frombuffer(a, _COUNT))
                once = _unpacked(b)
                pairs += [_counts_of(once, np.ones(len(once), np.uint32)), np.frombuffer(c, _COUNT)]
                if len(pairs) >= 64:  # keeps the shard's memory near that of its distinct n-grams
                    words, pairs = [_sums(words, _TOTAL)], [_sums(pairs, _TOTAL)]
        if now is not None:
            yield emit(close(now, words, pairs))

    dealt = blobs.repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(frugal(run), "shard int, words binary, pairs binary, levels binary, tokens long, types long, entries long")


def _slots(h: np.ndarray, level: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mix(h + np.uint64(level * 0xD1342543DE82EF95 % (1 << 64)))
    return x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)


def _bit(one: np.ndarray, two: np.ndarray, k: int, bits: int) -> np.ndarray:
    return (((one + np.uint64(k) * two) & np.uint64(0xFFFFFFFF)) * np.uint64(bits)) >> np.uint64(32)


def fill_segment(pairs: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
    """A shard's segment of the filter, ``bits`` long (a multiple of 8)."""
    out = np.zeros(bits // 8, np.uint8)
    h, last, level = pairs, levels.astype(np.int64), 1
    while len(h):
        one, two = _slots(h, level, bits)
        for k in range(PROBES):
            at = _bit(one, two, k, bits)
            np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
        level += 1
        more = last >= level
        h, last = h[more], last[more]
    return out


class Filter:
    """Segments of one size in a row; a hash's shard says which segment holds it."""

    def __init__(self, data: np.ndarray, shards: int, bits: int, first_shard: int = 0):
        self.data, self.shards, self.bits, self.first_shard = data, shards, bits, first_shard

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The last level up to which all are present; 0 if none is."""
        out = np.zeros(len(h), np.int64)
        if not self.bits:
            return out
        rows, level = np.arange(len(h)), 1
        base = (shard_of(h, self.shards) - np.uint64(self.first_shard)) * np.uint64(self.bits)
        while len(rows) and level < len(MIDDLE):
            one, two = _slots(h[rows], level, self.bits)
            own = base[rows]
            for k in range(PROBES):
                at = own + _bit(one, two, k, self.bits)
                there = (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                rows, one, two, own = rows[there], one[there], two[there], own[there]
                if not len(rows):
                    break
            out[rows] = level
            level += 1
        return out


class Model:
    """What :func:`fit` learnt: shard rows (a frame), sizes, number of documents."""

    def __init__(self, shards: DataFrame, n_shards: int, bits: int, tokens: int, types: int, n_docs: int):
        self.rows, self.n_shards, self.bits, self.tokens, self.types, self.n_docs = shards, n_shards, bits, tokens, types, n_docs

    @property
    def n_bytes(self) -> int:
        return self.n_shards * self.bits // 8 + self.types * _TOTAL.itemsize


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Count the words and pairs of all ``docs``; null texts are empty, other columns are ignored."""
    n_shards = max(partitions_for(docs.sparkSession), docs.rdd.getNumPartitions())
    rows = materialize(_merged(_count_blobs(docs, text, n_shards), n_shards), "ngrams", sweep=True)
    tokens, types, most = rows.agg(*(F.coalesce(f(c), F.lit(0)) for f, c in ((F.sum, "tokens"), (F.sum, "types"), (F.max, "entries")))).first()
    bits = -(-most * ENTRY_BITS // 8) * 8
    # every document has one end, so the count of ends is the number of documents
    end_shard = int(shard_of(np.array([END], np.uint64), n_shards)[0])
    found = rows.where(F.col("shard") == end_shard).select("words").collect()
    table = np.frombuffer(found[0][0], _TOTAL) if found else np.zeros(0, _TOTAL)
    n_docs = int(table["c"][table["h"] == np.uint64(END)].sum())
    return Model(rows, n_shards, bits, int(tokens), int(types), n_docs)


def _log10_probability(pair: np.ndarray, history: np.ndarray, word: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """From the pair's estimated and the words' exact counts; words that were never seen share the probability of one more."""
    own = (word + 1) / (tokens + types + 1)
    weight = np.where(history > 0, PAIR_WEIGHT, 0.0)
    return np.log10((1 - weight) * own + weight * np.minimum(1.0, pair / np.maximum(history, 1.0)))


def _base(c: np.ndarray, tokens: int, types: int) -> np.ndarray:
    return np.log10((c + 1) / (tokens + types + 1))


_OUT = "n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model, keys: tuple[str, ...] = ("doc_id",), text: str = "text", max_broadcast: int | None = None) -> DataFrame:
    """Per row: keys, n_tokens, n_known, base_score, score (log10 probability of the text).

    A null text is empty: its end alone is scored. Every row of ``docs`` gives one.
    """
    return (_score_here if model.n_bytes <= (MAX_BROADCAST if max_broadcast is None else max_broadcast) else _score_there)(docs, model, keys, text)


def _score_here(docs: DataFrame, model: Model, keys: tuple[str, ...], text: str) -> DataFrame:
    bits, n_shards, tokens, types, n_docs = model.bits, model.n_shards, model.tokens, model.types, model.n_docs

    def fill(batch: pa.RecordBatch) -> dict:
        cols = [batch.column(c).to_pylist() for c in ("pairs", "levels")]
        return {"shard": batch.column("shard"), "words": batch.column("words"), "segment": [fill_segment(_unpacked(p), np.frombuffer(q, np.uint8), bits).tobytes() for p, q in zip(*cols)]}

    found = arrow_map(model.rows, fill, "shard int, words binary, segment binary").toArrow()
    data, tables = np.zeros(n_shards * bits // 8, np.uint8), {}
    for batch in found.to_batches():
        for k, words, segment in zip(*(batch.column(c) for c in ("shard", "words", "segment"))):
            k = k.as_py()
            data[k * bits // 8 : (k + 1) * bits // 8] = np.frombuffer(segment.as_buffer(), np.uint8)
            tables[k] = np.frombuffer(words.as_buffer(), _TOTAL)
    table = np.concatenate([tables[k] for k in sorted(tables)]) if tables else np.zeros(0, _TOTAL)
    known, counts = np.ascontiguousarray(table["h"]), np.ascontiguousarray(table["c"])
    del found, tables, table
    shared = docs.sparkSession.sparkContext.broadcast((data, known, counts))
    del data, known, counts
    types_of = dict(docs.dtypes)

    class Scorer:
        def __init__(self):
            self.words = None

        def __call__(self, batch: pa.RecordBatch) -> dict:
            data, known, counts = shared.value
            grid = Filter(data, n_shards, bits)
            words = self.words = self.words or Words()
            out: list[np.ndarray] = []
            for codes, sizes in _tokens(words, texts(batch, text)):
                met = np.flatnonzero(np.bincount(codes))
                c = np.zeros(len(words.index), np.float64)
                c[met] = _find(known, counts, words.hashes[met])
                base = np.zeros(len(c))
                base[met] = _base(c[met], tokens, types)
                starts = np.cumsum(sizes) - sizes
                both, slot = np.unique(_pairs(codes, sizes), return_inverse=True)
                history = c[both >> 32]
                history[both >> 32 == 1] = n_docs
                pair = MIDDLE[grid.levels(_pair_hashes(words, both))]
                p = _log10_probability(pair, history, c[both & 0xFFFFFFFF], tokens, types)[slot]
                out.append(np.array([sizes, np.add.reduceat((c > 0)[codes].astype(np.int64), starts), np.add.reduceat(base[codes], starts), np.add.reduceat(p, starts)]))
            n, n_known, base, p = np.concatenate(out, axis=1)
            return {k: batch.column(k) for k in keys} | {"n_tokens": n.astype(np.int64), "n_known": n_known.astype(np.int64), "base_score": base, "score": p}

    return arrow_map(docs.select(*keys, text), Scorer(), ", ".join([*(f"`{k}` {types_of[k]}" for k in keys), _OUT]))


def _hot(model: Model) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted hashes and values of the most frequent words (counts) and pairs (levels by the filter), at most HOT of each, evenly by shards."""
    each, bits, n_shards = -(-HOT // model.n_shards), model.bits, model.n_shards

    def top(batch: pa.RecordBatch) -> dict:
        out = {"pair": [], "h": [], "v": []}
        for shard, w, p, q in zip(*(batch.column(c).to_pylist() for c in ("shard", "words", "pairs", "levels"))):
            w, p, q = np.frombuffer(w, _TOTAL), _unpacked(p), np.frombuffer(q, np.uint8)
            grid = Filter(fill_segment(p, q, bits), n_shards, bits, shard)
            w, p = w[np.argsort(w["c"], kind="stable")[::-1][:each]], p[np.argsort(q, kind="stable")[::-1][:each]]
            levels = grid.levels(p)
            for pair, h, v in ((False, w["h"], w["c"]), (True, p, levels)):
                out["pair"] += [pair] * len(h)
                out["h"] += h.view(np.int64).tolist()
                out["v"] += v.tolist()
        return out

    found = arrow_map(model.rows.select("shard", "words", "pairs", "levels"), top, "pair boolean, h long, v long").toArrow()
    pair, h, v = found["pair"].to_numpy(), found["h"].to_numpy().view(np.uint64), found["v"].to_numpy()
    out = []
    for kind in (False, True):
        own = np.flatnonzero(pair == kind)
        own = own[np.argsort(h[own])]
        out.append((h[own], v[own]))
    return out


def _packed(h: np.ndarray) -> bytes:
    """Sorted hashes in some 5.5 bytes each: differences of the upper halves, compressed, and the lower halves."""
    if not len(h):
        return b""
    steps = np.diff((h >> np.uint64(32)).astype("<u4"), prepend=np.uint32(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T)
    return len(h).to_bytes(8, "little") + h.astype("<u4").tobytes() + _zipped(planes)


def _unpacked(blob: bytes | None) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    n = int.from_bytes(blob[:8], "little")
    steps = np.ascontiguousarray(_unzipped(blob[8 + 4 * n :], np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint64) << np.uint64(32) | np.frombuffer(blob, "<u4", n, 8)


def _zipped(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True)


def _unzipped(blob: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def _units(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` as compressed Arrow streams of about UNIT_BYTES, each with a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, held = TaskContext.get().partitionId() << 32, 0, []

        def close() -> pa.RecordBatch:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for batch in held:
                    stream.write_batch(batch)
            return pa.RecordBatch.from_arrays([pa.array([first + n]), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["unit", "blob"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(x.nbytes for x in held) >= UNIT_BYTES:
                    yield close()
                    n, held = n + 1, []
        if held:
            yield close()

    return docs.mapInArrow(frugal(run), "unit long, blob binary")


class _Unit:
    """A unit's rows, the numbers of its words in blocks, and the hashes of its tokens' pairs."""

    def __init__(self, words: Words, blob: bytes, text: str):
        self.batches = list(pa.ipc.open_stream(blob))
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pairs = []
        for codes, sizes in _tokens(words, (t for batch in self.batches for t in texts(batch, text))):
            met = np.flatnonzero(np.bincount(codes))
            number = np.zeros(len(words.index), np.int32)
            number[met] = np.arange(len(met), dtype=np.int32)
            own = words.hashes[codes]
            before = np.roll(own, 1)
            before[np.cumsum(sizes) - sizes] = BEGIN
            pairs.append(pair_hash(before, own))
            self.blocks.append((number[codes], words.hashes[met], sizes))
        self.pairs = np.concatenate(pairs)
        self.words = np.unique(np.concatenate([own for _, own, _ in self.blocks]))


def _cuts(h: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of sorted hashes begins, and the end."""
    return np.searchsorted(shard_of(h, shards), np.arange(shards + 1))


def _score_there(docs: DataFrame, model: Model, keys: tuple[str, ...], text: str) -> DataFrame:
    """The same scores where the filter is too large for a worker: lookups of all but the hot go to the shards.

    Rows travel in units of some million tokens. A unit asks a shard for its
    distinct words and pairs, in the order of hashes, and the shard answers with
    counts and levels in that order. Unit and answers then meet in one task.
    """
    bits, n_shards, tokens, types, n_docs = model.bits, model.n_shards, model.tokens, model.types, model.n_docs
    shared = docs.sparkSession.sparkContext.broadcast(_hot(model))
    kinds = dict(docs.dtypes)
    units = materialize(_units(docs.select(*keys, text)), "units")
    n_units = units.count()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            hot = shared.value
            for k, blob in zip(batch.column("unit").to_pylist(), batch.column("blob")):
                unit = _Unit(words, blob.as_py(), text)
                asked = [h[_find(*hot[i], h, -1) < 0] for i, h in enumerate((unit.words, np.unique(unit.pairs)))]
                cuts = [_cuts(h, n_shards) for h in asked]
                parts = [[_packed(h[cut[s] : cut[s + 1]]) for s in range(n_shards)] for h, cut in zip(asked, cuts)]
                rows = [(s, k, a, b) for s, (a, b) in enumerate(zip(*parts)) if a or b]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "unit", "words", "pairs"])
                del unit, asked, parts, rows
                give_back()

    asked = units.mapInArrow(frugal(ask), "shard int, unit long, words binary, pairs binary")
    both = model.rows.select("shard", F.lit(-1).cast("long").alias("unit"), "words", "pairs", "levels").union(asked.withColumn("levels", F.lit(None).cast("binary")))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grid, known, counts = None, None, None, None
        for batch in batches:
            out = []
            for shard, unit, w, p, q in zip(*(batch.column(c) for c in ("shard", "unit", "words", "pairs", "levels"))):
                shard, unit, w, p = shard.as_py(), unit.as_py(), w.as_py(), p.as_py()
                if unit < 0:
                    table = np.frombuffer(w, _TOTAL)
                    now, known, counts = shard, np.ascontiguousarray(table["h"]), np.ascontiguousarray(table["c"])
                    grid = Filter(fill_segment(_unpacked(p), np.frombuffer(q.as_py(), np.uint8), bits), n_shards, bits, shard)
                    continue
                w, p = _unpacked(w), _unpacked(p)
                met = shard == now
                out.append((unit, shard, _zipped(_find(known, counts, w) if met else np.zeros(len(w), np.int64)), _zipped((grid.levels(p) if met else np.zeros(len(p))).astype(np.uint8))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["unit", "shard", "counts", "blob"])

    dealt = both.repartition(n_shards, "shard").sortWithinPartitions("shard", "unit")
    known = materialize(dealt.mapInArrow(frugal(look), "unit long, shard int, counts binary, blob binary"), "known", sweep=True)

    def values(h: np.ndarray, hot: tuple[np.ndarray, np.ndarray], answers: list[tuple[int, bytes]], kind: type) -> np.ndarray:
        out = _find(*hot, h, -1)
        asked = np.flatnonzero(out < 0)
        cut = _cuts(h[asked], n_shards)
        for s, blob in answers:
            out[asked[cut[s] : cut[s + 1]]] = _unzipped(blob, kind, int(cut[s + 1] - cut[s]))
        return out

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, answers = Words(), []
        for batch in batches:
            hot = shared.value
            for shard, c, blob in zip(*(batch.column(c) for c in ("shard", "counts", "blob"))):
                if shard.is_valid:
                    answers.append((shard.as_py(), c.as_py(), blob.as_py()))
                    continue
                unit = _Unit(words, blob.as_py(), text)
                counts = values(unit.words, hot[0], [(s, x) for s, x, _ in answers], np.int64).astype(np.float64)
                order = np.argsort(unit.pairs)
                pairs = unit.pairs[order]
                first = np.concatenate([[True], pairs[1:] != pairs[:-1]])
                levels = values(pairs[first], hot[1], [(s, x) for s, _, x in answers], np.uint8).astype(np.uint8)
                level = np.empty(len(pairs), np.uint8)
                level[order] = levels[np.cumsum(first) - 1]
                del order, pairs, first, levels
                answers, out, at = [], [], 0
                for codes, own, sizes in unit.blocks:
                    c = counts[np.searchsorted(unit.words, own)]
                    starts = np.cumsum(sizes) - sizes
                    word = c[codes]
                    history = np.roll(word, 1)
                    history[starts] = n_docs
                    p = _log10_probability(MIDDLE[level[at : at + len(codes)]], history, word, tokens, types)
                    out.append(np.array([sizes, np.add.reduceat((c > 0)[codes].astype(np.int64), starts), np.add.reduceat(_base(c, tokens, types)[codes], starts), np.add.reduceat(p, starts)]))
                    at += len(codes)
                n, n_known, base, p = np.concatenate(out, axis=1)
                at = 0
                for rows in unit.batches:
                    part = slice(at, at := at + rows.num_rows)
                    yield pa.RecordBatch.from_arrays(
                        [*(rows.column(k) for k in keys), *map(pa.array, (n[part].astype(np.int64), n_known[part].astype(np.int64), base[part], p[part]))], [*keys, "n_tokens", "n_known", "base_score", "score"]
                    )
                del unit, level, out, codes, word, history, p, rows
                give_back()

    met = known.union(units.select("unit", F.lit(None).cast("int"), F.lit(None).cast("binary"), "blob"))
    # answers come before the unit itself, which has no shard
    met = met.repartition(max(partitions_for(docs.sparkSession), 2 * n_units), "unit").sortWithinPartitions("unit", F.col("shard").asc_nulls_last())
    return met.mapInArrow(frugal(finish), ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), _OUT]))


def digest(docs: DataFrame, key: str = "doc_id", max_broadcast: int | None = None) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32 of the id, as text, leaves a rest other than
    2 when divided by 7; rows without an id are neither learnt from nor held out.
    """
    rest = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(7))
    model = fit(docs.where(rest != 2))
    found = score(docs.select(key, "text"), model, (key,), max_broadcast=max_broadcast)
    return found.select(key, F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
