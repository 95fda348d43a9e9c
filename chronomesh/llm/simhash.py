"""SimHash near-duplicates by bit-sliced comparison (operator 10).

Documents that may be alike meet in buckets. Inside a bucket fingerprints are
stored as vertical bit planes, 64 to a machine word; for each fingerprint the
distances to 64 others grow at once in carry-save counters, and a word is left as
soon as all of its distances exceed the radius.

* :func:`near_duplicate_groups` links 64-bit fingerprints within a few bits. A pair
  within the radius leaves at least ``blocks - radius`` of the fingerprint's blocks
  equal, so every such pair meets in the bucket of some combination of blocks.
* :func:`similar_groups` links texts whose sets of word shingles reach a Jaccard
  similarity, verified exactly. At 0.8 two fingerprints differ in some 15 % of
  their bits, too many for blocks, so buckets are single shingles: sets this
  similar share one of the first ``n - ceil(t * n) + 1`` shingles in any order that is
  the same for all documents. Fingerprints have 256 bits there, so that the radius
  parts similar from unrelated pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.llm.common import LOWER, arrow_map, discard, fresh, frugal, materialize, partitions_for, texts
from chronomesh.llm.components import connected_components

#: A bucket of more distinct fingerprints is cut, and its parts are compared two by two in tasks of their own.
HOT = 8192
#: (fingerprint, word) pairs compared at a time in one task.
PAIRS = 1 << 19
#: 64-bit words of the fingerprints that similar sets are compared by.
WIDE = 4
#: Frequent shingles are looked for in one of so many documents; they set the order of keys only, not what is found.
SAMPLE = 8
#: Least count in that sample of a frequent shingle, and how many are known.
FREQUENT, MOST_FREQUENT = 3, 300_000
#: Shingles of one part of a group whose links are searched exactly; each two parts make a task's work.
PART_SHINGLES = 1 << 20
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of a text's word shingles in order, repeats included; fewer words are one shingle, none give none."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> np.uint64:
    """64 bits, each set if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(part), 255):
            ones += np.add.reduce(part[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned; zero without words."""
    return int(majority(shingles(text, width)))


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """WIDE words of SimHash of a set of hashes."""
    out, h = np.zeros(WIDE, np.uint64), found
    for k in range(WIDE):
        out[k] = majority(h)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return out


def with_fingerprint(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), width: int = 4, text: str = "text") -> DataFrame:
    """Keys and ``fp`` (the fingerprint's bits as a signed long) of each row."""
    types = dict(docs.dtypes)

    def run(batch: pa.RecordBatch) -> dict:
        fp = np.array([fingerprint(t, width) for t in texts(batch, text)], np.uint64)
        return {c: batch.column(c) for c in keys} | {"fp": fp.view(np.int64)}

    return arrow_map(docs.select(*keys, text), run, ", ".join(f"`{c}` {types[c]}" for c in keys) + ", fp long")


class BitPlanes:
    """Fingerprints of several buckets as vertical bit planes; a word holds up to 64 fingerprints of one bucket.

    ``fps`` has one row of 64-bit words a fingerprint (or is flat, for one word).
    With ``labels``, words that hold nothing but the row's own label are not compared.
    """

    def __init__(self, fps: np.ndarray, bucket_starts: np.ndarray, labels: np.ndarray | None = None):
        self.fps = fps = fps.reshape(len(fps), -1)
        sizes = np.diff(np.append(bucket_starts, len(fps)))
        words = -(-sizes // 64)
        first = np.cumsum(words) - words
        inside = np.arange(len(fps)) - np.repeat(bucket_starts, sizes)
        lane = (inside % 64).astype(np.uint64)
        begins = np.flatnonzero(inside % 64 == 0)
        self.base, self.filled = begins, np.diff(np.append(begins, len(fps)))
        self.planes = np.array([np.bitwise_or.reduceat(((fps[:, j // 64] >> np.uint64(j % 64)) & _ONE) << lane, begins) for j in range(64 * fps.shape[1])])
        self.first, self.words, self.inside = np.repeat(first, sizes), np.repeat(words, sizes), inside
        self.labels = labels
        if labels is not None:
            self.least, self.most = np.minimum.reduceat(labels, begins), np.maximum.reduceat(labels, begins)

    def matches(self, radius: int):
        """Yields (row, word, lanes): rows later in the row's bucket within the radius."""
        ahead = self.words - self.inside // 64
        bounds = np.concatenate([[0], np.cumsum(ahead)])
        at = 0
        while at < len(self.fps):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PAIRS, "right")) - 1)
            n = ahead[at:end]
            row = np.repeat(np.arange(at, end), n)
            word = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[at:end] + self.inside[at:end] // 64, n)
            yield from self._compare(row, word, radius)
            at = end

    def _compare(self, row: np.ndarray, word: np.ndarray, radius: int):
        low = np.maximum(row - self.base[word] + 1, 0)
        filled = self.filled[word]
        some = low < filled
        if self.labels is not None:
            own = self.labels[row]
            some &= (self.least[word] != own) | (self.most[word] != own)
        row, word, low, filled = row[some], word[some], low[some].astype(np.uint64), filled[some]
        full = np.where(filled >= 64, _ALL, (_ONE << (filled % 64).astype(np.uint64)) - _ONE)
        over = ~(full & (_ALL << low))
        bits = max(1, radius.bit_length())
        counters = [np.zeros(len(row), np.uint64) for _ in range(bits)]
        query = self.fps[row]
        last = len(self.planes) - 1
        for j, plane in enumerate(self.planes):
            carry = plane[word] ^ (np.uint64(0) - ((query[:, j // 64] >> np.uint64(j % 64)) & _ONE))
            for k in range(bits):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if j % 6 == 5 and j >= radius or j == last:
                dead = over | _exceeds(counters, radius)
                alive = np.flatnonzero(dead != _ALL)
                if len(alive) < 0.8 * len(row) or j == last:
                    row, word, query, over = row[alive], word[alive], query[alive], dead[alive]
                    counters = [c[alive] for c in counters]
                if not len(row):
                    return
        yield row, word, ~over


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _ALL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above = above | equal & counters[k]
            equal = equal & ~counters[k]
    return above


def forest(fps: np.ndarray, keys: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, bucket by bucket, what lies within the radius; fewer than rows."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    planes = BitPlanes(fps, starts)
    label = np.arange(len(fps))
    bucket = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(fps))))
    ends = np.append(starts, len(fps))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for row, word, lanes in planes.matches(radius):
        base = planes.base[word]
        for i, b, mask in zip(row.tolist(), base.tolist(), lanes.tolist()):
            a, z = ends[bucket[i]], ends[bucket[i] + 1]
            if z - a > 64:  # roots of many rows at once
                own = b + np.flatnonzero(np.unpackbits(np.array([mask], np.uint64).view(np.uint8), bitorder="little"))
                top = own[label[own] != label[i]].tolist() if len(own) > 1 else own.tolist()
                others = {root(j) for j in top}
            else:
                others = set()
                while mask:
                    bit = mask & -mask
                    others.add(root(b + bit.bit_length() - 1))
                    mask ^= bit
            mine = root(i)
            least = min([mine, *others])
            for j in (mine, *others):
                label[j] = least
    while True:
        up = label[label]
        if (up == label).all():
            break
        label = up
    child = np.flatnonzero(label != np.arange(len(fps)))
    return fps[label[child]], fps[child]


def blocks_for(n: int, radius: int) -> list[int]:
    """Bits of the blocks of a fingerprint, from the lowest: enough for buckets of a few by chance among ``n``."""
    blocks = radius + 2
    while blocks < 16 and n >> (64 * (blocks - radius) // blocks) > 8:
        blocks += 1
    return [64 // blocks + (k < 64 % blocks) for k in range(blocks)]


def _shared(keyed: DataFrame, key: str = "key") -> DataFrame:
    """The keys of more than one row and their number ``n``; counted before anything is gathered."""
    return keyed.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def _cut(bucketed: DataFrame, columns: list[str], node: str) -> DataFrame:
    """Buckets (key, n) of over HOT rows become one for each two of their parts; sorted for a task, by key."""
    cuts = F.ceil(F.col("n") / HOT).cast("int")
    part = F.pmod(F.xxhash64(node), cuts).cast("int")
    others = F.transform(F.sequence(F.lit(0), cuts - 1), lambda k: F.least(k, part) * 1_000_000 + F.greatest(k, part))
    pairs = bucketed.select(*columns, "key", F.explode(F.when(F.col("n") <= HOT, F.array(F.lit(0))).otherwise(others)).alias("pair"))
    return pairs.select(*columns, F.xxhash64("key", "pair").alias("key")).repartition(max(12, partitions_for(bucketed.sparkSession)), "key")


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) within the radius.

    Enough links to connect all that are connected: each bucket gives a forest.
    Buckets are keyed by the values of all but ``radius`` blocks; buckets of one
    fingerprint go at once, those of over HOT are cut into parts and each two
    parts are compared in a task of their own. The number of blocks grows with
    that of the fingerprints, so that buckets do not.
    """
    if not 0 <= radius < 14:
        raise ValueError("radius must be 0 to 13")
    blocks = blocks_for(fps.count(), radius)
    offsets = np.concatenate([[0], np.cumsum(blocks)]).tolist()
    keys = []
    for n, chosen in enumerate(combinations(range(len(blocks)), len(blocks) - radius)):
        mask = sum(((1 << blocks[b]) - 1) << offsets[b] for b in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(mask))))
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    bucketed = _cut(keyed.join(_shared(keyed), "key"), ["fp"], "fp").sortWithinPartitions("key", "fp")

    def run(batches):
        fp, key = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            key = np.concatenate([key, batch.column("key").to_numpy()])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut >= 1 << 15:
                yield _edges(*forest(fp[:cut], key[:cut], radius))
                fp, key = fp[cut:], key[cut:]
        if len(fp):
            yield _edges(*forest(fp, key, radius))

    return bucketed.mapInArrow(frugal(run), "a long, b long").distinct()


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def near_duplicate_groups(docs: DataFrame, radius: int = 4, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, fp and component_id, the least key reachable.

    Texts without words, null ones too, have fingerprint zero and are linked like
    any other. Equal fingerprints are one node, so groups of exact copies, however
    large, cost one row each. Rows with a null key get the component of their
    fingerprint; repeated rows stay; rows that repeat a key with another text
    have a fingerprint and component of their own; an empty table gives no row.
    """
    marked = materialize(with_fingerprint(docs, (key,), width, text), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min(key).alias("least")), "classes")
    found = connected_components(links(classes.select("fp"), radius))
    members = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    of = members.select("fp", "component").join(least, "component").select("fp", "component_id")
    return marked.join(of, "fp").select(key, "fp", "component_id")


# -- texts of similar shingle sets --------------------------------------------
def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Hashes of a text's distinct shingles, sorted; a text without words has one that stands for that."""
    found = shingles(text, width)
    return np.unique(found) if len(found) else np.array([xxhash.xxh64_intdigest(b"", 42)], np.uint64)


def prefix(found: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles by which a set is keyed; ``frequent`` (sorted) come last, by their counts."""
    n = len(found)
    rank = np.zeros(n, np.int64)
    if len(frequent):
        slot = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        rank = np.where(frequent[slot] == found, counts[slot], 0)
    return found[np.lexsort((found, rank))[: n - math.ceil(similarity * n - 1e-9) + 1]]


def wide_radius(similarity: float) -> int:
    """Bits that wide fingerprints of similar sets differ by at most.

    Bits differ with the chance angle / pi of the sets' vectors, which is greatest
    for sets of one size; sets of four and five have 3/16 at 0.8. Six and a half
    standard deviations lie above that: one pair in ten thousand million.
    """
    p = max(0.19, math.acos(2 * similarity / (1 + similarity)) / math.pi + 0.04)
    return min(64 * WIDE - 1, math.ceil(64 * WIDE * p + 6.5 * math.sqrt(64 * WIDE * p * (1 - p))))


def _reaches(common, a, b, similarity: float):
    return common >= similarity * (a + b - common) - 1e-9


def _frequent(docs: DataFrame, key: str, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the documents repeats and their counts (at most MOST_FREQUENT)."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"s": [shingle_set(t, width).view(np.int64) for t in texts(batch, text)]}

    sample = docs.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(SAMPLE)) == 0).select(text)
    counted = arrow_map(sample, run, "s array<long>").select(F.explode("s").alias("s")).groupBy("s").count().where(F.col("count") >= FREQUENT)
    top = counted.orderBy(F.desc("count"), "s").limit(MOST_FREQUENT).toArrow()
    found, n = top.column("s").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(found)
    return found[order], n[order]


class _Links:
    """Union of labels, with the links that united them."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.found: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in set(zip(a.tolist(), b.tolist())):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.found.append((max(x, y), min(x, y)))


def candidates(fps: np.ndarray, keys: np.ndarray, labels: np.ndarray, sizes: np.ndarray, radius: int, similarity: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links of labels of rows within the radius in a bucket, and which rows have such a partner of another label."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    planes, out, some = BitPlanes(fps, starts, labels), _Links(), np.zeros(len(fps), bool)
    for row, word, lanes in planes.matches(radius):
        for at in range(0, len(row), 1 << 13):
            r, w = row[at : at + (1 << 13)], word[at : at + (1 << 13)]
            which, lane = np.nonzero(np.unpackbits(lanes[at : at + (1 << 13)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = r[which], planes.base[w[which]] + lane
            own = (labels[a] != labels[b]) & _reaches(np.minimum(sizes[a], sizes[b]), sizes[a], sizes[b], similarity)
            a, b = a[own], b[own]
            some[a] = some[b] = True
            out.add(labels[a], labels[b])
    return out.found, some


def similar_links(sets: list[np.ndarray], labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of labels that connect all sets of at least this similarity."""
    sizes, out = np.array([len(s) for s in sets]), _Links()
    _, codes, shared = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    own = shared[codes] > 1
    codes, owner = codes[own], owner[own]
    order = np.argsort(codes, kind="stable")
    holders, first = owner[order], np.searchsorted(codes[order], np.arange(len(shared) + 1))
    ends = np.searchsorted(owner, np.arange(len(sets) + 1))
    for i in range(1, len(sets)):
        mine = codes[ends[i] : ends[i + 1]]
        if len(mine):
            before = np.concatenate([holders[a : a + np.searchsorted(holders[a:b], i)] for a, b in zip(first[mine].tolist(), first[mine + 1].tolist())])
            others, common = np.unique(before, return_counts=True)
            near = others[_reaches(common, sizes[others], sizes[i], similarity) & (labels[others] != labels[i])]
            out.add(np.full(len(near), labels[i]), labels[near])
    return out.found


def _link_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def similar_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs`` with a key: key, text_hash (xxhash64 of the text) and ``first``, the least (key, text_hash) reachable by similar pairs.

    Similarity is the Jaccard similarity of the sets of word shingles; texts
    without words, null ones too, are alike. Rows are told apart by key and text,
    so rows that repeat a key with another text have a group of their own. Rows
    with a null key are left out. An empty table gives no row.

    Texts of one set are one node. Nodes are keyed by shingles; every node is
    compared with the first of each of its buckets, exactly, and buckets whose
    nodes are then connected are done. In the others fingerprints are compared by
    bit planes, and the sets of what is close but not connected are compared
    exactly, in groups cut by their number of shingles.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    docs = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("hash", F.xxhash64("text"))
    shared, radius = docs.sparkSession.sparkContext.broadcast(_frequent(docs, "key", "text", width)), wide_radius(similarity)
    kind = dict(docs.dtypes)["key"]

    def mark(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, width) for t in texts(batch)]
        ids = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for s in sets]).reshape(-1, 2)
        fps = np.array([wide_fingerprint(s) for s in sets]).reshape(-1, WIDE).view(np.int64)
        out = {"key": batch.column("key"), "hash": batch.column("hash"), "h1": ids[:, 0], "h2": ids[:, 1], "size": [len(s) for s in sets]}
        return out | {f"f{k}": fps[:, k] for k in range(WIDE)} | {"shingles": [prefix(s, similarity, *shared.value).view(np.int64) for s in sets]}

    words = [f"f{k}" for k in range(WIDE)]
    marked = materialize(arrow_map(docs, mark, f"key {kind}, hash long, h1 long, h2 long, size long, {', '.join(f'{w} long' for w in words)}, shingles array<long>"), "shingles")
    found = marked.groupBy("h1", "h2").agg(F.min(F.struct("key", "hash")).alias("first"), *(F.any_value(c).alias(c) for c in ("size", *words, "shingles")))
    classes = materialize(found.withColumn("node", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("node", F.explode("shingles").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    bucketed = materialize(keyed.join(buckets, "key"), "buckets")
    print_of = classes.select("node", "size", *words)

    def fetch(nodes: DataFrame) -> DataFrame:
        """(node, content) for each row of ``nodes``: the set, as an array."""
        wanted = classes.join(nodes, "node", "left_semi").select("node", F.col("first.key").alias("key"), F.col("first.hash").alias("hash"))
        own = docs.join(wanted, ["key", "hash"]).groupBy("node").agg(F.any_value("text").alias("text"))

        def sets_of(batch: pa.RecordBatch) -> dict:
            return {"node": batch.column("node"), "content": [shingle_set(t, width).view(np.int64) for t in texts(batch)]}

        return arrow_map(own, sets_of, "node long, content array<long>")

    # each node and the first node of its buckets
    one, two = (print_of.select(*(F.col(c).alias(f"{c}_{side}") for c in print_of.columns)) for side in ("a", "b"))
    stars = bucketed.where("node > least").select(F.col("node").alias("node_a"), F.col("least").alias("node_b")).distinct().join(one, "node_a").join(two, "node_b")
    apart = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words), F.lit(0))
    stars = stars.where((apart <= radius) & _reaches(F.least("size_a", "size_b"), F.col("size_a"), F.col("size_b"), similarity)).select("node_a", "node_b")
    stars = materialize(stars, "stars")
    contents = materialize(fetch(stars.select(F.col("node_a").alias("node")).union(stars.select("node_b")).distinct()), "sets")
    left, right = (contents.select(F.col("node").alias(f"node_{side}"), F.col("content").alias(side)) for side in ("a", "b"))
    common = F.size(F.array_intersect("a", "b"))
    alike = stars.join(right, "node_b").join(left, "node_a").where(_reaches(common, F.size("a"), F.size("b"), similarity))
    joined = connected_components(alike.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    discard(contents)

    # buckets that are not connected yet
    labelled = bucketed.join(joined, "node", "left").select("key", "n", "node", F.coalesce("component", "node").alias("label"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    rows = _cut(labelled.join(open_keys, "key").join(print_of, "node"), ["node", "label", "size", *words], "node").sortWithinPartitions("key", "label", "node")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            col = {c: table[c].to_numpy() for c in table.column_names}
            fps = np.array([col[w] for w in words]).T.view(np.uint64)
            found, some = candidates(fps, col["key"], col["label"], col["size"], radius, similarity)
            yield from _tagged(found, 0)
            yield from _tagged(sorted(set(zip(col["node"][some].tolist(), col["label"][some].tolist()))), 1)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 1 << 15:
                table = pa.Table.from_batches(held)
                keys = table["key"].to_numpy()
                cut = int(np.flatnonzero(keys == keys[-1])[0])
                if cut:
                    yield from flush(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
        if held and sum(b.num_rows for b in held):
            yield from flush(pa.Table.from_batches(held))

    def _tagged(found: list[tuple[int, int]], tag: int) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([tag] * len(found), pa.int32())], ["a", "b", "tag"])

    near = materialize(rows.mapInArrow(frugal(close), "a long, b long, tag int").distinct(), "near")
    groups = connected_components(near.where("tag = 0").select("a", "b")).select(F.col("node").alias("label"), F.col("component").alias("grp"))
    members = materialize(near.where("tag = 1").select(F.col("a").alias("node"), F.col("b").alias("label")).join(groups, "label").join(classes.select("node", "size"), "node"), "members")
    parts = members.groupBy("grp").agg(F.ceil(F.sum("size") / PART_SHINGLES).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.least(k, part) * 1_000_000 + F.greatest(k, part))
    dealt = members.join(parts, "grp").select("node", "label", "grp", F.explode(pairs).alias("pair")).join(fetch(members.select("node")), "node")
    dealt = dealt.repartition(partitions_for(docs.sparkSession), "grp", "pair").sortWithinPartitions("grp", "pair", "label", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, labels, sets = None, [], []
        for batch in batches:
            for g, p, label, content in zip(*(batch.column(c).to_pylist() if c != "content" else batch.column(c) for c in ("grp", "pair", "label", "content"))):
                if (g, p) != now:
                    if len(sets) > 1:
                        yield _link_batch(similar_links(sets, np.array(labels), similarity))
                    now, labels, sets = (g, p), [], []
                labels.append(label)
                sets.append(content.values.to_numpy().view(np.uint64))
        if len(sets) > 1:
            yield _link_batch(similar_links(sets, np.array(labels), similarity))

    more = connected_components(dealt.mapInArrow(frugal(verify), "a long, b long")).select(F.col("node").alias("label"), F.col("component").alias("above"))
    of = classes.join(joined, "node", "left").select("h1", "h2", "first", F.coalesce("component", "node").alias("label")).join(more, "label", "left")
    of = of.select("h1", "h2", "first", F.coalesce("above", "label").alias("label"))
    least = of.groupBy("label").agg(F.min("first").alias("first"))
    return marked.select("key", "hash", "h1", "h2").join(of.select("h1", "h2", "label").join(least, "label"), ["h1", "h2"]).select(F.col("key").alias(key), F.col("hash").alias("text_hash"), "first")


def deduplicate(docs: DataFrame, radius: int = 4, width: int = 4, key: str = "doc_id", text: str = "text", similarity: float | None = None) -> DataFrame:
    """Keep one document of each group, that of the least key (then of the least hash of its text); columns stay.

    Groups are those of fingerprints within ``radius``; with ``similarity`` those
    of shingle sets at least so similar. Rows are told apart by key and text:
    rows that repeat both are one document and share its fate, a row with another
    text under the same key is another document. Rows with a null key are kept.
    """
    if similarity is not None:
        groups = similar_groups(docs, similarity, width, key, text)
    else:
        keyed = docs.where(F.col(key).isNotNull()).select(F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("hash")).alias("row"), F.col(text).alias("text"))
        found = near_duplicate_groups(keyed, radius, width, "row", "text")
        groups = found.select(F.col("row.key").alias(key), F.col("row.hash").alias("text_hash"), F.col("component_id").alias("first"))
    of_key, of_text = fresh(docs, "gone_key"), fresh(docs, "gone_text")
    gone = groups.where((F.col(key) != F.col("first.key")) | (F.col("text_hash") != F.col("first.hash"))).select(F.col(key).alias(of_key), F.col("text_hash").alias(of_text)).distinct()
    return docs.join(gone, (docs[key] == gone[of_key]) & (F.xxhash64(docs[text]) == gone[of_text]), "left_anti")
