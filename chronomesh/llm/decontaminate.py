"""Benchmark decontamination by a broadcast set of test n-grams (operator 6).

The normalised words of the benchmark get numbers; a window of ``n`` words (a
shorter item: all its words) becomes a 64-bit polynomial hash. Blocks of these
hashes of a checked size are broadcast; documents are scanned window by window,
hits are verified word by word.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.llm.common import arrow_map, fresh, materialize, texts

#: Words are runs of ASCII letters and digits and of non-ASCII characters, in lower case.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 64 << 20
_WORD = re.compile(rb"[^ ]+")
_P = 0x9E3779B97F4A7C15


class WindowSet:
    """The windows of some benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.vocab: dict[bytes, int] = {}
        self.items: list[str] = []
        self.windows: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for name, text in items:
            words = text.translate(NORMAL).split()
            if not words:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            k = len(self.items)
            self.items.append(name)
            size = min(n, len(ids))
            of = self.windows.setdefault(size, {})
            for i in range(len(ids) - size + 1):
                who = of.setdefault(tuple(ids[i : i + size]), [])
                if not who or who[-1] != k:
                    who.append(k)
        self.hashes = {size: np.unique(_rolled(np.array(list(of), np.uint64).T)) for size, of in self.windows.items()}

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items whose windows occur."""
        hit, found = np.zeros(len(words), bool), set()
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.uint64, len(words))
        gaps = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, of in self.windows.items():
            n = len(ids) - size + 1
            if n <= 0:
                continue
            at = np.flatnonzero(gaps[size:] == gaps[:-size])
            if not len(at):
                continue
            sums = _rolled([ids[at + k] for k in range(size)])
            known = self.hashes[size]
            slot = np.minimum(np.searchsorted(known, sums), len(known) - 1)
            for i in at[known[slot] == sums]:
                who = of.get(tuple(ids[i : i + size].tolist()))
                if who is not None:
                    hit[i : i + size] = True
                    found.update(who)
        return hit, found


def _rolled(columns) -> np.ndarray:
    total = np.zeros(len(columns[0]) if len(columns) else 0, np.uint64)
    for c in columns:
        total = (total ^ c) * np.uint64(_P)
        total ^= total >> np.uint64(29)
    return total


def _blocks(benchmark: DataFrame, item: str, text: str) -> list[DataFrame]:
    """The benchmark's distinct rows in parts whose text is within BLOCK_BYTES each (one hash range a part)."""
    bench = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct()
    size = bench.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = 1 if size <= BLOCK_BYTES else 2 * -(-size // BLOCK_BYTES)
    return [bench if n == 1 else bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n)]


def scan_documents(docs: DataFrame, benchmark: DataFrame, n: int = 8, text: str = "text", item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """All columns of ``docs`` plus four new ones, whose names are returned by role.

    ``words`` (long) number of words, ``hits`` (binary) a bit per word that lies
    in a benchmark window, ``n_hits`` (long) their number, ``items`` (array of string) the items met, sorted.
    A null text has no words; items with a null id or text, or without words,
    are no items; an item met twice counts once; columns may have any names.
    """
    names = {k: fresh(docs, f"{k}_of_scan") for k in ("words", "hits", "n_hits", "items")}
    out, many = docs, _blocks(benchmark, item, item_text)
    for k, block in enumerate(many):
        found = docs.sparkSession.sparkContext.broadcast(WindowSet([(r[0], r[1].encode()) for r in block.collect()], n))
        base = list(docs.columns)

        def scan(batch: pa.RecordBatch, found=found, first=k == 0) -> dict:
            windows = found.value
            n_words, hits, n_hits, items = [], [], [], []
            before = repeat((b"", [])) if first else zip(batch.column(names["hits"]).to_pylist(), batch.column(names["items"]).to_pylist())
            for t, (bits, had) in zip(texts(batch, text), before):
                words = (t or b"").translate(NORMAL).split()
                hit, who = windows.scan(words)
                if bits:
                    hit |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words)).astype(bool)
                n_words.append(len(words))
                hits.append(np.packbits(hit).tobytes())
                n_hits.append(int(hit.sum()))
                items.append(sorted({*had, *(windows.items[i] for i in who)}))
            return {c: batch.column(c) for c in base} | {names["words"]: n_words, names["hits"]: hits, names["n_hits"]: n_hits, names["items"]: items}

        schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", {names['words']} long, {names['hits']} binary, {names['n_hits']} long, {names['items']} array<string>"
        out = arrow_map(out, scan, schema)
        if k + 1 < len(many):
            out = materialize(out, "scan")
    return out, names


def digest(docs: DataFrame, benchmark: DataFrame, n: int = 8, least_items: int = 2, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: keys, n_words, n_hit, n_items, items_sha256, contaminated."""
    found, c = scan_documents(docs.select(*keys, "text"), benchmark, n)
    return found.select(
        *keys,
        F.col(c["words"]).alias("n_words"),
        F.col(c["n_hits"]).alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.col(c["items"])), 256).alias("items_sha256"),
        (F.size(c["items"]) >= least_items).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, least_items: int = 2, text: str = "text") -> DataFrame:
    """Remove benchmark passages: documents and spans.

    Documents with windows of ``least_items`` or more items go; from the others
    the words inside windows are cut out of the text, and the rest of the text,
    its spacing included, stays byte for byte. Columns are those of ``docs``.
    """
    found, c = scan_documents(docs, benchmark, n, text)
    base = list(docs.columns)

    def cut(batch: pa.RecordBatch) -> dict:
        out = []
        for t, bits in zip(texts(batch, text), batch.column(c["hits"]).to_pylist()):
            if t is None or not any(bits or b""):
                out.append(t)
                continue
            spans = [m.span() for m in _WORD.finditer(t.translate(NORMAL))]
            hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(spans))
            kept, at = [], 0
            for i in np.flatnonzero(np.diff(np.concatenate([[0], hit])) == 1):
                j = i
                while j + 1 < len(spans) and hit[j + 1]:
                    j += 1
                kept.append(t[at : spans[i][0]])
                at = spans[j][1]
            out.append(b"".join([*kept, t[at:]]))
        return {x: batch.column(x) for x in base} | {text: pa.array([t if t is None else t.decode() for t in out], pa.string())}

    kept = found.where(F.size(c["items"]) < least_items).select(*base, c["hits"])
    return arrow_map(kept, cut, ", ".join(f"`{x}` {t}" for x, t in docs.dtypes))

