"""Token encoding with a word cache, exact length histograms (operator 5).

The BPE of ``word_bpe_49k`` drops white space and never merges across it, so
the ids of a text are the ids of its white-space separated words in order.
:class:`WordEncoder` asks the tokenizer once for each distinct word that a
process meets and gathers ids with numpy. New Latin words are merged by
``tiktoken`` over the same file's ranks, which is some thirty times as fast and
gives the same ids (tested); all others go through the tokenizer itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.llm.common import arrow_map, materialize, texts

#: Distinct words kept in one task's cache before it starts anew.
CACHE_WORDS = 250_000
#: Stands for the end of a word; UTF-8 never holds this byte.
END = b"\xff"
#: Latin words without special tokens, where lower case and NFC look at one letter at a time.
PLAIN = re.compile("[\x21-\x3b\x3d-\x7b\x7d\x7e\xa1-\xac\xae-\u012f\u0131-\u017e]+").fullmatch
#: The vocabulary's own split of a word into parts (a fixed pattern of the file).
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
#: Marks that end words and are a part of their own there.
MARKS = frozenset(".,;:!?")
#: Characters that Python takes for white space and the tokenizer does not.
ODD = re.compile("[\x1c-\x1f]").search
_encoders: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """This worker process's encoder; its cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _merger(path: str):
    """The file's merges as a ``tiktoken`` encoder: there the rank of a merge is the id it makes, as in the file."""
    import tiktoken

    vocab = json.loads(open(path).read())["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {END: len(vocab)}
    for token, i in vocab.items():
        core = token.removesuffix("</w>")
        if core and set(core) <= letter.keys() and letter[core[-1]] != 255 and not core.startswith("<|"):
            ranks[bytes(letter[c] for c in core) + (END if core != token else b"")] = i
    return tiktoken.Encoding("merges", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})


class _Numbers(dict):
    """Numbers words as they are looked up; ``new`` has those that were not there before."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """ids of whole texts, equal to ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bpe = _merger(path)
        self.marks = {m: self.bpe._core_bpe.encode_single_piece(m.encode() + END) for m in MARKS}
        self._clear()

    def _clear(self) -> None:
        self.index = _Numbers()
        self.cores: dict[str, list[int]] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, words: list[str]) -> None:
        piece, lists = self.bpe._core_bpe.encode_single_piece, []
        cores, append = self.cores, lists.append
        for word in words:
            core, mark = word.lower(), []
            if core[-1] in MARKS and len(core) > 1:  # most words are letters and at most one mark
                core, mark = core[:-1], self.marks[core[-1]]
            if core.isalpha() and (core.isascii() or PLAIN(word)):  # a single part, which NFC leaves alone
                ids = cores.get(core)
                if ids is None:
                    ids = cores[core] = piece(core.encode() + END)
                append(ids + mark if mark else ids)
            elif PLAIN(word):
                parts = PARTS(unicodedata.normalize("NFC", word).lower())
                ids = piece(parts[0].encode() + END)
                for part in parts[1:]:
                    ids += piece(part.encode() + END)
                append(ids)
            else:
                append(self._encode(word).tolist())
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        n = len(self.index) - len(words)
        while n + len(words) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + len(words)] = sizes
        self.used += len(flat)

    def _codes(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if len(self.index) > CACHE_WORDS:
            self._clear()
        codes = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            try:
                self._learn(self.index.new)
            except BaseException:
                self._clear()  # its new words have numbers and no ids
                raise
            self.index.new = []
        return codes

    def length(self, text: str | None) -> int:
        if ODD(text or ""):
            return len(self._encode(text))
        codes = self._codes(text)
        return int(self.sizes[codes].sum())

    def ids(self, text: str | None) -> np.ndarray:
        if ODD(text or ""):
            return self._encode(text)
        codes = self._codes(text)
        sizes = self.sizes[codes]
        total = int(sizes.sum())
        if not total:
            return np.zeros(0, np.uint32)
        ends = np.cumsum(sizes)
        return self.flat[np.arange(total) + np.repeat(self.starts[codes] - (ends - sizes), sizes)]


def with_length(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """One column, the encoded length of each text; null and empty texts have 0."""

    def lengths(batch: pa.RecordBatch) -> dict:
        encoder = encoder_for(path)
        return {out: [encoder.length(t and t.decode()) for t in texts(batch, text)]}

    return arrow_map(docs.select(text), lengths, f"{out} long")


def length_histogram(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Exact histogram of encoded lengths with prefix and suffix sums.

    One row per distinct length ``n_tokens``, which also stands for the context
    limit of that many tokens:

    * ``n_docs`` documents of that length, ``n_docs_le`` at most, ``n_docs_ge`` at least;
    * ``tokens_le`` / ``tokens_ge`` their tokens;
    * ``truncated_total`` tokens left if every document is cut at the limit;
    * ``quantile`` share of documents of at most this length.

    Null and empty texts count as length 0, repeated rows count each, an empty
    table gives no row, other columns are ignored. Only the histogram is shuffled,
    and it is written once, so texts are encoded once; sums run over blocks of lengths and then over the blocks' totals, so no
    single task sees all lengths.
    """
    hist = materialize(with_length(docs, path, text).groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "histogram")
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / 4096))
    tokens: Column = F.col("n_docs") * F.col("n_tokens")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum(tokens).alias("bt"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        F.col("block").alias("b"),
        *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("bd", "bt")),
        *(F.sum(c).over(every).alias(f"{c}_all") for c in ("bd", "bt")),
    )
    within = Window.partitionBy("block").orderBy("n_tokens")
    return (
        hist.join(blocks, F.col("block") == F.col("b"))
        .withColumn("n_docs_le", F.col("bd_before") + F.sum("n_docs").over(within))
        .withColumn("tokens_le", F.col("bt_before") + F.sum(tokens).over(within))
        .withColumn("n_docs_ge", F.col("bd_all") - F.col("n_docs_le") + F.col("n_docs"))
        .withColumn("tokens_ge", F.col("bt_all") - F.col("tokens_le") + tokens)
        .select(
            "n_tokens", "n_docs", "n_docs_le", "n_docs_ge", "tokens_le", "tokens_ge",
            (F.col("tokens_le") + F.col("n_tokens") * (F.col("n_docs_ge") - F.col("n_docs"))).alias("truncated_total"),
            (F.col("n_docs_le") / F.col("bd_all")).alias("quantile"),
        )
    )


def answer(hist: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for any context limits: one row per limit, from the histogram alone.

    Columns ``context_limit``, ``n_docs_over`` (longer documents), ``total_tokens``
    and ``truncated_total``. An empty histogram answers 0.
    """
    row = hist.agg(
        F.sum(F.col("n_docs") * F.col("n_tokens")).alias("total"),
        *(F.sum(F.when(F.col("n_tokens") > x, F.col("n_docs"))).alias(f"o{i}") for i, x in enumerate(limits)),
        *(F.sum(F.col("n_docs") * F.least(F.col("n_tokens"), F.lit(int(x)))).alias(f"t{i}") for i, x in enumerate(limits)),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return row.select(
        F.explode(F.array(*(F.struct(F.lit(int(x)).cast("long").alias("context_limit"), zero(f"o{i}").alias("n_docs_over"), zero("total").alias("total_tokens"), zero(f"t{i}").alias("truncated_total")) for i, x in enumerate(limits)))).alias("a")
    ).select("a.*")


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The least length that at least ``q`` of the documents do not exceed (one row; null if empty)."""
    return hist.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
