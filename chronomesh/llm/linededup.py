"""Line dedup by a deletion-neighbourhood join (operator 7).

A line is dropped if an earlier line of the corpus is the same or, for lines that
are long enough, within the edit bound. Distinct lines that could have such a
neighbour are found first: two lines k edits apart agree in one of k + 1 parts.
Of those all variants with up to k characters deleted are emitted as hashed keys
and equal keys are joined. With one edit, lines with the same variant at the same
place differ by a substitution there, and a line equal to another's variant by an
insertion. With more, a key names the places of the edits too. Each group passes
on its earliest line only, so no group yields pairs; the distance to that line is
then verified on the texts.
"""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.llm.common import arrow_map, fresh, frugal, materialize, texts

#: Stands for a null document id in the order of lines: after all others.
LAST = (1 << 63) - 1
#: Frames of at most so many rows of a few numbers are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 300_000
#: What a line is known by, in the order of the corpus.
ME = ["doc", "hash", "line"]
_LINE = "h1 long, h2 long, doc long, hash long, line int"


def normal(line: str) -> str:
    """ASCII letters in lower case, runs of ASCII white space (9 to 13 and 32) as one space, none at the ends."""
    return b" ".join(line.encode().lower().split()).decode()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(line: str, edits: int) -> list[int]:
    """Keys of which two lines at most so many edits apart share one at least.

    The longer line of a pair, of length n, is cut into edits + 1 parts, one of
    which the other has too, moved by the edits before it at most.
    """
    keys, m, cut = set(), len(line), edits + 1
    for n in range(m, m + edits + 1):
        ends = [n * k // cut for k in range(cut + 1)]
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            moves = (0,) if k == 0 else (m - n,) if k == edits else range(-edits, edits + 1)
            for shift in moves:
                if 0 <= a + shift and b + shift <= m:
                    keys.add(_signed(xxhash.xxh3_64_intdigest(line[a + shift : b + shift].encode(), cut * n + k)))
    return sorted(keys)


def _lines(docs: DataFrame, key: str, text: str, near: int, edits: int) -> DataFrame:
    """One row per line that is not blank, and one (line -1, h1 the number of lines) per document."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for doc, mark, t in zip(batch.column("d").to_pylist(), batch.column("h").to_pylist(), texts(batch, "t")):
            doc = LAST if doc is None else doc
            lines = t.decode().split("\n") if t else []
            rows.append((len(lines), None, doc, mark, -1, None))
            for k, line in enumerate(lines):
                line = normal(line)
                if line:
                    h = xxhash.xxh3_128_intdigest(line.encode())
                    rows.append((_signed(h >> 64), _signed(h & ((1 << 64) - 1)), doc, mark, k, _parts(line, edits) if edits and len(line) >= near else None))
        return dict(zip(("h1", "h2", "doc", "hash", "line", "parts"), zip(*rows)))

    return arrow_map(docs.select(F.col(key).cast("long").alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("t")), run, f"{_LINE}, parts array<long>")


def _variants(line: str) -> np.ndarray:
    """128-bit polynomial hashes of the line (row 0) and of the line without its i-th character (row i + 1)."""
    codes = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    n, out = len(codes), []
    for base, seed in ((0x9E3779B97F4A7C15, 0x5851F42D4C957F2D), (0xC2B2AE3D27D4EB4F, 0x14057B7EF767814F)):
        mixed = (codes ^ np.uint64(seed)) * np.uint64(base)
        mixed ^= mixed >> np.uint64(31)
        powers = np.cumprod(np.full(n + 1, base, np.uint64))
        head = np.concatenate([[np.uint64(0)], np.cumsum(mixed * powers[:n])])  # sum of c_i * base^(i + 1)
        shifted = np.concatenate([[np.uint64(0)], np.cumsum(mixed[1:] * powers[: n - 1])])  # the same one place to the left
        rest = shifted[n - 1] - shifted[np.arange(n)]
        sums = np.concatenate([[head[n]], head[:n] + rest])
        sums = (sums ^ np.concatenate([[n], np.full(n, n - 1)]).astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        out.append(sums ^ (sums >> np.uint64(33)))
    return np.array(out).view(np.int64)


def _explode_variants(lines: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row, line in enumerate(batch.column("content").to_pylist()):
                v = _variants(line)
                for at in range(0, v.shape[1], 1 << 16):
                    n = min(1 << 16, v.shape[1] - at)
                    own = [pa.array(np.full(n, batch.column(c)[row].as_py(), np.int32 if c == "line" else np.int64)) for c in ("doc", "hash", "line")]
                    yield pa.RecordBatch.from_arrays([pa.array(v[0, at : at + n]), pa.array(v[1, at : at + n]), pa.array(np.arange(at - 1, at - 1 + n, dtype=np.int32)), *own], ["v1", "v2", "place", "doc", "hash", "line"])

    return lines.mapInArrow(frugal(run), "v1 long, v2 long, place int, doc long, hash long, line int")


def edit_keys(line: str, edits: int):
    """Keys that two lines share exactly if at most so many edits lead from one to the other.

    A line without the characters at some places is a variant; a key is a variant
    with a multiset of ``edits`` of its gaps that holds those of the deleted
    characters: in a gap that both lines have, an edit is a substitution.
    """
    m = len(line)
    for k in range(min(edits, m) + 1):
        for gone in combinations(range(m), k):
            left = "".join(c for i, c in enumerate(line) if i not in gone)
            gaps = [i - n for n, i in enumerate(gone)]
            for more in combinations_with_replacement(range(len(left) + 1), edits - k):
                yield xxhash.xxh3_128_digest(f"{sorted([*gaps, *more])}{left}".encode())


def _explode_keys(lines: DataFrame, edits: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row, line in enumerate(batch.column("content").to_pylist()):
                keys = iter(dict.fromkeys(edit_keys(line, edits)))
                while part := list(islice(keys, 1 << 16)):
                    v = np.frombuffer(b"".join(part), "<i8").reshape(-1, 2)
                    own = [pa.array(np.full(len(v), batch.column(c)[row].as_py(), np.int32 if c == "line" else np.int64)) for c in ("doc", "hash", "line")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v[:, 0])), pa.array(np.ascontiguousarray(v[:, 1])), *own], ["v1", "v2", "doc", "hash", "line"])

    return lines.mapInArrow(frugal(run), "v1 long, v2 long, doc long, hash long, line int")


def _contents(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """The normal texts of the lines (doc, hash, line) of ``wanted``."""
    per_doc = wanted.groupBy("doc", "hash").agg(F.collect_list("line").alias("nos"))  # at most a document's lines
    if wanted.count() <= BROADCAST_ROWS:
        per_doc = F.broadcast(per_doc)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("hash"), F.col(text).alias("t")).join(per_doc, ["doc", "hash"])

    def run(batch: pa.RecordBatch) -> dict:
        out = {"doc": [], "hash": [], "line": [], "content": []}
        for doc, mark, t, nos in zip(batch.column("doc").to_pylist(), batch.column("hash").to_pylist(), texts(batch, "t"), batch.column("nos").to_pylist()):
            lines = (t or b"").decode().split("\n")
            for no in nos:
                out["doc"].append(doc)
                out["hash"].append(mark)
                out["line"].append(no)
                out["content"].append(normal(lines[no]))
        return out

    found = arrow_map(rows, run, "doc long, hash long, line int, content string")
    return found.groupBy(*ME).agg(F.min("content").alias("content"))  # a repeated row gives its lines once


def _near(contents: DataFrame, edits: int) -> DataFrame:
    """(doc, hash, line, best): lines with the earliest line of one of their keys, where that is earlier."""
    me = F.struct(*ME)
    if edits == 1:
        variant = Window.partitionBy("v1", "v2")
        rows = (
            _explode_variants(contents)
            .withColumn("whole", F.min(F.when(F.col("place") < 0, me)).over(variant))
            .withColumn("cut", F.min(F.when(F.col("place") >= 0, me)).over(variant))
            .withColumn("same", F.min(me).over(Window.partitionBy("v1", "v2", "place")))
            .withColumn("best", F.when(F.col("place") < 0, F.col("cut")).otherwise(F.least("whole", "same")))
        )
    else:
        rows = _explode_keys(contents, edits).withColumn("best", F.min(me).over(Window.partitionBy("v1", "v2")))
    return rows.where(F.col("best") < me).select(*ME, *(F.col(f"best.{c}").alias(f"b{c}") for c in ME)).distinct()


def removed_lines(docs: DataFrame, max_edits: int = 1, near_chars: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc``, ``hash`` (xxhash64 of its text), ``n_lines`` and ``gone``, the numbers of its lines to drop.

    Lines are the ``\\n``-separated parts of a text, compared as :func:`normal`
    gives them; blank ones always stay. A line goes if an earlier one is the same
    or, where both have ``near_chars`` characters or more, at most ``max_edits``
    edits away, whether or not that one goes itself. The order is that of (id,
    hash, line number); null ids come last. Rows with one id and one text are one
    document; another text under the same id is a document of its own. A null
    text has no lines; an empty table gives no row.

    The keys of a line grow with its length to the power of ``max_edits``.
    """
    if max_edits < 0:
        raise ValueError("max_edits must not be negative")
    lines = materialize(_lines(docs, key, text, near_chars, max_edits), "lines")
    real = lines.where("line >= 0")
    distinct = real.groupBy("h1", "h2").agg(F.min(F.struct(*ME)).alias("first"), F.any_value("parts").alias("parts"))
    if max_edits:
        distinct = materialize(distinct, "distinct")
        keyed = distinct.where("parts is not null").select("first", F.explode("parts").alias("part"))
        shared = keyed.groupBy("part").count().where("count > 1").select("part")
        wanted = materialize(keyed.join(shared, "part").select("first.*").distinct(), "wanted")
        contents = materialize(_contents(docs, wanted, key, text), "contents")
        other = contents.select(*(F.col(c).alias(f"b{c}") for c in ME), F.col("content").alias("bcontent"))
        verified = (
            _near(contents, max_edits).join(contents, ME).join(other, [f"b{c}" for c in ME])
            .where(F.levenshtein("content", "bcontent", max_edits) >= 0)
            .select(F.struct(*ME).alias("first")).distinct().withColumn("near", F.lit(True))
        )
        firsts = distinct.select("h1", "h2", "first").join(verified, "first", "left")
    else:
        firsts = distinct.select("h1", "h2", "first").withColumn("near", F.lit(False))
    gone = (
        real.select("h1", "h2", *ME).join(firsts, ["h1", "h2"])
        .where(F.coalesce("near", F.lit(False)) | (F.col("first") < F.struct(*ME)))
        .groupBy("doc", "hash").agg(F.array_sort(F.collect_set("line")).alias("gone"))  # at most a document's lines
    )
    per_doc = lines.where("line < 0").groupBy("doc", "hash").agg(F.max("h1").alias("n_lines"))
    return per_doc.join(gone, ["doc", "hash"], "left").select("doc", "hash", "n_lines", F.coalesce("gone", F.expr("array()").cast("array<int>")).alias("gone"))


def digest(docs: DataFrame, max_edits: int = 1, near_chars: int = 10, key: str = "doc_id") -> DataFrame:
    """Per document (id and text): n_lines, n_removed and the removed lines' numbers (comma-joined)."""
    found = removed_lines(docs, max_edits, near_chars, key)
    return found.select(
        F.when(F.col("doc") != LAST, F.col("doc")).alias(key),
        F.col("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.concat_ws(",", F.transform("gone", lambda x: x.cast("string"))).alias("removed_lines"),
    )


def deduplicate(docs: DataFrame, max_edits: int = 1, near_chars: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated lines; every row and column stays, a text may become empty."""
    gone = materialize(removed_lines(docs, max_edits, near_chars, key, text).where("size(gone) > 0").select("doc", "hash", "gone"), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    base = list(docs.columns)
    column, of_doc, of_text = (fresh(docs, c) for c in ("gone_lines", "gone_doc", "gone_hash"))
    gone = gone.select(F.col("doc").alias(of_doc), F.col("hash").alias(of_text), F.col("gone").alias(column))
    own = (F.coalesce(docs[key].cast("long"), F.lit(LAST)) == F.col(of_doc)) & (F.xxhash64(docs[text]) == F.col(of_text))
    joined = docs.join(gone, own, "left").select(*(docs[c] for c in base), column)

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for t, nos in zip(texts(batch, text), batch.column(column).to_pylist()):
            if t is not None and nos:
                drop = set(nos)
                t = b"\n".join(x for k, x in enumerate(t.split(b"\n")) if k not in drop)
            out.append(t if t is None else t.decode())
        return {c: batch.column(c) for c in base} | {text: pa.array(out, pa.string())}

    return arrow_map(joined, run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
