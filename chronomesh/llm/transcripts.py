"""Transcript parsing by a hidden Markov model (operator 2).

The lines of a transcript are observations: the speaker marker they begin with,
their length and their last character. States are a role and whether the line
begins a turn. Viterbi recovers the most likely states, and turns are rendered
with canonical markers.

Lines are range-partitioned by conversation and place, so a conversation of any
size spreads over partitions. A partition sums up its part of a conversation as a
max-plus matrix; the driver chains these (two small matrices a partition), and
each partition then decodes its lines with the scores from before and behind.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.llm.common import arrow_map, materialize, partitions_for

ROLES = ("assistant", "system", "user")
#: Words that speakers are marked with (fixed values).
MARKERS = {
    "assistant": ("assistant", "ai", "bot", "model", "a"),
    "system": ("system", "instruction", "instructions", "sys"),
    "user": ("user", "human", "question", "customer", "q"),
}
#: Names of speakers that no marker tells, and beginnings of lines that are no speakers (fixed values).
PEOPLE = {"assistant": ("Mira", "Oleg"), "system": ("Desk", "Desk"), "user": ("Jonas", "Ines")}
MISLEADING = ("Note: ", "Question: ", "Example: ", "[Model] ")
_ROLE_OF = {w: ROLES.index(r) for r, words in MARKERS.items() for w in words}
_MARK = re.compile(r"\s*(?:#{1,6}\s*|<\|?|\[|\*\*)?(?P<w>[A-Za-z]{1,12})\s*(?:\|?>|\]|\*\*|:|>)+\s*")
_LENGTHS = (0, 20, 80, 200, 500)
#: Observation codes: marker (none, a role, other) x length x ends with a question mark.
CODES = (len(ROLES) + 2) * (len(_LENGTHS) + 1) * 2
STATES = 2 * len(ROLES)
_LINE = "conv long, turn long, tag long, line_no int, line string, role string, code int"
_NONE = -1e18


def split_marker(line: str) -> tuple[int, str]:
    """(0 no marker, 1.. role, last other marker; the line without it)."""
    m = _MARK.match(line)
    if not m:
        return 0, line
    word = m["w"].lower()
    return (_ROLE_OF[word] + 1, line[m.end() :]) if word in _ROLE_OF else (len(ROLES) + 1, line)


def observe(line: str) -> int:
    marker, rest = split_marker(line)
    length = sum(len(rest) > x for x in _LENGTHS)
    return (marker * (len(_LENGTHS) + 1) + length) * 2 + rest.rstrip().endswith("?")


def transcript_lines(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of a table (conv_id, turn, role, text), line by line.

    Turns begin with a marker in the conversation's own style; about a quarter,
    by a hash of conversation and turn, have none. In one conversation of eight
    speakers go by names that say nothing of their role, and one further line in
    sixteen begins with a word that looks like a marker. Rows without conversation or
    turn are left out, a null text is one empty line, repeated rows count once.
    """
    styles = ("{}: ", "### {}: ", "<|{}|> ", "[{}] ", "**{}:** ")

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text"))):
            k = zlib.crc32(str(conv).encode())
            names = MARKERS.get(role or "", (role or "",)) if k // 1000 % 8 else PEOPLE.get(role or "", (role or "",))
            tag = zlib.crc32(f"{role}\x00{text}".encode())
            marked = bool(role) and zlib.crc32(f"{conv}|{turn}".encode()) % 4
            for n, line in enumerate((text or "").split("\n")):
                if n == 0 and marked:
                    line = styles[k % len(styles)].format(names[k // 7 % min(2, len(names))].capitalize()) + line
                elif n and zlib.crc32(f"{conv}|{turn}|{n}".encode()) % 16 == 0:
                    line = MISLEADING[k % len(MISLEADING)] + line
                out.append((conv, turn, tag, n, line, role, observe(line)))
        return dict(zip(("conv", "turn", "tag", "line_no", "line", "role", "code"), zip(*out)))

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return arrow_map(rows.where("conv is not null and turn is not null").distinct(), run, _LINE)


class Hmm:
    """Log probabilities: start (S), move (S, S), emit (CODES, S)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        def log(x: np.ndarray, axis: int) -> np.ndarray:
            x = x + 0.5
            return np.log(x / x.sum(axis=axis, keepdims=True))

        start = start.astype(float)
        self.start, self.move, self.emit = log(start, 0), log(move, 1), log(emit, 0)
        self.start[1::2] += -20  # a conversation begins with the first line of a turn
        inside = np.arange(1, STATES, 2)
        for s in range(STATES):
            for t in inside:
                if s // 2 != t // 2:
                    self.move[s, t] = -50.0  # only a turn of the same role goes on

    def product(self, codes: np.ndarray) -> np.ndarray:
        """Best scores from each state before the lines to each state at their end."""
        m = np.where(np.eye(STATES, dtype=bool), 0.0, _NONE)
        for c in codes.tolist():
            m = (m[:, :, None] + self.move[None]).max(axis=1) + self.emit[c]
        return m

    def forward(self, codes: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(scores at the end, back pointers); ``before`` is None at the start of a conversation."""
        back = np.zeros((len(codes), STATES), np.int8)
        v = before
        for i, c in enumerate(codes.tolist()):
            if v is None:
                v = self.start + self.emit[c]
            else:
                s = v[:, None] + self.move
                back[i] = s.argmax(axis=0)
                v = s.max(axis=0) + self.emit[c]
        return v, back

    def decode(self, codes: np.ndarray, before: np.ndarray | None, behind: np.ndarray | None) -> np.ndarray:
        v, back = self.forward(codes, before)
        state = int((v if behind is None else v + behind).argmax())
        out = np.zeros(len(codes), np.int8)
        for i in range(len(codes) - 1, -1, -1):
            out[i] = state
            state = int(back[i][state])
        return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, dict]]:
    """(part, conversation, columns) of the runs of lines of one conversation in one part."""
    held: list[pa.RecordBatch] = []

    def close() -> tuple[int, int, dict]:
        table = pa.Table.from_batches(held)
        return table["part"][0].as_py(), table["conv"][0].as_py(), {c: table[c] for c in table.column_names}

    for batch in batches:
        key = list(zip(batch.column("part").to_pylist(), batch.column("conv").to_pylist()))
        cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            if held and (held[-1].column("part")[-1].as_py(), held[-1].column("conv")[-1].as_py()) != key[a]:
                yield close()
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield close()


def _ordered(lines: DataFrame) -> DataFrame:
    """The lines in order, with the number of their part and of their place in it, in the shared folder."""
    order = ["conv", "turn", "tag", "line_no"]
    parts = partitions_for(lines.sparkSession)
    sorted_lines = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(sorted_lines.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "lines")


def _in_parts(ordered: DataFrame, *columns: str) -> DataFrame:
    """Part and some columns of the lines, each part in a partition of its own, in order."""
    parts = partitions_for(ordered.sparkSession)
    return ordered.select("part", "place", *columns).repartitionById(parts, "part").sortWithinPartitions("part", "place")


def _ends(ordered: DataFrame) -> dict[int, tuple[int, int, bool]]:
    """Per part: its first and last conversation, and whether the first begins there. One row a part comes to the driver."""
    found = ordered.groupBy("part").agg(F.min_by("conv", "place").alias("first"), F.max_by("conv", "place").alias("last")).collect()
    out, before = {}, None
    for part, first, last in sorted(map(tuple, found)):
        out[part] = (first, last, first != before)
        before = last
    return out


def fit(ordered: DataFrame, ends: dict[int, tuple[int, int, bool]]) -> Hmm:
    """Counts over all labelled lines of conversations whose crc32, as text, leaves a rest other than 1 when divided by 3.

    A conversation starts with its first line, whatever its turn's number; lines
    without a known role count for nothing and part those around them.
    """
    role = F.coalesce(*(F.when(F.col("role") == r, F.lit(k)) for k, r in enumerate(ROLES)), F.lit(-1))
    learn = ordered.where(F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(3)) != 1).withColumn("state", F.when(role < 0, -1).otherwise(2 * role + (F.col("line_no") > 0).cast("int")))
    shared = ordered.sparkSession.sparkContext.broadcast(ends)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CODES, STATES))
        for part, conv, run in _runs(batches):
            state, codes = run["state"].to_numpy(), run["code"].to_numpy()
            first, _, begins = shared.value[part]
            if (conv != first or begins) and state[0] >= 0 and state[0] % 2 == 0:
                start[state[0]] += 1
            both, own = (state[:-1] >= 0) & (state[1:] >= 0), state >= 0
            np.add.at(move, (state[:-1][both], state[1:][both]), 1)
            np.add.at(emit, (codes[own], state[own]), 1)
        rows = [(k, int(i), int(n[i])) for k, n in enumerate((start, move.ravel(), emit.ravel())) for i in np.flatnonzero(n)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ([], [], []))], ["kind", "i", "n"])

    found = _in_parts(learn, "conv", "state", "code").mapInArrow(count, "kind long, i long, n long").groupBy("kind", "i").agg(F.sum("n").alias("n"))
    tables = [np.zeros(STATES), np.zeros(STATES * STATES), np.zeros(CODES * STATES)]
    for kind, i, n in found.collect():  # at most CODES * STATES + STATES * (STATES + 1) rows
        tables[kind][i] = n
    return Hmm(tables[0], tables[1].reshape(STATES, STATES), tables[2].reshape(CODES, STATES))


def _chain(parts: list[dict], hmm: Hmm) -> dict[int, tuple[np.ndarray | None, np.ndarray | None]]:
    """For each part: scores before its first run and behind its last (None: the conversation starts or ends there)."""
    parts = sorted(parts, key=lambda r: r["part"])
    before: list = [None] * len(parts)
    behind: list = [None] * len(parts)
    for k in range(1, len(parts)):
        p, q = parts[k - 1], parts[k]
        if p["last"] == q["first"]:
            if p["runs"] == 1:
                head = np.array(p["head"]).reshape(STATES, STATES)
                before[k] = np.array(p["alone"]) if before[k - 1] is None else (before[k - 1][:, None] + head).max(axis=0)
            else:
                before[k] = np.array(p["tail"])
    for k in range(len(parts) - 2, -1, -1):
        p, q = parts[k], parts[k + 1]
        if p["last"] == q["first"]:
            head = np.array(q["head"]).reshape(STATES, STATES)
            behind[k] = (head + (behind[k + 1] if q["runs"] == 1 and behind[k + 1] is not None else 0.0)).max(axis=1)
    return {r["part"]: (before[k], behind[k]) for k, r in enumerate(parts)}


def parse(lines: DataFrame) -> DataFrame:
    """Recover roles and turns of transcripts given as lines (conv, turn, tag, line_no, line, role, code).

    ``code`` is :func:`observe` of the line; ``role`` is used for learning only. Per line: conv, turn, line_no, role,
    role_pred, begins (whether a turn begins here), rendered: the line without its
    marker, after ``<|role|>`` on a line of its own where a turn begins. An empty
    table gives no row; with nothing to learn from all states are alike.
    """
    ordered = _ordered(lines)
    begin_end = _ends(ordered)
    hmm = fit(ordered, begin_end)
    shared = ordered.sparkSession.sparkContext.broadcast(hmm)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, now = shared.value, None
        for part, conv, run in _runs(batches):
            codes = run["code"].to_numpy()
            if now is None or now["part"] != part:
                if now is not None:
                    yield pa.RecordBatch.from_pylist([now])
                now = {"part": part, "first": conv, "runs": 0, "head": model.product(codes).ravel().tolist(), "alone": model.forward(codes, None)[0].tolist()}
            now["last"], now["runs"] = conv, now["runs"] + 1
            now["tail"] = model.forward(codes, None)[0].tolist()
        if now is not None:
            yield pa.RecordBatch.from_pylist([now])

    fields = "part int, first long, last long, runs long, head array<double>, alone array<double>, tail array<double>"

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in summary(batches):
            yield b.select(["part", "first", "last", "runs", "head", "alone", "tail"]).set_column(0, "part", b.column("part").cast(pa.int32()))

    found = [r.asDict() for r in _in_parts(ordered, "conv", "code").mapInArrow(tidy, fields).collect()]  # one row a part
    edges = ordered.sparkSession.sparkContext.broadcast(_chain(found, hmm))
    ends = ordered.sparkSession.sparkContext.broadcast(begin_end)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, conv, run in _runs(batches):
            first, last, _ = ends.value[part]
            before, behind = edges.value[part]
            text = [x or "" for x in run["line"].to_pylist()]
            state = model.decode(run["code"].to_numpy(), before if conv == first else None, behind if conv == last else None)
            roles = [ROLES[s // 2] for s in state]
            begins = [s % 2 == 0 for s in state]
            rendered = [f"<|{r}|>\n{split_marker(x)[1]}" if b else x for r, b, x in zip(roles, begins, text)]
            for at in range(0, len(text), 10_000):
                cut = slice(at, at + 10_000)
                own = {c: run[c].slice(at, 10_000).combine_chunks() for c in ("conv", "turn", "line_no", "role")}
                own = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in own.items()}
                yield pa.RecordBatch.from_arrays([*own.values(), pa.array(roles[cut]), pa.array(begins[cut]), pa.array(rendered[cut])], [*own, "role_pred", "begins", "rendered"])

    return _in_parts(ordered, "conv", "turn", "line_no", "line", "role", "code").mapInArrow(decode, "conv long, turn long, line_no int, role string, role_pred string, begins boolean, rendered string")


def digest(conversations: DataFrame) -> DataFrame:
    """Every line of the conversations' transcripts with its recovered role and canonical rendering.

    Columns beside conv_id, turn, role and text are not read. Rows without
    conversation or turn give no line, a null text is one empty line, a null or
    unknown role is not learnt from, repeated rows count once; turns that share a
    number are ordered by a hash; an empty table gives no row.
    """
    found = parse(transcript_lines(conversations))
    held = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(3)) == 1
    return found.select(F.col("conv").alias("conv_id"), "turn", "line_no", held.alias("held_out"), "role", "role_pred", "begins", "rendered")
