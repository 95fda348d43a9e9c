"""The operators against brute force; edge cases: nulls, empty tables, repeated rows, clashing names."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from chronomesh.llm import decontaminate, langid, linededup, lmscore, packing, quality, simhash, substring, tokens, transcripts
from chronomesh.llm.components import connected_components
from chronomesh.llm.queries import tokenizer_path

WS = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: t.encode().lower().decode()


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# -- operator 1 ---------------------------------------------------------------
def base_of(text):
    words = WS.findall(text or "")
    tri = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WS.search(x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def test_quality_base(table, corpus):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    more = [*corpus, (50, "a b c a b c a b a"), (51, "#x #x\n#x #x\n \n %& <>|")]
    assert rows(quality.digest(table(more)), *names) == sorted(((d, *base_of(t)) for d, t in more), key=repr)
    assert quality.digest(table([])).count() == 0


def test_quality_verdict(table):
    """Clean documents are kept, symbols in place of prose are not, without labels nothing is judged."""
    import random

    r = random.Random(1)
    english = ["the", "and", "of", "to", "in", "is", "that", "window", "table", "river", "green", "stone", "paper", "walks", "under"]
    clean = [(k, ". ".join(" ".join(r.choice(english) for _ in range(8)).capitalize() for _ in range(25)) + ".", "en") for k in range(30)]
    junk = [(100, " ".join(r.choice(english) + "$$$%%%" for _ in range(200)), "en")]
    got = {x.doc_id: x.kept for x in quality.digest(table(clean + junk)).collect()}
    assert all(got[d] for d, *_ in clean) and not got[100]
    assert all(x.kept for x in quality.digest(table([(k, t) for k, t, _ in clean])).collect())


# -- operator 2 ---------------------------------------------------------------
def _conversations(spark, n=60):
    import random

    r = random.Random(4)
    out = []
    for c in range(n):
        for t in range(r.randint(2, 8)):
            role = "user" if t % 2 == 0 else "assistant"
            text = "why is it so?" if role == "user" else "\n".join(" ".join(["because of that"] * 9) for _ in range(r.randint(1, 3)))
            out.append((c, t, role, text))
    return spark.createDataFrame([*out, out[0], (None, 1, "user", "x"), (900, 0, None, None)], "conv_id long, turn long, role string, text string")


def test_transcripts(spark):
    df = _conversations(spark)
    got = transcripts.digest(df).collect()
    labelled = [x for x in got if x.role is not None]
    assert len(got) == len(labelled) + 1
    held = [x for x in labelled if x.held_out]
    assert sum(x.role == x.role_pred for x in held) / len(held) > 0.9
    assert all(x.rendered.startswith(f"<|{x.role_pred}|>\n") == x.begins for x in got)
    want = sorted(map(tuple, got))
    spark.conf.set("spark.sql.shuffle.partitions", "13")  # conversations cut elsewhere decode alike
    try:
        assert sorted(map(tuple, transcripts.digest(df).collect()), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert transcripts.digest(df.limit(0)).count() == 0


def slow_parse(lines, held):
    """Counts and Viterbi of whole conversations in plain Python: (conv, turn, line_no) -> (role, begins)."""
    n, roles = transcripts.STATES, transcripts.ROLES
    start, move, emit = [0.5] * n, [[0.5] * n for _ in range(n)], [[0.5] * n for _ in range(transcripts.CODES)]
    convs = defaultdict(list)
    for x in sorted(lines, key=lambda x: (x.conv, x.turn, x.tag, x.line_no)):
        convs[x.conv].append(x)
    state = lambda x: 2 * roles.index(x.role) + (x.line_no > 0) if x.role in roles else None
    for c, xs in convs.items():
        if held(c):
            continue
        if state(xs[0]) is not None and state(xs[0]) % 2 == 0:
            start[state(xs[0])] += 1
        for a, b in zip(xs, xs[1:]):
            if None not in (state(a), state(b)):
                move[state(a)][state(b)] += 1
        for x in xs:
            if state(x) is not None:
                emit[transcripts.observe(x.line)][state(x)] += 1
    ls = [math.log(x / sum(start)) - 20 * (s % 2) for s, x in enumerate(start)]
    lm = [[-50.0 if t % 2 and s // 2 != t // 2 else math.log(move[s][t] / sum(move[s])) for t in range(n)] for s in range(n)]
    le = [[math.log(row[s] / sum(r[s] for r in emit)) for s in range(n)] for row in emit]
    out = {}
    for c, xs in convs.items():
        v, back = [ls[s] + le[transcripts.observe(xs[0].line)][s] for s in range(n)], []
        for x in xs[1:]:
            best = [max(range(n), key=lambda s: (v[s] + lm[s][t], -s)) for t in range(n)]
            v = [v[best[t]] + lm[best[t]][t] + le[transcripts.observe(x.line)][t] for t in range(n)]
            back.append(best)
        s = max(range(n), key=lambda s: (v[s], -s))
        path = [s]
        for best in reversed(back):
            path.append(s := best[s])
        for x, s in zip(xs, reversed(path)):
            out[x.conv, x.turn, x.tag, x.line_no] = (roles[s // 2], s % 2 == 0, f"<|{roles[s // 2]}|>\n" + transcripts.split_marker(x.line)[1] if s % 2 == 0 else x.line)
    return out


def test_transcripts_by_brute_force(spark, prose):
    """Roles, begins and rendering of whole conversations, whatever the parts; turns from 1, foreign markers, clashing columns, a very long text."""
    from pyspark.sql import functions as F

    rows_ = [(r.conv_id, (r.turn or 0) + 1, r.role, r.text) for r in _conversations(spark, 40).collect()]
    rows_ += [(300, 1, "user", prose(1, 3000)), (300, 2, "assistant", "\n".join(prose(k, 30) for k in range(400))), (301, 1, "narrator", "once upon a time"), (301, 2, "user", "and then?"), (301, 2, "user", "Bob: and then?"), (302, 1, "assistant", "")]
    df = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as part", "2 as place", "'y' as code", "'z' as conv", "1 as line_no")
    lines = transcripts.transcript_lines(df).collect()
    want = slow_parse(lines, lambda c: zlib.crc32(str(c).encode()) % 3 == 1)
    assert len(lines) > 600 and any(x.line.startswith(("Note: ", "Question: ", "Example: ", "[Model] ")) for x in lines)
    for parts in ("4", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = transcripts.digest(df).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        key = lambda c, t, n: (c, t, n)
        assert sorted((key(x.conv_id, x.turn, x.line_no), x.role_pred, x.begins, x.rendered) for x in got) == sorted((key(c, t, n), *v) for (c, t, _, n), v in want.items())


def test_viterbi_over_cuts():
    """Matrices of parts chain to the decoding of the whole."""
    r = np.random.default_rng(1)
    hmm = transcripts.Hmm(r.random(transcripts.STATES), r.random((transcripts.STATES,) * 2), r.random((transcripts.CODES, transcripts.STATES)))
    codes = r.integers(0, transcripts.CODES, 40)
    whole = hmm.decode(codes, None, None)
    parts = [codes[:7], codes[7:19], codes[19:20], codes[20:]]
    found = [{"part": k, "first": 5, "last": 5, "runs": 1, "head": hmm.product(p).ravel().tolist(), "alone": hmm.forward(p, None)[0].tolist(), "tail": hmm.forward(p, None)[0].tolist()} for k, p in enumerate(parts)]
    edges = transcripts._chain(found, hmm)
    assert np.concatenate([hmm.decode(p, *edges[k]) for k, p in enumerate(parts)]).tolist() == whole.tolist()
    score = lambda s: hmm.start[s[0]] + sum(hmm.emit[c, x] for c, x in zip(codes[:3], s)) + sum(hmm.move[a, b] for a, b in zip(s, s[1:]))
    n = transcripts.STATES
    best = max(((a, b, c) for a in range(n) for b in range(n) for c in range(n)), key=score)
    assert tuple(hmm.decode(codes[:3], None, None)) == best


# -- operator 3 ---------------------------------------------------------------
WORDS = {"en": "the and of that with thing ouing ered", "de": "der und das nicht keit ung schen über", "fr": "le les des que ment eau tion été", "es": "el los del que ción mente ado niño"}


def test_language(table):
    import random

    r = random.Random(2)
    docs = [(k, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(5, 60))), lang) for k, lang in enumerate(list(WORDS) * 40)]
    odd = [(900, None), (901, "12 34 !!"), (902, ""), (None, docs[0][1])]
    got = {x.doc_id: x for x in langid.digest(table(docs + odd)).collect()}
    assert len(got) == len(docs) + 4
    held = [(got[d], lang) for d, _, lang in docs if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(x.held_out for x, _ in held) and sum(x.lang_pred == lang for x, lang in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 for x in got.values())
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[None].lang_pred == docs[0][2]
    kept = langid.keep_known(table(docs + odd))
    assert kept.columns == table([]).columns and {d for d, *_ in docs} <= {x.doc_id for x in kept.collect()} and kept.where("doc_id >= 900").count() == 0
    assert langid.digest(table([])).count() == 0
    assert {x.lang_pred for x in langid.digest(table([(1, "abc"), (2, "def")])).collect()} == {"und"}  # nothing to learn from
    assert {x.lang_pred for x in langid.digest(table([(k, "abc", "xx") for k in range(6)])).collect()} == {"xx"}


def test_language_filter(table, prose, spark):
    """Text of no learnt language goes, clean text stays; columns with the filter's own names stay."""
    import random

    r = random.Random(3)
    docs = [(k, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(20, 60))), lang) for k, lang in enumerate(list(WORDS) * 40)]
    bad = [(900, " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(50))), (901, "Все люди рождаются свободными и равными в своем достоинстве и правах"), (902, None), (903, "!!! 123")]
    df = table(docs + bad).selectExpr("*", "'mine' as lang_of_filter", "'own' as score_of_filter", "1 as untypical_of_filter")
    kept = langid.keep_known(df).collect()
    assert {x.doc_id for x in kept} == {d for d, *_ in docs} and {(x.lang_of_filter, x.score_of_filter, x.untypical_of_filter) for x in kept} == {("mine", "own", 1)}
    assert langid.keep_known(table([(1, "abc"), (2, "def")])).count() == 0 and langid.keep_known(table([])).count() == 0


def test_language_votes():
    """Most duels, then the larger sum of chances, then the first name: by brute force over all classes."""
    r = np.random.default_rng(5)
    for _ in range(200):
        n = int(r.integers(1, 6))
        names = [f"l{k}" for k in range(n)]
        margin = {(a, b): float(r.choice([-1.0, -0.2, 0.0, 0.2, 1.0])) for a in range(n) for b in range(a + 1, n)}
        duels = [(a, b, np.zeros(3, np.float32), m) for (a, b), m in margin.items()]
        chance = {}
        for (a, b), m in margin.items():
            chance[a, b] = 1 / (1 + math.exp(-4 * m))
            chance[b, a] = 1 - chance[a, b]
        wins = lambda k: sum((m >= 0) if a == k else (m < 0) for (a, b), m in margin.items() if k in (a, b))
        worth = lambda k: (wins(k), round(sum(chance[k, j] for j in range(n) if j != k), 9))
        got, score = langid.Model._vote((names, duels), np.ones(3, np.float32))
        k = names.index(got)
        assert worth(k) == max(map(worth, range(n))) and abs(score - min([chance[k, j] for j in range(n) if j != k], default=1.0)) < 1e-9


def test_svm_reaches_the_least_objective():
    """Against plain subgradient-free descent run far longer."""
    r = np.random.default_rng(7)
    x = np.vstack([r.normal(0.3, 1, (40, 6)), r.normal(-0.3, 1, (25, 6))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([1] * 40 + [-1] * 25, np.float32)
    weight = np.where(y > 0, 0.5 / 40, 0.5 / 25)
    x1 = np.hstack([x, np.ones((65, 1))])
    objective = lambda w: 0.5 * w @ w + 10 * (weight * np.maximum(0, 1 - y * (x1 @ w)) ** 2).sum()
    w = np.zeros(7)
    for _ in range(20_000):
        w -= 0.01 * (w - 20 * (x1.T @ (weight * y * np.maximum(0, 1 - y * (x1 @ w)))))
    mine, bias = langid.fit_svm(x, y)
    assert objective(np.append(mine, bias)) <= objective(w) * 1.01


# -- operator 4 ---------------------------------------------------------------
def test_scores(table, corpus):
    df = table(corpus)
    got = lmscore.digest(df).collect()
    text = [(d, WS.findall(lower(t or "")) + [""]) for d, t in corpus]
    rest = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 7
    counts = Counter(w for d, ws in text if d is not None and rest(d) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d, rest(d) == 2, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in text), key=repr)
    assert sorted(((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got), key=repr) == want
    assert all(x.score < 0 for x in got)
    far = lmscore.digest(df, max_broadcast=0).collect()  # by lookups at the shards
    key = lambda x: repr((x.doc_id, x.n_tokens, round(x.score, 6)))
    assert sorted(map(key, got)) == sorted(map(key, far))
    assert lmscore.digest(table([])).count() == 0


def test_filter_levels():
    """Levels that were put in are found; few others are."""
    r = np.random.default_rng(3)
    h = r.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    own, want = np.sort(h[:2000]), lmscore.quantise(r.integers(1, 1000, 2000))
    bits = int(want.sum()) * lmscore.ENTRY_BITS // 8 * 8
    grid = lmscore.Filter(lmscore.fill_segment(own, want.astype(np.uint8), bits), 1, bits)
    level = grid.levels(own)
    assert (level >= want).all() and (level > want).mean() < 0.02
    assert (grid.levels(h[2000:]) > 0).mean() < 0.02


# -- operators 5 and 9 ----------------------------------------------------------
def test_encoder_equals_the_tokenizer(prose):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    t, mine = Tokenizer.from_file(path), tokens.WordEncoder(path)
    odd = ["", " ", "a\xa0b it's <|endoftext|>x   y\x85z\x1cq", "İ ΑΣ ΟΔΟΣ", "é ́x ét", "x\x1f\x1ey", "日本 ｶﾞ 12³½ ª", "don't 'S we'LL", "​q Å", prose(1, 500)]
    for text in odd:
        assert mine.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids and mine.length(text) == len(mine.ids(text)), text


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_encoder_on_any_text(text):
    mine = tokens.encoder_for(tokenizer_path())
    text = text.encode("utf-8", "ignore").decode()
    assert mine.ids(text).tolist() == mine.tokenizer.encode(text, add_special_tokens=False).ids


def test_histogram(table, corpus):
    mine = tokens.encoder_for(tokenizer_path())
    lengths = [mine.length(t) for _, t in corpus]
    hist = tokens.length_histogram(table(corpus), tokenizer_path())
    got = hist.collect()
    assert {x.n_tokens: x.n_docs for x in got} == Counter(lengths)
    for x in got:
        assert x.n_docs_le == sum(n <= x.n_tokens for n in lengths) and x.n_docs_ge == sum(n >= x.n_tokens for n in lengths)
        assert x.tokens_le == sum(n for n in lengths if n <= x.n_tokens) and x.tokens_ge == sum(n for n in lengths if n >= x.n_tokens)
        assert x.truncated_total == sum(min(n, x.n_tokens) for n in lengths) and abs(x.quantile - x.n_docs_le / len(lengths)) < 1e-12
    for x in tokens.answer(hist, [0, 5, 100, 10**6]).collect():
        assert x.truncated_total == sum(min(n, x.context_limit) for n in lengths) and x.n_docs_over == sum(n > x.context_limit for n in lengths)
    assert tokens.quantile(hist, 0.5).first()[0] == sorted(lengths)[-(-len(lengths) // 2) - 1]
    empty = tokens.length_histogram(table([]), tokenizer_path())
    assert empty.count() == 0 and tokens.answer(empty, [7]).first().total_tokens == 0


def slow_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, room in enumerate(bins) if room >= n]
        k = min(fit, key=lambda k: bins[k]) if fit else len(bins)
        if not fit:
            bins.append(capacity)
        bins[k] -= n
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    plan = packing.best_fit_plan(Counter(lengths), 40)
    used = defaultdict(list)
    for n, rank, count, first, per, offset in plan:
        for j in range(count):
            used[first + j // per].append((offset + j % per * n, n))
    assert sorted(n for b in used.values() for _, n in b) == sorted(lengths)
    for b in used.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 40
    assert sorted(40 - sum(n for _, n in b) for b in used.values()) == sorted(slow_best_fit(lengths, 40))


def test_packing(table, corpus, prose):
    more = [*corpus, (60, prose(60, 9000))]
    got = packing.best_fit_pack(table(more), tokenizer_path(), capacity=512, with_ids=True).collect()
    t = tokens.encoder_for(tokenizer_path())
    want = []
    for d, text in more:
        ids = [*t.ids(text).tolist(), 0]
        want += [(d, k, a, len(ids[a : a + 512]), zlib.crc32(np.array(ids[a : a + 512], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 512))]
    assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for x in got:
        assert len(x.ids) == x.length
        bins[x.sequence_id].append((x.offset, x.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 512
    assert len(bins) == len(slow_best_fit([x.length for x in got], 512))
    assert packing.best_fit_pack(table([]), tokenizer_path()).count() == 0


# -- operator 6 ---------------------------------------------------------------
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_scan(text, items):
    words = NORMAL.findall(lower(text or ""))
    hit, found = set(), set()
    for name, item in items:
        iw = NORMAL.findall(lower(item or ""))
        k = min(8, len(iw))
        windows = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(str(name))
    ids = sorted(found)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(ids) >= 2


@pytest.mark.parametrize("block", [64 << 20, 300])
def test_decontaminate(spark, table, corpus, prose, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [(1, prose(0, 60)), (2, "A, b C!"), (3, prose(500, 20)), (10, prose(99, 12)), (4, None), (5, "..."), (2, "other text of the item with many words in it here"), (7, prose(99, 40)), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    real = [(k, t) for k, t in items if k is not None]
    got = rows(decontaminate.digest(table(corpus), bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(((d, *slow_scan(t, real)) for d, t in corpus), key=repr)
    out = decontaminate.decontaminate(table(corpus), bench)
    left = {x.doc_id: x.text for x in out.collect()}
    assert out.columns == table([]).columns and 23 not in left and left[29] == "" and left[4] == corpus[4][1]
    assert decontaminate.digest(table(corpus), bench.limit(0)).where("n_items > 0").count() == 0
    assert decontaminate.decontaminate(table([]), bench).count() == 0


# -- operator 7 ---------------------------------------------------------------
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def slow_lines(docs, near=10, edits=1):
    seen, out = set(), []
    for d, text in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = text.split("\n") if text else []
        gone = []
        for k, line in enumerate(lines):
            line = re.sub("[\x09-\x0d ]+", " ", lower(line)).strip(" ")
            if line:
                if line in seen or len(line) >= near and any(len(s) >= near and abs(len(s) - len(line)) <= edits and distance(line, s) <= edits for s in seen):
                    gone.append(k)
                seen.add(line)
        out.append((d, len(lines), len(gone), ",".join(map(str, gone))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("edits", [1, 2])
def test_lines(table, edits):
    import random

    r = random.Random(6)
    lines = ["".join(r.choice("ab ") for _ in range(r.randint(8, 14))) for _ in range(60)] + ["the quick brown fox", "the quick brown fix", "the quick  Brown fox ", "the quick brown foxx", "he quick brown fox", "the quack brown fix", "short", "shart"]
    lines += ["le prix\u202fest\xa0grand\u3000ici", "le prix est grand ici", "le prix \x0best grand ici", "", " "]
    docs = [(k, "\n".join(r.choice(lines) for _ in range(r.randint(1, 6)))) for k in range(40)] + [(90, None), (91, ""), (92, "\n\n"), (None, "the quick brown fox\nsomething else entirely")]
    want = slow_lines(docs, edits=edits)
    assert rows(linededup.digest(table(docs), edits), "doc_id", "n_lines", "n_removed", "removed_lines") == want
    out = {x.doc_id: x.text for x in linededup.deduplicate(table(docs), edits).collect()}
    gone = {d: set(map(int, g.split(","))) if g else set() for d, _, _, g in want}
    assert out == {d: t if not t else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in docs}


def test_lines_of_odd_rows(table, spark, prose):
    twice = [(1, "a line that is here"), (1, "a line that is here"), (2, "a line that is here!")]
    assert rows(linededup.digest(table(twice)), "doc_id", "n_removed") == [(1, 0), (2, 1)]
    assert linededup.digest(table([])).count() == 0 and linededup.deduplicate(table([])).count() == 0
    exact = rows(linededup.digest(table(twice), max_edits=0), "doc_id", "n_removed")
    assert exact == [(1, 0), (2, 0)]
    other = [(1, "first line of one\nshared line of both"), (1, "first line of two\nanother line of it"), (1, "shared line of both"), (2, "another line of it")]
    left = sorted(x.text for x in linededup.deduplicate(table(other), max_edits=0).collect())
    assert sorted(x for t in left for x in t.split("\n") if x) == sorted({x for _, t in other for x in t.split("\n")})
    named = spark.createDataFrame([(1, "one and the same line", "kept"), (2, "one and the same line", "kept")], "doc_id long, text string, gone_lines_of string").withColumnsRenamed({"gone_lines_of": "gone_lines"}).selectExpr("*", "gone_lines as gone_doc", "'x' as gone_hash", "gone_lines as gone_lines_of")
    assert sorted(map(tuple, linededup.deduplicate(named).collect())) == [(1, "one and the same line", "kept", "kept", "x", "kept"), (2, "", "kept", "kept", "x", "kept")]
    long = prose(5, 8000)
    assert rows(linededup.digest(table([(1, long), (2, long[:9000] + "x" + long[9000:]), (3, long[:9000] + "xyz" + long[9000:])])), "doc_id", "n_removed") == [(1, 0), (2, 1), (3, 0)]


@settings(max_examples=150, deadline=None)
@given(st.text("ab", min_size=1, max_size=9), st.text("ab", min_size=1, max_size=9))
def test_line_keys_lose_no_pair(a, b):
    va, vb = linededup._variants(a), linededup._variants(b)
    same = {tuple(x) + (i,) for i, x in enumerate(va.T[1:])} & {tuple(x) + (i,) for i, x in enumerate(vb.T[1:])}
    whole = tuple(va.T[0]) in set(map(tuple, vb.T)) or tuple(vb.T[0]) in set(map(tuple, va.T))
    assert bool(same or whole) == (distance(a, b) <= 1)
    for edits in (1, 2, 3):
        if edits < 3:
            assert bool(set(linededup.edit_keys(a, edits)) & set(linededup.edit_keys(b, edits))) == (distance(a, b) <= edits)
        if distance(a, b) <= edits:
            assert set(linededup._parts(a, edits)) & set(linededup._parts(b, edits))


# -- operator 8 ---------------------------------------------------------------
def slow_substrings(docs, length):
    seen, out, order = set(), {}, {}
    for d, text in sorted(set(docs), key=lambda r: (r[0] is None, r[0] or 0)):
        b = (text or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                mark[p : p + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(x for x, m in zip(b, mark) if not m)
        order[(d, text)] = (d, len(b), sum(mark), sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark)), hashlib.sha256(kept).hexdigest())
    return sorted((order[r] for r in docs), key=repr)


@pytest.mark.parametrize("hot, flush", [(10**9, 300_000), (1, 300_000), (1, 40), (3, 40)])
def test_substrings(table, corpus, prose, monkeypatch, hot, flush):
    monkeypatch.setattr(substring, "HOT_RUNS", hot)
    monkeypatch.setattr(substring, "FLUSH_ROWS", flush)
    monkeypatch.setattr(substring, "STRIDE", 700)
    shared = prose(77, 30)
    more = [r for r in corpus if r[0] is not None] + [(k, prose(k, 3) + shared + prose(k + 500, 5)) for k in range(100, 130)] + [(140, "ab" * 300), (141, "ba" * 90 + "c"), (142, "é" * 120)]
    assert rows(substring.digest(table(more)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == slow_substrings(more, 100)
    nulls = rows(substring.digest(table([(None, shared), (None, shared), (5, shared), (None, None)])), "doc_id", "n_removed")
    assert nulls == sorted([(None, len(shared.encode()))] * 2 + [(5, 0), (None, 0)], key=repr)


def test_substrings_of_other_lengths(table, prose):
    other = [(1, "abcdefgh" * 8 + "x" + "abcdefgh" * 8), (2, "z" + "abcdefgh" * 9), (3, prose(1, 90) + "q" + prose(2, 50)), (4, prose(2, 50) + prose(1, 90))]
    for length in (64, 65, 97, 130, 300):
        assert rows(substring.digest(table(other), length), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == slow_substrings(other, length)
    assert [substring.rounds(n) for n in (64, 100, 300)] == [[(32, 32)], [(32, 32), (64, 36)], [(32, 32), (64, 64), (128, 128), (256, 44)]]
    assert substring.digest(table([])).count() == 0


def test_substrings_of_repeated_keys(table, prose):
    """Another text under the same key is another document; of equal texts under one key none goes."""
    own, shared = prose(4, 40), prose(5, 40)
    got = rows(substring.digest(table([(1, own), (1, own), (1, shared), (2, shared)])), "doc_id", "n_removed")
    assert got == [(1, 0), (1, 0), (1, 0), (2, len(shared.encode()))]


# -- operator 10 --------------------------------------------------------------
def slow_fingerprint(text):
    words = WS.findall(lower(text or ""))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(table, corpus):
    got = simhash.near_duplicate_groups(table(corpus)).collect()
    fps = [slow_fingerprint(t) for _, t in corpus]
    assert sorted((repr(x.doc_id), x.fp % 2**64) for x in got) == sorted((repr(d), f) for (d, _), f in zip(corpus, fps))
    group = list(range(len(corpus)))
    for i in range(len(corpus)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((d for (d, _), h in zip(corpus, group) if h == g and d is not None), default=None) for g in set(group)}
    assert sorted(((repr(x.doc_id), x.component_id) for x in got), key=repr) == sorted(((repr(d), least[g]) for (d, _), g in zip(corpus, group)), key=repr)
    kept = simhash.deduplicate(table(corpus))
    assert kept.columns == table([]).columns and kept.where("doc_id in (20, 21, 30)").count() == 0 and kept.where("doc_id in (0, 29)").count() == 2
    assert simhash.near_duplicate_groups(table([])).count() == 0


@pytest.mark.parametrize("hot", [8192, 40])
def test_links_find_every_pair(spark, monkeypatch, hot):
    """Clusters of close fingerprints, one of them in a bucket that is cut in parts."""
    monkeypatch.setattr(simhash, "HOT", hot)
    r = np.random.default_rng(9)
    centres = r.integers(0, 1 << 63, 6, dtype=np.uint64) * np.uint64(2)
    near = [int(c) ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 4), replace=False)) for c in centres for _ in range(60)]
    fps = np.unique(np.array([*near, *r.integers(0, 1 << 63, 200).tolist()], np.uint64))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    found = {x.node: x.component for x in connected_components(simhash.links(df)).collect()}
    signed = fps.view(np.int64).tolist()
    label = {f: f for f in signed}
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(fps ^ f) <= 4):
            a, b = label[signed[i]], label[signed[j]]
            if a != b:
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    assert {f: found.get(f, f) for f in signed} == label


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 100), (7, 7), (None, 3), (300, 250)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 300: 250, 250: 250}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_random_graphs(spark):
    """A hub, paths in random order and random edges, as by brute force."""
    r = np.random.default_rng(4)
    edges = [(5000 + int(k), 7000) for k in range(900)] + [tuple(map(int, r.permutation([k, k + 1]))) for k in range(9000, 9040)] + [tuple(map(int, x)) for x in r.integers(0, 400, (300, 2))]
    label = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: label[x] for x in label if x in got} and {x for e in edges if e[0] != e[1] for x in e} == set(got)
