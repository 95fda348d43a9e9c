"""Hierarchical language identification (operator 3).

:class:`Model` predicts the language family first; inside it one-versus-one linear
support vector machines separate the closely related languages. Features are hashed
byte n-grams of the whole text's letters. A text may also be in none of the learnt
languages: :meth:`Model.typical` says how far its n-grams lie from those of the
language it was given.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.llm.common import arrow_map, fresh, texts

#: Families of languages by code (fixed values). A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
#: Hashed features of a text.
FEATURES = 4096
#: Bound of the labelled rows that the model is fitted on.
MAX_SAMPLE = 2000
#: Texts beyond this are in none of the learnt languages.
MOST_UNTYPICAL = 15.0
UNKNOWN = "und"
#: Bytes of letters stay, every other ASCII byte becomes a space.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counted(text: str) -> np.ndarray:
    """How often each feature, a hashed 1- to 3-byte string, occurs."""
    counts = np.zeros(FEATURES, np.float64)
    for at in range(0, len(text), 1 << 19):  # whole texts, in blocks of bounded memory
        data = b" " + b" ".join(text[at : at + (1 << 19)].lower().encode().translate(_LETTERS).split()) + b" "
        a = np.frombuffer(data, np.uint8).astype(np.uint32)
        two = a[:-1] * np.uint32(257) + a[1:]
        three = two[:-1] * np.uint32(263) + a[2:]
        for k, codes in enumerate((a, two, three)):
            codes = (codes * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(20)
            counts += np.bincount(codes, minlength=FEATURES)
    return counts


def shares(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the features, of length 1."""
    total = counts.sum()
    return np.sqrt(counts / total).astype(np.float32) if total else counts.astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge, L2) for labels -1 and 1, classes weighed alike, by accelerated gradient."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = v = np.zeros(x1.shape[1], np.float32)
    rate = 1.0 / (1.0 + 4.0 * penalty)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        new = v - rate * (v - 2 * penalty * (x1.T @ (weight * y * slack)))
        v = new + (t / (t + 3.0)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def _squash(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-4.0 * np.clip(x, -8, 8))))


class Model:
    """One-versus-one machines between families and between each family's languages."""

    def __init__(self, x: np.ndarray, labels: list[str], totals: np.ndarray | None = None):
        family = {lang: name for name, langs in FAMILIES.items() for lang in langs}
        names = np.array(labels, dtype=object)
        families = np.array([family.get(lang, lang) for lang in labels], dtype=object)
        self.families = self._duels(x, families)
        self.languages = {f: self._duels(x[families == f], names[families == f]) for f in sorted(set(families))}
        self.profiles = {} if totals is None else {lang: self._profile(x[names == lang], totals[names == lang]) for lang in sorted(set(names))}

    @staticmethod
    def _profile(x: np.ndarray, totals: np.ndarray) -> tuple:
        """Log shares of a language's features, their mean and variance in its texts, and the usual range of :meth:`_distance`."""
        share = (x.astype(np.float64) ** 2).mean(axis=0) + 0.05 / FEATURES
        share /= share.sum()
        logs = np.log(share)
        own = (x.astype(np.float64) ** 2) @ logs
        mean = float(np.median(own))
        spread = float(share @ (logs - share @ logs) ** 2)
        between = 1.4826 * float(np.median(np.abs(own - mean)))
        t = (own - mean) / np.sqrt(between**2 + 9 * spread / np.maximum(totals, 1)) if len(own) else np.zeros(1)
        low, middle = np.quantile(t, [0.05, 0.5])
        return logs, mean, spread, between, float(middle), max(0.5, float(middle - low))

    def typical(self, x: np.ndarray, total: float, lang: str) -> float:
        """How far a text's mean log share lies below its language's usual one, in units of that of the lowest twentieth of the learnt texts.

        About 1 and below for texts of the language; the distance allows for the
        text's length. 0 if the model holds no profile of the language.
        """
        if lang not in self.profiles:
            return 0.0
        logs, mean, spread, between, middle, unit = self.profiles[lang]
        t = (float((x.astype(np.float64) ** 2) @ logs) - mean) / np.sqrt(between**2 + 9 * spread / max(total, 1.0) + 1e-12)
        return (middle - t) / unit

    @staticmethod
    def _duels(x: np.ndarray, y: np.ndarray) -> tuple[list[str], list]:
        classes = sorted(set(y))
        duels = []
        for a, b in combinations(range(len(classes)), 2):
            own = (y == classes[a]) | (y == classes[b])
            duels.append((a, b, *fit_svm(x[own], np.where(y[own] == classes[a], 1, -1).astype(np.float32))))
        return classes, duels

    @staticmethod
    def _vote(machines: tuple[list[str], list], x: np.ndarray) -> tuple[str, float]:
        """The class with most won duels (then the larger sum of chances) and its least chance in a duel."""
        classes, duels = machines
        wins, least, total = np.zeros(len(classes)), np.ones(len(classes)), np.zeros(len(classes))
        for a, b, w, bias in duels:
            chance = _squash(float(x @ w) + bias)
            wins[a if chance >= 0.5 else b] += 1
            for k, p in ((a, chance), (b, 1 - chance)):
                least[k] = min(least[k], p)
                total[k] += p
        best = max(range(len(classes)), key=lambda k: (wins[k], total[k], -k))
        return classes[best], float(least[best])

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and how untypical the text is (:meth:`typical`)."""
        if text is None or not self.families[0] or not has_letter(text):
            return UNKNOWN, 0.0, math.inf
        counts = counted(text)
        x = shares(counts)
        family, p = self._vote(self.families, x)
        lang, q = self._vote(self.languages[family], x)
        return lang, p * q, self.typical(x, float(counts.sum()), lang)


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", max_sample: int = MAX_SAMPLE) -> Model:
    """Learn from a bounded sample of the labelled rows of ``docs``.

    ``max_sample`` is shared evenly by the languages; rows are chosen by a hash of
    their id and text against a threshold from exact counts, and where repeated
    rows make them more, the first 2 * ``max_sample`` in the order of that hash
    are taken. Features come from whole texts.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), text).alias("h")).where("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row per language
    share = F.lit(False)
    for name, n in counts.items():
        share = share | ((F.col("lang") == name) & (F.pmod("h", F.lit(1_000_000)) < min(1_000_000, math.ceil(1_000_000 * max_sample / len(counts) / n))))

    def run(batch: pa.RecordBatch) -> dict:
        found = [counted(t.decode()) for t in texts(batch)]
        return {"lang": batch.column("lang"), "x": [shares(c).astype("<f2").tobytes() for c in found], "total": [float(c.sum()) for c in found]}

    chosen = rows.where(share).orderBy("h", "lang").limit(2 * max_sample).select("lang", "text")
    sample = arrow_map(chosen, run, "lang string, x binary, total double").toArrow()
    order = sorted(zip(*(sample.column(c).to_pylist() for c in ("lang", "x", "total"))))
    if not order:
        return Model(np.zeros((0, FEATURES), np.float32), [])
    return Model(np.array([np.frombuffer(x, "<f2") for _, x, _ in order]).astype(np.float32), [name for name, _, _ in order], np.array([n for _, _, n in order]))


def with_language(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score", untypical: str = "untypical") -> DataFrame:
    """``docs`` plus the predicted language, its score and how untypical the text is of it, from the text alone.

    ``und``, 0 and infinity for a null text, one without a letter, or a model without
    languages. All rows and columns stay; a column of ``docs`` with one of the
    new names is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = [c for c in docs.columns if c.lower() not in (lang.lower(), score.lower(), untypical.lower())]
    types = dict(docs.dtypes)

    def run(batch: pa.RecordBatch) -> dict:
        found = [shared.value.predict(t if t is None else t.decode()) for t in texts(batch, text)]
        return {c: batch.column(c) for c in base} | {c: [f[k] for f in found] for k, c in enumerate((lang, score, untypical))}

    return arrow_map(docs, run, ", ".join([*(f"`{c}` {types[c]}" for c in base), f"{lang} string, {score} double, {untypical} double"]))


def learnable(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose crc32 of the id, as text, leaves a rest other than 1 when divided by 3 (rows without an id: none)."""
    return docs.where(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) != 1)


def digest(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: key, held_out, lang_pred, score; held-out rows are never learnt from.

    Every row gives one, repeated ones too; rows without an id are neither held out
    nor learnt from; null and letterless texts are ``und`` with score 0; an empty
    table gives no row; columns beside the key and the text (and, to learn from,
    lang) are not read.
    """
    model = fit(learnable(docs, key), key=key)
    found = with_language(docs.select(key, "text"), model)
    held = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return found.select(key, held.alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, most_untypical: float = MOST_UNTYPICAL, key: str = "doc_id") -> DataFrame:
    """Only documents in one of the learnt languages; rows and columns stay as they are.

    A document goes if its text is null or has no letter, or if its n-grams are
    more untypical of the language it was given than ``most_untypical`` (see
    :meth:`Model.typical`): another language, random letters. With nothing to
    learn from all documents go.
    """
    names = {c: fresh(docs, f"{c}_of_filter") for c in ("lang", "score", "untypical")}
    found = with_language(docs, fit(learnable(docs, key), key=key), **names)
    return found.where((F.col(names["lang"]) != UNKNOWN) & (F.col(names["untypical"]) <= most_untypical)).select(*docs.columns)
