"""Quality rules from distribution divergence (operator 1), DataFrame functions only.

A document's histograms of character classes and of common words are compared
with those of each language by the Jensen-Shannon distance. A document that is
far from every language fails; short ones are not judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomesh.llm.common import materialize

#: Common words by language (fixed values).
COMMON_WORDS = {
    "de": ("das", "den", "der", "die", "ein", "im", "in", "ist", "nicht", "und", "von", "zu"),
    "en": ("a", "and", "in", "is", "of", "that", "the", "to", "was", "with"),
    "es": ("de", "del", "el", "en", "la", "los", "no", "por", "que", "se", "un", "y"),
    "fr": ("dans", "de", "des", "du", "en", "et", "la", "le", "les", "que", "un", "une"),
}
COMMON = tuple(sorted({w for words in COMMON_WORDS.values() for w in words}))
#: Patterns of the character classes that are counted; white space and lower case complete them.
CLASSES = {
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "point": "[.,;:!?'\"()-]",
    "symbol": r"[#$%&*+/<=>@\[\\\]^_`{|}~]",
    "wide": r"[^\x00-\x7F]",
}
SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT = 50, 0.5
#: Documents of fewer words are not compared; nor are common words if so few words of letters are there.
GUARD_WORDS, GUARD_COMMON = 80, 80
#: Largest Jensen-Shannon distance (base 2, its square root) from the nearest language.
MAX_CLASS_DISTANCE, MAX_COMMON_DISTANCE = 0.25, 0.3


def _base(docs: DataFrame, keys: tuple[str, ...], text: str, lang: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, SPACE))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    letters = F.filter(F.split(F.lower(t), r"[^\p{L}]+"), lambda x: x != "")
    first = docs.select(*keys, F.col(lang).alias("_lang"), t.alias("_t"), words.alias("_w"), lines.alias("_lines"), letters.alias("_letters"))
    n = F.size("_w")
    hashed = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))),
    )
    # most texts repeat no window: only the others' windows are sorted
    sorted_windows = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    counts = {k: F.regexp_count("_t", F.lit(p)) for k, p in CLASSES.items()}
    second = first.select(
        *keys,
        "_lang",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        hashed.alias("_h"),
        F.length("_t").alias("_chars"),
        *(c.cast("long").alias(f"_{k}") for k, c in counts.items()),
        F.size("_letters").alias("_n_letters"),
        F.filter("_letters", lambda x: x.isin(*COMMON)).alias("_hits"),
    )
    third = second.withColumn("_s", sorted_windows).withColumn(
        "_p",
        F.sort_array(F.transform(F.filter("_s", lambda x, i: (F.get("_s", i - 1)["h"] == x["h"]) | (F.get("_s", i + 1)["h"] == x["h"])), lambda x: x["i"])),
    )
    repeated = F.aggregate(
        F.transform("_p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    space = F.col("_chars") - F.col("word_chars")
    lower = F.col("word_chars") - sum((F.col(f"_{k}") for k in CLASSES), F.lit(0))
    common = F.transform(F.array(*map(F.lit, COMMON)), lambda w: (F.size("_hits") - F.size(F.array_remove(F.col("_hits"), w))).cast("double"))
    return third.select(
        *keys,
        "_lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(repeated, F.lit(0)).alias("n_repeat_words"),
        "_n_letters",
        F.array(*(F.col(f"_{k}").cast("double") for k in CLASSES), space.cast("double"), F.greatest(lower, F.lit(0)).cast("double")).alias("_classes"),
        F.concat(common, F.array((F.col("_n_letters") - F.size("_hits")).cast("double"))).alias("_common"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEAT * F.col("n_words")))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, 0 to 1."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.ln(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2 / F.ln(F.lit(2.0))))


def _references(stats: DataFrame) -> dict[str, list[list[float]]]:
    """Shares of classes and common words of each language, over all its documents that pass the base rules."""
    sizes = {"_classes": len(CLASSES) + 2, "_common": len(COMMON) + 1}
    good = stats.where(F.col("_lang").isNotNull() & ~F.col("base_failed"))
    sums = good.groupBy("_lang").agg(*(F.sum(F.get(c, F.lit(k))).alias(f"{c}{k}") for c, n in sizes.items() for k in range(n)))
    rows = sums.orderBy("_lang").collect()  # a row per language
    out: dict[str, list[list[float]]] = {}
    for c, n in sizes.items():
        counts = [[r[f"{c}{k}"] for k in range(n)] for r in rows]
        out[c] = [[x / sum(own) for x in own] for own in counts if sum(own)]
    return out


def quality(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: keys, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, common_distance, kept.

    A null text has no words and fails the base rules. Distances are null where a
    document is below the guards or no language is known, and then do not count
    against it. The language of a row is used for the references only.
    """
    stats = materialize(_base(docs, keys, text, lang), "quality")
    references = _references(stats)

    def nearest(column: str, guard: Column) -> Column:
        if not references[column]:
            return F.lit(None).cast("double")
        own = _shares(F.col(column))
        known = F.array(*(F.array(*map(F.lit, q)) for q in references[column]))
        return F.when(guard, F.array_min(F.transform(known, lambda q: js_distance(own, q))))

    judged = stats.withColumns(
        {
            "class_distance": nearest("_classes", F.col("n_words") >= GUARD_WORDS),
            "common_distance": nearest("_common", (F.col("n_words") >= GUARD_WORDS) & (F.col("_n_letters") >= GUARD_COMMON)),
        }
    )
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("common_distance", F.lit(0.0)) > MAX_COMMON_DISTANCE)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "common_distance"]
    return judged.select(*keys, *names, (~F.col("base_failed") & ~far).alias("kept"))


def digest(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return quality(docs, (key,)).drop("class_distance", "common_distance")


def _sql_array(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql() -> str:
    """The digest in DuckDB's SQL."""
    count = "CAST(len(regexp_extract_all(t, '{}')) AS DOUBLE)"
    classes = [count.format(p.replace("'", "''")) for p in CLASSES.values()]
    js = "sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * ln(2 * z[1] / (z[1] + z[2])) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * ln(2 * z[2] / (z[1] + z[2])) ELSE 0 END)) / 2 / ln(2)))"
    n, m = len(CLASSES) + 2, len(COMMON) + 1
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
        list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}]+'), lambda x: x <> '') AS lw FROM d),
tri AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM
        (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        len(lw) AS n_letters, length(t) AS chars, [{", ".join(classes)}] AS cls,
        list_transform({_sql_array(COMMON)}, lambda c: CAST(len(list_filter(lw, lambda x: x = c)) AS DOUBLE)) AS com
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
s AS (SELECT doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_letters,
        list_concat(cls, [CAST(chars - word_chars AS DOUBLE), greatest(0, word_chars - list_sum(cls))]) AS cls,
        list_concat(com, [n_letters - list_sum(com)]) AS com,
        n_words < {MIN_WORDS} OR 100 * n_repeat_words > {100 * MAX_REPEAT} * n_words AS base_failed FROM b),
g AS (SELECT * FROM s WHERE lang IS NOT NULL AND NOT base_failed),
ref AS (SELECT lang, [{", ".join(f"sum(cls[{k}])" for k in range(1, n + 1))}] AS rc, [{", ".join(f"sum(com[{k}])" for k in range(1, m + 1))}] AS rw FROM g GROUP BY lang),
shr AS (SELECT list_transform(rc, lambda x: x / list_sum(rc)) AS rc, list_transform(rw, lambda x: x / list_sum(rw)) AS rw FROM ref),
own AS (SELECT *, list_transform(cls, lambda x: x / greatest(list_sum(cls), 1)) AS pc, list_transform(com, lambda x: x / greatest(list_sum(com), 1)) AS pw FROM s),
dist AS (SELECT doc_id, min({js.format(p="pc", q="rc")}) AS dc, min({js.format(p="pw", q="rw")}) AS dw FROM own CROSS JOIN shr GROUP BY doc_id)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {GUARD_WORDS} AND (coalesce(dc, 0) > {MAX_CLASS_DISTANCE} OR n_letters >= {GUARD_COMMON} AND coalesce(dw, 0) > {MAX_COMMON_DISTANCE})) AS kept
FROM s LEFT JOIN dist ON dist.doc_id = s.doc_id"""
