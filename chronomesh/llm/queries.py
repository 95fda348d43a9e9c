"""The queries ``opN_<name>`` with production parameters, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.llm import quality
from chronomesh.llm.common import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    # a table in fewer pieces than there are cores is small: deal it out, since the work is in the rows
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of every document."""
    from chronomesh.llm.quality import digest

    return digest(_table(spark, sf_dir, "documents"))


def op2_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and turns of every conversation's transcript."""
    from chronomesh.llm.transcripts import digest

    return digest(_table(spark, sf_dir, "conversations"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    from chronomesh.llm.langid import digest

    return digest(_table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learnt from those that are not held out."""
    from chronomesh.llm.lmscore import digest

    return digest(_table(spark, sf_dir, "documents"))


def op5_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact histogram of encoded lengths with totals for every context limit."""
    from chronomesh.llm.tokens import length_histogram

    return length_histogram(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    from chronomesh.llm.decontaminate import digest

    return digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one up to one edit."""
    from chronomesh.llm.linededup import digest

    return digest(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes inside repeated 100-byte strings."""
    from chronomesh.llm.substring import digest

    return digest(_table(spark, sf_dir, "documents"))


def op9_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    from chronomesh.llm.packing import best_fit_pack

    return best_fit_pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups within 4 bits of the fingerprints."""
    from chronomesh.llm.simhash import near_duplicate_groups

    groups = near_duplicate_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run`` of corpus_pipeline.py, which stands beside the package."""
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return found | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_WORDS_OF = r"list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_NORMAL = r"trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+', ' ', 'g'))"

SQL = {
    "op1_divergence": quality.sql(),
    "op7_line_dedup": f"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
o AS (SELECT doc_id, k - 1 AS k, {_NORMAL} AS l FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS k FROM d)),
f AS (SELECT l, min((doc_id, k)) AS first FROM o WHERE l <> '' GROUP BY l),
v AS (SELECT l, first, l AS v, -1 AS i FROM f WHERE length(l) >= 10 UNION ALL
      SELECT l, first, left(l, i) || substr(l, i + 2) AS v, i FROM (SELECT l, first, unnest(range(0, length(l))) AS i FROM f WHERE length(l) >= 10)),
n AS (SELECT DISTINCT a.l FROM v a JOIN v b ON a.v = b.v AND b.first < a.first AND (a.i = b.i OR a.i < 0 OR b.i < 0)),
g AS (SELECT doc_id, k FROM o JOIN f USING (l) LEFT JOIN n ON n.l = o.l WHERE n.l IS NOT NULL OR f.first < (doc_id, k))
SELECT d.doc_id, CAST(len(any_value(ls)) AS BIGINT) AS n_lines, count(k) AS n_removed,
       coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k), '') AS removed_lines
FROM d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op6_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS_OF.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS_OF.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT item_id, w, least(8, len(w)) AS k, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN ks)),
m AS (SELECT DISTINCT doc_id, dw.k AS k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
}
