"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a built-in column expression; no user function runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"

# Frequent function words of four languages.
STOP_WORDS = tuple(
    """
    the of and to in a is that for it was on with by at from this are be or an as not
    der die das und in zu den von ist mit sich auf für ein eine nicht im dem des
    le la les de des et un une du que qui dans pour est en au sur avec pas
    el los las y por con una se no es del al lo su para como
    """.split()
)


@dataclass(frozen=True)
class Rule:
    """A document passes while low <= measure <= high; None leaves that side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Production thresholds. The measures are columns of `measures()`.
RULES = (
    Rule("n_words", 50, 100_000),
    Rule("repeat_ratio", None, 0.5),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_ratio", 0.01, None),
    Rule("dup_line_ratio", None, 0.5),
)
#: These two are what every caller must fail on; the others add to them.
BASE_MEASURES = ("n_words", "repeat_ratio")


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def measures(docs: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """doc_id, text and the measures of every row, computed from its whole text.

    A null text has no words; all counts are 0 then. Rows with the same doc_id are
    measured one by one. Columns other than doc_id and text are left out, so clashing
    names do no harm.
    """
    stop = F.array(*[F.lit(w) for w in sorted(set(stop_words))])
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "doc_id",
        "text",
        F.array_remove(F.split(text, SPACE + "+"), "").alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("_w")
    counted = split.select(
        "*",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda w: F.array_contains(stop, w))).cast("long").alias("n_stop"),
        F.when(
            n >= 3,
            F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get("_w", i - 1), F.get("_w", i), F.get("_w", i + 1))),
        ).alias("_tri"),
    )
    # Only texts in which some window comes twice have their windows sorted.
    ordered = counted.select(
        "*",
        F.when(
            F.size(F.array_distinct("_tri")) < F.size("_tri"),
            F.array_sort(F.transform("_tri", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_sorted"),
    )
    at = lambda j: F.get("_sorted", j)["h"]
    repeated = ordered.select(
        "*",
        F.sort_array(
            F.transform(
                F.filter(
                    F.transform(
                        "_sorted",
                        lambda e, j: F.when(e["h"].eqNullSafe(at(j - 1)) | e["h"].eqNullSafe(at(j + 1)), e["i"]),
                    ),
                    lambda i: i.isNotNull(),
                ),
                lambda i: i,
            )
        ).alias("_at"),
    )
    # A repeated window adds its three words less those that the next one covers too.
    covered = F.aggregate(
        F.transform("_at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    out = repeated.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return out.select(
        *[c for c in out.columns if not c.startswith("_")],
        _ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        _ratio("word_chars", "n_words").alias("mean_word_chars"),
        _ratio("n_symbols", "n_words").alias("symbol_ratio"),
        _ratio("n_stop", "n_words").alias("stop_ratio"),
        _ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )


def failing(rules: tuple[Rule, ...]) -> Column:
    """The rules' table as one expression: names of the measures outside their bounds."""
    tests = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.measure) < r.low)
        if r.high is not None:
            bad = bad | (F.col(r.measure) > r.high)
        tests.append(F.when(bad, F.lit(r.measure)))
    return F.array_compact(F.array(*tests))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """`measures` with base_failed, failed (names of broken rules) and kept, a row for each input row.

    A document with null text, no text or no words fails on n_words. A null doc_id stays null.
    """
    base = tuple(r for r in rules if r.measure in BASE_MEASURES)
    m = measures(docs, stop_words).withColumn("failed", failing(rules))
    return m.withColumns({"base_failed": F.size(failing(base)) > 0, "kept": F.size("failed") == 0})


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """`judge` of documents by RULES; a null or empty text fails on its number of words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, all columns as they were; extra columns may have any name.

    A null or empty text has no words and goes; repeated rows are judged one by one.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text")
    # The task's number is no function of the row: with it in the condition the optimiser
    # leaves the filter above the measures and each of them is computed once.
    judged = judge(keyed, rules).select("doc_id", "kept", F.spark_partition_id().alias("task"))
    return judged.filter("kept AND task >= 0").select("doc_id.*")


def _sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words)))


OP4_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         len(list_filter(w, lambda x: x IN ({_sql_list(STOP_WORDS)}))) AS n_stop,
         row_number() OVER () AS rid, w
  FROM w),
t AS (
  SELECT rid, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS tri
  FROM (SELECT rid, w, unnest(range(1, n_words - 1)) AS i FROM m WHERE n_words >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS c FROM t) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
f AS (
  SELECT doc_id, n_words, word_chars, n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, n_stop, len(lines) AS n_lines
  FROM m LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words <= 100000
       AND word_chars / n_words >= 2.0 AND word_chars / n_words <= 14.0
       AND n_symbols / n_words <= 0.1 AND n_stop / n_words >= 0.01
       AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5) AS kept
FROM b
"""
