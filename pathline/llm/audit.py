"""Filter interaction audit: what each filter of a chain removes, in every order, and its Shapley value.

1. A document's failures are one number (a bit for each filter). Documents are counted by part,
   failures and labels; no text and no document goes further than that.
2. A table of all coalitions (2^m sets of filters) holds how many documents each removes.
3. What a filter removes after others is the difference of two coalitions, so all m! orders
   follow from that table.
4. The Shapley value is the solution of least squares: values of single filters whose sums come
   closest to what coalitions remove, weighed by the Shapley kernel, under the constraint that
   all of them add up to what the whole chain removes. The normal equations with their
   multiplier are solved once in rationals for every coalition's unit game; a part's values are
   then whole-number sums over its coalitions.

Copies (filter E) are told without a join of documents: those with one text meet as counts by
digest, part and labels, which are summed before the shuffle, so a text that a third of all
rows have is a few rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathline.llm.batches import settle, small_batches

LETTERS = "ABCDE"
#: Thresholds of the filters: words; percent of distinct words; percent of capital letters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNS = b"#$%&*|"
_WITHIN = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are cut into words at once.
_PIECE = 1 << 20


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; bytes.split() cuts at the six characters of _SPACE."""
    at = 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + _PIECE)
        end = cut.start() if cut else len(raw)
        yield raw[at:end].split()
        at = end


def failures(raw: bytes) -> int:
    """Bits of the filters A to D (1, 2, 4, 8) that a text fails."""
    n, distinct = 0, set()
    for words in _words(raw):
        n += len(words)
        distinct.update(words)
    fails = n < LEAST_WORDS
    fails |= (100 * len(distinct) < LEAST_DISTINCT * n) << 1
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    fails |= (100 * capitals > MOST_CAPITALS * len(raw.translate(None, _WITHIN))) << 2
    return fails | (len(raw.translate(None, _SIGNS)) < len(raw)) << 3


def failing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits of the filters that fail), good, toxic, n: documents counted.

    part is lang (null: ""). A null text is an empty one. A row fails E if a smaller doc_id has the
    same text; one with a null doc_id neither fails it nor makes others fail, and has no labels. A
    doc_id that labels hold several times is good (toxic) if one of the rows says so; a document
    without labels is neither. Repeated rows all count.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            raws = [r or b"" for r in batch.column("raw").to_pylist()]
            digests = pa.array([hashlib.sha256(r).digest() for r in raws], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(map(failures, raws), type=pa.int32()), digests], ["doc_id", "part", "mask", "digest"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").cast("binary").alias("raw"))
    facts = texts.mapInArrow(run, "doc_id long, part string, mask int, digest binary")
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    said = said.groupBy("doc_id").agg(*[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    facts = facts.join(said, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    each = facts.groupBy("doc_id", "digest", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    # documents with one text, part and labels are a row: how many, the smallest doc_id, and how many have it or none
    alike = each.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null")
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    alone = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    sides = F.array(F.struct(F.col("mask").alias("mask"), F.col("alone").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - F.col("alone")).alias("n")))
    split = alike.withColumn("first", first).withColumn("alone", alone).select("part", "good", "toxic", F.explode(sides).alias("s"))
    return split.groupBy("part", "s.mask", "good", "toxic").agg(F.sum("s.n").alias("n"))


def coalitions(counts: DataFrame, m: int = len(LETTERS)) -> DataFrame:
    """part, coalition (bits of its filters), removed, good, toxic: documents that fail any of its filters; counts as `failing` gives them."""
    by = counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(2**m - 1))))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return by.groupBy("part", "coalition").agg(of(hit).alias("removed"), of(hit & F.col("good")).alias("good"), of(hit & F.col("toxic")).alias("toxic"), F.sum("n").alias("total"))


def solve(a: list[list[Fraction]], b: list[list[Fraction]]) -> list[list[Fraction]]:
    """x of a x = b for several right sides (rows of b belong to rows of a), exact."""
    rows = [[*x, *y] for x, y in zip(a, b, strict=True)]
    n = len(rows)
    for c in range(n):
        p = next(r for r in range(c, n) if rows[r][c])
        rows[c], rows[p] = rows[p], rows[c]
        rows[c] = [v / rows[c][c] for v in rows[c]]
        for r in range(n):
            if r != c and rows[r][c]:
                rows[r] = [v - rows[r][c] * w for v, w in zip(rows[r], rows[c], strict=True)]
    return [r[n:] for r in rows]


def kernel_values(m: int = len(LETTERS)) -> list[list[int]]:
    """For each filter and coalition how often what the coalition removes counts in m! times the filter's Shapley value.

    Least over x: sum over coalitions S but none and all of w(S) (v(S) - sum of x in S)^2, where the sum of all x is
    v(all) and w(S) = (m - 1) / (C(m, s) s (m - s)). Each coalition's unit game is one right side.
    """
    some = range(1, 2**m - 1)
    w = {s: Fraction(m - 1, comb(m, k := s.bit_count()) * k * (m - k)) for s in some}
    has = lambda s, i: s >> i & 1
    a = [[sum((w[s] for s in some if has(s, i) and has(s, j)), Fraction(0)) for j in range(m)] + [Fraction(1)] for i in range(m)]
    a.append([Fraction(1)] * m + [Fraction(0)])
    b = [[w[s] if s in w and has(s, i) else Fraction(0) for s in range(2**m)] for i in range(m)]
    b.append([Fraction(s == 2**m - 1) for s in range(2**m)])
    x = [[factorial(m) * v for v in row] for row in solve(a, b)[:m]]
    if any(v.denominator != 1 for row in x for v in row):
        raise ArithmeticError("the kernel's solution is no whole number of orders")
    return [[int(v) for v in row] for row in x]


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step (from 1), filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a
    row for each part, order of the filters and step in it, zeros included. counts as `failing` gives them; a part is there
    if it has a document, so no documents give no rows.
    """
    m = len(letters)
    orders = ["".join(o) for o in permutations(letters)]
    bit = {c: 1 << i for i, c in enumerate(letters)}
    steps = [(o, k, sum(bit[c] for c in o[:k]), o[k]) for o in orders for k in range(m)]
    table = settle(coalitions(counts, m), "coalitions")
    row = F.struct("coalition", "removed", "good", "toxic")
    parts = table.groupBy("part").agg(F.sort_array(F.collect_list(row)).alias("v"), F.first("total").alias("total"))
    whole = lambda weights: sum((F.col("v")[s]["removed"] * F.lit(x) for s, x in enumerate(weights) if x), F.lit(0).cast("long"))
    parts = parts.withColumn("values", F.array(*[whole(x) for x in kernel_values(m)]))
    fixed = lambda values: F.lit(values)[F.col("i")]
    each = parts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    each = each.withColumns(
        {"filter_order": fixed([s[0] for s in steps]), "step": fixed([s[1] + 1 for s in steps]), "before": fixed([s[2] for s in steps]), "of": fixed([letters.index(s[3]) for s in steps]), "own": fixed([bit[s[3]] for s in steps]), "filter": fixed([s[3] for s in steps])}
    )
    own = F.col("own")
    each = each.withColumns({"a": F.col("v")[F.col("before")], "b": F.col("v")[F.col("before") + own], "alone": F.col("v")[own], "all": F.col("v")[2**m - 1], "rest": F.col("v")[2**m - 1 - own]})
    gone = lambda c: F.col(f"b.{c}") - F.col(f"a.{c}")
    return each.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        (F.col("total") - F.col("b.removed")).alias("kept"),
        gone("removed").alias("removed"),
        (F.col("alone.removed") - gone("removed")).alias("redundant"),
        (F.col("all.removed") - F.col("rest.removed")).alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        F.col("values")[F.col("of")].alias("shapley"),
        "filter",
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """`audit` of documents by lang under the five filters; a null text is an empty one, a null lang the part ""."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(failing(docs, labels))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
w AS (
  SELECT t.doc_id, part, text, least,
         list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM t JOIN c USING (text)),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN coalesce(w.doc_id > least, false) THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
n AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, k AS step, filter_order[k] AS filter, filter_order[1 : k - 1] AS before FROM o, range(1, 6) r(k)),
h AS (
  SELECT part, filter_order, step, filter, n, good, toxic, contains(fails, filter) AS hit, fails = filter AS only_it,
         before <> '' AND length(translate(fails, before, '')) < length(fails) AS gone
  FROM s, n),
r AS (
  SELECT part, filter_order, step, filter,
         sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN only_it THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM h GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley, filter
FROM r
"""
