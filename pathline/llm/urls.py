"""URL filters by a temporal list join.

Dated list entries become validity intervals: an entry holds from its date until the next
entry for the same key. A key's intervals are one row. A capture is looked up under its
keys (host, parent domains, host with first path segment), and the as-of join takes the
interval of each key that holds when it was fetched; the most specific key decides. The
list goes to all executors if its counted size allows. Else both sides are shuffled by
key, where the list has one row each, so the captures of a host with very many of them can
be split among tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathline.llm.batches import settle

#: Keys and intervals of a list that goes to all executors.
BROADCAST_KEYS, BROADCAST_SPANS = 200_000, 1_000_000


def host_of(url: Column) -> Column:
    """Host in lower case without user, port and a last dot; empty for a null or odd url."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"\.$", "")


def keys_of(url: Column) -> Column:
    """Keys of a url, most specific first: host/segment, host, all parent domains of two labels and more."""
    host = host_of(url)
    segment = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]+://[^/?#]*/([^/?#]+)", 1)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    every = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.array_join(F.slice(labels, i + 1, n - i), "."))
    parents = F.when(n >= 3, every).otherwise(F.array().cast("array<string>"))
    first = F.when((host != "") & (segment != ""), F.concat_ws("/", host, segment))
    return F.array_distinct(F.array_compact(F.concat(F.array(first, F.when(host != "", host)), parents)))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (key, listed_on date, action 'add' or 'remove') -> key and spans: since and until (exclusive, null:
    still holds) of the times at which it is on the list, in order.

    Of several entries of one key and day 'remove' counts. Entries with a null field or another
    action are left out, and keys that are never on the list.
    """
    known = entries.select("key", "listed_on", "action").dropna().filter(F.col("action").isin("add", "remove"))
    days = known.groupBy("key", "listed_on").agg(F.max("action").alias("action"))
    history = days.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("listed_on", "action"))).alias("h"))
    each = F.transform("h", lambda e, i: F.struct(e["action"].alias("action"), e["listed_on"].alias("since"), F.get("h", i + 1)["listed_on"].alias("until")))
    held = F.transform(F.filter(each, lambda e: e["action"] == "add"), lambda e: F.struct(e["since"].alias("since"), e["until"].alias("until")))
    return history.select("key", held.alias("spans")).filter(F.size("spans") > 0)


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched_on, blocked, matched (most specific key that held, or null) and since, for each capture.

    A capture with a null url or fetched_on is not blocked. Repeated captures are judged
    one by one; columns of captures other than these three are left out.
    """
    rows = captures.select("page_id", "url", F.col("fetched_on").cast("date").alias("fetched_on"))
    asked = rows.select("*", F.posexplode_outer(keys_of(F.col("url"))).alias("order", "key"))
    held = settle(intervals(entries), "intervals")
    size = held.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("spans")).first()
    few = size["keys"] <= BROADCAST_KEYS and size["spans"] <= BROADCAST_SPANS
    met = asked.join(F.broadcast(held) if few else held, "key", "left")
    day = F.col("fetched_on")
    now = F.get(F.filter("spans", lambda s: (s["since"] <= day) & (s["until"].isNull() | (day < s["until"]))), F.lit(0))
    best = F.min(F.when(now.isNotNull(), F.struct("order", "key", now["since"].alias("since"))))
    # a capture's first key (or none) stands for it once, so that repeated captures are counted
    copies = F.sum(F.when(F.coalesce("order", F.lit(0)) == 0, 1).otherwise(0)).cast("int")
    out = met.groupBy("page_id", "url", "fetched_on").agg(best.alias("b"), copies.alias("copies"))
    out = out.withColumn("_", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select("page_id", "url", "fetched_on", F.col("b").isNotNull().alias("blocked"), F.col("b.key").alias("matched"), F.col("b.since").alias("since"))


def _digit(text: Column, k: int) -> Column:
    """A number from 0 to 15 drawn from a text."""
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(text), k, 1)) - 1


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages table has no dates: a page counts as fetched page_id days (modulo 400) into 2024."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(400)).cast("int")).alias("fetched_on"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A list drawn from the pages' own hosts: some hosts and domains are added, some later removed, some added again."""
    host = pages.select(host_of(F.col("url")).alias("host")).filter("host <> ''")
    domain = host.select(F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".").alias("key")).distinct()
    keys = host.select(F.col("host").alias("key")).distinct().filter(_digit(F.col("host"), 1) < 6).select("key").union(domain.filter(_digit(F.col("key"), 1) < 1)).distinct()
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    k = F.col("key")
    start = _digit(k, 2) * 16 + _digit(k, 3)
    gone = start + 10 + _digit(k, 4) * 5
    added = keys.select("key", day(start).alias("listed_on"), F.lit("add").alias("action"))
    removed = keys.filter(_digit(k, 5) < 8).select("key", day(gone).alias("listed_on"), F.lit("remove").alias("action"))
    again = keys.filter(_digit(k, 5) < 3).select("key", day(gone + 20).alias("listed_on"), F.lit("add").alias("action"))
    return added.union(removed).union(again)


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    """`judge` of every page; a null or odd url is not blocked. Fetch dates and the list are drawn from the pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(captures_of(pages), entries_of(pages))


_D = "(instr('0123456789abcdef', substr(md5(key), {k}, 1)) - 1)"
OP6_SQL = rf"""
WITH p AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 400 AS INTEGER) AS DATE) AS fetched_on,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS host,
         regexp_extract(url, '^[^:/?#]+://[^/?#]*/([^/?#]+)', 1) AS segment
  FROM pages),
l AS (SELECT *, string_split(host, '.') AS labels FROM p),
q AS (
  SELECT page_id, url, fetched_on, 0 AS o, host || '/' || segment AS key FROM l WHERE host <> '' AND segment <> ''
  UNION ALL SELECT page_id, url, fetched_on, 1, host FROM l WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched_on, i + 1, array_to_string(labels[i + 1 :], '.') FROM (SELECT *, unnest(range(1, len(labels) - 1)) AS i FROM l WHERE len(labels) >= 3)),
d AS (SELECT DISTINCT array_to_string(labels[-2:], '.') AS key FROM l WHERE host <> ''),
k AS (
  SELECT DISTINCT key FROM (
    SELECT key FROM (SELECT DISTINCT host AS key FROM l WHERE host <> '') WHERE {_D.format(k=1)} < 6
    UNION ALL SELECT key FROM d WHERE {_D.format(k=1)} < 1)),
s AS (SELECT key, {_D.format(k=2)} * 16 + {_D.format(k=3)} AS a, {_D.format(k=4)} * 5 + 10 AS n, {_D.format(k=5)} AS w FROM k),
e AS (
  SELECT key, a AS d, 'add' AS action FROM s UNION ALL SELECT key, a + n, 'remove' FROM s WHERE w < 8
  UNION ALL SELECT key, a + n + 20, 'add' FROM s WHERE w < 3),
t AS (SELECT key, CAST(DATE '2024-01-01' + CAST(d AS INTEGER) AS DATE) AS since, action, lead(CAST(DATE '2024-01-01' + CAST(d AS INTEGER) AS DATE)) OVER (PARTITION BY key ORDER BY d) AS until FROM e),
m AS (
  SELECT page_id, url, fetched_on, arg_min(key, o) AS matched, arg_min(since, o) AS since
  FROM q JOIN t USING (key) WHERE action = 'add' AND since <= fetched_on AND (until IS NULL OR fetched_on < until) GROUP BY ALL)
SELECT p.page_id, p.url, p.fetched_on, matched IS NOT NULL AS blocked, matched, since
FROM p LEFT JOIN m USING (page_id, url, fetched_on)
"""
