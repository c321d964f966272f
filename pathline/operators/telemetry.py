"""Series of scalars and log records (H1 to H18). A series is ordered by iteration and seq."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathline.functions.order import along, in_ranges, with_halo
from pathline.sources.shared import settle

ORDER = ("iteration", "seq")


def scoped(df: DataFrame, scope: str) -> DataFrame:
    """H1: names under a scope, values as doubles."""
    return df.withColumns({"name": F.concat(F.lit(scope.rstrip("/") + "/"), F.col("name")), "value": F.col("value").cast("double")})


def latest(df: DataFrame) -> DataFrame:
    """H2: name, value and iteration of the newest row."""
    return df.groupBy("name").agg(F.max_by(F.struct("value", "iteration"), F.struct(*ORDER)).alias("r")).select("name", "r.value", "r.iteration")


def _series(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`along` for the series of names, with running `_sum` and `_count` of the values."""
    return along(df, "name", ORDER, {"sum": F.col("value").cast("double"), "count": F.col("value").isNotNull().cast("long")})


def rolling(df: DataFrame, n: int = 20) -> DataFrame:
    """H3, H4, H5: with each row the median and mean of the last n and the mean of all so far. Null values count for nothing.

    A series is dealt by range; each range gets the n - 1 rows before it, and running sums go over from range to range.
    """
    rows, ends = _series(df)
    last = Window.partitionBy("_part", "name").orderBy(*ORDER, "_place").rowsBetween(-(n - 1), 0)
    both = with_halo(rows, ends, "name", ORDER, n)
    out = both.withColumns({"median": F.percentile("value", 0.5).over(last), "mean": F.avg("value").over(last)}).filter("_own")
    return out.withColumn("global_mean", F.when(F.col("_count") > 0, F.col("_sum") / F.col("_count"))).select(*df.columns, "median", "mean", "global_mean")


def bounded(df: DataFrame, most: int) -> DataFrame:
    """H6: the newest rows of each name."""
    w = Window.partitionBy("name").orderBy(*[F.desc(c) for c in ORDER])
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most).drop("_rank")


def latest_smoothed(df: DataFrame, n: int = 20) -> DataFrame:
    """H7: name, iteration and the median of the last n where the name is to be smoothed, else the latest value."""
    last = bounded(df, n).groupBy("name").agg(F.percentile("value", 0.5).alias("m"), F.max_by(F.struct("value", "iteration", "smoothing_hint"), F.struct(*ORDER)).alias("r"))
    return last.select("name", "r.iteration", F.when(F.col("r.smoothing_hint"), F.col("m")).otherwise(F.col("r.value")).alias("value"))


def hint_violations(df: DataFrame) -> DataFrame:
    """H8: names with more than one smoothing hint."""
    return df.groupBy("name").agg(F.count_distinct("smoothing_hint").alias("hints")).filter("hints > 1")


def histogram(df: DataFrame, bins: int = 1000) -> DataFrame:
    """H9: name, bin from 0, limit (upper), count, and min, max, num, sum, sum_squares of the name's values. The last bin has its
    upper edge; where all values are equal it has them all."""
    stats = df.groupBy("name").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("num"), F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("sum_squares"))
    width = (F.col("max") - F.col("min")) / bins
    place = F.when(F.col("max") > F.col("min"), F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("min")) / width))).otherwise(bins - 1)
    counts = df.filter("value IS NOT NULL").join(stats, "name").groupBy("name", place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    dense = stats.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts, ["name", "bin"], "left")
    return dense.select("name", "bin", (F.col("min") + (F.col("bin") + 1) * width).alias("limit"), F.coalesce("c", F.lit(0)).alias("count"), "min", "max", "num", "sum", "sum_squares")


def newer(df: DataFrame, written: int) -> DataFrame:
    """Rows of iterations after the last one written."""
    return df.filter(F.col("iteration") > written)


def due(df: DataFrame, max_iter: int, period: int = 20, epoch_iters: int | None = None) -> DataFrame:
    """Rows of iterations at which something is written: each period's last, an epoch's last, and the last of all."""
    at = (F.pmod(F.col("iteration") + 1, F.lit(period)) == 0) | (F.col("iteration") == max_iter - 1)
    if epoch_iters:
        at = at | (F.pmod(F.col("iteration") + 1, F.lit(epoch_iters)) == 0)
    return df.filter(at)


#: Rows of a series that are joined as one bucket.
_BUCKET = 1024


def progress(df: DataFrame, max_iter: int, period: int = 20) -> DataFrame:
    """Iteration, data_time (mean of 20), time (mean of all), eta_seconds, lr (latest) and a column for each
    loss (median of 200), as they stand at each iteration that is due. None is due at max_iter or after.

    Means and medians are taken for the iterations that are due alone: each asks for a range
    of places in its series, which meets the rows by buckets of places, so the work is dealt
    by name and bucket and falls with the period.
    """
    rows = df.filter(F.col("name").isin("data_time", "time", "lr") | F.col("name").contains("loss")).filter(F.col("iteration") < max_iter)
    placed, _ = _series(rows)
    placed = placed.select("name", "iteration", "value", F.col("_place").alias("place"), F.when(F.col("_count") > 0, F.col("_sum") / F.col("_count")).alias("ever"))
    placed = settle(placed.withColumn("bucket", F.floor(F.col("place") / _BUCKET)), "series")
    # the iteration at which a row is first seen, and what is newest there
    due_at = F.least(F.lit(max_iter - 1), F.ceil((F.col("iteration") + 1) / period) * period - 1).cast("long")
    newest = placed.groupBy("name", due_at.alias("iteration")).agg(F.max(F.struct("place", "ever", "value")).alias("r"))
    names = [r.name for r in newest.select("name").distinct().orderBy("name").collect()]
    marks = due(placed.select("iteration").distinct(), max_iter, period).select(F.explode(F.array(*map(F.lit, names))).alias("name"), "iteration")
    far = Window.partitionBy("name").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    at = newest.join(marks.withColumn("asked", F.lit(True)), ["name", "iteration"], "full").withColumn("r", F.last("r", True).over(far))
    at = at.filter("asked AND r IS NOT NULL").select("name", "iteration", "r.*")
    name = F.col("name")
    n = F.when(name == "data_time", 20).when(name == "time", 1000).when(name.contains("loss"), 200)
    asked = at.withColumn("n", n).filter("n IS NOT NULL").withColumn("low", F.greatest(F.lit(1), F.col("place") - F.col("n") + 1))
    asked = asked.select("name", "iteration", "low", F.col("place").alias("high"), F.explode(F.sequence(F.floor(F.col("low") / _BUCKET), F.floor(F.col("place") / _BUCKET))).alias("bucket"))
    inside = asked.join(placed.select("name", "bucket", "place", "value"), ["name", "bucket"]).filter("place BETWEEN low AND high")
    last = inside.groupBy("name", "iteration").agg(F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"))
    shown = F.when(name == "data_time", F.col("mean")).when(name == "time", F.col("ever")).when(name.contains("loss"), F.col("median")).otherwise(F.col("value"))
    all_ = at.join(last, ["name", "iteration"], "left").select("name", "iteration", shown.alias("v"), F.when(name == "time", F.col("median")).alias("pace"))
    cells = [F.max(F.when(F.col("name") == x, F.col("v"))).alias(x) for x in names]
    return all_.groupBy("iteration").agg(*cells, (F.max("pace") * (max_iter - F.col("iteration") - 1)).alias("eta_seconds"))


def step_time(df: DataFrame, warmup: int = 3) -> DataFrame:
    """One row: n (steps), total (seconds from step `warmup` on), mean (total by n - warmup, as it is reported) and
    plain_mean (total by the number of steps in it)."""
    early = df.orderBy(*ORDER).limit(warmup - 1).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("e"))
    all_ = df.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")).join(F.broadcast(early))
    total = F.col("s") - F.col("e")
    return all_.select("n", total.alias("total"), F.when(F.col("n") > warmup, total / (F.col("n") - warmup)).alias("mean"), (total / (F.col("n") - warmup + 1)).alias("plain_mean"))


def over_workers(df: DataFrame, average: bool = True) -> DataFrame:
    """The mean or sum of a name's values in an iteration."""
    return df.groupBy("iteration", "name").agg((F.avg if average else F.sum)("value").alias("value"))


def best_epochs(df: DataFrame, period: int, max_epoch: int) -> DataFrame:
    """Epochs at which something is kept: periodic, final, and best (strictly above all kept before; from -1 on; a
    missing metric is -1). There is a row for each epoch, so they fit one window."""
    kept = df.filter((F.pmod(F.col("epoch") + 1, F.lit(period)) == 0) | (F.col("epoch") >= max_epoch - 1)).withColumn("metric", F.coalesce("metric", F.lit(-1.0)))
    before = F.coalesce(F.max("metric").over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1.0))
    final = F.col("epoch") >= max_epoch - 1
    return kept.select("epoch", "metric", (F.col("metric") > F.greatest(before, F.lit(-1.0))).alias("best"), (~final).alias("periodic"), final.alias("final"))


def first_n(df: DataFrame, n: int = 1, key: tuple[str, ...] = ("caller",)) -> DataFrame:
    """The first n records of each caller, message, or both."""
    w = Window.partitionBy(*key).orderBy("seq")
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def every_n(df: DataFrame, n: int) -> DataFrame:
    """The first and then every n-th record of each caller."""
    w = Window.partitionBy("caller").orderBy("seq")
    return df if n == 1 else df.withColumn("_rank", F.row_number().over(w)).filter(F.pmod("_rank", F.lit(n)) == 1).drop("_rank")


def _passage(t: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """What sorted times do to the last kept time that comes in: (bounds, exits); one that allows a record from time x on
    leaves as the exit of the first bound that is not below x, and as it came where there is none.

    Each record's jump to the next one that is kept after it is found by binary search; jumps are doubled until they leave.
    """
    n = len(t)
    jump = np.append(np.searchsorted(t, t + least), n)
    at = np.where(jump < n, jump, np.arange(n + 1))
    while (at[at] != at).any():
        at = at[at]
    # a time that comes in is not after the first here, so no record after `least` more is the first that it allows
    m = min(n, int(np.searchsorted(t, t[0] + least)) + 1)
    exits = t[at[:m]]
    last = np.append(exits[1:] != exits[:-1], True)
    return t[:m][last], exits[last]


def _entries(spread: DataFrame, least: int) -> DataFrame:
    """_part, caller, entry: the last kept time (microseconds) before a range, for callers whose records are in several."""
    timed = spread.filter("ts IS NOT NULL").select("_part", "caller", "ts")
    ranges = timed.select("_part", "caller").distinct().groupBy("caller").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("caller")
    long = timed.join(ranges, timed.caller.eqNullSafe(ranges.caller), "left_semi")

    def passage(key, table):
        bounds, exits = _passage(np.sort(table.column("ts").cast(pa.int64()).to_numpy()), least)
        return pa.table({"_part": pa.array([key[0].as_py()], pa.int32()), "caller": pa.array([key[1].as_py()], pa.string()), "bounds": pa.array([bounds]), "exits": pa.array([exits])})

    def chain(key, table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("_part", "bounds", "exits")), strict=True))
        last, entries = None, []
        for _, bounds, exits in rows:
            entries.append(last)
            at = 0 if last is None else bisect_left(bounds, last + least)
            last = exits[at] if at < len(bounds) else last
        return pa.table({"_part": pa.array([r[0] for r in rows], pa.int32()), "caller": pa.array([key[0].as_py()] * len(rows), pa.string()), "entry": pa.array(entries, pa.int64())})

    passages = long.groupBy("_part", "caller").applyInArrow(passage, "_part int, caller string, bounds array<long>, exits array<long>")
    return passages.groupBy("caller").applyInArrow(chain, "_part int, caller string, entry long")


def every_n_seconds(df: DataFrame, seconds: float) -> DataFrame:
    """A record is kept if the caller's last kept one is at least so many seconds older. A record without a time is kept
    and counts for nothing.

    Records are dealt by range, so that a caller with very many is in several tasks. What a range of its records does to the last
    kept time is a step function of few steps; these are composed range by range, which gives
    each range the time that comes in, and then all ranges are read side by side.
    """
    least = round(seconds * 1_000_000)
    spread = in_ranges(df.withColumn("caller", F.col("caller").cast("string")), "caller", "ts", "seq")
    entries = settle(_entries(spread, least), "entries")
    entries = entries.select(F.col("_part").alias("_in"), F.col("caller").alias("_caller"), "entry")
    rows = spread.join(entries, (F.col("_part") == F.col("_in")) & F.col("caller").eqNullSafe(F.col("_caller")), "left").drop("_in", "_caller")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for batch in batches:
            keep = []
            for p, c, t, e in zip(batch.column("_part").to_pylist(), batch.column("caller").to_pylist(), batch.column("ts").cast(pa.int64()).to_pylist(), batch.column("entry").to_pylist(), strict=True):
                if (p, c) != at:
                    at, last = (p, c), e
                ok = t is None or last is None or t - last >= least
                if ok and t is not None:
                    last = t
                keep.append(ok)
            yield batch.filter(pa.array(keep, type=pa.bool_())).select(names)

    names = df.columns
    return rows.repartition("_part", "caller").sortWithinPartitions("_part", "caller", "ts", "seq").mapInArrow(run, df.schema)
