"""Ordered folds as windows: source health, aggregate caps, budgets, expiring caches, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ORDER
from .graph import ensure_checkpoint_dir

FAILURES, RESETS = ("retryable_failure", "fatal_failure"), ("success", "empty")
#: Planning cost of one paid call, by source.
COST_PER_CALL = {"google": 0.02, "yelp": 0.02}


def segmented(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df with __seg: ranges of (key, order) of about equal size, so that a key with most rows lies in many of them.

    Later segments of a key hold later rows.  The rows are written to the shared folder once, as a range is only the same range for whoever reads it later
    when it is not sampled again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(n, key, *order).withColumn("__seg", F.spark_partition_id()).checkpoint()


def running_sum(df: DataFrame, value: str, key: str, order: list[str], out: str) -> DataFrame:
    """df with the sum of value over the key's rows up to each, in order.

    Two levels: sums inside a segment, and sums of whole segments before it (a row for each key and segment).
    """
    placed = segmented(df, key, order)
    inside = Window.partitionBy(key, "__seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("__k").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.groupBy(F.col(key).alias("__k"), F.col("__seg").alias("__s")).agg(F.sum(value).alias("__whole"))
    whole = whole.withColumn("__before", F.coalesce(F.sum("__whole").over(before), F.lit(0)))
    joined = placed.withColumn("__sum", F.sum(value).over(inside)).join(whole, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__seg") == F.col("__s")))
    return joined.withColumn(out, F.coalesce("__sum", F.lit(0)) + F.col("__before")).select(*df.columns, out)


def health(events: DataFrame, threshold: int = 3, source: str = "source", order: str = "ts", tie: str = "event_id") -> DataFrame:
    """events with the source's consecutive failures after each, and its status.

    success and empty reset the streak, skipped leaves it.  status: healthy, degraded (a failure since
    the last reset) or threshold (streak at the threshold).  A source's streak is counted inside segments and carried from one to the next.
    """
    placed = segmented(events, source, [order, tie])
    inside = Window.partitionBy(source, "__seg").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.withColumn("__resets", F.sum(F.col("outcome").isin(*RESETS).cast("int")).over(inside))
    group = Window.partitionBy(source, "__seg", "__resets").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("__streak", F.sum(F.col("outcome").isin(*FAILURES).cast("int")).over(group))
    ends = counted.groupBy(F.col(source).alias("__k"), F.col("__seg").alias("__s")).agg(F.max("__resets").alias("__had"), F.max_by("__streak", F.struct(order, tie, "__resets", "__streak")).alias("__tail"))
    along = Window.partitionBy("__k").orderBy("__s")
    since = ends.withColumn("__g", F.sum((F.col("__had") > 0).cast("int")).over(along))
    end = since.withColumn("__end", F.sum("__tail").over(Window.partitionBy("__k", "__g").orderBy("__s").rowsBetween(Window.unboundedPreceding, 0)))
    carried = end.select("__k", "__s", F.coalesce(F.lag("__end").over(along), F.lit(0)).alias("__carry"))
    out = counted.join(carried, F.col(source).eqNullSafe(F.col("__k")) & (F.col("__seg") == F.col("__s")))
    out = out.withColumn("consecutive_failures", F.col("__streak") + F.when(F.col("__resets") == 0, F.col("__carry")).otherwise(0)).select(*events.columns, "consecutive_failures")
    return out.withColumn("health", F.when(F.col("consecutive_failures") >= threshold, "threshold").when(F.col("consecutive_failures") > 0, "degraded").otherwise("healthy"))


def health_counts(events: DataFrame, source: str = "source") -> DataFrame:
    kinds = (*RESETS, *FAILURES, "skipped")
    return events.groupBy(source).agg(F.count("*").alias("attempts"), *[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])


def cap_rows(df: DataFrame, total: int | None = None, per_source: int | None = None, per_location: int | None = None, source: str = "source", location: str = "location", order: str = ORDER) -> DataFrame:
    """Rows an acquisition with these caps takes, in input order.

    Caps intersect one after another: rows over their source's cap do not use up their location's, and
    rows over either do not use up the total.
    """
    out = df
    for cap, keys in ((per_source, [source]), (per_location, [location])):
        if cap is not None:
            w = Window.partitionBy(*keys).orderBy(order)
            out = out.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap).drop("__n")
    return out.orderBy(order).limit(total) if total is not None else out


def remaining(limits: dict[str, int | None], used: dict[str, int], task_limit: int | None) -> tuple[int | None, str | None]:
    """How many records the next task may take, or why it is skipped: total, then source, then location."""
    options = [] if task_limit is None else [task_limit]
    for name in ("total", "source", "location"):
        cap = limits.get(name)
        if cap is None:
            continue
        left = cap - used.get(name, 0)
        if left <= 0:
            return None, f"{name} records cap reached"
        options.append(left)
    return (min(options) if options else None), None


def cache_lookup(requests: DataFrame, cache: DataFrame, as_of: Column, ttl_days: dict[str, int] | None = None, default_ttl: int = 90) -> DataFrame:
    """requests(source, source_id) with hit and value: the newest entry of the key that is still within its source's time.

    A time to live of 0 or less never hits.
    """
    newest = cache.groupBy("source", "source_id").agg(F.max("fetched_at").alias("fetched_at"), F.max_by("value", "fetched_at").alias("value"))
    ttl = F.lit(default_ttl)
    for name, days in (ttl_days or {}).items():
        ttl = F.when(F.col("source") == name, F.lit(days)).otherwise(ttl)
    out = requests.join(newest, ["source", "source_id"], "left")
    live = F.coalesce((ttl > 0) & (F.col("fetched_at") > as_of - F.make_dt_interval(ttl)), F.lit(False))
    return out.withColumn("hit", live).withColumn("value", F.when(F.col("hit"), F.col("value")))


def cache_put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache after insert-or-replace: the newest entry of each key."""
    both = cache.unionByName(entries)
    return both.groupBy("source", "source_id").agg(F.max_by("value", "fetched_at").alias("value"), F.max("fetched_at").alias("fetched_at"))


def spend_budget(requests: DataFrame, max_calls: int | dict[str, int | None], order: str = ORDER) -> DataFrame:
    """requests (source, source_id, hit) with action: hit, paid, repeat or skipped.

    In row order the first `max_calls` misses of a source are paid (None: all).  A repeated id is a miss only until it is
    paid for, then a hit ('repeat'); an id beyond the cap stays skipped.  Ids are counted once each, whatever their number of requests, and numbered in segments.
    """
    ids = requests.groupBy("source", "source_id").agg(F.min(order).alias("__first"), F.min_by("hit", order).alias("__hit"))
    asked = ids.withColumn("__miss", (~F.col("__hit")).cast("int"))
    caps = max_calls if isinstance(max_calls, dict) else None
    bounded = [s for s, c in caps.items() if c is not None] if caps is not None else None
    cap = F.lit(max_calls) if caps is None else F.coalesce(F.create_map(*[F.lit(x) for s in bounded for x in (s, caps[s])])[F.col("source")] if bounded else F.lit(None).cast("int"), F.lit(0))
    free = F.lit(False) if caps is None else F.col("source").isin([s for s, c in caps.items() if c is None])
    ranked = running_sum(asked, "__miss", "source", ["__first", "source_id"], "__nth")
    over = ranked.select(F.col("source").alias("__s"), F.col("source_id").alias("__i"), "__first", (~F.col("__hit")).alias("__counts"), (~F.col("__hit") & ~free & (F.col("__nth") > cap)).alias("__over"))
    out = requests.join(over, F.col("source").eqNullSafe(F.col("__s")) & F.col("source_id").eqNullSafe(F.col("__i")))
    action = F.when(F.col("hit"), "hit").when(F.col("__over"), "skipped").when(F.col("__counts") & (F.col(order) == F.col("__first")), "paid").otherwise("repeat")
    return out.withColumn("action", action).select(*requests.columns, "action")


def task_counts(tasks: DataFrame, by: str = "source") -> DataFrame:
    """(by, rows) of the tasks that succeeded or found nothing."""
    return tasks.where(F.col("outcome").isin(*RESETS)).groupBy(by).agg(F.sum("raw_count").alias("rows"))


def costs(calls: DataFrame) -> DataFrame:
    """(source, calls, cost) of paid calls; a total row has source 'total'."""
    each = F.lit(0.0)
    for name, cost in COST_PER_CALL.items():
        each = F.when(F.col("source") == name, F.lit(cost)).otherwise(each)
    per = calls.groupBy("source").agg(F.count("*").alias("calls")).withColumn("cost", F.round(F.col("calls") * each, 2))
    return per.union(per.agg(F.lit("total"), F.coalesce(F.sum("calls"), F.lit(0)), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 2)))


def capped(spent: int, cap: int | None) -> bool:
    """A cap of 0 counts as reached without a call."""
    return cap is not None and spent >= cap
