"""Telemetry of crawls: metrics, retries, rates, state machines over ordered requests.

Requests are rows of ``(key, ts, ok, seconds, ...)``.  State machines run over
rows that come partitioned by key and sorted by time, and keep only the state
of the current key, so that a key with very many rows needs no more memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: words by which errors are classified, buckets of histograms --------------------
CRAWL_BUCKETS = [10, 30, 60, 300, 600, 1800, 3600]
FETCH_BUCKETS = [0.1, 0.5, 1, 2, 5, 10]
RECOVERY_WORDS = [
    ("network", ["timeout", "connection", "dns", "network", "unreachable", "refused", "reset", "timed out"]),
    ("driver", ["driver", "browser", "playwright", "selenium", "webdriver", "crash", "terminated"]),
    ("parsing", ["parse", "html", "decode", "encoding", "malformed", "invalid markup", "beautifulsoup"]),
    ("storage", ["storage", "disk", "write", "save", "database", "sqlite", "mongodb", "no space"]),
]
# --- end of fixed values --------------------------------------------------------------------------


def _has(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(w.replace(".", r"\.") for w in words))


def error_category(kind: Column, message: Column) -> Column:
    """Category of an error from the name of its type and its message."""
    k, m = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(_has(k, ["connection", "timeout", "network"]) | _has(m, ["connection", "timeout", "network"]), "network")
        .when(_has(k, ["http", "status"]) | _has(m, ["404", "500", "502", "503"]), "http")
        .when(_has(k, ["parse", "decode", "encoding"]), "parsing")
        .when(_has(k, ["validation", "invalid"]), "validation")
        .when(_has(k, ["auth", "permission", "forbidden"]) | _has(m, ["401", "403", "unauthorized", "forbidden"]), "authentication")
        .when(_has(m, ["rate", "429"]), "rate_limit")
        .when(_has(k, ["driver", "playwright", "selenium"]), "driver")
        .otherwise("unknown")
    )


def error_severity(category: Column, message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when((category == "validation") | _has(m, ["fatal", "critical"]), "critical")
        .when(category.isin("authentication", "rate_limit") | _has(m, ["500", "502", "503"]), "high")
        .when(category.isin("network", "driver") | _has(m, ["timeout"]), "medium")
        .when(_has(m, ["404"]), "low")
        .otherwise("medium")
    )


def is_retryable(category: Column, message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    never = category.isin("validation", "authentication") | _has(m, ["404", "401", "403"]) | (_has(m, ["invalid"]) & _has(m, ["url"]))
    return ~never & category.isin("network", "http", "driver", "rate_limit", "parsing")


def recovery_kind(message: Column) -> Column:
    """Kind of an error by the words of its message, first list that has one; else ``unknown``."""
    m = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("unknown")
    for name, words in reversed(RECOVERY_WORDS):
        out = F.when(_has(m, words), name).otherwise(out)
    return out


def retry_delay(status: Column, attempt: Column, base: float = 1.0) -> Column:
    """base * factor * 2^attempt, the factor 3 for 429, 0.5 for 503 (no jitter)."""
    factor = F.when(status == 429, 3.0).when(status == 503, 0.5).otherwise(1.0)
    return F.lit(base) * factor * F.pow(F.lit(2.0), attempt)


def crawl_metrics(requests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pages, failures, times and rates, per group or over all."""
    grouped = requests.groupBy(*by) if by else requests.groupBy()
    n = F.count(F.lit(1))
    return grouped.agg(
        n.alias("n_requests"),
        F.count_if("ok").alias("n_ok"),
        F.count_if(~F.col("ok")).alias("n_failed"),
        F.avg("seconds").alias("avg_seconds"),
        F.min("seconds").alias("min_seconds"),
        F.max("seconds").alias("max_seconds"),
        F.coalesce(F.count_if("ok") * 100.0 / F.when(n > 0, n), F.lit(0.0)).alias("success_percent"),
    )


def histogram(requests: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts of a value per upper bound: ``(bound, n)``, the last bound without limit."""
    row = requests.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("rest"))
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("bound"), F.col("rest").alias("n")))
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def dead_letters(requests: DataFrame, *, max_attempts: int = 3) -> DataFrame:
    """Keys whose last requests failed: attempts since the last success, and when to retry.

    ``(key, attempts, first_failed, last_failed, last_error, permanent, retry_after)``;
    times in epoch seconds; the delay doubles per attempt, permanent failures
    have none.  Of failures at one time the greatest error text is the last.
    """
    # Two combinable aggregations instead of a window per key.
    good = requests.where("ok").groupBy("key").agg(F.max("ts").alias("good"))
    failed = requests.where(~F.col("ok")).join(good, "key", "left").where(F.col("good").isNull() | (F.col("ts") > F.col("good")))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    agg = failed.groupBy("key").agg(F.count(F.lit(1)).alias("attempts"), seconds(F.min("ts")).alias("first_failed"), seconds(F.max("ts")).alias("last_failed"), F.max(F.struct("ts", "error"))["error"].alias("last_error"))
    permanent = F.col("attempts") >= max_attempts
    return agg.withColumn("permanent", permanent).withColumn("retry_after", F.when(~permanent, F.col("last_failed") + F.pow(F.lit(2.0), F.col("attempts") - 1)))


def consecutive_errors(requests: DataFrame) -> DataFrame:
    """Longest run of failures of each key: ``(key, longest_run)``."""
    w = Window.partitionBy("key").orderBy("ts", "id")
    island = requests.withColumn("island", F.sum(F.col("ok").cast("int")).over(w)).where(~F.col("ok"))
    runs = island.groupBy("key", "island").agg(F.count(F.lit(1)).alias("run")).groupBy("key").agg(F.max("run").alias("longest_run"))
    return requests.select("key").distinct().join(runs, "key", "left").select("key", F.coalesce("longest_run", F.lit(0)).alias("longest_run"))


def sliding_rate(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests of the key in the window that ends with each request: ``(id, key, n_recent)``."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("key").orderBy("at").rangeBetween(-seconds * 1_000_000, 0)
    return requests.withColumn("at", at).select("id", "key", F.count(F.lit(1)).over(w).alias("n_recent"))


def fixed_rate(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests per key and fixed window: ``(key, window_start, n)``."""
    return requests.groupBy("key", F.window(F.col("ts"), f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("key", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


def last_n(rows: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` rows of each key."""
    w = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("id"))
    return rows.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def session_count(requests: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each key, split where it pauses longer than ``gap``: ``(key, session_start, n)``."""
    return requests.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("key", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def _fold(start: Callable, step: Callable):
    """Fold over rows that come sorted by key and time; yields (id, key, value) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for b in batches:
            ids, values = b.column(0), []
            for key, *row in zip(*(c.to_pylist() for c in b.columns[1:5])):
                if key != current:
                    current, state = key, start()
                state, out = step(state, *row)
                values.append(out)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(values, pa.float64())], names=["id", "key", "value"]) if len(ids) else b

    return run


def _ordered(requests: DataFrame) -> DataFrame:
    kind = dict(requests.dtypes)["key"]
    rows = requests.select(F.col("id").cast("long").alias("id"), "key", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "ok", F.col("seconds").cast("double").alias("seconds"))
    return rows.repartition("key").sortWithinPartitions("key", "t", "id"), f"id bigint, key {kind}, value double"


def throttle(requests: DataFrame, *, start: float = 0.5, low: float = 0.1, high: float = 5.0, every: int = 10, recent: int = 100) -> DataFrame:
    """Delay of an adaptive throttle after each request: ``(id, key, delay)``.

    Every ``every`` requests: more than 10 % errors in the last ``recent`` raise
    it by half, else a mean time below 0.5 s lowers it by a fifth.
    """

    def begin():
        return [start, 0, deque(maxlen=recent), deque(maxlen=recent)]

    def step(state, t, ok, seconds):
        state[1] += 1
        state[2].append(0 if ok else 1)
        if ok and seconds is not None:
            state[3].append(seconds)
        if state[1] % every == 0:
            if sum(state[2]) / len(state[2]) > 0.1:
                state[0] = min(high, state[0] * 1.5)
            elif state[3] and sum(state[3]) / len(state[3]) < 0.5:
                state[0] = max(low, state[0] * 0.8)
        return state, state[0]

    rows, schema = _ordered(requests)
    return rows.mapInArrow(_fold(begin, step), schema).withColumnRenamed("value", "delay")


def token_bucket(requests: DataFrame, *, rate: float = 2.0, capacity: float | None = None) -> DataFrame:
    """Wait of each request at a token bucket of its key: ``(id, key, wait)``."""
    full = 2 * rate if capacity is None else capacity

    def step(state, t, ok, seconds):
        tokens, last = state
        tokens = min(full, tokens + (t - last) * rate) if last is not None else full
        if tokens >= 1:
            return (tokens - 1, t), 0.0
        wait = (1 - tokens) / rate
        return (tokens - 1, t), wait

    rows, schema = _ordered(requests)
    return rows.mapInArrow(_fold(lambda: (full, None), step), schema).withColumnRenamed("value", "wait")


def dns_cache(requests: DataFrame, *, ttl: float = 3600.0) -> DataFrame:
    """Whether each lookup of a key hits a cache of that lifetime: ``(id, key, hit)`` with 1.0 or 0.0."""

    def step(state, t, ok, seconds):
        return (state, 1.0) if state is not None and t <= state + ttl else (t, 0.0)

    rows, schema = _ordered(requests)
    return rows.mapInArrow(_fold(lambda: None, step), schema).withColumnRenamed("value", "hit")


def proxy_scores(requests: DataFrame, *, least_requests: int = 10, good_rate: float = 0.5) -> DataFrame:
    """Per key (proxy): requests, success rate, mean seconds of successes, and whether it is good to use."""
    agg = requests.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("rate"), F.avg(F.when(F.col("ok"), F.col("seconds"))).alias("avg_seconds"))
    return agg.withColumn("good", (F.col("rate") >= good_rate) | (F.col("n") < least_requests))


def best_proxies(requests: DataFrame, n: int) -> DataFrame:
    """The ``n`` best good keys: by rate, then by speed, then by key."""
    return proxy_scores(requests).where("good").orderBy(F.desc("rate"), F.asc_nulls_last("avg_seconds"), "key").limit(n)


def round_robin(requests: DataFrame, pool: list[str]) -> DataFrame:
    """Pool member for each request in order of its id: ``(id, member)``.  Ids are dense from 0."""
    return requests.select("id", F.get(F.array(*map(F.lit, pool)), F.pmod(F.col("id"), F.lit(len(pool))).cast("int")).alias("member"))


def queue_stats(queue: DataFrame) -> DataFrame:
    """One row: entries per status, zero where there are none, and the total."""
    names = ["pending", "processing", "done", "failed"]
    return queue.agg(*[F.count_if(F.col("status") == s).alias(s) for s in names], F.count(F.lit(1)).alias("total"))


def queue_push(queue: DataFrame, new: DataFrame) -> DataFrame:
    """Queue with the urls that a scan does not have yet, as pending."""
    fresh = new.dropDuplicates(["scan_id", "url"]).join(queue.select("scan_id", "url"), ["scan_id", "url"], "left_anti").withColumn("status", F.lit("pending"))
    return queue.unionByName(fresh, allowMissingColumns=True)


def queue_pop(queue: DataFrame, n: int) -> DataFrame:
    """The next ``n`` pending entries: highest priority, then oldest, then id."""
    return queue.where(F.col("status") == "pending").orderBy(F.desc("priority"), "created_at", "id").limit(n)


def queue_reset_stuck(queue: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """Entries that are processing for longer than ``seconds`` are pending again."""
    stuck = (F.col("status") == "processing") & (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("processed_at").cast("timestamp")) > seconds * 1_000_000)
    return queue.withColumn("status", F.when(stuck, "pending").otherwise(F.col("status")))


def jobs_page(jobs: DataFrame, *, status: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Jobs, newest first, a page at a time."""
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), "job_id").offset(offset).limit(limit)


def status_counts(responses: DataFrame) -> DataFrame:
    return responses.groupBy("status_code").agg(F.count(F.lit(1)).alias("n"))
