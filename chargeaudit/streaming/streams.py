"""Structured Streaming: request limits, audits as bills arrive, deadlines, repeated lines and stuck requests.

The batch twins of the aggregations take a static frame.  A query on the files of a table runs its stream to the
end with ``availableNow`` into a folder below the shared checkpoint folder and returns what was written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.bridge import shared_folder

HOUR = 3600


def over_limit(events: DataFrame, limit: int, seconds: int = HOUR) -> DataFrame:
    """Events that bring their user above ``limit`` within the trailing window."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("_at", at).select("event_id", "user_id", F.count("*").over(w).alias("n")).filter(F.col("n") > limit)


def totals(events: DataFrame, length: str = "1 day") -> DataFrame:
    """Number and sum of values for each user and window; the same on a stream with a watermark."""
    per = events.groupBy("user_id", F.window("ts", length).alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return per.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", F.col("total").cast("double").alias("total"))


def requests_per_window(events: DataFrame, limit: int, length: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Users and sliding windows with more than ``limit`` requests.

    The windows that start within one length are counted together: a request enters two such groups at most, not each window that holds it.
    """
    size, step = (pd.Timedelta(x) // pd.Timedelta(microseconds=1) for x in (length, slide))
    n = -(-size // step)
    at, micros = F.unix_micros("ts"), lambda x: F.expr(f"INTERVAL '{x}' MICROSECOND")
    group = F.window("ts", f"{(n - 1) * step + size} microseconds", f"{n * step} microseconds")
    per = events.withWatermark("ts", late).select("user_id", "ts", group.alias("w"))
    begin = F.unix_micros("w.start")
    counts = [F.count_if((at >= begin + k * step) & (at < begin + k * step + size)).alias(f"_{k}") for k in range(n)]
    held = per.groupBy("user_id", "w").agg(*counts)
    each = F.explode(F.array(*[F.struct((F.col("w.start") + micros(k * step)).alias("start"), F.col(f"_{k}").alias("n")) for k in range(n)]))
    return held.select("user_id", each.alias("x")).select("user_id", "x.start", "x.n").filter(F.col("n") > limit)


def unanswered(requests: DataFrame, answers: DataFrame, within: str, late: str = "10 minutes") -> DataFrame:
    """Requests (user_id, ts, event_id) with their answer within the time, or null once it is past."""
    r = requests.withWatermark("ts", late).select("user_id", F.col("ts").alias("asked"), F.col("event_id").alias("request_id"))
    a = answers.withWatermark("ts", late).select(F.col("user_id").alias("_user"), F.col("ts").alias("answered"), F.col("event_id").alias("answer_id"))
    on = (F.col("user_id") == F.col("_user")) & (F.col("answered") >= F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"INTERVAL {within}"))
    return r.join(a, on, "left").select("request_id", "user_id", "asked", "answer_id")


def first_only(rows: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows whose keys did not turn up within the watermark before."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def stuck(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user, by gaps without any event, in which nothing was completed."""
    per = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("done"))
    return per.filter("done = 0").select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    # the star lets a table be one file as well as a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


#: The state store that holds its state on disk, and keeps lists and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and reads its sink."""
    spark, folder = df.sparkSession, _folder(df.sparkSession)
    q = df.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def run_on_disk(df: DataFrame, mode: str = "append") -> DataFrame:
    """:func:`run` with a state store on disk, which is set for this stream alone."""
    conf = df.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, STORE)
    try:
        return run(df, mode)
    finally:
        if before is None:
            conf.unset(PROVIDER)
        else:
            conf.set(PROVIDER, before)


def each_batch(df: DataFrame, audit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Audits every micro-batch and writes it under its number, so that a batch that runs again replaces itself."""
    spark, folder = df.sparkSession, _folder(df.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        audit(batch).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    df.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    try:
        return spark.read.parquet(f"{folder}/out").drop("batch")
    except AnalysisException:  # no batch came
        return audit(spark.createDataFrame([], df.schema))


def closed(events: DataFrame, table: DataFrame, kinds: list[str], after: str = "30 days") -> DataFrame:
    """The stream ``events`` with one row of a user below zero for each kind, long after the last row of ``table``, so that its end closes what is open.

    Such rows stay open themselves, for no watermark passes them, and no two of them have one user.
    """
    spark, path = events.sparkSession, f"{_folder(events.sparkSession)}/end"
    rows = table.agg((F.max("ts").cast("timestamp") + F.expr(f"INTERVAL {after}")).alias("ts")).filter("ts IS NOT NULL")
    end = rows.select(F.posexplode(F.array(*map(F.lit, kinds))).alias("_at", "event_type"), "ts").withColumn("user_id", -1 - F.col("_at").cast("long"))
    end.select(*[F.col(f.name) if f.name in ("ts", "event_type", "user_id") else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]).write.parquet(path)
    return events.union(spark.readStream.schema(events.schema).parquet(path))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _closed_events(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    return closed(_events(spark, sf_dir), spark.read.parquet(f"{sf_dir}/events.parquet"), list(kinds))


def audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving lines above 1.5 times their part's price."""
    from ..sources.bridge import benchmarks

    rates = benchmarks(spark, sf_dir).select(F.col("code").alias("l_partkey"), F.col("rate").cast("double").alias("rate"))

    def audit(batch: DataFrame) -> DataFrame:
        j = batch.join(rates, "l_partkey")
        return j.filter(F.col("l_extendedprice") > 1.5 * F.col("rate") * F.col("l_quantity")).select(F.col("l_orderkey").alias("bill_id"), "l_linenumber", F.col("l_extendedprice").alias("billed"), (F.col("rate") * F.col("l_quantity")).alias("benchmark"))

    return each_batch(source(spark, sf_dir, "lineitem"), audit)


def sla_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups with each purchase that follows within a day, or none."""
    e = _closed_events(spark, sf_dir, "signup", "purchase")
    return _plain(run(unanswered(e.filter("event_type = 'signup'"), e.filter("event_type = 'purchase'"), "1 day")))


def dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user, type and day in which the user had an event of the type: the first that comes is passed on."""
    days = _events(spark, sf_dir).select("user_id", "event_type", "ts", F.date_trunc("day", "ts").alias("day"))
    return _plain(run(first_only(days, ["user_id", "event_type", "day"]).select("user_id", "event_type", "day")))


def stuck_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in which nothing was bought."""
    return _plain(run(stuck(_closed_events(spark, sf_dir, "click"))))


def _plain(df: DataFrame) -> DataFrame:
    """Times without a zone."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])
