"""Streaming queries: a file source run to its end must give what the batch gives."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from tidemark.columns import snap
from tidemark.plans.knowledge_queries import _BREACH as BREACH
from tidemark.plans.knowledge_queries import _rules as rules
from tidemark.plans.registry import query
from tidemark.plans.sql import BARS, roll
from tidemark.plans.sql import snap as s
from tidemark.plans.store_queries import scratch
from tidemark.sources.bars import daily_bars
from tidemark.sources.tables import table
from tidemark.streaming import stateful as sf
from tidemark.streaming import streams as st


def event_stream(spark, folder):
    """The events table as a stream, ``ts`` as an instant."""
    schema = table(spark, folder, "events").schema
    raw = st.read_files(spark, folder, schema, glob="events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def samples(spark, folder):
    return event_stream(spark, folder).select(F.col("event_type").alias("name"), "ts", "value", "event_id")


@contextlib.contextmanager
def setting(spark, name, value):
    """A session setting for the length of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drain(spark, stream, name):
    """Run a stream to its end."""
    folder = scratch(spark, name)
    return st.finish(st.to_folder(stream, folder), spark, folder)


def backfilled(spark, source, name, build):
    """Run a stream to its end and close its windows."""
    return st.backfill(build, source, scratch(spark, name))


@query(
    "stream_windows",
    f"""SELECT event_type AS name, time_bucket(INTERVAL 15 MINUTE, ts) AS start, count(*) AS count, min(value) AS min, max(value) AS max, {s('avg(value)')} AS mean FROM events GROUP BY 1, 2""",
)
def stream_windows(spark, folder):
    out = backfilled(spark, samples(spark, folder), "windows", lambda rows: sf.windowed(rows, "15 minutes"))
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "mean": snap(F.col("mean"))})


@query("stream_deduplicated", "SELECT event_id, event_type AS name FROM events")
def stream_deduplicated(spark, folder):
    """Every message twice; each is kept once."""
    twice = samples(spark, folder).unionByName(samples(spark, folder))
    return drain(spark, sf.deduplicated(twice, ["event_id"]), "dedup").select("event_id", "name")


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
    k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS rows FROM k GROUP BY user_id, run""",
)
def stream_sessions(spark, folder):
    out = backfilled(spark, event_stream(spark, folder), "sessions", lambda rows: sf.sessions(rows, ["user_id"], "2 hours"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "rows")


@query(
    "stream_alerts",
    f"""WITH RECURSIVE {BREACH}, c AS (SELECT rule_id, (floor(floor(epoch(ts)) / 60) * 60)::BIGINT AS tick, count(*) AS samples FROM b GROUP BY 1, 2),
    go AS (SELECT rule_id, min(tick) AS tick FROM c GROUP BY 1 UNION ALL SELECT g.rule_id, (SELECT min(c.tick) FROM c WHERE c.rule_id = g.rule_id AND c.tick >= g.tick + 3600) AS tick FROM go g WHERE g.tick IS NOT NULL)
    SELECT rule_id, tick, samples FROM go JOIN c USING (rule_id, tick)""",
)
def stream_alerts(spark, folder):
    with rocks_state(spark):
        return backfilled(spark, samples(spark, folder), "alerts", lambda rows: sf.alerts(rows, rules(spark), "1 minute", 3600))


@query(
    "stream_quality",
    f"""SELECT event_type AS source, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS rows, CAST(sum((event_id % 11 = 0)::INT) AS BIGINT) AS empty, {s('sum((event_id % 11 = 0)::INT) / (count(*) * 2.0)')} AS empty_rate FROM events GROUP BY 1, 2""",
)
def stream_quality(spark, folder):
    rows = event_stream(spark, folder).select(
        F.col("event_type").alias("source"), "ts", "value", F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("props")).alias("props")
    )
    out = backfilled(spark, rows, "quality", lambda rows: sf.quality(rows, ["value", "props"], "1 hour"))
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "empty_rate": snap(F.col("empty_rate"))})


@query(
    "stream_messages",
    """SELECT CASE WHEN event_id % 13 = 0 THEN 'unreadable' WHEN event_type = 'signup' THEN 'unknown type' ELSE 'handled' END AS outcome, count(*) AS messages FROM events GROUP BY 1""",
)
def stream_messages(spark, folder):
    """Publish, parse, handle; malformed and unknown messages end as dead letters."""
    root = scratch(spark, "messages")
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kinds = F.create_map(*[F.lit(x) for kv in {"view": "market_data", "click": "news_data", "purchase": "trading_signals", "error": "system_alerts"}.items() for x in kv])
    good = e.where(F.col("event_id") % 13 != 0).select(
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id"),
        F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("gossip")).alias("stream_type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.create_map(F.lit("value"), F.col("value").cast("string")).alias("data"),
    )
    st.publish(good, f"{root}/in")
    e.where(F.col("event_id") % 13 == 0).select(F.concat(F.lit("{broken "), F.col("event_id").cast("string")).alias("value")).write.mode("append").text(f"{root}/in")

    parsed = st.parse(st.read_files(spark, f"{root}/in", "value string", "text"))
    every = {c.stream_type: [keep_kind(root, c.stream_type)] for c in st.DEFAULT_STREAMS}
    running = st.run_handlers(parsed, every, root, st.DEFAULT_STREAMS[1], backfill=True)
    running.awaitTermination()
    done = spark.read.parquet(f"{root}/handled").select(F.lit("handled").alias("outcome"))
    dead = spark.read.schema("value string, error string").json(f"{root}/dead_letters").select(F.col("error").alias("outcome"))
    return done.unionByName(dead).groupBy("outcome").agg(F.count(F.lit(1)).alias("messages"))


def keep_kind(root, kind):
    def keep(rows, number):
        rows.select("message_id", "stream_type").write.mode("overwrite").parquet(f"{root}/handled/kind={kind}/batch={number}")

    return keep


def rocks_state(spark):
    return setting(spark, "spark.sql.streaming.stateStore.providerClass", sf.ROCKS)


@query("stream_count_windows", "SELECT event_type AS name, ceil(count(*) / 100)::BIGINT AS windows, count(*) AS rows FROM events GROUP BY 1")
def stream_count_windows(spark, folder):
    with rocks_state(spark):
        root = scratch(spark, "counts")
        full = st.finish(st.to_folder(sf.count_windows(samples(spark, folder), 100), root), spark, root)
        out = full.unionByName(sf.open_windows(spark, f"{root}/checkpoint"))
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("windows"), F.sum("rows").alias("rows"))


@query(
    "stream_features",
    f"WITH {BARS} SELECT symbol, date, {s(roll('avg', 'close', 20))} AS sma FROM bars",
)
def stream_features(spark, folder):
    """Bars arrive three years at a time; the 19 bars before those of a batch come from the state."""
    with rocks_state(spark):
        root = scratch(spark, "features")
        bars = daily_bars(spark, folder).select("symbol", "date", "close", "volume")
        bars.withColumn("span", F.floor(F.year("date") / 3)).write.partitionBy("span").parquet(f"{root}/all")
        stored = spark.read.parquet(f"{root}/all")
        first, last = stored.agg(F.min("span"), F.max("span")).first()
        stored.limit(0).drop("span").write.parquet(f"{root}/in")
        stream = sf.with_tail(st.read_files(spark, f"{root}/in", bars.schema), "symbol", 19)
        for span in range(first, last + 1):
            stored.where(F.col("span") == span).drop("span").write.mode("append").parquet(f"{root}/in")
            running = stream.writeStream.foreachBatch(sf.feature_step(root, ["sma"]))
            running.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{root}/features")
    return out.select("symbol", "date", snap(F.col("sma")).alias("sma"))
