"""Triples, retrieval, feature store, metrics, subscriptions and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.columns import snap
from tidemark.operators import factors as fc
from tidemark.operators import feature_store as fs
from tidemark.operators import knowledge as kn
from tidemark.operators import metrics as mt
from tidemark.operators import modeling as md
from tidemark.operators import predicates as pr
from tidemark.plans.factor_sql import FACTORS
from tidemark.plans.registry import query
from tidemark.plans.sql import avg_rank
from tidemark.plans.sql import snap as s
from tidemark.plans.store_queries import coded_bars, scratch
from tidemark.plans.store_queries import _CODED as CODED
from tidemark.sources import graph_store as gs
from tidemark.sources.bars import daily_bars
from tidemark.sources.tables import events, table


def triples(spark, folder):
    """Supplier supplies part name; surer with the number of lines."""
    c = F.col
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate")
    part = table(spark, folder, "part").select(c("p_partkey").alias("l_partkey"), "p_name", "p_type")
    supp = table(spark, folder, "supplier").select(c("s_suppkey").alias("l_suppkey"), "s_name")
    g = lines.join(part, "l_partkey").join(supp, "l_suppkey").groupBy("s_name", "p_name").agg(
        F.count(F.lit(1)).alias("n"), F.max("l_shipdate").cast("timestamp").alias("timestamp"), F.min("p_type").alias("kind")
    )
    out = g.select(
        F.when(c("n") > 5, "fact").otherwise("rumour").alias("type"),
        c("s_name").alias("subject"),
        F.lit("supplies").alias("predicate"),
        c("p_name").alias("object"),
        (c("n") / (c("n") + 5)).alias("confidence"),
        "timestamp",
        F.array("kind").alias("tags"),
    )
    return kn.with_ids(out)


T = """g AS (SELECT s_name, p_name, count(*) AS n, max(l_shipdate) AS timestamp, min(p_type) AS kind FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
tr AS (SELECT substr(md5(concat(s_name, '_supplies_', p_name)), 1, 16) AS id, CASE WHEN n > 5 THEN 'fact' ELSE 'rumour' END AS type, s_name AS subject, 'supplies' AS predicate, p_name AS object, n / (n + 5.0::DOUBLE) AS confidence, timestamp, kind FROM g)"""
_COLS = "id, type, subject, object"


def _show(df):
    return df.select("id", "type", "subject", "object")


@query("triple_exact", f"WITH {T} SELECT {_COLS} FROM tr WHERE subject = 'Supplier#000000003' AND kind = 'ECONOMY'")
def triple_exact(spark, folder):
    return _show(kn.exact(triples(spark, folder), tag="ECONOMY", subject="Supplier#000000003"))


@query("triple_words", f"WITH {T} SELECT {_COLS} FROM tr WHERE object LIKE '%red%' AND list_contains(string_split(object, ' '), 'red') AND list_contains(string_split(object, ' '), 'widget')")
def triple_words(spark, folder):
    return _show(kn.by_words(triples(spark, folder), "Red widget"))


@query("triple_regex", f"WITH {T} SELECT {_COLS} FROM tr WHERE regexp_matches(concat(subject, ' ', predicate, ' ', object), '(?i)00[12] SUPPLIES (small|blue)')")
def triple_regex(spark, folder):
    return _show(kn.by_regex(triples(spark, folder), "00[12] SUPPLIES (small|blue)"))


@query("triple_ordered", f"WITH {T} SELECT {_COLS}, {s('confidence')} AS confidence FROM tr ORDER BY tr.confidence DESC, timestamp DESC, id LIMIT 50")
def triple_ordered(spark, folder):
    return kn.ordered(triples(spark, folder), 50).select("id", "type", "subject", "object", snap(F.col("confidence")).alias("confidence"))


@query("triple_counts", f"WITH {T} SELECT type, count(*) AS triples FROM tr GROUP BY 1")
def triple_counts(spark, folder):
    return kn.counts(triples(spark, folder))


@query("triple_upsert_remove", f"WITH {T} SELECT CASE WHEN subject LIKE '%7' THEN 'checked' ELSE type END AS type, count(*) AS triples FROM tr WHERE NOT (subject LIKE '%3') GROUP BY 1")
def triple_upsert_remove(spark, folder):
    t = triples(spark, folder)
    new = t.where(F.col("subject").endswith("7")).withColumns(
        {"type": F.lit("checked"), "timestamp": F.col("timestamp") + F.expr("INTERVAL 1 DAY")}
    )
    gone = t.where(F.col("subject").endswith("3")).select("id")
    return kn.counts(kn.remove(kn.add(t, new), gone))


@query(
    "triple_levels",
    f"WITH {T} SELECT CASE WHEN confidence <= 0.2 THEN 'very_low' WHEN confidence <= 0.4 THEN 'low' WHEN confidence <= 0.6 THEN 'medium' WHEN confidence <= 0.8 THEN 'high' ELSE 'very_high' END AS level, count(*) AS triples FROM tr GROUP BY 1",
)
def triple_levels(spark, folder):
    from tidemark.functions.text import confidence_level

    return triples(spark, folder).groupBy(confidence_level(F.col("confidence")).alias("level")).agg(F.count(F.lit(1)).alias("triples"))


@query(
    "triple_inference",
    """WITH RECURSIVE b AS (SELECT DISTINCT user_id % 40 AS a, floor(value / 25)::BIGINT + 1 + user_id % 40 AS c FROM events WHERE event_type = 'purchase'),
    r AS (SELECT a, c FROM b UNION SELECT r.a, b.c FROM r JOIN b ON r.c = b.a) SELECT concat('K', a) AS subject, concat('K', c) AS object FROM r""",
)
def triple_inference(spark, folder):
    """``leads_to`` closed under transitivity; edges go upward, so a few rounds end it."""
    e = table(spark, folder, "events").where(F.col("event_type") == "purchase")
    a = F.col("user_id") % 40
    base = e.select(
        F.concat(F.lit("K"), a.cast("string")).alias("subject"),
        F.lit("leads_to").alias("predicate"),
        F.concat(F.lit("K"), (F.floor(F.col("value") / 25) + 1 + a).cast("string")).alias("object"),
        F.lit(0.9).alias("confidence"),
    ).distinct()
    return kn.infer(base, [kn.transitive("leads_to")]).select("subject", "object")


@query(
    "entity_search",
    """WITH d AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_name = 'Customer#000000077' THEN 1.0 WHEN contains(c_name, 'Customer#000000077') OR contains('Customer#000000077', c_name) THEN 0.8 ELSE 1.0 - levenshtein('Customer#000000077', c_name)::DOUBLE / greatest(length(c_name), 18) END AS similarity FROM customer)
    SELECT id, name, floor(similarity * 1000000 + 0.4871) / 1000000 AS similarity FROM d WHERE d.similarity >= 0.9 ORDER BY d.similarity DESC, id LIMIT 30""",
)
def entity_search(spark, folder):
    names = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return kn.search_entities(names, "Customer#000000077", limit=30, threshold=0.9).withColumn("similarity", snap(F.col("similarity")))


@query("semantic_search")
def semantic_search(spark, folder):
    return kn.semantic_search(table(spark, folder, "documents"), "doc_id", "text", "the reason and the thing with la", 20)


@query(
    "graph_store_roundtrip",
    f"WITH {T} SELECT id, 'fact' AS type, subject FROM tr WHERE type = 'fact'",
)
def graph_store_roundtrip(spark, folder):
    """Table, JSON export, JSON import with merge, load by type."""
    rows = triples(spark, folder).withColumn("created_at", F.col("timestamp"))
    root, path = scratch(spark, "triples"), scratch(spark, "json")
    gs.save(spark, rows, root)
    gs.export_json(gs.load(spark, root), path, gzip=True)
    gs.import_rows(spark, gs.import_json(spark, path, rows.schema), root, merge=True)
    return gs.load(spark, root, "fact").select("id", "type", "subject")


# --- predicates -----------------------------------------------------------------------


@query(
    "market_universe",
    f"WITH {CODED} SELECT symbol, count(*) AS rows FROM coded WHERE symbol LIKE '%.SH' GROUP BY 1",
)
def market_universe(spark, folder):
    return pr.in_market(coded_bars(spark, folder), "SH").groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))


@query("symbol_sample")
def symbol_sample(spark, folder):
    return pr.sample_symbols(daily_bars(spark, folder), 5, seed=3)


@query(
    "record_validation",
    """SELECT event_id, array_to_string(list_filter([CASE WHEN try_cast(json_extract_string(props, '$.k') AS INT) < 10 THEN 'k: below minimum' END, CASE WHEN value > 200 THEN 'value: above maximum' END, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'event_type: not allowed' END], lambda x: x IS NOT NULL), ',') AS errors
    FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INT) < 10 OR value > 200 OR event_type NOT IN ('view', 'click', 'purchase')""",
)
def record_validation(spark, folder):
    rows = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k"))
    rules = {
        "k": {"type": "int", "min": 10, "nullable": False},
        "value": {"type": "double", "max": 200},
        "event_type": {"allowed": ["view", "click", "purchase"]},
    }
    bad = pr.split_valid(rows, rules)[1]
    return bad.select("event_id", F.array_join("errors", ",").alias("errors"))


def _subscriptions(spark):
    rows = [
        ("s1", "click", {"user_id": ["1", "2", "3"]}),
        ("s2", "click", {}),
        ("s3", "error", {"user_id": ["8"], "region": ["north"]}),
        ("s4", "view", {"absent": ["x"]}),
    ]
    return spark.createDataFrame(rows, "subscription_id string, kind string, filters map<string,array<string>>")


_SUBS = """f AS (SELECT 's1' AS subscription_id, * FROM events WHERE event_type = 'click' AND user_id IN (1, 2, 3) UNION ALL SELECT 's2', * FROM events WHERE event_type = 'click'
  UNION ALL SELECT 's3', * FROM events WHERE event_type = 'error' AND user_id = 8 UNION ALL SELECT 's4', * FROM events WHERE event_type = 'view')"""


@query("subscription_fanout", f"WITH {_SUBS} SELECT subscription_id, event_id FROM f")
def subscription_fanout(spark, folder):
    return pr.subscribed(events(spark, folder), _subscriptions(spark), ["user_id"]).select("subscription_id", "event_id")


@query(
    "subscription_push",
    f"WITH {_SUBS} SELECT subscription_id, time_bucket(INTERVAL 1 HOUR, ts) AS pushed_at, arg_max(value, event_id) AS value, max(event_id) AS event_id, count(*) AS events FROM f GROUP BY 1, 2",
)
def subscription_push(spark, folder):
    out = mt.push_batches(events(spark, folder), _subscriptions(spark), ["user_id"], "1 hour", "event_id")
    return out.withColumn("pushed_at", F.col("pushed_at").cast("timestamp_ntz"))


# --- metrics ---------------------------------------------------------------------------


def _samples(spark, folder):
    return events(spark, folder).select(F.col("event_type").alias("name"), "ts", "value", "event_id")


@query(
    "metric_statistics",
    f"""SELECT event_type AS name, count(*) AS count, min(value) AS min, max(value) AS max, {s('avg(value)')} AS mean, {s('stddev_samp(value)')} AS std, arg_max(value, row(ts, event_id)) AS latest, {s('median(value)')} AS median
    FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' GROUP BY 1""",
)
def metric_statistics(spark, folder):
    out = mt.metric_statistics(_samples(spark, folder), "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    return out.select("name", "count", "min", "max", snap(F.col("mean")).alias("mean"), snap(F.col("std")).alias("std"), "latest", snap(F.col("median")).alias("median"))


@query(
    "metric_windows",
    f"""SELECT event_type AS name, time_bucket(INTERVAL 15 MINUTE, ts) AS start, count(*) AS count, min(value) AS min, max(value) AS max, {s('avg(value)')} AS mean FROM events GROUP BY 1, 2""",
)
def metric_windows(spark, folder):
    out = mt.windowed_statistics(_samples(spark, folder), "15 minutes")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "mean": snap(F.col("mean"))})


@query(
    "metric_sliding_windows",
    f"""WITH b AS (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS q, value FROM events), k AS (SELECT event_type, unnest([q, q - INTERVAL 15 MINUTE, q - INTERVAL 30 MINUTE, q - INTERVAL 45 MINUTE]) AS start, value FROM b)
    SELECT event_type AS name, start, count(*) AS count, max(value) AS max FROM k GROUP BY 1, 2""",
)
def metric_sliding_windows(spark, folder):
    out = mt.windowed_statistics(_samples(spark, folder), "1 hour", "15 minutes")
    return out.select("name", F.col("start").cast("timestamp_ntz").alias("start"), "count", "max")


@query(
    "metric_error_rate",
    f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS events, CAST(sum((event_type = 'error')::INT) AS BIGINT) AS errors, {s("avg((event_type = 'error')::INT)")} AS error_rate FROM events GROUP BY 1""",
)
def metric_error_rate(spark, folder):
    out = mt.error_rate(events(spark, folder), F.col("event_type") == "error")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "error_rate": snap(F.col("error_rate"))})


def _rules(spark):
    return spark.createDataFrame(
        [("slow", "view", ">", 60.0, "warning"), ("burst", "click", ">=", 40.0, "error"), ("low", "error", "<", 2.0, "info")],
        "rule_id string, name string, op string, threshold double, severity string",
    )


_BREACH = """b AS (SELECT 'slow' AS rule_id, 'warning' AS severity, * FROM events WHERE event_type = 'view' AND value > 60 UNION ALL SELECT 'burst', 'error', * FROM events WHERE event_type = 'click' AND value >= 40
  UNION ALL SELECT 'low', 'info', * FROM events WHERE event_type = 'error' AND value < 2)"""


@query("alert_breaches", f"WITH {_BREACH} SELECT rule_id, event_id, severity FROM b")
def alert_breaches(spark, folder):
    return mt.breaches(_samples(spark, folder), _rules(spark)).select("rule_id", "event_id", "severity")


@query(
    "alert_cool_down",
    f"""WITH RECURSIVE {_BREACH}, k AS (SELECT rule_id, (floor(floor(epoch(ts)) / 60) * 60)::BIGINT AS tick, count(*) AS samples FROM b GROUP BY 1, 2),
    go AS (SELECT rule_id, min(tick) AS tick FROM k GROUP BY 1 UNION ALL SELECT g.rule_id, (SELECT min(k.tick) FROM k WHERE k.rule_id = g.rule_id AND k.tick >= g.tick + 3600) AS tick FROM go g WHERE g.tick IS NOT NULL)
    SELECT rule_id, tick, samples FROM go JOIN k USING (rule_id, tick)""",
)
def alert_cool_down(spark, folder):
    return mt.cool_down(mt.ticks(mt.breaches(_samples(spark, folder), _rules(spark)), 60), 3600)


@query(
    "alert_counts",
    f"""WITH {_BREACH}, a AS (SELECT severity, CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'active' END AS status FROM b) SELECT status, severity, count(*) AS alerts FROM a GROUP BY CUBE (status, severity)""",
)
def alert_counts(spark, folder):
    a = mt.breaches(_samples(spark, folder), _rules(spark)).withColumn(
        "status", F.when(F.col("event_id") % 3 == 0, "resolved").otherwise("active")
    )
    return mt.alert_counts(a)


@query(
    "alert_history",
    f"WITH {_BREACH} SELECT event_id, rule_id FROM b WHERE severity = 'warning' ORDER BY ts DESC LIMIT 25",
)
def alert_history(spark, folder):
    a = mt.breaches(_samples(spark, folder), _rules(spark))
    return mt.latest_rows(a, "ts", 25, [F.col("severity") == "warning"]).select("event_id", "rule_id")


@query("rows_to_json", """SELECT event_id, concat('{"user_id":', user_id, ',"event_type":"', event_type, '"}') AS json FROM events""")
def rows_to_json(spark, folder):
    return events(spark, folder).select("event_id", F.to_json(F.struct("user_id", "event_type")).alias("json"))


# --- feature store ---------------------------------------------------------------------


def _feature_store(spark, folder):
    store = fs.FeatureStore(spark, scratch(spark, "features"), buckets=8)
    store.register(
        fs.FeatureGroup("customers", ("c_custkey",), {"c_acctbal": {"type": "double", "min": 0, "nullable": False}}, ttl_seconds=86400)
    )
    rows = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    bad = store.put("customers", rows, "2024-01-01 00:00:00")
    store.put("customers", rows.where(F.col("c_custkey") < 500).withColumn("c_acctbal", F.col("c_acctbal") + 1000), "2024-01-03 00:00:00")
    return store, bad


_FS = """f AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey < 500 AND c_acctbal + 1000 >= 0 THEN c_acctbal + 1000 ELSE c_acctbal END AS c_acctbal, c_custkey < 500 AND c_acctbal + 1000 >= 0 AS fresh FROM customer WHERE c_acctbal >= 0 OR (c_custkey < 500 AND c_acctbal + 1000 >= 0))"""


@query("feature_store_get", f"WITH {_FS} SELECT c_custkey, {s('c_acctbal', 2)} AS c_acctbal FROM f")
def feature_store_get(spark, folder):
    store, _ = _feature_store(spark, folder)
    keys = table(spark, folder, "customer")
    return store.get("customers", keys, ["c_acctbal"]).withColumn("c_acctbal", snap(F.col("c_acctbal"), 2))


@query("feature_store_rejected", "SELECT c_custkey, 'c_acctbal: below minimum' AS errors FROM customer WHERE c_acctbal < 0")
def feature_store_rejected(spark, folder):
    _, bad = _feature_store(spark, folder)
    return bad.select("c_custkey", F.array_join("errors", ",").alias("errors"))


@query("feature_store_live", f"WITH {_FS} SELECT c_custkey FROM f WHERE fresh")
def feature_store_live(spark, folder):
    store, _ = _feature_store(spark, folder)
    return store.live("customers", "2024-01-03 12:00:00").select("c_custkey")


@query("feature_store_history", f"WITH {_FS} SELECT c_custkey, c_mktsegment FROM f WHERE NOT fresh")
def feature_store_history(spark, folder):
    store, _ = _feature_store(spark, folder)
    return store.history("customers", "2024-01-01 00:00:00", "2024-01-02 00:00:00", ["c_mktsegment"]).drop("_timestamp")


@query("feature_store_delete", f"WITH {_FS} SELECT count(*) AS rows FROM f WHERE c_custkey >= 100")
def feature_store_delete(spark, folder):
    store, _ = _feature_store(spark, folder)
    store.delete("customers", table(spark, folder, "customer").where(F.col("c_custkey") < 100))
    return store.info("customers").select("rows")


# --- model data ------------------------------------------------------------------------

_SPANS = {"train": ("1995-01-01", "1998-12-31"), "valid": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2001-12-31")}
_MF = ("momentum_20d", "volatility_20d", "rsi_14d")


def _model_data(spark, folder):
    wide = fc.forward_return(fc.builtin_factors(daily_bars(spark, folder)))
    return md.model_data(wide, _MF, "fwd_ret", _SPANS)


def _z(c):
    return f"coalesce(greatest(least(({c} - {c}_m) / nullif({c}_d * 1.4826, 0), 3), -3), 0)"


@query(
    "model_data",
    f"""WITH {FACTORS}, sg AS (SELECT *, CASE WHEN date <= DATE '1998-12-31' THEN 'train' WHEN date <= DATE '1999-12-31' THEN 'valid' ELSE 'test' END AS segment FROM fac),
    m AS (SELECT {', '.join(f'median({c}) AS {c}_m' for c in _MF)} FROM sg WHERE segment = 'train'),
    d AS (SELECT {', '.join(f'median(abs({c} - {c}_m)) AS {c}_d' for c in _MF)} FROM sg, m WHERE segment = 'train'),
    z AS (SELECT symbol, date, segment, fwd_ret, {', '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE {_z(c)} END AS {c}' for c in _MF)} FROM sg, m, d WHERE fwd_ret IS NOT NULL)
    SELECT symbol, date, segment, {', '.join(f'{s(c, 5)} AS {c}' for c in _MF)}, {s(f"({avg_rank('fwd_ret', 'date')} / count(*) OVER (PARTITION BY date) - 0.5) * 3.46", 5)} AS label_rank FROM z""",
)
def model_data(spark, folder):
    out = _model_data(spark, folder)
    return out.select("symbol", "date", "segment", *[snap(F.col(c), 5).alias(c) for c in (*_MF, "label_rank")])


@query("model_scores")
def model_scores(spark, folder):
    return md.boosted_scores(_model_data(spark, folder), _MF)
