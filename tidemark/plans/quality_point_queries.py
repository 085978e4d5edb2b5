"""Point, source and feature quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.columns import snap
from tidemark.operators import quality_features as qf
from tidemark.operators import quality_points as qp
from tidemark.operators import quality_sources as qs
from tidemark.plans.registry import query
from tidemark.plans.sql import snap as s
from tidemark.sources.points import trade_points
from tidemark.sources.tables import events, table

AS_OF = "2001-06-30 00:00:00"
_POINTS = """p AS (SELECT CASE WHEN l_quantity = 50 THEN NULL ELSE concat('P', l_partkey) END AS symbol, l_shipdate AS ts,
    CASE WHEN l_linestatus = 'O' THEN 'akshare' ELSE 'tushare' END AS source,
    l_extendedprice / l_quantity / 10 * (1.05::DOUBLE - l_discount) AS open, l_extendedprice / l_quantity / 10 * (1 + l_discount) AS high,
    l_extendedprice / l_quantity / 10 * (1 - l_tax) AS low, l_extendedprice / l_quantity / 10 * (1 + l_discount - l_tax) AS close,
    CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS volume, (l_discount - l_tax) * 300 AS change_pct FROM lineitem)"""
_CHECKS = [
    ("symbol IS NULL", "missing_value", "critical", "symbol"),
    ("volume IS NULL", "missing_value", "high", "volume"),
    *[(f"{f} < 0.01 OR {f} > 10000", "out_of_range", "medium", f) for f in ("open", "high", "low", "close")],
    ("volume < 0 OR volume > 1e12", "out_of_range", "medium", "volume"),
    ("change_pct < -20 OR change_pct > 20", "out_of_range", "medium", "change_pct"),
    *[(f"NOT ({f} BETWEEN low AND high)", "inconsistent", "high", f) for f in ("open", "close")],
    ("abs(change_pct) > 20", "suspicious", "medium", "change_pct"),
    *[(f"{f} > 1000 OR {f} < 0.01", "outlier", "medium", f) for f in ("open", "high", "low", "close")],
    (f"ts > TIMESTAMP '{AS_OF}'", "invalid_value", "high", "timestamp"),
    (f"date_diff('day', ts, TIMESTAMP '{AS_OF}') > 365", "stale_data", "low", "timestamp"),
]
_ISSUES = f"WITH {_POINTS}, i AS (" + " UNION ALL ".join(
    f"SELECT symbol, ts, source, '{k}' AS issue_type, '{v}' AS severity, '{f}' AS field FROM p WHERE {c}" for c, k, v, f in _CHECKS
) + ")"


@query(
    "points_issues",
    f"{_ISSUES} SELECT coalesce(symbol, '-') AS symbol, ts, issue_type, severity, field FROM i",
)
def points_issues(spark, folder):
    out = qp.point_issues(trade_points(spark, folder), AS_OF)
    return out.select(
        F.coalesce("symbol", F.lit("-")).alias("symbol"), F.col("timestamp").cast("timestamp_ntz").alias("ts"), "issue_type", "severity", "field"
    )


@query(
    "points_issue_statistics",
    f"{_ISSUES} SELECT issue_type, severity, field, count(*) AS issues FROM i GROUP BY GROUPING SETS ((issue_type), (severity), (field), ())",
)
def points_issue_statistics(spark, folder):
    return qp.issue_statistics(qp.point_issues(trade_points(spark, folder), AS_OF))


@query(
    "points_score",
    f"""{_ISSUES}, n AS (SELECT source, count(*) AS points FROM p GROUP BY 1),
    k AS (SELECT source, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
      count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM i GROUP BY 1)
    SELECT source, points, critical, high, medium, low,
      {s('greatest(0, least(1, 1 - (critical * 0.5 + high * 0.3 + medium * 0.1 + low * 0.05) / points))')} AS score, critical = 0 AS valid FROM n JOIN k USING (source)""",
)
def points_score(spark, folder):
    out = qp.score(trade_points(spark, folder), AS_OF)
    return out.withColumn("score", snap(F.col("score")))


@query(
    "points_recommendations",
    f"{_ISSUES} SELECT issue_type, count(*) AS issues, CASE issue_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in qp.ADVICE.items())
    + " END AS advice FROM i GROUP BY 1",
)
def points_recommendations(spark, folder):
    return qp.recommendations(qp.point_issues(trade_points(spark, folder), AS_OF))


@query(
    "points_duplicates",
    f"WITH {_POINTS} SELECT coalesce(symbol, '-') AS symbol, CAST(ts AS DATE) AS date, count(*) - 1 AS extra FROM p GROUP BY symbol, ts HAVING count(*) > 1",
)
def points_duplicates(spark, folder):
    out = qp.duplicates(trade_points(spark, folder))
    return out.select(F.coalesce("symbol", F.lit("-")).alias("symbol"), F.to_date("timestamp").alias("date"), "extra")


@query(
    "points_continuity",
    f"""WITH {_POINTS}, d AS (SELECT DISTINCT symbol, CAST(ts AS DATE) AS date FROM p),
    g AS (SELECT *, date - lag(date) OVER (PARTITION BY symbol ORDER BY date) AS gap_days FROM d)
    SELECT coalesce(symbol, '-') AS symbol, date, gap_days FROM g WHERE gap_days > 7""",
)
def points_continuity(spark, folder):
    out = qp.continuity(trade_points(spark, folder))
    return out.withColumn("symbol", F.coalesce("symbol", F.lit("-")))


@query(
    "points_consistency",
    f"""WITH {_POINTS} SELECT coalesce(symbol, '-') AS symbol, CAST(ts AS DATE) AS date, count(DISTINCT close) > 1 AS close_differs,
      count(DISTINCT volume) > 1 AS volume_differs FROM p GROUP BY symbol, 2 HAVING count(DISTINCT close) > 1 OR count(DISTINCT volume) > 1""",
)
def points_consistency(spark, folder):
    out = qp.consistency(trade_points(spark, folder))
    return out.withColumn("symbol", F.coalesce("symbol", F.lit("-")))


@query(
    "points_freshness",
    f"""WITH {_POINTS} SELECT source, CAST(max(ts) AS DATE) AS newest, date_diff('day', max(ts), TIMESTAMP '2001-12-31') AS age_days,
      date_diff('day', max(ts), TIMESTAMP '2001-12-31') > 1 AS stale FROM p GROUP BY 1""",
)
def points_freshness(spark, folder):
    out = qp.freshness(trade_points(spark, folder), "2001-12-31 00:00:00")
    return out.withColumn("newest", F.to_date("newest"))


@query(
    "points_coverage",
    f"WITH {_POINTS} "
    + " UNION ALL ".join(f"SELECT '{f}' AS field, {s(f'count({f})::DOUBLE / count(*)')} AS coverage FROM p" for f in ("open", "high", "low", "close", "volume", "change_pct")),
)
def points_coverage(spark, folder):
    out = qp.field_coverage(trade_points(spark, folder))
    return out.withColumn("coverage", snap(F.col("coverage")))


@query(
    "points_sanity",
    f"""WITH {_POINTS} SELECT source, count(*) AS points, {s('avg((symbol IS NOT NULL AND coalesce(volume BETWEEN 0 AND 1e10, true) AND open >= 0 AND low >= 0 AND close >= 0 AND change_pct >= 0)::INT)')} AS valid_rate
    FROM p GROUP BY 1""",
)
def points_sanity(spark, folder):
    points = trade_points(spark, folder)
    return points.groupBy("source").agg(
        F.count(F.lit(1)).alias("points"),
        snap(F.avg(F.when(qp.sane_points(points), 1).otherwise(0))).alias("valid_rate"),
    )


# --- sources --------------------------------------------------------------------------


def source_events(spark, folder):
    """Events as source rows: the source is the event type, empty cells by rule."""
    e = events(spark, folder)
    return e.select(
        "event_id",
        F.col("event_type").alias("source"),
        "ts",
        "user_id",
        F.when(F.col("user_id") % 7 == 0, None).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("props")).alias("props"),
        (F.col("ts") + F.expr("make_dt_interval(0, 0, 0, user_id % 40 * 60)")).alias("_ingested_at"),
    )


_SRC = """e AS (SELECT event_id, event_type AS source, ts, user_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE value END AS value,
    CASE WHEN event_id % 11 = 0 THEN '' ELSE props END AS props, ts + to_seconds(user_id % 40 * 60) AS ingested FROM events)"""


@query(
    "source_missing",
    f"WITH {_SRC} "
    + " UNION ALL ".join(
        f"SELECT source, '{f}' AS field, count(*) FILTER ({f} IS NULL OR {f}::VARCHAR = '') AS missing, {s(f"(count(*) FILTER ({f} IS NULL OR {f}::VARCHAR = ''))::DOUBLE / count(*)")} AS missing_rate, (count(*) FILTER ({f} IS NULL OR {f}::VARCHAR = ''))::DOUBLE / count(*) > 0.05 AS issue FROM e GROUP BY 1"
        for f in ("user_id", "value", "props")
    ),
)
def source_missing(spark, folder):
    out = qs.missing_rates(source_events(spark, folder), ["user_id", "value", "props"])
    return out.withColumn("missing_rate", snap(F.col("missing_rate")))


@query(
    "source_duplicates",
    f"""WITH {_SRC}, g AS (SELECT source, user_id, floor(value / 100) AS band, count(*) AS c FROM e GROUP BY 1, 2, 3)
    SELECT source, CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c) - count(*) AS BIGINT) AS duplicates, {s('(sum(c) - count(*))::DOUBLE / sum(c)')} AS duplicate_rate, (sum(c) - count(*))::DOUBLE / sum(c) > 0.01 AS issue FROM g GROUP BY 1""",
)
def source_duplicates(spark, folder):
    rows = source_events(spark, folder).select(
        "source", "user_id", F.floor(F.col("value") / 100).alias("band"), F.col("ts").alias("timestamp"), "_ingested_at"
    )
    out = qs.duplicate_rates(rows)
    return out.withColumn("duplicate_rate", snap(F.col("duplicate_rate")))


def _outlier_sql(marks: str, odd: str) -> str:
    return f"""WITH {_SRC}, v AS (SELECT source, value AS v FROM e WHERE value IS NOT NULL), {marks}
    SELECT source, count(*) AS "values", CAST(sum(({odd})::INT) AS BIGINT) AS outliers, {s(f'avg(({odd})::INT)')} AS outlier_rate, avg(({odd})::INT) > 0.05 AS issue FROM v JOIN m USING (source) GROUP BY 1"""


def _outliers(spark, folder, method, threshold):
    out = qs.outlier_rates(source_events(spark, folder), "value", method, threshold)
    return out.withColumn("outlier_rate", snap(F.col("outlier_rate")))


@query(
    "source_outliers_iqr",
    _outlier_sql(
        "m AS (SELECT source, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM v GROUP BY 1)",
        "v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)",
    ),
)
def source_outliers_iqr(spark, folder):
    return _outliers(spark, folder, "iqr", 3.0)


@query(
    "source_outliers_zscore",
    _outlier_sql("m AS (SELECT source, avg(v) AS a, stddev_pop(v) AS b FROM v GROUP BY 1)", "abs((v - a) / b) > 2"),
)
def source_outliers_zscore(spark, folder):
    return _outliers(spark, folder, "zscore", 2.0)


@query(
    "source_outliers_modified_zscore",
    _outlier_sql(
        "d AS (SELECT source, median(v) AS a FROM v GROUP BY 1), m AS (SELECT source, any_value(a) AS a, median(abs(v - a)) AS b FROM v JOIN d USING (source) GROUP BY 1)",
        "abs(0.6745 * (v - a) / b) > 3.5",
    ),
)
def source_outliers_modified_zscore(spark, folder):
    return _outliers(spark, folder, "modified_zscore", 3.5)


@query(
    "source_stale",
    f"""WITH {_SRC}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, event_id DESC) AS n FROM e)
    SELECT source, max(epoch(TIMESTAMP '2024-01-31')::BIGINT - floor(epoch(ts))::BIGINT) AS oldest_age,
      max(epoch(TIMESTAMP '2024-01-31')::BIGINT - floor(epoch(ts))::BIGINT) > 86400 AS stale FROM r WHERE n <= 10 GROUP BY 1""",
)
def source_stale(spark, folder):
    return qs.stale_sources(source_events(spark, folder), "2024-01-31 00:00:00", 86400)


@query(
    "source_volume_anomaly",
    f"""WITH {_SRC}, c AS (SELECT source, CAST(date_trunc('day', ts) AS DATE) AS period, count(*) AS rows FROM e GROUP BY 1, 2),
    l AS (SELECT *, lag(rows) OVER (PARTITION BY source ORDER BY period) AS b FROM c)
    SELECT source, period, rows, {s('abs(rows - b)::DOUBLE / b')} AS change_rate, coalesce(abs(rows - b)::DOUBLE / b > 0.2, false) AS issue FROM l""",
)
def source_volume_anomaly(spark, folder):
    out = qs.volume_anomalies(source_events(spark, folder), limit=0.2)
    return out.select("source", F.to_date("period").alias("period"), "rows", snap(F.col("change_rate")).alias("change_rate"), "issue")


@query(
    "source_range_errors",
    f"""WITH {_SRC} SELECT source, count(*) FILTER (value < 1 OR value > 200) AS out_of_range,
      {s('(count(*) FILTER (value < 1 OR value > 200))::DOUBLE / count(*)')} AS error_rate FROM e GROUP BY 1 HAVING count(*) FILTER (value < 1 OR value > 200) > 0""",
)
def source_range_errors(spark, folder):
    out = qs.range_errors(source_events(spark, folder), "value", 1, 200)
    return out.withColumn("error_rate", snap(F.col("error_rate")))


@query(
    "source_format_errors",
    f"""WITH {_SRC}, f AS (SELECT source, (NOT regexp_matches(props, '^[{{]"k": [0-9][0-9][}}]$'))::INT AS bad FROM e)
    SELECT source, CAST(sum(bad) AS BIGINT) AS malformed, {s('avg(bad)')} AS malformed_rate FROM f GROUP BY 1""",
)
def source_format_errors(spark, folder):
    out = qs.format_errors(source_events(spark, folder), "props", '^[{]"k": [0-9][0-9][}]$')
    return out.withColumn("malformed_rate", snap(F.col("malformed_rate")))


_METRICS = f"""WITH {_SRC}, r AS (SELECT *, (value IS NULL)::INT + (props = '')::INT AS empties, floor(epoch(ingested)) - floor(epoch(ts)) AS lat FROM e),
    a AS (SELECT source, count(*) AS record_count, 1 - sum(empties) / (count(*) * 3.0) AS completeness, avg(lat) AS avg_latency, max(lat)::BIGINT AS max_latency,
      avg(coalesce((value BETWEEN 1 AND 200)::INT, 0)) AS accuracy, avg((empties = 0)::INT) AS validity FROM r GROUP BY 1),
    k AS (SELECT source, user_id, CAST(ts AS DATE) AS day, min(value) = max(value) AS same FROM e GROUP BY 1, 2, 3),
    c AS (SELECT source, avg(coalesce(same::INT, 0)) AS consistency FROM k GROUP BY 1),
    m AS (SELECT *, greatest(0, 1 - avg_latency / 3600) AS timeliness FROM a JOIN c USING (source)),
    o AS (SELECT *, 0.25 * completeness + 0.25 * accuracy + 0.2 * consistency + 0.15 * timeliness + 0.15 * validity AS overall FROM m)"""


def _source_metrics(spark, folder):
    rows = source_events(spark, folder).withColumn("day", F.to_date("ts"))
    return qs.source_metrics(
        rows, ["user_id", "value", "props"], "_ingested_at", ("value", 1, 200), ["user_id", "day"], "value"
    )


@query(
    "source_metrics",
    f"{_METRICS} SELECT source, record_count, max_latency, "
    + ", ".join(f"{s(c)} AS {c}" for c in ("completeness", "avg_latency", "accuracy", "consistency", "timeliness", "validity", "overall"))
    + " FROM o",
)
def source_metrics(spark, folder):
    m = _source_metrics(spark, folder)
    return m.select(
        "source",
        "record_count",
        "max_latency",
        *[snap(F.col(c)).alias(c) for c in ("completeness", "avg_latency", "accuracy", "consistency", "timeliness", "validity", "overall")],
    )


@query("source_overall_quality", f"{_METRICS} SELECT count(*) AS sources, {s('avg(overall)')} AS overall FROM o")
def source_overall_quality(spark, folder):
    return qs.overall_quality(_source_metrics(spark, folder)).withColumn("overall", snap(F.col("overall")))


@query(
    "source_issue_merge",
    """WITH i AS (SELECT 'high_value' AS rule, event_type AS source, date_trunc('second', ts) AS ts, count(*) AS affected FROM events WHERE value > 100 GROUP BY 1, 2, 3),
    g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY source ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM i),
    k AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY ts) AS run FROM g)
    SELECT rule, source, 'value' AS field, min(ts) AS opened, CAST(sum(affected) AS BIGINT) AS affected FROM k GROUP BY rule, source, run""",
)
def source_issue_merge(spark, folder):
    issues = events(spark, folder).where(F.col("value") > 100).select(
        F.lit("high_value").alias("rule"), F.col("event_type").alias("source"), F.lit("value").alias("field"), "ts", F.lit(1).alias("affected")
    )
    out = qs.merge_issues(issues)
    return out.select("rule", "source", "field", F.col("opened").cast("timestamp_ntz").alias("opened"), "affected")


@query(
    "source_issue_resolved",
    f"""SELECT event_id AS issue_id, CASE WHEN event_id = 100 THEN 'resolved' ELSE 'open' END AS status,
      CASE WHEN event_id = 100 THEN 'checked by hand' END AS notes FROM events WHERE event_type = 'error'""",
)
def source_issue_resolved(spark, folder):
    issues = table(spark, folder, "events").where(F.col("event_type") == "error").select(
        F.col("event_id").alias("issue_id"),
        F.lit("open").alias("status"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.lit(None).cast("string").alias("notes"),
    )
    return qs.resolve(issues, 100, "checked by hand", "2024-02-01").select("issue_id", "status", "notes")


# --- features -------------------------------------------------------------------------

_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _lines(spark, folder):
    return table(spark, folder, "lineitem").select(*_FEATURES)


@query(
    "feature_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS rows, 0::BIGINT AS nulls, min({c}) AS min, max({c}) AS max, {s(f'avg({c})', 4)} AS mean, {s(f'stddev_samp({c})', 4)} AS std,"
        f" count(DISTINCT {c}) AS \"distinct\", {s(f'quantile_cont({c}, 0.25)', 4)} AS p25, {s(f'quantile_cont({c}, 0.5)', 4)} AS p50, {s(f'quantile_cont({c}, 0.75)', 4)} AS p75 FROM lineitem"
        for c in _FEATURES
    ),
)
def feature_profile(spark, folder):
    p = qf.profile(_lines(spark, folder), _FEATURES)
    return p.select(
        "feature", "rows", "nulls", "min", "max", "distinct", *[snap(F.col(c), 4).alias(c) for c in ("mean", "std", "p25", "p50", "p75")]
    )


@query(
    "feature_histogram",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(least(floor(({c} - lo) / ((hi - lo) / 10)), 9) AS INT) AS bin, count(*) AS rows FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY 1, 2"
        for c in ("l_quantity", "l_extendedprice")
    ),
)
def feature_histogram(spark, folder):
    return qf.histogram(_lines(spark, folder), ["l_quantity", "l_extendedprice"])


@query(
    "feature_rules",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER ({c} < 0.01) AS below, count(*) FILTER ({c} > 50000) AS above, min({c}) AS min, max({c}) AS max, 0.0::DOUBLE AS null_ratio,"
        f" {s(f'count(DISTINCT {c})::DOUBLE / count(*)')} AS unique_ratio, count(*) FILTER ({c} < 0.01 OR {c} > 50000) = 0 AS range_ok, true AS nulls_ok, count(DISTINCT {c})::DOUBLE / count(*) >= 0.01 AS unique_ok FROM lineitem"
        for c in _FEATURES
    ),
)
def feature_rules(spark, folder):
    out = qf.basic_rules(_lines(spark, folder), _FEATURES, 0.01, 50000)
    return out.withColumns({c: snap(F.col(c)) for c in ("null_ratio", "unique_ratio")})


@query(
    "feature_outlier_rule",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS \"values\", count(*) FILTER (abs({c} - m) / sd > 1.6) AS outliers, {s(f'(count(*) FILTER (abs({c} - m) / sd > 1.6))::DOUBLE / count(*)')} AS outlier_rate,"
        f" (count(*) FILTER (abs({c} - m) / sd > 1.6))::DOUBLE / count(*) <= 0.05 AS passed FROM lineitem, (SELECT avg({c}) AS m, stddev_samp({c}) AS sd FROM lineitem) GROUP BY 1"
        for c in _FEATURES
    ),
)
def feature_outlier_rule(spark, folder):
    out = qf.outlier_rule(_lines(spark, folder), _FEATURES, "zscore", 1.6)
    return out.withColumn("outlier_rate", snap(F.col("outlier_rate")))


_JB = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS n, count(*) / 6.0 * (pow(avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5), 2) + pow(avg(pow({c} - m, 4)) / pow(avg(pow({c} - m, 2)), 2) - 3, 2) / 4) AS jb FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)"
    for c in _FEATURES
)


@query(
    "feature_distribution_rule",
    f"WITH j AS ({_JB}) SELECT feature, n, {s('jb', 3)} AS jarque_bera, {s('exp(-jb / 2)')} AS p_value, exp(-jb / 2) > 0.05 AS passed FROM j",
)
def feature_distribution_rule(spark, folder):
    out = qf.distribution_rule(_lines(spark, folder), _FEATURES)
    return out.withColumns({"jarque_bera": snap(F.col("jarque_bera"), 3), "p_value": snap(F.col("p_value"))})


@query(
    "feature_uniform_distance",
    f"""WITH x AS (SELECT l_returnflag, (l_extendedprice - min(l_extendedprice) OVER w) / (max(l_extendedprice) OVER w - min(l_extendedprice) OVER w) AS x,
      count(*) OVER w AS n, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS a, count(*) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS b
      FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)),
    d AS (SELECT l_returnflag, n, max(greatest(abs(b::DOUBLE / n - x), abs(a::DOUBLE / n - x))) AS d FROM x GROUP BY 1, 2),
    p AS (SELECT *, CASE WHEN sqrt(n) * d < 0.2 THEN 1.0::DOUBLE ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END * exp(-2.0::DOUBLE * k * k * n * d * d))), 0), 1) END AS p FROM d)
    SELECT l_returnflag, n, {s('d')} AS ks_distance, {s('p')} AS p_value, p > 0.05 AS passed FROM p""",
)
def feature_uniform_distance(spark, folder):
    out = qf.uniform_ks(table(spark, folder, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.withColumns({"ks_distance": snap(F.col("ks_distance")), "p_value": snap(F.col("p_value"))})


def _normal_sql(z: str) -> str:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * abs({z}) / sqrt(2.0::DOUBLE)))"
    power = f"({qf.ERFC[-1]!r}::DOUBLE)"
    for c in reversed(qf.ERFC[:-1]):
        power = f"({c!r}::DOUBLE + t * {power})"
    return f"(SELECT CASE WHEN {z} > 0 THEN 1.0::DOUBLE - u ELSE u END FROM (SELECT 0.5::DOUBLE * t * exp(-{z} * {z} / 2.0::DOUBLE + {power}) AS u FROM (SELECT {t} AS t)))"


@query(
    "feature_normal_distance",
    f"""WITH z AS (SELECT l_returnflag, (l_extendedprice - avg(l_extendedprice) OVER w) / stddev_samp(l_extendedprice) OVER w AS z,
      count(*) OVER w AS n, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS a, count(*) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS b
      FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)),
    x AS (SELECT *, {_normal_sql('z')} AS x FROM z),
    d AS (SELECT l_returnflag, n, max(greatest(abs(b::DOUBLE / n - x), abs(a::DOUBLE / n - x))) AS d FROM x GROUP BY 1, 2),
    p AS (SELECT *, CASE WHEN sqrt(n) * d < 0.2 THEN 1.0::DOUBLE ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END * exp(-2.0::DOUBLE * k * k * n * d * d))), 0), 1) END AS p FROM d)
    SELECT l_returnflag, n, {s('d')} AS ks_distance, {s('p')} AS p_value, p > 0.05 AS passed FROM p""",
)
def feature_normal_distance(spark, folder):
    out = qf.kolmogorov(table(spark, folder, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.withColumns({"ks_distance": snap(F.col("ks_distance")), "p_value": snap(F.col("p_value"))})


@query("feature_normality")
def feature_normality(spark, folder):
    """Daily mean prices of each brand, by W or by the distance, whichever their number asks for."""
    c = F.col
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "part"), c("l_partkey") == c("p_partkey"))
    daily = lines.groupBy("p_brand", "l_shipdate").agg(F.avg("l_extendedprice").alias("price"))
    out = qf.distribution_test(daily, "price", ["p_brand"])
    return out.withColumns({"statistic": snap(c("statistic")), "p_value": snap(c("p_value"))})


@query(
    "feature_custom_rules",
    """SELECT 'mean_quantity_above_20' AS rule, avg(l_quantity) > 20 AS passed FROM lineitem
    UNION ALL SELECT 'tax_below_5_percent', max(l_tax) < 0.05 FROM lineitem""",
)
def feature_custom_rules(spark, folder):
    return qf.custom_rules(
        table(spark, folder, "lineitem"),
        {
            "mean_quantity_above_20": lambda: F.avg("l_quantity") > 20,
            "tax_below_5_percent": lambda: F.max("l_tax") < 0.05,
        },
    )


@query(
    "feature_validation_report",
    "WITH r AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, unnest(['range', 'nulls', 'outliers']) AS rule, unnest([(SELECT count(*) FILTER ({c} < 0.01 OR {c} > 50000) = 0 FROM lineitem), true,"
        f" (SELECT (count(*) FILTER (abs({c} - m) / sd > 1.6))::DOUBLE / count(*) <= 0.05 FROM lineitem, (SELECT avg({c}) AS m, stddev_samp({c}) AS sd FROM lineitem))]) AS passed"
        for c in _FEATURES
    )
    + f") SELECT feature, count(*) AS rules, {s('avg(passed::INT)')} AS success_rate, CAST(sum((NOT passed AND rule = 'outliers')::INT) AS BIGINT) AS failed_warnings, CAST(sum((NOT passed AND rule <> 'outliers')::INT) AS BIGINT) = 0 AS valid FROM r GROUP BY 1",
)
def feature_validation_report(spark, folder):
    lines = _lines(spark, folder)
    basic = qf.basic_rules(lines, _FEATURES, 0.01, 50000)
    outliers = qf.outlier_rule(lines, _FEATURES, "zscore", 1.6)
    out = qf.report(
        [
            (basic.select("feature", F.col("range_ok").alias("passed")), "range", "error", "business"),
            (basic.select("feature", F.col("nulls_ok").alias("passed")), "nulls", "error", "completeness"),
            (outliers, "outliers", "warning", "data_quality"),
        ]
    )
    return out.withColumn("success_rate", snap(F.col("success_rate")))
