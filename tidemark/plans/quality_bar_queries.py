"""Bar quality, calendar and cleaning queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.columns import snap
from tidemark.operators import calendar as cal
from tidemark.operators import quality_bars as qb
from tidemark.plans.registry import query
from tidemark.plans.sql import BARS, WS, div
from tidemark.plans.sql import snap as s
from tidemark.session import checkpoint_dir
from tidemark.sources.bars import daily_bars, landed_bars
from tidemark.sources.tables import table

AS_OF = "2001-06-30"

LANDED = """
priced AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, lineitem.*,
    CASE WHEN l_quantity = 13 THEN 0 WHEN l_linenumber = 7 AND l_tax = 0.08 THEN -l_extendedprice / l_quantity
      ELSE l_extendedprice / l_quantity END AS price FROM lineitem JOIN part ON l_partkey = p_partkey),
landed AS (SELECT symbol, date, price * (1.05::DOUBLE - l_discount) AS open, price * (1 + l_discount) AS high,
    price * (1 - l_tax) AS low, price * (1 + l_discount - l_tax) AS close,
    CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN NULL WHEN l_discount = 0 THEN 0 ELSE l_quantity END AS volume,
    row(l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS seq FROM priced)"""
DAYS = """
days AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM
  (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE weekday(o_orderdate) < 5))"""
METRICS = f"""{LANDED}, {DAYS.strip().replace("weekday(o_orderdate) < 5", "isodow(o_orderdate) < 6")},
daily AS (SELECT symbol, date, count(*) AS rows,
    sum((open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT + (volume IS NULL)::INT) AS nulls,
    sum((open < 0)::INT + (high < 0)::INT + (low < 0)::INT + (close < 0)::INT) AS negative_prices,
    sum((open = 0)::INT + (high = 0)::INT + (low = 0)::INT + (close = 0)::INT) AS zero_prices,
    sum((high < greatest(open, close))::INT + (low > least(open, close))::INT) AS ohlc_errors,
    sum(coalesce((volume < 0)::INT, 0)) AS negative_volume, sum(coalesce((volume = 0)::INT, 0)) AS zero_volume,
    arg_max(open, seq) AS open, arg_max(close, seq) AS close,
    arg_max_null(volume, seq) AS volume FROM landed GROUP BY 1, 2),
z AS (SELECT daily.*, idx, {div('close', f'lag(close) OVER ({WS})')} - 1 AS ret, abs({div('open', f'lag(close) OVER ({WS})')} - 1) AS jump,
    abs({div('close - avg(close) OVER (PARTITION BY symbol)', 'stddev_samp(close) OVER (PARTITION BY symbol)')}) AS pz,
    abs({div('volume - avg(volume) OVER (PARTITION BY symbol)', 'stddev_samp(volume) OVER (PARTITION BY symbol)')}) AS vz,
    idx - lag(idx) OVER ({WS}) AS gap FROM daily LEFT JOIN days USING (date)),
metrics AS (SELECT symbol, sum(rows) AS total_records, sum(nulls) / (sum(rows) * 5.0) AS missing_ratio,
    sum(rows) - count(*) AS duplicate_dates, sum((date > DATE '{AS_OF}')::INT * rows) AS future_dates,
    sum((idx IS NULL)::INT) AS non_trading_days, sum(negative_prices) AS negative_prices, sum(zero_prices) AS zero_prices,
    sum(ohlc_errors) AS ohlc_errors, sum(negative_volume) AS negative_volume, sum(zero_volume) / sum(rows)::DOUBLE AS zero_volume_ratio,
    sum(coalesce((abs(ret) > 0.2)::INT, 0)) AS extreme_returns, max(ret) AS max_return, min(ret) AS min_return,
    sum(coalesce((pz > 3)::INT, 0)) AS price_outliers, sum(coalesce((vz > 5)::INT, 0)) AS volume_outliers,
    sum(coalesce((gap > 5)::INT, 0)) AS data_gaps, sum(coalesce((jump > 0.15)::INT, 0)) AS price_jumps FROM z GROUP BY 1)"""
_COUNTS = (
    "total_records duplicate_dates future_dates non_trading_days negative_prices zero_prices ohlc_errors "
    "negative_volume extreme_returns price_outliers volume_outliers data_gaps price_jumps"
).split()


def order_days(spark, folder):
    """Trading days: the weekdays on which orders came in."""
    days = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("date"))
    return cal.trading_days(days).where(F.weekday("date") < 5)


def _metrics(spark, folder):
    return qb.bar_metrics(landed_bars(spark, folder), AS_OF, cal.indexed(order_days(spark, folder)))


@query(
    "dq_bar_metrics",
    f"WITH {METRICS} SELECT symbol, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _COUNTS)}, {s('missing_ratio')} AS missing_ratio,"
    f" {s('zero_volume_ratio')} AS zero_volume_ratio, {s('max_return', 4)} AS max_return, {s('min_return', 4)} AS min_return FROM metrics",
)
def dq_bar_metrics(spark, folder):
    m = _metrics(spark, folder)
    return m.select(
        "symbol",
        *[F.col(c).cast("bigint").alias(c) for c in _COUNTS],
        *[snap(F.col(c), p).alias(c) for c, p in (("missing_ratio", 6), ("zero_volume_ratio", 6), ("max_return", 4), ("min_return", 4))],
    )


ISSUES = (
    METRICS
    + ", issues AS ("
    + " UNION ALL ".join(
        f"SELECT symbol, '{r.name}' AS rule, '{r.severity}' AS severity, {r.metric}::DOUBLE AS value, {r.threshold}::DOUBLE AS threshold FROM metrics WHERE {r.metric} > {r.threshold}"
        for r in qb.DEFAULT_RULES
    )
    + ")"
)


@query("dq_bar_issues", f"WITH {ISSUES} SELECT symbol, rule, severity, {s('value')} AS value, threshold FROM issues")
def dq_bar_issues(spark, folder):
    out = qb.issues(_metrics(spark, folder))
    return out.select("symbol", "rule", "severity", snap(F.col("value")).alias("value"), "threshold")


@query(
    "dq_bar_issues_by_severity",
    f"WITH {ISSUES} SELECT symbol, rule, {s('value')} AS value FROM issues WHERE severity = 'error' AND rule <> 'duplicate_dates'",
)
def dq_bar_issues_by_severity(spark, folder):
    rules = qb.RuleSet()
    rules.switch("duplicate_dates", False)
    out = qb.by_severity(qb.issues(_metrics(spark, folder), rules.active()), "error")
    return out.select("symbol", "rule", snap(F.col("value")).alias("value"))


_ASKED = "asked AS (SELECT DISTINCT p_brand AS symbol FROM part UNION SELECT DISTINCT concat('Brand#9', p_size) FROM part WHERE p_size < 4)"


def _state(spark, folder):
    metrics = _metrics(spark, folder)
    part = table(spark, folder, "part")
    asked = part.select(F.col("p_brand").alias("symbol")).union(
        part.where(F.col("p_size") < 4).select(F.concat(F.lit("Brand#9"), F.col("p_size").cast("string")))
    )
    found = qb.with_missing_symbols(qb.issues(metrics), metrics, asked)
    return found, qb.health(found, asked)


_HEALTH = f"""{ISSUES}, {_ASKED}, full_issues AS (SELECT * FROM issues UNION ALL SELECT symbol, 'no_data', 'error', 0.0, 0.0 FROM asked WHERE symbol NOT IN (SELECT symbol FROM metrics)),
state AS (SELECT a.symbol, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings
  FROM asked a LEFT JOIN full_issues i ON a.symbol = i.symbol GROUP BY 1)"""


@query("dq_bar_health", f"WITH {_HEALTH} SELECT symbol, errors, warnings, errors = 0 AS healthy FROM state")
def dq_bar_health(spark, folder):
    return _state(spark, folder)[1]


@query(
    "dq_bar_summary",
    f"""WITH {_HEALTH} SELECT count(*) AS total_symbols, count(*) FILTER (errors = 0) AS healthy_symbols,
      count(*) FILTER (errors > 0) AS symbols_with_errors, count(*) FILTER (warnings > 0) AS symbols_with_warnings,
      CAST(sum(errors + warnings) AS BIGINT) AS total_issues FROM state""",
)
def dq_bar_summary(spark, folder):
    return qb.summary(_state(spark, folder)[1])


@query(
    "dq_report_store",
    f"""WITH {_HEALTH}, n AS (SELECT symbol, count(*) AS issues FROM full_issues GROUP BY 1)
    SELECT symbol, errors, warnings, coalesce(issues, 0) AS issues, symbol IN (SELECT symbol FROM metrics) AS measured,
      (SELECT count(*) FILTER (errors > 0) FROM state) AS symbols_with_errors FROM state LEFT JOIN n USING (symbol)""",
)
def dq_report_store(spark, folder):
    """Reports are written as JSON and read back."""
    root = f"{checkpoint_dir(spark)}/reports/dq-{uuid.uuid4().hex}"
    found, state = _state(spark, folder)
    qb.save_reports(qb.symbol_reports(_metrics(spark, folder), found, state), state, root)
    reports, total = spark.read.json(f"{root}/symbols"), spark.read.json(f"{root}/summary")
    return reports.select(
        "symbol", "errors", "warnings", F.coalesce(F.size("issues"), F.lit(0)).cast("long").alias("issues"), F.col("metrics").isNotNull().alias("measured"),
        total.select("symbols_with_errors").scalar().alias("symbols_with_errors"),
    )


@query("dq_bar_breakdown", f"WITH {ISSUES} SELECT rule, count(*) AS issues FROM issues GROUP BY 1")
def dq_bar_breakdown(spark, folder):
    return qb.breakdown(qb.issues(_metrics(spark, folder)))


@query(
    "dq_bar_top_issues",
    f"WITH {ISSUES} SELECT symbol, rule, {s('value')} AS value FROM issues WHERE severity = 'error' ORDER BY issues.value DESC, symbol, rule LIMIT 10",
)
def dq_bar_top_issues(spark, folder):
    out = qb.top_issues(qb.issues(_metrics(spark, folder)))
    return out.select("symbol", "rule", snap(F.col("value")).alias("value"))


@query(
    "universe_by_quality",
    f"""WITH {LANDED}, g AS (SELECT symbol, count(*) AS rows, sum((open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT + (volume IS NULL)::INT) / (count(*) * 5.0) AS null_ratio
      FROM landed WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY 1)
    SELECT symbol, rows, {s('null_ratio')} AS null_ratio FROM g WHERE rows >= 1500 AND null_ratio <= 0.5""",
)
def universe_by_quality(spark, folder):
    out = qb.usable_symbols(landed_bars(spark, folder), "1996-01-01", "2000-12-31", min_days=1500)
    return out.select("symbol", "rows", snap(F.col("null_ratio")).alias("null_ratio"))


# --- calendar -------------------------------------------------------------------------

_CAL = "days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE isodow(o_orderdate) < 6)"


@query("calendar_days", f"WITH {_CAL} SELECT date FROM days WHERE year(date) BETWEEN 1996 AND 1999")
def calendar_days(spark, folder):
    return cal.trading_days(order_days(spark, folder), 1996, 1999)


@query("calendar_between", f"WITH {_CAL} SELECT date FROM days WHERE date BETWEEN DATE '1997-01-15' AND DATE '1997-03-10'")
def calendar_between(spark, folder):
    return cal.between(order_days(spark, folder), "1997-01-15", "1997-03-10")


@query(
    "calendar_neighbours",
    f"""WITH {_CAL}, span AS (SELECT CAST(unnest(generate_series(min(date) - INTERVAL 1 DAY, max(date) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM days),
    n AS (SELECT s.date, (SELECT count(*) FROM days d WHERE d.date = s.date) > 0 AS is_open,
      (SELECT min(d.date) FROM days d WHERE d.date > s.date) AS a, (SELECT max(d.date) FROM days d WHERE d.date < s.date) AS b FROM span s)
    SELECT date, is_open,
      CASE WHEN a - date <= 10 THEN a ELSE CAST(date + CASE isodow(date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS DATE) END AS next_day,
      CASE WHEN date - b <= 10 THEN b ELSE CAST(date - CASE isodow(date) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS DATE) END AS prev_day FROM n""",
)
def calendar_neighbours(spark, folder):
    return cal.neighbours(order_days(spark, folder))


@query(
    "calendar_weekdays",
    """SELECT date FROM (SELECT CAST(unnest(generate_series(make_date(min(year(o_orderdate))::INT, 1, 1), make_date(max(year(o_orderdate))::INT, 12, 31), INTERVAL 1 DAY)) AS DATE) AS date FROM orders)
    WHERE isodow(date) < 6""",
)
def calendar_weekdays(spark, folder):
    """Weekdays of the years the orders span."""
    years = table(spark, folder, "orders").agg(
        F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b")
    )
    one = F.lit(1)
    days = years.select(
        F.explode(F.sequence(F.make_date("a", one, one), F.make_date("b", F.lit(12), F.lit(31)))).alias("date")
    )
    return days.where(F.weekday("date") < 5)


@query(
    "calendar_membership",
    f"WITH {_CAL}, {BARS} SELECT symbol, date, volume FROM bars WHERE date IN (SELECT date FROM days)",
)
def calendar_membership(spark, folder):
    out = cal.on_trading_days(daily_bars(spark, folder), order_days(spark, folder))
    return out.select("symbol", "date", "volume")


# --- cleaning -------------------------------------------------------------------------

_HOLES = "holes AS (SELECT symbol, date, CASE WHEN volume % 3 = 0 THEN NULL ELSE close END AS close FROM bars)"


def _holes(spark, folder):
    return daily_bars(spark, folder).select(
        "symbol", "date", F.when(F.col("volume") % 3 == 0, None).otherwise(F.col("close")).alias("close")
    )


@query(
    "clean_fill",
    f"""WITH {BARS}, {_HOLES}, r AS (SELECT *, row_number() OVER ({WS}) AS i FROM holes),
    e AS (SELECT *, last_value(close IGNORE NULLS) OVER ({WS}) AS v0, first_value(close IGNORE NULLS) OVER ({WS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1,
      last_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) OVER ({WS}) AS i0,
      first_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) OVER ({WS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1 FROM r)
    SELECT symbol, date, {s('v0')} AS forward, {s('v1')} AS backward,
      {s('coalesce(close, v0 + coalesce((v1 - v0) * (i - i0) / nullif(i1 - i0, 0), 0))')} AS linear FROM e""",
)
def clean_fill(spark, folder):
    df = _holes(spark, folder).withColumns({c: F.col("close") for c in ("forward", "backward", "linear")})
    for column, how in (("forward", "forward"), ("backward", "backward"), ("linear", "interpolate")):
        df = qb.fill_gaps(df, column, how)
    return df.select("symbol", "date", *[snap(F.col(c)).alias(c) for c in ("forward", "backward", "linear")])


@query(
    "clean_adjusted_prices",
    f"""WITH {BARS}, f AS (SELECT *, 1 + (year(date) - 1994) * 0.5::DOUBLE AS k FROM bars)
    SELECT symbol, date, {s(f'open * k / last_value(k) OVER ({WS} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)')} AS qfq_open,
      {s('close * k')} AS hfq_close FROM f""",
)
def clean_adjusted_prices(spark, folder):
    bars = daily_bars(spark, folder).withColumn("adj_factor", 1 + (F.year("date") - 1994) * 0.5)
    q = qb.adjust_prices(bars.withColumn("__c", F.col("close")), how="qfq")
    return q.select(
        "symbol", "date", snap(F.col("open")).alias("qfq_open"), snap(F.col("__c") * F.col("adj_factor")).alias("hfq_close")
    )
