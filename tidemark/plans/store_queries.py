"""Storage, landing, export and normalisation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.columns import ordered, snap
from tidemark.functions import symbols as sy
from tidemark.functions import text as tx
from tidemark.functions import values as va
from tidemark.operators.predicates import recent
from tidemark.plans.registry import query
from tidemark.plans.sql import BARS, WS, div
from tidemark.plans.sql import snap as s
from tidemark.session import checkpoint_dir
from tidemark.sources import bundle, landing, points, store
from tidemark.sources.bars import daily_bars, minute_bars
from tidemark.sources.tables import table


def scratch(spark, name):
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/stores/{name}-{uuid.uuid4().hex}"


def coded_bars(spark, folder):
    """Bars whose symbol is an exchange code made from the brand number."""
    n = F.split("symbol", "#")[1]
    code = F.concat(F.when(n.cast("int") % 2 == 1, "600").otherwise("000"), F.lpad(n, 3, "0"))
    return daily_bars(spark, folder).withColumn("symbol", sy.standard_symbol(code))


_CODED = f"""{BARS}, coded AS (SELECT CASE WHEN CAST(split_part(symbol, '#', 2) AS INT) % 2 = 1 THEN concat('600', lpad(split_part(symbol, '#', 2), 3, '0'), '.SH')
    ELSE concat('000', lpad(split_part(symbol, '#', 2), 3, '0'), '.SZ') END AS symbol, date, open, high, low, close, volume, amount FROM bars)"""


def _stored(spark, folder):
    root = scratch(spark, "daily")
    bars = coded_bars(spark, folder)
    store.write_daily_bars(spark, bars.where(F.col("date") < "1999-01-01"), root)
    late = bars.where(F.col("date") >= "1998-07-01").withColumn("close", F.col("close") * 1.5)
    store.write_daily_bars(spark, late, root)
    return root


@query(
    "store_upsert",
    f"""WITH {_CODED} SELECT symbol, date, {s('open')} AS open, {s("CASE WHEN date >= DATE '1998-07-01' THEN close * 1.5::DOUBLE ELSE close END")} AS close, volume FROM coded""",
)
def store_upsert(spark, folder):
    out = store.read_daily_bars(spark, _stored(spark, folder))
    return out.select("symbol", "date", snap(F.col("open")).alias("open"), snap(F.col("close")).alias("close"), "volume")


@query(
    "store_range_scan",
    f"""WITH {_CODED} SELECT symbol, date, {s('open')} AS open, volume FROM coded
    WHERE symbol IN ('600001.SH', '000002.SZ') AND date BETWEEN DATE '1997-03-01' AND DATE '1998-03-31'""",
)
def store_range_scan(spark, folder):
    root = scratch(spark, "daily")
    store.write_daily_bars(spark, coded_bars(spark, folder), root)
    out = store.read_daily_bars(spark, root, ["600001.SH", "000002.SZ"], "1997-03-01", "1998-03-31")
    return out.select("symbol", "date", snap(F.col("open")).alias("open"), "volume")


@query(
    "store_statistics",
    f"WITH {_CODED} SELECT split_part(symbol, '.', 2) AS exchange, count(DISTINCT symbol) AS symbols, count(*) AS rows FROM coded GROUP BY 1",
)
def store_statistics(spark, folder):
    root = scratch(spark, "daily")
    store.write_daily_bars(spark, coded_bars(spark, folder), root)
    return store.statistics(spark, root).select("exchange", "symbols", "rows")


@query("store_symbols", f"WITH {_CODED} SELECT DISTINCT symbol FROM coded")
def store_symbols(spark, folder):
    root = scratch(spark, "daily")
    store.write_daily_bars(spark, coded_bars(spark, folder), root)
    return store.list_symbols(spark, root)


@query(
    "store_missing_symbols",
    f"WITH {_CODED} SELECT DISTINCT symbol FROM coded WHERE symbol NOT IN (SELECT symbol FROM coded WHERE date BETWEEN DATE '1995-01-02' AND DATE '1995-01-02')",
)
def store_missing_symbols(spark, folder):
    bars = coded_bars(spark, folder)
    return store.missing_symbols(bars, bars, "1995-01-02", "1995-01-02")


@query(
    "store_minute_bars",
    """SELECT event_type AS symbol, CAST(time_bucket(INTERVAL 30 MINUTE, ts) AS DATE) AS date, count(DISTINCT time_bucket(INTERVAL 30 MINUTE, ts)) AS bars, count(*) AS volume
    FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2""",
)
def store_minute_bars(spark, folder):
    """Write, then keep what retention keeps, then read."""
    root, kept = scratch(spark, "minute"), scratch(spark, "kept")
    store.write_minute_bars(minute_bars(spark, folder, 30), root, 30)
    store.drop_old_days(spark, root, kept, "2024-01-30", keep_days=15)
    out = store.read_minute_bars(spark, kept, 30)
    return out.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"))


@query(
    "store_minute_expired",
    """WITH b AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, count(DISTINCT time_bucket(INTERVAL 30 MINUTE, ts)) AS bars FROM events GROUP BY 1, 2)
    SELECT symbol, date, bars, (SELECT count(DISTINCT date) FROM b WHERE date < DATE '2024-01-15') AS expired FROM b WHERE date >= DATE '2024-01-15'""",
)
def store_minute_expired(spark, folder):
    """Folders of days out of retention are deleted where they lie; what is left is read."""
    root = scratch(spark, "minute")
    store.write_minute_bars(minute_bars(spark, folder, 30), root, 30)
    gone = store.expire_days(spark, root, "2024-01-30", keep_days=15)
    out = store.read_minute_bars(spark, root, 30).groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("bars"))
    return out.withColumn("expired", F.lit(gone).cast("bigint"))


@query(
    "store_by_code",
    f"""WITH {_CODED} SELECT 'D' AS freq, symbol, date::VARCHAR AS at, {s('close')} AS close FROM coded WHERE symbol = '600001.SH' AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
    UNION ALL SELECT '30', 'view', strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%d %H:%M'), {s('arg_max(value, row(ts, event_id))')} FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-10' GROUP BY 3""",
)
def store_by_code(spark, folder):
    """One reader and writer for days and minutes, told apart by the frequency."""
    days, minutes = scratch(spark, "daily"), scratch(spark, "minute")
    store.write_code(spark, days, coded_bars(spark, folder))
    store.write_code(spark, minutes, minute_bars(spark, folder, 30), freq="30")
    daily = store.read_code(spark, days, "600001.SH", "1996-01-01", "1998-12-31")
    fine = store.read_code(spark, minutes, "view", "2024-01-10", freq="30")
    at = [F.col("date").cast("string"), F.date_format("datetime", "yyyy-MM-dd HH:mm")]
    return daily.select(F.lit("D").alias("freq"), "symbol", at[0].alias("at"), snap(F.col("close")).alias("close")).unionByName(
        fine.select(F.lit("30").alias("freq"), "symbol", at[1].alias("at"), snap(F.col("close")).alias("close"))
    )


# --- landing --------------------------------------------------------------------------


def _vendor_file(spark, folder):
    """Trades as a vendor would land them: vendor names, text cells, some unreadable."""
    c = F.col
    t = table(spark, folder, "lineitem")
    code = F.concat(F.lit(" "), F.lpad((c("l_suppkey") * 7919 % 700000).cast("string"), 6, "0"))
    price = c("l_extendedprice") / c("l_quantity")
    return t.select(
        code.alias("代码"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("日期"),
        price.cast("string").alias("开盘"),
        (price * 2).cast("string").alias("最高"),
        (price * 0.5).cast("string").alias("最低"),
        F.when(c("l_quantity") == 7, "--").otherwise(price.cast("string")).alias("收盘"),
        c("l_quantity").cast("string").alias("成交量"),
    )


_LAND = """v AS (SELECT DISTINCT lpad((l_suppkey * 7919 % 700000)::VARCHAR, 6, '0') AS code, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS open,
    CASE WHEN l_quantity = 7 THEN NULL ELSE l_extendedprice / l_quantity END AS close, l_quantity AS volume FROM lineitem),
    std AS (SELECT concat(code, CASE WHEN substr(code, 1, 3) IN ('600', '601', '603', '605', '688') THEN '.SH' ELSE '.SZ' END) AS symbol, v.* FROM v)"""


@query(
    "landing_daily",
    f"""WITH {_LAND} SELECT symbol, date, CAST(date - 1 AS DATE) AS utc_day, {s('open')} AS open, {s('close')} AS close, volume FROM std""",
)
def landing_daily(spark, folder):
    path = scratch(spark, "landed")
    _vendor_file(spark, folder).write.option("header", "true").csv(path)
    names = ", ".join(f"`{c}` string" for c in ("代码", "日期", "开盘", "最高", "最低", "收盘", "成交量"))
    out = landing.daily_frame(landing.read_landed(spark, path, "csv", names))
    return out.select(
        "symbol", "date", F.to_date("ts_utc").alias("utc_day"), snap(F.col("open")).alias("open"), snap(F.col("close")).alias("close"), "volume"
    )


@query(
    "landing_minutes",
    f"""WITH v AS (SELECT DISTINCT lpad((user_id * 7919 % 700000)::VARCHAR, 6, '0') AS code, date_trunc('second', ts) - INTERVAL 8 HOUR AS utc, value FROM events)
    SELECT concat(code, CASE WHEN substr(code, 1, 3) IN ('600', '601', '603', '605', '688') THEN '.SH' ELSE '.SZ' END) AS symbol, strftime(utc, '%Y-%m-%d %H:%M:%S') AS at, {s('value')} AS close, {s('value * 2')} AS high
    FROM v WHERE utc BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""",
)
def landing_minutes(spark, folder):
    c = F.col
    value = c("value").cast("string")
    landed = table(spark, folder, "events").select(
        F.lpad((c("user_id") * 7919 % 700000).cast("string"), 6, "0").alias("代码"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("时间"),
        value.alias("开盘"), (c("value") * 2).cast("string").alias("最高"), value.alias("最低"), value.alias("收盘"), F.lit("100").alias("成交量"),
    )
    out = landing.minute_frame(landed, "2024-01-05 00:00:00", "2024-01-20 12:00:00")
    return out.select("symbol", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("at"), snap(c("close")).alias("close"), snap(c("high")).alias("high"))


@query("landing_backtest_prices", f"WITH {_CODED} SELECT date, {s('close')} AS close, symbol FROM coded")
def landing_backtest_prices(spark, folder):
    return landing.backtest_prices(coded_bars(spark, folder)).withColumn("close", snap(F.col("close")))


@query(
    "normalize_cells",
    r"""SELECT doc_id, md5(regexp_replace(trim(text), '[\x00-\x1f\x7f-\x{9f}]', '', 'g')) AS cleaned,
      CASE WHEN doc_id % 3 = 0 THEN '000300.SH' WHEN doc_id % 3 = 1 THEN '399006.SZ' ELSE lpad(doc_id::VARCHAR, 6, '9') END AS index_symbol FROM documents""",
)
def normalize_cells(spark, folder):
    """Text cells without control characters, and codes of indices."""
    c = F.col
    code = F.when(c("doc_id") % 3 == 0, "000300").when(c("doc_id") % 3 == 1, "399006").otherwise(F.lpad(c("doc_id").cast("string"), 6, "9"))
    return table(spark, folder, "documents").select("doc_id", F.md5(va.clean_text(c("text"))).alias("cleaned"), sy.index_symbol(code).alias("index_symbol"))


@query(
    "landing_futures",
    f"""WITH {_LAND}, k AS (SELECT symbol FROM (SELECT DISTINCT * FROM std) GROUP BY 1 HAVING avg((close IS NULL)::INT) <= 0.02)
    SELECT symbol, count(*) AS rows FROM std WHERE symbol IN (SELECT symbol FROM k) GROUP BY 1""",
)
def landing_futures(spark, folder):
    rows = _vendor_file(spark, folder).distinct()
    out = landing.futures_frame(rows, va.BAR_COLUMNS, max_null=0.02)
    return out.groupBy(sy.standard_symbol(F.col("symbol")).alias("symbol")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "landing_stock_list",
    """SELECT DISTINCT concat(lpad(s_suppkey::VARCHAR, 6, '0'), '.SZ') AS symbol, s_name AS name, 'SZ' AS exchange FROM supplier""",
)
def landing_stock_list(spark, folder):
    landed = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("代码"), F.col("s_name").alias("名称"))
    return landing.stock_list(landed)


@query(
    "landing_quotes",
    """SELECT concat(lpad(s_suppkey::VARCHAR, 6, '0'), '.SZ') AS symbol, s_acctbal AS price, DATE '2024-01-02' AS day FROM supplier WHERE s_suppkey IN (1, 2, 3)""",
)
def landing_quotes(spark, folder):
    landed = table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("代码"), F.col("s_acctbal").cast("string").alias("最新价")
    )
    out = landing.quotes(landed, ["000001.SZ", "000002.SZ", "000003.SZ"], "2024-01-02 09:30:00")
    return out.select("symbol", "price", F.to_date("timestamp").alias("day"))


@query(
    "landing_union",
    f"""WITH {BARS} SELECT symbol, date, volume FROM bars WHERE symbol IN ('Brand#1', 'Brand#2') AND date BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'
    UNION ALL SELECT symbol, date, volume FROM bars WHERE symbol = 'Brand#3'""",
)
def landing_union(spark, folder):
    bars = daily_bars(spark, folder)
    a = landing.filtered(bars, "symbol", ["Brand#1", "Brand#2"], "date", "1996-01-01", "1996-06-30")
    b = landing.filtered(bars, "symbol", ["Brand#3"])
    return landing.union_all([a, b.drop("amount")]).select("symbol", "date", "volume")


@query(
    "landing_points",
    """SELECT concat('P', l_partkey) AS symbol, CAST(l_shipdate AS DATE) AS day, l_quantity AS quantity, l_tax AS tax, l_returnflag AS flag FROM lineitem""",
)
def landing_points(spark, folder):
    lines = table(spark, folder, "lineitem").withColumnsRenamed({"l_quantity": "quantity", "l_tax": "tax", "l_returnflag": "flag"})
    out = points.to_points(
        lines, F.concat(F.lit("P"), F.col("l_partkey").cast("string")), F.col("l_shipdate"), ["quantity", "tax", "flag"], "stock_price", F.lit("files"), "b1"
    )
    return out.select(
        "symbol", F.to_date("timestamp").alias("day"), F.col("values")["quantity"].alias("quantity"), F.col("values")["tax"].alias("tax"), F.col("texts")["flag"].alias("flag")
    )


@query(
    "landing_news",
    """SELECT doc_id AS id FROM documents WHERE (contains(text, 'tion') OR contains(text, 'ment')) AND (contains(text, 'ouou') OR contains(source, 'src1'))""",
)
def landing_news(spark, folder):
    news = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("title"))
    return points.news_points(news, ["tion", "ment"], ["ouou", "src1"]).select("id")


# --- export ---------------------------------------------------------------------------


@query(
    "export_calendar",
    f"WITH {BARS} SELECT DISTINCT date FROM bars",
)
def export_calendar(spark, folder):
    bars = daily_bars(spark, folder).select("date")
    both = bars.select(F.col("date").cast("string")).union(bars.select(F.date_format("date", "yyyyMMdd")))
    return bundle.calendar_lines(both)


@query(
    "export_instruments",
    f"WITH {_CODED} SELECT DISTINCT concat(split_part(symbol, '.', 2), split_part(symbol, '.', 1)) AS instrument, '2018-01-01' AS start_date, '2030-12-31' AS end_date FROM coded",
)
def export_instruments(spark, folder):
    return bundle.instrument_rows(coded_bars(spark, folder))


@query(
    "export_features",
    f"""WITH {_CODED} SELECT concat(split_part(symbol, '.', 2), split_part(symbol, '.', 1)) AS instrument, epoch(date)::BIGINT AS epoch,
      {s('close::FLOAT::DOUBLE', 3)} AS close, volume::FLOAT::DOUBLE AS volume, 1.0::DOUBLE AS factor FROM coded""",
)
def export_features(spark, folder):
    out = bundle.feature_rows(coded_bars(spark, folder))
    return out.select(
        "instrument",
        "epoch",
        snap(F.col("`$close`").cast("double"), 3).alias("close"),
        F.col("`$volume`").cast("double").alias("volume"),
        F.col("`$factor`").cast("double").alias("factor"),
    )


@query(
    "export_bundle",
    f"""WITH {_CODED} SELECT count(DISTINCT date) AS days, count(DISTINCT symbol) AS instruments, count(*) AS rows, 0::BIGINT AS empty_instruments, true AS valid FROM coded""",
)
def export_bundle(spark, folder):
    """Build from the first years, update with all, validate."""
    bars = coded_bars(spark, folder)
    first, second = scratch(spark, "bundle"), scratch(spark, "bundle")
    early = bars.where(F.col("date") < "1997-01-01")
    bundle.build(spark, early, early.select("symbol"), first)
    bundle.update(spark, first, second, bars, bars.select("symbol"))
    return bundle.validate(spark, second).drop("missing_fields")


# --- normalisation --------------------------------------------------------------------

_CODES = """c AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN concat(' ', (c_custkey * 7919 % 700000)::VARCHAR) WHEN 1 THEN concat(lpad((c_custkey * 131 % 1000)::VARCHAR, 6, '6'), '.sh')
    WHEN 2 THEN concat(lpad((c_custkey * 37 % 400000)::VARCHAR, 6, '0'), '.SZ') WHEN 3 THEN concat(lpad((c_custkey * 11 % 1000)::VARCHAR, 6, '6'), '.SS') ELSE concat('688', lpad((c_custkey % 1000)::VARCHAR, 3, '0')) END AS code,
    CASE c_custkey % 3 WHEN 0 THEN 'akshare' WHEN 1 THEN 'tushare' ELSE 'yahoo' END AS source FROM customer)"""


def _codes(spark, folder):
    k = F.col("c_custkey")

    def digits(n, width, fill):
        return F.lpad(n.cast("string"), width, fill)

    code = (
        F.when(k % 5 == 0, F.concat(F.lit(" "), (k * 7919 % 700000).cast("string")))
        .when(k % 5 == 1, F.concat(digits(k * 131 % 1000, 6, "6"), F.lit(".sh")))
        .when(k % 5 == 2, F.concat(digits(k * 37 % 400000, 6, "0"), F.lit(".SZ")))
        .when(k % 5 == 3, F.concat(digits(k * 11 % 1000, 6, "6"), F.lit(".SS")))
        .otherwise(F.concat(F.lit("688"), digits(k % 1000, 3, "0")))
    )
    source = F.when(k % 3 == 0, "akshare").when(k % 3 == 1, "tushare").otherwise("yahoo")
    return table(spark, folder, "customer").select("c_custkey", code.alias("code"), source.alias("source"))


_U = "upper(trim(code))"
_PRE = "CASE WHEN substr({0}, 1, 3) IN ('600', '601', '603', '605', '688') THEN 'SH' ELSE 'SZ' END"
_HEAD = f"split_part({_U}, '.', 1)"
_STD = f"concat(CASE WHEN length({_HEAD}) < 6 THEN lpad({_HEAD}, 6, '0') ELSE {_HEAD} END, '.', CASE WHEN contains({_U}, '.') THEN split_part({_U}, '.', 2) ELSE {_PRE.format(_U)} END)"
_FIRST = "CASE WHEN {0} LIKE '6%' THEN concat({0}, '.SH') WHEN {0} LIKE '0%' OR {0} LIKE '3%' THEN concat({0}, '.SZ') ELSE {0} END"


@query(
    "normalize_symbols",
    f"""WITH {_CODES} SELECT c_custkey, {_STD} AS standard, concat(trim(code), '.', {_PRE.format('trim(code)')}) AS vendor,
      CASE WHEN contains(code, '.') THEN split_part(code, '.', 2) ELSE {_PRE.format('trim(code)')} END AS exchange,
      CASE WHEN source = 'akshare' AND NOT contains({_U}, '.') THEN {_FIRST.format(_U)} WHEN source = 'yahoo' AND {_U} LIKE '%.SS' THEN replace({_U}, '.SS', '.SH') ELSE {_U} END AS by_source,
      CASE WHEN contains(code, '.') AND upper(split_part(code, '.', 2)) IN ('SH', 'SZ') THEN concat(split_part(code, '.', 1), '.', upper(split_part(code, '.', 2))) ELSE {_FIRST.format('code')} END AS second_vendor,
      CASE WHEN split_part({_STD}, '.', 2) IN ('SH', 'SZ') THEN concat(split_part({_STD}, '.', 2), split_part({_STD}, '.', 1)) END AS prefixed,
      CASE WHEN contains({_U}, '.') AND split_part({_U}, '.', 2) IN ('SH', 'SZ') THEN split_part({_U}, '.', 2) WHEN substr({_U}, 1, 2) IN ('SH', 'SZ') THEN substr({_U}, 1, 2) ELSE 'SH' END AS market
    FROM c""",
)
def normalize_symbols(spark, folder):
    c = F.col("code")
    std = sy.standard_symbol(c)
    return _codes(spark, folder).select(
        "c_custkey",
        std.alias("standard"),
        sy.vendor_to_standard(c).alias("vendor"),
        sy.exchange_of(c).alias("exchange"),
        sy.source_symbol(c, F.col("source")).alias("by_source"),
        sy.vendor_code(c).alias("second_vendor"),
        sy.to_prefixed(std).alias("prefixed"),
        sy.market_and_code(c)["market"].alias("market"),
    )


@query(
    "normalize_values",
    f"""WITH v AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'akshare' ELSE 'tushare' END AS source, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN source = 'akshare' THEN l_quantity * 100 ELSE l_quantity END AS volume, {s('l_extendedprice / 10000')} AS amount,
      {s('CASE WHEN abs(l_discount * 30) > 1 THEN l_discount * 30 / 100 ELSE l_discount * 30 END')} AS change_pct, CASE WHEN l_quantity = 50 THEN 0 ELSE l_tax END AS turnover_rate FROM v""",
)
def normalize_values(spark, folder):
    c = F.col
    t = table(spark, folder, "lineitem").withColumn("source", F.when(c("l_linestatus") == "O", "akshare").otherwise("tushare"))
    raw = F.create_map(
        F.lit("v"), c("l_quantity"), F.lit("amount"), c("l_extendedprice"), F.lit("pct_chg"), c("l_discount") * 30,
        F.lit("turnover_rate"), F.when(c("l_quantity") == 50, float("nan")).otherwise(c("l_tax")),
    )
    out = t.withColumn("values", va.convert_values(va.map_fields(raw, "stock_price"), c("source")))
    v = F.col("values")
    return out.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        v["volume"].alias("volume"), snap(v["amount"]).alias("amount"), snap(v["change_pct"]).alias("change_pct"), v["turnover_rate"].alias("turnover_rate"),
    )


@query(
    "normalize_rule_chain",
    f"""SELECT event_id, event_type AS source, {s("CASE WHEN event_type LIKE 'c%' THEN (value + 1) * 2 WHEN event_type LIKE 'p%' THEN value * 2 ELSE value END")} AS value,
      {s("CASE WHEN event_id % 4 = 0 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END")} AS quality FROM events""",
)
def normalize_rule_chain(spark, folder):
    e = table(spark, folder, "events").select("event_id", F.col("event_type").alias("source"), "value")
    rules = [
        (20, "^(c|p)", {"value": lambda: F.col("value") * 2}),
        (10, "^click", {"value": lambda: F.col("value") + 1}),
    ]
    out = va.apply_rules(e, rules)
    before = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.when(F.col("event_id") % 4 == 0, None).otherwise(F.lit(2.0)))
    out = out.withColumn("before", before).withColumn("after", va.drop_empty(F.col("before")))
    return out.select(
        "event_id", "source", snap(F.col("value")).alias("value"),
        snap(va.lowered_quality(F.col("before"), F.col("after"), F.lit(1.0))).alias("quality"),
    )


@query(
    "normalize_text",
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^\x{4e00}-\x{9fa5}a-zA-Z0-9\s.,;:!?()\[\]{}"''%$/-]', '', 'g'))) AS cleaned,
      CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[。！？；\n]'), lambda x: trim(x)), lambda x: x <> '')) AS INT) AS sentences FROM documents""",
)
def normalize_text(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.md5(tx.clean_text(F.col("text"))).alias("cleaned"), F.size(tx.sentences(F.col("text"))).alias("sentences"))


@query(
    "normalize_dates",
    """SELECT event_id, regexp_matches(CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y%m%d') END, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AS iso, ts - INTERVAL 8 HOUR AS utc FROM events""",
)
def normalize_dates(spark, folder):
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyyMMdd"))
    return e.select("event_id", sy.is_iso_date(text).alias("iso"), va.china_time_to_utc(F.col("ts")).cast("timestamp_ntz").alias("utc"))


@query(
    "price_derived_fields",
    f"""WITH {BARS}, l AS (SELECT *, lag(close) OVER ({WS}) AS p FROM bars)
    SELECT symbol, date, {s('close - p')} AS change, {s(div('close - p', 'p') + ' * 100', 4)} AS pct_chg, {s(div('high - low', 'p') + ' * 100', 4)} AS amplitude, {s('close * 1.5::DOUBLE')} AS adj_close FROM l""",
)
def price_derived_fields(spark, folder):
    w = ordered(["symbol"], ["date"])
    bars = daily_bars(spark, folder).withColumn("p", F.lag("close").over(w))
    f = va.price_fields(F.col("p"), F.lit(1.5))
    return bars.select(
        "symbol", "date", snap(f["change"]).alias("change"), snap(f["pct_chg"], 4).alias("pct_chg"), snap(f["amplitude"], 4).alias("amplitude"), snap(f["adj_close"]).alias("adj_close")
    )


@query(
    "fundamental_ratios",
    f"""WITH f AS (SELECT l_suppkey, sum(l_extendedprice) AS revenue, sum(l_extendedprice * l_discount) AS net_profit, sum(l_quantity) AS shares, sum(l_extendedprice * l_tax) AS liab FROM lineitem GROUP BY 1)
    SELECT l_suppkey, {s(div('net_profit', 'shares'))} AS eps, {s(div('net_profit', 's_acctbal') + ' * 100', 4)} AS roe, {s(div('net_profit', 'revenue') + ' * 100')} AS roa, {s(div('liab', 'revenue') + ' * 100')} AS debt_ratio,
      {s(div('s_acctbal * 1000', 'net_profit'))} AS pe, {s(div('s_acctbal * 1000', 'revenue'))} AS ps FROM f JOIN supplier ON l_suppkey = s_suppkey""",
)
def fundamental_ratios(spark, folder):
    c = F.col
    f = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.sum("l_extendedprice").alias("revenue"),
        F.sum(c("l_extendedprice") * c("l_discount")).alias("net_profit"),
        F.sum("l_quantity").alias("shares"),
        F.sum(c("l_extendedprice") * c("l_tax")).alias("total_liabilities"),
    )
    joined = f.join(table(spark, folder, "supplier"), c("l_suppkey") == c("s_suppkey")).withColumns(
        {"equity": c("s_acctbal"), "total_assets": c("revenue"), "market_cap": c("s_acctbal") * 1000, "operating_cash_flow": c("net_profit")}
    )
    r = va.fundamental_ratios()
    places = {"roe": 4}
    return joined.select("l_suppkey", *[snap(r[k], places.get(k, 6)).alias(k) for k in ("eps", "roe", "roa", "debt_ratio", "pe", "ps")])


# --- sorting and paging ---------------------------------------------------------------


@query(
    "page_of_quotes",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 100",
)
def page_of_quotes(spark, folder):
    page, size = 3, 50
    return (
        table(spark, folder, "customer")
        .select("c_custkey", "c_acctbal")
        .orderBy(F.desc("c_acctbal"), "c_custkey")
        .offset((page - 1) * size)
        .limit(size)
    )


@query(
    "latest_signals",
    "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, value DESC, event_id LIMIT 100",
)
def latest_signals(spark, folder):
    e = table(spark, folder, "events").where(F.col("event_type") == "purchase")
    return e.orderBy(F.desc("ts"), F.desc("value"), "event_id").limit(100).select("event_id", "user_id", "value")


@query(
    "last_rows_per_user",
    "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3",
)
def last_rows_per_user(spark, folder):
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, folder, "events").withColumn("n", F.row_number().over(newest))
    return e.where(F.col("n") <= 3).select("user_id", "event_id")


@query(
    "recent_window",
    "SELECT event_type, count(*) AS rows FROM events WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 72 HOUR AND ts <= TIMESTAMP '2024-01-25' GROUP BY 1",
)
def recent_window(spark, folder):
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return recent(e, "ts", "2024-01-25 00:00:00", hours=72).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))

