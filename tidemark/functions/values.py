"""Value, map and date normalisation as columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.columns import ratio

# Vendor column names and the names used here.
BAR_COLUMNS = {
    "日期": "date",
    "时间": "datetime",
    "开盘": "open",
    "收盘": "close",
    "最高": "high",
    "最低": "low",
    "成交量": "volume",
    "成交额": "amount",
    "振幅": "amplitude",
    "涨跌幅": "pct_chg",
    "涨跌额": "change",
    "换手率": "turnover",
    "代码": "symbol",
    "名称": "name",
    "最新价": "price",
    "昨收": "prev_close",
}
# Map keys per data type and the names used here.
FIELD_NAMES = {
    "stock_price": {
        "开盘": "open",
        "最高": "high",
        "最低": "low",
        "收盘": "close",
        "成交量": "volume",
        "成交额": "amount",
        "振幅": "amplitude",
        "涨跌幅": "change_pct",
        "涨跌额": "change_amount",
        "换手率": "turnover_rate",
        "trade_date": "date",
        "ts_code": "symbol",
        "vol": "volume",
        "pre_close": "prev_close",
        "pct_chg": "change_pct",
        "o": "open",
        "h": "high",
        "l": "low",
        "c": "close",
        "v": "volume",
        "adj_close": "close",
    },
    "financial": {
        "total_assets": "total_assets",
        "total_liab": "total_liabilities",
        "total_hldr_eqy_exc_min_int": "shareholders_equity",
        "total_revenue": "revenue",
        "n_income": "net_income",
        "operate_profit": "operating_profit",
        "n_cashflow_act": "operating_cash_flow",
        "n_cashflow_inv_act": "investing_cash_flow",
        "n_cashflow_fin_act": "financing_cash_flow",
    },
    "market_index": {
        "index_code": "symbol",
        "index_name": "name",
        "close_point": "close",
        "change_point": "change_amount",
        "change_rate": "change_pct",
    },
}
PRICE_KEYS = ("open", "high", "low", "close", "price")


def rename(df: DataFrame, names: Mapping[str, str] = BAR_COLUMNS) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def to_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unreadable text becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns if c in df.columns})


def map_fields(values: Column, data_type: str) -> Column:
    names = F.create_map(*[F.lit(x) for kv in FIELD_NAMES[data_type].items() for x in kv])
    return F.transform_keys(values, lambda k, v: F.coalesce(F.try_element_at(names, k), k))


def clean_number(x: Column) -> Column:
    """NaN, infinities and anything beyond 1e15 become 0."""
    return F.when(F.isnan(x) | (F.abs(x) > 1e15), 0.0).otherwise(x)


def clean_text(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), "[\\x00-\\x1f\\x7f-\\x9f]", "")


def convert_values(values: Column, source: Column) -> Column:
    """Units per key: lots to shares, amount to ten thousands, percent to share,
    prices to two decimals (half to even), all else cleaned."""

    def one(k: Column, v: Column) -> Column:
        return (
            F.when(k.isin("volume", "vol") & (source == "akshare"), v * 100)
            .when(k.isin("volume", "vol") & (source == "tushare"), v)
            .when(k == "amount", v / 10000)
            .when(k.isin("change_pct", "pct_chg"), F.when(F.abs(v) > 1, v / 100).otherwise(v))
            .when(k.isin(*PRICE_KEYS), F.bround(v, 2))
            .otherwise(clean_number(v))
        )

    return F.transform_values(values, one)


def drop_empty(values: Column) -> Column:
    return F.map_filter(values, lambda k, v: v.isNotNull() & ~F.isnan(v))


def lowered_quality(before: Column, after: Column, quality: Column) -> Column:
    """Nine tenths of the score where entries were dropped."""
    return F.when(F.size(after) < F.size(before), quality * 0.9).otherwise(quality)


def china_time_to_utc(ts: Column) -> Column:
    """A naive instant is Asia/Shanghai; it is kept as UTC."""
    return F.to_utc_timestamp(ts, "Asia/Shanghai")


Rule = tuple[int, str, Mapping[str, Callable[[], Column]]]


def apply_rules(df: DataFrame, rules: Sequence[Rule], source: str = "source") -> DataFrame:
    """Fold (priority, source pattern, column -> new value) rules in priority order.

    A rule changes only rows whose source its pattern fits; the whole chain stays one
    projection.
    """
    for _, pattern, changes in sorted(rules, key=lambda r: r[0]):
        fits = F.col(source).rlike(pattern)
        df = df.withColumns({c: F.when(fits, new()).otherwise(F.col(c)) for c, new in changes.items()})
    return df


def price_fields(prev_close: Column, factor: Column | None = None) -> dict[str, Column]:
    """Documented derived fields of a bar."""
    c, h, low = F.col("close"), F.col("high"), F.col("low")
    out = {
        "change": c - prev_close,
        "pct_chg": ratio(c - prev_close, prev_close) * 100,
        "amplitude": ratio(h - low, prev_close) * 100,
    }
    if factor is not None:
        out |= {f"adj_{p}": F.col(p) * factor for p in ("open", "high", "low", "close")}
    return out


def fundamental_ratios() -> dict[str, Column]:
    """EPS, ROE, ROA, debt ratio and price multiples of a joined fundamentals row."""
    c = F.col
    return {
        "eps": ratio(c("net_profit"), c("shares")),
        "roe": ratio(c("net_profit"), c("equity")) * 100,
        "roa": ratio(c("net_profit"), c("total_assets")) * 100,
        "debt_ratio": ratio(c("total_liabilities"), c("total_assets")) * 100,
        "pe": ratio(c("market_cap"), c("net_profit")),
        "pb": ratio(c("market_cap"), c("equity")),
        "ps": ratio(c("market_cap"), c("revenue")),
        "pcf": ratio(c("market_cap"), c("operating_cash_flow")),
    }
