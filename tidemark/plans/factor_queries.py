"""Factor, evaluation, back-test and portfolio queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.columns import ratio, snap
from tidemark.operators import evaluation as ev
from tidemark.operators import factors as fc
from tidemark.operators import portfolio as pf
from tidemark.plans.factor_sql import BUCKETS, FACTORS, NAMES, PANEL, SERIES
from tidemark.plans.registry import query
from tidemark.plans.sql import BARS, WS, div, lag
from tidemark.plans.sql import snap as s
from tidemark.session import cut_lineage
from tidemark.sources.bars import daily_bars


def _wide(spark, folder):
    return fc.forward_return(fc.builtin_factors(daily_bars(spark, folder)))


def _panel(spark, folder, names=fc.BUILT_IN):
    return fc.factor_panel(_wide(spark, folder), names)


def _both(spark, folder, names=fc.BUILT_IN):
    return _panel(spark, folder, names).where(F.col("value").isNotNull() & F.col("fwd_ret").isNotNull())


def _shown(df, places, *keep):
    return df.select(*keep, *[snap(F.col(c), p).alias(c) for c, p in places.items()])


@query(
    "factor_builtin",
    f"WITH {FACTORS} SELECT symbol, date, " + ", ".join(f"{s(n, 5)} AS {n}" for n in (*NAMES, "fwd_ret")) + " FROM fac",
)
def factor_builtin(spark, folder):
    return _shown(_wide(spark, folder), dict.fromkeys((*NAMES, "fwd_ret"), 5), "symbol", "date")


@query(
    "factor_composite_score",
    f"""WITH {PANEL}, z AS (SELECT *, avg(value) OVER ({SERIES}) AS m, stddev_samp(value) OVER ({SERIES}) AS sd
      FROM panel WHERE value IS NOT NULL AND factor_id IN ('momentum_20d', 'volatility_20d', 'rsi_14d'))
    SELECT symbol, date, {s("sum((CASE WHEN sd > 0 THEN (value - m) / sd ELSE value - m END) * CASE factor_id WHEN 'momentum_20d' THEN 0.5 WHEN 'volatility_20d' THEN 0.2 ELSE 0.1 END) / 0.8")} AS score
    FROM z GROUP BY 1, 2""",
)
def factor_composite_score(spark, folder):
    panel = _panel(spark, folder).where(F.col("value").isNotNull())
    weights = {"momentum_20d": 0.5, "volatility_20d": 0.2, "rsi_14d": 0.1, "volume_ratio_20d": 0.0}
    return _shown(fc.composite_score(panel, weights), {"score": 6}, "symbol", "date")


@query(
    "factor_store_latest",
    f"""WITH {PANEL}, r AS (SELECT *, row_number() OVER ({SERIES} ORDER BY date DESC) AS n FROM panel WHERE value IS NOT NULL)
    SELECT factor_id, symbol, date, {s('value', 5)} AS value FROM r WHERE n <= 100""",
)
def factor_store_latest(spark, folder):
    return _shown(fc.latest_values(_panel(spark, folder), 100), {"value": 5}, "factor_id", "symbol", "date")


@query(
    "factor_export_range",
    f"""WITH {PANEL} SELECT factor_id, symbol, date, {s('value', 5)} AS value FROM panel
    WHERE factor_id IN ('momentum_20d', 'rsi_14d') AND date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""",
)
def factor_export_range(spark, folder):
    out = fc.export_range(_panel(spark, folder), ["momentum_20d", "rsi_14d"], "1998-01-01", "1998-12-31")
    return _shown(out, {"value": 5}, "factor_id", "symbol", "date")


_MEAN = "avg(value) OVER (PARTITION BY factor_id)"


@query(
    "factor_descriptive",
    f"""WITH {PANEL}, d AS (SELECT factor_id, value - {_MEAN} AS c, value FROM pairs)
    SELECT factor_id, count(*) AS n, {s('avg(value)')} AS mean, {s('stddev_pop(value)', 5)} AS std,
      {s('avg(c * c * c) / pow(avg(c * c), 1.5)', 4)} AS skewness, {s('avg(c * c * c * c) / pow(avg(c * c), 2) - 3', 2)} AS kurtosis,
      1.0::DOUBLE AS coverage FROM d GROUP BY 1""",
)
def factor_descriptive(spark, folder):
    out = ev.descriptive(_both(spark, folder))
    return _shown(out, {"mean": 6, "std": 5, "skewness": 4, "kurtosis": 2, "coverage": 6}, "factor_id", "n")


@query(
    "factor_coverage",
    f"""WITH {PANEL} SELECT factor_id, symbol, count(value) AS n, {s('count(value)::DOUBLE / count(*)')} AS coverage
    FROM panel GROUP BY 1, 2""",
)
def factor_coverage(spark, folder):
    out = ev.descriptive(_panel(spark, folder), ("factor_id", "symbol"))
    return _shown(out, {"coverage": 6}, "factor_id", "symbol", "n")


_IC60 = f"({SERIES} ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
_ROLL = f"""rolled AS (SELECT *, CASE WHEN count(*) OVER {_IC60} = 60
    AND min(value) OVER {_IC60} < max(value) OVER {_IC60} AND min(fwd_ret) OVER {_IC60} < max(fwd_ret) OVER {_IC60}
    THEN corr(value, fwd_ret) OVER {_IC60} END AS ic FROM pairs)"""


@query(
    "factor_rolling_ic",
    f"WITH {PANEL}, {_ROLL} SELECT factor_id, symbol, date, {s('ic', 5)} AS ic FROM rolled",
)
def factor_rolling_ic(spark, folder):
    out = ev.rolling_ic(_both(spark, folder), spearman=False)
    return _shown(out, {"ic": 5}, "factor_id", "symbol", "date")


def _ranks(xs: str) -> str:
    return (
        f"list_transform({xs}, lambda v: len(list_filter({xs}, lambda u: u < v))"
        f" + (len(list_filter({xs}, lambda u: u = v)) + 1) / 2.0 - 30.5)"
    )


@query(
    "factor_rolling_rank_ic",
    f"""WITH {PANEL}, w AS (SELECT symbol, date, list(value) OVER {_IC60} AS a, list(fwd_ret) OVER {_IC60} AS b
      FROM pairs WHERE factor_id = 'momentum_20d'),
    r AS (SELECT symbol, date, CASE WHEN len(a) = 60 THEN {_ranks('a')} END AS ra,
      CASE WHEN len(a) = 60 THEN {_ranks('b')} END AS rb FROM w)
    SELECT symbol, date, {s('list_sum(list_transform(list_zip(ra, rb), lambda p: p[1] * p[2])) / nullif(sqrt(list_sum(list_transform(ra, lambda x: x * x)) * list_sum(list_transform(rb, lambda x: x * x))), 0)')} AS rank_ic FROM r""",
)
def factor_rolling_rank_ic(spark, folder):
    out = ev.rolling_ic(_both(spark, folder, ["momentum_20d"]))
    return _shown(out, {"rank_ic": 6}, "symbol", "date")


_ICS = f"""ics AS (SELECT factor_id, symbol, coalesce(avg(ic), 0) AS ic_mean, coalesce(stddev_pop(ic), 0) AS ic_std,
    coalesce(CASE WHEN stddev_pop(ic) > 0 THEN avg(ic) / stddev_pop(ic) END, 0) AS ic_ir,
    coalesce(avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END), 0) AS ic_win_rate FROM rolled GROUP BY 1, 2)"""


@query(
    "factor_ic_summary",
    f"""WITH {PANEL}, {_ROLL}, {_ICS} SELECT factor_id, symbol, {s('ic_mean', 5)} AS ic_mean, {s('ic_std', 5)} AS ic_std,
      {s('ic_ir', 4)} AS ic_ir, {s('ic_win_rate', 5)} AS ic_win_rate FROM ics""",
)
def factor_ic_summary(spark, folder):
    out = ev.ic_summary(ev.rolling_ic(_both(spark, folder), spearman=False))
    return _shown(out, {"ic_mean": 5, "ic_std": 5, "ic_ir": 4, "ic_win_rate": 5}, "factor_id", "symbol")


@query(
    "factor_regression",
    f"""WITH {PANEL}, g AS (SELECT factor_id, symbol, regr_slope(fwd_ret, value) AS b, regr_intercept(fwd_ret, value) AS a,
      corr(fwd_ret, value) AS r, count(*) AS n FROM pairs GROUP BY 1, 2),
    t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS v FROM g),
    terms AS (SELECT factor_id, symbol, exp(sum(ln(CASE WHEN v % 2 = 0 THEN (2 * j - 1)::DOUBLE / (2 * j) ELSE (2 * j)::DOUBLE / (2 * j + 1) END * v / (v + t * t)))
        OVER (PARTITION BY factor_id, symbol ORDER BY j)) AS term FROM t, unnest(range(1, (v - 2) // 2 + 1)) AS u(j)),
    series AS (SELECT factor_id, symbol, sum(term) AS more FROM terms GROUP BY 1, 2),
    tail AS (SELECT t.*, (CASE WHEN v > 1 THEN 1 ELSE 0 END + coalesce(more, 0)) * abs(t) / sqrt(v + t * t) AS body FROM t LEFT JOIN series USING (factor_id, symbol))
    SELECT factor_id, symbol, {s('b', 5)} AS factor_loading, {s('a', 5)} AS intercept, n, {s('r * r')} AS r_squared, {s('t', 4)} AS t_stat,
      {s('1 - CASE WHEN v % 2 = 0 THEN body ELSE 2 / pi() * (atan(abs(t) / sqrt(v)) + body * sqrt(v / (v + t * t))) END')} AS p_value FROM tail""",
)
def factor_regression(spark, folder):
    out = ev.regression(_both(spark, folder), ev.SERIES)
    return _shown(
        out, {"factor_loading": 5, "intercept": 5, "r_squared": 6, "t_stat": 4, "p_value": 6}, "factor_id", "symbol", "n"
    )


@query(
    "factor_regression_pooled",
    f"""WITH {PANEL} SELECT factor_id, {s('regr_slope(fwd_ret, value)', 5)} AS factor_loading, count(*) AS n,
      {s('corr(fwd_ret, value)', 5)} AS ic FROM pairs GROUP BY 1""",
)
def factor_regression_pooled(spark, folder):
    out = _both(spark, folder).groupBy("factor_id").agg(
        F.regr_slope("fwd_ret", "value").alias("factor_loading"),
        F.count(F.lit(1)).alias("n"),
        F.corr("value", "fwd_ret").alias("ic"),
    )
    return _shown(out, {"factor_loading": 5, "ic": 5}, "factor_id", "n")


_RV = f"(rank() OVER ({SERIES} ORDER BY value) + (count(*) OVER ({SERIES}, value) - 1) / 2.0)"
_RR = f"(rank() OVER ({SERIES} ORDER BY fwd_ret) + (count(*) OVER ({SERIES}, fwd_ret) - 1) / 2.0)"


@query(
    "factor_information_coefficient",
    f"""WITH {PANEL}, k AS (SELECT *, {_RV} AS rv, {_RR} AS rr FROM pairs),
    g AS (SELECT factor_id, symbol, corr(value, fwd_ret) AS ic, corr(rv, rr) AS rank_ic, count(*) AS n FROM k GROUP BY 1, 2)
    SELECT factor_id, symbol, n, {s('ic')} AS ic, {s('rank_ic')} AS rank_ic, {s('ic * sqrt((n - 2) / (1 - ic * ic))', 4)} AS t_stat,
      CASE WHEN abs(ic) > 0.1 THEN 'excellent' WHEN abs(ic) > 0.05 THEN 'good' WHEN abs(ic) > 0.02 THEN 'average' ELSE 'poor' END AS ic_quality
    FROM g""",
)
def factor_information_coefficient(spark, folder):
    out = ev.information_coefficient(_both(spark, folder))
    return _shown(out, {"ic": 6, "rank_ic": 6, "t_stat": 4}, "factor_id", "symbol", "n", "ic_quality")


@query(
    "factor_quantile_returns",
    f"""WITH {BUCKETS} SELECT factor_id, symbol, {', '.join(f"{s(f'q{i}', 5)} AS q{i}" for i in range(1, 6))},
      {s('q5 - q1', 5)} AS long_short_return,
      {s('greatest((q2>q1)::INT + (q3>q2)::INT + (q4>q3)::INT + (q5>q4)::INT, (q2<q1)::INT + (q3<q2)::INT + (q4<q3)::INT + (q5<q4)::INT) / 4.0')} AS monotonicity
    FROM qs""",
)
def factor_quantile_returns(spark, folder):
    out = ev.bucket_means(ev.bucketed(_both(spark, folder)))
    out = out.withColumns({"long_short_return": F.col("q5") - F.col("q1"), "monotonicity": ev.monotonicity()})
    return _shown(
        out, {**{f"q{i}": 5 for i in range(1, 6)}, "long_short_return": 5, "monotonicity": 6}, "factor_id", "symbol"
    )


_LS = f"""{BUCKETS}, ends AS (SELECT factor_id, symbol, pos, max(fwd_ret) FILTER (bucket = 4) - max(fwd_ret) FILTER (bucket = 0) AS ret
      FROM placed WHERE bucket IN (0, 4) GROUP BY 1, 2, 3),
    ls AS (SELECT * FROM ends WHERE ret IS NOT NULL),
    path AS (SELECT *, product(1 + ret) OVER ({SERIES} ORDER BY pos) AS g FROM ls),
    dd AS (SELECT *, (g - max(g) OVER ({SERIES} ORDER BY pos)) / nullif(max(g) OVER ({SERIES} ORDER BY pos), 0) AS drawdown FROM path),
    lss AS (SELECT factor_id, symbol, stddev_pop(ret) * sqrt(252) AS vol,
      CASE WHEN stddev_pop(ret) > 0 THEN (avg(ret) * 252 - 0.03) / (stddev_pop(ret) * sqrt(252)) ELSE 0 END AS sharpe,
      min(drawdown) AS mdd FROM dd GROUP BY 1, 2)"""


@query(
    "factor_long_short",
    f"""WITH {_LS} SELECT factor_id, symbol, {s('vol', 4)} AS long_short_volatility, {s('sharpe', 4)} AS long_short_sharpe,
      {s('ln(1 - mdd)', 5)} AS log_drawdown FROM lss""",
)
def factor_long_short(spark, folder):
    """A spread may lose more than all, so its drawdown is told as ln(1 - drawdown)."""
    out = ev.long_short(ev.bucketed(_both(spark, folder)))
    out = out.withColumn("log_drawdown", F.log(1 - F.col("max_drawdown")))
    return _shown(
        out, {"long_short_volatility": 4, "long_short_sharpe": 4, "log_drawdown": 5}, "factor_id", "symbol"
    )


_TURN = f"""lagged AS (SELECT *, lag(value) OVER ({SERIES} ORDER BY date) AS p FROM pairs),
    turned AS (SELECT factor_id, symbol, coalesce(avg(CASE WHEN p <> 0 THEN abs(value - p) / abs(p) END), 0) AS turnover,
      coalesce(corr(value, p), 0) AS auto_correlation FROM lagged GROUP BY 1, 2)"""


@query(
    "factor_turnover",
    f"""WITH {PANEL}, {_TURN} SELECT factor_id, symbol, {s('turnover', 3)} AS turnover,
      {s('auto_correlation', 5)} AS auto_correlation FROM turned""",
)
def factor_turnover(spark, folder):
    return _shown(ev.turnover(_both(spark, folder)), {"turnover": 3, "auto_correlation": 5}, "factor_id", "symbol")


@query(
    "factor_correlation_matrix",
    f"""WITH {PANEL} SELECT a.factor_id AS factor_a, b.factor_id AS factor_b, {s('corr(a.value, b.value)', 5)} AS correlation,
      count(*) AS n FROM panel a JOIN panel b ON a.symbol = b.symbol AND a.date = b.date AND a.factor_id <= b.factor_id
    WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2""",
)
def factor_correlation_matrix(spark, folder):
    out = ev.factor_correlation(_panel(spark, folder))
    return _shown(out, {"correlation": 5}, "factor_a", "factor_b", "n")


# The full evaluation of one factor per symbol, and what is derived from it.
_MOM = PANEL.replace("pairs AS (SELECT * FROM panel WHERE", "pairs AS (SELECT * FROM panel WHERE factor_id <> 'rsi_14d' AND")
_EVAL = f"""{_LS.replace(PANEL, _MOM)}, {_ROLL}, {_ICS}, {_TURN},
    w AS (SELECT factor_id, symbol, list(value) OVER {_IC60} AS a, list(fwd_ret) OVER {_IC60} AS b FROM pairs),
    r AS (SELECT factor_id, symbol, CASE WHEN len(a) = 60 THEN {_ranks('a')} END AS ra,
      CASE WHEN len(a) = 60 THEN {_ranks('b')} END AS rb FROM w),
    ri AS (SELECT factor_id, symbol, list_sum(list_transform(list_zip(ra, rb), lambda p: p[1] * p[2])) / nullif(sqrt(list_sum(list_transform(ra, lambda x: x * x)) * list_sum(list_transform(rb, lambda x: x * x))), 0) AS rank_ic FROM r),
    ris AS (SELECT factor_id, symbol, coalesce(CASE WHEN stddev_pop(rank_ic) > 0 THEN avg(rank_ic) / stddev_pop(rank_ic) END, 0) AS rank_ic_ir FROM ri GROUP BY 1, 2),
    base AS (SELECT factor_id, symbol, count(*) AS n FROM pairs GROUP BY 1, 2 HAVING count(*) >= 20),
    scored AS (SELECT *, 0.3 * least(abs(ic_ir) / 2, 1) + 0.2 * least(abs(rank_ic_ir) / 2, 1) + 0.2 * least(abs(sharpe) / 3, 1)
        + 0.1 * greatest((q2>q1)::INT + (q3>q2)::INT + (q4>q3)::INT + (q5>q4)::INT, (q2<q1)::INT + (q3<q2)::INT + (q4<q3)::INT + (q5<q4)::INT) / 4.0
        + 0.1 + 0.1 * abs(ic_win_rate - 0.5) * 2 AS quality_score
      FROM base JOIN ics USING (factor_id, symbol) JOIN ris USING (factor_id, symbol) JOIN lss USING (factor_id, symbol)
        JOIN qs USING (factor_id, symbol) JOIN turned USING (factor_id, symbol)),
    evaluated AS (SELECT *, CASE WHEN quality_score >= 0.8 THEN 'excellent' WHEN quality_score >= 0.6 THEN 'good'
        WHEN quality_score >= 0.4 THEN 'average' WHEN quality_score >= 0.2 THEN 'poor' ELSE 'invalid' END AS quality FROM scored)"""
_EVALUATED = ["momentum_20d", "mean_reversion_10d", "volatility_20d", "volume_ratio_20d"]


def _metrics(spark, folder):
    return ev.evaluate(_panel(spark, folder, _EVALUATED))


@query(
    "factor_evaluation",
    f"""WITH {_EVAL} SELECT factor_id, symbol, n, {s('ic_ir', 4)} AS ic_ir, {s('rank_ic_ir', 4)} AS rank_ic_ir,
      {s('sharpe', 4)} AS long_short_sharpe, {s('turnover', 3)} AS turnover, {s('quality_score', 5)} AS quality_score, quality
    FROM evaluated""",
)
def factor_evaluation(spark, folder):
    return _shown(
        _metrics(spark, folder),
        {"ic_ir": 4, "rank_ic_ir": 4, "long_short_sharpe": 4, "turnover": 3, "quality_score": 5},
        "factor_id",
        "symbol",
        "n",
        "quality",
    )


@query(
    "factor_evaluation_summary",
    f"""WITH {_EVAL} SELECT count(*) AS total, {', '.join(f"count(*) FILTER (quality = '{q}') AS {q}" for q in ('excellent', 'good', 'average', 'poor', 'invalid'))},
      {s('avg(ic_ir)', 5)} AS avg_ic_ir, {s('avg(rank_ic_ir)', 5)} AS avg_rank_ic_ir, {s('avg(sharpe)', 4)} AS avg_long_short_sharpe,
      {s('avg(turnover)', 3)} AS avg_turnover, 1.0::DOUBLE AS avg_coverage, {s('avg(quality_score)', 5)} AS avg_quality_score,
      arg_max(factor_id, row(quality_score, factor_id)) AS best_factor FROM evaluated""",
)
def factor_evaluation_summary(spark, folder):
    out = ev.evaluation_summary(_metrics(spark, folder))
    return out.select(
        *[c for c in out.columns if not c.startswith("avg_")],
        *[
            snap(F.col(c), {"avg_long_short_sharpe": 4, "avg_turnover": 3}.get(c, 5)).alias(c)
            for c in out.columns
            if c.startswith("avg_")
        ],
    )


@query(
    "factor_ranking",
    f"""WITH {_EVAL}, f AS (SELECT factor_id, avg(quality_score) AS quality_score FROM evaluated GROUP BY 1)
    SELECT factor_id, {s('quality_score', 5)} AS quality_score, CAST(row_number() OVER (ORDER BY quality_score DESC, factor_id) AS INT) AS rank FROM f""",
)
def factor_ranking(spark, folder):
    mean = _metrics(spark, folder).groupBy("factor_id").agg(F.avg("quality_score").alias("quality_score"))
    return _shown(fc.rank_factors(mean, "quality_score"), {"quality_score": 5}, "factor_id", "rank")


@query(
    "factor_alerts",
    f"""WITH {PANEL}, {_ROLL}, {_ICS}, {_TURN}, cov AS (SELECT factor_id, symbol, count(value)::DOUBLE / count(*) AS coverage FROM panel GROUP BY 1, 2),
    m AS (SELECT * FROM ics JOIN turned USING (factor_id, symbol) JOIN cov USING (factor_id, symbol))
    SELECT factor_id, symbol, 'low_ic' AS alert FROM m WHERE abs(ic_mean) < 0.01
    UNION ALL SELECT factor_id, symbol, 'low_ic_ir' FROM m WHERE abs(ic_ir) < 0.3
    UNION ALL SELECT factor_id, symbol, 'high_turnover' FROM m WHERE turnover > 1.5
    UNION ALL SELECT factor_id, symbol, 'low_coverage' FROM m WHERE coverage < 0.8""",
)
def factor_alerts(spark, folder):
    panel = cut_lineage(_panel(spark, folder))
    both = panel.where(F.col("value").isNotNull() & F.col("fwd_ret").isNotNull())
    metrics = (
        ev.ic_summary(ev.rolling_ic(both, spearman=False))
        .join(ev.turnover(both), list(ev.SERIES))
        .join(ev.descriptive(panel, ev.SERIES).select(*ev.SERIES, "coverage"), list(ev.SERIES))
    )
    return fc.alerts(metrics)


@query(
    "factor_deprecation",
    f"""WITH {PANEL}, g AS (SELECT factor_id, date_trunc('month', date)::DATE AS evaluated_on, corr(value, fwd_ret) AS ic,
        stddev_pop(value) AS sp, avg(value) AS av, count(value)::DOUBLE / count(*) AS coverage FROM panel GROUP BY 1, 2),
    e AS (SELECT factor_id, evaluated_on, ic, ic * 2 AS ic_ir, coalesce(abs({div('sp', 'av')}), 0) AS turnover, coverage FROM g WHERE ic IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY factor_id ORDER BY evaluated_on DESC) AS n FROM e),
    m AS (SELECT factor_id, avg(abs(ic)) AS ic, avg(abs(ic_ir)) AS ic_ir, avg(turnover) AS turnover, avg(coverage) AS coverage, count(*) AS evaluations
      FROM r WHERE n <= 10 GROUP BY 1)
    SELECT factor_id, {s('ic', 5)} AS ic, {s('turnover', 3)} AS turnover, evaluations,
      evaluations >= 10 AND (ic < 0.02 OR ic_ir < 0.3 OR turnover > 2 OR coverage < 0.8) AS deprecate FROM m""",
)
def factor_deprecation(spark, folder):
    """Monthly evaluations of each factor, then the rule over the last ten."""
    monthly = _panel(spark, folder).groupBy("factor_id", F.trunc("date", "month").alias("evaluated_on")).agg(
        F.corr("value", "fwd_ret").alias("ic"),
        F.coalesce(F.abs(F.try_divide(F.stddev_pop("value"), F.avg("value"))), F.lit(0.0)).alias("turnover"),
        (F.count("value") / F.count(F.lit(1))).alias("coverage"),
    )
    monthly = monthly.where(F.col("ic").isNotNull() & ~F.isnan("ic")).withColumn("ic_ir", F.col("ic") * 2)
    out = fc.deprecation_candidates(monthly)
    return _shown(out, {"ic": 5, "turnover": 3}, "factor_id", "evaluations", "deprecate")


@query(
    "factor_catalogue",
    f"""WITH {PANEL}, m AS (SELECT factor_id, corr(value, fwd_ret) AS ic, avg(fwd_ret) / stddev_samp(fwd_ret) AS sharpe,
      CASE WHEN factor_id LIKE 'momentum%' THEN 'momentum' WHEN factor_id LIKE 'mean%' THEN 'mean_reversion' WHEN factor_id LIKE 'volatility%' THEN 'risk' ELSE 'technical' END AS category,
      CASE WHEN abs(corr(value, fwd_ret)) > 0.05 THEN 'active' ELSE 'testing' END AS status FROM pairs GROUP BY 1)
    SELECT category, status, count(*) AS factors, {s('avg(ic)', 5)} AS avg_ic, {s('avg(sharpe)', 5)} AS avg_sharpe FROM m
    GROUP BY GROUPING SETS ((category), (status), ())""",
)
def factor_catalogue(spark, folder):
    m = _catalogue(spark, folder)
    return _shown(fc.catalogue_statistics(m), {"avg_ic": 5, "avg_sharpe": 5}, "category", "status", "factors")


def _catalogue(spark, folder):
    f = F.col("factor_id")
    m = _both(spark, folder).groupBy("factor_id").agg(
        F.corr("value", "fwd_ret").alias("ic"),
        (F.avg("fwd_ret") / F.stddev_samp("fwd_ret")).alias("sharpe"),
    )
    return m.withColumns(
        {
            "category": F.when(f.startswith("momentum"), "momentum")
            .when(f.startswith("mean"), "mean_reversion")
            .when(f.startswith("volatility"), "risk")
            .otherwise("technical"),
            "status": F.when(F.abs("ic") > 0.05, "active").otherwise("testing"),
        }
    )


@query(
    "factor_selection",
    f"""WITH {PANEL} SELECT factor_id, {s('corr(value, fwd_ret)', 5)} AS ic FROM pairs WHERE factor_id NOT LIKE 'm%' AND factor_id NOT LIKE 'volatility%'
    GROUP BY 1 HAVING abs(corr(value, fwd_ret)) > 0.05""",
)
def factor_selection(spark, folder):
    out = fc.select_factors(_catalogue(spark, folder), status="active", category="technical")
    return _shown(out, {"ic": 5}, "factor_id")


# --- back-test and portfolio -------------------------------------------------------

_SIG = f"""{FACTORS}, picked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY momentum_20d DESC, symbol) AS rank
      FROM fac WHERE momentum_20d IS NOT NULL)"""


def _signals(spark, folder):
    # signals and returns share the bars, which are derived and written once
    wide = cut_lineage(_wide(spark, folder).select("date", "symbol", "momentum_20d", "fwd_ret"))
    return (
        wide.where(F.col("momentum_20d").isNotNull()).select("date", "symbol", F.col("momentum_20d").alias("score")),
        wide.select("date", "symbol", F.col("fwd_ret").alias("ret")),
    )


@query(
    "signal_top_k",
    f"WITH {_SIG} SELECT date, symbol, {s('momentum_20d', 5)} AS score, CAST(rank AS INT) AS rank FROM picked WHERE rank <= 5",
)
def signal_top_k(spark, folder):
    signals, _ = _signals(spark, folder)
    return _shown(pf.top_k(signals, 5), {"score": 5}, "date", "symbol", "rank")


@query(
    "backtest_daily",
    f"WITH {_SIG} SELECT date, {s('avg(coalesce(fwd_ret, 0))', 5)} AS ret FROM picked WHERE rank <= 5 GROUP BY 1",
)
def backtest_daily(spark, folder):
    return _shown(pf.backtest_returns(*_signals(spark, folder), 5), {"ret": 5}, "date")


_SPAN = div("high - low", "close")


@query(
    "factor_custom",
    f"""WITH {BARS}, f AS (SELECT *, {_SPAN} AS day_span FROM bars)
    SELECT symbol, date, {s('day_span')} AS day_span, {s(f'avg(day_span) OVER ({WS} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)')} AS span_mean FROM f""",
)
def factor_custom(spark, folder):
    """A user's factors, one built on the other; a deprecated one is left out."""
    book = fc.FactorRegistry()
    book.register(fc.Factor("span_mean", ("day_span",), lambda w: F.avg("day_span").over(w.rowsBetween(-4, 0))))
    book.register(fc.Factor("day_span", ("high", "low", "close"), lambda w: ratio(F.col("high") - F.col("low"), F.col("close"))))
    book.register(fc.Factor("old", ("close",), lambda w: F.col("close"), status="deprecated"))
    return _shown(book.calculate(daily_bars(spark, folder)), {"day_span": 6, "span_mean": 6}, "symbol", "date")


@query(
    "backtest_summary",
    f"""WITH {_SIG}, d AS (SELECT date, avg(coalesce(fwd_ret, 0)) AS ret FROM picked WHERE rank <= 5 GROUP BY 1)
    SELECT {s('avg(ret)', 5)} AS mean, {s('stddev_pop(ret)', 5)} AS std, {s('avg(ret) * 252', 3)} AS annualized_return,
      {s('avg(ret) * 252 / (stddev_pop(ret) * sqrt(252))', 4)} AS information_ratio, 0.0::DOUBLE AS max_drawdown FROM d""",
)
def backtest_summary(spark, folder):
    out = pf.backtest_summary(pf.backtest_returns(*_signals(spark, folder), 5))
    return _shown(
        out, {"mean": 5, "std": 5, "annualized_return": 3, "information_ratio": 4}, "max_drawdown"
    )


_RETS = f"""{_SIG}, port AS (SELECT CAST(rank AS INT) AS portfolio_id, date, coalesce(fwd_ret, 0) AS ret FROM picked WHERE rank <= 5),
    bench AS (SELECT date, avg(coalesce(fwd_ret, 0)) AS bench FROM fac GROUP BY 1),
    held AS (SELECT * FROM port JOIN bench USING (date)),
    grown AS (SELECT *, product(1 + ret) OVER (PARTITION BY portfolio_id ORDER BY date) AS g FROM held),
    dd AS (SELECT *, (g - max(g) OVER (PARTITION BY portfolio_id ORDER BY date)) / nullif(max(g) OVER (PARTITION BY portfolio_id ORDER BY date), 0) AS drawdown FROM grown)"""


@query(
    "portfolio_performance",
    f"""WITH {_RETS}, p AS (SELECT portfolio_id, product(1 + ret) - 1 AS total_return, stddev_pop(ret) * sqrt(252) AS volatility,
      avg(ret) / stddev_pop(ret) * sqrt(252) AS sharpe, min(drawdown) AS mdd, avg((ret > 0)::INT) AS hit,
      stddev_pop(ret - bench) * sqrt(252) AS te, avg(ret - bench) / stddev_pop(ret - bench) * sqrt(252) AS ir FROM dd GROUP BY 1)
    SELECT portfolio_id, {s('sign(total_return) * ln(1 + abs(total_return))', 4)} AS log_total_return, {s('volatility', 5)} AS volatility, {s('sharpe', 4)} AS sharpe_ratio,
      {s('mdd')} AS max_drawdown, {s('hit', 5)} AS hit_rate, {s('te', 5)} AS tracking_error, {s('ir', 4)} AS information_ratio,
      {s('CASE WHEN mdd < 0 THEN sign(total_return) * ln(1 + abs(total_return / mdd)) ELSE 0 END', 2)} AS log_calmar_ratio FROM p""",
)
def portfolio_performance(spark, folder):
    signals, forward = _signals(spark, folder)
    held = pf.top_k(signals, 5).join(forward, ["date", "symbol"], "left")
    held = held.select(F.col("rank").alias("portfolio_id"), "date", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    bench = forward.groupBy("date").agg(F.avg(F.coalesce("ret", F.lit(0.0))).alias("bench"))
    out = pf.performance(held.join(bench, "date"), benchmark="bench")
    # noisy prices compound beyond what fixed decimals hold
    told = {f"log_{c}": F.signum(F.col(c)) * F.log1p(F.abs(F.col(c))) for c in ("total_return", "calmar_ratio")}
    return _shown(
        out.withColumns(told),
        {
            "log_total_return": 4, "volatility": 5, "sharpe_ratio": 4, "max_drawdown": 6, "hit_rate": 5,
            "tracking_error": 5, "information_ratio": 4, "log_calmar_ratio": 2,
        },
        "portfolio_id",
    )


_R = f"r AS (SELECT symbol, date, close, {div('close', lag('close'))} - 1 AS ret FROM bars)"


def _returns(spark, folder):
    from tidemark.columns import change, ordered

    w = ordered(["symbol"], ["date"])
    return daily_bars(spark, folder).select("symbol", "date", "close", change(F.col("close"), w).alias("ret"))


@query(
    "portfolio_drawdown",
    f"""WITH {BARS} SELECT symbol, date, {s(f'(close - max(close) OVER ({WS})) / max(close) OVER ({WS})')} AS drawdown FROM bars""",
)
def portfolio_drawdown(spark, folder):
    return _shown(pf.price_drawdown(daily_bars(spark, folder)), {"drawdown": 6}, "symbol", "date")


@query(
    "portfolio_drawdown_report",
    f"""WITH {BARS}, i AS (SELECT symbol, row_number() OVER ({WS}) - 2 AS i, close / first_value(close) OVER ({WS}) AS g FROM bars),
    k AS (SELECT *, max(g) OVER (PARTITION BY symbol ORDER BY i) AS peak FROM i WHERE i >= 0),
    d AS (SELECT *, (g - peak) / peak AS dd, min(i) OVER (PARTITION BY symbol, peak) AS since FROM k)
    SELECT symbol, {s('min(dd)')} AS max_drawdown, CAST(arg_min(since, row(dd, i)) AS INT) AS peak_idx,
      CAST(arg_min(i, row(dd, i)) AS INT) AS trough_idx, {s('arg_max(dd, i)')} AS current_drawdown FROM d GROUP BY 1""",
)
def portfolio_drawdown_report(spark, folder):
    out = pf.drawdown_report(daily_bars(spark, folder))
    return _shown(out, {"max_drawdown": 6, "current_drawdown": 6}, "symbol", "peak_idx", "trough_idx")


@query(
    "portfolio_return_statistics",
    f"""WITH {BARS}, {_R}, q AS (SELECT symbol, date, ret FROM r WHERE ret IS NOT NULL),
    g AS (SELECT *, product(1 + ret) OVER ({WS}) AS g FROM q),
    d AS (SELECT *, (g - max(g) OVER ({WS})) / nullif(max(g) OVER ({WS}), 0) AS dd FROM g)
    SELECT symbol, {s('avg((ret > 0)::INT)', 5)} AS win_rate, {s('avg(ret) / stddev_samp(ret) * sqrt(252)', 4)} AS sharpe_ratio,
      {s('min(dd)')} AS max_drawdown, {s('avg(ret) / (stddev_samp(ret) / sqrt(count(ret)))', 4)} AS t_stat,
      {s('CASE WHEN min(dd) <> 0 THEN avg(ret) * 252 / abs(min(dd)) ELSE 0 END', 2)} AS calmar_ratio FROM d GROUP BY 1""",
)
def portfolio_return_statistics(spark, folder):
    r = _returns(spark, folder).where(F.col("ret").isNotNull())
    return _shown(
        pf.return_statistics(r),
        {"win_rate": 5, "sharpe_ratio": 4, "max_drawdown": 6, "t_stat": 4, "calmar_ratio": 2},
        "symbol",
    )


def _var_sql(level: str) -> str:
    return f"""WITH {BARS}, {_R}, q AS (SELECT * FROM r WHERE ret IS NOT NULL),
    v AS (SELECT symbol, {level} AS v, min(ret) AS lo, max(ret) AS hi FROM q GROUP BY 1)
    SELECT symbol, {s('any_value(v)')} AS var, {s('any_value(lo)')} AS worst_return, {s('any_value(hi)', 5)} AS best_return,
      {s('coalesce(avg(ret) FILTER (ret <= v), any_value(v))')} AS cvar FROM q JOIN v USING (symbol) GROUP BY symbol"""


@query("risk_value_at_risk", _var_sql("quantile_cont(ret, 0.05)"))
def risk_value_at_risk(spark, folder):
    r = _returns(spark, folder).where(F.col("ret").isNotNull())
    return _shown(
        pf.value_at_risk(r, 0.95), {"var": 6, "cvar": 6, "worst_return": 6, "best_return": 5}, "symbol"
    )


@query("risk_value_at_risk_parametric", _var_sql("avg(ret) - 1.645 * stddev_pop(ret)"))
def risk_value_at_risk_parametric(spark, folder):
    r = _returns(spark, folder).where(F.col("ret").isNotNull())
    return _shown(
        pf.value_at_risk(r, 0.95, "parametric"),
        {"var": 6, "cvar": 6, "worst_return": 6, "best_return": 5},
        "symbol",
    )


@query(
    "factor_covariance",
    f"""WITH {PANEL}, f AS (SELECT factor_id, date, avg(value) AS ret FROM panel WHERE value IS NOT NULL GROUP BY 1, 2),
    d AS (SELECT DISTINCT date FROM f ORDER BY date DESC LIMIT 252), k AS (SELECT f.* FROM f JOIN d USING (date))
    SELECT a.factor_id AS "left", b.factor_id AS "right", {s('covar_samp(a.ret, b.ret)', 5)} AS covariance, count(*) AS n
    FROM k a JOIN k b USING (date) GROUP BY 1, 2 HAVING count(*) >= 10""",
)
def factor_covariance(spark, folder):
    means = _panel(spark, folder).where(F.col("value").isNotNull()).groupBy("factor_id", "date").agg(
        F.avg("value").alias("ret")
    )
    return _shown(pf.covariance(means, "factor_id"), {"covariance": 5}, "left", "right", "n")


@query(
    "correlation_close_volume",
    f"""WITH {BARS}, k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY close) + (count(*) OVER (PARTITION BY symbol, close) - 1) / 2.0 AS a,
      rank() OVER (PARTITION BY symbol ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, volume) - 1) / 2.0 AS b FROM bars),
    g AS (SELECT symbol, corr(a, b) AS r, count(*) AS n FROM k GROUP BY 1)
    SELECT symbol, n, {s('r')} AS correlation, {s('r * sqrt((n - 2) / (1 - r * r))', 4)} AS t_stat,
      abs(r * sqrt((n - 2) / (1 - r * r))) > 1.96 AS significant FROM g""",
)
def correlation_close_volume(spark, folder):
    out = pf.correlation(daily_bars(spark, folder), "close", "volume", ["symbol"], "spearman")
    return _shown(out, {"correlation": 6, "t_stat": 4}, "symbol", "n", "significant")
