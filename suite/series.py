"""Queries and their SQL: time series and tests of group differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from headcount.operators import hypothesis_tests as tests
from headcount.operators import timeseries
from suite.analysis import rounded
from suite.views import table, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function

    return register


# --- resampling -------------------------------------------------------------


def _resample_sql(source: str, date: str, value: str, unit: str) -> str:
    return f"""SELECT CAST(date_trunc('{unit}', {date}) AS DATE) AS period, avg({value}) AS value
               FROM {source} WHERE {date} IS NOT NULL GROUP BY 1"""


_INPUTS = {
    "daily": ("events", "ts", "value"),
    "weekly": ("events", "ts", "value"),
    "monthly": ("orders", "o_orderdate", "o_totalprice"),
    "quarterly": ("orders", "o_orderdate", "o_totalprice"),
    "yearly": ("orders", "o_orderdate", "o_totalprice"),
}


def resampled(spark, d, grain):
    source, date, value = _INPUTS[grain]
    return timeseries.resample_mean(table(spark, d, source), date, value, grain)


def series_sql(grain: str) -> str:
    source, date, value = _INPUTS[grain]
    return _resample_sql(source, date, value, timeseries.UNITS[grain])


for _grain in _INPUTS:
    query(
        f"resample_{_grain}",
        f"SELECT period, round(value, 6) AS value FROM ({series_sql(_grain)})",
    )(lambda spark, d, g=_grain: rounded(resampled(spark, d, g)))


# --- trend ------------------------------------------------------------------


def _trend_sql(series: str, order: str, value: str, keep: str) -> str:
    return f"""WITH s AS ({series}), p AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS pos FROM s),
      l AS (SELECT regr_slope({value}, pos) AS m, regr_intercept({value}, pos) AS c FROM p)
      SELECT {keep}, pos, round(c + m * pos, 4) AS fitted FROM p, l"""


@query("linear_trend", _trend_sql(series_sql("monthly"), "period", "value", "period"))
def _(spark, d):
    found = timeseries.linear_trend(resampled(spark, d, "monthly"), ["period"], "value", few_rows=True)
    return found.select("period", "pos", F.round("fitted", 4).alias("fitted"))


@query(
    "linear_trend_rows",
    _trend_sql("SELECT event_id, ts, value FROM events", "ts, event_id", "value", "event_id"),
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "value")
    found = timeseries.linear_trend(rows, ["ts", "event_id"], "value")
    return found.select("event_id", "pos", F.round("fitted", 4).alias("fitted"))


@query(
    "trend_summary",
    f"""WITH s AS ({series_sql("monthly")}),
        p AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS pos FROM s)
        SELECT min(period) AS "start", max(period) AS "end", round(avg(value), 4) AS mean,
          round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max,
          CASE WHEN regr_slope(value, pos) > 0 THEN 'Increasing' ELSE 'Decreasing' END AS trend FROM p""",
)
def _(spark, d):
    found = timeseries.trend_summary(resampled(spark, d, "monthly"), ["period"], "value", few_rows=True)
    return rounded(found, 4)


# --- smoothing --------------------------------------------------------------


def _moving_sql(series: str, order: str, value: str, rows: int, keep: str) -> str:
    return f"""WITH s AS ({series}) SELECT {keep}, round(avg({value}) OVER (ORDER BY {order}
      ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW), 6) AS smoothed FROM s"""


@query("moving_average", _moving_sql(series_sql("daily"), "period", "value", 7, "period"))
def _(spark, d):
    found = timeseries.moving_average(resampled(spark, d, "daily"), ["period"], "value", 7, few_rows=True)
    return found.select("period", F.round("smoothed", 6).alias("smoothed"))


@query(
    "moving_average_rows",
    _moving_sql("SELECT event_id, ts, value FROM events", "ts, event_id", "value", 30, "event_id"),
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "value")
    found = timeseries.moving_average(rows, ["ts", "event_id"], "value", 30)
    return found.select("event_id", F.round("smoothed", 6).alias("smoothed"))


# --- seasonal decomposition -------------------------------------------------


def _season_sql(series: str, order: str, keep: str, period: int) -> str:
    half = period // 2
    edge = (
        f"(lag(value, {half}) OVER o + lead(value, {half}) OVER o) / 2" if period % 2 == 0 else "0"
    )
    return f"""WITH s AS ({series}), p AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS pos FROM s),
      m AS (SELECT *, CASE WHEN pos >= {half} AND pos < (SELECT count(*) FROM s) - {half} THEN
              (sum(value) OVER (ORDER BY pos ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) - {edge})
              / {period}::DOUBLE END AS trend FROM p WINDOW o AS (ORDER BY pos)),
      a AS (SELECT pos % {period} AS k, avg(value - trend) AS mean FROM m GROUP BY 1),
      c AS (SELECT k, mean - (SELECT avg(mean) FROM a) AS seasonal FROM a)
      SELECT {keep}, pos, round(value, 6) AS observed, round(trend, 6) AS trend,
        round(seasonal, 6) AS seasonal, round(value - trend - seasonal, 6) AS residual
      FROM m JOIN c ON c.k = m.pos % {period}"""


for _grain, _period in (("monthly", 12), ("quarterly", 4), ("daily", 7)):
    query(
        f"seasonal_decompose_{_grain}",
        _season_sql(series_sql(_grain), "period", "period", _period),
    )(
        lambda spark, d, g=_grain: rounded(
            timeseries.seasonal_decompose(resampled(spark, d, g), ["period"], "value", g, few_rows=True)
        )
    )


@query(
    "seasonal_decompose",
    _season_sql("SELECT event_id, ts, value FROM events", "ts, event_id", "event_id, ts", 7),
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "value")
    return rounded(timeseries.seasonal_decompose(rows, ["ts", "event_id"], "value"))


# --- tests of group differences ---------------------------------------------

_LINE = ("l_quantity", "l_linestatus")
_PRICE = ("l_extendedprice", "l_returnflag")


@query(
    "t_test",
    """WITH g AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v
                  FROM lineitem GROUP BY 1),
       a AS (SELECT * FROM g ORDER BY g LIMIT 1), b AS (SELECT * FROM g ORDER BY g DESC LIMIT 1)
       SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)
                    * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)), 6) AS statistic, a.n + b.n - 2 AS df FROM a, b""",
)
def _(spark, d):
    return rounded(tests.t_test(table(spark, d, "lineitem"), *_LINE))


def _simpson(density: str, upto: str, source: str) -> str:
    """The integral of a density of x from 0 to `upto`, in 4,000 even steps."""
    weight = "CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    inner = f"SELECT i, {upto} * i / 4000::DOUBLE AS x, {upto} / 12000::DOUBLE AS h, * FROM {source}, range(0, 4001) r(i)"
    return f"(SELECT sum({weight} * ({density}) * h) FROM ({inner}))"


def _t_tail(t: str, freedom: str, source: str) -> str:
    density = (
        f"exp(lgamma(({freedom} + 1) / 2) - lgamma({freedom} / 2)) / sqrt({freedom} * pi())"
        f" * pow(1 + x * x / {freedom}, -({freedom} + 1) / 2)"
    )
    return f"1 - 2 * {_simpson(density, t, source)}"


def _with_p(found, digits: int = 6):
    """A test with its statistic rounded, and its p-value to four places."""
    return rounded(found.withColumn("p_value", F.round("p_value", 4)), digits)


@query(
    "t_test_p",
    f"""WITH b AS (SELECT statistic, df, abs(statistic) AS t, df::DOUBLE AS v FROM ({ORACLES["t_test"]})),
       p AS (SELECT statistic, df, round({_t_tail("t", "v", "b")}, 4) AS p_value FROM b)
       SELECT *, p_value < 0.05 AS reject FROM p""",
)
def _(spark, d):
    return _with_p(tests.t_test_p(table(spark, d, "lineitem"), *_LINE))


def _rank_sql(value: str, group: str) -> str:
    return f"""v AS (SELECT {value} AS v, {group} AS g, count(*) AS n FROM lineitem GROUP BY 1, 2),
      t AS (SELECT v, sum(n) AS t FROM v GROUP BY 1),
      r AS (SELECT v, t, coalesce(sum(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + (t + 1) / 2::DOUBLE AS rank FROM t),
      s AS (SELECT g, sum(n)::DOUBLE AS n, sum(n * rank) AS ranks FROM v JOIN r USING (v) GROUP BY 1),
      z AS (SELECT sum(t::DOUBLE * t * t - t) AS ties FROM t)"""


@query(
    "mann_whitney",
    f"""WITH {_rank_sql(*_LINE)}, a AS (SELECT * FROM s ORDER BY g LIMIT 1),
       b AS (SELECT * FROM s ORDER BY g DESC LIMIT 1),
       u AS (SELECT a.n AS n1, b.n AS n2, a.ranks - a.n * (a.n + 1) / 2 AS u1 FROM a, b)
       SELECT u1 AS statistic, round((greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5::DOUBLE)
         / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z,
         CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, ties FROM u, z""",
)
def _(spark, d):
    return rounded(tests.mann_whitney(table(spark, d, "lineitem"), *_LINE))


@query(
    "mann_whitney_p",
    f"""WITH b AS ({ORACLES["mann_whitney"]}),
       p AS (SELECT *, round(least(1, 1 - 2 * {_simpson("exp(-x * x / 2) / sqrt(2 * pi())", "z", "b")}), 4)
             AS p_value FROM b)
       SELECT *, p_value < 0.05 AS reject FROM p""",
)
def _(spark, d):
    return _with_p(tests.mann_whitney_p(table(spark, d, "lineitem"), *_LINE))


@query(
    "kruskal_wallis",
    f"""WITH {_rank_sql(*_PRICE)}, k AS (SELECT count(*) AS k, sum(n) AS n, sum(ranks * ranks / n) AS q FROM s)
       SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) AS statistic,
         k - 1 AS df FROM k, z""",
)
def _(spark, d):
    return rounded(tests.kruskal_wallis(table(spark, d, "lineitem"), *_PRICE), 4)


# With two degrees of freedom the chi-square tail is an exponential, and that of F a power.
@query(
    "kruskal_wallis_p",
    f"""WITH p AS (SELECT statistic, df, round(exp(-statistic / 2), 4) AS p_value FROM ({ORACLES["kruskal_wallis"]}))
        SELECT *, p_value < 0.05 AS reject FROM p""",
)
def _(spark, d):
    return _with_p(tests.kruskal_wallis_p(table(spark, d, "lineitem"), *_PRICE), 4)


@query(
    "one_way_anova",
    """WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v
                  FROM lineitem GROUP BY 1), t AS (SELECT avg(l_extendedprice) AS grand FROM lineitem)
       SELECT round((sum(n * (m - grand) * (m - grand)) / (count(*) - 1)) / (sum((n - 1) * v)
                    / (sum(n) - count(*))), 4) AS statistic, count(*) - 1 AS df_between,
         CAST(sum(n) - count(*) AS BIGINT) AS df_within FROM g, t""",
)
def _(spark, d):
    return rounded(tests.one_way_anova(table(spark, d, "lineitem"), *_PRICE), 4)


_F_TWO = "pow(1 + 2 * statistic / {v}, -{v} / 2)"


@query(
    "one_way_anova_p",
    f"""WITH p AS (SELECT *, round({_F_TWO.format(v="df_within::DOUBLE")}, 4) AS p_value
                   FROM ({ORACLES["one_way_anova"]}))
        SELECT *, p_value < 0.05 AS reject FROM p""",
)
def _(spark, d):
    return _with_p(tests.one_way_anova_p(table(spark, d, "lineitem"), *_PRICE), 4)


# The second factor has two levels, so the additive fit has a closed form.
@query(
    "two_way_anova",
    """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n, avg(l_quantity) AS m,
                    var_pop(l_quantity) * count(*) AS w FROM lineitem GROUP BY 1, 2),
       tot AS (SELECT sum(n) AS n, sum(w) AS w, count(*) AS cells, count(DISTINCT a) AS ka FROM c),
       am AS (SELECT a, sum(n) AS n, sum(n * m) / sum(n) AS m FROM c GROUP BY 1),
       bm AS (SELECT b, sum(n) AS n, sum(n * m) / sum(n) AS m FROM c GROUP BY 1),
       cell_a AS (SELECT sum(c.n * (c.m - am.m) * (c.m - am.m)) AS ss FROM c JOIN am USING (a)),
       cell_b AS (SELECT sum(c.n * (c.m - bm.m) * (c.m - bm.m)) AS ss FROM c JOIN bm USING (b)),
       pair AS (SELECT x.a, x.n * y.n / (x.n + y.n) AS w, x.m - y.m AS d
                FROM c x JOIN c y ON x.a = y.a AND x.b = 'F' AND y.b = 'O'),
       eff AS (SELECT sum(w * d) * sum(w * d) / sum(w) AS ss_b FROM pair),
       ss AS (SELECT cell_b.ss - (cell_a.ss - ss_b) AS ss_a, ss_b, cell_a.ss - ss_b AS ss_ab FROM cell_a, cell_b, eff),
       r AS (SELECT tot.w AS w, CAST(tot.n - cells AS BIGINT) AS df, ka FROM tot)
       SELECT 'a' AS term, round(ss_a, 4) AS sum_sq, ka - 1 AS df,
         round(ss_a / (ka - 1) / (w / df), 6) AS statistic FROM ss, r
       UNION ALL SELECT 'b', round(ss_b, 4), 1, round(ss_b / (w / df), 6) FROM ss, r
       UNION ALL SELECT 'a:b', round(ss_ab, 4), ka - 1, round(ss_ab / (ka - 1) / (w / df), 6) FROM ss, r
       UNION ALL SELECT 'Residual', round(w, 4), df, NULL FROM r""",
)
def _(spark, d):
    found = tests.two_way_anova(table(spark, d, "lineitem"), "l_quantity", "l_returnflag", "l_linestatus")
    return found.select("term", F.round("sum_sq", 4).alias("sum_sq"), "df", F.round("statistic", 6).alias("statistic"))


@query(
    "two_way_anova_p",
    f"""WITH b AS ({ORACLES["two_way_anova"]}), v AS (SELECT df::DOUBLE AS v FROM b WHERE term = 'Residual'),
       one AS (SELECT sqrt(statistic) AS t, v FROM b, v WHERE term = 'b'),
       p AS (SELECT b.*, round(CASE WHEN b.df = 2 THEN {_F_TWO.format(v="v.v")} WHEN term = 'b'
             THEN {_t_tail("t", "v", "one")} END, 4) AS p_value FROM b, v)
       SELECT *, p_value < 0.05 AS reject FROM p""",
)
def _(spark, d):
    found = tests.two_way_anova_p(table(spark, d, "lineitem"), "l_quantity", "l_returnflag", "l_linestatus")
    return found.select(
        "term",
        F.round("sum_sq", 4).alias("sum_sq"),
        "df",
        F.round("statistic", 6).alias("statistic"),
        F.round("p_value", 4).alias("p_value"),
        "reject",
    )
