"""Queries that run a whole view from the raw table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from headcount.functions.dates import MONTHS
from headcount.operators.recruiting import recruitment_funnel
from headcount.plans import attrition, diversity, exploration, prediction, recruitment
from suite.analysis import _FLAGS, NAMES, _dimension_sql, _funnel_sql, _histogram_sql, rounded
from suite.series import series_sql
from suite.tables import LEAVERS, employees, years_sql
from suite.views import AS_OF, candidates, table, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function

    return register


@query(
    "attrition_flow",
    f"""WITH {LEAVERS}, f AS (SELECT * FROM leavers WHERE Department IN ('1-URGENT', '5-LOW')
          AND Exit_Year BETWEEN 1997 AND 2001)
        {_dimension_sql(["Exit_Year", "Exit_Month", "Exit_Quarter", "Department"], "f")}""",
)
def _(spark, d):
    cleaned = attrition.prepare(employees(spark, d), AS_OF)
    return attrition.breakdown(
        cleaned, {"Department": ["1-URGENT", "5-LOW"], "Gender": ["All"]}, custom=(1997, 2001, list(MONTHS))
    )


@query(
    "diversity_flow",
    _histogram_sql(
        f"""(SELECT {years_sql(f"DATE '{AS_OF}' - DOB")} AS Age FROM hr_employees
             WHERE Department IS NOT NULL)""",
        "Age",
        20,
    ),
)
def _(spark, d):
    # Exit date and reason are mostly empty and are dropped by the policy.
    return rounded(diversity.summary(diversity.prepare(employees(spark, d), AS_OF))["age"])


@query("recruitment_flow", _funnel_sql().replace("FROM hr_candidates)", "FROM hr_candidates WHERE Interviewed IS NOT NULL)", 1))
def _(spark, d):
    ready = recruitment.prepare(candidates(spark, d), AS_OF, "RequisitionDate")
    return recruitment_funnel(ready, NAMES)


@query(
    "recruitment_analysis",
    f"""WITH {_FLAGS} SELECT Country, DEI, round(avg(CAST(f4 AS INT)), 6) AS "Join Ratio" FROM flags
        WHERE Interviewed IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, d):
    ready = recruitment.prepare(candidates(spark, d), AS_OF, "RequisitionDate")
    return rounded(recruitment.analyse(ready, "Join Ratio", "Country", "DEI", NAMES))


@query(
    "exploration_flow",
    f"""WITH s AS ({series_sql("monthly")}),
        m AS (SELECT period, avg(value) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS value FROM s),
        p AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS pos FROM m),
        l AS (SELECT regr_slope(value, pos) AS a, regr_intercept(value, pos) AS c FROM p)
        SELECT period, pos, round(value, 6) AS value, round(c + a * pos, 6) AS fitted FROM p, l""",
)
def _(spark, d):
    found = exploration.time_series(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "monthly", 3)
    return rounded(found.trend)


@query(
    "prediction_flow",
    f"""WITH c AS (SELECT EmployeeID, CASE WHEN Turnover = 'Yes' THEN 1 ELSE 0 END::DOUBLE AS label,
         {years_sql(f"coalesce(DOE, DATE '{AS_OF}') - DOJ")} AS Tenure,
         {years_sql(f"DATE '{AS_OF}' - DOB")} AS Age FROM hr_employees WHERE Department IS NOT NULL),
       r AS (SELECT min(Tenure) AS t0, max(Tenure) AS t1, min(Age) AS a0, max(Age) AS a1, count(*) AS n FROM c),
       s AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || EmployeeID::VARCHAR), EmployeeID)
             <= ceil(n * 20 / 100::DOUBLE) AS is_test FROM c, r)
       SELECT EmployeeID, label, round((Tenure - t0) / (t1 - t0), 6) AS Tenure,
         round((Age - a0) / (a1 - a0), 6) AS Age FROM s WHERE is_test""",
)
def _(spark, d):
    ready = prediction.cleaned(employees(spark, d), AS_OF)
    made = prediction.prepare(ready, "Turnover", "EmployeeID", [], ["Tenure", "Age"])
    return rounded(made.test.select("EmployeeID", "label", F.col("Tenure"), F.col("Age")))
