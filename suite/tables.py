"""Queries and their SQL: sources, columns, filters, data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from headcount.functions import dates
from headcount.functions.text import contains_ci, encode_target
from headcount.operators import columns, filters, quality
from headcount.session import shared_path
from headcount.sources import tables
from suite.views import AS_OF, candidates, employees, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function

    return register


def leavers(spark, d):
    return dates.exit_calendar(filters.exited_only(employees(spark, d)))


# The exit calendar in SQL, for the statements below.
LEAVERS = """leavers AS (
  SELECT *, CAST(year(DOE) AS INT) AS Exit_Year, CAST(month(DOE) AS INT) AS Exit_Month_Num,
         monthname(DOE) AS Exit_Month, year(DOE) || 'Q' || quarter(DOE) AS Exit_Quarter,
         strftime(DOE, '%Y-%m') AS Exit_Month_Year
  FROM hr_employees WHERE DOE IS NOT NULL)"""


def years_sql(days: str) -> str:
    return f"round_even(({days}) / 365.25::DOUBLE, 1)"


# --- sources ---------------------------------------------------------------


@query("csv_roundtrip", "SELECT * FROM hr_employees")
def _(spark, d):
    source = employees(spark, d)
    path = tables.write_csv(source, shared_path(spark, "roundtrip"))
    return tables.read_table(spark, path, source.schema)


_TEXT_DATES = """CASE WHEN EmployeeID % 50 = 0 THEN '2023-02-30' ELSE CAST(DOJ AS VARCHAR) END"""


@query(
    "coerce_dates",
    f"SELECT EmployeeID, TRY_CAST({_TEXT_DATES} AS DATE) AS DOJ, DOE FROM hr_employees",
)
def _(spark, d):
    text = F.when(F.col("EmployeeID") % 50 == 0, "2023-02-30").otherwise(F.col("DOJ").cast("string"))
    raw = employees(spark, d).select("EmployeeID", text.alias("DOJ"), F.col("DOE").cast("string"))
    return dates.coerce_dates(raw, ["DOJ", "DOE"])


@query(
    "parse_mixed_dates",
    """SELECT EmployeeID, strftime(DOJ, '%Y-%m-%d') AS DOJ, strftime(DOE, '%Y-%m-%d') AS DOE
       FROM hr_employees""",
)
def _(spark, d):
    def mixed(c):
        layout = F.col("EmployeeID") % 4
        return (
            F.when(layout == 0, F.date_format(c, "dd-MM-yyyy"))
            .when(layout == 1, F.date_format(c, "dd/MM/yyyy"))
            .when(layout == 2, F.date_format(c, "d MMM yyyy"))
            .otherwise(F.date_format(c, "yyyy-MM-dd"))
            .alias(c)
        )

    raw = employees(spark, d).select("EmployeeID", mixed("DOJ"), mixed("DOE"))
    return dates.parse_mixed_dates(raw, ["DOJ", "DOE"])


@query("preview", "SELECT * FROM hr_employees ORDER BY EmployeeID LIMIT 5")
def _(spark, d):
    return tables.preview(employees(spark, d), "EmployeeID")


@query("shape", 'SELECT count(*) AS "rows", CAST(19 AS INT) AS "columns" FROM hr_employees')
def _(spark, d):
    return tables.shape(employees(spark, d))


@query("input_template", "SELECT * EXCLUDE (Turnover) FROM hr_employees ORDER BY EmployeeID LIMIT 5")
def _(spark, d):
    return tables.input_template(employees(spark, d), "EmployeeID", "Turnover")


# --- projections -----------------------------------------------------------


@query("drop_columns", "SELECT * EXCLUDE (EmployeeID, Reason) FROM hr_employees")
def _(spark, d):
    return columns.drop_columns(employees(spark, d), ["EmployeeID", "Reason", "NotThere"])


@query("tenure_exited", f"SELECT EmployeeID, {years_sql('DOE - DOJ')} AS Tenure FROM hr_employees")
def _(spark, d):
    return employees(spark, d).select("EmployeeID", dates.tenure_exited().alias("Tenure"))


@query(
    "tenure_effective",
    f"""SELECT EmployeeID, {years_sql(f"coalesce(DOE, DATE '{AS_OF}') - DOJ")} AS Tenure
        FROM hr_employees""",
)
def _(spark, d):
    return employees(spark, d).select("EmployeeID", dates.tenure_effective(AS_OF).alias("Tenure"))


@query(
    "tenure_current",
    f"""SELECT EmployeeID, {years_sql(f"DATE '{AS_OF}' - DOJ")} AS Tenure FROM hr_employees""",
)
def _(spark, d):
    return employees(spark, d).select("EmployeeID", dates.tenure_current(AS_OF).alias("Tenure"))


@query("age", f"""SELECT EmployeeID, {years_sql(f"DATE '{AS_OF}' - DOB")} AS Age FROM hr_employees""")
def _(spark, d):
    return employees(spark, d).select("EmployeeID", dates.age(AS_OF).alias("Age"))


@query(
    "requisition_days",
    f"SELECT CandidateID, CAST(DATE '{AS_OF}' - RequisitionDate AS INT) AS Days FROM hr_candidates",
)
def _(spark, d):
    return candidates(spark, d).select("CandidateID", dates.requisition_days(AS_OF).alias("Days"))


@query(
    "exit_calendar",
    f"""WITH {LEAVERS} SELECT EmployeeID, Exit_Year, Exit_Month_Num, Exit_Month, Exit_Quarter,
        Exit_Month_Year FROM leavers""",
)
def _(spark, d):
    return leavers(spark, d).select(
        "EmployeeID", "Exit_Year", "Exit_Month_Num", "Exit_Month", "Exit_Quarter", "Exit_Month_Year"
    )


@query(
    "encode_target",
    """SELECT EmployeeID, CAST(CASE Turnover WHEN 'No' THEN 0 WHEN 'Yes' THEN 1 END AS INT) AS y,
       CAST(CASE Segment WHEN 'No' THEN 0 WHEN 'Yes' THEN 1 END AS INT) AS other FROM hr_employees""",
)
def _(spark, d):
    return employees(spark, d).select(
        "EmployeeID", encode_target("Turnover").alias("y"), encode_target("Segment").alias("other")
    )


@query(
    "align_columns",
    """SELECT Salary, CAST(0 AS DOUBLE) AS Overtime, Engagement, EmployeeID FROM hr_employees""",
)
def _(spark, d):
    return columns.align_columns(employees(spark, d), ["Salary", "Overtime", "Engagement", "EmployeeID"])


# --- filters ---------------------------------------------------------------


@query("exited_only", "SELECT * FROM hr_employees WHERE DOE IS NOT NULL")
def _(spark, d):
    return filters.exited_only(employees(spark, d))


@query(
    "quick_filter",
    f"WITH {LEAVERS} SELECT EmployeeID, DOE FROM leavers WHERE Exit_Year = 1999 AND Exit_Month = 'May'",
)
def _(spark, d):
    return filters.quick_filter(leavers(spark, d), 1999, "May").select("EmployeeID", "DOE")


@query(
    "quick_filter_month",
    f"WITH {LEAVERS} SELECT EmployeeID, DOE FROM leavers WHERE Exit_Month = 'March'",
)
def _(spark, d):
    return filters.quick_filter(leavers(spark, d), None, "March").select("EmployeeID", "DOE")


@query(
    "date_range_filter",
    """SELECT EmployeeID, DOE FROM hr_employees
       WHERE DOE BETWEEN DATE '1998-03-01' AND DATE '1999-06-30'""",
)
def _(spark, d):
    found = filters.date_range_filter(employees(spark, d), "DOE", "1998-03-01", "1999-06-30")
    return found.select("EmployeeID", "DOE")


@query("date_range_open", "SELECT EmployeeID, DOE FROM hr_employees WHERE DOE IS NOT NULL")
def _(spark, d):
    return filters.date_range_filter(employees(spark, d), "DOE").select("EmployeeID", "DOE")


@query(
    "custom_period_filter",
    f"""WITH {LEAVERS} SELECT EmployeeID, DOE FROM leavers WHERE Exit_Year BETWEEN 1997 AND 2000
        AND Exit_Month IN ('January', 'June', 'December')""",
)
def _(spark, d):
    found = filters.custom_period_filter(leavers(spark, d), 1997, 2000, ["January", "June", "December"])
    return found.select("EmployeeID", "DOE")


_MEMBERS = {
    "Department": ["1-URGENT", "2-HIGH"],
    "JobLevel": ["All"],
    "Gender": ["Female"],
    "DEIGroup": ["All", "Yes"],
}


@query(
    "member_filter",
    """SELECT EmployeeID, Department, Gender FROM hr_employees
       WHERE Department IN ('1-URGENT', '2-HIGH') AND Gender = 'Female'""",
)
def _(spark, d):
    return filters.member_filter(employees(spark, d), _MEMBERS).select("EmployeeID", "Department", "Gender")


@query(
    "contains_ci",
    """SELECT CandidateID, coalesce(contains(lower(Interviewed), 'yes'), FALSE) AS interviewed,
       coalesce(contains(lower(JoinedOrDropout), 'joined'), FALSE) AS joined FROM hr_candidates""",
)
def _(spark, d):
    return candidates(spark, d).select(
        "CandidateID",
        contains_ci("Interviewed", "Yes").alias("interviewed"),
        contains_ci("JoinedOrDropout", "Joined").alias("joined"),
    )


@query(
    "distinct_options",
    f"WITH {LEAVERS} SELECT DISTINCT Exit_Month AS option FROM leavers ORDER BY 1",
)
def _(spark, d):
    return filters.distinct_options(leavers(spark, d), "Exit_Month")


@query(
    "filter_summary",
    f"""WITH {LEAVERS} SELECT count(*) FILTER (WHERE Exit_Year = 1999) AS kept, count(*) AS total
        FROM leavers""",
)
def _(spark, d):
    return filters.filter_summary(leavers(spark, d), F.col("Exit_Year") == 1999)


# --- data quality ----------------------------------------------------------

_CLEANED = [
    "EmployeeID", "Department", "JobLevel", "DOJ", "DOB", "Gender", "DEIGroup", "LGBTQ", "Veteran",
    "Disability", "Country", "Salary", "Segment", "Reason", "Engagement", "TrainingHours",
    "Turnover", "RareTarget",
]


def _null_profile_sql() -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", (count(*) - count({c})) / count(*)::DOUBLE * 100 AS pct FROM hr_employees"
        for c in _CLEANED
    ]
    return f"""WITH p AS ({' UNION ALL '.join(parts)})
      SELECT "column", round(pct, 6) AS pct, CASE WHEN pct = 0 THEN 'No action required'
        WHEN pct <= 5 THEN 'Drop Rows' WHEN pct <= 30 THEN 'Impute' ELSE 'Drop Column' END AS action
      FROM p"""


@query("null_profile", _null_profile_sql())
def _(spark, d):
    return quality.null_profile(employees(spark, d), _CLEANED).withColumn("pct", F.round("pct", 6))


@query("drop_sparse_rows", "SELECT * FROM hr_employees WHERE Department IS NOT NULL")
def _(spark, d):
    return quality.drop_sparse_rows(employees(spark, d), ["Department"])


def _mode_sql(column: str, source: str) -> str:
    return f"""(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY {column}
               ORDER BY count(*) DESC, {column} LIMIT 1)"""


@query(
    "impute_mode",
    f"SELECT EmployeeID, coalesce(Segment, {_mode_sql('Segment', 'hr_employees')}) AS Segment FROM hr_employees",
)
def _(spark, d):
    return quality.impute_mode(employees(spark, d), ["Segment"]).select("EmployeeID", "Segment")


@query(
    "impute_median",
    """SELECT EmployeeID, round(coalesce(Salary, (SELECT quantile_cont(Salary, 0.5) FROM hr_employees)), 6)
       AS Salary FROM hr_employees""",
)
def _(spark, d):
    filled = quality.impute_median(employees(spark, d), ["Salary"])
    return filled.select("EmployeeID", F.round("Salary", 6).alias("Salary"))


@query(
    "impute_mean",
    f"""WITH t AS (SELECT EmployeeID, CASE WHEN EmployeeID % 10 = 3 THEN NULL ELSE
          {years_sql(f"DATE '{AS_OF}' - DOB")} END AS Age FROM hr_employees)
        SELECT EmployeeID, round(coalesce(Age, (SELECT avg(Age) FROM t)), 6) AS Age FROM t""",
)
def _(spark, d):
    aged = employees(spark, d).select(
        "EmployeeID", F.when(F.col("EmployeeID") % 10 != 3, dates.age(AS_OF)).alias("Age")
    )
    return quality.impute_mean(aged, ["Age"]).withColumn("Age", F.round("Age", 6))


@query(
    "clean",
    f"""WITH kept AS (SELECT * FROM hr_employees WHERE Department IS NOT NULL)
        SELECT * EXCLUDE (Reason)
          REPLACE (round(coalesce(Salary, (SELECT quantile_cont(Salary, 0.5) FROM kept)), 6) AS Salary,
                   coalesce(Segment, {_mode_sql('Segment', 'kept')}) AS Segment)
        FROM kept""",
)
def _(spark, d):
    return quality.clean(employees(spark, d), _CLEANED).withColumn("Salary", F.round("Salary", 6))


_IQR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _bounds_sql(source: str, cols: list[str], extra: str = "") -> str:
    parts = [
        f"""SELECT '{c}' AS "column", quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3,
            quantile_cont({c}, 0.5) AS median FROM {source}"""
        for c in cols
    ]
    return f"""q AS ({' UNION ALL '.join(parts)}),
      b AS (SELECT *, q1 - 1.5::DOUBLE * (q3 - q1) AS lower, q3 + 1.5::DOUBLE * (q3 - q1) AS upper FROM q)"""


def _unpivot_sql(source: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS x FROM {source}" for c in cols)


_EMP_NUM = ["Salary", "TrainingHours", "Engagement"]


@query(
    "iqr_bounds",
    f"""WITH {_bounds_sql('hr_employees', _EMP_NUM)}, u AS ({_unpivot_sql('hr_employees', _EMP_NUM)})
        SELECT "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(lower, 6) AS lower,
          round(upper, 6) AS upper, (SELECT count(*) FROM u WHERE u."column" = b."column"
          AND (u.x < b.lower OR u.x > b.upper)) AS outliers FROM b""",
)
def _(spark, d):
    return quality.iqr_bounds(employees(spark, d), _EMP_NUM).select(
        "column", *[F.round(c, 6).alias(c) for c in ("q1", "q3", "lower", "upper")], "outliers"
    )


@query(
    "iqr_remove",
    f"""WITH a AS (SELECT quantile_cont(TrainingHours, 0.25) AS q1, quantile_cont(TrainingHours, 0.75) AS q3
                 FROM hr_employees),
        one AS (SELECT h.* FROM hr_employees h, a WHERE TrainingHours IS NULL OR TrainingHours BETWEEN
                q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)),
        b AS (SELECT quantile_cont(Salary, 0.25) AS q1, quantile_cont(Salary, 0.75) AS q3 FROM one)
        SELECT EmployeeID, Salary, TrainingHours FROM one, b WHERE Salary IS NULL OR Salary BETWEEN
          q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)""",
)
def _(spark, d):
    return quality.iqr_remove(employees(spark, d), ["TrainingHours", "Salary"]).select(
        "EmployeeID", "Salary", "TrainingHours"
    )


@query(
    "iqr_impute",
    f"""WITH {_bounds_sql('hr_employees', ['Salary', 'TrainingHours'])},
        s AS (SELECT * FROM b WHERE "column" = 'Salary'), t AS (SELECT * FROM b WHERE "column" = 'TrainingHours')
        SELECT EmployeeID,
          round(CASE WHEN Salary < s.lower OR Salary > s.upper THEN s.median ELSE Salary END, 6) AS Salary,
          round(CASE WHEN TrainingHours < t.lower OR TrainingHours > t.upper THEN t.median
                ELSE TrainingHours END, 6) AS TrainingHours
        FROM hr_employees, s, t""",
)
def _(spark, d):
    return quality.iqr_impute(employees(spark, d), ["Salary", "TrainingHours"]).select(
        "EmployeeID", F.round("Salary", 6).alias("Salary"), F.round("TrainingHours", 6).alias("TrainingHours")
    )
