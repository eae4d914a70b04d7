"""Queries and their SQL: profiles, counts, recruitment, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from headcount.functions import dates
from headcount.operators import counts, distributions, profile, recruiting
from headcount.operators.columns import with_requisition_days
from headcount.plans import attrition
from suite.tables import LEAVERS, _bounds_sql, _unpivot_sql, employees, leavers, years_sql
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


def rounded(df, places=6, keep=()):
    """Round the double columns, as the SQL side does."""
    return df.select(
        [
            F.round(F.col(f"`{c}`"), places).alias(c) if t == "double" and c not in keep else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


# --- whole-table profiles ---------------------------------------------------

_ALL = [
    "EmployeeID", "Department", "JobLevel", "DOJ", "DOE", "DOB", "Gender", "DEIGroup", "LGBTQ",
    "Veteran", "Disability", "Country", "Salary", "Segment", "Reason", "Engagement",
    "TrainingHours", "Turnover", "RareTarget",
]
_TYPES = {
    "EmployeeID": "bigint", "JobLevel": "int", "DOJ": "date", "DOE": "date", "DOB": "date",
    "Salary": "double", "Engagement": "int", "TrainingHours": "int",
}
_NULLS = " + ".join(f"(count(*) - count({c}))" for c in _ALL)


@query(
    "overview",
    f"""SELECT count(*) AS "rows", CAST({len(_ALL)} AS INT) AS "columns",
        CAST({_NULLS} AS BIGINT) AS missing FROM hr_employees""",
)
def _(spark, d):
    return profile.overview(employees(spark, d))


@query(
    "column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{_TYPES.get(c, "string")}' AS "type",
            count(DISTINCT {c}) AS "distinct", count(*) - count({c}) AS nulls FROM hr_employees"""
        for c in _ALL
    ),
)
def _(spark, d):
    return profile.column_profile(employees(spark, d))


def _describe_sql(source: str, cols: list[str], extra: str = "", places: int = 4) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), {places}) AS mean,
            round(stddev_samp({c}), {places}) AS std, min({c})::DOUBLE AS min,
            round(quantile_cont({c}, 0.25), 6)::DOUBLE AS q25, round(quantile_cont({c}, 0.5), 6)::DOUBLE AS q50,
            round(quantile_cont({c}, 0.75), 6)::DOUBLE AS q75, max({c})::DOUBLE AS max
            {extra.format(c=c)} FROM {source}"""
        for c in cols
    )


def _described(df):
    out = df.withColumns({c: F.round(c, 4) for c in ("mean", "std")})
    return out.withColumns({c: F.round(c, 6) for c in ("q25", "q50", "q75")})


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_EMP = ["Salary", "TrainingHours", "JobLevel"]


@query("describe_numeric", _describe_sql("hr_employees", _EMP))
def _(spark, d):
    return _described(profile.describe_numeric(employees(spark, d), _EMP))


@query(
    "describe_extended",
    _describe_sql("lineitem", _NUMBERS, ", round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis"),
)
def _(spark, d):
    out = _described(profile.describe_extended(table(spark, d, "lineitem"), _NUMBERS))
    return out.withColumns({c: F.round(c, 4) for c in ("skewness", "kurtosis")})


def _date_figures(c: str) -> str:
    s = f"epoch({c}::TIMESTAMP)"
    parts = {
        "mean": f"avg({s})", "min": f"min({s})", "q25": f"quantile_cont({s}, 0.25)",
        "q50": f"quantile_cont({s}, 0.5)", "q75": f"quantile_cont({s}, 0.75)", "max": f"max({s})",
    }
    made = ", ".join(f"make_timestamp(CAST(floor({e}) AS BIGINT) * 1000000) AS {n}" for n, e in parts.items())
    return f"""SELECT '{c}' AS "column", count({c}) AS count, {made} FROM hr_employees"""


@query("describe_dates", " UNION ALL ".join(_date_figures(c) for c in ("DOJ", "DOE", "DOB")))
def _(spark, d):
    return profile.describe_dates(employees(spark, d), ["DOJ", "DOE", "DOB"])


_TEXTS = ["Department", "Segment", "Reason", "Country", "Gender"]


def _top_sql(c: str, what: str) -> str:
    return f"""(SELECT {what} FROM hr_employees WHERE {c} IS NOT NULL GROUP BY {c}
               ORDER BY count(*) DESC, {c} LIMIT 1)"""


@query(
    "describe_categorical",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, count(DISTINCT {c}) AS "unique",
            {_top_sql(c, c)} AS top, {_top_sql(c, "count(*)")} AS freq FROM hr_employees"""
        for c in _TEXTS
    ),
)
def _(spark, d):
    return profile.describe_categorical(employees(spark, d), _TEXTS)


@query(
    "categorical_modes",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {_top_sql(c, c)} AS most_common, {_top_sql(c, "count(*)")} AS frequency"""
        for c in _TEXTS
    ),
)
def _(spark, d):
    return profile.categorical_modes(employees(spark, d), _TEXTS)


# --- counts -----------------------------------------------------------------


@query(
    "value_counts",
    """SELECT Department AS value, count(*) AS count FROM hr_employees WHERE Department IS NOT NULL
       GROUP BY 1 ORDER BY 2 DESC, 1""",
)
def _(spark, d):
    return counts.value_counts(employees(spark, d), "Department")


@query(
    "pair_counts",
    """SELECT Department, Segment, count(*) AS count FROM hr_employees
       WHERE Department IS NOT NULL AND Segment IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, d):
    return counts.pair_counts(employees(spark, d), "Department", "Segment")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "crosstab",
    "SELECT Department, "
    + ", ".join(f"count(*) FILTER (WHERE Segment = '{s}') AS \"{s}\"" for s in _SEGMENTS)
    + " FROM hr_employees WHERE Department IS NOT NULL AND Segment IS NOT NULL GROUP BY 1",
)
def _(spark, d):
    return counts.crosstab(employees(spark, d), "Department", "Segment")


@query(
    "crosstab_long",
    """WITH p AS (SELECT Country, Segment FROM hr_employees WHERE Country IS NOT NULL AND Segment IS NOT NULL),
       a AS (SELECT DISTINCT Country FROM p), b AS (SELECT DISTINCT Segment FROM p)
       SELECT a.Country, b.Segment AS variable, count(p.Country) AS value
       FROM a CROSS JOIN b LEFT JOIN p ON p.Country = a.Country AND p.Segment = b.Segment GROUP BY 1, 2""",
)
def _(spark, d):
    return counts.crosstab_long(employees(spark, d), "Country", "Segment")


_DIMS = ["Gender", "LGBTQ", "Disability", "Veteran", "Country"]


def _dimension_sql(cols: list[str], source: str = "hr_employees") -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS count FROM {source}
            WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c in cols
    )


@query("dimension_counts", _dimension_sql(_DIMS))
def _(spark, d):
    df = employees(spark, d)
    return counts.dimension_counts(df, counts.present_dimensions(df))


_SHARED = ["Gender", "Segment", "Country"]


@query(
    "category_shares",
    f"""WITH c AS ({_dimension_sql(_SHARED)})
        SELECT *, round_even(count / (SELECT count(*) FROM hr_employees)::DOUBLE * 100, 2) AS pct FROM c""",
)
def _(spark, d):
    return counts.category_shares(employees(spark, d), _SHARED)


def _status_sql(c: str, value: str) -> str:
    return f"""SELECT '{c}' AS "column", count(DISTINCT {value}) AS categories,
      CASE count(DISTINCT {value}) WHEN 0 THEN 'no data' WHEN 1 THEN 'single category' ELSE 'breakdown' END
      AS status, CASE WHEN count(DISTINCT {value}) = 1 THEN min({value}) END AS category FROM hr_employees"""


@query(
    "dimension_status",
    " UNION ALL ".join(
        [
            _status_sql("Gender", "Gender"),
            _status_sql("Country", "Country"),
            _status_sql("Empty", "CAST(NULL AS VARCHAR)"),
            _status_sql("Same", "CASE WHEN Gender = 'Male' THEN 'only' END"),
        ]
    ),
)
def _(spark, d):
    df = employees(spark, d).withColumns(
        {"Empty": F.lit(None).cast("string"), "Same": F.when(F.col("Gender") == "Male", "only")}
    )
    return counts.dimension_status(df, ["Gender", "Country", "Empty", "Same"])


@query(
    "attrition_breakdown",
    f"""WITH {LEAVERS}, f AS (SELECT * FROM leavers WHERE Gender = 'Female')
        {_dimension_sql(["Exit_Year", "Exit_Month", "Exit_Quarter", "Gender"], "f")}""",
)
def _(spark, d):
    choices = {"Department": ["All"], "Gender": ["Female"]}
    return attrition.breakdown(employees(spark, d), choices)


@query(
    "monthly_pattern",
    f"""WITH {LEAVERS} SELECT Exit_Month_Num AS month_num, Exit_Month, count(*) AS count FROM leavers
        GROUP BY 1, 2 ORDER BY 1""",
)
def _(spark, d):
    return counts.monthly_pattern(leavers(spark, d))


@query(
    "quarterly_distribution",
    f"""WITH {LEAVERS} SELECT Exit_Quarter, count(*) AS count,
        round_even(count(*) / (SELECT count(*) FROM leavers)::DOUBLE * 100, 2) AS pct FROM leavers GROUP BY 1""",
)
def _(spark, d):
    return counts.quarterly_distribution(leavers(spark, d))


def _compare_sql(column: str) -> str:
    return f"""WITH {LEAVERS}, o AS (SELECT min({column}) AS a, max({column}) AS b FROM leavers)
      SELECT o.a AS period_1, count(*) FILTER (WHERE {column} = o.a) AS count_1,
             o.b AS period_2, count(*) FILTER (WHERE {column} = o.b) AS count_2
      FROM leavers, o GROUP BY o.a, o.b"""


for _grain, _column in counts.GRAINS.items():
    query(f"period_compare_{_grain}", _compare_sql(_column))(
        lambda spark, d, g=_grain: counts.period_compare(leavers(spark, d), g)
    )


@query(
    "period_compare",
    f"""WITH {LEAVERS} SELECT CAST(1998 AS INT) AS period_1, count(*) FILTER (WHERE Exit_Year = 1998) AS count_1,
        CAST(2000 AS INT) AS period_2, count(*) FILTER (WHERE Exit_Year = 2000) AS count_2 FROM leavers""",
)
def _(spark, d):
    return counts.period_compare(leavers(spark, d), "year", 1998, 2000)


@query("date_extent", 'SELECT min(DOE) AS "first", max(DOE) AS "last" FROM hr_employees')
def _(spark, d):
    return counts.date_extent(employees(spark, d), "DOE")


# --- recruitment ------------------------------------------------------------

NAMES = recruiting.CandidateColumns("Interviewed", "Shortlisted", "OfferAccepted", "JoinedOrDropout")
_FLAGS = """flags AS (
  SELECT *, coalesce(lower(Interviewed) LIKE '%yes%', FALSE) AS f1, lower(Shortlisted) LIKE '%yes%' AS f2,
         lower(OfferAccepted) LIKE '%yes%' AS f3, lower(JoinedOrDropout) LIKE '%joined%' AS f4,
         CAST(DATE '2009-01-01' - RequisitionDate AS INT) AS Days FROM hr_candidates),
  staged AS (SELECT *, CASE WHEN f1 AND f2 AND f3 AND f4 THEN 'Joined' WHEN f1 AND f2 AND f3 THEN 'Offer Accepted'
         WHEN f1 AND f2 THEN 'Shortlisted' WHEN f1 THEN 'Interviewed' ELSE 'Requisitions' END AS stage FROM flags)"""


def applicants(spark, d):
    aged = with_requisition_days(candidates(spark, d), AS_OF, "RequisitionDate")
    return recruiting.with_funnel_flags(aged, "Days", NAMES)


def _funnel_sql() -> str:
    tests = ["TRUE", "f1", "f1 AND f2", "f1 AND f2 AND f3", "f1 AND f2 AND f3 AND f4"]
    parts = []
    for i, (stage, test) in enumerate(zip(recruiting.STAGES, tests)):
        here = f"count(*) FILTER (WHERE {test})"
        prior = f"count(*) FILTER (WHERE {tests[i - 1]})"
        rate = (
            "CAST(NULL AS DOUBLE)"
            if i == 0
            else f"CASE WHEN {prior} > 0 THEN round_even({here} / {prior}::DOUBLE * 100, 2) ELSE 0 END"
        )
        parts.append(f"SELECT CAST({i} AS INT) AS step, '{stage}' AS stage, {here} AS count, {rate} AS rate FROM flags")
    return f"WITH {_FLAGS} " + " UNION ALL ".join(parts)


@query("recruitment_funnel", _funnel_sql())
def _(spark, d):
    return recruiting.recruitment_funnel(candidates(spark, d), NAMES)


_SIX = """min(Days) AS "Min", round(avg(Days), 6) AS "Mean", median(Days)::DOUBLE AS "Median", max(Days) AS "Max",
          count(Days) AS "Count", round(stddev_samp(Days), 6) AS "Std Dev" """


@query(
    "time_to_hire",
    f"WITH {_FLAGS} SELECT Department, Gender, {_SIX} FROM flags WHERE f4 GROUP BY 1, 2",
)
def _(spark, d):
    return rounded(recruiting.time_to_hire(applicants(spark, d), "Department", "Gender", names=NAMES))


@query("requisition_aging", f"WITH {_FLAGS} SELECT Country, {_SIX} FROM flags GROUP BY 1")
def _(spark, d):
    return rounded(recruiting.requisition_aging(applicants(spark, d), "Country"))


@query(
    "total_profiles",
    'SELECT Department, DEI, count(*) AS "Total Profiles" FROM hr_candidates GROUP BY 1, 2',
)
def _(spark, d):
    return recruiting.total_profiles(applicants(spark, d), "Department", "DEI")


for _name, _flag, _label, _function in (
    ("interview_ratio", "f1", "Interview Ratio", recruiting.interview_ratio),
    ("offer_ratio", "f3", "Offer Ratio", recruiting.offer_ratio),
    ("join_ratio", "f4", "Join Ratio", recruiting.join_ratio),
):
    query(
        _name,
        f"""WITH {_FLAGS} SELECT PositionName, Gender, round(avg(CAST({_flag} AS INT)), 6) AS "{_label}"
            FROM flags GROUP BY 1, 2""",
    )(lambda spark, d, f=_function: rounded(f(applicants(spark, d), "PositionName", "Gender")))


@query(
    "source_effectiveness",
    f"""WITH {_FLAGS} SELECT SourceOfHire, round(avg(CAST(f4 AS INT)), 6) AS "Effectiveness",
        count(*) AS "Candidates" FROM flags GROUP BY 1""",
)
def _(spark, d):
    return rounded(recruiting.source_effectiveness(applicants(spark, d), "SourceOfHire"))


@query(
    "funnel_by_group",
    f"""WITH {_FLAGS} SELECT Department, Gender, stage AS "Funnel Stage", count(*) AS "Count"
        FROM staged GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return recruiting.funnel_by_group(applicants(spark, d), "Department", "Gender")


@query(
    "stats_long",
    f"""WITH {_FLAGS}, s AS (SELECT JobLevel, {_SIX} FROM flags GROUP BY 1)
        """
    + " UNION ALL ".join(
        f"SELECT JobLevel, '{m}' AS \"Metric\", \"{m}\"::DOUBLE AS \"Value\" FROM s" for m in recruiting.SIX_FIGURES
    ),
)
def _(spark, d):
    stats = recruiting.requisition_aging(applicants(spark, d), "JobLevel")
    return rounded(recruiting.stats_long(stats, "JobLevel"))


# --- distributions ----------------------------------------------------------


def _histogram_sql(source: str, x: str, bins: int) -> str:
    return f"""WITH v AS (SELECT {x}::DOUBLE AS x FROM {source} WHERE {x} IS NOT NULL),
      e AS (SELECT min(x) AS lo, (max(x) - min(x)) / {bins}::DOUBLE AS w FROM v),
      c AS (SELECT least(CAST(floor((x - lo) / w) AS INT), {bins - 1}) AS bin, count(*) AS n FROM v, e GROUP BY 1)
      SELECT CAST(r.i AS INT) AS bin, round(lo + w * r.i, 6) AS "start", round(lo + w * (r.i + 1), 6) AS "end",
        coalesce(n, 0) AS count FROM range({bins}) AS r(i) CROSS JOIN e LEFT JOIN c ON c.bin = r.i"""


@query("histogram", _histogram_sql("lineitem", "l_extendedprice", 30))
def _(spark, d):
    return rounded(distributions.histogram(table(spark, d, "lineitem"), "l_extendedprice", 30))


@query(
    "histogram_age",
    _histogram_sql(f"""(SELECT {years_sql(f"DATE '{AS_OF}' - DOB")} AS Age FROM hr_employees)""", "Age", 20),
)
def _(spark, d):
    aged = employees(spark, d).select(dates.age(AS_OF).alias("Age"))
    return rounded(distributions.histogram(aged, "Age", 20))


@query(
    "density",
    """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
         stddev_samp(l_extendedprice) * pow(count(*)::DOUBLE, -0.2) AS w, count(*)::DOUBLE AS n FROM lineitem),
       g AS (SELECT r.i, lo + (hi - lo) / 99::DOUBLE * r.i AS gx, w, n FROM range(100) AS r(i), e),
       v AS (SELECT l_extendedprice AS x, count(*) AS c FROM lineitem GROUP BY 1)
       SELECT CAST(i AS INT) AS point, round(gx, 4) AS x,
         round(sum(c * exp(-0.5::DOUBLE * ((gx - x) / w) * ((gx - x) / w))) / (n * w * sqrt(2 * pi())) * 1e6, 6)
         AS density FROM g, v GROUP BY i, gx, w, n""",
)
def _(spark, d):
    found = distributions.density(table(spark, d, "lineitem"), "l_extendedprice", 100)
    # Prices are large, so densities are small: compare them per million.
    return found.select(
        "point", F.round("x", 4).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density")
    )


@query("rug", "SELECT Salary AS value FROM hr_employees WHERE Salary IS NOT NULL")
def _(spark, d):
    return distributions.rug(employees(spark, d), "Salary")


_BOXES = ["Salary", "TrainingHours"]


@query(
    "box_stats",
    f"""WITH {_bounds_sql("hr_employees", _BOXES)}, u AS ({_unpivot_sql("hr_employees", _BOXES)})
        SELECT b."column", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
          round(lower, 6) AS lower, round(upper, 6) AS upper,
          round(min(x) FILTER (WHERE x BETWEEN lower AND upper), 6) AS whisker_low,
          round(max(x) FILTER (WHERE x BETWEEN lower AND upper), 6) AS whisker_high,
          count(*) FILTER (WHERE x < lower OR x > upper) AS outliers
        FROM b JOIN u ON u."column" = b."column" GROUP BY ALL""",
)
def _(spark, d):
    return rounded(distributions.box_stats(employees(spark, d), _BOXES))


@query(
    "hierarchy_counts",
    """WITH p AS (SELECT Department, Segment FROM hr_employees WHERE Department IS NOT NULL AND Segment IS NOT NULL)
       SELECT Department, CAST(NULL AS VARCHAR) AS Segment, CAST(1 AS INT) AS level, count(*) AS count
       FROM p GROUP BY 1
       UNION ALL SELECT Department, Segment, CAST(2 AS INT), count(*) FROM p GROUP BY 1, 2""",
)
def _(spark, d):
    return distributions.hierarchy_counts(employees(spark, d), "Department", "Segment")


_CORR = ["Salary", "TrainingHours", "JobLevel"]


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM hr_employees"
        for a in _CORR
        for b in _CORR
    ),
)
def _(spark, d):
    return rounded(distributions.correlation_matrix(employees(spark, d), _CORR))


@query(
    "scatter_sample",
    """SELECT EmployeeID, Salary, TrainingHours FROM hr_employees
       ORDER BY md5('42:' || EmployeeID::VARCHAR), EmployeeID LIMIT 500""",
)
def _(spark, d):
    return distributions.scatter_sample(employees(spark, d), ["Salary", "TrainingHours"], "EmployeeID", 500)


@query("scatter_points", "SELECT l_quantity, l_extendedprice FROM lineitem")
def _(spark, d):
    return distributions.scatter_points(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
