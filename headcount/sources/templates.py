"""Column layouts of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S, D, I, F8 = T.StringType(), T.DateType(), T.IntegerType(), T.DoubleType()


def _schema(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


# The column names an input file carries, per kind of table.
_ATTRITION = (
    ("EmployeeID", S),
    ("Department", S),
    ("Job level", S),
    ("DOJ", D),
    ("DOB", D),
    ("DOE", D),
    ("Gender", S),
    ("DEIGroup", S),
    ("Country", S),
    ("Reason for Leaving", S),
)
_DIVERSITY = (
    ("EmployeeID", S),
    ("Department", S),
    ("Job Level", S),
    ("Gender", S),
    ("LGBTQ", S),
    ("Indigenous", S),
    ("Ethnicity", S),
    ("Disability", S),
    ("Minority", S),
    ("Veteran", S),
    ("DOB", D),
    ("DOJ", D),
    ("Country", S),
)
_RECRUITMENT = (
    ("Department", S),
    ("Position Name", S),
    ("Job Level", S),
    ("DEI", S),
    ("Country", S),
    ("Date of Requisition Received", D),
    ("Source of Hire", S),
    ("Gender", S),
    ("Candidate Experience (Years)", F8),
    ("Interviewed or Not", S),
    ("Shortlisted or Not", S),
    ("Offer Accepted or Not", S),
    ("Joined or Dropout", S),
)
_PREDICTION = _ATTRITION + (
    ("Salary", F8),
    ("Engagement Score", I),
    ("Performance Score", I),
    ("Training Hours", F8),
    ("Number of Projects", I),
    ("Overtime", S),
    ("Promotion in Last 3 Years", S),
    ("Work-Life Balance", I),
    ("Turnover", S),
)
_HEADCOUNT = (
    ("EmployeeID", S),
    ("Department", S),
    ("DOJ", D),
    ("Age", I),
    ("Attrition", S),
)

TEMPLATES: dict[str, T.StructType] = {
    "attrition": _schema(*_ATTRITION),
    "diversity": _schema(*_DIVERSITY),
    "recruitment": _schema(*_RECRUITMENT),
    "prediction": _schema(*_PREDICTION),
    "engagement": _schema(*_HEADCOUNT),
    "performance": _schema(*_HEADCOUNT),
}

# The date columns a file of each kind must have.
REQUIRED_DATES: dict[str, tuple[str, ...]] = {
    "attrition": ("DOJ", "DOE", "DOB"),
    "diversity": ("DOJ", "DOB"),
    "recruitment": ("Date of Requisition Received",),
    "prediction": ("DOJ", "DOE", "DOB"),
    "engagement": ("DOJ", "DOE", "DOB"),
    "performance": ("DOJ", "DOE", "DOB"),
}


def template_schema(name: str) -> T.StructType:
    if name not in TEMPLATES:
        raise ValueError(f"no template '{name}'; known: {', '.join(TEMPLATES)}")
    return TEMPLATES[name]


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Return `df`, or raise KeyError naming every column it lacks."""
    present = {c.lower() for c in df.columns}
    missing = [c for c in columns if c.lower() not in present]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df
