"""The two workforce views that the queries run on, derived from the given tables.

Each is one SQL projection that Spark and the checking engine both run as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2009-01-01"

HR_EMPLOYEES = """
SELECT o_orderkey AS EmployeeID,
       CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE o_orderpriority END AS Department,
       CAST(1 + o_custkey % 5 AS INT) AS JobLevel,
       CAST(o_orderdate AS DATE) AS DOJ,
       CASE WHEN o_orderstatus = 'F'
            THEN CAST(o_orderdate AS DATE) + CAST(30 + (o_orderkey * 37) % 2500 AS INT) END AS DOE,
       CAST(o_orderdate AS DATE) - CAST(7300 + (o_custkey * 13) % 12000 AS INT) AS DOB,
       CASE WHEN o_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS Gender,
       CASE WHEN o_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS DEIGroup,
       CASE WHEN o_custkey % 7 = 0 THEN 'Yes' ELSE 'No' END AS LGBTQ,
       CASE WHEN o_custkey % 11 = 0 THEN 'Yes' ELSE 'No' END AS Veteran,
       CASE WHEN o_custkey % 9 = 0 THEN 'Yes' ELSE 'No' END AS Disability,
       n_name AS Country,
       CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_totalprice END AS Salary,
       CASE WHEN o_orderkey % 8 = 1 THEN NULL ELSE c_mktsegment END AS Segment,
       CASE WHEN o_orderkey % 20 < 9 THEN NULL ELSE c_mktsegment END AS Reason,
       CAST(1 + o_orderkey % 5 AS INT) AS Engagement,
       CAST(CASE WHEN o_orderkey % 997 = 0 THEN 5000 ELSE 10 + (o_custkey * 7) % 90 END AS INT)
         AS TrainingHours,
       CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS Turnover,
       CASE WHEN o_orderkey % 25 = 0 THEN 'Yes' ELSE 'No' END AS RareTarget
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

HR_CANDIDATES = """
SELECT o_orderkey AS CandidateID,
       o_orderpriority AS Department,
       c_mktsegment AS PositionName,
       n_name AS Country,
       CAST(1 + o_custkey % 5 AS INT) AS JobLevel,
       CASE WHEN o_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS DEI,
       CASE WHEN o_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS Gender,
       CAST(o_orderdate AS DATE) AS RequisitionDate,
       CASE o_custkey % 4 WHEN 0 THEN 'Job_portal' WHEN 1 THEN 'Referral'
                          WHEN 2 THEN 'Campus' ELSE 'Agency' END AS SourceOfHire,
       CASE WHEN o_orderkey % 40 = 11 THEN NULL WHEN o_orderkey % 10 < 4 THEN 'Yes'
            WHEN o_orderkey % 10 < 8 THEN 'yes' ELSE 'No' END AS Interviewed,
       CASE WHEN o_orderkey % 7 < 5 THEN 'Yes' ELSE 'No' END AS Shortlisted,
       CASE WHEN o_orderkey % 3 < 2 THEN 'YES' ELSE 'no' END AS OfferAccepted,
       CASE WHEN o_orderkey % 4 < 3 THEN 'Joined' ELSE 'Dropout' END AS JoinedOrDropout
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

_SOURCES = ("orders", "customer", "nation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HR_EMPLOYEES, **{t: table(spark, sf_dir, t) for t in _SOURCES})


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HR_CANDIDATES, **{t: table(spark, sf_dir, t) for t in _SOURCES})


def with_views(body: str) -> str:
    """A statement for the checking engine, with the views it mentions in front."""
    views = {"hr_employees": HR_EMPLOYEES, "hr_candidates": HR_CANDIDATES}
    parts = [
        f"{name} AS ({sql.format(**{t: t for t in _SOURCES})})"
        for name, sql in views.items()
        if name in body
    ]
    if not parts:
        return body.strip()
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"
