"""Registry of example queries and the canonical inputs derived from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.operators import panel as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def case(name: str, sql: str | None = None):
    """Register a query and, where SQL can state it, the equivalent DuckDB text."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} exists already")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


class Tables:
    """The parquet tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


SERIES_ATTRS = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]


def line_sales(t: Tables) -> DataFrame:
    """Line items by item (brand) and store (region); ``amount`` is in cents."""
    return (
        t.lineitem.select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        .join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t.supplier.select("s_suppkey", "s_nationkey"),
              F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation.select("n_nationkey", "n_regionkey"),
              F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("p_brand").alias("item_id"),
            F.col("r_name").alias("store_id"),
            F.col("l_shipdate").cast("date").alias("dt"),
            F.col("l_quantity").alias("sold"),
            F.round(F.col("l_extendedprice") * 100).alias("amount"),
        )
    )


def with_hierarchy(df: DataFrame) -> DataFrame:
    """The series id and the retail hierarchy, all given by item and store."""
    brand = F.substring("item_id", 7, 10).cast("int")
    west = F.col("store_id").isin("AMERICA", "EUROPE")
    return df.withColumns({
        "id": F.concat("item_id", F.lit("_"), "store_id"),
        "dept_id": F.concat(F.lit("DEPT_"), F.floor((2 * brand + 3) / 5).cast("string")),
        "cat_id": F.concat(F.lit("CAT_"), F.floor((brand + 4) / 5).cast("string")),
        "state_id": F.when(west, "WEST").otherwise("EAST"),
    })


def raw_sales(t: Tables) -> DataFrame:
    """Line items with the whole hierarchy."""
    return with_hierarchy(line_sales(t))


def day_list(t: Tables) -> DataFrame:
    return P.day_table(t.lineitem.select(F.col("l_shipdate").cast("date").alias("dt")), "dt")


def sales_panel(t: Tables) -> tuple[DataFrame, int]:
    """The dense panel and its number of days."""
    observed = with_hierarchy(P.observed_days(line_sales(t), "item_id", ["store_id"], "dt", "sold"))
    days = P.day_table(observed, "dt")
    return P.dense_panel(observed, days, "id", SERIES_ATTRS, "sold"), days.count()


PANEL_SQL = """
raw AS (
  SELECT p_brand || '_' || r_name AS id, p_brand AS item_id,
         'DEPT_' || CAST((2 * CAST(substr(p_brand, 7) AS INTEGER) + 3) // 5 AS VARCHAR) AS dept_id,
         'CAT_' || CAST((CAST(substr(p_brand, 7) AS INTEGER) + 4) // 5 AS VARCHAR) AS cat_id,
         r_name AS store_id,
         CASE WHEN r_name IN ('AMERICA', 'EUROPE') THEN 'WEST' ELSE 'EAST' END AS state_id,
         CAST(l_shipdate AS DATE) AS dt, l_quantity AS sold, round(l_extendedprice * 100) AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
days AS (
  SELECT dt, CAST(row_number() OVER (ORDER BY dt) AS INTEGER) AS d
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS dt FROM lineitem)),
series AS (SELECT DISTINCT id, item_id, dept_id, cat_id, store_id, state_id FROM raw),
daily AS (SELECT id, dt, sum(sold) AS sold FROM raw GROUP BY id, dt),
panel AS (
  SELECT series.*, days.d, days.dt, coalesce(daily.sold, 0e0) AS sold
  FROM series CROSS JOIN days LEFT JOIN daily ON daily.id = series.id AND daily.dt = days.dt)
"""


def r(col: str, digits: int = 6, name: str | None = None):
    """Rounded output column."""
    return (F.round(F.col(col), digits) + F.lit(0.0)).alias(name or col)


def rsql(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0e0 AS {name}"
