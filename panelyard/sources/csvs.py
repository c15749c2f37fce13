"""CSV scans."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelyard.functions.columns import clean_names, names_matching
from panelyard.operators.prep import split_target
from panelyard.operators.reshape import melt
from panelyard.operators.sampling import keys_per_group


def _read(spark: SparkSession, path: str, schema: StructType | str | None) -> DataFrame:
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def load_with_target(spark: SparkSession, path: str, target: str,
                     schema: StructType | str | None = None) -> tuple[DataFrame, list[str], str]:
    """A CSV table with its feature names and target name."""
    df = _read(spark, path, schema)
    return (df, *split_target(df, target))


def load_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV table with cleaned column names; an unnamed first column becomes ``id``."""
    df = _read(spark, path, schema)
    return df.toDF(*clean_names(df.columns))


def load_series(spark: SparkSession, path: str, value: str = "value") -> DataFrame:
    """A CSV series whose ``value`` column is cast to double."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumn(value, F.col(value).try_cast("double"))


# Column types of the price and calendar tables; other columns are text.
PRICE_TYPES = {"wm_yr_wk": "int", "sell_price": "double"}
CALENDAR_TYPES = {"date": "date", "wm_yr_wk": "int", "wday": "int", "month": "int", "year": "int"}


def _read_typed(spark: SparkSession, path: str, type_of: Callable[[str], str]) -> DataFrame:
    """A CSV table with types given by column name; only the header line is read for it."""
    names = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{c}` {type_of(c)}" for c in names)
    return spark.read.option("header", True).schema(schema).csv(path)


def load_panel_folder(spark: SparkSession, folder: str, sales: str, prices: str, calendar: str,
                      horizon: int = 0, keys_per_category: int | None = None,
                      seed: int = 0, value_type: str = "int") -> dict[str, DataFrame]:
    """The three tables of a retail panel (S3), with the wide sales melted right after the scan.

    ``horizon`` appends that many empty future days per series (S4); ``keys_per_category`` keeps
    a random set of items per category for trial runs (M2).
    """
    base = folder.rstrip("/")
    wide = _read_typed(spark, f"{base}/{sales}", lambda c: value_type if re.match(r"d_\d+", c) else "string")
    price = _read_typed(spark, f"{base}/{prices}", lambda c: PRICE_TYPES.get(c, "string"))
    if keys_per_category is not None:
        wide = keys_per_group(wide, "cat_id", "item_id", keys_per_category, seed)
        price = price.join(wide.select("item_id").distinct(), "item_id", "left_semi")
    days = names_matching(wide, r"d_\d+")
    ids = [c for c in wide.columns if c not in days]
    long = melt(wide, ids, days)
    if horizon:
        last = max(int(c.split("_")[1]) for c in days)
        future = wide.select(*ids).withColumn(
            "d", F.explode(F.array(*[F.lit(f"d_{last + i + 1}") for i in range(horizon)])))
        long = long.unionByName(future.withColumn("sold", F.lit(0).cast(dict(long.dtypes)["sold"])))
    return {"sales": long, "prices": price, "calendar": _read_typed(
        spark, f"{base}/{calendar}", lambda c: CALENDAR_TYPES.get(c, "int" if c.startswith("snap") else "string"))}
