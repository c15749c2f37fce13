"""Credit risk: preparation and exploration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions import columns as C
from panelyard.operators import association, encode, outliers, prep, profile


def prepare(df: DataFrame, key: str = "id", risk: str = "risk", good: str = "good",
            impute: Sequence[str] = ("saving_accounts", "checking_account")) -> DataFrame:
    """Modes for missing accounts, the target as 0/1, text columns as codes, narrow types.

    The key stays in the frame: it identifies rows for splits and is left out of the features.
    """
    for c in impute:
        df = encode.impute_mode(df, c)
    df = df.withColumn("good_risk", C.flag(risk, good)).drop(risk)
    texts = [c for c in C.names_of_type(df, "string") if c != key]
    df = encode.category_codes(df, texts)
    for c in texts:
        df = df.withColumn(c, F.col(f"{c}_code")).drop(f"{c}_code")
    return prep.narrow(df)


def explore(df: DataFrame, key: str = "id", target: str = "good_risk", cut: int = 8) -> dict[str, DataFrame]:
    """The tables behind the figures of the credit exploration."""
    data = df.drop(key)
    kinds = prep.columns_by_cardinality(data, cut).collect()
    continuous = [r["column_name"] for r in kinds if r["kind"] == "continuous"]
    discrete = [r["column_name"] for r in kinds if r["kind"] == "discrete"]
    tables = {
        "columns": profile.column_profile(data),
        "contingency": association.category_rows(data, [c for c in discrete if c != target], [target])
        .groupBy("column_name", "level", target).agg(F.count("*").alias("n")),
        "mutual_information": association.mixed_mutual_information(data, discrete, continuous, target),
    }
    if continuous:
        flagged = outliers.isolation_forest(df, key, continuous)
        tables |= {
            "describe": profile.describe(data, continuous),
            "shape": profile.shape_statistics(data, continuous),
            "boxes": profile.box_statistics(data, continuous, [target]),
            "outliers": flagged,
            "outlier_profile": outliers.outlier_profile(flagged, continuous),
            "pearson": association.pearson(data, continuous),
            "spearman": association.spearman(data, continuous),
        }
    return tables
