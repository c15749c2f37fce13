"""Regression and classification scores per split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.operators.profile import _match
from panelyard.plans import hash_key, quantiles_of_table, stage, with_row, with_running_total

REGRESSION = ["mae", "mse", "rmse", "nrmse", "r2", "bsl_r2"]


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE, RMSE, RMSE / IQR(predictions), R2 and the R2 of the mean predictor (V1).

    Predictions without spread give an infinite NRMSE (null when the error is 0 as well).
    """
    by = list(by)
    error = F.col(actual) - F.col(predicted)
    df = stage(df.select(*by, *dict.fromkeys([actual, predicted])), "predictions")
    sums = df.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"),
        F.var_pop(actual).alias("__var"), F.count(error).alias("n"))
    q = quantiles_of_table(df, [predicted], [0.25, 0.75], by).drop("column")
    out = _match(sums, q, by) if by else with_row(sums, q)
    spread = F.col("q")[1] - F.col("q")[0]
    r2 = F.when(F.col("__var") > 0, 1 - F.try_divide(F.col("mse"), F.col("__var"))).otherwise(
        F.when(F.col("mse") == 0, 1.0).otherwise(0.0))
    return out.select(
        *by, "n", "mae", "mse", F.sqrt("mse").alias("rmse"),
        F.when((spread == 0) & (F.col("mse") > 0), F.lit(float("inf")))
        .otherwise(F.try_divide(F.sqrt("mse"), spread)).alias("nrmse"), r2.alias("r2"),
        F.when(F.col("__var") > 0, 0.0).otherwise(1.0).alias("bsl_r2"))


def multi_target_metrics(df: DataFrame, pairs: dict[str, tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Metrics per target (name -> (actual, predicted)) and their mean as 'Aggregated' (V2)."""
    by = list(by)
    long = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(name).alias("target"), F.col(a).cast("double").alias("y"),
                 F.col(p).cast("double").alias("p")) for name, (a, p) in pairs.items()])))
    each = regression_metrics(long, "y", "p", [*by, "target"])
    mean = each.groupBy(*by).agg(
        F.sum("n").alias("n"), *[F.avg(m).alias(m) for m in REGRESSION])
    return each.unionByName(mean.withColumn("target", F.lit("Aggregated")))


def score_table(metrics: DataFrame, split: str, names: Sequence[str]) -> DataFrame:
    """Rows (score, value) with names such as ``mae_test`` (V7)."""
    long = metrics.select(split, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])))
    return long.select(F.concat_ws("_", "metric", split).alias("score"), "value")


def confusion(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Cell counts and their share of all rows (V6)."""
    cells = df.groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("__all"))
    joined = _match(cells, total, list(by)) if by else with_row(cells, total)
    return joined.withColumn("share", F.col("n") / F.col("__all")).drop("__all")


def classification_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = (),
                           positive=1) -> DataFrame:
    """Accuracy, precision, recall, F1 and the ROC-AUC of the hard labels (V3, V4).

    Binary scores are those of ``positive``; with more than two actual classes all scores are
    macro means. A zero denominator gives 0.
    """
    by = list(by)
    cells = df.groupBy(*by, F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(
        F.count("*").alias("n"))
    n, hit = F.col("n"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    # Every cell counts once for its actual class and once for its predicted class.
    sides = F.array(
        F.struct(F.col("a").alias("label"), n.alias("support"), zero.alias("said"), hit.alias("tp")),
        F.struct(F.col("p").alias("label"), zero.alias("support"), n.alias("said"), zero.alias("tp")))
    labels = cells.select(*by, F.inline(sides)).groupBy(*by, "label").agg(
        *[F.sum(c).alias(c) for c in ("support", "said", "tp")])
    totals = labels.groupBy(*by).agg(
        F.sum("support").alias("rows"), F.sum("tp").alias("hits"),
        F.count_if(F.col("support") > 0).alias("classes"))
    each = _match(labels, totals, by) if by else with_row(labels, totals)

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    tp, said, support, rows = (F.col(c) for c in ("tp", "said", "support", "rows"))
    precision, recall = ratio(tp, said), ratio(tp, support)
    each = each.withColumn("__p", precision).withColumn("__r", recall)
    each = each.withColumn("__f", ratio(2 * tp, said + support))
    negatives = rows - support
    specificity = F.try_divide(negatives - (said - tp), negatives)
    each = each.withColumn(
        "__auc", F.when(support > 0, (F.try_divide(tp, support) + specificity) / 2))
    binary = F.col("classes") <= 2
    used = F.when(binary, F.col("label") == F.lit(positive)).otherwise(F.lit(True))

    def mean(c: str) -> Column:
        return F.coalesce(F.avg(F.when(used, F.col(c))), F.lit(0.0))

    return each.groupBy(*by).agg(
        F.max("rows").alias("n"), (F.max("hits") / F.max("rows")).alias("accuracy"),
        mean("__p").alias("precision"), mean("__r").alias("recall"), mean("__f").alias("f1"),
        F.avg(F.when(used, F.col("__auc"))).alias("roc_auc"))


def score_auc(df: DataFrame, actual: str, score: str) -> DataFrame:
    """ROC-AUC of a continuous score (V4): share of (positive, negative) pairs in the right
    order, ties half. Scores are counted first and walked with running totals."""
    counts = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(actual) == 1).alias("pos"), F.count_if(F.col(actual) == 0).alias("neg"))
    walked = with_running_total(counts, [], ["s"], F.col("neg"), "neg_upto")
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)
    sums = walked.agg(F.sum(won).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(F.try_divide("won", F.col("p") * F.col("n")).alias("roc_auc"))


def uniform(key, seed) -> Column:
    """Reproducible number in [0, 1) per key, from 32 bits of its md5."""
    return F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("double") / 4294967296.0


def stratified_guess(df: DataFrame, actual: str, key, seed=42, name="guess") -> DataFrame:
    """Random labels drawn with the class shares (V5); null where no row has a class.

    Each class owns a stretch of [0, 1) as long as its share. The stretches are cut at as many
    even steps as there are classes, so a row finds its class by a join on the step, whatever the
    number of classes.
    """
    counts = stage(df.filter(F.col(actual).isNotNull()).groupBy(F.col(actual).alias("__c")).agg(
        F.count("*").alias("__n")), "classes")
    classes, total = counts.agg(F.count("*"), F.sum("__n")).first()
    steps = max(1, classes)
    walked = with_running_total(counts, [], ["__c"], F.col("__n"), "__upto")
    low, high = (F.col("__upto") - F.col("__n")) / F.lit(total), F.col("__upto") / F.lit(total)
    owned = walked.select("__c", low.alias("__low"), high.alias("__high"))
    owned = owned.withColumn("__step", F.explode(F.sequence(
        F.floor(F.col("__low") * steps), F.least(F.ceil(F.col("__high") * steps), F.lit(steps)) - 1)))
    drawn = df.withColumn("__u", uniform(key, seed)).withColumn("__s", F.floor(F.col("__u") * steps))
    met = (F.col("__s") == F.col("__step")) & (F.col("__u") >= F.col("__low")) & (F.col("__u") < F.col("__high"))
    return drawn.join(stage(owned, "stretches"), met, "left").select(*df.columns, F.col("__c").alias(name))


def baseline_auc(df: DataFrame, actual: str, key, seed=42) -> DataFrame:
    guessed = stratified_guess(df, actual, key, seed)
    return classification_metrics(guessed, actual, "guess").select(
        F.col("roc_auc").alias("bsl_roc_auc"))
