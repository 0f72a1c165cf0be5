"""Classification metrics, all from one count of (actual, predicted) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.functions.numeric import round4


def pair_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows per pair; at most classes x classes rows, combined before the shuffle."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def outcomes(pairs: DataFrame, classes: str = "actual") -> DataFrame:
    """TP, FP, TN, FN per class, for classes that occur as actual label or in either column."""
    same = F.col("actual").eqNullSafe(F.col("predicted"))
    sides = F.array(
        F.struct(
            F.col("actual").alias("label"),
            F.col("n").alias("as_actual"),
            F.lit(0).cast("bigint").alias("as_predicted"),
            F.when(same, F.col("n")).otherwise(0).alias("tp"),
        ),
        F.struct(
            F.col("predicted").alias("label"),
            F.lit(0).cast("bigint").alias("as_actual"),
            F.col("n").alias("as_predicted"),
            F.lit(0).cast("bigint").alias("tp"),
        ),
    )
    per_class = (
        pairs.select(F.inline(sides))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("as_actual", "as_predicted", "tp")])
    )
    # one row per class
    total = F.sum("as_actual").over(Window.partitionBy())
    counted = per_class.withColumn("_total", total)
    if classes == "actual":
        counted = counted.filter(F.col("as_actual") > 0)
    return counted.select(
        "label",
        "tp",
        (F.col("as_predicted") - F.col("tp")).alias("fp"),
        (F.col("_total") - F.col("as_actual") - F.col("as_predicted") + F.col("tp")).alias("tn"),
        (F.col("as_actual") - F.col("tp")).alias("fn"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def recall(rounded: bool = True) -> Column:
    value = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return round4(value) if rounded else value


def precision(rounded: bool = True) -> Column:
    value = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return round4(value) if rounded else value


def f1(p: Column, r: Column, rounded: bool = True) -> Column:
    """From precision and recall as given, which may already be rounded."""
    value = F.when(p + r == 0, F.lit(0.0)).otherwise(2.0 * (p * r) / (p + r))
    return round4(value) if rounded else value


def accuracy(pairs: DataFrame, rounded: bool = True) -> DataFrame:
    """Share of equal pairs; null for an empty input."""
    same = F.col("actual").eqNullSafe(F.col("predicted"))
    value = F.sum(F.when(same, F.col("n")).otherwise(0)) / F.sum("n")
    return pairs.agg((round4(value) if rounded else value).alias("accuracy"))


def class_scores(pairs: DataFrame) -> DataFrame:
    """Rounded precision, recall and F1 per class that occurs as actual label."""
    rated = outcomes(pairs).select("label", precision().alias("precision"), recall().alias("recall"))
    return rated.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def one_class_summary(pairs: DataFrame, label: str) -> DataFrame:
    """One row for one class; a class that never occurs scores zero."""
    is_actual = F.col("actual").eqNullSafe(F.lit(label))
    is_predicted = F.col("predicted").eqNullSafe(F.lit(label))
    same = F.col("actual").eqNullSafe(F.col("predicted"))

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    counted = pairs.agg(
        rows(is_actual & is_predicted).alias("tp"),
        rows(~is_actual & is_predicted).alias("fp"),
        rows(is_actual & ~is_predicted).alias("fn"),
        round4(rows(same) / F.sum("n")).alias("accuracy"),
    )
    rated = counted.select(precision().alias("precision"), recall().alias("recall"), "accuracy")
    return rated.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def macro_scores(pairs: DataFrame) -> DataFrame:
    """Unweighted means of the rounded class scores, and the accuracy."""
    means = class_scores(pairs).agg(
        *[round4(F.avg(c)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    )
    return means.withColumn("accuracy", accuracy(pairs).scalar())


def class_accuracies(pairs: DataFrame) -> DataFrame:
    """Accuracy inside each actual class, rounded, and the plain mean over classes."""
    same = F.col("actual").eqNullSafe(F.col("predicted"))
    per_class = pairs.groupBy(F.col("actual").alias("label")).agg(
        round4(F.sum(F.when(same, F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy")
    )
    return per_class.withColumn("mean_accuracy", F.avg("accuracy").over(Window.partitionBy()))


def gold_scores(df: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """F1 of the labels against themselves for a fixed class list; an absent class scores zero."""
    listed = df.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    scores = class_scores(pair_counts(df, label, label)).select("label", "f1")
    return listed.join(scores, "label", "left").withColumn("f1", F.coalesce("f1", F.lit(0.0)))


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """Counts for every pair of classes that occur in either column, zeros included."""
    axis = outcomes(pairs, "either").select(F.col("label").alias("actual"))
    # the class list of each row is one array, so no table is joined with itself
    everyone = F.sort_array(F.collect_set("actual").over(Window.partitionBy()))
    listed = axis.withColumn("_axis", everyone)
    grid = listed.select("actual", F.explode("_axis").alias("predicted"))
    return grid.join(pairs, ["actual", "predicted"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def classification_report(pairs: DataFrame) -> DataFrame:
    """Unrounded precision, recall, F1 and support per class, with three summary rows."""
    p, r = precision(rounded=False), recall(rounded=False)
    per_class = outcomes(pairs, "either").select(
        F.col("label").cast("string").alias("label"),
        p.alias("precision"),
        r.alias("recall"),
        f1(p, r, rounded=False).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
        "tp",
    )
    share = F.col("support") / F.sum("support").over(Window.partitionBy())
    weighted = per_class.withColumn("share", share)
    hit = F.sum("tp") / F.sum("support")
    summary = weighted.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("label"), hit.alias("precision"), hit.alias("recall"),
                     hit.alias("f1"), F.sum("support").alias("support")),
            F.struct(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                     F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                     F.sum("support").alias("support")),
            F.struct(F.lit("weighted avg").alias("label"),
                     F.sum(F.col("precision") * F.col("share")).alias("precision"),
                     F.sum(F.col("recall") * F.col("share")).alias("recall"),
                     F.sum(F.col("f1") * F.col("share")).alias("f1"),
                     F.sum("support").alias("support")),
        ).alias("rows")
    )
    return per_class.drop("tp").unionByName(summary.select(F.inline("rows")))


def balanced_accuracy(pairs: DataFrame) -> DataFrame:
    """Mean recall over the classes that occur as actual label."""
    return outcomes(pairs).agg(F.avg(recall(rounded=False)).alias("balanced_accuracy"))
