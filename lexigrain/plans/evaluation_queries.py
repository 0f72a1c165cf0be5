"""Metric queries on seeded random predictions of the language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.operators import evaluate, splits
from lexigrain.plans.feature_queries import RANDOM_LABELS_SQL
from lexigrain.plans.registry import query
from lexigrain.plans.sql import round4
from lexigrain.sources import read_table


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "lang")
    guessed = splits.random_labels(docs, "doc_id", "lang", 42)
    return evaluate.pair_counts(guessed, "lang", "predicted")


_BASE = f"""{RANDOM_LABELS_SQL},
    o AS (SELECT label, CAST(count(*) FILTER (lang = label AND predicted = label) AS BIGINT) AS tp,
                 CAST(count(*) FILTER (lang <> label AND predicted = label) AS BIGINT) AS fp,
                 CAST(count(*) FILTER (lang <> label AND predicted <> label) AS BIGINT) AS tn,
                 CAST(count(*) FILTER (lang = label AND predicted <> label) AS BIGINT) AS fn
          FROM guess, (SELECT DISTINCT lang AS label FROM documents) GROUP BY label),
    pr AS (SELECT label, {round4('CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END')} AS p,
                  {round4('CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END')} AS r FROM o),
    s AS (SELECT label, p AS "precision", r AS recall,
                 {round4('CASE WHEN p + r = 0 THEN 0 ELSE 2 * (p * r) / (p + r) END')} AS f1 FROM pr),
    a AS (SELECT {round4('avg(CASE WHEN lang = predicted THEN 1.0::DOUBLE ELSE 0 END)')} AS accuracy FROM guess)"""


@query(f"WITH {_BASE} SELECT * FROM o")
def v01_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.outcomes(_pairs(spark, folder))


@query(f"WITH {_BASE} SELECT label, recall FROM s")
def v02_recall(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.outcomes(_pairs(spark, folder)).select(
        "label", evaluate.recall().alias("recall")
    )


@query(f"WITH {_BASE} SELECT label, \"precision\" FROM s")
def v03_precision(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.outcomes(_pairs(spark, folder)).select(
        "label", evaluate.precision().alias("precision")
    )


@query(f"WITH {_BASE} SELECT label, f1 FROM s")
def v04_f1(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.class_scores(_pairs(spark, folder)).select("label", "f1")


@query(f"WITH {_BASE} SELECT accuracy FROM a")
def v05_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.accuracy(_pairs(spark, folder))


@query(f"WITH {_BASE} SELECT \"precision\", recall, f1, accuracy FROM s, a WHERE label = 'de'")
def v06_one_class_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.one_class_summary(_pairs(spark, folder), "de")


@query(f"WITH {_BASE} SELECT label, \"precision\", recall, f1 FROM s")
def v07_class_scores(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.class_scores(_pairs(spark, folder))


@query(
    f"""WITH {_BASE}, m AS (SELECT {round4('avg("precision")')} AS macro_precision,
          {round4('avg(recall)')} AS macro_recall, {round4('avg(f1)')} AS macro_f1 FROM s)
        SELECT macro_precision, macro_recall, macro_f1, accuracy FROM m, a"""
)
def v08_macro_scores(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.macro_scores(_pairs(spark, folder))


@query(
    f"""WITH {RANDOM_LABELS_SQL},
          c AS (SELECT lang AS label,
                {round4('avg(CASE WHEN lang = predicted THEN 1.0::DOUBLE ELSE 0 END)')} AS accuracy
                FROM guess GROUP BY lang)
        SELECT label, accuracy, round(avg(accuracy) OVER (), 9) AS mean_accuracy FROM c"""
)
def v09_random_baseline(spark: SparkSession, folder: str) -> DataFrame:
    scores = evaluate.class_accuracies(_pairs(spark, folder))
    return scores.withColumn("mean_accuracy", F.round("mean_accuracy", 9))


@query(
    """SELECT label, CAST(CASE WHEN label IN (SELECT lang FROM documents) THEN 1 ELSE 0 END AS DOUBLE) AS f1
       FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) v(label)"""
)
def v10_gold_against_gold(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("lang")
    return evaluate.gold_scores(docs, "lang", ["de", "en", "es", "fr", "it"])


@query(
    f"""WITH {RANDOM_LABELS_SQL}, x AS (SELECT DISTINCT lang AS c FROM documents),
          n AS (SELECT lang, predicted, count(*) AS n FROM guess GROUP BY ALL)
        SELECT a.c AS actual, p.c AS predicted, CAST(coalesce(n, 0) AS BIGINT) AS n
        FROM x a CROSS JOIN x p LEFT JOIN n ON lang = a.c AND n.predicted = p.c"""
)
def v11_confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion_matrix(_pairs(spark, folder))


@query(
    f"""WITH {_BASE},
          u AS (SELECT label, tp, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p,
                       CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r,
                       2 * tp / (2 * tp + fp + fn) AS f, tp + fn AS s FROM o),
          z AS (SELECT label, p, r, f, s FROM u
            UNION ALL SELECT 'accuracy', sum(tp) / sum(s), sum(tp) / sum(s), sum(tp) / sum(s), sum(s) FROM u
            UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM u
            UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM u)
        SELECT label, round(p, 9) AS "precision", round(r, 9) AS recall, round(f, 9) AS f1,
               CAST(s AS BIGINT) AS support FROM z"""
)
def v12_classification_report(spark: SparkSession, folder: str) -> DataFrame:
    report = evaluate.classification_report(_pairs(spark, folder))
    for c in ("precision", "recall", "f1"):
        report = report.withColumn(c, F.round(c, 9))
    return report


@query(f"WITH {_BASE} SELECT round(avg(tp / (tp + fn)), 9) AS balanced_accuracy FROM o")
def v13_balanced_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.balanced_accuracy(_pairs(spark, folder)).select(
        F.round("balanced_accuracy", 9).alias("balanced_accuracy")
    )


@query(
    f"""WITH {RANDOM_LABELS_SQL}
        SELECT round(avg(CASE WHEN lang = predicted THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM guess"""
)
def v14_plain_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.accuracy(_pairs(spark, folder), rounded=False).select(
        F.round("accuracy", 9).alias("accuracy")
    )
