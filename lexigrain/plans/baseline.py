"""The whole baseline run: texts and labels in, metrics of a tree and a forest out."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.functions import text
from lexigrain.functions.fixed_values import BASELINE
from lexigrain.operators import evaluate, features, labels, models, saved_stages, splits, trees, vocab
from lexigrain.plans.registry import query
from lexigrain.session import colocate, persisted, shared_path
from lexigrain.sources import load_model, read_table, save_model


def baseline(
    train: DataFrame,
    test: DataFrame,
    label: str,
    doc_id: str = "doc_id",
    top_tokens: int = BASELINE["top_tokens"],
    top_features: int = BASELINE["top_features"],
    components: int = BASELINE["components"],
    max_depth: int = BASELINE["max_depth"],
    n_trees: int = BASELINE["trees"],
    seed: int = BASELINE["seed"],
) -> DataFrame:
    """Macro scores per model. Everything is fitted on ``train`` and applied to ``test``."""
    categories = labels.category_codes(train, label)
    n_classes = categories.count()
    kept = None
    fitted = reduced = None
    rows = {}
    for name, part in (("train", train), ("test", test)):
        cleaned = part.select(doc_id, label, text.clean_tokens(F.col("text")).alias("tokens"))
        cleaned = persisted(colocate(cleaned, doc_id), name)
        if kept is None:
            kept = persisted(vocab.top_tokens(cleaned, label, F.col("tokens"), top_tokens), "top")
        tokens = features.filter_tokens(cleaned, F.col("tokens"), kept)
        filtered = persisted(cleaned.select(doc_id, label).join(tokens, doc_id), name)
        if fitted is None:
            fitted = features.fit_features(filtered, F.col("tokens"), top_features)
            width = fitted.table.count()
        dense = fitted.vectors(filtered, F.col("tokens"), width)
        vectors = features.as_vectors(filtered.select(doc_id, label).join(dense, doc_id))
        if reduced is None:
            vectors = persisted(vectors, "vectors")
            reduced = models.reduction(components, vectors.count(), width).fit(vectors)
        projected = labels.encode(reduced.transform(vectors), categories, label)
        rows[name] = projected.select(
            F.col(doc_id).alias("row_id"),
            vector_to_array("components").alias("features"),
            F.col("code").alias("label"),
        )
    n_components = max(1, min(components, width))
    sizes = (n_components, n_classes, max_depth)
    known = persisted(rows["train"], "train")
    asked = persisted(rows["test"], "test")
    tree = trees.grow(known, *sizes)
    drawn = persisted(splits.bootstrap(known.select("row_id"), "row_id", n_trees, seed), "drawn")
    forest = trees.forest(known, drawn, *sizes)
    results = []
    for name, nodes in (("decision tree", tree), ("random forest", forest)):
        judged = trees.forest_votes(asked, nodes, max_depth, "label")
        pairs = evaluate.pair_counts(judged, "label", "predicted")
        results.append(evaluate.macro_scores(pairs).withColumn("model", F.lit(name)))
    return results[0].unionByName(results[1])


#: Components of the pipeline that is stored.
SAVED_COMPONENTS = 50


def _rated_texts(spark: SparkSession, folder: str) -> DataFrame:
    rated = read_table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = read_table(spark, folder, "documents").select("doc_id", "text").join(rated, "doc_id")
    return splits.random_split(docs, "doc_id", 42)


@query()
def a04_saved_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of unseen documents by the whole pipeline, after it was stored and loaded."""
    parts = _rated_texts(spark, folder)
    pipeline = saved_stages.baseline_pipeline("label", components=SAVED_COMPONENTS)
    fitted = saved_stages.fit_written(pipeline, parts.filter("split = 'train'"), "doc_id", "label")
    path = shared_path(spark, "pipeline")
    save_model(fitted, path)
    return load_model(path).transform(parts.filter("split = 'test'")).select("doc_id", "label", "predicted")


@query()
def l1_baseline_run(spark: SparkSession, folder: str) -> DataFrame:
    """The run on all rated documents, with the settings of the baseline."""
    parts = _rated_texts(spark, folder)
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    return baseline(train, test, "label")
