"""The baseline as stages of one ``pyspark.ml`` pipeline that is saved, loaded and scores new texts.

A fitted stage holds tables of bounded size, stored as Parquet beside its parameters. Applying one
works inside the row: nothing is shuffled, rows keep their other columns, repeated ids do not meet.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasFeaturesCol,
    HasInputCol,
    HasLabelCol,
    HasOutputCol,
    HasPredictionCol,
    HasSeed,
)
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.functions import text
from lexigrain.functions.fixed_values import BASELINE, ENGLISH_STOP_WORDS
from lexigrain.operators import features, labels, models, splits, subtrees, trees, vocab
from lexigrain.session import persisted


class TableModel(Model, MLWritable, MLReadable):
    """A fitted stage: parameters and named tables."""

    #: Names of the tables that a saved model has.
    TABLES: tuple[str, ...] = ()

    def __init__(self, tables: Mapping[str, DataFrame] | None = None):
        super().__init__()
        self.tables = dict(tables or {})

    def write(self) -> MLWriter:
        return TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return TableReader(cls)


class TableWriter(MLWriter):
    def __init__(self, model: TableModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        for name in self.model.TABLES:
            self.model.tables[name].write.parquet(f"{path}/{name}")


class TableReader(MLReader):
    def __init__(self, cls: type[TableModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TableModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        tables = {name: self.sparkSession.read.parquet(f"{path}/{name}") for name in self.cls.TABLES}
        model = self.cls(tables)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _HasIdCol(Params):
    idCol = Param(Params._dummy(), "idCol", "column that names a row when fitting", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(idCol="doc_id")


def _tokens_of(column: str):
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


class CleanTokens(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Cleaned tokens of a text; none for a null or empty one."""

    stopWords = Param(Params._dummy(), "stopWords", "words to drop", TypeConverters.toListString)

    def __init__(self, **settings: object):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="tokens", stopWords=list(ENGLISH_STOP_WORDS))
        self._set(**settings)

    def _transform(self, df: DataFrame) -> DataFrame:
        found = text.clean_tokens(F.col(self.getInputCol()), self.getOrDefault(self.stopWords))
        return df.withColumn(self.getOutputCol(), F.coalesce(found, F.array().cast("array<string>")))


class _FilterParams(HasInputCol, HasOutputCol, HasLabelCol, _HasIdCol):
    topTokens = Param(Params._dummy(), "topTokens", "tokens kept for each label", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(inputCol="tokens", outputCol="kept", topTokens=BASELINE["top_tokens"])


class TopTokenFilter(Estimator, _FilterParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns each label's most frequent tokens; the model keeps tokens that any label has.

    Labels times ``topTokens`` may reach ``features.LISTED_TOKENS``; more are refused when fitting.
    """

    def __init__(self, **settings: object):
        super().__init__()
        self._set(**settings)

    def _fit(self, df: DataFrame) -> TopTokenFilterModel:
        n, tokens = self.getOrDefault(self.topTokens), F.col(self.getInputCol())
        top = vocab.top_tokens(df, self.getLabelCol(), tokens, n, self.getOrDefault(self.idCol))
        kept = persisted(top.select("token").distinct(), "kept")
        if kept.count() > features.LISTED_TOKENS:
            raise ValueError(f"more than {features.LISTED_TOKENS} tokens to keep; lower topTokens")
        return self._copyValues(TopTokenFilterModel({"kept": kept}))


class TopTokenFilterModel(TableModel, _FilterParams):
    TABLES = ("kept",)

    def _transform(self, df: DataFrame) -> DataFrame:
        kept = [r["token"] for r in self.tables["kept"].collect()]
        found = F.filter(_tokens_of(self.getInputCol()), lambda x: x.isin(kept))
        return df.withColumn(self.getOutputCol(), found)


class _TermParams(HasInputCol, HasOutputCol, _HasIdCol):
    nFeatures = Param(Params._dummy(), "nFeatures", "terms with the largest column sum", TypeConverters.toInt)
    weighting = Param(Params._dummy(), "weighting", "tf or tfidf", TypeConverters.toString)
    idf = Param(Params._dummy(), "idf", "frequency that the IDF counts: collection or document", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(
            inputCol="kept", outputCol="features", nFeatures=BASELINE["top_features"], weighting="tf", idf="collection"
        )


class TermTable(Estimator, _TermParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the terms with the largest column sum; the model gives their weights as a vector.

    Training texts without any token are refused, as there is no term to choose.
    """

    def __init__(self, **settings: object):
        super().__init__()
        self._set(**settings)

    def _fit(self, df: DataFrame) -> TermTableModel:
        settings = (self.getOrDefault(p) for p in (self.nFeatures, self.weighting, self.idf, self.idCol))
        fitted = features.fit_features(df, F.col(self.getInputCol()), *settings)
        if fitted.table.isEmpty():
            raise ValueError("the training texts have no tokens")
        return self._copyValues(TermTableModel({"terms": fitted.table}))


class TermTableModel(TableModel, _TermParams):
    """Term weights by term number, zeros for a text that has none of the terms."""

    TABLES = ("terms",)

    def _transform(self, df: DataFrame) -> DataFrame:
        # as many rows as features were asked for
        terms = self.tables["terms"].orderBy("feature_pos").collect()
        counter = CountVectorizerModel.from_vocabulary(
            [t["term"] for t in terms], inputCol="_tokens", outputCol="_counts", minTF=0.0
        )
        weighted = self.getOrDefault(self.weighting) == "tfidf"
        factors = F.array(*(F.lit(t["idf"] if weighted else 1.0) for t in terms))
        counted = counter.transform(df.withColumn("_tokens", _tokens_of(self.getInputCol())))
        length = F.greatest(F.size("_tokens"), F.lit(1))
        weights = F.zip_with(vector_to_array("_counts"), factors, lambda n, factor: n / length * factor)
        return counted.withColumn(self.getOutputCol(), array_to_vector(weights)).drop("_tokens", "_counts")


class Reduction(Estimator, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns principal components, clipped to rows and features; they are added as ``components``."""

    components = Param(Params._dummy(), "components", "components wanted", TypeConverters.toInt)

    def __init__(self, **settings: object):
        super().__init__()
        self._setDefault(inputCol="features", components=BASELINE["components"])
        self._set(**settings)

    def _fit(self, df: DataFrame) -> PipelineModel:
        name = self.getInputCol()
        first = df.select(name).first()
        if first is None:
            raise ValueError("no training rows")
        k = self.getOrDefault(self.components)
        return models.reduction(k, df.count(), first[0].size, name).fit(df)


class _ForestParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed, _HasIdCol):
    nTrees = Param(Params._dummy(), "nTrees", "bootstrapped trees; 0 is one tree on all rows", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "deepest level", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(
            featuresCol="components", predictionCol="predicted", seed=BASELINE["seed"],
            nTrees=BASELINE["trees"], maxDepth=BASELINE["max_depth"],
        )


class NativeForest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the entropy-based trees of ``operators.trees``; rows without a label are left out."""

    def __init__(self, **settings: object):
        super().__init__()
        self._set(**settings)

    def _fit(self, df: DataFrame) -> NativeForestModel:
        label, key = self.getLabelCol(), self.getOrDefault(self.idCol)
        values = vector_to_array(self.getFeaturesCol()).alias("features")
        labelled = df.filter(F.col(label).isNotNull()).select(F.col(key).alias("row_id"), values, label)
        labelled = persisted(labelled, "labelled")
        categories = labels.category_codes(labelled, label, "_code")
        coded = labels.encode(labelled, categories, label, "_code")
        rows = persisted(coded.select("row_id", "features", F.col("_code").alias("label")), "rows")
        first = rows.first()
        if first is None:
            raise ValueError("no labelled training rows")
        sizes = (len(first["features"]), categories.count(), self.getOrDefault(self.maxDepth))
        n_trees = self.getOrDefault(self.nTrees)
        if n_trees:
            drawn = splits.bootstrap(rows.select("row_id"), "row_id", n_trees, self.getSeed())
            nodes = trees.forest(rows, persisted(drawn, "drawn"), *sizes)
        else:
            nodes = trees.grow(rows, *sizes)
        classes = categories.select(F.col("_code").alias("code"), F.col(label).alias("name"))
        return self._copyValues(NativeForestModel({"nodes": nodes, "classes": classes}))


class NativeForestModel(TableModel, _ForestParams):
    """The label that most trees vote for, the first in order of equal ones.

    Forests of at most ``subtrees.SHARED_NODES`` nodes descend inside the tasks that read the rows;
    a larger one is joined by ``idCol``, which then has to be unique.
    """

    TABLES = ("nodes", "classes")

    def _transform(self, df: DataFrame) -> DataFrame:
        names = [r["name"] for r in self.tables["classes"].orderBy("code").collect()]
        kind = self.tables["classes"].schema["name"].dataType
        named = F.array(*(F.lit(n).cast(kind) for n in names))
        values = vector_to_array(self.getFeaturesCol())
        code = F.element_at(named, F.col("_code") + 1)
        return self._coded(df, values).withColumn(self.getPredictionCol(), code).drop("_code")

    def _coded(self, df: DataFrame, values) -> DataFrame:
        nodes, depth = self.tables["nodes"], self.getOrDefault(self.maxDepth)
        if nodes.count() > subtrees.SHARED_NODES:
            key = self.getOrDefault(self.idCol)
            rows = df.select(F.col(key).alias("row_id"), values.alias("features"))
            voted = trees.forest_votes(rows, nodes, depth)
            return df.join(voted.select(F.col("row_id").alias(key), F.col("predicted").alias("_code")), key)
        shared = df.sparkSession.sparkContext.broadcast(subtrees.Forest.collected(nodes))

        @F.pandas_udf("int")
        def voted(batch: pd.Series) -> pd.Series:
            forest, out = shared.value, []
            classes = np.arange(int(forest.best.max()) + 1)
            for at in range(0, len(batch), 1_000):
                votes = forest.votes(np.array(batch.iloc[at : at + 1_000].tolist(), float), [depth])[:, 0]
                out.extend((votes[..., None] == classes).sum(axis=1).argmax(axis=1))
            return pd.Series(out, dtype="int32")

        return df.withColumn("_code", voted(values))


def baseline_pipeline(
    label: str,
    doc_id: str = "doc_id",
    top_tokens: int = BASELINE["top_tokens"],
    top_features: int = BASELINE["top_features"],
    components: int = BASELINE["components"],
    max_depth: int = BASELINE["max_depth"],
    n_trees: int = BASELINE["trees"],
    seed: int = BASELINE["seed"],
) -> Pipeline:
    """Cleaning, token filter, feature table, components and trees over a column ``text``."""
    return Pipeline(
        stages=[
            CleanTokens(),
            TopTokenFilter(labelCol=label, idCol=doc_id, topTokens=top_tokens),
            TermTable(idCol=doc_id, nFeatures=top_features),
            Reduction(components=components),
            NativeForest(labelCol=label, idCol=doc_id, maxDepth=max_depth, nTrees=n_trees, seed=seed),
        ]
    )


def fit_written(pipeline: Pipeline, train: DataFrame, *keep: str) -> PipelineModel:
    """What ``pipeline.fit`` gives, with each stage's columns written once for the next one.

    Each stage reads the columns that the one before has added and those in ``keep`` (id, label).
    So a text is tokenised once however often the stages read their input.
    """
    fitted, rows = [], train
    for stage in pipeline.getStages():
        model = stage.fit(rows) if isinstance(stage, Estimator) else stage
        fitted.append(model)
        if stage is not pipeline.getStages()[-1]:
            made = model.transform(rows)
            added = [c for c in made.columns if c not in rows.columns]
            rows = persisted(made.select(*keep, *added), "stage")
    return PipelineModel(fitted)
