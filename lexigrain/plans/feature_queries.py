"""Feature extraction, split and sampling queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.functions import text
from lexigrain.operators import features, splits, vocab
from lexigrain.plans import sql
from lexigrain.plans.registry import query
from lexigrain.session import colocate, widen
from lexigrain.sources import read_table


def _texts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text", *columns)
    return colocate(docs, "doc_id")


def _scan(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Texts where they are read, for steps that stay inside a row."""
    return widen(read_table(spark, folder, "documents").select("doc_id", "text", *columns))


def _clean() -> Column:
    return text.clean_tokens(F.col("text"))


_TERMS = f"""{sql.DOC_TOKENS},
terms AS (SELECT doc_id, token AS term, CAST(count(*) AS BIGINT) AS n FROM tok GROUP BY ALL),
lens AS (SELECT doc_id, CAST(len(toks) AS BIGINT) AS doc_len FROM cleaned),
tf AS (SELECT doc_id, term, n, doc_len, n / doc_len AS tf FROM terms JOIN lens USING (doc_id)),
st AS (SELECT term, CAST(sum(n) AS BIGINT) AS cf, CAST(count(*) AS BIGINT) AS df, sum(tf) AS tf_sum
       FROM tf GROUP BY term),
nd AS (SELECT count(*) AS nd FROM documents)"""


@query(
    f"""WITH {sql.DOC_TOKENS},
        c AS (SELECT lang, token, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC,
                     min(doc_id * 16777216 + pos)) AS rk FROM tok GROUP BY lang, token),
        k AS (SELECT DISTINCT token FROM c WHERE rk <= 50),
        f AS (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS t, count(*) AS n
              FROM tok WHERE token IN (SELECT token FROM k) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(t, '') AS tokens, CAST(coalesce(n, 0) AS BIGINT) AS n
        FROM documents d LEFT JOIN f USING (doc_id)"""
)
def e01_filter_tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = _scan(spark, folder, "lang")
    top = vocab.top_tokens(docs, "lang", _clean(), 50)
    kept = features.filter_tokens(docs, _clean(), top)
    return kept.select(
        "doc_id", text.join_tokens(F.col("tokens")).alias("tokens"),
        text.token_count(F.col("tokens")).alias("n"),
    )


@query(
    f"""WITH {_TERMS} SELECT term, cf, df, round(ln(nd / (1 + cf)), 6) AS idf_collection,
               round(ln(nd / (1 + df)), 6) AS idf_document FROM st, nd"""
)
def e02_inverse_frequency(spark: SparkSession, folder: str) -> DataFrame:
    docs = _scan(spark, folder)
    stats = features.term_statistics(features.doc_terms(docs, _clean()))
    n_docs = features.document_count(docs)
    return stats.select(
        "term",
        "cf",
        "df",
        F.round(features.inverse_frequency(n_docs, F.col("cf")), 6).alias("idf_collection"),
        F.round(features.inverse_frequency(n_docs, F.col("df")), 6).alias("idf_document"),
    )


@query(f"WITH {_TERMS} SELECT doc_id, term, n, doc_len, round(tf, 9) AS tf FROM tf")
def e03_term_frequency(spark: SparkSession, folder: str) -> DataFrame:
    terms = features.doc_terms(_scan(spark, folder), _clean())
    return features.term_frequencies(terms).withColumn("tf", F.round("tf", 9))


def _tfidf(spark: SparkSession, folder: str, weighting: str, idf: str) -> DataFrame:
    weights = features.tfidf(_texts(spark, folder), _clean(), weighting, idf)
    return weights.withColumn("weight", F.round("weight", 6))


@query(
    f"""WITH {_TERMS} SELECT doc_id, term, round(tf * ln(nd / (1 + cf)), 6) AS weight
        FROM tf JOIN st USING (term), nd"""
)
def e04_tfidf_collection(spark: SparkSession, folder: str) -> DataFrame:
    return _tfidf(spark, folder, "tfidf", "collection")


@query(
    f"""WITH {_TERMS} SELECT doc_id, term, round(tf * ln(nd / (1 + df)), 6) AS weight
        FROM tf JOIN st USING (term), nd"""
)
def e04_tfidf_document(spark: SparkSession, folder: str) -> DataFrame:
    return _tfidf(spark, folder, "tfidf", "document")


@query(f"WITH {_TERMS} SELECT doc_id, term, round(tf, 6) AS weight FROM tf")
def e04_tf_only(spark: SparkSession, folder: str) -> DataFrame:
    return _tfidf(spark, folder, "tf", "collection")


def _best(expression: str) -> str:
    return f"""SELECT term, total, CAST(row_number() OVER (ORDER BY total DESC, term) - 1 AS INTEGER) AS feature_pos
        FROM (SELECT term, round({expression}, 9) AS total FROM st, nd)
        QUALIFY row_number() OVER (ORDER BY total DESC, term) <= 150"""


def _features(spark: SparkSession, folder: str, weighting: str, idf: str) -> DataFrame:
    fitted = features.fit_features(_texts(spark, folder), _clean(), 150, weighting, idf)
    return fitted.table.drop("idf")


@query(f"WITH {_TERMS} {_best('tf_sum')}")
def d15_top_features_tf(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "tf", "collection")


@query(f"WITH {_TERMS} {_best('tf_sum * ln(nd / (1 + cf))')}")
def d15_top_features_collection(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "tfidf", "collection")


@query(f"WITH {_TERMS} {_best('tf_sum * ln(nd / (1 + df))')}")
def d15_top_features_document(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "tfidf", "document")


# Fitted on the train part of a seeded split, applied to the rest.
_FITTED = f"""{sql.DOC_TOKENS},
sp AS (SELECT doc_id, {sql.uniform('doc_id', 42)} < 0.8 AS train FROM documents),
terms AS (SELECT doc_id, token AS term, count(*) AS n FROM tok GROUP BY ALL),
lens AS (SELECT doc_id, len(toks) AS doc_len FROM cleaned),
tf AS (SELECT doc_id, term, n, n / doc_len AS tf, train
       FROM terms JOIN lens USING (doc_id) JOIN sp USING (doc_id)),
st AS (SELECT term, count(*) AS df, sum(tf) AS tf_sum FROM tf WHERE train GROUP BY term),
nd AS (SELECT count(*) AS nd FROM sp WHERE train),
best AS (SELECT term, ln(nd / (1 + df)) AS idf,
                row_number() OVER (ORDER BY round(tf_sum * ln(nd / (1 + df)), 9) DESC, term) - 1 AS feature_pos
         FROM st, nd QUALIFY feature_pos < 150)"""


def _fit_and_test(spark: SparkSession, folder: str) -> tuple[features.TermFeatures, DataFrame]:
    docs = splits.random_split(_texts(spark, folder), "doc_id", 42)
    train = docs.filter(F.col("split") == "train")
    test = docs.filter(F.col("split") == "test")
    return features.fit_features(train, _clean(), 150, "tfidf", "document"), test


@query(
    f"""WITH {_FITTED} SELECT doc_id, CAST(feature_pos AS INTEGER) AS feature_pos,
               round(tf * idf, 6) AS weight FROM tf JOIN best USING (term) WHERE NOT train"""
)
def e05_fit_train_apply_test(spark: SparkSession, folder: str) -> DataFrame:
    fitted, test = _fit_and_test(spark, folder)
    return fitted.weights(test, _clean()).withColumn("weight", F.round("weight", 6))


@query(
    f"""WITH {_FITTED},
        w AS (SELECT doc_id, feature_pos, tf * idf AS weight FROM tf JOIN best USING (term) WHERE NOT train),
        g AS (SELECT doc_id, f.i AS feature_pos FROM sp, (SELECT unnest(range(150)) AS i) f WHERE NOT train)
        SELECT doc_id, CAST(feature_pos AS INTEGER) AS feature_pos, round(coalesce(weight, 0), 6) AS weight
        FROM g LEFT JOIN w USING (doc_id, feature_pos)"""
)
def e06_feature_vectors(spark: SparkSession, folder: str) -> DataFrame:
    fitted, test = _fit_and_test(spark, folder)
    dense = fitted.vectors(test, _clean(), 150)
    rows = dense.select("doc_id", F.posexplode("features").alias("feature_pos", "weight"))
    return rows.withColumn("weight", F.round("weight", 6))


def _library(source: str) -> str:
    return f"""tok AS (SELECT doc_id, unnest({source}) AS term FROM documents),
        terms AS (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY ALL),
        st AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
               FROM terms GROUP BY term),
        raw AS (SELECT doc_id, term, n * idf AS w FROM terms JOIN st USING (term))
        SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw"""


@query(f"WITH {_library(sql.long_words('text'))}")
def e07_normalised_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    return features.normalised_tfidf(_texts(spark, folder)).withColumn(
        "weight", F.round("weight", 6)
    )


_NO_STOP = f"list_filter({sql.long_words('text')}, lambda x: x NOT IN {sql.STOP})"


@query(f"WITH {_library(_NO_STOP)}")
def e07_normalised_tfidf_no_stop_words(spark: SparkSession, folder: str) -> DataFrame:
    array = text.long_words(F.col("text"), text.ENGLISH_STOP_WORDS)
    return features.normalised_tfidf(_texts(spark, folder), array).withColumn(
        "weight", F.round("weight", 6)
    )


@query(
    f"""SELECT doc_id, term, CAST(count(*) AS BIGINT) AS n
        FROM (SELECT doc_id, unnest({_NO_STOP}) AS term FROM documents) GROUP BY doc_id, term"""
)
def e08_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    array = text.long_words(F.col("text"), text.ENGLISH_STOP_WORDS)
    return features.doc_terms(_scan(spark, folder), array).drop("doc_len")


def _ids(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", *columns)


@query(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents)
       SELECT doc_id, CASE WHEN rn <= floor(n * 0.6::DOUBLE) THEN 'train'
              WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r"""
)
def f01_positional_split(spark: SparkSession, folder: str) -> DataFrame:
    return splits.positional_split(_ids(spark, folder), "doc_id")


@query(
    f"""SELECT doc_id, CASE WHEN {sql.uniform('doc_id', 42)} < 0.8 THEN 'train' ELSE 'test' END AS split
        FROM documents"""
)
def f02_random_split(spark: SparkSession, folder: str) -> DataFrame:
    return splits.random_split(_ids(spark, folder), "doc_id", 42)


_SHUFFLED = f"""r AS (SELECT doc_id, row_number() OVER (ORDER BY {sql.uniform('doc_id', 42)}, doc_id) AS rn,
                             count(*) OVER () AS n FROM documents)"""


@query(
    f"""WITH {_SHUFFLED} SELECT doc_id, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split
        FROM r"""
)
def f02_exact_random_split(spark: SparkSession, folder: str) -> DataFrame:
    return splits.exact_random_split(_ids(spark, folder), "doc_id", 42)


@query(f"WITH {_SHUFFLED} SELECT doc_id, CAST(rn AS BIGINT) AS place FROM r")
def f03_seeded_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    return splits.shuffled(_ids(spark, folder), "doc_id", 42)


_PER_TREE = """r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents),
               t AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS tree_id)"""


@query(
    f"""WITH {_PER_TREE},
        d AS (SELECT tree_id, floor({sql.uniform("tree_id || ':' || rn", 42)} * n) + 1 AS rn FROM r, t)
        SELECT tree_id, doc_id, CAST(count(*) AS BIGINT) AS w FROM d JOIN r USING (rn) GROUP BY ALL"""
)
def f04_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    return splits.bootstrap(_ids(spark, folder), "doc_id", trees=3, seed=42)


def _poisson_sql(u: str) -> str:
    total, term, parts = 0.0, 2.718281828459045**-1, []
    for k in range(12):
        total += term
        term /= k + 1
        parts.append(f"CAST({u} >= {total!r}::DOUBLE AS BIGINT)")
    return " + ".join(parts)


@query(
    f"""WITH {_PER_TREE},
        d AS (SELECT tree_id, doc_id, {sql.uniform("tree_id || ':' || doc_id", 42)} AS u FROM r, t),
        w AS (SELECT tree_id, doc_id, CAST({_poisson_sql('u')} AS BIGINT) AS w FROM d)
        SELECT * FROM w WHERE w > 0"""
)
def f04_poisson_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    return splits.poisson_bootstrap(_ids(spark, folder), "doc_id", trees=3, seed=42)


RANDOM_LABELS_SQL = f"""k AS (SELECT lang AS predicted, row_number() OVER (ORDER BY lang) - 1 AS code,
                                     count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM documents)),
    guess AS (SELECT doc_id, lang, predicted FROM documents JOIN k
              ON code = floor({sql.uniform('doc_id', 42)} * n))"""


@query(f"WITH {RANDOM_LABELS_SQL} SELECT * FROM guess")
def f05_random_labels(spark: SparkSession, folder: str) -> DataFrame:
    return splits.random_labels(_ids(spark, folder, "lang"), "doc_id", "lang", 42)


@query(
    """SELECT doc_id, lang, CAST(ntile(5) OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS INTEGER) AS fold
       FROM documents"""
)
def f06_stratified_folds(spark: SparkSession, folder: str) -> DataFrame:
    return splits.stratified_folds(_ids(spark, folder, "lang"), "doc_id", "lang")


@query(
    "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 32 AS BIGINT) AS batch FROM documents"
)
def f07_batches(spark: SparkSession, folder: str) -> DataFrame:
    return splits.batches(_ids(spark, folder), "doc_id", 32)
