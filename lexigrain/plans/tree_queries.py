"""Tree and forest queries on embedding features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain import sources
from lexigrain.functions.numeric import entropy
from lexigrain.operators import evaluate, splits, stats, trees
from lexigrain.plans.registry import query
from lexigrain.plans.sql import round4, uniform
from lexigrain.session import persisted, shared_path
from lexigrain.sources import read_table

N_FEATURES = 64
N_CLASSES = 10
#: Depth that SQL checks follow, and the depth of whole trees.
CHECKED_DEPTH, WHOLE_DEPTH = 4, 20


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """All dimensions as features."""
    vectors = read_table(spark, folder, "embeddings")
    return vectors.select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        "label",
    )


def _root(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder).select(
        F.lit(0).alias("tree_id"), F.lit(0).cast("bigint").alias("node_id"), "row_id", "features",
        "label", F.lit(1).cast("bigint").alias("w"),
    )
    return trees.with_ranges(rows, N_FEATURES)


_ENTROPY = "-sum(n / s * log2(n / s))"


@query(
    f"""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL),
             t AS (SELECT *, sum(n) OVER (PARTITION BY source) AS s FROM c)
        SELECT source, round({_ENTROPY}, 9) AS entropy FROM t GROUP BY source"""
)
def t01_entropy(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("source", "lang")
    langs = stats.class_values(docs, "lang")
    code = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1
    counts = trees.class_counts("code", "1", len(langs))
    per_source = docs.withColumn("code", code).groupBy("source").agg(counts.alias("counts"))
    return per_source.select("source", F.round(entropy("counts"), 9).alias("entropy"))


@query(
    """WITH c AS (SELECT source, lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL)
       SELECT source, lang, n, round(n / sum(n) OVER (PARTITION BY source), 9) AS share FROM c"""
)
def t02_present_class_shares(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("source", "lang")
    shares = trees.present_class_shares(docs, "source", "lang")
    return shares.withColumn("share", F.round("share", 9))


@query(
    """SELECT r.i AS label, round(count(*) FILTER (label = r.i) / count(*), 9) AS share
       FROM embeddings, (SELECT CAST(unnest(range(10)) AS INTEGER) AS i) r GROUP BY r.i"""
)
def t02_full_class_shares(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    counts = rows.agg(trees.class_counts("label", "1", N_CLASSES).alias("counts"))
    shares = counts.select(F.posexplode(trees.class_shares("counts")).alias("label", "share"))
    return shares.withColumn("share", F.round("share", 9))


def tree_sql(depth: int, sample: str) -> str:
    """Definition of exact tree growth in SQL, level by level, for checking.

    ``sample`` gives (tree_id, row_id, label, f, v) with rows repeated as often as they were drawn.
    """
    parts = [
        f"r0 AS ({sample})",
        f"""n0 AS (SELECT tree_id, CAST(0 AS BIGINT) AS node_id, count(*) // {N_FEATURES} AS n,
                         count(DISTINCT label) AS classes FROM r0 GROUP BY ALL)""",
    ]
    for d in range(depth):
        parts.append(
            f"""x{d} AS (SELECT r.* FROM r{d} r JOIN n{d} USING (tree_id, node_id) WHERE classes > 1),
            q{d} AS (SELECT tree_id, node_id, f, unnest([1, 2, 3]) AS q,
                            unnest(quantile_cont(v, [0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE])) AS t
                     FROM x{d} GROUP BY tree_id, node_id, f),
            k{d} AS (SELECT tree_id, node_id, f, q, t, v < t AS low, label, count(*) AS n
                     FROM x{d} JOIN q{d} USING (tree_id, node_id, f) GROUP BY ALL),
            s{d} AS (SELECT *, sum(n) OVER (PARTITION BY tree_id, node_id, f, q, low) AS s FROM k{d}),
            h{d} AS (SELECT tree_id, node_id, f, q, t, low, {_ENTROPY} AS h, max(s) AS s FROM s{d}
                     GROUP BY ALL),
            c{d} AS (SELECT tree_id, node_id, f, q, t, round(sum(h * s) / sum(s), 12) AS h,
                            sum(CASE WHEN low THEN s ELSE 0 END) AS nl,
                            sum(CASE WHEN low THEN 0 ELSE s END) AS nr FROM h{d} GROUP BY ALL),
            b{d} AS (SELECT * FROM c{d}
                     QUALIFY row_number() OVER (PARTITION BY tree_id, node_id ORDER BY h, f, q) = 1),
            e{d} AS (SELECT tree_id, node_id, {_ENTROPY} AS h0 FROM (
                       SELECT *, sum(n) OVER (PARTITION BY tree_id, node_id) AS s FROM (
                         SELECT tree_id, node_id, label, count(*) AS n FROM x{d} WHERE f = 0 GROUP BY ALL))
                     GROUP BY ALL),
            g{d} AS (SELECT b.*, round(round(h0, 12) - h, 12) AS gain FROM b{d} b JOIN e{d} USING (tree_id, node_id)),
            y{d} AS (SELECT * FROM g{d} WHERE nl > 0 AND nr > 0 AND gain >= 0),
            z{d} AS (SELECT tree_id, node_id, row_id, v AS sv, y.t AS st FROM x{d} x JOIN y{d} y
                     USING (tree_id, node_id, f)),
            zz{d} AS (SELECT DISTINCT * FROM z{d}),
            r{d + 1} AS (SELECT tree_id, CASE WHEN sv < st THEN node_id * 2 + 1 ELSE node_id * 2 + 2 END AS node_id,
                                row_id, label, f, v FROM x{d} JOIN zz{d} USING (tree_id, node_id, row_id)),
            n{d + 1} AS (SELECT tree_id, node_id, count(*) // {N_FEATURES} AS n, count(DISTINCT label) AS classes
                         FROM r{d + 1} GROUP BY ALL)"""
        )
    nodes = " UNION ALL ".join(
        f"""SELECT n.tree_id, n.node_id, {d} AS depth, n.n, """
        + (
            f"g.f, g.t, g.gain, y.node_id IS NULL AS is_leaf FROM n{d} n LEFT JOIN g{d} g USING (tree_id, node_id) "
            f"LEFT JOIN y{d} y USING (tree_id, node_id)"
            if d < depth
            else f"NULL AS f, NULL AS t, NULL AS gain, TRUE AS is_leaf FROM n{d} n"
        )
        for d in range(depth + 1)
    )
    leaves = " UNION ALL ".join(
        f"SELECT tree_id, node_id, label, count(*) // {N_FEATURES} AS n, {d} AS depth FROM r{d} GROUP BY ALL"
        for d in range(depth + 1)
    )
    return ",\n".join(
        [*parts, f"nodes AS ({nodes})", f"node_labels AS ({leaves})"]
    )


_FEATURES_SQL = f"""SELECT vec_id AS row_id, label,
    unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range({N_FEATURES})) AS f FROM embeddings"""
_ONE_TREE = f"""SELECT 0 AS tree_id, CAST(0 AS BIGINT) AS node_id, row_id, label, CAST(f AS INTEGER) AS f, v
                FROM ({_FEATURES_SQL})"""


@query(f"WITH {tree_sql(1, _ONE_TREE)} SELECT f AS feature_idx, CAST(q AS INTEGER) AS quartile, t AS threshold, h AS entropy FROM c0")
def t03_weighted_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate split of the root."""
    rows = persisted(_root(spark, folder), "root")
    candidates = trees.split_candidates(rows, trees.node_quartiles(rows), N_CLASSES, 1)
    return candidates.select("feature_idx", "quartile", "threshold", "entropy")


@query(
    """SELECT vec_id AS row_id, CASE WHEN CAST(embedding[1] AS DOUBLE) < 0 THEN 1 ELSE 2 END AS node_id
       FROM embeddings"""
)
def t04_split_rows(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("features")[0]
    child = trees.child_of(F.lit(0), value, F.lit(0.0))
    return _rows(spark, folder).select("row_id", child.alias("node_id"))


@query(f"WITH {tree_sql(1, _ONE_TREE)} SELECT f AS feature_idx, CAST(q AS INTEGER) AS quartile, t AS threshold FROM q0")
def t05_candidate_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    found = trees.node_quartiles(persisted(_root(spark, folder), "root"))
    listed = F.array(*[F.struct(F.lit(q).alias("quartile"), F.col(f"t{q}").alias("threshold")) for q in (1, 2, 3)])
    return found.select("feature_idx", F.inline(listed))


@query()
def t05_sketched_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate thresholds from sketches whose ranks are off by at most a thousandth."""
    found = trees.sketched_quartiles(_root(spark, folder), 1000)
    listed = F.array(*[F.struct(F.lit(q).alias("quartile"), F.col(f"t{q}").alias("threshold")) for q in (1, 2, 3)])
    return found.select("feature_idx", F.inline(listed))


@query(
    f"""WITH {tree_sql(1, _ONE_TREE)} SELECT f AS feature_idx, CAST(q AS INTEGER) AS quartile, t AS threshold,
               h AS entropy, CAST(nl AS BIGINT) AS n_left, CAST(nr AS BIGINT) AS n_right FROM b0"""
)
def t06_best_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = persisted(_root(spark, folder), "root")
    candidates = trees.split_candidates(rows, trees.node_quartiles(rows), N_CLASSES, 1)
    best = trees.best_splits(candidates)

    def size(c: str):
        return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)

    return best.select(
        "feature_idx", "quartile", "threshold", "entropy",
        size("left_counts").alias("n_left"), size("right_counts").alias("n_right"),
    )


@query(
    f"""WITH {tree_sql(1, _ONE_TREE)}
        SELECT round(gain, 9) AS gain, NOT (nl >= 5 AND nr >= 5 AND gain >= 0.01) AS is_leaf FROM g0"""
)
def t07_information_gain(spark: SparkSession, folder: str) -> DataFrame:
    rows = persisted(_root(spark, folder), "root")
    nodes = rows.groupBy("tree_id", "node_id").agg(
        trees.class_counts("label", "w", N_CLASSES).alias("counts")
    )
    candidates = trees.split_candidates(rows, trees.node_quartiles(rows), N_CLASSES, 1)
    decided = trees.decide(nodes, trees.best_splits(candidates), 5, 0.01)
    return decided.select(F.round("gain", 9).alias("gain"), "is_leaf")


_NODES_SQL = """SELECT tree_id, node_id, CAST(depth AS INTEGER) AS depth, CAST(n AS BIGINT) AS n,
                       f AS feature_idx, t AS threshold, round(gain, 9) AS gain, is_leaf FROM nodes"""


@query(f"WITH {tree_sql(CHECKED_DEPTH, _ONE_TREE)} {_NODES_SQL}")
def t08_train_tree(spark: SparkSession, folder: str) -> DataFrame:
    nodes = trees.grow(_rows(spark, folder), N_FEATURES, N_CLASSES, max_depth=CHECKED_DEPTH)
    return nodes.drop("probs").withColumn("gain", F.round("gain", 9))


@query()
def t08_train_whole_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The tree of the baseline's depth."""
    nodes = trees.grow(_rows(spark, folder), N_FEATURES, N_CLASSES, max_depth=WHOLE_DEPTH)
    return nodes.drop("probs").withColumn("gain", F.round("gain", 9))


# Class of a leaf: most rows, then the lowest label. A row ends in its deepest node.
def _votes_sql(depth: int) -> str:
    paths = " UNION ALL ".join(
        f"SELECT DISTINCT tree_id, row_id, node_id, {d} AS depth FROM r{d}" for d in range(depth + 1)
    )
    return f"""last AS (SELECT tree_id, row_id, arg_max(node_id, depth) AS node_id FROM ({paths}) GROUP BY ALL),
        leaf AS (SELECT tree_id, node_id, label AS predicted FROM node_labels
                 QUALIFY row_number() OVER (PARTITION BY tree_id, node_id ORDER BY n DESC, label) = 1)"""


@query(
    f"""WITH {tree_sql(CHECKED_DEPTH, _ONE_TREE)}, {_votes_sql(CHECKED_DEPTH)}
        SELECT row_id, tree_id, node_id, predicted FROM last JOIN leaf USING (tree_id, node_id)"""
)
def t09_predict(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    nodes = trees.grow(rows, N_FEATURES, N_CLASSES, max_depth=CHECKED_DEPTH)
    return trees.predict(rows, nodes)


@query(
    f"""WITH {tree_sql(CHECKED_DEPTH, _ONE_TREE)}, {_votes_sql(CHECKED_DEPTH)}
        SELECT row_id, tree_id, node_id, predicted FROM last JOIN leaf USING (tree_id, node_id)"""
)
def a04_saved_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of a tree after its node table was stored and loaded."""
    rows = _rows(spark, folder)
    path = shared_path(spark, "saved-tree")
    sources.save_node_table(trees.grow(rows, N_FEATURES, N_CLASSES, max_depth=CHECKED_DEPTH), path)
    return trees.predict(rows, sources.load_node_table(spark, path))


FOREST_TREES = 50

_DRAWN = f"""WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn, count(*) OVER () AS n FROM embeddings),
        d AS (SELECT tree_id, floor({uniform("tree_id || ':' || rn", 42)} * n) + 1 AS rn
              FROM o, (SELECT CAST(unnest(range({FOREST_TREES})) AS INTEGER) AS tree_id))
    SELECT tree_id, CAST(0 AS BIGINT) AS node_id, row_id, label, CAST(f AS INTEGER) AS f, v
    FROM d JOIN o USING (rn) JOIN ({_FEATURES_SQL}) e ON e.row_id = o.vec_id"""


def _forest(rows: DataFrame, max_depth: int) -> DataFrame:
    drawn = persisted(splits.bootstrap(rows.select("row_id"), "row_id", FOREST_TREES, 42), "drawn")
    return trees.forest(rows, drawn, N_FEATURES, N_CLASSES, max_depth)


@query(f"WITH {tree_sql(CHECKED_DEPTH, _DRAWN)} {_NODES_SQL}")
def t10_train_forest(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _forest(_rows(spark, folder), CHECKED_DEPTH)
    return nodes.drop("probs").withColumn("gain", F.round("gain", 9))


# Every row descends every tree, drawn or not, so the splits are applied to all rows.
def _descend_sql(depth: int) -> str:
    steps = [
        f"""p0 AS (SELECT tree_id, vec_id AS row_id, CAST(0 AS BIGINT) AS node_id, embedding
                   FROM embeddings, (SELECT CAST(unnest(range({FOREST_TREES})) AS INTEGER) AS tree_id))"""
    ]
    for d in range(depth):
        steps.append(
            f"""p{d + 1} AS (SELECT p.tree_id, row_id, embedding, CASE WHEN n.f IS NULL OR n.is_leaf THEN p.node_id
                  WHEN CAST(embedding[n.f + 1] AS DOUBLE) < n.t THEN p.node_id * 2 + 1
                  ELSE p.node_id * 2 + 2 END AS node_id
                FROM p{d} p LEFT JOIN nodes n ON p.tree_id = n.tree_id AND p.node_id = n.node_id)"""
        )
    steps.append(
        f"""leaf AS (SELECT tree_id, node_id, label AS predicted FROM node_labels
                 QUALIFY row_number() OVER (PARTITION BY tree_id, node_id ORDER BY n DESC, label) = 1),
            votes AS (SELECT tree_id, row_id, predicted FROM p{depth} JOIN leaf USING (tree_id, node_id)),
            counted AS (SELECT row_id, predicted, CAST(count(*) AS BIGINT) AS n FROM votes GROUP BY ALL),
            forest AS (SELECT row_id, predicted FROM counted
                       QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, predicted) = 1)"""
    )
    return ", ".join(steps)


_FOREST_SQL = f"WITH {tree_sql(CHECKED_DEPTH, _DRAWN)}, {_descend_sql(CHECKED_DEPTH)}"


@query(f"{_FOREST_SQL} SELECT row_id, predicted, n, round(n / {FOREST_TREES}, 9) AS share FROM counted")
def t11_vote_shares(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    votes = trees.predict(rows, _forest(rows, CHECKED_DEPTH))
    return trees.vote_shares(votes, FOREST_TREES).withColumn("share", F.round("share", 9))


@query(f"{_FOREST_SQL} SELECT row_id, predicted FROM forest")
def t12_forest_prediction(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    return trees.forest_votes(rows, _forest(rows, CHECKED_DEPTH), CHECKED_DEPTH)


@query(
    f"""{_FOREST_SQL} SELECT {round4('avg(CASE WHEN predicted = label THEN 1.0::DOUBLE ELSE 0 END)')} AS accuracy
        FROM forest JOIN embeddings ON vec_id = row_id"""
)
def t12_forest_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    votes = trees.predict(rows, _forest(rows, CHECKED_DEPTH), "label")
    judged = trees.majority(votes, "label")
    return evaluate.accuracy(evaluate.pair_counts(judged, "label", "predicted"))


@query()
def t10_train_whole_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty trees of the baseline's depth."""
    nodes = _forest(_rows(spark, folder), WHOLE_DEPTH)
    return nodes.drop("probs").withColumn("gain", F.round("gain", 9))


@query()
def t12_whole_forest_prediction(spark: SparkSession, folder: str) -> DataFrame:
    """The vote of fifty trees of the baseline's depth."""
    rows = _rows(spark, folder)
    return trees.forest_votes(rows, _forest(rows, WHOLE_DEPTH), WHOLE_DEPTH)
