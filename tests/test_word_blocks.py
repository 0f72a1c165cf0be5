"""Word vectors and values per word that are met in blocks of documents."""

from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lexigrain.operators import bayes, features, models, skip_grams, word_blocks
from lexigrain.operators.skip_grams import CodeTree
from lexigrain.session import persisted

TOPICS = [[f"{t}{i}" for i in range(6)] for t in "abc"]


def corpus(n=240):
    rng = np.random.default_rng(3)
    return [(i, [str(w) for w in rng.choice(TOPICS[i % 3], 40)]) for i in range(n)]


def depths(counts):
    """Weighted length of the best code, by merging word by word."""
    import heapq

    heap, total = sorted(counts), 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@pytest.mark.parametrize("counts", [[5], [1, 1], [1] * 7, [1, 1, 1, 2, 2, 3, 9, 9, 9, 40], [1] * 33 + [2] * 17 + [50]])
def test_ranges_make_the_shortest_code(counts):
    tree = CodeTree.grow(sorted(Counter(counts).items()))
    nodes, branches, starts = tree.paths(np.arange(len(counts)))
    length = np.diff(starts)
    assert (length * np.array(sorted(counts))).sum() == depths(counts)
    codes = {tuple(zip(nodes[a:b], branches[a:b])) for a, b in zip(starts, starts[1:])}
    assert len(codes) == len(counts)
    # a branch of a node leads to one child only
    children = Counter(pair for path in codes for pair in {(n, b) for n, b in path})
    assert len(counts) == 1 or len(children) == 2 * (len(counts) - 1)


def test_words_of_one_topic_are_near(spark):
    rows = [*corpus(), (900, ["once"]), (901, []), (902, None)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)
    fitted = models.word_vectors(size=20, partitions=3).fit(df)
    found = {r.word: r.vector.toArray() for r in fitted.getVectors().collect()}
    assert set(found) == {w for t in TOPICS for w in t} | {"once"}
    unit = {w: v / np.linalg.norm(v) for w, v in found.items()}
    same = np.mean([unit[a] @ unit[b] for t in TOPICS for a in t for b in t if a != b])
    other = np.mean([unit[a] @ unit[b] for a in TOPICS[0] for b in TOPICS[1]])
    assert same > other + 0.2
    again = {r.word: r.vector.toArray() for r in models.word_vectors(size=20, partitions=3).fit(df).getVectors().collect()}
    assert all(np.allclose(found[w], again[w], atol=1e-5) for w in found)
    often = models.word_vectors(size=4, min_count=2).fit(df).getVectors()
    assert {r.word for r in often.collect()} == set(found) - {"once"}


def test_no_words_no_vectors(spark):
    df = spark.createDataFrame([(1, []), (2, None)], "doc_id long, tokens array<string>")
    assert models.word_vectors().fit(df).getVectors().count() == 0


def test_mean_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(word_blocks, "BLOCK_WORDS", 500)
    rows = [*corpus(60), (7, ["a0", "b0", "zz"]), (None, ["a0"]), (500, ["zz"]), (501, None), (502, ["c1"])]
    df = spark.createDataFrame(rows, "doc_id long, toks array<string>").repartition(3)
    vectors = {w: [float(i), float(i * i), 1.0] for i, w in enumerate(w for t in TOPICS for w in t)}
    table = spark.createDataFrame([(w, Vectors.dense(v)) for w, v in vectors.items()], ["word", "vector"])
    want, got = {}, Counter()
    for doc_id, words in rows:
        if doc_id is not None:
            want.setdefault(doc_id, []).extend(vectors[w] for w in words or [] if w in vectors)
    means = models.mean_vectors(df, F.col("toks"), table, 3)
    for r in means.collect():
        got[r.doc_id] += 1
        known = want.get(r.doc_id) or [[0.0, 0.0, 0.0]]
        assert np.allclose(r["mean"], np.mean(known, axis=0))
    assert got == Counter(doc_id for doc_id, _ in rows)
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert "summarizer" not in plan.lower() and "FlatMapCoGroupsInArrow" in plan


def test_scaled_terms_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(word_blocks, "BLOCK_WORDS", 300)
    rows = [*corpus(40), (7, ["a0", "a0", "zz"]), (None, ["a0"]), (None, ["b1", "zz"]), (500, []), (501, None)]
    df = spark.createDataFrame(rows, "doc_id long, toks array<string>").repartition(3)
    found = features.normalised_tfidf(df, F.col("toks"))
    frequency = Counter(w for _, words in rows for w in set(words or []))
    raw = [(d, w, n * (np.log((1 + len(rows)) / (1 + frequency[w])) + 1)) for d, words in rows for w, n in Counter(words or []).items()]
    norm = Counter()
    for d, _, x in raw:
        norm[d] += x * x
    want = sorted((str(d), w, round(x / norm[d] ** 0.5, 9)) for d, w, x in raw)
    assert sorted((str(r.doc_id), r.term, round(r.weight, 9)) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_bayes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(word_blocks, "BLOCK_WORDS", 300)
    rows = [(i, words, "xyz"[i % 3]) for i, words in corpus(40)]
    rows += [(500, ["a0", "a0", "zz"], "x"), (None, ["a0"], "y"), (501, [], "z"), (502, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, toks array<string>, lang string").repartition(3)
    counts = {k: Counter(w for _, words, lang in rows if lang == k for w in words or []) for k in "xyz"}
    size = len(set().union(*counts.values()))
    fitted = bayes.fit_naive_bayes(df, "lang", F.col("toks"))
    asked = spark.createDataFrame([*rows, (600, ["never", "b3"], "x")], df.schema)
    judged = fitted.predict(asked, F.col("toks"))
    got = {r.doc_id: r for r in judged.collect()}
    for doc_id, words, _ in [*rows, (600, ["b3"], "x")]:
        # a row without an id has no terms
        used = (words or []) if doc_id is not None else []
        scores = {}
        for k, c in counts.items():
            prior = np.log(sum(r[2] == k for r in rows) / len(rows))
            scores[k] = round(prior + sum(np.log(c[w] + 1) - np.log(sum(c.values()) + size) for w in used), 6)
        best = max(scores.values())
        assert got[doc_id].score == pytest.approx(best, abs=2e-6)
        assert got[doc_id].predicted in {k for k, s in scores.items() if s > best - 2e-6}
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_held_out_bayes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(word_blocks, "BLOCK_WORDS", 300)
    rows = [(i, words, "xyz"[i % 3], i % 2) for i, words in corpus(40)] + [(500, ["only", "a0"], "x", 1), (501, None, "y", 0)]
    df = persisted(spark.createDataFrame(rows, "doc_id long, toks array<string>, lang string, fold int"), "folds")
    judged = bayes.predict_held_out(df, "lang", F.col("toks"))
    got = {r.doc_id: r for r in judged.collect()}
    for fold in (0, 1):
        fitted = bayes.fit_naive_bayes(df.filter(F.col("fold") != fold), "lang", F.col("toks"))
        for r in fitted.predict(df.filter(F.col("fold") == fold), F.col("toks")).collect():
            assert (got[r.doc_id].fold, got[r.doc_id].predicted) == (fold, r.predicted)
            assert got[r.doc_id].score == pytest.approx(r.score, abs=2e-6)
    assert len(got) == len(rows)
    assert "FlatMapCoGroupsInArrow" in judged._jdf.queryExecution().executedPlan().toString()


def test_training_is_that_of_a_plain_loop():
    rng = np.random.default_rng(4)
    sentences = [rng.integers(0, 9, n) for n in (1, 2, 7, 30)] + [np.array([3, 3, 3]), np.zeros(0, dtype=np.int64)]
    tree = CodeTree.grow(sorted(Counter(np.bincount(np.concatenate(sentences), minlength=9).tolist()).items()))
    words, window, rate = np.arange(9), 2, 0.5
    got = skip_grams.start_vectors(words, 5, 1)
    want = got.astype(float)
    skip_grams.trained(sentences, got, tree, words, window, rate, 6)

    nodes, branches, starts = tree.paths(words)
    inner, draw, done, total = np.zeros((nodes.max() + 1, 5)), np.random.default_rng(6), 0, sum(map(len, sentences))
    for sentence in sentences:
        if not len(sentence):
            continue
        step = rate * max(1 - done / total, 1e-4)
        spans = window - draw.integers(0, window, len(sentence))
        for i, word in enumerate(sentence):
            around = [sentence[j] for j in range(len(sentence)) if j != i and abs(i - j) <= spans[i]]
            path, taken = (x[starts[word] : starts[word + 1]] for x in (nodes, branches))
            a, b = want[around], inner[path].copy()
            error = (1 - taken - 1 / (1 + np.exp(-a @ b.T))) * step
            inner[path] += error.T @ a
            for j, change in zip(around, error @ b):
                want[j] += change
        done += len(sentence)
    assert np.abs(got - skip_grams.start_vectors(words, 5, 1)).max() > 0.02 and np.allclose(got, want, atol=1e-4)
    near, ends, single = skip_grams._windows(np.array([4, 5, 4, 6]), np.array([2, 1, 2, 1]), 2)
    assert [x.tolist() for x in np.split(near, ends[:-1])] == [[5, 4], [4, 4], [4, 5, 6], [4]]
    assert single == [True, False, True, True]


def test_blocks_fill_all_cores(spark, monkeypatch):
    monkeypatch.setattr(word_blocks, "BLOCK_WORDS", 1_000)
    rows = spark.createDataFrame(corpus(), "doc_id long, tokens array<string>")
    cores = spark.sparkContext.defaultParallelism
    for least in (None, 3):
        blocks = word_blocks.WordBlocks.deal(rows, F.col("tokens"), F.xxhash64("doc_id"), ["doc_id"], least)
        assert blocks.n >= 9_600 / 1_000 and blocks.n % cores == 0


def test_trained_vectors_travel_in_single_precision(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, [])], "doc_id long, tokens array<string>")
    table = spark.createDataFrame([("a", Vectors.dense([0.5, 0.1])), ("b", Vectors.dense([0.25, 2.0]))], ["word", "vector"])
    found, one = models.mean_vectors(rows, F.col("tokens"), table, 2, kind="float32"), float(np.float32(0.1))
    assert {r.doc_id: r.mean for r in found.collect()} == {1: [0.375, (one + 2.0) / 2], 2: [0.5, one], 3: [0.0, 0.0]}


def test_stored_parts_are_read_in_tasks(spark):
    rows = [(i % 3, str(i), bytes([i])) for i in range(9)]
    path = word_blocks.stored_by(spark.createDataFrame(rows, "_block int, a string, b binary").repartition(2), "_block", "parts")
    schema = word_blocks.pa.schema([("b", word_blocks.pa.binary()), ("a", word_blocks.pa.string())])
    for place in (path, f"file:{path}", f"file://{path}"):
        found = [word_blocks.stored_of(place, part, schema) for part in range(4)]
        assert [sorted(t["a"].to_pylist()) for t in found] == [[str(i) for i in range(9) if i % 3 == p] for p in range(3)] + [[]]
        assert all(t.schema == schema for t in found)
