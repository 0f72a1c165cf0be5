"""Topics inferred in blocks, against a plain computation on one matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrain.operators import models, topics, word_blocks
from lexigrain.plans.catalog import QUERIES

THEMES = [[f"{t}{i}" for i in range(8)] for t in "abc"]


def corpus(n=90):
    rng = np.random.default_rng(5)
    return [(i, [str(w) for w in rng.choice(THEMES[i % 3], 30)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)


def test_special_functions():
    x = np.array([0.01, 0.5, 1.0, 3.7, 40.0])
    assert topics.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-9)
    assert topics.trigamma(np.array([1.0]))[0] == pytest.approx(np.pi**2 / 6, abs=1e-9)
    assert np.allclose(topics.digamma(x + 1) - topics.digamma(x), 1 / x)
    assert np.allclose(topics.trigamma(x) - topics.trigamma(x + 1), 1 / x**2)
    drawn = topics.starts(np.arange(20_000), 3, 1)
    assert np.allclose(drawn.mean(axis=0), 1, atol=0.01) and np.allclose(drawn.std(axis=0), 0.1, atol=0.01)


def plain(rows, keys, k, iterations, seed):
    """The same model on one matrix: shares per document, weights per word, in the order of sorted words."""
    words = sorted({w for _, d in rows for w in d or []})
    n = np.array([[(d or []).count(w) for w in words] for _, d in rows], dtype=float)
    x = n * np.log((len(rows) + 1) / ((n > 0).sum(axis=0) + 1))
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    weights, alpha = keys["words"](words), np.full(k, 1 / k)

    def infer(row, key, seed):
        e = np.exp(topics.digamma(weights) - topics.digamma(weights.sum(axis=0)))
        gamma = topics.starts(np.array([key]), k, seed)[0]
        while True:
            share = np.exp(topics.digamma(gamma) - topics.digamma(gamma.sum()))
            new = share * (e.T @ (row / (e @ share))) + alpha
            done, gamma = np.abs(new - gamma).mean() <= 1e-3, new
            if done:
                share = np.exp(topics.digamma(gamma) - topics.digamma(gamma.sum()))
                return gamma, e * share * (row / (e @ share))[:, None]

    for i in range(1, iterations + 1):
        rate = (1024 + i) ** -0.51
        found = [infer(row, key, seed + i) for row, key in zip(x, keys["docs"]) if row.any()]
        change = np.mean([topics.digamma(g) - topics.digamma(g.sum()) for g, _ in found], axis=0)
        weights = (1 - rate) * weights + rate * (sum(s for _, s in found) + 1 / k)
        alpha = topics._alpha(alpha, change * len(found), len(found), rate)
    shares = [infer(row, key, seed)[0] if row.any() else np.zeros(k) for row, key in zip(x, keys["docs"])]
    return np.array([s / max(s.sum(), 1e-300) for s in shares]), weights, words


def test_blocks_give_the_plain_model(spark, monkeypatch):
    monkeypatch.setattr(word_blocks, "BLOCK_WORDS", 300)
    monkeypatch.setattr(topics, "PART_WORDS", 50)
    rows = [*corpus(), (900, ["once"]), (901, []), (902, None), (903, ["a0", "a0", "c3"]), (5, ["b1", "b2"])]
    df = frame(spark, rows)
    found = models.topic_model(3, 7, 6).fit(df)
    key = {(r.doc_id, tuple(r.tokens or [])): r.k for r in df.select("*", F.xxhash64("doc_id", "tokens").alias("k")).collect()}
    keys = {
        "docs": [key[d, tuple(t or [])] for d, t in rows],
        "words": lambda words: topics.starts(topics._hashed(topics.pa.array(words)), 3, 7),
    }
    shares, weights, words = plain(rows, keys, 3, 6, 7)
    got = sorted((r.doc_id, tuple(np.round(r.topicDistribution, 4))) for r in found.distributions().collect())
    want = sorted((d, tuple(np.round(s, 4))) for (d, _), s in zip(rows, shares))
    assert [d for d, _ in got] == [d for d, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], atol=5e-4)
    best = {(r.topic, r.rk): r.term for r in models.topic_words(found, 5).collect()}
    for topic in range(3):
        strongest = np.sort(weights[:, topic])[::-1][:5]
        assert np.allclose([weights[words.index(best[topic, rk]), topic] for rk in range(1, 6)], strongest, rtol=1e-4)
    # rows that were not fitted on, with words that are not known
    asked = frame(spark, [*rows, (999, ["never"])])
    other = {r.doc_id: r.topicDistribution for r in found.on(asked).distributions().collect() if r.doc_id != 5}
    assert other.pop(999) == [0.0, 0.0, 0.0]
    assert all(np.allclose(other[d], x, atol=1e-6) for d, x in ((r.doc_id, r.topicDistribution) for r in found.distributions().collect()) if d != 5)


def test_themes_are_found(spark):
    found = models.topic_model(3, 1, 15).fit(frame(spark, corpus()))
    topic = {r.doc_id: r.topic for r in models.assign_topics(found).collect()}
    share = [np.bincount([t for d, t in topic.items() if d % 3 == theme]).max() / 30 for theme in range(3)]
    assert np.mean(share) > 0.5


def test_no_words_no_topics(spark):
    found = models.topic_model().fit(frame(spark, [(1, []), (2, None)]))
    assert found.words().count() == 0
    assert [r.topicDistribution for r in found.distributions().collect()] == [[0.0] * 5] * 2


@pytest.mark.parametrize(
    ("name", "least"), [("d10_topics_by_label", 1), ("e12_topic_distribution", 30)]
)
def test_topics_need_no_vocabulary_on_the_driver(spark, monkeypatch, tmp_path, name, least):
    rows = [(i, " ".join(f"letter{w}s" for w in words), "en" if i % 2 else "de") for i, words in corpus(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(models, "DRIVER_TERMS", 10)
    assert QUERIES[name](spark, str(tmp_path)).count() >= least


def test_documents_of_unlike_sizes_are_inferred_as_alone():
    rng = np.random.default_rng(8)
    sizes = np.array([1, 700, 3, 40, 45, 2, 260, 1, 44])
    words, values = rng.gamma(2, 1, (4, sizes.sum())), rng.random(sizes.sum()).astype(np.float32)
    start, alpha = rng.gamma(2, 1, (4, len(sizes))), np.array([0.2, 0.1, 0.4, 0.25])
    found, ends = topics.inferred(words, values, sizes, start, alpha), np.cumsum(sizes)
    for i, (lo, hi) in enumerate(zip(ends - sizes, ends)):
        gamma = start[:, i]
        while True:
            share = np.exp(topics.digamma(gamma) - topics.digamma(gamma.sum()))
            new = share * (words[:, lo:hi] @ (values[lo:hi] / (share @ words[:, lo:hi]))) + alpha
            done, gamma = np.abs(new - gamma).mean() <= topics.TOLERANCE, new
            if done:
                break
        assert np.allclose(found[:, i], gamma, rtol=1e-9)


def test_ranges_hold_documents_of_like_sizes():
    sizes = np.array([5, 1, 0, 9])
    rows = topics.pa.table({"id": [0, 1, 2, 3]})
    at, values = np.arange(15), np.arange(15) / 2
    rows, lengths, at, values = topics._by_size(rows, sizes, at, values)
    assert rows["id"].to_pylist() == [2, 1, 0, 3] and lengths.tolist() == [0, 1, 5, 9]
    assert at.tolist() == [5, 0, 1, 2, 3, 4, *range(6, 15)] and (values == at / 2).all()
    x = np.array([1e-9, 1e-3, 0.2, 5.0, 1e9])
    assert np.allclose(topics.digamma(x + 1) - topics.digamma(x), 1 / x)


def test_documents_are_not_exchanged_in_iterations(spark, monkeypatch):
    monkeypatch.setattr(word_blocks, "BLOCK_WORDS", 100)
    moved, deal = [], topics.Topics.next

    def watched(self, coded, iteration):
        assert isinstance(coded, str)
        moved.append(coded)
        return deal(self, coded, iteration)

    monkeypatch.setattr(topics.Topics, "next", watched)
    found = models.topic_model(3, 1, 2).fit(frame(spark, corpus()))
    assert len(moved) == 2 and len(set(moved)) == 1 and found.distributions().count() == 90
    sizes = [len(word_blocks.stored_of(moved[0], b, topics._CODED.remove(0))) for b in range(found.blocks.n)]
    assert sum(sizes) >= sum(n > 0 for n in sizes) > 1
