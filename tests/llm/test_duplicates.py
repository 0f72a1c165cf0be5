"""SimHash groups, components and near vectors against brute force."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from lexigrain.llm import simhash, vector_graph
from lexigrain.llm.components import components

CLASHING = "doc_id long, text string, print long, node long, component_id string, key int"


def plain_fingerprint(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in small.translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_every_close_pair_shares_a_key():
    rng = np.random.default_rng(1)
    left = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    right = left.copy()
    for i in range(len(right)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            right[i] ^= np.uint64(1) << np.uint64(bit)
    sets = []
    for prints in (left, right):
        rows, keys = simhash.keys_of(prints)
        sets.append([set() for _ in prints])
        for r, k in zip(rows, keys):
            sets[-1][r].add(k)
    assert all(a & b for a, b in zip(*sets))


def test_decoding_reaches_every_word():
    words = np.arange(1 << 23, dtype=np.int64)[::97]
    errors = simhash._ERROR[simhash._remainders(words)]
    assert np.bitwise_count(errors).max() <= 3
    assert not simhash._remainders(words ^ errors).any()


def near_texts():
    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(400)]
    texts = [None, "", " \t\n", "one", "One", "two words", "a b c", "A B C"]
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"v{rng.randrange(4000)}" for _ in range(rng.randrange(3, 90))) for _ in range(30)]
    texts.append(" ".join(f"u{i % 977}" for i in range(30_000)))
    return texts + texts[10:14]


@pytest.mark.parametrize("part", [4, simhash.PART])
def test_groups_equal_brute_force(spark, part):
    texts = near_texts()
    rows = [(100 + i, t, 1, 2, "x", 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, CLASHING).repartition(3)
    got = {r.doc_id: r for r in simhash.simhash_groups(docs, part=part).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    label = plain_components(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    assert len(got) == len(texts)
    for i, p in enumerate(prints):
        assert got[100 + i].fingerprint == format(p, "016x")
        assert got[100 + i].component_id == 100 + label[i]


def test_groups_of_repeated_rows_null_ids_and_an_empty_table(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "a b"), (None, "z y x")], schema)
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.simhash_groups(docs).collect())
    assert got == [(0, 0), (0, 5), (5, 5), (5, 5)]
    empty = simhash.simhash_groups(spark.createDataFrame([], schema))
    assert empty.columns == ["doc_id", "fingerprint", "component_id"] and empty.count() == 0


def test_stage_keeps_the_smallest_of_each_simhash_group(spark):
    texts = near_texts()
    prints = [plain_fingerprint(t) for t in texts]
    label = plain_components(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    rows = [(100 + i, t, "x", 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, component_id int").repartition(3)
    kept = corpus_pipeline.without_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {100 + c for c in label}
    assert corpus_pipeline.without_near_copies(spark, docs.limit(0), "").collect() == []


def test_a_key_spread_one_per_batch_is_counted_and_split(spark):
    # all prints share the last segments, so they share keys; no batch holds two of them
    rng = np.random.default_rng(8)
    prints = rng.integers(0, 1 << 63, 4000, dtype=np.int64)
    prints[::20] = (prints[::20] & ((1 << 22) - 1)) | (0x15A5A5A5A5 << 22)
    rows = [(i, int(p)) for i, p in enumerate(prints)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        distinct = simhash.persisted(spark.createDataFrame(rows, "node long, print long").coalesce(1), "spread")
        slots, hot = simhash.hot_slots(distinct, 50)
        parts = {r.slot: r.parts for r in hot.collect()}
        links = {(r.u, r.v) for r in simhash.near_links(distinct, 50).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    _, keys = simhash.keys_of(prints.view(np.uint64))
    key, n = np.unique(keys, return_counts=True)
    assert n.max() >= 200
    assert all(parts[k % slots] >= -(-c // 50) for k, c in zip(key[n > 50].tolist(), n[n > 50].tolist()))
    label = plain_components(200, lambda i, j: int(prints[20 * i] ^ prints[20 * j]).bit_count() <= 3)
    close = {(i, c) for i, c in enumerate(label) if c != i}
    assert len(links) >= len(close)


def test_components_of_chains_and_hubs(spark):
    chain = [(i + 1, i) for i in range(40)]
    hub = [(200, 201 + i) for i in range(50)]
    links = spark.createDataFrame(chain + hub + [(7, 7), (3, 2)], "u long, v long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{200 + i: 200 for i in range(51)}}


def vector_rows():
    rng = np.random.default_rng(5)
    rows = []
    for label in range(3):
        for _ in range(12):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 9)):
                rows.append((label, (centre + rng.normal(size=16) * 0.12).astype(np.float32).tolist()))
    dense = rng.normal(size=16)
    rows += [(1, (dense + rng.normal(size=16) * 0.1).astype(np.float32).tolist()) for _ in range(80)]
    rows += [rows[0]] * 3 + [(1, [2 * x for x in rows[-1][1]])]
    zero = [0.0] * 16
    rows += [(None, rows[0][1]), (0, None), (0, zero), (0, zero), (0, [float("nan")] * 16)]
    rows += [(0, [float("inf")] + zero[1:]), (0, [None] + rows[0][1][1:]), (0, rows[0][1][:8]), (0, [1e-30] * 16), (0, [1e30] * 16)]
    return [(10 + i, v, label, 1, 2) for i, (label, v) in enumerate(rows)]


@pytest.mark.parametrize("block", [24, vector_graph.BLOCK])
def test_near_vectors_equal_brute_force(spark, block):
    rows = vector_rows()
    schema = "vec_id long, embedding array<float>, label int, node long, copies long"
    got = {r.vec_id: r for r in vector_graph.near_vectors(spark.createDataFrame(rows, schema), block=block).collect()}
    vectors = []
    for _, v, label, _, _ in rows:
        good = label is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)
        wide = np.array(v, np.float32).astype(float) if good else None
        vectors.append(wide / np.linalg.norm(wide) if good else None)

    def linked(i, j):
        a, b = vectors[i], vectors[j]
        return a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= 0.93

    n = len(rows)
    label = plain_components(n, linked)
    for i in range(n):
        row = got[10 + i]
        assert row.n_links == sum(linked(i, j) for j in range(n) if j != i), i
        assert row.component_id == 10 + label[i]
        assert row.kept == (label[i] == i)
    assert len(got) == n


def test_near_vectors_without_rows_or_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_graph.near_vectors(spark.createDataFrame([], schema)).count() == 0
    row = vector_graph.near_vectors(spark.createDataFrame([(None, [1.0], 1)], schema)).first()
    assert (row.vec_id, row.n_links, row.component_id) == (None, 0, None)


def test_pruned_graph_finds_what_brute_force_finds():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    points = np.repeat(centres, 15, axis=0) + rng.normal(size=(600, 32)) * 0.15
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    lists = vector_graph.prune(points)
    near = np.full((600, vector_graph.DEGREE), -1)
    for i, x in enumerate(lists):
        near[i, : len(x)] = x
    truth = points @ points.T >= 0.93
    np.fill_diagonal(truth, False)
    hits = vector_graph.search_block(points, near, np.arange(0, 600, 50), 0.93)
    assert not (hits & ~truth).any()
    assert (hits & truth).sum() >= 0.95 * truth.sum()


def test_links_between_tight_groups_of_a_block_are_found():
    rng = np.random.default_rng(4)
    middle = np.eye(64)[0]
    centres = [middle + 0.2 * (x / np.linalg.norm(x)) for x in rng.normal(size=(14, 64)) * (1 - middle)]
    points = np.repeat(centres, 100, axis=0) + rng.normal(size=(1400, 64)) * 0.004
    points = points[rng.permutation(1400)]
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    lists = vector_graph.prune(points)
    near = np.full((1400, vector_graph.DEGREE), -1)
    for i, x in enumerate(lists):
        near[i, : len(x)] = x
    truth = points @ points.T >= 0.93
    np.fill_diagonal(truth, False)
    assert truth.sum() > 0.9 * 1400 * 1399
    for audited in (np.arange(0, 1400, 50), np.zeros(0, np.int64)):
        hits = vector_graph.search_block(points, near, audited, 0.93)
        assert not (hits & ~truth).any() and (hits & truth).sum() >= 0.95 * truth.sum()


def test_spread_out_vectors_join_few_shards_and_keep_their_links(spark):
    rng = np.random.default_rng(7)
    ones = rng.normal(size=(20_000, 64))
    ones /= np.linalg.norm(ones, axis=1, keepdims=True)
    moved = ones[:100] + 0.37 * (x := rng.normal(size=(100, 64))) / np.linalg.norm(x, axis=1, keepdims=True)
    points = np.concatenate([ones, moved / np.linalg.norm(moved, axis=1, keepdims=True)])
    truth = sum(int((points[i] @ points.T >= 0.93).sum()) - 1 for i in range(20_000, 20_100))
    assert truth >= 80
    sample = points[rng.choice(len(points), 4_000, replace=False)]
    frame = vector_graph.pd.DataFrame({"space": "a", "node": range(4_000), "vector": list(sample)})
    cells = vector_graph.centres(frame, {"a": len(points)})["a"]
    margin = vector_graph.probe_margin(sample, cells, 0.93)
    shards = (vector_graph.beyond(points, cells) <= margin).sum(axis=1).mean()
    assert len(cells) > 30 and shards < 4
    docs = spark.createDataFrame(vector_graph.pd.DataFrame({"vec_id": range(len(points)), "embedding": points.tolist(), "label": 1}))
    found = vector_graph.near_vectors(docs).filter("vec_id >= 20000").toPandas()
    assert found.n_links.sum() >= 0.95 * truth


def test_links_across_many_shards_are_found(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "PER_CENTRE", 50)
    rng = np.random.default_rng(6)
    ones = rng.normal(size=(1500, 64))
    ones /= np.linalg.norm(ones, axis=1, keepdims=True)
    others = ones + 0.36 * (x := rng.normal(size=ones.shape)) / np.linalg.norm(x, axis=1, keepdims=True)
    points = np.concatenate([ones, others / np.linalg.norm(others, axis=1, keepdims=True)])
    truth = points @ points.T >= 0.93
    np.fill_diagonal(truth, False)
    assert truth.sum() > 2000
    docs = spark.createDataFrame([(i, v, 1) for i, v in enumerate(points.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vector_graph.near_vectors(docs.repartition(4)).collect()}
    assert all(got[i] <= n for i, n in enumerate(truth.sum(axis=1)))
    assert sum(got.values()) >= 0.98 * truth.sum()
