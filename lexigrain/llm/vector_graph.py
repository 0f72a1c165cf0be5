"""Near-duplicate embeddings: a robust-pruned graph over overlapping shards, searched by range."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm.common import query, table, within
from lexigrain.llm.components import components
from lexigrain.session import persisted

LEAST_COSINE = 0.93
#: Vectors that the cluster centres are fitted on, drawn by a hash of the id (about so many).
SAMPLE = 20_000
#: Vectors per centre, and centres in all.
PER_CENTRE, MOST_CENTRES, ROUNDS = 600, 2_048, 8
#: Audited vectors of all large spaces (about so many), probes of each space, and the share of links and
#: of probes whose ends share a shard.
AUDITED, PROBES, SHARED = 2_000, 8_000, 0.99
#: Vectors that meet in one task. A larger shard is cut into parts; each pair of parts is a block.
BLOCK = 4_096
#: Out-degree, candidates and slack of the pruned graph; most neighbours with those that chose a point;
#: width of the greedy search.
DEGREE, CANDIDATES, SLACK, MOST_NEAR, BEAM = 24, 64, 1.2, 48, 8
#: Vectors whose id this divides are the audit's queries, and so many more that each block has some; a
#: block below the recall of their links and nearest neighbours is compared exactly.
AUDIT_EVERY, LEAST_AUDITED, LEAST_RECALL = 50, 64, 0.95

MEMBERS = "space string, shard int, shards array<int>, node long, copies long, vector array<double>"
ADJACENT = "node long, near array<long>"
LINKED = "node long, n long, root long"


def centres(sample: pd.DataFrame, sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """Cluster centres of every space that needs more than one shard, by a few rounds of k-means."""
    total = sum(sizes.values())
    out = {}
    for space, group in sample.groupby("space"):
        rows = np.array(group.sort_values("node")["vector"].tolist())
        share = MOST_CENTRES * sizes[space] / max(total, 1)
        k = int(min(np.ceil(sizes[space] / PER_CENTRE), max(share, 1), len(rows)))
        if k < 2:
            continue
        found = rows[np.random.default_rng(k).choice(len(rows), k, replace=False)]
        for _ in range(ROUNDS):
            nearest = (rows @ found.T).argmax(axis=1)
            sums = np.zeros_like(found)
            np.add.at(sums, nearest, rows)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            found = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), found)
        out[space] = found
    return out


def beyond(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """How far each vector is from the border to each centre's cell, as a sine; 0 for its own cell.

    A way between two vectors of two cells crosses the border between them, so if they are an angle t
    apart, one of them is at most t / 2 from it: joining all cells up to sin(t / 2) loses no pair.
    """
    cosine = vectors @ centres.T
    home = cosine.argmax(axis=1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))[home]
    over = cosine[np.arange(len(home)), home][:, None] - cosine
    return np.where(gap > 1e-9, over / np.where(gap > 1e-9, gap, 1), 0)


def half_sine(least: float) -> float:
    """Sine of half the angle of a cosine: the margin that loses no pair."""
    return float(np.sqrt(max(0.0, (1 - least) / 2))) + 1e-9


def probe_margin(sample: np.ndarray, cells: np.ndarray, least: float) -> float:
    """Least margin at which the wanted share of probes share a shard with their vector.

    A probe lies at a cosine of ``least`` from a vector of the sample, in the direction of another one, as
    differences between vectors of the space lie. So a margin is measured where there are no links too.
    """
    rng = np.random.default_rng(len(cells))
    sine = np.sqrt(1 - least * least)
    needed = []
    for at in range(0, PROBES, 1_000):
        start = sample[rng.integers(0, len(sample), min(1_000, PROBES - at))]
        end = sample[rng.integers(0, len(sample), len(start))]
        way = end - np.einsum("nd,nd->n", end, start)[:, None] * start
        length = np.linalg.norm(way, axis=1)
        probe = least * start + sine * way / np.where(length > 1e-9, length, 1)[:, None]
        far = np.maximum(beyond(start, cells), beyond(probe, cells)).min(axis=1)
        needed.append(far[length > 1e-9])
    found = np.concatenate(needed)
    return float(np.quantile(found, SHARED)) if len(found) else 0.0


def margins(
    vectors: DataFrame, found: dict[str, np.ndarray], probed: dict[str, float], least: float, audited: int = AUDITED
) -> dict[str, float]:
    """Margin of each space within which a vector joins shards: what probes and the audit need.

    The audit's queries are the vectors whose id ``AUDIT_EVERY`` divides, drawn by a hash where there
    are more than ``audited``. They are compared with all vectors of their space, and each link needs a margin
    at which its ends share a shard. The margin is the least that holds for the wanted share of links and for
    that of probes (``probed``), and never more than the one that loses no pair.
    """
    spark = vectors.sparkSession
    most = half_sine(least)
    known = F.col("space").isin(list(found))
    asked = within(vectors.filter(known & (F.col("node") % AUDIT_EVERY == 0)).select("node", "space", "vector"),
                   F.col("node"), audited).toPandas()
    queries = {s: (g["node"].to_numpy(), np.array(g["vector"].tolist())) for s, g in asked.groupby("space")}
    shared = spark.sparkContext.broadcast((found, queries))

    def compared(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, queries = shared.value
        sines = {s: beyond(v, cells[s]) for s, (_, v) in queries.items()}
        for batch in batches:
            for space, group in batch.groupby("space"):
                if space not in queries:
                    continue
                ids, wanted = queries[space]
                rows = np.array(group["vector"].tolist())
                u, q = np.nonzero((rows @ wanted.T >= least) & (group["node"].to_numpy()[:, None] != ids))
                if not len(u):
                    continue
                own = beyond(rows, cells[space])
                steps = np.zeros(len(u), np.int64)
                for at in range(0, len(u), 1 << 13):
                    part = slice(at, at + (1 << 13))
                    needed = np.maximum(own[u[part]], sines[space][q[part]]).min(axis=1)
                    steps[part] = np.ceil(np.minimum(needed / most, 1) * 100)
                step, n = np.unique(steps, return_counts=True)
                yield pd.DataFrame({"space": space, "step": step, "n": n})

    counted = vectors.filter(known).select("space", "node", "vector")
    steps = (
        counted.mapInPandas(compared, "space string, step long, n long")
        .groupBy("space", "step").agg(F.sum("n").alias("n")).toPandas()
    )
    out = {space: min(probed[space], most) for space in found}
    for space, group in steps.sort_values("step").groupby("space"):
        total = group["n"].cumsum().to_numpy()
        enough = int((total >= SHARED * total[-1]).argmax())
        out[space] = max(out[space], float(group["step"].iloc[enough]) / 100 * most + 1e-9)
    return out


def prune(vectors: np.ndarray, degree: int = DEGREE) -> list[np.ndarray]:
    """Robust pruning: of a point's nearest candidates, those that no kept one is much nearer to."""
    out = []
    for at in range(0, len(vectors), 512):
        cosine = vectors[at : at + 512] @ vectors.T
        cosine[np.arange(len(cosine)), np.arange(at, at + len(cosine))] = -2
        most = min(CANDIDATES, len(vectors) - 1)
        if most < 1:
            return [np.zeros(0, np.int64) for _ in vectors]
        near = np.argpartition(-cosine, most - 1, axis=1)[:, :most]
        for i, candidates in enumerate(near):
            near_i = candidates[np.argsort(-cosine[i, candidates], kind="stable")]
            distance = np.sqrt(np.maximum(0, 2 - 2 * cosine[i, near_i]))
            block = vectors[near_i]
            between = np.sqrt(np.maximum(0, 2 - 2 * (block @ block.T)))
            alive, kept = np.ones(len(near_i), bool), []
            for j in range(len(near_i)):
                if alive[j]:
                    kept.append(near_i[j])
                    if len(kept) == degree:
                        break
                    alive &= SLACK * between[j] > distance
            out.append(np.array(kept, np.int64))
    return out


def neighbours(vectors: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Lists of both directions of the edges ``u, v``, so that a search can leave and enter each point.

    A point keeps the list it chose; those that chose it follow, nearest first, up to ``MOST_NEAR``
    in all. Rows are filled up with -1.
    """
    n = len(vectors)
    both = np.concatenate([u * n + v, v * n + u])
    pairs, first = np.unique(both, return_index=True)
    left, right = np.divmod(pairs, n)
    chosen = first < len(u)
    cosine = np.einsum("pd,pd->p", vectors[left], vectors[right]) if len(pairs) else np.zeros(0)
    order = np.lexsort((-cosine, ~chosen, left))
    left, right, chosen = left[order], right[order], chosen[order]
    place = np.arange(len(left)) - np.searchsorted(left, left)
    kept = chosen | (place < MOST_NEAR)
    near = np.full((n, int(place[kept].max(initial=0)) + 1), -1, np.int64)
    near[left[kept], place[kept]] = right[kept]
    return near


def medoids(vectors: np.ndarray, n: int = 4) -> np.ndarray:
    """The point nearest to the mean of all, and of each of a few runs of points."""
    means = [vectors.mean(axis=0)] + [p.mean(axis=0) for p in np.array_split(vectors, n) if len(p)]
    return np.unique((vectors @ np.array(means).T).argmax(axis=0))


def range_search(
    vectors: np.ndarray, near: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, least: float
) -> tuple[np.ndarray, np.ndarray]:
    """Which points each query finds within the range, and which it meets, as boolean matrices.

    First a greedy search from the medoids and the query's own list with a bounded beam, all queries side by side; then the
    search widens over the neighbours of every point found in range until nothing is added.
    """
    q, m = len(queries), len(vectors)
    target = vectors[queries]
    seen = np.zeros((q, m), bool)
    hits = np.zeros((q, m), bool)
    each = np.arange(q)[:, None]
    # a query is a point itself, so its own list is an entry besides the medoids
    found = np.concatenate([np.broadcast_to(entry, (q, len(entry))), queries[:, None]], axis=1)
    score = np.einsum("qed,qd->qe", vectors[found], target)
    seen[each, found] = True
    hits[each, found] = score >= least
    done = np.zeros(found.shape, bool)
    while True:
        open_score = np.where(done, -np.inf, score)
        best = open_score.argmax(axis=1)[:, None]
        going = np.isfinite(np.take_along_axis(open_score, best, 1))[:, 0]
        if not going.any():
            break
        np.put_along_axis(done, best, True, 1)
        rows = each[going, 0]
        nearby = near[np.take_along_axis(found, best, 1)[going, 0]]
        fresh = (nearby >= 0) & ~seen[rows[:, None], nearby]
        fresh &= np.concatenate(
            [np.ones((len(rows), 1), bool), np.diff(nearby, axis=1) != 0], axis=1
        )
        new_score = np.full((q, near.shape[1]), -np.inf)
        new_found = np.zeros((q, near.shape[1]), np.int64)
        value = np.einsum("qrd,qd->qr", vectors[nearby], target[rows])
        new_score[rows] = np.where(fresh, value, -np.inf)
        new_found[rows] = np.maximum(nearby, 0)
        at = np.nonzero(fresh)
        seen[rows[at[0]], nearby[at]] = True
        hits[rows[at[0]], nearby[at]] = value[at] >= least
        found = np.concatenate([found, new_found], axis=1)
        score = np.concatenate([score, new_score], axis=1)
        done = np.concatenate([done, np.zeros(new_score.shape, bool)], axis=1)
        done |= ~np.isfinite(score)
        if found.shape[1] > beam:
            top = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
            found, score, done = (np.take_along_axis(x, top, 1) for x in (found, score, done))
    rows, points = np.nonzero(hits)
    while len(rows):
        wanted = np.zeros((q, m), bool)
        for at in range(0, len(rows), 1 << 15):
            nearby = near[points[at : at + (1 << 15)]]
            inside = nearby >= 0
            wanted[np.repeat(rows[at : at + (1 << 15)], near.shape[1])[inside.ravel()], nearby[inside]] = True
        wanted &= ~seen
        seen |= wanted
        rows, points = np.nonzero(wanted)
        keep = np.zeros(len(rows), bool)
        for at in range(0, len(rows), 1 << 15):
            part = slice(at, at + (1 << 15))
            keep[part] = np.einsum("pd,pd->p", target[rows[part]], vectors[points[part]]) >= least
        rows, points = rows[keep], points[keep]
        hits[rows, points] = True
    return hits, seen


def search_block(
    vectors: np.ndarray, near: np.ndarray, audited: np.ndarray, least: float
) -> np.ndarray:
    """Links between all points of a block as a symmetric boolean matrix.

    The audit compares its queries, the given ones and some spread over the block, with all points:
    what they are to find is their links and their nearest neighbour, which there always is. If the
    search meets less of that than the recall, all points are compared.
    """
    m, entry = len(vectors), medoids(vectors)
    some = np.linspace(0, m - 1, min(m, LEAST_AUDITED)).astype(np.int64)
    audited = np.union1d(np.asarray(audited, np.int64), some)
    cosine = vectors[audited] @ vectors.T
    cosine[np.arange(len(audited)), audited] = -2
    truth = cosine >= least
    if m > 1:
        truth[np.arange(len(audited)), cosine.argmax(axis=1)] = True
    hits, met = np.zeros((m, m), bool), np.zeros((len(audited), m), bool)
    for at in range(0, m, 256):
        queries = np.arange(at, min(at + 256, m))
        hits[queries], seen = range_search(vectors, near, queries, entry, BEAM, least)
        mine = (at <= audited) & (audited < at + 256)
        met[mine] = seen[audited[mine] - at]
    hits |= hits.T
    met |= hits[audited]
    if (met & truth).sum() < LEAST_RECALL * truth.sum():
        for at in range(0, m, 512):
            hits[at : at + 512] |= vectors[at : at + 512] @ vectors.T >= least
        hits |= hits.T
    np.fill_diagonal(hits, False)
    return hits


def roots(links: np.ndarray) -> np.ndarray:
    """Smallest point of each point's component."""
    label = np.arange(len(links))
    while True:
        lowest = np.where(links, label, len(links)).min(axis=1, initial=len(links))
        lowest = np.minimum(lowest, label)
        lowest = lowest[lowest]
        if (lowest == label).all():
            return label
        label = lowest


def _members(vectors: DataFrame, sample_rows: int, least: float) -> DataFrame:
    """Each vector in all shards within its space's margin: a stored table with the shard and all of them."""
    spark = vectors.sparkSession
    sample = within(vectors.select("node", "space", "vector"), F.col("node"), sample_rows).toPandas()
    # spaces that need several shards are in the sample; the list is no longer than it
    large = vectors.groupBy("space").count().filter(F.col("count") > PER_CENTRE)
    spaces = spark.createDataFrame(
        pd.DataFrame({"space": sorted(sample["space"].unique())}, dtype=object), "space string"
    )
    sizes = {r["space"]: r["count"] for r in large.join(spaces, "space").collect()}
    found = centres(sample[sample["space"].isin(list(sizes))], sizes)
    drawn = {s: np.array(g.sort_values("node")["vector"].tolist()) for s, g in sample.groupby("space") if s in found}
    probed = {s: probe_margin(drawn[s], cells, least) for s, cells in found.items()}
    shared = spark.sparkContext.broadcast((found, margins(vectors, found, probed, least) if found else {}))
    names = [c.split()[0] for c in MEMBERS.split(", ")]

    def assigned(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for space, group in batch.groupby("space"):
                cells, margin = shared.value
                if space not in cells:
                    yield group.assign(shard=0, shards=[[0]] * len(group))[names]
                    continue
                near = beyond(np.array(group["vector"].tolist()), cells[space]) <= margin[space]
                row, shard = np.nonzero(near)
                joined = pd.Series([np.flatnonzero(n) for n in near], index=group.index)
                for at in range(0, len(row), 1 << 12):
                    rows = row[at : at + (1 << 12)]
                    yield group.assign(shards=joined).iloc[rows].assign(shard=shard[at : at + (1 << 12)])[names]

    return persisted(vectors.mapInPandas(assigned, MEMBERS), "members")


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """Members in blocks of bounded size, as ``part, a, b``: all of a shard, or two of its parts."""
    sizes = members.groupBy("space", "shard").count().filter(F.col("count") > block)
    sizes = persisted(
        sizes.select("space", "shard", F.ceil(F.col("count") * 3 / block).cast("int").alias("parts")), "shards"
    )
    own = F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.lit(0))
    return (
        members.join(sizes, ["space", "shard"], "left")
        .withColumn("part", own)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        .withColumn("a", F.least("part", "with"))
        .withColumn("b", F.greatest("part", "with"))
        .drop("parts", "with")
    )


def near_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    least: float = LEAST_COSINE,
    block: int = BLOCK,
    sample_rows: int = SAMPLE,
) -> DataFrame:
    """Links and component of every vector: ``vec_id, n_links, component_id, kept``.

    Vectors of one label link at a cosine of ``least`` or more, in double precision. Equal vectors
    are one node with a number of copies. Nodes join every shard within a margin of their nearest, which
    an audit against whole labels sets; each block of a shard
    builds a robust-pruned graph, adjacency lists of a node are united over blocks, and each block
    searches it for all its members. A link is counted in one block only, the first that both ends
    share, so numbers of links are sums and no list of pairs leaves a block; a block hands on its
    members' components, which are joined over blocks.

    Vectors that are null, zero, or hold null or non-finite components, vectors without a label and
    without an id link with nothing: 0 links, their own component. Repeated rows are copies of one
    vector; an id names one vector. Vectors of different lengths are never compared. Only three
    columns are read. An empty table gives no rows.
    """
    wide = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), wide.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    usable = F.coalesce(~bad & (top > 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    base = persisted(
        rows.select(
            "vec_id",
            F.when(usable, F.concat_ws(":", F.col("label").cast("string"), F.size("v").cast("string"))).alias("space"),
            F.when(usable, F.transform("v", lambda x: x / top)).alias("scaled"),
            F.when(usable, F.xxhash64("label", "v")).alias("k1"),
            F.when(usable, F.xxhash64("v", "label", F.lit(1))).alias("k2"),
        ),
        "vectors",
    )
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    nodes = persisted(
        base.filter("space IS NOT NULL")
        .groupBy("k1", "k2", "space")
        .agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("scaled").alias("scaled"))
        .withColumn("norm", norm)
        .select("k1", "k2", "space", "node", "copies", F.transform("scaled", lambda x: x / F.col("norm")).alias("vector")),
        "nodes",
    )
    blocks = persisted(_blocks(_members(nodes, sample_rows, least), block), "blocks")

    def built(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        ids = group["node"].to_numpy()
        near = prune(np.array(group["vector"].tolist()))
        return pd.DataFrame({"node": ids, "near": [ids[n] for n in near]})

    key = ["space", "shard", "a", "b"]
    adjacent = blocks.groupBy(*key).applyInPandas(built, ADJACENT)
    united = adjacent.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    def searched(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        ids = group["node"].to_numpy()
        # lists also name nodes of other blocks, which are searched there
        lists = [n for n in group["near"]]
        flat = np.concatenate(lists) if len(lists) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(ids)), [len(n) for n in lists])
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        here = ids[at] == flat
        vectors_here = np.array(group["vector"].tolist())
        near = neighbours(vectors_here, of[here], at[here])
        links = search_block(vectors_here, near, np.flatnonzero(ids % AUDIT_EVERY == 0), least)
        # the shards before this one, as bits
        shard = int(group["shard"].iloc[0])
        before = np.zeros((len(ids), shard), bool)
        for i, shards in enumerate(group["shards"]):
            before[i, [x for x in shards if x < shard]] = True
        bits = np.packbits(before, axis=1)
        part = group["part"].to_numpy()
        n = np.zeros(len(ids), np.int64)
        copies = group["copies"].to_numpy()
        linked = np.flatnonzero(links.any(axis=1))
        for i in linked:
            owned = links[i] & ~(bits & bits[i]).any(axis=1)
            if group["a"].iloc[0] != group["b"].iloc[0]:
                owned &= part != part[i]
            n[i] = copies[owned].sum()
        root = roots(links[np.ix_(linked, linked)])
        return pd.DataFrame({"node": ids[linked], "n": n[linked], "root": ids[linked[root]]})

    found = persisted(
        blocks.join(united, "node").groupBy(*key).applyInPandas(searched, LINKED), "found"
    )
    groups = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    linked = found.groupBy("node").agg(F.sum("n").alias("n"))
    of_node = (
        nodes.select("k1", "k2", "node", "copies")
        .join(linked, "node", "left")
        .join(groups, "node", "left")
        .select(
            "k1", "k2",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    return (
        base.select("vec_id", "k1", "k2")
        .join(of_node, ["k1", "k2"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
            F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
        )
    )


@query()
def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and groups of all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
