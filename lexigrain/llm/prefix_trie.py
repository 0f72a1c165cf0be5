"""The prefix trie of conversations, by ROLLUP over blocks of turn columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrain.llm.common import query, table
from lexigrain.session import persisted, shuffle_width

#: Turns of the first blocks; later blocks are as wide as the last. Most conversations end in the
#: first. Spark takes at most 64 grouping sets.
WIDTHS = (8, 16, 48)
#: Ids that differ only in so many last bits are joined in one row before the digest.
ID_RANGE_BITS = 12
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """Twenty bytes that stand for a turn: a digest of role and text, and the bytes of the text.

    The digest covers the length of the role, so no two pairs are joined to one string.
    """
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"))
    size = F.lpad(F.hex(F.octet_length(text).cast("bigint")), 8, "0")
    return F.unhex(F.concat(digest, size))


def _text_bytes(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 17, 4)), 16, 10).cast("bigint")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, id``: every turn's place from 1, by turn (null first), equal ones by id."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "id"))
    return turns.select("conv_id", place.cast("bigint").alias("pos"), "id")


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """``conv_id, pos, id`` of rebuilt conversations, and ``conv_id, null, null`` of turnless ones.

    The first h turns of conversation c are replaced by those of conversation c - c % ``every``,
    where h is the crc32 of c as text modulo ``most``; fewer if it has fewer, none without it.
    """
    placed = persisted(ordered_turns(turns), "turns")
    conv = F.col("conv_id")
    sizes = placed.groupBy("conv_id").agg(F.max("pos").alias("size"))
    base = (conv - conv % every).alias("base")
    head = (F.crc32(conv.cast("string").cast("binary")) % most).alias("head")
    heads = sizes.select("conv_id", base, head)
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    shift = F.least("head", F.coalesce("base_size", F.lit(0))) - F.col("head")
    known = heads.join(of_base, "base", "left").select("conv_id", "base", "head", shift.alias("shift"))
    own = placed.join(known, "conv_id").filter(F.col("pos") > F.col("head"))
    own = own.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "id")
    # at most ``most`` turns of a base meet at most ``every`` conversations
    first = placed.filter(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    lent = first.join(known, "base").filter(F.col("pos") <= F.col("head")).select("conv_id", "pos", "id")
    blank = sizes.select("conv_id", F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("id"))
    return own.unionByName(lent).unionByName(blank)


def _starts(length: int, widths: tuple[int, ...] = WIDTHS) -> list[tuple[int, int]]:
    """First turn (from 0) and width of each block that conversations of ``length`` turns need."""
    out, at = [], 0
    while not out or at < length:
        out.append((at, widths[min(len(out), len(widths) - 1)]))
        at += out[-1][1]
    return out


def _rollup(rows: DataFrame, width: int, aggregates: str) -> DataFrame:
    """All prefixes of a block's turn columns, below each node that the block goes on from.

    ``level`` is the number of turns; ``path`` has their ids. Groups that end in the null after
    a conversation's last turn are no prefixes.
    """
    columns = [f"t{i}" for i in range(1, width + 1)]
    wide = rows.select("*", *[F.get("ids", F.lit(i)).alias(c) for i, c in enumerate(columns)]).drop("ids")
    grouped = rows.sparkSession.sql(
        f"""
        SELECT prior, {width} - bit_count(grouping_id()) AS level,
            array({', '.join(columns)}) AS row, {aggregates}
        FROM {{wide}} GROUP BY prior, ROLLUP({', '.join(columns)})
        """,
        wide=wide,
    )
    path = F.slice("row", F.lit(1), F.col("level"))
    ends_in_null = (F.col("level") > 0) & F.get("row", F.col("level") - 1).isNull()
    return grouped.filter(~ends_in_null).withColumn("path", path).drop("row")


def _digests(ends: DataFrame) -> DataFrame:
    """``node, depth, ends_sha256`` of ``node, depth, conv_id``: ids in ascending order, joined.

    Ids of one range are joined first, 4,096 at most in a row. The rows of a node are then
    read in order as a stream, so a node in which very many conversations end is never held whole.
    """
    ranges = ends.groupBy("node", "depth", F.shiftright("conv_id", ID_RANGE_BITS).alias("range")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def digest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for node, depth, ids in zip(batch["node"], batch["depth"], batch["ids"]):
                if at == (node, depth):
                    state.update(b",")
                else:
                    if at:
                        done.append((*at, state.hexdigest()))
                    at, state = (node, depth), hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=["node", "depth", "ends_sha256"])
        if at:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=["node", "depth", "ends_sha256"])

    return (
        ranges.repartition(shuffle_width(ends.sparkSession), "node", "depth")
        .sortWithinPartitions("node", "depth", "range")
        .mapInPandas(digest, "node long, depth long, ends_sha256 string")
    )


def _blocks(sequences: DataFrame, starts: list[tuple[int, int]]) -> DataFrame:
    """``conv_id, block, ids, n_turns``: the turn ids of each block, and the conversation's length."""
    block = F.lit(0)
    for number, (start, _) in enumerate(starts):
        block = F.when(F.col("pos") > start, number).otherwise(block)
    turn = F.when(F.col("id").isNotNull(), F.struct("pos", "id"))
    return (
        sequences.repartition(shuffle_width(sequences.sparkSession), "conv_id")
        .groupBy("conv_id", block.alias("block"))
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.max("pos").alias("last"))
        .select(
            "conv_id",
            "block",
            F.col("turns.id").alias("ids"),
            F.coalesce(F.max("last").over(Window.partitionBy("conv_id")), F.lit(0)).alias("n_turns"),
        )
    )


def trie(sequences: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """The prefix trie of ``conv_id, pos, id``: one row per distinct sequence of first turns.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. A smallest member and a depth name a node.
    ``pos`` counts from 1 without gaps; a row with null ``pos`` and ``id`` names a conversation that
    may have no turn. No row gives no node, not even a root.

    A block of turn columns is rolled up at once. Conversations that go on take part in the next
    block, below the node they have reached; where only one has reached it, its further prefixes are
    its alone and are listed as they are, so blocks end with the longest prefix that is shared. Subtree sums need no walk: every node counts for
    its smallest member, so a subtree's sum is that of its members, which a second ROLLUP gives,
    less what the node's own smallest member has above it.
    """
    longest = sequences.agg(F.max("pos")).first()[0] or 0
    starts = _starts(longest, widths)
    rows = persisted(_blocks(sequences, starts), "blocks")
    later = persisted(rows.filter("block > 0"), "later") if len(starts) > 1 else rows
    same = F.col("l.prior").eqNullSafe(F.col("r.prior")) & (F.col("l.path") == F.col("r.path"))
    taking_part, nodes, ends, alone = [], [], [], []
    prior: DataFrame | None = None
    for number, (start, width) in enumerate(starts):
        here = (later if number else rows).filter(F.col("block") == number).drop("block")
        if prior is None:
            here = here.withColumn("prior", F.lit(None).cast("bigint"))
        else:
            here = persisted(here.join(prior, "conv_id"), "block")
        taking_part.append((here, start, width))
        found = _rollup(here.select("conv_id", "ids", "prior"), width, "min(conv_id) AS node, count(*) AS n_convs")
        found = persisted(found.filter("level > 0") if number else found, "nodes")
        by_path = found.select("prior", "path", "node", "n_convs").alias("r")
        reached = persisted(
            here.withColumnRenamed("ids", "path").alias("l").join(by_path, same)
            .select("l.conv_id", "n_turns", (F.lit(start) + F.size("l.path")).cast("bigint").alias("depth"), "r.node", "n_convs"),
            "reached",
        )
        depth = (F.lit(start) + F.col("level")).cast("bigint").alias("depth")
        ends.append(reached.filter("depth = n_turns").select("conv_id", "node", "depth"))
        alone.append(reached.filter("depth < n_turns AND n_convs = 1").select("conv_id", "depth", "n_turns"))
        prior = reached.filter("depth < n_turns AND n_convs > 1").select("conv_id", F.col("node").alias("prior"))
        size = F.when(F.col("level") > 0, _text_bytes(F.element_at("path", -1))).otherwise(0)
        sized = found.withColumn("value", (F.col("n_convs") - 1) * size)
        columns = [F.col("l.node").alias("conv_id"), depth, "parent_conv_id", "n_convs", "value"]
        # a block's first nodes hang on the one they go on from; the root on none
        top = sized.filter(F.col("level") == (1 if number else 0)).withColumn("parent_conv_id", F.col("prior"))
        nodes.append(top.alias("l").select(*columns))
        inner = sized.filter(F.col("level") > (1 if number else 0))
        upper = F.slice("path", F.lit(1), F.col("level") - 1)
        hung = inner.withColumn("path", upper).alias("l").join(by_path, same)
        nodes.append(hung.select(*columns[:2], F.col("r.node").alias("parent_conv_id"), "l.n_convs", "value"))
        if number + 1 < len(starts) and prior.isEmpty():
            break

    lonely = reduce(DataFrame.unionByName, alone)
    ends.append(lonely.select("conv_id", F.col("conv_id").alias("node"), F.col("n_turns").alias("depth")))
    further = F.explode(F.sequence(F.col("depth") + 1, F.col("n_turns"))).alias("depth")
    nodes.append(
        lonely.select("conv_id", further).select(
            "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"),
            F.lit(1).cast("bigint").alias("n_convs"), F.lit(0).cast("bigint").alias("value"),
        )
    )
    listed = persisted(reduce(DataFrame.unionByName, nodes), "listed")
    children = listed.filter("depth > 0").groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    known = persisted(
        listed.join(children, ["conv_id", "depth"], "left").fillna(0, ["n_children"]), "known"
    )
    carried = persisted(
        known.groupBy("conv_id").agg(F.sum("value").alias("value"), F.count_if(F.col("n_children") == 0).alias("leaves")),
        "carried",
    )
    sums = []
    for here, start, width in taking_part:
        loaded = here.select("conv_id", "ids", "prior").join(carried, "conv_id", "left")
        summed = _rollup(
            loaded, width,
            "min(conv_id) AS conv_id, coalesce(sum(value), 0) AS total, coalesce(sum(leaves), 0) AS n_leaves",
        )
        summed = summed.filter("level > 0") if start else summed
        depth = (F.lit(start) + F.col("level")).cast("bigint").alias("depth")
        sums.append(summed.select("conv_id", depth, "total", "n_leaves"))
    earlier = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum("value").over(earlier), F.lit(0))
    digests = _digests(reduce(DataFrame.unionByName, ends)).withColumnRenamed("node", "conv_id")
    return (
        known.withColumn("above", above)
        .join(reduce(DataFrame.unionByName, sums), ["conv_id", "depth"], "left")
        .join(digests, ["conv_id", "depth"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
            F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
            F.coalesce(F.col("total") - F.col("above"), F.lit(0)).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(EMPTY_DIGEST)).alias("ends_sha256"),
        )
    )


def prefix_trie(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """The trie of rebuilt conversations, see :func:`rebuilt` and :func:`trie`.

    Null roles and texts are empty. Turns are ordered by number, null first; equal numbers by the
    digest of role and text. Repeated rows are turns of their own. Rows without a conv_id belong to
    no conversation and are left out. Texts are hashed where they are read, so a turn of any length
    goes on as twenty bytes. An empty table gives no row. Only the four named columns are read.
    """
    rows = turns.select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        turn_id(F.col(role), F.col(text)).alias("id"),
    )
    sequences = rebuilt(rows.filter("conv_id IS NOT NULL"))
    return trie(persisted(sequences, "sequences"))


# crc32 of the digits, bit by bit: a digit is xored in, each -1 shifts
_CRC = """
    xor(list_reduce(
        flatten(list_transform(string_split(cast(conv_id AS VARCHAR), ''),
            lambda ch: [cast(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x)
            ELSE xor(crc >> 1, CASE WHEN crc & 1 = 1 THEN 3988292384 ELSE 0 END) END,
        4294967295), 4294967295)
"""


@query(
    f"""
    WITH turns AS (
        SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
            md5(length(role) || ':' || role || ':' || text), strlen(text)) AS pos
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
        WHERE conv_id IS NOT NULL),
    heads AS (
        SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS head FROM (SELECT DISTINCT conv_id FROM turns)),
    built AS (
        SELECT conv_id, 0 AS part, pos, role, text FROM heads JOIN turns USING (conv_id) WHERE pos > head
        UNION ALL
        SELECT heads.conv_id, -1, pos, role, text FROM heads JOIN turns ON turns.conv_id = base WHERE pos <= head),
    listed AS (
        SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY part, pos) AS seq FROM built GROUP BY conv_id),
    seqs AS (SELECT heads.conv_id, coalesce(seq, []) AS seq FROM heads LEFT JOIN listed USING (conv_id)),
    prefixes AS (
        SELECT conv_id, depth, seq[1:depth] AS path, len(seq) = depth AS ends
        FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM seqs)),
    nodes AS (
        SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
            coalesce(string_agg(CASE WHEN ends THEN cast(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ids
        FROM prefixes GROUP BY path, depth),
    children AS (
        SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
    valued AS (
        SELECT nodes.*, coalesce(n_children, 0) AS n_children,
            CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(path[depth].text) ELSE 0 END AS value
        FROM nodes LEFT JOIN children USING (path)),
    sums AS (
        SELECT path[1:up] AS path, sum(value) AS saved, count_if(n_children = 0) AS n_leaves
        FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM valued) GROUP BY 1)
    SELECT v.conv_id, cast(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs,
        cast(v.n_children AS BIGINT) AS n_children, cast(sums.n_leaves AS BIGINT) AS n_leaves,
        cast(saved AS BIGINT) AS saved_tokens, sha256(v.ids) AS ends_sha256
    FROM valued AS v JOIN sums USING (path)
    LEFT JOIN nodes AS p ON v.depth > 0 AND p.depth = v.depth - 1 AND p.path = v.path[1:v.depth - 1]
    """
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
