"""Near duplicates by SimHash: Golay-code keys of fingerprint segments, then a check of each pair."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm.common import query, spread, table
from lexigrain.llm.components import components
from lexigrain.session import persisted, shuffle_width

SHINGLE, SEED, BITS = 3, 42, 64
MOST_BITS = 3
#: Distinct fingerprints of one key that meet in one task; a key with more is cut into parts, and
#: every pair of parts is a group of its own.
PART = 1 << 14
#: Generator of the perfect binary Golay code of length 23 and dimension 12. (Fixed value.)
GENERATOR = 0xC75
LENGTH, DIMENSION = 23, 12
#: Segments of the 64 bits as (first bit, bits); the last is shorter and filled with zeros.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: object, shingle: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """The words of a text in ASCII lower case, and a hash of each shingle; none without words."""
    import xxhash

    words = text.encode("utf-8", "replace").translate(_LOWER).split() if isinstance(text, str) else []
    joined = b" ".join(words)
    if not words:
        return joined, np.zeros(0, "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return joined, np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist())), "<u8", n
    )


def fingerprint(text: object, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text over the hashes of its word shingles; 0 without words."""
    _, hashes = shingle_hashes(text, shingle)
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _remainders(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator polynomial: the syndromes."""
    words = words.copy()
    for bit in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
        words ^= np.where((words >> bit) & 1, GENERATOR << (bit - (LENGTH - DIMENSION)), 0)
    return words


def _errors() -> np.ndarray:
    """The error of at most three bits for each syndrome; the code is perfect, so there is one."""
    one = 1 << np.arange(LENGTH)
    two = one[:, None] | one
    three = two[:, :, None] | one
    errors = np.unique(np.concatenate([[0], one, two.ravel(), three.ravel()]))
    out = np.zeros(1 << (LENGTH - DIMENSION), np.int64)
    out[_remainders(errors)] = errors
    return out


_ERROR = _errors()


def decode(words: np.ndarray) -> np.ndarray:
    """Index of the codeword within three bits of each 23-bit word: its first twelve bits."""
    return (words ^ _ERROR[_remainders(words)]) >> (LENGTH - DIMENSION)


def near_indices(segments: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of each segment and of all segments one bit away, each index once.

    Two segments at most two bits apart have an index in common: that of themselves, or of a word
    between them. Returns the row of each index and the index. Most segments give six.
    """
    flips = np.concatenate([[0], 1 << np.arange(bits)])
    found = np.sort(decode((segments[:, None] ^ flips).astype(np.int64)), axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(fresh)[0], found[fresh]


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of each fingerprint: which two segments, and an index for each of them.

    Of three bits that differ at most one segment holds three, so two segments hold two or fewer
    each, and both share an index: every pair to be found meets under some key.
    """
    rows, indices = [], []
    for first, bits in SEGMENTS:
        segment = (prints >> np.uint64(first)).astype(np.int64) & ((1 << bits) - 1)
        r, i = near_indices(segment, bits)
        rows.append(r)
        indices.append(i)
    out_rows, out_keys = [], []
    n = len(prints)
    for which, (a, b) in enumerate(PAIRS):
        # each index of the first segment with each of the second, row by row
        count_b = np.bincount(rows[b], minlength=n)
        begin_b = np.cumsum(count_b) - count_b
        times = count_b[rows[a]]
        left = np.repeat(np.arange(len(rows[a])), times)
        inside = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        row = rows[a][left]
        right = begin_b[row] + inside
        out_rows.append(row)
        out_keys.append((which << 24) | (indices[a][left] << 12) | indices[b][right])
    return np.concatenate(out_rows), np.concatenate(out_keys)


def forest(prints: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """Links that join exactly what fingerprints within ``most`` bits join, one per joined print.

    Goes from print to print and compares each with those not yet reached, so a dense group of
    copies costs about one comparison each, and no list of all its pairs is made.
    """
    rest, links = np.arange(len(prints)), []
    while len(rest) > 1:
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = np.bitwise_count(prints[rest] ^ prints[at]) <= most
            if near.any():
                found = rest[near]
                rest = rest[~near]
                links += [(at, int(i)) for i in found]
                reached += found.tolist()
    return links


def _group_links(
    nodes: np.ndarray, prints: np.ndarray, group: np.ndarray, most: int = MOST_BITS
) -> np.ndarray:
    """Links inside each run of equal ``group`` numbers, as rows (u, v) of nodes."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    # neighbours in small groups are compared side by side, distance by distance
    small = np.repeat(sizes <= 16, sizes)
    left, right = [], []
    for step in range(1, min(16, int(sizes.max(initial=1)))):
        same = (group[step:] == group[:-step]) & small[step:]
        near = same & (np.bitwise_count(prints[step:] ^ prints[:-step]) <= most)
        at = np.flatnonzero(near)
        left.append(at)
        right.append(at + step)
    for start, size in zip(starts[sizes > 16], sizes[sizes > 16]):
        links = np.array(forest(prints[start : start + size], most), np.int64).reshape(-1, 2) + start
        left.append(links[:, 0])
        right.append(links[:, 1])
    if not left:
        return np.zeros((0, 2), np.int64)
    u, v = nodes[np.concatenate(left)], nodes[np.concatenate(right)]
    return np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """``doc_id, print`` of every whole text, the 64 bits as a signed number."""

    def computed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "print": found})

    rows = spread(docs, [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")])
    return rows.mapInPandas(computed, "doc_id long, print long")


#: Keys of a fingerprint on average, and all keys there are: a pair of segments and two indices.
KEYS_PER_PRINT, ALL_KEYS = 84, 3 << 2 * DIMENSION


def hot_slots(distinct: DataFrame, part: int) -> tuple[int, DataFrame]:
    """Slots of keys that may hold a key with more than ``part`` prints: their number, and ``slot, parts``.

    A key's slot is its remainder modulo the returned number of slots, which grows with the prints
    up to one slot per key. Every key of every print is counted, first in an array of slots inside
    each task, so one key spread thinly over all tasks is found like any other. A slot's count is
    at least that of each of its keys; ``parts`` is how many parts of ``part`` prints it makes.
    """
    wanted = KEYS_PER_PRINT * distinct.count() * 8 // part
    slots = min(ALL_KEYS, 1 << max(10, wanted.bit_length()))

    def counted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(slots, np.int32)
        for batch in batches:
            _, keys = keys_of(batch["print"].to_numpy(np.int64).view(np.uint64))
            slot, n = np.unique(keys % slots, return_counts=True)
            total[slot] += n.astype(np.int32)
        met = np.flatnonzero(total)
        for at in range(0, len(met), 1 << 16):
            some = met[at : at + (1 << 16)]
            yield pd.DataFrame({"slot": some.astype(np.int32), "n": total[some].astype(np.int64)})

    hot = (
        distinct.select("print")
        .mapInPandas(counted, "slot int, n long")
        .groupBy("slot")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") > part)
        .select("slot", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    )
    return slots, persisted(hot, "hot-slots")


def near_links(distinct: DataFrame, part: int = PART, most: int = MOST_BITS) -> DataFrame:
    """Links ``u, v`` between nodes whose fingerprints differ in at most ``most`` (three) bits.

    ``distinct`` is a stored table ``node, print`` with one row per fingerprint. Not all pairs are
    returned, but every linked pair is connected by links inside some key.

    First all keys are counted. A key that may have more than ``part`` prints is cut into parts by a
    hash, and each pair of its parts becomes a group, so a group has about twice ``part`` prints and
    none of its pairs is lost. Then keys are shuffled, sorted, and read as a stream of groups.
    """
    if most > 3:
        raise ValueError("two segments share an index up to three differing bits only")
    spark = distinct.sparkSession
    slots, hot = hot_slots(distinct, part)

    def keyed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = batch["print"].to_numpy(np.int64)
            nodes = batch["node"].to_numpy(np.int64)
            rows, keys = keys_of(prints.view(np.uint64))
            yield pd.DataFrame(
                {"key": keys.astype(np.int32), "node": nodes[rows], "print": prints[rows]}
            )

    def linked(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        names = ["key", "a", "b"]

        def links(frame: pd.DataFrame) -> pd.DataFrame:
            changed = (frame[names].to_numpy()[1:] != frame[names].to_numpy()[:-1]).any(axis=1)
            found = _group_links(
                frame["node"].to_numpy(np.int64),
                frame["print"].to_numpy(np.int64).view(np.uint64),
                np.concatenate([[0], np.cumsum(changed)]),
                most,
            )
            return pd.DataFrame(found, columns=["u", "v"])

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) < 100_000:
                continue
            frame = pd.concat(held, ignore_index=True)
            # the last group may go on in the next batch
            same = (frame[names] == frame[names].iloc[-1]).all(axis=1)
            cut = int(same.idxmax())
            if cut:
                yield links(frame.iloc[:cut])
            held = [frame.iloc[cut:]]
        if held:
            yield links(pd.concat(held, ignore_index=True))

    rows = distinct.mapInPandas(keyed, "key int, node long, print long")
    if hot.isEmpty():
        rows = rows.select("key", F.lit(0).alias("a"), F.lit(0).alias("b"), "node", "print")
    else:
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))
        rows = (
            rows.withColumn("slot", F.col("key") % slots)
            .join(hot, "slot", "left")
            .select("key", F.coalesce(own, F.lit(0)).alias("own"), other.alias("other"), "node", "print")
            .select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "print")
        )
    return (
        rows.repartition(shuffle_width(spark), "key", "a", "b")
        .sortWithinPartitions("key", "a", "b")
        .mapInPandas(linked, "u long, v long")
    )


def simhash_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    part: int = PART,
    shingle: int = SHINGLE,
    most: int = MOST_BITS,
) -> DataFrame:
    """Fingerprint and group of every document: ``doc_id, fingerprint, component_id``.

    Fingerprints are over shingles of ``shingle`` words and link at ``most`` or fewer differing bits,
    at most three; the component is the smallest id reachable.
    Documents with one fingerprint are one node, so exact copies are never paired.

    A null text and a text without words have fingerprint 0 and are linked like any other. A null id
    stays null and takes the component of its fingerprint's other documents (null if there are none:
    such documents are no one's link). Repeated rows each give a row. An empty table gives none.
    Only the two named columns are read.
    """
    prints = persisted(fingerprints(docs, doc_id, text, shingle), "prints")
    distinct = persisted(
        prints.groupBy("print").agg(F.min("doc_id").alias("node")).filter("node IS NOT NULL"),
        "nodes",
    )
    groups = components(near_links(distinct, part, most))
    of_print = distinct.join(groups, "node", "left").select(
        "print", F.coalesce("component", "node").alias("component_id")
    )
    return prints.join(of_print, "print", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        "component_id",
    )


@query()
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return simhash_groups(table(spark, sf_dir, "documents"))
