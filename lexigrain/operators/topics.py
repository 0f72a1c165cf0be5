"""Topics by variational inference in blocks of documents, with topics x words as a table.

The model is latent Dirichlet allocation over scaled TF-IDF, fitted as ``pyspark.ml``'s online optimiser
does with all documents in every iteration. Words are dealt out to ranges and documents to blocks. In an
iteration each range sends every block the weights of the words that the block holds, blocks infer the
topics of their documents and send back one sum per word, and ranges add these up. The driver sees a few
numbers per topic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain.operators import word_blocks
from lexigrain.operators.word_blocks import WordBlocks
from lexigrain.session import persisted

#: Words of documents that are inferred together.
PART_WORDS = 32_000
#: Times the words that other blocks hold, as every block gets the weights of its words in each iteration.
BLOCK_TIMES = 4
#: Slows the first iterations down, and how fast later ones weigh less.
DELAY, DECAY = 1024, 0.51
#: Shape of the random starts, whose mean is 1.
SHAPE = 100.0
#: Mean change of a document's topics that ends its inference.
TOLERANCE = 1e-3


def digamma(x: np.ndarray) -> np.ndarray:
    """The series at x + 6, less the six reciprocals from x on, of which two share a denominator each."""
    x = np.asarray(x, dtype=float)
    y, t = x + 6, x * (x + 5)
    r = 1 / (y * y)
    series = np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    return series - (2 * x + 5) * (1 / t + 1 / (t + 4) + 1 / (t + 6))


def trigamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, dtype=float), np.zeros(np.shape(x))
    for _ in range(6):
        low = x < 6
        out += np.where(low, 1 / (x * x), 0.0)
        x += low
    r = 1 / (x * x)
    return out + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def starts(keys: np.ndarray, topics: int, seed: int) -> np.ndarray:
    """Per key and topic a draw from the gamma distribution of shape 100 and mean 1 (Wilson and Hilferty)."""
    with np.errstate(over="ignore"):
        cell = keys.astype(np.uint64)[:, None] + np.arange(2 * topics, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        z = (cell + np.uint64(seed) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    u = ((z >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
    normal = np.sqrt(-2 * np.log(u[:, :topics])) * np.cos(2 * np.pi * u[:, topics:])
    return (1 - 1 / (9 * SHAPE) + normal / (3 * np.sqrt(SHAPE))) ** 3


def _shares(gamma: np.ndarray) -> np.ndarray:
    found = digamma(np.vstack([gamma, gamma.sum(axis=0)]))
    return np.exp(found[:-1] - found[-1])


def inferred(words: np.ndarray, values: np.ndarray, sizes: np.ndarray, gamma: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Topics (topics x documents) of documents that are not empty.

    ``words`` are the topics' weights of each entry (topics x entries), ``values`` the entries' values and
    ``sizes`` the entries of each document; ``gamma`` is the start. Each document stops on its own. Documents
    of like sizes are filled up to the largest one with entries of no value, and multiplied together.
    """
    out, first = np.empty(gamma.shape), np.cumsum(sizes) - sizes
    by = np.argsort(sizes, kind="stable")
    while len(by):
        like = np.searchsorted(sizes[by], sizes[by[0]] * 1.25 + 4, side="right")
        docs, by = by[:like], by[like:]
        place = np.arange(sizes[docs[-1]])
        inside = place < sizes[docs][:, None]
        at = np.where(inside, first[docs][:, None] + place, 0)
        filled = np.ascontiguousarray(words[:, at].transpose(1, 0, 2))
        out[:, docs] = _converged(filled, np.where(inside, values[at], 0.0), gamma[:, docs], alpha[:, None])
    return out


def _converged(words: np.ndarray, values: np.ndarray, gamma: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Topics of documents with equally many entries; ``words`` is documents x topics x entries."""
    out, gamma, at = np.empty(gamma.shape), gamma.copy(), np.arange(len(values))
    running = np.ones(len(values), dtype=bool)
    while True:
        while 2 * running.sum() > len(running):
            share = _shares(gamma)
            ratio = values / ((share.T[:, None] @ words)[:, 0] + 1e-100)
            new = share * (words @ ratio[:, :, None])[:, :, 0].T + alpha
            change = np.abs(new - gamma).mean(axis=0)
            gamma[:, running] = new[:, running]
            running &= change > TOLERANCE
        out[:, at[~running]] = gamma[:, ~running]
        if not running.any():
            return out
        words, values, gamma, at = words[running], values[running], gamma[:, running], at[running]
        running = running[running]


def _binary(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=kind) for x in column]


def _coded(rows: pa.Table, links: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of each row, their places among the words of ``links`` and scaled TF-IDF."""
    text, offsets = word_blocks.flat(rows["_words"])
    known, _ = word_blocks.flat(links["words"])
    at = word_blocks.places(text, pa.chunked_array([known]))
    row = np.repeat(np.arange(len(rows), dtype=np.int64), np.diff(offsets))[at >= 0]
    pairs, n = np.unique(row << 32 | at[at >= 0], return_counts=True)
    row, at = pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.int32)
    raw = n * np.concatenate([np.zeros(0), *_binary(links["idf"], float)])[at]
    # a word of all documents weighs nothing
    row, at, raw = row[raw > 0], at[raw > 0], raw[raw > 0]
    norm = np.sqrt(np.bincount(row, raw * raw, len(rows)))
    return np.bincount(row, minlength=len(rows)), at, (raw / norm[row]).astype(np.float32)


def _by_size(rows: pa.Table, sizes: np.ndarray, at: np.ndarray, values: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Rows and their entries in order of their number of entries, so that a range has documents of like sizes."""
    by = np.argsort(sizes, kind="stable")
    lengths = sizes[by]
    first, into = np.cumsum(sizes) - sizes, np.cumsum(lengths) - lengths
    entry = np.arange(len(at)) + np.repeat(first[by] - into, lengths)
    return rows.take(pa.array(by)), lengths, at[entry], values[entry]


def _parts(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows of about ``PART_WORDS`` entries each."""
    if not len(sizes):
        return []
    part = (np.cumsum(sizes) - sizes) // PART_WORDS
    first = np.flatnonzero(np.diff(part, prepend=-1))
    return list(zip(first.tolist(), [*first[1:].tolist(), len(sizes)], strict=True))


def _stacked(pieces: pa.Table, topics: int) -> np.ndarray:
    found = _binary(pieces["x"], np.float32)
    return (np.concatenate(found) if found else np.zeros(0, np.float32)).reshape(-1, topics)


def _table(rows: Iterable[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True)
    data = [list(c) for c in columns] or [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(data, schema, strict=True)], schema=schema)


def _links(rows: pa.Table, words: pa.Array, at: np.ndarray, idf: np.ndarray) -> pa.Table:
    """One row per block of the rows, which are in order of blocks."""
    block = rows["_block"].to_numpy()
    first = np.flatnonzero(np.diff(block, prepend=-1))
    ends = np.append(first, len(block)).astype(np.int32)
    columns = {
        "_range": pa.array(np.full(len(first), rows["_range"][0].as_py() if len(rows) else 0, dtype=np.int32)),
        "_block": pa.array(block[first].astype(np.int32)),
        "words": pa.ListArray.from_arrays(pa.array(ends), words),
    }
    for name, values in (("places", at.astype(np.int32)), ("idf", idf.astype(float))):
        columns[name] = pa.array([values[lo:hi].tobytes() for lo, hi in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
    return pa.table(columns)


_PIECE = pa.schema([("_block", pa.int32()), ("_range", pa.int32()), ("x", pa.binary()), ("sums", pa.list_(pa.float64()))])
_STATE = pa.schema([("_range", pa.int32()), ("x", pa.binary()), ("sums", pa.list_(pa.float64()))])
_CODED = pa.schema(
    [("_block", pa.int32()), ("_part", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary()), ("at", pa.binary()), ("value", pa.binary())]
)
PIECE = "_block int, _range int, x binary, sums array<double>"
STATE = "_range int, x binary, sums array<double>"
LINKS = "_range int, _block int, words array<string>, places binary, idf binary"
CODED = "_block int, _part int, keys binary, sizes binary, at binary, value binary"


@dataclass(frozen=True)
class Topics:
    """A fitted model. ``links`` (range, block, words, places, idf), ``state`` (range, weights), ``alpha`` per topic."""

    blocks: WordBlocks
    links: DataFrame
    state: DataFrame
    ranges: int
    sums: np.ndarray
    alpha: np.ndarray
    seed: int
    keep: Sequence[str]

    def _by_range(self) -> DataFrame:
        """Links, and weights as a row without block, where their range is."""
        links = self.links.select("_range", "_block", "places", F.lit(None).cast("binary").alias("x"))
        state = self.state.select("_range", F.lit(-1).alias("_block"), F.lit(None).cast("binary").alias("places"), "x")
        return links.unionByName(state).repartitionById(self.ranges, F.col("_range"))

    def _sent(self) -> DataFrame:
        """The weights of each block's words, not yet divided by the sums of their topics."""
        topics = len(self.alpha)

        def send(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("_block")
            weights = np.frombuffer(rows["x"][0].as_buffer()).reshape(-1, topics)
            x, links = np.exp(digamma(weights)).astype(np.float32), rows.slice(1)
            found = zip(links["_block"].to_pylist(), links["_range"].to_pylist(), _binary(links["places"], np.int32), strict=True)
            return _table(((b, r, x[p].tobytes(), None) for b, r, p in found), _PIECE)

        return self._by_range().groupBy("_range").applyInArrow(send, PIECE)

    def _scale(self) -> np.ndarray:
        return np.exp(-digamma(np.maximum(self.sums, 1e-2)))

    def next(self, coded: str, iteration: int) -> Topics:
        """The model after one more iteration over all documents, whose entries are stored by block in ``coded``."""
        topics, alpha, scale, seed = len(self.alpha), self.alpha, self._scale(), self.seed + iteration
        rate, eta = (DELAY + iteration) ** -DECAY, 1 / len(self.alpha)

        def infer(pieces: pa.Table) -> pa.Table:
            parts = word_blocks.stored_of(coded, pieces["_block"][0].as_py(), _CODED.remove(0)).sort_by("_part")
            pieces = pieces.sort_by("_range")
            weights = _stacked(pieces, topics) * scale
            found, change, docs = [], np.zeros(topics), 0
            columns = [_binary(parts[c], kind) for c, kind in _KINDS.items()]
            for keys, sizes, at, value in zip(*columns, strict=True):
                words = np.ascontiguousarray(weights[at].T)
                gamma = inferred(words, value, sizes, starts(keys, topics, seed).T, alpha)
                share = np.repeat(_shares(gamma), sizes, axis=1)
                found.append((share * (value / ((words * share).sum(axis=0) + 1e-100))).astype(np.float32))
                change += (digamma(gamma) - digamma(gamma.sum(axis=0))).sum(axis=1)
                docs += len(sizes)
            if not found:
                return _table([], _PIECE)
            at, values = np.concatenate(columns[2]), np.concatenate(found, axis=1)
            total = np.stack([np.bincount(at, v, len(weights)) for v in values], axis=1)
            total = (total * weights).astype(np.float32)
            ends = np.cumsum([len(x) for x in _binary(pieces["x"], np.float32)]) // topics
            sums = [[*change, float(docs)]] + [None] * (len(ends) - 1)
            blocks, ranges = pieces["_block"].to_pylist(), pieces["_range"].to_pylist()
            return _table(zip(blocks, ranges, [x.tobytes() for x in np.split(total, ends[:-1])], sums, strict=True), _PIECE)

        def update(rows: pa.Table, pieces: pa.Table) -> pa.Table:
            rows, pieces = rows.sort_by("_block"), pieces.sort_by("_block")
            weights = np.frombuffer(rows["x"][0].as_buffer()).reshape(-1, topics)
            places = dict(zip(rows["_block"].to_pylist()[1:], _binary(rows["places"].slice(1), np.int32), strict=True))
            total, sums = np.zeros(weights.shape), np.zeros(topics + 1)
            for b, x, more in zip(pieces["_block"].to_pylist(), _binary(pieces["x"], np.float32), pieces["sums"].to_pylist(), strict=True):
                total[places[b]] += x.reshape(-1, topics)
                sums += more or 0
            new = (1 - rate) * weights + rate * (total + eta)
            return _table([(rows["_range"][0].as_py(), new.tobytes(), [*new.sum(axis=0), *sums])], _STATE)

        sent = self._sent().repartitionById(self.blocks.n, F.col("_block")).groupBy("_block")
        back = sent.applyInArrow(infer, PIECE).repartitionById(self.ranges, F.col("_range"))
        state = persisted(self._by_range().groupBy("_range").cogroup(back.groupBy("_range")).applyInArrow(update, STATE), "topics")
        found = _sums(state, 2 * topics + 1)
        return replace(self, state=state, sums=found[:topics], alpha=_alpha(alpha, found[topics:-1], found[-1], rate))

    def on(self, df: DataFrame, tokens: str = "tokens", keep: Sequence[str] = ("doc_id",)) -> Topics:
        """The same model for the rows of ``df``, whose words that it does not know are left out."""
        blocks = WordBlocks.deal(df, F.col(tokens), F.xxhash64(*keep, tokens), keep, times=BLOCK_TIMES)
        asked = blocks.words().select(_range("word", self.ranges), "_block", "word")

        def link(rows: pa.Table, known: pa.Table) -> pa.Table:
            texts, _ = word_blocks.flat(known["words"])
            rows = rows.sort_by([("_block", "ascending"), ("word", "ascending")])
            found = word_blocks.places(rows["word"].combine_chunks(), pa.chunked_array([texts]))
            rows, found = rows.filter(pa.array(found >= 0)), found[found >= 0]
            place = np.concatenate([np.zeros(0, np.int32), *_binary(known["places"], np.int32)])[found]
            idf = np.concatenate([np.zeros(0), *_binary(known["idf"], float)])[found]
            return _links(rows, rows["word"].combine_chunks(), place, idf)

        both = asked.groupBy("_range").cogroup(self.links.groupBy("_range"))
        return replace(self, blocks=blocks, links=persisted(both.applyInArrow(link, LINKS), "links"), keep=keep)

    def distributions(self) -> DataFrame:
        """Kept columns and ``topicDistribution``, an array of shares, zeros for a row without words."""
        topics, alpha, scale, seed, keep = len(self.alpha), self.alpha, self._scale(), self.seed, list(self.keep)
        links = self.links.select("_block", "_range", "words", "idf", F.lit(None).cast("binary").alias("x"))
        sent = self._sent().select(
            "_block", "_range", F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("binary").alias("idf"), "x"
        )

        def shares(rows: pa.Table, known: pa.Table) -> pa.Table:
            known = known.sort_by("_range")
            sent = known["x"].is_valid()
            pieces, links = known.filter(sent), known.filter(known["words"].is_valid())
            rows, sizes, at, values = _by_size(rows, *_coded(rows, links))
            keys, weights = rows["_place"].to_numpy(), _stacked(pieces, topics) * scale
            out, ends = np.zeros((len(rows), topics)), np.cumsum(sizes)
            for lo, hi in _parts(sizes):
                full = np.flatnonzero(sizes[lo:hi]) + lo
                if len(full):
                    part = slice(ends[lo] - sizes[lo], ends[hi - 1])
                    words = np.ascontiguousarray(weights[at[part]].T)
                    gamma = inferred(words, values[part], sizes[full], starts(keys[full], topics, seed).T, alpha)
                    out[full] = (gamma / gamma.sum(axis=0)).T
            return rows.select(keep).append_column("topicDistribution", word_blocks.ragged(out))

        kept = [self.blocks.rows.schema[c] for c in keep]
        share = T.StructField("topicDistribution", T.ArrayType(T.DoubleType()))
        return self.blocks.meet(links.unionByName(sent), shares, T.StructType([*kept, share]))

    def words(self, n: int = 10) -> DataFrame:
        """``topic, rk, term``: the strongest words of each topic, equal ones by word."""
        topics = len(self.alpha)
        rows = self.links.select("_range", "_block", "words", "places", F.lit(None).cast("binary").alias("x"))
        state = self.state.select(
            "_range", F.lit(-1).alias("_block"), F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("binary").alias("places"), "x"
        )
        schema = pa.schema([("topic", pa.int32()), ("term", pa.string()), ("weight", pa.float64())])

        def best(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("_block")
            weights = np.frombuffer(rows["x"][0].as_buffer()).reshape(-1, topics)
            links = rows.slice(1)
            texts, _ = word_blocks.flat(links["words"])
            where = np.empty(len(weights), dtype=np.int64)
            at = np.concatenate(_binary(links["places"], np.int32))
            where[at] = np.arange(len(at))
            out = []
            for topic, x in enumerate(weights.T):
                # words are numbered in their order
                top = np.argsort(-x, kind="stable")[:n]
                out += [(topic, texts[int(where[i])].as_py(), float(x[i])) for i in top]
            return _table(out, schema)

        found = rows.unionByName(state).groupBy("_range").applyInArrow(best, "topic int, term string, weight double")
        rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.col("weight").desc(), "term"))
        return found.select("topic", rank.alias("rk"), "term").filter(F.col("rk") <= n)


_KINDS = {"keys": np.int64, "sizes": np.int32, "at": np.int32, "value": np.float32}


def _range(word: str, ranges: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(ranges)).cast("int").alias("_range")


def _sums(state: DataFrame, n: int) -> np.ndarray:
    found = state.agg(*(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(n))).first()
    return np.array([x or 0.0 for x in found])


def _alpha(alpha: np.ndarray, change: np.ndarray, docs: float, rate: float) -> np.ndarray:
    """A weighted Newton step for the topics' shares in documents, as long as all stay positive."""
    if not docs:
        return alpha
    slope = docs * (digamma(alpha.sum()) - digamma(alpha) + change / docs)
    shared, own = docs * trigamma(alpha.sum()), -docs * trigamma(alpha)
    common = (slope / own).sum() / (1 / shared + (1 / own).sum())
    new = alpha - rate * (slope - common) / own
    return new if (new > 0).all() else alpha


@dataclass(frozen=True)
class TopicModel:
    """Fits ``topics`` on arrays of words; see ``fit``."""

    topics: int
    seed: int
    iterations: int

    def getSubsamplingRate(self) -> float:  # noqa: N802, named as in pyspark.ml
        """Every iteration reads every document once."""
        return 1.0

    def fit(self, df: DataFrame, tokens: str = "tokens", keep: Sequence[str] = ("doc_id",)) -> Topics:
        """Topics of the rows' words, weighted by IDF, each row scaled to length 1; columns ``keep`` go with the rows.

        All words count. Null and empty arrays hold none and are counted as documents. Repeated rows count
        as often as they occur.
        """
        topics, seed = self.topics, self.seed
        blocks = WordBlocks.deal(df, F.col(tokens), F.xxhash64(*keep, tokens), keep, times=BLOCK_TIMES)
        used, docs = persisted(blocks.words(), "used"), blocks.rows.count()
        # a range holds texts, places and weights of its words
        ranges = word_blocks.buckets(df, used.count(), 8 * topics)
        dealt = used.select(_range("word", ranges), "_block", "word", "rows")

        def link(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("_block", "ascending"), ("word", "ascending")])
            words = rows["word"].combine_chunks()
            known = words.unique().sort()
            at = word_blocks.places(words, pa.chunked_array([known])).astype(np.int32)
            frequency = np.bincount(at, rows["rows"].to_numpy(), len(known))
            idf = np.log((docs + 1) / (frequency + 1))
            return _links(rows, words, at, idf[at])

        linked = persisted(dealt.repartitionById(ranges, F.col("_range")).groupBy("_range").applyInArrow(link, LINKS), "links")

        def code(rows: pa.Table, links: pa.Table) -> pa.Table:
            rows, links = rows.sort_by("_place"), links.sort_by("_range")
            rows, sizes, at, values = _by_size(rows, *_coded(rows, links))
            keys, ends, out = rows["_place"].to_numpy(), np.cumsum(sizes), []
            for i, (lo, hi) in enumerate(_parts(sizes)):
                full, part = np.flatnonzero(sizes[lo:hi]) + lo, slice(ends[lo] - sizes[lo], ends[hi - 1])
                if len(full):
                    columns = zip((keys[full], sizes[full], at[part], values[part]), _KINDS.values(), strict=True)
                    out.append((rows["_block"][0].as_py(), i, *(x.astype(kind).tobytes() for x, kind in columns)))
            return _table(out, _CODED)

        def start(rows: pa.Table) -> pa.Table:
            words = word_blocks.flat(rows["words"])[0].unique().sort()
            x = starts(_hashed(words), topics, seed)
            return _table([(rows["_range"][0].as_py(), x.tobytes(), x.sum(axis=0).tolist())], _STATE)

        # read by the tasks of every iteration and never exchanged
        coded = word_blocks.stored_by(blocks.meet(linked.select("_block", "_range", "words", "idf"), code, CODED), "_block", "coded")
        state = persisted(
            linked.select("_range", "words").repartitionById(ranges, F.col("_range")).groupBy("_range").applyInArrow(start, STATE), "topics"
        )
        alpha = np.full(topics, 1 / topics)
        model = Topics(blocks, linked, state, ranges, _sums(state, topics), alpha, seed, keep)
        for i in range(1, self.iterations + 1 if model.sums.any() else 1):
            model = model.next(coded, i)
        return model


def _hashed(words: pa.Array) -> np.ndarray:
    """A number per word that does not depend on the other words."""
    found = (hashlib.blake2b(w.encode(), digest_size=8).digest() for w in words.to_pylist())
    return np.frombuffer(b"".join(found), dtype=np.uint64)
