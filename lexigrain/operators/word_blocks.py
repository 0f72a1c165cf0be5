"""Documents dealt out to blocks, each with the values of its own words.

A table of values per word can be as wide as the corpus has words. No task needs all of it: a block of
documents is met by one row per distinct word that it holds, so a frequent word travels once per
block, not once per document, and a group of equal documents is spread by its keys.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain.session import persisted, shared_path, shuffle_width

#: Words of documents, repeats included, that a block holds.
BLOCK_WORDS = 3_000_000
#: Numbers that the values of a block's distinct words may hold.
BLOCK_VALUES = 60_000_000


@dataclass(frozen=True)
class WordBlocks:
    """``rows``: a stored table with ``_place`` and the array ``_words``; ``n`` blocks."""

    rows: DataFrame
    n: int

    @staticmethod
    def deal(df: DataFrame, words: Column, by: Column, keep: Sequence[str] = (), least: int | None = None, times: int = 1) -> WordBlocks:
        """Rows with equal ``by`` share a block; there are at least ``least`` blocks, one per core by default.

        A block holds about ``times`` x ``BLOCK_WORDS`` words. More blocks than cores are a multiple of them, so no core
        waits for a last few. Columns ``keep`` go with the rows. A null array is an empty one.
        """
        full = F.coalesce(words, F.array())
        stored = persisted(df.select(*keep, by.cast("bigint").alias("_place"), full.alias("_words")), "dealt")
        total = stored.agg(F.sum(F.size("_words"))).first()[0] or 0
        cores = df.sparkSession.sparkContext.defaultParallelism
        n = max(cores if least is None else least, -(-total // (times * BLOCK_WORDS)), 1)
        return WordBlocks(stored, -(-n // cores) * cores if n > max(cores, least or 0) else n)

    @property
    def block(self) -> Column:
        return F.pmod("_place", F.lit(self.n)).cast("int")

    def words(self) -> DataFrame:
        """``_block, word, rows``: the distinct words of every block and how many rows hold them."""
        rows = self.rows.select(self.block.alias("_block"), F.explode(F.array_distinct("_words")).alias("word"))
        counted = rows.filter("word IS NOT NULL").groupBy("_block", "word")
        return counted.agg(F.count(F.lit(1)).alias("rows"))

    def meet(self, values: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str | T.StructType) -> DataFrame:
        """What ``work`` makes of each block's rows and of its rows of ``values`` (with ``_block``)."""
        # as many tasks as blocks, which adaptive execution does not merge again
        rows = self.rows.withColumn("_block", self.block).repartitionById(self.n, F.col("_block"))
        sent = values.repartitionById(self.n, F.col("_block"))
        return rows.groupBy("_block").cogroup(sent.groupBy("_block")).applyInArrow(work, schema)


def stored_by(df: DataFrame, column: str, name: str) -> str:
    """Write ``df`` once to the shared folder, a folder for each value of ``column``, for ``stored_of``."""
    path = shared_path(df.sparkSession, name)
    df.withColumnRenamed(column, "part").write.partitionBy("part").parquet(path)
    return path


def stored_of(path: str, part: int, schema: pa.Schema) -> pa.Table:
    """The rows of one value, read inside a task through the file systems that Arrow knows."""
    from pyarrow import fs, parquet

    system, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
    found = system.get_file_info(fs.FileSelector(f"{place}/part={part}", allow_not_found=True))
    files = sorted(f.path for f in found if f.base_name.endswith(".parquet"))
    tables = [parquet.ParquetFile(f, filesystem=system).read(schema.names) for f in files]
    return pa.concat_tables([t.cast(schema) for t in tables]) if tables else schema.empty_table()


def flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The values of an array column without nulls, one after the other, and where each row begins."""
    joined = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    offsets = joined.offsets.to_numpy()
    return joined.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def places(words: pa.Array, known: pa.ChunkedArray) -> np.ndarray:
    """Where each word stands in ``known``; -1 if it does not."""
    found = pc.index_in(words, value_set=pa.concat_arrays(known.chunks) if known.num_chunks else pa.array([], pa.string()))
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False)


def entries(rows: pa.Table, key: str, known: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of rows, null being one, and the known words of every row in order of the keys.

    For every word of a row the place of the row's key, the place of the word in ``known``, and how often
    the row holds it.
    """
    words, starts = flat(rows["_words"])
    keys = pa.concat_arrays(rows[key].chunks).dictionary_encode(null_encoding="encode")
    at = places(words, known)
    row = np.repeat(np.arange(len(rows), dtype=np.int64), np.diff(starts))[at >= 0]
    pairs, n = np.unique(row << 32 | at[at >= 0], return_counts=True)
    owner, at = keys.indices.to_numpy()[pairs >> 32], pairs & 0xFFFFFFFF
    by = np.argsort(owner, kind="stable")
    return keys.dictionary, owner[by], at[by], n[by].astype(float)


def by_label(
    owner: np.ndarray, at: np.ndarray, n: np.ndarray, starts: np.ndarray, label: np.ndarray, value: np.ndarray, labels: int, owners: int
) -> np.ndarray:
    """Per owner and label, the sum of n times the value that an entry's word has for the label.

    The labels and values of word ``w`` stand from ``starts[w]`` to ``starts[w + 1]``.
    """
    out = np.zeros(owners * labels)
    for lo in range(0, len(owner), 1 << 19):
        part = slice(lo, lo + (1 << 19))
        first, times = starts[at[part]], np.diff(starts)[at[part]]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        place = np.repeat(first, times) + inside
        cell = np.repeat(owner[part].astype(np.int64) * labels, times) + label[place]
        # owners are in order, so a part touches few cells
        low = int(owner[part][0]) * labels
        found = np.bincount(cell - low, np.repeat(n[part], times) * value[place])
        out[low : low + len(found)] += found
    return out.reshape(owners, labels)


def maps(keys: list[str], x: np.ndarray) -> pa.Array:
    """Each row of a matrix as a map from the names of its columns."""
    starts = np.arange(len(x) + 1, dtype=np.int32) * np.int32(len(keys))
    return pa.MapArray.from_arrays(pa.array(starts), pa.array(keys * len(x), pa.string()), pa.array(x.ravel()))


def stacked(column: pa.ChunkedArray) -> np.ndarray:
    """Arrays of equal length as the rows of a matrix."""
    values, offsets = flat(column)
    return values.to_numpy(zero_copy_only=False).reshape(len(offsets) - 1, -1) if len(values) else np.zeros((len(offsets) - 1, 0))


def ragged(x: np.ndarray) -> pa.Array:
    starts = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.size else np.zeros(len(x) + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(x.ravel()))


def buckets(df: DataFrame, rows: int, values: int) -> int:
    """Groups that ``rows`` arrays of so many ``values`` are summed in, each of bounded size."""
    return max(shuffle_width(df.sparkSession), -(-rows * values // BLOCK_VALUES))
