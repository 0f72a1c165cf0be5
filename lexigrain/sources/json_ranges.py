"""One large JSON array file read by many tasks, each from a byte range of its own.

A task that starts in the middle of a file cannot see whether it stands inside a string, nor how
deep. Both follow from what comes before, and what a range does to them can be computed without it:
for each of the three states a range can start in (outside a string, inside one, inside one after
a backslash) the state it ends in and the brackets it opens and closes. One job summarises
all ranges so, the driver chains the summaries (a few numbers a range), and a second job reads
from each range the records that begin in it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE_BYTES = 64 << 20
#: Bytes of small ranges that one task reads, if there are enough for all cores.
TASK_BYTES = 16 << 20
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
RANGES = "file string, first long, size long, length long"

# whole stretches without a quote or backslash at once, which never have to be given back
_INNER = rb'[^"\\]*+(?:\\.[^"\\]*+)*+"'
_STRING = re.compile(rb'"' + _INNER, re.S)
_REST = re.compile(_INNER, re.S)
_STRUCTURE = re.compile(rb'"' + _INNER + rb'|["{}\[\]]', re.S)


def read_bytes(path: str, first: int, size: int) -> bytes:
    """``size`` bytes of a file from ``first`` on, through the file systems that Arrow knows."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "/", path)
    system, place = fs.FileSystem.from_uri(uri)
    with system.open_input_file(place) as opened:
        return opened.read_at(size, first)


def _outside(data: bytes) -> tuple[int, int]:
    """End state and net depth of bytes that start outside a string."""
    bare = _STRING.sub(b"", data)
    cut = bare.find(b'"')
    if cut < 0:
        return OUTSIDE, _depth(bare)
    # a string goes on beyond the end; an odd run of backslashes there escapes what follows
    tail = bare[cut + 1 :]
    return (ESCAPED if _odd_backslashes(tail) else INSIDE), _depth(bare[:cut])


def _odd_backslashes(data: bytes) -> bool:
    return (len(data) - len(data.rstrip(b"\\"))) % 2 == 1


def _depth(bare: bytes) -> int:
    return bare.count(b"{") + bare.count(b"[") - bare.count(b"}") - bare.count(b"]")


def leave_string(data: bytes, state: int) -> int:
    """Where bytes that start in ``state`` are outside a string again; -1 if they never are."""
    if state == OUTSIDE:
        return 0
    at = 1 if state == ESCAPED else 0
    end = _REST.match(data, at)
    return end.end() if end else -1


def effect(data: bytes, state: int) -> tuple[int, int]:
    """End state and net depth of bytes that start in ``state``."""
    at = leave_string(data, state)
    if at >= 0:
        return _outside(data[at:])
    if state == ESCAPED and not data:
        return ESCAPED, 0
    tail = data[1:] if state == ESCAPED else data
    return (ESCAPED if _odd_backslashes(tail) else INSIDE), 0


def effects(data: bytes) -> list[tuple[int, int]]:
    """The effect of bytes for each state that they can start in.

    A backslash before the first byte only matters if that is a quote or a backslash itself.
    """
    outside, inside = effect(data, OUTSIDE), effect(data, INSIDE)
    alike = data[:1] not in (b"", b'"', b"\\")
    return [outside, inside, inside if alike else effect(data, ESCAPED)]


def records_from(data: bytes, state: int, depth: int, whole: int) -> Iterator[bytes | None]:
    """The records of an array that begin in the first ``whole`` bytes, as they stand.

    ``depth`` is that of the first byte; records are what stands at depth 1. The last may go on
    behind the range; None says that it ends beyond ``data``.
    """
    at = leave_string(data, state)
    if at < 0:
        return
    begin = None
    for mark in _STRUCTURE.finditer(data, at):
        kind = mark[0][:1]
        if mark[0] == b'"':
            break  # a string that ends beyond the data
        if kind in b"{[":
            if depth == 1:
                if mark.start() >= whole:
                    return
                begin = mark.start()
            depth += 1
        elif kind in b"}]":
            depth -= 1
            if depth == 1 and begin is not None:
                yield data[begin : mark.end()]
                begin = None
    if begin is not None:
        yield None


def byte_ranges(spark: SparkSession, path: str | Sequence[str], range_bytes: int) -> DataFrame:
    """Ranges of all files: their lengths come from the file listing, no file is opened."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    return files.select(F.col("path").alias("file"), F.explode(starts).alias("first"), "length").select(
        "file", "first", F.least(F.lit(range_bytes), F.col("length") - F.col("first")).alias("size"), "length"
    )


def chained(summaries: pd.DataFrame) -> list[tuple[str, int, int, int, int, int]]:
    """Each range with the state and depth that it starts in, from the effects of those before it."""
    out = []
    for file, ranges in summaries.sort_values(["file", "first"]).groupby("file"):
        state, depth = OUTSIDE, 0
        for r in ranges.itertuples():
            out.append((file, int(r.first), int(r.size), int(r.length), state, depth))
            ends, changes = json.loads(r.effects)
            state, depth = ends[state], depth + changes[state]
        if (state, depth) != (OUTSIDE, 0):
            raise ValueError(f"{file} ends inside a string or record")
    return out


def read_large_json_array(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """The records of files that each hold one JSON array of objects, of any size.

    A file is cut into ranges of ``range_bytes``, which tasks read side by side: one pass finds out where
    strings and records end, a second one parses. A record belongs to the range that it begins in, however long it is.
    Records are parsed as the JSON source does, missing fields are null. A file that ends inside a record fails
    the job. Files are read through Arrow's file systems. Small ranges share tasks.
    """
    ranges = byte_ranges(spark, path, range_bytes)
    n, total = ranges.agg(F.count(F.lit(1)), F.sum("size")).first()
    # a task's start costs more than a small range
    tasks = max(1, min(n, 10_000, max(3 * spark.sparkContext.defaultParallelism, -(-(total or 0) // TASK_BYTES))))

    def summarised(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                data = read_bytes(row.file, row.first, row.size)
                found = effects(data)
                text = json.dumps([[e for e, _ in found], [d for _, d in found]])
                yield pd.DataFrame([(row.file, row.first, row.size, row.length, text)],
                                   columns=["file", "first", "size", "length", "effects"])

    def parsed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ahead, done = 1 << 16, 0
                while True:
                    data = read_bytes(row.file, row.first, min(row.size + ahead, row.length - row.first))
                    found = list(records_from(data, row.state, row.depth, row.size))
                    missing = bool(found) and found[-1] is None
                    fresh = found[done : len(found) - missing]
                    for at in range(0, len(fresh), 1_000):
                        yield pd.DataFrame({"value": [r.decode("utf-8", "replace") for r in fresh[at : at + 1_000]]})
                    done += len(fresh)
                    if not missing:
                        break
                    ahead *= 8

    spread = ranges.repartition(tasks)
    summaries = spread.mapInPandas(summarised, f"{RANGES}, effects string").toPandas()
    listed = chained(summaries)
    known = spark.createDataFrame(listed, f"{RANGES}, state int, depth int").repartition(tasks, "file", "first")
    records = known.mapInPandas(parsed, "value string")
    return records.select(F.from_json("value", schema).alias("record")).select("record.*")
