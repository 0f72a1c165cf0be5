"""Token ids in files of length-delimited binary records with an offset index."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrain.llm.common import bound_batches, query, table
from lexigrain.llm.tokens import encoder, tokenizer_path
from lexigrain.session import persisted, shared_path, shuffle_width

END_ID = 1
#: Stretches that a worker keeps, as a cache emptied too often has to encode the frequent ones again.
CACHE_UNITS = 1_000_000
#: Bytes of a record file before the next one begins.
FILE_BYTES = 32 << 20
#: Added to the turned checksum of a frame, so that a checksum of checksums is no fixed point.
#: (Fixed value of the record format.)
MASK_DELTA = 0xA282EAD8
#: Reversed Castagnoli polynomial. (Fixed value of the record format.)
CASTAGNOLI = 0x82F63B78
HEAD, FOOT = struct.Struct("<QI"), struct.Struct("<I")
RECORD = struct.Struct("<qBI")  # document number, whether it has one, number of ids

INDEX = (
    "doc_id long, file string, ordinal long, offset long, length long, n_tokens long, before long"
)
FOUND = "doc_id long, file string, ordinal long, n_tokens long, ids_crc32 long"


CHUNK = 256


def _tables() -> np.ndarray:
    """Checksum tables for eight bytes at a time: row k advances a byte by k further bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(CASTAGNOLI), one >> 1)
    rows = [one]
    for _ in range(7):
        rows.append((rows[-1] >> 8) ^ one[rows[-1] & 0xFF])
    return np.stack(rows)


def _chunk_tables() -> list[list[int]]:
    """A register after a chunk of zero bytes, as one table for each of its four bytes."""
    out = []
    for byte in range(4):
        register = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
        for _ in range(CHUNK):
            register = (register >> 8) ^ _TABLES[0][register & 0xFF]
        out.append(register.tolist())
    return out


_TABLES = _tables()
_BYTE = _TABLES[0].tolist()
_A, _B, _C, _D = _chunk_tables()


def _crc32c_short(data: bytes) -> int:
    register = 0xFFFFFFFF
    for byte in data:
        register = (register >> 8) ^ _BYTE[(register ^ byte) & 0xFF]
    return register ^ 0xFFFFFFFF


def crc32c_many(blobs: list[bytes]) -> list[int]:
    """Castagnoli checksums. All chunks of all blobs advance side by side, then are joined in turn.

    Zero bytes in front do not change a zero register, so blobs are filled up there to whole chunks;
    the usual start value enters as if xored into a blob's first four bytes.
    """
    counts = [-(-len(b) // CHUNK) if len(b) >= 4 else 0 for b in blobs]
    lanes = np.zeros((sum(counts), CHUNK), np.uint8)
    flat, end = lanes.reshape(-1), 0
    for blob, n in zip(blobs, counts):
        if n:
            end += n * CHUNK
            flat[end - len(blob) : end] = np.frombuffer(blob, np.uint8)
            flat[end - len(blob) : end - len(blob) + 4] ^= 0xFF
    register = np.zeros(len(lanes), np.uint32)
    for at in range(0, CHUNK, 8):
        block = lanes[:, at : at + 8]
        fresh = _TABLES[3][block[:, 4]] ^ _TABLES[2][block[:, 5]]
        fresh ^= _TABLES[1][block[:, 6]] ^ _TABLES[0][block[:, 7]]
        for byte in range(4):
            low = (register >> np.uint32(8 * byte)).astype(np.uint8) ^ block[:, byte]
            fresh ^= _TABLES[7 - byte][low]
        register = fresh
    chunks, out = iter(register.tolist()), []
    for blob, n in zip(blobs, counts):
        if not n:
            out.append(_crc32c_short(blob))
            continue
        r = 0
        for _ in range(n):
            r = _A[r & 0xFF] ^ _B[r >> 8 & 0xFF] ^ _C[r >> 16 & 0xFF] ^ _D[r >> 24] ^ next(chunks)
        out.append(r ^ 0xFFFFFFFF)
    return out


def masked(checksum: int) -> int:
    return (((checksum >> 15) | (checksum << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frames(payloads: list[bytes]) -> list[bytes]:
    """Length, masked checksum of the length, payload, masked checksum of the payload, for each."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    return [
        b"".join((n, FOOT.pack(masked(c)), p, FOOT.pack(masked(d))))
        for n, c, p, d in zip(lengths, crc32c_many(lengths), payloads, crc32c_many(payloads))
    ]


def payloads(records: list[bytes]) -> list[bytes]:
    """The payloads of frames; fails on any damage."""
    if any(len(r) < HEAD.size + FOOT.size for r in records):
        raise ValueError("a record is cut short")
    heads = crc32c_many([r[:8] for r in records])
    found = [r[HEAD.size : -FOOT.size] for r in records]
    for record, payload, head, body in zip(records, found, heads, crc32c_many(found)):
        if HEAD.unpack_from(record) != (len(payload), masked(head)):
            raise ValueError("the length of a record is damaged")
        if FOOT.unpack_from(record, len(record) - FOOT.size)[0] != masked(body):
            raise ValueError("the payload of a record is damaged")
    return found


def serialize(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """Document number and ids, as ``width`` bytes each; ``ids`` are unsigned 32-bit."""
    body = np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()
    return RECORD.pack(doc_id or 0, doc_id is not None, len(ids) // 4) + body


def deserialize(payload: bytes) -> tuple[int | None, bytes]:
    doc_id, given, n = RECORD.unpack_from(payload)
    width = (len(payload) - RECORD.size) // n if n else 4
    ids = np.frombuffer(payload, f"<u{width}", n, RECORD.size).astype("<u4").tobytes()
    return (doc_id if given else None), ids


def _files(folder: str):
    """File system and path of a folder given by path or address, from inside a task."""
    from pyarrow import fs

    address = folder if "://" in folder or not folder.startswith("file:") else "file://" + folder[5:]
    return fs.FileSystem.from_uri(address)


def write_records(
    docs: DataFrame,
    folder: str,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Encode every text, write record files below ``folder`` and return the stored offset index.

    Documents are cut into ranges of ascending number (rows of one number by a hash of their text),
    so a task writes one range in order to files of about ``file_bytes``; the names ascend with the
    numbers. A vocabulary within 16 bits takes two bytes an id. The index has a row per record:
    ``doc_id, file, ordinal, offset, length, n_tokens, before`` (ids before it in its file), and is
    written apart by Spark's own commit: a task that ran twice leaves a file that no index row
    names, since every attempt has its own names.

    Null texts are empty, null numbers come first and are kept as null.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    end = int(end_id).to_bytes(4, "little")

    def written(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        coder = encoder(path, CACHE_UNITS)
        vocabulary = max(coder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        width = 2 if vocabulary <= 1 << 16 else 4
        part, out, name, offset, before, n_files = context.partitionId(), None, "", 0, 0, 0
        for batch in batches:
            found = coder.batch([t if isinstance(t, str) else "" for t in batch["text"]])
            keys = [None if pd.isna(key) else int(key) for key in batch["doc_id"]]
            data = frames([serialize(k, ids + end, width) for k, ids in zip(keys, found)])
            rows = []
            for key, ids, record in zip(keys, found, data):
                if out is None or offset >= file_bytes:
                    if out is not None:
                        out.close()
                    name = f"{part:08d}-{n_files:06d}-{context.taskAttemptId()}.rec"
                    out = files.open_output_stream(f"{root}/{name}")
                    offset, before, n_files, ordinal = 0, 0, n_files + 1, 0
                out.write(record)
                n = len(ids) // 4 + 1
                rows.append((key, name, ordinal, offset, len(record), n, before))
                offset, before, ordinal = offset + len(record), before + n, ordinal + 1
            frame_out = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
            yield frame_out.astype({"doc_id": "Int64"})
        if out is not None:
            out.close()

    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranged = rows.repartitionByRange(
        shuffle_width(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    ).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    bound_batches(spark)
    return persisted(ranged.mapInPandas(written, INDEX), "index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read the records that ``index`` names, in any order of its rows; fails on damage.

    Returns ``doc_id, file, ordinal, n_tokens, ids_crc32`` from the records themselves. A task opens
    the files that its index rows name and seeks to each record.
    """

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _files(folder)
        name, source = None, None
        for batch in batches:
            data = []
            for row in batch.itertuples():
                if row.file != name:
                    if source is not None:
                        source.close()
                    name, source = row.file, files.open_input_file(f"{root}/{row.file}")
                data.append(source.read_at(row.length, row.offset))
            rows = [
                (key, file, ordinal, len(ids) // 4, zlib.crc32(ids))
                for file, ordinal, (key, ids) in zip(
                    batch["file"], batch["ordinal"], map(deserialize, payloads(data))
                )
            ]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])
            yield out.astype({"doc_id": "Int64"})
        if source is not None:
            source.close()

    return index.select("file", "ordinal", "offset", "length").mapInPandas(read, FOUND)


def file_starts(index: DataFrame) -> DataFrame:
    """Number of ids before each file. There is one row per file, so one task can sum them."""
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "file", F.coalesce(F.sum("file_tokens").over(earlier), F.lit(0)).alias("file_start")
    )


@query()
def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the record files hold of every document, read back through the index."""
    folder = shared_path(spark, "records")
    index = write_records(table(spark, sf_dir, "documents"), folder)
    place = index.select("file", "ordinal", "before").join(file_starts(index), "file")
    return (
        read_records(index, folder)
        .join(place, ["file", "ordinal"])
        .select(
            "doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
        )
    )
