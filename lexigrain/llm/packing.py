"""Pack documents into windows of a fixed number of tokens: online, best fit, bounded space."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm.common import query, spread, table
from lexigrain.llm.tokens import encoder, tokenizer_path
from lexigrain.session import persisted

WINDOW = 1_024
END_ID = 0
#: Windows that a partition keeps open.
OPEN = 32
#: A document is cut to fill a window with at least this much room; less room is padded.
LEAST_PIECE = 16
#: Partitions whose leftover windows are merged by one task, so its input is bounded.
MERGED = 16
#: Leftovers of tasks are numbered above those of the first pass.
SERIAL_BITS, MERGE_BIT = 32, 1 << 62

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)
NAMES = [c.split()[0] for c in PIECES.split(", ")]


class Packer:
    """Open windows of one task. ``closed`` holds the pieces of windows that are done.

    A document longer than a window gives whole windows and a rest. A rest goes to the open window
    that it leaves fullest; with no such window a new one opens. When as many as allowed are
    open, the fullest is emitted: filled with the head of the rest if it has room for a piece worth
    cutting, else padded.
    """

    def __init__(self, window: int, open_windows: int, least_piece: int, base: int):
        self.window, self.most, self.least = window, open_windows, least_piece
        self.serial = base
        self.room: list[tuple[int, int]] = []  # (free tokens, sequence id), ascending
        self.pieces: dict[int, list[tuple]] = {}
        self.closed: list[tuple] = []

    def _new(self) -> int:
        self.serial += 1
        self.pieces[self.serial] = []
        return self.serial

    def _put(self, sequence: int, free: int, piece: tuple) -> int:
        """Lay a piece (id, start, ids, doc_tokens) into a window; gives the room that is left."""
        self.pieces[sequence].append((*piece, self.window - free))
        return free - len(piece[2]) // 4

    def _emit(self, sequence: int) -> None:
        for doc_id, start, ids, total, offset in self.pieces.pop(sequence):
            self.closed.append(
                (doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset)
            )

    def add(self, doc_id, start: int, ids: bytes, total: int) -> None:
        whole = 4 * self.window
        while len(ids) >= whole:
            sequence = self._new()
            self._put(sequence, self.window, (doc_id, start, ids[:whole], total))
            self._emit(sequence)
            ids, start = ids[whole:], start + self.window
        n = len(ids) // 4
        if not n:
            return
        at = bisect.bisect_left(self.room, (n, -1))
        if at < len(self.room):
            free, sequence = self.room.pop(at)
        elif len(self.room) < self.most:
            free, sequence = self.window, self._new()
        else:
            free, sequence = self.room.pop(0)
            if free >= self.least:
                self._put(sequence, free, (doc_id, start, ids[: 4 * free], total))
                ids, start = ids[4 * free :], start + free
            self._emit(sequence)
            free, sequence = self.window, self._new()
        free = self._put(sequence, free, (doc_id, start, ids, total))
        if free:
            bisect.insort(self.room, (free, sequence))
        else:
            self._emit(sequence)

    def take_closed(self, group: int | None = None) -> pd.DataFrame:
        rows, self.closed = self.closed, []
        out = pd.DataFrame(rows, columns=NAMES)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out.assign(merge=pd.array([pd.NA] * len(out), "Int64"), ids=None)

    def leftover(self, group: int) -> pd.DataFrame:
        """The pieces of open windows with their ids, for the merge."""
        rows = [
            (doc_id, start, len(ids) // 4, 0, total, sequence, offset, group, ids)
            for sequence, pieces in self.pieces.items()
            for doc_id, start, ids, total, offset in pieces
        ]
        out = pd.DataFrame(rows, columns=[*NAMES, "merge", "ids"])
        return out.astype({"doc_id": "Int64", "merge": "Int64"})


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    window: int = WINDOW,
    open_windows: int = OPEN,
    least_piece: int = LEAST_PIECE,
) -> DataFrame:
    """Pieces of all documents and their places in windows of ``window`` tokens.

    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``. The ids of a document are those of its text and ``end_id``; each lies in exactly one
    piece. Offsets have no gaps from 0, the rest of a window is padding.

    Each task tokenizes and packs the rows of its partition in one pass with ``open_windows`` open
    windows, so its memory does not depend on their number. What is still open at its end is carried
    with its ids to a merge of ``MERGED`` partitions, which fills windows one after the other and
    leaves one partly filled per merge task. Both passes read one stored table, so a lost executor
    cannot make closed windows and leftovers disagree.

    A null or empty text is its end id alone. Rows with the same or a null id are separate
    documents. Long texts give whole windows. An empty table gives no pieces.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    end = int(end_id).to_bytes(4, "little")

    def packed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        packer = Packer(window, open_windows, least_piece, part << SERIAL_BITS)
        for batch in batches:
            ids = encoder(path).batch([t if isinstance(t, str) else "" for t in batch["text"]])
            keys = [None if pd.isna(k) else int(k) for k in batch["doc_id"]]
            for key, found in zip(keys, ids):
                found += end
                packer.add(key, 0, found, len(found) // 4)
            yield packer.take_closed()
        yield packer.leftover(part // MERGED)

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(window, 1, least_piece, MERGE_BIT + (int(group["merge"][0]) << SERIAL_BITS))
        # fuller windows first, each kept together and in its order
        fill = group.groupby("sequence_id")["length"].transform("sum")
        order = group.assign(fill=-fill).sort_values(["fill", "sequence_id", "offset"])
        for row in order.itertuples():
            key = None if pd.isna(row.doc_id) else int(row.doc_id)
            packer.add(key, int(row.start), bytes(row.ids), int(row.doc_tokens))
        for _, sequence in packer.room:
            packer._emit(sequence)
        return packer.take_closed()[NAMES]

    source = spread(docs, [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")])
    first = persisted(
        source.mapInPandas(packed, PIECES + ", merge long, ids binary"), "packed"
    )
    done = first.filter(F.col("merge").isNull()).select(*NAMES)
    rest = first.filter(F.col("merge").isNotNull())
    return done.unionByName(rest.groupBy("merge").applyInPandas(merged, PIECES))


@query()
def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
