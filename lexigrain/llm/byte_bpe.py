"""Byte-level BPE as a tree reduction: halves are encoded, neighbours joined at their border."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm.common import query, spread, table
from lexigrain.llm.tokens import tokenizer_path

#: Characters of a leaf, which the library encodes at once, and ids of a leaf of decoding.
LEAF = 2048
#: Characters on either side of a border that are encoded again at first.
WINDOW = 24
#: White space after anything else always begins a match of the pattern, wherever the text is cut.
_CERTAIN = re.compile(r"(?<=[!-~À-ÖØ-öø-ÿĀ-ɏЀ-ҁ])(?=[ \t\n\r])")
#: Letters in every version of Unicode; two of them side by side are in one match. (Fixed values.)
_SAME_RUN = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ɏЀ-ҁぁ-ゖァ-ヺ一-龥가-힣])(?=[A-Za-zÀ-ÖØ-öø-ɏЀ-ҁぁ-ゖァ-ヺ一-龥가-힣])")

Part = tuple[int, int, np.ndarray]


class ByteBpe:
    """Encoder and decoder for a file of ranks, whose ids are those of the library on whole texts.

    A part of a text is ``(start, end, ids)``. Parts are joined pairwise up a tree, so a long text
    costs its leaves and a small window per border, whatever its matches look like.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.sizes = np.array(list(map(len, self.bytes_of)), np.int64)

    def _leaf(self, text: str) -> np.ndarray:
        return np.array(self.coder.encode_ordinary(text), np.uint32)

    def _tokens_in(self, ids: np.ndarray, size: int, last: bool) -> int | None:
        """Number of first (or last) ids that hold exactly ``size`` bytes; None if an id crosses."""
        near = ids[::-1][: size] if last else ids[:size]  # an id holds a byte at least
        ends = np.cumsum(self.sizes[near])
        at = int(np.searchsorted(ends, size))
        return 0 if not size else at + 1 if at < len(ends) and ends[at] == size else None

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether two ids side by side in one match are what their bytes are encoded to."""
        both = self.bytes_of[a] + self.bytes_of[b]
        return self.coder._encode_single_piece(both) == [a, b]

    def _edges(self, text: str, lo: int, hi: int, part: Part, left: bool) -> Iterator[tuple[int, int, bool]]:
        """Places of a side where a window may end: place, ids of ``part`` inside, whether certain.

        The end of the part next to the window's far side is certain, as its own neighbour's join
        takes care of what lies beyond. So is a border that every text keeps. Last come borders of
        ids inside a run of letters, which hold if the ids on both sides stay apart.
        """
        start, end, ids = part
        if left and lo <= start or not left and hi >= end:
            yield (start if left else end), len(ids), True
            return
        if left:
            certain = _CERTAIN.search(text, lo, end)
        else:
            certain = None
            for certain in _CERTAIN.finditer(text, start + 1, hi):  # noqa: B007
                pass
        if certain and start < certain.start() < end:
            place = certain.start()
            inside = text[place:end] if left else text[start:place]
            yield place, self._tokens_in(ids, len(inside.encode()), left), True
            return
        if hi - lo < 4 * WINDOW:
            return
        for met in _SAME_RUN.finditer(text, lo if left else hi - 16, lo + 16 if left else hi):
            place = met.start()
            # after an apostrophe and one letter, what follows may make a match of the three
            if not start < place < end or text[place - 2 : place - 1] == "'":
                continue
            inside = text[place:end] if left else text[start:place]
            count = self._tokens_in(ids, len(inside.encode()), left)
            if count is not None and count < len(ids):
                yield place, count, False

    def join(self, text: str, a: Part, b: Part) -> Part:
        """The part that covers two neighbours.

        A window around their border is encoded again. It ends where ids beyond it cannot change:
        at the part's own end, at a border that holds in every context, or between two ids of one
        match that are encoded to themselves side by side. In the last case no merge crosses any
        border of neighbours that stay apart, so the ids of the match are what they were. The
        window grows fourfold until both of its ends are of that kind.
        """
        border, width = a[1], WINDOW
        while True:
            lo, hi = max(a[0], border - width), min(b[1], border + width)
            for p, mine, sure_left in self._edges(text, lo, border, a, True):
                for q, yours, sure_right in self._edges(text, border, hi, b, False):
                    fresh = self._leaf(text[p:q])
                    before, after = a[2][: len(a[2]) - mine], b[2][yours:]
                    if not len(fresh):
                        continue
                    if not sure_left and not self._stay_apart(int(before[-1]), int(fresh[0])):
                        continue
                    if not sure_right and not self._stay_apart(int(fresh[-1]), int(after[0])):
                        continue
                    return a[0], b[1], np.concatenate([before, fresh, after])
            width *= 4

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        """Ids of a whole text: each half by itself, then their join."""

        def half(start: int, end: int) -> Part:
            if end - start <= leaf:
                return start, end, self._leaf(text[start:end])
            middle = (start + end) // 2
            return self.join(text, half(start, middle), half(middle, end))

        return half(0, len(text))[2]

    def decode(self, ids: np.ndarray, leaf: int = LEAF) -> bytes:
        """Bytes of ids: those of the halves, one after the other. An unknown id is an error."""
        if len(ids) <= leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        middle = len(ids) // 2
        return self.decode(ids[:middle], leaf) + self.decode(ids[middle:], leaf)


@functools.cache
def coder(path: str, pattern: str) -> ByteBpe:
    """One coder per Python worker, file and pattern."""
    return ByteBpe(path, pattern)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoded(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every whole text as little-endian unsigned 32-bit numbers.

    ``pattern`` parts a text into matches, which are encoded separately, without special tokens.
    Null and empty texts have no ids (an empty value). Null doc_ids stay null, repeated rows each
    give a row, an empty table gives none. Only the two named columns are read. Rows go through in
    batches and are not exchanged, but for a table with fewer splits than cores.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            ids = [bpe.encode(t or "").astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"]
            )

    rows = spread(docs, [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")])
    return rows.mapInArrow(encode, "doc_id long, ids binary")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids of :func:`encoded` stand for.

    Null ids give null, no ids give no bytes. An id outside the file fails the job.
    """

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            texts = [
                None if ids is None else bpe.decode(np.frombuffer(ids, "<u4"))
                for ids in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.binary())],
                names=["doc_id", "ids", "decoded"],
            )

    return tokens.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids binary, decoded binary")


@query()
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document, and of the bytes decoded from them."""
    path, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), _pattern()
    tokens = encoded(table(spark, sf_dir, "documents"), path, pattern)
    return decoded(tokens, path, pattern).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
