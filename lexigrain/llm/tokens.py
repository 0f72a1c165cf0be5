"""Token ids of whole texts, each distinct stretch between blanks encoded once per worker."""

from __future__ import annotations

import functools
import os
import re
from array import array

#: White space of Unicode, at which both pre-tokenizers always part. (Fixed values.)
BLANK = (
    "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
)
#: Letters that no normalizer joins with a sign after them, and signs that always end a word.
LETTER, SIGN = "A-Za-zÀ-ÖØ-öø-ÿ", ".,!?;:&$*#%"
UNIT = re.compile(
    rf" ?[{LETTER}]+(?=[{BLANK}{SIGN}]|\Z)| ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
)
#: A word of plain letters, which normalizers treat letter by letter.
PLAIN = re.compile(rf" ?[{LETTER}]+")
#: Stretches kept in a worker's cache, and the longest one that is worth keeping.
CACHE_UNITS, CACHE_CHARS = 600_000, 48


class Encoder:
    """Ids of a tokenizer file as little-endian unsigned 32-bit bytes.

    A byte-level or word tokenizer never joins what white space parts, where a stretch keeps the
    one blank before it, nor letters and the sign after them. Most stretches of a corpus recur, so
    each is encoded once and looked up afterwards. If the tokenizer ignores case and blanks, words of plain letters that
    differ in them only are encoded once. Texts that contain the string of a special token are encoded whole, since the
    tokenizer parts them there first. The cache is emptied when it is full.
    """

    def __init__(self, path: str, most: int = CACHE_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.most = most
        letters = "".join(c for c in map(chr, range(256)) if PLAIN.fullmatch(c))
        self.folds = all(self._parts(" " + w) == self._parts(w.lower()) for w in [*letters, letters])

    def _parts(self, word: str) -> list[str]:
        """What the model gets of a word: normalized and parted."""
        normalizer, parter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        bare = normalizer.normalize_str(word) if normalizer else word
        return [part for part, _ in parter.pre_tokenize_str(bare)] if parter else [bare]

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def batch(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > self.most:
            self.cache.clear()
        units = [
            [t] if any(s in t for s in self.special) else UNIT.findall(t) for t in texts
        ]
        fresh = list(set().union(*units).difference(self.cache))
        if self.folds:
            alike = [" " + u.lower().lstrip(" ") if PLAIN.fullmatch(u) else u for u in fresh]
            asked = list(set(alike).difference(self.cache))
            self.cache.update(zip(asked, self._encode(asked)))
            self.cache.update(zip(fresh, map(self.cache.__getitem__, alike)))
        else:
            self.cache.update(zip(fresh, self._encode(fresh)))
        ids = [b"".join(map(self.cache.__getitem__, u)) for u in units]
        for u in fresh:
            if len(u) > CACHE_CHARS:
                del self.cache[u]
        return ids


@functools.cache
def encoder(path: str, most: int = CACHE_UNITS) -> Encoder:
    """One encoder per Python worker and tokenizer file; ``most`` bounds its cache."""
    return Encoder(path, most)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
