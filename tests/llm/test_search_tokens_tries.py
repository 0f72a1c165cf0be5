"""Lexical search, byte-level BPE and the prefix trie against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrain.llm import byte_bpe, lexical_search, prefix_trie
from lexigrain.llm.tokens import tokenizer_path

# --- lexical search


def plain_terms(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def plain_ranking(docs, items, best=50):
    lists = [(d, plain_terms(t)) for d, t in docs]
    n_docs, length = sum(bool(t) for _, t in lists), sum(len(t) for _, t in lists)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(plain_terms(t))
    held = {t: sum(t in ts for _, ts in lists) for t in set().union(*wanted.values())}
    out = []
    for item, terms in wanted.items():
        scores = []
        for doc, ts in lists:
            if ts:
                m = 50 + (50 * len(ts) * n_docs) // length
                score = sum(
                    math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1)))
                    * ((1000000000 * ts.count(t)) // (1000 * ts.count(t) + 20 * m))
                    for t in terms & set(ts)
                )
                if score > 0:
                    scores.append((-score, math.inf if doc is None else doc, doc))
        for rank, (score, _, doc) in enumerate(sorted(scores, key=lambda s: s[:2])[:best], 1):
            out.append((item, rank, doc, -score))
    return sorted(out, key=str)


def random_docs(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(400)] + ["Über", "über", "don't", "x_y"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30]))) for _ in range(n)]
    texts[5:60] = [texts[4] or "w1 w2"] * 55  # a tie that is longer than the ranking
    return list(enumerate(texts))


@pytest.mark.parametrize("best", [3, 50])
def test_search_equals_scoring_everything(spark, best, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD", 300)
    rows = [*random_docs(400), (None, "w1 w2"), (7, "w1"), (7, "w1"), (900, None), (901, "?!"), (902, "w3 " * 30_000)]
    items = [(1, "w1 w2 Über"), (1, "w9"), (2, "absent"), (3, None), (4, ""), (None, "W1 w2 w2"), (5, rows[4][1])]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, query string, n int")
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in lexical_search.ranked(docs, asked, best).collect()]
    assert sorted(got, key=str) == plain_ranking(rows, items, best)
    blocks = [tuple(r) for r in lexical_search.ranked(docs, asked, best, query_bytes=8).collect()]
    assert sorted(blocks, key=str) == sorted(got, key=str)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a")], "item_id string, text string")
    found = lexical_search.ranked(docs, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert found.first().item_id == "x"
    assert lexical_search.ranked(docs.limit(0), items).collect() == []
    assert lexical_search.ranked(docs, items.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(
    lists=st.lists(st.dictionaries(st.integers(0, 30), st.integers(1, 9), min_size=1), min_size=1, max_size=6),
    best=st.integers(1, 8),
)
def test_intervals_close_on_the_best_and_their_ties(lists, best):
    total = np.zeros(31, int)
    for entries in lists:
        for doc, impact in entries.items():
            total[doc] += impact
    ordered = sorted((d for d in range(31) if total[d]), key=lambda d: -total[d])
    bar = total[ordered[min(best, len(ordered)) - 1]] if len(ordered) >= best else 1
    sorted_lists = []
    for entries in lists:
        pairs = sorted(entries.items(), key=lambda e: -e[1])
        sorted_lists.append((np.array([d for d, _ in pairs]), np.array([s for _, s in pairs])))
    docs, scores = lexical_search.resolve(sorted_lists, 31, best, first=1)
    assert dict(zip(docs.tolist(), scores.tolist())) == {d: total[d] for d in ordered if total[d] >= bar}


# --- byte-level BPE

PATH = tokenizer_path("byte_bpe_50k.tiktoken")
CODER = byte_bpe.coder(PATH, byte_bpe._pattern())
PIECES = st.sampled_from(
    ["a", "word", "Émile", "don't", "'s", "x's", "'l", "l", "'", "'r", "e", "1", "42", ",", "...", "***", " ",
     "  ", "\n", "\t", "\r\n", "\x85", "\xa0", "　", "é", "漢字", "漢", "İ", "😀", "<|endoftext|>", "²", "_",
     "aaaa", "the", " the", "​"]
)


@settings(max_examples=400, deadline=None)
@given(
    text=st.one_of(st.lists(PIECES, max_size=300).map("".join), st.text(max_size=200), st.text("ab' sl漢", max_size=600)),
    leaf=st.sampled_from([1, 2, 7, 40]),
)
def test_joined_halves_are_the_whole_encoding(text, leaf):
    ids = CODER.encode(text, leaf)
    assert ids.tolist() == CODER.coder.encode_ordinary(text)
    assert CODER.decode(ids, leaf) == text.encode()


@pytest.mark.parametrize("letters", ["a", "abcdefghij", "漢字仮名", "ab ", " ", "=", "'sl"])
def test_one_long_match(letters):
    rng = random.Random(5)
    text = "".join(rng.choice(letters) for _ in range(40_000))
    assert CODER.encode(text).tolist() == CODER.coder.encode_ordinary(text)


def test_ids_that_stay_apart():
    a, b = CODER.coder.encode_ordinary("xyzzyqvab")[:2]
    assert CODER._stay_apart(a, b)
    h, e = CODER.coder.encode_ordinary("t")[0], CODER.coder.encode_ordinary("he")[0]
    assert not CODER._stay_apart(h, e)


def test_bpe_rows(spark):
    texts = ["Hello  world", None, "", "naïve 漢字 " * 3000, "Hello  world"]
    rows = [(i if i != 2 else None, t, "z", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    tokens = byte_bpe.encoded(docs, PATH, byte_bpe._pattern())
    got = {r.doc_id: r for r in byte_bpe.decoded(tokens, PATH, byte_bpe._pattern()).collect()}
    for i, t in enumerate(texts):
        r = got[i if i != 2 else None]
        assert np.frombuffer(r.ids, "<u4").tolist() == CODER.coder.encode_ordinary(t or "")
        assert bytes(r.decoded) == (t or "").encode()
    none = byte_bpe.decoded(byte_bpe.encoded(docs.limit(0), PATH, byte_bpe._pattern()), PATH, byte_bpe._pattern())
    assert none.collect() == []
    gone = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert byte_bpe.decoded(gone, PATH, byte_bpe._pattern()).first().decoded is None


# --- prefix trie


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            turn_key = (role or "", text or "")
            tie = hashlib.md5(f"{len(turn_key[0])}:{turn_key[0]}:{turn_key[1]}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, turn_key))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built = tuple((own.get(c - c % 5, [])[:h] + turns[h:]))
        for d in range(len(built) + 1):
            members.setdefault(built[:d], []).append((c, len(built) == d))
    out = []
    for path, found in members.items():
        below = [p for p in members if p[: len(path)] == path]
        parents = {p[:-1] for p in members if p}
        out.append((
            min(c for c, _ in found), len(path),
            min(c for c, _ in members[path[:-1]]) if path else None,
            len(found), sum(p[:-1] == path for p in members if p),
            sum(p not in parents for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
            hashlib.sha256(",".join(str(c) for c in sorted(c for c, e in found if e)).encode()).hexdigest(),
        ))
    return sorted(out)


def conversations(n, seed=9):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(3 * n), n):
        for turn in range(rng.choice([1, 2, 4, 9, 14])):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(["a", "é", "long " * 9])))
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("widths", [(2, 3), (8, 16)])
def test_trie_equals_brute_force(spark, monkeypatch, widths):
    monkeypatch.setattr(prefix_trie, "ID_RANGE_BITS", 3)
    monkeypatch.setattr(prefix_trie.trie, "__defaults__", (widths,))
    rows = conversations(90)
    rows += [(1_000 + i, t, "user", "same") for i in range(40) for t in range(20)]  # one very common conversation
    rows += [(5_000, None, None, None), (5_000, 1, "user", None), (5_000, 1, None, "b"), (None, 0, "user", "lost")]
    rows += [(5_001, 0, "user", "x" * 100_000)] * 3  # repeated rows, a long text
    table = spark.createDataFrame(
        [(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, pos int, id string"
    )
    found = prefix_trie.prefix_trie(table)
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[:2]) == plain_trie(rows)


def test_trie_of_turnless_conversations_and_of_none(spark):
    # the crc32 of "6" is 7 modulo 9, and there is no conversation 5
    rows = [(6, 0, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = prefix_trie.prefix_trie(table)
    assert [tuple(r) for r in found.collect()] == plain_trie(rows)
    assert prefix_trie.prefix_trie(table.limit(0)).collect() == []
