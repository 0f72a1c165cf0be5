import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexigrain.llm.tokens import Encoder, tokenizer_path

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
CODERS = {f: (Encoder(tokenizer_path(f)), Tokenizer.from_file(tokenizer_path(f))) for f in FILES}
PIECES = st.sampled_from(
    ["a", "word", "Émile", "don't", "'s", "x's", "1", "42", ",", "...", "!", "***", " ", "  ", "\n",
     "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", "é", "≠", "̸", "漢字", "İ",
     "Σ", "ς", "😀", "<|endoftext|>", "<|startoftext|>", "ß", "²", "_", "$", "&&&", "​"]
)


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.one_of(st.lists(PIECES, max_size=12).map("".join), st.text(max_size=20)), max_size=4))
def test_cached_ids_are_the_tokenizers_ids(file, texts):
    coder, plain = CODERS[file]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.batch(texts)] == want


def test_words_that_differ_in_case_or_blanks_are_encoded_once(monkeypatch):
    coder, asked = Encoder(tokenizer_path("word_bpe_49k.json")), []
    encode = coder._encode
    monkeypatch.setattr(coder, "_encode", lambda texts: asked.extend(texts) or encode(texts))
    words = "Émile émile ÉMILE Über über ÿ Word word"
    want = coder.tokenizer.encode(words, add_special_tokens=False).ids
    assert np.frombuffer(coder.batch([words])[0], "<u4").tolist() == want
    assert sorted(asked) == [" word", " émile", " über", " ÿ"]
    assert not Encoder(tokenizer_path("byte_bpe_50k.json")).folds
