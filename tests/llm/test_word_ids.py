"""Ids of words that are encoded together."""

import pyarrow as pa
import pytest

from affinia.llm import packing
from affinia.llm.queries import tokenizer_path
from affinia.llm.words import utf8

ODD = [
    "one two three", "", None, "\x1e", "a\x1eb \x1e\x1e c", " \x1e lead", "é ́x ̸y", "ΣΑΣ ΑΣ", "it's we'll O'Neil's 's",
    "x y  z\u0085w", "tab\tnew\nline\x0b\x0c\r", "123 4a5 $$$ ñandú$$$ Ŀ ﬁ İ", "🙂🙂 字字 한글",
]


@pytest.mark.parametrize("together", [1, 2, 64])
def test_words_encoded_together_equal_whole_texts(monkeypatch, together):
    monkeypatch.setattr(packing, "TOGETHER", together)
    word_ids = packing.WordIds(tokenizer_path())
    texts = ODD + [f"word{i} wörd{i % 50}" for i in range(300)]
    for _ in range(2):  # the second time from memory
        ids, borders = word_ids.ids(*utf8(pa.array(texts, pa.string())))
        for text, a, b in zip(texts, borders, borders[1:]):
            assert ids[a:b].tolist() == word_ids.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_share_calls():
    word_ids = packing.WordIds(tokenizer_path())
    calls, inner = [], word_ids.tokenizer

    class Counted:
        def encode(self, text, add_special_tokens):
            calls.append(text)
            return inner.encode(text, add_special_tokens=add_special_tokens)

    word_ids.tokenizer = Counted()
    word_ids.ids(*utf8(pa.array([f"w{i}" for i in range(6400)])))
    assert len(calls) == 100
