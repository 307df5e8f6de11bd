"""Encoding of many texts at once: the library's ids, and each new word asked for once."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tillscope.llm import tokens
from tillscope.llm.tokens import Tokens

VOCABULARIES = [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")]
PARTS = ["a", "The", "é", "ñu", "Ż", "1", "23", "½", " ", " ", "\n", "\t", "\r", "'s", "'", ".", ",", "!?", "…", "|", "("]


def _path(vocabulary):
    return str(public_tokenizers.path(vocabulary))


def _numbers(ids):
    return np.frombuffer(ids, "<u2").tolist()


@pytest.mark.parametrize("vocabulary, kind", VOCABULARIES)
def test_texts_encoded_together_get_the_ids_of_the_library(vocabulary, kind, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 400)  # pieces are forgotten on the way
    draw = random.Random(7)
    texts = ["".join(draw.choices(PARTS, k=draw.randint(0, 12))) for _ in range(3000)]
    texts += ["a  ", "a \n", "a\n\n", "\n\na", " \n a", "İa", "a 's 'tis", "x" * 500 + ".", "中 a", "\x00a"]
    texts += ["a <|endoftext|> b", *("%x" % draw.getrandbits(60) for _ in range(300))]
    coder, ours = Tokenizer.from_file(_path(vocabulary)), Tokens(_path(vocabulary), kind)
    for begin in range(0, len(texts), 50):
        some = texts[begin : begin + 50]
        expected = [coder.encode(text, add_special_tokens=False).ids for text in some]
        assert [_numbers(ids) for ids in ours.encode_all(some)] == expected
        assert len(ours.known) + len(ours.older) < 1500
    assert ours.encode_all([]) == []
    assert ours.encode_all([None, "", None]) == [b"", b"", b""]


@pytest.mark.parametrize("vocabulary, kind", VOCABULARIES)
def test_new_words_of_many_texts_go_to_the_library_together(vocabulary, kind, monkeypatch):
    ours, asked = Tokens(_path(vocabulary), kind), []
    library = ours._library

    def counted(texts, *more):
        asked.extend(texts)
        return library(texts, *more)

    monkeypatch.setattr(ours, "_library", counted)
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    texts = [f"{word(i)}, so {word(i)}. {word(i + 1)}" for i in range(1000)]
    assert len(ours.encode_all(texts)) == 1000
    assert 0 < len(asked) < 100  # one call a text before
    asked.clear()
    ours.encode_all(texts)
    assert not asked
