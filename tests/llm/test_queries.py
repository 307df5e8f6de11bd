"""The registered queries on the given tables: SQL, plain encoding, held-out accuracy."""

from __future__ import annotations

import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tillscope.llm.queries import QUERIES
from tillscope.llm.queries_sql import SQL
from tillscope.llm.tokens import Tokens

SF = "/root/testdata/sf0.001"


def _table(name):
    return f"read_parquet('{SF}/{name}.parquet')"


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_equals_its_sql(spark, key):
    found = QUERIES[key](spark, SF)
    names = sorted(found.columns)
    with duckdb.connect() as db:
        for path in Path(SF).glob("*.parquet"):
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        expected = db.execute(f"SELECT {', '.join(names)} FROM ({SQL[key]})").fetchall()
    got = [tuple(row) for row in found.select(*names).collect()]
    assert len(got) == len(expected) > 0
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def _encoded(vocabulary, end_id):
    coder = Tokenizer.from_file(str(public_tokenizers.path(vocabulary)))
    texts = duckdb.sql(f"SELECT doc_id, text FROM {_table('documents')} ORDER BY doc_id").fetchall()
    return {
        i: [*coder.encode(t or "", add_special_tokens=False).ids, end_id] for i, t in texts
    }


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("vocabulary, kind", [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_ids_are_those_of_the_library_also_around_marks(vocabulary, kind):
    coder = Tokenizer.from_file(str(public_tokenizers.path(vocabulary)))
    ours = Tokens(str(public_tokenizers.path(vocabulary)), kind)
    texts = ["", "a b  c", "It's 1 2\n\nß", "ok \u2028 x"]
    for mark in ("<|endoftext|>", "<|startoftext|>", "<|EndOfText|>"):
        texts += [mark, f"a {mark} b", f"A{mark}{mark}b c", f"<|{mark}", f"x\n {mark[:-1]}"]
    for text in texts * 2:
        expected = coder.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode(text), "<u2").tolist() == expected, text


def test_token_store_gives_back_every_id(spark):
    start, expected = 0, {}
    for i, ids in _encoded("byte_bpe_50k.json", 2).items():
        expected[i] = (start, len(ids), _crc(ids))
        start += len(ids)
    found = QUERIES["op1_rans_tokens"](spark, SF).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == expected


def test_packing_places_every_token_once(spark):
    documents = _encoded("word_bpe_49k.json", 0)
    pieces = QUERIES["op4_vector_best_fit"](spark, SF).collect()
    expected = {
        (i, k, at, len(ids[at : at + 2048]), _crc(ids[at : at + 2048]))
        for i, ids in documents.items()
        for k, at in enumerate(range(0, len(ids), 2048))
    }
    found = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces}
    assert found == expected and len(pieces) == len(expected)
    ends = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert len(ends) <= 1.05 * sum(map(len, documents.values())) / 2048 + 2


def test_languages_of_held_out_documents(spark):
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM {_table('documents')}").fetchall())
    found = QUERIES["op2_cross_parsing"](spark, SF).collect()
    assert len(found) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert all(0 <= r.score <= 1 for r in found)
    judged = [r.lang_pred == langs[r.doc_id] for r in found if r.held_out and langs[r.doc_id]]
    assert sum(judged) >= 0.9 * len(judged)


def test_toxic_documents_that_were_not_learned_score_higher(spark):
    """On the largest given tables; the smaller ones hold out a handful of toxic documents."""
    large = "/root/testdata/sf0.1"
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{large}/labels.parquet'").fetchall())
    found = QUERIES["op6_subword_toxicity"](spark, large).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    judged = [r for r in found if r.held_out and labels.get(r.doc_id) is not None]
    known = [(r.score, labels[r.doc_id]) for r in judged]
    toxic, clean = ([s for s, y in known if y == side] for side in (1, 0))
    wins = sum((a > b) + (a == b) / 2 for a in toxic for b in clean)
    assert wins >= 0.9 * len(toxic) * len(clean)
