"""The pipeline's stages, each against a brute-force version on its own input."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import _classes, _shingles
from tillscope.llm.queries import toxicity_model
from tillscope.llm.queries_sql import SQL
from tillscope.llm.store import written
from tillscope.llm.toxicity import Scorer

INSULTS = ["blorgface", "snarkhead", "grubwit", "dulltooth", "mudbrain", "wretchling"]
COLUMNS = ["doc_id", "text", "source", "score", "kept", "copies"]


def _corpus():
    """doc_id, text, source, toxic: prose, insults, near copies, copies and awkward rows."""
    draw = random.Random(3)
    words = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su", "no") for b in ("rem", "pal", "dor", "vin", "ket", "sal", "ber")]
    stops = ["the", "and", "of", "to", "in", "is"]

    def prose(n):
        return [draw.choice(stops) if draw.random() < 0.4 else draw.choice(words) + draw.choice(words) for _ in range(n)]

    rows = []
    for i in range(240):
        text, toxic = prose(draw.randint(60, 200)), int(i % 5 == 0)
        if toxic:
            at = draw.randrange(len(text))
            text[at:at] = draw.choices(INSULTS, k=14)
        rows.append((" ".join(text), toxic))
    bases = [prose(120) for _ in range(8)]
    for base in bases:
        for _ in range(6):
            copy = list(base)
            copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append((" ".join(copy), 0))
    rows += [(" ".join(bases[0]), 0)] * 30
    rows += [(" ".join(prose(9000)), 0), ("a b c", 0), ("", 0), (None, 0), ("one " * 200, 0)]
    draw.shuffle(rows)
    sources = ["web", "web", "web", "books", "code", None]
    found = [(i * 7, text, draw.choice(sources), toxic) for i, (text, toxic) in enumerate(rows)]
    return found + [(None, " ".join(prose(90)), "web", None)]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rows = _corpus()
    ids = pa.array([r[0] for r in rows], pa.int64())
    docs = {
        "doc_id": ids,
        "text": [r[1] for r in rows],
        "source": [r[2] for r in rows],
        "score": ["own"] * len(rows),  # names that the operators use too
        "kept": [7] * len(rows),
        "copies": [0.5] * len(rows),
    }
    pq.write_table(pa.table(docs), folder / "documents.parquet")
    labels = {"doc_id": ids, "quality": pa.array([1] * len(rows)), "toxic": pa.array([r[3] for r in rows], pa.int64())}
    pq.write_table(pa.table(labels), folder / "labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def stages(spark, corpus):
    """Input and result of each stage."""
    docs, found = spark.read.parquet(f"{corpus}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = written(stage(spark, docs, corpus), f"test-{name}")
        found[name] = (docs, result)
        docs = result
    return found


def _rows(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def _by_sql(key, docs):
    """The SQL of a query over the rows of ``docs``."""
    rows = _rows(docs, "doc_id", "text", "source")
    documents = pa.table(
        {
            "doc_id": pa.array([r[0] for r in rows], pa.int64()),
            "text": pa.array([r[1] for r in rows], pa.string()),
            "source": pa.array([r[2] for r in rows], pa.string()),
        }
    )
    with duckdb.connect() as db:
        db.register("documents", documents)
        return db.execute(f"SELECT * FROM ({SQL[key]})").fetchdf()


def test_all_stages_but_the_last_keep_the_columns(stages):
    for name, (docs, result) in stages.items():
        assert docs.columns == COLUMNS, name
        others = [tuple(r) for r in docs.select(*COLUMNS[3:]).distinct().collect()]
        assert others == [("own", 7, 0.5)], name
        if name != "packing":
            assert result.schema.simpleString() == docs.schema.simpleString(), name


def test_toxicity_drops_what_the_model_calls_toxic_and_keeps_clean_texts(spark, corpus, stages):
    docs, result = stages["toxicity"]
    scorer = Scorer(toxicity_model(spark, docs, corpus))
    rows = _rows(docs, "doc_id", "text")
    scores = np.concatenate([scorer.scores([text]) for _, text in rows])
    expected = [row for row, score in zip(rows, scores, strict=True) if score < 0.5]
    assert Counter(expected) == Counter(_rows(result, "doc_id", "text"))
    kept = {i for i, _ in expected}
    truth = {i: toxic for i, _, _, toxic in _corpus() if i is not None}
    toxic = [i for i, y in truth.items() if y and zlib.crc32(str(i).encode()) % 5 == 0]
    clean = [i for i, y in truth.items() if not y]
    assert len(toxic) >= 5
    assert sum(i in kept for i in toxic) <= 0.1 * len(toxic)
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)


def test_quality_keeps_what_the_sql_keeps(stages):
    docs, result = stages["quality_rules"]
    judged = _by_sql("op10_quality_rules", docs)
    named = judged[judged.doc_id.notna()]
    expected = sorted(named.doc_id[named.kept].astype(int))
    assert sorted(i for (i,) in _rows(result, "doc_id") if i is not None) == expected
    assert 0 < len(expected) < len(judged)


def test_near_duplicates_keep_the_first_of_each_class(stages):
    docs, result = stages["near_duplicates"]
    rows = _rows(docs, "doc_id", "text")
    sets = {i: _shingles(text) for i, text in rows if i is not None}
    linked = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    classes = _classes(list(sets), linked)
    expected = [(i, text) for i, text in rows if i is None or classes[i] == i]
    assert Counter(expected) == Counter(_rows(result, "doc_id", "text"))
    assert len(expected) < len(rows) - 40


def test_mixing_repeats_documents_as_the_sql_says(stages):
    docs, result = stages["mixing"]
    mixed = _by_sql("op9_mix_sources", docs)
    expected = Counter()
    for row in mixed.itertuples():
        expected[None if row.doc_id is pd.NA else int(row.doc_id)] += int(row.copies)
    found = Counter(i for (i,) in _rows(result, "doc_id"))
    assert found == +expected


def _pieces(docs):
    coder = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    for i, text in _rows(docs, "doc_id", "text"):
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            yield i, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())


def test_packing_places_every_copy_of_every_piece_once(spark, corpus, stages):
    docs, result = stages["packing"]
    expected = Counter(_pieces(docs))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    for packed in (result, corpus_pipeline.run(spark, corpus)):
        rows = _rows(packed, *names, "sequence_id", "offset")
        assert Counter(r[:5] for r in rows) == expected
        ends = {}
        for r in sorted(rows, key=lambda r: (r[5], r[6])):
            assert r[6] == ends.get(r[5], 0)
            ends[r[5]] = r[6] + r[3]
        assert max(ends.values()) <= 2048
        assert len(ends) <= 1.05 * sum(k[3] * n for k, n in expected.items()) / 2048 + 2


def test_empty_tables_pass_through_every_stage(spark, corpus, tmp_path):
    for name in ("documents", "labels"):
        pq.write_table(pq.read_table(f"{corpus}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
