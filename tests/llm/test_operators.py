"""The operators against brute-force versions on small tables with awkward rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tillscope.llm.itq import itq_near_duplicates
from tillscope.llm import jaccard
from tillscope.llm import jaccard
from tillscope.llm.jaccard import ngram_jaccard
from tillscope.llm.mixing import mixed_counts
from tillscope.llm.packing import Capacity, plan_sequences
from tillscope.llm.quality_rules import quality_rules
from tillscope.llm.rans import Damaged, decode_frame, encode_frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def _classes(ids, linked):
    """The smallest id that links lead to, by plain spreading of labels."""
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def _near_texts():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(draw.choices(words, k=40))
    texts = [None, "", " \t\n", "one two", "One TWO", "one two three", "Ä ä", "ä ä"]
    for _ in range(12):
        base = draw.choices(words, k=draw.randint(5, 90))
        for _ in range(5):
            copy = list(base)
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy))
    texts += [" ".join(draw.choices(words, k=25)) + " " + passage for _ in range(20)]
    hot = draw.choices(words, k=60)
    for i in range(40):
        texts.append(" ".join(hot[:57] + draw.choices(words, k=3)))
    texts += ["same text again and again here"] * 30
    texts.append(" ".join(draw.choices(words, k=20000)))
    draw.shuffle(texts)
    return texts


def _loose_texts():
    """Families whose members are about as far apart as the bound, and a passage in all texts."""
    draw = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    passage = " ".join(draw.choices(words, k=60))
    texts = []
    for size in (60, 300, 330, 1500):
        base = draw.choices(words, k=size)
        for _ in range(30):
            copy = list(base)
            for _ in range(draw.randint(0, size // 18)):
                copy[draw.randrange(size)] = draw.choice(words)
            texts.append(" ".join(copy) + " " + passage)
    for _ in range(60):
        texts.append(" ".join(draw.choices(words, k=draw.randint(5, 120))) + " " + passage)
    return texts + texts[::7]


@pytest.mark.parametrize(
    "make, tile, percent",
    [(_near_texts, 1024, 75), (_loose_texts, 1024, 75), (_loose_texts, 8, 75), (_loose_texts, 8, 90), (_near_texts, 8, 100)],
)
def test_jaccard_join_finds_the_components_of_all_pairs(spark, monkeypatch, make, tile, percent):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(make())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    sets = {i: _shingles(t) for i, t, _ in rows}
    linked = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    expected = _classes(list(sets), linked)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard(docs, percent=percent).collect()}
    assert found == {i: (len(sets[i]), expected[i]) for i in sets}


@pytest.mark.parametrize("percent", [50, 74, 101])
def test_jaccard_join_refuses_similarities_it_would_lose_links_at(spark, percent):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="percent"):
        ngram_jaccard(docs, percent=percent)


def _base(text):
    words = WORD.findall(text or "")
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    n = len(words)
    failed = n < 50 or 100 * len(again) > 50 * n
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(again), failed


def test_quality_counts_equal_plain_counts(spark):
    draw = random.Random(7)
    texts = [None, "", "a a a a a", "x\nx\nx y\n\n\n \n \nx", "# * | <b> 𝄞 é b"]
    for size in (10, 60, 200, 5000):
        for kinds in (3, 12, 2000):
            text = " ".join(f"w{draw.randrange(kinds)}" for _ in range(size))
            texts.append(text.replace("w1 ", "w1\n"))
    rows = [(i, t, "other") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    judged = quality_rules(docs.select("doc_id", "text"))
    for r in judged.collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == _base(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.base_failed and r.kept)
    every = judged.select("doc_id", "kept").collect()
    kept = {r.doc_id for r in judged.where("kept").collect()}
    assert kept == {r.doc_id for r in every if r.kept}


def test_mixing_meets_the_targets(spark):
    rows = [(i, "abc"[i % 3] if i % 7 else None, "w " * (1 + i % 9)) for i in range(3000)]
    rows += [(5000, "a", None), (5001, "a", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mixed_counts(docs)
    first = sorted(map(tuple, mixed.select("doc_id", "size", "copies", "target").collect()))
    assert first == sorted(map(tuple, mixed.select("doc_id", "size", "copies", "target").collect()))
    source = {i: s for i, s, _ in rows}
    total = sum(size for _, size, _, _ in first)
    assert all(copies <= 2 for _, _, copies, _ in first)
    targets = {source[i]: target for i, _, _, target in first}
    assert abs(sum(targets.values()) - 1.5 * total) < 1
    for name, target in targets.items():
        taken = sum(size * copies for i, size, copies, _ in first if source[i] == name)
        assert abs(taken - target) < 0.1 * target


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70000])
def test_coded_ids_come_back(n):
    draw = np.random.default_rng(n)
    ids = np.minimum(draw.zipf(1.3, n), 50256).astype(np.uint32)
    frame = encode_frame(ids)
    assert np.array_equal(decode_frame(frame), ids)
    if n >= 1000:
        broken = bytearray(frame)
        broken[len(broken) // 2] ^= 0x55
        with pytest.raises(Damaged):
            decode_frame(bytes(broken))


def test_planned_sequences_hold_every_piece():
    counts = {2048: 3, 1500: 10, 548: 9, 300: 100, 7: 1000, 1: 500}
    plan = plan_sequences(dict(counts), Capacity())
    tokens = sum(length * n for length, n in counts.items())
    used = sum(times for times, _ in plan)
    assert used >= tokens / 2048
    assert used <= tokens / 2048 + 25


def test_embeddings_link_as_all_pairs_do(spark):
    draw = np.random.default_rng(3)
    vectors = [draw.normal(size=32) for _ in range(150)]
    vectors += [vectors[i % 20] + 0.05 * draw.normal(size=32) for i in range(80)]
    vectors += [vectors[0] * 2, vectors[0] * 3]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [None, [0.0] * 32, [float("nan")] * 32, [None] + [1.0] * 31]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    near = np.argwhere(np.triu(unit @ unit.T >= 0.95, 1)).tolist()
    found = {r.vec_id: r for r in itq_near_duplicates(table).collect()}
    assert len(found) == len(rows)
    expected = sum(2 for _ in near)
    assert 0.9 * expected <= sum(r.n_links for r in found.values()) <= expected
    assert all(found[1000 + i].n_links == 0 and found[1000 + i].kept for i in range(4))


def test_empty_tables_give_empty_results(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert ngram_jaccard(docs).count() == 0
    assert quality_rules(docs.select("doc_id", "text")).count() == 0
    assert mixed_counts(docs).count() == 0
