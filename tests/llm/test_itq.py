"""Near duplicates of vectors: pairs are compared where they meet, and the driver sees none."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from tillscope.llm import itq as module
from tillscope.llm.itq import Settings, code_parts, itq_near_duplicates, unit

KIND = "vec_id long, embedding array<{}>, label int"


def _near(draw, base, n, by):
    return [base + by * draw.normal(size=len(base)) for _ in range(n)]


def _rows(draw):
    """Loose vectors, near ones, copies, two lengths besides, and rows without a vector."""
    vectors = list(draw.normal(size=(150, 32)))
    for k, by in enumerate((0.02, 0.1, 0.2, 0.25)):
        vectors += _near(draw, vectors[k], 30, by)
    vectors += [vectors[5]] * 3 + [vectors[151]] * 2
    vectors += list(draw.normal(size=(20, 3))) + _near(draw, np.ones(3), 10, 0.1)
    vectors += [np.array([x]) for x in (1.0, 2.0, -1.0, 0.0)]
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(vectors)]
    return rows + [(5000, None, 0), (5001, [], 0), (None, rows[0][1], 0), rows[7], rows[7]]


def _linked(rows, settings, models):
    """Of every two rows whether they link: the stated rule, pair by pair."""
    links = []
    able = [(i, r[0], np.array(r[1])) for i, r in enumerate(rows) if r[0] is not None and r[1] and any(r[1])]
    codes = {i: int(models[len(v)].codes(v[None])[0]) & ((1 << 64) - 1) for i, _, v in able}
    for a, (i, _, v) in enumerate(able):
        for j, _, w in able[a + 1 :]:
            if len(v) != len(w):
                continue
            parts = code_parts(min(settings.bits, len(v)), settings.tables)
            apart = codes[i] ^ codes[j]
            meet = any((apart >> at & (1 << n) - 1).bit_count() <= 1 for at, n in parts)
            close = (unit(v[None]) * unit(w[None])).sum(1)[0] >= settings.cosine
            if (v == w).all() or (meet and close and apart.bit_count() <= settings.farthest):
                links.append((i, j))
    return links


@pytest.mark.parametrize("number", ["float", "double"])
def test_links_are_those_of_all_pairs_however_the_places_are_cut(spark, monkeypatch, number):
    rows = _rows(np.random.default_rng(8))
    table = spark.createDataFrame(rows, KIND.format(number)).repartition(5)
    seen = {}
    own = module._models

    def kept(classes, settings):
        seen.update(own(classes, settings))
        return dict(seen)

    monkeypatch.setattr(module, "_models", kept)
    found = []
    for together in (1 << 22, 2000, 150):
        settings = Settings(together=together)
        out = itq_near_duplicates(table, settings=settings)
        found.append(sorted(map(tuple, out.collect()), key=str))
    assert found[0] == found[1] == found[2]

    links = _linked(rows, Settings(), {n: model for n, (_, model) in seen.items()})
    n = [0] * len(rows)
    least = [r[0] for r in rows]
    for i, j in links:
        n[i] += 1
        n[j] += 1
    for _ in rows:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    assert sorted(n)[-30] >= 25
    expected = [(r[0], k, c, c is not None and c == r[0]) for r, k, c in zip(rows, n, least)]
    assert found[0] == sorted(expected, key=str)


def test_rotations_are_learned_in_tasks(spark, monkeypatch):
    own = module.learn_rotation

    def learn(vectors, settings):
        assert TaskContext.get() is not None, "the driver holds the sample"
        return own(vectors, settings)

    monkeypatch.setattr(module, "learn_rotation", learn)
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(draw.normal(size=(40, 16)))]
    assert itq_near_duplicates(spark.createDataFrame(rows, KIND.format("float"))).count() == 40


def test_near_copies_leave_a_row_for_each_of_their_places(spark, monkeypatch):
    """Not one for each pair of them."""
    written = []
    own = module.written

    def counted(df, name):
        out = own(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(module, "written", counted)
    draw = np.random.default_rng(2)
    vectors = _near(draw, draw.normal(size=32), 300, 0.01) + list(draw.normal(size=(100, 32)))
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    found = itq_near_duplicates(spark.createDataFrame(rows, KIND.format("double")))
    near = found.where("vec_id < 300 AND component_id = 0").agg(F.min("n_links"), F.max("n_links"))
    assert tuple(near.first())[1] <= 299 and tuple(near.first())[0] > 150
    assert sum(n for name, n in written if name == "itq-links") <= 8 * 400


@pytest.mark.parametrize(("bits", "equal", "pairs", "many"), [(3, True, 7, 2), (4, False, 50, 9),
                                                              (5, True, 1 << 16, 32), (1, True, 3, 1)])
def test_pairs_one_bit_apart_come_once(monkeypatch, bits, equal, pairs, many):
    monkeypatch.setattr(module, "_PAIRS", pairs)
    monkeypatch.setattr(module, "_MANY", many)
    draw = np.random.default_rng(bits)
    local = np.sort(np.minimum(draw.geometric(0.4, 150) - 1, (1 << bits) - 1))
    codes = draw.integers(0, 1 << 12, 150).astype(np.uint64)
    got = [
        (min(p), max(p))
        for a, b in module._near(local, codes, bits, equal, 5)
        for p in zip(a.tolist(), b.tolist())
    ]
    expected = [
        (i, j)
        for i in range(150)
        for j in range(i + 1, 150)
        if int(local[i] ^ local[j]).bit_count() in ((0, 1) if equal else (1,))
        and int(codes[i] ^ codes[j]).bit_count() <= 5
    ]
    assert sorted(got) == expected and expected


def test_embeddings_of_an_empty_table(spark):
    for rows in ([], [(1, None, 0), (None, [1.0], 0)]):
        found = itq_near_duplicates(spark.createDataFrame(rows, KIND.format("float")))
        assert [(r.n_links, r.kept) for r in found.collect()] == [(0, r[0] is not None) for r in rows]
