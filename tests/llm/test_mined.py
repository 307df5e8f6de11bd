"""Whitening, secret scans and hard negatives against brute force on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from tillscope.llm.hard_negatives import Settings, exact_scores, hard_negatives, primes_for
from tillscope.llm.secrets import secret_scan
from tillscope.llm.whitening import whiten

NAN, INF = float("nan"), float("inf")


def _vectors(n=300, length=20, seed=4):
    draw = np.random.default_rng(seed)
    turn = draw.normal(size=(length, length))
    plain = draw.normal(size=(n, length)) @ turn * 0.2 + draw.normal(size=length)
    rows = [[float(np.float32(x)) for x in v] for v in plain]
    rows += [rows[0]] * 200 + [rows[1]] * 5  # copies
    return rows


ODD = [None, [], [None] * 20, [1.0] * 19 + [None], [NAN] * 20, [INF] + [0.0] * 19, [1.0] * 3,
       [1e300] * 20]


def test_whitening_equals_a_direct_one(spark):
    vectors = _vectors()
    rows = [(i, v, "x", 7) for i, v in enumerate(vectors)]
    rows += [(9000 + i, v, None, 0) for i, v in enumerate(ODD)] + [(None, vectors[2], "", 1)]
    rows += [rows[5], rows[5]]
    table = spark.createDataFrame(
        rows, "vec_id long, embedding array<double>, component string, n int"
    )
    found = whiten(table.repartition(7)).collect()
    used = [(i, v) for i, v, *_ in rows if v in vectors]
    assert len(found) == 16 * len(used)

    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in used]
    fit = sorted({tuple(v) for v in x})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    centred = [[Fraction(c) - Fraction(s, n) for c, s in zip(v, sums)] for v in fit]
    covariance = np.array(
        [[float(sum(r[a] * r[b] for r in centred) / n) for b in range(20)] for a in range(20)]
    )
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    scores = {
        i: (np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(v, sums)]) @ axes)
        / np.sqrt(values)
        for (i, _), v in zip(used, x)
    }
    deviation = {
        i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for (i, _), v in zip(used, x)
    }
    first = {r.component: np.sign(r.whitened * scores[0][r.component - 1])
             for r in found if r.vec_id == 0}
    for r in found:
        k = r.component - 1
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert r.whitened * first[r.component] == pytest.approx(scores[r.vec_id][k], abs=1e-7)
        assert r.explained == pytest.approx(values[k] / np.trace(covariance), rel=1e-9)
        assert 0 <= r.identity_error < 1e-9
    assert sorted({r.component for r in found}) == list(range(1, 17))


def test_whitening_of_large_numbers_is_exact(spark):
    rows = [(i, [2.0**45 * (i % 5), float(i), -(2.0**45) * (i % 3)]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = whiten(table).collect()
    assert {r.component for r in found} == {1, 2, 3}
    fit = {tuple(int(64 * c) + 1_000_000 for c in v) for _, v in rows}
    sums = [sum(c) for c in zip(*fit)]
    for r in found:
        own = [int(64 * c) + 1_000_000 for c in rows[r.vec_id][1]]
        exact = sum((len(fit) * c - s) ** 2 for c, s in zip(own, sums))
        assert r.deviation == (exact if exact < 1 << 63 else None)
        assert r.identity_error < 1e-4
        # the small dimension is below the rounding of the large ones
        assert (r.whitened is None) == (r.component == 3)


def test_whitening_without_variance_and_without_rows(spark):
    kind = "vec_id long, embedding array<float>"
    same = whiten(spark.createDataFrame([(i, [0.5, 0.25]) for i in range(4)], kind)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in same] == [(1, 0, None, None)] * 8
    flat = whiten(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], kind)).collect()
    assert {r.component for r in flat if r.whitened is None} == {2}
    for rows in ([], [(1, None)]):
        assert whiten(spark.createDataFrame(rows, kind)).count() == 0


@pytest.mark.parametrize(("largest", "length"), [(1, 1), (150, 64), (3000, 64), (2**24, 700),
                                                 (20, 3000)])
def test_residues_give_exact_scores(largest, length):
    draw = np.random.default_rng(largest)
    left = draw.integers(-largest, largest + 1, (13, length))
    right = draw.integers(-largest, largest + 1, (17, length))
    right[0], right[1] = left[0], -left[0]
    left[1] = 0
    expected = left.astype(object) @ right.T.astype(object)
    assert (exact_scores(left, right).astype(object) == expected).all()


def test_primes_differ_and_suffice():
    for bound, depth in ((1, 64), (10**5, 64), (10**17, 64), (10**12, 5000)):
        primes = primes_for(bound, depth)
        assert len(set(primes)) == len(primes) and np.prod([float(p) for p in primes]) > 2 * bound
        assert min(depth, 1024) * ((primes[0] - 1) // 2) ** 2 < 1 << 24
    with pytest.raises(OverflowError):
        primes_for(10**1000, 64)


def _mined(rows, settings, is_anchor):
    """Anchor by anchor; rows of (id, label, whole numbers)."""
    out = []
    for a, label, v in rows:
        if not is_anchor(a):
            continue
        scores = [
            (-sum(x * y for x, y in zip(v, w)), i, other == label)
            for i, other, w in rows
            if i != a and len(w) == len(v)
        ]
        for p, i, _ in sorted(s for s in scores if s[2])[: settings.positives]:
            fits = sorted(
                s for s in scores
                if not s[2]
                and settings.least_percent * -p <= 100 * -s[0] <= settings.most_percent * -p
            )
            for rank, (s, j, _) in enumerate(fits[: settings.negatives], 1):
                out.append((a, i, rank, j, -p, -s))
    return sorted(out)


@pytest.mark.parametrize("sizes", [(4096, 8192), (3, 7)])
def test_hard_negatives_equal_all_pairs(spark, sizes):
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(150, 12)) * 0.4
    vectors[40:80] = vectors[40] + draw.normal(size=(40, 12)) * 0.02
    vectors[90:120] = vectors[90]  # ties
    rows = [(i * 3, int(i % 4 if i % 3 else 0), [float(x) for x in v]) for i, v in
            enumerate(vectors)]
    rows += [(1000 + i, 1, [float(x) for x in draw.normal(size=5)]) for i in range(9)]
    rows += [(2000, 9, rows[0][2])]  # alone with its label
    odd = [(3000, None, rows[0][2]), (None, 1, rows[0][2]), (3001, 1, None), (3002, 1, []),
           (3003, 1, [None] * 12), (3004, 1, [NAN] * 12), (3005, 1, [1e200] * 12)]
    twice = [rows[3], rows[3], (rows[4][0], rows[4][1] + 1, rows[4][2])]
    settings = Settings(anchors_per_block=sizes[0], rows_per_block=sizes[1])
    table = spark.createDataFrame(
        [(*r, "x", 0) for r in rows + odd + twice],
        "vec_id long, label long, embedding array<double>, rank string, length int",
    )
    whole = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in rows]
    for anchor, test in (("vec_id % 10 = 0", lambda i: i % 10 == 0), ("label = 0 AND vec_id < 60",
                         lambda i: i < 60 and dict((r[0], r[1]) for r in rows)[i] == 0)):
        found = hard_negatives(table, anchor, settings)
        got = sorted(
            (r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score)
            for r in found.collect()
        )
        assert got == _mined(whole, settings, test) and got


def test_hard_negatives_of_empty_tables(spark):
    kind = "vec_id long, label int, embedding array<float>"
    for rows in ([], [(0, None, None)], [(0, 1, [1.0])]):
        assert hard_negatives(spark.createDataFrame(rows, kind), "vec_id % 50 = 0").count() == 0


# patterns as their description states them, lengths checked afterwards
PATTERNS = (
    ("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*"
                          r"[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def _base(text):
    spans = [
        (m.start(), k, m.end())
        for k, (_, pattern, group, least) in enumerate(PATTERNS)
        for m in pattern.finditer(text or "")
        if len(m[group]) >= least
    ]
    return sorted(spans)


def _listed(spans, names=("assign", "access", "hex", "owned")):
    return ",".join(f"{names[k]}:{start}:{end}" for start, k, end in spans)


def _secret_texts():
    draw = random.Random(3)
    key = "AKIA" + "Q7" * 9
    hexes = ["%040x" % draw.getrandbits(160) for _ in range(6)]
    live = "Zx9-Yw8_Vu7-Ts6_Rq5-Po4"
    texts = [
        None, "", " ", "no secret here", "password=token: abcdefgh", 'token = "abc" secret=abcdef',
        "PassWord : 'hunter2hunter2' api-key=zzzzzz apikey=zzzzzz API_KEY==", f"é𝄞 {key} {key}x",
        "AKIA123 AKIAAKIA" + "A" * 16, hexes[0][:23] + " " + hexes[0][:24], "f" * 30 + "g" + "0" * 24,
        f"id {live} and {live}", "word" * 40, "secret" + " " * 50 + "=" + " " * 50 + "abcdef",
        'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"', "secret=" + "a" * 5 + "ß" * 9,
    ]
    texts += [f"copied {hexes[1]} Example-Key-0123456789abcXYZ n{i}" for i in range(40)]
    texts += [f"line {i} passwd={h}\n" * 30 for i, h in enumerate(hexes)]
    texts.append(" ".join("%032x" % draw.getrandbits(128) for _ in range(3000)))
    texts.append("secret=" * 2000)
    return texts


def test_secret_spans_equal_plain_finds(spark):
    rows = [(i, t, f"own{i % 3}", str(i), "x") for i, t in enumerate(_secret_texts())]
    rows += [(500, rows[11][1], None, None, "y"), rows[20], rows[20], (None, rows[6][1], "a", "b", "")]
    table = spark.createDataFrame(
        rows, "doc_id long, text string, owner string, repo string, spans string"
    )
    found = secret_scan(table.repartition(5), "owner", "repo").collect()
    assert len(found) == len(rows)
    texts = {i: t for i, t, *_ in rows}
    for r in found:
        base = _base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(_listed(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in base) for k in range(3)]
        named = [s for s in r.spans.split(",") if s and not s.startswith("owned:")]
        assert ",".join(named) == _listed(base)
        assert r.n_owned + r.n_copied == len([s for s in r.spans.split(",") if s])
        assert r.spans == ",".join(sorted(
            r.spans.split(","),
            key=lambda s: (int(s.split(":")[1]), ["assign", "access", "hex", "owned"].index(
                s.split(":")[0])) if s else 0,
        ))


def test_owned_and_copied_secrets_are_told_apart(spark):
    live, example = "Zx9-Yw8_Vu7-Ts6_Rq5-Po4", "Example-Key-0123456789abcXYZ"
    hot = "0123456789abcdef0123456789abcdef"
    rows = [(i, f"use {example} {hot}", f"o{i % 50}", f"r{i}") for i in range(3000)]
    rows += [(5000 + i, f"my {live}", "o1", f"r{i}") for i in range(2)]
    rows += [(6000 + i, f"ours {live[::-1]}", "o1", f"s{i}") for i in range(9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string")
    found = {r.doc_id: r for r in secret_scan(table, "owner", "repo").collect()}
    assert all(found[i].spans == "hex:33:65" and found[i].n_copied == 1 for i in range(3000))
    assert all(found[5000 + i].spans == "owned:3:26" and found[5000 + i].n_owned for i in range(2))
    # one owner, but in too many repositories
    assert all(found[6000 + i].spans == "" for i in range(9))
    wide = secret_scan(table, "owner", "repo", most_repositories=9)
    assert wide.where("doc_id >= 6000 AND n_owned = 1").count() == 9


def test_secret_scan_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, owner string, repo string")
    assert secret_scan(docs, "owner", "repo").count() == 0
