"""Licence families: planted lines found, other paragraphs left alone, awkward rows."""

from __future__ import annotations

import random

import pytest

from tillscope.llm.licences import TEMPLATES, Settings, _calibrated, fit_licences, licence_scan

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "so", "ta", "vi") for b in ("den", "lar", "mos", "pit", "ran", "tul")]


def _prose(draw, lines):
    return "\n".join(
        " ".join(draw.choices([*WORDS, "the", "this", "under", "all", "any"], k=draw.randint(4, 25)))
        for _ in range(lines)
    )


@pytest.fixture(scope="module")
def model(spark):
    draw = random.Random(1)
    rows = [(i, _prose(draw, 8)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return fit_licences(docs, Settings(background=300))


def test_planted_lines_are_found_and_others_left_alone(spark, model):
    draw = random.Random(2)
    rows, expected = [], {}
    for k, (family, line) in enumerate(TEMPLATES):
        shapes = (line, line.upper(), f"  * {line}", f"Copyright 2021 Someone. {line}")
        text = "\n".join([_prose(draw, 3), shapes[k % 4], _prose(draw, 2)])
        rows.append((k, text, -1))
        expected[k] = family
    rows += [(1000 + k, _prose(draw, 6), -1) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_licences long")
    found = {r.doc_id: r for r in licence_scan(docs, model).collect()}
    assert len(found) == len(rows)
    right = [k for k, family in expected.items() if list(found[k].licences) == [family]]
    assert len(right) >= 0.9 * len(expected), sorted(set(expected) - set(right))
    clean = [found[1000 + k] for k in range(120)]
    assert all(r.n_licences == 0 and r.licences == [] and r.probability is None for r in clean)


def test_awkward_rows_have_defined_results(spark, model):
    line = "Licensed under the Apache License, Version 2.0."
    long = "\n".join([_prose(random.Random(4), 4000), line])
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, line), (4, line), (None, line), (5, long), (6, f"{line}\n{line}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.n_licences, list(r.licences)) for r in licence_scan(docs, model).collect()]
    one = (1, ["Apache-2.0"])
    assert sorted(found, key=repr) == sorted(
        [(1, 0, []), (2, 0, []), (3, 0, []), (4, *one), (4, *one), (None, *one), (5, *one), (6, *one)], key=repr
    )


def test_empty_tables(spark, model):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licence_scan(empty, model).count() == 0
    assert licence_scan(empty, fit_licences(empty)).count() == 0


def test_the_whole_background_is_learned_from(spark):
    """Long paragraphs count too, and shares of words are those of all paragraphs."""
    draw = random.Random(5)
    often = ["hereby", "mozilla", "creative", "bsd", "waived", "mit", "fee", "affero", "isc", "lesser"]
    lines = [" ".join([*draw.choices(WORDS, k=5), str(i + 100)]) for i in range(400)]
    lines = [f"{x} {often[i % 10]}" if i % 20 < 10 else x for i, x in enumerate(lines)]
    for i in range(60):
        lines[20 * (i % 20) + 10 + i // 20] += " " + " ".join([*draw.choices(WORDS, k=400), "redistribute"])
    docs = spark.createDataFrame([(0, "\n".join(lines))], "doc_id long, text string")
    words = fit_licences(docs, Settings(background=10)).words  # common: in 20 of the 400
    assert not {*often, "redistribute"} & set(words)
    assert {"gpl", "apache", "noncommercial"} <= set(words)


def test_threshold_is_the_probability_that_too_many_reach(spark):
    draw = random.Random(6)
    rows = [(draw.choice([0.2, 0.5, 0.9, 1.0, draw.random()]), draw.randint(1, 9)) for _ in range(300)]
    alarms = spark.createDataFrame(rows, "probability double, n long")
    each = sorted((p for p, n in rows for _ in range(n) if p >= 0.5), reverse=True)
    for allowed in (0, 1, 17, len(each) - 1):
        assert _calibrated(alarms, allowed) == each[allowed]
    assert _calibrated(alarms, len(each)) == _calibrated(alarms.limit(0), 0) == 0.5
