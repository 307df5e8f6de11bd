"""Connected components: the classes of all links, and no round more than they need."""

from __future__ import annotations

import random

import pytest

from tillscope.llm import components as module
from tillscope.llm.components import components

SCHEMA = "u bigint, v bigint"


@pytest.fixture
def writes(monkeypatch):
    """The tables written on the way: the links as given, and one of each round."""
    made = []
    own = module.written

    def counted(df, name):
        made.append(name)
        return own(df, name)

    monkeypatch.setattr(module, "written", counted)
    return made


def _found(spark, links):
    rows = components(spark.createDataFrame(links, SCHEMA)).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


def _classes(links):
    label = {n: n for u, v in links if None not in (u, v) and u != v for n in (u, v)}
    for _ in label:
        for u, v in links:
            if u in label and v in label:
                label[u] = label[v] = min(label[u], label[v])
    return label


def test_components_are_the_classes_of_all_links(spark):
    draw = random.Random(3)
    links = [(draw.randint(-40, 40), draw.randint(-40, 40)) for _ in range(45)]
    links += [(100 + k, 101 + k) for k in range(23)] + [(7, 7), (300, 300), (None, 5), (5, None), (None, None)]
    assert _found(spark, links + links[:9]) == _classes(links)


def test_stars_take_no_round(spark, writes):
    links = [(k, 1) for k in range(2, 40)] + [(50, 60), (50, 61), (60, 50)]
    assert _found(spark, links) == _classes(links)
    assert len(writes) == 1


def test_stars_whose_smallest_nodes_link_take_one_round(spark, writes):
    links = [(k, k % 4) for k in range(4, 40)] + [(3, 1), (2, 1)]
    assert _found(spark, links) == _classes(links)
    assert len(writes) == 2


def test_no_links_give_no_nodes(spark, writes):
    assert _found(spark, []) == {}
    assert _found(spark, [(4, 4), (None, 1)]) == {}
    assert len(writes) == 2


def test_too_few_rounds_are_refused(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(64)], SCHEMA)
    with pytest.raises(RuntimeError, match="did not settle"):
        components(chain, most_rounds=1)
