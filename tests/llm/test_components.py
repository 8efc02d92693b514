"""Connected components by rounds and by one last task, against a plain union."""

import random

import pytest

from tallyscope.llm import components as C


def plain(pairs):
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


@pytest.mark.parametrize("last", [-1, 40, 500_000])
def test_rounds_and_the_last_task_agree(spark, monkeypatch, last):
    monkeypatch.setattr(C, "LAST_LINKS", last)
    rng = random.Random(last)
    pairs = [(rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(70)] + [(100 + i, 101 + i) for i in range(25)] + [(500, 600 + i) for i in range(40)] + [(7, 7)]
    got = {r.node: r.component for r in C.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(4)).collect()}
    assert got == plain(pairs)


def test_no_links(spark):
    assert C.connected_components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).count() == 0
