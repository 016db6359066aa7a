"""Families of near copies: their rows stay in proportion to the documents, and every way of comparing them gives the same groups."""

import random

import numpy as np
import pytest

from ticktide.llm import near_dedup

from .test_operators import DOCS, groups


def family(n: int):
    """Copies of one text with 0 to 20 of its 150 words changed: most link, the others are near all and linked with few."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(n):
        mine = list(words)
        for k in rng.sample(range(150), rng.choice((0, 2, 5, 9, 13, 16, 20))):
            mine[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(mine), None, None, 0))
    return rows


def test_a_family_costs_rows_in_proportion(spark, monkeypatch):
    """No stage of 400 near copies has more rows than their buckets; a list of the pairs to confirm would."""
    kept, sizes = near_dedup.stage, {}

    def stage(df, tag):
        out = kept(df, tag)
        sizes[tag] = max(sizes.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(near_dedup, "stage", stage)
    rows = family(400)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), width=2).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == groups(rows, 2)
    assert max(sizes.values()) <= near_dedup.BANDS * 400, sizes


@pytest.mark.parametrize(("weight", "dense"), [(2000, 64), (2000, 0)])
def test_families_by_blocks_and_by_pairs(spark, monkeypatch, weight, dense):
    monkeypatch.setattr(near_dedup, "WEIGHT", weight)
    monkeypatch.setattr(near_dedup, "DENSE", dense)
    rows = family(120)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), width=2).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == groups(rows, 2)


@pytest.mark.parametrize(("rare", "expanded"), [(1, 50), (160, 2_000_000), (10**6, 50)])
def test_overlaps(monkeypatch, rare, expanded):
    monkeypatch.setattr(near_dedup, "RARE", rare)
    monkeypatch.setattr(near_dedup, "EXPANDED", expanded)
    monkeypatch.setattr(near_dedup, "SLICE", 16)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(200, rng.integers(1, 90)).astype(np.uint64) ** np.uint64(5)) for _ in range(30)]
    want = [[len(np.intersect1d(x, y)) for y in sets[9:]] for x in sets[:9]]
    assert near_dedup.overlaps(sets[:9], sets[9:]).tolist() == want
