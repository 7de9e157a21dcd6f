"""Hard negatives against brute force, and the threshold join by itself."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from famloom.llm import hard_negatives, queries
from oracle import connect, difference

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank int, score string, vector string"


def by_force(rows, positives=5, negatives=5, floor=80):
    table = {}
    for key, vector, label, *_ in rows:
        if key is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        item = (label, [math.floor(256 * float(np.float32(x))) for x in vector])
        table[key] = min(table.get(key, item), item)
    score = lambda a, b: sum(x * y for x, y in zip(table[a][1], table[b][1]))
    out = []
    for anchor in table:
        if anchor % 100:
            continue
        ranked = sorted((k for k in table if k != anchor), key=lambda k: (-score(anchor, k), k))
        same = [k for k in ranked if table[k][0] == table[anchor][0]]
        other = [k for k in ranked if table[k][0] != table[anchor][0]]
        for positive in same[:positives]:
            top = score(anchor, positive)
            window = [k for k in other if floor * top <= 100 * score(anchor, k) <= 100 * top]
            for rank, k in enumerate(window[:negatives], 1):
                out.append((anchor, positive, rank, k, top, score(anchor, k)))
    return sorted(out)


def odd_rows():
    draw = random.Random(5)
    rows = []
    for i in range(900):
        size = draw.choice([12, 12, 12, 9, 0])
        vector = [draw.gauss(0.1, 0.3) for _ in range(size)]
        rows.append([i, vector, draw.randrange(4), i, "x", "y"])
    hot = [0.4] * 12
    for i in range(1000, 1400):  # a third of all rows are one vector
        rows.append([i, hot, i % 2, i, None, None])
    rows += [rows[3], rows[3], [3, [1.0] * 12, 3, 0, None, None]]
    rows += [[500, [0.5] * 12, None, 1, "", ""], [None, hot, 1, 1, "", ""], [600, None, 1, 1, "", ""]]
    rows += [[2000, [None, 1.0], 1, 1, "", ""], [2100, [float("nan")], 1, 1, "", ""]]
    rows += [[2200, [float("inf")] * 12, 1, 1, "", ""], [2300, [-0.5] * 12, 9, 1, "", ""]]
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("row_block,anchor_block", [(4096, 4096), (97, 4)])
def test_against_brute_force(spark, row_block, anchor_block):
    rows = odd_rows()
    vectors = hard_negatives.quantized(spark.createDataFrame(rows, SCHEMA))
    found = hard_negatives.hard_negatives(
        vectors, F.col("vec_id") % 100 == 0, row_block=row_block, anchor_block=anchor_block
    )
    assert sorted(tuple(r) for r in found.collect()) == by_force(rows)


def test_nothing(spark):
    for rows in ([], [(1, [0.5], 1, 1, "", "")], [(100, [], 1, 1, "", ""), (2, [], 2, 1, "", "")]):
        vectors = hard_negatives.quantized(spark.createDataFrame(rows, SCHEMA))
        assert hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("scale", [1, 300, 1 << 20])
def test_threshold_join_loses_nothing(scale):
    draw = np.random.default_rng(scale)
    falling = np.linspace(3, 0.05, 70)
    anchors = (draw.normal(size=(300, 70)) * falling * scale).astype(np.int64)
    rows = (draw.normal(size=(500, 70)) * falling * scale).astype(np.int64)
    scores = anchors @ rows.T
    for share in (50, 99, 99.9):
        least = np.percentile(scores, share, axis=1).astype(np.int64)
        least[:3] = [-(2**60), 0, 2**60]
        got = sorted(zip(*(x.tolist() for x in hard_negatives.reaching(anchors, rows, least))))
        i, j = np.nonzero(scores >= least[:, None])
        assert got == sorted(zip(i.tolist(), j.tolist(), scores[i, j].tolist()))


def test_too_large_scores_are_refused():
    with pytest.raises(ValueError, match="2\\*\\*56"):
        hard_negatives.reaching(np.array([[1 << 40]]), np.array([[1 << 40]]), np.array([0]))


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    name = "op11_hard_negatives"
    assert difference(queries.QUERIES[name](spark, folder), connect(folder), queries.ORACLES[name]) is None
