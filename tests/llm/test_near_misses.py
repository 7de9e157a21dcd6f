"""Near duplicates of one hot group whose pairs lie on both sides of the limit."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from famloom.llm import minhash

SCHEMA = "doc_id bigint, text string, _members int, cell int, band string, component int"


def _group(count, seed):
    """A base of 80 words with 1 to 6 words changed in each member, and some exact copies."""
    draw = random.Random(seed)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(count):
        words = list(base)
        for at in draw.sample(range(80), draw.randint(1, 6)):
            words[at] = f"x{draw.randrange(400)}"
        texts.append(" ".join(words))
    texts += texts[:20]
    draw.shuffle(texts)
    return texts


def _components(texts, least=75):
    """Smallest linked id of each text, from exact set similarities of all pairs."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    often = {s: i for i, s in enumerate(k for k, n in Counter(s for x in sets for s in x).items() if n > 1)}
    held = np.zeros((len(sets), len(often)), np.float32)
    for i, own in enumerate(sets):
        held[i, [often[s] for s in own if s in often]] = 1
    shared = (held @ held.T).astype(np.int64)
    sizes = np.array([len(s) for s in sets])
    linked = 100 * shared >= least * (sizes[:, None] + sizes[None, :] - shared)
    np.fill_diagonal(linked, True)  # shingles of one text alone are not counted above
    low = np.arange(len(sets))
    while True:
        following = np.where(linked, low[None, :], len(sets)).min(axis=1)
        if (following == low).all():
            return low.tolist(), linked
        low = following


@pytest.mark.parametrize("count,block,set_block", [(2000, 2048, 512), (400, 37, 11)])
def test_group_of_near_misses(spark, monkeypatch, count, block, set_block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SET_BLOCK", set_block)
    texts = _group(count, count)
    want, linked = _components(texts)
    assert 0.02 < linked.mean() < 0.9 and len(set(want)) > 10  # links, near misses and lone members
    rows = [(i, t, 1, 2, "b", 3) for i, t in enumerate(texts)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {r.doc_id: r.component_id for r in found}
    assert [got[i] for i in range(len(texts))] == want
    by = defaultdict(int)
    for r in found:
        by[r.component_id] += r.kept
    assert set(by.values()) == {1}
