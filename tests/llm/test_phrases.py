"""Phrases against brute force, and the automata by themselves."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from famloom.llm import count_automata, phrases, queries
from famloom.llm.count_automata import CountTransducer
from oracle import connect, difference

SCHEMA = "doc_id bigint, text string, lang string, rank int, phrase string, part string, a int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_force(rows, least, top, longest=4):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in held.items():
            inside = any(
                len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, b in held.items()
            )
            if not inside:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def odd_rows():
    draw = random.Random(3)
    stock = ["the", "of", "A", "b", "é", "ÉÉ", "z\x00", " x", "日本", "w" * 300]
    rows = []
    for i in range(150):
        words = draw.choices(stock, weights=[30, 20, 9, 8, 7, 6, 5, 4, 3, 2], k=draw.randrange(60))
        gaps = draw.choices([" ", "  ", "\t", ". ", ",", "\n", "\r\n", " \x0b", "? !"], [60, 5, 5, 3, 3, 3, 3, 1, 1], k=len(words))
        text = "".join(w + g for w, g in zip(words, gaps))
        rows.append((i, text, draw.choice(["en", "en", "de", None, "und", ""]), i, "x", "y", 1))
    rows += [(1, "hot pair of words. " * 300, "en", 1, None, None, None)] * 3
    rows += [(2, "no break at all " * 900 + "tail", "xx", 1, "", "", 1)]
    rows += [(3, "x" * 5000 + " b " + "y" * 7000, "xx", 1, "", "", 1), (4, "a b a b " * 40, "xx", 1, "", "", 1)]
    rows += [(None, None, None, None, None, None, None), (5, "", "en", 1, "", "", 1), (6, " \t.,!\n", "fr", 1, "", "", 1)]
    return rows


@pytest.mark.parametrize("slice_bytes,range_bytes", [(16 << 20, 12 << 20), (700, 4000)])
def test_against_brute_force(spark, slice_bytes, range_bytes):
    rows = odd_rows()
    found = phrases.mine_phrases(
        spark.createDataFrame(rows, SCHEMA), least=4, top=60, slice_bytes=slice_bytes, range_bytes=range_bytes
    )
    got = sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == by_force(rows, 4, 60)


def test_nothing(spark):
    for rows in ([], [(1, "one two", "en", 1, "", "", 1)], [(1, None, None, None, None, None, None)]):
        assert phrases.mine_phrases(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_ranges_do_not_change_the_result(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    cut = phrases.mine_phrases(docs, range_bytes=30_000, slice_bytes=60_000)
    name = "op13_phrases"
    whole = queries.QUERIES[name](spark, folder)
    assert difference(whole, connect(folder), queries.ORACLES[name]) is None
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


def _trie(texts, depth=3):
    words = [w for t in texts for w in t]
    piece = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return count_automata.build(pa.array(words, pa.large_binary()), piece, depth)


def test_cut_and_united_tries_keep_all_counts():
    draw = random.Random(1)
    stock = [bytes([c]) * draw.randrange(1, 3) for c in b"abcdef"]
    texts = [[draw.choice(stock) for _ in range(draw.randrange(1, 30))] for _ in range(40)]
    want = Counter()
    for t in texts:
        for k in (1, 2, 3):
            want.update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
    keys = sorted(want)
    boundaries = sorted(set(draw.sample(keys, 15)) | {(b"a",), (b"zz",), (b"c", b"nowhere")})
    parts = {}
    for half in (texts[::2], texts[1::2]):
        for number, part in count_automata.split(_trie(half), boundaries):
            copy = count_automata.trie_from_bytes(count_automata.trie_to_bytes(part))
            parts.setdefault(number, []).append(copy)
    got = {}
    for number, tries in parts.items():
        for sequence, count in count_automata.sequences(count_automata.union(tries)):
            assert sequence not in got and sum(b <= sequence for b in boundaries) == number
            got[sequence] = count
    assert got == dict(want)
    often = {}
    for tries in parts.values():
        often |= dict(count_automata.sequences(count_automata.union(tries, least=5)))
    assert often == {s: c for s, c in want.items() if c >= 5}


def test_transducer_shares_states_and_composes():
    pairs = [((a, b, c), i) for i, (a, b, c) in enumerate((a, b, c) for a in (b"x", b"y") for b in (b"p", b"q") for c in (b"1", b"2"))]
    pairs = sorted([*pairs, ((b"x",), 77), ((b"x", b"p"), 78)])
    made = CountTransducer.of(pairs)
    assert list(made.items()) == pairs and len(made.arcs) < 8  # a trie has 15 states
    copy = CountTransducer.from_bytes(made.to_bytes())
    asked = CountTransducer.of([((b"x", b"p"), 0), ((b"y", b"q", b"2"), 0), ((b"z",), 0)])
    assert list(copy.compose(asked)) == [((b"x", b"p"), 78), ((b"y", b"q", b"2"), 7)]
    assert list(CountTransducer.of([]).items()) == []
    with pytest.raises(ValueError):
        CountTransducer.of([((b"b",), 1), ((b"a",), 1)])
