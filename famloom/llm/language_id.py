"""Language identification by prediction by partial matching over bytes.

Per language a context tree holds how often each byte followed the last three, two, one
and no bytes.  A byte that a context has seen costs its share of the context's counts; an
unseen byte costs an escape and what the shorter context says, renormalised over the
bytes that the longer one has not seen (escape method C), down to a uniform choice.
Statistics are frozen after training, so an unseen byte costs a constant of its context
on top of the shorter context's code, and a tree is four sorted tables: the bits of
(context, byte) pairs that were seen, and the escape bits of contexts.  Every context of
every language is kept.  A text's code length is a sum over its distinct four-byte
strings.

The language with the shortest code wins, the smaller name on ties.  The score is its
posterior under equal priors against the other languages and against no language at all:
single bytes with the mean shares of all languages.  Letters in an order that no learned
language uses cost more by the trees than one by one, so their score is near 0.

Training reads labelled documents that the caller allows, chosen by a hash of the id: of
each language about ``SAMPLE_DOCS`` documents and ``SAMPLE_BYTES`` bytes, of all languages
together about ``SAMPLE_TOTAL`` bytes.  Every label is learned.  A tree is fitted by one
task from the distinct four-byte strings of its sample; trees are broadcast, and larger
ones than ``MODEL_BYTES`` together are refused with an error.  Texts are scored in blocks of
``BLOCK`` bytes, so a long text needs about three times its own size.

A null text, or one without a letter, is ``und`` with score 0, and so is every text if
there is no training document.  Repeated rows give repeated results, an empty table none;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from famloom.llm.common import slices, text_bytes
from famloom.session import discard, durable

SAMPLE_DOCS = 3000
SAMPLE_BYTES = 8 << 20
SAMPLE_TOTAL = 256 << 20
MODEL_BYTES = 256 << 20
BLOCK = 1 << 20
ORDER = 3
#: Bytes before a text's first.
_START = 10
_TREE = "lang string, depth int, grams binary, bits binary, contexts binary, escapes binary"


class Level(NamedTuple):
    """Contexts of one length: the last byte of a gram is the one that is coded."""

    grams: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray


class Model(NamedTuple):
    languages: list[str]
    #: per language its levels by context length; the first holds the bits of all 256 bytes
    trees: list[list[Level]]


def _with_starts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with ``ORDER`` start bytes before each, where texts begin and end."""
    data, offsets = text_bytes(batch.column("text"))
    sizes = np.diff(offsets)
    begins = offsets[:-1] + ORDER * np.arange(1, len(sizes) + 1)
    padded = np.full(len(data) + ORDER * len(sizes), _START, np.uint8)
    padded[_coded(len(padded), begins)] = data
    return padded, begins, begins + sizes


def _coded(size: int, begins: np.ndarray) -> np.ndarray:
    """Which bytes are text; start bytes are context only."""
    text = np.ones(size, bool)
    for k in range(1, ORDER + 1):
        text[begins - k] = False
    return text


def _blocks(
    padded: np.ndarray, begins: np.ndarray, ends: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(four-byte strings of coded bytes, texts, where each text begins) block by block."""
    text = _coded(len(padded), begins)
    for low in range(ORDER, len(padded), BLOCK):
        high = min(low + BLOCK, len(padded))
        near = padded[low - ORDER : high].astype(np.uint32)
        grams = near[:-3] << 24 | near[1:-2] << 16 | near[2:-1] << 8 | near[3:]
        first, last = np.searchsorted(ends, low, "right"), np.searchsorted(begins, high, "left")
        owners = np.arange(first, last)
        sizes = np.minimum(ends[owners], high) - np.maximum(begins[owners], low)
        owners, sizes = owners[sizes > 0], sizes[sizes > 0]
        if len(owners):
            yield grams[text[low:high]], owners, np.cumsum(sizes) - sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=BLOCK):
        languages, codes = np.unique(np.array(batch.column("lang").to_pylist()), return_inverse=True)
        names = pa.array(languages)
        for grams, owners, starts in _blocks(*_with_starts(batch)):
            owner = np.repeat(codes[owners].astype(np.uint64), np.diff(np.append(starts, len(grams))))
            found, counts = np.unique(owner << np.uint64(32) | grams, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    names.take(pa.array((found >> np.uint64(32)).astype(np.int64))).cast(pa.string()),
                    pa.array((found & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                    pa.array(counts, pa.int64()),
                ],
                ["lang", "gram", "n"],
            )


def sample(
    labelled: DataFrame,
    per_language: int = SAMPLE_DOCS,
    language_bytes: int = SAMPLE_BYTES,
    total_bytes: int = SAMPLE_TOTAL,
) -> DataFrame:
    """Rows (text, lang) of each language by a hash of doc_id; all where there are fewer.

    Shares stand in a stored table of one row per label, so a small one is broadcast and
    no text is moved to its label.
    """
    counts = durable(
        labelled.groupBy("lang").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")
        )
    )
    each = min(language_bytes, total_bytes / max(1, counts.count()))
    share = F.least(F.lit(per_language) / F.col("n"), F.lit(each) / F.greatest("size", F.lit(1)))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    shares = counts.select("lang", share.alias("share"))
    return labelled.join(shares, "lang").filter(drawn < F.col("share")).select("text", "lang")


def tree_of(grams: np.ndarray, n: np.ndarray) -> list[Level]:
    """The levels of one language from its distinct four-byte strings and their counts."""
    none = np.zeros(0, np.uint32)
    counts = np.bincount(grams & 255, n, 256)
    total, kinds = counts.sum(), np.count_nonzero(counts)
    escaped = kinds / (total + kinds) / max(1, 256 - kinds)
    chance = counts / total if kinds == 256 else np.where(counts > 0, counts / (total + kinds), escaped)
    tree = [Level(none, -np.log2(chance), none, np.zeros(0))]
    shorter, shares = np.arange(256), chance
    for depth in range(1, ORDER + 1):
        keys, place = np.unique(grams & ((1 << 8 * depth + 8) - 1), return_inverse=True)
        counts = np.bincount(place, n)
        contexts, owner = np.unique(keys >> 8, return_inverse=True)
        totals, kinds = np.bincount(owner, counts), np.bincount(owner)
        # What a longer context has seen, the shorter one has seen too.
        below = shares[np.searchsorted(shorter, keys & ((1 << 8 * depth) - 1))]
        rest = np.maximum(1 - np.bincount(owner, below), 1e-12)
        shorter, shares = keys, counts / (totals + kinds)[owner]
        escapes = np.log2(rest) - np.log2(kinds / (totals + kinds))
        tree.append(Level(keys, -np.log2(shares), contexts, escapes))
    return tree


def _fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    tree = tree_of(rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.float64))
    kinds = (np.uint32, np.float32, np.uint32, np.float32)
    return pd.DataFrame(
        [
            (key[0], depth, *(part.astype(kind).tobytes() for part, kind in zip(level, kinds)))
            for depth, level in enumerate(tree)
        ],
        columns=["lang", "depth", "grams", "bits", "contexts", "escapes"],
    )


def train(labelled: DataFrame, per_language: int = SAMPLE_DOCS) -> Model | None:
    """Fit the trees to rows (doc_id, text, lang) with text and lang; None without rows."""
    counts = (
        sample(labelled.select("doc_id", "text", "lang"), per_language)
        .mapInArrow(_count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    levels = durable(counts.groupBy("lang").applyInPandas(_fit, _TREE))
    parts = ["grams", "bits", "contexts", "escapes"]
    size = levels.agg(F.sum(sum(F.octet_length(p).cast("bigint") for p in parts))).first()[0]
    if size is None:
        return None
    if size > MODEL_BYTES:
        raise ValueError(f"trees of {size} bytes, more than MODEL_BYTES: take a smaller sample")
    trees: dict[str, list[Level]] = {}
    for row in sorted(levels.collect(), key=lambda r: (r.lang, r.depth)):
        kinds = (np.uint32, np.float32, np.uint32, np.float32)
        trees.setdefault(row.lang, []).append(
            Level(*(np.frombuffer(row[p], kind) for p, kind in zip(parts, kinds)))
        )
    discard(levels)
    return Model(list(trees), list(trees.values()))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of every key in a sorted table."""
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


def gram_bits(tree: list[Level], grams: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each four-byte string after its first three."""
    bits, open_ = np.zeros(len(grams), np.float64), np.arange(len(grams))
    for depth in range(ORDER, 0, -1):
        level, keys = tree[depth], grams[open_] & np.uint32((1 << 8 * depth + 8) - 1)
        at, seen = _find(level.grams, keys)
        bits[open_[seen]] += level.bits[at[seen]]
        open_, keys = open_[~seen], keys[~seen]
        at, known = _find(level.contexts, keys >> np.uint32(8))
        bits[open_[known]] += level.escapes[at[known]]
    bits[open_] += tree[0].bits[grams[open_] & np.uint32(255)]
    return bits


def code_lengths(model: Model, batch: pa.RecordBatch) -> np.ndarray:
    """Bits of every text (rows) under every language (columns), and last under none."""
    alone = -np.log2(np.mean([np.exp2(-tree[0].bits.astype(np.float64)) for tree in model.trees], axis=0))
    totals = np.zeros((batch.num_rows, len(model.languages) + 1))
    for grams, owners, starts in _blocks(*_with_starts(batch)):
        coded = pa.array(grams).dictionary_encode()
        distinct, place = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        order = np.argsort(distinct)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        distinct, place = distinct[order], rank[place]
        for i, tree in enumerate(model.trees):
            totals[owners, i] += np.add.reduceat(gram_bits(tree, distinct)[place], starts)
        totals[owners, -1] += np.add.reduceat(alone[grams & np.uint32(255)], starts)
    return totals


def _best(totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, its bits, its posterior) of every text."""
    best = totals[:, :-1].argmin(axis=1)
    least = totals[np.arange(len(best)), best]
    return best, least, 1 / np.exp2(np.clip(least[:, None] - totals, -1000, 1000)).sum(axis=1)


def _sure(shared, least: float):
    """The rows whose best language scores at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            score = _best(code_lengths(shared.value, batch))[2]
            yield batch.filter(pa.array(score >= least))

    return run


def _lettered() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, limit=2 << 20):
            best, least, score = _best(code_lengths(model, batch))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key"),
                    pa.array(model.languages).take(pa.array(best)),
                    pa.array(score),
                    pa.array(least),
                ],
                ["_key", "lang_pred", "score", "code_bits"],
            )

    return run


def predict(docs: DataFrame, model: Model | None, key: Column) -> DataFrame:
    """(_key, lang_pred, score, code_bits) for every row; ``key`` is carried through."""
    spark = docs.sparkSession
    rows = docs.select(
        F.struct(key.alias("key"), _lettered().alias("lettered")).alias("_key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    kind = rows.schema["_key"].dataType.simpleString()
    if model is None:
        return rows.select(
            F.col("_key.key").alias("_key"),
            F.lit("und").alias("lang_pred"),
            F.lit(0.0).alias("score"),
            F.lit(0.0).alias("code_bits"),
        )
    shared = spark.sparkContext.broadcast(model)
    scored = rows.mapInArrow(
        _predict(shared), f"_key {kind}, lang_pred string, score double, code_bits double"
    )
    return scored.select(
        F.col("_key.key").alias("_key"),
        F.when(F.col("_key.lettered"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("_key.lettered"), F.col("score")).otherwise(0.0).alias("score"),
        "code_bits",
    )


def held_out(doc_id: Column) -> Column:
    """Documents that training never reads: crc32 of the id as text leaves 2 modulo 4."""
    remainder = F.crc32(doc_id.cast("string").cast("binary")) % 4
    return F.coalesce(remainder == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
    ).select("doc_id", "text", "lang")


def languages_of(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    model = train(training_rows(docs))
    return predict(docs, model, F.col("doc_id")).select(
        F.col("_key").alias("doc_id"), held_out(F.col("_key")).alias("held_out"), "lang_pred", "score"
    )


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a language: ``und`` and scores below ``least`` go.

    Whole rows go through the tasks that score them, so nothing is joined.
    """
    model = train(training_rows(docs))
    if model is None:
        return docs.filter(F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.filter(_lettered()).mapInArrow(_sure(shared, least), docs.schema)
