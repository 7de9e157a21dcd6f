"""Near-duplicate documents by HyperMinHash registers, bands, and exact confirmation.

A document's set holds the distinct five-word shingles of its text (A-Z lower-cased, words
apart at ASCII white space); shorter texts have one shingle.  Each shingle falls in one of
``REGISTERS`` buckets by its hash, and a bucket keeps its minimum as a leading-zero count
with ten mantissa bits.  Empty buckets borrow from others in an order drawn per bucket, so
small sets agree register by register as often as large ones.  Five registers make a band.

1. Documents with equal sets collapse to the smallest id; only sets go on.
2. Sets that share a band are compared with the smallest id of that band, if the estimate
   from the registers, corrected for chance collisions, leaves a similarity of 0.75
   within five standard deviations, and if sizes allow it; links are confirmed on full
   sets.
3. Bands that now hold more than one component are unresolved: every member outside the
   band's largest component is estimated against all members, in cells of a visitor block
   and a member block; a pair is looked at in the first band that it shares.  Where the
   estimate leaves a component possible, the member's full set is compared with those of
   the whole component, again in cells, and only links come out; they extend the
   components of step 2.  Pairs inside one component need no look, whatever their number.

So no link is lost between sets that share a band, and a pair at 0.75 misses all 51 bands
with a chance of 1e-6.

Null and empty texts have no shingle and link with nothing.  Rows with a null id get the
component of an equal set that has an id, else null, and link nothing themselves.
Repeated rows are copies of each other; ids are taken to name one text.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from famloom.llm.common import binary_rows, id_and_text, release_memory, slices, text_bytes
from famloom.operators.graph import connected_components, extend_components
from famloom.session import discard, durable

WORDS = 5
REGISTERS = 256
ROWS = 5
BANDS = REGISTERS // ROWS
MANTISSA = 10
#: Members, and outsiders, of a band that are compared in one cell.
BLOCK = 2048
#: Members of a component, and visitors, whose full sets are compared in one cell.
SET_BLOCK = 256

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS: dict[str, np.ndarray] = {}


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's last step)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


#: Unrelated odd factors, so that no order of the same words gives the same sum.
_WEIGHTS = mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, kept for the largest n so far."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, row of every word) for rows of bytes.

    Words end at row ends and at the bytes that ``apart`` marks; A-Z count as a-z.
    """
    space = np.ones(len(data) + 1, bool)
    space[:-1] = apart[data]
    starts = ~space[:-1]
    starts[1:] &= space[:-2]
    inner = offsets[1:-1][offsets[1:-1] < len(data)]
    starts[inner] = ~space[inner]
    begin = np.flatnonzero(starts)
    ends = space[1:].copy()
    ends[inner[inner > 0] - 1] = True
    end = np.flatnonzero(ends & ~space[:-1]) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mixed((sums[end] - sums[begin]) * down[begin])
    return hashes, np.searchsorted(offsets, begin, side="right") - 1


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts joined, count per text)."""
    data, offsets = text_bytes(texts)
    words, row = word_hashes(data, offsets)
    rows = len(offsets) - 1
    per_row = np.bincount(row, minlength=rows)
    first = np.cumsum(per_row) - per_row
    short = (per_row > 0) & (per_row < WORDS)
    n = np.where(short, 1, np.maximum(per_row - WORDS + 1, 0))
    values = np.zeros(int(n.sum()), np.uint64)
    at = np.cumsum(n) - n
    full = np.repeat(~short, n)
    place = np.arange(len(values)) - np.repeat(at - first, n)
    whole = place[full]
    total = np.zeros(len(whole), np.uint64)
    for i in range(WORDS):
        total += words[whole + i] * _WEIGHTS[i]
    values[full] = mixed(total)
    few = np.flatnonzero(short)
    total = per_row[few].astype(np.uint64)
    for i in range(WORDS - 1):
        has = per_row[few] > i
        total[has] += words[first[few[has]] + i] * _WEIGHTS[i]
    values[at[few]] = mixed(total)
    fresh = np.ones(len(values), bool)
    for a, k in zip(at.tolist(), n.tolist()):
        if k > 1:
            part = values[a : a + k]
            part.sort()
            np.not_equal(part[1:], part[:-1], out=fresh[a + 1 : a + k])
    owner = np.repeat(np.arange(rows), n)
    return values[fresh], np.bincount(owner[fresh], minlength=rows)


def _probe_orders() -> np.ndarray:
    draw = np.random.default_rng(20)
    return np.stack([draw.permutation(REGISTERS) for _ in range(REGISTERS)])


_ORDERS = _probe_orders()


def registers(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (rows of uint16) of sorted sets; all zero for an empty set."""
    rows = len(counts)
    owner = np.repeat(np.arange(rows), counts)
    cell = owner * REGISTERS + (values >> np.uint64(56)).astype(np.int64)
    least = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
    low = (values[least] & np.uint64((1 << 56) - 1)).astype(np.float64) + 0.5
    fraction, exponent = np.frexp(low)
    code = (56 - exponent) * (1 << MANTISSA) + ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    plain = np.full(rows * REGISTERS, -1, np.int64)
    plain[cell[least]] = code
    plain = plain.reshape(rows, REGISTERS)
    out = plain.copy()
    row, bucket = np.nonzero((out < 0) & (counts > 0)[:, None])
    for probe in range(REGISTERS):
        if not len(row):
            break
        found = plain[row, _ORDERS[bucket, probe]]
        out[row, bucket] = found
        row, bucket = row[found < 0], bucket[found < 0]
    return np.maximum(out, 0).astype(np.uint16)


def band_keys(codes: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, rows by documents."""
    parts = codes[:, : BANDS * ROWS].reshape(len(codes), BANDS, ROWS).astype(np.uint64)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(ROWS):
        total = mixed(total + (parts[:, :, i] + np.uint64(1)) * _WEIGHTS[i])
    return total


def _levels(n: np.ndarray) -> np.ndarray:
    """Chance of each leading-zero count in a bucket of sets of these sizes."""
    load = np.maximum(np.asarray(n, float), REGISTERS)[..., None] / REGISTERS
    above = np.exp(-load * np.exp2(-np.arange(0, 40.0)))  # no value below this level
    return np.diff(1 - above, append=0.0) * -1


def _corrected(a: np.ndarray, b: np.ndarray, levels_a: np.ndarray, levels_b: np.ndarray) -> np.ndarray:
    """Share of equal registers, corrected for registers of different sets that agree by chance.

    Two unrelated buckets agree when their leading-zero counts do and then with chance
    2**-``MANTISSA`` for the mantissa.
    """
    chance = (levels_a * levels_b).sum(axis=-1) / (1 << MANTISSA)
    return ((a == b).mean(axis=-1) - chance) / (1 - chance)


def estimated_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of pairs of register rows."""
    return _corrected(a, b, _levels(n_a), _levels(n_b))


def _margin(large: np.ndarray, least: float) -> np.ndarray:
    return 5 * np.sqrt(least * (1 - least) / np.maximum(np.minimum(large, REGISTERS), 1))


def may_be_similar(a, b, n_a, n_b, least: float) -> np.ndarray:
    """False only where sizes rule the pair out, or the estimate by five deviations."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return (small >= least * large) & (estimated_jaccard(a, b, n_a, n_b) >= least - _margin(large, least))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=2 << 20):
        values, counts = shingles(batch.column("text"))
        ends = np.cumsum(counts)
        sums = [np.concatenate([[0], np.cumsum(v, dtype=np.uint64)]).astype(np.uint64) for v in (values, mixed(values))]
        digest = [(s[ends] - s[ends - counts]).astype(np.int64) for s in sums]
        codes = registers(values, counts)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(counts, pa.int64()),
                pa.array(digest[0]),
                pa.array(digest[1]),
                binary_rows(codes.view(np.uint8).ravel(), np.arange(1, len(codes) + 1) * 2 * REGISTERS),
            ],
            ["doc_id", "n", "set_a", "set_b", "codes"],
        )


def _codes(column: pa.Array) -> np.ndarray:
    data, _ = text_bytes(column)
    return data.view(np.uint16).reshape(len(column), REGISTERS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = band_keys(_codes(batch.column("codes")))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id").take(pa.array(np.repeat(np.arange(len(keys)), BANDS))),
                pa.array(keys.ravel().view(np.int64)),
            ],
            ["id", "band"],
        )


def _estimated(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = may_be_similar(
                _codes(batch.column("codes_a")),
                _codes(batch.column("codes_b")),
                batch.column("n_a").to_numpy(),
                batch.column("n_b").to_numpy(),
                least,
            )
            yield batch.select(["a", "b"]).filter(pa.array(fits))

    return run


def _confirmed(least_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a", 1 << 20):
            a, n_a = shingles(batch.column("text_a"))
            b, n_b = shingles(batch.column("text_b"))
            end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
            linked = np.zeros(len(n_a), bool)
            for i in range(len(n_a)):
                one, two = a[end_a[i] - n_a[i] : end_a[i]], b[end_b[i] - n_b[i] : end_b[i]]
                at = np.searchsorted(one, two)
                shared = int(np.count_nonzero(one[np.minimum(at, len(one) - 1)] == two)) if len(one) else 0
                linked[i] = shared and 100 * shared >= least_percent * (len(one) + len(two) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, least_percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar; whole texts are fetched for both sides."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_confirmed(least_percent), "a bigint, b bigint")


def _by_group(keys: list[str], work):
    """Run ``work`` on all rows of each group; rows come sorted by the two keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (batch.column(k).to_numpy() for k in keys)
            edges = np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
            for start, stop in zip([0, *edges], [*edges, batch.num_rows]):
                key = (one[start], two[start])
                if held and key != last:
                    yield work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
                held.append(batch.slice(start, stop - start))
                last = key
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _id_pairs(pairs: list[tuple[int, np.ndarray]], names: list[str]) -> pa.RecordBatch:
    sizes = [len(many) for _, many in pairs]
    one = np.repeat(np.array([i for i, _ in pairs], np.int64), sizes)
    two = np.concatenate([many for _, many in pairs]) if pairs else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names)


def _outsiders(least: float):
    """(visitor, component): components of a band that hold a member the visitor may be similar to.

    A pair that shares an earlier band is left to that one: both stand there too, one of
    them as a visitor.
    """

    def compare(table: pa.RecordBatch) -> pa.RecordBatch:
        codes, n = _codes(table.column("codes")), table.column("n").to_numpy()
        ids, component = table.column("id").to_numpy(), table.column("component").to_numpy()
        visitor = table.column("visitor").to_numpy(zero_copy_only=False)
        keys = band_keys(codes).view(np.int64)
        at = int(np.flatnonzero(keys[0] == table.column("band")[0].as_py())[0])
        earlier, levels = keys[:, :at], _levels(n)
        members, found = np.flatnonzero(~visitor), []
        for g in np.flatnonzero(visitor).tolist():
            large = np.maximum(n[members], n[g])
            fits = (component[members] != component[g]) & (np.minimum(n[members], n[g]) >= least * large)
            other, large = members[fits], large[fits]
            if at:
                first = ~(earlier[other] == earlier[g]).any(axis=1)
                other, large = other[first], large[first]
            likely = _corrected(codes[g], codes[other], levels[g], levels[other]) >= least - _margin(large, least)
            found.append((ids[g], np.unique(component[other[likely]])))
        return _id_pairs(found, ["id", "target"])

    return _by_group(["band", "cell"], compare)


def _sets_of(table: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a cell's texts, some megabytes of text at a time."""
    parts = [shingles(part.column("text")) for part in slices(iter([table]), limit=1 << 20)]
    release_memory()
    return np.concatenate([v for v, _ in parts]), np.concatenate([n for _, n in parts])


def _linked_visitors(least_percent: int):
    """(a, b): visitors and members of a component's cell whose full sets are similar."""

    def compare(table: pa.RecordBatch) -> pa.RecordBatch:
        values, n = _sets_of(table)
        ends = np.cumsum(n)
        ids = table.column("id").to_numpy()
        visitor = table.column("visitor").to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(n)), n)
        inside = ~visitor[owner]
        order = np.argsort(values[inside], kind="stable")
        pool, holder = values[inside][order], owner[inside][order]
        found = []
        for g in np.flatnonzero(visitor).tolist():
            own = values[ends[g] - n[g] : ends[g]]
            low, high = np.searchsorted(pool, own, "left"), np.searchsorted(pool, own, "right")
            width = high - low
            spots = np.arange(width.sum()) + np.repeat(low - np.cumsum(width) + width, width)
            shared = np.bincount(holder[spots], minlength=len(n))
            linked = (shared > 0) & (100 * shared >= least_percent * (n[g] + n - shared))
            found.append((ids[g], ids[linked]))
        return _id_pairs(found, ["a", "b"])

    return _by_group(["target", "cell"], compare)


def _both_ways(edges: DataFrame) -> DataFrame:
    one = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _cells(members: DataFrame, visitors: DataFrame, key: str, size: int) -> DataFrame:
    """Each member block of a key meets each visitor block in a numbered cell.

    Both tables have the key's ``_members`` and ``_visitors`` counts; a cell holds about
    ``size`` rows of each side at most.
    """
    rows, columns = (F.ceil(F.col(c) / F.lit(size)).cast("int") for c in ("_members", "_visitors"))
    own = F.xxhash64("id")

    def placed(df: DataFrame, row, column, visitor: bool) -> DataFrame:
        cells = F.transform(F.sequence(F.lit(0), (columns if row is not None else rows) - 1), lambda i: (
            (row if row is not None else i) * columns + (column if column is not None else i)
        ).cast("bigint"))
        rest = [c for c in ("component",) if c in df.columns]
        return df.select(key, F.explode(cells).alias("cell"), "id", *rest, F.lit(visitor).alias("visitor"))

    return placed(members, F.pmod(own, rows), None, False).unionByName(
        placed(visitors, None, F.pmod(own, columns), True), allowMissingColumns=True
    )


def near_duplicates(docs: DataFrame, least_percent: int = 75) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    least = least_percent / 100
    texts = id_and_text(docs)
    sketched = durable(
        texts.mapInArrow(_sketch, "doc_id bigint, n bigint, set_a bigint, set_b bigint, codes binary")
    )
    same = ["n", "set_a", "set_b"]
    # Registers follow from the set, so those of any of its rows will do.
    sets = durable(
        sketched.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
        .groupBy(*same)
        .agg(F.min("doc_id").alias("id"), F.first("codes").alias("codes"))
    )
    bands = durable(sets.select("id", "codes").mapInArrow(_bands, "id bigint, band bigint"))
    # Stored, so that the join has two plain shuffles, which adaptive execution can split.
    heads = durable(
        bands.groupBy("band")
        .agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("size"))
        .filter("size > 1")
    )
    shared = durable(bands.join(heads, "band"))
    discard(bands, heads)

    def sketches(side: str) -> DataFrame:
        return sets.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("codes").alias(f"codes_{side}"))

    candidates = shared.filter("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    likely = (
        candidates.join(sketches("a"), "a").join(sketches("b"), "b").mapInArrow(_estimated(least), "a bigint, b bigint")
    )
    links = durable(confirmed(likely, texts, least_percent))
    parts = durable(connected_components(_both_ways(links)))

    named = shared.select("band", "id", "size").join(
        parts.select(F.col("node").alias("id"), "component"), "id", "left"
    )
    named = named.withColumn("component", F.coalesce("component", "id"))
    open_bands = named.groupBy("band").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high")
    ).filter("_low <> _high").select("band")
    unresolved = durable(named.join(open_bands, "band"))
    shares = unresolved.groupBy("band", "component").agg(F.count(F.lit(1)).alias("_n"))
    largest = shares.groupBy("band").agg(
        F.max_by("component", F.struct("_n", "component")).alias("_main")
    )
    member = unresolved.join(largest, "band")
    outside = F.col("component") != F.col("_main")
    counts = durable(member.groupBy("band").agg(F.count_if(outside).alias("_visitors"), F.count("*").alias("_members")))
    targets = durable(
        _cells(member.join(counts, "band"), member.filter(outside).join(counts, "band"), "band", BLOCK)
        .join(sets.select("id", "n", "codes"), "id")
        .repartition("band", "cell")
        .sortWithinPartitions("band", "cell")
        .mapInArrow(_outsiders(least), "id bigint, target bigint")
        .distinct()
    )
    asked = durable(targets.groupBy("target").agg(F.count("*").alias("_visitors")))
    homes = (
        sets.select("id")
        .join(parts.select(F.col("node").alias("id"), "component"), "id", "left")
        .select("id", F.coalesce("component", "id").alias("target"))
        .join(asked.select("target"), "target")
    )
    sizes = durable(homes.groupBy("target").agg(F.count("*").alias("_members")).join(asked, "target"))
    more = durable(
        _cells(homes.join(sizes, "target"), targets.join(sizes, "target"), "target", SET_BLOCK)
        .join(texts.withColumnRenamed("doc_id", "id"), "id")
        .repartition("target", "cell")
        .sortWithinPartitions("target", "cell")
        .mapInArrow(_linked_visitors(least_percent), "a bigint, b bigint")
    )
    if not more.isEmpty():
        parts = durable(extend_components(parts, _both_ways(more)))
    discard(shared, unresolved, counts, targets, asked, sizes, more)
    group = sets.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").select(
        *same, F.coalesce("component", "id").alias("component_id")
    )
    found = sketched.select("doc_id", *same)
    full = found.filter("n > 0").join(group, same, "left")
    lone = found.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    return full.unionByName(lone).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, least_percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component."""
    stays = near_duplicates(docs, least_percent).filter("kept").select(F.col("doc_id").alias("_stays")).distinct()
    return docs.join(stays, docs.doc_id.eqNullSafe(stays["_stays"]), "left_semi")
