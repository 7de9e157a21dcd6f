"""Hard-negative mining: threshold joins over an inverted index with norm bounds.

Queries (anchors) meet rows in a grid of blocks, so no task holds more than one block of
each.  Inside a cell the rows' dimensions stand in order of falling energy, in chunks.
A row's suffix whose norm is below the cell's least threshold (over the anchor's norm)
is left out of the index: it could not reach any threshold by itself.  Partial scores
are added up chunk by chunk; after each chunk a pair goes when its partial score plus
the product of both remaining norms stays under the anchor's threshold.  What is left
gets its omitted dimensions, so every score given out is an exact integer.

Positives: an anchor's threshold is its k-th best score in a first block, then all
blocks are searched.  Negatives: thresholds start near the positive's score and are
lowered (``SHARES``) until each window holds its k rows or stands at its floor.

Defined cases.  Rows with a null id, label or vector, or a null or non-finite component,
take no part.  Rows of one id count once: the least by (label, vector).  Missing
trailing components count as 0 and an empty vector scores 0.  Ties go to the smaller id.
Anchors without positives, and positives whose window is empty (always so below a score
of 0), give no rows.  Empty tables give an empty result.  Other columns are not read.
Scores must stay below 2**56 in size; beyond that the job fails and says so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from famloom.llm.common import shuffle_partitions
from famloom.session import discard, durable

#: Rows and anchors of a block; a cell of the grid holds one block of each.
ROW_BLOCK = 4096
ANCHOR_BLOCK = 4096
#: Anchors of a cell that are scored at a time, and dimensions added at a time.
ANCHOR_SLICE = 256
CHUNK = 8
#: Percent of the positive's score at which each round looks; the last is the floor.
SHARES = (97, 90)
#: Rounds of a cell go over to single pairs when this share of them is still open.
SPARSE = 0.1

_FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint, found_id bigint, score bigint"


def quantized(
    embeddings: DataFrame,
    scale: int = 256,
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
) -> DataFrame:
    """(vec_id, label, vector of integers floor(scale * x)) of the rows that take part."""
    label = F.col(label) if isinstance(label, str) else label
    plain = embeddings.select(
        F.col(key).cast("bigint").alias("vec_id"),
        label.cast("bigint").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    whole = F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    taken = plain.filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & whole
    )
    numbers = F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x))
    kept = F.min(F.struct("label", numbers.alias("vector"))).alias("row")
    return taken.groupBy("vec_id").agg(kept).select("vec_id", "row.label", "row.vector")


def _matrix(column: pa.ChunkedArray, order: np.ndarray) -> np.ndarray:
    """Vectors as rows, dimensions in ``order``, missing ones 0; whole numbers as doubles or longs."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], column.type)
    ends = np.asarray(lists.offsets, dtype=np.int64)
    values = np.asarray(lists.values, dtype=np.int64)[ends[0] : ends[-1]] if len(ends) else np.zeros(0, np.int64)
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), len(order)), np.int64)
    at = np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = values
    return out[:, order]


def _exact(anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where no sum can pass 2**53, else as longs."""
    most = [float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (anchors, rows)]
    bound = most[0] * most[1] * max(1, rows.shape[1])
    if bound >= 2.0**56:
        raise ValueError("hard negatives: scores of 2**56 or more are not supported")
    kind = np.float64 if bound < 2.0**53 else np.int64
    return anchors.astype(kind), rows.astype(kind)


def _suffix_norms(vectors: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Norm of each vector from each cut on, one column a cut and a last column of 0."""
    squares = np.add.reduceat(vectors.astype(np.float64) ** 2, cuts, axis=1) if len(cuts) else vectors[:, :0]
    tails = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.hstack([tails, np.zeros((len(vectors), 1))])) * (1 + 1e-9)


def reaching(
    anchors: np.ndarray, rows: np.ndarray, least: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs whose score reaches the anchor's threshold ``least``."""
    anchors, rows = _exact(anchors, rows)
    cuts = np.arange(0, rows.shape[1], CHUNK)
    chunks = len(cuts)
    anchor_tails, row_tails = _suffix_norms(anchors, cuts), _suffix_norms(rows, cuts)
    # Suffixes below the least cosine-like threshold of all anchors stay out of the index.
    with np.errstate(divide="ignore", invalid="ignore"):
        lowest = np.where(least > 0, least / np.maximum(anchor_tails[:, 0], 1e-300), -np.inf)
    omitted_below = lowest.min(initial=np.inf)
    indexed = (row_tails[:, :chunks] >= omitted_below).sum(axis=1)  # chunks; norms only fall
    order = np.argsort(-indexed, kind="stable")
    indexed = indexed[order]
    if omitted_below > 0:  # rows without a posting reach no threshold
        order, indexed = order[indexed > 0], indexed[indexed > 0]
    rows, row_tails = rows[order], row_tails[order]
    postings = [int((indexed > c).sum()) for c in range(chunks)]  # a dimension's list is a prefix
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(anchors), ANCHOR_SLICE):
        part = slice(start, start + ANCHOR_SLICE)
        query, tails, floor = anchors[part], anchor_tails[part], least[part, None] - 1e-3
        sums = np.zeros((len(query), len(rows)), rows.dtype)
        chunk = 0
        i = j = None
        while chunk < chunks and i is None:
            span, n = slice(cuts[chunk], cuts[chunk] + CHUNK), postings[chunk]
            sums[:, :n] += query[:, span] @ rows[:n, span].T
            chunk += 1
            rest = np.minimum(indexed, chunk)
            bound = sums + tails[:, rest] * row_tails[np.arange(len(rows)), rest]
            alive = bound >= floor
            if chunk == chunks or np.count_nonzero(alive) <= SPARSE * alive.size:
                i, j = np.nonzero(alive)
        if i is None:  # no dimensions at all
            i, j = np.nonzero(sums >= floor)
        score = sums[i, j]
        while chunk < chunks and len(i):
            span = slice(cuts[chunk], cuts[chunk] + CHUNK)
            more = indexed[j] > chunk
            score[more] += np.einsum("ij,ij->i", query[i[more], span], rows[j[more], span])
            chunk += 1
            rest = np.minimum(indexed[j], chunk)
            keep = score + tails[i, rest] * row_tails[j, rest] >= floor[i, 0]
            i, j, score = i[keep], j[keep], score[keep]
        for c in range(chunks):  # dimensions that the index left out
            more = np.flatnonzero(indexed[j] <= c)
            if len(more):
                span = slice(cuts[c], cuts[c] + CHUNK)
                score[more] += np.einsum("ij,ij->i", query[i[more], span], rows[j[more], span])
        score = score.astype(np.int64)
        keep = score >= least[part][i]
        found.append((i[keep] + start, order[j[keep]], score[keep]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` entries of each group by falling score, then id."""
    order = np.lexsort((ids, -score, group))
    group = group[order]
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else group
    rank = np.arange(len(group)) - np.repeat(heads, np.diff(np.r_[heads, len(group)]))
    return order[rank < count]


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _positives(order: np.ndarray, count: int):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids, labels = _numbers(rows, "vec_id"), _numbers(rows, "label")
        names, kinds, least = (_numbers(anchors, c) for c in ("anchor_id", "label", "least"))
        a, r = _matrix(anchors.column("vector"), order), _matrix(rows.column("vector"), order)
        out: list[tuple[np.ndarray, ...]] = []
        for kind in np.intersect1d(kinds, labels):
            mine, theirs = np.flatnonzero(kinds == kind), np.flatnonzero(labels == kind)
            i, j, score = reaching(a[mine], r[theirs], least[mine])
            i, j = mine[i], theirs[j]
            other = names[i] != ids[j]
            i, j, score = i[other], j[other], score[other]
            best = _first(i, score, ids[j], count)
            out.append((names[i[best]], ids[j[best]], score[best]))
        who, what, score = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"anchor_id": who, "positive_id": what, "positive_score": score})

    return cell


def _negatives(order: np.ndarray, count: int):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids, labels = _numbers(rows, "vec_id"), _numbers(rows, "label")
        names, kinds = _numbers(anchors, "anchor_id"), _numbers(anchors, "label")
        windows = anchors.column("windows").to_pylist()
        owner = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        flat = [w for ws in windows for w in ws]
        positive, high, low = (
            np.array([w[k] for w in flat], np.int64) for k in ("positive_id", "positive_score", "low")
        )
        least = np.full(len(windows), np.iinfo(np.int64).max)
        np.minimum.at(least, owner, low)
        a, r = _matrix(anchors.column("vector"), order), _matrix(rows.column("vector"), order)
        i, j, score = reaching(a, r, least)
        other = kinds[i] != labels[j]
        i, j, score = i[other], j[other], score[other]
        # Pairs by anchor, so that a window's candidates are one stretch.
        by = np.argsort(i, kind="stable")
        i, j, score = i[by], j[by], score[by]
        ends = np.searchsorted(i, np.arange(len(windows) + 1))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for w, own in enumerate(owner):
            at = np.arange(ends[own], ends[own + 1])
            at = at[(score[at] >= low[w]) & (score[at] <= high[w])]
            best = at[_first(np.zeros(len(at), np.int64), score[at], ids[j[at]], count)]
            out.append((np.full(len(best), w), best))
        w, at = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 2
        return pa.table(
            {
                "anchor_id": names[owner[w]],
                "positive_id": positive[w],
                "positive_score": high[w],
                "found_id": ids[j[at]],
                "score": score[at],
            }
        )

    return cell


def _energy(rows: DataFrame) -> np.ndarray:
    """Dimensions by falling sum of squares; as many numbers as a vector has reach the driver."""

    def partial(batches):
        sums = np.zeros(0)
        for batch in batches:
            lists = batch.column(0)
            ends = np.asarray(lists.offsets, dtype=np.int64)
            values = np.asarray(lists.values, dtype=np.float64)[ends[0] : ends[-1]]
            at = np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], np.diff(ends))
            got = np.bincount(at, weights=values**2)
            if len(got) > len(sums):
                got, sums = sums, got.astype(np.float64)
            sums[: len(got)] += got
        if len(sums):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(sums))), pa.array(sums)], names=["place", "energy"]
            )

    sums = rows.select("vector").mapInArrow(partial, "place bigint, energy double")
    by_place = sums.groupBy("place").agg(F.sum("energy").alias("energy")).collect()
    energy = np.zeros(len(by_place))
    for row in by_place:
        energy[row.place] = row.energy
    return np.argsort(-energy, kind="stable")


def _spread(rows: DataFrame, block: str, size: int, key: str) -> tuple[DataFrame, int]:
    """Number blocks of about ``size`` rows by the hash of ``key``; small tables use all tasks."""
    count = rows.count()
    blocks = max(-(-count // size), min(count // 256, shuffle_partitions(rows.sparkSession)), 1)
    return rows.withColumn(block, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")), blocks


def _every(df: DataFrame, name: str, count: int) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def _grid(anchors: DataFrame, rows: DataFrame, sides: tuple[int, int], cell, schema: str) -> DataFrame:
    """Run ``cell`` on each pair of an anchor block and a row block."""
    keys = ["anchor_block", "row_block"]
    left = _every(anchors, "row_block", sides[1]).groupBy(*keys)
    right = _every(rows, "anchor_block", sides[0]).groupBy(*keys)
    types = pa.schema([(f.split()[0], pa.int64()) for f in schema.split(", ")])

    def both(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return types.empty_table()
        return cell(one, two).cast(types)

    return left.cogroup(right).applyInArrow(both, schema)


def _best(found: DataFrame, keys: list[str], score: str, name: str, count: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.col(name))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    floor: int = 80,
    row_block: int = ROW_BLOCK,
    anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """Negatives in [floor % of the positive's score, that score] of each anchor and positive.

    ``vectors`` is what :func:`quantized` gives; ``anchors`` says which rows are anchors.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    vectors = durable(vectors)
    order = _energy(vectors)
    rows, row_blocks = _spread(vectors, "row_block", row_block, "vec_id")
    chosen = vectors.filter(anchors).withColumnRenamed("vec_id", "anchor_id")
    heads, anchor_blocks = _spread(chosen, "anchor_block", anchor_block, "anchor_id")
    heads = durable(heads)
    sides = (anchor_blocks, row_blocks)

    # The k-th best score in one block bounds the k-th best of all from below.
    nothing = F.lit(-(2**60))
    shape = "anchor_id bigint, positive_id bigint, positive_score bigint"
    seed = _grid(
        heads.withColumn("least", nothing),
        rows.filter("row_block = 0"),
        (anchor_blocks, 1),
        _positives(order, positives),
        shape,
    )
    known = seed.groupBy("anchor_id").agg(
        F.when(F.count("*") == positives, F.min("positive_score")).alias("least")
    )
    bounded = durable(heads.join(known, "anchor_id", "left").fillna(-(2**60), ["least"]))
    near = _grid(bounded, rows, sides, _positives(order, positives), shape)
    pairs = durable(_best(near, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"))

    open_windows = pairs.filter("positive_score >= 0")
    results: list[DataFrame] = []
    for share in [*[s for s in SHARES if s > floor], floor]:
        low = F.expr(f"({share} * positive_score + 99) div 100")
        windows = open_windows.groupBy("anchor_id").agg(
            F.collect_list(F.struct("positive_id", "positive_score", low.alias("low"))).alias("windows")
        )
        asked = heads.join(durable(windows), "anchor_id")
        found = durable(
            _best(
                _grid(asked, rows, sides, _negatives(order, negatives), _FOUND),
                ["anchor_id", "positive_id"], "score", "found_id", negatives,
            )
        )
        if share == floor:
            results.append(found)
            break
        keys = ["anchor_id", "positive_id"]
        full = durable(found.groupBy(*keys).count().filter(F.col("count") == negatives).select(*keys))
        results.append(found.join(full, keys, "left_semi"))
        open_windows = durable(open_windows.join(full, keys, "left_anti"))
        if open_windows.isEmpty():
            break
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    done = durable(
        out.select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            F.col("found_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
    discard(vectors, heads, bounded, pairs)
    return done


#: The query in SQL: brute force over all pairs of an anchor and a row.
ORACLE = """
    WITH parts AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
    good AS (
        SELECT vec_id FROM parts GROUP BY vec_id
        HAVING bool_and(x IS NOT NULL AND isfinite(x))),
    cells AS (
        SELECT vec_id, label, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS q
        FROM parts JOIN good USING (vec_id)),
    scored AS (
        SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS vec_id, b.label AS label,
               CAST(sum(a.q * b.q) AS BIGINT) AS score
        FROM cells a JOIN cells b ON a.i = b.i
        WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        GROUP BY ALL),
    positive AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored
        WHERE label = anchor_label
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id,
           CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
                AS INTEGER) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positive JOIN scored USING (anchor_id)
    WHERE label <> anchor_label AND 80 * positive_score <= 100 * score AND score <= positive_score
    QUALIFY rank <= 5"""
