"""Phrase collocation mining with weighted acyclic automata.

1. Tasks count all sequences of 1 to 4 words of slices of text as shard tries, cut each
   at the same boundaries, and send the parts to their prefix range.
2. Each range unites its parts, sums their counts and keeps what occurs often enough as
   one minimal count transducer.
3. Candidates are read from the transducers.  The parts they are cut into lie in other
   ranges: each distinct part is sent there once, and composing the range's transducer
   with the acceptor of the parts asked of it gives their counts.
4. Scores, containment and ranks are DataFrame work in exact decimals.

Boundaries come from sampled sequences; they only lay out the work and change no count.
One boundary is kept for ``RANGE_BYTES`` of text.

Defined cases.  A null text is empty; a null language is ``und``.  A text longer than a
slice is read in slices that overlap by the words a sequence can span, so nothing is lost
or counted twice.  Repeated rows count as often as they stand there; row ids are not
read, nor are other columns.  Languages without candidates give no rows; an empty table
gives an empty result.  Ties go to the larger count, then to the smaller phrase by bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from famloom.llm import count_automata
from famloom.llm.common import release_memory, text_bytes
from famloom.llm.count_automata import CountTransducer, Trie
from famloom.operators.skew import lookup
from famloom.session import discard, durable

#: Text bytes that one shard trie is built from, and that one prefix range stands for.
SLICE_BYTES = 8 << 20
RANGE_BYTES = 12 << 20
#: Sampled sequences a range, to lay the boundaries by.
SAMPLES = 60

#: Kinds of bytes: 1 parts words, 2 parts pieces.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, 0x09]] = 1
_KINDS[list(b".,;:!?\n\x0b\x0c\r")] = 2
_PARTING = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(lower-cased words, piece number of each, where each begins) of rows joined in ``data``.

    Words never span rows: a row's first word starts anew even without a separator.
    """
    kinds = _KINDS[data]
    apart = kinds > 0
    begins = ~apart
    begins[1:] &= apart[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = ~apart[inner]
    starts = np.flatnonzero(begins)
    ends = ~apart
    ends[:-1] &= apart[1:] | begins[1:]
    lengths = np.flatnonzero(ends) + 1 - starts
    piece = np.searchsorted(np.flatnonzero(kinds == 2), starts) + np.searchsorted(offsets, starts, side="right")
    return count_automata.word_column(lengths, _LOWER[data[~apart]]), piece, starts


def _chunks(data: bytes, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of about ``limit`` bytes that end at a separator."""
    start = 0
    while start < len(data):
        end = start + limit
        if end < len(data):
            parting = _PARTING.search(data, end)
            end = parting.start() if parting else len(data)
        yield start, min(end, len(data))
        start = end


def _tries(texts: list[pa.Array], depth: int, limit: int) -> Iterator[Trie]:
    """Shard tries of texts, each from about ``limit`` bytes."""
    column = pa.concat_arrays([t.cast(pa.large_binary()) for t in texts])
    data, offsets = text_bytes(column)
    first = 0
    while first < len(offsets) - 1:
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        part = data[offsets[first] : offsets[stop]]
        if stop > first + 1 or len(part) <= limit:
            words, piece, _ = words_of(part, offsets[first : stop + 1] - offsets[first])
            yield count_automata.build(words, piece, depth)
        else:  # one long text, in slices that share the words a sequence can span
            whole, back, skip = part.tobytes(), 0, 0
            for start, end in _chunks(whole, limit):
                begin = back if skip else start
                words, piece, places = words_of(part[begin:end], np.array([0, end - begin]))
                yield count_automata.build(words, piece, depth, skip)
                skip = min(depth - 1, len(places))
                back = begin + int(places[-skip]) if skip else end
        first = stop


def _by_language(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, list[pa.Array]]]:
    """Texts of one language at a time, gathered to about ``limit`` bytes over batches."""
    held: dict[str, list[pa.Array]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        langs, texts = batch.column(0).dictionary_encode(), batch.column(1)
        codes = langs.indices.to_numpy(zero_copy_only=False)
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            mine = texts.take(pa.array(np.flatnonzero(codes == code)))
            held.setdefault(lang, []).append(mine)
            sizes[lang] = sizes.get(lang, 0) + mine.nbytes
        while sum(sizes.values()) >= limit:
            most = max(sizes, key=sizes.get)
            del sizes[most]
            yield most, held.pop(most)
    yield from held.items()


def _sampler(depth: int, share: float, seed: int) -> Callable:
    """Some of the sequences of ``depth`` words, for laying boundaries."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(seed)
        for lang, texts in _by_language(batches, SLICE_BYTES):
            data, offsets = text_bytes(pa.concat_arrays([t.cast(pa.large_binary()) for t in texts]))
            words, piece, _ = words_of(data, offsets)
            count = len(piece) - depth + 1
            if count < 1:
                continue
            starts = np.flatnonzero(draw.random(count) < share)
            starts = starts[piece[starts] == piece[starts + depth - 1]]
            rows = [words.slice(s, depth).to_pylist() for s in starts.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(rows), pa.string()), pa.array(rows, pa.list_(pa.binary()))],
                names=["lang", "words"],
            )

    return sample


def _boundaries(docs: DataFrame, depth: int, size: int) -> list[tuple[str, tuple[bytes, ...]]]:
    """(language, sequence) that part the prefix ranges, in order."""
    held = docs.agg(
        F.count("*").alias("rows"),
        F.sum(F.octet_length("text")).alias("size"),
    ).first()
    ranges = -(-(held.size or 0) // size)
    if ranges <= 1:
        return []
    share_of_rows = min(1.0, max(0.02, 4000 / held.rows))
    share = min(1.0, SAMPLES * ranges / (share_of_rows * held.size / 6))
    picked = docs.sample(share_of_rows, seed=7).mapInArrow(
        _sampler(depth, share, 7), "lang string, words array<binary>"
    )
    keys = sorted({(r.lang, tuple(bytes(w) for w in r.words)) for r in picked.collect()})
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def _shards(boundaries: list, depth: int, limit: int) -> Callable:
    langs = [lang for lang, _ in boundaries]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_language(batches, limit):
            low, high = bisect_left(langs, lang), bisect_right(langs, lang)
            cuts = [sequence for _, sequence in boundaries[low:high]]
            for trie in _tries(texts, depth, limit):
                for number, part in count_automata.split(trie, cuts):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([low + number]),
                            pa.array([lang], pa.string()),
                            pa.array([count_automata.trie_to_bytes(part)], pa.binary()),
                        ],
                        names=["range", "lang", "trie"],
                    )
                trie = part = None
                release_memory()

    return shards


def _united(least: int) -> Callable:
    kinds = pa.schema(
        [("range", pa.int64()), ("lang", pa.string()), ("words", pa.int64()), ("transducer", pa.binary())]
    )

    def united(parts: pa.Table) -> pa.Table:
        place = parts.column("range")[0].as_py()
        langs = parts.column("lang").to_pylist()
        blobs = parts.column("trie")
        rows = []
        for lang in sorted(set(langs)):
            tries = [
                count_automata.trie_from_bytes(blobs[i].as_py()) for i, own in enumerate(langs) if own == lang
            ]
            words = sum(int(t.levels[0][2].sum()) for t in tries)
            often = count_automata.sequences(count_automata.union(tries, least))
            rows.append((place, lang, words, CountTransducer.of(often).to_bytes()))
        release_memory()
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds.types)], schema=kinds)

    return united


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, words, a) of each transducer's sequences of two words or more."""
    for batch in batches:
        for lang, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = [
                (b" ".join(s).decode(), len(s), count)
                for s, count in CountTransducer.from_bytes(blob.as_py()).items()
                if len(s) > 1
            ]
            names, sizes, counts = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(found), pa.string()),
                    pa.array(names, pa.string()),
                    pa.array(sizes, pa.int32()),
                    pa.array(counts, pa.int64()),
                ],
                names=["lang", "phrase", "size", "a"],
            )


def _routed(boundaries: list) -> Callable:
    """Add the prefix range of each (lang, part)."""

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [
                (lang, tuple(part.encode().split(b" ")))
                for lang, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            ]
            places = pa.array([bisect_right(boundaries, key) for key in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([places, *batch.columns], names=["range", "lang", "part"])

    return routed


def _composed(held: pa.Table, asked: pa.Table) -> pa.Table:
    """Counts of the parts asked of one range."""
    wanted: dict[str, list[tuple[bytes, ...]]] = {}
    for lang, part in zip(asked.column("lang").to_pylist(), asked.column("part").to_pylist()):
        wanted.setdefault(lang, []).append(tuple(part.encode().split(b" ")))
    langs, parts, counts = [], [], []
    for lang, blob in zip(held.column("lang").to_pylist(), held.column("transducer")):
        if lang not in wanted:
            continue
        acceptor = CountTransducer.of((s, 0) for s in sorted(wanted[lang]))
        for sequence, count in CountTransducer.from_bytes(blob.as_py()).compose(acceptor):
            langs.append(lang)
            parts.append(b" ".join(sequence).decode())
            counts.append(count)
    return pa.table(
        {
            "lang": pa.array(langs, pa.string()),
            "part": pa.array(parts, pa.string()),
            "f": pa.array(counts, pa.int64()),
        }
    )


def mine_phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = 30,
    longest: int = 4,
    contained: int = 80,
    top: int = 2000,
    slice_bytes: int = SLICE_BYTES,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    docs = docs.select(
        F.coalesce(F.col(lang), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    boundaries = _boundaries(docs, longest, range_bytes)
    shards = docs.mapInArrow(
        _shards(boundaries, longest, slice_bytes), "range bigint, lang string, trie binary"
    )
    held = durable(
        shards.groupBy("range").applyInArrow(
            _united(least), "range bigint, lang string, words bigint, transducer binary"
        )
    )
    totals = held.groupBy("lang").agg(F.sum("words").alias("n"))
    candidates = durable(
        held.select("lang", "transducer").mapInArrow(_phrases, "lang string, phrase string, size int, a bigint")
    )

    # Every way to cut a candidate, and the counts of both parts.
    words = F.split("phrase", " ", -1)
    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).select(
        "lang",
        "phrase",
        "size",
        "a",
        "k",
        F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    cuts = durable(cuts)
    asked = cuts.select("lang", F.explode(F.array("first", "rest")).alias("part")).distinct()
    routed = asked.mapInArrow(_routed(boundaries), "range bigint, lang string, part string")
    parts = durable(
        held.groupBy("range")
        .cogroup(routed.groupBy("range"))
        .applyInArrow(_composed, "lang string, part string, f bigint")
    )
    both = lookup(cuts, parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"], "inner")
    both = lookup(both, parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"], "inner")
    score = F.expr(
        "(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)))"
        " div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"
    )
    scored = both.groupBy("lang", "phrase", "size", "a").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    )

    # The most frequent longer candidate around each phrase.
    stretches = (
        candidates.filter("size > 2")
        .withColumn("span", F.explode(F.expr("sequence(2, size - 1)")))
        .withColumn("at", F.explode(F.expr("sequence(1, size - span + 1)")))
        .select(
            "lang",
            F.array_join(F.slice(words, F.col("at"), F.col("span")), " ").alias("phrase"),
            F.col("a").alias("longer"),
        )
    )
    around = stretches.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    large = "cast({} as decimal(19,0))"
    kept = lookup(scored, around, ["lang", "phrase"]).filter(
        f"longer is null or not 100 * {large.format('longer')} >= {contained} * {large.format('a')}"
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase"))
    first = (
        kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .filter(F.col("rank") <= top)
    )
    done = durable(
        lookup(first, totals, ["lang"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
    discard(candidates, cuts, parts, held)
    return done


#: The query in SQL, for small tables.
ORACLE = r"""
    WITH pieces AS (
        SELECT row_number() OVER () AS piece, lang, part FROM (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz'),
                       '[.,;:!?\x0A-\x0D]')) AS part
            FROM documents)),
    lists AS (
        SELECT lang, list_filter(regexp_split_to_array(part, '[\x20\x09]+'), lambda w: w <> '') AS words
        FROM pieces),
    grams AS (
        SELECT lang, size, array_to_string(words[pos : pos + size - 1], ' ') AS phrase
        FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS pos
              FROM lists, range(1, 5) AS sizes(size) WHERE len(words) >= size)),
    counted AS (
        SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
    totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM lists GROUP BY lang),
    candidates AS (
        SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words
        FROM counted WHERE size > 1),
    cuts AS (
        SELECT lang, size, phrase, a, k, array_to_string(words[1 : k], ' ') AS head,
               array_to_string(words[k + 1 : size], ' ') AS tail
        FROM candidates, range(1, 4) AS ks(k) WHERE k < size),
    scored AS (
        SELECT c.lang, c.phrase, c.a, one.f AS l, two.f AS r,
               CAST((2000000::HUGEINT * c.a) // (one.f::HUGEINT + two.f) AS BIGINT) AS score
        FROM cuts c
        JOIN counted one ON one.lang = c.lang AND one.phrase = c.head
        JOIN counted two ON two.lang = c.lang AND two.phrase = c.tail
        QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
    around AS (
        SELECT lang, array_to_string(words[pos : pos + span - 1], ' ') AS phrase, max(a) AS longer
        FROM (SELECT lang, a, words, span, unnest(range(1, size - span + 2)) AS pos
              FROM candidates, range(2, 4) AS spans(span) WHERE span < size)
        GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
           phrase, a, l, r, n, score
    FROM scored LEFT JOIN around USING (lang, phrase) JOIN totals USING (lang)
    WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
    QUALIFY rank <= 2000"""
