"""Token ids in Huffman-coded files: write whole documents, read them back.

A file set is a folder with ``blocks`` (Parquet, one file per range of doc_id, rows in
ascending doc_id; ``bucket`` numbers the files, ``block`` the rows of a file) and ``code`` (Parquet: id, count, bits).  A block holds whole
documents up to about ``BLOCK_IDS`` ids, so it decodes by itself: doc_ids, counts, the
coded bits, and the bit offset of every 1024th id.  Codes are canonical, so their
lengths are the whole table.

Null text is empty; an empty document holds only the end id.  A null doc_id sorts
first; repeated doc_ids follow each other in the order of their ids' bytes.  An empty
table gives a file set without blocks.  Further columns of the input are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from famloom.llm import huffman
from famloom.llm.common import binary_rows, id_and_text, slices
from famloom.llm.tokens import WORD_SLICE, encoder, with_end
from famloom.session import discard, durable, ensure_checkpoint_dir

BLOCK_IDS = 1 << 16
#: Ids per file; a file is also what one task writes.
FILE_IDS = 16 << 20

_DRAFT = "doc_id bigint, n_tokens bigint, ids binary, counts binary"
_BLOCKS = "doc_ids array<bigint>, counts array<bigint>, bits binary, offsets binary"
_READ = "doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint"


def _tokenize(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        packer = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, limit=WORD_SLICE):
            ids, counts = with_end(*encoder(path).encode(batch.column("text")), end)
            now = np.bincount(ids)
            if len(now) > len(seen):
                now, seen = seen, now
            seen[: len(now)] += now
            ends = np.cumsum(counts)
            packed = [
                packer.compress(ids[e - n : e].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
                for e, n in zip(ends, counts)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(packed, pa.binary()),
                    pa.nulls(len(counts), pa.binary()),
                ],
                ["doc_id", "n_tokens", "ids", "counts"],
            )
        if len(seen):
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([None], pa.int64()),
                    "n_tokens": pa.array([None], pa.int64()),
                    "ids": pa.array([None], pa.binary()),
                    "counts": pa.array([zlib.compress(seen.astype("<i8").tobytes(), 1)], pa.binary()),
                }
            )

    return run


def _counts_of_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column("counts").to_pylist():
            seen = np.frombuffer(zlib.decompress(packed), "<i8")
            ids = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(seen[ids], pa.int64())], ["id", "n"]
            )


def _encode_blocks(lengths: np.ndarray):
    codes = huffman.canonical_codes(lengths)

    def block(bucket: int, number: int, docs: list[tuple]) -> pa.RecordBatch:
        bits, _, offsets = huffman.encode(np.concatenate([d[1] for d in docs]), codes, lengths)
        return pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array([bucket], pa.int32()),
                "block": pa.array([number], pa.int64()),
                "doc_ids": pa.array([[d[0] for d in docs]], pa.list_(pa.int64())),
                "counts": pa.array([[len(d[1]) for d in docs]], pa.list_(pa.int64())),
                "bits": pa.array([bits], pa.binary()),
                "offsets": pa.array([offsets.tobytes()], pa.binary()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One task's range of documents, in order; ``bucket`` is the same in all rows."""
        held, size, number, bucket = [], 0, 0, 0
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for bucket, key, packed in zip(*(c.to_pylist() for c in batch.select(["bucket", "doc_id", "ids"]).columns)):
                if size >= BLOCK_IDS:
                    yield block(bucket, number, held)
                    held, size, number = [], 0, number + 1
                planes = np.frombuffer(unpack.decompress(packed), np.uint8)
                held.append((key, planes.reshape(4, -1).T.copy().view("<u4").ravel()))
                size += len(held[-1][1])
        if held:
            yield block(bucket, number, held)

    return run


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end: int = 2) -> None:
    """Tokenize whole texts once, fit one code to the counts of all ids, write the blocks.

    Ids are stored once between counting and coding; documents travel once, to the task
    that writes their range of doc_id.  The driver sees one count per id of the
    vocabulary and one bound per file.
    """
    spark = docs.sparkSession
    made = durable(id_and_text(docs).mapInArrow(_tokenize(tokenizer, end), _DRAFT))
    counted = (
        made.filter(F.col("counts").isNotNull())
        .select("counts")
        .mapInArrow(_counts_of_tasks, "id bigint, n bigint")
        .groupBy("id")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    counts = np.zeros(max((row.id for row in counted), default=-1) + 1, np.int64)
    for row in counted:
        counts[row.id] = row.n
    lengths = huffman.code_lengths(counts)
    spark.createDataFrame(
        [(int(i), int(counts[i]), int(lengths[i])) for i in np.flatnonzero(counts)],
        "id bigint, count bigint, bits int",
    ).coalesce(1).write.parquet(f"{path}/code")

    files = max(1, -(-int(counts.sum()) // FILE_IDS))
    (
        made.filter(F.col("ids").isNotNull())
        .select("doc_id", "ids")
        .repartitionByRange(files, F.asc_nulls_first("doc_id"))
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids")
        .withColumn("bucket", F.spark_partition_id())
        .mapInArrow(_encode_blocks(lengths), f"bucket int, block bigint, {_BLOCKS}")
        .write.parquet(f"{path}/blocks")
    )
    discard(made)


def _decode_blocks(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = huffman.decoding_table(lengths)
        for whole in batches:
            for i in range(0, whole.num_rows, 32):
                batch = whole.slice(i, 32)
                counts = batch.column("counts")
                sizes = np.array([sum(row) for row in counts.to_pylist()], np.int64)
                offsets = [np.frombuffer(o, np.uint32) for o in batch.column("offsets").to_pylist()]
                ids = huffman.decode(batch.column("bits").to_pylist(), sizes, offsets, table)
                each = counts.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(each)
                parents = np.repeat(np.arange(len(counts)), [len(row) for row in counts])
                firsts = np.searchsorted(parents, np.arange(len(counts)))
                data = ids.astype("<u4").tobytes()
                before = ends - each
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("bucket").take(pa.array(parents)),
                        batch.column("block").take(pa.array(parents)),
                        batch.column("doc_ids").flatten(),
                        pa.array(before - before[firsts[parents]], pa.int64()),
                        pa.array(each, pa.int64()),
                        pa.array(
                            [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends, each)], pa.int64()
                        ),
                    ],
                    ["bucket", "block", "doc_id", "place", "n_tokens", "ids_crc32"],
                )

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a file set: doc_id, start, n_tokens, ids_crc32, from the decoded ids.

    ``start`` counts the ids of all documents before it: ids in earlier files (one sum
    per file meets in one task), in earlier blocks of its file, and in its block.
    """
    code = spark.read.parquet(f"{path}/code").select("id", "bits").collect()
    lengths = np.zeros(max((row.id for row in code), default=0) + 1, np.uint8)
    for row in code:
        lengths[row.id] = row.bits
    if not code:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    blocks = spark.read.schema(f"bucket int, block bigint, {_BLOCKS}").parquet(f"{path}/blocks")
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, b: a + b)
    heads = blocks.select("bucket", "block", total.alias("n"))
    files = heads.groupBy("bucket").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = (
        Window.partitionBy("bucket")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = heads.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
        files.select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "bucket"
    )
    decoded = blocks.mapInArrow(_decode_blocks(lengths), f"bucket int, block bigint, {_READ}")
    return decoded.join(starts, ["bucket", "block"]).select(
        "doc_id", (F.col("base") + F.col("within") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{kind}/{uuid.uuid4().hex}"
