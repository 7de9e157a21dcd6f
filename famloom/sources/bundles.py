"""Many small files as few: gzip members in bundles, with an index of their offsets.

One file or folder per family makes millions of names.  A bundle holds the texts of many
families one after the other, each as gzip members of its own, so the bytes of one family
are by themselves a valid ``.gz`` file.  The index, a Parquet table sorted by family, says
where they lie; a point read asks the index and then reads just these ranges.

Rows are range-partitioned by family and order, so bundles follow the family order, a
large family spans several tasks, and no text is held beyond ``MEMBER_BYTES`` (a longer
row is a member by itself).  A task writes a bundle under a name of its own and reports it
in the index.  The index is committed last, by Spark's committer, and names the bundles of
successful attempts only: bundles of lost or repeated attempts are never read.

Null values are left out.  A family of null is written and comes back in whole reads.
Rows of one family with equal ``order`` may come in any order.  An empty table makes an
empty index.
"""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from famloom.sources.places import opened, qualified

#: Text that makes a gzip member full, and compressed bytes that one reading task is given.
MEMBER_BYTES = 4 << 20
TASK_BYTES = 64 << 20


def _bundler(folder: str, member_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        name = f"bundle-{task:06d}-{uuid.uuid4().hex}.gz"
        system, base = opened(folder)
        sink, at, part, kind = None, 0, task << 33, None
        key, held, size = None, [], 0

        def member() -> pa.RecordBatch:
            nonlocal sink, at, part, held, size
            if sink is None:
                sink = system.open_output_stream(f"{base}/{name}", compression=None)
            data = gzip.compress("".join(held).encode("utf-8", "surrogatepass"), 6, mtime=0)
            sink.write(data)
            row = [[key], [part], [name], [at], [len(data)], [len(held)]]
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            at, part, held, size = at + len(data), part + 1, [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, kinds)],
                ["family", "part", "file", "offset", "length", "n_rows"],
            )

        try:
            for batch in batches:
                kind = batch.schema.field("family").type
                for family, value in zip(batch.column("family"), batch.column("value")):
                    family, value = family.as_py(), value.as_py()
                    if held and (family != key or size + len(value) > member_bytes):
                        yield member()
                    key = family
                    held.append(value + "\n")
                    size += len(value) + 1
            if held:
                yield member()
        finally:
            if sink is not None:
                sink.close()

    return run


def write_bundles(
    rows: DataFrame,
    path: str,
    family: str,
    value: str,
    order: Sequence[str] = (),
    member_bytes: int = MEMBER_BYTES,
) -> None:
    """Write the ``value`` texts of every family, in ``order``, below the new folder ``path``."""
    spark = rows.sparkSession
    folder = qualified(spark, path)
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/data")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(place):
        raise ValueError(f"{path} already holds bundles")
    system.mkdirs(place)
    orders = [f"_order{i}" for i in range(len(order))]
    texts = rows.filter(F.col(value).isNotNull()).select(
        F.col(family).alias("family"),
        F.col(value).cast("string").alias("value"),
        *[F.col(name).alias(own) for name, own in zip(order, orders)],
    )
    kind = texts.schema["family"].dataType.simpleString()
    texts.repartitionByRange("family", *orders).sortWithinPartitions("family", *orders).select(
        "family", "value"
    ).mapInArrow(
        _bundler(f"{folder}/data", member_bytes),
        f"family {kind}, part bigint, file string, offset bigint, length bigint, n_rows bigint",
    ).write.parquet(f"{folder}/index")


def bundle_index(spark: SparkSession, path: str) -> DataFrame:
    """family, part, file, offset, length, n_rows: one row per member, parts in order."""
    return spark.read.parquet(f"{qualified(spark, path)}/index")


def _reader(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        name, source = None, None
        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    file, offset, length = (row.column(c)[0].as_py() for c in ("file", "offset", "length"))
                    if file != name:
                        if source is not None:
                            source.close()
                        name, source = file, system.open_input_file(f"{base}/{file}")
                    text = zlib.decompress(source.read_at(length, offset), 31)
                    yield pa.RecordBatch.from_arrays(
                        [row.column("family"), row.column("part"), pa.array([text]).cast(pa.string())],
                        ["family", "part", "content"],
                    )
        finally:
            if source is not None:
                source.close()

    return run


def read_bundles(spark: SparkSession, path: str, families: DataFrame | None = None) -> DataFrame:
    """family, part, content: the texts of all families, or of those in a one-column table.

    Only the wanted ranges are read.  Index rows are few and small, so they are dealt
    over tasks by the bytes they stand for.
    """
    folder = qualified(spark, path)
    index = bundle_index(spark, path)
    if families is not None:
        wanted = families.select(F.col(families.columns[0]).alias("family"))
        index = index.join(wanted, "family", "left_semi")
    size = index.agg(F.sum("length").alias("n")).first().n or 0
    tasks = max(1, -(-size // TASK_BYTES), min(spark.sparkContext.defaultParallelism, size >> 20))
    dealt = index.repartition(int(tasks), "file", "offset").sortWithinPartitions("file", "offset")
    kind = index.schema["family"].dataType.simpleString()
    return dealt.mapInArrow(_reader(f"{folder}/data"), f"family {kind}, part bigint, content string")


def read_family(spark: SparkSession, path: str, family: object) -> DataFrame:
    """part, content of one family, in order; the index is pruned by its sorted families."""
    index = bundle_index(spark, path).filter(F.col("family") == F.lit(family))
    kind = index.schema["family"].dataType.simpleString()
    found = index.sortWithinPartitions("file", "offset").mapInArrow(
        _reader(f"{qualified(spark, path)}/data"), f"family {kind}, part bigint, content string"
    )
    return found.select("part", "content").orderBy("part")


def bundle_lines(contents: DataFrame) -> DataFrame:
    """family, part, line_order, value: the lines of contents that :func:`read_bundles` gives."""
    lines = F.split(F.expr("left(content, length(content) - 1)"), "\n", -1)
    return contents.select("family", "part", F.posexplode(lines).alias("line_order", "value"))
