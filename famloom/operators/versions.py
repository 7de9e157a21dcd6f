"""Updates committed as versions of a table.

A table is a folder: rows under ``data``, dealt to buckets by the hash of the key, and
one manifest a version under ``versions``, naming each bucket's folder.  A commit first
writes the buckets it changes as new folders and last the manifest; readers go by the
newest whole manifest.  So a crash before the manifest leaves the old version as it was,
and what was written then is never named.  Unchanged buckets are shared by versions.

Two writers that start from one version cannot both commit: a manifest is created only
if its number is free, and only if its parent is still the newest.  Creation that fails
on an existing file is atomic on HDFS and on stores with conditional writes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from famloom.operators.updates import update_by_id

_END = "end of manifest"


class CommitConflict(RuntimeError):
    """Another writer committed since this one's version was read."""


@dataclass(frozen=True)
class Version:
    """One manifest: ``folders`` names, for each bucket with rows, the folder that holds it."""

    number: int
    parent: int
    key: str
    buckets: int
    schema: str
    folders: dict[int, str]

    def to_text(self) -> str:
        body = self.__dict__ | {"folders": {str(k): v for k, v in sorted(self.folders.items())}}
        return json.dumps(body) + "\n" + _END

    @classmethod
    def from_text(cls, text: str) -> Version | None:
        """None for a manifest that was not written to its end."""
        body, _, end = text.rpartition("\n")
        if end != _END:
            return None
        fields = json.loads(body)
        return cls(**fields | {"folders": {int(k): v for k, v in fields["folders"].items()}})


class VersionedTable:
    """A table in ``root`` whose updates are committed as a whole or not at all."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests -----------------------------------------------------------------

    def _manifests(self) -> dict[int, str]:
        folder = self._path(f"{self.root}/versions")
        if not self._files.exists(folder):
            return {}
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return {int(n[:12]): n for n in names if n[:12].isdigit() and n.endswith(".json")}

    def _read_text(self, name: str) -> str:
        stream = self._files.open(self._path(f"{self.root}/versions/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def versions(self) -> list[Version]:
        """Committed versions, oldest first."""
        names = self._manifests()
        found = [Version.from_text(self._read_text(names[n])) for n in sorted(names)]
        return [v for v in found if v is not None]

    def latest(self) -> Version | None:
        """The newest committed version; unfinished manifests are passed over."""
        names = self._manifests()
        for number in sorted(names, reverse=True):
            version = Version.from_text(self._read_text(names[number]))
            if version is not None:
                return version
        return None

    def _commit(self, version: Version) -> Version:
        """Write the manifest under the next free number, or fail without a trace."""
        newest = self.latest()
        if (newest.number if newest else 0) != version.parent:
            raise CommitConflict(f"version {version.parent} is no longer the newest")
        number = max(self._manifests(), default=0) + 1
        done = Version(**version.__dict__ | {"number": number})
        self._files.mkdirs(self._path(f"{self.root}/versions"))
        try:
            stream = self._files.create(self._path(f"{self.root}/versions/{number:012d}.json"), False)
        except Py4JJavaError as error:
            raise CommitConflict(f"version {number} was taken by another writer") from error
        try:
            stream.write(bytearray(done.to_text().encode()))
        finally:
            stream.close()
        return done

    # Rows ------------------------------------------------------------------------

    def _write(self, rows: DataFrame, key: str, buckets: int) -> dict[int, str]:
        """Store rows by bucket; the folders of the buckets that have any."""
        name = f"data/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        dealt = rows.withColumn("_bucket", bucket).repartition("_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.root}/{name}")
        written = [s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.root}/{name}"))]
        return {int(n.split("=")[1]): f"{name}/{n}" for n in written if n.startswith("_bucket=")}

    def _rows(self, version: Version, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(version.schema))
        wanted = version.folders if buckets is None else [b for b in buckets if b in version.folders]
        paths = [f"{self.root}/{version.folders[b]}" for b in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def create(self, rows: DataFrame, key: str, buckets: int = 64) -> Version:
        """The first version; ``buckets`` bounds a manifest's length and an update's grain."""
        if self.latest() is not None:
            raise CommitConflict(f"{self.root} holds a table already")
        folders = self._write(rows, key, buckets)
        return self._commit(Version(0, 0, key, buckets, rows.schema.json(), folders))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        if number is None:
            version = self.latest()
        else:
            version = next((v for v in self.versions() if v.number == number), None)
        if version is None:
            raise ValueError(f"{self.root} has no version" + (f" {number}" if number else ""))
        return self._rows(version)

    def prepare_update(
        self, changes: DataFrame, columns: Sequence[str], order: str | None = None, base: Version | None = None
    ) -> Version:
        """Write the changed buckets of the next version without committing it.

        Only buckets that ``changes`` has keys of are read and written again.
        """
        base = base or self.latest()
        if base is None:
            raise ValueError(f"{self.root} has no version")
        kind = self._rows(base, []).schema[base.key].dataType
        typed = changes.withColumn(base.key, F.col(base.key).cast(kind))
        bucket = F.pmod(F.xxhash64(base.key), F.lit(base.buckets)).cast("int")
        touched = sorted(r[0] for r in typed.select(bucket).distinct().collect())  # at most ``buckets``
        updated = update_by_id(self._rows(base, touched), typed, base.key, columns, order)
        folders = base.folders | self._write(updated, base.key, base.buckets)
        return Version(0, base.number, base.key, base.buckets, base.schema, folders)

    def commit(self, prepared: Version) -> Version:
        """Make a prepared version the newest, if its base still is."""
        return self._commit(prepared)

    def update(self, changes: DataFrame, columns: Sequence[str], order: str | None = None) -> Version:
        """Overwrite ``columns`` where ``changes`` has the key, as the next version."""
        return self.commit(self.prepare_update(changes, columns, order))

    def expire(self, keep: int) -> list[str]:
        """Drop all but the newest ``keep`` versions and the data that only they name.

        Data written by updates still in preparation counts as unnamed: run it alone.
        """
        versions = self.versions()
        gone, kept = versions[: max(0, len(versions) - keep)], versions[max(0, len(versions) - keep) :]
        for version in gone:
            self._files.delete(self._path(f"{self.root}/versions/{version.number:012d}.json"), False)
        named = {f for v in kept for f in v.folders.values()}
        dropped = []
        for run in self._files.listStatus(self._path(f"{self.root}/data")):
            for part in self._files.listStatus(run.getPath()):
                name = f"data/{run.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in named:
                    self._files.delete(part.getPath(), True)
                    dropped.append(name)
        return dropped
