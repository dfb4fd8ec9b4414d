"""A store of documents on disk that replaces and clears whole documents; readers see the old state or the new one.

Rows lie in versions, one folder a write, that are never changed. A manifest tells of each document and version how many
rows it has and whether they are live; a commit, one small file made last and only if it is not there yet, names the
manifest that holds. So a write that fails before its commit changes nothing, one of two writers at a time wins, and what a
reader has begun to read stays until it is vacuumed.

    root/data/__version=.../part-*.parquet   root/manifest/.../part-*.parquet   root/commits/00000001

Reading leaves out what is dead by an anti-join with the replaced documents alone, which ``compact`` keeps few, so it costs no
shuffle of the store.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "__version string, rows long, live boolean"


class WriteConflict(RuntimeError):
    """Another writer has committed meanwhile; nothing of this write is seen. Writing again is safe."""


class DocumentStore:
    """Documents under ``root``. key: the column that names a row's document; null is refused."""

    def __init__(self, spark: SparkSession, root: str, key: str = "__document_id"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._paths, self._fs = spark._jvm.org.apache.hadoop.fs.Path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str) -> list[str]:
        place = self._paths(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def commits(self) -> list[int]:
        """The numbers of the commits so far."""
        return [int(n) for n in self._names("commits") if n.isdigit()]

    def _manifest_path(self, commit: int) -> str:
        return f"{self.root}/manifest/{self.spark.read.text(f'{self.root}/commits/{commit:08d}').first()[0]}"

    def manifest(self, at: int | None = None) -> DataFrame:
        """(document, __version, rows, live) at a commit, by default the last."""
        last = max(self.commits(), default=None) if at is None else at
        if last is None:
            return self.spark.createDataFrame([], f"`{self.key}` string, {MANIFEST}")
        return self.spark.read.parquet(self._manifest_path(last))

    def documents(self, at: int | None = None) -> DataFrame:
        """(document, rows) of what is in the store."""
        return self.manifest(at).where("live").select(self.key, "rows")

    def read(self, at: int | None = None) -> DataFrame | None:
        """The rows at a commit, by default the last; None if there are none. Columns that a version lacks are null."""
        manifest = self.manifest(at)
        versions = [r[0] for r in manifest.where("live").select("__version").distinct().collect()]  # a write's each, until compacted
        if not versions:
            return None
        data = self.spark.read.option("basePath", f"{self.root}/data").option("mergeSchema", True).parquet(*[f"{self.root}/data/__version={v}" for v in sorted(versions)])
        dead = manifest.where(~F.col("live") & F.col("__version").isin(versions)).select(self.key, "__version")
        return (data if dead.isEmpty() else data.join(dead, [self.key, "__version"], "left_anti")).drop("__version")

    def _commit(self, seen: int, manifest: DataFrame) -> int:
        name = uuid.uuid4().hex
        manifest.write.parquet(f"{self.root}/manifest/{name}")
        place = self._paths(f"{self.root}/commits/{seen + 1:08d}")
        try:
            out = self._fs.create(place, False)  # fails if it is there
        except Exception as e:
            if self._fs.exists(place):
                raise WriteConflict(f"commit {seen + 1} was made by another writer") from e
            raise
        out.write(bytearray(name.encode()))
        out.close()
        return seen + 1

    def _write(self, rows: DataFrame) -> str:
        version = uuid.uuid4().hex
        rows.sortWithinPartitions(self.key).write.parquet(f"{self.root}/data/__version={version}")
        return version

    def _counted(self, version: str) -> DataFrame:
        told = self.spark.read.parquet(f"{self.root}/data/__version={version}").groupBy(self.key).agg(F.count("*").alias("rows"))
        return told.select(F.col(self.key).cast("string").alias(self.key), F.lit(version).alias("__version"), "rows", F.lit(True).alias("live"))

    def put(self, rows: DataFrame) -> int:
        """Stores documents; those that are there already are replaced as a whole, all others stay untouched. Gives the
        commit. What ``rows`` reads may be this store."""
        seen, before = max(self.commits(), default=0), self.manifest()
        version = self._write(rows)
        new = self._counted(version)
        if not new.where(F.col(self.key).isNull()).isEmpty():
            raise ValueError(f"a row without {self.key}")
        replaced = new.select(self.key, F.lit(True).alias("_replaced"))
        kept = before.join(replaced, self.key, "left").withColumn("live", F.col("live") & F.col("_replaced").isNull()).drop("_replaced")
        return self._commit(seen, kept.unionByName(new))

    def delete(self, documents: Iterable[str]) -> DataFrame:
        """Removes documents by id; gives (document, removed) of those that were there."""
        ids = self.spark.createDataFrame([(d,) for d in sorted(set(documents))], f"`{self.key}` string")
        return self._remove(lambda live: live.join(ids, self.key, "left_semi"))

    def clear(self) -> DataFrame:
        """Removes all documents; gives (document, removed). Writing afterwards goes on in the same store."""
        return self._remove(lambda live: live)

    def _remove(self, which) -> DataFrame:
        seen, before = max(self.commits(), default=0), self.manifest()
        gone = which(before.where("live")).select(self.key, F.col("rows").alias("removed"))
        if not gone.isEmpty():
            kept = before.join(gone.withColumn("_gone", F.lit(True)).drop("removed"), self.key, "left").withColumn("live", F.col("live") & F.col("_gone").isNull()).drop("_gone")
            self._commit(seen, kept)
        return gone  # read from the manifest before, which stays

    def compact(self, share: float = 0.5) -> int | None:
        """Writes anew what is live of the versions of which more than ``share`` is dead; others stay untouched. Gives the
        commit, None if there is nothing to do."""
        seen, before = max(self.commits(), default=0), self.manifest()
        told = before.groupBy("__version").agg((F.sum(F.when(F.col("live"), F.col("rows")).otherwise(0)) / F.sum("rows")).alias("alive"))
        thin = [r["__version"] for r in told.where(F.col("alive") < 1 - share).collect()]
        if not thin:
            return None
        keep = before.where(~F.col("__version").isin(thin))
        live = before.where(F.col("__version").isin(thin) & F.col("live")).select(self.key, "__version")
        versions = [r[0] for r in live.select("__version").distinct().collect()]
        if versions:
            data = self.spark.read.option("basePath", f"{self.root}/data").option("mergeSchema", True).parquet(*[f"{self.root}/data/__version={v}" for v in versions])
            keep = keep.unionByName(self._counted(self._write(data.join(live, [self.key, "__version"], "left_semi").drop("__version"))))
        return self._commit(seen, keep)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes versions, manifests and commits that none of the last ``keep`` commits needs, failed writes' included;
        gives how many versions. Not while another writes; readers of earlier states must have ended."""
        commits = self.commits()
        held = commits[-keep:]
        manifests = {self._manifest_path(c).rpartition("/")[2] for c in held}
        versions = {r[0] for c in held for r in self.manifest(c).where("live").select("__version").distinct().collect()}
        for c in commits[:-keep]:
            self._fs.delete(self._paths(f"{self.root}/commits/{c:08d}"), False)
        for name in set(self._names("manifest")) - manifests:
            self._fs.delete(self._paths(f"{self.root}/manifest/{name}"), True)
        gone = [n for n in self._names("data") if n.removeprefix("__version=") not in versions]
        for name in gone:
            self._fs.delete(self._paths(f"{self.root}/data/{name}"), True)
        return len(gone)


__all__ = ["DocumentStore", "WriteConflict"]
