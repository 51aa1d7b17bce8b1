"""Tables that are changed in place: buckets by key, new versions of the touched ones, one manifest a commit.

Under the store's path, ``data/<table>/version=<n>/bucket=<b>`` has rows and ``manifest/version=<n>`` says
which version of each bucket counts. A change writes the buckets it touches under a new version and then
the manifest, a single file; so a run that dies leaves the rows as they were, in every table of the change,
and doing it again writes the same rows. Buckets that are not touched are neither read nor written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.sources import tables


class TableStore:
    """Tables under ``path``, each in ``buckets`` buckets by the hash of its ``by`` columns."""

    def __init__(self, spark: SparkSession, path: str, by: dict[str, list[str]], buckets: int = 16):
        self.spark, self.path, self.by, self.buckets = spark, path.rstrip("/"), by, buckets

    # -- what is there

    def _manifests(self) -> list[int]:
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        whole = [p.getPath() for p in fs.listStatus(fs_path) if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().partition("=")[2]) for p in whole)

    def version(self) -> int:
        """Number of the last commit, 0 before the first."""
        return max(self._manifests(), default=0)

    def _state(self) -> dict[str, dict[int, int]]:
        """For each table its buckets' versions: as many rows as there are tables times buckets."""
        at = self.version()
        found: dict[str, dict[int, int]] = {name: {} for name in self.by}
        if at:
            for r in self.spark.read.parquet(f"{self.path}/manifest/version={at}").collect():
                found.setdefault(r["table"], {})[r["bucket"]] = r["data_version"]
        return found

    def _bucket(self, name: str):
        return F.pmod(F.xxhash64(*self.by[name]), F.lit(self.buckets)).cast("int")

    def read(self, name: str, only: list[int] | None = None) -> DataFrame | None:
        """The table as of the last commit (or ``only`` some buckets of it); None if it was never written."""
        state = self._state()[name]
        wanted = {b: v for b, v in state.items() if only is None or b in only}
        if not wanted:
            return self.spark.read.parquet(f"{self.path}/data/{name}/version={next(iter(state.values()))}").drop("bucket").limit(0) if state else None
        parts = [f"{self.path}/data/{name}/version={v}/bucket={b}" for b, v in sorted(wanted.items())]
        return self.spark.read.parquet(*parts)

    # -- changes

    def _write(self, name: str, rows: DataFrame, version: int) -> None:
        # an empty bucket has a file as well, so that its rows are known to be gone
        made = rows.withColumn("bucket", self._bucket(name)).repartition("bucket")
        made.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{name}/version={version}")

    def _commit(self, version: int, written: dict[str, list[int]]) -> None:
        state = self._state()
        for name, touched in written.items():
            there = self._there(name, version)
            for b in touched:
                if b in there:
                    state[name][b] = version
                else:
                    state[name].pop(b, None)
        rows = [(name, b, v) for name, buckets in state.items() for b, v in buckets.items()]
        self.spark.createDataFrame(rows, "table string, bucket int, data_version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def _there(self, name: str, version: int) -> set[int]:
        jvm, at = self.spark.sparkContext._jvm, f"{self.path}/data/{name}/version={version}"
        fs_path = jvm.org.apache.hadoop.fs.Path(at)
        fs = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return {int(p.getPath().getName().partition("=")[2]) for p in fs.listStatus(fs_path) if p.getPath().getName().startswith("bucket=")} if fs.exists(fs_path) else set()

    def replace(self, changes: dict[str, DataFrame]) -> None:
        """Whole tables anew, in one commit."""
        at = self.version() + 1
        for name, rows in changes.items():
            self._write(name, rows, at)
        self._commit(at, {name: list(range(self.buckets)) for name in changes})

    def upsert(self, name: str, new: DataFrame, keys: list[str], version: str | None = None) -> None:
        """One row for each key of ``new`` (its latest by ``version``) in place of what was there; see ``tables.upsert``.

        ``keys`` hold the table's bucket columns, so a key's rows are in one bucket.
        """
        if not set(self.by[name]) <= set(keys):
            raise ValueError(f"keys {keys} don't hold the bucket columns {self.by[name]}")
        touched = self._touched(name, new)
        old = self.read(name, touched)
        fresh = tables.upsert(new.limit(0) if old is None else old, new, keys, version)
        at = self.version() + 1
        self._write(name, fresh, at)
        self._commit(at, {name: touched})

    def delete(self, names: list[str], gone: DataFrame, key: str = "session_id") -> None:
        """Takes the rows of some keys out of every named table, in one commit.

        A table that is bucketed by the key has only its buckets with such keys written again.
        """
        at, written = self.version() + 1, {}
        for name in names:
            touched = self._touched(name, gone) if self.by[name] == [key] else sorted(self._state()[name])
            old = self.read(name, touched)
            if old is None:
                continue
            self._write(name, tables.cascade_delete({name: old}, gone, key)[name], at)
            written[name] = touched
        self._commit(at, written)

    def purge(self, names: list[str], derived: set[str], sessions: DataFrame) -> None:
        """Derived tables without the given sessions' rows; captured ones stay as they are."""
        self.delete([n for n in names if n in derived], sessions)

    def _touched(self, name: str, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket(name)).distinct().collect())  # as many as buckets at most
