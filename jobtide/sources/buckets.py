"""A table of current rows, kept in buckets of its keys: a batch rewrites the buckets that it touches.

Which folders hold the buckets is said by a manifest; each batch writes new folders for its buckets and
then one new manifest, which becomes visible by a rename. Readers read the folders of the newest manifest,
a row per key, and rank nothing. A batch that fails before the rename leaves folders that nobody reads and
that its retry replaces; a batch that is repeated after the rename changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.operators.stats import latest_rows
from jobtide.session import remove

BUCKETS = 256


@dataclass(frozen=True)
class BucketTable:
    """``schema`` (DDL) of the rows, their ``keys``, and the columns by which of a key's rows the newest is taken."""

    spark: SparkSession
    path: str
    schema: str
    keys: Sequence[str]
    newest: Sequence[str]
    buckets: int = BUCKETS

    # -- manifests -----------------------------------------------------------------------------------

    def _files(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, files = self._files(f"{self.path}/_manifests")
        found = files.listStatus(folder) if files.exists(folder) else []
        names = [status.getPath().getName() for status in found]
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def manifest(self, version: int | None = None) -> dict:
        """``batch_id`` of the last batch and ``folders`` by bucket; of the newest version unless told."""
        known = self.versions()
        if not known:
            return {"batch_id": -1, "folders": {}}
        name, files = self._files(f"{self.path}/_manifests/v{known[-1] if version is None else version}")
        stream = files.open(name)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """The next version; a rename makes it whole or not at all, and never replaces another."""
        version = (self.versions() or [-1])[-1] + 1
        draft, files = self._files(f"{self.path}/_manifests/_draft-{manifest['batch_id']}")
        stream = files.create(draft, True)
        try:
            stream.write(json.dumps(manifest).encode())
        finally:
            stream.close()
        target, _ = self._files(f"{self.path}/_manifests/v{version}")
        if not files.rename(draft, target):
            raise RuntimeError(f"manifest v{version} was written by another batch")

    # -- rows ----------------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, folders: Sequence[str]) -> DataFrame:
        paths = [f"{self.path}/{folder}" for folder in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(sorted(self.manifest()["folders"].values()))

    def stage(self, rows: DataFrame, batch_id: int) -> dict:
        """Write the buckets that ``rows`` touch anew, and return the manifest that would show them."""
        before = self.manifest()
        names = [field.name for field in self.spark.createDataFrame([], self.schema).schema]
        rows = rows.select(*names).withColumn("__batch", F.lit(1))
        touched = sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())
        old = self._read([before["folders"][str(b)] for b in touched if str(b) in before["folders"]]).withColumn("__batch", F.lit(0))
        order = [F.col(c).desc_nulls_last() for c in (*self.newest, "__batch")]
        merged = latest_rows(old.unionByName(rows).withColumn("bucket", self._bucket()), ["bucket", *self.keys], order)
        folder = f"rows/batch_id={batch_id}"
        merged.drop("__batch").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return {"batch_id": batch_id, "folders": before["folders"] | {str(b): f"{folder}/bucket={b}" for b in touched}}

    def upsert(self, rows: DataFrame, batch_id: int) -> None:
        """Put the newest row of each key in its place. Batches come in order; one that is known already is left out."""
        if batch_id > self.manifest()["batch_id"]:
            self._publish(self.stage(rows, batch_id))

    def vacuum(self, keep: int = 1) -> None:
        """Remove manifests but the newest ``keep``, and folders that none of these shows."""
        known = self.versions()
        shown = {folder for v in known[-keep:] for folder in self.manifest(v)["folders"].values()}
        for version in known[:-keep]:
            remove(self.spark, f"{self.path}/_manifests/v{version}")
        rows, files = self._files(f"{self.path}/rows")
        for batch in files.listStatus(rows) if files.exists(rows) else []:
            for bucket in files.listStatus(batch.getPath()):
                name = f"rows/{batch.getPath().getName()}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and name not in shown:
                    files.delete(bucket.getPath(), True)
