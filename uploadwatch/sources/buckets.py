"""Result tables in buckets of their key's hash: a merge reads and rewrites only the buckets its batch meets.

A merge writes those buckets to a folder of its own and then a manifest, which names the folder of each bucket.  The
manifest is what commits: readers follow the newest, and as a manifest's file can be made only once, of two writers that
began from the same one the second gets an error and changes nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from uploadwatch import schemas
from uploadwatch.scratch import drop_path, materialize

BUCKETS = 64


class ConcurrentWrite(RuntimeError):
    """Another writer has committed since this merge began."""


class BucketTable:
    """A keyed Parquet table under a folder, in a fixed number of buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _files(self):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder

    def _manifests(self) -> list[dict]:
        """Committed manifests, oldest first; a file that was not written to its end is none."""
        fs, folder = self._files()
        found = []
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            if named := re.fullmatch(r"m([0-9]+)\.json", status.getPath().getName()):
                rows = self.spark.read.text(f"{self.path}/{named[0]}", wholetext=True).collect()  # one small file
                try:
                    found.append(json.loads(rows[0][0]) | {"number": int(named[1])})
                except (IndexError, ValueError):
                    continue
        return sorted(found, key=lambda m: m["number"])

    def _of(self, manifest: dict | None, buckets: list[int] | None = None) -> DataFrame:
        placed = {int(k): v for k, v in manifest["buckets"].items()} if manifest else {}
        paths = [f"{self.path}/{placed[k]}/_bucket={k}" for k in sorted(placed) if buckets is None or k in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def holds(self, stream: str, batch: int) -> bool:
        """Whether a stream's batch, or a later one, is in the table."""
        held = self._manifests()
        return bool(held) and held[-1]["batches"].get(stream, -1) >= batch

    def read(self, before: tuple[str, int] | None = None) -> DataFrame:
        """The newest state, or the newest that a stream's batch has not written."""
        held = [m for m in self._manifests() if before is None or m["batches"].get(before[0], -1) < before[1]]
        return self._of(held[-1] if held else None)

    def meeting(self, keys: DataFrame, before: tuple[str, int] | None = None) -> DataFrame:
        """Rows whose key is among keys; only the buckets of these keys are read."""
        held = [m for m in self._manifests() if before is None or m["batches"].get(before[0], -1) < before[1]]
        met = sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())  # buckets at most
        return self._of(held[-1] if held else None, met).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def merge(self, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> list[int]:
        """``how(old, rows)`` for the buckets that rows meet, which must keep a row's key; gives the buckets that were rewritten."""
        held = self._manifests()
        last = held[-1] if held else {"number": 0, "buckets": {}, "batches": {}}
        rows = materialize(rows, "batch")
        met = sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # buckets at most
        folder = f"b{last['number'] + 1}-{uuid.uuid4().hex[:12]}"
        if met:
            after = how(self._of(last, met), rows).select(*schemas.names(self.schema))
            after.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fs, base = self._files()
        kept = {int(k) for k in last["buckets"]} - {*met}
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        written = [k for k in met if fs.exists(path(f"{self.path}/{folder}/_bucket={k}"))]
        manifest = {"buckets": {str(k): last["buckets"][str(k)] for k in sorted(kept)} | {str(k): folder for k in written}, "batches": last["batches"] | ({batch[0]: batch[1]} if batch else {})}
        try:
            out = fs.create(path(f"{self.path}/m{last['number'] + 1}.json"), False)
        except Exception as e:
            drop_path(self.spark, f"{self.path}/{folder}")
            raise ConcurrentWrite(f"{self.path} has a newer manifest than {last['number']}") from e
        out.write(json.dumps(manifest).encode())
        out.close()
        self._tidy([*held, manifest | {"number": last["number"] + 1}])
        return written

    def _tidy(self, manifests: list[dict]) -> None:
        """Folders and manifests that neither the newest state nor the one before names."""
        named = {f for m in manifests[-2:] for f in m["buckets"].values()}
        for m in manifests[:-2]:
            for folder in {*m["buckets"].values()} - named:
                drop_path(self.spark, f"{self.path}/{folder}")
            drop_path(self.spark, f"{self.path}/m{m['number']}.json")
