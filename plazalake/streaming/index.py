"""An index table kept up to date by micro-batches, without listing what came before.

A batch is a run: a folder with a sub-folder per bucket of keys. A manifest, one small
file per batch, names the runs, the last batch in them and the high-water mark. A batch
reads the buckets of its own keys from the runs that the manifest names; FAN runs of one
level are merged into one of the next, so their number grows with the logarithm of the
number of batches.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that keys are dealt to, and runs of a level that are merged.
BUCKETS, FAN = 32, 8
#: Columns of a run beside its rows: the bucket, and the batch that a row came with.
BUCKET, BATCH = "_bucket", "_batch"


class Index:
    """Rows of one schema by key, at a path that Spark writes.

    newest: the column by which a later row of a key takes its place, the later batch of a
    tie; without it the row that came first stays. time: the column of the high-water mark.
    Within a batch repeated keys are settled by newest, then by all columns, so that a batch
    that is repeated gives the same rows. Rows with a null key are left out.
    """

    def __init__(self, spark: SparkSession, path: str, schema, key: str = "id", newest: str | None = None, time: str | None = None):
        self.spark, self.path, self.schema, self.key, self.newest, self.time = spark, path.rstrip("/"), schema, key, newest, time
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._hadoop.Path(path)

    # the manifest

    def _manifests(self) -> list[int]:
        at = self._path(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(x) for x in names if x.isdigit())

    def state(self) -> dict:
        """runs (level, name), batch (the last one in), mark (text or None)."""
        found = self._manifests()
        if not found:
            return {"runs": [], "batch": -1, "mark": None}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/{found[-1]}").collect()))

    def _publish(self, state: dict) -> None:
        """Written aside and renamed, so that readers see the old manifest or the new one; the two before stay for them."""
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(aside))
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self._fs.mkdirs(self._path(f"{self.path}/manifest"))
        target = self._path(f"{self.path}/manifest/{state['batch']}")
        self._fs.delete(target, False)
        if not self._fs.rename(self._path(aside), target):
            raise OSError(f"can't place the manifest of batch {state['batch']}")
        for old in self._manifests()[:-3]:
            self._fs.delete(self._path(f"{self.path}/manifest/{old}"), False)

    # rows

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int")

    def _read(self, runs: list, buckets: list[int] | None = None) -> DataFrame:
        """Rows of runs with their batch and bucket; only of these buckets if given."""
        schema = T.StructType([*self.spark.createDataFrame([], self.schema).schema.fields, T.StructField(BATCH, T.LongType()), T.StructField(BUCKET, T.IntegerType())])
        if not runs:
            return self.spark.createDataFrame([], schema)
        parts = None
        for _, name in runs:
            one = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
            if buckets is not None:
                one = one.where(F.col(BUCKET).isin(buckets))
            parts = one if parts is None else parts.unionByName(one)
        return parts

    def _one(self, rows: DataFrame) -> DataFrame:
        """A row for each key, by the rule of the index."""
        order = [F.desc_nulls_last(self.newest), F.desc(BATCH)] if self.newest else [F.asc(BATCH)]
        rest = [F.asc(c) for c in rows.columns if c not in (BATCH, BUCKET, self.newest)]
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(self.key).orderBy(*order, *rest))).where("_n = 1").drop("_n")

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.repartition(F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{name}")

    def rows(self) -> DataFrame:
        """What the index holds."""
        return self._one(self._read(self.state()["runs"])).drop(BATCH, BUCKET)

    def mark(self) -> str | None:
        """The newest time so far, as text; None before anything came."""
        return self.state()["mark"]

    def since(self, rows: DataFrame) -> DataFrame:
        """Rows from the mark on, the mark itself too, as more may come with that time."""
        mark = self.mark()
        return rows if mark is None else rows.where(F.col(self.time) >= F.lit(mark).cast(rows.schema[self.time].dataType))

    def apply(self, batch: DataFrame, number: int) -> bool:
        """Take in a micro-batch; numbers rise. False, with nothing done, if it is in already."""
        state = self.state()
        if number <= state["batch"]:
            return False
        names = self.spark.createDataFrame([], self.schema).columns
        new = batch.where(F.col(self.key).isNotNull()).select(*names).withColumns({BATCH: F.lit(number).cast("long"), BUCKET: self._bucket()})
        new = self._one(new)
        if not self.newest and state["runs"]:
            touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # BUCKETS at most
            new = new.join(self._read(state["runs"], touched).select(self.key), self.key, "left_anti").select(*names, BATCH, BUCKET)
        name = f"run-{number}"
        self._write(new, name)
        written = self._read([(0, name)])
        runs, old = [*state["runs"], [0, name]], []
        mark = state["mark"]
        if self.time:
            top = written.agg(F.max(self.time).cast("string")).first()[0]
            mark = max((x for x in (mark, top) if x is not None), default=None)
        if not written.take(1):
            runs.pop()
        level = 0
        while len(group := [r for r in runs if r[0] == level]) >= FAN:
            merged = f"run-{number}-{level + 1}"
            self._write(self._one(self._read(group)), merged)
            runs = [r for r in runs if r[0] != level] + [[level + 1, merged]]
            old += [r[1] for r in group]
            level += 1
        self._publish({"runs": runs, "batch": number, "mark": mark, "gone": old})
        for gone in state.get("gone", []):  # merged a batch ago: readers that began then have ended or read again
            self._fs.delete(self._path(f"{self.path}/{gone}"), True)
        return True
