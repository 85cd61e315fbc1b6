"""Stored tables that change: copy on write of the touched buckets, published by one pointer.

A store is a folder. Each table is dealt to buckets by the hash of its first key column, a folder of
Parquet files a bucket. A pointer file names the folders that make up every table now. A change
reads and rewrites only the buckets that it touches, into new folders, for as many tables as it
likes; nothing is visible until the next pointer is in place, which is one rename. A run that dies
before it leaves the old rows, and of two changes made at once the second to publish fails. Old folders
stay until `vacuum`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        fs, folder = self._fs(f"{self.path}/pointers")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json")), default=0)

    def state(self, version: int | None = None) -> dict:
        """table: schema, key, buckets, folders by bucket, as of a version (the last)."""
        version = self.version() if version is None else version
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/pointers/{version:09d}.json", wholetext=True).first()[0])

    def publish(self, state: dict, version: int) -> None:
        """Put the pointer of a new version in place; fails if there is one already."""
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        fs, target = self._fs(f"{self.path}/pointers/{version:09d}.json")
        _, source = self._fs(draft)
        fs.mkdirs(target.getParent())
        out = fs.create(source, False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if fs.exists(target) or not fs.rename(source, target):
            raise RuntimeError(f"version {version} of {self.path} has been published by another change")

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return rows_of(self.spark, self.path, self.state(version)[table])

    def change(self) -> Change:
        return Change(self)

    def vacuum(self) -> None:
        """Delete the folders that the last version does not name, and all earlier pointers."""
        version = self.version()
        named = {f for t in self.state(version).values() for f in t["folders"].values()}
        fs, data = self._fs(f"{self.path}/data")
        for write in fs.listStatus(data) if fs.exists(data) else []:
            for bucket in fs.listStatus(write.getPath()):
                if bucket.isDirectory() and f"{write.getPath().getName()}/{bucket.getPath().getName()}" not in named:
                    fs.delete(bucket.getPath(), True)
        for old in range(1, version):
            fs, p = self._fs(f"{self.path}/pointers/{old:09d}.json")
            fs.delete(p, False)


def rows_of(spark: SparkSession, path: str, table: dict, buckets: list[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(table["schema"])
    folders = [f"{path}/data/{f}" for b, f in sorted(table["folders"].items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


class Change:
    """Changes of one or more tables that become visible together, by `commit`."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.version()
        self.tables = store.state(self.base)

    def read(self, table: str) -> DataFrame:
        """The table with what this change has done so far."""
        return rows_of(self.store.spark, self.store.path, self.tables[table])

    def _bucket(self, table: str) -> Column:
        t = self.tables[table]
        return F.pmod(F.xxhash64(F.col(t["key"][0]).cast("string")), F.lit(t["buckets"])).cast("int").cast("string")

    def _touched(self, table: str, rows: DataFrame) -> list[str]:
        found = rows.select(self._bucket(table).alias("b")).distinct().collect()  # at most a row a bucket
        return sorted(r["b"] for r in found)

    def _write(self, table: str, rows: DataFrame, touched: list[str]) -> None:
        """Put rows, which lie in the touched buckets, in place of what these held."""
        t, name = self.tables[table], uuid.uuid4().hex
        columns = StructType.fromJson(t["schema"]).fieldNames()
        target = f"{self.store.path}/data/{name}"
        rows.select(*columns, self._bucket(table).alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(target)
        fs, _ = self.store._fs(target)
        folders = {b: f for b, f in t["folders"].items() if b not in touched}
        for b in touched:
            _, p = self.store._fs(f"{target}/bucket={b}")
            if fs.exists(p):
                folders[b] = f"{name}/bucket={b}"
        self.tables[table] = t | {"folders": folders}

    def create(self, table: str, rows: DataFrame, *key: str, buckets: int = 16) -> None:
        """A new table, whose rows `key` names; it is dealt by the first column of key."""
        self.tables[table] = {"schema": json.loads(rows.schema.json()), "key": list(key), "buckets": buckets, "folders": {}}
        self._write(table, rows, [str(b) for b in range(buckets)])

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Rows in place of those with their keys, new keys added. A key occurs once in rows."""
        touched, t = self._touched(table, rows), self.tables[table]
        old = rows_of(self.store.spark, self.store.path, t, touched)
        self._write(table, old.join(rows.select(*t["key"]), t["key"], "left_anti").select(*old.columns).unionByName(rows.select(*old.columns)), touched)

    def update(self, table: str, where: Column, **values: Column) -> None:
        """New values for the columns of the rows that satisfy a condition."""
        touched = self._touched(table, self.read(table).where(where))
        old = rows_of(self.store.spark, self.store.path, self.tables[table], touched)
        kinds = {f.name: f.dataType for f in old.schema}
        hit = F.coalesce(where, F.lit(False))
        changed = old.withColumn("hit", hit).select(*[F.when(F.col("hit"), values[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns])
        self._write(table, changed, touched)

    def delete(self, table: str, where: Column) -> int:
        """Drop the rows that satisfy a condition; how many there were."""
        hit = self.read(table).where(where).groupBy(self._bucket(table).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most a row a bucket
        touched = sorted(r["b"] for r in hit)
        if touched:
            old = rows_of(self.store.spark, self.store.path, self.tables[table], touched)
            self._write(table, old.where(~F.coalesce(where, F.lit(False))), touched)
        return sum(r["n"] for r in hit)

    def commit(self) -> int:
        """Publish; the new version."""
        self.store.publish(self.tables, self.base + 1)
        return self.base + 1
