"""Merge-on-read tables: a base, deltas of changed rows, and numbered pointers.

A table's state is a small JSON file `at-<number>`; the greatest number counts. It names, for every bucket of the key, the version folder that
holds the bucket's base rows, and the delta folders since. A delta holds only the rows that were put or dropped, in order of its number; a
read takes the newest row of each key from the deltas and the rest from the base. The keys of the deltas are few, so that the base is
filtered by them where it is (Spark broadcasts them as long as they are small) and isn't shuffled.

`merge` writes a delta, or nothing at all if there is no row. Once deltas are many or large, `compact` writes anew the buckets that they
touch, and only those. Writers add files and then a pointer, by one rename that fails if the number is taken; nothing that a pointer names is
overwritten, so a failed write is never seen, and a reader keeps what it began with until `vacuum` deletes what no recent pointer names.

Tables of a few rows (settings, sessions, jobs) stand in the pointer itself.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Deltas after which, and share of the base's rows from which, a table is compacted.
MOST_DELTAS = 8
DELTA_SHARE = 0.25
#: Base rows a bucket is meant to have; the number of buckets follows at a compaction of all of them.
BUCKET_ROWS = 2_000_000
MOST_BUCKETS = 8192


class Conflict(RuntimeError):
    """Another writer was first."""


class Store:
    """Tables under one folder, local to the driver or in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # pointers

    def pointers(self, name: str) -> list[str]:
        """Names of the pointers, the newest last."""
        folder = self._path(f"{self.base}/{name}")
        if not self._fs.exists(folder):
            return []
        return sorted(n for n in (f.getPath().getName() for f in self._fs.listStatus(folder)) if n.startswith("at-"))

    def load(self, name: str, pointer: str) -> dict:
        stream = self._fs.open(self._path(f"{self.base}/{name}/{pointer}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def state(self, name: str) -> tuple[int, dict]:
        """The newest pointer's number and content; 0 and an empty state without one."""
        pointers = self.pointers(name)
        if not pointers:
            return 0, {"buckets": 1, "base": {}, "rows": 0, "deltas": []}
        return int(pointers[-1].removeprefix("at-")), self.load(name, pointers[-1])

    def point(self, name: str, number: int, state: dict) -> None:
        beside, target = self._path(f"{self.base}/{name}/next-{uuid.uuid4().hex}"), self._path(f"{self.base}/{name}/at-{number:012d}")
        stream = self._fs.create(beside, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if not self._fs.rename(beside, target):
            self._fs.delete(beside, False)
            raise Conflict(f"another process wrote {name}")

    # small tables

    def rows(self, name: str) -> list[list]:
        return self.state(name)[1].get("small", [])

    def put_rows(self, name: str, rows: list[list]) -> None:
        self.point(name, self.state(name)[0] + 1, {"small": rows})

    # large tables

    def read(self, name: str, ddl: str, keys: tuple[str, ...]) -> DataFrame:
        """The table as its newest pointer has it."""
        return self.merged(name, self.state(name)[1], ddl, keys)

    def merged(self, name: str, state: dict, ddl: str, keys: tuple[str, ...], within: list[int] | None = None) -> DataFrame:
        """Base and deltas of a state, or of the buckets `within` only."""
        columns = [f.name for f in self.spark.createDataFrame([], ddl).schema]
        base = self.base_rows(name, state, ddl, within)
        if not state["deltas"]:
            return base.select(*columns)
        newest = self.newest(name, state, ddl, keys, within)
        kept = base.join(newest.select("_bucket", *keys), ["_bucket", *keys], "left_anti").select(*columns)
        return kept.unionByName(newest.filter(~F.col("_gone")).select(*columns))

    def base_rows(self, name: str, state: dict, ddl: str, within: list[int] | None = None) -> DataFrame:
        versions = defaultdict(list)
        for bucket, version in state["base"].items():
            if version is not None and (within is None or int(bucket) in within):
                versions[version].append(int(bucket))
        out = None
        for version, buckets in versions.items():
            folder = f"{self.base}/{name}/{version}"
            part = self.spark.read.schema(f"{ddl}, _bucket int").option("basePath", folder).parquet(*[f"{folder}/_bucket={b}" for b in sorted(buckets)])
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], f"{ddl}, _bucket int") if out is None else out

    def newest(self, name: str, state: dict, ddl: str, keys: tuple[str, ...], within: list[int] | None = None) -> DataFrame:
        """The newest row of each key in the deltas, with _bucket and _gone."""
        paths = [f"{self.base}/{name}/{d['path']}" for d in state["deltas"]]
        rows = self.spark.read.schema(f"{ddl}, _gone boolean, _seq long").parquet(*paths).withColumn("_bucket", bucket_of(keys, state["buckets"]))
        if within is not None:
            rows = rows.filter(F.col("_bucket").isin(within))
        if len(paths) == 1:
            return rows
        rest = [c for c in rows.columns if c not in keys and c != "_bucket"]
        picked = rows.groupBy("_bucket", *keys).agg(F.max_by(F.struct(*rest), "_seq").alias("_row"))
        return picked.select("_bucket", *keys, *[F.col(f"_row.{c}").alias(c) for c in rest])

    def write(self, name: str, table: DataFrame, ddl: str, keys: tuple[str, ...]) -> int:
        """A new base of the whole table, cast to `ddl`; returns its number of rows."""
        number, state = self.state(name)
        buckets = wanted_buckets(state["rows"] + sum(d["rows"] for d in state["deltas"]))
        version, rows, _ = self._base(name, shaped(table, self.spark.createDataFrame([], ddl)), keys, buckets)
        self.point(name, number + 1, {"buckets": buckets, "base": self._placed(name, version, range(buckets)), "rows": rows, "deltas": []})
        return rows

    def _base(self, name: str, table: DataFrame, keys: tuple[str, ...], buckets: int) -> tuple[str, int, Observation]:
        version, seen = f"v-{uuid.uuid4().hex}", Observation()
        placed = table.withColumn("_bucket", bucket_of(keys, buckets)).observe(seen, F.count(F.lit(1)).alias("n"))
        if buckets > 1:
            placed = placed.repartition("_bucket")
        placed.write.partitionBy("_bucket").parquet(f"{self.base}/{name}/{version}")
        return version, seen.get["n"], seen

    def _placed(self, name: str, version: str, buckets) -> dict[str, str | None]:
        """Bucket → version, or null where the version has no row of a bucket."""
        found = {f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.base}/{name}/{version}"))}
        return {str(b): version if f"_bucket={b}" in found else None for b in buckets}

    def merge(self, name: str, rows: DataFrame | None, ddl: str, keys: tuple[str, ...], *, gone: DataFrame | None = None) -> int:
        """Puts `rows`, at most one a key, and drops the keys of `gone`; returns the number of both. Writes nothing if there are none."""
        empty = self.spark.createDataFrame([], ddl)
        number, state = self.state(name)
        if rows is not None and not state["base"] and not state["deltas"]:  # the first rows are a base; there is nothing to drop
            version, n, _ = self._base(name, shaped(rows, empty), keys, 1)
            if n:
                self.point(name, number + 1, {"buckets": 1, "base": self._placed(name, version, [0]), "rows": n, "deltas": []})
            else:
                self._fs.delete(self._path(f"{self.base}/{name}/{version}"), True)
            return n
        delta = None if rows is None else shaped(rows, empty).withColumn("_gone", F.lit(False))
        if gone is not None:
            dropped = shaped(gone.select(*keys), empty).withColumn("_gone", F.lit(True))
            delta = dropped if delta is None else delta.unionByName(dropped)
        path, seen = f"d-{uuid.uuid4().hex}", Observation()
        delta.withColumn("_seq", F.lit(number + 1).cast("long")).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.base}/{name}/{path}")
        n = seen.get["n"]
        if not n:
            self._fs.delete(self._path(f"{self.base}/{name}/{path}"), True)
            return 0
        deltas = [*state["deltas"], {"path": path, "rows": n}]
        self.point(name, number + 1, state | {"deltas": deltas})
        if len(deltas) > MOST_DELTAS or sum(d["rows"] for d in deltas) > DELTA_SHARE * state["rows"]:
            self.compact(name, ddl, keys)
        return n

    def compact(self, name: str, ddl: str, keys: tuple[str, ...]) -> int:
        """Writes the buckets anew that deltas touch, or all once there should be more of them; returns how many were written."""
        number, state = self.state(name)
        if not state["deltas"]:
            return 0
        wanted = wanted_buckets(state["rows"] + sum(d["rows"] for d in state["deltas"]))
        touched = sorted(r[0] for r in self.newest(name, state, ddl, keys).select("_bucket").distinct().collect())
        if not state["base"] or wanted >= 4 * state["buckets"] or len(touched) == state["buckets"]:
            version, rows, _ = self._base(name, self.merged(name, state, ddl, keys), keys, wanted)
            self.point(name, number + 1, {"buckets": wanted, "base": self._placed(name, version, range(wanted)), "rows": rows, "deltas": []})
            return wanted
        before = self.base_rows(name, state, ddl, touched).count()
        version, rows, _ = self._base(name, self.merged(name, state, ddl, keys, touched), keys, state["buckets"])
        self.point(name, number + 1, state | {"base": state["base"] | self._placed(name, version, touched), "rows": state["rows"] - before + rows, "deltas": []})
        return len(touched)

    def vacuum(self, name: str, *, keep_seconds: float = 0) -> int:
        """Deletes what the newest pointer doesn't name, and older pointers, once `keep_seconds` old; returns how many folders (small tables: versions) went."""
        if not (pointers := self.pointers(name)):
            return 0
        state, border, gone = self.load(name, pointers[-1]), (time.time() - keep_seconds) * 1000, 0
        named = {*state.get("base", {}).values(), *[d["path"] for d in state.get("deltas", [])]}
        for status in self._fs.listStatus(self._path(f"{self.base}/{name}")):
            own = status.getPath().getName()
            old = own.startswith("at-") and own < pointers[-1] or own.startswith("next-") or own.startswith(("v-", "d-")) and own not in named
            if old and status.getModificationTime() <= border:
                self._fs.delete(status.getPath(), True)
                gone += own.startswith("at-") if "small" in state else own.startswith(("v-", "d-"))
        return gone


def wanted_buckets(rows: int) -> int:
    """A power of two, so that few different numbers ever occur."""
    return min(MOST_BUCKETS, 1 << max(0, rows // BUCKET_ROWS).bit_length())


def bucket_of(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") if buckets > 1 else F.lit(0)


def shaped(table: DataFrame, empty: DataFrame) -> DataFrame:
    """The columns of `empty`, cast; those that `table` lacks are null."""
    return table.select(*[(F.col(f.name) if f.name in table.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema])
