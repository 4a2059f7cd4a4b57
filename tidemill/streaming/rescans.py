"""Rescans of a tree as a stream: every batch is a generation, with its diff to the one before.

A generation is the stream's offset. Its folders are planned once and its listing is written once, part by part, under a state folder that
all executors share, before a row of it is handed on; a batch that is done again after a failure reads what was listed the first time, so
that each generation counts exactly once and with the diff that it had, however the tree has changed since. A part is a set of folders: the
tree is opened level by level until there are `PARTS` folders, and tasks walk down from them.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from tidemill.operators.snapshot import snapshot_diff
from tidemill.sources.tree import Walk

LISTING = "generation long, root string, rel_path string, size long, mtime_ns long, error string"
#: Parts of a generation's walk, and generations whose listings stay.
PARTS = 64
KEPT = 3


class Part(InputPartition):
    def __init__(self, generation: int, number: int, folders: list[tuple[str, bool]]):
        super().__init__(number)
        self.generation, self.number, self.folders = generation, number, folders


def written(path: str, text: str) -> None:
    """Writes a file under another name and renames it; what is there already stays."""
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(beside, path)
    except FileExistsError:
        pass
    os.unlink(beside)


class RescanReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.base, self.root, self.state = os.path.abspath(options["path"]), options.get("root", "source"), options["state"]
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        self.skip = tuple(x for x in options.get("skip", "").split(os.pathsep) if x)
        self.parts = int(options.get("parts", PARTS))

    def folder(self, generation: int) -> str:
        return os.path.join(self.state, f"generation-{generation:09d}")

    def initialOffset(self) -> dict:
        return {"generation": 0}

    def latestOffset(self) -> dict:
        """Every trigger is a new generation, planned here."""
        os.makedirs(self.state, exist_ok=True)
        last = max((int(m[1]) for m in (re.fullmatch(r"generation-(\d+)", n) for n in os.listdir(self.state)) if m), default=0)
        self.plan(last + 1)
        return {"generation": last + 1}

    def plan(self, generation: int) -> list[list[tuple[str, bool]]]:
        """The parts of a generation, each a list of (folder, whether to go down from it), written once."""
        path = os.path.join(self.folder(generation), "plan.json")
        if not os.path.exists(path):
            os.makedirs(self.folder(generation), exist_ok=True)
            walk, flat, deep = Walk(self.base, skip=self.skip), [self.base], []
            if self.recursive:
                deep = list(self.inside(walk, self.base))
                while deep and len(deep) < self.parts:
                    opened = [(f, list(self.inside(walk, f))) for f in deep]
                    if not any(own for _, own in opened):
                        break
                    flat += [f for f, _ in opened]
                    deep = [x for _, own in opened for x in own]
            every = [(f, False) for f in flat] + [(f, True) for f in deep]
            written(path, json.dumps([every[k :: self.parts] for k in range(min(self.parts, len(every)))]))
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    @staticmethod
    def inside(walk: Walk, folder: str) -> Iterator[str]:
        from tidemill.sources.tree import excluded

        try:
            for entry in sorted(os.scandir(folder), key=lambda e: e.name):
                if entry.is_dir(follow_symlinks=False) and not excluded(entry.name) and entry.path not in walk.skipped:
                    yield entry.path
        except OSError:  # its own listing says so
            return

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if start["generation"] == end["generation"]:
            return []
        generation = end["generation"]
        return [Part(generation, k, [tuple(f) for f in folders]) for k, folders in enumerate(self.plan(generation))]

    def read(self, partition: Part) -> Iterator[tuple]:
        path = os.path.join(self.folder(partition.generation), f"part-{partition.number:06d}.jsonl")
        if not os.path.exists(path):
            lines = []
            for folder, deep in partition.folders:
                walk = Walk(self.base, recursive=deep, skip=self.skip)
                for row in walk.down(self.root, folder, [1 << 62]):
                    lines.append(json.dumps((row[0], row[1], row[4], row[5], row[7])))
            written(path, "".join(line + "\n" for line in lines))
        with open(path, encoding="utf-8") as f:
            for line in f:
                yield partition.generation, *json.loads(line)

    def commit(self, end: dict) -> None:
        """Listings that no batch can ask for any more go."""
        for name in os.listdir(self.state):
            found = re.fullmatch(r"generation-(\d+)", name)
            if found and int(found[1]) <= end["generation"] - KEPT:
                shutil.rmtree(os.path.join(self.state, name), ignore_errors=True)


class Rescans(DataSource):
    """`readStream.format("tidemill_rescans").option("state", folder).load(path)`."""

    @classmethod
    def name(cls) -> str:
        return "tidemill_rescans"

    def schema(self) -> str:
        return LISTING

    def streamReader(self, schema: object) -> RescanReader:
        return RescanReader(self.options)


def rescans(spark: SparkSession, path: str, state: str, **options: str) -> DataFrame:
    """A tree's listings as a stream of LISTING rows."""
    spark.dataSource.register(Rescans)
    return spark.readStream.format("tidemill_rescans").options(state=state, **options).load(path)


def follow_tree(spark: SparkSession, path: str, output: str, checkpoint: str, *, interval: str | None = None, **options: str) -> StreamingQuery:
    """Writes the diff of every generation to `output`/diff=<batch> and what is known after it to `output`/state=<batch>.

    Without an interval, one generation is taken and the stream ends; started again, it goes on with the next.
    """

    def compare(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # the batch's rows are read twice: from the listing that is written by now
        failed = tuple(r["rel_path"] for r in batch.filter(F.col("error").isNotNull()).select("rel_path").collect())
        seen = batch.filter(F.col("error").isNull()).select("root", "rel_path", "size", "mtime_ns")
        old = session.read.parquet(f"{output}/state={number - 1}") if number else session.createDataFrame([], "root string, rel_path string, size long, mtime_ns long, status string")
        snapshot_diff(old, seen, failed_dirs=failed).write.mode("overwrite").parquet(f"{output}/diff={number}")
        known = session.read.parquet(f"{output}/diff={number}")
        known.select("root", "rel_path", "size", "mtime_ns", "status").write.mode("overwrite").parquet(f"{output}/state={number}")

    writer = rescans(spark, path, os.path.join(output, "listings"), **options).writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
