"""Moves and deletes files by a plan, on executors, through a Python data source that is written to.

`write` works through a task's rows where it runs. Every row has two lines in the task attempt's own log: an intent, written through to the
disk before a file is touched, and what came of it. A second attempt of the task, on whatever executor, reads the logs of those before it and
goes on where they ended; files are claimed by a link or an exclusive name, so nothing is ever overwritten, by other tasks neither.
`commit` names the logs that count. The journal is made of these logs, by Spark; a process that dies in between leaves them, and the next
that opens the catalog records what they say.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import shutil
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidemill.functions.constants import TEMP_SUFFIX
from tidemill.functions.names import suffixed_name

#: Rows of a plan. `src_os` is the name on the disk where it differs, `purge` marks files to delete.
PLAN = "nth long, op_id string, action string, file_id long, item_id long, src_root string, src_rel string, src_os string, dst_root string, dst_rel string, origin_after string, category string, size long, undoes long, purge boolean"
DONE = PLAN + ", to_rel string, method string, conflict boolean, error string"
LINES = DONE + ", stage string"


def free_path(path: str) -> Iterator[str]:
    """`path` and its numbered neighbours, from ~2, that don't exist."""
    folder, name = os.path.split(path)
    n = 1
    while True:
        own = os.path.join(folder, suffixed_name(name, n))
        if not os.path.lexists(own):
            yield own
        n += 1


def digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def claim(source: str, target: str) -> None:
    """Gives a file a name that must be free, on one volume. Raises FileExistsError if it isn't, whoever took it."""
    try:
        os.link(source, target)
        os.unlink(source)
    except FileExistsError:
        raise
    except OSError:  # a file system without links
        os.close(os.open(target, os.O_CREAT | os.O_EXCL))
        os.replace(source, target)


def move_file(source: str, target: str, *, dry_run: bool = True, intent: Callable[[str], None] = lambda target: None) -> tuple[str, str]:
    """The path that the file gets and how: rename, or copy, compare and delete between volumes. Nothing is ever overwritten.

    `intent` is told the path before anything is touched.
    """
    if dry_run:
        return next(free_path(target)), "dry_run"
    for own in free_path(target):
        intent(own)
        os.makedirs(os.path.dirname(own), exist_ok=True)
        try:
            if os.stat(source).st_dev == os.stat(os.path.dirname(own)).st_dev:
                claim(source, own)
                return own, "rename"
            part = own + TEMP_SUFFIX
            shutil.copy2(source, part)
            if digest(source) != digest(part):
                os.unlink(part)
                raise OSError(f"the copy of {source} differs")
            claim(part, own)
            os.unlink(source)
            return own, "copy"
        except FileExistsError:  # taken since it was seen to be free
            continue
    raise OSError(f"no free name for {target}")


def settled(source: str, target: str) -> bool:
    """Whether an intended move was made; what a process left half done is finished or taken back."""
    if os.path.exists(target + TEMP_SUFFIX):
        os.unlink(target + TEMP_SUFFIX)
    if not os.path.lexists(target):
        return False
    if not os.path.lexists(source):
        return True
    if os.path.samefile(source, target):  # linked, the old name still there
        os.unlink(source)
        return True
    if os.path.getsize(target) == os.path.getsize(source) and os.stat(source).st_dev != os.stat(target).st_dev and digest(source) == digest(target):
        os.unlink(source)  # copied to another volume and compared
        return True
    if os.path.getsize(target) == 0 and os.path.getsize(source):  # a name claimed for it
        os.unlink(target)
    return False


class Log:
    """A task attempt's log; the lines of the attempts before it are known."""

    def __init__(self, folder: str, name: str):
        os.makedirs(folder, exist_ok=True)
        self.before: dict[tuple, dict] = {}
        for path in sorted(glob.glob(os.path.join(folder, "*.jsonl"))):
            with open(path, encoding="utf-8") as f:
                for line in f:
                    try:
                        row = json.loads(line)
                    except ValueError:  # the last line, cut off
                        continue
                    if self.before.get(self.key(row), {}).get("stage") != "done":
                        self.before[self.key(row)] = row
        self.path = os.path.join(folder, name)
        self.file = open(self.path, "a", encoding="utf-8")

    @staticmethod
    def key(row: dict) -> tuple:
        return row["op_id"], row["file_id"], row.get("undoes")

    def put(self, row: dict, *, sure: bool = False) -> None:
        self.file.write(json.dumps(row) + "\n")
        if sure:
            self.file.flush()
            os.fsync(self.file.fileno())

    def close(self) -> None:
        self.file.flush()
        os.fsync(self.file.fileno())
        self.file.close()


def carry_out(moves: Iterable[dict], roots: dict[str, str], *, dry_run: bool = True, log: str | None = None, name: str = "driver.jsonl") -> Iterator[dict]:
    """Each move with to_rel, method, conflict or error; a failed file doesn't stop the others.

    A file that is where it should be already is left out. `log` is the folder of the logs of this share of the plan.
    """
    kept = Log(log, name) if log and not dry_run else None
    try:
        for move in moves:
            if not move.get("purge") and (move["src_root"], move["src_rel"]) == (move["dst_root"], move["dst_rel"]):
                continue
            earlier = kept.before.get(Log.key(move)) if kept else None
            done = earlier if earlier and earlier["stage"] == "done" else one(move, roots, dry_run, kept, earlier)
            if kept:
                kept.put(done | {"stage": "done"})
            yield done
    finally:
        if kept:
            kept.close()


def one(move: dict, roots: dict[str, str], dry_run: bool, log: Log | None, earlier: dict | None) -> dict:
    source = os.path.join(roots[move["src_root"]], move.get("src_os") or move["src_rel"])
    out = move | {"to_rel": None, "method": None, "conflict": False, "error": None}

    def intent(target: str | None) -> None:
        if log:
            log.put(move | {"to_rel": target and os.path.relpath(target, roots[move["dst_root"]]), "stage": "intent"}, sure=True)

    try:
        if move.get("purge"):
            intent(None)
            if not dry_run and not (earlier and not os.path.lexists(source)):
                os.unlink(source)
            return out | {"method": "delete"}
        base = roots[move["dst_root"]]
        wanted = os.path.join(base, move["dst_rel"])
        if earlier and settled(source, os.path.join(base, earlier["to_rel"])):
            return out | {"to_rel": earlier["to_rel"], "method": "recovered", "conflict": earlier["to_rel"] != move["dst_rel"]}
        got, method = move_file(source, wanted, dry_run=dry_run, intent=intent)
        return out | {"to_rel": os.path.relpath(got, base), "method": method, "conflict": got != wanted}
    except OSError as error:
        return out | {"error": str(error)[:2000]}


@dataclass
class Attempt(WriterCommitMessage):
    """The log of a task whose rows count."""

    path: str


class MoveWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.log = options["path"]
        self.roots = json.loads(options["roots"])

    def write(self, iterator: Iterator) -> Attempt:
        task = TaskContext.get()
        folder, name = os.path.join(self.log, f"part-{task.partitionId():06d}"), f"attempt-{task.taskAttemptId()}.jsonl"
        for _ in carry_out((row.asDict() for row in iterator), self.roots, dry_run=False, log=folder, name=name):
            pass
        return Attempt(os.path.join(folder, name))

    def commit(self, messages: list[Attempt | None]) -> None:
        """Names the logs that count; a plan without rows has none."""
        os.makedirs(self.log, exist_ok=True)
        with open(os.path.join(self.log, "committed.next"), "w", encoding="utf-8") as f:
            f.writelines(m.path + "\n" for m in messages if m is not None)
        os.replace(os.path.join(self.log, "committed.next"), os.path.join(self.log, "committed"))

    def abort(self, messages: list[Attempt | None]) -> None:
        """The logs stay: what was moved is recorded from them."""


class MoveTarget(DataSource):
    """`plan.write.format("tidemill_moves").option("roots", json).mode("append").save(log folder)`."""

    @classmethod
    def name(cls) -> str:
        return "tidemill_moves"

    def writer(self, schema: object, overwrite: bool) -> MoveWriter:
        return MoveWriter(self.options)


def perform(plan: DataFrame, roots: dict[str, str], log: str) -> None:
    """Carries `plan` (PLAN) out on executors; what came of it is in the logs under `log`."""
    plan.sparkSession.dataSource.register(MoveTarget)
    plan.write.format("tidemill_moves").option("roots", json.dumps(roots)).mode("append").save(log)


def outcomes(spark: SparkSession, log: str, roots: dict[str, str]) -> DataFrame:
    """DONE, one row for each file of the logs under `log` that was moved, deleted or failed; intents without an end are looked into on executors."""
    lines = spark.read.schema(LINES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(f"file://{log}").filter(F.col("file_id").isNotNull())
    key = ("op_id", "file_id", "undoes")
    # the end of a row counts before its intents, its last intent before others: what was intended first and given up is still free
    last = F.max_by(F.struct(*[c for c in lines.columns if c not in key]), F.struct(F.col("stage") == "done", F.col("to_rel").isNotNull() & F.col("error").isNull(), F.length("to_rel"), "to_rel"))
    rows = lines.groupBy(*key).agg(last.alias("_row"))
    rows = rows.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in lines.columns])
    ended, open_rows = rows.filter("stage = 'done'").drop("stage"), rows.filter("stage = 'intent'").drop("stage")
    names = [part.split(" ")[0] for part in DONE.split(", ")]
    kinds = spark.createDataFrame([], DONE).schema

    def looked_into(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                source = os.path.join(roots[row["src_root"]], row["src_os"] or row["src_rel"])
                if row["purge"]:
                    made = not os.path.lexists(source)
                else:
                    made = settled(source, os.path.join(roots[row["dst_root"]], row["to_rel"]))
                if made:
                    out.append(row | {"method": "recovered", "conflict": row["to_rel"] not in (None, row["dst_rel"]), "error": None})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return ended.select(*names).unionByName(open_rows.select(*names).mapInArrow(looked_into, kinds))


def remove_empty_dirs(folders: DataFrame, root: str) -> None:
    """Removes the folders (dir_path) under `root` that are empty, and then those above them; each top folder's are one task's."""
    parts = F.split("dir_path", "/")
    every = folders.filter("dir_path <> ''").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("path")).distinct()
    dealt = every.withColumn("depth", F.size(F.split("path", "/"))).repartition(F.split("path", "/")[0]).sortWithinPartitions(F.col("depth").desc())

    def removed(rows: Iterator) -> None:
        for row in rows:
            path = os.path.join(root, row["path"])
            if os.path.isdir(path) and not os.listdir(path):
                os.rmdir(path)

    dealt.foreachPartition(removed)
