"""A file tree as a DataFrame, walked from a frontier.

Spark's own file listing leaves out names that start with a dot or an underscore, which an inventory must see. Folders are rows: each round deals
the folders of the frontier out to tasks by count, a task walks down from its folders, and once it has met `BUDGET` entries, what is left
of its way comes back as rows and is the next round's frontier. So a tree with one top folder is listed by all tasks from the
second round on, a small tree in one round, and no round holds more in a task than a folder's own entries. Files are never opened. Folders that cannot
be listed come back as rows with `error`, and protect what they held from being taken for missing.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import names
from tidemill.functions.constants import EXCLUDED_DIRS, EXCLUDED_SUFFIXES, TEMP_SUFFIX
from tidemill.session import cut

LISTING = "root string, rel_path string, rel_path_os string, name string, size long, mtime_ns long, path string, error string, folder boolean, task int"
# File systems that are on a network.
NETWORK_KINDS = {"nfs", "nfs4", "cifs", "smb3", "smbfs", "afpfs", "fuse.sshfs", "fuse.rclone", "9p", "ceph", "glusterfs", "lustre"}
#: Entries that a task meets before it hands folders back; few in the first round, whose frontier is the roots.
BUDGET = 50_000
FIRST_BUDGET = 2_000


def excluded(name: str) -> bool:
    return name in EXCLUDED_DIRS or name.lower().endswith(EXCLUDED_SUFFIXES)


class Walk:
    """How a root is walked: its path, whether into folders, and which folders are left out."""

    def __init__(self, base: str, *, recursive: bool = True, skip: tuple[str, ...] = ()):
        self.base, self.recursive, self.skipped = os.path.abspath(base), recursive, {os.path.abspath(x) for x in skip}

    def down(self, root: str, folder: str, budget: list[int]) -> Iterator[tuple]:
        """Rows of `LISTING` under a folder; those of folders not gone into once the budget is used up."""
        waiting = [folder]
        while waiting:
            folder = waiting.pop()
            if budget[0] <= 0:
                yield root, None, None, None, None, None, folder, None, True
                continue
            try:
                with os.scandir(folder) as listing:
                    entries = list(listing)
            except OSError as error:
                rel = os.path.relpath(folder, self.base)
                yield root, unicodedata.normalize("NFC", "" if rel == "." else rel), None, None, None, None, folder, str(error)[:2000], False
                continue
            budget[0] -= len(entries) + 1
            inside = "" if folder == self.base else os.path.relpath(folder, self.base) + "/"
            for entry in entries:
                if entry.is_symlink():
                    continue
                if entry.is_dir(follow_symlinks=False):
                    if self.recursive and not excluded(entry.name) and entry.path not in self.skipped:
                        waiting.append(entry.path)
                elif entry.is_file(follow_symlinks=False) and not entry.name.endswith(TEMP_SUFFIX):
                    try:
                        stat = entry.stat(follow_symlinks=False)
                    except FileNotFoundError:  # gone since the folder was read
                        continue
                    rel = inside + entry.name
                    plain = rel if rel.isascii() else unicodedata.normalize("NFC", rel)
                    yield root, plain, rel if rel != plain else None, plain[plain.rfind("/") + 1 :], stat.st_size, stat.st_mtime_ns, entry.path, None, False


def walk(spark: SparkSession, roots: dict[str, Walk], *, tasks: int | None = None, budget: int = BUDGET, first_budget: int = FIRST_BUDGET) -> DataFrame:
    """Rows of `LISTING` of all roots by name, written round by round to the shared folder."""
    tasks = tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kinds = (*(pa.string(),) * 4, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
    columns = [part.split(" ")[0] for part in LISTING.split(", ")]
    frontier = spark.createDataFrame([(name, own.base) for name, own in roots.items()], "root string, path string")
    out, waiting, limit = None, len(roots), first_budget
    while waiting:

        def listed(batches: Iterator[pa.RecordBatch], limit: int = limit) -> Iterator[pa.RecordBatch]:
            task, left = TaskContext.get().partitionId(), [limit]
            for batch in batches:
                for root, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    rows = list(roots[root].down(root, folder, left))
                    parts = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
                    yield pa.RecordBatch.from_arrays([*parts, pa.array([task] * len(rows), pa.int32())], columns)

        seen = Observation()
        round = frontier.repartition(min(tasks, waiting)).mapInArrow(listed, LISTING).observe(seen, F.count_if(F.col("folder")).alias("n"))
        round = cut(round, "listing")
        waiting, limit = seen.get["n"], budget
        frontier = round.filter("folder").select("root", "path")
        files = round.filter("not folder")
        out = files if out is None else out.unionByName(files)
    return out


def list_tree(spark: SparkSession, path: str, *, root: str = "source", recursive: bool = True, skip: list[str] | None = None) -> DataFrame:
    """All files under `path` with names taken apart: dir_path, stem, ext, kind."""
    return named(walk(spark, {root: Walk(path, recursive=recursive, skip=tuple(skip or ()))}))


def named(listed: DataFrame) -> DataFrame:
    parts = listed.drop("folder", "task").withColumn("dir_path", names.dirname(F.col("rel_path"))).withColumn("stem", names.stem(F.col("name"))).withColumn("ext", names.ext(F.col("name")))
    return parts.withColumn("kind", names.kind(F.col("ext")))


def scan_roots(spark: SparkSession, source: str, review: str | None = None, delete: str | None = None, *, recursive: bool = True) -> DataFrame:
    """The three roots in one table. Review and delete folders inside the source are left out of it, and are always walked whole."""
    others = {name: path for name, path in (("review", review), ("delete", delete)) if path}
    roots = {"source": Walk(source, recursive=recursive, skip=tuple(others.values()))}
    return named(walk(spark, roots | {name: Walk(path) for name, path in others.items()}))


def network_volume(path: str, mounts: str = "/proc/self/mounts") -> bool:
    """Whether a path is on a network file system, by the mount it lies under; False where there is no table of mounts."""
    own, best = os.path.realpath(path), ("", "")
    try:
        with open(mounts, encoding="utf-8") as f:
            for line in f:
                _, point, kind, *_ = line.split(" ")
                point = point.replace("\\040", " ")
                if (own == point or own.startswith(point.rstrip("/") + "/")) and len(point) >= len(best[0]):
                    best = point, kind
    except OSError:
        return False
    return best[1] in NETWORK_KINDS


def check_roots(source: str, review: str | None = None, delete: str | None = None) -> tuple[list[str], list[str]]:
    """Errors and warnings about a choice of roots: photo libraries, missing or nested folders, catalogs, other and network volumes."""
    errors, warnings = [], []
    base = os.path.abspath(source)
    if any(part.lower().endswith(".photoslibrary") for part in base.split(os.sep)):
        errors.append("apple_photos_library")
    if not os.path.isdir(base):
        return [*errors, "source_missing"], warnings
    if not os.access(base, os.R_OK):
        errors.append("source_unreadable")
    for name, path in (("review", review), ("delete", delete)):
        if path and os.path.commonpath([os.path.abspath(path), base]) == os.path.abspath(path):
            errors.append(f"{name}_contains_source")
    if review and delete and os.path.abspath(review) == os.path.abspath(delete):
        errors.append("review_equals_delete")
    if any(e.name.lower().endswith(".lrcat") for e in os.scandir(base)):
        warnings.append("lightroom_catalog")
    volumes = {os.stat(p).st_dev for p in (base, review, delete) if p and os.path.isdir(p)}
    if len(volumes) > 1:
        warnings.append("different_volumes")
    if network_volume(base):
        warnings.append("network_volume")
    return errors, warnings
