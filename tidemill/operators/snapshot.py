"""Snapshot diffs and the feature cache: what a rescan changes, and what is still valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import names
from tidemill.functions.dates import same_mtime


def changed(size: Column, new_size: Column, mtime: Column, new_mtime: Column, status: Column) -> Column:
    """Size, mtime to the second, or a status other than present."""
    return (size != new_size) | ~same_mtime(mtime, new_mtime) | (status != "present")


def spared(folder: Column, failed_dirs: tuple[str, ...]) -> Column:
    """Whether a folder is, or lies in, one that could not be listed."""
    out = F.lit(False)
    for failed in failed_dirs:
        out = out | (folder == failed) | folder.startswith(failed + "/")
    return out


def snapshot_diff(old: DataFrame, new: DataFrame, *, keys: tuple[str, ...] = ("root", "rel_path"), failed_dirs: tuple[str, ...] = ()) -> DataFrame:
    """keys, change (new, changed, unchanged, missing, kept), size, mtime_ns, status after the scan.

    Rows gone from a folder that could not be listed are kept. An unchanged row keeps its old mtime, so that what was derived from it stays valid.
    """
    a = old.select(*keys, F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"), F.col("status").alias("_status"))
    b = new.select(*keys, "size", "mtime_ns", F.lit(True).alias("_seen"))
    both = a.join(b, list(keys), "full_outer")
    folder = F.when(F.instr(keys[-1], "/") > 0, F.regexp_replace(keys[-1], "/[^/]*$", "")).otherwise("")
    gone = F.col("_seen").isNull()
    change = (
        F.when(gone & ((F.col("_status") != "present") | spared(folder, failed_dirs)), "kept")
        .when(gone, "missing")
        .when(F.col("_status").isNull(), "new")
        .when(changed(F.col("_size"), F.col("size"), F.col("_mtime"), F.col("mtime_ns"), F.col("_status")), "changed")
        .otherwise("unchanged")
    )
    status = F.when(gone & (F.col("change") == "missing"), "missing").when(gone, F.col("_status")).otherwise("present")
    keep_old = gone | (F.col("change") == "unchanged")
    out = both.withColumn("change", change).withColumn("status", status)
    return out.select(*keys, "change", F.when(keep_old, F.col("_size")).otherwise(F.col("size")).alias("size"), F.when(keep_old, F.col("_mtime")).otherwise(F.col("mtime_ns")).alias("mtime_ns"), "status")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """All rows of `new` and those of `old` whose keys it lacks: insert or replace."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def merge_features(old: DataFrame, new: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Partial upsert of features by file_id: a version (size, mtime_ns) other than the stored one wipes all that isn't supplied."""
    a = old.select("file_id", *[F.col(c).alias(f"_{c}") for c in ("size", "mtime_ns", *features)])
    both = a.join(new, "file_id", "full_outer")
    same = (F.col("_size") == F.col("size")) & (F.col("_mtime_ns") == F.col("mtime_ns"))
    untouched = F.col("size").isNull()
    kept = [F.when(untouched, F.col(f"_{c}")).when(F.coalesce(same, F.lit(False)), F.coalesce(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)).alias(c) for c in features]
    return both.select("file_id", F.coalesce("size", "_size").alias("size"), F.coalesce("mtime_ns", "_mtime_ns").alias("mtime_ns"), *kept)


def needing_features(files: DataFrame, features: DataFrame) -> DataFrame:
    """Files whose features are absent or of another version, compared to the nanosecond."""
    own = features.select(F.col("file_id").alias("_id"), F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"))
    both = files.join(own, F.col("id") == F.col("_id"), "left")
    stale = F.col("_id").isNull() | (F.col("_size") != F.col("size")) | (F.col("_mtime") != F.col("mtime_ns"))
    return both.filter(stale).drop("_id", "_size", "_mtime")


def latest(df: DataFrame, *keys: str, by: str) -> DataFrame:
    """The row of greatest `by` for each key, by aggregation rather than a sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def wide_rows(files: DataFrame, meta: DataFrame, analysis: DataFrame) -> DataFrame:
    """Files with metadata of the same version and analysis flagged a_valid if it is."""
    version = {"size": "_size", "mtime_ns": "_mtime"}
    m = meta.withColumnsRenamed({"file_id": "_id", **version})
    with_meta = files.join(m, (F.col("id") == F.col("_id")) & (F.col("size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_mtime")), "left").drop("_id", "_size", "_mtime")
    a = analysis.withColumnsRenamed({"file_id": "_id", **version})
    both = with_meta.join(a, F.col("id") == F.col("_id"), "left")
    return both.withColumn("a_valid", F.coalesce((F.col("_size") == F.col("size")) & (F.col("_mtime") == F.col("mtime_ns")), F.lit(False))).drop("_id", "_size", "_mtime")


def replace_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Applied candidates of any run and all of the new run."""
    return old.filter(F.col("applied_op").isNotNull()).unionByName(new, allowMissingColumns=True)


def relocated(files: DataFrame, moves: DataFrame) -> DataFrame:
    """`files` after `moves` (id in the order of moving, file_id, from_rel, to_root, to_rel): names and folders follow the new path.

    A file that moves several times is where the last move put it. One that leaves the source remembers where it was; one that comes back forgets it.
    """
    last = F.max_by(F.struct("to_root", "to_rel"), "id").alias("_to")
    moved = moves.groupBy("file_id").agg(last, F.min_by("from_rel", "id").alias("_from"))
    moved = moved.select(F.col("file_id").alias("id"), F.col("_to.to_root").alias("_root"), F.col("_to.to_rel").alias("_rel"), "_from")
    both, here = files.join(moved, "id", "left"), F.col("_root").isNotNull()
    origin = F.when(here & (F.col("_root") == "source"), F.lit(None)).when(here & (F.col("root") == "source"), F.col("_from")).otherwise(F.col("origin_rel_path"))
    both = both.withColumn("origin_rel_path", origin).withColumn("root", F.coalesce("_root", "root")).withColumn("rel_path", F.coalesce("_rel", "rel_path"))
    name = names.basename(F.col("rel_path"))
    both = both.withColumn("name", F.when(here, name).otherwise(F.col("name"))).withColumn("dir_path", F.when(here, names.dirname(F.col("rel_path"))).otherwise(F.col("dir_path")))
    both = both.withColumn("stem", F.when(here, names.stem(name)).otherwise(F.col("stem"))).withColumn("ext", F.when(here, names.ext(name)).otherwise(F.col("ext")))
    return both.withColumn("rel_path_os", F.when(here, F.lit(None)).otherwise(F.col("rel_path_os"))).drop("_root", "_rel", "_from")


def reviewed(files: DataFrame, items: DataFrame, at: str | None) -> DataFrame:
    """`files` with reviewed_at set to `at`, or cleared, for all files of `items` (item_id)."""
    mine = items.select("item_id").distinct().withColumn("_mine", F.lit(True))
    both = files.join(mine, "item_id", "left")
    return both.withColumn("reviewed_at", F.when(F.col("_mine"), F.lit(at).cast("string")).otherwise(F.col("reviewed_at"))).drop("_mine")


def append_with_ids(table: DataFrame, rows: DataFrame, order: list[Column], id: str = "id") -> DataFrame:
    """`rows` with ids that follow the table's greatest one, in the given order. The rows are one action's, not the table."""
    start = table.agg(F.coalesce(F.max(id), F.lit(0)).alias("m")).scalar()
    return rows.withColumn(id, F.row_number().over(Window.orderBy(*order)) + start)
