"""Exact duplicates by a funnel: size, digest of both ends, digest of all, keeper.

Each step keeps only rows whose key so far occurs at least twice. Keys are counted by partial aggregation and joined back, so that
a size shared by a third of all files is one aggregate row rather than one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import constants as C
from tidemill.functions import hashing, names
from tidemill.operators.numbering import numbered
from tidemill.session import cut


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """The rows whose `keys` occur at least twice. Null keys never do."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).drop("_n")
    return df.join(counts, list(keys), "left_semi")


def digested(files: DataFrame, content: Column | None = None) -> DataFrame:
    """`files` (id, size and content) without content, with partial_hash and full_hash; empty files take no part.

    Digests are taken where the rows are, once, and written: content goes no further, and what counts on them reads ids, sizes and digests.
    """
    content = F.col("content") if content is None else content
    rest = [c for c in files.columns if c != "content"]
    return cut(files.filter(F.col("size") > 0).select(*rest, hashing.partial_hash(content).alias("partial_hash"), hashing.full_hash(content).alias("full_hash")), "digests")


def funnel(files: DataFrame, content: Column | None = None) -> DataFrame:
    """The rows of `files` (id, size and content, or those of `digested`) that have an exact copy, with partial_hash and full_hash."""
    hashed = files if "full_hash" in files.columns else digested(files, content)
    return repeated(partially_equal(hashed), "full_hash")


def partially_equal(hashed: DataFrame) -> DataFrame:
    """The rows (size, partial_hash) whose size and digest of both ends occur at least twice."""
    return repeated(hashed, "size", "partial_hash")


def keeper_order(stem: Column, ts: Column, path: Column, id: Column) -> list[Column]:
    """Plainest name, earliest capture (0 counts as none), shortest path, shallowest, smallest id."""
    when = F.when(ts.isNull() | (ts == 0), F.lit(C.NO_TIME)).otherwise(ts)
    depth = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return [names.name_penalty(stem), when, F.length(path), depth, id]


def duplicate_groups(rows: DataFrame, run_id: int = 1) -> DataFrame:
    """id, group_id, keeper_id, keeper_path, is_keeper of rows id, full_hash, stem, ts, path that share a digest.

    Groups are numbered by their smallest id: `d<run>-<n>`.
    """
    # read three times: written, so that what led here runs once
    shared = cut(repeated(rows.filter(F.col("full_hash").isNotNull()), "full_hash"), "copies")
    best = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(keeper_order(F.col("stem"), F.col("ts"), F.col("path"), F.col("id")))], F.col("path").alias("path"))
    groups = shared.groupBy("full_hash").agg(F.min(best).alias("_best"), F.min("id").alias("_first"))
    # one row a group: numbering orders groups, never their members
    named = numbered(groups, "_first").withColumn("group_id", F.concat(F.lit(f"d{run_id}-"), F.col("nth").cast("string")))
    placed = shared.select("id", "full_hash").join(named, "full_hash")
    return placed.select("id", "group_id", F.col("_best.k4").alias("keeper_id"), F.col("_best.path").alias("keeper_path"), (F.col("id") == F.col("_best.k4")).alias("is_keeper"))
