"""Lists of items and groups: sorted and filtered pages, group members, counts of live videos, operations of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import names
from tidemill.session import scratch_path

# What a kind filter lets through.
KIND_FILTERS = {"all": ("photo", "raw", "video"), "photo": ("photo", "raw"), "video": ("video",)}


def sort_key(by: str) -> Column:
    """date: capture time, else the second of mtime; name without regard to ASCII case; size."""
    return {"date": F.coalesce("date_taken_ts", F.expr("mtime_ns div 1000000000")), "name": names.nocase(F.col("name")), "size": F.col("size")}[by]


def list_items(files: DataFrame, *, by: str = "date", descending: bool = False, kinds: str = "all", folder: str = "", recursive: bool = True, unreviewed: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Present primaries in order, ties by id in the same direction; `limit` and `offset` cut a page."""
    rows = files.filter((F.col("status") == "present") & (F.col("item_id") == F.col("id")) & F.col("kind").isin(*KIND_FILTERS[kinds]))
    rows = rows.filter(names.in_folder(F.col("dir_path"), folder, recursive))
    rows = rows.filter(F.col("reviewed_at").isNull()) if unreviewed else rows
    order = [sort_key(by), F.col("id")]
    rows = rows.orderBy(*[c.desc_nulls_last() if descending else c.asc_nulls_first() for c in order])
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit is not None else rows


def page_around(rows: DataFrame, index: int, span: int = 120) -> DataFrame:
    """The `span` rows of an ordered list around the one at `index`, which counts from 0; at the list's start the first `span`."""
    return rows.offset(max(0, index - span // 2)).limit(span)


class RankedList:
    """An ordered list, stored by ranges with their numbers of rows: any page is read from its ranges alone.

    Rows are dealt by ranges of the order and written with their range as partition; the table of ranges, one row each, tells at which place of the
    list a range begins.
    """

    def __init__(self, rows: DataFrame, *order: Column, ranges: int | None = None):
        dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
        path = scratch_path(rows.sparkSession, "ranked")
        dealt.sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)
        self.order, self.columns = order, rows.columns
        self.rows = rows.sparkSession.read.schema(f"{rows.schema.toDDL()}, _range int").parquet(path)
        self.starts, place = [], 0
        for row in self.rows.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
            self.starts.append((place, row["_range"]))
            place += row["n"]
        self.size = place

    def page(self, start: int, limit: int) -> DataFrame:
        """The rows at the places from `start`, which counts from 0, in order; `limit` of them at most."""
        start = max(0, start)
        before = [k for k, (place, _) in enumerate(self.starts) if place <= start]
        first = before[-1] if before else 0
        wanted = [r for place, r in self.starts[first:] if place < start + limit]
        skipped = start - self.starts[first][0] if self.starts else 0
        own = self.rows.filter(F.col("_range").isin(wanted)).orderBy(*self.order).select(*self.columns)
        return own.offset(skipped).limit(limit)

    def around(self, index: int, span: int = 120) -> DataFrame:
        """`page_around` from the stored ranges."""
        return self.page(max(0, index - span // 2), span)


def newest(rows: DataFrame, *, limit: int, offset: int = 0, states: tuple[str, ...] = (), **equal: object) -> DataFrame:
    """Rows of greatest id first, of the wanted states and of equal values; None asks for nothing."""
    for column, value in equal.items():
        rows = rows.filter(F.col(column) == value) if value is not None else rows
    rows = rows.filter(F.col("state").isin(*states)) if states else rows
    return rows.orderBy(F.col("id").desc()).offset(offset).limit(limit)


def item_files(files: DataFrame, item_id: int) -> DataFrame:
    """An item's files, the primary first, then by path."""
    return files.filter(F.col("item_id") == item_id).orderBy((F.col("id") == F.col("item_id")).desc(), "rel_path")


def live_counts(items: DataFrame, companions: DataFrame, item: str = "item_id") -> DataFrame:
    """`items` with live_count, the number of their `companions`; 0 without any."""
    counted = companions.groupBy(F.col(item).alias("_item")).agg(F.count("*").alias("_n"))
    return items.join(counted, F.col(item) == F.col("_item"), "left").withColumn("live_count", F.coalesce("_n", F.lit(0).cast("long"))).drop("_item", "_n")


def group_members(candidates: DataFrame, files: DataFrame, group_id: str) -> DataFrame:
    """A group's candidates with their files, the keeper first, then by path."""
    own = candidates.filter(F.col("group_id") == group_id).join(files.select(F.col("id").alias("file_id"), "rel_path", "size"), "file_id")
    return own.orderBy(F.col("is_keeper").desc(), "rel_path", "file_id")


def group_ops(journal: DataFrame, candidates: DataFrame) -> DataFrame:
    """group_id, op_id of the operations that touched a group's files, each once."""
    own = candidates.filter(F.col("group_id").isNotNull()).select("group_id", "file_id")
    return journal.select("op_id", "file_id").join(own, "file_id").select("group_id", "op_id").distinct()


def groups_of(rows: DataFrame, key: str, id: str, least: int = 2) -> DataFrame:
    """key, n, first_id of the keys that at least `least` rows share."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(id).alias("first_id")).filter(F.col("n") >= least)
