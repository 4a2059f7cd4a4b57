"""The report over candidates and files: category totals, examples, stats, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import constants as C
from tidemill.functions import display, names


def item_sizes(files: DataFrame, item: str = "item_id", size: str = "size") -> DataFrame:
    return files.groupBy(item).agg(F.sum(size).alias("item_bytes"))


def root_stats(files: DataFrame, root: str = "root", size: Column | None = None) -> DataFrame:
    size = F.col("size") if size is None else size
    return files.groupBy(root).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def live_and_edited(files: DataFrame) -> DataFrame:
    """One row: count and bytes of live videos and of edited versions among `files`."""

    def both(condition: Column, name: str) -> list[Column]:
        return [F.count_if(condition).alias(f"{name}_count"), F.coalesce(F.sum(F.when(condition, F.col("size"))), F.lit(0)).alias(f"{name}_bytes")]

    live = F.coalesce(F.col("companion_role") == "live_video", F.lit(False))
    return files.agg(*both(live, "live"), *both(F.col("edited_of").isNotNull(), "edited"))


def category_counts(candidates: DataFrame) -> DataFrame:
    """category, n of those that aren't keepers."""
    return candidates.filter(~F.col("is_keeper")).groupBy("category").agg(F.count("*").alias("n"))


def top_folder_stats(files: DataFrame, path: Column, size: Column) -> DataFrame:
    """Files and bytes by the first component of a path, '' for files in none."""
    return files.groupBy(names.top_folder(path).alias("category")).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def category_dimension(spark: SparkSession, enabled: dict[str, bool] | None = None) -> DataFrame:
    rows = [(n, c, k, (enabled or {}).get(c, True)) for n, (c, k) in enumerate(C.CATEGORIES.items())]
    return spark.createDataFrame(rows, "nth int, category string, confidence string, enabled boolean")


def category_report(dimension: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per category of the dimension: non-keepers, their bytes, groups (keepers included). Categories without candidates are zero rows.

    `candidates`: category, group_id, is_keeper, bytes (of the item for primaries, its own for companions).
    """
    counted = candidates.groupBy("category").agg(F.count_if(~F.col("is_keeper")).alias("n"), F.sum(F.when(~F.col("is_keeper"), F.col("bytes")).otherwise(0)).alias("bytes"), F.count_distinct(F.nullif("group_id", F.lit(""))).alias("groups"))
    zero = F.lit(0).cast("long")
    return dimension.join(counted, "category", "left").select(*dimension.columns, F.coalesce("n", zero).alias("n"), F.coalesce("bytes", zero).alias("bytes"), F.coalesce("groups", zero).alias("groups"))


def report_totals(report: DataFrame) -> DataFrame:
    on = F.when(F.col("enabled"), F.col("n")).otherwise(0)
    size = F.when(F.col("enabled"), F.col("bytes")).otherwise(0)
    return report.agg(F.sum(on).alias("candidates"), F.sum(size).alias("bytes"), F.sum("n").alias("all_candidates"), F.sum("bytes").alias("all_bytes"))


def first_examples(candidates: DataFrame, n: int, *, partition: str = "category", order: list[Column]) -> DataFrame:
    """The first `n` rows of each partition, with their rank. Spark limits groups before the shuffle."""
    w = Window.partitionBy(partition).orderBy(*order)
    return candidates.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


def large_videos(files: DataFrame, n: int = 100, meta: DataFrame | None = None, *, on: str = "id") -> DataFrame:
    """The `n` largest rows (id, size, codec) with what HEVC would save; ties by id.

    Where codecs are in another table, `meta` (`on`, codec and more), it is joined to the n rows, not to all.
    """
    top = files.orderBy(F.col("size").desc(), "id").limit(n)
    top = top if meta is None else top.join(meta, on, "left")
    return top.withColumn("saving", display.hevc_saving(F.col("size"), F.col("codec")))


def candidate_rows(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Unapplied candidates of present source files with their bytes, as the report counts them."""
    sizes = item_sizes(files.filter((F.col("root") == "source") & (F.col("status") == "present"))).withColumnRenamed("item_id", "_item")
    own = candidates.join(files.select(F.col("id").alias("file_id"), "root", "status", "item_id", F.col("rel_path").alias("path"), "size"), "file_id").filter((F.col("root") == "source") & (F.col("status") == "present"))
    placed = own.join(sizes, F.col("item_id") == F.col("_item"), "left")
    size = F.when(F.col("item_id") != F.col("file_id"), F.col("size")).otherwise(F.coalesce("item_bytes", "size"))
    return placed.withColumn("bytes", size).drop("_item", "item_bytes")


def quantiles(rows: DataFrame, key: str, value: str, shares: dict[str, float], *, buckets: int = 1024) -> DataFrame:
    """key and a column for each share: exact quantiles with linear interpolation, as `percentile` gives them.

    A histogram of each key's range finds the buckets in which the wanted ranks lie; only their rows are ordered, so no task holds a
    key's values. Nulls don't count.
    """
    known = rows.filter(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"))
    spread = known.groupBy("_k").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / buckets
    bucket = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int")
    placed = known.withColumnRenamed("_k", "_own").join(spread, F.col("_own").eqNullSafe(F.col("_k"))).drop("_own")
    placed = placed.withColumn("_bucket", bucket)
    counts = placed.groupBy("_k", "_bucket").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    order = Window.partitionBy("_k").orderBy("_bucket")
    counts = counts.withColumn("_before", F.sum("_c").over(order) - F.col("_c"))
    ranks = F.array(*[F.lit(float(s)) * (F.col("_n") - 1) for s in shares.values()])
    wanted = F.exists(ranks, lambda r: (F.floor(r) < F.col("_before") + F.col("_c")) & (F.ceil(r) >= F.col("_before")))
    some = counts.filter(wanted).select(F.col("_k").alias("_key"), F.col("_bucket").alias("_b"), "_before")
    ordered = placed.join(some, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_b")))
    ordered = ordered.withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_k", "_bucket").orderBy("_v")) - 1)
    out = []
    for name, share in shares.items():
        rank = F.lit(float(share)) * (F.col("_n") - 1)
        low = F.max(F.when(F.col("_r") == F.floor(rank), F.col("_v")))
        high = F.max(F.when(F.col("_r") == F.ceil(rank), F.col("_v")))
        part = F.first(rank - F.floor(rank))
        out.append((low + (high - low) * part).alias(name))
    return ordered.groupBy(F.col("_k").alias(key)).agg(*out)


def lru_evictions(entries: DataFrame, limit: int, *, hysteresis: float = 0.05, most: int = 5000) -> DataFrame:
    """key, bytes of the least recently used entries to drop so that bytes fall to the limit less the hysteresis.

    The running sum is taken over buckets of access time first, so that only the bucket in which it ends is ordered row by row.
    """
    spread = entries.agg(F.sum("bytes").alias("total"), F.min("last_access").alias("lo"), F.max("last_access").alias("hi"))
    goal = F.when(F.col("total") > limit, F.col("total") - int(limit * (1 - hysteresis))).otherwise(0)
    facts = spread.select("lo", "hi", goal.alias("goal")).first()
    if not facts["goal"]:
        return entries.select("key", "bytes").limit(0)
    width = max((facts["hi"] - facts["lo"]) / 1000, 1e-9)
    placed = entries.withColumn("_bucket", F.floor((F.col("last_access") - facts["lo"]) / width))
    buckets = placed.groupBy("_bucket").agg(F.sum("bytes").alias("_sum"))
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    needed = placed.join(buckets.filter(F.col("_before") < facts["goal"]).select("_bucket", "_before"), "_bucket")
    running = F.sum("bytes").over(Window.partitionBy("_bucket").orderBy("last_access", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = needed.withColumn("_reached", F.col("_before") + running - F.col("bytes")).filter(F.col("_reached") < facts["goal"])
    return chosen.orderBy("last_access", "key").limit(most).select("key", "bytes")
