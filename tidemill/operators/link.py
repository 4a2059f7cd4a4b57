"""Entity resolution of files: live pairs, sidecars, edited versions. Where the order of equals matters, the smallest id wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import constants as C


def best_match(pairs: DataFrame, key: str, value: str, *preference: Column) -> DataFrame:
    """For each `key`, the `value` whose preference sorts first, then the smallest value."""
    order = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(preference)], F.col(value).alias("v"))
    return pairs.groupBy(key).agg(F.min(order).alias("_best")).select(key, F.col("_best.v").alias(value))


def _sides(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.select(*[F.col(c) if c in on else F.col(c).alias(f"l_{c}") for c in left.columns]).join(right.select(*[F.col(c) if c in on else F.col(c).alias(f"r_{c}") for c in right.columns]), on)


def link_items(files: DataFrame) -> DataFrame:
    """id, item_id, companion_role, edited_of of present files (id, root, dir_path, stem, ext, kind, detached_at, content_id, duration_ms)."""
    own = files.select("id", "root", "dir_path", F.lower("stem").alias("key"), "stem", "ext", "kind", F.col("detached_at").isNotNull().alias("detached"), F.nullif(F.col("content_id"), F.lit("")).alias("content_id"), "duration_ms")
    photos = own.filter(F.col("kind").isin("photo", "raw"))
    videos = own.filter((F.col("kind") == "video") & ~F.col("detached"))

    by_id = _sides(videos.filter(F.col("content_id").isNotNull()), photos, ["root", "content_id"])
    elsewhere = F.col("l_dir_path") != F.col("r_dir_path")
    live = best_match(by_id.withColumnsRenamed({"l_id": "id", "r_id": "owner"}), "id", "owner", elsewhere, F.col("l_key") != F.col("r_key"))

    short = F.col("duration_ms").isNull() | (F.col("duration_ms") <= C.LIVE_VIDEO_MS)
    by_stem = _sides(videos.filter(F.col("content_id").isNull() & short), photos.filter(F.col("content_id").isNull()), ["root", "dir_path", "key"])
    live = live.unionByName(best_match(by_stem.withColumnsRenamed({"l_id": "id", "r_id": "owner"}), "id", "owner")).withColumn("role", F.lit("live_video"))

    plain = F.regexp_replace("key", r"^(.*)_[oe](\d+)$", "$1_$2")
    variants = F.array_distinct(F.array(F.struct(F.lit(0).alias("n"), F.col("key").alias("key")), F.struct(F.lit(1).alias("n"), plain.alias("key"))))
    wanted = own.filter(F.col("kind") == "sidecar").select("id", "root", "dir_path", "ext", F.explode(variants).alias("v")).select("id", "root", "dir_path", "ext", F.col("v.n").alias("n"), F.col("v.key").alias("key"))
    owners = _sides(wanted, own.filter(F.col("kind").isin(*C.MEDIA_KINDS)), ["root", "dir_path", "key"]).withColumnsRenamed({"l_id": "id", "r_id": "owner"})
    rank = F.when(F.col("r_kind") == "photo", 0).when(F.col("r_kind") == "raw", 1).otherwise(2)
    sidecars = best_match(owners, "id", "owner", F.col("l_n"), rank).join(own.select("id", F.col("ext").alias("role")), "id")

    derived = own.filter(F.col("kind").isin(*C.MEDIA_KINDS) & F.col("stem").rlike(C.EDITED_STEM)).withColumn("key", F.lower(F.concat(F.regexp_extract("stem", C.EDITED_STEM, 1), F.lit("_"), F.regexp_extract("stem", C.EDITED_STEM, 2))))
    originals = _sides(derived, own, ["root", "dir_path", "key"]).filter((F.col("l_kind") == F.col("r_kind")) | F.col("r_kind").isin("photo", "raw"))
    edited = best_match(originals.withColumnsRenamed({"l_id": "id", "r_id": "edited_of"}), "id", "edited_of")

    owned = live.unionByName(sidecars)
    placed = files.select("id").join(owned, "id", "left").join(edited, "id", "left")
    return placed.select("id", F.coalesce("owner", "id").alias("item_id"), F.col("role").alias("companion_role"), "edited_of")


def relinked(files: DataFrame, touched: DataFrame, lost_ids: DataFrame | None = None) -> DataFrame:
    """`link_items` for what a change in the folders `touched` (root, dir_path) can have an effect on; no other folder is joined.

    Links reach over folders by content_id only: videos elsewhere that share one with a touched folder, or with a file that went from it
    (`lost_ids`: root, content_id), look for their photo anew. For these, `live_only` is true, and edited_of isn't worked out.
    """
    touched = touched.select("root", "dir_path").distinct()
    here = files.join(touched, ["root", "dir_path"], "left_semi")
    ids = here.filter(F.col("content_id") != "").select("root", "content_id")
    ids = (ids if lost_ids is None else ids.unionByName(lost_ids.select("root", "content_id"))).distinct()
    far = files.join(ids, ["root", "content_id"], "left_semi").join(touched, ["root", "dir_path"], "left_anti")
    links = link_items(here.unionByName(far))
    asked = here.select("id", F.lit(False).alias("live_only"))
    looking = far.filter((F.col("kind") == "video") & F.col("detached_at").isNull()).select("id", F.lit(True).alias("live_only"))
    return links.join(asked.unionByName(looking), "id")
