"""Classification: ordered rules, the first match assigns, later ones are kept in `also`.

Row-local rules are one expression: an array of nullable structs in order of priority, compacted. No shuffle happens for them;
the two group rules come in as columns (`dup`, `sim`) joined by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import constants as C
from tidemill.functions import names
from tidemill.functions.config import ClassifyConfig
from tidemill.operators.dedupe import duplicate_groups
from tidemill.operators.similar import similar_groups

FOUND = "struct<category:string,confidence:string,reason:string,params:map<string,string>,group_id:string,is_keeper:boolean>"


def found(category: str, reason: str | Column, *, group_id: Column | None = None, is_keeper: Column | None = None, **params: Column) -> Column:
    """A match of a category with its reason and the reason's parameters."""
    given = F.create_map(*[x for k, v in params.items() for x in (F.lit(k), v.cast("string"))]) if params else F.create_map().cast("map<string,string>")
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(category).alias("category"), F.lit(C.CATEGORIES.get(category, "medium")).alias("confidence"), reason.alias("reason"), given.alias("params"), (group_id if group_id is not None else F.lit(None)).cast("string").alias("group_id"), (is_keeper if is_keeper is not None else F.lit(False)).alias("is_keeper")).cast(FOUND)


def is_primary() -> Column:
    return F.col("item_id") == F.col("id")


def has_camera() -> Column:
    return F.coalesce(F.length("make") > 0, F.lit(False)) | F.coalesce(F.length("model") > 0, F.lit(False)) | F.coalesce(F.col("software").startswith("Android"), F.lit(False))


def is_kind(*kinds: str) -> Column:
    return F.coalesce(F.col("kind").isin(*kinds), F.lit(False))


def without_camera() -> Column:
    return F.coalesce(F.col("camera_known").cast("boolean"), F.lit(False)) & ~has_camera()


def valid() -> Column:
    return F.coalesce(F.col("a_valid"), F.lit(False))


def screenshots() -> Column:
    sized = F.col("format").eqNullSafe("png") & without_camera() & names.is_phone_screen(F.col("width"), F.col("height"))
    said = F.coalesce(F.lower(F.trim("user_comment")) == "screenshot", F.lit(False))
    return F.when(is_primary() & is_kind("photo"), F.when(said, found("screenshots", "screenshot_comment")).when(sized, found("screenshots", "screenshot_resolution", width=F.col("width"), height=F.col("height"))))


def screen_recordings() -> Column:
    sized = without_camera() & names.is_phone_screen(F.col("width"), F.col("height"))
    return F.when(is_primary() & is_kind("video"), F.when(F.col("stem").rlike(C.SCREEN_RECORDING), found("screen_recordings", "screen_recording_name")).when(sized, found("screen_recordings", "screen_recording_resolution", width=F.col("width"), height=F.col("height"))))


def short_videos(cfg: ClassifyConfig) -> Column:
    short = F.col("duration_ms") < cfg.short_video_seconds * 1000
    return F.when(is_primary() & is_kind("video") & short, found("short_videos", "short_video", seconds=F.col("duration_ms") / 1000, threshold=F.lit(cfg.short_video_seconds)))


def no_camera_media() -> Column:
    """A broken structure doesn't exempt a file: it is then also junk."""
    return F.when(is_primary() & is_kind("photo", "video") & without_camera(), found("no_camera_media", "no_camera"))


def junk(cfg: ClassifyConfig) -> Column:
    """Names, emptiness, broken structure, failed decoding, sidecars. The only rule for companions too."""
    lower = F.lower("name")
    sidecar = is_kind("sidecar") & (F.col("ext") == "aae")
    broken = is_kind(*C.MEDIA_KINDS) & F.coalesce(~F.col("structure_ok").cast("boolean"), F.lit(False))
    undecoded = is_kind("photo", "raw") & valid() & F.coalesce(F.length("decode_error") > 0, F.lit(False))
    return (
        F.when(lower.isin(*C.JUNK_NAMES) | lower.startswith(C.JUNK_PREFIX), found("junk", "junk_name"))
        .when(F.col("size") == 0, found("junk", "junk_empty"))
        .when(broken, found("junk", "junk_broken", detail=F.lit("invalid file structure")))
        .when(undecoded, found("junk", "junk_broken", detail=F.substring("decode_error", 1, 80)))
        .when(sidecar & is_primary(), found("junk", "junk_orphan_aae"))
        .when(sidecar & F.lit(cfg.move_all_aae), found("junk", "junk_aae"))
    )


def blurry_dark(cfg: ClassifyConfig) -> Column:
    """A frame of low mean whose highlights pass the limit is neither dark nor blurry."""
    dark = (F.col("brightness") < cfg.dark_mean) & (F.col("dark_p99") < cfg.dark_p99)
    blurry = (F.col("sharpness") < cfg.blur_threshold) & (F.col("brightness").isNull() | (F.col("brightness") >= cfg.dark_mean))
    own = F.when(dark, found("blurry_dark", "dark", percent=F.col("brightness") * 100)).when(blurry, found("blurry_dark", "blurry", sharpness=F.col("sharpness"), threshold=F.lit(cfg.blur_threshold)))
    return F.when(is_primary() & is_kind("photo", "raw") & valid(), own)


def group_match(category: str, prefix: str, keeper_reason: str, member_reason: str, **more: Column) -> Column:
    """A group rule's match from joined columns `<prefix>_group`, `<prefix>_keeper`, `<prefix>_path`."""
    keeper = F.col(f"{prefix}_keeper")
    own = found(category, F.when(keeper, keeper_reason).otherwise(member_reason), group_id=F.col(f"{prefix}_group"), is_keeper=keeper, group=F.col(f"{prefix}_group"), keeper=F.col(f"{prefix}_path"), **more)
    return F.when(F.col(f"{prefix}_group").isNotNull(), own)


def first_match(rows: DataFrame, matches: list[Column], *, drop_unmatched: bool = True) -> DataFrame:
    """`rows` with `found`, the first non-null of `matches`, and `also`, the categories of the others, each once."""
    every = rows.withColumn("_all", F.array_compact(F.array(*matches)))
    first = F.get("_all", F.lit(0))
    rest = F.transform(F.slice("_all", 2, 100), lambda m: m["category"])
    out = every.withColumn("found", first).withColumn("also", F.array_remove(F.array_distinct(rest), first["category"])).drop("_all")
    return out.filter(F.col("found").isNotNull()) if drop_unmatched else out


#: Settings that a rule's matches depend on; the others have none.
RULE_SETTINGS = {"short_videos": ("short_video_seconds",), "junk": ("move_all_aae",), "blurry_dark": ("blur_threshold", "dark_mean", "dark_p99"), "similar": ("similar_window_seconds", "similar_distance")}
FLAT = ("category", "confidence", "reason", "params", "group_id", "is_keeper")


def changed_rules(before: ClassifyConfig, cfg: ClassifyConfig) -> list[str]:
    """The rules whose settings differ."""
    return [rule for rule, names_ in RULE_SETTINGS.items() if any(getattr(before, n) != getattr(cfg, n) for n in names_)]


def matches_of(files: DataFrame, cfg: ClassifyConfig, *, run_id: int = 1, only: list[str] | None = None) -> DataFrame:
    """file_id and `matches`, a map from category to match, of every file that a rule but the similar one matches; of the rules `only`, if given."""
    wanted = [c for c in C.CATEGORIES if c != "similar" and (only is None or c in only)]
    rows = files
    if "duplicates" in wanted:
        hashed = files.filter(is_primary() & is_kind(*C.MEDIA_KINDS) & valid()).select("id", "full_hash", "stem", F.col("date_taken_ts").alias("ts"), "path")
        dup = duplicate_groups(hashed, run_id).select(F.col("id").alias("_id"), F.col("group_id").alias("dup_group"), F.col("is_keeper").alias("dup_keeper"), F.col("keeper_path").alias("dup_path"))
        rows = files.join(dup, F.col("id") == F.col("_id"), "left").drop("_id")
    every = {
        "duplicates": lambda: group_match("duplicates", "dup", "duplicate_keeper", "duplicate_of"),
        "screenshots": screenshots,
        "screen_recordings": screen_recordings,
        "short_videos": lambda: short_videos(cfg),
        "no_camera_media": no_camera_media,
        "junk": lambda: junk(cfg),
        "blurry_dark": lambda: blurry_dark(cfg),
    }
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), every[c]().alias("value")) for c in wanted])
    found_ = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    return rows.select(F.col("id").alias("file_id"), found_.alias("matches")).filter(F.size("matches") > 0)


def ranked(matches: DataFrame, cfg: ClassifyConfig) -> DataFrame:
    """Candidates from stored matches: the first enabled category assigns."""
    order = [c for c in C.CATEGORIES if c != "similar" and cfg.is_enabled(c)]
    rows = first_match(matches, [F.element_at("matches", c) for c in order] or [F.lit(None).cast(FOUND)])
    return rows.select("file_id", *[f"found.{c}" for c in FLAT], "also")


def similar_candidates(files: DataFrame, assigned: DataFrame, cfg: ClassifyConfig, *, run_id: int = 1) -> DataFrame:
    """Candidates of the similar rule, sought among photos that no other rule, keepers included, has named."""
    photos = files.filter(is_primary() & is_kind("photo") & valid()).join(assigned.select(F.col("file_id").alias("id")), "id", "left_anti")
    items = photos.select("id", F.col("date_taken_ts").alias("ts"), "phash", "edited_of", "sharpness", "width", "height", "path")
    sim = similar_groups(items, window=cfg.similar_window_seconds, distance=cfg.similar_distance, run_id=run_id).select("id", F.col("group_id").alias("sim_group"), F.col("is_keeper").alias("sim_keeper"), F.col("keeper_path").alias("sim_path"), F.col("delta").alias("sim_delta"))
    rows = first_match(sim, [group_match("similar", "sim", "similar_keeper", "similar_member", delta=F.col("sim_delta"))])
    return rows.select(F.col("id").alias("file_id"), *[f"found.{c}" for c in FLAT], "also")


def classify(files: DataFrame, cfg: ClassifyConfig | None = None, *, run_id: int = 1, matches: DataFrame | None = None) -> DataFrame:
    """Candidates (file_id, category, confidence, reason, params, group_id, is_keeper, also) of wide rows.

    `files` has the columns of the catalog's wide projection: id, item_id, name, stem, ext, kind, size, path, metadata and analysis. `matches` are
    those of `matches_of`, where they are known.
    """
    cfg = cfg or ClassifyConfig()
    if matches is None:
        matches = matches_of(files, cfg, run_id=run_id, only=[c for c in C.CATEGORIES if cfg.is_enabled(c)])
    assigned = ranked(matches, cfg)
    return assigned.unionByName(similar_candidates(files, assigned, cfg, run_id=run_id)) if cfg.is_enabled("similar") else assigned


def rematched(files: DataFrame, stored: DataFrame, before: ClassifyConfig, cfg: ClassifyConfig, *, run_id: int = 1) -> DataFrame:
    """Stored matches brought to other settings: only rules whose settings changed are worked out again."""
    again = [c for c in changed_rules(before, cfg) if c != "similar"]
    if not again:
        return stored.select("file_id", "matches")
    kept = stored.select("file_id", F.map_filter("matches", lambda k, v: ~k.isin(*again)).alias("_kept"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{FOUND}>"))
    both = kept.join(matches_of(files, cfg, run_id=run_id, only=again), "file_id", "full_outer")
    return both.select("file_id", F.map_concat(F.coalesce("_kept", none), F.coalesce("matches", none)).alias("matches")).filter(F.size("matches") > 0)
