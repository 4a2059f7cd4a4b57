"""The public API: open a workspace, scan, classify, report, apply, undo, purge, status.

Plans are DataFrames; side effects, dry by default, are carried out on executors by `sources.mover`, whose logs become the journal.
"""

from __future__ import annotations

import itertools
import json
import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import display, hashing
from tidemill.functions.config import ClassifyConfig
from tidemill.functions.constants import CATEGORIES, MEDIA_KINDS
from tidemill.operators import dedupe, journal, link, report, rules, similar, snapshot
from tidemill.operators.numbering import numbered
from tidemill.plans.running import Running
from tidemill.session import cut, scratch_path, settings
from tidemill.sources import headers, images, mover, sinks, tree
from tidemill.sources.catalog import KEEP_SECONDS, Catalog, CatalogLock, utcnow

CATALOG_DIR = "_tidemill_catalog"
#: Photo paths that the driver hands to the image source at once; every batch is worked through.
PATHS = 20_000
CHANGES = ("new", "changed", "unchanged", "missing")
DECODED = ("jpg", "jpeg", "jpe", "png", "gif")


@dataclass
class Workspace:
    spark: SparkSession
    roots: dict[str, str]
    catalog: Catalog
    lock: CatalogLock | None
    session_id: int | None
    recursive: bool = True

    @property
    def move_log(self) -> str:
        return os.path.join(self.roots["review"], CATALOG_DIR, "moves.log")

    @property
    def tasks(self) -> int:
        """Tasks that work on files is dealt out to."""
        return max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def running(self, kind: str) -> Running:
        return Running(self.spark, self.catalog, os.path.join(self.roots["review"], CATALOG_DIR), kind, self.session_id, self.touch)

    def touch(self) -> None:
        """Tells others that the lock's owner is alive."""
        if self.lock:
            self.lock.touch()

    def close(self) -> None:
        if self.session_id is not None:
            self.catalog.end_session(self.session_id)
            self.catalog.vacuum(keep_seconds=KEEP_SECONDS)
        if self.lock:
            self.lock.release()


def open_workspace(spark: SparkSession, source: str, review: str | None = None, delete: str | None = None, *, recursive: bool = True, read_only: bool = False, force_lock: bool = False, session_kind: str = "cli") -> Workspace:
    """Checks the roots, takes the lock, and starts a session. Raises ValueError on roots that must not be used."""
    review = review or os.path.join(source, "_review")
    if delete is None:  # as this host had it last
        known = Catalog(spark, f"file://{os.path.abspath(os.path.join(review, CATALOG_DIR))}").resolve_roots()
        delete = known[2] if known and os.path.abspath(known[0]) == os.path.abspath(source) else os.path.join(source, "_delete")
    errors, _ = tree.check_roots(source, review, delete)
    if errors:
        raise ValueError(", ".join(errors))
    base = os.path.join(review, CATALOG_DIR)
    lock = None
    if not read_only:
        for folder in (review, delete, base):
            os.makedirs(folder, exist_ok=True)
        lock = CatalogLock(base)
        lock.acquire(force_lock)
    catalog = Catalog(spark, f"file://{os.path.abspath(base)}")
    session = None
    if not read_only:
        catalog.interrupt_jobs()
        catalog.record_roots(source, review, delete)
        session = catalog.start_session(session_kind)
    ws = Workspace(spark, {"source": os.path.abspath(source), "review": os.path.abspath(review), "delete": os.path.abspath(delete)}, catalog, lock, session, recursive)
    if not read_only:
        recover(ws)
    return ws


def recover(ws: Workspace) -> int:
    """Records what a process that died left in its logs of moves, and finishes or takes back what it left half done."""
    if not os.path.isdir(ws.move_log):
        return 0
    n = record(ws, mover.outcomes(ws.spark, ws.move_log, ws.roots))["moved"]
    shutil.rmtree(ws.move_log)
    return n


def run_scan(ws: Workspace) -> dict[str, int]:
    """Lists the three roots, diffs against the catalog, reads headers of new and changed media, links what a change can have an effect on.

    Only rows that change are written: a scan that meets nothing new leaves every table as it is, and only notes its generation.
    """
    with ws.running("scan") as job:
        return _scan(ws, job)


def _scan(ws: Workspace, job: Running) -> dict[str, int]:
    job.at("list")
    listed = tree.scan_roots(ws.spark, *ws.roots.values(), recursive=ws.recursive)
    failed = [(r["root"], r["rel_path"], r["error"]) for r in listed.filter(F.col("error").isNotNull()).select("root", "rel_path", "error").collect()]
    ws.catalog.add_issues([(rel, "list_error", error) for _, rel, error in failed], job.id)
    seen = listed.filter(F.col("error").isNull())
    spared = tuple(rel for _, rel, _ in failed)

    job.at("diff")
    last = ws.catalog.setting("scan") or {"gen": 0, "at": None, "failed": [], "clean": True}
    now, gen = utcnow(), last["gen"] + 1
    old = ws.catalog.read("files")
    tally = Observation()
    diff = snapshot.snapshot_diff(old, seen, failed_dirs=spared)
    diff = diff.observe(tally, *[F.count_if(F.col("change") == c).alias(c) for c in CHANGES], F.coalesce(F.max(F.when(F.col("change") == "new", 1)), F.lit(0)).alias("any"))
    changes = cut(diff.filter(F.col("change").isin("new", "changed", "missing")), "changes")
    counts = {c: tally.get[c] for c in CHANGES}
    if spared:  # what can't be seen now keeps the time at which it was seen last
        kept = old.filter((F.col("status") == "present") & snapshot.spared(F.col("dir_path"), spared) & ~snapshot.spared(F.col("dir_path"), tuple(last["failed"])))
        ws.catalog.merge("files", kept)
    mark = {"gen": gen, "at": now, "failed": list(spared)}
    touched = any(counts[c] for c in ("new", "changed", "missing"))
    whole = not last["clean"]  # an earlier scan ended before its features and links
    if touched or whole:
        ws.catalog.set_setting("scan", last | {"clean": False})
        folders, lost = None, None
        if touched:
            files = changed_rows(ws, old, changes, seen, now, gen)
            folders = cut(files.select("root", "dir_path").distinct(), "touched")
            ids = ws.catalog.read("file_meta").filter(F.col("content_id") != "").select(F.col("file_id").alias("id"), "content_id")
            lost = cut(files.select("id", "root").join(ids, "id").select("root", "content_id"), "lost-ids")
            ws.catalog.merge("files", files)
        job.at("features")
        read_headers(ws, now)
        job.at("links")
        relink(ws, None if whole or last["gen"] == 0 else folders, lost)
    ws.catalog.set_setting("scan", mark | {"clean": True})
    return {c: counts[c] for c in CHANGES} | {"failed_dirs": len(failed)}


def changed_rows(ws: Workspace, old: DataFrame, changes: DataFrame, seen: DataFrame, now: str, gen: int) -> DataFrame:
    """The rows of files that a scan puts: new ones with ids that follow the greatest, in the order of paths, changed and missing ones."""
    start = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    kept = [c for c in ws.catalog.columns("files") if c not in ("root", "rel_path", "size", "mtime_ns", "status", "name", "stem", "ext", "kind", "dir_path", "rel_path_os")]
    known = old.select("root", "rel_path", F.col("rel_path_os").alias("_old_os"), *kept)
    rows = changes.join(known, ["root", "rel_path"], "left").join(seen.select("root", "rel_path", F.col("rel_path_os").alias("_os")), ["root", "rel_path"], "left")
    numbers = numbered(changes.filter("change = 'new'").select("root", "rel_path"), "root", "rel_path", column="_new", start=start)
    rows = rows.join(numbers, ["root", "rel_path"], "left").withColumn("id", F.coalesce("id", "_new"))
    met = F.col("change") != "missing"
    rows = rows.withColumn("first_seen", F.coalesce("first_seen", F.lit(now))).withColumn("last_seen", F.when(met, now).otherwise(F.col("last_seen"))).withColumn("seen_gen", F.when(met, gen).otherwise(F.col("seen_gen")))
    rows = rows.withColumn("rel_path_os", F.when(met, F.col("_os")).otherwise(F.col("_old_os"))).withColumn("name", F.substring_index("rel_path", "/", -1))
    rows = rows.withColumn("dir_path", tree.names.dirname(F.col("rel_path"))).withColumn("stem", tree.names.stem(F.col("name"))).withColumn("ext", tree.names.ext(F.col("name"))).withColumn("kind", tree.names.kind(F.col("ext")))
    alone = [F.when(met, F.col(c)).alias(c) for c in ("companion_role", "edited_of")]
    rest = [c for c in ws.catalog.columns("files") if c not in ("item_id", "companion_role", "edited_of", "error")]
    return cut(rows.select(*rest, F.coalesce("item_id", "id").alias("item_id"), *alone, F.when(~met, F.col("error")).alias("error")), "changed-files")


def read_headers(ws: Workspace, now: str) -> int:
    """Media info of present media whose stored features are absent or of another version."""
    media = ws.catalog.read("files").filter((F.col("status") == "present") & F.col("kind").isin(*MEDIA_KINDS))
    wanted = snapshot.needing_features(media, ws.catalog.read("file_meta")).withColumn("path", full_path(ws))
    # small files: dealt out by count
    wanted = wanted.select("id", "size", "mtime_ns", "ext", "path").repartition(ws.tasks)
    described = headers.with_media_info(wanted).select(F.col("id").alias("file_id"), "size", "mtime_ns", "media.*").withColumn("extracted_at", F.lit(now))
    return ws.catalog.merge("file_meta", described)


def full_path(ws: Workspace):
    base = F.create_map(*[F.lit(x) for pair in ws.roots.items() for x in pair])
    return F.concat(base[F.col("root")], F.lit("/"), F.coalesce("rel_path_os", "rel_path"))


def relink(ws: Workspace, folders: DataFrame | None = None, lost_ids: DataFrame | None = None) -> int:
    """Live pairs, sidecars and edited versions of present files, of all or of what changes in `folders` can have an effect on; writes the rows that differ."""
    files = ws.catalog.read("files").filter("status = 'present'")
    meta = ws.catalog.read("file_meta").select(F.col("file_id").alias("id"), "content_id", "duration_ms")
    placed = files.join(meta, "id", "left")
    links = link.link_items(placed).withColumn("live_only", F.lit(False)) if folders is None else link.relinked(placed, folders, lost_ids)
    new = links.select("id", F.col("item_id").alias("_item"), F.col("companion_role").alias("_role"), F.col("edited_of").alias("_edited"), "live_only")
    both = files.join(new, "id").withColumn("_edited", F.when(F.col("live_only"), F.col("edited_of")).otherwise(F.col("_edited")))
    other = ~(F.col("item_id").eqNullSafe(F.col("_item")) & F.col("companion_role").eqNullSafe(F.col("_role")) & F.col("edited_of").eqNullSafe(F.col("_edited")))
    rest = [c for c in files.columns if c not in ("item_id", "companion_role", "edited_of")]
    return ws.catalog.merge("files", both.filter(other).select(*rest, F.col("_item").alias("item_id"), F.col("_role").alias("companion_role"), F.col("_edited").alias("edited_of")))


def wide(ws: Workspace) -> DataFrame:
    """Present source files with their metadata and analysis."""
    files = ws.catalog.read("files").filter((F.col("root") == "source") & (F.col("status") == "present"))
    meta = ws.catalog.read("file_meta").drop("extracted_at")
    analysis = ws.catalog.read("file_analysis").drop("analyzed_at", "phash_source")
    return snapshot.wide_rows(files, meta, analysis).withColumn("path", F.col("rel_path"))


def run_analysis(ws: Workspace, cfg: ClassifyConfig | None = None) -> None:
    """Digests along the duplicate funnel and pixel features of decodable photos, for files whose stored features are not valid.

    Where no wanted category but similar photos looks at pixels, only photos with a neighbour in time are decoded.
    """
    cfg = cfg or ClassifyConfig()
    files = ws.catalog.read("files").filter((F.col("root") == "source") & (F.col("status") == "present") & (F.col("item_id") == F.col("id")))
    media = files.filter(F.col("kind").isin(*MEDIA_KINDS) & (F.col("size") > 0)).withColumn("path", full_path(ws))
    features = ("partial_hash", "full_hash", "phash", "phash_source", "sharpness", "brightness", "dark_p99", "decode_error")
    stored = ws.catalog.read("file_analysis").select(F.col("file_id").alias("id"), "size", "mtime_ns", *features)
    known = media.select("id", "size", "mtime_ns", "path", "ext", "kind").join(stored, ["id", "size", "mtime_ns"], "left")
    # executors read the files that the path table names, each in pieces; what is stored for the same version isn't read again
    tasks = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    sized = dedupe.repeated(known, "size").repartition(tasks, "id")
    partial = hashing.partial_file_hash(F.when(F.col("partial_hash").isNull(), F.col("path")))
    partly = cut(sized.withColumn("partial_hash", F.coalesce("partial_hash", partial)).filter(F.col("partial_hash").isNotNull()), "partial")
    both = dedupe.repeated(partly, "size", "partial_hash").repartition(tasks, "id")
    full = hashing.full_file_hash(F.when(F.col("full_hash").isNull(), F.col("path")))
    wholly = cut(both.select("id", F.coalesce("full_hash", full).alias("_full")), "full")
    hashed = partly.join(wholly, "id", "left").select(F.col("id").alias("file_id"), "size", "mtime_ns", "partial_hash", F.coalesce("_full", "full_hash").alias("full_hash"))
    turns = ws.catalog.read("file_meta").select(F.col("file_id").alias("id"), "size", "mtime_ns", "orientation", "preview_kind", "preview_offset", "preview_length")
    looked = known.filter(F.col("kind").isin("photo", "raw") & F.col("phash").isNull() & F.col("decode_error").isNull())
    photos = looked.join(turns, ["id", "size", "mtime_ns"], "left").select("id", "ext", "size", "mtime_ns", "path", "orientation", "preview_kind", "preview_offset", "preview_length")
    if not cfg.is_enabled("junk") and not cfg.is_enabled("blurry_dark"):
        taken = media.filter("kind = 'photo'").select("id").join(ws.catalog.read("file_meta").select(F.col("file_id").alias("id"), F.col("date_taken_ts").alias("ts")), "id")
        window = cfg.similar_window_seconds
        near = similar.time_neighbours(taken, window, bucket=max(1, int(window)) * 60)
        photos = photos.join(near, "id", "left_semi") if cfg.is_enabled("similar") else photos.limit(0)
    photos = cut(photos, "photos")
    # an embedded preview that is large enough stands for its photo, RAW ones too
    shown, folder = photos.filter("preview_kind = 'jpeg' AND preview_offset > 0"), scratch_path(ws.spark, "previews")
    pre = None
    if shown.limit(1).count():
        images.write_previews(shown.repartition(tasks, "id"), folder)
        pre = cut(images.preview_features(shown, folder).withColumn("phash_source", F.lit("embedded")), "previews")
        photos = cut(photos.join(pre.select("id"), "id", "left_anti"), "photos")
        pre = shown.select("id", "size", "mtime_ns").join(pre, "id")
    photos = photos.filter(F.col("ext").isin(*DECODED))
    # Spark's image source takes paths from the driver, so they come in batches until none is left; each adds to one table, whose plan stays one read.
    # Small files share listing and reading tasks
    target, kinds = scratch_path(ws.spark, "pixels"), "path string, phash long, sharpness double, brightness double, dark_p99 double, decode_error string"
    ws.spark.createDataFrame([], kinds).write.parquet(target)
    shared = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * tasks), "spark.sql.files.openCostInBytes": str(1 << 18)}
    with settings(ws.spark, shared):
        for batch in itertools.batched(((r["path"], r["orientation"]) for r in photos.select("path", "orientation").toLocalIterator()), PATHS):
            turned = ws.spark.createDataFrame([x for x in batch if x[1] not in (None, 1)], "path string, orientation int")
            images.image_features(ws.spark, [f"file://{path}" for path, _ in batch], turned).write.mode("append").parquet(target)
    seen = ws.spark.read.schema(kinds).parquet(target)
    pixels = photos.select(F.col("id").alias("file_id"), "size", "mtime_ns", "path").join(seen, "path").drop("path").withColumn("phash_source", F.when(F.col("phash").isNotNull(), "decode"))
    pixels = pixels if pre is None else pixels.unionByName(pre.withColumnRenamed("id", "file_id"), allowMissingColumns=True)
    found = cut(hashed.join(pixels, ["file_id", "size", "mtime_ns"], "full_outer"), "analysis")
    known = ws.catalog.read("file_analysis").join(found.select("file_id"), "file_id", "left_semi")
    ws.catalog.merge("file_analysis", snapshot.merge_features(known, found, features))


def run_classify(ws: Workspace, cfg: ClassifyConfig | None = None, *, compute: bool = True) -> dict[str, int]:
    """A new run of all rules; unapplied candidates of earlier runs are replaced. Non-keepers by category."""
    cfg = cfg or ws.catalog.config()
    ws.catalog.save_config(cfg)
    with ws.running("classify") as job:
        job.at("analyse")
        if compute:
            run_analysis(ws, cfg)
        job.at("rules")
        rows = wide(ws)
        ws.catalog.write("matches", rules.matches_of(rows, cfg, run_id=job.id).withColumn("run_id", F.lit(job.id)))
        found = rules.classify(rows, cfg, run_id=job.id, matches=ws.catalog.read("matches"))
        table = put_candidates(ws, found, job.id)
        ws.catalog.set_setting("last_run", job.id)
        ws.catalog.set_setting("run_config", json.loads(cfg.to_json()))
    return {r["category"]: r["n"] for r in report.category_counts(table.filter(F.col("run_id") == job.id)).collect()}


def put_candidates(ws: Workspace, found: DataFrame, run_id: int) -> DataFrame:
    new = found.withColumn("run_id", F.lit(run_id)).withColumn("applied_op", F.lit(None).cast("string"))
    return ws.catalog.write("candidates", snapshot.replace_candidates(ws.catalog.read("candidates"), new))


def run_reevaluate(ws: Workspace, cfg: ClassifyConfig) -> dict[str, int]:
    """The last run under other settings, with the same number and without a look at files.

    Rules whose settings changed are worked out again, the stored matches of the others are ranked anew; similar groups are sought again only if
    their own settings, or the files that other rules name, are others.
    """
    run_id, before = ws.catalog.setting("last_run"), ws.catalog.setting("run_config")
    if run_id is None:
        raise ValueError("nothing was classified yet")
    before = ClassifyConfig.from_json(json.dumps(before))
    ws.catalog.save_config(cfg)
    with ws.running("reevaluate") as job:
        job.at("rules")
        rows, stored = wide(ws), ws.catalog.read("matches")
        own = cut(rules.rematched(rows, stored, before, cfg, run_id=run_id).join(rows.select(F.col("id").alias("file_id")), "file_id", "left_semi"), "matches")
        assigned = rules.ranked(own, cfg)
        old = ws.catalog.candidates(run_id, unapplied_only=True)
        similar_before = old.filter("category = 'similar'")
        if not cfg.is_enabled("similar"):
            found = assigned
        else:
            same = "similar" not in rules.changed_rules(before, cfg) and before.is_enabled("similar")
            named = assigned.select("file_id")
            were = old.filter("category <> 'similar'").select("file_id")
            if same and not named.exceptAll(were).union(were.exceptAll(named)).limit(1).count():
                found = assigned.unionByName(cut(similar_before.select(*assigned.columns), "similar"))
            else:
                found = assigned.unionByName(rules.similar_candidates(rows, assigned, cfg, run_id=run_id))
        table = put_candidates(ws, cut(found, "candidates"), run_id)
        ws.catalog.write("matches", own.withColumn("run_id", F.lit(run_id)))
        ws.catalog.set_setting("run_config", json.loads(cfg.to_json()))
    return {r["category"]: r["n"] for r in report.category_counts(table.filter(F.col("run_id") == run_id)).collect()}


def get_plan(ws: Workspace, cfg: ClassifyConfig | None = None, *, examples: int = 12, lang: str = "en") -> dict:
    """The nested report of the last run, with reasons in a language."""
    cfg = cfg or ws.catalog.config()
    files = ws.catalog.read("files")
    found = ws.catalog.candidates(int(ws.catalog.setting("last_run", 0)), unapplied_only=True)
    rows = report.candidate_rows(found, files)
    table = report.category_report(report.category_dimension(ws.spark, cfg.enabled), rows)
    rows_shown = rows.filter(~F.col("is_keeper")).withColumn("reason", display.reason_text(F.col("reason"), F.col("params"), lang))
    shown = report.first_examples(rows_shown, examples, order=[F.col("group_id").asc_nulls_first(), F.col("file_id")]).select("category", "nth", "file_id", "path", "size", "group_id", "reason").collect()
    own = files.filter((F.col("root") == "source") & (F.col("status") == "present"))
    pairs = report.live_and_edited(own).first()
    codec = ws.catalog.read("file_meta").select(F.col("file_id").alias("id"), "codec", "width", "height", "bitrate", "duration_ms")
    large = report.large_videos(own.filter("kind = 'video'").select("id", "rel_path", "size"), cfg.large_video_top, codec)
    categories = [r.asDict() | {"examples": [s.asDict() for s in sorted(shown, key=lambda s: s["nth"]) if s["category"] == r["category"]]} for r in table.orderBy("nth").collect()]
    totals = report.report_totals(table).first().asDict()
    return {"run_id": ws.catalog.setting("last_run"), "categories": categories, "live_photos": {"count": pairs["live_count"], "bytes": pairs["live_bytes"]}, "edited_pairs": {"count": pairs["edited_count"], "bytes": pairs["edited_bytes"]}, "large_videos": sorted((r.asDict() for r in large.collect()), key=lambda v: (-v["size"], v["id"])), "totals": totals}


def record(ws: Workspace, done: DataFrame, steps: DataFrame | None = None) -> dict[str, int]:
    """Journal rows, new file locations, marks and issues of what was carried out; said again of the same moves, it changes nothing.

    `steps` (file_id, steps) has the journal rows that an undo takes back at once; each of them gets a row of its own.
    """
    done = cut(done.withColumn("nth", F.coalesce("nth", "file_id")), "moves")
    counts = tally(done)
    if not counts["moved"] + counts["errors"]:
        return counts
    fine = done.filter(F.col("error").isNull())
    rows = fine.withColumn("_step", F.lit(0).cast("long"))
    if steps is not None:
        each = steps.select("file_id", F.posexplode("steps").alias("_step", "_s"))
        last = F.col("_step") == F.col("_last")
        sizes = steps.select("file_id", (F.size("steps") - 1).alias("_last"))
        rows = fine.join(each, "file_id").join(sizes, "file_id").withColumns({"src_root": F.col("_s.src_root"), "src_rel": F.col("_s.src_rel"), "dst_root": F.col("_s.dst_root"), "to_rel": F.when(last, F.col("to_rel")).otherwise(F.col("_s.dst_rel")), "undoes": F.col("_s.undoes"), "op_id": F.md5(F.concat_ws("/", "op_id", "_s.op_id")), "conflict": last & F.col("conflict"), "nth": -F.col("_s.undoes")})
    old = ws.catalog.read("journal")
    known = old.select("op_id", "file_id", F.coalesce("undoes", F.lit(-1)).alias("_undoes"))
    rows = rows.withColumn("_undoes", F.coalesce("undoes", F.lit(-1))).join(known, ["op_id", "file_id", "_undoes"], "left_anti")
    new = rows.select("nth", "_step", "op_id", "action", "file_id", "item_id", F.col("src_root").alias("from_root"), F.col("src_rel").alias("from_rel"), F.col("dst_root").alias("to_root"), "to_rel", "method", "conflict", "category", "size", "undoes")
    start = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = cut(numbered(new, "nth", "file_id", "_step", column="id", start=start).withColumn("ts", F.lit(utcnow())).withColumn("session_id", F.lit(ws.session_id).cast("long")), "journal-rows")
    by = new.filter(F.col("undoes").isNotNull()).select(F.col("undoes").alias("id"), F.col("id").alias("_by"))
    marked = old.join(by, "id").withColumn("undone_by", F.coalesce("undone_by", "_by")).drop("_by")
    ws.catalog.merge("journal", new.unionByName(marked, allowMissingColumns=True).select(*ws.catalog.columns("journal")))
    files = ws.catalog.read("files")
    if counts["purged"]:
        gone = files.join(fine.filter("purge").select(F.col("file_id").alias("id")), "id", "left_semi")
        ws.catalog.merge("files", gone.withColumn("status", F.lit("purged")))
    if counts["moved"] > counts["purged"]:
        at = fine.filter(~F.coalesce("purge", F.lit(False))).select(F.col("nth").alias("id"), "file_id", F.col("src_rel").alias("from_rel"), F.col("dst_root").alias("to_root"), "to_rel")
        moved = files.join(at.select(F.col("file_id").alias("id")), "id", "left_semi")
        ws.catalog.merge("files", snapshot.relocated(moved, at))
    if counts["staged"]:
        ops = fine.filter("action = 'to_review'").select("file_id", F.col("op_id").alias("_op"))
        open_rows = F.col("applied_op").isNull() & (F.col("run_id") == F.lit(ws.catalog.setting("last_run", 0)))
        ws.catalog.merge("candidates", ws.catalog.read("candidates").filter(open_rows).join(ops, "file_id").withColumn("applied_op", F.col("_op")).drop("_op"))
    if counts["errors"] + counts["conflicts"]:
        trouble = done.filter(F.col("error").isNotNull()).select("src_rel", F.lit("move_error").alias("kind"), F.col("error").alias("message"))
        trouble = trouble.unionByName(fine.filter("conflict").select(F.col("dst_rel").alias("src_rel"), F.lit("name_conflict").alias("kind"), F.concat(F.lit("stored as "), "to_rel").alias("message")))
        issues = numbered(trouble, "src_rel", "message", column="id", start=ws.catalog.last_id("issues"))
        ws.catalog.merge("issues", issues.select("id", F.lit(utcnow()).alias("ts"), F.col("src_rel").alias("path"), "kind", "message"))
    return counts


def tally(done: DataFrame) -> dict[str, int]:
    """What a call did, in numbers."""
    fine = F.col("error").isNull()
    marks = {"moved": fine, "errors": ~fine, "conflicts": fine & F.col("conflict"), "purged": fine & F.col("purge"), "staged": fine & (F.col("action") == "to_review")}
    row = done.agg(*[F.count_if(c).alias(n) for n, c in marks.items()], F.coalesce(F.sum(F.when(fine, F.col("size"))), F.lit(0)).alias("bytes")).first()
    return row.asDict()


def planned(ws: Workspace, plan: DataFrame, **more: object) -> DataFrame:
    """A plan's rows as the mover takes them: one operation an item, named by this call, in the order of items and files."""
    call = uuid.uuid4().hex
    own = plan.filter(~(F.col("src_root").eqNullSafe(F.col("dst_root")) & F.col("src_rel").eqNullSafe(F.col("dst_rel"))))
    for name, value in more.items():
        own = own.withColumn(name, F.lit(value))
    own = own.withColumn("op_id", F.md5(F.concat_ws("/", F.lit(call), F.col("item_id").cast("string"))))
    if "nth" not in own.columns:
        own = own.withColumn("nth", F.col("file_id"))
    own = journal.with_disk_names(own, ws.catalog.read("files"))
    kinds = ws.spark.createDataFrame([], mover.PLAN).schema
    return cut(own.select(*[(F.col(f.name) if f.name in own.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds]), "plan")


def move(ws: Workspace, plan: DataFrame, steps: DataFrame | None = None) -> dict[str, int]:
    """Carries a plan of `planned` out, of any size, and records it. Moves wait for others that are to leave their place."""
    with ws.running("move") as job:
        job.at("move")
        pending, left, wave = journal.first_free(plan, ws.catalog.read("files")), plan.count(), 0
        pending = cut(pending, "pending") if left else pending
        while left:
            ready = cut(journal.next_wave(pending), "wave")
            n = ready.count()
            if not n:  # a circle: its first free names break it
                ready, n = pending, left
            mover.perform(ready.repartition(min(ws.tasks, n)), ws.roots, os.path.join(ws.move_log, f"wave-{wave:04d}"))
            left, wave = left - n, wave + 1
            if left:
                pending = cut(pending.join(ready.select("file_id"), "file_id", "left_anti").select(*pending.columns), "pending")
        if not wave:
            return {"moved": 0, "errors": 0}
        job.at("record")
        done = record(ws, mover.outcomes(ws.spark, ws.move_log, ws.roots), steps)
        shutil.rmtree(ws.move_log)
    return done


def counted(plan: DataFrame) -> dict[str, int]:
    row = plan.agg(F.count("*").alias("planned"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    return row.asDict()


def run_apply(ws: Workspace, categories: list[str] | None = None, *, dry_run: bool = True) -> dict[str, int]:
    """Moves unapplied candidates to the review folder, one operation an item."""
    cfg = ws.catalog.config()
    wanted = categories or [c for c in CATEGORIES if cfg.is_enabled(c)]
    unknown = set(wanted) - set(CATEGORIES)
    if unknown:
        raise ValueError(f"unknown categories: {sorted(unknown)}")
    found = ws.catalog.candidates(int(ws.catalog.setting("last_run", 0)))
    plan = planned(ws, journal.apply_plan(found, ws.catalog.read("files"), wanted), action="to_review")
    if dry_run:
        return {"moved": 0} | counted(plan)
    return short(move(ws, plan))


def short(done: dict[str, int]) -> dict[str, int]:
    return {"moved": done["moved"], "errors": done["errors"]}


def run_live_photos(ws: Workspace, *, dry_run: bool = True) -> dict[str, int]:
    """Detaches live videos from their photos."""
    plan = planned(ws, journal.live_videos(ws.catalog.read("files")), action="detach_live", src_root="source")
    return {"planned": plan.count()} if dry_run else short(move(ws, plan))


def run_item_action(ws: Workspace, item_ids: list[int], action: str, *, dry_run: bool = True) -> dict[str, int]:
    """keep, to_delete or restore of whole items, one operation each. keep marks items of source and review as reviewed."""
    items = ws.spark.createDataFrame([(i,) for i in item_ids], "item_id long")
    files = ws.catalog.read("files")
    plan = planned(ws, journal.item_action(files, items, action))
    stay = cut(stay_in_place(ws, journal.kept_in_place(files, items)), "kept") if action == "keep" else None
    if dry_run:
        return {"planned": plan.count() + (stay.count() if stay is not None else 0)}
    seen = cut(files.filter(F.col("root").isin("source", "review")).join(items, "item_id", "left_semi").select("item_id").distinct(), "seen") if action == "keep" else None
    done = short(move(ws, plan))
    if stay is None:
        return done
    record(ws, stay)
    ws.catalog.set_reviewed(seen)
    return done | {"kept": stay.select("item_id").distinct().count()}


def stay_in_place(ws: Workspace, rows: DataFrame) -> DataFrame:
    """What is journaled without a move, as the mover would have told it."""
    call = uuid.uuid4().hex
    own = rows.withColumn("op_id", F.md5(F.concat_ws("/", F.lit(call), F.col("item_id").cast("string")))).withColumn("nth", F.col("file_id"))
    kinds = ws.spark.createDataFrame([], mover.DONE).schema
    return own.select(*[(F.col(f.name) if f.name in own.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


def run_group_decision(ws: Workspace, keep: list[int], delete: list[int], *, dry_run: bool = True) -> list[dict[str, int]]:
    """A group's kept items go back or stay, the others go to delete."""
    return [run_item_action(ws, keep, "keep", dry_run=dry_run), run_item_action(ws, delete, "to_delete", dry_run=dry_run)]


def run_undo(ws: Workspace, scope: str = "last", *, session_id: int | None = None, category: str | None = None, dry_run: bool = True) -> dict[str, int]:
    """Undoes the last operation, a session's, a category's or all, newest first, where files are still where they were put.

    A file goes back through all its rows by one move; every row is journaled.
    """
    rows, files = ws.catalog.read("journal"), ws.catalog.read("files")
    if scope == "session" and session_id is None:
        last = journal.last_undoable_session(rows).first()
        session_id = last["session_id"] if last else -1
    ops = journal.undoable_ops(rows, session_id=session_id if scope == "session" else None, category=category if scope == "category" else None, limit=1 if scope == "last" else None)
    plan = cut(journal.undo_plan(rows, files, ops), "undo")
    counts = plan.agg(F.count_if(F.col("valid")).alias("valid"), F.count_if(~F.col("valid")).alias("skipped")).first()
    if dry_run:
        return {"planned": counts["valid"], "skipped": counts["skipped"]}
    item = files.select(F.col("id").alias("file_id"), "item_id")
    net = cut(journal.net_moves(plan).join(item, "file_id", "left").withColumn("action", F.lit("undo")), "net")
    here = (F.col("src_root") == F.col("dst_root")) & (F.col("src_rel") == F.col("dst_rel"))
    done = move(ws, planned(ws, net.filter(~here)), net.select("file_id", "steps"))
    still = net.filter(here).withColumns({"to_rel": F.col("dst_rel"), "method": F.lit("none"), "conflict": F.lit(False)})
    record(ws, stay_in_place(ws, still), net.select("file_id", "steps"))
    own = ws.catalog.read("journal").filter(F.col("undoes").isNotNull()).select("undoes")
    undone = cut(plan.join(own, "undoes", "left_semi").join(item, "file_id"), "undone")
    ws.catalog.set_reviewed(undone.filter("clears_reviewed").select("item_id"), False)
    apart = undone.filter("relinks").join(ws.catalog.read("files").select(F.col("id").alias("file_id"), "root", "dir_path"), "file_id").select("root", "dir_path")
    if apart.limit(1).count():
        relink(ws)
    return {"moved": undone.filter("valid").count(), "errors": done["errors"], "skipped": counts["skipped"]}


def run_purge(ws: Workspace, *, dry_run: bool = True) -> dict[str, int]:
    """Deletes what lies in the delete folder."""
    plan = planned(ws, journal.purge_plan(ws.catalog.read("files")).withColumns({"src_root": F.lit("delete"), "src_rel": F.col("rel_path"), "item_id": F.lit(0)}).withColumn("dst_root", F.lit(None).cast("string")).withColumn("dst_rel", F.lit(None).cast("string")), action="purge", purge=True)
    if dry_run:
        return {"files": plan.count(), "bytes": counted(plan)["bytes"], "errors": 0}
    if not plan.limit(1).count():
        return {"files": 0, "bytes": 0, "errors": 0}
    with ws.running("purge") as job:
        job.at("delete")
        mover.perform(plan.repartition(ws.tasks), ws.roots, os.path.join(ws.move_log, "purge"))
        job.at("record")
        done = record(ws, mover.outcomes(ws.spark, ws.move_log, ws.roots))
        shutil.rmtree(ws.move_log)
        mover.remove_empty_dirs(plan.select(tree.names.dirname(F.col("src_rel")).alias("dir_path")), ws.roots["delete"])
    return {"files": done["moved"], "bytes": done["bytes"], "errors": done["errors"]}


def status(ws: Workspace) -> dict:
    files = ws.catalog.read("files").filter("status = 'present'")
    roots = {r["root"]: {"files": r["n"], "bytes": r["bytes"]} for r in report.root_stats(files).collect()}
    return {"roots": roots, "last_run": ws.catalog.setting("last_run"), "jobs": [r.asDict() for r in ws.catalog.jobs(limit=5).collect()], "lock": CatalogLock(os.path.join(ws.roots["review"], CATALOG_DIR)).owner()}


def write_reports(ws: Workspace, folder: str, lang: str = "en") -> None:
    """JSON plan, CSV of candidates by category and of the session's journal."""
    sinks.write_json(folder, "plan.json", get_plan(ws))
    sinks.candidate_csv(ws.catalog.candidates(int(ws.catalog.setting("last_run", 0))), ws.catalog.read("files"), os.path.join(folder, "candidates"), lang)
    sinks.journal_csv(ws.catalog.read("journal"), os.path.join(folder, "journal"))
