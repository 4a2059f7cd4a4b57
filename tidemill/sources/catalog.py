"""The catalog: the tables behind a workspace, merged on read.

Large tables (files, features, candidates, journal, issues) are bases with deltas in a `Store`: scans, moves and marks write the rows that they
change. Settings, hosts, sessions and jobs are a few rows in a pointer file each, read and written without a Spark job.
"""

from __future__ import annotations

import json
import os
import socket
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.config import ClassifyConfig
from tidemill.operators import journal as J
from tidemill.operators import listing as L
from tidemill.operators import snapshot as S
from tidemill.sources.store import Conflict, Store

# Table columns in DDL; text, 64-bit and double columns of the catalog.
TABLES = {
    "meta": "key string, value string",
    "hosts": "hostname string, platform string, source_path string, review_path string, delete_path string, last_seen string",
    "settings": "key string, value string",
    "files": "id long, root string, rel_path string, rel_path_os string, origin_rel_path string, dir_path string, name string, stem string, ext string, kind string, size long, mtime_ns long, item_id long, companion_role string, edited_of long, detached_at string, status string, error string, reviewed_at string, first_seen string, last_seen string, seen_gen long",
    "file_meta": "file_id long, size long, mtime_ns long, format string, width long, height long, orientation int, make string, model string, software string, date_taken string, date_taken_ts long, date_source string, user_comment string, content_id string, duration_ms long, codec string, bitrate long, fps double, has_preview boolean, preview_kind string, preview_offset long, preview_length long, camera_known boolean, structure_ok boolean, extractor string, extracted_at string",
    "file_analysis": "file_id long, size long, mtime_ns long, partial_hash string, full_hash string, phash long, phash_source string, sharpness double, brightness double, dark_p99 double, decode_error string, analyzed_at string",
    "sessions": "id long, kind string, host string, app string, started_at string, ended_at string, params string",
    "jobs": "id long, session_id long, kind string, state string, params string, progress string, checkpoint string, started_at string, updated_at string, finished_at string, error string",
    "candidates": "run_id long, file_id long, category string, confidence string, reason string, params map<string,string>, group_id string, is_keeper boolean, also array<string>, applied_op string",
    "matches": "file_id long, run_id long, matches map<string,struct<category:string,confidence:string,reason:string,params:map<string,string>,group_id:string,is_keeper:boolean>>",
    "journal": "id long, op_id string, session_id long, ts string, action string, file_id long, item_id long, from_root string, from_rel string, to_root string, to_rel string, method string, conflict boolean, category string, reason string, params map<string,string>, size long, undoes long, undone_by long",
    "issues": "id long, job_id long, ts string, path string, kind string, message string",
}
# What tells the rows of a table apart.
KEYS = {
    "meta": ("key",),
    "hosts": ("hostname",),
    "settings": ("key",),
    "files": ("id",),
    "file_meta": ("file_id",),
    "file_analysis": ("file_id",),
    "sessions": ("id",),
    "jobs": ("id",),
    "candidates": ("run_id", "file_id", "category"),
    "matches": ("file_id",),
    "journal": ("id",),
    "issues": ("id",),
}
SMALL = ("meta", "hosts", "settings", "sessions", "jobs")
STALE_SECONDS = 600
#: Seconds for which superseded files stay, for readers that began before.
KEEP_SECONDS = 3600


def utcnow() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class Locked(RuntimeError):
    """Another process writes to the catalog."""


class Catalog:
    """Tables of one catalog folder. The folder is local to the driver or in any store that Spark reads."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.store = spark, base.rstrip("/"), Store(spark, base)

    def read(self, name: str) -> DataFrame:
        """The table as it is now; what is written later doesn't change it."""
        if name in SMALL:
            return self.spark.createDataFrame([tuple(r) for r in self.store.rows(name)], TABLES[name])
        rows = self.store.read(name, TABLES[name], KEYS[name])
        return self.seen(rows) if name == "files" else rows

    def seen(self, files: DataFrame) -> DataFrame:
        """Present files are seen by every scan: unless their folder couldn't be listed, generation and time are those of the newest one.

        So a file that doesn't change needs no new row for each scan.
        """
        scan = self.setting("scan") or {}
        if not scan or not scan["gen"]:
            return files
        met = (F.col("status") == "present") & (F.col("seen_gen") < scan["gen"]) & ~S.spared(F.col("dir_path"), tuple(scan["failed"]))
        return files.withColumn("last_seen", F.when(met, scan["at"]).otherwise(F.col("last_seen"))).withColumn("seen_gen", F.when(met, scan["gen"]).otherwise(F.col("seen_gen")))

    def write(self, name: str, table: DataFrame) -> DataFrame:
        """All of a table anew, cast to its schema."""
        try:
            if name in SMALL:
                self.store.put_rows(name, [list(r) for r in table.select(*self.columns(name)).collect()])
            else:
                self.store.write(name, table, TABLES[name], KEYS[name])
        except Conflict as error:
            raise Locked(str(error)) from error
        return self.read(name)

    def merge(self, name: str, rows: DataFrame | None, *, gone: DataFrame | None = None) -> int:
        """Puts rows by their keys, drops the keys of `gone`, and returns the number of both; nothing is written for none."""
        try:
            return self.store.merge(name, rows, TABLES[name], KEYS[name], gone=gone)
        except Conflict as error:
            raise Locked(str(error)) from error

    def columns(self, name: str) -> list[str]:
        return [part.split(" ")[0] for part in TABLES[name].split(", ")]

    def vacuum(self, name: str | None = None, *, keep_seconds: float = 0) -> int:
        """Deletes what the newest pointer of a table, or of every table, doesn't name."""
        return sum(self.store.vacuum(n, keep_seconds=keep_seconds) for n in ([name] if name else TABLES))

    # small tables

    def records(self, name: str) -> list[dict]:
        columns = self.columns(name)
        return [dict(zip(columns, r, strict=True)) for r in self.store.rows(name)]

    def put(self, name: str, *records: dict) -> None:
        """Inserts or replaces rows of a small table."""
        columns, keys = self.columns(name), KEYS[name]
        kept = {tuple(r[k] for k in keys): r for r in self.records(name)}
        kept |= {tuple(r[k] for k in keys): kept.get(tuple(r[k] for k in keys), {}) | r for r in records}
        try:
            self.store.put_rows(name, [[r.get(c) for c in columns] for r in kept.values()])
        except Conflict as error:
            raise Locked(str(error)) from error

    def setting(self, key: str, default: object = None) -> object:
        return next((json.loads(r["value"]) for r in self.records("settings") if r["key"] == key), default)

    def set_setting(self, key: str, value: object) -> None:
        self.put("settings", {"key": key, "value": json.dumps(value)})

    def config(self) -> ClassifyConfig:
        return ClassifyConfig.from_json(json.dumps(self.setting("classify", {})))

    def save_config(self, cfg: ClassifyConfig) -> None:
        self.set_setting("classify", json.loads(cfg.to_json()))

    def record_roots(self, source: str, review: str, delete: str) -> None:
        self.put("hosts", {"hostname": socket.gethostname(), "platform": os.name, "source_path": source, "review_path": review, "delete_path": delete, "last_seen": utcnow()})

    def resolve_roots(self) -> tuple[str, str, str] | None:
        """The roots that this host used last."""
        found = next((r for r in self.records("hosts") if r["hostname"] == socket.gethostname()), None)
        return (found["source_path"], found["review_path"], found["delete_path"]) if found else None

    def last_id(self, name: str) -> int:
        if name in SMALL:
            return max((r["id"] for r in self.records(name)), default=0)
        return self.read(name).agg(F.max("id")).first()[0] or 0

    def _next(self, name: str) -> int:
        return self.last_id(name) + 1

    def start_session(self, kind: str, app: str = "tidemill", params: dict | None = None) -> int:
        id = self._next("sessions")
        self.put("sessions", {"id": id, "kind": kind, "host": socket.gethostname(), "app": app, "started_at": utcnow(), "params": json.dumps(params or {})})
        return id

    def end_session(self, id: int) -> None:
        self.put("sessions", {"id": id, "ended_at": utcnow()})

    def create_job(self, kind: str, session_id: int | None = None, params: dict | None = None) -> int:
        id, now = self._next("jobs"), utcnow()
        self.put("jobs", {"id": id, "session_id": session_id, "kind": kind, "state": "running", "params": json.dumps(params or {}), "started_at": now, "updated_at": now})
        return id

    def update_job(self, id: int, state: str, *, progress: dict | None = None, error: str | None = None) -> None:
        now = utcnow()
        done = {"finished_at": now} if state in ("done", "cancelled", "failed") else {}
        more = {"progress": json.dumps(progress)} if progress is not None else {}
        self.put("jobs", {"id": id, "state": state, "updated_at": now, "error": error} | done | more)

    def interrupt_jobs(self) -> None:
        """Jobs that a process which is gone left running."""
        left = [r["id"] for r in self.records("jobs") if r["state"] == "running"]
        if left:
            self.put("jobs", *[{"id": i, "state": "interrupted"} for i in left])

    def jobs(self, kind: str | None = None, states: tuple[str, ...] = (), limit: int = 50) -> DataFrame:
        return L.newest(self.read("jobs"), limit=limit, states=states, kind=kind)

    def add_issues(self, rows: list[tuple[str | None, str, str]], job_id: int | None = None) -> None:
        """Appends (path, kind, message); messages are cut at 2,000 characters."""
        if rows:
            first, now = self._next("issues"), utcnow()
            own = [(first + k, job_id, now, path, kind, message[:2000]) for k, (path, kind, message) in enumerate(rows)]
            self.merge("issues", self.spark.createDataFrame(own, TABLES["issues"]))

    def set_reviewed(self, items: DataFrame, reviewed: bool = True) -> None:
        """Marks all files of `items` (item_id), or clears the mark."""
        own = self.read("files").join(items.select("item_id").distinct(), "item_id", "left_semi")
        self.merge("files", S.reviewed(own, items, utcnow() if reviewed else None))

    def issues(self, job_id: int | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
        return L.newest(self.read("issues"), limit=limit, offset=offset, job_id=job_id)

    # files

    def files(self, root: str | None = None, *, kinds: tuple[str, ...] = (), status: str | None = "present", dir_path: str | None = None, recursive: bool = True, primaries_only: bool = False) -> DataFrame:
        from tidemill.functions.names import in_folder

        rows = self.read("files")
        for column, value in (("root", root), ("status", status)):
            rows = rows.filter(F.col(column) == value) if value is not None else rows
        rows = rows.filter(F.col("kind").isin(*kinds)) if kinds else rows
        rows = rows.filter(in_folder(F.col("dir_path"), dir_path, recursive)) if dir_path is not None else rows
        rows = rows.filter(F.col("item_id") == F.col("id")) if primaries_only else rows
        return rows.orderBy("rel_path")

    def _row(self, name: str, key: str, value: int) -> dict | None:
        found = self.read(name).filter(F.col(key) == value).first()
        return found.asDict() if found else None

    def file(self, id: int) -> dict | None:
        return self._row("files", "id", id)

    def file_by_path(self, root: str, rel_path: str) -> dict | None:
        found = self.read("files").filter((F.col("root") == root) & (F.col("rel_path") == rel_path)).first()
        return found.asDict() if found else None

    def item_files(self, item_id: int) -> DataFrame:
        return L.item_files(self.read("files"), item_id)

    def meta(self, file_id: int) -> dict | None:
        return self._row("file_meta", "file_id", file_id)

    def analysis(self, file_id: int) -> dict | None:
        return self._row("file_analysis", "file_id", file_id)

    def job(self, id: int) -> dict | None:
        return next((r for r in self.records("jobs") if r["id"] == id), None)

    def candidates(self, run_id: int | None = None, category: str | None = None, *, unapplied_only: bool = False, include_keepers: bool = True) -> DataFrame:
        rows = self.read("candidates")
        rows = rows.filter(F.col("run_id") == run_id) if run_id is not None else rows
        rows = rows.filter(F.col("category") == category) if category else rows
        rows = rows.filter(F.col("applied_op").isNull()) if unapplied_only else rows
        return rows if include_keepers else rows.filter(~F.col("is_keeper"))

    def journal(self, **search: object) -> DataFrame:
        return J.search(self.read("journal"), **search)


class CatalogLock:
    """One writer at a time, by a file made exclusively; a lock untouched for ten minutes, or whose process is gone, may be taken."""

    def __init__(self, folder: str):
        self.path = os.path.join(folder, "lock.json")

    def owner(self) -> dict | None:
        try:
            with open(self.path, encoding="utf-8") as f:
                return json.load(f)
        except (OSError, ValueError):
            return None

    def stale(self, owner: dict | None) -> bool:
        if owner is None:
            return True
        if time.time() - owner.get("touched", 0) > STALE_SECONDS:
            return True
        if owner.get("host") == socket.gethostname():
            try:
                os.kill(int(owner.get("pid", 0)), 0)
            except (OSError, ValueError):
                return True
        return False

    def acquire(self, force: bool = False) -> None:
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        if os.path.exists(self.path):
            own = self.owner()
            if not force and not self.stale(own):
                raise Locked(f"the catalog is in use by {own}")
            os.unlink(self.path)
        try:
            handle = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError as error:
            raise Locked("the catalog was just taken") from error
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump({"host": socket.gethostname(), "pid": os.getpid(), "touched": time.time()}, f)

    def touch(self) -> None:
        own = self.owner() or {}
        with open(self.path + ".next", "w", encoding="utf-8") as f:
            json.dump(own | {"touched": time.time()}, f)
        os.replace(self.path + ".next", self.path)

    def release(self) -> None:
        if os.path.exists(self.path):
            os.unlink(self.path)
