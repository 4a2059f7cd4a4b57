"""Merge-on-read tables, the frontier walk, scans that write what changes, jobs that stop."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemill.operators import link
from tidemill.plans import workspace as W
from tidemill.sources import store, tree

DDL = "id long, name string, n int"
KEYS = ("id",)


def table(spark, rows):
    return spark.createDataFrame(sorted(rows), DDL)


def test_merge_on_read(spark, tmp_path, monkeypatch):
    """Puts and drops in any order against a dictionary, over buckets, deltas and compactions."""
    monkeypatch.setattr(store, "BUCKET_ROWS", 40)
    monkeypatch.setattr(store, "DELTA_SHARE", 2.0)
    monkeypatch.setattr(store, "MOST_DELTAS", 4)
    own, rng, want = store.Store(spark, f"file://{tmp_path}"), random.Random(2), {}
    assert own.read("t", DDL, KEYS).count() == 0 and own.compact("t", DDL, KEYS) == 0
    seen = []
    for step in range(14):
        puts = {i: (i, rng.choice(["a", None]), step) for i in rng.sample(range(step * 30 + 40), 12)}
        drops = [i for i in rng.sample(sorted(want), min(len(want), 4)) if i not in puts]
        gone = spark.createDataFrame([(i,) for i in drops], "id long") if drops else None
        before = own.read("t", DDL, KEYS)
        expected = dict(want)
        assert own.merge("t", table(spark, puts.values()), DDL, KEYS, gone=gone) == len(puts) + len(drops)
        want = {i: r for i, r in (want | puts).items() if i not in drops}
        assert {r.id: tuple(r) for r in own.read("t", DDL, KEYS).collect()} == want
        # a reader keeps what it began with
        assert {r.id: tuple(r) for r in before.collect()} == expected
        seen.append(len(own.state("t")[1]["deltas"]))
    assert 0 in seen and max(seen) > 1
    own.compact("t", DDL, KEYS)
    number, state = own.state("t")
    assert state["buckets"] > 1 and state["rows"] == len(want) and not state["deltas"]
    # a delta that touches one bucket has that one written anew
    one = next(iter(want))
    own.merge("t", table(spark, [(one, "new", 99)]), DDL, KEYS)
    assert own.compact("t", DDL, KEYS) == 1
    after = own.state("t")[1]
    assert sum(after["base"][b] != state["base"][b] for b in after["base"]) == 1 and after["rows"] == len(want)
    want[one] = (one, "new", 99)
    assert {r.id: tuple(r) for r in own.read("t", DDL, KEYS).collect()} == want
    assert own.merge("t", table(spark, []), DDL, KEYS) == 0 and own.state("t")[0] == number + 2
    assert own.vacuum("t", keep_seconds=3600) == 0 and own.vacuum("t") > 3
    assert {r.id: tuple(r) for r in own.read("t", DDL, KEYS).collect()} == want


def test_two_writers(spark, tmp_path):
    own = store.Store(spark, f"file://{tmp_path}")
    own.put_rows("s", [["a", 1]])
    own.point("s", 2, {"small": [["b", 2]]})
    with pytest.raises(store.Conflict):
        own.point("s", 2, {"small": [["c", 3]]})
    assert own.rows("s") == [["b", 2]] and own.vacuum("s") == 1


def walked(base):
    out = set()
    for folder, folders, names in os.walk(base):
        folders[:] = [f for f in folders if not tree.excluded(f)]
        out |= {os.path.relpath(os.path.join(folder, n), base) for n in names}
    return out


def test_walk_from_one_top_folder(spark, tmp_path):
    for k in range(300):
        folder = tmp_path / "only" / f"a{k % 7}" / f"b{k % 60}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"_f{k}.jpg").write_bytes(b"x" * k)
    (tmp_path / "only" / "@eaDir").mkdir()
    (tmp_path / "only" / "@eaDir" / "no.jpg").write_bytes(b"")
    (tmp_path / "link").symlink_to(tmp_path / "only")
    own = {"source": tree.Walk(str(tmp_path))}
    rows = tree.walk(spark, own, tasks=4, budget=30, first_budget=5).collect()
    assert sorted(r.rel_path for r in rows) == sorted(walked(tmp_path)) and len(rows) == 300
    assert {r.task for r in rows} == {0, 1, 2, 3} and all(r.size == int(r.name[2:-4]) for r in rows)
    assert sorted(r.rel_path for r in tree.walk(spark, own).collect()) == sorted(walked(tmp_path))


def versions(ws):
    return {n: ws.catalog.store.state(n)[0] for n in ("files", "file_meta", "file_analysis", "candidates", "journal", "issues")}


def open_ws(spark, base, **more):
    return W.open_workspace(spark, str(base / "src"), str(base / "review"), str(base / "delete"), **more)


def make(base, *names):
    for name in names:
        path = base / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())


def test_a_scan_without_changes_writes_no_table(spark, tmp_path):
    make(tmp_path, *[f"d{k % 3}/IMG_{k:04d}.JPG" for k in range(40)], "d1/IMG_0004.AAE")
    ws = open_ws(spark, tmp_path)
    assert W.run_scan(ws)["new"] == 41
    first = ws.catalog.file_by_path("source", "d0/IMG_0000.JPG")
    before = versions(ws)
    assert W.run_scan(ws) == {"new": 0, "changed": 0, "unchanged": 41, "missing": 0, "failed_dirs": 0}
    assert versions(ws) == before
    again = ws.catalog.file_by_path("source", "d0/IMG_0000.JPG")
    assert (first["seen_gen"], again["seen_gen"]) == (1, 2) and again["first_seen"] == first["first_seen"]
    # one file more, one less and one changed: three rows in a delta
    make(tmp_path, "d2/new.jpg")
    os.unlink(tmp_path / "src" / "d0" / "IMG_0003.JPG")
    (tmp_path / "src" / "d1" / "IMG_0001.JPG").write_bytes(b"longer than before")
    assert W.run_scan(ws) == {"new": 1, "changed": 1, "unchanged": 39, "missing": 1, "failed_dirs": 0}
    gone = ws.catalog.file_by_path("source", "d0/IMG_0003.JPG")
    assert (gone["status"], gone["seen_gen"]) == ("missing", 2) and ws.catalog.file_by_path("source", "d2/new.jpg")["id"] == 42
    assert ws.catalog.file_by_path("source", "d2/new.jpg")["seen_gen"] == 3
    ws.close()


def test_unreadable_folders_keep_their_files(spark, tmp_path, monkeypatch):
    make(tmp_path, "a/x.jpg", "b/y.jpg")
    ws = open_ws(spark, tmp_path)
    W.run_scan(ws)
    listed = tree.scan_roots

    def failing(*args, **more):
        rows = listed(*args, **more)
        lost = rows.filter("rel_path = 'a/x.jpg'").withColumn("rel_path", F.lit("a")).withColumn("error", F.lit("denied"))
        return rows.filter("rel_path <> 'a/x.jpg'").unionByName(lost)

    monkeypatch.setattr(tree, "scan_roots", failing)
    for _ in range(2):
        assert W.run_scan(ws)["failed_dirs"] == 1
    seen = {r.rel_path: (r.status, r.seen_gen) for r in ws.catalog.read("files").collect()}
    assert seen == {"a/x.jpg": ("present", 1), "b/y.jpg": ("present", 3)} and ws.catalog.issues().count() == 2
    monkeypatch.setattr(tree, "scan_roots", listed)
    W.run_scan(ws)
    assert {r.rel_path: r.seen_gen for r in ws.catalog.read("files").collect()} == {"a/x.jpg": 4, "b/y.jpg": 4}
    ws.close()


def test_a_scan_that_died_is_made_up_for(spark, tmp_path, monkeypatch):
    make(tmp_path, "a/IMG_1.JPG", "a/IMG_1.AAE")
    ws = open_ws(spark, tmp_path)

    def dies(*args):
        raise RuntimeError("no memory")

    with monkeypatch.context() as m:
        m.setattr(W, "read_headers", dies)
        with pytest.raises(RuntimeError):
            W.run_scan(ws)
    assert ws.catalog.jobs(kind="scan").first()["state"] == "failed" and ws.catalog.read("file_meta").count() == 0
    assert W.run_scan(ws)["unchanged"] == 2
    assert ws.catalog.read("file_meta").count() == 1
    ids = {r.rel_path: (r.id, r.item_id) for r in ws.catalog.read("files").collect()}
    assert ids["a/IMG_1.AAE"][1] == ids["a/IMG_1.JPG"][0]
    ws.close()


def test_relinking_touched_folders_is_linking_all(spark):
    """After inserts, deletions and changes, the links of touched folders and the stored ones of others are those of all files."""
    rng = random.Random(5)
    ddl = "id long, root string, dir_path string, stem string, ext string, kind string, detached_at string, content_id string, duration_ms long"

    def some(i):
        kind = rng.choice(["photo", "raw", "video", "sidecar"])
        ext = {"photo": "jpg", "raw": "dng", "video": "mov", "sidecar": rng.choice(["aae", "xmp"])}[kind]
        content = rng.choice([None, None, "c1", "c2", "c3", "c4"]) if kind != "sidecar" else None
        stem = rng.choice(["IMG_1", "IMG_2", "IMG_E1", "img_1", "IMG_O2", "X"])
        return (i, rng.choice(["source", "source", "review"]), f"d{rng.randrange(9)}", stem, ext, kind, rng.choice([None, None, None, "t"]) if kind == "video" else None, content, rng.choice([None, 1000, 9000]))

    rows = {i: some(i) for i in range(150)}
    frame = lambda r: spark.createDataFrame(sorted(r.values()), ddl)
    links = {r.id: (r.item_id, r.companion_role, r.edited_of) for r in link.link_items(frame(rows)).collect()}
    for step in range(3):
        gone = rng.sample(sorted(rows), 6)
        new = {1000 * (step + 1) + k: some(1000 * (step + 1) + k) for k in range(6)}
        folders = {rows[i][1:3] for i in gone} | {r[1:3] for r in new.values()}
        lost = [(rows[i][1], rows[i][7]) for i in gone if rows[i][7]]
        rows = {i: r for i, r in rows.items() if i not in gone} | new
        touched = spark.createDataFrame(sorted(folders), "root string, dir_path string")
        found = link.relinked(frame(rows), touched, spark.createDataFrame(lost, "root string, content_id string")).collect()
        links = {i: x for i, x in links.items() if i in rows}
        assert len(found) < len(rows)
        for r in found:
            links[r.id] = (r.item_id, r.companion_role, links[r.id][2] if r.live_only else r.edited_of)
        assert links == {r.id: (r.item_id, r.companion_role, r.edited_of) for r in link.link_items(frame(rows)).collect()}


def test_a_cancelled_job(spark, tmp_path, monkeypatch):
    """A job that is asked to stop leaves the catalog at its last version; progress is there while it runs."""
    from tidemill.plans import running

    monkeypatch.setattr(running, "BEAT", 0.05)
    make(tmp_path, "a/IMG_1.JPG", "a/IMG_2.JPG")
    ws = open_ws(spark, tmp_path)
    W.run_scan(ws)
    before, progress = versions(ws), []

    def slow(ws, cfg):
        job = ws.catalog.records("jobs")[-1]["id"]
        folder = os.path.dirname(ws.lock.path)

        def wait(rows):
            time.sleep(20)
            yield from rows

        with open(os.path.join(folder, f"cancel-{job}.later"), "w"):
            pass
        import threading

        def ask():
            path = os.path.join(folder, "progress.json")
            until = time.time() + 10
            while time.time() < until and not progress:
                if os.path.exists(path) and '"step": "analyse"' in open(path).read() and '"total": 0' not in open(path).read():
                    progress.append(open(path).read())
                time.sleep(0.02)
            os.rename(os.path.join(folder, f"cancel-{job}.later"), os.path.join(folder, f"cancel-{job}"))

        threading.Thread(target=ask).start()
        spark.range(1).repartition(1).mapInArrow(wait, "id long").collect()

    monkeypatch.setattr(W, "run_analysis", slow)
    began = time.time()
    with pytest.raises(running.Cancelled):
        W.run_classify(ws)
    assert time.time() - began < 15 and progress and '"step": "analyse"' in progress[0]
    assert versions(ws) == before and ws.catalog.jobs(kind="classify").first()["state"] == "cancelled"
    assert not os.path.exists(os.path.join(os.path.dirname(ws.lock.path), "progress.json"))
    ws.close()
