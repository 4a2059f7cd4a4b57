"""Moves on executors: attempts that go on, places that others leave, a process that is killed."""

import glob
import os
import signal
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from tidemill.plans import workspace as W
from tidemill.sources import mover


def row(k, src, dst, **more):
    return {"nth": k, "op_id": f"op{k}", "action": "to_review", "file_id": k, "item_id": k, "src_root": "a", "src_rel": src, "dst_root": "b", "dst_rel": dst, "size": 1} | more


@pytest.fixture
def roots(tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    for k in range(6):
        (tmp_path / "a" / f"{k}.jpg").write_bytes(b"file %d" % k)
    return {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}


def state(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(root) for n in names}


@pytest.mark.parametrize("left", ["nothing", "intent", "linked", "claimed", "moved"])
def test_an_attempt_goes_on(roots, tmp_path, left):
    """Whatever the first attempt left of its second file, the second attempt ends where one attempt would have."""
    moves = [row(k, f"{k}.jpg", "x/same.jpg") for k in range(3)]
    log = str(tmp_path / "log")
    first = mover.carry_out(moves, roots, dry_run=False, log=log, name="attempt-0.jsonl")
    assert next(first)["to_rel"] == "x/same.jpg"
    first.close()
    source, target = os.path.join(roots["a"], "1.jpg"), os.path.join(roots["b"], "x/same~2.jpg")
    if left != "nothing":
        own = mover.Log(log, "attempt-0.jsonl")
        own.put(moves[1] | {"to_rel": "x/same~2.jpg", "stage": "intent"}, sure=True)
        own.file.write('{"cut off')
        own.close()
    if left == "linked":
        os.link(source, target)
    if left == "claimed":
        open(target, "w").close()
    if left == "moved":
        os.rename(source, target)
    again = list(mover.carry_out(moves, roots, dry_run=False, log=log, name="attempt-1.jsonl"))
    assert [m["to_rel"] for m in again] == ["x/same.jpg", "x/same~2.jpg", "x/same~3.jpg"] and not any(m["error"] for m in again)
    assert state(roots["b"]) == {"x/same.jpg": b"file 0", "x/same~2.jpg": b"file 1", "x/same~3.jpg": b"file 2"} and len(state(roots["a"])) == 3
    assert again[1]["method"] == ("recovered" if left in ("linked", "moved") else "rename")


def test_deleting_goes_on(roots, tmp_path):
    moves = [row(k, f"{k}.jpg", None, purge=True) for k in range(3)]
    log = str(tmp_path / "log")
    next(mover.carry_out(moves, roots, dry_run=False, log=log, name="0.jsonl"))
    assert [m["error"] for m in mover.carry_out(moves, roots, dry_run=False, log=log, name="1.jsonl")] == [None] * 3
    assert set(state(roots["a"])) == {"3.jpg", "4.jpg", "5.jpg"}
    missing = list(mover.carry_out([row(9, "none.jpg", "y.jpg")], roots, dry_run=False, log=str(tmp_path / "other")))
    assert missing[0]["error"] and missing[0]["to_rel"] is None


def test_outcomes_of_logs(spark, roots, tmp_path):
    """Done rows count once over attempts; open intents are looked into."""
    moves = [row(k, f"{k}.jpg", f"{k}.jpg") for k in range(4)]
    log = str(tmp_path / "log")
    first = mover.carry_out(moves, roots, dry_run=False, log=f"{log}/w/part-0", name="0.jsonl")
    next(first), next(first)
    first.close()
    list(mover.carry_out(moves[:2], roots, dry_run=False, log=f"{log}/w/part-0", name="1.jsonl"))
    own = mover.Log(f"{log}/w/part-1", "0.jsonl")
    for m in moves[2:]:
        own.put(m | {"to_rel": m["dst_rel"], "stage": "intent"}, sure=True)
    own.close()
    os.rename(os.path.join(roots["a"], "2.jpg"), os.path.join(roots["b"], "2.jpg"))
    found = {r.file_id: (r.method, r.to_rel) for r in mover.outcomes(spark, log, roots).collect()}
    assert found == {0: ("rename", "0.jpg"), 1: ("rename", "1.jpg"), 2: ("recovered", "2.jpg")} and os.path.exists(os.path.join(roots["a"], "3.jpg"))


def open_ws(spark, base):
    return W.open_workspace(spark, str(base / "src"), str(base / "review"), str(base / "delete"))


def test_moves_wait_for_places(spark, tmp_path):
    """A file that goes where another leaves, one that follows it, and two that change places."""
    for name in ("one", "two", "three", "x", "y"):
        (tmp_path / "src" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "src" / name).write_text(name)
    ws = open_ws(spark, tmp_path)
    W.run_scan(ws)
    ids = {r.rel_path: r.id for r in ws.catalog.read("files").collect()}
    wanted = {"one": "two", "two": "three", "three": "four", "x": "y", "y": "x"}
    rows = [(ids[a], ids[a], "source", a, "source", b, 1) for a, b in wanted.items()]
    plan = spark.createDataFrame(rows, "file_id long, item_id long, src_root string, src_rel string, dst_root string, dst_rel string, size long")
    assert W.move(ws, W.planned(ws, plan, action="restore"))["moved"] == 5
    got = state(str(tmp_path / "src"))
    assert {n: t for n, t in got.items() if n in ("two", "three", "four")} == {"two": b"one", "three": b"two", "four": b"three"}
    assert sorted(got.values()) == sorted(n.encode() for n in wanted) and len(got) == 5
    assert {r.rel_path for r in ws.catalog.read("files").collect()} == set(got)
    assert W.run_undo(ws, "all", dry_run=False)["errors"] == 0
    assert {n: t.decode() for n, t in state(str(tmp_path / "src")).items() if n in ("one", "two", "three")} == {n: n for n in ("one", "two", "three")}
    ws.close()


CHILD = """
import sys
sys.path.insert(0, {repo!r})
from tidemill.plans import workspace as W
from tidemill.session import build_session
spark = build_session("child", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
ws = W.open_workspace(spark, {src!r}, {review!r}, {delete!r})
print(W.run_apply(ws, dry_run=False))
"""


def test_a_killed_process(spark, tmp_path):
    """Killed between two files, a second run ends in the same state."""
    n = 600
    for k in range(n):
        folder = tmp_path / "src" / f"d{k % 50}" / f"e{k}"
        folder.mkdir(parents=True)
        (folder / "empty.jpg").write_bytes(b"")
    ws = open_ws(spark, tmp_path)
    W.run_scan(ws)
    assert sum(W.run_classify(ws, compute=False).values()) == n
    log = ws.move_log
    ws.close()
    code = CHILD.format(repo=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), src=str(tmp_path / "src"), review=str(tmp_path / "review"), delete=str(tmp_path / "delete"))
    child = subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    until = time.time() + 120
    try:
        while time.time() < until and child.poll() is None:
            if sum(open(p).read().count("intent") for p in glob.glob(f"{log}/*/*/*.jsonl")) > 60:
                break
            time.sleep(0.005)
    finally:
        os.killpg(child.pid, signal.SIGKILL)
        child.wait()
    time.sleep(3)  # its workers end with it
    moved = len(state(str(tmp_path / "review")))
    assert moved > 0
    ws = open_ws(spark, tmp_path)
    assert not os.path.exists(log)
    recovered = ws.catalog.read("journal").count()
    W.run_apply(ws, dry_run=False)
    journal = ws.catalog.read("journal")
    assert 60 < recovered and journal.count() == n == journal.select("file_id").distinct().count()
    assert not [p for p in state(str(tmp_path / "src"))] and W.run_apply(ws)["planned"] == 0
    places = {r.rel_path for r in ws.catalog.read("files").filter("root = 'review' AND status = 'present'").collect()}
    assert len(places) == n and all(os.path.exists(tmp_path / "review" / p) for p in places)
    assert ws.catalog.read("candidates").filter(F.col("applied_op").isNull()).count() == 0
    ws.close()
