"""Streams against batches: rescans with a restart, bursts with late rows."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemill.operators import similar, snapshot
from tidemill.session import settings
from tidemill.sources import tree
from tidemill.streaming import bursts, rescans

STATE = "root string, rel_path string, size long, mtime_ns long, status string"


def diff_of(rows):
    return sorted((r.rel_path, r.change, r["size"], r.status) for r in rows)


def test_three_generations_one_restarted(spark, tmp_path, monkeypatch):
    """A batch that fails and is done again keeps the listing it had; diffs are those of batch scans."""
    src, out, check = tmp_path / "src", tmp_path / "out", tmp_path / "check"
    for k in range(40):
        (src / f"d{k % 4}" / f"e{k % 7}").mkdir(parents=True, exist_ok=True)
        (src / f"d{k % 4}" / f"e{k % 7}" / f"{k}.jpg").write_bytes(b"x" * k)
    want, old = [], spark.createDataFrame([], STATE)

    def batch():
        nonlocal old
        listed = tree.list_tree(spark, str(src)).select("root", "rel_path", "size", "mtime_ns")
        rows = snapshot.snapshot_diff(old, listed).collect()
        want.append(diff_of(rows))
        old = spark.createDataFrame([(r.root, r.rel_path, r["size"], r.mtime_ns, r.status) for r in rows], STATE)

    def step():
        rescans.follow_tree(spark, str(src), str(out), str(check), parts="5").awaitTermination(120)

    batch()
    step()
    (src / "d0" / "new.jpg").write_bytes(b"new")
    (src / "d1" / "e1" / "1.jpg").unlink()
    (src / "d2" / "e2" / "2.jpg").write_bytes(b"longer")
    batch()
    # the second generation fails once its listing is there
    def broken(old, seen, **more):
        assert seen.count() == 40
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(rescans, "snapshot_diff", broken)
        with pytest.raises(StreamingQueryException):
            step()
    (src / "d3" / "later.jpg").write_bytes(b"later")
    step()
    assert diff_of(spark.read.parquet(str(out / "diff=1")).collect()) == want[1]
    batch()
    if not (out / "diff=2").exists():
        step()
    got = [diff_of(spark.read.parquet(str(out / f"diff={k}")).collect()) for k in range(3)]
    assert got == want and {c for _, c, *_ in want[2]} >= {"new", "unchanged"}


def photos(rng, n):
    """Bursts of a few cameras: near and far hashes, ties, nulls, edited versions."""
    out, at = [], 1_700_000_000
    base = [rng.getrandbits(64) for _ in range(2)]
    for i in range(n):
        at += rng.choice([0, 1, 10, 20, 20, 60, 61, 2000])
        value = rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 4])))
        value -= (value >> 63) << 64
        out.append((f"cam{rng.randrange(3)}", i, at, rng.choice([value] * 9 + [None]), rng.choice([None, None, i - 1]), rng.choice([None, 1.0, 2.5]), rng.choice([10, 20, None]), 10, f"p{i}"))
    return out


DDL = "key string, id long, ts long, phash long, edited_of long, sharpness double, width int, height int, path string"


def test_bursts_are_the_groups_of_the_table(spark, tmp_path):
    rng = random.Random(8)
    rows = photos(rng, 260)
    table = spark.createDataFrame(rows, DDL)
    want = set()
    for key in ("cam0", "cam1", "cam2"):
        groups = similar.similar_groups(table.filter(F.col("key") == key)).collect()
        least = {}
        for r in groups:
            least[r.group_id] = min(least.get(r.group_id, r.id), r.id)
        want |= {(key, r.id, least[r.group_id], r.keeper_id, r.keeper_path, r.is_keeper, r.delta) for r in groups}
    assert len(want) > 30
    # files in the order of time, with rows that come up to two files late, and one row that closes everything
    files = [rows[k : k + 40] for k in range(0, len(rows), 40)]
    for k in range(2, len(files)):
        late = [r for r in files[k - 1] if files[k][-1][2] - r[2] < 9000][-3:]
        files[k - 1] = [r for r in files[k - 1] if r not in late]
        files[k] = files[k] + late
    files.append([("end", -1, rows[-1][2] + 10**6, 0, None, None, 1, 1, "end")])
    for k, own in enumerate(files):
        spark.createDataFrame(own, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with settings(spark, bursts.STATE_STORE):
        stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("ts"))
        found = bursts.similar_stream(stream, late="3 hours")
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(300)
    got = [tuple(r) for r in spark.read.schema(bursts.GROUPS).parquet(str(tmp_path / "out")).collect()]
    assert sorted(set(got) - want) == sorted(want - set(got)) == []
    assert len(got) == len(set(got))
