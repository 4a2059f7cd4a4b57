"""What only shows on tables larger than the given ones, or on rows that these don't hold."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidemill.operators import similar
from tidemill.plans import catalogue
from tidemill.session import settings
from tidemill.streaming import bursts


def test_sizes_above_a_gigabyte_and_null(spark, tmp_path):
    ids = [None, -3, 0, 1, 2, 1023, 1024, 2_093_062, 2_093_063, 5_999_999, 40_000_000]
    spark.createDataFrame([(i,) for i in ids], "event_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    want = duckdb.sql(catalogue.ORACLES["human_sizes"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    got = [(r.event_id, r["size"]) for r in catalogue.QUERIES["human_sizes"](spark, str(tmp_path)).collect()]
    assert set(got) == set(want) and len(got) == len(ids) and (5_999_999, "2935.4 MB") in got and (None, None) in got


def test_many_alike_photos_of_one_moment(spark, tmp_path):
    """30,000 photos of two looks within one window have 225 million links; the groups come without them."""
    n = 30_000
    photo = F.lit(1_700_000_000) + F.when(F.col("id") == n, 10**7).otherwise(F.col("id") * 50 % 1013)
    rows = spark.range(n + 1).select(F.lit("cam").alias("key"), "id", F.timestamp_seconds(photo).alias("ts"), (F.col("id") % 2 * 255).alias("phash"), F.lit(None).cast("long").alias("edited_of"), (F.col("id") % 1000).cast("double").alias("sharpness"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.concat(F.lit("p"), "id").alias("path"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    with settings(spark, bursts.STATE_STORE):
        found = bursts.similar_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), window=3600)
        stream = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        try:
            assert stream.awaitTermination(120)
        finally:
            stream.stop()
    got = spark.read.schema(bursts.GROUPS).parquet(str(tmp_path / "out")).groupBy("component", "keeper_id", "keeper_path").agg(F.count_distinct("id").alias("n"), F.sum(F.col("is_keeper").cast("int")).alias("kept"), F.max("delta").alias("most")).collect()
    at = [k * 50 % 1013 for k in range(n)]
    far = {keeper: max(abs(at[k] - at[keeper]) for k in range(keeper % 2, n, 2)) for keeper in (998, 999)}
    assert {tuple(r) for r in got} == {(0, 998, "p998", n // 2, 1, far[998]), (1, 999, "p999", n // 2, 1, far[999])}


def test_burst_groups_are_those_of_all_links():
    rng = random.Random(3)
    for _ in range(400):
        n, window, distance = rng.randrange(1, 40), rng.choice([0, 1, 5, 60]), rng.choice([0, 1, 6])
        looks = [rng.getrandbits(64) for _ in range(2)]
        ids = rng.sample(range(60), n) if rng.random() < 0.7 else [rng.randrange(n) for _ in range(n)]
        rows = sorted((rng.randrange(-50, 100), i, rng.choice([i, i, rng.choice(ids), 99]), rng.choice(looks) ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 0, 1, 3])))) for i in ids)
        roots = list(range(n))
        for i in range(n):
            for j in range(i + 1, n):
                (s, a, e, v), (t, b, f, w) = rows[i], rows[j]
                if t - s <= window and (v ^ w).bit_count() <= distance and a not in (b, f) and e != b:
                    low, high = sorted((roots[i], roots[j]))
                    roots = [low if r == high else r for r in roots]
        at, id, edited = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        assert bursts.burst_roots(at, id, np.array([r[3] for r in rows], np.uint64).view(np.int64), edited, window, distance).tolist() == roots


def test_hashes_that_probing_would_look_up_too_often(spark, monkeypatch):
    """Pairs and groups are the same by probing and by blocks, with copies and repeated ids; a distance of 18 bits is compared, whatever the number of rows."""
    rng = np.random.default_rng(4)
    hashes = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 300)]
    hashes += [h ^ (1 << int(b)) ^ (1 << 3) for h, b in zip(hashes[:60], rng.integers(0, 62, 60), strict=True)] + hashes[100:140] + [hashes[7]] * 5
    rows = [(f"v{k % 390:03d}", h) for k, h in enumerate(hashes)] + [(None, hashes[0]), ("n", None)]
    frame = spark.createDataFrame(rows, "vec string, h long").repartition(3)
    known, n = similar._known(frame, "vec", "h")
    own = [(i, h) for i, h in rows if i is not None and h is not None]
    assert n == len(own)
    for distance in (0, 2, 6, 18):
        want = sorted((a, b, ((v ^ w) & (1 << 64) - 1).bit_count()) for a, v in own for b, w in own if a < b and ((v ^ w) & (1 << 64) - 1).bit_count() <= distance)
        near = {}
        for a, b, _ in want:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        groups, seen = {}, set()
        for start in sorted(near):
            todo = [] if start in seen else [start]
            while todo:
                at = todo.pop()
                if at not in seen:
                    seen.add(at)
                    groups[at] = start
                    todo += near[at]
        for least in (4, 1 << 12):
            monkeypatch.setattr(similar, "LEAST_BLOCK", least)
            assert sorted(tuple(r) for r in similar.compared_pairs(known, n, distance).collect()) == want
            assert {r.id: r.component for r in similar.hash_groups(frame, distance, id="vec", value="h").collect()} == groups
        if distance < 18:
            assert sorted(tuple(r) for r in similar.probed_pairs(known, n, distance).collect()) == want
    assert [similar._probing_pays(n, 18) for n in (500, 10**5, 10**6, 10**8)] == [False] * 4 and similar._probing_pays(10**6, 3)


def test_groups_of_copies_list_no_pairs(spark):
    """4,000 copies have 8 million pairs, 1,000 rows that are all alike half a million; links stay about as many as the rows."""
    rows = spark.createDataFrame([(k, 5 if k < 4000 else 1 << k % 60 ^ k % 7) for k in range(5000)], "id long, h long")
    known, n = similar._known(rows, "id", "h")
    assert n == 5000 and similar.compared_links(known, 18).count() < 2 * n
    groups = similar.hash_groups(rows, 18, value="h").collect()
    assert len(groups) == 5000 and {r.component for r in groups} == {0}
