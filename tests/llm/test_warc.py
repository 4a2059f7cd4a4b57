"""WARC archives: round trips, roles, the same bytes from any split."""

import collections
import glob
import gzip
import hashlib
import os
import random

import duckdb
import pytest

from tidemill.llm import queries, warc

PAGES = "page_id long, url string, html string, digest string, `a.b` int, kind int, n string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out, copy = [], "<p>" + "é" * 80 + "</p>"
    for i in range(160):
        html = rng.choice([None, "", "short", "x" * 99, "y" * 100, copy, copy, f"<p>{rng.random()}</p>" * rng.randrange(40), "<html>\r\n\r\nWARC/1.1\r\n</html>" * 5])
        out.append((i, rng.choice([None, f"http://h/{i % 7}", "http://h/a b\n"]), html, "d", 1, 2, "n"))
    rng.shuffle(out)
    same = next(r for r in out if r[2] == copy)
    return [*out, same, same, (None, "http://h/", copy, "d", 1, 2, "n"), (None, None, "z" * 200, "d", 1, 2, "n"), (same[0], "http://other", copy, "d", 1, 2, "n")]


def expected(rows):
    """Each row's (page_id, bytes, digest, type, refers_to), counted; of equal rows one may be the response."""
    groups, out = collections.defaultdict(list), collections.Counter()
    for page_id, url, html, *_ in rows:
        raw = (html or "").encode()
        groups[raw].append((page_id is None, page_id or 0, url is not None, url or "", page_id))
    for raw, own in groups.items():
        for k, (*_, page_id) in enumerate(sorted(own, key=lambda r: r[:4])):
            first = sorted(own, key=lambda r: r[:4])[0][4]
            again = k > 0 and len(raw) >= 100
            out[page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    return out


def got(records):
    rows = records.select(records.page_id.cast("long"), "payload_bytes", "payload_digest", "record_type", records.refers_to.cast("long"))
    return collections.Counter(tuple(r) for r in rows.collect())


def bytes_of(folder):
    return {os.path.basename(f): open(f, "rb").read() for f in glob.glob(folder.removeprefix("file://") + "/*.warc.gz")}


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 5000}, {"shard_bytes": 9000, "roll_bytes": 600}])
def test_round_trip(spark, rows, tmp_path, sizes):
    folder = f"file://{tmp_path}/a"
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(5), folder, **sizes)
    files = {r.file: r for r in manifest.collect()}
    assert len({r.shard for r in files.values()}) > 3 if "shard_bytes" in sizes else len(files) == 1
    assert any(r.roll for r in files.values()) == ("roll_bytes" in sizes)
    raw = bytes_of(folder)
    assert set(raw) == set(files) and all(hashlib.sha256(raw[n]).hexdigest() == r.sha256 and len(raw[n]) == r.bytes for n, r in files.items())
    assert not os.path.exists(f"{tmp_path}/a/_temporary")
    records = warc.read_archives(spark, folder, with_payload=True)
    assert records.filter("fault is not null").count() == 0
    assert got(records) == expected(rows)
    texts = collections.Counter((r.page_id, bytes(r.payload).decode()) for r in warc.resolved(records).collect())
    assert texts == collections.Counter((None if r[0] is None else str(r[0]), r[2] or "") for r in rows)
    assert sum(r.records for r in files.values()) == len(rows) and len({r.record_id for r in records.collect()}) == len(rows)
    # offsets are places where a gzip member begins
    for r in records.limit(20).collect():
        member = gzip.decompress(raw[r.file][r.record_offset :])
        assert member.startswith(b"WARC/1.1\r\n") and r.record_id.encode() in member


def test_same_bytes(spark, rows, tmp_path):
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(1), one, shard_bytes=5000, roll_bytes=600)
    warc.write_archives(spark.createDataFrame(rows[::-1], PAGES).repartition(9), two, shard_bytes=5000, roll_bytes=600)
    assert bytes_of(one) == bytes_of(two) and len(bytes_of(one)) > 5
    with pytest.raises(FileExistsError):
        warc.write_archives(spark.createDataFrame(rows, PAGES), one)


def test_faults_and_attempts(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/a"
    warc.write_archives(spark.createDataFrame(rows, PAGES), folder)
    (name, raw), = bytes_of(folder).items()
    # a second attempt at a file finds it there and leaves it
    os.makedirs(f"{tmp_path}/a/_temporary")
    again = warc.Roll(folder, 0, 0, date=warc.DATE, level=1)
    assert again.close()[0] == name and bytes_of(folder)[name] == raw
    # another payload under the old headers is noticed
    (begins, fields, block), *_ = [r for r in warc.Source(open(f"{tmp_path}/a/{name}", "rb")).records() if r[1]["WARC-Type"] == "response"]
    assert warc.described(name, begins, fields, block)[0][-1] is None
    assert warc.described(name, begins, fields, block + b"x")[0][-1] == "block digest"
    with pytest.raises((ValueError, EOFError)):
        open(f"{tmp_path}/cut", "wb").write(raw[:-9])
        list(warc.Source(open(f"{tmp_path}/cut", "rb")).records())


def test_empty(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    assert warc.write_archives(spark.createDataFrame([], PAGES), folder).count() == 0
    assert warc.read_archives(spark, folder).count() == 0


def test_text_keys(spark, tmp_path):
    docs = spark.createDataFrame([("b\n%", None, "x" * 120), ("a", "u", "x" * 120), (None, "u", "x" * 120)], "page_id string, url string, html string")
    warc.write_archives(docs, f"file://{tmp_path}/a")
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(spark, f"file://{tmp_path}/a").collect()}
    assert found == {"a": ("response", None), "b\n%": ("revisit", "a"), None: ("revisit", "a")}


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    want = con.execute(queries.ORACLES["op11_warc_shards"])
    columns = [c[0] for c in want.description]
    found = queries.QUERIES["op11_warc_shards"](spark, sf_dir)
    assert sorted(found.columns) == sorted(columns)
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
