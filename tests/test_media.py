"""Functions, rules, links, snapshots and journal on small tables; headers and workspace on small files."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import dates, display, names, pixels
from tidemill.functions.config import ClassifyConfig
from tidemill.operators import journal, link, report, rules, similar, snapshot
from tidemill.operators.components import connected_components
from tidemill.plans import workspace as W
from tidemill.sources import headers, mover, tree
from tidemill.sources.catalog import Locked


def column(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in frame.select(expression(F.col("x"))).collect()]


def test_names(spark):
    given = ["IMG_0001.HEIC", ".DS_Store", "archive.tar.gz", "noext"]
    assert column(spark, given, names.stem) == ["IMG_0001", ".DS_Store", "archive.tar", "noext"]
    assert column(spark, given, names.ext) == ["heic", "", "gz", ""]
    assert column(spark, ["IMG_0004 (1)", "IMG_0004", "photo copy", "IMG_1234-1", "IMG_1234~2", "copy of x"], names.name_penalty) == [5, 0, 3, 2, 4, 3]
    assert column(spark, ["IMG_1.JPG", ".DS_Store"], lambda c: names.suffixed(c, F.lit(2))) == ["IMG_1~2.JPG", ".DS_Store~2"]
    assert column(spark, ["a/b/c", "", "a"], names.ancestors) == [["a", "a/b", "a/b/c"], [], ["a"]]
    assert column(spark, ["é"], names.nfc) == ["é"] and column(spark, ["é"], names.nfd) == ["é"]
    assert column(spark, ["@eaDir", "x.photoslibrary", "ok"], names.is_excluded_dir) == [True, True, False]


def test_dates(spark):
    assert column(spark, ["2020:06:05 14:03:22", "2020:13:05 14:03:22", "1800:01:01 00:00:00", None], dates.exif_to_iso) == ["2020-06-05T14:03:22", None, None, None]
    assert column(spark, ["2020-06-05T14:03:22", "2020-02-31T00:00:00"], dates.iso_to_ts) == [1591365802, None]
    assert column(spark, ["2020-06-05T14:03:22+02:00", "no"], dates.iso_local) == ["2020-06-05T14:03:22", None]
    both = spark.createDataFrame([(1_700_000_000_123_456_789, 1_700_000_000_123_456_700), (1_700_000_000_000_000_000, 1_700_000_002_000_000_000)], "a long, b long")
    assert [r[0] for r in both.select(dates.same_mtime(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_display(spark):
    assert column(spark, [5, 1280, 5 << 30], display.human_bytes, "long") == ["5 B", "1.2 KB", "5.0 GB"]
    assert [display.format_eta(x) for x in (None, 5, 65, 3700)] == ["?", "5s", "1m 05s", "1h 01m"]
    frame = spark.createDataFrame([("short_video", {"seconds": "1.25", "threshold": "3.0"}), ("duplicate_keeper", {}), ("dark", {"percent": "2.5"})], "k string, p map<string,string>")
    assert [r[0] for r in frame.select(display.reason_text(F.col("k"), F.col("p"))).collect()] == ["Video is 1.2 s long (threshold 3 s)", "duplicate_keeper", "Almost black frame (mean brightness 2%)"]


def test_pixels():
    rng = np.random.default_rng(1)
    sharp = rng.uniform(0, 255, (32, 32))
    d = pixels.dct_matrix(32)
    assert np.allclose(d @ d.T, np.eye(32))
    assert bin(pixels.phash_of(sharp) & (1 << 64) - 1).count("1") == 32
    assert pixels.sharpness_of(sharp) > 50 > 12 > pixels.sharpness_of(np.full((32, 32), 7.0)) == 0 == pixels.sharpness_of(sharp[:2])
    assert pixels.brightness_of(np.full((4, 4), 255.0)) == (1.0, 1.0)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (102, 102), (103, None)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


WIDE = "id long, item_id long, name string, stem string, ext string, kind string, size long, path string, make string, model string, software string, user_comment string, format string, width long, height long, camera_known boolean, structure_ok boolean, decode_error string, duration_ms long, brightness double, dark_p99 double, sharpness double, date_taken_ts long, phash long, edited_of long, full_hash string, a_valid boolean"


def wide(spark, *rows):
    base = dict.fromkeys(x.split()[0] for x in WIDE.split(", ")) | {"size": 10, "kind": "photo", "name": "x.jpg", "stem": "x", "ext": "jpg", "camera_known": True, "structure_ok": True, "make": "M", "a_valid": True}
    full = [base | {"item_id": r["id"], "path": f"d/{r['id']}.jpg"} | r for r in rows]
    return spark.createDataFrame([tuple(r[x.split()[0]] for x in WIDE.split(", ")) for r in full], WIDE)


def test_rules(spark):
    rows = wide(
        spark,
        {"id": 1, "full_hash": "h", "stem": "a (1)"}, {"id": 2, "full_hash": "h"},
        {"id": 3, "user_comment": " Screenshot "}, {"id": 4, "format": "png", "make": None, "width": 2532, "height": 1170},
        {"id": 5, "kind": "video", "stem": "RPReplay_Final123", "duration_ms": 2000}, {"id": 6, "kind": "video", "duration_ms": 3000},
        {"id": 7, "make": None, "structure_ok": False}, {"id": 8, "name": "._x"}, {"id": 9, "size": 0}, {"id": 10, "kind": "raw", "decode_error": "no preview"},
        {"id": 11, "brightness": 0.01, "dark_p99": 0.05, "sharpness": 1.0}, {"id": 12, "brightness": 0.5, "dark_p99": 0.9, "sharpness": 5.0}, {"id": 13, "brightness": 0.01, "dark_p99": 0.5, "sharpness": 1.0},
        {"id": 14, "phash": 0, "date_taken_ts": 100, "sharpness": 50.0}, {"id": 15, "phash": 3, "date_taken_ts": 160, "sharpness": 60.0}, {"id": 16, "phash": 7, "date_taken_ts": 215, "sharpness": 20.0}, {"id": 17, "phash": 0, "date_taken_ts": 400},
        {"id": 18, "kind": "sidecar", "ext": "aae"}, {"id": 19, "item_id": 2, "kind": "sidecar", "ext": "aae"}, {"id": 20, "software": "Android 13", "make": None},
    )
    got = {r.file_id: r for r in rules.classify(rows, run_id=7).collect()}
    assert {i: r.category for i, r in got.items()} == {1: "duplicates", 2: "duplicates", 3: "screenshots", 4: "screenshots", 5: "screen_recordings", 7: "no_camera_media", 8: "junk", 9: "junk", 10: "junk", 11: "blurry_dark", 12: "blurry_dark", 14: "similar", 15: "similar", 16: "similar", 18: "junk"}
    assert got[2].is_keeper and not got[1].is_keeper and got[1].group_id == "d7-1" and got[1].params["keeper"] == "d/2.jpg"
    assert got[4].also == ["no_camera_media"] and got[5].also == ["short_videos"] and got[7].also == ["junk"] and got[3].also == []
    assert got[15].is_keeper and got[16].group_id == "s7-1" and got[16].params["delta"] == "55"
    only = rules.classify(rows, ClassifyConfig(enabled=dict.fromkeys(["duplicates", "similar"], False), move_all_aae=True)).collect()
    assert {r.file_id for r in only} >= {19} and not {r.category for r in only} & {"duplicates", "similar"}


def test_links(spark):
    kind = "id long, root string, dir_path string, stem string, ext string, kind string, detached_at string, content_id string, duration_ms long"
    rows = [
        (1, "source", "d", "IMG_1", "heic", "photo", None, "C", None), (2, "source", "e", "IMG_1", "mov", "video", None, "C", 2000), (3, "source", "d", "IMG_2", "jpg", "photo", None, None, None),
        (4, "source", "d", "img_2", "mov", "video", None, None, 5000), (5, "source", "d", "IMG_2", "aae", "sidecar", None, None, None), (6, "source", "d", "IMG_O2", "aae", "sidecar", None, None, None),
        (7, "source", "d", "IMG_X2", "jpg", "photo", None, None, None), (8, "source", "d", "IMG_9", "aae", "sidecar", None, None, None), (9, "source", "d", "IMG_2", "mp4", "video", None, None, 6000), (10, "source", "d", "IMG_2", "m4v", "video", "t", None, 1000),
    ]
    got = {r.id: (r.item_id, r.companion_role, r.edited_of) for r in link.link_items(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: (1, None, None), 2: (1, "live_video", None), 3: (3, None, None), 4: (3, "live_video", None), 5: (3, "aae", None), 6: (3, "aae", None), 7: (7, None, None), 8: (8, None, None), 9: (9, None, None), 10: (10, None, None)}
    assert link.link_items(spark.createDataFrame([(1, "s", "d", "IMG_0003", "jpg", "photo", None, None, None), (2, "s", "d", "IMG_E0003", "jpg", "photo", None, None, None), (3, "s", "d", "A_E5", "jpg", "photo", None, None, None), (4, "s", "d", "A_5", "dng", "raw", None, None, None)], kind).filter("id > 2")).filter("id = 3").first().edited_of == 4


def test_snapshots(spark):
    old = spark.createDataFrame([("s", "a", 1, 10**9, "present"), ("s", "b", 1, 10**9, "present"), ("s", "x/c", 1, 10**9, "present"), ("s", "y/d", 1, 10**9, "present"), ("s", "e", 1, 10**9, "missing")], "root string, rel_path string, size long, mtime_ns long, status string")
    new = spark.createDataFrame([("s", "a", 1, 10**9 + 5), ("s", "b", 2, 10**9), ("s", "e", 1, 10**9), ("s", "n", 1, 1)], "root string, rel_path string, size long, mtime_ns long")
    got = {r.rel_path: (r.change, r.status, r.mtime_ns) for r in snapshot.snapshot_diff(old, new, failed_dirs=("x",)).collect()}
    assert got == {"a": ("unchanged", "present", 10**9), "b": ("changed", "present", 10**9), "x/c": ("kept", "present", 10**9), "y/d": ("missing", "missing", 10**9), "e": ("changed", "present", 10**9), "n": ("new", "present", 1)}
    have = spark.createDataFrame([(1, 5, 5, "h", 1.0), (2, 5, 5, "g", 2.0)], "file_id long, size long, mtime_ns long, full_hash string, sharpness double")
    more = spark.createDataFrame([(1, 5, 5, None, 9.0), (2, 6, 5, None, 8.0), (3, 1, 1, "k", None)], have.schema)
    merged = {r.file_id: (r.full_hash, r.sharpness, r["size"]) for r in snapshot.merge_features(have, more, ("full_hash", "sharpness")).collect()}
    assert merged == {1: ("h", 9.0, 5), 2: (None, 8.0, 6), 3: ("k", None, 1)}


def test_band_join_is_the_plain_join(spark):
    rng = np.random.default_rng(2)
    ts = rng.integers(0, 3000, 200)
    frame = spark.createDataFrame([(i, int(t)) for i, t in enumerate(ts)], "id long, ts long")
    got = {(r.a_id, r.b_id) for r in similar.band_pairs(frame, 25).collect()}
    assert got == {(i, j) for i in range(200) for j in range(200) if 0 <= ts[j] - ts[i] <= 25 and (ts[j] > ts[i] or i < j)}


def test_journal_and_report(spark):
    files = spark.createDataFrame([(1, 1, "a/x.jpg", "x.jpg", 5, "source", "present", None), (2, 1, "a/x.aae", "x.aae", 1, "source", "present", None), (3, 3, "y.jpg", "y.jpg", 7, "source", "present", None)], "id long, item_id long, rel_path string, name string, size long, root string, status string, origin_rel_path string")
    found = spark.createDataFrame([(1, "junk", None, False, None), (2, "junk", None, False, None), (3, "similar", "s1-1", False, None)], "file_id long, category string, group_id string, is_keeper boolean, applied_op string")
    plan = {r.file_id: r.dst_rel for r in journal.apply_plan(found, files, ["junk", "similar"]).collect()}
    assert plan == {1: "junk/a/x.jpg", 2: "junk/a/x.aae", 3: "similar/s1-1/y.jpg"}
    rows = report.candidate_rows(found, files)
    assert {r.category: (r.n, r.bytes) for r in report.category_report(report.category_dimension(spark), rows).filter("n > 0").collect()} == {"junk": (2, 7), "similar": (1, 7)}
    log = spark.createDataFrame([(1, "o1", 1, "to_review", 1, "review", "junk/a/x.jpg", "source", "a/x.jpg", None, "junk", 5), (2, "o2", 1, "keep", 3, "source", "y.jpg", "source", "y.jpg", None, None, 7), (3, "o3", 1, "undo", 3, "source", "y.jpg", "source", "y.jpg", None, None, 7)], "id long, op_id string, session_id long, action string, file_id long, to_root string, to_rel string, from_root string, from_rel string, undone_by long, category string, size long")
    ops = journal.undoable_ops(log)
    assert [r.op_id for r in ops.collect()] == ["o2", "o1"]
    assert [(r.undoes, r.valid) for r in journal.undo_plan(log, files, ops).collect()] == [(2, True), (1, False)]


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def exif_block():
    make = b"Canon\0"
    entries = struct.pack("<HHII", 0x10F, 2, len(make), 38) + struct.pack("<HHIHH", 0x112, 3, 1, 6, 0)
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + entries + struct.pack("<I", 0) + make


def samples():
    exif = b"Exif\0\0" + exif_block()
    jpeg = b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", 2 + len(exif)) + exif + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 480, 640, 1) + b"\xff\xda\0\2data\xff\xd9"

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1170, 2532, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"x") + chunk(b"tEXt", b"Comment\0Screenshot") + chunk(b"IEND", b"")
    mvhd = box(b"mvhd", b"\0\0\0\0" + struct.pack(">IIII", 3_600_000_000, 0, 600, 1500) + b"\0" * 80)
    stsd = box(b"stsd", b"\0\0\0\0" + struct.pack(">I", 1) + box(b"avc1", b"\0" * 24 + struct.pack(">HH", 1280, 720) + b"\0" * 50))
    stts = box(b"stts", b"\0\0\0\0" + struct.pack(">III", 1, 75, 20))
    mdia = box(b"mdia", box(b"mdhd", b"\0\0\0\0" + struct.pack(">IIII", 0, 0, 600, 1500) + b"\0" * 4), box(b"hdlr", b"\0" * 8 + b"vide" + b"\0" * 12), box(b"minf", box(b"stbl", stsd, stts)))
    mp4 = box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", mvhd, box(b"trak", mdia))
    gif = b"GIF89a" + struct.pack("<HH", 120, 90) + b"\0\0\0;"
    webp = b"RIFF" + struct.pack("<I", 30) + b"WEBPVP8X" + struct.pack("<I", 10) + b"\0\0\0\0" + (199).to_bytes(3, "little") + (99).to_bytes(3, "little")
    return {"jpg": jpeg, "png": png, "mp4": mp4, "gif": gif, "webp": webp, "tif": exif_block(), "bin": b"random bytes of no format"}


def test_headers():
    got = {}
    for ext, data in samples().items():
        got[ext] = headers.media_info(lambda at, n, d=data: d[at : at + n] if at >= 0 else b"", len(data), ext, 1_600_000_000_000_000_000)
    view = {k: (v["format"], v["width"], v["height"], v["structure_ok"]) for k, v in got.items()}
    assert view == {"jpg": ("jpeg", 640, 480, True), "png": ("png", 1170, 2532, True), "mp4": ("mp4", 1280, 720, True), "gif": ("gif", 120, 90, True), "webp": ("webp", 200, 100, True), "tif": ("tiff", None, None, True), "bin": (None, None, None, False)}
    assert got["jpg"]["make"] == got["tif"]["make"] == "Canon" and got["jpg"]["orientation"] == 6 and got["png"]["user_comment"] == "Screenshot"
    assert (got["mp4"]["duration_ms"], got["mp4"]["codec"], got["mp4"]["fps"], got["mp4"]["date_source"]) == (2500, "h264", 30.0, "quicktime_utc")
    assert got["gif"]["date_taken"] == "2020-09-13T12:26:40" and got["gif"]["date_source"] == "mtime"
    for ext, data in samples().items():  # truncated files never raise
        for cut in range(0, len(data), 7):
            headers.media_info(lambda at, n, d=data[:cut]: d[at : at + n] if at >= 0 else b"", cut, ext, 0)
    assert headers.user_comment(b"UNICODE\0" + "hé".encode("utf-16-le"), "<") == "hé" and headers.user_comment(b"ASCII\0\0\0abc\0x", ">") == "abc"


def test_codec_names_and_long_values():
    mp4 = samples()["mp4"]
    for name, codec in headers.CODECS.items():
        data = mp4.replace(b"avc1", name)
        assert headers.media_info(lambda at, n, d=data: d[at : at + n] if at >= 0 else b"", len(data), "mov", 0)["codec"] == codec
    assert headers.CODECS[b"mjpa"] == "mjpeg"
    # a value of 3 MB is read, one of 5 MB is left out, and a directory may have over 512 entries
    for size, kept in ((3 << 20, True), (5 << 20, False)):
        text = b"m" * (size - 1) + b"\0"
        rows = b"".join(struct.pack("<HHII", 0x9000, 4, 1, 0) for _ in range(600)) + struct.pack("<HHII", 0x10F, 2, size, 2 + 601 * 12 + 4)
        data = struct.pack("<H", 601) + rows + struct.pack("<I", 0) + text
        found, _ = headers.directory(lambda at, n: data[at : at + n], 0, 0, "<")
        assert (0x10F in found) == kept and len(found) == 1 + kept


def test_heif():
    """A HEIF file: its item's size from the properties, its EXIF from the item location box."""
    exif = struct.pack(">I", 6) + b"Exif\0\0" + exif_block()
    ftyp = box(b"ftyp", b"heic\0\0\0\0mif1heic")
    infe = box(b"infe", b"\2\0\0\0" + struct.pack(">HH", 1, 0) + b"hvc1\0"), box(b"infe", b"\2\0\0\0" + struct.pack(">HH", 2, 0) + b"Exif\0")
    iinf = box(b"iinf", b"\0\0\0\0" + struct.pack(">H", 2) + b"".join(infe))
    pitm = box(b"pitm", b"\0\0\0\0" + struct.pack(">H", 1))
    ispe = box(b"ispe", b"\0\0\0\0" + struct.pack(">II", 4032, 3024))
    iprp = box(b"iprp", box(b"ipco", ispe), box(b"ipma", b"\0\0\0\0" + struct.pack(">IHBB", 1, 1, 1, 1)))

    def whole(at):
        iloc = box(b"iloc", b"\0\0\0\0" + bytes([0x44, 0x00]) + struct.pack(">H", 1) + struct.pack(">HHHII", 2, 0, 1, at, len(exif)))
        return ftyp + box(b"meta", b"\0\0\0\0", box(b"hdlr", b"\0" * 8 + b"pict" + b"\0" * 13), pitm, iinf, iprp, iloc)

    data = whole(len(whole(0)) + 8) + box(b"mdat", exif)
    info = headers.media_info(lambda at, n: data[at : at + n] if at >= 0 else b"", len(data), "heic", 0)
    assert (info["format"], info["width"], info["height"], info["make"]) == ("heic", 4032, 3024, "Canon")


def test_sniffing(spark):
    rows = [(bytearray(d), e) for e, d in samples().items()]
    got = spark.createDataFrame(rows, "head binary, ext string").select(headers.sniff_format(F.col("head"), F.col("ext"))).collect()
    assert [r[0] for r in got] == ["jpeg", "png", "isobmff", "gif", "webp", "tiff", "unknown"]


@pytest.fixture
def archive(tmp_path):
    for rel, data in {"2020/IMG_1.JPG": samples()["jpg"], "2020/IMG_1 (1).JPG": samples()["jpg"], "2020/shot.png": samples()["png"], "clip.mp4": samples()["mp4"], ".DS_Store": b"x", "empty.jpg": b"", "@eaDir/no.jpg": b"x", "lone.aae": b"<x/>"}.items():
        path = tmp_path / "src" / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return tmp_path


def contents(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and W.CATALOG_DIR not in p.parts}


def test_tree(spark, archive):
    rows = tree.list_tree(spark, str(archive / "src")).collect()
    assert {r.rel_path for r in rows} == {"2020/IMG_1.JPG", "2020/IMG_1 (1).JPG", "2020/shot.png", "clip.mp4", ".DS_Store", "empty.jpg", "lone.aae"}
    assert {r.rel_path for r in tree.list_tree(spark, str(archive / "src"), recursive=False).collect()} == {"clip.mp4", ".DS_Store", "empty.jpg", "lone.aae"}
    assert tree.check_roots(str(archive / "none"))[0] == ["source_missing"] and tree.check_roots(str(archive / "src"), str(archive))[0] == ["review_contains_source"]


def test_workspace(spark, archive):
    before = contents(archive / "src")
    ws = W.open_workspace(spark, str(archive / "src"), str(archive / "review"), str(archive / "delete"))
    assert W.run_scan(ws) == {"new": 7, "changed": 0, "unchanged": 0, "missing": 0, "failed_dirs": 0}
    assert W.run_scan(ws)["unchanged"] == 7
    counts = W.run_classify(ws)
    assert counts == {"duplicates": 1, "screenshots": 1, "screen_recordings": 1, "junk": 3}
    plan = W.get_plan(ws)
    assert plan["totals"]["candidates"] == 6 and [c["n"] for c in plan["categories"]] == [1, 1, 1, 0, 0, 3, 0, 0]
    assert W.run_apply(ws)["planned"] == 6 and contents(archive / "src") == before
    assert W.run_apply(ws, dry_run=False) == {"moved": 6, "errors": 0}
    assert sorted(contents(archive / "src").values()) == sorted([samples()["jpg"], b"x"]) and W.run_apply(ws)["planned"] == 0
    W.write_reports(ws, str(archive / "report"))
    assert os.path.exists(archive / "report" / "plan.json")
    assert W.run_undo(ws, "category", category="junk", dry_run=False)["moved"] == 3
    assert W.run_undo(ws, "all", dry_run=False)["moved"] == 3
    assert contents(archive / "src") == before
    assert W.run_item_action(ws, [ws.catalog.file_by_path("source", "empty.jpg")["id"]], "to_delete", dry_run=False)["moved"] == 1
    assert W.run_purge(ws, dry_run=False) == {"files": 1, "bytes": 0, "errors": 0}
    assert W.status(ws)["roots"]["source"]["files"] == 6
    with pytest.raises(Locked):
        W.CatalogLock(os.path.dirname(ws.lock.path)).acquire()
    ws.close()


def test_moves_never_overwrite(tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text(name)
    assert mover.move_file(str(tmp_path / "a.txt"), str(tmp_path / "b.txt"), dry_run=False)[0].endswith("b~2.txt")
    assert (tmp_path / "b.txt").read_text() == "b.txt" and (tmp_path / "b~2.txt").read_text() == "a.txt"


def gray_png(pixels):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_analysis_takes_every_file(spark, tmp_path, monkeypatch):
    """Several batches of photos; what is stored isn't read again."""
    monkeypatch.setattr(W, "PATHS", 2, raising=False)
    (tmp_path / "src").mkdir()
    shots = [gray_png(np.random.default_rng(k).integers(0, 255, (40, 40)).astype(np.uint8)) for k in range(3)]
    for k in range(6):
        (tmp_path / "src" / f"p{k}.png").write_bytes(shots[k // 2])
    ws = W.open_workspace(spark, str(tmp_path / "src"), str(tmp_path / "review"), str(tmp_path / "delete"))
    W.run_scan(ws)
    W.run_analysis(ws)
    first = sorted(ws.catalog.read("file_analysis").collect())
    assert len(first) == 6 and all(r.full_hash and r.phash is not None for r in first) and len({r.full_hash for r in first}) == 3
    for k in range(6):
        (tmp_path / "src" / f"p{k}.png").unlink()
    W.run_analysis(ws)
    assert sorted(ws.catalog.read("file_analysis").collect()) == first
    ws.close()


def test_manual_actions(spark, archive):
    """One operation an item, kept items are reviewed and journaled, undo clears the mark; a lost journal is found again."""
    ws = W.open_workspace(spark, str(archive / "src"), str(archive / "review"), str(archive / "delete"))
    W.run_scan(ws)
    before = contents(archive / "src")
    ids = [ws.catalog.file_by_path("source", x)["id"] for x in ("clip.mp4", "2020/shot.png", "empty.jpg")]
    assert W.run_item_action(ws, ids[:2], "keep", dry_run=False) == {"moved": 0, "errors": 0, "kept": 2}
    assert all(ws.catalog.file(i)["reviewed_at"] for i in ids[:2]) and not ws.catalog.file(ids[2])["reviewed_at"]
    assert contents(archive / "src") == before and ws.catalog.read("journal").select("op_id").distinct().count() == 2
    assert W.run_undo(ws, "last", dry_run=False)["moved"] == 1
    assert sum(bool(ws.catalog.file(i)["reviewed_at"]) for i in ids) == 1
    W.run_item_action(ws, [ids[2]], "to_delete", dry_run=False)
    assert W.run_item_action(ws, [ids[2]], "to_delete", dry_run=False) == {"moved": 0, "errors": 0}
    assert W.run_group_decision(ws, [ids[2]], [ids[0]], dry_run=False)[1]["moved"] == 1
    assert ws.catalog.file(ids[2])["root"] == "source" and ws.catalog.file(ids[0])["root"] == "delete"

    # the process dies after a move, before its journal is written
    moves = [{"op_id": "lost", "action": "to_review", "file_id": ids[1], "item_id": ids[1], "src_root": "source", "src_rel": "2020/shot.png", "dst_root": "review", "dst_rel": "junk/shot.png", "size": 1}]
    assert [m["method"] for m in mover.carry_out(moves, ws.roots, dry_run=False, log=ws.move_log)] == ["rename"]
    rows = ws.catalog.read("journal").count()
    ws.close()
    ws = W.open_workspace(spark, str(archive / "src"), str(archive / "review"), str(archive / "delete"))
    assert ws.catalog.read("journal").count() == rows + 1 and ws.catalog.file(ids[1])["root"] == "review" and not os.path.exists(ws.move_log)
    assert W.run_undo(ws, "all", dry_run=False)["errors"] == 0
    assert contents(archive / "src") == before
    ws.close()


def test_pointers_survive(spark, archive):
    ws = W.open_workspace(spark, str(archive / "src"), str(archive / "review"), str(archive / "delete"))
    for k in range(3):
        ws.catalog.set_setting("k", k)
    assert ws.catalog.setting("k") == 2 and ws.catalog.vacuum("settings") == 2 and ws.catalog.setting("k") == 2
    (archive / "review" / W.CATALOG_DIR / "settings" / "next-v-dead").write_text("v-dead")  # a writer that died before its rename
    assert ws.catalog.setting("k") == 2
    ws.close()


def test_numbers_follow_the_order(spark):
    from tidemill.operators.numbering import numbered

    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(5)
    got = numbered(rows, "v", start=10).collect()
    assert {(r.v, r.nth) for r in got} == {(v, v + 11) for v in range(5000)}


def test_quantiles_and_hash_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [(k % 3 if k % 50 else None, float(v)) for k, v in enumerate(rng.normal(size=2000))] + [(7, 1.5), (8, 2.0), (8, 2.0), (9, None)]
    got = {r.k: r for r in report.quantiles(spark.createDataFrame(rows, "k int, v double"), "k", "v", {"p99": 0.99, "mid": 0.5}, buckets=16).collect()}
    for k in (0, 1, 2, None, 7, 8):
        own = [v for a, v in rows if a == k and v is not None]
        assert np.allclose([got[k].p99, got[k].mid], np.percentile(own, [99, 50]))
    hashes = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 60)]
    hashes += [h ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)) - (0) if n else h for h, n in zip(hashes[:20], range(20), strict=True)]
    hashes = [h - (1 << 64) if h >= 1 << 63 else h for h in hashes]
    frame = spark.createDataFrame(list(enumerate(hashes)), "id long, phash long")
    apart = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    for limit in (3, 11):
        want = {(a, b) for a in range(80) for b in range(a + 1, 80) if apart(hashes[a], hashes[b]) <= limit}
        assert {(r.a, r.b) for r in similar.hash_pairs(frame, limit).collect()} == want


def test_streams(spark, tmp_path):
    """Listings that arrive one after the other give diffs; windows close behind the watermark."""
    from tidemill.streaming import follow

    for k, sizes in enumerate([{"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 4}, {"b": 3}]):
        rows = spark.createDataFrame([("source", p, n, 10**9) for p, n in sizes.items()], "root string, rel_path string, size long, mtime_ns long").withColumn("scan_ts", F.current_timestamp())
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        follow.follow_listings(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
        got = {r.rel_path: r.change for r in spark.read.parquet(str(tmp_path / "out" / f"diff={k}")).collect()}
        assert got == [{"a": "new", "b": "new"}, {"a": "unchanged", "b": "changed", "c": "new"}, {"a": "missing", "b": "unchanged", "c": "missing"}][k]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 2.0), ("2024-01-01 03:00:00", "y", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = follow.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    stream.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "check2")).trigger(availableNow=True).start().awaitTermination(120)
    assert [(r.event_type, r.n, r.value) for r in spark.table("closed").collect()] == [("x", 2, 3.0)]


def test_turned_photos(spark, tmp_path):
    """A photo and its copy stored turned, with the orientation that turns it back, have the same features; names with pattern signs are read."""
    from tidemill.sources import images

    upright = np.random.default_rng(3).integers(0, 255, (40, 60)).astype(np.uint8)
    (tmp_path / "a [1].png").write_bytes(gray_png(upright))
    (tmp_path / "b.png").write_bytes(gray_png(np.ascontiguousarray(np.rot90(upright))))  # orientation 6 shows it turned clockwise
    turns = spark.createDataFrame([(str(tmp_path / "b.png"), 6)], "path string, orientation int")
    got = {os.path.basename(r.path): r for r in images.image_features(spark, [f"file://{tmp_path}/a [1].png", f"file://{tmp_path}/b.png"], turns).collect()}
    a, b = got["a [1].png"], got["b.png"]
    assert a.phash == b.phash and a.sharpness == b.sharpness and a.brightness == b.brightness
    assert images.image_features(spark, [f"file://{tmp_path}/b.png"]).first().phash != a.phash


def test_similar_links_are_all_near_pairs(spark):
    rng = np.random.default_rng(12)
    base = int(rng.integers(-(1 << 62), 1 << 62))
    hashes = [base]
    for n in range(70):
        flipped = base & (1 << 64) - 1
        for b in rng.choice(64, n % 9, replace=False):
            flipped ^= 1 << int(b)
        hashes.append(flipped - (1 << 64) if flipped >= 1 << 63 else flipped)
    ts = [int(x) for x in rng.integers(0, 90, len(hashes))]
    rows = [(i, ts[i], h, i - 1 if i % 10 == 9 else None) for i, h in enumerate(hashes)]
    frame = spark.createDataFrame(rows, "id long, ts long, phash long, edited_of long")
    apart = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    for distance in (0, 6):
        want = {frozenset((i, j)) for i in range(71) for j in range(i) if abs(ts[i] - ts[j]) <= 30 and apart(hashes[i], hashes[j]) <= distance and not (i % 10 == 9 and j == i - 1)}
        got = [frozenset((r.a, r.b)) for r in similar.similar_links(frame, 30, distance).collect()]
        assert set(got) == want and len(got) == len(want)


def test_a_file_that_moves_twice_stays_one_row(spark):
    from tidemill.operators import snapshot

    files = spark.createDataFrame([(1, "delete", "d/a.jpg", "x/a.jpg", "a.jpg", "d", "a", "jpg", None), (2, "source", "b.jpg", None, "b.jpg", "", "b", "jpg", None)], "id long, root string, rel_path string, origin_rel_path string, name string, dir_path string, stem string, ext string, rel_path_os string")
    moves = spark.createDataFrame([(9, 1, "r/a.jpg", "source", "x/a.jpg"), (8, 1, "d/a.jpg", "review", "r/a.jpg")], "id long, file_id long, from_rel string, to_root string, to_rel string")
    rows = {r.id: r for r in snapshot.relocated(files, moves).collect()}
    assert len(rows) == 2 and rows[2].rel_path == "b.jpg" and rows[2].root == "source"
    assert (rows[1].root, rows[1].rel_path, rows[1].dir_path, rows[1].origin_rel_path) == ("source", "x/a.jpg", "x", None)


def test_first_free_names(spark):
    """Names among the moves, gaps, dotfiles and names without extension, as if the moves were made one by one."""
    import random

    from tidemill.functions import names
    from tidemill.operators import journal

    rng, moves, taken = random.Random(7), [], set()
    for k in range(400):
        moves.append((k, f"d{k % 3}", rng.choice(["a.jpg", "a.jpg", "a~2.jpg", "a~2~2.jpg", "b.tar.gz", ".rc", ".rc~2", "plain", "plain~3", "x~12.png", "~2.jpg"]), k))
    moves += [(1000 + k, "one", "c.mov", k) for k in range(30)]
    moves += [(2000, "gap", "a.jpg", 1), (2001, "two", "a.jpg", 1), (2002, "two", "a.jpg", 1), (2003, "two", "a~2.jpg", 1)]
    taken = {(f"d{k % 3}", n) for k in range(9) for n in rng.sample(["a.jpg", "a~2.jpg", "a~5.jpg", "b.tar~2.gz", ".rc", "plain~2", "x~12~2.png"], 3)}
    taken |= {("one", n) for n in ("c.mov", "c~2.mov", "c~3.mov", "c~7.mov", "c~9.mov", "c~07.mov", "c~8.MOV", "c~1.mov", "c~99999999999.mov")} | {("gap", "a~7.jpg")}
    held, want = set(taken), {}
    for k, folder, name, _ in moves:
        n = 1
        while (folder, names.suffixed_name(name, n)) in held:
            n += 1
        want[k] = names.suffixed_name(name, n)
        held.add((folder, want[k]))
    table = spark.createDataFrame(moves, "id long, folder string, name string, n int")
    got = journal.unique_names(table, spark.createDataFrame(sorted(taken), "folder string, name string"))
    assert got.columns == ["id", "folder", "name", "n", "unique_name"]
    assert {r.id: r.unique_name for r in got.collect()} == want
    assert (want[2000], want[2001], want[2002], want[2003]) == ("a.jpg", "a.jpg", "a~2.jpg", "a~2~2.jpg")
    assert len({(f, want[k]) for k, f, *_ in moves}) == len(moves)
    assert names.suffixed_name("a.", 2) == column(spark, ["a."], lambda c: names.suffixed(c, F.lit(2)))[0]


def test_components_follow_changes(spark):
    """Inserted and deleted edges: contraction and splitting give what all edges give."""
    import random

    from tidemill.operators.components import updated_components

    rng, ddl = random.Random(3), "a long, b long"
    edges = {tuple(sorted(rng.sample(range(120), 2))) for _ in range(70)}
    comps = connected_components(spark.createDataFrame(sorted(edges), ddl))
    for _ in range(2):
        gone = set(rng.sample(sorted(edges), 8))
        new = {tuple(sorted(rng.sample(range(140), 2))) for _ in range(8)} - edges
        edges = (edges - gone) | new
        after = spark.createDataFrame(sorted(edges), ddl)
        comps = updated_components(comps, after, spark.createDataFrame(sorted(new), ddl), spark.createDataFrame(sorted(gone), ddl))
        assert sorted(comps.collect()) == sorted(connected_components(after).collect())
    same = updated_components(comps, after, after.limit(0), after.limit(0))
    assert sorted(same.collect()) == sorted(comps.collect())


def test_dct_on_the_jvm(spark):
    rng = np.random.default_rng(6)
    for width in (8, 32):
        frames = [rng.integers(0, 255, (width, width)).astype(float) for _ in range(6)]
        table = spark.createDataFrame([(f.reshape(-1).tolist(),) for f in frames], "v array<double>")
        assert [r[0] for r in table.select(pixels.dct_bits(F.col("v"), width)).collect()] == [pixels.phash_of(f) for f in frames]


def test_pages_by_rank(spark):
    """A page reads its ranges only, at the list's start, middle and end, and beyond."""
    from tidemill.operators.listing import RankedList

    rows = spark.range(1000).selectExpr("id", "id % 7 AS k")
    ranked = RankedList(rows, F.col("k").desc(), F.col("id").asc(), ranges=9)
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert ranked.size == 1000 and len(ranked.starts) == 9
    for start, limit in ((0, 10), (95, 30), (500, 1), (990, 50), (2000, 5)):
        assert [r.id for r in ranked.page(start, limit).collect()] == want[start : start + limit]
    plan = ranked.page(500, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in plan and "Exchange rangepartitioning" not in plan
    assert [r.id for r in ranked.around(3, 10).collect()] == want[:10]
    assert RankedList(rows.limit(0), F.col("id")).page(0, 10).count() == 0


def test_digests_are_taken_once(spark, sf_dir, monkeypatch):
    """The funnel's queries read documents in one job, and nothing after that reads texts."""
    from tidemill.operators import dedupe
    from tidemill.plans import catalogue

    plans, written = [], dedupe.cut

    def noted(rows, tag):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return written(rows, tag)

    monkeypatch.setattr(dedupe, "cut", noted)
    for name in ("exact_duplicates", "dedupe_funnel"):
        plans.clear()
        out = catalogue.QUERIES[name](spark, sf_dir)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        assert sum("text#" in p for p in plans) == 1 and plans[0].count("Relation") == 1


def test_console_report_and_lists(spark, archive, tmp_path):
    """The report as lines, in two languages; CSV columns; where a host had its folders; only photos with neighbours in time."""
    from tidemill.plans.console import plan_lines
    from tidemill.sources import sinks

    ws = W.open_workspace(spark, str(archive / "src"), str(archive / "review"), str(archive / "elsewhere"))
    assert "No classification yet" in next(plan_lines(W.get_plan(ws)))
    W.run_scan(ws)
    W.run_classify(ws)
    lines = "\n".join(plan_lines(W.get_plan(ws)))
    assert "File is empty (0 bytes)" in lines and "junk" in lines and "total (enabled)" in lines and "Report only" in lines
    assert "Пустой файл (0 байт)" in "\n".join(plan_lines(W.get_plan(ws, lang="ru"), lang="ru"))
    rows = sinks.candidate_rows(ws.catalog.candidates(), ws.catalog.read("files"))
    assert rows.columns == ["category", *sinks.CANDIDATE_COLUMNS] and {r.root for r in rows.collect()} == {"source"} and {r.keeper for r in rows.collect()} <= {0, 1}
    ws.close()
    again = W.open_workspace(spark, str(archive / "src"), str(archive / "review"))
    assert again.roots["delete"] == str(archive / "elsewhere")
    again.close()


def test_network_volumes(tmp_path):
    table = tmp_path / "mounts"
    table.write_text("/dev/sda / ext4 rw 0 0\nnas:/x /mnt/the\\040nas nfs4 rw 0 0\n")
    assert tree.network_volume("/mnt/the nas/photos", str(table)) and not tree.network_volume("/home/x", str(table)) and not tree.network_volume("/x", str(tmp_path / "none"))


def test_pixels_of_neighbours_only(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for k in range(4):
        (tmp_path / "src" / f"p{k}.png").write_bytes(gray_png(np.random.default_rng(k).integers(0, 255, (40, 40)).astype(np.uint8)))
        os.utime(tmp_path / "src" / f"p{k}.png", (1_600_000_000 + 1000 * (k // 2) * (k + 1),) * 2)
    ws = W.open_workspace(spark, str(tmp_path / "src"), str(tmp_path / "review"), str(tmp_path / "delete"))
    W.run_scan(ws)
    cfg = ClassifyConfig().with_overrides(enabled={c: c == "similar" for c in ("duplicates", "screenshots", "screen_recordings", "short_videos", "no_camera_media", "junk", "blurry_dark", "similar")})
    W.run_analysis(ws, cfg)
    names = {r.id: r.name for r in ws.catalog.read("files").collect()}
    assert {names[r.file_id] for r in ws.catalog.read("file_analysis").filter("phash is not null").collect()} == {"p0.png", "p1.png"}
    W.run_analysis(ws)
    assert ws.catalog.read("file_analysis").filter("phash is not null").count() == 4
    ws.close()


def test_reevaluation_is_a_new_run_with_the_old_number(spark, archive, monkeypatch):
    """Other settings give what a new classification gives; unchanged rules aren't worked out, similar groups only if need be."""
    ws = W.open_workspace(spark, str(archive / "src"), str(archive / "review"), str(archive / "delete"))
    with pytest.raises(ValueError):
        W.run_reevaluate(ws, ClassifyConfig())
    W.run_scan(ws)
    W.run_classify(ws)
    run, sought, worked = ws.catalog.setting("last_run"), [], []
    groups, matched = rules.similar_groups, rules.matches_of
    monkeypatch.setattr(rules, "similar_groups", lambda *a, **k: sought.append(1) or groups(*a, **k))
    monkeypatch.setattr(rules, "matches_of", lambda *a, **k: worked.append(k.get("only")) or matched(*a, **k))
    view = lambda found: sorted((r.file_id, r.category, r.reason, str(r.params), r.group_id, r.is_keeper, str(r.also)) for r in found.collect())
    seen = set()
    for changes, rules_again in (({"short_video_seconds": 20.0}, [["short_videos"]]), ({"similar_distance": 9}, []), ({"enabled": {"junk": False}}, []), ({"move_all_aae": True, "enabled": {"junk": True}}, [["junk"]])):
        cfg = ws.catalog.config().with_overrides(**changes)
        sought.clear(), worked.clear()
        W.run_reevaluate(ws, cfg)
        assert worked == rules_again and ws.catalog.setting("last_run") == run
        seen.add(len(sought))
        got = ws.catalog.candidates()
        assert {r.run_id for r in got.collect()} == {run}
        assert view(got) == view(rules.classify(W.wide(ws), cfg, run_id=run))
    assert seen == {0, 1}
    ws.close()


def test_embedded_previews(spark, tmp_path):
    """A RAW file and a JPEG are seen by their embedded preview, turned by their orientation; a small one isn't taken."""
    import bench_media
    from tidemill.sources import images

    body = bench_media.jpeg_body(spark, 160, 120)
    small = bench_media.jpeg_body(spark, 80, 60)

    def tiff(preview, orientation):
        entries = [(0x103, 3, 1, 6), (0x111, 4, 1, 1000), (0x112, 3, 1, orientation), (0x117, 4, 1, len(preview))]
        head = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
        return head.ljust(1000, b"\0") + preview

    src = tmp_path / "src"
    src.mkdir()
    (src / "raw.nef").write_bytes(tiff(body, 1))
    (src / "turned.nef").write_bytes(tiff(body, 6))
    (src / "tiny.nef").write_bytes(tiff(small, 1))
    (src / "plain.jpg").write_bytes(body)
    ws = W.open_workspace(spark, str(src), str(tmp_path / "review"), str(tmp_path / "delete"))
    W.run_scan(ws)
    names = {r.id: r.name for r in ws.catalog.read("files").collect()}
    meta = {names[r.file_id]: (r.preview_kind, r.preview_offset) for r in ws.catalog.read("file_meta").collect()}
    assert meta["raw.nef"] == ("jpeg", 1000) == meta["tiny.nef"]
    W.run_analysis(ws)
    got = {names[r.file_id]: (r.phash_source, r.phash) for r in ws.catalog.read("file_analysis").collect()}
    assert got["raw.nef"] == ("embedded", got["plain.jpg"][1]) and got["plain.jpg"][0] == "decode"
    assert got["turned.nef"][0] == "embedded" and got["turned.nef"][1] != got["raw.nef"][1]
    assert got.get("tiny.nef", (None, None))[0] is None
    before = sorted(ws.catalog.read("file_analysis").collect())
    W.run_analysis(ws)
    assert sorted(ws.catalog.read("file_analysis").collect()) == before
    ws.close()
    assert images.LEAST_PREVIEW == 96
