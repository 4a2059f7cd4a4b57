"""More registered queries: the rules, links, move plans and lists, each through its operator, with SQL.

The driver's tables hold no media files, so rows with the columns of the catalog are made from `part`, `documents` and `conversations`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import constants as C
from tidemill.functions import names
from tidemill.functions.config import ClassifyConfig
from tidemill.operators import journal, link, listing, rules
from tidemill.plans.catalogue import _CANDIDATES, document_candidates, query, seconds
from tidemill.session import read_table as table
from tidemill.streaming import follow

CFG = ClassifyConfig()


def null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def pick(key: Column, *values: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


# -- rules -------------------------------------------------------------------------------------------------------------------------


def media_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide rows: every value follows from p_partkey."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, F.col("p_size").cast("long").alias("p_size"))
    stem = F.when(k % 12 == 1, F.concat(F.lit("RPReplay_Final"), k.cast("string"))).otherwise(F.concat(F.lit("IMG_"), k.cast("string")))
    rows = rows.withColumn("stem", stem).withColumn("kind", pick(k, "photo", "video", "raw", "sidecar")).withColumn("ext", pick(k, "jpg", "mp4", "dng", "aae"))
    name = F.when(k % 23 == 0, "Thumbs.db").when(k % 29 == 0, F.concat(F.lit("._"), "stem")).otherwise(F.concat("stem", F.lit("."), "ext"))
    made = {
        "id": k, "item_id": F.when(k % 10 == 9, k - 1).otherwise(k), "name": name, "size": F.when(k % 17 == 0, 0).otherwise(F.col("p_size")), "path": F.concat(F.lit("d/"), F.col("stem")),
        "make": F.when(k % 3 == 0, "Canon"), "model": null("string"), "software": F.when((k % 3 == 1) & (k % 7 == 0), "Android 13"), "user_comment": F.when(k % 20 == 0, " Screenshot "), "format": F.when(k % 5 == 0, "png").otherwise("jpeg"),
        "width": F.when(k % 6 == 1, 2532).when(k % 6 == 2, 1170).otherwise(640), "height": F.when(k % 6 == 1, 1170).when(k % 6 == 2, 2532).otherwise(480), "camera_known": k % 8 != 7, "structure_ok": k % 13 != 0, "decode_error": F.when(k % 19 == 0, "bad data"),
        "duration_ms": (k % 9) * 700, "brightness": (k % 50) / 100.0, "dark_p99": (k % 21) / 100.0, "sharpness": (k % 31).cast("double"), "a_valid": k % 11 != 0,
    }
    return rows.withColumns({c: v for c, v in made.items() if c not in ("stem", "kind", "ext")})


_SCREENS = ", ".join(f"({w}, {h})" for w, h in C.SCREENS)
_MEDIA = f"""
    s AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS p_size, CASE WHEN p_partkey % 12 = 1 THEN 'RPReplay_Final' || p_partkey ELSE 'IMG_' || p_partkey END AS stem, ['photo', 'video', 'raw', 'sidecar'][p_partkey % 4 + 1] AS kind, ['jpg', 'mp4', 'dng', 'aae'][p_partkey % 4 + 1] AS ext FROM part),
    m AS (SELECT *, CASE WHEN id % 10 = 9 THEN id - 1 ELSE id END = id AS primary_file, CASE WHEN id % 23 = 0 THEN 'Thumbs.db' WHEN id % 29 = 0 THEN '._' || stem ELSE stem || '.' || ext END AS name, CASE WHEN id % 17 = 0 THEN 0 ELSE p_size END AS size,
        CASE WHEN id % 6 = 1 THEN 2532 WHEN id % 6 = 2 THEN 1170 ELSE 640 END AS width, CASE WHEN id % 6 = 1 THEN 1170 WHEN id % 6 = 2 THEN 2532 ELSE 480 END AS height,
        id % 8 <> 7 AND NOT (id % 3 = 0 OR (id % 3 = 1 AND id % 7 = 0)) AS no_camera, (id % 9) * 700 AS duration_ms, (id % 50) / 100.0::DOUBLE AS brightness, (id % 21) / 100.0::DOUBLE AS dark_p99, id % 31 AS sharpness, id % 11 <> 0 AS valid FROM s),
    w AS (SELECT m.*, (least(width, height), greatest(width, height)) IN ({_SCREENS}) AS screen FROM m)"""


def reasons(rows: DataFrame, rule: Column) -> DataFrame:
    """id, reason of the rows that a rule names."""
    return rows.select("id", rule.alias("found")).filter("found IS NOT NULL").select("id", F.col("found.reason").alias("reason"))


@query(f"""WITH {_MEDIA}, r AS (SELECT id, CASE WHEN id % 20 = 0 THEN 'screenshot_comment' WHEN id % 5 = 0 AND no_camera AND screen THEN 'screenshot_resolution' END AS reason FROM w WHERE primary_file AND kind = 'photo') SELECT * FROM r WHERE reason IS NOT NULL""")
def rule_screenshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(media_rows(spark, sf_dir), rules.screenshots())


@query(f"""WITH {_MEDIA}, r AS (SELECT id, CASE WHEN stem LIKE 'RPReplay%' THEN 'screen_recording_name' WHEN no_camera AND screen THEN 'screen_recording_resolution' END AS reason FROM w WHERE primary_file AND kind = 'video') SELECT * FROM r WHERE reason IS NOT NULL""")
def rule_screen_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(media_rows(spark, sf_dir), rules.screen_recordings())


@query(f"""WITH {_MEDIA} SELECT id, 'short_video' AS reason FROM w WHERE primary_file AND kind = 'video' AND duration_ms < {CFG.short_video_seconds * 1000}""")
def rule_short_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(media_rows(spark, sf_dir), rules.short_videos(CFG))


@query(f"""WITH {_MEDIA} SELECT id, 'no_camera' AS reason FROM w WHERE primary_file AND kind IN ('photo', 'video') AND no_camera""")
def rule_no_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(media_rows(spark, sf_dir), rules.no_camera_media())


@query(f"""WITH {_MEDIA}, r AS (SELECT id, CASE WHEN lower(name) = 'thumbs.db' OR starts_with(name, '._') THEN 'junk_name' WHEN size = 0 THEN 'junk_empty' WHEN kind <> 'sidecar' AND id % 13 = 0 THEN 'junk_broken'
    WHEN kind IN ('photo', 'raw') AND valid AND id % 19 = 0 THEN 'junk_broken' WHEN kind = 'sidecar' AND primary_file THEN 'junk_orphan_aae' END AS reason FROM w) SELECT * FROM r WHERE reason IS NOT NULL""")
def rule_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(media_rows(spark, sf_dir), rules.junk(CFG))


@query(f"""WITH {_MEDIA}, r AS (SELECT id, CASE WHEN brightness < {CFG.dark_mean}::DOUBLE AND dark_p99 < {CFG.dark_p99}::DOUBLE THEN 'dark' WHEN sharpness < {CFG.blur_threshold} AND brightness >= {CFG.dark_mean}::DOUBLE THEN 'blurry' END AS reason
    FROM w WHERE primary_file AND kind IN ('photo', 'raw') AND valid) SELECT * FROM r WHERE reason IS NOT NULL""")
def rule_blurry_dark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(media_rows(spark, sf_dir), rules.blurry_dark(CFG))


# -- links -------------------------------------------------------------------------------------------------------------------------


def linked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of a photo, a video, another photo and a sidecar, four part keys each."""
    k = F.col("p_partkey")
    g, role = F.floor(k / 4).cast("long"), k % 4
    lone = F.when(g % 11 == 0, "LONE_").when(g % 3 == 0, "IMG_O").otherwise("IMG_")
    folder = F.concat(F.lit("d"), ((g + F.when((role == 1) & (g % 5 == 0), 1).otherwise(0)) % 3).cast("string"))
    stem = F.concat(F.when((role == 1) & (g % 7 == 0), "V").when(role == 3, lone).otherwise("IMG_"), g.cast("string"))
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.lit("source").alias("root"), F.when(role == 2, "x").otherwise(folder).alias("dir_path"), stem.alias("stem"), pick(k, "heic", "mov", "jpg", "aae").alias("ext"), pick(k, "photo", "video", "photo", "sidecar").alias("kind"),
        F.when((role == 1) & (g % 13 == 0), "gone").alias("detached_at"), F.when((role != 3) & (g % 2 == 0), F.concat(F.lit("C"), g.cast("string"))).alias("content_id"), F.when(role == 1, (g % 8) * 1000).alias("duration_ms"))


_LINK = """
    k AS (SELECT p_partkey AS id, p_partkey // 4 AS g, p_partkey % 4 AS r FROM part),
    f AS (SELECT id, g, r, CASE WHEN r = 2 THEN 'x' ELSE 'd' || ((g + CASE WHEN r = 1 AND g % 5 = 0 THEN 1 ELSE 0 END) % 3) END AS dir,
        CASE WHEN r = 1 AND g % 7 = 0 THEN 'V' WHEN r = 3 AND g % 11 = 0 THEN 'LONE_' WHEN r = 3 AND g % 3 = 0 THEN 'IMG_O' ELSE 'IMG_' END || g AS stem, CASE WHEN r <> 3 AND g % 2 = 0 THEN 'C' || g END AS cid, (g % 8) * 1000 AS ms FROM k),
    v AS (SELECT * FROM f WHERE r = 1 AND g % 13 <> 0), p AS (SELECT * FROM f WHERE r IN (0, 2))"""


@query(f"""WITH {_LINK} SELECT id, item_id FROM (SELECT v.id, p.id AS item_id, row_number() OVER (PARTITION BY v.id ORDER BY v.dir <> p.dir, lower(v.stem) <> lower(p.stem), p.id) AS n FROM v JOIN p ON v.cid = p.cid) WHERE n = 1""")
def live_pairs_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = linked_files(spark, sf_dir)
    own = files.filter("content_id IS NOT NULL").select("id")
    return link.link_items(files).filter("companion_role = 'live_video'").join(own, "id").select("id", "item_id")


@query(f"""WITH {_LINK} SELECT v.id, min(p.id) AS item_id FROM v JOIN p ON v.dir = p.dir AND lower(v.stem) = lower(p.stem) WHERE v.cid IS NULL AND p.cid IS NULL AND v.ms <= {C.LIVE_VIDEO_MS} GROUP BY v.id""")
def live_pairs_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = linked_files(spark, sf_dir)
    own = files.filter("content_id IS NULL").select("id")
    return link.link_items(files).filter("companion_role = 'live_video'").join(own, "id").select("id", "item_id")


_OWNERS = f"""WITH {_LINK}, a AS (SELECT id, dir, lower(stem) AS key, 0 AS n FROM f WHERE r = 3 UNION SELECT id, dir, regexp_replace(lower(stem), '^(.*)_[oe](\\d+)$', '\\1_\\2'), 1 FROM f WHERE r = 3),
    o AS (SELECT a.id, m.id AS item_id, row_number() OVER (PARTITION BY a.id ORDER BY a.n, m.r = 1, m.id) AS k FROM a JOIN f m ON m.r <> 3 AND m.dir = a.dir AND lower(m.stem) = a.key)"""


@query(f"{_OWNERS} SELECT id, item_id FROM o WHERE k = 1")
def sidecar_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.link_items(linked_files(spark, sf_dir)).filter("companion_role = 'aae'").select("id", "item_id")


@query(f"{_OWNERS} SELECT id FROM f WHERE r = 3 AND id NOT IN (SELECT id FROM o)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars that found no owner."""
    files = linked_files(spark, sf_dir)
    return link.link_items(files).filter("item_id = id").join(files.filter("kind = 'sidecar'").select("id"), "id", "left_semi").select("id")


# -- plans -------------------------------------------------------------------------------------------------------------------------


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as catalog files: every third belongs to the one before it, every thirteenth is missing."""
    d, id = table(spark, sf_dir, "documents"), F.col("doc_id")
    name = F.concat(id.cast("string"), F.lit(".txt"))
    return d.select(id.alias("id"), F.when(id % 3 == 2, id - 1).otherwise(id).alias("item_id"), F.lit("source").alias("root"), F.concat_ws("/", "source", name).alias("rel_path"), name.alias("name"), F.coalesce("n_chars", F.lit(0)).alias("size"), F.when(id % 13 == 0, "missing").otherwise("present").alias("status"), null("string").alias("origin_rel_path"))


def document_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document_candidates(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "found.category", "found.group_id", "found.is_keeper", null("string").alias("applied_op"))
    return journal.apply_plan(found, document_files(spark, sf_dir), list(C.CATEGORIES))


_MOVES = f"""{_CANDIDATES},
    files AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 2 THEN doc_id - 1 ELSE doc_id END AS item_id, source AS dir, doc_id || '.txt' AS name, coalesce(n_chars, 0) AS size FROM documents WHERE doc_id % 13 <> 0),
    cf AS (SELECT f.*, c.category FROM c JOIN files f ON c.doc_id = f.id), whole AS (SELECT * FROM cf WHERE id = item_id),
    moves AS (SELECT f.id, f.item_id, concat_ws('/', w.category, w.dir, f.name) AS dst, f.size, w.category FROM files f JOIN whole w ON f.item_id = w.id
        UNION ALL SELECT id, item_id, concat_ws('/', category, dir, name), size, category FROM cf WHERE id <> item_id AND item_id NOT IN (SELECT id FROM whole))"""


@query(f"WITH {_MOVES} SELECT id AS file_id, item_id, dst AS dst_rel, category, size FROM moves")
def apply_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_moves(spark, sf_dir).select("file_id", "item_id", "dst_rel", "category", "size")


@query(f"""WITH {_MOVES}, t AS (SELECT d.doc_id, sha256(coalesce(text, '')) AS h, concat_ws('/', source, d.doc_id || '.txt') AS was, m.dst FROM documents d LEFT JOIN moves m ON d.doc_id = m.id)
    SELECT count(*) AS before, count(*) AS after, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS gained, count(dst) AS moved, count(DISTINCT ('source', was)) AS places_before, count(DISTINCT CASE WHEN dst IS NULL THEN ('source', was) ELSE ('review', dst) END) AS places_after FROM t""")
def multiset_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content and places before and after a move plan is carried out on paper: nothing is lost or gained, no place is taken twice."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    at = d.join(document_files(spark, sf_dir).select(F.col("id").alias("file_id"), "root", "rel_path"), "file_id")
    plan = document_moves(spark, sf_dir).select("file_id", "dst_root", "dst_rel")
    after = at.join(plan, "file_id", "left").select("h", F.coalesce("dst_root", "root").alias("root"), F.coalesce("dst_rel", "rel_path").alias("rel_path"), F.col("dst_rel").isNotNull().alias("moved"))
    a, b = at.groupBy("h").agg(F.count("*").alias("a")), after.groupBy("h").agg(F.count("*").alias("b"))
    zero = F.lit(0).cast("long")
    both = a.join(b, "h", "full_outer").select(F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"))
    sums = both.agg(F.sum("a").alias("before"), F.sum("b").alias("after"), F.sum(F.greatest(F.col("a") - F.col("b"), zero)).alias("lost"), F.sum(F.greatest(F.col("b") - F.col("a"), zero)).alias("gained"))
    places = at.agg(F.count_distinct("root", "rel_path").alias("places_before")).join(after.agg(F.count_if("moved").alias("moved"), F.count_distinct("root", "rel_path").alias("places_after")))
    return sums.join(places)


def turn_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as journal rows that moved one of 40 files of a conversation to the review folder."""
    c = table(spark, sf_dir, "conversations")
    id = F.col("conv_id") * 1000 + F.col("turn")
    action = F.when(F.col("turn") == 0, "purge").when(F.col("turn") % 3 == 0, "keep").when(F.col("turn") % 3 == 1, "to_review").otherwise("restore")
    file = (F.col("conv_id") * 40 + F.col("turn") % 40).alias("file_id")
    return c.select(id.alias("id"), F.col("conv_id").alias("op_id"), (F.col("conv_id") % 5).alias("session_id"), action.alias("action"), file, F.lit("source").alias("from_root"), F.concat(F.lit("s/"), id.cast("string")).alias("from_rel"), F.lit("review").alias("to_root"), F.concat(F.lit("r/"), id.cast("string")).alias("to_rel"), F.when(F.col("role") == "assistant", F.lit(1)).cast("long").alias("undone_by"), null("string").alias("category"))


_TURNS = """
    j AS (SELECT conv_id * 1000 + turn AS id, conv_id AS op_id, conv_id % 5 AS session_id, CASE WHEN turn = 0 THEN 'purge' WHEN turn % 3 = 0 THEN 'keep' WHEN turn % 3 = 1 THEN 'to_review' ELSE 'restore' END AS action, conv_id * 40 + turn % 40 AS file_id, role = 'assistant' AS undone FROM conversations)"""


@query(f"""WITH {_TURNS} SELECT id AS undoes, op_id, 's/' || id AS dst_rel, action = 'keep' OR (id % 4 <> 0 AND id % 7 <> 0) AS valid, action IN ('keep', 'restore') AS clears_reviewed FROM j WHERE NOT undone AND action <> 'purge' AND session_id = 2""")
def undo_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_journal(spark, sf_dir)
    files = rows.select(F.col("file_id").alias("id"), F.when(F.col("id") % 4 == 0, "source").otherwise("review").alias("root"), F.col("to_rel").alias("rel_path"), F.when(F.col("id") % 7 == 0, "missing").otherwise("present").alias("status"))
    return journal.undo_plan(rows, files, journal.undoable_ops(rows, session_id=2)).select("undoes", "op_id", "dst_rel", "valid", "clears_reviewed")


@query(f"""WITH {_TURNS} SELECT file_id, 'review' AS to_root, 'r/' || max(id) AS to_rel FROM j WHERE NOT undone GROUP BY file_id""")
def net_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.net_state(turn_journal(spark, sf_dir))


def staged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files in the three roots, pairs of an item each."""
    k = F.col("p_partkey")
    root = pick(k, "source", "review", "delete")
    name = F.concat(F.lit("IMG_"), k.cast("string"), F.lit(".jpg"))
    return table(spark, sf_dir, "part").select(k.alias("id"), (k - k % 2).alias("item_id"), root.alias("root"), F.concat(F.when(root == "source", "d/").otherwise("staged/"), name).alias("rel_path"), F.when(root != "source", F.concat(F.lit("d/"), name)).alias("origin_rel_path"), name.alias("name"), F.col("p_size").cast("long").alias("size"), F.when(k % 17 == 0, "missing").otherwise("present").alias("status"), F.when(k % 5 == 0, "live_video").alias("companion_role"))


_STAGED = """
    f AS (SELECT p_partkey AS id, p_partkey - p_partkey % 2 AS item_id, ['source', 'review', 'delete'][p_partkey % 3 + 1] AS root, 'd/IMG_' || p_partkey || '.jpg' AS origin, CAST(p_size AS BIGINT) AS size, CASE WHEN p_partkey % 5 = 0 THEN 'live_video' END AS role FROM part WHERE p_partkey % 17 <> 0)"""


@query(f"""WITH {_STAGED} SELECT id AS file_id, 'to_delete' AS action, 'delete' AS dst_root, origin AS dst_rel, origin AS origin_after FROM f WHERE root <> 'delete' AND item_id % 8 = 0
    UNION ALL SELECT id, 'restore', 'source', origin, NULL FROM f WHERE root <> 'source' AND item_id % 8 = 2""")
def group_decision_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = staged_files(spark, sf_dir)
    items = files.select("item_id").distinct()
    return journal.group_decision(files, items.filter("item_id % 8 = 2"), items.filter("item_id % 8 = 0")).select("file_id", "action", "dst_root", "dst_rel", "origin_after")


@query(f"""WITH {_STAGED} SELECT f.id AS file_id, 'live_photos/' || f.origin AS dst_rel FROM f WHERE f.root = 'source' AND f.role = 'live_video'""")
def live_video_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = staged_files(spark, sf_dir)
    owners = files.select("item_id").distinct().join(files.select("id"), F.col("item_id") == F.col("id"), "left_anti")
    photos = owners.select(F.col("item_id").alias("id"), F.lit("").alias("rel_path"))
    return journal.live_videos(files.unionByName(photos, allowMissingColumns=True)).select("file_id", "dst_rel")


@query(f"""WITH {_STAGED} SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM f WHERE root = 'delete'""")
def purge_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.purge_preview(staged_files(spark, sf_dir))


# -- lists -------------------------------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch_us(ts) // 1000000 END AS taken, event_id * 1500000000 AS mtime_ns, 'a' || (user_id % 3) || '/b' || (user_id % 2) AS dir, ['photo', 'raw', 'video', 'other'][event_id % 4 + 1] AS kind FROM events WHERE event_id % 6 <> 0)
    SELECT id FROM f WHERE kind IN ('photo', 'raw') AND (dir = 'a1' OR starts_with(dir, 'a1/')) ORDER BY coalesce(taken, mtime_ns // 1000000000) DESC, id DESC LIMIT 120 OFFSET 40""")
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    id, user = F.col("event_id"), F.col("user_id")
    files = table(spark, sf_dir, "events").select(id.alias("id"), id.alias("item_id"), F.when(id % 3 != 0, seconds("ts")).alias("date_taken_ts"), (id * 1_500_000_000).alias("mtime_ns"), F.concat(F.lit("a"), (user % 3).cast("string"), F.lit("/b"), (user % 2).cast("string")).alias("dir_path"), pick(id, "photo", "raw", "video", "other").alias("kind"), F.lit("present").alias("status"), F.when(id % 6 == 0, "seen").alias("reviewed_at"))
    return listing.list_items(files, by="date", descending=True, kinds="photo", folder="a1", unreviewed=True, limit=120, offset=40).select("id")


@query(f"""WITH {_CANDIDATES}, g AS (SELECT keeper FROM c WHERE category = 'duplicates' GROUP BY keeper ORDER BY count(*) DESC, keeper LIMIT 1)
    SELECT doc_id AS file_id, source || '/' || doc_id || '.txt' AS rel_path FROM c JOIN g ON c.keeper = g.keeper WHERE category = 'duplicates'""")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document_candidates(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "found.category", "found.group_id", "found.is_keeper", "keeper").filter("category = 'duplicates'")
    first = found.groupBy("group_id", "keeper").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "keeper").limit(1).first()
    return listing.group_members(found, document_files(spark, sf_dir), first["group_id"] if first else "").select("file_id", "rel_path")


@query(f"""WITH {_TURNS} SELECT DISTINCT 'g' || (file_id % 50) AS group_id, op_id FROM j WHERE file_id % 3 = 0""")
def group_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_journal(spark, sf_dir)
    found = rows.select("file_id").distinct().select("file_id", F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("g"), (F.col("file_id") % 50).cast("string"))).alias("group_id"))
    return listing.group_ops(rows, found)


# -- windows that the streams keep, here over the whole table -----------------------------------------------------------------------


@query("""SELECT CAST(epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return follow.windowed_counts(events).select(F.unix_seconds("window.start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("""WITH e AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w), 9000000000000) >= 3600000000 AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS burst FROM e)
    SELECT user_id, CAST(epoch_us(min(ts)) // 1000000 AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, burst""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return follow.sessions(events, gap="1 hour").select("user_id", F.unix_seconds("session_window.start").alias("start"), "n")
