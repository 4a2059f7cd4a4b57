"""Registered queries of what the catalog does with its own tables: upserts, versions, moves, marks, lists, names and digests."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import constants as C
from tidemill.functions import dates, display, hashing, names, pixels
from tidemill.operators import dedupe, journal, listing, report, similar, snapshot
from tidemill.operators.components import connected_components, updated_components
from tidemill.plans.catalogue import _CANDIDATES, content, document_candidates, query
from tidemill.plans.media import _STAGED, _TURNS, document_files, null, pick, staged_files, turn_journal
from tidemill.session import cut, scratch_path, settings
from tidemill.session import read_table as table
from tidemill.sources.store import Store
from tidemill.streaming.bursts import GROUPS, STATE_STORE, similar_stream

SECOND = 1_000_000_000

# -- versions of derived rows ------------------------------------------------------------------------------------------------------


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored features of two thirds of the documents."""
    id, size = F.col("doc_id"), F.coalesce("n_chars", F.lit(0)).cast("long")
    rows = table(spark, sf_dir, "documents").filter(id % 3 != 0)
    return rows.select(id.alias("file_id"), size.alias("size"), (id * SECOND).alias("mtime_ns"), F.concat(F.lit("p"), id.cast("string")).alias("partial_hash"), F.when(id % 2 == 0, F.concat(F.lit("f"), id.cast("string"))).alias("full_hash"))


def found_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of three quarters of the documents, of a later version for every fifth."""
    id, size = F.col("doc_id"), F.coalesce("n_chars", F.lit(0)).cast("long")
    rows = table(spark, sf_dir, "documents").filter(id % 4 != 0)
    return rows.select(id.alias("file_id"), size.alias("size"), (id * SECOND + F.when(id % 5 == 0, 1).otherwise(0)).alias("mtime_ns"), F.when(id % 7 == 0, F.concat(F.lit("n"), id.cast("string"))).alias("partial_hash"), null("string").alias("full_hash"))


_ANALYSED = """
    a AS (SELECT doc_id AS id, 'p' || doc_id AS p, CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id END AS f FROM documents WHERE doc_id % 3 <> 0),
    n AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'n' || doc_id END AS p, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS later FROM documents WHERE doc_id % 4 <> 0)"""


@query(f"""WITH {_ANALYSED} SELECT coalesce(a.id, n.id) AS file_id, coalesce(a.id, n.id) * {SECOND} + coalesce(n.later, 0) AS mtime_ns, CASE WHEN n.later = 1 THEN n.p ELSE coalesce(n.p, a.p) END AS partial_hash, CASE WHEN n.later = 1 THEN NULL ELSE a.f END AS full_hash
    FROM a FULL JOIN n ON a.id = n.id""")
def feature_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is supplied is set; another version wipes what isn't."""
    merged = snapshot.merge_features(analysed(spark, sf_dir), found_again(spark, sf_dir), ("partial_hash", "full_hash"))
    return merged.select("file_id", "mtime_ns", "partial_hash", "full_hash")


@query(f"""WITH {_ANALYSED} SELECT id AS file_id, p AS partial_hash, NULL::VARCHAR AS full_hash FROM n UNION ALL SELECT id, p, f FROM a WHERE id NOT IN (SELECT id FROM n)""")
def row_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.upsert(analysed(spark, sf_dir), found_again(spark, sf_dir), "file_id").select("file_id", "partial_hash", "full_hash")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 THEN 'png' END AS format, CASE WHEN doc_id % 4 <> 0 AND doc_id % 7 = 0 THEN 'n' || doc_id END AS partial_hash, doc_id % 4 <> 0 AND doc_id % 5 <> 0 AS a_valid FROM documents""")
def wide_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the same version only; analysis of any version, flagged."""
    id = F.col("doc_id")
    files = table(spark, sf_dir, "documents").select(id.alias("id"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("size"), (id * SECOND).alias("mtime_ns"))
    same = analysed(spark, sf_dir).select("file_id", "size", "mtime_ns", F.lit("png").alias("format"))
    older = files.filter(F.col("id") % 3 == 0).select(F.col("id").alias("file_id"), (F.col("size") + 1).alias("size"), "mtime_ns", F.lit("gif").alias("format"))
    return snapshot.wide_rows(files, same.unionByName(older), found_again(spark, sf_dir)).select("id", "format", "partial_hash", "a_valid")


@query(f"""WITH {_CANDIDATES} SELECT 1 AS run_id, doc_id AS file_id, category, 'op' || doc_id AS applied_op FROM c WHERE doc_id % 2 = 0 UNION ALL SELECT 2, doc_id, category, NULL FROM c WHERE category <> 'junk'""")
def candidate_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new run takes the place of all candidates that weren't applied."""
    found = document_candidates(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "found.category")
    old = found.withColumn("run_id", F.lit(1)).withColumn("applied_op", F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("op"), F.col("file_id").cast("string"))))
    return snapshot.replace_candidates(old, found.filter("category <> 'junk'").withColumn("run_id", F.lit(2)).withColumn("applied_op", null("string")))


@query(f"""WITH {_TURNS}, s AS (SELECT id, op_id FROM j WHERE session_id = 1), m AS (SELECT max(id) AS m FROM j WHERE session_id = 0)
    SELECT row_number() OVER (ORDER BY s.id) + m.m AS id, s.op_id, s.id AS was FROM s, m""")
def journal_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one session get ids after those of another."""
    rows = turn_journal(spark, sf_dir)
    new = rows.filter("session_id = 1").select("op_id", F.col("id").alias("was"))
    return snapshot.append_with_ids(rows.filter("session_id = 0"), new, [F.col("was")])


# -- places and marks --------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_STAGED}, k AS (SELECT p_partkey AS id, ['source', 'review', 'delete'][p_partkey % 3 + 1] AS root, 'IMG_' || p_partkey || '.jpg' AS name FROM part),
    o AS (SELECT id, root, CASE WHEN root = 'source' THEN 'd/' ELSE 'staged/' END || name AS rel, CASE WHEN root <> 'source' THEN 'd/' || name END AS origin FROM k),
    w AS (SELECT o.*, f.id IS NOT NULL AND o.id % 4 = 0 AND o.root <> 'delete' AS deleted, f.id IS NOT NULL AND o.id % 4 = 2 AND o.root <> 'source' AS back FROM o LEFT JOIN f ON o.id = f.id)
    SELECT id, CASE WHEN deleted THEN 'delete' WHEN back THEN 'source' ELSE root END AS root, CASE WHEN deleted OR back THEN coalesce(origin, rel) ELSE rel END AS rel_path,
        CASE WHEN back THEN NULL WHEN deleted AND root = 'source' THEN rel ELSE origin END AS origin_rel_path, CASE WHEN deleted OR back THEN 'd' END AS dir_path, CASE WHEN deleted OR back THEN 'IMG_' || id END AS stem FROM w""")
def relocated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where files are after a group decision; what the catalog knows of a place follows the path."""
    files = staged_files(spark, sf_dir)
    plan = journal.group_decision(files, files.filter("id % 4 = 2").select(F.col("id").alias("item_id")), files.filter("id % 4 = 0").select(F.col("id").alias("item_id")))
    moves = plan.filter("file_id = item_id").select(F.col("file_id").alias("id"), "file_id", F.col("src_rel").alias("from_rel"), F.col("dst_root").alias("to_root"), F.col("dst_rel").alias("to_rel"))
    rows = files.withColumns({"dir_path": null("string"), "stem": null("string"), "ext": null("string"), "rel_path_os": null("string")})
    return snapshot.relocated(rows, moves).select("id", "root", "rel_path", "origin_rel_path", "dir_path", "stem")


@query(f"""WITH {_STAGED} SELECT id AS file_id, origin AS to_rel, 'keep' AS action FROM f WHERE root = 'source' AND item_id % 4 = 0""")
def kept_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = staged_files(spark, sf_dir)
    return journal.kept_in_place(files, files.filter("item_id % 4 = 0").select("item_id").distinct()).select("file_id", "to_rel", "action")


@query("""SELECT p_partkey AS id, CASE WHEN (p_partkey - p_partkey % 2) % 4 = 0 THEN 'now' WHEN p_partkey % 5 = 0 THEN 'then' END AS reviewed_at FROM part""")
def reviewed_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = staged_files(spark, sf_dir).withColumn("reviewed_at", F.when(F.col("id") % 5 == 0, "then"))
    return snapshot.reviewed(files, files.filter("item_id % 4 = 0").select("item_id"), "now").select("id", "reviewed_at")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 AND source IS NOT NULL THEN 'similar/g' || doc_id % 5 ELSE concat_ws('/', CASE WHEN doc_id % 3 = 0 THEN 'similar' ELSE 'junk' END, source) END AS folder FROM documents""")
def review_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    id = F.col("id")
    files = document_files(spark, sf_dir)
    group = F.when((id % 3 == 0) & (names.dirname(F.col("rel_path")) != ""), F.concat(F.lit("g"), (id % 5).cast("string")))
    return files.select("id", journal.review_destination(F.when(id % 3 == 0, "similar").otherwise("junk"), F.col("rel_path"), group).alias("folder"))


# -- sums and lists ----------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_STAGED} SELECT count(*) FILTER (role = 'live_video') AS live_count, CAST(coalesce(sum(size) FILTER (role = 'live_video'), 0) AS BIGINT) AS live_bytes, count(*) FILTER (id % 7 = 0) AS edited_count, CAST(coalesce(sum(size) FILTER (id % 7 = 0), 0) AS BIGINT) AS edited_bytes FROM f""")
def live_and_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = staged_files(spark, sf_dir).filter("status = 'present'")
    return report.live_and_edited(files.withColumn("edited_of", F.when(F.col("id") % 7 == 0, F.col("id") - 1)))


@query(f"""WITH {_CANDIDATES} SELECT category, count(*) AS n FROM c WHERE doc_id % 4 <> 0 GROUP BY category""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document_candidates(spark, sf_dir).select("found.category", (F.col("doc_id") % 4 == 0).alias("is_keeper"))
    return report.category_counts(found)


@query(f"""WITH {_CANDIDATES}, f AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 2 THEN doc_id - 1 ELSE doc_id END AS item_id, coalesce(n_chars, 0) AS size FROM documents WHERE doc_id % 13 <> 0), s AS (SELECT item_id, sum(size) AS total FROM f GROUP BY item_id)
    SELECT f.id AS file_id, c.category, CAST(CASE WHEN f.id = f.item_id THEN s.total ELSE f.size END AS BIGINT) AS bytes FROM c JOIN f ON c.doc_id = f.id JOIN s ON f.item_id = s.item_id""")
def candidate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A primary counts with all its item's files, a companion alone."""
    found = document_candidates(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "found.category")
    return report.candidate_rows(found, document_files(spark, sf_dir)).select("file_id", "category", F.col("bytes").cast("long").alias("bytes"))


@query("""WITH d AS (SELECT doc_id AS id, octet_length(encode(text)) AS size, sha256(text) AS h FROM documents WHERE text IS NOT NULL), k AS (SELECT size, h FROM d GROUP BY size, h HAVING count(*) > 1)
    SELECT d.id, d.size FROM d JOIN k ON d.size = k.size AND d.h = k.h""")
def partial_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose size and digest of both ends others share; texts under twice the edge are digested whole."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    hashed = d.select(F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("size"), hashing.partial_hash(content(F.col("text"))).alias("partial_hash"))
    return dedupe.partially_equal(hashed).select("id", "size")


@query("""SELECT o_orderkey AS id, o_orderpriority AS kind FROM orders WHERE o_orderstatus IN ('O', 'P') AND starts_with(o_orderpriority, '1') ORDER BY id DESC LIMIT 50 OFFSET 10""")
def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderpriority").startswith("1"), "first")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), kind.alias("kind"), F.col("o_orderstatus").alias("state"))
    return listing.newest(jobs, limit=50, offset=10, states=("O", "P"), kind="first").select("id", F.col("name").alias("kind"))


@query("""SELECT conv_id * 1000 + turn AS id, 't/' || turn AS rel_path FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations)""")
def item_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    files = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("item_id"), F.concat(F.lit("t/"), F.col("turn").cast("string")).alias("rel_path"))
    newest = c.agg(F.max("conv_id")).first()[0]
    return listing.item_files(files, newest).select("id", "rel_path")


@query("""SELECT event_id AS id FROM events ORDER BY user_id DESC, id DESC LIMIT 120 OFFSET 440""")
def page_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("item_id"), F.lit("present").alias("status"), F.lit("photo").alias("kind"), F.lit("d").alias("dir_path"), F.col("user_id").alias("size"))
    return listing.page_around(listing.list_items(rows, by="size", descending=True), 500).select("id")


@query(f"""WITH {_TURNS} SELECT session_id FROM j WHERE NOT undone AND action <> 'purge' ORDER BY id DESC LIMIT 1""")
def last_undoable_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.last_undoable_session(turn_journal(spark, sf_dir))


# -- similar photos ----------------------------------------------------------------------------------------------------------------

_BURST = """
    b AS (SELECT vec_id AS id, vec_id // 4 AS g, vec_id % 4 AS r, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE vec_id % 5 END AS sharp, vec_id % 7 AS width FROM embeddings),
    i AS (SELECT * FROM b WHERE NOT (r = 3 AND g % 5 = 0)), n AS (SELECT *, count(*) OVER (PARTITION BY g) AS members FROM i), m AS (SELECT * FROM n WHERE members > 1),
    k AS (SELECT *, first_value(id) OVER w AS keeper, first_value(r) OVER w AS best FROM m WINDOW w AS (PARTITION BY g ORDER BY coalesce(sharp, -1) DESC, width DESC, id)),
    o AS (SELECT g, row_number() OVER (ORDER BY min(id)) AS nth FROM m GROUP BY g)"""


@query(f"""WITH {_BURST} SELECT k.id, 's3-' || o.nth AS group_id, k.keeper AS keeper_id, k.id = k.keeper AS is_keeper, CAST(abs(k.r - k.best) * 20 AS BIGINT) AS delta FROM k JOIN o ON k.g = o.g""")
def similar_keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of four frames 20 s apart, every fifth with one that looks otherwise: the sharpest stays, then the largest, then the first."""
    id = F.col("vec_id")
    g, r = F.floor(id / 4).cast("long"), id % 4
    looks = F.xxhash64(g).bitwiseXOR(F.pow(2, r).cast("long"))
    made = {"id": id, "ts": g * 1000 + r * 20, "phash": F.when((r == 3) & (g % 5 == 0), F.bitwise_not(looks)).otherwise(looks), "edited_of": null("long"), "sharpness": F.when(id % 3 != 0, (id % 5).cast("double")), "width": id % 7, "height": F.lit(1), "path": id.cast("string")}
    items = table(spark, sf_dir, "embeddings").select(*[c.alias(n) for n, c in made.items()])
    return similar.similar_groups(items, window=60.0, distance=6, run_id=3).select("id", "group_id", "keeper_id", "is_keeper", F.col("delta").cast("long").alias("delta"))


# -- names, dates, digests ---------------------------------------------------------------------------------------------------------

_DIRS = ", ".join(f"'{d}'" for d in C.EXCLUDED_DIRS)


@query(f"""WITH n AS (SELECT p_partkey AS id, [{_DIRS}, 'Holiday.PhotosLibrary', 'x.lrdata', '@EADIR', 'clip{C.TEMP_SUFFIX}', 'plain'][p_partkey % {len(C.EXCLUDED_DIRS) + 5} + 1] AS name FROM part)
    SELECT id, name IN ({_DIRS}) OR ends_with(lower(name), '.photoslibrary') OR ends_with(lower(name), '.lrdata') AS excluded, ends_with(name, '{C.TEMP_SUFFIX}') AS temporary FROM n""")
def excluded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = pick(k, *C.EXCLUDED_DIRS, "Holiday.PhotosLibrary", "x.lrdata", "@EADIR", f"clip{C.TEMP_SUFFIX}", "plain")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), name.alias("name"))
    return rows.select("id", names.is_excluded_dir(F.col("name")).alias("excluded"), names.is_temp_file(F.col("name")).alias("temporary"))


@query("""WITH p AS (SELECT page_id AS id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), n AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM p),
    e AS (SELECT *, regexp_matches(name, '^.+\\.[^.]*$') AS dotted FROM n)
    SELECT id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir_path, name, CASE WHEN dotted THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END AS stem, CASE WHEN dotted THEN lower(regexp_extract(name, '[^.]*$')) ELSE '' END AS ext FROM e""")
def path_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://", "")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), names.dirname(path).alias("dir_path"), names.basename(path).alias("name"))
    return rows.select("id", "dir_path", "name", names.stem(F.col("name")).alias("stem"), names.ext(F.col("name")).alias("ext"))


@query("""SELECT p_partkey AS id, nfc_normalize(replace(p_name, 'e', 'e' || chr(769))) AS composed, replace(p_name, 'e', 'e' || chr(769)) AS decomposed FROM part""")
def unicode_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    accented = F.replace("p_name", F.lit("e"), F.lit("é"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), names.nfc(accented).alias("composed"), names.nfd(names.nfc(accented)).alias("decomposed"))


@query("""SELECT event_id AS id, strftime(make_timestamp(epoch_us(ts) // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%S') AS shown, epoch_us(ts) // 1000000 AS taken, event_id % 2 = 0 AS same FROM events""")
def file_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mtimes as text, back to seconds, and compared to the second."""
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    mtime = (s * SECOND + F.col("event_id") % 1000).alias("mtime")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), mtime)
    shown = dates.mtime_to_iso(F.col("mtime"))
    other = F.when(F.col("id") % 2 == 0, F.col("mtime") + 1_000_000).otherwise(F.col("mtime") + SECOND)
    return rows.select("id", shown.alias("shown"), dates.iso_to_ts(shown).alias("taken"), dates.same_mtime(F.col("mtime"), other).alias("same"))


@query("""SELECT doc_id AS id, sha256(CASE WHEN length(text) <= 128 THEN text ELSE left(text, 64) || right(text, 64) END) AS partial_hash, sha256(text) AS full_hash FROM documents WHERE length(text) = octet_length(encode(text))""")
def edge_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of both ends, here of 64 bytes, and of everything; single-byte texts, which SQL can cut like bytes."""
    d = table(spark, sf_dir, "documents").filter(F.length("text") == F.octet_length("text"))
    return d.select(F.col("doc_id").alias("id"), hashing.partial_hash(content(F.col("text")), 64).alias("partial_hash"), hashing.full_hash(content(F.col("text"))).alias("full_hash"))


# -- what is kept up to date instead of made anew -------------------------------------------------------------------------------------


@query("""
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 23 = 4 THEN 'late' WHEN o_orderkey % 17 = 3 THEN 'first' ELSE o_orderstatus END AS name, CAST(CASE WHEN o_orderkey % 23 = 4 THEN 2 WHEN o_orderkey % 17 = 3 THEN 1 ELSE 0 END AS BIGINT) AS n FROM orders WHERE o_orderkey % 29 <> 5
    UNION ALL SELECT o_orderkey + 1000000000000, 'new', 3 FROM orders WHERE o_orderkey % 31 = 6""")
def merge_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base with three deltas: rows put twice, rows dropped, rows added."""
    id = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(id.cast("long").alias("id"), F.col("o_orderstatus").alias("name"), F.lit(0).cast("long").alias("n"))
    ddl, keys, own = "id long, name string, n long", ("id",), Store(spark, scratch_path(spark, "store"))
    own.write("orders", orders, ddl, keys)

    def put(rows: DataFrame, name: str, n: int) -> DataFrame:
        return rows.withColumns({"name": F.lit(name), "n": F.lit(n).cast("long")})

    own.merge("orders", put(orders.filter("id % 17 = 3"), "first", 1), ddl, keys)
    own.merge("orders", put(orders.filter("id % 23 = 4 AND id % 29 <> 5"), "late", 2), ddl, keys, gone=orders.filter("id % 29 = 5"))
    own.merge("orders", put(orders.filter("id % 31 = 6").withColumn("id", F.col("id") + 1_000_000_000_000), "new", 3), ddl, keys)
    return own.read("orders", ddl, keys)


@query("""
    WITH e AS (SELECT event_id AS id, user_id, event_type, epoch_us(ts) // 1000000 AS t FROM events WHERE event_id % 7 <> 5),
    o AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, id), 1000000000) > 7200 AS starts FROM e),
    s AS (SELECT *, sum(starts::INT) OVER (PARTITION BY user_id, event_type ORDER BY t, id) AS burst FROM o),
    g AS (SELECT *, min(id) OVER w AS component, count(*) OVER w AS members FROM s WINDOW w AS (PARTITION BY user_id, event_type, burst))
    SELECT id, component FROM g WHERE members > 1""")
def component_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of events without a seventh, brought to where another seventh is gone and the first is there."""
    events = table(spark, sf_dir, "events").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))

    def links(rows: DataFrame) -> DataFrame:
        pairs = similar.band_pairs(rows, 7200, by=("user_id", "event_type"), id="event_id", ts="t")
        return cut(pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "links")

    before, after = links(events.filter("event_id % 7 <> 3")), links(events.filter("event_id % 7 <> 5"))
    return updated_components(connected_components(before), after, after.subtract(before), before.subtract(after))


@query("""
    WITH e AS (SELECT event_id AS id, user_id % 10 AS key, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t, coalesce(value, -1) AS value FROM events),
    o AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY key, event_type ORDER BY t, id), 1000000000) > 3600 AS starts FROM e),
    s AS (SELECT *, sum(starts::INT) OVER (PARTITION BY key, event_type ORDER BY t, id) AS burst FROM o),
    g AS (SELECT *, min(id) OVER w AS component, count(*) OVER w AS members, first_value(id) OVER b AS keeper_id, first_value(t) OVER b AS keeper_t FROM s
        WINDOW w AS (PARTITION BY key, event_type, burst), b AS (PARTITION BY key, event_type, burst ORDER BY value DESC, id))
    SELECT CAST(key AS VARCHAR) AS key, id, component, keeper_id, 'e' || keeper_id AS keeper_path, id = keeper_id AS is_keeper, abs(t - keeper_t) AS delta FROM g WHERE members > 1""")
def burst_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of photos, a look for each type: bursts close as the watermark passes, the last ones by a row of a later year."""
    events = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    items = events.select((F.col("user_id") % 10).cast("string").alias("key"), F.col("event_id").cast("long").alias("id"), ts.alias("ts"), F.xxhash64("event_type").alias("phash"), null("long").alias("edited_of"), F.col("value").alias("sharpness"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("path"))
    last = items.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts")).select(F.lit("end").alias("key"), F.lit(-1).cast("long").alias("id"), "ts", F.lit(0).cast("long").alias("phash"), null("long").alias("edited_of"), null("double").alias("sharpness"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit("end").alias("path"))
    folder = scratch_path(spark, "photos")
    items.unionByName(last).write.parquet(folder)
    out, check = scratch_path(spark, "bursts"), scratch_path(spark, "bursts-checkpoint")
    with settings(spark, STATE_STORE | {"spark.sql.shuffle.partitions": str(2 * spark.sparkContext.defaultParallelism)}):  # few keys meet in a task
        found = similar_stream(spark.readStream.schema(items.schema).parquet(folder), window=3600)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(GROUPS).parquet(out)


@query("""
    WITH p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS g FROM embeddings, range(64) r(i) WHERE len(embedding) = 64),
    c AS (SELECT k, i, cos(pi() * k * (2 * i + 1) / 16) * sqrt(CASE WHEN k = 0 THEN 1 ELSE 2 END / 8) AS w FROM range(8) a(k), range(8) b(i)),
    h AS (SELECT vec_id, k, x, sum(w * g) AS v FROM p JOIN c ON c.i = p.y GROUP BY ALL),
    f AS (SELECT h.vec_id, h.k * 8 + c.k AS place, sum(w * v) AS v FROM h JOIN c ON c.i = h.x GROUP BY ALL),
    b AS (SELECT vec_id, v > median(v) OVER (PARTITION BY vec_id) AS bit, place FROM f)
    SELECT vec_id, CAST(sum(CASE WHEN bit THEN CASE WHEN place = 0 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << CAST(63 - place AS INTEGER)) END ELSE 0 END) AS BIGINT) AS phash FROM b GROUP BY vec_id""")
def phash_dct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perceptual hash of embeddings as frames of 8 x 8, by DCT on the JVM."""
    rows = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64)
    return rows.select("vec_id", pixels.dct_bits(F.col("embedding"), 8).alias("phash"))


@query("""
    WITH o AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) - 1 AS place FROM orders), n AS (SELECT count(*) AS n FROM orders)
    SELECT page, place - start AS nth, id FROM o, n, (VALUES (0, 0), (1, 440), (2, -1)) v(page, spot), LATERAL (SELECT CASE WHEN spot < 0 THEN n - 60 ELSE spot END AS start) WHERE place >= start AND place < start + 120""")
def ranked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a list, the one around place 500 and the last, each read from its ranges."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    order = [F.col("o_totalprice").desc(), F.col("id").desc()]
    ranked = listing.RankedList(orders, *order)
    pages = [ranked.around(index) for index in (0, 500, ranked.size)]
    nth = F.row_number().over(Window.partitionBy("page").orderBy(*order)) - 1  # of 120 rows a page
    every = functools.reduce(DataFrame.unionByName, [p.withColumn("page", F.lit(k)) for k, p in enumerate(pages)])
    return every.select("page", nth.cast("long").alias("nth"), "id")


@query("""
    SELECT doc_id AS id FROM documents WHERE contains(lower(source || '/IMG_' || doc_id || '%.JPG'), 'g_1') OR contains(lower(coalesce(lang, '') || '/x' || doc_id || '.MOV'), 'g_1') ORDER BY id DESC LIMIT 40 OFFSET 3""")
def journal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text sought in both paths of a journal, without regard to case and with pattern signs taken as they are."""
    id = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(id.alias("id"), F.concat("source", F.lit("/IMG_"), id.cast("string"), F.lit("%.JPG")).alias("from_rel"), F.concat(F.coalesce("lang", F.lit("")), F.lit("/x"), id.cast("string"), F.lit(".MOV")).alias("to_rel"))
    return journal.search(rows, text="G_1", limit=40, offset=3).select("id")


@query(f"""WITH {_CANDIDATES} SELECT doc_id, CASE category WHEN 'duplicates' THEN 'Точная копия ' || keeper WHEN 'screenshots' THEN 'В EXIF UserComment записано «Screenshot»' WHEN 'junk' THEN 'Файл не декодируется (low quality)'
    WHEN 'short_videos' THEN 'Длительность ' || printf('%.1f', n_chars / 10) || ' с (порог 20 с)' ELSE 'В метаданных нет производителя и модели камеры' END AS reason FROM c""")
def reason_text_ru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_candidates(spark, sf_dir).select("doc_id", display.reason_text(F.col("found.reason"), F.col("found.params"), "ru").alias("reason"))
