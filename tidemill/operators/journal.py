"""The journal: undoable operations, counters, and plans of moves, undos and purges. Plans are data; nothing here touches files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import names

NOT_UNDOABLE = ("undo", "purge")


def search(journal: DataFrame, *, session_id: int | None = None, category: str | None = None, action: str | None = None, text: str | None = None, limit: int = 500, offset: int = 0) -> DataFrame:
    """Newest first; `text` is sought in both paths, without regard to the case of ASCII letters."""
    rows = journal
    for column, value in (("session_id", session_id), ("category", category), ("action", action)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if text:
        sought = names.nocase(F.lit(text))
        rows = rows.filter(F.coalesce(names.nocase(F.col("from_rel")).contains(sought), F.lit(False)) | F.coalesce(names.nocase(F.col("to_rel")).contains(sought), F.lit(False)))
    return rows.orderBy(F.col("id").desc()).offset(offset).limit(limit)


def undoable_ops(journal: DataFrame, *, session_id: int | None = None, category: str | None = None, limit: int | None = None) -> DataFrame:
    """op_id, last_id of operations not yet undone, newest first."""
    rows = journal.filter(F.col("undone_by").isNull() & ~F.col("action").isin(*NOT_UNDOABLE))
    if session_id is not None:
        rows = rows.filter(F.col("session_id") == session_id)
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    ops = rows.groupBy("op_id").agg(F.max("id").alias("last_id")).orderBy(F.col("last_id").desc())
    return ops.limit(limit) if limit is not None else ops


def last_undoable_session(journal: DataFrame) -> DataFrame:
    """session_id of the newest operation that isn't undone; no row without one."""
    rows = journal.filter(F.col("undone_by").isNull() & ~F.col("action").isin(*NOT_UNDOABLE) & F.col("session_id").isNotNull())
    return rows.agg(F.max_by("session_id", "id").alias("session_id")).filter(F.col("session_id").isNotNull())


def session_counters(journal: DataFrame, files: DataFrame, session_id: int) -> DataFrame:
    """Kept, deleted, restored operations and deleted bytes of a session; a deletion counts while the file is still where it went."""
    own = journal.filter((F.col("session_id") == session_id) & F.col("undone_by").isNull())
    at = files.select(F.col("id").alias("file_id"), F.col("root").alias("_root"), F.col("rel_path").alias("_rel"), F.col("status").alias("_status"))
    placed = own.join(at, "file_id", "left")
    still = (F.col("_root") == F.col("to_root")) & (F.col("_rel") == F.col("to_rel")) & (F.col("_status") == "present")
    gone = (F.col("action") == "to_delete") & F.coalesce(still, F.lit(False))

    def ops(condition: Column) -> Column:
        return F.count_distinct(F.when(condition, F.col("op_id")))

    return placed.agg(ops(F.col("action") == "keep").alias("kept"), ops(gone).alias("deleted"), ops(F.col("action") == "restore").alias("restored"), F.coalesce(F.sum(F.when(gone, F.col("size"))), F.lit(0)).alias("deleted_bytes"))


def undo_plan(journal: DataFrame, files: DataFrame, ops: DataFrame) -> DataFrame:
    """The rows of `ops`, newest first, with where each file goes back to and whether it can.

    A file must be present where the row left it, once the newer rows of the plan are undone: the rows of one file are gone
    through from the newest, each valid one taking it to where it came from. A keep without a move is always valid.
    """
    at = files.select(F.col("id").alias("file_id"), F.struct(F.col("root").alias("root"), F.col("rel_path").alias("rel")).alias("_at"), (F.col("status") == "present").alias("_present"))
    rows = journal.join(ops.select("op_id"), "op_id", "left_semi").filter(F.col("undone_by").isNull() & ~F.col("action").isin(*NOT_UNDOABLE))
    row = F.struct("id", "op_id", "action", "from_root", "from_rel", "to_root", "to_rel")
    chains = rows.groupBy("file_id").agg(F.sort_array(F.collect_list(row), asc=False).alias("_rows")).join(at, "file_id", "left")
    flags = F.array().cast("array<boolean>")

    def step(state: Column, r: Column) -> Column:
        here = F.coalesce((state["at"]["root"] == r["to_root"]) & (state["at"]["rel"] == r["to_rel"]) & F.col("_present"), F.lit(False))
        back = F.struct(r["from_root"].alias("root"), r["from_rel"].alias("rel"))
        return F.struct(F.when(here, back).otherwise(state["at"]).alias("at"), F.concat(state["flags"], F.array(here | (r["action"] == "keep"))).alias("flags"))

    walked = chains.withColumn("_flags", F.aggregate("_rows", F.struct(F.col("_at").alias("at"), flags.alias("flags")), step, lambda state: state["flags"]))
    each = walked.select("file_id", F.explode(F.arrays_zip("_rows", "_flags")).alias("_r")).select("file_id", "_r._rows.*", F.col("_r._flags").alias("valid"))
    clears = F.col("action").isin("keep", "restore")
    return each.select(F.col("id").alias("undoes"), "op_id", "file_id", F.col("to_root").alias("src_root"), F.col("to_rel").alias("src_rel"), F.col("from_root").alias("dst_root"), F.col("from_rel").alias("dst_rel"), "valid", clears.alias("clears_reviewed"), (F.col("action") == "detach_live").alias("relinks")).orderBy(F.col("undoes").desc())


def net_state(journal: DataFrame) -> DataFrame:
    """Where each file is after all moves that were not undone."""
    moves = journal.filter(F.col("undone_by").isNull() & F.col("to_root").isNotNull() & (F.col("action") != "undo"))
    return moves.groupBy("file_id").agg(F.max_by(F.struct("to_root", "to_rel"), "id").alias("_at")).select("file_id", "_at.to_root", "_at.to_rel")


def review_destination(category: Column, path: Column, group: Column) -> Column:
    """`similar/<group>` for similar photos, else the category and the file's own folder."""
    folder = names.dirname(path)
    return F.when((category == "similar") & group.isNotNull(), F.concat_ws("/", F.lit("similar"), group)).otherwise(F.concat_ws("/", category, F.nullif(folder, F.lit(""))))


def move_specs(files: DataFrame, items: DataFrame, dst_root: str) -> DataFrame:
    """One move a present file of `items` (item_id, and dst_dir or null for the file's original place)."""
    own = files.filter(F.col("status") == "present").join(items, "item_id")
    origin = F.coalesce(F.when(F.col("root") != "source", F.col("origin_rel_path")), F.col("rel_path"))
    inside = F.concat_ws("/", F.nullif(F.col("dst_dir"), F.lit("")), F.col("name"))
    target = F.when(F.col("dst_dir").isNotNull(), inside).otherwise(origin)
    after = F.lit(None).cast("string") if dst_root == "source" else origin
    return own.select(F.col("id").alias("file_id"), "item_id", F.col("root").alias("src_root"), F.col("rel_path").alias("src_rel"), F.lit(dst_root).alias("dst_root"), target.alias("dst_rel"), "size", after.alias("origin_after"))


def with_disk_names(plan: DataFrame, files: DataFrame) -> DataFrame:
    """`plan` with src_os, the name on the disk of files whose name isn't the catalog's."""
    other = files.filter(F.col("rel_path_os").isNotNull()).select(F.col("id").alias("file_id"), F.col("rel_path_os").alias("src_os"))
    return plan.join(other, "file_id", "left")


def net_moves(plan: DataFrame) -> DataFrame:
    """One row a file of an undo plan's valid rows: from where the newest left it to where the oldest took it from, with all rows in `steps`.

    `nth` orders them as the plan does, newest first.
    """
    step = F.struct((-F.col("undoes")).alias("k"), "undoes", "op_id", "src_root", "src_rel", "dst_root", "dst_rel", "clears_reviewed", "relinks")
    rows = plan.filter("valid").groupBy("file_id").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    first, last = F.col("steps")[0], F.element_at("steps", -1)
    return rows.select("file_id", first["src_root"].alias("src_root"), first["src_rel"].alias("src_rel"), last["dst_root"].alias("dst_root"), last["dst_rel"].alias("dst_rel"), first["undoes"].alias("undoes"), first["k"].alias("nth"), "steps")


def next_wave(pending: DataFrame) -> DataFrame:
    """The moves whose place isn't held by a file that is still to move."""
    held = pending.select(F.col("src_root").alias("dst_root"), F.col("src_rel").alias("dst_rel"), F.col("file_id").alias("_holder"))
    return pending.join(held, ["dst_root", "dst_rel"], "left").filter(F.col("_holder").isNull() | (F.col("_holder") == F.col("file_id"))).drop("_holder").select(*pending.columns)


def first_free(plan: DataFrame, files: DataFrame) -> DataFrame:
    """`plan` (nth, dst_root, dst_rel) with dst_rel numbered as if the moves were made one by one, beside present files and each other."""
    own = plan.withColumn("_folder", F.concat_ws("/", "dst_root", F.nullif(names.dirname(F.col("dst_rel")), F.lit("")))).withColumn("_base", names.basename(F.col("dst_rel")))
    here = files.filter("status = 'present'").join(plan.select(F.col("file_id").alias("id")), "id", "left_anti")
    taken = here.select(F.concat_ws("/", "root", F.nullif(F.col("dir_path"), F.lit(""))).alias("_folder"), F.col("name").alias("_base")).join(own.select("_folder").distinct(), "_folder", "left_semi")
    named = unique_names(own, taken, folder="_folder", name="_base", order="nth")
    folder = names.dirname(F.col("dst_rel"))
    return named.withColumn("dst_rel", F.concat_ws("/", F.nullif(folder, F.lit("")), "unique_name")).select(*plan.columns)


def apply_plan(candidates: DataFrame, files: DataFrame, categories: list[str]) -> DataFrame:
    """Moves of unapplied, non-keeper candidates of `categories`, in their order: an item moves once, with its first candidate; a companion alone."""
    nth = F.array_position(F.lit(categories), F.col("category"))
    own = candidates.filter(F.col("category").isin(*categories) & ~F.col("is_keeper") & F.col("applied_op").isNull()).withColumn("_nth", nth)
    at = files.filter((F.col("root") == "source") & (F.col("status") == "present"))
    placed = own.join(at.select(F.col("id").alias("file_id"), "item_id", "rel_path"), "file_id").withColumn("_whole", F.col("file_id") == F.col("item_id"))
    whole = placed.filter("_whole").groupBy("item_id").agg(F.min_by(F.struct("category", "group_id", "rel_path"), F.struct("_nth", "file_id")).alias("c"))
    items = whole.select("item_id", "c.category", review_destination(F.col("c.category"), F.col("c.rel_path"), F.col("c.group_id")).alias("dst_dir"))
    moved = move_specs(at, items.select("item_id", "dst_dir"), "review").join(items.select("item_id", "category"), "item_id")
    alone = placed.filter(~F.col("_whole")).join(whole.select("item_id"), "item_id", "left_anti")
    alone = alone.groupBy("file_id").agg(F.min_by(F.struct("category", "group_id", "rel_path"), "_nth").alias("c"))
    single = at.join(alone.select(F.col("file_id").alias("id"), "c"), "id")
    single = single.select(F.col("id").alias("file_id"), "item_id", F.col("root").alias("src_root"), F.col("rel_path").alias("src_rel"), F.lit("review").alias("dst_root"), F.concat_ws("/", review_destination(F.col("c.category"), F.col("c.rel_path"), F.col("c.group_id")), "name").alias("dst_rel"), "size", F.col("rel_path").alias("origin_after"), "c.category")
    return moved.unionByName(single)


def item_action(files: DataFrame, item_ids: DataFrame, action: str) -> DataFrame:
    """keep and restore return staged items to the source, both as restore; to_delete moves items to delete. `kept_in_place` has the kept ones that stay."""
    items = item_ids.select("item_id").withColumn("dst_dir", F.lit(None).cast("string"))
    root = {"keep": "source", "to_delete": "delete", "restore": "source"}[action]
    return move_specs(files.filter(F.col("root") != root), items, root).withColumn("action", F.lit("restore" if root == "source" else action))


def kept_in_place(files: DataFrame, item_ids: DataFrame) -> DataFrame:
    """Journal rows of items of the source that are kept where they are: from and to are the same."""
    own = files.filter((F.col("root") == "source") & (F.col("status") == "present")).join(item_ids.select("item_id"), "item_id", "left_semi")
    at = F.col("rel_path")
    return own.select(F.col("id").alias("file_id"), "item_id", F.col("root").alias("src_root"), at.alias("src_rel"), F.col("root").alias("dst_root"), at.alias("dst_rel"), at.alias("to_rel"), "size", F.lit("keep").alias("action"), F.lit("none").alias("method"), F.lit(False).alias("conflict"), F.lit(None).cast("string").alias("error"))


def live_videos(files: DataFrame) -> DataFrame:
    """Moves that detach live videos from their photos."""
    photo = files.select(F.col("id").alias("item_id"), F.col("rel_path").alias("photo"))
    own = files.filter((F.col("root") == "source") & (F.col("status") == "present") & (F.col("companion_role") == "live_video"))
    return own.join(photo, "item_id").select(F.col("id").alias("file_id"), "item_id", "photo", F.col("rel_path").alias("src_rel"), F.lit("review").alias("dst_root"), F.concat_ws("/", F.lit("live_photos"), F.col("rel_path")).alias("dst_rel"), "size")


def group_decision(files: DataFrame, keep: DataFrame, delete: DataFrame) -> DataFrame:
    """A group's kept items go back or stay, the others go to delete."""
    return item_action(files, keep, "keep").unionByName(item_action(files, delete, "to_delete"))


def purge_plan(files: DataFrame) -> DataFrame:
    return files.filter((F.col("root") == "delete") & (F.col("status") == "present")).select(F.col("id").alias("file_id"), "rel_path", "size")


def purge_preview(files: DataFrame) -> DataFrame:
    return purge_plan(files).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def name_family(name: Column) -> Column:
    """The name without the numbers ~n behind its stem: only names of one family can stand in each other's way."""
    plain = names.ext(name) == ""
    stem = F.when(plain, name).otherwise(names.stem(name))
    return F.concat(F.regexp_replace(stem, r"(~\d+)+$", ""), F.when(plain, "").otherwise(F.concat(F.lit("."), F.substring_index(name, ".", -1))))


def unique_names(moves: DataFrame, taken: DataFrame, *, folder: str = "folder", name: str = "name", order: str = "id") -> DataFrame:
    """`moves` with `unique_name`: the first of name, name~2, name~3 … that is free when the moves are made one by one in their `order`.

    Taken are the names of `taken` (folder, name) and those that earlier moves got. A name is taken literally, as in a case-sensitive folder.
    Where all moves of a family ask for one name, the k-th gets the k-th free number: the numbers taken are islands, and
    before the i-th of them lie its value less i free ones, so one running count over both finds every number. Families whose moves
    ask for several names (`a.jpg` and `a~2.jpg`) depend on the order between them and are gone through one by one, family by family.
    """
    own = moves.select(F.col(order).alias("_order"), F.col(folder).alias("_folder"), F.col(name).alias("_name")).withColumn("_family", name_family(F.col("_name")))
    families = own.groupBy("_folder", "_family").agg(F.min("_name").alias("_asked"), (F.min("_name") != F.max("_name")).alias("_mixed"))
    held = taken.select(F.col(folder).alias("_folder"), F.col(name).alias("_name")).distinct().withColumn("_family", name_family(F.col("_name"))).join(families, ["_folder", "_family"])
    own = own.join(families, ["_folder", "_family"])

    plain = own.filter(~F.col("_mixed"))
    number = F.when(F.col("_name") == F.col("_asked"), 1).otherwise(F.regexp_extract("_name", r"~(\d{1,9})(\.[^.]*)?$", 1).try_cast("int"))
    islands = held.filter(~F.col("_mixed")).withColumn("_number", number).filter((F.col("_name") == F.col("_asked")) | ((F.col("_number") > 1) & (names.suffixed(F.col("_asked"), F.col("_number")) == F.col("_name"))))
    group = Window.partitionBy("_folder", "_asked")
    before = islands.select("_folder", "_asked", (F.col("_number") - F.row_number().over(group.orderBy("_number"))).alias("_place"), F.lit(1).alias("_kind"), F.lit(None).cast(moves.schema[order].dataType).alias("_order"))
    asked = plain.select("_folder", "_asked", F.row_number().over(group.orderBy("_order")).alias("_place"), F.lit(0).alias("_kind"), "_order")
    passed = F.sum("_kind").over(group.orderBy("_place", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    found = asked.unionByName(before).withColumn("_n", F.col("_place") + passed).filter("_kind = 0").select("_order", names.suffixed(F.col("_asked"), F.col("_n")).alias("unique_name"))

    rows = own.filter("_mixed").select("_folder", "_family", "_order", "_name").unionByName(held.filter("_mixed").select("_folder", "_family", "_name"), allowMissingColumns=True)
    kind = moves.schema[order].dataType.simpleString()

    def in_turn(table: pa.Table) -> pa.Table:
        asks = sorted((o, n) for o, n in zip(table["_order"].to_pylist(), table["_name"].to_pylist(), strict=True) if o is not None)
        used = {n for o, n in zip(table["_order"].to_pylist(), table["_name"].to_pylist(), strict=True) if o is None}
        least: dict[str, int] = {}
        out = []
        for _, wanted in asks:
            n = least.get(wanted, 1)
            while (got := names.suffixed_name(wanted, n)) in used:
                n += 1
            least[wanted] = n + 1
            used.add(got)
            out.append(got)
        return pa.table({"_order": pa.array([o for o, _ in asks], table["_order"].type), "unique_name": pa.array(out, pa.string())})

    mixed = rows.groupBy("_folder", "_family").applyInArrow(in_turn, f"_order {kind}, unique_name string")
    both = found.unionByName(mixed)
    return moves.join(both, moves[order] == both["_order"]).drop("_order")
