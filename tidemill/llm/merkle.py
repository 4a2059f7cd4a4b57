"""A Merkle manifest of a dataset, with proofs.

Every row is a leaf: the SHA-256 of its fields, each as byte count, colon and value, or `-` if null. A group's leaves stand in the order of
their ids, and `FAN` consecutive nodes (the last run: what is left) become their digest until one is left, the group's subroot; the subroots,
in the order of groups, become the root likewise. Digests are lower-case hex text wherever they are hashed.

Rows are dealt by ranges of (group, id), sorted, and written with their places. Each range says which groups it begins and ends with and how many
rows of the last one it has: from these, one row a range, every row's place in its group follows without another pass. Each range builds
the complete aligned subtrees that lie wholly inside it, of `HEIGHT` levels at most; at its borders smaller ones are left over. Only these
subtrees' roots are shuffled, by the coordinate of their ancestor `HEIGHT` levels further up, and the levels between are finished there;
then come the next `HEIGHT` levels, until every group has its subroot, and the subroots' own tree in the same way. A task so meets the nodes under
one ancestor and no group of rows, however large. Proofs come back the same way: each subtree's siblings on the way up are joined
to it, and its leaves are folded inside it.

Defined cases: rows without id come first in their group; rows of equal id are in the order of their leaves; a null group is a group of its own
and the first; groups are in the order of their UTF-8 bytes; an empty table gives an empty result; other columns take no part, whatever
their names. Rows without id are never tampered with.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.session import cut, release

FAN = 3
#: Levels that one task builds at once: a subtree has FAN ** HEIGHT = 729 leaves.
HEIGHT = 6


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` if null, else byte count, colon, value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def sorted_leaves(rows: DataFrame) -> DataFrame:
    """`rows` (grp, id, leaf, other) by ranges, with range (_pid), number of the group in its range (_seg) and place in that (_pos)."""
    dealt = rows.repartitionByRange("grp", "id", "leaf").sortWithinPartitions("grp", "id", "leaf").withColumn("_pid", F.spark_partition_id())
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seg, pos = None, -1, 0
        for batch in batches:
            segs, places = [], []
            for group in batch.column(0).to_pylist():
                if seg < 0 or group != last:
                    last, seg, pos = group, seg + 1, 0
                segs.append(seg)
                places.append(pos)
                pos += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segs, pa.int64()), pa.array(places, pa.int64())], [*batch.schema.names, "_seg", "_pos"])

    ddl = f"grp {kinds['grp']}, id {kinds['id']}, leaf string, other string, _pid int, _seg long, _pos long"
    return cut(dealt.select("grp", "id", "leaf", "other", "_pid").mapInArrow(placed, ddl), "leaves")


def range_offsets(leaves: DataFrame) -> dict[int, tuple[int, int]]:
    """For each range, the number of its first group and the place of its first row in that; one row a range comes to the driver."""
    ends = leaves.groupBy("_pid").agg(F.min_by(F.struct("grp"), "_seg").alias("first"), F.max_by(F.struct("grp"), "_seg").alias("last"), F.max(F.struct("_seg", "_pos")).alias("end"))
    out, number, before, reached = {}, -1, None, 0
    for row in ends.orderBy("_pid").collect():
        goes_on = before is not None and row["first"] == before
        first, offset = (number, reached) if goes_on else (number + 1, 0)
        out[row["_pid"]] = first, offset
        number = first + row["end"]["_seg"]
        reached = row["end"]["_pos"] + 1 + (offset if row["end"]["_seg"] == 0 else 0)
        before = row["last"]
    return out


def levels(leaves: list[str], height: int) -> list[list[str]]:
    """All levels of a complete subtree, the leaves first."""
    out = [leaves]
    for _ in range(height):
        below = out[-1]
        out.append([digest("".join(below[k : k + FAN])) for k in range(0, len(below), FAN)])
    return out


def subtrees(leaves: DataFrame, offsets: dict[int, tuple[int, int]], height: int = HEIGHT) -> DataFrame:
    """g, level, at, hash of the largest complete aligned subtrees inside each range, with their ids, leaves and other leaves."""
    kind = leaves.schema["id"].dataType.simpleString()
    sizes = [FAN**k for k in range(height + 1)]
    names = ["g", "level", "at", "hash", "ids", "leaves", "others"]

    def rows_of(g: int, start: int, own: list[tuple]) -> list[tuple]:
        out, k = [], 0
        while k < len(own):
            level = 0
            while level < height and (start + k) % sizes[level + 1] == 0 and k + sizes[level + 1] <= len(own):
                level += 1
            part = own[k : k + sizes[level]]
            out.append((g, level, (start + k) // sizes[level], levels([x[1] for x in part], level)[-1][0], *map(list, zip(*part, strict=True))))
            k += sizes[level]
        return out

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []
        at = (-1, 0)  # group and place of the first pending row
        kinds = None
        for batch in batches:
            kinds = kinds or (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(batch.column(3).type), pa.list_(pa.string()), pa.list_(pa.string()))
            pid, seg, pos = (batch.column(k).to_numpy() for k in range(3))
            moved = np.array([offsets[p] for p in pid.tolist()], np.int64).reshape(-1, 2)
            group, place = moved[:, 0] + seg, pos + np.where(seg == 0, moved[:, 1], 0)
            rows = list(zip(*[batch.column(k).to_pylist() for k in (3, 4, 5)], strict=True))
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(group) != 0) | (np.diff(place) != 1)])) if len(rows) else np.zeros(0, np.int64)
            out = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
                if pending and (int(group[a]), int(place[a])) != (at[0], at[1] + len(pending)):
                    out += rows_of(*at, pending)
                    pending = []
                if not pending:
                    at = int(group[a]), int(place[a])
                pending += rows[a:b]
            # what can't grow any more goes; what follows the last border of a largest subtree may
            end = at[1] + len(pending)
            border = end // sizes[-1] * sizes[-1]
            if border > at[1]:
                out += rows_of(*at, pending[: border - at[1]])
                pending, at = pending[border - at[1] :], (at[0], border)
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        if pending:
            columns = list(zip(*rows_of(*at, pending), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    read = leaves.select("_pid", "_seg", "_pos", "id", "leaf", "other")
    return read.mapInArrow(built, f"g long, level long, at long, hash string, ids array<{kind}>, leaves array<string>, others array<string>")


def width(n: int, level: int) -> int:
    """Nodes on a level over n leaves."""
    return -(-n // FAN**level)


CLIMBED = pa.schema([("g", pa.int64()), ("level", pa.int64()), ("at", pa.int64()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string())), ("up_level", pa.int64()), ("up_at", pa.int64()), ("up_hash", pa.string()), ("n", pa.int64())])


def climbed(table: pa.Table, top: int) -> pa.Table:
    """The nodes (g, level, at, hash, n) under one ancestor on level `top`, with their siblings up to it or the group's last level."""
    columns = {name: table.column(name).to_pylist() for name in ("g", "level", "at", "hash", "n")}
    g, n = columns["g"][0], columns["n"][0]
    nodes: dict[int, dict[int, str]] = defaultdict(dict)
    for level, at, value in zip(columns["level"], columns["at"], columns["hash"], strict=True):
        nodes[level][at] = value
    beside: dict[tuple[int, int], tuple[str, str]] = {}
    level = min(nodes)
    while level < top and width(n, level) > 1:
        for parent in {at // FAN for at in nodes[level]}:
            own = [nodes[level][at] for at in range(parent * FAN, min(parent * FAN + FAN, width(n, level)))]
            for k in range(len(own)):
                beside[level, parent * FAN + k] = "".join(own[:k]), "".join(own[k + 1 :])
            nodes[level + 1][parent] = digest("".join(own))
        level += 1
    rows = []
    for start, at in zip(columns["level"], columns["at"], strict=True):
        path = [beside[k, at // FAN ** (k - start)] for k in range(start, level)]
        up = at // FAN ** (level - start)
        rows.append((g, start, at, [p[0] for p in path], [p[1] for p in path], level, up, nodes[level][up], n))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CLIMBED, strict=True)], schema=CLIMBED)


def climbing(top: int) -> Callable[[pa.Table], pa.Table]:
    def worked(table: pa.Table) -> pa.Table:
        return climbed(table, top)

    return worked


def leaf_counts(nodes: DataFrame) -> DataFrame:
    """`nodes` (g, level, at) with n, the number of leaves of their group."""
    ends = (F.col("at") + 1) * F.pow(F.lit(float(FAN)), F.col("level")).cast("long")
    return nodes.join(nodes.groupBy("g").agg(F.max(ends).alias("n")), "g")


def finished(nodes: DataFrame, top: int, height: int = HEIGHT) -> DataFrame:
    """g, level, at, lefts, rights, top_hash of every node (g, level, at, hash, n): its siblings on the way to its group's last digest, and that.

    `nodes` are subtrees that cover each group's n leaves without gaps. `top` is the first level that is built up to.
    """
    ddl = "g long, level long, at long, lefts array<string>, rights array<string>, up_level long, up_at long, up_hash string, n long"
    rows, tiers = nodes, []
    while True:
        up = F.floor(F.col("at") / F.pow(F.lit(float(FAN)), top - F.col("level"))).cast("long")
        # dealt by both: rows that come dealt by g would stay so
        found = cut(rows.withColumn("up", up).repartition("g", "up").groupBy("g", "up").applyInArrow(climbing(top), ddl), "tier")
        tiers.append(found)
        most = found.agg(F.max("n")).first()[0]
        if most is None or width(most, top) == 1:
            break
        rows = found.select("g", F.col("up_level").alias("level"), F.col("up_at").alias("at"), F.col("up_hash").alias("hash"), "n").distinct()
        top += height
    plain = ("g", "level", "at", "lefts", "rights", "up_level", "up_at", "up_hash")
    out = tiers[0].select(*plain)
    for tier in tiers[1:]:
        above = tier.select("g", F.col("level").alias("up_level"), F.col("at").alias("up_at"), F.col("lefts").alias("_l"), F.col("rights").alias("_r"), F.col("up_level").alias("_ul"), F.col("up_at").alias("_ua"), F.col("up_hash").alias("_uh"))
        both = out.drop("up_hash").join(above, ["g", "up_level", "up_at"])
        out = both.select("g", "level", "at", F.concat("lefts", "_l").alias("lefts"), F.concat("rights", "_r").alias("rights"), F.col("_ul").alias("up_level"), F.col("_ua").alias("up_at"), F.col("_uh").alias("up_hash"))
    return out.select("g", "level", "at", "lefts", "rights", F.col("up_hash").alias("top_hash"))


def folded(start: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf and its siblings, level by level, come to."""
    for left, right in zip(lefts, rights, strict=True):
        start = digest(left + start + right)
    return start


def proofs(blocks: DataFrame, *, with_siblings: bool) -> DataFrame:
    """A row for each leaf of each subtree, which has its way up in lefts and rights."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["lefts", "rights"] * with_siblings
    kinds = [pa.string()] * 5 + [pa.bool_()] + [pa.list_(pa.string())] * 2 * with_siblings

    def unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level, leaves, others, lefts, rights, subroot, root = (batch.column(k).to_pylist() for k in range(1, 8))
            rows = []
            for height, own, other, above_left, above_right, sub, top in zip(level, leaves, others, lefts, rights, subroot, root, strict=True):
                tree = levels(own, height)
                beside = [[("".join(t[k - k % FAN : k]), "".join(t[k + 1 : k - k % FAN + FAN])) for k in range(len(t))] for t in tree[:-1]]
                tail = "".join([a + b for a, b in zip(above_left, above_right, strict=True)])
                # the siblings of every node on the way up, from the subtree's root down to its leaves
                ways = [tail]
                for sides in reversed(beside):
                    ways = [a + b + ways[k // FAN] for k, (a, b) in enumerate(sides)]
                for k, (plain, changed) in enumerate(zip(own, other, strict=True)):
                    path = [sides[k // FAN**j] for j, sides in enumerate(beside)]
                    left, right = [p[0] for p in path] + above_left, [p[1] for p in path] + above_right
                    reached = folded(changed or plain, left, right)
                    rows.append((plain, sub, top, digest(ways[k]), reached, reached == top, *((left, right) if with_siblings else ())))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).flatten(), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)

    ddl = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", lefts array<string>, rights array<string>" * with_siblings
    return blocks.select("ids", "level", "leaves", "others", "lefts", "rights", "subroot", "root").mapInArrow(unfolded, ddl)


def without_newlines(text: Column) -> Column:
    return F.replace(text.cast("string"), F.lit("\n"), F.lit(""))


def manifest(docs: DataFrame, *, tamper: bool = False, with_siblings: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of `docs` (doc_id, source, lang, n_chars, text).

    folded_root is worked out anew from the leaf and its siblings, `verified` says that it is the root. With `tamper`, rows whose doc_id has
    an even CRC-32 lose their line feeds first. With `with_siblings`, the proof itself follows: the joined siblings to the left and to the
    right on each level, from the leaf to the root.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    own = leaf(*fields, F.col("text"))
    text = F.col("text").cast("string")
    touched = F.lit(tamper) & (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & text.contains("\n")
    other = F.when(touched, leaf(*fields, without_newlines(F.col("text"))))
    leaves = sorted_leaves(docs.select(F.col("source").cast("string").alias("grp"), F.col("doc_id").alias("id"), own.alias("leaf"), other.alias("other")))
    blocks = cut(subtrees(leaves, range_offsets(leaves)), "subtrees")
    upper = cut(finished(leaf_counts(blocks.select("g", "level", "at", "hash")), 2 * HEIGHT), "upper")
    release(leaves)
    subroots = cut(upper.select("g", F.col("top_hash").alias("hash")).distinct(), "subroots")
    zero = F.lit(0).cast("long")
    root = finished(subroots.select(zero.alias("g"), zero.alias("level"), F.col("g").alias("at"), "hash", F.lit(subroots.count()).alias("n")), HEIGHT)
    root = root.select(F.col("at").alias("g"), F.col("lefts").alias("_l"), F.col("rights").alias("_r"), F.col("top_hash").alias("root"))
    placed = blocks.join(upper, ["g", "level", "at"]).join(root, "g")
    placed = placed.select("ids", "level", "leaves", "others", F.concat("lefts", "_l").alias("lefts"), F.concat("rights", "_r").alias("rights"), F.col("top_hash").alias("subroot"), "root")
    return proofs(placed, with_siblings=with_siblings).withColumnRenamed("id", "doc_id")
