"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled by the largest norm and lifted by one coordinate to unit length, which makes the largest inner product the
smallest angle. A rotation applies three rounds of random signs and a fast Hadamard transform, and a vector is hashed to its nearest
signed axis. A table joins the hashes of as many rotations, the last one over a part of the axes, as buckets of about `BUCKET_ROWS` rows take: so
buckets become more, not larger, as rows become more. Every vector is in one bucket of each table; a query probes the buckets whose axes
are nearest to it in sum, `PROBES` times the square root of the number of buckets, so that it looks at about the square root
of all rows for each table. What the probed buckets hold is ranked by the exact inner product of the original vectors.

Buckets travel in groups of about `GROUP_ROWS` rows, and a query goes to a group once, with the list of its buckets there. Groups
of any size are dealt in blocks: an index block has about `INDEX_BLOCK` rows and a query block about `QUERY_BLOCK`, by
hash, so a bucket with a third of all rows is many blocks, none of them larger. A block keeps each query's `k` best ids, a task the `k` best of
its blocks, and the best of the tasks meet by query.

Queries that found fewer than `k` although there are more ids go through the blocks of one table once more, with every bucket.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do null vec_ids; vectors of each
length are a space of their own, in which a query finds those of its length; a query's own vec_id isn't its neighbour, also where
rows repeat it; a vec_id found with several vectors counts with its best; ties go to the smaller vec_id; a table of one row has no result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from tidemill.llm.text import mixed
from tidemill.session import cut

TABLES = 16
BUCKET_ROWS = 8
PROBES = 0.7
ROUNDS = 3
SEED = 11
K = 20
GROUP_ROWS = 16_384
INDEX_BLOCK = 16_384
QUERY_BLOCK = 2048
#: Scores closer than this share of the largest possible score count as ties while a block chooses; what it chose is ranked exactly.
TIE = 1e-13
#: Rows of a table of groups up to which it is broadcast.
BROADCAST_GROUPS = 100_000
#: Pairs that a task holds before it reduces them to the best.
HELD = 1 << 20


def hadamard(values: np.ndarray) -> np.ndarray:
    """The normalised fast Walsh-Hadamard transform of every row; the length is a power of two."""
    rows, n = values.shape
    half = 1
    while half < n:
        pairs = values.reshape(rows, n // (2 * half), 2, half)
        values = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, n)
        half *= 2
    return values / np.sqrt(n)


class Rotations:
    """The tables' pseudo-rotations for `rows` vectors of `dims` components whose norms reach `largest`."""

    def __init__(self, dims: int, largest: float, rows: int, *, tables: int = TABLES, probes: float = PROBES, bucket_rows: int = BUCKET_ROWS, seed: int = SEED):
        self.dims, self.largest, self.tables = dims, largest, tables
        self.padded = 1 << dims.bit_length()  # room for the lifted coordinate
        wanted, self.widths = rows / bucket_rows, [2 * self.padded]
        while wanted >= 2 * math.prod(self.widths):
            self.widths.append(min(2 * self.padded, 1 << int(math.log2(wanted / math.prod(self.widths)))))
        self.count = min(math.prod(self.widths), math.ceil(probes * math.sqrt(math.prod(self.widths))))
        self.groups = max(1, math.ceil(rows / GROUP_ROWS))
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, len(self.widths), ROUNDS, self.padded))

    def lift(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(vectors), self.padded))
        norms = np.linalg.norm(vectors, axis=1)
        out[:, : self.dims] = vectors / (norms if query else np.full(len(vectors), self.largest))[:, None]
        if not query:
            out[:, self.dims] = np.sqrt(np.maximum(0, 1 - (norms / self.largest) ** 2))
        return out

    def signed(self, lifted: np.ndarray, table: int, turn: int) -> np.ndarray:
        """The coordinate along each signed axis of a rotation: 2 * axis, plus 1 if negative."""
        for signs in self.signs[table, turn]:
            lifted = hadamard(lifted * signs)
        own = lifted[:, : self.widths[turn] // 2]
        return np.stack([own, -own], axis=2).reshape(len(lifted), -1)

    def buckets(self, vectors: np.ndarray, table: int) -> np.ndarray:
        lifted, out = self.lift(vectors, False), np.zeros(len(vectors), np.int64)
        for turn, width in enumerate(self.widths):
            out = out * width + self.signed(lifted, table, turn).argmax(axis=1)
        return out

    def probes(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """The `count` buckets of largest sum of coordinates for each query."""
        lifted, rows = self.lift(vectors, True), len(vectors)
        sums, codes = np.zeros((rows, 1)), np.zeros((rows, 1), np.int64)
        for turn, width in enumerate(self.widths):
            own = self.signed(lifted, table, turn)
            axes = best_columns(own, self.count)
            sums = (sums[:, :, None] + np.take_along_axis(own, axes, axis=1)[:, None, :]).reshape(rows, -1)
            codes = (codes[:, :, None] * width + axes[:, None, :]).reshape(rows, -1)
            best = best_columns(sums, self.count)
            sums, codes = np.take_along_axis(sums, best, axis=1), np.take_along_axis(codes, best, axis=1)
        return codes

    def group(self, codes: np.ndarray) -> np.ndarray:
        return (mixed(codes.astype(np.uint64)) % np.uint64(self.groups)).astype(np.int32)


def best_columns(values: np.ndarray, count: int) -> np.ndarray:
    if count >= values.shape[1]:
        return np.broadcast_to(np.arange(values.shape[1]), values.shape)
    return np.argpartition(-values, count - 1, axis=1)[:, :count]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (as bytes of doubles' source type is kept an array here) of the rows that take part."""
    v = F.col(vector_col)
    own = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    big = F.lit(float("inf"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("v", lambda x: x != 0)
    return own.filter(F.coalesce(fine, F.lit(False)))


def _strips(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors, some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def hashed_index(rows: DataFrame, turn: Rotations) -> DataFrame:
    """id, vec (the vector's bytes) and, for every table, the bucket and its group, as an array `places`; written, as it is read twice."""
    kind, dims = rows.schema["id"].dataType.simpleString(), turn.dims

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _strips(batches, dims):
            codes = np.stack([turn.buckets(vectors.astype(np.float64), table) for table in range(turn.tables)], axis=1).reshape(-1)
            ends = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * turn.tables)
            both = pa.StructArray.from_arrays([pa.array(codes), pa.array(turn.group(codes))], ["bucket", "grp"])
            raw = pa.array([x.tobytes() for x in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, raw, pa.ListArray.from_arrays(ends, both)], ["id", "vec", "places"])

    return cut(rows.mapInArrow(hashed, f"id {kind}, vec binary, places array<struct<bucket:long,grp:int>>"), "hashed")


def query_rows(rows: DataFrame, turn: Rotations, tables: int, with_vectors: bool, every: bool) -> DataFrame:
    """tab, grp and, if asked for, the probed buckets of the group, id and the vector's bytes. `every`: all groups, no list of buckets."""
    kind, dims = rows.schema["id"].dataType.simpleString(), turn.dims

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _strips(batches, dims):
            raw = pa.array([x.tobytes() for x in vectors], pa.binary()) if with_vectors else None
            for table in range(tables):
                if every:
                    owner, groups = np.repeat(np.arange(len(vectors)), turn.groups), np.tile(np.arange(turn.groups, dtype=np.int32), len(vectors))
                    ends, codes = np.zeros(len(owner) + 1, np.int32), np.zeros(0, np.int64)
                else:
                    codes = turn.probes(vectors.astype(np.float64), table)
                    owner, codes = np.repeat(np.arange(len(vectors)), codes.shape[1]), codes.reshape(-1)
                    groups = turn.group(codes)
                    order = np.lexsort((groups, owner))
                    owner, groups, codes = owner[order], groups[order], codes[order]
                    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (groups[1:] != groups[:-1])]))
                    ends = np.append(first, len(owner)).astype(np.int32)
                    owner, groups = owner[first], groups[first]
                columns = [pa.array(np.full(len(owner), table, np.int32)), pa.array(groups)]
                if with_vectors:
                    own = pa.array(owner)
                    columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(codes)), ids.take(own), raw.take(own)]
                yield pa.RecordBatch.from_arrays(columns, ["tab", "grp", "buckets", "id", "vec"][: len(columns)])

    return rows.mapInArrow(hashed, "tab int, grp int" + f", buckets array<long>, id {kind}, vec binary" * with_vectors)


def best_of(queries: tuple[np.ndarray, np.ndarray], index: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, index row, exact score) of each query's `k` best ids in a bucket, own ids left out. Index rows are in the order of ids."""
    (q_ids, q), (i_ids, x) = queries, index
    first = np.flatnonzero(np.concatenate([[True], i_ids[1:] != i_ids[:-1]]))
    if len(first) <= k:
        a, b = np.nonzero(q_ids[:, None] != i_ids[None, :])
        return a, b, np.sum(q[a] * x[b], axis=1)
    scores = q @ x.T
    scores[q_ids[:, None] == i_ids[None, :]] = -np.inf
    # an id has one place, that of its best row
    best = scores if len(first) == len(i_ids) else np.maximum.reduceat(scores, first, axis=1)
    least = np.partition(best, len(first) - k, axis=1)[:, len(first) - k][:, None]
    close = TIE * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1).max()
    above = best > least + close
    # of the ids that tie for the last places, the smallest
    tied = ~above & (best >= least - close)
    chosen = (above | (tied & (np.cumsum(tied, axis=1) <= k))) & (best > -np.inf)
    if len(first) < len(i_ids):
        owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(i_ids))))
        chosen = chosen[:, owner] & (scores >= best[:, owner] - close)
    a, b = np.nonzero(chosen)
    return a, b, np.sum(q[a] * x[b], axis=1)


def best_pairs(q: np.ndarray, i: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's `k` best ids, each id once, with its best score."""
    order = np.lexsort((-score, i, q))
    new = np.concatenate([[True], (q[order][1:] != q[order][:-1]) | (i[order][1:] != i[order][:-1])]) if len(order) else np.zeros(0, bool)
    order = order[new]
    order = order[np.lexsort((i[order], -score[order], q[order]))]
    own = q[order]
    start = np.searchsorted(own, own, "left")
    return order[np.arange(len(own)) - start < k]


def search(queries: DataFrame, index: DataFrame, turn: Rotations, kind: type, *, tables: int, k: int, index_block: int, query_block: int, every: bool = False) -> DataFrame:
    """query_id, id, score: each query's best of every table, `k` at most of every task. `index` as `hashed_index` gives it; `kind` of numbers."""
    own = F.posexplode(F.slice("places", 1, tables)).alias("tab", "place")
    sizes = index.select(own).groupBy("tab", F.col("place.grp").alias("grp")).agg(F.count("*").alias("n"))
    asked = query_rows(queries, turn, tables, False, every).groupBy("tab", "grp").agg(F.count("*").alias("m"))
    blocks = sizes.join(asked, ["tab", "grp"]).select("tab", "grp", F.ceil(F.col("n") / index_block).alias("ib"), F.ceil(F.col("m") / query_block).alias("qb"))
    blocks = F.broadcast(blocks) if tables * turn.groups <= BROADCAST_GROUPS else blocks

    def block(own: Column, count: Column) -> Column:
        return F.pmod(F.xxhash64(own), count)

    def each(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), count - 1))

    rows = index.select("id", "vec", own).select("tab", "place.grp", "place.bucket", "id", "vec").join(blocks, ["tab", "grp"]).select("tab", "grp", block(F.col("id"), F.col("ib")).alias("i"), each(F.col("qb")).alias("q"), "bucket", "id", "vec")
    asks = query_rows(queries, turn, tables, True, every).join(blocks, ["tab", "grp"]).select("tab", "grp", block(F.col("id"), F.col("qb")).alias("q"), each(F.col("ib")).alias("i"), "buckets", "id", "vec")
    dims, key, names = turn.dims, ["tab", "grp", "i", "q"], ["query_id", "id", "score"]

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims).astype(np.float64)

    def table_of(q: np.ndarray, i: np.ndarray, score: np.ndarray) -> pa.Table:
        """A row for each query, with its ids and scores. `q` is in order."""
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        ends = pa.array(np.append(first, len(q)).astype(np.int32))
        return pa.table([pa.array(q[first], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(i, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(score, pa.float64()))], ["query_id", "ids", "scores"])

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        if not left.num_rows or not right.num_rows:
            return table_of(none, none, none)
        q_ids, q = left.column("id").to_numpy().astype(np.int64), matrix(left.column("vec"))
        i_ids, x = right.column("id").to_numpy().astype(np.int64), matrix(right.column("vec"))
        where = np.zeros(len(i_ids), np.int64) if every else right.column("bucket").to_numpy()
        order = np.lexsort((i_ids, where))
        i_ids, x, where = i_ids[order], x[order], where[order]
        if every:
            owner, codes = np.arange(len(q_ids)), np.zeros(len(q_ids), np.int64)
        else:
            lists = left.column("buckets").combine_chunks()
            owner, codes = np.repeat(np.arange(len(q_ids)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        there = np.unique(where)
        order = np.argsort(codes, kind="stable")
        owner, codes = owner[order], codes[order]
        found = []
        bounds = [np.searchsorted(values, there, side) for values in (where, codes) for side in ("left", "right")]
        for a, b, c, d in zip(*[x.tolist() for x in bounds], strict=True):
            if c < d:
                mine = owner[c:d]
                one, two, score = best_of((q_ids[mine], q[mine]), (i_ids[a:b], x[a:b]), k)
                found.append((q_ids[mine[one]], i_ids[a + two], score))
        if not found:
            return table_of(none, none, none)
        qs, ids, scores = (np.concatenate(c) for c in zip(*found, strict=True))
        kept = best_pairs(qs, ids, scores, k)
        return table_of(qs[kept], ids[kept], scores[kept])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            queries, ids, scores = batch.columns
            owner = np.repeat(queries.to_numpy(), ids.value_lengths().to_numpy())
            held.append([owner, ids.flatten().to_numpy(), scores.flatten().to_numpy()])
            count += len(owner)
            if count > HELD:
                held = reduced(held)
                count = len(held[0][0])
                if count > HELD // 2:  # many queries: on to the next stage with them
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names)
                    held, count = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in reduced(held)[0]], names)

    def reduced(held: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
        q, i, score = (np.concatenate(c) for c in zip(*held, strict=True))
        kept = best_pairs(q, i, score, k)
        return [[q[kept], i[kept], score[kept]]]

    found = asks.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(ranked, "query_id long, ids array<long>, scores array<double>")
    return found.mapInArrow(of_task, "query_id long, id long, score double")


def top(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score: the best `k` of each query."""
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def neighbours(vectors: DataFrame, query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, tables: int = TABLES, probes: float = PROBES, bucket_rows: int = BUCKET_ROWS, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` rows of largest inner product found for every row that `query` (a condition on `id`) names."""
    every = usable(vectors, id_col, vector_col)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    lengths = every.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.max(square).alias("square"))
    out = every.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    for dims, rows, ids, largest in sorted(map(tuple, lengths.collect())):
        if ids < 2:
            continue
        own = every.filter(F.size("v") == dims)
        if ids < rows:  # a row that says the same again finds nothing new
            own = cut(own.distinct(), "vectors")
        turn = Rotations(dims, math.sqrt(largest), rows, tables=tables, probes=probes, bucket_rows=bucket_rows)
        asking, index = own.filter(query), hashed_index(own, turn)
        kind = np.float32 if isinstance(own.schema["v"].dataType.elementType, FloatType) else np.float64
        found = cut(top(search(asking, index, turn, kind, tables=tables, k=k, index_block=index_block, query_block=query_block), k), "nearest")
        full = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k, ids - 1))
        short = cut(asking.join(full, asking["id"] == full["query_id"], "left_anti"), "short")
        if short.limit(1).count():
            more = search(short, index, turn, kind, tables=1, k=k, index_block=index_block, query_block=query_block, every=True)
            found = top(found.select("query_id", "id", "score").unionByName(more), k)
        out = out.unionByName(found.select("query_id", "rank", F.col("id").alias("vec_id"), "score"))
    return out
