"""Near-duplicates in time: band join, bit distance, components, keeper."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.forest import joined
from tidemill.functions.pixels import hamming
from tidemill.operators.components import connected_components
from tidemill.operators.numbering import numbered
from tidemill.session import cut


#: Values that a row looks up in one part of its hash; where more would be needed, parts become smaller.
MOST_FLIPS = 4096
#: Comparisons in a block that cost as much as a value that is looked up through a shuffle, and as a row met there.
PROBE, MEETING = 1000, 4
#: Rows in a block that is compared with others, at least and at most, and blocks at most, beyond which they grow; pairs compared at once, and near ones told at once.
LEAST_BLOCK, BLOCK, MOST_BLOCKS, COMPARED, TOLD = 1 << 12, 1 << 17, 128, 1 << 18, 1 << 16


def band_pairs(rows: DataFrame, window: float, *, by: tuple[str, ...] = (), id: str = "id", ts: str = "ts", carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows at most `window` apart in `ts`, inclusive, within equal `by`: a_id, a_ts, b_id, b_ts and carried columns.

    An equi-join on buckets as wide as the window: the earlier row looks into its own bucket and the next one.
    """
    width = max(1, int(-(-window // 1)))
    cols = [F.col(id).alias("id"), F.col(ts).alias("ts"), *[F.col(c) for c in (*by, *carry)]]
    own = rows.filter(F.col(ts).isNotNull()).select(*cols).withColumn("_bucket", F.floor(F.col("ts") / width))
    left = own.select(*[F.col(c).alias(f"a_{c}") for c in own.columns if c != "_bucket"], F.explode(F.array("_bucket", F.col("_bucket") + 1)).alias("_bucket"))
    right = own.select(*[F.col(c).alias(f"b_{c}") for c in own.columns if c != "_bucket"], "_bucket")
    apart = F.col("b_ts") - F.col("a_ts")
    on = (left["_bucket"] == right["_bucket"]) & (apart >= 0) & (apart <= window) & ((apart > 0) | (F.col("a_id") < F.col("b_id")))
    for c in by:
        on = on & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    return left.join(right, on).drop("_bucket")


def hash_pairs(rows: DataFrame, distance: int, *, id: str = "id", value: str = "phash") -> DataFrame:
    """a, b, distance of 64-bit hashes at most `distance` bits apart, exactly: by multi-index probing, or block against block, whatever costs less."""
    known, n = _known(rows, id, value)
    if _probing_pays(n, distance):
        return probed_pairs(known, n, distance)
    return compared_pairs(known, n, distance)


def hash_groups(rows: DataFrame, distance: int, *, id: str = "id", value: str = "phash") -> DataFrame:
    """id, component of the rows that another row's 64-bit hash is at most `distance` bits from. Pairs aren't listed one by one unless they are few."""
    known, n = _known(rows, id, value)
    if _probing_pays(n, distance):
        return connected_components(probed_pairs(known, n, distance).select("a", "b"))
    return connected_components(compared_links(known, distance))


def _known(rows: DataFrame, id: str, value: str) -> tuple[DataFrame, int]:
    known = rows.select(F.col(id).alias("id"), F.col(value).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    return known, known.count()


def _parts(n: int, distance: int) -> tuple[list[int], int]:
    """Edges of the parts that hashes are cut into for probing, and the bits flipped in a part."""
    parts = max(1, 64 // max(8, math.ceil(math.log2(max(2, n)))))
    while parts <= distance and sum(math.comb(-(-64 // parts), f) for f in range(distance // parts + 1)) > MOST_FLIPS:
        parts += 1
    return [64 * k // parts for k in range(parts + 1)], distance // parts


def _probing_pays(n: int, distance: int) -> bool:
    """A row meets half of all rows by comparison. By probing it sends a row for each value that it looks up, and meets the rows of that bucket."""
    edges, flips = _parts(n, distance)
    cost = 0.0
    for lo, hi in itertools.pairwise(edges):
        cost += sum(math.comb(hi - lo, f) for f in range(flips + 1)) * (PROBE + MEETING * n / 2 ** (hi - lo))
    return cost < n / 2


def probed_pairs(known: DataFrame, n: int, distance: int) -> DataFrame:
    """a, b, distance of the `n` rows (id, v), by multi-index probing.

    The hash is cut into parts of about log2 of the number of rows bits. Two such hashes agree in one part at least up to `distance` over the number of
    parts, rounded down: every row is listed under its parts, and looks up its parts with that many bits flipped. A part's buckets
    stay near one row each however many rows there are. A pair counts in the first part that it agrees in.
    """
    edges, flips = _parts(n, distance)
    listed, asked = [], []

    def own(k: int, value: Column) -> Column:
        return F.shiftrightunsigned(value, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))

    def part(k: int, value: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), value.alias("p"))

    def flipped(k: int, masks: list[int]) -> Column:
        return F.transform(F.lit(masks).cast("array<long>"), lambda mask: part(k, own(k, F.col("v")).bitwiseXOR(mask)))

    for k, (lo, hi) in enumerate(itertools.pairwise(edges)):
        masks = [sum(1 << b for b in bits_of) for f in range(flips + 1) for bits_of in itertools.combinations(range(hi - lo), f)]
        listed.append(part(k, own(k, F.col("v"))))
        asked.append(flipped(k, masks))
    index = known.select(F.col("id").alias("b"), F.col("v").alias("w"), F.explode(F.array(*listed)).alias("key")).select("b", "w", "key.k", "key.p")
    probes = known.select(F.col("id").alias("a"), "v", F.explode(F.flatten(F.array(*asked))).alias("key")).select("a", "v", "key.k", "key.p")
    apart = F.col("v").bitwiseXOR(F.col("w"))
    first = F.coalesce(*[F.when(F.bit_count(own(k, apart)) <= flips, F.lit(k)) for k in range(len(edges) - 1)])
    near = probes.join(index, ["k", "p"]).filter((F.col("a") < F.col("b")) & (hamming(F.col("v"), F.col("w")) <= distance) & (F.col("k") == first))
    return near.select("a", "b", hamming(F.col("v"), F.col("w")).cast("long").alias("distance"))


def _blocks(rows: DataFrame, n: int) -> int:
    """Blocks that `n` rows are dealt into: enough for all tasks, none too small to be worth a task, and none of over `BLOCK` rows while that makes few blocks."""
    spread = math.ceil(math.sqrt(8 * rows.sparkSession.sparkContext.defaultParallelism))
    return max(min(spread, -(-n // LEAST_BLOCK)), min(-(-n // BLOCK), MOST_BLOCKS), 1)


def _met(placed: DataFrame, blocks: int, function, schema: str, *, own: bool = True) -> DataFrame:
    """Rows of a `function` of every two blocks' rows (`placed`, and the `other` block that they meet there); of each with itself as well, if `own`."""
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met if own else met.filter(F.col("other") != F.col("block"))
    met = met.withColumn("_meet", F.greatest("block", "other") * blocks + F.least("block", "other"))
    return met.repartition(blocks * (blocks + 1) // 2, "_meet").groupBy("_meet").applyInArrow(function, schema)


def _in_order(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    """Two blocks' rows in the order of their ids, and the ids' ranks."""
    rows = pa.Table.from_batches(batches).sort_by("id").combine_chunks()
    ids = rows.column("id")
    return rows, np.concatenate([[0], np.cumsum(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))])


def _near(rows: pa.Table, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of two blocks' rows that are near, one of either block or both of a block that meets itself, with their distances, about `TOLD` at a time."""
    hashes, block, other = rows.column("v").to_numpy().view(np.uint64), rows.column("block").to_numpy(), rows.column("other").to_numpy()
    single = block[0] == other[0]
    left, right = (np.arange(len(block)),) * 2 if single else (np.flatnonzero(block < other), np.flatnonzero(block > other))
    if not len(left) or not len(right):
        return
    one, two = hashes[left], hashes[right]
    step = max(1, COMPARED // len(right))
    told, waiting = [], 0
    apart, count, near = (np.empty(step * len(right) + 8, kind) for kind in (np.uint64, np.uint8, bool))
    for k in range(0, len(left), step):
        m, begin = min(step, len(left) - k), k if single else 0  # within one block, a row meets those from itself on
        width = len(right) - begin
        n = m * width
        np.bitwise_xor(one[k : k + m, None], two[None, begin:], out=apart[:n].reshape(m, width))
        np.bitwise_count(apart[:n], out=count[:n])
        np.less_equal(count[:n], distance, out=near[:n])
        near[n : n + 8] = False
        some = np.flatnonzero(near[: -(-n // 8) * 8].view(np.uint64))  # near pairs are few: eight are passed over at once
        found = (some[:, None] * 8 + np.arange(8))[near[some[:, None] * 8 + np.arange(8)]]
        i, j = np.divmod(found, width)
        bits = count[found]
        if single:
            later = j > i
            i, j, bits = i[later], j[later], bits[later]
        told.append((left[k + i], right[begin + j], bits))
        waiting += len(i)
        if waiting >= TOLD or k + step >= len(left):
            yield tuple(np.concatenate(column) for column in zip(*told, strict=True))
            told, waiting = [], 0


def compared_pairs(known: DataFrame, n: int, distance: int) -> DataFrame:
    """a, b, distance of the `n` rows (id, v): blocks of rows meet, each two in a task, and their hashes are compared all with all.

    Rows are shuffled once for each block, and memory is that of two blocks.
    """
    blocks, kind = _blocks(known, n), known.schema["id"].dataType.simpleString()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, rank = _in_order(batches)
        ids = rows.column("id").combine_chunks()
        for i, j, apart in _near(rows, distance):
            other = rank[i] != rank[j]
            a, b = np.minimum(i, j)[other], np.maximum(i, j)[other]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(apart[other].astype(np.int64))], ["a", "b", "distance"])

    placed = known.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return _met(placed, blocks, compared, f"a {kind}, b {kind}, distance long")


def compared_links(known: DataFrame, distance: int) -> DataFrame:
    """a, b whose components are those of all near pairs of the rows (id, v), at most about one for each row and block that it is linked in.

    Rows of one hash hang on the smallest id of them, and those are compared: at first within blocks, then block against block, where a row
    stands for the component that it has in its own block, so that what is joined already isn't told again.
    """
    hashes = cut(known.groupBy("v").agg(F.min("id").alias("id")), "hashes")
    copies = known.join(hashes.withColumnRenamed("id", "least"), "v").filter(F.col("id") != F.col("least")).select(F.col("least").alias("a"), F.col("id").alias("b"))
    n, kind = hashes.count(), known.schema["id"].dataType.simpleString()
    blocks = _blocks(known, n)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, rank = _in_order(batches)
        roots = np.arange(len(rank))
        for i, j, _ in _near(rows, distance):
            roots = joined(roots, i, j)
        of = rank[roots]  # ids repeat where rows do; one with several hashes is one node
        roots = joined(np.arange(len(rank)), rank, of)[rank]
        root = rows.column("id").take(pa.array(np.searchsorted(rank, roots)))
        yield from rows.select(["v", "id", "block"]).append_column("root", root).to_batches()

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, _ = _in_order(batches)
        names = rows.column("root").combine_chunks().dictionary_encode()
        node, roots = names.indices.to_numpy(), np.arange(len(names.dictionary))
        for i, j, _ in _near(rows, distance):
            roots = joined(roots, node[i], node[j])
        moved = np.flatnonzero(roots != np.arange(len(roots)))
        yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(roots[moved])), names.dictionary.take(pa.array(moved))], ["a", "b"])

    placed = hashes.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.col("block"))
    schema = f"v long, id {kind}, block int, root {kind}"
    rooted = cut(placed.repartition(blocks, "block").groupBy("block").applyInArrow(within, schema), "rooted")
    links = rooted.filter(F.col("root") != F.col("id")).select(F.col("root").alias("a"), F.col("id").alias("b"))
    if blocks > 1:
        links = links.unionByName(_met(rooted, blocks, between, f"a {kind}, b {kind}", own=False))
    return links.unionByName(copies)


def similar_links(items: DataFrame, window: float, distance: int) -> DataFrame:
    """a, b of items (id, ts, phash, edited_of) close in time and looks, edited pairs left out as links.

    Of distance + 1 parts of a hash, two that are near agree in one whole part: the band join meets by part, so that very many photos of one
    moment aren't compared with each other. A pair counts in the first part that it agrees in.
    """
    parts = min(distance + 1, 64)
    edges = [64 * k // parts for k in range(parts + 1)]
    masks = [((1 << hi) - (1 << lo)) - (1 << 64 if hi == 64 else 0) for lo, hi in itertools.pairwise(edges)]
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("phash").bitwiseAND(F.lit(m).cast("long")).alias("v")) for k, m in enumerate(masks)])
    keyed = items.select("id", "ts", "phash", "edited_of", F.explode(keys).alias("_key")).select("id", "ts", "phash", "edited_of", F.col("_key.k").alias("_part"), F.col("_key.v").alias("_value"))
    pairs = band_pairs(keyed, window, by=("_part", "_value"), carry=("phash", "edited_of"))
    apart = F.col("a_phash").bitwiseXOR(F.col("b_phash"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(k)) for k, m in enumerate(masks)])
    edited = F.coalesce(F.col("a_edited_of") == F.col("b_id"), F.lit(False)) | F.coalesce(F.col("b_edited_of") == F.col("a_id"), F.lit(False))
    return pairs.filter((F.col("a__part") == first) & ~edited & (F.bit_count(apart) <= distance)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def similar_groups(items: DataFrame, *, window: float = 60.0, distance: int = 6, run_id: int = 1) -> DataFrame:
    """id, group_id, keeper_id, keeper_path, is_keeper, delta of items (id, ts, phash, edited_of, sharpness, width, height, path).

    The sharpest of a group stays, then the largest, then the smallest id. Groups are numbered by their smallest id: `s<run>-<n>`.
    """
    known = items.filter(F.col("phash").isNotNull() & F.col("ts").isNotNull())
    comps = connected_components(similar_links(known, window, distance))
    members = known.join(comps, "id")
    pixels = F.coalesce(F.col("width"), F.lit(0)) * F.coalesce(F.col("height"), F.lit(0))
    best = F.struct((-F.coalesce("sharpness", F.lit(-1.0))).alias("s"), (-pixels).alias("p"), F.col("id").alias("id"), F.col("ts").alias("ts"), F.col("path").alias("path"))
    groups = members.groupBy("component").agg(F.min(best).alias("_best"))
    named = numbered(groups, "component").withColumn("group_id", F.concat(F.lit(f"s{run_id}-"), F.col("nth").cast("string")))
    placed = members.select("id", "ts", "component").join(named, "component")
    return placed.select("id", "group_id", F.col("_best.id").alias("keeper_id"), F.col("_best.path").alias("keeper_path"), (F.col("id") == F.col("_best.id")).alias("is_keeper"), F.abs(F.col("ts") - F.col("_best.ts")).alias("delta"))


def time_neighbours(rows: DataFrame, window: float, *, bucket: int, id: str = "id", ts: str = "ts") -> DataFrame:
    """id of the rows whose previous or next row in time is at most `window` away.

    Neighbours are looked up in time buckets; a bucket's first and last instant stand in for it next door, so there is no global order.
    """
    own = rows.filter(F.col(ts).isNotNull()).select(F.col(id).alias("id"), F.col(ts).alias("ts")).withColumn("_bucket", F.floor(F.col("ts") / bucket))
    edges = own.groupBy("_bucket").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    far = edges.select((F.col("_bucket") + 1).alias("_bucket"), F.col("_last").alias("_before")).join(edges.select((F.col("_bucket") - 1).alias("_bucket"), F.col("_first").alias("_after")), "_bucket", "full_outer")
    w = Window.partitionBy("_bucket").orderBy("ts", "id")
    placed = own.join(far, "_bucket", "left").withColumn("_p", F.coalesce(F.lag("ts").over(w), "_before")).withColumn("_n", F.coalesce(F.lead("ts").over(w), "_after"))
    return placed.filter((F.col("ts") - F.col("_p") <= window) | (F.col("_n") - F.col("ts") <= window)).select("id")
