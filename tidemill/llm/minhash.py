"""Near-duplicates by min-max hashing.

A document's set holds the distinct shingles of five words; a permutation gives two values of its signature, the minimum and the maximum
over the set, so that a signature of `VALUES` values takes half as many hash evaluations. Bands of `BAND` values key the
buckets in which candidates meet. Documents of equal sets are one class, a node with a number of its own.

A bucket is open while its members belong to several components. First come `ROUNDS` star rounds: every open bucket names a centre, and
each class is compared with the centres that it shares most bands with. That joins nearly all that belongs together, at a few
comparisons a class, however large a bucket is. Then every pair of classes that still meets in an open bucket without being in one component is
compared, by one rule for buckets of any size. A class has a home, the largest open bucket that it is in, whose classes are dealt in blocks of
`BLOCK`; two blocks meet in one task if they share an open bucket, each class coming at most once to it, and the task
counts the intersections of all pairs at once as a product of incidence matrices. What leaves it is one link for each component that it joins,
never a row for a pair. So no pair across components that shares a band goes unseen, and nothing is limited to a number of partners.

All decisions are made on the full sets of 64-bit shingle hashes, computed from whole texts: 100 * intersection >= 75 * union.
Links and components stay distributed; intermediate tables are deleted as soon as the next one is written.

Defined cases: a text without words, or null, has an empty set and is linked with nothing; with fewer than five words, the whole sequence is
one shingle; rows that repeat a doc_id are one node with the links of each of its texts; a null doc_id is its own component
(component_id null, kept); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.rows import columns_of, row_of
from tidemill.llm.text import MIX, WordHashes, give_back, mixed, texts_of
from tidemill.operators.components import connected_components
from tidemill.session import cut, release

SHINGLE = 5
VALUES = 128
BAND = 4
SIMILAR = 75
SEED = 5
#: Classes of one home that come to a task together, and the shingles they may have in sum unless one alone has more.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
#: Members of a centre whose texts come to a task one after the other.
CHUNK = 128
#: Star rounds, and the centres that a class is compared with in each after the first.
ROUNDS = 2
TRIES = 3
#: Rows of a table of ids up to which it is broadcast to the texts; beyond, texts are shuffled.
BROADCAST_ROLES = 250_000
#: Shingles that are permuted at once.
STRIP = 8192
#: Shared shingles that are multiplied at once.
COLUMNS = 4096

_RNG = np.random.default_rng(SEED)
FACTORS = (_RNG.integers(0, 1 << 31, VALUES // 2) * 2 + 1).astype(np.uint32)[:, None]
SHIFTS = _RNG.integers(0, 1 << 32, VALUES // 2).astype(np.uint32)[:, None]


def shingle_set(text: bytes, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's five-word shingles, ASCII letters in lower case."""
    h = words.of(text.lower().split())
    if not len(h):
        return h
    width = min(SHINGLE, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = out * MIX + h[k : len(h) - width + 1 + k]
    return np.unique(mixed(out + np.uint64(width)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation, side by side: VALUES numbers of 32 bits."""
    small = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    low, high = np.full(VALUES // 2, 0xFFFFFFFF, np.uint32), np.zeros(VALUES // 2, np.uint32)
    for at in range(0, small.shape[1], STRIP):
        turned = small[:, at : at + STRIP] * FACTORS + SHIFTS
        low, high = np.minimum(low, turned.min(axis=1)), np.maximum(high, turned.max(axis=1))
    return np.stack([low, high], axis=1).reshape(-1)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a signature; bands have keys of their own."""
    values = sig.reshape(-1, BAND).astype(np.uint64)
    out = np.arange(1, len(values) + 1, dtype=np.uint64)
    for k in range(BAND):
        out = mixed(out * MIX + values[:, k])
    return out.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, n_shingles, digest of the set and band keys of every row; for empty sets no digest and no keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in texts_of(batch.column(2)):
                own = shingle_set(text, words)
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                keys.append(band_keys(signature(own)) if len(own) else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], ["doc_id", "hash", "n_shingles", "digest", "keys"])
        words.clear()
        give_back()

    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("hash"), text.alias("text")).mapInArrow(sketched, f"doc_id {kind}, hash long, n_shingles long, digest binary, keys array<long>")


def classes_of(every: DataFrame) -> DataFrame:
    """digest, node, doc_id and hash of one row, n_shingles, keys of every class of equal sets."""
    known = every.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    one = known.groupBy("digest").agg(F.min(F.struct("doc_id", "hash")).alias("r"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    # written at once: a number given by partition and place stays what it was
    return cut(one.select("digest", F.monotonically_increasing_id().alias("node"), "r.doc_id", "r.hash", "n_shingles", "keys"), "classes")


def with_texts(roles: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """`roles` (node and other columns) with the text of each node; the rows are counted, and broadcast where they are few."""
    named = cut(roles.join(classes.select("node", F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")), "node"), "roles")
    sent = F.broadcast(named) if named.count() <= BROADCAST_ROLES else named
    text = F.col("text").cast("string")
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_own"))
    return texts.join(sent, (F.col("doc_id") == F.col("_id")) & (F.col("_own") == F.col("_hash"))).select(*roles.columns, "text")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose full sets are similar enough. b is the centre whose text serves all its members."""
    chunks = pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    members = pairs.join(chunks, "b").select(F.col("a").alias("node"), F.col("b").alias("centre"), F.pmod(F.xxhash64("a"), F.col("chunks")).alias("chunk"), F.lit(1).alias("member"))
    centres = chunks.select(F.col("b").alias("node"), F.col("b").alias("centre"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("member"))
    roles = with_texts(members.unionByName(centres), classes, docs).select("centre", "chunk", "member", "node", "text")
    # a centre comes before its members, so that a task holds one centre's set at a time
    dealt = roles.repartition("centre", "chunk").sortWithinPartitions("centre", "chunk", "member")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, key, middle = WordHashes(), None, None
        for batch in batches:
            out = []
            rows = zip(*[batch.column(k).to_pylist() for k in range(4)], texts_of(batch.column(4)), strict=True)
            for centre, chunk, member, node, text in rows:
                if (centre, chunk) != key:
                    key, middle = (centre, chunk), None
                if not member:
                    middle = shingle_set(text, words)
                    continue
                own = shingle_set(text, words)
                if 100 * min(len(own), len(middle)) >= SIMILAR * max(len(own), len(middle)):
                    same = len(np.intersect1d(own, middle, assume_unique=True))
                    if 100 * same >= SIMILAR * (len(own) + len(middle) - same):
                        out.append((node, centre))
            nodes, middles = zip(*out, strict=True) if out else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(middles, pa.int64())], ["a", "b"])
        words.clear()
        give_back()

    return dealt.mapInArrow(compared, "a long, b long")


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets of `left` with all of `right`, as a product of incidence matrices over what sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    met = shared[column]
    owner, column = owner[met], (np.cumsum(shared) - 1)[column[met]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        strip = np.zeros((len(sets), COLUMNS), np.float32)
        strip[owner[a:b], column[a:b] - at] = 1
        out += strip[left] @ strip[right].T
    return out


def joined(comps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of `comps`, numbered from 0, the least that the links between rows `a` and `b` join it with."""
    label, x, y = np.arange(comps.max() + 1), comps[a], comps[b]
    while True:
        least, new = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def across(open_rows: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links a, b that join all components with similar classes in one open bucket. `open_rows`: key, node, comp."""
    sizes = open_rows.groupBy("key").agg(F.count("*").alias("n"))
    home = open_rows.join(sizes, "key").groupBy("node", "comp").agg(F.max(F.struct("n", "key")).alias("home")).select("node", "comp", F.col("home.key").alias("home"))
    home = home.join(classes.select("node", "n_shingles"), "node")
    blocks = home.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    placed = home.join(blocks, "home").select("node", "comp", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("block"))
    here = cut(open_rows.select("key", "node").join(placed, "node"), "placed")
    met = here.groupBy("key").agg(F.collect_set("block").alias("blocks"))
    others = here.join(met, "key").groupBy("node", "comp", "block").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("others"))
    roles = others.select("node", "comp", "block", F.explode("others").alias("other"))
    roles = roles.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp")

    def compared(rows: pa.Table) -> pa.Table:
        nodes, first = np.unique(rows.column("node").to_numpy(), return_index=True)
        comps, names = rows.column("comp").to_numpy()[first], ["a", "b"]
        number = np.unique(comps, return_inverse=True)[1]
        none = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64())], names)
        if number.max() == 0:
            return none
        blocks, words = rows.column("block").to_numpy()[first], WordHashes()
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        left, right = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
        texts = rows.column("text").take(pa.array(first)).combine_chunks()
        sets = [shingle_set(text, words) for text in texts_of(texts)]
        size = np.array([len(s) for s in sets], np.float64)
        same = intersections(sets, left, right).astype(np.float64)
        near = 100 * same >= SIMILAR * (size[left][:, None] + size[right][None, :] - same)
        a, b = np.nonzero(near & (number[left][:, None] != number[right][None, :]))
        label = joined(number, left[a], right[b])
        moved = np.flatnonzero(label != np.arange(len(label)))
        some = np.zeros(len(label), np.int64)
        some[number] = nodes  # any node of a component stands for it
        return pa.table([pa.array(some[moved]), pa.array(some[label[moved]])], names)

    dealt = with_texts(roles, classes, docs)
    links = cut(dealt.groupBy("i", "j").applyInArrow(compared, "a long, b long"), "links")
    release(here)
    return links


def centres_of(rows: DataFrame, turn: int) -> DataFrame:
    """key, centre, centre_comp of every open bucket of `rows` (key, node, comp)."""
    least, most = F.min("comp").alias("least"), F.max("comp").alias("most")
    if turn == 0:  # every node is its own component
        found = rows.groupBy("key").agg(least, most).withColumn("c", F.struct(F.col("least").alias("node"), F.col("least").alias("comp")))
    else:
        found = rows.groupBy("key").agg(least, most, F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), "node", "comp")).alias("c"))
    return found.filter(F.col("least") != F.col("most")).select("key", F.col("c.node").alias("centre"), F.col("c.comp").alias("centre_comp"))


def tries(rows: DataFrame, most: int) -> DataFrame:
    """a, b: for every class, the `most` centres of other components that it shares most bands with."""
    met = rows.filter(F.col("comp") != F.col("centre_comp")).groupBy("node", "centre").agg(F.count("*").alias("times"))
    # a class has no more centres than bands
    best = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("times")).alias("t"), F.xxhash64("node", "centre").alias("h"), "centre"))), 1, most).alias("best"))
    return best.select(F.col("node").alias("a"), F.explode("best.centre").alias("b"))


def class_components(classes: DataFrame, docs: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """node, component of every class that is linked with another, `links` (a, b) that are known included."""
    written = []
    known = classes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0) if links is None else links
    rows, comps = classes.select("node", F.explode("keys").alias("key"), F.col("node").alias("comp")), None
    for turn in range(ROUNDS + 1):
        before, rows = rows, cut(rows.join(centres_of(rows, turn), "key").select("key", "node", "comp", "centre", "centre_comp"), "open")
        release(before)
        if not rows.limit(1).count():
            break
        if turn < ROUNDS:
            pairs = cut(tries(rows, 1 if turn == 0 else TRIES), "pairs")
            written.append(cut(verified(pairs, classes, docs), "links"))
            release(pairs)
        else:
            written.append(across(rows.select("key", "node", "comp"), classes, docs))
        known = known.unionByName(written[-1])
        comps = cut(connected_components(known).select(F.col("id").alias("node"), "component"), "comps")
        if turn < ROUNDS:
            placed = rows.select("key", "node").join(comps, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
            before, rows = rows, cut(placed, "placed")
            release(before)
    release(rows)
    if comps is None:
        comps = cut(connected_components(known).select(F.col("id").alias("node"), "component"), "comps")
    for table in written:
        release(table)
    return comps


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs` (doc_id, text)."""
    every = cut(sketches(docs), "sketches")
    classes = classes_of(every)
    named = every.select("doc_id", "digest").filter(F.col("doc_id").isNotNull()).join(classes.select("digest", "node"), "digest").select("doc_id", "node")
    # a doc_id with several texts links their classes
    several = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).filter(F.col("a") != F.col("most")).select("doc_id", "a")
    same = cut(named.join(several, "doc_id").select("a", F.col("node").alias("b")), "links")
    comps = class_components(classes, docs, same)
    placed = classes.join(comps, "node", "left").select("digest", "doc_id", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = cut(placed.join(least, "component").select("digest", "component_id"), "components")
    release(classes)
    release(comps)
    out = every.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each group of near-duplicates: the one of smallest doc_id, then of smallest text hash.

    A doc_id with several texts is several documents here. Rows of equal doc_id and text are one; rows without doc_id stay.
    """
    every = cut(sketches(docs), "sketches")
    classes = classes_of(every)
    comps = class_components(classes, docs)
    placed = classes.join(comps, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    named = every.select("doc_id", "hash", "digest").filter(F.col("doc_id").isNotNull()).join(placed, "digest").select("doc_id", "hash", "component").distinct()
    kept = named.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "hash")).alias("k")).filter("n > 1").select("component", "k")
    dropped = cut(named.join(kept, "component").filter(F.struct("doc_id", "hash") != F.col("k")).select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")), "dropped")
    again = every.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).agg(F.count("*").alias("n")).filter("n > 1").select("_id", "_hash")
    again = cut(again.join(dropped, ["_id", "_hash"], "left_anti"), "again")
    for table in (every, classes, comps):
        release(table)
    own = docs.select(row_of(docs))

    def known(table: DataFrame, how: str, rows: DataFrame = own) -> DataFrame:
        sent = F.broadcast(table) if table.count() <= BROADCAST_ROLES else table
        return rows.join(sent, (F.col("_row.doc_id") == F.col("_id")) & (F.xxhash64(F.col("_row.text").cast("string")) == F.col("_hash")), how)

    rest = known(dropped, "left_anti")
    if again.limit(1).count():
        twice = known(again, "left_semi").withColumn("_hash", F.xxhash64(F.col("_row.text").cast("string"))).withColumn("_id", F.col("_row.doc_id"))
        rest = known(again, "left_anti", rest).unionByName(twice.dropDuplicates(["_id", "_hash"]).select("_row"))
    return rest.select(*columns_of(docs))
