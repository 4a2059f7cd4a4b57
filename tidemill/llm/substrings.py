"""Repeated substrings by prefix-free parsing.

Triggers are the rolling-hash minimizers of a text: in every window of `LENGTH` bytes, the leftmost `GRAM`-byte string of least hash. They depend on
the window alone, so equal windows have equal triggers. Neighbouring windows of one trigger make a phrase: the bytes from the first
of these windows to the end of the last, so that phrases overlap and hold whole windows. (A periodic run, whose trigger comes again and again, is one
phrase.) Phrases go into a dictionary with their numbers of occurrences, and a text's parse is its list of phrases. Equal windows lie in
phrases of equal trigger, so the corpus order is made trigger by trigger, over the triggers that occur more than once: a phrase that
the parse has twice repeats as a whole, at once; the other phrases of a trigger go through the suffix array of their part of
the dictionary. It is made by prefix doubling, so that ranks are the alphabetical order of the suffixes' first `LENGTH` bytes, found from the
bytes themselves; suffixes of equal rank, weighted by their phrases' counts in the parse, are one class of the corpus order. As a phrase holds its
windows whole, order inside `LENGTH` bytes never reaches past its end, so all that is needed of the parse's own suffix array is
these counts. Windows whose fingerprint is alone in its trigger don't enter the suffix array: equal bytes have equal fingerprints.

Repetitive text collapses in the dictionary before any bytes move; the bytes of a phrase move only once, and only where its trigger has other phrases.
A trigger with more than `HOT` phrases is dealt out by window instead, under 128-bit digests that are counted by partial aggregation, so no
trigger is ever one task's own. Phrases and documents of a dictionary are told apart by 64-bit digests beside 64 bits of the trigger or of the doc_id.

Defined cases: null is an empty text; texts shorter than `LENGTH` bytes lose nothing; repeated rows are separate documents, so each is
the other's repetition; rows that repeat a doc_id with another text are told apart by a hash of the text; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.text import mixed, texts_of
from tidemill.session import cut, release

LENGTH = 400
GRAM = 32
#: Bytes of a text that are searched for triggers at once.
STRIP = 1 << 20
#: Phrase bytes that are put in order at once; a trigger's phrases stay together.
BUFFER = 1 << 22
#: Phrases of a trigger from which its windows are counted by aggregation.
HOT = 8192

_RNG = np.random.default_rng(9)
WORD_FACTORS = _RNG.integers(0, 1 << 63, 4).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUES = _RNG.integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RNG.integers(0, 1 << 61)) * 8 + 5
PLACE_BITS = np.uint64(22)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at every place of `raw`."""
    places = len(raw) - GRAM + 1
    words = np.empty(len(raw) - 7, np.uint64)
    for k in range(8):
        own = raw[k : k + (len(raw) - k) // 8 * 8].view(np.uint64)
        words[k::8] = own[: len(words[k::8])]
    out = words[:places] * WORD_FACTORS[0]
    for k in range(1, GRAM // 8):
        out = mixed_once(out) + words[8 * k : 8 * k + places] * WORD_FACTORS[k]
    return mixed(out)


def mixed_once(values: np.ndarray) -> np.ndarray:
    return values ^ (values >> np.uint64(29))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    n = len(values)
    pad = -n % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Trigger place, first window, last window, trigger hash and whether the trigger's place moves, of every phrase of a text."""
    places, firsts, lasts, hashes, moves = [], [], [], [], []
    width = length - GRAM + 1
    for at in range(0, max(0, len(text) - length + 1), STRIP):
        raw = np.frombuffer(text[at : at + STRIP + length - 1], np.uint8)
        own = gram_hashes(raw)
        keyed = (own >> PLACE_BITS << PLACE_BITS) | np.arange(len(own), dtype=np.uint64)
        trigger = (sliding_minimum(keyed, width) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        kind = own[trigger]
        start = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        end = np.append(start[1:] - 1, len(trigger) - 1)
        places.append(trigger[start] + at)
        firsts.append(start + at)
        lasts.append(end + at)
        hashes.append(kind[start])
        moves.append(trigger[start] != trigger[end])
    if not places:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    return tuple(np.concatenate(x) for x in (places, firsts, lasts, hashes, moves))


def parse(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, hash, first, last, trigger, phrase, moves of every phrase of every row of `docs` (id, hash, text)."""
    kind = docs.schema["id"].dataType.simpleString()
    names, kinds = ["first", "last", "trigger", "phrase", "moves"], (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owners = [], []
            for row, text in enumerate(texts_of(batch.column(2))):
                _, first, last, trigger, moves = runs(text, length)
                ends = (last + length).tolist()
                phrase = [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(first.tolist(), ends, strict=True)]
                found.append((first, last, trigger.view(np.int64), np.array(phrase, np.uint64).view(np.int64), moves))
                owners.append(np.full(len(first), row))
            owner = pa.array(np.concatenate(owners) if owners else np.zeros(0, np.int64), pa.int64())
            columns = [pa.array(np.concatenate([f[k] for f in found]) if found else [], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *columns], ["id", "hash", *names])

    return docs.select("id", "hash", "text").mapInArrow(parsed, f"id {kind}, hash long, first int, last int, trigger long, phrase long, moves boolean")


def powers(count: int, base: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def prints(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit fingerprint of the `length` bytes from each place."""
    up = powers(len(raw) + 1, BASE)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[raw] * up[:-1], dtype=np.uint64)])
    return mixed((sums[at + length] - sums[at]) * powers(len(raw) + 1, pow(BASE, -1, 1 << 64))[at])


def suffix_ranks(raw: np.ndarray, length: int) -> np.ndarray:
    """Alphabetical ranks of the first `length` bytes of every suffix, by prefix doubling; equal bytes have equal ranks.

    Suffixes that end before are taken to go on with zeros.
    """
    wide = np.concatenate([raw, np.zeros(7, np.uint8)])
    words = np.zeros(len(raw), np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | wide[k : k + len(raw)]
    ranks, depth = np.unique(words, return_inverse=True)[1].astype(np.uint64), 8
    while depth < length:
        step = min(depth, length - depth)
        ahead = np.concatenate([ranks[step:] + np.uint64(1), np.zeros(min(step, len(ranks)), np.uint64)])
        ranks, depth = np.unique(ranks << np.uint64(32) | ahead, return_inverse=True)[1].astype(np.uint64), depth + step
    return ranks


def occurring_twice(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Whether the weights of all that have the same key come to two at least."""
    _, kind = np.unique(keys, return_inverse=True)
    return (np.bincount(kind, weights) > 1)[kind]


def equal_windows(phrases: list[tuple[int, int, bytes]], length: int) -> list[np.ndarray]:
    """For each phrase (trigger, count, bytes), which of its windows occur at least twice."""
    sizes = np.array([len(x[2]) for x in phrases])
    windows = sizes - length + 1
    counts = np.array([x[1] for x in phrases])
    raw = np.frombuffer(b"".join([x[2] for x in phrases]), np.uint8)
    owner = np.repeat(np.arange(len(phrases)), windows)
    at = np.arange(len(owner)) + np.repeat((length - 1) * np.arange(len(phrases)), windows)
    triggers = np.array([x[0] for x in phrases], np.int64).view(np.uint64)[owner]
    repeated = occurring_twice(prints(raw, at, length) ^ mixed(triggers), counts[owner])
    # the suffix array holds the phrases in which a fingerprint comes again
    kept = np.zeros(len(phrases), bool)
    kept[owner[repeated]] = True
    if kept.any():
        bounds = np.cumsum(sizes)
        part = np.concatenate([raw[end - size : end] for end, size in zip(bounds[kept].tolist(), sizes[kept].tolist(), strict=True)])
        inside = kept[owner]
        own = np.repeat(np.arange(int(kept.sum())), windows[kept])
        places = np.arange(len(own)) + (length - 1) * own
        repeated[inside] = occurring_twice(suffix_ranks(part, length)[places], counts[owner[inside]])
    return np.split(repeated, np.cumsum(windows)[:-1])


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every run of true values."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def phrase_bytes(open_phrases: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """trigger, phrase, n, bytes of `open_phrases`, each from one place of a text that has it."""
    asked = open_phrases.groupBy("id", "hash").agg(F.collect_list(F.struct("first", "last", "trigger", "phrase", "n")).alias("asked"))
    texts = docs.join(asked, ["id", "hash"]).select("text", "asked")

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, own in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                rows += [(x["trigger"], x["phrase"], x["n"], text[x["first"] : x["last"] + length]) for x in own]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.binary(),), strict=True)], ["trigger", "phrase", "n", "bytes"])

    return texts.mapInArrow(sliced, "trigger long, phrase long, n long, bytes binary")


def contested(open_phrases: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """trigger, phrase, starts, ends: the repeated windows of phrases that aren't repeated as a whole, as distances from the first."""
    dealt = phrase_bytes(open_phrases, docs, length).repartition("trigger").sortWithinPartitions("trigger")

    def ordered(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for row, flags in zip(rows, equal_windows([(r[0], r[2], r[3]) for r in rows], length) if rows else (), strict=True):
            if row[2] == 1 and flags.any():
                first, last = spans(flags)
                out.append((row[0], row[1], first.tolist(), last.tolist()))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["trigger", "phrase", "starts", "ends"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held >= BUFFER and row[0] != rows[-1][0]:
                    yield ordered(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[3])
        yield ordered(rows)

    return dealt.mapInArrow(compared, "trigger long, phrase long, starts array<long>, ends array<long>")


def counted(open_phrases: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """`contested` for triggers with very many phrases: a row for each window, counted by its digest wherever it is."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for trigger, phrase, n, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                digests = [xxhash.xxh3_128_digest(raw[k : k + length]) for k in range(len(raw) - length + 1)]
                columns = [pa.array([x] * len(digests), pa.int64()) for x in (trigger, phrase, n)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(range(len(digests)), pa.int64()), pa.array(digests, pa.binary())], ["trigger", "phrase", "n", "at", "digest"])

    rows = phrase_bytes(open_phrases, docs, length).mapInArrow(digested, "trigger long, phrase long, n long, at long, digest binary")
    twice = rows.groupBy("digest").agg(F.sum("n").alias("times")).filter("times > 1").select("digest")
    found = rows.filter("n = 1").join(twice, "digest").groupBy("trigger", "phrase").agg(F.sort_array(F.collect_list("at")).alias("starts"))
    return found.select("trigger", "phrase", "starts", F.col("starts").alias("ends"))


def repeated_windows(docs: DataFrame, *, length: int = LENGTH, hot: int | None = None) -> DataFrame:
    """id, hash, starts, ends: for each document with any, the places of windows that occur elsewhere. `docs`: id, hash, text."""
    every = cut(parse(docs, length), "parse")
    # a trigger that occurs once has no equal window elsewhere, and inside its phrase only if its place moves
    again = every.groupBy("trigger").agg(F.count("*").alias("times"), F.max("moves").alias("turns")).filter((F.col("times") > 1) | F.col("turns")).select("trigger")
    occurrences = cut(every.join(again, "trigger"), "occurrences")
    release(every)
    dictionary = occurrences.groupBy("trigger", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("id", "hash", "first", "last")).alias("at"), F.max("moves").alias("moves"))
    dictionary = cut(dictionary, "dictionary")
    kinds = dictionary.groupBy("trigger").agg(F.count("*").alias("phrases"), F.max("moves").alias("turns"))
    shared = kinds.filter((F.col("phrases") > 1) | F.col("turns")).select("trigger", (F.col("phrases") > (HOT if hot is None else hot)).alias("hot"))
    open_phrases = cut(dictionary.join(shared, "trigger").select("trigger", "phrase", "n", "at.*", "hot"), "open")
    partly = contested(open_phrases.filter("not hot"), docs, length)
    if open_phrases.filter("hot").limit(1).count():
        partly = partly.unionByName(counted(open_phrases.filter("hot"), docs, length))
    wholly = dictionary.filter(F.col("n") > 1).select("trigger", "phrase", F.lit(None).cast("array<long>").alias("starts"), F.lit(None).cast("array<long>").alias("ends"))
    verdicts = cut(partly.unionByName(wholly), "verdicts")
    release(dictionary)
    release(open_phrases)
    found = occurrences.join(verdicts, ["trigger", "phrase"])
    one = F.array(F.struct(F.col("first").cast("long").alias("a"), F.col("last").cast("long").alias("b")))
    some = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct((x["starts"] + F.col("first")).alias("a"), (x["ends"] + F.col("first")).alias("b")))
    placed = found.select("id", "hash", F.explode(F.when(F.col("starts").isNull(), one).otherwise(some)).alias("w"))
    windows = cut(placed.groupBy("id", "hash").agg(F.collect_list("w").alias("windows")), "windows")
    release(occurrences)
    release(verdicts)
    return windows


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of every row of `docs` (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # id and hash only tell texts apart, so a null doc_id may go under any id: one that meets it with the same hash has the same text
    id = F.coalesce("doc_id", F.lit(0).cast(kind))
    own = docs.select("doc_id", id.alias("id"), text.alias("text")).withColumn("hash", F.xxhash64("text"))
    found = repeated_windows(own.select("id", "hash", "text"), length=length).withColumnsRenamed({"id": "_id", "hash": "_hash"})
    placed = own.join(found, (own["id"] == found["_id"]) & (own["hash"] == found["_hash"]), "left").select("doc_id", "text", "windows")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text]

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            lists = batch.column(2)
            for k, raw in enumerate(texts_of(batch.column(1))):
                gone, merged = 0, []
                if lists[k].is_valid:
                    inner = lists[k].values
                    a, b = (inner.field(i).to_numpy() for i in (0, 1))
                    order = np.argsort(a, kind="stable")
                    a, reach = a[order], np.maximum.accumulate(b[order] + length)
                    new = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
                    merged = list(zip(a[new].tolist(), np.append(reach[new[1:] - 1], reach[-1]).tolist(), strict=True))
                    gone = sum(y - x for x, y in merged)
                kept = raw
                if merged:
                    kept = b"".join([raw[x:y] for x, y in zip([0] + [y for _, y in merged], [x for x, _ in merged] + [len(raw)], strict=True)])
                rows.append((len(raw), gone, len(merged), hashlib.sha256(kept).hexdigest(), kept)[: 4 + with_text])
            columns = list(zip(*rows, strict=True)) or [[]] * (4 + with_text)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    return placed.mapInArrow(removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
