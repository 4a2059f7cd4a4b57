"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, word pairs and pairs that skip one word, lower-cased in ASCII
with ASCII punctuation as white space. FTRL-proximal keeps a rate for each coordinate; its L1 term leaves most weights at
exactly zero, so that the model shipped to executors is a short list whose size is bounded by `SLOTS`.

Learning uses a sample of at most about `TRAIN_ROWS` labelled rows, chosen by hash, one text a doc_id; scoring covers every row and whole texts.

Defined cases: a null or empty text has no features and gets the score of the bias alone; rows whose label is null teach nothing;
without labelled rows of both kinds the score is the share of toxic labels, 0 with none; a doc_id with several labels counts as
toxic if any says so; a null doc_id is never held out; repeated rows get the same score; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemill.llm.rows import columns_of, row_of
from tidemill.llm.text import MIX, WordHashes, give_back, mixed, texts_of

SLOTS = 1 << 20
TRAIN_ROWS = 16_000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 40.0, 1.0
#: Weight of a toxic row's gradient: toxic rows are few, and what marks them is rare.
TOXIC_WEIGHT = 6.0
#: A feature enters the model once this many sampled rows have it.
LEAST_ROWS = 4
TOXIC_AT = 0.7

#: ASCII letters to lower case, ASCII punctuation to a space; other bytes stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if re.match(rb"[!-/:-@\[-`{-~]", bytes([c])) else c for c in range(256))


def features(text: bytes, cache: WordHashes) -> np.ndarray:
    """Distinct slots of a text's words, pairs and skip pairs."""
    h = cache.of(text.translate(FOLD).split())
    pairs = mixed(h[:-1] * MIX + h[1:])
    skips = mixed(h[:-2] * MIX + h[2:] + np.uint64(1))
    return np.unique((np.concatenate([mixed(h), pairs, skips]) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int32))


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(SLOTS, np.float64)
        out[self.slots] = self.weights
        return out


@dataclass
class Sample:
    """Rows of slots end to end, where each begins, and their labels, in the order of learning."""

    slots: np.ndarray
    ends: np.ndarray
    labels: np.ndarray
    order: np.ndarray

    def common(self, least_rows: int, step: int = 512) -> Sample:
        """Only slots that `least_rows` rows have; `step` rows at a time."""
        blocks = [self.ends[at : at + step + 1] for at in range(0, len(self.labels), step)]
        seen = np.zeros(SLOTS, np.int64)
        for own in blocks:
            seen += np.bincount(self.slots[own[0] : own[-1]], minlength=SLOTS)
        frequent, parts, ends = seen >= least_rows, [], [np.zeros(1, np.int64)]
        for own in blocks:
            kept = frequent[self.slots[own[0] : own[-1]]]
            parts.append(self.slots[own[0] : own[-1]][kept])
            ends.append(ends[-1][-1] + np.concatenate([[0], np.cumsum(kept)])[own[1:] - own[0]])
        return Sample(np.concatenate(parts), np.concatenate(ends), self.labels, self.order)


def ftrl(sample: Sample, *, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, least_rows: int = LEAST_ROWS, toxic_weight: float = TOXIC_WEIGHT) -> Model:
    """FTRL-proximal with a bias that L1 leaves alone. With one kind of label only, the bias is its share."""
    share = float(sample.labels.mean()) if len(sample.labels) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(0, np.int32), np.zeros(0), np.inf if share else -np.inf)
    sample = sample.common(least_rows)
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    rate = np.full(SLOTS + 1, l1)
    rate[SLOTS] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= rate[at], 0.0, (np.sign(own) * rate[at] - own) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for row in sample.order:
            label = sample.labels[row]
            at = np.append(sample.slots[sample.ends[row] : sample.ends[row + 1]], SLOTS)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (toxic_weight if label else 1.0)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    every = weights(np.arange(SLOTS + 1))
    kept = np.flatnonzero(every[:SLOTS]).astype(np.int32)
    return Model(kept, every[kept], float(every[SLOTS]))


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from labelled rows that are not held out; the sample's rows are put in the order of a hash of doc_id."""
    marks = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_toxic")).filter(~held_out(F.col("doc_id")))
    share = min(1.0, train_rows / max(1, marks.count()))
    order = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(4)), F.lit(1 << 30))
    chosen = marks.filter(order < int(share * (1 << 30)))
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select(order.alias("_order"), "_toxic", F.xxhash64("doc_id", F.lit(5)).alias("_key"), "text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one text a doc_id, the one of least hash, so that the bound on doc_ids is one on rows but for doc_ids that several tasks have
        cache, kept = WordHashes(), {}
        for batch in batches:
            for order, toxic, key, text in zip(*[batch.column(k).to_pylist() for k in range(3)], texts_of(batch.column(3)), strict=True):
                mark = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                if key not in kept or mark < kept[key][3]:
                    slots = features(text, cache).tobytes()
                    kept[key] = (order, toxic, key, mark, xxhash.xxh3_64_intdigest(slots) - (1 << 63), slots)
        columns = list(zip(*kept.values(), strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["_order", "_toxic", "_key", "mark", "tie", "slots"])
        del cache, kept, columns
        give_back()

    found = sample.mapInArrow(featured, "_order long, _toxic int, _key long, mark long, tie long, slots binary").toArrow()
    learnt = sample_of(found)
    del found
    return ftrl(learnt)


def sample_of(found: pa.Table) -> Sample:
    """The sample as a few large arrays, which go back to the system as a whole once the driver is done with them."""
    by_key = np.lexsort((found.column("mark").to_numpy(), found.column("_key").to_numpy()))
    keys = found.column("_key").to_numpy()[by_key]
    again = np.concatenate([[False], keys[1:] == keys[:-1]])[: len(keys)]
    if again.any():  # several tasks had texts of one doc_id
        kept = np.ones(len(keys), bool)
        kept[by_key[again]] = False
        found = found.filter(pa.array(kept))
    labels = (found.column("_toxic").to_numpy() != 0).astype(np.int8)
    order = np.lexsort((labels, found.column("tie").to_numpy(), found.column("_order").to_numpy()))
    sizes, parts = [], []
    for chunk in found.column("slots").chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32 if pa.types.is_binary(chunk.type) else np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        sizes.append(np.diff(ends) // 4)
        parts.append(np.frombuffer(chunk.buffers()[2] or b"", np.int32)[ends[0] // 4 : ends[-1] // 4])
    slots = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return Sample(slots, np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64), labels, order)


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """_row (the columns of `docs`, text as a string) and the score of each row's whole text."""
    text_at = docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, dense = WordHashes(), model.dense()
        for batch in batches:
            sums = np.array([dense[features(x, cache)].sum() for x in texts_of(batch.column(0).field(text_at))], np.float64) + model.bias
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-sums)), pa.float64())], ["_row", "score"])
        del cache, dense
        give_back()

    rows = docs.select(row_of(docs, {"text": F.col("text").cast("string")}))
    return rows.mapInArrow(scored, StructType([rows.schema["_row"], StructField("score", DoubleType())]))


def without_toxic(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, toxic_at: float = TOXIC_AT) -> DataFrame:
    """The rows of `docs` that score under `toxic_at`, with the columns of `docs`."""
    scored = with_score(docs, fit(docs, labels, train_rows=train_rows)).filter(F.col("score") < toxic_at)
    return scored.select(*columns_of(docs))


def classify(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, toxic_at: float = TOXIC_AT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels, train_rows=train_rows))
    doc_id = F.col("_row.doc_id")
    return scored.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= toxic_at).cast("int").alias("predicted"))
