"""Language identification with error-correcting output codes.

Every learned language gets a codeword of +1 / -1 bits. One binary logistic classifier for each bit sees hashed byte n-grams
(1 to 4) of the whole lower-cased text. Decoding is loss-weighted: a language's distance is the sum of the logistic losses of
its codeword's bits under the predicted margins, each bit weighted by the accuracy it had on training rows; the nearest
codeword wins. The score is the winner's share of exp(-distance); `ambiguous` marks rows whose two nearest codewords are closer
than `AMBIGUOUS_GAP`.

Up to `EXHAUSTIVE` languages use the exhaustive code of 2^(k-1) - 1 bits, more use seeded random columns. Learning uses a
sample of about `TRAIN_ROWS` rows, chosen by hash, in which a language of less than its share for that has about `LEAST_ROWS` rows, or
all if it has no more; so every language of the rows that may be learned from is learned, at any size of table. Statistics and
predictions cover every row.

Defined cases: a text that is null or has no letter is `und` with score 0; with no rows to learn from every text is `und`, with one
language every lettered text is that one with score 1; rows with null lang teach nothing; a null doc_id is never held out; ties
between codewords go to the language first by code point; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.text import texts_of
from tidemill.llm.toxicity import held_out

SLOTS = 4096
TRAIN_ROWS = 6000
#: Rows that a language rare in the table has in the sample.
LEAST_ROWS = 50
EXHAUSTIVE = 6
RANDOM_BITS_PER_LANGUAGE = 4
AMBIGUOUS_GAP = 0.5
STEPS = 150
UNDETERMINED = "und"

LETTER = regex.compile(r"\p{L}")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of a text that are turned into slots at once.
BLOCK = 1 << 18


def profile(text: bytes) -> np.ndarray:
    """Square roots of the n-gram shares of a text, at length 1: float32 over SLOTS."""
    raw = np.frombuffer(b" " + b" ".join(text.translate(LOWER).split()) + b" ", np.uint8)
    counts = np.zeros(SLOTS)
    shift = np.uint32(32 - SLOTS.bit_length() + 1)
    for at in range(0, len(raw), BLOCK):
        b = raw[at : at + BLOCK + 3].astype(np.uint32)
        gram = np.zeros(len(b), np.uint32)
        for n in range(1, min(4, len(b)) + 1):
            gram = (gram[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
            starts = gram[:BLOCK]  # a block owns the n-grams that start in it
            counts += np.bincount(((starts + np.uint32(n * 0x01000193)) * np.uint32(0x9E3779B1)) >> shift, minlength=SLOTS)
    out = np.sqrt(counts)
    return (out / max(1e-9, np.linalg.norm(out))).astype(np.float32)


def code(languages: int) -> np.ndarray:
    """languages x bits of +1 and -1; columns differ from each other and from their complements."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= EXHAUSTIVE:
        columns = [[1, *[1 if c >> i & 1 else -1 for i in range(languages - 1)]] for c in range(2 ** (languages - 1) - 1)]
    else:
        rng, found = np.random.default_rng(3), {}
        while len(found) < RANDOM_BITS_PER_LANGUAGE * languages:
            column = rng.choice([-1, 1], languages) * 1
            if abs(column.sum()) < languages:
                found[tuple(column * column[0])] = None
        columns = list(found)
    return np.array(columns, float).T


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weights: np.ndarray

    def decode(self, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its score and whether the decision is ambiguous."""
        margins = profiles @ self.weights + self.bias
        distance = np.stack([(self.bit_weights * np.logaddexp(0, -margins * word)).sum(axis=1) for word in self.code], axis=1)
        best = distance.argmin(axis=1)
        share = np.exp(distance.min(axis=1, keepdims=True) - distance)
        two = np.sort(distance, axis=1)[:, :2]
        close = two[:, 1] - two[:, 0] < AMBIGUOUS_GAP if distance.shape[1] > 1 else np.zeros(len(best), bool)
        return best, 1 / share.sum(axis=1), close


def learn(profiles: np.ndarray, marks: list[str], *, steps: int = STEPS) -> Model:
    """One logistic classifier a bit, all fitted together by gradient steps with momentum."""
    languages = sorted(set(marks))
    words = code(len(languages))
    bits = words.shape[1]
    weights, bias = np.zeros((SLOTS, bits), np.float32), np.zeros(bits, np.float32)
    if len(languages) > 1:
        y = words[np.searchsorted(languages, marks)].astype(np.float32)
        velocity, drift = np.zeros_like(weights), np.zeros_like(bias)
        for _ in range(steps):
            g = -y / (1 + np.exp(np.clip(y * (profiles @ weights + bias), -30, 30))) / len(y)
            velocity, drift = 0.9 * velocity - 8.0 * (profiles.T @ g + 1e-5 * weights), 0.9 * drift - 0.5 * g.sum(axis=0)
            weights, bias = weights + velocity, bias + drift
        hit = (np.sign(profiles @ weights + bias) == y).mean(axis=0)
    else:
        hit = np.ones(bits)
    return Model(languages, words, weights, bias, np.maximum(hit, 0.5) / max(1e-9, np.maximum(hit, 0.5).mean()))


def fit(docs: DataFrame, *, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from lang and text of rows that are not held out."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    share = min(1.0, train_rows / max(1, sum(sizes.values())))
    limits = own.sparkSession.createDataFrame([(x, int(min(1.0, max(share, LEAST_ROWS / n)) * (1 << 30))) for x, n in sizes.items()], "lang string, _limit long")
    # rows without doc_id, or with the same, have places of their own by their text
    place = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(3))

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [profile(x).tobytes() for x in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["_order", "lang", "profile"])

    sample = own.join(F.broadcast(limits), "lang").withColumn("_order", place).filter(F.pmod("_order", F.lit(1 << 30)) < F.col("_limit")).select("_order", "lang", "text").dropDuplicates(["_order", "lang"])
    found = sample.mapInArrow(profiled, "_order long, lang string, profile binary").toArrow().sort_by([("_order", "ascending"), ("lang", "ascending")])
    rows = found.column("profile").to_pylist()
    profiles = np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), SLOTS)
    return learn(profiles, found.column("lang").to_pylist())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, scores, close = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            texts = texts_of(batch.column(1))
            lettered = [i for i, x in enumerate(texts) if model.languages and LETTER.search(x.decode("utf-8", "replace"))]
            for at in range(0, len(lettered), 256):
                rows = lettered[at : at + 256]
                best, score, doubt = model.decode(np.stack([profile(texts[i]) for i in rows]))
                for i, b, s, d in zip(rows, best, score, doubt, strict=True):
                    marks[i], scores[i], close[i] = model.languages[b], s, d
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string()), pa.array(scores), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(predicted, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, *, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row."""
    found = predict(docs, fit(docs, train_rows=train_rows))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
