"""Best-fit packing: bounded-space online best-fit of token runs into fixed-length sequences.

Documents are tokenized once, cut into pieces only where they exceed a sequence, and the small piece table is packed. A
packer keeps a fixed number of open bins; a bitset holds which amounts of free space occur among them, so that the
tightest bin is found with one shift. When a new bin is needed and none may be added, the fullest open bin closes.

Pieces are dealt to groups by hash; every group packs on its own, so a group is the unit of recovery, and at most
`open_bins` sequences a group stay unfilled at its end.

Defined cases: a null or empty text is a document of the end id alone; a repeated row is packed as often as it occurs; a
null doc_id is carried as null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.text import give_back, texts_of
from tidemill.session import cut

SEQUENCE_TOKENS = 4096
END_ID = 1
#: Words, and parts of words, whose ids a task remembers: some 100 bytes each.
CACHE_WORDS = 400_000
OPEN_BINS = 1024
#: Pieces a packing group has on average. The last open bins of each group are what packing loses.
GROUP_PIECES = 50_000

#: How the tokenizer file splits a lower-cased word.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else the next unused one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Little-endian 32-bit ids of words, remembered. Words split at white space are tokenized independently."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model, self.characters = self.tokenizer.model, byte_characters()
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        text = word.decode("utf-8", "replace")
        # Latin words without special-token brackets are split here, so that their letter runs are shared
        if "<|" not in text and max(text) < "ɐ":
            text = unicodedata.normalize("NFC", text).lower()
            value = b"".join([self._part(x) for x in PIECES.findall(text)])
        else:
            value = self._encoded(text)
        self[word] = value
        return value

    def _part(self, part: str) -> bytes:
        value = self.parts.get(part)
        if value is None:
            if len(self.parts) >= CACHE_WORDS:
                self.parts.clear()
            # a part is one run of the file's own splitting: straight to the merges
            tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.characters))
            value = self.parts[part] = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        return value

    def _encoded(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def token_pieces(docs: DataFrame, tokenizer_json: str, *, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end = end_id.to_bytes(4, "little")
    step = capacity * 4

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_json)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids = words.ids(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part)[: 5 + with_ids])
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            types = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)
        del words
        give_back()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(pieces, schema)


class Packer:
    """Open bins keyed by free space, at most `open_bins` of them."""

    def __init__(self, capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.count, self.next = 0, 0, 0
        self.bins: dict[int, list[int]] = {}

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset that a piece of `length` gets."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.count >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, sequence = self.capacity, self.next
            self.next += 1
        if free > length:
            self.bins.setdefault(free - length, []).append(sequence)
            self.bits |= 1 << (free - length)
            self.count += 1
        return sequence, self.capacity - free

    def _take(self, free: int) -> int:
        same = self.bins[free]
        sequence = same.pop()
        self.count -= 1
        if not same:
            del self.bins[free]
            self.bits ^= 1 << free
        return sequence


def pack_pieces(pieces: DataFrame, *, capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces that has been written (its rows are counted first)."""
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("long")).repartition(groups, "_group").sortWithinPartitions("_group", F.xxhash64("piece", "doc_id"), "doc_id", "piece", "start")
    length_at, group_at = dealt.columns.index("length"), dealt.columns.index("_group")
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, current = None, None
        for batch in batches:
            sequences, offsets = [], []
            for length, group in zip(batch.column(length_at).to_pylist(), batch.column(group_at).to_pylist(), strict=True):
                if group != current:
                    packer, current = Packer(capacity, open_bins), group
                sequence, offset = packer.place(length)
                sequences.append((group << 40) + sequence)
                offsets.append(offset)
            columns = [batch.column(i) for i in range(batch.num_columns) if i != group_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], schema.names)

    return dealt.mapInArrow(packed, schema)


def pack_documents(docs: DataFrame, tokenizer_json: str, *, capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """Packs whole documents (doc_id, text) into sequences of at most `capacity` tokens. See the module for the method."""
    pieces = cut(token_pieces(docs, tokenizer_json, capacity=capacity, with_ids=with_ids), "pieces")
    return pack_pieces(pieces, capacity=capacity, open_bins=open_bins, group_pieces=group_pieces)
