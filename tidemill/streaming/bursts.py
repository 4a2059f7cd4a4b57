"""Similar photos as they arrive: bursts stay open in state and close when the watermark passes.

Photos of a key (a camera, a folder) that follow each other by no more than a window chain into a burst. The state holds a key's
rows of bursts that may still grow, in pieces of columns; one timer stands where the first of them may end. When the watermark has passed a burst's
end, no row can join any more: the burst's groups are worked out, go out, and its rows leave the state. Rows that arrive late, but not behind
the watermark, take their place in time. So the state is bounded by what the lateness and the window let arrive, and the groups are those of
the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.functions.forest import joined

ROW = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("phash", pa.int64()), ("edited_of", pa.int64()), ("sharpness", pa.float64()), ("pixels", pa.int64()), ("path", pa.string())])
GROUPS = "key string, id long, component long, keeper_id long, keeper_path string, is_keeper boolean, delta long"
SECOND = 1000
#: Rows in a piece of the state, and in a piece of the output.
PIECE = 50_000
#: Pairs of cells that are compared at once.
PAIRS = 1 << 19


def burst_roots(at: np.ndarray, ids: np.ndarray, hashes: np.ndarray, edited: np.ndarray, window: int, distance: int) -> np.ndarray:
    """The first place of each row's group, of rows in the order of time. A row with its own id in `edited` is edited of none.

    Rows with one hash within one window of time are a cell: they are linked whatever else there is, so cells are compared instead of rows, with those of
    their window and of the next. Cells of one window that look alike are linked; of two windows, if the last row of one and the first of the
    other are near in time. Edited pairs and rows with one id are left out as links: such rows are cells by themselves.
    """
    n, place = len(at), np.arange(len(at))
    asks, (known, times) = edited != ids, np.unique(ids, return_counts=True)
    alone = np.isin(ids, known[times > 1]) | (asks & np.isin(edited, ids)) | np.isin(ids, edited[asks])
    stretch, tag = at // max(1, window), np.where(alone, place, -1)
    order = np.lexsort((place, tag, hashes, stretch))
    new = np.concatenate([[True], (np.diff(stretch[order]) != 0) | (np.diff(hashes[order]) != 0) | (np.diff(tag[order]) != 0)])
    begin = np.flatnonzero(new)
    first, last = order[begin], order[np.append(begin[1:], n) - 1]
    cell = np.empty(n, np.int64)
    cell[order] = np.cumsum(new) - 1
    looks, when, single = hashes[first].view(np.uint64), stretch[first], alone[first]
    reach = np.searchsorted(when, when + 1, "right") - np.arange(len(first)) - 1  # cells behind each one, up to the end of the next window
    ends, roots, start = np.cumsum(reach), np.arange(len(first)), 0
    while start < len(first):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - reach[start] + PAIRS, "right")))
        counts = reach[start:stop]
        a = np.repeat(np.arange(start, stop), counts)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
        near = (np.bitwise_count(looks[a] ^ looks[b]) <= distance) & (at[first[b]] - at[last[a]] <= window)
        a, b = a[near], b[near]
        one, two = first[a], first[b]
        apart = single[a] & single[b] & ((ids[one] == ids[two]) | (edited[one] == ids[two]) | (edited[two] == ids[one]))
        roots, start = joined(roots, a[~apart], b[~apart]), stop
    least = np.full(len(first), n)
    np.minimum.at(least, roots[cell], place)
    return least[roots[cell]]


def burst_groups(rows: pa.Table, window: int, distance: int) -> pd.DataFrame:
    """id, component, keeper_id, keeper_path, is_keeper, delta of the rows, in the order of time, that have a near neighbour."""
    at, ids, pixels = (rows[c].to_numpy() for c in ("at", "id", "pixels"))
    sharp = np.nan_to_num(rows["sharpness"].to_numpy(), nan=-1.0, posinf=np.inf, neginf=-np.inf)
    roots = burst_roots(at, ids, rows["phash"].to_numpy(), rows["edited_of"].to_numpy(), window, distance)
    members = np.flatnonzero(np.bincount(roots, minlength=len(roots))[roots] > 1)
    ranked = members[np.lexsort((ids[members], -pixels[members], -sharp[members], roots[members]))]
    keeper, least = np.zeros(len(roots), np.int64), np.full(len(roots), np.iinfo(np.int64).max)
    best = np.concatenate([[True], np.diff(roots[ranked]) != 0])[: len(ranked)]
    keeper[roots[ranked[best]]] = ranked[best]
    np.minimum.at(least, roots[members], ids[members])
    kept = keeper[roots[members]]
    paths = rows["path"].take(pa.array(kept)).to_pandas()
    return pd.DataFrame({"id": ids[members], "component": least[roots[members]], "keeper_id": ids[kept], "keeper_path": paths, "is_keeper": members == kept, "delta": np.abs(at[members] - at[kept])})


def packed(rows: pa.Table) -> bytes:
    """Rows as the state takes them."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ROW, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


class OpenBursts(StatefulProcessor):
    """A key's open bursts."""

    nothing = pd.DataFrame(columns=[part.split(" ")[0] for part in GROUPS.split(", ")])

    def __init__(self, window: int, distance: int):
        self.window, self.distance = window, distance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "timer long, pieces int")
        self.pieces = handle.getMapState("pieces", "n int", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        timer, pieces = self.open.get() or (None, 0)
        first = timer
        for batch in rows:
            # a burst ends a window behind its first row, or later
            end = (int(batch["at"].min()) + self.window) * SECOND
            first = end if first is None else min(first, end)
            self.pieces.updateValue((pieces,), (packed(pa.Table.from_pandas(batch[ROW.names], ROW, preserve_index=False)),))
            pieces += 1
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self.open.update((first, pieces))
        yield self.nothing

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        watermark, (_, pieces) = timerValues.getCurrentWatermarkInMs(), self.open.get()
        rows = pa.concat_tables([pa.ipc.open_stream(bytes(self.pieces.getValue((n,))[0])).read_all() for n in range(pieces)])
        rows = rows.take(pa.array(np.lexsort((rows["id"].to_numpy(), rows["at"].to_numpy()))))
        at = rows["at"].to_numpy()
        number = np.concatenate([[0], np.cumsum(np.diff(at) > self.window)])
        ends = (at[np.append(np.flatnonzero(np.diff(number)), len(at) - 1)] + self.window) * SECOND
        closed = ends < watermark
        if closed.all():
            self.open.clear()
            self.pieces.clear()
        else:
            if closed.any():
                self.pieces.clear()
                left = rows.filter(pa.array(~closed[number])).combine_chunks()
                pieces = -(-len(left) // PIECE)
                for n in range(pieces):
                    self.pieces.updateValue((n,), (packed(left.slice(n * PIECE, PIECE)),))
            timer = max(int(ends[~closed].min()) + 1, watermark + 1)
            self.handle.registerTimer(timer)
            self.open.update((timer, pieces))
        if not closed.any():
            yield self.nothing
            return
        found = burst_groups(rows.filter(pa.array(closed[number])), self.window, self.distance)
        found.insert(0, "key", key[0])
        for k in range(0, max(1, len(found)), PIECE):
            yield found[k : k + PIECE]

    def close(self) -> None:
        pass


def similar_stream(items: DataFrame, *, key: str = "key", window: int = 60, distance: int = 6, late: str = "10 minutes") -> DataFrame:
    """GROUPS of a stream of items (key, id, ts timestamp, phash, edited_of, sharpness, width, height, path), each group once it is closed.

    The watermark moves with the newest ts: what is open at the end closes as later rows come. Rows without ts or phash take no part.
    """
    pixels = F.coalesce(F.col("width"), F.lit(0)).cast("long") * F.coalesce(F.col("height"), F.lit(0)).cast("long")
    own = items.filter(F.col("phash").isNotNull() & F.col("ts").isNotNull()).select(F.col(key).cast("string").alias("key"), "ts", F.col("id").cast("long").alias("id"), F.unix_seconds("ts").alias("at"), "phash", F.coalesce(F.col("edited_of").cast("long"), F.col("id").cast("long")).alias("edited_of"), F.col("sharpness").cast("double").alias("sharpness"), pixels.alias("pixels"), "path")
    return own.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(OpenBursts(window, distance), outputStructType=GROUPS, outputMode="Append", timeMode="EventTime")


STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
