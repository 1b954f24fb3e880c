"""Streams of arriving texts: tokens buffered per key, full chunks emitted."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from foliant.operators.sizing import shared_dir

_OUT = "{key} bigint, kind string, chunk_id bigint, turn bigint, input_ids array<int>"
MAX_TRIGGER_BYTES = 4 * 1024**3
_SLICE_ROWS = 10_000
# Keyed map state needs this provider.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _bounded(reader, max_bytes: int, max_files: int | None):
    """Bound a micro-batch by bytes, or by files when a number is given."""
    if max_files is not None:
        return reader.option("maxFilesPerTrigger", max_files)
    return reader.option("maxBytesPerTrigger", max_bytes)


def read_json_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    max_bytes: int = MAX_TRIGGER_BYTES,
    max_files: int | None = None,
) -> DataFrame:
    """JSON lines that keep arriving in a folder, a bounded amount at a time."""
    return _bounded(spark.readStream.schema(schema), max_bytes, max_files).json(path)


def read_parquet_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    max_bytes: int = MAX_TRIGGER_BYTES,
    max_files: int | None = None,
) -> DataFrame:
    return _bounded(spark.readStream.schema(schema), max_bytes, max_files).parquet(path)


class ChunkEmitter(StatefulProcessor):
    """Tail, counters and held turns of one key; see ``emit_chunks``.

    One value holds the counters and the tail, which is shorter than a chunk; a held
    turn is one entry of a map, so putting a turn aside writes that turn only. The
    number of held turns stands beside the counters: in-order arrivals never ask the map.
    """

    def __init__(self, key: str, size: int, first_turn: int, final_end: bool, report_end: bool, patience_ms: int | None):
        self.size, self.first_turn, self.final_end = size, first_turn, final_end
        self.report_end = report_end
        self.patience_ms = patience_ms
        self.names = [key, "kind", "chunk_id", "turn", "input_ids"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "chunks bigint, wanted bigint, n_held bigint, tail array<int>")
        self.held = handle.getMapState("held", "turn bigint", "ids array<int>, closes boolean")

    def close(self) -> None:
        pass

    def _load(self) -> None:
        known = self.at.get()
        self.chunks, self.wanted, self.n_held, tail = known if known else (0, self.first_turn, 0, [])
        self.rest = np.asarray(tail, dtype=np.int32)
        self.closed, self.out = False, []

    def _store(self) -> None:
        if not self.closed:
            self.at.update((self.chunks, self.wanted, self.n_held, self.rest.tolist()))
            return
        if self.n_held:
            for (turn,), (ids, _) in sorted(self.held.iterator()):
                self.out.append(("late", None, turn, np.asarray(ids, dtype=np.int32)))
            self.held.clear()
        self.at.clear()

    def _is_held(self, turn: int) -> bool:
        return self.n_held > 0 and self.held.containsKey((turn,))

    def _take(self, ids: np.ndarray, closes: bool) -> None:
        """The next turn in order."""
        size = self.size
        self.rest = np.concatenate([self.rest, ids])
        full = len(self.rest) // size
        for c in range(full):
            part = self.rest[c * size : (c + 1) * size]
            self.out.append(("chunk", self.chunks + c, self.wanted, part))
        self.chunks += full
        self.rest = self.rest[full * size :]
        if closes and self.report_end:
            self.out.append(("end", self.chunks, self.wanted, self.rest))
        self.wanted += 1
        self.closed = closes

    def _drain(self) -> None:
        """Held turns whose predecessor is there now."""
        while not self.closed and self._is_held(self.wanted):
            turn = (self.wanted,)
            ids, closes = self.held.getValue(turn)
            self.held.removeKey(turn)
            self.n_held -= 1
            self._take(np.asarray(ids, dtype=np.int32), bool(closes))

    def _skip(self, turns: list[int]) -> None:
        """Give up what is missing before ``turns``, a row per gap."""
        for turn in turns:
            if self.closed or turn < self.wanted:
                continue
            if turn > self.wanted:
                self.out.append(("gap", turn - self.wanted, self.wanted, None))
                self.wanted = turn
            self._drain()

    def _waiting(self) -> list[int]:
        return sorted(turn for (turn,) in self.held.keys()) if self.n_held else []

    def _frame(self, key: tuple) -> pd.DataFrame:
        made = pd.DataFrame([(key[0], *row) for row in self.out], columns=self.names)
        made["chunk_id"] = made["chunk_id"].astype("Int64")
        self.out = []
        return made

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        ended, due = False, None
        for batch in rows:
            for r in batch.itertuples(index=False):
                turn, ids = int(r.turn), np.asarray(r.input_ids, dtype=np.int32)
                if self.closed or turn < self.wanted or self._is_held(turn):
                    self.out.append(("late", None, turn, ids))
                elif turn == self.wanted:
                    self._take(ids, bool(r.closes))
                    self._drain()
                else:
                    self.held.updateValue((turn,), (ids.tolist(), bool(r.closes)))
                    self.n_held += 1
                    ended |= bool(r.closes)
                    if self.patience_ms is not None:
                        until = int(pd.Timestamp(r.time).value // 1_000_000) + self.patience_ms
                        due = until if due is None else min(due, until)
                if len(self.out) >= _SLICE_ROWS:
                    yield self._frame(key)
        if ended and self.final_end and not self.closed:
            self._skip(self._waiting())
        if due is not None and not self.closed and self.n_held:
            # Never before the watermark: such a timer would not fire.
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        self._store()
        if self.out:
            yield self._frame(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        self._skip(self._waiting())
        self._store()
        if self.out:
            yield self._frame(key)


def emit_chunks(
    arrivals: DataFrame,
    chunk_size: int,
    key: str = "conv_id",
    turn: str = "turn",
    ids: str = "input_ids",
    end: str | None = None,
    first_turn: int = 0,
    final_end: bool = False,
    report_end: bool = False,
    time: str | None = None,
    patience_seconds: int | None = None,
) -> DataFrame:
    """Full chunks of each key's tokens as they fill up, in turn order.

    Turns of a key count up from ``first_turn``. A turn that came before its
    predecessor is held, so the chunks are the same however arrivals are dealt
    to micro-batches. A turn that was there already, or was given up, comes out as
    a ``late`` row. A true ``end`` column marks a key's last turn: once it is
    reached the state is removed and the tail dropped; in a later micro-batch the key
    starts anew. ``report_end`` adds an ``end`` row with the number of chunks and the
    dropped tail.

    Turns that never come end in one of two ways, with a ``gap`` row each
    (``turn``: the first one missing, ``chunk_id``: how many), after which held turns
    go on as the batch form has them:

    * ``final_end``: once the end of a key has come, no earlier turn of it will; what
      its micro-batch has not brought is given up.
    * ``time`` and ``patience_seconds``: a turn is held until the watermark on the
      column ``time`` passes its time and the patience. ``arrivals`` carry the watermark;
      what is older than it when it arrives is dropped by the stream itself.

    Without either a key with a gap waits. Arrivals are taken as they come, one batch
    at a time; results leave in slices.
    """
    if (time is None) != (patience_seconds is None):
        raise ValueError("time and patience_seconds go together")
    columns = [
        F.col(key).cast("bigint").alias(key),
        F.col(turn).cast("bigint").alias("turn"),
        F.col(ids).alias("input_ids"),
        (F.coalesce(F.col(end), F.lit(False)) if end else F.lit(False)).alias("closes"),
    ]
    rows = arrivals.select(*columns, *([F.col(time).alias("time")] if time else []))
    patience = None if patience_seconds is None else 1000 * patience_seconds
    return rows.groupBy(key).transformWithStateInPandas(
        ChunkEmitter(key, chunk_size, first_turn, final_end, report_end, patience),
        _OUT.format(key=key),
        "append",
        "eventTime" if time else "none",
    )


def run_to_table(stream: DataFrame, name: str = "stream") -> DataFrame:
    """Run a stream over all that is there now and read back what it wrote.

    Output and progress go to a fresh folder below the shared one, so a lost
    executor or a restarted query resumes from the last finished micro-batch.
    Keyed map state needs the RocksDB provider, which is set for this query.
    """
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return _run(stream, name)
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _run(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = stream.schema
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{base}/progress")
        .option("path", f"{base}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/rows")
