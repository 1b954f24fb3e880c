"""The chunk stream against its batch form."""

import json

import pytest

from foliant.functions import tokens as tk
from foliant.operators import context
from foliant.streaming import chunk_stream as cs
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("closes", T.BooleanType()),
    ]
)


def put(folder, name, rows):
    (folder / name).write_text(
        "".join(
            json.dumps({"conv_id": c, "turn": t, "text": x, "closes": e}) + "\n" for c, t, x, e in rows
        )
    )


def text(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def run(spark, folder, end=None):
    """One file per micro-batch, in name order."""
    turns = cs.read_json_stream(spark, str(folder), SCHEMA, max_files=1)
    ids = turns.select("conv_id", "turn", "closes", tk.tokenize(F.col("text"), add_bos=False).alias("input_ids"))
    return cs.run_to_table(cs.emit_chunks(ids, 4, end=end)).orderBy("conv_id", "chunk_id")


@pytest.fixture
def folder(tmp_path):
    return tmp_path


def batches(folder, *files):
    import os

    for i, rows in enumerate(files):
        put(folder, f"{i}.json", rows)
        os.utime(folder / f"{i}.json", (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))


def test_stream_equals_batch(spark, folder):
    files = [
        [(1, 1, text(3, 9), False), (1, 0, text(0, 3), False), (2, 0, text(0, 2), False)],
        [(1, 2, text(9, 10), False), (2, 1, text(2, 9), False)],
        [(1, 3, text(10, 17), False), (2, 2, "", False)],
    ]
    batches(folder, *files)
    got = run(spark, folder).collect()
    rows = [r for f in files for r in f]
    df = spark.createDataFrame(rows, SCHEMA).withColumn(
        "input_ids", tk.tokenize(F.col("text"), add_bos=False)
    )
    expected = context.emitted_chunks(df, 4).orderBy("conv_id", "chunk_id").collect()
    assert {r.kind for r in got} == {"chunk"}
    assert [(r.conv_id, r.chunk_id, r.input_ids) for r in got] == [
        (r.conv_id, r.chunk_id, r.input_ids) for r in expected
    ]
    assert len(got) == 4 + 2


def test_any_order_and_any_bound_give_the_same(spark, folder):
    files = [
        [(1, 2, text(9, 10), False), (2, 1, text(2, 9), False)],
        [(1, 3, text(10, 17), False)],
        [(1, 1, text(3, 9), False), (1, 0, text(0, 3), False), (2, 0, text(0, 2), False)],
    ]
    batches(folder, *files)
    seen = []
    for bound in ({"max_files": 1}, {"max_bytes": 1}, {}):
        turns = cs.read_json_stream(spark, str(folder), SCHEMA, **bound)
        ids = turns.select("conv_id", "turn", "closes", tk.tokenize(F.col("text"), add_bos=False).alias("input_ids"))
        rows = cs.run_to_table(cs.emit_chunks(ids, 4)).collect()
        seen.append(sorted((r.conv_id, r.kind, r.chunk_id, r.input_ids) for r in rows))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 4 + 2


def test_repeated_turns_come_out_beside(spark, folder):
    batches(folder, [(1, 0, text(0, 3), False)], [(1, 0, text(9, 11), False), (1, 1, text(3, 4), False)])
    got = run(spark, folder).collect()
    late = [r for r in got if r.kind == "late"]
    chunks = [r for r in got if r.kind == "chunk"]
    assert [(r.turn, len(r.input_ids)) for r in late] == [(0, 2)]
    assert len(chunks) == 1 and chunks[0].turn == 1


def test_end_removes_the_state(spark, folder):
    batches(folder, [(1, 0, text(0, 6), False), (1, 1, "x", True)], [(1, 0, text(0, 4), False)])
    got = run(spark, folder, "closes").collect()
    assert [(r.chunk_id, r.kind) for r in got] == [(0, "chunk"), (0, "chunk")]


def emit(spark, folder, watermark=None, **options):
    turns = cs.read_json_stream(spark, str(folder), SCHEMA, max_files=1)
    ids = turns.select("conv_id", "turn", "closes", tk.tokenize(F.col("text"), add_bos=False).alias("input_ids"))
    if watermark:
        # The turn of an arrival is its minute; turns 1 and 4 were sent much later.
        minute = 1000 + F.when(F.col("turn").isin(1, 4), 40).otherwise(F.col("turn"))
        ids = ids.withColumn("at", F.timestamp_seconds(60 * minute)).withWatermark("at", watermark)
    rows = cs.run_to_table(cs.emit_chunks(ids, 4, **options)).collect()
    found = [(r.conv_id, r.kind, r.chunk_id, r.turn, len(r.input_ids or [])) for r in rows]
    return sorted(found, key=lambda r: (r[0], r[1], r[2] or 0, r[3]))


def test_gaps_end_with_the_last_turn(spark, folder):
    """Turns 0, 2, 3 of 5 tokens: three chunks as in the batch form, one gap."""
    batches(
        folder,
        [(1, 0, text(0, 5), False), (1, 3, text(10, 15), True), (2, 1, text(0, 9), False)],
        [(1, 2, text(5, 10), False), (2, 0, text(0, 1), False)],
    )
    got = emit(spark, folder, end="closes", final_end=True, report_end=True)
    # The second batch comes after the end: turn 2 is the start of a new key's life and waits.
    assert got == [
        (1, "chunk", 0, 0, 4), (1, "chunk", 1, 3, 4), (1, "end", 2, 3, 2), (1, "gap", 2, 1, 0),
        (2, "chunk", 0, 1, 4), (2, "chunk", 1, 1, 4),
    ]


def test_gaps_end_with_the_watermark(spark, folder):
    """A held turn goes on when the watermark passes its time and the patience."""
    batches(
        folder,
        [(1, 0, text(0, 5), False), (1, 2, text(5, 10), False), (1, 3, text(10, 15), False)],
        [(2, 30, text(0, 1), False)],
        [(2, 31, text(0, 1), False)],
        [(1, 1, text(0, 3), False), (1, 4, text(15, 16), False)],
    )
    got = emit(spark, folder, "1 minute", time="at", patience_seconds=60)
    chunks = [r for r in got if r[:2] == (1, "chunk")]
    assert [r[2:] for r in sorted(chunks)] == [(0, 0, 4), (1, 2, 4), (2, 3, 4), (3, 4, 4)]
    assert (1, "gap", 1, 1, 0) in got and (1, "late", None, 1, 3) in got


def test_options_go_together(spark, folder):
    put(folder, "0.json", [(1, 0, "a", False)])
    with pytest.raises(ValueError, match="together"):
        emit(spark, folder, time="at")
