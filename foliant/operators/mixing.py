"""Distractor joins, task joins, weighted mixtures and chunk reservoirs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant import config as C
from foliant.functions import hashing
from foliant.operators.once import with_once
from foliant.operators.ordered import ID_SHIFTS, id_positions, shuffled_positions

_MIN_KEYS = 4096


# --- distractor joins ------------------------------------------------------


def _join_at_position(
    rows: DataFrame, texts: DataFrame, text_id: str, text: str, row_id: str, slot, out: str
) -> DataFrame:
    """Give each row the text at position ``slot(count)`` of the text corpus.

    The count is a scalar subquery. With fewer texts than ``_MIN_KEYS`` each
    text would gather a large share of the rows, so texts are repeated under a
    salt until there are about that many join keys.
    """
    size = texts.agg(F.count(F.lit(1)).alias("n")).scalar()
    copies = F.greatest(F.lit(1), F.lit(_MIN_KEYS) / F.greatest(size, F.lit(1))).cast("int")
    right = id_positions(texts, text_id, out="_slot").select(
        "_slot",
        F.col(text).alias(out),
        F.explode(F.sequence(F.lit(0), copies - 1)).alias("_salt"),
    )
    left = rows.withColumns(
        {
            "_slot": slot(size),
            "_salt": F.pmod(F.xxhash64(F.col(row_id)), copies.cast("bigint")).cast("int"),
        }
    )
    return left.join(right, ["_slot", "_salt"]).drop("_slot", "_salt")


def distractor_by_position(
    rows: DataFrame,
    distractors: DataFrame,
    row_id: str = "row_id",
    distractor_id: str = "row_id",
    text: str = "text",
    cap: int | None = C.CHAR_CAPS["128k"],
    out: str = "disturb",
) -> DataFrame:
    """Row i takes distractor ``i mod count``, counted in corpus order."""
    texts = distractors.select(distractor_id, F.substring(text, 1, cap).alias(text) if cap else text)
    return _join_at_position(
        rows, texts, distractor_id, text, row_id, lambda n: F.pmod(F.col(row_id), n), out
    )


def distractor_at_random(
    rows: DataFrame,
    distractors: DataFrame,
    row_id: str = "row_id",
    distractor_id: str = "row_id",
    text: str = "text",
    min_chars: int = C.CHAR_CAPS["128k"],
    cap: int | None = C.CHAR_CAPS["128k"],
    seed: int = 42,
    out: str = "disturb",
) -> DataFrame:
    """Each row takes a random distractor among those long enough.

    Drawing from the qualifying rows gives the same distribution as drawing
    from all rows until one qualifies.
    """
    fit = distractors.filter(F.length(text) >= min_chars)
    texts = fit.select(distractor_id, F.substring(text, 1, cap).alias(text) if cap else text)
    return _join_at_position(
        rows,
        texts,
        distractor_id,
        text,
        row_id,
        lambda n: F.pmod(hashing.draw(F.col(row_id), seed, "distractor"), n),
        out,
    )


# --- tasks -----------------------------------------------------------------

TASK_SCHEMA = T.StructType(
    [
        T.StructField("task_id", T.IntegerType(), False),
        T.StructField("task_type", T.StringType(), False),
        T.StructField("task_name", T.StringType(), False),
        T.StructField("num_instance", T.LongType(), True),
        T.StructField("truncation", T.IntegerType(), True),
    ]
)


def tasks_frame(spark: SparkSession, tasks: Sequence[C.Task]) -> DataFrame:
    rows = [
        (i, t.task_type, t.task_name, t.num_instance, t.truncation) for i, t in enumerate(tasks)
    ]
    return spark.createDataFrame(rows, TASK_SCHEMA)


def task_samples(
    corpus: DataFrame, tasks: DataFrame, row_no: str = "row_no", name: str = "task_name"
) -> DataFrame:
    """Every task over the first ``num_instance`` rows of its corpus.

    The task's tag replaces the row's.
    """
    first = F.col("num_instance").isNull() | (F.col(row_no) <= F.col("num_instance"))
    kept = corpus.drop("task_type") if "task_type" in corpus.columns else corpus
    return kept.join(tasks, name).filter(first)


def numbered_rows(df: DataFrame, row_id: str, out: str = "row_no") -> DataFrame:
    """1-based dense row number in corpus order."""
    return id_positions(df, row_id, out=out).withColumn(out, F.col(out) + 1)


def first_rows(df: DataFrame, n: int, row_id: str = "row_id", require: bool = False) -> DataFrame:
    """The first n rows in order; ``require`` makes a shorter corpus an error.

    The first ids are found alone, so whole rows meet in no task.
    """
    first = df.select(row_id).orderBy(row_id).limit(n)
    kept = df.join(first, row_id, "left_semi").orderBy(row_id)
    if require:
        found = df.limit(n).count()
        if found < n:
            raise ValueError(f"corpus has {found} rows, {n} are required")
    return kept


# --- weighted mixture ------------------------------------------------------


def check_weights(weights: Sequence[float]) -> None:
    if abs(sum(weights) - 1) >= 1e-3:
        raise ValueError(f"partitions sum to {sum(weights)}, not to 1")


def mixture_draws(
    spark: SparkSession, names: Sequence[str], weights: Sequence[float], iters: int, seed: int = 42
) -> DataFrame:
    """One row per step: which corpus it draws from and how often before."""
    check_weights(weights)
    unit = hashing.draw("step", F.col("step"), seed) / F.lit(float(2**32))
    # The last corpus takes whatever rounding leaves of the unit interval.
    edges, acc = [], 0.0
    for w in weights[:-1]:
        acc += w
        edges.append(acc)
    choice = F.lit(names[-1])
    for name, edge in reversed(list(zip(names, edges, strict=False))):
        choice = F.when(F.col("_u") < edge, F.lit(name)).otherwise(choice)
    steps = spark.range(iters).select(F.col("id").alias("step")).withColumn("_u", unit)
    drawn = steps.select("step", choice.alias("name"))
    return id_positions(drawn, "step", by=["name"], out="pos", shifts=ID_SHIFTS)


def mixture_parts(
    corpora: dict[str, DataFrame],
    mix: Sequence[C.MixEntry],
    iters: int,
    row_id: str = "row_id",
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Per corpus, the rows drawn from it with the step that draws each.

    A corpus is visited in shuffled order, without replacement; one that runs
    out is an error. Only the shuffled positions that can be drawn are ranked.
    """
    spark = next(iter(corpora.values())).sparkSession
    draws = mixture_draws(spark, [m.name for m in mix], [m.partition for m in mix], iters, seed)
    parts = {}
    for m in mix:
        df = corpora[m.name]
        cols = [c for c in df.columns if c != "name"]
        # The constant name keeps the order of each corpus its own.
        tagged = df.select(F.lit(m.name).alias("name"), *cols)
        rows = shuffled_positions(
            tagged, row_id, seed, ["name"], "pos", first=iters, known_keys=1
        ).drop("name")
        own = draws.filter(F.col("name") == m.name).drop("name")
        fed = own.join(rows.withColumn("_found", F.lit(True)), "pos", "left")
        step = F.when(F.col("_found"), F.col("step")).otherwise(
            F.raise_error(F.lit(f"corpus exhausted: {m.name}")).cast("bigint")
        )
        parts[m.name] = fed.select(
            step.alias("step"),
            F.lit(m.name).alias("name"),
            "pos",
            *cols,
            F.lit(m.truncation).cast("int").alias("truncation"),
        )
    return parts


def mixture_feed(
    corpora: dict[str, DataFrame],
    mix: Sequence[C.MixEntry],
    iters: int,
    row_id: str = "row_id",
    seed: int = 42,
) -> DataFrame:
    """The draw at every step of a weighted mixture."""
    parts = mixture_parts(corpora, mix, iters, row_id, seed)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts.values())


# --- chunk reservoir -------------------------------------------------------

#: What a reservoir decides about one chunk.
FATE = ("slot", "outcome", "released_at", "visit")


def with_fates(
    df: DataFrame, n_chunks: Column, k: int = 2, doc: str = "sample_id", seed: int = 42, out: str = "fates"
) -> DataFrame:
    """Add the fate of every chunk of a document, by chunk number, from their count alone.

    Chunk c below k goes to slot c. A later one draws j in [0, c]: below k it
    replaces the holder of slot j, otherwise it is released at once. So the
    survivor of a slot is the last chunk that came to it, and a chunk is
    released when the next one comes to its slot. At the end the document's
    last chunk is taken out; the other survivors are visited from the highest
    slot down.

    ``outcome`` is kept, evicted or last; ``released_at`` is the chunk at
    whose arrival an evicted one went; ``visit`` counts the survivors. All of it
    is arrays of the document's row, sorted by slot: no shuffle and no window.
    """
    kept_names = [c for c in df.columns if c != out]
    j = lambda c: hashing.draw_below(c.cast("bigint") + 1, F.col(doc), c, seed, "slot")
    numbers = F.when(n_chunks > 0, F.sequence(F.lit(0), (n_chunks - 1).cast("int")))
    numbers = F.coalesce(numbers, F.array().cast("array<int>"))
    drawn = F.transform(
        numbers,
        lambda c: F.struct(F.when(c < k, c.cast("bigint")).otherwise(j(c)).alias("slot"), c.alias("c")),
    )
    df = with_once(df, {"_drawn": drawn})
    entered = F.array_sort(F.filter("_drawn", lambda d: d["slot"] < k))
    df = with_once(df, {"_entered": entered, "_last": F.size("_drawn") - 1})

    def lane(d: Column, i: Column) -> Column:
        after = F.get("_entered", i + 1)
        follower = F.when(after["slot"] == d["slot"], after["c"])
        return F.struct(d["c"].alias("c"), d["slot"].alias("slot"), follower.alias("next"))

    nothing = F.lit(None).cast("int")
    passed = F.transform(
        F.filter("_drawn", lambda d: d["slot"] >= k),
        lambda d: F.struct(d["c"].alias("c"), nothing.cast("bigint").alias("slot"), nothing.alias("next")),
    )
    df = with_once(df, {"_lanes": F.array_sort(F.concat(F.transform("_entered", lane), passed))})
    stays = lambda r: r["slot"].isNotNull() & r["next"].isNull() & (r["c"] != F.col("_last"))
    df = with_once(df, {"_kept": F.transform(F.filter("_lanes", stays), lambda r: r["slot"])})

    def fate(r: Column) -> Column:
        outcome = F.when(r["c"] == F.col("_last"), "last").when(stays(r), "kept").otherwise("evicted")
        released = F.when(r["slot"].isNull(), r["c"]).otherwise(r["next"])
        visit = F.size(F.filter("_kept", lambda s: s >= r["slot"]))
        return F.struct(
            r["slot"].alias("slot"),
            outcome.alias("outcome"),
            released.cast("bigint").alias("released_at"),
            F.when(stays(r), visit).alias("visit"),
        )

    return df.select(*kept_names, F.transform("_lanes", fate).alias(out))


def chunk_reservoir(
    docs: DataFrame,
    n_chunks: Column,
    k: int = 2,
    doc: str = "sample_id",
    chunk: str = "seq",
    seed: int = 42,
) -> DataFrame:
    """Which chunks of each document a k-slot reservoir keeps, and when it lets go.

    One row in per document, one row out per chunk; see ``with_fates``.
    """
    decided = with_fates(docs.select(doc, n_chunks.alias("_n")), F.col("_n"), k, doc, seed)
    out = decided.select(doc, F.posexplode("fates").alias(chunk, "_f"))
    return out.select(doc, chunk, *[F.col("_f")[name].alias(name) for name in FATE])
