"""Token samples from raw rows, and whole-corpus operators on them.

Every builder is one select over one scan: a dropped row is a filter, never a
second pass, and the three input shapes are handled in the same projection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant import config as C
from foliant.functions import text as tx
from foliant.functions import tokens as tk
from foliant.operators.once import with_once
from foliant.operators.ordered import shuffled_positions
from foliant.operators.sizing import settle


# --- shapes of raw rows ----------------------------------------------------


def lm_rows(
    df: DataFrame, text: str = "text", tag: str = C.LANGUAGE_MODELING, keep: Sequence[str] = ()
) -> DataFrame:
    keep = [*[c for c in ("row_id",) if c in df.columns], *keep]
    return df.select(*keep, F.col(text).alias("text"), F.lit(tag).alias("task_type"))


def copy_rows(df: DataFrame) -> DataFrame:
    keep = [c for c in ("row_id",) if c in df.columns]
    return df.select(*keep, "prompt", "response", F.lit(C.AUTO_ENCODING).alias("task_type"))


def flag(text: str) -> bool:
    """The words true and false, nothing else."""
    if text not in ("true", "false"):
        raise ValueError(f"{text!r} is neither 'true' nor 'false'")
    return text == "true"


def qa_rows(
    df: DataFrame, prompt: str, response: str, train_prompt: bool = True, keep: Sequence[str] = ()
) -> DataFrame:
    if not isinstance(train_prompt, bool):
        raise ValueError("train_prompt must be True or False")
    keep = [*[c for c in ("row_id",) if c in df.columns], *keep]
    return df.select(
        *keep,
        F.col(prompt).alias("prompt"),
        F.col(response).alias("response"),
        F.lit(train_prompt).alias("train_prompt"),
        F.lit(C.QUESTION_ANSWERING).alias("task_type"),
    )


def news_rows(joined: DataFrame, method: str | None = None) -> DataFrame:
    """News rows from a story table that already carries ``disturb``."""
    if method not in (None, "lm", "distill"):
        raise ValueError(f"method {method!r} is neither 'lm' nor 'distill'")
    keep = [c for c in ("row_id",) if c in joined.columns]
    cols = [
        *keep,
        "disturb",
        F.col("story").alias("context"),
        "questions",
        "answers",
        F.col("summary").alias("summation"),
    ]
    if method is None:
        return joined.select(*cols, F.lit(C.NEWS_V2).alias("task_type"))
    return joined.select(*cols, F.lit(method).alias("method"), F.lit(C.NEWS_V1).alias("task_type"))


def split_violations(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with every required field, and the quarantined rest with a reason."""
    ok = reduce(lambda a, c: a & F.col(c).isNotNull(), required, F.lit(True))
    missing = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda m: m.isNotNull()
    )
    return df.filter(ok), df.filter(~ok).withColumn("missing", missing)


# --- token samples ---------------------------------------------------------


def sft_words(
    df: DataFrame,
    conf: C.Tokens,
    max_length: int,
    prompt: str = "input",
    output: str = "output",
    char_bound: int | None = None,
) -> DataFrame:
    """Add the truncated prompt words and the output words of an instruction row.

    A prompt above the room left by the output keeps its first and last half.
    The two halves are joined without a blank, so the words on either side of
    the cut become one word, as they do when decoded text is tokenized again.
    With room for no half the whole prompt stays. ``_fits`` is false for rows
    whose output is alone too long, ``_answered`` for those with an empty one.
    ``char_bound`` cuts prompts to that many characters per token beforehand.
    """
    bos = 1 if conf.add_bos else 0
    room = F.lit(max_length) - F.size("_out")
    half = F.greatest(F.floor(room / 2), F.lit(0)).cast("int")
    df = with_once(
        df,
        {
            "_in": tk.words(
                tx.strip(F.col(prompt))
                if char_bound is None
                else tx.middle_truncate_chars(tx.strip(F.col(prompt)), char_bound * max_length)
            ),
            "_out": tk.words(tx.strip(F.col(output))),
        },
    )
    df = df.withColumns({
            "_half": half,
            "_fits": F.size("_out") <= max_length,
            "_answered": F.size("_out") > 0,
        })
    # bos is the first token of the first half.
    head = tk.first_n(F.col("_in"), F.col("_half") - bos)
    tail = tk.last_n(F.col("_in"), F.col("_half"))
    df = df.withColumns({"_head": head, "_tail": tail})
    joint = F.array(F.concat(F.try_element_at("_head", F.lit(-1)), F.try_element_at("_tail", F.lit(1))))
    joined = F.when(F.size("_head") == 0, F.col("_tail")).otherwise(
        F.concat(tk.drop_last(F.col("_head")), joint, tk.drop_first(F.col("_tail")))
    )
    too_long = F.size("_in") + bos > F.lit(max_length) - F.size("_out")
    return df.withColumn(
        "_prompt",
        F.when(too_long & (F.col("_half") > 0), joined).otherwise(F.col("_in")),
    ).drop("_in", "_half", "_head", "_tail")


def lm_samples(
    df: DataFrame,
    conf: C.Tokens = C.Tokens(),
    min_length: int = C.SAMPLE_MIN_LENGTH,
    max_length: int = 8192,
    text: str = "text",
    row_id: str = "row_id",
    keep: Sequence[str] = (),
    char_bound: int | None = None,
) -> DataFrame:
    """Language-modelling samples: labels are the ids themselves.

    ``char_bound`` cuts a text to that many characters per token before it is
    tokenized. With tokens that are words this shortens samples; it is off.
    """
    capped = tx.cap_chars(F.col(text), None if char_bound is None else char_bound * max_length)
    ids = tk.head_truncate(tk.tokenize(capped, conf), max_length)
    out = with_once(df.select(row_id, *keep, text), {"input_ids": ids})
    out = out.filter(tk.length_between(F.col("input_ids"), min_length, None))
    return _finish(out, row_id, keep, F.col("input_ids"))


def sft_samples(
    df: DataFrame,
    conf: C.Tokens = C.Tokens(),
    min_length: int = C.SAMPLE_MIN_LENGTH,
    max_length: int = 8192,
    prompt: str = "input",
    output: str = "output",
    row_id: str = "row_id",
    keep: Sequence[str] = (),
    with_labels: bool = True,
    seed: int = 42,
    keep_text: bool = False,
    char_bound: int | None = None,
) -> DataFrame:
    """Instruction samples: only the output (and the eos) carries labels.

    ``with_labels=False`` gives the evaluation form: the prompt alone, without
    labels and without a minimum length. ``keep_text`` adds the joined text
    with its random separator, for tokenizers that see blanks.
    """
    df = sft_words(df, conf, max_length, prompt, output, char_bound).filter("_fits")
    if with_labels:
        df = df.filter("_answered")
    else:
        out = df.select(F.col(row_id), *keep, tk.word_ids(F.col("_prompt"), conf).alias("input_ids"))
        return _finish(out, row_id, keep, None)
    ids = tk.word_ids(F.concat("_prompt", "_out"), conf)
    text = F.concat(
        tk.decode(F.col("_prompt")), tk.separator(F.col(row_id), seed), tk.decode(F.col("_out"))
    )
    extra = {"text": text} if keep_text else {}
    out = with_once(
        df.select(row_id, *keep, "_prompt", "_out"),
        {"_ids": ids, "_answer": F.size("_out"), **extra},
    ).filter(tk.length_between(F.col("_ids"), min_length, None))
    columns = _sft_columns(F.col("_ids"), F.col("_answer"))
    out = out.select(
        F.col(row_id),
        *keep,
        *[F.col("text")] * keep_text,
        *[c.alias(n) for n, c in columns.items()],
    )
    return out.withColumns(
        {"length": F.size("input_ids"), "index": F.col(row_id).cast("bigint")}
    )


def _sft_columns(ids: Column, answer_length: Column) -> dict[str, Column]:
    return tk.append_eos(
        {
            "input_ids": ids,
            "labels": tk.mask_all_but_last(ids, answer_length),
            "attention_mask": tk.ones(ids),
        }
    )


def pretokenized_samples(
    df: DataFrame,
    min_length: int = C.SAMPLE_MIN_LENGTH,
    max_length: int = 8192,
    row_id: str = "row_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows that already hold ids and labels, kept when the length fits."""
    out = df.filter(tk.length_between(F.col("input_ids"), min_length, max_length))
    return _finish(out, row_id, keep, F.col("labels"))


def _finish(df: DataFrame, row_id: str, keep: Sequence[str], labels: Column | None) -> DataFrame:
    cols = [F.col(row_id), *[F.col(c) for c in keep], F.col("input_ids")]
    if labels is not None:
        cols.append(labels.alias("labels"))
    return df.select(
        *cols,
        tk.ones(F.col("input_ids")).alias("attention_mask"),
        F.size("input_ids").alias("length"),
        F.col(row_id).cast("bigint").alias("index"),
    )


def mixed_samples(
    df: DataFrame,
    conf: C.Tokens = C.Tokens(),
    min_length: int = C.SAMPLE_MIN_LENGTH,
    max_length: int = 8192,
    row_id: str = "row_id",
    keep: Sequence[str] = (),
    with_labels: bool = True,
    char_bound: int | None = None,
) -> DataFrame:
    """Samples from a wide table whose rows have one of three shapes.

    ``text`` wins over ``input``/``output``, that over ``input_ids``/``labels``;
    a row with none of them is an error. All three shapes are built in the
    same scan. ``with_labels=False`` gives instruction rows their evaluation
    form: the prompt alone, no labels, no minimum length.
    """
    is_lm = F.col("text").isNotNull()
    is_sft = ~is_lm & F.col("input").isNotNull()
    is_ids = ~is_lm & ~is_sft & F.col("input_ids").isNotNull()
    shape = (
        F.when(is_lm, "lm")
        .when(is_sft, "sft")
        .when(is_ids, "ids")
        .otherwise(F.raise_error(F.lit("row has neither text, input nor input_ids")))
    )
    words = sft_words(df.withColumn("_shape", shape), conf, max_length, char_bound=char_bound)
    capped = tx.cap_chars(F.col("text"), None if char_bound is None else char_bound * max_length)
    lm, sft = F.col("_shape") == "lm", F.col("_shape") == "sft"
    words_of_sft = F.concat("_prompt", "_out") if with_labels else F.col("_prompt")
    ids = (
        F.when(lm, tk.head_truncate(tk.tokenize(capped, conf), max_length))
        .when(sft, tk.word_ids(words_of_sft, conf))
        .otherwise(F.col("input_ids"))
    )
    usable = F.col("_fits") & F.col("_answered") if with_labels else F.col("_fits")
    shaped = with_once(
        words.filter(~sft | usable), {"_ids": ids, "_answer": F.size("_out")}
    ).withColumnRenamed("labels", "_labels")
    long_enough = tk.length_between(F.col("_ids"), min_length, None)
    shaped = shaped.filter(
        (long_enough if with_labels else sft | long_enough)
        & ((F.col("_shape") != "ids") | tk.length_between(F.col("_ids"), None, max_length))
    )
    if with_labels:
        made = _sft_columns(F.col("_ids"), F.col("_answer"))
    else:
        made = {
            "input_ids": F.col("_ids"),
            "labels": F.lit(None).cast("array<int>"),
            "attention_mask": tk.ones(F.col("_ids")),
        }
    plain = {
        "input_ids": F.col("_ids"),
        "labels": F.when(lm, F.col("_ids")).otherwise(F.col("_labels")),
        "attention_mask": tk.ones(F.col("_ids")),
    }
    out = shaped.select(
        F.col(row_id), *keep, *[F.when(sft, made[n]).otherwise(plain[n]).alias(n) for n in made]
    )
    return out.withColumns(
        {"length": F.size("input_ids"), "index": F.col(row_id).cast("bigint")}
    )


# --- row functions supplied by the user ------------------------------------


def map_rows(
    df: DataFrame,
    fn: Callable[..., dict | None],
    schema: T.StructType | str,
    index: str | None = None,
    augment: bool = False,
) -> DataFrame:
    """Apply a Python row function to Arrow batches on the executors.

    ``fn`` gets the row's columns as keywords and returns one row as a dict,
    or ``None`` to drop it. With ``augment`` each value is a list and the row
    becomes as many rows. ``index`` is passed as ``_index``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_dict("records"):
                if index is not None:
                    row["_index"] = row[index]
                made = fn(**row)
                if made is None:
                    continue
                if augment:
                    names = list(made)
                    out += [dict(zip(names, v, strict=True)) for v in zip(*made.values(), strict=True)]
                else:
                    out.append(made)
            if out:
                yield pd.DataFrame(out)

    return df.mapInPandas(run, schema)


# --- whole-corpus operators ------------------------------------------------


def sample_per_source(
    df: DataFrame,
    n: int = C.SAMPLE_CAP_PER_SOURCE,
    source: str = "source",
    row_id: str = "row_id",
    seed: int = 42,
    known_sources: int | None = None,
) -> DataFrame:
    """Exactly n random rows of every source that has more, all of the others."""
    return shuffled_positions(
        df, row_id, seed, [source], "_pos", first=n, known_keys=known_sources
    ).drop("_pos")


def concatenate(parts: Sequence[DataFrame]) -> DataFrame:
    """Row-wise union in list order; ``part`` keeps that order."""
    tagged = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def after(rows: DataFrame, earlier: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``rows`` numbered on from the last id of ``earlier``; ``part_row`` is the old id.

    One running index over both, dense if both are. The last id is a scalar
    subquery over one column, so no row moves.
    """
    last = earlier.agg((F.coalesce(F.max(row_id), F.lit(-1)) + 1).alias("n")).scalar()
    return rows.withColumns({"part_row": F.col(row_id), row_id: F.col(row_id) + last})


def two_part_corpus(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Language-modelling rows, then question-answer rows with a hidden prompt.

    ``row_id`` runs on over both parts, ``part_row`` counts within its part.
    """
    first = texts.withColumn("part_row", F.col("row_id"))
    second = after(pairs, texts)
    return concatenate(
        [
            lm_rows(first, keep=("part_row",)),
            qa_rows(second, "input", "output", False, keep=("part_row",)),
        ]
    )


def sampled_corpus(
    texts: DataFrame,
    pairs: DataFrame | None,
    conf: C.Tokens = C.Tokens(),
    max_length: int = 8192,
    min_length: int = C.SAMPLE_MIN_LENGTH,
    per_source: int = C.SAMPLE_CAP_PER_SOURCE,
    distill: bool = False,
    seed: int = 42,
) -> DataFrame:
    """Token samples of both parts, each part cut to an exact random number.

    ``row_id`` runs on over the raw rows of both parts. Samples are written once, so
    that counting and choosing them does not tokenize twice; the choice reads ids of
    what was written, and of the arrays only buckets that can hold chosen rows move.
    """
    parts = [
        lm_samples(texts, conf, min_length, max_length).withColumn("part", F.lit(0))
    ]
    if pairs is not None:
        parts.append(
            sft_samples(after(pairs, texts), conf, min_length, max_length, seed=seed).withColumn(
                "part", F.lit(1)
            )
        )
    both = settle(reduce(lambda a, b: a.unionByName(b), parts))
    kept = sample_per_source(both, per_source, "part", "row_id", seed, known_sources=2)
    return kept.withColumns(
        {"distill": F.lit(distill), "task_type": F.lit(C.SHIFTED_LABELS)}
    )
