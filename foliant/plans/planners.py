"""Task planners: a corpus row becomes an ordered list of chunk-plan rows.

Each planner builds its rows as one array of structs inside the row and
explodes that array once, so planning never shuffles and never copies a whole
document per chunk.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant import config as C
from foliant.functions import hashing
from foliant.functions import text as tx
from foliant.functions import tokens as tk
from foliant.operators import mixing
from foliant.operators.once import with_once

# Fields of one chunk-plan row, in order, with their types and defaults.
FIELDS = {
    "segment": ("string", None),
    "input_ids": ("array<int>", None),
    "labels": ("array<int>", None),
    "loss_mask": ("array<int>", None),
    "has_loss": ("boolean", False),
    "loss_kind": ("string", None),
    "prefix_repeat": ("boolean", False),
    "forward_teacher": ("boolean", False),
    "do_not_compress": ("boolean", False),
    "clear_cache": ("int", None),
    "loss_denominator": ("int", None),
    "prompt_emptied": ("boolean", False),
}
PLAN_COLUMNS = ["sample_id", "task_type", "seq", *FIELDS]


def plan_row(**given: Column | str | bool | int | None) -> Column:
    """One chunk-plan struct; fields not given take their defaults."""
    unknown = set(given) - set(FIELDS)
    if unknown:
        raise ValueError(f"not a chunk-plan field: {sorted(unknown)}")
    parts = []
    for name, (kind, default) in FIELDS.items():
        value = given.get(name, default)
        col = value if isinstance(value, Column) else F.lit(value)
        parts.append(col.cast(kind).alias(name))
    return F.struct(*parts)


def _with_loss(condition: Column, value: Column | str) -> Column:
    return F.when(condition, value if isinstance(value, Column) else F.lit(value))


def emit(df: DataFrame, rows: Column, task_type: str, row_id: str = "row_id") -> DataFrame:
    """Explode an array of plan structs; ``seq`` is the order of consumption."""
    out = df.select(F.col(row_id).cast("bigint").alias("sample_id"), F.posexplode(rows))
    return out.select(
        "sample_id",
        F.lit(task_type).alias("task_type"),
        F.col("pos").alias("seq"),
        *[F.col("col")[name].alias(name) for name in FIELDS],
    )


# Marks the rows a planner is meant for when several share one pass.
_MINE = "_mine"


def _ids(df: DataFrame, **columns: Column) -> DataFrame:
    """Token columns, made once however often later expressions use them.

    In a shared pass they stay null on the rows of other planners.
    """
    if _MINE in df.columns:
        columns = {n: F.when(F.col(_MINE), c) for n, c in columns.items()}
    return with_once(df, columns)


def planner(tag: str) -> Callable:
    """A planner from a function that returns a table and an array of plan structs.

    Called, it explodes the array. ``rows`` is the function itself, from which
    the dispatcher takes the arrays of all its planners in one pass.
    """

    def wrap(build: Callable) -> Callable:
        signature = inspect.signature(build)

        @functools.wraps(build)
        def plan(*args, **kwargs) -> DataFrame:
            given = signature.bind(*args, **kwargs)
            given.apply_defaults()
            df, rows = build(*given.args, **given.kwargs)
            return emit(df, rows, tag, given.arguments["row_id"])

        plan.rows = build
        return plan

    return wrap


def explode_chunks(
    df: DataFrame, chunk_size: int, arrays: tuple[str, ...] = ("input_ids",), keep: tuple[str, ...] = ()
) -> DataFrame:
    """Fixed-size segmentation of parallel arrays: one row per chunk."""
    parts = F.transform(
        tk.chunk_starts(F.col(arrays[0]), chunk_size),
        lambda i: F.struct(*[tk.chunk_at(F.col(a), i, chunk_size).alias(a) for a in arrays]),
    )
    out = df.select(*keep, F.posexplode(parts))
    return out.select(
        *keep, F.col("pos").alias("chunk_id"), *[F.col("col")[a].alias(a) for a in arrays]
    )


@planner(C.LANGUAGE_MODELING)
def lm_plan(
    df: DataFrame,
    chunks: C.Chunks = C.Chunks(),
    tokens: C.Tokens = C.Tokens(),
    truncation: int | None = None,
    text: str = "text",
    row_id: str = "row_id",
) -> tuple[DataFrame, Column]:
    """Every chunk predicts its own next tokens; a one-token chunk has no loss."""
    df = _ids(df, _ids=tk.head_truncate(tk.tokenize(F.col(text), tokens), truncation))

    def row(chunk):
        scored = F.size(chunk) > 1
        return plan_row(
            segment="context",
            input_ids=chunk,
            labels=tk.drop_first(chunk),
            loss_mask=tk.ones(tk.drop_first(chunk)),
            has_loss=scored,
            loss_kind=_with_loss(scored, "ce"),
            loss_denominator=_with_loss(scored, F.size(chunk) - 1),
        )

    rows = F.transform(tk.chunk_arrays(F.col("_ids"), chunks.chunk_size), row)
    return df, rows


@planner(C.PERPLEXITY)
def perplexity_plan(
    df: DataFrame,
    chunks: C.Chunks = C.Chunks(),
    tokens: C.Tokens = C.Tokens(),
    truncation: int | None = None,
    text: str = "text",
    row_id: str = "row_id",
) -> tuple[DataFrame, Column]:
    """Every chunk is scored on its own; its first token never is."""
    df = _ids(df, _ids=tk.head_truncate(tk.tokenize(F.col(text), tokens), truncation))

    def row(chunk):
        return plan_row(
            segment="context",
            input_ids=chunk,
            labels=tk.drop_first(chunk),
            loss_mask=tk.ones(tk.drop_first(chunk)),
            has_loss=True,
            loss_kind="ppl",
            loss_denominator=F.size(chunk) - 1,
        )

    rows = F.transform(tk.chunk_arrays(F.col("_ids"), chunks.chunk_size), row)
    return df, rows


@planner(C.QUESTION_ANSWERING)
def qa_plan(
    df: DataFrame,
    chunks: C.Chunks = C.Chunks(),
    tokens: C.Tokens = C.Tokens(),
    truncation: int | None = None,
    row_id: str = "row_id",
) -> tuple[DataFrame, Column]:
    """Prompt cut from the middle, then prompt and response chunked together.

    The first chunk never has loss; a later one has it when a scored position
    remains after the shift. ``prompt_emptied`` tells that the response leaves
    no room for the prompt.
    """
    n = chunks.chunk_size
    df = _ids(
        df,
        _full=tk.tokenize(F.col("prompt"), tokens),
        _response=tk.tokenize(F.col("response"), tokens),
    )
    df = _ids(df, _prompt=tk.middle_truncate_prompt(F.col("_full"), F.col("_response"), truncation))
    prompt_mask = F.array_repeat(F.col("train_prompt").cast("int"), F.size("_prompt"))
    df = _ids(
        df,
        _ids=F.concat("_prompt", "_response"),
        _mask=F.concat(prompt_mask, tk.ones(F.col("_response"))),
    )

    def row(i):
        ids = tk.chunk_at(F.col("_ids"), i, n)
        mask = tk.drop_first(tk.chunk_at(F.col("_mask"), i, n))
        scored = (i > 0) & (tk.total(mask) > 0)
        return plan_row(
            segment=F.when(i * n < F.size("_prompt"), "prompt").otherwise("response"),
            input_ids=ids,
            labels=tk.drop_first(ids),
            loss_mask=mask,
            has_loss=scored,
            loss_kind=_with_loss(scored, "ce"),
            loss_denominator=_with_loss(scored, tk.total(mask)),
            prompt_emptied=F.lit(False) if truncation is None else F.size("_response") >= truncation,
        )

    rows = F.transform(tk.chunk_starts(F.col("_ids"), n), row)
    return df, rows


@planner(C.AUTO_ENCODING)
def copy_pair_plan(
    df: DataFrame,
    chunks: C.Chunks = C.Chunks(),
    tokens: C.Tokens = C.Tokens(),
    row_id: str = "row_id",
    strict: bool = False,
) -> tuple[DataFrame, Column]:
    """A prompt chunk, then a response chunk scored whole.

    The response is fed after a repeat token, so its labels are not shifted.
    The prompt must fill a chunk and the response must be one token shorter;
    other rows are left out, or an error with ``strict``.
    """
    n = chunks.chunk_size
    df = _ids(
        df,
        _prompt=tk.tokenize(F.col("prompt"), tokens),
        _response=tk.tokenize(F.col("response"), tokens),
    )
    fits = (F.size("_prompt") == n) & (F.size("_response") == n - 1)
    if strict:
        fits = F.when(fits, F.lit(True)).otherwise(
            F.raise_error(F.lit("copy pair does not fill its chunks")).cast("boolean")
        )
    rows = F.array(
        plan_row(segment="prompt", input_ids=F.col("_prompt")),
        plan_row(
            segment="repeat",
            input_ids=F.col("_response"),
            labels=F.col("_response"),
            loss_mask=tk.ones(F.col("_response")),
            has_loss=True,
            loss_kind="ce",
            prefix_repeat=True,
            loss_denominator=F.size("_response"),
        ),
    )
    df = _ids(df, _fits=fits)
    return df, F.when(F.col("_fits"), rows)


def copy_pair_violations(
    df: DataFrame, chunks: C.Chunks = C.Chunks(), tokens: C.Tokens = C.Tokens()
) -> DataFrame:
    """Copy pairs that do not fill their chunks, with both lengths."""
    sized = _ids(
        df,
        prompt_length=F.size(tk.tokenize(F.col("prompt"), tokens)),
        response_length=F.size(tk.tokenize(F.col("response"), tokens)),
    )
    n = chunks.chunk_size
    return sized.filter((F.col("prompt_length") != n) | (F.col("response_length") != n - 1))


def _encode_news(df: DataFrame, prefix: str, lead: str, tokens: C.Tokens, most: int) -> DataFrame:
    """Add ``_texts``, what a list encoder makes of a news row in one pass.

    The ids of prefix, story and distractor and of both sides of every turn,
    without bos and no more than ``most`` of each.
    """
    if tokens.list_encoder is None:
        return df
    told = F.array(F.lit(prefix), tx.news_context(F.col("context"), prefix), F.col("disturb"))
    sides = F.transform(_turn_texts(lead), lambda z: F.array(z["ask"], z["reply"]))
    texts = F.concat(told, F.flatten(sides))
    if _MINE in df.columns:
        texts = F.when(F.col(_MINE), texts)
    return _ids(df, _texts=tokens.list_encoder(texts, most))


def _place_story(
    df: DataFrame, prefix: str, tokens: C.Tokens, position: Callable[[Column], Column], most: int
) -> DataFrame:
    """Add ``_context``: the story inside distractor tokens, ``_budget`` long.

    ``position`` maps the number of distractor tokens to the insertion point.
    The prefix stands once before the distractors and once before the story.
    A story that fills the budget by itself is cut to it. No budget is above
    ``most``. The words of a story are all counted; only those of story and
    distractor that the budget has room for are turned into ids. A list encoder
    stops at ``most`` ids: whatever follows them, such a story leaves no room.
    """
    if tokens.list_encoder is not None:
        story = F.get("_texts", F.lit(1))
        counted = F.struct(F.size(story).alias("size"), tk.first_n(story, F.col("_budget")).alias("ids"))
        lead = tk.with_bos(F.get("_texts", F.lit(0)), tokens)
        noise = lambda n: tk.first_n(F.get("_texts", F.lit(2)), n)
    else:
        story = tx.news_context(F.col("context"), prefix)
        counted = tk.counted_ids(story, F.col("_budget"), tokens, add_bos=False)
        lead = tk.tokenize(F.lit(prefix), tokens)
        noise = lambda n: tk.first_ids(F.col("disturb"), n, most, tokens, add_bos=False)
    df = _ids(df, _counted=counted, _prefix=lead)
    df = _ids(df, _room=F.col("_budget") - F.col("_counted.size") - F.size("_prefix"))
    df = _ids(df, _story=F.col("_counted.ids"), _extra=noise(F.col("_room")))
    df = _ids(df, _at=F.coalesce(position(F.size("_extra")), F.lit(0)).cast("int"))
    inside = F.concat(
        F.col("_prefix"),
        tk.first_n(F.col("_extra"), F.col("_at")),
        F.col("_story"),
        tk.drop_first(F.col("_extra"), F.col("_at")),
    )
    alone = tk.first_n(F.concat("_prefix", "_story"), F.col("_budget"))
    return _ids(df, _context=F.when(F.col("_room") > 0, inside).otherwise(alone))


def _turn_texts(lead: str) -> Column:
    """Structs of the two sides of each turn: the questions with their answers and, last, the summary."""
    asked = F.transform(F.arrays_zip(F.col("questions"), F.col("answers")), lambda z: F.struct(
        tx.question_text(z["questions"], lead).alias("ask"),
        tx.answer_text(z["answers"], lead).alias("reply"),
    ))
    # Only pairs present on both sides take part.
    asked = tk.first_n(asked, F.least(F.size("questions"), F.size("answers")))
    summary = F.array(
        F.struct(F.lit(lead + C.SUMMARY_REQUEST).alias("ask"), F.col("summation").alias("reply"))
    )
    return F.concat(asked, summary)


def _turns(
    df: DataFrame, lead: str, tokens: C.Tokens, width: Column | int, cap: int, most: int
) -> DataFrame:
    """Add ``_turns``: structs of ids, mask and the length of the turn before.

    No ``width`` is above ``most``.
    """
    def encoded(z):
        # Made once per turn, in a transform of its own: both arrays of the turn read them.
        return F.struct(*[tk.first_ids(z[side], width, most, tokens).alias(side) for side in ("ask", "reply")])

    def turn(z):
        return F.struct(
            tk.first_n(F.concat(z["ask"], z["reply"]), width).alias("ids"),
            tk.first_n(F.concat(tk.zeros(z["ask"]), tk.ones(z["reply"])), width).alias("mask"),
        )

    if tokens.list_encoder is not None:
        sides = F.transform(tk.chunk_arrays(tk.drop_first(F.col("_texts"), 3), 2), lambda z: F.struct(
            *[tk.with_bos(F.get(z, F.lit(i)), tokens).alias(side) for i, side in enumerate(("ask", "reply"))]
        ))
    else:
        sides = F.transform(_turn_texts(lead), encoded)
    df = _ids(df, _bare=F.transform(sides, turn))
    before = F.transform(
        F.col("_bare"),
        lambda t, i: F.when(
            i > 0, F.least(F.size(F.get(F.col("_bare"), i - 1)["ids"]), F.lit(cap))
        ),
    )
    df = _ids(df, _before=before)
    last = F.size("_bare") - 1
    return _ids(
        df,
        _turns=F.transform(
            F.col("_bare"),
            lambda t, i: F.struct(
                t["ids"].alias("ids"),
                t["mask"].alias("mask"),
                F.get(F.col("_before"), i).alias("before"),
                F.when(i < last, "question").otherwise("summary").alias("segment"),
            ),
        ),
    )


@planner(C.NEWS_V1)
def news_plan_v1(
    df: DataFrame,
    chunks: C.Chunks = C.Chunks(),
    tokens: C.Tokens = C.Tokens(),
    truncation: int = 8192,
    row_id: str = "row_id",
    seed: int = 42,
    compat: bool = False,
) -> tuple[DataFrame, Column]:
    """Story hidden among distractors, then questions and a summary request.

    The context budget is a random whole number of chunks up to
    ``truncation``. ``method`` of the row picks the loss: ``lm`` is cross
    entropy on the shifted reply, ``distill`` is KL against the teacher. With
    ``compat`` the ``lm`` mask stays unshifted beside shifted labels, so the
    first reply token is counted but not scored.
    """
    df = _plain_answers(df)
    n = chunks.chunk_size
    gain = hashing.draw_below(truncation // n, F.col(row_id), seed, "gain") + 1
    df = _encode_news(df, C.NEWS_V1_PREFIX, "", tokens, max(truncation, n))
    df = _ids(df, _budget=(gain * n).cast("int"))
    df = _place_story(
        df,
        C.NEWS_V1_PREFIX,
        tokens,
        lambda size: hashing.draw_below(size, F.col(row_id), seed, "place"),
        truncation,
    )
    df = _turns(df, "", tokens, n, n, n)
    lm = F.col("method") == "lm"

    def turn_row(t):
        shifted = t["mask"] if compat else tk.drop_first(t["mask"])
        mask = F.when(lm, shifted).otherwise(t["mask"])
        return plan_row(
            segment=t["segment"],
            input_ids=t["ids"],
            labels=F.when(lm, tk.drop_first(t["ids"])),
            loss_mask=mask,
            has_loss=True,
            loss_kind=F.when(lm, "ce").otherwise("kl"),
            forward_teacher=~lm,
            do_not_compress=True,
            clear_cache=t["before"],
            loss_denominator=tk.total(mask),
        )

    context = F.transform(
        tk.chunk_arrays(F.col("_context"), n),
        lambda c: plan_row(segment="context", input_ids=c, forward_teacher=~lm),
    )
    return df, F.concat(context, F.transform("_turns", turn_row))


@planner(C.NEWS_V2)
def news_plan_v2(
    df: DataFrame,
    chunks: C.Chunks = C.Chunks(),
    tokens: C.Tokens = C.Tokens(),
    window: int = 4096,
    low: int = 3072,
    high: int = 3584,
    row_id: str = "row_id",
    seed: int = 42,
) -> tuple[DataFrame, Column]:
    """As v1, with a budget in [low, high] of a fixed window.

    What the context leaves of the window bounds each turn. Every row runs the
    teacher and the loss blends KL and cross entropy; the summary carries the
    labels the blend needs.
    """
    df = _plain_answers(df)
    n = chunks.chunk_size
    budget = hashing.draw_below(high - low + 1, F.col(row_id), seed, "budget") + low
    df = _encode_news(df, C.NEWS_V2_PREFIX, C.V2_LEAD, tokens, max(high, window - low))
    df = _ids(df, _budget=budget.cast("int"))
    df = _place_story(
        df,
        C.NEWS_V2_PREFIX,
        tokens,
        lambda size: hashing.draw_below(size - 2, F.col(row_id), seed, "place") + 1,
        high,
    )
    df = _turns(df, C.V2_LEAD, tokens, F.lit(window) - F.col("_budget"), n, window - low)
    context = F.transform(
        tk.chunk_arrays(F.col("_context"), n),
        lambda c: plan_row(segment="context", input_ids=c, forward_teacher=True),
    )
    turns = F.transform(
        "_turns",
        lambda t: plan_row(
            segment=t["segment"],
            input_ids=t["ids"],
            labels=tk.drop_first(t["ids"]),
            loss_mask=t["mask"],
            has_loss=True,
            loss_kind="kl+ce",
            forward_teacher=True,
            do_not_compress=True,
            clear_cache=t["before"],
            loss_denominator=tk.total(t["mask"]),
        ),
    )
    return df, F.concat(context, turns)


@planner(C.MEMORY_UTILIZATION)
def memory_utilization_plan(
    df: DataFrame,
    chunks: C.Chunks = C.Chunks(),
    tokens: C.Tokens = C.Tokens(),
    truncation: int = 2048,
    text: str = "text",
    row_id: str = "row_id",
    seed: int = 42,
) -> tuple[DataFrame, Column]:
    """The text, then random ids that only the memory could help to predict."""
    n = chunks.chunk_size
    if truncation % 2 or truncation // 2 != n:
        raise ValueError("truncation must be exactly two chunks")
    df = _ids(
        df,
        _ids=tk.head_truncate(tk.tokenize(F.col(text), tokens), truncation),
        _noise=tk.random_ids(F.col(row_id), n, tokens.vocab_size, seed),
    )
    rows = F.array(
        plan_row(segment="context", input_ids=F.col("_ids"), forward_teacher=True),
        plan_row(
            segment="random",
            input_ids=F.col("_noise"),
            loss_mask=tk.ones(F.col("_noise")),
            has_loss=True,
            loss_kind="kl",
            forward_teacher=True,
            do_not_compress=True,
            loss_denominator=n,
        ),
    )
    return df, rows


@planner(C.SHIFTED_LABELS)
def shifted_label_plan(
    df: DataFrame, chunks: C.Chunks = C.Chunks(), row_id: str = "row_id"
) -> tuple[DataFrame, Column]:
    """Chunks of prepared samples with labels shifted over the whole sample.

    Cross entropy per chunk is divided by the valid labels of the sample;
    ``distill`` rows take KL under the chunk's mask instead.
    """
    n = chunks.chunk_size
    attended = F.forall("attention_mask", lambda m: m != 0)
    checked = F.when(attended, F.col("attention_mask")).otherwise(
        F.raise_error(F.lit("attention_mask must be all ones")).cast("array<int>")
    )
    df = _ids(df, _mask=checked)
    df = _ids(df, _labels=tk.ignore_masked(tk.shift_labels(F.col("labels")), F.col("_mask")))
    df = _ids(df, _valid=tk.valid_labels(F.col("_labels")))
    distill = F.col("distill")

    def row(i):
        mask = tk.chunk_at(F.col("_mask"), i, n)
        return plan_row(
            segment="context",
            input_ids=tk.chunk_at(F.col("input_ids"), i, n),
            labels=tk.chunk_at(F.col("_labels"), i, n),
            loss_mask=mask,
            has_loss=True,
            loss_kind=F.when(distill, "kl").otherwise("ignore_index"),
            forward_teacher=distill,
            loss_denominator=F.when(distill, tk.total(mask)).otherwise(F.col("_valid")),
        )

    rows = F.transform(tk.chunk_starts(F.col("input_ids"), n), row)
    return df, rows


@planner(C.COPY_BACK)
def copy_back_plan(
    df: DataFrame,
    chunks: C.Chunks = C.Chunks(),
    tokens: C.Tokens = C.Tokens(),
    truncation: int | None = None,
    text: str = "text",
    row_id: str = "row_id",
) -> tuple[DataFrame, Column]:
    """Whole chunks of the text, then the same text again as labels after eos."""
    n = chunks.chunk_size
    df = _ids(df, _all=tk.tokenize(F.col(text), tokens))
    whole = F.floor(F.size("_all") / n).cast("int") * n
    df = _ids(df, _m=whole if truncation is None else F.least(F.lit(truncation), whole))
    df = _ids(df, _ids=tk.first_n(F.col("_all"), F.col("_m")))
    df = _ids(df, _fed=F.concat(F.array(F.lit(C.EOS)), tk.drop_last(F.col("_ids"))))
    starts = tk.chunk_starts(F.col("_ids"), n)
    first = F.transform(
        starts,
        lambda i: plan_row(segment="context", input_ids=tk.chunk_at(F.col("_ids"), i, n)),
    )
    second = F.transform(
        starts,
        lambda i: plan_row(
            segment="repeat",
            input_ids=tk.chunk_at(F.col("_fed"), i, n),
            labels=tk.chunk_at(F.col("_ids"), i, n),
            has_loss=True,
            loss_kind="ignore_index",
            loss_denominator=F.col("_m"),
        ),
    )
    return df, F.concat(first, second)


def first_alternative(answers: Column) -> Column:
    """The first of each question's alternative answers."""
    return F.transform(answers, lambda alternatives: F.get(alternatives, 0))


def _plain_answers(df: DataFrame) -> DataFrame:
    """Answers as they come from a corpus (lists of alternatives) or one each."""
    kind = df.schema["answers"].dataType
    nested = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)
    return df.withColumn("answers", first_alternative(F.col("answers"))) if nested else df


_PLAN_TYPE = f"array<struct<{','.join(f'{n}:{kind}' for n, (kind, _) in FIELDS.items())}>>"


def plan_tasks(
    df: DataFrame,
    chunks: C.Chunks = C.Chunks(),
    tokens: C.Tokens = C.Tokens(),
    truncation: int | None = None,
    task_types: tuple[str, ...] | None = None,
    override: str | None = None,
    row_id: str = "row_id",
    seed: int = 42,
    reservoir: int | None = None,
) -> DataFrame:
    """Plan a wide corpus by the tag of each row, in one pass.

    ``override`` replaces every row's tag, as evaluation does. ``task_types``
    names the tags to plan; without it these are all tags whose columns the
    table has and whose planner can work with ``truncation``. Each planner
    adds one array to the row, null on rows of other tags; the arrays are
    joined and exploded once. A row with any other tag is an error.
    ``reservoir`` adds what a reservoir of that many slots decides about each chunk
    (``mixing.FATE``), in the row before it is exploded.
    """
    common = {"chunks": chunks, "row_id": row_id}
    cut = {**common, "tokens": tokens, "truncation": truncation}
    n = chunks.chunk_size
    text, pair = ("text",), ("prompt", "response")
    news = ("disturb", "context", "questions", "answers", "summation")
    # Planner, its settings, the columns it reads, and whether it can work.
    known = {
        C.LANGUAGE_MODELING: (lm_plan, cut, text, True),
        C.PERPLEXITY: (perplexity_plan, cut, text, True),
        C.QUESTION_ANSWERING: (qa_plan, cut, (*pair, "train_prompt"), True),
        C.AUTO_ENCODING: (copy_pair_plan, {**common, "tokens": tokens}, pair, True),
        C.NEWS_V1: (news_plan_v1, {**cut, "seed": seed}, (*news, "method"), (truncation or 0) >= n),
        C.NEWS_V2: (news_plan_v2, {**common, "tokens": tokens, "seed": seed}, news, True),
        C.MEMORY_UTILIZATION: (memory_utilization_plan, {**cut, "seed": seed}, text, truncation == 2 * n),
        C.SHIFTED_LABELS: (
            shifted_label_plan, common, ("input_ids", "labels", "attention_mask", "distill"), True
        ),
        C.COPY_BACK: (copy_back_plan, cut, text, True),
    }
    if override is not None:
        df = df.withColumn("task_type", F.lit(override))
        task_types = (override,)
    if task_types is None:
        have = set(df.columns)
        wanted = [t for t, (_, _, needs, able) in known.items() if able and have.issuperset(needs)]
    else:
        wanted = list(task_types)
        unknown = [t for t in wanted if t not in known]
        if unknown:
            raise ValueError(f"no planner for task type {unknown}")
        unable = [t for t in wanted if not known[t][3]]
        if unable:
            raise ValueError(f"truncation {truncation} does not suit task type {unable}")
    own, plans = df.columns, []
    for k, tag in enumerate(wanted):
        build, settings, _, _ = known[tag]
        mine = F.coalesce(F.col("task_type") == tag, F.lit(False))
        made, rows = build.rows(df.withColumn(_MINE, mine), **settings)
        made = with_once(made, {f"_plan{k}": F.when(F.col(_MINE), rows).cast(_PLAN_TYPE)})
        plans.append(f"_plan{k}")
        df = made.select(*own, *plans)
    failed = F.raise_error(
        F.concat(F.lit("no planner for task type "), F.coalesce("task_type", F.lit("null")))
    ).cast(_PLAN_TYPE)
    planned = F.coalesce(F.col("task_type").isin(*wanted), F.lit(False))
    rows = F.when(~planned, failed).otherwise(F.coalesce(*plans, F.lit(None).cast(_PLAN_TYPE)))
    fate: tuple[str, ...] = ()
    if reservoir is not None:
        fate = mixing.FATE
        df = with_once(df.withColumn("_sample", F.col(row_id).cast("bigint")), {"_rows": rows})
        count = F.coalesce(F.size("_rows"), F.lit(0))
        df = mixing.with_fates(df.drop(*plans), count, reservoir, "_sample", seed, "_fates")
        rows = F.transform(
            "_rows",
            lambda r, i: F.struct(
                *[r[n].alias(n) for n in FIELDS], *[F.get("_fates", i)[n].alias(n) for n in fate]
            ),
        )
    out = df.select(F.col(row_id).cast("bigint").alias("sample_id"), "task_type", F.posexplode(rows))
    return out.select(
        "sample_id",
        "task_type",
        F.col("pos").alias("seq"),
        *[F.col("col")[name].alias(name) for name in (*FIELDS, *fate)],
    )
