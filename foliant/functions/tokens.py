"""Column functions on ARRAY<INT> token columns.

Array bounds: ``slice`` fails on start 0 and on a negative length, returns an
empty array for ``slice(a, -k, n)`` with k above the size, and
``sequence(0, -1)`` counts down. The helpers below guard each of these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant import config as C
from foliant.functions import hashing

_BLANK = r"[ \t\n\x0B\f\r]"


def empty_ints() -> Column:
    return F.array().cast("array<int>")


def words(text: Column) -> Column:
    """Maximal runs without ASCII blanks; splitting is faster than matching."""
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def word_id(word: Column, vocab_size: int) -> Column:
    """Hash id of one word; pad, bos and eos stay below it."""
    return (hashing.hex_to_long(F.md5(word), 6) % vocab_size + 3).cast("int")


def with_bos(ids: Column, conf: C.Tokens, add_bos: bool | None = None) -> Column:
    wanted = conf.add_bos if add_bos is None else add_bos
    return F.concat(F.array(F.lit(C.BOS)), ids) if wanted else ids


def word_ids(word_array: Column, conf: C.Tokens = C.Tokens(), add_bos: bool | None = None) -> Column:
    if conf.encoder is not None:
        raise ValueError("this sample is cut by words and needs the word tokenizer")
    return with_bos(F.transform(word_array, lambda w: word_id(w, conf.vocab_size)), conf, add_bos)


def tokenize(text: Column, conf: C.Tokens = C.Tokens(), add_bos: bool | None = None) -> Column:
    if conf.encoder is not None:
        return with_bos(conf.encoder(text), conf, add_bos)
    return word_ids(words(text), conf, add_bos)


def first_words(text: Column, most: int) -> Column:
    """The first ``most`` words; what follows them is not split."""
    pieces = F.split(text, _BLANK + "+", max(most, 0) + 2)
    return first_n(F.filter(pieces, lambda w: w != ""), most)


def first_ids(
    text: Column,
    n: Column | int,
    most: int,
    conf: C.Tokens = C.Tokens(),
    add_bos: bool | None = None,
) -> Column:
    """``first_n(tokenize(text), n)`` for an n up to ``most``; words behind it are not hashed."""
    if conf.encoder is not None:
        return first_n(tokenize(text, conf, add_bos), n)
    return first_n(word_ids(first_n(first_words(text, most), n), conf, add_bos), n)


def counted_ids(
    text: Column, n: Column | int, conf: C.Tokens = C.Tokens(), add_bos: bool | None = None
) -> Column:
    """Struct of the number of ids (``size``) and the first n of them (``ids``).

    All words are split and counted; those behind the first n are not hashed.
    """
    bos = 1 if (conf.add_bos if add_bos is None else add_bos) else 0
    if conf.encoder is not None:
        made, size, ids = tokenize(text, conf, add_bos), F.size, lambda a: first_n(a, n)
    else:
        made, size = words(text), lambda a: F.size(a) + bos
        ids = lambda a: first_n(word_ids(first_n(a, n), conf, add_bos), n)
    # The array goes through a lambda so that it is made once.
    both = F.transform(F.array(made), lambda a: F.struct(size(a).alias("size"), ids(a).alias("ids")))
    return F.get(both, F.lit(0))


def _word_hasher(vocab_size: int) -> Callable[[pa.Array], np.ndarray]:
    """``word_id`` of the distinct words of a batch; nested, so that it travels with the encoders."""

    def ids_of(found: pa.Array) -> np.ndarray:
        each = found.cast(pa.binary()).to_numpy(zero_copy_only=False)
        digests = b"".join([hashlib.md5(w).digest() for w in each])
        first = np.frombuffer(digests, np.uint8).reshape(-1, 16)[:, :3].astype(np.int32)
        return (first @ np.array([65536, 256, 1], np.int32)) % vocab_size + 3

    return ids_of


def word_encoder(vocab_size: int) -> Callable[[Column], Column]:
    """The word tokenizer over Arrow batches, as an ``encoder`` of ``C.Tokens``.

    The ids are those of ``word_ids`` without bos. A word is hashed once per batch,
    not once per occurrence; the words of a batch are forgotten after it.
    """

    ids_of = _word_hasher(vocab_size)

    @F.arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        pieces = pc.ascii_split_whitespace(text)
        coded = pieces.values.dictionary_encode()
        # Blanks at either end leave an empty piece.
        word = pc.binary_length(pieces.values).to_numpy(zero_copy_only=False) > 0
        ids = ids_of(coded.dictionary)[coded.indices.to_numpy()][word]
        before = np.concatenate([[0], np.cumsum(word)]).astype(np.int32)
        ends = pa.array(before[pieces.offsets.to_numpy()])
        return pa.ListArray.from_arrays(ends, pa.array(ids), mask=text.is_null())

    return encode


def word_list_encoder(vocab_size: int) -> Callable[[Column, int], Column]:
    """The word tokenizer over Arrow batches, as a ``list_encoder`` of ``C.Tokens``.

    Every text of a list becomes its first ``most`` ids without bos; a null text
    stays null. Words behind them are not hashed, the others once per batch. A
    batch is split some hundred lists at a time, which bounds what is held.
    """

    ids_of, at_once = _word_hasher(vocab_size), 500

    def ends(sizes: list[np.ndarray]) -> pa.Array:
        return pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))

    def first_words(flat: pa.Array, most: int) -> tuple[np.ndarray, pa.DictionaryArray]:
        pieces = pc.ascii_split_whitespace(flat)
        # Blanks at either end leave an empty piece.
        at = np.flatnonzero(pc.binary_length(pieces.values).to_numpy(zero_copy_only=False))
        bounds = np.searchsorted(at, pieces.offsets.to_numpy())
        n = np.diff(bounds)
        place = np.arange(len(at)) - np.repeat(bounds[:-1], n)
        kept = pieces.values.take(pa.array(at[place < most]))
        return np.minimum(n, most), kept.dictionary_encode()

    def encode(texts: Column, most: int) -> Column:
        @F.arrow_udf("array<array<int>>")
        def encode_lists(texts: pa.Array) -> pa.Array:
            flat = [texts.slice(i, at_once).flatten() for i in range(0, max(len(texts), 1), at_once)]
            sizes, coded = zip(*[first_words(f, most) for f in flat], strict=True)
            coded = pa.chunked_array(coded).unify_dictionaries()
            id_of = ids_of(coded.chunk(0).dictionary)
            ids = np.concatenate([id_of[c.indices.to_numpy()] for c in coded.chunks])
            nulls = pa.concat_arrays([f.is_null() for f in flat])
            inner = pa.ListArray.from_arrays(ends(sizes), pa.array(ids, pa.int32()), mask=nulls)
            lists = pc.fill_null(pc.list_value_length(texts), 0).to_numpy()
            return pa.ListArray.from_arrays(ends([lists]), inner, mask=texts.is_null())

        return encode_lists(texts)

    return encode


def in_batches(conf: C.Tokens = C.Tokens()) -> C.Tokens:
    """The word tokenizer of ``conf`` with its words hashed over Arrow batches."""
    if conf.encoder is not None:
        raise ValueError("only the word tokenizer has a form over batches")
    return replace(
        conf, encoder=word_encoder(conf.vocab_size), list_encoder=word_list_encoder(conf.vocab_size)
    )


def decode(word_array: Column) -> Column:
    """Text of a word array; specials are not in it."""
    return F.array_join(word_array, " ")


def first_n(arr: Column, n: Column | int | None) -> Column:
    """First n elements; ``None`` keeps all and n below 1 keeps none."""
    if n is None:
        return arr
    n = n if isinstance(n, Column) else F.lit(n)
    return F.slice(arr, F.lit(1), F.greatest(n, F.lit(0)).cast("int"))


def last_n(arr: Column, n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    keep = F.least(F.greatest(n, F.lit(0)), F.size(arr)).cast("int")
    return F.slice(arr, F.size(arr) - keep + 1, keep)


def drop_first(arr: Column, n: Column | int = 1) -> Column:
    return last_n(arr, F.size(arr) - n)


def drop_last(arr: Column, n: Column | int = 1) -> Column:
    return first_n(arr, F.size(arr) - n)


def head_truncate(ids: Column, truncation: int | None) -> Column:
    return first_n(ids, truncation)


def middle_truncate_prompt(prompt: Column, response: Column, truncation: int | None) -> Column:
    """Cut the middle of the prompt so that prompt and response fit.

    Without room for any prompt token the prompt becomes empty.
    """
    if truncation is None:
        return prompt
    room = F.greatest(F.lit(truncation) - F.size(response), F.lit(0))
    head = F.floor(room / 2).cast("int")
    cut = F.concat(first_n(prompt, head), last_n(prompt, room - head))
    return F.when(F.size(prompt) + F.size(response) > truncation, cut).otherwise(prompt)


def length_between(ids: Column, low: int | None, high: int | None) -> Column:
    keep = F.lit(True)
    if low is not None:
        keep = keep & (F.size(ids) >= low)
    if high is not None:
        keep = keep & (F.size(ids) <= high)
    return keep


def mask_all_but_last(ids: Column, kept: Column) -> Column:
    """Labels: the last ``kept`` ids, everything before them ignored."""
    hidden = F.greatest(F.size(ids) - kept, F.lit(0)).cast("int")
    return F.concat(F.array_repeat(F.lit(C.IGNORE), hidden), last_n(ids, kept))


def ends_with(ids: Column, token: int) -> Column:
    return F.coalesce(F.try_element_at(ids, F.lit(-1)) == token, F.lit(False))


# What appending one eos adds to each kind of column.
_EOS_RULES = {
    "input_ids": lambda v: F.array(F.lit(C.EOS)),
    "labels": lambda v: F.array(F.lit(C.EOS)),
    "attention_mask": lambda v: last_n(v, 1),
    "token_type_ids": lambda v: last_n(v, 1),
    "position_ids": lambda v: F.transform(last_n(v, 1), lambda x: x + 1),
}


def append_eos(columns: dict[str, Column]) -> dict[str, Column]:
    """Append eos to parallel columns unless the ids already end with it."""
    unknown = sorted(set(columns) - set(_EOS_RULES))
    if unknown:
        raise ValueError(f"no rule for appending eos to {unknown}")
    done = ends_with(columns["input_ids"], C.EOS)
    return {
        name: F.when(done, col).otherwise(F.concat(col, _EOS_RULES[name](col)))
        for name, col in columns.items()
    }


def remove_first_eos(columns: dict[str, Column], strict: bool = True) -> dict[str, Column]:
    """Delete the position of the first eos from every parallel column."""
    at = F.array_position(columns["input_ids"], C.EOS).cast("int")
    missing = F.raise_error(F.lit("no eos in input_ids")) if strict else None

    def cut(col):
        shorter = F.concat(first_n(col, at - 1), drop_first(col, at))
        if missing is None:
            return F.when(at > 0, shorter).otherwise(col)
        return F.when(at > 0, shorter).otherwise(missing.cast("array<int>"))

    return {name: cut(col) for name, col in columns.items()}


def shift_labels(labels: Column) -> Column:
    """Labels moved one to the left, the last one ignored."""
    moved = F.concat(drop_first(labels), F.array(F.lit(C.IGNORE)))
    return F.when(F.size(labels) > 0, moved).otherwise(labels)


def ignore_masked(labels: Column, mask: Column) -> Column:
    return F.zip_with(labels, mask, lambda y, m: F.when(m == 0, F.lit(C.IGNORE)).otherwise(y))


def replace_value(arr: Column, target: int, value: int = 0, depth: int = 1) -> Column:
    """Replace a value in an array nested ``depth`` levels deep."""
    if depth > 1:
        return F.transform(arr, lambda inner: replace_value(inner, target, value, depth - 1))
    return F.transform(arr, lambda x: F.when(x == target, F.lit(value)).otherwise(x))


def ones(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def zeros(ids: Column) -> Column:
    return F.array_repeat(F.lit(0), F.size(ids))


def total(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, x: a + x)


def valid_labels(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda y: y != C.IGNORE))


def same_length(*arrays: Column) -> Column:
    out = F.lit(True)
    for other in arrays[1:]:
        out = out & (F.size(arrays[0]) == F.size(other))
    return out


def separator(row_id: Column, seed: int = 42) -> Column:
    """One of the three separators, fixed by row and seed."""
    choices = F.array(*[F.lit(s) for s in C.SEPARATORS])
    return F.element_at(choices, (hashing.draw_below(3, row_id, seed, "separator") + 1).cast("int"))


def random_ids(row_id: Column, n: int, vocab_size: int, seed: int = 42) -> Column:
    """n ids uniform in [0, vocab_size - 1), fixed by row, place and seed."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: hashing.draw_below(vocab_size - 1, row_id, i, seed, "random").cast("int"),
    )


def chunk_starts(ids: Column, n: int) -> Column:
    """0-based chunk numbers of an array; empty array for empty input."""
    count = F.ceil(F.size(ids) / n).cast("int")
    return F.when(F.size(ids) > 0, F.sequence(F.lit(0), count - 1)).otherwise(empty_ints())


def chunk_at(arr: Column, index: Column, n: int) -> Column:
    return F.slice(arr, index * n + 1, F.lit(n))


def chunk_arrays(ids: Column, n: int) -> Column:
    """Consecutive slices of n; the last may be short; no slice of nothing."""
    return F.transform(chunk_starts(ids, n), lambda i: chunk_at(ids, i, n))


def adjacent_pairs(chunk: Column) -> Column:
    """(prev, tok) structs of one chunk; a one-token chunk has none."""
    return F.arrays_zip(drop_last(chunk).alias("prev"), drop_first(chunk).alias("tok"))


def pad_to(arr: Column, length: Column, value: int, side: str = "right") -> Column:
    fill = F.array_repeat(F.lit(value), F.greatest(length - F.size(arr), F.lit(0)).cast("int"))
    return F.concat(arr, fill) if side == "right" else F.concat(fill, arr)


def pad_mask(arr: Column, length: Column, side: str = "right") -> Column:
    return pad_to(ones(arr), length, 0, side)


def position_ids_contiguous(mask: Column) -> Column:
    """Running count of ones minus one, 0 where the mask is 0.

    For a mask with one block of ones, as left or right padding makes it.
    """
    first = F.array_position(mask, 1).cast("int")
    return F.transform(mask, lambda m, i: F.when(m == 0, F.lit(0)).otherwise(i + 1 - first))


def longest(nested: Column, depth: int = 2) -> Column:
    """Length of the longest innermost list."""
    if depth <= 1:
        return F.size(nested)
    return F.coalesce(
        F.array_max(F.transform(nested, lambda inner: longest(inner, depth - 1))), F.lit(0)
    )
