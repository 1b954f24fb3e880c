"""Removal of passages that an earlier document has: suffix automata by anchor.

A window of 50 words is removed where the same words also start in a document
with a smaller id. Broadcasting automata of the whole corpus would grow with
it, so the reference is dealt into shards by content: a window's anchor is the
smallest digest of its 10-word runs, equal windows have equal anchors, and all
stretches of text with one anchor meet in one shard. Anchors of one document
only have no partner and are dropped after counting. Equal stretches are
counted as one before anything moves.

In a shard the stretches come in order of id. Each is streamed through the
suffix automaton of the smaller ids; where the matching statistic reaches 50
words, the window ends there. Then it is added to the automaton. A shard of
more than ``SHARD`` different stretches (a passage with that many different
surroundings) is split by its windows' digests instead, so no shard is large;
windows whose middle words are in one document only are dropped before that.

Defined cases: null and empty texts have no words; texts below 50 words lose
nothing; rows that repeat an id are no reference for each other and are judged
each on their own text; a null id is no reference and loses nothing; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import words
from foliant.operators.sizing import settle

WINDOW = 50
GRAM = 10
STRETCH = 64
SHARD = 256
CORE = 4

_INVERSE = pow(int(words.MIX_A), -1, 1 << 64)


class Powers:
    """Powers of an odd number and of its inverse, for digests of any stretch."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            tail = lambda base: np.cumprod(
                np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)])
            )
            self.up, self.down = tail(words.MIX_A), tail(np.uint64(_INVERSE))
        return self.up, self.down


def stretch_digests(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray, powers: Powers) -> np.ndarray:
    """Digest of ``h[start : start + size]`` for every start."""
    up, down = powers.reach(len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    return words.mixed((sums[starts + sizes] - sums[starts]) * down[starts] + sizes.astype(np.uint64))


def stretches(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of runs of windows with one anchor."""
    low = words.grams(h, GRAM)
    span, reach = WINDOW - GRAM + 1, 1
    while 2 * reach <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    at = np.arange(len(low))
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    since = at - np.maximum.accumulate(np.where(new, at, 0))
    first = at[since % STRETCH == 0]
    return first, np.diff(np.append(first, len(low))), low[first]


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.nxt: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]

    def _split(self, p: int, q: int, c: int) -> int:
        clone = len(self.nxt)
        self.nxt.append(dict(self.nxt[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        while p != -1 and self.nxt[p].get(c) == q:
            self.nxt[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        known = self.nxt[last].get(c)
        if known is not None:
            return known if self.size[known] == self.size[last] + 1 else self._split(last, known, c)
        new = len(self.nxt)
        self.nxt.append({})
        self.link.append(0)
        self.size.append(self.size[last] + 1)
        p = last
        while p != -1 and c not in self.nxt[p]:
            self.nxt[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.nxt[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, c)
        return new

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def matches(self, sequence: list[int], least: int) -> list[int]:
        """Starts of the windows of ``least`` words that the automaton holds."""
        found, state, length = [], 0, 0
        nxt, link, size = self.nxt, self.link, self.size
        for i, c in enumerate(sequence):
            while state and c not in nxt[state]:
                state = link[state]
                length = size[state]
            if c in nxt[state]:
                state = nxt[state][c]
                length += 1
            if length >= least:
                found.append(i - least + 1)
        return found


def _numbers(values, kind=np.int64) -> pa.Array:
    return pa.array(np.concatenate(values).astype(kind, copy=False) if values else np.empty(0, kind))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    names = ["doc_id", "tid", "start", "n", "anchor", "seg"]
    for batch in words.slices(batches):
        out: list[list[np.ndarray]] = [[] for _ in names]
        ids, tids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for doc, tid, text in zip(ids, tids, words.texts_of(batch.column(2)), strict=True):
            h = words.hashes(words.split(text))
            if len(h) < WINDOW:
                continue
            start, n, anchor = stretches(h)
            seg = stretch_digests(h, start, n + (WINDOW - 1), powers)
            made = (np.full(len(n), doc), np.full(len(n), tid), start, n, anchor.view(np.int64), seg.view(np.int64))
            for held, column in zip(out, made, strict=True):
                held.append(column)
        kinds = (np.int64, np.int64, np.int32, np.int32, np.int64, np.int64)
        yield pa.RecordBatch.from_arrays([_numbers(x, k) for x, k in zip(out, kinds, strict=True)], names)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word numbers of the wanted stretches of each text."""
    schema = pa.schema(
        [("anchor", pa.int64()), ("seg", pa.int64()), ("first", pa.int64()), ("size", pa.int64()), ("h", pa.list_(pa.int64()))]
    )
    for batch in words.slices(batches, 64):
        rows: list[dict] = []
        for wanted, text in zip(batch.column(0).to_pylist(), words.texts_of(batch.column(1)), strict=True):
            h = words.hashes(words.split(text)).view(np.int64)
            for w in wanted:
                rows.append(
                    {k: w[k] for k in ("anchor", "seg", "first", "size")}
                    | {"h": h[w["start"] : w["start"] + w["n"] + WINDOW - 1]}
                )
        yield pa.RecordBatch.from_pylist(rows, schema)


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each stretch that stretches of smaller ids in its shard have."""
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("offsets", pa.list_(pa.int32()))])
    shard, doc, automaton, waiting = None, None, Automaton(), []
    for batch in words.slices(batches):
        rows = []
        for row in batch.to_pylist():
            if row["anchor"] != shard:
                shard, doc, automaton, waiting = row["anchor"], row["first"], Automaton(), []
            elif row["first"] != doc:
                for sequence in waiting:
                    automaton.add(sequence)
                doc, waiting = row["first"], []
            rows.append({"anchor": shard, "seg": row["seg"], "offsets": automaton.matches(row["h"], WINDOW)})
            waiting.append(row["h"])
        yield pa.RecordBatch.from_pylist(rows, schema)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of a stretch's windows, a few at a time with the words common to them."""
    powers = Powers()
    schema = pa.schema(
        [(n, pa.int64()) for n in ("anchor", "seg", "first", "core")]
        + [("offset", pa.int32()), ("wins", pa.list_(pa.int64()))]
    )
    for batch in words.slices(batches):
        rows = []
        for row in batch.to_pylist():
            h = np.array(row["h"], np.int64).view(np.uint64)
            at = np.arange(len(h) - WINDOW + 1)
            win = stretch_digests(h, at, np.full(len(at), WINDOW), powers).view(np.int64)
            # Windows are taken together by the place of their anchor, the same in every text.
            anchors = np.flatnonzero(words.grams(h, GRAM).view(np.int64) == row["anchor"])
            place = anchors[np.searchsorted(anchors, at)]
            part = (place - at) // CORE
            new = np.ones(len(at), bool)
            new[1:] = (place[1:] != place[:-1]) | (part[1:] != part[:-1])
            first = np.flatnonzero(new)
            middle = place[first] - part[first] * CORE
            size = np.full(len(first), WINDOW - CORE + 1)
            core = stretch_digests(h, middle, size, powers).view(np.int64)
            same = {k: row[k] for k in ("anchor", "seg", "first")}
            ends = np.append(first[1:], len(at))
            for k, end, c in zip(first.tolist(), ends.tolist(), core.tolist(), strict=True):
                rows.append(same | {"core": c, "offset": k, "wins": win[k:end]})
        yield pa.RecordBatch.from_pylist(rows, schema)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]
    )
    for batch in words.slices(batches):
        rows = []
        cuts = batch.column(2).to_pylist()
        for doc, text, cut in zip(batch.column(0).to_pylist(), words.texts_of(batch.column(1)), cuts, strict=True):
            found = words.split(text)
            change = np.zeros(len(found) + 1, np.int64)
            for c in cut or ():
                if c["offsets"] is None:
                    change[c["start"]] += 1
                    change[c["start"] + c["n"] + WINDOW - 1] -= 1
                else:
                    at = c["start"] + np.asarray(c["offsets"], np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + WINDOW, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = found if not gone.any() else [w for w, g in zip(found, gone.tolist(), strict=True) if not g]
            rows.append((doc, len(found), int(gone.sum()), b" ".join(kept)))
        ids, sizes, removed, texts = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(texts, pa.binary()).cast(pa.string()),
            ],
            schema=schema,
        )


def cuts(texts: DataFrame) -> DataFrame:
    """(doc_id, tid, cuts): what each text loses; ``texts`` has doc_id, tid, text."""
    own = texts.filter("doc_id IS NOT NULL").select("doc_id", "tid", "text")
    anchors = settle(
        own.mapInArrow(_anchors, "doc_id bigint, tid bigint, start int, n int, anchor bigint, seg bigint")
    )
    # Count equal stretches first; an anchor that many share is few rows then.
    segs = anchors.groupBy("anchor", "seg").agg(F.min("doc_id").alias("f"), F.max("doc_id").alias("l"))
    shared = segs.groupBy("anchor").agg(
        F.min("f").alias("f"), F.max("l").alias("l"), F.count(F.lit(1)).alias("size")
    )
    shared = settle(shared.filter("f <> l").select("anchor", "size"))
    rows = settle(anchors.join(shared, "anchor"))
    firsts = rows.groupBy("anchor", "seg").agg(F.min("doc_id").alias("first"))
    rows = settle(rows.join(settle(firsts), ["anchor", "seg"]))

    wanted = rows.filter("size > 1 AND doc_id = first").groupBy("anchor", "seg").agg(
        F.min(F.struct("first", "tid", "start", "n", "size")).alias("w")
    )
    wanted = wanted.select("anchor", "seg", "w.*")
    by_text = wanted.groupBy(F.col("first").alias("doc_id"), "tid").agg(
        F.collect_list(F.struct("anchor", "seg", "first", "size", "start", "n")).alias("wanted")
    )
    content = settle(by_text).join(own, ["doc_id", "tid"])
    content = settle(
        content.select("wanted", "text").mapInArrow(
            _contents, "anchor bigint, seg bigint, first bigint, size bigint, h array<bigint>"
        ).dropDuplicates(["anchor", "seg"])
    )
    small = content.filter(F.col("size") <= SHARD).repartition("anchor")
    masks = small.sortWithinPartitions("anchor", "first", "seg").mapInArrow(
        _matched, "anchor bigint, seg bigint, offsets array<int>"
    )
    parts = settle(
        content.filter(F.col("size") > SHARD).mapInArrow(
            _windows, "anchor bigint, seg bigint, first bigint, core bigint, offset int, wins array<bigint>"
        )
    )
    # Windows whose common words no other document has are settled.
    cores = parts.groupBy("anchor", "core").agg(F.min("first").alias("f"), F.max("first").alias("l"))
    cores = settle(cores.filter("f <> l").select("anchor", "core"))
    windows = settle(
        parts.join(cores, ["anchor", "core"])
        .select("anchor", "seg", "first", "offset", F.posexplode("wins").alias("k", "win"))
        .select("anchor", "seg", "first", (F.col("offset") + F.col("k")).alias("offset"), "win")
    )
    earliest = settle(windows.groupBy("anchor", "win").agg(F.min("first").alias("least")))
    late = windows.join(earliest, ["anchor", "win"]).filter("first > least")
    late = late.groupBy("anchor", "seg").agg(F.collect_list("offset").alias("offsets"))
    masks = settle(masks.filter(F.size("offsets") > 0).unionByName(late))

    whole = rows.filter("doc_id > first").withColumn("offsets", F.lit(None).cast("array<int>"))
    part = rows.filter("doc_id = first AND size > 1").join(masks, ["anchor", "seg"])
    lost = whole.select("doc_id", "tid", "start", "n", "offsets").unionByName(
        part.select("doc_id", "tid", "start", "n", "offsets")
    )
    # Bounded by the length of one text.
    return lost.groupBy("doc_id", "tid").agg(
        F.collect_list(F.struct("start", "n", "offsets")).alias("cuts")
    )


def remove_repeats(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row of ``docs``."""
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(
        F.col(row_id).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("tid"), body.alias("text")
    )
    lost = settle(cuts(texts))
    joined = texts.join(lost, ["doc_id", "tid"], "left")
    return joined.select("doc_id", "text", "cuts").mapInArrow(
        _strip, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"
    )
