"""Hard negatives by threshold joins over inverted indices of vectors.

Vectors have whole-number components; a score is an inner product. An anchor's
positives are the best rows of its label; for each positive the best rows of
other labels count whose score lies in a window below the positive's.

Rows are dealt into blocks by their digest, and every anchor visits every block
(a stated query set against all rows, in blocks). A block is one sorted stretch
of a partition, rows before anchors, so a task holds the rows of one block and
one batch of anchors. In a block, for anchors with thresholds (L2AP's scheme):

* Dimensions are ordered by their weight in the block and taken in groups. Of a
  row, the leading groups are left out of the index as long as the norm of what
  is left out times the anchors' norm there stays below their thresholds: such a
  row cannot reach a threshold by these dimensions alone. The list of a group
  names the rows that are indexed in it.
* Lists are read from the last group to the first, adding up partial scores.
  After each, a pair stays only if its partial score and the product of the
  remaining norms reach the threshold. When few pairs are left, they are
  followed one by one.
* The left-out dimensions of surviving pairs are added exactly.

Thresholds fall until windows fill: a pilot over one block's share of rows lowers
each anchor's threshold from half of what is possible (``LADDER``) until the block
fills its windows. The last score that filled a window is a lower bound of what
counts, so the pass over all blocks starts from it; a window that the pilot did
not fill keeps its own lower end. A block returns the best few of each window at
most, which is all that the whole can need of it.

A positive with a score below 0 has an empty window, so positives are searched
down to 0 only.

Shuffled are all rows once per pass, and every anchor once per block; a block
holds ``BLOCK`` components (and there is a block for each shuffle partition at
least).

Defined cases: rows with a null label, a null vector, or any null, NaN or infinite
component take no part, nor rows whose squared length reaches 4e18, as scores may
then exceed a BIGINT. Vectors of different lengths have no score and do not meet;
empty ones score 0. A null id is no anchor and sorts last among equal scores.
Rows with the anchor's id are the anchor, whatever they hold; anchors that repeat
an id with different contents are served one by one; partners equal in id and
score count once. An empty table gives an empty table; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.sizing import settle

SCALE = 256
BLOCK = 1 << 20
POSITIVES = 5
NEGATIVES = 5
LOW_PERCENT = 80
HIGH_PERCENT = 100
GROUP = 16
ASKS = 256
LADDER = (0.5, 0.25, 0.12, 0.0)
VERIFIED_AT_ONCE = 1 << 16
_LARGEST = 4.0e18
_EXACT = float(1 << 52)
_TOP = 1 << 62

_FOUND = "anchor_id bigint, twin bigint, k int, id bigint, score bigint"
_STREAM = ("block", "kind", "id", "twin", "label", "c", "ks", "lows", "highs")


def whole_vectors(
    rows: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label"
) -> DataFrame:
    """Id, label and components as whole numbers, of rows that take part."""
    label = F.col(label) if isinstance(label, str) else label
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE))
    length = F.aggregate(
        F.col(vector),
        F.lit(0.0),
        lambda total, x: total + F.pow(F.floor(x.cast("double") * SCALE).cast("double"), 2.0),
    )
    # Null components give null, infinite ones and NaN nothing below the bound.
    taken = rows.filter(label.isNotNull() & F.forall(vector, lambda x: F.abs(x.cast("double")) < 1e9))
    taken = taken.filter(length < _LARGEST)
    return taken.select(
        F.col(row_id).cast("bigint").alias("id"),
        label.cast("bigint").alias("label"),
        scaled.cast("array<int>").alias("c"),
    )


class Index:
    """Rows of one length (and one label, if that matters) with prefix norms by groups."""

    def __init__(self, matrix: np.ndarray, ids: np.ndarray, nulls: np.ndarray, labels: np.ndarray):
        self.ids, self.nulls, self.labels = ids, nulls, labels
        self.whole = matrix
        self.order = np.argsort((matrix.astype(float) ** 2).sum(axis=0), kind="stable")
        self.sorted = matrix[:, self.order].astype(float)
        self.edges = [*range(0, matrix.shape[1], GROUP), matrix.shape[1]]
        self.norms = self._norms(self.sorted)

    def _norms(self, m: np.ndarray) -> np.ndarray:
        """Norm of what lies before each edge."""
        square = np.zeros((len(m), m.shape[1] + 1))
        np.cumsum(m**2, axis=1, out=square[:, 1:])
        return np.sqrt(square[:, self.edges])

    def search(self, asks: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs (ask, row, score) with a score of at least the ask's threshold."""
        q = asks[:, self.order].astype(float)
        qn, n = self._norms(q), self.norms
        groups = len(self.edges) - 1
        most = qn[:, -1].max(initial=0) * n[:, -1].max(initial=0)
        need = least - 0.5 - 1e-9 * most
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(need[:, None] > 0, qn / need[:, None], np.inf).max(axis=0)
            left_out = (n * reach < 1 - 1e-9)[:, 1:]
        start = left_out.sum(axis=1)
        rows = np.argsort(start, kind="stable")
        listed = np.searchsorted(start[rows], np.arange(groups + 1), side="right")
        scores = np.zeros((len(q), int(listed[groups - 1]) if groups else len(rows)))
        pairs, done = None, []
        if not groups:  # empty vectors score 0
            done.append((*np.nonzero(scores >= need[:, None]), np.empty(0)))
        for k in range(groups - 1, -1, -1):
            part = slice(self.edges[k], self.edges[k + 1])
            if pairs is not None:
                i, j, s = pairs
                more = start[j] <= k
                s[more] += np.einsum("ij,ij->i", q[i[more], part], self.sorted[j[more], part])
                fits = ~more | (s + qn[i, k] * n[j, k] >= need[i])
                pairs = (i[fits], j[fits], s[fits])
                continue
            here, below = int(listed[k]), int(listed[k - 1]) if k else 0
            own = rows[:here]
            scores[:, :here] += q[:, part] @ self.sorted[own, part].T
            fits = scores[:, :here] + qn[:, k, None] * n[own, k] >= need[:, None]
            i, j = np.nonzero(fits[:, below:])
            done.append((i, own[j + below], scores[i, j + below]))
            if k and 8 * np.count_nonzero(fits[:, :below]) <= fits[:, :below].size:
                i, j = np.nonzero(fits[:, :below])
                pairs = (i, own[j], scores[i, j])
        if pairs is not None:
            done.append(pairs)
        i, j = (np.concatenate([d[x] for d in done]) for x in (0, 1))
        if groups and most < _EXACT:
            exact = np.concatenate([d[2] for d in done]).astype(np.int64)
            partial = np.flatnonzero(start[j] > 0)
        else:
            exact, partial = np.zeros(len(i), np.int64), np.arange(len(i))
        for at in np.split(partial, range(VERIFIED_AT_ONCE, len(partial), VERIFIED_AT_ONCE)):
            exact[at] = np.einsum("ij,ij->i", asks[i[at]], self.whole[j[at]])
        fits = exact >= least[i]
        return i[fits], j[fits], exact[fits]


class Block:
    """The indices of a block's rows: by length, and by label for searches within one."""

    def __init__(self, columns: dict[str, np.ndarray], within: bool):
        lengths = columns["lengths"]
        ends = np.cumsum(lengths)
        self.parts: dict[tuple, Index] = {}
        keys = np.stack([lengths, columns["label"] if within else np.zeros_like(lengths)], axis=1)
        kinds, member = np.unique(keys, axis=0, return_inverse=True)
        for number, (length, label) in enumerate(kinds.tolist()):
            rows = np.flatnonzero(member.ravel() == number)
            at = (ends[rows] - length)[:, None] + np.arange(length)
            own = [columns[name][rows] for name in ("id", "null", "label")]
            self.parts[length, label] = Index(columns["flat"][at].reshape(len(rows), length), *own)


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns of a batch as arrays; vectors as one flat array and lengths."""
    ids = batch.column("id")
    vectors = batch.column("c")
    return {
        "id": ids.fill_null(0).to_numpy(zero_copy_only=False),
        "null": ids.is_null().to_numpy(zero_copy_only=False),
        "label": batch.column("label").to_numpy(zero_copy_only=False),
        "lengths": vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
        "flat": vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
    }


def best(
    index: Index,
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray],
    low: np.ndarray,
    high: np.ndarray,
    most: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``most`` pairs of each ask inside its bounds, equal rows once."""
    i, j, s = pairs
    inside = (s >= low[i]) & (s <= high[i])
    i, j, s = i[inside], j[inside], s[inside]
    order = np.lexsort((index.ids[j], index.nulls[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (s[1:] != s[:-1])
    for own in (index.ids[j], index.nulls[j]):
        new[1:] |= own[1:] != own[:-1]
    i, j, s = i[new], j[new], s[new]
    first = np.searchsorted(i, i, side="left")
    kept = np.arange(len(i)) - first < most
    return i[kept], j[kept], s[kept]


def _answer(
    index: Index, asks: dict[str, np.ndarray], within: bool, most: int, ladder: tuple[float, ...]
) -> Iterator[tuple[np.ndarray, ...]]:
    """Ask number, window, row and score of the best rows of each window."""
    vectors, lows, highs = asks["vectors"], asks["lows"], asks["highs"]
    open_ = np.arange(len(vectors))
    for turn, share in enumerate(ladder):
        if not len(open_):
            return
        top = index.norms[:, -1].max(initial=0) * np.sqrt((vectors[open_].astype(float) ** 2).sum(axis=1))
        ends = np.minimum(highs[open_], np.ceil(top)[:, None].astype(np.int64))
        bound = lows[open_] + np.maximum(0, np.ceil(share * (ends - lows[open_]))).astype(np.int64)
        i, j, s = index.search(vectors[open_], bound.min(axis=1))
        apart = (index.ids[j] != asks["id"][open_][i]) | index.nulls[j]
        if not within:
            apart &= index.labels[j] != asks["label"][open_][i]
        pairs = (i[apart], j[apart], s[apart])
        found, filled = [], np.ones(len(open_), bool)
        for k in range(lows.shape[1]):
            i, j, s = best(index, pairs, bound[:, k], highs[open_, k], most)
            found.append((i, np.full(len(i), k), j, s))
            filled &= (np.bincount(i, minlength=len(open_)) >= most) | (bound[:, k] <= lows[open_, k])
        last = turn == len(ladder) - 1
        for i, k, j, s in found:
            ready = filled[i] | last
            yield open_[i[ready]], k[ready], j[ready], s[ready]
        open_ = open_[~filled]


def _scan(within: bool, most: int, ladder: tuple[float, ...]):
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in _FOUND.split(", ")]
        block: int | None = None
        held: list[dict[str, np.ndarray]] = []
        index: Block | None = None
        for batch in batches:
            key = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("block", "kind")])
            turns = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            edges = [0, *turns.tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:], strict=False):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if key[0, low] != block:
                    block, held, index = int(key[0, low]), [], None
                if key[1, low] == 0:
                    held.append(_columns(part))
                    continue
                if not held:
                    continue
                if index is None:
                    rows = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
                    index = Block(rows, within)
                for at in range(0, part.num_rows, ASKS):
                    found = _served(index, part.slice(at, ASKS), within, most, ladder)
                    if len(found[0]):
                        id_ = pa.array(found[3], pa.int64(), mask=found[5])
                        columns = [*(pa.array(x) for x in found[:2]), pa.array(found[2], pa.int32())]
                        yield pa.RecordBatch.from_arrays([*columns, id_, pa.array(found[4])], names)

    return visit


def _served(
    block: Block, batch: pa.RecordBatch, within: bool, most: int, ladder: tuple[float, ...]
) -> list[np.ndarray]:
    """Anchor id, twin, window, row id, score and whether the id is null."""
    asked = _columns(batch)
    twin = batch.column("twin").to_numpy(zero_copy_only=False)
    windows = batch.column("lows").value_lengths().to_numpy(zero_copy_only=False)
    listed = {n: batch.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("ks", "lows", "highs")}
    begins = np.cumsum(windows) - windows
    ends = np.cumsum(asked["lengths"])
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(5)] + [[np.empty(0, bool)]]
    label = asked["label"] if within else np.zeros_like(asked["label"])
    keys = np.stack([asked["lengths"], label, windows], axis=1)
    kinds, member = np.unique(keys, axis=0, return_inverse=True)
    for number, (length, own, width) in enumerate(kinds.tolist()):
        index = block.parts.get((length, own))
        if index is None or not width:
            continue
        rows = np.flatnonzero(member.ravel() == number)
        at = (ends[rows] - length)[:, None] + np.arange(length)
        window = begins[rows][:, None] + np.arange(width)
        vectors = asked["flat"][at].reshape(len(rows), length)
        asks = {"vectors": vectors, "id": asked["id"][rows], "label": asked["label"][rows]}
        asks |= {n: listed[n][window].astype(np.int64) for n in ("lows", "highs")}
        for i, k, j, s in _answer(index, asks, within, most, ladder):
            found = (asked["id"][rows][i], twin[rows][i], listed["ks"][window[i, k]], index.ids[j], s, index.nulls[j])
            for column, values in zip(out, found, strict=True):
                column.append(values)
    return [np.concatenate(x) for x in out]


def _pass(
    rows: DataFrame, asks: DataFrame, within: bool, most: int, ladder: tuple[float, ...]
) -> DataFrame:
    """Bring rows and asks of a block together, rows first, and search."""
    rows = rows.withColumn("kind", F.lit(0)).withColumn("twin", F.lit(None).cast("bigint"))
    for name in ("ks", "lows", "highs"):
        rows = rows.withColumn(name, F.lit(None).cast("array<int>" if name == "ks" else "array<bigint>"))
    both = rows.select(*_STREAM).unionByName(asks.withColumn("kind", F.lit(1)).select(*_STREAM))
    dealt = both.repartition("block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(_scan(within, most, ladder), _FOUND)


def _first(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each window over all blocks, with their rank."""
    order = Window.partitionBy("anchor_id", "twin", "k").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= most)
    return ranked.dropDuplicates(["anchor_id", "twin", "k", "place"])


def _windows(asks: DataFrame) -> DataFrame:
    """One row per anchor with arrays of its windows."""
    parts = F.sort_array(F.collect_list(F.struct("k", "low", "high")))
    grouped = asks.groupBy("anchor_id", "twin").agg(parts.alias("w"))
    return grouped.select("anchor_id", "twin", *[F.col("w")[a].alias(b) for a, b in zip(
        ("k", "low", "high"), ("ks", "lows", "highs"), strict=True)])


def _threshold_join(
    rows: DataFrame, anchors: DataFrame, windows: DataFrame, blocks: int, within: bool, most: int
) -> DataFrame:
    """The best rows of every window: a pilot for the thresholds, then all blocks."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = anchors.withColumnRenamed("id", "anchor_id")

    def asked(w: DataFrame, block: Column) -> DataFrame:
        joined = named.join(_windows(w), ["anchor_id", "twin"]).withColumnRenamed("anchor_id", "id")
        return joined.withColumn("block", block)

    sample = rows.filter(F.col("block") == 0)
    sample = sample.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pilot = _pass(
        sample, asked(windows, F.pmod(F.xxhash64("id", "twin"), F.lit(parts)).cast("int")), within, most, LADDER
    )
    floors = pilot.groupBy("anchor_id", "twin", "k").agg(
        F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")
    )
    floors = floors.filter(F.col("n") >= most).drop("n")
    raised = windows.join(floors, ["anchor_id", "twin", "k"], "left").select(
        "anchor_id", "twin", "k", F.greatest("low", F.coalesce("floor", "low")).alias("low"), "high"
    )
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    return _first(_pass(rows, asked(settle(raised), everywhere), within, most, (0.0,)), most)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
    block: int = BLOCK,
) -> DataFrame:
    """Hard negatives of every anchor and positive, from rows of ``whole_vectors``.

    ``is_anchor`` chooses the anchors by ``id``. A negative's score lies between
    the two percentages of the positive's.
    """
    spark = vectors.sparkSession
    total = vectors.agg(F.sum(F.greatest(F.size("c"), F.lit(1)))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parts, -(-total // block))
    rows = vectors.withColumn("block", F.pmod(F.xxhash64("id", "label", "c"), F.lit(blocks)).cast("int"))
    anchors = vectors.filter(is_anchor & F.col("id").isNotNull())
    anchors = settle(anchors.withColumn("twin", F.xxhash64("label", "c")).dropDuplicates(["id", "twin"]))

    key = [F.col("id").alias("anchor_id"), "twin"]
    everything = anchors.select(
        *key, F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("low"), F.lit(_TOP).alias("high")
    )
    found = _threshold_join(rows, anchors, everything, blocks, True, positives)
    chosen = settle(
        found.select("anchor_id", "twin", F.col("place").alias("k"), "id", "score").withColumnsRenamed(
            {"id": "positive_id", "score": "positive_score"}
        )
    )
    p = F.col("positive_score")
    windows = chosen.select(
        "anchor_id",
        "twin",
        "k",
        # In two parts, as the product may exceed a BIGINT.
        F.expr(
            f"positive_score div 100 * {low_percent} + (positive_score % 100 * {low_percent} + 99) div 100"
        ).alias("low"),
        F.expr(
            f"positive_score div 100 * {high_percent} + positive_score % 100 * {high_percent} div 100"
        ).alias("high"),
    )
    hard = _threshold_join(rows, anchors, windows, blocks, False, negatives)
    return hard.join(chosen, ["anchor_id", "twin", "k"]).select(
        "anchor_id",
        "positive_id",
        F.col("place").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        p,
        F.col("score").alias("negative_score"),
    )
