"""Near-duplicate groups by min-max hashing, with every link confirmed.

Signature: 64 permutations of a document's shingle set, of which both the
smallest and the largest value are kept: 128 unbiased slots for 64 hash
evaluations per shingle. They are cut into 32 bands of 4; two sets with a
Jaccard similarity of 0.8 share no band with a probability of 5e-8.

Equal sets are one class from the start, so copies never multiply. In a band's
bucket every set is compared with the smallest id; these links are joined into
components. Then only members of different components of one bucket are open.
They meet in blocks of at most ``BLOCK`` members, those outside the bucket's
largest component against all, as short digests of their whole sets: shared
digests are never fewer than shared shingles, so what falls short is settled
there, and only the few pairs that may reach the similarity leave the block.
Nothing is capped. Every link is confirmed on whole texts, read again: a
pivot's texts are streamed beside those of its partners, in blocks, so one
pivot with any number of partners is many tasks, and a task holds one pivot's
set at a time.

Defined cases: null and empty texts have no shingles and no links; a text with
fewer words than a shingle is one shingle; rows that repeat an id are one node
that has the links of each; a null id has no links and stays; extra columns
are ignored (``signatures``) and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import words
from foliant.llm.components import components
from foliant.operators.sizing import settle

PERMUTATIONS = 64
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
SEED = 20240229
BLOCKS = 64
BLOCK = 1024
# Sets up to this size are compared by 16 bits of each shingle, larger ones by 32.
SHORT = 8192

_SIGNATURE = "doc_id bigint, n_shingles bigint, set_id string, bands array<bigint>"


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    top = np.iinfo(np.uint64).max
    factors = rng.integers(0, top, PERMUTATIONS, np.uint64, endpoint=True) | np.uint64(1)
    return factors[:, None], rng.integers(0, top, PERMUTATIONS, np.uint64, endpoint=True)[:, None]


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of a non-empty shingle set."""
    factors, offsets = _permutations()
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for start in range(0, len(shingles), 2048):
        values = factors * shingles[None, start : start + 2048] + offsets
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    slots = np.concatenate([low, high]).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * words.MIX_A
    for j in range(ROWS):
        keys = words.mixed(keys + slots[:, j])
    return keys


def signatures(docs: DataFrame, size: int, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Set size, set identity and band keys of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            counts, sets, bands = [], [], []
            for text in words.texts_of(batch.column(1)):
                found = words.shingles(text, size)
                counts.append(len(found))
                sets.append(xxhash.xxh3_128_hexdigest(found.tobytes()) if len(found) else None)
                bands.append(band_keys(found).view(np.int64) if len(found) else [])
            flat = np.concatenate([np.asarray(b, np.int64) for b in bands])
            ends = np.cumsum([0, *[len(b) for b in bands]])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(sets, pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                ["doc_id", "n_shingles", "set_id", "bands"],
            )

    rows = docs.select(F.col(row_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, _SIGNATURE)


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the similarity."""
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(BLOCKS)).alias("block"))
    needs = dealt.select(F.col("b").alias("doc_id"), "a", "block", F.lit(1).alias("part")).unionByName(
        dealt.select(F.col("a").alias("doc_id"), "a", "block", F.lit(0).alias("part")).distinct()
    )
    rows = needs.join(texts, "doc_id").select("a", "block", "part", "doc_id", "text")
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", "part", "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, sets = None, {}
        for batch in words.slices(batches):
            left, right = [], []
            a, part, b = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for i, text in enumerate(words.texts_of(batch.column(4))):
                if a[i] != pivot:
                    pivot, sets = a[i], {}
                own = words.shingles(text, size)
                if part[i] == 0:
                    sets[own.tobytes() if len(own) < 64 else xxhash.xxh3_128_digest(own.tobytes())] = own
                elif any(_alike(own, other, percent) for other in sets.values()):
                    left.append(a[i])
                    right.append(b[i])
            yield _pair_batch(list(zip(left, right, strict=True)))

    return rows.mapInArrow(compare, "a bigint, b bigint").distinct()


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(x), len(y)))
    if not small or 100 * small < percent * large:
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (small + large - shared)


def _digests(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Each text's set size and the leading bits of its shingles."""
    for batch in words.slices(batches):
        counts, sets = [], []
        for text in words.texts_of(batch.column(1)):
            found = words.shingles(text, size)
            counts.append(len(found))
            kind, bits = (np.uint16, 48) if len(found) <= SHORT else (np.uint32, 32)
            sets.append((found >> np.uint64(bits)).astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(sets, pa.binary())], ["rep", "n", "digests"]
        )


def _leading(digests: bytes, n: int) -> tuple[np.ndarray, np.ndarray | None]:
    """16 bits of each shingle, and 32 bits where they are kept."""
    if n <= SHORT:
        return np.frombuffer(digests, np.uint16), None
    full = np.frombuffer(digests, np.uint32)
    return (full >> np.uint32(16)).astype(np.uint16), full


class _Block:
    """Members of a bucket from outside its largest component, met by all others."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.outside: list[tuple] = []
        self.inside: list[tuple] = []

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Pairs of different components whose digests allow the similarity."""
        if not self.outside or not self.inside:
            return
        reps, parts, sizes = (np.array([m[k] for m in self.inside], np.int64) for k in (0, 1, 2))
        sets = [_leading(m[3], m[2]) for m in self.inside]
        flat = np.concatenate([x for x, _ in sets])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        held = np.zeros(1 << 16, bool)
        for rep, part, n, digests in self.outside:
            short, full = _leading(digests, n)
            held[short] = True
            # Never fewer than the shingles that both have.
            shared = np.minimum(np.add.reduceat(held[flat], starts, dtype=np.int64), np.minimum(sizes, n))
            held[short] = False
            near = (parts != part) & (100 * shared >= self.percent * (sizes + n - shared))
            for k in np.flatnonzero(near).tolist():
                other = sets[k][1]
                if full is not None and other is not None:
                    both = min(int(np.isin(other, full).sum()), n)
                    if 100 * both < self.percent * (n + int(sizes[k]) - both):
                        continue
                yield min(rep, int(reps[k])), max(rep, int(reps[k]))


def _open_pairs(open_: DataFrame, found: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of one bucket that no link joins yet and that may be similar."""
    labelled = open_.select("key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = settle(labelled.withColumn("component", F.coalesce("component", "rep")))
    parts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    # Two sets alone in a bucket have met already.
    mixed = parts.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"),
        F.sum("n").alias("all"),
        F.count(F.lit(1)).alias("parts"),
    )
    mixed = mixed.filter("parts > 1 AND all > 2")
    mixed = settle(mixed.select("key", "main", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks")))
    rows = labelled.join(mixed, "key").withColumn("outside", F.col("component") != F.col("main"))
    rows = settle(rows.drop("main"))
    reps = settle(rows.select("rep").distinct())
    digests = settle(
        texts.withColumnRenamed("doc_id", "rep").join(reps, "rep", "left_semi").mapInArrow(
            lambda batches: _digests(batches, size), "rep bigint, n bigint, digests binary"
        ).filter("n > 0")
    )
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # Block (i, j) has the i-th part of the outside members and the j-th part of all.
    first = rows.filter("outside").select("key", own.alias("i"), every.alias("j"), F.lit(0).alias("side"), "rep", "component")
    second = rows.select("key", every.alias("i"), own.alias("j"), F.lit(1).alias("side"), "rep", "component")
    dealt = settle(first.unionByName(second)).join(digests, "rep")
    dealt = dealt.select("key", "i", "j", "side", "rep", "component", "n", "digests")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, _Block(percent)
        for batch in words.slices(batches):
            pairs: list[tuple[int, int]] = []
            columns = [batch.column(k).to_pylist() for k in range(8)]
            for key, i, j, side, *member in zip(*columns, strict=True):
                if (key, i, j) != at:
                    pairs.extend(block.pairs())
                    at, block = (key, i, j), _Block(percent)
                (block.inside if side else block.outside).append(tuple(member))
            yield _pair_batch(pairs)
        yield _pair_batch(list(block.pairs()))

    return dealt.mapInArrow(meet, "a bigint, b bigint").distinct()


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def groups(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    row_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    signed = settle(signatures(docs, size, row_id, text))
    sets = signed.filter("set_id IS NOT NULL AND doc_id IS NOT NULL")
    classes = settle(sets.groupBy("set_id").agg(F.min("doc_id").alias("rep")))
    first = classes.select("set_id", F.col("rep").alias("doc_id"))
    reps = sets.join(first, ["doc_id", "set_id"]).select("doc_id", "n_shingles", "bands")
    members = reps.select(F.col("doc_id").alias("rep"), "n_shingles", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("last"))
    buckets = settle(buckets.filter("a <> last").drop("last"))
    # Members of buckets with two sets or more; the rest have no partner.
    open_ = settle(members.join(buckets, "key"))
    stars = settle(open_.filter("a <> rep").select("a", F.col("rep").alias("b")).distinct())
    # Only these are read again: one text of each class that shares a bucket.
    texts = docs.select(F.col(row_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    wanted = settle(open_.select(F.col("rep").alias("doc_id")).distinct())
    texts = settle(texts.join(wanted.hint("merge"), "doc_id", "left_semi"))
    links = settle(confirm(stars, texts, size, percent))

    # One id with several texts ties their classes together.
    several = sets.join(classes, "set_id").groupBy("doc_id").agg(
        F.min("rep").alias("a"), F.max("rep").alias("z"), F.collect_set("rep").alias("reps")
    )
    ties = several.filter("a <> z").select("a", F.explode("reps").alias("b"))
    links = settle(links.unionByName(ties))
    found = settle(components(links))

    more = settle(confirm(_open_pairs(open_, found, texts, size, percent), texts, size, percent))
    if not more.isEmpty():
        links = settle(links.unionByName(more))
        found = settle(components(links))

    labels = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    labels = settle(labels.select("set_id", F.coalesce("component", "rep").alias("component_id")))
    out = signed.select("doc_id", "n_shingles", "set_id").join(labels, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def keep_one(
    docs: DataFrame, size: int = 5, percent: int = 80, row_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group.

    Rows without an id all stay. An id that stands for different texts names no text:
    its rows take no part, and those that differ in text all stay. Of rows equal
    in id and text one stays, that with the smallest digest of all its columns.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(row_id).cast("bigint").alias("id"),
        F.xxhash64(body).alias("body"),
        F.col(text).alias("text"),
        F.struct(*docs.columns).alias("row"),
    )
    named = rows.filter(F.col("id").isNotNull())
    texts = named.groupBy("id").agg(F.min("body").alias("a"), F.max("body").alias("z"))
    several = settle(texts.filter("a <> z").select("id"))
    single = named.join(several, "id", "left_anti")
    kept = groups(single.select("id", "text"), size, percent, "id", "text").filter("kept")
    chosen = single.join(kept.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    apart = chosen.unionByName(named.join(several, "id", "left_semi"))
    first = F.min_by("row", F.xxhash64("row")).alias("row")
    left = apart.groupBy("id", "body").agg(first).select("row")
    return left.unionByName(rows.filter(F.col("id").isNull()).select("row")).select("row.*")
