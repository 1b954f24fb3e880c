"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

1. **Targets.** Sources have weights and share the words of all documents by
   them. A target stops at ``MOST`` times its source's words; the excess is shared
   again by weight until none is above.
2. **Streams and blocks.** A source's documents are ordered by a digest; their words,
   repeated as often as the target needs, are the source's stream, cut into blocks of
   equal length. A document belongs to the block its first word is in; the last
   document a target takes is cut at the target. A repetition reads the same order
   again, so a block lies in one repetition or across the border of two.
3. **Splitting tree.** The blocks of all sources are dealt to output shards as if
   drawn without replacement, but by counts: a node of the tree halves its shards,
   and the left half's count of each source is a hypergeometric draw given what
   is left of the node and of its sources. Every node's counts add up to its
   quota, so shards differ by one block at most and sources lose none. Draws invert
   the distribution from a digest's uniform number; its tails beyond twelve standard
   deviations, below any double's precision, are left out.
4. **Disjoint permuted blocks.** A source's blocks are put in the order of a digest;
   the shards take consecutive stretches of it, as long as their quotas. Inside a
   shard, blocks follow in that order across sources, documents of a block in the
   order of a digest of document and repetition: a sort within the shard's files.

Running totals of words go by (source, bucket of the digest): 4,096 buckets a
source, so a source with a third of all rows is as even as others. Documents meet
the plan by broadcasts of proven size: one row a source (``MOST_SOURCES`` at most,
checked) and one row a block (``BLOCKS`` plus one a source at most). The tree has one
row a shard with one number a source.

Only DataFrame functions are used.

Defined cases: a null text has no words; documents without words are never drawn; a
null source is a source of its own, the last; documents without an id are ordered by
their text; rows that repeat an id count each, and equal rows change places freely;
a source without words has the target 0; an empty table gives an empty table; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.hashing import digest, hex_to_long
from foliant.operators.once import with_once
from foliant.operators.sizing import settle

WEIGHTS = (1, 2, 3)
MOST = 3
SHARDS = 32
BLOCKS = 65_536
LEAST_BLOCK = 4096
MOST_SOURCES = 4096
SEED = 42
_BUCKET_DIGITS = 3
_TAIL = 12
_WORD = r"[^\x20\x09-\x0D]+"


def facts(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED
) -> DataFrame:
    """Id, source, number of words, and the digest that orders a source."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.coalesce(F.col(row_id).cast("string"), F.md5(body.cast("binary")))
    return docs.select(
        F.col(row_id).cast("bigint").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.regexp_count(body, F.lit(_WORD)).cast("bigint").alias("size"),
        digest(key, seed).alias("digest"),
        F.xxhash64(body).alias("twin"),
    )


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row a source: number, ``source_size``, ``target`` and ``quota`` in words.

    ``sizes`` has a row a source: ``source`` and ``source_size``.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    numbered = sizes.withColumn("number", F.row_number().over(by_name) - 1)
    listed = F.array(*[F.lit(int(w)).cast("bigint") for w in weights])
    weighed = numbered.withColumns(
        {
            "weight": F.get(listed, F.col("number") % len(weights)),
            "total": F.sum("source_size").over(everything),
            "most": F.col("source_size") * most,
        }
    )
    # In the order in which a rising level meets the bounds; who is met stays at its bound.
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    earlier, later = (
        rising.rowsBetween(Window.unboundedPreceding, -1),
        rising.rowsBetween(Window.currentRow, Window.unboundedFollowing),
    )
    level = weighed.withColumns(
        {
            "left": F.col("total") - F.coalesce(F.sum("most").over(earlier), F.lit(0)),
            "sharing": F.sum("weight").over(later),
        }
    )
    met = F.col("most") * F.col("sharing") <= F.col("weight") * F.col("left")
    # Of those never met, the first one's level holds for all.
    level = level.withColumn("met", met)
    first = F.when(~F.col("met"), F.struct("number", "left", "sharing"))
    level = level.withColumn("open", F.first(first, ignorenulls=True).over(
        rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = (F.col("weight") * F.col("open.left")).cast("double") / F.col("open.sharing").cast("double")
    target = F.when(F.col("met"), F.col("most").cast("double")).otherwise(share)
    return level.select("source", "number", "source_size", target.alias("target")).withColumn(
        "quota", F.floor(F.col("target") + 0.5).cast("bigint")
    )


def hypergeometric(balls: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` balls are marked, by inversion; all but ``uniform`` are BIGINT."""
    n, k, d = (c.cast("double") for c in (balls, marked, drawn))
    mean = d * k / F.greatest(n, F.lit(1.0))
    spread = F.sqrt(
        F.greatest(
            mean * (1 - k / F.greatest(n, F.lit(1.0))) * (n - d) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)
        )
    )
    low = F.greatest(
        F.lit(0).cast("bigint"), drawn + marked - balls, F.floor(mean - _TAIL * spread - _TAIL).cast("bigint")
    )
    high = F.least(drawn, marked, F.ceil(mean + _TAIL * spread + _TAIL).cast("bigint"))
    steps = F.sequence(low, high - 1)

    def grown(weight: Column, x: Column) -> Column:
        """Weight of ``x + 1`` from the weight of ``x``."""
        x = x.cast("double")
        return weight * (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))

    total = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum")),
        lambda a, x: F.struct(grown(a["w"], x).alias("w"), (a["sum"] + grown(a["w"], x)).alias("sum")),
        lambda a: a["sum"],
    )
    # The goal travels along, or every step would sum the weights again.
    found = F.aggregate(
        steps,
        F.struct(
            F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), low.alias("x"), (uniform * total).alias("goal")
        ),
        lambda a, x: F.struct(
            grown(a["w"], x).alias("w"),
            (a["sum"] + grown(a["w"], x)).alias("sum"),
            F.when(a["sum"] < a["goal"], x + 1).otherwise(a["x"]).alias("x"),
            a["goal"].alias("goal"),
        ),
        lambda a: a["x"],
    )
    return F.when(low >= high, low).otherwise(found)


def _uniform(*parts: Column | int) -> Column:
    return hex_to_long(digest(*parts), 13).cast("double") / float(16**13)


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Counts of blocks by shard and source: ``shard``, ``number``, ``blocks``.

    ``quotas`` has one row a source: ``number`` (0, 1, ...) and ``blocks``.
    """
    by_number = F.sort_array(F.collect_list(F.struct("number", "blocks")))
    nodes = quotas.groupBy().agg(by_number.alias("listed"))
    nodes = nodes.select(
        F.lit(0).alias("begin"), F.lit(shards).alias("end"), F.col("listed.blocks").alias("counts")
    ).filter(F.col("counts").isNotNull())
    width = shards
    while width > 1:
        half = F.expr("(end - begin) div 2")
        total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)
        nodes = with_once(nodes, {"half": half, "total": total})
        wanted = F.expr("total * half div greatest(end - begin, 1)")

        def draw(a: Column, c: Column) -> Column:
            u = _uniform(F.col("begin"), F.col("end"), F.size(a["left"]), seed)
            x = hypergeometric(a["balls"], c, a["wanted"], u)
            # One draw, used three times.
            return F.get(
                F.transform(
                    F.array(x),
                    lambda y: F.struct(
                        (a["balls"] - c).alias("balls"),
                        (a["wanted"] - y).alias("wanted"),
                        F.concat(a["left"], F.array(y)).alias("left"),
                    ),
                ),
                0,
            )

        start = F.struct(
            F.col("total").alias("balls"),
            wanted.cast("bigint").alias("wanted"),
            F.array().cast("array<bigint>").alias("left"),
        )
        left = F.aggregate("counts", start, draw, lambda a: a["left"])
        nodes = with_once(nodes, {"left": left})
        right = F.zip_with("counts", "left", lambda c, x: c - x)
        cut = F.col("begin") + F.col("half")
        halves = F.array(
            F.struct(F.col("begin"), cut.alias("end"), F.col("left").alias("counts")),
            F.struct(cut.alias("begin"), F.col("end"), right.alias("counts")),
        )
        nodes = nodes.select(F.inline(halves)).filter("end > begin")
        width = -(-width // 2)
    return nodes.select(F.col("begin").alias("shard"), F.posexplode("counts").alias("number", "blocks"))


def block_plan(
    sources: DataFrame, block: int, shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """Shard and place of every block: ``number``, ``block``, ``shard``, ``place``."""
    quotas = sources.select("number", F.expr(f"(quota + {block - 1}) div {block}").alias("blocks"))
    leaves = splitting_tree(quotas, shards, seed).filter("blocks > 0")
    along = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    leaves = leaves.withColumn("begin", F.coalesce(F.sum("blocks").over(along), F.lit(0)))
    taken = leaves.select(
        "number", "shard", F.explode(F.expr("sequence(begin, begin + blocks - 1)")).alias("place")
    )
    blocks = quotas.filter("blocks > 0").select(
        "number", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block")
    )
    order = Window.partitionBy("number").orderBy(digest(F.col("number"), F.col("block"), seed), "block")
    permuted = blocks.withColumn("place", (F.row_number().over(order) - 1).cast("bigint"))
    return permuted.join(taken, ["number", "place"]).select("number", "block", "shard", "place")


def mix(
    docs: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """One row a document with its draws.

    Columns: ``doc_id``, ``twin`` (digest of the text), ``source``, ``size``,
    ``source_size``, ``target`` (of the source) and ``draws``, an array of up to
    ``most`` structs: ``turn`` (repetition), ``words`` (taken, less than the size only
    where a target ends), ``shard`` and ``place`` (order of the block within its shard).
    """
    own = settle(facts(docs, row_id, text, source, seed))
    own = own.withColumn("bucket", F.substring("digest", 1, _BUCKET_DIGITS))
    totals = settle(own.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sizes = totals.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = settle(targets(sizes, weights, most))
    count, words = sources.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    if count > MOST_SOURCES:
        raise ValueError(f"{count} sources; at most {MOST_SOURCES} are mixed")
    block = max(LEAST_BLOCK, -(-(words or 0) // BLOCKS))
    plan = settle(block_plan(sources, block, shards, seed))

    known = F.broadcast(sources.withColumnRenamed("source", "named"))
    is_named = F.col("source").eqNullSafe(F.col("named"))
    earlier = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.join(known, is_named).select(
        "number", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("number", "bucket").orderBy("digest", "doc_id", "size", "twin")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = own.join(known, is_named).withColumn("before", before)
    placed = placed.join(offsets, ["number", "bucket"])
    placed = placed.withColumn("begin", F.col("offset") + F.col("before"))
    for turn in range(most):
        at = F.col("begin") + turn * F.col("source_size")
        words_taken = F.least(F.col("size"), F.col("quota") - at)
        placed = placed.withColumn(f"words{turn}", words_taken)
        # No key, no draw: documents without words and those behind the target.
        key = F.when((F.col("size") > 0) & (at < F.col("quota")), F.floor(at / block))
        placed = placed.withColumn(f"block{turn}", key.cast("bigint"))
        own_plan = F.broadcast(
            plan.select(
                F.col("number").alias(f"number{turn}"),
                F.col("block").alias(f"b{turn}"),
                F.col("shard").alias(f"shard{turn}"),
                F.col("place").alias(f"place{turn}"),
            )
        )
        on = (F.col("number") == F.col(f"number{turn}")) & (F.col(f"block{turn}") == F.col(f"b{turn}"))
        placed = placed.join(own_plan, on, "left")
    drawn = [
        F.when(
            F.col(f"shard{t}").isNotNull(),
            F.struct(
                F.lit(t).alias("turn"),
                F.col(f"words{t}").alias("words"),
                F.col(f"shard{t}").alias("shard"),
                F.col(f"place{t}").alias("place"),
            ),
        )
        for t in range(most)
    ]
    return placed.select(
        "doc_id", "twin", "source", "size", "source_size", "target", F.array_compact(F.array(*drawn)).alias("draws")
    )


def taken_words(draws: str = "draws") -> Column:
    """Words taken of a document, repeats counted."""
    return F.aggregate(draws, F.lit(0).cast("bigint"), lambda a, d: a + d["words"])


def write_shards(
    docs: DataFrame, mixed: DataFrame, folder: str, row_id: str = "doc_id", text: str = "text", seed: int = SEED
) -> None:
    """Texts of all draws, in one folder a shard, shuffled locally.

    Files of a shard hold consecutive places; inside a place the order is that of a
    digest of document and repetition. Columns: ``place``, ``doc_id``, ``turn``, ``words``
    (how many of the text's words count), ``text``.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(
        F.col(row_id).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("twin"), body.alias("text")
    )
    # Equal rows have one text; each of them has draws of its own.
    texts = texts.groupBy(F.col("doc_id").alias("text_id"), F.col("twin").alias("text_twin")).agg(
        F.first("text").alias("text")
    )
    draws = mixed.select("doc_id", "twin", F.inline("draws"))
    joined = draws.join(
        texts, F.col("doc_id").eqNullSafe(F.col("text_id")) & (F.col("twin") == F.col("text_twin"))
    )
    local = digest(F.coalesce(F.col("doc_id").cast("string"), F.col("twin").cast("string")), F.col("turn"), seed)
    (
        joined.withColumn("local", local)
        .repartitionByRange("shard", "place")
        .sortWithinPartitions("shard", "place", "local")
        .select("shard", "place", "doc_id", "turn", "words", "text")
        .write.partitionBy("shard")
        .parquet(folder)
    )
