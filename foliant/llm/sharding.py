"""Even shards that keep linked documents together: balanced label propagation.

Documents that share a link key (by default: equal texts) are linked. They
start in the shard of their id's digest. In each round every link key counts
its members per shard, its members vote for the shard that has most of them,
and members elsewhere move there as far as that shard's quota for linked rows
goes. Keys with more members than a quarter of a shard are first cut into parts
by the digest of the ids; as many parts as a shard holds follow the key's first
choice, the next ones its second, so a key that is larger than a shard fills
few shards and is never one task.

After the rounds the shards are made exactly even: ``rows`` counts differ by
one at most. Rows are numbered within (shard, linked or not, digest block);
what lies beyond a shard's size, unlinked rows first, fills the others, and
the same numbers give the gapless slots. No window sees more than one block,
and what is broadcast has at most ``2 * BLOCKS`` rows per shard.

Only DataFrame functions are used.

Defined cases: a null text has no bytes, checksum 0, and counts as equal to
other null or empty texts; rows that repeat an id each get a slot of their
own; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.sizing import settle

SHARDS = 24
ROUNDS = 6
BLOCKS = 1024
ADMISSION = 4096
PARTS_PER_SHARD = 4


def facts(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, size in bytes plus 8, checksum and the key of equal texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(row_id).alias("doc_id"),
        (F.octet_length(body).cast("bigint") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.md5(body.cast("binary")).alias("link"),
    )


def _digest(*parts: Column | str, modulus: int) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(modulus)).cast("int")


def _split_keys(nodes: DataFrame, shards: int, total: int) -> DataFrame:
    """Link keys with two members or more, and parts of large ones; else null."""
    most = max(1, total // (shards * PARTS_PER_SHARD))
    keys = nodes.filter("link IS NOT NULL").groupBy("link").agg(F.count(F.lit(1)).alias("n"))
    keys = keys.filter("n > 1").select("link", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    joined = nodes.join(settle(keys), "link", "left")
    part = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.col("parts")).cast("int")
    return joined.withColumns(
        {"link": F.when(F.col("parts").isNotNull(), F.col("link")), "part": part}
    ).drop("parts")


def propagate(state: DataFrame, shards: int, total: int, rounds: int = ROUNDS) -> DataFrame:
    """Move members of a link key to the shards that most of them are in."""
    room = total // shards
    for turn in range(rounds):
        votes = settle(
            state.filter("link IS NOT NULL")
            .groupBy("link", "part", "shard")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        # A key's choices: at most one row per shard.
        choice = Window.partitionBy("link").orderBy(F.desc("n"), F.xxhash64("link", "shard", F.lit(turn)))
        choices = votes.groupBy("link", "shard").agg(F.sum("n").alias("n"))
        choices = choices.select(
            "link", F.col("shard").alias("goal"), (F.row_number().over(choice) - 1).alias("place")
        )
        place = F.floor(F.col("part") / PARTS_PER_SHARD).cast("int").alias("place")
        wishes = settle(
            votes.select("link", "part", "shard", "n", place)
            .join(choices, ["link", "place"])
            .withColumn("bucket", _digest("link", "part", F.lit(turn), modulus=ADMISSION))
        )
        stay = wishes.filter("shard = goal").groupBy("goal").agg(F.sum("n").alias("stay"))
        stay = {r["goal"]: r["stay"] for r in stay.collect()}
        quotas = [max(0, room - stay.get(s, 0)) for s in range(shards)]
        # At most ADMISSION rows per shard in this window.
        so_far = Window.partitionBy("goal").orderBy("bucket")
        admitted = (
            wishes.filter("shard <> goal")
            .groupBy("goal", "bucket")
            .agg(F.sum("n").alias("n"))
            .withColumn("upto", F.sum("n").over(so_far))
            .filter(F.col("upto") <= _by_shard(F.col("goal"), quotas))
            .select("goal", "bucket")
        )
        moves = settle(
            wishes.filter("shard <> goal")
            .join(F.broadcast(admitted), ["goal", "bucket"])
            .select("link", "part", "shard", "goal")
        )
        if moves.isEmpty():
            break
        moved = state.join(moves, ["link", "part", "shard"], "left")
        state = settle(
            moved.withColumn("shard", F.coalesce("goal", "shard")).select(*state.columns)
        )
    return state


def _case(value: Column, steps: list[tuple[int, int]]) -> Column:
    """The second of the first step whose first is above ``value``."""
    out = F.lit(None).cast("int")
    for bound, result in reversed(steps):
        out = F.when(value < bound, F.lit(result)).otherwise(out)
    return out


def _by_shard(shard: Column, values: list[int]) -> Column:
    return F.get(F.array(*[F.lit(v).cast("bigint") for v in values]), shard)


def even_rows(state: DataFrame, shards: int, total: int) -> DataFrame:
    """Shards of ``total / shards`` rows, one more in the first, and slots."""
    rows = state.withColumns(
        {
            "alone": F.col("link").isNull().cast("int"),
            "block": _digest("doc_id", "text_crc32", F.lit(-1), modulus=BLOCKS),
        }
    )
    counts = settle(rows.groupBy("shard", "alone", "block").agg(F.count(F.lit(1)).alias("n")))
    load = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    loads = [load.get(s, 0) for s in range(shards)]
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    spare, over, fills, filled = [0] * shards, 0, [], 0
    before_fill = [0] * shards
    for s in range(shards):
        spare[s] = over
        over += max(0, loads[s] - sizes[s])
        before_fill[s] = filled
        if sizes[s] > loads[s]:
            filled += sizes[s] - loads[s]
            fills.append((filled, s))
    earlier = (
        Window.partitionBy("shard").orderBy("alone", "block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        "shard", "alone", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("shard", "alone", "block").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("rank", F.row_number().over(inside)).join(
        F.broadcast(offsets), ["shard", "alone", "block"]
    )
    shard = F.col("shard")
    position = F.col("offset") + F.col("rank") - 1
    released = position >= _by_shard(shard, sizes)
    number = position - _by_shard(shard, sizes) + _by_shard(shard, spare)
    placed = placed.select(
        *state.columns, position.alias("position"), F.when(released, number).alias("number")
    )
    to = _case(F.col("number"), fills)
    slot = _by_shard(to, loads) + F.col("number") - _by_shard(to, before_fill)
    return placed.withColumn("to", to).select(
        *[c for c in state.columns if c != "shard"],
        F.coalesce("to", "shard").cast("int").alias("shard"),
        F.when(F.col("number").isNull(), F.col("position")).otherwise(slot).alias("slot"),
    )


def shard_rows(
    docs: DataFrame,
    shards: int = SHARDS,
    rounds: int = ROUNDS,
    row_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, link, shard, slot): even shards by rows."""
    nodes = settle(facts(docs, row_id, text))
    total = nodes.count()
    state = _split_keys(nodes, shards, total)
    start = F.coalesce(_digest("doc_id", modulus=shards), F.lit(0))
    state = settle(state.withColumn("shard", start).select("doc_id", "size", "text_crc32", "link", "part", "shard"))
    return even_rows(propagate(state, shards, total, rounds), shards, total).drop("part")


def cut_links(placed: DataFrame) -> DataFrame:
    """One row: linked rows, and those outside their key's largest shard."""
    per = placed.filter("link IS NOT NULL").groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
    best = per.groupBy("link").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    return best.agg(F.sum("all").alias("linked"), F.sum(F.col("all") - F.col("most")).alias("cut"))
