"""Articles cut out of a corpus stored as ordered lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import config as C
from foliant.functions import text as tx
from foliant.operators.once import with_once
from foliant.operators.sizing import settle

# Lines of a block, blocks of a group, groups of a group ..., in bits of the line number.
BLOCK_BITS = 14
FAN_BITS = 10
# What is known after a line, in bits: it may be a heading (if the next line starts with a
# blank), it ends a paragraph, it is blank, and the line before it was a heading.
STATES = 16


def split_whole_text(df: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """Articles of sources that each fit one row.

    The text is split at every heading; what stands before the first heading
    is dropped.
    """
    parts = F.split(F.col(text), C.ARTICLE_HEADING, -1)
    return df.select(source, F.posexplode(parts).alias("article", "text")).filter(
        F.col("article") > 0
    )


def _codes(text: Column) -> Column:
    """What matters of a line, in bits: looks, ends, blank, starts."""
    flags = (
        text.rlike(C.HEADING_LINE),
        text.endswith(" \n"),
        text == " \n",
        text.startswith(" "),
    )
    return reduce(
        lambda x, y: x.bitwiseOR(y), [F.shiftleft(f.cast("int"), k) for k, f in enumerate(flags)]
    )


def _bit(number: Column, k: int) -> Column:
    return F.shiftright(number, k).bitwiseAND(F.lit(1))


def _after(state: Column, line: Column) -> Column:
    """State after one more line, and whether the line before it is a heading (0 or 1).

    A heading looks like one, follows the end of a paragraph and is followed by a
    blank; it takes the blank before and after it. So no heading follows another
    directly, nor with a blank line between them.
    """
    heading = _bit(state, 0).bitwiseAND(_bit(line, 3))
    taken = heading.bitwiseOR(_bit(state, 2).bitwiseAND(_bit(state, 3)))
    may = _bit(line, 0).bitwiseAND(_bit(state, 1)).bitwiseAND(F.lit(1) - taken)
    kept = F.shiftleft(_bit(line, 1), 1).bitwiseOR(F.shiftleft(_bit(line, 2), 2))
    new = may.bitwiseOR(kept).bitwiseOR(F.shiftleft(heading, 3))
    return F.struct(new.alias("to"), heading.cast("bigint").alias("n"))


def _line_blocks(lines: DataFrame, source: str, line_no: str) -> DataFrame:
    """One row a block with the lines that can matter for headings.

    These are lines that look like headings with two before and one after, the first
    and the last two of the block. Between two others nothing is open, whatever came
    before: leaving them out changes no state.
    """
    coded = lines.select(
        source,
        F.shiftright(line_no, BLOCK_BITS).alias("at"),
        F.struct(F.col(line_no).alias("no"), _codes(F.col("_t")).alias("code")).alias("line"),
    )
    blocks = coded.groupBy(source, "at").agg(F.sort_array(F.collect_list("line")).alias("all"))
    looks = F.filter(
        F.transform("all", lambda x, i: F.when(_bit(x["code"], 0) == 1, i)), lambda i: i.isNotNull()
    )
    near = F.flatten(
        F.transform(looks, lambda i: F.sequence(F.greatest(i - 2, F.lit(0)), F.least(i + 1, F.size("all") - 1)))
    )
    ends = F.array(F.lit(0), F.greatest(F.size("all") - 2, F.lit(0)), F.size("all") - 1)
    wanted = F.array_sort(F.array_distinct(F.concat(near, ends)))
    blocks = with_once(blocks, {"lines": F.transform(wanted, lambda i: F.get("all", i))})
    return blocks.select(source, "at", "lines")


def _composed(f: Column, g: Column) -> Column:
    """First ``f``, then ``g``: arrays of a new state and a number of headings by state."""
    return F.transform(
        f,
        lambda x: F.struct(
            F.get(g, x["to"])["to"].alias("to"), (x["n"] + F.get(g, x["to"])["n"]).alias("n")
        ),
    )


_KIND = "array<struct<to:int,n:bigint>>"


def _identity() -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(STATES - 1)),
        lambda s: F.struct(s.cast("int").alias("to"), F.lit(0).cast("bigint").alias("n")),
    ).cast(_KIND)


def _block_function(lines: Column) -> Column:
    """What a block makes of every state before it."""
    return F.aggregate(
        lines,
        _identity(),
        lambda f, x: F.transform(
            f,
            lambda s: F.struct(
                _after(s["to"], x["code"])["to"].alias("to"),
                (s["n"] + _after(s["to"], x["code"])["n"]).alias("n"),
            ),
        ),
    )


def _starts(blocks: DataFrame, source: str) -> DataFrame:
    """State and number of headings before each block: ``source, at, to, n``.

    ``blocks`` has their functions. Groups of ``2**FAN_BITS`` neighbours are composed
    to one function, groups of groups likewise, up to one per source; then the
    starts go down the same tree. No group has more members, and the largest block
    number gives the depth.
    """
    levels = [blocks.select(source, "at", "f")]
    groups = []
    largest = blocks.agg(F.max("at")).first()[0] or 0
    depth = max(0, largest.bit_length() - 1) // FAN_BITS
    for level in range(depth + 1):
        last = level == depth
        up = F.lit(0).cast("bigint") if last else F.shiftright("at", FAN_BITS)
        members = F.sort_array(F.collect_list(F.struct("at", "f"))).alias("members")
        grouped = levels[-1].groupBy(source, up.alias("up")).agg(members)
        if not last:
            grouped = settle(grouped)
            whole = F.aggregate("members", _identity(), lambda f, m: _composed(f, m["f"]))
            levels.append(grouped.select(source, F.col("up").alias("at"), whole.alias("f")))
        groups.append(grouped)
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("bigint").alias("n"))
    begins = groups[-1].select(source, "members", start.alias("start"))
    for level in range(depth, -1, -1):
        # A state and a count are carried; every member is given those before it.
        listed = F.aggregate(
            "members",
            F.struct(
                F.col("start").cast("struct<to:int,n:bigint>").alias("now"),
                F.array().cast("array<struct<at:bigint,to:int,n:bigint>>").alias("out"),
            ),
            lambda a, m: F.struct(
                F.struct(
                    F.get(m["f"], a["now"]["to"])["to"].alias("to"),
                    (a["now"]["n"] + F.get(m["f"], a["now"]["to"])["n"]).alias("n"),
                ).alias("now"),
                F.concat(
                    a["out"],
                    F.array(F.struct(m["at"].alias("at"), a["now"]["to"].alias("to"), a["now"]["n"].alias("n"))),
                ).alias("out"),
            ),
            lambda a: a["out"],
        )
        found = begins.select(source, F.inline(listed))
        if level == 0:
            return found
        below = found.select(source, F.col("at").alias("up"), F.struct("to", "n").alias("start"))
        begins = groups[level - 1].join(below, [source, "up"]).select(source, "members", "start")
    raise AssertionError("no level")


def split_lines(
    df: DataFrame,
    source: str = "source",
    line_no: str = "line_no",
    text: str = "text",
    min_chars: int | None = C.MIN_ARTICLE_CHARS,
) -> DataFrame:
    """The same articles when a source is many ordered lines in many tasks.

    A line can be a heading if it looks like one, the line before ends a
    paragraph and the line after starts with a blank. Splitting consumes the
    blank that the next heading would need, so of headings that follow each
    other directly only every second one splits. Each article loses the blank
    after its heading and the two characters before the next heading.

    A block of lines is a function from the state before it to the state and the
    number of headings after it. Blocks are read once for these functions, which are
    composed in a tree (``_starts``), and lines once for their texts. Line numbers are
    not negative.
    """
    lines = df.select(
        source, F.col(line_no).cast("bigint").alias("_no"), F.col(text).alias("_t")
    ).filter(F.col("_t") != "")
    blocks = settle(_line_blocks(lines, source, "_no"))
    functions = blocks.select(source, "at", _block_function(F.col("lines")).cast(_KIND).alias("f"))
    begun = blocks.join(_starts(functions, source), [source, "at"])
    # The lines after a heading; a block has few.
    passed = F.aggregate(
        "lines",
        F.struct(F.col("to"), F.array().cast("array<bigint>").alias("out")),
        lambda a, x: F.struct(
            _after(a["to"], x["code"])["to"].alias("to"),
            F.when(_after(a["to"], x["code"])["n"] == 1, F.concat(a["out"], F.array(x["no"])))
            .otherwise(a["out"])
            .alias("out"),
        ),
        lambda a: a["out"],
    )
    begun = settle(begun.select(source, "at", "n", passed.alias("firsts")))
    marked = lines.withColumn("at", F.shiftright("_no", BLOCK_BITS)).join(begun, [source, "at"])
    number = F.col("n") + F.size(F.filter("firsts", lambda b: b <= F.col("_no")))
    marked = marked.select(source, "_no", "_t", number.cast("bigint").alias("article")).filter("article > 0")
    last = begun.groupBy(source).agg(F.max(F.col("n") + F.size("firsts")).alias("_last"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_no", "_t"))), lambda r: r["_t"])
    # One article is one output row, so its lines have to meet in one task.
    whole = marked.groupBy(source, "article").agg(parts.alias("_parts")).join(last, source)
    # All but the last end with the next heading and the blank before it.
    is_last = F.col("article") == F.col("_last")
    body = F.array_join(F.when(is_last, F.col("_parts")).otherwise(F.slice("_parts", F.lit(1), F.size("_parts") - 1)), "")
    whole = with_once(whole, {"_body": body})
    n = F.length("_body")
    cut = F.when(is_last, n - 1).otherwise(n - 3)
    out = whole.select(
        source, "article", F.substring(F.col("_body"), F.lit(2), F.greatest(cut, F.lit(0))).alias("text")
    )
    return out if min_chars is None else out.filter(tx.longer_than(F.col("text"), min_chars))
