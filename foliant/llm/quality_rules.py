"""Quality rules: decision lists learned from labelled text statistics.

Sequential covering in Spark: a rule for low-quality documents is grown one
threshold at a time (each step is one histogram per statistic, counted by the
cluster), its last conditions are pruned on rows held out from growing, the
rows it covers are set aside, and the next rule is grown on the rest. The
result is an ordered list of threshold conjunctions and one Spark ``CASE``.

Only DataFrame functions are used. What reaches the driver are histograms: at
most a hundred rows per statistic and step, whatever the input.

Defined cases: a null or empty text has all counts 0 and fails the base rule;
rows that repeat a ``doc_id`` are judged each on their own; several labels of
one document count as the lowest; documents or labels that lack each other,
null ids and null labels take no part in learning; without labelled rows of
both kinds the list is empty and only the base rule rejects. Extra columns of
either table are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.once import with_once
from foliant.operators.sizing import settle

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BINS = 40
MAX_RULES = 8
MAX_CONDITIONS = 3
MIN_COVER = 6
MIN_PRECISION = 0.93
PRUNE_PARTS = 3


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, "")).cast("bigint")


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def _covered(grams: Column) -> Column:
    """Positions within three-word windows whose hash occurs twice or more."""

    def repeated(pairs: Column) -> Column:
        same = lambda p, j: F.coalesce(F.get(pairs, j)["h"] == p["h"], F.lit(False))
        twice = F.filter(pairs, lambda p, j: same(p, j - 1) | same(p, j + 1))
        return F.sort_array(F.transform(twice, lambda p: p["i"]))

    def length(starts: Column) -> Column:
        steps = F.transform(
            starts, lambda s, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - s, F.lit(3)))
        )
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _bind(_bind(pairs, repeated), length)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of the base rule, lines, capitals and exclamation marks."""
    df = with_once(docs, {"_t": F.coalesce(F.col(text), F.lit(""))})
    words = F.array_remove(F.split("_t", BLANK_RUN), "")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    df = with_once(df, {"_w": words, "_l": lines})
    size = F.size("_w")
    grams = F.when(
        size >= 3,
        F.transform(
            F.sequence(F.lit(0), F.greatest(size - 3, F.lit(0))),
            lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    df = with_once(df, {"_g": grams})
    repeats = F.when(F.size(F.array_distinct("_g")) < F.size("_g"), _covered(F.col("_g")))
    text_size = F.length("_t").cast("bigint")
    return with_once(
        df,
        {
            "n_words": size.cast("bigint"),
            "word_chars": _without(F.col("_t"), BLANKS),
            "n_symbols": text_size - _without(F.col("_t"), SYMBOLS),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"),
            "n_repeat_words": F.coalesce(repeats, F.lit(0).cast("bigint")),
            "n_lines": F.size("_l").cast("bigint"),
            "n_capitals": text_size - _without(F.col("_t"), CAPITALS),
            "n_exclaimed": text_size - _without(F.col("_t"), "!"),
        },
    ).drop("_t", "_w", "_l", "_g")


def _ratio(above: str, below: str) -> Column:
    return F.col(above) / F.greatest(F.col(below), F.lit(1))




def features() -> dict[str, Column]:
    """What rules may test, from the counts of a document."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "repeated_lines": _ratio("n_dup_lines", "n_lines"),
        "repeated_words": _ratio("n_repeat_words", "n_words"),
        "capitals": _ratio("n_capitals", "word_chars"),
        "exclaimed_per_word": _ratio("n_exclaimed", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature >= threshold`` or ``feature < threshold``."""

    feature: str
    at_least: bool
    threshold: float
    bin: int

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= self.threshold if self.at_least else value < self.threshold

    def binned(self) -> Column:
        value = F.col(f"b_{self.feature}")
        return value >= self.bin if self.at_least else value < self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, null where none does."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules))):
        out = F.when(_all([c.column() for c in rule]), F.lit(number)).otherwise(out)
    return out


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Candidate thresholds: quantiles of both classes."""
    names = list(features())
    share = [0.0, 0.001, 0.0025, 0.005, 0.01, *[i / BINS for i in range(1, BINS)], 0.99, 0.995, 1.0]
    found: dict[str, set[float]] = {n: set() for n in names}
    for row in (
        rows.groupBy("bad")
        .agg(*[F.percentile_approx(n, share, 10_000).alias(n) for n in names])
        .collect()
    ):
        for n in names:
            found[n].update(row[n] or ())
    out = {}
    for n, values in found.items():
        out[n] = sorted(values)
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL gain of narrowing (p0, n0) to (p, n)."""
    if p == 0:
        return 0.0
    return p * (log2((p + 1) / (p + n + 2)) - log2((p0 + 1) / (p0 + n0 + 2)))


def _best(histogram: list, cuts: dict[str, list[float]], p0: int, n0: int) -> Condition | None:
    names = list(features())
    best, score = None, 1e-9
    for k, name in enumerate(names):
        bad, good = [0] * (len(cuts[name]) + 1), [0] * (len(cuts[name]) + 1)
        for row in histogram:
            if row["f"] == k:
                bad[row["b"]] += row["bad"]
                good[row["b"]] += row["n"] - row["bad"]
        for at in range(1, len(bad)):
            for above in (True, False):
                p, n = (sum(c[at:]) if above else sum(c[:at]) for c in (bad, good))
                found = _gain(p, n, p0, n0) if p + n >= MIN_COVER else 0.0
                if found > score:
                    best, score = Condition(name, above, cuts[name][at - 1], at), found
    return best


def learn(labelled: DataFrame, row_id: str = "doc_id") -> list[Rule]:
    """Ordered rules for rows whose ``bad`` is 1, from counts and labels."""
    names = list(features())
    rows = labelled.filter("bad IS NOT NULL").select(
        F.col(row_id).alias("row_id"),
        F.col("bad").cast("int").alias("bad"),
        *[c.alias(n) for n, c in features().items()],
    )
    cuts = _thresholds(rows)
    if not all(cuts.values()):
        return []

    def bin_of(name: str) -> Column:
        ordered = F.array(*[F.lit(float(t)) for t in cuts[name]])
        return F.size(F.filter(ordered, lambda t: t <= F.col(name))).cast("int").alias(f"b_{name}")

    bins = [bin_of(n) for n in names]
    held = F.pmod(F.xxhash64("row_id"), F.lit(PRUNE_PARTS)) == 0
    binned = settle(rows.select("bad", held.alias("held"), *bins))
    rest, rules = F.lit(True), []
    cells = F.posexplode(F.array(*[F.col(f"b_{n}") for n in names])).alias("f", "b")
    while len(rules) < MAX_RULES:
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            within = binned.filter(~F.col("held") & rest & _all([c.binned() for c in rule]))
            histogram = (
                within.select("bad", cells)
                .groupBy("f", "b")
                .agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n"))
                .collect()
            )
            total = [r for r in histogram if r["f"] == 0]
            p0 = sum(r["bad"] for r in total)
            n0 = sum(r["n"] for r in total) - p0
            if p0 == 0 or n0 == 0:
                break
            found = _best(histogram, cuts, p0, n0)
            if found is None:
                break
            rule.append(found)
        if not rule:
            break
        # Conditions from the end go while that does not hurt on held-out rows.
        prefixes = [_all([c.binned() for c in rule[: k + 1]]) for k in range(len(rule))]
        counts = (
            binned.filter(rest & F.col("held"))
            .agg(
                *[F.sum(F.when(c, F.col("bad"))).alias(f"p{k}") for k, c in enumerate(prefixes)],
                *[F.count(F.when(c, 1)).alias(f"n{k}") for k, c in enumerate(prefixes)],
            )
            .first()
        )

        def worth(k: int, counts=counts) -> float:
            p, n = counts[f"p{k}"] or 0, counts[f"n{k}"]
            return (p + 1) / (n + 2)

        kept = max(range(len(rule)), key=lambda k: (worth(k), -k))
        n, p = counts[f"n{kept}"], counts[f"p{kept}"] or 0
        if n < max(1, MIN_COVER // PRUNE_PARTS) or p / n < MIN_PRECISION:
            break
        rules.append(tuple(rule[: kept + 1]))
        rest = rest & ~_all([c.binned() for c in rules[-1]])
    return rules


def judge(
    docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, list[Rule]]:
    """Counts, ``base_failed``, ``rule`` and ``kept`` of every row, and the rules.

    ``labels`` has ``row_id`` and ``quality`` (0 marks a bad document).
    """
    rows = docs.select(F.col(row_id), F.col(text), _text_id(text).alias("text_id"))
    counted = settle(statistics(rows, text).drop(text))
    lowest = labels.groupBy(F.col(row_id).alias("_label_id")).agg(F.min("quality").alias("_q"))
    # The base rule has decided its rows; the list is learned for the others.
    labelled = (
        counted.filter(~base_failed())
        .join(lowest, F.col(row_id) == F.col("_label_id"))
        .withColumn("bad", F.when(F.col("_q").isNotNull(), (F.col("_q") == 0).cast("int")))
    )
    rules = learn(labelled, row_id)
    judged = counted.withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    kept = ~F.col("base_failed") & F.col("rule").isNull()
    return judged.withColumn("kept", kept), rules


def _text_id(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def reject(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that the base rule or a learned rule rejects.

    Rows are judged once on narrow columns; whole rows are only joined.
    """
    judged, _ = judge(docs, labels, row_id, text)
    gone = judged.filter(~F.col("kept")).select(F.col(row_id).alias("id"), F.col("text_id").alias("body"))
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(row_id).alias("of"), _text_id(text).alias("own")
    )
    same = F.col("of").eqNullSafe(F.col("id")) & (F.col("own") == F.col("body"))
    return rows.join(gone.distinct(), same, "left_anti").select("row.*")
