"""Secrets in texts: three base patterns plus windows of high entropy.

Entropy: every candidate string is slid over with a window of 20 characters. The
counts of the window's characters change by one in and one out per step, and
with them the sum of ``c * log2(c)`` from which the entropy follows. Character
classes have candidates and thresholds of their own: runs of 20 or more key-like
characters that hold letters and digits, and hex pieces of lower, of upper and of
either case, whatever stands around them. An allow list suppresses identifiers and
counting strings, and windows that overlap an allowed word, but nothing beside it.

``scan`` lists each entropy span once and none that overlaps a base span. Masking
keeps hex pieces that do, so that what reaches beyond a base span is masked as well.

Only DataFrame functions are used; a row's spans never leave its row, so there
is no shuffle. Positions are code points, the end is exclusive.

Defined cases: null and empty texts have no spans; a pattern's failing
matches (too short) still use up their characters; repeated rows are each
scanned; extra columns are kept and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.once import with_once

# The base patterns, the group that is measured and its least length.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
PATTERNS = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Maximal runs, so the length can be part of the pattern.
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
HEX_ALPHABET = "0123456789abcdef"
KEY_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
HEX_BITS = 3.0
KEY_BITS = 3.7
# What is never a secret however random it looks.
ALLOWED = (
    r"(?i)example|sample|placeholder|changeme|dummy|redacted",
    r"(?i)0123456789|123456789|abcdefgh|qwertyui",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[0-9+/_=-]*$",
    r"^[A-Za-z+/_=-]*$",
)

# Hex pieces, whatever stands around them; words that no window may overlap.
MIXED_BITS = 3.2
HEX_PIECES = (
    (r"[0-9a-f]{20,}", HEX_ALPHABET, HEX_BITS),
    (r"[0-9A-F]{20,}", HEX_ALPHABET.upper(), HEX_BITS),
    (r"[0-9A-Fa-f]{20,}", HEX_ALPHABET + "ABCDEF", MIXED_BITS),
)
ALLOWED_WORDS = tuple(p.removeprefix("(?i)") for p in ALLOWED[:2])

_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _pieces(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans of one pattern: matches and the texts between them, added up."""
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(
        F.transform(between, F.length).alias("gap"),
        F.transform(hits, F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length).alias("own"),
    )

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + F.coalesce(part["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        good = F.coalesce(part["own"] >= least, F.lit(False))
        spans = F.when(good, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    first = F.struct(F.lit(0).cast("bigint").alias("at"), _none().alias("spans"))
    return F.aggregate(parts, first, add, lambda s: s["spans"])


def _none() -> Column:
    return F.array().cast(_SPANS)


def find(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans of one pattern; texts without a match are read once."""
    return F.when(text.rlike(pattern), _pieces(text, pattern, kind, group, least)).otherwise(_none())


def _entropy_windows(string: Column, alphabet: str, bits: float) -> Column:
    """First start and last end of windows with at least ``bits``, or nulls."""
    size = len(alphabet)
    # c * log2(c) for every count a window can have, one more before a character
    # leaves; entropy is log2(w) - sum / w.
    parts = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    most = WINDOW * (log2(WINDOW) - bits)
    slot = lambda i: F.instr(F.lit(alphabet), F.substring(string, i + 1, F.lit(1))) - 1
    count = lambda counts, k: F.coalesce(F.get(counts, k), F.lit(0))

    def shift(counts: Column, at: Column, by: int) -> Column:
        return F.transform(counts, lambda c, k: F.when(k == at, c + by).otherwise(c))

    def move(state: Column, into: Column, out: Column) -> Column:
        held = state["counts"]
        before = count(held, into)
        total = state["sum"] + F.get(parts, before + 1) - F.get(parts, before)
        grown = shift(held, into, 1)
        leaving = count(grown, out)
        total = F.when(
            out >= 0, total + F.get(parts, leaving - 1) - F.get(parts, leaving)
        ).otherwise(total)
        return F.struct(F.when(out >= 0, shift(grown, out, -1)).otherwise(grown).alias("c"), total.alias("s"))

    def step(state: Column, i: Column) -> Column:
        gone = F.when(i >= WINDOW, slot(i - WINDOW)).otherwise(F.lit(-1))
        moved = F.transform(
            F.array(F.struct(slot(i).alias("into"), gone.alias("out"))),
            lambda x: move(state, x["into"], x["out"]),
        )[0]

        def judged(m: Column) -> Column:
            high = (i >= WINDOW - 1) & (m["s"] <= most + 1e-9)
            return F.struct(
                m["c"].alias("counts"),
                m["s"].alias("sum"),
                F.when(high & state["first"].isNull(), i - WINDOW + 1)
                .otherwise(state["first"]).alias("first"),
                F.when(high, i + 1).otherwise(state["last"]).alias("last"),
            )

        return F.transform(F.array(moved), judged)[0]

    start = F.struct(
        F.array_repeat(F.lit(0), size).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )
    return F.aggregate(
        F.sequence(F.lit(0), F.length(string) - 1),
        start,
        step,
        lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")),
    )


def _suspect(string: Column) -> Column:
    out = F.lit(True)
    for pattern in ALLOWED:
        out = out & ~string.rlike(pattern)
    return out


def _by_run(string: Column) -> Column:
    return F.when(string.rlike("^[0-9a-f]+$"), _entropy_windows(string, HEX_ALPHABET, HEX_BITS)).otherwise(
        _entropy_windows(string, KEY_ALPHABET, KEY_BITS)
    )


def _entropy_spans(
    text: Column, candidate: str = CANDIDATE, windows: Callable[[Column], Column] = _by_run
) -> Column:
    """Entropy spans of a text; candidates on the allow list are passed over."""
    kind = KINDS.index("entropy")
    runs = _pieces(text, candidate, kind, 0, WINDOW)

    def narrowed(run: Column) -> Column:
        string = F.substring(text, (run["start"] + 1).cast("int"), (run["end"] - run["start"]).cast("int"))
        return F.transform(
            F.array(string),
            lambda s: F.transform(
                F.array(
                    F.when(_suspect(s), windows(s))
                ),
                lambda w: F.struct(
                    (run["start"] + w["first"]).alias("start"),
                    F.lit(kind).alias("kind"),
                    (run["start"] + w["last"]).alias("end"),
                ),
            )[0],
        )[0]

    found = F.filter(F.transform(runs, narrowed), lambda x: x["start"].isNotNull())
    return F.when(text.rlike(candidate), found).otherwise(_none())


def _without_allowed(text: Column) -> Column:
    """The text with as many blanks in place of every allowed word, so that places stay."""
    blank = text
    for word in "|".join(ALLOWED_WORDS).split("|"):
        blank = F.regexp_replace(blank, f"(?i){word}", " " * len(word))
    return F.when(text.rlike(f"(?i){'|'.join(ALLOWED_WORDS)}"), blank).otherwise(text)


def _hex_spans(text: Column) -> Column:
    """Entropy spans of hex pieces, each class with its alphabet and threshold."""
    return F.concat(
        *[
            _entropy_spans(text, piece, lambda s, alphabet=alphabet, bits=bits: _entropy_windows(s, alphabet, bits))
            for piece, alphabet, bits in HEX_PIECES
        ]
    )


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has, in either case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def scan(docs: DataFrame, text: str = "text", out: str = "secrets", wide: bool = False) -> DataFrame:
    """Add an array of spans (start, kind number, end), in order of start and kind.

    ``wide`` is what masking needs: hex pieces that overlap base spans, too.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    names = {part: _free(docs, f"_secret_{part}") for part in ("text", "base", "more", "open")}
    df = with_once(docs, {names["text"]: whole})
    body, seen = F.col(names["text"]), F.col(names["open"])
    base = F.concat(*[find(body, p, k, g, n) for k, (_, p, g, n) in enumerate(PATTERNS)])
    df = with_once(df, {names["open"]: _without_allowed(body)})
    runs, pieces = _entropy_spans(seen), _hex_spans(seen)
    more = runs if wide else F.array_distinct(F.concat(runs, pieces))
    df = with_once(df, {names["base"]: base, names["more"]: more})
    apart = F.filter(
        names["more"],
        lambda e: ~F.exists(names["base"], lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])),
    )
    spans = [F.col(names["base"]), apart, *([pieces] if wide else [])]
    df = with_once(df, {out: F.sort_array(F.concat(*spans))})
    return df.drop(*names.values())


def digest_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < KINDS.index("entropy"))


def count_kind(spans: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("bigint")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, overlaps joined, replaced by ``mask``."""

    def add(state: Column, s: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        fresh = s["start"] >= state["at"]
        return F.struct(
            F.when(fresh, F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], s["end"]).alias("at"),
        )

    def close(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))

    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, first, add, close))


def mask_secrets(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets masked; a column ``size`` is the new length."""
    spans = _free(docs, "_secret_spans")
    found = scan(docs, text, out=spans, wide=True)
    found = found.withColumn(text, redact(F.col(text), F.col(spans)))
    if size in docs.columns:
        found = found.withColumn(size, F.length(text).cast(docs.schema[size].dataType))
    return found.select(*docs.columns)
