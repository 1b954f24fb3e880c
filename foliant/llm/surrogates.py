"""Surrogates for personal data: keyed, of the same type, form, gender and script.

Entities are e-mail addresses, phone, card and social security numbers, IBANs,
IPv4 addresses, and names that follow a title (in English, German, French,
Spanish and Russian); a titled name's words are then found wherever else they
stand in the document. An entity is its kind and its bare form (digits only,
lower case), so spellings of one entity are one entity in all documents and
keep one surrogate. A surrogate is drawn from a keyed digest of the entity:

* numbers keep their length, punctuation and leading country or network digit;
  cards and IBANs (numbers without valid check digits are neither) keep valid check
  digits, private addresses stay private;
* addresses keep the form of their local part and move to ``example`` domains,
  equal domains to equal ones;
* names keep their script, the gender of their title, and their case.

The table of entities is checked for collisions by Spark: a surrogate drawn by
two entities of a kind stays with the smaller one, a surrogate that is itself
an entity of the corpus is given up, and the others draw again, until none is
left. So different entities stay different. Mentions take their surrogates by
a join on the entity; both sides are stored tables, so an entity with a third
of all mentions is split. Texts move once, to meet their replacements.

Defined cases: null and empty texts have no entities and stay; repeated rows
get the same result each; mentions never overlap, the earlier and then the
longer one counts; extra columns are kept and may have any name.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import words
from foliant.operators.sizing import settle

DEFAULT_KEY = "foliant"
KINDS = ("email", "phone", "card", "ssn", "iban", "ip", "given_f", "given_m", "surname_f", "surname_m", "surname")

EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
NUMBER = re.compile(
    rf"(?<![\w.])(?P<ip>{_OCTET}(?:\.{_OCTET}){{3}})(?!\w|\.\d)"
    r"|(?<![\w.+-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w.+-])(?P<card>\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{5})(?![\w-])"
    r"|(?<![\w.])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}"
    r"|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-])",
    re.A,
)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
# Titles by gender; M, F, or unknown.
TITLES = {
    "m": "Mr Mister Sir Herr Herrn Monsieur Señor Sr Don г-н господин",
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Mademoiselle Señora Señorita Sra Srta Doña г-жа госпожа",
    "": "Dr Prof Professor Doctor доктор профессор",
}
_GENDER = {t: g for g, names in TITLES.items() for t in names.split()}
NAME = re.compile(
    r"(?<!\w)(" + "|".join(sorted(map(re.escape, _GENDER), key=len, reverse=True)) + r")\.?[  ]"
    r"([^\W\d_a-zа-яё][^\W\d_]+(?:-[^\W\d_]+)?)(?:[  ]([^\W\d_a-zа-яё][^\W\d_]+(?:-[^\W\d_]+)?))?"
)
# Sounds of made-up names by script: first letters, vowels, endings by gender.
SOUNDS = {
    "latin": ("b d f g h k l m n p r s t v w j".split(), "a e i o u".split(), {"f": "a ina elle", "m": "o an er", "": "er en ow"}),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х".split(), "а е и о у".split(), {"f": "ина ова ая", "m": "ин ов ский", "": "ко ук ян"}),
}


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 else sum(divmod(2 * d, 10))
    return -total % 10


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _bare(kind: str, surface: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", surface)
    if kind == "iban":
        return surface.replace(" ", "")
    return surface if kind == "ip" else surface.lower()


def _valid(kind: str, surface: str) -> bool:
    bare = _bare(kind, surface)
    if kind == "card":
        return 13 <= len(bare) <= 19 and luhn(bare[:-1]) == int(bare[-1])
    if kind == "phone":
        return 9 <= len(bare) <= 15
    if kind == "iban":
        return 15 <= len(bare) <= 34 and _iban_check(bare[:2], bare[4:]) == bare[2:4]
    return True


def _script(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def mentions(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a text's entities, in order, without overlaps."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    for m in NUMBER.finditer(text):
        if _valid(m.lastgroup, m[0]):
            found.append((m.start(), m.end(), m.lastgroup))
    found += [(m.start(), m.end(), "iban") for m in IBAN.finditer(text) if _valid("iban", m[0])]
    named: dict[str, str] = {}
    for m in NAME.finditer(text):
        gender = _GENDER[m[1]]
        if m[3]:
            named.setdefault(m[2], f"given_{gender}" if gender else "surname")
        last = m[3] or m[2]
        cyrillic = gender and _script(last) == "cyrillic"
        named.setdefault(last, f"surname_{gender}" if cyrillic else "surname")
    if named:
        again = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, named)) + r")(?!\w)")
        found += [(m.start(), m.end(), named[m[0]]) for m in again.finditer(text)]
    found.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for x in found:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


class _Draw:
    """Repeatable choices from a keyed digest."""

    def __init__(self, key: bytes, *parts: object) -> None:
        self.key, self.seed, self.block, self.bits = key, "|".join(map(str, parts)), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 48:
            digest = hmac.new(self.key, f"{self.seed}|{self.block}".encode(), hashlib.sha256).digest()
            self.bits, self.left, self.block = int.from_bytes(digest, "big"), 256, self.block + 1
        taken = self.bits & ((1 << 48) - 1)
        self.bits >>= 48
        self.left -= 48
        return taken % n

    def alike(self, text: str) -> str:
        """Letters for letters and digits for digits."""
        return "".join(
            chr(48 + self.below(10)) if c.isdigit()
            else chr((97 if c.islower() else 65) + self.below(26)) if c.isascii() and c.isalpha()
            else c
            for c in text
        )


def draw(key: str, kind: str, bare: str, attempt: int) -> str:
    """The surrogate of an entity in its bare form."""
    secret = key.encode()
    d = _Draw(secret, kind, bare, attempt)
    if kind == "email":
        local, _, domain = bare.rpartition("@")
        top = domain.rsplit(".", 1)[1]
        label = _Draw(secret, "domain", domain).alike("a" * max(6, len(domain.split(".")[0])))
        return f"{d.alike(local)}@{label}.example.{top if top in ('com', 'net', 'org') else 'org'}"
    if kind == "ip":
        octets = list(map(int, bare.split(".")))
        private = (octets[0] == 10) + 2 * (octets[:2] == [192, 168]) + 2 * (octets[0] == 172 and 16 <= octets[1] < 32)
        # A small private network can hold more addresses than it has surrogates: later
        # attempts leave it for 10.*, and that for public addresses.
        kept = octets[:private] if attempt < 4 else [10] if private and attempt < 12 else []
        made = kept + [1 + d.below(254) for _ in octets[len(kept) :]]
        if not kept:
            public = [x for x in range(11, 224) if x not in (127, 172, 192)]
            made[0] = public[d.below(len(public))]
        return ".".join(map(str, made))
    if kind == "card":
        body = bare[0] + d.alike(bare[1:-1])
        return body + str(luhn(body))
    if kind == "phone":
        head = max(1, len(bare) - 10)
        return bare[:head] + str(2 + d.below(8)) + d.alike(bare[head + 1 :]) if len(bare) > head else d.alike(bare)
    if kind == "iban":
        rest = d.alike(bare[4:])
        return bare[:2] + _iban_check(bare[:2], rest) + rest
    if kind == "ssn":
        return f"9{d.alike(bare[1:])}"
    first, vowels, endings = SOUNDS[_script(bare)]
    gender = kind.partition("_")[2]
    tail = endings[gender].split()
    syllables = 2 + attempt // 4
    body = "".join(first[d.below(len(first))] + vowels[d.below(len(vowels))] for _ in range(syllables))
    return body + first[d.below(len(first))] + tail[d.below(len(tail))]


def render(kind: str, surface: str, surrogate: str) -> str:
    """The surrogate in the spelling of its mention."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(surrogate)
        same = str.isdigit if kind != "iban" else str.isalnum
        return "".join(next(rest) if same(c) else c for c in surface)
    if surface.isupper():
        return surrogate.upper()
    return surrogate.title() if surface[:1].isupper() and kind != "email" else surrogate


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "tid", "first", "last", "kind", "surface", "bare"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    for batch in words.slices(batches):
        rows = []
        for doc, tid, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            for start, end, kind in mentions(text):
                surface = text[start:end]
                rows.append((doc, tid, start, end, kind, surface, _bare(kind, surface)))
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def _drawn(key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
        made = pa.array([draw(key, *r) for r in rows], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], made], ["kind", "bare", "attempt", "surrogate"])


def entity_table(found: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """(kind, bare, attempt, surrogate): different surrogates for the entities of a kind."""
    schema = "kind string, bare string, attempt int, surrogate string"

    def drawn(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(lambda batches: _drawn(key, batches), schema)

    table = found.select("kind", "bare").distinct().withColumn("attempt", F.lit(0))
    table = settle(drawn(table))
    family = F.split_part("kind", F.lit("_"), F.lit(1))
    while True:
        holders = table.groupBy(family.alias("family"), "surrogate").agg(F.min(F.struct("bare", "kind")).alias("holder"))
        real = table.select(family.alias("family"), F.col("bare").alias("surrogate"), F.lit(True).alias("real")).distinct()
        judged = (
            table.withColumn("family", family)
            .join(settle(holders), ["family", "surrogate"])
            .join(real, ["family", "surrogate"], "left")
        )
        lost = (F.struct("bare", "kind") != F.col("holder")) | F.col("real").isNotNull()
        judged = settle(judged.select("kind", "bare", "attempt", "surrogate", lost.alias("lost")))
        again = judged.filter("lost").select("kind", "bare", (F.col("attempt") + 1).alias("attempt"))
        if again.isEmpty():
            return judged.drop("lost")
        table = settle(judged.filter("NOT lost").drop("lost").unionByName(drawn(again)))


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the new text after a batch's columns; texts and spots are its last two."""
    for batch in words.slices(batches):
        out = []
        for text, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text is not None and spots:
                parts, at = [], 0
                for s in sorted(spots, key=lambda x: x["first"]):
                    parts += [text[at : s["first"]], render(s["kind"], s["surface"], s["surrogate"])]
                    at = s["last"]
                text = "".join(parts) + text[at:]
            out.append(text)
        rest = batch.columns[2:]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *rest], ["text", "row", "counts"])


def pseudonymize(
    docs: DataFrame, key: str = DEFAULT_KEY, row_id: str = "doc_id", text: str = "text", counts: str = "n_entities"
) -> DataFrame:
    """``docs`` with surrogates in the text, and how many mentions were replaced."""
    body = F.coalesce(F.col(text), F.lit(""))
    ids = [F.col(row_id).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("tid")]
    found = docs.select(*ids, body.alias("text")).mapInArrow(
        _detect, "doc_id bigint, tid bigint, first int, last int, kind string, surface string, bare string"
    )
    # Rows that repeat id and text have the same mentions.
    found = settle(found.dropDuplicates(["doc_id", "tid", "first"]))
    table = entity_table(found, key)
    spots = found.join(table.select("kind", "bare", "surrogate"), ["kind", "bare"])
    # Bounded by the length of one text.
    by_text = spots.groupBy("doc_id", "tid").agg(
        F.collect_list(F.struct("first", "last", "kind", "surface", "surrogate")).alias("spots")
    )
    by_text = settle(by_text).withColumnsRenamed({"doc_id": "_spot_id", "tid": "_spot_tid"})
    # Rows travel as one column, so that no name of theirs meets one of ours.
    rest = [F.col(c) for c in docs.columns if c != text] or [F.lit(None).alias("none")]
    packed = docs.select(*ids, F.col(text).cast("string").alias("text"), F.struct(*rest).alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("_spot_id")) & (F.col("tid") == F.col("_spot_tid"))
    # What is to be replaced grows with the texts: one plan at every size, no broadcast.
    joined = packed.join(by_text.hint("merge"), same, "left").select(
        "text", "spots", "row", F.coalesce(F.size("spots"), F.lit(0)).cast("bigint").alias("counts")
    )
    kind = joined.schema["row"].dataType.simpleString()
    made = joined.mapInArrow(_replaced, f"text string, row {kind}, counts bigint")
    own = [F.col("text").alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c != counts]
    return made.select(*own, F.col("counts").alias(counts))
