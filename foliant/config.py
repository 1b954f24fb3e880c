"""Settings and fixed values shared by every module."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values. Results depend on them being exactly these.
# ---------------------------------------------------------------------------

IGNORE = -100  # label of a position that carries no loss
PAD, BOS, EOS, UNK = 0, 1, 2, 3

# Named character caps.
CHAR_CAPS = {
    "8m": 8 * 1024 * 1024,
    "1m": 1024 * 1024,
    "256k": 256 * 1024,
    "128k": 128 * 1024,
}

# Task tags carried by every prepared row.
LANGUAGE_MODELING = "language modeling"
AUTO_ENCODING = "auto encoding"
QUESTION_ANSWERING = "question answering"
PERPLEXITY = "perplexity"
NEWS_V1 = "news qa summation"
NEWS_V2 = "news qa summation v2"
MEMORY_UTILIZATION = "memory utilization"
SHIFTED_LABELS = "activation beacons"
COPY_BACK = "longdata copy"

# Text patterns. Java's \P{Alnum} is the ASCII class [^a-zA-Z0-9], matched ten times faster in a group.
SYMBOL_RUN = r"(\P{Alnum})\1{4,}"
REPEATED_UNIT = r"([a-zA-Z0-9]{3,}?)\1+"
ARTICLE_HEADING = "( \n = [^=]*[^=] = \n )"
HEADING_LINE = "^ = [^=]*[^=] = \n$"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DIGITS = "0123456789"
SEPARATORS = (" ", "\n", "\n\n")

# Prompt texts.
NEWS_V1_PREFIX = """
            Below is a paragraph which is inserted with bunch of irrelated context among it.
            You must remember the information that you think is neccessary.
            Then, answer questions at the end.

        """
NEWS_V2_PREFIX = """
            Below is a paragraph, and only a part of this paragraph is valid content, 
            the rest is irrelevant. Please identify the valid parts, 
            remember them, and answer the question after the end of the paragraph.\n\n
        """
QUESTION_LEAD = "Question: "
ANSWER_LEAD = "Answer: "
SUMMARY_REQUEST = "The paragraph is over, now summarize the above article in few sentences."
V2_LEAD = "\n\n"

# Sizes.
SAMPLE_MIN_LENGTH = 1200
SAMPLE_CAP_PER_SOURCE = 200_000
BOUNDED_READ_ROWS = 10_000
CHARS_PER_TOKEN_BOUND = 5
MIN_ARTICLE_CHARS = 100
KL_SHARE, CE_SHARE = 0.9, 0.1

# Code point ranges that Python's str.split() and str.strip() treat as blank.
BLANK_RANGES = (
    (0x09, 0x0D),
    (0x1C, 0x20),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)

# ---------------------------------------------------------------------------

BLANKS = "".join(chr(c) for low, high in BLANK_RANGES for c in range(low, high + 1))
# The same set as a regex class that Java and RE2 both read.
BLANK_CLASS = "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in BLANK_RANGES) + "]"


@dataclass(frozen=True)
class Tokens:
    """Word tokenizer: ids are 3 .. vocab_size + 2, below are pad, bos and eos.

    ``encoder`` replaces it by any function from a text column to an
    ``ARRAY<INT>`` column without bos, such as ``scoring.text_encoder`` makes
    from a Python tokenizer. ``list_encoder`` does the same for a column of
    text lists and the most ids wanted of each text.
    """

    vocab_size: int = 32000
    add_bos: bool = True
    encoder: Callable | None = None
    list_encoder: Callable | None = None


@dataclass(frozen=True)
class Chunks:
    """Tokens per chunk and memory slots each full chunk is compressed into."""

    chunk_size: int = 1024
    num_memory: int = 32

    @property
    def ratio(self) -> float:
        return self.chunk_size / self.num_memory


CHUNKS_32X = Chunks(1024, 32)
CHUNKS_8X = Chunks(1024, 128)


@dataclass(frozen=True)
class Task:
    """One evaluation task. ``None`` means every row / no truncation."""

    task_type: str
    task_name: str
    num_instance: int | None
    truncation: int | None


@dataclass(frozen=True)
class MixEntry:
    """One corpus of a weighted mixture."""

    name: str
    partition: float
    truncation: int | None = None
