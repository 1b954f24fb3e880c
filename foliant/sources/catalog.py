"""Corpora by name: ``name.split.option`` resolves to a lazy DataFrame."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import config as C
from foliant.functions import text as tx
from foliant.operators import articles, mixing, samples
from foliant.operators.ordered import id_positions
from foliant.sources import readers


@dataclass(frozen=True)
class Location:
    """Where a raw input lies: a path with its format, or a table name."""

    where: str
    fmt: str = "parquet"


class Corpora:
    """Corpus names over the raw inputs of one installation.

    ``locations`` maps input names (the first argument of the readers below)
    to paths or ``Location``s. Tables hold their position as ``row_id``.
    """

    def __init__(
        self,
        spark: SparkSession,
        locations: Mapping[str, str | Location],
        tokens: C.Tokens = C.Tokens(),
        min_length: int = C.SAMPLE_MIN_LENGTH,
        per_source: int = C.SAMPLE_CAP_PER_SOURCE,
    ):
        self.spark = spark
        self.locations = locations
        self.tokens = tokens
        self.min_length = min_length
        self.per_source = per_source
        # The names of corpora; what follows a name are its reader's arguments.
        self._named: dict[str, Callable[..., DataFrame]] = {
            "minipile": self._minipile,
            "wikitext103": self._articles,
            "pg19": self._books,
            "proof-pile": lambda cap=None: self._json_corpus("proof-pile", cap),
            "code-parrot": lambda cap=None: self._json_corpus("code-parrot", cap),
            "longdata-corpus": self._cleaned,
            "longalpaca": self._instructions,
            "minipilecopy256": lambda split: self._copy_pairs("minipile-copy-256", split),
            "minipilecopy2k": lambda split: self._copy_pairs("minipile-copy-2k", split),
            "minipilecopy4k": lambda split: self._copy_pairs("minipile-copy-4k", split),
            "longdata-corpuscopy": self._cleaned_copy,
            "redpajamaarxivsample": self._papers,
            "redpajamabooksample": self._book_sample,
            "redpajamav2": self._web,
            "newsqasum": self._news_v1,
            "newsqasumv2": self._news_v2,
            "memoryutil2k": self._memory,
            "beacons": self._two_part,
            "beaconssampled": self._sampled,
        }

    @property
    def names(self) -> list[str]:
        return list(self._named)

    def read(self, spec: str) -> DataFrame:
        """A name and its options, parted by dots; case and blanks do not matter."""
        name, _, tail = re.sub(r"\s", "", spec).casefold().partition(".")
        reader = self._named.get(name)
        if reader is None:
            raise ValueError(f"unknown corpus {name!r}; known are {self.names}")
        options = tail.split(".") if tail else []
        try:
            inspect.signature(reader).bind(*options)
        except TypeError as e:
            raise ValueError(f"wrong options for corpus {name!r}: {options}") from e
        return reader(*options)

    # --- inputs ------------------------------------------------------------

    def _where(self, name: str) -> Location:
        if name not in self.locations:
            raise ValueError(f"no location is set for input {name!r}")
        at = self.locations[name]
        return at if isinstance(at, Location) else Location(at)

    def _table(self, name: str, split: str | None = None, lang: str | None = None) -> DataFrame:
        at = self._where(name)
        return readers.read_table(self.spark, at.where, split, lang, at.fmt)

    def _lines(self, name: str, schema) -> DataFrame:
        return readers.read_json_lines(self.spark, self._where(name).where, schema)

    def _json_split(self, name: str, split: str) -> DataFrame:
        return readers.read_split_json(self.spark, self._where(name).where, split)

    @staticmethod
    def _capped(df: DataFrame, cap: int | None, text: str = "text") -> DataFrame:
        return df.withColumn(text, tx.cap_chars(F.col(text), cap))

    # --- language modelling ------------------------------------------------

    def _minipile(self, split: str) -> DataFrame:
        return samples.lm_rows(self._table("minipile", split))

    def _articles(self, split: str) -> DataFrame:
        lines = self._table("wikitext103", split).withColumn("source", F.lit(split))
        made = articles.split_lines(lines, "source", "line_no", "text")
        return samples.lm_rows(id_positions(made, "article", out="row_id"))

    def _books(self, split: str, cap: str | None = None) -> DataFrame:
        # Any other option means uncapped.
        limit = C.CHAR_CAPS[cap] if cap in ("1m", "256k", "128k") else None
        return samples.lm_rows(self._capped(self._table("pg19", split), limit))

    def _json_corpus(self, name: str, cap: str | None) -> DataFrame:
        limit = C.CHAR_CAPS[cap] if cap in ("1m", "256k") else None
        return samples.lm_rows(self._capped(self._lines(name, readers.TEXT), limit))

    def _cleaned_text(self, limit: int | None) -> DataFrame:
        df = self._table("longdata-corpus")
        return df.withColumn("text", tx.clean_then_cap(F.col("text"), limit))

    def _cleaned(self, cap: str | None = None) -> DataFrame:
        limit = C.CHAR_CAPS[cap] if cap in ("128k", "1m") else None
        return samples.lm_rows(self._cleaned_text(limit))

    def _cleaned_copy(self, cap: str | None = None) -> DataFrame:
        limit = tx.char_cap(cap, ("128k",))
        return samples.lm_rows(self._cleaned_text(limit), tag=C.COPY_BACK)

    def _papers(self, split: str, cap: str | None = None) -> DataFrame:
        _only_train(split)
        limit = tx.char_cap(cap, ("8m", "1m", "128k"), required=True)
        df = self._table("redpajama-sample-1t")
        is_map = dict(df.dtypes)["meta"].startswith("map")
        df = df.filter(tx.has_meta_key(F.col("meta"), "arxiv_id", is_map))
        return samples.lm_rows(self._capped(df, limit))

    def _book_sample(self, split: str, cap: str | None = None) -> DataFrame:
        _only_train(split)
        limit = tx.char_cap(cap, ("8m", "1m", "128k"), required=True)
        df = readers.read_first(self._lines("redpajama-book-sample", readers.TEXT))
        return samples.lm_rows(self._capped(df, limit))

    def _web(self, split: str) -> DataFrame:
        _only_train(split)
        return samples.lm_rows(self._table("redpajama-v2", "train", "en"), "raw_content")

    # --- instructions and copies -------------------------------------------

    def _instructions(
        self, split: str, train_prompt: str, sharded: str | None = None
    ) -> DataFrame:
        if sharded not in (None, "deepspeed"):
            raise ValueError(f"option {sharded!r} is not 'deepspeed'")
        df = self._table("longalpaca", split)
        return samples.qa_rows(df, "instruction", "output", samples.flag(train_prompt))

    def _copy_pairs(self, name: str, split: str) -> DataFrame:
        return samples.copy_rows(self._json_split(name, split))

    def _memory(self, split: str) -> DataFrame:
        df = self._json_split("minipile-copy-2k", split)
        return samples.lm_rows(df, "prompt", C.MEMORY_UTILIZATION)

    # --- news --------------------------------------------------------------

    def _news_parts(self) -> tuple[DataFrame, DataFrame]:
        news = self._table("news-qa-summarization", "train")
        return news, self._books("train", "128k")

    def _news_v1(self, split: str, method: str) -> DataFrame:
        _only_train(split)
        if method not in ("lm", "distill"):
            raise ValueError(f"method {method!r} is neither 'lm' nor 'distill'")
        news, books = self._news_parts()
        return samples.news_rows(mixing.distractor_by_position(news, books), method)

    def _news_v2(self) -> DataFrame:
        news, books = self._news_parts()
        return samples.news_rows(mixing.distractor_at_random(news, books))

    # --- mixed -------------------------------------------------------------

    def _two_part(self) -> DataFrame:
        return samples.two_part_corpus(
            self._lines("redpajama-sample", readers.TEXT),
            self._lines("longalpaca-lines", readers.INSTRUCTION_LINES),
        )

    def _sampled(
        self, max_length: str, pairs: str | None = None, distill: str | None = None
    ) -> DataFrame:
        if pairs not in (None, "no_alpaca", "with_alpaca"):
            raise ValueError(f"option {pairs!r} is neither 'no_alpaca' nor 'with_alpaca'")
        if distill not in (None, "distill"):
            raise ValueError(f"option {distill!r} is not 'distill'")
        return samples.sampled_corpus(
            self._lines("redpajama-sample", readers.TEXT),
            None
            if pairs == "no_alpaca"
            else self._lines("longalpaca-lines", readers.INSTRUCTION_LINES),
            self.tokens,
            int(max_length),
            self.min_length,
            self.per_source,
            distill == "distill",
        )


def _only_train(split: str) -> None:
    if split != "train":
        raise ValueError(f"only the split 'train' exists, not {split!r}")
