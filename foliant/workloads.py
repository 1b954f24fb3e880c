"""Registered queries: each maps (spark, folder of tables) to a DataFrame.

Sizes are scaled to the test tables (a chunk of 128 tokens rather than 1024);
every query reads its tables whole. Where the number of draws is the feature
(mixtures, exact samples, the bounded reader) it bounds the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant import config as C
from foliant.functions import text as tx
from foliant.functions import tokens as tk
from foliant.operators import (
    articles,
    collate,
    context,
    mixing,
    ordered,
    parameters,
    samples,
    scoring,
    vocabulary,
)
from foliant.operators.once import with_once
from foliant.operators.sizing import shared_dir, spread
from foliant.plans import feed, planners, reports
from foliant.sources import readers, sinks
from foliant.sources.catalog import Corpora
from foliant.streaming import chunk_stream

CHUNKS = C.Chunks(128, 4)
CHUNKS_WIDE = C.Chunks(128, 16)
TOKENS = C.Tokens()
SEED = 42
TRUNCATIONS = (128, 256, 512, 1024, None)
MIN_LENGTH, MAX_LENGTH = 50, 512
SFT_MIN, SFT_MAX = 16, 256
VOCABULARY = 2000
PER_SOURCE = 30
TURN_BITS = 20

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query | None = None, *, optional: tuple[str, ...] = ()) -> Query:
    """Register a query; ``optional`` names integer columns that can be null."""
    if fn is None:
        return lambda f: query(f, optional=optional)
    QUERIES[fn.__name__] = lambda spark, folder: tidy(fn(spark, folder), optional)
    return fn


PLAN_OPTIONAL = ("clear_cache", "loss_denominator")


def tidy(df: DataFrame, optional: tuple[str, ...] = ()) -> DataFrame:
    """Plain result types: BIGINT, rounded DOUBLE, and arrays as joined text.

    Integers that can be null become DOUBLE, which every client reads the same.
    """
    cols = []
    for f in df.schema.fields:
        col = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            if isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
                # Millionths: engines print small doubles differently.
                col = F.transform(col, lambda x: F.round(x.cast("double") * 1e6).cast("bigint"))
            col = F.array_join(col.cast("array<string>"), ",")
        elif f.name in optional:
            col = col.cast("bigint").cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.BooleanType)):
            col = col.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            col = F.round(col.cast("double"), 6)
        cols.append(col.alias(f.name))
    return df.select(*cols)


# --- tables ----------------------------------------------------------------


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return spread(_table(spark, folder, "documents").withColumnRenamed("doc_id", "row_id"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Instruction rows: a user turn and the assistant turn right after it."""
    turns = _table(spark, folder, "conversations")
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("input")
    )
    replied = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")
    )
    return asked.join(replied, ["conv_id", "turn"]).select(
        (F.shiftleft("conv_id", TURN_BITS) + F.col("turn")).alias("row_id"), "input", "output"
    )


def _qa(spark: SparkSession, folder: str) -> DataFrame:
    return samples.qa_rows(_pairs(spark, folder), "input", "output", False)


def _ids(df: DataFrame, text: str = "text") -> DataFrame:
    return with_once(df, {"input_ids": tk.tokenize(F.col(text), TOKENS)})


def _arrivals(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations")
    ids = {"input_ids": tk.tokenize(F.col("text"), TOKENS, False)}
    made = with_once(turns, ids).withColumn("n_tokens", F.size("input_ids"))
    return made.drop("text")


def _logits(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as logits of ten positions per sample; every third is masked out."""
    vectors = _table(spark, folder, "embeddings")
    return vectors.select(
        F.expr("vec_id div 10").alias("sample_id"),
        (F.col("vec_id") % 10).alias("pos"),
        F.col("embedding").alias("logits"),
        F.when(F.col("vec_id") % 7 == 0, C.IGNORE).otherwise(F.col("label")).alias("label"),
        (F.col("vec_id") % 3 != 0).cast("int").alias("mask"),
        "vec_id",
    )


def _teacher_student(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector with its successor as the second side."""
    rows = _logits(spark, folder)
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("logits").alias("student"))
    return rows.withColumnRenamed("logits", "teacher").join(other, "vec_id")


def _news(stories: DataFrame) -> DataFrame:
    """Stories with their lines: odd lines ask, even lines answer, the last one sums up."""
    lines = F.split("story", "\n")
    return stories.select(
        *stories.columns,
        F.filter(lines, lambda x, i: i % 2 == 0).alias("questions"),
        F.transform(F.filter(lines, lambda x, i: i % 2 == 1), lambda x: F.array(x)).alias(
            "answers"
        ),
        F.element_at(lines, -1).alias("summary"),
    )


def _news_v1_rows(spark: SparkSession, folder: str) -> DataFrame:
    # The lines are cut behind the join, so its shuffle carries each story once.
    books = _docs(spark, folder).select("row_id", "text")
    stories = books.withColumnRenamed("text", "story")
    rows = _news(mixing.distractor_by_position(stories, books))
    rows = samples.news_rows(rows, "lm").withColumn(
        "method", F.when(F.col("row_id") % 2 == 0, "lm").otherwise("distill")
    )
    return rows


def _news_v2_rows(spark: SparkSession, folder: str) -> DataFrame:
    books = _docs(spark, folder).select("row_id", "text")
    rows = mixing.distractor_at_random(
        books.withColumnRenamed("text", "story"), books, min_chars=2000, cap=2000, seed=SEED
    )
    return samples.news_rows(_news(rows))


def _copy_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each document cut into pieces of 31 words; the copy lacks the last word."""
    words = _docs(spark, folder).select("row_id", tk.words(F.col("text")).alias("w"))
    pieces = planners.explode_chunks(words, 31, ("w",), ("row_id",))
    return pieces.select(
        (F.shiftleft("row_id", TURN_BITS) + F.col("chunk_id")).alias("row_id"),
        tk.decode(F.col("w")).alias("prompt"),
        tk.decode(tk.first_n(F.col("w"), 30)).alias("response"),
    )


def _plan(df: DataFrame) -> DataFrame:
    return df.drop("task_type")


# --- text ------------------------------------------------------------------


@query
def char_cap(spark, folder):
    text = F.col("text")
    return _docs(spark, folder).select(
        "row_id",
        tx.cap_chars(text, 1000).alias("capped"),
        F.length(tx.cap_chars(text, tx.char_cap("128k"))).alias("n_128k"),
    )


@query
def min_chars(spark, folder):
    return _docs(spark, folder).filter(tx.longer_than(F.col("text"))).select("row_id", "n_chars")


@query
def lang_filter(spark, folder):
    return _docs(spark, folder).filter(F.col("lang") == "en").select("row_id", "text")


@query
def meta_contains(spark, folder):
    events = _table(spark, folder, "events")
    return events.filter(tx.has_meta_key(F.col("props"), '"k": 6')).select(
        "event_id",
        tx.has_meta_key(F.from_json("props", "map<string,int>"), "k", True).alias("has_k"),
    )


@query
def squeeze_symbols(spark, folder):
    return _docs(spark, folder).select("row_id", tx.squeeze_symbols(F.col("text")).alias("text"))


@query
def collapse_repeats(spark, folder):
    return _docs(spark, folder).select("row_id", tx.collapse_repeats(F.col("text")).alias("text"))


@query
def clean_then_cap(spark, folder):
    return _docs(spark, folder).select(
        "row_id", tx.clean_then_cap(F.col("text"), C.CHAR_CAPS["128k"]).alias("text")
    )


@query
def strip_text(spark, folder):
    return _docs(spark, folder).select("row_id", tx.strip(F.col("text")).alias("text"))


@query
def normalize_text(spark, folder):
    return _docs(spark, folder).select(
        "row_id",
        tx.normalize_text(F.col("text")).alias("plain"),
        F.length(tx.normalize_text(F.col("text"), ignore_number=True)).alias("n_no_digits"),
    )


@query
def prompt_texts(spark, folder):
    return _pairs(spark, folder).select(
        "row_id",
        tx.question_text(F.col("input")).alias("question"),
        tx.answer_text(F.col("output"), C.V2_LEAD).alias("answer"),
    )


@query
def article_split(spark, folder):
    """Documents written out as heading and paragraph lines, then split again."""
    docs = _docs(spark, folder)
    body = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit(" "), x, F.lit(" \n")))
    heading = F.concat(F.lit(" = Doc "), F.col("row_id").cast("string"), F.lit(" = \n"))
    written = F.concat(F.array(F.lit(" \n"), heading), body)
    lines = docs.select("source", "row_id", F.posexplode(written).alias("i", "text")).select(
        "source", (F.shiftleft("row_id", TURN_BITS) + F.col("i")).alias("line_no"), "text"
    )
    return articles.split_lines(lines)


@query
def corpus_by_name(spark, folder):
    corpora = Corpora(spark, {"pg19": f"{folder}/documents.parquet"})
    return corpora.read("PG19. train .128k").select(F.md5("text").alias("digest"), "task_type")


#: Corpora read in ``corpora_by_name``, with options.
CORPUS_SPECS = (
    "minipile.train",
    "pg19.train",
    "pg19.test.256k",
    "proof-pile.1m",
    "code-parrot.256k",
    "redpajama arxiv sample.train.1m",
    "redpajama book sample.train.128k",
    "redpajama v2.train",
    "longdata-corpus.128k",
    "longdata-corpus copy",
    "longalpaca.train.true.deepspeed",
    "beacons",
)


@query
def corpora_by_name(spark, folder):
    """Twelve corpora by their names over the documents and the instruction pairs."""
    base = f"{shared_dir(spark).rstrip('/')}/corpora-{uuid.uuid4().hex}"
    docs, pairs = _table(spark, folder, "documents"), _pairs(spark, folder)
    whole = f"{folder}/documents.parquet"
    sinks.write_json(docs.select("text"), f"{base}/lines")
    sinks.write_json(pairs.select("input", "output"), f"{base}/pairs")
    pairs.select(F.col("input").alias("instruction"), "output").write.parquet(f"{base}/instructions")
    docs.select(F.col("text").alias("raw_content"), "lang").write.parquet(f"{base}/web")
    key = F.when(F.col("doc_id") % 2 == 0, "arxiv_id").otherwise("isbn")
    meta = F.to_json(F.create_map(key, F.col("doc_id").cast("string")))
    docs.select("text", meta.alias("meta")).write.parquet(f"{base}/papers")
    corpora = Corpora(
        spark,
        {
            **{name: whole for name in ("minipile", "pg19", "longdata-corpus")},
            **{n: f"{base}/lines" for n in ("proof-pile", "code-parrot", "redpajama-book-sample", "redpajama-sample")},
            "longalpaca-lines": f"{base}/pairs",
            "longalpaca": f"{base}/instructions",
            "redpajama-v2": f"{base}/web",
            "redpajama-sample-1t": f"{base}/papers",
        },
    )
    parts = []
    for spec in CORPUS_SPECS:
        rows = corpora.read(spec)
        bodies = [F.col("text")] if "text" in rows.columns else []
        if "prompt" in rows.columns:
            bodies.append(F.concat_ws("|", "prompt", "response"))
        parts.append(rows.select(F.lit(spec).alias("name"), "task_type", F.md5(F.coalesce(*bodies)).alias("digest")))
    return reduce(DataFrame.unionByName, parts)


@query
def json_round_trip(spark, folder):
    """Documents written as JSON lines into the shared folder and read again."""
    path = f"{shared_dir(spark).rstrip('/')}/documents-{uuid.uuid4().hex}"
    docs = _docs(spark, folder).select("row_id", "text", "lang")
    sinks.write_json(docs.withColumnRenamed("row_id", "doc_id"), path)
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    )
    rows = readers.read_json_lines(spark, path, schema)
    total = rows.agg(F.max("row_id") + 1).scalar()
    return rows.select("doc_id", F.md5("text").alias("digest"), total.alias("n_rows"))


@query
def file_list_order(spark, folder):
    """Documents in three folders of JSON lines, read as a list in another order."""
    base = f"{shared_dir(spark).rstrip('/')}/listed-{uuid.uuid4().hex}"
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    parts = docs.withColumn("third", F.col("doc_id") % 3)
    for third in range(3):
        own = parts.filter(F.col("third") == third).drop("third")
        sinks.write_json(own.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), f"{base}/{third}")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    rows = readers.read_json_lines(spark, [f"{base}/{third}" for third in (2, 0, 1)], schema)
    return rows.select("row_id", "doc_id", F.md5("text").alias("digest"))


@query
def metrics_log(spark, folder):
    """Reports of three runs, one of which was repeated: every run stands in the log once."""
    path = f"{shared_dir(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    report = _table(spark, folder, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_chars")
    )
    for run in ("first", "second", "first", "third"):
        sinks.append_log(report, path, "report", run=run, model="none")
    return spark.read.json(path).select("run", "command", "model", "lang", "n", "mean_chars")


@query
def bounded_rows(spark, folder):
    """The first hundred documents in corpus order."""
    return mixing.first_rows(_docs(spark, folder).select("row_id", "text"), 100)


@query
def row_contract(spark, folder):
    """User turns beside their reply; those without one break the contract."""
    turns = _table(spark, folder, "conversations")
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    replied = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    rows = asked.join(replied, ["conv_id", "turn"], "left")
    good, bad = samples.split_violations(rows, ["prompt", "response"])
    kept = good.select("conv_id", "turn", F.lit("").alias("missing"))
    return kept.unionByName(bad.select("conv_id", "turn", F.array_join("missing", ",").alias("missing")))


# --- tokens ----------------------------------------------------------------


@query
def token_ids(spark, folder):
    return _ids(_docs(spark, folder)).select(
        "row_id", "input_ids", F.size("input_ids").alias("length")
    )


@query
def decode_words(spark, folder):
    return _docs(spark, folder).select(
        "row_id", tk.decode(tk.words(F.col("text"))).alias("text")
    )


@query
def vocab_topk(spark, folder):
    return vocabulary.build_vocabulary(_docs(spark, folder), size=VOCABULARY)


@query
def vocab_encode(spark, folder):
    docs = _docs(spark, folder)
    vocab = vocabulary.build_vocabulary(docs, size=VOCABULARY)
    return vocabulary.encode_with_vocabulary(docs, vocab)


@query
def external_tokenizer(spark, folder):
    """The tokenizer seam with a stand-in that encodes a word by its length."""

    def make():
        return lambda text: [len(w) for w in text.split(" ") if w]

    docs = scoring.tokenize_with(_docs(spark, folder), make)
    return docs.select("row_id", "input_ids")


@query
def head_truncate(spark, folder):
    return _ids(_docs(spark, folder)).select(
        "row_id", tk.head_truncate(F.col("input_ids"), MAX_LENGTH).alias("input_ids")
    )


@query
def middle_truncate_prompt(spark, folder):
    pairs = _pairs(spark, folder).select(
        "row_id",
        tk.tokenize(F.col("input"), TOKENS).alias("p"),
        tk.tokenize(F.col("output"), TOKENS).alias("r"),
    )
    cut = tk.middle_truncate_prompt(F.col("p"), F.col("r"), 64)
    return pairs.select("row_id", cut.alias("prompt"), F.size("r").alias("response_length"))


@query
def middle_truncate_chars(spark, folder):
    return _docs(spark, folder).select(
        "row_id", tx.middle_truncate_chars(F.col("text"), 1001).alias("text")
    )


@query
def length_filter(spark, folder):
    docs = _ids(_docs(spark, folder))
    return docs.filter(tk.length_between(F.col("input_ids"), MIN_LENGTH, MAX_LENGTH)).select(
        "row_id", F.size("input_ids").alias("length"), F.col("row_id").alias("index")
    )


@query
def label_shift(spark, folder):
    return _ids(_docs(spark, folder)).select(
        "row_id", tk.shift_labels(F.col("input_ids")).alias("labels")
    )


@query
def mask_fill(spark, folder):
    docs = _ids(_docs(spark, folder)).withColumn(
        "mask", F.transform("input_ids", lambda x: (x % 3 != 0).cast("int"))
    )
    labels = tk.ignore_masked(F.col("input_ids"), F.col("mask"))
    return docs.select("row_id", labels.alias("labels"), tk.valid_labels(labels).alias("valid"))


@query
def append_eos(spark, folder):
    """Ids of an even number of tokens already end with eos."""
    ids = F.col("input_ids")
    ended = F.when(F.size(ids) % 2 == 0, F.concat(ids, F.array(F.lit(C.EOS)))).otherwise(ids)
    docs = _ids(_docs(spark, folder)).select("row_id", ended.alias("input_ids"))
    docs = docs.withColumns(
        {
            "labels": F.col("input_ids"),
            "attention_mask": tk.ones(F.col("input_ids")),
            "position_ids": F.sequence(F.lit(0), F.size("input_ids") - 1),
        }
    )
    names = ["input_ids", "labels", "attention_mask", "position_ids"]
    made = tk.append_eos({n: F.col(n) for n in names})
    return docs.select("row_id", *[made[n].alias(n) for n in names])


@query
def remove_eos(spark, folder):
    """An eos put after the fifth token and another at the end; the first goes."""
    ids, eos = F.col("input_ids"), F.array(F.lit(C.EOS))
    docs = _ids(_docs(spark, folder)).select(
        "row_id",
        F.concat(tk.first_n(ids, 5), eos, tk.drop_first(ids, F.least(F.size(ids), F.lit(5))), eos).alias("input_ids"),
    )
    docs = docs.withColumn("position_ids", F.sequence(F.lit(0), F.size("input_ids") - 1))
    made = tk.remove_first_eos({n: F.col(n) for n in ("input_ids", "position_ids")})
    return docs.select("row_id", *[c.alias(n) for n, c in made.items()])


@query
def mask_replace(spark, folder):
    docs = _ids(_docs(spark, folder)).select(
        "row_id", tk.chunk_arrays(F.col("input_ids"), CHUNKS.chunk_size).alias("nested")
    )
    replaced = tk.replace_value(F.col("nested"), C.BOS, C.IGNORE, depth=2)
    return docs.select(
        "row_id",
        F.flatten(replaced).alias("values"),
        tk.longest(F.col("nested")).alias("longest"),
    )


@query
def sft_separator(spark, folder):
    return _pairs(spark, folder).select(
        "row_id", tk.separator(F.col("row_id"), SEED).alias("separator")
    )


@query
def equal_lengths(spark, folder):
    """Whether shifted labels, and labels cut by one, still match their ids."""
    ids = F.col("input_ids")
    docs = _ids(_docs(spark, folder)).withColumns(
        {
            "labels": tk.shift_labels(ids),
            "short": F.when(F.size(ids) % 2 == 0, tk.drop_first(ids)).otherwise(ids),
        }
    )
    return docs.select(
        "row_id",
        tk.same_length(ids, F.col("labels")).alias("labels_match"),
        tk.same_length(ids, F.col("labels"), F.col("short")).alias("all_match"),
    )


# --- samples ---------------------------------------------------------------


@query
def lm_samples(spark, folder):
    return samples.lm_samples(_docs(spark, folder), TOKENS, MIN_LENGTH, MAX_LENGTH)


@query
def lm_samples_bounded(spark, folder):
    """Texts cut to five characters per token before they are tokenized."""
    return samples.lm_samples(
        _docs(spark, folder), TOKENS, MIN_LENGTH, MAX_LENGTH, char_bound=C.CHARS_PER_TOKEN_BOUND
    )


@query
def sft_samples(spark, folder):
    return samples.sft_samples(_pairs(spark, folder), TOKENS, SFT_MIN, SFT_MAX, seed=SEED)


@query
def sft_eval_samples(spark, folder):
    return samples.sft_samples(
        _pairs(spark, folder), TOKENS, SFT_MIN, SFT_MAX, with_labels=False
    )


@query
def pretokenized_filter(spark, folder):
    docs = _ids(_docs(spark, folder)).withColumn("labels", tk.shift_labels(F.col("input_ids")))
    return samples.pretokenized_samples(docs, MIN_LENGTH, MAX_LENGTH)


def _mixed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as text, instruction pairs, and documents as ids."""
    docs = _docs(spark, folder)
    ids = _ids(docs).select(F.col("row_id"), "input_ids", F.col("input_ids").alias("labels"))
    return samples.concatenate([docs.select("row_id", "text"), _pairs(spark, folder), ids])


@query
def mixed_shape_samples(spark, folder):
    rows = _mixed_rows(spark, folder)
    return samples.mixed_samples(rows, TOKENS, SFT_MIN, SFT_MAX, keep=("part",))


@query
def mixed_eval_samples(spark, folder):
    rows = _mixed_rows(spark, folder)
    return samples.mixed_samples(
        rows, TOKENS, SFT_MIN, SFT_MAX, keep=("part",), with_labels=False
    )


@query
def row_function(spark, folder):
    """The row-function seam: count words, drop rows that are not English."""

    def count(row_id, text, lang):
        if lang != "en":
            return None
        return {"row_id": row_id, "n_words": len(text.split()), "n_chars": len(text)}

    docs = _docs(spark, folder).select("row_id", "text", "lang")
    return samples.map_rows(docs, count, "row_id bigint, n_words bigint, n_chars bigint")


@query
def capped_per_source(spark, folder):
    docs = _docs(spark, folder).select("row_id", "source", "text")
    return samples.sample_per_source(docs, PER_SOURCE, seed=SEED)


@query(optional=("train_prompt",))
def two_part_corpus(spark, folder):
    return samples.two_part_corpus(_docs(spark, folder), _pairs(spark, folder))


@query
def sampled_corpus(spark, folder):
    return samples.sampled_corpus(
        _docs(spark, folder),
        _pairs(spark, folder),
        TOKENS,
        MAX_LENGTH,
        MIN_LENGTH,
        per_source=150,
        seed=SEED,
    )


# --- planners --------------------------------------------------------------


@query(optional=PLAN_OPTIONAL)
def chunk_lm(spark, folder):
    return _plan(planners.lm_plan(_docs(spark, folder), CHUNKS, TOKENS, None))


@query(optional=PLAN_OPTIONAL)
def chunk_ppl(spark, folder):
    return _plan(planners.perplexity_plan(_docs(spark, folder), CHUNKS, TOKENS, 1024))


@query(optional=PLAN_OPTIONAL)
def chunk_qa(spark, folder):
    return _plan(planners.qa_plan(_qa(spark, folder), C.Chunks(32, 4), TOKENS, 128))


@query(optional=PLAN_OPTIONAL)
def chunk_copy_pair(spark, folder):
    return _plan(planners.copy_pair_plan(_copy_pairs(spark, folder), C.Chunks(32, 4), TOKENS))


@query
def copy_pair_violations(spark, folder):
    found = planners.copy_pair_violations(_copy_pairs(spark, folder), C.Chunks(32, 4), TOKENS)
    return found.select("row_id", "prompt_length", "response_length")


@query(optional=PLAN_OPTIONAL)
def chunk_shifted(spark, folder):
    made = samples.lm_samples(_docs(spark, folder), TOKENS, MIN_LENGTH, MAX_LENGTH)
    made = made.withColumn("distill", F.col("row_id") % 2 == 1)
    return _plan(planners.shifted_label_plan(made, CHUNKS))


@query(optional=PLAN_OPTIONAL)
def chunk_copy_back(spark, folder):
    return _plan(planners.copy_back_plan(_docs(spark, folder), CHUNKS, TOKENS, None))


@query(optional=PLAN_OPTIONAL)
def chunk_mem_util(spark, folder):
    return _plan(
        planners.memory_utilization_plan(_docs(spark, folder), CHUNKS, TOKENS, 256, seed=SEED)
    )


@query(optional=PLAN_OPTIONAL)
def news_plan_v1(spark, folder):
    tokens = tk.in_batches(TOKENS)
    return _plan(
        planners.news_plan_v1(_news_v1_rows(spark, folder), CHUNKS, tokens, 512, seed=SEED)
    )


@query(optional=PLAN_OPTIONAL)
def catalog_news_plan(spark, folder):
    """Rows as the corpus has them, with alternative answers, through the dispatcher."""
    rows, tokens = _news_v1_rows(spark, folder), tk.in_batches(TOKENS)
    return _plan(planners.plan_tasks(rows, CHUNKS, tokens, 512, override=C.NEWS_V1, seed=SEED))


@query(optional=PLAN_OPTIONAL)
def news_plan_v2(spark, folder):
    tokens = tk.in_batches(TOKENS)
    return _plan(
        planners.news_plan_v2(
            _news_v2_rows(spark, folder), CHUNKS, tokens, 512, 384, 448, seed=SEED
        )
    )


@query
def task_dispatch(spark, folder):
    """English documents as language modelling, the others as copy-back."""
    docs = _docs(spark, folder).withColumn(
        "task_type",
        F.when(F.col("lang") == "en", C.LANGUAGE_MODELING).otherwise(C.COPY_BACK),
    )
    plan = planners.plan_tasks(
        docs, CHUNKS, TOKENS, 512, (C.LANGUAGE_MODELING, C.COPY_BACK), seed=SEED
    )
    return plan.groupBy("sample_id", "task_type").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if("has_loss").alias("scored_chunks"),
        F.sum(F.size("input_ids")).alias("tokens"),
    )


# --- joins, order, mixtures ------------------------------------------------


@query
def distractor_mod_join(spark, folder):
    # Every document meets the one seven places on, counted in corpus order.
    docs = _docs(spark, folder)
    shifted = docs.select((F.col("row_id") + 7).alias("row_id"))
    joined = mixing.distractor_by_position(shifted, docs.select("row_id", "text"))
    return joined.select("row_id", F.md5("disturb").alias("disturb"))


@query
def distractor_random_join(spark, folder):
    docs = _docs(spark, folder)
    joined = mixing.distractor_at_random(
        docs.select("row_id"), docs.select("row_id", "text"), min_chars=2000, cap=2000, seed=SEED
    )
    return joined.select("row_id", F.md5("disturb").alias("disturb"))


@query(optional=("num_instance", "truncation"))
def task_cross_samples(spark, folder):
    docs = _docs(spark, folder).select("row_id", "lang")
    numbered = mixing.numbered_rows(docs, "row_id").withColumn("task_name", F.lit("documents"))
    tasks = [
        C.Task(C.PERPLEXITY, "documents", None, 512),
        C.Task(C.PERPLEXITY, "documents", 100, 1024),
        C.Task(C.LANGUAGE_MODELING, "documents", 10, None),
    ]
    return mixing.task_samples(numbered, mixing.tasks_frame(spark, tasks))


@query
def shuffle_positions(spark, folder):
    docs = _docs(spark, folder).select("row_id")
    return ordered.shuffled_positions(docs, "row_id", SEED)


def _mixture(spark: SparkSession, folder: str):
    """A 0.7 / 0.3 mixture of English and other documents, half a corpus long."""
    docs = _docs(spark, folder)
    corpora = {
        "english": samples.lm_rows(docs.filter(F.col("lang") == "en")),
        "other": samples.lm_rows(docs.filter(F.col("lang") != "en"), tag=C.COPY_BACK),
    }
    mix = [C.MixEntry("english", 0.7, 512), C.MixEntry("other", 0.3, None)]
    iters = _table(spark, folder, "documents").count() // 2
    return corpora, mix, iters


@query(optional=("truncation",))
def mixture_feed(spark, folder):
    corpora, mix, iters = _mixture(spark, folder)
    return mixing.mixture_feed(corpora, mix, iters, seed=SEED).drop("task_type")


@query(optional=("visit",))
def training_feed(spark, folder):
    corpora, mix, iters = _mixture(spark, folder)
    tags = {"english": (C.LANGUAGE_MODELING,), "other": (C.COPY_BACK,)}
    rows = feed.training_feed(corpora, mix, iters, tags, CHUNKS, TOKENS, 2, seed=SEED)
    return rows.select("step", "seq", "segment", "input_ids", "has_loss", "outcome", "visit")


@query(optional=("slot", "released_at", "visit"))
def chunk_reservoir(spark, folder):
    docs = _ids(_docs(spark, folder))
    return mixing.chunk_reservoir(docs, F.ceil(F.size("input_ids") / 32), 2, "row_id", "chunk_id", SEED)


# --- scores ----------------------------------------------------------------


@query
def token_nll(spark, folder):
    return scoring.with_nll(_logits(spark, folder)).select("vec_id", "nll")


@query
def shifted_nll(spark, folder):
    pairs = scoring.shifted(_logits(spark, folder), "sample_id")
    return scoring.with_nll(pairs).select("sample_id", "pos", "nll")


@query
def softmax_rows(spark, folder):
    return scoring.with_softmax(_logits(spark, folder)).select("vec_id", "probs")


@query
def minmax_rows(spark, folder):
    return scoring.with_min_max(_logits(spark, folder), "logits").select("vec_id", "scaled")


@query
def ce_prefix_mask(spark, folder):
    rows = _table(spark, folder, "embeddings").select(
        F.expr("vec_id div 10").alias("sample_id"),
        (F.col("vec_id") % 10).alias("pos"),
        F.col("embedding").alias("logits"),
        "label",
        (F.col("vec_id") % 3 != 0).cast("int").alias("mask"),
    )
    return scoring.prefix_masked_ce(scoring.with_nll(rows), ["sample_id"])


@query(optional=("sample_id",))
def ce_ignore_index(spark, folder):
    return scoring.ignore_index_ce(scoring.with_nll(_logits(spark, folder)), "sample_id")


@query
def chunk_loss_sum(spark, folder):
    rows = scoring.with_nll(_logits(spark, folder)).withColumns(
        {"chunk_id": F.expr("pos div 4"), "denominator": F.lit(10)}
    )
    return scoring.chunk_loss_sum(rows, "sample_id", "chunk_id")


@query
def kl_masked(spark, folder):
    return scoring.kl_masked(_teacher_student(spark, folder), ["sample_id"])


@query
def mse_masked(spark, folder):
    return scoring.mse_masked(_teacher_student(spark, folder), ["sample_id"])


@query
def blended_loss(spark, folder):
    both = _teacher_student(spark, folder)
    kl = scoring.criterion("KLDiv")(both, ["sample_id"])
    scored = scoring.with_nll(both, "student", "label")
    ce = scoring.criterion("ce")(scored, ["sample_id"])
    return kl.join(ce, "sample_id").select(
        "sample_id", scoring.blended(F.col("kl"), F.col("loss")).alias("loss")
    )


@query(optional=("truncation",))
def bigram_perplexity(spark, folder):
    return reports.perplexity_samples(_docs(spark, folder), [None], CHUNKS, TOKENS)


@query(optional=("num_instance", "truncation"))
def ppl_report(spark, folder):
    tasks = [C.Task(C.PERPLEXITY, "documents", None, t) for t in TRUNCATIONS]
    return reports.perplexity_report({"documents": _docs(spark, folder)}, tasks, CHUNKS, TOKENS)


@query
def external_scorer(spark, folder):
    """The scorer seam with a stand-in model that knows only id parity."""

    def make():
        return lambda chunks: [[-0.5 if t % 2 else -1.5 for t in c[1:]] for c in chunks]

    plan = planners.perplexity_plan(_docs(spark, folder), CHUNKS, TOKENS, None)
    return scoring.sample_perplexity(scoring.score_chunks_with(plan, make))


@query
def first_result(spark, folder):
    rows = scoring.with_nll(_logits(spark, folder), ignore=None)
    return scoring.first_result(rows, "sample_id", "pos", "nll", "result")


@query(optional=("num_instance", "truncation"))
def copy_report(spark, folder):
    """Report of a copy task: the first result of every sample."""
    rows = scoring.with_nll(_logits(spark, folder), ignore=None)
    first = scoring.first_result(rows, "sample_id", "pos", "nll", "result")
    numbered = mixing.numbered_rows(first, "sample_id").withColumn("task_name", F.lit("copies"))
    tasks = [C.Task(C.AUTO_ENCODING, "copies", None, None), C.Task(C.AUTO_ENCODING, "copies", 10, None)]
    joined = mixing.task_samples(numbered, mixing.tasks_frame(spark, tasks))
    return reports.task_report(joined, CHUNKS.chunk_size, "result")


# --- batches ---------------------------------------------------------------


@query
def pad_batches(spark, folder):
    made = samples.lm_samples(_docs(spark, folder), TOKENS, MIN_LENGTH, MAX_LENGTH)
    return collate.collate(made, 8, seed=SEED, add_position_ids=False)


@query
def pad_nested(spark, folder):
    """Chunks of samples as lists of lists, padded to the longest chunk of a batch."""
    made = samples.lm_samples(_docs(spark, folder), TOKENS, MIN_LENGTH, MAX_LENGTH)
    cut = {"chunks": "input_ids", "chunk_label_ids": "labels", "chunk_attention_mask": "attention_mask"}
    nested = made.select(
        "row_id", *[tk.chunk_arrays(F.col(c), CHUNKS.chunk_size).alias(name) for name, c in cut.items()]
    )
    padded = collate.collate(nested, 8, seed=SEED, add_position_ids=True)
    names = [*cut, "chunk_position_ids"]
    return padded.select("row_id", "batch_id", F.size("chunks").alias("n"), *[F.flatten(c).alias(c) for c in names])


@query
def stacked_batches(spark, folder):
    made = samples.lm_samples(_docs(spark, folder), TOKENS, MIN_LENGTH, MAX_LENGTH)
    stacked = collate.stack_batches(collate.collate(made, 8, seed=SEED), ["input_ids", "row_id"])
    return stacked.select(
        "batch_id",
        "row_id",
        tk.longest(F.col("input_ids")).alias("longest"),
        F.flatten("input_ids").alias("input_ids"),
    )


@query
def position_ids(spark, folder):
    """Left padding to the batch maximum, and a mask with holes."""
    made = samples.lm_samples(_docs(spark, folder), TOKENS, MIN_LENGTH, MAX_LENGTH)
    batches = collate.collate(made, 8, seed=SEED, side="left", add_position_ids=True)
    holes = F.transform("input_ids", lambda x: (x % 3 != 0).cast("int"))
    made = collate.with_position_ids(batches.withColumn("holes", holes), "holes", "with_holes")
    return made.select("row_id", "batch_id", "position_ids", "with_holes")


# --- context ---------------------------------------------------------------


@query
def context_state(spark, folder):
    turns = _arrivals(spark, folder).select("conv_id", "turn", "n_tokens")
    return context.context_state(turns, C.Chunks(64, 2))


@query
def emitted_chunks(spark, folder):
    return context.emitted_chunks(_arrivals(spark, folder), 64)


@query
def stream_chunk_emit(spark, folder):
    schema = _table(spark, folder, "conversations").schema
    # The pattern lets the stream read a single file as well as a folder.
    turns = chunk_stream.read_parquet_stream(spark, f"{folder}/conversations.parquet*", schema)
    ids = turns.select(
        "conv_id", "turn", tk.tokenize(F.col("text"), TOKENS, False).alias("input_ids")
    )
    rows = chunk_stream.run_to_table(chunk_stream.emit_chunks(ids, 64), "chunks")
    return rows.filter(F.col("kind") == "chunk").select("conv_id", "chunk_id", "input_ids")


def _marked_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Arrivals of conversations as a stream; the last turn of each is marked as its end."""
    table = _table(spark, folder, "conversations")
    turns = chunk_stream.read_parquet_stream(spark, f"{folder}/conversations.parquet*", table.schema)
    last = table.groupBy("conv_id").agg(F.max("turn").alias("last"))
    ids = tk.tokenize(F.col("text"), TOKENS, False).alias("input_ids")
    return turns.join(last, "conv_id").select("conv_id", "turn", ids, (F.col("turn") == F.col("last")).alias("ends"))


@query
def stream_gaps(spark, folder):
    """Conversations that lost every third turn: gaps are reported, the rest goes on."""
    turns = _marked_stream(spark, folder).filter((F.col("turn") % 3 != 1) | F.col("ends"))
    rows = chunk_stream.emit_chunks(turns, 64, end="ends", final_end=True)
    return chunk_stream.run_to_table(rows, "gaps")


@query
def stream_reset(spark, folder):
    """What is dropped when a conversation's last turn removes its state."""
    rows = chunk_stream.emit_chunks(_marked_stream(spark, folder), 64, end="ends", report_end=True)
    ended = chunk_stream.run_to_table(rows, "reset").filter(F.col("kind") == "end")
    return ended.select("conv_id", F.col("chunk_id").alias("chunks"), "turn", F.col("input_ids").alias("tail"))


# --- vectors ---------------------------------------------------------------


@query
def vector_mix(spark, folder):
    vectors = _table(spark, folder, "embeddings")
    return parameters.mix_vectors(vectors, "label", "embedding")


@query
def vector_mix_weighted(spark, folder):
    vectors = _table(spark, folder, "embeddings").withColumn(
        "weight", (F.col("vec_id") % 5 + 1) / F.lit(10.0)
    )
    return parameters.mix_vectors(vectors, "label", "embedding", "weight")


@query
def vector_agreement(spark, folder):
    """Names (conversations' roles) whose fixed value differs between turns."""
    turns = _table(spark, folder, "conversations")
    return parameters.disagreeing_names(turns, "conv_id", "role")


@query
def norm_report(spark, folder):
    """Vectors as parameters, the next vector of the table as the update."""
    vectors = _table(spark, folder, "embeddings")
    updates = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("grad"))
    both = vectors.withColumnRenamed("embedding", "param").join(updates, "vec_id", "left")
    return parameters.norm_report(both, "label")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["ppl_report"](spark, folder)



