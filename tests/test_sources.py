"""Readers, writers and the corpus catalog, through files in a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from foliant import config as C
from foliant.operators import sizing
from foliant.plans import prepare
from foliant.sources import readers, sinks
from foliant.sources.catalog import Corpora, Location


def write_lines(path, rows):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), "utf-8")
    return str(path)


def test_json_lines_are_numbered_in_file_order(spark, tmp_path):
    for f, rows in (("a", range(5)), ("b", range(5, 9))):
        write_lines(tmp_path / f"{f}.json", [{"text": f"t{i}"} for i in rows])
    for paths in (f"{tmp_path}/*.json", [f"{tmp_path}/a.json", f"{tmp_path}/b.json"]):
        rows = readers.read_json_lines(spark, paths).orderBy("row_id").collect()
        assert [r.text for r in rows] == [f"t{i}" for i in range(9)]
        assert [r.row_id for r in rows] == list(range(9))
        assert rows[0].source.endswith("a.json") and rows[8].source.endswith("b.json")
    assert readers.read_first(readers.read_json_lines(spark, f"{tmp_path}/*.json"), 6).count() == 6


def test_numbering_over_several_splits_of_a_file(spark, tmp_path):
    path = write_lines(tmp_path / "big.json", [{"text": f"{i:06d}" + "x" * 200} for i in range(4000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        raw = readers.read_json_lines(spark, path, numbered=False)
        assert raw.rdd.getNumPartitions() > 4
        rows = readers.read_json_lines(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.row_id, int(r.text[:6])) for r in rows) == [(i, i) for i in range(4000)]


def test_a_list_keeps_its_order(spark, tmp_path):
    for name, count in (("a", 3), ("b", 2)):
        (tmp_path / f"{name}.json").write_text("".join(f'{{"text": "{name}{k}"}}\n' for k in range(count)))
    rows = readers.read_json_lines(spark, [str(tmp_path / "b.json"), str(tmp_path / "a.json")])
    assert [r["text"] for r in rows.orderBy("row_id").collect()] == ["b0", "b1", "a0", "a1", "a2"]
    assert sorted(r["row_id"] for r in rows.collect()) == list(range(5))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # Texts stay where they are read; only the table of splits is exchanged.
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "text#" in x]


def test_split_json(spark, tmp_path):
    pairs = {s: [{"prompt": f"{s}{i}", "response": "r"} for i in range(3)] for s in ("train", "test")}
    path = tmp_path / "pairs.json"
    path.write_text(json.dumps(pairs, indent=1))
    rows = readers.read_split_json(spark, str(path), "test").collect()
    assert [(r.row_id, r.prompt) for r in rows] == [(0, "test0"), (1, "test1"), (2, "test2")]
    with pytest.raises(ValueError):
        readers.read_split_json(spark, str(path), "valid")


def test_settings(spark, tmp_path):
    task = {"task_type": "perplexity", "task_name": "pg19.test.1m", "num_instance": 10, "truncation": None}
    job = {"train": {"tasks": [task], "corpus": [{"name": "beacons", "partition": 1, "truncation": None}]}}
    (tmp_path / "job.json").write_text(json.dumps(job, indent=4))
    (tmp_path / "tasks.json").write_text(json.dumps([task, task], indent=4))
    (tmp_path / "chunks.json").write_text(json.dumps({"num_memory": 32, "chunk_size": 1024}))
    assert readers.read_tasks(spark, f"{tmp_path}/tasks.json") == [C.Task(**task)] * 2
    assert readers.read_tasks(spark, f"{tmp_path}/job.json") == [C.Task(**task)]
    assert readers.read_mix(spark, f"{tmp_path}/job.json") == [C.MixEntry("beacons", 1.0, None)]
    assert readers.read_chunks(spark, f"{tmp_path}/chunks.json") == C.CHUNKS_32X


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "žluťoučký 漢字")], "row_id bigint, text string")
    sinks.write_json(df, f"{tmp_path}/out")
    written = "".join(p.read_text("utf-8") for p in (tmp_path / "out").glob("*.json"))
    assert "žluťoučký 漢字" in written
    for value in (1.0, 2.0):
        report = spark.createDataFrame([("t", value)], "task_name string, avg double")
        sinks.append_log(report, f"{tmp_path}/log", "evaluate", model="m")
    log = spark.read.json(f"{tmp_path}/log")
    assert log.count() == 2 and {r.command for r in log.collect()} == {"evaluate"}
    assert {"logged_at", "model", "avg"} <= set(log.columns)
    feed = spark.range(25).select(F.col("id").alias("step"), F.lit(0).alias("seq"))
    sinks.write_feed(feed, f"{tmp_path}/feed", 10)
    assert {p.name for p in (tmp_path / "feed").glob("step_range=*")} == {f"step_range={i}" for i in range(3)}


def test_settle_writes_to_the_shared_folder(spark):
    df = sizing.settle(spark.range(10).withColumnRenamed("id", "x"))
    assert df.count() == 10
    assert sizing.shared_dir(spark) in df.inputFiles()[0]


# --- catalog ---------------------------------------------------------------

LONG = "word " * 40000


@pytest.fixture(scope="module")
def corpora(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("corpora")

    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{base}/{name}")
        return f"{base}/{name}"

    def lines(name, rows):
        return write_lines(base / f"{name}.json", rows)

    def splits(name):
        data = {s: [{"prompt": f"{s} p", "response": f"{s} r"}] for s in ("train", "test")}
        (base / f"{name}.json").write_text(json.dumps(data))
        return f"{base}/{name}.json"

    text = [{"text": f"line {i} " + LONG} for i in range(3)]
    pairs = [{"input": f"ask {i}", "output": f"say {i}"} for i in range(4)]
    split_text = "row_id bigint, text string, split string"
    docs = [(0, "zero " + LONG, "train"), (1, "one", "test"), (2, "two " + LONG, "train")]
    article = [" \n", " = A = \n", " " + "x" * 150 + " \n", " = B = \n", " short \n"]
    news = "row_id bigint, story string, questions array<string>, answers array<array<string>>, summary string, split string"
    return Corpora(
        spark,
        {
            "minipile": table("minipile", docs, split_text),
            "wikitext103": table(
                "wiki",
                [(i, t, "train") for i, t in enumerate(article)],
                "line_no bigint, text string, split string",
            ),
            "pg19": Location(table("pg19", docs, split_text)),
            "proof-pile": lines("proof", text),
            "code-parrot": lines("code", text),
            "longdata-corpus": table("longdata", [(0, "a-----b abcabc " + LONG)], "row_id bigint, text string"),
            "longalpaca": table(
                "alpaca", [(0, "do", "done", "train")], "row_id bigint, instruction string, output string, split string"
            ),
            "minipile-copy-256": splits("c256"),
            "minipile-copy-2k": splits("c2k"),
            "minipile-copy-4k": splits("c4k"),
            "redpajama-sample-1t": table(
                "rp1t",
                [(0, "paper " + LONG, '{"arxiv_id": "1"}'), (1, "web", '{"url": "u"}')],
                "row_id bigint, text string, meta string",
            ),
            "redpajama-book-sample": lines("books", text),
            "redpajama-v2": table(
                "rpv2",
                [(0, "hello", "en", "train"), (1, "bonjour", "fr", "train")],
                "row_id bigint, raw_content string, lang string, split string",
            ),
            "news-qa-summarization": table(
                "news", [(5, "story", ["q"], [["a", "b"]], "sum", "train")], news
            ),
            "redpajama-sample": lines("rps", text),
            "longalpaca-lines": lines("las", pairs),
        },
        min_length=2,
        per_source=2,
    )


K128, K256, M1 = 128 * 1024, 256 * 1024, 1024 * 1024


@pytest.mark.parametrize(
    "spec, rows, tag, column, longest",
    [
        ("minipile.train", 2, "language modeling", "text", None),
        ("wikitext103.train", 1, "language modeling", "text", 150),
        ("PG19.train.128k", 2, "language modeling", "text", K128),
        ("pg19.test.256k", 1, "language modeling", "text", 3),
        ("pg19.train", 2, "language modeling", "text", 5 + len(LONG)),
        ("proof-pile.1m", 3, "language modeling", "text", 7 + len(LONG)),
        ("code-parrot", 3, "language modeling", "text", 7 + len(LONG)),
        ("longdata-corpus.128k", 1, "language modeling", "text", K128),
        ("longdata-corpus copy.128k", 1, "longdata copy", "text", K128),
        ("longalpaca.train.true", 1, "question answering", "prompt", 2),
        ("longalpaca.train.false.deepspeed", 1, "question answering", "response", 4),
        ("minipile copy 256.train", 1, "auto encoding", "prompt", 7),
        ("minipile copy 2k.test", 1, "auto encoding", "response", 6),
        ("minipile copy 4k.test", 1, "auto encoding", "response", 6),
        ("memory util 2k.train", 1, "memory utilization", "text", 7),
        ("redpajama arxiv sample.train.128k", 1, "language modeling", "text", K128),
        ("redpajama book sample.train.128k", 3, "language modeling", "text", K128),
        ("redpajama v2.train", 1, "language modeling", "text", 5),
        ("newsqasum.train.lm", 1, "news qa summation", "disturb", K128),
        ("newsqasumv2", 1, "news qa summation v2", "disturb", K128),
        ("beacons", 7, None, "text", 7 + len(LONG)),
    ],
)
def test_corpora(corpora, spec, rows, tag, column, longest):
    df = corpora.read(spec)
    assert df.count() == rows
    if tag:
        assert {r.task_type for r in df.select("task_type").distinct().collect()} == {tag}
    if longest:
        assert df.agg(F.max(F.length(column))).first()[0] == longest


def test_corpus_details(corpora):
    assert corpora.read("longalpaca.train.true").first().train_prompt is True
    assert corpora.read("beacons").filter("task_type = 'question answering'").first().train_prompt is False
    cleaned = corpora.read("longdata-corpus.128k").first().text
    assert cleaned.startswith("a----b abc ")
    assert len(corpora.names) == 19
    # Row 5 meets distractor 5 mod 2 of the two training books.
    assert corpora.read("newsqasum.train.distill").first().disturb.startswith("two ")


def test_sampled_corpus(corpora):
    both = corpora.read("beacons sampled.64")
    rows = both.collect()
    assert [sum(r.part == p for r in rows) for p in (0, 1)] == [2, 2]
    assert all(len(r.input_ids) <= 66 and not r.distill for r in rows)
    assert {r.task_type for r in rows} == {"activation beacons"}
    only = corpora.read("beacons sampled.64.no_alpaca.distill").collect()
    assert len(only) == 2 and all(r.distill for r in only)


@pytest.mark.parametrize(
    "spec",
    [
        "unknown",
        "minipile",
        "minipile.train.1m.x",
        "longalpaca.train.yes",
        "minipilecopy256.valid",
        "redpajamav2.test",
        "redpajamaarxivsample.train",
        "redpajamabooksample.train.2m",
        "newsqasum.train.kl",
        "beaconssampled.64.some",
        "longdata-corpuscopy.1m",
    ],
)
def test_wrong_specs(corpora, spec):
    with pytest.raises(ValueError):
        corpora.read(spec)


def test_prepared_files(spark, tmp_path):
    texts = write_lines(tmp_path / "a.json", [{"text": "w " * n} for n in (1, 5, 6, 7, 8)])
    pairs = write_lines(tmp_path / "b.json", [{"input": "ask me", "output": "say so"}] * 2)
    made = prepare.training_samples(spark, [texts, pairs], max_length=20, min_length=4, max_per_source=3)
    rows = made.collect()
    assert [sum(r.source.endswith(f) for r in rows) for f in ("a.json", "b.json")] == [3, 2]
    assert all(r.labels[-1] == 2 for r in rows if r.source.endswith("b.json"))
    tested = prepare.evaluation_samples(spark, [texts, pairs], max_length=20, min_length=4, max_rows=6)
    rows = tested.orderBy("index").collect()
    assert [r["index"] for r in rows] == [1, 2, 3, 4, 5]
    assert rows[-1].labels is None and rows[-1].length == 3
    assert prepare.training_samples(spark, None) is None


def test_a_repeated_run_is_logged_once(spark, tmp_path):
    report = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "task string, avg double")
    path = f"{tmp_path}/log"
    for run, scale in (("one", 1), ("two", 1), ("one", 5)):
        sinks.append_log(report.withColumn("avg", F.col("avg") * scale), path, "evaluate", run=run)
    rows = spark.read.json(path).orderBy("run", "task").collect()
    assert [(r.run, r.task, r.avg) for r in rows] == [("one", "a", 5.0), ("one", "b", 10.0), ("two", "a", 1.0), ("two", "b", 2.0)]
    sinks.append_log(report, f"{tmp_path}/plain", "evaluate")
    sinks.append_log(report, f"{tmp_path}/plain", "evaluate")
    assert spark.read.json(f"{tmp_path}/plain").count() == 4
