"""Settings files to results, and the guards of vector mixes."""

import json

import pytest

from foliant import config as C
from foliant.operators import parameters
from foliant.plans import jobs
from foliant.sources.catalog import Corpora


@pytest.fixture
def corpora(spark, tmp_path):
    rows = [(f"w{k} " * 3 + " ".join(f"v{j}" for j in range(k % 9 + 2)), "train") for k in range(12)]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id bigint, text string, split string").write.parquet(
        str(tmp_path / "minipile")
    )
    return Corpora(spark, {"minipile": str(tmp_path / "minipile")})


def settings(tmp_path, tasks, mix):
    path = tmp_path / "job.json"
    path.write_text(json.dumps({"train": {"tasks": tasks, "corpus": mix}}))
    return str(path)


def task(n, truncation):
    return {"task_type": C.PERPLEXITY, "task_name": "minipile.train", "num_instance": n, "truncation": truncation}


def test_report(spark, corpora, tmp_path):
    path = settings(tmp_path, [task(5, 8), task(5, None)], [])
    rows = jobs.evaluation_report(spark, path, corpora, C.Chunks(4, 1)).collect()
    assert len(rows) == 2 and all(r["samples"] == 5 for r in rows)
    with pytest.raises(ValueError, match="12 rows"):
        jobs.evaluation_report(spark, settings(tmp_path, [task(99, 8)], []), corpora, C.Chunks(4, 1))


def test_feed(spark, corpora, tmp_path):
    path = settings(tmp_path, [], [{"name": "minipile.train", "partition": 1.0, "truncation": None}])
    rows = jobs.job_feed(spark, path, corpora, 10, C.Chunks(4, 1)).collect()
    assert {r["step"] for r in rows} == set(range(10))


def test_mix_guards(spark):
    df = spark.createDataFrame(
        [("a", "m1", [1.0], 1), ("a", "m2", [3.0], 1), ("b", "m1", [1.0], None), ("b", "m2", [1.0], 2)],
        "name string, model string, vector array<double>, n int",
    )
    assert {r["name"]: r["value"] for r in parameters.mix_vectors(df, "name", "vector", model="model").collect()} == {
        "a": 2.0, "b": 1.0,
    }
    with pytest.raises(ValueError, match="differ for"):
        parameters.mix_vectors(df, "name", "vector", fixed="n")
    with pytest.raises(ValueError, match="names differ"):
        parameters.mix_vectors(df.filter("name = 'a' OR model = 'm1'"), "name", "vector", model="model")
