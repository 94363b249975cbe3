"""Every stage of the pipeline on its own input, against plain versions."""

import random

import brute
import pytest

import corpus_pipeline
from pulsegrid.llm.shared import cut


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "tu"]) for _ in range(rng.randint(1, 4)))
    shared = " ".join(word() for _ in range(60))
    docs = [" ".join(word() for _ in range(rng.randint(40, 160))) for _ in range(150)]
    docs += docs[:10] + [d + " " + shared for d in docs[20:30]] + [" ".join(x + "###" for x in d.split()) for d in docs[30:40]] + ["too short", None, ""]
    d = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en" if i % 2 else "de", f"src{i % 3}", len(t or "")) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return str(d)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    by = [docs]
    for _, stage in corpus_pipeline.STAGES:
        by.append(cut(stage(spark, by[-1], sf_dir)))
    good, one, without, mixed, tokens = ({r.doc_id: r for r in x.collect()} for x in by[1:])
    assert all(x.columns == columns for x in by[1:5])
    assert set(good) == set(range(170))
    assert set(one) == set(range(150)) | set(range(160, 170))
    given = [(i, r.text) for i, r in one.items()]
    removed = {i: n for i, _, n, _ in brute.substring(given)}
    for i, r in without.items():
        assert len(r.text.split()) == len(one[i].text.split()) - removed[i]
        assert removed[i] or r.text == one[i].text
        assert r.n_chars == len(r.text)
    assert sum(removed.values()) >= 600
    assert set(mixed) <= set(without)
    total = sum(len(r.text.split()) for r in without.values())
    taken = sum(len(r.text.split()) for r in by[4].collect())
    assert 0.6 * total < taken <= 0.9 * total + 1
    assert set(tokens) == set(mixed)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() > 100
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_run_on_nothing_and_on_nulls(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i if i % 5 else None, words(i), "en" if i % 2 else None, None if i % 3 else "s", 1) for i in range(80)] + [(None, None, None, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/nulls/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/nulls").collect()
    assert 40 < len(out) <= 80 and all(r.n_tokens > 60 for r in out)
