"""The language model apart from the texts it scores: broadcast or asked by bucket, written and read, rows sent."""

from __future__ import annotations

import random

import pytest

from foliant.llm import language_id, lm_scoring

R = random.Random(11)
VOCAB = ["".join(R.choice("abcdefghij") for _ in range(R.randrange(2, 7))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(R.choice(VOCAB) for _ in range(n))


TEXTS = [None, "", " \n", "NEW words Only", prose(5000)] + [prose(R.randrange(1, 200)) for _ in range(60)]
TEXTS += TEXTS[-3:]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a row without an id", "x"), (7, TEXTS[9], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, bucket string").repartition(4)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_scores_are_the_same_where_the_filter_is_not_broadcast(docs, monkeypatch):
    own = language_id.held_out("doc_id", 7)
    near = rows(lm_scoring.score(docs, own))
    monkeypatch.setattr(lm_scoring, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 2000)
    assert len(near) == len(TEXTS) + 2
    assert [r[:5] for r in rows(lm_scoring.score(docs, own))] == [r[:5] for r in near]
    for a, b in zip(near, rows(lm_scoring.score(docs, own))):
        assert a[5:] == pytest.approx(b[5:], rel=1e-12)


@pytest.mark.parametrize("most", [-1, 1 << 30])
def test_a_written_model_scores_other_documents(spark, docs, tmp_path, monkeypatch, most):
    monkeypatch.setattr(lm_scoring, "BROADCAST_BYTES", most)
    lm_scoring.fit(docs).write.parquet(str(tmp_path / "model"))
    model = spark.read.parquet(str(tmp_path / "model"))
    other = spark.createDataFrame([("a", TEXTS[10]), ("b", "zzz qqq xxx"), ("c", None)], "name string, body string")
    got = {r["doc_id"]: r for r in lm_scoring.apply(other, model, "name", "body").collect()}
    alone = {r["doc_id"]: r["score"] for r in lm_scoring.apply(docs, model).collect()}
    assert got["a"]["score"] == pytest.approx(alone[10], rel=1e-12) and got["a"]["n_known"] == got["a"]["n_tokens"]
    assert (got["b"]["n_tokens"], got["b"]["n_known"]) == (4, 1) and got["b"]["score"] < -8
    assert got["c"]["n_tokens"] == 1 and all(r["held_out"] is None for r in got.values())


def test_a_model_of_nothing_gives_probability_one(spark, docs):
    model = lm_scoring.fit(docs.where("false"))
    assert model.count() == 0
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in lm_scoring.apply(docs, model).collect()} == {(0, 0, 0.0, 0.0)}
