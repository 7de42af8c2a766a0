"""Rows with null or repeated ids, and columns with the operators' own names, for operators that look at each row by itself."""

from __future__ import annotations

import random

import pytest

from foliant.llm import language_id, lm_scoring, packing, pii, quality_rules, token_counts

R = random.Random(21)
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
TEXT = "write to a.b@c.org now " + " ".join(R.choice(WORDS) for _ in range(40))
OTHER = " ".join(R.choice(WORDS) for _ in range(60))
CLASH = "doc_id long, text string, lang string, source string, n_tokens long, held_out boolean, score double, spans string, bin long, task long, word string, piece int, n_words long, lang_pred string, kept boolean"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "aa" if t == TEXT else "bb", "s", 0, True, 0.0, "z", 0, 0, "z", 0, 0, "z", False) for i, t in [(1, TEXT), (2, OTHER), (None, TEXT), (None, OTHER), (1, TEXT), (3, None), (None, None), (4, ""), (5, TEXT), (6, OTHER), (8, TEXT), (9, OTHER)]]
    return spark.createDataFrame(rows, CLASH).repartition(3)


def of_null_ids(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect() if r["doc_id"] is None), key=repr)


def alike(df, *cols):
    """Rows with null ids have the values of rows with the same text and an id; all rows are there."""
    got = df.collect()
    assert len(got) == 12 and sum(r["doc_id"] == 1 for r in got) == 2
    known = {r["doc_id"]: tuple(r[c] for c in cols) for r in got if r["doc_id"] is not None}
    assert of_null_ids(df, *cols) == sorted((known[k] for k in (1, 2, 3)), key=repr)


def test_token_counts(docs):
    alike(token_counts.count_tokens(docs), "n_bytes", "n_tokens", "over_limit")


def test_personal_data(docs):
    alike(pii.summary(docs), "n_email", "base_sha256", "spans")


def test_quality(docs):
    alike(quality_rules.quality(docs), "n_words", "word_chars", "base_failed", "kept")


def test_language(docs):
    alike(language_id.identify(docs), "lang_pred", "score")


def test_scores(docs):
    alike(lm_scoring.score(docs, language_id.held_out("doc_id", 7)), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def test_packing(docs):
    placed = packing.place(docs)
    assert placed.count() == 12
    alike(placed, "piece", "start", "length", "ids_crc32")
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in placed.collect())
    assert all(b[1] == a[1] + a[2] for a, b in zip(spans, spans[1:]) if a[0] == b[0])
