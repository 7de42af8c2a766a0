"""Sequences stay near the fewest possible however many tasks the input comes in."""

from __future__ import annotations

import random

from foliant.llm import packing

R = random.Random(31)
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]


def test_sequences_of_many_tasks(spark, monkeypatch):
    texts = [" ".join(R.choice(WORDS) for _ in range(R.randrange(5, 400))) for _ in range(600)] + [None, "", "alpha " * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts, merge_rows in ((1, 50_000), (60, 50_000), (60, 200)):
        monkeypatch.setattr(packing, "MERGE_ROWS", merge_rows)
        placed = packing.place(docs.repartition(parts)).collect()
        total = sum(r["length"] for r in placed)
        spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in placed)
        for a, b in zip(spans, spans[1:]):
            assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)
        assert spans[0][1] == 0 and max(o + n for _, o, n in spans) <= 4096
        fewest = -(-total // 4096)
        assert len({s for s, *_ in spans}) <= fewest + max(2, fewest // 50) + (merge_rows < 1000) * 4, (parts, merge_rows)
        assert {r["doc_id"] for r in placed} == set(range(len(texts)))
