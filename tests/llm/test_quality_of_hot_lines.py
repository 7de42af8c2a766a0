"""Frequent lines beyond what is broadcast: the hottest apart, the rest by shuffle, verdicts alike."""

from __future__ import annotations

import pytest

from foliant.llm import quality_rules


@pytest.mark.parametrize("most", [0, 1, 3])
def test_verdicts_do_not_depend_on_the_bound(spark, monkeypatch, most):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(25))
    texts = [(i, f"shared line of the host\n{own(i)}\n" + "".join(f"footer {j} of some {'abcdefg'[j]}\n" for j in range(7) if i % (j + 1) == 0), f"s{i % 2}" if i % 9 else None) for i in range(120)]
    texts += [(None, None, None), (7, "", "s1"), (7, "shared line of the host", "s1")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(5)
    kept = lambda: sorted((tuple(r) for r in quality_rules.quality(docs, max_docs=8).collect()), key=repr)
    want = kept()
    assert len(want) == len(texts) and {r[-1] for r in want} > {0, 25}
    found = quality_rules.frequent_lines(docs.withColumnRenamed("source", "host"), 8).collect()
    assert len({(r["host"], r["line"]) for r in found}) == len(found) > 3 and min(r["n"] for r in found) > 8
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", most)
    assert kept() == want
