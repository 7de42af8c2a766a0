"""Spelling variants, whitening and MinHash near-duplicates against plain versions; nulls, empties, ties, repeats, long texts."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import brute
import numpy as np
import pytest

from foliant.llm import minhash, registry, spelling, whitening

R = random.Random(11)
CLASH = "doc_id long, text string, word string, n long, key long, root string, token long, pattern boolean, len int, sketch string, v string, w string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "z", 0, 0, "z", 0, True, 0, "z", "z", "z") for i, t in docs], CLASH).repartition(3)


# -- spelling variants -------------------------------------------------------------------------------------------------


def near_by_definition(u: str, v: str) -> bool:
    return u != v and abs(len(u) - len(v)) <= 1 and brute.edit_distance(u, v) == 1


def plain_variants(docs):
    count = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 5:
                count[run] += 1
    count = {w: n for w, n in count.items() if n >= 3}
    near = {w: [x for x in count if near_by_definition(w, x)] for w in count}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 2 * count[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), None if form[w] is None else count[form[w]]) for w, n in count.items()), near


def slips(word: str) -> str:
    k = R.randrange(len(word))
    return word[:k] + R.choice(["", word[k] + R.choice("aeé"), R.choice("xyzÿ")]) + word[k + 1 :]


def spelling_docs():
    stems = ["".join(R.choice("abcdeéÀ") for _ in range(R.randrange(5, 13))) for _ in range(30)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abcde" * 20]
    words = [w for s in stems for w in [s] * R.randrange(3, 40) + [slips(s) for _ in range(20)] * 3]
    words += [slips(slips(s)) for s in stems for _ in range(6)] * 4
    R.shuffle(words)
    docs = [(k, " ".join(words[k * 50 : k * 50 + 50])) for k in range(-(-len(words) // 50))]
    return [*docs, (7, docs[0][1]), (None, docs[1][1].upper()), (9001, None), (9002, ""), (9003, "x1y2 ×÷ a"), (9004, "Straße,straße;STRAßE")]


@pytest.mark.parametrize("hot", [2, 256])
def test_spelling_variants(spark, hot):
    docs = spelling_docs()
    want, _ = plain_variants(docs)
    got = sorted(tuple(r) for r in spelling.variants(frame(spark, docs), hot=hot).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert len(want) > 100 and any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)
    assert got == want


def test_near_words_are_met_once_each_way(spark):
    _, near = plain_variants(spelling_docs())
    words = spark.createDataFrame([(w, 3) for w in near], "word string, n long")
    got = Counter((r["word"], r["near"]) for r in spelling.near_words(words, hot=1, shard_rows=50).collect())
    assert got == Counter((w, x) for w, own in near.items() for x in own)


@pytest.mark.parametrize("u,v", [("abcde", "abcde"), ("abcde", "abxde"), ("abcde", "abcdef"), ("abcde", "xabcde"), ("abcde", "abdce"), ("aaaaa", "aaaaaa"), ("abcde", "axcxe"), ("éabcd", "eabcd")])
def test_one_edit(u, v):
    assert spelling.one_edit(u, v) == near_by_definition(u, v)


def test_chains_of_forms_and_empty_tables(spark):
    docs = [(1, " ".join(["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["abbbb"] * 48))]
    want, _ = plain_variants(docs)
    assert sorted(tuple(r) for r in spelling.variants(frame(spark, docs)).collect()) == want
    assert {r[2] for r in want} == {"abbbb"}
    assert spelling.variants(frame(spark, [(1, None)]).limit(0)).collect() == []
    assert spelling.variants(frame(spark, [(1, None), (2, "")])).collect() == []


# -- whitening ---------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, n long, v string, deviation int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "z", 0) for i, v in rows], VECTORS).repartition(5)


def plain_whitening(rows, k=8):
    """In exact fractions up to the covariance."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(kept), len(kept[0][1])
    x = np.array([v for _, v in kept], object)
    s = x.sum(0)
    apart = n * x - s
    covariance = np.array([[float(Fraction(int((apart[:, i] * apart[:, j]).sum()), n**3)) for j in range(d)] for i in range(d)])
    values, vecs = np.linalg.eigh(covariance)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    white = (apart / n).astype(float) @ vecs / np.sqrt(values)
    return {i: (int((a * a).sum()), w) for (i, _), a, w in zip(kept, apart.tolist() and apart, white)}, n, values / np.trace(covariance)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    mixing = rng.normal(size=(12, 12))
    rows = [(k, [float(c) for c in rng.normal(size=12) @ mixing + 300]) for k in range(150)]
    rows += [(200, rows[0][1]), (201, None), (202, [None] + rows[1][1][1:]), (203, [math.nan] + rows[1][1][1:]), (204, [math.inf] + rows[1][1][1:]), (205, []), (206, [1.0, 2.0])]
    want, n, shares = plain_whitening(rows[:151])
    got = whitening.summary(vectors(spark, rows)).collect()
    assert len(got) == 8 * n == 8 * 151 and {r["vec_id"] for r in got} == set(want)
    signs = {}
    for r in got:
        deviation, white = want[r["vec_id"]]
        k = r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation
        assert r["explained"] == pytest.approx(shares[k], rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-9
        assert abs(r["whitened"]) == pytest.approx(abs(white[k]), abs=1e-7)
        if abs(white[k]) > 1e-3:
            assert signs.setdefault(k, math.copysign(1, r["whitened"] * white[k])) == math.copysign(1, r["whitened"] * white[k])
    assert len({r["identity_error"] for r in got}) == 1


def test_scatter_is_exact(spark):
    rng = np.random.default_rng(5)
    for most in (10, 2**30, 2**58):
        y = rng.integers(-most, most, (300, 5))
        big = y.astype(object)
        assert (whitening.exact_products(y) == big.T @ big).all()
    rows = [(k, [float(rng.integers(-(2**40), 2**40)) for _ in range(3)]) for k in range(40)]
    valid = whitening.valid_vectors(vectors(spark, rows), "vec_id", "embedding")
    n, sums, products = whitening.scatter(valid, 3)
    y = np.array([[math.floor(1024 * float(np.float32(c))) for c in v] for _, v in rows], object)
    assert n == 40 and sums == y.sum(0).tolist() and (products == y.T @ y).all()


def test_whitening_sums_meet_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(30)]
    valid = whitening.valid_vectors(vectors(spark, rows).repartition(9), "vec_id", "embedding")
    n, sums, _ = whitening.scatter(valid, 4)
    assert (n, sums) == (30, np.array([[math.floor(1024 * float(np.float32(c))) for c in v] for _, v in rows], object).sum(0).tolist())


def test_whitening_without_spread_and_without_rows(spark):
    alike = whitening.summary(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(alike) == 6 and {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alike} == {(0, None, None, None)}
    line = whitening.summary(vectors(spark, [(k, [float(k), float(2 * k)]) for k in range(9)])).collect()
    assert {r["component"] for r in line if r["whitened"] is None} == {2} and all(r["identity_error"] < 1e-9 for r in line)
    empty = whitening.summary(vectors(spark, [(1, None), (2, [math.nan, 1.0])]))
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_deviation_beyond_a_long_is_a_decimal(spark):
    rows = vectors(spark, [(k, [float(k) * 1e12, 0.0]) for k in range(4)])
    assert {r["deviation"] for r in whitening.summary(rows).collect()} == {None}
    x = [math.floor(1024 * float(np.float32(k * 1e12))) for k in range(4)]
    assert {int(r["deviation"]) for r in whitening.whiten(rows).collect()} == {(4 * a - sum(x)) ** 2 for a in x}


# -- MinHash -----------------------------------------------------------------------------------------------------------


def minhash_docs():
    vocabulary = ["".join(R.choice("abcdefgh") for _ in range(R.randrange(2, 7))) for _ in range(400)]
    prose = lambda n: [R.choice(vocabulary) for _ in range(n)]
    texts: list[str | None] = [None, "", " \n", "one", "ONE", "one two", "one two\tthree", prose(5000)]
    for _ in range(8):
        base = prose(R.randrange(20, 150))
        texts += [base, base, [w.upper() for w in base]]
        for _ in range(8):
            other = list(base)
            for _ in range(R.randrange(1, 2 + len(base) // 9)):
                other[R.randrange(len(other))] = R.choice(vocabulary)
            texts.append(other)
    texts += [prose(R.randrange(3, 60)) for _ in range(30)]
    docs = list(enumerate((" ".join(t) if isinstance(t, list) else t for t in texts), 5))
    return [*docs, docs[-1], (None, docs[10][1]), (None, "nobody else says this"), (None, None)]


def plain_near_duplicates(docs):
    sets = []
    for _, t in docs:
        w = brute.SPACE.findall((t or "").translate(brute.LOWER))
        sets.append({tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set())
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and (sets[a] == sets[b] or None not in (docs[a][0], docs[b][0])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(sets[k]), least.get(top(k)), i == least.get(top(k))) for k, (i, _) in enumerate(docs)), key=repr)


@pytest.mark.parametrize("block", [4, 4096])
def test_near_duplicates(spark, block):
    docs = minhash_docs()
    want = plain_near_duplicates(docs)
    got = minhash.near_duplicates(frame(spark, docs), block=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sum(not r[3] for r in want) > 40


def test_near_duplicates_around_the_threshold(spark):
    """n shared shingles of n + d on each side: 80 percent at n = 8 d."""
    docs, k = [], 0
    for d in range(1, 12):
        for n in (8 * d - 1, 8 * d, 8 * d + 1):
            shared = [f"s{d}x{n}x{j}" for j in range(n + 1)]
            docs += [(k + e, " ".join(shared + [f"t{k}x{e}x{j}" for j in range(d)])) for e in range(2)]
            k += 2
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, docs)).collect()}
    for k in range(0, len(docs), 6):
        assert [got[k + j] - k for j in range(6)] == [0, 1, 2, 2, 4, 4]


def test_empty_tables_and_links_of_none(spark):
    assert minhash.near_duplicates(frame(spark, [(1, "a b c")]).limit(0)).collect() == []
    assert [tuple(r) for r in minhash.near_duplicates(frame(spark, [(1, "a b c"), (2, "d e f g")])).orderBy("doc_id").collect()] == [(1, 2, 1, True), (2, 3, 2, True)]


def hashes(n: int, rng) -> np.ndarray:
    return rng.integers(0, 2**64, n, dtype=np.uint64)


def test_samples_and_sketches_tell_similarities():
    rng = np.random.default_rng(1)
    met, guesses, most = [], [], minhash.most_differing(80)
    for _ in range(300):
        both, x, y = hashes(240, rng), hashes(30, rng), hashes(30, rng)
        least = np.stack([minhash.samples(np.unique(np.concatenate([both, z]))) for z in (x, y)])
        bits = minhash.odd_sketches(least)
        differing = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        assert differing <= most and differing <= 2 * int((least[0] != least[1]).sum())
        met.append((least[0] == least[1]).mean())
        guesses.append(minhash.estimate(differing))
    assert abs(np.mean(met) - 0.8) < 0.01 and abs(np.mean(guesses) - 0.8) < 0.01
    assert np.std(met) < 1.3 * math.sqrt(0.16 / minhash.SAMPLES)  # as independent as samples of a binomial
    far = [minhash.odd_sketches(np.stack([minhash.samples(hashes(200, rng)) for _ in range(2)])) for _ in range(50)]
    assert all(np.bitwise_count(b[0] ^ b[1]).sum() > most for b in far)


def test_set_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(4)
    for n in (1, 30, 400, 3000):
        both, x, y = hashes(n, rng), hashes(n // 4, rng), hashes(n // 7, rng)
        s, t = (np.unique(np.concatenate([both, z])) for z in (x, y))
        assert int(np.bitwise_count(minhash.set_sketch(s) ^ minhash.set_sketch(t)).sum()) <= len(x) + len(y)


def test_sketch_bound_is_a_binomial_tail():
    rng = np.random.default_rng(2)
    loose = minhash.most_differing(80, 0.01)
    differ = rng.binomial(minhash.SAMPLES, 0.2, 20_000)
    bits = [int((np.bincount(rng.integers(0, minhash.BITS, 2 * d), minlength=minhash.BITS) & 1).sum()) for d in differ]
    assert 0.002 < np.mean(np.array(bits) > loose) <= 0.013
    assert loose < minhash.most_differing(80) < minhash.most_differing(60)


def test_queries_are_registered(spark, tmp_path):
    frame(spark, [(1, "aaaaa aaaaa aaaaa b"), (2, "aaaaa aaaaa aaaaa b")]).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    vectors(spark, [(k, [float(k), 1.0]) for k in range(3)]).select("vec_id", "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = {name: registry.QUERIES[name](spark, str(tmp_path)).collect() for name in ("op11_spelling_variants", "op12_whitening", "op13_minhash")}
    assert [tuple(r) for r in rows["op11_spelling_variants"]] == [("aaaaa", None, "aaaaa", 6, 0, None)]
    assert len(rows["op12_whitening"]) == 6 and {r["component_id"] for r in rows["op13_minhash"]} == {1}
