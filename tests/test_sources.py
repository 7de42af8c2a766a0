"""Reading and writing a run's files."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from foliant.errors import Refusal
from foliant.operators import scoring, work
from foliant.sources import runs


@pytest.fixture
def corpus(tmp_path):
    for d in ("images", "transcripts"):
        (tmp_path / "corpus" / d).mkdir(parents=True)
    rows = []
    for case in ("CASE001_invoices", "CASE002_invoices"):
        (tmp_path / "corpus/images" / f"{case}.png").write_bytes(case.encode())
        (tmp_path / "corpus/transcripts" / f"{case}.md").write_text("# TAX INVOICE\n")
        rows.append({"image": f"images/{case}.png", "transcript": f"transcripts/{case}.md", "doc_type": "invoices", "sha256": hashlib.sha256(case.encode()).hexdigest()})
    (tmp_path / "corpus/transcripts/._CASE001_invoices.md").write_text("junk")
    (tmp_path / "corpus/manifest.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    for system in ("one", "two"):
        own = tmp_path / "predictions" / system
        (own / "_truncated").mkdir(parents=True)
        (own / "_truncated/CASE009_invoices.md").write_text("cut")
        (own / "CASE001_invoices.md").write_text("# TAX INVOICE\n")
        (own / "_timing.json").write_text(json.dumps({"cards": 1, "shard": 0, "shards": 1, "images": 2, "inference_seconds": 3}))
    (tmp_path / "predictions/one/CASE002_invoices.md").write_text("# TAX INVOICE\n")
    (tmp_path / "predictions/two/_unproduced.json").write_text(json.dumps({"reason": "too long", "pages": ["CASE002_invoices"]}))
    return tmp_path


def test_a_run_scores_end_to_end(spark, corpus):
    truth, pred = runs.transcripts(spark, f"{corpus}/corpus"), runs.predictions(spark, f"{corpus}/predictions")
    assert truth.count() == 2 and pred.count() == 3
    p = scoring.pairs(truth, pred, runs.unproduced(spark, f"{corpus}/predictions"))
    got = {(r["system"], r["stem"][:7]): r["strict_cer"] for r in scoring.character_facts(p).collect()}
    assert got == {("one", "CASE001"): 0.0, ("one", "CASE002"): 0.0, ("two", "CASE001"): 0.0, ("two", "CASE002"): 1.0}


def test_hidden_sidecars_are_read(spark, corpus):
    t = runs.timing(spark, f"{corpus}/predictions")
    assert sorted((r["system"], r["images"], r["inference_seconds"]) for r in t.collect()) == [("one", 2, 3.0), ("two", 2, 3.0)]
    assert runs.unproduced(spark, f"{corpus}/corpus").count() == 0
    (corpus / "predictions/one/_timing.shard1.json").write_text("{")
    with pytest.raises(Refusal, match="not JSON"):
        runs.timing(spark, f"{corpus}/predictions")


def test_tampered_images_are_refused(spark, corpus):
    m = runs.manifest(spark, f"{corpus}/corpus/manifest.jsonl")
    assert m.count() == 2 and m.where("family is null").count() == 2
    hashes = lambda: runs.content_hashes(spark, f"{corpus}/corpus/images/*")
    runs.refuse_tampered(m, hashes())
    (corpus / "corpus/images/CASE002_invoices.png").write_bytes(b"else")
    with pytest.raises(Refusal, match="not the one"):
        runs.refuse_tampered(m, hashes())


def test_images_are_paired_by_suffix(spark):
    images = spark.createDataFrame([("/a/x.jpg",), ("/a/x.png",), ("/a/y.jpeg",), ("/a/z.txt",)], "path string")
    assert {(r["stem"], r["path"]) for r in runs.image_for_stem(images).collect()} == {("x", "/a/x.png"), ("y", "/a/y.jpeg")}


def test_reports_have_systems_as_keys(spark, tmp_path):
    doc = {"stem": "CASE001_invoices", "strict_cer": 0.5, "amounts": 3, "columns_match": True}
    (tmp_path / "scores_a.json").write_text(json.dumps({"corpus": "c", "systems": {"s-2": {"strict": {"cer": 0.5, "wer": 1.0, "distance": 7}, "documents": [doc]}, "s.3": {"documents": []}}}, indent=2))
    read = runs.reports(spark, f"{tmp_path}/scores_*.json")
    assert {r["system"] for r in read.collect()} == {"s-2", "s.3"}
    d = runs.report_documents(read).first()
    assert (d["system"], d["stem"], d["amounts"], d["prompt_sha256"]) == ("s-2", "CASE001_invoices", 3, None)


def test_a_scored_run_is_read_back_with_its_tier_and_timing(spark, corpus):
    labels = {"family": "scan", "severity": "heavy"}
    path = corpus / "corpus/manifest.jsonl"
    with pytest.raises(Refusal, match="no family"):
        runs.tiers(spark, [f"{corpus}/corpus"])
    path.write_text("\n" + json.dumps({"image": "images/a.png", **labels}) + "\n" + json.dumps({"image": "images/b.png", "family": "photo", "severity": "light"}) + "\n")
    (corpus / "predictions/one/_prompt_provenance.json").write_text(json.dumps({"sha256": "21ea"}))
    facts = runs.score(spark, f"{corpus}/corpus", f"{corpus}/predictions", f"{corpus}/out")
    assert facts.count() == 4
    read = runs.reports(spark, f"{corpus}/out/reports", multi_line=False)
    rates = {r["system"]: (r["strict"]["cer"], r["strict"]["distance"], r["prompt_sha256"], len(r["documents"])) for r in read.collect()}
    assert rates == {"one": (0.0, 0, "21ea", 2), "two": (0.5, len("# TAX INVOICE\n"), None, 2)}
    rows = runs.with_tiers(runs.report_documents(read), runs.tiers(spark, [f"{corpus}/corpus"]))
    assert {(r["family"], r["severity"]) for r in rows.collect()} == {("scan", "heavy")}
    assert {(r["system"], r["stem"], r["strict_cer"]) for r in rows.collect()} == {(r["system"], r["stem"], r["strict_cer"]) for r in facts.collect()}
    speed = work.shard_rollup(runs.timing(spark, f"{corpus}/predictions"))
    timed = runs.run_rows(rows, speed)
    runs.write_results(timed, ["system", "family", "severity", "images_per_minute"], f"{corpus}/results")
    flat = spark.read.csv(f"{corpus}/results/csv", header=True)
    assert flat.columns[:4] == ["system", "family", "severity", "images_per_minute"] and flat.count() == 4
    assert spark.read.json(f"{corpus}/results/json").selectExpr("system", "size(documents) n").where("n = 2").count() == 2
    with pytest.raises(Refusal, match="no timing"):
        runs.run_rows(rows, speed.where("system = 'one'"))
    with pytest.raises(Refusal, match="no labels"):
        runs.with_tiers(runs.report_documents(read), runs.tiers(spark, [f"{corpus}/corpus"]).where("false"))


def test_long_runs_have_several_records(spark, monkeypatch):
    monkeypatch.setattr(runs, "PAGES_A_RECORD", 10)
    rows = spark.range(100).selectExpr("'s' as system", "cast(id as string) as stem")
    parts = runs.in_parts(rows, ["system"])
    assert parts.count() == 100 and parts.select("part").distinct().count() > 5


def test_prompt_stamps_without_a_hash_are_refused(spark, corpus):
    assert runs.prompt_stamps(spark, f"{corpus}/predictions").count() == 0
    (corpus / "predictions/one/_prompt_provenance.json").write_text("{}")
    with pytest.raises(Refusal, match="no sha256"):
        runs.prompt_stamps(spark, f"{corpus}/predictions")


def test_ground_truth_and_prompts(spark):
    as_map = runs.ground_truth(spark, {"CASE1": {"layout": "x", "fields": {"A": "1 | 2"}}})
    as_list = runs.ground_truth(spark, [{"case_id": "CASE1", "fields": {"A": "1 | 2"}}])
    assert as_map.collect() == as_list.collect()
    with pytest.raises(Refusal, match="without an id"):
        runs.ground_truth(spark, [{"fields": {}}])
    t = spark.createDataFrame([("note\n---\n body \n---\nmore\n",), ("  all ",)], "t string")
    assert [r[0] for r in t.select(runs.prompt_body(F.col("t"))).collect()] == ["body \n---\nmore", "all"]


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([("s", 1)], "system string, x int"), spark.createDataFrame([("t", 2)], "system string, y int")
    assert runs.write_flat([a, b], f"{tmp_path}/flat").columns == ["system", "x", "y"]
    assert spark.read.csv(f"{tmp_path}/flat", header=True).count() == 2
    runs.write_facts(a, f"{tmp_path}/facts")
    assert spark.read.parquet(f"{tmp_path}/facts").where("system = 's'").count() == 1
    runs.write_extraction(spark.createDataFrame([("f", "v")], "filename string, A string"), f"{tmp_path}/x")
    assert spark.read.csv(f"{tmp_path}/x/csv", header=True).columns == ["image_file", "A"]


def test_empty_corpora_and_loose_pages_are_refused(spark, corpus):
    with pytest.raises(Refusal, match="no transcript"):
        runs.transcripts(spark, f"{corpus}/nowhere")
    (corpus / "predictions/CASE001_invoices.md").write_text("x")
    with pytest.raises(Refusal, match="outside of any system"):
        runs.predictions(spark, f"{corpus}/predictions")
    (corpus / "bare").mkdir()
    with pytest.raises(Refusal, match="no system has a folder"):
        runs.predictions(spark, f"{corpus}/bare")
    (corpus / "bare/one").mkdir()
    assert runs.predictions(spark, f"{corpus}/bare").collect() == []


def test_missing_images_are_refused_with_a_cause(spark):
    stems = spark.createDataFrame([("x",), ("y",)], "stem string")
    images = lambda *p: spark.createDataFrame([(q,) for q in p], "path string")
    assert {tuple(r) for r in runs.page_images(stems, images("/a/x.png", "/a/y.JPG")).collect()} == {("x", "/a/x.png"), ("y", "/a/y.JPG")}
    for paths, cause in (((), "no image at all"), (("/a/x.png", "/a/y.tif"), r"\.tif files are not read"), (("/a/x.png", "/a/z.png"), "export the corpus again")):
        with pytest.raises(Refusal, match=cause):
            runs.page_images(stems, images(*paths))


def test_the_prompt_that_is_sent(spark, tmp_path):
    (tmp_path / "prompt.md").write_text("For whoever runs this.\n---\n Read  the page.\n")
    got = runs.prompt(spark, str(tmp_path)).first()
    assert (got["body"], got["words"], got["sha256"]) == ("Read  the page.", 3, hashlib.sha256(b"Read  the page.").hexdigest())
    (tmp_path / "other.md").write_text("note\n---\n \n")
    with pytest.raises(Refusal, match="below the rule"):
        runs.prompt(spark, str(tmp_path), f"{tmp_path}/other.md")
    with pytest.raises(Refusal, match="no prompt"):
        runs.prompt(spark, f"{tmp_path}/nowhere")


def test_stems_without_a_type_are_refused(spark):
    scoring.refuse_untyped(spark.createDataFrame([("C1_invoices",)], "stem string"))
    for stem in ("C1", "C1_", None):
        with pytest.raises(Refusal, match="without a document type"):
            scoring.refuse_untyped(spark.createDataFrame([(stem,)], "stem string"))


def test_results_keep_runs_with_nulls(spark, tmp_path):
    rows = spark.createDataFrame([("s", None, "C1_a", 1), ("s", None, "C2_a", 2), ("s", "p", "C1_a", 3)], "system string, prompt_sha256 string, stem string, amounts int")
    runs.write_results(rows, ["system", "prompt_sha256"], str(tmp_path))
    assert sorted(len(r["documents"]) for r in spark.read.json(f"{tmp_path}/json").collect()) == [1, 2]
    whole = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/runs").collect()]
    assert len(whole) == 1 and whole[0]["schema"] == 1 and sorted(len(r["documents"]) for r in whole[0]["runs"]) == [1, 2]


@pytest.mark.parametrize("most", [10_000, 2])
def test_reports_are_read_back_whole(spark, tmp_path, monkeypatch, most):
    """Scored, written, read: rates, means, sums, pages and divergences are what went in, in one record or in many."""
    monkeypatch.setattr(runs, "PAGES_A_RECORD", most)
    table = "| Date | Amount |\n|---|---|\n| 1 May | $5.00 |\n| 2 May | $6.10 |"
    truth = [(f"C{k}_bank_statements", f"# S{k}\n\n{table}") for k in range(7)]
    made = [(s, stem, text if s == "one" else text.replace("$6.10", "$6.70").replace("# S", "**S** ")) for s in ("one", "two") for stem, text in truth]
    p = spark.createDataFrame(truth, "stem string, truth string").join(spark.createDataFrame(made, "system string, stem string, prediction string"), "stem")
    facts = scoring.doc_scores(p).cache()
    groups = scoring.divergence_groups(scoring.hunks(p))
    runs.write_report(runs.report_blocks(facts, "c", "p", "standard"), f"{tmp_path}/r", groups)
    read = runs.reports(spark, f"{tmp_path}/r", multi_line=False)
    assert (spark.read.text(f"{tmp_path}/r").count() == 1) == (most > 2)
    by = {r["system"]: r for r in runs.report_systems(read).collect()}
    assert set(by) == {"one", "two"} and runs.report_systems(read).count() == 2
    sums = {r["system"]: r for r in scoring.column_sums(facts).join(scoring.table_sums(facts), "system").join(scoring.number_sums(facts), "system").collect()}
    for s, r in by.items():
        for kind in ("columns", "tables", "numbers"):
            for name, got in r[kind].asDict().items():
                assert got == sums[s][runs.RENAMED.get(name, name)], (s, kind, name)
        for kind in ("strict", "normalised"):
            micro = scoring.micro(facts, kind).where(F.col("system") == s).first()
            assert (r[kind]["cer"], r[kind]["wer"], r[kind]["distance"]) == (micro["cer"], micro["wer"], micro["char_distance"])
            macro = scoring.macro(facts, kind).where(F.col("system") == s).first()
            assert (r["macro"][f"{kind}_cer"], r["macro"][f"{kind}_wer"]) == pytest.approx((macro["macro_cer"], macro["macro_wer"]))
    assert by["one"]["numbers"]["misread"] == 0 < by["two"]["numbers"]["misread"] == 7
    pages = {(r["system"], r["stem"]): (r["strict_cer"], r["attributable"], r["amounts_correct"]) for r in runs.report_documents(read).collect()}
    assert pages == {(r["system"], r["stem"]): (r["strict_cer"], r["attributable"], r["amounts_correct"]) for r in facts.collect()}
    back = {(r["kind"], r["truth"], r["prediction"], r["count"], tuple(r["systems"])) for r in runs.report_divergences(spark, f"{tmp_path}/r", multi_line=False).collect()}
    assert back == {(r["kind"], r["truth"], r["prediction"], r["count"], tuple(r["systems"])) for r in groups.collect()} and len(back) > 2


def test_manifests_are_built_of_pages_and_images(spark, corpus):
    hashes = runs.content_hashes(spark, f"{corpus}/corpus/images/*")
    records = runs.manifest_records(runs.transcripts(spark, f"{corpus}/corpus"), hashes)
    runs.write_manifest(records, f"{corpus}/new")
    read, old = (runs.manifest(spark, p).select("image", "transcript", "doc_type", "sha256").collect() for p in (f"{corpus}/new", f"{corpus}/corpus/manifest.jsonl"))
    assert sorted(read) == sorted(old)
    with pytest.raises(Refusal, match="without an image"):
        runs.manifest_records(runs.transcripts(spark, f"{corpus}/corpus"), hashes.limit(1))


def test_declared_pages_are_written_and_read(spark, corpus):
    declared = spark.createDataFrame([("one", "b", "why"), ("one", "a", "why"), ("three", "c", "else")], "system string, stem string, reason string")
    runs.declare_unproduced(declared, f"{corpus}/predictions")
    got = {tuple(r) for r in runs.unproduced(spark, f"{corpus}/predictions").collect()}
    assert got == {("one", "a", "why"), ("one", "b", "why"), ("three", "c", "else"), ("two", "CASE002_invoices", "too long")}
    assert json.loads((corpus / "predictions/one/_unproduced.json").read_text())["pages"] == ["a", "b"]


def test_a_corpus_stamp_is_its_folder_less_the_prefix(spark):
    t = spark.createDataFrame([("/a/parsing_20260818/",), ("parsing_20260818_scan-light",)], "c string")
    assert [r[0] for r in t.select(runs.corpus_stamp(F.col("c"))).collect()] == ["20260818", "20260818_scan-light"]


def test_a_subset_names_pages_that_are_there(spark):
    stems = spark.createDataFrame([("C1_receipts",), ("C1_bank_statements",), ("C2_bank_statements",)], "stem string")
    assert {r["stem"] for r in work.carved(stems, ["receipts"], ["C2_bank_statements"]).collect()} == {"C1_receipts", "C2_bank_statements"}
    with pytest.raises(Refusal, match="no such pages: C9"):
        work.carved(stems, [], ["C9"])
