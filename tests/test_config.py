"""Configuration files."""

from __future__ import annotations

import dataclasses
import json
import sys
import types

import pytest

from foliant.errors import Refusal
from foliant.operators.transcripts import STANDARD as LOGS
from foliant.policy import STANDARD
from foliant.sources import config


def test_policies_conventions_and_cases_are_read(spark, tmp_path):
    for name, value in (("policy", dataclasses.asdict(STANDARD)), ("logs", dataclasses.asdict(LOGS) | {"emphasis": "none"}), ("cases", {"CASE1": {"layout": "x", "fields": {"A": "1 | 2"}}}), ("list", [{"case_id": "CASE1", "fields": {"A": "1 | 2"}}]), ("none", 5)):
        (tmp_path / f"{name}.json").write_text(json.dumps(value, indent=1))
    assert config.policy(spark, f"{tmp_path}/policy.json") == STANDARD
    assert config.convention(spark, f"{tmp_path}/logs.json") == LOGS
    assert config.ground_truth(spark, f"{tmp_path}/cases.json").collect() == config.ground_truth(spark, f"{tmp_path}/list.json").collect()
    for read in (config.policy, config.convention, config.ground_truth):
        with pytest.raises(Refusal):
            read(spark, f"{tmp_path}/none.json")
    with pytest.raises(Refusal, match="lacks"):
        config.policy(spark, f"{tmp_path}/logs.json")
    with pytest.raises(Refusal, match="5 files|2 files"):
        config.content(spark, f"{tmp_path}/*.json")


def test_yaml_needs_its_reader(monkeypatch):
    monkeypatch.setitem(sys.modules, "yaml", None)
    with pytest.raises(Refusal, match="no reader of YAML"):
        config.parsed("fold_case: false", "here")

    class Wrong(Exception):
        pass

    def safe_load(text):
        if ":" not in text:
            raise Wrong
        key, _, value = text.partition(": ")
        return {key: value}

    monkeypatch.setitem(sys.modules, "yaml", types.SimpleNamespace(safe_load=safe_load, YAMLError=Wrong))
    assert config.parsed("a: b", "here") == {"a": "b"}
    with pytest.raises(Refusal, match="neither"):
        config.parsed("[", "here")
