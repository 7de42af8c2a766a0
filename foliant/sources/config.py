"""Small files that configure a run: a scoring policy, a convention for logs, ground truth. JSON, or YAML where a reader of it is installed."""

from __future__ import annotations

import importlib
import json
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from foliant.errors import Refusal
from foliant.operators.transcripts import Convention
from foliant.policy import Policy, from_mapping
from foliant.sources import runs


def parsed(text: str, where: str) -> object:
    """What the text says; every JSON text is YAML, so JSON is tried first."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        yaml = importlib.import_module("yaml")
    except ImportError as e:
        raise Refusal("this is not JSON, and no reader of YAML is installed", where, "JSON, or YAML with its reader", "install PyYAML, or write JSON") from e
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise Refusal("this is neither JSON nor YAML", where, "one mapping or list", "mend the file") from e


def content(spark: SparkSession, path: str) -> object:
    """Of one small file, by any path that Spark reads."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise Refusal(f"{len(rows)} files", path, "one file", "name one file")
    return parsed(rows[0]["value"], path)


def policy(spark: SparkSession, path: str) -> Policy:
    values = content(spark, path)
    if not isinstance(values, dict):
        raise Refusal("the policy is no mapping", path, "a value for each key", "write key and value")
    return from_mapping(values, path)


def convention(spark: SparkSession, path: str) -> Convention:
    """Every key must be there, those that change nothing too; keys that only describe the text are read over."""
    values = content(spark, path)
    names = [f.name for f in fields(Convention)]
    missing = names if not isinstance(values, dict) else [n for n in names if n not in values]
    if missing:
        raise Refusal(f"the convention lacks {', '.join(missing)}", path, f"all of {', '.join(names)}", "add the missing keys")
    return Convention(**{n: values[n] for n in names})


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    cases = content(spark, path)
    if not isinstance(cases, (dict, list)):
        raise Refusal("the ground truth is no mapping or list", path, "cases by id, or records that name theirs", "mend the file")
    return runs.ground_truth(spark, cases)
