"""Models made of parts, stored as a table of trees and a manifest.

A model is described by its kind and the attributes that ``KINDS`` lists, parts within
parts.  Numbers, texts and weights go into the manifest, one JSON text; trees go into a
Parquet table, a row a tree, in a folder that the manifest names.  The manifest is
written last, so a half-written model has none, and a model that is written over an
older one replaces it when all its parts are there.
"""

from __future__ import annotations

import importlib
import json
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from foldwise.models.trees import Nodes

#: kind -> module and stored attributes
KINDS = {
    "BoostedStages": ("boosting", ("step", "max_depth", "min_leaf", "max_bins", "base_score", "checkpoint_every", "seed", "features", "trees")),
    "MultiOutputBoosting": ("boosting", ("models", "features", "parallel")),
    "LinearLayer": ("neural", ("W", "b", "bias", "loss", "activation", "opt", "input_size", "output_size")),
    "_Optimizer": ("neural", ("kind", "lr", "t", "m", "v")),
    "ArrayMap": ("layered", ("width", "rounds", "trees")),
    "Boosted": ("layered", ("up", "down")),
    "Linear": ("layered", ("layer",)),
    "StageNet": ("layered", ("stages", "loss", "target_lr", "noise", "seed", "key", "history")),
    "Autoencoder": ("layered", ("encode", "decode", "undo", "target_lr", "noise", "seed", "key", "history")),
}
#: what a loaded part has besides
DEFAULTS = {"BoostedStages": lambda: {"gradient": importlib.import_module("foldwise.models.boosting").squared_error_gradient}}
TREE = "tree int, feature array<bigint>, threshold array<double>, left array<bigint>, right array<bigint>, value array<double>, depth int"


def _describe(value, trees: list):
    kind = type(value).__name__
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, np.ndarray):
        return {"array": value.tolist()}
    if isinstance(value, (list, tuple)):
        return {"list": [_describe(v, trees) for v in value]}
    if isinstance(value, dict):
        return {"dict": {k: _describe(v, trees) for k, v in value.items()}}
    if isinstance(value, Nodes):
        trees.append(value)
        return {"tree": len(trees) - 1}
    if kind in KINDS:
        return {"kind": kind, "parts": {name: _describe(getattr(value, name), trees) for name in KINDS[kind][1]}}
    raise TypeError(f"{kind} can't be saved")


def _build(stored, trees: list):
    if not isinstance(stored, dict):
        return stored
    if "array" in stored:
        return np.array(stored["array"], dtype=float)
    if "list" in stored:
        return [_build(v, trees) for v in stored["list"]]
    if "dict" in stored:
        return {k: _build(v, trees) for k, v in stored["dict"].items()}
    if "tree" in stored:
        return trees[stored["tree"]]
    module, names = KINDS[stored["kind"]]
    cls = getattr(importlib.import_module(f"foldwise.models.{module}"), stored["kind"])
    out = cls.__new__(cls)
    out.__dict__.update(DEFAULTS.get(stored["kind"], dict)())
    out.__dict__.update({name: _build(stored["parts"][name], trees) for name in names})
    return out


def save(model, path: str, spark: SparkSession) -> str:
    """Write a model of one of ``KINDS``; an older one at ``path`` is replaced."""
    trees: list = []
    described = _describe(model, trees)
    folder = f"trees-{uuid.uuid4().hex[:12]}"
    rows = [(i, t.feature.tolist(), t.threshold.tolist(), t.left.tolist(), t.right.tolist(), t.value.tolist(), t.depth) for i, t in enumerate(trees)]
    spark.createDataFrame(rows, TREE).write.parquet(f"{path}/{folder}")
    manifest = json.dumps({"model": described, "trees": folder, "n_trees": len(trees)})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return path


def load(path: str, spark: SparkSession, kind: type | None = None):
    """The model at ``path``; without a manifest, with trees missing, or of another kind than
    the one asked for -> ValueError."""
    try:
        found = spark.read.text(f"{path}/manifest").head(1)
    except AnalysisException:
        found = []
    if not found:
        raise ValueError(f"no complete model at {path}")
    manifest = json.loads(found[0][0])
    if kind is not None and manifest["model"]["kind"] != kind.__name__:
        raise ValueError(f"the model at {path} is a {manifest['model']['kind']}")
    rows = spark.read.schema(TREE).parquet(f"{path}/{manifest['trees']}").orderBy("tree").collect()  # the model's own size
    if len(rows) != manifest["n_trees"]:
        raise ValueError(f"{len(rows)} of {manifest['n_trees']} trees are at {path}")
    trees = [Nodes(np.array(r.feature, np.int64), np.array(r.threshold, float), np.array(r.left, np.int64), np.array(r.right, np.int64),
                   np.array(r.value, float), r.depth) for r in rows]
    return _build(manifest["model"], trees)
