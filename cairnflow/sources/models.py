"""Saved models with their description, the latest one by prefix, and the listing of a data folder."""

from __future__ import annotations

import json
import time
from pathlib import PurePosixPath

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from cairnflow.durable import files_of
from cairnflow.sources.raw import SUFFIXES


def save(spark: SparkSession, folder: str, version: str, model: PipelineModel, about: dict) -> str:
    """Write a model and, last, its description (a model without one is unfinished and never found). The folder may be in any store that
    Spark reads."""
    path = f"{folder}/{version}"
    model.write().overwrite().save(f"{path}/model")
    text = json.dumps(about | {"model_version": version, "saved_at_ms": int(time.time() * 1000)}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return path


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """(model, description); FileNotFoundError without either."""
    fs, at = files_of(spark, f"{path}/about/_SUCCESS")
    if not fs.exists(at):
        raise FileNotFoundError(path)
    about = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/about").collect()))  # one row
    return PipelineModel.load(f"{path}/model"), about


def latest(spark: SparkSession, folder: str, prefix: str) -> str | None:
    """The finished model of that prefix that was written last, None without."""
    fs, at = files_of(spark, folder)
    if not fs.exists(at):
        return None
    found = []
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        done = files_of(spark, f"{folder}/{name}/about/_SUCCESS")[1]
        if name.startswith(prefix) and fs.exists(done):
            found.append((fs.getFileStatus(done).getModificationTime(), name))
    return f"{folder}/{max(found)[1]}" if found else None


def load_latest(spark: SparkSession, folder: str, prefix: str) -> tuple[PipelineModel, dict]:
    path = latest(spark, folder, prefix)
    if path is None:
        raise FileNotFoundError(f"no model {prefix}* in {folder}")
    return load(spark, path)


def listing(spark: SparkSession, folder: str) -> list[dict]:
    """Name and size of the supported files of a data folder, by name."""
    fs, at = files_of(spark, folder)
    if not fs.exists(at):
        return []
    rows = [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(at)]
    return [{"name": n, "size_mb": round(b / 1e6, 2)} for n, b in sorted(rows) if PurePosixPath(n).suffix.lower() in SUFFIXES]


def confined(folder: str, name: str) -> str:
    """The path of a file inside the folder; a name that leads elsewhere, or isn't a supported file, raises ValueError."""
    parts = PurePosixPath(name).parts
    if not parts or name.startswith(("/", "~")) or ":" in name or "\\" in name or ".." in parts:
        raise ValueError(f"{name!r} is outside the data folder")
    if PurePosixPath(name).suffix.lower() not in SUFFIXES:
        raise ValueError(f"unsupported file type {name!r}")
    return f"{folder}/{name}"
