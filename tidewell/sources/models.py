"""Model folders: checked on the driver, shipped with the job, loaded in the workers on the device that their task was given."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

import numpy as np
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.dense import HashingEmbedder

T = TypeVar("T")
#: The environment variable that names a device for all workers.
DEVICE = "TIDEWELL_DEVICE"


def device() -> str:
    """In a task: the named device, else the first GPU that Spark gave to the task, else the CPU."""
    if os.environ.get(DEVICE):
        return os.environ[DEVICE]
    task = TaskContext.get()
    gpus = task.resources().get("gpu") if task else None
    return f"cuda:{gpus.addresses[0]}" if gpus and gpus.addresses else "cpu"


@dataclass(frozen=True)
class ModelFolder:
    """A folder that every worker has a copy of."""

    name: str

    def path(self) -> str:
        return SparkFiles.get(self.name)

    def loader(self, make: Callable[[str, str], T]) -> Callable[[], T]:
        """What loads the model in a worker: ``make`` of the folder's path and the device."""
        return lambda: make(self.path(), device())


def ship(spark: SparkSession, folder: str, needs: tuple[str, ...] = ()) -> ModelFolder:
    """Sends a folder, from the driver's disk or a store, to all workers. Raises now, and not in a task, if it or a needed file is missing.

    A folder of the driver's disk goes as an archive, which Spark unpacks for each executor: it sends no local folders on a cluster.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for name in ("", *needs):
        at = hadoop.Path(f"{folder}/{name}" if name else folder)
        if not at.getFileSystem(conf).exists(at):
            raise FileNotFoundError(f"model folder {folder} has no {name}" if name else f"no model folder {folder}")
    name, at = folder.rstrip("/").rpartition("/")[2], hadoop.Path(folder)
    if at.getFileSystem(conf).getUri().getScheme() == "file":
        packed = shutil.make_archive(os.path.join(tempfile.mkdtemp(), name), "zip", at.toUri().getPath())
        spark.sparkContext.addArchive(f"{packed}#{name}")
    else:
        spark.sparkContext.addFile(folder, recursive=True)
    return ModelFolder(name)


class BucketModel:
    """A small model of a folder's ``config.json`` and ``weights.npy``: token counts in hash buckets, weighted and scaled to unit length.

    Embeds texts, and scores pairs of texts by their embeddings' product.
    """

    FILES = ("config.json", "weights.npy")

    def __init__(self, path: str, on: str = "cpu"):
        with open(os.path.join(path, "config.json"), encoding="utf-8") as file:
            self.dim = json.load(file)["dim"]
        self.device, self.weights, self._counts = on, np.load(os.path.join(path, "weights.npy")), HashingEmbedder(self.dim)
        if self.weights.shape != (self.dim,):
            raise ValueError(f"{path}: weights of shape {self.weights.shape}, not ({self.dim},)")

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = self._counts(texts) * self.weights
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)

    def pairs(self, both: list[tuple[str, str]]) -> np.ndarray:
        return np.einsum("nd,nd->n", self([a for a, _ in both]), self([b for _, b in both]))


def fit_buckets(texts: DataFrame, column: str, folder: str, dim: int = 64) -> str:
    """Fits a BucketModel's weights to a corpus and saves it: a bucket's weight is its inverse document frequency over the texts.

    One row for each bucket comes to the driver.
    """
    bucket = lambda t: F.conv(F.left(F.md5(t), F.lit(8)), 16, 10).cast("bigint") % dim
    held = texts.select(F.explode(F.array_distinct(F.transform(tx.lower_tokens(F.col(column)), bucket))).alias("bucket"))
    found = {r["bucket"]: r["n"] for r in held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = texts.count()
    os.makedirs(folder, exist_ok=True)
    np.save(os.path.join(folder, "weights.npy"), np.log((n + 1) / (np.array([found.get(b, 0) for b in range(dim)]) + 1)) + 1)
    with open(os.path.join(folder, "config.json"), "w", encoding="utf-8") as file:
        json.dump({"dim": dim}, file)
    return folder
