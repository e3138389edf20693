"""Fitted models and their reports on shared storage, found again by what they were fitted on.

An entry is a folder named by a digest of everything that decides the fit: the content of the input
rows and all settings. It is written beside its place and moved there when complete, so a reader
sees a whole entry or none, and of two writers the first one stays.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.operators.checks import CheckFailed
from tillspark.sources.workspace import remove, shared_folder

MANIFEST = "manifest.json"


def content_of(df: DataFrame) -> dict:
    """Row count and order-free digest of the content of a table, as plain values."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"),
        F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s"),
    ).first()
    return {"rows": row["rows"], "digest": f"{row['x'] & (2**64 - 1):016x}:{row['s']}"}


def files_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the names and contents of all files below `path`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", path.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    each = F.sort_array(F.collect_list(F.concat_ws(":", name, F.sha2("content", 256))))
    return files.where(~F.col("path").rlike(r"/[._][^/]*$")).agg(
        F.sha2(F.array_join(each, "\n"), 256)
    ).first()[0]


@dataclass
class Entry:
    """A complete entry; models and tables are read on first use."""

    spark: SparkSession
    path: str
    manifest: dict

    def model(self, name: str) -> PipelineModel:
        if name not in self.manifest["models"]:
            raise CheckFailed(f"No stored model {name}")
        return PipelineModel.load(f"{self.path}/models/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/tables/{name}")

    @cached_property
    def models(self) -> dict[str, PipelineModel]:
        return {name: self.model(name) for name in self.manifest["models"]}

    def manifest_frame(self) -> DataFrame:
        """One row per stored model: its digest, and rows and digest of what it was fitted on."""
        rows = [
            (name, m["sha256"], m["rows"], m["end"], self.manifest["input"]["digest"])
            for name, m in sorted(self.manifest["models"].items())
        ]
        return self.spark.createDataFrame(
            rows,
            "model string, model_sha256 string, fitted_rows bigint, fitted_end string, input_digest string",
        )


class ModelStore:
    """Entries below `folder`, the session's shared folder unless named."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{shared_folder(spark)}/models").rstrip("/")

    @staticmethod
    def key(facts: dict) -> str:
        told = json.dumps(facts, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(told.encode()).hexdigest()[:32]

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def open(self, key: str) -> Entry | None:
        """The entry, or None where there is none."""
        path = f"{self.folder}/{key}"
        target, fs = self._fs(f"{path}/{MANIFEST}")
        if not fs.exists(target):
            return None
        text = self.spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0]
        return Entry(self.spark, path, json.loads(text))

    def save(
        self,
        key: str,
        models: dict[str, tuple[PipelineModel, int, str]],
        tables: dict[str, DataFrame],
        facts: dict,
    ) -> Entry:
        """Write an entry; `models` come with the rows and the last day of their fit."""
        building = f"{self.folder}/building-{key}-{uuid.uuid4().hex[:8]}"
        try:
            told = {}
            for name, (model, rows, end) in models.items():
                model.write().save(f"{building}/models/{name}")
                told[name] = {
                    "rows": rows,
                    "end": end,
                    "sha256": files_digest(self.spark, f"{building}/models/{name}"),
                }
            for name, df in tables.items():
                df.coalesce(1).write.parquet(f"{building}/tables/{name}")
            target, fs = self._fs(f"{building}/{MANIFEST}")
            out = fs.create(target)
            out.write(bytearray(json.dumps(facts | {"models": told}, sort_keys=True).encode()))
            out.close()
            source, _ = self._fs(building)
            place, fs = self._fs(f"{self.folder}/{key}")
            if not fs.exists(place):
                fs.rename(source, place)
        finally:
            remove(self.spark, building)
        entry = self.open(key)
        if entry is None:
            raise CheckFailed(f"The entry {key} could not be stored")
        return entry
