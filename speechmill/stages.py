"""Stages whose outputs are kept: a stage is run when what it depends on has changed, and otherwise read.

A stage has a name, the names of what it needs (inputs or other stages), the settings it looks at, and a function. The key of its output is a digest of all of
that: of the keys of what it needs, the settings, and its version; the key of an input is a digest of its files' paths, lengths and times. An output lies under its key,
and a manifest row is written last, so an output whose run was cut off has none and is made again, and one with a manifest is never made twice. Since
keys follow from inputs and settings alone, a second run after a loss at any point gives the same outputs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "stage string, key string, path string, n_rows long, settings string, needs map<string, string>"


@dataclass(frozen=True)
class Stage:
    name: str
    needs: tuple[str, ...]
    make: Callable[..., DataFrame]
    settings: tuple[str, ...] = ()
    version: int = 1


@dataclass
class Run:
    """The stages of a folder. made and kept: the names of the stages that this run made, and that it found."""

    spark: SparkSession
    folder: str
    inputs: Mapping[str, str]
    settings: Mapping[str, object] = field(default_factory=dict)
    stages: dict[str, Stage] = field(default_factory=dict)
    made: list[str] = field(default_factory=list)
    kept: list[str] = field(default_factory=list)
    _keys: dict[str, str] = field(default_factory=dict)
    _done: dict[str, DataFrame] = field(default_factory=dict)

    def add(self, *stages: Stage) -> Run:
        for stage in stages:
            if stage.name in self.inputs or stage.name in self.stages:
                raise ValueError(f"{stage.name} is the name of an input or of a stage already")
            for name in stage.needs:
                if name not in self.stages and name not in self.inputs:
                    raise ValueError(f"stage {stage.name} needs {name}, which is no input and no stage before it")
            self.stages[stage.name] = stage
        return self

    def key(self, name: str) -> str:
        if name not in self._keys:
            stage = self.stages.get(name)
            what = self._files(self.inputs[name]) if stage is None else [stage.name, stage.version, {s: self.settings.get(s) for s in stage.settings}, [[n, self.key(n)] for n in stage.needs]]
            self._keys[name] = hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()[:24]
        return self._keys[name]

    def _files(self, path: str) -> list:
        """One digest of the files under a path: their names, lengths and times, not their contents."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
        one = files.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("sum")).first()
        return [path, one["n"], one["bytes"], str(one["sum"])]

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}/{self.key(name)}"

    def _manifest(self, name: str) -> str:
        return f"{self.folder}/manifests/{name}/{self.key(name)}"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def get(self, name: str) -> DataFrame | str:
        """An input's path, or the output of a stage, made now if it isn't there."""
        if name not in self.stages:
            return self.inputs[name]
        if name not in self._done:
            stage, path = self.stages[name], self.path(name)
            if self._exists(self._manifest(name)):
                self.kept.append(name)
            else:
                needs = {n: self.get(n) for n in stage.needs}
                stage.make(self, **needs).write.mode("overwrite").option("compression", "zstd").parquet(path)
                rows = self.spark.read.parquet(path).count()
                own = {s: self.settings.get(s) for s in stage.settings}
                row = [(name, self.key(name), path, rows, json.dumps(own, default=str), {n: self.key(n) for n in stage.needs})]
                self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("overwrite").json(self._manifest(name))
                self.made.append(name)
            self._done[name] = self.spark.read.parquet(path)
        return self._done[name]

    def all(self) -> dict[str, DataFrame]:
        return {name: self.get(name) for name in self.stages}

    def manifest(self) -> DataFrame:
        """stage, key, path, n_rows, settings, needs of the outputs of this run, as committed."""
        return self.spark.read.schema(MANIFEST).json([self._manifest(name) for name in self.stages if self._exists(self._manifest(name))])
