"""A resumable run of stages: each one writes a table, then a manifest; a stage with a manifest is read and not run again.

A stage's folder carries a fingerprint of its options and of the stages it reads, so other options or other input make a
new folder, and what they do not touch is used again. A table without a manifest is the rest of a run that broke off; it is overwritten.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Run:
    """folder: any path that the cluster's file system reaches. source: names the input's version."""

    def __init__(self, spark: SparkSession, folder: str, source: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.marks: dict[str, str] = {"": source}
        self.made: list[str] = []  # the stages that this run has run itself

    def _file(self, path: str):
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(sc._jsc.hadoopConfiguration()), at

    def stage(self, name: str, make: Callable[[], DataFrame], *, after: tuple[str, ...] = ("",), options: object = None) -> DataFrame:
        """The stage's table. after: the stages that it reads, of which the empty one is the input; options: what else it depends on."""
        mark = hashlib.sha256(json.dumps([name, [self.marks[a] for a in after], repr(options)]).encode()).hexdigest()
        self.marks[name] = mark
        table, manifest = f"{self.folder}/{name}-{mark[:16]}", f"{self.folder}/{name}-{mark[:16]}.json"
        fs, at = self._file(manifest)
        if not fs.exists(at):
            began = time.time()
            make().write.mode("overwrite").parquet(table)
            rows = self.spark.read.parquet(table)
            facts = {"stage": name, "fingerprint": mark, "after": [a for a in after if a], "rows": rows.count(), "schema": rows.schema.simpleString(), "seconds": round(time.time() - began, 3)}
            out = fs.create(at, True)
            out.write(bytearray(json.dumps(facts).encode()))
            out.close()
            self.made.append(name)
        return self.spark.read.parquet(table)

    def manifests(self) -> DataFrame:
        """What the finished stages of the folder say of themselves."""
        return self.spark.read.json(f"{self.folder}/*.json")
