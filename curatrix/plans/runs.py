"""Registry of runs: a configuration and result tables under one folder each."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class Runs:
    """Runs below ``root``, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._path("/".join((self.root, *parts)))

    def keys(self) -> list[str]:
        if not self._fs.exists(self._at()):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at()))

    def register(self, key: str, config: dict, overwrite: bool = False) -> None:
        if key in self.keys():
            if not overwrite:
                raise ValueError(f"run {key!r} exists")
            self.cleanup(key)
        self.spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string").coalesce(1).write.parquet(f"{self.root}/{key}/config")

    def config(self, key: str) -> dict:
        if key not in self.keys():
            raise ValueError(f"no run {key!r}; there are {self.keys()}")
        return json.loads(self.spark.read.parquet(f"{self.root}/{key}/config").first()[0])

    def save(self, key: str, table: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{key}/{table}")

    def load(self, key: str, table: str) -> DataFrame:
        self.config(key)
        return self.spark.read.parquet(f"{self.root}/{key}/{table}")

    def rename(self, key: str, new: str) -> None:
        self.config(key)
        if new in self.keys():
            raise ValueError(f"run {new!r} exists")
        self._fs.rename(self._at(key), self._at(new))

    def cleanup(self, key: str, samples: DataFrame | None = None) -> DataFrame | None:
        """Delete a run; ``samples`` come back without the fields that it wrote."""
        out = samples if samples is None else samples.drop(*self.fields(key).values())
        self._fs.delete(self._at(key), True)
        return out

    def fields(self, key: str) -> dict[str, str]:
        """The samples' fields that a run wrote, by what they hold."""
        return self.config(key).get("fields", {})

    def rename_fields(self, key: str, new: dict[str, str], samples: DataFrame) -> DataFrame:
        """``samples`` with a run's fields renamed, as its configuration is."""
        config = self.config(key)
        old = config.get("fields", {})
        out = samples
        for what, name in new.items():
            out = out.withColumnRenamed(old[what], name)
        config["fields"] = old | new
        self.spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{key}/config")
        return out
