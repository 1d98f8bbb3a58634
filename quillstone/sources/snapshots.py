"""Versioned builds: written whole to a new folder, checked, then made active by one rename."""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillstone.operators.maintenance import is_valid


@dataclass(frozen=True)
class Builds:
    """A folder of builds on a file system that the driver mounts; Spark reads and writes the tables in it."""

    root: str

    @property
    def pointer(self) -> str:
        return f"{self.root}/ACTIVE.json"

    def active(self) -> str | None:
        try:
            with open(self.pointer, encoding="utf-8") as f:
                return json.load(f)["active"]
        except (OSError, ValueError, KeyError):
            return None

    def activate(self, build_id: str) -> None:
        if not build_id:
            raise ValueError("no build to activate")
        own = f"{self.pointer}.{uuid.uuid4().hex}"
        with open(own, "w", encoding="utf-8") as f:
            json.dump({"active": build_id, "updated_at": int(time.time())}, f)
        os.replace(own, self.pointer)

    def path(self, build_id: str, table: str) -> str:
        return f"{self.root}/builds/{build_id}/{table}"

    def resolve(self, wanted: str | None = None, default: str | None = None, table: str = "chunks") -> str | None:
        """The first build that has the table: the wanted one, the active one, the default."""
        return next((b for b in (wanted, self.active(), default) if b and os.path.isdir(self.path(b, table))), None)

    def read(self, spark: SparkSession, table: str, wanted: str | None = None, default: str | None = None) -> DataFrame | None:
        build = self.resolve(wanted, default, table) if wanted or default else self.active()
        return spark.read.parquet(self.path(build, table)) if build and os.path.isdir(self.path(build, table)) else None

    def publish(self, spark: SparkSession, build_id: str, tables: dict[str, DataFrame], keep: int = 3) -> bool:
        """Write all tables, validate ``chunks``, swap the pointer, drop old builds. False leaves the active build as it is."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self.path(build_id, name))
        if not is_valid(spark.read.parquet(self.path(build_id, "chunks"))):
            return False
        self.activate(build_id)
        for old in self.expired(keep):
            shutil.rmtree(f"{self.root}/builds/{old}")
        return True

    def expired(self, keep: int) -> list[str]:
        """Builds beyond the newest ``keep`` by name, the active one excepted."""
        names = sorted(os.listdir(f"{self.root}/builds"), reverse=True)
        return [n for n in names[keep:] if n != self.active()]
