"""A runner of named stages: outputs are checked, finished stages skipped, every event kept in a manifest."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "ts double, stage string, status string, detail string"


# Fixed value: the digest of a configuration is that of its JSON with sorted keys.
def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


class Run:
    """Stages of one configuration under one folder; a changed configuration is refused."""

    def __init__(self, spark: SparkSession, folder: str, config: dict):
        self.spark, self.folder, self.sha = spark, folder.rstrip("/"), config_hash(config)
        known = [r.detail for r in self.events().where("stage = 'lock'").collect()]
        if known and known[0] != self.sha:
            raise ValueError("the configuration differs from the one this run was begun with")
        if not known:
            self.note("lock", "ok", self.sha)

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifest")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def note(self, stage: str, status: str, detail: str = "") -> None:
        self.spark.createDataFrame([(time.time(), stage, status, detail)], MANIFEST).coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def complete(self, stage: str, least: int) -> bool:
        try:
            return self.spark.read.parquet(f"{self.folder}/{stage}").limit(least).count() >= least
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return False

    def stage(self, name: str, make: Callable[[], DataFrame], least: int = 1, force: bool = False) -> DataFrame:
        """The stage's table: made unless its output has at least so many rows already."""
        path = f"{self.folder}/{name}"
        if force or not self.complete(name, least):
            make().write.mode("overwrite").parquet(path)
            if not self.complete(name, least):
                self.note(name, "fail", f"fewer than {least} rows")
                raise ValueError(f"stage {name} gave fewer than {least} rows")
            self.note(name, "ok")
        else:
            self.note(name, "skipped")
        return self.spark.read.parquet(path)


def latest_status(events: DataFrame, stage: str = "stage", ts: str = "ts", status: str = "status") -> DataFrame:
    """The last event of each stage, and how many there were."""
    return events.groupBy(stage).agg(F.max_by(status, ts).alias("status"), F.max(ts).alias("ts"), F.count("*").alias("events"))


def first_and_latest(events: DataFrame, stage: str = "stage", ts: str = "ts", status: str = "status") -> DataFrame:
    """The first and the last event of each stage."""
    ends = [F.min_by(status, ts).alias("first"), F.min(ts).alias("first_ts"), F.max_by(status, ts).alias("last"), F.max(ts).alias("last_ts")]
    return events.groupBy(stage).agg(*ends)


def refuse_hits(pairs: DataFrame) -> None:
    """Stops a run whose audit has any hit, naming some."""
    if hits := pairs.limit(5).collect():
        raise ValueError(f"held-out text in the training data: {[tuple(r) for r in hits]}")


# The gates a configuration sets, each with its comparison.
GATES = {"ece": ("<=",), **{k: (">", ">=") for k in ("synth3", "mnli", "ocnli", "synth2zh", "synth2")}}
NEEDED = ("name", "base", "profile", "data", "train", "gates")


def config_errors(config) -> list[str]:
    """What is wrong with a configuration: missing parts, a name that is no slug, no base path, gates other than the known ones or with a wrong comparison or bar."""
    if not isinstance(config, dict):
        return ["the configuration must be an object"]
    out = [f"missing key {k}" for k in NEEDED if k not in config]
    name = config.get("name", "x")
    if not isinstance(name, str) or not name.replace("-", "").replace("_", "").isalnum():
        out.append("name must be a simple slug")
    if "base" in config and not (isinstance(config["base"], dict) and "path" in config["base"]):
        out.append("base.path is required")
    for part in ("data", "train", "gates"):
        if part in config and not isinstance(config[part], dict):
            out.append(f"{part} must be an object")
    gates = config.get("gates")
    if isinstance(gates, dict):
        if set(gates) != set(GATES):
            out.append(f"gates must be exactly {sorted(GATES)}")
        for k, gate in gates.items():
            if not isinstance(gate, dict) or not {"cmp", "value"} <= set(gate):
                out.append(f"gate {k} needs cmp and value")
            elif k in GATES and gate["cmp"] not in GATES[k]:
                out.append(f"gate {k} must be compared by {' or '.join(GATES[k])}")
            elif isinstance(gate["value"], bool) or not isinstance(gate["value"], (int, float)):
                out.append(f"gate {k} must have a numeric bar")
    return out
