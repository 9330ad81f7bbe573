"""Run artefacts: canonical hashes, manifests and the reuse of finished stages."""

from __future__ import annotations

import hashlib
import json
import sys
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from cartwheel.sources import store


def stable_hash(value: Any) -> str:
    """SHA-256 of the value's JSON with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def save_report(spark: SparkSession, path: str, report: Any) -> None:
    store.write_text(spark, path, json.dumps(report, indent=2, sort_keys=True, default=str))


def _manifest(spark: SparkSession, folder: str) -> dict[str, Any] | None:
    path = f"{folder}/manifest.json"
    return json.loads(store.read_text(spark, path)) if store.exists(spark, path) else None


def console(stage: str, state: str, seconds: float) -> None:
    """Progress on standard error: a line for each stage, rewritten on a terminal."""
    live = sys.stderr.isatty()
    end = "\n" if state != "running" or not live else "\r"
    if live or state != "running":
        print(f"{stage:<40} {state:<8} {seconds:7.1f} s", end=end, file=sys.stderr, flush=True)


def silent(stage: str, state: str, seconds: float) -> None:
    """Progress that nobody asked for."""


class Run:
    """A folder of stages, in any store; a stage that is finished for the same spec is read again."""

    def __init__(self, spark: SparkSession, folder: str, spec: dict[str, Any], progress: Callable[[str, str, float], None] = silent):
        self.spark, self.folder, self.spec, self.progress = spark, str(folder).rstrip("/"), stable_hash(spec), progress
        self.reused: list[str] = []
        self.made: list[str] = []
        own = _manifest(spark, self.folder)
        if own and own["spec"] != self.spec:
            raise ValueError("the folder holds a run of another specification")
        save_report(spark, f"{self.folder}/manifest.json", {"stage": "run", "spec": self.spec, "result": {"spec": spec}})

    def stage(self, name: str, make: Callable[[str], dict[str, Any] | None]) -> tuple[str, dict[str, Any]]:
        """``make(folder)`` writes the stage's tables and returns its report."""
        folder, begun = f"{self.folder}/{name}", time.monotonic()
        done = _manifest(self.spark, folder)
        if done and done["spec"] == self.spec:
            self.reused.append(name)
            self.progress(name, "reused", 0.0)
            return folder, done["result"]
        self.progress(name, "running", 0.0)
        result = make(folder) or {}
        save_report(self.spark, f"{folder}/manifest.json", {"stage": name, "spec": self.spec, "result": result})
        self.made.append(name)
        self.progress(name, "done", time.monotonic() - begun)
        return folder, result
