"""Run directories and manifests: small files about a run, beside the tables that Spark writes."""

from __future__ import annotations

import csv
import datetime as dt
import json
import shutil
import time
import uuid
import zipfile
from pathlib import Path
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from tessel.functions.tables import file_system, names_in, remove
from tessel.sources.sinks import atomic_write, write_json

#: Pointers to keep, for readers that hold an older one.
KEPT_POINTERS = 20


def now() -> str:
    return dt.datetime.now(dt.UTC).isoformat(timespec="seconds")


def run_id() -> str:
    return dt.datetime.now(dt.UTC).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:6]


def file_record(path: Path) -> dict[str, Any]:
    """Path and size of a file; a table's directory, or a pattern, counts its files."""
    found = path.parent.glob(path.name) if "*" in path.name else [path]
    files = [f for p in found for f in (p.rglob("*") if p.is_dir() else [p]) if f.is_file()]
    return {"path": str(path), "exists": bool(files), "bytes": sum(p.stat().st_size for p in files), "files": len(files)}


def report_shape(path: Path) -> dict[str, Any] | None:
    """Columns and number of rows of a report's CSV; None where there is none."""
    if not path.is_file():
        return None
    with path.open(newline="", encoding="utf-8-sig") as f:
        rows = csv.reader(f)
        return {"columns": next(rows, []), "rows": sum(1 for _ in rows)}


class Manifest:
    """The record of a run, written after each change: settings, stages with status, times, inputs and outputs."""

    def __init__(self, path: Path, command: str, config: dict[str, Any], spark_app: str = ""):
        self.path = path
        self.value: dict[str, Any] = {"run_id": run_id(), "command": command, "config": config, "spark_app": spark_app, "started_at": now(), "status": "running", "stages": {}}
        self.write()

    def write(self) -> None:
        write_json(self.path, self.value)

    def started(self, stage: str, inputs: list[str] | tuple[str, ...] = ()) -> None:
        self.value["stages"][stage] = {"status": "running", "started_at": now(), "inputs": [file_record(Path(p)) for p in dict.fromkeys(inputs)]}
        self.write()

    def finished(self, stage: str, outputs: list[str] | tuple[str, ...] = (), error: str = "", inputs: list[str] | tuple[str, ...] = ()) -> None:
        """The stage's end: `inputs` are those it turned out to read, beside those known at its start."""
        s = self.value["stages"][stage]
        s |= {"status": "failed" if error else "succeeded", "finished_at": now(), "outputs": [file_record(Path(p)) for p in dict.fromkeys(outputs)]}
        known = {r["path"] for r in s["inputs"]}
        s["inputs"] += [file_record(Path(p)) for p in dict.fromkeys(inputs) if p not in known]
        s["metrics"] = {Path(p).name: found for p in dict.fromkeys(outputs) if (found := report_shape(Path(f"{p}.csv")))}
        s["elapsed_seconds"] = (dt.datetime.fromisoformat(s["finished_at"]) - dt.datetime.fromisoformat(s["started_at"])).total_seconds()
        if error:
            s["error"] = error
        self.write()

    def skipped(self, stage: str, reason: str) -> None:
        self.value["stages"][stage] = {"status": "skipped", "reason": reason, "at": now()}
        self.write()

    def close(self, status: str) -> None:
        self.value |= {"status": status, "finished_at": now()}
        self.write()


def bundle(run_dir: Path, name: str = "reports.zip") -> Path:
    """One ZIP of a run's reports (CSV, Markdown, JSON), without its tables."""

    def write(target: Path) -> None:
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(run_dir.iterdir()):
                if p.is_file() and not p.name.startswith(".") and p.suffix in (".csv", ".md", ".json"):
                    z.write(p, p.name)

    return atomic_write(run_dir / name, write)


def _pointers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[:-5]) for n in names_in(spark, f"{root}/pointers") if n.endswith(".json") and n[:-5].isdigit())


def _pointer(spark: SparkSession, root: str, version: int) -> dict[str, str] | None:
    """The tables of a version; None where its publisher hasn't finished writing it."""
    found = spark.read.text(f"{root}/pointers/{version:08d}.json", wholetext=True).first()
    try:
        return json.loads(found[0])["tables"] if found else None
    except json.JSONDecodeError:
        return None


def current_tables(spark: SparkSession, root: str) -> dict[str, str]:
    """The published tables' names and paths, by the newest finished pointer below `root`."""
    for version in reversed(_pointers(spark, root)):
        if (tables := _pointer(spark, root, version)) is not None:
            return tables
    return {}


def point_to(spark: SparkSession, root: str, tables: dict[str, str], patience: float = 5.0) -> int:
    """Publish tables where they lie: a new numbered pointer over those published before; returns its number.

    Hadoop's exclusive create decides between publishers; the loser starts again from the winner's tables. A pointer
    that stays unfinished for `patience` seconds is taken for a crash and passed over.
    """
    waited = 0.0
    while True:
        versions = _pointers(spark, root)
        if versions and waited < patience and _pointer(spark, root, versions[-1]) is None:
            time.sleep(0.5)
            waited += 0.5
            continue
        version = versions[-1] + 1 if versions else 1
        body = json.dumps({"published_at": now(), "tables": current_tables(spark, root) | tables}, indent=2)
        fs, target = file_system(spark, f"{root}/pointers/{version:08d}.json")
        try:
            out = fs.create(target, False)
        except Py4JJavaError as e:
            if fs.exists(target) and "AlreadyExists" in e.java_exception.getClass().getName():
                waited = 0.0
                continue
            raise
        out.write(bytearray(body.encode()))
        out.close()
        for old in versions:
            if old <= version - KEPT_POINTERS:
                remove(spark, f"{root}/pointers/{old:08d}.json")
        return version


def publish(spark: SparkSession, run_dir: Path, latest: Path) -> None:
    """Make a finished run the current one: its small files replace those in `latest`, each whole, and a pointer names its tables, which stay where they are."""
    latest.mkdir(parents=True, exist_ok=True)
    for p in sorted(run_dir.iterdir()):
        if p.is_file() and not p.name.startswith("."):
            atomic_write(latest / p.name, lambda target, source=p: shutil.copyfile(source, target))
    fs, folder = file_system(spark, str(run_dir.resolve()))
    found = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory()]
    point_to(spark, str(latest.resolve()), {p.getName(): p.toUri().getPath() if fs.getScheme() == "file" else p.toString() for p in found})
    write_json(latest.with_name(f"{latest.name}.json"), {"run_dir": str(run_dir), "published_at": now()})
