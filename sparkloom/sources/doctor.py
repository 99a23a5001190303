"""Checks of an installation: what is there, readable and in order."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from .logs import existing

VERSION = "0.2"


def _object(path: str) -> dict | None:
    """The JSON object of a local file, None if it is none."""
    try:
        with open(path, encoding="utf-8-sig") as f:
            got = json.load(f)
    except (OSError, ValueError):
        return None
    return got if isinstance(got, dict) else None


def run_doctor(spark: SparkSession, home: str, own: str, command: str = "sparkloom") -> DataFrame:
    """Nine rows (position, name, status, detail); ``home`` is the agent's folder, ``own`` this engine's.

    Settings live in home/settings.json, logs below home/projects; calibration.json, history.jsonl and
    backups/ below ``own``. Fold the statuses with ``operators.reports.worst_status``."""
    rows: list[tuple[str, str, str]] = [("version", "ok", VERSION)]
    has_home = os.path.isdir(home)
    rows.append(("home folder", "ok" if has_home else "fail", home))
    at = f"{home}/settings.json"
    settings = _object(at) if os.path.exists(at) else None
    if not os.path.exists(at):
        rows.append(("settings", "warn", "no settings file"))
    else:
        rows.append(("settings", "fail" if settings is None else "ok", "not a JSON object" if settings is None else "read"))
    logs = f"{home}/projects"
    n = 0
    if existing(spark, [logs]):
        n = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(logs).select("path").count()
    rows.append(("sessions", "ok" if n else "warn", f"{n} sessions"))
    if settings is None:
        rows += [("hook", "warn", "no settings"), ("status line", "warn", "no settings")]
    else:
        hooks = settings.get("hooks")
        groups = [g for entries in (hooks.values() if isinstance(hooks, dict) else ()) if isinstance(entries, list) for g in entries]
        mine = any(isinstance(g, dict) and isinstance(g.get("hooks"), list) and any(isinstance(h, dict) and h.get("command") == f"{command} status" for h in g["hooks"]) for g in groups)
        rows.append(("hook", "ok", "installed" if mine else "not installed"))
        line = settings.get("statusLine")
        said = line.get("command") if isinstance(line, dict) else None
        rows.append(("status line", "warn" if said and said != f"{command} statusline" else "ok", said or "not installed"))
    at = f"{own}/calibration.json"
    kept = _object(at) if os.path.exists(at) else None
    rows.append(("calibration", "warn", "none saved") if not os.path.exists(at) else ("calibration", "fail", "not a JSON object") if kept is None else ("calibration", "ok", str(kept.get("timestamp", "unknown"))))
    at = f"{own}/history.jsonl"
    if not os.path.exists(at):
        rows.append(("history", "warn", "none yet"))
    else:
        n = spark.read.text(at).filter("value <> ''").count()
        rows.append(("history", "ok", f"{n} records"))
    try:
        os.makedirs(f"{own}/backups", exist_ok=True)
        good = os.access(f"{own}/backups", os.W_OK)
    except OSError:
        good = False
    rows.append(("backups", "ok" if good else "fail", "can be written" if good else "cannot be written"))
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "position int, name string, status string, detail string")
