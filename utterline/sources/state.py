"""Small state and settings on the driver, and files for other programs."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def default_state() -> dict:
    """Counters of a service that has just begun."""
    return {"start_time": time.time(), "messages_processed": 0, "audio_files_processed": 0, "errors": 0, "is_running": False, "last_error": None, "user_stats": {}, "total_unique_users": 0}


def load_state(path: str, defaults: Mapping[str, Any] | None = None) -> dict:
    """What a JSON file says, over the defaults; the defaults alone if there is none or it can't be read."""
    out = dict(default_state() if defaults is None else defaults)
    try:
        with open(path, encoding="utf-8") as f:
            out.update(json.load(f))
    except (OSError, ValueError, TypeError):
        pass
    return out


def save_state(state: Mapping[str, Any], path: str) -> None:
    """Written beside and put in place, so a reader never sees half of it."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(dict(state), f, indent=2, ensure_ascii=False)
    os.replace(part, path)


def count_use(state: dict, user: int | str, name: str | None = None, now: float | None = None) -> dict:
    """A user's count and last use, one more."""
    own = state["user_stats"].setdefault(str(user), {"username": name or f"user_{user}", "usage_count": 0, "last_used": 0.0})
    own |= {"usage_count": own["usage_count"] + 1, "last_used": time.time() if now is None else now, **({"username": name} if name else {})}
    state["total_unique_users"] = len(state["user_stats"])
    return state


def users(spark: SparkSession, state: Mapping[str, Any]) -> DataFrame:
    """user_id, username, usage_count, last_used of a state, the most frequent first."""
    rows = [(u, s.get("username"), int(s.get("usage_count", 0)), float(s.get("last_used", 0.0))) for u, s in state.get("user_stats", {}).items()]
    return spark.createDataFrame(rows, "user_id string, username string, usage_count long, last_used double").orderBy(F.desc("usage_count"), "user_id")


def append_errors(errors: Iterable[Mapping[str, Any]], path: str) -> int:
    """Add errors to a JSON list in a file; one that can't be read begins anew. Returns how many there are."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    try:
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
    except (OSError, ValueError):
        known = []
    known = (known if isinstance(known, list) else []) + [dict(e) for e in errors]
    with open(path, "w", encoding="utf-8") as f:
        json.dump(known, f, indent=2, ensure_ascii=False)
    return len(known)


class Settings:
    """A YAML or JSON file, looked for in the given folders and anywhere under them."""

    def __init__(self, path: str, roots: Iterable[str] = (".",)):
        self.path = self.find(path, roots)
        with open(self.path, encoding="utf-8") as f:
            if self.path.suffix in (".yaml", ".yml"):
                import yaml

                self.values = yaml.safe_load(f) or {}
            else:
                self.values = json.load(f)

    @staticmethod
    def find(path: str, roots: Iterable[str]) -> Path:
        """The path itself, or below a root, or the first file of its name under a root, those that end like the path first."""
        if os.path.isabs(path) and os.path.exists(path):
            return Path(path)
        tail = path
        while tail.startswith("../"):
            tail = tail[3:]
        for root in map(Path, roots):
            if (root / tail).exists():
                return root / tail
            named = sorted(root.rglob(Path(tail).name), key=lambda p: (not str(p).endswith(tail), str(p)))
            if named:
                return named[0]
        raise FileNotFoundError(path)

    def get(self, key: str, default: Any = None) -> Any:
        """The value at a dotted key."""
        value = self.values
        for k in key.split("."):
            if not isinstance(value, Mapping) or k not in value:
                return default
            value = value[k]
        return value

    def lists(self, key: str) -> dict[str, list]:
        """A mapping of lists; anything else is an error."""
        value = self.get(key)
        if value is None:
            raise KeyError(f"no such key: {key}")
        if not isinstance(value, Mapping) or not all(isinstance(v, list) for v in value.values()):
            raise ValueError(f"{key} must map names to lists")
        return dict(value)


def export_dataset(rows: DataFrame, csv: str | None = None, jsonl: str | None = None) -> None:
    """A training set (dialog_id, text, topics, topics_csv) as CSV with a header and as JSON lines; each a folder of parts."""
    if csv:
        rows.select("dialog_id", "text", "topics_csv").write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(csv)
    if jsonl:
        rows.select("dialog_id", "text", "topics").write.mode("overwrite").json(jsonl)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """dialog_id, text, topics of an exported or hand-made CSV; a text may span lines."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if missing := sorted({"dialog_id", "text", "topics_csv"} - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    topics = F.filter(F.transform(F.split(F.coalesce("topics_csv", F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    return df.select("dialog_id", "text", topics.alias("topics"))


def size_mb(n: int | float) -> float:
    return round(n / (1024 * 1024), 2)


def uptime_hours(state: Mapping[str, Any], now: float | None = None) -> float:
    return round(((time.time() if now is None else now) - state["start_time"]) / 3600, 2)
