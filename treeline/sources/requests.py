"""The request contract: one JSON object in, one out; a catalogue of commands; request logs as tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Commands, whether they only read, and their parameters.
COMMANDS: dict[str, tuple[bool, str]] = {
    "search": (True, "name kind pattern language"), "search_page": (True, "name after max_items max_bytes"), "outline": (True, "path"), "references": (True, "name declared_in"), "where": (True, "name"),
    "deps": (True, "path"), "explain": (True, "path offset"), "surface": (True, "package"), "impact": (True, "name declared_in"), "dead": (True, ""), "imports": (True, ""), "skipped": (True, "language"),
    "relationships": (True, "name declared_in max_files max_items max_lookups"), "navigate": (True, "path offset"), "resolve": (True, "path offset"), "context": (True, "name declared_in max_items max_bytes"), "workspace_files": (True, ""), "file": (True, "path"),
    "discover": (True, ""), "schema": (True, "command"),
}
BUDGETS = {"max_items": (20, 64), "max_bytes": (16384, 1 << 20), "max_lookups": (64, 512), "max_files": (64, 1024)}


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(name, read_only, params.split()) for name, (read_only, params) in sorted(COMMANDS.items())]
    return spark.createDataFrame(rows, "command string, read_only boolean, parameters array<string>")


def clamp(budget: dict[str, int]) -> dict[str, int]:
    """Budgets with defaults filled in and limits kept; a budget below one is an error."""
    out = {}
    for key, (usual, most) in BUDGETS.items():
        value = budget.get(key, usual)
        if value < 1:
            raise ValueError(f"{key} must be at least 1")
        out[key] = min(value, most)
    return out


def serve(lines: Iterable[str], handlers: dict[str, Callable[..., DataFrame]]) -> Iterator[str]:
    """Answer request lines; a bad line gets an error with its id if it has one."""
    for line in lines:
        key = None
        try:
            request = json.loads(line)
            key = request.pop("id", None)
            command = request.pop("command")
            if command not in handlers:
                raise KeyError(f"unknown command {command}")
            rows = [r.asDict(recursive=True) for r in handlers[command](**request).collect()]
            yield json.dumps({"id": key, "status": "ok", "schema": 1, "result": rows}, default=str)
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            yield json.dumps({"id": key, "status": "error", "code": "bad_request", "message": str(e)})
        except LookupError as e:
            yield json.dumps({"id": key, "status": "error", "code": "not_found", "message": str(e)})


def parse_requests(lines: DataFrame) -> DataFrame:
    """lines(value) as id, command and the rest as JSON text; lines that are no object have a null command."""
    known = F.from_json("value", "id long, command string, name string, path string")
    return lines.select(known.alias("r")).select("r.*")


def replies(results: DataFrame) -> DataFrame:
    """One JSON text a row: id, status, schema, result."""
    return results.select(F.to_json(F.struct("id", F.lit("ok").alias("status"), F.lit(1).alias("schema"), "result")).alias("value"))


def tail(history: DataFrame, most: int = 20) -> DataFrame:
    """The newest records, oldest first; a top-k, so each task keeps `most` rows."""
    return history.orderBy(F.desc("id")).limit(most).orderBy("id")
