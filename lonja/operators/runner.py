"""A linear chain of tasks with retries, messages between tasks, skips and backfill; and a timer for queries."""

from __future__ import annotations

import datetime as dt
import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lonja.sources.storage import Files
from lonja.sources.versioned import VersionedTable


class Skip(Exception):
    """Raised by a task: later tasks that don't ask to run anyway are skipped."""


@dataclass
class Task:
    name: str
    run: Callable[[dict], object]
    always: bool = False


@dataclass
class Run:
    day: str
    results: dict = field(default_factory=dict)
    states: dict = field(default_factory=dict)


def run_chain(tasks: list[Task], day: str, retries: int = 2, wait_s: float = 300.0, sleep: Callable[[float], None] = time.sleep) -> Run:
    """Runs tasks in order; each gets the results of those before. A task that fails ``retries`` + 1 times stops the run."""
    out, skipping = Run(day), False
    for t in tasks:
        if skipping and not t.always:
            out.states[t.name] = "skipped"
            continue
        for attempt in range(retries + 1):
            try:
                out.results[t.name] = t.run({"day": day, **out.results})
                out.states[t.name] = "ok"
                break
            except Skip:
                out.states[t.name], skipping = "skipped", True
                break
            except Exception:
                if attempt == retries:
                    out.states[t.name] = "failed"
                    raise
                sleep(wait_s)
    return out


def backfill(tasks: list[Task], first: str, last: str, **options) -> list[Run]:
    day, end, out = dt.date.fromisoformat(first), dt.date.fromisoformat(last), []
    while day <= end:
        out.append(run_chain(tasks, day.isoformat(), **options))
        day += dt.timedelta(days=1)
    return out


def require_table(spark: SparkSession, path: str) -> None:
    """Skips a task, and those after it, while the versioned table it reads isn't there."""
    if not VersionedTable.exists(spark, path):
        raise Skip(f"no table at {path}")


def scanned(df: DataFrame) -> dict:
    """Runs a query and tells rows, files and bytes: of all the files behind it, and read by its scans after pruning."""
    rows = df.count()
    listed = df.inputFiles()
    sizes = [Files(df.sparkSession, f).length(f) for f in listed]
    return {"rows": rows, "files": len(listed), "bytes": sum(sizes)}


def explained(df: DataFrame) -> str:
    """The formatted physical plan."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def timed(make: Callable[[], DataFrame], repeat: int = 3) -> dict:
    """Median seconds of full evaluations, written to a sink that discards rows."""
    took = []
    for _ in range(repeat):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return {"median_s": statistics.median(took), "runs": took}
