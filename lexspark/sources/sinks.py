"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUTS = ("annotated", "normalized", "aggregated")


def write_review(issues: DataFrame, path: str) -> None:
    """Issues as JSON, a folder a job."""
    issues.write.mode("overwrite").partitionBy("job_id").json(path)


def build_manifest(artifacts: DataFrame) -> DataFrame:
    """One row a job: its artifacts in order of path, and its status: failed where an error is noted."""
    errors = F.array_join(F.array_sort(F.collect_set("error")), "; ")
    item = F.struct("virtual_path", "type")
    return artifacts.groupBy("job_id").agg(F.array_sort(F.collect_list(item)).alias("artifacts"), errors.alias("errors")).withColumn("status", F.when(F.col("errors") == "", "ok").otherwise("failed"))


def selected_outputs(asked: list[str]) -> list[str]:
    """Names asked for, ``all`` standing for every one, without repeats, in order."""
    names = [n for a in asked for n in (OUTPUTS if a == "all" else (a,))]
    unknown = set(names) - set(OUTPUTS)
    if unknown:
        raise ValueError(f"unknown outputs: {sorted(unknown)}")
    return list(dict.fromkeys(names))


def write_metadata(frames: dict[str, DataFrame], asked: list[str], path: str) -> None:
    for name in selected_outputs(asked):
        frames[name].write.mode("overwrite").json(f"{path}/{name}")


def write_by_category(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("category").json(path)


def append_run_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def register_artifacts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Artifacts of results that succeeded, whose path is not yet registered, each once."""
    return new.where("ok and virtual_path is not null").dropDuplicates(["thread_id", "virtual_path"]).join(existing.select("thread_id", "virtual_path"), ["thread_id", "virtual_path"], "left_anti")


def save_index(rules: DataFrame, path: str) -> None:
    rules.write.mode("overwrite").json(path)
