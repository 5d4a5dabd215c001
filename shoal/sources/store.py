"""Tables that runs write: partitions replaced whole, and append-only logs of what each run did."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession

from shoal.operators import tables


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write ``rows`` in place of the partitions that they name; others stay, and no rows replace nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


#: The logs and their columns; every row also carries its run and when it was written.
LOGS = {
    "manifest": "run_type string, status string, summary_json string, error string",
    "evidence": "stage string, claim string, source string, as_of string, quote string",
    "calc": "output string, value string, func string, inputs_json string",
    "conflicts": "field string, source_a string, value_a string, source_b string, value_b string, resolution string",
}


class Run:
    """One run's entries. ``with Run(...) as r`` notes the run as running, then as complete or failed; the logs are appended once, at the end."""

    def __init__(self, spark: SparkSession, folder: str, run_id: str, run_type: str):
        self.spark, self.folder, self.run_id, self.run_type = spark, folder, run_id, run_type
        self.rows: dict[str, list[tuple]] = {k: [] for k in LOGS}
        self.summary: dict | None = None

    def _append(self, log: str, rows: list[tuple]) -> None:
        if rows:
            schema = f"run_id string, at timestamp, {LOGS[log]}"
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{log}")

    def _row(self, *values) -> tuple:
        return (self.run_id, datetime.now(timezone.utc), *values)

    def _state(self, status: str, error: str | None = None) -> None:
        self._append("manifest", [self._row(self.run_type, status, None if self.summary is None else json.dumps(self.summary), error)])

    def __enter__(self) -> Run:
        self._state("running")
        return self

    def claim(self, stage: str, claim: str, source: str | None = None, as_of: str | None = None, quote: str | None = None) -> None:
        self.rows["evidence"].append(self._row(stage, claim, source, as_of, quote))

    def calc(self, output: str, value: object, func: str, inputs: dict) -> None:
        self.rows["calc"].append(self._row(output, str(value), func, json.dumps(inputs, default=str)))

    def conflict(self, field: str, a: tuple[str, object], b: tuple[str, object], resolution: str = "manual") -> None:
        self.rows["conflicts"].append(self._row(field, a[0], str(a[1]), b[0], str(b[1]), resolution))

    def __exit__(self, kind: type | None, error: BaseException | None, at: TracebackType | None) -> None:
        for log, rows in self.rows.items():
            self._append(log, rows)
        self._state("failed" if kind else "complete", str(error) if error else None)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state of every run."""
    return tables.latest(spark.read.parquet(f"{folder}/manifest"), ["run_id"], "at")
