"""An append-only store of feedback and cases. Every change is a new row; views give the latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERDICTS = ("confirmed", "dismissed", "unsure")


class CaseStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, table: str, row: tuple, schema: str) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{table}")

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except Exception as e:  # noqa: BLE001  nothing was written yet
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    FEEDBACK = "id bigint, dataset string, entity bigint, verdict string, note string"
    CASES = "id bigint, case_id string, title string, status string, entities array<bigint>"

    def give(self, dataset: str, entity: int, verdict: str, note: str = "") -> None:
        if verdict not in VERDICTS:
            raise ValueError(f"verdict must be one of {VERDICTS}")
        self._append("feedback", (self.feedback().count(), dataset, entity, verdict, note), self.FEEDBACK)

    def feedback(self) -> DataFrame:
        return self._read("feedback", self.FEEDBACK)

    def verdicts(self, dataset: str) -> DataFrame:
        from cairnflow.operators.risk import latest_verdicts

        return latest_verdicts(self.feedback().where(F.col("dataset") == dataset))

    def put_case(self, case_id: str, title: str, entities: list[int], status: str = "open") -> None:
        self._append("cases", (self._read("cases", self.CASES).count(), case_id, title, status, entities), self.CASES)

    STATUS = "id bigint, alert_id string, status string"

    def set_status(self, alert_id: str, status: str) -> None:
        self._append("statuses", (self._read("statuses", self.STATUS).count(), alert_id, status), self.STATUS)

    def statuses(self) -> DataFrame:
        """(alert_id, status, n_changes): the last status of each alert that was given one."""
        return self._read("statuses", self.STATUS).groupBy("alert_id").agg(F.max_by("status", "id").alias("status"), F.count(F.lit(1)).alias("n_changes"))

    def cases(self) -> DataFrame:
        last = F.max_by(F.struct("title", "status", "entities"), "id").alias("x")
        return self._read("cases", self.CASES).groupBy("case_id").agg(last).select("case_id", "x.*")
