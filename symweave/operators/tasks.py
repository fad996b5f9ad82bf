"""The annotation work queue as relations: ``tasks(ord, task_id, ...)`` and ``submissions(seq, task_id, result)``.

A task is pending until a submission of it exists; the latest submission is its
result. Queues change by appending rows, so any number of workers may submit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TaskList:
    tasks: DataFrame
    submissions: DataFrame
    allow_resubmit: bool = False
    name: str = "tasks"

    def add(self, more: DataFrame) -> TaskList:
        """Append tasks; KeyError if an id is already there."""
        both = self.tasks.select("task_id").unionByName(more.select("task_id"))
        twice = both.groupBy("task_id").count().where("count > 1").join(more.select("task_id"), "task_id", "left_semi").limit(1).collect()
        if twice:
            raise KeyError(twice[0]["task_id"])
        return replace(self, tasks=self.tasks.unionByName(more))

    def submit(self, task_id, result: str, callback: Callable[[object, str], None] | None = None) -> TaskList:
        """Append a submission; the callback runs first, and if it fails the task stays pending."""
        if self.tasks.where(F.col("task_id") == task_id).isEmpty():
            raise KeyError(task_id)
        if not self.allow_resubmit and not self.submissions.where(F.col("task_id") == task_id).isEmpty():
            raise ValueError(f"task {task_id!r} is already submitted")
        if callback is not None:
            callback(task_id, result)
        last = self.submissions.agg(F.max("seq")).first()[0]
        row = self.tasks.sparkSession.createDataFrame([((last or 0) + 1, task_id, result)], self.submissions.schema)
        return replace(self, submissions=self.submissions.unionByName(row))

    def pending(self) -> DataFrame:
        return self.tasks.join(self.submissions.select("task_id"), "task_id", "left_anti")

    def pending_page(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Pending tasks in order of insertion."""
        out = self.pending().orderBy("ord")
        out = out.offset(offset) if offset else out
        return out if limit is None else out.limit(limit)

    def any_pending(self) -> DataFrame:
        return self.pending().orderBy("ord").limit(1)

    def is_pending(self, task_id) -> bool:
        return not self.pending().where(F.col("task_id") == task_id).isEmpty()

    def progress(self) -> DataFrame:
        """(total, submitted, pending, text)"""
        done = self.submissions.select("task_id").distinct().withColumn("done", F.lit(1))
        flat = self.tasks.join(done, "task_id", "left").agg(F.count("*").alias("total"), F.coalesce(F.sum("done"), F.lit(0)).alias("submitted"))
        return flat.withColumn("pending", F.col("total") - F.col("submitted")).withColumn("text", F.format_string("%d/%d submitted, %d pending", "submitted", "total", "pending"))

    def recent(self, n: int = 5) -> DataFrame:
        """The last ``n`` submissions, oldest first; a resubmitted task appears again."""
        return self.submissions.orderBy(F.desc("seq")).limit(n).orderBy("seq")

    def results(self) -> DataFrame:
        """(ord, task_id, result): the latest result of each task, null while pending."""
        latest = self.submissions.groupBy("task_id").agg(F.max_by("result", "seq").alias("result"))
        return self.tasks.select("ord", "task_id").join(latest, "task_id", "left")

    def result(self, task_id) -> str | None:
        row = self.results().where(F.col("task_id") == task_id).first()
        if row is None:
            raise KeyError(task_id)
        return row["result"]

    def clear_submitted(self) -> tuple[TaskList, int]:
        """The list without submitted tasks, and their number."""
        gone = self.tasks.join(self.submissions.select("task_id").distinct(), "task_id", "left_semi").count()
        return replace(self, tasks=self.pending(), submissions=self.submissions.limit(0)), gone


def describe_tasks(definitions: DataFrame, noted: DataFrame, order: DataFrame | None = None, skip_existing_notes: bool = True) -> DataFrame:
    """Definitions to be described (column ``task_id``), in the given order(task_id, position) or by id, without those that are noted."""
    out = definitions.join(noted.select("task_id").distinct(), "task_id", "left_anti") if skip_existing_notes else definitions
    if order is None:
        return out.withColumn("ord", F.col("task_id"))
    return out.join(order.select("task_id", F.col("position").alias("ord")), "task_id")
