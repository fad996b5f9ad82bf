"""Containment of call sites in definition bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contained(bodies: DataFrame, calls: DataFrame, half_open: bool = False) -> DataFrame:
    """Rows of ``calls(file_path, start_byte, end_byte, ...)`` within ``bodies(file_path, body_start, body_end, ...)`` of the same file.

    An equi-join on the file with two inequalities: a call belongs to every
    definition around it. Files bound the work; a hot file is split by the join.
    ``half_open`` excludes calls that end at the body's end.
    """
    inside = (F.col("start_byte") >= F.col("body_start")) & (F.col("end_byte") < F.col("body_end") if half_open else F.col("end_byte") <= F.col("body_end"))
    return calls.join(bodies, "file_path").where(inside)
