"""Error lines of build logs: one rule per tool, over all tools in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import strip


def build_errors(log_lines: DataFrame) -> DataFrame:
    """``repo_id, tool, line_no, line`` -> the error lines, as messages.

    Tools: ``tsc dotnet maven gradle`` keep lines with their error mark; ``go
    build`` and ``go vet`` keep every line that is neither blank nor a ``#``
    header and put the name of the step in front.
    """
    line, tool, text = F.col("line"), F.col("tool"), strip(F.col("line"))
    step = F.when(tool == "go build", "build").when(tool == "go vet", "vet")
    is_error = (
        F.when(tool == "tsc", line.contains("error TS"))
        .when(tool == "dotnet", line.contains("error CS"))
        .when(tool == "maven", line.contains("ERROR"))
        .when(tool == "gradle", F.lower(line).contains("error:"))
        .when(step.isNotNull(), (text != "") & ~line.startswith("#"))
        .otherwise(False)
    )
    message = F.when(step.isNotNull(), F.concat(step, F.lit(": "), text)).otherwise(text)
    return log_lines.filter(is_error).select(
        "repo_id", "tool", "line_no", message.alias("message")
    )


def read_logs(spark, path: str) -> DataFrame:
    """Logs stored as ``<path>/repo_id=<id>/tool=<name>/*.log``, one row per line.

    ``line_no`` counts from 1 inside ``log_file``.  A log is read whole, as the
    lines of a file say nothing of their place; builds write logs of megabytes.
    """
    logs = spark.read.text(path, wholetext=True)
    text = F.regexp_replace("value", r"\r\n?", "\n")
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)
    return logs.select(
        F.col("repo_id").cast("long").alias("repo_id"), "tool", F.col("_metadata.file_path").alias("log_file"),
        F.posexplode(lines).alias("place", "line"),
    ).select("repo_id", "tool", "log_file", (F.col("place") + 1).cast("long").alias("line_no"), "line")
