"""Report sinks: CSV by category, journal CSV, JSON."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.display import reason_text

CANDIDATE_COLUMNS = ["file_id", "path", "root", "size", "confidence", "group", "keeper", "reason", "also", "applied"]
JOURNAL_COLUMNS = ["id", "op_id", "session_id", "ts", "action", "file_id", "item_id", "from_root", "from_rel", "to_root", "to_rel", "method", "conflict", "category", "size", "undoes", "undone_by"]


def candidate_rows(candidates: DataFrame, files: DataFrame, lang: str = "en") -> DataFrame:
    """category and CANDIDATE_COLUMNS: keeper as 0 or 1, `also` joined by commas, nulls as empty strings."""
    placed = candidates.join(files.select(F.col("id").alias("file_id"), F.col("rel_path").alias("path"), "root", "size"), "file_id")
    more = {"group": F.coalesce("group_id", F.lit("")), "keeper": F.col("is_keeper").cast("int"), "reason": reason_text(F.col("reason"), F.col("params"), lang), "also": F.concat_ws(",", "also"), "applied": F.coalesce("applied_op", F.lit(""))}
    return placed.select("category", *[more.get(c, F.col(c)).alias(c) for c in CANDIDATE_COLUMNS])


def candidate_csv(candidates: DataFrame, files: DataFrame, folder: str, lang: str = "en") -> None:
    """One folder of CSV for each category, header first."""
    candidate_rows(candidates, files, lang).write.mode("overwrite").partitionBy("category").csv(folder, header=True)


def journal_csv(journal: DataFrame, folder: str, session_id: int | None = None) -> None:
    rows = journal.filter(F.col("session_id") == session_id) if session_id is not None else journal
    rows.select(*JOURNAL_COLUMNS).write.mode("overwrite").csv(folder, header=True)


def write_json(folder: str, name: str, payload: object) -> str:
    """Indented, with non-ASCII text as it is; complete or absent."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path + ".next", "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=2, default=str)
    os.replace(path + ".next", path)
    return path
