"""Delivery formats: JSON lines, CSV with JSON lists, small reports."""

from __future__ import annotations

import csv
import fcntl
import io
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """JSON lines with fixed fields in order, nulls included, letters unescaped."""
    df.select(*(fields or df.columns)).write.option("ignoreNullFields", "false").json(path)


def csv_columns(df: DataFrame) -> DataFrame:
    """All columns as CSV text: lists, maps and structs as JSON, flags in lower case, null as the empty string."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        nested = kind.startswith(("array", "map", "struct"))
        out.append(F.coalesce(F.to_json(c) if nested else c.cast("string"), F.lit("")).alias(name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    csv_columns(df).write.options(header=True, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


#: Rows that may come to the driver as one text; more are an error, as such a table is written instead.
MOST_ROWS = 100_000


def _small(df: DataFrame) -> list:
    """All rows of a small table; a larger one is refused, never cut."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: write the table instead")
    return rows


def csv_text(df: DataFrame) -> str:
    """All rows of a small table as a CSV text for download."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows(_small(csv_columns(df)))
    return out.getvalue()


def write_file(path: str | Path, text: str) -> None:
    """A small file, replaced in one step."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def append_lines(path: str | Path, rows: list[dict]) -> None:
    """Add small records to a file of JSON lines of one machine: under a lock, and on the disk when this returns."""
    with Path(path).open("a", encoding="utf-8") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        f.write("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))
        f.flush()
        os.fsync(f.fileno())


def clone_file(template: str | Path, path: str | Path) -> None:
    """A copy of a template file; one that is there is never overwritten."""
    with Path(template).open("rb") as source, Path(path).open("xb") as target:
        target.write(source.read())


def write_texts(df: DataFrame, path: str, key: str, text: str, split: str) -> None:
    """The texts, partitioned by split, with file-safe keys."""
    df.select(F.replace(F.col(key), F.lit(":"), F.lit("__")).alias("name"), F.col(text).alias("text"), split).write.partitionBy(split).json(path)


def markdown_table(df: DataFrame) -> str:
    """A Markdown table of all rows of a small table, pipes escaped."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in row) + " |" for row in _small(df)]
    return "\n".join(lines)


def quality_report(sections: dict[str, DataFrame], title: str) -> str:
    """A Markdown report of small aggregates, one section each."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown_table(df)}" for name, df in sections.items())]) + "\n"
