"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelab.session import ensure_checkpoint_dir

#: A word of the white-space contracts: anything but space, \t \n \v \f \r.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: A word of the decontamination contract: a-z, 0-9 and every character beyond ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else. ``lower`` folds every script, so it is
    used where the text is pure ASCII (equal counts of bytes and characters)."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def word_array(text: Column, pattern: str) -> Column:
    """All matches of ``pattern``; null text has no words."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                      F.array().cast("array<string>"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_name(taken: list[str], name: str) -> str:
    """``name``, or with underscores appended until no column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def small_batches(batches: Iterator[pa.RecordBatch], column: str,
                  limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the values of ``column`` stay near ``limit``
    bytes: memory follows the longest single row, not the rows of a batch."""
    for b in batches:
        i = b.schema.get_field_index(column)
        if b.num_rows and b.column(i).nbytes > limit:
            rows = max(1, int(b.num_rows * limit / b.column(i).nbytes))
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)
        elif b.num_rows:
            yield b


def small_arrays(values: pa.Array, limit: int = 8 << 20) -> Iterator[pa.Array]:
    """Consecutive slices of ``values`` of about ``limit`` bytes, in even numbers of rows."""
    rows = max(1, int(len(values) * limit / max(limit, values.nbytes)))
    for at in range(0, len(values), rows):
        yield values.slice(at, rows)
