"""Shared helpers of the training-data operators: table access, checkpoints and Arrow batch slicing."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """``df`` narrowed to the wanted columns with the wanted types, so that extra columns can't clash."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in wanted.items()))


def packed(df: DataFrame) -> DataFrame:
    """``df`` as the one column ``row``, so that helper columns beside it can't clash with its own."""
    return df.select(F.struct(*(F.col(f"`{name.replace('`', '``')}`") for name in df.columns)).alias("row"))


def unpacked(df: DataFrame, names: list[str], **replaced: Column) -> DataFrame:
    """The columns ``names`` of ``row`` again, some of them replaced."""
    return df.select(*(replaced.get(name, F.col("row").getField(name)).alias(name) for name in names))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``.

    Only where that is unset and the master runs in this very process (as in tests) is it a
    temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="codeloupe-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Successive slices of a batch and the UTF-8 bytes of a text column (null: empty).

    A slice holds ``most_bytes`` of text at most, or one row, so a task's memory doesn't depend on
    how many long texts an Arrow batch happens to hold.
    """
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    start, size, found = 0, 0, []
    for i in range(len(values)):
        value = values[i].as_py() or b""
        if found and size + len(value) > most_bytes:
            yield batch.slice(start, i - start), found
            start, size, found = i, 0, []
        found.append(value)
        size += len(value)
    if found:
        yield batch.slice(start), found


def map_texts(
    df: DataFrame,
    column: str,
    schema: str,
    work: Callable[[pa.RecordBatch, list[bytes]], pa.RecordBatch | dict | None],
    most_bytes: int = 4 << 20,
) -> DataFrame:
    """``mapInArrow`` over bounded slices of the text column; ``work`` returns the columns of the result."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, column, most_bytes):
                made = work(part, texts)
                if made is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if not isinstance(made[f.name], pa.Array) else made[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
