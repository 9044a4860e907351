"""Cutting lineage in loops, through the folder that all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame


def folder(df: DataFrame) -> str:
    """The context's checkpoint folder, by ``spark.checkpoint.dir``.

    Only where that is unset and the master runs in this process is a temporary folder used.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="codeloupe-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read back."""
    folder(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``checkpointed`` for large tables: by columns, compressed, and read only where needed.

    The files stay in a folder of their own below the checkpoint folder until that is cleaned.
    """
    path = f"{folder(df)}/stored-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
