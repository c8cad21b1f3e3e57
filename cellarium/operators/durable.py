"""Cuts of lineage that survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def held(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder: its readers plan over a table, not over its
    whole lineage, and lost executors cost no more than a read."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cellarium-"))
    return df.checkpoint()
