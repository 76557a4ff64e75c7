"""Session settings that the operators rely on, and names of helper columns."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_checkpoints(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; a temporary one only on a single machine, where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[\d*,\s]+\])?", context.master):
            raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
