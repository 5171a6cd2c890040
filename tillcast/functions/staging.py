"""Durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def staging_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder stands in only for a local master, where all tasks see it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tillcast-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def snapshot(frame: DataFrame, label: str, **faults: Column) -> DataFrame:
    """Write the frame as parquet in the shared folder and read it back.

    Later steps then scan only the columns they need, see true sizes, and survive a
    lost executor without going back to the raw log.  ``faults`` are counts that must be zero:
    they are taken in the pass that writes, and the table is only handed out if they are.
    """
    path = f"{staging_folder(frame.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    kept, seen = frame, None
    if faults:
        seen = Observation(f"{label}-{uuid.uuid4().hex}")
        kept = frame.observe(seen, *[count.alias(name) for name, count in faults.items()])
    kept.write.parquet(path)
    found = {name.replace("_", " "): n for name, n in (seen.get if seen else {}).items() if n}
    if found:
        raise ValueError(f"{label}: " + ", ".join(f"{n} {name}" for name, n in found.items()))
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
