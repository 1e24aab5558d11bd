"""Where iterative operators write what they cut their lineage with."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only where none is named (single-machine tests)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or None
    found = context._jsc.sc().getCheckpointDir()
    if named is None and found.isDefined():
        return found.get()
    if named is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = named or "file://" + tempfile.mkdtemp(prefix="scanforge-")
    if not found.isDefined():
        context.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one, as a URI."""
    top = ensure_checkpoint_dir(spark)
    if top.startswith("file:") and not top.startswith("file://"):
        top = "file://" + top[5:]
    return f"{top.rstrip('/')}/files-{uuid.uuid4().hex}"
