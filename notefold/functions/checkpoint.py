"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """The same rows, written once to the folder in ``spark.checkpoint.dir`` and read back.

    This runs a job at once. Where the setting is absent, a session on one machine
    (master ``local``) gets a folder of its own that goes when Python ends; on a
    cluster there is no folder that all executors see, so that is an error.
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` removes files no longer used.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="notefold-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
