"""Where plans are cut: reliable checkpoints in the folder that a cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where nothing is set, on one machine (as in tests), a temporary folder is taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="granary-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    Unless the cluster's settings say otherwise, Spark removes the files once no table refers to them any more.
    """
    context = df.sparkSession.sparkContext
    if context.getConf().get(CLEAN) is None:
        context._jsc.sc().conf().set(CLEAN, "true")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
