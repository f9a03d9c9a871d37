"""Session defaults and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Setting of a session: into how many parts tables of texts are spread by their key as they are read; unset, as they lie.
SPREAD = "spark.inkwell.spread"


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("inkwell")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config(SPREAD, str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the folder of spark.checkpoint.dir and read it back, so a lost executor loses no result.

    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table of compressed columns in that folder. For large tables, of which later steps read some columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder in which lineage is cut and tables are kept: the session's, or that of spark.checkpoint.dir.

    Where neither is set, a local session, as in tests, gets a temporary one. On a cluster that folder would be another
    on every machine, so there it is an error.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="inkwell-")
        context.setCheckpointDir(folder)
        known = context._jsc.sc().getCheckpointDir()
    return known.get()
