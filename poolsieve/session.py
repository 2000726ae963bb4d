"""Session defaults, table access, and the seeded hash that stands for every random draw."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "poolsieve", **conf: str) -> SparkSession:
    """A session with adaptive execution; the number of shuffle partitions is left to the cluster's settings."""
    builder = SparkSession.builder.appName(app)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder (``spark.checkpoint.dir``) and read back: lineage ends there, a lost executor costs nothing, and sizes
    are those of the files (a checkpoint keeps the estimates of its plan, which multiply over rounds of joins). Only where driver and executors are one process may the folder
    be unset; a temporary one is set then. Files are not deleted by us."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="poolsieve-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/kept-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Roles:
    """Which columns of a table hold what."""

    id: str = "id"
    text: str = "text"
    label: str | None = None

    def check(self, df: DataFrame) -> DataFrame:
        missing = [c for c in (self.id, self.text, self.label) if c and c not in df.columns]
        if missing:
            raise ValueError(f"columns {missing} are not among {df.columns}")
        return df


def hash01(seed: int, *cols: Column | str) -> Column:
    """Uniform in [0, 1), from the first 32 bits of an md5 of seed and columns: the same on every engine."""
    given = F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(given), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def literal_vector(values) -> Column:  # noqa: ANN001
    """A vector as a literal array of doubles."""
    return F.array(*[F.lit(float(v)) for v in values])
