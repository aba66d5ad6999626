"""Small JSON catalogues of signals and ideas."""

from pyspark.sql import DataFrame, SparkSession

from tallyweave.schemas import ALPHA_CATALOG, IDEA


def read_alpha_catalog(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A JSON list per file, or one object per line (what `write_catalog` writes) with multi_line=False."""
    return spark.read.schema(ALPHA_CATALOG).option("multiLine", multi_line).json(path)


def read_ideas(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(IDEA).option("multiLine", multi_line).json(path)


def write_catalog(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
