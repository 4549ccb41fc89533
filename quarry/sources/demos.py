"""Loaders of the public demonstration data sets, from a folder that holds them as CSV or Parquet.

Nothing is downloaded: ``folder`` names where the files lie, in any store that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: For each set its target and the type of its problem.
DEMOS = {
    "breast_cancer": ("target", "binary"),
    "churn": ("Churn", "binary"),
    "diabetes": ("target", "regression"),
    "fraud": ("fraud", "binary"),
    "weather": ("Temp", "time_series_regression"),
    "wine": ("target", "multiclass"),
}


def load_demo(spark: SparkSession, folder: str, name: str, n_rows: int | None = None, target: str | None = None) -> tuple[DataFrame, str]:
    """The set's table (the first ``n_rows`` of it, if asked for) and the name of its target; blank strings are null."""
    if name not in DEMOS:
        raise ValueError(f"no demonstration data {name!r}")
    base, y = f"{folder}/{name}", target or DEMOS[name][0]
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}.parquet")
    stored = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
    df = spark.read.parquet(f"{base}.parquet") if stored else spark.read.option("header", True).option("inferSchema", True).csv(f"{base}.csv")
    if y not in df.columns:
        raise ValueError(f"{name} has no column {y!r}")
    strings = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    df = df.withColumns({c: F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`")) for c in strings}) if strings else df
    return (df.limit(n_rows) if n_rows else df), y


def _loader(name: str):
    def load(spark: SparkSession, folder: str, n_rows: int | None = None) -> tuple[DataFrame, str]:
        return load_demo(spark, folder, name, n_rows)

    load.__doc__ = f"The {name.replace('_', ' ')} data and the name of their target."
    return load


load_breast_cancer, load_churn, load_diabetes, load_fraud, load_weather, load_wine = (_loader(n) for n in DEMOS)
