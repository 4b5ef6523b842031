"""Results as CSV and JSON, read back by name, and charts of small frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A stored CSV or JSON result, told by its name; give a schema to spare a pass over a large one."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.rstrip("/").endswith("json"):
        return reader.json(path)
    return reader.option("header", True).csv(path) if schema else reader.option("header", True).option("inferSchema", True).csv(path)


def chart(df: DataFrame, x: str, y: list[str], path: str, most: int = 5000) -> None:
    """A line chart as PNG. Long frames are averaged down to about `most` points on Spark first."""
    import matplotlib  # optional

    matplotlib.use("Agg")
    from matplotlib import pyplot as plt
    from pyspark.sql import functions as F

    lo, hi = df.agg(F.min(x), F.max(x)).first()
    width = max((hi - lo) / most, 1e-9) if lo is not None else 1.0
    small = df.groupBy(F.floor((F.col(x) - F.lit(lo)) / width).alias("_b")).agg(F.min(x).alias(x), *[F.avg(c).alias(c) for c in y]).orderBy(x).toPandas()
    figure, axes = plt.subplots()
    for c in y:
        axes.plot(small[x], small[c], label=c)
    axes.set_xlabel(x)
    axes.legend()
    figure.savefig(path)
    plt.close(figure)
