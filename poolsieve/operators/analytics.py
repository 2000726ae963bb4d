"""Experiment logs: flattening of configurations, metrics in long and wide form, bands over seeds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: the order in which a run's metric files are looked for, and the prefixes of a metric's key
METRIC_FILES = ["target_metrics.json", "successor_metrics.json", "acquisition_metrics.json", "metrics.json"]
PREFIXES = ["test_", "eval_", ""]
# fixed value: metric files of influence quantiles, their share
QUANTILE_FILE = r"^target_tracin_quantile_(.+)_metrics\.json$"


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t distribution with whole degrees of freedom: bisection on its distribution function,
    a finite series in the cosine of atan(t / sqrt(df))."""

    def below(t: float) -> float:
        angle = math.atan(t / math.sqrt(df))
        c2, odd = math.cos(angle) ** 2, df % 2
        term, series = 1.0, 1.0 if df > 1 else 0.0
        for i in range(2 + odd, df - 1, 2):
            term *= (i - 1) / i * c2
            series += term
        inner = 2 / math.pi * (angle + math.sin(angle) * math.cos(angle) * series) if odd else math.sin(angle) * series
        return (1 + inner) / 2

    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return (lo + hi) / 2


def bands(metrics: DataFrame, keys: list[str], value: str, confidence: float | None = 0.95) -> DataFrame:
    """Rows (keys, mean, std, n, low, high): mean and sample deviation by group; the band is mean -+ t(n) std / sqrt(n), with as many
    degrees of freedom as there are values, or mean -+ std without a confidence. A single value has no band."""
    g = metrics.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
    if confidence is None:
        half: Column = F.col("std")
    else:
        counts = [r[0] for r in g.select("n").distinct().where("n > 1").collect()]  # a row for each number of seeds
        t = F.create_map(*[F.lit(x) for n in counts for x in (n, t_quantile((1 + confidence) / 2, n))]) if counts else F.create_map(F.lit(0).cast("long"), F.lit(0.0))
        half = F.try_element_at(t, F.col("n")) * F.col("std") / F.sqrt("n")
    return g.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def first_metric(run: Column, metric: str, prefixes: list[str] = PREFIXES) -> Column:
    """The first value present under prefix + metric in a map of a run's metrics."""
    return F.coalesce(*[F.try_element_at(run, F.lit(p + metric)) for p in prefixes])


def wide(metrics: DataFrame, keys: list[str], iterations: int, value: str = "value", missing: float | None = None) -> DataFrame:
    """One row a run with columns f1_0 ... f1_{n-1}; iterations that are missing are null; the value -1 of overlap metrics becomes null."""
    v = F.when(F.col(value) != -1, F.col(value))
    out = metrics.groupBy(*keys).agg(*[F.max(F.when(F.col("iteration") == i, v)).alias(f"f1_{i}") for i in range(iterations)])
    return out if missing is None else out.fillna(missing, [f"f1_{i}" for i in range(iterations)])


def long(table: DataFrame, keys: list[str]) -> DataFrame:
    """The wide form back to rows (keys, iteration, value)."""
    cols = [c for c in table.columns if c.startswith("f1_")]
    flat = table.unpivot(keys, cols, "name", "value")
    return flat.select(*keys, F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("iteration"), "value")


def padded(metrics: DataFrame, keys: list[str], iterations: int) -> DataFrame:
    """All iterations 0 ... n - 1 of each run, null where nothing was logged."""
    runs = metrics.select(*keys).distinct().withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    return runs.join(metrics, [*keys, "iteration"], "left")


def first_file(files: DataFrame, run: str, name: str) -> DataFrame:
    """Of each run's files the one that comes first in METRIC_FILES."""
    place = F.array_position(F.array(*[F.lit(x) for x in METRIC_FILES]), F.col(name))
    order = Window.partitionBy(run).orderBy(place, name)
    return files.where(place > 0).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Rows (run, config, file, metrics, quantiles): each folder below ``root`` with a config.yaml, told as JSON, and metrics of acquisition or plain ones; the
    file is the first of METRIC_FILES; ``quantiles`` maps the shares of influence quantiles to the text of their metric files."""
    from ..sources.readers import yaml_as_json

    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{yaml,json}").select("value", F.col("_metadata.file_path").alias("path"))
    files = files.withColumn("run", F.regexp_replace("path", r"/[^/]*$", "")).withColumn("file", F.regexp_extract("path", r"([^/]*)$", 1))
    config = files.where("file = 'config.yaml'").select("run", yaml_as_json(F.col("value")).alias("config"))
    whole = files.where(F.col("file").isin("acquisition_metrics.json", "metrics.json")).select("run").distinct()
    share = F.regexp_extract("file", QUANTILE_FILE, 1)
    shares = files.where(share != "").groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(share.alias("k"), F.col("value").alias("v"))))).alias("quantiles"))
    found = first_file(files.drop("path"), "run", "file").join(whole, "run", "left_semi").join(config, "run").join(shares, "run", "left")
    return found.select("run", "config", "file", F.col("value").alias("metrics"), "quantiles")


def _series(metrics: Column, metric: str) -> Column:
    """Values by iteration; a single number is the value of every iteration, told as one."""
    lists, single = F.from_json(metrics, "map<string, array<double>>"), F.from_json(metrics, "map<string, double>")
    one = first_metric(single, metric)
    return F.coalesce(first_metric(lists, metric), F.when(one.isNotNull(), F.array(one)))


def collect_metrics(spark: SparkSession, root: str, metric: str) -> DataFrame:
    """Rows (run, deleted, iteration, value) of a metric over all runs below ``root``; -1 becomes null. ``deleted`` is null for the run's own metrics, and the share for those of
    an influence quantile where the configuration asks for them."""
    every = runs(spark, root)
    asked = F.get_json_object("config", "$.tracin.use") == "true"
    more = every.where(asked).select("run", F.explode("quantiles").alias("deleted", "metrics"))
    found = every.select("run", F.lit(None).cast("string").alias("deleted"), "metrics").union(more)
    found = found.select("run", "deleted", _series(F.col("metrics"), metric).alias("v")).where("v is not null")
    return found.select("run", "deleted", F.posexplode("v").alias("iteration", "value")).withColumn("value", F.when(F.col("value") != -1, F.col("value")))


def flat_config(config: Column) -> Column:
    """A configuration, as JSON, as one struct: strategy, models, what of the pool was left out, how it was sub-sampled, seed and data set."""
    get = lambda path: F.get_json_object(config, path)
    model = lambda name: F.coalesce(get(f"$.{name}.name"), get(f"$.{name}.checkpoint"))
    learns = get("$.al").isNotNull()
    acquisition = F.coalesce(model("acquisition_model"), model("model"))
    successor = F.coalesce(model("successor_model"), acquisition)
    target = F.when(get("$.target_model").isNotNull(), model("target_model")).otherwise(successor)
    threshold = get("$.al.plasm_thresh")
    number = threshold.try_cast("double")
    kept = F.when(number != 1, F.round(1 - number, 4).cast("string")).when(number.isNull(), threshold)
    sampling = get("$.al.sampling_type")
    drawn = F.concat(F.lit("k="), get("$.al.gamma_or_k_confident_to_save"), F.lit(", T="), get("$.al.T"))
    names = F.from_json(get("$.data.dataset_name"), "array<string>")
    kind = (
        F.when(get("$.acquisition_model").isNull(), "full")
        .when(get("$.target_model").isNotNull(), F.when(F.coalesce(number != 1, threshold.isNotNull()), "plasm_thresh").otherwise("plasm"))
        .when(get("$.successor_model").isNotNull(), "asm")
        .otherwise("one")
    )
    return F.struct(
        F.when(learns, get("$.al.strategy")).otherwise("full").alias("strategy"),
        F.coalesce(F.array_join(names, " "), get("$.data.dataset_name")).alias("dataset"),
        acquisition.alias("acquisition"),
        successor.alias("successor"),
        target.alias("target"),
        F.when(~learns, "None").when(sampling.isNull() | sampling.isin("", "false"), "k=1.0, T=0").otherwise(drawn).alias("ups"),
        F.coalesce(get("$.al.share_confident_to_save"), kept, F.lit("0")).alias("deleted"),
        F.coalesce(get("$.framework.name"), get("$.framework")).alias("framework"),
        kind.alias("al_type"),
        get("$.seed").cast("int").alias("seed"),
    )


def pretty(name: Column, table: dict[str, str]) -> Column:
    """The first entry whose key the name begins with, put in its place; longer keys first."""
    out = F.when(F.lit(False), name)
    for k in sorted(table, key=len, reverse=True):
        out = out.when(name.startswith(k), F.concat(F.lit(table[k]), F.substring(name, F.lit(len(k) + 1), F.length(name))))
    return out.otherwise(name)


def rotated(files: DataFrame, limit: int, folder: str, name: str, modified: str | None = None) -> DataFrame:
    """Checkpoints to delete: all but the newest ``limit`` of each folder, by the number at the end of the name or by time."""
    age = F.col(modified) if modified else F.regexp_extract(name, r"(\d+)$", 1).cast("long")
    order = Window.partitionBy(folder).orderBy(age.desc(), F.col(name).desc())
    return files.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") > limit).drop("_rank")
