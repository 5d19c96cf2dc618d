"""Sinks and small stored tables: predictions, feature parameters, model registry, forests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_predictions(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite",
) -> None:
    """Predictions, signals, equity curves (parquet or CSV) or metric trees (JSON)."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def pack_feature_params(params: DataFrame, periods: Sequence[int] = (5, 21, 63, 126), lookback: int = 21) -> DataFrame:
    """(feature, mean, std) rows -> the one-row table of fitted parameters."""
    entries = F.sort_array(F.collect_list(F.struct("feature", "mean", "std")))
    return params.agg(entries.alias("features")).withColumns(
        {"momentum_periods": F.array(*[F.lit(p) for p in periods]), "illiq_lookback": F.lit(lookback)})


def unpack_feature_params(packed: DataFrame) -> DataFrame:
    return packed.select(F.inline("features"))


def save_feature_params(packed: DataFrame, path: str) -> None:
    packed.write.mode("overwrite").json(path)


PARAMS_SCHEMA = "features array<struct<feature string, mean double, std double>>, momentum_periods array<int>, illiq_lookback int"


def load_feature_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARAMS_SCHEMA).json(path)


def model_registry(models: DataFrame, metrics: DataFrame, spans: DataFrame, *, by: str = "fold") -> DataFrame:
    """One row per walk-forward window: coefficients, metrics and date spans."""
    return models.join(metrics, by, "left").join(spans, by, "left")


def production_model(registry: DataFrame, *, by: str = "fold") -> DataFrame:
    """The last window's row."""
    last = registry.agg(F.max_by(F.struct(*registry.columns), by).alias("m"))
    return last.select("m.*")


# Accepted names of each node field, in order of preference.
NODE_KEYS = {
    "node_id": ("id", "node_id", "nodeid"),
    "feature_idx": ("feature_idx", "feature", "split_feature", "split_index", "split", "column"),
    "split_value": ("split_value", "threshold", "split_condition", "value", "split_val"),
    "left": ("left_child", "left", "yes", "lchild"),
    "right": ("right_child", "right", "no", "rchild"),
    "leaf_value": ("leaf_value", "value", "leaf", "prediction", "predict"),
    "num_samples": ("num_samples",),
    "gain": ("gain",),
    "default_left": ("default_left", "missing_go_left", "missing", "missing_to_left"),
}


def forest_table(docs: DataFrame, col: str = "json", *, by: Sequence[str] = ()) -> DataFrame:
    """Forest JSON documents -> one row per node.

    A tree is an array of nodes or an object holding one under nodes, tree or children; node
    fields may carry any of the accepted names.
    """
    trees = F.from_json(F.coalesce(F.get_json_object(col, "$.trees"), F.col(col)), "array<string>")
    exploded = docs.select(*by, F.posexplode(trees).alias("tree_id", "_t"))
    held = [F.get_json_object("_t", f"$.{k}") for k in ("nodes", "tree", "children")]
    nodes = exploded.select(*by, "tree_id", F.posexplode(F.from_json(F.coalesce(*held, F.col("_t")), "array<map<string,string>>")).alias("_i", "_n"))
    pick = lambda f: F.coalesce(*[F.col("_n").getItem(k) for k in NODE_KEYS[f]])
    number = lambda f: pick(f).try_cast("double")
    missing = pick("default_left")
    default_left = F.when(missing.isNull(), True).when(
        missing.isin("true", "false"), missing == "true").otherwise(F.coalesce(missing.try_cast("double") < 0, F.lit(True)))
    return nodes.select(
        *by, "tree_id", F.coalesce(number("node_id"), F.col("_i")).cast("int").alias("node_id"),
        F.coalesce(F.ltrim(pick("feature_idx"), F.lit("f")).try_cast("int"), F.lit(-1)).alias("feature_idx"),
        F.coalesce(number("split_value"), F.lit(0.0)).alias("split_value"),
        F.coalesce(number("left"), F.lit(-1)).cast("int").alias("left"), F.coalesce(number("right"), F.lit(-1)).cast("int").alias("right"),
        F.coalesce(number("leaf_value"), F.lit(0.0)).alias("leaf_value"), number("num_samples").cast("bigint").alias("num_samples"),
        number("gain").alias("gain"), default_left.alias("default_left"))


def forest_json(forest: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Node rows -> one forest document per key."""
    fields = [c for c in forest.columns if c not in (*by, "tree_id")]
    ids = {"node_id": "id", "left": "left_child", "right": "right_child"}
    node = F.struct(*[F.col(c).alias(ids.get(c, c)) for c in fields])
    trees = forest.groupBy(*by, "tree_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("node_id", node.alias("n")))), lambda x: x["n"]).alias("t"))
    docs = trees.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("tree_id", "t"))), lambda x: x["t"]).alias("trees"))
    return docs.select(*by, F.to_json(F.struct("trees")).alias("json"))
