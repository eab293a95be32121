"""Assembly of training tables: union of batches, balance, permutation, split, encodings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from randaudit.operators.ranking import hash_key, hash_ranked

#: Node types that have a place in the one-hot part; width of a padded path; features of a path.
NODE_TYPES, PATH_WIDTH, PATH_FEATURES = 10, 20, 6


def union_batches(batches: dict[str, DataFrame]) -> DataFrame:
    """All entries with the name of their batch (M1)."""
    return reduce(DataFrame.unionByName, [df.withColumn("batch", F.lit(name)) for name, df in batches.items()])


def valid_entries(entries: DataFrame, graphs: DataFrame, paths: DataFrame) -> DataFrame:
    """Entries with both artefacts, which are tables of (batch, contract_id) (M2)."""
    on = ["batch", "contract_id"]
    return entries.join(graphs, on, "left_semi").join(paths, on, "left_semi")


def missing_entries(entries: DataFrame, graphs: DataFrame, paths: DataFrame, shown: int = 5) -> DataFrame:
    """batch, missing, examples (the first ids, in order) of entries without both artefacts (M2)."""
    on = ["batch", "contract_id"]
    lost = entries.join(graphs.join(paths, on, "left_semi"), on, "left_anti")
    first = lost.withColumn("k", F.row_number().over(Window.partitionBy("batch").orderBy("contract_id"))).where(F.col("k") <= shown)
    examples = first.groupBy("batch").agg(F.sort_array(F.collect_list("contract_id")).alias("examples"))
    return lost.groupBy("batch").agg(F.count(F.lit(1)).alias("missing")).join(examples, "batch")


def batch_label_counts(entries: DataFrame, valid: Column) -> DataFrame:
    """batch (null for the total), safe, vulnerable, missing, by rollup; `valid` tells entries with both artefacts (M3)."""
    return entries.rollup("batch").agg(
        F.count_if(valid & (F.col("label") == 0)).alias("safe"),
        F.count_if(valid & (F.col("label") == 1)).alias("vulnerable"),
        F.count_if(~valid).alias("missing"),
    )


def balance(entries: DataFrame, seed: int = 42) -> DataFrame:
    """Safe entries sampled down to the number of vulnerable ones, by a seeded hash; vulnerable entries all stay (M4).

    Raises where a class is empty.
    """
    counts = entries.agg(F.count_if(F.col("label") == 0).alias("safe"), F.count_if(F.col("label") == 1).alias("vulnerable")).first()
    if not counts.safe or not counts.vulnerable:
        raise ValueError(f"both classes are needed: {counts.safe} safe, {counts.vulnerable} vulnerable")
    ranked = hash_ranked(entries.withColumn("_key", hash_key(seed, "contract_id")), "_key", ["contract_id"], ["label"])
    kept = ranked.where((F.col("label") != 0) | (F.col("rank") <= min(counts.safe, counts.vulnerable)))
    return kept.drop("_key", "rank", "total")


def shuffle(entries: DataFrame, seed: int = 42) -> DataFrame:
    """entries with place, from 0: a seeded permutation (M5)."""
    ranked = hash_ranked(entries.withColumn("_key", hash_key(seed, "contract_id")), "_key", ["contract_id"])
    return ranked.withColumn("place", F.col("rank") - 1).drop("_key", "rank", "total")


def split(entries: DataFrame, train: float = 0.7, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """entries with split: train and validation of int(share * n) rows, the rest is test (M6)."""
    ranked = hash_ranked(entries.withColumn("_key", hash_key(seed, "contract_id")), "_key", ["contract_id"])
    n_train, n_val = F.floor(F.col("total") * train), F.floor(F.col("total") * validation)
    name = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "validation").otherwise("test")
    return ranked.withColumn("split", name).drop("_key", "rank", "total")


def one_hot(features: Column, node_type: Column, n: int = NODE_TYPES) -> Column:
    """The features with the one-hot node type after them; a type out of range is all zeros (M7)."""
    return F.concat(features, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce((i == node_type).cast("int"), F.lit(0)).cast("float")))


def pad_truncate(sequence: Column, length: Column, width: int = PATH_WIDTH) -> tuple[Column, Column]:
    """(sequence cut or padded with zeros on the right to width, length) (M8)."""
    return F.slice(F.concat(sequence, F.array_repeat(F.lit(0).cast("int"), width)), 1, width), F.least(length, F.lit(width))


def with_default_paths(index: DataFrame, paths: DataFrame, width: int = PATH_WIDTH, n_features: int = PATH_FEATURES) -> DataFrame:
    """index (contract_id, num_paths) joined with its paths; a contract without any has one row of zeros (M9)."""
    joined = index.join(paths, "contract_id", "left")
    return joined.select(
        "contract_id",
        "num_paths",
        (F.col("num_paths") > 0).alias("has_paths"),
        F.coalesce("path_idx", F.lit(0)).alias("path_idx"),
        F.coalesce("sequence", F.array_repeat(F.lit(0), width)).alias("sequence"),
        F.coalesce("length", F.lit(0)).alias("length"),
        F.coalesce("features", F.array_repeat(F.lit(0.0), n_features)).alias("features"),
    )


def class_weights(entries: DataFrame) -> DataFrame:
    """label, n, percent, weight = total / (2 n)."""
    counts = entries.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    joined = counts.crossJoin(F.broadcast(total))  # one row
    return joined.select("label", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"), (F.col("total") / (F.col("n") * 2.0)).alias("weight"))


def path_risk_label(paths: DataFrame) -> DataFrame:
    """contract_id, risk_label (0, 1, 2) from the means of length, dangerous operations and external calls."""
    means = paths.groupBy("contract_id").agg(*[F.avg(F.col("features")[i]).alias(f"f{i}") for i in range(3)])
    high = (F.col("f1") > 0.7) | (F.col("f2") > 0.8) | (F.col("f0") > 0.9)
    middle = (F.col("f1") > 0.4) | (F.col("f2") > 0.5) | (F.col("f0") > 0.6)
    return means.select("contract_id", F.when(high, 2).when(middle, 1).otherwise(0).alias("risk_label"))
