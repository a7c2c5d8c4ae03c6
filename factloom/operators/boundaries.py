"""Layers' borders and the references that cross them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def layer_label(layer: Column) -> Column:
    """What the lowest layers are called."""
    return (
        F.when(layer == 0, "Foundation: zero external dependencies, migrate first")
        .when(layer == 1, "Core logic: depends on foundation only")
        .when(layer == 2, "Feature modules: core + cross-cutting")
        .otherwise("Higher-level composition")
    )


def layer_groups(modules: DataFrame) -> DataFrame:
    """modules(module, layer, public_symbols) -> layer, label, n_modules, public_symbols."""
    return modules.groupBy("layer").agg(F.count("*").alias("n_modules"), F.sum("public_symbols").alias("public_symbols")).withColumn("label", layer_label(F.col("layer")))


def external_usage(exports: DataFrame, refs: DataFrame) -> DataFrame:
    """exports(module, symbol) with is_public: whether another file uses it. refs(module, symbol, file): file uses that module's symbol."""
    used = refs.filter("file <> module").select("module", "symbol").distinct().withColumn("is_public", F.lit(True))
    return exports.join(used, ["module", "symbol"], "left").select("module", "symbol", F.coalesce("is_public", F.lit(False)).alias("is_public"))


def uncut(refs: DataFrame, layers: DataFrame) -> DataFrame:
    """refs(consumer, provider, symbol, kind) from a higher layer to a lower, once each, of the smallest kind; no layer counts as 0."""
    of = lambda x: layers.select(F.col("id").alias(x), F.col("layer").alias(f"{x}_layer")).hint("shuffle_hash")
    # consumers last: rows then lie by consumer, as the groups need them, and the one sort is that of the groups
    out = refs.join(of("provider"), "provider", "left").join(of("consumer"), "consumer", "left").fillna(0, ["consumer_layer", "provider_layer"])
    out = out.filter("consumer_layer > provider_layer")
    # the smallest text needs sorted groups: by a number first, as that is quick to compare
    out = out.groupBy(F.xxhash64("consumer", "provider", "symbol").alias("_order"), "consumer", "provider", "symbol", "consumer_layer", "provider_layer").agg(F.min("kind").alias("kind"))
    return out.drop("_order").withColumn("direction", F.concat(F.lit("L"), "consumer_layer", F.lit("->L"), "provider_layer"))
