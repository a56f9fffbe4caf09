"""Data-health, readiness and module-validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators import health
from revlens.sources import ingest
from revlens.plans.distributed import materialized
from revlens.plans.registry import Modules, register


def _mods(spark, sf_dir):
    return Modules(spark, sf_dir).all()


@register("quality_profile")
def q_quality_profile(spark, sf_dir):
    return health.quality_profile(_mods(spark, sf_dir))


@register("module_health")
def q_module_health(spark, sf_dir):
    mh = health.module_health(_mods(spark, sf_dir))
    return mh.select("Module", "Rows", "Required_Columns", "Required_Status", "Status",
                     F.size("Warnings").alias("Warning_Count"),
                     F.array_join("Warnings", " | ").alias("Warnings"))


@register("join_coverage")
def q_join_coverage(spark, sf_dir):
    jh = health.join_health(spark, _mods(spark, sf_dir))
    return jh.select("Relationship", "Join_Key", "Rows_Checked", "Matched", "Unmatched", "Status", "Details")


@register("relationships")
def q_relationships(spark, sf_dir):
    return health.relationships(spark, _mods(spark, sf_dir)).drop("Relationship_Order")


@register("join_key_validation")
def q_join_key_validation(spark, sf_dir):
    m = _mods(spark, sf_dir)
    # the lookup side of Deals -> Accounts, checked on its own
    return health.relationships(spark, {"Deals": m["Deals"], "Accounts": m["Accounts"]}) \
        .where(F.col("Left_Module") == "Deals").where(F.col("Right_Module") == "Accounts") \
        .drop("Relationship_Order")


@register("capabilities")
def q_capabilities(spark, sf_dir):
    return health.capabilities(spark, _mods(spark, sf_dir)).drop("Capability_Order")


@register("warning_list")
def q_warning_list(spark, sf_dir):
    m = _mods(spark, sf_dir)
    return health.warning_list(health.module_health(m), health.join_health(spark, m))


@register("health_summary")
def q_health_summary(spark, sf_dir):
    m = _mods(spark, sf_dir)
    # a row per module and per relationship, written once: all parts of the report derive from them
    mh, jh = materialized(health.module_health(m)), materialized(health.join_health(spark, m))
    caps = health.capabilities(spark, m, rels=jh)
    return health.health_summary(mh, caps, health.warning_list(mh, jh))


@register("module_validation")
def q_module_validation(spark, sf_dir):
    return ingest.module_validation(_mods(spark, sf_dir))
