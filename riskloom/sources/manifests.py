"""Which framework a project uses, from its manifest and marker files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.rules.packs import FRAMEWORK_PACKAGES


def detect_frameworks(files: DataFrame) -> DataFrame:
    """``(project, name, version)`` for projects with a known framework.

    Paths are relative to the project.  Only files at its root count, except
    that any file below ``wp-content`` marks WordPress.
    """
    local = F.col("path")
    is_wp = (local == "wp-config.php") | F.startswith(local, F.lit("wp-content/"))
    is_manifest = local == "composer.json"
    require = F.from_json("content", "require MAP<STRING, STRING>")["require"]

    def priority(package):
        rank = F.lit(len(FRAMEWORK_PACKAGES))
        for n in reversed(range(len(FRAMEWORK_PACKAGES))):
            rank = F.when(
                F.contains(package, F.lit(FRAMEWORK_PACKAGES[n][1])), F.lit(n)
            ).otherwise(rank)
        return rank

    # First rule in the list that any required package meets.
    choices = F.array_min(
        F.filter(
            F.transform(
                F.map_entries(require),
                lambda e: F.struct(
                    priority(e["key"]).alias("rank"), e["value"].alias("version"),
                ),
            ),
            lambda c: c["rank"] < len(FRAMEWORK_PACKAGES),
        )
    )
    names = F.array(*[F.lit(name) for name, _ in FRAMEWORK_PACKAGES])
    per_project = (
        files.where(is_wp | is_manifest)
        .groupBy("project")
        .agg(
            F.bool_or(is_wp).alias("wp"),
            F.min(F.when(is_manifest, choices)).alias("choice"),
        )
    )
    return per_project.where(F.col("wp") | F.col("choice").isNotNull()).select(
        "project",
        F.when(F.col("wp"), F.lit("wordpress"))
        .otherwise(F.element_at(names, F.col("choice.rank") + 1)).alias("name"),
        F.when(F.col("wp"), F.lit("")).otherwise(F.col("choice.version")).alias("version"),
    )


def rules_for_projects(rules: DataFrame, projects: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Rules that apply to each project: common ones and those of its framework.

    One row per project and rule; the rule table is the small side.
    """
    known = projects.select("project").distinct().join(
        frameworks.select("project", F.col("name").alias("framework")), "project", "left"
    )
    packs = known.select(
        "project", F.explode(F.array(F.lit(""), F.coalesce("framework", F.lit("generic")))).alias("pack")
    )
    keyed = rules.withColumn("pack", F.coalesce("pack", F.lit("")))
    return packs.join(keyed, "pack")
