"""Rules of inclusion: keyed and prefix joins, the decision table, plans of output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(folder: Column) -> Column:
    """Every prefix of a path, the root '' first."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def ancestor_rules(docs: DataFrame, folder_rules: DataFrame) -> DataFrame:
    """Add ``folder_block`` (root-most blocked ancestor) and ``folder_allow`` by an equi-join on the exploded prefixes."""
    steps = docs.select("key", F.posexplode(ancestors(F.col("folder"))).alias("depth", "path"))
    met = steps.join(folder_rules.withColumnRenamed("folder", "path"), "path").groupBy("key").agg(
        F.min_by("path", F.when(F.col("blocked"), F.col("depth"))).alias("folder_block"), F.bool_or("allowed").alias("folder_allow")
    )
    return docs.join(met, "key", "left").withColumn("folder_allow", F.coalesce("folder_allow", F.lit(False)))


def decide(docs: DataFrame, mode: str, notebooks: bool) -> DataFrame:
    """Add ``wanted`` and ``reason``; the first case that holds decides.

    ``docs`` has kind, source_id, note_blocked, note_allowed, folder_block,
    folder_allow and excluded (in or under an excluded folder).
    """
    explicit = F.col("note_allowed") | F.col("folder_allow")
    allow = F.lit(mode == "allowlist")
    case = (
        F.when(F.col("kind").isin("pdf", "epub"), "unsupported-kind")
        .when(F.col("note_blocked"), "note-rule")
        .when(allow & explicit, F.lit(""))
        .when(allow, "allowlist")
        .when(F.col("folder_block").isNotNull() & ~F.col("note_allowed"), F.concat(F.lit("folder-rule:"), F.col("folder_block")))
        .when(~explicit & (F.col("kind") == "notebook") & F.lit(not notebooks), "scope-notebooks")
        .when(~explicit & (F.col("source_id") == "remarkable") & F.col("excluded"), "config-exclude")
        .otherwise("")
    )
    return docs.withColumn("reason", F.nullif(case, F.lit(""))).withColumn("wanted", F.col("reason").isNull())


def output_plan(docs: DataFrame) -> DataFrame:
    """Add ``path`` from overrides (rule_folder, rule_name, rule_format); names and folders are made safe."""
    clean = lambda c, bad: F.coalesce(F.nullif(F.trim(F.translate(c, bad, "-" * len(bad))), F.lit("")), F.lit("_"))
    folder = F.coalesce(F.nullif("rule_folder", F.lit("")), "folder")
    folder = F.array_join(F.transform(F.filter(F.split(folder, "/"), lambda p: p != ""), lambda p: clean(p, "\\:")), "/")
    name = clean(F.coalesce(F.nullif("rule_name", F.lit("")), "name"), "/\\")
    kind = F.coalesce(F.nullif("rule_format", F.lit("")), F.lit("pdf"))
    return docs.withColumn("path", F.concat(F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(""), name, F.lit("."), kind))


def sync_actions(docs: DataFrame, state: DataFrame) -> DataFrame:
    """(key, action): render, skip, exclude or delete, from wanted documents and the last state.

    A document is skipped if its time is equal, the expected path is among its
    outputs and all of them exist; state without a wanted document is deleted.
    """
    s = state.select("key", F.col("mtime").alias("was"), "outputs", "exist", F.lit(True).alias("had"))
    done = (F.col("was") == F.col("mtime")) & F.array_contains("outputs", F.col("path")) & F.col("exist")
    both = docs.join(s, "key", "full_outer")
    action = (
        F.when(F.coalesce("wanted", F.lit(False)), F.when(F.coalesce(done, F.lit(False)), "skip").otherwise("render"))
        .when(F.col("had"), "delete")
        .otherwise("exclude")
    )
    return both.select("key", action.alias("action"))


def snapshot(docs: DataFrame, state: DataFrame) -> DataFrame:
    """Add ``state``: excluded, synced, failed or pending; a failure counts only for the time it happened at."""
    s = state.select("key", F.col("mtime").alias("was"), "outputs", "exist", "failed_mtime")
    done = (F.col("was") == F.col("mtime")) & F.array_contains("outputs", F.col("path")) & F.col("exist")
    case = F.when(~F.col("wanted"), "excluded").when(done, "synced").when(F.col("failed_mtime") == F.col("mtime"), "failed").otherwise("pending")
    return docs.join(s, "key", "left").withColumn("state", case)
