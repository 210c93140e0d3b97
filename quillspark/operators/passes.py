"""One incremental pass on tables: what is wanted, what has to be rendered, and what follows for state and files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import ancestor_rules, decide, output_plan

STATE = "key string, mtime long, outputs array<string>, synced_at long, error string, failed_mtime long"
#: The source whose older state is known by document alone, and that state's kind of file.
OLD_SOURCE, OLD_KIND = "remarkable", ".pdf"


def doc_key() -> Column:
    return F.concat_ws(":", "source_id", "doc_id")


def find_doc(docs: DataFrame, key: str) -> DataFrame:
    """The document with a key: its source is what stands before the first colon."""
    source, _, ident = key.partition(":")
    return docs.where((F.col("source_id") == source) & (F.col("doc_id") == ident))


def union_sources(listings: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """Documents of all sources that can be listed, and the errors of the others; columns are met by name."""
    found, errors = None, {}
    for name, listing in listings.items():
        try:
            docs = listing().withColumn("source_id", F.lit(name))
            docs.schema  # a listing that cannot be planned fails here
        except Exception as e:  # one source must not stop the others; what went wrong is handed back
            errors[name] = f"{type(e).__name__}: {e}"
            continue
        found = docs if found is None else found.unionByName(docs, allowMissingColumns=True)
    return found, errors


def with_rules(docs: DataFrame, doc_rules: DataFrame) -> DataFrame:
    """Documents with their own rule by key; without one nothing is blocked, allowed or overridden."""
    own = doc_rules.select("key", F.col("blocked").alias("note_blocked"), F.col("allowed").alias("note_allowed"), F.col("name").alias("rule_name"), F.col("folder").alias("rule_folder"), F.col("format").alias("rule_format"))
    both = docs.withColumn("key", doc_key()).join(own, "key", "left")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("note_blocked", "note_allowed")} | {c: F.coalesce(c, F.lit("")) for c in ("rule_name", "rule_folder", "rule_format")})


def is_excluded(folder: Column, paths: list[str]) -> Column:
    """Whether a folder is one of ``paths`` or below one."""
    found = F.lit(False)
    for p in paths:
        found = found | (folder == p) | folder.startswith(p.rstrip("/") + "/")
    return found


def outputs_exist(state: DataFrame, files: DataFrame) -> DataFrame:
    """State with ``exist``: all outputs are among the files (path); no outputs are all there."""
    each = state.select("key", F.explode("outputs").alias("path")).distinct().join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    whole = each.groupBy("key").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("exist"))
    return state.join(whole, "key", "left").withColumn("exist", F.coalesce("exist", F.lit(True)))


def adopted(docs: DataFrame, state: DataFrame, old: DataFrame, files: DataFrame) -> DataFrame:
    """State with the entries that older state (doc_id, mtime) vouches for.

    A document without state is adopted if its time is the one recorded and
    its file of the older kind exists.
    """
    plain = F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(OLD_KIND))
    fresh = docs.where((F.col("source_id") == OLD_SOURCE) & F.col("wanted")).join(state.select("key"), "key", "left_anti").withColumn("path", plain)
    kept = fresh.join(old.select("doc_id", F.col("mtime").alias("was")), "doc_id").where("was = mtime").join(files.select("path").distinct(), "path", "left_semi")
    entry = kept.select("key", "mtime", F.array("path").alias("outputs"), F.lit(None).cast("long").alias("synced_at"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("long").alias("failed_mtime"))
    return state.unionByName(entry)


def planned(docs: DataFrame, doc_rules: DataFrame, folder_rules: DataFrame, state: DataFrame, files: DataFrame, old: DataFrame | None = None, mode: str = "blocklist", notebooks: bool = True, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(key, name, path, mtime, reason, action, outputs, error, failed_mtime, synced_at) of a pass.

    ``docs`` has source_id, doc_id, name, folder, mtime, kind.  Actions:
    ``skip`` if the recorded time is the document's, the expected path is among
    the outputs and all of them exist; else ``render``; ``exclude`` for what is
    not wanted and has no state, ``delete`` for state without a wanted document.
    """
    ruled = ancestor_rules(with_rules(docs, doc_rules), folder_rules)
    ruled = output_plan(decide(ruled.withColumn("excluded", is_excluded(F.col("folder"), list(excluded))), mode, notebooks))
    if old is not None:
        state = adopted(ruled, state, old, files)
    s = outputs_exist(state, files).withColumnRenamed("mtime", "was").withColumn("had", F.lit(True))
    both = ruled.select("key", "name", "path", "mtime", "reason", "wanted").join(s, "key", "full_outer")
    wanted = F.coalesce("wanted", F.lit(False))
    done = F.coalesce((F.col("was") == F.col("mtime")) & F.array_contains("outputs", F.col("path")) & F.col("exist"), F.lit(False))
    action = F.when(wanted & done, "skip").when(wanted, "render").when(F.col("had"), "delete").otherwise("exclude")
    return both.select("key", "name", "path", "mtime", "was", "reason", action.alias("action"), "outputs", "error", "failed_mtime", "synced_at")


def next_state(plan: DataFrame, results: DataFrame) -> DataFrame:
    """State after a pass; ``results`` has (key, outputs, error, at) of what was rendered.

    Success replaces an entry and clears its error; a failure keeps the old
    outputs and time and notes the error and the time it happened at; what was
    skipped stays; what is deleted or excluded has no entry.
    """
    r = results.select("key", F.col("outputs").alias("new"), F.col("error").alias("new_error"), "at", F.lit(True).alias("ran"))
    both = plan.where(F.col("action").isin("skip", "render")).join(r, "key", "left")
    ok = F.coalesce(F.col("ran") & F.col("new_error").isNull(), F.lit(False))
    failed = F.col("new_error").isNotNull()
    return both.where((F.col("action") == "skip") | F.col("ran") | F.col("was").isNotNull()).select(
        "key",
        F.when(ok, F.col("mtime")).otherwise(F.col("was")).alias("mtime"),
        F.when(ok, F.col("new")).otherwise(F.coalesce("outputs", F.array().cast("array<string>"))).alias("outputs"),
        F.when(ok, F.col("at")).otherwise(F.col("synced_at")).alias("synced_at"),
        F.when(failed, F.col("new_error")).when(~ok, F.col("error")).alias("error"),
        F.when(failed, F.col("mtime")).when(~ok, F.col("failed_mtime")).alias("failed_mtime"),
    )


def removals(plan: DataFrame, results: DataFrame, files: DataFrame, cleanup: bool = False) -> DataFrame:
    """(path, why) of the files to remove: outputs of what is gone, outputs that a new rendering no longer has, and,
    with ``cleanup``, files of the older kind that nothing refers to.  Only files that exist are told, each once.
    """
    gone = plan.where("action = 'delete'").select(F.explode("outputs").alias("path"), F.lit("gone").alias("why"))
    fresh = results.where("error is null").select("key", F.col("outputs").alias("new"))
    stale = plan.where("action = 'render'").join(fresh, "key").select(F.explode(F.array_except("outputs", "new")).alias("path"), F.lit("stale").alias("why"))
    every = gone.unionByName(stale)
    if cleanup:
        live = next_state(plan, results).select(F.explode("outputs").alias("path")).distinct()
        left = files.where(F.lower("path").endswith(OLD_KIND)).select("path").distinct().join(live, "path", "left_anti")
        every = every.unionByName(left.select("path", F.lit("unreferenced").alias("why")))
    return every.join(files.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.min("why").alias("why"))


def summary(plan: DataFrame, results: DataFrame, removed: DataFrame) -> DataFrame:
    """One row: documents, rendered, skipped, failed, removed."""
    counts = plan.join(results.select("key", F.col("error").alias("failure"), F.lit(True).alias("ran")), "key", "left").agg(
        F.count_if(F.col("action").isin("skip", "render")).alias("documents"),
        F.count_if(F.col("ran") & F.col("failure").isNull()).alias("rendered"),
        F.count_if(F.col("action") == "skip").alias("skipped"),
        F.count_if(F.col("failure").isNotNull()).alias("failed"),
    )
    return counts.join(removed.where("why <> 'stale'").agg(F.count(F.lit(1)).alias("removed")))


def state_of(raw: Column) -> Column:
    """The entries of a state file's JSON text (version 2), or null: null for older state and for broken text."""
    entry = "struct<mtime:long,outputs:array<string>,synced_at:long,error:string,failed_mtime:long>"
    parsed = F.from_json(raw, f"version int, docs map<string,{entry}>")
    return F.when(parsed["version"] == 2, F.coalesce(parsed["docs"], F.create_map().cast(f"map<string,{entry}>")))


def old_state_of(raw: Column) -> Column:
    """The times by document of an older state file's JSON text; null if it is of version 2 or broken."""
    return F.when(F.coalesce(F.from_json(raw, "version int")["version"], F.lit(0)) != 2, F.from_json(raw, "map<string,long>"))


def relevant_events(events: DataFrame, state_name: str) -> DataFrame:
    """Change events (path, is_directory) that start a pass: not of folders, nor of the state file itself."""
    return events.where(~F.col("is_directory") & ~F.col("path").contains(state_name))
