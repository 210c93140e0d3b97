"""An incremental pass against the same pass told step by step."""

import json
import random

from pyspark.sql import functions as F

from quillspark.operators import passes

DOCS = "source_id string, doc_id string, name string, folder string, mtime long, kind string"
RULES = "key string, blocked boolean, allowed boolean, name string, folder string, format string"
FOLDERS = "folder string, blocked boolean, allowed boolean"
RESULTS = "key string, outputs array<string>, error string, at long"


def told(docs, doc_rules, folder_rules, state, files, old, fails):
    """The pass one document at a time."""
    rules = {r[0]: r for r in doc_rules}
    state = {k: dict(v) for k, v in state.items()}
    actions, live, live_outputs, results = {}, set(), set(), {}
    for source, ident, name, folder, mtime, kind in docs:
        key = f"{source}:{ident}"
        _, blocked, allowed, new_name, new_folder, fmt = rules.get(key, (key, False, False, None, None, None))
        above = [f for f in folder_rules if f[0] == "" or folder == f[0] or folder.startswith(f[0] + "/")]
        block, allow = any(f[1] for f in above), any(f[2] for f in above)
        wanted = kind not in ("pdf", "epub") and not blocked and not (block and not allowed)
        if wanted and not (allowed or allow):
            wanted = not (source == "remarkable" and (folder == "x" or folder.startswith("x/")))
        stem = f"{new_folder or folder}/{new_name or name}".lstrip("/")
        path = f"{stem}.{fmt or 'pdf'}"
        if not wanted:
            actions.setdefault(key, "exclude")
            continue
        live.add(key)
        entry = state.get(key)
        if entry is None and source == "remarkable" and old.get(ident) == mtime and f"{stem}.pdf" in files:
            entry = state[key] = {"mtime": mtime, "outputs": [f"{stem}.pdf"], "error": None, "failed": None}
        if entry and entry["mtime"] == mtime and path in entry["outputs"] and all(o in files for o in entry["outputs"]):
            actions[key] = "skip"
            live_outputs.update(entry["outputs"])
            continue
        actions[key] = "render"
        if key in fails:
            results[key] = (key, None, "broke", 9)
            state[key] = {"mtime": None, "outputs": [], **(entry or {}), "error": "broke", "failed": mtime}
            live_outputs.update(state[key]["outputs"])
        else:
            results[key] = (key, [path], None, 9)
            for o in (entry or {"outputs": []})["outputs"]:
                if o != path:
                    files = files - {o}
            state[key] = {"mtime": mtime, "outputs": [path], "error": None, "failed": None}
            live_outputs.add(path)
    for key in [k for k in state if k not in live]:
        actions[key] = "delete"
        files = files - set(state.pop(key)["outputs"])
    files = {f for f in files if not f.endswith(".pdf") or f in live_outputs}
    return actions, state, files, results


def test_pass_as_told(spark):
    rng = random.Random(4)
    folders = ["", "x", "x/y", "z", "z/y", "xx"]
    docs = [(rng.choice(["remarkable", "folder-1"]), f"d:{k}", f"n{k}", rng.choice(folders), rng.randrange(3), rng.choice(["notebook", "file", "pdf"])) for k in range(120)]
    keys = [f"{d[0]}:{d[1]}" for d in docs]
    doc_rules = [(k, rng.random() < 0.2, rng.random() < 0.3, rng.choice([None, "other"]) and f"other{i}", rng.choice([None, "moved"]), rng.choice([None, "svg"])) for i, k in enumerate(keys) if rng.random() < 0.4]
    folder_rules = [("z", True, False), ("x/y", False, True)]
    state, files = {}, {f"stray{k}.pdf" for k in range(3)} | {"keep.txt"}
    for k, d in list(zip(keys, docs)) + [(f"gone:{k}", None) for k in range(5)]:
        stem = f"{d[3]}/{d[2]}".lstrip("/") if d else k
        if rng.random() < 0.6:
            state[k] = {"mtime": rng.choice([d[4] if d else 0, 7]), "outputs": [f"{stem}.pdf"] + ([f"{stem}-2.svg"] if rng.random() < 0.3 else []), "error": rng.choice([None, "was"]), "failed": None}
            files |= {o for o in state[k]["outputs"] if rng.random() < 0.8}
        elif rng.random() < 0.7:
            files.add(f"{stem}.pdf")
    old = {d[1]: rng.choice([d[4], 5]) for d in docs if rng.random() < 0.5}
    fails = {k for k in keys if rng.random() < 0.3}
    actions, after, left, results = told(docs, doc_rules, folder_rules, state, files, old, fails)

    listing = spark.createDataFrame([(f,) for f in files], "path string")
    before = spark.createDataFrame([(k, s["mtime"], s["outputs"], 1, s["error"], s["failed"]) for k, s in state.items()], passes.STATE)
    plan = passes.planned(spark.createDataFrame(docs, DOCS), spark.createDataFrame(doc_rules, RULES), spark.createDataFrame(folder_rules, FOLDERS), before, listing, spark.createDataFrame([*old.items()], "doc_id string, mtime long"), excluded=("x",)).cache()
    assert {r["key"]: r["action"] for r in plan.collect()} == actions
    done = spark.createDataFrame([*results.values()], RESULTS)
    got = {r["key"]: (r["mtime"], r["outputs"], r["error"], r["failed_mtime"]) for r in passes.next_state(plan, done).collect()}
    assert got == {k: (s["mtime"], s["outputs"], s["error"], s["failed"]) for k, s in after.items()}
    removed = passes.removals(plan, done, listing, cleanup=True)
    assert files - {r["path"] for r in removed.collect()} == left
    line = passes.summary(plan, done, removed).first()
    n = list(actions.values())
    assert (line["documents"], line["skipped"], line["failed"], line["rendered"]) == (n.count("skip") + n.count("render"), n.count("skip"), sum(r[2] is not None for r in results.values()), sum(r[2] is None for r in results.values()))
    empty = passes.planned(spark.createDataFrame([], DOCS), spark.createDataFrame([], RULES), spark.createDataFrame([], FOLDERS), before.limit(0), listing)
    assert empty.count() == 0


def test_sources_states_and_events(spark):
    docs = spark.createDataFrame([("a:b", "n")], "doc_id string, name string")

    def broken():
        raise OSError("gone")

    every, errors = passes.union_sources({"one": lambda: docs, "two": broken, "three": lambda: docs.withColumn("kind", F.lit("pdf"))})
    assert sorted(r["source_id"] for r in every.collect()) == ["one", "three"] and errors == {"two": "OSError: gone"}
    assert passes.find_doc(every, "three:a:b").count() == 1 and passes.find_doc(every, "three").count() == 0
    texts = [json.dumps({"version": 2, "docs": {"k": {"mtime": 3, "outputs": ["a.pdf"]}}}), '{"u1": 5}', "{broken", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(passes.state_of(F.col("t")).alias("s"), passes.old_state_of(F.col("t")).alias("o")).collect()
    assert rows[0]["s"]["k"]["mtime"] == 3 and rows[0]["o"] is None and rows[1]["s"] is None and rows[1]["o"] == {"u1": 5} and rows[2]["s"] is None and rows[3]["s"] is None
    events = spark.createDataFrame([("/a", True), ("/b.note", False), ("/x/.state.json", False)], "path string, is_directory boolean")
    assert [r["path"] for r in passes.relevant_events(events, ".state.json").collect()] == ["/b.note"]
