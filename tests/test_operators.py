"""Operators on small inputs with known results."""

import random

from pyspark.sql import functions as F

from quillspark.functions import laws
from quillspark.operators import analytics, rules, sequences


def test_freedraw_known_values_and_inverse(spark):
    rows = spark.range(11).select((F.col("id") / 10).alias("p")).select("p", laws.freedraw_factor(F.col("p")).alias("f")).select("p", "f", laws.freedraw_pressure(F.col("f")).alias("b")).collect()
    assert abs(rows[5].f - 6.0104) < 1e-3
    assert all(abs(r.p - r.b) < 1e-9 for r in rows)


def test_width_runs_follow_the_rule(spark):
    rng = random.Random(3)
    data = [(k, [round(rng.random() * 2, 3) for _ in range(rng.randint(1, 30))]) for k in range(40)]
    got = {r.k: r.starts for r in sequences.width_runs(spark.createDataFrame(data, "k int, w array<double>"), "w").collect()}
    for k, w in data:
        starts, first, n = [0], w[0], 1
        for i in range(1, len(w)):
            if abs(w[i] - first) > 0.35 and n > 1:
                starts.append(i)
                first, n = w[i], 1
            n += 1
        assert got[k] == starts


def test_delta_coding_round_trip(spark):
    pts = spark.range(50).select((F.col("id") % 3).alias("stroke"), F.col("id").alias("i"), (F.col("id") * 0.37).alias("v"))
    back = sequences.delta_decode(sequences.delta_encode(pts, F.col("v"), 0.01).withColumnRenamed("v", "was"), "d", 0.01)
    assert back.where(F.abs(F.col("v") - F.col("was")) > 0.005 + 1e-9).count() == 0


def test_folder_paths_end_on_cycles(spark):
    nodes = spark.createDataFrame([("a", "b", "A"), ("b", "a", "B"), ("c", "trash", "C"), ("d", "c", "D"), ("e", "gone", "E")], "id string, parent string, name string")
    got = {r.id: (r.path, r.trashed) for r in analytics.folder_paths(nodes, doublings=2).collect()}
    assert got["a"] == ("A/B/A/B/A", False)
    assert got["e"] == ("E", False) and got["d"] == ("C/D", True) and got["c"] == ("C", True)


def test_decision_order(spark):
    base = dict(kind="notebook", source_id="remarkable", note_blocked=False, note_allowed=False, folder_block=None, folder_allow=False, excluded=False)
    cases = [({"kind": "pdf", "note_allowed": True}, "unsupported-kind"), ({"note_blocked": True, "note_allowed": True}, "note-rule"), ({"folder_block": "x", "folder_allow": True}, "folder-rule:x"), ({"folder_block": "x", "note_allowed": True}, None), ({}, "scope-notebooks"), ({"kind": "file", "excluded": True}, "config-exclude"), ({"kind": "file"}, None)]
    schema = "n int, kind string, source_id string, note_blocked boolean, note_allowed boolean, folder_block string, folder_allow boolean, excluded boolean"
    df = spark.createDataFrame([{"n": k} | base | c for k, (c, _) in enumerate(cases)], schema)
    got = {r.n: r.reason for r in rules.decide(df, "blocklist", notebooks=False).collect()}
    assert [got[k] for k in range(len(cases))] == [r for _, r in cases]
    allow = {r.n: r.reason for r in rules.decide(df, "allowlist", notebooks=False).collect()}
    assert allow[2] is None and allow[6] == "allowlist"


def test_ranks_against_sorting(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *(k / 4 for k in range(40))]), k) for k in range(900)] + [("one", 3.0, 900)] + [("c", float(k), 1000 + k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    got = {r["g"]: r for r in analytics.quartiles_by_index(df, "g", "v").collect()}
    middle = {r["g"]: r["median"] for r in analytics.medians(df, "g", "v").collect()}
    for g in {r[0] for r in rows}:
        s = sorted(v for x, v, _ in rows if x == g and v is not None)
        n = len(s)
        assert (got[g]["n"], got[g]["q1"], got[g]["q3"]) == (n, s[n // 4], s[3 * n // 4])
        assert got[g]["median"] == middle[g] == (s[(n - 1) // 2] + s[n // 2]) / 2
    order = [r["id"] for r in analytics.numbered(df, "v", F.col("id")).orderBy("nth").collect()]
    assert order == [r[2] for r in sorted(rows, key=lambda r: (-r[1] if r[1] is not None else float("inf"), r[2]))]
    assert analytics.numbered(df.limit(0), "v", F.col("id")).count() == 0


def test_nearest_keeps_repeated_rows(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 0.0), (9.0, 9.0), (None, 1.0)], "x double, y double")
    got = sorted((r["target"], r["d2"]) for r in analytics.nearest(df, [("near", 0, 0), ("tie", 2, 0), ("far", 9, 9)], ["x", "y"]).where("x is not null").collect())
    assert got == [("far", 0.0), ("near", 1.0), ("near", 1.0)]


def test_entropy(spark):
    df = spark.createDataFrame([(1, "ab"), (1, "ab"), (2, "aaaa"), (3, ""), (4, None)], "k long, t string")
    assert {r["k"]: (r["entropy"], r["size"]) for r in analytics.text_entropy(df, "k", "t").collect()} == {1: (1.0, 4), 2: (0.0, 4)}
