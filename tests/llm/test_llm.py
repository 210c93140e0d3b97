"""Operators of the llm subpackage against brute force on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, exact_dedup, graph, langid, lm, mixing, ngram_join, packing, pii, quality, registry, store, toxicity
from quillspark.llm.graph import components
from quillspark.llm.store import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string"


@pytest.fixture(scope="module")
def odd(spark):
    words = [f"w{k}" for k in range(300)]
    near = list(words)
    near[150] = "other"
    texts = [None, "", " \t\n", "a", "A", "É", "é", "same text", "SAME text", "same text", " ".join(words), " ".join(near), "long " * 30000, "x" * 50000, "word\n" * 60, " \x1c\x1f z", "<|endoftext|> [INST] \\ <|turn|>"]
    rows = [(k, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else f"s{k % 2}", k, "clash", "clash") for k, t in enumerate(texts)]
    rows += [rows[9], (None, "same text", None, None, None, None, None), (None, "null id", "fr", "s9", 1, "c", "c")]
    return spark.createDataFrame(rows, SCHEMA), rows


def documents(spark):
    rows = table(spark, SF, "documents").collect()
    return rows


def test_exact_dedup(spark, odd):
    df, rows = odd
    for digest in (exact_dedup._digest, lambda b: f"{len(b) % 3}"):  # the second collides
        got = exact_dedup.exact_duplicates(df, digest=digest).collect()
        groups = defaultdict(list)
        for r in rows:
            groups[(r[1] or "").translate(LOW)].append(r[0])
        assert len(got) == len(rows)
        sizes = Counter((r.doc_id, r.keep_id, r.group_size) for r in got)
        assert sizes == Counter((i, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)
        assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


def test_quality_base(spark, odd):
    df, rows = odd
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    for r in rows:
        t = r[1] or ""
        words = WORD.findall(t)
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            dup += line in seen and bool(WORD.search(line))
            seen.add(line)
        if r[0] is not None:
            g = got[r[0]]
            assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(inside))
            assert not (g.base_failed and g.kept)
    assert quality.keep_good(df).columns == df.columns


def brute_quality(text):
    """Verdict and shares of the repetition rules by plain counting."""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    grams = lambda w: [tuple(words[i : i + w]) for i in range(len(words) - w + 1)]

    def covered(w, chosen):
        at = {i + k for i, g in enumerate(grams(w)) if g in chosen for k in range(w)}
        return sum(len(words[i]) for i in at)

    dup, top, failed = 0.0, 0.0, sum(text.count(c) for c in "#*$%&|<>") > quality.SYMBOL_RATIO * len(words)
    for w in {*quality.DUP_NGRAM_SHARE, *quality.TOP_NGRAM_SHARE}:
        count = Counter(grams(w))
        most = max(count.values(), default=0)
        if most < 2:
            continue
        if w in quality.TOP_NGRAM_SHARE:
            share = max(covered(w, {g}) for g, n in count.items() if n == most) / chars
            top, failed = max(top, share), failed or share > quality.TOP_NGRAM_SHARE[w]
        if w in quality.DUP_NGRAM_SHARE:
            share = covered(w, {g for g, n in count.items() if n > 1}) / chars
            dup, failed = max(dup, share), failed or share > quality.DUP_NGRAM_SHARE[w]
    seen, repeated = set(), 0
    for line in text.split("\n"):
        repeated += sum(map(len, WORD.findall(line))) if line in seen else 0
        seen.add(line)
    line_share = repeated / chars if chars else 0.0
    threes = Counter(grams(3))
    inside = {i + k for i, g in enumerate(grams(3)) if threes[g] > 1 for k in range(3)}
    base = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return dup, top, line_share, not (base or failed or line_share > quality.DUP_LINE_SHARE)


def test_quality_verdict_against_brute_force():
    rng = np.random.default_rng(17)
    memo, kept = quality.WordHashes(), Counter()
    for _ in range(250):
        words = [f"{'é' * int(rng.integers(1, 4))}{k}" for k in rng.integers(0, int(rng.choice([6, 300, 5000, 5000])), rng.integers(20, 260))]
        for _ in range(int(rng.integers(0, 3))):
            if len(words) > 20:
                a = int(rng.integers(0, len(words) - 15))
                words += words[a : a + int(rng.integers(2, 60))]
        text = "".join(w + str(rng.choice([" ", "\n", " # ", "  "], p=[0.8, 0.1, 0.04, 0.06])) for w in words)
        got = dict(zip([n for n, _ in quality._OUT], quality.measure(text.encode(), memo)))
        dup, top, line, verdict = brute_quality(text)
        assert np.allclose([got["dup_ngram_share"], got["top_ngram_share"], got["dup_line_share"]], [dup, top, line]) and got["kept"] == verdict
        kept[verdict] += 1
    assert min(kept[True], kept[False]) > 10


def test_odd_names_and_empty_tables(spark, odd):
    """Columns that look like those the operators add, names with dots, and no rows at all."""
    df, rows = odd
    clash = df.select("*", *[F.lit(c).alias(c) for c in ("__dd_digest", "__dd_kept", "__qr_kept", "__nj_gone", "__id", "__text", "rid", "size", "held_out", "rank")]).withColumnRenamed("kept", "a.b")
    assert quality.keep_good(clash).columns == exact_dedup.drop_duplicates(clash).columns == ngram_join.keep_one_per_component(clash).columns == mixing.mixed_documents(clash).columns == clash.columns
    assert exact_dedup.drop_duplicates(clash).count() == exact_dedup.drop_duplicates(df).count()
    dotted = df.select(F.col("doc_id").alias("the.id"), F.col("text").alias("the.text"), F.col("source").alias("the.source"), F.col("lang").alias("the.lang"))
    where = {"text": "the.text", "id_col": "the.id"}
    no = spark.createDataFrame([], "doc_id long, toxic int")
    each = {
        "op2": lambda d: mixing.mix_sources(d, source_col="the.source", **where),
        "op3": lambda d: lm.score_texts(d, F.lit(False), rounds=1, **where),
        "op4": lambda d: packing.pack_documents(d, **where),
        "op5": lambda d: exact_dedup.exact_duplicates(d, **where),
        "op6": lambda d: toxicity.score(d, toxicity.Model(toxicity.Lexicon({"bad": toxicity.Term(1.0)}), (1.0, 1.0), np.zeros(3)), **where),
        "op7": lambda d: ngram_join.ngram_join(d, **where),
        "op8": lambda d: quality.quality_rules(d, **where),
        "op9": lambda d: pii.find_personal_data(d, **where),
        "op10": lambda d: langid.identify(d, langid.train(d, "the.text", "the.lang"), **where),
    }
    for name, run in each.items():
        assert run(dotted.limit(0)).count() == 0, name
        n = run(dotted).select("`the.id`").count()
        assert n >= len(rows) if name == "op4" else n == len(rows), name
    assert toxicity.train(df.limit(0), no).lexicon.terms == {}
    assert chat.fold_events(spark.createDataFrame([], "conv_id long, seq long, kind string, message long, role string, text string")).count() == 0


def test_stages_without_rows(spark):
    import corpus_pipeline as c

    docs = table(spark, SF, "documents")
    for name, stage in c.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").translate(LOW).encode().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return union_find(links, ids), {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (1, 60)])
def test_ngram_join(spark, width, percent):
    rng = np.random.default_rng(5)
    texts = {}
    for k in range(260):
        if k < 60:
            w = list(rng.integers(0, 40 if k % 3 else 4000, rng.integers(0, 120)))
        else:  # copies of earlier texts, some changed
            w = texts[int(rng.integers(0, k))].split()
            for _ in range(int(rng.integers(0, 4))):
                if w:
                    w[int(rng.integers(0, len(w)))] = f"n{rng.integers(0, 50)}"
        texts[k] = " ".join(map(str, w))
    want, sizes = brute_components(texts, width, percent)
    df = spark.createDataFrame([*texts.items(), (None, "a b c d e f")], "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_join.ngram_join(df, width=width, percent=percent).collect()}
    assert len(got) == 261 and got.pop(None).component_id is None
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == sizes


def test_ngram_join_differences_from_pivots(spark, monkeypatch):
    """Copies of a few originals at all distances, so that large groups stay open and their differences are indexed."""
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    rng = np.random.default_rng(11)
    originals = [[f"o{k}_{j}" for j in range(n)] for k, n in enumerate((60, 150, 300))]
    texts = {}
    for i in range(400):
        w = list(originals[i % 3])
        for _ in range(int(rng.integers(0, len(w) // 9))):
            at = int(rng.integers(0, len(w)))
            kind = rng.integers(0, 4)  # replaced by a word of its own or one that others have too, dropped, repeated
            w[at : at + 1] = [[f"n{i}_{at}"], [f"c{rng.integers(0, 5)}"], [], [w[at]] * 2][kind]
        texts[i] = " ".join(w)
    seen = []
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: seen.append(name) or store.materialize(df, name))
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(df, width=5, percent=80).collect()}
    assert got == brute_components(texts, 5, 80)[0] and "nj-below" in seen


def changed_copies(rng, n_words, n_copies, most):
    texts = {}
    for i in range(n_copies):
        w = [f"o{j}" for j in range(n_words)]
        for at in rng.integers(0, n_words, int(rng.integers(0, most))):
            w[at] = f"c{rng.integers(0, 400)}"
        texts[i] = " ".join(w)
    return texts


def test_ngram_join_indexes_few_differences(spark, monkeypatch):
    """Many copies of one text, each changed at random: few differences can lead to a link, so few are indexed."""
    texts = changed_copies(np.random.default_rng(23), 150, 500, 14)
    made = {}

    def counted(df, name):
        made[name] = store.materialize(df, name)
        if name == "nj-below":
            made["rows"] = made[name].count()
        return made[name]

    monkeypatch.setattr(ngram_join, "materialize", counted)
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(df, width=5, percent=80).collect()}
    assert got == brute_components(texts, 5, 80)[0]
    assert made["rows"] < 4 * len(texts)


@pytest.mark.parametrize("few,worthwhile", [(3, 1.0), (64, 0.0)])
def test_ngram_join_useful_differences(spark, monkeypatch, few, worthwhile):
    """One round of dropping with combinations of differences, and all rounds with single ones, lose no link."""
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "WORTHWHILE", worthwhile)
    rng = np.random.default_rng(29)
    texts = changed_copies(rng, 120, 150, 12)
    for i in range(150, 330):  # copies of copies share differences from the center
        w = texts[int(rng.integers(0, i))].split()
        for at in rng.integers(0, len(w), int(rng.integers(0, 4))):
            w[at : at + 1] = [[f"c{rng.integers(0, 5)}"], [], [w[at]] * 2][rng.integers(0, 3)]
            w.append("end")
        texts[i] = " ".join(w)
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(df, width=5, percent=80).collect()}
    assert got == brute_components(texts, 5, 80)[0]


@pytest.mark.parametrize("together", [0, 250, 1 << 16])
def test_ngram_join_rounds_for_large_tables_only(spark, monkeypatch, together):
    """What one task can look through takes no rounds; in rounds, or with some pivots in rounds, the result is the same."""
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    monkeypatch.setattr(ngram_join, "TOGETHER", together, raising=False)
    monkeypatch.setattr(graph, "TOGETHER", together, raising=False)
    rng = np.random.default_rng(37)
    texts = changed_copies(rng, 120, 100, 12)
    texts |= {100 + i: t.replace("o", "other") for i, t in changed_copies(rng, 120, 30, 12).items()}
    for i in range(130, 260):  # copies of copies share differences from the center
        w = texts[int(rng.integers(0, i))].split()
        for at in rng.integers(0, len(w), int(rng.integers(0, 4))):
            w[at : at + 1] = [[f"c{rng.integers(0, 5)}"], [], [w[at]] * 2][rng.integers(0, 3)]
            w.append("end")
        texts[i] = " ".join(w)
    seen = Counter()
    for module in (ngram_join, graph):
        monkeypatch.setattr(module, "materialize", lambda df, name: seen.update([name]) or store.materialize(df, name))
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(df, width=5, percent=80).collect()}
    assert got == brute_components(texts, 5, 80)[0]
    assert (seen["nj-useful"] == seen["cc-0"] == 0 and seen["cc"] == 2) == (together == 1 << 16)


def test_ngram_join_leaves_strangers_of_pivots(spark, monkeypatch):
    """Texts that share a passage and little else meet by its tokens; their differences need not be listed."""
    passage = [f"p{j}" for j in range(79)]
    texts = {i: " ".join(passage + [f"own{i}_{j}" for j in range(25)]) for i in range(80)}
    texts |= {100 + i: texts[i].replace(f"own{i}_{9 + i}", f"new{i}") for i in range(5)}
    handed = []

    def centered(table, of=ngram_join._centered):
        handed.extend(r.tokens for r in table.collect())
        return of(table)

    monkeypatch.setattr(ngram_join, "_centered", centered)
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(df, width=5, percent=80).collect()}
    assert got == brute_components(texts, 5, 80)[0]
    assert sum(map(len, handed)) < 5 * len(texts)


def test_outside_prefix_is_a_bound():
    rng = np.random.default_rng(31)
    seen = Counter()
    for _ in range(6000):
        n = int(rng.integers(5, 200))
        b = rng.choice(400, n, replace=False)
        c = np.union1d(b[rng.random(n) < rng.uniform(0.7, 1)], rng.choice(400, rng.integers(0, 1 + n // 4), replace=False))
        a = np.unique(np.concatenate([b[rng.random(n) < rng.uniform(0, 0.9)], rng.choice(400, rng.integers(0, n), replace=False)]))
        percent = int(rng.integers(50, 95))
        both = len(np.intersect1d(b, c))
        if 100 * both >= percent * (n + len(c) - both):
            a, b, c = (np.sort(x).astype(np.uint64) for x in (a, b, c))
            (x, need_x), (y, need_y) = (ngram_join.outside_prefix(s, a, percent) for s in (b, c))
            seen[max(need_x, need_y) > 3] += 1
            assert len(np.intersect1d(x, y)) >= max(need_x, need_y)
    assert min(seen[True], seen[False]) > 20


def test_shared_differences_is_a_bound():
    rng = np.random.default_rng(3)
    seen = Counter()
    for _ in range(4000):
        center = set(range(60))
        sets = [set(rng.choice(60, rng.integers(30, 61), replace=False)) | set(rng.integers(60, 75, rng.integers(0, 8))) for _ in range(3)]
        percent = int(rng.integers(50, 95))
        over = [ngram_join.excess(len(x ^ center), len(x), percent) for x in sets]
        least = min(over)
        a, b = sets[:2]
        alike = 100 * len(a & b) >= percent * len(a | b)
        if over[0] + over[1] <= 0:
            assert alike
        if alike and over[0] + least > 0:  # a is apart
            seen[over[1] + least > 0] += 1
            both = len((a ^ center) & (b ^ center))
            for x, apart in ((a, True), (b, over[1] + least > 0)):
                assert both >= ngram_join.shared_differences(len(x ^ center), len(x), least if apart else abs(least), percent)
    assert min(seen[True], seen[False]) > 20


def test_ngram_join_odd(spark, odd):
    df, rows = odd
    got = ngram_join.ngram_join(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got}[9] == 7
    assert ngram_join.ngram_join(df.limit(0)).count() == 0
    assert ngram_join.keep_one_per_component(df).columns == df.columns


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 430)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union_find(pairs, {x for p in pairs for x in p})
    assert all(got.get(n, n) == c for n, c in want.items())


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    df, rows = odd
    exact = Tokenizer.from_file(packing.default_vocabulary())
    rows = [r for r in rows if r[0] is not None and r[0] != 9]
    got = packing.packed_pieces(df.where("doc_id is not null and doc_id <> 9")).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t, *_ in rows:
        ids, at = exact.encode(t or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.packed_pieces(df.limit(0)).count() == 0


def test_mixing(spark, odd):
    df, rows = odd
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    again = mixing.mix_sources(df.repartition(3)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(got, key=key) == sorted(again, key=key)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, total = {}, 1.5 * sum(sizes.values())
    free = set(names)
    while True:  # as worded: the excess goes to the others until none is above
        left = total - sum(2 * sizes[s] for s in set(names) - free)
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]}
        if not over:
            break
        free -= over
    target = {s: left * weight[s] / sum(weight[x] for x in free) if s in free else 2 * sizes[s] for s in names}
    assert {round(r.target, 6) for r in got} == {round(t, 6) for t in target.values()}
    assert mixing.mix_sources(df.limit(0)).count() == 0
    whole = mixing.mixed_documents(df)
    assert whole.columns == df.columns


def test_mixing_near_targets_and_permutation(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    taken = docs.select("doc_id", "source").join(mixing.mix_sources(docs), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken / r.target - 1) < 0.05 for r in taken)
    words = mixing.mixed_documents(docs).agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert words == sum(r.taken for r in taken)
    p = spark.range(35).select(mixing.permuted(F.col("id"), F.lit(5).cast("long"), F.lit(7).cast("long"), F.lit(3)).alias("p"))
    assert sorted(r.p for r in p.collect()) == list(range(35))


def test_mixing_shards(spark):
    """Counts by shard sum to the totals, slots follow from them, and parts in slots are what is taken."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    _, plan = mixing._layout(docs, "text", "doc_id", "source", [], 0, 16, 1 << 12)
    draws = {r["rank"]: r["draws"] for r in plan.collect()}
    counts = mixing.draw_counts(plan).collect()
    by_source = defaultdict(list)
    for r in counts:
        by_source[r["rank"]].append(r)
    shards = {r["shard"] for r in counts}
    assert len(shards) > 1 and len(by_source) == len(draws) > 1
    for rank, rows in by_source.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["shard"]):
            assert r["first"] == at
            at += r["n"]
        assert at == draws[rank]
        expected = draws[rank] / len(shards)
        assert all(abs(r["n"] - expected) < 6 * expected**0.5 + 6 for r in rows)
    slots = mixing.mix_slots(docs, block_words=16, stream_words=1 << 12)
    whole = {r["doc_id"]: r for r in mixing.mix_sources(docs, block_words=16, stream_words=1 << 12).collect()}
    got = slots.groupBy("doc_id").agg(F.sum(F.col("to") - F.col("from")).alias("taken"), F.count_distinct("shard").alias("n")).collect()
    assert {r["doc_id"]: (r["taken"], r["n"]) for r in got} == {i: (r["taken"], r["n_shards"]) for i, r in whole.items() if r["taken"]}
    # The slot numbers of a source lie in the range that its shard has drawn.
    first = {(r["rank"], r["shard"]): (r["first"], r["first"] + r["n"]) for r in counts}
    assert all(first[r["source_rank"], r["shard"]][0] <= r["slot"] < first[r["source_rank"], r["shard"]][1] for r in slots.select("source_rank", "shard", "slot").distinct().collect())


def test_chat(spark):
    turns = [(1, 0, "user", "<|turn|>\\n[INST]"), (1, 1, "assistant", "\\l<|end|>"), (1, 2, None, None), (2, 0, "assis\ntant", "x"), (2, 0, "assistant", ""), (None, 0, "user", "a"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "<|turn|>\\n[INST]"), ("assistant", "\\l<|end|>"), ("", "")]
    assert got[1].learned == ["\\l<|end|>"] and got[-7].learned == ["</s>[INST] ok [/INST]"]
    assert [t.role for t in got[2].turns] == ["assis\ntant", "assistant"] and len(got) == 4
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_chat_folds_events(spark):
    log = [(1, 1, "message", 0, "user", "hi"), (1, 2, "message", 1, "assistant", "he"), (1, 3, "delta", 1, None, "ll"), (1, 4, "delta", 1, None, "o"), (1, 5, "message", 2, "user", "gone"), (1, 6, "regenerate", 1, None, "bye"), (1, 7, "delta", 1, None, "!"), (1, 8, "edit", 0, None, "HI")]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string")
    got = sorted((r.message, r.role, r.text) for r in chat.fold_events(df).collect())
    assert got == [(0, "user", "HI"), (1, "assistant", "bye!")]


def test_chat_folds_random_logs_as_written(spark):
    rng = np.random.default_rng(21)
    log = [(int(rng.integers(0, 40)), int(rng.integers(0, 25)), [None, "message", "edit", "delta", "delta", "regenerate"][rng.integers(0, 6)], [None, 0, 1, 2, 3][rng.integers(0, 5)], [None, "user", "assistant"][rng.integers(0, 3)], [None, "a", "b", "c"][rng.integers(0, 4)]) for _ in range(600)]
    state = {}
    first = lambda m: -1 if m is None else m
    for conv, seq, message, kind, text, role in sorted((c, s, first(m), k or "message", t or "", r or "") for c, s, k, m, r, t in log):
        messages = state.setdefault(conv, {})
        if kind == "regenerate":
            for later in [m for m in messages if m > message]:
                del messages[later]
        before = messages.get(message, (None, ""))
        messages[message] = (role or before[0], before[1] + text if kind == "delta" else text)
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string")
    got = {(r.conv_id, first(r.message)): (r.role, r.text) for r in chat.fold_events(df).collect()}
    want = {(c, m): x for c, messages in state.items() for m, x in messages.items()}
    assert got.keys() == want.keys() and {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    lone = [k for k in want if sum((r[0], first(r[3])) == k and r[4] is not None for r in log) < 2]
    assert lone and all(got[k][0] == want[k][0] for k in lone)


def test_hmm_is_a_distribution_and_exact():
    rng = np.random.default_rng(0)
    emit = rng.random((3, lm.STATES))
    hmm = lm.Hmm(np.full(lm.STATES, 1 / lm.STATES), rng.dirichlet(np.ones(lm.STATES), lm.STATES), emit / emit.sum(axis=0))
    every = [np.array([a, b, c]) for a in range(3) for b in range(3) for c in range(3)]
    assert abs((10 ** hmm.log10(every)).sum() - 1) < 1e-9
    mixed = [np.array([0]), np.array([1, 2, 0, 1]), np.array([2, 2])]
    for seq, value in zip(mixed, hmm.log10(mixed)):
        a = hmm.start * hmm.emit[seq[0]]
        for s in seq[1:]:
            a = (a @ hmm.step) * hmm.emit[s]
        assert abs(np.log10(a.sum()) - value) < 1e-9


@pytest.mark.parametrize("run,portion", [(1, 2), (3, 4), (128, 4096)])
def test_baum_welch_counts_against_enumeration(monkeypatch, run, portion):
    """Expected counts of whole texts, whatever the runs in which they are worked out."""
    import itertools

    monkeypatch.setattr(lm, "RUN", run)
    monkeypatch.setattr(lm, "SLICE", portion)
    monkeypatch.setattr(lm, "SYMBOLS", 4)
    rng = np.random.default_rng(1)
    emit = rng.random((4, 3))
    hmm = lm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), emit / emit.sum(axis=0))
    texts = [rng.integers(0, 4, n) for n in (7, 1, 3, 6, 2, 7, 4)]
    first, steps, emissions = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for text in texts:
        paths = list(itertools.product(range(3), repeat=len(text)))
        weight = np.array([hmm.start[p[0]] * np.prod([hmm.step[a, b] for a, b in zip(p, p[1:])]) * np.prod([hmm.emit[x, a] for x, a in zip(text, p)]) for p in paths])
        for p, w in zip(paths, weight / weight.sum()):
            first[p[0]] += w
            for a, b in zip(p, p[1:]):
                steps[a, b] += w
            for x, a in zip(text, p):
                emissions[x, a] += w
    for got, want in zip(hmm.expect(texts), (first, steps, emissions)):
        assert np.allclose(got, want, atol=1e-4)


def test_baum_welch_multiplies_matrices_only_for_very_long_texts(monkeypatch):
    """Texts of usual length are worked out whole, side by side; what long ones get by runs is the same."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(lm, "SYMBOLS", 9)
    emit = rng.random((9, lm.STATES)) ** 8
    hmm = lm.Hmm(rng.dirichlet(np.ones(lm.STATES)), rng.dirichlet(np.full(lm.STATES, 0.1) + 0.01, lm.STATES) * 0.99 + 0.01 / lm.STATES, emit / emit.sum(axis=0))
    texts = [rng.integers(0, 9, n) for n in (1000, 1, 300, 128, 129, 2, 700, 700)]
    with monkeypatch.context() as m:
        m.setattr(lm.Hmm, "_products", lambda *_: pytest.fail("a product for a text of usual length"))
        whole = hmm.expect(texts)
    assert abs(whole[0].sum() - len(texts)) < 1e-3 and abs(whole[2].sum() - sum(map(len, texts))) < 1e-2
    assert np.allclose(whole[2].sum(axis=1), np.bincount(np.concatenate(texts), minlength=9), atol=1e-2)
    for most, run, portion in ((1, 1, 300), (2, 3, 4), (128, 128, 4096), (650, 50, 3)):
        monkeypatch.setattr(lm, "WHOLE", most)
        monkeypatch.setattr(lm, "RUN", run)
        monkeypatch.setattr(lm, "SLICE", portion)
        for got, want in zip(hmm.expect(texts), whole):
            assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_lm_words_are_looked_up_once_a_slice(monkeypatch):
    texts = ["", None, " a\tB\n\x0bÀ\x0c\x0da ", "  ", "x\x1cy\u0085z\x00 \u00a0q 日本語", "a a b", "É ab abc abcd zabcd"]
    code, count, words = lm.encoded(pa.array(texts))
    found = [w.encode() for w in words.to_pylist()]
    want = [(t or "").encode().lower().split() for t in texts]
    assert [found[c] for c in code] == [w for x in want for w in x] and count.tolist() == [len(x) for x in want]
    asked = []
    monkeypatch.setattr(lm, "class_of", lambda w, f=lm.class_of: asked.append(w) or f(w))
    vocabulary = lm.Vocabulary(pa.array(["a", "b", "日本語"]), np.array([5, 4, 2]), 2)
    symbol, c = vocabulary.look_up(pa.array(["b", "abcd", "zabcd", "a", "日本語", "", "xbcd"]))
    assert symbol.tolist() == [2, *[1 + lm.VOCABULARY + lm.class_of(w) for w in (b"bcd", b"bcd")], 1, *[1 + lm.VOCABULARY + lm.class_of(w) for w in ("日本語".encode(), b"", b"bcd")]]
    assert c.tolist() == [4, -1, -1, 5, 2, -1, -1] and len(asked) == 3 + 5  # three endings, and five times just now


def test_lm_scores(spark, odd):
    df, rows = odd
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = lm.score_texts(df, held, rounds=1).collect()
    assert len(got) == len(rows) and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)
    counts = Counter()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for r in rows:
        if not out(r[0]):
            counts.update((r[1] or "").encode().lower().split() + [None])
    n, v = sum(counts.values()), len(counts)
    want = {r[0]: sum(np.log10((counts[t] + 1) / (n + v + 1)) for t in (r[1] or "").encode().lower().split() + [None]) for r in rows if r[0] is not None}
    assert all(abs(r.base_score - want[r.doc_id]) < 1e-6 * abs(want[r.doc_id]) for r in got if r.doc_id is not None)
    assert lm.score_texts(df.limit(0), held, rounds=1).count() == 0
    docs = registry.op3_hmm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert docs.s > docs.b


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_edit_distances():
    rng = np.random.default_rng(3)
    word = lambda lo, hi: "".join(rng.choice(list("abc"), rng.integers(lo, hi)))
    for _ in range(60):
        terms = {word(2, 7): toxicity.Term(float(rng.random()) + 0.1, bool(rng.random() < 0.4), bool(rng.random() < 0.7)) for _ in range(8)}
        lexicon = toxicity.Lexicon(terms)
        for _ in range(60):
            w = word(1, 10)
            near = {}
            for t, x in terms.items():
                d = min(edits(w[:n], t) for n in range(len(w) + 1)) if x.open else edits(w, t)
                if d == 0 or d == 1 and x.fuzzy:
                    near[t] = d
            got = lexicon.match(w)
            assert (got is None) == (not near), (w, terms, got, near)
            if got:
                assert got[1] == near[got[0]] == min(near.values())
    lexicon = toxicity.Lexicon({"idiot": toxicity.Term(3.0), "low": toxicity.Term(2.0, True, False)})
    assert [lexicon.match(w) for w in ("idiot", "idiott", "idot", "lowest", "clear", "lxw")] == [("idiot", 0), ("idiot", 1), ("idiot", 1), ("low", 0), None, None]
    assert [h.quoted for h in toxicity.hits('you idiot, she said "idiot" today', lexicon, {})] == [False, True]


@pytest.fixture(scope="module")
def abuse(spark):
    """Rows whose toxic half has one of four words, some misspelt; rows in quotes after "reports" are not toxic."""
    rng = np.random.default_rng(12)
    plain = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(80)]
    say = lambda n: " ".join(rng.choice(plain, n))
    slurs = ["zornwurst", "quibblon", "trompelix", "wuxmaton"]
    rows = []
    for k in range(400):
        slur = slurs[k % 4]
        if k % 3 == 0:
            rows.append((k, f"{say(12)} {slur if k % 9 else slur[:3] + 'y' + slur[4:]} {say(6)} {slurs[(k + 1) % 4]}", 1))
        elif k % 10 == 1:
            rows.append((k, f"{say(9)} reports {slur} {say(9)}", 0))
        else:
            rows.append((k, say(20), 0))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(9999, None), (9998, 7), (None, 1)], "doc_id long, toxic int")
    return docs, labels, slurs, say, toxicity.train(docs, labels)


def test_toxicity_finds_misspellings_and_tells_quotation(spark, abuse):
    _, _, slurs, say, model = abuse
    assert set(slurs) <= set(model.lexicon.terms) and "reports" in model.lexicon.told
    texts = {0: f"{say(10)} {slurs[0]} {say(5)} {slurs[1]}", 1: f"{say(10)} zornwrst {say(5)} quibbblon trompelis", 2: f'{say(10)} reports {slurs[0]} {say(9)} "{slurs[1]}" {say(9)}', 3: say(20), 4: f"{say(10)} zornwurst {say(10)}", 5: f"{say(10)} zornwyrst {say(10)}", 6: None}
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame([*texts.items()], "doc_id long, text string"), model).collect()}
    assert got[0].score >= toxicity.THRESHOLD and got[1].score >= toxicity.THRESHOLD and [h.edits for h in got[1].hits] == [1, 1, 1]
    assert got[2].score < 0.5 and all(h.quoted for h in got[2].hits) and len(got[2].hits) == 2
    assert got[4].score > got[5].score > got[3].score == got[6].score


def test_lexicon_against_brute_force(abuse):
    """Every form that holds is chosen or covered, and nothing else is."""
    docs, labels, _, _, model = abuse
    import math

    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1)}
    bad, good = Counter(), Counter()
    for r in docs.collect():
        (bad if toxic[r.doc_id] else good).update(toxicity._forms(r.text))
    b, g = sum(toxic.values()), len(toxic) - sum(toxic.values())
    tested = sum(bad[f] + good[f] > 1 for f in bad.keys() | good.keys())

    def holds(f):
        n, share = bad[f] + good[f], b / (b + g)
        ratio = bad[f] * math.log(bad[f] / n / share) + (good[f] * math.log(good[f] / n / (1 - share)) if good[f] else 0)
        return bad[f] > 1 and bad[f] >= toxicity.MIN_PRECISION * n and ratio >= math.log(tested)

    held = {f: (bad[f], good[f]) for f in bad if holds(f)}
    assert toxicity.chosen_terms(held, b, g).keys() == model.lexicon.terms.keys()
    for f in held:
        base = f.rstrip("*")
        assert any(t == base or t.startswith(base) and f.endswith("*") or x.open and base.startswith(t) for t, x in model.lexicon.terms.items())


def test_toxicity(spark, odd):
    df, rows = odd
    got = registry.op6_toxicity(spark, "/root/testdata/sf0.01").where("held_out")
    c = Counter((r.toxic, r.predicted) for r in got.join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").collect())
    assert c[(1, 1)] > 2 * c[(1, 0)] and c[(0, 1)] <= 0.02 * c[(0, 0)]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(df, none)
    scored = toxicity.score(df, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(df.limit(0), model).count() == 0


def test_lexicon_keeps_rare_terms_among_many_common_forms(spark):
    """Everyday words in more toxic rows than a rarer term, with over 50,000 forms, do not crowd it out."""
    rng = np.random.default_rng(4)
    common = " ".join("".join(chr(97 + c) for c in word) for word in rng.integers(0, 26, (9_000, 10)))
    texts = [(common, 1)] * 20 + [(common, 0)] * 40 + [("grobnik", 1)] * 12 + [("calm", 0)] * 40
    assert len(toxicity._forms(common)) > 50_000
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    lexicon = toxicity.train(docs, spark.createDataFrame([(k, y) for k, (_, y) in enumerate(texts)], "doc_id long, toxic int")).lexicon
    assert lexicon.match("grobnik") and not any(lexicon.match(w) for w in common.split()[:50] if not w.startswith("gro")) and not lexicon.match("calm")


def test_pii(spark, odd):
    df, rows = odd
    t = "a@b.co x.y@@z.de 1.2.3.4 999.1.1.1, 4111 1111 1111 1111 +1 (555) 010-9999 d.e@f.g-h.com@i.j 00001.2.3.4"
    kinds = [(k, t[a:b]) for k, a, b in pii.base_spans(t)]
    assert kinds == [("email", "a@b.co"), ("email", "d.e@f.g-h.com"), ("ip", "1.2.3.4"), ("ip", "00001.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-9999")]
    assert pii.find_personal_data(df).count() == len(rows)
    assert pii.find_personal_data(df.limit(0)).count() == 0


def contract_spans(text):
    """The fixed forms as they are worded, by plain regular expressions."""
    forms = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub("[^0-9]", "", s)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(re.sub("[^0-9]", "", s)[::-1])) % 10 == 0),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    return [(kind, m.start(), m.end()) for kind, (form, passes) in forms.items() for m in re.finditer(form, text) if passes(m[0])]


def test_pii_forms_against_the_wording():
    rng = np.random.default_rng(8)
    for alphabet in ("a.@-1 +", "0123. ", "0-9 +()", "4111 1-", "x%@.y2é+"):
        for _ in range(1500):
            text = "".join(rng.choice(list(alphabet), rng.integers(0, 60)))
            assert pii.base_spans(text) == contract_spans(text), text
    assert pii.base_spans("4242424242424242 +14155550123 1.2.3.4") == contract_spans("4242424242424242 +14155550123 1.2.3.4")
    assert pii.base_spans("0" * 5000 + ".0.0.0") == [("ip", 0, 5006)] and pii.base_spans("9" * 5000 + ".0.0.0") == []


def test_pii_bootstrap(spark):
    """Keys teach their context, which finds strings of another shape, which teach a second context; everyday words teach none."""
    rng = np.random.default_rng(6)
    key = lambda: "".join(rng.choice(list("0123456789abcdef"), 40)) + "a1"
    texts = [f'see the {key()} and passwort = "{key()}" end the house the dog' for _ in range(6)]
    texts += [f'passwort = "Zx-{k}77" and secret_id: Zx-{k}77 ok the 20{k}0-01 day' for k in range(4)]
    texts += ["secret_id: Qy.99x1 ok the Qy.99x2 day", "ask the a@b.co the c@d.co the e@f.co", "the " * 50, "no secret"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    cut = lambda k: [texts[k][int(a) : int(b)] for kind, a, b in (s.split(":") for s in rows[k].spans.split(",") if s) if kind == "id"]
    assert all(cut(k) == [texts[k].split('"')[1]] for k in range(6))
    assert all(cut(k) == [f"Zx-{k - 6}77"] * 2 for k in range(6, 10))
    assert cut(10) == ["Qy.99x1"] and not any(cut(k) for k in (11, 12, 13))


def test_pii_patterns_against_brute_force(spark):
    rng = np.random.default_rng(9)
    graph = [(f"p{rng.integers(0, 12)}", f"i{rng.integers(0, 30)}", bool(rng.random() < 0.2)) for _ in range(200)]
    total = {f"p{k}": int(rng.integers(1, 30)) for k in range(12)}
    known = {i for _, i, k in graph if k}
    for _ in range(pii.ROUNDS):
        good = {}
        for p in total:
            filled = [i for q, i, _ in graph if q == p and i in known]
            if len(set(filled)) >= pii.MIN_INSTANCES and len(filled) >= pii.MIN_SHARE * max(len(filled), total[p]):
                good[p] = len(filled) / max(len(filled), total[p])
        known |= {i for p, i, _ in graph if p in good}
    counts = spark.createDataFrame([*total.items()], "pattern string, n long")
    # An instance that one row calls known is known wherever it stands.
    got = pii.good_patterns(spark.createDataFrame(graph, "pattern string, instance string, known boolean"), lambda patterns: counts)
    assert {r.pattern: round(r.share, 9) for r in got.collect()} == {p: round(x, 9) for p, x in good.items()}


def test_langid(spark, odd):
    df, rows = odd
    got = registry.op10_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    model = langid.train(df, "text", "lang")
    out = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert out[0].lang_pred == out[1].lang_pred == out[2].lang_pred == "und"
    assert len(langid.identify(df.limit(0), langid.train(df.limit(0), "text", "lang")).collect()) == 0


def test_langid_learns_every_language(spark):
    """300 languages of one word each: beyond the former 64 and beyond one byte."""
    said = {f"l{k:03}": "".join(chr(97 + (k * 7 + j * j * (k + 3)) % 26) for j in range(3)) + chr(97 + k // 26) + chr(97 + k % 26) for k in range(300)}
    docs = spark.createDataFrame([(k, " ".join([word] * 4), lang) for k, (lang, word) in enumerate(said.items())], "doc_id long, text string, lang string")
    model = langid.train(docs, "text", "lang")
    assert model.names == sorted(said)
    assert all(r.lang_pred == r.lang for r in langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect())
    assert [x.tolist() for x in langid.viterbi([np.eye(300, dtype=np.float32)[[299, 299]]])] == [[299, 299]]


def test_langid_scripts():
    names = ["", *langid._BLOCKS]
    said = "Hello wörld “Ελλάδα” мир हिन्दी বাংলা தமிழ் ไทย ລາວ ქართული việt 한국어 漢字 かな カナ ።አማርኛ— x1y"
    _, begin, script, chars = langid.words_of(said.encode())
    assert [names[k] for k in script] == ["Latin", "Latin", "Greek", "Cyrillic", "Devanagari", "Bengali", "Tamil", "Thai", "Lao", "Georgian", "Latin", "Hangul", "Han", "Hiragana", "Katakana", "Ethiopic", "Latin", "Latin"]
    assert chars[:4].tolist() == [5, 5, 6, 3] and len(begin) == len(script)


def test_langid_against_brute_force(spark):
    """Counts of n-grams and scripts, word scores and the vote, told again without numpy's tricks."""
    rng = np.random.default_rng(13)
    letters = {"aa": "abcde é", "bb": "defgh ü", "gg": "αβγδε ζ"}
    rows = [(k, "".join(rng.choice(list(letters[lang]), 60)), lang) for k in range(30) for lang in letters] + [(91, None, "aa"), (92, "", "bb"), (93, "no lang", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, "text", "lang")
    assert model.names == ["aa", "bb", "gg"]
    bucket = lambda g: (int.from_bytes(g, "little") * 2654435761 % (1 << 32)) >> 17
    counts = {lang: Counter() for lang in letters}
    scripts = {lang: set() for lang in letters}

    def grams(text):
        b = b" " + text.lower().encode() + b"   "
        begins = [m.start() - 1 for m in re.finditer(rb"[^ ]+", b)] + [len(b) - 3]
        return [[bucket(b[i : i + 4]) for i in range(m, n)] for m, n in zip(begins, begins[1:])]

    for _, text, lang in rows:
        if text and lang:
            for g in grams(text):
                counts[lang].update(g)
            scripts[lang] |= {"G" if any("α" <= c <= "ω" for c in w) else "L" for w in text.split()}
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    for text in ("abc deé dgh", "αβγ abc", "fgh üge dd αβ"):
        scores, _ = model.word_scores(text.encode())
        for w, g, got in zip(text.split(), grams(text), scores):
            want = [sum(np.log((counts[x][k] + langid.SMOOTHING) / (total[x] + langid.SMOOTHING * langid.BUCKETS)) for k in g) if ("G" if w[0] >= "α" else "L") in scripts[x] else -np.inf for x in model.names]
            assert np.allclose(got, np.array(want) - max(want), atol=1e-3)


def test_viterbi_against_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    texts = [rng.normal(0, 3, (n, 3)).astype(np.float32) for n in (5, 1, 4, 0)]
    for scores, labels in zip(texts, langid.viterbi(texts, 2.0)):
        value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max((value(p) for p in itertools.product(range(3), repeat=len(scores))), default=0)
        assert len(labels) == len(scores) and abs(value(list(labels)) - best) < 1e-4


def test_pipeline(spark):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["quality", "exact_dedup", "ngram_jaccard_join", "mixing", "packing"]
    docs = table(spark, SF, "documents")
    good = c.quality_stage(spark, docs, SF)
    texts = {r.doc_id: r.text for r in good.collect()}
    unique = c.exact_dedup_stage(spark, good, SF)
    by_text = defaultdict(list)
    for i, t in texts.items():
        by_text[t.translate(LOW)].append(i)
    assert {r.doc_id for r in unique.collect()} == {max(v) for v in by_text.values()}
    left = {r.doc_id: r.text for r in unique.collect()}
    want, _ = brute_components(left, 5, 80)
    single = c.near_dedup_stage(spark, unique, SF)
    assert {r.doc_id for r in single.collect()} == set(want.values())
    mix = c.mixing_stage(spark, single, SF)
    assert mix.columns == docs.columns
    packed = c.run(spark, SF)
    assert packed.agg(F.sum("length")).first()[0] > 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    from compare import difference

    assert difference(spark, registry.queries()[name], registry.oracle_sql()[name], SF) is None
