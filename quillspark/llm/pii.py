"""Personal data by fixed forms and by bootstrapped contextual extraction.

Four kinds have fixed forms (e-mail, IPv4 address, card, telephone).  Their
finds, and strings that can only be keys (long, of hexadecimal digits), are
the seeds of a bootstrap.  A pattern is what stands around a string: the word
before it, the marks between and, in a second form, the marks after it.  Spark
scores the graph of patterns and instances in rounds: a pattern holds if it is
found around enough different known instances and they fill most of *all* its
occurrences in all texts, so an everyday word holds nothing.  Every string of
the shape of an identifier that a pattern which holds has found becomes known,
wherever else it stands.  These strings in those contexts are added as spans
of kind ``id``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, named
from .words import slices

KINDS = ("email", "ip", "card", "phone")
EXTRA = "id"
#: A pattern must be seen around so many different known instances, which fill so large a share of its occurrences.
MIN_INSTANCES, MIN_SHARE = 3, 0.5
ROUNDS = 3
#: Slots of the filter by which tasks know the patterns to count (1 MB when sent); more patterns only cost time.
SLOTS = 1 << 20

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\w+(?:[.@+/:-]\w+)*")
_PAIR = re.compile(r"(\w+(?:[.@+/:-]\w+)*)(\W*)")
_LAST = re.compile(r"\w+(?:[.@+/:-]\w+)*\W*\Z")
#: Seeds that are keys by their form; and the shape of identifiers, which holds for any of them.
_KEY = re.compile(r"(?=[a-z]*[0-9])(?=[0-9]*[a-z])[0-9a-f]{32,}|(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[0-9A-F]{32,}")
MIN_IDENTIFIER = 6
#: Parts of a context are cut to so many characters from the instance on.
_CONTEXT = 24


def _emails(text: str) -> list[tuple[int, int]]:
    found, last = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and ord(text[start - 1]) in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            last = m.end()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed forms by kind and start: leftmost, not overlapping within a kind; matches that fail their test are dropped."""
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(q) <= 3 and int(q or "0") <= 255 for q in (part.lstrip("0") for part in m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return spans


def _marks(gap: str) -> str:
    return " ".join(gap.split())


def patterns_around(before: str, gap: str, after: str) -> tuple[str, str]:
    """The two patterns of a string, from the word before it, the marks between, and what follows up to the next word."""
    left = f"{before[-_CONTEXT:].lower()} {_marks(gap[-_CONTEXT:])}\t"
    return left, left + _marks(after[:_CONTEXT])[:1]


def _candidates(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds and strings of the shape of identifiers: patterns, instance, start, end, known."""
    taken = sorted((a, b) for _, a, b in spans)
    found = [(a, b, True) for a, b in taken]
    k = 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        if b - a < MIN_IDENTIFIER or not any(c.isdigit() for c in m[0]):
            continue
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= b:
            found.append((a, b, bool(_KEY.fullmatch(m[0]))))
    out = []
    for a, b, known in found:
        last = _LAST.search(text[max(0, a - 4 * _CONTEXT) : a])
        if last:
            before = _TOKEN.match(last[0])
            after = re.match(r"\W*", text[b : b + _CONTEXT])[0]
            out.append({"patterns": patterns_around(before[0], last[0][before.end() :], after), "instance": text[a:b], "start": a, "end": b, "known": known})
    return out


def _slot(pattern: str) -> int:
    return xxhash.xxh3_64_intdigest(pattern) % SLOTS


def count_patterns(docs: DataFrame, text: str, wanted: np.ndarray) -> DataFrame:
    """(pattern, n): how often each pattern occurs around any word, for the patterns whose slot is in ``wanted`` (a boolean for each)."""
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.unpackbits(sent.value).astype(bool)
        seen: Counter = Counter()

        def report() -> pa.RecordBatch:
            counts: Counter = Counter()
            for (before, gap, after), n in seen.items():
                for p in patterns_around(before, gap, after):
                    if slots[_slot(p)]:
                        counts[p] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])

        for batch in batches:
            for part in slices(batch, "__text"):
                for x in part.column(0).to_pylist():
                    pairs = _PAIR.findall(x or "")
                    seen.update((before, gap, after[:1] if after[:1] != " " else after) for (before, gap), (_, after) in zip(pairs, pairs[1:]))
                if len(seen) > 400_000:
                    yield report()
        yield report()

    return docs.select(named(text).alias("__text")).mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(rid, id, counts, base, candidates) for every row."""
    slim = docs.select(named(id_col).alias("__id"), named(text).alias("__text"))
    kind = slim.schema["__id"].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]
    item = pa.struct([("patterns", pa.list_(pa.string())), ("instance", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("known", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = [x or "" for x in part.column(1).to_pylist()]
                spans = [base_spans(x) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(rid, rid + len(texts)), pa.int64()), part.column(0), *(pa.array([sum(s[0] == k for s in x) for x in spans], pa.int64()) for k in KINDS),
                     pa.array([_join(x) for x in spans], pa.string()), pa.array([_candidates(x, s) for x, s in zip(texts, spans)], pa.list_(item))],
                    names=["rid", "__id", *counts, "base", "candidates"],
                )
                rid += len(texts)

    found = f"rid long, __id {kind}, {', '.join(c + ' long' for c in counts)}, base string, candidates array<struct<patterns:array<string>,instance:string,start:long,end:long,known:boolean>>"
    return slim.mapInArrow(run, found)


def good_patterns(candidates: DataFrame, occurrences: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS, min_instances: int = MIN_INSTANCES, min_share: float = MIN_SHARE) -> DataFrame:
    """Patterns (pattern, share) that hold, from (pattern, instance, known), one row for each occurrence.

    ``occurrences`` gives (pattern, n), how often the patterns it is handed
    (a DataFrame of them) occur around anything.  Every round scores all
    patterns by what the occurrences of known instances are of all, and makes
    the instances of those that hold known; it ends when none are new.
    """
    graph = materialize(candidates.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("times"), F.max("known").alias("known")), "pii-graph")
    # Whatever holds has enough instances; only such patterns are counted in the texts.
    enough = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_instances).select("pattern")
    graph = materialize(graph.join(enough, "pattern"), "pii-graph-often")
    total = materialize(occurrences(graph.select("pattern").distinct()), "pii-occurrences")
    known = materialize(graph.where("known").select("instance").distinct(), "pii-known")
    size = known.count()
    while True:
        marked = graph.join(known, "instance", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("k"), F.sum("times").alias("filled"))
        scored = marked.where(F.col("k") >= min_instances).join(total, "pattern", "left")
        share = F.col("filled") / F.greatest("filled", F.coalesce("n", F.lit(0)))
        good = materialize(scored.select("pattern", share.alias("share")).where(F.col("share") >= min_share), "pii-patterns")
        rounds -= 1
        if not rounds:
            return good
        known = materialize(known.unionAll(graph.join(good, "pattern", "left_semi").select("instance")).distinct(), "pii-known")
        before, size = size, known.count()
        if size == before:
            return good


def find_personal_data(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, counts of the four kinds, ``base``, ``spans`` and ``n_id``, how many were added.

    Both list kind:start:end (code points, end exclusive), comma-joined, by
    kind (e-mail, ip, card, phone, then ids found by context) and start.  An
    added span never overlaps a base one.  Null and empty texts have no spans;
    repeated rows are read alike and each kept; an empty table gives no row;
    other columns are not read.
    """
    rows = materialize(scan(docs, text, id_col), "pii-rows")
    each = rows.select("rid", F.explode("candidates").alias("c")).select("rid", F.explode("c.patterns").alias("pattern"), "c.instance", "c.start", "c.end", "c.known")

    def occurrences(patterns: DataFrame) -> DataFrame:
        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([_slot(p) for p in batch.column(0).to_pylist()], pa.int32())], names=["slot"])

        wanted = np.zeros(SLOTS, dtype=bool)
        wanted[patterns.mapInArrow(slots, "slot int").distinct().toPandas()["slot"].to_numpy(dtype=np.int64)] = True
        return count_patterns(docs, text, wanted)

    # A key by its form is a seed, but only its context makes it a span.
    good = good_patterns(each, occurrences)
    more = each.join(good, "pattern", "left_semi").select("rid", "start", "end").distinct()
    base = rows.where("base != ''").select("rid", F.explode(F.split("base", ",")).alias("b")).select("rid", F.split_part("b", F.lit(":"), F.lit(2)).cast("long").alias("start"))
    more = more.join(base, ["rid", "start"], "left_anti")
    more = more.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("more"))
    listed = F.array_join(F.transform("more", lambda s: F.concat_ws(":", F.lit(EXTRA), s["start"].cast("string"), s["end"].cast("string"))), ",")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), listed)
    return rows.drop("candidates").join(more, "rid", "left").select(F.col("__id").alias(id_col), *[f"n_{k}" for k in KINDS], "base", spans.alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_id"))
