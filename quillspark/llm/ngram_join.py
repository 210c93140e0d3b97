"""Near duplicates by Jaccard similarity of word n-grams, over token-combination prefixes.

The tokens of a document are its shingles.  All documents order tokens alike:
rare ones before frequent ones, by hash within a class.  Two sets that are
similar enough share at least k tokens in prefixes of length n - t + k, with
t the least overlap that n allows.  Rare tokens are indexed singly, frequent
ones in combinations of two.  With k = g + m, a pair shares m rare tokens or
g + 1 frequent ones; the frequent ones are split into g groups by hash and
only combinations inside a group are indexed, for two of g + 1 fall into one
group.  g grows with the size of the sets, which bounds the combinations of
very long documents.

Equal sets are one class.  A signature's classes are first compared with one
of them only, its pivot (linear, however many share it).  What this links is
contracted.  Small groups whose classes are still in different components are
compared pair by pair.  In large ones the combinations are extended.  The
tokens that most sets of a pivot have are its center.  Sets near the center
are alike for sure and are linked through the nearest one; two other sets that
are alike differ from the center in the same tokens for a good part, so the
tokens in which a set differs from it are indexed in turn, singly where few
sets of the pivot have them, in combinations of up to four where many do.
A set that shares little with its pivot, but met it through some common
combination, goes before that unless its prefix outside the pivot meets others'.
Before that, differences are dropped that no other set has which could be alike,
judged by how many differences are left to either, until few more go; a pivot's
sets are looked through in one task, or in rounds of many if there are too many.
No link that decides a component is lost and no group is expanded into all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .store import commonest, discard, free_prefix, materialize, named
from .words import mixed, raw, shingle_sets, slices

#: A token in more documents than this, as far as tasks have counted, is frequent.
FREQUENT = 4
#: The frequent class holds at most so many tokens, the commonest (2 MB when sent to executors).
FREQUENT_MOST = 1 << 18
#: A task reports a token that so many documents share among those it counts together.
SEEN_TOGETHER = 2
COUNT_TOKENS = 1 << 21
SALTS = 64
#: A token of the rare class by which more sets than this are indexed is combined like a frequent one.
RARE = 4
#: Rare tokens that a pair must share in its prefixes unless it shares a combination of frequent ones.
RARE_SHARED = 3
#: Groups of so many classes at most are compared pair by pair; in larger ones differences from a pivot are indexed.
SMALL = 8
#: A set that has much outside its pivot must share one token there in so many of its size with another, three at least.
OUTSIDE = 16
#: Differences that so many sets of a pivot still have at most are indexed singly.
FEW = 64
#: The sets that have a difference are told apart by so many hash classes of their components, and by their excess
#: in steps of so large a part of what two similar sets may differ in.
PLACES = 8
STEP = 0.5
#: Dropping differences goes on while a round drops at least this share of them.
WORTHWHILE = 0.1
#: The differences that sets of one pivot share are looked through in one task if they and the sets are at most so many.
TOGETHER = 1 << 16
#: Levels of the second index: groups of tokens, and tokens in a combination.  A pair that shares
#: groups * (tokens - 1) + 1 differences shares a combination, or a difference that few sets have.
LEVELS = ((1, 1), (2, 2), (3, 3), (5, 4))
#: A pivot of so many tokens has the groups of `LEVELS`, a larger one in proportion more.
LEVEL_TOKENS = 128


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def frequent_tokens(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """The frequent class: sorted token hashes, at most `FREQUENT_MOST`.

    Which tokens are in it decides the cost of the join only, never its
    result, so counting may be rough; it covers all documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def report() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= SEEN_TOGETHER
            return pa.RecordBatch.from_arrays([pa.array(_signed(tokens[often])), pa.array(n[often])], names=["token", "n"])

        for batch in batches:
            for part in slices(batch, "__text", 1 << 20):
                held += shingle_sets(raw(part.column(0)), width)
                size = sum(len(x) for x in held)
                if size >= COUNT_TOKENS:
                    yield report()
                    held, size = [], 0
        if size:
            yield report()

    counts = docs.select(named(text).alias("__text")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = commonest(materialize(counts.where(F.col("n") > FREQUENT), "nj-counts"), "n", FREQUENT_MOST).select("token").toPandas()
    return np.sort(top["token"].to_numpy(dtype=np.int64).view(np.uint64))


def _groups(n: int, percent: int) -> list[int]:
    """Into how many groups frequent tokens are split, for each class of sizes that a partner of ``n`` tokens may have."""
    classes = range((-(-percent * n // 100)).bit_length(), (n * 100 // percent).bit_length() + 1)
    return sorted({max(8, (1 << c) >> 7) for c in classes})


def prefix_tokens(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The prefix of a set of tokens (sorted): its rare and its frequent tokens, and up to where all its rare tokens are in."""
    n = len(tokens)
    common = np.zeros(n, dtype=bool)
    if len(frequent) and n:
        common = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
    rare = tokens[~common]
    prefix = min(n, n + percent * n // -100 + _groups(n, percent)[-1] + RARE_SHARED)
    limit = int(rare[prefix - 1] >> np.uint64(1)) if len(rare) > prefix else (1 << 63) - 1
    return rare[:prefix], tokens[common][: max(0, prefix - len(rare))], limit


def signatures(n: int, rare: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """What a set of ``n`` tokens is indexed by: even numbers for single tokens, odd ones for combinations."""
    found = []
    for groups in _groups(n, percent):
        if -(-percent * n // 100) < groups + RARE_SHARED:  # too small to be sure of so many: any shared token makes a pair
            found += [mixed(rare), mixed(common)]
        place = common % np.uint64(groups)
        order = np.argsort(place, kind="stable")
        own, place = common[order], place[order]
        i, j = np.triu_indices(len(own), 1) if len(own) < 64 else _within(place)
        same = place[i] == place[j]
        found.append(mixed(mixed(np.minimum(own[i], own[j])[same]) + np.maximum(own[i], own[j])[same]))
    return np.concatenate([np.unique(rare & ~np.uint64(1)), np.unique(np.concatenate(found) | np.uint64(1))])


def _within(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs inside each run of equal numbers."""
    edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
    pairs = [np.triu_indices(b - a, 1) for a, b in zip(edges[:-1], edges[1:])]
    return tuple(np.concatenate([p[k] + a for p, a in zip(pairs, edges)]) for k in (0, 1))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(np.concatenate(arrays))))


def parity(tokens: np.ndarray) -> np.ndarray:
    """256 bits, as four numbers: the parity of the tokens that fall on each.  Two sets differ in as many tokens as bits, or more."""
    return np.packbits((np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)


BITS = ["b0", "b1", "b2", "b3"]


def _prefixes(docs: DataFrame, text: str, id_col: str, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(id, n, key: digest of the set, upto, its parity bits, rare, common) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    names = ["id", "n", "key", "upto", *BITS, "rare", "common"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", 1 << 20):
                sets = shingle_sets(raw(part.column(1)), width)
                rare, common, upto = zip(*(prefix_tokens(s, sent.value, percent) if len(s) else (s, s, 0) for s in sets))
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(upto, pa.int64()), *(pa.array(b, pa.int64()) for b in zip(*(parity(s) for s in sets))), _lists(rare), _lists(common)], names=names)

    return docs.select(named(id_col).cast("long").alias("id"), named(text).alias("__text")).mapInArrow(run, "id long, n long, key binary, upto long, b0 long, b1 long, b2 long, b3 long, rare array<long>, common array<long>")


def _combined(classes: DataFrame, percent: int) -> DataFrame:
    """(rep, n, upto, own, sigs) from (rep, n, upto, own, rare, common)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rare, common = ([np.array(x or (), dtype=np.int64).view(np.uint64) for x in batch.column(c).to_pylist()] for c in (4, 5))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], _lists([signatures(n, r, c, percent) for n, r, c in zip(batch.column(1).to_pylist(), rare, common)])], names=["rep", "n", "upto", "own", "sigs"])

    return classes.select("rep", "n", "upto", "own", "rare", "common").mapInArrow(run, "rep long, n long, upto long, own long, sigs array<long>")


def _sets(docs: DataFrame, text: str, id_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """Shingle sets (id, tokens as sorted 64-bit hashes) of the documents in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in shingle_sets(raw(part.column(1)), width)], pa.binary())], names=["id", "tokens"])

    texts = docs.select(named(id_col).cast("long").alias("id"), named(text).alias("__text")).join(wanted, "id", "left_semi")
    return texts.mapInArrow(run, "id long, tokens binary")


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with the token sets x of a and y of b.

    One a may stand in a good part of all pairs, so its set goes to many tasks: one copy for each salt.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    first = salted.select("a", "salt").distinct().join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")).hint("merge"), "a")
    return salted.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")).hint("merge"), "b").join(first.hint("merge"), ["a", "salt"]).drop("salt")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for x, y in zip(a, b):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _beside(pairs, sets).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def excess(d: int, n: int, percent: int) -> int:
    """By how much the ``d`` differences of a set of ``n`` tokens from the center exceed its share of what two similar sets may differ in.

    With c = (100 - percent) / (100 + percent), sets x and y are alike if they
    differ in c (n_x + n_y) tokens at most; this is (100 + percent) (d - c n).
    Two sets whose excesses add up to 0 or less are alike.
    """
    return d * (100 + percent) - n * (100 - percent)


def shared_differences(d: int, n: int, least: int, percent: int) -> int:
    """How many of its ``d`` differences a set shares at least with any similar set, if their excesses add up to more than 0.

    The shared ones are half of the sum of the excesses; ``least`` is the
    smallest excess that such a set may have.
    """
    # A partner has n * 100 / percent tokens at most, which bounds in how many tokens the two differ.
    return max(1, d - n * (100 - percent) // percent, -(-(excess(d, n, percent) + least) // (2 * (100 + percent))))


def outside_prefix(tokens: np.ndarray, pivot: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The first tokens of a set that its pivot lacks, and how many of them a similar set has among its own first ones.

    A set of n tokens has at most n (100 - percent) / 100 that a similar set
    lacks, so of its tokens outside the pivot the first k that both have come
    among so many and k more in either set.  The size of a similar set is no
    less than percent / 100 of n, which k must allow for.  The number is 0 if
    the set has too few tokens outside to be sure of so many.
    """
    n = len(tokens)
    outside = np.setdiff1d(tokens, pivot, assume_unique=True)
    lost = n * (100 - percent) // 100
    need = max(3, -(-percent * n // 100) // OUTSIDE)
    return outside[: lost + max(3, n // OUTSIDE)], need if len(outside) >= lost + need else 0


def _differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a: pivot, b, c, n, np, parity bits of b, need and first: `outside_prefix`, tokens: in which they differ) from (a, b, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            numbers = [pa.array([len(f[k]) for f in found], pa.int64()) for k in (1, 0)]
            bits = [pa.array(b, pa.int64()) for b in zip(*(parity(f[1]) for f in found))]
            first, need = zip(*(outside_prefix(y, x, percent) for x, y in found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *numbers, *bits, pa.array(need, pa.int64()), _lists(first), _lists([np.setxor1d(*f, assume_unique=True) for f in found])], names=["a", "b", "c", "n", "np", *BITS, "need", "first", "tokens"])

    return _beside(members, sets).select("a", "b", "c", "x", "y").mapInArrow(run, "a long, b long, c long, n long, np long, b0 long, b1 long, b2 long, b3 long, need long, first array<long>, tokens array<long>")


def _not_alone(table: DataFrame) -> DataFrame:
    """The rows of `_differences` whose sets may be similar to a set of another component of their pivot, as far as what lies outside the pivot tells."""
    far = table.where("need > 0").select("a").distinct()
    first = table.join(far.hint("merge"), "a", "left_semi").select("a", "b", "c", "need", F.explode("first").alias("token"))
    met = first.groupBy("a", "token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("a", "token")
    enough = first.where("need > 0").join(met.hint("merge"), ["a", "token"]).groupBy("a", "b", "need").agg(F.count(F.lit(1)).alias("met")).where("met >= need").select("a", "b")
    return table.where("need = 0").unionAll(table.where("need > 0").join(enough.hint("merge"), ["a", "b"], "left_semi")).drop("need", "first")


def _centered(table: DataFrame) -> DataFrame:
    """(a, b, c, n, np, parity bits, d, shared) from `_differences`: the number of differences from the center, and those that other sets of the pivot have too, as (size: number of sets, token)."""
    tokens = table.select("a", "b", F.explode("tokens").alias("token"))
    sizes = materialize(tokens.groupBy("a", "token").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "nj-sizes")
    shared = tokens.join(sizes.hint("merge"), ["a", "token"]).groupBy("a", "b").agg(F.collect_list(F.struct("size", "token")).alias("shared"))
    # Where more than half of the sets differ from the pivot in a token, the center does; there are 2 * average differences at most.
    every = table.groupBy("a").agg(F.count(F.lit(1)).alias("members"))
    flipped = sizes.join(every, "a").where("2 * size > members").groupBy("a").agg(F.first("members").alias("members"), F.collect_list(F.struct("size", "token")).alias("flipped"))
    salted = table.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    salts = salted.select("a", "salt").distinct().join(flipped.hint("merge"), "a")
    rows = salted.join(salts.hint("merge"), ["a", "salt"], "left").join(shared.hint("merge"), ["a", "b"], "left")
    lacks = F.filter("flipped", lambda f: ~F.array_contains(F.col("shared.token"), f["token"]))
    turned = F.transform(F.coalesce("lacks", F.array().cast("array<struct<size:long,token:long>>")), lambda f: F.struct((F.col("members") - f["size"]).alias("size"), f["token"].alias("token")))
    stays = F.coalesce(F.filter("shared", lambda s: F.col("members").isNull() | (2 * s["size"] <= F.col("members"))), F.array().cast("array<struct<size:long,token:long>>"))
    rows = rows.withColumn("shared", F.coalesce("shared", F.array().cast("array<struct<size:long,token:long>>"))).withColumn("lacks", lacks)
    rows = rows.select("a", "b", "c", "n", "np", *BITS, (F.size("tokens") - F.size("shared")).alias("alone"), stays.alias("stays"), turned.alias("turned"))
    return rows.select("a", "b", "c", "n", "np", *BITS, (F.col("alone") + F.size("stays") + F.size("turned")).cast("long").alias("d"), F.concat("stays", F.filter("turned", lambda t: t["size"] > 1)).alias("shared"))


def difference_signatures(d: int, floor: int, n_pivot: int, shared: list[tuple[int, int]]) -> np.ndarray:
    """What a set is indexed by below its pivot.

    Of its ``d`` differences, those that other sets of the pivot have too are
    given as (sets, token) in ``shared``, as far as a similar set may have them;
    the order of all differences is by the number of sets, then by token.  Two sets meet at the level of the one
    with the larger ``floor``, so each takes part in its own level and those above.
    """
    shared = sorted(shared)
    alone = d - len(shared)
    scale = max(1, n_pivot // LEVEL_TOKENS)
    levels = [(1, 1) if k == 1 else (g * scale, k) for g, k in LEVELS]
    needs = [g * (k - 1) + 1 for g, k in levels]
    own = max(k for k, need in enumerate(needs) if need <= floor)
    found = []
    for (groups, width), need in list(zip(levels, needs))[own:]:
        prefix = shared[: max(0, min(d, d - floor + need) - alone)]
        few = np.array([t for size, t in prefix if size <= FEW or width == 1], dtype=np.int64).view(np.uint64)
        found.append(few & ~np.uint64(1))
        if width > 1:
            many = np.array([t for size, t in prefix if size > FEW], dtype=np.int64).view(np.uint64)
            place = many % np.uint64(groups)
            for g in np.unique(place):
                tokens = many[place == g]
                if len(tokens) >= width:
                    at = np.array(list(combinations(range(len(tokens)), width)))
                    acc = np.full(len(at), width, dtype=np.uint64)
                    for k in range(width):
                        acc = mixed(acc + np.sort(tokens)[at[:, k]])
                    found.append(acc | np.uint64(1))
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)


def _useful(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, least, shared) of the sets that may have a link yet unknown; ``rows`` is (a: pivot, b, c: component, apart, n, d, np, over: excess, shared).

    Sets x and y are alike if twice their shared differences, times
    100 + percent, reach the sum of their excesses.  So a difference of x is of
    use only if another set y has it, of another component and one of the two
    apart, such that the useful differences of either alone would suffice.
    ``shared`` holds the useful differences as (sets to which it is of use,
    token), ``least`` is the smallest excess of such a y.  A set with too few
    of them is dropped, which makes differences of other sets useless in turn.
    """
    double = 2 * (100 + percent)
    w = Window.partitionBy("a", "b")
    tokens = rows.select("a", "b", "c", "apart", "n", "d", "np", "over", F.size("shared").cast("long").alias("m"), F.explode("shared.token").alias("token"))
    tokens = materialize(tokens.withColumn("least", F.lit(None).cast("long")), "nj-useful-0")
    left = tokens.count()
    while left:
        spare = double * F.col("m") - F.col("over")
        place = [F.pmod(F.xxhash64("c"), F.lit(PLACES)).alias("place"), F.floor(F.col("over") / F.greatest(F.lit(1.0), F.col("np") * (100 - percent) * STEP)).alias("step")]
        held = tokens.groupBy("a", "token", "apart", *place).agg(F.max(spare).alias("spare"), F.min("over").alias("over"), F.min("c").alias("lo"), F.max("c").alias("hi"))
        held = held.groupBy("a", "token").agg(F.collect_list(F.struct("apart", "spare", "over", "lo", "hi")).alias("held"))
        may = lambda h: ((h["lo"] != F.col("c")) | (h["hi"] != F.col("c"))) & (F.col("apart") | h["apart"]) & (h["spare"] >= F.col("over")) & (h["over"] <= spare)
        found = tokens.drop("least").join(held.hint("merge"), ["a", "token"]).withColumn("least", F.array_min(F.transform(F.filter("held", may), lambda h: h["over"])))
        found = found.drop("held").where("least is not null").withColumns({"m": F.count(F.lit(1)).over(w), "least": F.min("least").over(w)})
        # `shared_differences` as a column.
        floor = F.greatest(F.lit(1), F.expr(f"d - n * {100 - percent} div {percent}"), F.expr(f"(over + least + {double - 1}) div {double}"))
        before, old = left, tokens
        tokens = materialize(found.where(F.col("m") >= floor).select(*tokens.columns), "nj-useful")
        discard(old)
        left = tokens.count()
        if left >= (1 - WORTHWHILE) * before:
            break
    sizes = tokens.groupBy("a", "token").agg(F.count(F.lit(1)).alias("size"))
    return tokens.join(sizes.hint("merge"), ["a", "token"]).groupBy("a", "b").agg(F.min("least").alias("least"), F.collect_list(F.struct("size", "token")).alias("shared"))


def useful_differences(row: np.ndarray, token: np.ndarray, c: np.ndarray, apart: np.ndarray, n: np.ndarray, d: np.ndarray, over: np.ndarray, n_pivot: int, percent: int, worthwhile: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_useful` for the sets of one pivot: the rows and tokens that stay of the shared differences (row: number of the set, token), and ``least`` by set."""
    double, most = 2 * (100 + percent), np.iinfo(np.int64).max
    place = mixed(c.view(np.uint64)) % np.uint64(PLACES)
    step = np.floor(over / max(1.0, n_pivot * (100 - percent) * STEP))
    least = np.full(len(c), most)
    while len(row):
        before = len(row)
        spare = double * np.bincount(row, minlength=len(c)) - over
        order = np.lexsort((step[row], place[row], apart[row], token))
        by, sets = token[order], row[order]
        changes = [x[1:] != x[:-1] for x in (by, apart[sets], place[sets], step[sets])]
        starts = np.flatnonzero(np.concatenate([[True], np.any(changes, axis=0)]))
        held = by[starts]
        h_apart, h_spare, h_over = apart[sets[starts]], np.maximum.reduceat(spare[sets], starts), np.minimum.reduceat(over[sets], starts)
        lo, hi = np.minimum.reduceat(c[sets], starts), np.maximum.reduceat(c[sets], starts)
        first = np.searchsorted(held, token)
        classes = np.searchsorted(held, token, side="right") - first
        found = np.full(len(row), most)
        for k in range(int(classes.max())):
            h = first + np.minimum(k, classes - 1)  # the last class may come again
            may = ((lo[h] != c[row]) | (hi[h] != c[row])) & (apart[row] | h_apart[h]) & (h_spare[h] >= over[row]) & (h_over[h] <= spare[row])
            found = np.where(may, np.minimum(found, h_over[h]), found)
        use = found < most
        row, token = row[use], token[use]
        least = np.full(len(c), most)
        np.minimum.at(least, row, found[use])
        some = least < most
        floor = np.maximum(np.maximum(1, d - n * (100 - percent) // percent), -(-(over + np.where(some, least, 0)) // double))
        stays = some & (np.bincount(row, minlength=len(c)) >= floor)
        row, token = row[stays[row]], token[stays[row]]
        if len(row) >= (1 - worthwhile) * before:
            break
    return row, token, least


#: What is known of a set of a pivot: its component (the nearest set's, if it is alike that for sure), whether it is
#: apart, the nearest set if it is alike that for sure, and by what it is indexed.
SEEN = "a long, b long, c long, apart boolean, n long, d long, b0 long, b1 long, b2 long, b3 long, near long, sigs array<long>"


def _by_pivot(rows: DataFrame, percent: int) -> DataFrame:
    """`SEEN` from `_centered`, a task for each pivot."""
    worthwhile = WORTHWHILE

    def run(found: pa.Table) -> pa.Table:
        found = found.combine_chunks()
        b, c, n, d = (found.column(k).to_numpy() for k in ("b", "c", "n", "d"))
        n_pivot = found.column("np")[0].as_py()
        over = excess(d, n, percent)
        k = np.lexsort((c, b, over))[0]
        apart = over + over[k] > 0
        c = np.where(apart, c, c[k])
        near = [None if away or x == b[k] else b[k] for away, x in zip(apart, b)]
        shared = [[s["token"] for s in x] for x in found.column("shared").to_pylist()]
        row = np.repeat(np.arange(len(b)), [len(x) for x in shared])
        token = np.array([t for x in shared for t in x], dtype=np.int64)
        row, token, least = useful_differences(row, token, c, apart, n, d, over, n_pivot, percent, worthwhile)
        _, which, sizes = np.unique(token, return_inverse=True, return_counts=True)
        left: list[list[tuple[int, int]]] = [[] for _ in b]
        for x, size, t in zip(row.tolist(), sizes[which].tolist(), token.tolist()):
            left[x].append((size, t))
        sigs = [difference_signatures(dx, shared_differences(dx, nx, lx, percent), n_pivot, x) if x else np.empty(0, np.uint64) for dx, nx, lx, x in zip(d.tolist(), n.tolist(), least.tolist(), left)]
        columns = [found.column("a"), found.column("b"), pa.array(c), pa.array(apart), found.column("n"), found.column("d"), *(found.column(k) for k in BITS), pa.array(near, pa.int64()), _lists(sigs)]
        return pa.table(columns, names=["a", "b", "c", "apart", "n", "d", *BITS, "near", "sigs"])

    return rows.groupBy("a").applyInArrow(run, SEEN)


def _in_rounds(rows: DataFrame, percent: int) -> DataFrame:
    """`SEEN` from `_centered`, the sets of a pivot in many tasks."""
    over = F.col("d") * (100 + percent) - F.col("n") * (100 - percent)
    nearest = rows.groupBy("a").agg(F.min(F.struct(over.alias("over"), F.col("b").alias("b"), F.col("c").alias("c"))).alias("nearest"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    nearest = salted.select("a", "salt").distinct().join(nearest.hint("merge"), "a")
    rows = salted.join(nearest.hint("merge"), ["a", "salt"]).drop("salt").withColumn("apart", over + F.col("nearest.over") > 0)
    near = F.when(~F.col("apart") & (F.col("b") != F.col("nearest.b")), F.col("nearest.b"))
    rows = rows.select("a", "b", F.when(F.col("apart"), F.col("c")).otherwise(F.col("nearest.c")).alias("c"), "apart", "n", "d", *BITS, near.alias("near"), "np", over.alias("over"), "shared")
    rows = rows.drop("over", "shared").join(_useful(rows, percent).hint("merge"), ["a", "b"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = []
            for n, d, n_pivot, least, found in zip(*(batch.column(k).to_pylist() for k in ("n", "d", "np", "least", "shared"))):
                if found:
                    floor = shared_differences(d, n, least, percent)
                    sigs.append(difference_signatures(d, floor, n_pivot, [(s["size"], s["token"]) for s in found]))
                else:
                    sigs.append(np.empty(0, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:11], _lists(sigs)], names=["a", "b", "c", "apart", "n", "d", *BITS, "near", "sigs"])

    return rows.mapInArrow(run, SEEN)


def _difference_pairs(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Certain links and candidate pairs (a, b), a < b, of sets of one pivot; ``members`` is (a: pivot, b, c: component)."""
    every = materialize(_differences(members, sets, percent), "nj-differ")
    table = materialize(_not_alone(every), "nj-not-alone")
    discard(every)
    rows = materialize(_centered(table), "nj-centered")
    large = materialize(rows.groupBy("a").agg(F.sum(F.size("shared") + 1).alias("size")).where(F.col("size") > TOGETHER).select("a"), "nj-large")
    if large.isEmpty():
        seen = _by_pivot(rows, percent)
    else:
        seen = _by_pivot(rows.join(large.hint("merge"), "a", "left_anti"), percent).unionAll(_in_rounds(rows.join(large.hint("merge"), "a", "left_semi"), percent))
    seen = materialize(seen, "nj-seen")
    sure = seen.where("near is not null").select(F.least("b", "near").alias("a"), F.greatest("b", "near").alias("b"))
    rows = seen.select("a", "b", "c", "apart", "n", "d", *BITS, F.explode("sigs").alias("sig"))
    rows = materialize(rows, "nj-below")
    some = rows.groupBy("a", "sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("apart").alias("any")).where("lo < hi and any").select("a", "sig")
    below, rows = rows, materialize(rows.join(some.hint("merge"), ["a", "sig"]), "nj-below-open")
    discard(below)
    x = rows.where("apart").select("a", "sig", *[F.col(k).alias(k + "x") for k in ("b", "c", "n", "d", *BITS)])
    y = rows.select("a", "sig", *[F.col(k).alias(k + "y") for k in ("b", "c", "n", "d", "apart", *BITS)])
    once = ~F.col("aparty") | (F.col("bx") < F.col("by"))
    apart_bits = sum((F.bit_count(F.col(k + "x").bitwiseXOR(F.col(k + "y"))) for k in BITS), F.lit(0))
    close = F.greatest(F.abs(F.col("dx") - F.col("dy")), apart_bits) * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent)
    pairs = x.join(y.hint("merge"), ["a", "sig"]).where((F.col("cx") != F.col("cy")) & once & close)
    return sure, pairs.select(F.least("bx", "by").alias("a"), F.greatest("bx", "by").alias("b")).distinct()


def ngram_join(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``.

    Documents are linked when the Jaccard similarity of their sets of
    ``width``-word shingles (A-Z lowered) is at least ``percent`` / 100.
    ``component_id`` is the smallest id reachable by links.
    Fewer words than ``width`` make one shingle; null
    and empty texts have none and link with nothing.  Rows that repeat an id
    are one document.  A null id keeps its row, is alone, and its component is
    null.  The id must be a whole number; other columns are not read.
    """
    frequent = frequent_tokens(docs, text, width)
    rows = materialize(_prefixes(docs, text, id_col, width, percent, frequent), "nj-rows")
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    linked = rows.where("n > 0 and id is not null")
    classes = linked.groupBy("key").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "upto", *BITS, "rare", "common")])
    classes = materialize(classes, "nj-classes")
    # Tokens of the rare class by the number of sets indexed by them: alone, rare indeed, or frequent after all.
    met = classes.select("rep", F.explode("rare").alias("token")).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("size > 1")
    met = met.groupBy("rep").agg(
        F.count(F.lit(1)).alias("met"),
        F.collect_list(F.when(F.col("size") <= RARE, F.col("token"))).alias("rare"),
        F.collect_list(F.when(F.col("size") > RARE, F.col("token"))).alias("more"),
    )
    indexed = classes.select("rep", "n", "upto", F.size("rare").cast("long").alias("indexed"), "common").join(met.hint("merge"), "rep", "left").withColumn("common", F.concat("common", F.coalesce("more", F.array().cast("array<long>"))))
    # No other set is indexed by such a token, so none whose rare tokens are indexed that far has it.
    own = F.col("indexed") - F.coalesce("met", F.lit(0))
    combined = materialize(_combined(indexed.withColumn("own", own), percent), "nj-sigs")
    sigs = combined.select("rep", "n", "upto", "own", F.explode("sigs").alias("sig"))
    # The set with the fewest tokens of its own is the likeliest to be what the others were made from.  A signature
    # may be in a good part of all sets: it is aggregated before it is shuffled, and joins can split it.
    about = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("own", "rep", "n", "upto")).alias("first")).where("size > 1")
    groups = materialize(sigs.join(about.hint("merge"), "sig"), "nj-groups")
    discard(combined)

    def near(n: tuple[str, str], upto: tuple[str, str], own: tuple[str, str]):
        """Whether sizes, less the tokens that only one of two sets can have, allow the similarity."""
        most = [F.col(n[k]) - F.when(F.col(upto[k]) <= F.col(upto[1 - k]), F.col(own[k])).otherwise(0) for k in (0, 1)]
        both = F.least(*most)
        return 100 * both >= percent * (F.col(n[0]) + F.col(n[1]) - both)

    def candidates(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that share a combination or enough rare tokens, from one row for each shared signature."""
        counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max(F.col("sig").bitwiseAND(1)).alias("combined"))
        return counted.where((F.col("combined") == 1) | (F.col("shared") >= RARE_SHARED)).select("a", "b")

    def docs_sets(pairs: DataFrame, how: str | None = None) -> DataFrame:
        ends = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
        return materialize(_sets(docs, text, id_col, width, ends.hint(how) if how else ends).dropDuplicates(["id"]), "nj-sets")

    star = groups.where("rep != first.rep").select("sig", F.col("first.rep").alias("a"), F.col("rep").alias("b"), *[F.col(f"first.{c}").alias(c + "a") for c in ("n", "upto", "own")], *[F.col(c).alias(c + "b") for c in ("n", "upto", "own")])
    star = star.where(near(("na", "nb"), ("uptoa", "uptob"), ("owna", "ownb")))
    star = star.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    star = materialize(candidates(star), "nj-star")
    sets = docs_sets(star, "merge")
    links = materialize(_verified(star, sets, percent), "nj-links")
    discard(sets)
    label = components(links)
    about = classes.select("rep", *BITS).join(label.hint("merge"), F.col("rep") == F.col("node"), "left").select("rep", *BITS, F.coalesce("component", "rep").alias("c"))
    marked = materialize(groups.join(about.hint("merge"), "rep"), "nj-marked")
    discard(groups)
    several = marked.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("sig")
    apart = materialize(marked.join(several.hint("merge"), "sig"), "nj-apart")
    discard(marked)
    few = apart.where(F.col("size") <= SMALL)
    x, y = (few.select("sig", *[F.col(c).alias(c + s) for c in ("rep", "n", "upto", "own", "c", *BITS)]) for s in "xy")
    apart_bits = sum((F.bit_count(F.col(b + "x").bitwiseXOR(F.col(b + "y"))) for b in BITS), F.lit(0))
    alike = apart_bits * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent)
    cross = x.join(y.hint("merge"), "sig").where((F.col("repx") < F.col("repy")) & (F.col("cx") != F.col("cy")) & alike & near(("nx", "ny"), ("uptox", "uptoy"), ("ownx", "owny"))).select("sig", F.col("repx").alias("a"), F.col("repy").alias("b"))
    cross = materialize(candidates(cross).join(star.hint("merge"), ["a", "b"], "left_anti"), "nj-cross")
    members = apart.where(F.col("size") > SMALL).select(F.col("first.rep").alias("a"), F.col("rep").alias("b"), "c").where("a != b").distinct()
    members = materialize(members, "nj-members")
    discard(apart, star)
    sets = docs_sets(cross.unionAll(members.select("a", "b")), "merge")
    sure, below = _difference_pairs(members, sets, percent)
    pairs = materialize(cross.unionAll(below).distinct(), "nj-pairs")
    more = materialize(_verified(pairs, sets, percent).unionAll(sure), "nj-more")
    discard(cross, members, pairs, sets)
    final = components(links.unionAll(more))
    of_class = classes.select("key", "rep").join(final.hint("merge"), classes["rep"] == final["node"], "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    # The rows of a class meet its component salt by salt, so a class of a third of all rows is spread.
    salts = linked.select("key", salt.alias("salt")).distinct().join(of_class.hint("merge"), "key")
    salted = rows.withColumn("salt", salt)
    found = salted.join(salts.hint("merge"), ["key", "salt"], "left").select("id", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one_per_component(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that lead their component (its smallest id), and those without words or id; columns as they came."""
    found = ngram_join(docs, text, id_col, width, percent)
    gone = free_prefix(docs.columns, "__nj_") + "gone"
    others = found.where(F.col("component_id") != named(id_col)).select(named(id_col).alias(gone)).distinct()
    return docs.join(others.hint("merge"), named(id_col) == F.col(gone), "left_anti")
