"""Hidden Markov language model: Baum-Welch over all training texts, exact likelihoods by the scaled forward recursion.

The states emit symbols: the commonest words have one each, the end of a text
has one, and all other words share a symbol by the end of their spelling.
What a word of such a class is worth inside it, its smoothed share of the
class, does not depend on the state, so a text's probability is the forward
probability of its symbols times those shares.  The first needs only tables
of fixed size on the executors; the second comes from a join of rare words
with the counts of all training words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import commonest, materialize, named
from .words import encoded, slices

STATES = 8
#: A word has a symbol of its own if it is at least one in so many training tokens, so at most so many words have.
VOCABULARY = 49_152
#: Words whose counts are sent to executors, the commonest (about 6 MB there); it decides where counts are looked up, never a result.
COUNTED = 200_000
CLASSES = 256
ROUNDS = 5
#: Training cuts texts of more than ``WHOLE`` tokens into runs of ``RUN``; the probabilities before and after each run are
#: those of the whole text.  ``SLICE * RUN`` tokens are worked out at once, of texts of similar length out of ``POOL`` as many.
RUN, SLICE, WHOLE, POOL = 128, 4096, 8192, 8
SMOOTHING = 50.0
SEED = 7
END = 0


def class_of(word: bytes) -> int:
    """Class of a word outside the vocabulary, by its last three bytes."""
    return xxhash.xxh3_64_intdigest(word[-3:]) % CLASSES


def classes(words: pa.Array) -> np.ndarray:
    """`class_of` for each word; each ending is hashed once."""
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    words = words.cast(pa.string())
    _, offsets, data = words.buffers()
    until = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    text = np.frombuffer(data, dtype=np.uint8) if data and data.size else np.zeros(1, dtype=np.uint8)
    size = np.minimum(np.diff(until), 3)
    key = size << 24
    for k in range(3):
        key |= np.where(size > k, text[np.maximum(until[1:] - 1 - k, 0)].astype(np.int64) << (8 * k), 0)
    endings, at = np.unique(key, return_inverse=True)
    return np.array([class_of(int(e & 0xFFFFFF).to_bytes(3)[3 - (int(e) >> 24) :]) for e in endings], dtype=np.int64)[at]


class Vocabulary:
    """Symbols and counts of the commonest training words; the first ``own`` of them have symbols of their own."""

    def __init__(self, words: pa.Array, counts: np.ndarray, own: int):
        self.words = words
        self.symbol = np.concatenate([1 + np.arange(own), 1 + VOCABULARY + classes(words[own:]), [0]])
        self.count = np.concatenate([counts, [-1]])

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and training counts of words; count -1 if it must be looked up."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), len(self.words)).to_numpy()
        symbol, count = self.symbol[at], self.count[at]
        other = np.flatnonzero(count < 0)
        symbol[other] = 1 + VOCABULARY + classes(words.take(pa.array(other)))
        return symbol, count


SYMBOLS = 1 + VOCABULARY + CLASSES


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all of ``docs`` (text); words are folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

        for batch in batches:
            for part in slices(batch, "text"):
                code, _, words = encoded(part.column(0))
                counts = np.bincount(code, minlength=len(words))
                held.append(pa.table({"word": words.cast(pa.string()), "c": counts}).filter(pa.array(counts > 0)))
                if sum(t.num_rows for t in held) > 800_000:
                    held = [merged()]
                    if held[0].num_rows > 400_000:
                        yield from held.pop().to_batches()
        if held:
            yield from merged().to_batches()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def symbols(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(rid, id, held_out, n_tokens, known, head, shares, symbols, tail) for every row of ``docs`` (id, held_out, text).

    ``known`` and ``head`` count and sum log10(c + 1) over the words whose
    counts are at hand; ``shares`` holds those of them outside the vocabulary
    as class and log10(c + 1) summed; ``tail`` has the other words and how
    often each occurs.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    item = pa.struct([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                code, count, words = encoded(part.column(2))
                words = words.cast(pa.string())
                symbol, c = sent.value.look_up(words)
                log = np.log10(np.maximum(c, 0) + 1.0)
                text = np.repeat(np.arange(len(count)), count)
                seq = np.full(len(code) + len(count), END, dtype="<u2")
                seq[np.arange(len(code)) + text] = symbol[code]
                until = np.concatenate([[0], np.cumsum(count + 1)])
                far = np.flatnonzero(c[code] < 0)
                place, n = np.unique(text[far] * max(len(words), 1) + code[far], return_counts=True)
                of, word = np.divmod(place, max(len(words), 1))
                tail = pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array(n)], fields=list(item))
                cols = [
                    pa.array(np.arange(rid, rid + len(count))), pa.array(count + 1), pa.array(count - np.bincount(text[far], minlength=len(count))),
                    pa.array(np.bincount(text, weights=log[code], minlength=len(count))), pa.array(np.bincount(text, weights=(log * (symbol > VOCABULARY))[code], minlength=len(count))),
                    pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer((2 * until).astype(np.int32)), pa.py_buffer(seq)]),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(count) + 1)), pa.int32()), tail),
                ]
                rid += len(count)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["id", "held_out", "rid", "n_tokens", "known", "head", "rare", "symbols", "tail"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "held_out", "text").mapInArrow(run, f"id {kind}, held_out boolean, rid long, n_tokens long, known long, head double, rare double, symbols binary, tail array<struct<word:string,n:long>>")


class Hmm:
    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit  # emit: symbols by states

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """Exact log10 probability of each sequence of symbols: forward, scaled as it goes, many texts a token at a time."""
        lengths = np.array([len(x) for x in texts], dtype=np.int64)
        out = np.empty(len(texts))
        if not len(texts):
            return out
        flat, start = np.concatenate(texts), np.cumsum(lengths) - lengths
        step, emit = np.ascontiguousarray(self.step.T), np.ascontiguousarray(self.emit.T)
        for at in _slices(lengths):
            symbols, base, alive = _by_position(flat, start[at], lengths[at])
            total, alpha = np.zeros(len(at)), np.empty((len(step), len(at)))
            ahead = np.repeat(self.start[:, None], len(at), axis=1)
            for t, n in enumerate(alive[:-1]):
                if t:
                    np.matmul(step, alpha[:, :n], out=ahead[:, :n])
                a = np.multiply(ahead[:, :n], emit.take(symbols[base[t] : base[t + 1]], axis=1), out=alpha[:, :n])
                if t % 4 == 3 or alive[t + 1] < n:
                    scale = a.sum(axis=0)
                    a /= scale
                    total[:n] += np.log10(scale)
            out[at] = total
        return out

    def expect(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts over whole texts (arrays of symbols, none empty): first states, steps, emissions by symbol.

        A text of more than ``WHOLE`` tokens is cut into runs.  The product of
        a run's matrices carries the forward probabilities over it from its
        beginning to its end, and the backward ones the other way, so one pass
        over the runs of a text gives both at every cut; then all runs and all
        other texts are worked out side by side.
        """
        k = len(self.start)
        size = np.array([len(x) for x in texts], dtype=np.int64)
        count = np.where(size > WHOLE, -(-size // RUN), 1)
        last = np.cumsum(count) - 1
        head = last - count + 1
        place = np.arange(int(count.sum())) - np.repeat(head, count)  # of each run in its text
        length = np.where(np.repeat(count > 1, count), RUN, np.repeat(size, count))
        length[last] = size - (count - 1) * np.where(count > 1, RUN, 0)
        flat, origin = np.concatenate(texts), np.cumsum(length) - length

        start, step, emit = (x.astype(np.float32) for x in (self.start, self.step, self.emit / np.maximum(self.emit.max(axis=1, keepdims=True), 1e-300)))
        before, after = np.empty((len(place), k), np.float32), np.ones((len(place), k), np.float32)
        before[head] = start
        several = np.flatnonzero(np.repeat(count > 1, count))
        if len(several):
            matrix = np.empty((len(place), k, k), np.float32)
            for at in _slices(length[several]):
                at = several[at]
                matrix[at] = self._products(flat, origin[at], length[at], place[at] == 0, step, emit)
            many = np.flatnonzero(count > 1)
            for j in range(1, int(count.max())):
                many = many[count[many] > j]
                to = head[many] + j
                end = np.einsum("ns,nst->nt", before[to - 1], matrix[to - 1]) if j == 1 else np.einsum("ns,nst->nt", ends, matrix[to - 1])
                ends = end / end.sum(axis=1, keepdims=True)
                before[to] = ends  # the forward probabilities at the end of the run before
                if j + 1 < count.max():
                    ends = ends[count[many] > j + 1]
            many = np.flatnonzero(count > 1)
            for j in range(1, int(count.max())):
                many = many[count[many] > j]
                at = last[many] - j
                back = np.einsum("nst,nt->ns", matrix[at + 1], after[at + 1])
                after[at] = back / back.sum(axis=1, keepdims=True)
        first, steps = np.zeros(k), np.zeros((k, k))
        emissions = np.zeros((k, len(emit)))
        for at in _slices(length):
            f, x = self._within(flat, origin[at], length[at], place[at] == 0, before[at].T, after[at].T, step, np.ascontiguousarray(emit.T), emissions)
            first += f
            steps += x
        return first, steps, emissions.T

    def _products(self, flat: np.ndarray, origin: np.ndarray, length: np.ndarray, heads: np.ndarray, step: np.ndarray, emit: np.ndarray) -> np.ndarray:
        """For each run (rows sorted by length, longest first), the product of its steps and emissions up to a factor; heads begin without a step."""
        k = len(step)
        b = emit[flat[np.minimum(origin + np.arange(int(length[0]))[:, None], len(flat) - 1)]]  # position, run, state
        product = np.where(heads[:, None, None], np.eye(k, dtype=np.float32), step) * b[0][:, None, :]
        for t in range(1, int(length[0])):
            n = int(np.searchsorted(-length, -t, side="left"))  # runs longer than t
            m = (product[:n].reshape(-1, k) @ step).reshape(n, k, k) * b[t, :n, None, :]
            product[:n] = m / m.max(axis=(1, 2), keepdims=True) if t % 4 == 0 else m
        return product / product.max(axis=(1, 2), keepdims=True)

    def _within(
        self, flat: np.ndarray, origin: np.ndarray, length: np.ndarray, heads: np.ndarray, before: np.ndarray, after: np.ndarray, step: np.ndarray, emit: np.ndarray, emissions: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Expected first states and steps of runs (sorted by length, longest first), given the probabilities before and after each; adds to ``emissions``.

        States are the rows of all arrays, so that sums over states run along
        memory.  With ``ahead`` for the forward probabilities one step on, the
        states expected at a position are forward times step times (expected
        at the next over ahead there); no scale enters, and the step itself is
        expected as forward times that quotient.  A symbol's emissions are at
        most 1 and one of them is 1, so a position takes no more from the scale
        than the least likely step, and scaling every other one is enough.
        """
        symbols, base, alive = _by_position(flat, origin, length)
        size = len(base) - 1
        forward = emit.take(symbols, axis=1)
        ahead = np.zeros_like(forward)  # at each position that of the next one, then the quotient there
        gamma = np.empty_like(forward)
        back = np.ascontiguousarray(step.T)
        enter = np.where(heads, before, back @ before)
        forward[:, : base[1]] *= enter
        for t in range(size):
            i, j, m = base[t], base[t + 1], alive[t + 1]
            a = forward[:, i:j]
            if t % 2 == 0:
                a /= a.sum(axis=0)
            if m:
                np.matmul(back, a[:, :m], out=ahead[:, i : i + m])
                forward[:, j : j + m] *= ahead[:, i : i + m]
        for t in range(size - 1, -1, -1):
            i, j, m = base[t], base[t + 1], alive[t + 1]
            g = gamma[:, i:j]
            if m:  # runs that go on
                quotient = np.divide(gamma[:, j : j + m], ahead[:, i : i + m], out=ahead[:, i : i + m])
                np.matmul(step, quotient, out=g[:, :m])
                g[:, :m] *= forward[:, i : i + m]
            if m < alive[t]:
                g[:, m:] = forward[:, i + m : j] * after[:, m : alive[t]]
                g[:, m:] /= g[:, m:].sum(axis=0)
            if t % 64 == 0:
                g /= g.sum(axis=0)
        steps = np.zeros(step.shape)
        for i in range(0, len(symbols), 1 << 16):
            steps += forward[:, i : i + (1 << 16)] @ ahead[:, i : i + (1 << 16)].T
        rest = ~heads
        if rest.any():  # the step into a run from the one before
            steps += before[:, rest] @ (gamma[:, : base[1]][:, rest] / enter[:, rest]).T
        for s, weight in enumerate(gamma):
            emissions[s] += np.bincount(symbols, weights=weight, minlength=emissions.shape[1])
        return gamma[:, : base[1]][:, heads].sum(axis=1, dtype=np.float64), step * steps


def _slices(length: np.ndarray) -> Iterator[np.ndarray]:
    """The runs with these lengths, the longest first, so many at a time as have about ``SLICE * RUN`` tokens and one at least."""
    order = np.argsort(-length, kind="stable")
    part = (np.cumsum(length[order]) - 1) // (SLICE * RUN)
    yield from np.split(order, np.flatnonzero(np.diff(part)) + 1)


def _by_position(flat: np.ndarray, origin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of runs (longest first) in order of position, then run; where each position begins and the end; how many runs have each, and 0."""
    alive = np.searchsorted(-length, -np.arange(int(length[0]) + 1), side="left")
    base = np.concatenate([[0], np.cumsum(alive[:-1])])
    run = np.arange(base[-1]) - np.repeat(base[:-1], alive[:-1])
    return flat[origin[run] + np.repeat(np.arange(len(base) - 1), alive[:-1])].astype(np.intp), base, alive


def _initial(p: np.ndarray) -> Hmm:
    """States that stay likely and emit the words of all texts, tilted at random."""
    rng = np.random.default_rng(SEED)
    emit = p[:, None] * np.exp(rng.normal(0, 1.0, (SYMBOLS, STATES)))
    step = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(step, 0.9)
    even = np.full(STATES, 1 / STATES)
    return Hmm(even, step, emit / emit.sum(axis=0))


def _expectations(table: DataFrame, model: Hmm) -> np.ndarray:
    """Counts summed over all partitions: rows 0.. are symbols, then steps, then first states."""
    sent = table.sparkSession.sparkContext.broadcast(model)
    names = ["row", *(f"s{k}" for k in range(STATES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SYMBOLS + STATES + 1, STATES))
        held: list[np.ndarray] = []
        size = 0

        def add() -> None:
            first, steps, emissions = sent.value.expect(held)
            total[:SYMBOLS] += emissions
            total[SYMBOLS : SYMBOLS + STATES] += steps
            total[-1] += first
            held.clear()

        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(np.frombuffer(x, dtype="<u2"))
                size += len(held[-1])
                if size >= POOL * SLICE * RUN:
                    add()
                    size = 0
        if held:
            add()
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[at, k]) for k in range(STATES))], names=names)

    sums = table.select("symbols").mapInArrow(run, "row int, " + ", ".join(f"{n} double" for n in names[1:])).groupBy("row").agg(*[F.sum(n).alias(n) for n in names[1:]]).toPandas()
    total = np.zeros((SYMBOLS + STATES + 1, STATES))
    total[sums["row"].to_numpy()] = sums[names[1:]].to_numpy()
    return total


def fit(table: DataFrame, p: np.ndarray, rounds: int = ROUNDS) -> Hmm:
    """Baum-Welch over the rows of ``table`` (symbols); ``p`` is the symbols' share of all training tokens, none zero."""
    model = _initial(p)
    for _ in range(rounds):
        total = _expectations(table, model)
        emissions, steps = total[:SYMBOLS] + SMOOTHING * p[:, None], total[SYMBOLS : SYMBOLS + STATES] + 1.0
        start = total[-1] + 1.0
        model = Hmm(start / start.sum(), steps / steps.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0))
    return model


def score_texts(docs: DataFrame, held_out, text: str = "text", id_col: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a boolean column: the rows not to learn from.  Tokens are
    the words (A-Z lowered) and one end.  ``base_score`` is the add-one unigram
    log10 probability, ``score`` that of the hidden Markov model.  Words that
    training lacks count as one unseen word (in the model: one for each
    class).  Null and empty texts are their end alone; repeated rows are
    scored alike and, in training, counted each; if there is nothing to learn
    from, both scores follow from smoothing only.  Texts are scored whole.
    """
    slim = docs.select(named(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), named(text).alias("text"))
    training = slim.where(~F.col("held_out"))
    counts = materialize(count_words(training), "lm-counts")
    ends = training.count()
    sums = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n_train, v = int(sums["n"]) + ends, int(sums["v"]) + (ends > 0)
    top = commonest(counts, "c", COUNTED).toPandas().sort_values(["c", "word"], ascending=[False, True])
    words, often = pa.array(top["word"], pa.string()), top["c"].to_numpy(dtype=np.int64)
    own = int((often >= max(1, n_train) / VOCABULARY).sum())
    vocabulary = Vocabulary(words, often, own)
    table = materialize(symbols(slim, vocabulary), "lm-symbols")

    # Size of each class: what its words weigh, and one for a word never seen.
    common = docs.sparkSession.sparkContext.broadcast(words[:own])

    def uncommon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.invert(pc.is_in(batch.column(0).cast(pa.string()), value_set=common.value)))
            yield pa.RecordBatch.from_arrays([pa.array(classes(batch.column(0)), pa.int32()), batch.column(1)], names=["class", "c"])

    size = np.ones(CLASSES)
    seen = np.zeros(CLASSES)
    for r in counts.select("word", "c").mapInArrow(uncommon, "class int, c long").groupBy("class").agg(F.sum(F.col("c") + 1).alias("w"), F.sum("c").alias("c")).collect():
        size[r["class"]] += r["w"]
        seen[r["class"]] += r["c"]
    p = np.concatenate([[ends + 1.0], often[:own] + 1.0, np.zeros(VOCABULARY - own), seen + 1.0])
    unused = p == 0
    p /= p.sum()
    model = fit(table.where(~F.col("held_out")), p, rounds)
    model.emit[unused] = 1e-300  # symbols without a word, which no text has
    sent = docs.sparkSession.sparkContext.broadcast((model, np.log10(size)))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, log_size = sent.value
        for batch in batches:
            texts = [np.frombuffer(x, dtype="<u2") for x in batch.column(1).to_pylist()]
            score = hmm.log10(texts)
            for k, x in enumerate(texts):
                score[k] -= log_size[x[x > VOCABULARY].astype(np.int64) - VOCABULARY - 1].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["rid", "path"])

    kind = slim.schema["id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (scored,) = forward([batch.select(["rid", "symbols"])])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "id", "held_out", "n_tokens", "known", "head", "rare")), scored.column(1)], names=["rid", "id", "held_out", "n_tokens", "known", "head", "rare", "path"])

    scored = table.drop("tail").mapInArrow(rows, f"rid long, id {kind}, held_out boolean, n_tokens long, known long, head double, rare double, path double")
    tail = table.select("rid", F.explode("tail").alias("t")).select("rid", "t.word", "t.n")
    tail = tail.join(counts.hint("merge"), "word").groupBy("rid").agg(F.sum("n").alias("tail_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("tail_log"))
    whole = scored.join(tail.hint("merge"), "rid", "left")
    extra, more = F.coalesce("tail_log", F.lit(0.0)), F.coalesce("tail_known", F.lit(0))
    base = F.col("head") + extra + math.log10(ends + 1) - F.col("n_tokens") * math.log10(n_train + v + 1)
    return whole.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + more + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("path") + F.col("rare") + extra).alias("score"),
    )
