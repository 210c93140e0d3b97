"""Toxicity: a learned lexicon, Levenshtein automata intersected with its trie, and context windows.

Labelled documents give a lexicon of whole terms and of open ones, which any
ending may follow.  Both are in one trie.  Each word is read once by the
Levenshtein automaton of the lexicon: its states are sets of trie nodes with
the edits spent to reach them, made deterministic as words need them, so a
word costs a look-up for each letter and most words die after a few.  A
window around each hit tells quotation from abuse.  The evidence of a text is
the sum of its terms' weights, less for misspelt and for quoted hits, and a
logistic model of it gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, named
from .words import slices

#: Labelled rows that a model is fitted on at most, the first by a hash of their id (1 MB when sent).
SAMPLE = 50_000
MIN_PRECISION = 0.8
#: Letters of open terms; a term may be misspelt by one edit if it has five letters at least.
OPEN = range(3, 11)
FUZZY_FROM = 5
#: An open term must be so many times as sure as any one word that begins with it.
OPEN_GAIN = 1.5
WINDOW = 4
THRESHOLD = 0.7
#: Shares of toxic rows that misspelt and quoted hits are taken to have before any is seen, against exact ones, and how many rows that counts for.
PRIOR = {"fuzzy": 0.5, "quoted": 0.1}
PRIOR_ROWS = 10
#: Rows that are not toxic in which a context word must stand by a hit before it can tell quotation.
MIN_TOLD = 5
#: States of the automaton, and words with their result, that a task remembers.
STATES, REMEMBERED = 100_000, 200_000
_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = frozenset("\"“”„«»‘’`")


@dataclass
class Term:
    weight: float
    open: bool = False
    fuzzy: bool = True


@dataclass
class Lexicon:
    """Terms by their letters, those with ``open`` set standing for all words that begin with them."""

    terms: dict[str, Term]
    told: frozenset = frozenset()
    trie: list = field(init=False)

    def __post_init__(self) -> None:
        self.trie = [({}, None)]  # children by letter, and the term that ends here
        for name in self.terms:
            at = 0
            for c in name:
                below = self.trie[at][0]
                if c not in below:
                    below[c] = len(self.trie)
                    self.trie.append(({}, None))
                at = below[c]
            self.trie[at] = (self.trie[at][0], name)
        self.forget()

    def forget(self) -> None:
        start = self._closed({0: 0})
        self.states, self.steps, self.accepts, self.begins = {start: 0}, [{}], [self._best(start, False)], [self._best(start, True)]
        self.sets = [start]

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "told": self.told, "trie": self.trie}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def _closed(self, nodes: dict[int, int]) -> frozenset:
        """A state: nodes with the fewest edits; a letter of the term may be missing from the word."""
        for at in [n for n, edits in nodes.items() if not edits]:
            for below in self.trie[at][0].values():
                nodes.setdefault(below, 1)
        return frozenset(nodes.items())

    def _best(self, state: frozenset, begun: bool) -> tuple[str, int] | None:
        """The term that ends in this state with the fewest edits, of largest weight; of open terms if ``begun``."""
        found = [(edits, -self.terms[t].weight, t) for at, edits in state if (t := self.trie[at][1]) and (self.terms[t].open or not begun) and (not edits or self.terms[t].fuzzy)]
        return (min(found)[2], min(found)[0]) if found else None

    def _step(self, state: int, c: str) -> int:
        after: dict[int, int] = {}
        for at, edits in self.sets[state]:
            for letter, below in self.trie[at][0].items():
                cost = edits + (letter != c)
                if cost <= 1 and cost < after.get(below, 2):
                    after[below] = cost
            if not edits and after.get(at, 2) > 1:
                after[at] = 1  # a letter too many in the word
        key = self._closed(after)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.accepts.append(self._best(key, False))
            self.begins.append(self._best(key, True))
        self.steps[state][c] = to
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that a lower-case word is, or begins with if the term is open, and the edits between: 0 before 1."""
        if len(self.sets) > STATES:
            self.forget()
        state, begun = 0, None
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if not self.sets[state]:
                return begun
            found = self.begins[state]
            if found and (begun is None or found[1] < begun[1]):
                begun = found
                if not found[1]:
                    break
        whole = self.accepts[state] if state else None
        if begun and not begun[1] or not whole:
            return begun
        return whole if begun is None or whole[1] < begun[1] else begun


@dataclass
class Hit:
    start: int
    end: int
    term: str
    edits: int
    quoted: bool
    near: tuple


def hits(text: str, lexicon: Lexicon, memo: dict) -> list[Hit]:
    """The words of a text that match, with their windows."""
    words = set(_WORD.findall(text))
    found = {}
    for word in words:
        m = memo.get(word, 0)
        if m == 0:
            if len(memo) >= REMEMBERED:
                memo.clear()
            m = memo[word] = lexicon.match(word.lower())
        if m:
            found[word] = m
    if not found:
        return []
    out = []
    for m in _WORD.finditer(text):
        if m[0] in found:
            before, after = text[max(0, m.start() - 60) : m.start()], text[m.end() : m.end() + 60]
            near = tuple(w.lower() for w in _WORD.findall(before)[-WINDOW:] + _WORD.findall(after)[:WINDOW])
            marks = any(c in _QUOTES for c in before[-2:]) and any(c in _QUOTES for c in after[:2])
            inside = sum(before.count(q) for q in '"`') % 2 == 1 and any(q in after for q in '"`')
            pairs = any(before.rfind(a) > before.rfind(b) and b in after for a, b in ("“”", "„“", "«»", "‘’"))
            out.append(Hit(m.start(), m.end(), *found[m[0]], marks or inside or pairs or any(w in lexicon.told for w in near), near))
    return out


def evidence(found: list[Hit], lexicon: Lexicon) -> tuple[float, float, float, float]:
    """Weights of the hits, summed: exact, misspelt, exact quoted, misspelt quoted ones."""
    sums = [0.0, 0.0, 0.0, 0.0]
    for h in found:
        sums[h.edits + 2 * h.quoted] += lexicon.terms[h.term].weight
    return tuple(sums)


@dataclass
class Model:
    lexicon: Lexicon
    discount: tuple[float, float]  # what a misspelt and a quoted hit count, against an exact one
    weights: np.ndarray  # of the features, with the constant last

    def features(self, sums: tuple, length: int) -> tuple[float, float]:
        fuzzy, quoted = self.discount
        e = sums[0] + fuzzy * sums[1] + quoted * sums[2] + fuzzy * quoted * sums[3]
        return math.log1p(e), math.log1p(1000.0 * e / max(100, length))

    def score(self, found: list[Hit], length: int) -> float:
        z = float(np.dot(self.weights[:-1], self.features(evidence(found, self.lexicon), length)) + self.weights[-1])
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps; a weight below zero is dropped, for evidence never speaks against toxicity."""
    if not len(x) or not y.any() or y.all():
        return np.concatenate([np.zeros(x.shape[1] if len(x) else 2), [-4.0]])
    use = np.ones(x.shape[1], dtype=bool)
    while True:
        a = np.column_stack([x[:, use], np.ones(len(x))])
        penalty = ridge * len(x) * np.append(np.ones(use.sum()), 0)
        w = np.zeros(a.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9)
            step = np.linalg.solve(h, a.T @ (y - p) - penalty * w)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        out = np.zeros(x.shape[1] + 1)
        out[np.append(use, True)] = w
        if (out[:-1] >= 0).all():
            return out
        use &= out[:-1] > 0


def _forms(text: str) -> set[str]:
    """Words, and their beginnings marked by a star."""
    words = {w.lower() for w in _WORD.findall(text)}
    return words | {w[:n] + "*" for w in words for n in OPEN if len(w) >= n}


FOLDS = 2
_FORM_COLUMNS = [f"{kind}{k}" for k in range(FOLDS) for kind in ("bad", "good")]


def _count(rows: DataFrame) -> DataFrame:
    """(form, bad0, good0, bad1, ...): in how many toxic and how many other rows of each fold each form is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in _FORM_COLUMNS]

        def flushed() -> pa.RecordBatch:
            forms = list(set().union(*counts))
            out = pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), *(pa.array([c[f] for f in forms], pa.int64()) for c in counts)], names=["form", *_FORM_COLUMNS])
            for c in counts:
                c.clear()
            return out

        for batch in batches:
            for x, toxic, fold in zip(*(batch.column(k).to_pylist() for k in range(3))):
                counts[2 * fold + (not toxic)].update(_forms(x or ""))
                if sum(map(len, counts)) > 300_000:
                    yield flushed()
        yield flushed()

    return rows.select("text", "toxic", "fold").mapInArrow(run, "form string, " + ", ".join(f"{c} long" for c in _FORM_COLUMNS)).groupBy("form").agg(*[F.sum(c).alias(c) for c in _FORM_COLUMNS])


def _ratio(b: float, g: float, share: float) -> float:
    """Log-likelihood ratio of b toxic rows and g others against the share of toxic rows."""
    n = b + g
    return (b * math.log(b / n / share) if b else 0.0) + (g * math.log(g / n / (1 - share)) if g else 0.0)


def chosen_terms(held: dict[str, tuple[int, int]], bad_rows: int, good_rows: int) -> dict[str, Term]:
    """Whole and open terms from the forms that hold, with (toxic, other) rows of each.

    The surest form comes first, a word before an open form and a longer one
    before a shorter among equals.  What an open term covers is left out, and
    so is an open form with which a surer term begins or that is little surer
    than one word with it: then endings do not matter, or are misspellings.
    """
    share = bad_rows / max(1, bad_rows + good_rows)
    surest: dict[str, float] = {}  # of the words with each beginning
    for form in held:
        if not form.endswith("*"):
            for n in range(1, len(form) + 1):
                surest[form[:n]] = max(surest.get(form[:n], 0.0), _ratio(*held[form], share))
    terms: dict[str, Term] = {}
    begun: set[str] = set()
    for form in sorted(held, key=lambda f: (-_ratio(*held[f], share), f.endswith("*"), -len(f), f)):
        base, is_open = form.rstrip("*"), form.endswith("*")
        if is_open and (base in begun or _ratio(*held[form], share) < OPEN_GAIN * surest.get(base, 0.0)) or any(base[:n] in terms and terms[base[:n]].open for n in range(1, len(base) + 1)):
            continue
        b, g = held[form]
        terms[base] = Term(max(0.1, math.log((b + 0.5) / (g + 0.5) * (good_rows + 1) / (bad_rows + 1))), is_open, len(base) >= FUZZY_FROM)
        begun.update(base[:n] for n in range(1, len(base) + 1))
    return terms


def holding(counts: DataFrame, bad: str, good: str, bad_rows: int, good_rows: int) -> dict[str, tuple[int, int]]:
    """The forms that tell toxic rows from others more surely than chance makes any of so many forms do.

    A form holds if `MIN_PRECISION` of the rows with it are toxic and its
    log-likelihood ratio against the share of toxic rows exceeds the
    logarithm of the number of forms.  All that hold are collected; in every
    one are several toxic rows of the sample, which bounds them.
    """
    if not bad_rows or not good_rows:
        return {}
    share = bad_rows / (bad_rows + good_rows)
    b, n = F.col(bad), F.col(bad) + F.col(good)
    tested = max(1, counts.where(n > 1).count())
    rows = counts.where((b > 1) & (b >= MIN_PRECISION * n) & (b * math.log(1 / share) >= math.log(tested))).select("form", b.alias("b"), F.col(good).alias("g")).collect()
    return {r["form"]: (r["b"], r["g"]) for r in rows if _ratio(r["b"], r["g"], share) >= math.log(tested)}


def _over(rows: DataFrame, lexicons: list[Lexicon], pick, emit, schema: str) -> DataFrame:
    """Rows that ``emit`` makes of (lexicon number, toxic, fold, text, hits), for the lexicons that ``pick`` names by fold."""
    sent = rows.sparkSession.sparkContext.broadcast(lexicons)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "long": pa.int64()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos: list[dict] = [{} for _ in sent.value]
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for x, toxic, fold in zip(*(part.column(k).to_pylist() for k in range(3))):
                    for k in pick(fold):
                        out += emit(k, toxic, fold, x or "", hits(x or "", sent.value[k], memos[k]), sent.value[k])
                columns = list(zip(*out)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

    return rows.select("text", "toxic", "fold").mapInArrow(run, schema)


def _curb(rows: DataFrame, lexicons: list[Lexicon], pick) -> None:
    """Misspellings stay allowed for the terms whose near forms are in toxic rows for the most part."""

    def emit(k, toxic, fold, text, found, lexicon):
        return [(k, toxic, t) for t in {h.term for h in found if h.edits}]

    seen = _over(rows, lexicons, pick, emit, "k int, toxic int, term string").groupBy("k", "term").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    for r in seen.where(F.col("bad") < MIN_PRECISION * F.col("n")).collect():
        lexicons[r["k"]].terms[r["term"]].fuzzy = False
    for lexicon in lexicons:
        lexicon.forget()


def _told(rows: DataFrame, lexicons: list[Lexicon], pick) -> frozenset:
    """Context words that stand by exact hits in rows that are not toxic more surely than chance makes any of so many words do."""

    def emit(k, toxic, fold, text, found, lexicon):
        exact = [h for h in found if not h.edits]
        return [(toxic, w) for w in {w for h in exact for w in h.near}] + ([(toxic, "")] if exact else [])

    seen = _over(rows, lexicons, pick, emit, "toxic int, word string").groupBy("word").agg(F.sum("toxic").alias("b"), F.sum(1 - F.col("toxic")).alias("g"))
    seen = materialize(seen, "tox-contexts")
    every = seen.where("word = ''").first()
    if not every or not every["b"] or not every["g"]:
        return frozenset()
    share, tested = every["b"] / (every["b"] + every["g"]), max(2, seen.count())
    least = max(MIN_TOLD, math.log(tested) / math.log(1 / (1 - share)))
    return frozenset(r["word"] for r in seen.where((F.col("word") != "") & (F.col("g") > F.col("b")) & (F.col("g") >= least)).collect() if _ratio(r["b"], r["g"], share) >= math.log(tested))


def _discounts(read) -> tuple[float, float]:
    """Share of toxic rows among those with misspelt and with quoted hits, against that of exact ones; ``read`` has toxic and e0 .. e3."""
    toxic = read["toxic"].to_numpy(dtype=float)
    has = [read[f"e{k}"].to_numpy() > 0 for k in range(4)]
    exact = (toxic[has[0]].sum() + 1) / (has[0].sum() + 1)
    shares = [(toxic[at].sum() + PRIOR_ROWS * prior) / (at.sum() + PRIOR_ROWS) for at, prior in ((has[1], PRIOR["fuzzy"]), (has[2] | has[3], PRIOR["quoted"]))]
    return tuple(min(1.0, float(x / exact)) for x in shares)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit lexicon, contexts and weights on at most ``sample`` labelled documents.

    ``labels`` (id, label) gives the rows to learn from; labels other than 0
    and 1 are left out.  The lexicon is learned from all rows; what its hits
    are worth is measured on each half of the rows with the lexicon of the
    other half, so no term vouches for itself.
    """
    chosen = labels.where(named(label).isin(0, 1) & named(id_col).isNotNull()).select(named(id_col).alias("__id"), named(label).cast("int").alias("toxic")).dropDuplicates(["__id"])
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    slim = docs.select(named(id_col).alias("__id"), named(text).alias("text"))
    fold = F.pmod(F.xxhash64("__id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    rows = materialize(slim.join(F.broadcast(chosen), "__id").select("text", "toxic", fold.alias("fold")), "tox-rows")
    counts = materialize(_count(rows), "tox-forms")
    size = Counter({(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()})
    both = counts.select("form", (F.col("bad0") + F.col("bad1")).alias("bad"), (F.col("good0") + F.col("good1")).alias("good"))
    total = size[0, 1] + size[1, 1], size[0, 0] + size[1, 0]
    final = Lexicon(chosen_terms(holding(both, "bad", "good", *total), *total))
    half = [Lexicon(chosen_terms(holding(counts, f"bad{k}", f"good{k}", size[k, 1], size[k, 0]), size[k, 1], size[k, 0])) for k in range(FOLDS)]
    every = [*half, final]
    _curb(rows, every, lambda fold: (fold, FOLDS))
    told = _told(rows, half, lambda fold: (1 - fold,))
    for lexicon in every:
        lexicon.told = told

    def emit(k, toxic, fold, text, found, lexicon):
        return [(toxic, len(text), *evidence(found, lexicon))]

    read = _over(rows, half, lambda fold: (1 - fold,), emit, "toxic int, length long, e0 double, e1 double, e2 double, e3 double").toPandas()
    model = Model(final, _discounts(read), np.zeros(3))
    x = np.array([model.features(sums, n) for n, *sums in read[["length", "e0", "e1", "e2", "e3"]].itertuples(index=False)]).reshape(-1, 2)
    model.weights = _fit(x, read["toxic"].to_numpy(dtype=float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, ``score``, ``hits`` (start, end, term, edits, quoted).

    Null and empty texts have no hits and the score of such texts.  Texts are
    read whole; repeated rows are scored alike; of terms as near, the one with
    the largest weight is reported; an empty table gives no row; other columns
    are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(named(id_col).alias("__id"), named(text).alias("__text"))
    item = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("edits", pa.int64()), ("quoted", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = [x or "" for x in part.column(1).to_pylist()]
                found = [hits(x, sent.value.lexicon, memo) for x in texts]
                listed = [[{"start": h.start, "end": h.end, "term": h.term, "edits": h.edits, "quoted": h.quoted} for h in x] for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sent.value.score(h, len(x)) for h, x in zip(found, texts)], pa.float64()), pa.array(listed, item)], names=["__id", "score", "hits"])

    kind = slim.schema["__id"].dataType.simpleString()
    return slim.mapInArrow(run, f"__id {kind}, score double, hits array<struct<start:long,end:long,term:string,edits:long,quoted:boolean>>").withColumnRenamed("__id", id_col)
