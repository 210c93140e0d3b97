"""Language identification: scripts, per-word scores, Viterbi.

A word's script, told by ranges of its characters, leaves the languages that
use it; the word is scored for each by hashed byte n-grams; and a Viterbi
pass with a penalty for switching labels the spans of a mixed text.  The
language with the most characters in its spans is the text's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import named
from .words import raw, slices

BUCKETS = 1 << 15
#: A task holds counts of so many languages at once (17 MB) and sends them on when another comes.
HELD = 64
SWITCH_PENALTY = 8.0
SMOOTHING = 0.5
#: A language is a candidate for a script if so large a share of its words is in it.
SCRIPT_SHARE = 0.001

# First and last code point of the blocks of each script (fixed by Unicode).  A word of several scripts counts as the last in this list.
_BLOCKS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE)],
    "Syriac": [(0x700, 0x74F)],
    "Thaana": [(0x780, 0x7BF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Oriya": [(0xB00, 0xB7F)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Cherokee": [(0x13A0, 0x13FF)],
    "Khmer": [(0x1780, 0x17FF)],
    "Mongolian": [(0x1800, 0x18AF)],
    "Han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
    "Bopomofo": [(0x3100, 0x312F)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Hiragana": [(0x3040, 0x309F)],
    "Katakana": [(0x30A0, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
}
#: Scripts by number; 0 is any other script.
SCRIPTS = 1 + len(_BLOCKS)
_SCRIPT = np.zeros(0x32400, dtype=np.uint8)
for _number, _ranges in enumerate(_BLOCKS.values(), 1):
    for _first, _last in _ranges:
        _SCRIPT[_first : _last + 1] = _number
#: Code points past ASCII that part words: signs, spaces, punctuation and symbols.
_PARTS = np.zeros(len(_SCRIPT), dtype=bool)
for _first, _last in [(0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x200B), (0x200E, 0x206F), (0x20A0, 0x20CF), (0x2100, 0x2BFF), (0x3000, 0x3004), (0x3008, 0x3020), (0xFF00, 0xFF20), (0x1F000, 0x1FAFF)]:
    _PARTS[_first : _last + 1] = True
_LETTERS = np.zeros(256, dtype=bool)  # bytes that stay; all others become a space
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[~_LETTERS] = 32


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each byte's n-gram, first byte of each word, script and characters of each word."""
    b = np.frombuffer(b" " + text + b"   ", dtype=np.uint8)
    low = _LOWER[b]
    inside = _LETTERS[b]
    lead = (b & 0xC0) != 0x80
    if text.isascii():
        script = _SCRIPT[b]
    else:
        points = np.minimum(np.frombuffer(text.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32), len(_SCRIPT) - 1)
        sizes = np.diff(np.flatnonzero(lead))[1 : len(points) + 1]  # bytes of each character
        script = np.zeros(len(b), dtype=np.uint8)
        script[1:-3] = np.repeat(_SCRIPT[points], sizes)
        parts = np.repeat(_PARTS[points], sizes)
        inside[1:-3] &= ~parts
        low[1:-3][parts] = 32
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if not len(starts):
        return np.empty(0, np.int64), starts, starts, starts
    gram = low[:-3] | low[1:-2] << np.uint32(8) | low[2:-1] << np.uint32(16) | low[3:] << np.uint32(24)
    bucket = (gram * np.uint32(2654435761)) >> np.uint32(17)
    # N-grams begin at the space before a word and belong to the word that follows or holds them.
    chars = np.add.reduceat((lead & inside)[:-3].astype(np.int64), starts)
    return bucket, starts - 1, np.maximum.reduceat(script[:-3], starts).astype(np.int64), chars


class Model:
    def __init__(self, names: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.names = names
        total = grams.sum(axis=1, keepdims=True)
        self.scores = np.log((grams + SMOOTHING) / (total + SMOOTHING * BUCKETS)).T.astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        used = share >= SCRIPT_SHARE
        used[:, ~used.any(axis=0)] = True
        self.barred = np.where(used, 0.0, -np.inf).T.astype(np.float32)

    def word_scores(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        bucket, begin, script, chars = words_of(text)
        if not len(begin):
            return np.empty((0, len(self.names)), np.float32), chars
        scores = np.add.reduceat(self.scores[bucket], begin, axis=0) + self.barred[script]
        return scores - scores.max(axis=1, keepdims=True), chars


def viterbi(scores: list[np.ndarray], penalty: float = SWITCH_PENALTY) -> list[np.ndarray]:
    """Best labels of each word of several texts, all texts a word at a time."""
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    lengths = np.array([len(scores[k]) for k in order])
    steps = int(lengths[0]) if len(lengths) else 0
    flat = np.concatenate([scores[k] for k in order]) if steps else np.empty((0, 1))
    offset = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.empty(0, int)
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts longer than each step
    pointer = np.min_scalar_type(flat.shape[1])
    back = np.empty(flat.shape, dtype=pointer)
    best = np.zeros((len(order), flat.shape[1]), dtype=np.float32)
    for t in range(steps):
        n = alive[t]
        at = offset[:n] + t
        if t == 0:
            best[:n] = flat[at]
            continue
        b = best[:n]
        top = b.argmax(axis=1)
        jump = b[np.arange(n), top][:, None] - penalty
        stay = b >= jump
        back[at] = np.where(stay, np.arange(b.shape[1], dtype=pointer), top[:, None].astype(pointer))
        best[:n] = np.where(stay, b, jump) + flat[at]
    labels = np.empty(len(flat), dtype=pointer)
    state = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        at = offset[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    out: list[np.ndarray] = [np.empty(0, pointer)] * len(scores)
    for k, o, n in zip(order, offset, lengths):
        out[k] = labels[o : o + n]
    return out


def train(docs: DataFrame, text: str, lang: str) -> Model:
    """Counts over every row with a language, summed across tasks; a table of fixed size for each language reaches the driver."""

    def flushed(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "slot", "n"])
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, x in zip(batch.column(1).to_pylist(), raw(batch.column(0))):
                bucket, begin, script, _ = words_of(x)
                if len(counts) >= HELD and name not in counts:
                    yield from flushed(counts)
                c = counts.setdefault(name, np.zeros(BUCKETS + SCRIPTS, dtype=np.int64))
                if len(begin):
                    c[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    c[BUCKETS:] += np.bincount(script, minlength=SCRIPTS)
        yield from flushed(counts)

    known = docs.where(named(lang).isNotNull()).select(named(text).alias("text"), named(lang).alias("lang"))
    names = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    sums = known.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(names), BUCKETS + SCRIPTS))
    table[sums["lang"].map({x: k for k, x in enumerate(names)}).to_numpy(dtype=np.int64), sums["slot"].to_numpy()] = sums["n"].to_numpy()
    return Model(names, table[:, :BUCKETS], table[:, BUCKETS:])


def label(model: Model, texts: list[bytes]) -> list[tuple[str, float, list[tuple[str, int]]]]:
    """Language, its share of the characters, and spans (language, words) of each text."""
    scored = [model.word_scores(x) if model.names else (np.empty((0, 1), np.float32), np.empty(0, np.int64)) for x in texts]
    out = []
    for text, (_, chars), labels in zip(texts, scored, viterbi([s for s, _ in scored])):
        if not len(labels) or not any(c.isalpha() for c in text.decode("utf-8", "replace")):
            out.append(("und", 0.0, []))
            continue
        weight = np.bincount(labels, weights=np.maximum(chars, 1), minlength=len(model.names))
        best = int(weight.argmax())
        edges = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1], [True]]))
        out.append((model.names[best], float(weight[best] / weight.sum()), [(model.names[labels[a]], int(b - a)) for a, b in zip(edges[:-1], edges[1:])]))
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score``, ``spans`` (language and words of each run).

    ``und``, score 0, if the text is null or has no letter, or if no language
    was learned.  Ties go to the language first in order.  Repeated rows are
    labelled alike; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(named(id_col).alias("__id"), named(text).alias("__text"))
    span = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                lang, score, spans = zip(*label(sent.value, raw(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([[{"lang": a, "words": n} for a, n in x] for x in spans], span)], names=["__id", "lang_pred", "score", "spans"])

    kind = slim.schema["__id"].dataType.simpleString()
    return slim.mapInArrow(run, f"__id {kind}, lang_pred string, score double, spans array<struct<lang:string,words:long>>").withColumnRenamed("__id", id_col)
