"""Quality rules built on repetition coverage.

Words are hashed, n-grams of several lengths get rolling hashes in numpy, and
the characters that lie inside n-grams found more than once in the same text
(and in repeated lines) are measured against all characters in words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from .store import free_prefix, named
from .words import WordHashes, raw, slices, windows

_SYMBOLS = b"#*$%&|<>"
#: Largest share of word characters inside repeated n-grams, by length of the n-gram: about half, so that an
#: article with a repeated paragraph stays and a text that is mostly its own repeat goes.
DUP_NGRAM_SHARE = {5: 0.50, 6: 0.49, 7: 0.48, 8: 0.47, 9: 0.46, 10: 0.45}
#: Largest share of word characters in the occurrences of the commonest n-gram, where it occurs twice at least.
TOP_NGRAM_SHARE = {2: 0.25, 3: 0.22, 4: 0.20}
DUP_LINE_SHARE = 0.30
#: Symbols to words.
SYMBOL_RATIO = 0.10
MIN_WORDS = 50
_P = "__qr_"

_OUT = [
    ("n_words", LongType()), ("word_chars", LongType()), ("n_symbols", LongType()), ("n_dup_lines", LongType()), ("n_repeat_words", LongType()),
    ("base_failed", BooleanType()), ("kept", BooleanType()), ("dup_line_share", DoubleType()), ("dup_ngram_share", DoubleType()), ("top_ngram_share", DoubleType()), ("failed_rule", StringType()),
]


def _covered(repeated: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie inside a repeated window."""
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(repeated)
    edge[at] += 1
    edge[at + width] -= 1
    return np.cumsum(edge[:n]) > 0


def measure(text: bytes, memo: WordHashes) -> tuple:
    words = text.split()
    n = len(words)
    symbols = sum(text.count(bytes([c])) for c in _SYMBOLS)
    sizes = np.array([len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass")) for w in words], dtype=np.int64)
    chars = int(sizes.sum())
    seen: set[bytes] = set()
    dup_lines = dup_chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            inside = line.split()
            if inside:
                dup_lines += 1
                dup_chars += sum(len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass")) for w in inside)
        else:
            seen.add(line)
    hashes = memo.of(words)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    repeat_words, dup_share, top_share, failed = 0, 0.0, 0.0, None
    line_share = dup_chars / chars if chars else 0.0
    if symbols > SYMBOL_RATIO * n:
        failed = "symbols"
    if line_share > DUP_LINE_SHARE:
        failed = failed or "dup_lines"
    for width in sorted({3, *TOP_NGRAM_SHARE, *DUP_NGRAM_SHARE}):
        if n < width:
            break
        _, inverse, counts = np.unique(windows(hashes, width), return_inverse=True, return_counts=True)
        times = counts[inverse]
        if times.max() < 2:
            if width == 2:
                continue
            break  # no longer n-gram can repeat either
        inside = _covered(times >= 2, width, n)
        if width == 3:
            repeat_words = int(inside.sum())
        if width in TOP_NGRAM_SHARE:
            # Of n-grams that are equally common, the one that covers most.
            order = np.argsort(inverse, kind="stable")
            gram = inverse[order]
            following = np.append(np.where(gram[1:] == gram[:-1], order[1:], n), n)
            covered = upto[np.minimum(order + width, following)] - upto[order]
            share = int(np.bincount(gram, weights=covered)[counts == counts.max()].max()) / chars
            top_share = max(top_share, share)
            if share > TOP_NGRAM_SHARE[width]:
                failed = failed or f"top_{width}gram"
        if width in DUP_NGRAM_SHARE:
            share = int(sizes[inside].sum()) / chars
            dup_share = max(dup_share, share)
            if share > DUP_NGRAM_SHARE[width]:
                failed = failed or f"dup_{width}gram"
    base_failed = n < MIN_WORDS or 100 * repeat_words > 50 * n
    if base_failed:
        failed = "base"
    return n, chars, symbols, dup_lines, repeat_words, base_failed, failed is None, line_share, dup_share, top_share, failed


def with_quality(docs: DataFrame, text: str = "text", prefix: str = _P) -> DataFrame:
    """Every row and column of ``docs`` with the measures, each under ``prefix`` + its name.

    Null and empty texts have no words and fail the base rule.  Repeated rows
    are judged alike; texts of any length are read whole.  The operator maps
    rows one by one, without a shuffle.
    """
    # Positions stand for names meanwhile, which may have dots.
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    at = f"c{docs.columns.index(text)}"
    schema = StructType([*plain.schema.fields, *(StructField(n, t) for n, t in _OUT)])
    added = pa.schema([(n, {LongType: pa.int64(), BooleanType: pa.bool_(), DoubleType: pa.float64(), StringType: pa.string()}[type(t)]) for n, t in _OUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for part in slices(batch, at):
                found = list(zip(*(measure(x, memo) for x in raw(part.column(at)))))
                columns = [pa.array(values, field.type) for values, field in zip(found, added)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *added.names])

    return plain.mapInArrow(run, schema).toDF(*docs.columns, *(prefix + n for n, _ in _OUT))


def quality_rules(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document with its measures and the verdict ``kept``; see `with_quality`."""
    slim = docs.select(named(id_col).alias("__id"), named(text).alias("__text"))
    return with_quality(slim, "__text", "__q_").select(F.col("__id").alias(id_col), *[F.col("__q_" + n).alias(n) for n, _ in _OUT])


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    p = free_prefix(docs.columns, _P)
    return with_quality(docs, text, p).where(F.col(p + "kept")).select(*[named(c) for c in docs.columns])
