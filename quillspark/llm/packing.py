"""Cost-balanced packing of token ids into training sequences.

Each task packs the documents it reads, in pools of a bounded number of
tokens, so nothing is shuffled and a pool's memory does not depend on the
size of the corpus.  In a pool, whole sequences are cut from long documents
first; the rests are taken in descending length and each goes to the
sequence of least cost (linear plus quadratic in the lengths of its pieces)
among those with room.  What fits nowhere whole is cut to fill the gaps, and
the tail of a pool becomes sequences whose lengths are powers of two.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .store import named
from .words import slices

SEQUENCE = 2048
END_ID = 1
#: Tokens that a task gathers before it packs them: 1,024 sequences.
POOL_TOKENS = 1 << 21
LINEAR, QUADRATIC = 1.0, 1.0 / SEQUENCE


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from a text to its ids, equal to those of the ``tokenizers`` file at ``path``.

    The byte-level vocabulary is handed to the faster of two public BPE
    implementations; texts that contain a special token's string, and any
    that it refuses, go to ``tokenizers`` itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    # Printable bytes stand for themselves, the others follow from code point 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    to_byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("quill", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return exact.encode(text, add_special_tokens=False).ids
        try:
            return fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit, MemoryError):
            raise
        except BaseException:  # its regular expressions give up on very long runs by a panic
            return exact.encode(text, add_special_tokens=False).ids

    return encode


def pack(lengths: list[int], size: int = SEQUENCE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover each length once.

    Every sequence is full or, in the tail, as long as a power of two.
    """
    out: list[tuple[int, int, int, int, int]] = []
    seq = 0
    rests: list[tuple[int, int, int]] = []  # length, document, start
    for doc, n in enumerate(lengths):
        whole = n // size
        for k in range(whole):
            out.append((doc, k * size, size, seq, 0))
            seq += 1
        if n % size:
            rests.append((n % size, doc, whole * size))
    total = sum(r[0] for r in rests)
    room = np.array([size] * (total // size) + [1 << b for b in reversed(range(size.bit_length())) if (total % size) >> b & 1], dtype=np.int64)
    filled = np.zeros(len(room), dtype=np.int64)
    cost = np.zeros(len(room))

    def place(k: int, doc: int, start: int, n: int) -> None:
        out.append((doc, start, n, seq + k, int(filled[k])))
        filled[k] += n
        room[k] -= n
        cost[k] += linear * n + quadratic * n * n

    cut: list[tuple[int, int, int]] = []
    for n, doc, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        fits = np.where(room >= n, cost, np.inf)
        k = int(fits.argmin())
        if fits[k] < np.inf:
            place(k, doc, start, n)
        else:
            cut.append((n, doc, start))
    for n, doc, start in cut:
        while n:
            k = int(np.where(room > 0, room, 0).argmax())
            m = min(n, int(room[k]))
            place(k, doc, start, m)
            n, start = n - m, start + m
    return out


def pack_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", vocabulary: str | None = None, end_id: int = END_ID, size: int = SEQUENCE, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null text counts as empty, and an empty document is its end id alone.
    Repeated rows are packed once each; a null id stays null; other columns
    are not read.  ``sequence_id`` is the task's number times 2**40 plus a
    count, so a task that runs again gives the same rows.
    """
    path = vocabulary or default_vocabulary()
    slim = docs.select(named(id_col).alias("id"), named(text).alias("__text"))
    id_type = slim.schema[0].dataType
    schema = StructType([StructField("id", id_type), StructField("start", LongType()), StructField("length", LongType()), StructField("ids", BinaryType()), StructField("doc_tokens", LongType()), StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        base = TaskContext.get().partitionId() << 40
        count = 0
        keys: list[pa.Array] = []
        pool: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            if not pool:
                return
            pieces = pack([len(x) for x in pool], size)
            every = pa.concat_arrays(keys)
            for at in range(0, len(pieces), 1000):
                some = pieces[at : at + 1000]
                doc, start, length, seq, offset = zip(*some)
                yield pa.RecordBatch.from_arrays(
                    [every.take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([pool[d][s : s + n].tobytes() for d, s, n, _, _ in some], pa.binary()),
                     pa.array([len(pool[d]) for d in doc], pa.int64()), pa.array([base + count + s for s in seq], pa.int64()), pa.array(offset, pa.int64())],
                    names=schema.names,
                )
            count += max(p[3] for p in pieces) + 1
            keys.clear()
            pool.clear()

        held = 0
        for batch in batches:
            for part in slices(batch, "__text"):
                keys.append(part.column(0))
                for x in part.column(1).to_pylist():
                    ids = np.array([*encode(x or ""), end_id], dtype="<u4")
                    pool.append(ids)
                    held += len(ids)
                if held >= pool_tokens:
                    yield from flush()
                    held = 0
        yield from flush()

    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def packed_pieces(docs: DataFrame, **options) -> DataFrame:
    """`pack_documents` with a checksum in place of the ids."""
    return pack_documents(docs, **options).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
