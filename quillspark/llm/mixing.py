"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents form streams of words that are cut into blocks of a
fixed length.  Every draw of a source falls on an output shard, which gives
each shard its counts by source: a multinomial draw, given the sources'
totals, for a free draw would miss small targets.  The slots of a shard follow
from its counts; they number the source's slots on from where the shards
before it ended.  The n-th slot of a source takes the block that a
pseudorandom permutation of the source's block indices names, and blocks are
joined by index.

No step gathers a source: streams are bounded pieces of a source, draws are
counted in chunks, slots are generated by shard, and blocks are joined by
(source, index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, named

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: The mix's size against that of all documents, and a source's largest target against its size.
SHARE, MOST = 1.5, 2
BLOCK_WORDS = 128
#: Words in one stream; a source has as many streams as it needs.
STREAM_WORDS = 1 << 20
SLOTS_PER_SHARD = 1 << 13
CHUNK = 1 << 12
#: Shards whose counts are summed together.
BUNCH = 1 << 12


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``rank``, ``weight`` and ``target`` to (source, source_size).

    Targets share ``share`` times all sizes by weight.  None exceeds ``most``
    times its source's size; what is over goes to the others by weight until
    none is above: target = min(most * size, level * weight), and the level
    follows from the sources in the order of their caps per weight.  The
    windows run over one row per source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)).withColumn("per", F.col("cap") / F.col("weight"))
    order = Window.orderBy("per", "rank")
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.orderBy("per", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = capped.withColumn("level", (F.sum("source_size").over(every) * float(share) - below) / open_weight)
    chosen = F.min(F.when(F.col("level") <= F.col("per"), F.struct("per", "rank", "level"))).over(every)["level"]
    return level.withColumn("chosen", chosen).select("source", "source_size", "rank", "weight", F.when(F.col("chosen").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("chosen") * F.col("weight"))).alias("target"))


def permuted(index: Column, rows: Column, columns: Column, *salt: Column, rounds: int = 4) -> Column:
    """A pseudorandom permutation of 0 .. rows * columns - 1.

    The index is a cell of a grid; each round shifts the row by a hash of the
    column and then the column by a hash of the new row, modulo their counts,
    both of which can be undone.
    """
    column = F.pmod(index, columns)
    cell = F.struct(((index - column) / columns).cast("long").alias("r"), column.alias("c"))

    def half_round(x: Column, k: Column) -> Column:
        shift = F.xxhash64(*salt, k, F.when(k % 2 == 0, x["c"]).otherwise(x["r"]))
        r = F.when(k % 2 == 0, F.pmod(x["r"] + F.pmod(shift, rows), rows)).otherwise(x["r"])
        c = F.when(k % 2 == 1, F.pmod(x["c"] + F.pmod(shift, columns), columns)).otherwise(x["c"])
        return F.struct(r.alias("r"), c.alias("c"))

    # A fold, for nested expressions would double with every round.
    return F.aggregate(F.array(*[F.lit(k) for k in range(2 * rounds)]), cell, half_round, lambda x: x["r"] * columns + x["c"])


def _layout(docs: DataFrame, text: str, id_col: str, source_col: str, payload: list[str], seed: int, block_words: int, stream_words: int) -> tuple[DataFrame, DataFrame]:
    """Documents laid out in streams (rank, base block, lo, size, ...) and one row per source with its slot plan."""
    words = F.coalesce(F.regexp_count(named(text), F.lit(WORD)), F.lit(0)).cast("long")
    # Ids may be null or repeated, so texts help to spread rows over streams.
    spread = F.xxhash64(named(id_col), named(text))
    sized = docs.select(named(id_col).alias("__id"), named(source_col).alias("__source"), words.alias("__size"), spread.alias("__h"), *[F.col(f"`{c}`").alias(f"__p_{k}") for k, c in enumerate(payload)])
    if not payload:
        sized = materialize(sized, "mix-sizes")
    sizes = sized.groupBy("__source").agg(F.sum("__size").alias("source_size")).withColumnRenamed("__source", "source")
    targets = materialize(source_targets(sizes).withColumn("streams", F.greatest(F.lit(1), F.ceil(F.col("source_size") / stream_words)).cast("long")), "mix-targets")
    placed = sized.join(targets, sized["__source"].eqNullSafe(targets["source"])).withColumn("__stream", F.pmod(F.xxhash64("__h", F.lit(seed)), F.col("streams")))
    in_stream = Window.partitionBy("rank", "__stream").orderBy(F.xxhash64(F.lit(seed), "__h"), "__h", "__id", "__size")
    placed = placed.withColumn("__lo", F.sum("__size").over(in_stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")).drop("__h")
    placed = materialize(placed, "mix-placed")
    blocks = placed.groupBy("rank", "__stream").agg(F.ceil(F.sum("__size") / block_words).alias("n"))
    base = materialize(blocks.withColumn("__base", F.sum("n").over(Window.partitionBy("rank").orderBy("__stream").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")), "mix-streams")
    count = base.groupBy("rank").agg(F.sum("n").alias("n_blocks"))
    # A grid of about equal sides holds the block indices; cells past the last block are passed over.
    plan = (
        targets.join(count, "rank")
        .where("n_blocks > 0")
        .withColumn("rows", F.ceil(F.sqrt("n_blocks")).cast("long"))
        .withColumn("columns", F.ceil(F.col("n_blocks") / F.col("rows")).cast("long"))
        .withColumn("cells", F.col("rows") * F.col("columns"))
        .withColumn("draws", F.least(F.round(F.col("target") / F.col("source_size") * F.col("cells")).cast("long"), F.col("cells") * int(MOST)))
    )
    return placed.join(base.drop("n"), ["rank", "__stream"]), materialize(plan, "mix-plan")


def draw_counts(plan: DataFrame, seed: int = 0) -> DataFrame:
    """(rank, shard, n, first): the slots that each shard draws of each source, and the source's slots in the shards before it.

    Every draw of a source falls on a shard by its hash.  Draws come in chunks
    of a source, so that no task makes more than a chunk's at a time, and only
    counts are shuffled.  Running sums are taken over bunches of shards first.
    """
    shards = F.greatest(F.lit(1), F.ceil(F.sum("draws").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / SLOTS_PER_SHARD)).cast("long")
    chunks = plan.where("draws > 0").withColumn("shards", shards).withColumn("chunk", F.explode(F.expr(f"sequence(0L, (draws - 1) div {CHUNK})")))
    # A chunk is a few bytes and stands for thousands of draws, so the number of tasks is given outright.
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = chunks.repartition(tasks, F.col("rank"), F.col("chunk")).withColumn("draw", F.explode(F.expr(f"sequence(chunk * {CHUNK}L, least(draws, (chunk + 1) * {CHUNK}L) - 1)")))
    shard = F.pmod(F.xxhash64(F.lit(seed), F.col("rank"), F.col("draw")), F.col("shards"))
    counts = materialize(drawn.select("rank", shard.alias("shard")).groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("n")).withColumn("bunch", F.expr(f"shard div {BUNCH}")), "mix-counts")
    bunches = counts.groupBy("rank", "bunch").agg(F.sum("n").alias("m"))
    bunches = bunches.select("rank", "bunch", F.coalesce(F.sum("m").over(Window.partitionBy("rank").orderBy("bunch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("rank", "bunch").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("within", within).join(bunches, ["rank", "bunch"]).select("rank", "shard", "n", (F.col("start") + F.col("within")).alias("first"))


def draw_slots(plan: DataFrame, seed: int = 0) -> DataFrame:
    """Slots (shard, rank, slot, block, copy) of the mix, from the counts by shard; ``copy`` is 0 the first time a block is taken."""
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = draw_counts(plan, seed).repartition(tasks, "rank", "shard").join(plan.select("rank", "cells", "rows", "columns", "n_blocks"), "rank")
    slots = counts.withColumn("slot", F.explode(F.expr("sequence(first, first + n - 1)")))
    block = permuted(F.pmod(F.col("slot"), F.col("cells")), F.col("rows"), F.col("columns"), F.lit(seed), F.col("rank"))
    return slots.select("shard", "rank", "slot", block.alias("block"), F.expr("slot div cells").alias("copy"), "n_blocks").where("block < n_blocks").drop("n_blocks")


def _segments(placed: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """Parts of documents in slots (rank, stream, lo, shard, slot, copy, from, to); from and to count words inside the document."""
    parts = placed.where("__size > 0").select(
        "rank", "__stream", "__lo", "__size", "__base", "__id",
        F.explode(F.expr(f"sequence(__lo div {block_words}, (__lo + __size - 1) div {block_words})")).alias("__b"),
    )
    parts = parts.select(
        "rank", "__stream", "__lo", "__size", "__id", (F.col("__base") + F.col("__b")).alias("block"),
        F.greatest(F.lit(0), F.col("__b") * block_words - F.col("__lo")).alias("from"),
        F.least(F.col("__size"), (F.col("__b") + 1) * block_words - F.col("__lo")).alias("to"),
    )
    # The plan is tiny and its slots are not: without the hint their size would be taken for the plan's and they'd be broadcast.
    return parts.join(slots.hint("merge"), ["rank", "block"])


def mix_slots(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 0, block_words: int = BLOCK_WORDS, stream_words: int = STREAM_WORDS) -> DataFrame:
    """The mix by slots: shard, source_rank, slot, block, id, from, to; a row for each document's part (words from .. to - 1) in a slot."""
    placed, plan = _layout(docs, text, id_col, source_col, [], seed, block_words, stream_words)
    found = _segments(placed, draw_slots(plan, seed), block_words)
    return found.select("shard", F.col("rank").alias("source_rank"), "slot", "block", F.col("__id").alias(id_col), "from", "to")


def mix_sources(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 0, block_words: int = BLOCK_WORDS, stream_words: int = STREAM_WORDS) -> DataFrame:
    """One row per document: id, size, source_size, target (its source's), taken (its words in the mix), n_shards (shards that hold some).

    Null text and texts without words have size 0 and nothing is taken; a
    null source is a source of its own, last in order.  Repeated rows each
    have their own place in a stream.  A block is taken twice at most, hence
    so is a document.  Runs agree as long as rows and parameters do.
    """
    placed, plan = _layout(docs, text, id_col, source_col, [], seed, block_words, stream_words)
    key = ["rank", "__stream", "__lo"]
    taken = _segments(placed, draw_slots(plan, seed), block_words).groupBy(*key).agg(F.sum(F.col("to") - F.col("from")).alias("taken"), F.count_distinct("shard").alias("n_shards"))
    with_words = placed.where("__size > 0").join(taken, key, "left")
    empty = placed.where("__size = 0").withColumns({"taken": F.lit(None).cast("long"), "n_shards": F.lit(None).cast("long")})
    columns = ["__id", "__size", "source_size", "target", "taken", "n_shards"]
    return with_words.select(columns).unionByName(empty.select(columns)).select(F.col("__id").alias(id_col), F.col("__size").alias("size"), "source_size", "target", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_shards")])


def mixed_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source_col: str = "source", length_col: str | None = "n_chars", seed: int = 0, block_words: int = BLOCK_WORDS, stream_words: int = STREAM_WORDS) -> DataFrame:
    """The mix itself, as documents with the columns of ``docs``.

    A document gives one row for the parts that the mix takes at least once
    and another for those it takes twice.  A row's text is those parts in
    order, with the white space before each word; a document taken whole is
    unchanged.  ``length_col``, where present, is counted anew.
    """
    names = docs.columns
    placed, plan = _layout(docs, text, id_col, source_col, names, seed, block_words, stream_words)
    key = ["rank", "__stream", "__lo"]
    copies = _segments(placed, draw_slots(plan, seed), block_words)
    parts = copies.groupBy(*key, "copy").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("parts"), F.sum(F.col("to") - F.col("from")).alias("words"))
    rows = placed.where("__size > 0").join(parts, key)
    at = {c: f"__p_{k}" for k, c in enumerate(names)}
    tokens = F.regexp_extract_all(F.col(at[text]), F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    cut = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice("__tokens", (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")))), "")
    whole = F.col("words") == F.col("__size")
    rows = rows.withColumn("__tokens", F.when(~whole, tokens)).withColumn("__text", F.when(whole, F.col(at[text])).otherwise(cut))

    def column(c: str) -> Column:
        if c == text:
            return F.col("__text").alias(c)
        if c == length_col:
            return F.length("__text").cast(docs.schema[c].dataType).alias(c)
        return F.col(at[c]).alias(c)

    return rows.select(*[column(c) for c in names])
