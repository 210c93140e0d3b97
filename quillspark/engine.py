"""Conversion between ink formats, and the registry of readers and writers behind it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ink
from .plans import ink_xml
from .shipping import ship_package
from .sources import ink_binary, ink_json, xml_ink


class NotSupported(ValueError):
    """No reader or writer, a page that is not there, or an output that may not be written."""


@dataclass(frozen=True)
class Sink:
    write: Callable[[DataFrame], DataFrame]  # one row (doc, text) for each document
    extension: str
    validated: bool = True


#: Readers of whole documents, and of flat strokes.
DOCUMENTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"json": ink_json.read_ink_json} | {n: ink_binary.reader(n) for n in ink_binary.DECODERS}
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"xopp": xml_ink.read_xopp, "inkml": xml_ink.read_inkml, "svg": xml_ink.read_svg, "tldraw": xml_ink.read_tldraw}


def _flat(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: ink.flat_strokes(DOCUMENTS[name](spark, path).where("broken is null"))


READERS |= {name: _flat(name) for name in DOCUMENTS}
#: Formats by the extensions of their files, where the two differ.
EXTENSIONS = {"tldr": "tldraw", "sba": "saber", "sbn": "saber", "sbn2": "saber", "pkdrawing": "pencilkit"}
#: Size of pages that do not tell their own, in points (US letter).
PAGE = (612.0, 792.0)
SINKS: dict[str, Sink] = {
    "xopp": Sink(lambda s: ink_xml.xopp(s, *PAGE), ".xopp"),
    "inkml": Sink(ink_xml.inkml, ".inkml"),
    "excalidraw": Sink(ink_xml.scene, ".excalidraw", validated=False),
}


def formats(spark: SparkSession) -> DataFrame:
    """(format, reads, writes, validated) of everything registered."""
    rows = [(n, n in READERS, n in SINKS, n in SINKS and SINKS[n].validated) for n in sorted(READERS.keys() | SINKS.keys())]
    return spark.createDataFrame(rows, "format string, reads boolean, writes boolean, validated boolean")


def parse_pages(text: str) -> list[int]:
    """Pages (from 0) of ``1-3,7``: in the order given, repeats kept; a range backwards is empty."""
    found: list[int] = []
    for part in text.split(","):
        a, dash, b = part.strip().partition("-")
        try:
            first, last = int(a), int(b) if dash else int(a)
        except ValueError:
            raise NotSupported(f"not a page selection: {part!r}") from None
        if first < 1:
            raise NotSupported(f"pages count from 1: {part!r}")
        found += range(first - 1, last)
    return found


def select_pages(strokes: DataFrame, pages: list[int]) -> DataFrame:
    """The pages named, numbered anew in that order; the filter comes before the join, on a list as long as the selection."""
    spark = strokes.sparkSession
    wanted = spark.createDataFrame(list(enumerate(pages)), "nth int, page int")
    return strokes.join(F.broadcast(wanted), "page").withColumn("page", F.col("nth")).select(*strokes.columns)


def read(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Strokes of the files of one format below ``path``; the format follows from the name unless given."""
    ending = path.rsplit(".", 1)[-1].lower()
    fmt = fmt or EXTENSIONS.get(ending, ending)
    if fmt not in READERS:
        raise NotSupported(f"no reader for {fmt!r}")
    return READERS[fmt](spark, path)


def check_target(source: str, target: str, protected: tuple[str, ...] = ()) -> None:
    """An output folder must neither be nor hold the source or a protected folder, and must not lie in a protected one."""
    plain = lambda p: re.sub(r"^file:/+", "/", p).rstrip("/") + "/"
    out = plain(target)
    for other in (source, *protected):
        if plain(other).startswith(out) or other in protected and out.startswith(plain(other)):
            raise NotSupported(f"{target!r} would overwrite {other!r}")


def convert(spark: SparkSession, source: str, target: str, to: str, fmt: str | None = None, pages: str | None = None, experimental: bool = False, protected: tuple[str, ...] = ()) -> int:
    """Convert every document below ``source`` and write one text file each below ``target``; returns how many.

    Executors write the files themselves, so no document passes through the
    driver.  A page of the selection that a document lacks is left out of it;
    one that no document has is an error, as is a sink that is not validated
    unless ``experimental`` is set, and a target that would overwrite the source
    or a ``protected`` folder.
    """
    check_target(source, target, protected)
    if to not in SINKS:
        raise NotSupported(f"no writer for {to!r}")
    sink = SINKS[to]
    if not (sink.validated or experimental):
        raise NotSupported(f"{to} output is experimental")
    ship_package(spark)
    strokes = read(spark, source, fmt)
    if pages is not None:
        wanted = parse_pages(pages)
        most = strokes.agg(F.max("page")).first()[0]
        beyond = sorted({p + 1 for p in wanted if most is None or p > most})
        if beyond:
            raise NotSupported(f"no document has pages {', '.join(map(str, beyond))}")
        strokes = select_pages(strokes, wanted)
    name = F.regexp_replace(F.element_at(F.split("doc", "/"), -1), r"\.[^.]*$", "")
    # Documents of the same name in different folders are told apart by a digest of their path.
    files = sink.write(strokes).withColumn("name", F.concat(name, F.lit("-"), F.substring(F.md5("doc"), 1, 8)))
    files.select("name", F.col("text").alias("value")).write.mode("overwrite").partitionBy("name").option("lineSep", "\n").text(target)
    return spark.read.text(target).select("name").distinct().count()
