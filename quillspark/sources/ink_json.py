"""Documents as JSON: the model of `ink` written out, one file a document."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ink import BACKGROUNDS, DOCUMENT, FAMILIES, FIELDS
from ..shipping import ship_package
from .codecs import Malformed

VERSION = 1
#: A file of this kind has the version under a key that ends so, within its first `HEAD` characters.
KEY, HEAD = r'"(\w+_ir)"\s*:\s*(-?[0-9]+)', 4096
MARK = "quill_ir"


def is_ink_json(text):
    return F.regexp_like(F.substring(text, 1, HEAD), F.lit(KEY))


def parsed(texts: DataFrame) -> DataFrame:
    """(doc, DOCUMENT columns, broken) from (doc, json).

    ``broken`` tells why a row has no document: no version, another version,
    no JSON of this shape, or a name that the model does not have.  A null
    text is broken as well.
    """
    schema = DOCUMENT + ", broken string"
    doc = F.from_json("json", schema, {"columnNameOfCorruptRecord": "broken"})
    rows = texts.select("doc", F.regexp_extract(F.substring("json", 1, HEAD), KEY, 2).alias("version"), doc.alias("d"))
    strokes = F.flatten(F.flatten(F.transform("d.pages", lambda p: F.transform(p["layers"], lambda x: x["strokes"]))))
    family = F.exists(strokes, lambda s: ~F.coalesce(s["tool"]["family"].isin(*FAMILIES), F.lit(False)))
    background = F.exists("d.pages", lambda p: ~F.coalesce(p["background"]["type"], F.lit(BACKGROUNDS[0])).isin(*BACKGROUNDS))
    broken = (
        F.when(F.coalesce(F.col("version"), F.lit("")) != str(VERSION), F.concat(F.lit("unsupported version "), F.coalesce("version", F.lit(""))))
        .when(F.col("d").isNull() | F.col("d.broken").isNotNull(), "not a document")
        .when(F.coalesce(family, F.lit(False)), "unknown tool family")
        .when(F.coalesce(background, F.lit(False)), "unknown background")
    )
    rows = rows.withColumn("broken", broken)
    default = {"title": F.lit(""), "orientation": F.lit("portrait")}
    value = {c: F.coalesce(F.col(f"d.{c}"), default[c]) if c in default else F.col(f"d.{c}") for c in FIELDS}
    return rows.select("doc", *[F.when(F.col("broken").isNull(), value[c]).alias(c) for c in FIELDS], "broken")


def read_ink_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents of all ``*.json`` files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    return parsed(files.select(F.col("path").alias("doc"), F.decode("content", "utf-8").alias("json")))


def ink_json(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """(doc, text): one JSON text for each document; fields without a value are left out, points and numbers are kept exactly."""
    body = F.to_json(F.struct(F.lit(VERSION).alias(mark), *[F.col(c) for c in FIELDS]))
    return docs.select("doc", body.alias("text"))


def embedded(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Documents whose attachments kept as paths hold the bytes instead; ``files`` is (path, content)."""
    paths = docs.select("doc", F.explode("attachments").alias("key", "a")).where("a.path is not null").select("doc", "key", "a.path")
    found = paths.join(files.select("path", F.base64("content").alias("data")), "path")
    loaded = found.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("key", "data"))).alias("loaded"))
    item = lambda k, a: F.struct(F.coalesce(a["data"], F.col("loaded")[k]).alias("data"), F.when(F.col("loaded")[k].isNull(), a["path"]).alias("path"))
    return docs.join(loaded, "doc", "left").withColumn("attachments", F.when(F.col("loaded").isNull(), F.col("attachments")).otherwise(F.transform_values("attachments", item))).drop("loaded")


def decoded_documents(spark: SparkSession, path: str, decode: Callable[[bytes, str], dict], patterns: str) -> DataFrame:
    """(doc, DOCUMENT columns, broken) of the binary files below ``path`` whose names fit; ``decode`` takes bytes and title.

    A file that cannot be read keeps its row: ``broken`` tells why.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", patterns).load(path)

    def plain(value):
        if isinstance(value, bytes):
            return base64.b64encode(value).decode()
        raise TypeError(type(value).__name__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                title = doc.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                text, broken = None, None
                try:
                    text = json.dumps({MARK: VERSION} | decode(data, title), default=plain)
                except Malformed as e:
                    broken = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.string()), pa.array([text], pa.string()), pa.array([broken], pa.string())], names=["doc", "json", "unread"])

    texts = files.select("path", "content").mapInArrow(run, "doc string, json string, unread string")
    docs = parsed(texts).withColumnRenamed("broken", "shape")
    return docs.join(texts.select("doc", "unread"), "doc").withColumn("broken", F.coalesce("unread", "shape")).drop("unread", "shape")
