"""Detection of note formats, and scans of JSON scenes, library caches and folders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Format:
    name: str
    extensions: tuple[str, ...]
    marks: tuple[str, ...]  # a file's head holds one of them
    at_start: bool = True


#: Names, extensions and marks of public file formats, in order of priority.
FORMATS: list[Format] = [
    Format("xopp", (".xopp",), ("\x1f", "<?xml")),
    Format("inkml", (".inkml",), ("<ink", "inkml"), False),
    Format("excalidraw", (".excalidraw",), ('"excalidraw"',), False),
    Format("tldraw", (".tldr",), ("tldrawFileFormatVersion",), False),
    Format("svg", (".svg",), ("<svg",), False),
    Format("zip", (".note", ".goodnotes", ".sbn2", ".nebo"), ("PK",)),
]
HEAD = 4096


def register(fmt: Format) -> None:
    """A format registered later has a lower priority."""
    FORMATS.append(fmt)


def _fits(fmt: Format, head: Column) -> Column:
    tests = [head.startswith(m) if fmt.at_start else head.contains(m) for m in fmt.marks]
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def detect(path: Column, head: Column) -> Column:
    """Format of a file: the first whose extension and head both fit, else the first whose head fits, else null."""
    low = F.lower(path)
    case = None
    for by_extension in (True, False):
        for fmt in FORMATS:
            named = F.lit(False)
            for e in fmt.extensions:
                named = named | low.endswith(e)
            test = _fits(fmt, head) & (named if by_extension else F.lit(True))
            case = F.when(test, fmt.name) if case is None else case.when(test, fmt.name)
    return case


def format_for_output(path: str) -> str | None:
    low = path.lower()
    return next((f.name for f in FORMATS if any(low.endswith(e) for e in f.extensions)), None)


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, size, format) of every file below ``root``; names with a dot part are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    head = F.decode(F.substring("content", 1, HEAD), "iso-8859-1")
    return files.where(~F.col("path").rlike(r"/\.[^/]+")).select("path", F.unix_millis("modificationTime").alias("modified"), F.col("length").alias("size"), detect(F.col("path"), head).alias("format"))


SCENE = "type string, elements array<struct<id:string,type:string,x:double,y:double,width:double,height:double,strokeColor:string,strokeWidth:double,opacity:double,isDeleted:boolean,points:array<array<double>>,pressures:array<double>,text:string>>"


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Strokes (doc, stroke_no, kind, x, y, pressure, color, width, opacity) of JSON scenes; deleted elements vanish.

    Points are relative to their element; a rectangle becomes its outline.
    """
    docs = spark.read.schema(SCENE).option("multiLine", "true").json(path).withColumn("doc", F.col("_metadata.file_path"))
    e = docs.select("doc", F.posexplode("elements").alias("stroke_no", "e")).where(~F.coalesce("e.isDeleted", F.lit(False))).select("doc", "stroke_no", "e.*")
    corner = lambda dx, dy: F.array(F.col("width") * dx, F.col("height") * dy)
    outline = F.array(*[corner(a, b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    pts = F.when(F.col("type").isin("freedraw", "line", "arrow"), F.col("points")).when(F.col("type") == "rectangle", outline)
    return e.withColumn("pts", pts).where("pts is not null").select(
        "doc", "stroke_no", F.col("type").alias("kind"), F.transform("pts", lambda p: p[0] + F.col("x")).alias("x"), F.transform("pts", lambda p: p[1] + F.col("y")).alias("y"),
        F.col("pressures").alias("pressure"), F.col("strokeColor").alias("color"), F.col("strokeWidth").alias("width"), (F.coalesce("opacity", F.lit(100.0)) / 100).alias("opacity"),
    )


def read_library(spark: SparkSession, root: str) -> DataFrame:
    """(id, name, parent, modified, doc_type) of a library cache's ``*.metadata`` files; corrupt and deleted ones are left out."""
    schema = "visibleName string, parent string, type string, lastModified string, deleted boolean, broken string"
    m = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").option("pathGlobFilter", "*.metadata").json(root)
    ident = F.regexp_extract("_metadata.file_path", r"([^/]+)\.metadata$", 1)
    return m.where(F.col("broken").isNull() & ~F.coalesce("deleted", F.lit(False))).select(ident.alias("id"), F.col("visibleName").alias("name"), F.coalesce("parent", F.lit("")).alias("parent"), F.col("lastModified").cast("long").alias("modified"), F.col("type").alias("doc_type"))


CONTENT = "fileType string, orientation string, cPages struct<pages:array<struct<id:string,deleted:variant,template:struct<value:string>>>>, pages array<string>, broken string"


def library_documents(spark: SparkSession, root: str) -> DataFrame:
    """(id, name, parent, modified, file_type, orientation, pages) of a library cache's documents, from ``*.metadata`` and ``*.content``.

    ``pages`` lists (id, template) in order without deleted pages; older files
    name their pages only.  A document whose content is missing or broken has
    no pages and the defaults.
    """
    meta = read_library(spark, root).where("doc_type = 'DocumentType' or doc_type is null").drop("doc_type")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.content").load(root)
    c = files.select(F.regexp_extract("path", r"([^/]+)\.content$", 1).alias("id"), F.from_json(F.decode("content", "utf-8"), CONTENT, {"columnNameOfCorruptRecord": "broken"}).alias("c")).where("c.broken is null")
    page = lambda ident, template: F.struct(ident.alias("id"), F.coalesce(template, F.lit("")).alias("template"))
    listed = F.transform(F.filter("c.cPages.pages", lambda p: p["deleted"].isNull()), lambda p: page(p["id"], p["template"]["value"]))
    older = F.transform("c.pages", lambda p: page(p, F.lit("")))
    none = F.array().cast("array<struct<id:string,template:string>>")
    rows = c.select("id", F.col("c.fileType").alias("file_type"), F.col("c.orientation").alias("orientation"), F.coalesce(listed, older).alias("pages"))
    return meta.join(rows, "id", "left").select("id", F.coalesce("name", "id").alias("name"), "parent", "modified", F.coalesce("file_type", F.lit("notebook")).alias("file_type"), F.coalesce("orientation", F.lit("portrait")).alias("orientation"), F.coalesce("pages", none).alias("pages"))


def listed(docs: DataFrame, folders: DataFrame) -> DataFrame:
    """Documents that are not in the trash with their folder, in the order of folder and name; ``folders`` is (id, path, trashed) of all nodes."""
    at = folders.select("id", F.regexp_replace("path", "(^|/)[^/]*$", "").alias("folder"), "trashed")
    return docs.join(at, "id").where("not trashed").drop("trashed").orderBy("folder", "name", "id")
