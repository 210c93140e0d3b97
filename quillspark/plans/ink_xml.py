"""Xournal++, InkML and JSON scenes from strokes (the columns of ``sources.xml_ink``), built as text in the JVM.

Each function returns one row a document; a document's pages are folded
together only here, where its file needs them in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.forms import number_text


def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _numbers(values: Column, places: int) -> Column:
    return F.transform(values, lambda v: number_text(v, places))


def _folded(rows: DataFrame, by: list[str], order: str, text: str, head: Column, tail: str) -> DataFrame:
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "")
    return rows.groupBy(*by).agg(F.concat(head, parts, F.lit(tail)).alias("text"))


def xopp(strokes: DataFrame, width: float, height: float) -> DataFrame:
    """(doc, text): a stroke of one point becomes a short line, for the format has no points."""
    x, y = (F.when(F.size(c) == 1, F.array(F.get(c, F.lit(0)), F.get(c, F.lit(0)) + step)).otherwise(F.col(c)) for c, step in (("x", 0.001), ("y", 0.0)))
    points = F.array_join(F.flatten(F.zip_with(_numbers(x, 6), _numbers(y, 6), lambda a, b: F.array(a, b))), " ")
    one = F.coalesce(F.get("width", F.lit(0)), F.lit(2.0))
    widths = F.when(F.col("constant") | (F.size("width") < 2), number_text(one, 6)).otherwise(F.array_join(_numbers(F.col("width"), 6), " "))
    alpha = F.lpad(F.lower(F.hex(F.bround(F.col("opacity") * 255).cast("long"))), 2, "0")
    stroke = F.concat(F.lit('<stroke tool="'), _escaped(F.col("tool")), F.lit('" color="'), _escaped(F.col("color")), alpha, F.lit('" width="'), widths, F.lit('">'), points, F.lit("</stroke>"))
    rows = strokes.where(F.size("x") > 0).withColumn("text", stroke)
    layers = _folded(rows, ["doc", "page", "layer"], "stroke", "text", F.lit("<layer>"), "</layer>")
    page = f'<page width="{width:g}" height="{height:g}"><background type="solid" color="#ffffffff" style="plain"/>'
    pages = _folded(layers, ["doc", "page"], "layer", "text", F.lit(page), "</page>")
    return _folded(pages, ["doc"], "page", "text", F.lit('<?xml version="1.0" standalone="no"?><xournal fileversion="4">'), "</xournal>")


def inkml(strokes: DataFrame) -> DataFrame:
    """(doc, text): pages and layers are nested trace groups; brushes get their ids by what they are, so equal ones are written once."""
    width = F.when(F.col("constant"), F.get("width", F.lit(0)))
    # A document's brushes are numbered by the first stroke that has them.
    brush = F.struct("color", "opacity", width.alias("w"))
    rows = strokes.where(F.size("x") > 0).withColumn("brush", brush).withColumn("place", F.struct("page", "layer", "stroke"))
    first = rows.groupBy("doc", "brush").agg(F.min("place").alias("first"))
    from pyspark.sql import Window

    ids = first.withColumn("b", F.row_number().over(Window.partitionBy("doc").orderBy("first")) - 1)
    prop = lambda n, v: F.coalesce(F.concat(F.lit(f'<brushProperty name="{n}" value="'), v, F.lit('"/>')), F.lit(""))
    body = F.concat(F.lit('<brush xml:id="b'), F.col("b").cast("string"), F.lit('">'), prop("color", _escaped(F.col("brush.color"))), prop("transparency", number_text(1 - F.col("brush.opacity"), 4)), prop("width", number_text(F.col("brush.w"), 4)), F.lit("</brush>"))
    brushes = _folded(ids.withColumn("text", body), ["doc"], "b", "text", F.lit(""), "").withColumnRenamed("text", "brushes")
    columns = F.zip_with(_numbers(F.col("x"), 4), _numbers(F.col("y"), 4), lambda a, b: F.concat_ws(" ", a, b))
    varied = F.zip_with(columns, _numbers(F.col("width"), 4), lambda a, b: F.concat_ws(" ", a, b))
    trace = F.concat(F.lit('<trace contextRef="#'), F.when(F.col("constant"), "c0").otherwise("c1"), F.lit('" brushRef="#b'), F.col("b").cast("string"), F.lit('">'), F.array_join(F.when(F.col("constant"), columns).otherwise(varied), ","), F.lit("</trace>"))
    traces = rows.join(ids.select("doc", "brush", "b"), (rows["doc"] == ids["doc"]) & rows["brush"].eqNullSafe(ids["brush"])).drop(ids["doc"]).withColumn("text", trace)
    layers = _folded(traces, ["doc", "page", "layer"], "stroke", "text", F.lit("<traceGroup>"), "</traceGroup>")
    pages = _folded(layers, ["doc", "page"], "layer", "text", F.lit("<traceGroup>"), "</traceGroup>")
    whole = _folded(pages, ["doc"], "page", "text", F.lit(""), "</ink>")
    channel = lambda names: "".join(f'<channel name="{n}" type="decimal"/>' for n in names)
    head = '<ink xmlns="http://www.w3.org/2003/InkML"><definitions>' + "".join(f'<context xml:id="c{k}"><traceFormat>{channel(n)}</traceFormat></context>' for k, n in enumerate(("XY", "XYW")))
    return whole.join(brushes, "doc").select("doc", F.concat(F.lit(head), "brushes", F.lit("</definitions>"), "text").alias("text"))


def scene(strokes: DataFrame) -> DataFrame:
    """(doc, text): a JSON scene of the first page."""
    number = lambda c: number_text(c, 2).cast("double")
    x0, y0 = F.get("x", F.lit(0)), F.get("y", F.lit(0))
    element = F.struct(
        F.concat_ws("-", F.lit("s"), "layer", "stroke").alias("id"), F.lit("freedraw").alias("type"), number(x0).alias("x"), number(y0).alias("y"), F.col("color").alias("strokeColor"),
        F.coalesce(F.array_max("width"), F.lit(1.0)).alias("strokeWidth"), F.bround(F.col("opacity") * 100).alias("opacity"), F.lit(False).alias("isDeleted"),
        F.zip_with("x", "y", lambda a, b: F.array(number(a - x0), number(b - y0))).alias("points"), F.coalesce("pressure", F.array().cast("array<double>")).alias("pressures"), F.col("pressure").isNull().alias("simulatePressure"),
    )
    rows = strokes.where((F.size("x") > 0) & (F.col("page") == 0)).select("doc", F.struct("layer", "stroke").alias("at"), element.alias("e"))
    elements = F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda s: s["e"])
    return rows.groupBy("doc").agg(F.to_json(F.struct(F.lit("excalidraw").alias("type"), F.lit(2).alias("version"), elements.alias("elements"))).alias("text"))
