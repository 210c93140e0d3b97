"""SVG pages from strokes, built as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(c: Column, places: int = 2) -> Column:
    """Shortest form with at most ``places`` decimals; no negative zero."""
    text = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{places}f", c.cast("double")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(text == "-0", "0").otherwise(text)


def elements(strokes: DataFrame) -> DataFrame:
    """Add ``element``: a circle for one point, else a stroked path; from x, y (arrays), color, width, opacity."""
    xy = F.zip_with("x", "y", lambda x, y: F.concat(number(x), F.lit(","), number(y)))
    attributes = F.concat(F.lit('stroke="'), F.col("color"), F.lit('" stroke-width="'), number(F.col("width")), F.lit('" opacity="'), number(F.col("opacity")), F.lit('"'))
    dot = F.concat(F.lit('<circle cx="'), number(F.col("x")[0]), F.lit('" cy="'), number(F.col("y")[0]), F.lit('" r="'), number(F.col("width") / 2), F.lit('" fill="'), F.col("color"), F.lit('"/>'))
    path = F.concat(F.lit('<path fill="none" '), attributes, F.lit(' d="M'), F.array_join(xy, " L"), F.lit('"/>'))
    return strokes.where(F.size("x") > 0).withColumn("element", F.when(F.size("x") == 1, dot).otherwise(path))


def pages(strokes: DataFrame, width: float, height: float) -> DataFrame:
    """(doc, svg): one page per document; underlay strokes first, then by number."""
    order = F.struct((~F.coalesce("underlay", F.lit(False))).alias("over"), "stroke_no", "element")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda s: s["element"]), "\n")
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} {height:g}">\n'
    return elements(strokes).groupBy("doc").agg(F.concat(F.lit(head), body, F.lit("\n</svg>\n")).alias("svg"))
