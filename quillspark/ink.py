"""The document model: one row for each document, pages, layers and strokes nested in it, and views by page and by stroke.

Open parts (metadata, extras, a tool's parameters) are variants; a stroke's
points are parallel arrays, its channels a map of such arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLOR = "struct<r:double,g:double,b:double,a:double>"
BOUNDS = "struct<x_min:double,y_min:double,x_max:double,y_max:double>"
APPEARANCE = f"struct<mode:string,color:{COLOR},width:double,opacity:double,blend:string,cap:string,join:string,underlay:boolean>"
TOOL = "struct<family:string,native:struct<format_id:string,tool_id:variant,params:variant>>"
STROKE = f"struct<x:array<double>,y:array<double>,tool:{TOOL},color:{COLOR},channels:map<string,array<double>>,appearance:{APPEARANCE},extra:variant>"
TEXT = f"struct<x:double,y:double,text:string,font_size:double,color:{COLOR},extra:variant>"
#: Image bytes are base64 text.
RASTER = f"struct<data:string,format:string,bounds:{BOUNDS}>"
LAYER = f"struct<name:string,visible:boolean,strokes:array<{STROKE}>,texts:array<{TEXT}>,raster:{RASTER}>"
#: One of four, by ``type``: template, pdf, image, color.
BACKGROUND = f"struct<type:string,kind:string,name:string,pitch:double,line_width:double,dot_radius:double,gray:double,attachment_key:string,page_index:int,image:{RASTER},color:{COLOR}>"
PAGE = f"struct<bounds:{BOUNDS},point_scale:double,background:{BACKGROUND},extra:variant,layers:array<{LAYER}>>"
DOCUMENT = f"format_id string, title string, orientation string, metadata variant, extra variant, attachments map<string,struct<data:string,path:string>>, pages array<{PAGE}>"
FIELDS = ["format_id", "title", "orientation", "metadata", "extra", "attachments", "pages"]

#: Tool families, modes of geometry, blending and line ends.
FAMILIES = ("pen", "ballpoint", "fineliner", "pencil", "mechanical_pencil", "marker", "highlighter", "shader", "brush", "calligraphy", "eraser", "unknown")
MODES = ("stroked_constant", "stroked_variable", "filled_outline")
BACKGROUNDS = ("template", "pdf", "image", "color")
FALLBACK_WIDTH = 2.0


def pages_of(docs: DataFrame) -> DataFrame:
    """(doc, page_no, bounds, point_scale, background, layers) in order from 0."""
    return docs.select("doc", F.posexplode("pages").alias("page_no", "p")).select("doc", "page_no", "p.bounds", "p.point_scale", "p.background", "p.layers")


def layers_of(docs: DataFrame) -> DataFrame:
    """(doc, page_no, layer_no, name, visible, strokes, texts, raster); a layer is visible unless it says otherwise."""
    layers = pages_of(docs).select("doc", "page_no", F.posexplode("layers").alias("layer_no", "l"))
    return layers.select("doc", "page_no", "layer_no", F.coalesce("l.name", F.lit("")).alias("name"), F.coalesce("l.visible", F.lit(True)).alias("visible"), "l.strokes", "l.texts", "l.raster")


def strokes_of(docs: DataFrame) -> DataFrame:
    """One row for each stroke: doc, page_no, layer_no, visible, stroke_no and the stroke's fields."""
    strokes = layers_of(docs).select("doc", "page_no", "layer_no", "visible", F.posexplode("strokes").alias("stroke_no", "s"))
    return strokes.select("doc", "page_no", "layer_no", "visible", "stroke_no", "s.*")


def visible(rows: DataFrame) -> DataFrame:
    """Strokes or layers that are shown."""
    return rows.where("visible")


def channel(name: str) -> Column:
    return F.col("channels")[name]


def is_drawable() -> Column:
    """A stroke has points, and its first alpha, or else its opacity, is not zero."""
    alpha = F.coalesce(F.get(channel("alpha"), F.lit(0)), F.col("appearance.opacity"), F.lit(1.0))
    return (F.coalesce(F.size("x"), F.lit(0)) > 0) & (alpha > 0)


def pages_with_content(docs: DataFrame, vectors_only: bool = False) -> DataFrame:
    """(doc, page_no, has_content): a visible drawable stroke, an image behind the page, or a visible raster layer.

    With ``vectors_only`` only strokes count.  Pages without layers are told as well.
    """
    drawn = visible(strokes_of(docs)).where(is_drawable()).select("doc", "page_no").distinct().withColumn("drawn", F.lit(True))
    shown = F.exists("layers", lambda x: F.coalesce(x["visible"], F.lit(True)) & x["raster"].isNotNull())
    other = F.lit(False) if vectors_only else F.coalesce(F.col("background.type") == "image", F.lit(False)) | F.coalesce(shown, F.lit(False))
    return pages_of(docs).join(drawn, ["doc", "page_no"], "left").select("doc", "page_no", (F.coalesce("drawn", F.lit(False)) | other).alias("has_content"))


def problems(docs: DataFrame) -> DataFrame:
    """(doc, page_no, stroke_no, problem) of visible strokes whose arrays differ in length; strokes are numbered over the page's visible layers."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc", "page_no").orderBy("layer_no", "stroke_no")
    strokes = visible(strokes_of(docs)).withColumn("nth", F.row_number().over(order) - 1)
    n = F.size("x")
    odd = F.array_sort(F.map_keys(F.map_filter("channels", lambda k, v: F.size(v) != n)))
    problem = F.when(n != F.size("y"), F.format_string("x has %d values and y %d", n, F.size("y"))).when(F.size(odd) > 0, F.format_string("channel %s has %d values for %d points", odd[0], F.size(F.col("channels")[odd[0]]), n))
    return strokes.select("doc", "page_no", F.col("nth").alias("stroke_no"), problem.alias("problem")).where("problem is not null")


def first_problem(docs: DataFrame) -> DataFrame:
    """(doc, page_no, stroke_no, problem): the first of each document that has any."""
    return problems(docs).groupBy("doc").agg(F.min(F.struct("page_no", "stroke_no", "problem")).alias("p")).select("doc", "p.*")


def default_appearance(family: Column, color: Column, widths: Column) -> Column:
    """How a stroke looks by its tool's family alone; a constant width is the first of its widths."""
    first = F.coalesce(F.get(widths, F.lit(0)), F.lit(FALLBACK_WIDTH))
    constant, under = family.isin("highlighter", "fineliner"), family.isin("highlighter", "shader")
    white = F.struct(*[F.lit(1.0).alias(c) for c in "rgba"])
    look = {
        "mode": F.when(constant, MODES[0]).otherwise(MODES[1]),
        "color": F.when(family == "eraser", white).otherwise(color),
        "width": F.when(constant, first),
        "opacity": F.when(family == "highlighter", 0.85).when(family == "shader", 0.45).otherwise(1.0),
        "blend": F.when(under, "darken").otherwise("normal"),
        "cap": F.when(under, "square").otherwise("round"),
        "join": F.lit("round"),
        "underlay": under,
    }
    return F.struct(*[c.alias(k) for k, c in look.items()]).cast(APPEARANCE)


def restyled(strokes: DataFrame, reserved: str | None = None) -> DataFrame:
    """Strokes that look as their family does; ``reserved`` names a key of ``extra`` that goes."""
    out = strokes.withColumn("appearance", default_appearance(F.col("tool.family"), F.col("color"), channel("width")))
    if reserved is not None:
        rest = F.map_filter(F.from_json(F.to_json("extra"), "map<string,variant>"), lambda k, v: k != reserved)
        out = out.withColumn("extra", F.when(F.col("extra").isNotNull(), F.parse_json(F.to_json(rest))))
    return out


def inspected(docs: DataFrame) -> DataFrame:
    """One row a page: its visible strokes, points, strokes by tool (sorted by name) and the channels that occur."""
    s = visible(strokes_of(docs))
    name = F.coalesce("tool.family", F.lit("unknown"))
    tools = s.groupBy("doc", "page_no", name.alias("tool")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("x")).cast("long").alias("points"), F.array_distinct(F.flatten(F.collect_set(F.map_keys("channels")))).alias("channels"))
    pages = tools.groupBy("doc", "page_no").agg(
        F.sum("n").alias("strokes"), F.sum("points").alias("points"), F.array_sort(F.collect_list(F.struct("tool", "n"))).alias("tools"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("channels")))).alias("channels")
    )
    every = pages_of(docs).select("doc", "page_no")
    empty = F.array().cast("array<string>")
    return every.join(pages, ["doc", "page_no"], "left").select("doc", "page_no", F.coalesce("strokes", F.lit(0)).alias("strokes"), F.coalesce("points", F.lit(0)).alias("points"), "tools", F.coalesce("channels", empty).alias("channels"))


def first_pages(docs: DataFrame, n: int) -> DataFrame:
    """Documents cut to their first ``n`` pages."""
    return docs.withColumn("pages", F.slice("pages", 1, n))


def selected_pages(docs: DataFrame, numbers: list[int]) -> DataFrame:
    """Documents with the pages (from 0) named, in that order; those that a document lacks are left out of it."""
    wanted = F.array(*[F.lit(n) for n in numbers]).cast("array<int>")
    have = F.filter(wanted, lambda n: n < F.size("pages"))
    return docs.withColumn("pages", F.transform(have, lambda n: F.get(F.col("pages"), n)))


def flat_strokes(docs: DataFrame) -> DataFrame:
    """Visible strokes in the flat form that text sinks take, coordinates in points from the page's corner."""
    pages = pages_of(docs).select("doc", "page_no", F.col("bounds").alias("pb"), F.coalesce("point_scale", F.lit(1.0)).alias("k"))
    s = visible(strokes_of(docs)).join(pages, ["doc", "page_no"])
    color = F.coalesce("appearance.color", "color")
    byte = lambda c: F.lpad(F.lower(F.hex(F.bround(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))), 2, "0")
    width = F.coalesce(channel("width"), F.transform("x", lambda _: F.coalesce(F.col("appearance.width"), F.lit(FALLBACK_WIDTH))))
    return s.select(
        "doc", F.col("page_no").alias("page"), F.col("layer_no").alias("layer"), F.col("stroke_no").alias("stroke"), F.coalesce("tool.family", F.lit("pen")).alias("tool"),
        F.concat(F.lit("#"), byte(color["r"]), byte(color["g"]), byte(color["b"])).alias("color"), F.coalesce("appearance.opacity", F.lit(1.0)).alias("opacity"),
        F.transform("x", lambda v: (v - F.col("pb.x_min")) * F.col("k")).alias("x"), F.transform("y", lambda v: (v - F.col("pb.y_min")) * F.col("k")).alias("y"),
        F.transform(width, lambda v: v * F.col("k")).alias("width"), channel("pressure").alias("pressure"), (F.coalesce("appearance.mode", F.lit(MODES[1])) == MODES[0]).alias("constant"),
    )
