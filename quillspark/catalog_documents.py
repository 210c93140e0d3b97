"""Queries of the document model over the driver's tables: suppliers are documents, line numbers pages, line states layers, line items strokes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ink
from .catalog import query, table


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Nested documents; layer F is hidden, a page has an image behind it if its number is 7."""
    e = table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_linestatus").alias("layer"), F.col("l_orderkey").alias("k"),
        (F.col("l_quantity").cast("int") % 4).alias("n"), F.col("l_returnflag").alias("flag"), "l_tax", "l_discount",
    )
    row = F.sort_array(F.collect_list(F.struct("k", "n", "flag", "l_tax", "l_discount")))

    def stroke(r):
        xs = F.transform(F.sequence(F.lit(0), r["n"]), lambda i: i.cast("double"))
        xs = F.slice(xs, F.lit(1), r["n"])
        family = F.when(r["flag"] == "A", "highlighter").when(r["flag"] == "R", "eraser").otherwise("pen")
        wide = F.transform(F.sequence(F.lit(0), r["n"]), lambda i: r["l_tax"] * 100 + i)
        wide = F.slice(wide, F.lit(1), r["n"] + F.when(r["k"] % 11 == 0, 1).otherwise(0))
        channels = F.when(r["l_tax"] > 0.02, F.map_from_arrays(F.array(F.lit("width")), F.array(wide))).otherwise(F.create_map().cast("map<string,array<double>>"))
        color = F.struct(r["l_tax"].alias("r"), r["l_discount"].alias("g"), F.lit(0.5).alias("b"), F.lit(1.0).alias("a"))
        native = F.struct(F.lit("table").alias("format_id"), F.parse_json(F.lit("1")).alias("tool_id"), F.parse_json(F.lit("{}")).alias("params"))
        look = F.struct(F.lit(ink.MODES[1]).alias("mode"), color.alias("color"), F.lit(None).cast("double").alias("width"), r["l_discount"].alias("opacity"), F.lit("normal").alias("blend"), F.lit("round").alias("cap"), F.lit("round").alias("join"), F.lit(False).alias("underlay"))
        return F.struct(xs.alias("x"), xs.alias("y"), F.struct(family.alias("family"), native.alias("native")).alias("tool"), color.alias("color"), channels.alias("channels"), look.alias("appearance"), F.lit(None).cast("variant").alias("extra"))

    layers = e.groupBy("doc", "page", "layer").agg(row.alias("rows"))
    layers = layers.withColumn("strokes", F.transform("rows", stroke)).groupBy("doc", "page").agg(F.collect_list(F.struct("layer", "strokes")).alias("layers"))
    both = F.array(F.lit("F"), F.lit("O"))  # in this order, each at most once
    ordered = F.flatten(F.transform(both, lambda b: F.filter("layers", lambda x: x["layer"] == b)))
    none = lambda kind: F.lit(None).cast(kind)
    layer = F.transform(ordered, lambda x: F.struct(x["layer"].alias("name"), (x["layer"] == "O").alias("visible"), x["strokes"].alias("strokes"), F.array().cast(f"array<{ink.TEXT}>").alias("texts"), none(ink.RASTER).alias("raster")))
    background = F.when(F.col("page") == 7, F.from_json(F.lit('{"type": "image"}'), ink.BACKGROUND))
    bounds = F.struct(*[F.lit(v).alias(k) for k, v in (("x_min", 0.0), ("y_min", 0.0), ("x_max", 3.0), ("y_max", 3.0))])
    pages = layers.select("doc", F.struct(F.col("page").alias("page"), bounds.alias("bounds"), F.lit(1.0).alias("point_scale"), background.alias("background"), none("variant").alias("extra"), layer.alias("layers")).alias("p"))
    # Pages are put in the order of their numbers by a position, for structs with maps have no order.
    pages = pages.groupBy("doc").agg(F.collect_list("p").alias("all"))
    numbers = F.array_sort(F.transform("all", lambda p: p["page"]))
    inner = F.transform(numbers, lambda n: F.element_at(F.filter("all", lambda p: p["page"] == n), 1))
    cut = F.transform(inner, lambda p: F.struct(p["bounds"].alias("bounds"), p["point_scale"].alias("point_scale"), p["background"].alias("background"), p["extra"].alias("extra"), p["layers"].alias("layers")))
    return pages.select("doc", F.lit("table").alias("format_id"), F.col("doc").alias("title"), F.lit("portrait").alias("orientation"), none("variant").alias("metadata"), none("variant").alias("extra"), none("map<string,struct<data:string,path:string>>").alias("attachments"), cut.alias("pages"))


S = """s AS (SELECT CAST(l_suppkey AS VARCHAR) AS doc, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber) - 1 AS page_no, l_linenumber AS page, l_linestatus AS layer, l_orderkey AS k,
    CAST(floor(l_quantity) AS INT) % 4 AS n, CASE l_returnflag WHEN 'A' THEN 'highlighter' WHEN 'R' THEN 'eraser' ELSE 'pen' END AS family, l_tax AS tax, l_discount AS discount FROM lineitem)"""


@query(f"""WITH {S}, v AS (SELECT doc, page_no, family, count(*) AS c, sum(n) AS points, bool_or(tax > 0.02) AS wide FROM s WHERE layer = 'O' GROUP BY ALL),
    p AS (SELECT DISTINCT doc, page_no FROM s)
    SELECT doc, page_no, CAST(coalesce(sum(c), 0) AS BIGINT) AS strokes, CAST(coalesce(sum(points), 0) AS BIGINT) AS points,
    coalesce(string_agg(family || ':' || c, ',' ORDER BY family), '') AS tools, CASE WHEN bool_or(wide) THEN 'width' ELSE '' END AS channels FROM p LEFT JOIN v USING (doc, page_no) GROUP BY ALL""")
def inspect_documents(spark, d):
    """Visible strokes, points, strokes by tool and channels of each page."""
    found = ink.inspected(documents(spark, d))
    tools = F.array_join(F.transform("tools", lambda t: F.concat_ws(":", t["tool"], t["n"].cast("string"))), ",")
    return found.select("doc", F.col("page_no").cast("long").alias("page_no"), "strokes", "points", F.coalesce(tools, F.lit("")).alias("tools"), F.array_join("channels", ",").alias("channels"))


@query(f"WITH {S} SELECT doc, page_no, bool_or(layer = 'O' AND n > 0 AND discount > 0) OR any_value(page) = 7 AS has_content, bool_or(layer = 'O' AND n > 0 AND discount > 0) AS has_vectors FROM s GROUP BY doc, page_no")
def page_content(spark, d):
    """Pages with a visible drawable stroke or an image behind them."""
    docs = documents(spark, d)
    vectors = ink.pages_with_content(docs, vectors_only=True).withColumnRenamed("has_content", "has_vectors")
    return ink.pages_with_content(docs).join(vectors, ["doc", "page_no"]).select("doc", F.col("page_no").cast("long").alias("page_no"), "has_content", "has_vectors")


@query(f"""WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY doc, page_no ORDER BY k, n, family, tax, discount) - 1 AS nth FROM (SELECT * REPLACE (CASE family WHEN 'highlighter' THEN 'A' WHEN 'pen' THEN 'N' ELSE 'R' END AS family) FROM s WHERE layer = 'O')),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page_no, nth) AS place FROM r WHERE tax > 0.02 AND k % 11 = 0)
    SELECT doc, page_no, nth AS stroke_no, 'channel width has ' || (n + 1) || ' values for ' || n || ' points' AS problem FROM b WHERE place = 1""")
def first_problems(spark, d):
    """The first visible stroke of each document whose arrays differ in length."""
    return ink.first_problem(documents(spark, d)).select("doc", F.col("page_no").cast("long").alias("page_no"), F.col("stroke_no").cast("long").alias("stroke_no"), "problem")


@query(f"""WITH {S} SELECT doc, page_no, CASE WHEN family = 'highlighter' THEN 'stroked_constant' ELSE 'stroked_variable' END AS mode, family = 'highlighter' AS underlay,
    CASE WHEN family = 'highlighter' THEN 'darken' ELSE 'normal' END AS blend, CASE WHEN family = 'highlighter' THEN 'square' ELSE 'round' END AS cap,
    count(*) AS strokes, round(sum(CASE WHEN family = 'highlighter' THEN 0.85 ELSE 1.0 END), 4) AS opacity,
    round(coalesce(sum(CASE WHEN family = 'highlighter' THEN CASE WHEN tax > 0.02 AND n + (CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END) > 0 THEN tax * 100 ELSE 2.0 END END), 0), 4) AS width,
    round(sum(CASE WHEN family = 'eraser' THEN 1.0 ELSE tax END), 4) AS red FROM s WHERE layer = 'O' GROUP BY ALL""")
def restyle_documents(spark, d):
    """What strokes look like by their family alone, summed by page and look."""
    a = ink.restyled(ink.visible(ink.strokes_of(documents(spark, d)))).select("doc", F.col("page_no").cast("long").alias("page_no"), "appearance.*")
    four = lambda c, name: F.round(c, 4).alias(name)
    return a.groupBy("doc", "page_no", "mode", "underlay", "blend", "cap").agg(F.count(F.lit(1)).alias("strokes"), four(F.sum("opacity"), "opacity"), four(F.coalesce(F.sum("width"), F.lit(0.0)), "width"), four(F.sum("color.r"), "red"))


@query(f"WITH {S} SELECT doc, page_no, layer AS name, count(*) AS strokes, CAST(sum(n) AS BIGINT) AS points FROM s WHERE layer = 'O' GROUP BY ALL")
def visible_layers(spark, d):
    """Layers that are shown, with their strokes and points."""
    found = ink.visible(ink.layers_of(documents(spark, d)))
    points = F.aggregate("strokes", F.lit(0), lambda a, s: a + F.size(s["x"]))
    return found.select("doc", F.col("page_no").cast("long").alias("page_no"), "name", F.size("strokes").cast("long").alias("strokes"), points.cast("long").alias("points"))
