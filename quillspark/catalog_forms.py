"""More queries of the library beside their SQL: forms, array operators, joins and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import DECIDED, N, P, QUERIES, SQL, decided, notes, points, query, r6, table
from .functions import forms
from .operators import arrays

E64 = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def doubles(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


@query("WITH t AS (SELECT p_partkey AS id, CAST(p_size AS VARCHAR) || CASE p_partkey % 6 WHEN 0 THEN 'mm' WHEN 1 THEN 'in' WHEN 2 THEN 'px' WHEN 3 THEN '' WHEN 4 THEN 'cm' ELSE '%' END AS text FROM part) SELECT id, round(p.f * CAST(regexp_extract(text, '[0-9]+') AS DOUBLE), 6) AS pt FROM t LEFT JOIN (VALUES ('pt', 1.0), ('px', 0.75), ('', 0.75), ('in', 72.0), ('mm', 72.0 / 25.4), ('cm', 72.0 / 2.54), ('pc', 12.0)) p(unit, f) ON unit = regexp_extract(text, '[a-z%]*$')")
def css_lengths(spark, d):
    """Lengths with a unit in points; unknown units are null."""
    k = F.col("p_partkey") % 6
    unit = F.when(k == 0, "mm").when(k == 1, "in").when(k == 2, "px").when(k == 3, "").when(k == 4, "cm").otherwise("%")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), r6(forms.length_in_points(F.concat(F.col("p_size").cast("string"), unit)), "pt"))


@query("WITH c AS (SELECT p_partkey AS id, p_partkey * 7919 % 16777216 AS n, p_partkey % 5 AS k FROM part), t AS (SELECT id, k, n // 65536 AS r, n // 256 % 256 AS g, n % 256 AS b FROM c) SELECT id, CASE k WHEN 0 THEN round(r / 255, 6) WHEN 1 THEN round(r / 255, 6) WHEN 2 THEN round((r % 16) * 17 / 255, 6) WHEN 3 THEN 1.0 END AS r, CASE k WHEN 0 THEN round(g / 255, 6) WHEN 1 THEN round(g / 255, 6) WHEN 2 THEN round((g % 16) * 17 / 255, 6) WHEN 3 THEN 0.0 END AS g, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN round(b / 255, 6) WHEN 2 THEN 1.0 WHEN 3 THEN 1.0 END AS a FROM t")
def parse_colors(spark, d):
    """Colours written as #rrggbb, #rrggbbaa, #rgb and names; unknown names are null."""
    n = F.col("p_partkey") * 7919 % 16777216
    digits = F.lower(F.lpad(F.hex(n), 6, "0"))
    short = F.concat(*[F.substring(digits, p, 1) for p in (2, 4, 6)])
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, F.concat(F.lit("#"), digits)).when(k == 1, F.concat(F.lit("#"), digits, F.substring(digits, 5, 2))).when(k == 2, F.concat(F.lit("#"), short)).when(k == 3, "Red").otherwise("none")
    c = forms.parse_color(text)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), r6(c["r"], "r"), r6(c["g"], "g"), r6(c["a"], "a"))


@query("SELECT o_orderkey AS id, CASE WHEN t IN ('-0', '') THEN '0' ELSE t END AS text FROM (SELECT o_orderkey, regexp_replace(regexp_replace(printf('%.4f', sqrt(o_totalprice) - 300), '0+$', ''), '\\.$', '') AS t FROM orders)")
def number_texts(spark, d):
    """Coordinates as text: four decimals, no trailing zeros."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), forms.number_text(F.sqrt("o_totalprice") - 300, 4).alias("text"))


@query("WITH t AS (SELECT event_id, 1700000000 - event_id * 37 AS changed FROM events), s AS (SELECT event_id, greatest(0, 1700000000 - changed) AS s FROM t) SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN 'never' WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS ago FROM s")
def ages(spark, d):
    """Ages of changes; every other instant is in milliseconds."""
    at = F.lit(1700000000) - F.col("event_id") * 37
    then = F.when(F.col("event_id") % 10 == 0, F.lit(None)).when(F.col("event_id") % 2 == 0, at * 1000).otherwise(at)
    return table(spark, d, "events").select(F.col("event_id").alias("id"), forms.time_ago(F.lit(1700000000), then).alias("ago"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 9 <> 0 THEN 'AB-' || upper(lpad(printf('%x', p_partkey % 4096 + 1), 4, '0')) END AS next FROM part")
def next_ids(spark, d):
    """The id after one; overflow is null."""
    last = F.when(F.col("p_partkey") % 9 == 0, "FFFF").otherwise(F.lpad(F.hex(F.col("p_partkey") % 4096), 4, "0"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), forms.next_hex_id(F.concat(F.lit("AB-"), last)).alias("next"))


@query("WITH b AS (SELECT event_id AS id, event_id * 40503 % 65536 AS b FROM events) SELECT id, round(CASE WHEN b >= 32768 THEN -1 ELSE 1 END * (b % 32768) / 32, 6) AS xy, round(CASE WHEN b >= 32768 THEN -1 ELSE 1 END * (b % 32768) / 4096, 6) AS small FROM b")
def fixed_point_deltas(spark, d):
    """Coordinate and pressure deltas of 16 bits."""
    b = (F.col("event_id") * 40503 % 65536).cast("int")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), r6(forms.fixed_delta(b, 5), "xy"), r6(forms.fixed_delta(b, 12), "small"))


@query("WITH c AS (SELECT p_partkey AS id, p_partkey * 37 % 256 / 255 AS r, p_partkey * 91 % 256 / 255 AS g, p_partkey * 53 % 256 / 255 AS b, p_partkey % 4 / 4 AS o FROM part), l AS (SELECT id, CAST(round_even((1 - o * (1 - (0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b))) * 255, 0) AS INT) AS lum FROM c) SELECT id, lum, CASE WHEN lum < 64 THEN 0 WHEN lum < 140 THEN 1 WHEN lum < 217 THEN 2 ELSE 3 END AS level FROM l")
def gray_levels(spark, d):
    """Colours over white as luminance and one of four levels."""
    p = F.col("p_partkey")
    ch = lambda m: p * m % 256 / F.lit(255.0)
    g = forms.gray_level(ch(37), ch(91), ch(53), p % 4 / F.lit(4.0))
    return table(spark, d, "part").select(p.alias("id"), g["lum"].alias("lum"), g["level"].alias("level"))


@query(f"WITH {P} SELECT id, round(CASE WHEN family = 'click' THEN 2.0 * 2.5 * 0.45 ELSE 2.0 * least(greatest(p, 0.4), 0.7) END, 6) AS width, 'b' || repeat('z', CAST(i // 25 AS INT)) || chr(CAST(97 + i % 25 AS INT)) AS key FROM points")
def clamped_widths(spark, d):
    """Widths by clamped pressure, and keys that sort as the points do."""
    return points(spark, d).select("id", r6(forms.clamped_width(F.lit(2.0), F.col("family") == "click", F.col("p")), "width"), forms.sequence_key(F.col("i")).alias("key"))


@query(f"WITH {E64}, m AS (SELECT vec_id, e, list_min(e) AS lo, list_max(e) AS hi FROM e) SELECT vec_id AS stroke, round(CASE WHEN hi > lo THEN (e[3] - lo) / (hi - lo) ELSE 0 END, 6) AS third, hi - lo > 1e-6 AS variable, round(list_median(e), 6) AS width FROM m")
def channel_scaling(spark, d):
    """Channels scaled to 0..1, whether they vary, and their median."""
    e = F.col("e")
    return doubles(spark, d).select(F.col("vec_id").alias("stroke"), r6(F.get(forms.min_max(e), F.lit(2)), "third"), (F.array_max(e) - F.array_min(e) > 1e-6).alias("variable"), r6(arrays.middle(e), "width"))


@query("WITH RECURSIVE n AS (SELECT event_id AS id, event_id * event_id * 7919 AS n FROM events), v(id, rest, k, out) AS (SELECT id, n, 0, '' FROM n UNION ALL SELECT id, rest // 128, k + 1, out || upper(lpad(printf('%x', rest % 128 + CASE WHEN rest >= 128 THEN 128 ELSE 0 END), 2, '0')) FROM v WHERE k = 0 OR rest > 0) SELECT id, max_by(out, k) AS bytes FROM v GROUP BY id")
def varints(spark, d):
    """Base-128 varints."""
    i = F.col("event_id")
    return table(spark, d, "events").select(i.alias("id"), forms.varint_hex(i * i * 7919).alias("bytes"))


@query("WITH RECURSIVE p AS (SELECT user_id AS stroke, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CAST(event_id % 50 - 25 AS DOUBLE) AS v, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 END AS mode FROM events), r(stroke, i, m, p, v) AS (SELECT DISTINCT stroke, 0::BIGINT, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM p UNION ALL SELECT q.stroke, q.i, coalesce(q.mode, r.m), r.p + CASE coalesce(q.mode, r.m) WHEN 0 THEN q.v - r.p WHEN 1 THEN q.v ELSE r.v + q.v END, CASE coalesce(q.mode, r.m) WHEN 0 THEN q.v - r.p WHEN 1 THEN q.v ELSE r.v + q.v END FROM r JOIN p q ON q.stroke = r.stroke AND q.i = r.i + 1) SELECT stroke, i, p AS pos FROM r WHERE i > 0")
def trace_modes(spark, d):
    """Traces of explicit, first and second differences; a mode holds until the next."""
    t = F.col("event_type")
    item = F.struct("ts", "event_id", (F.col("event_id") % 50 - 25).cast("double").alias("v"), F.when(t == "click", 0).when(t == "view", 1).when(t == "error", 2).alias("mode"))
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("stroke")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    s = s.select("stroke", F.posexplode(arrays.decode_modes(F.col("items.v"), F.col("items.mode"))).alias("k", "pos"))
    return s.select("stroke", (F.col("k") + 1).cast("long").alias("i"), "pos")


@query(f"WITH {E64}, s AS (SELECT vec_id, e, k, CASE WHEN vec_id % 3 = 0 AND k > 0 THEN k - 1 ELSE k END AS i FROM e, range(0, 8) t(k)) SELECT vec_id AS stroke, k, round(e[CASE WHEN label % 2 = 0 THEN least(i, 3) * 2 ELSE least(vec_id % 3 * 30 + i, 63) END + 1], 6) AS sample FROM s JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id)")
def sensor_alignment(spark, d):
    """Samples of a sensor for the points of a spline, by offset or mapping."""
    mapping = F.when(F.col("label") % 2 == 0, F.array(*map(F.lit, (0, 2, 4, 6))))
    s = arrays.sensor_values(F.col("e"), F.lit(8), (F.col("vec_id") % 3 * 30).cast("int"), mapping)
    return doubles(spark, d).select(F.col("vec_id").alias("stroke"), F.posexplode(s).alias("k", "sample")).select("stroke", F.col("k").cast("long").alias("k"), r6(F.col("sample"), "sample"))


@query(f"WITH {E64}, s AS (SELECT vec_id, list_sort(e[1:2 * CAST(2 + vec_id % 4 AS INT)]) AS s FROM e), p AS (SELECT vec_id, k, s[2 * k + 1] AS a, s[2 * k + 2] AS b FROM s, range(0, 5) t(k) WHERE 2 * k + 2 <= len(s)) SELECT vec_id AS stroke, round(min_by(a, k), 6) AS a, round(min_by(b, k), 6) AS b FROM p WHERE a <= 0 AND b >= 0 GROUP BY vec_id")
def parity_intervals(spark, d):
    """Even-odd interval of crossings around 0."""
    found = doubles(spark, d).withColumn("p", arrays.parity_interval(F.slice("e", F.lit(1), (2 * (2 + F.col("vec_id") % 4)).cast("int"))))
    return found.where("p is not null").select(F.col("vec_id").alias("stroke"), r6(F.col("p.a"), "a"), r6(F.col("p.b"), "b"))


@query(f"WITH {E64}, x AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN [e[1]] || e[1:5] ELSE e[1:5] END AS h FROM e), y AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN h || [h[len(h)]] ELSE h END AS x FROM x) SELECT vec_id AS stroke, 5::BIGINT AS n, round(list_sum(y.x[CASE WHEN x[1] = x[2] THEN 2 ELSE 1 END:CASE WHEN x[len(x)] = x[len(x) - 1] THEN len(x) - 1 ELSE len(x) END]), 6) AS total FROM y")
def phantom_trim(spark, d):
    """End points that repeat their neighbour go."""
    five, one = F.slice("e", 1, 5), F.slice("e", 1, 1)
    h = F.when(F.col("vec_id") % 2 == 0, F.concat(one, five)).otherwise(five)
    x = F.when(F.col("vec_id") % 3 == 0, F.concat(h, F.slice(h, -1, 1))).otherwise(h)
    t = doubles(spark, d).select(F.col("vec_id").alias("stroke"), arrays.trim_phantoms(x).alias("x"))
    return t.select("stroke", F.size("x").cast("long").alias("n"), r6(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), "total"))


@query(f"WITH {E64} SELECT vec_id AS stroke, k, round(pow(1 - k / 16, 3) * e[1] + 3 * pow(1 - k / 16, 2) * (k / 16) * e[2] + 3 * (1 - k / 16) * pow(k / 16, 2) * e[3] + pow(k / 16, 3) * e[4], 6) AS cubic, round(pow(1 - k / 16, 2) * e[1] + 2 * (1 - k / 16) * (k / 16) * e[2] + pow(k / 16, 2) * e[3], 6) AS quadratic FROM e, range(1, 17) t(k)")
def curve_steps(spark, d):
    """Cubic and quadratic curves in sixteen steps."""
    c = [F.get("e", F.lit(j)) for j in range(4)]
    both = F.arrays_zip(arrays.bezier(c, 16).alias("a"), arrays.bezier(c[:3], 16).alias("b"))
    s = doubles(spark, d).select(F.col("vec_id").alias("stroke"), F.posexplode(both).alias("k", "c"))
    return s.select("stroke", (F.col("k") + 1).cast("long").alias("k"), r6(F.col("c.a"), "cubic"), r6(F.col("c.b"), "quadratic"))


@query("SELECT p_partkey AS shape, corner, p_partkey % 50 + CASE WHEN p_partkey % 2 = 0 THEN [0, 1, 1, 0, 0][corner + 1] * p_size ELSE [0.5, 1, 0.5, 0, 0.5][corner + 1] * p_size END::DOUBLE AS x, p_partkey % 40 + CASE WHEN p_partkey % 2 = 0 THEN [0, 0, 1, 1, 0][corner + 1] * p_size ELSE [0, 0.5, 1, 0.5, 0][corner + 1] * p_size END::DOUBLE AS y FROM part, range(0, 5) t(corner)")
def shape_outlines(spark, d):
    """Closed outlines of rectangles and diamonds."""
    p, size = F.col("p_partkey"), F.col("p_size").cast("double")
    corner = lambda pts: F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in pts])
    ring = F.when(p % 2 == 0, corner([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])).otherwise(corner([(0.5, 0), (1, 0.5), (0.5, 1), (0, 0.5), (0.5, 0)]))
    s = table(spark, d, "part").select(p, size.alias("s"), F.posexplode(ring).alias("corner", "c"))
    return s.select(p.alias("shape"), F.col("corner").cast("long").alias("corner"), (p % 50 + F.col("c.a") * F.col("s")).alias("x"), (p % 40 + F.col("c.b") * F.col("s")).alias("y"))


@query(f"WITH {E64} SELECT vec_id AS stroke, round(e[3] + (e[1] - e[3]) * cos(vec_id % 7) - (e[2] - e[4]) * sin(vec_id % 7), 6) AS x, round(e[4] + (e[1] - e[3]) * sin(vec_id % 7) + (e[2] - e[4]) * cos(vec_id % 7), 6) AS y, round((e[1] - list_min(e)) * 72 / 25.4, 6) AS rebased FROM e")
def rotate_rebase(spark, d):
    """Points turned about a centre, and rebased to points of paper."""
    x, y, cx, cy = (F.get("e", F.lit(k)) for k in range(4))
    q = arrays.rotate(x, y, cx, cy, (F.col("vec_id") % 7).cast("double"))
    return doubles(spark, d).select(F.col("vec_id").alias("stroke"), r6(q["x"], "x"), r6(q["y"], "y"), r6((x - F.array_min("e")) * 72 / 25.4, "rebased"))


@query(f"WITH {E64} SELECT vec_id AS stroke, round((e[1] + e[8]) / 2, 6) AS x0, round(sqrt(pow(e[1] - e[8], 2) + pow(e[33] - e[40], 2)), 6) AS width0, round((e[4] + e[5]) / 2, 6) AS x3 FROM e WHERE vec_id % 5 <> 0")
def outline_center(spark, d):
    """Center lines of outlines of four points a side; outlines of another size have none."""
    pts = F.zip_with(F.slice("e", 1, 8), F.slice("e", 33, 8), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    s = doubles(spark, d).withColumn("c", arrays.center_line(pts, F.when(F.col("vec_id") % 5 == 0, 3).otherwise(4)))
    return s.where("c is not null").select(F.col("vec_id").alias("stroke"), r6(F.get("c", F.lit(0))["x"], "x0"), r6(F.get("c", F.lit(0))["width"], "width0"), r6(F.get("c", F.lit(3))["x"], "x3"))


@query("WITH o AS (SELECT l_orderkey AS page, list(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_linenumber % 2 = 0) AS ord, list(l_partkey ORDER BY l_linenumber, l_partkey) AS every FROM lineitem GROUP BY l_orderkey), z AS (SELECT page, list_reverse(list_distinct_in_order) AS r, every FROM (SELECT page, coalesce(ord, []) AS list_distinct_in_order, every FROM o)), x AS (SELECT page, r, list_filter(every, lambda v: NOT list_contains(r, v)) AS rest FROM z) SELECT page, array_to_string(r || list_filter(rest, lambda v, i: list_position(rest, v) = i), ',') AS layers FROM x")
def layer_order(spark, d):
    """The named layers bottom up, then those which the order lacks."""
    item = F.struct("l_linenumber", "l_partkey")
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(
        F.reverse(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") % 2 == 0, item)))["l_partkey"]).alias("named"), F.array_sort(F.collect_list(item))["l_partkey"].alias("every")
    )
    return g.select("page", F.array_join(arrays.append_missing(F.col("named"), F.col("every")), ",").alias("layers"))


@query("WITH l AS (SELECT l_orderkey AS page, l_linenumber AS shape, l_suppkey % 5 AS layer_id FROM lineitem), y(layer_id, layer_no) AS (VALUES (0, 0), (1, 1), (2, 2)) SELECT page, shape, CAST(coalesce(layer_no, 3) AS INT) AS layer_no FROM l LEFT JOIN y USING (layer_id)")
def layer_assignment(spark, d):
    """Shapes on their layers; those of an unknown layer go to one more, the last."""
    layers = spark.range(3).select(F.col("id").alias("layer_id"), F.col("id").cast("int").alias("layer_no"))
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("shape"), (F.col("l_suppkey") % 5).alias("layer_id"))
    return s.join(layers, "layer_id", "left").select("page", "shape", F.coalesce("layer_no", F.lit(3)).alias("layer_no"))


@query("SELECT l_orderkey AS stroke, l_linenumber AS i, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE coalesce(n_name, 'inline') END AS brush FROM lineitem LEFT JOIN nation ON l_partkey % 40 = n_nationkey + 1")
def dictionary_join(spark, d):
    """Brushes by an index from 1 into a table; an index beyond it falls back, a null one stays null."""
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("at"), "n_name")
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stroke"), F.col("l_linenumber").alias("i"), "l_partkey", (F.col("l_partkey") % 40).alias("at"))
    return s.join(n, "at", "left").select("stroke", "i", F.when(F.col("l_partkey") % 3 != 0, F.coalesce("n_name", F.lit("inline"))).alias("brush"))


@query("WITH s AS (SELECT l_orderkey AS page, l_linenumber AS no, CAST(l_partkey % 97 AS DOUBLE) AS x, CAST(l_suppkey % 89 AS DOUBLE) AS y FROM lineitem), m AS (SELECT a.page, a.no, min({'d': (a.x + 3 - b.x) ** 2 + (a.y - b.y) ** 2, 'no': b.no}) AS best FROM s a JOIN s b USING (page) GROUP BY a.page, a.no) SELECT page, no AS path, best.no AS stroke, best.d AS d2 FROM m")
def nearest_centroid(spark, d):
    """The stroke of its page nearest to each exported path; the first of equals."""
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("no"), (F.col("l_partkey") % 97).cast("double").alias("x"), (F.col("l_suppkey") % 89).cast("double").alias("y"))
    paths = s.select("page", F.col("no").alias("path"), (F.col("x") + 3).alias("px"), F.col("y").alias("py"))
    near = paths.join(s, "page").groupBy("page", "path").agg(F.min(F.struct(((F.col("px") - F.col("x")) * (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) * (F.col("py") - F.col("y"))).alias("d2"), "no")).alias("m"))
    return near.select("page", "path", F.col("m.no").alias("stroke"), F.col("m.d2").alias("d2"))


@query(f"WITH {N}, w AS (SELECT c_custkey AS q, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE upper(c_name) END AS wanted FROM customer), f AS (SELECT q, 0 AS prio, key, folder, name FROM w JOIN notes ON CAST(key AS VARCHAR) = wanted UNION ALL SELECT q, 1, key, folder, name FROM w JOIN notes ON lower(name) = lower(wanted) WHERE key % 23 <> 0) SELECT q, min({{'prio': prio, 'folder': folder, 'name': name, 'key': key}}).key AS found FROM f GROUP BY q")
def library_find(spark, d):
    """Notes by exact id, else by name without regard to case among those not in the trash."""
    w = table(spark, d, "customer").select(F.col("c_custkey").alias("q"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(F.upper("c_name")).alias("wanted"))
    n = notes(spark, d).select("key", "folder", "name")
    by_id = w.join(n, F.col("key").cast("string") == F.col("wanted")).withColumn("prio", F.lit(0))
    by_name = w.join(n.where("key % 23 <> 0"), F.lower("name") == F.lower("wanted")).withColumn("prio", F.lit(1))
    return by_id.unionByName(by_name).groupBy("q").agg(F.min(F.struct("prio", "folder", "name", "key"))["key"].alias("found"))


@query("WITH own AS (SELECT l_orderkey AS grp, l_linenumber AS trace, CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey END AS ctx FROM lineitem), grp AS (SELECT o_orderkey AS grp, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS ctx FROM orders) SELECT own.grp, trace, coalesce(own.ctx, g.ctx, -1) AS ctx FROM own LEFT JOIN grp g ON own.grp = g.grp")
def inherited_context(spark, d):
    """A trace's context: its own, else its group's, else the root's."""
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("trace"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_suppkey")).alias("own"))
    grp = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("grp"), F.col("o_custkey").alias("of_group"))
    return own.join(grp, "grp", "left").select("grp", "trace", F.coalesce("own", "of_group", F.lit(-1)).alias("ctx"))


@query(f"WITH {P}, m AS (SELECT stroke, median(round(v)) AS m FROM points GROUP BY stroke) SELECT family, round(count(*) FILTER (round(v) = m) / count(*), 6) AS rate FROM points JOIN m USING (stroke) GROUP BY family")
def exact_match_rate(spark, d):
    """Share of points whose rounded width is its stroke's median."""
    p = points(spark, d).select("stroke", "family", F.round("v").alias("v"))
    m = p.groupBy("stroke").agg(F.median("v").alias("m"))
    return p.join(m, "stroke").groupBy("family").agg(r6(F.avg((F.col("v") == F.col("m")).cast("double")), "rate"))


@query(f"WITH {P}, q AS (SELECT family, deg, abs(sin(v / 10 - radians(deg))) AS a, p, v AS y FROM points, range(0, 180, 2) t(deg)), m AS (SELECT family, deg, var_pop(a) AS aa, var_pop(p) AS pp, var_pop(y) AS yy, covar_pop(a, p) AS ap, covar_pop(a, y) AS ay, covar_pop(p, y) AS py FROM q GROUP BY family, deg), r AS (SELECT family, deg, round((ay * (ay * pp - py * ap) + py * (py * aa - ay * ap)) / ((aa * pp - ap * ap) * yy), 6) AS r2 FROM m) SELECT family, CAST(-(max({{'r2': r2, 'deg': -deg}}).deg) AS BIGINT) AS deg, max(r2) AS r2 FROM r GROUP BY family")
def angle_grid_fit(spark, d):
    """Least squares on direction and pressure for ninety nib angles; the first best one stays."""
    q = points(spark, d).withColumn("deg", F.explode(F.sequence(F.lit(0), F.lit(178), F.lit(2)))).withColumn("a", F.abs(F.sin(F.col("v") / 10 - F.radians("deg"))))
    m = q.groupBy("family", "deg").agg(F.var_pop("a").alias("aa"), F.var_pop("p").alias("pp"), F.var_pop("v").alias("yy"), F.covar_pop("a", "p").alias("ap"), F.covar_pop("a", "v").alias("ay"), F.covar_pop("p", "v").alias("py"))
    r2 = F.expr("(ay * (ay * pp - py * ap) + py * (py * aa - ay * ap)) / ((aa * pp - ap * ap) * yy)")
    best = m.groupBy("family").agg(F.max(F.struct(F.round(r2, 6).alias("r2"), (-F.col("deg")).alias("deg"))).alias("m"))
    return best.select("family", (-F.col("m.deg")).cast("long").alias("deg"), F.col("m.r2").alias("r2"))


@query(f"WITH {DECIDED} SELECT folder, bool_or(reason IS NULL) AS ticked, bool_and(note_allowed OR reason IS NOT NULL) AND bool_or(reason IS NOT NULL) AS needs_allow, count(*) FILTER (reason IS NOT NULL) AS excluded FROM reasons WHERE kind <> 'pdf' GROUP BY folder")
def folder_checkbox(spark, d):
    """What a folder's box shows, over the notes of kinds that can be synced."""
    out = F.col("reason").isNotNull()
    return decided(spark, d).where("kind <> 'pdf'").groupBy("folder").agg(F.bool_or(~out).alias("ticked"), (F.bool_and(F.col("note_allowed") | out) & F.bool_or(out)).alias("needs_allow"), F.count_if(out).alias("excluded"))


@query("WITH q AS (SELECT o_custkey AS page, o_orderkey % 97 AS x, CAST(floor(o_totalprice) AS BIGINT) % 71 AS y, CAST(floor(o_totalprice) AS BIGINT) % 256 < 235 AND o_orderkey % 3 = 0 AS ink FROM orders) SELECT page, coalesce(greatest(0, min(x) FILTER (ink) - 2), 0) AS x0, coalesce(greatest(0, min(y) FILTER (ink) - 2), 0) AS y0, coalesce(least(97, max(x) FILTER (ink) + 3), 97) AS x1, coalesce(least(71, max(y) FILTER (ink) + 3), 71) AS y1 FROM q GROUP BY page")
def content_bbox(spark, d):
    """Box of a page's ink with two pixels of margin; the whole page if it has none."""
    price = F.floor("o_totalprice")
    q = table(spark, d, "orders").select(F.col("o_custkey").alias("page"), (F.col("o_orderkey") % 97).alias("x"), (price % 71).alias("y"), ((price % 256 < 235) & (F.col("o_orderkey") % 3 == 0)).alias("ink"))
    low = lambda c: F.coalesce(F.greatest(F.lit(0), F.min(F.when(F.col("ink"), F.col(c))) - 2), F.lit(0))
    high = lambda c, n: F.coalesce(F.least(F.lit(n), F.max(F.when(F.col("ink"), F.col(c))) + 3), F.lit(n))
    return q.groupBy("page").agg(low("x").cast("long").alias("x0"), low("y").cast("long").alias("y0"), high("x", 97).cast("long").alias("x1"), high("y", 71).cast("long").alias("y1"))


@query("WITH t AS (SELECT user_id AS list, row_number() OVER w AS seq, event_id % 100 AS n, event_type = 'signup' AS commits, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS done, coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS txn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT list, max_by(n, seq) AS n, count(*) AS applied FROM t WHERE NOT commits AND txn < done GROUP BY list")
def transaction_replay(spark, d):
    """The last count of each list; counts after the last commit do not hold."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    commits = (F.col("event_type") == "signup").cast("int")
    e = table(spark, d, "events").select("user_id", "event_id", "ts", commits.alias("c"))
    t = e.select(F.col("user_id").alias("list"), "c", F.struct("ts", "event_id").alias("seq"), (F.col("event_id") % 100).alias("n"), F.sum("c").over(w).alias("txn"), F.sum("c").over(Window.partitionBy("user_id")).alias("done"))
    return t.where("c = 0 and txn < done").groupBy("list").agg(F.max_by("n", "seq").alias("n"), F.count(F.lit(1)).alias("applied"))


@query("SELECT l_orderkey AS page, l_linenumber AS stroke, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_suppkey % 3, l_linenumber, l_partkey) AS BIGINT) AS nth FROM lineitem")
def paint_order(spark, d):
    """Strokes under the ink first, then by layer and number."""
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_returnflag") != "R", F.col("l_suppkey") % 3, "l_linenumber", "l_partkey")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("stroke"), F.row_number().over(w).cast("long").alias("nth"))


@query("WITH a AS (SELECT DISTINCT o_custkey % 50 AS page, o_orderkey % 41 AS x, o_custkey % 37 AS y FROM orders), b AS (SELECT DISTINCT page, x + 1 + page % 2 AS x, y - page % 3 AS y FROM a WHERE (x + y) % 4 <> 0), h AS (SELECT a.page, dy, dx, count(*) AS hits FROM a, range(-3, 4) u(dy), range(-3, 4) t(dx), b WHERE b.page = a.page AND b.x = a.x + dx AND b.y = a.y + dy GROUP BY ALL), m AS (SELECT page, max({'hits': hits, 'dy': -dy, 'dx': -dx}) AS m FROM h GROUP BY page) SELECT page, CAST(-m.dx AS BIGINT) AS dx, CAST(-m.dy AS BIGINT) AS dy, m.hits AS hits FROM m")
def best_shift(spark, d):
    """The shift by up to three pixels under which most ink of two pages meets; the first of equals."""
    o = table(spark, d, "orders")
    a = o.select((F.col("o_custkey") % 50).alias("page"), (F.col("o_orderkey") % 41).alias("x"), (F.col("o_custkey") % 37).alias("y")).distinct()
    b = a.where("(x + y) % 4 <> 0").select("page", (F.col("x") + 1 + F.col("page") % 2).alias("x"), (F.col("y") - F.col("page") % 3).alias("y"))
    # The page that stays is shifted instead of joined by distance: an equi-join on 49 times its ink.
    grid = F.sequence(F.lit(-3), F.lit(3))
    moved = a.withColumn("dy", F.explode(grid)).withColumn("dx", F.explode(grid)).select("page", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "dy", "dx")
    h = moved.join(b, ["page", "x", "y"]).groupBy("page", "dy", "dx").agg(F.count(F.lit(1)).alias("hits"))
    m = h.groupBy("page").agg(F.max(F.struct("hits", (-F.col("dy")).alias("dy"), (-F.col("dx")).alias("dx"))).alias("m"))
    return m.select("page", (-F.col("m.dx")).cast("long").alias("dx"), (-F.col("m.dy")).cast("long").alias("dy"), F.col("m.hits").alias("hits"))


@query("WITH st AS (SELECT o_orderkey AS key, o_custkey AS mtime, 'out' || o_orderkey AS output, NULL AS error, NULL::BIGINT AS failed FROM orders WHERE o_orderkey % 4 <> 0), up AS (SELECT o_orderkey AS key, o_custkey + 1 AS mtime, CASE WHEN o_orderkey % 5 <> 0 THEN 'new' || o_orderkey END AS output FROM orders WHERE o_orderkey % 3 = 0) SELECT key, CASE WHEN up.output IS NOT NULL THEN up.mtime ELSE st.mtime END AS mtime, coalesce(up.output, st.output) AS output, CASE WHEN up.key IS NOT NULL AND up.output IS NULL THEN 'failed' END AS error, CASE WHEN up.key IS NOT NULL AND up.output IS NULL THEN up.mtime END AS failed_mtime FROM st FULL JOIN up USING (key)")
def state_upsert(spark, d):
    """State after a pass: a success replaces the entry, a failure keeps its outputs and records itself."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    was = o.where("o_orderkey % 4 <> 0").select(k.alias("key"), F.col("o_custkey").alias("was_mtime"), F.concat(F.lit("out"), k).alias("was_output"))
    now = o.where("o_orderkey % 3 = 0").select(k.alias("key"), (F.col("o_custkey") + 1).alias("now_mtime"), F.when(k % 5 != 0, F.concat(F.lit("new"), k)).alias("now_output"))
    failed = F.col("now_mtime").isNotNull() & F.col("now_output").isNull()
    return was.join(now, "key", "full_outer").select(
        "key", F.when(F.col("now_output").isNotNull(), F.col("now_mtime")).otherwise(F.col("was_mtime")).alias("mtime"), F.coalesce("now_output", "was_output").alias("output"),
        F.when(failed, "failed").alias("error"), F.when(failed, F.col("now_mtime")).alias("failed_mtime"),
    )


@query("WITH r AS (SELECT l_orderkey AS doc, l_partkey AS page, min(l_linenumber) AS first_at FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL), idx AS (SELECT l_orderkey AS doc, l_partkey AS page, min(l_linenumber) AS first_at FROM lineitem WHERE l_linenumber % 3 <> 1 GROUP BY ALL), ok AS (SELECT doc FROM r JOIN idx USING (doc, page) GROUP BY doc), merged AS (SELECT doc, page, 0 AS part, first_at FROM r WHERE doc IN (FROM ok) UNION ALL SELECT doc, page, 1, first_at FROM idx WHERE NOT EXISTS (SELECT 1 FROM r JOIN ok USING (doc) WHERE r.doc = idx.doc AND r.page = idx.page)) SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY part, first_at, page) AS nth FROM merged")
def page_replay(spark, d):
    """Pages as replayed from a journal, if it names any page there is, then those it lacks; else as indexed."""
    first = lambda where: table(spark, d, "lineitem").where(where).groupBy(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("page")).agg(F.min("l_linenumber").alias("at"))
    r, idx = first("l_linenumber % 2 = 1"), first("l_linenumber % 3 <> 1")
    held = r.join(r.join(idx.select("doc", "page"), ["doc", "page"], "left_semi").select("doc").distinct(), "doc", "left_semi")
    both = held.withColumn("part", F.lit(0)).unionByName(idx.join(held.select("doc", "page"), ["doc", "page"], "left_anti").withColumn("part", F.lit(1)))
    return both.select("doc", "page", F.row_number().over(Window.partitionBy("doc").orderBy("part", "at", "page")).cast("long").alias("nth"))


def sync_summary(spark, d):
    """Counts of the actions of a pass."""
    return QUERIES["sync_actions"](spark, d).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


QUERIES["sync_summary"], SQL["sync_summary"] = sync_summary, f"SELECT action, count(*) AS n FROM ({SQL['sync_actions']}) GROUP BY action"


def worst_page(spark, d):
    """The least ink match of a group of pages."""
    return QUERIES["pixel_match"](spark, d).groupBy((F.col("page") % 10).alias("doc")).agg(F.min("ink_match").alias("worst"), F.count(F.lit(1)).alias("pages"))


QUERIES["worst_page"], SQL["worst_page"] = worst_page, f"SELECT page % 10 AS doc, min(ink_match) AS worst, count(*) AS pages FROM ({SQL['pixel_match']}) GROUP BY 1"
