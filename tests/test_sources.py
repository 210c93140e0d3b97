import json
import math

from pyspark.sql import functions as F

from quillspark.operators import geometry
from quillspark.plans import svg
from quillspark.sources import formats
from quillspark.streaming import debounce


def test_scan_detect_and_render(spark, tmp_path):
    scene = {"type": "excalidraw", "elements": [
        {"id": "a", "type": "freedraw", "x": 10.0, "y": 5.0, "strokeColor": "#000", "strokeWidth": 2.0, "opacity": 50.0, "points": [[0.0, 0.0], [1.5, 2.25]], "pressures": [0.5, 0.6]},
        {"id": "b", "type": "freedraw", "x": 0.0, "y": 0.0, "isDeleted": True, "points": [[0.0, 0.0]]},
        {"id": "c", "type": "rectangle", "x": 1.0, "y": 1.0, "width": 2.0, "height": 3.0, "strokeColor": "red", "strokeWidth": 1.0},
    ]}
    (tmp_path / "s.excalidraw").write_text(json.dumps(scene))
    (tmp_path / "x.svg").write_text("<svg/>")
    (tmp_path / "odd.bin").write_text("{}")
    found = {r.path.rsplit("/", 1)[-1]: r.format for r in formats.scan_files(spark, str(tmp_path)).collect()}
    assert found == {"s.excalidraw": "excalidraw", "x.svg": "svg", "odd.bin": None}
    strokes = formats.read_scenes(spark, str(tmp_path / "s.excalidraw"))
    rows = strokes.orderBy("stroke_no").collect()
    assert [r.kind for r in rows] == ["freedraw", "rectangle"]
    assert rows[0].x == [10.0, 11.5] and rows[0].opacity == 0.5 and rows[1].y == [1.0, 1.0, 4.0, 4.0, 1.0]
    page = svg.pages(strokes.withColumn("underlay", F.col("kind") == "rectangle"), 100, 50).first().svg
    assert page.index("red") < page.index("#000") and 'd="M10,5 L11.5,7.25"' in page


def test_library_cache(spark, tmp_path):
    (tmp_path / "u1.metadata").write_text('{"visibleName": "A", "parent": "", "type": "DocumentType", "lastModified": "12"}')
    (tmp_path / "u2.metadata").write_text('{"visibleName": "B", "deleted": true}')
    (tmp_path / "u3.metadata").write_text("{broken")
    assert [tuple(r) for r in formats.read_library(spark, str(tmp_path)).collect()] == [("u1", "A", "", 12, "DocumentType")]


def test_library_documents(spark, tmp_path):
    meta = lambda **k: json.dumps({"parent": "", "type": "DocumentType", "lastModified": "5"} | k)
    for ident, name in (("u1", "B"), ("u2", "A"), ("u3", "C")):
        (tmp_path / f"{ident}.metadata").write_text(meta(visibleName=name, parent="f1" if ident == "u1" else ""))
    (tmp_path / "f1.metadata").write_text(meta(visibleName="Folder", type="CollectionType"))
    pages = [{"id": "p1", "template": {"value": "P Dots S"}}, {"id": "p2", "deleted": {"value": 1}}, {"id": "p3"}]
    (tmp_path / "u1.content").write_text(json.dumps({"fileType": "pdf", "orientation": "landscape", "cPages": {"pages": pages}}))
    (tmp_path / "u2.content").write_text(json.dumps({"pages": ["q1", "q2"]}))
    (tmp_path / "u3.content").write_text("{broken")
    docs = formats.library_documents(spark, str(tmp_path))
    got = {r.id: (r.name, r.file_type, r.orientation, [tuple(p) for p in r.pages]) for r in docs.collect()}
    assert got == {"u1": ("B", "pdf", "landscape", [("p1", "P Dots S"), ("p3", "")]), "u2": ("A", "notebook", "portrait", [("q1", ""), ("q2", "")]), "u3": ("C", "notebook", "portrait", [])}
    folders = spark.createDataFrame([("u1", "Folder/B", False), ("u2", "A", False), ("u3", "C", True), ("f1", "Folder", False)], "id string, path string, trashed boolean")
    assert [(r.id, r.folder) for r in formats.listed(docs, folders).collect()] == [("u2", ""), ("u1", "Folder")]


def test_outline_of_a_straight_stroke(spark):
    pts = spark.createDataFrame([(1, k, float(k * 10), 0.0, 2.0) for k in range(4)] + [(2, k, 1.0, 1.0, 2.0) for k in range(3)], "stroke int, i int, x double, y double, half double")
    rows = geometry.outlines(pts).orderBy("stroke", "seq").collect()
    assert {r.stroke for r in rows} == {1} and [r.seq for r in rows] == list(range(2 * 4 + 14))
    assert all(abs(abs(r.y) - 2) < 1e-9 for r in rows if r.seq < 4 or 11 <= r.seq < 15)
    assert all(abs(math.hypot(r.x - 30, r.y) - 2) < 1e-9 for r in rows if 4 <= r.seq < 11)
    assert all(r.x >= 30 for r in rows if 4 <= r.seq < 11) and all(r.x <= 0 for r in rows if r.seq >= 15)


def test_debounce_stream(spark, tmp_path):
    rows = spark.createDataFrame([("k", 0), ("k", 20), ("k", 100), ("k", 500)], "key string, s int").select("key", F.timestamp_seconds("s").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = debounce.watch(stream).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.changes for r in spark.table("bursts").collect()) == [1, 2]
