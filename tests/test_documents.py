"""The document model, its JSON form and binary readers, against known inputs."""

import json
import math
import struct
import zipfile
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import ink
from quillspark.sources import codecs, ink_binary, ink_json

COLOR = {"r": 0.25, "g": 0.5, "b": 1.0, "a": 1.0}
LOOK = {"mode": "stroked_constant", "color": COLOR, "width": 30.0, "opacity": 0.85, "blend": "darken", "cap": "square", "join": "round", "underlay": True}
SAMPLE = {
    "any_ir": 1, "format_id": "test", "title": "T é", "orientation": "landscape", "metadata": {"n": 3, "deep": {"a": [1, None, "x"]}}, "extra": {},
    "attachments": {"a.pdf": {"data": "JVBERg=="}, "b.pdf": {"path": "/files/b.pdf"}},
    "pages": [
        {
            "bounds": {"x_min": -702.0, "y_min": 0.0, "x_max": 702.0, "y_max": 1872.0}, "point_scale": 0.3, "extra": {"src": {"k": 1}},
            "background": {"type": "template", "kind": "dots", "name": "P Dots S", "pitch": 52.0, "line_width": 0.0, "dot_radius": 2.0, "gray": 0.62},
            "layers": [
                {
                    "name": "ink", "visible": True,
                    "strokes": [
                        {"x": [0.1, 1.0, 2.0], "y": [0.0, 1.5, 3.0], "tool": {"family": "ballpoint", "native": {"format_id": "test", "tool_id": 15, "params": {"p": [1, 2]}}}, "color": COLOR, "channels": {"width": [1.0, 2.0, 3.0], "pressure": [0.1, 0.5, 1.0]}, "extra": {"own": {"a": 1}, "reserved": 2}},
                        {"x": [5.0, 6.0], "y": [5.0, 6.0], "tool": {"family": "highlighter"}, "color": COLOR, "channels": {"width": [30.0, 30.0]}, "appearance": LOOK},
                    ],
                    "texts": [{"x": 10.0, "y": 20.0, "text": "hello", "font_size": 12.0}],
                },
                {"name": "hidden", "visible": False, "strokes": [{"x": [1.0], "y": [], "tool": {"family": "pen"}, "color": COLOR}], "raster": {"data": "aGk=", "format": "png"}},
            ],
        },
        {"bounds": {"x_min": 0.0, "y_min": 0.0, "x_max": 1.0, "y_max": 1.0}, "point_scale": 1.0, "background": {"type": "image", "image": {"data": "aGk=", "format": "png"}}, "layers": []},
        {"bounds": {"x_min": 0.0, "y_min": 0.0, "x_max": 1.0, "y_max": 1.0}, "point_scale": 1.0, "layers": [{"strokes": [{"x": [1.0, 2.0], "y": [1.0, 2.0], "tool": {"family": "eraser"}, "color": COLOR, "channels": {"alpha": [0.0, 1.0], "width": [4.0]}}]}]},
    ],
}


def dropped(value):
    """Without nulls and empty objects inside objects."""
    if isinstance(value, dict):
        return {k: dropped(v) for k, v in value.items() if v is not None}
    return [dropped(v) for v in value] if isinstance(value, list) else value


@pytest.fixture(scope="module")
def sample(spark):
    return ink_json.parsed(spark.createDataFrame([("d", json.dumps(SAMPLE))], "doc string, json string"))


def test_json_round_trip(sample):
    assert sample.select("broken").first()[0] is None
    once = json.loads(ink_json.ink_json(sample, "any_ir").first()["text"])
    assert dropped(once) == dropped(SAMPLE)


def test_json_that_is_no_document(spark):
    texts = {"version": json.dumps(SAMPLE | {"any_ir": 2}), "none": '{"x": 1}', "cut": json.dumps(SAMPLE)[:-30], "null": None, "family": json.dumps(SAMPLE).replace('"eraser"', '"spoon"'), "back": json.dumps(SAMPLE).replace('"image", "image"', '"lava", "image"'), "ok": json.dumps({"any_ir": 1, "format_id": "t", "pages": []})}
    got = {r["doc"]: r for r in ink_json.parsed(spark.createDataFrame([*texts.items()], "doc string, json string")).collect()}
    assert got["ok"]["broken"] is None and got["ok"]["orientation"] == "portrait" and got["ok"]["title"] == ""
    assert got["version"]["broken"] == "unsupported version 2" and got["null"]["broken"] and got["none"]["broken"]
    assert [got[k]["broken"] for k in ("cut", "family", "back")] == ["not a document", "unknown tool family", "unknown background"]


def test_json_files(spark, sample, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text(json.dumps(SAMPLE, indent=2))
    (tmp_path / "two.json").write_text("[]")
    got = {r["doc"].rsplit("/", 1)[-1]: r for r in ink_json.read_ink_json(spark, str(tmp_path)).collect()}
    assert got["one.json"]["broken"] is None and len(got["one.json"]["pages"]) == 3 and got["two.json"]["broken"]
    files = spark.createDataFrame([("/files/b.pdf", bytearray(b"%PDF"))], "path string, content binary")
    whole = ink_json.embedded(sample, files).first()["attachments"]
    assert whole["b.pdf"]["data"] == "JVBERg==" and whole["b.pdf"]["path"] is None and whole["a.pdf"]["data"] == "JVBERg=="


def test_views_and_filters(sample):
    strokes = ink.strokes_of(sample)
    assert strokes.count() == 4 and ink.visible(strokes).count() == 3
    assert [(r["page_no"], r["has_content"]) for r in ink.pages_with_content(sample).orderBy("page_no").collect()] == [(0, True), (1, True), (2, False)]
    assert [r["has_content"] for r in ink.pages_with_content(sample, vectors_only=True).orderBy("page_no").collect()] == [True, False, False]
    assert [tuple(r) for r in ink.problems(sample).collect()] == [("d", 2, 0, "channel width has 1 values for 2 points")]
    page = ink.inspected(sample).orderBy("page_no").collect()
    assert [(r["strokes"], r["points"], [tuple(t) for t in r["tools"] or []], r["channels"]) for r in page] == [(2, 5, [("ballpoint", 1), ("highlighter", 1)], ["pressure", "width"]), (0, 0, [], []), (1, 2, [("eraser", 1)], ["alpha", "width"])]
    assert len(ink.first_pages(sample, 2).first()["pages"]) == 2
    assert [p["point_scale"] for p in ink.selected_pages(sample, [2, 0, 0, 9]).first()["pages"]] == [1.0, 0.3, 0.3]


def test_restyled(sample):
    rows = {(r["page_no"], r["stroke_no"]): r for r in ink.restyled(ink.visible(ink.strokes_of(sample)), "reserved").withColumn("extra", F.to_json("extra")).collect()}
    look = {k: (r["appearance"]["mode"], r["appearance"]["width"], r["appearance"]["opacity"], r["appearance"]["blend"], r["appearance"]["underlay"]) for k, r in rows.items()}
    assert look == {(0, 0): ("stroked_variable", None, 1.0, "normal", False), (0, 1): ("stroked_constant", 30.0, 0.85, "darken", True), (2, 0): ("stroked_variable", None, 1.0, "normal", False)}
    assert tuple(rows[2, 0]["appearance"]["color"]) == (1.0, 1.0, 1.0, 1.0) and json.loads(rows[0, 0]["extra"]) == {"own": {"a": 1}}


def binary(data):
    return b"\x05p\0" + struct.pack("<i", len(data)) + b"\0" + data


def saber_note():
    """Two strokes, one with pressure and one a highlighter; a text."""

    def stroke(points, **keys):
        blobs = b"".join(b"\x05" + str(k).encode() + b"\0" + struct.pack("<i", 4 * len(p)) + b"\0" + struct.pack(f"<{len(p)}f", *p) for k, p in enumerate(points))
        array = struct.pack("<i", len(blobs) + 5) + blobs + b"\0"
        rest = codecs.to_bson(keys)
        body = b"\x04p\0" + array + rest[4:-1]
        return struct.pack("<i", len(body) + 5) + body + b"\0"

    items = [stroke([(1, 2, 0.5), (3, 4, 0.25)], pe=True, ty="fountainPen", c=-16776961, s=3.0), stroke([(5, 6)], pe=False, ty="Highlighter", c=0x80FF0000 - (1 << 32), s=9.0), stroke([], ty="pencil")]
    strokes = b"".join(b"\x03" + str(k).encode() + b"\0" + s for k, s in enumerate(items))
    page = codecs.to_bson({"w": 800.0, "q": [{"insert": "note"}, {"insert": 5}]})
    body = b"\x04s\0" + struct.pack("<i", len(strokes) + 5) + strokes + b"\0" + page[4:-1]
    page = struct.pack("<i", len(body) + 5) + body + b"\0"
    body = b"\x10v\0" + struct.pack("<i", 19) + b"\x04z\0" + struct.pack("<i", len(page) + 8) + b"\x030\0" + page + b"\0"
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def test_saber(spark, tmp_path):
    note = saber_note()
    (tmp_path / "bare.sbn2").write_bytes(note)
    with zipfile.ZipFile(tmp_path / "packed.sba", "w") as z:
        z.writestr("other.txt", "x")
        z.writestr("a.sbn2", note)
    (tmp_path / "bad.sbn2").write_bytes(note[:-9])
    got = {r["doc"].rsplit("/", 1)[-1]: r for r in ink_binary.reader("saber")(spark, str(tmp_path)).withColumn("whole", F.to_json("pages")).collect()}
    assert got["bad.sbn2"]["broken"] and got["bad.sbn2"]["pages"] is None
    assert got["bare.sbn2"]["whole"] == got["packed.sba"]["whole"] and got["bare.sbn2"]["title"] == "bare"
    (page,) = got["bare.sbn2"]["pages"]
    first, second = page["layers"][0]["strokes"]
    assert (first["x"], first["y"], first["channels"]) == ([1.0, 3.0], [2.0, 4.0], {"width": [3.0, 3.0], "pressure": [0.5, 0.25]})
    assert first["tool"]["family"] == "pen" and tuple(first["color"]) == (0.0, 0.0, 1.0, 1.0) and first["appearance"]["opacity"] == 1.0
    assert second["tool"]["family"] == "highlighter" and second["appearance"]["underlay"] and abs(second["appearance"]["opacity"] - 128 / 255) < 1e-9
    assert (page["bounds"]["x_max"], page["bounds"]["y_max"]) == (800.0, 1400.0) and [t["text"] for t in page["layers"][0]["texts"]] == ["note"]


def pencil_drawing(count=3, own=0x023, force=1500):
    """A stroke whose place, time and force vary; the other channels are constant."""
    field = lambda n, data: {"field": n, "wire": 2, "number": None, "bytes": data}
    number = lambda n, v: {"field": n, "wire": 0, "number": v, "bytes": None}
    single = lambda n, v: {"field": n, "wire": 5, "number": None, "bytes": struct.pack("<f", v)}
    double = {"field": 2, "wire": 1, "number": None, "bytes": struct.pack("<d", 100.0)}
    points = b"".join(struct.pack("<fffH", 10.0 + k, 20.0, 0.5 * k, force) for k in range(count))
    shared = struct.pack("<fHHHHHfH", 4.0, 500, 0, 32768, 0, 65535, 8.0, 0)
    path = codecs.to_message([field(1, b"\x01\x02"), double, number(3, count), number(4, own), number(5, 0x7FF ^ own), field(6, shared), field(7, points)])
    ink_type = codecs.to_message([field(1, codecs.to_message([single(k + 1, v) for k, v in enumerate((0.5, 0.25, 0.0, 1.0))])), field(2, b"com.apple.ink.monoline")])
    stroke = codecs.to_message([number(4, 0), field(5, path)])
    return b"wrd\xf0\x02\x00" + codecs.to_message([field(4, ink_type), field(5, stroke)])


def test_pencilkit(spark, tmp_path):
    (tmp_path / "a.pkdrawing").write_bytes(pencil_drawing())
    (tmp_path / "empty.pkdrawing").write_bytes(b"wrd\xf0\x02\x00")
    (tmp_path / "bad.pkdrawing").write_bytes(pencil_drawing()[:-3])
    (tmp_path / "other.pkdrawing").write_bytes(b"none")
    got = {r["doc"].rsplit("/", 1)[-1]: r for r in ink_binary.reader("pencilkit")(spark, str(tmp_path)).collect()}
    assert got["bad.pkdrawing"]["broken"] and got["other.pkdrawing"]["broken"] == "no drawing"
    assert tuple(got["empty.pkdrawing"]["pages"][0]["bounds"]) == (0.0, 0.0, 612.0, 792.0)
    page = got["a.pkdrawing"]["pages"][0]
    (s,) = page["layers"][0]["strokes"]
    assert (s["x"], s["y"], s["channels"]["timestamp"], s["channels"]["width"]) == ([10.0, 11.0, 12.0], [20.0] * 3, [0.0, 0.5, 1.0], [4.0] * 3)
    assert s["channels"]["pressure"] == [1.0] * 3 and json.loads(s["extra"].toJson())["pencilkit"]["force_raw"] == [1.5] * 3
    assert np.allclose(s["channels"]["tilt_azimuth"], (2 * 32768 / 65535 * math.pi - math.pi) % (2 * math.pi)) and s["channels"]["tilt_altitude"] == [math.pi / 2] * 3
    assert s["tool"]["family"] == "fineliner" and tuple(s["color"]) == (0.5, 0.25, 0.0, 1.0) and s["appearance"]["opacity"] == 2.0
    assert json.loads(s["tool"]["native"]["params"].toJson()) == {"aspect": 0.5, "secondary_scale": 2.0}
    assert tuple(page["bounds"]) == (0.0, 10.0, 22.0, 30.0)
    flat = ink.flat_strokes(ink_binary.reader("pencilkit")(spark, str(tmp_path)).where("broken is null")).first()
    assert flat["x"] == [10.0, 11.0, 12.0] and flat["color"] == "#804000" and not flat["constant"]
    with pytest.raises(codecs.Malformed):
        ink_binary.pencilkit(pencil_drawing(own=0x021), "x")


def test_bad_bytes_are_malformed():
    rng = np.random.default_rng(2)
    whole = {"saber": saber_note(), "pencilkit": pencil_drawing()}
    for name, data in whole.items():
        for _ in range(300):
            spoiled = bytearray(data)
            for at in rng.integers(0, len(data), 3):
                spoiled[at] = rng.integers(0, 256)
            try:
                json.dumps(ink_binary.DECODERS[name][0](bytes(spoiled), "t"), default=str)
            except codecs.Malformed:
                pass
