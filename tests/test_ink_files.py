import gzip
import json
import math
import random
import struct

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import pytest

from quillspark.plans import ink_xml
from quillspark.sources import codecs, formats, xml_ink

FIELD = st.one_of(
    st.tuples(st.just(0), st.integers(-(1 << 63), (1 << 63) - 1)), st.tuples(st.just(1), st.binary(min_size=8, max_size=8)), st.tuples(st.just(2), st.binary(max_size=40)), st.tuples(st.just(5), st.binary(min_size=4, max_size=4))
)
LEAF = st.none() | st.booleans() | st.integers(-(1 << 63), (1 << 63) - 1) | st.floats(allow_nan=False) | st.text(alphabet="ab\u00e9\u4e2d ", max_size=8)
JSON = LEAF | st.lists(LEAF, max_size=3) | st.dictionaries(st.sampled_from("abc"), LEAF | st.lists(LEAF, max_size=2), max_size=3)


@given(st.lists(st.tuples(st.integers(1, 5000), FIELD), max_size=12))
def test_message_round_trip(items):
    fields = [{"field": f, "wire": w, "number": v if w == 0 else None, "bytes": None if w == 0 else v} for f, (w, v) in items]
    assert codecs.message_fields(codecs.to_message(fields)) == fields


@settings(suppress_health_check=[HealthCheck.too_slow], deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "b", "cc"]), JSON, max_size=3))
def test_bson_round_trip(value):
    assert codecs.bson(codecs.to_bson(value)) == value


@given(st.binary(max_size=900))
def test_lz4_round_trip_and_bad_bytes(data):
    assert codecs.lz4_block(codecs.to_lz4_block(data)) == data
    for decode in (codecs.lz4_block, codecs.message_fields, codecs.bson, codecs.riff_chunks, codecs.delimited):
        try:
            decode(data)
        except codecs.Malformed:
            pass


def test_lz4_copies_and_chunks_and_bits():
    assert codecs.lz4_block(b"\x32abc\x03\x00\x10X") == b"abcabcabcX"
    riff = b"RIFF" + struct.pack("<I", 4 + 8 + 4 + 12 + 2) + b"WAVE" + b"one " + struct.pack("<I", 3) + b"xyz\0" + b"LIST" + struct.pack("<I", 4) + b"kind"
    assert [(c["kind"], c["bytes"]) for c in codecs.riff_chunks(riff)] == [("one ", b"xyz"), ("LIST", b"kind")]
    assert codecs.packed_numbers(bytes([0b10100111]), 2, 4) == [-2, -2, 1, -1]


def test_columns_are_decoded_alone(spark):
    rows = [(1, codecs.to_message([{"field": 3, "wire": 0, "number": 7, "bytes": None}]), "a"), (2, b"\xff", "b"), (3, None, "c"), (4, b"", "d")]
    got = {r.k: r for r in codecs.with_message_fields(spark.createDataFrame(rows, "k int, data binary, other string"), "data").collect()}
    assert got[1].fields[0].number == 7 and got[1].broken is None and got[1].other == "a"
    assert got[2].fields is None and got[2].broken == "varint" and got[3].fields is None and got[3].broken is None and got[4].fields == []
    d = codecs.with_bson(spark.createDataFrame([(bytearray(codecs.to_bson({"a": [1, None]})),)], "data binary"), "data").first()
    assert json.loads(d.document) == {"a": [1, None]}


def strokes_for(spark, seed=5):
    rng, rows = random.Random(seed), []
    for doc in ("d1", "d2"):
        for page in range(2):
            for layer in range(2):
                for s in range(3):
                    n = rng.randint(2, 6)
                    value = lambda: round(rng.random() * 100, 2)  # noqa: B023, E731
                    constant = s == 0
                    w = [value()] * n if constant else [value() for _ in range(n)]
                    rows.append((doc, page, layer, s, "pen", "#102030", 1.0, [value() for _ in range(n)], [value() for _ in range(n)], w, None, constant))
    return spark.createDataFrame(rows, xml_ink.STROKES), rows


def key(r):
    return (r.page, r.layer, r.stroke, r.color, r.opacity, list(r.x), list(r.y), list(r.width), r.constant)


@pytest.mark.parametrize("kind", ["xopp", "inkml"])
def test_ink_round_trip(spark, tmp_path, kind):
    df, rows = strokes_for(spark)
    files = ink_xml.xopp(df, 100, 200) if kind == "xopp" else ink_xml.inkml(df)
    for r in files.collect():
        raw = r.text.encode()
        (tmp_path / f"{r.doc}.{kind}").write_bytes(gzip.compress(raw) if kind == "xopp" and r.doc == "d2" else raw)
    (tmp_path / f"bad.{kind}").write_text("<broken")
    back = (xml_ink.read_xopp if kind == "xopp" else xml_ink.read_inkml)(spark, str(tmp_path)).collect()
    was = df.collect()
    for doc in ("d1", "d2"):
        assert sorted(key(r) for r in back if r.doc.endswith(f"{doc}.{kind}")) == sorted(key(r) for r in was if r.doc == doc)
    assert len(back) == len(rows)


def test_one_point_and_escapes(spark):
    row = [("d", 0, 0, 0, 'a"<', "#000000", 0.5, [1.0], [2.0], [3.0], None, False), ("d", 0, 0, 1, "pen", "#000000", 1.0, [], [], [], None, True)]
    text = ink_xml.xopp(spark.createDataFrame(row, xml_ink.STROKES), 10, 10).first().text
    assert 'tool="a&quot;&lt;"' in text and ">1 2 1.001 2</stroke>" in text and text.count("<stroke") == 1


def test_scene_round_trip(spark, tmp_path):
    df, _ = strokes_for(spark)
    (tmp_path / "d1.excalidraw").write_text(ink_xml.scene(df.where("doc = 'd1'")).first().text)
    back = formats.read_scenes(spark, str(tmp_path / "d1.excalidraw")).orderBy("stroke_no").collect()
    was = df.where("doc = 'd1' and page = 0").orderBy("layer", "stroke").collect()
    assert len(back) == len(was) and all(abs(a - b) < 0.011 for r, s in zip(back, was) for a, b in zip(r.x + r.y, s.x + s.y))


def test_bson_too_deep_is_malformed():
    data = codecs.to_bson({})
    for _ in range(5000):
        data = struct.pack("<i", len(data) + 8) + b"\x03a\0" + data + b"\0"
    with pytest.raises(codecs.Malformed):
        codecs.bson(data)


def test_trace_modes():
    assert xml_ink.trace_rows("10 20, '1 \"2, 3 4, !7 !8, 1", 2) == [[10, 20], [11, 42], [14, 68], [7, 8]]


def test_paths_and_transforms():
    assert xml_ink.path_points("M1 1 l2,0 0-1 H5 v3 z m1 1 1 1") == [[(1, 1), (3, 1), (3, 0), (5, 0), (5, 3), (1, 1)], [(2, 2), (3, 3)]]
    curve = xml_ink.path_points("M0,0 C0,0 4,4 4,4 S8 8 8 8 Q9 9 10 8 T12 8")[0]
    assert len(curve) == 1 + 4 * 16 and curve[16] == (4, 4) and curve[-1] == (12, 8)
    assert xml_ink.path_points("M0 0 L5") == [[(0, 0)]] and xml_ink.path_points("") == []
    m = xml_ink.transform_of("translate(10) scale(2,3) skewX(4) rotate(90 1 1)")
    x, y = m[0] * 2 + m[2] * 1 + m[4], m[1] * 2 + m[3] * 1 + m[5]
    assert math.isclose(x, 12) and math.isclose(y, 6)


def test_svg_styles(spark, tmp_path):
    (tmp_path / "a.svg").write_text('<svg xmlns="http://www.w3.org/2000/svg"><g stroke="red" stroke-width="2" transform="scale(2)"><path d="M1 1L2 2" style="stroke:blue"/><polyline points="0,0 1,1"/><path d="M0 0" stroke="none"/></g><defs><path d="M0 0L1 1" stroke="red"/></defs><circle cx="3" cy="4" r="1.5" fill="green"/></svg>')
    got = xml_ink.read_svg(spark, str(tmp_path)).orderBy("stroke").collect()
    assert [(r.color, list(r.x), r.width[0]) for r in got] == [("blue", [2.0, 4.0], 4.0), ("red", [0.0, 2.0], 4.0), ("green", [3.0], 3.0)]


def test_tldraw_pages(spark, tmp_path):
    draw = lambda i, parent, **k: {"id": i, "typeName": "shape", "type": "draw", "parentId": parent, "index": "a1", "x": 10.0, "y": 0.0, "rotation": 0.0, "props": {"color": "black", "segments": [{"type": "free", "points": [{"x": 0, "y": 0, "z": 0.5}, {"x": 1, "y": 2}]}]}} | k
    records = [{"id": "page:1", "typeName": "page"}, {"id": "g", "typeName": "shape", "type": "group", "parentId": "page:1"}, draw("s1", "page:1"), draw("s2", "g", rotation=math.pi / 2), draw("s3", "gone"), draw("s4", "s4")]
    (tmp_path / "a.tldr").write_text(json.dumps({"records": records}))
    got = {r["shape"]: r for r in xml_ink.read_tldraw(spark, str(tmp_path / "a.tldr")).collect()}
    assert set(got) == {"s1", "s2"} and got["s2"].page == "page:1" and got["s1"].x == [10.0, 11.0] and got["s1"].z == [0.5, 0.5]
    assert abs(got["s2"].x[1] - 8) < 1e-9 and abs(got["s2"].y[1] - 1) < 1e-9
