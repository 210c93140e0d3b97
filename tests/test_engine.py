import json

import pytest
from test_ink_files import key, strokes_for

from quillspark import engine
from quillspark.__main__ import main
from quillspark.operators import settings
from quillspark.plans import ink_xml
from quillspark.sources import xml_ink


@pytest.fixture
def notes(spark, tmp_path):
    df, _ = strokes_for(spark)
    for r in ink_xml.xopp(df, 100, 200).collect():
        (tmp_path / f"{r.doc}.xopp").write_text(r.text)
    return str(tmp_path)


def test_convert_and_read_back(spark, notes, tmp_path):
    out = str(tmp_path / "out")
    assert engine.convert(spark, notes, out, "inkml", "xopp") == 2
    texts = spark.read.option("wholetext", "true").text(out).collect()
    was = {r.doc.rsplit("/", 1)[-1]: r for r in ink_xml.inkml(engine.read(spark, notes, "xopp")).collect()}
    assert sorted(t.value.strip() for t in texts) == sorted(r.text for r in was.values())
    back = [s for t in texts for s in xml_ink.inkml_strokes(t.value.strip().encode())]
    assert len(back) == engine.read(spark, notes, "xopp").count()


def test_pages_are_chosen_in_order(spark, notes):
    strokes = engine.read(spark, notes, "xopp")
    got = engine.select_pages(strokes, engine.parse_pages("2,1,2,5-4"))
    assert {r.page for r in got.collect()} == {0, 1, 2} and got.count() == strokes.count() * 3 // 2
    second = sorted(key(r)[1:] for r in strokes.where("page = 1").collect())
    assert second == sorted(key(r)[1:] for r in got.where("page = 2").collect()) == sorted(key(r)[1:] for r in got.where("page = 0").collect())
    for bad in ("x", "0", "1-b"):
        with pytest.raises(engine.NotSupported):
            engine.parse_pages(bad)


def test_refusals(spark, notes, tmp_path):
    for kw in ({"to": "pdf"}, {"to": "excalidraw"}, {"to": "inkml", "pages": "1,9"}, {"to": "inkml", "fmt": "zip"}):
        with pytest.raises(engine.NotSupported):
            engine.convert(spark, notes, str(tmp_path / "no"), **({"fmt": "xopp"} | kw))


def test_command_line(spark, notes, capsys):
    assert main(["inspect", notes, "--format", "xopp"], spark) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(rows) == 4 and all(r["strokes"] == 6 and r["tools"] == ["pen"] for r in rows)
    assert main(["formats"], spark) == 0 and '"xopp"' in capsys.readouterr().out
    assert main(["inspect", "x.unknown"], spark) == 2


def test_rules(spark, tmp_path):
    r = settings.Rules()
    r.set_note("s:1", blocked=True, format="svg")
    r.set_folder("A", allowed=True)
    r.set_folder("B", blocked=True)
    r.set_folder("B", blocked=False)
    for bad in (lambda: r.set_note("s:1", format="doc"), lambda: r.set_folder("A", format="svg"), lambda: r.set_mode("none"), lambda: r.set_note("s:1", colour=1)):
        with pytest.raises(settings.BadSetting):
            bad()
    path = str(tmp_path / "rules.json")
    assert settings.load(path) == settings.Rules()
    settings.save(r, path)
    assert settings.load(path) == r and set(r.folders) == {"A"}
    own, folders = r.tables(spark)
    assert own.first().format == "svg" and folders.first().allowed
    (tmp_path / "rules.json").write_text("{")
    assert settings.load(path) == settings.Rules() and (tmp_path / "rules.json.broken").exists()


def test_targets_that_are_refused():
    engine.check_target("/notes/in", "/notes/out", ("/library",))
    for target, protected in (("/notes/in", ()), ("/notes", ()), ("/library/x", ("/library",)), ("file:///", ()), ("/library", ("/library/deep",))):
        with pytest.raises(engine.NotSupported):
            engine.check_target("/notes/in", target, protected)
