"""Slide files and debug images, written and read."""

import io
import zipfile
from xml.etree import ElementTree as ET

import numpy as np
import pandas as pd
import pytest

from lamella.sources import slides
from lamella.sources.slides import deck_file, debug_artifacts, pixels_of, png, read_deck


def some_slides():
    image = np.random.default_rng(1).integers(0, 256, (6, 8, 3)).astype(np.uint8)
    first = [
        {"name": "a & <b>", "kind": "shape", "box": (0, 0, 960, 540), "fill": "#FF0000", "opacity": 0.5, "stroke": "#000000", "stroke_width": 2.0},
        {"name": "line", "kind": "shape", "box": (10, 10, 200, 10), "form": "line", "stroke": "#00FF00"},
        {"name": "pic", "kind": "picture", "box": (5, 5, 50, 40), "data": png(image)},
        {"name": "table", "kind": "table", "box": (100, 100, 300, 160), "rows": [["a", "b <c>"], ["", "d"]]},
        {"name": "text", "kind": "text", "box": (1.25, 2.5, 100, 30), "text": 'two & "lines"\n\n<three>', "size": 10.5, "bold": True, "italic": True, "font": "Courier New"},
    ]
    return [first, [], [{"name": "中文", "kind": "text", "box": (0, 0, 10, 10), "text": "中文 ' \u00e9"}]]


def test_what_is_written_is_read():
    slides = some_slides()
    got = read_deck(deck_file(slides, 960, 540))
    assert [[(i["name"], i["kind"]) for i in s] for s in got] == [[(i["name"], i["kind"]) for i in s] for s in slides]
    for s, t in zip(slides, got):
        for i, j in zip(s, t):
            assert j["box"] == pytest.approx(i["box"], abs=1e-4)
            assert j["text"] == ("\n".join("\t".join(r) for r in i["rows"]) if i["kind"] == "table" else i.get("text"))
    assert read_deck(deck_file([], 960, 540)) == []


def test_parts_are_whole():
    """Every part is well-formed and typed, and every link leads to a part."""
    data = deck_file(some_slides(), 960, 540)
    assert data == deck_file(some_slides(), 960, 540)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        types = ET.fromstring(z.read("[Content_Types].xml"))
        typed = {x.get("PartName", "").lstrip("/") for x in types}
        assert {n for n in names if n.endswith(".xml") and n != "[Content_Types].xml"} == typed - {""}
        for n in names:
            if n.endswith((".xml", ".rels")):
                ET.fromstring(z.read(n))
            if n.endswith(".rels"):
                folder = n.replace("_rels/", "").rpartition("/")[0]
                for x in ET.fromstring(z.read(n)):
                    parts = [p for p in f"{folder}/{x.get('Target')}".split("/") if p]
                    while ".." in parts:
                        k = parts.index("..")
                        del parts[k - 1 : k + 1]
                    assert "/".join(parts) in names
        ids = [x.get("id") for x in ET.fromstring(z.read("ppt/slides/slide1.xml")).iter("{http://schemas.openxmlformats.org/presentationml/2006/main}cNvPr")]
        assert len(set(ids)) == len(ids)


def test_a_batch_of_files_is_read_in_frames(monkeypatch):
    monkeypatch.setattr(slides, "ROWS", 10)
    data = deck_file(some_slides(), 960, 540)  # of 6 items
    frames = list(slides.item_frames([pd.DataFrame({"deck": range(7), "data": [data] * 7}), pd.DataFrame({"deck": range(7, 9), "data": [data] * 2})]))
    assert [len(f) for f in frames] == [12, 12, 12, 12, 6]
    got = pd.concat(frames)
    assert sorted(set(got["deck"])) == list(range(9)) and got.groupby("deck").size().eq(6).all()


def test_debug_images():
    image = np.random.default_rng(2).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    mask = image[..., 0] > 128
    files = debug_artifacts(image, mask, repaired=image[::-1])
    assert (pixels_of(files["page"]) == image).all() and (pixels_of(files["repaired"]) == image[::-1]).all()
    assert (pixels_of(files["mask"]) == 255 * mask).all()
    assert (pixels_of(files["masked"])[mask] == 255).all() and (pixels_of(files["masked"])[~mask] == image[~mask]).all()
