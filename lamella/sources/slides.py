"""Editable slide files: a writer and a reader of the parts of the open presentation format that are used here.

A deck is a bounded unit: its items are grouped, put in paint order and packed
by one call, so decks are written in parallel and each on its own.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the format: its name spaces, part types and units of a point.
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
PART = "application/vnd.openxmlformats-officedocument.presentationml"
EMU = 12_700
_NS = {"a": A, "p": P, "r": R}
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_TREE = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'


def _root(tag: str, body: str, more: str = "") -> str:
    return f'{_HEAD}<p:{tag} xmlns:a="{A}" xmlns:p="{P}" xmlns:r="{R}"{more}>{body}</p:{tag}>'


def _links(links: Iterable[tuple[str, str]]) -> str:
    rows = "".join(f'<Relationship Id="rId{n}" Type="{R}/{kind}" Target="{target}"/>' for n, (kind, target) in enumerate(links, 1))
    return f'{_HEAD}<Relationships xmlns="{PACKAGE}/relationships">{rows}</Relationships>'


def _emu(points: float) -> int:
    return int(np.floor(points * EMU + 0.5))


def _frame(box: tuple, tag: str = "a") -> str:
    x, y, w, h = _emu(box[0]), _emu(box[1]), max(0, _emu(box[2]) - _emu(box[0])), max(0, _emu(box[3]) - _emu(box[1]))
    return f'<{tag}:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="{w}" cy="{h}"/></{tag}:xfrm>'


def _paint(colour: str | None, opacity: float = 1.0) -> str:
    if not colour:
        return "<a:noFill/>"
    alpha = "" if opacity >= 1 else f'<a:alpha val="{int(opacity * 100_000)}"/>'
    return f'<a:solidFill><a:srgbClr val="{colour.lstrip("#")}">{alpha}</a:srgbClr></a:solidFill>'


def _paragraphs(text: str, size: float | None = None, bold: bool = False, italic: bool = False, font: str | None = None) -> str:
    style = "".join([f' sz="{int(round(size * 100))}"' if size else "", ' b="1"' if bold else "", ' i="1"' if italic else ""])
    face = f"<a:latin typeface={quoteattr(font)}/>" if font else ""
    line = lambda t: f'<a:p><a:r><a:rPr lang="en-US"{style}>{face}</a:rPr><a:t>{escape(t)}</a:t></a:r></a:p>' if t else "<a:p/>"
    return "<a:bodyPr/><a:lstStyle/>" + "".join(map(line, text.split("\n")))


def _item(number: int, item: dict, picture: str | None) -> str:
    name, box = f'<p:cNvPr id="{number}" name={quoteattr(item["name"])}/>', item["box"]
    if item["kind"] == "text":
        return f'<p:sp><p:nvSpPr>{name}<p:cNvSpPr txBox="1"/><p:nvPr/></p:nvSpPr><p:spPr>{_frame(box)}<a:prstGeom prst="rect"><a:avLst/></a:prstGeom><a:noFill/></p:spPr><p:txBody>{_paragraphs(item["text"], item.get("size"), item.get("bold", False), item.get("italic", False), item.get("font"))}</p:txBody></p:sp>'
    if item["kind"] == "table":
        rows, (x0, y0, x1, y1) = item["rows"], box
        width, height = _emu(x1 - x0) // max(1, len(rows[0])), _emu(y1 - y0) // max(1, len(rows))
        grid = "".join(f'<a:gridCol w="{width}"/>' for _ in rows[0])
        body = "".join(f'<a:tr h="{height}">' + "".join(f"<a:tc><a:txBody>{_paragraphs(c)}</a:txBody><a:tcPr/></a:tc>" for c in row) + "</a:tr>" for row in rows)
        return f'<p:graphicFrame><p:nvGraphicFramePr>{name}<p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr>{_frame(box, "p")}<a:graphic><a:graphicData uri="{A.replace("/main", "/table")}"><a:tbl><a:tblPr/><a:tblGrid>{grid}</a:tblGrid>{body}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    if item["kind"] == "picture":
        return f'<p:pic><p:nvPicPr>{name}<p:cNvPicPr/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="{picture}"/><a:stretch><a:fillRect/></a:stretch></p:blipFill><p:spPr>{_frame(box)}<a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr></p:pic>'
    line = f'<a:ln w="{_emu(item.get("stroke_width") or 1)}">{_paint(item["stroke"])}</a:ln>' if item.get("stroke") else "<a:ln><a:noFill/></a:ln>"
    form = "line" if item.get("form") == "line" else "rect"
    return f'<p:sp><p:nvSpPr>{name}<p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr>{_frame(box)}<a:prstGeom prst="{form}"><a:avLst/></a:prstGeom>{_paint(item.get("fill"), item.get("opacity") or 1.0)}{line}</p:spPr></p:sp>'


def deck_file(slides: list[list[dict]], width: float, height: float) -> bytes:
    """A presentation with a slide for each list of items, painted in order.

    Items have a name, a kind (text, shape, table, picture) and a box in
    points; pictures have their PNG in `data`. A file does not depend on when
    it is written.
    """
    count = len(slides)
    colours = "".join(f'<a:{n}><a:srgbClr val="{v}"/></a:{n}>' for n, v in zip("dk1 lt1 dk2 lt2 accent1 accent2 accent3 accent4 accent5 accent6 hlink folHlink".split(), "000000 FFFFFF 333333 EEEEEE 4472C4 ED7D31 A5A5A5 FFC000 5B9BD5 70AD47 0563C1 954F72".split()))
    face = '<a:latin typeface="Arial"/><a:ea typeface=""/><a:cs typeface=""/>'
    plain = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>'
    theme = f'{_HEAD}<a:theme xmlns:a="{A}" name="plain"><a:themeElements><a:clrScheme name="plain">{colours}</a:clrScheme><a:fontScheme name="plain"><a:majorFont>{face}</a:majorFont><a:minorFont>{face}</a:minorFont></a:fontScheme><a:fmtScheme name="plain"><a:fillStyleLst>{plain * 3}</a:fillStyleLst><a:lnStyleLst>{f"<a:ln>{plain}</a:ln>" * 3}</a:lnStyleLst><a:effectStyleLst>{"<a:effectStyle><a:effectLst/></a:effectStyle>" * 3}</a:effectStyleLst><a:bgFillStyleLst>{plain * 3}</a:bgFillStyleLst></a:fmtScheme></a:themeElements></a:theme>'
    mapping = " ".join(f'{a}="{b}"' for a, b in zip("bg1 tx1 bg2 tx2 accent1 accent2 accent3 accent4 accent5 accent6 hlink folHlink".split(), "lt1 dk1 lt2 dk2 accent1 accent2 accent3 accent4 accent5 accent6 hlink folHlink".split()))
    ids = "".join(f'<p:sldId id="{256 + n}" r:id="rId{n + 1}"/>' for n in range(1, count + 1))
    parts: dict[str, str | bytes] = {
        "_rels/.rels": _links([("officeDocument", "ppt/presentation.xml")]),
        "ppt/presentation.xml": _root("presentation", f'<p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="{_emu(width)}" cy="{_emu(height)}"/><p:notesSz cx="{_emu(height)}" cy="{_emu(width)}"/>'),
        "ppt/_rels/presentation.xml.rels": _links([("slideMaster", "slideMasters/slideMaster1.xml"), *[("slide", f"slides/slide{n}.xml") for n in range(1, count + 1)]]),
        "ppt/theme/theme1.xml": theme,
        "ppt/slideMasters/slideMaster1.xml": _root("sldMaster", f'<p:cSld><p:spTree>{_TREE}</p:spTree></p:cSld><p:clrMap {mapping}/><p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst>'),
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": _links([("slideLayout", "../slideLayouts/slideLayout1.xml"), ("theme", "../theme/theme1.xml")]),
        "ppt/slideLayouts/slideLayout1.xml": _root("sldLayout", f"<p:cSld><p:spTree>{_TREE}</p:spTree></p:cSld><p:clrMapOvr><a:masterClrMapping/></p:clrMapOvr>", ' type="blank"'),
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": _links([("slideMaster", "../slideMasters/slideMaster1.xml")]),
    }
    media = 0
    for n, items in enumerate(slides, 1):
        links, body = [("slideLayout", "../slideLayouts/slideLayout1.xml")], []
        for k, item in enumerate(items):
            picture = None
            if item["kind"] == "picture":
                media += 1
                parts[f"ppt/media/image{media}.png"] = item["data"]
                links.append(("image", f"../media/image{media}.png"))
                picture = f"rId{len(links)}"
            body.append(_item(k + 2, item, picture))
        parts[f"ppt/slides/slide{n}.xml"] = _root("sld", f"<p:cSld><p:spTree>{_TREE}{''.join(body)}</p:spTree></p:cSld><p:clrMapOvr><a:masterClrMapping/></p:clrMapOvr>")
        parts[f"ppt/slides/_rels/slide{n}.xml.rels"] = _links(links)
    kinds = {"presentation.xml": "presentation.main", "slideMaster1.xml": "slideMaster", "slideLayout1.xml": "slideLayout"}
    types = "".join(f'<Override PartName="/{p}" ContentType="{PART}.{kinds.get(p.rpartition("/")[2], "slide")}+xml"/>' for p in parts if p.endswith(".xml") and "theme" not in p)
    types += '<Override PartName="/ppt/theme/theme1.xml" ContentType="application/vnd.openxmlformats-officedocument.theme+xml"/>'
    defaults = f'<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in {"[Content_Types].xml": f'{_HEAD}<Types xmlns="{PACKAGE}/content-types">{defaults}{types}</Types>', **parts}.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def read_deck(data: bytes) -> list[list[dict]]:
    """The items of each slide of a file, in paint order: name, kind, box in points, text (cells by tabs)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        links = {x.get("Id"): x.get("Target") for x in ET.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
        order = [links[x.get(f"{{{R}}}id")] for x in ET.fromstring(z.read("ppt/presentation.xml")).iterfind("p:sldIdLst/p:sldId", _NS)]
        return [[_read_item(x) for x in ET.fromstring(z.read(f"ppt/{name}")).find("p:cSld/p:spTree", _NS) if x.tag.rpartition("}")[2] in ("sp", "pic", "graphicFrame")] for name in order]


def _read_item(x: ET.Element) -> dict:
    tag = x.tag.rpartition("}")[2]
    frame = x.find("p:xfrm", _NS) if tag == "graphicFrame" else x.find("p:spPr/a:xfrm", _NS)
    at, size = frame.find("a:off", _NS), frame.find("a:ext", _NS)
    x0, y0 = int(at.get("x")) / EMU, int(at.get("y")) / EMU
    lines = lambda e: "\n".join("".join(t.text or "" for t in p.iterfind(".//a:t", _NS)) for p in e.iterfind("a:p", _NS))
    if tag == "graphicFrame":
        kind, text = "table", "\n".join("\t".join(lines(c) for c in r.iterfind("a:tc/a:txBody", _NS)) for r in x.iterfind(".//a:tr", _NS))
    else:
        body = x.find("p:txBody", _NS)
        kind, text = "picture" if tag == "pic" else "shape" if body is None else "text", None if body is None else lines(body)
    return {"name": x.find(".//p:cNvPr", _NS).get("name"), "kind": kind, "box": (x0, y0, x0 + int(size.get("cx")) / EMU, y0 + int(size.get("cy")) / EMU), "text": text}


def deck_files(items: DataFrame, width: float, height: float) -> DataFrame:
    """(deck, page, layer, ord, id, kind, x0, y0, x1, y1, and texts' text, font_size, bold, italic, font, shapes' fill,
    stroke, stroke_width, opacity, form) -> (deck, data binary): a file for each deck, slides by page, painted by
    layer, ord and id."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page", "layer", "ord", "id"]).astype(object)
        pdf = pdf.where(pdf.notna(), None)
        slides = []
        for _, rows in pdf.groupby("page", sort=True):
            slides.append([{**r, "name": f"{r['kind']} {r['page']} {r['id']}", "box": (r["x0"], r["y0"], r["x1"], r["y1"]), "size": r["font_size"], "text": r["text"] or ""} for r in rows.to_dict("records")])
        return pd.DataFrame({"deck": [int(pdf["deck"].iloc[0])], "data": [deck_file(slides, width, height)]})

    return items.groupBy("deck").applyInPandas(pack, "deck long, data binary")


#: Rows of items in a frame: a batch of files holds many times its own size in items.
ROWS = 10_000
_ITEM = "deck slide place name kind x0 y0 x1 y1 text".split()


def item_frames(files: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of the items in batches of files (deck, data); a frame ends with the deck that brings it to ROWS."""
    rows: list[tuple] = []
    for pdf in files:
        for d, data in zip(pdf["deck"], pdf["data"]):
            rows += [(d, s, p, i["name"], i["kind"], *i["box"], i["text"]) for s, slide in enumerate(read_deck(data)) for p, i in enumerate(slide)]
            if len(rows) >= ROWS:
                yield pd.DataFrame(rows, columns=_ITEM)
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=_ITEM)


def deck_items(files: DataFrame) -> DataFrame:
    """(deck, data) -> (deck, slide, place, name, kind, x0, y0, x1, y1, text) of the items in the files."""
    return files.select("deck", "data").mapInPandas(item_frames, "deck long, slide int, place int, name string, kind string, x0 double, y0 double, x1 double, y1 double, text string")


# ------------------------------------------------------------------ debug images


def png(image: np.ndarray) -> bytes:
    """A PNG of an RGB image or, in shades, of a mask."""
    pixels = np.where(image, np.uint8(255), np.uint8(0)) if image.dtype == bool else image.astype(np.uint8)
    rows = pixels.reshape(pixels.shape[0], -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes())) + chunk(b"IEND", b"")


def pixels_of(data: bytes) -> np.ndarray:
    """The pixels of a PNG that png() made."""
    at, found = 8, {}
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        found[kind] = found.get(kind, b"") + data[at + 8 : at + 8 + n]
        at += n + 12
    width, height, _, colour = struct.unpack(">IIBB", found[b"IHDR"][:10])
    flat = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(height, -1)[:, 1:]
    return flat.reshape(height, width, 3) if colour == 2 else flat


def debug_artifacts(image: np.ndarray, mask: np.ndarray, **more: np.ndarray) -> dict[str, bytes]:
    """PNGs by name: the page, the mask, the page with the mask painted white, and what else is given."""
    return {"page": png(image), "mask": png(mask), "masked": png(np.where(mask[..., None], np.uint8(255), image)), **{k: png(v) for k, v in more.items()}}
