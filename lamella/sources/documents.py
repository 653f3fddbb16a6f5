"""Readers of decks, recognition payloads, drawings, archives and file lists.

Everything is read by Spark's own readers, so any store that Spark reaches
will do, and decoded by expressions; only archives need a Python decoder.
"""

from __future__ import annotations

import io
import stat
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.text import safe_member

VERSION = "1.0"
BLOCK = "struct<id:string,source:string,bbox:array<double>,text:string,confidence:double,font_family:string,font_size:double,bold:boolean,italic:boolean,reading_order:int,role:string>"
PAGE = f"struct<page_number:int,width_pt:double,height_pt:double,page_kind:string,background_mode:string,text_blocks:array<{BLOCK}>>"
DECK = f"schema_version string, source_path string, slide_width_pt double, slide_height_pt double, pages array<{PAGE}>"


def read_decks(spark: SparkSession, path: str) -> DataFrame:
    """A row for each page of the deck documents under path, in page order.

    A document of another version, without pages or of no positive size, and
    one that does not parse, fail the read with a message that names it.
    """
    raw = spark.read.schema(DECK).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.input_file_name())
    return deck_pages(raw)


def deck_pages(decks: DataFrame) -> DataFrame:
    wrong = (
        F.when(F.col("schema_version").isNull() | (F.col("schema_version") != VERSION), F.concat(F.lit("schema version of "), F.col("file")))
        .when(~F.coalesce((F.col("slide_width_pt") > 0) & (F.col("slide_height_pt") > 0), F.lit(False)), F.concat(F.lit("page size of "), F.col("file")))
        .when(~F.coalesce(F.size("pages") > 0, F.lit(False)), F.concat(F.lit("no pages in "), F.col("file")))
    )
    checked = decks.withColumn("pages", F.when(wrong.isNotNull(), F.raise_error(wrong).cast(f"array<{PAGE}>")).otherwise(F.col("pages")))
    pages = checked.select("file", "slide_width_pt", "slide_height_pt", F.posexplode("pages").alias("pos", "p"))
    return pages.select("file", "pos", "slide_width_pt", "slide_height_pt", "p.*")


def blocks_of(pages: DataFrame) -> DataFrame:
    b = pages.select("file", F.col("page_number").alias("page"), F.explode("text_blocks").alias("b"))
    box = [F.get("b.bbox", F.lit(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]
    return b.select("file", "page", *box, "b.*").drop("bbox")


def word_fields(raw: Column) -> Column:
    """[x0, y0, x1, y1, text, ...] as a struct; null if fields are missing, blank, not numeric or of no extent."""
    return _word(F.from_json(raw, "array<string>"))


#: A flat word: numbers and quoted texts that neither a comma, an escape nor a sign of control stands in, the fifth quoted.
_Q = r'"[^"\\,\x00-\x1f\x7f]*"'
_N = r"-?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]{1,15})?"
_FLAT = rf"^\[(?:(?:{_N}|{_Q}),){{4}}{_Q}(?:,(?:{_N}|{_Q})){{0,40}}\]\z"


def _word_parts(raw: Column) -> Column:
    """The fields of a word as texts; null if they are no five. Flat words are split, which takes a third of a parser's time."""
    flat = F.split(F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('"'), F.lit("")), ",")
    short = F.substring_index(raw, ",", 4) == raw
    return F.when(raw.isNull() | short, F.lit(None)).when(raw.rlike(_FLAT), flat).otherwise(F.from_json(raw, "array<string>"))


def word_rows(rows: DataFrame, raw: str, *keep: str) -> DataFrame:
    """(keep, x0, y0, x1, y1, text) of the rows whose raw word has word_fields.

    A generator gives the parsed fields, as a projection's would be put in place of each of their uses in the
    filter and behind it.
    """
    parts = F.explode(F.array(_word_parts(F.col(raw))))
    fields = rows.select(*keep, parts.alias("lm_parts")).select(*keep, _word(F.col("lm_parts")).alias("lm_word"))
    return fields.where("lm_word IS NOT NULL").select(*keep, "lm_word.*")


def _word(parts: Column) -> Column:
    box = [F.get(parts, F.lit(k)).try_cast("double") for k in range(4)]
    text = F.get(parts, F.lit(4))
    fit = (F.size(parts) >= 5) & (F.trim(text) != "") & (box[2] > box[0]) & (box[3] > box[1])
    return F.when(F.coalesce(fit, F.lit(False)), F.struct(*[b.alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"))], text.alias("text")))


REGION = "array<struct<coordinate:array<double>,bbox:array<double>,score:double,confidence:double,label:string>>"
WRAPPERS = ("res", "result", "data", "layout_det_res")


def layout_boxes(payload: Column, depth: int = 3) -> Column:
    """The first list of boxes in a payload, under any of the wrappers, at most `depth` of them deep."""

    def kind(d: int) -> str:
        inner = "".join(f",{w}:{kind(d - 1)}" for w in WRAPPERS) if d else ""
        return f"struct<boxes:{REGION}{inner}>"

    def search(node: Column, d: int) -> list[Column]:
        return [node["boxes"], *[c for w in WRAPPERS for c in search(node[w], d - 1)]] if d else [node["boxes"]]

    found = F.coalesce(*search(F.from_json(payload, kind(depth)), depth), F.when(payload.startswith("["), F.from_json(payload, REGION)))
    return F.transform(found, lambda r: F.struct(F.coalesce(r["coordinate"], r["bbox"]).alias("bbox"), F.coalesce(r["score"], r["confidence"], F.lit(0.0)).alias("confidence"), r["label"].alias("label")))


COLUMNAR = "rec_texts:array<string>,rec_scores:array<double>,dt_polys:array<array<array<double>>>"


def recognised(payload: Column) -> Column:
    """(pos, text, score, box) of a recognition payload in any of three shapes; blank texts go, places stay.

    Shapes: columns of texts, scores and polygons; the same under a wrapper;
    a list of [polygon, [text, score]].
    """
    node = F.from_json(payload, f"struct<{COLUMNAR},{','.join(f'{w}:struct<{COLUMNAR}>' for w in WRAPPERS)}>")
    texts, scores, polys = (F.coalesce(node[n], *[node[w][n] for w in WRAPPERS]) for n in ("rec_texts", "rec_scores", "dt_polys"))
    columns = F.transform(F.arrays_zip(texts.alias("t"), scores.alias("s"), polys.alias("p")), lambda x: F.struct(x["t"].alias("text"), x["s"].alias("score"), x["p"].alias("poly")))
    pairs = F.transform(
        F.from_json(payload, "array<array<string>>"),
        lambda x: F.struct(F.get(F.from_json(F.get(x, F.lit(1)), "array<string>"), F.lit(0)).alias("text"), F.get(F.from_json(F.get(x, F.lit(1)), "array<string>"), F.lit(1)).try_cast("double").alias("score"), F.from_json(F.get(x, F.lit(0)), "array<array<double>>").alias("poly")),
    )
    rows = F.when(texts.isNotNull(), columns).otherwise(pairs)
    numbered = F.transform(rows, lambda x, i: F.struct((i + 1).alias("pos"), x["text"].alias("text"), x["score"].alias("score"), _extent(x["poly"]).alias("box")))
    return F.filter(numbered, lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) != "")


def _extent(poly: Column) -> Column:
    xs, ys = F.transform(poly, lambda p: p[0]), F.transform(poly, lambda p: p[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def files_of(spark: SparkSession, folder: str, suffix: str = "pdf", recursive: bool = True) -> DataFrame:
    """Paths under folder by suffix, case apart, in order; hidden files, and those in hidden folders, are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length", "modificationTime")
    return found.where(F.col("path").rlike(f"(?i)\\.{suffix}$") & ~F.col("path").rlike("/\\.[^/]")).orderBy("path")


LIMITS = {"entries": 2_000, "entry_bytes": 100 << 20, "total_bytes": 500 << 20, "ratio": 100.0}


def archive_problem(data: bytes, limits: dict) -> tuple[int, int, str | None]:
    """(entries, bytes, what is wrong with the archive or None), from its directory alone."""
    try:
        infos = zipfile.ZipFile(io.BytesIO(data)).infolist()
    except (zipfile.BadZipFile, OSError) as e:
        return 0, 0, f"not an archive: {e}"
    total = sum(i.file_size for i in infos)
    names = [i.filename.replace("\\", "/") for i in infos]
    rules = [
        (len(infos) > limits["entries"], "too many entries"),
        (any(n.startswith("/") or n[1:2] == ":" or ".." in n.split("/") for n in names), "path outside"),
        (any(stat.S_ISLNK(i.external_attr >> 16) for i in infos), "link"),
        (any(i.file_size > limits["entry_bytes"] for i in infos), "entry too large"),
        (total > limits["total_bytes"], "too large"),
        (any(i.file_size > limits["ratio"] * max(1, i.compress_size) for i in infos), "ratio"),
    ]
    return len(infos), total, next((text for hit, text in rules if hit), None)


def checked_archives(files: DataFrame, limits: dict | None = None) -> DataFrame:
    """(path, entries, bytes, problem) for rows of the binaryFile reader."""
    limits = {**LIMITS, **(limits or {})}

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(p, *archive_problem(c, limits)) for p, c in zip(pdf["path"], pdf["content"])], columns=["path", "entries", "bytes", "problem"])

    return files.select("path", "content").mapInPandas(run, "path string, entries int, bytes long, problem string")


def entries_of(files: DataFrame, limits: dict | None = None) -> DataFrame:
    """(path, name, content) of the entries of archives without a problem.

    The bytes that come out are counted as they are read, as a directory may
    tell less than is there; an archive that exceeds a limit gives no entry.
    """
    limits = {**LIMITS, **(limits or {})}

    def read(data: bytes) -> list[tuple[str, bytes]]:
        if archive_problem(data, limits)[2]:
            return []
        out, total = [], 0
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                with z.open(info) as f:
                    content = f.read(limits["entry_bytes"] + 1)
                total += len(content)
                if len(content) > limits["entry_bytes"] or total > limits["total_bytes"]:
                    return []
                out.append((info.filename, content))
        return out

    def run(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                if found := read(data):
                    yield pd.DataFrame([(path, n, c) for n, c in found], columns=["path", "name", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, content binary")


def upload_kind(path: Column) -> Column:
    """How an upload is read: as a document, or an image as a document of one page; null for others."""
    p = F.lower(path)
    return F.when(p.endswith(".pdf"), "document").when(p.rlike("\\.(png|jpe?g)$"), "image")


def entry_problem(name: Column, size: Column, packed: Column, limits: dict) -> Column:
    """The same rules over a relation of entries; null if an entry is fine."""
    return F.when(~safe_member(name), "path outside").when(size > limits["entry_bytes"], "entry too large").when(size > limits["ratio"] * F.greatest(F.lit(1), packed), "ratio")


def scanned(images: DataFrame, load_model, batch: int = 3) -> DataFrame:
    """(page, text) read by a model, which is loaded once in each worker and given `batch` images at a time."""

    def run(batches):
        model = load_model()
        for pdf in batches:
            texts = [t for a in range(0, len(pdf), batch) for t in model(pdf["image"].iloc[a : a + batch].tolist())]
            yield pd.DataFrame({"id": pdf["id"], "text": texts})

    return images.select("id", "image").mapInPandas(run, "id long, text string")
