"""Queries over readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.functions.geometry import box
from lamella.operators import spatial as J
from lamella.sources import documents as D
from lamella.sources import sinks
from lamella.sources import slides as decks

from .registry import query


@query("src_spans", "SRC-02 SRC-04", """
WITH l AS (SELECT page, id, font, unnest(range(len(ls)))::INT AS line, unnest(ls) AS t FROM (SELECT *, string_split(text, chr(10)) AS ls FROM blocks)), s AS (SELECT page, id, font, line, unnest(range(len(ss)))::INT AS span, unnest(ss) AS t FROM (SELECT *, string_split(t, ' ') AS ss FROM l))
SELECT page, id, line, span, t AS text, coalesce(contains(lower(font), 'new'), false) AS bold FROM s WHERE trim(t) <> ''""")
def spans(v):
    """Nested blocks, lines and spans flattened; blank spans go. The sample fonts mark boldness by `New`."""
    span = lambda font: lambda t: F.struct(t.alias("text"), font.alias("font"))
    nested = v.blocks.select("page", "id", F.transform(F.split("text", "\n"), lambda line: F.struct(F.transform(F.split(line, " "), span(F.col("font"))).alias("spans"))).alias("lines"))
    lines = nested.select("page", "id", F.posexplode("lines").alias("line", "l"))
    rows = lines.select("page", "id", "line", F.posexplode("l.spans").alias("span", "s")).select("page", "id", "line", "span", "s.*").where("trim(text) <> ''")
    return rows.select("page", "id", "line", "span", "text", F.coalesce(F.lower("font").contains("new"), F.lit(False)).alias("bold"))


@query("src_words", "SRC-03 SRC-06", "SELECT page, id, x0, y0, x1, y1, text FROM words")
def words(v):
    """Raw word tuples, with malformed ones beside the true ones: rows that are short, blank, not numeric or of no extent go."""
    at = lambda *names: F.concat_ws(",", *[F.col(c).cast("string") for c in names])
    texts = v.words.select("page", "id", "text", at("x0", "y0", "x1", "y1").alias("box"), at("x1", "y0", "x0", "y1").alias("turned"))
    good = F.concat(F.lit("["), F.col("box"), F.lit(',"'), F.col("text"), F.lit('",0,0]'))
    short, blank, turned = (F.concat(F.lit("["), F.col(c), F.lit(more)) for c, more in (("box", "]"), ("box", ',"  "]'), ("turned", ',"t"]')))
    raw = texts.select("page", "id", F.explode(F.array(good, short, blank, F.lit('["a",1,2,3,"t"]'), turned, F.lit(None).cast("string"))).alias("raw"))
    return D.word_rows(raw, "raw", "page", "id")


@query("src_drawings", "SRC-05 SRC-07 SRC-08 SRC-09", """
WITH f AS (SELECT page, id, 'fill' AS part, x0, greatest(0.0, least(1.0, opacity * 1.5)) AS opacity, NULL::BIGINT AS ord FROM shapes WHERE fill IS NOT NULL), i AS (SELECT page, id, 'image' AS part, x0, 1.0 AS opacity, NULL::BIGINT AS ord FROM images),
p AS (SELECT page, id, CASE id % 4 WHEN 2 THEN 'paint image' ELSE 'paint path' END AS part, x0, 1.0 AS opacity, row_number() OVER (PARTITION BY page ORDER BY id) - 1 AS ord FROM shapes) SELECT * FROM f UNION ALL SELECT * FROM i UNION ALL SELECT * FROM p WHERE id % 4 < 3""")
def drawings(v):
    """Filled drawings with opacities in 0..1, image boxes, and the paint log by order and kind."""
    none, one = F.lit(None).cast("long"), F.lit(1.0)
    part = lambda df, name, opacity, ord_: df.select("page", "id", F.lit(name).alias("part") if isinstance(name, str) else name.alias("part"), "x0", opacity.alias("opacity"), ord_.alias("ord"))
    fills = part(v.shapes.where("fill IS NOT NULL"), "fill", F.greatest(F.lit(0.0), F.least(one, F.col("opacity") * 1.5)), none)
    op = F.element_at(F.array(*map(F.lit, ("fill-path", "stroke-path", "fill-image", "ignore-text"))), (F.col("id") % 4 + 1).cast("int"))
    log = v.shapes.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("id", op.alias("op"), "x0"))).alias("log")).select("page", F.posexplode("log").alias("ord", "e")).select("page", "ord", "e.*")
    kind = F.when(F.col("op").endswith("-path"), "paint path").when(F.col("op").endswith("-image"), "paint image")
    paint = part(log.withColumn("k", kind).where("k IS NOT NULL"), F.col("k"), one, F.col("ord").cast("long"))
    return fills.unionByName(part(v.images, "image", one, none)).unionByName(paint)


@query("src_image_elements", "SRC-10", """
WITH m AS (SELECT page, max(z) AS top FROM shapes GROUP BY page) SELECT page, id, (coalesce(top, 0) + row_number() OVER (PARTITION BY page ORDER BY id))::INT AS z FROM images LEFT JOIN m USING (page) WHERE x1 - x0 > 1 AND y1 - y0 > 1""")
def image_elements(v):
    """Images of more than a point each way, stacked above all drawings of the page."""
    top = v.shapes.groupBy("page").agg(F.max("z").alias("top"))
    rows = J.ranked(v.images.where((box().w > 1) & (box().h > 1)), ["page"], F.col("id")).join(top, "page", "left")
    return rows.select("page", "id", (F.coalesce("top", F.lit(0)) + F.col("rank")).cast("int").alias("z"))


@query("src_layout_payload", "SRC-13 SRC-16", """
SELECT page, id, x0, y1, CASE WHEN id % 5 = 4 THEN 0.0 ELSE confidence END AS confidence, label FROM regions WHERE id % 7 < 6""")
def layout_payload(v):
    """Region lists at several depths and under several keys; a payload without boxes gives none."""
    nums = F.concat_ws(",", *[F.col(c).cast("string") for c in box()._fields])
    keys = F.when(F.col("id") % 2 == 0, "coordinate").otherwise("bbox")
    conf = F.when(F.col("id") % 5 == 4, "").otherwise(F.concat(F.lit(',"'), F.when(F.col("id") % 3 == 0, "score").otherwise("confidence"), F.lit('":'), F.col("confidence").cast("string")))
    boxes = F.concat(F.lit('[{"'), keys, F.lit('":['), nums, F.lit('],"label":"'), F.col("label"), F.lit('"'), conf, F.lit("}]"))
    wrap = lambda k, x: F.concat(F.lit(f'{{"{k}":'), x, F.lit("}"))
    i = F.col("id") % 7
    own = wrap("boxes", boxes)
    raw = F.when(i == 0, own).when(i == 1, wrap("res", own)).when(i == 2, wrap("data", wrap("result", own))).when(i == 3, wrap("layout_det_res", wrap("res", wrap("data", own)))).when(i < 6, boxes).otherwise(wrap("other", own))
    rows = v.regions.select("page", "id", F.explode(D.layout_boxes(raw)).alias("r"))
    return rows.select("page", "id", F.get("r.bbox", F.lit(0)).alias("x0"), F.get("r.bbox", F.lit(3)).alias("y1"), "r.confidence", "r.label")


@query("src_ocr_payload", "SRC-14 SRC-15", """
SELECT page, id, 1 AS pos, concat('t', id) AS text, confidence AS score, x0, y1 FROM blocks UNION ALL SELECT page, id, 3, concat('u', id), 0.5, x0 + 1, y1 + 1 FROM blocks""")
def ocr_payload(v):
    """Recognition results in three shapes; the blank second entry goes, and leaves a gap."""
    s = lambda c: F.col(c).cast("string")
    poly = lambda d: F.concat(F.lit("[["), (F.col("x0") + d).cast("string"), F.lit(","), (F.col("y0") + d).cast("string"), F.lit("],["), (F.col("x1") + d).cast("string"), F.lit(","), (F.col("y1") + d).cast("string"), F.lit("]]"))
    columns = F.concat(F.lit('{"rec_texts":["t'), s("id"), F.lit('"," ","u'), s("id"), F.lit('"],"rec_scores":['), s("confidence"), F.lit(',0.1,0.5],"dt_polys":['), poly(0), F.lit(","), poly(0), F.lit(","), poly(1), F.lit("]}"))
    one = lambda d, t, c: F.concat(F.lit("["), poly(d), F.lit(',["'), t, F.lit('",'), c, F.lit("]]"))
    pairs = F.concat(F.lit("["), one(0, F.concat(F.lit("t"), s("id")), s("confidence")), F.lit(","), one(0, F.lit(" "), F.lit("0.1")), F.lit(","), one(1, F.concat(F.lit("u"), s("id")), F.lit("0.5")), F.lit("]"))
    i = F.col("id") % 3
    raw = F.when(i == 0, columns).when(i == 1, F.concat(F.lit('{"res":'), columns, F.lit("}"))).otherwise(pairs)
    rows = v.blocks.select("page", "id", F.explode(D.recognised(raw)).alias("r"))
    return rows.select("page", "id", "r.pos", "r.text", "r.score", F.get("r.box", F.lit(0)).alias("x0"), F.get("r.box", F.lit(3)).alias("y1"))


@query("src_deck_round_trip", "SRC-01 SRC-11 SNK-03 SNK-04 SNK-06", """
SELECT page, count(*) AS n, sum(x0) AS x0, string_agg(id::VARCHAR, ',' ORDER BY reading_order, id) AS reading_order, string_agg(text, '|' ORDER BY id) AS texts, count(font_size) AS sized FROM blocks GROUP BY page""")
def deck_round_trip(v):
    """Pages as nested JSON and back: what was written is what is read, in the same orders."""
    text = sinks.page_json(v.blocks)
    page = F.from_json("json", "struct<page_number:bigint,text_blocks:array<struct<id:bigint,bbox:array<double>,text:string,font_size:double>>,reading_order:array<bigint>>")
    p = text.select(page.alias("p")).select("p.*")
    ids = F.array_join(F.transform("reading_order", lambda x: x.cast("string")), ",")
    x0 = F.aggregate("text_blocks", F.lit(0.0), lambda a, b: a + F.get(b["bbox"], F.lit(0)))
    sized = F.size(F.filter("text_blocks", lambda b: b["font_size"].isNotNull())).cast("long")
    return p.select(F.col("page_number").alias("page"), F.size("text_blocks").cast("long").alias("n"), x0.alias("x0"), ids.alias("reading_order"), F.array_join(F.transform("text_blocks", lambda b: b["text"]), "|").alias("texts"), sized.alias("sized"))


@query("src_archive_entries", "SRC-24", """
WITH e AS (SELECT id % 100 AS archive, path, (id * 37 % 2000)::BIGINT AS size, (id * 11 % 40)::BIGINT AS packed FROM files), r AS (SELECT *, CASE WHEN size > 1990 THEN 'entry too large' WHEN size > 100.0 * greatest(1, packed) THEN 'ratio' END AS problem FROM e)
SELECT archive, count(*) AS entries, sum(size)::BIGINT AS bytes, CASE WHEN count(*) > 2000 THEN 'too many entries' WHEN sum(size) > 140000 THEN 'too large' ELSE min(problem) END AS problem FROM r GROUP BY archive""")
def archive_entries(v):
    """Limits of archives over a relation of their entries."""
    limits = {**D.LIMITS, "entry_bytes": 1990, "total_bytes": 140_000}
    e = v.files.select((F.col("id") % 100).alias("archive"), "path", (F.col("id") * 37 % 2000).alias("size"), (F.col("id") * 11 % 40).alias("packed"))
    e = e.withColumn("problem", D.entry_problem(F.col("path"), F.col("size"), F.col("packed"), limits))
    g = e.groupBy("archive").agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"), F.min("problem").alias("problem"))
    return g.withColumn("problem", F.when(F.col("entries") > limits["entries"], "too many entries").when(F.col("bytes") > limits["total_bytes"], "too large").otherwise(F.col("problem")))


@query("src_model_scan", "SRC-28", "SELECT id, upper(text) AS text FROM blocks WHERE source = 'ocr'")
def model_scan(v):
    """Images read by a model in micro-batches; the sample model knows its images' texts."""
    return D.scanned(v.blocks.where("source = 'ocr'").select("id", F.col("text").cast("binary").alias("image")), lambda: lambda images: [bytes(i).decode().upper() for i in images])


@query("sink_summary", "SNK-07 SNK-08 SNK-09", """
SELECT id, concat('| ', path, ' | ', status, ' | ', printf('%.3f', seconds), ' | ', CASE WHEN cost IS NULL THEN '-' ELSE printf('$%.6f', cost) END, ' |') AS line, coalesce(cost::VARCHAR, '') AS cost_text, n_pages::VARCHAR AS pages_text FROM files""")
def summary(v):
    """Rows of a batch summary as Markdown lines and CSV texts."""
    csv = sinks.summary_csv(v.files, ["id", "cost", "n_pages"]).select(F.col("id").cast("long").alias("id"), F.col("cost").alias("cost_text"), F.col("n_pages").alias("pages_text"))
    lines = v.files.select("id", sinks.summary_line(F.col("path"), F.col("status"), F.col("seconds"), F.col("cost")).alias("line"))
    return lines.join(csv, "id")


@query("sink_reports", "SNK-11 SNK-13", """
SELECT page, list_sort(list(to_json({'id': id, 'kind': kind, 'evidence': evidence})::VARCHAR)) AS entries FROM issues GROUP BY page""")
def reports(v):
    """Issues of a page as report entries."""
    entry = F.to_json(F.struct("id", "kind", "evidence"))
    return v.issues.groupBy("page").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


@query("sink_slides", "SNK-01", """
WITH i AS (SELECT page, 0 AS layer, z AS ord, id, 'shape' AS kind, x0, y0, x1, y1, NULL AS text FROM shapes UNION ALL SELECT page, 1, reading_order, id, 'text', x0, y0, x1, y1, text FROM blocks)
SELECT page, kind, id, (row_number() OVER (PARTITION BY page ORDER BY layer, ord, id) - 1)::INT AS place, x0, y0, x1, y1, text FROM i""")
def slides(v):
    """Shapes and texts written as editable slide files, ten pages a deck, and read from the files again."""
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    box_ = ["x0", "y0", "x1", "y1"]
    deck = F.floor(F.col("page") / 10).alias("deck")
    shapes = v.shapes.select(deck, "page", F.lit(0).alias("layer"), F.col("z").alias("ord"), "id", F.lit("shape").alias("kind"), *box_, *none("string", "text"), *none("double", "font_size"), *none("boolean", "bold", "italic"), *none("string", "font"), "fill", "stroke", "stroke_width", "opacity", F.col("kind").alias("form"))
    texts = v.blocks.select(deck, "page", F.lit(1).alias("layer"), F.col("reading_order").alias("ord"), "id", F.lit("text").alias("kind"), *box_, "text", "font_size", "bold", "italic", "font", *none("string", "fill", "stroke"), *none("double", "stroke_width", "opacity"), *none("string", "form"))
    read = decks.deck_items(decks.deck_files(shapes.unionByName(texts), 960.0, 540.0))
    name = F.split("name", " ")
    return read.select(F.get(name, F.lit(1)).cast("long").alias("page"), "kind", F.get(name, F.lit(2)).cast("long").alias("id"), "place", *[F.round(c, 4).alias(c) for c in box_], "text")
