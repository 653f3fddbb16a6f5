import json
import stat
import zipfile

import pytest
from pyspark.sql import functions as F

from lamella.operators import pages as P
from lamella.plans.page_queries import converted
from lamella.sources import documents as D
from lamella.sources import sinks
from lamella.streaming import ledger


def deck(**more):
    block = {"id": "b1", "source": "native", "bbox": [1, 2, 3, 4], "text": "hi", "confidence": 1.0, "reading_order": 1}
    page = {"page_number": 1, "width_pt": 960, "height_pt": 540, "text_blocks": [block, {**block, "id": "b2", "bbox": [5, 6, 7, 8]}]}
    return {"schema_version": "1.0", "source_path": "x.pdf", "slide_width_pt": 960, "slide_height_pt": 540, "pages": [page, {**page, "page_number": 2}], **more}


def write(path, content):
    path.write_text(content if isinstance(content, str) else json.dumps(content, indent=1))
    return str(path)


def test_decks(spark, tmp_path):
    pages = D.read_decks(spark, write(tmp_path / "a.json", deck()))
    rows = sorted(pages.collect(), key=lambda r: r.pos)
    assert [(r.pos, r.page_number, r.slide_width_pt) for r in rows] == [(0, 1, 960.0), (1, 2, 960.0)]
    blocks = D.blocks_of(pages).collect()
    assert len(blocks) == 4 and {(b.id, b.x0, b.y1) for b in blocks} == {("b1", 1.0, 4.0), ("b2", 5.0, 8.0)}


@pytest.mark.parametrize("bad", [{"schema_version": "2.0"}, {"schema_version": None}, {"pages": []}, {"slide_width_pt": 0}, "{not json"])
def test_bad_decks_fail_the_read(spark, tmp_path, bad):
    path = write(tmp_path / "bad.json", bad if isinstance(bad, str) else deck(**bad))
    with pytest.raises(Exception, match="schema version|no pages|page size|Malformed|MALFORMED|FAILED_READ_FILE"):
        D.read_decks(spark, path).collect()


def test_written_decks_read_back(spark, tmp_path):
    D.read_decks(spark, write(tmp_path / "a.json", deck()))
    pages = D.read_decks(spark, str(tmp_path / "a.json")).withColumn("deck", F.lit(7)).drop("file", "pos", "slide_width_pt", "slide_height_pt")
    for _ in range(2):  # overwriting is whole
        sinks.write_decks(pages, str(tmp_path / "out"), 960.0, 540.0)
    again = spark.read.schema(D.DECK).json(str(tmp_path / "out")).withColumn("file", F.lit("f"))
    assert D.blocks_of(D.deck_pages(again)).count() == 4
    with pytest.raises(ValueError):
        sinks.write_decks(pages.limit(0), str(tmp_path / "none"), 960.0, 540.0)


def test_files(spark, tmp_path):
    for name in ("b.PDF", "a.pdf", ".h.pdf", "n.txt", "sub/c.pdf", ".hid/d.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    names = [r.path.rsplit("/", 1)[1] for r in D.files_of(spark, str(tmp_path)).collect()]
    assert names == ["a.pdf", "b.PDF", "c.pdf"]


def archive(path, entries, link=False):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
        if link:
            info = zipfile.ZipInfo("link")
            info.external_attr = (stat.S_IFLNK | 0o777) << 16
            z.writestr(info, "target")


def test_archives(spark, tmp_path):
    archive(tmp_path / "ok.zip", [("a.xml", "x"), ("b/c.xml", "yy")])
    archive(tmp_path / "out.zip", [("../a", "x")])
    archive(tmp_path / "abs.zip", [("/a", "x")])
    archive(tmp_path / "bomb.zip", [("a", "0" * 1_000_000)])
    archive(tmp_path / "link.zip", [("a", "x")], link=True)
    (tmp_path / "no.zip").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[1]: r for r in D.checked_archives(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert (got["ok.zip"].entries, got["ok.zip"].bytes, got["ok.zip"].problem) == (2, 3, None)
    assert {k: v.problem for k, v in got.items() if k not in ("ok.zip", "no.zip")} == {"out.zip": "path outside", "abs.zip": "path outside", "bomb.zip": "ratio", "link.zip": "link"}
    assert got["no.zip"].problem.startswith("not an archive")
    few = D.checked_archives(spark.read.format("binaryFile").load(str(tmp_path / "ok.zip")), {"entries": 1}).first()
    assert few.problem == "too many entries"


@pytest.mark.parametrize(
    "payload, boxes",
    [
        ('{"boxes":[{"coordinate":[1,2,3,4],"score":0.5,"label":"a"}]}', [([1.0, 2.0, 3.0, 4.0], 0.5, "a")]),
        ('{"result":{"data":{"boxes":[{"bbox":[1,2,3,4],"confidence":0.25}]}}}', [([1.0, 2.0, 3.0, 4.0], 0.25, None)]),
        ('[{"bbox":[1,2,3,4]}]', [([1.0, 2.0, 3.0, 4.0], 0.0, None)]),
        ('{"boxes":[]}', []),
        ('{"else":1}', None),
        ("broken", None),
        (None, None),
    ],
)
def test_layout_payloads(spark, payload, boxes):
    got = spark.createDataFrame([(payload,)], "p string").select(D.layout_boxes(F.col("p")).alias("b")).first().b
    assert (got and [tuple(x) for x in got]) == boxes or got == boxes


def test_words(spark):
    raw = ['[1,2,3,4,"w",0]', '[1,2,3,4]', '[1,2,3,4," "]', '["a",2,3,4,"w"]', '[3,2,1,4,"w"]', "x", None]
    got = spark.createDataFrame([(r,) for r in raw], "r string").select(D.word_fields(F.col("r")).alias("w")).collect()
    assert [r.w is not None for r in got] == [True] + [False] * 6


def test_flat_words_are_split_as_they_are_parsed(spark):
    """Words with blanks, escapes, quotes, nested and odd values have the fields that the parser gives, flat ones without it."""
    flat = ['[1,2.5,3,4.25,"w",0,0]', '[-1,-2.50,3,4,"w [1] x y"]', '["1","2","3","4","5"]', '["1e0",2,"3d",4,"中文"]', '["a",1,2,3,"t"]', '[1,2,3,4,"  "]', '[3,2,1,4,"t"]', '["","","","",""]']
    other = ['[1,2,3,4]', "x", "", None, "{}", '[1,2,3,4,5.50]', '[1,2,3,4,"a,b"]', '[1,2,3,4,"a\\"b"]', '[1,2,3,4,"a\\u0041"]', '[1,2,3,4,"a\nb"]', "[1,2,3,4,'q']", '[01,2,3,4,"w"]', '[1e0,2,3,4,"w"]', ' [1, 2, 3, 4, "w"] ',
             '[1,2,3,4,"w"]\n', '[1,2,3,4,"w"]]', '[1,2,3,4,"w"] x', '[1,2,3,4,"w",[5,6]]', '[1,2,3,4,null]', '[1,2,3,4,"w",true]', '[+1,2,3,4,"w"]', '[1.,2,3,4,"w"]', '[1,2,12345678901234567890,4,"w"]', '[1,2,3,4,""w"]', '[1,2,3,4,"w"', '[1,2,,4,"w"]', '[[1,2,3,4,"w"]]', '[NaN,2,3,4,"w"]']
    rows = spark.createDataFrame(list(enumerate(flat + other)), "id long, r string")
    got = D.word_rows(rows, "r", "id")
    want = rows.select("id", D.word_fields(F.col("r")).alias("w")).where("w IS NOT NULL").select("id", "w.*")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 8
    assert [r.f for r in rows.orderBy("id").select(F.coalesce(F.col("r").rlike(D._FLAT), F.lit(False)).alias("f")).collect()] == [True] * len(flat) + [False] * len(other)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_summaries(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b.pdf", "ok", 3, 1.5, 0.25), (2, "a.pdf", "failed", None, 0.0, None)], "id long, path string, status string, n_pages int, seconds double, cost double")
    for _ in range(2):
        sinks.write_summaries(rows, str(tmp_path))
    assert [r.value for r in spark.read.text(str(tmp_path / "summary.md")).collect()] == ["| a.pdf | failed | 0.000 | - |", "| b.pdf | ok | 1.500 | $0.250000 |"]
    csv = spark.read.option("header", True).csv(str(tmp_path / "summary.csv")).orderBy("id").collect()
    assert (csv[1].n_pages, csv[1].cost) == (None, None) and csv[0].cost == "0.25"
    assert spark.read.json(str(tmp_path / "summary.json")).count() == 2


def test_a_failing_conversion_stops_no_other(spark):
    files = spark.createDataFrame([(i, f"f{i}", i) for i in range(10)], "id long, path string, n_pages int")

    def convert(row):
        return 10 // (row.n_pages - 4)

    got = {r.id: r for r in converted(files, convert).collect()}
    assert got[4].status == "failed" and "ZeroDivisionError" in got[4].error and got[6].pages == 5


def test_circuit_goes_on_over_batches(spark, tmp_path):
    rows = [(1, i, i, f, False) for i, f in enumerate([1, 1, 0, 1, 1, 1, 0, 1])] + [(2, 10, 1, True, True), (2, 11, 2, False, False), (3, 12, 1, False, False)]
    schema = "worker long, id long, ts long, failed boolean, auth boolean"
    for k in (0, 1):  # two files, one a batch
        part = [(w, i, t, bool(f), a) for w, i, t, f, a in rows if (t >= 4) == bool(k) or w > 1 and (t > 1) == bool(k)]
        spark.createDataFrame([r for r in part if (r[2] >= 4 if r[0] == 1 else r[2] > 1) == bool(k)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.id: r.state for r in ledger.stored_stream(ledger.circuit_stream(stream), spark).collect()}
    assert [got[i] for i in range(8)] == ["failed", "failed", "ok", "failed", "failed", "failed", "rejected", "rejected"]
    assert (got[10], got[11], got[12]) == ("failed", "rejected", "ok")


def test_hours_come_after_the_watermark(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 09:00:00", "b", 5.0)]
    spark.createDataFrame(rows, "t string, event_type string, value double").selectExpr("timestamp(t) AS ts", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ledger.hourly(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in")))
    assert [(r.event_type, r.n, r.total) for r in ledger.stored_stream(stream, spark).collect()] == [("a", 2, 3.0)]


def test_entries(spark, tmp_path):
    archive(tmp_path / "ok.zip", [("a.xml", "x"), ("b/c.xml", "yy")])
    archive(tmp_path / "out.zip", [("../a", "x")])
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted((r.name, bytes(r.content)) for r in D.entries_of(files).collect()) == [("a.xml", b"x"), ("b/c.xml", b"yy")]
    assert D.entries_of(files, {"total_bytes": 2}).count() == 0
    kinds = spark.createDataFrame([(p,) for p in ("a.PDF", "b.jpeg", "c.jpg", "d.PNG", "e.txt")], "p string").select(D.upload_kind(F.col("p")).alias("k")).collect()
    assert [r.k for r in kinds] == ["document", "image", "image", "image", None]


def test_line_runs_feed_one_group_each():
    assert P.line_groups(P.np.zeros((1, 4))).tolist() == [0]
