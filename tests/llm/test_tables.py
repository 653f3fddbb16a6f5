"""All queries on empty tables, and on tables with nulls in every column, repeated rows and further columns."""

import pytest

import corpus_pipeline
from lamella.llm import queries

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
}
ODD = {
    "documents": [(None,) * 5, (1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three four five six", None, None, None), (3, "one two three four five six", None, None, None), (4, "one two three four five six", "en", "a", 27), (50, "ä b c d e f g h i j k l", "de", "b", 23)],
    "embeddings": [(None,) * 3, (0, None, None), (50, [1.0, None], 1), (100, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (7, [0.5, -1.0], None), (8, [0.5, -1.0], None)],
    "pages": [(None,) * 3, (1, None, "<p>a"), (1, None, "<p>a"), (2, "u", "")],
    "benchmark": [(None, None), (1, None), (2, ""), (3, "two three"), (3, "two three"), (None, "five six")],
    "labels": [(None,) * 3, (3, None, None), (4, 1, 1), (4, 1, 0), (50, 0, 0), (99, 1, 1)],
}
RUN = {**queries.queries(), "pipeline": corpus_pipeline.run}


def tables(spark, folder, rows, more):
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows.get(name, []), schema)
        for c in more:
            df = df.selectExpr("*", f"'x' AS `{c}`") if c not in df.columns else df
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), {}, [])


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("odd"), ODD, ["score", "id", "hits", "n", "h", "lm_text", "key", "rank", "v", "toxic", "label"])


@pytest.mark.parametrize("name", RUN)
def test_empty(spark, empty, name):
    assert RUN[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", RUN)
def test_odd(spark, odd, name):
    n = RUN[name](spark, odd).count()
    if name == "op6_topk":
        assert n == 4  # two rows of vector 100, two candidates each
    elif name == "pipeline":
        assert n == 1  # of 3, 3 and 4 one stays, and most of its words are the benchmark's
    else:
        assert n == len(ODD["pages" if name == "op2_html_text" else "documents"])
