import random

import pytest

WORDS = "river stone garden window market silver morning winter letter travel basket copper forest ribbon harbor candle meadow thunder velvet pepper orchard lantern marble saddle timber walnut anchor bridge castle desert".split()
#: Names that the operators use for columns of their own.
CLASHING = ("fp", "rep", "component_id", "lm_text", "lm_row", "n_words", "hits", "items", "score", "lang_pred", "predicted", "mention", "kind", "canon", "mix_slot", "mix_share", "removed", "spans", "kept", "rank", "sha", "doc", "node", "key")


@pytest.fixture()
def prose():
    """prose(n, seed): n words of running text."""

    def make(n, seed=0):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + (str(r.randrange(900)) if r.random() < 0.3 else "") for _ in range(n))

    return make


@pytest.fixture()
def frame(spark):
    """Rows (doc_id, text, lang, source) as a table of documents, with columns of clashing names on demand."""

    def make(rows, clash=False):
        rows = [(*r, *("en", "web")[len(r) - 2 :]) for r in rows]
        rows = [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        if clash:
            for name in CLASHING:
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


@pytest.fixture()
def odd_rows(prose):
    """Nulls, empty, blank and very long texts, a repeated row, ties, a null id."""
    long_text = prose(200_000, 5)
    return [(1, None), (2, ""), (3, "  \n\t "), (4, long_text), (5, long_text), (6, "a b"), (6, "a b"), (7, "a b"), (None, "a b"), (None, None), (8, prose(60, 1)), (9, prose(60, 2)), (10, "éß" * 40)]
