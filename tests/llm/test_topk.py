import duckdb
import numpy as np
from pyspark.sql import functions as F

from lamella.llm.queries import op6_topk
from lamella.llm.topk import TOP_K_SQL, top_k


def plain(rows, asked, k=5):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors.setdefault(len(v), []).append((i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]))
    out = []
    for own in vectors.values():
        for q, a in own:
            if asked(q):
                best = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in own if c != q)[:k]
                out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return out


def test_query_against_sql(spark, sf_dir):
    got = op6_topk(spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(con.execute(TOP_K_SQL).fetchall())


def make(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("id", F.lit(1)).repartition(3)


def test_ties_odd_vectors_and_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 8).astype(float).tolist()) for i in range(300)]
    rows += [(300, None), (350, [None] * 8), (400, [float("nan")] * 8), (450, [float("inf")] * 8), (500, []), (550, [1.0, 2.0]), (None, [1.0] * 8), (7, rows[7][1]), (600, [0.0] * 8)]
    for block in (16_384, 3):
        got = top_k(make(spark, rows), F.col("vec_id") % 50 == 0, query_block=block)
        assert sorted(map(tuple, got.collect())) == sorted(plain(rows, lambda q: q % 50 == 0))


def test_few_and_no_rows(spark):
    got = top_k(make(spark, [(0, [1.0, 0.5]), (1, [2.0, 1.0])]), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 256 * 512 + 128 * 256)]
    assert top_k(make(spark, []), F.col("vec_id") % 50 == 0).count() == 0
