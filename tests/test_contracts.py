"""The semantic contracts of the inventory, on rows made for them."""

import pytest
from pyspark.sql import functions as F

from lamella.functions import aggregates as A
from lamella.functions import geometry as G
from lamella.functions import rules as R
from lamella.functions import text as T
from lamella.functions.geometry import box
from lamella.operators import sequence as Q
from lamella.operators import spatial as J
from lamella.plans.ledger_queries import admitted, fallback_kind, unlike
from lamella.plans.sequence_queries import proposed_actions, zebra_stacks


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def boxes(spark, data, extra=""):
    data = [(*r[:2], *map(float, r[2:6]), *r[6:]) for r in data]
    return rows(spark, data, f"page long, id long, x0 double, y0 double, x1 double, y1 double{extra}")


def test_page_kind_takes_the_first_rule(spark):
    cases = [(40, 0.01, 0.75, 0, "digital"), (40, 0.01, 0.76, 0, "hybrid"), (13, 0.5, 0.9, 5, "hybrid"), (39, 0.5, 0.0, 0, "hybrid"), (12, 0.0, 0.45, 9, "scanned"), (12, 0.0, 0.0, 0, "scanned"), (0, 0.0, 0.0, 1, "hybrid")]
    df = rows(spark, cases, "c long, t double, i double, d long, want string")
    got = df.select("want", R.page_kind(*map(F.col, "ctid")).alias("kind")).collect()
    assert all(r.want == r.kind for r in got)


def test_overlap_measures_differ_in_what_they_divide_by(spark):
    df = rows(spark, [(0.0, 0.0, 10.0, 10.0, 5.0, 0.0, 25.0, 10.0)], "ax0 double, ay0 double, ax1 double, ay1 double, bx0 double, by0 double, bx1 double, by1 double")
    a, b = (G.Box(*[F.col(f"{n}{c}") for c in G.Box._fields]) for n in "ab")
    r = df.select(G.intersection_area(a, b).alias("i"), G.share_of_first(a, b).alias("s"), G.share_of_first(b, a).alias("t"), G.iou(a, b).alias("u"), G.overlap_coefficient(a, b).alias("c")).first()
    assert (r.i, r.s, r.t, r.c) == (50.0, 0.5, 0.25, 0.5) and r.u == pytest.approx(50 / 250)


def test_best_partner_takes_the_first_of_equals(spark):
    left = boxes(spark, [(1, 1, 0, 0, 10, 10), (2, 1, 0, 0, 10, 10)])
    right = boxes(spark, [(1, 8, 0, 0, 10, 10), (1, 5, 0, 0, 10, 10), (1, 9, 0, 0, 5, 10)])
    got = J.best(left, right, G.share_of_first, lambda a, b: G.intersection_area(a, b) > 0, F.col("b.id"), [F.col("b.id").alias("region")]).collect()
    assert [(r.page, r.id, r.region, r.score) for r in got] == [(1, 1, 5, 1.0)]


def test_joins_keep_to_their_page(spark):
    left, right = boxes(spark, [(1, 1, 0, 0, 10, 10), (2, 2, 0, 0, 10, 10)]), boxes(spark, [(1, 7, 0, 0, 10, 10)])
    over = lambda a, b: G.share_of_first(a, b) >= 0.5
    assert [r.id for r in J.semi(left, right, over).collect()] == [1] and [r.id for r in J.anti(left, right, over).collect()] == [2]
    assert {(r.id, r.hit) for r in J.flagged(left, right, over, "hit").collect()} == {(1, True), (2, False)}


def test_nearest_takes_the_last_of_equals_and_as_of_defaults_to_zero(spark):
    values = rows(spark, [(1, 1, 5.0), (1, 2, 22.0), (1, 3, 23.1), (1, 4, -9.0)], "page long, id long, x double")
    centres = rows(spark, [(1, 0, 0.0), (1, 1, 10.0)], "page long, i long, c double")
    near = {r.id: r.cluster for r in J.nearest(values, centres, "x", "c", "i", 12.0).collect()}
    assert near == {1: 1, 2: 1, 3: None, 4: 0}
    column = {r.id: r.column for r in J.as_of(values, centres, "x", "c", "i", 6.0).collect()}
    assert column == {1: 1, 2: 1, 3: 1, 4: 0}


def test_clusters_link_to_the_last_value_inclusively(spark):
    df = rows(spark, [(1, i, x) for i, x in enumerate([0.0, 4.0, 8.0, 12.1, 12.1])], "page long, id long, x double")
    got = [(r.cluster, r.centre, r.n) for r in Q.clusters_1d(df, ["page"], "x", "id", 4.0).orderBy("cluster").collect()]
    assert got == [(1, 4.0, 3), (2, 12.1, 2)]


def test_two_medians_and_first_mode(spark):
    df = rows(spark, [(1, 1, 1.0, "b"), (1, 2, 2.0, "a"), (1, 3, 3.0, "a"), (1, 4, 4.0, "b"), (1, 5, None, None)], "page long, id long, x double, v string")
    r = df.groupBy("page").agg(A.upper_median(F.col("x")).alias("u"), F.median("x").alias("m"), A.upper_median(F.when(F.col("x") > 9, F.col("x"))).alias("none")).first()
    assert (r.u, r.m, r.none) == (3.0, 2.5, None)
    assert A.first_mode(df, ["page"], "v", "id").first().v == "b"


def test_trimming_cuts_to_whole_numbers(spark):
    df = rows(spark, [(1, i, float(i)) for i in range(19)], "page long, id long, x double")
    assert A.trimmed(df, ["page"], "x", "id").agg(F.min("x"), F.max("x")).first()[:] == (1.0, 17.0)
    assert A.trimmed(df.where("id < 9"), ["page"], "x", "id").count() == 9


def test_bag_scores_of_empty_bags(spark):
    df = rows(spark, [(0, 0, 0), (0, 3, 0), (0, 0, 2), (2, 4, 2), (0, 1, 1)], "o long, r long, c long")
    got = [tuple(x) for x in df.select(*A.multiset_scores(F.col("o"), F.col("r"), F.col("c")).values()).collect()]
    assert got[0] == (1.0, 1.0, 1.0) and got[1][2] == got[2][2] == got[4][2] == 0.0
    assert got[3][:2] == (1.0, 0.5) and got[3][2] == pytest.approx(2 / 3)


def test_zebra_stacks_need_alternation(spark):
    def stack(page, fills, gap=0.0):
        return [(page, i, 10.0, 100 + (20 + gap) * i, 210.0, 120 + (20 + gap) * i, c) for i, c in enumerate(fills)]

    data = stack(1, "abab") + stack(2, "aabb") + stack(3, "aaaa") + stack(4, "ab") + stack(5, "aba", 7.0) + stack(6, "abb")
    got = {r.page: (r.n, r.alternations) for r in zebra_stacks(boxes(spark, data, ", fill string")).collect()}
    assert got == {1: (4, 3), 6: (3, 1)}


def test_text_rules(spark):
    lines = [("• item", True, "item"), ("1. one", True, "one"), ("b) two", True, "two"), ("(iv) x", True, "x"), ("-", False, "-"), ("2024 was", False, "2024 was")]
    got = rows(spark, lines, "t string, want boolean, bare string").select("want", "bare", T.is_list_line(F.col("t")).alias("is"), T.without_mark(F.col("t")).alias("rest")).collect()
    assert all(r.want == r["is"] and r.bare == r.rest for r in got)
    scripts = [("hello", "latin"), ("中文字", "cjk"), ("123", "numeric"), ("abc中文字", "mixed"), ("--", "other")]
    got = rows(spark, scripts, "t string, want string").select("want", T.script_of(F.col("t")).alias("s")).collect()
    assert all(r.want == r.s for r in got)
    joined = rows(spark, [(["foo", "bar"],), (["foo", "中"],), (["foo,", "bar"],), ([" ", "x"],)], "p array<string>").select(T.join_pieces(F.col("p")).alias("j")).collect()
    assert [r.j for r in joined] == ["foo bar", "foo中", "foo,bar", "x"]


def test_admission_uses_nothing_when_it_turns_away(spark):
    log = rows(spark, [([(1, 50), (2, 60), (3, 50), (4, 1)],)], "log array<struct<id:bigint,cost:bigint>>")
    got = log.select(admitted(F.col("log"), 2, 100).alias("r")).first().r
    assert [(x.id, x.admitted, x.spent) for x in got] == [(1, True, 50), (2, False, 50), (3, True, 100), (4, False, 100)]


def test_fallback_kinds_take_the_first_that_fits(spark):
    notes = [("Flat RING, budget", "flat_ring"), ("low_freq", "low_freq"), ("safety budget", "safety_block"), ("budget ocr", "budget"), ("ocr cache", "ocr_safety"), ("cache", "cache_reject"), ("?", "api_error")]
    got = rows(spark, notes, "n string, want string").select("want", fallback_kind(F.col("n")).alias("k")).collect()
    assert all(r.want == r.k for r in got)


def test_local_quality_and_actions(spark):
    df = rows(spark, [(0.4, 0.5, 0.0, 0.0), (0.48, 0.5, 11.9, 0.0), (0.9, 0.5, 32.0, 5.0), (0.9, 0.5, 13.0, 6.0)], "s double, p double, m double, q double")
    got = [r.v for r in df.select(unlike(*map(F.col, "spmq")).alias("v")).collect()]
    assert got[0] == pytest.approx(0.08) and got[1] is None and got[2] == 0.5 and got[3] is None
    acts = rows(spark, [("line_drift", "text"), ("low_local_ssim", "shape")], "k string, e string").select(proposed_actions(F.col("k"), F.col("e")).alias("a")).collect()
    assert acts[0].a[0] == "match_line_bboxes" and acts[1].a == ["raster_fallback"]


def test_plans_prune_and_push_down(spark, sf_dir):
    from lamella.sources.views import Views

    plan = Views(spark, sf_dir).regions.select("page", "x0")._jdf.queryExecution().toString()
    assert "EqualTo(event_type,click)" in plan and "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan


def test_page_joins_are_equi_joins(spark, sf_dir):
    from lamella import catalog

    for name, make in catalog.queries().items():
        if name.startswith("join_"):
            plan = make(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_boxes_in_columns(spark):
    df = boxes(spark, [(1, 1, 1, 2, 3, 4)])
    assert df.select(box().struct().alias("b")).first().b == (1.0, 2.0, 3.0, 4.0)
