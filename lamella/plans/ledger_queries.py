"""Queries over attempts, budgets, caches and diagnoses."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.functions import geometry as G
from lamella.functions import scalar as X
from lamella.functions.geometry import box
from lamella.operators import spatial as J

from .registry import query


@query("state_accept_gate", "STATE-01", """
WITH g AS (SELECT *, ssim_after > ssim_before + 1e-4 AND edit_after >= edit_before - 1e-6 AND f1_after >= f1_before - 1e-6 AS better, id % 5 AS el, row_number() OVER (PARTITION BY page ORDER BY id) AS n, row_number() OVER (PARTITION BY page, id % 5 ORDER BY id) AS n_el, sum(seconds) OVER (PARTITION BY page ORDER BY id ROWS UNBOUNDED PRECEDING) AS spent FROM attempts)
SELECT page, id, better AND n <= 8 AND n_el <= 2 AND spent <= 90 AS accepted, CASE WHEN n > 8 THEN 'attempt_cap' WHEN n_el > 2 THEN 'element_cap' WHEN spent > 90 THEN 'time_budget' WHEN NOT better THEN 'no_gain' END AS reason FROM g""")
def accept_gate(v):
    """A fix stays if the page looks better and neither editability nor text suffers, within the caps."""
    w = Window.partitionBy("page").orderBy("id")
    better = (F.col("ssim_after") > F.col("ssim_before") + 1e-4) & (F.col("edit_after") >= F.col("edit_before") - 1e-6) & (F.col("f1_after") >= F.col("f1_before") - 1e-6)
    rows = v.attempts.withColumn("better", better).withColumn("el", F.col("id") % 5).withColumn("n", F.row_number().over(w)).withColumn("n_el", F.row_number().over(Window.partitionBy("page", "el").orderBy("id")))
    rows = rows.withColumn("spent", F.sum("seconds").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    reason = F.when(F.col("n") > 8, "attempt_cap").when(F.col("n_el") > 2, "element_cap").when(F.col("spent") > 90, "time_budget").when(~F.col("better"), "no_gain")
    return rows.withColumn("reason", reason).select("page", "id", F.col("reason").isNull().alias("accepted"), "reason")


_OVER = "greatest(0.5::DOUBLE * length(text) * font_size / greatest(1.0, x1 - x0), 1.2::DOUBLE * font_size / greatest(1.0, y1 - y0))"


@query("state_diagnosis", "STATE-03 STATE-04 STATE-05 STATE-06", f"""
WITH b AS (SELECT *, x1 > 900.5 AS past, (id * 3) % 30 AS spill, (id % 30) > 26 AS spilled, trim(text) <> '' AND {_OVER} > 1.02 AS measured, {_OVER} AS over, greatest(1, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))) AS src, id % 4 AS shown, (id * 17 % 1000)::DOUBLE / 1000 AS ssim, (id * 29 % 640)::DOUBLE / 10 AS mae FROM blocks),
u AS (SELECT page, id, 'text_overflow' AS kind, past OR spilled AS evidence, round(CASE WHEN NOT past AND NOT spilled THEN 0.15::DOUBLE ELSE greatest(CASE WHEN past THEN 0.5::DOUBLE ELSE 0.0 END, CASE WHEN spilled THEN least(1.0, spill / 20.0::DOUBLE) ELSE 0.0 END, CASE WHEN measured THEN least(1.0, greatest(over, 1.0) - 1.0) ELSE 0.0 END) END, 4) AS severity FROM b WHERE past OR spilled OR measured
 UNION ALL SELECT page, id, 'extra_wrap', true, round(least(1.0, (shown - src)::DOUBLE / src), 4) FROM b WHERE shown > src
 UNION ALL SELECT page, id, 'low_local_ssim', true, round(greatest(CASE WHEN ssim < 0.5 - 0.02::DOUBLE THEN least(1.0, 0.5 - 0.02::DOUBLE - ssim) ELSE 0.0 END, CASE WHEN mae >= greatest(12.0, 2.5 * 8.0) THEN least(1.0, mae / 64.0) ELSE 0.0 END), 4) FROM b WHERE ssim < 0.5 - 0.02::DOUBLE OR mae >= greatest(12.0, 2.5 * 8.0))
SELECT *, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN evidence THEN 0 ELSE 1 END, -severity, kind, id)::INT AS rank FROM u""")
def diagnosis(v):
    """Issues of all kinds of a page's blocks, in the order in which to treat them."""
    text, font, i = F.col("text"), F.col("font_size"), F.col("id")
    b = box()
    one, none = F.lit(1.0), F.lit(0.0)
    over = F.greatest(0.5 * F.length(text) * font / F.greatest(one, b.w), 1.2 * font / F.greatest(one, b.h))
    lines = F.greatest(F.lit(1), F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")))
    rows = v.blocks.select("page", "id", (b.x1 > 900.5).alias("past"), ((i * 3) % 30).alias("spill"), (i % 30 > 26).alias("spilled"), ((F.trim(text) != "") & (over > 1.02)).alias("measured"), over.alias("over"), lines.alias("src"), (i % 4).alias("shown"), ((i * 17 % 1000) / 1000.0).alias("ssim"), ((i * 29 % 640) / 10.0).alias("mae"))
    past, spilled, measured = map(F.col, ("past", "spilled", "measured"))
    severity = F.greatest(F.when(past, 0.5).otherwise(none), F.when(spilled, F.least(one, F.col("spill") / 20.0)).otherwise(none), F.when(measured, F.least(one, F.greatest(F.col("over"), one) - 1.0)).otherwise(none))
    overflow = rows.where(past | spilled | measured).select("page", "id", F.lit("text_overflow").alias("kind"), (past | spilled).alias("evidence"), F.when(~past & ~spilled, 0.15).otherwise(severity).alias("severity"))
    wrap = rows.where("shown > src").select("page", "id", F.lit("extra_wrap").alias("kind"), F.lit(True).alias("evidence"), F.least(one, (F.col("shown") - F.col("src")) / F.col("src")).alias("severity"))
    found = unlike(F.col("ssim"), F.lit(0.5), F.col("mae"), F.lit(8.0))
    local = rows.withColumn("s", found).where("s IS NOT NULL").select("page", "id", F.lit("low_local_ssim").alias("kind"), F.lit(True).alias("evidence"), F.col("s").alias("severity"))
    every = overflow.unionByName(wrap).unionByName(local).withColumn("severity", F.round("severity", 4))
    return J.ranked(every, ["page"], F.when(F.col("evidence"), 0).otherwise(1), F.desc("severity"), F.col("kind"), F.col("id"))


def unlike(ssim, page_ssim, mae, page_mae):
    """Severity of a region that looks far worse than its page; null if it does not."""
    bad_s, bad_m = ssim < page_ssim - 0.02, mae >= F.greatest(F.lit(12.0), 2.5 * page_mae)
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.when(bad_s | bad_m, F.greatest(F.when(bad_s, F.least(one, page_ssim - 0.02 - ssim)).otherwise(zero), F.when(bad_m, F.least(one, mae / 64.0)).otherwise(zero)))


@query("state_fixes", "STATE-07 STATE-08 STATE-09", """
WITH l AS (SELECT *, greatest(0.5::DOUBLE, (y1 - y0) * 0.05::DOUBLE) AS pad, 0.5::DOUBLE * length(text) * greatest(6.0, font_size) * 1.02::DOUBLE AS need, greatest(1, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))) AS n FROM blocks),
w AS (SELECT *, least(960.0, x1 + (need - (x1 - x0))) AS nx1 FROM l)
SELECT page, id, greatest(greatest(8.0, font_size * 0.95::DOUBLE), round(font_size - 0.5::DOUBLE, 2)) AS shrunk, list_transform([font_size, font_size / 2], lambda s: greatest(greatest(8.0, s * 0.95::DOUBLE), round(s - 0.5::DOUBLE, 2))) AS paragraph_sizes,
 greatest(0.0, x0 - pad) AS line_x0, least(540.0, y1 + pad) AS line_y1, CASE WHEN trim(text) <> '' AND need > x1 - x0 THEN nx1 END AS wide_x1, CASE WHEN trim(text) <> '' AND need > x1 - x0 THEN greatest(0.0, x0 - greatest(0.0, need - (nx1 - x0))) END AS wide_x0,
 CASE WHEN trim(text) <> '' AND need > x1 - x0 THEN least(540.0, greatest(y1, y0 + greatest(greatest(6.0, font_size) * 1.2::DOUBLE, (y1 - y0) / n) * n)) END AS wide_y1 FROM w""")
def fixes(v):
    """What each fix makes of a block: smaller fonts, the box of its lines, a box wide enough."""
    b, font = box(), F.col("font_size")
    small = lambda s: F.greatest(X.font_floor(s, 8.0, 0.95), F.round(s - 0.5, 2))
    lines = G.line_boxes(b, F.lit(2))
    bottom = F.array_max(F.transform(lines, lambda x: x["y1"]))
    pad = F.greatest(F.lit(0.5), b.h * 0.05)
    used = F.greatest(F.lit(6.0), font)
    need = 0.5 * F.length("text") * used * 1.02
    right = F.least(F.lit(960.0), b.x1 + (need - b.w))
    n = F.greatest(F.lit(1), F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")))
    fits = (F.trim("text") != "") & (need > b.w)
    left = F.greatest(F.lit(0.0), b.x0 - F.greatest(F.lit(0.0), need - (right - b.x0)))
    low = F.least(F.lit(540.0), F.greatest(b.y1, b.y0 + F.greatest(used * 1.2, b.h / n) * n))
    return v.blocks.select(
        "page", "id", small(font).alias("shrunk"), F.transform(F.array(font, font / 2), small).alias("paragraph_sizes"), F.greatest(F.lit(0.0), b.x0 - pad).alias("line_x0"), F.least(F.lit(540.0), bottom + pad).alias("line_y1"),
        F.when(fits, right).alias("wide_x1"), F.when(fits, left).alias("wide_x0"), F.when(fits, low).alias("wide_y1"),
    )


@query("state_time_slices", "STATE-11", """
WITH r AS (SELECT page, id, 90.0 - sum(seconds) OVER (PARTITION BY page ORDER BY id ROWS UNBOUNDED PRECEDING) AS remaining, count(*) OVER (PARTITION BY page) - row_number() OVER (PARTITION BY page ORDER BY id) AS pages_left, id % 2 = 0 AS capped FROM attempts), k AS (SELECT *, greatest(0.0, remaining) AS rest FROM r)
SELECT page, id, CASE WHEN pages_left <= 0 OR rest + 1e-9 < 5 THEN 0.0::DOUBLE WHEN capped THEN least(rest, rest / pages_left) WHEN rest / pages_left + 1e-9 < 5 THEN least(rest, 5.0) ELSE rest / pages_left END AS slice FROM k""")
def time_slices(v):
    """A fair share of the time left, of at least five seconds where it may be raised."""
    w = Window.partitionBy("page").orderBy("id")
    rest = F.greatest(F.lit(0.0), 90.0 - F.sum("seconds").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = v.attempts.withColumn("rest", rest).withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("page")) - F.row_number().over(w))
    fair = F.col("rest") / F.greatest(F.col("left"), F.lit(1))
    slice_ = F.when((F.col("left") <= 0) | (F.col("rest") + 1e-9 < 5), 0.0).when(F.col("id") % 2 == 0, F.least("rest", fair)).when(fair + 1e-9 < 5, F.least(F.col("rest"), F.lit(5.0))).otherwise(fair)
    return rows.select("page", "id", slice_.alias("slice"))


@query("state_budget_ledger", "STATE-13", """
WITH RECURSIVE c AS (SELECT worker, id, tokens_in + 4 * tokens_out AS cost, row_number() OVER (PARTITION BY worker ORDER BY ts, id) AS n FROM calls WHERE NOT cached),
r AS (SELECT worker, 0::BIGINT AS n, 0::BIGINT AS id, 0::BIGINT AS calls_made, 0::BIGINT AS spent, false AS ok FROM (SELECT DISTINCT worker FROM c) UNION ALL SELECT r.worker, c.n, c.id, CASE WHEN r.calls_made < 12 AND r.spent + c.cost <= 60000 THEN r.calls_made + 1 ELSE r.calls_made END, CASE WHEN r.calls_made < 12 AND r.spent + c.cost <= 60000 THEN r.spent + c.cost ELSE r.spent END, r.calls_made < 12 AND r.spent + c.cost <= 60000 FROM r JOIN c ON c.worker = r.worker AND c.n = r.n + 1)
SELECT worker, id, ok AS admitted, spent FROM r WHERE n > 0""")
def budget_ledger(v):
    """Admission in order: a call is let in if the caps of calls and cost still hold; one turned away uses nothing."""
    calls = v.calls.where("NOT cached").select("worker", "ts", "id", (F.col("tokens_in") + 4 * F.col("tokens_out")).alias("cost"))
    log = calls.groupBy("worker").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "cost"))).alias("log"))
    return log.select("worker", F.explode(admitted(F.col("log"), 12, 60_000)).alias("r")).select("worker", "r.id", "r.admitted", "r.spent")


def admitted(log, most_calls: int, most_cost: int):
    """(id, admitted, spent) of each entry (id, cost) of an ordered log, by one fold."""
    entry = "struct<id:bigint,admitted:boolean,spent:bigint>"
    zero = F.struct(F.lit(0).cast("long").alias("calls"), F.lit(0).cast("long").alias("spent"), F.array().cast(f"array<{entry}>").alias("out"))

    def step(a, x):
        ok = (a["calls"] < most_calls) & (a["spent"] + x["cost"] <= most_cost)
        spent = F.when(ok, a["spent"] + x["cost"]).otherwise(a["spent"])
        row = F.struct(x["id"].alias("id"), ok.alias("admitted"), spent.alias("spent"))
        return F.struct(F.when(ok, a["calls"] + 1).otherwise(a["calls"]).alias("calls"), spent.alias("spent"), F.concat(a["out"], F.array(row)).alias("out"))

    return F.aggregate(log, zero, step, lambda a: a["out"])


@query("state_circuit", "STATE-14", """
WITH c AS (SELECT worker, id, failed, failed AND tokens_in % 50 = 0 AS auth, row_number() OVER w AS n, failed AND coalesce(lag(failed) OVER w, false) AND coalesce(lag(failed, 2) OVER w, false) AS third FROM calls WHERE NOT cached WINDOW w AS (PARTITION BY worker ORDER BY ts, id)), o AS (SELECT worker, min(n) FILTER (WHERE auth OR third) AS opened FROM c GROUP BY worker)
SELECT worker, id, CASE WHEN opened IS NOT NULL AND n > opened THEN 'rejected' WHEN failed THEN 'failed' ELSE 'ok' END AS state, CASE WHEN n = opened THEN CASE WHEN auth THEN 'auth' ELSE '3 consecutive failures' END END AS opened_by FROM c JOIN o USING (worker)""")
def circuit(v):
    """Three failures in a row, or one of authorisation, shut a worker's later calls out."""
    w = Window.partitionBy("worker").orderBy("ts", "id")
    calls = v.calls.where("NOT cached").withColumn("n", F.row_number().over(w)).withColumn("auth", F.col("failed") & (F.col("tokens_in") % 50 == 0))
    third = F.col("failed") & F.coalesce(F.lag("failed").over(w), F.lit(False)) & F.coalesce(F.lag("failed", 2).over(w), F.lit(False))
    calls = calls.withColumn("third", third).withColumn("opened", F.min(F.when(F.col("auth") | F.col("third"), F.col("n"))).over(Window.partitionBy("worker")))
    state = F.when(F.col("n") > F.col("opened"), "rejected").when(F.col("failed"), "failed").otherwise("ok")
    return calls.select("worker", "id", state.alias("state"), F.when(F.col("n") == F.col("opened"), F.when(F.col("auth"), "auth").otherwise("3 consecutive failures")).alias("opened_by"))


@query("state_cache_lookup", "STATE-16 STATE-17", """
WITH k AS (SELECT id, cached, sha256(concat('plan', chr(0), tokens_in % 500)) AS key FROM calls), c AS (SELECT key, min(id) AS entry FROM k WHERE cached GROUP BY key), m AS (SELECT key, min(id) AS first_miss FROM k WHERE NOT cached AND key NOT IN (SELECT key FROM c) GROUP BY key)
SELECT id, entry, CASE WHEN entry IS NOT NULL THEN 'hit' WHEN first_miss = id THEN 'call' ELSE 'shared' END AS state FROM k LEFT JOIN c USING (key) LEFT JOIN m USING (key) WHERE NOT cached""")
def cache_lookup(v):
    """Requests against stored results by content key; of equal misses one is to be called."""
    k = v.calls.select("id", "cached", X.key_of(F.lit("plan"), (F.col("tokens_in") % 500).cast("string")).alias("key"))
    stored = k.where("cached").groupBy("key").agg(F.min("id").alias("entry"))
    asked = k.where("NOT cached").join(stored, "key", "left")
    first = asked.where("entry IS NULL").groupBy("key").agg(F.min("id").alias("first_miss"))
    state = F.when(F.col("entry").isNotNull(), "hit").when(F.col("first_miss") == F.col("id"), "call").otherwise("shared")
    return asked.join(first, "key", "left").select("id", "entry", state.alias("state"))


_NOTES = {0: "flat ring around", 1: "Low-Frequency check", 2: "RECITATION block", 3: "over budget", 4: "ocr found text", 5: "cache entry bad", 6: "HTTP 500"}


@query("state_fallbacks", "STATE-19", f"""
WITH n AS (SELECT worker, CASE WHEN id % 3 = 0 THEN 'given' END AS kind, CASE id % 7 {" ".join(f"WHEN {k} THEN '{t}'" for k, t in _NOTES.items())} END AS note FROM calls WHERE failed),
k AS (SELECT worker, coalesce(kind, CASE WHEN lower(note) LIKE '%flat%' AND lower(note) LIKE '%ring%' THEN 'flat_ring' WHEN lower(note) LIKE '%low-frequency%' THEN 'low_freq' WHEN lower(note) LIKE '%recitation%' OR lower(note) LIKE '%blocked%' THEN 'safety_block' WHEN lower(note) LIKE '%budget%' THEN 'budget' WHEN lower(note) LIKE '%ocr%' THEN 'ocr_safety' WHEN lower(note) LIKE '%cache%' THEN 'cache_reject' ELSE 'api_error' END) AS kind FROM n)
SELECT worker, kind, count(*) AS n FROM k GROUP BY ALL""")
def fallbacks(v):
    i = F.col("id") % 7
    note = F.lit(None).cast("string")
    for k, t in _NOTES.items():
        note = F.when(i == k, t).otherwise(note)
    kind = F.coalesce(F.when(F.col("id") % 3 == 0, "given"), fallback_kind(note))
    return v.calls.where("failed").groupBy("worker", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def fallback_kind(note):
    """Kind of a fallback from its note: the first of these that fits."""
    t = F.lower(note)
    blocked = t.contains("copyright") | t.contains("recitation") | t.contains("safety") | t.contains("blocked") | t.contains("unable to show the generated image")
    return (
        F.when(t.contains("flat") & t.contains("ring"), "flat_ring").when(t.contains("low-frequency") | t.contains("low_freq"), "low_freq").when(blocked, "safety_block")
        .when(t.contains("budget"), "budget").when(t.contains("ocr"), "ocr_safety").when(t.contains("cache"), "cache_reject").otherwise("api_error")
    )
