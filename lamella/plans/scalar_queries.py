"""Queries over numeric, array, JSON and hash expressions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.functions import geometry as G
from lamella.functions import scalar as X
from lamella.functions.geometry import box

from .registry import query


@query("job_expiry", "DT-01 DT-02 SRC-26 STATE-22", """
WITH s AS (SELECT id % 400 AS job, id, CASE WHEN id % 50 <> 0 THEN updated_at END AS updated_at, status FROM files), l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY job ORDER BY id DESC) = 1)
SELECT job, id, strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS iso, updated_at IS NULL OR updated_at < TIMESTAMP '1998-01-01' - INTERVAL 720 HOUR AS expired, status FROM l""")
def job_expiry(v):
    """Latest state of each job, and whether its retention is over."""
    s = v.files.withColumn("job", F.col("id") % 400).withColumn("updated_at", F.when(F.col("id") % 50 != 0, F.col("updated_at")))
    latest = s.groupBy("job").agg(F.max_by(F.struct("id", "updated_at", "status"), "id").alias("s")).select("job", "s.*")
    now = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    t = F.col("updated_at").cast("timestamp_ntz")
    return latest.select("job", "id", X.iso_utc(t).alias("iso"), (t.isNull() | (t < now - F.expr("INTERVAL '720' HOUR"))).alias("expired"), "status")


@query("math_fonts", "MATH-01 MATH-04 MATH-05 MATH-06 MATH-07 MATH-15 MATH-16", """
WITH b AS (SELECT *, y0 + 0.85::DOUBLE * greatest(font_size, 1.0) AS base FROM blocks), p AS (SELECT *, lag(base) OVER w AS pb, lag(font_size) OVER w AS pf FROM b WINDOW w AS (PARTITION BY page ORDER BY id)),
g AS (SELECT id, s, 0.7::DOUBLE * abs(2.5::DOUBLE * s - (x1 - x0)) / (x1 - x0) + 1.15::DOUBLE * abs(s * 1.2::DOUBLE - (y1 - y0)) / (y1 - y0) + 1.5::DOUBLE * (greatest(0.0, 2.5::DOUBLE * s / (x1 - x0) - 1.02::DOUBLE) + greatest(0.0, s * 1.2::DOUBLE / (y1 - y0) - 1.02::DOUBLE)) AS fit FROM blocks, (SELECT unnest(range(6, 41))::INT AS s)),
c AS (SELECT id, arg_min(s, row(round(fit, 9), s)) AS coarse FROM g WHERE s % 2 = 0 GROUP BY id), f AS (SELECT g.id, arg_min(s, row(round(fit, 9), s)) AS best FROM g JOIN c USING (id) WHERE abs(s - coarse) <= 1 GROUP BY g.id)
SELECT page, p.id, round(0.7::DOUBLE * abs(font_size * 4 - (x1 - x0)) / (x1 - x0) + 1.15::DOUBLE * abs(font_size - (y1 - y0)) / (y1 - y0) + 1.5::DOUBLE * (greatest(0.0, font_size * 4 / (x1 - x0) - 1.02::DOUBLE) + greatest(0.0, font_size / (y1 - y0) - 1.02::DOUBLE)), 9) AS fit,
 greatest(9.0, font_size * 0.6::DOUBLE) AS floor_pt, greatest(2, least(9, greatest(3, round((y1 - y0) * 0.25::DOUBLE)::INT))) AS dilate_px,
 CASE WHEN confidence - 0.1::DOUBLE < 0 OR font_size / 8 >= 4 THEN NULL ELSE (confidence - 0.1::DOUBLE) * greatest(1.0, font_size / 8 / 2) END AS threshold,
 CASE WHEN pb IS NULL THEN NULL WHEN base - pb - 1.2::DOUBLE * pf <= 0.25::DOUBLE THEN 0.0::DOUBLE ELSE base - pb - 1.2::DOUBLE * pf END AS space_before,
 greatest(6.0, least(54.0, coalesce(CASE WHEN p.id % 2 = 0 THEN font_size END, (y1 - y0) * 0.78::DOUBLE))) AS fallback, best FROM p JOIN f ON p.id = f.id""")
def math_fonts(v):
    b, font = box(), F.col("font_size")
    w = Window.partitionBy("page").orderBy("id")
    base = G.baseline(b, font)
    rows = v.blocks.withColumn("base", base).withColumn("pb", F.lag("base").over(w)).withColumn("pf", F.lag("font_size").over(w))
    return rows.select(
        "page", "id", F.round(X.font_fit(font * 4, font, b.w, b.h), 9).alias("fit"), X.font_floor(font, 9.0, 0.6).alias("floor_pt"), X.dilation(b.h, 0.25, 3, 9, 2).alias("dilate_px"),
        X.texture_threshold(F.col("confidence") - 0.1, font / 8).alias("threshold"), X.space_before(F.col("base"), F.col("pb"), F.col("pf")).alias("space_before"),
        X.fallback_font(F.when(F.col("id") % 2 == 0, font), b.h, F.lit(False)).alias("fallback"), X.best_font(F.lit(2.5), b.w, b.h).alias("best"),
    )


@query("math_severity", "MATH-02 MATH-03", """
SELECT page, round(40 * (1 - 0.9::DOUBLE) + 0.25::DOUBLE * avg(severity) + 0.15::DOUBLE * ln(1 + count(*)) / ln(21) + 0.25::DOUBLE * least(1.0, sum(CASE WHEN has_box THEN least(1.0, (x1 - x0) * (y1 - y0) / 518400.0) ELSE 0.0 END)), 6) AS severity,
 round(sum(CASE WHEN has_box THEN least(1.0, (x1 - x0) * (y1 - y0) / 518400.0) ELSE 0.0 END), 9) AS area_share FROM issues GROUP BY page""")
def math_severity(v):
    share = F.sum(X.area_share(G.area(box()), 518400.0, F.col("has_box")))
    severity = 40 * (1 - F.lit(0.9)) + 0.25 * F.avg("severity") + 0.15 * F.log1p(F.count(F.lit(1))) / F.log1p(F.lit(20.0)) + 0.25 * F.least(F.lit(1.0), share)
    return v.issues.groupBy("page").agg(F.round(severity, 6).alias("severity"), F.round(share, 9).alias("area_share"))


@query("math_costs", "MATH-08 MATH-09 MATH-10 MATH-11 MATH-12 MATH-13 MATH-14", """
SELECT id, ((id % 256)::INT >> 4) << 4 AS quantized, tokens_in / 1e6 * 0.25::DOUBLE + 8192 / 1e6 * 1.5::DOUBLE AS worst,
 CASE WHEN id % 7 = 0 THEN NULL WHEN tokens_in <= 0 AND tokens_out <= 0 THEN NULL ELSE tokens_in / 1e6 * 0.25::DOUBLE + tokens_out / 1e6 * 1.5::DOUBLE END AS cost,
 CASE WHEN id % 3 = 0 THEN tokens_out * 30.0::DOUBLE / 1e6 ELSE (tokens_out / 2)::BIGINT * 30.0::DOUBLE / 1e6 + greatest(0, tokens_out - (tokens_out / 2)::BIGINT) * 2.5::DOUBLE / 1e6 END AS output_cost,
 (100 * 5.0::DOUBLE + (tokens_in % 50 + greatest(0, tokens_in - 100 - tokens_in % 50)) * 10.0::DOUBLE) / 1e6 AS input_cost, round(-id / 1e9, 4) + 0.0 AS printed FROM calls""".replace("(tokens_out / 2)::BIGINT", "(tokens_out // 2)"))
def math_costs(v):
    a, b, i = F.col("tokens_in"), F.col("tokens_out"), F.col("id")
    named = F.struct(F.when(i % 2 == 0, a).alias("prompt_token_count"), F.when(i % 2 == 1, a).alias("input_tokens"), F.when(i % 2 == 0, b).alias("candidates_token_count"), F.when(i % 2 == 1, b).alias("output_tokens"))
    half = F.expr("tokens_out div 2")
    entry = lambda m, n: F.struct(F.lit(m).alias("modality"), n.alias("n"))
    entries = F.when(i % 3 == 0, F.expr("array_remove(array(named_struct('modality', 'x', 'n', 0L)), named_struct('modality', 'x', 'n', 0L))")).otherwise(F.array(entry("IMAGE", a), entry("Image", half)))
    return v.calls.select(
        "id", X.quantized((i % 256).cast("int")).alias("quantized"), X.call_cost(a, F.lit(8192)).alias("worst"), F.when(i % 7 != 0, X.usage_cost(named)).alias("cost"),
        X.output_cost(X.modality_map(entries), b, 2.5, 30.0).alias("output_cost"), X.input_cost(a, F.lit(100), a % 50, 5.0, 10.0).alias("input_cost"), X.printed(-i / 1e9, 4).alias("printed"),
    )


@query("array_split_lines", "ARR-01 ARR-02", """
WITH l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM blocks), s AS (SELECT *, len(ls) >= 2 AND x1 - x0 >= 60 AND list_max(list_transform(ls, lambda x: length(x))) <= 40 AS wide FROM l)
SELECT page, concat(id, '_split_', i) AS id, ls[i + 1] AS text, x0 + (x1 - x0) * i / len(ls) AS x0, y0 + (y1 - y0) * i / len(ls) AS band_y0 FROM (SELECT *, unnest(range(len(ls)))::INT AS i FROM s WHERE wide)
UNION ALL SELECT page, id::VARCHAR, text, x0, y0 FROM s WHERE NOT coalesce(wide, false)""")
def array_split_lines(v):
    b = box()
    rows = v.blocks.withColumn("ls", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    wide = F.coalesce((F.size("ls") >= 2) & (b.w >= 60) & (F.array_max(F.transform("ls", F.length)) <= 40), F.lit(False))
    rows = rows.withColumn("wide", wide)
    n = F.size("ls")
    cut = rows.where("wide").select("*", F.posexplode("ls").alias("i", "line"))
    parts = cut.select("page", F.concat_ws("_split_", F.col("id").cast("string"), F.col("i").cast("string")).alias("id"), F.col("line").alias("text"), (b.x0 + b.w * F.col("i") / n).alias("x0"), (b.y0 + b.h * F.col("i") / n).alias("band_y0"))
    return parts.unionByName(rows.where("NOT wide").select("page", F.col("id").cast("string").alias("id"), "text", "x0", F.col("y0").alias("band_y0")))


@query("array_true_runs", "ARR-03", """
WITH b AS (SELECT user_id AS page, event_id, value > 50 AS flag, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
g AS (SELECT page, i, i - row_number() OVER (PARTITION BY page ORDER BY i) AS g FROM b WHERE flag) SELECT page, min(i)::INT AS run_start, (max(i) + 1)::INT AS run_end FROM g GROUP BY page, g""")
def array_true_runs(v):
    flags = v.events.groupBy(F.col("user_id").alias("page")).agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") > 50).alias("flag")))).alias("f"))
    runs = flags.select("page", F.explode(X.true_runs(F.transform("f", lambda x: x["flag"]))).alias("r"))
    return runs.select("page", F.col("r.start").alias("run_start"), F.col("r.end").alias("run_end"))


@query("json_validation", "JSON-01 JSON-02 SRC-12", """
SELECT id, list_filter([CASE WHEN id % 3 <> 0 THEN 'version' END, CASE WHEN n_pages = 0 THEN 'no pages' END, CASE WHEN seconds <= 5 THEN 'page size' END], lambda x: x IS NOT NULL) AS problems,
 CASE id % 3 WHEN 0 THEN concat('cannot read: ', 'Doc_', id) WHEN 1 THEN concat('not found: ', 'Doc_', id) ELSE concat('other: /home/u/Doc_', id) END AS message FROM files""")
def json_validation(v):
    i = F.col("id")
    checks = X.problems((i % 3 != 0, "version"), (F.col("n_pages") == 0, "no pages"), (F.col("seconds") <= 5, "page size"))
    raw = F.concat(F.when(i % 3 == 0, "cannot read: ").when(i % 3 == 1, "not found: ").otherwise("other: "), F.lit("/home/u/Doc_"), i.cast("string"))
    return v.files.select("id", checks.alias("problems"), X.scrubbed(raw, ["cannot read: ", "not found: "]).alias("message"))


@query("json_payloads", "JSON-03 JSON-04", """
WITH p AS (SELECT id, CASE id % 4 WHEN 0 THEN concat('{"candidates":[{"parts":[{"text":"a', id, '"},{"text":"b"}]}]}') WHEN 1 THEN concat('{"candidates":[{"parts":[]},{"parts":[{"text":"c', id, '"}]}]}') WHEN 2 THEN concat('{"text":"top', id, '"}') ELSE 'not json' END AS j FROM calls)
SELECT id, CASE id % 4 WHEN 0 THEN concat('a', id, 'b') WHEN 1 THEN concat('c', id) WHEN 2 THEN concat('top', id) END AS text, id % 4 < 3 AS parsed FROM p""")
def json_payloads(v):
    i = F.col("id").cast("string")
    n = F.col("id") % 4
    j = F.when(n == 0, F.concat(F.lit('{"candidates":[{"parts":[{"text":"a'), i, F.lit('"},{"text":"b"}]}]}')))
    j = j.when(n == 1, F.concat(F.lit('{"candidates":[{"parts":[]},{"parts":[{"text":"c'), i, F.lit('"}]}]}'))).when(n == 2, F.concat(F.lit('{"text":"top'), i, F.lit('"}'))).otherwise("not json")
    p = F.from_json(j, "struct<candidates:array<struct<parts:array<struct<text:string>>>>,text:string>")
    full = F.filter(F.transform(p["candidates"], lambda c: F.array_join(F.transform(c["parts"], lambda t: t["text"]), "")), lambda s: s != "")
    return v.calls.select("id", F.coalesce(F.try_element_at(full, F.lit(1)), p["text"]).alias("text"), F.try_parse_json(j).isNotNull().alias("parsed"))


@query("hash_keys", "HASH-01 HASH-02 HASH-03", """
WITH k AS (SELECT page, sha256(string_agg(concat(id, '=', text), '|' ORDER BY concat(id, '=', text))) AS digest FROM blocks WHERE source = 'native' GROUP BY page)
SELECT page, digest, sha256(concat('model-a', chr(0), 'v3', chr(0), digest)) AS plan_key, sha256(concat('prov', chr(0), 'model-b', chr(0), digest, chr(0), 'mask', chr(0), 'prompt')) AS edit_key FROM k""")
def hash_keys(v):
    member = F.concat(F.col("id").cast("string"), F.lit("="), F.col("text"))
    k = v.blocks.where("source = 'native'").groupBy("page").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(member)), "|"), 256).alias("digest"))
    d = F.col("digest")
    return k.select("page", "digest", X.key_of(F.lit("model-a"), F.lit("v3"), d).alias("plan_key"), X.key_of(F.lit("prov"), F.lit("model-b"), d, F.lit("mask"), F.lit("prompt")).alias("edit_key"))
