"""Numeric, array, JSON and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def expired(updated: Column, now: Column, hours: float) -> Column:
    """Rows older than the retention; rows without a time are expired; no retention keeps all."""
    if hours <= 0:
        return F.lit(False)
    return updated.isNull() | (updated < now - F.make_interval(hours=F.lit(int(hours))))


def font_fit(w: Column, h: Column, want_w: Column, want_h: Column) -> Column:
    over = F.greatest(F.lit(0.0), w / want_w - 1.02) + F.greatest(F.lit(0.0), h / want_h - 1.02)
    return 0.7 * F.abs(w - want_w) / want_w + 1.15 * F.abs(h - want_h) / want_h + 1.5 * over


def area_share(area: Column, page_area: float, known: Column) -> Column:
    return F.when(known, F.least(F.lit(1.0), area / page_area)).otherwise(0.0)


def font_floor(size: Column, least_pt: float, ratio: float) -> Column:
    return F.greatest(F.lit(least_pt), size * max(0.0, min(1.0, ratio)))


def dilation(height: Column, ratio: float, least: int, most: int, floor: int) -> Column:
    return F.greatest(F.lit(floor), F.least(F.lit(most), F.greatest(F.lit(least), F.round(height * ratio).cast("int"))))


def texture_threshold(base: Column, score: Column) -> Column:
    return F.when((base < 0) | (score >= 4), None).otherwise(base * F.greatest(F.lit(1.0), score / 2))


def space_before(base: Column, before: Column, font_before: Column) -> Column:
    free = base - before - 1.2 * font_before
    return F.when(before.isNull(), None).when(free <= 0.25, 0.0).otherwise(free)


def quantized(channel: Column, bits: int = 4) -> Column:
    return F.shiftleft(F.shiftright(channel, 8 - bits), 8 - bits)


def call_cost(tokens_in: Column, tokens_out: Column, usd_in: float = 0.25, usd_out: float = 1.5) -> Column:
    return tokens_in / 1e6 * usd_in + tokens_out / 1e6 * usd_out


def usage_cost(usage: Column, usd_in: float = 0.25, usd_out: float = 1.5) -> Column:
    """usage: a struct whose counts go by either of two names; null if both are missing or 0."""
    a = F.coalesce(usage["prompt_token_count"], usage["input_tokens"], F.lit(0))
    b = F.coalesce(usage["candidates_token_count"], usage["output_tokens"], F.lit(0))
    return F.when((a <= 0) & (b <= 0), None).otherwise(call_cost(a, b, usd_in, usd_out))


def modality_map(entries: Column) -> Column:
    """Entries (modality, n) as a map, keys in lower case; the last of equal keys counts."""
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: F.lower(o["modality"]) == F.lower(e["modality"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(F.lower(e["modality"]), e["n"])))


def output_cost(split: Column, total: Column, usd_text: float, usd_image: float) -> Column:
    """Image and text output by their prices; what no entry tells is text, all is image without entries."""
    image, text = F.coalesce(F.try_element_at(split, F.lit("image")), F.lit(0)), F.coalesce(F.try_element_at(split, F.lit("text")), F.lit(0))
    rest = F.greatest(F.lit(0), total - image - text)
    return F.when(F.size(split) == 0, total * usd_image / 1e6).otherwise(image * usd_image / 1e6 + (text + rest) * usd_text / 1e6)


def input_cost(total: Column, text: Column, image: Column, usd_text: float, usd_image: float) -> Column:
    """What is neither text nor image is billed as image."""
    rest = F.greatest(F.lit(0), total - F.coalesce(text, F.lit(0)) - F.coalesce(image, F.lit(0)))
    return (F.coalesce(text, F.lit(0)) * usd_text + (F.coalesce(image, F.lit(0)) + rest) * usd_image) / 1e6


def printed(value: Column, digits: int) -> Column:
    """Rounded, without a negative zero."""
    return F.round(value, digits) + 0.0


def fallback_font(size: Column, height: Column, cjk: Column) -> Column:
    guess = F.coalesce(size, height * F.when(cjk, 0.72).otherwise(0.78))
    return F.greatest(F.lit(6.0), F.least(F.when(cjk, 44.0).otherwise(54.0), guess))


def best_font(width_per_pt: Column, w: Column, h: Column, least: int = 6, most: int = 40) -> Column:
    """The size, coarse then fine, at which text of a width for each point fits a box best."""

    def best(sizes: Column) -> Column:
        fits = F.transform(sizes, lambda s: F.struct(F.round(font_fit(width_per_pt * s, s * 1.2, w, h), 9).alias("fit"), s.alias("size")))
        return F.array_min(fits)["size"]

    coarse = best(F.sequence(F.lit(least), F.lit(most), F.lit(2)))
    return best(F.sequence(F.greatest(F.lit(least), coarse - 1), F.least(F.lit(most), coarse + 1)))


def true_runs(flags: Column) -> Column:
    """[start, end) of the runs of true in a boolean array."""
    n = F.size(flags)
    at = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(flags, i) & ((i == 1) | ~F.element_at(flags, F.greatest(i - 1, F.lit(1)))))
    end = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(flags, i) & ((i == n) | ~F.element_at(flags, F.least(i + 1, n))))
    return F.when(n > 0, F.zip_with(at, end, lambda a, b: F.struct((a - 1).alias("start"), b.alias("end")))).otherwise(F.array())


def problems(*checks: tuple[Column, str]) -> Column:
    """The messages of the checks that hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks]))


def scrubbed(message: Column, marks: list[str]) -> Column:
    """The path behind a known mark is cut to its last part."""
    return F.regexp_replace(message, f"^({'|'.join(marks)}).*/", "$1")


def key_of(*parts: Column) -> Column:
    """SHA-256 of parts with NUL between them."""
    return F.sha2(F.concat_ws("\x00", *parts), 256)
