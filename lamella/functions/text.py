"""String expressions: tokens, scripts, list marks, spacing, labels, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\x{3400}-\\x{9fff}\\x{f900}-\\x{faff}\\x{3040}-\\x{30ff}"
WORD = f"[\\p{{L}}\\p{{N}}_{CJK}]+"
BULLET = "^\\s*([•◦▪‣·*-]|[0-9]{1,3}[.)]|[A-Za-z][.)]|\\([A-Za-z0-9]{1,3}\\)|[ivxIVX]{1,5}[.)])\\s+"
SPACE = "[\\s\\x{00a0}\\x{3000}]"
LABELS = {"doc_title": "title", "paragraph_title": "title", "plain_text": "text", "paragraph": "text", "image": "figure", "picture": "figure", "list_item": "list", "page_header": "header", "page_footer": "footer"}
KNOWN_LABELS = ["title", "text", "figure", "table", "list", "chart", "header", "footer", "caption"]
BRACKETS = {"(": ")", "[": "]", "{": "}", "<": ">", "（": "）", "【": "】"}


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lower)


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def has_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK}]")


def count_of(text: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{char_class}]", ""))


def script_of(text: Column) -> Column:
    """cjk, latin, numeric (80 % of the characters), mixed or other."""
    bare = without_space(text)
    n = F.length(bare)
    cjk, latin, digits = (count_of(bare, c) for c in (CJK, "A-Za-z", "0-9"))
    out = F.when((cjk == 0) & (latin == 0) & (digits == 0), "other")
    for name, count in (("cjk", cjk), ("latin", latin), ("numeric", digits)):
        out = out.when(count * 10 >= n * 8, name)
    return out.otherwise("mixed")


def font_script(text: Column) -> Column:
    return F.when(has_cjk(text), "cjk").otherwise("latin")


def is_list_line(text: Column) -> Column:
    return text.rlike(BULLET)


def without_mark(text: Column) -> Column:
    """The text behind its list mark; the trimmed text if nothing is behind it."""
    rest = F.trim(F.regexp_replace(text, BULLET, ""))
    return F.when(rest == "", F.trim(text)).otherwise(rest)


def list_style(text: Column) -> Column:
    mark = F.regexp_extract(text, BULLET, 1)
    return F.when(mark == "", None).when(mark.rlike("^[0-9]+[.)]$"), "arabicPeriod").when(mark.rlike("^[A-Z][.)]$"), "alphaUcPeriod").when(mark.rlike("^[a-z][.)]$"), "alphaLcPeriod").otherwise("bullet")


def list_level(left: Column, least: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(8), F.floor((left - least) / 18))).cast("int")


def needs_space(left: Column, right: Column) -> Column:
    """Whether two pieces are joined by a blank: only between two alphanumerics that are not CJK."""
    a, b = F.right(left, F.lit(1)), F.left(right, F.lit(1))
    plain = "^[\\p{L}\\p{N}]$"
    return a.rlike(plain) & b.rlike(plain) & ~has_cjk(a) & ~has_cjk(b)


def join_pieces(pieces: Column) -> Column:
    """Ordered pieces as one text, with blanks where needs_space asks for them."""

    def step(sofar: Column, piece: Column) -> Column:
        return F.when(sofar == "", piece).otherwise(F.concat(sofar, F.when(needs_space(sofar, piece), " ").otherwise(""), piece))

    return F.aggregate(F.filter(pieces, lambda p: F.trim(p) != ""), F.lit(""), step)


def match_form(text: Column) -> Column:
    return F.lower(without_space(text))


def match_score(found: Column, wanted: Column) -> Column:
    """1 if equal, .85 if one holds the other (an empty text is held by any), else 0."""
    a, b = match_form(found), match_form(wanted)
    return F.when(a == b, 1.0).when(b.contains(a) | a.contains(b), 0.85).otherwise(0.0)


def layout_label(raw: Column) -> Column:
    form = F.translate(F.lower(F.trim(raw)), "- ", "__")
    known = F.create_map(*[F.lit(x) for k, v in {**LABELS, **{k: k for k in KNOWN_LABELS}}.items() for x in (k, v)])
    return F.coalesce(F.element_at(known, form), F.lit("other"))


def hex_colour(value: Column) -> Column:
    return F.format_string("#%06X", value.bitwiseAND(0xFFFFFF))


def hex_of_floats(r: Column, g: Column, b: Column) -> Column:
    """Channels of 0 to 1, clamped."""
    part = [F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255).cast("int") for c in (r, g, b)]
    return F.when(r.isNotNull() & g.isNotNull() & b.isNotNull(), F.format_string("#%02X%02X%02X", *part))


def near_white(colour: Column, least: int = 245) -> Column:
    channels = [F.conv(F.substring(colour, i, 2), 16, 10).cast("int") >= least for i in (2, 4, 6)]
    return F.coalesce(F.when(colour.rlike("^#[0-9A-Fa-f]{6}$"), channels[0] & channels[1] & channels[2]), F.lit(False))


def dash_style(dashes: Column) -> Column:
    return F.when(dashes.isNull(), None).when(F.trim(dashes).isin("", "[] 0"), "solid").otherwise("dash")


def office_font(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("helvetica") | low.contains("arial"), "Arial").when(low.contains("times"), "Times New Roman").when(low.contains("courier"), "Courier New").otherwise(name)


def corner_mark(text: Column, box, page_w: float, page_h: float, marks: list[str]) -> Column:
    """A logo text in the lower right corner of the page."""
    form = F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))
    named = F.lit(False)
    for m in marks:
        named = named | form.contains(m)
    return named & (box.x0 >= 0.72 * page_w) & (box.y0 >= 0.9 * page_h) & (box.w <= 0.2 * page_w) & (box.h <= 0.06 * page_h)


def shortened(text: Column, most: int = 240) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def bracketed(text: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in BRACKETS.items() for x in kv])
    t = F.trim(text)
    return F.length(t).between(4, 12) & F.coalesce(F.element_at(pairs, F.left(t, F.lit(1))) == F.right(t, F.lit(1)), F.lit(False))


def tiny_footer(text: Column, w: Column, h: Column) -> Column:
    return (script_of(text) == "latin") & F.length(F.trim(text)).between(6, 16) & (w <= 100) & (h <= 16)


def short_or_numeric(cell: Column) -> Column:
    t = F.trim(cell)
    return ((F.length(t) <= 12) & (F.size(F.split(t, " +")) <= 2)) | t.rlike("^[-+]?[$€]?[0-9][0-9.,]*%?$")


def safe_member(name: Column) -> Column:
    """False for archive member names that leave the target folder."""
    return ~(name.rlike("^[/\\\\]") | name.rlike("^[^/]*:/|^[^/]*:$") | F.array_contains(F.split(name, "/"), "..") | (name == ""))


def contains_any(text: Column, marks: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, marks)), lambda m: F.lower(text).contains(m))


def source_lines(text: Column, stored: Column) -> Column:
    own = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    return F.greatest(F.lit(1), F.coalesce(stored, own))


FONT_MAP = {"sans": {"latin": "Arial", "cjk": "Noto Sans"}, "serif": {"latin": "Times New Roman", "cjk": "Noto Serif"}, "mono": {"latin": "Courier New", "cjk": "Noto Mono"}}
UNKNOWN_FONTS = ["", "unknown", "default", "none"]


def known_font(family: Column) -> Column:
    return family.isNotNull() & ~F.lower(F.trim(family)).isin(UNKNOWN_FONTS)


def font_map_literal(extra: dict | None = None) -> Column:
    """Class to script to family, with `extra` entries laid over the defaults."""
    merged = {k: {**v, **(extra or {}).get(k, {})} for k, v in FONT_MAP.items()}
    return F.create_map(*[x for k, v in merged.items() for x in (F.lit(k), F.create_map(*[F.lit(y) for kv in v.items() for y in kv]))])


def resolved_font(cls: Column, text: Column, existing: Column, extra: dict | None = None) -> Column:
    found = F.element_at(F.element_at(font_map_literal(extra), cls), font_script(text))
    return F.when(known_font(existing), existing).otherwise(F.coalesce(found, existing))
