"""Surrogates for personal data and secrets, in DataFrame functions only.

1. One regular expression finds all mentions of a text, in one pass; the rows
   are written with what it found.
2. A mention stands for entities of a kind with a canonical form, by which
   mentions corefer: an address in lower case, the digits of a number (of
   numbers of the North American plan with their country code), each word of a
   name. So "Mr. Smith" and "John Smith" share the family name, and get one.
3. Given names of the lists below change places within their list, by the key.
   All other entities draw a core from a keyed hash: digits, letters or a name
   of the same gender and script. Cores drawn twice, or equal to a canonical
   form that occurs, are drawn again by all but one holder. Names grow longer
   with the draws; an entity whose format is used up gets a keyed suffix
   instead. So distinct entities stay distinct.
4. A mention is written anew from the cores in its own format: punctuation,
   spaces, case, title, country code, card network and check digits are kept.

Only documents with a mention are shuffled. What was drawn for a mention is
written before it is joined, so that a very common mention is split, and so are
the texts' mentions, for texts with very many copies.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, stored

#: Draws before an entity gets a suffix.
ROUNDS = 12

TITLES = {
    "m": "Mr|Mister|Herr|Monsieur|M\\.|Señor|Sr|Don|Signor|Sir|господин|г-н",
    "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Doña|Signora|Lady|госпожа|г-жа",
    "n": "Dr|Prof|Doctor|Professor",
}
TITLES["m"] += "|Κύριος|κύριος|Κος"
TITLES["f"] += "|Κυρία|κυρία|Κα"
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Richard Thomas Peter Paul Martin Andreas Stefan Klaus Jean Pierre Louis Antoine Carlos Miguel Javier Pedro".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Anna Laura Julia Petra Sabine Monika Marie Claire Sophie Camille Carmen Isabel Lucía Pilar".split(),
    ("n", "latin"): "Robin Alex Kim Jordan Morgan Taylor Casey Riley Quinn Jamie Dana Lee".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Дмитрий Алексей Николай Михаил Андрей Юрий Олег".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Юлия Вера".split(),
    ("n", "cyrillic"): "Саша Женя Валя Слава Шура".split(),
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος".split(),
    ("f", "greek"): "Ελένη Μαρία Κατερίνα Σοφία Άννα Δήμητρα".split(),
}
FAMILY = {
    "latin": "bar ber bran cas cor dal del dor fal fen gar gil har hol jan kar kel lan lor mar mel mor nel nor pal per ran rol san sel tam tor val ver wal wen".split(),
    "cyrillic": "бар бер вал вол гор дан зар кал кол лан лар мал мар мел ном пар пол рад ром сал сев тар том фед хол чер шал юр".split(),
    "greek": "βαρ γαλ γερ δαλ δορ ζερ θαλ καλ κορ λαρ λεν μαλ μαρ μελ νικ παλ παν ραλ σαλ σαρ ταλ τορ φαλ χαρ".split(),
}
#: How given names that are drawn end.
ENDINGS = {("m", "latin"): "us", ("f", "latin"): "ia", ("n", "latin"): "en", ("m", "cyrillic"): "ий", ("f", "cyrillic"): "ия", ("n", "cyrillic"): "ко", ("m", "greek"): "ος", ("f", "greek"): "ία", ("n", "greek"): "ι"}
NAME_WORD = "\\p{Lu}[\\p{L}'’-]*\\p{L}"
_TITLE = "|".join(TITLES.values())
_GIVEN = "|".join(x for v in GIVEN.values() for x in v)
#: Repeats with a group are bounded, as each takes a stack frame, and so are those that may start anywhere in a run: a search is linear.
KINDS = {
    "email": "[\\p{L}\\p{N}][\\p{L}\\p{N}._%+-]{0,254}+@(?:[\\p{L}\\p{N}-]{1,63}+\\.){1,126}\\p{L}{2,24}",
    "secret": "(?i:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key)\\s{0,2}[=:]\\s{0,2}[\"']?[^\\s\"',;]{6,}",
    "key": "AKIA[0-9A-Z]{16}|[0-9a-f]{32,128}",
    "ip": "(?:(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)\\.){3}(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)(?!\\.\\d)",
    "ssn": "\\d{3}-\\d{2}-\\d{4}",
    "iban": "[A-Z]{2}\\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?",
    "card": "\\d{4}([ -]?)\\d{4}\\1\\d{4}\\1\\d{1,7}|3[47]\\d{2}[ -]?\\d{6}[ -]?\\d{5}",
    "phone": "(?:\\+\\d{1,3}[ .-]?)?(?:\\(\\d{2,4}\\) ?|\\d{3}[ .-])\\d{3}[ .-]\\d{4}|\\+\\d{1,3}(?:[ .-]?\\d{2,4}){3,5}",
    "name": f"(?:(?:{_TITLE})\\.?\\s(?:(?:{_GIVEN})\\s)?|(?:{_GIVEN})\\s){NAME_WORD}(?:\\s{NAME_WORD})?",
}
#: Mentions start and end off word characters. A first look at the next characters turns most positions away.
_ANY = "|".join(f"(?:{p})" for p in KINDS.values()).replace("([ -]?)", "(?<gap>[ -]?)").replace("\\1", "\\k<gap>")
_START = "(?<![\\p{L}\\p{N}_])"
PATTERN = f"{_START}(?=[\\p{{L}}\\p{{N}}+(])(?:{_ANY})(?![\\p{{L}}\\p{{N}}_])"


def _digest(kind: Column, canon: Column, attempt: Column, key: str, purpose: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(purpose), kind, canon, attempt.cast("string")), 256)


def _number(hexes: Column, at: int, digits: int = 7) -> Column:
    return F.conv(F.substring(hexes, at, digits), 16, 10).cast("long")


def _pick(items: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (n % len(items) + 1).cast("int"))


def _digits(hexes: Column) -> Column:
    return F.translate(hexes, "abcdef", "012345")


def _letters(hexes: Column) -> Column:
    return F.translate(hexes, "0123456789abcdef", "bcdfghjkmnprstvw")


def _gender(mention: Column) -> Column:
    out = F.lit("n")
    for g, titles in TITLES.items():
        out = F.when(mention.rlike(f"^(?:{titles})\\.?\\s"), g).otherwise(out) if g != "n" else out
    for (g, _), names in GIVEN.items():
        out = F.when((out == "n") & mention.rlike(f"(?:^|\\s)(?:{'|'.join(names)})(?:\\s|$)"), g).otherwise(out)
    return out


def _bare_name(mention: Column) -> Column:
    return F.regexp_replace(mention, f"^(?:{_TITLE})\\.?\\s", "")


def kind_of(mention: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in KINDS if k != "name"]):
        out = F.when(mention.rlike(f"^(?:{KINDS[kind]})$"), kind).otherwise(out)
    return out


def _ten_digits(mention: Column) -> Column:
    """Whether a phone number has ten digits and no country code: it is taken as one of the North American plan."""
    return (F.length(F.regexp_replace(mention, "\\D", "")) == 10) & ~mention.startswith("+")


def canonical(kind: Column, mention: Column) -> Column:
    """The form by which mentions other than names corefer."""
    digits = F.regexp_replace(mention, "\\D", "")
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "secret", F.regexp_extract(mention, "(?s)[=:]\\s{0,2}[\"']?(.*)$", 1))
        .when(kind == "key", mention)
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "ip", mention)
        .when((kind == "phone") & _ten_digits(mention), F.concat(F.lit("1"), digits))
        .otherwise(digits)
    )


def _script(word: Column) -> Column:
    return F.when(word.rlike("\\p{IsCyrillic}"), "cyrillic").when(word.rlike("\\p{IsGreek}"), "greek").otherwise("latin")


def swapped_given(key: str) -> Column:
    """Map of the listed given names: each to the next of its list, in an order that the key gives."""
    pairs: dict[str, str] = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hmac.digest(key.encode(), n.encode(), "sha256"))
        for one, two in zip(order, [*order[1:], order[0]]):
            pairs.setdefault(one, two)
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def parts_of(kind: Column, mention: Column, given: Column) -> Column:
    """array<struct<pos, kind, canon>>: the entities that a mention stands for and that are drawn. A word of a
    name is canonical in lower case, with its script in front, and a given name with its gender, too."""
    words = F.split(_bare_name(mention), "\\s")
    gender = _gender(mention)

    def of_word(w: Column, i: Column) -> Column:
        last = i == F.size(words) - 1
        canon = F.when(last, F.concat_ws(" ", _script(w), F.lower(w))).otherwise(F.concat_ws(" ", gender, _script(w), F.lower(w)))
        listed = ~last & F.element_at(given, w).isNotNull()
        return F.struct(i.alias("pos"), F.when(listed, None).when(last, "family").otherwise("given").alias("kind"), canon.alias("canon"))

    one = F.array(F.struct(F.lit(0).alias("pos"), kind.alias("kind"), canonical(kind, mention).alias("canon")))
    return F.when(kind == "name", F.filter(F.transform(words, of_word), lambda x: x["kind"].isNotNull())).otherwise(one)


def _luhn(digits: Column) -> Column:
    """Sum of a digit string that is to end in 0 if its last digit is the check digit."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, [0, 2, 4, 6, 8, 1, 3, 5, 7, 9])), c.cast("int") + 1)),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _syllables(items: list[str], hexes: Column, last: Column, attempt: Column) -> Column:
    """Items 0 to `last` of a keyed draw; beyond eight, the digest is read again, shifted."""
    number = lambda i: F.conv(F.substring(hexes, i % 8 * 7 + 1, F.lit(7)), 16, 10).cast("long") + (i / 8).cast("long") * attempt
    return F.transform(F.sequence(F.lit(0), last), lambda i: _pick(items, number(i)))


def _mod97(iban: Column) -> Column:
    """Remainder by 97 of an account number, its first four characters behind the rest; 1 if it is valid."""
    value = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    each = F.split(F.concat(F.substring(iban, 5, 60), F.substring(iban, 1, 4)), "")
    return F.aggregate(F.filter(each, lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def country_of(kind: Column, mention: Column) -> Column:
    """Digits of the country code that a phone number sets apart; empty for all else."""
    return F.when((kind == "phone") & _ten_digits(mention), "1").when(kind == "phone", F.regexp_extract(mention, "^\\+(\\d{1,3})[ .(-]", 1)).otherwise("")


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, country, attempt, ...) with core: a keyed draw of the kind, which replaces the canonical form.

    A country code is kept in front. Step by step, as what several kinds need
    would otherwise be computed, and compiled, for each of its uses.
    """
    kind, canon, country, attempt = (F.col(c) for c in ("kind", "canon", "country", "attempt"))
    h, digits, letters, card, account = (F.col(f"lm_{c}") for c in ("core", "digits", "letters", "card", "account"))
    digests = {f"lm_{p}": _digest(kind, canon, attempt, key, p) for p in ("core", "more", "most")}
    three = lambda f: F.concat(*[f(F.col(c)) for c in digests])
    out = entities.withColumns(digests).withColumns({"lm_digits": three(_digits), "lm_letters": three(_letters)})
    out = out.withColumns(
        {
            "lm_card": F.when(kind == "card", F.concat(F.substring(canon, 1, 2), F.substring(digits, 1, F.length(canon) - 3))),
            "lm_account": F.when(kind == "iban", _filled(F.substring(canon, 5, 60), digits, F.upper(letters))),
        }
    )
    check = (10 - _luhn(F.concat(card, F.lit("0"))) % 10) % 10
    wanted = 98 - _mod97(F.concat(F.substring(canon, 1, 2), F.lit("00"), account))
    out = out.withColumns({"lm_check": check, "lm_wanted": wanted})
    own_card = F.concat(card, F.when(_luhn(canon) % 10 == 0, F.col("lm_check")).otherwise((F.col("lm_check") + 1) % 10).cast("string"))
    iban = F.concat(F.substring(canon, 1, 2), F.lpad(F.when(_mod97(canon) == 1, F.col("lm_wanted")).otherwise(F.col("lm_wanted") % 97 + 1).cast("string"), 2, "0"), account)
    words = F.split(canon, " ")
    script = F.element_at(words, -2)
    stem, ending = F.lit(None).cast("string"), F.lit("")
    count = F.when(kind == "family", 3).otherwise(2) + attempt
    for s, items in FAMILY.items():
        stem = F.when(script == s, F.array_join(_syllables(items, h, count, attempt), "")).otherwise(stem)
    for (g, s), x in ENDINGS.items():
        ending = F.when((kind == "given") & (words[0] == g) & (script == s), x).otherwise(ending)
    ip = F.concat_ws(".", F.lit("10"), *[(_number(h, at) % 254 + 1).cast("string") for at in (1, 10, 20)])
    domain = F.concat(F.substring(_letters(F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.regexp_extract(canon, "@(.*)$", 1)), 256)), 1, 8), F.lit(".example"))
    core = (
        F.when(kind == "email", F.concat(F.substring(letters, 1, 12), F.substring(digits, 1, 12), F.lit("@"), domain))
        .when(kind.isin("family", "given"), F.initcap(F.concat(stem, ending)))
        .when(kind == "card", own_card)
        .when(kind == "iban", iban)
        .when(kind == "ip", ip)
        .when(kind == "phone", F.concat(country, (_number(h, 50) % 8 + 2).cast("string"), F.substring(digits, 2, 20)))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(digits, 2, 8)))
        .otherwise(F.concat(digits, letters))
    )
    return out.withColumn("core", core).select(*entities.columns, "core")


def _filled(shape: Column, digits: Column, letters: Column) -> Column:
    """shape with its digits and letters taken, in order, from the two strings, in its own case."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("d"), F.lit(0).alias("l"))

    def step(a: Column, c: Column) -> Column:
        digit, letter = c.rlike("^[0-9]$"), c.rlike("^\\p{L}$")
        drawn = F.substring(letters, a["l"] % F.length(letters) + 1, F.lit(1))
        cased = F.when(c.rlike("^\\p{Lu}$"), F.upper(drawn)).otherwise(drawn)
        new = F.when(digit, F.substring(digits, a["d"] % F.length(digits) + 1, F.lit(1))).when(letter, cased).otherwise(c)
        return F.struct(F.concat(a["out"], new).alias("out"), F.when(digit, a["d"] + 1).otherwise(a["d"]).alias("d"), F.when(letter, a["l"] + 1).otherwise(a["l"]).alias("l"))

    return F.aggregate(F.split(shape, ""), zero, step, lambda a: a["out"])


def _secret(value: Column, core: Column) -> Column:
    """value with each digit and letter taken from the core by its place: a secret has one format, and may be long."""
    digits, letters = F.regexp_replace(core, "\\D", ""), F.regexp_replace(core, "[^a-z]", "")
    letters = F.when(value.rlike("^[0-9a-f]+$"), F.translate(letters, "bcdfghjkmnprstvw", "abcdefabcdefabcd")).otherwise(letters)
    at = lambda s, i: F.substring(s, i % F.length(s) + 1, F.lit(1))

    def other(c: Column, i: Column, own: Column) -> Column:
        letter = F.when(c.rlike("^\\p{Lu}$"), F.upper(at(own["l"], i))).when(c.rlike("^\\p{L}$"), at(own["l"], i))
        return F.when(c.rlike("^[0-9]$"), at(own["d"], i)).otherwise(F.coalesce(letter, c))

    # The core's digits and letters are a variable of an outer function, as they would else be found again for each character.
    own = F.array(F.struct(digits.alias("d"), letters.alias("l")))
    filled = F.transform(own, lambda o: F.array_join(F.transform(F.split(value, ""), lambda c, i: other(c, i, o)), ""))
    return F.get(filled, F.lit(0))


def _written(kind: Column, mention: Column, core: Column) -> Column:
    """A mention other than a name in its own format, from the core; behind `~`, a suffix of the core."""
    extra = F.when(core.contains("~"), F.substring_index(core, "~", -1)).otherwise("")
    core = F.substring_index(core, "~", 1)
    digits, letters = F.regexp_replace(core, "\\D", ""), F.regexp_replace(core, "[^a-z]", "")
    local, domain = F.regexp_extract(mention, "^([^@]*)@", 1), F.regexp_extract(core, "@(.*)$", 1)
    mail_letters = F.regexp_replace(F.regexp_extract(core, "^([^@]*)@", 1), "[^a-z]", "")
    prefix = F.regexp_extract(mention, "^([^=:]*[=:]\\s{0,2}[\"']?)", 1)
    value = F.substring(mention, F.length(prefix) + 1, F.length(mention))
    hex_letters = F.translate(letters, "bcdfghjkmnprstvw", "abcdefabcdefabcd")
    account = F.regexp_replace(core, "\\d", ""), F.regexp_replace(core, "\\D", "")
    more = F.when(extra != "", F.concat(F.when(kind.isin("email", "secret", "key"), "").otherwise("-"), extra)).otherwise("")
    return F.when(kind == "email", F.concat(_filled(local, digits, mail_letters), more, F.lit("@"), domain)).otherwise(
        F.concat(
            F.when(kind == "secret", F.concat(prefix, _secret(value, core)))
            .when((kind == "key") & mention.startswith("AKIA"), F.concat(F.lit("AKIA"), _filled(F.substring(mention, 5, 16), digits, letters)))
            .when(kind == "key", _filled(mention, digits, hex_letters))
            .when(kind == "iban", _filled(mention, account[1], account[0]))
            .when(kind == "ip", core)
            .when((kind == "phone") & _ten_digits(mention), _filled(mention, F.substring(digits, 2, 40), letters))
            .otherwise(_filled(mention, digits, letters)),
            more,
        )
    )


def rewritten(kind: Column, mention: Column, cores: Column, core: Column, given: Column) -> Column:
    """The mention in its own format. cores: array<struct<pos, core>>, one for each of parts_of(); core: the first of them."""
    title = F.regexp_extract(mention, f"^((?:{_TITLE})\\.?\\s)", 1)
    bare = _bare_name(mention)

    def word(w: Column, i: Column) -> Column:
        own = F.filter(cores, lambda c: c["pos"] == i)
        new = F.when(F.size(own) > 0, F.get(own, F.lit(0))["core"]).otherwise(F.element_at(given, w))
        return F.when((F.length(w) > 1) & (F.upper(w) == w), F.upper(new)).otherwise(new)

    gaps = F.concat(F.regexp_extract_all(bare, F.lit("\\s"), F.lit(0)), F.array(F.lit("")))
    name = F.concat(title, F.array_join(F.zip_with(F.transform(F.split(bare, "\\s"), word), gaps, lambda w, g: F.concat(w, g)), ""))
    return F.when(kind == "name", name).otherwise(_written(kind, mention, core))


def _spelled(kind: Column, canon: Column, core: Column) -> Column:
    """What must differ between entities of a kind: the canonical form, in lower case, of what is written for them."""
    name = F.concat(F.when(kind == "family", F.substring_index(canon, " ", 1)).otherwise(F.substring_index(canon, " ", 2)), F.lit(" "), core)
    return F.lower(F.when(kind.isin("family", "given"), name).when(kind == "secret", _secret(canon, core)).otherwise(_written(kind, canon, core)))


def cores(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """(kind, canon, country), one for each (kind, canon) -> (kind, canon, core): no two entities of a kind look alike,
    and none looks like one that occurs. Each round draws again for what collided; what still collides after
    `rounds` gets a suffix of 64 keyed bits."""
    taken = None
    left = entities.withColumn("attempt", F.lit(0))
    for n in range(rounds):
        shown = cut(drawn(left, key).withColumn("shown", _spelled(F.col("kind"), F.col("canon"), F.col("core"))))
        first = shown.groupBy("kind", "shown").agg(F.min("canon").alias("canon"))
        first = first.join(entities.select("kind", F.lower("canon").alias("shown")).distinct(), ["kind", "shown"], "left_anti")
        if taken is not None:
            first = first.join(taken.select("kind", "shown"), ["kind", "shown"], "left_anti")
        won = shown.join(first, ["kind", "canon", "shown"]).select("kind", "canon", "core", "shown")
        taken = cut(won if taken is None else taken.unionByName(won))
        left = cut(entities.join(taken, ["kind", "canon"], "left_anti").withColumn("attempt", F.lit(n + 1)))
        if left.isEmpty():
            return taken.drop("shown")
    suffix = F.substring(_digest(F.col("kind"), F.col("canon"), F.lit(0), key, "suffix"), 1, 16)
    name = F.col("kind").isin("family", "given")
    rest = drawn(left, key).withColumn("core", F.when(name, F.concat("core", _letters(suffix))).otherwise(F.concat("core", F.lit("~"), suffix)))
    return (rest if taken is None else taken.unionByName(rest, allowMissingColumns=True)).select("kind", "canon", "core")


def surrogates(docs: DataFrame, key: str, count_col: str | None = None) -> DataFrame:
    """docs, in their own columns, with each mention in text replaced by its surrogate.

    key: a secret; who has it can tell which surrogate a value gets, and runs
    with one key give one value one surrogate (but for what was drawn again).
    count_col, if given, is added (or replaced): the number of mentions. An
    n_chars column is counted anew for changed texts. Null, empty and
    mention-free texts stay as they are; repeated rows are changed alike; no
    rows give no rows. Documents are matched to their mentions by their text's
    hash, so ids may be null or repeated. A long text's mentions are found and
    put back in order, in time that grows with their number.
    """
    if not key:
        raise ValueError("surrogates need a key")
    key = hashlib.sha256(key.encode()).hexdigest()
    names = [c for c in docs.columns if c != count_col]
    key_, new_, seen_ = (fresh(c, names) for c in ("lm_text", "lm_new", "lm_seen"))
    text, given = F.col("text"), swapped_given(key)
    seen = F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))
    marked = docs.select(*names, seen.alias(seen_))
    marked = stored(marked.withColumn(key_, F.when(F.size(seen_) > 0, F.sha2(text, 256))))
    found = marked.where(F.col(key_).isNotNull())
    places = found.select(F.col(key_).alias("lm_text"), F.posexplode(seen_).alias("at", "mention")).distinct()
    forms = cut(places.select("mention").distinct().withColumn("kind", kind_of(F.col("mention"))))
    parts = cut(forms.select("mention", F.explode(parts_of(F.col("kind"), F.col("mention"), given)).alias("part"), country_of(F.col("kind"), F.col("mention")).alias("country")).select("mention", "part.*", "country"))
    draws = stored(cores(cut(parts.groupBy("kind", "canon").agg(F.max("country").alias("country"))), key))
    own = parts.join(draws, ["kind", "canon"]).groupBy("mention").agg(F.collect_list(F.struct("pos", "core")).alias("cores"))
    own = forms.join(own, "mention", "left").withColumn("cores", F.coalesce("cores", F.array().cast("array<struct<pos:int,core:string>>"))).withColumn("core", F.get("cores", F.lit(0))["core"])
    news = own.select("mention", rewritten(F.col("kind"), F.col("mention"), F.col("cores"), F.col("core"), given).alias("new"))
    put = places.join(stored(news), "mention").groupBy("lm_text").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("put"))
    put = cut(put.select(F.col("lm_text").alias(key_), F.transform("put", lambda x: x["new"]).alias(new_)))

    joined = F.array_join(F.zip_with(F.split(text, PATTERN, -1), F.col(new_), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    changed = found.join(put, key_).withColumn("text", joined)
    if "n_chars" in names:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    same = marked.where(F.col(key_).isNull())
    count = [F.size(seen_).alias(count_col)] if count_col else []
    return changed.select(*names, *count).union(same.select(*names, *count))


def session_key(spark) -> str:
    """The key in spark.lamella.surrogates.secret (a name that Spark's logs redact); where it is unset, one is drawn and
    set for the session. Query plans hold a hash of the key that is as good as the key: event logs are to be kept as it is."""
    name = "spark.lamella.surrogates.secret"
    if not spark.conf.get(name, ""):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name)
