"""Operator 6: format-preserving Feistel pseudonyms for personal data, with DataFrame functions only.

Mentions are found by one pattern, validated by their kind (Luhn, mod 97, octets, calendar, number ranges), and permuted
by a keyed Feistel network within their own format: every letter and digit stays one of its class, separators stay, and
check digits are set again so that the result is valid too. Equal values get equal pseudonyms in all documents, and
different values of a kind and format get different ones, so links survive. Dates move within the 400-year cycle of the
calendar, whose 146,097 days are 189 x 773 (those that read as month/day only, among such days), and social security
numbers within their valid ranges. Two things are unlike only by a digest's or an address's width: names in mail
addresses with letters of other scripts than ``RUNS`` has, and addresses written with leading zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let

ROUNDS = 8
#: Fixed code points: the first and the last of runs of letters or digits; a pseudonym's letter is of the same run.
RUNS = (
    (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF), (0x100, 0x17F), (0x391, 0x3A1), (0x3A3, 0x3A9),
    (0x3B1, 0x3C9), (0x410, 0x42F), (0x430, 0x44F), (0x531, 0x556), (0x561, 0x586), (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x905, 0x939),
    (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
)
#: Steps of a walk that stays inside a set; the chance to need more is below 1e-20 for the sets here.
WALK = 64

#: Kinds in the order in which a mention is tried; the first that fits it whole and is valid names it. Fixed formats.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-.]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "secret": r"(?:(?i:token|secret|passwd|password|api_key|apikey|api-key|access_key|auth))[\x22']?\s{0,3}[=:]\s{0,3}[\x22']?[A-Za-z0-9_\-/+]{8,}|(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[\-. ][0-9]{4}(?![0-9])|(?<![0-9\-])[0-9]{3}[\-. ][0-9]{3}[\-. ][0-9]{4}(?![0-9\-])|(?<![0-9+.,\-/])0[1-9][0-9]{1,3}[ \-/][0-9]{6,8}(?![0-9]|[\-./,][0-9])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
#: A secret's name and sign, and its value.
_NAMED = r"^([^=:]*[=:]\s{0,3}[\x22']?)(.*)$"
_DAYS, _DAY_SIDES = 146_097, (189, 773)
#: Valid areas (001-665, 667-899), groups (01-99) and serials (0001-9999) of a social security number.
_AREAS, _REST = 898, 99 * 9999


def _draw(key: str, *what: Column) -> Column:
    """A keyed pseudo-random long of 52 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *(w.cast("string") for w in what)), 256), 1, 13), 16, 10).cast("long")


def feistel(value: Column, left: int, right: int, key: str, tweak: str, undo: bool = False) -> Column:
    """A keyed permutation of 0 .. left*right-1: rounds add a function of one side to the other, modulo its size."""

    def step(s: Column, i: Column) -> Column:
        a, b = s["a"], s["b"]
        sign = -1 if undo else 1
        even = F.struct(F.pmod(a + sign * (_draw(key, F.lit(tweak), i, b) % left), F.lit(left)).alias("a"), b.alias("b"))
        odd = F.struct(a.alias("a"), F.pmod(b + sign * (_draw(key, F.lit(tweak), i, a) % right), F.lit(right)).alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(F.floor(value / right).cast("long").alias("a"), (value.cast("long") % right).alias("b"))
    order = range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)
    return F.aggregate(F.array(*map(F.lit, order)), start, step, lambda s: s["a"] * right + s["b"])


def _run(c: Column) -> Column:
    """(n, base) of the run of a code point: how many it has and the first; n is 0 where it is not permuted."""
    of = lambda n, base: F.struct(F.lit(n).alias("n"), F.lit(base).alias("base"))
    out = F.when(c.between(*RUNS[0]), of(10, 48))
    for a, b in RUNS[1:]:
        out = out.when(c.between(a, b), of(b - a + 1, a))
    return out.otherwise(of(0, 0))


def _letter(code: Column) -> Column:
    """The character of a code point below 65,536."""
    return F.when(code < 256, F.char(code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE"))


def permuted(text: Column, key: str, tweak: str, hexadecimal: bool = False) -> Column:
    """A keyed permutation of the strings of one format: the Feistel sides are the first and the second half of the
    characters, and a round moves each character of a side within its class by a function of the other side."""
    chars = F.transform(F.split(text, ""), lambda c: F.struct(F.ascii(c).alias("c"), c.alias("s")))
    chars = F.filter(chars, lambda x: x["s"] != "")
    if hexadecimal:
        value = lambda x: F.conv(x, 16, 10).cast("int")
        items = F.transform(chars, lambda x: F.struct(value(x["s"]).alias("v"), F.lit(16).alias("n"), x["s"].alias("s"), F.lit(0).alias("base")))
        out = lambda e: F.lower(F.conv(e["v"].cast("string"), 10, 16))
    else:
        items = F.transform(chars, lambda x: let(_run(x["c"]), lambda r: F.struct(F.when(r["n"] > 0, x["c"] - r["base"]).otherwise(0).alias("v"), r["n"].alias("n"), x["s"].alias("s"), r["base"].alias("base"))))
        out = lambda e: F.when(e["n"] > 0, _letter(e["base"] + e["v"])).otherwise(e["s"])

    def run(all_: Column) -> Column:
        half = F.floor(F.size(all_) / 2).cast("int")

        def moved(side: Column, other: Column, i: Column) -> Column:
            print_of = F.array_join(F.transform(other, out), "")
            return let(
                print_of,
                lambda p: F.transform(side, lambda e, at: F.struct(F.when(e["n"] > 0, ((e["v"] + _draw(key, F.lit(tweak), i, at, p) % e["n"]) % e["n"]).cast("int")).otherwise(e["v"]).alias("v"), e["n"].alias("n"), e["s"].alias("s"), e["base"].alias("base"))),
            )

        def step(s: Column, i: Column) -> Column:
            even = F.struct(moved(s["a"], s["b"], i).alias("a"), s["b"].alias("b"))
            odd = F.struct(s["a"].alias("a"), moved(s["b"], s["a"], i).alias("b"))
            return F.when(i % 2 == 0, even).otherwise(odd)

        start = F.struct(F.slice(all_, 1, half).alias("a"), F.slice(all_, half + 1, F.size(all_)).alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.array_join(F.transform(F.concat(s["a"], s["b"]), out), ""))

    return let(items, run)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one counting once."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97).cast("int"))


def _fill(mask: Column, letters: Column) -> Column:
    """``mask`` with its letters and digits replaced in order by ``letters``; separators stay."""
    places = F.filter(F.split(mask, ""), lambda c: c != "")
    done = F.aggregate(
        places,
        F.struct(F.lit(0).alias("i"), F.lit("").alias("t")),
        lambda s, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct((s["i"] + 1).alias("i"), F.concat(s["t"], F.substr(letters, s["i"] + 1, F.lit(1))).alias("t"))).otherwise(F.struct(s["i"].alias("i"), F.concat(s["t"], c).alias("t"))),
        lambda s: s["t"],
    )
    return done


def _date(text: Column, fmt: str) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit(fmt)))


def _moved_date(day: Column, fmt: str, key: str, late: bool = False) -> Column:
    """Another day of the same 400 years; ``late``: among the days from the 13th on, by walking until one is met."""
    first = F.lit("1600-01-01").cast("date")
    number = F.datediff(day, first)
    begin = F.floor(number / _DAYS) * _DAYS
    at = lambda n: F.date_add(first, (begin + n).cast("int"))
    step = lambda n: feistel(n, *_DAY_SIDES, key, "late" if late else "date")
    start = F.pmod(number, F.lit(_DAYS)).cast("long")
    if not late:
        return F.date_format(at(step(start)), fmt)
    walk = lambda n, i: F.when((i > 0) & (F.dayofmonth(at(n)) > 12), n).otherwise(step(n))
    return F.date_format(at(F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), start, walk)), fmt)


def _ip(text: Column, key: str) -> Column:
    """Addresses written with leading zeros are permuted by themselves and keep their width at least."""
    parts = F.split(text, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("long"))
    octets = lambda n: [F.shiftrightunsigned(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    plain = let(feistel(number, 65536, 65536, key, "ip"), lambda n: F.concat_ws(".", *octets(n)))
    wide = lambda i, o: F.when(F.length(o) < F.length(parts[i]), F.lpad(o, F.length(parts[i]), F.lit("0"))).otherwise(o)
    padded = let(feistel(number, 65536, 65536, key, "ip0"), lambda n: F.concat_ws(".", *(wide(i, o) for i, o in enumerate(octets(n)))))
    return F.when(text.rlike(r"(?:^|\.)0[0-9]"), padded).otherwise(plain)


def _ssn(text: Column, key: str) -> Column:
    area, group, serial = (F.substring(text, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    index = (area - 1 - F.when(area > 666, 1).otherwise(0)) * _REST + (group - 1) * 9999 + serial - 1
    return let(
        feistel(index, _AREAS, _REST, key, "ssn"),
        lambda n: let(F.floor(n / _REST), lambda a: F.concat_ws("-", F.lpad((a + 1 + F.when(a >= 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((F.floor(n % _REST / 9999) + 1).cast("string"), 2, "0"), F.lpad((n % _REST % 9999 + 1).cast("string"), 4, "0"))),
    )


def _card(text: Column, key: str) -> Column:
    def with_check(digits: Column) -> Column:
        body = permuted(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
        return let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

    return _fill(text, let(_digits(text), with_check))


def _iban(text: Column, key: str) -> Column:
    def with_check(plain: Column) -> Column:
        body = permuted(F.substr(plain, F.lit(5), F.length(plain)), key, "iban")
        country = F.substring(plain, 1, 2)
        return let(body, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))

    return _fill(text, let(F.regexp_replace(text, " ", ""), with_check))


def _email(text: Column, key: str) -> Column:
    head = F.regexp_extract(text, r"^(.*)(\.[A-Za-z]{2,})$", 1)
    local = F.regexp_extract(head, r"^(.*)@", 1)
    moved = permuted(head, key, "email")
    # a name with a letter that is in no run is replaced by a keyed digest as a whole
    known = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in RUNS)
    moved = F.when(local.rlike(rf"^[{known}._%+\-]*$"), moved).otherwise(F.concat(F.substring(F.sha2(F.concat(F.lit(key), local), 256), 1, 16), F.substr(moved, F.length(local) + 1)))
    return F.concat(moved, F.regexp_extract(text, r"(\.[A-Za-z]{2,})$", 1))


def _phone(text: Column, key: str) -> Column:
    country = F.regexp_extract(text, r"^(\+[0-9]{1,3})(?=[ .\-(])", 1)
    return F.concat(country, permuted(F.substr(text, F.length(country) + 1), key, "phone"))


def _handled(m: Column, key: str) -> Column:
    """(kind, text) of a mention: its pseudonym, or kind null and the text as it is where it is not valid."""
    fits = lambda kind: m.rlike(f"^(?:{kind})$")
    iso, other = m.rlike("^[0-9]{4}-"), F.regexp_replace(m, r"\.", "/")
    day = F.when(iso, _date(m, "yyyy-MM-dd")).otherwise(F.coalesce(_date(other, "dd/MM/yyyy"), _date(other, "MM/dd/yyyy")))
    day = F.when(day >= F.lit("0400-01-01").cast("date"), day)
    octets = F.forall(F.split(m, r"\."), lambda p: p.cast("int") <= 255)
    area, length = F.substring(m, 1, 3), F.length(_digits(m))
    out = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    ssn_ok = fits(r"[0-9]{3}-[0-9]{2}-[0-9]{4}") & ~area.isin("000", "666") & (area < "900") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")
    slashed = let(day, lambda d: F.when(_date(other, "dd/MM/yyyy").isNotNull(), _moved_date(d, "dd/MM/yyyy", key)).otherwise(_moved_date(d, "MM/dd/yyyy", key, True)))
    dated = F.when(iso, _moved_date(day, "yyyy-MM-dd", key)).otherwise(F.when(m.contains("."), F.regexp_replace(slashed, "/", ".")).otherwise(slashed))
    return (
        F.when(m.contains("@"), out("email", _email(m, key)))
        .when(fits("[0-9a-f]{32,128}"), out("secret", permuted(m, key, "hex", True)))
        .when(fits("[0-9A-F]{32,128}"), out("secret", F.upper(permuted(F.lower(m), key, "hex", True))))
        .when(fits(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), F.when(octets, out("ip", _ip(m, key))).otherwise(out(None, m)))
        .when(fits(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}"), F.when(day.isNotNull(), out("date", dated)).otherwise(out(None, m)))
        .when(ssn_ok, out("ssn", _ssn(m, key)))
        .when(fits(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), out(None, m))
        .when(fits(r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]+") & (_mod97(F.regexp_replace(F.concat(F.substr(m, F.lit(5)), F.substring(m, 1, 4)), " ", "")) == 1), out("iban", _iban(m, key)))
        .when(fits(r"[0-9 \-]+") & length.between(13, 19) & (luhn_sum(_digits(m)) % 10 == 0), out("card", _card(m, key)))
        .when(fits(PATTERNS["phone"]) & length.between(7, 15), out("phone", _phone(m, key)))
        .when(fits(r"[0-9 \-]+|[A-Z]{2}[0-9]{2}[A-Z0-9 ]+"), out(None, m))
        .otherwise(out("secret", F.concat(F.regexp_extract(m, _NAMED, 1), let(F.regexp_extract(m, _NAMED, 2), lambda v: F.when(v.rlike("^[0-9a-f]{32,128}$"), permuted(v, key, "hex", True)).otherwise(permuted(v, key, "secret"))))))
    )


def pseudonyms(text: Column, key: str) -> Column:
    """(text, kinds): the whole text with all valid mentions replaced, and the kinds of those in order."""

    def replaced(mentions: Column) -> Column:
        between = F.split(text, ANY, -1)
        done = F.transform(mentions, lambda m: _handled(m, key))
        return let(
            done,
            lambda d: F.struct(
                F.array_join(F.flatten(F.zip_with(between, F.transform(d, lambda x: x["text"]), lambda b, t: F.array(b, F.coalesce(t, F.lit(""))))), "").alias("text"),
                F.filter(F.transform(d, lambda x: x["kind"]), lambda k: k.isNotNull()).alias("kinds"),
            ),
        )

    found = let(F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)), replaced)
    return F.when(text.rlike("[0-9@]|(?i:token|secret|passw|key|auth)"), found).otherwise(F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds")))


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its text replaced by the one that carries pseudonyms; other columns stay.

    Null and empty texts stay as they are; repeated rows get the same text; an empty table gives no rows; the other columns
    stay whatever their names. Nothing is shuffled: a row's result needs the row and the key alone, and whole texts are
    handled, however long. The key has no default: who has it can undo the pseudonyms.
    """
    return docs.withColumn("text", pseudonyms(F.col("text"), key)["text"])


def report(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_mentions, kinds): the new text, how many mentions were replaced, and their distinct kinds,
    for every row of ``docs`` (doc_id, text). Edge cases are those of ``pseudonymised``; a null text has no mentions."""
    done = free_name(docs, "done")
    rows = docs.select("doc_id", "text").withColumn(done, F.explode(F.array(pseudonyms(F.col("text"), key))))
    kinds = F.coalesce(F.col(done)["kinds"], F.array().cast("array<string>"))
    return rows.select("doc_id", F.col(done)["text"].alias("text"), F.size(kinds).cast("long").alias("n_mentions"), F.array_join(F.array_sort(F.array_distinct(kinds)), ",").alias("kinds"))
