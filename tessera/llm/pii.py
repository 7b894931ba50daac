r"""Format-preserving Feistel pseudonyms for personal data (operator 3); DataFrame functions only.

Found values are replaced by keyed permutations of themselves within their
format: a card number stays a card number with a right check digit, a date stays
a date of the same century written the same way, an address of the internet four
numbers up to 255 (parts written with leading zeros stay such parts of the same
width), a mail address one with as many letters and digits in the same places.  The
permutations are bijections and depend on the key (HMAC-SHA-256 drives the Feistel
rounds) and the value only, so equal values stay equal across documents and
different ones different; one date or phone number written in two ways has one
pseudonym, written in these two ways.

Numbers and dates are validated first (check digits, ranges, calendar); what
fails is left alone.  Bank accounts have the length of their country.  Digits that
fail as one card number are cut at their separators: the first and longest run of
groups that passes is one, and if none does, dates, ssns and phones are looked for
within.  Kinds, in the order in which they claim a place:

    mail, iban, ip, year-first date (2024-03-05, 2024/3/5), numeric date (05.03.2024,
    3/5/2024, 05-03-2024; day first if that is a date, else month first), written date
    (3 March 2024, 3rd mar. 2024, MARCH 3, 2024), ssn, phone (ten digits in a row too),
    card

Defined cases: a null text stays null (counts 0), an empty one empty; texts of any
length are read whole; rows and other columns are kept as they are, repeated rows
too; an empty table gives an empty result; an empty key is an error.  Each row is
handled where it is read; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rounds of each Feistel network; even.
ROUNDS = 8
#: Steps of a walk along a permutation's cycle until it is back within a format.
WALK = 64
#: Used, with a warning, where the session sets no tessera.pii.key: for tests only, as anyone can invert it.
DEFAULT_KEY = "tessera"
LOG = logging.getLogger(__name__)

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
MONTH = rf"(?i:{MONTHS}|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec)"
ORDINAL = r"(?:(?i:st|nd|rd|th))?"
START, END = r"(?<![\w.+/-])", r"(?![\w/]|[.+-]\w)"
MAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
#: Lengths of bank account numbers by country; of other countries, any that the general form allows.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_form(length: int, lands: str) -> str:
    rest = rf"[ ]?[A-Z0-9]{{{length % 4}}}" if length % 4 else ""
    return rf"(?:{lands.replace(' ', '|')})[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{{length // 4 - 1}}}{rest}"


KNOWN = "|".join(" ".join(IBAN_LENGTHS.values()).split())
IBAN = rf"{START}(?:{'|'.join(iban_form(*f) for f in IBAN_LENGTHS.items())}|(?!{KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?){END}"
IP = rf"{START}[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}{END}"
NUMERIC = rf"(?<![\w./-])(?:[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}}|[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}){END}"
WRITTEN = rf"{START}(?:[0-9]{{1,2}}{ORDINAL} {MONTH}\.?,? [0-9]{{4}}|{MONTH}\.? [0-9]{{1,2}}{ORDINAL},? [0-9]{{4}}){END}"
SSN = rf"{START}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{END}"
PHONE = rf"(?<![\w.+/-])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{{2}}\) ?|[2-9][0-9]{{2}}[ .-])[2-9][0-9]{{2}}[ .-][0-9]{{4}}{END}|{START}[2-9][0-9]{{2}}[2-9][0-9]{{6}}{END}|(?<![\w+])\+[1-9][0-9]{{0,2}}(?:[ .-]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})){{2,6}}{END}"
CARD = rf"{START}[0-9](?:[ -]?[0-9]){{12,18}}{END}"
ISO = rf"{START}(?:[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}|[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}})(?:(?=T[0-9])|{END})"
PATTERNS = {"mail": MAIL, "iban": IBAN, "ip": IP, "iso": ISO, "numeric": NUMERIC, "written": WRITTEN, "ssn": SSN, "phone": PHONE, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What digits that are no card number can hold.
WITHIN = f"(?:{ISO})|(?:{NUMERIC})|(?:{SSN})|(?:{PHONE})"
#: A text without these holds nothing to replace.
HINT = r"[0-9]|@"


def hmac_pads(key: str) -> tuple[bytes, bytes]:
    """The inner and outer block of HMAC-SHA-256."""
    if not key:
        raise ValueError("a key is needed")
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def mixed(key: str, tag: str, value: Column, *more: Column) -> Column:
    """A keyed pseudo-random number from 0 to 2^52 - 1: the first 13 hexadecimal digits of the HMAC of tag|more|...|value."""
    inner, outer = hmac_pads(key)
    text = F.concat_ws("|", F.lit(tag), *(m.cast("string") for m in more), value.cast("string"))
    within = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(text, "UTF-8")), 256))
    return F.conv(F.substring(F.sha2(F.concat(F.lit(outer), within), 256), 1, 13), 16, 10).cast("long")


def feistel(key: str, tag: str, left: Column, right: Column, n_left: Column, n_right: Column) -> Column:
    """A bijection of pairs of numbers below n_left and n_right: struct(l, r)."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), n_left.cast("long").alias("m"), n_right.cast("long").alias("n"))
    step = lambda s, i: F.struct(
        F.when(i % 2 == 0, F.pmod(s["l"] + mixed(key, tag, s["r"], i), s["m"])).otherwise(s["l"]).alias("l"),
        F.when(i % 2 == 1, F.pmod(s["r"] + mixed(key, tag, s["l"], i), s["n"])).otherwise(s["r"]).alias("r"),
        s["m"].alias("m"),
        s["n"].alias("n"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def chars(text: Column) -> Column:
    """The characters of a non-empty text as an array."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def shifted(text: Column, amount: Callable[[Column], Column]) -> Column:
    """Each digit and ASCII letter moved on within its kind by amount(its place); the rest stays."""

    def move(c: Column, j: Column) -> Column:
        code = F.ascii(c)
        turn = lambda first, n: F.char(F.pmod(code - first + amount(j), F.lit(n)) + first)
        return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(chars(text), move), ""))


def permuted(key: str, tag: str, text: Column) -> Column:
    """A bijection of texts that keeps the length, the kind of every character, and marks."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
    step = lambda s, i: F.struct(
        F.when(i % 2 == 0, shifted(s["l"], lambda j: mixed(key, tag, s["r"], i, j))).otherwise(s["l"]).alias("l"),
        F.when(i % 2 == 1, shifted(s["r"], lambda j: mixed(key, tag, s["l"], i, j))).otherwise(s["r"]).alias("r"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """The Luhn sum of a string of digits; double_last: whether the last digit counts twice."""
    back = F.reverse(digits)
    value = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    first = 1 if double_last else 0
    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda s, i: s + F.when(i % 2 == first, twice(value(i))).otherwise(value(i)))


def refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by those of ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(chars(form), start, step, lambda s: s["out"])


def card(key: str, value: Column) -> Column:
    """Another number that passes the same check; one that doesn't pass and holds none between its separators stays."""
    digits = only_digits(value)

    def other(body: Column) -> Column:
        return F.concat(body, F.pmod(-luhn_sum(body, True), F.lit(10)).cast("string"))

    new = F.element_at(F.transform(F.array(permuted(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1))), other), 1)
    return F.when(luhn_sum(digits, False) % 10 == 0, refill(value, new)).otherwise(value)


def card_within(value: Column) -> Column:
    """struct(at, n): place and length of the first, longest groups of digits that pass as a card number; null if none do."""
    groups = F.split(value, "[ -]")

    def windows(s: Column) -> Column:
        before = F.aggregate(F.slice(groups, F.lit(1), s - 1), F.lit(1), lambda n, g: n + F.length(g) + 1)
        ends = F.transform(F.sequence(F.size(groups), s, F.lit(-1)), lambda e: F.array_join(F.slice(groups, s, e - s + 1), " "))
        passing = F.filter(ends, lambda w: F.length(only_digits(w)).between(13, 19) & (luhn_sum(only_digits(w), False) % 10 == 0))
        return F.transform(passing, lambda w: F.struct(before.alias("at"), F.length(w).alias("n")))

    return F.get(F.flatten(F.transform(F.sequence(F.lit(1), F.size(groups)), windows)), F.lit(0))


def digit_groups(key: str, value: Column) -> Column:
    """What stands in for a match of CARD: a card number whole or within, else what else its groups hold."""

    def cut(w: Column) -> Column:
        at, n = w["at"], w["n"]
        return F.concat(F.substring(value, F.lit(1), at - 1), card(key, F.substring(value, at, n)), F.substring(value, at + n, F.length(value)))

    smaller = F.transform(
        F.regexp_extract_all(value, F.lit(WITHIN), F.lit(0)),
        lambda m: F.when(m.rlike(rf"\A(?:{ISO})\z"), year_first_date(key, m)).when(m.rlike(rf"\A(?:{NUMERIC})\z"), numeric_date(key, m)).when(m.rlike(rf"\A(?:{SSN})\z"), ssn(key, m)).otherwise(phone(key, m)),
    )
    parts = F.array_join(F.zip_with(F.split(value, WITHIN, -1), smaller, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    inner = F.element_at(F.transform(F.array(card_within(value)), lambda w: F.when(w.isNull(), parts).otherwise(cut(w))), 1)
    return F.when(luhn_sum(only_digits(value), False) % 10 == 0, card(key, value)).when(value.rlike("[ -]"), inner).otherwise(value)


def mod97(text: Column) -> Column:
    """The remainder of an IBAN's characters, letters as 10 to 35, read as one number."""
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars(text), F.lit(0), lambda s, c: F.when(c.between("0", "9"), (s * 10 + value(c)) % 97).otherwise((s * 100 + value(c)) % 97))


def iban(key: str, value: Column) -> Column:
    plain = F.regexp_replace(value, " ", "")
    land, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))

    def other(b: Column) -> Column:
        check = F.lpad((98 - mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(land, check, b)

    new = F.element_at(F.transform(F.array(permuted(key, "iban", body)), other), 1)
    spaced = F.when(F.contains(value, F.lit(" ")), F.rtrim(F.regexp_replace(new, "(.{4})", "$1 "))).otherwise(new)
    return F.when(mod97(F.concat(body, F.substring(plain, 1, 4))) == 1, spaced).otherwise(value)


def ip(key: str, value: Column) -> Column:
    """Parts without leading zeros are numbers below 256; with them, numbers of one digit less than their width."""
    text = lambda i: F.element_at(F.split(value, r"\."), i)
    number = lambda i: text(i).cast("long")
    led = lambda i: text(i).startswith("0") & (F.length(text(i)) > 1)
    size = lambda i: F.when(led(i), F.when(F.length(text(i)) == 3, 100).otherwise(10)).otherwise(256)
    new = feistel(key, "ip", number(1) * size(2) + number(2), number(3) * size(4) + number(4), size(1) * size(2), size(3) * size(4))

    def written(i: int, n: Column) -> Column:
        return F.when(led(i), F.lpad(n.cast("string"), F.length(text(i)), F.lit("0"))).otherwise(n.cast("string"))

    four = lambda s: (F.floor(s["l"] / size(2)), s["l"] % size(2), F.floor(s["r"] / size(4)), s["r"] % size(4))
    made = F.element_at(F.transform(F.array(new), lambda s: F.concat_ws(".", *(written(i, n) for i, n in enumerate(four(s), 1)))), 1)
    valid = (number(1) < 256) & (number(2) < 256) & (number(3) < 256) & (number(4) < 256)
    return F.when(valid, made).otherwise(value)


def other_day(key: str, day: Column) -> Column:
    """Another day of the same century; a bijection of each century's days."""
    first = F.make_date(F.floor(F.year(day) / 100).cast("int") * 100, F.lit(1), F.lit(1))
    n = F.datediff(F.add_months(first, 1200), first)
    # 36524 = 92 x 397 days, or 36525 = 75 x 487 with a leap year at the century's start
    rows = F.when(n == 36524, 397).otherwise(487)
    at = F.datediff(day, first)
    new = feistel(key, "date", F.floor(at / rows), at % rows, F.floor(n / rows), rows)
    return F.element_at(F.transform(F.array(new), lambda s: F.date_add(first, (s["l"] * rows + s["r"]).cast("int"))), 1)


def dated(key: str, value: Column, day: Column, write: Callable[[Column], Column], fits: Callable[[Column], Column] | None = None) -> Column:
    """``value``, the date ``day``, with another day written in its place; one that ``fits``, as ``day`` does."""
    if fits is None:
        new = other_day(key, day)
    else:  # on along the cycle until a day fits again: still a bijection, of the days that fit
        start = F.struct(day.alias("d"), F.lit(False).alias("done"))
        on = lambda s: F.element_at(F.transform(F.array(other_day(key, s["d"])), lambda d: F.struct(d.alias("d"), fits(d).alias("done"))), 1)
        new = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda s, _: F.when(s["done"], s).otherwise(on(s)), lambda s: s["d"])
    return F.when(day.isNull() | (F.year(day) < 1000), value).otherwise(F.element_at(F.transform(F.array(new), write), 1))


def as_day(year: Column, month: Column, day: Column) -> Column:
    """The date of these numbers as texts or numbers; null if there is none."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws("-", year, two(month), two(day)).try_cast("date")


def part_of(value: Column, i: int) -> Column:
    return F.element_at(F.split(value, "[-/.]"), i)


def like(part: Column, number: Column, padded: Column) -> Column:
    """A day's or month's number, with two digits where the date was ``padded``."""
    return F.when(padded, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))


def year_first_date(key: str, value: Column) -> Column:
    year, month, day = (part_of(value, i) for i in (1, 2, 3))
    padded = (F.length(month) == 2) & (F.length(day) == 2)
    sep = F.substring(value, 5, 1)
    write = lambda d: F.concat(F.year(d).cast("string"), sep, like(month, F.month(d), padded), sep, like(day, F.day(d), padded))
    return dated(key, value, as_day(year, month, day), write)


def numeric_date(key: str, value: Column) -> Column:
    """Day first if that is a date, else month first (and then the pseudonym too is a date only if read so)."""
    one, two, year = (part_of(value, i) for i in (1, 2, 3))
    padded = (F.length(one) == 2) & (F.length(two) == 2)
    sep = F.substring(value, F.length(one) + 1, F.lit(1))

    def write(day_first: bool) -> Callable[[Column], Column]:
        parts = lambda d: (F.day(d), F.month(d)) if day_first else (F.month(d), F.day(d))
        return lambda d: F.concat(like(one, parts(d)[0], padded), sep, like(two, parts(d)[1], padded), sep, F.year(d).cast("string"))

    day_first, month_first = as_day(year, two, one), as_day(year, one, two)
    return F.when(day_first.isNotNull(), dated(key, value, day_first, write(True))).otherwise(dated(key, value, month_first, write(False), lambda d: F.day(d) > 12))


def written_date(key: str, value: Column) -> Column:
    """The month's name stays short or long, its letters as large; so do ordinals and marks."""
    form = rf"^(?:([0-9]{{1,2}})({ORDINAL}) )?({MONTH})(\.?)(,?) (?:([0-9]{{1,2}})({ORDINAL})(,?) )?([0-9]{{4}})$"
    group = lambda i: F.regexp_extract(value, form, i)
    day_first = group(1) != ""
    day, ordinal, name = F.when(day_first, group(1)).otherwise(group(6)), F.when(day_first, group(2)).otherwise(group(7)), group(3)
    short = F.transform(F.array(*map(F.lit, MONTHS.lower().split("|"))), lambda m: F.substring(m, 1, 3))
    month = F.array_position(short, F.substring(F.lower(name), 1, 3))
    padded = day.startswith("0")

    def write(d: Column) -> Column:
        full = F.element_at(F.split(F.lit(MONTHS), r"\|"), F.month(d))
        long = (F.length(name) > 4) | F.lower(name).isin("may", "june", "july")
        plain = F.when(long, full).otherwise(F.substring(full, 1, 3))
        named = F.when(name == F.upper(name), F.upper(plain)).when(name == F.lower(name), F.lower(plain)).otherwise(plain)
        n = F.day(d)
        nth = F.when(n.isin(11, 12, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
        nth = F.when(ordinal == "", "").when(ordinal == F.upper(ordinal), F.upper(nth)).otherwise(nth)
        number = F.concat(like(day, n, padded), nth)
        first = F.concat(number, F.lit(" "), named, group(4), group(5), F.lit(" "), F.year(d).cast("string"))
        last = F.concat(named, group(4), F.lit(" "), number, group(8), F.lit(" "), F.year(d).cast("string"))
        return F.when(day_first, first).otherwise(last)

    return dated(key, value, as_day(group(9), month, day), write)


def ssn(key: str, value: Column) -> Column:
    """Numbers that may be issued: areas 1 to 899 without 666, groups from 1, serials from 1."""
    part = lambda i: F.element_at(F.split(value, "-"), i).cast("long")
    area, group, serial = part(1), part(2), part(3)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)
    new = feistel(key, "ssn", place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    text = F.element_at(F.transform(F.array(new), lambda s: F.concat_ws("-", pad(s["l"] + F.when(s["l"] >= 665, 2).otherwise(1), 3), pad(F.floor(s["r"] / 9999) + 1, 2), pad(s["r"] % 9999 + 1, 4))), 1)
    return F.when(valid, text).otherwise(value)


def phone(key: str, value: Column) -> Column:
    """National numbers keep areas and exchanges from 200 on; others keep their country's first digits."""
    digits = only_digits(value)
    long = F.length(digits) == 11
    ten = F.substring(digits, F.when(long, 2).otherwise(1), F.lit(10))
    new = feistel(key, "phone", F.substring(ten, 1, 3).cast("long") - 200, F.substring(ten, F.lit(4), F.lit(7)).cast("long") - 2_000_000, F.lit(800), F.lit(8_000_000))
    national = F.element_at(F.transform(F.array(new), lambda s: F.concat(F.when(long, "1").otherwise(""), (s["l"] + 200).cast("string"), (s["r"] + 2_000_000).cast("string"))), 1)
    kept = F.regexp_extract(value, r"^\+[1-9][0-9]?", 0)
    foreign = F.concat(kept, permuted(key, "phone", F.substring(value, F.length(kept) + 1, F.length(value))))
    is_national = ((F.length(digits) == 10) | (long & digits.startswith("1"))) & (ten >= "2") & (F.substring(ten, 4, 1) >= "2")
    return F.when(is_national, refill(value, national)).when(F.length(digits).between(8, 15) & value.startswith("+"), foreign).otherwise(value)


def mail(key: str, value: Column) -> Column:
    at = F.instr(value, "@")
    return F.concat(permuted(key, "mail", F.substring(value, F.lit(1), at - 1)), F.substring(value, at, F.length(value)))


def pseudonym(key: str, value: Column) -> Column:
    """What stands in for a match of ANY."""
    alone = lambda kind: value.rlike(rf"\A(?:{PATTERNS[kind]})\z")
    return (
        F.when(F.contains(value, F.lit("@")), mail(key, value))
        .when(alone("iban"), iban(key, value))
        .when(alone("ip"), ip(key, value))
        .when(alone("iso"), year_first_date(key, value))
        .when(alone("numeric"), numeric_date(key, value))
        .when(alone("written"), written_date(key, value))
        .when(alone("ssn"), ssn(key, value))
        .when(alone("phone"), phone(key, value))
        .otherwise(digit_groups(key, value))
    )


def pseudonymised(text: Column, key: str) -> tuple[Column, Column]:
    """The text with pseudonyms, and the array of struct(old, new) of its matches; null texts give nulls."""
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    pairs = F.transform(found, lambda m: F.struct(m.alias("old"), pseudonym(key, m).alias("new")))
    return text, pairs


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``column``, and pii_found: array of struct(old, new)."""
    text = F.col(column)
    _, pairs = pseudonymised(text, key)
    pieces = F.split(text, ANY, -1)
    filled = F.array_join(F.zip_with(pieces, F.col("pii_found"), lambda p, m: F.concat(p, F.coalesce(m["new"], F.lit("")))), "")
    order = [F.when(F.size("pii_found") > 0, filled).otherwise(text).alias(c) if c == column else F.col(c) for c in docs.columns if c != "pii_found"]
    return docs.select("*", pairs.alias("pii_found")).select(*order, "pii_found") if "pii_found" not in docs.columns else pseudonymise(docs.drop("pii_found"), key, column)


def session_key(spark: SparkSession) -> str:
    """The session's tessera.pii.key; without one, a key for tests, and a warning."""
    key = spark.conf.get("tessera.pii.key", None)
    if not key:
        LOG.warning("tessera.pii.key is not set: pseudonyms are made with a known key and can be inverted by anyone")
    return key or DEFAULT_KEY


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, session_key(spark))
    found = F.coalesce(F.size("pii_found"), F.lit(0))
    changed = F.coalesce(F.size(F.filter("pii_found", lambda m: m["old"] != m["new"])), F.lit(0))
    return out.select("doc_id", "text", F.greatest(found, F.lit(0)).cast("long").alias("n_found"), F.greatest(changed, F.lit(0)).cast("long").alias("n_replaced"))


QUERIES = {"op3_pii": op3_pii}
SQL: dict[str, str] = {}
