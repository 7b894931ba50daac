"""Operator 3 against plain Python: the same keyed permutations written out, text by text."""

import datetime
import hmac
import random
import re

import pytest

from tessera.llm import pii

KEY = "a key"
DOC = "doc_id long, text string"


def mixed(tag, value, *more):
    said = "|".join([tag, *map(str, more), str(value)])
    return int(hmac.new(KEY.encode(), said.encode(), "sha256").hexdigest()[:13], 16)


def feistel(tag, left, right, n_left, n_right):
    for i in range(8):
        if i % 2 == 0:
            left = (left + mixed(tag, right, i)) % n_left
        else:
            right = (right + mixed(tag, left, i)) % n_right
    return left, right


def permuted(tag, text):
    def shifted(part, other, i):
        out = ""
        for j, c in enumerate(part):
            for first, n in (("0", 10), ("a", 26), ("A", 26)):
                if ord(first) <= ord(c) < ord(first) + n:
                    c = chr((ord(c) - ord(first) + mixed(tag, other, i, j)) % n + ord(first))
                    break
            out += c
        return out

    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    for i in range(8):
        if i % 2 == 0:
            left = shifted(left, right, i)
        else:
            right = shifted(right, left, i)
    return left + right


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))


def digits_of(value):
    return re.sub("[^0-9]", "", value)


def refill(form, digits):
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in form)


def card(value):
    body = permuted("card", digits_of(value)[:-1])
    return refill(value, body + str(-luhn(body + "0") % 10))


def cards(value):
    """A row of groups of digits: a card whole, or the first and longest run of groups that is one, or other things in it."""
    if luhn(digits_of(value)) % 10 == 0:
        return card(value)
    if not re.search("[ -]", value):
        return value
    at = [0, *(m.end() for m in re.finditer("[ -]", value))]
    ends = [*(m.start() for m in re.finditer("[ -]", value)), len(value)]
    for a in at:
        for b in reversed(ends):
            part = digits_of(value[a:b]) if b > a else ""
            if 13 <= len(part) <= 19 and luhn(part) % 10 == 0:
                return value[:a] + card(value[a:b]) + value[b:]
    within = [pii.ISO, pii.NUMERIC, pii.SSN, pii.PHONE]
    makers = [year_first, numeric, ssn, phone]
    return re.sub("|".join(f"(?:{p})" for p in within), lambda m: next(make(m[0]) for p, make in zip(within, makers, strict=True) if re.fullmatch(p, m[0], re.A)), value, flags=re.A)


def iban(value):
    plain = value.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if number(plain[4:] + plain[:4]) % 97 != 1:
        return value
    body = permuted("iban", plain[4:])
    out = f"{plain[:2]}{98 - number(body + plain[:2] + '00') % 97:02d}{body}"
    return " ".join(out[i : i + 4] for i in range(0, len(out), 4)) if " " in value else out


def ip(value):
    parts = value.split(".")
    if any(int(p) > 255 for p in parts):
        return value
    size = [10 ** (len(p) - 1) if p[0] == "0" and len(p) > 1 else 256 for p in parts]
    a, b, c, d = map(int, parts)
    left, right = feistel("ip", a * size[1] + b, c * size[3] + d, size[0] * size[1], size[2] * size[3])
    new = [*divmod(left, size[1]), *divmod(right, size[3])]
    return ".".join(str(n).zfill(len(p)) if s < 256 else str(n) for n, p, s in zip(new, parts, size, strict=True))


def other_day(day):
    first = datetime.date(day.year // 100 * 100, 1, 1)
    n = 36525 if first.year % 400 == 0 else 36524
    rows = 487 if n == 36525 else 397
    a, b = feistel("date", *divmod((day - first).days, rows), n // rows, rows)
    return first + datetime.timedelta(a * rows + b)


def real(year, month, day):
    try:
        return datetime.date(int(year), int(month), int(day)) if int(year) >= 1000 else None
    except ValueError:
        return None


def spread(numbers, padded):
    return [str(n).zfill(2) if padded else str(n) for n in numbers]


def year_first(value):
    sep = value[4]
    year, month, day = value.split(sep)
    date = real(year, month, day)
    if not date:
        return value
    new = other_day(date)
    return sep.join([str(new.year), *spread((new.month, new.day), len(month) == len(day) == 2)])


def numeric(value):
    sep = re.search("[^0-9]", value)[0]
    one, two, year = value.split(sep)
    if date := real(year, two, one):
        new = other_day(date)
        pair = new.day, new.month
    elif date := real(year, one, two):
        new = other_day(date)
        while new.day <= 12:
            new = other_day(new)
        pair = new.month, new.day
    else:
        return value
    return sep.join([*spread(pair, len(one) == len(two) == 2), str(new.year)])


NAMES = pii.MONTHS.split("|")


def written(value):
    day, year = re.search(r"(?<!\d)\d\d?(?!\d)", value)[0], re.search(r"\d{4}$", value)[0]
    name = re.search(r"(?i)jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec", value)
    whole = re.compile("[A-Za-z]+").match(value, name.start())[0]
    nth = re.search(r"(?i)(?<=\d)(st|nd|rd|th)", value)
    date = real(year, 1 + [n[:3].lower() for n in NAMES].index(name[0].lower()), day)
    if not date:
        return value
    new = other_day(date)
    month = NAMES[new.month - 1] if len(whole) > 4 or whole.lower() in ("may", "june", "july") else NAMES[new.month - 1][:3]
    month = month.upper() if whole.isupper() else month.lower() if whole.islower() else month
    end = "th" if new.day in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
    end = "" if not nth else end.upper() if nth[0].isupper() else end
    number = spread((new.day,), day[0] == "0")[0] + end
    old = day + (nth[0] if nth else "")
    out = value[: -len(year)] + str(new.year)
    return out.replace(old, number, 1).replace(whole, month, 1) if out.index(old) > out.index(whole) else re.sub(whole, month, out.replace(old, number, 1), count=1)


def ssn(value):
    area, group, serial = map(int, value.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return value
    places = [a for a in range(1, 900) if a != 666]
    a, rest = feistel("ssn", places.index(area), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
    return f"{places[a]:03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"


def phone(value):
    digits = digits_of(value)
    ten = digits[1:] if len(digits) == 11 else digits
    if (len(digits) == 10 or len(digits) == 11 and digits[0] == "1") and ten[0] >= "2" and ten[3] >= "2":
        a, b = feistel("phone", int(ten[:3]) - 200, int(ten[3:10]) - 2_000_000, 800, 8_000_000)
        return refill(value, digits[: len(digits) - 10] + str(a + 200) + str(b + 2_000_000))
    if value[0] == "+" and 8 <= len(digits) <= 15:
        kept = re.match(r"\+[1-9][0-9]?", value)[0]
        return kept + permuted("phone", value[len(kept) :])
    return value


def mail(value):
    name, at, rest = value.partition("@")
    return permuted("mail", name) + at + rest


MAKERS = {"mail": mail, "iban": iban, "ip": ip, "iso": year_first, "numeric": numeric, "written": written, "ssn": ssn, "phone": phone, "card": cards}


def brute(text):
    return re.sub(pii.ANY, lambda m: next(MAKERS[kind](m[0]) for kind, p in pii.PATTERNS.items() if re.fullmatch(p, m[0], re.A)), text, flags=re.A)


FORMS = [
    "2125551234", "DOB 1/2/2024", "12-03-2024", "2024/03/05", "3 march 2024", "Mar 3 2024", "010.001.002.003", "10.1.2.3", "10.01.002.3", "30.02.2024", "12/25/2024", "25/12/2024", "1/13/1999", "2024-02-30", "2024-2-9",
    "MARCH 3rd, 2024", "1st sept. 2021", "03 May 2001", "Dec. 31, 1999", "4111 1111 1111 1111 123", "4111111111111111", "4111111111111112", "5500-0000-0000-0004 12", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00",
    "DE88370400440532013000", "123-45-6789", "000-45-6789", "899-99-9999", "+1 (988) 555-2485", "(212) 555-1234", "212.555.1234", "+49 30 1234567", "12125551234", "jo.Do9@mail.example.com", "12 12-03-2024 1234567", "12 2024-02-29 1234",
    "1.2.3.4.5", "a1/2/2024", "2024-03-05T10:00", "12 2125551234 99 123", "29 February 1900", "29 February 2000", "256.1.1.1",
]


def test_pseudonyms_against_brute_force(spark):
    pick = random.Random(7)
    texts = list(FORMS)
    for _ in range(400):
        made = pick.choice(
            [
                lambda: f"{pick.randint(1, 31)}{pick.choice('/.-')}{pick.randint(1, 31)}{pick.choice('/.-')}{pick.randint(1000, 2999)}",
                lambda: f"{pick.randint(1, 31):02d}/{pick.randint(1, 31):02d}/{pick.randint(1900, 2099)}",
                lambda: f"{pick.randint(1500, 2500)}-{pick.randint(1, 13):02d}-{pick.randint(1, 32):02d}",
                lambda: ".".join(str(pick.randint(0, 270)).zfill(pick.choice((1, 1, 2, 3))) for _ in range(4)),
                lambda: f"{pick.randint(1, 32)} {pick.choice(NAMES)[: pick.choice((3, 9))]} {pick.randint(1000, 2999)}",
                lambda: "".join(pick.choices("0123456789", k=pick.randint(9, 20))),
                lambda: " ".join("".join(pick.choices("0123456789", k=pick.choice((2, 4, 4, 4, 6)))) for _ in range(pick.randint(3, 6))),
                lambda: f"{pick.randint(0, 999):03d}-{pick.randint(0, 99):02d}-{pick.randint(0, 9999):04d}",
                lambda: f"{pick.choice(['', '1 ', '+1-'])}{pick.randint(200, 999)}-{pick.randint(100, 999)}-{pick.randint(0, 9999):04d}",
                lambda: pick.choice(FORMS),
            ]
        )
        texts.append(pick.choice(("", "x ", "(", "no. ")).join(["", made()]) + pick.choice((" ", ". ", ", and ")) + made())
    texts.append("pay 4111111111111111 on 1/2/2024, " * 3000)
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), DOC), KEY).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert r["text"] == brute(t), t
    for form in FORMS[:9]:
        assert got[FORMS.index(form)]["text"] != form


def test_formats_are_kept_and_values_linked(spark):
    texts = ["010.001.002.003", "10.1.2.3", "2125551234", "(212) 555-1234", "1/2/2024", "01/02/2024", "2024-02-01", "1 Feb 2024", "1st February 2024", "12/25/2024"]
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), DOC), KEY).orderBy("doc_id").collect()]
    assert re.fullmatch(r"0\d\d\.0\d\d\.0\d\d\.0\d\d", got[0]) and got[0] != got[1]
    assert re.sub(r"\D", "", got[2]) == re.sub(r"\D", "", got[3])
    day = datetime.date.fromisoformat(got[6])
    assert got[4] == f"{day.day}/{day.month}/{day.year}" and got[5] == f"{day.day:02d}/{day.month:02d}/{day.year}"
    assert got[7] == f"{day.day} {NAMES[day.month - 1][:3]} {day.year}" and NAMES[day.month - 1] in got[8]
    month, number, _ = map(int, got[9].split("/"))
    assert month <= 12 < number  # still a date only if read with the month first


def test_a_key_is_needed():
    with pytest.raises(ValueError):
        pii.hmac_pads("")
