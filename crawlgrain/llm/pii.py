"""Format-preserving pseudonyms of personal data, by native columns alone.

A text is cut at every candidate by one pattern. Numbers and dates that hold good
(check digits, ranges, calendar) are permuted within their format by a keyed Feistel
network: both halves are numbers, and in turn one gets a keyed hash of the other added,
modulo its range. So the result is of the same format and valid, two values never
become one, and equal values become equal pseudonyms in every document. What only
looks like personal data stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgrain.functions.urls import bound

ROUNDS = 8

# The formats, in the order in which they are tried at a place.
_EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
#: Lengths of the IBAN registry, so that a word after an IBAN isn't taken for its end.
_IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV",
    29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_IBAN_BY_LENGTH = "|".join(rf"(?:{c})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in _IBAN_COUNTRIES.items())
_IBAN = rf"(?:{_IBAN_BY_LENGTH}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])"
_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-])"
_IP = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)"
_SSN = r"\d{3}-\d{2}-\d{4}(?![\d-])"
_CARD = r"(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
_LOCAL_PHONE = r"\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
#: A number that is whole as it stands, of 8 to 15 digits, doesn't go on with a group that begins another value.
_ONE = r"[ .()-]{0,3}\d"
_WHOLE = rf"(?<=\+{_ONE * 8}{f'(?:{_ONE}' * 7}{')?' * 7})"
_NEXT = rf"(?!{_WHOLE} (?:{_EMAIL}|{_DATE}|{_IP}|{_SSN}|(?:{_LOCAL_PHONE})(?!\d)|{_CARD}(?! \d{{4}})))"
_PHONE = rf"(?:\+1[ .-]?(?:\(\d{{3}}\)|\d{{3}})[ .-]?\d{{3}}[ .-]?\d{{4}}|\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:{_NEXT}[ .-]?\d{{2,4}}){{1,4}}{_WHOLE}|{_LOCAL_PHONE})(?!\d)"
#: What a match begins with is looked at first, so that words cost little.
PATTERN = rf"(?<![A-Za-z0-9._%+@-])(?:{_EMAIL}|(?=[A-Z]{{2}}\d\d)(?:{_IBAN})|(?=[\d+(])(?:{_DATE}|{_IP}|{_SSN}|{_PHONE}|{_CARD}))"
_MARK = "\x01"

#: Days of 400 Gregorian years from 1700 on, as a product.
_FIRST_DAY, _DAYS = "1700-01-01", (189, 773)
#: Social security numbers: areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999.
_AREAS, _GROUPS, _SERIALS = 898, 99, 9999


def _keyed(key: Column, tweak: Column, turn: Column, value: Column) -> Column:
    """A keyed hash as a number below 2**60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, tweak, turn.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, n_left: Column, n_right: Column, key: Column, tweak: Column) -> Column:
    """struct(l, r): the keyed permutation of pairs below (n_left, n_right)."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        even = (i % 2) == 0
        return F.struct(
            F.when(even, F.pmod(acc["l"] + F.pmod(_keyed(key, tweak, i, acc["r"]), n_left), n_left)).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + F.pmod(_keyed(key, tweak, i, acc["l"]), n_right), n_right)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(digits: Column, key: Column, tweak: str) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""

    def halves(d: Column) -> Column:
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        b = n - a
        sizes = F.struct(_power(a).alias("a"), _power(b).alias("b"))
        out = bound(sizes, lambda p: feistel(F.substring(d, F.lit(1), a), F.substring(d, a + 1, b), p["a"], p["b"], key, F.concat(F.lit(tweak), n.cast("string"))))
        return bound(out, lambda o: F.concat(F.lpad(o["l"].cast("string"), a, "0"), F.lpad(o["r"].cast("string"), b, "0")))

    return bound(digits, halves)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _fill(m: Column, digits: Column) -> Column:
    """m with its digits, from left to right, replaced by those of a string."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, c: Column, d: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct((acc["at"] + F.when(digit, 1).otherwise(0)).alias("at"), F.concat(acc["out"], F.when(digit, F.substring(d, acc["at"], F.lit(1))).otherwise(c)).alias("out"))

    return bound(digits, lambda d: F.aggregate(F.filter(F.split(m, ""), lambda c: c != ""), start, lambda acc, c: step(acc, c, d))["out"])


def luhn_sum(digits: Column, shift: int) -> Column:
    """The Luhn sum of a digit string; shift 0: its last digit is the check digit, 1: it lacks one."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = F.transform(chars, lambda c, i: F.when((i + shift) % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _card(m: Column, key: Column) -> Column:
    def changed(d: Column) -> Column:
        body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        whole = bound(body, lambda b: _fill(m, F.concat(b, F.pmod(-luhn_sum(b, 1), F.lit(10)).cast("string"))))
        return F.when(F.length(d).between(13, 19) & (luhn_sum(d, 0) % 10 == 0) & (F.regexp_replace(d, "0", "") != ""), whole)

    return bound(_digits(m), changed)


def _phone(m: Column, key: Column) -> Column:
    def changed(x: Column) -> Column:
        d, code = x["d"], x["code"]
        return F.when(F.length(d).between(8, 15), _fill(m, F.concat(F.substring(d, F.lit(1), code), permute_digits(F.substring(d, code + 1, F.length(d) - code), key, "phone"))))

    return bound(F.struct(_digits(m).alias("d"), F.length(F.regexp_extract(m, r"^\+(\d{1,3})(?=[ .(-])", 1)).alias("code")), changed)


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    fine = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = (area - F.when(area > 666, 2).otherwise(1)) * _GROUPS + group - 1
    out = feistel(place, serial - 1, F.lit(_AREAS * _GROUPS), F.lit(_SERIALS), key, F.lit("ssn"))

    def written(o: Column) -> Column:
        a = F.floor(o["l"] / _GROUPS).cast("int") + 1
        return F.concat(F.lpad((a + F.when(a >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lit("-"), F.lpad((o["l"] % _GROUPS + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((o["r"] + 1).cast("string"), 4, "0"))

    return F.when(fine, bound(out, written))


def _ip(m: Column, key: Column) -> Column:
    out = bound(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), lambda o: feistel(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), F.lit(65536), F.lit(65536), key, F.lit("ip")))
    halves = lambda o: F.flatten(F.transform(F.array(o["l"], o["r"]), lambda x: F.array(F.floor(x / 256).cast("string"), (x % 256).cast("string"))))
    return F.array_join(bound(out, halves), ".")


def _date(m: Column, key: Column) -> Column:
    iso, dots = m.contains("-"), m.contains(".")
    first = F.lit(_FIRST_DAY).cast("date")

    def read(p: Column) -> Column:
        """The date, and whether its day stands first: 12/31/1999 by month first; a first number over 12 or a dot means day first."""
        a, b, c = (F.get(p, F.lit(k)) for k in range(3))
        day_first = dots | (a > 12)
        return F.struct(F.when(iso, a).otherwise(c).alias("year"), F.when(iso | day_first, b).otherwise(a).alias("month"), F.when(iso, c).when(day_first, a).otherwise(b).alias("day"), day_first.alias("day_first"))

    def written(x: Column) -> Column:
        year, month, day = x["year"], x["month"], x["day"]
        leap = (month == 2) & (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        days = F.get(F.array(*map(F.lit, (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31))), month - 1) + F.when(leap, 1).otherwise(0)
        fine = year.between(1700, 2099) & month.between(1, 12) & day.between(1, days)
        date = F.to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")))
        out = bound(F.datediff(date, first), lambda n: feistel(F.floor(n / _DAYS[1]), n % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1]), key, F.lit("date")))
        new = bound(out, lambda o: F.date_add(first, (o["l"] * _DAYS[1] + o["r"]).cast("int")))
        return F.when(fine, bound(new, lambda d: spelled(d, x["day_first"])))

    def spelled(new: Column, day_first: Column) -> Column:
        sep = F.when(dots, F.lit(".")).otherwise(F.lit("/"))
        number = lambda part: F.when(F.length(m) == 10, F.lpad(part.cast("string"), 2, "0")).otherwise(part.cast("string"))
        d, mo = number(F.dayofmonth(new)), number(F.month(new))
        other = F.concat(F.when(day_first, d).otherwise(mo), sep, F.when(day_first, mo).otherwise(d), sep, F.year(new).cast("string"))
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(other)

    return bound(bound(F.transform(F.split(m, r"[./-]"), lambda x: x.cast("int")), read), written)


def mod97(text: Column) -> Column:
    """A string of capitals and digits modulo 97, letters as 10 to 35."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: Column) -> Column:
    def changed(x: Column) -> Column:
        country, bban = F.substring(x, 1, 2), F.substring(x, F.lit(5), F.length(x) - 4)
        fine = F.length(x).between(15, 34) & (mod97(F.concat(bban, country, F.substring(x, 3, 2))) == 1) & (F.length(_digits(bban)) >= 2)
        body = _fill(bban, permute_digits(_digits(bban), key, "iban"))
        check = lambda b: F.lpad((F.lit(98) - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
        return F.when(fine, bound(body, lambda b: _fill(m, F.concat(check(b), _digits(b)))))

    return bound(F.regexp_replace(m, " ", ""), changed)


def _email(m: Column, key: Column) -> Column:
    """The name's letters and digits become others of their kind by a keyed hash of the whole address; the host stays."""
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    stream = F.concat(*[F.sha2(F.concat_ws("|", key, F.lit(f"email{k}"), F.lower(m)), 256) for k in range(2)])
    chars = F.filter(F.split(name, ""), lambda c: c != "")

    def one(c: Column, x: Column) -> Column:
        return F.when(c.between("0", "9"), F.char(48 + x % 10)).when(c.between("a", "z"), F.char(97 + x % 26)).when(c.between("A", "Z"), F.char(65 + x % 26)).otherwise(c)

    drawn = lambda st, i: F.conv(F.substring(st, (i % 60) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    new = bound(stream, lambda st: F.transform(chars, lambda c, i: bound(drawn(st, i), lambda x: one(c, x))))
    return F.concat(F.array_join(new, ""), F.lit("@"), host)


def kind(m: Column) -> Column:
    """Which format a candidate has."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return F.when(m.contains("@"), "email").when(whole(_IBAN), "iban").when(whole(_DATE), "date").when(whole(_IP), "ip").when(whole(_SSN), "ssn").when(whole(_PHONE), "phone").otherwise("card")


def pseudonym(m: Column, key: Column) -> Column:
    """struct(kind, value): a candidate's format and its pseudonym; value is null if it doesn't hold good."""
    by = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}

    def changed(k: Column) -> Column:
        value = F.lit(None).cast("string")
        for name, f in by.items():
            value = F.when(k == name, f(m, key)).otherwise(value)
        return F.struct(k.alias("kind"), value.alias("value"))

    return bound(kind(m), changed)


def pseudonymise(docs: DataFrame, key: str, text_column: str = "text", found_column: str | None = None) -> DataFrame:
    """docs with pseudonyms in its text column, all other columns as they are.

    key is a secret: whoever has it can undo the pseudonyms. found_column, if named, gets the kinds replaced, in text order. One pass without a
    shuffle; texts of any length are read whole. Null texts stay null (found: empty),
    empty texts empty; repeated rows stay; an empty table gives no rows. Numbers whose
    check digits, ranges or calendar don't hold stay in the text.
    """
    k, text = F.lit(key), F.col(f"`{text_column}`")
    taken = {c.lower() for c in docs.columns}
    name = lambda n: next(x for i in range(len(taken) + 1) if (x := f"_{n}{i}") not in taken)
    gaps, new = name("gaps"), name("new")
    # one search marks all matches; only a text that holds the mark itself is searched twice
    cut, marked = name("cut"), F.contains(text, F.lit(_MARK))
    parts = F.split(F.regexp_replace(text, PATTERN, f"{_MARK}$0{_MARK}"), _MARK, -1)
    every = lambda odd: F.filter(F.col(cut), lambda x, i: (i % 2) == odd)
    step = docs.withColumn(cut, F.when(marked, F.lit(None)).otherwise(parts))
    matches = F.when(marked, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(every(1))
    step = step.withColumn(new, F.transform(matches, lambda m: F.struct(m.alias("old"), pseudonym(m, k).alias("to"))))
    step = step.withColumn(gaps, F.when(F.size(new) > 0, F.when(marked, F.split(text, PATTERN, -1)).otherwise(every(0))))
    joined = F.array_join(F.zip_with(gaps, new, lambda g, n: F.concat(g, F.coalesce(n["to"]["value"], n["old"], F.lit("")))), "")
    kinds = F.transform(F.filter(F.coalesce(new, F.array()), lambda n: n["to"]["value"].isNotNull()), lambda n: n["to"]["kind"])
    out = {text_column: F.when(F.size(new) > 0, joined).otherwise(text)}
    columns = [out[c].alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns]
    return step.select(*columns, *([kinds.alias(found_column)] if found_column else []))
