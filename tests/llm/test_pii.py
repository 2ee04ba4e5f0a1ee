from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from datetime import date

from pyspark.sql import functions as F

from crawlgrain.llm import pii
from tests.llm.helpers import docs


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0


def iban(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def shape(s):
    return re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", s)))


def run(spark, texts, key="k"):
    rows = pii.pseudonymise(docs(spark, list(enumerate(texts))).drop("pii"), key, found_column="pii").orderBy("doc_id").collect()
    return [x.text for x in rows], [x.pii for x in rows]


VALID = [
    ("card", "4111 1111 1111 1111"), ("card", "378282246310005"), ("card", "4111-1111-1111-1111"), ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"),
    ("ip", "192.168.0.255"), ("date", "2020-02-29"), ("date", "12/31/1999"), ("date", "31.1.2001"), ("date", "25/12/1990"), ("ssn", "123-45-6789"), ("ssn", "899-99-9999"),
    ("phone", "+1 (974) 555-3436"), ("phone", "555-123-4567"), ("phone", "+49 30 1234567"), ("email", "einau.34@mail7.example.com"),
]


class Slow:
    """Pseudonyms written out in plain Python."""

    def __init__(self, key):
        self.key = key

    def keyed(self, tweak, turn, value):
        return int(hashlib.sha256(f"{self.key}|{tweak}|{turn}|{value}".encode()).hexdigest()[:15], 16)

    def feistel(self, a, b, n_a, n_b, tweak, back=False):
        for turn in sorted(range(8), reverse=back):
            sign = -1 if back else 1
            if turn % 2 == 0:
                a = (a + sign * (self.keyed(tweak, turn, b) % n_a)) % n_a
            else:
                b = (b + sign * (self.keyed(tweak, turn, a) % n_b)) % n_b
        return a, b

    def digits(self, d, tweak):
        n, h = len(d), len(d) // 2
        a, b = self.feistel(int(d[:h]), int(d[h:]), 10**h, 10 ** (n - h), f"{tweak}{n}")
        return f"{a:0{h}d}{b:0{n - h}d}"

    def fill(self, v, digits):
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in v)

    def card(self, v):
        body = self.digits(re.sub(r"\D", "", v)[:-1], "card")
        return self.fill(v, body + next(c for c in "0123456789" if luhn(body + c)))

    def iban(self, v):
        bare = v.replace(" ", "")
        body = self.fill(bare[4:], self.digits(re.sub(r"\D", "", bare[4:]), "iban"))
        check = next(f"{c:02d}" for c in range(2, 99) if iban(f"{bare[:2]}{c:02d}{body}"))
        return self.fill(v, check + re.sub(r"\D", "", body))

    def phone(self, v):
        d, code = re.sub(r"\D", "", v), re.match(r"\+(\d{1,3})(?=[ .(-])", v)
        n = len(code[1]) if code else 0
        return self.fill(v, d[:n] + self.digits(d[n:], "phone"))

    def ssn(self, v):
        area, group, serial = map(int, v.split("-"))
        areas = [x for x in range(1, 900) if x != 666]
        a, b = self.feistel(areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
        return f"{areas[a // 99]:03d}-{a % 99 + 1:02d}-{b + 1:04d}"

    def ip(self, v):
        o = [int(x) for x in v.split(".")]
        a, b = self.feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"

    def date(self, v):
        parts = [int(x) for x in re.split("[./-]", v)]
        iso, day_first = "-" in v, "." in v or parts[0] > 12
        y, m, d = parts if iso else (parts[2], parts[1], parts[0]) if day_first else (parts[2], parts[0], parts[1])
        n = (date(y, m, d) - date(1700, 1, 1)).days
        a, b = self.feistel(n // 773, n % 773, 189, 773, "date")
        new = date.fromordinal(date(1700, 1, 1).toordinal() + a * 773 + b)
        if iso:
            return new.isoformat()
        x, y = (new.day, new.month) if day_first else (new.month, new.day)
        sep, pad = "." if "." in v else "/", "02d" if len(v) == 10 else "d"
        return f"{x:{pad}}{sep}{y:{pad}}{sep}{new.year}"

    def email(self, v):
        name, host = v.split("@")
        stream = "".join(hashlib.sha256(f"{self.key}|email{k}|{v.lower()}".encode()).hexdigest() for k in range(2))
        new = lambda c, x: chr(48 + x % 10) if "0" <= c <= "9" else chr(97 + x % 26) if "a" <= c <= "z" else chr(65 + x % 26) if "A" <= c <= "Z" else c
        return "".join(new(c, int(stream[k % 60 * 2 : k % 60 * 2 + 2], 16)) for k, c in enumerate(name)) + "@" + host


def test_pseudonyms_are_those_of_a_plain_feistel_network(spark):
    more = [("card", "4012888888881881"), ("iban", "FR14 2004 1010 0505 0001 3M02 606"), ("ip", "0.0.0.0"), ("date", "1700-01-01"), ("date", "1.1.2099"), ("ssn", "001-01-0001"), ("phone", "+442071838750"), ("email", "A.B_c9@x.org")]
    values = [*VALID, *more]
    slow = Slow("another key")
    out, kinds = run(spark, [v for _, v in values], "another key")
    assert kinds == [[k] for k, _ in values]
    assert out == [getattr(slow, k)(v) for k, v in values]
    for a, b in ((0, 0), (7, 772), (188, 5)):
        assert slow.feistel(*slow.feistel(a, b, 189, 773, "date"), 189, 773, "date", back=True) == (a, b)


def test_valid_values_keep_their_format_and_stay_valid(spark):
    out, kinds = run(spark, [f"see {v}, and {v}!" for _, v in VALID])
    for (kind, v), text, k in zip(VALID, out, kinds, strict=True):
        assert k == [kind, kind], (v, k)
        a, b = re.fullmatch(r"see (.+), and (.+)!", text).groups()
        assert a == b != v
        if kind not in ("ip", "date"):
            assert shape(a) == shape(v)
        if kind == "card":
            assert luhn(a)
        if kind == "iban":
            assert iban(a) and a[:2] == v[:2]
        if kind == "ip":
            ipaddress.ip_address(a)
        if kind == "ssn":
            area, group, serial = map(int, a.split("-"))
            assert 0 < area < 900 and area != 666 and group and serial
        if kind == "email":
            assert a.endswith("@mail7.example.com")
        if v.startswith("+"):
            assert a.startswith(v.split(" ")[0] + " ")
    y, m, d = map(int, re.search(r"see ([\d-]+)", out[6])[1].split("-"))
    date(y, m, d)
    assert re.search(r"see \d\d/\d\d/\d{4},", out[7]) and re.search(r"see \d{1,2}\.\d{1,2}\.\d{4},", out[8])


def test_what_only_looks_like_it_stays(spark):
    texts = ["4111 1111 1111 1112", "DE88 3704 0044 0532 0130 00", "256.1.1.1", "1.2.3.4.5", "2021-02-29", "13/32/1999", "000-12-3456", "666-12-3456", "0000000000000000", "version 2.0", "year 1999", "a@b", None, "", "x" * 300_000]
    out, kinds = run(spark, texts)
    assert out == texts and all(k == [] for k in kinds)


def test_neighbours_and_long_texts(spark):
    v = "4111111111111111"
    out, kinds = run(spark, [f"{v} {v}", f"({v})", f"{v}{v}", "w " * 200_000 + v])
    assert kinds == [["card", "card"], ["card"], [], ["card"]] and v not in out[0] and v not in out[1] and v in out[2]


def test_permutations_are_one_to_one(spark):
    ids = spark.range(1000)
    three = pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("k"), "t")
    got = [x[0] for x in ids.select(three).collect()]
    assert sorted(map(int, got)) == list(range(1000)) and all(len(x) == 3 for x in got)
    days = pii.feistel(F.floor(F.col("id") / 773), F.col("id") % 773, F.lit(189), F.lit(773), F.lit("k"), F.lit("d"))
    assert spark.range(189 * 773).select((days["l"] * 773 + days["r"]).alias("v")).distinct().count() == 189 * 773


def test_keys_and_links(spark):
    r = random.Random(4)
    cards = []
    while len(cards) < 30:
        c = "".join(r.choice("0123456789") for _ in range(16))
        if luhn(c):
            cards.append(c)
    one, _ = run(spark, cards)
    again, _ = run(spark, [f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}" for c in cards])
    other, _ = run(spark, cards, key="another")
    assert len({*one}) == 30 and [x.replace("-", "") for x in again] == one and one != other and all(map(luhn, one))


def test_columns_and_plan(spark):
    table = docs(spark, [(1, "mail a.b@c.org"), (1, "mail a.b@c.org"), (2, None)])
    got = pii.pseudonymise(table, "k")
    assert got.columns == table.columns and got.count() == 3 and len({x.text for x in got.collect()}) == 2
    assert pii.pseudonymise(table.limit(0), "k").collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_adjacent_values(spark):
    phones = ["+1 (826) 555-4081", "+49 30 1234567", "+44 20 7946 0958"]
    ibans = ["BE71096123456769", "BE71 0961 2345 6769", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332"]
    nexts = [("ip", "190.137.223.204"), ("date", "2019-05-03"), ("date", "12/31/1999"), ("ssn", "123-45-6789"), ("phone", "555-123-4567"), ("card", "4111 1111 1111 1111"), ("email", "123@mail.example.com")]
    alone = [*phones, *ibans, *(v for _, v in nexts)]
    pairs = [(p, v, ["phone", k]) for p in phones for k, v in nexts] + [(v, w, ["iban"]) for v in ibans for w in ("EUR", "BANK")] + [(phones[0], "2019", ["phone"])]
    # short beginnings are no number of their own
    whole = ["+33 61 12.34.56.78", "+49 30 123-45-6789"]
    out, kinds = run(spark, [*alone, *(f"{a} {b}" for a, b, _ in pairs), *whole])
    to = dict(zip(alone, out, strict=False))
    for (a, b, want), text, found in zip(pairs, out[len(alone) :], kinds[len(alone) :], strict=False):
        assert found == want and text == f"{to[a]} {to.get(b, b)}", (a, b, text)
    assert kinds[-2:] == [["phone"]] * 2


def test_texts_that_hold_the_mark(spark):
    values = ["x \x01 4111 1111 1111 1111 \x01\x01 2020-02-29", "\x01", "a\x01b 2020-02-29\x01", "2020-02-29", "2020-02-29 2020-02-29", " 2020-02-29 "]
    out, kinds = run(spark, values)
    slow = Slow("k")
    for v, text, k in zip(values, out, kinds, strict=True):
        assert text == v.replace("4111 1111 1111 1111", slow.card("4111 1111 1111 1111")).replace("2020-02-29", slow.date("2020-02-29"))
        assert len(k) == v.count("4111 1111") + v.count("2020-02-29")
