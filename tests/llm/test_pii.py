"""Pseudonyms against a plain Python pseudonymiser, on very long texts and on clashing columns."""

import datetime
import hashlib
import re

from pyspark.sql import functions as F

from spindrift.llm import pii, queries

KEY = hashlib.sha256(b"key").hexdigest()
DAY_ONE = datetime.date(1900, 1, 1)


def digest(*parts):
    return hashlib.sha256("\x1f".join((KEY, *map(str, parts))).encode()).hexdigest()


def shifted(text, by):
    out = []
    for i, c in enumerate(text):
        n = int(by[2 * (i % 32) : 2 * (i % 32) + 2], 16)
        for first, size in (("0", 10), ("a", 26), ("A", 26)):
            if ord(first) <= ord(c) < ord(first) + size:
                c = chr((ord(c) - ord(first) + n) % size + ord(first))
                break
        out.append(c)
    return "".join(out)


def permuted(text, label):
    a, b = text[: len(text) // 2], text[len(text) // 2 :]
    for i in range(pii.ROUNDS):
        a, b = b, shifted(a, digest(label, i, b)) if a else a
    return a + b


def permuted_pair(index, a, b, label):
    left, right = divmod(index, b)
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + int(digest(label, i, right)[:13], 16)) % a
        else:
            right = (right + int(digest(label, i, left)[:13], 16)) % b
    return left * b + right


def luhn(digits):
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def filled(template, chars, wanted):
    chars = iter(chars)
    return "".join(next(chars) if re.match(wanted, c) else c for c in template)


def card(m):
    body = permuted(re.sub(r"\D", "", m)[:-1], "card")
    return filled(m, body + luhn(body), r"\d")


def iban(m):
    flat = m.replace(" ", "")
    account = filled(flat[4:], permuted(re.sub(r"\D", "", flat[4:]), "iban"), r"\d")
    check = 98 - int("".join(str(int(c, 36)) for c in account + flat[:2] + "00")) % 97
    return filled(m, f"{flat[:2]}{check:02d}{account}", "[A-Z0-9]")


def date(m):
    parts = re.split(r"\D", m)
    mark = m[4] if m[4] in "-/" else m[2]
    orders = {"-": "ymd", ".": "dmy"}
    order = orders.get(mark) or ("ymd" if m[4] == "/" else "dmy" if int(parts[1]) <= 12 else "mdy")
    at = {k: int(parts[order.index(k)]) for k in "ymd"}
    index = (datetime.date(at["y"], at["m"], at["d"]) - DAY_ONE).days
    while True:
        index = permuted_pair(index, 270, 270, "date")
        new = DAY_ONE + datetime.timedelta(index)
        if order != "mdy" or new.day > 12:
            return mark.join({"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}[k] for k in order)


def ssn(m):
    a, g, s = map(int, m.split("-"))
    moved = permuted_pair(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99, 9999, "ssn")
    place = moved // (99 * 9999)
    return f"{place + 1 + (place >= 665):03d}-{moved // 9999 % 99 + 1:02d}-{moved % 9999 + 1:04d}"


def ip(m):
    moved = permuted_pair(int.from_bytes(bytes(map(int, m.split("."))), "big"), 65536, 65536, "ip")
    return ".".join(map(str, moved.to_bytes(4, "big")))


def phone(m):
    country = re.match(r"(\+\d{1,3}(?=\D))?", m)[0]
    rest = m[len(country) :]
    return country + filled(rest, permuted(re.sub(r"\D", "", rest), "phone"), r"\d")


def email(m):
    name, _, domain = m.partition("@")
    return f"{permuted(name, 'email')}@{domain}"


VALUES = [
    (card, "4532015112830366"), (card, "4532-0151-1283-0366"), (card, "4222222222222"), (iban, "DE89 3704 0044 0532 0130 00"), (iban, "GB82WEST12345698765432"),
    (date, "2020-02-29"), (date, "1999/12/31"), (date, "31.12.1999"), (date, "31/12/1999"), (date, "12/31/1999"), (date, "03/04/2020"), (ssn, "123-45-6789"), (ssn, "667-01-0001"),
    (ip, "83.192.178.196"), (phone, "+49 89 123 456"), (phone, "(030) 123 456"), (email, "Joe.Doe12@ex-ample.co.uk"), (email, "x@y.zz"),
]


def test_equal_to_a_plain_pseudonymiser(spark):
    texts = [f"ä {v} — und {v}, 漢" for _, v in VALUES]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "key").collect()
    for r in rows:
        make, v = VALUES[r.doc_id]
        assert r.text == texts[r.doc_id].replace(v, make(v)) != texts[r.doc_id]
        assert (r[f"n_{make.__name__}"], r.n_replaced) == (2, 2)


def test_month_first_dates_stay_so(spark):
    days = [DAY_ONE + datetime.timedelta(k) for k in range(0, 72_900, 61)]
    texts = [d.strftime("%m/%d/") + f"{d.year:04d}" for d in days if d.day > 12]
    rows = pii.pseudonymise(spark.createDataFrame([(t, t) for t in texts], "was string, text string"), "key").collect()
    assert len({r.text for r in rows}) == len(texts)
    assert all(int(r.text[3:5]) > 12 and r.text == date(r.was) for r in rows)


def test_very_long_texts(spark):
    long = [
        ("x@" + "ab.a-b." * 150_000 + "com", 1), ("a@b.cd " * 150_000, 150_000), ("4532015112830366 " * 3000, 3000), ("1 " * 3000, 0),
        ("DE89 3704 0044 0532 0130 00 " * 2000, 2000), ("12/31/1999 " * 5000, 5000), ("1.2.3.4 " * 5000, 5000), ("+49 89 123 456 " * 5000, 5000),
        ("123-45-6789 " * 5000, 5000), ("a.b" * 350_000, 0), ("+" * 1_000_000, 0), ("1-" * 500_000, None), ("7" * 1_000_000, 0), ("A1" * 500_000, 0), ("", 0), (None, 0),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, n) in enumerate(long) if n is not None], "doc_id int, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(docs, "key").select("doc_id", "n_replaced", F.length("text").alias("n")).collect()}
    for i, (t, n) in enumerate(long):
        if n is not None:
            assert got[i].n_replaced == n and (i == 6 or got[i].n == (None if t is None else len(t)))


def test_clashing_columns_and_private_characters(spark):
    odd = "".join(map(chr, range(0xE000, 0xE024))) + ""
    text = f"{odd} 4532015112830366 {odd}"
    docs = spark.createDataFrame([(1, text, 7, "kept", 3)], "doc_id int, text string, n_card int, `N_Replaced` string, __found_0 int")
    r = pii.pseudonymise(docs, "key").first()
    assert (r.n_card, r.N_Replaced, r["__found_0"], r.n_card_, r.n_replaced_) == (7, "kept", 3, 1, 1)
    assert r.text == text.replace("4532015112830366", card("4532015112830366"))
    alone = pii.pseudonymise(docs, "key", counts=False)
    assert alone.columns == docs.columns and alone.first().text == r.text


def test_the_key_is_the_deployment_s(spark):
    assert queries.pseudonym_key(spark) == queries.DEMONSTRATION_KEY
    spark.conf.set(queries.KEY_SETTING, "own")
    try:
        assert queries.pseudonym_key(spark) == "own"
    finally:
        spark.conf.unset(queries.KEY_SETTING)
