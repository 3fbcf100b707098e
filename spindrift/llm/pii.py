"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame operations only.

Numbers and dates that pass their own checks (Luhn, IBAN check digits, calendar,
octet and area ranges) are replaced by keyed permutations inside their format:
a Feistel network over the characters, or over a pair of mixed radices where
the valid values are not all digit strings.  Permutations are one to one and
depend on the key and the value alone, so equal values stay linked across
documents and different ones stay apart.

What is replaced: payment card numbers (13 to 19 digits, Luhn; the check digit
is made anew), IBANs (digits of the account part; check digits made anew),
international and parenthesised phone numbers (the digits after the country
code), IPv4 addresses, United States social security numbers, calendar dates
from 1900-01-01 on for 72,900 days (dates elsewhere stay), and the local part
of e-mail addresses (letters stay letters, digits digits).  Separators stay.
Dates with slashes are read day first; those that have no such day are read
month first and become another date that only the month-first reading allows.

Forms are looked for one after the other in what is still in clear: a pass puts
one private-use character in the place of each value it takes out, and the
values return in reverse order at the end, so a text of any length costs time
in proportion.  In a run of groups every stretch of whole groups is tried, so a
number beside other groups is found: for IBANs first the length of the country,
for cards a number without separators, then from the left the longest stretch.
A stretch with foreign groups passes a card's check by chance one time in ten;
it is replaced whole then, and nothing stays in clear, but that card is not
linked to others.

Defined results: null texts stay null with counts of 0; empty texts stay empty;
texts without a match are returned as they are; repeated rows are replaced
alike; an empty table gives an empty result; the table's other columns stay as
they are.  A count column whose name the table has already (in any case of
letters) gets underscores at its end.  The patterns repeat without recursion,
so very long texts are safe.  The key's digest is all that a query plan shows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# The forms of personal numbers, dates and addresses, in the order they are tried.
FORMS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,10}[A-Za-z]{2,24}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "date": r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}[ .-]?\d{2,4}[ .-]?\d{3,4}[ .-]?\d{3,4}",
    "card": r"\d(?:[ -]?\d){12,18}",
}
KINDS = tuple(FORMS)
BEFORE, AFTER = r"(?<![A-Za-z0-9_+])", r"(?![A-Za-z0-9_])"
#: Groups of digits, or of an IBAN's characters, of which a stretch can be a number.
CARD_RUN = BEFORE + r"(?=\d(?:[ -]?\d){12})\d++" + AFTER + r"(?:[ -]\d++" + AFTER + ")*+"
IBAN_RUN = BEFORE + r"[A-Z]{2}\d{2}[A-Z0-9]*+" + AFTER + r"(?: [A-Z0-9]++" + AFTER + ")*+"
# Characters of a country's IBANs.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: Failed matches that no later form may take groups from.
STAYS = {"date": r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])$", "ssn": "^"}
#: What each form implies; cheaper to look for than the form.
HINTS = {"email": "@", "iban": r"[A-Z]{2}\d{2}", "date": r"\d{4}", "ssn": r"-\d{4}", "ip": r"\d\.\d", "phone": r"\+\d|\(\d{2}", "card": r"\d(?:[ -]?\d){12}"}
#: Implied by every form: an e-mail's sign, an IBAN's head, a phone's head, an address's point, or
#: four digits with a card's separators at most (cards, dates and social security numbers have them).
HINT = r"@|[A-Z]{2}\d{2}|\+\d|\(\d{2}|\d\.\d|\d(?:[ -]?\d){3}"


#: A pass puts its own private-use character where it took a value out.
MARKS = "\ue000\ue001\ue002\ue003\ue004\ue005\ue006\ue007"
#: Such characters in a text become this one and a character further on.
GUARD, SHIFT = "\ue00f", 0x10


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digest(key: str, *parts: Column) -> Column:
    """key: a digest of the caller's key."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts).cast("binary"), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def _shift(text: Column, digest: Column, sign: int) -> Column:
    """Every digit and letter moves within its class by a digit pair of the digest."""

    def one(c: Column, i: Column) -> Column:
        by = F.lit(sign) * F.conv(F.substring(digest, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        in_class = lambda first, size: F.char((F.pmod(code - first + by, F.lit(size)) + first).cast("long"))
        out = c
        for a, b, first, size in (("0", "9", 48, 10), ("a", "z", 97, 26), ("A", "Z", 65, 26)):
            out = F.when(c.between(a, b), in_class(first, size)).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def permute(text: Column, label: str, key: str, inverse: bool = False) -> Column:
    """A keyed permutation of all strings with the same classes of characters by place."""
    half = (F.length(text) / 2).cast("int")
    left, right = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))

    def step(state: Column, i: Column) -> Column:
        a, b = (state["a"], state["b"]) if not inverse else (state["b"], state["a"])
        digest = _digest(key, F.lit(label), i.cast("string"), b)
        moved = F.when(F.length(a) > 0, _let(digest, lambda d: _shift(a, d, -1 if inverse else 1))).otherwise(a)
        return F.struct(b.alias("a"), moved.alias("b")) if not inverse else F.struct(moved.alias("a"), b.alias("b"))

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1)) if not inverse else F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1))
    return F.aggregate(rounds, F.struct(left.alias("a"), right.alias("b")), step, lambda s: F.concat(s["a"], s["b"]))


def permute_pair(index: Column, a: int, b: int, label: str, key: str, inverse: bool = False) -> Column:
    """A keyed permutation of 0 .. a * b - 1, as a Feistel network over the two radices."""

    def step(state: Column, i: Column) -> Column:
        by = lambda x: F.lit(-1 if inverse else 1) * _number(_digest(key, F.lit(label), i.cast("string"), x.cast("string")))
        left = F.pmod(state["l"] + by(state["r"]), F.lit(a).cast("long"))
        right = F.pmod(state["r"] + by(state["l"]), F.lit(b).cast("long"))
        return F.struct(F.when(i % 2 == 0, left).otherwise(state["l"]).alias("l"), F.when(i % 2 == 1, right).otherwise(state["r"]).alias("r"))

    index = index.cast("long")
    start = F.struct(F.floor(index / b).cast("long").alias("l"), (index % b).alias("r"))
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1)) if not inverse else F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1))
    return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _luhn_sum(digits: Column) -> Column:
    """The sum over digits whose last one is doubled (the check digit not among them)."""
    places = F.split(F.reverse(digits), "")
    twice = F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    doubled = F.transform(places, lambda c, i: F.when(i % 2 == 0, F.element_at(twice, c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x)


def _check_digit(digits: Column) -> Column:
    return F.pmod(-_luhn_sum(digits), F.lit(10)).cast("string")


def _fill(template: Column, characters: Column, replaced: str) -> Column:
    """The template with its characters of the class ``replaced`` taken from ``characters`` in order."""
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(characters: Column, s: Column, c: Column) -> Column:
        mine = c.rlike(replaced)
        char = F.when(mine, F.substring(characters, s["at"], F.lit(1))).otherwise(c)
        return F.struct(F.concat(s["out"], char).alias("out"), (s["at"] + F.when(mine, 1).otherwise(0)).alias("at"))

    return _let(characters, lambda known: F.aggregate(F.split(template, ""), state, lambda s, c: put(known, s, c), lambda s: s["out"]))


def _mod97(text: Column) -> Column:
    step = lambda s, c: F.when(c.between("0", "9"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban_rotated(compact: Column, check: Column) -> Column:
    return F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 2), check)


def _card(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    body = F.substring(d, F.lit(1), F.length(d) - 1)
    valid = F.substring(d, F.length(d), F.lit(1)) == _check_digit(body)
    whole = _let(permute(body, "card", key), lambda moved: F.concat(moved, _check_digit(moved)))
    return valid, _fill(m, whole, r"\d")


def _iban(m: Column, key: str) -> tuple[Column, Column]:
    compact = F.replace(m, F.lit(" "), F.lit(""))
    valid = F.length(compact).between(15, 34) & (_mod97(_iban_rotated(compact, F.substring(compact, 3, 2))) == 1)
    account = F.substring(compact, F.lit(5), F.length(compact))
    unchecked = F.concat(F.substring(compact, 1, 2), F.lit("00"), _fill(account, permute(_digits(account), "iban", key), r"\d"))

    def checked(moved: Column) -> Column:
        check = F.lpad((F.lit(98) - _mod97(_iban_rotated(moved, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(F.substring(moved, 1, 2), check, F.substring(moved, F.lit(5), F.length(moved)))

    return valid, _fill(m, _let(unchecked, checked), "[A-Z0-9]")


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    country = F.regexp_extract(m, r"^\+\d{1,3}(?=\D)", 0)
    country = F.when((country == "") & m.startswith("+"), F.substring(m, 1, 2)).otherwise(country)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    return F.length(_digits(m)).between(8, 15), F.concat(country, _fill(rest, permute(_digits(rest), "phone", key), r"\d"))


def _ip(m: Column, key: str) -> tuple[Column, Column]:
    octets = F.split(m, r"\.")
    valid = F.forall(octets, lambda x: x.rlike("^(?:0|[1-9][0-9]{0,2})$") & (x.cast("int") < 256))
    index = F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    moved = permute_pair(index, 65536, 65536, "ip", key)
    octet = lambda x, k: F.pmod(F.floor(x / F.pow(F.lit(2.0), k)).cast("long"), F.lit(256).cast("long")).cast("string")
    return valid, _let(moved, lambda x: F.array_join(F.transform(F.array(*map(F.lit, (24, 16, 8, 0))), lambda k: octet(x, k)), "."))


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)
    index = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1) * 9999 + serial - 1
    pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")

    def written(moved: Column) -> Column:
        place = F.floor(moved / (99 * 9999))
        new_area = place + 1 + F.when(place >= 665, 1).otherwise(0)
        return F.concat_ws("-", pad(new_area, 3), pad(F.floor(moved / 9999) % 99 + 1, 2), pad(moved % 9999 + 1, 4))

    return valid, _let(permute_pair(index, 898 * 99, 9999, "ssn", key), written)


def _date(m: Column, key: str) -> tuple[Column, Column]:
    first = F.to_date(F.lit("1900-01-01"))
    year, a, b = F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)
    day_first = F.concat_ws("-", year, b, a)
    dated = lambda iso: F.coalesce(F.datediff(iso.try_cast("date"), first), F.lit(-1))
    in_range = lambda index: index.between(0, 72_899)
    shape = (
        F.when(m.rlike(r"^\d{4}-"), 0).when(m.rlike(r"^\d{4}/"), 1).when(m.rlike(r"^\d{2}\."), 2)
        .when(day_first.try_cast("date").isNotNull(), 3).otherwise(4)
    )
    iso = F.when(shape <= 1, F.replace(m, F.lit("/"), F.lit("-"))).when(shape <= 3, day_first).otherwise(F.concat_ws("-", year, a, b))
    index = dated(iso)
    moves = lambda index: permute_pair(index, 270, 270, "date", key)
    late = lambda index: F.dayofmonth(F.date_add(first, index.cast("int"))) > 12
    # Month-first dates walk along the permutation's cycle to the next day that cannot be read day first.
    walk = lambda index: F.aggregate(F.sequence(F.lit(0), F.lit(63)), moves(index), lambda x, _: F.when(late(x), x).otherwise(moves(x)))
    moved = F.date_add(first, F.when(shape == 4, walk(index)).otherwise(moves(index)).cast("int"))

    def written(x: Column) -> Column:
        y, mo, d = (F.lpad(f(x).cast("string"), n, "0") for f, n in ((F.year, 4), (F.month, 2), (F.dayofmonth, 2)))
        out = F.concat_ws("/", mo, d, y)
        for k, (mark, *parts) in enumerate([("-", y, mo, d), ("/", y, mo, d), (".", d, mo, y), ("/", d, mo, y)]):
            out = F.when(shape == k, F.concat_ws(mark, *parts)).otherwise(out)
        return out

    return in_range(index), _let(moved, written)


def _email(m: Column, key: str) -> tuple[Column, Column]:
    at = F.instr(m, "@")
    return F.lit(True), F.concat(permute(F.substring(m, F.lit(1), at - 1), "email", key), F.substring(m, at, F.length(m)))


_MAKERS = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card}


PARTS = "array<struct<kind:string,text:string>>"
#: Values that a fold gathers before they are put with the others.
_CHUNK = 256


def _part(text: Column, kind: str | None = None) -> Column:
    return F.struct(F.lit(kind).cast("string").alias("kind"), text.alias("text"))


def pseudonym(match: Column, kind: str, key: str) -> Column:
    """(kind, text) of a match of a form; no kind, and unchanged, where it fails the form's check.

    What still looks like a date or a social security number has the kind "" and is no card's group.
    """
    valid, text = _MAKERS[kind](match, key)
    out = F.when(valid, _part(text, kind))
    return (out.when(match.rlike(STAYS[kind]), _part(match, "")) if kind in STAYS else out).otherwise(_part(match))


def _stretches(run: Column, word: str, most: int, kind: str, key: str, prefer) -> Column:
    """The parts of a run of groups: from its start on, the stretches of whole groups that are valid.

    ``prefer`` gives the stretches that begin at a group, of up to ``most`` groups, in the order to try.
    """
    taken = "array<struct<valid:boolean,text:string>>"

    def scan(pieces: Column) -> Column:  # groups, and separators between them, at which no stretch begins
        # Element by element: a slice would walk the whole run each time.
        stretch = lambda i, n: F.array_join(F.transform(F.sequence(i, i + n - 1), lambda j: F.element_at(pieces, j)), "")

        def step(state: Column, i: Column) -> Column:
            lengths = F.sequence(F.lit(1), F.least(F.lit(2 * most - 1), F.size(pieces) - i + 1), F.lit(2))
            fits = lambda x: x["text"].rlike(f"^(?:{FORMS[kind]})$") & _MAKERS[kind](x["text"], key)[0]
            tried = F.filter(F.transform(lengths, lambda n: F.struct(n.alias("n"), stretch(i, n).alias("text"))), fits)
            first = F.try_element_at(F.when(i >= state["next"], prefer(tried)), F.lit(1))
            put = lambda n, valid, text: F.struct(
                (i + n).cast("int").alias("next"),
                F.concat(state["parts"], F.array(F.struct(F.lit(valid).alias("valid"), text.alias("text")))).alias("parts"),
            )
            return _let(
                first,
                lambda x: F.when(x.isNotNull(), put(x["n"], True, x["text"]))
                .when(i >= state["next"], put(F.lit(1), False, F.element_at(pieces, i)))
                .otherwise(state),
            )

        def chunk(state: Column, lo: Column) -> Column:
            places = F.sequence(lo, F.least(lo + _CHUNK - 1, F.size(pieces)))
            start = F.struct(state["next"].alias("next"), F.array().cast(taken).alias("parts"))
            own = F.aggregate(places, start, step)
            return _let(own, lambda x: F.struct(x["next"].alias("next"), F.concat(state["parts"], F.array(x["parts"])).alias("parts")))

        begin = F.struct(F.lit(1).alias("next"), F.array().cast(f"array<{taken}>").alias("parts"))
        end = lambda x: F.when(x["valid"], pseudonym(x["text"], kind, key)).otherwise(_part(x["text"]))
        return F.aggregate(F.sequence(F.lit(1), F.size(pieces), F.lit(_CHUNK)), begin, chunk, lambda s: F.transform(F.flatten(s["parts"]), end))

    return _let(F.regexp_extract_all(run, F.lit(f"{word}|[ -]"), F.lit(0)), scan)


def _longest(tried: Column) -> Column:
    return F.reverse(tried)


def _by_country(tried: Column) -> Column:
    """Stretches of the length that the country's IBANs have, then the longest."""
    lengths = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))
    own = lambda x: F.length(F.replace(x["text"], F.lit(" "), F.lit(""))) == F.try_element_at(lengths, F.substring(x["text"], 1, 2))
    return F.concat(F.filter(tried, own), F.reverse(tried))


def _passes(key: str):
    """(hint, pattern, parts of a match) in the order they are applied to what is still in clear."""
    alone = lambda kind, form: (HINTS[kind], BEFORE + f"(?:{form})" + AFTER, lambda m: F.array(pseudonym(m, kind, key)))
    yield alone("email", FORMS["email"])
    yield HINTS["iban"], IBAN_RUN, lambda m: _stretches(m, "[A-Z0-9]+", 10, "iban", key, _by_country)
    for kind in ("date", "ssn", "ip", "phone"):
        yield alone(kind, FORMS[kind])
    # Cards without separators come first: a group beside them is not theirs.
    yield alone("card", r"\d{14,19}")
    yield HINTS["card"], CARD_RUN, lambda m: _stretches(m, r"\d+", 19, "card", key, _longest)


def _guarded(text: Column) -> Column:
    """The text without private-use marks of its own."""
    out = F.regexp_replace(text, f"([{MARKS}{GUARD}])", f"{GUARD}$1")
    for c in MARKS + GUARD:
        out = F.replace(out, F.lit(GUARD + c), F.lit(GUARD + chr(ord(c) + SHIFT)))
    return F.when(text.rlike(f"[{MARKS}{GUARD}]"), out).otherwise(text)


def _unguarded(text: Column) -> Column:
    out = text
    for c in MARKS + GUARD:  # the guard's own code last, or it would form new ones
        out = F.replace(out, F.lit(GUARD + chr(ord(c) + SHIFT)), F.lit(c))
    return F.when(text.contains(GUARD), out).otherwise(text)


def _marked(mark: str):
    """A match's parts with the mark for each value that is taken out."""
    return lambda parts: F.array_join(F.transform(parts, lambda x: F.when(x["kind"].isNull(), x["text"]).otherwise(F.lit(mark))), "")


def _free(name: str, taken: set[str]) -> str:
    """The name, with underscores at its end while the table has it."""
    while name.lower() in taken:
        name += "_"
    taken.add(name.lower())
    return name


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """The documents with the text replaced; counts: also columns n_<kind> and n_replaced."""
    names = docs.columns
    taken = {c.lower() for c in names}
    counted = {k: _free(f"n_{k}", taken) for k in (*KINDS, "replaced")}
    clear, passes = _free("__clear", taken), list(_passes(hashlib.sha256(key.encode()).hexdigest()))
    found = [_free(f"__found_{i}", taken) for i in range(len(passes))]
    own = F.col(f"`{text_col}`").cast("string")
    out = docs.withColumn(clear, F.when(own.rlike(HINT), _guarded(own)))
    for mark, name, (hint, pattern, make) in zip(MARKS, found, passes, strict=True):
        # Each pass's values are computed once, in a projection of their own.
        text = F.col(clear)
        matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), make)
        out = out.withColumn(name, F.when(text.rlike(hint) & text.rlike(pattern), matches))
        marked = F.transform(name, _marked(mark))
        left = F.zip_with(F.split(text, pattern, -1), marked, lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
        taken_out = F.filter(F.flatten(name), lambda x: x["kind"].isNotNull())
        out = out.withColumns({clear: F.when(F.col(name).isNotNull(), F.array_join(left, "")).otherwise(text), name: taken_out})
    of_kind = lambda f, k: F.coalesce(F.size(F.filter(f, lambda x: x["kind"] == k)), F.lit(0))
    out = out.withColumns({counted[k]: sum((of_kind(f, k) for f in found), F.lit(0)).cast("long") for k in KINDS})
    out = out.withColumn(counted["replaced"], sum((F.col(counted[k]) for k in KINDS), F.lit(0).cast("long")))
    whole = F.col(clear)
    for mark, name in reversed(list(zip(MARKS, found, strict=True))):
        back = F.zip_with(F.split(whole, mark, -1), F.col(name)["text"], lambda p, v: F.concat(p, F.coalesce(v, F.lit(""))))
        whole = F.when(F.size(name) > 0, F.array_join(back, "")).otherwise(whole)
    out = out.withColumn(text_col, F.when(F.col(counted["replaced"]) > 0, _unguarded(whole)).otherwise(own))
    return out.select(*(f"`{c}`" for c in names), *(counted.values() if counts else ()))
