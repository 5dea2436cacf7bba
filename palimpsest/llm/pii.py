"""Format-preserving pseudonyms by keyed Feistel permutations (operator 5), in DataFrame functions alone.

One pattern finds candidates; each is validated by what its format demands (Luhn or mod-97
digits, octets, calendar, area codes), and only valid ones are permuted, inside their format:
digits stay digits, letters letters of their case, separators stay, check digits are computed
anew, dates stay dates of the same layout, a phone number has an area code and exchange that
the numbering plan allows, a social security number an area, group and serial that can be given out.
The round function is HMAC-SHA256 of the kind, the round and the other half, so equal values get equal
pseudonyms in every document, and different values of a format different ones; without the key
they can't be taken back. Everything happens inside the row: no exchange, no join, no state.

What was chosen: of a card the first digit stays, of an address the domain, of a secret with a
public prefix that prefix; a secret of hexadecimal digits stays one, other secrets keep the class of each character.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import operator
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Lengths of IBANs by country, from the registry of ISO 13616.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBANS.items())
#: What the candidates look like, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    # what is assigned to a telling name, and keys with the prefixes that their issuers publish; the group is what is secret: with a digit in it, or all hexadecimal or capitals
    "secret": r"(?:(?i:pass(?:word|wd|phrase)|secret|token|(?:api|access|auth|private|account)[_\-]?key)[\x22']?\s{0,3}[=:]\s{0,3}[\x22']?|\b(?:A[KS]IA(?=[A-Z0-9]{16}\b)|gh[pousr]_(?=[A-Za-z0-9]{36})|xox[abprs]-(?=[A-Za-z0-9\-]{10})|sk-(?=[A-Za-z0-9]{20})|AIza(?=[0-9A-Za-z_\-]{35})))"
    r"((?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{8,}+|(?:[A-Fa-f]{16,}+|[A-Z]{16})(?![A-Za-z0-9+/_\-]))",
    "iban": rf"\b(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{_KNOWN})\b|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?\b)",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9\-/.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9\-/])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9+\-])(?:\+?1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9\-])",
}
# a run of numbers, of which some make a card; it ends where another kind begins
_OTHER = "|".join(PATTERNS[k] for k in ("email", "ip", "date", "ssn", "phone"))
PATTERNS["card"] = rf"(?<![0-9\-])(?=[0-9](?:[ \-]?[0-9]){{12}})[0-9]++(?:[ \-](?!{_OTHER})[0-9]++)*(?![0-9\-])"
#: Cards as they are grouped in print; these go before other runs.
_PRINTED = "^([0-9]{13,19}|[0-9]{4}( [0-9]{4}){2}( [0-9]{4})?( [0-9]{1,3})?|[0-9]{4} [0-9]{6} [0-9]{4,5})$"
_EVERY = "(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
# inside a word only a number or the telling name of a secret can begin, so most places are passed over at once
_ANY = "(?:(?<![A-Za-z])|(?=[0-9+(pPsStTaA]))" + _EVERY
#: Place of what is secret among the groups of the pattern; characters of a secret that are permuted together.
_SECRET, _PART = 1, 250
#: Days from 1900-01-01 to 2099-12-31, and two factors of their number.
_DAYS, _DAY_FACTORS = 73_049, (17, 4297)
_DATE_FORMATS = {"-": "yyyy-MM-dd", "/": "MM/dd/yyyy", ".": "dd.MM.yyyy"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Expressions have no local names; a one-element array gives one."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cases(*cases: tuple[Column, Column]) -> Column:
    return functools.reduce(lambda out, case: out.when(*case), cases[1:], F.when(*cases[0]))


def _sub(text: Column, start: Column | int, n: Column | int | None = None) -> Column:
    return F.substr(text, *(x if isinstance(x, Column) else F.lit(x) for x in (start, n) if x is not None))


def _left(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _places(text: Column) -> Column:
    return F.sequence(F.lit(1), F.length(text))


def _padded(number: Column, n: int) -> Column:
    return F.lpad(number.cast("string"), n, "0")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string whose last digit counts once."""

    def step(s, i):
        c = _sub(digits, i, 1)
        twice = c.cast("int") * 2 - F.when(c > "4", 9).otherwise(0)
        return s + F.when(F.pmod(F.length(digits) - i, F.lit(2)) == 0, c.cast("int")).otherwise(twice)

    return F.aggregate(_places(digits), F.lit(0), step)


def _mod97(text: Column) -> Column:
    """Of a text of digits and capitals, letters read as 10 to 35."""

    def step(s, i):
        c = _sub(text, i, 1)
        return F.when(c <= "9", (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_places(text), F.lit(0), step)


def _mac(key: bytes, *message: Column) -> Column:
    """HMAC-SHA256 as 64 hexadecimal digits; message: what joins to a string."""
    own = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in own)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.concat(*message).cast("binary")), 256))), 256)


def _shifted(half: Column, other: Column, key: tuple[bytes, str], hexes: bool, r: Column) -> Column:
    """Every character of ``half`` moved within its class by a stream keyed with ``other``; a bijection of ``half`` for any ``other``."""
    stream = _mac(key[0], F.lit(f"{key[1]}:"), r, F.lit(":"), F.lower(other) if hexes else other)

    def moved(z, y):
        c, k = y["c"], y["k"]
        if hexes:  # 16 digits in either case
            digit = _sub(F.lit("0123456789abcdef"), 1 + F.pmod(F.conv(c, 16, 10).cast("int") + k, F.lit(16)), 1)
            return _let(digit, lambda w: F.when(z["h"] == F.upper(z["h"]), F.upper(w)).otherwise(w))
        classes = (("0", "9", 10), ("a", "z", 26), ("A", "Z", 26), ("à", "ö", 23), ("À", "Ö", 23))
        return _cases(*(((c >= a) & (c <= b), F.char(ord(a) + F.pmod(F.ascii(c) - ord(a) + k, F.lit(n)))) for a, b, n in classes)).otherwise(c)

    def inside(z):
        one = lambda i: F.struct(_sub(z["h"], i, 1).alias("c"), F.conv(_sub(z["d"], F.pmod(2 * i, F.lit(62)) + 1, 2), 16, 10).cast("int").alias("k"))
        each = F.transform(_places(z["h"]), lambda i: _let(one(i), lambda y: moved(z, y)))
        return F.when(z["h"] == "", F.lit("")).otherwise(F.array_join(each, ""))

    return _let(F.struct(half.alias("h"), stream.alias("d")), inside)


def _rounds(start: Column, moved: Callable[[Column, Column, Column], Column], finish: Callable[[Column], Column]) -> Column:
    """Alternating Feistel over a pair (a, b); moved: of the half that moves, the other, and the round."""

    def step(f, r):
        odd = r % 2 == 1
        turned = lambda g: F.struct(F.when(odd, g).otherwise(f["a"]).alias("a"), F.when(odd, f["b"]).otherwise(g).alias("b"))
        return _let(moved(F.when(odd, f["a"]).otherwise(f["b"]), F.when(odd, f["b"]).otherwise(f["a"]), r), turned)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, finish)


def _text_feistel(value: Column, key: tuple[bytes, str], hexes: bool = False) -> Column:
    """Over the halves of a string of two or more characters."""
    middle = (F.length(value) / 2).cast("int")
    start = F.struct(_sub(value, 1, middle).alias("a"), _sub(value, middle + 1).alias("b"))
    return _rounds(start, lambda half, other, r: _shifted(half, other, key, hexes, r), lambda f: F.concat(f["a"], f["b"]))


def _number_feistel(a: Column, b: Column, m: int, n: int, key: tuple[bytes, str], finish: Callable[[Column, Column], Column]) -> Column:
    """Over a pair of numbers below m and n; ``finish`` makes a text or date of the two."""

    def moved(half, other, r):
        mac = _mac(key[0], F.lit(f"{key[1]}:"), r, F.lit(":"), other)
        most = F.when(r % 2 == 1, F.lit(m).cast("long")).otherwise(F.lit(n).cast("long"))
        return F.pmod(half + F.conv(_sub(mac, 1, 12), 16, 10).cast("long"), most)

    return _rounds(F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), moved, lambda f: finish(f["a"], f["b"]))


def _into(value: Column, made: Column, replaced: Callable[[Column], Column]) -> Column:
    """``value`` with the characters that are ``replaced`` taken in turn from ``made``, everything else kept."""

    def step(z, i):
        c = _sub(value, i, 1)
        new = F.struct(F.concat(z["t"], _sub(made, z["k"], 1)).alias("t"), (z["k"] + 1).alias("k"))
        return F.when(replaced(c), new).otherwise(F.struct(F.concat(z["t"], c).alias("t"), z["k"].alias("k")))

    return F.aggregate(_places(value), F.struct(F.lit("").alias("t"), F.lit(1).alias("k")), step, lambda z: z["t"])


def _digit(c: Column) -> Column:
    return (c >= "0") & (c <= "9")


def _is_card(d: Column) -> Column:
    return F.length(d).between(13, 19) & (_luhn(d) % 10 == 0) & F.regexp_like(d, F.lit("[^0]"))


def _card_parts(v: Column) -> Column:
    """Of a run of numbers an array of texts that join to it; what is a valid card is a text of its own.

    From left to right a card begins at a number and ends at one: a printed form first, else the
    longest that is valid and that no printed form begins in. One pass with a bounded look ahead.
    """

    def ends(g, i):
        return F.sequence(F.lit(1), F.least(F.lit(19), F.size(g) - i + 1))

    def valid(g, i, n):
        return _let(F.array_join(F.slice(g, i, n), ""), _is_card)

    def printed(g, i):
        return F.coalesce(F.array_max(F.filter(ends(g, i), lambda n: F.regexp_like(F.array_join(F.slice(g, i, n), " "), F.lit(_PRINTED)) & valid(g, i, n))), F.lit(0))

    def taken(g, t, i):
        longest = F.array_max(F.filter(ends(g, i), lambda n: valid(g, i, n) & ~F.exists(F.slice(t, i, n), lambda x: x > 0)))
        return F.when(t[i - 1] > 0, t[i - 1]).otherwise(F.coalesce(longest, F.lit(0)))

    def picks(g, t):
        """(first number, how many) of each card."""

        def step(z, i):
            more = lambda n: F.struct((i + n).alias("free"), F.concat(z["x"], F.array(F.struct(i.alias("i"), n.alias("n")))).alias("x"))
            return F.when(i < z["free"], z).otherwise(_let(taken(g, t, i), lambda n: F.when(n > 0, more(n)).otherwise(z)))

        none = F.array().cast("array<struct<i:int,n:int>>")
        return F.aggregate(F.sequence(F.lit(1), F.size(g)), F.struct(F.lit(1).alias("free"), none.alias("x")), step, lambda z: z["x"])

    def cut(g, p, c):  # p: numbers, each with the separator before it
        text = lambda a, n: F.array_join(F.slice(p, a, n), "")

        def one(e, k):
            before, at = F.when(k == 0, 1).otherwise(c[k - 1]["i"] + c[k - 1]["n"]), e["i"] - 1
            return F.array(text(before, e["i"] - before), F.left(p[at], F.length(p[at]) - F.length(g[at])), F.concat(g[at], text(e["i"] + 1, e["n"] - 1)))

        end = c[F.size(c) - 1]
        return F.when(F.size(c) == 0, F.array(v)).otherwise(F.concat(F.flatten(F.transform(c, one)), F.array(text(end["i"] + end["n"], F.size(p)))))

    def body(g, p):
        return _let(F.transform(F.sequence(F.lit(1), F.size(g)), lambda i: printed(g, i)), lambda t: _let(picks(g, t), lambda c: cut(g, p, c)))

    found = lambda pattern: F.regexp_extract_all(v, F.lit(pattern), F.lit(0))
    return _let(found("[0-9]+"), lambda g: _let(found("[ -]?[0-9]+"), lambda p: body(g, p)))


def _rank(number: Column, block: int) -> Column:
    """Of a number of the plan (first digit 2 to 9, not ending in 11 within its block) its place among those."""
    return (_div(number, 100) - 2) * (block - 1) + number % 100 - F.when(number % 100 > 11, 1).otherwise(0)


def _ranked(place: Column, block: int) -> Column:
    return (2 + _div(place, block - 1)) * 100 + place % (block - 1) + F.when(place % (block - 1) >= 11, 1).otherwise(0)


#: Area codes and exchanges of the North American plan begin with 2 to 9 and don't end in 11; area codes have no 9 in the middle.
_PHONE = "^1?[2-9](?!11)[0-8][0-9][2-9](?!11)[0-9]{2}[0-9]{4}$"
_AREAS, _EXCHANGES = 8 * 89, 8 * 99


def _pseudonym(v: Column, s: Column, key: bytes) -> Column:
    """(t, n) of the candidate ``v``, which ends in the secret ``s``, if that isn't empty: its pseudonym, or ``v`` itself if it isn't valid, and how many values changed.

    Made of functions, not of SQL: as text it is 20 kB, and of that the parser kept 76 MB in the driver.
    """

    def k(kind: str) -> tuple[bytes, str]:
        return key, kind

    def number(text: Column) -> Column:
        return text.cast("int")

    def card(v, d):
        body = F.concat(_left(d, 1), _text_feistel(_sub(d, 2, F.length(d) - 2), k("card")))
        whole = lambda q: F.concat(q, F.pmod(10 - _luhn(F.concat(q, F.lit("0"))), F.lit(10)))
        return F.when(_is_card(d), _let(body, lambda q: _into(v, whole(q), _digit))).otherwise(v)

    def phone(d):
        plan = lambda a, b: F.concat(_ranked(a, 90), _ranked(_div(b, 10000), 100), _padded(b % 10000, 4))
        moved = lambda t: _number_feistel(_rank(number(_left(t, 3)), 90), _rank(number(_sub(t, 4, 3)), 100) * F.lit(10000).cast("long") + number(F.right(t, F.lit(4))), _AREAS, _EXCHANGES * 10000, k("phone"), plan)
        new = _let(F.right(d, F.lit(10)), lambda t: F.concat(F.left(d, F.length(d) - 10), moved(t)))
        return F.when(F.regexp_like(d, F.lit(_PHONE)), _let(new, lambda q: _into(v, q, _digit))).otherwise(v)

    def ssn(d):
        area, group, serial = _left(d, 3), _sub(d, 4, 2), F.right(d, F.lit(4))
        a = number(area) - 1 - F.when(number(area) > 666, 1).otherwise(0)
        b = (number(group) - 1) * F.lit(9999).cast("long") + number(serial) - 1
        parts = lambda a, b: F.concat(_padded(a + 1 + F.when(a >= 665, 1).otherwise(0), 3), _padded(_div(b, 9999) + 1, 2), _padded(b % 9999 + 1, 4))
        given = ~area.isin("000", "666") & (_left(d, 1) != "9") & (group != "00") & (serial != "0000")
        return F.when(given, _let(_number_feistel(a, b, 898, 99 * 9999, k("ssn"), parts), lambda q: _into(v, q, _digit))).otherwise(v)

    def ip(o):
        dotted = lambda a, b: F.concat_ws(".", _div(a, 256), a % 256, _div(b, 256), b % 256)
        moved = _number_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, k("ip"), dotted)
        return F.when(F.forall(o, lambda b: b <= 255), moved).otherwise(v)

    def date(layout):  # one permutation of days for all
        first, (m, n) = F.lit(datetime.date(1900, 1, 1)), _DAY_FACTORS
        moved = lambda day: _number_feistel(_div(day, n), day % n, m, n, k("date"), lambda a, b: F.date_add(first, (a * n + b).cast("int")))
        shown = lambda day: F.when((day >= 0) & (day < _DAYS), F.call_function("date_format", moved(day), layout)).otherwise(v)
        return _let(F.datediff(F.try_to_timestamp(v, layout).cast("date"), first), shown)

    layout = _cases(*((v.contains(mark), F.lit(form)) for mark, form in _DATE_FORMATS.items()))  # by the separator
    at = F.instr(v, "@")
    local, domain = F.left(v, at - 1), _sub(v, at)
    email = F.when(at > 2, F.concat(_text_feistel(local, k("email")), domain)).otherwise(F.concat(_shifted(local, F.lit(""), k("email"), False, F.lit(0)), domain))

    def plain(text):
        return F.replace(text, F.lit(" "), F.lit(""))

    def is_iban(p):
        return F.length(p).between(15, 34) & (_mod97(F.concat(_sub(p, 5), _left(p, 4))) == 1)

    def iban_of(v):
        whole = lambda p, q: F.concat(_left(p, 2), _padded(98 - _mod97(F.concat(q, _left(p, 2), F.lit("0"), F.lit("0"))), 2), q)
        made = lambda p: _let(_text_feistel(_sub(p, 5), k("iban")), lambda q: _let(whole(p, q), lambda y: _into(v, y, lambda c: c != " ")))
        return _let(plain(v), lambda p: F.when(is_iban(p), made(p)).otherwise(v))

    # of a country that isn't known: the longest part up to a space that is valid
    groups = F.split(v, " ")
    parts = F.transform(F.sequence(F.lit(0), F.size(groups) - 1), lambda i: F.array_join(F.slice(groups, F.lit(1), F.size(groups) - i), " "))
    shorter = F.coalesce(F.get(F.filter(parts, lambda w: is_iban(plain(w))), F.lit(0)), F.lit(""))
    iban = _let(shorter, lambda u: F.concat(_let(F.when(u == "", v).otherwise(u), iban_of), F.when(u == "", F.lit("")).otherwise(_sub(v, F.length(u) + 1))))

    # a long secret goes part by part: each step looks at its text once for each character
    def part(m, n, i):
        start, end = _div(i * m, n), _div((i + 1) * m, n)
        return _sub(s, start.cast("int") + 1, (end - start).cast("int"))

    def whole(hexes):
        cut = _let(F.length(s).cast("long"), lambda m: _let(1 + _div(m - 1, _PART), lambda n: F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: part(m, n, i))))
        return F.array_join(F.transform(cut, lambda c: _text_feistel(c, k("secret"), hexes=hexes)), "")

    hexes = F.regexp_like(s, F.lit("^[0-9A-Fa-f]+$")) & ((s == F.upper(s)) | (s == F.lower(s)))
    secret = F.concat(F.left(v, F.length(v) - F.length(s)), F.when(hexes, whole(True)).otherwise(whole(False)))

    def digits(text):
        return F.regexp_replace(text, "[^0-9]", "")

    def like(pattern):
        return F.regexp_like(v, F.lit(pattern))

    shapes = [
        (s != "", lambda d: secret),
        (v.contains("@"), lambda d: email),
        (like("^[A-Z]"), lambda d: iban),
        (like("^[0-9]{1,3}([.][0-9]{1,3}){3}$"), lambda d: _let(F.transform(F.split(v, "[.]"), number), ip)),
        (like("^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}[.][0-9]{2}[.][0-9]{4})$"), lambda d: _let(layout, date)),
        (like("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ssn),
        (like(r"^([+]?1[ .\-]?)?([(][0-9]{3}[)] ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}$"), phone),
    ]
    made = _let(digits(v), lambda d: _cases(*((test, made(d)) for test, made in shapes)))
    other = _let(made, lambda q: F.struct(q.alias("t"), F.when(q != v, 1).otherwise(0).alias("n")))
    joined = lambda x, y: F.struct(F.array_join(y, "").alias("t"), F.size(F.filter(F.zip_with(x, y, lambda a, b: a != b), lambda z: z)).alias("n"))
    cards = _let(_card_parts(v), lambda x: _let(F.transform(x, lambda w: _let(digits(w), lambda d: card(w, d))), lambda y: joined(x, y)))
    return F.when(functools.reduce(operator.or_, (test for test, _ in shapes)), other).otherwise(cards)


@functools.lru_cache(maxsize=2)
def _pseudonyms(context: SparkContext, key: bytes) -> Column:
    """Of the candidates (v, s) in __k. Some thousand calls of functions, so it is made once for a context and key."""
    return F.transform("__k", lambda e: _let(e["v"], lambda v: _let(e["s"], lambda s: _pseudonym(v, s, key))))


def with_pseudonyms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` masked, and __plm_changed, the number of values that were.

    A null text stays null, an empty one empty. What no format validates stays as it is, so
    clean documents come back unchanged. Characters outside ASCII and Latin-1 letters inside
    an address stay in place. The key is a literal of the plan: who may read plans may read it.
    """
    if not key:
        raise ValueError("a key is needed")
    out = docs.withColumn("__m", F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)))
    secrets = F.regexp_extract_all(text, F.lit(_ANY), F.lit(_SECRET))
    out = out.withColumn("__k", F.when(F.size("__m") > 0, F.arrays_zip(F.col("__m").alias("v"), secrets.alias("s"))))
    out = out.withColumn("__q", _pseudonyms(docs.sparkSession.sparkContext, key.encode()))
    pieces = F.split(F.col(text), _ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(pieces, "__q", lambda p, q: F.array(p, F.coalesce(q["t"], F.lit(""))))), "")
    changed = F.when(F.col("__q").isNotNull(), F.aggregate("__q", F.lit(0), lambda a, q: a + q["n"])).otherwise(0)
    return out.withColumns({text: F.when(F.col("__q").isNotNull(), joined).otherwise(F.col(text)), "__plm_changed": changed.cast("long")}).drop("__m", "__k", "__q")


def mask(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with masked texts, and n_chars, if there is such a column, as long as they are. Other columns and repeated rows stay."""
    own = with_pseudonyms(docs, key)
    new = {"n_chars": F.when(F.col("__plm_changed") > 0, F.length("text").cast("long")).otherwise(docs["n_chars"].cast("long"))} if "n_chars" in docs.columns else {}
    return own.select(*(new[c].alias(c) if c in new else own[c] for c in docs.columns))


#: The setting that names the key, and the one that queries and pipeline take where it is not set; that one is public, so its pseudonyms are no secret.
KEY, PUBLIC = "spark.palimpsest.pseudonym.key", "no secret: set spark.palimpsest.pseudonym.key"


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY, None) or PUBLIC


def query(docs: DataFrame) -> DataFrame:
    own = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return with_pseudonyms(own, key_of(docs.sparkSession)).select("doc_id", F.col("__plm_changed").alias("n_masked"), "text")
