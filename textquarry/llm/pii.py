"""Format-preserving pseudonyms of personal data (native).

Matches are validated first (Luhn sum, octet range, IBAN remainder, calendar,
numbers that a social security number cannot have); whatever fails is left as it
is. A valid value is permuted inside its own format by a keyed Feistel network
over two halves of it, so the result is valid again and equal values get equal
pseudonyms in all documents. Check digits are computed anew. Dates are permuted
by day number within 400 years, which is the same in every notation. Octets keep
their number of digits. A phone number has no check beside its notation; its
country code stays, and the first digits of area and exchange stay among 2 to 9
or among 0 and 1, so a number that the plan allows becomes one that it allows.
Of an IBAN the country and the letters of the bank's code stay.

Defined cases: a null text stays null; separators stay in place; the local part
of an e-mail address is written in lower case, as addresses are compared without
case; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.spans import chars, once, scanned

KINDS = ("email", "iban", "date", "ip", "phone", "card", "ssn")
#: One alternative for each of KINDS.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in KINDS)
#: Where a candidate begins, and what stands from there on; candidates other than e-mail addresses have at most 43 characters.
START = f"(?={ANY})"
WINDOW = 48
#: A shorter run of card digits does not end inside what is written as an SSN.
CARD_END = r"(?![0-9]|-[0-9]{2}-[0-9]{4}(?![0-9-])|(?<=\x20[0-9]{3}-[0-9]{2})-[0-9]{4}(?![0-9-]))"
#: What else can begin at the start of a candidate that is not valid: shorter runs first of all, then the other kinds.
SHORTER_IBANS = [r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){%d}%s(?![A-Za-z0-9])" % (g, rf"\x20?[A-Z0-9]{{{t}}}" if t else "") for g in range(7, 1, -1) for t in (3, 2, 1, 0)]
SHORTER_CARDS = [r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){%d}" % (n - 1) + CARD_END for n in range(19, 12, -1)]
ROUNDS = 8
#: 400 years from 1800-01-01, as a product of two numbers near each other.
DAY_HALVES = (189, 773)


def feistel(a: Column, b: Column, m_a: Column, m_b: Column, key: str, tweak: Column) -> Column:
    """struct<a, b>: (a, b) permuted on Z_m_a x Z_m_b by alternating keyed additions."""

    def drawn(r: Column, x: Column, m: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", F.lit(key), tweak, r.cast("string"), x.cast("string")), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), m)

    def step(s: Column, r: Column) -> Column:
        to_a = F.pmod(s["a"] + drawn(r, s["b"], m_a), m_a)
        to_b = F.pmod(s["b"] + drawn(r, s["a"], m_b), m_b)
        even = F.pmod(r, F.lit(2)) == 0
        return F.struct(F.when(even, to_a).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(to_b).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def permuted_digits(digits: Column, key: str, tweak: str | Column) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    m_a, m_b = F.pow(F.lit(10.0), u).cast("long"), F.pow(F.lit(10.0), n - u).cast("long")
    got = feistel(F.substr(digits, F.lit(1), u).cast("long"), F.substr(digits, u + 1).cast("long"), m_a, m_b, key, F.concat(F.lit(tweak), n.cast("string")))
    return F.transform(F.array(got), lambda g: F.concat(F.lpad(g["a"].cast("string"), u, "0"), F.lpad(g["b"].cast("string"), n - u, "0")))[0]


def permuted_letters(letters: Column, key: str, tweak: str | Column) -> Column:
    """A string of 2 to 24 letters a-z, permuted among those of its length."""
    n = F.length(letters)
    u = F.floor(n / 2).cast("int")

    def number(s: Column) -> Column:
        return F.aggregate(chars(s), F.lit(0).cast("long"), lambda acc, c: acc * 26 + F.ascii(c) - 97)

    def spelled(x: Column, size: Column) -> Column:
        state = F.struct(x.alias("x"), F.lit("").alias("s"))
        return F.aggregate(F.sequence(F.lit(1), size), state, lambda t, _: F.struct(F.floor(t["x"] / F.lit(26).cast("decimal(20,0)")).cast("long").alias("x"), F.concat(F.char(F.pmod(t["x"], F.lit(26)) + 97), t["s"]).alias("s")), lambda t: t["s"])

    got = feistel(number(F.substr(letters, F.lit(1), u)), number(F.substr(letters, u + 1)), F.pow(F.lit(26.0), u).cast("long"), F.pow(F.lit(26.0), n - u).cast("long"), key, F.concat(F.lit(tweak), n.cast("string")))
    return F.transform(F.array(got), lambda g: F.concat(spelled(g["a"], u), spelled(g["b"], n - u)))[0]


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refilled(value: Column, fresh: Column, first: str = "0", last: str = "9") -> Column:
    """value with its characters from first to last replaced in turn by those of `fresh`."""
    state = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        mine = c.between(first, last)
        return F.struct((s["at"] + mine.cast("int")).alias("at"), F.concat(s["out"], F.when(mine, F.substr(fresh, s["at"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(chars(value), state, step, lambda s: s["out"])


def respaced(value: Column, plain: Column) -> Column:
    """`plain` with the blanks of value put in."""
    state = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        return F.struct((s["at"] + (c != " ").cast("int")).alias("at"), F.concat(s["out"], F.when(c == " ", c).otherwise(F.substr(plain, s["at"], F.lit(1)))).alias("out"))

    return F.aggregate(chars(value), state, step, lambda s: s["out"])


def luhn_digit(body: Column) -> Column:
    """The check digit that makes body valid."""
    doubled = F.transform(F.reverse(chars(body)), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 0, F.pmod(c.cast("int") * 2, F.lit(10)) + F.when(c.cast("int") > 4, 1).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(10 - F.pmod(F.aggregate(doubled, F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10)).cast("string")


def iban_remainder(plain: Column) -> Column:
    """The remainder by 97 of an IBAN without blanks."""
    moved = chars(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))))

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.when(is_digit, F.pmod(acc * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(moved, F.lit(0), step)


def _card(v: Column, key: str) -> Column:
    return once(digits_of(v), lambda d: once(permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"), lambda body: refilled(v, F.concat(body, luhn_digit(body)))))


def _iban(v: Column, key: str) -> Column:
    """Digits, and letters behind the bank's code, are permuted apart."""
    plain = F.replace(v, F.lit(" "), F.lit(""))

    def made(p: Column) -> Column:
        bank, account = F.substr(p, F.lit(5), F.lit(4)), F.substr(p, F.lit(9))
        letters = F.upper(_in_runs(F.lower(F.regexp_replace(account, "[^A-Z]", "")), 24, _shifted("a", 26, key, "iban-letters"), lambda r, tweak: permuted_letters(r, key, tweak), "iban-letters"))
        rest = F.concat(bank, once(letters, lambda f: refilled(account, f, "A", "Z")))
        fresh = once(rest, lambda r: once(digits_of(r), lambda d: F.when(F.length(d) >= 2, refilled(r, permuted_digits(d, key, "iban"))).otherwise(r)))

        def checked(r: Column) -> Column:
            check = F.lpad((98 - iban_remainder(F.concat(F.substr(p, F.lit(1), F.lit(2)), F.lit("00"), r))).cast("string"), 2, "0")
            return once(F.concat(F.substr(p, F.lit(1), F.lit(2)), check, r), lambda whole: respaced(v, whole))

        return once(fresh, checked)

    return once(plain, made)


def _ip(v: Column, key: str) -> Column:
    """Octets written alike (so many digits, with or without a leading zero) are permuted among each other."""

    def kind(o: Column) -> Column:
        n = F.length(o)
        zero = (n > 1) & o.startswith("0")
        low = F.when(zero | (n == 1), 0).when(n == 2, 10).otherwise(100)
        size = F.when(n == 1, 10).when(zero, F.when(n == 2, 10).otherwise(100)).when(n == 2, 90).otherwise(156)
        return F.struct(low.cast("long").alias("low"), size.cast("long").alias("size"), n.alias("n"), o.cast("long").alias("value"))

    def made(o: Column) -> Column:
        def half(i: int) -> tuple[Column, Column]:
            x, y = o[i], o[i + 1]
            return (x["value"] - x["low"]) * y["size"] + y["value"] - y["low"], x["size"] * y["size"]

        (a, m_a), (b, m_b) = half(0), half(2)

        def spelled(number: Column, of: Column) -> Column:
            return F.lpad((number + of["low"]).cast("string"), of["n"], "0")

        def octets(g: Column) -> Column:
            parts = [(F.floor(g["a"] / o[1]["size"]), o[0]), (F.pmod(g["a"], o[1]["size"]), o[1]), (F.floor(g["b"] / o[3]["size"]), o[2]), (F.pmod(g["b"], o[3]["size"]), o[3])]
            return F.concat_ws(".", *[spelled(x, of) for x, of in parts])

        return once(feistel(a, b, m_a, m_b, key, F.lit("ip")), octets)

    return once(F.transform(F.split(v, r"\."), kind), made)


def _day(v: Column) -> Column:
    """The date that v names, null if it names none or lies outside the 400 years."""
    iso = F.when(F.substr(v, F.lit(5), F.lit(1)) == "-", v).otherwise(F.concat_ws("-", F.substr(v, F.lit(7)), F.substr(v, F.lit(4), F.lit(2)), F.substr(v, F.lit(1), F.lit(2))))
    day = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")
    return F.when(F.year(day).between(1800, 2199), day)


def _date(v: Column, key: str) -> Column:
    p, q = (F.lit(x).cast("long") for x in DAY_HALVES)
    first = F.lit("1800-01-01").cast("date")
    n = F.datediff(_day(v), first).cast("long")
    got = feistel(F.floor(n / q), F.pmod(n, q), p, q, key, F.lit("date"))
    return once(got, lambda g: once(F.date_add(first, (g["a"] * q + g["b"]).cast("int")), lambda d: F.when(F.substr(v, F.lit(5), F.lit(1)) == "-", F.date_format(d, "yyyy-MM-dd")).when(F.substr(v, F.lit(3), F.lit(1)) == "/", F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy"))))


def _phone(v: Column, key: str) -> Column:
    """The last ten digits: area and exchange as (first digit in its class, two digits), then the line."""

    def made(d: Column) -> Column:
        ten = F.substr(d, F.length(d) - 9)

        def coded(at: int) -> tuple[Column, Column, Column]:
            digit = F.substr(ten, F.lit(at), F.lit(1)).cast("long")
            low = F.when(digit >= 2, 2).otherwise(0).cast("long")
            size = F.when(digit >= 2, 8).otherwise(2).cast("long")
            return (digit - low) * 100 + F.substr(ten, F.lit(at + 1), F.lit(2)).cast("long"), size * 100, low * 100

        (area, areas, area_low), (exchange, exchanges, exchange_low) = coded(1), coded(4)
        line = F.substr(ten, F.lit(7)).cast("long")
        got = feistel(area, exchange * 10_000 + line, areas, exchanges * 10_000, key, F.lit("phone"))
        fresh = once(got, lambda g: F.concat(F.lpad((g["a"] + area_low).cast("string"), 3, "0"), F.lpad((g["b"] + exchange_low * 10_000).cast("string"), 7, "0")))
        return once(fresh, lambda f: refilled(v, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), f)))

    return once(digits_of(v), made)


#: A social security number: 898 areas (001 to 899 without 666), groups 01 to 99, serials 0001 to 9999.
SSN_AREAS, SSN_GROUPS, SSN_SERIALS = 898, 99, 9999


def _ssn(v: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        area, group, serial = (F.substr(d, F.lit(at), F.lit(n)).cast("long") for at, n in ((1, 3), (4, 2), (6, 4)))
        place = F.when(area > 666, area - 2).otherwise(area - 1)
        got = feistel(place, (group - 1) * SSN_SERIALS + serial - 1, F.lit(SSN_AREAS).cast("long"), F.lit(SSN_GROUPS * SSN_SERIALS).cast("long"), key, F.lit("ssn"))

        def spelled(g: Column) -> Column:
            parts = [(F.when(g["a"] >= 665, g["a"] + 2).otherwise(g["a"] + 1), 3), (F.floor(g["b"] / SSN_SERIALS) + 1, 2), (F.pmod(g["b"], F.lit(SSN_SERIALS)) + 1, 4)]
            return F.concat(*[F.lpad(x.cast("string"), n, "0") for x, n in parts])

        return once(once(got, spelled), lambda f: refilled(v, f))

    return once(digits_of(v), made)


def _in_runs(value: Column, most: int, one, permuted, tweak: str = "email") -> Column:
    """value in runs of `most` characters, each permuted among those of its length; a single character is shifted by a keyed step, never by none."""
    runs = F.regexp_extract_all(value, F.lit(f".{{1,{most}}}"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r, i: F.when(F.length(r) == 1, one(r)).otherwise(permuted(r, F.when(i == 0, tweak).otherwise(F.concat(F.lit(f"{tweak}/"), i.cast("string"), F.lit("/")))))), "")


def _shifted(first: str, size: int, key: str, tweak: str = "email"):
    """A function that moves one character among the `size` from `first` on by a step of 1 to size - 1."""
    step = F.pmod(F.conv(F.substring(F.sha2(F.lit(f"{key}:{tweak}:one:{first}"), 256), 1, 15), 16, 10).cast("long"), F.lit(size - 1)) + 1
    return lambda c: F.char(F.pmod(F.ascii(c) - ord(first) + step, F.lit(size)) + ord(first))


def _email(v: Column, key: str) -> Column:
    """Letters and digits of the local part, in lower case, are permuted apart, in runs of 24 and 36; a run of one joins a fixed keyed shift."""
    low = F.lower(F.substring_index(v, "@", 1))

    letters = _in_runs(F.regexp_replace(low, "[^a-z]", ""), 24, _shifted("a", 26, key), lambda r, tweak: permuted_letters(r, key, tweak))
    digits = _in_runs(digits_of(low), 36, _shifted("0", 10, key), lambda r, tweak: permuted_digits(r, key, tweak))
    with_digits = once(digits, lambda d: refilled(low, d))
    return F.concat(once(letters, lambda f: refilled(with_digits, f, "a", "z")), F.lit("@"), F.substring_index(v, "@", -1))


def kind_of(v: Column) -> Column:
    """The kind that v is valid as, null if none."""
    def is_a(k: str) -> Column:
        return v.rlike("^(?:" + PATTERNS[k] + r")\z")

    octets = F.forall(F.split(v, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(999)) <= 255)
    ssn_ok = ~v.rlike(r"^(?:000|666|9)") & ~v.rlike(r"^...-00") & ~v.rlike(r"0000\z")
    return (
        F.when(is_a("email"), "email")
        .when(is_a("iban") & (iban_remainder(F.replace(v, F.lit(" "), F.lit(""))) == 1), "iban")
        .when(is_a("date"), F.when(_day(v).isNotNull(), "date"))
        .when(is_a("ip"), F.when(octets, "ip"))
        .when(is_a("phone"), "phone")
        .when(is_a("card"), F.when(F.call_function("luhn_check", digits_of(v)), "card"))
        .when(is_a("ssn"), F.when(ssn_ok, "ssn"))
    )


def pseudonym(v: Column, kind: Column, key: str) -> Column:
    out = v
    for name, made in (("email", _email), ("iban", _iban), ("date", _date), ("ip", _ip), ("phone", _phone), ("card", _card), ("ssn", _ssn)):
        out = F.when(kind == name, made(v, key)).otherwise(out)
    return out


def _first_valid(around: Column, patterns: list[str]) -> Column:
    """The first valid value, with its kind, that one of the patterns finds behind the first character of `around`."""
    tried = F.array(*[F.regexp_extract(around, rf"(?s)\A.({p})", 1) for p in patterns])
    typed = F.transform(tried, lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    return F.get(F.filter(typed, lambda t: t["kind"].isNotNull()), F.lit(0))


def found_at_starts(text: Column) -> Column:
    """array<struct<value, kind>>: the text in pieces, valid values with their kind and all between them with none.

    Every place where a candidate can begin is looked at, those inside a candidate that
    is not valid too; of values that overlap the one that begins first counts.
    """
    pieces = F.split(text, START, -1)
    greedy = F.regexp_extract_all(text, F.lit(f"(?=({ANY}))"), F.lit(1))
    windows = F.regexp_extract_all(text, F.lit(rf"(?s)(?={ANY})(?=(.{{1,{WINDOW}}}))"), F.lit(1))

    def placed(pieces: Column, starts: Column) -> Column:
        before = F.size(pieces) - F.size(starts)  # 1 if the text does not begin with a candidate

        def best(s: Column, i: Column) -> Column:
            around = F.concat(F.coalesce(F.right(F.get(pieces, i + before - 1), F.lit(1)), F.lit("\n")), s["window"])
            others = F.when(s["window"].rlike("^[A-Z]"), _first_valid(around, SHORTER_IBANS)).otherwise(_first_valid(around, [PATTERNS["date"], PATTERNS["ip"], PATTERNS["phone"], *SHORTER_CARDS, PATTERNS["ssn"]]))
            kind = kind_of(s["value"])
            got = once(kind, lambda k: F.when(k.isNotNull(), F.struct(s["value"].alias("value"), k.alias("kind"))).otherwise(others))
            return F.struct(F.get(pieces, i + before).alias("piece"), got.alias("got"))

        head = F.when(before > 0, F.get(pieces, F.lit(0))).otherwise(F.lit(""))
        kind = "struct<value:string,kind:string>"

        def literal(v: Column) -> Column:
            return F.struct(v.alias("value"), F.lit(None).cast("string").alias("kind"))

        def step(left: Column, p: Column) -> tuple[Column, Column]:
            taken = (left <= 0) & p["got"].isNotNull()
            over = F.when(taken, F.length(p["got"]["value"])).otherwise(F.greatest(left, F.lit(0)))
            rest = literal(F.substr(p["piece"], over + 1))
            out = F.when(taken, F.array(F.struct(p["got"]["value"].alias("value"), p["got"]["kind"].alias("kind")), rest)).otherwise(F.array(rest))
            return (over - F.length(p["piece"])).cast("int"), out

        found = F.flatten(scanned(F.transform(starts, best), F.lit(0), step, f"array<{kind}>"))
        return F.concat(F.array(literal(head)), found)

    starts = F.arrays_zip(greedy.alias("value"), windows.alias("window"))
    return once(pieces, lambda p: once(starts, lambda s: placed(p, s)))


def pseudonymise(docs: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """The columns `keep`, the new text, and one count n_<kind> for each kind."""
    text = F.col("__text")
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    empty = F.expr("cast(array() as array<struct<value:string,kind:string>>)")
    rows = rows.withColumn("__found", F.when(text.rlike(ANY), found_at_starts(text)).otherwise(empty))
    fresh = F.transform("__found", lambda f: F.when(f["kind"].isNull(), f["value"]).otherwise(pseudonym(f["value"], f["kind"], key)))

    def found_of(kind: str) -> Column:
        return F.size(F.filter("__found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [found_of(k) for k in KINDS]
    return rows.select(*keep, F.when(F.size("__found") > 0, F.array_join(fresh, "")).otherwise(text).alias("text"), *counts)
