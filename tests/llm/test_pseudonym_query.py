"""The registered query op2 against a plain Python version of the same Feistel network; odd and very long texts."""

import hashlib
import re
from datetime import date, timedelta
from math import prod

import pytest

from tests.llm.conftest import SCHEMA, frame
from textquarry.llm import pii, registry

KEY = "query-key"
COUNTS = [f"n_{k}" for k in pii.KINDS]


def feistel(a, b, m_a, m_b, tweak):
    for r in range(pii.ROUNDS):
        drawn = lambda x, m: int(hashlib.sha256(f"{KEY}:{tweak}:{r}:{x}".encode()).hexdigest()[:15], 16) % m  # noqa: B023, E731
        if r % 2 == 0:
            a = (a + drawn(b, m_a)) % m_a
        else:
            b = (b + drawn(a, m_b)) % m_b
    return a, b


def digits(d, tweak):
    u = len(d) // 2
    a, b = feistel(int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u), f"{tweak}{len(d)}")
    return f"{a:0{u}d}{b:0{len(d) - u}d}"


def letters(d, tweak):
    number = lambda s: sum((ord(c) - 97) * 26**i for i, c in enumerate(reversed(s)))
    spelled = lambda x, n: "".join(chr(97 + x // 26**i % 26) for i in reversed(range(n)))
    u = len(d) // 2
    a, b = feistel(number(d[:u]), number(d[u:]), 26**u, 26 ** (len(d) - u), f"{tweak}{len(d)}")
    return spelled(a, u) + spelled(b, len(d) - u)


def runs(value, most, permuted, first, size, tweak="email"):
    step = int(hashlib.sha256(f"{KEY}:{tweak}:one:{first}".encode()).hexdigest()[:15], 16) % (size - 1) + 1
    out = ""
    for i, run in enumerate(value[k : k + most] for k in range(0, len(value), most)):
        out += chr((ord(run) - ord(first) + step) % size + ord(first)) if len(run) == 1 else permuted(run, tweak if i == 0 else f"{tweak}/{i}/")
    return out


def refilled(value, fresh, pattern="[0-9]"):
    fresh = iter(fresh)
    return re.sub(pattern, lambda _: next(fresh), value)


def only(pattern, value):
    return "".join(re.findall(pattern, value))


def card(v):
    body = digits(only("[0-9]", v)[:-1], "card")
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
    return refilled(v, body + str(-total % 10))


def remainder(plain):
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def iban(v):
    p = v.replace(" ", "")
    account = refilled(p[8:], runs(only("[A-Z]", p[8:]).lower(), 24, letters, "a", 26, "iban-letters").upper(), "[A-Z]")
    rest = p[4:8] + account
    rest = refilled(rest, digits(only("[0-9]", rest), "iban")) if len(only("[0-9]", rest)) > 1 else rest
    return refilled(v, p[:2] + f"{98 - remainder(p[:2] + '00' + rest):02d}" + rest, "[^ ]")


def ip(v):
    o = v.split(".")

    def kind(x):
        zero = len(x) > 1 and x[0] == "0"
        return {1: (0, 10), 2: (0, 10) if zero else (10, 90), 3: (0, 100) if zero else (100, 156)}[len(x)]

    k = [kind(x) for x in o]
    n = [int(x) - low for x, (low, _) in zip(o, k, strict=True)]
    a, b = feistel(n[0] * k[1][1] + n[1], n[2] * k[3][1] + n[3], k[0][1] * k[1][1], k[2][1] * k[3][1], "ip")
    new = [a // k[1][1], a % k[1][1], b // k[3][1], b % k[3][1]]
    return ".".join(f"{x + low:0{len(t)}d}" for x, (low, _), t in zip(new, k, o, strict=True))


def day(v):
    parts = [int(x) for x in re.split("[-/.]", v)]
    return date(*(parts if "-" in v else parts[::-1]))


def dated(v):
    p, q = pii.DAY_HALVES
    n = (day(v) - date(1800, 1, 1)).days
    a, b = feistel(n // q, n % q, p, q, "date")
    d = date(1800, 1, 1) + timedelta(a * q + b)
    return d.isoformat() if "-" in v else d.strftime("%d/%m/%Y" if "/" in v else "%d.%m.%Y")


def phone(v):
    d = only("[0-9]", v)
    ten = d[-10:]
    low = [2 if ten[i] >= "2" else 0 for i in (0, 3)]
    size = [8 if x else 2 for x in low]
    a, b = feistel(int(ten[:3]) - 100 * low[0], int(ten[3:]) - 1_000_000 * low[1], size[0] * 100, size[1] * 1_000_000, "phone")
    return refilled(v, f"{d[:-10]}{a + 100 * low[0]:03d}{b + 1_000_000 * low[1]:07d}")


def ssn(v):
    areas = [x for x in range(1, 900) if x != 666]
    area, group, serial = (int(x) for x in v.split("-"))
    a, b = feistel(areas.index(area), (group - 1) * 9999 + serial - 1, len(areas), 99 * 9999, "ssn")
    return f"{areas[a]:03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def email(v):
    local, domain = v.split("@")
    local = local.lower()
    local = refilled(local, runs(only("[0-9]", local), 36, digits, "0", 10))
    return refilled(local, runs(only("[a-z]", local), 24, letters, "a", 26), "[a-z]") + "@" + domain


MADE = {"email": email, "iban": iban, "date": dated, "ip": ip, "phone": phone, "card": card, "ssn": ssn}


def kind_of(v):
    for kind in pii.KINDS:
        if re.fullmatch(pii.PATTERNS[kind], v):
            break
    else:
        return None
    if kind == "iban":
        return kind if remainder(v.replace(" ", "")) == 1 else None
    if kind == "date":
        try:
            return kind if 1800 <= day(v).year <= 2199 else None
        except ValueError:
            return None
    if kind == "ip":
        return kind if all(int(x) < 256 for x in v.split(".")) else None
    if kind == "card":
        d = [int(x) for x in only("[0-9]", v)][::-1]
        return kind if sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0 else None
    if kind == "ssn":
        return kind if not re.match("000|666|9|...-00", v) and not v.endswith("0000") else None
    return kind


def found(text, at):
    """The value that begins at this place, with its kind: what the patterns take together, else shorter runs and other kinds."""
    m = re.compile(pii.ANY).match(text, at)
    if not m:
        return None
    if kind_of(m[0]):
        return m[0], kind_of(m[0])
    cut = text[max(0, at - 1) : at + pii.WINDOW] if at else "\n" + text[: pii.WINDOW]
    others = pii.SHORTER_IBANS if re.match("[A-Z]", m[0]) else [pii.PATTERNS["date"], pii.PATTERNS["ip"], pii.PATTERNS["phone"], *pii.SHORTER_CARDS, pii.PATTERNS["ssn"]]
    for p in others:
        n = re.compile(p).match(cut, 1)
        if n and kind_of(n[0]):
            return n[0], kind_of(n[0])
    return None


def pseudonymised(text):
    """Text and counts by brute force: every place in turn."""
    counts = dict.fromkeys(COUNTS, 0)
    out, at = [], 0
    starts = {m.start() for m in re.finditer(f"(?={pii.ANY})", text or "")}
    while text and at < len(text):
        got = found(text, at) if at in starts else None
        if got:
            out.append(MADE[got[1]](got[0]))
            counts[f"n_{got[1]}"] += 1
            at += len(got[0])
        else:
            out.append(text[at])
            at += 1
    return None if text is None else "".join(out), counts


def _check(spark, folder):
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = registry.queries()["op2_pseudonyms"](spark, folder)
    assert rows.columns == ["doc_id", "text", *COUNTS] and [t for _, t in rows.dtypes] == ["bigint", "string"] + ["bigint"] * len(COUNTS)
    seen = rows.collect()
    assert len(seen) == len(given)
    for r in seen:
        text, counts = pseudonymised(given[r["doc_id"]])
        assert r["text"] == text and {c: r[c] for c in COUNTS} == counts, (given[r["doc_id"]], r)
    return seen


def test_query_against_brute_force_on_the_smallest_table(spark):
    assert sum(r["n_card"] + r["n_email"] + r["n_phone"] for r in _check(spark, "/root/testdata/sf0.001"))


def test_query_against_brute_force_on_values_of_all_kinds(spark, tmp_path):
    values = [f"{a:03d}-{g:02d}-{s:04d}" for a, g, s in ((1, 1, 1), (665, 50, 77), (667, 9, 9999), (899, 99, 9999), (123, 45, 6789), (666, 1, 1), (900, 1, 1), (1, 0, 1), (1, 1, 0))]
    values += ["1.2.3.4", "255.255.255.255", "0.0.0.0", "010.01.1.200", "10.99.100.9", "256.1.1.1", "192.168.0.1"]
    values += ["743-555-3824", "(200) 999-0000", "+49 143-055-3824", "+1 (743) 555-3824", "100-200-3000"]
    values += ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR1420041010050500013M02606", "MT84MALT011000012345MTLCAST001S", "DE89370400440532013001"]
    values += ["4111 1111 1111 1111", "378282246310005", "4111111111111111 12/25", "1800-01-01", "31/12/2199", "29.02.1900", "29.02.2000", "Ab.C9@Mail.example.COM", "x@a.b.c", "a@b.c.de-", "q@" + "l." * 300 + "org"]
    rows = [(i, f"v {x}, {x} end", "en", "a", 0) for i, x in enumerate(values)] + [(900, " ".join(values), "en", "a", 0), (901, None, None, None, None), (902, "", "en", "a", 0)]
    frame(spark, [r[:4] for r in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    for r in _check(spark, str(tmp_path)):
        if r["doc_id"] < len(values) and r["n_ssn"]:
            assert all(kind_of(x) == "ssn" for x in re.findall(r"\d{3}-\d\d-\d{4}", r["text"]))


@pytest.mark.parametrize("piece", ["b.", "1-", "1 ", "a@", "A1", "x@b.", "4111-1111-1111-1111 ", "9.9.9.9 "])
def test_a_megabyte_of_one_piece(spark, piece):
    text = "x@" + piece * ((1 << 18) // len(piece))
    out = pii.pseudonymise(spark.createDataFrame([(1, text, "en", "a", 0)], SCHEMA), KEY, ["doc_id"]).first()
    assert len(out["text"]) == len(text)
    if "4111" in piece:
        assert out["n_card"] == text.count("4111-") and "4111-1111-1111-1111" not in out["text"]


def test_pseudonyms_are_one_to_one(spark):
    plain = [f"{a}.{b}.7.7" for a in range(10) for b in range(10, 100)]
    rows = spark.createDataFrame([(i, v, "en", "a", 0) for i, v in enumerate(plain)], SCHEMA)
    out = [r["text"] for r in pii.pseudonymise(rows, KEY, ["doc_id"]).collect()]
    assert len(set(out)) == len(plain) == prod((10, 90))
