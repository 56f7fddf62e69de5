import random
import re
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arcframe.llm import pii

from .data import ODD_TEXTS, documents

CIPHER = pii.Feistel(b"a key")


@pytest.mark.parametrize("size", [1, 2, 3, 10, 26, 100, 997])
def test_permutations(size):
    got = [CIPHER.permute(v, size, "t") for v in range(size)]
    assert sorted(got) == list(range(size))
    assert [CIPHER.permute(v, size, "t", back=True) for v in got] == list(range(size))
    even = [CIPHER.permute(v, size, "t", lambda n: n % 2 == 0) for v in range(0, size, 2)]
    assert sorted(even) == list(range(0, size, 2))


def card(n, rng):
    body = "4" + "".join(rng.choices("0123456789", k=n - 2))
    return body + str(pii.luhn(body))


def iban(rng):
    account = "".join(rng.choices("0123456789", k=18))
    return f"DE{98 - pii.iban_remainder('DE00' + account):02}{account}"


def values(rng):
    c = card(16, rng)
    b = iban(rng)
    yield "card", [c, f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}"]
    yield "iban", [b, " ".join(b[i : i + 4] for i in range(0, 22, 4))]
    p = f"{rng.randrange(200, 1000)}{rng.randrange(200, 1000)}{rng.randrange(10**4):04}"
    yield "phone", [f"+1 ({p[:3]}) {p[3:6]}-{p[6:]}", f"{p[:3]}-{p[3:6]}-{p[6:]}", f"({p[:3]}) {p[3:6]}-{p[6:]}"]
    yield "ip", [f"{rng.randrange(11, 100)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}"]
    yield "ssn", [f"{rng.randrange(1, 666):03}-{rng.randrange(1, 100):02}-{rng.randrange(1, 10**4):04}"]
    d = date.fromordinal(rng.randrange(pii.FIRST_DAY, pii.LAST_DAY))
    yield "date", [d.strftime("%Y-%m-%d"), d.strftime("%d.%m.%Y"), d.strftime("%m/%d/%Y"), d.strftime("%Y/%m/%d")]
    yield "email", [f"{''.join(rng.choices('abcdefgh', k=9))}.{rng.randrange(10, 100)}@mail{rng.randrange(9)}.example.com"]


def test_values_stay_valid_linked_and_reversible():
    rng = random.Random(6)
    seen = {}
    for _ in range(150):
        for kind, forms in values(rng):
            fresh = [pii.pseudonym(kind, f, CIPHER) for f in forms]
            for f, p in zip(forms, fresh, strict=True):
                assert p != f and re.sub("[0-9]", "9", re.sub("[a-z]", "a", p)) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", f)) or kind == "ip"
                assert pii.pseudonym(kind, p, CIPHER, back=True) == f, (kind, f, p)
                assert [(k, f"x {p}."[a:b]) for a, b, k in pii.candidates(f"x {p}.")] == [(kind, p)]  # still found, as the same kind
            if kind not in ("date", "email", "ip"):
                plain = [re.sub("[^0-9A-Z]", "", p)[-10 if kind == "phone" else None :] for p in fresh]
                assert len(set(plain)) == 1
            if kind == "date":
                assert len({pii._fields(p)[1] for p, f in zip(fresh, forms, strict=True)}) == 1
            assert seen.setdefault((kind, fresh[0]), forms[0]) == forms[0]


@pytest.mark.parametrize("text", ["4242424242424243", "1234567890123", "0000000000000", "127.0.0.1", "0.1.2.3", "224.0.0.1", "256.1.1.1", "1.2.3", "2.0.", "666-12-3456", "000-12-3456", "123-00-4567", "2021-02-30", "31.04.2020", "99/99/2020", "1234", "c1f80f127674f6764aed23d9333c5f5659a6d986", "DE00123456789012345678", "a@b", "@x.com", "12 34 56", "3.14159265358979", "v1.2.3.4.5", "http://a.b/2020", "x4242424242424242", "1,234,567.89", "ISBN 978-3-16-148410-0"])
def test_what_isnt_valid_stays(text):
    for t in (text, f"see {text} here", f"({text})"):
        assert pii.pseudonymize(t, CIPHER)[0] == t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["+1 (269) 555-3296", "4524132264652876", "a.b@c.de", "8.8.8.8", "2020-01-05", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "123-45-6789", " ", "\n", "x", "é", ",", "12", "@", "+", "("]), max_size=8))
def test_counts_and_the_rest_of_the_text(parts):
    text = "".join(parts)
    fresh, counts = pii.pseudonymize(text, CIPHER)
    assert (fresh == text) == (sum(counts.values()) == 0)
    assert re.sub("[0-9A-Za-z.]", "", fresh) == re.sub("[0-9A-Za-z.]", "", text)


@pytest.mark.parametrize("address", ["10.1.2.3", "192.168.77.9", "172.20.0.5", "100.64.1.1"])
def test_private_addresses_stay_in_their_block(address):
    fresh = pii.pseudonym("ip", address, CIPHER)
    number = lambda a: int.from_bytes(bytes(map(int, a.split("."))), "big")
    assert fresh != address and pii._inside(number(fresh), pii.PRIVATE) == pii._inside(number(address), pii.PRIVATE)
    assert pii.pseudonym("ip", fresh, CIPHER, back=True) == address


def test_ibans_end_before_words():
    text = "to DE89 3704 0044 0532 0130 00 AND MORE"
    fresh, counts = pii.pseudonymize(text, CIPHER)
    assert counts["iban"] == 1 and fresh.endswith(" AND MORE") and pii.iban_remainder(fresh[3:30].replace(" ", "")[:22]) == 1


def test_query_rows(spark):
    texts = [*ODD_TEXTS, "call +1 (834) 555-4560 or iork.24@mail7.example.com", "pay 4524132264652876", "pay 4524 1322 6465 2876 from 57.14.248.132", "a" * 10_000 + " 123-45-6789 " + "b" * 10_000]
    rows = {r.doc_id: r for r in pii.pseudonymize_documents(documents(spark, texts), b"a key").collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = (None, None) if t is None else pii.pseudonymize(t, CIPHER)
        assert rows[i].text == want[0] and rows[i].changed == (t is not None and want[0] != t)
        assert t is None or all(rows[i][f"n_{k}"] == n for k, n in want[1].items())
    n = len(ODD_TEXTS)
    assert [rows[i].changed for i in range(n)] == [False] * n and all(rows[i].changed for i in range(n, n + 4))
    assert rows[n + 1].text.split()[1] == rows[n + 2].text[4:23].replace(" ", "")
    other = {r.doc_id: r.text for r in pii.pseudonymize_documents(documents(spark, texts), b"another key").collect()}
    assert other[n + 1] != rows[n + 1].text


def test_odd_tables(spark):
    assert pii.pseudonymize_documents(documents(spark, []), b"k").count() == 0
    assert pii.pseudonymize_documents(documents(spark, ["8.8.8.8"] * 2, [None, None]), b"k").distinct().count() == 1


CARD, IBAN = "4111 1111 1111 1111", "BE68539007547034"


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        (f"{IBAN} {CARD}", ["iban", "card"]),
        ("BE68 5390 0754 7034 555-123-4567", ["iban", "phone"]),
        (f"ID42 {CARD}", ["card"]),
        (f"1234 {CARD}", ["card"]),
        ("BE68 5390 0754 7034 Is paid", ["iban"]),
        ("at 2021-03-04T10:00", ["date"]),
        (f"{IBAN} 2021-03-04T10:00Z {CARD}", ["iban", "date", "card"]),
    ],
)
def test_invalid_and_long_matches_hide_nothing(text, kinds):
    fresh, counts = pii.pseudonymize(text, CIPHER)
    assert [k for k in pii.KINDS if counts[k]] == sorted(kinds, key=pii.KINDS.index) and sum(counts.values()) == len(kinds)
    assert all(value not in fresh for value in (CARD, IBAN, "5390 0754 7034", "555-123-4567", "2021-03-04"))
    assert len(fresh) == len(text)


def test_a_date_before_a_word_is_none():
    for text in ("2021-03-04Tuesday", "2021-03-04x", "04-03-2021T10:00", "2021-03-04T"):
        assert pii.pseudonymize(text, CIPHER)[0] == text


@pytest.mark.parametrize(
    "forms",
    [
        ("+358 40 123 4567", "+358401234567", "+358-40-123-4567"),
        ("+44 20 7946 0958", "+442079460958", "+44 (20) 7946 0958"),
        ("+7 495 123 4567", "+74951234567"),
        ("+1 555 234 5678", "(555) 234-5678", "555.234.5678"),
        ("4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"),
        ("BE68 5390 0754 7034", "BE68539007547034"),
    ],
)
def test_one_number_in_any_punctuation_has_one_pseudonym(forms):
    fresh = [pii.pseudonymize(f"see {f} there", CIPHER)[0][4:-6] for f in forms]
    plain = {re.sub("[^0-9A-Z]", "", f)[-10:] for f in fresh}
    assert len(plain) == 1 and not plain & {re.sub("[^0-9A-Z]", "", f)[-10:] for f in forms}
    assert [re.sub("[0-9A-Z]", "x", f) for f in fresh] == [re.sub("[0-9A-Z]", "x", f) for f in forms]
    code = pii.calling_code(pii.digits(forms[0]))
    assert not forms[0].startswith("+") or fresh[0].startswith("+" + code)


def test_one_day_in_any_form_has_one_pseudonym():
    day = date(1999, 1, 1)
    while day < date(2000, 12, 31):
        y, m, d = f"{day.year:04}", f"{day.month:02}", f"{day.day:02}"
        forms = [f"{y}-{m}-{d}", f"{y}/{m}/{d}", f"{m}/{d}/{y}", f"{d}.{m}.{y}", f"{d}-{m}-{y}"]
        # what could be read either way is read one way; the other order is only for days after the 12th
        forms += [f"{d}/{m}/{y}", f"{m}.{d}.{y}", f"{m}-{d}-{y}"] if day.day > 12 else []
        fresh = [pii.pseudonym("date", f, CIPHER) for f in forms]
        assert len({pii._fields(f)[1] for f in fresh}) == 1 and pii._fields(fresh[0])[1] != day or day == pii._fields(fresh[0])[1]
        assert [pii.pseudonym("date", f, CIPHER, back=True) for f in fresh] == forms
        day += timedelta(days=11)


def test_long_local_parts_are_no_addresses():
    for local, fits in (("ab.cd" * 12, True), ("x" * 64, True), ("x" * 65, False), ("ab.cd" * 400, False)):
        text = f"to {local}@mail.example.com now"
        fresh, counts = pii.pseudonymize(text, CIPHER)
        assert (counts["email"] == 1 and local not in fresh) if fits else fresh == text


# --- values found by trying every stretch of a text, one rule a kind, written apart from the operator's patterns


def brute_valid(kind, t):
    d = [int(c) for c in t if c.isdigit()]
    if kind == "card":
        total = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d)))
        return len(d) == 16 and total % 10 == 0 and len(set(d)) > 1 and (t.isdigit() or (len(t) == 19 and {t[4], t[9], t[14]} in ({" "}, {"-"}) and all(c.isdigit() for c in t[:4] + t[5:9] + t[10:14] + t[15:])))
    if kind == "ssn":
        return len(t) == 11 and t[3] == t[6] == "-" and len(d) == 9 and 0 < int(t[:3]) < 900 and t[:3] != "666" and t[4:6] != "00" and t[7:] != "0000"
    if kind == "date":
        if len(t) != 10 or t[4] != "-" or t[7] != "-" or len(d) != 8:
            return False
        try:
            return 1900 <= date(int(t[:4]), int(t[5:7]), int(t[8:])).year <= 2099
        except ValueError:
            return False
    if kind == "ip":
        parts = t.split(".")
        return len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) < 256 for p in parts) and int(parts[0]) not in (0, 127) and int(parts[0]) < 224 and parts[:2] != ["169", "254"]
    return False


def brute_values(text):
    """(start, end) of all stretches that are a value and stand alone, those at the left first."""
    out, at = [], 0
    while at < len(text):
        ends = [e for e in range(at + 7, min(len(text), at + 20) + 1) if any(brute_valid(k, text[at:e]) for k in ("card", "ssn", "date", "ip"))]
        ends = [e for e in ends if (at == 0 or text[at - 1] in " ;") and (e == len(text) or text[e] in " ;")]
        if ends:
            out.append((at, ends[-1]))
            at = ends[-1]
        else:
            at += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1112", "4524132264652876", "123-45-6789", "666-45-6789", "000-45-6789", "2021-02-28", "2021-02-30", "1850-01-01", "57.14.248.132", "257.1.1.1", "127.0.0.1", "10.20.30.40", "word", "77"]), max_size=8))
def test_values_are_those_that_trying_every_stretch_finds(values):
    text = " ; ".join(values)
    fresh, counts = pii.pseudonymize(text, CIPHER)
    found = brute_values(text)
    inside = {i for a, b in found for i in range(a, b)}
    if not any("." in v for v in values):  # pseudonyms of addresses may have another length
        assert len(fresh) == len(text) and all(x == y for i, (x, y) in enumerate(zip(text, fresh, strict=True)) if i not in inside)
    assert sum(counts.values()) == len(found)
