from __future__ import annotations

import hashlib
import random
import re

import pytest

from tests.llm.tables import multiset
from yieldloom.llm import pii, queries


def brute_luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, digits[::-1])):
        d = d * 2 if i % 2 else d
        total += d // 10 + d % 10
    return total % 10 == 0


def brute(text: str | None) -> list[tuple]:
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and brute_luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_against_brute_force(spark, folder, records):
    got = queries.op10_personal_data(spark, folder).collect()
    want = []
    for doc_id, text, _ in records:
        spans = brute(text)
        counts = [sum(s[0] == k for s in spans) for k in pii.BASE]
        want.append((doc_id, *counts, hashlib.sha256(joined(spans).encode()).hexdigest()))
    assert multiset(tuple(r)[:6] for r in got) == multiset(want)
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert [s.split(":")[0] for s in spans[113].split(",")] == ["email", "ip", "card", "phone"]
    assert [s.split(":")[0] for s in spans[115].split(",")] == ["iban", "phone_local"]


def test_random_texts_against_brute_force():
    rng = random.Random(10)
    stock = ["@", ".", "a", "b-c", "%", "+", "1", "23", "255", "256", "0007", " ", "-", "(", ")", "é", "\n",
             "4111111111111111", "4111 1111-1111 1111", "x@y.z", "+1 (266) 555-7228", "1.2.3.4", "٣"]
    for _ in range(4000):
        text = "".join(rng.choices(stock, k=rng.randint(0, 20)))
        got = [(s.kind, s.start, s.end) for s in pii.personal_data(text) if s.base]
        assert got == brute(text), repr(text)


def test_long_runs_take_linear_time():
    text = "a" * 300_000 + " " + "1" * 300_000 + " " + "b." * 100_000 + "@" * 1000
    assert [s for s in pii.personal_data(text) if s.base] == []


@pytest.mark.parametrize(("text", "kinds"), [
    ("GB82 WEST 1234 5698 7654 32", ["iban"]),
    ("GB83 WEST 1234 5698 7654 32", []),
    ("amex card 378282246310005 thanks", ["card_short"]),
    ("number 378282246310005 thanks", []),
    ("ssn 078-05-1120", ["ssn"]),
    ("part 078-05-1120", []),
    ("tel. (555) 123-4567", ["phone_local"]),
    ("order phone 555 123 4567", []),
])
def test_context_and_checksums(text, kinds):
    assert [s.kind for s in pii.personal_data(text)] == kinds


@pytest.mark.parametrize(("text", "codes"), [
    ("AT61 1904 3002 3457 3201 BIC X", ["AT61 1904 3002 3457 3201"]),
    ("AT611904300234573201 EUR 500", ["AT611904300234573201"]),
    ("ES9121000418450200051332 BANK x", ["ES9121000418450200051332"]),
    ("IBAN BE68 5390 0754 7034 2024", ["BE68 5390 0754 7034"]),
    ("AT611904300234573201 INTERNATIONALE", ["AT611904300234573201"]),
    ("AT61 1904 3002 3457 3201 BE68 5390 0754 7034", ["AT61 1904 3002 3457 3201", "BE68 5390 0754 7034"]),
    ("AB12 CODE USED AT61 1904 3002 3457 3201", ["AT61 1904 3002 3457 3201"]),
    ("AT62 1904 3002 3457 3201 BIC X", []),
    ("DE89 3704 0044 0532 0130 00 BIC", ["DE89 3704 0044 0532 0130 00"]),
    ("Invoice: DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"]),
    ("Order 5 DE89370400440532013000", ["DE89370400440532013000"]),
])
def test_account_numbers_before_other_words(text, codes):
    assert [text[s.start : s.end] for s in pii.personal_data(text) if s.kind == "iban"] == codes


def test_empty_table(spark, empty):
    assert queries.op10_personal_data(spark, empty).collect() == []
