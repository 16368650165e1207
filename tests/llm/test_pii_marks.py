"""Values in brackets, at a sentence's end and beside other digits."""

import pytest

from shalegrid.llm import pii

CARD = "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"
FOUND = [
    ("(1912-06-23)", [("1912-06-23", "date")]),
    ("(123-45-6789)", [("123-45-6789", "ssn")]),
    ("(192.168.1.1)", [("192.168.1.1", "ip")]),
    ("(4111 1111 1111 1111)", [("4111 1111 1111 1111", "card")]),
    ("call 555-123-4567. 24 hours", [("555-123-4567", "phone")]),
    ("on 2020-01-05. 3 people", [("2020-01-05", "date")]),
    ("((555) 123-4567)", [("(555) 123-4567", "phone")]),
    ("(10.0.0.1) (1912-06-23), 123-45-6789", [("10.0.0.1", "ip"), ("1912-06-23", "date"), ("123-45-6789", "ssn")]),
    (f"{CARD} 2 3", [(CARD, "card")]),
    ("555 123 4567", [("555 123 4567", "phone")]),
    ("call 5551234567 now", [("5551234567", "phone")]),
    ("00 44 20 7946 0958", [("00 44 20 7946 0958", "phone")]),
    ("0044 20 7946 0958", [("0044 20 7946 0958", "phone")]),
    ("123 45 6789", [("123 45 6789", "ssn")]),
    ("at 2021-01-03T10:00:00", [("2021-01-03", "date")]),
    (f"{'long.' * 40}name@example.com", [(f"{'long.' * 40}name@example.com", "email")]),
    ("\u0661\u0662\u0663-45-6789", []),
]


@pytest.mark.parametrize("text, want", FOUND)
def test_marks_do_not_hide_values(text, want):
    assert [(text[a:b], k) for a, b, k in pii.find(text)] == want
    new, _ = pii.replaced(text, b"k")
    assert all(value not in new for value, _ in want)


def plain_find(text):
    """Every stretch of the text that is a value by its own rule, the longest from the left; without the operator's search."""
    import datetime
    import re

    def is_date(x):
        for form in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y"):
            try:
                return 1900 <= datetime.datetime.strptime(x, form).year < 2100
            except ValueError:
                pass
        return False

    def is_card(x):
        d = [int(c) for c in re.sub("[^0-9]", "", x)]
        return bool(re.fullmatch("[0-9](?:[ -]?[0-9])*", x)) and 13 <= len(d) <= 19 and len(set(d)) > 1 and sum(v if i % 2 == 0 else v // 5 + 2 * v % 10 for i, v in enumerate(reversed(d))) % 10 == 0

    rules = {"email": lambda x: re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.]*@[a-z]+\.com", x), "card": is_card, "date": is_date, "ip": lambda x: re.fullmatch(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", x) and all(str(int(p)) == p and int(p) < 256 for p in x.split(".")), "ssn": lambda x: re.fullmatch("(?!666|000|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", x)}
    out, at = [], 0
    while at < len(text):
        ends = [(e, k) for e in range(len(text), at, -1) for k, rule in rules.items() if (at == 0 or text[at - 1] == " ") and (e == len(text) or text[e] == " ") and rule(text[at:e])]
        if ends:
            out.append((at, *ends[0]))
            at = ends[0][0]
        else:
            at += 1
    return out


def test_against_plain_search():
    import random

    rnd = random.Random(6)
    values = ["4111 1111 1111 1111", "5500000000000004", "123-45-6789", "10.0.0.1", "2020-02-29", "31.12.1999", "2020-02-30", "666-12-3456", "999.1.1.1", "a.b@c.com", "word", "x", "12", "1234567812345678"]
    for _ in range(400):
        text = " and ".join(rnd.choices(values, k=rnd.randint(1, 4)))
        assert pii.find(text) == plain_find(text), text
