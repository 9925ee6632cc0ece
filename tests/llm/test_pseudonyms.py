"""Permutations are one to one and keep formats; values outside the formats stay."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from text_tables import table

from tidemark.llm.pseudonyms import Feistel, Pseudonyms, luhn_digit, pseudonymise

NAMES, BACK = Pseudonyms(b"key"), Pseudonyms(b"key", inverse=True)


@given(st.integers(1, 3000), st.text(max_size=5))
@settings(max_examples=60, deadline=None)
def test_permutation(size, tag):
    feistel = Feistel(b"k")
    image = [feistel.permute(i, size, tag) for i in range(size)]
    assert sorted(image) == list(range(size))
    assert [feistel.permute(i, size, tag, inverse=True) for i in image] == list(range(size))


VALUES = [
    "4111 1111 1111 1111", "5500005555555559", "GB82 WEST 1234 5698 7654 32", "2024-02-29", "31.12.1999", "12/31/1999", "123-45-6789",
    "+1 (319) 555-5132", "415-555-0123", "192.0.2.17", "first.last-7@mail.example.org", "ünal.7@example.de", "A1.b2@x.io",
]


@pytest.mark.parametrize("value", VALUES)
def test_round_trip_and_format(value):
    text = f"x {value} y, again {value}."
    other, spans = NAMES.rewrite(text)
    assert len(spans) == 2 and value not in other
    assert len(other) == len(text) or spans[0][0] == "ip"  # an address's numbers have one to three digits
    assert [text[s : s + n] for _, s, n in spans] == [value, value]
    assert other[2 : other.index(" y,")] == other[other.index("again ") + 6 : -1]
    assert BACK.rewrite(other)[0] == text
    assert NAMES.rewrite(f"({value})")[0].strip("()") == other[2 : other.index(" y,")]


def test_dates_without_leading_zeros():
    """The date is permuted; single digits are written only where the other date has them."""
    assert NAMES.rewrite("1/5/2001")[0] == "/".join(p.lstrip("0") for p in NAMES.rewrite("01/05/2001")[0].split("/"))


def test_secrets_and_keys():
    text = 'api_key: "0123456789abcdef0123" token = \'Zz9-Yy8_Xx7\''
    other, spans = NAMES.rewrite(text)
    assert [k for k, _, _ in spans] == ["secret", "secret"] and BACK.rewrite(other)[0] == text
    assert Pseudonyms(b"another").rewrite(text)[0] != other


@pytest.mark.parametrize("text", ["4111 1111 1111 1112", "2390409500648961", "2023-02-29", "999.1.1.1", "1.2.3", "000-12-3456", "v1.2.3.4.5", "GB83 WEST 1234 5698 7654 32", "plain words", "a@b", "0000000000000000"])
def test_left_alone(text):
    assert NAMES.rewrite(text) == (text, [])


FOLLOWED = [
    ("4111 1111 1111 1111", " 12/26"), ("4111111111111111", " 123"), ("4111 1111 1111 1111", "-123"), ("BE68 5390 0754 7034", " EUR"), ("AT61 1904 3002 3457 3201", " BIC"),
    ("BE68539007547034", " EURO PAID 17"), ("5500005555555559", " 12"),
]


@pytest.mark.parametrize("value,rest", FOLLOWED)
def test_what_follows_a_value_does_not_hide_it(value, rest):
    text = f"x {value}{rest}, y"
    other, spans = NAMES.rewrite(text)
    assert [(s, n) for _, s, n in spans] == [(2, len(value))] and value not in other and other.endswith(f"{rest}, y")
    assert other[2 : 2 + len(value)] == NAMES.rewrite(value)[0]
    assert BACK.rewrite(other)[0] == text


def test_values_in_a_row():
    text = "BE68 5390 0754 7034 EUR 4111 1111 1111 1111 5500 0055 5555 5559 GB83 WEST 1234 5698 7654 32 4111111111111111 123"
    other, spans = NAMES.rewrite(text)
    assert [k for k, _, _ in spans] == ["iban", "card", "card", "card"] and BACK.rewrite(other)[0] == text


@given(st.integers(10**14, 10**15 - 1), st.integers(0, 999))
@settings(max_examples=300, deadline=None)
def test_followed_cards_and_long_ones_are_invertible(body, code):
    card = str(body) + luhn_digit(str(body))
    grouped = " ".join(card[i : i + 4] for i in range(0, 16, 4))
    long = f"{body:015d}{code:03d}"
    long += luhn_digit(long)
    for text in (f"{grouped} {code:03d}", f"{card}-{code}", " ".join([*(long[i : i + 4] for i in range(0, 16, 4)), long[16:]])):
        assert BACK.rewrite(NAMES.rewrite(text)[0])[0] == text


@given(st.integers(10**14, 10**15 - 1))
@settings(max_examples=100, deadline=None)
def test_cards_stay_valid(body):
    card = str(body) + luhn_digit(str(body))
    digits = NAMES.rewrite(card)[0]
    assert luhn_digit(digits[:-1]) == digits[-1] and len(digits) == 16


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "no values"), (4, "mail a.b@c.de"), (4, "mail a.b@c.de"), (None, "ip 10.0.0.1"), (5, "10.0.0.1 " * 30000)]
    got = pseudonymise(table(spark, rows, ["spans", "id"]), b"key").collect()
    assert len(got) == len(rows)
    by_id = {r["id"]: r for r in got}
    assert by_id[1]["text"] is None and by_id[2]["text"] == "" and by_id[3]["text"] == "no values"
    assert by_id[5]["n_values"] == 30000 and by_id[None]["text"][3:] == by_id[5]["text"].split()[0]
    assert pseudonymise(table(spark, []), b"key").count() == 0
