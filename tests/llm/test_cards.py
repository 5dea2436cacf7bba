"""Cards and IBANs with other numbers and words beside them."""

from __future__ import annotations

import re

import pytest
from test_operators import luhn, masked

CARD, SPACED, AMEX = "4111111111111111", "4111 1111 1111 1111", "3782 822463 10005"


@pytest.fixture(scope="module")
def alone(spark):
    return {x: t for x, (_, t) in zip((CARD, SPACED, AMEX), masked(spark, CARD, SPACED, AMEX))}


def test_cards_with_neighbours(spark, alone):
    """Each in the place of {}; what stands beside it stays."""
    forms = ["{} 03/27", "{} 123", "2 {}", "12345 {}", "{} 03-27", "no 77 {} 737 x", "1 2 3 {} 4 5 6", "{} 2027 12", "{}\n12"]
    values = [(f, c) for f in forms for c in alone]
    for (f, c), (n, t) in zip(values, masked(spark, *(f.format(c) for f, c in values))):
        assert (n, t) == (1, f.format(alone[c]))
    assert all(luhn(re.sub(r"\D", "", t)) and t != c for c, t in alone.items())


def test_values_next_to_cards_are_found(spark, alone):
    rows = [f"{SPACED} {AMEX}", f"{SPACED} 2024-02-29", f"{SPACED} 413 555-3797", f"{SPACED} 123-45-6789", f"{SPACED} 10.0.0.1", f"{SPACED} 5bob@example.com", f"{CARD} {CARD} {CARD}"]
    for row, (n, t) in zip(rows, masked(spark, *rows)):
        assert n == (3 if row.startswith(CARD) else 2) and t.startswith(alone[CARD if row.startswith(CARD) else SPACED])
    assert masked(spark, "4111 1111 1111 1112 03/27", "1000 2000 3000 4000 7")[0][0] == 0


def test_ibans_with_words_behind(spark):
    plain = [t for _, t in masked(spark, "BE68 5390 0754 7034", "BE68539007547034", "DE89 3704 0044 0532 0130 00")]
    for own, t in zip(("BE68 5390 0754 7034", "BE68539007547034", "DE89 3704 0044 0532 0130 00"), plain):
        assert own != t
        for word in ("EUR", "PAID", "A", "IBAN BIC"):
            assert masked(spark, f"{own} {word}") == [(1, f"{t} {word}")]
    (n, t), = masked(spark, f"BE68 5390 0754 7034 {SPACED}")
    assert n == 2 and t.startswith(plain[0])
