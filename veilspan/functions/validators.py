"""Checks of matched values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def one_digit_only(number: Column) -> Column:
    """True for an empty string and for repetitions of a single digit."""
    return F.replace(number, F.substring(number, 1, 1), F.lit("")) == ""


def card(value: Column) -> Column:
    d = digits(value)
    return F.length(d).between(13, 19) & ~one_digit_only(d) & F.call_function("luhn_check", d)


def phone(value: Column) -> Column:
    return F.length(digits(value)).between(7, 15)


def ssn(value: Column) -> Column:
    d = digits(value)
    area, group, serial = F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4)
    return (F.length(d) == 9) & ~one_digit_only(d) & ~area.isin("000", "666") & ~area.startswith("9") & (group != "00") & (serial != "0000")


def mod97(compact: Column) -> Column:
    """The remainder by 97 of a string of digits and capitals, a capital counting 10 to 35."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97)))
    return F.aggregate(F.filter(F.split(compact, ""), lambda c: c != ""), F.lit(0), lambda a, c: step(a, c).cast("int"))


def iban(value: Column) -> Column:
    c = F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")
    return F.length(c).between(15, 34) & c.rlike("^[A-Z]{2}[0-9]{2}") & (mod97(F.concat(F.substr(c, F.lit(5)), F.substring(c, 1, 4))) == 1)


def person(value: Column) -> Column:
    """One to four words, 80 characters at most, each of two or more with a capital first."""
    words = F.filter(F.split(value, r"[\t\n\f\r \x0B]+"), lambda w: w != "")
    plain = F.transform(words, lambda w: F.regexp_replace(w, r"^[.'\-]+|[.'\-]+$", ""))
    return F.size(words).between(1, 4) & (F.length(value) <= 80) & F.forall(plain, lambda w: (F.length(w) >= 2) & w.rlike(r"^\p{Lu}"))


VALID = {"card": card, "phone": phone, "ssn": ssn, "iban": iban, "person": person}
