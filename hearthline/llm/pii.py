"""Personal data: patterns propose, checksums confirm, words nearby tip the scale."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.spans import matches, ordered

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

# The forms proposed. Repetitions that can never give characters back
# are possessive, and starts inside of a longer run are left out, so that a search
# takes time in proportion to the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

# How long the account numbers (IBAN) of each country are.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _account_form(lengths: Mapping[int, str] = IBAN_LENGTHS) -> str:
    """Account numbers, spaces anywhere after the check digits, as long as their country says.

    So a word in capitals behind one is no part of it. Countries that are not listed have
    groups of four and a shorter last one.
    """
    known = [rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}" for length, names in lengths.items()]
    listed = "|".join(" ".join(lengths.values()).split())
    other = rf"(?!{listed})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?"
    return rf"(?<![A-Za-z0-9])(?:{'|'.join([*known, other])})(?![A-Za-z0-9])"


IBAN = _account_form()

#: What a proposed and confirmed span is worth on its own. Kinds at the threshold or
#: above stay whatever stands near them.
WORTH = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
#: Words that, near a span, speak for its kind.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "carte", "karte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
#: Words that speak against any kind.
AGAINST = ("version", "build", "isbn", "example", "sample", "order")


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""

    def worth(digit: Column, place: Column) -> Column:
        twice = digit * 2
        return F.when(place % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: worth(c.cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda total, value: total + value) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, letters counting from A = 10, leaves 1 modulo 97."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(rest: Column, letter: Column) -> Column:
        value = F.when(letter.rlike("[0-9]"), letter.cast("int")).otherwise(F.ascii(letter) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _confirmed(kind: str, span: Column) -> Column:
    found = span["found"]
    if kind == "ip":
        return ~F.exists(F.split(found, r"\."), lambda p: ~p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        digits = digits_of(found)
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits_of(found)).between(9, 15)
    if kind == "iban":
        return mod97(found)
    if kind == "ssn":
        return ~found.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def find_personal_data(
    docs: DataFrame,
    text: str = "text",
    threshold: float = 0.5,
    reach: int = 40,
    worth: Mapping[str, float] = WORTH,
    context: Mapping[str, Sequence[str]] = CONTEXT,
    against: Sequence[str] = AGAINST,
    into: str = "personal",
) -> DataFrame:
    """Adds the column ``into``: ordered spans of personal data, each with its ``score``.

    A kind's pattern proposes spans; the Luhn check confirms cards, the remainder
    modulo 97 account numbers (iban), ranges of values or digits ip, phone and ssn.
    The score is the kind's worth, 0.3 more if one of its context words stands within
    ``reach`` characters, 0.15 less (but for kinds worth ``threshold`` or more not
    below it) if a word of ``against`` does. Spans below ``threshold`` are left out.
    NULL or empty texts have an empty list; a column that has the name ``into`` already
    is replaced. Only Spark functions are used and no rows are exchanged.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    forms = {
        "email": (EMAIL, "@"),
        "ip": (IP, r"[0-9]\.[0-9]"),
        "card": (CARD, "[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"),
        "phone": (PHONE, r"\+[0-9]"),
        "iban": (IBAN, "[A-Z]{2}[0-9]{2}"),
        "ssn": (SSN, "-[0-9]{2}-"),
    }

    def scored(kind: str):
        def score(span: Column) -> Column:
            near = F.lower(
                F.concat_ws(
                    " ",
                    F.substring(whole, F.greatest(span["begin"] - reach, F.lit(0)) + 1, F.least(span["begin"], F.lit(reach))),
                    F.substring(whole, span["end"] + 1, F.lit(reach)),
                )
            )
            value = F.lit(worth[kind])
            value = value + F.when(near.rlike(rf"\b(?:{'|'.join(context[kind])})"), 0.3).otherwise(0.0)
            lower = value - F.when(near.rlike(rf"\b(?:{'|'.join(against)})\b"), 0.15).otherwise(0.0)
            value = F.greatest(lower, F.lit(threshold)) if worth[kind] >= threshold else lower
            return F.struct(*(span[n].alias(n) for n in ("kind", "begin", "end", "found")), F.least(value, F.lit(1.0)).alias("score"))

        return score

    def confirmed(kind: str):
        return lambda span: _confirmed(kind, span)

    kept = [
        F.transform(F.filter(matches(whole, kind, pattern, needs=needs), confirmed(kind)), scored(kind))
        for kind, (pattern, needs) in forms.items()
    ]
    spans = F.filter(F.concat(*kept), lambda s: s["score"] >= threshold)
    return docs.withColumn(into, ordered(spans, KINDS))
