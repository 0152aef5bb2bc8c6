"""Find personal data: patterns propose spans, checks confirm them, words nearby adjust their score.

All of it is column expressions on the text, row by row, without a shuffle:

1. *Propose.* For each kind the matches of its pattern, leftmost and without overlap, and the pieces of the text between them.
   The lengths of both, summed up along the array, are the places; the sums take one pass for each doubling of their number.
   Patterns start a match only where no other of the same stretch of signs can, so a long stretch is read once.
2. *Confirm.* Internet addresses by their parts, cards by their digits (Luhn), phone numbers by the count of digits, bank accounts by
   the length of their country and the remainder of 97, insurance numbers by their groups. What fails goes; no shorter match is tried.
3. *Score.* Every kind has a score of its own; a word of the kind among the ``NEAR`` signs to either side (up to the next proposal of
   the kind) adds ``HINT``. Base kinds stay whatever their score; the others stay from ``ENOUGH`` on.

Defined results: null and empty texts have no spans; every row is judged by itself, so repeated rows and null ids give the same
again; places are code points from 0, ends exclusive; extra columns are left out unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40
HINT = 0.3
ENOUGH = 0.5

# Lengths of bank account numbers by country.
ACCOUNT_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29,
}
PART = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
ADDRESS = rf"^0*{PART}\.0*{PART}\.0*{PART}\.0*{PART}$"
INSURANCE = "^(00[1-9]|0[1-9][0-9]|[1-57-8][0-9][0-9]|6[0-57-9][0-9]|66[0-57-9])-(0[1-9]|[1-9][0-9])-(000[1-9]|00[1-9][0-9]|0[1-9][0-9][0-9]|[1-9][0-9]{3})$"


def word_pattern(words: tuple[str, ...]) -> str:
    return f"(^|[^a-z])({'|'.join(words)})([^a-z]|$)"


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""

    def value(digit: Column, place: Column) -> Column:
        twice = digit.cast("int") * 2
        return F.when(place % 2 == 0, digit.cast("int")).when(twice > 9, twice - 9).otherwise(twice)

    values = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(values, F.lit(0), lambda total, one: total + one) % 10 == 0


def remainder_97(account: Column) -> Column:
    """Remainder of an account number, its first four signs moved behind and letters read as 10 to 35."""

    def step(rest: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(F.concat(F.substr(account, F.lit(5)), F.left(account, F.lit(4))), ""), F.lit(0), step)


def _stands_alone(found: Column, text: Column, beside: str) -> Column:
    """Whether no sign of ``beside`` touches ``text``, which begins a proposal."""
    rest = F.left(F.concat(F.substr(found.match, F.length(text) + 1), found.after), F.lit(1))
    start_known = (F.length(found.before) > 0) | (found.end == F.length(found.match))
    return start_known & ~F.right(found.before, F.lit(1)).rlike(beside) & ~rest.rlike(beside)


def _email(found: Column) -> Column:
    return found.match


def _ip(found: Column) -> Column:
    return F.when(found.match.rlike(ADDRESS), found.match)


def _card(found: Column) -> Column:
    digits = F.translate(found.match, " -", "")
    return F.when(F.length(digits).between(13, 19), F.when(luhn(digits), found.match))


def _phone(found: Column) -> Column:
    return F.when(F.length(F.regexp_replace(found.match, "[^0-9]", "")).between(9, 15), found.match)


def _account(found: Column) -> Column:
    lengths = F.lit("".join(f"{country}{length}" for country, length in ACCOUNT_LENGTHS.items()))
    place = F.instr(lengths, F.left(found.match, F.lit(2)))
    length = F.when(place > 0, F.substr(lengths, place + 2, F.lit(2)).cast("int"))
    compact = F.left(F.translate(found.match, " ", ""), length)
    text = F.regexp_substr(found.match, F.concat(F.lit("^(?:[A-Z0-9] ?){"), (length - 1).cast("string"), F.lit("}[A-Z0-9]")))
    long_enough = F.length(F.translate(found.match, " ", "")) >= length
    alone = _stands_alone(found, text, "[A-Za-z0-9]")
    return F.when(length.isNotNull() & long_enough, F.when((remainder_97(compact) == 1) & alone, text))


def _insurance(found: Column) -> Column:
    return F.when(found.match.rlike(INSURANCE) & _stands_alone(found, found.match, "[0-9A-Za-z-]"), found.match)


def _local_phone(found: Column) -> Column:
    part_of_another = found.before.rlike(r"[+0-9][ ().-]*$") | found.after.rlike("^[ ().-]?[0-9]")
    return F.when(~part_of_another & _stands_alone(found, found.match, "[0-9A-Za-z]"), found.match)


@dataclass(frozen=True)
class Kind:
    """``confirm`` turns a proposal (match, before, after, end) into the confirmed text at its start, or null."""

    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    score: float
    words: tuple[str, ...]
    base: bool


KINDS = (
    Kind(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _email, 0.7,
        ("email", "mail", "contact", "correo"), True,
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, 0.5, ("ip", "address", "host", "server"), True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, 0.6, ("card", "visa", "mastercard", "amex", "credit", "karte", "tarjeta"), True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 0.6, ("phone", "tel", "call", "mobile", "fax", "telefon"), True),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", _account, 0.6, ("iban", "account", "bank", "konto", "cuenta"), False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _insurance, 0.3, ("ssn", "social", "security", "taxpayer"), False),
    Kind(
        "tel", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", _local_phone, 0.3,
        ("phone", "tel", "call", "mobile", "fax", "telefon"), False,
    ),
)

SPAN = "struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>"


def running_sums(values: Column) -> Column:
    """Sums of an array up to each place; every round adds what stands twice as far back."""
    rounds = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def add(sums: Column, turn: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.pow(F.lit(2), turn).cast("int")), sums)
        return F.slice(F.zip_with(sums, moved, lambda one, other: F.coalesce(one, F.lit(0)) + other), F.lit(1), F.size(sums))

    return F.aggregate(rounds, values, add)


def _spans(kind: Kind) -> Column:
    """Spans of one kind from its columns: matches, pieces and ends."""
    matches, pieces, ends = (F.col(f"_{part}_{kind.name}") for part in ("matches", "pieces", "ends"))
    after = F.slice(pieces, F.lit(2), F.size(matches))
    found = F.zip_with(
        F.zip_with(matches, ends, lambda match, end: F.struct(match.alias("match"), end.alias("end"))),
        F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), after, lambda one, other: F.struct(one.alias("before"), other.alias("after"))),
        lambda one, beside: F.struct(
            one.match.alias("match"), one.end.alias("end"),
            F.right(beside.before, F.lit(NEAR)).alias("before"), F.left(beside.after, F.lit(NEAR)).alias("after"),
        ),
    )

    def judged(one: Column) -> Column:
        text = kind.confirm(one)
        start = one.end - F.length(one.match)
        near = F.lower(F.concat_ws(" ", one.before, one.after)).rlike(word_pattern(kind.words))
        score = F.lit(kind.score) + F.when(near, F.lit(HINT)).otherwise(F.lit(0.0))
        span = F.struct(
            F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(text)).alias("end"), score.alias("score"),
            F.lit(kind.base).alias("base"),
        )
        return span.cast(SPAN)

    spans = F.transform(found, judged)
    return F.filter(spans, lambda span: span.end.isNotNull() & (span.base | (span.score >= ENOUGH)))


def find_spans(docs: DataFrame, keep: list[str], text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Columns of ``keep``, then spans: kind, start, end, score and base of all found, by kind as listed, then start."""
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(text, F.lit("")).alias("_text"))
    rows = rows.withColumns({f"_matches_{k.name}": F.regexp_extract_all("_text", F.lit(k.pattern), F.lit(0)) for k in kinds})
    any_match = {k.name: F.size(f"_matches_{k.name}") > 0 for k in kinds}
    none = F.array().cast("array<string>")
    rows = rows.withColumns(
        {f"_pieces_{k.name}": F.when(any_match[k.name], F.split("_text", k.pattern, -1)).otherwise(none) for k in kinds}
    )
    rows = rows.withColumns(
        {
            f"_ends_{k.name}": F.zip_with(
                f"_matches_{k.name}",
                F.slice(f"_pieces_{k.name}", F.lit(1), F.size(f"_matches_{k.name}")),
                lambda match, piece: (F.length(match) + F.length(piece)).cast("bigint"),
            )
            for k in kinds
        }
    )
    rows = rows.withColumns({f"_ends_{k.name}": running_sums(F.col(f"_ends_{k.name}")) for k in kinds})
    found = F.concat(*[F.when(any_match[k.name], _spans(k)).otherwise(F.array().cast(f"array<{SPAN}>")) for k in kinds])
    return rows.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], found.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string")))
    return F.concat_ws(",", parts)
