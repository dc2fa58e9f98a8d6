"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Everything is column expressions over one row: no shuffle, no Python in the tasks.  Positions
come from the pieces between the matches of a pattern: a match starts where the pieces and
matches before it end.  The running sums go in chunks, so a text with very many matches
stays cheap.  Patterns are written so that a run is looked at once: possessive repeats, and
a start only where a run starts or the last match ended.

A kind has a base score, a bonus if a checksum confirms it (a failing checksum drops the
match) and a bonus for context words within ``CONTEXT`` characters before or after.  Spans of
the base kinds always stay; spans of the other kinds need ``min_score``.

Defined cases: a null text is an empty one and has no span; repeated rows are scanned each;
an empty table gives an empty result; positions are code points, ends exclusive; spans are
ordered by start, then by the order of the kinds, then by end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
_CHUNK = 512
_PROPOSED = "array<struct<start:int,end:int,match:string,near:string>>"
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """True if the digits of the match pass the Luhn check."""
    def check(number: Column) -> Column:
        worth = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: _bind(
            F.substring(number, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
            lambda d: d - F.when(d > 9, 9).otherwise(0)))
        return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0
    return _bind(F.reverse(digits(match)), check)


def mod97(match: Column) -> Column:
    """True if the match (spaces apart) passes the ISO 7064 mod-97 check."""
    def check(code: Column) -> Column:
        turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
        return _bind(turned, lambda t: F.aggregate(
            F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.ascii(F.substring(t, i, F.lit(1)))), F.lit(0),
            lambda a, x: F.when(x >= 65, a * 100 + x - 55).otherwise(a * 10 + x - 48) % 97)) == 1
    return _bind(F.regexp_replace(match, " ", ""), check)


def octets(match: Column) -> Column:
    """True if all dotted parts are at most 255."""
    return F.forall(F.split(match, r"\."), lambda p: p.try_cast("double") <= 255)


def _between(match: Column, least: int, most: int) -> Column:
    return F.length(digits(match)).between(least, most)


@dataclass(frozen=True)
class Kind:
    """``start`` is a literal text without which a document can't hold a match ('' if none)."""

    name: str
    pattern: str
    valid: Callable[[Column], Column] | None
    base: bool
    score: float
    checked: float
    words: str
    start: str = ""


# Length of an IBAN by country code.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """An IBAN has the length of its country; one of another country is a run that ends
    before the next known one."""
    codes = {n: f"(?:{c.replace(' ', '|')})" for n, c in _IBAN_LENGTHS.items()}
    known = "(?:" + "|".join(codes.values()) + ")[0-9]{2}"
    exact = "|".join(rf"{c}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in codes.items())
    other = rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20{known})\x20?[A-Z0-9]){{11,30}}"
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{exact}|{other})(?![A-Za-z0-9])"


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         None, True, 0.7, 0.0, "e-?mail|mail|contact|correo|courriel", "@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         octets, True, 0.5, 0.1, "ip|address|server|host|adresse", "."),
    # a chain of digits with single separators, only where it has 14 to 19 digits
    Kind("card", r"(?<![0-9]|[0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
         luhn, True, 0.4, 0.4, "card|visa|credit|payment|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda m: _between(m, 10, 15), True, 0.5, 0.1, "phone|tel|call|mobile|fax|telefon", "+"),
    Kind("iban", _iban(),
         mod97, False, 0.4, 0.5, "iban|bank|account|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         None, False, 0.3, 0.0, "ssn|social|security"),
)
CONTEXT_BONUS = 0.3


def _positions(pieces: Column) -> Column:
    """Running sums over ``(before, long, match, near)`` in two levels: spans with positions."""
    one = "array<struct<start:int,end:int,match:string,near:string>>"

    def chunk(at: Column, part: Column) -> Column:
        return F.aggregate(
            part, F.struct(at.alias("at"), F.array().cast(one).alias("out")),
            lambda acc, p: F.struct(
                (acc["at"] + p["before"] + p["long"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + p["before"]).alias("start"), (acc["at"] + p["before"] + p["long"]).alias("end"),
                    p["match"].alias("match"), p["near"].alias("near")))).alias("out")))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _CHUNK).cast("int")),
                         lambda c: F.slice(pieces, c * _CHUNK + 1, F.lit(_CHUNK)))
    return F.aggregate(
        chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{one}>").alias("out")),
        lambda acc, part: _bind(chunk(acc["at"], part), lambda done: F.struct(
            done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))),
        lambda acc: F.flatten(acc["out"]))


def _proposed(matches: Column, gaps: Column) -> Column:
    """Matches with the text around them; ``gaps`` has one piece more than ``matches``.

    The text around a match is joined from the short ends of the pieces and matches beside it;
    as a match has a character at least, ``CONTEXT`` of them on a side reach far enough."""
    def ends(cut: Callable[[Column, Column], Column]) -> Column:
        return F.flatten(F.transform(gaps, lambda g, i: F.array(
            cut(g, F.lit(CONTEXT)), F.coalesce(cut(F.get(matches, i), F.lit(CONTEXT)), F.lit("")))))

    def near(first: Column, last: Column, i: Column) -> Column:
        # gap i is the element 2 i + 1 of both; match i comes after it
        count = F.least(2 * i, F.lit(2 * CONTEXT)) + 1
        before = F.array_join(F.slice(last, 2 * i + 2 - count, count), "")
        after = F.array_join(F.slice(first, 2 * i + 3, F.lit(2 * CONTEXT + 1)), "")
        return F.concat(F.right(before, F.lit(CONTEXT)), F.lit("\n"), F.left(after, F.lit(CONTEXT)))

    return _bind(ends(F.left), lambda first: _bind(ends(F.right), lambda last: F.transform(matches, lambda m, i: F.struct(
        F.length(F.get(gaps, i)).alias("before"), F.length(m).alias("long"), m.alias("match"), near(first, last, i).alias("near")))))


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, min_score: float = 0.6, text: str = "text",
         out: str = "spans") -> DataFrame:
    """The rows with an array ``out`` of ``(start, rank, end, kind, score)``; ``rank`` is the
    place of the kind in ``kinds`` (columns of that name, and names with ``_pii_``, are replaced).

    The steps are separate projections so that no pattern runs twice on a text.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    names = [k.name for k in kinds]
    docs = docs.withColumns({f"_pii_m_{k.name}": (
        F.when(F.contains(source, F.lit(k.start)), F.regexp_extract_all(source, F.lit(k.pattern), F.lit(0)))
        if k.start else F.regexp_extract_all(source, F.lit(k.pattern), F.lit(0))) for k in kinds})
    docs = docs.withColumns({f"_pii_g_{k.name}": F.when(F.size(f"_pii_m_{k.name}") > 0, F.split(source, k.pattern, -1)) for k in kinds})
    docs = docs.withColumns({f"_pii_p_{n}": F.when(F.size(f"_pii_m_{n}") > 0, _proposed(F.col(f"_pii_m_{n}"), F.col(f"_pii_g_{n}"))) for n in names})
    docs = docs.withColumns({f"_pii_s_{n}": F.when(F.size(f"_pii_p_{n}") > 0, _positions(F.col(f"_pii_p_{n}"))) for n in names})

    def scored(rank: int, k: Kind) -> Column:
        spans = F.coalesce(F.col(f"_pii_s_{k.name}"), F.array().cast(_PROPOSED))
        if k.valid:
            spans = F.filter(spans, lambda s: k.valid(s["match"]))
        spans = F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(k.name).alias("kind"),
            F.least(F.lit(1.0), F.lit(k.score + k.checked) + F.when(
                F.rlike(F.lower(s["near"]), F.lit(rf"\b(?:{k.words})\b")), CONTEXT_BONUS).otherwise(0.0)).alias("score")))
        return spans if k.base else F.filter(spans, lambda s: s["score"] >= min_score)

    found = F.array_sort(F.concat(*[scored(i, k) for i, k in enumerate(kinds)]))
    return docs.withColumn(out, found.cast(SPANS)).drop(*[f"_pii_{x}_{n}" for x in "mgps" for n in names])
