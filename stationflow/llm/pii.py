"""Personal data: patterns propose spans, checks confirm them, context adjusts the score.

All of it is column expressions. Positions are code points: a pattern's matches are wrapped in
a private-use character, the text is split there, and the pieces' lengths add up to positions.
That character itself is replaced in the text beforehand by another of equal length that no
pattern knows.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.base import columns, named, sha256_text

_MARK, _STAND_IN = "\ue000", "\ue001"


@dataclass(frozen=True)
class Kind:
    """A pattern with its check and score. Possessive repeats: same matches, no backtracking."""

    name: str
    pattern: str
    trigger: str  # a text without it has no match
    check: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    value = F.translate(value, " ", "")
    turned = F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


# Lengths of the countries' IBANs: where groups end, words in capitals may follow.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
    26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA",
    30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """An unbroken run, or groups of four with single blanks and a shorter last one."""
    forms = ["[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+"]
    for n, countries in _IBAN_LENGTHS.items():
        last = f" [A-Z0-9]{{{n % 4}}}" if n % 4 else ""
        forms.append(f"(?:{countries})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}{last}")
    known = "|".join(_IBAN_LENGTHS.values())
    forms.append(f"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?: [A-Z0-9]{{4}}){{3,7}}(?: [A-Z0-9]{{1,3}}(?![A-Za-z0-9]))?")
    return "(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(f"(?:{f})(?![A-Za-z0-9])" for f in forms) + ")"


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = (
    Kind("email", "[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@", lambda v: F.lit(True), 0.9,
         "mail|contact|write"),
    Kind("ip", "[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", "[0-9]\\.[0-9]",
         lambda v: v.rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$"), 0.6, "ip|address|host|server|login"),
    Kind("card", "[0-9](?:[ -]?[0-9])++", "[0-9][ -]?[0-9]",
         lambda v: F.length(_digits(v)).between(14, 19) & F.call_function("luhn_check", _digits(v)), 0.8, "card|visa|pay|credit"),
    Kind("phone", "\\+[0-9][ ().0-9-]+[0-9]", "\\+[0-9]",
         lambda v: F.length(_digits(v)).between(10, 15), 0.7, "tel|phone|call|mobile|fax"),
    Kind("iban", _iban(), "[A-Z]{2}[0-9]{2}", _mod97, 0.8,
         "iban|account|bank", False),
    Kind("ssn", "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", lambda v: F.lit(True), 0.3,
         "ssn|social|security", False),
    Kind("local_phone", "(?<![0-9+()-])(?<![0-9+()-] )(?:[(][0-9]{3}[)] ?|[0-9]{3}[ -])[0-9]{3}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]",
         lambda v: F.lit(True), 0.3, "tel|phone|call|mobile|fax", False),
)
REACH, BONUS, ACCEPT = 40, 0.3, 0.5
RUN = 64  # values that a running fold takes at once
CUT = 512  # characters of a piece from which texts are put together again
_SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"
_NONE = f"array<{_SPAN}>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, use: Callable[[Callable[[Column], Column]], Column], merge: Callable[[Column, Column], Column]) -> Column:
    """``use`` of a function that gives the fold of all values before a place.

    Values are folded in runs of RUN and the runs one by one, so that a place costs a part of
    its own run only, however many values there are.
    """
    zero = F.lit(0)

    def runs(v: Column) -> Column:
        numbers = F.sequence(zero, F.floor(F.size(v) / RUN).cast("int"))
        each = F.transform(numbers, lambda r: F.aggregate(F.slice(v, r * RUN + 1, RUN), zero, merge))
        first = F.struct(zero.alias("at"), F.expr("CAST(array() AS array<int>)").alias("out"))
        return F.aggregate(each, first, lambda state, x: F.struct(
            merge(state["at"], x).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out")), lambda state: state["out"])

    def before(v: Column, starts: Column, place: Column) -> Column:
        within = place % RUN
        return F.aggregate(F.slice(v, place - within + 1, within), F.get(starts, F.floor(place / RUN).cast("int")), merge)

    return _let(values, lambda v: _let(runs(v), lambda starts: use(lambda place: before(v, starts, place))))


def _spans(clean: Column, rank: int, kind: Kind) -> Column:
    """The kind's leftmost matches that do not overlap and pass, as _SPAN.

    Pieces at odd places are matches. Neighbouring pieces give the context: two of them hold
    a character at least, so twice REACH of them hold REACH characters.
    """
    word = f"(?i)(?<![a-z])(?:{kind.context})"

    def near(pieces: Column, place: Column) -> Column:
        first = F.greatest(place - 2 * REACH, F.lit(0))
        before = F.transform(F.slice(pieces, first + 1, place - first), lambda p: F.right(p, F.lit(REACH)))
        after = F.transform(F.slice(pieces, place + 2, 2 * REACH), lambda p: F.left(p, F.lit(REACH)))
        return (F.right(F.array_join(before, ""), F.lit(REACH)).rlike(word)
                | F.left(F.array_join(after, ""), F.lit(REACH)).rlike(word))

    def found(pieces: Column) -> Column:
        matches = F.filter(F.transform(pieces, lambda p, i: F.struct(i.alias("place"), p.alias("value"))),
                           lambda m: (m["place"] % 2 == 1) & kind.check(m["value"]))

        def span(m: Column, position: Callable[[Column], Column]) -> Column:
            score = F.lit(kind.score) + F.when(near(pieces, m["place"]), BONUS).otherwise(0.0)
            return _let(position(m["place"]), lambda at: F.struct(
                at.alias("start"), F.lit(rank).alias("rank"), (at + F.length(m["value"])).alias("end"),
                F.lit(kind.name).alias("kind"), F.least(score, F.lit(1.0)).alias("score")))

        return _let(matches, lambda ms: F.when(F.size(ms) > 0, _running(
            F.transform(pieces, F.length), lambda position: F.transform(ms, lambda m: span(m, position)),
            lambda x, y: x + y).cast(_NONE)).otherwise(F.expr(f"CAST(array() AS {_NONE})")))

    pieces = F.split(F.regexp_replace(clean, kind.pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    spans = _let(pieces, found)
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= ACCEPT)
    return F.when(clean.rlike(kind.trigger), spans).otherwise(F.expr(f"CAST(array() AS {_NONE})"))


def with_spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with ``__spans``: start, rank, end, kind, score by start, then kind."""
    clean = F.translate(F.coalesce("text", F.lit("")), _MARK, _STAND_IN)
    rows = docs.withColumn("__clean", clean)
    names = [f"__kind{i}" for i in range(len(kinds))]
    rows = rows.select(*columns(docs), *[_spans(F.col("__clean"), i, k).alias(n)
                                        for i, (k, n) in enumerate(zip(kinds, names, strict=True))])
    return rows.withColumn("__spans", F.array_sort(F.concat(*names))).drop(*names)


def _listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores for each row.

    Null and empty texts have no spans: counts 0, the hash of nothing, empty strings.
    Repeated rows each give a row. scores lists the spans' scores in the same order.
    """
    rows = with_spans(docs.select("doc_id", "text"), kinds)
    base = [k.name for k in kinds if k.base]


    def number(kind: str) -> Column:
        return F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return rows.select(
        "doc_id", *map(number, base),
        sha256_text(_listing(F.filter("__spans", lambda s: s["kind"].isin(base)))).alias("base_sha256"),
        _listing(F.col("__spans")).alias("spans"),
        F.array_join(F.transform("__spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))


def redacted(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with each span of its text replaced by ``<KIND>``; n_chars follows where it is
    a column. Overlapping spans are replaced together, under the first one's kind. Null texts
    stay null."""
    rows = with_spans(docs, kinds)
    text = F.col("text")

    def part(cuts: Column, start: Column, end: Column) -> Column:
        """Characters from start to end, from the cuts that hold them."""
        first = F.floor(start / CUT).cast("int")
        held = F.array_join(F.slice(cuts, first + 1, F.floor(end / CUT).cast("int") - first + 1), "")
        return F.substring(held, start - first * CUT + 1, end - start)

    def replaced(spans: Column, cuts: Column, reached: Callable[[Column], Column]) -> Column:
        # A span that starts inside an earlier one is replaced with it.
        numbered = F.transform(spans, lambda s, i: F.struct(i.alias("place"), s["start"].alias("start"), s["kind"].alias("kind")))
        fresh = F.filter(F.transform(numbered, lambda s: F.struct(
            reached(s["place"]).alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))), lambda s: s["at"] <= s["start"])
        put = F.transform(fresh, lambda s: F.concat(part(cuts, s["at"], s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        rest = part(cuts, reached(F.size(spans)), F.length(text))
        return F.concat(F.array_join(put, ""), rest)

    cuts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    whole = _let(F.col("__spans"), lambda spans: _let(cuts, lambda c: _running(
        F.transform(spans, lambda s: s["end"]), lambda reached: replaced(spans, c, reached), lambda x, y: F.greatest(x, y))))
    rows = rows.withColumn("__text", F.when(F.size("__spans") > 0, whole).otherwise(text))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("__text").alias("text"))
        elif c == "n_chars":
            changed = F.size("__spans") > 0
            out.append(F.when(changed, F.length("__text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(named(c))
    return rows.select(*out)
