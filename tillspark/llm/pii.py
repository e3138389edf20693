"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for IBANs, part
and digit counts for addresses and phones), and words near a span adjust its score. The four base
kinds stay whatever their score; the further kinds need a score of `least_score`.

Patterns use possessive loops and do not start inside a run of their own characters, so a text of
one unbroken run takes linear time and no deep recursion. They match what the plain forms match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.scratch import blocks_of, bound, cut_out, sums_before, text_of


@dataclass(frozen=True)
class Kind:
    name: str
    #: What a text must contain for the pattern to be tried at all.
    hint: str
    pattern: str
    #: Score of a confirmed match, and what a context word nearby adds.
    score: float
    near: float
    context: str
    #: Characters which a match has at least.
    least: int


#: Fixed by the contract: kinds, order, patterns and digit counts of the first four.
BASE = (
    Kind(
        "email",
        "@",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.9,
        0.1,
        "mail|contact|write|address",
        5,
    ),
    Kind(
        "ip",
        r"[0-9]\.[0-9]",
        r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
        0.6,
        0.3,
        r"\bip\b|server|host|address|login",
        7,
    ),
    Kind(
        "card",
        r"[0-9][ -]?[0-9]",
        r"[0-9](?:[ -]?+[0-9])++",
        0.7,
        0.3,
        "card|visa|master|credit|debit|payment",
        2,
    ),
    Kind(
        "phone",
        r"\+[0-9]",
        r"\+[0-9][ ().0-9-]+[0-9]",
        0.6,
        0.3,
        r"phone|\btel\b|call|mobile|fax|whatsapp",
        3,
    ),
)
MORE = (
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        0.8,
        0.2,
        "iban|bank|account|konto|transfer",
        12,
    ),
    Kind(
        "national_id",
        r"[0-9]-[0-9]{2}-[0-9]",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        0.3,
        0.4,
        r"\bssn\b|social security|tax id",
        11,
    ),
)
CONTEXT_CHARACTERS = 40


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn check digit."""
    back = F.reverse(digits)

    def term(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    places = F.sequence(F.lit(1), F.length(digits))
    total = F.aggregate(places, F.lit(0), lambda acc, i: acc + term(i))
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(False)


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 modulo 97."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise(
            (acc * 100 + code - 55) % 97
        )

    places = F.sequence(F.lit(1), F.length(turned))
    return F.when(
        F.length(iban) > 4, F.aggregate(places, F.lit(0), step) == 1
    ).otherwise(False)


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255))
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, " ", ""))
    return F.lit(True)


_SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,score:double>"


def _spans(text: Column, kind: Kind, rank: int, least_score: float | None) -> Column:
    """Confirmed matches of one kind, in order, as array of structs."""
    floor = 0.0 if least_score is None else least_score

    def placed(p: Column) -> Column:
        hits, gaps = p["hits"], p["gaps"]
        before = F.slice(gaps, F.lit(1), F.size(hits))
        steps = F.zip_with(hits, before, lambda h, g: (F.length(h) + F.length(g)).cast("long"))
        starts = F.zip_with(sums_before(steps), before, lambda s, g: s + F.length(g))
        # The text as gap, hit, gap, ...; of each piece only its ends can be near another hit.
        pieces = F.concat(
            F.flatten(F.zip_with(before, hits, lambda g, h: F.array(g, h))),
            F.slice(gaps, F.size(gaps), F.lit(1)),
        )
        ends = F.transform(pieces, lambda x: F.right(x, F.lit(CONTEXT_CHARACTERS)))
        heads = F.transform(pieces, lambda x: F.left(x, F.lit(CONTEXT_CHARACTERS)))
        return bound(
            F.struct(starts.alias("starts"), ends.alias("ends"), heads.alias("heads")),
            lambda near: F.filter(
                F.transform(hits, lambda h, i: span(h, i, near)), lambda s: s["score"] >= floor
            ),
        )

    def span(hit: Column, i: Column, near: Column) -> Column:
        # So many hits, with their gaps, hold the characters on a side.
        reach = 2 * -(-CONTEXT_CHARACTERS // kind.least)
        own = 2 * i + 1
        first = F.greatest(own - reach, F.lit(1))
        before = F.right(F.array_join(F.slice(near["ends"], first, own + 1 - first), ""), F.lit(CONTEXT_CHARACTERS))
        after = F.left(F.array_join(F.slice(near["heads"], own + 2, F.lit(reach)), ""), F.lit(CONTEXT_CHARACTERS))
        around = F.lower(F.concat(before, hit, after))
        score = kind.score + F.when(around.rlike(kind.context), kind.near).otherwise(0.0)
        start = F.get(near["starts"], i)
        return F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            (start + F.length(hit)).alias("end"),
            F.lit(kind.name).alias("kind"),
            F.when(_confirmed(kind.name, hit), score).alias("score"),
        )

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hits"),
        F.split(text, kind.pattern, -1).alias("gaps"),
    )
    found = bound(parts, placed)
    hint = F.contains(text, F.lit("@")) if kind.hint == "@" else text.rlike(kind.hint)
    return F.when(hint, found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def find(
    docs: DataFrame, text_col: str = "text", least_score: float = 0.5, out: str = "_spans"
) -> DataFrame:
    """`docs` with the column `out`: array of (start, rank, end, kind, score), by start and kind.

    Positions count code points from 0, ends are exclusive. Spans of one kind do not overlap, those
    of different kinds may. Null and empty texts have none. Rows are searched one by one, so ties,
    repeated rows and other columns do not matter; whole texts are searched. A column named `out` is
    replaced.
    """
    text = text_of(docs, text_col)
    each = [_spans(text, k, i, None) for i, k in enumerate(BASE)]
    each += [_spans(text, k, len(BASE) + i, least_score) for i, k in enumerate(MORE)]
    return docs.withColumn(out, F.array_sort(F.concat(*each)))


def named(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["rank"] < len(BASE))


def redacted(text: Column, spans: Column) -> Column:
    """`text` with each span replaced by its kind in angle brackets; overlapping spans are one.

    The first span of an overlap names it. Spans are in the order of their starts.
    """

    def farthest(s: Column) -> Column:
        """Before each span, the farthest end of the spans before it: running in short stretches."""
        step = F.greatest(F.ceil(F.sqrt(F.size(s))).cast("int"), F.lit(1))
        zero = F.lit(0).cast("long")
        cut = F.transform(
            F.sequence(F.lit(0), F.size(s) - 1, step),
            lambda i: F.transform(F.slice(s, i + 1, step), lambda x: x["end"]),
        )

        def running(ends: Column, first: Column) -> Column:
            return F.aggregate(
                ends,
                F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out")),
                lambda acc, e: F.struct(
                    F.greatest(acc["at"], e).alias("at"),
                    F.concat(acc["out"], F.array(acc["at"])).alias("out"),
                ),
                lambda acc: acc["out"],
            )

        return bound(
            cut,
            lambda parts: F.flatten(
                F.zip_with(parts, running(F.transform(parts, F.array_max), zero), running)
            ),
        )

    def changed(s: Column) -> Column:
        return bound(
            F.struct(farthest(s).alias("reached"), blocks_of(text).alias("blocks")),
            lambda w: F.concat(
                F.array_join(
                    F.transform(
                        s,
                        lambda x, i: bound(
                            F.get(w["reached"], i),
                            lambda at: F.when(
                                x["start"] >= at,
                                F.concat(
                                    cut_out(w["blocks"], at, x["start"]), F.lit("<"), x["kind"], F.lit(">")
                                ),
                            ).otherwise(""),
                        ),
                    ),
                    "",
                ),
                cut_out(
                    w["blocks"],
                    F.array_max(F.transform(s, lambda x: x["end"])),
                    F.length(text).cast("long"),
                ),
            ),
        )

    return F.when(F.size(spans) > 0, bound(spans, changed)).otherwise(text)
