"""Chat formatting of typed content parts, with DataFrame functions only.

A visitor walks the parts of every turn in order: text is escaped and written out, an image, audio
or document part becomes a numbered placeholder, and its reference and the tokens it will expand
to are recorded. A turn is written as

    <s>[INST]role[/INST]content</s>

Inside roles and texts a control string gets one backslash after its first character, also where
it has some already, so taking one away restores every text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.scratch import blocks_of, bound, cut_out, sums_before

#: Marks of the template and the opening of a placeholder: first character, rest.
OPEN, SAID, CLOSE, HOLD = "<s>[INST]", "[/INST]", "</s>", "<|"
_REST = r"(/?s>|/?INST\]|\|)"
PART = "struct<kind:string,text:string,ref:string,units:double>"


@dataclass(frozen=True)
class Template:
    #: Tokens which one unit of a part expands to: image tile, second of audio, document page.
    tokens_per_unit: dict[str, int] = field(
        default_factory=lambda: {"image": 256, "audio": 25, "document": 600}
    )
    #: Roles whose contents bear loss.
    learned: tuple[str, ...] = ("assistant",)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, "$1$2$3")


def text_part(text: Column) -> Column:
    """A turn's content of a single text part."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("double").alias("units"),
        )
    )


def visit(parts: Column, template: Template) -> Column:
    """Struct (content, attachments, tokens) of the parts of one turn.

    The number of a placeholder counts from 0 within the turn. Parts of unknown kind, and null
    parts, are written as empty text. Neighbouring texts are escaped as the one text they make. A part
    of unknown length counts as one unit.
    """
    costs = F.create_map(*[F.lit(x) for kv in template.tokens_per_unit.items() for x in kv])

    def of(part: Column) -> Column:
        held = part["kind"].isin(*template.tokens_per_unit)
        return F.struct(
            F.coalesce(held, F.lit(False)).alias("held"),
            F.when(held, F.lit("")).otherwise(
                F.when(part["kind"] == "text", F.coalesce(part["text"], F.lit(""))).otherwise("")
            ).alias("text"),
            part["kind"].alias("kind"),
            part["ref"].alias("ref"),
            F.when(held, F.ceil(F.coalesce(part["units"], F.lit(1.0)) * costs[part["kind"]]))
            .otherwise(0)
            .cast("long")
            .alias("tokens"),
        )

    seen = F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), of)

    def content(seen: Column) -> Column:
        held = F.filter(seen, lambda p: p["held"])
        # Places of the held parts, one before the first and one behind the last part.
        places = F.filter(
            F.transform(seen, lambda p, i: F.when(p["held"], i)), lambda i: i.isNotNull()
        )
        edges = F.concat(F.array(F.lit(-1)), places, F.array(F.size(seen)))
        texts = F.transform(seen, lambda p: p["text"])

        def stretch(cuts: Column, k: Column) -> Column:
            first = F.get(cuts, k) + 2
            # Neighbouring texts are one text: a control string must not hide in two of them.
            own = F.array_join(F.slice(texts, first, F.get(cuts, k + 1) + 1 - first), "")
            hold = F.concat(F.lit(HOLD), F.get(held["kind"], k), F.lit("_"), k, F.lit("|>"))
            return F.concat(escaped(own), F.when(k < F.size(cuts) - 2, hold).otherwise(""))

        return bound(
            edges,
            lambda cuts: F.array_join(
                F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), lambda k: stretch(cuts, k)), ""
            ),
        )

    return F.struct(
        bound(seen, content).alias("content"),
        F.transform(
            F.filter(seen, lambda p: p["held"]),
            lambda p, i: F.struct(
                i.alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"),
                p["tokens"].alias("tokens"),
            ),
        ).alias("attachments"),
        F.coalesce(F.aggregate(seen, F.lit(0).cast("long"), lambda a, p: a + p["tokens"]), F.lit(0))
        .cast("long")
        .alias("tokens"),
    )


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation of `turns` (conv_id, turn, role, parts).

    Returns conv_id, formatted, loss (array of start, end in characters of `formatted`, end
    exclusive), attachments (with the place of their turn) and expanded_tokens. Turns go by number;
    equal numbers by role and content, nulls first; null roles are empty. A conversation is one
    text by nature and is put together in one row. Rows of null conv_id form one conversation.
    """
    template = template or Template()
    visited = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visit(F.col("parts"), template).alias("v"))
    row = F.struct("turn", "role", F.col("v.content").alias("content"), F.col("v.attachments").alias("attachments"), F.col("v.tokens").alias("tokens"))
    chats = visited.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def head(r: Column) -> Column:
        return F.concat(F.lit(OPEN), escaped(r["role"]), F.lit(SAID))

    written = chats.withColumn(
        "pieces",
        F.transform(
            "rows",
            lambda r: F.struct(
                head(r).alias("head"),
                r["content"].alias("content"),
                r["role"].isin(*template.learned).alias("learned"),
            ),
        ),
    )
    tail = len(CLOSE)

    def masked(pieces: Column) -> Column:
        long = lambda c: F.length(c).cast("long")
        sizes = F.transform(pieces, lambda p: long(p["head"]) + long(p["content"]) + tail)
        spans = F.zip_with(
            pieces,
            sums_before(sizes),
            lambda p, at: F.when(
                p["learned"],
                F.struct(
                    (at + long(p["head"])).alias("start"),
                    (at + long(p["head"]) + long(p["content"])).alias("end"),
                ),
            ),
        )
        return F.filter(spans, lambda s: s.isNotNull())

    spans = bound(F.col("pieces"), masked)
    return written.select(
        "conv_id",
        F.array_join(
            F.transform("pieces", lambda p: F.concat(p["head"], p["content"], F.lit(CLOSE))), ""
        ).alias("formatted"),
        spans.alias("loss"),
        F.flatten(
            F.transform(
                "rows",
                lambda r, place: F.transform(
                    r["attachments"], lambda a: F.struct(place.alias("place"), a.alias("attachment"))
                ),
            )
        ).alias("attachments"),
        F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["tokens"]).alias(
            "expanded_tokens"
        ),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    each = F.split(formatted, CLOSE)
    inner = F.slice(each, F.lit(1), F.size(each) - 1)

    def turn(t: Column) -> Column:
        at = F.position(F.lit(SAID), t)
        role = F.substring(t, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        return F.struct(
            unescaped(role).alias("role"),
            unescaped(F.substring(t, at + len(SAID), F.length(t))).alias("text"),
        )

    return F.transform(inner, turn)


def under_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return bound(
        blocks_of(formatted),
        lambda blocks: F.array_join(
            F.transform(loss, lambda s: unescaped(cut_out(blocks, s["start"], s["end"]))), ""
        ),
    )
