"""Mentions, triples, statements and model answers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESPONSE = (
    "description string, annotated_description string, "
    "statements array<struct<text: string, subject: string, predicate: string, object: string, object_type: string, confidence: double>>, "
    "entities array<struct<name: string, type: string>>"
)


def mentions(text: Column) -> Column:
    """What stands in square brackets, each once, without `Entity:` before it."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\]]*)\]"), F.lit(1)), lambda m: F.trim(F.regexp_replace(m, r"^Entity:\s*", "")))
    return F.array_distinct(F.filter(found, lambda m: m != ""))


def entity_mentions(text: Column) -> Column:
    """Only mentions written [Entity: name]."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[Entity:\s*([^\]]+)\]"), F.lit(1)), lambda m: F.trim(m)))


def context(text: Column, name: Column, width: int = 100) -> Column:
    """`width` characters on either side of the first mention, without brackets, trimmed; null without a mention."""
    at = F.position(name, text)
    start = F.greatest(at - width, F.lit(1))
    piece = F.substr(text, start, F.length(name) + width + (at - start))
    return F.when(at > 0, F.trim(F.translate(piece, "[]", "")))


def annotate(text: Column) -> Column:
    """Capitalised words put in square brackets."""
    return F.regexp_replace(text, r"(^|[^A-Za-z])([A-Z][a-z]{2,})", "$1[$2]")


def triple_from_text(text: Column, is_entity: Column) -> tuple[Column, Column, Column]:
    """predicate, object and object_type read from a sentence: ` is `, ` has `, ` was ` or ` contains `, in this order; else has attribute."""
    predicate = F.lit("has attribute")
    rest = text
    for word in ("contains", "was", "has", "is"):
        here = text.contains(f" {word} ")
        predicate = F.when(here, word).otherwise(predicate)
        rest = F.when(here, F.substring_index(text, f" {word} ", -1)).otherwise(rest)
    return predicate, rest, F.when(is_entity, "entity").otherwise("literal")


def parse_response(answer: Column) -> Column:
    """The struct in a model's answer, with or without a ``` fence; null fields where it is not JSON."""
    body = F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.from_json(body, RESPONSE)


def statement_problems(s: Column) -> Column:
    """What is wrong with a statement, as a list of messages."""
    def blank(c: Column) -> Column:
        return c.isNull() | (F.trim(c) == "")

    return F.array_compact(
        F.array(
            F.when(blank(s["text"]), "text is required"),
            F.when(blank(s["predicate"]), "predicate is required"),
            F.when(blank(s["object"]), "object is required"),
            F.when(s["confidence"].isNotNull() & ~s["confidence"].between(0, 1), "confidence is not in 0..1"),
            F.when(s["object_type"].isNotNull() & ~s["object_type"].isin("entity", "literal"), "object_type is unknown"),
        )
    )


def with_defaults(s: Column) -> Column:
    """Confidence 0.7, type literal, source ai, and a text made of the parts."""
    text = F.coalesce(F.nullif(F.trim(s["text"]), F.lit("")), F.concat_ws(" ", s["subject"], s["predicate"], s["object"]))
    return F.struct(text.alias("text"), s["predicate"].alias("predicate"), s["object"].alias("object"), F.coalesce(s["object_type"], F.lit("literal")).alias("object_type"), F.coalesce(s["confidence"], F.lit(0.7)).alias("confidence"), F.lit("ai").alias("source"))


def data_url(url: Column) -> tuple[Column, Column]:
    """MIME type and bytes of data:type;base64,... ; null for anything else."""
    ok = url.rlike("^data:[^;,]+;base64,")
    return F.when(ok, F.regexp_extract(url, "^data:([^;,]+);base64,", 1)), F.when(ok, F.unbase64(F.regexp_replace(url, "^data:[^,]*,", "")))


def truncate(text: Column, n: int = 100) -> Column:
    """At most n characters, the last three of them dots if it was longer."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def aliases(*columns: Column) -> Column:
    """Distinct names that are present, in order."""
    return F.array_distinct(F.array_compact(F.array(*[F.nullif(F.trim(c), F.lit("")) for c in columns])))


def signature(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def format_duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(F.round(ms, 0).cast("long").cast("string"), F.lit("ms"))).otherwise(F.concat(F.format_number(ms / 1000, 2), F.lit("s")))
