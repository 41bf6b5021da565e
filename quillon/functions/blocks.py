"""Blocks of text for prompts, fingerprints and keys, from arrays of a group's rows. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

OUTCOMES = {"F": "success", "P": "partial"}


def in_order(key: str, value: Column) -> Column:
    """An aggregate: a group's values by key."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda o: o["v"])


def observation_line(text: Column, low: Column) -> Column:
    return F.concat(text, F.when(low, " [low confidence]").otherwise(""))


def numbered(lines: Column) -> Column:
    """Lines with their numbers from 1, one a line."""
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def history_turn(role: Column, content: Column) -> Column:
    """A turn as JSON."""
    return F.to_json(F.struct(role.alias("role"), content.alias("content")))


def prompt_turn(date: Column, role: Column, content: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(date, "yyyy-MM-dd"), F.lit("] "), role, F.lit(": "), content)


def fingerprint(turns: Column) -> Column:
    """SHA-256 of a sequence of (role, text) entries: role and text with a newline after each."""
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)


def cache_key(query: Column, limit: Column, entity: Column) -> Column:
    return F.sha2(F.concat_ws("\x01", query, limit.cast("string"), entity), 256)


def outcome(status: Column, known: dict[str, str] | None = None, default: str = "failure") -> Column:
    """A status by its table; what the table lacks, null too, is the default."""
    table = F.create_map(*[F.lit(x) for pair in (known or OUTCOMES).items() for x in pair])
    return F.coalesce(F.try_element_at(table, status), F.lit(default))
