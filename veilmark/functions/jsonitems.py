"""Identifier lists in JSON as models write them. Python's JSON reader decides what counts, so this is an
Arrow-backed UDF; it goes last and on the one column it needs."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..maps import NOTHING_FOUND

ITEMS = "array<struct<text string, type string>>"


def _items(text: str) -> list[dict] | None:
    """The objects with text and type of a JSON array, None if ``text`` is none."""
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return [x for x in value if isinstance(x, dict) and {"text", "type"} <= x.keys()] if isinstance(value, list) else None


def parse_items(raw: str | None) -> list[dict] | None:
    """Items of an answer; [] for "nothing found", None where nothing can be read.

    Tried in turn, code fences aside: the answer as an array, in brackets, with commas between adjacent
    objects, and each flat object in it by itself.
    """
    if raw is None:
        return None
    if raw.strip() in NOTHING_FOUND:
        return []
    text = re.sub(r"```(?:json)?\s*", "", raw.strip()).strip()
    if text in NOTHING_FOUND:
        return []
    for form in (text, f"[{text}]", "[" + re.sub(r"\}\s*\{", "},{", text) + "]"):
        if (found := _items(form)) is not None:
            return found
    alone = [x for flat in re.findall(r"\{[^{}]*\}", text) for x in _items(f"[{flat}]") or []]
    return alone or None


def json_items(raw: Column) -> Column:
    """``parse_items`` of a column; texts and types that are no strings are written as JSON."""

    def run(text: str) -> list:
        found = parse_items(text)
        as_text = lambda v: v if isinstance(v, str) else json.dumps(v)
        return found and [{"text": as_text(x["text"]), "type": as_text(x["type"])} for x in found]

    return F.udf(run, ITEMS, useArrow=True)(raw)
