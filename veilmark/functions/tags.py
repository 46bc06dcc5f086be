"""Redaction tags in any notation, found with built-in functions.

Each notation is one regular expression. The gaps between its matches (split) and the matches
themselves (regexp_extract_all) give every match's position in code points. Of several matches that
start at one place the first notation in order counts; nested spellings such as [[NAME]] start at two
places and so count twice.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..maps import TAG_NAMES, TAG_OF_SPELLING
from .binding import let, running_sums

_T = "(" + "|".join(TAG_NAMES) + ")"
# Fixed values: (format, pattern, whether group 1 is the type), in order of precedence. Bare [REDACTED],
# [REMOVED], [PHI] and <REDACTED> are matches of the first and third, which always come before them.
NOTATIONS = (
    ("bracket", rf"(?iu)\[(?:REDACTED[-_]?)?{_T}\]", True),
    ("patient_bracket", rf"(?iu)\[(?:PATIENT[-_]){_T}\]", True),
    ("angle", rf"(?iu)<(?:REDACTED[-_]?)?{_T}>", True),
    ("double_angle", rf"(?iu)<<{_T}>>", True),
    ("double_bracket", rf"(?iu)\[\[{_T}\]\]", True),
    ("curly_brace", rf"(?iu)\{{{_T}\}}", True),
    ("asterisk", r"\*{3,}", False),
    ("x_sequence", r"X{4,}", False),
    ("ellipsis_bracket", r"\[\.{2,}\]", False),
    ("underscore", r"_{4,}", False),
)
#: Any text with a tag matches this; others skip the search.
ANY_TAG = r"[\[<{]|\*{3}|X{4}|_{4}"
TAG = "array<struct<position int, pattern_no int, tag_text string, tag_type string, format string>>"


def normalised(name: Column) -> Column:
    """The tag that a spelling stands for; the upper-cased spelling itself if it is unknown."""
    upper = F.upper(F.trim(name))
    table = F.create_map(*[F.lit(x) for pair in TAG_OF_SPELLING.items() for x in pair])
    return F.coalesce(F.try_element_at(table, upper), upper)


def _matches(text: Column, number: int, kind: str, pattern: str, typed: bool) -> Column:
    def entries(m: Column) -> Column:
        # each match lies behind all gaps and matches before it
        behind = F.transform(m["found"], lambda x, i: F.length(F.get(m["gaps"], i)) + F.when(i > 0, F.length(F.get(m["found"], i - 1))).otherwise(0))

        def entry(places: Column):
            def tag(x: Column, i: Column) -> Column:
                kept = F.regexp_extract(x, pattern, 1) if typed else None
                return F.struct(
                    F.get(places, i).alias("position"), F.lit(number).alias("pattern_no"), x.alias("tag_text"),
                    (normalised(kept) if typed else F.lit("UNKNOWN")).alias("tag_type"), F.lit(kind).alias("format"),
                )

            return F.transform(m["found"], tag)

        return let(running_sums(behind), entry)

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), let(found, entries)).otherwise(F.array().cast(TAG))


def find_tags(text: Column) -> Column:
    """Array of (position, pattern_no, tag_text, tag_type, format) by position; null for null."""

    def found(x: Column) -> Column:
        every = F.array_sort(F.concat(*[_matches(x, k, *n) for k, n in enumerate(NOTATIONS)]))
        return let(every, lambda e: F.filter(e, lambda t, i: (i == 0) | (F.get(e, i - 1)["position"] != t["position"])))

    return F.when(text.rlike(ANY_TAG), let(text, found)).when(text.isNotNull(), F.array().cast(TAG)).cast(TAG)


def tag_count(text: Column) -> Column:
    """How many tags a text has, in any notation."""
    return F.size(find_tags(text))


def _text(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


def tags_sql(text: str = "t") -> str:
    """``find_tags`` of an SQL expression as SQL text, for use where there are no columns."""
    spelled = ", ".join(f"{_text(a)}, {_text(b)}" for a, b in TAG_OF_SPELLING.items())
    powers = ", ".join(str(1 << k) for k in range(31))
    parts = []
    for number, (kind, pattern, typed) in enumerate(NOTATIONS):
        rx = f"r'{pattern}'"
        name = f"upper(trim(regexp_extract(x, {rx}, 1)))"
        tag = f"coalesce(try_element_at(map({spelled}), {name}), {name})" if typed else "'UNKNOWN'"
        behind = "transform(found, (x, i) -> length(gaps[i]) + if(i > 0, length(get(found, i - 1)), 0))"
        sums = f"aggregate(filter(array({powers}), p -> p <= size(found) - 1), {behind}, (s, back) -> transform(s, (x, i) -> x + if(i >= back, get(s, i - back), 0)))"
        entry = f"struct(places[i] as position, {number} as pattern_no, x as tag_text, {tag} as tag_type, {_text(kind)} as format)"
        entries = f"transform(array({sums}), places -> transform(found, (x, i) -> {entry}))[0]"
        split = f"transform(array(split({text}, {rx}, -1)), gaps -> {entries})[0]"
        parts.append(f"if({text} rlike {rx}, transform(array(regexp_extract_all({text}, {rx}, 0)), found -> {split})[0], cast(array() as {TAG}))")
    every = f"array_sort(concat({', '.join(parts)}))"
    return f"transform(array({every}), e -> filter(e, (t, i) -> i = 0 or get(e, i - 1).position != t.position))[0]"


def register_tags(spark: SparkSession, name: str = "veilmark_tags") -> None:
    """A table function of the session: ``select ... from texts, lateral veilmark_tags(texts.text)`` gives one row
    (position, tag_text, tag_type, format) for each tag. Built-in expressions only; null has no tags."""
    rows = f"select tag.position, tag.tag_text, tag.tag_type, tag.format from (select explode({tags_sql('txt')}) as tag)"
    spark.sql(f"create or replace temporary function {name}(txt string) returns table (position int, tag_text string, tag_type string, format string) return {rows}")
