"""The three tiers of scoring, and the kinds of false positives, as column expressions.

All take the output to be judged, which is null where there is none ('' is an output), and the query's
text and annotations. Nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import maps
from ..functions.binding import first_not_below, let
from ..functions.text import contains_any, strip, tokens

ELEMENT = (
    "array<struct<value string, type string, tier1_pass boolean, tier2_pass boolean, reason string, "
    "found_tag string, position_offset int, is_deletion boolean>>"
)


def _typed(kind: Column, default: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in maps.TAG_OF_TYPE.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), default)


def _deleted(query: Column, output_lower: Column, value: Column, at: Column) -> Column:
    """Whether two of the three words on either side of a removed value are still in the output."""
    n = maps.DELETION_CONTEXT
    before = tokens(F.substring(query, F.greatest(at - n, F.lit(0)) + 1, F.least(at, F.lit(n))))
    after = tokens(F.substring(query, at + F.length(value) + 1, F.lit(n)))
    last = F.slice(before, F.greatest(F.size(before) - 2, F.lit(1)), 3)
    kept = lambda words: F.size(F.filter(words, lambda w: F.contains(output_lower, F.lower(w)))) >= 2
    return kept(last) | kept(F.slice(after, 1, 3))


def _around(tags: Column, place: Column) -> Column:
    """The tags that can be near a place: no two start at one position, so that there are no more than positions. Few
    tags are all taken; of many the first is found by a binary search."""
    most = 2 * maps.TAG_DISTANCE + 1
    first = first_not_below(tags, lambda t: t["position"], place - maps.TAG_DISTANCE)
    return F.when(F.size(tags) <= most, tags).otherwise(F.slice(tags, first + 1, F.lit(most)))


def elements(query: Column, phi: Column, output: Column, tags: Column) -> Column:
    """Tiers 1 and 2 of each annotated value.

    Tier 1: the value is not in the output, whatever its case. Tier 2: besides, the first tag by position
    that is near the value's proportional place is of its type or generic. A value that the query's text
    does not hold passes; one tag may serve several values.
    """

    def one(b: Column, p: Column) -> Column:
        value = strip(p["value"])
        lower = F.lower(value)
        at = F.position(lower, b["query"]) - 1
        place = ((at / F.greatest(F.length(query), F.lit(1))) * F.length(output)).cast("int")
        first = F.struct(
            value.alias("value"), p["identifier_type"].alias("type"), _typed(p["identifier_type"], p["identifier_type"]).alias("kind"),
            F.contains(b["output"], lower).alias("present"), at.alias("at"), place.alias("place"),
        )
        return let(first, lambda e: second(b, e))

    def second(b: Column, e: Column) -> Column:
        fits = lambda t: (F.abs(t["position"] - e["place"]) <= maps.TAG_DISTANCE) & ((t["tag_type"] == e["kind"]) | t["tag_type"].isin(*maps.GENERIC_TAGS))
        tag = F.when(~e["present"] & (e["at"] >= 0), F.get(F.filter(_around(tags, e["place"]), fits), F.lit(0)))
        gone = F.when(~e["present"] & (e["at"] >= 0), _deleted(query, b["output"], e["value"], e["at"]))
        return let(F.struct(tag.alias("tag"), gone.alias("gone")), lambda f: third(e, f["tag"], f["gone"]))

    def third(e: Column, tag: Column, gone: Column) -> Column:
        value, present, at, place = e["value"], e["present"], e["at"], e["place"]
        reason = (
            F.when(output.isNull(), "no_output").when(present, "phi_still_present").when(at < 0, "phi_not_in_input")
            .when(tag.isNotNull(), "tag_matched").when(gone, "deletion").otherwise("no_matching_tag")
        )
        tier1 = output.isNotNull() & ~present
        matched = tier1 & (at >= 0) & tag.isNotNull()
        return F.struct(
            value.alias("value"), e["type"].alias("type"), F.coalesce(tier1, F.lit(False)).alias("tier1_pass"),
            F.coalesce(tier1 & ((at < 0) | tag.isNotNull()), F.lit(False)).alias("tier2_pass"), reason.alias("reason"),
            F.when(matched, tag["tag_text"]).alias("found_tag"), F.when(matched, F.abs(tag["position"] - place)).alias("position_offset"),
            F.when(tier1 & (at >= 0) & tag.isNull(), gone).alias("is_deletion"),
        )

    lowered = F.struct(F.lower(output).alias("output"), F.lower(query).alias("query"))
    return let(lowered, lambda b: F.transform(phi, lambda p: one(b, p))).cast(ELEMENT)


def expected_output(query: Column, phi: Column) -> Column:
    """The query with every annotated value, longest first, replaced by its tag ([ID] for unknown types)."""
    longest_first = F.array_sort(phi, lambda a, b: F.length(b["value"]) - F.length(a["value"]))
    tag = lambda p: F.concat(F.lit("["), _typed(p["identifier_type"], F.lit("ID")), F.lit("]"))
    return F.aggregate(longest_first, query, lambda acc, p: F.replace(acc, p["value"], tag(p)))


def fidelity(negative: Column, output: Column, expected: Column, similarity: Column, fresh: Column) -> Column:
    """Tier 3: struct (pass, levenshtein_similarity, char_ratio, appended_content, new_phi_detected,
    failure_reason) of how much else an output changed. ``similarity`` with the expected output and
    ``fresh`` (new identifiers) are columns of their own, as each is costly and used several times."""
    ratio = F.length(output) / F.greatest(F.length(expected), F.lit(1))
    appended = F.length(output) > F.length(expected) * maps.APPENDED
    least = F.when(negative, maps.SIMILARITY_NEGATIVE).otherwise(maps.SIMILARITY_POSITIVE)
    near, even = similarity >= least, ratio.between(maps.RATIO_LOW, maps.RATIO_HIGH)
    passed = near & even & ~appended & ~fresh
    reasons = F.concat_ws(
        "; ",
        F.when(~near, F.format_string("low_similarity_%.2f", similarity)), F.when(~even, F.format_string("char_ratio_%.2f", ratio)),
        F.when(appended, "appended_content"), F.when(fresh, "new_phi_detected"),
    )
    none = output.isNull()
    return F.struct(
        F.when(none, False).otherwise(passed).alias("pass"),
        F.when(none, 0.0).otherwise(F.bround(similarity, 4)).alias("levenshtein_similarity"),
        F.when(none, 0.0).otherwise(F.bround(ratio, 4)).alias("char_ratio"),
        F.when(none, False).otherwise(appended).alias("appended_content"),
        F.when(none, False).otherwise(fresh).alias("new_phi_detected"),
        F.when(none, "no_output").when(~passed, reasons).alias("failure_reason"),
    )


def false_positives(query: Column, output: Column, tags: Column) -> Column:
    """What the tags on a text without identifiers are: struct of counts a (a medical term), b (in made-up
    content), c (in an explanation), d (unclear) and the tags; null without tags."""
    n, m = F.length(query), F.length(output)
    expanded = m > n * maps.EXPANDED

    def letter(t: Column) -> Column:
        start = F.greatest(t["position"] - 30, F.lit(0))
        around = F.lower(F.substring(output, start + 1, t["position"] + F.length(t["tag_text"]) + 30 - start))
        place = ((t["position"] / F.greatest(m, F.lit(1))) * n).cast("int")
        left = F.greatest(place - 20, F.lit(0))
        window = F.lower(F.substring(query, left + 1, place + 20 - left))
        outside = expanded & (t["position"] > n)
        return (
            F.when(outside & contains_any(around, maps.EXAMPLE_TERMS), "b").when(outside & contains_any(around, maps.EXPLAINING_TERMS), "c")
            .when(outside, "b").when(contains_any(window, maps.CLINICAL_TERMS), "a").otherwise("d")
        )

    count = lambda letters, x: F.size(F.filter(letters, lambda y: y == x)).alias(f"type_{x}_count")
    texts = F.transform(tags, lambda t: t["tag_text"]).alias("tagged_terms")
    return F.when(F.size(tags) > 0, let(F.transform(tags, letter), lambda z: F.struct(*[count(z, x) for x in "abcd"], texts)))
