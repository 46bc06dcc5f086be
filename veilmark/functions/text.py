"""Scalar text functions: trimming, parsing of answers, redaction, similarity, repetition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import maps
from .binding import let
from .distance import levenshtein
from .tags import find_tags


def strip(text: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(F.lower(text)))


def contains_any(text: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def direct_answer(raw: Column) -> Column:
    """A direct answer without its prefixes, each stripped at most once and in their fixed order."""

    def without(text: Column, prefix: Column) -> Column:
        rest = strip(F.substring(text, F.length(prefix) + 1, F.length(text)))
        return F.when(F.startswith(F.lower(text), F.lower(prefix)), rest).otherwise(text)

    return F.aggregate(F.array(*[F.lit(p) for p in maps.ANSWER_PREFIXES]), strip(raw), without)


def redact(text: Column, items: Column) -> Column:
    """Replace each item's ``text`` by [TYPE], longest first; items of no text change nothing."""
    longest_first = F.array_sort(items, lambda a, b: F.length(b["text"]) - F.length(a["text"]))
    tag = lambda p: F.concat(F.lit("["), F.upper(p["type"]), F.lit("]"))
    return F.aggregate(longest_first, text, lambda acc, p: F.replace(acc, p["text"], tag(p)))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / length of the longer; 1 for equal texts, which need no distance."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).otherwise(1 - levenshtein(a, b) / longest)


def overlap(of: Column, other: Column) -> Column:
    """Share of the distinct tokens ``of`` that are among ``other``; null if there are none."""
    return F.try_divide(F.size(F.array_intersect(of, other)).cast("double"), F.size(of))


def _content(text: Column) -> Column:
    """The distinct lower-cased tokens that are no stop words."""
    return F.array_except(token_set(text), F.array(*[F.lit(w) for w in maps.STOP_WORDS]))


def resembles(candidate: Column, original: Column | None, content: Column | None = None) -> Column:
    """Whether a candidate is a redaction of ``original``: it shares enough words, stop words aside.
    Without an original: whether it has a typed tag. ``content``: the original's words, if at hand."""
    names = "|".join(maps.TAG_NAMES)
    typed = candidate.rlike(rf"(?iu)[\[<](?:{names})[\]>]")
    if original is None:
        return typed
    share = F.coalesce(overlap(_content(original) if content is None else content, _content(candidate)), F.lit(0.0))
    close = let(share, lambda s: (s > 0.4) & ((s > 0.85) | (F.size(find_tags(candidate)) > 0)))
    return F.when(F.length(original) == 0, typed).otherwise(close)


def _window_hashes(hashes: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` words but the last, from hashes of the words: windows of 1, 2, 4, ... words are
    hashed from two halves, and those of which ``size`` is the sum from one another."""
    joined = lambda a, b, apart: F.transform(F.slice(a, 1, F.greatest(F.size(b) - apart, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(b, i + apart)))
    parts = [k for k in reversed(range(size.bit_length())) if size >> k & 1]

    def doubled(windows: Column, k: int, held: dict[int, Column]) -> Column:
        held = held | {k: windows}
        if k < parts[0]:
            return let(joined(windows, windows, 1 << k), lambda w: doubled(w, k + 1, held))
        out, covered = held[parts[0]], 1 << parts[0]
        for p in parts[1:]:
            out, covered = joined(out, held[p], covered), covered + (1 << p)
        return F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))

    return doubled(hashes, 0, {})


def _often(words: Column, hashes: Column, size: int, threshold: int) -> Column:
    """Whether a window of ``size`` words stands ``threshold`` times: hashes that do are found by sorting, the words decide."""
    equal = lambda sorted_, i: F.get(sorted_, i) == F.get(sorted_, i - (threshold - 1))
    several = lambda sorted_: F.filter(sorted_, lambda x, i: (i >= threshold - 1) & equal(sorted_, i))

    def checked(windows: Column, x: Column) -> Column:
        places = F.filter(F.transform(windows, lambda w, i: F.when(w == x, i)), lambda i: i.isNotNull())
        texts = F.array_sort(F.transform(places, lambda i: F.array_join(F.slice(words, i + 1, size), " ")))
        return let(texts, lambda t: F.size(several(t)) > 0)

    return let(_window_hashes(hashes, size), lambda w: F.exists(let(F.array_sort(w), several), lambda x: checked(w, x)))


def repeats(text: Column, threshold: int = 3) -> Column:
    """Whether an answer collapsed: ``threshold`` equal lines in a row, or a run of 10, 20 or 30 tokens as often (the
    last run of a size is left out). Hashes of 64 bits find the runs, in time that grows with the text; their words are compared."""
    lines, words = F.split(strip(text), "\n"), tokens(text)
    n = F.size(lines)
    same = lambda x: lambda i: (F.size(F.array_distinct(F.slice(x, i, threshold))) == 1) & (F.length(strip(F.get(x, i - 1))) > 5)
    rows = let(lines, lambda x: F.exists(F.sequence(F.lit(1), n - threshold + 1), same(x)))

    def runs(given: Column) -> Column:
        out = F.lit(False)
        for size in (10, 20, 30):
            out = out | F.when(F.size(given["words"]) >= 3 * size, _often(given["words"], given["hashes"], size, threshold)).otherwise(False)
        return out

    hashed = let(words, lambda x: F.struct(x.alias("words"), F.transform(x, lambda w: F.xxhash64(w)).alias("hashes")))
    return F.when(n < threshold, False).otherwise(rows | let(hashed, runs))


def section_answer(raw: Column, original: Column | None = None) -> Column:
    """Struct (text, status) of the answer in a response of several sections.

    In turn: after the first of the markers that is there and followed by text; the last paragraph that
    resembles the original; nothing for collapsed, cut off or garbled responses; else the whole.
    """
    given = F.struct(strip(F.coalesce(raw, F.lit(""))).alias("text"), (F.lit(None).cast("array<string>") if original is None else _content(original)).alias("content"))
    return let(given, lambda g: _section(g["text"], original, g["content"]))


def _section(text: Column, original: Column | None, content: Column) -> Column:
    pair = lambda t, s: F.struct(t.alias("text"), F.lit(s).alias("status"))
    # after each marker, in their order: the first that is there and followed by text
    markers = F.array(*[F.lit(m) for m in maps.SECTION_MARKERS])
    after = lambda m: F.when(F.contains(text, m), strip(F.element_at(F.split(text, F.concat(F.lit(r"\Q"), m, F.lit(r"\E")), -1), -1)))
    found = F.get(F.filter(F.transform(markers, after), lambda x: F.coalesce(x != "", F.lit(False))), F.lit(0))
    parts = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    last = F.try_element_at(F.filter(parts, lambda p: resembles(p, original, content)), F.lit(-1))

    def without_section(paragraph: Column) -> Column:
        out = F.when(paragraph.isNotNull(), pair(paragraph, "output_only"))
        return _collapsed(out, text, pair)

    section = lambda x: F.when(resembles(x, original, content), pair(x, "clean")).otherwise(pair(x, "minor_format"))
    return F.when(text == "", pair(F.lit(""), "empty")).otherwise(let(found, lambda x: F.when(x.isNotNull(), section(x)).otherwise(let(last, without_section))))


def _collapsed(out: Column, text: Column, pair) -> Column:
    """What is left when there is neither a section nor a paragraph to take."""
    out = out.when(repeats(text), pair(F.lit(""), "repetition"))
    out = out.when((F.size(tokens(text)) > 200) & ~text.rlike(r"[.?!\]>]$"), pair(F.lit(""), "truncated"))
    strange = F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) / F.length(text)
    return out.when(strange > 0.1, pair(F.lit(""), "garbage")).otherwise(pair(text, "section_bleed"))


def runaway(output: Column, query: Column) -> Column:
    """Whether an output is over three times as long as its query or shares under 0.3 of its words."""
    share = overlap(token_set(query), token_set(output))
    return (F.length(output) > 3 * F.length(query)) | F.coalesce(share < 0.3, F.lit(False))


def prompt_hash(system: Column, template: Column) -> Column:
    """SHA-256 of system prompt and user template, three bars between them."""
    return F.sha2(F.concat_ws("|||", system, template), 256)


def filled(template: Column, query: Column, items: Column | None = None) -> Column:
    """A prompt template with its {query} (and {phi_json}) filled in."""
    text = F.replace(template, F.lit("{query}"), query)
    return text if items is None else F.replace(text, F.lit("{phi_json}"), items)


def name_like(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Z][a-z]+\s+[A-Z][a-z]*\.?\b"), 0))


def phone_like(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"), 0))


def new_identifiers(output: Column, original: Column) -> Column:
    """Whether an output has names or ten-digit numbers that its original has not."""
    known = F.array(*[F.lit(x) for x in maps.NO_NAMES])
    names = F.array_except(F.array_except(name_like(output), name_like(original)), known)
    return (F.size(names) > 0) | (F.size(F.array_except(phone_like(output), phone_like(original))) > 0)
