"""Scalar functions on hand-written rows."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from veilmark.functions import special
from veilmark.functions.jsonitems import json_items, parse_items
from veilmark.functions.tags import find_tags, normalised, tag_count
from veilmark.functions.text import direct_answer, filled, levenshtein_similarity, new_identifiers, prompt_hash, redact, repeats, runaway, section_answer, strip
from veilmark.sources.fixtures import turns


def column(spark, expr, *values, schema="x string"):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.y for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


TAGS = {
    "a [[NAME]] b <<DATE>> {{ID}}": [(2, "[[NAME]]", "double_bracket", "NAME"), (3, "[NAME]", "bracket", "NAME"), (13, "<<DATE>>", "double_angle", "DATE"), (14, "<DATE>", "angle", "DATE"), (23, "{ID}", "curly_brace", "ID")],
    "[REDACTED] [removed] <redacted> [PHI]": [(0, "[REDACTED]", "bracket", "REDACTED"), (11, "[removed]", "bracket", "REMOVED"), (21, "<redacted>", "angle", "REDACTED"), (32, "[PHI]", "bracket", "PHI")],
    "[PATIENT_NAME] [PATIENT-ID] [REDACTED-NAME] [Redacteddate]": [(0, "[PATIENT_NAME]", "bracket", "NAME"), (15, "[PATIENT-ID]", "patient_bracket", "ID"), (28, "[REDACTED-NAME]", "bracket", "NAME"), (44, "[Redacteddate]", "bracket", "DATE")],
    "\U0001f642 *** XXXXX [...] ____ [****]": [(2, "***", "asterisk", "UNKNOWN"), (6, "XXXXX", "x_sequence", "UNKNOWN"), (12, "[...]", "ellipsis_bracket", "UNKNOWN"), (18, "____", "underscore", "UNKNOWN"), (24, "****", "asterisk", "UNKNOWN")],
    "[CLINıC]": [(0, "[CLINıC]", "bracket", None)],
    "xxxx": [], "XXX": [], "___": [], "": [],
}


def test_tags_in_every_notation(spark):
    got = column(spark, find_tags(F.col("x")), *TAGS)
    for tags, want in zip(got, TAGS.values()):
        assert [(t.position, t.tag_text, t.format) for t in tags] == [w[:3] for w in want]
        assert all(t.tag_type == w[3] for t, w in zip(tags, want) if w[3])
    assert column(spark, tag_count(F.col("x")), *TAGS) == [len(w) for w in TAGS.values()]
    assert column(spark, find_tags(F.col("x")), None, "x") == [None, []]


def test_tag_spellings(spark):
    assert column(spark, normalised(F.col("x")), "dob", "SSN", "age", " city ") == ["DATE", "ID", "AGE", "LOCATION"]


def test_direct_answers(spark):
    got = column(spark, direct_answer(F.col("x")), "Output: Result: x", "Result: Output: x", "  Here's the de-identified text:\n y \xa0", "Note: z", "", None)
    assert got == ["x", "Output: x", "y", "Note: z", "", None]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("[]", []), ("No PHI found.", []), ("```json\n[]\n```", []), ("12", []), ('"x"', []), ("[1]", []), ("sorry", None), (None, None),
        ('{"text":"a","type":"NAME"}\n{"text":"b","type":"DATE"}', [("a", "NAME"), ("b", "DATE")]), ('[{"text":"a","type":"NAME"},1,{"text":"b"}]', [("a", "NAME")]),
        ('{"text":"a","type":"NAME"}', [("a", "NAME")]), ('Found {"text":"a","type":"NAME"} and {bad} {"text":"b","type":"ID"}.', [("a", "NAME"), ("b", "ID")]), ("{bad}", None),
    ],
)
def test_item_lists(raw, want):
    found = parse_items(raw)
    assert (found if found is None else [(x["text"], x["type"]) for x in found]) == want


def test_item_lists_as_a_column(spark):
    got = column(spark, json_items(F.col("x")), '[{"text":"a","type":"NAME"}]', "[]", "sorry", None)
    assert [x and [tuple(i) for i in x] for x in got] == [[("a", "NAME")], [], None, None]


def test_redaction(spark):
    items = lambda *p: [{"text": t, "type": k} for t, k in p]
    rows = [("John Doe saw John", items(("John", "name"), ("John Doe", "NAME"))), ("NAME Longer", items(("Longer", "NAME"), ("NAME", "X"))), ("abc", items(("", "NAME"))), ("abc", [])]
    got = column(spark, redact(F.col("x"), F.col("p")), *rows, schema="x string, p array<struct<text string, type string>>")
    assert got == ["[NAME] saw [NAME]", "[X] [[X]]", "abc", "abc"]


def test_similarity_and_white_space(spark):
    rows = [("", ""), ("abc", "abd"), ("é\U0001f642", "e"), ("", "x")]
    assert column(spark, levenshtein_similarity(F.col("x"), F.col("z")), *rows, schema="x string, z string") == [1.0, pytest.approx(2 / 3), 0.0, 0.0]
    assert column(spark, strip(F.col("x")), "\xa0 a b \n") == ["a b"]


def test_new_identifiers(spark):
    rows = [("in New York", "x"), ("by Jane Roe", "x"), ("by Jane Roe", "Jane Roe"), ("555-123-4567", "x"), ("555-123-4567", "555-123-4567"), ("Bob\xa0Ray", "x")]
    assert column(spark, new_identifiers(F.col("x"), F.col("z")), *rows, schema="x string, z string") == [False, True, False, True, False, True]


def test_sections(spark):
    query = "Patient John Doe was admitted with severe chest pain yesterday"
    redacted = query.replace("John Doe", "[NAME]")
    cases = {
        f"STEP 1: x\nOUTPUT: {redacted}": (redacted, "clean"), "OUTPUT: something else": ("something else", "minor_format"), f"I think.\n\n{redacted}": (redacted, "output_only"),
        "the same line\n" * 4: ("", "repetition"), " ".join(f"w{i}" for i in range(300)): ("", "truncated"), "ééééé ééé": ("", "garbage"), "short and odd": ("short and odd", "section_bleed"), "  ": ("", "empty"), None: ("", "empty"),
    }
    rows = [(raw, query) for raw in cases]
    got = column(spark, section_answer(F.col("x"), F.col("q")), *rows, schema="x string, q string")
    assert [tuple(r) for r in got] == list(cases.values())


def test_repetition_and_runaway(spark):
    gram = " ".join(f"t{i}" for i in range(10))
    assert column(spark, repeats(F.col("x")), "a\nb\nc", "long line\n" * 3, "abc\nabc\nabc", f"{gram}\n" + f"x {gram}\ny {gram}\n z", f"{gram}\n{gram}\nq") == [False, True, False, True, False]
    rows = [("a b c", "a b c"), ("a" * 10, "a a"), ("x y z", "a b c"), ("", "")]
    assert column(spark, runaway(F.col("x"), F.col("q")), *rows, schema="x string, q string") == [False, True, True, False]


def test_prompts(spark):
    assert column(spark, prompt_hash(F.col("x"), F.lit("t")), "s") == [hashlib.sha256(b"s|||t").hexdigest()]
    assert column(spark, filled(F.col("x"), F.lit("q"), F.lit("j")), "{query}: {phi_json} {query}") == ["q: j q"]


def test_distributions(spark):
    assert special.norm_ppf(0.5) == 0 and special.norm_ppf(0) == -6 and special.norm_ppf(1) == 6
    assert special.norm_ppf(0.975) == pytest.approx(1.96, abs=1e-3)
    assert special.norm_cdf(1.96) == pytest.approx(0.975, abs=1e-4)
    for x in (0.1, 1.0, 3.84, 30.0):
        assert special.chi2_sf(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)
        assert special.chi2_sf(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-10)
    assert special.chi2_sf(11.0705, 5) == pytest.approx(0.05, abs=1e-5)
    df = spark.createDataFrame([(0.975,), (0.3,)], "p double")
    assert [r.z for r in df.select(special.norm_ppf_column(F.col("p")).alias("z")).collect()] == [pytest.approx(special.norm_ppf(p)) for p in (0.975, 0.3)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similarity_against_a_plain_table(spark):
    """Characters outside ASCII count as one each, in the texts of a table as in made ones."""
    pairs = [(r.query, r.output[:120]) for r in turns(spark, "/root/testdata/sf0.001").orderBy("conv_id", "turn").collect()]
    pairs += [("é", "e"), ("نص", ""), ("x" * 50, "y" * 50), ("ab", "ba"), ("", "")]
    got = column(spark, levenshtein_similarity(F.col("x"), F.col("z")), *pairs, schema="x string, z string")
    want = [1.0 if a == b else 1 - distance(a, b) / max(len(a), len(b)) for a, b in pairs]
    assert got == pytest.approx(want, abs=1e-12)
