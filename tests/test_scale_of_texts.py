"""Tags, the search for the nearest tag and distances: right on all texts, and not quadratic in their length."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veilmark import maps, schemas
from veilmark.functions import binding, distance
from veilmark.functions.tags import NOTATIONS, find_tags
from veilmark.functions.text import levenshtein_similarity
from veilmark.operators import tiers


def took(action):
    began = time.time()
    out = action()
    return out, time.time() - began


def plain_tags(text):
    found = {}
    for k, (kind, rx, typed) in enumerate(NOTATIONS):
        for m in re.finditer(rx.replace("(?iu)", "(?i)"), text):
            name = m[1].upper() if typed else None
            found.setdefault(m.start(), (m.start(), k, m[0], maps.TAG_OF_SPELLING.get(name, name) if typed else "UNKNOWN", kind))
    return [found[x] for x in sorted(found)]


def test_tags_of_any_text(spark):
    rng = random.Random(1)
    parts = ["[NAME]", "[[DATE]]", "<<MRN>>", "<PHONE>", "{ID}", "***", "****", "XXXXX", "[...]", "____", "[PATIENT-NAME]", "[REDACTED_DATE]", " ", "a", "é😀", "[", "]", "\n", "[redacted]"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)] + ["", "[NAME]" * 3000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", find_tags(F.col("t")).alias("x")).collect()
    for r in rows:
        assert [tuple(t) for t in r.x] == plain_tags(texts[r.k])


def test_a_hundred_thousand_tags(spark):
    def each(n):
        df = spark.createDataFrame([("word [NAME] and [[DATE]] *** " * (n // 4),)], "t string").select(F.size(find_tags(F.col("t"))).alias("n"))
        found, seconds = took(lambda: df.first().n)
        assert found == n
        return seconds

    each(1000)  # compiled
    few, many = each(1000), each(100_000)
    assert many < 100 * few + 2 and many < 30


def test_running_sums_and_search(spark):
    rng = random.Random(2)
    rows = [(k, sorted(rng.randrange(50) for _ in range(rng.choice([0, 1, 2, 3, 7, 8, 9, 100])))) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, x array<int>")
    got = df.select("k", "x", binding.running_sums(F.col("x")).alias("s"), binding.first_not_below(F.col("x"), lambda v: v, F.pmod("k", F.lit(52)) - 1).alias("n"))
    for r in got.collect():
        assert r.s == [sum(r.x[: i + 1]) for i in range(len(r.x))] and r.n == sum(v < r.k % 52 - 1 for v in r.x)


def judged(spark, query, phi, output):
    df = spark.createDataFrame([(query, [{"identifier_type": t, "value": v} for t, v in phi], output)], f"q string, phi {schemas.PHI}, o string")
    df = df.withColumn("tags", find_tags(F.col("o")))
    return df.select(tiers.elements(F.col("q"), F.col("phi"), F.col("o"), F.col("tags")).alias("e")).first().e


@pytest.mark.parametrize("seed", range(3))
def test_the_first_fitting_tag_near_a_place(spark, seed):
    rng = random.Random(seed)
    values = [f"v{k:03d}v" for k in range(150)]
    query = " ".join(x for v in values for x in (v, "w" * rng.randrange(20)))
    kinds = rng.choices(["NAME", "DATE", "EMAIL_ADDRESS"], k=150)
    output = "".join(rng.choice(["[NAME]", "[DATE]", "[EMAIL]", "***", "-", "word "]) + " " * rng.randrange(9) for _ in range(900))
    tags = plain_tags(output)
    assert len(tags) > 161
    for e, kind, value in zip(judged(spark, query, list(zip(kinds, values)), output), kinds, values):
        place = int(query.index(value) / len(query) * len(output))
        fits = [t for t in tags if abs(t[0] - place) <= maps.TAG_DISTANCE and (t[3] == maps.TAG_OF_TYPE.get(kind, kind) or t[3] in maps.GENERIC_TAGS)]
        assert (e.found_tag, e.position_offset) == ((fits[0][2], abs(fits[0][0] - place)) if fits else (None, None))


def test_elements_times_tags_do_not_multiply(spark):
    def seconds(n):
        query = " ".join(f"v{k:06d}v" for k in range(n))
        return took(lambda: judged(spark, query[:20_000], [("NAME", f"v{k:06d}v") for k in range(300)], "[DATE] " * n))[1]

    seconds(1000)
    few, many = seconds(1000), seconds(20_000)  # twenty times the tags for as many elements
    assert many < 20 * few + 5


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def pairs(rng, n):
    for _ in range(n):
        letters = rng.choice(["ab", "abc", "aé😀日"])
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        b = list(a if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randrange(30))))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        yield a, "".join(b)


def test_distances_of_any_texts(spark, monkeypatch):
    given = [*pairs(random.Random(3), 1500), ("", ""), ("", "a"), ("a" * 40, "a" * 39)]
    want = [plain_distance(a, b) for a, b in given]
    assert [distance.distance(a, b) for a, b in given] == want
    for (a, b), w in zip(given, want):
        x, y = distance._codes(a), distance._codes(b)
        if a and b:
            assert distance._by_bits(a, b) == w and distance._by_diagonals(x, y, 3) == (w if w <= 3 else None)
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(given)] + [(-1, None, "a"), (-2, "a", None)], "k int, a string, b string")
    for cells in (distance.CELLS, 20):  # built in, and by Arrow for all but the smallest
        monkeypatch.setattr(distance, "CELLS", cells)
        got = {r.k: r.d for r in df.select("k", distance.levenshtein(F.col("a"), F.col("b")).alias("d")).collect()}
        assert got == {**dict(enumerate(want)), -1: None, -2: None}


def test_long_texts_that_differ_little(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    other = list(words)
    for i in rng.sample(range(20_000), 50):
        other[i] = "é" + other[i]
    a, b = " ".join(words), " ".join(other)
    found, seconds = took(lambda: distance.distance(a, b))
    assert found == 50 and seconds < 1
    df = spark.createDataFrame([(a, b), (a, a)], "a string, b string").select(levenshtein_similarity(F.col("a"), F.col("b")).alias("s"))
    rows, seconds = took(df.collect)
    assert [r.s for r in rows] == [pytest.approx(1 - 50 / len(b)), 1.0] and seconds < 20
    assert distance.distance(a, a[::-1]) > 1000  # past the diagonals
