"""The operators against brute force, on whole small tables with every awkward case."""

import hashlib
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from cases import DOCS, documents, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilmark.llm import ann, decontam, licenses, mixing, quality, simhash, substring, tokencount, tokenfile, urlfilter
from veilmark.llm.common import alnum_words, components, space_words


def b(text):
    return None if text is None else text.encode()


# --- SimHash


def fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def linked(fps, ids):
    group = list(range(len(fps)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                group[find(i)] = find(j)
    found = defaultdict(list)
    for i in range(len(fps)):
        found[find(i)].append(ids[i])
    return [min((x for x in found[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_simhash_links_as_brute_force_does(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [fingerprint(t) for _, t in rows]
    want = [(i, format(f, "016x"), c) for (i, _), f, c in zip(rows, fps, linked(fps, [i for i, _ in rows]))]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert Counter(got) == Counter(want)
    assert dict((i, c) for i, _, c in got)[2] in (0, 2)  # a near copy of document 0, if within two bits
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({c for _, _, c in want})


def test_simhash_large_buckets_keep_every_link(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    # many fingerprints with one half in common: far more than BUCKET in one bucket
    near = {base}
    while len(near) < 300:
        near.add(base ^ (1 << int(rng.integers(32))) ^ (1 << int(rng.integers(32))) ^ (1 << int(rng.integers(32))))
    far = {base ^ (int(rng.integers(1 << 30)) << 33) for _ in range(50)}
    fps = sorted(near | far)
    edges = simhash.near_pairs(spark.createDataFrame([(x,) for x in fps], "fp bigint"))
    assert all((r.u ^ r.v).bit_count() <= 2 for r in edges.collect())
    roots = {r.node: r.root for r in components(edges).collect()}
    assert [roots.get(x, x) for x in fps] == linked(fps, fps)


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}


# --- Mixing


def first_fit(rows, max_epochs=3, weights=(5, 2, 1)):
    size = lambda t: len((t or "").encode().split())
    sources = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    weight = {s: weights[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    clamped = set()
    while True:
        free = sum(weight[s] for s in sources if s not in clamped)
        level = (sum(total.values()) - sum(max_epochs * total[s] for s in clamped)) / free if free else 0
        more = {s for s in sources if s not in clamped and weight[s] * level > max_epochs * total[s]}
        if not more:
            break
        clamped |= more
    target = {s: float(max_epochs * total[s]) if s in clamped else weight[s] * level for s in sources}
    out = []
    for s in sources:
        whole = int(target[s] // total[s]) if total[s] else 0
        left = int(target[s] - whole * total[s])
        units = defaultdict(list)
        for i, t, x in rows:
            if x == s:
                units[int(hashlib.md5(f"{mixing.SEED}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16)].append((i, size(t)))
        go = left > 0
        for u in sorted(units):
            n = sum(z for _, z in units[u])
            fits = go and n <= left
            left -= n * fits
            out += [(i, z, total[s], target[s], whole + fits) for i, z in units[u]]
    return out


def test_mixing_fills_targets(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = [tuple(r) for r in mixing.mix(docs).select("doc.doc_id", "size", "source_size", "target", "copies").collect()]
    assert Counter(got) == Counter(first_fit(rows))
    assert Counter(r.doc_id for r in mixing.repeated(docs).collect()) == Counter({i: n for i, n in Counter(x for x, *_, c in got for _ in range(c)).items()})
    assert mixing.repeated(docs).columns == docs.columns


def test_mixing_clamps_small_sources(spark):
    rows = [(i, "a " * n, s, 1) for i, (n, s) in enumerate([(10, "a"), (2, "b"), (500, "c"), (300, "c"), (0, "d")])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, x int")
    got = {r.source: r.target for r in mixing.plan(docs).collect()}
    assert got["a"] == 30 and got["b"] == 6 and got["d"] == 0 and got["c"] == pytest.approx(812 - 36)


# --- Quality


def labelled(spark, n=600):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)]
        docs.append((i, " ".join(words) if good else " | ".join(w.upper() + "!!" for w in words), None, None, None, None, None, None, None))
        labels.append((i, int(good), 0))
    docs += [(None, "no id", None, None, None, None, None, None, None), (n, None, None, None, None, None, None, None, None), (n + 1, "", None, None, None, None, None, None, None), docs[0]]
    labels += [(None, 1, 0), (n + 5, 1, 0), (1, None, 1)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_learns_only_from_its_folds_and_predicts_the_other(spark):
    docs, labels = labelled(spark)
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    test = [r for r in got if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 3 > 0) for r in test) / len(test) > 0.97
    # other labels of held-out rows change nothing
    other = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted((str(r.doc_id), r.score) for r in quality.classify(docs, other).collect()) == sorted((str(r.doc_id), r.score) for r in got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_quality_without_labels(spark):
    docs, labels = labelled(spark, 6)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_trees_agree_with_plain_traversal():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 3] > 0).astype(float)
    model = quality.train(x, y, trees=20)
    for row in x[:20]:
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        assert model.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


# --- Licenses


def test_license_phrases_and_templates(spark):
    mit = licenses.TEMPLATES["mit"]
    cut = mit.replace("without restriction, ", "").replace("publish", "print and publish")
    rows = [
        "Under the MIT License. under the mit license!", "see CC-BY-NC and under the\nmit-license", mit, "x " * 100 + cut, mit[:60], "the apache license, version 2.0",
        None, "", "cc by", "ÉCC BY NC", "K", *texts(),
    ]
    docs = documents(spark, rows)
    docs = docs.union(docs.limit(1)).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    got = defaultdict(list)
    for r in licenses.scan(docs).collect():
        got[r.doc_id].append(r)
    assert len(got[0]) == 2 and len(got[None]) == 1 and got[0][0] == got[0][1]
    for k, text in enumerate(rows):
        w = licenses.words_of(text or "")
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[k][0]
        want = (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places})))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert [got[k][0].labels for k in (2, 3, 4)] == ["mit", "mit", ""] and got[2][0].score == 1


# --- Nearest neighbours


def exact(vectors, queries, k):
    want = {}
    for q, v in queries:
        scored = sorted((-float(np.dot(v, w)), i) for i, w in vectors if i != q)[:k]
        want[q] = [(i, -s) for s, i in scored]
    return want


def test_neighbours_recall_order_and_ties(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 30] + 0.3 * rng.normal(size=16)]) for i in range(3000)]
    rows += [(3000 + i, rows[0][1]) for i in range(400)]  # one vector many times over
    bad = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16), (9005, [1.0] * 4), (None, rows[1][1]), (9020, [0.0] * 16)]
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows + bad], "vec_id bigint, embedding array<float>, score int")
    got = defaultdict(list)
    for r in ann.search(vectors, vectors.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r["rank"]))
    want = exact(rows, [(i, v) for i, v in rows if i % 20 == 0], 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in want[q]} & {i for i, _, _ in got[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    by_id = dict(rows)
    for q, found in got.items():
        assert [r for _, _, r in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(s == pytest.approx(float(np.dot(by_id[q], by_id[i])), rel=1e-12) for i, s, _ in found)


def test_neighbours_of_few_and_of_no_vectors(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [-1.0, 0.5])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.search(one, one.filter("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(one.limit(0), one).count() == 0


# --- URL filter


def test_url_rules_and_propagation(spark):
    link = lambda *hosts: "".join(f'<a class=x href="http://{h}/p">x</a>' for h in hosts) + '<a href="/own">'
    rows = [
        (1, "http://a.org/x?q#f", None), (2, "HTTPS://WWW.Example.ORG/es/1", ""), (3, "http://example.org/en/12", "x"), (4, "http://notexample.org/en/12", None),
        (5, "http://a.com/fr/1", link("b.net")), (6, "http://b.net/1", link("c.net")), (7, "http://c.net", None), (8, "http://evil.com/de/2", None),
        (9, "http://spam.net/1", link("evil.com", "evil.com")), (10, None, "x"), (11, "no host", "x"), (12, "http://a.org", None), (13, "http://a.com?x=/fr/", None), (1, "http://a.org/x?q#f", None),
    ]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id bigint, url string, html string, host string")
    got = {r.page_id: r for r in urlfilter.judge(pages).collect()}
    assert urlfilter.judge(pages).count() == len(rows)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.org", "/x", "org/", "allow")
    assert (got[2].host, got[2].rule, got[2].verdict) == ("www.example.org", "example.org/es/", "block")
    assert [got[k].rule for k in (3, 4, 5, 8)] == ["example.org/en/1", "org/", "com/fr/", "com/de/"]
    assert [got[k].verdict for k in (5, 6, 7, 8, 9)] == ["allow", "allow", "allow", "block", "block"]
    assert (got[10].host, got[10].path, got[10].rule, got[10].verdict) == ("", "", None, "allow")
    assert (got[11].host, got[12].rule, got[12].path, got[13].rule, got[13].path) == ("", None, "", None, "")
    many = [*urlfilter.RULES, *((f"r{i}.test", "/", "block") for i in range(urlfilter.LITERAL_RULES))]
    assert sorted(map(str, urlfilter.judge(pages, many).collect())) == sorted(map(str, urlfilter.judge(pages).collect()))


# --- Decontamination


def covered(items, docs, window=10):
    grams = defaultdict(set)
    for name, text in items:
        w = alnum_words(b(text))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams[tuple(w[k : k + window])].add("" if name is None else str(name))
    out = []
    for i, text in docs:
        w, hit, found = alnum_words(b(text)), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[g]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def bench_items():
    t = texts()
    long = t[9].split()
    return [(0, " ".join(long[40:70])), (1, "W1 w2, w3"), (2, " ".join(long[60:75])), (3, None), (4, ""), (10, "w1 w2"), (2, "w1-w2-w3"), (None, " ".join(long[100:112])), (5, "same " * 12), (6, "a b a b a b a b a b a b")]


@pytest.mark.parametrize("block", [200_000, 12])
def test_decontamination_marks_as_brute_force_does(spark, block):
    docs = documents(spark)
    items = spark.createDataFrame(bench_items(), "item_id bigint, text string")
    got = decontam.digest(decontam.contamination(docs, items, block=block)).collect()
    assert Counter(map(tuple, got)) == Counter(covered(bench_items(), [(r.doc_id, r.text) for r in docs.collect()]))


def test_decontamination_cuts_passages_and_leaves_the_rest(spark):
    docs = documents(spark)
    items = spark.createDataFrame(bench_items(), "item_id bigint, text string")
    clean = decontam.decontaminated(docs, items)
    assert clean.columns == docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    hit = {r[0] for r in covered(bench_items(), list(before.items())) if r[2]}
    rows = clean.collect()
    assert not any(r.contaminated for r in decontam.digest(decontam.contamination(clean, spark.createDataFrame(bench_items()[:1], "item_id bigint, text string"))).collect())
    assert all(r.text == before[r.doc_id] for r in rows if r.doc_id not in hit) and {r.doc_id for r in rows} >= before.keys() - hit
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=6), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(2, 5))
def test_automaton_on_small_alphabets(items, doc, window):
    a = decontam.Automaton.of([(str(k), [x.encode() for x in w]) for k, w in enumerate(items)], window)
    hit, found = a.matches([x.encode() for x in doc])
    want, names = set(), set()
    for k, w in enumerate(items):
        for i in range(max(1, len(w) - window + 1) if w else 0):
            g = w[i : i + window]
            for j in range(len(doc) - len(g) + 1):
                if doc[j : j + len(g)] == g:
                    want |= set(range(j, j + len(g)))
                    names.add(str(k))
    assert set(np.flatnonzero(hit)) == want and {a.items[k] for k in found} == names


# --- Substring dedup


def without(rows, width):
    split = [space_words(b(t)) for t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        hit = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in hit)
        out.append((len(w), len(hit), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("width", [35, 12, 3])
def test_repeats_are_removed_exactly(spark, width):
    docs = documents(spark)
    rows = docs.collect()
    got = Counter(map(tuple, substring.digest(substring.without_repeats(docs, width)).collect()))
    assert got == Counter((r.doc_id, *w) for r, w in zip(rows, without([r.text for r in rows], width)))


def test_picked_symbols_depend_on_their_words_only():
    rng = np.random.default_rng(2)
    for _ in range(30):
        core = [b"%d" % x for x in rng.integers(0, int(rng.integers(2, 50)), 60)]
        sets = []
        for _ in range(2):
            left, right = ([b"%d" % x for x in rng.integers(0, 50, int(rng.integers(1, 40)))] for _ in range(2))
            h = np.concatenate(([np.uint64(rng.integers(1 << 60))], substring._word_hashes(left + core + right), [np.uint64(rng.integers(1 << 60))]))
            name, start, dl, dr = substring.recompress(h)
            a = 1 + len(left)
            inside = (dl >= a) & (dr <= a + len(core))
            sets.append(set(zip((start[inside] - a).tolist(), name[inside].tolist())))
            assert (np.diff(dl) >= 0).all() and (np.diff(dr) >= 0).all()
        assert sets[0] == sets[1]


# --- Token files


def test_token_files_hold_the_ids_in_order(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    extra = ["<|endoftext|>x <|startoftext|>", "É ΑΣ Σ. ΟΔΟΣ İ ŉ", "é ́x", "it's WE'LL 'S 1234", " nbsp em", "\U0001f642\U0001f642"]
    docs = documents(spark, texts() + extra).unionByName(documents(spark).filter("doc_id is null or doc_id = 9"))
    rows = sorted(((r.doc_id if r.doc_id is not None else -1), r.text) for r in docs.fillna("", ["text"]).collect())
    at, want = 0, []
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        want.append((None if i < 0 else i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    out = f"file://{tmp_path}/ids"
    got = sorted((tuple(r) for r in tokenfile.tokenised(docs, path, out).collect()), key=lambda r: r[1])
    assert got == want
    some = tokenfile.read(spark, out, F.col("doc_id") == 9)
    assert some.count() == 3 and some.first().ids == library.encode(texts()[9], add_special_tokens=False).ids + [2]
    assert "EqualTo(doc_id,9)" in some._jdf.queryExecution().toString()


# --- Token counts


def test_token_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = documents(spark)
    got = tokencount.token_counts(docs, path).collect()
    assert Counter(map(tuple, got)) == Counter((r.doc_id, len(b(r.text) or b""), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in docs.collect())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'aAbz09.|<>é "), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=4))
def test_token_counts_of_any_text(parts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = LIBRARY.setdefault(path, Tokenizer.from_file(path)) if path not in LIBRARY else LIBRARY[path]
    every = parts + ["<|endoftext|>".join(parts), " ".join(parts)]
    assert tokencount._counter(path).count([t.encode() for t in every]) == [len(library.encode(t, add_special_tokens=False).ids) for t in every]


LIBRARY: dict = {}


def test_merges_follow_the_vocabulary_file():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    rank = {tuple(m): k for k, m in enumerate(spec["model"]["merges"])}

    def plain(piece):
        symbols = [tokencount._byte_symbols()[c] for c in piece]
        while pairs := [rank[p] for p in zip(symbols, symbols[1:]) if p in rank]:
            a, c = spec["model"]["merges"][min(pairs)]
            i = 0
            while i < len(symbols) - 1:
                if symbols[i] == a and symbols[i + 1] == c:
                    symbols[i : i + 2] = [a + c]
                i += 1
        return len(symbols)

    pieces = [b"aaaaaaa", b"hello", b" the", b"x", b"mississippi" * 5, "façade".encode(), b"=" * 37]
    assert tokencount._counter(public_tokenizers.path("byte_bpe_50k.json")).merged(pieces).tolist() == list(map(plain, pieces))


# --- Empty tables


def test_empty_tables_give_empty_results(spark):
    docs = documents(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    for df in (
        simhash.near_duplicates(docs), simhash.keep_one(docs), mixing.mix(docs), quality.classify(docs, labels), licenses.scan(docs), urlfilter.judge(pages),
        decontam.digest(decontam.contamination(docs, items)), substring.digest(substring.without_repeats(docs)),
        tokenfile.tokenised(docs, public_tokenizers.path("word_bpe_49k.json")), tokencount.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")),
    ):
        assert df.count() == 0
    some = documents(spark)
    assert not any(r.contaminated for r in decontam.digest(decontam.contamination(some, items)).collect())
