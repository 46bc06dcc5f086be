"""Coverage of a template by spans of several diagonals."""

from veilmark.llm import licenses


def test_a_repeated_run_does_not_cover_a_template(spark):
    texts = ["of the software a b c d e " * 30, licenses.TEMPLATES["mit"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[0].labels == "" and got[0].score < licenses.COVERAGE
    assert got[1].labels == "mit" and got[1].score == 1.0


def test_work_is_linear_in_the_text(spark):
    import time

    def took(n):
        text = " ".join(f"w{k % 1000}" for k in range(n)) + " under the mit license"
        docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        began = time.time()
        (row,) = licenses.scan(docs).collect()
        assert (row.n_words, row.n_base, row.first_word, row.labels) == (n + 4, 1, n, "mit")
        return time.time() - began

    took(1000)
    few, many = took(100_000), took(1_000_000)
    assert many < 10 * few + 10
