"""Propagation of trust and distrust until it has settled."""

import numpy as np
import pytest

from veilmark.llm import urlfilter


def test_distrust_reaches_hosts_many_links_away(spark):
    n = 15
    rows = [(k, f"http://h{k}.x/", f'<a href="http://h{k + 1}.x/">') for k in range(n)] + [(n, f"http://h{n}.x/", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = urlfilter.judge(pages, [(f"h{n}.x", "/", "block")]).collect()
    assert {r.page_id: r.verdict for r in got} == dict.fromkeys(range(n + 1), "block")


def test_pages_without_links_do_not_change_normalised_verdicts(spark):
    link = lambda to: f'<a href="https://{to}/">x</a>'
    rows = [("https://good.org/", link("mid.net")), ("https://mid.net/", link("www.bad.com")), ("https://www.bad.com/de/1", "")]
    more = rows + [(f"https://www.bad.com/de/{k}", "") for k in range(2, 6)]
    verdicts = lambda pages, **options: {r.host: r.verdict for r in urlfilter.judge(spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id long, url string, html string"), **options).collect()}
    assert verdicts(rows)["mid.net"] == "allow" and verdicts(more)["mid.net"] == "block"  # seeds are numbers of pages
    assert verdicts(more, normalised=True)["mid.net"] == verdicts(rows)["mid.net"]


def test_sums_over_hosts_stand_for_mass_given_back(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("d", "a", 1)]  # c has no links: what reaches it is lost
    frame = spark.createDataFrame(edges, "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", 3.0, 0.0), ("d", 1.0, 0.0)], "host string, good double, bad double")
    got = {r.host: r.trust for r in urlfilter.propagate(seeds, frame).collect()}
    hosts, start = "abcd", np.array([0.75, 0.0, 0.0, 0.25])
    moves = np.zeros((4, 4))
    for s, t, n in edges:
        moves[hosts.index(t), hosts.index(s)] = n / sum(m for x, _, m in edges if x == s)
    moves[:, 2] = start  # a host without links goes back to the seeds
    x = np.linalg.solve(np.eye(4) - urlfilter.DAMPING * moves, (1 - urlfilter.DAMPING) * start)
    assert [got[h] / sum(got.values()) for h in hosts] == pytest.approx(x.tolist(), abs=1e-6)


def test_one_host_that_everything_links_to(spark):
    pages = [(k, f"https://h{k}.example.net/", '<a href="https://hub.io/">x</a>') for k in range(3000)] + [(9000, "https://hub.io/", ""), (9001, "https://a.org/", '<a href="https://hub.io/">x</a>')]
    rows = urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(rows) == 3002 and {r.verdict for r in rows} == {"allow"}
