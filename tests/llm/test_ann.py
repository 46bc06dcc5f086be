"""Nearest neighbours of the embeddings table against all inner products; codebooks by the table's rows."""

import numpy as np

from veilmark.llm import ann, queries

SF = "/root/testdata/sf0.1"


def test_recall_on_embeddings(spark):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").filter(ann.usable("embedding")).collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    found = {}
    for r in queries.QUERIES["op5_nearest_vectors"](spark, SF).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = np.flatnonzero(ids % 20 == 0)
    assert set(found) == set(ids[asked].tolist())
    at, hits = {int(i): k for k, i in enumerate(ids)}, 0
    for k in asked:
        mine = sorted(found[int(ids[k])])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(s == np.einsum("ij,ij->i", x[[k]], x[[at[i]]])[0] for _, i, s in mine)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        score = x @ x[k]
        score[k] = -np.inf
        hits += len({i for _, i, _ in mine} & set(ids[np.argsort(-score)[:20]].tolist()))
    assert hits >= 0.95 * 20 * len(asked)


def test_codebooks_grow_with_the_table_up_to_a_bound():
    sizes = [ann.centroids_for(n) for n in (0, 1, 500, 4_096, 16_384, 51_282, 1_000_000, 10**12)]
    assert sizes == [1, 1, 11, 32, 32, 56, 250, 256]
