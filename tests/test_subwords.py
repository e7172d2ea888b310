"""Pieces of words against a plain longest match, and their mean vectors."""

import random

import numpy as np
import pytest

from inkgrove.operators import embedding as E
from inkgrove.operators import retrieval as R
from inkgrove.plans.shared import cut

PIECES = ["a", "ab", "abc", "b", "##b", "##c", "##bc", "##cab", "x", "ü", "##ß"]


def plain(word):
    out, at = [], 0
    while at < len(word):
        fit = [p for p in sorted(PIECES) if word.startswith(p[2:] if at else p, at) and p.startswith("##") == (at > 0)]
        if not fit:
            return [-1]
        best = max(fit, key=len)
        out.append(sorted(PIECES).index(best))
        at += len(best) - 2 * (at > 0)
    return out


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("".join(rng.choices("abcx", k=rng.randrange(1, 9))) for _ in range(rng.randrange(0, 12)))) for i in range(300)]
    return [*rows, (300, None), (301, ""), (302, "ABC, abcab! Üß zz"), (303, "ab " * 50000)]


def test_longest_match(spark, texts):
    pieces = E.held_pieces(spark.createDataFrame([(p,) for p in PIECES + PIECES[:3]] + [(None,)], "piece string"))
    assert pieces == sorted(PIECES)
    got = {r.id: r.ids for r in E.subword_ids(spark.createDataFrame(texts, "id long, text string").repartition(5), pieces).collect()}
    words = lambda t: (t or "").lower().replace(",", " ").replace("!", " ").split()
    assert got[302] == [*plain("abc"), *plain("abcab"), *got[302][-2:]] and got[302][-1] == -1
    assert all(got[i] == [x for w in words(t) for x in plain(w)] for i, t in texts if i != 302)


def test_mean_vectors(spark, texts):
    rng = np.random.default_rng(1)
    vectors = {p: rng.normal(size=3).tolist() for p in PIECES}
    model = cut(spark.createDataFrame(list(vectors.items()), "piece string, vector array<double>"), "model")
    got = {r.id: r for r in E.embed_subwords(spark.createDataFrame(texts, "id long, text string"), model, 3).collect()}
    order = sorted(PIECES)
    for i, t in texts:
        if i == 302:
            continue
        ids = [x for w in (t or "").split() for x in plain(w)]
        total = sum((np.array(vectors[order[x]]) for x in ids if x >= 0), np.zeros(3))
        size = np.linalg.norm(total)
        assert np.allclose(got[i].vector, total / size if size else total) and got[i].known == sum(x >= 0 for x in ids) and got[i].seen == len(ids)


def test_a_search_is_logged_within_its_run(spark):
    hits = spark.createDataFrame([("c1", "x"), ("c2", None), ("c3", "x"), ("c4", "a")], "citation string, bereich string")
    watched, row = R.logged_search(hits, "  The Query ", "key", "x")
    assert watched.count() == 4
    told = row()
    assert '"hits": 4' in told["detail"] and '"per_bereich": {"a": 1, "x": 2}' in told["detail"] and "Query" not in told["detail"] and '"requested_bereich": "x"' in told["detail"]
