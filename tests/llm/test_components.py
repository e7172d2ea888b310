"""Components against a plain version, and what the plans of the near-copy stage ask of the driver."""

import random

from inkgrove.llm.components import components
from inkgrove.llm.jaccard import near_duplicates
from inkgrove.plans.shared import cut, scratch


def plain(edges):
    label = {}
    for u, v in edges:
        if u != v:
            label.setdefault(u, u), label.setdefault(v, v)
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            if u != v and label[u] != label[v]:
                label[u] = label[v] = min(label[u], label[v])
                changed = True
    return label


def exchanges(spark, run):
    """Of each execution of run(): its broadcasts and its shuffles."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    done = store.executionsList()
    found = []
    for i in range(before, done.size()):
        nodes = store.planGraph(done.apply(i).executionId()).allNodes()
        names = [nodes.apply(k).name() for k in range(nodes.size())]
        found.append((names.count("BroadcastExchange"), names.count("Exchange")))
    return found


def test_components_equal_plain_version(spark):
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(40)]
    rng.shuffle(path)
    shapes = [
        [],
        [(1, 1)],
        [(5, 2), (2, 5), (5, 2)],
        path,
        [(1000, i) for i in range(30)] + [(i, 2000) for i in range(30, 60)] + [(29, 30), (7, 7)],
        [(rng.randrange(200), rng.randrange(200)) for _ in range(130)],
    ]
    for edges in shapes:
        with scratch(spark):
            found = components(cut(spark.createDataFrame(edges, "u bigint, v bigint"), "edges")).collect()
        assert len(found) == len({r.node for r in found})
        assert {r.node: r.label for r in found} == plain(edges)


def test_components_hold_no_broadcast_and_few_shuffles_at_once(spark):
    with scratch(spark):
        edges = cut(spark.createDataFrame([(i, i + 1) for i in range(20)], "u bigint, v bigint"), "edges")
        found = exchanges(spark, lambda: components(edges).collect())
    assert max(b for b, _ in found) == 0
    assert max(x for _, x in found) <= 3


def test_near_copies_plan_few_exchanges_at_once(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(4, 60, 2)] + [f"other text {i} of some six words" for i in range(30)]
    with scratch(spark):
        docs = cut(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "docs")
        found = exchanges(spark, lambda: near_duplicates(docs).collect())
    assert len(found) > 10
    assert max(b + x for b, x in found) <= 7
