"""The component search against union-find, and how many jobs it and a join without open lists give the driver to plan."""

import random

from engram.llm import set_join, sparktools


def jobs(spark, group, run):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return out, len(sc.statusTracker().getJobIdsForGroup(group))


def brute(edges):
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return label


def test_components_of_random_graphs_chains_and_a_star(spark):
    rng = random.Random(3)
    names = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(400)]
    edges = [(names[rng.randrange(150)], names[rng.randrange(150)]) for _ in range(90)]
    edges += [(names[i], names[i + 1]) for i in range(200, 240)] + [(names[300], names[i]) for i in range(301, 400)]
    edges += [(b, a) for a, b in edges[:20]] + [(5, 5)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    kept = {r.id: r.label for r in sparktools.connected_components(frame).collect()}
    with sparktools.Scratch(spark) as scratch:
        stored = {r.id: r.label for r in sparktools.connected_components(frame, scratch).collect()}
    assert kept == stored == brute(edges)


def test_components_of_no_edges(spark):
    assert sparktools.connected_components(spark.createDataFrame([(1, 1)], "src long, dst long")).collect() == []


def test_a_search_and_a_join_take_few_jobs(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "src long, dst long")
    found, n = jobs(spark, "components", lambda: sparktools.connected_components(chain))
    assert {r.label for r in found.collect()} == {0}
    docs = spark.createDataFrame([(i, f"the same words of text number {i // 2} follow one another here " + ("and end " * (i % 2))) for i in range(40)], "doc_id long, text string")
    out, m = jobs(spark, "join", lambda: set_join.joined_sets(docs))
    assert out.count() == 40
    # 88 and 158 when a round took two checkpoint jobs and a join, and all rounds of lists ran
    assert n <= 60 and m <= 125, (n, m)
