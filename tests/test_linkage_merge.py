from almanac.operators import linkage


def joined(first, last, at=1818, until=1819):
    found = linkage.merge([(1.0, 1, 2)], {1: ("a", first, last), 2: ("b", at, until)})
    return found[1] == found[2]


def test_a_cluster_spans_nine_years_at_most():
    assert joined(1811, 1812) and not joined(1810, 1811)  # 1811 to 1819 are nine years


def test_no_two_spells_of_a_school_and_little_overlap():
    assert not linkage.merge([(1.0, 1, 2)], {1: ("a", 1811, 1812), 2: ("a", 1818, 1819)})[2] == 1
    assert joined(1817, 1818) and not joined(1817, 1819)


def test_clusters_are_those_of_all_edges(spark):
    """Pairs that can't share a cluster are dropped before components; the result is that of merging all edges at once."""
    import random

    r = random.Random(6)
    spans = {i: (r.choice("abcd"), y := 1800 + r.randint(0, 14), y + r.randint(0, 3)) for i in range(60)}
    edges = [(round(r.uniform(1, 9), 3), a, b) for a in range(60) for b in range(a + 1, 60) if r.random() < 0.06]
    want = linkage.merge(edges, spans)
    spell = spark.createDataFrame([(i, *s) for i, s in spans.items()], "spell_id long, school string, first_seen long, last_seen long")
    scored = spark.createDataFrame([(a, b, w, 1.0) for w, a, b in edges], "lid long, rid long, weight double, probability double")
    got = {x["spell_id"]: x["student_id"] for x in linkage.cluster(scored, spell).collect()}
    group = lambda m: sorted(sorted(i for i in m if m[i] == g) for g in set(m.values()))
    assert group(got) == group(want)
