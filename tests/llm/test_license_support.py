from almanac.llm import license_scan as L

NOTICES = {n: L.TEMPLATES[n][0] for n in ("gpl-3", "bsd", "mpl-2", "unlicense", "agpl-3")}


def labels(spark, rows):
    return {r["doc_id"]: r["labels"] for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_a_notice_in_a_third_of_the_rows(spark):
    for name in ("gpl-3", "bsd"):
        rows = [(i, f"file {i} {NOTICES[name]} end" if i < 10 else f"plain number {i} of the common kind") for i in range(30)]
        assert labels(spark, rows) == {i: name if i < 10 else "" for i, _ in rows}


def test_two_notices_and_strewn_words(spark):
    """Two notices in one file keep both labels; words of other licences strewn over a long file take none away."""
    both = f"{NOTICES['bsd']} and else {NOTICES['mpl-2']}"
    strewn = " some text ".join("redistribution mozilla unencumbered affero sharealike attribution commons binary forms domain".split())
    long = f"{strewn} {'word ' * 3000}{NOTICES['gpl-3']} {'word ' * 3000}{strewn}"
    rows = [(1, both), (2, long), (3, f"{NOTICES['unlicense']} {both}"), *[(10 + i, f"t{i} {n}") for i, n in enumerate(NOTICES.values())], *[(100 + i, f"plain {i}") for i in range(60)]]
    got = labels(spark, rows)
    assert got[1] == "bsd,mpl-2" and got[2] == "gpl-3" and got[3] == "bsd,mpl-2,unlicense"
    assert [got[10 + i] for i in range(len(NOTICES))] == list(NOTICES) and all(got[100 + i] == "" for i in range(60))


def test_support_against_a_plain_loop(spark):
    import random

    r, passage = random.Random(3), "the old and the new of the far and near by the sea"
    idf = {w: r.uniform(0.1, 3) for w in set(passage.split())}
    words = passage.split()
    rows = [[r.choice([*words, "x", "y"]) for _ in range(r.randint(0, 30))] for _ in range(40)] + [["x", *words]]
    rare = sorted(idf, key=lambda w: (-idf[w], w))[: L.TOP]
    out = spark.createDataFrame([(i, w) for i, w in enumerate(rows)], "i int, words array<string>").select("i", L.support(passage, idf).alias("s")).orderBy("i").collect()
    for row, got in zip(rows, out, strict=True):
        best = max(sum(idf[w] for w in rare if any(w == a == b and j - i == by for i, a in enumerate(words) for j, b in enumerate(row))) for by in range(-len(words), len(row) + 1))
        assert abs(got["s"] - min(1, best / sum(idf[w] for w in rare))) < 1e-9
