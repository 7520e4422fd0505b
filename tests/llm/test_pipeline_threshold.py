import corpus_pipeline
from almanac.llm import near_dedup as N


def test_stage_links_from_a_similarity_of_80_percent(spark):
    """100 shingles a side; 89 to 91 shared ones give 0.80 to under 0.85, 87 ones 0.77."""
    rows, gone = [], set()
    for i, shared in enumerate((89, 90, 91, 89, 90, 91, 87)):
        one = [f"w{i}x{k}" for k in range(104)]
        two = one[: shared + 4] + [f"v{i}x{k}" for k in range(100 - shared)]
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
        a, b = (set(N.shingles(t).tolist()) for _, t in rows[-2:])
        assert len(a & b) == shared and len(a | b) == 200 - shared
        gone |= {2 * i + 1} if 100 * shared >= 80 * (200 - shared) else set()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert len(gone) == 6 and left == {i for i, _ in rows} - gone


def test_margin_grows_under_85_percent():
    assert N.most_flips(0.8) > N.most_flips(0.85) == 73
