import random
from collections import defaultdict

import corpus_pipeline
from almanac.llm import packing
from almanac.llm.queries import QUERIES, SQL


def make(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdeilmnorstu") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for i in range(300):
        w = [word() for _ in range(r.randint(30, 150))]
        y = int(i % 3 == 0)
        if y:
            w[5] = r.choice(["gorfin", "skulzat"])
        rows.append((i, " ".join(w), "en", f"s{i % 4}", 0, i))
        labels.append((i, 1, y))
    copy = lambda i, j: (i, rows[j][1].replace(" ", "  ", 1), "en", "s", 0, i)
    near = lambda i, j: (i, rows[j][1] + " tail", "en", "s", 0, i)
    rows += [copy(300, 1), near(301, 2), near(302, 4), (303, None, None, None, None, 1), (304, "", "de", "s", 0, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return {r[0]: r[1] for r in rows}, {i for i, _, y in labels if y}


def test_stages(spark, tmp_path):
    text, toxic = make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.dtypes, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left.append({r["doc_id"] for r in docs.collect()})
    assert len(left[0] & toxic) <= 5 and len(set(text) - toxic - left[0]) <= 5
    assert 300 not in left[1] and 304 not in left[1] and left[0] - left[1] == {300, 304} & left[0]
    assert left[1] - left[2] == {301, 302} & left[1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    sizes = defaultdict(int)
    for r in packed:
        sizes[r["doc_id"]] += r["length"]
    assert sizes == {i: len(packing.tokens(text[i])) for i in left[2]}
    again = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["piece"], r["length"]) for r in packed)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "packing"]
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11)) and set(SQL) <= set(QUERIES)
