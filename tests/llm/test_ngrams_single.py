import zlib
from collections import Counter, defaultdict

from test_ngrams import END, Plain, corpus

from almanac.llm.queries import QUERIES


class Whole(Plain):
    """The same model with all pairs and triples."""

    def __init__(self, texts):
        self.c1, self.k2, self.k3 = Counter(), Counter(), Counter()
        for t in texts:
            w = t.encode().lower().split() + [END]
            x = [END, *w]
            self.c1.update(w)
            self.k2.update(zip(x, x[1:], strict=False))
            self.k3.update(zip(x, x[1:], x[2:], strict=False))
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        self.d2, self.d3 = self.discount(self.k2), self.discount(self.k3)
        self.b2, self.b3 = defaultdict(float), defaultdict(float)
        for (u, _), n in self.k2.items():
            self.b2[u] += n - self.d2
        for (u, v, _), n in self.k3.items():
            self.b3[u, v] += n - self.d3


def test_query_holds_pairs_and_triples_seen_once(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    train = [t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    whole, cut, text = Whole(train), Plain(train), dict(rows)
    apart = 0
    for r in QUERIES["op4_lm_scoring"](spark, str(tmp_path)).collect():
        n, _, _, score = whole.score(text[r["doc_id"]] or "")
        assert abs(r["score"] - score) < 3e-4 * n
        apart += abs(cut.score(text[r["doc_id"]] or "")[3] - score) > 3e-4 * n
    assert apart > 100
