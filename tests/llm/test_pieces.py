import hashlib
import random
import zlib

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path

from almanac.llm import pieces as P

SP = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8", exclude_characters="\0"), st.sampled_from("abcdeinrst  ▁\n")), max_size=80))
def test_ids_and_text_are_the_librarys(text):
    (ids,) = P.pieces("piece_bpe_32k.model").encode_batch([text])
    assert ids.tolist() == SP.encode(text)
    assert P.pieces("piece_bpe_32k.model").decode(ids.tolist()) == SP.decode(SP.encode(text))


def test_many_words():
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("aeionrstldhmuc") for _ in range(r.randint(1, 14))) for _ in range(80)) for _ in range(80)]
    texts += ["internationalisation  antidisestablishmentarianism", "x = {'a': [1, 2, 3]}\n\tpass", "aaaa" * 300]
    got = P.pieces("piece_bpe_32k.model").encode_batch(texts)
    assert [g.tolist() for g in got] == SP.encode(texts)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(P, "REMEMBER", 5)
    p = P.Pieces("piece_bpe_32k.model")
    texts = ["the quick brown fox jumps over the lazy dog", "the slow brown fox", "", None]
    assert [g.tolist() for g in p.encode_batch(texts)] == [*SP.encode(texts[:2]), [], []]


def test_query(spark):
    rows = [(1, "hello  wörld", "x"), (2, None, "y"), (None, "", "z"), (3, "▁mark", "m"), (1, "hello  wörld", "x"), (4, "long " * 40_000, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, same string")
    out = P.encoded(df, with_ids=True)
    text = dict((i, t) for i, t, _ in rows)
    for r in out.collect():
        ids = SP.encode(text[r["doc_id"]] or "")
        assert r["ids"] == ids and r["n_ids"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r["same"] == (r["doc_id"] != 3) and r["decoded_sha256"] == hashlib.sha256(SP.decode(ids).encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in P.decoded(out.select("doc_id", "ids")).collect()}
    assert back == {1: "hello  wörld", 2: "", None: "", 3: " mark", 4: "long " * 40_000}
    assert P.encoded(df.limit(0)).count() == 0
