"""SentencePiece encoding and decoding by shared-prefix search.

A text becomes marked words: blanks turn into marks, one mark goes first, and each run of marks with what
follows is a word; no piece of the vocabulary reaches over a word's end. The distinct words of a batch are
sorted, which lists their trie depth-first; the forward states of a prefix are kept while the
traversal is below it, so a common prefix is computed once.

The vocabulary is a BPE one: its scores order merges, and the path of the largest score sum is not
the tokenizer's. So a transition from the last piece of a prefix to the next piece is open only if
merging both pieces' characters gives these two back. Merging leaves one segmentation of each prefix, so the first
open transition is the only one, and the maximum over transitions needs no comparison of scores; the library's own
segmentation comes out (tested against it). Characters without a piece end such a chain and become bytes.

Defined cases: null or empty text: no ids, decoded as empty; the mark itself in a text reads back as a
blank, as with the library; repeated rows are encoded each; an empty table gives no rows; other
columns are not read."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import per_text

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words and pairs that a worker remembers before it starts anew.
REMEMBER = 500_000


class Pieces:
    def __init__(self, model: str):
        import public_tokenizers as P
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=P.path(model))
        n = sp.get_piece_size()
        self.ids, self.scores, self.bytes, self.raw, self.names = {}, [0.0] * n, [0] * 256, [b""] * n, [""] * n
        for i in range(n):
            name = self.names[i] = sp.id_to_piece(i)
            self.scores[i] = sp.get_score(i)
            if sp.is_byte(i):
                b = int(name[3:5], 16)
                self.bytes[b], self.raw[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[name] = i
                self.raw[i] = name.replace(MARK, " ").encode()
        # pieces by their last character, the one before it and so on; 0 leads to the piece itself
        self.ends: dict = {}
        for name, i in self.ids.items():
            node = self.ends
            for c in reversed(name):
                node = node.setdefault(c, {})
            node[0] = i
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The characters of a short text after all merges, best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                p = self.ids.get(parts[i] + parts[i + 1])
                if p is not None and (best is None or self.scores[p] > best):
                    best, at = self.scores[p], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def joins(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a; remembered."""
        if len(self.pairs) >= REMEMBER:
            self.pairs.clear()
        x, y = self.names[a], self.names[b]
        known = self.pairs[a << 32 | b] = self.merged(x + y) == [x, y]
        return known

    def learn(self, words: list[str]) -> None:
        """Encodes sorted distinct words into ``self.words``, as bytes of 32-bit ids."""
        root, pair, joins = self.ends, self.pairs.get, self.joins
        # for each prefix length of the current word: last piece (-1: bytes), where it starts
        last, begin = [-2], [0]
        before = ""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], begin[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                # pieces that end here, from the shortest on, until one may follow the piece before it
                node, i = root, end
                while i:
                    i -= 1
                    node = node.get(word[i])
                    if node is None:
                        i, p = end - 1, -1
                        break
                    p = node.get(0)
                    if p is not None:
                        a = last[i]
                        if a < 0:
                            break
                        known = pair(a << 32 | p)
                        if joins(a, p) if known is None else known:
                            break  # the open transition is the only one
                else:
                    i, p = end - 1, -1
                last.append(p)
                begin.append(i)
            before = word
            out, end = [], len(word)
            while end:
                start = begin[end]
                if last[end] >= 0:
                    out.append(last[end])
                else:
                    out += [self.bytes[b] for b in reversed(word[start:end].encode("utf-8", "surrogatepass"))]
                end = start
            out.reverse()
            self.words[word] = struct.pack(f"<{len(out)}I", *out)

    def encode_batch(self, texts: list) -> list[np.ndarray]:
        split = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set(chain.from_iterable(split)) - self.words.keys()
        if len(self.words) + len(new) > REMEMBER:
            self.words.clear()
            new = set(chain.from_iterable(split))
        self.learn(sorted(new))
        return [np.frombuffer(b"".join(map(self.words.__getitem__, w)), "<u4") for w in split]

    def decode(self, ids) -> str:
        out = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


_models: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    if model not in _models:
        _models[model] = Pieces(model)
    return _models[model]


def encoded(docs: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, n_ids, ids_crc32 (of unsigned little-endian 32-bit ids), decoded_sha256, same (decoded text is the text); with_ids adds ids."""

    def run(texts: list) -> list[tuple]:
        p, out = pieces(model), []
        for t, ids in zip(texts, p.encode_batch(texts), strict=True):
            back = p.decode(ids.tolist())
            out.append((len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (t or ""), *([ids.tolist()] if with_ids else [])))
        return out

    return per_text(docs, run, "n_ids long, ids_crc32 long, decoded_sha256 string, same boolean" + ", ids array<long>" * with_ids, text, key, 200)


def decoded(rows: DataFrame, model: str = "piece_bpe_32k.model", ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key, text: the texts of lists of ids; null for null."""
    return per_text(rows, lambda lists: [(None if x is None else pieces(model).decode(x),) for x in lists], "text string", ids, key)
