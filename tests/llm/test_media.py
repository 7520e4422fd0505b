import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from almanac.llm import media, webp


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=2000))
def test_round_trip(text):
    raw = text.encode()
    payload = media.load(media.store(text))
    assert len(payload) % 576 == 0 and len(payload) >= 576 and payload == raw + b"\xff" * (len(payload) - len(raw))
    assert len(payload) - len(raw) < 576 or not raw


def test_more_rows_than_one_image_has():
    text = "z9" * 4_800_000
    assert media.load(media.store(text))[: len(text)] == text.encode()


def stream(bits: webp.Writer, head: webp.Writer | None = None) -> bytes:
    raw = bits.value.to_bytes((bits.at + 7) // 8 + 8, "little")
    return b"RIFF" + struct.pack("<I", 12 + len(raw)) + b"WEBPVP8L" + struct.pack("<I", len(raw)) + raw


def code(w, code, n):
    """A prefix code, whose first bit is the most significant."""
    w.put(int(f"{code:0{n}b}"[::-1], 2) if n else 0, n)


def canonical(lengths):
    """symbol -> (code, length)."""
    code, last, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[s] = (code, n)
        code, last = code + 1, n
    return out


def flat_codes(w):
    """Green, red and blue with flat 8-bit codes, alpha 255 and distance 0 with no bits."""
    w.put(0, 1)  # a normal code for green; its length symbols 8 and 18 take one bit each
    w.put(15, 4)
    for s in webp.LENGTH_ORDER:
        w.put(int(s in (8, 18)), 3)
    w.put(0, 1)
    w.put(0, 256)  # 256 times length 8
    w.put(1, 1)
    w.put(24 - 11, 7)  # 24 times length 0
    for _ in range(2):
        w.put(0, 1)
        w.put(15, 4)
        for s in webp.LENGTH_ORDER:
            w.put(int(s == 8), 3)
        w.put(0, 1)
    w.put(0b101 | 255 << 3, 11)
    w.put(0b0001, 4)


def start(width, height):
    w = webp.Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    return w


def simple(w, *symbols):
    w.put(1, 1)
    w.put(len(symbols) - 1, 1)
    w.put(1, 1)
    for s in symbols:
        w.put(s, 8)


def lengths_code(w, lengths):
    """A normal code, its lengths written with a flat code of 5 bits' worth of symbols 0..15."""
    w.put(0, 1)
    w.put(15, 4)
    for s in webp.LENGTH_ORDER:
        w.put(4 if s < 16 else 0, 3)
    w.put(0, 1)
    for n in lengths:
        code(w, n, 4)


def test_back_references_and_colour_cache():
    # green: literals 1 and 2, length symbol 256+1 (length 2) and cache entry; two bits each
    w = start(4, 2)
    w.put(0, 1)  # no transform
    w.put(1, 1)
    w.put(1, 4)  # a cache of two colours
    w.put(0, 1)
    green = [0] * 282
    argb = lambda g: 255 << 24 | 7 << 16 | g << 8 | 9
    slot = lambda g: (argb(g) * 0x1E35A7BD & 0xFFFFFFFF) >> 31
    for s in (1, 2, 257, 280 + slot(1)):
        green[s] = 2
    lengths_code(w, green)
    for s in (7, 9, 255):
        simple(w, s)
    # distances: codes 2 (the pixel to the left) with one symbol
    simple(w, 1)
    codes = canonical(green)
    for s in (1, 2, 257, 257, 280 + slot(1), 2):
        code(w, *codes[s])
    image, _ = webp.decode(stream(w))
    got = ((image >> 8) & 255).reshape(-1).tolist()
    assert got[:6] == [1, 2, 2, 2, 2, 2]
    cached = 1 if slot(1) != slot(2) else 2
    assert got[6:] == [cached, 2]
    assert ((image >> 16) & 255 == 7).all() and (image & 255 == 9).all()


def flat(w, pixels):
    """Pixels (argb) with flat codes for green, red, blue and one alpha."""
    w.put(0, 2)
    flat_codes(w)
    for p in pixels:
        for shift in (8, 16, 0):
            code(w, p >> shift & 255, 8)


def block(w, values, at):
    """A transform image of one colour channel value."""
    w.put(0, 1)
    for s in (values if at == 8 else 0, values if at == 16 else 0, values if at == 0 else 0, 255):
        simple(w, s)
    simple(w, 0)


@pytest.mark.parametrize("mode", range(14))
def test_predictors_invert_a_forward_model(mode):
    rng = np.random.default_rng(mode)
    width, height = 5, 4
    image = rng.integers(0, 256, (height, width, 4))  # b g r a
    image[:, :, 3] = 255
    rest = np.zeros_like(image)
    for y in range(height):
        for x in range(width):
            at = lambda v, u: image[v, u].tolist()
            if y == 0:
                by = at(0, x - 1) if x else [0, 0, 0, 255]
            elif x == 0:
                by = at(y - 1, 0)
            else:
                by = webp.predicted(mode, at(y, x - 1), at(y - 1, x), at(y - 1, x - 1), at(y - 1, x + 1) if x + 1 < width else at(y, 0))
            rest[y, x] = (image[y, x] - by) & 255
    packed = rest.astype(np.uint8).reshape(-1, 4).copy().view(np.uint32).reshape(-1)
    out = webp.undo_predictor(packed, width, height, 3, np.array([mode << 8], np.uint32))
    assert (out.view(np.uint8).reshape(height, width, 4) == image).all()


def test_colour_transforms():
    pixels = np.random.default_rng(1).integers(0, 1 << 32, 12, dtype=np.uint32)
    green = (pixels >> 8) & 255
    less = (pixels & np.uint32(0xFF00FF00)) | (((pixels >> 16) - green) & 255) << 16 | ((pixels - green) & 255)
    assert (webp.undo_green(less) == pixels).all()
    signed = lambda a: ((a & 255) ^ 128) - 128
    r2b, g2b, g2r = 5, -7, 33
    own = pixels.astype(np.int64)
    g, r = signed(own >> 8), own >> 16 & 255
    moved = (own & 0xFF00FF00) | ((r - (g2r * g >> 5)) & 255) << 16 | (((own & 255) - (g2b * g >> 5) - (r2b * signed(r) >> 5)) & 255)
    data = np.array([(r2b & 255) << 16 | (g2b & 255) << 8 | (g2r & 255)], np.uint32)
    assert (webp.undo_cross_colour(moved.astype(np.uint32), 4, 3, 5, data) == pixels).all()


def test_palette_with_packed_pixels_in_a_stream():
    w = start(5, 2)
    w.put(1, 1)
    w.put(3, 2)
    w.put(1, 8)  # two colours, as steps: 0xFF000010 and one more green
    flat_colours = [0xFF000010, 0x00000300]
    w.put(0, 1)
    simple(w, 0, 3)
    simple(w, 0)
    simple(w, 16, 0)
    simple(w, 255, 0)
    simple(w, 0)
    for g, b, a in ((0, 16, 255), (3, 0, 0)):
        codes = [canonical([1 if s in pair else 0 for s in range(256)]) for pair in ((0, 3), (16, 0), (255, 0))]
        for c, v in zip(codes, (g, b, a), strict=True):
            code(w, *c[v])
    w.put(0, 1)  # no more transforms
    w.put(0, 2)
    simple(w, 0b10110, 0b01001)  # eight pixels in a green sample, five of them used
    simple(w, 0)
    simple(w, 0)
    simple(w, 255)
    simple(w, 0)
    code(w, 1, 1)  # the larger symbol has code 1
    code(w, 0, 1)
    image, _ = webp.decode(stream(w))
    bits = [0b10110 >> i & 1 for i in range(5)], [0b01001 >> i & 1 for i in range(5)]
    assert image.tolist() == [[0xFF000310 if b else 0xFF000010 for b in row] for row in bits]
    assert flat_colours


def test_meta_prefix_image():
    w = start(8, 4)
    w.put(0, 1)
    w.put(0, 1)
    w.put(1, 1)
    w.put(0, 3)  # tiles of four pixels: two codes side by side
    w.put(0, 1)
    simple(w, 0, 1)
    for s in (0, 0, 255):
        simple(w, s)
    simple(w, 0)
    code(w, 0, 1)
    code(w, 1, 1)
    for g in (11, 22):
        simple(w, g)
        for s in (1, 2, 255):
            simple(w, s)
        simple(w, 0)
    image, _ = webp.decode(stream(w))
    green = (image >> 8) & 255
    assert (green[:, :4] == 11).all() and (green[:, 4:] == 22).all()


def test_bad_streams():
    good = media.store("abc")
    with pytest.raises(ValueError):
        webp.decode(b"RIFX" + good[4:])
    with pytest.raises(ValueError):
        webp.decode(good[: len(good) // 2])


def test_query_rows(spark):
    rows = [(1, "héllo", 1), (2, None, 2), (3, "", 3), (None, "héllo", 4), (2**60 + 1, "x" * 100_000, 5), (1, "héllo", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature int")
    out = media.media_columns(df, with_media=True).collect()
    assert sorted((r["doc_id"] or -1) for r in out) == sorted((r[0] or -1) for r in rows)
    assert len({tuple(r)[1:] for r in out if r["n_bytes"] == 6}) == 1
    for r in out:
        payload = media.load(bytes(r["media"]))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(bytes(r["media"])).hexdigest())
    assert media.media_columns(df.limit(0)).count() == 0


def kinds(media_bytes):
    """What an image's stream holds: its transforms, and whether cache and back-references occur."""
    bits = webp.Bits(media_bytes[20:])
    bits.read(40)
    found = []
    seen = {"copy": False, "cache": False}
    while bits.read(1):
        kind = bits.read(2)
        found.append(kind)
        if kind in (0, 1):
            bits.read(3)
            webp.read_image(bits, 1, 1, False)
        elif kind == 3:
            webp.read_image(bits, bits.read(8) + 1, 1, False)
    seen["cache"] = bool(bits.peek(1))
    return found, seen


def test_the_writer_uses_what_helps(monkeypatch):
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvwz") for _ in range(r.randint(2, 9)))
    prose = " ".join(word() for _ in range(600))
    plain, repeated, few = prose, (prose[:499] + "\n") * 9, "ab" * 3000
    triples = "".join(r.choice(["abc", "def", "ghi", "jkl", "mno", "pqr", "stu", "vwx"]) for _ in range(3000))
    steps, at = [], 70
    for _ in range(4000):
        at = min(120, max(33, at + r.choice([-1, 0, 1])))
        steps.append(chr(at))
    ramp = "".join(steps)
    copies = []
    real = webp.copy
    monkeypatch.setattr(webp, "copy", lambda *a: (copies.append(1), real(*a))[1])
    for text, transforms, copied, cached in ((plain, [1], False, False), (repeated, [1], True, False), (few, [3], True, False), (triples, [3], None, False), (ramp, [0, 1], None, False)):
        copies.clear()
        stored = media.store(text)
        assert media.load(stored)[: len(text)] == text.encode()
        found, seen = kinds(stored)
        assert found == transforms or text is triples, (text[:20], found)
        assert copied is None or bool(copies) == copied, text[:20]
        assert len(stored) < 0.75 * len(text)


def test_literals_by_deflate_are_those_of_the_symbol_loop(monkeypatch):
    import random

    r = random.Random(9)
    texts = ["".join(chr(r.randint(32, 32 + k)) for _ in range(r.randint(1, 4000))) for k in (20, 40, 90, 400, 5000) for _ in range(4)]
    stored = [media.store(t) for t in texts]
    quick = [media.load(m) for m in stored]
    monkeypatch.setattr(webp, "literals", lambda *a: None)
    assert [media.load(m) for m in stored] == quick
    assert all(q[: len(t.encode())] == t.encode() for q, t in zip(quick, texts, strict=True))


def test_rgb_images_with_a_colour_cache():
    rng = np.random.default_rng(3)
    colours = rng.integers(0, 256, (700, 3), dtype=np.uint8)
    image = colours[rng.zipf(1.3, 30 * 192) % 700].reshape(-1)
    stored = webp.encode(image, 192)
    assert kinds(stored)[1]["cache"]
    back, _ = webp.decode(stored)
    assert (back.reshape(-1).view(np.uint8).reshape(-1, 4)[:, 2::-1].reshape(-1) == image).all()
