"""Lossless WebP (VP8L): a writer for 8-bit samples and a decoder of the whole format.

Writer: a palette where an image has few colours; else the top or left predictor and the cross-colour
transform where they lower the samples' entropy. Pixels become back-references to earlier runs, colour
cache codes and literals, under prefix codes made from their counts.

Decoder: simple and normal prefix codes, meta prefix images, back-references with the two-dimensional
distance map, the colour cache; inverts predictor, cross-colour, subtract-green and palette transforms. Symbols are
looked up by nine bits, longer ones in a whole table; images of grey samples or indexes are built as bytes, whose
back-references are slices. Prefix codes are those of Deflate, bit for bit, so a run of literals alone, which the writer makes where
back-references would not pay, is handed to zlib under a Deflate head with the same code lengths. Transforms are inverted for all pixels at once where they are the same for the whole image.

Format facts follow the public "WebP Lossless Bitstream Specification"."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left

import numpy as np

SIDE = 16_384  # most pixels of a side
#: Fixed values of the format: the order in which lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: (x, y) of the 120 short distance codes.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + 4 + (n >> 3)], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the bitstream ends early")
        out = self.peek(n)
        self.at += n
        return out


class Writer:
    """Writes bits, least significant first."""

    def __init__(self) -> None:
        self.value, self.at = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n


_turned: dict[int, np.ndarray] = {}


def turned(width: int) -> np.ndarray:
    """Each number under 2 ** width with its bits in reverse order."""
    if width not in _turned:
        out = np.zeros(1, np.int64)
        for _ in range(width):
            out = np.concatenate([out << 1, out << 1 | 1])
        _turned[width] = out
    return _turned[width]


def spelled(lengths) -> tuple[np.ndarray, np.ndarray]:
    """The code (least significant bit first, as it is written) and its length for each symbol; no bits for an only symbol."""
    lengths = np.asarray(lengths, np.int64)
    codes, used = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths)
    if len(used) < 2:
        return codes, np.zeros(len(lengths), np.int64)
    used = used[np.argsort(lengths[used], kind="stable")]
    n, top = lengths[used], int(lengths[used[-1]])
    ends = np.cumsum(1 << (top - n))  # of the symbols' shares of all words of ``top`` bits
    codes[used] = turned(top)[ends - (1 << (top - n))]
    return codes, lengths


#: Bits of the short tables.
SHORT = 9


class Prefix:
    """A prefix code as tables by the next bits: symbol << 4 | length for SHORT bits (0 where the code is longer), and whole."""

    #: Where the code's lengths stand in the stream, under which code; and whether symbol 256 has a code.
    stored: tuple | None = None
    ends = False

    def __init__(self, lengths):
        lengths = np.asarray(lengths, np.int64)
        used = np.flatnonzero(lengths)
        self.only = int(used[0]) if len(used) == 1 else None
        if self.only is not None:
            return
        used = used[np.argsort(lengths[used], kind="stable")]
        own = lengths[used]
        self.width = int(own[-1]) if len(own) else 0
        share = 1 << (self.width - own)
        if not len(used) or int(share.sum()) != 1 << self.width:
            raise ValueError("an incomplete prefix code")
        self.whole = np.repeat(used << 4 | own, share)[turned(self.width)]
        part = self.whole[: 1 << SHORT]
        if self.width > SHORT:
            part = np.where(part & 15 <= SHORT, part, 0)
        self.short, self.mask = part.tolist(), len(part) - 1

    @classmethod
    def single(cls, symbol: int) -> Prefix:
        out = cls.__new__(cls)
        out.only = symbol
        return out

    def long(self, word: int) -> int:
        return int(self.whole[word & ((1 << self.width) - 1)])

    def next(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        word = bits.peek(15)
        e = self.short[word & self.mask] or self.long(word)
        bits.at += e & 15
        if bits.at > bits.end:
            raise ValueError("the bitstream ends early")
        return e >> 4


_kept: dict[tuple, Prefix] = {}


def kept_prefix(lengths: tuple) -> Prefix:
    """A code for code lengths; few of them occur, so they are kept."""
    if lengths not in _kept:
        if len(_kept) > 1000:
            _kept.clear()
        _kept[lengths] = Prefix(lengths)
    return _kept[lengths]


def read_prefix(bits: Bits, size: int) -> Prefix:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        if not two:
            return Prefix.single(first)
        lengths = [0] * max(size, 256)
        lengths[first] = lengths[bits.read(8)] = 1
        return Prefix(lengths)
    own = [0] * 19
    n = 4 + bits.read(4)
    stored = bits.read(3 * n)
    for i in range(n):
        own[LENGTH_ORDER[i]] = stored >> 3 * i & 7
    code, begin = kept_prefix(tuple(own)), bits.at + 1
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths, last, data, at, number = [], 8, bits.data, bits.at, int.from_bytes
    short, mask = ([code.only << 4], 0) if code.only is not None else (code.short, code.mask)
    word = spare = 0  # the next bits, and how many of them are good
    while len(lengths) < size and left:
        left -= 1
        if spare < 16:
            word = number(data[at >> 3 : (at >> 3) + 48], "little") >> (at & 7)
            spare = 376
        e = short[word & mask]
        s, n = e >> 4, e & 15
        word >>= n
        if s < 16:
            lengths.append(s)
            last = s or last
        else:
            value, many, extra = (last, 3 + (word & 3), 2) if s == 16 else (0, 3 + (word & 7), 3) if s == 17 else (0, 11 + (word & 127), 7)
            word >>= extra
            n += extra
            lengths += [value] * many
        at += n
        spare -= n
    if len(lengths) > size:
        raise ValueError("code lengths run over")
    if at > bits.end:
        raise ValueError("the bitstream ends early")
    bits.at = at
    out = Prefix(lengths + [0] * (size - len(lengths)))
    if size == 280 and len(lengths) == size and left >= 0 and code.only is None:
        out.stored = (tuple(own), begin, at)  # all lengths, as they stand in the stream
        out.ends = len(lengths) > 256 and lengths[256] > 0
    return out


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """width * height pixels as uint32 ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    meta, tile = None, 0
    if main and bits.read(1):
        tile = 2 + bits.read(3)
        across = -(-width >> tile)
        meta = (read_image(bits, across, -(-height >> tile), False) >> 8) & 0xFFFF
    groups = [[read_prefix(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(1 if meta is None else int(meta.max()) + 1)]
    n = width * height
    g = groups[0]
    if meta is None and all(c.only is not None for c in g[:4]) and g[0].only < 256:
        return np.full(n, g[3].only << 24 | g[1].only << 16 | g[0].only << 8 | g[2].only, np.uint32)
    if meta is None and not cache_bits and all(c.only is not None for c in g[1:4]):
        found = literals(bits, g, n) if main else None
        return grey_pixels(bits, g, n, width) if found is None else found
    out: list[int] = []
    cache, cached = [0] * (1 << cache_bits), 0
    green, red, blue, alpha, far = g
    short, data, at, number = near(width), bits.data, bits.at, int.from_bytes
    while len(out) < n:
        if meta is not None:
            here = len(out)
            green, red, blue, alpha, far = groups[meta[(here // width >> tile) * across + (here % width >> tile)]]
        word = number(data[at >> 3 : (at >> 3) + 24], "little") >> (at & 7)  # as much as a symbol with all that belongs to it takes
        before, e = word, 0
        if green.only is not None:
            s, used = green.only, 0
        else:
            e = green.short[word & green.mask] or green.long(word)
            s, used = e >> 4, e & 15
        if s < 256:
            colour = s << 8
            for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
                if code.only is not None:
                    colour |= code.only << shift
                else:
                    word = before >> used
                    e = code.short[word & code.mask] or code.long(word)
                    colour |= e >> 4 << shift
                    used += e & 15
            out.append(colour)
        elif s < 280:
            length, used = number_of(s - 256, before, used)
            if far.only is not None:
                s = far.only
            else:
                word = before >> used
                e = far.short[word & far.mask] or far.long(word)
                s = e >> 4
                used += e & 15
            code, used = number_of(s, before, used)
            copy(out, code - 120 if code > 120 else short[code], length, n)
        else:
            for colour in out[cached:]:  # pixels enter the cache in order, up to here
                cache[(colour * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = colour
            cached = len(out)
            out.append(cache[s - 280])
        at += used
        if at > bits.end:
            raise ValueError("the bitstream ends early")
    bits.at = at
    return np.array(out, np.uint32)


#: Fixed values of Deflate: the order in which it stores the lengths of the code-length code.
DEFLATE_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)


def literals(bits: Bits, g: list, n: int) -> np.ndarray | None:
    """n grey pixels that are all literals, the last thing in the stream; None where they aren't, or Deflate can't say it.

    Symbol 256 alone of those after the literals has a code: Deflate's end, which nothing here reaches."""
    green = g[0]
    if not green.stored or not green.ends or int(green.whole.max()) >> 4 != 256:
        return None
    own, begin, end = green.stored
    codes, sizes = spelled(own)
    if not sizes[0]:
        return None
    head = Writer()
    head.put(0b101, 3)  # the last block, with codes of its own
    head.put(280 - 257, 5)
    head.put(0, 5)
    head.put(15, 4)
    for s in DEFLATE_ORDER:
        head.put(own[s], 3)
    raw = int.from_bytes(bits.data[begin >> 3 : (end >> 3) + 1], "little") >> (begin & 7)
    head.put(raw & ((1 << (end - begin)) - 1), end - begin)
    head.put(int(codes[0]), int(sizes[0]))  # one distance, of no bits
    rest = int.from_bytes(bits.data[bits.at >> 3 :], "little") >> (bits.at & 7)
    size = head.at + bits.end - bits.at
    out = zlib.decompressobj(-15).decompress((head.value | rest << head.at).to_bytes((size >> 3) + 2, "little"), n)
    if len(out) < n:
        raise ValueError("the bitstream ends early")
    bits.at = bits.end
    return np.frombuffer(out, np.uint8).astype(np.uint32) << np.uint32(8) | np.uint32(g[3].only << 24 | g[1].only << 16 | g[2].only)


def number_of(s: int, word: int, used: int) -> tuple[int, int]:
    """A length or distance from its prefix symbol and the bits of word after the first ``used``; the bits used then."""
    if s < 4:
        return s + 1, used
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + (word >> used & ((1 << extra) - 1)) + 1, used + extra


def copy(out, back: int, length: int, n: int) -> None:
    """Adds ``length`` items from ``back`` before the end of a list or bytearray; they may reach into themselves."""
    at = len(out)
    if back > at or at + length > n:
        raise ValueError("a back-reference leaves the image")
    if back >= length:
        out += out[at - back : at - back + length]
    else:
        piece = out[at - back :]
        out += (piece * (length // back + 1))[:length]


def grey_pixels(bits: Bits, g: list, n: int, width: int) -> np.ndarray:
    """n pixels whose red, blue and alpha take no bits."""
    out, data, at, number, short_codes = bytearray(), bits.data, bits.at, int.from_bytes, near(width)
    append, green, far = out.append, g[0], g[4]
    if green.only is not None:
        raise ValueError("symbols without bits")
    short, mask, word, spare, left = green.short, green.mask, 0, 0, n
    while left > 0:
        if spare < 96:
            word, spare = number(data[at >> 3 : (at >> 3) + 48], "little") >> (at & 7), 376
        e = short[word & mask] or green.long(word)
        k = e & 15
        at += k
        if e < 4096:  # a literal
            append(e >> 4)
            left -= 1
            word >>= k
            spare -= k
            continue
        if e >= 280 << 4:
            raise ValueError("a cache code without a cache")
        length, used = number_of((e >> 4) - 256, word, k)
        if far.only is not None:
            s = far.only
        else:
            e = far.short[word >> used & far.mask] or far.long(word >> used)
            s = e >> 4
            used += e & 15
        code, used = number_of(s, word, used)
        copy(out, code - 120 if code > 120 else short_codes[code], length, n)
        left -= length
        at += used - k
        word >>= used
        spare -= used
    if at > bits.end:
        raise ValueError("the bitstream ends early")
    bits.at = at
    return np.frombuffer(out, np.uint8).astype(np.uint32) << np.uint32(8) | np.uint32(g[3].only << 24 | g[1].only << 16 | g[2].only)


_near: dict[int, list[int]] = {}


def near(width: int) -> list[int]:
    """The distance in pixels of each short distance code."""
    if width not in _near:
        _near[width] = [1] + [max(1, x + y * width) for x, y in NEAR]
    return _near[width]


_shortest: dict[int, dict[int, int]] = {}


def shortest(width: int) -> dict[int, int]:
    """The first short code of each distance that has one."""
    if width not in _shortest:
        _shortest[width] = {int(d): c for c, d in reversed(list(enumerate(near(width)))) if c}
    return _shortest[width]


def slots(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    """The place of each colour in the cache."""
    return ((pixels.astype(np.uint32) * np.uint32(0x1E35A7BD)) >> np.uint32(32 - cache_bits)).astype(np.int64)


def average(a, b):
    return (a & b) + ((a ^ b) >> 1)


def predicted(mode: int, left, top, top_left, top_right):
    """One pixel's prediction; each argument is a list of four channels."""
    if mode in (0, 14, 15):
        return [0, 0, 0, 255]
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode <= 10:
        mean = lambda p, q: [average(a, b) for a, b in zip(p, q, strict=True)]
        return (
            lambda: mean(mean(left, top_right), top), lambda: mean(left, top_left), lambda: mean(left, top),
            lambda: mean(top_left, top), lambda: mean(top, top_right), lambda: mean(mean(left, top_left), mean(top, top_right)),
        )[mode - 5]()
    if mode == 11:
        far = sum(abs(t - c) for t, c in zip(top, top_left, strict=True)) - sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if far < 0 else top
    clip = lambda x: 0 if x < 0 else 255 if x > 255 else x
    if mode == 12:
        return [clip(a + b - c) for a, b, c in zip(left, top, top_left, strict=True)]
    halves = [(average(a, b), c) for a, b, c in zip(left, top, top_left, strict=True)]
    return [clip(m + int((m - c) / 2)) for m, c in halves]


def undo_predictor(pixels: np.ndarray, width: int, height: int, tile: int, data: np.ndarray) -> np.ndarray:
    """Channels in memory order blue, green, red, alpha."""
    image = pixels.view(np.uint8).reshape(height, width, 4).copy()
    modes = ((data >> 8) & 15).reshape(-(-height >> tile), -(-width >> tile))
    image[0, 0, 3] = (int(image[0, 0, 3]) + 255) & 255
    image[0] = np.cumsum(image[0], axis=0, dtype=np.uint8)  # the top row adds the pixel to the left
    if height > 1 and (modes == 2).all():
        np.cumsum(image, axis=0, dtype=np.uint8, out=image)  # every other one adds the pixel above
        return image.view(np.uint32).reshape(-1)
    if (modes == 1).all():
        image[1:, 0] += np.cumsum(np.concatenate([image[:1, 0], image[1:, 0]]), axis=0, dtype=np.uint8)[:-1]  # first pixels add the one above
        np.cumsum(image[1:], axis=1, dtype=np.uint8, out=image[1:])
        return image.view(np.uint32).reshape(-1)
    rows = image.tolist()
    for y in range(1, height):
        up, row = rows[y - 1], rows[y]
        for x in range(width):
            if x == 0:
                by = up[0]
            else:
                by = predicted(int(modes[y >> tile, x >> tile]), row[x - 1], up[x], up[x - 1], up[x + 1] if x + 1 < width else row[0])
            row[x] = [(a + b) & 255 for a, b in zip(row[x], by, strict=True)]
    return np.array(rows, np.uint8).reshape(-1, 4).copy().view(np.uint32).reshape(-1)


def undo_cross_colour(pixels: np.ndarray, width: int, height: int, tile: int, data: np.ndarray) -> np.ndarray:
    if (data == data[0]).all():  # the same for the whole image
        out = pixels.view(np.uint8).reshape(-1, 4).copy()
        red_to_blue, green_to_blue, green_to_red = (int(v) - 256 * (v > 127) for v in (data[0] >> 16 & 255, data[0] >> 8 & 255, data[0] & 255))
        green = out[:, 1].view(np.int8).astype(np.int16)
        out[:, 2] += (green * np.int16(green_to_red) >> 5).astype(np.uint8)
        out[:, 0] += (green * np.int16(green_to_blue) >> 5).astype(np.uint8)
        if red_to_blue:
            out[:, 0] += (out[:, 2].view(np.int8).astype(np.int16) * np.int16(red_to_blue) >> 5).astype(np.uint8)
        return out.view(np.uint32).reshape(-1)
    y, x = np.divmod(np.arange(width * height), width)
    by = data[(y >> tile) * (-(-width >> tile)) + (x >> tile)]
    signed = lambda a, shift: ((a >> shift) & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    red_to_blue, green_to_blue, green_to_red = signed(by, 16), signed(by, 8), signed(by, 0)
    green = signed(pixels, 8)
    red = ((pixels >> 16).astype(np.int32) + (green_to_red * green >> 5)) & 255
    blue = (pixels.astype(np.int64).astype(np.int32) & 255) + (green_to_blue * green >> 5) + (red_to_blue * red.astype(np.uint8).view(np.int8).astype(np.int32) >> 5) & 255
    return (pixels & np.uint32(0xFF00FF00)) | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def undo_green(pixels: np.ndarray) -> np.ndarray:
    green = (pixels >> 8) & 255
    return (pixels & np.uint32(0xFF00FF00)) | (((pixels >> 16) + green) & 255) << 16 | ((pixels + green) & 255)


def undo_palette(pixels: np.ndarray, width: int, height: int, packed: int, colours: np.ndarray) -> np.ndarray:
    """packed: log2 of the pixels in one green sample; width: that of the image itself."""
    green = ((pixels >> 8) & 255).reshape(height, -1)
    if packed:
        bits = 8 >> packed
        green = np.stack([(green >> (bits * i)) & ((1 << bits) - 1) for i in range(1 << packed)], axis=2).reshape(height, -1)[:, :width]
    known = np.zeros(256, np.uint32)
    known[: len(colours)] = colours
    return known[green].reshape(-1)


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """The first image of data as height x width uint32 ARGB, and the bytes that its container takes."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or data[12:16] != b"VP8L":
        raise ValueError("not a lossless WebP file")
    whole, size = 8 + struct.unpack_from("<I", data, 4)[0], struct.unpack_from("<I", data, 16)[0]
    bits = Bits(bytes(data[20 : 20 + size]))
    if bits.read(8) != 0x2F:
        raise ValueError("not a VP8L stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    todo, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            tile = 2 + bits.read(3)
            todo.append((kind, inner, tile, read_image(bits, -(-inner >> tile), -(-height >> tile), False)))
        elif kind == 2:
            todo.append((2, inner, 0, None))
        else:
            n = bits.read(8) + 1
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            deltas = read_image(bits, n, 1, False)
            colours = np.cumsum(deltas.view(np.uint8).reshape(n, 4), axis=0, dtype=np.uint8).view(np.uint32).reshape(-1)
            todo.append((3, inner, packed, colours))
            inner = -(-inner >> packed)
    pixels = read_image(bits, inner, height, True)
    for kind, wide, by, extra in reversed(todo):
        if kind == 0:
            pixels = undo_predictor(pixels, wide, height, by, extra)
        elif kind == 1:
            pixels = undo_cross_colour(pixels, wide, height, by, extra)
        elif kind == 2:
            pixels = undo_green(pixels)
        else:
            pixels = undo_palette(pixels, wide, height, by, extra)
    return pixels.reshape(height, width), whole


# ---------------------------------------------------------------- the writer


_logs = np.arange(1, 1 << 14) * np.log2(np.arange(1, 1 << 14))


def entropy(counts: np.ndarray) -> float:
    """Bits that symbols with these counts take, and about five for each symbol that occurs."""
    c = counts[counts > 0]
    total = int(c.sum())
    if len(c) < 2:
        return 0.0
    own = _logs[c - 1].sum() if total < 1 << 14 else (c * np.log2(c)).sum()
    return float(total * np.log2(total) - own) + 5 * len(c)


#: Lengths of the code under which the writer stores code lengths: complete, short for those that texts' codes have.
STORED = (3, 7, 7, 7, 5, 4, 3, 3, 3, 3, 4, 5, 7, 7, 7, 7, 7, 4, 4)


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of an optimal prefix code, of at most ``most`` bits (counts are evened out until they fit)."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    while True:
        leaves, made = weights.tolist(), []
        n, i, k, up = len(leaves), 0, 0, []
        parent = [0] * (2 * n - 1)
        for new in range(n, 2 * n - 1):  # the two lightest of leaves and made nodes become one
            total = 0
            for _ in range(2):
                if k >= len(made) or i < n and leaves[i] <= made[k]:
                    total += leaves[i]
                    parent[i] = new
                    i += 1
                else:
                    total += made[k]
                    parent[n + k] = new
                    k += 1
            made.append(total)
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        up = depth[:n]
        if max(up) <= most:
            out[used] = up
            return out
        weights = np.sort((weights >> 1) + 1 + weights.sum() // (1 << most))


_stored: list = []


def stored() -> tuple:
    """What comes before code lengths in the stream, the codes of their marks, and their bits."""
    if not _stored:
        codes, bits = spelled(STORED)
        head = Writer()
        head.put(0, 1)
        head.put(15, 4)
        for s in LENGTH_ORDER:
            head.put(STORED[s], 3)
        head.put(0, 1)  # all lengths are there
        _stored.append((head, codes.tolist(), bits.tolist()))
    return _stored[0]


def put_lengths(to: Writer, lengths: np.ndarray) -> None:
    """A prefix code's lengths: simple for one or two symbols, else under the code STORED, with runs."""
    used = np.flatnonzero(lengths)
    if 0 < len(used) <= 2 and used[-1] < 256:
        used = used.tolist()
        to.put(1 | (len(used) - 1) << 1 | (used[0] > 1) << 2, 3)
        to.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            to.put(used[1], 8)
        return
    head, codes, bits = stored()
    edges = np.flatnonzero(lengths[1:] != lengths[:-1]) + 1
    begin = [0, *edges.tolist()]
    which = lengths[begin].tolist()
    value, at = head.value, head.at
    for a, b, n in zip(begin, [*begin[1:], len(lengths)], which, strict=True):
        left = b - a
        if n:
            value |= codes[n] << at
            at += bits[n]
            left -= 1
        while left >= 3:
            now = min(left, 138 if not n else 6)
            s, extra, more = (16, now - 3, 2) if n else (17, now - 3, 3) if now <= 10 else (18, now - 11, 7)
            value |= (codes[s] | extra << bits[s]) << at
            at += bits[s] + more
            left -= now
        for _ in range(left):
            value |= codes[n] << at
            at += bits[n]
    to.put(value, at)


def prefixes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and how many of lengths or distance codes (from 1 on)."""
    d = np.maximum(v - 1, 1)
    high = np.frexp(d.astype(np.float64))[1].astype(np.int64) - 1
    small = v <= 4
    n = np.where(small, 0, high - 1)
    return np.where(small, v - 1, 2 * high + ((d >> np.maximum(high - 1, 0)) & 1)), np.where(small, 0, d & ((1 << n) - 1)), n


def matches(pixels: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that are copies of earlier ones, as (start, pixels, distance), the next one found after each that is taken."""
    n = len(pixels) - 2
    if n < least:
        return (np.empty(0, np.int64),) * 3
    p = pixels.astype(np.uint64)
    key = (p[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93) ^ p[2:]
    order = np.argsort(key, kind="stable")
    late, soon = order[1:], order[:-1]
    same = (key[late] == key[soon]) & (pixels[late] == pixels[soon]) & (pixels[late + 1] == pixels[soon + 1]) & (pixels[late + 2] == pixels[soon + 2])
    before = np.full(n, -1)
    before[late[same]] = soon[same]
    before[np.arange(n) - before > (1 << 20) - 128] = -1
    # a run goes on while the next place's copy is the next one
    on = np.append((before[1:] == before[:-1] + 1) & (before[:-1] >= 0), False)
    stop = np.where(on, n, np.arange(n))
    length = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n) + 3
    good = np.flatnonzero((before >= 0) & (length >= least))
    places, k, taken = good.tolist(), 0, []
    ends = (good + length[good]).tolist()
    while k < len(places):
        taken.append(k)
        k = bisect_left(places, ends[k], k + 1)
    taken = good[np.array(taken, np.int64)]
    length, back = length[taken], taken - before[taken]
    if (length > 4096).any():  # the format's longest run
        parts = -(-length // 4096)
        which = np.repeat(np.arange(len(taken)), parts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        taken, back, length = taken[which] + 4096 * nth, back[which], np.minimum(4096, length[which] - 4096 * nth)
    return taken, length, back


def put_green(to: Writer, counts: np.ndarray, alpha: int) -> tuple[np.ndarray, np.ndarray]:
    """The heads of a main image of literals in green; their codes and bits."""
    to.put(0, 2)  # no colour cache, one group of codes
    lengths = code_lengths(counts, 11)
    put_lengths(to, lengths)
    for symbol in (0, 0, alpha):
        to.put(0b101 | symbol << 3, 11)
    to.put(0b0001, 4)
    return spelled(lengths)


def pays(pixels: np.ndarray) -> bool:
    """Whether back-references save a quarter of a grey image, by a quick try with others than the format's."""
    samples = (pixels >> np.uint32(8)).astype(np.uint8)
    return 8 * len(zlib.compress(samples.tobytes(), 1)) < 0.75 * entropy(np.bincount(samples))


def put_pixels(to: Writer, pixels: np.ndarray, width: int, main: bool) -> bytes:
    """An image's pixels after what is in ``to``; returned as bytes if main, else added to it."""
    n = len(pixels)
    flat = main and len(pixels) > 3 and not (pixels & np.uint32(0xFF00FF)).any()  # samples in green alone
    start, length, back = matches(pixels, 4 if flat else 3) if main and (not flat or pays(pixels)) else (np.empty(0, np.int64),) * 3
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, start + length, -1)
    alone = np.cumsum(inside[:-1]) == 0
    single = pixels[alone]
    channel = lambda p, shift: ((p >> np.uint32(shift)) & np.uint32(255)).astype(np.int64)
    parts = [channel(pixels, s) for s in ((8,) if flat else (8, 16, 0))] + [None, None] * flat
    len_symbol, len_extra, len_bits = prefixes(length)
    short = shortest(width)
    code = np.array([short.get(d, d + 120) for d in back.tolist()], np.int64)
    far_symbol, far_extra, far_bits = prefixes(code)
    runs = np.bincount(256 + len_symbol, minlength=280)
    none = np.bincount([0], minlength=256)
    counts = [np.bincount(p[alone], minlength=280) if i == 0 else none if flat else np.bincount(p[alone], minlength=256) for i, p in enumerate(parts)]
    counts[0] += runs
    if flat and not len(start):
        counts[0][256] = 1  # see literals()
    cache_bits, hit = 0, np.zeros(n, bool)
    if main and not flat and len(single) > 16:
        try_bits = min(10, max(2, len(single).bit_length() - 2))
        slot = slots(pixels, try_bits)
        order = np.argsort(slot, kind="stable")
        same = (slot[order[1:]] == slot[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
        hits = np.zeros(n, bool)
        hits[order[1:][same]] = True
        hits &= alone
        rest = alone & ~hits
        other = [np.bincount(p[rest], minlength=280 if i == 0 else 256) for i, p in enumerate(parts)]
        other[0] = np.concatenate([other[0] + runs, np.bincount(slot[hits], minlength=1 << try_bits)])
        if sum(map(entropy, other)) < sum(map(entropy, counts)):
            cache_bits, hit, counts = try_bits, hits, other
            parts[0] = np.where(hit, 280 + slot, parts[0])
    if flat and not len(start):  # a code for green alone; the others' only symbols are 0, 0 and the one alpha
        codes, sizes = put_green(to, counts[0], int(pixels[0] >> np.uint32(24)))
        return joined(to.value, to.at, codes[parts[0]], sizes[parts[0]]).tobytes()
    lengths = [code_lengths(c, 11) for c in counts]  # short tables read them faster than the format's 15 bits
    opaque = np.bincount(channel(single[:1] if flat else single, 24), minlength=256) if len(single) else np.bincount([255])
    lengths += [code_lengths(opaque, 15), code_lengths(np.bincount(far_symbol, minlength=40), 15)]
    to.put(cache_bits << 1 | 1 if cache_bits else 0, 5 if cache_bits else 1)
    if main:
        to.put(0, 1)  # one group of codes
    for x in lengths:
        if not x.any():
            x[0] = 1
        put_lengths(to, x)
    codes, sizes = zip(*map(spelled, lengths), strict=True)
    heads = np.flatnonzero(alone)
    if flat and len(single):  # a literal is its green sample alone; a copy its length, then its distance
        at = np.argsort(np.concatenate([heads, start]), kind="stable")
        values, many = np.zeros((2, len(heads) + len(start)), np.int64), np.zeros((2, len(heads) + len(start)), np.int64)
        k, s = len(heads), 256 + len_symbol
        values[0, :k], many[0, :k] = codes[0][parts[0][heads]], sizes[0][parts[0][heads]]
        values[0, k:], many[0, k:] = codes[0][s] | len_extra << sizes[0][s], sizes[0][s] + len_bits
        values[1, k:], many[1, k:] = codes[4][far_symbol] | far_extra << sizes[4][far_symbol], sizes[4][far_symbol] + far_bits
        if len(start):
            values, many = values[:, at].T.reshape(-1), many[:, at].T.reshape(-1)
        else:
            values, many = values[0], many[0]
        return joined(to.value, to.at, values, many).tobytes()
    # three numbers for each symbol: green, cache code or length; red or distance; blue and alpha
    at = np.argsort(np.concatenate([heads, start]), kind="stable")
    plain = ~hit[heads]
    values, many = np.zeros((3, len(heads) + len(start)), np.int64), np.zeros((3, len(heads) + len(start)), np.int64)
    green, k = parts[0][heads], len(heads)
    values[0, :k], many[0, :k] = codes[0][green], sizes[0][green]
    red, blue, alpha = parts[1][heads], parts[2][heads], channel(single, 24)
    values[1, :k], many[1, :k] = codes[1][red] * plain, sizes[1][red] * plain
    values[2, :k] = (codes[2][blue] | codes[3][alpha] << sizes[2][blue]) * plain
    many[2, :k] = (sizes[2][blue] + sizes[3][alpha]) * plain
    s = 256 + len_symbol
    values[0, k:], many[0, k:] = codes[0][s] | len_extra << sizes[0][s], sizes[0][s] + len_bits
    values[1, k:], many[1, k:] = codes[4][far_symbol] | far_extra << sizes[4][far_symbol], sizes[4][far_symbol] + far_bits
    out = joined(to.value, to.at, values[:, at].T.reshape(-1), many[:, at].T.reshape(-1))
    if not main:
        to.value, to.at = int.from_bytes(out.tobytes(), "little"), to.at + int(many.sum())
    return out.tobytes()


def joined(value: int, at: int, values: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Bits of value, then those of values, least significant first."""
    ends = at + np.cumsum(many)
    total = int(ends[-1]) if len(ends) else at
    words = np.zeros((total >> 6) + 2, np.uint64)
    begin = ends - many
    v, shift, word = values.astype(np.uint64), (begin & 63).astype(np.uint64), begin >> 6
    np.add.at(words, word, v << shift)
    over = np.flatnonzero((begin & 63) + many > 64)
    np.add.at(words, word[over] + 1, v[over] >> (np.uint64(64) - shift[over]))
    raw = words.view(np.uint8)
    front = np.frombuffer(value.to_bytes(at + 7 >> 3, "little"), np.uint8)
    raw[: len(front)] |= front
    return raw[: total + 7 >> 3]


def constant(to: Writer, red: int, green: int, blue: int) -> None:
    """An image of one colour: no colour cache, codes of one symbol each."""
    to.put(0, 1)
    for symbol in (green, red, blue, 255):
        to.put(0b101 | symbol << 3, 11)
    to.put(0b0001, 4)


def residues(image: np.ndarray, mode: int) -> np.ndarray:
    """What the left (1) or top (2) predictor leaves of a height x width x 3 image."""
    out = image.copy()
    out[0, 1:] -= image[0, :-1]
    if mode == 2:
        out[1:] -= image[:-1]
    else:
        out[1:, 1:] -= image[1:, :-1]
        out[1:, 0] -= image[:-1, 0]
    return out


def cost(image: np.ndarray) -> float:
    return sum(entropy(np.bincount(image[..., c].reshape(-1), minlength=256)) for c in range(3))


def slope(x: np.ndarray, y: np.ndarray) -> int:
    """The multiple of x / 32 that is nearest to y, both signed samples."""
    x, y = x.reshape(-1).view(np.int8).astype(np.float64), y.reshape(-1).view(np.int8).astype(np.float64)
    return int(np.clip(np.rint(32 * (x @ y) / max(1.0, x @ x)), -128, 127))


def less_cross(image: np.ndarray, by: tuple[int, int, int]) -> np.ndarray:
    """image without green's part of red, and green's and red's part of blue."""
    red, green, blue = (image[..., c].view(np.int8).astype(np.int32) for c in range(3))
    out = image.copy()
    out[..., 0] = (red - (by[0] * green >> 5)) & 255
    out[..., 2] = (blue - (by[1] * green >> 5) - (by[2] * red >> 5)) & 255
    return out


def argb(image: np.ndarray) -> np.ndarray:
    flat = image.reshape(-1, 3).astype(np.uint32)
    return np.uint32(0xFF000000) | flat[:, 0] << np.uint32(16) | flat[:, 1] << np.uint32(8) | flat[:, 2]


def put_palette(to: Writer, colours: np.ndarray, index: np.ndarray, width: int, height: int) -> tuple[np.ndarray, int]:
    """Writes the colours (ARGB); the indexes as pixels, several to a pixel if there are few colours, and their width."""
    packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
    to.put(1, 1)
    to.put(3, 2)
    to.put(len(colours) - 1, 8)
    deltas = np.diff(colours.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8))
    put_pixels(to, np.ascontiguousarray(deltas).view(np.uint32).reshape(-1), len(colours), False)
    inner = -(-width >> packed)
    wide = np.zeros((height, inner << packed), np.uint32)
    wide[:, :width] = index.reshape(height, width)
    wide = wide.reshape(height, inner, 1 << packed) << (np.arange(1 << packed, dtype=np.uint32) * np.uint32(8 >> packed))
    return np.uint32(0xFF000000) | wide.sum(axis=2, dtype=np.uint32).reshape(-1) << np.uint32(8), inner


def put_transform(to: Writer, kind: int, red: int, green: int, blue: int) -> None:
    """The predictor (0) or the cross-colour transform (1), the same for the whole image."""
    to.put(1, 1)
    to.put(kind, 2)
    to.put(7, 3)  # tiles of 512 pixels
    constant(to, red, green, blue)


def contained(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def opening(width: int, height: int) -> Writer:
    to = Writer()
    to.put(0x2F, 8)
    to.put(width - 1, 14)
    to.put(height - 1, 14)
    to.put(0, 4)
    return to


def encode_grey(samples: np.ndarray, width: int) -> bytes:
    """samples: uint8, one for each pixel, rows of ``width`` pixels.

    Red and blue equal green, which the cross-colour transform takes out of them (32 / 32 of it), so that they need no bits."""
    image = np.ascontiguousarray(samples).reshape(-1, width)
    height, to = len(image), opening(width, len(image))
    counts = np.bincount(samples, minlength=256)
    used = np.flatnonzero(counts)
    if len(used) <= 16:
        index = np.zeros(256, np.uint32)
        index[used] = np.arange(len(used))
        colours = np.uint32(0xFF000000) | used.astype(np.uint32) * np.uint32(0x10101)
        pixels, width = put_palette(to, colours, index[samples], width, height)
    else:
        best, mode = entropy(counts), 0
        for m in (1, 2):
            left = residues(image, m)
            if (c := entropy(np.bincount(left.reshape(-1), minlength=256)) + 80) < best:
                best, mode, chosen = c, m, left
        if mode:
            image = chosen
            put_transform(to, 0, 0, mode, 0)
        put_transform(to, 1, 0, 32, 32)
        pixels = image.reshape(-1).astype(np.uint32) << np.uint32(8)
        if not mode:  # with a predictor only the first pixel's alpha is predicted as 255, all others' as that of a neighbour
            pixels |= np.uint32(0xFF000000)
    to.put(0, 1)
    return contained(put_pixels(to, pixels, width, True))


def encode(samples: np.ndarray, width: int) -> bytes:
    """samples: uint8, three for each pixel (red, green, blue), rows of ``width`` pixels."""
    image = np.ascontiguousarray(samples).reshape(-1, width, 3)
    height = len(image)
    to = opening(width, height)
    pixels, inner = argb(image), width
    colours, plain, index = np.unique(pixels), cost(image), None
    if len(colours) <= 256:
        index = np.searchsorted(colours, pixels)
    if index is not None and entropy(np.bincount(index)) + 20 * len(colours) < plain:
        pixels, inner = put_palette(to, colours, index, width, height)
    else:
        best, mode = plain, 0
        for m in (1, 2):
            left = residues(image, m)
            if (c := cost(left) + 80) < best:
                best, mode, chosen = c, m, left
        if mode:
            image = chosen
            put_transform(to, 0, 0, mode, 0)
        to_red = slope(image[..., 1].copy(), image[..., 0].copy())
        to_blue = slope(image[..., 1].copy(), image[..., 2].copy())
        red_too = slope(image[..., 0].copy(), less_cross(image, (0, to_blue, 0))[..., 2].copy())
        by = (to_red, to_blue, red_too)
        if any(by) and cost(less := less_cross(image, by)) + 80 < best:
            image = less
            put_transform(to, 1, red_too & 255, to_blue & 255, to_red & 255)
        pixels = argb(image)
        if mode:  # the first pixel's alpha is predicted as 255, all others' as that of a neighbour
            pixels &= np.uint32(0xFFFFFF)
    to.put(0, 1)
    return contained(put_pixels(to, pixels, inner, True))
