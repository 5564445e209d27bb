"""Lossless WebP: round trips, and streams written here with every transform."""

import random

import numpy as np
import pytest

from tessera.llm import webp


class Writer(webp.BitWriter):
    """Writes what the library's own encoder never does: literal ARGB pixels with plain codes."""

    def eight_bit_code(self, alphabet):
        """Every symbol below 256 in eight bits."""
        self.put(0, 1)
        order = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8]
        lengths = {8: 1, 18: 2, 17: 2}
        self.put(len(order) - 4, 4)
        for k in order:
            self.put(lengths.get(k, 0), 3)
        codes = webp.canonical(lengths)
        self.put(0, 1)
        for _ in range(256):
            self.put(*codes[8])
        rest = alphabet - 256
        while rest >= 3:
            n = min(rest, 138 if rest >= 11 else 10)
            symbol, value, more = (18, n - 11, 7) if n >= 11 else (17, n - 3, 3)
            self.put(*codes[symbol])
            self.put(value, more)
            rest -= n

    def code_for_all(self):
        return [int(f"{s:08b}"[::-1], 2) for s in range(256)]

    def pixels(self, argb, main, cache_bits=0):
        """Literal pixels; alphabets of 280 + cache."""
        self.put(0, 1)
        if main:
            self.put(0, 1)
        for n in (280, 256, 256, 256):
            self.eight_bit_code(n)
        self.put(1 | 0 << 1 | 1 << 2, 11)
        codes = self.code_for_all()
        for p in argb:
            for shift in (8, 16, 0, 24):
                self.put(codes[p >> shift & 255], 8)


def file_of(writer):
    body = writer.value.to_bytes((writer.n + 7) // 8, "little")
    size = len(body)
    body += b"\0" * (size & 1)
    return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + size.to_bytes(4, "little") + body


def start(width, height):
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    return w


def channels(p):
    return [p & 255, p >> 8 & 255, p >> 16 & 255, p >> 24]


def word(c):
    return c[0] | c[1] << 8 | c[2] << 16 | c[3] << 24


def random_image(width, height, seed=0):
    r = random.Random(seed)
    return [r.getrandbits(32) for _ in range(width * height)]


def read(media):
    width, height, argb = webp.decode(media)
    return width, height, argb.tolist()


def test_literals():
    image = random_image(7, 5)
    w = start(7, 5)
    w.put(0, 1)
    w.pixels(image, True)
    assert read(file_of(w)) == (7, 5, image)


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    width, height = 9, 6
    image = random_image(width, height, mode)

    def guess(x, y):
        at = lambda i, j: channels(image[j * width + i])
        if x == y == 0:
            return [0, 0, 0, 255]
        if not y:
            return at(x - 1, y)
        if not x:
            return at(x, y - 1)
        left, top, corner = at(x - 1, y), at(x, y - 1), at(x - 1, y - 1)
        right = channels(image[(y - 1) * width + x + 1])  # past the end of a row: the next row's first
        mean = lambda a, b: [(p + q) // 2 for p, q in zip(a, b)]
        clamp = lambda v: max(0, min(255, v))
        if mode == 11:
            near = [a + b - c for a, b, c in zip(left, top, corner)]
            to_left = sum(abs(p - a) for p, a in zip(near, left))
            to_top = sum(abs(p - b) for p, b in zip(near, top))
            return left if to_left < to_top else top
        if mode == 12:
            return [clamp(a + b - c) for a, b, c in zip(left, top, corner)]
        if mode == 13:
            return [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner)]
        return {
            0: [0, 0, 0, 255], 1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner), 7: mean(left, top),
            8: mean(corner, top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right)),
        }[mode]

    rest = [word([(a - b) % 256 for a, b in zip(channels(image[y * width + x]), guess(x, y))]) for y in range(height) for x in range(width)]
    w = start(width, height)
    w.put(1 | webp.PREDICTOR << 1, 3)
    w.put(0, 3)
    w.pixels([mode << 8] * (3 * 2), False)
    w.put(0, 1)
    w.pixels(rest, True)
    assert read(file_of(w)) == (width, height, image)


def test_cross_colour_and_subtract_green():
    width, height = 6, 5
    image = random_image(width, height, 3)
    signed = lambda v: (v & 255) - 256 * ((v & 255) > 127)
    elements = [0xFF000000 | 17 << 16 | 200 << 8 | 90, 0xFF000000 | 250 << 16 | 3 << 8 | 130, 0xFF0102FE, 0xFF7F807F]
    rest = []
    for at, p in enumerate(image):
        x, y = at % width, at // width
        b, g, r, a = channels(p)
        e = elements[(y >> 2) * 2 + (x >> 2)]
        new_r = (r - (signed(e) * signed(g) >> 5)) & 255
        new_b = (b - (signed(e >> 8) * signed(g) >> 5) - (signed(e >> 16) * signed(r) >> 5)) & 255
        rest.append(word([(new_b - g) % 256, g, (new_r - g) % 256, a]))
    w = start(width, height)
    w.put(1 | webp.CROSS_COLOUR << 1, 3)
    w.put(0, 3)
    w.pixels(elements, False)
    w.put(1 | webp.SUBTRACT_GREEN << 1, 3)
    w.put(0, 1)
    w.pixels(rest, True)
    assert read(file_of(w)) == (width, height, image)


@pytest.mark.parametrize("colours", [2, 4, 13, 16, 40])
def test_palette(colours):
    width, height = 11, 3
    r = random.Random(colours)
    palette = [r.getrandbits(32) for _ in range(colours)]
    index = [r.randrange(colours) for _ in range(width * height)]
    bundle = webp.bundle_bits(colours)
    across = -(-width // (1 << bundle))
    packed = []
    for y in range(height):
        for x in range(across):
            row = index[y * width : (y + 1) * width][x << bundle : (x + 1) << bundle]
            packed.append(0xFF000000 | sum(v << (k * (8 >> bundle)) for k, v in enumerate(row)) << 8)
    steps = [word([(a - b) % 256 for a, b in zip(channels(p), channels(q))]) for p, q in zip(palette, [0, *palette])]
    w = start(width, height)
    w.put(1 | webp.COLOUR_INDEXING << 1 | (colours - 1) << 3, 11)
    w.pixels(steps, False)
    w.put(0, 1)
    w.pixels(packed, True)
    assert read(file_of(w)) == (width, height, [palette[i] for i in index])


def test_colour_cache_back_references_and_meta_codes():
    """Two prefix code groups; literals, a cached colour, a far and a near back-reference."""
    width, height = 8, 8
    w = start(width, height)
    w.put(0, 1)
    w.put(1, 1)
    w.put(4, 4)  # colour cache of 16
    w.put(1, 1)
    w.put(0, 3)  # groups by blocks of 4 x 4
    w.pixels([0, 1 << 8, 0, 1 << 8], False)
    first, second = 0xFF102030, 0xFF405060
    cache = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> 28
    length, far, near = webp.prefix_of(8), webp.prefix_of(width + 120), webp.prefix_of(2)

    def group(literals):
        green = {p >> 8 & 255: 5 for p in literals} | {280 + cache(first): 2, 256 + length[0]: 1, 256 + webp.prefix_of(52)[0]: 1}
        codes = [webp.put_code(w, green, 280 + 16)]
        for shift in (16, 0, 24):
            codes.append(webp.put_code(w, {p >> shift & 255: 1 for p in literals}, 256))
        codes.append(webp.put_code(w, {far[0]: 1, near[0]: 1}, 40))
        return codes

    groups = [group([first, second]), group([second, first])]
    out = []

    def at():
        x, y = len(out) % width, len(out) // width
        return groups[(x >> 2) & 1]

    def literal(p):
        codes = at()
        for code, shift in zip(codes, (8, 16, 0, 24)):
            w.put(*code[p >> shift & 255])
        out.append(p)

    def cached(p):
        w.put(*at()[0][280 + cache(p)])
        out.append(p)

    def copy(n, prefix, distance):
        codes = at()
        symbol, value, more = webp.prefix_of(n)
        w.put(*codes[0][256 + symbol])
        w.put(value, more)
        w.put(*codes[4][prefix[0]])
        w.put(prefix[1], prefix[2])
        for _ in range(n):
            out.append(out[-distance])

    literal(first)
    literal(second)
    cached(first)
    literal(second)  # the cache may hold only one of the two
    copy(8, near, 1)  # code 2 is the pixel to the left
    copy(52, far, width)
    assert read(file_of(w)) == (width, height, out)


PAYLOADS = [b"", b"a", b"ab" * 500, b"x" * 20000, bytes(range(256)) * 30, b"0123456789" * 3000, "Zoë and 漢字 😀\n".encode() * 50, random.Random(5).randbytes(60_000)]


@pytest.mark.parametrize("raw", PAYLOADS)
def test_payload_round_trip(raw):
    payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
    media = webp.store(payload)
    assert webp.recall(media, len(payload))[0] == payload
    assert webp.store(payload) == media


def test_long_payload_widens_the_rows():
    payload = b"long text " * 192 * 1700
    payload = payload[: len(payload) // 192 * 192]
    media = webp.store(payload)
    back, [(width, height, _)] = webp.recall(media, len(payload))
    assert back == payload and height <= webp.MAX_SIDE and width > 192


def test_damaged_media_are_refused():
    media = webp.store(b"some text".ljust(192))
    for bad in (b"", media[:10], media[:25], b"RIFF" + bytes(40), media[:20] + b"\0" + media[21:]):
        with pytest.raises(webp.BadImage):
            webp.decode(bad)


def test_operators(spark):
    rows = [(1, "one", "x"), (2, None, None), (3, "", "y"), (3, "", "y"), (None, "one", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    out = [r.asDict() for r in webp.store_texts(docs).collect()]
    assert len(out) == 5 and {r["payload_bytes"] for r in out} == {192}
    assert out[0]["media_sha256"] == out[4]["media_sha256"] and out[1]["payload_sha256"] == out[2]["payload_sha256"]
    media = spark.createDataFrame([(1, out[0]["media"]), (2, None), (3, bytearray(b"junk"))], "image_id int, media binary")
    decoded = {r["image_id"]: r for r in webp.decode_images(media).collect()}
    assert bytes(decoded[1]["pixels"])[::4] == b"one".ljust(192) and decoded[1]["error"] is None
    assert decoded[2]["pixels"] is None and decoded[3]["error"]
    assert webp.store_texts(docs.limit(0)).count() == 0


def test_plane_distances():
    assert len(webp.PLANE) == 120 and webp.PLANE[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)]
    assert webp.distance_of(1, 50) == 50 and webp.distance_of(2, 50) == 1 and webp.distance_of(121, 50) == 1


def test_payloads_beyond_one_image():
    """Several files, one after the other, each of whole rows."""
    payload = bytes(i * i % 251 for i in range(192 * 50))
    media = webp.store(payload, most=192 * 16)
    back, images = webp.recall(media, len(payload), most=192 * 16)
    assert back == payload and media.count(b"RIFF") == 4 and [h for _, h, _ in images] == [16, 16, 16, 2]
    assert webp.store(payload) != media and webp.recall(webp.store(payload), len(payload))[0] == payload


def test_a_file_made_elsewhere():
    """The 1 x 1 lossless image that web pages use to ask whether a browser reads the format."""
    import base64

    width, height, argb = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert (width, height, len(argb)) == (1, 1, 1)
