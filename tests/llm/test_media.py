import hashlib
import zlib

import numpy as np
import pytest

from stratalog.llm import media, webp


def images(rng):
    width, height = int(rng.integers(1, 30)), int(rng.integers(1, 30))
    n = width * height
    yield rng.integers(0, 1 << 32, n, dtype=np.uint32), width, height
    yield rng.integers(0, 3, n).astype(np.uint32) * np.uint32(0x01030507), width, height
    yield (np.arange(n) // 7 % 11 * 0x010101 | 0xFF000000).astype(np.uint32), width, height
    yield np.full(n, 7, np.uint32), width, height


@pytest.mark.parametrize("seed", range(6))
def test_every_transform_is_inverted(seed):
    rng = np.random.default_rng(seed)
    for pixels, width, height in images(rng):
        block = int(rng.integers(2, 5))
        n = webp.blocks(width, block) * webp.blocks(height, block)
        predict = ("predict", block, (rng.integers(0, 14, n) << 8 | 0xFF000000).astype(np.uint32))
        cross = ("cross", block, rng.integers(0, 1 << 24, n).astype(np.uint32) | np.uint32(0xFF000000))
        choices = [(), (("green",),), (predict,), (cross,), (predict, cross, ("green",))]
        if len(np.unique(pixels)) <= 256:
            choices.append((("palette",),))
        for transforms in choices:
            for cache in (0, 5):
                got, *shape = webp.read_image(webp.write_image(pixels, width, height, transforms, cache))
                assert shape == [width, height]
                assert np.array_equal(got, pixels), (transforms, cache)


def test_predictors_by_the_pixel():
    left, top, corner, right = (np.array([v]) for v in ([10, 20, 30, 40], [50, 10, 255, 0], [20, 15, 9, 7], [3, 200, 100, 255]))
    want = {1: [10, 20, 30, 40], 2: [50, 10, 255, 0], 3: [3, 200, 100, 255], 4: [20, 15, 9, 7], 5: [28, 60, 160, 73], 6: [15, 17, 19, 23], 7: [30, 15, 142, 20], 12: [40, 15, 255, 33], 13: [35, 15, 208, 26]}
    for mode, pixel in want.items():
        assert webp.predictions(np.array([mode]), left, top, corner, right)[0].tolist() == pixel, mode


def test_groups_of_codes_are_read():
    # two groups over blocks of 4 x 4: the left block codes red 1, the right one red 2
    pieces = [*webp.head_pieces(8, 4), (0, 1), (0, 1), (1, 1), (0, 3)]
    pieces += [(0, 1), *webp.code_pieces(np.eye(1, 280, 0)[0].astype(int) + np.eye(1, 280, 1)[0].astype(int)), *webp.code_pieces(webp.one_symbol(256, 0)) * 3, *webp.code_pieces(webp.one_symbol(40, 0)), (0, 1), (1, 1)]
    for red in (1, 2):
        for symbol, size in ((9, 280), (red, 256), (3, 256), (255, 256), (0, 40)):
            pieces += webp.code_pieces(webp.one_symbol(size, symbol))
    bits, sizes = webp.as_arrays(pieces)
    data = webp.joined_bits(bits, sizes, np.cumsum(sizes) - sizes, int(sizes.sum()))[: (int(sizes.sum()) + 7) // 8].tobytes()
    got, *_ = webp.read_image(webp.boxed(data))
    assert (got.reshape(4, 8) >> 16 & 255).tolist() == [[1] * 4 + [2] * 4] * 4


def test_text_to_media_and_back(spark, docs):
    rng = np.random.default_rng(3)
    texts = ["", None, "a", "short text", "x" * 191, "x" * 192, "x" * 193, "Zażółć gęślą jaźń 中文 " * 40, "long words and words " * 20_000, "".join(map(chr, rng.integers(32, 0x2FF, 9_000))), "short text"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "no id", "s")]
    got = {r.doc_id: r for r in media.round_trip(docs(rows), payloads=True).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        body = (t or "").encode()
        payload = media.padded(body)
        r = got[i]
        assert bytes(r.payload) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert len(payload) % 192 == 0 and payload.startswith(body) and len(payload) > 0
    assert got[3].media_sha256 == got[10].media_sha256 and got[3].feature == got[10].feature
    assert media.round_trip(docs([])).count() == 0


def test_runs_and_strips_do_not_change_the_media(monkeypatch):
    payloads = [media.padded(bytes([k % 256]) * k + b"some text " * k) for k in range(0, 900, 31)]
    want = media.to_media(payloads)
    assert [media.to_media([p])[0] for p in payloads] == want
    monkeypatch.setattr(media, "RUN_BYTES", webp.STRIP * 3)
    assert media.to_media(payloads) == want
    assert media.from_media(want, webp.Known()) == payloads


def test_broken_files_are_refused():
    file = webp.write_image(np.arange(64, dtype=np.uint32), 8, 8)
    with pytest.raises(ValueError):
        webp.read_image(b"RIFX" + file[4:])
    with pytest.raises(ValueError):
        webp.read_image(file[:20] + b"\0" + file[21:])


class Hand:
    """A stream put together bit by bit after the format's text, without the writer."""

    def __init__(self, width, height):
        self.bits = []
        self.put((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3))

    def put(self, *pieces):
        for value, n in pieces:
            self.bits += [value >> k & 1 for k in range(n)]
        return self

    def one(self, *symbols):
        """Codes of a single symbol each, which take no bits in the pixels."""
        for s in symbols:
            self.put((1, 1), (0, 1), (1, 1), (s, 8))
        return self

    def two(self, a, b):
        return self.put((1, 1), (1, 1), (1, 1), (a, 8), (b, 8))

    def read(self):
        number = sum(b << k for k, b in enumerate(self.bits))
        data = number.to_bytes((len(self.bits) + 7) // 8 + 8, "little")
        file = b"RIFF" + (len(data) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data
        return [tuple(int(p) >> s & 255 for s in (24, 16, 8, 0)) for p in webp.read_image(file)[0]]


def test_fixed_bits_of_a_predictor():
    hand = Hand(2, 2).put((1, 1), (0, 2), (0, 3), (0, 1)).one(2, 0, 0, 255, 0)  # above, in one block
    hand.put((0, 1), (0, 1), (0, 1)).one(0, 10, 0, 0, 0)
    assert hand.read() == [(255, r, 0, 0) for r in (10, 20, 20, 30)]


def test_fixed_bits_of_cross_colour():
    hand = Hand(1, 1).put((1, 1), (1, 2), (0, 3), (0, 1)).one(16, 0, 32, 255, 0)  # green to blue, red to blue, green to red
    hand.put((0, 1), (0, 1), (0, 1)).one(64, 0, 0, 255, 0)
    assert hand.read() == [(255, 64, 64, 32)]


def test_fixed_bits_of_subtract_green_and_a_palette():
    assert Hand(1, 1).put((1, 1), (2, 2), (0, 1), (0, 1), (0, 1)).one(200, 100, 5, 255, 0).read() == [(255, 44, 200, 205)]
    hand = Hand(8, 1).put((1, 1), (3, 2), (1, 8), (0, 1))
    hand.one(0).two(5, 7).one(0).two(0, 255).one(0).put((0, 1), (1, 1), (1, 1), (0, 1))  # red 5, opaque; then 7 more red
    hand.put((0, 1), (0, 1), (0, 1)).one(0b10110001, 0, 0, 255, 0)
    assert hand.read() == [(255, 12 if b == "1" else 5, 0, 0) for b in reversed("10110001")]


def test_fixed_bits_of_a_colour_cache():
    slot = (0xFF004100 * 0x1E35A7BD % 2**32) >> 31
    hand = Hand(3, 1).put((0, 1), (1, 1), (1, 4), (0, 1))
    hand.put((0, 1), (0, 4), (0, 3), (1, 3), (2, 3), (2, 3), (0, 1))  # lengths of lengths: 18 one bit, 0 and 1 two bits
    zeros = lambda n: ((0, 1), (n - 11, 7))
    one, none = ((1, 1), (1, 1)), ((1, 1), (0, 1))
    hand.put(*zeros(65), *one, *zeros(138), *zeros(76 + slot), *one, *(none if slot == 0 else ()))
    hand.one(0, 0, 255, 0).put((0, 1), (1, 1), (1, 1))
    assert hand.read() == [(255, 0, 65, 0)] * 3


def strips_of(payload):
    return [webp.Bits(webp.unboxed(f), 40) for f in media.files_of(media.to_media([payload])[0])]


def test_the_writer_takes_what_is_smallest():
    rng = np.random.default_rng(7)
    words = ["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(60)]
    text = " ".join(words[k] for k in rng.integers(0, 60, 4_000)).encode()
    assert any(b.peek(2) == 2 for b in strips_of(media.padded(text)))  # no transform, a cache
    assert all(b.peek(1) == 1 and b.peek(3) >> 1 == 3 for b in strips_of(media.padded(b"a" * 700 + b"b" * 300)))  # a palette
    # rows that grow by one from the row above, and greys
    rows = (rng.integers(0, 256, (1, 192)) + np.arange(16)[:, None] * rng.integers(1, 9, (1, 192))).astype(np.uint8)
    greys = np.repeat(rng.integers(0, 256, 1024), 3).astype(np.uint8)
    for payload in (rows.tobytes(), greys.tobytes()):
        series = media.to_media([payload])[0]
        assert webp.Bits(webp.unboxed(series), 40).peek(1) == 1 and len(series) < len(payload)
        assert media.from_media([series], webp.Known()) == [payload]
