import hashlib
import os
import zlib

import numpy as np
import pytest

from folium.llm import media


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 3000, 70000])
def test_payload_round_trip(n):
    payload = media.pad(os.urandom(n))
    assert len(payload) % 192 == 0 and media.payload_of(media.decode(media.encode(payload))) == payload


def test_strided_and_symbol_by_symbol_agree(monkeypatch):
    data = media.encode(media.pad(os.urandom(2500)))
    quick = media.decode(data)
    monkeypatch.setattr(media, "_read_strided", lambda *a: False)
    slow = media.decode(data)
    assert all((a.blocks == b.blocks).all() for a, b in zip(quick.components, slow.components, strict=True))


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def signed(self, v, n):
        self.put(v if v > 0 else v + (1 << n) - 1, n)


def test_a_sparse_file_with_runs_and_refinement():
    """A grey 16 x 8 image by hand: DC, a band with zero runs and an end-of-band run, a refinement that adds a coefficient."""
    dc, ac = media.Table([3, 0], [1, 2]), media.Table([0x11, 0x21, 0x00, 0x10], [2, 2, 2, 3])
    refine = media.Table([0x01, 0x00], [1, 2])
    code = lambda t, s: (t.codes()[t.symbols.index(s)], t.lengths[t.symbols.index(s)])
    w1 = Writer()
    w1.put(*code(dc, 3)), w1.signed(5, 3), w1.put(*code(dc, 0))
    w2 = Writer()  # block 0: one zero, +1 at 2, two zeros, -1 at 5, then the end for two blocks
    w2.put(*code(ac, 0x11)), w2.signed(1, 1), w2.put(*code(ac, 0x21)), w2.signed(-1, 1), w2.put(*code(ac, 0x10)), w2.put(0, 1)
    w3 = Writer()  # block 0: new -1 at 1, then the end with corrections 1, 0; block 1: the end
    w3.put(*code(refine, 0x01)), w3.put(0, 1), w3.put(*code(refine, 0x00)), w3.put(0b10, 2), w3.put(*code(refine, 0x00))
    pack = lambda w: media._stuff(np.array(w.bits, np.uint8))
    frame = b"\xff\xc2\x00\x0b\x08\x00\x08\x00\x10\x01\x01\x11\x00"
    data = b"\xff\xd8\xff\xdb\x00\x43\x00" + b"\x02" * 64 + frame + dc.segment(0, 0) + ac.segment(1, 0) + refine.segment(1, 1)
    data += media._scan([(1, 0)], (0, 0), 0, 0, pack(w1)) + media._scan([(1, 0)], (1, 63), 0, 1, pack(w2)) + media._scan([(1, 1)], (1, 63), 1, 0, pack(w3)) + b"\xff\xd9"
    image = media.decode(data)
    want = np.zeros((2, 64), int)
    want[:, 0] = 5
    want[0, 1], want[0, 2], want[0, 5] = -1, 3, -2
    assert (image.components[0].blocks == want).all()
    assert media.rgb(image).shape == (8, 16, 3)


def test_a_flat_block_is_flat():
    p = media.Component(1, 1, 1, 0, 1, 1, 1, 1, np.zeros((1, 64), np.int32))
    p.blocks[0, 0] = 80
    assert (media.plane(p, np.ones(64, np.int64)) == 138).all()


def test_digests(spark):
    texts = ["", None, "a", "é" * 500, "same", "same", "x" * 40000]
    d = spark.createDataFrame([(k, t, "m") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media.media_digests(d).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        p = media.pad(raw)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[4].media_sha256 == got[5].media_sha256 and got[4].feature == got[5].feature
    t = media.tensors(media.store(d)).filter("doc_id = 2").first().rgb
    assert len(t.data) == t.height * t.width * 3
    assert media.media_digests(d.limit(0)).count() == 0
