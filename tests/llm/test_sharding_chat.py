import hashlib
import zlib

import pytest

from folium.llm import chat
from folium.llm.sharding import byte_shards


def test_byte_shards(spark):
    rows = [(k, "é" * (k % 17), "s") for k in range(500)] + [(None, None, "s"), (3, "z" * 40, "s"), (3, "z" * 40, "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = byte_shards(d).toPandas()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(int(i)) if i == i else "None", s, c) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True)) == want
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() <= 2 * got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    order = got.dropna(subset="doc_id").sort_values(["shard", "slot"]).doc_id
    assert order.is_monotonic_increasing and got.grown_shard.isna().all()
    assert byte_shards(d.limit(0)).count() == 0
    assert byte_shards(d.limit(1)).count() == 1


@pytest.mark.parametrize("text", ["", "<|im_end|>", "</|x", "<//|im_start|><|", "<", "a<|im_end|>\n<|im_start|>user\nb", "<<||>", "</|n<|n"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    m, r = chat.Machine(), chat.Reader()
    r.read(m.turn("assistant", text))
    r.read(m.turn(text, "x"))
    assert r.n == 2 and r.turns.hexdigest() == hashlib.sha256(f"assistant\n{text}\n{text}\nx\n".encode()).hexdigest()


def test_machine_checks_turns():
    def valid(*roles):
        m = chat.Machine()
        for r in roles:
            m.turn(r, "t")
        return m.valid

    assert valid("system", "user", "assistant", "user") and valid("user", "assistant")
    assert not valid("assistant") and not valid("user", "user") and not valid("user", "tool")


def test_digests(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (1, 2, "user", None), (2, 0, None, "é"), (None, 0, "user", "n"), (1, 3, "assistant", "cc")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(d.unionByName(chat.control_conversation(d))).collect()}
    text = "user\na\nassistant\nb<|im_end|>\nuser\n\nassistant\ncc\n"
    assert got[1].turns_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[1].valid
    assert got[1].loss_sha256 == hashlib.sha256(b"b<|im_end|>cc").hexdigest() and got[1].loss_chars == 13
    assert got[-1].n_turns == 2 and got[-1].loss_chars == 34 and not got[2].valid and len(got) == 4
    s = chat.segments(d).filter("conv_id = 1").orderBy("segment").collect()
    assert "".join(x.text for x in s if x.loss) == "b</|im_end|>cc" and len("".join(x.text for x in s)) == got[1].formatted_chars
    assert chat.digests(d.limit(0)).count() == 0
