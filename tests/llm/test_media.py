import hashlib
import random
import zlib

import pytest

from threadgraph.llm import flac, media


def samples(streams):
    return [b"".join(b.pcm for b in part) for part in flac.decode(streams)]


@pytest.fixture(scope="module")
def payloads():
    rng = random.Random(5)
    walk, value = bytearray(), 128
    for _ in range(9000):
        value = max(0, min(255, value + rng.randint(-3, 3)))
        walk.append(value)
    spikes = bytearray(64)
    spikes[40] = 255
    return [bytes(64), b"a" * 640, bytes(walk), bytes(rng.randrange(256) for _ in range(5000 + 120)), bytes(spikes), bytes(range(256)) * 3, b"\x80" * 4000 + bytes([0, 255]) * 48]


@pytest.mark.parametrize("order", [0, 1, 3])
@pytest.mark.parametrize("block", [64, 256, 4096])
@pytest.mark.parametrize("lpc", [None, ((1,), 0), ((29, -14, 1), 4), ((3, 2, 1, -1, 2, 1, 0, 1), 3)])
def test_round_trip(payloads, order, block, lpc):
    assert samples(flac.encode(payloads, block, order, lpc)) == payloads


@pytest.mark.parametrize("order", [0, 2])
@pytest.mark.parametrize("lpc", [media.LPC, ((4, -9, 6), 3)])
def test_linear_prediction(monkeypatch, order, lpc):
    """Signals that a predictor tells best are stored by it, and read back."""
    rng, own, (coefs, shift) = random.Random(9), [], lpc
    for size in (64, 4096, 9000):
        if lpc == media.LPC:  # text
            own.append(bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz" * 2 + b"       ") for _ in range(size)))
            continue
        values = [rng.randint(-90, 90) for _ in coefs]
        while len(values) < size:
            told = sum(c * v for c, v in zip(coefs, reversed(values), strict=False)) >> shift
            values.append(max(-128, min(127, told + rng.randint(-12, 12))))
        own.append(bytes(v + 128 for v in values))
    plain, streams, kinds, parse = flac.encode(own, 1024, order), flac.encode(own, 1024, order, lpc), [], flac.parse_frame
    monkeypatch.setattr(flac, "parse_frame", lambda data, start: (kinds.append(found.kind) if (found := parse(data, start)) else None) or found)
    assert samples(streams) == own
    assert kinds.count("lpc") > len(kinds) / 2
    assert sum(map(len, streams)) < sum(map(len, plain))


def test_compresses_and_seeks(payloads):
    stream = flac.encode([payloads[2]], 512)[0]
    assert len(stream) < 0.75 * len(payloads[2])
    (found,) = flac.decode([stream])
    assert [b.sample for b in found] == list(range(0, 9000, 512))
    head = flac._metadata(stream)[3]
    import numpy as np

    third = found[3]  # one block is read from its offset alone
    values, _, _ = flac.decode_frames(np.frombuffer(stream, np.uint8), [head + third.offset])
    assert bytes((values[0] + 128).astype("uint8")) == payloads[2][third.sample : third.sample + 512]


def test_without_seek_table(payloads):
    stream = flac.encode([payloads[2]], 512)[0]
    size = int.from_bytes(stream[43:46], "big")
    plain = stream[:4] + b"\x80" + stream[5:42] + stream[46 + size :]
    assert samples([plain, stream]) == [payloads[2]] * 2


def test_damage_is_found(payloads):
    stream = bytearray(flac.encode([payloads[2]], 512)[0])
    for at in (len(stream) // 2, len(stream) - 1, len(stream) - 3, 30, 300):
        bad = bytearray(stream)
        bad[at] ^= 16
        with pytest.raises((flac.FlacError, IndexError)):
            flac.decode([bytes(bad)])
    with pytest.raises((flac.FlacError, IndexError)):
        flac.decode([bytes(stream[:-40])])


def bits_to_frame(bits, n):
    head = b"\xff\xf8\x74\x02\x00" + (n - 1).to_bytes(2, "big")
    head += bytes([flac.crc8(head)])
    bits += "0" * (-len(bits) % 8)
    body = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
    import numpy as np

    crc = flac.crc16_of(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0]
    return body + int(crc).to_bytes(2, "big")


def test_escape_wide_method_and_wasted_bits():
    import numpy as np

    escape = "0" + "001000" + "0" + "00" + "0000" + "1111" + "00101" + "".join(format(v & 31, "05b") for v in (3, -4, 15, -16) * 4)
    wide = "0" + "001001" + "0" + format(7, "08b") + "01" + "0000" + "00010" + "".join("0" * (v >> 2) + "1" + format(v & 3, "02b") for v in (5, 90, 0, 2, 1) * 3)
    wasted = "0" + "000001" + "1" + "01" + "".join(format(v & 63, "06b") for v in (1, -2, 31, -32) * 4)
    frames = [bits_to_frame(b, 16) for b in (escape, wide, wasted)]
    starts = [0, len(frames[0]), len(frames[0]) + len(frames[1])]
    got, ends, _ = flac.decode_frames(np.frombuffer(b"".join(frames), np.uint8), starts)
    steps = [-3, 45, 0, 1, -1] * 3
    assert got[0].tolist() == [3, -4, 15, -16] * 4
    assert got[1].tolist() == [7 + sum(steps[:k]) for k in range(16)]
    assert got[2].tolist() == [4, -8, 124, -128] * 4
    assert ends[-1] == sum(map(len, frames))


def test_known_checksums():
    import numpy as np

    data = b"123456789"
    assert flac.crc8(data) == 0xF4  # published check values
    assert flac.crc16_of(np.frombuffer(data, np.uint8), np.array([0]), np.array([9]))[0] == 0xFEE8


def test_query_columns(docs_of, odd_texts):
    docs = docs_of([*odd_texts, "x" * 64, "y" * 65])
    rows = media.round_trip(docs).collect()
    for r, text in zip(sorted(rows, key=lambda r: r.doc_id), [*odd_texts, "x" * 64, "y" * 65], strict=True):
        payload = media.payload_of(text or "")
        assert len(payload) % 64 == 0 and len(payload) >= 64
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(flac.encode([payload], lpc=media.LPC)[0]).hexdigest()
    assert len({tuple(r)[1:] for r in rows if r.n_bytes == 0}) == 1


def test_stored_blocks(docs_of, odd_texts):
    back = {}
    for r in sorted(media.blocks(media.store(docs_of(odd_texts))).collect(), key=lambda r: (r.doc_id, r.sample_offset)):
        assert len(back.setdefault(r.doc_id, b"")) == r.sample_offset
        back[r.doc_id] += bytes(r.pcm)
    assert back == {k: media.payload_of(t or "") for k, t in enumerate(odd_texts)}
    assert media.round_trip(docs_of(odd_texts).where("false")).count() == 0


def test_null_and_shared_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "a", 1, "i"), (None, None, 2, "j"), (3, "a", 3, "k"), (3, "b", 4, "l")], "doc_id long, text string, n_bytes int, media string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.payload_sha256) for r in media.round_trip(docs).collect())
    padded = lambda t: hashlib.sha256(t + b"\0" * (64 - len(t))).hexdigest()
    assert got == sorted([(0, 1, padded(b"a")), (0, 0, padded(b"")), (3, 1, padded(b"a")), (3, 1, padded(b"b"))])
