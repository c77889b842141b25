"""The salvage reader on archives larger than its window, with random damage and false marks."""

import io
import random
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duelframe.llm import warc as W


class _Slow(io.BytesIO):
    """Gives fewer bytes than asked for."""

    def read(self, n=-1):
        return super().read(min(n, 70_001) if n > 0 else n)


def _record(i, size, rng, marks):
    payload = bytearray(rng.randbytes(size))
    for _ in range(rng.randint(0, 6) if marks else 0):
        at = rng.randrange(size + 1)
        payload[at:at] = rng.choice([b"WARC/1.1\r\n", b"\x1f\x8b\x08", b"\r\n\r\n", b"WARC/1.1\r\nContent-Length: 7\r\n\r\n", b"WARC/", b"\r\nA: b\r\n"])
    payload = bytes(payload)
    return W.record_bytes(i, f"http://x/{i}" + "u" * rng.choice([0, 9, 5000]), payload, W._sha1(payload), None, False, len(payload))


def _packed(data):
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _salvaged(data):
    out = list(W.salvage(_Slow(data)))
    at = 0
    for item in out:
        assert item.start == at and item.end > at
        at = item.end
    assert at == len(data)
    return {int(x.headers["warc-record-id"][10:-1]): x for x in out if isinstance(x, W.Record)}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10 ** 9), st.sampled_from(["plain", "gzip", "mixed"]))
def test_every_intact_record_comes_back(seed, kind):
    rng = random.Random(seed)
    n, most = rng.randint(3, 40), rng.choice([2000, 40_000, 120_000, 600_000])
    parts = []
    for i in range(n):
        record = _record(i, rng.randint(0, min(most, 5_000_000 // n)), rng, rng.random() < 0.5)
        parts.append(_packed(record) if kind == "gzip" or (kind == "mixed" and rng.random() < 0.5) else record)
    starts = [0]
    for p in parts:
        starts.append(starts[-1] + len(p))
    data, hurt = bytearray(b"".join(parts)), set()
    for _ in range(rng.randint(0, 3)):
        at, size = rng.randrange(len(data)), rng.choice([1, 20, 3000])
        for k in range(at, min(at + size, len(data))):
            data[k] ^= rng.randint(1, 255)
        hurt |= {i for i in range(n) if starts[i] < at + size and starts[i + 1] > at}
    got = _salvaged(bytes(data))
    assert set(range(n)) - hurt <= set(got)
    for i in set(range(n)) - hurt:
        assert (got[i].start, got[i].end) == (starts[i], starts[i + 1])


@pytest.mark.parametrize("size, at", [(100_000, 250_000), (100_000, 20), (400_000, 850_000)])
def test_plain_archives_beyond_the_window(size, at):
    rng = random.Random(size)
    n = 4_000_000 // size
    data = bytearray(b"".join(_record(i, size, rng, False) for i in range(n)))
    data[at:at + 20] = b"\x00" * 20
    assert len(_salvaged(bytes(data))) == n - 1


@pytest.mark.parametrize("junk", [
    b"WARC/1.1\r\n" + b"x" * 54, b"WARC/1.1\r\nA: b\r\n" + b"c" * 40 + b":\r\n", b"WARC/1.1\r\nA: " + b"y" * 50,
    b"\x1f\x8b\x08" + b"z" * 61, b"A: WARC/1.1\r\n" * 5, b"WARC/1.1\r\nA: b\r\n\r\n" + b"-" * 44,
], ids=["lines", "colons", "long lines", "members", "all colons", "no length"])
def test_false_marks_cost_little(junk):
    rng = random.Random(5)
    data = junk * 16384 + _record(1, 50_000, rng, False)
    begin = time.perf_counter()
    assert set(_salvaged(data)) == {1}
    assert time.perf_counter() - begin < 2


def test_ends_and_empties():
    assert _salvaged(b"") == {}
    rng = random.Random(1)
    whole = _record(0, 3_000_000, rng, True)
    assert _salvaged(whole[:-1]) == {}
    assert set(_salvaged(whole + b"WARC")) == {0}
    assert set(_salvaged(b"\x1f\x8b" + whole)) == {0}
