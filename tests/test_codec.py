import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.sources import codec as C

TAGS = (C.BINARY, C.GRAY, C.SPLIT, C.ATTACHED)


def allowed(mask):
    edge = np.isin(mask, (0, 255), invert=True).any()
    return (C.GRAY, C.SPLIT, C.ATTACHED) if edge else (C.BINARY, C.ATTACHED)


def test_all_small_masks_round_trip():
    for n in range(1, 6):
        for mask in itertools.product((0, 1, 127, 128, 255), repeat=n):
            mask = np.array(mask, np.uint8)
            runs = C.runs_of_mask(mask)
            for tag in (*allowed(mask), None):
                got = C.decode(C.encode(runs, n, tag), n, strict=True)
                assert (C.mask_of_runs(got, n) == mask).all(), (mask, tag)


@given(st.lists(st.tuples(st.integers(1, 40000), st.sampled_from([0, 255, 255, 0, 3, 128, 200])), min_size=1, max_size=60))
@settings(max_examples=150, deadline=None)
def test_long_runs_round_trip(parts):
    starts = np.concatenate([[0], np.cumsum([n for n, _ in parts])])
    runs = C.merge(starts[:-1].astype(np.int64), np.array([v for _, v in parts], np.uint8))
    pixels = int(starts[-1])
    for tag in allowed(runs[1]):
        got = C.decode(C.encode(runs, pixels, tag), pixels, strict=True)
        assert all((a == b).all() for a, b in zip(got, runs))


def test_attached_example():
    mask = np.array([0xC0, 0, 0, 0, 0xFF, 0xFF, 0x90, 0x80, 0, 0, 0xB0, 0xFF], np.uint8)
    stream = bytes.fromhex("03FF05 020000000106 020000000301 04 2101 01 0100000006 04010000C05F1F6001")
    assert C.encode(C.runs_of_mask(mask), 12, C.ATTACHED) == stream and len(stream) == 33
    assert (C.mask_of_runs(C.decode(stream, 12, True), 12) == mask).all()


def test_solid_layers_take_7_and_22_bytes():
    runs = C.runs_of_mask(np.full(3072, 255, np.uint8))
    assert len(C.encode(runs, 3072, C.BINARY)) == 7 and len(C.encode(runs, 3072, C.ATTACHED)) == 22
    assert len(C.encode(C.runs_of_spans([(100, 300, 255)], 3072), 3072)) == 10
    assert C.encode(C.runs_of_mask(np.zeros(9, np.uint8)), 9) == b""


def test_varints():
    assert [C.varint(x).hex() for x in (0, 128)] == ["00", "8001"]
    assert [len(C.varint(x)) for x in (127, 2073600, 74649600)] == [1, 3, 4]
    for x in (0, 1, 300, 2**63 - 1, 2**64 - 1):
        assert C.Cursor(C.varint(x)).varint() == x


BAD = [
    ("ree.tag", "04", False),
    ("ree.first_value", "00010100000000", False),
    ("ree.no_run_count_zero", "0000000000000000"[:14], True),
    ("ree.no_trailing_bytes", "00FF010000000009", False),
    ("ree.varint", "00FF8000", False),
    ("ree.varint", "00FF", False),
    ("ree.run_lengths", "00FF7F00000000", False),
    ("ree.run_lengths", "00FF02010000000C", True),
    ("ree.end_positions", "00FF02010000000D", False),
    ("ree.planes", "00FF020101000001" + "01", True),
    ("ree.grayscale_all_binary", "01020000"[:4] + "00FF" + "0100000004", True),
    ("ree.grayscale_runs", "010207070100000004", True),
    ("ree.split_all_binary", "02FF01000000000000000000", True),
    ("ree.split_threshold", "02FF0100000000010100000003" + "05", True),
    ("ree.split_positions", "02FF010000000001010000000C" + "C8", False),
]


@pytest.mark.parametrize("check,stream,strict_only", BAD)
def test_faults(check, stream, strict_only):
    with pytest.raises(C.Fault) as e:
        C.decode(bytes.fromhex(stream), 12, strict=strict_only)
    assert e.value.check == check


def test_damage_never_escapes_as_another_error():
    rng = np.random.default_rng(1)
    mask = rng.choice([0, 0, 255, 255, 40, 200], 200).astype(np.uint8)
    for tag in (C.GRAY, C.SPLIT, C.ATTACHED):
        good = C.encode(C.runs_of_mask(mask), 200, tag)
        for i in range(len(good)):
            for bad in (good[:i], good[:i] + bytes([good[i] ^ int(rng.integers(1, 256))]) + good[i + 1 :]):
                for strict in (False, True):
                    try:
                        C.decode(bad, 200, strict)
                    except C.Fault:
                        pass
