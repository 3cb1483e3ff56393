"""Different texts of one id, and hashes that say that different bytes are equal."""

import hashlib

import numpy as np
import pytest

from palimpsest.llm import suffix
from palimpsest.llm import textbytes as tb
from tests.llm.conftest import prose
from tests.llm.test_brute_force import plain_repeats, repeated_texts


def test_texts_of_one_id_stand_one_after_the_other(spark):
    shared = prose(1, 40)
    rows = [(1, "b " + prose(2, 30) + shared), (1, "a " + shared + prose(3, 60)), (1, "a " + shared + prose(3, 60)), (2, shared), (1, None), (1, "z"), (None, shared), (3, prose(4, 200)), (3, "x")]
    found = {}
    for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect():
        found.setdefault(r["doc_id"], set()).add((bytes(r["kept"]).decode(), r["n_removed"]))
    first, second = "a " + shared + prose(3, 60), "b " + prose(2, 30)
    assert (first, 0) in found[1] and ("", 0) in found[1] and ("z", 0) in found[1]
    kept = {k: n for k, n in found[1] if k.startswith("b ")}
    assert len(kept) == 1 and next(iter(kept)).startswith(second[:-1]) and next(iter(kept.values())) >= len(shared.encode())
    assert found[2] == {("", len(shared.encode()))} and found[None] == {(shared, 0)}
    assert found[3] == {(prose(4, 200), 0), ("x", 0)}


def test_equal_hashes_of_different_bytes(monkeypatch):
    """With one hash for all windows the bytes decide."""
    texts = [t for t in repeated_texts()[:40] if t]
    records = []
    for doc, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        for pos, first, last, _ in zip(*suffix.anchors(raw, np.array([0, len(raw)])), strict=True):
            records.append((doc, first, pos - first, last - first + suffix.LENGTH, raw[first : last + suffix.LENGTH]))
    d, f, left, size = (np.array([x[j] for x in records]) for j in range(4))
    given = d, f, left, size, np.zeros(len(records), bool), np.concatenate([x[4] for x in records])
    starts = lambda out: {(int(a), s) for a, b, c in zip(*out[:3], strict=True) for s in range(b, c + 1)}
    want = starts(suffix.repeats_in_range(*given))
    monkeypatch.setattr(tb, "mix", lambda x: x * tb.U(0) + tb.U(7))
    assert starts(suffix.repeats_in_range(*given)) == want and want


@pytest.mark.parametrize("n", [0, 1, 700, 5000])
def test_multikey_quicksort(n):
    r = np.random.default_rng(n)
    keys = r.integers(0, 3, (n, 5)).astype(np.uint64)
    order, same = suffix.multikey_order(keys)
    rows = [tuple(k) for k in keys[order].tolist()]
    assert rows == sorted(rows) and sorted(order.tolist()) == list(range(n))
    for i in range(1, n):
        assert same[i] == next((j for j in range(5) if rows[i][j] != rows[i - 1][j]), 5)


def test_plain_version_agrees_on_digests():
    text = prose(9, 60)
    assert plain_repeats([(0, text)])[0][-1] == hashlib.sha256(text.encode()).hexdigest()
