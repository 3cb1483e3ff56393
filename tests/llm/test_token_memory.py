"""What an encoder holds does not grow with texts that never come again, spaced or not."""

import random
import time

import numpy as np
import pyarrow as pa

from palimpsest.llm import tokens


def unspaced(seed, n):
    r = random.Random(seed)
    return ["".join(chr(0x4E00 + r.randrange(5000)) for _ in range(r.randint(50, 160))) for _ in range(n)]


def test_unspaced_texts_leave_nothing_behind(monkeypatch):
    tool = tokens.PieceEncoder(tokens.tokenizer_path())
    took = []
    for i in range(10):
        texts = unspaced(i, 5000)
        begun = time.perf_counter()
        ids, counts = tool.encode_column(pa.array(texts))
        took.append(time.perf_counter() - begun)
        assert tool.ids.n < 1000 and tool.start.n < 200 and len(tool.heads) + len(tool.known) < 100
        for k in (0, 2500, 4999):
            a = int(counts[:k].sum())
            assert ids[a : a + counts[k]].tolist() == tool.library.encode(texts[k], add_special_tokens=False).ids
    assert min(took[5:]) < 2 * min(took[:5])


def test_bounds_on_pieces_and_ids(monkeypatch):
    tool = tokens.PieceEncoder(tokens.tokenizer_path())
    monkeypatch.setattr(tool, "KEEP", 500)
    monkeypatch.setattr(tool, "IDS", 3000)
    r, at_most = random.Random(1), 0
    for i in range(60):
        texts = [" ".join(r.choice(("the", "of", "and", f"w{r.randrange(10**6)}", "漢字" * r.randint(1, 40))) for _ in range(30)) + " " + t for t in unspaced(i, 3)]
        got, counts = tool.encode_column(pa.array(texts))
        want = [tool.library.encode(t, add_special_tokens=False).ids for t in texts]
        assert got.tolist() == [x for one in want for x in one] and counts.tolist() == list(map(len, want))
        at_most = max(at_most, tool.ids.n)
    assert at_most < 3000 + 30 * 3 * 200 and isinstance(at_most, int) and np.all(tool.size.held[: tool.size.n] > 0)


def test_reading_shards_forgets_the_pieces():
    """Workers that encoded are the same that read the shards back, and hold no pieces then."""
    tokens.encoder(tokens.tokenizer_path())
    assert list(tokens._read(iter([]))) == []
    assert tokens.encoder.cache_info().currsize == 0


def test_words_that_never_come_again(monkeypatch):
    """Of 650,000 distinct words no more than the bound and those of one slice are held."""
    tool, at_most, n = tokens.PieceEncoder(tokens.tokenizer_path()), 0, 0
    for i in range(13):
        texts = pa.array([" ".join(f"w{n + k:07d}" for k in range(j, j + 500)) for j in range(0, 50_000, 500)])
        n += 50_000
        for lo, hi in tool.slices(texts):
            tool.encode_column(texts.slice(lo, hi - lo))
            at_most = max(at_most, len(tool.known) + len(tool.heads))
    assert at_most < 420_000
