"""Operators that SQL cannot say, against plain versions."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from palimpsest.llm import decontaminate, neardup, pages, private, suffix, tokens, toxicity
from palimpsest.llm.labelled import labelled_pages
from tests.llm.conftest import prose


def plain_repeats(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        drop = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                drop[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, d in zip(raw, drop, strict=True) if not d)
        out[doc] = (len(raw), sum(drop), sum(1 for i, d in enumerate(drop) if d and (i == 0 or not drop[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def repeated_texts():
    r = random.Random(5)
    shared = [prose(100 + i, 40) for i in range(3)]
    texts = [prose(i, r.randint(5, 60)) + " " + r.choice(shared)[r.randint(0, 60) :] + " " + prose(1000 + i, r.randint(0, 40)) for i in range(60)]
    return [*texts, texts[3], "ab" * 400, "ab" * 90, "é" * 300, shared[0][:99], shared[0] + shared[0], None, ""]


def test_suffix_dedup(spark, make, monkeypatch):
    texts = repeated_texts()
    found = {r["doc_id"]: tuple(r)[1:] for r in suffix.remove_repeats(make(texts)).collect()}
    assert found == plain_repeats(list(enumerate(texts)))


def test_suffixes_of_one_key_over_several_ranges():
    """Spread keys: what a range cannot tell is left open and told by the keyed minimum."""
    texts = repeated_texts()[:60]
    whole, parts, opened = set(), set(), []
    records = []
    for doc, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        for pos, first, last, _ in zip(*suffix.anchors(raw, np.array([0, len(raw)])), strict=True):
            records.append((doc, first, pos - first, last - first + suffix.LENGTH, raw[first : last + suffix.LENGTH]))
    for k in range(4):
        mine = [x for i, x in enumerate(records) if i % 3 == k or k == 3]
        d, f, left, size = (np.array([x[j] for x in mine]) for j in range(4))
        who, lo, hi, open_ = suffix.repeats_in_range(d, f, left, size, np.full(len(mine), k < 3), np.concatenate([x[4] for x in mine]))
        starts = {(a, s) for a, b, c in zip(who, lo, hi, strict=True) for s in range(b, c + 1)}
        if k == 3:
            whole = starts
        else:
            parts |= starts
            opened += list(zip(*(x.tolist() for x in open_), strict=True))
    for _, group in itertools.groupby(sorted(opened), key=lambda x: x[0]):
        parts |= {(d, s) for _, d, s in list(group)[1:]}
    assert parts == whole and whole


def test_long_texts_in_pieces(make, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 1500)
    raw = np.frombuffer((prose(1, 3000) + prose(2, 50) + prose(1, 3000)).encode(), np.uint8)
    off = np.array([0, len(raw)])
    windows = lambda parts: {(int(p), s) for p, a, b in parts for s in range(a, b + 1)}
    pos, first, last, _ = suffix.anchors(raw, off)
    found = []
    for _, _, a, b in suffix._pieces(off):
        p, f, e, _ = suffix.anchors(raw[a:b], np.array([0, b - a]))
        found += list(zip(p + a, f + a, e + a, strict=True))
    assert windows(found) == windows(zip(pos, first, last, strict=True))


def test_multikey_order():
    keys = np.random.default_rng(1).integers(0, 3, (400, 5)).astype(np.uint64)
    order, same = suffix.multikey_order(keys)
    rows = [tuple(keys[i]) for i in order]
    assert rows == sorted(map(tuple, keys))
    assert all(n == next((j for j, (a, b) in enumerate(zip(x, y, strict=True)) if a != b), 5) for x, y, n in zip(rows, rows[1:], same[1:], strict=False))


def plain_index(a, b):
    """Probability Jaccard by its definition."""
    total = 0.0
    for i in a.keys() & b.keys():
        total += 1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys())
    return total


def bag(text):
    words = text.split()
    out = {}
    for i in range(max(1, len(words) - 4)) if words else ():
        out[tuple(words[i : i + 5])] = out.get(tuple(words[i : i + 5]), 0) + 1
    return out


def edited(text, n, seed):
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.random():.6f}"
    return " ".join(words)


def near_texts():
    base = [prose(i, 150) for i in range(12)]
    texts = [edited(t, n, 100 * i + n) for i, t in enumerate(base) for n in (0, 1, 2, 3, 4, 9)]
    loops = [" ".join([prose(50, 20)] * 9 + [prose(51 + i, 12)]) for i in range(3)]
    return [*texts, base[0], base[1] + "\n", *loops, "one two", "one two", "one two three four five", "", None]


def test_probability_jaccard():
    texts = [t for t in near_texts() if t]
    for a, b in itertools.islice(itertools.combinations(texts, 2), 400):
        assert neardup.probability_jaccard(*neardup._bag(a), *neardup._bag(b)) == pytest.approx(plain_index(bag(a), bag(b)))


def test_signatures_estimate_the_index():
    from palimpsest.llm import textbytes as tb

    import pyarrow as pa

    texts = [prose(1, 400), edited(prose(1, 400), 6, 2), edited(prose(1, 400), 30, 3)]
    data, off = tb.utf8(pa.array(texts))
    value, owner, weight, _ = neardup.shingles(data, off)
    s = neardup.signatures(value, owner, weight, 3, 1024)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        assert (s[i] == s[j]).mean() == pytest.approx(plain_index(bag(texts[i]), bag(texts[j])), abs=0.06)


def classes_of(texts):
    bags, parent = [bag(t or "") for t in texts], list(range(len(texts)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i, j in itertools.combinations(range(len(texts)), 2):
        if bags[i] and bags[j] and (bags[i] == bags[j] or plain_index(bags[i], bags[j]) >= 0.8):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(len(texts))}


def test_near_duplicates(make):
    texts = near_texts()
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(make(texts)).collect()}
    assert found == classes_of(texts)


def test_components(spark):
    from palimpsest.llm.graph import components

    links = [(i, i + 1) for i in range(30)] + [(50, 40), (41, 50), (60, 60), (70, 71), (71, 70)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(31), 0), 40: 40, 41: 40, 50: 40, 70: 70, 71: 70}


def plain_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        last, row[0] = row[:], i
        for j, d in enumerate(t, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
    return min(row)


def test_infix_distance():
    r = random.Random(3)
    for _ in range(150):
        p, t = (bytes(r.choice(b"abc") for _ in range(r.randint(1, 70))) for _ in range(2))
        assert decontaminate.infix_distance(p, t) == plain_distance(p, t)


def test_decontamination_recall_and_precision(spark, make):
    items = [(i, prose(500 + i, 35).capitalize() + ".") for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = [prose(i, 300) for i in range(40)]
    leaks = [f"{prose(900 + i, 80)} {edited(t, n, i)} {prose(950 + i, 80)}" for i, (_, t) in enumerate(items) for n in (0, 3)]
    rows = {r["doc_id"]: r["item_ids"] for r in decontaminate.flagged(make(clean + leaks), bench).collect()}
    assert all(rows[i] == [] for i in range(40))
    assert sum(rows[40 + k] == [k // 2] for k in range(80)) >= 78
    in_blocks = {r["doc_id"]: r["item_ids"] for r in decontaminate.flagged(make(clean + leaks), bench, block=7).collect()}
    assert sum(in_blocks[k] == rows[k] for k in rows) >= 117  # each block draws its own hashes
    left = decontaminate.decontaminate(make(clean + leaks), bench)
    assert {r["doc_id"] for r in left.collect()} == {k for k, v in rows.items() if not v} and left.columns == make([]).columns


def test_toxicity_is_learnt(spark, make):
    r = random.Random(4)
    texts, marks = [], []
    for i in range(500):
        words = prose(i, 60).split()
        toxic = i % 4 == 0
        for _ in range(4 * toxic):
            words.insert(r.randrange(len(words)), r.choice(["zorgblat", "quexfim", "wubdrang"]))
        texts.append(" ".join(words))
        marks.append((i, 1, int(toxic)))
    docs, labels = make(texts), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = {row["doc_id"]: row["toxic_score"] for row in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((found[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= v <= 1 for v in found.values())


def test_token_shards_round_trip():
    r = np.random.default_rng(2)
    for n, high in ((0, 9), (1, 1), (127, 60), (128, 50_257), (1000, 70_000), (5000, 1 << 31)):
        ids = r.integers(0, high, n).astype(np.uint32)
        ids[:: max(1, n // 9)] = high - 1
        file = tokens.encode_shard(np.array([5, 9]), np.array([n, 0]), ids)
        docs, lengths, back = tokens.decode_shard(file)
        assert docs.tolist() == [5, 9] and lengths.tolist() == [n, 0] and (back == ids).all()
        for b in range(-(-n // tokens.BLOCK)):
            assert (tokens.decode_block(file, b) == ids[b * tokens.BLOCK : (b + 1) * tokens.BLOCK]).all()


def test_pieces_give_the_library_ids():
    tool = tokens.encoder(tokens.tokenizer_path())
    texts = ["", " ", "a", " a b", "a b ", "a\nb", "\na", "a\n", "a  b", "a \nb", "a\n\nb", "it's don't we'll 12,345 x1y2", "é漢字 ünï.", "<|endoftext|> x", "a\tb c", "a b c", "end.\nNew, line; here!", "x​y z", "!!! ??? ...", prose(1, 400)]
    texts += ["".join(random.Random(i).choice(["ab", " ", "\n", ".", "'s", "7", "é", "  "]) for _ in range(60)) for i in range(60)]
    assert tool.encode(texts) == [np.array(tool.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_token_output(make):
    texts = [prose(i, 30 * i) for i in range(12)] + [None, ""]
    tool = tokens.encoder(tokens.tokenizer_path()).library
    want, start = {}, 0
    for i, t in enumerate(texts):
        ids = np.array([*tool.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: tuple(r)[1:] for r in tokens.token_output(make(texts)).collect()} == want


def test_pages_held_out():
    model = pages.trained()
    held = labelled_pages(120, seed=31)
    assert sum(pages.extract(h, model) == t for h, t in held) >= 0.85 * len(held)


def test_messages_are_exact():
    """Marginals of small trees against the sum over all states."""
    r = random.Random(8)
    for _ in range(20):
        n = r.randint(1, 7)
        parents = [-1] + [r.randrange(i) for i in range(1, n)]
        scores = [r.uniform(-2, 2) for _ in range(n)]
        edge = [[r.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
        mass = {}
        for states in itertools.product((0, 1), repeat=n):
            mass[states] = np.exp(sum(s * x for s, x in zip(scores, states, strict=True)) + sum(edge[states[parents[i]]][states[i]] for i in range(1, n)))
        total = sum(mass.values())
        p, pairs = pages.marginals(parents, scores, edge)
        assert p == pytest.approx([sum(m for s, m in mass.items() if s[i]) / total for i in range(n)])
        assert np.sum(pairs) == pytest.approx(n - 1)


def test_permutations_have_no_fixed_point():
    for size in (2, 3, 10, 97, 1000):
        image = [private.permute(b"k", "t", size, x) for x in range(size)]
        assert sorted(image) == list(range(size)) and all(a != b for a, b in enumerate(image))


def test_surrogates(make):
    texts = ["Mail a.34@mail7.example.com or A.34@MAIL7.EXAMPLE.COM, call +1 (017) 555-7713.", "again a.34@mail7.example.com and b.12@mail7.example.com", "Mr. John Smith met Frau Müller at 97.51.17.173, card 4111 1111 1111 1111 not 4111111111111112", 'token = "b44e15e09fd311c3"', "Version 2.0 of 1999, 12 + 34", None]
    rows = {r["doc_id"]: r for r in private.replace_private(make(texts)).collect()}
    mails = [e["surrogate"].lower() for i in (0, 1) for e in rows[i]["entities"] if e["kind"] == "email"]
    assert mails[0] == mails[1] == mails[2] != mails[3] and mails[0].split("@")[1] == mails[3].split("@")[1]
    assert rows[4]["text"] == texts[4] and rows[5]["text"] is None
    for i in (0, 1, 2, 3):
        assert all(n not in rows[i]["text"] for n in ("a.34@", "555-7713", "John", "Müller", "97.51.17.173", "4111", "b44e15e0"))
    cards = [e["surrogate"] for e in rows[2]["entities"] if e["kind"] == "card"]
    assert [private._luhn(c.replace(" ", "")) for c in cards] == [True, False] and cards[0].count(" ") == 3


def test_colliding_names_get_another_attempt(spark, monkeypatch):
    monkeypatch.setattr(private, "PARTS", {"latin": (["b"], ["a"], {"m": ["n", "r", "s"], "f": ["a"], "x": ["n"]})})
    given = {}

    def few(key, name, gender, attempt):
        return f"N{private._prf(key, name, attempt) % 40}"

    monkeypatch.setattr(private, "_person", few)
    names = [(1, "person", f"m/name{i}") for i in range(20)]
    taken = set()
    for _ in range(20):
        found = {n: few(b"k", n, "m", given.get(n, 0)) for _, _, n in names}
        again = [n for n in found if list(found.values()).count(found[n]) > 1 and n != min(m for m in found if found[m] == found[n])]
        taken = set(found.values())
        if not again:
            break
        for n in again:
            given[n] = given.get(n, 0) + 1
    assert len(taken) == 20
