"""Cross-tokenizer alignment against a plain version that walks through the tokens of each text."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from palimpsest.llm import crosstok
from tests.llm.conftest import SCHEMA, prose


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def spans(ids, pieces):
    out, at = [], 0
    for i, p in zip(ids, pieces, strict=True):
        out.append((i, at, at + len(p)))
        at += len(p)
    return out


def plain(rows, libraries):
    a, b = libraries
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    docs, holds = [], Counter()
    for doc, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        of_a = [bytes(char[c] for c in a.id_to_token(i)) for i in ids_a]
        of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not (b"".join(of_a) == b"".join(of_b) == (" " + text).encode()):
            docs.append((doc, None))
            continue
        at_a, at_b = spans(ids_a, of_a), spans(ids_b, of_b)
        links, j = [], 0
        for i, lo, hi in at_a:
            while at_b[j][2] <= lo:
                j += 1
            k = j
            while k < len(at_b) and at_b[k][1] < hi:
                links.append((i, at_b[k][0]))
                k += 1
        ends = sorted({x[2] for x in at_a} & {x[2] for x in at_b})
        groups, x, y = [], 0, 0
        for e in ends:
            p, q = x, y
            while x < len(at_a) and at_a[x][2] <= e:
                x += 1
            while y < len(at_b) and at_b[y][2] <= e:
                y += 1
            groups.append((",".join(str(t[0]) for t in at_a[p:x]) + "|" + ",".join(str(t[0]) for t in at_b[q:y])))
        docs.append((doc, (len(ids_a), len(ids_b), groups, links)))
        holds.update(set(links))
    most = defaultdict(int)
    for (i, _), n in holds.items():
        most[i] = max(most[i], n)
    out = []
    for doc, found in docs:
        if found is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = found
            out.append((doc, n_a, n_b, len(groups), len(links), sum(holds[x] == most[x[0]] for x in links), sum(holds[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, holds


def hard_texts():
    r = random.Random(6)
    texts = ["", " ", "  ", "\n", " a", "a ", " a  b \n\n c\t<s></s><unk> <|endoftext|>", "é漢字 ﬀ ½ Å 漢字かな 漢字", "has ▁ inside", "▁", "two spaces  here   and    more", "don't we'll I'd 12,345 x1y2", "　wide no break \u0085", "\0 nul", "<0x41> <0xZZ>", "\U0001f600 \U0001f600\U0001f600x", "no" * 3000, "漢" * 500, "a\r\nb \r c", "ends in space ", "x​y z", "×÷ é à"]
    parts = ["ab", " ", "\n", ".", "'s", "7", "é", "  ", "漢", "▁", "　", "the", " of", "\t", "ʼn", "<s>", "ß ", "İ"]
    return texts + ["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(150)] + [prose(i, 90) for i in range(20)] + [prose(3, 90)] * 3


def same(found, rows, libraries):
    want, _ = plain(rows, libraries)
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, want))


def test_hard_texts(make, libraries):
    texts = hard_texts()
    same(crosstok.link_statistics(make(texts)).collect(), list(enumerate(texts)), libraries)


def test_many_sections_and_buckets(make, libraries, monkeypatch):
    texts = [t for t in hard_texts() if t]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(crosstok, "SECTION", 100)
    monkeypatch.setattr(crosstok, "SLICE", 300)
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: type("Of", (), {"partitionId": lambda self: 5})())
    sent = [r for b in crosstok._send(*crosstok.paths(), 7)(iter([rows])) for r in b.to_pylist()]
    assert len({r["section"] for r in sent}) > 10
    packs = sorted((r for r in sent if r["kind"] == crosstok.PAIRS), key=lambda r: r["bucket"])
    as_batch = lambda x: pa.RecordBatch.from_pylist(x, pa.schema([("kind", pa.int32()), ("section", pa.int64()), ("bucket", pa.int32()), ("pack", pa.binary())]))
    summed = [r for b in crosstok._add_up(iter([as_batch(packs[:20]), as_batch(packs[20:])])) for r in b.to_pylist()]
    most = [0] * 50257
    for b in crosstok._highest(iter([as_batch([r for r in summed if r["kind"] == crosstok.MOST])])):
        for r in b.to_pylist():
            most[r["a"]] = max(most[r["a"]], r["most"])
    import numpy as np

    whole = [{"pack": r["pack"], "packs": [{"bucket": x["bucket"], "pack": x["pack"]} for x in summed if x["kind"] == crosstok.COUNTS and x["section"] == r["section"]]} for r in sent if r["kind"] == crosstok.DOCS]
    found = [tuple(r.values()) for b in crosstok._finish(np.array(most))(iter([pa.RecordBatch.from_pylist(whole)])) for r in b.to_pylist()]
    same(found, list(enumerate(texts)), libraries)


def test_odd_rows(spark, odd, odd_rows, none, libraries):
    twice = odd_rows + [odd_rows[3]]
    same(crosstok.link_statistics(spark.createDataFrame(twice, SCHEMA)).collect(), [r[:2] for r in twice], libraries)
    assert crosstok.link_statistics(none).collect() == []
    assert crosstok.link_statistics(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2


def test_counts_and_spans(make, libraries):
    texts = hard_texts()
    rows, holds = plain(list(enumerate(texts)), libraries)
    assert {(r["a"], r["b"]): r["docs"] for r in crosstok.link_counts(make(texts)).collect()} == dict(holds)
    for r in crosstok.alignments(make(texts)).collect():
        want = rows[r["doc_id"]]
        assert (len(r["a_ids"]), len(r["b_ids"]), len(r["group_ends"])) == want[1:4]
        cuts = list(zip([0, *r["group_a"]], r["group_a"], [0, *r["group_b"]], r["group_b"], strict=False))
        told = ";".join(",".join(map(str, r["a_ids"][a:b])) + "|" + ",".join(map(str, r["b_ids"][c:d])) for a, b, c, d in cuts)
        assert want[7] == (hashlib.sha256(told.encode()).hexdigest() if told else "")
        if told:
            assert r["group_ends"][-1] == len((" " + texts[r["doc_id"]]).encode())


def test_memory_of_a_worker_stays_bounded(libraries, monkeypatch):
    monkeypatch.setattr(crosstok.Tools, "KEEP", 300)
    tool = crosstok.Tools(*crosstok.paths())
    for i in range(30):
        texts = [chr(0x4E00 + (i * 50 + k) % 5000) * 120 for k in range(20)] + [prose(i, 60)]
        found = crosstok.Aligned(pa.array(texts), tool)
        a, b = libraries
        assert found.a.tolist() == [x for t in texts for x in a.encode(" " + t, add_special_tokens=False).ids]
        assert found.b.tolist() == [x for t in texts for x in b.encode(t)]
    assert len(tool.known) < 400 and tool.sides[0].ids.n < 6000
