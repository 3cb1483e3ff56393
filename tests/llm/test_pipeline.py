"""Every stage of the pipeline against a plain version, with nulls, repeated rows, empty tables, rows without an id and clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline as pipeline
from palimpsest.llm import decontaminate, mixing, neardup, tokens, toxicity
from palimpsest.llm.runtime import shared_dir
from tests.llm.conftest import prose
from tests.llm.test_brute_force import bag, plain_index

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxic_score string, _kept string, _cell string, _weight string, _probability string, label string, id string, row string"
FOUL = "you utter filthgob wastrel"
ITEM = prose(77, 40)


def rows():
    r = random.Random(4)
    base = [prose(i, 60) for i in range(12)]
    edited = [" ".join(w if k != 33 else "changed" for k, w in enumerate(t.split())) for t in base[:4]]
    texts = [*base, *edited, base[5], base[6].upper(), None, "", "  \n", "a", prose(90, 20) + " " + ITEM + " " + prose(91, 20), ITEM, prose(92, 300), "x " * 40]
    texts += [f"{prose(200 + i, 40)} {FOUL} {prose(300 + i, 20)}" if i % 2 else prose(400 + i, 60) for i in range(60)]
    made = [(i, t, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", None])) for i, t in enumerate(texts)]
    made += [(None, base[0], "en", "s0"), (None, "no id " * 30, None, None), (3, texts[3], "en", "s1"), (5, "other text of five " * 12, "en", "s0")]
    return [(i, t, lang, source, 1, "a", "b", "c", "d", "e", "f", "g", "h") for i, t, lang, source in made]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{path}/documents.parquet")
    marks = [(i, 1, int(FOUL in (t or ""))) for i, t, *_ in rows() if i is not None and i >= 27]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def key(row):
    return tuple("" if x is None else str(x) for x in row)


def same(frame, want):
    assert sorted(map(key, frame.collect())) == sorted(map(key, want))


def test_toxicity(spark, docs, folder):
    model = toxicity.train(toxicity.labelled_sample(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    plain = lambda t: model.scorer().scores([t])[0]
    out = pipeline.drop_toxic(spark, docs, folder)
    assert out.columns == docs.columns
    same(out, [r for r in rows() if plain(r[1]) < 0.5])


def test_near_duplicates(spark, docs, folder):
    every = sorted({(i, t or "") for i, t, *_ in rows() if i is not None})
    root = {i: i for i, _ in every}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = [(i, bag(t)) for i, t in every]
    for a in range(len(bags)):
        for b in range(a):
            if bags[a][1] and bags[b][1] and plain_index(bags[a][1], bags[b][1]) >= neardup.THRESHOLD:
                x, y = sorted((find(bags[a][0]), find(bags[b][0])))
                root[y] = x
    kept, seen = [], set()
    for row in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        if row[0] is None or (find(row[0]) == row[0] and row[0] not in seen):
            kept.append(row)
            seen.add(row[0])
    same(pipeline.drop_near_duplicates(spark, docs, folder), kept)
    assert len(kept) < len(rows()) - 5


def test_decontamination(spark, docs, folder):
    def words(t):
        raw = decontaminate._folded(t)
        starts, ends, _ = decontaminate.tb.words(raw, np.array([0, len(raw)]), decontaminate.tb.PUNCTUATION)
        return decontaminate.canonical(raw, starts, ends)

    item = words(ITEM)
    held = lambda t: decontaminate.infix_distance(item, words(t)) <= int(decontaminate.MAX_EDITS * len(item))
    want = [r for r in rows() if not held(r[1])]
    same(pipeline.drop_contaminated(spark, docs, folder), want)
    assert len(want) == len(rows()) - 2
    blocks = decontaminate.decontaminate(docs, spark.read.parquet(f"{folder}/benchmark.parquet"), block=1)
    same(blocks, want)


def plain_topic(t):
    size, words = len(t), len(t.split())
    if not words:
        return "empty"
    if sum(c in "#*$%&|<>" for c in t) * 20 >= size:
        return "symbols"
    if t.upper() == t and t.lower() != t:
        return "shouted"
    if sum(c in "0123456789" for c in t) * 50 >= size:
        return "figures"
    return "lines" if (t.count("\n") + 1) * 60 >= size else "prose"


def test_mixing(spark, docs, folder):
    cells, cell_of = defaultdict(int), []
    for r in rows():
        t = r[1] or ""
        cell = (r[3] or "", r[2] or "", plain_topic(t))
        cells[cell] += len(t.split())
        cell_of.append(cell)
    names = [c for c in cells if cells[c]]
    weight = {c: float(cells[c]) for c in names}
    for _ in range(3000):
        for k, dimension in enumerate(mixing.DIMENSIONS):
            count, have = defaultdict(float), defaultdict(float)
            for c in names:
                count[c[k]] += cells[c]
                have[c[k]] += weight[c]
            total = sum(n ** mixing.TEMPER[dimension] for n in count.values())
            for c in names:
                weight[c] *= count[c[k]] ** mixing.TEMPER[dimension] / total / have[c[k]]
    budget, full = sum(cells.values()) * mixing.KEEP_SHARE, set()
    while True:
        c0 = (budget - sum(cells[c] for c in full)) / sum(weight[c] for c in names if c not in full)
        more = {c for c in names if weight[c] / cells[c] * c0 >= 1}
        if more <= full:
            break
        full |= more
    uniform = lambda i: int(hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / (1 << 52)
    want = [r for r, c in zip(rows(), cell_of, strict=True) if c in weight and uniform(r[0]) < min(1.0, weight[c] / cells[c] * c0)]
    out = pipeline.mix_sources(spark, docs, folder)
    assert out.columns == docs.columns
    same(out, want)


def test_token_output(spark, docs, folder):
    tool = tokens.encoder(tokens.tokenizer_path()).library
    want, start = [], 0
    for i, t in sorted(((r[0], r[1]) for r in rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = np.array([*tool.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    same(pipeline.write_token_ids(spark, docs, folder), want)


def test_the_stages_follow_one_another(spark, docs, folder):
    out = pipeline.run(spark, folder)
    found = [r["doc_id"] for r in out.collect()]
    clean = {r[0] for r in rows()}
    assert found and set(found) <= clean and len([i for i in found if i is not None]) == len({i for i in found if i is not None})
    frame, left = docs, None
    for name, stage in pipeline.STAGES:
        frame = stage(spark, frame, folder)
        assert name == "token_output" or frame.columns == docs.columns
        left = frame
    assert sorted(map(key, left.collect())) == sorted(map(key, out.collect()))
    base = max(Path(shared_dir(spark).removeprefix("file:")).glob("pipeline-*"), key=lambda p: p.stat().st_mtime)
    assert [p.name for p in base.iterdir()] == ["token_output"]


def test_empty_tables(spark, docs, folder, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
    for _, stage in pipeline.STAGES[:3]:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert pipeline.drop_contaminated(spark, docs, str(tmp_path)).count() == docs.count()
    assert pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()
