"""Cases that a shortened search would lose, against plain versions."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, linededup, neardup, toxicity
from palimpsest.llm.runtime import shared_dir
from tests.llm.conftest import prose


def inserted(text, n, seed, spread):
    r, words = random.Random(seed), text.split()
    at = len(words) // 2
    for x in prose(seed, n).split():
        words.insert(r.randrange(1, len(words)) if spread else at, x)
    return " ".join(words)


def deleted(text, n, seed, spread):
    r, words = random.Random(seed), text.split()
    at = (len(words) - n) // 2
    for _ in range(n):
        words.pop(r.randrange(len(words)) if spread else at)
    return " ".join(words)


@pytest.mark.parametrize("spread", [False, True])
@pytest.mark.parametrize(("edit", "size", "n"), [(inserted, 50, 8), (inserted, 100, 15), (inserted, 40, 7), (deleted, 50, 8), (deleted, 100, 15)])
def test_inserted_and_deleted_words(spark, make, edit, size, n, spread):
    items = [(i, prose(5000 + 100 * size + i, size)) for i in range(20)]
    texts = [f"{prose(900 + i, 60)} {edit(t, n, 7000 + i, spread)} {prose(950 + i, 60)}" for i, t in items]
    due = {i for i, t in items if decontaminate.infix_distance(t.encode(), texts[i].encode()) <= int(decontaminate.MAX_EDITS * len(t))}
    found = {r["doc_id"]: r["item_ids"] for r in decontaminate.flagged(make(texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(due) >= 10
    assert all(found[i] == ([i] if i in due else []) for i in found)


def within_one_word(a, b):
    short, long_ = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return len(long_) == len(short) + 1 and any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def plain_lines(texts):
    """doc_id -> (text left, numbers of exact and of near repeats)."""
    seen, out = [], {}
    for doc, text in enumerate(texts):
        exact, near = [], []
        for number, line in enumerate((text or "").split("\n")):
            words = line.lower().split()
            if words:
                if words in seen:
                    exact.append(number)
                elif len(words) >= linededup.MIN_WORDS and any(len(w) >= linededup.MIN_WORDS and within_one_word(words, w) for w in seen):
                    near.append(number)
                seen.append(words)
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in exact + near)
        out[doc] = (kept, exact, near)
    return out


def test_line_dedup_writes_the_texts_that_are_left(spark, make, tmp_path):
    r, base = random.Random(6), [prose(i, 10) for i in range(12)]
    lines = [*base, *(inserted(x, 1, i, True) for i, x in enumerate(base)), *(x.upper() for x in base), "", "  ", "a b c", "a b d", *(prose(200 + i, 9) for i in range(30))]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(1, 12))) for _ in range(25)] + [None, "", base[0], base[0] + "\n"]
    make(texts).write.parquet(f"{tmp_path}/documents.parquet")
    counts = {row["doc_id"]: tuple(row)[1:] for row in linededup.op3_line_dedup(spark, str(tmp_path)).collect()}
    table = max(Path(shared_dir(spark).removeprefix("file:")).glob("deduplicated-*"), key=lambda p: p.stat().st_mtime)
    found = {row["doc_id"]: (row["text"], row["exact"], row["near"]) for row in spark.read.parquet(str(table)).collect()}
    assert found == plain_lines(texts)
    assert {k: v[1:] for k, v in counts.items()} == {k: (len(e), len(n)) for k, (_, e, n) in found.items()}
    assert any(n for _, _, n in found.values()) and any(e for _, e, _ in found.values())


def test_labelled_texts_with_one_head_are_all_learnt_from(monkeypatch):
    head = prose(1, 120)
    sample = [(i, f"{head} {prose(10 + i, 40)}", int(i % 3 == 0)) for i in range(60)] + [(100, f"{head} {prose(10, 40)}", 1), (101, f"{head} {prose(10, 40)}", 0)]
    assert len(head) > 400
    learnt = []
    monkeypatch.setattr(toxicity.Scorer, "features", lambda self, text: learnt.append(text) or [0.0] * 5)
    monkeypatch.setattr(toxicity, "_marked", lambda toxic, ordinary: learnt.extend([*toxic, *ordinary]) or [])
    monkeypatch.setattr(toxicity, "_passages", lambda body, marked: [])
    toxicity.train(sample)
    # the text of 0 is repeated with its own label, which counts once, and with the other
    assert len(learnt) == 61


def test_links_are_named_as_those_that_join(make):
    text = prose(1, 150)
    texts = [f"{text} new{i}" for i in range(12)]
    found = neardup.near_duplicates(make(texts))
    assert found.columns == ["doc_id", "class_id", "n_join_links"]
    rows = found.collect()
    assert {r["class_id"] for r in rows} == {0} and min(r["n_join_links"] for r in rows) >= 1


def test_lines_of_ids_at_both_ends_are_those_of_small_ids(spark):
    """Places of lines are longs where ids leave room, decimals elsewhere; ids only give the order."""
    base = [prose(i, 10) for i in range(6)]
    texts = [f"{base[i % 6]}\n\n x  {base[(i + 1) % 6]} {'y' * (i % 3)}\t\n{i}" for i in range(24)]
    ids = {"long": list(range(-12, 12)), "none": [-(2**63), *range(-11, 11), 2**63 - 1]}
    got = {}
    for kind, numbers in ids.items():
        docs = spark.createDataFrame([(n, t) for n, t in zip(numbers, texts, strict=True)], "doc_id long, text string")
        bits = linededup.bits_of(linededup.lines_of(docs))
        assert (bits is None) == (kind == "none")
        got[kind] = [tuple(r)[1:] for r in linededup.deduplicated(docs).sort("doc_id").collect()]
    assert got["long"] == got["none"] and [x[:3] for x in got["long"]] == list(plain_lines(texts).values())
    at = linededup.place(F.col("d"), F.col("n"), 3)
    rows = spark.createDataFrame([(-(2**60), 0), (-1, 7), (0, 0), (0, 7), (5, 1)], "d long, n int").select("d", "n", at.alias("at"), *(c.alias(x) for c, x in zip(linededup.unplace(at, 3), "en", strict=True)))
    assert [r[0] for r in rows.sort("at").collect()] == [-(2**60), -1, 0, 0, 5] and all(r[0] == r[3] and r[1] == r[4] for r in rows.collect())


def test_a_text_is_cut_into_lines_once(spark, make):
    """The text left is put together without cutting the whole text again for each of its lines."""
    plan = linededup.deduplicated(make(["a b\na b\nc", "c"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(parts" in plan and "lambdafunction(split(" not in plan
