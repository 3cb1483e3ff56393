"""Surrogates of a small corpus: distinct, coreferent, of the same format, and nobody else's value."""

import random
import re
from collections import defaultdict

import pytest

from palimpsest.llm import private

KEY = b"a key of this test"


def iban(country, body):
    return next(x for x in (f"{country}{i:02d}{body}" for i in range(2, 99)) if private._iban_ok(x))


def corpus():
    r = random.Random(3)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    texts = []
    for i in range(120):
        texts.append(
            f"Mail u{i % 40}.x@firm{i % 7}.org or call +1 {digits(3)}-555-{digits(4)}, ssn {digits(3)}-{digits(2)}-{digits(4)}, host {r.randrange(256)}.{r.randrange(256)}.1.{i % 256}, "
            f"{r.choice(['Mr', 'Dr', 'Prof'])} Anna{'abcdefghij'[i % 10]} Kim{'abcdefghij'[i % 6]}, iban {iban('DE', digits(18))}, password = {digits(4)}abcd{digits(3)}."
        )
    return texts


def test_distinct_coreferent_and_of_the_same_format(spark, make):
    texts = corpus()
    rows = {r["doc_id"]: r for r in private.replace_private(make(texts), KEY).collect()}
    given, back, real = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, text in enumerate(texts):
        for e in rows[i]["entities"]:
            seen = text[e["start"] : e["start"] + e["length"]]
            name = re.sub(r"[ .-]", "", seen) if e["kind"] in ("phone", "ssn", "iban") else seen.lower()
            given[e["kind"], name].add(e["surrogate"])
            real[e["kind"]].add(seen)
            if e["kind"] != "ipv4":
                assert len(seen) == len(e["surrogate"]) or e["kind"] in ("person",), (seen, e)
            if e["kind"] == "iban":
                assert private._iban_ok(e["surrogate"]) and e["surrogate"][:2] == "DE"
    assert {k for k, _ in given} == {"email", "phone", "ssn", "ipv4", "person", "iban", "secret"}
    for (kind, name), found in given.items():
        assert len(found) == 1, (kind, name, found)
        back[kind, next(iter(found))].add(name)
    assert all(len(names) == 1 for names in back.values())
    assert not [s for (kind, s) in back if s in real[kind]]


def test_one_person_under_several_titles(make):
    texts = ["Mr John Smith met Dr John Smith. Later John Smith left, and Smith slept.", "Dr John Smith again.", "Mrs Ada Kim and Mr Ada Kim.", "A smithy. Smith alone."]
    rows = {r["doc_id"]: r for r in private.replace_private(make(texts), KEY).collect()}
    said = [e["surrogate"] for e in rows[0]["entities"]]
    assert len(said) == 4 and said[0] == said[1] == said[2] and said[3] == said[0].rpartition(" ")[2]
    assert [e["surrogate"] for e in rows[1]["entities"]] == [said[0]]
    assert "Smith" not in rows[0]["text"] and rows[3]["text"] == texts[3]
    two = [e["surrogate"] for e in rows[2]["entities"]]
    assert len(set(two)) == 2


@pytest.mark.parametrize("max_sent", [0, 1000])
def test_names_that_collide(spark, make, monkeypatch, max_sent):
    """The assignment itself, with a space of few names, on the driver: attempts go on until all differ."""
    monkeypatch.setattr(private, "PARTS", {"latin": (["b"], ["a"], {"m": ["n", "r"], "f": ["a"], "x": ["n"]})})
    names = [(i, "person", f"m/name{i}") for i in range(12)]
    given = {n: (0, private.surrogate(KEY, "person", n[2:], "m", 0).lower()) for _, _, n in names}
    for _ in range(200):
        by = defaultdict(list)
        for n, (_, s) in given.items():
            by[s].append(n)
        again = [n for group in by.values() for n in sorted(group)[1:]]
        if not again:
            break
        for n in again:
            given[n] = (given[n][0] + 1, private.surrogate(KEY, "person", n[2:], "m", given[n][0] + 1).lower())
    assert len({s for _, s in given.values()}) == 12


def test_a_surrogate_is_nobody_elses_value(spark):
    """A collision with a real value is made: the surrogate of one number is another entity."""
    first = "123-45-6789"
    normal = first.replace("-", "")
    other = private.surrogate(KEY, "ssn", normal)
    entities = spark.createDataFrame([(1, "ssn", f"/{normal}"), (2, "ssn", f"/{other}")], "doc_id long, kind string, name string")
    found = {r["name"]: (r["attempt"], r["surrogate"]) for r in private.assignments(entities, KEY).collect()}
    assert found[f"/{normal}"][0] >= 1
    assert not {s for _, s in found.values()} & {normal, other} and len({s for _, s in found.values()}) == 2


def test_entities_by_document_and_by_task_agree(make):
    texts = ["Mr John Smith.", "Dr John Smith, ssn 123-45-6789.", "Prof John Smith"]
    sent = [r["text"] for r in private.replace_private(make(texts), KEY).orderBy("doc_id").collect()]
    joined = [r["text"] for r in private.replace_private(make(texts), KEY, max_sent=0).orderBy("doc_id").collect()]
    assert sent == joined and len({re.search(r"(?:Mr|Dr|Prof) (\w+ \w+)", t)[1] for t in sent}) == 1


def test_many_entities_take_linear_time():
    text = " ".join(f"a{i}@b{i}.org" for i in range(20_000))
    assert len(private.find(text)) == 20_000


def test_found(make):
    text = "+15551234567 2001:0db8:85a3:0000:0000:8a2e:0370:7334 me@münchen.de api_key=abc12345xyz password: secretly"
    assert [k for _, _, k, _, _ in private.find(text)] == ["phone", "ipv6", "email", "secret"]
