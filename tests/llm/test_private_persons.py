"""Persons of a text: who is meant by each mention, and whole texts against texts that are put together from known parts."""

import random
import re

import pytest

from palimpsest.llm import private

KEY = b"another key"


def meant(text):
    return [(text[a:b], n.rstrip("\x1f"), n.count("\x1f"), g) for a, b, k, n, g in private.find(text) if k == "person"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Mr John Smith came. Mr Smith left. Smith said so.", [("John Smith", "john smith", 0, "m"), ("Smith", "john smith", 1, "m"), ("Smith", "john smith", 1, "m")]),
        ("Mr John Smith, Ms Jane Smith. Smith spoke. Mr Smith went; Smith too.", [("John Smith", "john smith", 0, "m"), ("Jane Smith", "jane smith", 0, "f"), ("Smith", "jane smith", 1, "f"), ("Smith", "john smith", 1, "m"), ("Smith", "john smith", 1, "m")]),
        ("Mrs Anna-Maria de la Cruz, de la Cruz; Mrs Cruz's car", [("Anna-Maria de la Cruz", "anna-maria de la cruz", 0, "f"), ("de la Cruz", "anna-maria de la cruz", 3, "f"), ("Cruz", "anna-maria de la cruz", 1, "f")]),
        ("Señor José García y García Márquez. García Márquez y Señora López", [("José García y García Márquez", "josé garcía y garcía márquez", 0, "m"), ("García Márquez", "josé garcía y garcía márquez", 2, "m"), ("López", "lópez", 0, "f")]),
        ("Mr JOHN SMITH and John Smith, MR SMITH", [("JOHN SMITH", "john smith", 0, "m"), ("John Smith", "john smith", 0, "m"), ("SMITH", "john smith", 1, "m")]),
        ("Mr J. R. Smith's dog.", [("J. R. Smith", "j. r. smith", 0, "m")]),
        ("Mr Smith came before Mr John Smith.", [("Smith", "john smith", 1, "m"), ("John Smith", "john smith", 0, "m")]),
        ("Dr John Smith met Mr Smith.", [("John Smith", "john smith", 0, "m"), ("Smith", "john smith", 1, "m")]),
        ("Mrs Smith, Mr John Smith, Smith", [("Smith", "smith", 0, "f"), ("John Smith", "john smith", 0, "m"), ("Smith", "john smith", 1, "m")]),
        ("Mr Kim and Ms Kim: Kim.", [("Kim", "kim", 0, "m"), ("Kim", "kim", 0, "f"), ("Kim", "kim", 0, "f")]),
        ("Herr Müller Frau Weiß", [("Müller", "müller", 0, "m"), ("Weiß", "weiß", 0, "f")]),
        ("Mr Lee. A smithy, Leeds, Lee-Ann", [("Lee", "lee", 0, "m"), ("Lee", "lee", 0, "m")]),
        ("John Smith has no title here.", []),
    ],
)
def test_who_is_meant(text, expected):
    assert meant(text) == expected


def test_endings_and_capitals_follow_the_person():
    text = "Mrs Ana de la Cruz. MRS DE LA CRUZ, de la Cruz, Cruz, J."
    new, said = private.rewrite(text, KEY, {})
    given = [e["surrogate"] for e in said]
    last = given[0].rpartition(" ")[2]
    assert given[0].split(" ")[1:3] == ["de", "la"]
    assert given[1:] == [f"DE LA {last.upper()}", f"de la {last}", last]
    assert not re.search("(?i)cruz", new) and new.endswith(", J.")


def test_many_persons_of_one_name_take_linear_time():
    text = " ".join(f"Mr {chr(65 + i % 26)}{'abcdefghij'[i // 26 % 10]}{'klmnopqrst'[i // 260 % 10]} Smith met Smith." for i in range(20_000))
    assert len(private.find(text)) == 40_000


def test_card_of_fifteen_digits():
    assert [k for _, _, k, _, _ in private.find("378282246310005, 3782 822463 10005, 378282246310006")] == ["card", "card"]


def composed(r):
    """(parts, entities): literal text and entities in turn; an entity is told by kind, name and number of last words."""
    parts, said = [], []
    surnames = ["Nov" + c + "k" for c in "aeiou"]
    first = "Mr {0} {1}", "Ms {0} {1}"
    for _ in range(r.randrange(1, 6)):
        which = r.randrange(5)
        if which == 0:
            g = r.randrange(2)
            given, family = r.choice(["Tomn", "Karln"] if g == 0 else ["Evan", "Idan"]), r.choice(surnames)
            title = first[g].split(" ")[0]
            parts += [f"So {title} ", f"{given} {family}", ", later "]
            said += [None, ("person", g, f"{given} {family}", 0), None]
            # a last name right behind its person is that person
            parts += [family, f", then {title} ", family, " left. "]
            said += [("person", g, f"{given} {family}", 1), None, ("person", g, f"{given} {family}", 1), None]
        elif which == 1:
            mail = f"{r.choice('abc')}x{r.randrange(5)}@site{r.choice('kl')}.org"
            parts += ["Write to ", r.choice([mail, mail.upper()]), " soon. "]
            said += [None, ("email", 0, mail, 0), None]
        elif which == 2:
            n = f"{r.randrange(100, 103)}-{r.randrange(10, 13)}-{r.randrange(1000, 1003)}"
            parts += ["Number ", n, " it is. "]
            said += [None, ("ssn", 0, n, 0), None]
        elif which == 3:
            n = f"10.{r.randrange(3)}.{r.randrange(3)}.{r.randrange(200, 204)}"
            parts += ["Host ", n, " is down. "]
            said += [None, ("ipv4", 0, n, 0), None]
        else:
            parts.append("Nothing of note, 12 apples & <b>bold</b> - the smithy.\n")
            said.append(None)
    return parts, said


def test_whole_texts_of_a_corpus(make):
    """Literal text stays byte by byte; each entity gets one surrogate in all texts, and no two get the same."""
    r = random.Random(17)
    made = [composed(r) for _ in range(300)]
    rows = {x["doc_id"]: x for x in private.replace_private(make(["".join(p) for p, _ in made]), KEY).collect()}
    given = {}
    for i, (parts, said) in enumerate(made):
        at, text, items = 0, rows[i]["text"], iter(rows[i]["entities"])
        for part, entity in zip(parts, said, strict=True):
            if entity is None:
                assert text.startswith(part, at), (i, part, text[at : at + 60])
                at += len(part)
                continue
            item = next(items)
            assert item["kind"] == entity[0] and text.startswith(item["surrogate"], at)
            at += len(item["surrogate"])
            assert item["surrogate"].lower() != part.lower()
            kind, g, name, words = entity
            given.setdefault((kind, g, name), {}).setdefault(words, set()).add(item["surrogate"].lower())
        assert at == len(text) and next(items, None) is None
    assert all(len(s) == 1 for forms in given.values() for s in forms.values())
    whole = [(k[0], next(iter(f[0]))) for k, f in given.items()]
    assert len(set(whole)) == len(whole)
    for (kind, _, _), forms in given.items():
        if kind == "person":
            assert next(iter(forms[1])) == next(iter(forms[0])).rpartition(" ")[2]
