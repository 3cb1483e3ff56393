"""Personal data: detected entities get keyed surrogates of the same type and format.

Kinds: email, phone, ipv4, ipv6, card, ssn, iban, secret (value of a token, key
or password, quoted, or with a digit and eight characters) and person (a title
and one to four names, capitalised or all in capitals, with initials and with
particles as in "de la Cruz").

Other mentions of a person in the same text are found by the whole name or by
its last words ("Smith", "de la Cruz"), with or without a title. Such a mention
is the person named so whose last mention before it is the nearest, of those
that its title's gender allows; where none is named before, the first one named
after. A titled last name that fits no whole name of the text is a person by
itself. A name without any title in its text, and a given name alone, stay.

An entity is its kind and its normal form (case and separators aside), so all
spellings of one entity, in all documents, get one surrogate (coreference).
Persons are told by name: a title that says nothing of gender takes the gender
that other titles of the name say in the corpus, the one said in more documents
where both are. Mr Kim and Ms Kim are two persons.

Surrogates of all kinds but person are values of a keyed permutation without
fixed points over the strings of the same format: which characters are digits,
lower or upper letters stays, as do separators, the country code of a phone
number, the country of an IBAN, the last label of a mail domain, the Luhn
property of a card number and the check digits of an IBAN that has them right.
Mail domains are mapped by themselves, so addresses of one domain stay
together. Persons get made-up names of their gender and of the script of the
name, from the HMAC of the normal form; particles stay, initials are initials,
and a mention in capitals gets capitals.

Distinctness: the distinct entities of the corpus are counted by surrogate;
where two share one, or a surrogate is the value of an entity of the corpus,
all but the least normal form take the next attempt, until none is shared.
Made-up names grow with the attempt, so there are always enough. Only these
exceptions, and names that take another title's gender, are looked up when
texts are rewritten; all other surrogates follow from the key alone. Up to
``MAX_SENT`` of them are sent to the tasks; more are joined to their documents.

The key is the caller's, or one drawn once and kept in the shared folder.

Null text stays null and has no entities; every input row gives one row, also
repeated rows and those without a doc_id. An empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import time
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.runtime import cut, prepare, shared_dir

MAX_SENT = 50_000
#: Rounds of attempts without fewer collisions after which the values of some format must be used up.
STUCK = 50

#: Titles and the gender they tell (m, f, or x for unknown).
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Sir": "m", "Господин": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Mme": "f", "Madame": "f", "Mlle": "f", "Señora": "f", "Señorita": "f", "Sra": "f", "Lady": "f", "Госпожа": "f", "Dr": "x", "Prof": "x"}
#: Parts of made-up names by script: onsets, vowels, and endings of given names by gender.
PARTS = {
    "latin": ("b d f g h j k l m n p r s t v br dr kr st tr".split(), "a e i o u".split(), {"m": "n r s k l d".split(), "f": "a ia ina elle ette ara".split(), "x": "n r e y l i".split()}),
    "cyrillic": ("б в г д ж з к л м н п р с т ф".split(), "а е и о у".split(), {"m": "н р с к л д".split(), "f": "а ия ина ела ета ара".split(), "x": "н р е й л и".split()}),
    "greek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ".split(), "α ε ι ο".split(), {"m": "ος ης ας ων ις ευς".split(), "f": "α η ια ινα ελα αρα".split(), "x": "ι ω ο ε υ ιω".split()}),
}

#: Titles that are also read in capitals, and particles of names.
CAPITAL_TITLES = ("Mr", "Mrs", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora")
PARTICLES = "af al av bin da das de del della den der di dos du e el ibn la las le los ten ter van von y zu zum zur".split()

TITLES |= {t.upper(): TITLES[t] for t in CAPITAL_TITLES}
_BIG, _SMALL = "A-ZÀ-ÖØ-ÞĀ-ſΑ-ΩЁА-Я", "a-zß-öø-ÿĀ-ſα-ωёа-я"
_NOT_TITLE = rf"(?!(?:{'|'.join(TITLES)})(?!\w))"
# a name does not take the ending of a genitive, nor the title of whoever comes next
_NAME = rf"{_NOT_TITLE}(?:[{_BIG}](?:(?!['’]s(?!\w))[\w'’-])*[{_SMALL}]|[{_BIG}]\.(?= ))"
_CAPITALS = rf"{_NOT_TITLE}[{_BIG}](?:(?!['’]S(?!\w))[{_BIG}'’-])*[{_BIG}](?!\w)"


def _names(name: str, particles: list[str]) -> str:
    lead = rf"(?:(?:{'|'.join(particles)}) ){{0,3}}"
    return rf"{lead}{name}(?: {lead}{name}){{0,3}}"


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![\w.-])(?:(?:[0-9]{4}[ -]?){3}[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![\w-])"),
    "ipv6": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    "ipv4": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\w|\.[0-9])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "phone": re.compile(r"(?<![\w+])(?:\+[0-9]{9,15}|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3})(?![\w-])"),
    "secret": re.compile(r"""(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*(?:["']([^"'\s]{6,})["']|((?=[^\s"']*[0-9])[^\s"',;]{8,}))"""),
    "person": re.compile(rf"(?<!\w)({'|'.join(TITLES)})\.? ({_names(_NAME, PARTICLES)}|{_names(_CAPITALS, [p.upper() for p in PARTICLES])})"),
}
DIGIT_KINDS = ("iban", "card", "ipv6", "ipv4", "ssn", "phone")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_ok(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _endings(name: str) -> list[str]:
    """A name and what is left of it without its first words, longest first."""
    words = name.split(" ")
    return [" ".join(words[i:]) for i in range(len(words))]


def _untitled(text: str, names: set[str]) -> Iterator[tuple[int, int]]:
    """Spans of the longest of ``names`` at each word, in order, without overlap; time follows the length of the text."""
    heads = {re.match(r"\W*\w+", n)[0] for n in names}
    longest = max(len(re.findall(r"\w+", n)) for n in names)
    words = [m.span() for m in re.finditer(r"\w+", text)]
    upto = 0
    for i, (a, b) in enumerate(words):
        if a >= upto and text[a:b] in heads:
            for _, end in reversed(words[i : i + longest]):
                if text[a:end] in names:
                    upto = end
                    yield a, end
                    break


def persons(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, normal form, gender) of mentions of persons, in order, without overlap."""
    titled = [(*m.span(2), m[2].lower(), TITLES[m[1]]) for m in PATTERNS["person"].finditer(text)]
    if not titled:
        return []
    # genders by which each name is titled, and the names that end in other words said with a title
    said: dict[str, set[str]] = {}
    for _, _, name, gender in titled:
        said.setdefault(name, set()).add(gender)
    whole: dict[str, list[str]] = {}
    for name in said:
        for ending in _endings(name)[1:]:
            whole.setdefault(ending, []).append(name)
    # a person without a known gender takes that of a titled last name, if only one person has it
    for name in list(said):
        if len(whole.get(name, ())) == 1 and said[whole[name][0]] == {"x"}:
            said[whole[name][0]] |= said[name]
    told = {name: sorted(genders - {"x"}) or ["x"] for name, genders in said.items()}

    spelled = {text[a:b] for a, b, _, _ in titled}
    forms = {e for name in spelled for e in _endings(name) if e.lower() not in PARTICLES}
    mentions = [(a, b, name, gender) for a, b, name, gender in titled]
    taken = [(a, b) for a, b, _, _ in titled]
    mixed = {" ".join(w.lower() if w.lower() in PARTICLES else w.title() for w in f.split(" ")) for f in forms if f.isupper()}
    for a, b in _untitled(text, forms | mixed | {f.upper() for f in forms}):
        i = bisect_left(taken, (a, b))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
            mentions.append((a, b, text[a:b].lower(), "x"))
    mentions.sort()

    # for each ending and gender: who was mentioned last, and who is named first in the text
    first: dict[tuple[str, str], tuple[int, str, str]] = {}
    for at, _, name, gender in titled:
        for g in told[name] if gender == "x" else [gender]:
            for ending in _endings(name):
                if ending != name or name not in whole:
                    first.setdefault((ending, g), (at, name, g))
    last: dict[tuple[str, str], tuple[int, str, str]] = {}
    out = []
    for a, b, name, gender in mentions:
        allowed = ("m", "f", "x") if gender == "x" else (gender, "x")
        before = [last[name, g] for g in allowed if (name, g) in last]
        after = [first[name, g] for g in allowed if (name, g) in first]
        if before:
            _, person, told_gender = max(before)
        elif after:
            _, person, told_gender = min(after)
        else:
            # a titled last name whose gender no whole name of the text has
            person, told_gender = name, gender
        for ending in _endings(person):
            last[ending, told_gender] = (a, person, told_gender)
        words = 0 if person == name else name.count(" ") + 1
        out.append((a, b, person + "\x1f" * words, told_gender))
    return out


def find(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, normal form, gender), in order, without overlap; earlier kinds of PATTERNS win.

    The normal form of a mention of a person by the last words of the name is
    that of the person and a ``\x1f`` for each word; its surrogate are as many
    last words of the person's.
    """
    found: list[tuple[int, int, str, str, str]] = []
    starts: list[int] = []

    def add(kind: str, a: int, b: int, normal: str, gender: str = "") -> None:
        # spans are kept in order and apart, so only the neighbours can overlap
        i = bisect_left(starts, a)
        if (i == 0 or found[i - 1][1] <= a) and (i == len(starts) or starts[i] >= b):
            starts.insert(i, a)
            found.insert(i, (a, b, kind, normal, gender))

    if "@" in text:
        for m in PATTERNS["email"].finditer(text):
            add("email", *m.span(), m[0].lower())
    for m in PATTERNS["secret"].finditer(text) if "=" in text or ":" in text else ():
        k = 1 if m[1] else 2
        add("secret", *m.span(k), m[k])
    if any(c in text for c in "0123456789"):
        for kind in DIGIT_KINDS:
            for m in PATTERNS[kind].finditer(text):
                normal = m[0].lower() if kind.startswith("ip") else re.sub(r"[^0-9A-Za-z+]", "", m[0])
                if kind == "phone" and sum(c.isdigit() for c in normal) < 9 or kind == "card" and len(normal) == 15 and not _luhn(normal):
                    continue
                add(kind, *m.span(), normal)
    if any(t in text for t in TITLES):
        for a, b, name, gender in persons(text):
            add("person", a, b, name, gender)
    return found


# ---------------------------------------------------------------- surrogates


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def _feistel(key: bytes, tweak: str, size: int, x: int, back: bool) -> int:
    """A keyed permutation of range(size), or its inverse: a balanced Feistel network, walked until in range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(7, -1, -1) if back else range(8):
            if back:
                left, right = right ^ (_prf(key, tweak, r, left) & mask), left
            else:
                left, right = right, left ^ (_prf(key, tweak, r, right) & mask)
        x = left << half | right
        if x < size:
            return x


def permute(key: bytes, tweak: str, size: int, x: int) -> int:
    """A keyed permutation of range(size) without a fixed point (size above 1): a shift seen through a permutation."""
    if size < 2:
        return x
    shift = 1 + _prf(key, tweak, "shift") % (size - 1)
    return _feistel(key, tweak, size, (_feistel(key, tweak, size, x, False) + shift) % size, True)


def _classes(text: str) -> list[int]:
    return [10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" else 36 if "A" <= c <= "Z" else 0 for c in text]


def same_format(key: bytes, tweak: str, text: str) -> str:
    """Permute among strings that have digits, lower and upper letters in the same places."""
    kinds = _classes(text)
    size, x = 1, 0
    for c, k in zip(text, kinds, strict=True):
        if k:
            radix = 10 if k == 10 else 26
            x = x * radix + (ord(c) - (48 if k == 10 else 97 if k == 26 else 65))
            size *= radix
    y = permute(key, f"{tweak}\x1f{''.join('.da'[(k > 0) + (k > 10)] if k != 36 else 'A' for k in kinds)}\x1f{size}", size, x)
    out = list(text)
    for i in range(len(text) - 1, -1, -1):
        k = kinds[i]
        if k:
            y, r = divmod(y, 10 if k == 10 else 26)
            out[i] = chr(r + (48 if k == 10 else 97 if k == 26 else 65))
    return "".join(out)


def _hexadecimal(key: bytes, value: str) -> str | None:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) and len(value) > 1:
        out = format(permute(key, f"hex{len(value)}", 16 ** len(value), int(value, 16)), f"0{len(value)}x")
        return out.upper() if value.upper() == value and value.lower() != value else out
    return None


def _card(key: bytes, digits: str) -> str:
    if _luhn(digits):
        body = format(permute(key, f"luhn{len(digits)}", 10 ** (len(digits) - 1), int(digits[:-1])), f"0{len(digits) - 1}d")
        return next(body + c for c in "0123456789" if _luhn(body + c))
    while True:
        digits = format(permute(key, f"card{len(digits)}", 10 ** len(digits), int(digits)), f"0{len(digits)}d")
        if not _luhn(digits):
            return digits


def _script(name: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", name) else "greek" if re.search("[Ͱ-Ͽ]", name) else "latin"


def _person(key: bytes, name: str, gender: str, attempt: int) -> str:
    onsets, vowels, endings = PARTS[_script(name)]
    out = []
    for i, word in enumerate(name.split(" ")):
        if word in PARTICLES:
            out.append(word)
            continue
        n = _prf(key, "person", gender, attempt, i, name)

        def pick(options: list[str]) -> str:
            nonlocal n
            n, k = divmod(n, len(options))
            return options[k]

        stem = "".join(pick(onsets) + pick(vowels) for _ in range(2 + n % 2 + attempt // 2)) + pick(onsets)
        if word.endswith("."):
            out.append(stem[0].upper() + ".")
            continue
        last = i == len(name.split(" ")) - 1 and i > 0
        out.append((stem + (pick(vowels) if last else pick(endings[gender or "x"]))).capitalize())
    return " ".join(out)


def surrogate(key: bytes, kind: str, normal: str, gender: str = "", attempt: int = 0) -> str:
    """The normal form of an entity's surrogate."""
    tweak = f"{kind}/{attempt}"
    if kind == "email":
        local, domain = normal.split("@")
        labels = domain.split(".")
        host = ".".join(labels[:-1])
        return f"{same_format(key, tweak, local)}@{same_format(key, 'domain', host)}.{labels[-1]}"
    if kind == "ipv4":
        x = 0
        for part in normal.split("."):
            x = x << 8 | int(part)
        x = permute(key, tweak, 1 << 32, x)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        return _card(key + str(attempt).encode(), normal)
    if kind == "phone":
        plus = re.match(r"\+1|\+[0-9]{2}", normal)
        lead = plus[0] if plus else ""
        return lead + same_format(key, f"{tweak}{lead}", normal[len(lead) :])
    if kind == "iban":
        body = same_format(key, tweak + normal[:2], normal[4:])
        if _iban_ok(normal):
            return next(x for x in (f"{normal[:2]}{98 - i:02d}{body}" for i in range(97)) if _iban_ok(x))
        return normal[:2] + same_format(key, f"{tweak}check", normal[2:4]) + body
    if kind == "ipv6":
        return ":".join(_hexadecimal(key + f"{attempt}/{i}".encode(), part.rjust(4, "0")) for i, part in enumerate(normal.split(":")))
    if kind == "secret":
        return _hexadecimal(key + str(attempt).encode(), normal) or same_format(key, tweak, normal)
    if kind == "person":
        whole = _person(key, normal.rstrip("\x1f"), gender, attempt)
        return " ".join(whole.split(" ")[-normal.count("\x1f") :])
    return same_format(key, tweak, normal)


def dressed(kind: str, seen: str, new: str) -> str:
    """A surrogate's normal form in the spelling of the text: separators and case of what stood there."""
    if kind in ("email", "person") and seen == seen.upper():
        return new.upper()
    if kind in ("card", "phone", "iban", "ssn"):
        given = iter(new)
        return "".join(next(given) if c.isalnum() or c == "+" else c for c in seen)
    return new


@lru_cache(maxsize=200_000)
def _cached(key: bytes, kind: str, normal: str, gender: str, attempt: int) -> str:
    return surrogate(key, kind, normal, gender, attempt)


def entity_of(kind: str, normal: str, gender: str) -> str:
    """The name that an entity is known by: gender/normal form, for a person's last part that of the person."""
    return f"{gender}/{normal.rstrip(chr(31))}" if kind == "person" else f"/{normal}"


def rewrite(text: str | None, key: bytes, told: dict[tuple[str, str], tuple[str, int]]) -> tuple[str | None, list[dict]]:
    """The text with surrogates; ``told`` gives exceptions: the gender to go by and the attempt."""
    if not text:
        return text, []
    out, at, said = [], 0, []
    for a, b, kind, normal, gender in find(text):
        as_gender, attempt = told.get((kind, entity_of(kind, normal, gender)), (gender, 0))
        new = dressed(kind, text[a:b], _cached(key, kind, normal, as_gender if kind == "person" else "", attempt))
        out += [text[at:a], new]
        said.append({"kind": kind, "start": a, "length": b - a, "surrogate": new})
        at = b
    return "".join(out) + text[at:], said


# ---------------------------------------------------------------- on DataFrames


def stored_key(spark: SparkSession) -> bytes:
    """The key in the shared folder; drawn and written there if there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = f"{shared_dir(spark).rstrip('/')}/surrogate-key"
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(conf)
    if not store.exists(at):
        try:
            out = store.create(at, False)
            out.writeBytes(secrets.token_hex(32))
            out.close()
        except Py4JJavaError:
            # another driver has drawn it in between: its key holds
            if not store.exists(at):
                raise
    for _ in range(60):
        row = spark.read.text(path).first()
        if row and len(row["value"]) == 64:
            return bytes.fromhex(row["value"])
        time.sleep(1)
    raise RuntimeError(f"no whole key in {path}")


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, names, docs = [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for kind, name in sorted({(k, entity_of(k, n, g)) for _, _, k, n, g in find(text or "")}):
                kinds.append(kind)
                names.append(name)
                docs.append(doc)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(kinds, pa.string()), pa.array(names, pa.string())], ["doc_id", "kind", "name"])


def _assign(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for kind, name, attempt in zip(batch.column("kind").to_pylist(), batch.column("name").to_pylist(), batch.column("attempt").to_pylist(), strict=True):
                gender, _, normal = name.partition("/")
                new.append(surrogate(key, kind, normal, gender, attempt).lower() if kind == "person" else surrogate(key, kind, normal, gender, attempt))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("name"), batch.column("attempt"), pa.array(new, pa.string())], ["kind", "name", "attempt", "surrogate"])

    return run


def genders(entities: DataFrame) -> DataFrame:
    """(kind, name, entity): persons whose title says nothing of gender, as the person of that name of whom titles do; the gender said in more documents, m before f where both are as often."""
    person = entities.filter("kind = 'person'").groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("normal", F.expr("substring(name, 3)"))
    unknown = person.filter("name like 'x/%'").select("normal", "name")
    told = person.filter("name not like 'x/%'").groupBy("normal").agg(F.min(F.struct((-F.col("n")).alias("least"), (F.left("name", F.lit(1)) != "m").alias("later"), F.col("name").alias("entity"))).alias("best"))
    return unknown.join(told, "normal").select(F.lit("person").alias("kind"), "name", F.col("best.entity").alias("entity"))


def assignments(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, name, attempt, surrogate): distinct surrogates for distinct entities; ``name`` is gender/normal form. No surrogate is the value of an entity."""
    schema = "kind string, name string, attempt int, surrogate string"
    found = entities.select("kind", "name").distinct().repartition("kind", "name")
    given = cut(found.withColumn("attempt", F.lit(0)).mapInArrow(_assign(key), schema))
    own = given.select("kind", F.expr("substring(name, instr(name, '/') + 1)").alias("surrogate")).distinct()
    least_seen, stuck = None, 0
    while True:
        least = given.groupBy("kind", "surrogate").agg(F.min("name").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        taken = given.join(least, ["kind", "surrogate"]).filter("name <> first").select("kind", "name")
        taken = cut(taken.union(given.join(own, ["kind", "surrogate"], "left_semi").select("kind", "name")).distinct())
        n = taken.count()
        if not n:
            return given
        least_seen, stuck = (n, 0) if least_seen is None or n < least_seen else (least_seen, stuck + 1)
        if stuck > STUCK:
            raise RuntimeError(f"{n} entities are of formats whose values are used up")
        again = given.join(taken, ["kind", "name"]).select("kind", "name", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_assign(key), schema)
        given = cut(given.join(taken, ["kind", "name"], "left_anti").unionByName(again))


def _apply(key: bytes, sent: dict[tuple[str, str], tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("surrogate", pa.string())])
        for batch in batches:
            texts, items = [], []
            own = batch.column("own").to_pylist() if "own" in batch.schema.names else [None] * len(batch)
            for text, mine in zip(batch.column("text").to_pylist(), own, strict=True):
                new, said = rewrite(text, key, {(x["kind"], x["name"]): (x["gender"], x["attempt"]) for x in mine} if mine else sent)
                texts.append(new)
                items.append(said)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(items, pa.list_(item))], ["doc_id", "text", "entities"])

    return run


def replace_private(docs: DataFrame, key: bytes | None = None, id_col: str = "doc_id", text_col: str = "text", max_sent: int = MAX_SENT) -> DataFrame:
    """(doc_id, text, entities): each text with surrogates, and kind, start (in the input), length and surrogate of each."""
    spark = prepare(docs.sparkSession)
    key = key or stored_key(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = cut(texts.mapInArrow(_detect, "doc_id long, kind string, name string"))
    told = cut(genders(seen))
    entities = seen.join(told, ["kind", "name"], "left").select("kind", F.coalesce("entity", "name").alias("name"))
    given = assignments(entities, key).select("kind", F.col("name").alias("entity"), "attempt")
    other = told.join(given, ["kind", "entity"])
    plain = given.filter("attempt > 0").select("kind", F.col("entity").alias("name"), "entity", "attempt")
    moved = cut(other.select("kind", "name", "entity", "attempt").union(plain).select("kind", "name", F.substring_index("entity", "/", 1).alias("gender"), "attempt"))
    schema = "doc_id long, text string, entities array<struct<kind:string,start:int,length:int,surrogate:string>>"
    few = moved.limit(max_sent + 1).collect()
    if len(few) <= max_sent:
        return texts.mapInArrow(_apply(key, {(r["kind"], r["name"]): (r["gender"], r["attempt"]) for r in few}), schema)
    own = seen.join(moved, ["kind", "name"]).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "name", "gender", "attempt")).alias("own"))
    return texts.join(own, "doc_id", "left").mapInArrow(_apply(key, {}), schema)


def op9_private_surrogates(spark, sf_dir: str) -> DataFrame:
    out = replace_private(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.col("entities.kind").alias("kinds"), F.col("entities.surrogate").alias("surrogates"))
