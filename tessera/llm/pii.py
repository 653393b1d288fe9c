"""PII: detection and keyed surrogates.

Detected: secrets (assigned tokens, keys, passwords), e-mail addresses, IBANs,
payment cards, phone numbers, US social security numbers, IPv4 addresses,
titled personal names, and a known given name with a capitalised word after it.
Each is replaced by a surrogate of its own type:

- strings keep their format. A keyed Feistel network maps every letter or digit
  within its own alphabet (digits, Latin, Greek, Cyrillic, hexadecimal), the
  string of the next number is taken there, and mapped back: a permutation of
  the strings of one format in a single cycle. So two entities never get one
  surrogate, one entity gets the same everywhere, in whatever task, and none
  gets itself. Values that must stay in a set (valid octets) walk along the
  cycle until they are in it.
- cards keep their issuer's prefix; card and IBAN check digits are made anew, so
  surrogates stay valid.
- phone numbers keep country code and punctuation; the digits alone decide, so
  one number in two notations stays one number.
- names keep gender and script: known given names are permuted within the table
  of their gender and script; other names are numbered, permuted, and spelled in
  syllables (given names with an ending of their gender), so that different
  names have different surrogates and one name the same in all documents. Later
  mentions of a name's parts follow it, but for words that open a sentence or
  that the text has in lower case too.

Only entities are touched; a text without any comes out as it came in.

Surrogates can be turned back by whoever has the key, so there is none in the
source: the key is a parameter. The registered query and the pipeline take it
from the session's spark.tessera.pii.key, and where that is unset draw one for
the application, so that their surrogates are the same in all its tasks only.

Defined results: null texts stay null with no entities; empty and very long
texts are whole, in time linear in the text but for sorting; the surrogates
depend on key and entity alone, so repeated rows and retries agree; extra columns
are ignored by surrogates(), kept by cleaned().
"""

from __future__ import annotations

import bisect
import hmac
import re
import secrets
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import ship

KEY_CONF = "spark.tessera.pii.key"
SCHEMA = "doc_id long, text string, n_entities long, kinds array<string>"

# Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Ada Alice Bella Carla Clara Diana Elena Emma Flora Greta Hanna Irene Julia Laura Lena Lucia Maria Marta Nina Nora Olivia Paula Rosa Sara Sofia Teresa Vera Viola".split(),
    ("latin", "m"): "Adam Albert Bruno Carl David Emil Erik Felix Frank Georg Hugo Ivan Jan Karl Leo Luis Marco Martin Nils Oscar Pablo Paul Peter Robert Simon Thomas Victor Walter".split(),
    ("latin", "n"): "Alex Andrea Casey Chris Dominique Jamie Jordan Kim Luca Noel Robin Sam Sascha Taylor".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Татьяна Юлия".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Егор Иван Максим Николай Олег Павел Сергей".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава Шура".split(),
    ("greek", "f"): "Αννα Ελενη Ιωαννα Κατερινα Μαρια Σοφια".split(),
    ("greek", "m"): "Αντωνης Γιωργος Δημητρης Κωστας Νικος Πετρος".split(),
    ("greek", "n"): "Αλεξης Φωτης Χαρις".split(),
}
# Titles and the gender they tell.
TITLES = {
    "Mr": "m", "Mister": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mademoiselle": "f",
    "Señor": "m", "Señora": "f", "Señorita": "f", "Signor": "m", "Signora": "f", "господин": "m", "госпожа": "f", "Господин": "m", "Госпожа": "f", "κύριος": "m", "κυρία": "f", "Κύριος": "m", "Κυρία": "f",
}
SYLLABLES = {
    "latin": ("bdfgklmnprstvz", "aeiou"),
    "cyrillic": ("бвгдзклмнпрстф", "аеиоу"),
    "greek": ("βγδζθκλμνπρστφ", "αειου"),
}
# Endings of given names that are spelled in syllables, and of names with letters beyond their script's base alphabet.
ENDINGS = {
    "latin": {"f": "na", "m": "ro", "n": "ri"},
    "cyrillic": {"f": "на", "m": "рий", "n": "ки"},
    "greek": {"f": "να", "m": "ρος", "n": "ρι"},
}
BEYOND = {"latin": "th", "cyrillic": "х", "greek": "ξ"}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "greek": "αβγδεζηθικλμνξοπρσςτυφχψω"}
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
CLASS = {c: a for a in ALPHABETS for c in a}
HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}

WORD = r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω][\w'’-]*[a-zß-öø-ÿа-яα-ωάέήίόύώ]"
PATTERNS = [
    ("secret", re.compile(r"(?i)(?<!\w)(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|token|passw(?:or)?d|bearer)[\"']?\s{0,3}(?:[:=]|\s)\s{0,3}[\"']?([A-Za-z0-9+/_\-]{16,})")),
    ("secret", re.compile(r"(?<!\w)((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,})(?!\w)")),
    ("email", re.compile(r"(?<![\w.+-])([\w.+-]*\w@(?:[\w-]+\.)+[A-Za-z]{2,})(?![\w@])")),
    ("iban", re.compile(r"(?<!\w)([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)")),
    ("card", re.compile(r"(?<![\w.+-])(\d(?:[ -]?\d){12,18})(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+])(\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4})(?!\w)")),
    ("phone", re.compile(r"(?<![\w.+-])(\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w.+-])(\d{3}-\d{2}-\d{4})(?![\w-])")),
    ("ip", re.compile(r"(?<![\w.])(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![\w]|\.\d)")),
]
MARK = re.compile(r"[0-9@]|(?i:secret|token|passw|bearer|api.?key|access.?key)")
HINTS = re.compile("|".join(sorted({*TITLES, *(n for names in GIVEN.values() for n in names)}, key=lambda n: (-len(n), n))))
NAMED = re.compile(r"(?<!\w)(" + "|".join(sorted(TITLES, key=len, reverse=True)) + rf")\.?[  ]({WORD})(?:[  ]({WORD}))?")


def luhn(digits: str) -> int:
    """The check sum of a whole number, 0 where it is valid."""
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


# issuers' prefixes (first to last) and the lengths of their numbers.
ISSUERS = [("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("36", "36", (14,)), ("38", "39", (14,)), ("6011", "6011", (16, 19)), ("644", "649", (16, 19)), ("65", "65", (16, 19))]


def issuer(digits: str) -> int:
    """The length of the issuer's prefix; 0 where there is none of this length."""
    return next((len(a) for a, b, sizes in ISSUERS if a <= digits[: len(a)] <= b and len(digits) in sizes), 0)


def is_card(digits: str) -> bool:
    return issuer(digits) > 0 and luhn(digits) == 0


def iban_number(text: str) -> int:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def valid(kind: str, found: str) -> bool:
    digits = re.sub(r"\D", "", found)
    if kind == "card":
        return is_card(digits)
    if kind == "iban":
        return 15 <= len(found.replace(" ", "")) <= 34 and iban_number(found.replace(" ", "")) == 1
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "ip":
        return all(len(x) == len(str(int(x))) and int(x) < 256 for x in found.split("."))
    if kind == "ssn":
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if kind == "secret":
        return any(c.isdigit() for c in found)
    return True


class Keyed:
    """Permutations of strings of one format, by a secret."""

    def __init__(self, key: str):
        self.key = key.encode()

    def draw(self, *parts: str) -> bytes:
        return hmac.digest(self.key, "\x1f".join(parts).encode(), "sha256")

    def _stream(self, n: int, *parts: str) -> list[int]:
        out: list[int] = []
        block = 0
        while len(out) < n:
            raw = self.draw(*parts, str(block))
            out += [int.from_bytes(raw[i : i + 4], "big") for i in range(0, 32, 4)]
            block += 1
        return out[:n]

    def _mixed(self, domain: str, values: list[int], radix: list[int], sign: int) -> list[int]:
        """A Feistel network over digits of mixed radix, there (1) and back (-1)."""
        shape = ",".join(map(str, radix))
        half = len(values) // 2
        left, right = values[:half], values[half:]
        for turn in range(8)[::sign]:
            given, moved, at = (right, left, 0) if turn % 2 == 0 else (left, right, half)
            add = self._stream(len(moved), domain, shape, str(turn), ",".join(map(str, given)))
            moved = [(v + sign * a) % r for v, a, r in zip(moved, add, radix[at : at + len(moved)], strict=True)]
            left, right = (moved, right) if turn % 2 == 0 else (left, moved)
        return left + right

    def permute(self, domain: str, values: list[int], radix: list[int]) -> list[int]:
        """One step in a single cycle through all strings of these radixes: the next number, in the order that the network makes."""
        now = self._mixed(domain, values, radix, 1)
        for i in range(len(now) - 1, -1, -1):
            now[i] = (now[i] + 1) % radix[i]
            if now[i]:
                break
        return self._mixed(domain, now, radix, -1)

    def walk(self, domain: str, values: list[int], radix: list[int], allowed) -> list[int]:
        """Steps to the next value that is allowed; another one, unless no other is."""
        now = self.permute(domain, values, radix)
        while not allowed(now) and now != values:
            now = self.permute(domain, now, radix)
        return now

    def text(self, domain: str, text: str, classes: dict[str, str] | None = None) -> str:
        """Letters and digits change within their alphabets; all else stays."""
        classes = CLASS if classes is None else classes
        at = [i for i, c in enumerate(text) if c in classes]
        if not at:
            return text
        sets = [classes[text[i]] for i in at]
        moved = self.permute(domain, [s.index(text[i]) for s, i in zip(sets, at, strict=True)], [len(s) for s in sets])
        out = list(text)
        for i, s, v in zip(at, sets, moved, strict=True):
            out[i] = s[v]
        return "".join(out)


def _refill(pattern: str, digits: str, skip: int = 0) -> str:
    """The digits in the places of pattern's digits after the first skip ones."""
    it, n, out = iter(digits), 0, []
    for c in pattern:
        if c.isdigit():
            n += 1
            out.append(next(it) if n > skip else c)
        else:
            out.append(c)
    return "".join(out)


def surrogate(keyed: Keyed, kind: str, found: str) -> str:
    """The replacement of one entity (names: see Document)."""
    digits = re.sub(r"\D", "", found)
    if kind == "card":
        head = digits[: issuer(digits)]
        body = keyed.text("card" + head, digits[len(head) : -1])
        for check in "0123456789":
            if luhn(head + body + check) == 0:
                return _refill(found, head + body + check)
    if kind == "phone":
        country = re.match(r"\+(\d{1,3})[ .(-]", found)
        skip = len(country[1]) if country else min(2, len(digits) - 7) if found[0] == "+" else 0
        return _refill(found, keyed.text(f"phone{digits[:skip]}", digits[skip:]), skip)
    if kind == "ssn":
        fits = lambda v: valid("ssn", f"{v[0]}{v[1]}{v[2]}-{v[3]}{v[4]}-{v[5]}{v[6]}{v[7]}{v[8]}")
        return _refill(found, "".join(map(str, keyed.walk("ssn", [int(c) for c in digits], [10] * 9, fits))))
    if kind == "ip":
        host = lambda v: 1 <= v[0] <= 223 and v[0] not in (10, 127)
        return ".".join(map(str, keyed.walk("ip", [int(x) for x in found.split(".")], [256] * 4, host)))
    if kind == "iban":
        plain = found.replace(" ", "")
        body = keyed.text("iban" + plain[:2], plain[4:])
        made = plain[:2] + f"{98 - iban_number(plain[:2] + '00' + body):02d}" + body
        it = iter(made)
        return "".join(" " if c == " " else next(it) for c in found)
    if kind == "email":
        local, _, domain = found.rpartition("@")
        new = keyed.text("email@" + domain.lower(), local)
        name, _, suffix = domain.partition(".")
        reserved = re.search(r"(?i)(?:^|\.)example\.(?:com|org|net)$|\.(?:test|invalid|example)$", domain)
        return new + "@" + (domain if reserved or domain.count(".") > 2 else keyed.text("domain", name) + "." + suffix)
    if kind == "secret":
        return keyed.text("secret", found, HEX if re.fullmatch("[0-9a-f]+", found) else None)
    raise ValueError(kind)


def _script(word: str) -> str:
    c = next((c for c in word if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _spelled(keyed: Keyed, part: str, word: str, script: str) -> str:
    """A word in syllables: its number among all words that take as many syllables, permuted. Different words, different spellings."""
    low = word.lower()
    base = LETTERS[script]
    plain = all(c in base for c in low)
    size = len(base) if plain else 0x110000
    onset, vowel = SYLLABLES[script]
    per = len(onset) * len(vowel)
    needed = lambda n: next(m for m in range(1, 10 * n + 2) if per**m * (size - 1) >= size ** (n + 1))
    m = needed(len(low))
    number = 0
    for c in low:
        number = number * size + (base.index(c) if plain else ord(c))
    shorter = len(low) - 1
    while shorter and needed(shorter) == m:  # shorter words with as many syllables come first
        number += size**shorter
        shorter -= 1
    radix = [len(onset), len(vowel)] * m
    digits = []
    for r in reversed(radix):
        number, d = divmod(number, r)
        digits.append(d)
    moved = keyed.permute(f"{part}|{script}|{plain}", digits[::-1], radix)
    out = "".join((onset, vowel)[i % 2][d] for i, d in enumerate(moved))
    return out if plain else out + BEYOND[script]


def surname(keyed: Keyed, word: str) -> str:
    return _spelled(keyed, "surname", word, _script(word)).capitalize()


def given_name(keyed: Keyed, word: str, gender: str) -> str:
    script = _script(word)
    names = GIVEN[script, gender]
    if word in names:
        return names[keyed.permute(f"given|{script}|{gender}", [names.index(word)], [len(names)])[0]]
    return (_spelled(keyed, f"given|{gender}", word, script) + ENDINGS[script][gender]).capitalize()


KNOWN = {n: g for g in ("f", "m", "n") for (_, of), names in GIVEN.items() if of == g for n in names}
UNTITLED = re.compile(r"(?<![\w'’-])(" + "|".join(sorted(KNOWN, key=lambda n: (-len(n), n))) + rf")[  ]({WORD})(?![\w'’])")
WORDS = re.compile(r"\w+(?:['’-]\w+)*")
OPENS = re.compile(r"(?:^|[.!?:;\n]|[.!?][\"'»”)]+)\s*$")


def _names(keyed: Keyed, text: str) -> list[tuple[int, int, str, str]]:
    """Titled names, known given names with a surname, and later mentions of their parts."""
    parts: dict[str, str] = {}  # word -> surrogate
    spans: dict[int, tuple[int, str]] = {}  # start -> end, surrogate

    def take(m: re.Match, i: int, new: str) -> None:
        spans.setdefault(m.start(i), (m.end(i), new))
        parts.setdefault(m[i], new)

    for m in NAMED.finditer(text):
        if m[3]:
            take(m, 2, given_name(keyed, m[2], TITLES[m[1]]))
        take(m, 3 if m[3] else 2, surname(keyed, m[3] or m[2]))
    for m in UNTITLED.finditer(text):
        if m.start(1) not in spans:
            take(m, 1, given_name(keyed, m[1], KNOWN[m[1]]))
            take(m, 2, surname(keyed, m[2]))
    out = [(a, b, "name", new) for a, (b, new) in spans.items()]
    if parts:
        words = list(WORDS.finditer(text))
        said = {m[0] for m in words}
        common = {w for w in parts if w.lower() in said}
        for k, m in enumerate(words):
            if m[0] in parts and m.start() not in spans and m[0] not in common:
                after = words[k + 1][0] if k + 1 < len(words) else ""
                if after in parts or not OPENS.search(text, max(0, m.start() - 8), m.start()):
                    out.append((m.start(), m.end(), "name", parts[m[0]]))
    return out


def entities(keyed: Keyed, text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and surrogate of the entities of a text, none overlapping."""
    found: list[tuple[int, int, str, str]] = []  # by start

    def add(a: int, b: int, kind: str, make) -> None:
        at = bisect.bisect_left(found, (a,))
        if (at == 0 or found[at - 1][1] <= a) and (at == len(found) or b <= found[at][0]):
            found.insert(at, (a, b, kind, make()))

    if MARK.search(text):
        for kind, pattern in PATTERNS:
            for m in pattern.finditer(text):
                if valid(kind, m[1]):
                    add(*m.span(1), kind, lambda kind=kind, m=m: surrogate(keyed, kind, m[1]))
    if HINTS.search(text):
        for a, b, kind, new in _names(keyed, text):
            add(a, b, kind, lambda new=new: new)
    return found


def replaced(keyed: Keyed, text: str) -> tuple[str, list[str]]:
    found = entities(keyed, text)
    if not found:
        return text, []
    parts, at = [], 0
    for a, b, _, new in found:
        parts += [text[at:a], new]
        at = b
    return "".join(parts) + text[at:], [kind for _, _, kind, _ in found]


@lru_cache(maxsize=4)
def _keyed(key: str) -> Keyed:
    return Keyed(key)


def _rows(key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(None, []) if t is None else replaced(_keyed(key), t) for t in batch.column(1).to_pylist()]
        cols = [batch.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([len(k) for _, k in out], pa.int64()), pa.array([sorted(set(k)) for _, k in out], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "n_entities", "kinds"])


def _texts(key: str, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        new = pa.array([None if t is None else replaced(_keyed(key), t)[0] for t in batch.column(at).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([new if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)


def session_key(spark: SparkSession) -> str:
    """The session's key, or one drawn for this application."""
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        sc = spark.sparkContext
        key = sc._tessera_pii_key = getattr(sc, "_tessera_pii_key", None) or secrets.token_hex(32)
    return key


def surrogates(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities, kinds. No shuffle."""
    ship(df.sparkSession)
    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(lambda it: _rows(key, it), SCHEMA)


def cleaned(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with surrogates in the text."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)
    return df.mapInArrow(lambda it: _texts(key, at, it), df.schema)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return surrogates(spark.read.parquet(f"{sf_dir}/documents.parquet"), session_key(spark))
