"""Surrogates for personal data.

Detected entities get replacements that depend on a secret key and the entity alone, so
that equal entities stay equal everywhere (coreference) and different ones stay
different.  A replacement keeps type and format: digits, letters and separators keep
their places, a card number its first digit and whether its check digit holds, an IBAN
its country and valid check digits, an address its class, a name its gender, script and
case.

Digits and letters go to the next one in a keyed order of all texts of their format (a
Feistel network over the radix gives the order).  That is a bijection of the format
without a fixed point, so however many of a format's texts are real, replacements are
distinct and none is its own original; which of them are real elsewhere does not matter,
for those are replaced too.

Names come from limited lists, then from syllables, so a check over all of the corpus's
distinct names finds replacements that equal another's or their original; those are drawn
again, a syllable longer each time, so that clashes fall by a factor of 20 at least with
every attempt.  After ``LAST`` attempts, when draws exceed 100 bits, a clash is an error.

A name is found after a title; words so found are names wherever else they stand in the
text in the same case, unless the text also has them in small letters.  A given name has
one surrogate, whatever titles it follows: its gender is what most titles of the corpus
say, without any that of the list or ending.  Digits without separators are a card number
only if the check digit holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, lean, ship

KINDS = ("email", "iban", "secret", "mac", "ip", "ssn", "card", "phone", "given", "surname")
LAST = 24
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
MALE = ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "господин", "Господин", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "госпожа", "Госпожа", "г-жа")
NEUTRAL = ("Dr", "Prof", "Professor", "Doktor", "Docteur", "Doctor")
_TITLE = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:[-'’][A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)?"
_DOMAIN = r"@[^\W_](?:[\w\-]*[^\W_])?(?:\.[^\W_](?:[\w\-]*[^\W_])?)*\.[^\W\d_]{2,}"
#: All that can stand before an @ and its domain; the address begins at the first letter or digit.
_LOCAL = re.compile(rf"(?<![\w.%+\-])[\w.%+\-]++(?=(?P<domain>{_DOMAIN}))")
_ALNUM = re.compile(r"[^\W_]")
_KEY = r"(?i:token|api[_-]?key|secret|password|passwd|pwd|access[_-]?key)[\"']?"
_NAME = rf"(?P<title>{_TITLE})\.?\s+(?P<name>{_CAP}(?:\s+{_CAP})?)"
#: All entities but addresses of mail.
_FIND = re.compile(
    r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    rf"|(?:{_KEY}\s*[=:]\s*[\"']?(?P<secret>(?=[A-Za-z_\-+/]*\d)[A-Za-z0-9_\-+/]{{12,}}))"
    r"|(?P<secret2>\b(?:sk-|ghp_|gho_|AKIA|xox[abp]-|eyJ)[A-Za-z0-9_\-]{12,}|(?<![\w])(?=[0-9a-fA-F]*\d)(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{64}|[0-9A-F]{40}|[0-9A-F]{32})(?![\w]))"
    r"|(?P<mac>\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b)"
    rf"|(?P<ip>(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d))"
    r"|(?P<phone>(?<![\d.])\+\d{1,3}[ .\-]?\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-/]?\d{2,4}){1,3}(?!\.?\d)|(?<![\d.+])\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.+-])\d{3}[.\- ]\d{3}[.\- ]\d{4}(?![\d-]))"
    rf"|(?:(?<!\w){_NAME})",
)
_HINT = re.compile(r"[0-9@]")
_MAC_HINT = re.compile(r"[:-][A-Fa-f]{2}[:-]")
_TITLES = re.compile(rf"(?<!\w)(?:{_TITLE})")
_NAMED = re.compile(_NAME)
_CAPITAL = re.compile(rf"(?<!\w){_CAP}(?!\w)")
_WORD = re.compile(r"(?<!\w)[a-zß-öø-ÿа-яё]+(?:[-'’][a-zß-öø-ÿа-яё]+)?(?!\w)")
_KEY_END = re.compile(rf"{_KEY}\Z")
#: Given names by gender and script, syllables of surnames by script.
GIVEN = {
    ("m", "latin"): ("Adrian", "Albert", "Anton", "Arthur", "Bruno", "Daniel", "David", "Edgar", "Emil", "Felix", "Gabriel", "Hugo", "Jonas", "Julian", "Leon", "Lucas", "Marcus", "Martin", "Nathan", "Oliver", "Oscar", "Paul", "Robert", "Samuel", "Simon", "Thomas", "Victor", "Walter"),
    ("f", "latin"): ("Ada", "Alice", "Anna", "Beatrice", "Clara", "Diana", "Elena", "Emma", "Eva", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Lena", "Lucia", "Maria", "Marta", "Nina", "Nora", "Olivia", "Paula", "Rosa", "Sara", "Sofia", "Teresa", "Vera"),
    ("n", "latin"): ("Alex", "Andrea", "Ariel", "Charlie", "Chris", "Dominique", "Eden", "Kim", "Kit", "Lou", "Morgan", "Noel", "Robin", "Sam", "Sasha", "Toni"),
    ("m", "cyrillic"): ("Алексей", "Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Олег", "Павел", "Роман", "Сергей", "Юрий"),
    ("f", "cyrillic"): ("Алина", "Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Ксения", "Лариса", "Мария", "Нина", "Ольга", "Полина", "Софья", "Юлия"),
    ("n", "cyrillic"): ("Женя", "Саша", "Слава", "Валя", "Шура", "Паша", "Никита", "Миша"),
}
SYLLABLES = {"latin": ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ha", "he", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "pa", "pe", "ra", "re", "ro", "sa", "so", "ta", "te", "to", "va", "ve", "wa", "za"), "cyrillic": ("ба", "бо", "ва", "ве", "го", "да", "де", "за", "ка", "ко", "ла", "ле", "ма", "мо", "на", "но", "па", "пе", "ра", "ро", "са", "со", "та", "те", "фа", "хо")}
ENDINGS = {("m", "latin"): "n", ("f", "latin"): "na", ("n", "latin"): "ri", ("m", "cyrillic"): "н", ("f", "cyrillic"): "на", ("n", "cyrillic"): "ша", ("s", "latin"): "nd", ("s", "cyrillic"): "нко"}
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _round(key: bytes, tweak: str, r: int, half: int) -> int:
    return int.from_bytes(blake2b(f"{tweak}|{r}|{half}".encode(), key=key, digest_size=32).digest(), "big")


def permute(value: int, size_a: int, size_b: int, key: bytes, tweak: str) -> int:
    """The next of 0 .. size_a * size_b - 1 in a keyed order: a bijection, without a fixed point from two values on."""
    a, b = divmod(value, size_b)
    for r in range(10):
        if r % 2:
            b = (b + _round(key, tweak, r, a)) % size_b
        else:
            a = (a + _round(key, tweak, r, b)) % size_a
    a, b = divmod((a * size_b + b + 1) % (size_a * size_b), size_b)
    for r in reversed(range(10)):
        if r % 2:
            b = (b - _round(key, tweak, r, a)) % size_b
        else:
            a = (a - _round(key, tweak, r, b)) % size_a
    return a * size_b + b


def permute_text(text: str, alphabet: str, key: bytes, tweak: str) -> str:
    """A keyed bijection of texts of one length over an alphabet."""
    n, radix = len(text), len(alphabet)
    if not n:
        return text
    value = 0
    for c in text:
        value = value * radix + alphabet.index(c)
    value = permute(value, radix ** ((n + 1) // 2), radix ** (n // 2), key, f"{tweak}|{radix}|{n}")
    out = []
    for _ in range(n):
        value, d = divmod(value, radix)
        out.append(alphabet[d])
    return "".join(reversed(out))


def by_class(text: str, key: bytes, tweak: str) -> str:
    """Digits and letters permuted, each class among its own places; other characters stay."""
    shape = "".join("9" if c in _DIGIT else "a" if c in _LOWER else "A" if c in _UPPER else c for c in text)
    out = list(text)
    for alphabet in (_DIGIT, _LOWER, _UPPER):
        at = [i for i, c in enumerate(text) if c in alphabet]
        for i, c in zip(at, permute_text("".join(text[i] for i in at), alphabet, key, f"{tweak}|{shape}")):
            out[i] = c
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that belongs after ``digits``."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


_PRIVATE = ((10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (127 << 24, 24))


def _ip(canon: str, key: bytes, tweak: str) -> str:
    value = 0
    for part in canon.split("."):
        value = value * 256 + int(part)
    for base, bits in _PRIVATE:
        if value >> bits == base >> bits:
            low = permute(value & ((1 << bits) - 1), 1 << (bits // 2), 1 << (bits - bits // 2), key, f"{tweak}|{base}")
            value = base | low
            break
    else:
        public = lambda v: (v >> 24) not in (0, 10, 127) and not any(v >> k == b >> k for b, k in _PRIVATE)
        high = value >> 24 >= 224
        while True:  # walks the cycle until it is back in the class
            value = permute(value, 1 << 16, 1 << 16, key, tweak)
            if public(value) and (value >> 24 >= 224) == high:
                break
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def script_of(name: str) -> str:
    return "cyrillic" if re.search(r"[а-яёА-ЯЁ]", name) else "latin"


def guess(canon: str) -> str:
    """The gender of a given name that no title tells: by list, else by ending."""
    for gender in "nfm":
        if any(canon == x.lower() for k in ("latin", "cyrillic") for x in GIVEN[gender, k]):
            return gender
    return "f" if canon.endswith(("a", "ette", "elle", "ine", "lyn", "а", "я")) else "m"


_HEX = re.compile(r"[0-9a-f]+")


def surrogate(kind: str, canon: str, key: bytes, attempt: int = 0, gender: str = "") -> str:
    """The replacement of an entity in canonical form, in canonical form."""
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        labels = domain.split(".")
        return by_class(local, key, kind) + "@" + ".".join([*(by_class(x, key, "domain") for x in labels[:-1]), labels[-1]])
    if kind == "ip":
        return _ip(canon, key, kind)
    if kind == "card":
        body = canon[0] + permute_text(canon[1:-1], _DIGIT, key, kind)
        return body + str((luhn(body) + int(canon[-1]) - luhn(canon[:-1])) % 10)
    if kind == "iban":
        rest = by_class(canon[4:], key, kind + canon[:2])
        return canon[:2] + _iban_check(canon[:2], rest) + rest
    if kind == "phone":
        code, _, rest = canon.partition("|")
        return code + "|" + permute_text(rest, _DIGIT, key, kind + code)
    if kind == "mac" or kind == "secret" and _HEX.fullmatch(canon):
        return permute_text(canon, _DIGIT + "abcdef", key, kind)
    if kind in ("secret", "ssn"):
        canon = by_class(canon, key, kind)
        while kind == "secret" and _HEX.fullmatch(canon):  # walks the cycle until it leaves the other class
            canon = by_class(canon, key, kind)
        return canon
    script = script_of(canon)
    gender = (gender or guess(canon)) if kind == "given" else "s"
    draw = _round(key, f"{kind}|{attempt}", 0, int.from_bytes(blake2b(canon.encode(), digest_size=8).digest(), "big"))
    if kind == "given" and attempt == 0:
        names = GIVEN[gender, script]
        return names[draw % len(names)].lower()
    syllables, out = SYLLABLES[script], ""
    for _ in range(3 + attempt):
        draw, k = divmod(draw, len(syllables))
        out += syllables[k]
    return out + ENDINGS[gender, script]


class Entity:
    """A span of a text, its kind and canonical form, how a replacement is written there, and the gender that a title tells."""

    __slots__ = ("start", "end", "kind", "canon", "written", "gender")

    def __init__(self, start: int, end: int, kind: str, canon: str, written: str, gender: str = ""):
        self.start, self.end, self.kind, self.canon, self.written, self.gender = start, end, kind, canon, written, gender

    def write(self, value: str) -> str:
        w = self.written
        if self.kind in ("card", "phone", "mac", "iban"):
            code, _, rest = value.rpartition("|")
            chars = iter(code + rest)
            out = "".join(next(chars) if c.isalnum() else c for c in w)
        else:
            out = value
        if self.kind == "iban":
            return out
        if w.isupper():
            return out.upper()
        if self.kind in ("given", "surname"):
            return out[:1].upper() + out[1:]
        return out


def _back(text: str, at: int) -> int:
    while at and text[at - 1].isspace():
        at -= 1
    return at


def _keyed(text: str, begin: int) -> int:
    """Where the line of the key begins whose value may be on the line at ``begin``."""
    at = _back(text, begin)
    if at and text[at - 1] in "=:":
        at = _back(text, at - 1)
    key = _KEY_END.search(text, max(0, at - 12), at)
    return text.rfind("\n", 0, key.start()) + 1 if key else begin


def _spans(text: str) -> Iterator[tuple[int, int]]:
    """Lines in which an entity may be: all but names hold a digit, an @ or a MAC address of letters.

    Only names and the values of keys cross line feeds; their lines are one span.
    """
    found, end = [], -1
    for at in sorted(m.start() for hint in (_HINT, _MAC_HINT) for m in hint.finditer(text)):
        if at >= end:
            begin, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
            end = len(text) if end < 0 else end
            found.append((_keyed(text, begin), end))
    if any(t in text for t in (*MALE, *FEMALE, *NEUTRAL)):
        end = -1
        for m in _TITLES.finditer(text):
            if (name := _NAMED.match(text, m.start())) and name.end() > end:
                end = text.find("\n", name.end())
                end = len(text) if end < 0 else end
                found.append((text.rfind("\n", 0, m.start()) + 1, end))
    begin, end = 0, -1
    for b, e in sorted(found):
        if b > end:
            if end >= 0:
                yield begin, end
            begin, end = b, e
        end = max(end, e)
    if end >= 0:
        yield begin, end


def _matches(text: str, begin: int, end: int) -> Iterator[tuple[int, int, re.Match | None]]:
    """Start, end and match of what is found left to right; for an address of mail, which comes first, no match."""
    at, m = begin, _FIND.search(text, begin, end)
    for local in _LOCAL.finditer(text, begin, end) if text.find("@", begin, end) >= 0 else ():
        while first := _ALNUM.search(text, max(at, local.start()), local.end()):
            if m and m.start() < first.start():
                yield *m.span(), m
                at = m.end()
            else:
                at = local.end("domain")
                yield first.start(), at, None
            if m and m.start() < at:
                m = _FIND.search(text, at, end)
    while m:
        yield *m.span(), m
        m = _FIND.search(text, m.end(), end)


def entities(text: str) -> list[Entity]:
    """Non-overlapping entities of a text, left to right."""
    out = []
    for start, stop, m in (x for begin, end in _spans(text) for x in _matches(text, begin, end)):
        if m is None:
            out.append(Entity(start, stop, "email", text[start:stop].lower(), text[start:stop]))
            continue
        kind = m.lastgroup
        if kind == "name" or kind == "title":
            title, name = m["title"], m["name"]
            parts, at = re.split(r"(\s+)", name), m.start("name")
            gender = "m" if title in MALE else "f" if title in FEMALE else ""
            for k, part in enumerate(parts):
                if k % 2 == 0:
                    kind = "given" if k == 0 and len(parts) > 1 else "surname"
                    out.append(Entity(at, at + len(part), kind, part.lower(), part, gender if kind == "given" else ""))
                at += len(part)
            continue
        kind = next(g for g in ("iban", "secret", "secret2", "mac", "ip", "ssn", "card", "phone") if m[g] is not None)
        s, e = m.span(kind)
        found = m[kind]
        kind = "secret" if kind == "secret2" else kind
        if kind == "iban":
            canon = found.replace(" ", "")
            if _iban_check(canon[:2], canon[4:]) != canon[2:4]:
                continue
        elif kind == "card":
            canon = re.sub(r"\D", "", found)
            if canon == found and luhn(canon[:-1]) != int(canon[-1]):
                continue
        elif kind == "phone":
            digits = re.sub(r"\D", "", found)
            if not 7 <= len(digits) <= 15:
                continue
            code = m0[1] if (m0 := re.match(r"\+(\d{1,3})(?=\D)", found)) else digits[:1] if found[0] == "+" else ""
            canon = f"{code}|{digits[len(code):]}"
        elif kind == "mac":
            canon = re.sub(r"[:-]", "", found).lower()
        elif kind == "secret" and re.fullmatch(r"[0-9A-F]+", found):
            canon = found.lower()
        elif kind == "secret":
            canon = found
            if not re.search(r"\d", found):
                continue
        else:
            canon = found
        out.append(Entity(s, e, kind, canon, found))
    return _mentions(text, out)


def _mentions(text: str, found: list[Entity]) -> list[Entity]:
    """With the words that are names after a title also where they stand without one."""
    names: dict[str, Entity] = {}
    for x in found:
        if x.kind in ("given", "surname"):
            names.setdefault(x.written, x)
    if not names:
        return found
    words = {m[0] for m in _WORD.finditer(text)}
    names = {w: x for w, x in names.items() if x.canon not in words}
    more, k = [], 0
    for m in _CAPITAL.finditer(text) if names else ():
        if (x := names.get(m[0])) is None:
            continue
        while k < len(found) and found[k].end <= m.start():
            k += 1
        if k == len(found) or found[k].start >= m.end():
            more.append(Entity(m.start(), m.end(), x.kind, x.canon, m[0]))
    return sorted([*found, *more], key=lambda x: x.start) if more else found


def genders(found: list[Entity]) -> dict[str, int]:
    """By given name, how many more titles of men than of women it follows."""
    out: dict[str, int] = {}
    for x in found:
        if x.kind == "given":
            out[x.canon] = out.get(x.canon, 0) + (x.gender == "m") - (x.gender == "f")
    return out


def replace(text: str, key: bytes, known: dict[tuple[str, str], tuple[int, str]] | None = None) -> tuple[str, list[Entity]]:
    """The text with surrogates, and the entities that it had.

    known: attempt and gender by kind and canonical form where they are not 0 and the
    guess; without it the text is all there is, and its own titles tell genders.
    """
    found = entities(text)
    if not found:
        return text, found
    if known is None:
        known = {("given", c): (0, "m" if n > 0 else "f") for c, n in genders(found).items() if n}
    out, at = [], 0
    for x in found:
        out += [text[at : x.start], x.write(surrogate(x.kind, x.canon, key, *known.get((x.kind, x.canon), (0, ""))))]
        at = x.end
    return "".join([*out, text[at:]]), found


_NAMES = pa.schema([("kind", pa.string()), ("canon", pa.string()), ("men", pa.int64())])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names of a batch's texts and what titles tell of them."""
    for b in batches:
        seen: dict[tuple[str, str], int] = {}
        for t in b.column(0).to_pylist():
            if t and any(x in t for x in (*MALE, *FEMALE, *NEUTRAL)):
                found = entities(t)
                votes = genders(found)
                for at in {(x.kind, x.canon) for x in found if x.kind in ("given", "surname")}:
                    seen[at] = seen.get(at, 0) + (votes.get(at[1], 0) if at[0] == "given" else 0)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in seen], pa.string()), pa.array([x for _, x in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], schema=_NAMES)


def _draw(key: bytes):
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [surrogate(k, c, key, a, g) for k, c, g, a in zip(*(b.column(i).to_pylist() for i in range(4)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], ["kind", "canon", "gender", "attempt", "made"])

    return draw


def resolve(known: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """kind, canon, gender, attempt, made for each distinct name, no ``made`` equal to its canon or to another's."""
    schema = "kind string, canon string, gender string, attempt int, made string"
    columns = ["kind", "canon", "gender", "attempt"]
    settled, todo = None, known.withColumn("attempt", F.lit(0))
    for k in range(LAST):
        made = scratch.save(todo.mapInArrow(lean(_draw(key)), schema), f"made{k}")
        # of equal replacements the smallest canon keeps its own; earlier ones are kept before
        rivals = made.where("made != canon").groupBy("kind", "made").agg(F.min("canon").alias("first"))
        bad = made.join(rivals, ["kind", "made"], "left").where("first is null or canon != first").select(columns)
        if settled is not None:
            bad = bad.unionByName(made.join(settled.select("kind", "made"), ["kind", "made"], "left_semi").select(columns))
        bad = scratch.save(bad.distinct(), f"bad{k}")
        good = made.join(bad.select("kind", "canon"), ["kind", "canon"], "left_anti")
        settled = scratch.save(good if settled is None else settled.unionByName(good), f"settled{k}")
        if bad.isEmpty():
            return settled
        todo = bad.withColumn("attempt", (F.col("attempt") + 1).cast("int"))
    raise RuntimeError(f"replacements still clash after {LAST} attempts")


def replace_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """All columns of ``docs`` with surrogates in the text; with ``counts`` also n_entities and one count a kind.

    key: secret bytes, 64 at most; who has it can undo the replacements.  Null texts stay
    null, empty ones empty.  Repeated rows are replaced alike.  Ties (two names that draw
    the same replacement) go to the smaller name, so reruns agree.  A text is searched
    whole, however long; time is linear in it.  Empty tables give no rows.  A count whose
    name a column of ``docs`` has gets underscores.
    """
    spark = docs.sparkSession
    ship(spark)
    if not key or len(key) > 64:
        raise ValueError("surrogates need a key of 1 to 64 bytes")
    scratch = Scratch(spark, "pii")
    votes = docs.select(F.col(text_col)).mapInArrow(lean(_distinct), "kind string, canon string, men long").groupBy("kind", "canon").agg(F.sum("men").alias("men"))
    known = scratch.save(votes.select("kind", "canon", F.when(F.col("men") > 0, "m").when(F.col("men") < 0, "f").otherwise("").alias("gender")), "known")
    again = scratch.save(resolve(known, key, scratch).where("attempt > 0 or gender != ''").select("kind", "canon", "attempt", "gender"), "again")
    source, extra = docs, fresh(docs, "_known")
    if again.isEmpty():
        source = docs.withColumn(extra, F.lit(None).cast("array<struct<kind:string,canon:string,attempt:int,gender:string>>"))
    else:
        row = F.xxhash64(F.col(text_col))

        def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = {(h, x.kind, x.canon) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for x in entities(t) if x.kind in ("given", "surname")}
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int64(), pa.string(), pa.string()))], ["h", "kind", "canon"])

        where = docs.select(row.alias("h"), F.col(text_col)).mapInArrow(lean(occurrences), "h long, kind string, canon string").distinct()
        lists = scratch.save(where.join(again, ["kind", "canon"]).groupBy("h").agg(F.collect_list(F.struct("kind", "canon", "attempt", "gender")).alias(extra)), "lists")
        h = fresh(docs, "_h")
        # only texts with such a name meet the list
        source = docs.withColumn(h, row).join(lists.withColumnRenamed("h", h), h, "left").drop(h)
    at, names = docs.columns.index(text_col), [fresh(docs, f"n_{k}") for k in KINDS]
    total = fresh(docs, "n_entities")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + (f", `{total}` long, " + ", ".join(f"`{n}` long" for n in names) if counts else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, numbers = [], []
            for t, a in zip(b.column(at).to_pylist(), b.column(len(docs_columns)).to_pylist()):
                if t is None:
                    texts.append(None)
                    numbers.append([0] * len(KINDS))
                    continue
                new, found = replace(t, key, {(x["kind"], x["canon"]): (x["attempt"], x["gender"]) for x in a or ()})
                texts.append(new)
                numbers.append([sum(x.kind == k for x in found) for k in KINDS] if found else [0] * len(KINDS))
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            if counts:
                columns += [pa.array([sum(n) for n in numbers], pa.int64()), *(pa.array([n[k] for n in numbers], pa.int64()) for k in range(len(KINDS)))]
            yield pa.RecordBatch.from_arrays(columns, [*docs_columns, *([total, *names] if counts else [])])

    docs_columns = docs.columns
    return source.select(*[F.col(f"`{c}`") for c in docs_columns], extra).mapInArrow(lean(run), schema)
