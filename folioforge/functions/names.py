"""Personal names: cleaning of harvested fields, parts of a name, and similarity of two names."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import name_swap, nz

# Particles that belong to the surname after them.
PARTICLES = ("de", "del", "la", "las", "los", "san", "santa")
# Words that may stand small inside a listed person's name.
SMALL_WORDS = ("de", "del", "la", "las", "los", "y", "e", "da", "das", "do", "dos", "di", "du", "le", "van", "von", "der")
# Patterns of what is no name in a creator field.
ID_CODE = r"[A-Z]{4}\d{6}[HM][A-Z]{4,5}\d{0,2}|\d{4}-\d{4}-\d{4}-\d{1,4}[\dXx]?|cvu\d+|[A-Z]{4}\d{6}[A-Z0-9]{3}"
ROLE_MARKER = r"\b(?:co[-\s]*)?asesora?\s*tesis\b|\b(?:co[-\s]*)?asesora?\b:?|\bco[-\s]*ordinadora?\b:?|\bdirectora?\b:?|\b(?:dr|dra|mtro|mtra|lic|ing)\b\.?"
GLUED_ID = rf"#[\s/:]*(?:{ID_CODE})?(?:=?\s*asesor\s*tesis)?"
DIGIT_TOKEN = r"(?:\b(?:fl|ca)\.\s*)?(?:[#%*:=\-]+\s*|\b)[a-z]{0,4}\d[\da-z\-]*\.?"
ET_AL = r"(?:\.\.\.|…)?\s*\[?\s*\b(?:y otros|et al\b\.?)\s*\]?"
ROLE_SEGMENT = r"(?:^|,)[\s\-]*(?:sinodal|sustentante|autora?|compiladora?|comp\.|traductora?|tr\.|editora?|ed\.|ilustradora?|impresor|estudiante|revisor|presidente)\.?\s*(?=,|$)"
ACADEMIC_TITLE = r"\bM(?:\.\s?|\s)en\s[a-z]{1,2}\b\.?|\bC\.P\.C\.(?:\s*y\s*E\.I\.)?|\bM\.?V\.?Z\b\.?|\bQ\.?F\.?B\b\.?|\bQ\.B\.P\.|\bI\.Q\.(?:I\.)?|\bL\.A\.E\.T\.|\bIBQ\b\.?|\bPh\.?\s?D\b\.?|\bBi[oó]l\b\.?|\bArq\b\.?|\bEsp\."
INSTITUTION = (
    r"\b(?:univer\p{L}{0,3}dad|universit(?:y|é|ät|à)|institut[oe]?|tecnol[oó]gico|polit[eé]cnico|facultad|faculty|escuela|school|departamento|department|secretar[ií]a|direcci[oó]n|divisi[oó]n|coordinaci[oó]n|programa|centro de|cent(?:er|re)|campus|consejo|comit[eé]|committee|laboratorio|laboratory|academia|editorial|imprenta|oficina|gobierno|government|ayuntamiento|biblioteca|library|museo|fundaci[oó]n|asociaci[oó]n|sociedad|society|maestr[ií]a|doctorado|licenciatura|compa[ñn][ií]a|itesm|unam|ipn|conah?cyt|scielo)\b"
    r"|&\s*(?:co\b|cía|sons\b)|\bInc\b\.?|\bLtd\b\.?"
)
MOST_WORDS = 10


def _sub(c: Column, pattern: str, to: str = " ") -> Column:
    return F.regexp_replace(c, pattern, to)


def _any_case(pattern: str) -> str:
    return "(?iU)" + pattern


def repair_characters(c: Column) -> Column:
    """Dashes to ``-``; invisible marks dropped; loose accents and tildes joined with the letter before, else after them,
    or made an apostrophe; parentheses dropped with what they hold, brackets unwrapped; other symbols blank; a replacement
    character is ``?``, and one that stands beside no letter goes."""
    x = _sub(nz(c), "[‐‑‒–—]", "-")
    x = _sub(x, "[\u200b-\u200f\u202a-\u202e\u00ad\ufeff]", "")
    x = _sub(x, r"(?<=\p{L})([´`])\s+(?=\p{L})", "$1")
    x = _sub(x, r"(?U)(?<=\b\p{L})[´`](?=\p{Lu})", "'")
    pairs = [*zip("aeiouAEIOU", "áéíóúÁÉÍÓÚ", strict=True)]
    for plain, accented in [*pairs, ("ı", "í")]:
        x = _sub(x, f"{plain}[´`]", accented)
    for plain, accented in pairs:
        x = _sub(x, f"[´`]{plain}", accented)
    for n, tilded in (("n", "ñ"), ("N", "Ñ")):
        x = _sub(x, f"˜{n}|{n}˜", tilded)
    x = _sub(_sub(_sub(x, "[´`]", "'"), r"\([^)]*\)?"), r"[\[\]()]", "")
    x = _sub(_sub(x, '[:"“”«»©°*+¢±˜¿{}]'), "�", "?")
    return _sub(x, r"(?<!\p{L})\?(?!\p{L})")


def _edges(c: Column) -> Column:
    return _sub(c, r"^[,\s-]+|[,\s-]+$", "")


def clean_names(c: Column) -> Column:
    """Names in a creator field: split at ; | and line ends; identifiers, URLs, roles, titles, et-al marks, numbers and
    institutions removed; both the form found and its "First Last" form, without repeats.  Null has none."""
    parts = F.filter(F.transform(F.split(nz(c), r"[;\n|]"), lambda x: F.trim(x)), lambda x: F.length(x) >= 3)
    parts = F.filter(parts, lambda x: ~x.rlike(_any_case(rf"^(?:{ID_CODE})|^cvu\d+|^#?(?:{ID_CODE})$|^(?:https?://|info:eu-repo)")))

    def one(x: Column) -> Column:
        x = _sub(x, _any_case(r"https?://\S+"))
        x = _sub(_sub(x, _any_case(GLUED_ID)), "_")
        for pattern in (ROLE_MARKER, ET_AL, ACADEMIC_TITLE, DIGIT_TOKEN):
            x = _sub(x, _any_case(pattern))
        x = _sub(repair_characters(x), _any_case(ROLE_SEGMENT), "")
        return _edges(_sub(_sub(x, r"\s*,(\s*,)*", ","), r"\s+"))

    people = F.transform(F.flatten(F.transform(F.transform(parts, one), _people)), lambda x: _edges(_sub(x, r"\s*,\s*", ", ")))
    people = F.filter(people, lambda x: (F.length(x) >= 3) & x.rlike(r"\p{L}{2}") & ~x.rlike(_any_case(INSTITUTION)) & (F.size(F.split(x, r"\s+")) <= MOST_WORDS))
    return F.array_distinct(F.flatten(F.transform(people, lambda x: F.array(x, name_swap(x)))))


def _people(x: Column) -> Column:
    """Several people in one segment: at least three pieces, each of two to six words that are capitalised or small words,
    beginning with a capital and not ending in a small word."""
    pieces = F.transform(F.split(x, ","), lambda p: F.trim(p))
    words = lambda p: F.filter(F.split(p, r"\s+"), lambda w: w.rlike(r"\p{L}"))
    small = lambda w: F.lower(w).isin(*SMALL_WORDS)
    capital = lambda w: w.rlike(r"^\p{Lu}")
    person = lambda p: F.size(words(p)).between(2, 6) & capital(F.element_at(words(p), 1)) & ~small(F.element_at(words(p), -1)) & F.forall(words(p), lambda w: capital(w) | small(w))
    return F.when((F.size(pieces) >= 3) & F.forall(pieces, person), pieces).otherwise(F.array(x))


# --------------------------------------------------------------------------- parts of a name (plain Python)
@lru_cache(maxsize=200_000)
def name_tokens(raw: str) -> tuple[str, ...]:
    """Words of "First Last", folded to ASCII letters; an initial explained by a name after it is dropped."""
    if "," in raw:
        last, _, first = raw.partition(",")
        if last.strip() and first.strip():
            raw = f"{first.strip()} {last.strip()}"
    plain = "".join(ch for ch in unicodedata.normalize("NFD", raw.lower()) if not unicodedata.combining(ch))
    words = re.findall(r"[^\W_]+", plain.replace("'", ""))
    out: list[str] = []
    for w in words:
        if out and len(out[-1]) == 1 and len(w) > 1 and w[0] == out[-1] and re.search(rf"\b{re.escape(out[-1])}\.?\s*\(\s*{re.escape(w)}", plain):
            out[-1] = w
        else:
            out.append(w)
    return tuple(out)


def _unit(tokens: tuple[str, ...], i: int) -> tuple[str, int]:
    """The surname unit that ends at i, and where it starts: ``x y z``, or particles and a name."""
    if i >= 2 and tokens[i - 1] == "y":
        return f"{tokens[i - 2]}-y-{tokens[i]}", i - 2
    a = i
    while a > 0 and tokens[a - 1] in PARTICLES:
        a -= 1
    return "-".join(tokens[a : i + 1]), a


@lru_cache(maxsize=200_000)
def given_surname(tokens: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(given words, surname units): the maternal unit, and the paternal one if a given word is left before it."""
    if not tokens:
        return (), ()
    if len(tokens) == 1:
        return (), tokens
    last, a = _unit(tokens, len(tokens) - 1)
    if a <= 0:
        return (), (last,)
    if a >= 2:
        first, b = _unit(tokens, a - 1)
        if b >= 1 and len(first) > 1:
            return tokens[:b], (first, last)
    return tokens[:a], (last,)


def surname_words(surname: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(w for u in surname for w in u.split("-") if w not in PARTICLES and w != "y")


def block_keys(raw: str) -> list[str]:
    w = surname_words(given_surname(name_tokens(raw))[1])
    return sorted({w[0], w[-1]}) if w else []


def is_garbage(raw: str) -> bool:
    return bool(re.match(r"(?i)\s*(?:https?:|www\.|orcid|[\d\W_]+$)", raw)) or len(name_tokens(raw)) > 10 or not name_tokens(raw)


@lru_cache(maxsize=500_000)
def osa(a: str, b: str) -> int:
    """Edits of one character and swaps of neighbours, no part edited twice."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, last = last, now
    return last[-1]


def token_score(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if min(len(a), len(b)) == 1:
        return 1.0 / max(len(a), len(b)) if a[0] == b[0] else 0.0
    return 1.0 - osa(a, b) / max(len(a), len(b))


def align(short: tuple[str, ...], long: tuple[str, ...]) -> list[tuple[str, str, float]]:
    """One partner each, in order; the first of the best; a score of 0 uses its partner up too."""
    if len(short) > len(long):
        short, long = long, short
    used: set[int] = set()
    out = []
    for x in short:
        best, at = -1.0, -1
        for k, y in enumerate(long):
            if k not in used and (s := token_score(x, y)) > best:
                best, at = s, k
        used.add(at)
        out.append((x, long[at], best))
    return out


def surname_score(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """1 if equal, or if one is a single word that begins or ends the other; else the worse of the first words' and the
    other words' typo scores.  A surname without words, or whose last word has one letter, agrees with none."""
    x, y = surname_words(a), surname_words(b)
    if not x or not y or len(x[-1]) < 2 or len(y[-1]) < 2:
        return 0.0
    if x == y or (min(len(x), len(y)) == 1 and (x[0] == y[0] or x[-1] == y[-1])):
        return 1.0
    p, q = " ".join(x[1:]), " ".join(y[1:])
    tail = 1.0 if not p and not q else 0.0 if not p or not q else token_score(p, q)
    return min(token_score(x[0], y[0]), tail)


BAR, FLOOR = 0.9, 0.2


def match(a: tuple, b: tuple) -> tuple[float, float, list[tuple[str, str, float]]]:
    """(given match, surname score, aligned pairs) of two (given, surname)."""
    s = surname_score(a[1], b[1])
    if not a[0] and not b[0]:
        return 1.0, s, []
    if not a[0] or not b[0]:
        return 0.0, s, []
    pairs = align(a[0], b[0])
    return sum(p[2] for p in pairs) / len(pairs), s, pairs


def same_person(a: tuple, b: tuple) -> bool:
    m, s, _ = match(a, b)
    return m >= BAR and s >= BAR


def contradicts(a: tuple, b: tuple) -> bool:
    _, s, pairs = match(a, b)
    return s < BAR or any(len(x) > 1 and len(y) > 1 and v < FLOOR for x, y, v in pairs)


def may_be_initials(a: tuple, b: tuple) -> bool:
    """Surnames agree and every aligned pair is equal or an initial of the other."""
    _, s, pairs = match(a, b)
    return s >= BAR and bool(pairs) and all(x == y or (min(len(x), len(y)) == 1 and x[0] == y[0]) for x, y, _ in pairs)


def first_surname_agrees(a: tuple, b: tuple) -> bool:
    """False where the surnames differ in number and in their first word, unless the last words agree and the longer
    name (third of the tuple: whether it is written with a hyphen) has no hyphen.  Words of one letter don't count."""
    x, y = ([w for w in surname_words(n[1]) if len(w) > 1] for n in (a, b))
    if not x or not y or len(x) == len(y) or x[0] == y[0]:
        return True
    return x[-1] == y[-1] and not (a if len(x) > len(y) else b)[2]


def weak(a: tuple, b: tuple) -> bool:
    """Whether the alignment leaves out the first given word of the name that has more of them."""
    if not a[0] or not b[0] or len(a[0]) == len(b[0]):
        return False
    first = max(a[0], b[0], key=len)[0]
    return all(y != first for _, y, _ in align(a[0], b[0]))
