"""PII: detected entities get keyed surrogates of the same type, format, script and gender, equal for equal entities.

Kinds: e-mail addresses, phone numbers, payment cards (by check digit), IPv4 and IPv6 addresses, IBANs, national ids of the form 3-2-4,
numbers after the word passport, secrets of any length (``password=``, ``token = "..."``, keys that tell their kind), PEM blocks of private keys,
and names: after a form of address, and wherever the full name (in any case), its surname or its given name (with a capital) stands again in the
same text. Titles in capitals count before names in capitals; those that are also abbreviations (MS, DR, SR, PROF) need a full stop then. Birth dates
are not looked for. A surrogate is made from an HMAC, under the caller's key, of the entity's canonical form, so one entity has one surrogate in every
document and spelling ("+1 (212) 555-0100" and "+12125550100", or "+44 20 7946 0958" and "020 7946 0958", keep their own punctuation, country
code and trunk zero), digits stay digits, letters keep their case and script, cards keep their check digit and first digit, addresses stay valid and
given names keep their gender.

The words of a name are entities of their own: the last word is a surname, whatever the title, the word before it is a given name of
the gender that a title in the text tells; initials and particles ("de la", "van") stay. Where no title of a text tells it ("Dr John Smith"), the gender is
what titles tell of the same full name elsewhere in the corpus, else of the same given name, by majority; without one, or at a tie, it is left open. So "Mr John Smith" here and
"Dr John Smith", "JOHN SMITH" and "John" there get the same surrogate.

Distinctness is checked, not assumed: the distinct entities of the corpus are listed, and where two have the same surrogate as
it is printed, or a surrogate is another entity that occurs, all but the first (by canonical form) get another try, until none collide. Later tries have
more syllables or letters to choose from, so small spaces do not run out. Numbers of a fixed format can: where some of a kind still collide after
``MOST_TRIES`` tries (a corpus that holds nearly all of them), all of that kind go by a keyed permutation of their format, which cannot collide and leaves none
as it was; a surrogate may then be another number that occurs. Only entities that needed a second try, and names whose gender other texts tell, are
carried back; up to ``MOST_RETRIED`` of them as a broadcast table, more by a join.

Defined cases: null stays null and empty stays empty; overlapping finds go to the leftmost, then to the longest, then to the kind named first above;
texts without entities are returned as they are; very long texts are read whole; rows that repeat get the same text; extra columns pass
through whatever their names, one called like the new column is replaced.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import Scratch, thrifty, unused

MOST_RETRIED = 20_000
MOST_TRIES = 64

#: Forms of address by gender, and surrogate given and family names by script (fixed values).
TITLES = {
    "m": ("Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "господин", "г-н"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "Signora", "госпожа", "г-жа"),
    "n": ("Dr", "Prof", "Professor", "Doktor", "Docteur"),
}
#: Given names by script and gender for first tries, and the syllables and endings that later ones and surnames are made of (fixed values).
NAMES = {
    "latin": {
        "m": "Adam Bruno Carl David Erik Felix Georg Henri Ivan Jonas Karl Louis Martin Nils Oscar Paul Robert Simon Thomas Victor".split(),
        "f": "Alice Berta Clara Diana Elena Flora Greta Helen Irene Julia Karin Laura Maria Nina Olga Paula Rosa Sofia Teresa Vera".split(),
        "n": "Alex Robin Sascha Kim Andrea Dominique Noel Jo".split(),
    },
    "cyrillic": {
        "m": "Антон Борис Виктор Глеб Денис Игорь Лев Максим Олег Павел".split(),
        "f": "Алла Вера Галина Дарья Елена Инна Лариса Мария Нина Ольга".split(),
        "n": "Саша Женя Валя".split(),
    },
}
SYLLABLES = {
    "latin": ("b br c d dr f g gr h j k l m n p r s st t tr v w".split(), "a e i o u".split(), {"m": "an o us ek in".split(), "f": "a ia ina ella etta".split(), "n": "e y el is".split(), "last": "mann berg son well ter ler ner ard ens itz".split()}),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х".split(), "а е и о у".split(), {"m": "ан ор ин слав".split(), "f": "а ина ия ана".split(), "n": "я ни".split(), "last": "ов ев ин ский".split()}),
}
#: Words before a surname that stay as they are, and country codes of two digits; 1 and 7 have one, all others three (fixed values).
PARTICLES = "al bin da de del della den der di do dos du el la las le los ten ter van von zu".split()
CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
ABBREVIATIONS = ("MS", "DR", "SR", "PROF")
_GENDER = {t.lower(): g for g, titles in TITLES.items() for t in titles}
_SMALL = {w for p in PARTICLES for w in (p, p.upper())}
_CAPITAL = r"[^\W\d_a-zß-öø-ÿа-яё]"
_CAP = rf"(?:{_CAPITAL}['’])?{_CAPITAL}[^\W\d_]+(?:-{_CAPITAL}[^\W\d_]+)?"
_PARTS = "(?:(?:" + "|".join(sorted(_SMALL)) + ") ){0,3}"
_TITLE = "|".join(sorted(map(re.escape, (t for titles in TITLES.values() for t in titles)), key=len, reverse=True))
_LOUD = "|".join(rf"{re.escape(t)}\." if t in ABBREVIATIONS else rf"{re.escape(t)}\.?" for t in sorted({t.upper() for titles in TITLES.values() for t in titles if t.upper() != t}, key=len, reverse=True))
_PEM = r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----"
_FIND = {
    # To the block's own end; without one, as far as lines of base64 go.
    "private_key": re.compile(_PEM + r"(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{32,}+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]+(?:={1,2}|(?=[ \t]*(?:[\r\n]|\Z))))?)"),
    "secret": re.compile(
        r"""(?i:\b(?:password|passwd|pwd|passwort|contraseña|token|secret|api[_-]?key|access[_-]?key|auth)\b["']?\s{0,3}[:=]\s{0,3}["']?)(?P<secret>(?=[A-Za-z0-9+/_.\-]{8})(?:[A-Za-z0-9+/_.]++|-(?!----BEGIN ))++)"""
        r"|\b(?P<key>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})\b"
    ),
    "email": re.compile(r"(?<![\w.+-])[\w.+-]++@(?:[\w-]++\.)+[^\W\d_]{2,}+\b"),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    "ipv6": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\w)"),
    "card": re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w])"),
    "nid": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "passport": re.compile(r"(?i:\bpassport\b(?:\s{1,3}(?:no|nr|number)\b)?\.?\s{0,3}[:#]?\s{0,3})(?P<number>(?=[A-Z]{0,9}\d)[A-Z0-9]{6,9})\b"),
    "phone": re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w]|[.,]\d)|(?<![\w.])\+\d{8,15}(?!\w)"),
    "name": re.compile(
        rf"\b(?:(?P<title>{_TITLE})\.?|(?P<loud>{_LOUD})(?= (?:[^\W\d_]\. )?{_PARTS}(?:{_CAPITAL}|['’-]){{2,}}\b)) (?P<name>(?:[^\W\d_]\. )?{_PARTS}{_CAP}(?:(?: [^\W\d_]\.)? {_PARTS}{_CAP})?)"
    ),
}
#: What a text must hold for a kind to be worth a search.
_HINT = {"private_key": re.compile("PRIVATE KEY"), "email": re.compile("@"), "passport": re.compile("(?i:passport)"), "name": re.compile(f"{_TITLE}|{_LOUD}")}
_WORD = re.compile(rf"\b(?:[^\W\d_]['’])?[^\W\d_]+(?:-{_CAPITAL}[^\W\d_]+)?")
_BETWEEN = re.compile(rf"\s{{1,4}}(?:(?:[^\W\d_]\.|{'|'.join(sorted(_SMALL))})\s{{1,4}}){{0,4}}")
_SPACED = re.compile(r"(\s+)")
_DATE = re.compile(r"(?:19|20)\d\d[.-]\d\d[.-]\d\d(?!\d)|\d\d[.-]\d\d[.-](?:19|20)\d\d(?!\d)")
_INITIAL = re.compile(r"[^\W\d_]\.")
_MARK = re.compile(r"(?:AKIA|gh[pousr]_|sk-|xox[abprs]-)?")
_DIGITS = re.compile(r"\d")
_FRAME = re.compile(r"(-----[A-Z0-9 ]+-----|\\[nr])")


def _digits(x: str) -> str:
    """The decimal digits of x, of any script, as 0 to 9."""
    return "".join(str(unicodedata.decimal(c)) for c in x if c.isdecimal())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _core(words: list[str]) -> list[bool]:
    """Which words of a name get surrogates: not initials and particles, but the last in any case."""
    return [i == len(words) - 1 or not (_INITIAL.fullmatch(w) or w in _SMALL) for i, w in enumerate(words)]


def _lower(name: str) -> str:
    return name.lower().replace("’", "'")


def _national(x: str) -> str:
    """The digits of a phone number without country code and trunk zero."""
    form = _digits(x)
    abroad = x.startswith("+") or form.startswith("00")
    if abroad:
        form = form.removeprefix("00") if not x.startswith("+") else form
        form = form[1 if form[0] in "17" else 2 if form[:2] in CODES else 3 :]
    return form.removeprefix("0")


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of each entity, in order, without overlaps. The form of a name is gender:given|surname, in
    lower case, with |given behind it where the given name stands alone; either may be empty."""
    found, people = [], {}
    digits = _DIGITS.search(text) is not None
    for rank, (kind, pattern) in enumerate(_FIND.items()):
        if kind in _HINT and not _HINT[kind].search(text) or kind in ("iban", "ip", "ipv6", "card", "nid", "passport", "phone") and not digits:
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            x = m[0]
            if kind == "private_key":
                if sum(map(str.isalnum, _FRAME.sub("", x))) < 16:  # a frame without a key
                    continue
                form = x
            elif kind == "secret":
                a, b = m.span("secret") if m["secret"] else m.span("key")
                x = text[a:b]
                if m["secret"] and not (_DIGITS.search(x) or len(x) >= 16 and any(map(str.isalnum, x))):
                    continue
                form = x
            elif kind == "email":
                form = x.lower()
            elif kind == "iban":
                form = x.replace(" ", "")
                if not 15 <= len(form) <= 34 or int("".join(str(int(c, 36)) for c in form[4:] + form[:4])) % 97 != 1:
                    continue
            elif kind == "card":
                form = _digits(x)
                if not luhn(form) and not (len(form) == 16 and form[0] in "3456"):
                    continue
            elif kind == "phone":
                n = len(_digits(x))
                form = _national(x)
                trunk = x[0] == "0" and (n > 11 if x[1] == "0" else n == 11)
                if not 9 <= n <= 15 or len(form) < 6 or not (x[0] in "+(" or "(" in x or n == 10 or trunk) or _DATE.match(x):
                    continue
            elif kind == "name":
                a, b = m.span("name")
                words = text[a:b].split(" ")
                core = [_lower(w) for w, own in zip(words, _core(words), strict=True) if own]
                if next(w for w, own in zip(words, _core(words), strict=True) if own)[0].islower():
                    continue
                who = ("|" + core[-1]) if len(core) == 1 else f"{core[0]}|{core[-1]}"
                gender = _GENDER[(m["title"] or m["loud"].rstrip(".")).lower()]
                if people.get(who, "n") == "n":
                    people[who] = gender
                form = who
            elif kind == "ip":
                form = ".".join(str(int(n)) for n in x.split("."))
            elif kind == "ipv6":
                try:
                    form = ipaddress.IPv6Address(x).exploded
                except ValueError:
                    continue
                if sum(map(bool, x.split(":"))) < 3:  # ::1, or names in code
                    continue
            elif kind == "passport":
                a, b = m.span("number")
                form = m["number"]
            else:
                form = _digits(x)
            found.append((a, -b, rank, kind, form))
    if people:
        found += _mentions(text, people, len(_FIND))
        found = [(a, b, rank, kind, f"{people.get(form.removesuffix('|given'), 'n')}:{form}" if kind == "name" else form) for a, b, rank, kind, form in found]
    out, end = [], -1
    for a, b, _, kind, form in sorted(found):
        if a >= end:
            out.append((a, -b, kind, form))
            end = -b
    return out


def _mentions(text: str, people: dict[str, str], rank: int) -> Iterator[tuple[int, int, int, str, str]]:
    """Where full names of people, or their surnames or given names, stand without a title."""
    known, last = {}, set()
    for who in people:
        given, _, surname = who.partition("|")
        last.add(surname)
        if given:
            known.setdefault(given, []).append(surname)
    # A given name alone is that of the first person whose gender is told, else of the first.
    alone = {given: min(surnames, key=lambda s: people[f"{given}|{s}"] == "n") for given, surnames in known.items()}
    for m in _WORD.finditer(text):
        word = _lower(m[0])
        if word in known:
            gap = _BETWEEN.match(text, m.end())
            then = gap and _WORD.match(text, gap.end())
            if then and _lower(then[0]) in known[word]:
                yield m.start(), -then.end(), rank, "name", f"{word}|{_lower(then[0])}"
        if len(word) > 2 and not m[0][0].islower():
            if word in last:
                yield m.start(), -m.end(), rank, "name", f"|{word}"
            elif word in known:
                yield m.start(), -m.end(), rank, "name", f"{word}|{alone[word]}|given"


def parts(kind: str, form: str, known: dict[tuple[str, str], int] | None = None) -> list[tuple[str, str]]:
    """What gets a surrogate of its own: the entity, or the words of a name. known: ("who", given|surname) is 1 or 2 where other texts tell a man or a woman."""
    if kind != "name":
        return [(kind, form)]
    gender, _, who = form.partition(":")
    given, surname, *alone = who.split("|")
    if gender == "n" and known:
        gender = "nmf"[known.get(("who", f"{given}|{surname}"), 0)]
    return [("given", f"{gender}:{given}")] * (given != "") + [("surname", surname)] * (not alone)


def needs(kind: str, form: str) -> set[tuple[str, str]]:
    """All that ``replace`` may ask about an entity."""
    out = {*parts(kind, form), ("permuted", kind)}
    if kind == "name" and form.startswith("n:"):
        given, surname = form[2:].split("|")[:2]
        out |= {("who", f"{given}|{surname}"), ("given", f"m:{given}"), ("given", f"f:{given}")}
    return out


class _Stream:
    """Pseudo-random numbers under a key for one entity and try."""

    def __init__(self, key: bytes, *what: str) -> None:
        self.key, self.what, self.count, self.pool = key, "\0".join(what).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hmac.new(self.key, self.what + b"\0%d" % self.count, hashlib.sha256).digest()
            self.count += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n


@lru_cache(maxsize=4096)
def _letters(page: int, script: str, category: str) -> tuple[str, ...]:
    """Letters of a script and category among the 256 code points of a page, without marks where there are enough."""
    found = [c for c in map(chr, range(page << 8, (page + 1) << 8)) if unicodedata.category(c) == category and unicodedata.name(c, "").split(" ")[0] == script]
    plain = [c for c in found if not re.search(r" (?:WITH|SYMBOL|LETTER FINAL|FORM)", unicodedata.name(c)) and unicodedata.normalize("NFKC", c) == c]
    return tuple(plain if len(plain) > 4 else found)


def _letter(c: str, stream: _Stream) -> str:
    """A letter of the same script and case."""
    if c < "\u0250":
        return chr((65 if c.isupper() else 97) + stream.below(26))
    if "\u0400" <= c <= "\u04ff":
        return chr((0x410 if c.isupper() else 0x430) + stream.below(32))
    if "\u0370" <= c <= "\u03ff":
        new = "αβγδεζηθικλμνξοπρστυφχψω"[stream.below(24)]
        return new.upper() if c.isupper() else new
    among = _letters(ord(c) >> 8, unicodedata.name(c, "").split(" ")[0], unicodedata.category(c))
    return among[stream.below(len(among))] if among else c


def _like(x: str, stream: _Stream, hexadecimal: bool = False) -> str:
    """Another string of the same shape: digits for digits and letters for letters, of the same script and case."""
    out = []
    for c in x:
        if hexadecimal and c in "0123456789abcdef":
            out.append("0123456789abcdef"[stream.below(16)])
        elif c.isdecimal():
            out.append(chr(ord(c) - unicodedata.decimal(c) + stream.below(10)))
        else:
            out.append(_letter(c, stream) if c.isalpha() else c)
    return "".join(out)


def _script(x: str) -> str | None:
    """The script of a name that has syllables here."""
    c = next((c for c in x if c.isalpha()), "a")
    return "latin" if c < "\u0250" or "\u1e00" <= c <= "\u1eff" else "cyrillic" if "\u0400" <= c <= "\u04ff" else None


def _name(form: str, stream: _Stream, role: str, attempt: int) -> str:
    """A name, in lower case, in the script of form. role: a gender, or last."""
    pick = lambda among: among[stream.below(len(among))]
    script = _script(form)
    if script is None:  # of other scripts, as many letters; later tries have more
        return _like(form + form[-1] * max(0, attempt - 2), stream)
    if role in NAMES[script] and not attempt:
        return pick(NAMES[script][role]).lower()
    onsets, vowels, endings = SYLLABLES[script]
    made = "".join(pick(onsets) + pick(vowels) for _ in range(2 + attempt // 3)) + pick(onsets) + pick(endings[role])
    if script == "cyrillic" and role == "last" and form[-1] in "ая":
        made = made[:-2] + "ая" if made.endswith("ий") else made + "а"
    return made


def _walk(x: int, n: int, key: bytes, what: str, back: bool = False) -> int:
    """A keyed permutation of 0..n-1, or its inverse: eight rounds of a Feistel network, walked on while beyond n."""
    side = isqrt(n - 1) + 1
    part = lambda i, y: int.from_bytes(hmac.new(key, f"{what}\0{i}\0{y}".encode(), hashlib.sha256).digest()[:16], "big") % side
    while True:
        a, b = divmod(x, side)
        for i in reversed(range(8)) if back else range(8):
            a, b = ((b - part(i, a)) % side, a) if back else (b, (a + part(i, b)) % side)
        x = a * side + b
        if x < n:
            return x


def permuted(kind: str, form: str, key: bytes) -> str:
    """Another number of the same format, by a keyed permutation of all of that format without fixed points: two never get the same."""
    if kind == "ip":
        octets = form.split(".")
        private = octets[0] in ("10", "127")
        first = [o for o in range(256) if o not in (10, 127)]
        digits = [*([] if private else [first.index(int(octets[0]))]), *map(int, octets[1:])]
        radices = [256] * 3 if private else [len(first), *[256] * 3]
        new = _shuffled(digits, radices, key, f"ip {octets[0] if private else ''}")
        return ".".join(map(str, [octets[0], *new] if private else [first[new[0]], *new[1:]]))
    if kind == "card":
        good = lambda body: next(d for d in range(10) if luhn(f"{body}{d}"))
        body = form[0] + _reshaped("card " + form[0], form[1:-1], key)
        return f"{body}{(int(form[-1]) - good(form[:-1]) + good(body)) % 10}"
    if kind == "iban":
        body = _reshaped("iban " + form[:2], form[4:], key)
        return f"{form[:2]}{98 - int(''.join(str(int(c, 36)) for c in f'{body}{form[:2]}00')) % 97:02d}{body}"
    return _reshaped(kind, form, key, kind == "phone" and form[0] != "0")


def _shuffled(digits: list[int], radices: list[int], key: bytes, what: str) -> list[int]:
    """Digits of mixed radices under the permutation: one step along a keyed cycle of all numbers."""
    n, x = prod(radices), 0
    for d, r in zip(digits, radices, strict=True):
        x = x * r + d
    x = _walk((_walk(x, n, key, what) + 1) % n, n, key, what, back=True)
    out = []
    for r in reversed(radices):
        x, d = divmod(x, r)
        out.append(d)
    return out[::-1]


def _reshaped(what: str, form: str, key: bytes, no_zero: bool = False) -> str:
    """Digits and capitals of form under the permutation of its shape; no_zero: the first digit is not 0, before and after."""
    low = [49 if no_zero and i == 0 else 48 if c.isdigit() else 65 for i, c in enumerate(form)]
    radices = [{48: 10, 49: 9, 65: 26}[x] for x in low]
    new = _shuffled([ord(c) - x for c, x in zip(form, low, strict=True)], radices, key, f"{what} {bytes(low)!r}")
    return "".join(chr(x + d) for x, d in zip(low, new, strict=True))


#: Kinds of a fixed format, which can run out of tries.
FIXED = ("phone", "nid", "card", "iban", "ip", "passport")


def surrogate(kind: str, form: str, attempt: int, key: bytes) -> str:
    """The canonical surrogate of an entity (a part of one, see ``parts``); never the entity itself. attempt: -1 for the permutation of a format."""
    if attempt < 0:
        return permuted(kind, form, key)
    for again in range(MOST_TRIES):
        s = _Stream(key, kind, form, str(attempt), str(again))
        more = "".join(chr(97 + s.below(26)) for _ in range(max(0, attempt - 2, again - 8)))  # later tries are longer
        if kind == "secret":
            mark = _MARK.match(form)[0]  # what tells the kind of a key stays
            out = mark + _like(form[len(mark) :], s, hexadecimal=re.fullmatch("[0-9a-f]+", form) is not None) + more
        elif kind == "private_key":
            out = "".join(x if i % 2 else _like(x, s) for i, x in enumerate(_FRAME.split(form)))  # its first and last line and escaped line ends stay
        elif kind == "email":
            local, _, domain = form.partition("@")
            host, _, top = domain.rpartition(".")
            out = f"{_like(local, s)}{more}@{_like(host, _Stream(key, 'domain', host, str(attempt), str(again)))}.{top}"
        elif kind == "iban":
            body = _like(form[4:], s)
            check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{form[:2]}00")) % 97
            out = f"{form[:2]}{check:02d}{body}"
        elif kind == "ip":
            first = int(form.split(".")[0])
            out = ".".join([str(first if first in (10, 127) else 11 + s.below(100)), *(str(1 + s.below(254)) for _ in range(3))])
        elif kind == "ipv6":
            # Empty groups stay empty and lengths are kept at first; later tries have more to choose from.
            tries, new = max(attempt, again), []
            for g in (g.lstrip("0") for g in form.split(":")[1:]):
                n = "".join("0123456789abcdef"[s.below(16)] for _ in range(len(g) if tries < 3 else 4 if g or tries > 9 else 0))
                new.append((f"1{n[1:]}" if n[:1] == "0" else n).zfill(4))
            out = ":".join([form[:4], *new])
        elif kind == "card":
            body = form[0] + _like(form[1:-1], s)
            good = next(d for d in range(10) if luhn(f"{body}{d}"))
            out = body + str(good if luhn(form) else (good + 1 + s.below(9)) % 10)
        elif kind in ("given", "surname"):
            role, _, own = form.rpartition(":")
            made = _name(own, s, role or "last", max(attempt, again // 4))
            out = f"{role}:{made}" if role else made
        else:
            out = _like(form, s)
            if out[0] == "0" and form[0] != "0":
                out = str(1 + s.below(9)) + out[1:]
        if out != form:
            return out
    raise ValueError(f"no surrogate for an entity of the kind {kind}")


def printed(kind: str, made: str) -> str:
    """A surrogate, or a canonical form, as readers see it but for upper case: genders do not show."""
    return made.rpartition(":")[2] if kind == "given" else made


def render(kind: str, original: str, made: list[str]) -> str:
    """The surrogate, given for each of the entity's parts, in the spelling of the original."""
    if kind == "name":
        rest = iter(made)
        words = _SPACED.split(original)
        for i, own in enumerate(_core(words[::2])):
            if own:
                old, new = words[2 * i], printed("given", next(rest))
                words[2 * i] = new.upper() if len(old) > 1 and old.isupper() else new if old.islower() else new[:1].upper() + new[1:]
        return "".join(words)
    made = made[0]
    if kind == "email":
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, made, strict=True)) if len(original) == len(made) else made
    if kind in ("card", "phone", "nid"):
        digits = iter(_digits(made))
        head = len(_digits(original)) - len(_digits(made))  # a country code that the canonical form leaves out
        out, seen = [], 0
        for c in original:
            if c.isdecimal():
                out.append(c if seen < head else chr(ord(c) - unicodedata.decimal(c) + int(next(digits))))
                seen += 1
            else:
                out.append(c)
        return "".join(out)
    if kind == "ipv6":
        short = str(ipaddress.IPv6Address(made))
        return short.upper() if original.isupper() else short
    if kind == "iban":
        rest = iter(made)
        return "".join(c if c == " " else next(rest) for c in original)
    return made


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            seen = Counter(x[2:] for t in batch.column(0).slice(a, 512).to_pylist() if t for x in find(t))
            if seen:
                kinds, forms = zip(*seen, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(forms), pa.array(seen.values(), pa.int64())], names=["kind", "form", "n"])


def _told(found: DataFrame) -> DataFrame:
    """(given, surname, gender) of full names of open gender whose gender, m or f, other texts tell."""
    who = F.split(F.substring("form", 3, 1 << 30), r"\|")
    names = found.where("kind = 'name'").select(F.substring("form", 1, 1).alias("gender"), who[0].alias("given"), who[1].alias("surname"), "n").where("given <> ''")
    count = names.groupBy("given", "surname").agg(*(F.sum(F.when(F.col("gender") == g, F.col("n")).otherwise(0)).alias(g) for g in "mfn"))
    more = lambda a, b: F.when(F.col(a) > F.col(b), "m").when(F.col(a) < F.col(b), "f")
    by_given = count.groupBy("given").agg(F.sum("m").alias("ms"), F.sum("f").alias("fs")).where("ms <> fs")
    return count.where("n > 0").join(by_given, "given", "left").select("given", "surname", F.coalesce(more("m", "f"), more("ms", "fs")).alias("gender")).where("gender is not null")


def _parted(found: DataFrame, told: DataFrame) -> DataFrame:
    """(kind, form) of the distinct parts of entities, names of open gender with what other texts tell."""
    who = F.split(F.substring("form", 3, 1 << 30), r"\|")
    names = found.where("kind = 'name'").select(F.substring("form", 1, 1).alias("own"), who[0].alias("given"), who[1].alias("surname"), (F.size(who) > 2).alias("alone"))
    gender = F.when(F.col("own") == "n", F.coalesce("gender", "own")).otherwise(F.col("own"))
    given = names.where("given <> ''").join(told, ["given", "surname"], "left").select(F.lit("given").alias("kind"), F.concat(gender, F.lit(":"), "given").alias("form"))
    surname = names.where(~F.col("alone")).select(F.lit("surname").alias("kind"), F.col("surname").alias("form"))
    return found.where("kind <> 'name'").select("kind", "form").unionByName(given).unionByName(surname).distinct()


def retried(texts: DataFrame, work: Scratch, key: bytes) -> DataFrame:
    """(kind, form, attempt) of the entities whose first surrogate collided, 1 or 2 as the attempt of ("who", given|surname) where other texts tell
    a man or a woman, and 1 as that of ("permuted", kind) for kinds that ran out of tries; texts: one column."""

    def surrogates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            shown = [printed(k, surrogate(k, f, n, key)) for k, f, n in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shown, pa.string())], names=["kind", "form", "attempt", "shown"])

    def tried(entities: DataFrame) -> DataFrame:
        return entities.select("kind", "form", "attempt").mapInArrow(thrifty(surrogates), "kind string, form string, attempt int, shown string")

    found = work.table(texts.mapInArrow(thrifty(_entities), "kind string, form string, n long").groupBy("kind", "form").agg(F.sum("n").alias("n")), "found")
    told = work.table(_told(found), "told")
    who = told.select(F.lit("who").alias("kind"), F.concat("given", F.lit("|"), "surname").alias("form"), F.when(F.col("gender") == "m", 1).otherwise(2).alias("attempt"))
    known = work.table(_parted(found, told), "entities")
    # Given names of either gender are one and the same to a reader.
    taken = known.select("kind", F.when(F.col("kind") == "given", F.substring("form", 3, 1 << 30)).otherwise(F.col("form")).alias("shown")).distinct()
    current = work.table(tried(known.withColumn("attempt", F.lit(0))), "surrogates")
    for attempt in range(1, MOST_TRIES + 1):
        # Each surrogate goes to the one that has had it longest: rows of a new try have a greater attempt than all others.
        first = current.groupBy("kind", "shown").agg(F.min(F.struct("attempt", "form")).alias("w")).select("kind", "shown", "w.form")
        good = work.table(first.join(taken, ["kind", "shown"], "left_anti").select("kind", "form"), "settled")
        again = work.table(current.join(good, ["kind", "form"], "left_anti").select("kind", "form", F.lit(attempt).alias("attempt")), "again")
        if again.isEmpty():
            return current.where("attempt > 0").select("kind", "form", "attempt").unionByName(who)
        if attempt < MOST_TRIES:
            current = work.table(current.join(good, ["kind", "form"], "left_semi").unionByName(tried(again)), "surrogates")
    kinds = sorted(r["kind"] for r in again.select("kind").distinct().collect())
    if open_ended := [k for k in kinds if k not in FIXED]:
        raise ValueError(f"after {MOST_TRIES} tries, entities of these kinds have no surrogate of their own: {', '.join(open_ended)}")
    full = texts.sparkSession.createDataFrame([("permuted", k, 1) for k in kinds], "kind string, form string, attempt int")
    return current.where((F.col("attempt") > 0) & ~F.col("kind").isin(kinds)).select("kind", "form", "attempt").unionByName(who).unionByName(full)


def replace(text: str, attempts: dict[tuple[str, str], int], key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with surrogates, and (kind, start, end) of each in the result."""
    out, at, size, spans = [], 0, 0, []
    for a, b, kind, form in find(text):
        whole = ("permuted", kind) in attempts
        new = render(kind, text[a:b], [surrogate(*p, -1 if whole else attempts.get(p, 0), key) for p in parts(kind, form, attempts)])
        out += [text[at:a], new]
        size += a - at
        spans.append((kind, size, size + len(new)))
        size += len(new)
        at = b
    return "".join([*out, text[at:]]), spans


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def pseudonymize(df: DataFrame, key: bytes, text: str = "text", spans: str = "pii") -> DataFrame:
    """df with surrogates under the key in its text, and the column spans: kind, start and end of each in the new text.
    Whoever has the key can tell which surrogate belongs to a known entity: keep it apart from the result."""
    if not key:
        raise ValueError("surrogates need a key")
    work = Scratch(df.sparkSession, "pii")
    df = df.drop(spans)
    retry = work.table(retried(df.select(F.col(text).alias("text")), work, key), "retried")
    few = retry.limit(MOST_RETRIED + 1).collect()
    schema = T.StructType([*df.schema.fields, T.StructField(spans, _SPANS)])
    shared, tries = None, unused(df, "tries")
    if len(few) <= MOST_RETRIED:
        shared = df.sparkSession.sparkContext.broadcast({(r["kind"], r["form"]): r["attempt"] for r in few})
    else:
        # Too many for a broadcast: each text gets the retried entities that it holds.
        def mentions(batches):
            for batch in batches:
                found = [(h, *p) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for p in {p for x in find(t) for p in needs(*x[2:])}]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))], names=["hash", "kind", "form"])

        hashed = unused(df, "hash")
        df = df.withColumn(hashed, F.xxhash64(F.col(text)))
        held = df.select(F.col(hashed).alias("hash"), F.col(text).alias("text")).mapInArrow(thrifty(mentions), "hash long, kind string, form string").distinct().join(retry, ["kind", "form"])
        extra = held.groupBy(F.col("hash").alias(hashed)).agg(F.collect_list(F.struct("kind", "form", "attempt")).alias(tries))
        df = df.join(extra, hashed, "left").drop(hashed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempts = shared.value if shared is not None else {}
        for batch in batches:
            names = batch.schema.names
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = part.column(names.index(tries)).to_pylist() if tries in names else None
                out = []
                for k, t in enumerate(part.column(names.index(text)).to_pylist()):
                    if rows is not None:
                        attempts = {(r["kind"], r["form"]): r["attempt"] for r in rows[k] or []}
                    out.append(replace(t, attempts, key) if t else (t, []))
                columns = [pa.array([o[0] for o in out], pa.string()) if n == text else part.column(j) for j, n in enumerate(names) if n != tries]
                columns.append(pa.array([[{"kind": k, "start": x, "end": y} for k, x, y in o[1]] for o in out], _ARROW_SPANS))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(thrifty(run), schema)
