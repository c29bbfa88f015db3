"""Problem 2: personal information in free text, found and replaced.

Weak supervision in four steps:

1. Candidate spans.  Loose patterns (mail addresses, digit groups, labelled
   numbers, streets) and name runs (gazetteer hits, or words in the place of a
   name).  Every labeler - pattern, gazetteer or context - votes on each span by
   firing or not; the votes are a bit pattern.
2. Counts of vote patterns over all spans, by kind; at most 2**bits rows each.
3. Expectation-maximisation per kind, on those counts: the rate at which each
   labeler fires on true and on false spans, and the share of true spans.
4. A span classifier (logistic regression on hashed features: votes, shape,
   words around) trained on a bounded sample of spans with the posteriors as
   soft labels; it decides about all spans, evaluated as a plain expression.

The gazetteer is learnt from the person columns of all rows: senders whose
mail address contains their name, and persons of outreach.  Its size is bounded
by ``GAZETTEER_MOST`` (the most frequent tokens); a name outside it is still
found behind a greeting, a form of address or a closing, and as the surname of
a known first name.

Defined results: null and empty texts have no items; overlapping candidates
are resolved in favour of the longer, better supported one; repeated rows of a
message give one answer per item; positions count code points.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from missive.runtime import durable

GAZETTEER_MOST = 200_000
#: Spans wanted in the sample that trains the span classifier, shared evenly by the kinds; its bound is twice that.
TRAINING_SPANS = 8_000
DIMENSIONS = 4096
KINDS = ("email", "phone", "id_number", "address", "name")

# Forms of address, greetings, words around names, parts of addresses and labels.
HONORIFICS = tuple("Mr Mrs Ms Miss Mx Dr Prof Sir Herr Frau Hr Fr Mme Mlle Monsieur Madame Señor Señora Sr Sra Don Doña".split())
GREETINGS = (
    "dear", "hello", "hi", "hey", "good morning", "good afternoon", "good evening", "good day", "hallo", "liebe", "lieber", "guten tag",
    "guten morgen", "bonjour", "cher", "chère", "hola", "estimado", "estimada", "buenos días", "greetings",
)
CLOSINGS = tuple("regards wishes thanks cheers best sincerely br grüße gruß grüßen cordialement saludos atentamente".split())
PHONE_CUES = (
    "phone", "tel", "mobile", "cell", "call", "call you", "direct", "line is", "number is", "number", "text me", "desk has", "fax", "handy",
    "telefon", "tél", "móvil", "whatsapp", "☎", "ring", "dial", "from", "on", "at",
)
CODE_CUES = (
    "ticket", "code", "build", "badge", "case", "file", "order", "invoice", "version", "no.", "id", "ssn", "license", "licence", "passport",
    "budget", "room", "floor", "salary", "$", "€", "£", "#", "digest", "ray", "number stays", "account", "iban", "security number",
)
LEFT_CUE = frozenset(
    "dear hello hi hey morning afternoon evening day hallo liebe lieber bonjour hola estimado estimada from to von an de cc by with for quoting "
    "speaker colleague contact meet meeting referees such as ask spoke and is le el am on pm recruiter manager um at board "
    "attn signed sincerely regards thanks cheers best wishes br called named name person candidate interviewer und et y mit con avec".split()
)
RIGHT_CUE = (
    r"(?:wrote|writes|said|schrieb|escribió|a|and|leads|lead|explains|is|will|would|in|has|from|asks|asked|proposes|wants|offers|sends|invites|"
    r"worked|called|confirms|still|at|or|um|to|on|und|et|y|about|you|instead|can)"
)
STREET = (
    r"(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Boulevard|Blvd\.?|Lane|Ln\.?|Way|Court|Ct\.?|Drive|Dr\.?|Row|Place|Pl\.?|Terrace|Square|Sq\.?|"
    r"Parkway|Pkwy|Circle|Crescent|Close|Highway|Hwy|Alley|Quay|Walk|Grove|Hill|Park|Mews)"
)
ORG_WORDS = set(
    "systems group holdings capital health energy robotics insurance logistics networks partners software services technologies "
    "analytics aerospace biotech education freight foods retail consulting laboratories materials manufacturing mobility media "
    "security international associates inc llc ltd gmbh corp plc co company careers jobs alerts alert news newsletter team street avenue road lane way "
    "court drive row blvd boulevard place suite apt box engineer developer analyst scientist manager architect".split()
)
ID_LABEL = (
    r"(?:SSN|social security(?: number| no\.?)?|tax (?:id|number|no\.?|identification number)|NI (?:number|no\.?)|NINO|"
    r"national insurance(?: number| no\.?)?|passport(?: number| no\.?| #)?|driver(?:'?s)? licen[cs]e(?: number| no\.?)?|driving licen[cs]e(?: number| no\.?)?|"
    r"national id(?:entity)?(?: card)?(?: number| no\.?)?|id card(?: number| no\.?)?|identity (?:card|number|no\.?)(?: number| no\.?)?|"
    r"personal (?:id|number|identity number)|steuer-?id(?:entifikationsnummer)?|ausweisnummer|personalausweis(?:nummer)?|"
    r"reisepass(?:nummer)?|numéro de sécurité sociale|passeport|pasaporte|DNI|NIE|NIF)"
).replace(" ", r"\s+")

# Lower-case words one of which each match holds: at the start of a label
# (those of several words before white space), and in addresses, by pattern, before
# white space, before white space and a digit, or anywhere.  None stands for any text.
ID_HINTS = (
    "ssn", "social ", "tax ", "ni ", "nino", "national ", "passport", "driver", "driving ", "id ", "identity ", "personal ", "steuer",
    "ausweis", "personalausweis", "reisepass", "numéro ", "passeport", "pasaporte", "dni", "nie", "nif",
)
ADDRESS_HINTS = (
    None,
    tuple(f"{w}0" for w in ("allee", "straße", "strasse", "weg", "gasse", "platz", "ring", "damm", "ufer", "str.")),
    ("box", "postfach", "apartado"),
    ("rue ", "avenue ", "boulevard ", "place ", "chemin ", "calle ", "plaza "), ("calle ", "avenida ", "plaza "),
)

#: What a word found by the automaton may be.
NAME, OPENER, LABEL, ADDRESS = 1, 2, 4, 8

Span = tuple[str, int, int, int, tuple[int, ...]]  # kind, start, end, votes, features


def fold(word: str) -> str:
    """Lower case without accents."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def lower(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


#: What may stand between a cue and a name.
_BETWEEN = " \t\r\n\f\v\u00a0.,:>|»*\"(!-"


def backwards(words: tuple[str, ...]) -> str:
    """A pattern of one of ``words`` read from its end."""
    return "|".join(re.escape(w[::-1]) for w in words)


@lru_cache(maxsize=1)
def _p() -> dict:
    c = re.compile
    honorific = rf"\s+\.?(?:{backwards(HONORIFICS)})"
    dash = r"[\-‑–]"
    unit = r"(?:,?\s+(?:Apt\.?|Apartment|Suite|Unit|Ste\.?|Flat|Floor)\s*#?\w+|,?\s*#\s?\w+)?"
    town = r"[A-ZÄÖÜÉ][\w'’\-]+(?: [A-ZÄÖÜÉ][\w'’\-]+){0,2}"
    code = r"(?:,?\s+[A-Z]{2},?\s+\d{5}(?:-\d{4})?|,?\s+[A-Z]{1,2}\d[\dA-Z]?\s?\d[A-Z]{2})"
    return {
        # What stands before a place is matched on the reversed text, so that the matcher starts at that place alone.
        "mailbox": c(r"\n?([\w.+\-]+)"),
        "domain": c(r"[\w\-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[\w\-]+)+", re.I),
        "url": c(r"https?://\S+|www\.\S+"),
        "phone": c(
            rf"[+(\d](?<![\w.#/\-‑][+(\d])(?:(?<=\+)\s?\(?\d|(?<=\()\d|(?<=\d))(?:[ .()/]|\r?\n|{dash}|\d){{5,20}}\d(?:\s*(?:ext\.?|x|Durchwahl|poste)\s*\d{{1,5}})?(?![\w])"
        ),
        "phone_strict": c(
            rf"^(?:\+\d{{1,3}}[ .\-]?(?:\(0\)\s?)?(?:\(?\d{{1,4}}\)?(?:[ .‑–\-]|(?=\d)))(?:\d[ .‑–\-]?){{5,11}}|(?:1[ .\-])?\(?\d{{3}}\)?[ ./‑–\-]?\d{{3}}[ .‑–\-]?\d{{4}}|"
            r"0\d{2,5}[ /\-]?\d{3,8}(?:[ \-]?\d{2,4})?|0\d(?:[ .]\d\d){4})(?:\s*(?:ext\.?|x)\s*\d{1,5})?$"
        ),
        "phone_cue": c(rf"(?i)\n?\W{{0,4}}(?:{backwards(PHONE_CUES)}|[mt]\b)"),
        "code_cue": c(rf"(?i)\n?\W{{0,3}}(?:{backwards(CODE_CUES)}|\w*(?:fer|qer))"),
        "date": c(r"^\d{4}-\d{1,2}-\d{1,2}|^\d{1,2}/\d{1,2}/\d{2,4}\b|^\d{1,2}\.\d{1,2}\.\d{2,4}\b|^\d{1,2}-\d{1,2}-\d{4}$"),
        "id": c(rf"(?i:(?<!\w){ID_LABEL})\s*(?:is|:|no\.?|number|nr\.?|#|-)?\s*:?\s*([A-Za-z0-9](?:(?:[ \-]|\r?\n)?[A-Za-z0-9]){{4,17}})(?!\w)"),
        "id_shape": c(
            r"^(?:\d{3}[\s\-]{0,2}\d{2}[\s\-]{0,2}\d{4}|[A-Z]{2}\s{0,2}\d\d\s{0,2}\d\d\s{0,2}\d\d\s{0,2}[A-Z]|[A-Z]{1,2}\d{6,9}|\d{9,11}|(?:\d{4}[\s\-]{0,2}){2,3}\d{4}|[A-Z]\d?-\d{3}-\d{3,4}|"
            r"\d{8}[A-Z]|[A-Z]\d{7}[A-Z]|[A-Z0-9]{8,10})"
        ),
        "ssn": c(r"\d{3}-\d{2}-\d{4}"),
        "addresses": [
            c(rf"\d(?<![\w#\-]\d)\d{{0,4}}[A-Za-z]?\s+(?:[A-Z][\w'’\-]+\s+){{1,3}}{STREET}(?!\w){unit}(?:,?\s+{town}{code})?"),
            c(rf"(?<![\w\-])(?:[A-ZÄÖÜ][\w\-]*(?:allee|straße|strasse|weg|gasse|platz|ring|damm|ufer|str\.)|(?:[A-Z][\w\-]+ )(?:Straße|Allee|Platz|Weg))\s+\d{{1,4}}\s?[a-z]?(?:,?\s+\d{{5}}\s+{town})?"),
            c(rf"(?<!\w)(?:P\.?\s?O\.?\s?Box|Postfach|Apartado)\s+\d+(?:,?\s+{town}{code})?"),
            c(rf"(?<!\w)\d{{1,4}}(?: ?bis)?,?\s+(?:rue|avenue|boulevard|place|chemin|calle|plaza)\s+(?:[\w'’\-]+\s?){{1,4}},?\s+\d{{5}}\s+{town}"),
            c(rf"(?<!\w)(?:Calle|Avenida|Plaza)\s+(?:[\w'’\-]+\s?){{1,4}},?\s*\d{{1,4}},?\s+\d{{5}}\s+{town}"),
        ],
        "then_number": c(r"\s+\d"),
        "year": c(r"\d{4}-\d"),
        "postcode": c(r"\d{5}\b|[A-Z]{1,2}\d[\dA-Z]?\s?\d[A-Z]{2}$"),
        "split": c(r"[\W\d_]+"),
        "ascii": c(r"[a-z]{3,}"),
        "skip": c(r"[\s.,!>|»*\-–_~]*"),
        "digit": c(r"\d"),
        # Where phones and the first kind of addresses have their first digit.  A charset first
        # and the look-behind after it: the matcher skips faster.
        "number": c(r"\d(?<![\w#\-]\d)"),
        "capital": c(r"[A-ZÀ-ÖØ-ÞŠŽŁĐ](?<![^\W_].)[^\W\d_]*(?:['’\-][^\W\d_]+)*"),
        "right_cue": c(rf"(?i)^[\s,]*(?:<|\(chair|{RIGHT_CUE}\b)"),
        "honorific": c(rf"{honorific}(?!\w)"),
        "greeting": c(rf"(?i)(?:{honorific})?\s+(?:{backwards(GREETINGS)})(?!\w)"),
        "closing": c(rf"(?i)(?:\s*;tg&)*[\s>|»]*\n[\s,!.\-–>|»]*(?:{backwards(CLOSINGS)}|--\Z|__|~~)"),
        "cue": c(rf"[{re.escape(_BETWEEN)}]*(\w*)"),
        "attribution": c(r"(?i)^\s*(?:<[^>\n]*>|wrote|said|schrieb|escribió|a écrit)|^:\s*\n"),
    }


_SHAPES = {c: "0" if chr(c).isdigit() else "A" if chr(c).isupper() else "a" for c in range(0x250) if chr(c).isalnum()}
#: Accents taken off, letter by letter; case and length stay.
_ACCENTS = {c: p for c in range(0xC0, 0x180) if len(p := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) == 1 and p != chr(c)}
_REPEAT = re.compile(r"(.)\1+")
# Last words of what stands before a name.
NAME_OPENERS = frozenset(
    "dear hello hi hey morning afternoon evening day hallo liebe lieber tag morgen bonjour cher chère hola estimado estimada días greetings "
    "mr mrs ms miss mx dr prof sir herr frau hr fr mme mlle monsieur madame señor señora sr sra don doña "
    "regards wishes thanks cheers best sincerely br grüße gruß grüßen cordialement saludos atentamente".split()
)


@lru_cache(maxsize=100_000)
def _hashed(feature: str) -> int:
    return zlib.crc32(feature.encode()) % DIMENSIONS


_known: dict[tuple, tuple[int, ...]] = {}
_shapes: dict[str, str] = {}


@lru_cache(maxsize=10_000)
def _voted(kind: str, votes: int) -> tuple[int, ...]:
    return tuple(map(_hashed, [f"{kind}|bias", *(f"{kind}|v{i}" for i in range(10) if votes >> i & 1)]))


def _shape(part: str) -> str:
    """Letters and digits by their sort, repetitions left out."""
    sorts = part.translate(_SHAPES)
    shape = _shapes.get(sorts)
    if shape is None:
        if len(_shapes) > 200_000:
            _shapes.clear()
        shape = _shapes[sorts] = _REPEAT.sub(r"\1", sorts)
    return shape


def _features(kind: str, votes: int, text: str, a: int, b: int) -> tuple[int, ...]:
    """Hashed features of a span: its votes, its shape, the words beside it, its length."""
    left = text[a - 16 if a > 16 else 0 : a].rsplit(None, 1)
    right = text[b : b + 16].split(None, 1)
    if kind == "name":
        shape = "l" if text[a].islower() else "U" if text[a:b].isupper() else "T"
    else:
        shape = _shape(text[a : min(b, a + 40)])
    before, after, size = left[-1] if left else "^", right[0] if right else "$", min((b - a) // 4, 8)
    key = (kind, votes, shape, before, after, size)
    found = _known.get(key)
    if found is None:
        if len(_known) > 200_000:
            _known.clear()
        found = _known[key] = (
            *_voted(kind, votes), _hashed(f"{kind}|s|{shape}"), _hashed(f"{kind}|l|{before.lower()}"), _hashed(f"{kind}|r|{after.lower()}"),
            _hashed(f"{kind}|n|{size}"),
        )
    return found


def _matches(pattern: re.Pattern, text: str, starts: Iterable[int]) -> Iterator[re.Match]:
    """Matches of a pattern one after the other, where all places at which it can start are known."""
    end = 0
    for at in starts:
        if at >= end and (m := pattern.match(text, at)):
            end = m.end()
            yield m


def _openings(text: str, numbers: list[int]) -> Iterator[int]:
    """Places of numbers and of the ``+`` and ``(`` before them, in order."""
    for at in numbers:
        before = text[at - 1] if at else ""
        if before == "(":
            if "+" in text[max(0, at - 3) : at - 1]:
                yield from (x for x in (at - 3, at - 2) if x >= 0 and text[x] == "+")
            yield at - 1
        elif before == "+":
            yield at - 1
        elif at > 1 and text[at - 2] == "+":
            yield at - 2
        yield at


def _digits(text: str) -> int:
    return sum(map(str.isdigit, text))


class Labeler:
    """Candidate spans with their votes; one per Python worker."""

    def __init__(self, first: frozenset[str], last: frozenset[str]):
        self.first, self.last = first, last
        self.known: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        # What a hit may be, as bits: a name, what stands before a name, the start of an id's label, a part
        # of an address by pattern.  A hint's last blank stands for white space, a last 0 for white space and a digit.
        uses: dict[str, int] = {w: NAME for w in {*first, *last} if len(w) > 2}
        hints = [(w, OPENER) for w in (*NAME_OPENERS, "--", "__", "~~")] + [(w, LABEL) for w in ID_HINTS]
        hints += [(w, ADDRESS << n) for n, words in enumerate(ADDRESS_HINTS) for w in words or ()]
        endings: dict[str, list[tuple[int, str]]] = {}
        for hint, use in hints:
            word, then = (hint[:-1], hint[-1]) if hint[-1] in " 0" else (hint, "")
            uses[word] = uses.get(word, 0) | use
            if use >= LABEL:
                endings.setdefault(word, []).append((use, then))
        for word, bits in uses.items():
            self.automaton.add_word(word, (len(word), bits, endings.get(word, ())))
        self.automaton.make_automaton()

    def _hints(self, low: str, hits: list) -> tuple[list[int], int]:
        """(where labels of ids may start, bits of the address patterns that may match)."""
        labels, bits, number = [], 0, _p()["then_number"]
        for end, (length, uses, endings) in hits:
            if uses < LABEL:
                continue
            space = low[end + 1 : end + 2].isspace()
            at = end - length + 1
            inside = at and (low[at - 1].isalnum() or low[at - 1] == "_")
            for use, then in endings:
                if use == LABEL:
                    if not inside and (space or not then):
                        labels.append(at)
                elif not bits & use and (not then or (space and (then == " " or number.match(low, end + 1)))):
                    bits |= use
        return labels, bits

    def _last(self, word: str) -> bool:
        if word in self.last:
            return True
        if not ("-" in word or "'" in word or "’" in word):
            return False
        parts = re.split(r"['’\-]", word)
        return len(parts) > 1 and all(x in self.last or len(x) == 1 for x in parts) and any(len(x) > 1 for x in parts)

    def _class(self, word: str) -> str:
        """F(irst), L(ast), B(oth), C(apitalised, unknown), I(nitial) or X."""
        kind = self.known.get(word)
        if kind is None:
            if len(self.known) > 200_000:
                self.known.clear()
            if len(word) == 1:
                kind = "I" if word.isupper() else "X"
            else:
                w = fold(word)
                f, l = w in self.first or ("-" in w and all(x in self.first for x in w.split("-"))), self._last(w)
                kind = "B" if f and l else "F" if f else "L" if l else "C" if word[0].isupper() and word.lower() not in ORG_WORDS else "X"
            self.known[word] = kind
        return kind

    def spans(self, text: str) -> list[Span]:
        p, out = _p(), []
        taken: list[tuple[int, int]] = []

        def free(a: int, b: int) -> bool:
            for x, y in taken:
                if a < y and x < b:
                    return False
            return True

        def add(kind: str, a: int, b: int, votes: int) -> None:
            out.append((kind, a, b, votes, _features(kind, votes, text, a, b)))
            taken.append((a, b))

        low = lower(text)
        hits = list(self.automaton.iter(low))
        if "@" in text or "at]" in low or "at)" in low:
            for mark in ("@", "[at]", "(at)"):
                at = low.find(mark)
                while at >= 0:
                    left = at - 1 if at and text[at - 1].isspace() else at
                    right = at + len(mark)
                    right += right < len(text) and text[right].isspace()
                    width = 80
                    while (box := p["mailbox"].match(text[max(0, left - width) : left][::-1])) and box.end() == width < left:
                        width *= 4
                    start = left - box.end() if box else left
                    host = p["domain"].match(text, right) if box and text[start] != "." else None
                    if host and free(start, host.end()):
                        add("email", start, host.end(), (mark == "@") | host.group().isascii() << 1 | 4 | (right - left == len(mark)) << 3)
                    at = low.find(mark, at + len(mark))
        if "://" in text or "www." in low:
            taken += [m.span() for m in p["url"].finditer(text) if free(*m.span())]
        numbers = [m.start() for m in p["number"].finditer(text)]
        if numbers or p["digit"].search(text):
            labels, places = self._hints(low, hits)
            for m in (m for at in labels if (m := p["id"].match(text, at))):
                a, b = m.span(1)
                s = m.group(1)
                k = p["id_shape"].match(s)
                if k:
                    b = a + k.end()
                if free(a, b) and _digits(text[a:b]) >= 5:
                    add("id_number", a, b, 1 | (k is not None) << 1 | (_digits(s) >= 6) << 2)
            for n, pattern in enumerate(p["addresses"]):
                if ADDRESS_HINTS[n] and not places & ADDRESS << n:
                    continue
                for m in pattern.finditer(text) if n else _matches(pattern, text, numbers):
                    a, b = m.span()
                    if free(a, b):
                        s = m.group()
                        add("address", a, b, (p["postcode"].search(s) is not None) | (n == 0) << 1 | ("," in s or "\n" in s) << 2 | (b >= len(text) - 2) << 3)
            for m in _matches(p["phone"], text, _openings(text, numbers)):
                a, b = m.span()
                s = m.group()
                if s[0] == "(" and ")" not in s:
                    a, s = a + 1, s[1:]
                if "\n" in s:
                    # Hard-wrapped in the middle, or two numbers on two lines.
                    flat = re.sub(r"\s+", " ", s)
                    if p["phone_strict"].match(flat) and free(a, b):
                        s = flat
                    else:
                        s = s.split("\n")[0].rstrip(" .()/\r-‑–")
                        b = a + len(s)
                digits = _digits(s)
                if not 7 <= digits <= 20 or s.count("(") < s.count(")") or not free(a, b):
                    continue
                if p["ssn"].fullmatch(s):
                    add("id_number", a, b, 0b110)
                    continue
                if p["date"].match(s) or (p["year"].match(s) and "(" not in s):
                    continue
                back = text[max(0, a - 24) : a][::-1]
                votes = (p["phone_strict"].match(s) is not None) | (s[0] in "+(0" or digits in (10, 11)) << 1
                add("phone", a, b, votes | (4 if p["phone_cue"].match(back) else 8 if p["code_cue"].match(back) else 0))
        self._names(text, low, hits, p, taken, add, free)
        return out

    def _names(self, text, low, hits, p, taken, add, free) -> None:
        # Only words at gazetteer or opener hits, and their neighbours, are looked at.
        size, capital = len(text), p["capital"]
        spots: dict[int, int] = {}
        after: list[int] = []
        for end, (length, uses, _) in hits:
            if not uses & (NAME | OPENER):
                continue
            a, b = end - length + 1, end + 1
            if uses & OPENER:
                if not (b < size and low[b].isalnum()) and not (a and low[a - 1].isalnum()):
                    after.append(b)
                if not uses & NAME:
                    continue
            while a and (low[a - 1].isalpha() or low[a - 1] in "'’-"):
                a -= 1
            while b < size and (low[b].isalpha() or (low[b] in "'’-" and low[b + 1 : b + 2].isalpha())):
                b += 1
            if low[a] in "'’-":
                a += 1
            if b - a != length and not ("-" in low[a:b] or "'" in low[a:b] or "’" in low[a:b]):
                continue
            if (a and text[a - 1] in "@._+0123456789" and text[a].islower()) or (b < size and text[b] in "@_+0123456789"):
                continue
            spots[a] = b
        for b in after:
            # What a greeting, form of address or closing phrase opens.
            m = p["skip"].match(text, b)
            w = capital.match(text, m.end())
            if w:
                spots.setdefault(w.start(), w.end())
        if not spots:
            return
        for a, b in list(spots.items()):
            # Initials before, and a capitalised word or initial behind.
            if a > 2 and text[a - 1] == " " and text[a - 2] == "." and text[a - 3].isupper() and not (a > 3 and text[a - 4].isalnum()):
                spots.setdefault(a - 3, a - 2)
            for _ in range(2):
                mark = text[b : b + 1]
                at = b + 1 if mark == " " or mark == "\n" else b + 2 if text[b : b + 2] in (", ", ". ") else size
                w = capital.match(text, at) if text[at : at + 1].isupper() else None
                if not w:
                    break
                at, b = w.span()
                spots.setdefault(at, b)
                b += text[b : b + 1] == "."
        words = [(text[a:b], a, b) for a, b in sorted(spots.items())]
        known = self.known
        kinds = [known.get(w) or self._class(w) for w, _, _ in words]
        marks = sorted(taken)
        if marks:
            k = 0
            for x, (w, a, b) in enumerate(words):
                while k < len(marks) and marks[k][1] <= a:
                    k += 1
                if k == len(marks):
                    break
                if marks[k][0] < b:
                    kinds[x] = "-"
        n, i = len(words), 0
        for x, kind in enumerate(kinds):
            if kind == "I" and text[words[x][2] : words[x][2] + 1] != ".":
                kinds[x] = "X"
            elif kind == "C":
                before = text[max(0, words[x][1] - 14) : words[x][1]].split()
                opener = before[-1].lower().strip(".,!>|»-") if before else ""
                if opener not in NAME_OPENERS and not (before and (before[-1] in ("-", "–", ">", "|", "»") or set(before[-1]) <= set("-_~"))):
                    kinds[x] = "c"
        boxes: list[set[str]] = []

        def locals_() -> set[str]:
            """Words of the mailboxes in the text."""
            if not boxes:
                joint = " ".join([text[a:b].split("@", 1)[0] for a, b in marks])
                if joint.isascii():
                    boxes.append(set(p["ascii"].findall(joint.lower())))
                else:
                    boxes.append({fold(x) for x in p["split"].split(joint) if len(x) > 2})
            return boxes[0]

        def gap(x: int) -> str:
            return text[words[x][2] : words[x + 1][1]]

        def opened(a: int) -> tuple[str, bool, bool]:
            """The last word before a place; whether it ends a greeting or form of address; whether a closing ends there."""
            before = text[max(0, a - 30) : a]
            back = before[::-1]
            cue = p["cue"].match(back)[1][::-1].lower()
            polite = cue in NAME_OPENERS and bool(p["honorific"].match(back) or p["greeting"].match(back))
            return cue, polite, "\n" in before and p["closing"].match(back) is not None

        def joined(x: int) -> bool:
            g = gap(x)
            return g == " " or (kinds[x] == "I" and g in (". ", ".")) or (g in ("\n", "\r\n") and kinds[x] in "FB" and kinds[x + 1] == "L")

        while i < n:
            c = kinds[i]
            if c in "Xc-":
                i += 1
                continue
            (w, a, b), j = words[i], i
            if c in "FLBI":
                while j + 1 < n and kinds[j + 1] in "FLBI" and joined(j) and j - i < 4:
                    j += 1
                # "Last, First"
                if j == i and c in "LB" and j + 1 < n and kinds[j + 1] in "FB" and gap(j) == ", ":
                    j += 1
                # An unknown capitalised word after a first name may be its surname.
                if j == i and c in "FB" and j + 1 < n and kinds[j + 1] in "Cc" and gap(j) == " ":
                    word, follow = words[j + 1][0], words[j + 1][2]
                    if word.lower() not in ORG_WORDS and p["attribution"].match(text[follow : follow + 60]):
                        j += 1
                if c == "I" and not any([kinds[x] in "FLB" for x in range(i, j + 1)]):
                    i += 1
                    continue
            else:
                cue, polite, closing = opened(a)
                if not (polite or closing):
                    i += 1
                    continue
                while j + 1 < n and kinds[j + 1] in "CcFLBI" and joined(j) and j - i < 2 and words[j + 1][0].lower() not in ORG_WORDS:
                    j += 1
                if not polite and text[words[j][2] : words[j][2] + 1] not in ("", "\n", "\r"):
                    i += 1
                    continue
            b = words[j][2]
            run = kinds[i] if j == i else "".join(kinds[i : j + 1])
            if not free(a, b) or (w.islower() and (j == i or "c" in run or "C" in run) and all([words[x][0].islower() for x in range(i, j + 1)])):
                i = j + 1
                continue
            votes = ("F" in run or "B" in run) | ("L" in run or "B" in run) << 1 | (j > i) << 2
            if votes != FULL_NAME:  # else both gazetteers agree: the context labelers aren't asked
                before, after = text[max(0, a - 30) : a], text[b : b + 60]
                if c != "C":
                    cue, polite, closing = opened(a)
                if polite or closing:
                    votes |= 1 << 3
                if cue in LEFT_CUE or before.endswith("\n") or not before.strip():
                    votes |= 1 << 4
                if after[:1] in "\n,.!" or p["right_cue"].match(after) or not after.strip():
                    votes |= 1 << 5
                if marks and not locals_().isdisjoint([fold(words[x][0]) for x in range(i, j + 1)]):
                    votes |= 1 << 6
                if j == i and j + 1 < n and gap(j) in (" ", "\n") and words[j + 1][0].lower() in ORG_WORDS:
                    votes |= 1 << 7
            add("name", a, b, votes)
            i = j + 1


@lru_cache(maxsize=2)
def _labeler(first: frozenset[str], last: frozenset[str]) -> Labeler:
    return Labeler(first, last)


def _ascii_tokens(name: Column) -> Column:
    """Lower-case words of a name."""
    return F.split(F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}'’\-]+", " ")), " ")


def gazetteer(message: DataFrame, outreach: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """First and last names that occur in the person columns of all rows."""
    senders = message.select(F.col("sender").alias("person"), F.lower(F.substring_index("sender_email", "@", 1)).alias("mailbox"))
    persons = outreach.select("person", F.lower(F.substring_index("person_email", "@", 1)).alias("mailbox"))
    people = (
        senders.unionByName(persons).where("person IS NOT NULL").distinct()
        .withColumn("words", F.filter(_ascii_tokens(F.col("person")), lambda w: F.length(w) > 1))
        .where((F.size("words") >= 2) & (F.size("words") <= 4))
        .where(~F.arrays_overlap("words", F.array(*(F.lit(w) for w in sorted(ORG_WORDS)))))
    )
    ascii_ = lambda w: F.translate(w, "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    owns = F.exists("words", lambda w: F.contains(F.regexp_replace("mailbox", "[^a-z]", ""), F.regexp_replace(ascii_(w), "[^a-z]", "")))
    rows = (
        people.where(owns)
        .select(F.explode(F.transform("words", lambda w, i: F.struct(w.alias("word"), (i == 0).alias("first")))).alias("t"))
        .groupBy("t.word", "t.first").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "word", "first").limit(GAZETTEER_MOST).collect()
    )
    count: dict[str, list[int]] = {}
    raw: dict[str, set[str]] = {}
    for r in rows:
        raw.setdefault(fold(r.word), set()).add(r.word)
        count.setdefault(fold(r.word), [0, 0])[0 if r.first else 1] += r.n
    first = frozenset(w for w, (f, l) in count.items() if f >= max(1, l / 4))
    last = {w for w, (f, l) in count.items() if l >= max(1, f / 4)}
    # As written, with accents, as well as folded.
    spelt = lambda words: frozenset(x for w in words for v in {w, *raw.get(w, ())} for x in {v, *re.split(r"['’\-]", v)} if len(x) > 2)
    return spelt(first), spelt(last)


_SPAN = StructType(
    [StructField("kind", StringType()), StructField("a", IntegerType()), StructField("b", IntegerType()),
     StructField("votes", IntegerType()), StructField("features", ArrayType(IntegerType()))]
)


def _arrow(rows: list[list[Span]]) -> pa.Array:
    """Spans of many texts, column by column."""
    flat = [x for r in rows for x in r]
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    inner = np.zeros(len(flat) + 1, np.int32)
    np.cumsum([len(x[4]) for x in flat], out=inner[1:])
    features = pa.ListArray.from_arrays(pa.array(inner), pa.array([i for x in flat for i in x[4]], pa.int32()))
    column = lambda k, t: pa.array([x[k] for x in flat], t)
    struct = pa.StructArray.from_arrays(
        [column(0, pa.string()), column(1, pa.int32()), column(2, pa.int32()), column(3, pa.int32()), features],
        ["kind", "a", "b", "votes", "features"],
    )
    return pa.ListArray.from_arrays(pa.array(ends), struct)


def _spans_column(text: Column, names: tuple[frozenset[str], frozenset[str]]) -> Column:
    @F.arrow_udf(ArrayType(_SPAN))
    def spans(column: pa.Array) -> pa.Array:
        labeler = _labeler(*names)
        return _arrow([labeler.spans(t) if t else [] for t in column.to_pylist()])

    return spans(text)


#: Prior of every labeler: its firing rates on true and on false spans, worth this share of all spans.
PRIOR_ON, PRIOR_OFF, PRIOR_WEIGHT = 0.6, 0.15, 0.3


def estimate(patterns: list[tuple[int, int]], bits: int = 8, rounds: int = 40, unasked: dict[int, int] | None = None) -> dict[int, float]:
    """EM over vote patterns [(votes, count)]: the probability of each pattern's spans to be true.

    A labeler never used is ignored, and one that wasn't asked (``unasked``: the
    bits of such by pattern) abstains: it neither speaks for or against the
    pattern's spans nor learns from them.  The prior keeps the two classes from
    turning into two sorts of true spans, and no labeler may fire more often on
    false spans than on true ones.
    """
    if not patterns:
        return {}
    rows = lambda values: np.array([[v >> i & 1 for i in range(bits)] for v in values], float)
    votes = rows(v for v, _ in patterns)
    asked = 1 - rows((unasked or {}).get(v, 0) for v, _ in patterns)
    used = (votes * asked).any(0)
    votes, asked = votes[:, used], asked[:, used]
    n = np.array([c for _, c in patterns], float)
    if not votes.shape[1]:
        return {v: 0.5 for v, _ in patterns}
    share = 0.7
    on = np.full(votes.shape[1], PRIOR_ON)
    off = np.full(votes.shape[1], PRIOR_OFF)
    strength = PRIOR_WEIGHT * n.sum() + 2.0
    for _ in range(rounds):
        lift = (asked * (votes * np.log(on / off) + (1 - votes) * np.log((1 - on) / (1 - off)))).sum(1)
        post = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + lift, -30, 30)))
        true, false = (n * post)[:, None] * asked, (n * (1 - post))[:, None] * asked
        share = float(np.clip(((n * post).sum() + 0.5 * strength) / (n.sum() + strength), 0.05, 0.95))
        on = np.clip(((true * votes).sum(0) + PRIOR_ON * strength) / (true.sum(0) + strength), 0.02, 0.98)
        off = np.clip(((false * votes).sum(0) + PRIOR_OFF * strength) / (false.sum(0) + strength), 0.01, 0.97)
        off = np.minimum(off, on)
    return {v: float(p) for (v, _), p in zip(patterns, post)}


#: Vote bits whose firing speaks against a span, by kind.
AGAINST = {"phone": 3, "name": 7}
#: Votes for a name that both gazetteers know in full, and the context labelers that aren't asked then.
FULL_NAME, CONTEXT = 0b111, 0b11111000


def posteriors(counts: list[tuple[str, int, int]]) -> dict[tuple[str, int], float]:
    """By (kind, votes), from counted patterns; the against-votes enter EM inverted."""
    out: dict[tuple[str, int], float] = {}
    for kind in KINDS:
        flip = 1 << AGAINST[kind] if kind in AGAINST else 0
        own = [(v ^ flip, c) for k, v, c in counts if k == kind]
        unasked = {FULL_NAME ^ flip: CONTEXT} if kind == "name" else None
        for v, p in estimate(own, unasked=unasked).items():
            out[kind, v ^ flip] = p
    return out


def train(sample: list[tuple[list[int], float]], rounds: int = 300, rate: float = 0.5) -> np.ndarray:
    """Logistic regression with soft labels on hashed features."""
    weights = np.zeros(DIMENSIONS)
    if not sample:
        return weights
    width = max(len(f) for f, _ in sample)
    index = np.full((len(sample), width), DIMENSIONS)
    for r, (f, _) in enumerate(sample):
        index[r, : len(f)] = f
    target = np.array([y for _, y in sample])
    square = np.full(DIMENSIONS + 1, 1e-6)
    weights = np.zeros(DIMENSIONS + 1)
    for _ in range(rounds):
        score = weights[index].sum(1)
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target
        grad = np.bincount(index.ravel(), np.repeat(error, width), DIMENSIONS + 1) / len(sample) + 1e-5 * weights
        square += grad**2
        weights -= rate * grad / np.sqrt(square)
        weights[DIMENSIONS] = 0.0
    return weights[:DIMENSIONS]


def fields(message: DataFrame, outreach: DataFrame) -> DataFrame:
    """The free-text fields: src_table, rec_id, field, text, one row per different value."""
    entries = F.array(
        F.struct(F.lit("body_text").alias("field"), F.col("body_text").alias("text")),
        F.struct(F.lit("snippet").alias("field"), F.col("snippet").alias("text")),
    )
    mail = message.select(F.lit("message").alias("src_table"), F.col("id").alias("rec_id"), F.explode(entries).alias("e")).select(
        "src_table", "rec_id", "e.*"
    )
    other = outreach.select(
        F.lit("outreach").alias("src_table"), F.col("id").cast("string").alias("rec_id"), F.lit("summary").alias("field"),
        F.col("summary").alias("text"),
    )
    return mail.unionByName(other).where("text IS NOT NULL AND text <> ''")


def detect(texts: DataFrame, names: tuple[frozenset[str], frozenset[str]], keep: tuple[str, ...]) -> DataFrame:
    """Accepted spans of ``texts``(keep..., text): keep..., kind, start_pos, end_pos."""
    spans = durable(
        texts.select(*keep, _spans_column(F.col("text"), names).alias("spans")).where(F.size("spans") > 0)
        .select(*keep, F.explode("spans").alias("s")).select(*keep, "s.*")
    )
    counts = [(r.kind, r.votes, r.n) for r in spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()]
    belief = posteriors(counts)
    # A hash range of each kind holds about as many spans as are wanted; no task sends more than its share.
    total = {k: sum(n for kind, _, n in counts if kind == k) for k in KINDS}
    shares = {k: min(1_000_000, int(1_000_000 * TRAINING_SPANS / len(KINDS) / n) + 1) for k, n in total.items() if n}
    most = F.lit(0)
    for kind, share in shares.items():
        most = F.when(F.col("kind") == kind, share).otherwise(most)
    drawn = F.pmod(F.xxhash64(*keep, "a"), F.lit(1_000_000)) < most
    sample = spans.where(drawn).select("kind", "votes", "features").limit(2 * TRAINING_SPANS).collect()
    weights = train([(r.features, belief.get((r.kind, r.votes), 0.5)) for r in sample])
    table = F.array(*(F.lit(float(w)) for w in np.round(weights, 5)))
    score = F.aggregate("features", F.lit(0.0), lambda s, i: s + F.get(table, i))
    return spans.where(score > 0).select(*keep, "kind", F.col("a").cast("bigint").alias("start_pos"), F.col("b").cast("bigint").alias("end_pos"))


def found(message: DataFrame, outreach: DataFrame) -> DataFrame:
    """Rows (src_table, rec_id, field, kind, start_pos)."""
    keep = ("src_table", "rec_id", "field")
    spans = detect(fields(message, outreach), gazetteer(message, outreach), keep)
    return spans.select(*keep, "kind", "start_pos").distinct()


def redacted(message: DataFrame, outreach: DataFrame) -> DataFrame:
    """Each text with its items replaced by ``[KIND]``: src_table, rec_id, field, text, n_items."""
    texts = fields(message, outreach).distinct()
    texts = texts.withColumn("digest", F.xxhash64("text"))
    keep = ("src_table", "rec_id", "field", "digest")
    spans = detect(texts, gazetteer(message, outreach), keep)
    items = spans.groupBy(*keep).agg(F.array_sort(F.collect_set(F.struct("start_pos", "end_pos", "kind"))).alias("items"))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))

    def step(s: Column, e: Column) -> Column:
        gap = F.substr(F.col("text"), (s["at"] + 1).cast("int"), (e["start_pos"] - s["at"]).cast("int"))
        return F.struct(
            F.concat(s["done"], gap, F.lit("["), F.upper(e["kind"]), F.lit("]")).alias("done"), e["end_pos"].alias("at")
        )

    folded = F.aggregate("items", start, step)
    done = F.concat(folded["done"], F.substr(F.col("text"), (folded["at"] + 1).cast("int"), F.length("text")))
    return texts.join(items, list(keep), "left").select(
        "src_table", "rec_id", "field",
        F.when(F.col("items").isNull(), F.col("text")).otherwise(done).alias("text"),
        F.coalesce(F.size("items"), F.lit(0)).alias("n_items"),
    )
