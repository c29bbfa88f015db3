"""Problem 10: one form for texts that look the same.

Quick-check first: a text without any *unstable* character (one that
normalisation may change: combining marks, full-width forms, ligatures,
invisible or odd-width characters, letters shared in shape by several scripts)
is its own canonical form.  In the others only the unstable segments, each
with the starter before it as boundary context, are normalised and spliced
back between the unchanged parts.

What becomes equal: canonical composition, full- and half-width forms,
presentation ligatures, spaces of any width, non-breaking hyphens, invisible
characters, line-end styles, blanks at line ends, plain letters of another font
family, and letters of Latin, Cyrillic, Greek and Armenian that share a shape
(the rows of ``SHAPES``; the public table of confusable characters isn't at hand
here, so rarer scripts' look-alikes stay apart).  What stays different: letters, accents,
case, raised or lowered digits and signs.  Joiners keep their meaning between
emoji and in scripts that shape by them.

A shared letter takes the script of the unshared letters of its word; a word of
shared letters only takes the script that leads the text.  Both depend on
unshared letters alone, so texts that look the same get the same answer.

Defined results: null stays null, blank texts become ''.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from missive.runtime import durable, spread

# Letters that share their shape, as Latin, Cyrillic, Greek, Armenian ('.' where a script has no such letter).
SHAPES = (
    "AАΑ. BВΒ. EЕΕ. KКΚ. MМΜ. HНΗ. OОΟՕ PРΡ. CС.. TТΤ. XХΧ. YУΥ. SЅ.Տ IІΙ. JЈ.. N.Ν. Z.Ζ. QԚ.. WԜ.. "
    "aа.. eе.. oоοօ pрρ. cс.. yу.. xх.. sѕ.. iі.. jј.. v.ν. hһ.հ qԛ.զ wԝ.. lӏ.. dԁ.. u..ս n..ո"
).split()
# Characters of one script that are shown like another of it.
TWINS = {0x0261: "g", 0x0251: "a", 0x2024: ".", 0x02B9: "'", 0x2010: "-", 0x2011: "-"}
# Mathematical letters and digits that differ from plain ones in nothing but the font's family:
# first code point, and the plain characters in order.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
FONTS = ((0x1D5A0, _ALPHABET), (0x1D670, _ALPHABET), (0x1D7E2, "0123456789"), (0x1D7F6, "0123456789"))
# Code points shown as nothing, joiners, spaces, hyphens.
INVISIBLE = "".join(map(chr, [
    0xAD, 0x34F, 0x61C, 0x180E, 0x200B, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2060, 0x2065),
    *range(0x2066, 0x2070), 0xFEFF,
]))
JOINERS = "\u200c\u200d"
SPACES = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian")


@lru_cache(maxsize=1)
def _tables() -> dict:
    """Fold table, unstable pattern and shape classes, built once per worker.

    The pattern covers the basic plane, which the matcher looks up fastest; the
    few unstable characters beyond it are caught by the closing quick-check.
    """
    fold: dict[int, str] = {ord(c): "" for c in INVISIBLE}
    fold |= {ord(c): " " for c in SPACES}
    fold |= TWINS
    fold |= {first + i: c for first, plain in FONTS for i, c in enumerate(plain)}
    unstable: list[int] = [*fold, *map(ord, JOINERS)]
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp < 0xF900 or 0xAC00 <= cp < 0xD7A4:
            continue
        char = chr(cp)
        if cp in fold:
            continue
        kind = unicodedata.decomposition(char)
        if kind.startswith(("<wide>", "<narrow>")) or 0xFB00 <= cp <= 0xFB06:
            fold[cp] = unicodedata.normalize("NFKC", char)
            unstable.append(cp)
        elif unicodedata.combining(char) or unicodedata.normalize("NFC", char) != char:
            unstable.append(cp)
        elif unicodedata.category(char) in ("Mc", "Mn") or 0x1161 <= cp <= 0x11FF:
            unstable.append(cp)
    spans, unstable = [], sorted(set(unstable))
    for cp in unstable:
        if spans and spans[-1][1] == cp - 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    inside = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    segment = re.compile(f"[{inside}]+")
    shapes: list[dict[str, str]] = [{} for _ in SCRIPTS]
    for rows in SHAPES:
        present = [c for c in rows if c != "."]
        for script, target in enumerate(rows):
            for char in present:
                if target != ".":
                    shapes[script][char] = target
                else:
                    shapes[script][char] = rows[0] if rows[0] != "." else present[0]
    shared = set().union(*shapes)
    other = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}]")
    word = regex.compile(r"[\p{L}\p{M}]+")
    return {"fold": fold, "segment": segment, "shapes": shapes, "shared": shared, "other": other, "word": word}


_KEEPS_JOINER = regex.compile(
    r"[\p{Extended_Pictographic}\p{Emoji_Modifier}\uFE0F\p{Arabic}\p{Devanagari}\p{Bengali}\p{Gujarati}"
    r"\p{Gurmukhi}\p{Kannada}\p{Malayalam}\p{Oriya}\p{Sinhala}\p{Tamil}\p{Telugu}\p{Khmer}\p{Myanmar}"
    r"\p{Mongolian}\p{Syriac}]"
)
_JOINER = regex.compile(r"[\u200c\u200d]+")


def _splice(text: str) -> str:
    """Normalise the unstable segments, each with the starter before it."""
    t = _tables()
    fold, out, at = t["fold"], [], 0
    for match in t["segment"].finditer(text):
        start = max(at, match.start() - 1)
        out += (text[at:start], unicodedata.normalize("NFC", text[start : match.end()].translate(fold)))
        at = match.end()
    return "".join(out) + text[at:] if at else text


def _joiner(match: regex.Match) -> str:
    text, a, b = match.string, match.start(), match.end()
    if a and b < len(text) and _KEEPS_JOINER.match(text[a - 1]) and _KEEPS_JOINER.match(text[b]):
        return match.group()[0]
    return ""


_OF_SCRIPT = [regex.compile(rf"\p{{Script={s}}}") for s in SCRIPTS]


@lru_cache(maxsize=8192)
def _script(letter: str) -> int:
    """Number of a letter's script; that of none is the number of scripts."""
    return next((i for i, p in enumerate(_OF_SCRIPT) if p.match(letter)), len(SCRIPTS))


def _resolve_scripts(text: str) -> str:
    """Shared shapes to one script each, by word and then by text."""
    t = _tables()
    words = list(t["word"].finditer(text))
    shapes, shared = t["shapes"], t["shared"]
    known = range(len(SCRIPTS))
    own, total = [], [0] * (len(SCRIPTS) + 1)
    for m in words:
        count = [0] * (len(SCRIPTS) + 1)
        for letter in unicodedata.normalize("NFD", m.group()):
            if letter not in shared and letter.isalpha():
                count[_script(letter)] += 1
        own.append(count)
        for i, n in enumerate(count):
            total[i] += n
    lead = max(known, key=lambda i: (total[i], -i))
    out, at = [], 0
    for m, count in zip(words, own):
        best = max(known, key=lambda i: (count[i], -i)) if any(count[:-1]) else lead
        plain = unicodedata.normalize("NFD", m.group())
        done = unicodedata.normalize("NFC", "".join(shapes[best].get(c, c) for c in plain))
        out += (text[at : m.start()], done)
        at = m.end()
    return "".join(out) + text[at:]


def canonical_text(text: str) -> str:
    """The canonical form of one text, white space at line ends aside."""
    if text.isascii():
        return text
    t = _tables()
    if _JOINER.search(text):
        text = _JOINER.sub(_joiner, text.translate({ord(c): "" for c in INVISIBLE}))
    text = _splice(text)
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if t["other"].search(text):
        text = _resolve_scripts(text)
    return text


@F.arrow_udf(StringType())
def _canonical(column: pa.Array) -> pa.Array:
    return pa.array([None if v is None else canonical_text(v) for v in column.to_pylist()], pa.string())


def canonical(text: Column) -> Column:
    """Canonical form of a column; plain ASCII texts never leave the JVM."""
    odd = text.rlike(r"[^\x00-\x7f]")
    form = F.when(odd, _canonical(F.when(odd, text))).otherwise(text)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(form, r"\r\n?", "\n"), r"(?m)[ \t]++$", ""), r"^\s+|\s+\z", "")


def canonical_corpus(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with a column ``canonical``; a column of that name is replaced."""
    return documents.withColumn("canonical", canonical(F.col(text)))


def forms(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, variant, form): 128-bit digests of each visible text and of its canonical form."""
    return documents.select(
        F.col(key).alias("doc"),
        F.md5(F.encode(F.col(text), "UTF-8")).alias("variant"),
        F.md5(F.encode(canonical(F.col(text)), "UTF-8")).alias("form"),
        F.col(text).rlike(r"[^\s\p{Z}\p{Cf}]").alias("visible"),
    ).where("visible").drop("visible")


def classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document that looks like a different text: doc_id, class_id (its least document), n_docs, n_variants.

    A class that holds a large share of all documents costs no more than others:
    classes are aggregates, joined back by their form.
    """
    rows = durable(forms(documents, key, text))
    variants = rows.groupBy("form", "variant").agg(F.count("*").alias("n"), F.min("doc").alias("least"))
    several = variants.groupBy("form").agg(
        F.min("least").alias("class_id"), F.sum("n").alias("n_docs"), F.count("*").alias("n_variants")
    ).where("n_variants > 1")
    return rows.join(several, "form").select(F.col("doc").alias(key), "class_id", "n_docs", "n_variants")


def look_alikes(documents: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """Pairs (doc_a, doc_b) of different texts with one canonical form.

    Different texts of one form are paired first, by 128-bit digests; only then
    are the rows of each text attached, so copies are never compared.  Rows are
    salted against a text that holds a large share of the table.
    """
    rows = durable(spread(forms(documents, key, text), salts, "doc"))
    variants = rows.groupBy("form", "variant").agg(F.count("*").alias("n"))
    several = variants.groupBy("form").agg(F.count("*").alias("n_variants")).where("n_variants > 1").select("form")
    variants = durable(variants.select("form", "variant").join(several, "form", "left_semi"))
    left = variants.select("form", F.col("variant").alias("variant_a"))
    right = variants.select("form", F.col("variant").alias("variant_b"))
    pairs = left.join(right, "form").where("variant_a < variant_b").select("variant_a", "variant_b")
    salted = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    members = rows.select("doc", "variant", "salt")
    a = pairs.select("*", salted).join(
        members.select(F.col("doc").alias("x"), F.col("variant").alias("variant_a"), "salt"), ["variant_a", "salt"]
    ).select("x", "variant_b")
    b = a.select("*", salted).join(
        members.select(F.col("doc").alias("y"), F.col("variant").alias("variant_b"), "salt"), ["variant_b", "salt"]
    )
    return b.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()
