"""Problem 4: template residue, filler, error pages and script or check notices.

Lines are normalised (case, digits, outer white space) and counted by host over all
records.  Lines that recur across a host's records and carry no evidence are
its boilerplate and are subtracted.  What remains of a record, its residual,
decides:

* an unfilled slot or filler anywhere in the residual makes the record a case;
* an error message, script demand or check makes it a case unless the residual's
  other sentences outnumber it (``OTHER_SENTENCES`` to one), so a posting that
  speaks of such things is none, on one line or on many.  Menu entries are no
  sentences: those have four words or more, not all of them capitalised.

Counts are pre-aggregated map-side on 64-bit line digests; only records with
some evidence are joined back to them.

Defined results: null, empty and blank descriptions are no cases; repeated rows
of a record give one row; a record's host may be null and counts as ''.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from missive.runtime import durable

#: A line is boilerplate if at least so many, and such a share, of a host's records have it.
BOILERPLATE_RECORDS = 5
BOILERPLATE_SHARE = 0.004
#: An error or script page has at most so many sentences besides boilerplate for each one with evidence.
OTHER_SENTENCES = 3
#: Ids of asked records are broadcast up to so many.
ASKED_MOST = 2_000_000

# Nouns of the fields that posting templates leave open, in capitals inside brackets of any sort.
SLOT_NOUNS = (
    "role|title|job|position|company|employer|client|name|city|town|location|address|country|region|state|office|site|team|department|"
    "division|unit|manager|recruiter|contact|person|salary|range|pay|rate|amount|currency|bonus|date|deadline|start|end|hours|"
    "shift|duration|benefits|perks|requirements|skills|duties|tasks|responsibilities|qualifications|degree|experience|years|level|"
    "description|summary|overview|industry|product|phone|email|website|link|url|number|code|reference|text|content|"
    "firma|stelle|ort|datum|gehalt|poste|entreprise|ville|empresa|puesto|ciudad|nombre|fecha"
)
_NOUN = rf"(?:{SLOT_NOUNS})"
# Forms of unfilled slots.
SLOTS = [
    rf"\[(?:[A-Z]+[ _-]){{0,3}}{_NOUN.upper()}\]",
    rf"<(?:[A-Z]+[ _-]){{0,3}}{_NOUN.upper()}>",
    rf"«\s*(?i:(?:\w+[ _-]){{0,3}}{_NOUN})\s*»",
    rf"\$(?:[A-Z]+_){{0,3}}{_NOUN.upper()}\b(?!-style|-like)",
    r"\*\|\s*[\w:.\-]+\s*\|\*",
    r"@@\s*[\w.\-]+\s*@@",
    r"\b[Xx]{3,}(?:\s+[Xx]{3,}\b)+",
    r"\{\{\s*[\w.\-]+\s*\}\}",
    r"\$\{\s*[\w.\-]+\s*\}(?!-style|-like)",
    r"<%=?\s*[\w.\- ]+\s*%>",
    r"%[A-Z][A-Z_]{2,}%",
    r"\[\[\s*[\w.\- ]+\s*\]\]",
    r"\[(?:insert|enter|add|fill in|your)\b[^\]\n]{0,60}\]",
    r"<[\w ]{0,40}\b(?:goes here|name here|here)>",
    r"\b[Xx]{4,}\b",
    r"\[object Object\]",
    r"__[A-Z][A-Z_]{2,}__",
    r"#\{\s*[\w.\-]+\s*\}",
    r"(?<![{$#])\{\s*[\w.\-]{1,40}\s*\}(?!\}|-style|-like)",
    r"<<\s*[\w.\- ]{1,40}\s*>>",
    r"\b(?i:insert|enter|add) (?:the |your )?(?:job|company|role|title|text|description)[\w ]{0,30} here\b",
]
# Lines, or sentences, that are nothing but filler.
FILLER_LINES = [
    r"(?:tbd|tba|tbc|todo|fixme|n/?a|nan|null|none|undefined|test|text|sample|dummy|asdf\w*|qwer\w*|placeholder|foo|bar|blah)",
]
FILLER_PHRASES = [
    r"(?i)\bplaceholder\s*[-:–]+\s*do not publish",
    r"(?i)\btodo\s*:\s*(?:write|add|fill|insert)",
    r"(?i)\byour (?:content|text|job description|description) (?:goes )?here\b",
    r"(?i)\b(text|test|blah|sample)(?:\s+\1){2,}\b",
    r"(?i)\bdo not publish\b|\breplace (?:this |it )?before publi|\bplease ignore\b",
    r"(?i)\b(?:dummy|sample|test|example) (?:posting|job|text|listing|record|entry)[,.:;] ",
    r"(?m)^[ \t]*(?:\.{3}|…)[ \t]*\n\s*(?:\.{3}|…)[ \t]*$",
    r"(?i)\bfiller (?:text|copy) (?:only|here|until)",
    r"(?i)\bcopy to follow\b|\bto be (?:filled in|completed|confirmed) by (?:hr|the recruiter|the hiring manager)\b",
    r"\bTBD\s*(?:[.,;:/|-]\s*)?(?:TBD|test)\b",
]
# Stems of the customary dummy Latin.
DUMMY_LATIN = (
    r"(?i)\b(?:lorem|ipsum|dolor\w{0,3}|amet\w{0,3}|consec\w*|adipis\w*|elit\w?|eiusm\w*|tempor[aei]?|incid\w*|"
    r"labor[ei]s?|utlab\w*|magn[ai]r?|aliqu\w*|enim\w{0,3}|minim|veniam|quisn?o?|n?o?strud\w*|exerci\w*|tatio\w?|"
    r"ullam\w*|nisi\w{0,2}|tetur|sed[o]?|etdol\w*|commod\w*|conseq\w*)\b"
)
# Wording of error pages, script demands and checks.
NOTICES = [
    r"(?:enable|activate|turn on|switch on|allow|activer|activez|aktivieren|activ[ae]r?|habilit[ae]r?)\b[^.\n]{0,25}\b(?:java ?script|scripts?)\b",
    r"java ?script (?:is|must be|has to be|needs to be|seems to be)\s+(?:turned off|disabled|off|blocked|not enabled|not supported|enabled|switched on)",
    r"(?:requires?|needs?) (?:java ?script|scripts)\b",
    r"scripts? (?:must|have to|need to) (?:run|be)|scripts switched on|\bnoscript\b",
    r"java ?script (?:erforderlich|ist deaktiviert|est désactivé|desactivado|deaktiviert)",
    r"browser (?:is )?(?:not supported|blocks|out of date|outdated|unsupported)|browser (?:cannot|can.?t|does not|doesn.?t) (?:run|display|show|support)",
    r"(?:we.?ll|we will) be (?:right )?back (?:soon|shortly|in a)|be right back\b",
    r"checking your browser|verify (?:that )?you are (?:a )?(?:human|not a robot)|are you (?:a )?(?:human|robot)|not a robot|"
    r"\bcaptcha\b|solve the puzzle|unusual traffic|too many requests|security check|press and hold",
    r"überprüf\w+ ihren browser|kein roboter|vérif\w+ (?:que )?vous n.êtes pas un robot|no eres un robot|no es un robot|eres humano",
    r"\b(?:error|erreur|fehler|http|status)\s*(?:code|status)?\s*[#:(]?\s*\d{2,3}\b",
    r"\b[45]\d\d\s*[-:.,]?\s*(?:error|service unavailable|not found|forbidden|bad gateway|gateway|internal|unauthori[sz]ed|page)",
    r"(?:access|permission|zugriff|accès|acceso)\s*(?:is|was|has been|wurde|est|fue)?\s*(?:denied|forbidden|verweigert|refusé|denegado)|do not have permission",
    r"(?:page|seite|página|pagina|url|posting|listing|resource)[^.\n]{0,30}(?:not found|nicht gefunden|introuvable|no encontrad|no existe|does not exist|could not be found|rejected)",
    r"(?:can.?t|cannot|could not|couldn.t|unable to) (?:find|load|display|open|show) (?:that|this|the|your)\b[^.\n]{0,20}(?:page|posting|job|listing|record)",
    r"could not be (?:loaded|displayed|retrieved)|no se pudo cargar|konnte nicht geladen|n.a pas pu être charg",
    r"session (?:has |is )?(?:expired|timed out)|sitzung ist abgelaufen|session a expiré|sesión ha caducado",
    r"application error|server-side exception|\btraceback\b|unhandled exception|stack trace|render failed|internal (?:server )?error",
    r"bad gateway|gateway (?:time-?out|node)|service (?:is )?(?:temporarily )?unavailable|upstream did not answer|broken pipe",
    r"something went wrong|etwas ist schiefgelaufen|une erreur s.est produite|algo salió mal|unexpected error",
    r"down for maintenance|wartungsarbeiten|en maintenance|en mantenimiento|under maintenance",
    r"request(?:ed)? (?:url )?(?:was|has been) (?:rejected|blocked)|your support number is|incident #?\d|try again in \d+ minutes",
    r"nothing happens, allow|connection (?:was )?(?:reset|refused|timed out)|database connection|query failed",
]
#: Substrings of the lower-cased text without which a pattern of
#: that kind can't match, so that most lines never meet a pattern.  Lines of bare
#: filler words need none.
SLOT_HINTS = (
    "{", "<", "%", "__", "[[", "[insert", "[enter", "[add", "[fill", "[your", "xxx", "[object", "*|", "@@", "«",
    *(f"{n}]" for n in SLOT_NOUNS.split("|")),
    *(f"${a}" for a in "abcdefghijklmnopqrstuvwxyz"),
    *(f"{a} {b}" for a in ("insert", "enter", "add") for b in ("the", "your", "job", "company", "role", "title", "text", "description")),
)
FILLER_HINTS = (
    *"tbd|tba|tbc|todo|fixme|placeholder|your content|your text|your job desc|your desc|blah|dummy|sample|not publish|before publi|undefined|null".split("|"),
    *"please ignore|asdf|qwer|to be filled|to be completed|to be confirmed|copy to follow|filler".split("|"),
    *(f"{a} {b}" for a in ("test", "example") for b in ("posting", "job", "text", "listing", "record", "entry")),
)
#: Frequent words that make a notice only as ``LOOSE`` has them.
LOOSE_HINTS = ("script", "page", "internal", "unauthori")
LOOSE = r"(?i)\bscripts?\b|[45]\d\d\s*[-:.,]?\s*(?:page|internal|unauthori)"
#: All stems but two of DUMMY_LATIN, which asks for three different ones.
LATIN_HINTS = (
    "lorem|ipsum|dolor|amet|consec|adipis|eiusm|tempor|incid|labore|labori|utlab|magn|aliqu|enim|minim|veniam|quis|strud|exerci|tatio|"
    "ullam|nisi|tetur|etdol|commod|conseq"
).split("|")
NOTICE_HINTS = (
    "javascript|java script|scripts|noscript|browser|captcha|robot|human|humano|puzzle|unusual traffic|too many|"
    "security check|press and hold|error|erreur|fehler|http|status|denied|forbidden|verweigert|refusé|denegado|permission|"
    "not found|not be found|gefunden|introuvable|no encontrad|no existe|not exist|find that|find this|find the|find your|"
    "be loaded|load this|load the|load that|load your|charg|display|open this|open the|open that|open your|show this|show the|"
    "show that|show your|be retrieved|cargar|geladen|expired|timed out|abgelaufen|expiré|caducado|exception|traceback|"
    "stack trace|render failed|gateway|unavailable|upstream|broken pipe|went wrong|schief|s'est produite|salió mal|"
    "maintenance|mantenimiento|wartung|rejected|blocked|support number|incident|try again|nothing happens|connection|"
    "query failed|be back|right back|404|403|500|502|503|504|401"
).split("|")


@lru_cache(maxsize=1)
def _matchers() -> dict:
    """Patterns and the hint automaton, compiled once per worker."""
    automaton = ahocorasick.Automaton()
    kinds: dict[str, int] = {}
    for bit, hints in ((1, SLOT_HINTS), (2, FILLER_HINTS), (4, NOTICE_HINTS), (8, LATIN_HINTS), (16, LOOSE_HINTS)):
        for hint in hints:
            kinds[hint] = kinds.get(hint, 0) | bit
    for hint, bits in kinds.items():
        automaton.add_word(hint, bits)
    automaton.make_automaton()
    return {
        "hints": automaton,
        "slot": re.compile("|".join(f"(?:{p})" for p in SLOTS)),
        "filler": [re.compile(p) for p in FILLER_PHRASES],
        "repeated": [re.compile(p) for p in FILLER_PHRASES if r"\1" in p or r"\.{3}" in p],
        "filler_line": re.compile(rf"(?i)^[\W_]*(?:{FILLER_LINES[0]}[\W_]*){{1,12}}$"),
        "filler_start": re.compile(rf"\n[\W_]*{FILLER_LINES[0]}"),
        "loose": re.compile(LOOSE),
        "latin": re.compile(DUMMY_LATIN),
        "notice": re.compile("(?i)" + "|".join(f"(?:{p})" for p in NOTICES)),
        "sentence": re.compile(r"(?<=[.!?])\s+|\s+[•·*◦▪–-]\s+"),
    }


def prose(sentence: str) -> bool:
    """Four words or more, of which two in five begin in lower case; menus and names don't."""
    words = [w for w in sentence.split() if w[0].isalpha()]
    return len(words) >= 4 and 5 * sum(w[0].islower() for w in words) >= 2 * len(words)


def evidence_lines(text: str) -> list[tuple[int, bool, int, int]]:
    """(line number, unfinished?, sentences with a notice, other sentences) of lines that matter.

    Only lines that hold a hint meet the patterns, but for lines of bare filler
    words.  Without a hint such a line (``None``, ``N/A``, ``Test``) may answer a
    heading of a posting, so it counts as a notice does.  Filler that spans lines
    is reported once, as line -1.  Of a text with notices, and only of such, lines
    without evidence are given too if they hold sentences.
    """
    m = _matchers()
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    hits = list(m["hints"].iter(low))
    out: list[tuple[int, bool, int, int]] = []
    start, k, every = 0, 0, 0
    latin: list[str] = []
    bare = m["filler_line"].match
    bare_line = m["filler_start"].search("\n" + low) is not None
    # Words that are filler if said three times, and marks that are on two lines.
    repeats = low.count("test") > 2 or low.count("text") > 2 or low.count("...") + low.count("…") > 1
    if not (hits or bare_line or repeats):
        return []
    lines = text.split("\n")
    for at, line in enumerate(lines):
        stop, bits = start + len(line), 0
        while k < len(hits) and hits[k][0] <= stop:
            bits |= hits[k][1]
            k += 1
        start = stop + 1
        every |= bits
        if not (bits or bare_line) or not line.strip():
            continue
        if not bits:
            if bare(line):
                out.append((at, False, 1, 0))
            continue
        unfinished = bool(bits & 1 and m["slot"].search(line))
        if bits & 8 and not unfinished:
            stems = [w.lower() for w in m["latin"].findall(line)]
            latin += stems
            unfinished = len(stems) >= 5 and len(set(stems)) >= 3
        if bits & 2 and not unfinished:
            unfinished = bool(bare(line) or any(p.search(line) for p in m["filler"]))
        if unfinished:
            out.append((at, True, 0, 0))
        elif bare_line and bare(line):
            out.append((at, False, 1, 0))
        elif (bits & 4 or (bits & 16 and m["loose"].search(line))) and m["notice"].search(line):
            parts = m["sentence"].split(line.strip())
            told = [p for p in parts if m["notice"].search(p)]
            others = sum(prose(p) for p in parts) - sum(prose(p) for p in told)
            # A notice that runs over the end of a sentence is one.
            out.append((at, False, max(1, len(told)), others))
    if (len(latin) >= 5 and len(set(latin)) >= 3) or (
        (every & 2 or repeats) and any(p.search(text) for p in m["filler" if every & 2 else "repeated"])
    ):
        out.append((-1, True, 0, 0))
    if out and not any(e[1] for e in out):
        noted = {e[0] for e in out}
        for at, line in enumerate(lines):
            if at not in noted and (n := sum(map(prose, m["sentence"].split(line.strip())))):
                out.append((at, False, 0, n))
    return out


EVIDENCE = ArrayType(
    StructType(
        [StructField("at", IntegerType()), StructField("unfinished", BooleanType()), StructField("notices", IntegerType()),
         StructField("others", IntegerType())]
    )
)
_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("unfinished", pa.bool_()), ("notices", pa.int32()), ("others", pa.int32())]))


@F.arrow_udf(EVIDENCE)
def _evidence(column: pa.Array) -> pa.Array:
    names = ("at", "unfinished", "notices", "others")
    rows = [[dict(zip(names, e)) for e in evidence_lines(t)] if t else [] for t in column.to_pylist()]
    return pa.array(rows, _ARROW)


def _normal(text: Column) -> Column:
    """A text, or a line of it, without case, digits and outer white space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[0-9\r]+", ""))


def digest(line: Column) -> Column:
    """64-bit digest of a normalised line."""
    return F.xxhash64(_normal(line))


def different_lines(text: Column) -> Column:
    """A text's different lines without case and digits; outer white space is left for later."""
    return F.array_distinct(F.split(F.regexp_replace(F.lower(text), r"[0-9\r]+", ""), "\n"))


def filled(records: DataFrame) -> DataFrame:
    """Records that hold some text, with their host ('' for none)."""
    kept = records.select("src_table", "rec_id", F.coalesce("host", F.lit("")).alias("host"), "description")
    return kept.where(F.length(F.trim("description")) > 0)


def line_counts(records: DataFrame) -> DataFrame:
    """(host, digest, n): how many records of a host hold a normalised line."""
    lines = filled(records).select("host", F.explode(different_lines(F.col("description"))).alias("line"))
    return lines.select("host", F.xxhash64(F.trim("line")).alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("n"))


def residue(records: DataFrame, asked: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Cases among ``records``(src_table, rec_id, host, description): rows src_table, rec_id.

    With ``asked``(rec_id, different ones) only those need an answer; lines are counted over all
    records, and more are judged where ``asked`` is too large to be broadcast (``ASKED_MOST``).
    ``counts``: the records' ``line_counts``, if they are at hand.
    """
    records = filled(records)
    per_host = records.groupBy("host").agg(F.count("*").alias("n_records"))
    counted = (line_counts(records) if counts is None else counts).where(F.col("n") >= BOILERPLATE_RECORDS)
    # Both sides are aggregates; Catalyst picks the join from their sizes.
    boilerplate = (
        counted.join(per_host, "host").where(F.col("n") >= BOILERPLATE_SHARE * F.col("n_records")).select("host", "digest")
    )
    text, judged = F.col("description"), records
    if asked is not None and asked.count() <= ASKED_MOST:
        judged = records.join(F.broadcast(asked.select(F.col("rec_id").alias("asked"))), F.col("rec_id") == F.col("asked"))
        # A condition on both sides, or the filter on the evidence would go before the join.
        text = F.when(F.col("asked").isNotNull(), text)
    seen = durable(judged.withColumn("evidence", _evidence(text)).where(F.size("evidence") > 0).select(*records.columns, "evidence"))
    # Filler and slots decide at once; notices only if little else is said.
    unfinished = F.exists("evidence", lambda e: e["unfinished"])
    open_case = seen.where(unfinished).select("src_table", "rec_id")
    told = seen.where(~unfinished).select(
        "src_table", "rec_id", "host", F.split("description", "\n").alias("lines"), F.explode("evidence").alias("e")
    )
    line = F.get(F.col("lines"), F.col("e.at"))
    told = told.select(
        "src_table", "rec_id", "host", "e.notices", "e.others",
        F.when(F.col("e.notices") == 0, digest(line)).alias("digest"),
    )
    # Lines with a notice have no digest, so they always stay.
    notices = (
        told.join(boilerplate, ["host", "digest"], "left_anti")
        .groupBy("src_table", "rec_id").agg(F.sum("notices").alias("notices"), F.sum("others").alias("others"))
        .where(F.col("others") <= OTHER_SENTENCES * F.col("notices")).select("src_table", "rec_id")
    )
    return open_case.unionByName(notices).distinct()


def host_of(url: Column, otherwise: Column) -> Column:
    """The host a URL names, without ``www.``, else ``otherwise``."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z]+://(?:[^/@]*@)?(?:www\.)?([^/:?#]+)", 1)
    return F.when(host != "", host).otherwise(otherwise)


def job_records(job: DataFrame) -> DataFrame:
    return job.select(
        F.lit("job").alias("src_table"), F.col("id").cast("string").alias("rec_id"), host_of(F.col("url"), F.col("source")).alias("host"),
        "description",
    )


def scraped_records(scraped: DataFrame) -> DataFrame:
    host = host_of(F.col("final_url"), F.split("url_key", ":")[0])
    return scraped.select(
        F.lit("scraped_job").alias("src_table"), F.col("url_key").alias("rec_id"), host.alias("host"), "description"
    ).distinct()


def found(job: DataFrame, scraped: DataFrame) -> DataFrame:
    """Cases of both tables."""
    return residue(job_records(job).unionByName(scraped_records(scraped)))
