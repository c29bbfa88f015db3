"""Problem 1: the text a sender newly wrote, without quoted mail, closing and footers.

Multilingual line rules, applied to the lines of a body in one pass:

* quoted lines (``>``, ``|``, ``»``, escaped forms, nested), and blocks that an
  attribution line introduces and that are indented instead;
* attribution lines, also wrapped over up to three lines, in several languages;
* forwarded or original messages: the introducing line, its header lines and
  all that follows without a prefix;
* the closing block, from the sign-off phrase or delimiter (or, without one,
  from the sender's name above contact data) through name and contact data;
* device notes, gateway banners, legal and list footers.

Answers between quoted lines, greetings and digest rows stay.  A summary that
is copied from the body takes the judgement of the body's lines, so a line cut
short keeps its nature.

Defined results: null and empty bodies have no lines; blank lines are never
reported; repeated rows of a message give one answer per line.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

# Phrases that close a letter.
SIGN_OFF = (
    r"(?:(?:with |my )?(?:best|kind|kindest|warm|warmest|many|sincere|friendly)?\s*(?:regards|wishes|greetings)|best|thanks|thank you|"
    r"many thanks|thanks again|thanks in advance|thx|cheers|br|kr|rgds|sincerely|sincerely yours|yours|yours (?:sincerely|faithfully|truly)|"
    r"all the best|take care|respectfully|cordially|talk soon|best of luck|"
    r"mit (?:freundlichen|besten|herzlichen|vielen|lieben) gr(?:ü|ue)(?:ß|ss)en|(?:viele|beste|liebe|herzliche|freundliche|schöne) gr(?:ü|ue)(?:ß|ss)e|gru(?:ß|ss)|mfg|lg|vg|"
    r"vielen dank|danke|hochachtungsvoll|"
    r"cordialement|bien cordialement|bien à vous|sincères salutations|salutations|meilleures salutations|amicalement|merci|merci d'avance|"
    r"(?:un )?(?:cordial )?saludos?(?: cordial(?:es)?)?|atentamente|cordialmente|gracias|muchas gracias|un abrazo|"
    r"с уважением|спасибо|cordiali saluti|met vriendelijke groet(?:en)?)"
)
# Words that introduce an earlier mail.
WROTE = r"(?:wrote|writes|said|schrieb|a écrit|écrivait|escribió|ha scritto|schreef|пишет|написал\(?а?\)?)"
FORWARD = (
    r"(?:original message|forwarded message|forwarded|begin forwarded message|forwarded by|ursprüngliche nachricht|"
    r"weitergeleitete nachricht|message (?:d'origine|original|transféré|initial)|mensaje (?:original|reenviado)|"
    r"original-nachricht|messaggio originale|inoltrato)"
)
HEADER = r"(?:from|sent|to|cc|bcc|date|subject|reply-to|von|gesendet|an|datum|betreff|de|envoyé|à|objet|para|enviado|fecha|asunto)"
MONTHS = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|mär|mai|okt|dez|janv|févr|mars|avr|juin|juil|août|ene|abr|ago|dic)\w*\.?"
DATE = (
    rf"(?:(?:\w{{2,4}}\.?,?\s+)?{MONTHS}\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\.?\s+{MONTHS},?\s+\d{{4}}|"
    r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{2,4})"
)
TIME = r"(?:,?\s*(?:at|um|à|a las)?\s*\d{1,2}:\d{2}(?::\d{2})?\s*(?:[ap]\.?m\.?)?)?"
# Device notes, banners, legal and list footers.
DEVICE = (
    r"(?:sent (?:from|via|with|using) (?:my |a |the )?[\w ]{2,40}|get (?:the )?[\w ]{0,20}\b(?:app|outlook)\b.*|"
    r"(?:written|typed|sent) (?:from|on) (?:a|my) .*|von (?:meinem|unterwegs).*(?:gesendet)?|gesendet (?:von|mit) .*|"
    r"envoyé (?:depuis|de) .*|enviado desde .*|inviato da .*|please excuse (?:my )?(?:typos|brevity).*)"
)
FOOTERS = [
    r"\bconfidential(?:ity)?\b.*\b(?:notice|meant|intended|addressee|recipient|only|information)\b|\bconfidentiality notice\b",
    r"\b(?:legally )?privileged\b|\bunauthori[sz]ed (?:use|disclosure|copying)|\bmeant only for the\b|\bintended (?:only|solely) for\b|\bintended recipient",
    r"\bif you (?:have )?received (?:it|this).{0,40}\b(?:error|mistake)\b|\bplease delete it and (?:tell|notify)\b",
    r"\bvertraulich\b|nicht der richtige (?:adressat|empfänger)|löschen sie sie bitte",
    r"\bce (?:message|courriel|mail) (?:est|et).{0,60}(?:confidentiel|destin)|\bson seul destinataire",
    r"\b(?:mensaje|correo)\b.{0,40}\b(?:reservados?|confidencial)|si no es para usted|bórrelo",
    r"\baccepts? no (?:liability|responsibility)\b|\bdamage caused by (?:any )?virus",
    r"\b(?:views|opinions) expressed\b|\bthose of the author\b",
    r"\bnothing in this (?:letter|mail|message|e-?mail) forms a contract\b|\bforms? (?:no|a) contract unless\b|signed paper follows",
    r"\bthink of the environment\b|\bbefore printing this\b|\bconsider the environment\b",
    r"\b(?:you (?:get|got|receive|received|are receiving) this|why did you get this|warum erhalten sie|vous recevez ce|recibe este)\b",
    r"\bunsubscribe\b|\bmanage (?:your )?(?:preferences|subscription)|\bturn alerts off\b|\bstop these (?:letters|mails|e-?mails|messages)\b|"
    r"\bopt[- ]out\b|\babbestellen\b|\bse désabonner\b|\bdarse de baja\b|\bcancelar (?:la )?suscripción",
    r"^\s*(?:the )?[\w .,&'-]{0,60}registered (?:in|office|at)\b.*(?:number|no\.|:|\d)|\bregistered office:|\bcompany (?:no|number|registration)\b|"
    r"\bcommercial register\b|\bhandelsregister\b|\bgeschäftsführer\b|\bamtsgericht\b|\bsiège social\b|\bdomicilio social\b|\bvat (?:id|no)",
    r"^\s*board: .*\b(?:chair|seat)\b|\bour data notice\b|\bprivacy (?:notice|policy) (?:is|on|at)\b|\bdata notice is on\b",
    r"^\s*\*{2,}\s*(?:external|extern|externe|caution|warning|achtung|attention|atención)\b.*\*{2,}\s*$|^\s*\[?(?:external|caution)(?: e?-?mail| sender)?\]?:.*\b(?:links?|attachments?|trust)\b",
    r"\bview (?:this|it|the) (?:mail|e-?mail|message|letter)? ?(?:online|in (?:your|a) browser)\b|^\s*view (?:online|in browser)\s*$",
    r"^\s*(?:©|copyright \d{4})|\ball rights reserved\b",
    r"^\s*(?:list-(?:id|unsubscribe)|mailing list)\b",
    r"\bnot (?:legally )?binding\b.*\b(?:mail|message)\b|\bthis (?:e-?mail|message|mail) (?:and|may|is|was|contains)\b.*\b(?:attach|contain|confid|scan|virus)",
]
# Words of job titles in closings.
PHONE = r"(?:\+?\(?\d[\d\s().\-/‑–]{5,}\d(?:\s*(?:ext\.?|x)\s*\d+)?)"


# Substrings of the lower-cased line without which no footer can match.
FOOTER_HINTS = (
    "confiden|privileged|unauthori|meant only|intended|received|delete it|vertraulich|adressat|empfänger|löschen|seul dest|"
    "reservado|si no es para|bórrelo|no liability|no responsib|virus|expressed|of the author|contract|signed paper|environment|"
    "before printing|you get this|you got this|receive|warum|vous recevez|recibe|unsubscribe|preferences|subscription|alerts off|stop these|"
    "opt-out|opt out|abbestellen|désabonner|de baja|suscrip|registered|company n|company reg|handelsregister|commercial register|"
    "geschäftsführer|amtsgericht|siège social|domicilio social|vat |board:|data notice|privacy |**|external|caution|view |©|copyright|"
    "reserved|list-|mailing list|binding|this e|this m"
).split("|")


@lru_cache(maxsize=20_000)
def _is_footer(line: str) -> bool:
    low = line.lower()
    p = _p()
    return bool((any(h in low for h in FOOTER_HINTS) and p["footer"].search(line)) or p["device"].match(line))


@lru_cache(maxsize=1)
def _p() -> dict:
    c = lambda s: re.compile("(?i)" + s)
    mail = r"<?[\w.+\-]+\s?(?:@|\[at\]|\(at\))\s?[\w.\- \[\]()]+>?"
    lead = r"(?:on|am|le|el|il|op)"
    return {
        "quoted": c(r"^\s*(?:>|&gt;|»|\|(?!\|))"),
        "indent": re.compile(r"^(?:\t| {2,})\S"),
        # Sure on their own, and those that need a quoted block below.
        "sure": [
            c(rf"^\s*{lead}\b.{{4,160}}\b{WROTE}\s*:?\s*$"),
            c(rf"^\s*{lead}\s+{DATE}.{{0,20}}\b{WROTE}\b.{{2,120}}:\s*$"),
            c(rf"^.{{2,120}}\b{WROTE}\s+(?:on|am|le|el)\s+{DATE}{TIME}\s*:\s*$"),
            c(rf"^\s*{DATE}{TIME},?\s+.{{2,120}}\b{WROTE}\s*:\s*$"),
            c(rf"^.{{2,80}}<[^>]*@[^>]*>\s*{WROTE}\s*:\s*$"),
        ],
        "weak": [
            c(rf"^\s*(?:quoting|citing|zitat von|citation de|cita de|quoting from)\s+.{{2,90}}:\s*$"),
            c(rf"^\s*[^.!?]{{2,90}}\b{WROTE}\s*:\s*$"),
            c(rf"^\s*{DATE}{TIME},?\s+[^.!?]{{2,120}}(?:<[^>]*>)?\s*:\s*$"),
        ],
        "start": c(rf"^\s*(?:{lead}\b.*\d|{DATE})"),
        "forward": c(rf"^\s*[-_=*>\s]*\b{FORWARD}\b\s*:?\s*[-_=*\s]*$"),
        "fwd": c(r"^\s*(?:fwd?|wg|tr|rv)\s*:\s*$"),
        "rule": re.compile(r"^\s*_{8,}\s*$|^\s*-{20,}\s*$"),
        "header": c(rf"^\s*\**{HEADER}\**\s*:\s*\S"),
        "from": c(rf"^\s*\**(?:from|von|de)\**\s*:\s*\S"),
        "sign": c(rf"^\s*{SIGN_OFF}\s*[,!.\-–—]*\s*$"),
        "delimiter": re.compile(r"^\s*(?:--|__|~{2,}|—|---|={3,}|\*{3,}|-- )\s*$"),
        "footer": c("|".join(f"(?:{f})" for f in FOOTERS)),
        "device": c(rf"^\s*{DEVICE}\s*\.?\s*$"),
        "name": re.compile(r"^\s*[^\W\d_][\w.'’\-]*(?:,?\s+[^\W\d_][\w.'’\-]*){0,4}\s*,?\s*$"),
        "title": re.compile(r"^\s*[^\W\d_][\w&.'/ \-]{2,40}\s*(?:[·|@,•]|\bat\b|-)\s*[^\W\d_].{1,60}$"),
        "contact": c(
            rf"^\s*(?:(?:t|tel|phone|mobile|mob|cell|m|direct|fon|telefon|tél|office|e|mail|email|e-mail|w|web|fax|☎)\s*[.:]?\s*)?"
            rf"(?:{PHONE}|{mail}|https?://\S+|www\.\S+)\s*$"
        ),
        "address": c(
            r"^\s*(?:\d{1,5}\s+\w.{2,60}|p\.?\s?o\.?\s*box\s*\d+.*|[\w\-]+(?:allee|straße|strasse|weg|gasse|platz)\s+\d+.*|"
            r"[\w\- ]{2,40},?\s+[A-Z]{2}\s+\d{4,5}|[\w\- ]{2,40}\s+[A-Z]{1,2}\d{1,2}\s?\d[A-Z]{2}|\d{5}\s+\w[\w\- ]{1,30})\s*$"
        ),
        "postscript": c(r"^\s*p\.?\s?s\.?\s*[:.\-]?\s"),
    }


def carried_lines(text: str, sender: str = "") -> list[int]:
    """Numbers of the lines that are not newly written by the sender."""
    p = _p()
    lines = [x.rstrip("\r") for x in text.split("\n")]
    n = len(lines)
    drop = [False] * n
    blank = [not x.strip() for x in lines]

    def next_filled(i: int) -> int:
        i += 1
        while i < n and blank[i]:
            i += 1
        return i

    quoted = [bool(p["quoted"].match(x)) for x in lines]
    i, carried = 0, n
    while i < n:
        if blank[i]:
            i += 1
            continue
        line = lines[i]
        if quoted[i]:
            drop[i] = True
            i += 1
            continue
        # Forwarded or original message: all to the end, unless it's a lone phrase.
        j = next_filled(i)
        heads = j < n and p["header"].match(lines[j])
        if (
            p["forward"].match(line) and (heads or j >= n or re.search(r"[-_=]{2,}", line) or line.strip().endswith(":"))
            or p["fwd"].match(line) and (heads or j >= n)
            or p["rule"].match(line) and j < n and p["from"].match(lines[j])
            or p["from"].match(line) and heads and (i == 0 or blank[i - 1] or drop[i - 1])
        ):
            carried = i
            break
        # Attribution, on one to three lines.
        span = 0
        for width in (1, 2, 3) if line.rstrip().endswith(":") or p["start"].match(line) else ():
            if i + width > n or any(blank[i : i + width]) or any(quoted[i : i + width]):
                break
            joined = " ".join(x.strip() for x in lines[i : i + width])
            if not joined.endswith(":"):
                continue
            if width > 1 and not p["start"].match(joined):
                break
            below = next_filled(i + width - 1)
            backed = below >= n or quoted[below] or bool(p["indent"].match(lines[below]))
            if any(s.match(joined) for s in p["sure"]) or (backed and any(w.match(joined) for w in p["weak"])):
                span = width
                break
        if span:
            for k in range(i, i + span):
                drop[k] = True
            i += span
            # An indented block stands for quote prefixes.
            k = next_filled(i - 1)
            if k < n and not quoted[k] and p["indent"].match(lines[k]):
                while k < n and (blank[k] or p["indent"].match(lines[k]) or quoted[k]):
                    drop[k] = not blank[k]
                    k += 1
                i = k
            continue
        i += 1
    for k in range(carried, n):
        drop[k] = not blank[k]

    # Closing block and footers in what is left.
    own = set(re.findall(r"[^\W\d_]+", sender.lower()))
    closing = False
    for i in range(carried):
        if blank[i] or drop[i]:
            closing = closing and not (drop[i] and quoted[i])
            continue
        line = lines[i]
        if p["postscript"].match(line):
            closing = False
            continue
        if closing:
            drop[i] = True
            continue
        if _is_footer(line):
            banner = line.lstrip().startswith(("*", "["))
            drop[i] = True
            closing = not banner
            # A name of the house above its registered office.
            if i and not blank[i - 1] and not drop[i - 1] and line[:1].isspace() and len(lines[i - 1].split()) <= 6:
                drop[i - 1] = lines[i - 1].strip()[-1:] not in ".!?"
            continue
        j = next_filled(i)
        after = lines[j] if j < n else ""
        if p["sign"].match(line):
            end = j >= carried or quoted[j] or drop[j]
            if end or p["name"].match(after) or p["title"].match(after) or p["contact"].match(after) or _is_footer(after):
                closing = drop[i] = True
                continue
        if p["delimiter"].match(line):
            if j < carried and not quoted[j] and (p["name"].match(after) or p["contact"].match(after) or _is_footer(after)):
                closing = drop[i] = True
                continue
        # The sender's own name above title or contact data, or at the very end.
        words = set(re.findall(r"[^\W\d_]+", line.lower()))
        if words and p["name"].match(line) and len(line) < 60 and line.strip()[-1] not in ".!?:":
            below = j < carried and j == i + 1 and not quoted[j] and (
                p["contact"].match(after) or (p["title"].match(after) and len(after) < 80 and not after.rstrip().endswith("."))
            )
            if (below and (words & own or p["contact"].match(after) or _title_words(after))) or (
                (j >= carried or drop[j]) and len(words) >= 2 and words <= own
            ):
                closing = drop[i] = True
    # Line ends of a footer that began one line above (wrapped house name).
    return [i for i in range(n) if drop[i]]


def _title_words(line: str) -> bool:
    return bool(
        re.search(
            r"(?i)\b(recruit\w*|talent|hiring|people|hr|human|sourc\w*|partner|coordinator|manager|director|officer|lead|head|"
            r"consultant|advisor|assistant|specialist|acquisition|operations)\b.*[·|@,•]",
            line,
        )
    )


def _new_rows(bodies: list, summaries: list, senders: list) -> list[list[list[int]]]:
    out = []
    for body, summary, sender in zip(bodies, summaries, senders):
        of_body = carried_lines(body, sender or "") if body and body.strip() else []
        of_summary: list[int] = []
        if summary and summary.strip():
            if body and body.startswith(summary.rstrip()):
                last = summary.count("\n")
                filled = [bool(x.strip()) for x in summary.split("\n")]
                of_summary = [i for i in of_body if i <= last and filled[i]]
            elif "\n" in summary:
                of_summary = carried_lines(summary, sender or "")
        out.append([of_body, of_summary])
    return out


@F.arrow_udf(ArrayType(ArrayType(LongType())))
def _carried(body: pa.Array, summary: pa.Array, sender: pa.Array) -> pa.Array:
    rows = _new_rows(body.to_pylist(), summary.to_pylist(), sender.to_pylist())
    return pa.array(rows, pa.list_(pa.list_(pa.int64())))


@F.arrow_udf(ArrayType(LongType()))
def _carried_one(text: pa.Array, sender: pa.Array) -> pa.Array:
    rows = [carried_lines(t, s or "") if t else [] for t, s in zip(text.to_pylist(), sender.to_pylist())]
    return pa.array(rows, pa.list_(pa.int64()))


def new_text(text: Column, carried: Column) -> Column:
    """The text without the lines numbered in ``carried``."""
    lines = F.split(text, "\n")
    numbered = F.transform(lines, lambda x, i: F.struct(i.cast("bigint").alias("at"), x.alias("line")))
    kept = F.filter(numbered, lambda s: ~F.array_contains(carried, s["at"]))
    return F.trim(F.regexp_replace(F.array_join(F.transform(kept, lambda s: s["line"]), "\n"), r"\n{3,}", "\n\n"))


def newly_written(messages: DataFrame) -> DataFrame:
    """``messages`` with ``new_body``: only the sender's own new text."""
    marked = messages.withColumn("carried", _carried_one(F.col("body_text"), F.col("sender")))
    return marked.withColumn("new_body", new_text(F.col("body_text"), F.col("carried"))).drop("carried")


def found(message: DataFrame) -> DataFrame:
    """Rows (field, id, line_no) of lines that are not new text."""
    judged = message.select("id", _carried(F.col("body_text"), F.col("summary"), F.col("sender")).alias("lines"))
    fields = F.array(
        F.struct(F.lit("body_text").alias("field"), F.col("lines")[0].alias("at")),
        F.struct(F.lit("summary").alias("field"), F.col("lines")[1].alias("at")),
    )
    return (
        judged.select("id", F.explode(fields).alias("f")).where(F.size("f.at") > 0)
        .select("f.field", "id", F.explode("f.at").alias("line_no")).distinct()
    )
