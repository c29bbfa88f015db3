"""Problem 3: the main body of a page, without the site's furniture.

The stored value is the page's text, so its tree is rebuilt from lines: the
page holds blocks (lines between furniture), blocks hold paragraphs.  Every
paragraph earns points for its length and commas, discounted by its link
density, which is the share of it made of link labels (menu entries, button
texts, link lists).  Blocks with points, or else the first, are kept, and what scores nothing beside
furniture goes with it.  A widget's heading takes its entries along, wherever in
the posting it stands.

Two things tell furniture: wording, and recurrence, whatever the wording: a line
that stands on so many pages of a host, and on far more of them than on other
hosts' pages, is the host's own (``RECUR_RECORDS``, ``RECUR_SHARE``, ``RECUR_LIFT``).
Points don't compete against the best block,
since sentences of a posting that stand alone between furniture score as little
as furniture of unknown wording (figures in the README).

One pass per text inside a vectorised UDF; lines repeat across pages of a host,
so their judgements are cached per worker.  Lines are counted once, for this problem and problem 4,
combined map-side on 64-bit digests.

Defined results: null, empty and blank texts have no furniture lines; line
numbers count the '\\n' of the stored value; blank lines are never reported.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from missive.llm import p4_residue
from missive.runtime import durable

CONTENT_LENGTH = 25
#: A line is its host's own if at least so many of the host's pages have it, such a share of
#: them, and so many times the share of other hosts' pages.
RECUR_RECORDS = 5
RECUR_SHARE = 0.02
RECUR_LIFT = 5.0
CACHE_LINES = 200_000

# Labels of menus, buttons and page feet in four languages.
LABELS = """
home|jobs|job search|companies|salaries|sign in|sign up|log in|login|log out|register|join now|join|post a job|for employers|
employers|search|menu|my profile|profile|my account|account|saved jobs|saved|alerts|job alerts|about us|about|life at the company|
teams|our teams|blog|news|newsroom|events|english (us)|english (uk)|english|toggle navigation|navigation|skip to main content|
skip to content|skip navigation|main content|locations|students|graduates|help|help center|help centre|faq|support|career advice|
careers|contact|contact us|press|media|investors|investor relations|suppliers|partners|whistleblowing|privacy|privacy policy|
privacy notice|privacy settings|terms|terms of use|terms of service|terms and conditions|imprint|legal|legal notice|
accessibility|sitemap|site map|cookie choices|cookie settings|cookie policy|cookies|change region|change language|report a bug|
top of page|back to top|do not sell my data|do not sell my personal information|follow us on social media|follow us|
download our app|get the app|settings|reject|reject all|accept|accept all|accept cookies|allow all|decline|manage consent|
manage preferences|manage cookies|confirm my choices|save my choices|save preferences|strictly needed (always on)|
performance (off)|advertising (off)|functional (off)|advertisement|sponsored|share|share this job|share this page|email|copy link|
print|save|save job|save this job|apply now|apply|easy apply|quick apply|apply on company site|report this posting|report this job|report|
see more|show more|view all|view all jobs|see all jobs|more jobs|load more|next|previous|new|close|follow|follow company|send|
subscribe|unsubscribe|yes|no|your email|email address|enter your email address|enter your email|upload your cv|
upload your resume|not the right fit?|write a review|listen to this page|text size a a a|text size|deutsch|français|español|
italiano|english version|got it|ok, got it|learn more|fine / no thanks|be among the first to apply|was this page helpful?|
similar jobs|recommended for you|people also viewed|you may like|you may also like|related jobs|trending searches|
company snapshot|get alerts for jobs like this|need help? visit the help centre|all trademarks belong to their owners.|
social media|facebook|twitter|linkedin|instagram|youtube|xing|
startseite|stellen|stellenangebote|unternehmen|für arbeitgeber|arbeitgeber|standorte|suche|merkliste|anmelden|registrieren|
zum inhalt springen|über uns|karriere|hilfe|impressum|datenschutz|agb|kontakt|barrierefreiheit|nach oben|nutzungsbedingungen|
presse|merken|drucken|teilen|stelle teilen|stelle melden|jetzt bewerben|bewerben|jobs per e-mail erhalten|jetzt abonnieren|
abonnieren|ihre e-mail|e-mail-adresse eingeben|e-mail-adresse|e-mail|ähnliche stellen|das könnte sie interessieren|
alle akzeptieren|ablehnen|einstellungen|auswahl speichern|cookie-einstellungen|mehr anzeigen|weiter|zurück|neu|senden|newsletter|
accueil|offres|offres d'emploi|entreprises|recherche|rechercher|recruteurs|connexion|se connecter|créer un compte|mes alertes|
aller au contenu|à propos|mentions légales|confidentialité|plan du site|contact presse|haut de page|retour en haut|imprimer|
signaler|partager|partager cette offre|enregistrer|postuler|recevoir les offres par e-mail|s'abonner|votre e-mail|
votre adresse e-mail|offres similaires|tout accepter|refuser|gérer mes choix|paramètres|voir plus|suivant|précédent|nouveau|
envoyer|aide|conditions d'utilisation|gestion des cookies|accessibilité|
inicio|empleos|ofertas|empresas|para empresas|buscar|entrar|iniciar sesión|crear cuenta|alertas|mis alertas|ir al contenido|sobre nosotros|
quiénes somos|aviso legal|privacidad|contacto|prensa|mapa del sitio|volver arriba|compartir|compartir oferta|imprimir|guardar|
denunciar|inscribirse|recibe ofertas por correo|suscribirse|tu correo|tu correo electrónico|correo electrónico|
empleos similares|ofertas similares|aceptar todo|rechazar|configurar preferencias|configuración|ver más|siguiente|anterior|
enviar|ayuda|términos de uso|accesibilidad|política de cookies
""".replace("\n", "").split("|")

# Wording of consent banners, counters, page feet and widget lines.
FURNITURE = [
    r"cookies?\b.*\b(accept|reject|allow|agree|polic|consent|settings$|got it|bake|remember you|choose which|functional|akzeptieren|accepter|aceptar|verwenden|utilis|usamos)",
    r"^(we use|this (site|website) uses|our (site|website|pages) uses?|by (using|continuing|browsing)|before you continue|hungry for) .*\b(cookies?|consent|storage|identifiers|trackers?|accept|agree)\b",
    r"\b(allow|accept|reject) all (trackers?|cookies)\b|\btrackers?\b.*\b(allow|only needed|none at all)\b",
    r"^your privacy matters\b|^we value your (choices|privacy)|^gdpr notice\b|^privacy notice\b",
    r"\b(stores?|storing|read|access)\b.*\b(on|to) your device\b|\bpartners store\b|\bvendors? ask for access\b",
    r"^(ihre auswahl zum datenschutz|wir verwenden cookies|diese (seite|website) (verwendet|nutzt|speichert))",
    r"\b(déposent|dépose) des traceurs|^(ce site|nous utilisons des cookies)\b.*\b(cookies|traceurs|choix|audience)",
    r"^(este sitio (guarda|usa|utiliza)|usamos cookies|utilizamos cookies)",
    r"^(jobs?|stellen\w*|offres|empleos|careers|home|karriere|startseite|accueil|inicio|ofertas)\s*[>»/›→]\s*\S.*[>»/›→]\s*\S",
    r"^[\w ]{2,30}\s*[>»›→]\s*[\w ]{2,30}\s*[>»›→]\s*\S[^.]{1,60}$",
    r"^(jobs?|stellen|offres|empleos)\s*[>»›→]\s*\S",
    r"^(©|\(c\)|copyright)\s*(\d{4}|[-–]|\w)",
    r"^\W*©",
    r"\ball rights reserved\b|\balle rechte vorbehalten\b|\btous droits réservés\b|\btodos los derechos reservados\b",
    r"^\S.{0,60} HQ, \S.{0,40}$",
    r"^.{2,80} is an equal opportunity site\b",
    r"^version \d+(\.\d+)*$|^powered by\b|^\d+ (applicants?|views?|bewerber|candidats|candidatos|vues|aufrufe|visitas)$",
    r"^(posted|updated|published) (\d+|a|an|one|yesterday|today)\b.{0,20}(ago|yesterday|today)?$",
    r"^(veröffentlicht|publiée?|publicado) .{0,30}$",
    r"^size: \d[\d\-– ]*(people|employees)|^rating \d+(\.\d+)? (of|out of|/) \d|^founded:? \d{4}$",
    r"^language: \w+$|^(sprache|langue|idioma): \w+$",
    r"^subscribe to (the|our) .{0,40}(newsletter|list|mail)s?$",
    r"^browse (by (city|skill|company|category|title):|\d+ (openings|jobs) in )",
    r"^compare salaries for |^sign in to see who you know|^see who .{0,20}you know|^get (job )?alerts\b|^create (a )?job alert\b",
    r"^(remote )?[\w+#. ]{1,40} jobs( in [\w\- ]+)?$",
    r"^need help\?|^visit the help cent|^not the right fit\?|^was this (page|job|posting) (helpful|useful)\?",
    r"^want more (jobs|offers)|^be the first to|^share (this|on)\b.{0,20}$|^report (this|a)\b.{0,20}$|^upload your\b",
    r"^tags?: |^categor(y|ies): |^\d+ (jobs|results|openings) (found|in)\b",
]

# Substrings of the lower-cased line without which no wording that may
# stand anywhere in a line can match.
ANYWHERE_HINTS = (
    "cookie|tracker|device|partners store|vendor|reserved|vorbehalten|réservés|reservados|traceurs"
).split("|")

# Headings of postings' own sections.
SECTION = (
    r"(?i)^\W*(the role|your (tasks|profile|role|responsibilities|skills|mission)|day to day|responsibilities|requirements|"
    r"what (you|we) [\w' ]{2,30}|who you are|you (have|bring|are|will)|must have|nice to have|qualifications|benefits|perks|"
    r"good to know|about (the )?(role|job|position|team|you)|skills|duties|tasks|we offer|how to apply|das (erwartet|bringen) sie.*|"
    r"ihre? (aufgaben|profil)|wir bieten|gut zu wissen|anforderungen|aufgaben|le poste|votre profil|vos missions|avantages|"
    r"compétences attendues|nous offrons|profil recherché|missions|qué harás|requisitos|funciones|tu perfil|ofrecemos|beneficios|"
    r"el puesto|il ruolo|requisiti)\s*:?$"
)
# Nouns that end the title of a job.
ROLE = (
    r"(engineer|developer|analyst|scientist|architect|administrator|manager|designer|writer|steward|statistician|consultant|"
    r"specialist|lead|director|officer|assistant|technician|programmer|researcher|coordinator|intern|nurse|clerk|planner)s?"
)
# Widget headings whose following entries are links to other postings.
LISTS = (
    r"(?i)^\W*(similar jobs|recommended (for you|jobs)|people also viewed|you may (also )?like|related jobs|more (jobs|openings)\b.*|"
    r"ähnliche stellen|das könnte sie interessieren|offres similaires|empleos similares|ofertas similares|trending searches|"
    r"popular searches|latest jobs|other openings\b.*)\W*$"
)


@lru_cache(maxsize=1)
def _patterns() -> dict:
    labels = sorted({x.strip() for x in LABELS if x.strip()}, key=len, reverse=True)
    one = "|".join(re.escape(x) for x in labels)
    return {
        "labels": set(labels),
        "all_labels": labels,
        # A run of labels joined by blanks, bars, dots, brackets or bullets.
        "run": re.compile(rf"(?i)[\W_]*(?:(?:{one})(?![\w'])[\W_]*)+"),
        "first": {re.split(r"[^\w'?]+", x)[0] for x in labels},
        "anchored": re.compile("(?i)" + "|".join(f"(?:{p})" for p in FURNITURE if p.startswith("^"))),
        "anywhere": re.compile("(?i)" + "|".join(f"(?:{p})" for p in FURNITURE if not p.startswith("^"))),
        "section": re.compile(SECTION),
        "list": re.compile(LISTS),
        "entry": re.compile(
            rf"(?i)^\W*([\w/+#&\- ]+ {ROLE}|{ROLE})\W*(\s(in|at|-|–|/)\s.{{2,40}}|\s?\(.{{2,40}}\)|,\s.{{2,60}}|\s?/\s?.{{2,40}})?$"
        ),
        "word": re.compile(r"[\w']+\??"),
        "sentence": re.compile(r"[.!?…:](?:\s|$)|^\s*[-–•·*◦▪]\s+\S"),
        "bullet": re.compile(r"^\s*[-–•·*◦▪‣]\s+"),
    }


NAV, LIST, SECTION_HEAD, CONTENT, SHORT, BLANK = range(6)


def judge(line: str) -> tuple[int, float, bool]:
    """(kind, points, may be a list entry) of one stripped line, out of context."""
    if not line:
        return BLANK, 0.0, False
    p = _patterns()
    low = line.lower()
    n = len(line)
    bullet = line[0] in "-–•·*◦▪‣" and p["bullet"].match(line) is not None
    if n < 60 and p["section"].match(line):
        return SECTION_HEAD, 1.0, False
    if n < 60 and p["list"].match(line):
        return LIST, 0.0, False
    links = 0
    if (word := p["word"].search(low)) is None or word.group() in p["first"]:
        links = m.end() if (m := p["run"].match(line)) else 0
        if links == n:
            return NAV, 0.0, low.strip(" []*") in ("new", "see more", "see all jobs", "neu", "nouveau", "nuevo")
    if not bullet and n < 400 and (
        p["anchored"].match(line) or (any(h in low for h in ANYWHERE_HINTS) and p["anywhere"].search(line))
    ):
        return NAV, 0.0, True
    entry = bool(not bullet and n < 70 and line[-1] != "." and p["entry"].match(line))
    density = links / n
    if density > 0.6 and n < 120:
        # A menu whose last label was cut or is unknown.
        return NAV, 0.0, entry
    points = (1 + min(n // 100, 3) + line.count(",")) * (1 - density)
    if bullet or n >= CONTENT_LENGTH or p["sentence"].search(line):
        return CONTENT, points, entry
    return SHORT, points / 4, entry


_cache: dict[str, tuple[int, float, bool]] = {}


def _judged(line: str) -> tuple[int, float, bool]:
    found = _cache.get(line)
    if found is None:
        if len(_cache) > CACHE_LINES:
            _cache.clear()
        found = _cache[line] = judge(line)
    return found


def _cut_label(line: str) -> bool:
    """A last line that a cut left of a label or of a run of labels."""
    p, low = _patterns(), line.lower().strip(" [*·|•-")
    if not low or len(line) > 120:
        return False
    if any(x.startswith(low) for x in p["all_labels"]):
        return True
    words = line.split()
    return any(
        (m := p["run"].match(head := " ".join(words[:-k]))) is not None and m.end() == len(head)
        for k in range(1, min(4, len(words)))
    )


def furniture_lines(text: str, recurring: frozenset[int] = frozenset()) -> list[int]:
    """Numbers of the lines of a page text that are not part of its main body; ``recurring`` ones are its host's own."""
    lines = [x.strip() for x in text.split("\n")]
    judged = [_judged(x) for x in lines]
    if recurring:
        judged = [(NAV, 0.0, j[2]) if i in recurring and j[0] not in (SECTION_HEAD, BLANK) else j for i, j in enumerate(judged)]
    drop = [k in (NAV, LIST) for k, _, _ in judged]
    last = next((i for i in range(len(lines) - 1, -1, -1) if lines[i]), None)
    if last is None:
        return []
    filled = [i for i, x in enumerate(lines) if x]
    # Entries of link lists go with their heading.
    inside = False
    for i in filled:
        kind, _, entry = judged[i]
        if kind == LIST:
            inside = True
        elif inside and (entry or drop[i]):
            drop[i] = True
        else:
            inside = False
    if not any(drop):
        return []
    at = filled.index(last)
    if not drop[last] and at and drop[filled[at - 1]] and judged[last][0] in (SHORT, CONTENT) and _cut_label(lines[last]):
        drop[last] = True
    # Blocks between furniture, and their points.
    blocks: list[list[int]] = []
    for n, i in enumerate(filled):
        if drop[i]:
            continue
        if n and not drop[filled[n - 1]]:
            blocks[-1].append(i)
        else:
            blocks.append([i])
    score = [sum(judged[i][1] for i in b if judged[i][0] in (CONTENT, SECTION_HEAD)) for b in blocks]
    if blocks:
        best = max(range(len(blocks)), key=lambda b: score[b])
        real = [b for b in range(len(blocks)) if score[b] > 0]
        for b, block in enumerate(blocks):
            # Bare short lines between parts of the body belong to it; at the
            # page's ends they belong to the furniture beside them.
            between = real and real[0] < b < real[-1] and not any(judged[i][2] for i in block)
            if b != best and score[b] <= 0 and not between:
                for i in block:
                    drop[i] = True
    return [i for i in filled if drop[i]]


#: Hosts' own lines travel with the function that judges pages up to so many (8 bytes each), beyond it by a join.
OWN_MOST = 200_000

_DIGITS = re.compile(r"[0-9\r]+")


def line_digest(line: str) -> int:
    """The digest of ``p4_residue.line_counts`` of a line."""
    value = xxhash.xxh64(_DIGITS.sub("", line.lower()).strip(" ").encode(), seed=42).intdigest()
    return value - (1 << 64) if value >> 63 else value


def _judge_pages(own: dict[str, frozenset[int]]):
    @F.arrow_udf(ArrayType(LongType()))
    def judge(texts: pa.Array, hosts: pa.Array, recurring: pa.Array) -> pa.Array:
        out = []
        for text, host, known in zip(texts.to_pylist(), hosts.to_pylist(), recurring.to_pylist()):
            lines = frozenset(known or ())
            if text and (digests := own.get(host or "")):
                lines |= {i for i, x in enumerate(text.split("\n")) if line_digest(x) in digests}
            out.append(furniture_lines(text, lines) if text else [])
        return pa.array(out, pa.list_(pa.int64()))

    return judge


def furniture(text: Column, host: Column | None = None, own: dict[str, frozenset[int]] | None = None, recurring: Column | None = None) -> Column:
    """``array<bigint>`` of furniture line numbers.

    ``own``: digests of lines that are a host's own, by host; ``recurring``: an array of the numbers of such lines.
    """
    none = F.lit(None)
    return _judge_pages(own or {})(
        text, none.cast("string") if host is None else host, none.cast("array<bigint>") if recurring is None else recurring
    )


def own_lines(records: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, digest) of the lines that are a host's own, by the records' ``line_counts``."""
    per_host = p4_residue.filled(records).groupBy("host").agg(F.count("*").alias("of_host"))
    total = p4_residue.filled(records).agg(F.count("*").alias("total")).scalar()
    often = counts.where(F.col("n") >= RECUR_RECORDS).join(per_host, "host").where(F.col("n") >= RECUR_SHARE * F.col("of_host"))
    # Only digests that are frequent somewhere are summed over all hosts.
    everywhere = counts.join(often.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.sum("n").alias("n_all"))
    elsewhere = (F.col("n_all") - F.col("n")) / F.greatest(total - F.col("of_host"), F.lit(1))
    blank = F.xxhash64(F.lit(""))
    return (
        often.join(everywhere, "digest").where((F.col("n") / F.col("of_host") >= RECUR_LIFT * elsewhere) & (F.col("digest") != blank))
        .select("host", "digest")
    )


def judged(records: DataFrame, counts: DataFrame) -> DataFrame:
    """``records`` (src_table, rec_id, host, description) that hold text, with ``furniture``, by wording and by their hosts' own lines."""
    own = durable(own_lines(records, counts))
    pages = p4_residue.filled(records)
    if own.count() <= OWN_MOST:
        by_host: dict[str, set[int]] = {}
        for r in own.collect():
            by_host.setdefault(r.host, set()).add(r.digest)
        known = {h: frozenset(d) for h, d in by_host.items()}
        return pages.withColumn("furniture", furniture(F.col("description"), F.col("host"), known))
    lines = pages.select("src_table", "rec_id", "host", F.posexplode(F.split("description", "\n")).alias("at", "line"))
    lines = lines.select("src_table", "rec_id", "host", F.col("at").cast("bigint").alias("at"), p4_residue.digest(F.col("line")).alias("digest"))
    hits = lines.join(own, ["host", "digest"]).groupBy("src_table", "rec_id").agg(F.collect_set("at").alias("recurring"))
    joined = pages.join(hits, ["src_table", "rec_id"], "left")
    return joined.withColumn("furniture", furniture(F.col("description"), recurring=F.col("recurring"))).drop("recurring")


def main_text(text: Column) -> Column:
    """The text without its furniture lines."""
    lines = F.split(text, "\n")
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda s: ~F.array_contains(F.col("furniture"), s["at"].cast("bigint")))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda s: s["line"]), "\n"), r"^\s+|\s+\z", "")


def clean_pages(pages: DataFrame, text: str = "description") -> DataFrame:
    """``pages`` with ``furniture`` and ``main_text``, by wording alone; columns of these names are replaced."""
    return pages.withColumn("furniture", furniture(F.col(text))).withColumn("main_text", main_text(F.col(text)))


def clean_site_pages(records: DataFrame) -> DataFrame:
    """``records`` (src_table, rec_id, host, description) that hold text, with ``furniture`` and ``main_text``."""
    return judged(records, durable(p4_residue.line_counts(records))).withColumn("main_text", main_text(F.col("description")))


def found(job: DataFrame) -> DataFrame:
    """Rows (id, line_no), without the records that are cases of problem 4."""
    records = p4_residue.job_records(job)
    counts = durable(p4_residue.line_counts(records))
    cases = p4_residue.residue(records, counts=counts)
    return (
        judged(records, counts).select("src_table", "rec_id", "furniture").where(F.size("furniture") > 0)
        .join(cases, ["src_table", "rec_id"], "left_anti")
        .select(F.col("rec_id").try_cast("bigint").alias("id"), F.explode("furniture").alias("line_no"))
    )
