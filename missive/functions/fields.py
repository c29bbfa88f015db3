"""Fields of postings and letters read from free text, as column expressions.

Every extractor gives '' where it finds nothing, also for null.  Patterns and
labels are in ``missive.fixed``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from missive import fixed
from missive.functions import text as T


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _squeezed(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def _lookup(value: Column, table: dict[str, str], otherwise: Column) -> Column:
    case = reduce(lambda c, kv: c.when(value == kv[0], kv[1]), list(table.items())[1:], F.when(value == (first := next(iter(table))), table[first]))
    return case.otherwise(otherwise)


def employment(text: Column) -> Column:
    """Label of the first kind of employment that is named."""
    hit = F.regexp_extract(_text(text), fixed.EMPLOYMENT, 1)
    return F.when(hit == "", "").otherwise(_lookup(F.lower(F.regexp_replace(hit, r"\s+", " ")), fixed.EMPLOYMENT_LABELS, F.initcap(hit)))


def experience(text: Column) -> Column:
    """The first phrase that asks for years or a level, at most 80 characters."""
    return F.substring(_squeezed(F.regexp_extract(_text(text), fixed.EXPERIENCE, 1)), 1, 80)


def salary(text: Column) -> Column:
    """The first amount or range of pay, at most 80 characters."""
    return F.substring(_squeezed(F.regexp_extract(_text(text), fixed.SALARY, 0)), 1, 80)


def phone(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_extract(_text(text), T.PHONE, 0)), 1, 40)


#: Notes on the right to work: pattern, label, and words one of which each match holds; the first that matches counts.
VISA_RULES = (
    (fixed.CLEARANCE, fixed.VISA_LABELS[4], ("clearance", "ts/sci", "tssci", "polygraph", "active ")),
    (fixed.VISA_NO, fixed.VISA_LABELS[0], ("sponsor",)),
    (fixed.VISA_RESIDENT, fixed.VISA_LABELS[1], ("green card", "permanent resident", "uscis", "citizen")),
    (fixed.VISA_SPONSOR, fixed.VISA_LABELS[2], ("sponsor", "h1b", "h-1b", "h 1b")),
    (fixed.VISA_STUDENT, fixed.VISA_LABELS[3], ("opt", "cpt", "f1", "f-1", "f 1", "ead")),
)


def visa(text: Column) -> Column:
    """Label of the note on the right to work."""
    value = _text(text)
    case = F.lit("")
    for pattern, label, words in reversed(VISA_RULES):
        # Looking for words costs little, and few texts hold one.
        hinted = reduce(lambda a, w: a | F.contains(F.lower(value), F.lit(w)), words, F.lit(False))
        case = F.when(hinted & value.rlike(pattern), label).otherwise(case)
    return case


def visa_label(given: Column, text: Column) -> Column:
    """The label of a note and its text together; else the note itself if it is a label."""
    found = visa(F.concat(_text(given), F.lit("\n"), _text(text)))
    note = _squeezed(_text(given))
    return F.when(found != "", found).when(note.isin(*fixed.VISA_LABELS), note).otherwise("")


def state_of(location: Column, text: Column) -> Column:
    """A state's code or Remote: of the location, else of the beginning of the text."""
    place, words = _text(location), _text(text)
    code = F.regexp_extract(place, fixed.STATE, 1)
    far = F.concat(place, F.lit(" "), F.substring(words, 1, 1500)).rlike(fixed.REMOTE)
    return F.when(code != "", code).when(far, "Remote").otherwise(F.regexp_extract(F.substring(words, 1, 2000), fixed.STATE, 1))


def skills(text: Column, extra: tuple[str, ...] = (), most: int = 20) -> Column:
    """Names of common skills (and of ``extra``) that occur, in the order of the list, joined by commas."""
    low = F.lower(_text(text))
    names = list(dict.fromkeys([*fixed.SKILLS, *(e.lower() for e in extra)]))
    here = lambda n: low.rlike(rf"(^|[^a-z0-9]){n}([^a-z0-9]|$)") if len(n) <= 2 else F.contains(low, F.lit(n))
    found = F.array_compact(F.array(*(F.when(here(n), n) for n in names)))
    return F.array_join(F.slice(found, 1, most), ", ")


def source_type(source: Column, host: Column) -> Column:
    """job_board or official_career_site, by the board's name, else by the host; '' if neither is known."""
    name, at = F.lower(_text(source)), F.lower(_text(host))
    return (
        F.when(name.isin(*fixed.BOARD_SOURCES), "job_board")
        .when(name.isin(*fixed.OFFICIAL_SOURCES) | at.rlike("careers|jobs|workday"), "official_career_site")
        .when(name != "", "job_board").otherwise("")
    )


def posting_id(url_key: Column) -> Column:
    """What follows a key's first colon, at most 120 characters; a key without one as it is."""
    key = _text(url_key)
    return F.when(F.contains(key, F.lit(":")), F.substring(F.regexp_extract(key, r"(?s)^[^:]*:(.*)$", 1), 1, 120)).otherwise(key)


def email_type(category: Column, subject: Column, body: Column) -> Column:
    """Sort of a message of no other category: security, webinar, newsletter or unclassified."""
    blob = F.concat(_text(subject), F.lit("\n"), _text(body))
    sort = (
        F.when(blob.rlike(fixed.SECURITY) | blob.rlike(fixed.LOGIN_CODE), "security").when(blob.rlike(fixed.WEBINAR), "webinar")
        .when(blob.rlike(fixed.NEWSLETTER), "newsletter").otherwise("unclassified")
    )
    return F.when(category == "other", sort).otherwise("")


def scheduling_url(urls: Column, most: int = 400) -> Column:
    """The first of ``array<string>`` that leads to a calendar; '' if none."""
    host = lambda u: F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    known = lambda u: reduce(lambda a, h: a | F.contains(host(u), F.lit(h)), fixed.SCHEDULING_HOSTS, F.lit(False))
    hit = F.filter(urls, lambda u: known(u) | F.contains(F.lower(u), F.lit("calendly.com")) | F.contains(F.lower(u), F.lit("/book")))
    return F.substring(F.coalesce(F.get(hit, F.lit(0)), F.lit("")), 1, most)


FIELDS = (
    "source_type", "posting_id", "state", "salary", "employment_type", "visa_sponsorship", "experience_required", "required_skills", "posted_at",
)


def enriched(
    given: dict[str, Column], source: Column, host: Column, url_key: Column, location: Column, description: Column, extra: tuple[str, ...] = ()
) -> dict[str, Column]:
    """The fields of a posting: what is given, else what its text tells.  A visa note is always labelled anew."""
    blob = F.concat(_text(location), F.lit("\n"), _text(description))
    own = lambda name: given.get(name, F.lit(""))
    told = {
        "source_type": source_type(source, host),
        "posting_id": posting_id(url_key),
        "state": state_of(location, description),
        "salary": salary(blob),
        "employment_type": employment(blob),
        "experience_required": experience(blob),
        "required_skills": skills(blob, extra),
        "posted_at": F.regexp_extract(_text(description), T.DATE_ISO, 1),
    }
    filled = {name: F.when(_text(own(name)) != "", own(name)).otherwise(value) for name, value in told.items()}
    filled["visa_sponsorship"] = visa_label(own("visa_sponsorship"), blob)
    return {name: filled[name] for name in FIELDS}
