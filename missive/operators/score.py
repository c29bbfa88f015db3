"""Scoring of texts against a weighted profile.

The profile is a literal; nothing is broadcast, joined or shuffled.  Words and
skill hits are columns of their own, so that a text is tokenised once and every
term sought once however many scores read them.  Null texts score like empty ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive import fixed
from missive.functions import fields
from missive.functions import text as T


@dataclass(frozen=True)
class Profile:
    """What a text is scored against; all comparisons are in lower case."""

    text: str
    skills: tuple[tuple[str, float, tuple[str, ...]], ...]
    titles: tuple[str, ...] = ()
    title_words: tuple[str, ...] = ()
    excluded_titles: tuple[str, ...] = ()
    excluded_words: tuple[str, ...] = ()
    #: Labels of ``fields.visa`` that rule a posting out.
    excluded_notes: tuple[str, ...] = ()
    places: tuple[str, ...] = ()
    remote_ok: bool = True
    most_years: int = 5
    senders: tuple[str, ...] = ()
    weights: tuple[float, float, float] = (0.40, 0.35, 0.25)
    #: Coverage and cosine at which a component is full, and what years and places take off.
    full_coverage: float = 0.45
    full_cosine: float = 0.30
    years_grace: int = 2
    years_malus: float = 0.15
    place_malus: float = 0.10
    least_score: float = 0.45


#: A profile for queries and tests.
EXAMPLE = Profile(
    text=(
        "data engineer with python sql spark kafka airflow and postgres; built streaming joins, warehouse schemas, quality dashboards "
        "and pricing models; machine learning with pytorch, pandas and statistics; docker kubernetes aws"
    ),
    skills=(
        ("python", 3.0, ("pandas", "numpy")),
        ("sql", 3.0, ("postgres", "snowflake", "dbt")),
        ("spark", 2.0, ("hadoop", "flink")),
        ("machine learning", 2.0, ("pytorch", "tensorflow")),
        ("aws", 1.0, ("gcp", "azure")),
        ("docker", 1.0, ("kubernetes", "terraform")),
        ("r", 1.0, ()),
    ),
    titles=("data engineer", "ml engineer", "data scientist", "nlp engineer"),
    title_words=("data", "ml", "nlp", "analytics", "scientist"),
    excluded_titles=("manager", "director", "head of"),
    excluded_words=("commission only", "unpaid"),
    excluded_notes=("No sponsorship",),
    places=("tarnwick", "velden", "ny"),
)


def profile_terms(profile: Profile) -> dict[str, int]:
    """Token counts of the profile's text, with the tokeniser's rules."""
    counts: dict[str, int] = {}
    for token in re.findall(T.TOKEN, profile.text.lower()):
        if token not in T.STOPWORDS:
            counts[token] = counts.get(token, 0) + 1
    return counts


def cosine(words: Column, profile: Profile) -> Column:
    """Cosine of square-rooted token counts: sum of sqrt(a*b) over the roots of the totals.

    ``words`` should be a column, not an expression, as it is read more than once.
    """
    terms = profile_terms(profile)
    if not terms:
        return F.lit(0.0)
    # Only the few words that are the profile's own are counted; the norm needs the number of all.
    # One loop over them keeps the generated code small enough to be compiled.
    roots = F.create_map(*(x for t, n in terms.items() for x in (F.lit(t), F.lit(sqrt(n)))))
    own = F.filter(words, lambda w: w.isin(*terms))
    part = lambda t: F.sqrt((F.size(own) - F.size(F.array_remove(own, t))).cast("double")) * F.element_at(roots, t)
    summed = F.aggregate(F.array_sort(F.array_distinct(own)), F.lit(0.0), lambda a, t: a + part(t))
    return F.when(F.size(words) > 0, summed / (F.sqrt(F.size(words).cast("double")) * sqrt(sum(terms.values())))).otherwise(0.0)


def stands_alone(term: str) -> bool:
    """Short and odd terms count only as words of their own."""
    return len(term) <= 3 or not term.isalnum()


def alone_pattern(terms: list[str]) -> str:
    return f"(^|[^a-z0-9])({'|'.join(map(re.escape, terms))})([^a-z0-9]|$)"


def has_any(low: Column, terms: tuple[str, ...]) -> Column:
    """Whether a lower-cased text holds any of the terms."""
    alone = [t for t in terms if stands_alone(t)]
    parts = [F.contains(low, F.lit(t)) for t in terms if not stands_alone(t)] + ([low.rlike(alone_pattern(alone))] if alone else [])
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def skill_hits(low: Column, profile: Profile) -> Column:
    """``array<boolean>``: whether each skill of the profile occurs in a lower-cased text."""
    return F.array(*(has_any(low, (name, *others)) for name, _, others in profile.skills))


def coverage(hits: Column, profile: Profile) -> Column:
    """Share of the skills' weight that ``hits`` found."""
    total = sum(s[1] for s in profile.skills)
    got = [F.when(F.get(hits, F.lit(i)), s[1]).otherwise(0.0) for i, s in enumerate(profile.skills)]
    return sum(got[1:], got[0]) / total if total else F.lit(0.0)


def skill_names(hits: Column, profile: Profile, found: bool) -> Column:
    """Names of the skills found, or not found, in the profile's order, joined by commas."""
    names = F.array(*(F.when(F.get(hits, F.lit(i)) == found, s[0]) for i, s in enumerate(profile.skills)))
    return F.array_join(F.array_compact(names), ", ")


def title_words(folded: Column) -> Column:
    """Different words of a folded title that carry weight."""
    words = F.regexp_extract_all(folded, F.lit("[a-z0-9+#]+"), 0)
    return F.filter(words, lambda w: ~w.isin(*fixed.WEAK_TITLE_WORDS))


def folded(title: str) -> str:
    """``text.fold_title`` of a literal."""
    t = re.sub(r"[/-]", " ", re.sub(r"ai[/-]ml", " ai ml ", title.lower()))
    for long, short in T.TITLE_FOLDS.items():
        t = re.sub(rf"\b{long}\b", f" {short} ", t)
    return " ".join(t.split())


def wanted_title(low: Column, fold: Column, words: Column, profile: Profile) -> Column:
    """Whether a title holds a wanted one, as written, folded, or word by word in any order."""
    hit = F.lit(False)
    for target in profile.titles:
        own = [w for w in dict.fromkeys(re.findall(r"[a-z0-9+#]+", folded(target))) if w not in fixed.WEAK_TITLE_WORDS]
        hit = hit | F.contains(low, F.lit(target)) | F.contains(fold, F.lit(folded(target)))
        if own:
            hit = hit | (F.size(F.array_except(F.array(*map(F.lit, own)), words)) == 0)
    return hit


def with_title_score(rows: DataFrame, title: str, profile: Profile) -> DataFrame:
    """``rows`` with title_score (1 for a wanted title, .75 or .5 for two or one wanted words, .35 for none given, else .1) and title_excluded."""
    low = F.lower(F.trim(F.coalesce(F.col(title), F.lit(""))))
    rows = rows.withColumn("_low", low).withColumn("_fold", T.fold_title(F.col("_low"))).withColumn("_title", title_words(F.col("_fold")))
    n = sum(((has_any(F.col("_low"), (w,)) | has_any(F.col("_fold"), (w,))).cast("int") for w in profile.title_words), F.lit(0))
    rows = rows.withColumn("_n", n).withColumn("_wanted", wanted_title(F.col("_low"), F.col("_fold"), F.col("_title"), profile))
    tier = (
        F.when(F.col("_low") == "", 0.35).when(F.col("_wanted"), 1.0).when(F.col("_n") >= 2, 0.75).when(F.col("_n") == 1, 0.5).otherwise(0.1)
    )
    bad = F.col("_low").rlike(alone_pattern(list(profile.excluded_titles))) if profile.excluded_titles else F.lit(False)
    return rows.withColumn("title_score", tier).withColumn("title_excluded", bad).drop("_low", "_fold", "_title", "_n", "_wanted")


def worth_reading(rows: DataFrame, title: str) -> Column:
    """Whether a scored title deserves a look at its page: half a hit or more, a whole one for students' jobs."""
    student = F.coalesce(F.col(title), F.lit("")).rlike(fixed.STUDENT_TITLE)
    return ~F.col("title_excluded") & (F.col("title_score") >= 0.5) & (~student | (F.col("title_score") >= 1.0))


def place_ok(place: Column, text: Column, profile: Profile) -> Column:
    """Whether a place, or the beginning of the text, names a wanted place or remote work."""
    blob = F.lower(F.concat_ws(" ", F.coalesce(place, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, 2000)))
    if not profile.places:
        return F.lit(True)
    ok = reduce(lambda a, p: a | F.contains(blob, F.lit(p)), profile.places, F.lit(False))
    return ok | blob.rlike(fixed.REMOTE_HINT) if profile.remote_ok else ok


SCORES = ("score", "title_score", "skill_score", "resume_score", "matched_skills", "missing_skills", "verdict", "rejected", "matched")


def matched(rows: DataFrame, profile: Profile, title: str, description: str, location: str, company: str) -> DataFrame:
    """``rows`` with ``SCORES``; columns of these names are replaced.

    A posting with an excluded word, note or title is rejected: it scores 0 with
    no components.  Scores are rounded to three digits, halves up.
    """
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    rows = rows.withColumn("_text", F.concat_ws("\n", c(title), c(company), c(location), c(description)))
    rows = rows.withColumn("_small", F.lower("_text"))
    word = F.lit("")
    for w in reversed(profile.excluded_words):
        word = F.when(F.contains(F.col("_small"), F.lit(w)), w).otherwise(word)
    rows = with_title_score(rows, title, profile).withColumns({
        "_hits": skill_hits(F.col("_small"), profile), "_words": T.tokens(F.col("_text")), "_word": word, "_note": fields.visa(F.col("_text")),
        "_years": T.years_required(F.col(description)), "_place": place_ok(F.col(location), F.col(description), profile),
    })
    why = (
        F.when(F.col("_word") != "", F.concat(F.lit("rejected: contains '"), "_word", F.lit("'")))
        .when(F.col("_note").isin(*profile.excluded_notes), F.concat(F.lit("rejected: "), F.lower("_note")))
        .when(F.col("title_excluded"), "rejected: excluded title").otherwise("")
    )
    one = F.lit(1.0)
    rows = rows.withColumns({
        "_why": why, "_skill": F.least(one, coverage(F.col("_hits"), profile) / profile.full_coverage),
        "_resume": F.least(one, cosine(F.col("_words"), profile) / profile.full_cosine),
    })
    a, b, d = profile.weights
    late = F.when(F.col("_years") > profile.most_years + profile.years_grace, profile.years_malus).otherwise(0.0)
    far = F.when(F.col("_place"), 0.0).otherwise(profile.place_malus)
    raw = a * F.col("title_score") + b * F.col("_skill") + d * F.col("_resume") - late - far
    ok = F.col("_why") == ""
    kept = lambda value: F.when(ok, value).otherwise(0.0)
    told = F.format_string("title %.2f / skills %.2f / resume %.2f", "title_score", "_skill", "_resume")
    years = F.when(F.col("_years") > 0, F.format_string(" / wants %dy", "_years")).otherwise("")
    rows = rows.withColumns({
        "score": kept(F.round(F.least(one, F.greatest(F.lit(0.0), raw)), 3)), "skill_score": kept(F.round("_skill", 3)),
        "resume_score": kept(F.round("_resume", 3)), "rejected": ~ok,
        "matched_skills": F.when(ok, skill_names(F.col("_hits"), profile, True)).otherwise(""),
        "missing_skills": F.when(ok, skill_names(F.col("_hits"), profile, False)).otherwise(""),
        "verdict": F.when(ok, F.concat(told, years)).otherwise(F.col("_why")),
    }).withColumn("title_score", kept(F.col("title_score")))
    rows = rows.withColumn("matched", ~F.col("rejected") & (F.col("score") >= profile.least_score))
    return rows.drop("_text", "_small", "_hits", "_words", "_word", "_note", "_years", "_place", "_why", "_skill", "_resume", "title_excluded")


def promoted(score: Column, title: Column, rejected: Column, page_ok: Column, profile: Profile) -> Column:
    """The score of a strong title whose page came back empty, lifted to the least that matches."""
    return F.when(~page_ok & ~rejected & (title >= 0.75) & (score < profile.least_score), profile.least_score).otherwise(score)
