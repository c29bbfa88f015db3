"""Classification of messages by ordered rules, as one expression.

A rule is a test of the subject, of subject and body together, of the sender or
of the number of postings found; the first that holds decides.  Two findings
come before all rules: codes and security notes, and receipts that ask nothing.
Every pattern is evaluated at most once a message.

Defined results: null texts count as empty; a message that no rule meets is
``other`` with confidence 0.3.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive import fixed
from missive.functions import fields


@dataclass(frozen=True)
class Rule:
    """``when`` names flags that must all hold; ``postings`` is the least number of them."""

    when: tuple[str, ...]
    category: str
    confidence: float
    reason: str
    postings: int = 0


#: Flags and their patterns; those of ``SUBJECT_FLAGS`` read the subject alone.
FLAGS = {
    "offer": fixed.OFFER, "rejection": fixed.REJECTION, "video": fixed.VIDEO_STEP, "interview": fixed.INTERVIEW,
    "assessment": fixed.ASSESSMENT, "next_step": fixed.NEXT_STEP, "login": fixed.LOGIN_CODE, "security": fixed.SECURITY,
    "submitted": fixed.SUBMITTED, "applied": fixed.APPLIED, "recruiter": fixed.RECRUITER, "marketing": fixed.MARKETING,
}
SUBJECT_FLAGS = {"alert": fixed.ALERT_SUBJECT}
CODE = ("other", 0.95, "login/security code")
RECEIPT = ("application_update", 0.85, "application acknowledgement")
# The rules in order.
RULES = (
    Rule(("board", "alert"), "job_alert", 0.95, "job board sender + alert subject"),
    Rule(("offer",), "offer", 0.9, "offer language"),
    Rule(("rejection",), "rejection", 0.85, "rejection language"),
    Rule(("video",), "next_step", 0.85, "recorded video round"),
    Rule(("interview",), "interview_invite", 0.85, "interview scheduling language"),
    Rule(("assessment",), "assessment", 0.85, "assessment language"),
    Rule(("next_step",), "next_step", 0.8, "asks you to complete a step"),
    Rule(("code",), *CODE),
    Rule(("receipt",), "application_update", 0.8, "application acknowledgement"),
    Rule(("board",), "job_alert", 0.9, "job board sender + posting links", 2),
    Rule((), "job_alert", 0.85, "{n} posting links extracted", 2),
    Rule(("alert",), "job_alert", 0.75, "alert subject with posting link", 1),
    Rule(("recruiter", "automated"), "recruiter_outreach", 0.6, "recruiter outreach language"),
    Rule(("recruiter",), "recruiter_outreach", 0.85, "recruiter outreach language"),
    Rule(("marketing",), "other", 0.7, "marketing/transactional"),
)


def board_sender(address: Column, senders: tuple[str, ...] = ()) -> Column:
    """Whether an address is one of ``senders`` or of a known board's domain or one below it."""
    low = F.lower(F.coalesce(address, F.lit("")))
    domain = F.substring_index(low, "@", -1)
    # The domain and what is above it, so that known hosts are looked up and not scanned.
    steps = F.split(domain, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, n, F.size(steps)), "."))
    known = F.arrays_overlap(above, F.array(*map(F.lit, fixed.JOB_HOSTS)))
    return known | low.isin(*(s.lower() for s in senders)) if senders else known


def classified(
    messages: DataFrame, subject: str, body: str, address: str, postings: Column, senders: tuple[str, ...] = ()
) -> DataFrame:
    """``messages`` with category, confidence, reason and email_type (columns of these names are replaced).

    Rules read the subject and the first ``fixed.RULE_TEXT`` characters of the body.
    """
    head = F.coalesce(F.col(subject), F.lit(""))
    blob = F.concat(head, F.lit("\n"), F.substring(F.coalesce(F.col(body), F.lit("")), 1, fixed.RULE_TEXT))
    rows = messages.withColumns({"_head": head, "_blob": blob, "_postings": F.coalesce(postings, F.lit(0))})
    flags = {f"_{n}": F.col("_blob").rlike(p) for n, p in FLAGS.items()} | {f"_{n}": F.col("_head").rlike(p) for n, p in SUBJECT_FLAGS.items()}
    flags |= {"_board": board_sender(F.col(address), senders), "_automated": F.coalesce(F.col(address), F.lit("")).rlike(fixed.NOREPLY)}
    rows = rows.withColumns(flags)
    rows = rows.withColumns({
        "_code": F.col("_login") | F.col("_security"), "_receipt": F.col("_submitted") | F.col("_applied"),
        "_asks": F.col("_interview") | F.col("_assessment") | F.col("_video") | F.col("_next_step"),
    })

    def label(category: str, confidence: float, reason: str) -> Column:
        before, number, after = reason.partition("{n}")
        told = F.concat(F.lit(before), F.col("_postings").cast("string"), F.lit(after)) if number else F.lit(reason)
        return F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), told.alias("reason"))

    case: Column | None = None
    for rule in RULES:
        holds = F.col("_postings") >= rule.postings
        for name in rule.when:
            holds = holds & F.col(f"_{name}")
        case = F.when(holds, label(rule.category, rule.confidence, rule.reason)) if case is None else case.when(
            holds, label(rule.category, rule.confidence, rule.reason)
        )
    by_rules = case.otherwise(label("other", 0.3, "no rule matched"))
    rows = rows.withColumn("_rules", by_rules)
    receipt = F.col("_receipt") & ~F.col("_asks") & (F.col("_rules.category") != "application_update")
    rows = rows.withColumn("_rules", F.when(F.col("_code"), label(*CODE)).when(receipt, label(*RECEIPT)).otherwise(F.col("_rules")))
    sort = fields.email_type(F.col("category"), F.col(subject), F.substring(F.coalesce(F.col(body), F.lit("")), 1, fixed.FIELD_TEXT))
    rows = rows.withColumns({n: F.col(f"_rules.{n}") for n in ("category", "confidence", "reason")})
    return rows.withColumn("email_type", F.when(F.col("_code"), "security").otherwise(sort)).drop("_head", "_blob", "_postings", "_rules", "_code", "_receipt", "_asks", *flags)
