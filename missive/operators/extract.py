"""One mail to many postings: candidates, anchors, and the gates and merge of recovered rows.

Recovered rows come from outside as a relation; what is decided here is when
they are asked for, which of them stand on a link of the mail, and how they fill
what the rules left blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive import fixed
from missive.functions import digest
from missive.functions import text as T


def candidates(mails: DataFrame, key: str, markup: str, plain: str, name: str, address: str, subject: str, most: int = 40) -> DataFrame:
    """At most ``most`` postings of each mail: key, pos, url, url_key, title, company, location, source, context."""
    listed = digest.candidates(F.col(markup), F.col(plain), F.col(name), F.col(address), F.col(subject), most)
    return mails.select(key, F.posexplode(listed).alias("pos", "c")).select(key, F.col("pos").cast("int").alias("pos"), "c.*")


def anchors(mails: DataFrame, key: str, markup: str, most: int = 160) -> DataFrame:
    """Numbered links of each mail: key, idx, label, url, url_key, source, jobish, is_posting, role_like, title_like."""
    listed = F.slice(digest.anchors(F.col(markup)), 1, most)
    return mails.select(key, F.posexplode(listed).alias("idx", "a")).select(key, F.col("idx").cast("int").alias("idx"), "a.*")


def expected_postings(links: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """key and how many different titles a mail names: by its links' labels or by its lines, whichever are more.

    Where two labels or more read like roles, all labels that read like titles count.
    """
    print_ = lambda c: T.normalise_name(F.col(c))
    labels = links.select(key, print_("label").alias("print"), "role_like", "title_like").where("print <> ''")
    counted = labels.groupBy(key, "print").agg(F.max("role_like").alias("role"), F.max("title_like").alias("title")).groupBy(key).agg(
        F.count_if("role").alias("roles"), F.count_if("title").alias("titles")
    )
    lines = texts.select(key, F.explode(digest.role_lines(F.col(text))).alias("line")).select(key, print_("line").alias("print")).where("print <> ''")
    by_lines = lines.distinct().groupBy(key).agg(F.count("*").alias("lines"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    named = F.when(zero("roles") >= 2, zero("titles")).otherwise(zero("roles"))
    return counted.join(by_lines, key, "full").select(key, F.greatest(named, zero("lines")).alias("expected"))


def incomplete(found: DataFrame, links: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, n, expected, unclaimed, asks: whether the rules seem to have missed postings of a mail.

    They do if they found none, two or more fewer than expected, or left two
    posting links with a title unclaimed.
    """
    n = found.groupBy(key).agg(F.count("*").alias("n"))
    open_ = links.where("is_posting AND title_like").join(found.select(key, "url_key"), [key, "url_key"], "left_anti")
    unclaimed = open_.groupBy(key).agg(F.count("*").alias("unclaimed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = expected.join(n, key, "full").join(unclaimed, key, "left").select(key, zero("n"), zero("expected"), zero("unclaimed"))
    return rows.withColumn("asks", (F.col("n") == 0) | (F.col("expected") >= F.col("n") + 2) | (F.col("unclaimed") >= 2))


def grounded(recovered: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Recovered rows (key, pos, link, title, company, location) that stand on a link of the mail, or on none.

    A link that isn't in the mail's table drops the row.  The first title on a
    link has the link's key, other titles on it ``key#title``; rows without link
    are ``card:company:title``.
    """
    title, company = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("company", F.lit("")))
    rows = recovered.withColumn("title", title).withColumn("company", company)
    rows = rows.where(
        (F.length("title") >= 3) & (F.length("title") <= 200) & ~F.col("title").rlike(fixed.JUNK_TITLE) & ~F.col("title").rlike(fixed.APPLY_CALL)
        & ~F.startswith(F.lower("title"), F.lit("http"))
    ).withColumn("print", T.normalise_name(F.col("title")))
    named = links.select(key, F.col("idx").alias("link"), "url_key", "url", "source")
    linked = rows.where("link IS NOT NULL").join(named, [key, "link"])
    first = linked.groupBy(key, "url_key").agg(F.min_by("print", "pos").alias("first"))
    linked = linked.join(first, [key, "url_key"]).withColumn(
        "url_key", F.when(F.col("print") == F.col("first"), F.col("url_key")).otherwise(F.substring(F.concat("url_key", F.lit("#"), "print"), 1, 180))
    )
    card = F.concat(F.lit("card:"), F.coalesce(F.nullif(F.lower("company"), F.lit("")), F.lit("job")), F.lit(":"), F.col("print"))
    loose = rows.where("link IS NULL").select("*", F.substring(card, 1, 180).alias("url_key"), F.lit("").alias("url"), F.lit("").alias("source"))
    columns = [key, "pos", "url_key", "url", "title", "company", "location", "source"]
    both = linked.select(*columns).unionByName(loose.select(*columns))
    packed = F.struct(*columns)
    return both.groupBy(key, "url_key").agg(F.min_by(packed, "pos").alias("r")).select("r.*")


def merge_recovered(rules: DataFrame, recovered: DataFrame, keys: list[str], fill: list[str]) -> DataFrame:
    """Rows of the rules with blanks filled from recovered rows, and recovered rows of their own."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    r = recovered.select(*keys, *(F.col(c).alias(f"_{c}") for c in fill))
    joined = rules.withColumn("_own", F.lit(True)).join(r, keys, "full")
    return joined.select(
        *keys, *(F.coalesce(blank(F.col(c)), blank(F.col(f"_{c}")), F.lit("")).alias(c) for c in fill),
        F.coalesce("_own", F.lit(False)).alias("by_rules"),
    )


def asks_again(expected: Column, found: Column) -> Column:
    """Whether a second request is worth it: something was found, but three or more are still missing."""
    return (found > 0) & (expected - found >= 3)
