"""Problem 5: linking the spellings of one organisation.

Merge and rematch.  Each different name is parsed into a profile: its head (the
distinctive part, blanks inside removed) and its generic words ("systems",
"holdings"), each known in full, shortened ("Sys.", "Hldgs", "SW") or as an
initial.  Generic words are learnt from all names: words met beside many
different others.  Legal forms, case, order and separators don't matter.

* Profiles with equal parts merge at once, and so do complete profiles with the
  same generic words whose heads are one typing error apart.
* A cluster's profile is the union of its members': all their heads and all their
  lists of words, initials included.  It asks clusters whose profiles say more: of
  blocks that any of its heads reaches, those that every one of its lists of words
  fits.  If exactly one of the nearest does, the two merge.
* The richer profiles enter blocking again, until a round merges nothing.

Blocks are heads that share a one-letter deletion; as heads are different, a
block holds at most some dozens of letters times the places in a word.  Within a
head clusters meet on a word they share, never all with all; a cluster of a
bare head asks the head's least and greatest cluster, which tells whether
there is just one.  Heads of four letters or fewer have no typing errors.

Work is on different names and heads, so a company that fills a third of all
rows is one row here.

Defined results: null, blank and withheld names ("Confidential") give no pairs;
names equal after trimming but stored differently are different spellings.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from missive.runtime import durable

#: Bound of the learnt list of generic words, which every worker holds.
GENERIC_MOST = 2000
#: A word is generic if it stands beside so many different words, for so many of its names.
BESIDE_LEAST = 5
BESIDE_SHARE = 0.3

# Legal forms; words that name no organisation; common generic words.
LEGAL = frozenset(
    "inc incorporated llc ltd limited gmbh plc corp corporation co company lp llp ag sa sas sarl bv nv oy ab as kg kgaa mbh ug srl spa pty pte pvt".split()
)
NO_NAME = frozenset(
    "confidential undisclosed stealth anonymous private withheld unknown none null na tbd various hidden unnamed n/a - ? not disclosed "
    "vertraulich confidentiel confidencial".split()
)
NO_NAME_BESIDE = frozenset("client company employer startup start-up organisation organization firm name mode customer available applicable a an our the".split())
GENERIC = (
    "systems holdings group capital health energy robotics insurance logistics networks partners software services technologies "
    "analytics aerospace biotech education freight foods retail consulting laboratories materials manufacturing mobility media "
    "security international associates solutions industries global digital bank financial pharma medical engineering design"
).split()


def _plain(text: str) -> str:
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c))


def one_error(a: str, b: str) -> bool:
    """Equal, or one letter added, dropped, changed or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    short, long = (a, b) if len(a) < len(b) else (b, a)
    return short[i:] == long[i + 1 :]


def _within(short: str, long: str) -> bool:
    """Letters of ``short`` occur in ``long`` in order, from the first on."""
    if not short or short[0] != long[0]:
        return False
    at = iter(long)
    return all(c in at for c in short)


def tokens(name: str) -> list[tuple[str, bool]]:
    """Words of a name in natural order, with whether the word is marked as shortened."""
    text = _plain(name).strip()
    text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text)
    text = re.sub(r"(?<=[A-Za-z])\.(?=[A-Za-z]\b)|(?<=\b[A-Za-z])\.(?=[A-Za-z]\.)", "", text)
    parts = [p for p in text.split(",") if p.strip()]
    shouted = name.upper() == name
    words = lambda p: [(w.rstrip(".").lower(), w.endswith(".") or (len(w) <= 3 and w.isupper() and not shouted)) for w in re.findall(r"[^\W_]+\.?", p)]
    split = [words(p) for p in parts]
    if len(split) == 2 and not all(w in LEGAL for w, _ in split[1]):
        split = [split[1], split[0]]
    flat = [x for p in split for x in p]
    if len(flat) > 2 and flat[0][0] == "the" and flat[-1][0] in ("people", "folks", "guys", "team", "crew"):
        flat = flat[1:-1]
    if len(flat) > 1 and flat[0][0] == "the":
        flat = flat[1:]
    kept = [x for x in flat if x[0] not in LEGAL and x[0] != "and"]
    return kept or flat


class Parser:
    """Names to profiles; one per Python worker."""

    def __init__(self, generic: tuple[str, ...]):
        self.generic = dict.fromkeys([*generic, *GENERIC])
        self.words = list(self.generic)
        self.by_first: dict[str, list[str]] = {}
        for w in self.words:
            self.by_first.setdefault(w[0], []).append(w)
        self.cache: dict[tuple[str, bool], str | None] = {}

    def _generic(self, word: str, marked: bool) -> str | None:
        """``=word`` in full, ``?a|b`` shortened, ``!x`` initials; None if distinctive."""
        key = (word, marked)
        if key not in self.cache:
            self.cache[key] = self._read(word, marked)
        return self.cache[key]

    def _read(self, word: str, marked: bool) -> str | None:
        if word in self.generic:
            return "=" + word
        if len(word) == 1:
            return "!" + word
        if len(word) >= 4 and not marked:
            near = [w for w in self.words if abs(len(w) - len(word)) < 2 and len(w) >= 5 and one_error(word, w)]
            if near:
                return "=" + near[0]
        vowels = len(re.findall(r"[aeiou]", word))
        loose = marked or vowels == 0 or (vowels == 1 and len(word) >= 4)
        fits = [w for w in self.by_first.get(word[0], ()) if len(word) <= len(w) - 2 + marked and (w.startswith(word) or (loose and _within(word, w)))]
        prefix = [w for w in fits if w.startswith(word)]
        if len(word) >= 3 and prefix and (marked or len(word) <= 5):
            return "?" + "|".join(sorted(prefix))
        if fits and (marked or len(word) <= 6) and len(word) >= 2:
            strong = [w for w in fits if len(word) >= 3 or w[-1] == word[-1] or marked or len(word) == 2]
            if strong:
                return "?" + "|".join(sorted(strong)) + (f"|!{word}" if len(word) <= 3 else "")
        if len(word) <= 3 and not re.search(r"[aeiou]", word) or (marked and len(word) <= 3):
            return "!" + word
        # One error in a shortened word is no reason to take it for a head.
        if marked and len(word) <= 6:
            near = [w for w in self.words if len(word) <= len(w) - 1 and any(one_error(word, w[:n]) for n in (len(word) - 1, len(word), len(word) + 1))]
            if near:
                return "?" + "|".join(sorted(near))
        return None

    def parse(self, name: str) -> tuple[str, list[str]] | None:
        """(head, sorted generic words), or None if the value names no organisation."""
        found = tokens(name)
        plain = [w for w, _ in found]
        if not plain or not any(c.isalpha() for c in name):
            return None
        if plain[0] in NO_NAME or all(w in NO_NAME or w in NO_NAME_BESIDE for w in plain) or name.strip().lower() in NO_NAME:
            return None
        # A blank inside a word: two neighbours that together are generic.
        merged: list[tuple[str, bool]] = []
        for w, m in found:
            if merged and len(merged) > 1 and (merged[-1][0] + w) in self.generic and not (merged[-1][0] in self.generic and w in self.generic):
                merged[-1] = (merged[-1][0] + w, m)
            else:
                merged.append((w, m))
        # A head glued to its generic word.
        if len(merged) == 1:
            w = merged[0][0]
            tail = next((g for g in self.words if len(g) >= 5 and w.endswith(g) and len(w) - len(g) >= 5), None)
            if tail:
                merged = [(w[: -len(tail)], False), (tail, False)]
        read = [self._generic(w, m) for w, m in merged]
        # No name begins with a shortened word, but a blank may cut a head in two.
        if len(read) > 1 and read[0] is not None and read[0][0] != "=" and not merged[0][1]:
            read[0] = None
        if all(r is not None for r in read):
            # Nothing distinctive: the least generic word is the head.
            longest = max(range(len(merged)), key=lambda i: (len(merged[i][0]), -i))
            read[longest] = None
        head = "".join(w for (w, _), r in zip(merged, read) if r is None)
        return head, sorted(r for r in read if r is not None)


def _one_fits(a: str, b: str) -> bool:
    def options(x: str) -> set[str]:
        return set(x[1:].split("|")) if x[0] in "=?" else set()

    if a[0] in "=?" and b[0] in "=?":
        return bool(options(a) & options(b))
    if a[0] == "!" and b[0] == "!":
        return a == b
    word, initial = (a, b) if b[0] == "!" else (b, a)
    return len(initial) == 2 and any(o[0] == initial[1] for o in options(word) if o[0] != "!")


def fits(a: list[str], b: list[str]) -> bool:
    """Whether the shorter list of generic words can stand for (part of) the longer."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    # Joint initials ("RG." for Ridge Group) stand for several words.
    for x in short:
        joint = x[1:] if x[0] == "!" else next((o[1:] for o in x[1:].split("|") if o[:1] == "!"), "")
        if len(joint) > 1 and len(long) >= len(joint):
            first = [o[1] for o in long]
            if sorted(joint) == sorted(first):
                return True
    left = list(long)
    for x in short:
        hit = next((y for y in left if _one_fits(x, y)), None)
        if hit is None:
            return False
        left.remove(hit)
    return True


def _options(word: str) -> list[str]:
    return [o for o in word[1:].split("|") if o[:1] != "!"] if word[0] in "=?" else []


def _initials(word: str) -> list[str]:
    """Initials that a word is, or may be: one letter, or the first of joint ones."""
    return [word[1]] if word[0] == "!" else [o[1] for o in word[1:].split("|") if o[:1] == "!"]


def keys_asked(words: list[str]) -> list[str]:
    """Keys under which a list of words looks for lists it may fit: those of its first word."""
    if not words:
        return []
    found, own = _options(words[0]), _initials(words[0])
    return sorted({*(f"w{o}" for o in found), *(f"i{o[0]}" for o in found), *(f"i{x}" for x in own), *(f"o{x}" for x in own)})


def keys_offered(words: list[str]) -> list[str]:
    """Keys under which a list of words is found, by any of its words."""
    out: set[str] = set()
    for word in words:
        for o in _options(word):
            out |= {f"w{o}", f"o{o[0]}"}
        out |= {f"i{x}" for x in _initials(word)}
    return sorted(out)


_PROFILE = StructType([StructField("head", StringType()), StructField("words", ArrayType(StringType()))])
_KEYS = StructType([StructField("asked", ArrayType(StringType())), StructField("offered", ArrayType(StringType()))])


@F.arrow_udf(_KEYS)
def _keys(words: pa.Array) -> pa.Array:
    rows = [{"asked": keys_asked(w), "offered": keys_offered(w)} for w in words.to_pylist()]
    return pa.array(rows, pa.struct([("asked", pa.list_(pa.string())), ("offered", pa.list_(pa.string()))]))


def generic_words(names: DataFrame) -> tuple[str, ...]:
    """Words met beside many different others, over all names; at most GENERIC_MOST."""

    @F.arrow_udf(ArrayType(StringType()))
    def split(column: pa.Array) -> pa.Array:
        return pa.array([[w for w, _ in tokens(v) if len(w) > 2] for v in column.to_pylist()], pa.list_(pa.string()))

    words = durable(names.select("name", split("name").alias("ws")).where(F.size("ws") > 1))
    word = words.select("name", "ws", F.explode(F.array_distinct("ws")).alias("word"))
    used = durable(word.groupBy("word").agg(F.countDistinct("name").alias("n_names")))
    # Neighbours by their beginnings; one that also begins a commoner word than
    # this one is likely that word, shortened or misspelt.
    beside = (
        word.select("word", F.explode("ws").alias("other")).where("word <> other AND length(other) >= 4")
        .join(used.withColumnRenamed("word", "other").withColumnRenamed("n_names", "n_other"), "other")
        .groupBy("word", F.substring("other", 1, 4).alias("begins")).agg(F.max("n_other").alias("n_other"))
        .join(used, "word").where("n_other <= n_names")
        .groupBy("word").agg(F.count("*").alias("n_beside"))
    )
    rows = (
        used.join(beside, "word")
        .where((F.col("n_beside") >= BESIDE_LEAST) & (F.col("n_beside") >= BESIDE_SHARE * F.col("n_names")) & (F.length("word") >= 4))
        .orderBy(F.desc("n_beside"), "word").limit(GENERIC_MOST).select("word", "n_beside").collect()
    )
    found: dict[str, int] = {}
    for r in rows:
        # A misspelling of a far more common word is no word of its own.
        if len(r.word) >= 5 and not any(one_error(r.word, w) and r.n_beside < 0.05 * n for w, n in found.items()):
            found[r.word] = r.n_beside
    return tuple(w for w in found if not any(len(w) < len(o) and _within(w, o) for o in {*found, *GENERIC}))


def profiles(names: DataFrame) -> DataFrame:
    """(name, head, words, node) of each value that names an organisation."""
    generic = generic_words(names)

    @F.arrow_udf(_PROFILE)
    def parse(column: pa.Array) -> pa.Array:
        parser = Parser(generic)
        rows = [parser.parse(v) for v in column.to_pylist()]
        return pa.array([None if r is None else {"head": r[0], "words": r[1]} for r in rows], pa.struct([("head", pa.string()), ("words", pa.list_(pa.string()))]))

    return (
        names.select("name", parse("name").alias("p")).where("p IS NOT NULL AND p.head <> ''").select("name", "p.*")
        .withColumn("node", F.xxhash64("head", F.array_join("words", " ")))
    )


@F.arrow_udf(BooleanType())
def _fits(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([fits(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())])


def _near_heads(heads: DataFrame) -> DataFrame:
    """(head, other) one typing error apart, both ways, and each with itself; ``far`` 0 or 1."""
    size = F.length("head")
    drops = F.when(
        size >= 5,
        F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substr("head", F.lit(1), i - 1), F.substr("head", i + 1, size))),
    ).otherwise(F.array().cast("array<string>"))
    keys = heads.select("head", F.explode(F.array_distinct(F.array_union(F.array("head"), drops))).alias("key"))
    pairs = keys.join(keys.withColumnRenamed("head", "other"), "key").where("head <> other").select("head", "other").distinct()
    swapped = (F.levenshtein("head", "other") == 2) & (F.length("head") == F.length("other")) & (
        F.sort_array(F.split("head", "")) == F.sort_array(F.split("other", ""))
    )
    near = pairs.where((F.levenshtein("head", "other") <= 1) | swapped).withColumn("far", F.lit(1))
    return near.unionByName(heads.select("head", F.col("head").alias("other"), F.lit(0).alias("far")))


def _components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, cluster): the least node of each connected part, by propagation with pointer jumps."""
    labels = durable(nodes.select("node", F.col("node").alias("cluster")))
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if both.isEmpty():
        return labels
    while True:
        least = both.join(labels.select(F.col("node").alias("b"), "cluster"), "b").groupBy("a").agg(F.min("cluster").alias("best"))
        step = labels.join(least, labels.node == least.a, "left").select(
            "node", "cluster", F.least("cluster", F.coalesce("best", "cluster")).alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("cluster").alias("on"))
        step = durable(step.join(jump, "next", "left").select("node", "cluster", F.least("next", F.coalesce("on", "next")).alias("next")))
        labels = step.select("node", F.col("next").alias("cluster"))
        if step.where("next <> cluster").isEmpty():
            return labels


def resolve(names: DataFrame) -> DataFrame:
    """(name, cluster) of every value of ``names``(name) that names an organisation."""
    parsed = durable(profiles(names.where(F.col("name").rlike(r"\S")).distinct()))
    nodes = parsed.groupBy("node").agg(F.first("head").alias("head"), F.first("words").alias("words"))
    nodes = nodes.withColumn("keys", _keys("words")).withColumn("complete", (F.size("words") > 0) & F.forall("words", lambda w: F.startswith(w, F.lit("="))))
    near = durable(_near_heads(nodes.select("head").distinct()))
    # Complete profiles: equal words, heads one error apart.
    whole = nodes.where("complete").select("node", "head", F.array_join("words", " ").alias("key"))
    edges = (
        whole.select(F.col("node").alias("a"), "head", "key")
        .join(near.where("far = 1"), "head")
        .join(whole.select(F.col("node").alias("b"), F.col("head").alias("other"), "key"), ["other", "key"])
        .where("a < b").select("a", "b")
    )
    cluster = _components(edges, nodes)
    links = durable(edges)
    while True:
        fresh = durable(_offers(durable(nodes.join(cluster, "node")), near))
        if fresh.isEmpty():
            break
        links = durable(links.unionByName(fresh))
        cluster = _components(links, nodes)
    return parsed.select("name", "node").join(cluster, "node").select("name", "cluster")


def _offers(state: DataFrame, near: DataFrame) -> DataFrame:
    """Merges (a, b) of clusters of ``state``, as nodes: each asks with its whole profile."""
    # Heads that a cluster's heads reach, and how far.
    reach = (
        state.select("cluster", "head").distinct().join(near, "head")
        .groupBy("cluster", "other").agg(F.min("far").alias("far"))
    )
    lists = state.where("size(words) > 0").groupBy("cluster", "words").agg(F.max("complete").alias("complete"), F.first("keys").alias("keys"))
    wanted = lists.groupBy("cluster").agg(F.count("*").alias("n_lists"))
    asking = lists.select("cluster", "words", "complete", F.explode("keys.asked").alias("key")).join(reach, "cluster")
    offered = state.where("size(words) > 0").select(
        F.col("head").alias("other"), F.explode("keys.offered").alias("key"), F.col("cluster").alias("to"), F.col("words").alias("their"),
        F.col("complete").alias("sure"),
    ).distinct()
    met = (
        asking.join(offered, ["other", "key"])
        .where("to <> cluster AND size(their) >= size(words) AND (sure OR NOT complete)")
        .groupBy("cluster", "words", "to", "their").agg(F.min("far").alias("far"), F.max("sure").alias("sure"))
        .where(_fits("words", "their"))
    )
    fitting = (
        met.groupBy("cluster", "to", "words").agg(F.min("far").alias("far"), F.max("sure").alias("sure"))
        .groupBy("cluster", "to").agg(F.count("*").alias("k"), F.max("far").alias("far"), F.max("sure").alias("sure"))
        .join(wanted, "cluster").where("k = n_lists")
    )
    best = fitting.groupBy("cluster").agg(F.min("far").alias("nearest"))
    sure = F.max("sure").alias("any_sure")
    near_ones = fitting.join(best, "cluster").where("far = nearest")
    by_words = (
        near_ones.join(near_ones.groupBy("cluster").agg(sure), "cluster").where("sure OR NOT any_sure")
        .groupBy("cluster").agg(F.min("to").alias("least"), F.max("to").alias("most"))
    )
    # Bare heads: whether the nearest heads they reach are of one cluster.
    bare = reach.join(wanted, "cluster", "left_anti")
    per_head = offered.groupBy("other").agg(
        F.min("to").alias("least"), F.max("to").alias("most"), F.min(F.when(F.col("sure"), F.col("to"))).alias("sure_least"),
        F.max(F.when(F.col("sure"), F.col("to"))).alias("sure_most"),
    )
    by_head = (
        bare.join(per_head, "other").groupBy("cluster", "far")
        .agg(*(F.min(c).alias(c) if c.endswith("least") else F.max(c).alias(c) for c in ("least", "most", "sure_least", "sure_most")))
        .groupBy("cluster").agg(F.min_by(F.struct("least", "most", "sure_least", "sure_most"), "far").alias("m"))
        .select("cluster", F.coalesce("m.sure_least", "m.least").alias("least"), F.coalesce("m.sure_most", "m.most").alias("most"))
    )
    return by_words.unionByName(by_head).where("least = most").select(F.col("cluster").alias("a"), F.col("least").alias("b"))


def company_names(application: DataFrame, job: DataFrame, outreach: DataFrame) -> DataFrame:
    one = lambda df: df.select(F.col("company").alias("name"))
    return one(application).unionByName(one(job)).unionByName(one(outreach)).where("name IS NOT NULL AND name <> ''").distinct()


def found(application: DataFrame, job: DataFrame, outreach: DataFrame) -> DataFrame:
    """Pairs (name_a, name_b) of spellings of one organisation, name_a < name_b by code point."""
    linked = durable(resolve(company_names(application, job, outreach)))
    return (
        linked.select(F.col("name").alias("name_a"), "cluster")
        .join(linked.select(F.col("name").alias("name_b"), "cluster"), "cluster")
        .where("name_a < name_b").select("name_a", "name_b").distinct()
    )
