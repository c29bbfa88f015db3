r"""Problem 7: texts that were cut, in pure SQL.

Word trigrams are counted inside texts against at ends (of a text or a line),
per field over all texts.  The last trigram of each text, without a cut mark
such as an ellipsis, is joined to those counts and to the trigrams that start
with it.  A text is cut if

* it is a mere beginning of the text it was taken from, where that is at hand
  (a summary copied from its body; one that equals its body is whole);
* it ends in a piece of markup or an entity;
* it ends in a mark, unless its last words customarily end texts;
* its last trigram is frequent inside and almost never terminal, or its last
  word is a mere beginning of words that customarily follow the two before;
* its length is one at which texts of its field pile up far beyond the
  lengths around it (a field limit), with or without final punctuation.

Trigram keys are 64-bit digests of the first two words with the third word, so
the large shuffle is the pre-aggregated count table.  Copies of a text count
once: in Spark each of k copies brings a weight of 1/k, and the weights' sum is
rounded, so no text is shuffled to find the different ones; the checking SQL
takes distinct texts.

Defined results: null and blank values are no cases; repeated rows of a message
and copies of a text count once (a value is a case if any of its rows is).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from missive.runtime import durable

#: A last word is a mere beginning if longer words follow the two before it so often,
#: and it ends texts or lines in at most this share.
LONGER_LEAST = 2
TERMINAL_MOST = 0.2
#: A last trigram of whole words is inner if seen so often inside, and at most this share at ends.
INSIDE_LEAST = 8
WHOLE_TERMINAL_MOST = 0.03
#: A length is a limit if it holds so many texts, and so many times the number around it.
LIMIT_LEAST = 6
LIMIT_RATIO = 5.0

LIMIT_SHORTEST = 100

#: Last words are read from so many last characters where these hold four words, else
#: from the whole text; marks, none of which is longer, from so many before trailing white space.
TAIL = 160
MARK_TAIL = 40
#: Texts that occur more than once are broadcast (8 bytes each, and a count) up to so many, else joined.
COPIES_MOST = 2_000_000
#: Values whose trigrams decide: those without closing or mark, and those that don't close before their mark.
TELLING = "c IS NOT NULL AND CASE WHEN marked THEN NOT bare_closed ELSE NOT closed END"
#: Contexts (two words) that some such ending asks for are broadcast (8 bytes each) up to so many, and spare
#: the counting of all other trigrams; beyond it all are counted, and the join drops them.
CONTEXTS_MOST = 2_000_000

# Marks that stand for text left out, by how sure a sign they are.
SURE_MARK = r"((\.\.\.|…) ?(more|mehr|suite|más)|\[(\.\.\.|…)\]|\((more|mehr|suite|más)\)|read more|weiterlesen|lire la suite|leer más|mehr lesen|continue reading)"
STYLE_MARK = r"(\.\.\.+|…)"
BROKEN_MARKUP = r"(&[a-z#0-9]{1,8}|</?[a-z][a-z0-9]{0,9}|</?)\s*\z"
CLOSED = r"[.!?。！？:;)\]\"”»>]\s*\z"


class _Dialect:
    """The few spellings in which the two SQL engines differ."""

    def __init__(self, spark: bool):
        self.spark = spark

    def text(self, pattern: str) -> str:
        if self.spark:
            # Braces are doubled because the statement is formatted with its tables.
            pattern = pattern.replace("\\", "\\\\").replace("{", "{{").replace("}", "}}")
        return "'" + pattern.replace("'", "\\'" if self.spark else "''") + "'"

    def like(self, value: str, pattern: str) -> str:
        return f"regexp_like({value}, {self.text(pattern)})" if self.spark else f"regexp_matches({value}, {self.text(pattern)})"

    def sub(self, value: str, pattern: str, new: str) -> str:
        return f"regexp_replace({value}, {self.text(pattern)}, '{new}'" + (")" if self.spark else ", 'g')")

    def words(self, value: str) -> str:
        return f"split({value}, ' ')" if self.spark else f"string_split({value}, ' ')"

    def size(self, value: str) -> str:
        return f"size({value})" if self.spark else f"len({value})"

    def item(self, array: str, one_based: str) -> str:
        return f"element_at({array}, {one_based})" if self.spark else f"{array}[{one_based}]"

    def digest(self, a: str, b: str) -> str:
        return f"xxhash64({a}, {b})" if self.spark else f"hash({a}, {b})"

    def trimmed(self, value: str) -> str:
        """Without trailing white space; only texts that end in some are searched for it."""
        return f"CASE WHEN {self.like(f'right({value}, 1)', chr(92) + 's')} THEN {self.sub(value, chr(92) + 's+' + chr(92) + 'z', '')} ELSE {value} END"

    def starts(self, value: str, head: str) -> str:
        return f"startswith({value}, {head})" if self.spark else f"starts_with({value}, {head})"

    def explode_trigrams(self) -> str:
        if self.spark:
            # Places are exploded, not trigrams: no structs are built.
            return (
                "SELECT field, weight, element_at(ws, i) AS a, element_at(ws, i + 1) AS b, "
                "CASE WHEN i + 2 = size(ws) THEN concat(element_at(ws, i + 2), '¶') ELSE element_at(ws, i + 2) END AS w "
                "FROM (SELECT field, weight, ws, explode(sequence(1, size(ws) - 2)) AS i FROM tokens WHERE size(ws) >= 3) AS z"
            )
        return (
            "SELECT field, weight, g.a AS a, g.b AS b, g.w AS w FROM (SELECT field, weight, unnest(list_transform(range(3, len(ws) + 1), lambda i: {'a': ws[i - 2], 'b': ws[i - 1], "
            "'w': CASE WHEN i = len(ws) THEN ws[i] || '¶' ELSE ws[i] END})) AS g FROM tokens WHERE len(ws) >= 3) AS z"
        )


def texts_sql(d: _Dialect) -> str:
    """All values to be judged: src_table, rec_id, field, origin, text, body (without white space at its end), beginning, same."""
    starts = d.starts("body_text", "rtrim(summary)")
    domain = "lower(regexp_replace(coalesce(sender_email, ''), '^.*@', ''))"
    return f"""
        SELECT *, {d.trimmed("text")} AS body FROM (
            SELECT 'job' AS src_table, CAST(id AS string) AS rec_id, 'description' AS field,
                   coalesce(source, '') AS origin, description AS text,
                   false AS beginning, false AS same FROM job
            UNION ALL SELECT 'message', id, 'summary', {domain}, summary,
                   coalesce({starts} AND length(rtrim(body_text)) > length(rtrim(summary)), false),
                   coalesce(rtrim(body_text) = rtrim(summary), false) FROM message
            UNION ALL SELECT 'message', id, 'reason', {domain}, reason, false, false FROM message
        ) AS t WHERE text IS NOT NULL AND trim(text) <> ''
    """


def _words(d: _Dialect, value: str) -> str:
    """Words of a text: digits alike, tabs to blanks, line ends kept as a mark on the word before."""
    flat = d.sub(f"replace(replace(trim(lower({value})), chr(9), ' '), chr(13), '')", "[1-9]", "0")
    return d.words(d.sub(flat, r"\n+", "¶ "))


def _ends_sql(d: _Dialect, source: str) -> str:
    """Texts with ``tail``, their last characters, and ``bare``, the same without a mark."""
    bare = d.sub(d.sub("tail", rf"(?i)({SURE_MARK}|{STYLE_MARK})\z", ""), r"\s+\z", "")
    return f"SELECT *, {bare} AS bare FROM (SELECT *, right(body, {MARK_TAIL}) AS tail FROM {source}) AS e"


#: A text without its mark.
_BARE = f"concat(substr(body, 1, greatest(length(body) - {MARK_TAIL}, 0)), bare)"
_BARE_TAIL = f"concat(substr(right(body, {TAIL}), 1, greatest(least(length(body), {TAIL}) - {MARK_TAIL}, 0)), bare)"


def prints_sql(d: _Dialect) -> str:
    """Different texts by digest, with what piles of lengths need: field, print, closed, n, k (copies)."""
    print_ = "xxhash64(field, text)" if d.spark else "text"
    return f"""
        SELECT field, print, closed, n, CAST(count(*) AS bigint) AS k FROM (
            SELECT field, {print_} AS print, {d.like("right(body, 1)", CLOSED)} AS closed, CAST(length(text) AS int) AS n FROM texts) AS p
        GROUP BY field, print, closed, n
    """


def finals_sql(d: _Dialect, asked: bool = False) -> str:
    """Every value with its ending: marks, the key ``c`` of its last trigram and its last word ``w``.

    With ``asked`` only records of ``asked``(rec_id, different ones); joined last, so that no text moves.
    """
    tail_words, size = _words(d, _BARE_TAIL), d.size("ws")
    only = " JOIN {asked} AS a ON f.rec_id = a.rec_id" if asked else ""
    return f"""
        SELECT f.* FROM (
            SELECT src_table, rec_id, field, origin, beginning, same, n, {d.like("right(tail, 1)", CLOSED)} AS closed,
                   length(bare) < length(tail) AS marked,
                   length(bare) < length(tail) AND {d.like("tail", rf"(?i){SURE_MARK}" + r"\z")} AS sure,
                   {d.like("tail", "(?i)" + BROKEN_MARKUP)} AS broken, {d.like("right(bare, 1)", CLOSED)} AS bare_closed,
                   CASE WHEN {size} >= 3 THEN {d.digest(d.item("ws", size + " - 2"), d.item("ws", size + " - 1"))} END AS c,
                   {d.item("ws", size)} AS w
            FROM (
                SELECT src_table, rec_id, field, origin, beginning, same, CAST(length(text) AS int) AS n, tail, bare,
                       CASE WHEN length(body) <= {TAIL} OR {d.size("tail_ws")} > 3 THEN tail_ws ELSE {_words(d, _BARE)} END AS ws
                FROM (SELECT *, {tail_words} AS tail_ws FROM ({_ends_sql(d, "texts")}) AS b) AS t
            ) AS t
        ) AS f{only}
    """


def _texts(d: _Dialect) -> str:
    texts = texts_sql(d)
    if d.spark:
        return texts.replace("FROM job", "FROM {job}").replace("FROM message", "FROM {message}")
    return texts.replace("AS string", "AS VARCHAR")


def judged_sql(spark: bool = True, hint: str = "", only: bool = False) -> str:
    """Every value with ``sign``, the first sign of a cut, or null: src_table, rec_id, field, origin, sign.

    Counts and limits are over all values, even where only some are judged.
    Spark's statement reads {job}, {message}, {prints} and {finals}; with ``only``
    it counts the trigrams of wanted contexts alone.
    """
    d = _Dialect(spark)
    trimmed = "rtrim('¶', w)" if spark else "rtrim(w, '¶')"
    ending = "endswith(w, '¶')" if spark else "ends_with(w, '¶')"
    wanted = " LEFT SEMI JOIN (SELECT c FROM {finals} WHERE " + TELLING + " GROUP BY c) AS q ON z.c = q.c" if only else ""
    chosen = "/*+ BROADCAST(q) */ " if only else ""
    if spark:
        counted = (
            f"SELECT {hint} t.field, 1 / coalesce(c.k, 1) AS weight, {_words(d, _BARE)} AS ws FROM ({_ends_sql(d, 'texts')}) AS t "
            "LEFT JOIN (SELECT print, k FROM {prints} WHERE k > 1) AS c ON xxhash64(t.field, t.text) = c.print"
        )
        first, finals, prints = "", "{finals}", "{prints}"
    else:
        different = _ends_sql(d, "(SELECT DISTINCT field, text, body FROM texts) AS d")
        counted = f"SELECT field, 1 AS weight, {_words(d, _BARE)} AS ws FROM ({different}) AS t"
        first, finals, prints = f"prints AS ({prints_sql(d)}), finals AS ({finals_sql(d)}),", "finals", "prints"
    return f"""
    WITH texts AS ({_texts(d)}), {first}
    tokens AS ({counted}),
    grams AS ({d.explode_trigrams()}),
    counts AS (
        SELECT field, c, {trimmed} AS w, CAST(sum(CASE WHEN {ending} THEN 0 ELSE n END) AS bigint) AS inside,
               CAST(sum(CASE WHEN {ending} THEN n ELSE 0 END) AS bigint) AS ending
        FROM (SELECT {chosen}field, c, w, CAST(round(sum(weight)) AS bigint) AS n
              FROM (SELECT field, weight, {d.digest("a", "b")} AS c, w FROM grams) AS z{wanted} GROUP BY 1, 2, 3) AS g
        GROUP BY 1, 2, 3
    ),
    lengths AS (SELECT field, closed, n, CAST(count(*) AS bigint) AS k FROM {prints} GROUP BY 1, 2, 3),
    around AS (
        SELECT field, closed, n, k,
               sum(k) OVER (PARTITION BY field, closed ORDER BY n RANGE BETWEEN 15 PRECEDING AND 4 PRECEDING) AS below,
               sum(k) OVER (PARTITION BY field, closed ORDER BY n RANGE BETWEEN 4 FOLLOWING AND 15 FOLLOWING) AS above
        FROM lengths
    ),
    limits AS (
        SELECT field, closed, n FROM around
        WHERE k >= {LIMIT_LEAST} AND n >= {LIMIT_SHORTEST}
          AND k >= {LIMIT_RATIO} * greatest(coalesce(below, 0), coalesce(above, 0)) / 12.0
    ),
    wanted AS (SELECT DISTINCT field, c, w FROM {finals} WHERE {TELLING}),
    known AS (
        SELECT q.field, q.c, q.w,
               max(CASE WHEN k.w = q.w THEN k.inside ELSE 0 END) AS inside,
               max(CASE WHEN k.w = q.w THEN k.ending ELSE 0 END) AS ending,
               sum(CASE WHEN k.w <> q.w THEN k.inside + k.ending ELSE 0 END) AS longer
        FROM wanted AS q JOIN counts AS k ON q.field = k.field AND q.c = k.c AND {d.starts("k.w", "q.w")}
        GROUP BY q.field, q.c, q.w
    ),
    weighed AS (
        SELECT f.*, coalesce(k.inside, 0) AS inside, coalesce(k.ending, 0) - 1 AS ending, coalesce(k.longer, 0) AS longer,
               l.n IS NOT NULL AS at_limit
        FROM {finals} AS f
        LEFT JOIN known AS k ON f.field = k.field AND f.c = k.c AND f.w = k.w
        LEFT JOIN limits AS l ON f.field = l.field AND f.closed = l.closed AND f.n = l.n
    )
    SELECT src_table, rec_id, field, origin,
           CASE WHEN same AND NOT beginning THEN NULL
                WHEN NOT (closed OR marked) AND inside >= {INSIDE_LEAST} AND ending <= {WHOLE_TERMINAL_MOST} * (inside + ending) THEN 'inner trigram'
                WHEN NOT (closed OR marked) AND inside = 0 AND longer >= {LONGER_LEAST} AND ending <= {TERMINAL_MOST} * (longer + ending)
                    THEN 'part of a word'
                WHEN beginning THEN 'beginning of its source'
                WHEN sure THEN 'mark'
                WHEN marked AND NOT bare_closed AND ending <= inside + longer + 1 THEN 'mark'
                WHEN broken THEN 'markup'
                WHEN at_limit THEN 'field limit'
           END AS sign
    FROM weighed
    """


def found_sql(spark: bool = True, hint: str = "", only: bool = False) -> str:
    return f"SELECT DISTINCT src_table, rec_id, field FROM ({judged_sql(spark, hint, only)}) AS j WHERE sign IS NOT NULL"


def rates_sql(spark: bool = True, hint: str = "", only: bool = False) -> str:
    return f"""
    SELECT src_table, field, origin, CAST(count(*) AS bigint) AS n_texts, CAST(sum(cut) AS bigint) AS n_cut,
           round(CAST(sum(cut) AS double) / count(*), 6) AS cut_share
    FROM (
        SELECT src_table, field, origin, rec_id, max(CASE WHEN sign IS NOT NULL THEN 1 ELSE 0 END) AS cut
        FROM ({judged_sql(spark, hint, only)}) AS j GROUP BY src_table, field, origin, rec_id
    ) AS r GROUP BY src_table, field, origin
    """


def signs_sql(spark: bool = True, hint: str = "", only: bool = False) -> str:
    return f"""
    SELECT src_table, field, sign, CAST(count(DISTINCT rec_id) AS bigint) AS n_cut
    FROM ({judged_sql(spark, hint, only)}) AS j WHERE sign IS NOT NULL GROUP BY src_table, field, sign
    """


def _run(statement, job: DataFrame, message: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``statement`` over the tables, after different texts and endings are known."""
    spark, d = job.sparkSession, _Dialect(True)
    tables = {"job": job, "message": message}
    with_texts = f"WITH texts AS ({_texts(d)}) "
    prints = durable(spark.sql(with_texts + prints_sql(d), **tables))
    more = {} if asked is None else {"asked": asked}
    finals = durable(spark.sql(with_texts + finals_sql(d, asked is not None), **tables, **more))
    hint = "/*+ BROADCAST(c) */" if prints.where("k > 1").count() <= COPIES_MOST else ""
    only = finals.where(TELLING).select("c").distinct().count() <= CONTEXTS_MOST
    return spark.sql(statement(hint=hint, only=only), **tables, prints=prints, finals=finals)


def cut_descriptions(job: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ``ids``(id) whose description in ``job`` was cut."""
    asked = ids.selectExpr("CAST(id AS string) AS rec_id").distinct()
    none = job.sparkSession.range(0).selectExpr("'' AS id", "'' AS sender_email", "'' AS summary", "'' AS reason", "'' AS body_text")
    cut = _run(found_sql, job, none, asked)
    return cut.where("src_table = 'job'").selectExpr("try_cast(rec_id AS bigint) AS id")


def found(job: DataFrame, message: DataFrame) -> DataFrame:
    """Cut values: src_table, rec_id, field."""
    return _run(found_sql, job, message)


def rates(job: DataFrame, message: DataFrame) -> DataFrame:
    """Share of cut values by field and source or sender domain."""
    return _run(rates_sql, job, message)


def signs(job: DataFrame, message: DataFrame) -> DataFrame:
    """How many values each sign found first, the trigrams before the others."""
    return _run(signs_sql, job, message)
