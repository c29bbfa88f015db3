"""Training-data operators against brute force, the tokenizer library and small cases."""

import itertools
import random
import sys
from datetime import datetime
from itertools import chain

import pytest
from pyspark.sql import functions as F

from missive.llm import p1_new_text, p2_personal, p3_main_text, p4_residue, p5_entities, p6_survivor, p7_truncation
from missive.llm import p8_encode, p9_pack, p10_canonical

T0 = datetime(2025, 1, 2)


# -- 1 ---------------------------------------------------------------------------
MAIL = """Hello Ann,
The talk is on Friday.

On Mon, May 6, 2024 at 1:20 PM,
Bo Lind <bo@x.example>
wrote:
> Can you come?

Yes, gladly.

> And Tim?
Best regards,
Ann Berg
Recruiter | Xco
T: +1 212 555 0101

If you received it in error, please delete it and tell the sender."""


def test_p1_keeps_answers_between_quotes():
    lines = MAIL.split("\n")
    kept = [x for i, x in enumerate(lines) if x and i not in p1_new_text.carried_lines(MAIL)]
    assert kept == ["Hello Ann,", "The talk is on Friday.", "Yes, gladly."]


def test_p1_decoys_stay():
    text = "From: May 3 until June 5 I am away.\n---- agenda ----\nOn Tuesday the panel wrote: fine.\nThanks for the letter."
    assert p1_new_text.carried_lines(text) == []


def test_p1_forward_and_cut_summary(spark):
    body = "See below.\n\n-----Original Message-----\nFrom: A B <a@b.example>\nDate: 1/2/2024\n\nOld text\n"
    rows = spark.createDataFrame(
        [("m", "S", body, body[:24]), ("m", "S", body, body[:24]), ("n", None, None, None), ("e", "", "", "")],
        "id string, sender string, body_text string, summary string",
    )
    got = sorted((r.field, r.id, r.line_no) for r in p1_new_text.found(rows).collect())
    assert got == [("body_text", "m", i) for i in (2, 3, 4, 6)] + [("summary", "m", 2)]


# -- 2 ---------------------------------------------------------------------------
def test_p2_spans():
    labeler = p2_personal.Labeler(frozenset({"ann", "omar"}), frozenset({"berg", "holt"}))
    text = "Dear Ann, ask Dr. Holt or O. Berg (mail omar99 [at] x [dot] example, +49 (0)30 23125 111). SSN 919-41-1679. 12 Rowan Way, Apt 4, Elmstead, CO 00700. Ticket 448-4580-07."
    got = {(k, text[a:b]) for k, a, b, v, _ in labeler.spans(text) if not (k == "phone" and v & 8)}
    assert {("name", "Ann"), ("name", "Holt"), ("name", "O. Berg"), ("id_number", "919-41-1679")} <= got
    assert ("email", "omar99 [at] x [dot] example") in got and ("phone", "+49 (0)30 23125 111") in got
    assert ("address", "12 Rowan Way, Apt 4, Elmstead, CO 00700") in got
    assert not any("448" in t for _, t in got)


def test_p2_hints_pass_what_the_patterns_match():
    labeler, p = p2_personal.Labeler(frozenset(), frozenset()), p2_personal._p()
    streets = [
        "Nordring 12, 70173 Stuttgart", "Suedring 5", "Am Alter Weg\t3", "Lindenallee  4", "12 Long\nStreet", "9 Mill\r\nRow", "P.O. Box 77",
        "5 rue\nVerte, 75001 Paris", "Calle\nMayor, 3, 28013 Madrid", "Postfach 12",
    ]
    labels = [
        "tax\r\nid", "social\r\nsecurity", "social  security number", "NIE", "NIF", "DNI", "NI\tnumber", "national\ninsurance no.", "ID\ncard",
        "Identity  card", "personal\nid", "driver's licence", "Steuer-ID", "Personalausweis", "numéro\nde sécurité sociale", "passport #",
    ]
    for lead in ("", "(", "See ", "İ "):
        for text in (lead + x for x in streets):
            whole = {m.span() for q in p["addresses"] for m in q.finditer(text)}
            assert whole & {s[1:3] for s in labeler.spans(text) if s[0] == "address"}, text
        for text in (f"{lead}{x}: X1234567L" for x in labels):
            m = p["id"].search(text)
            assert m and m.start(1) in {s[1] for s in labeler.spans(text) if s[0] == "id_number"}, text


def test_p2_estimation_finds_reliable_labelers():
    rng = random.Random(1)
    counts: dict[int, int] = {}
    for _ in range(4000):
        true = rng.random() < 0.6
        votes = sum(1 << i for i, (on, off) in enumerate([(0.9, 0.05), (0.8, 0.1), (0.5, 0.4)]) if rng.random() < (on if true else off))
        counts[votes] = counts.get(votes, 0) + 1
    post = p2_personal.estimate(list(counts.items()))
    assert post[0b011] > 0.9 and post[0b100] < 0.5 and post[0b001] > post[0b100]


def test_p2_redaction_keeps_the_rest(spark):
    message = spark.createDataFrame(
        [("1", "Ann Berg", "ann.berg@x.example", "Write to ann.berg@x.example now", None), ("2", "", "", "", "nothing here")],
        "id string, sender string, sender_email string, body_text string, snippet string",
    )
    outreach = spark.createDataFrame([(1, "Omar Holt", "omar@y.example", "Ask Omar Holt")], "id long, person string, person_email string, summary string")
    got = {(r.src_table, r.rec_id, r.field): r.text for r in p2_personal.redacted(message, outreach).collect()}
    assert got["message", "1", "body_text"] == "Write to [EMAIL] now" and got["message", "2", "snippet"] == "nothing here"
    assert got["outreach", "1", "summary"] == "Ask [NAME]"


def test_p2_cues_end_where_the_span_begins():
    p = p2_personal._p()
    cues = {
        "phone_cue": (["Tel: ", "call you ", "línea móvil (", "am ☎ ", "M ", "t:\t", "ring\n", "at  ::\n"], ["tel. is it ", "item ", "at  ::::", "on it ", ""]),
        "code_cue": (["Ref12: ", "req.", "No. ", "$", "€ ", "licence: ", "Security Number "], ["ref a b ", "case one ", "$ . . ", ""]),
        "honorific": (["Mr. ", "mit Frau ", "\nSeñora\n"], ["mr ", "Amr. ", "Mr.", "Mr. A "]),
        "greeting": (["Dear ", "GUTEN Tag ", "buenos días  ", "hi dr. "], ["ahi ", "good ", "dear me ", "hello"]),
        "closing": (["Best regards,\n", "grüße\n> &gt; ", "--\n", "~~~ \n\n", "thanks!\r\n"], ["regards, ", "a --\n", "thanks a\n"]),
    }
    for name, (yes, no) in cues.items():
        assert [bool(p[name].match(x[::-1])) for x in yes + no] == [True] * len(yes) + [False] * len(no), name


def test_p2_numbers_are_found_once_for_all_patterns():
    p = p2_personal._p()
    for text in ("+1 (206) 555-0177, +(49) 30 1234567 or + (49) 30 7654321", "a5 x-5550126 (415/555-0126) +44 20 7946 0530\n0530 1",
                 "12 Old Mill Road 4 New St., Tarn, IL 00698 8575 Pelham Way\n+", "#12 Old Row 5-55 12345678 (1234567) ((030) 1234567"):
        numbers = [m.start() for m in p["number"].finditer(text)]
        for pattern, starts in ((p["phone"], p2_personal._openings(text, numbers)), (p["addresses"][0], numbers)):
            assert [m.span() for m in p2_personal._matches(pattern, text, starts)] == [m.span() for m in pattern.finditer(text)]


def test_p2_calls_per_text():
    """The labeler's work, as calls into functions: 393 before its cues were read backwards, numbers found once, and features kept by part."""
    labeler = p2_personal.Labeler(frozenset({"ann", "omar"}), frozenset({"berg", "holt"}))
    text = (
        "Dear Ann,\n\nOmar Holt and I would like to meet you. My direct line is (206) 555-0177, ticket 4155550126,\n"
        "the office is at 12 Old Mill Road, Tarnwick, IL 00698, or write to ann.berg@x.example.\n\nBest regards,\nBerg\n"
    )
    labeler.spans(text)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        labeler.spans(text)
    finally:
        sys.setprofile(None)
    assert calls < 340


def test_p2_mailboxes_of_any_length():
    labeler = p2_personal.Labeler(frozenset({"ann"}), frozenset({"berg"}))
    for size in (5, 79, 100, 3000):
        text = "mail " + "x" * size + "@a.example now"
        assert [(k, a, b) for k, a, b, *_ in labeler.spans(text)] == [("email", 5, 5 + size + 10)]
    assert [k for k, *_ in labeler.spans("İzmir\nANN BERG wrote")] == ["name"]
    assert labeler.spans("@") == [] and labeler.spans("") == []


def test_p2_labelers_that_are_not_asked_abstain():
    full, other = p2_personal.FULL_NAME, 0b00011001
    patterns = [(full, 900), (other, 50), (0b00000001, 50)]
    asked = p2_personal.estimate(patterns)
    spared = p2_personal.estimate(patterns, unasked={full: p2_personal.CONTEXT})
    # Names known by context are believed more if full names say nothing against context.
    assert spared[other] > asked[other] and spared[full] > 0.9


# -- 3 and 4 ---------------------------------------------------------------------
PAGE = """Jobs | Salaries | Sign in
We use cookies to keep this site running. Accept all
Reject
Our team needs an engineer, who likes long, clear sentences.
Requirements
R, Linux
Similar jobs
Data Scientist in Millrace
New
- You will own the cookie settings and privacy pages that customers see first.
Privacy policy
© 2025 Acme"""


def test_p3_furniture():
    lines = PAGE.split("\n")
    kept = [x for i, x in enumerate(lines) if i not in p3_main_text.furniture_lines(PAGE)]
    assert [x[:4] for x in kept] == ["Our ", "Requ", "R, L", "- Yo"]
    assert p3_main_text.furniture_lines("") == [] and p3_main_text.furniture_lines("Plain text only.") == []


def test_p3_unlisted_furniture_by_recurrence(spark, monkeypatch):
    head = "Explore | Opportunities | Community\nOur little biscuits keep the lights on, fine with you?\n\n"
    foot = "\nPastry cook at the Lakeside branch\nMade with care by the web folks of Zeta"
    body = lambda i: f"Duties\nYou bake {'abcdefghijklmnopqrstuvwxyz'[i] * 3} bread with two others, early in the day.\n- Knead dough {'abcdefghijklmnopqrstuvwxyz'[i]}"
    rows = [(i, "zeta.example", head + body(i) + foot) for i in range(12)] + [(100 + i, f"h{i}.example", body(i)) for i in range(20)]
    rows += [(200, "zeta.example", None), (201, None, ""), (202, "zeta.example", " ")]
    records = spark.createDataFrame([("job", str(i), h, t) for i, h, t in rows], "src_table string, rec_id string, host string, description string")
    for most in (p3_main_text.OWN_MOST, 0):
        monkeypatch.setattr(p3_main_text, "OWN_MOST", most)
        got = {int(r.rec_id): (r.furniture, r.main_text) for r in p3_main_text.clean_site_pages(records).collect()}
        for i in range(12):
            assert got[i] == ([0, 1, 6, 7], body(i)), got[i]
        assert all(got[100 + i] == ([], body(i)) for i in range(20)) and len(got) == 32
    assert p3_main_text.clean_site_pages(records.where("false")).count() == 0


def test_p3_digests_are_the_engine_s(spark):
    lines = ["", "  Jobs 12 | Menü\r", "straße 5", "\tTab", "日本 7", "x" * 100]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", p4_residue.digest(F.col("line")).alias("d"))
    assert all(r.d == p3_main_text.line_digest(r.line) for r in df.collect())


def test_p4_cases_and_decoys(spark):
    filler = "We build things for many people in many towns and pay well for it. " * 4
    rows = [
        ("1", "Join {{ city }} as our next {{ role }}."), ("2", "TBD\nTBD"), ("3", "You need to enable JavaScript to run this app."),
        ("4", filler + "\nYou hunt down 404 and 503 errors before customers notice them."), ("5", ""), ("6", None),
        ("7", filler + "\nYou maintain Mustache templates (the {{ }} kind) and ${HOME}-style variables."), ("8", filler),
        ("9", "Erreur 404 : la page demandée est introuvable."), ("9", "Erreur 404 : la page demandée est introuvable."),
    ]
    df = spark.createDataFrame([("job", i, "h", t) for i, t in rows], "src_table string, rec_id string, host string, description string")
    assert sorted(r.rec_id for r in p4_residue.residue(df).collect()) == ["1", "2", "3", "9"]
    assert p4_residue.residue(df.where("false")).count() == 0


def test_p4_slots_of_many_forms_and_postings_on_one_line(spark):
    body = "We build things for many people in many towns. We pay well for it. You work with two others. Letters are read on Monday."
    cases = [
        f"{body}\nYou report to [HIRING MANAGER] from [START DATE] on.", f"{body}\nStart: *|CITY|*", f"{body}\nJoin @@company_name@@ now.",
        f"{body}\nMeet <COMPANY_NAME>.", f"{body}\nDear $FIRST_NAME, hello.", f"{body}\nBei «Firma» im Team.", f"{body}\nxxx xxx xxx",
        "We'll be right back.", "This browser cannot run the app.", "İstanbul\nEnable JavaScript to continue",
        "Sign in\nSearch\nYour session has expired. Sign in again to see this posting.\nXco is an equal opportunity site.",
    ]
    whole = [f"{body} You hunt down 404 and 503 errors before anybody notices. {body}", f"{body}\n[Remote] [Sign in] costs $20K. «Guten Tag», sagt sie.",
             f"{body} • Access denied pages are yours to explain • You write code that helps many teams"]
    df = spark.createDataFrame(
        [("job", str(i), None, t) for i, t in enumerate(cases + whole)], "src_table string, rec_id string, host string, description string"
    )
    assert sorted(int(r.rec_id) for r in p4_residue.residue(df).collect()) == list(range(len(cases)))


def test_p4_hints_pass_what_the_patterns_match(spark):
    filler = "We build things for many people in many towns and pay well for it. " * 4
    cases = [
        "N/A", "n/a", "None", "nan", "Test", "Text", "foo bar", "test  test  test", "text\ttext\ttext", "null", "...\n...", "... \n\n...", "…\n …",
        "Enter job description here", "Add text here", "Insert your role here", "Scripts must run to show it.", "Enable script to go on.",
        "No eres un robot", "410 Page", "431 - unauthorized", "Example record: nothing", "Test entry. Nothing", "To be completed by HR",
        "Replace this before publication", "sed tempor\nincididunt ut\nlabore magna", "İ TBD\nTBD", "İ NOSCRIPT",
    ]
    whole = [filler + "\nTravel\nNone", filler + "\nVisa: see below\nN/A", "Test engineer for text and bar charts", filler + "\nTest"]
    rows = [("job", str(i), "h", x) for i, x in enumerate(cases + whole)]
    df = spark.createDataFrame(rows, "src_table string, rec_id string, host string, description string")
    got = {int(r.rec_id) for r in p4_residue.residue(df).collect()}
    assert [x for i, x in enumerate(cases) if i not in got] == []
    assert [x for i, x in enumerate(whole, len(cases)) if i in got] == []


# -- 5 ---------------------------------------------------------------------------
def test_p5_one_error_is_symmetric_and_exact():
    def distance(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    words = ["".join(w) for n in range(1, 5) for w in itertools.product("ab", repeat=n)]
    for a, b in itertools.product(words, words):
        assert p5_entities.one_error(a, b) == (distance(a, b) <= 1), (a, b)


def test_p5_links(spark):
    names = [
        "Kegazihor Health", "KEGAZIHOR HEALTH INC", "Kegazihor Hlth", "Health, Kegazihor", "Kegazhior Health", "Kegazihor", "Confidential", "n/a",
        "Minanodor Energy", "Minanodor Group", "Minanodor", " ",
    ]
    got = p5_entities.resolve(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    groups: dict[int, set[str]] = {}
    for r in got:
        groups.setdefault(r.cluster, set()).add(r.name)
    assert set(names[:6]) in groups.values()
    assert {"Minanodor Energy"} in groups.values() and {"Minanodor Group"} in groups.values()
    assert not {"Confidential", "n/a", " "} & {r.name for r in got}


def _clusters(spark, names):
    groups: dict[int, set[str]] = {}
    for r in p5_entities.resolve(spark.createDataFrame([(n,) for n in names], "name string")).collect():
        groups.setdefault(r.cluster, set()).add(r.name)
    return list(groups.values())


def test_p5_merged_profiles_ask_again(spark):
    # A misspelt twin doesn't keep a name from joining the one longer name it fits ...
    assert _clusters(spark, ["Kestrel Systems", "Kestral Systems", "Kestrel Systems Holdings"]) == [{"Kestrel Systems", "Kestral Systems", "Kestrel Systems Holdings"}]
    # ... a head that only a merged twin brings near is reached ...
    far = {"Kestrelo Energy", "Kestrel Energy", "Kestrelos"}
    assert far in _clusters(spark, [*far, "Minanodor Group"])
    # ... and what fits two organisations joins neither.
    apart = _clusters(spark, ["Kestrel", "Kestrel Energy", "Kestrel Foods", "Kestrel E. Grp"])
    assert {"Kestrel"} in apart and {"Kestrel Foods"} in apart


def test_p5_keys_meet_whatever_fits():
    lists = [["=energy"], ["!e"], ["?energy|engineering"], ["?energy|!eg"], ["!eg"], ["=energy", "=group"], ["!e", "!g"], ["=foods"], ["!f"], []]
    for short, long in itertools.product(lists, lists):
        if short and len(short) <= len(long) and p5_entities.fits(short, long):
            assert set(p5_entities.keys_asked(short)) & set(p5_entities.keys_offered(long)), (short, long)


# -- 6 ---------------------------------------------------------------------------
def test_p6_groups_follow_chains(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, 99), (7, 8), (8, 7)], "id long, duplicate_of long")
    got = sorted((r.id, r.root_id) for r in p6_survivor.groups(rows).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_p6_closest_to_consensus():
    values = ["we pay well and train you", "we pay well and teach you", "we pay well and train you now", "other text"]
    assert p6_survivor.closest(values, [1.0, 1.0, 1.0, 1.0]) == 0


def test_p6_preference_and_big_group(spark):
    job = spark.createDataFrame(
        [(1, None, "a", "1", "2024-01-01", "ok", T0), (2, 1, "b", "DOE", "2024-02-30", "error", T0), (3, 1, "b", "$90", "2099-12-31", "ok", T0)]
        + [(i, 1, "a", f"${i}", "2024-01-02", "ok", T0) for i in range(10, 60)],
        "id long, duplicate_of long, source string, salary string, posted_at string, scrape_status string, received_at timestamp",
    ).withColumn("description", F.concat(F.lit("text "), F.col("id").cast("string")))
    trust = spark.createDataFrame([("b", 1), ("a", 2)], "source string, trust_rank int")
    bad = spark.createDataFrame([(2,)], "id long")
    got = {r.field: r.job_id for r in p6_survivor.found(job, bad, trust).collect()}
    assert got == {"description": 3, "salary": 3, "posted_at": 1, "scrape_status": 3}
    assert p6_survivor.merged(job, bad, trust).count() == 4


# -- 7 ---------------------------------------------------------------------------
def test_p7_cut_and_whole(spark):
    whole = "We look for people who like long walks in the evening and good food"
    job = spark.createDataFrame(
        [(i, "s", whole + f". We also pay {i} euros.") for i in range(40)] + [(90, "s", whole[:-8]), (91, "s", whole[:-14]), (92, "s", "x"), (93, None, None)],
        "id long, source string, description string",
    )
    message = spark.createDataFrame([("m", "a@b.example", "The first half", "", "The first half and the second."), ("n", None, None, None, None)], "id string, sender_email string, summary string, reason string, body_text string")
    got = {(r.src_table, r.rec_id, r.field) for r in p7_truncation.found(job, message).collect()}
    assert ("message", "m", "summary") in got and ("job", "91", "description") in got and ("job", "5", "description") not in got


def test_p7_copies_and_repeated_rows_count_once(spark):
    hot = "We look for people who like long walks in the evening, good food and a quiet hour with a book at the end of the day"
    other = "Our small team builds tools for farms and dairies, and it wants a calm colleague with an eye for tidy and short code"
    cut = "You will plan the routes of nine boats on the lake, and in the evening you will see that it is bac"
    inner = [(200 + i, "s", f"Boat {'abcdefghij'[i]} of the lake is fine as it is back home now.") for i in range(10)]
    job = spark.createDataFrame(
        [(i, "s", hot) for i in range(60)] + [(90, "s", other[: len(hot)].ljust(len(hot), "y"))]
        + [(100 + i, "s", cut) for i in range(60)] + inner,
        "id long, source string, description string",
    )
    message = spark.createDataFrame([("m", "a@b.example", hot, hot, "")] * 30, "id string, sender_email string, summary string, reason string, body_text string")
    got = {(r.src_table, r.rec_id) for r in p7_truncation.found(job, message).collect()}
    # Neither the copies nor a text of their length are at a limit; copies of a cut text are no evidence of an end.
    assert got == {("job", str(100 + i)) for i in range(60)}


# -- 8 ---------------------------------------------------------------------------
def test_p8_equals_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(f"{p8_encode.VOCABULARY_DIR}/{p8_encode.VOCABULARY_FILE}")
    library.encode_special_tokens = True
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdefghijkl  aeiou<|>ßжあ\n\t\U0001f389") for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["", "a" * 3000, " " * 500 + "x", "<|endoftext|>", "é‍"]
    ours = [list(chain.from_iterable(w)) for w in p8_encode.encoder(f"{p8_encode.VOCABULARY_DIR}/{p8_encode.VOCABULARY_FILE}").encode_batch(texts)]
    assert ours == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_p8_null_empty_and_clashing_column(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in p8_encode.encode_corpus(rows).collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) == 1


# -- 9 ---------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(20))
def test_p9_plan_is_valid_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 100])
    histogram: dict[int, int] = {}
    for _ in range(rng.randint(1, 400)):
        s = rng.randint(1, capacity)
        histogram[s] = histogram.get(s, 0) + rng.choice([1, 1, 5])
    runs, used = p9_pack.plan(capacity, histogram)
    load, placed = [0] * used, {}
    for size, items, first, each in runs:
        for k in range(items):
            load[first + k // each] += size
        placed[size] = placed.get(size, 0) + items
    assert placed == histogram and max(load) <= capacity and min(load) > 0
    total = sum(s * n for s, n in histogram.items())
    large = sum(n for s, n in histogram.items() if 2 * s > capacity)
    assert used <= 1.25 * max(-(-total // capacity), large) + 1


def test_p9_pieces_cover_each_text(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "hello there", "word " * 900, "a b c"] + ["one two"] * 50)], "doc_id long, text string")
    kinds = spark.createDataFrame([("s", 64), ("s", 64), ("n", None)], "pack_name string, capacity_tokens int")
    rows = p9_pack.pack(docs, kinds).collect()
    assert {r.pack_name for r in rows} == {"s"}
    load: dict[int, int] = {}
    for r in rows:
        if r.n_tokens:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        else:
            assert r.container_id is None
    assert max(load.values()) <= 64 and sorted(load) == list(range(len(load)))
    long = sorted((r.piece_no, r.token_start, r.n_tokens) for r in rows if r.doc_id == 3)
    assert all(b[1] == a[1] + a[2] for a, b in zip(long, long[1:])) and all(p[2] == 64 for p in long[:-1])


# -- 10 --------------------------------------------------------------------------
def test_p10_same_and_different():
    c = p10_canonical.canonical_text
    for a, b in [("café", "café"), ("Ｆoo", "Foo"), ("ﬁne", "fine"), ("pаy", "pay"), ("a b", "a b"), ("a​b­", "ab"), ("Ваy", "Bay"), ("デ", "デ"), ("e‑m", "e-m")]:
        assert c(a) == c(b), (a, b)
    for a, b in [("x²", "x2"), ("cafe", "café"), ("Pay", "pay"), ("a-b", "a–b"), ("\U0001f469‍\U0001f4bb", "\U0001f469\U0001f4bb")]:
        assert c(a) != c(b), (a, b)
    russian = "наш дом"
    assert c(russian) == russian and c(c("pаy да")) == c("pаy да")


def test_p10_rarer_look_alikes():
    c = p10_canonical.canonical_text
    pairs = [("һello", "hello"), ("ԛuick", "quick"), ("ԝord", "word"), ("ӏine", "line"), ("ԁata", "data"), ("ɡo", "go"), ("teρm", "tepm"), ("օpen", "open"),
             ("\U0001d5a0\U0001d5ba1", "Aa1"), ("\U0001d670\U0001d7f6", "A0"), ("sհop", "shop")]
    for a, b in pairs:
        assert c(a) == c(b), (a, b)
    for a, b in [("\U0001d400", "A"), ("ρος", "pος"[::-1]), ("Հայ", "Zuj"), ("ℌ", "H")]:
        assert c(a) != c(b), (a, b)
    for text in ("Հայաստան է օր", "οδός ρόδα", "наш ӏ дом"):
        assert c(c(text)) == c(text)


def test_p10_classes(spark):
    docs = spark.createDataFrame([(1, "pay"), (2, "pаy"), (3, "pay"), (4, "no"), (5, None), (6, " "), (7, "no")], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_docs, r.n_variants) for r in p10_canonical.classes(docs).collect()}
    assert got == {1: (1, 3, 2), 2: (1, 3, 2), 3: (1, 3, 2)}
    assert p10_canonical.classes(docs.where("false")).count() == 0


def test_p10_pairs_against_brute_force(spark):
    texts = ["pay", "pаy", "pay", "café", "café", "cafe", "", " ", None, "x²", "x2", "pay "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_a, r.doc_b) for r in p10_canonical.look_alikes(docs).collect())
    form = lambda t: p10_canonical.canonical_text(t).strip()
    want = [(a, b) for (a, x), (b, y) in itertools.combinations(enumerate(texts), 2) if x and y and x.strip() and y.strip() and x != y and form(x) == form(y)]
    assert got == want
    assert p10_canonical.look_alikes(docs.where("false")).count() == 0
