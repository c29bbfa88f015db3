from pyspark.sql import functions as F

from missive.functions import html, pages

BODY = "You plan shifts with two others and answer for the ward. " * 6


def page(body, title="Clerk", extra=""):
    return f"<html><head><title>{title}</title>{extra}</head><body><nav>Menu<p>Home</nav><main>{body}</main><form>Apply</form><footer>Imprint</footer></body></html>"


def test_body_without_chrome():
    got = pages.read_body(page(f"<h1>Clerk</h1><p>{BODY}</p><aside>More</aside>", extra="<meta property='og:site_name' content='Zeta'>"))
    assert got["status"] == "ok" and got["company"] == "Zeta" and got["description"] == f"Clerk\n{BODY.strip()}"


def test_the_longest_candidate_is_the_body():
    got = pages.read_body(f"<div class='details'>short</div><div>outside</div><section class='Job'><p>{BODY}</p></section>")
    assert got["description"] == BODY.strip()
    assert pages.read_body("<div class='details'>short</div><div>outside</div>")["description"] == "short\noutside"


def test_walls_stopovers_and_forms():
    status = lambda *a, **k: pages.read_body(page(*a, **k))["status"]
    assert status("Please solve the CAPTCHA") == "blocked" and status(BODY + BODY * 6 + "captcha") == "ok"
    assert status(BODY, title="Page not found") == "empty" and status("indicates a required field") == "empty" and status("") == "empty"
    assert pages.read_body(page("You are now being redirected to Zeta Works."))["company"] == "Zeta Works"
    assert status("Skip to content Home Select language") == "empty" and status("Skip to content Select language Requirements: two years") == "ok"


def test_jsonld_comes_first_and_nulls_stay(spark):
    df = spark.createDataFrame([(page(BODY),), (None,), ("",), ("<main><p>open",)], "h string")
    rows = [r.p for r in df.select(html.page_fields(F.col("h")).alias("p")).collect()]
    assert rows[0].extraction == "html" and rows[0].status == "ok" and rows[1] is None and rows[2].status == "empty" and rows[3].description == "open"


def test_forward_to(spark):
    cases = ['{"widget": "redirect", "url": "/en/x"}', "If you are not redirected click <a class=b href='https://z.example/1'>here</a>",
             "<meta http-equiv='refresh' content='0; url=https://z.example/2'>", "nothing", None]
    df = spark.createDataFrame([(c,) for c in cases], "h string")
    assert [r.u for r in df.select(pages.forward_to(F.col("h")).alias("u")).collect()] == ["/en/x", "https://z.example/1", "https://z.example/2", "", ""]
