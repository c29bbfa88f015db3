import base64
import json
import zlib

from pyspark.sql import functions as F

from missive.functions import html, mail, urls
from missive.plans import records


def test_keys_agree_across_shapes():
    for url, key, board, leads in records.URL_CASES:
        p = urls.parts_of(url)
        assert (p["key"], p["source"], p["is_posting"]) == (key, board, leads), url


def test_unwrap_layers():
    target = "https://jobs.lever.co/zeta/5d1f3a90-77aa-4c1e-9b2d-0f60c1a2b3c4"
    coded = base64.urlsafe_b64encode(target.encode() + b"\0tail").decode().rstrip("=")
    packed = base64.urlsafe_b64encode(zlib.compress(b"a=1&l=" + target.replace(":", "%3A").encode())).decode().rstrip("=")
    wrapped = [
        "https://out.zeta.example/w?a=2&destination=" + target.replace(":", "%3A").replace("/", "%2F"), f"https://mail.zeta.example/x/{coded}",
        f"https://links.ukgjobalerts.com/c/{packed}", "https://t.zeta.example/cl0/" + target.replace("//", "%2F%2F") + "/1/00aa",
    ]
    twice = "https://out.zeta.example/w?url=" + wrapped[0].replace("%", "%25").replace("&", "%26").replace("?", "%3F")
    for url in (*wrapped, twice):
        assert urls.unwrap(url) == target, url
    assert urls.unwrap("nonsense") == "nonsense" and urls.unwrap("") == ""
    assert urls.counts_clicks(urls.Parts("https://u1.ct.sendgrid.net/ls/click?upn=x")) and not urls.counts_clicks(urls.Parts(target))


def test_url_parts_null_and_malformed(spark):
    df = spark.createDataFrame([(None,), ("https://[x",), ("",)], "url string")
    rows = df.select(urls.url_parts(F.col("url")).alias("u")).collect()
    assert rows[0].u is None and rows[1].u.host == "" and rows[2].u.key == ""


PAGE = """<html><head><title>t</title><script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "NLP Engineer",
"hiringOrganization": {"name": "Acme"}, "datePosted": "2024-05-01T00:00", "jobLocationType": "TELECOMMUTE", "employmentType": ["FULL_TIME"],
"baseSalary": {"value": {"minValue": 1, "maxValue": 2}}, "description": "<p>Build &amp; run models for many users every day.</p>"}]}</script></head>
<body><script>x</script><a href="https://a.example/1">One</a><a href="/rel">no</a><p>Hi&nbsp;there</p></body></html>"""


def test_page_record_reads_jsonld():
    got = html.page_record(PAGE)
    assert got["title"] == "NLP Engineer" and got["company"] == "Acme" and got["location"] == "(Remote)"
    assert got["salary"] == "USD 1–2" and got["employment_type"] == "Full-Time" and got["posted_at"] == "2024-05-01" and got["status"] == "ok"


def test_html_functions(spark):
    df = spark.createDataFrame([(PAGE,), (None,), ("",), ("<p><b>open",)], "h string")
    rows = df.select(html.html_to_text(F.col("h")).alias("t"), html.html_links(F.col("h")).alias("l")).collect()
    assert rows[0].t == "One\nno\nHi there" and [(x.url, x.text) for x in rows[0].l] == [("https://a.example/1", "One")]
    assert rows[1].t is None and rows[2].t == "" and rows[3].t == "open"


def test_parse_payload_walks_parts():
    data = base64.urlsafe_b64encode("grüße".encode()).decode().rstrip("=")
    payload = {"mimeType": "multipart/mixed", "headers": [{"name": "From", "value": '"A B" <A@X.example>'}], "parts": [{"mimeType": "text/plain", "body": {"data": data}}]}
    got = mail.parse_payload(json.dumps(payload))
    assert got["text"] == "grüße" and got["sender_email"] == "a@x.example" and got["sender_name"] == "A B"
    assert mail.parse_payload("{") is None and mail.parse_payload(None) is None
