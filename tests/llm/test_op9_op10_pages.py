"""Rules and aliases of urls; derivatives and files of WARC."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import url_filter, warc


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://www.Example.com/en/x?q#f", ""), (2, "https://m.example.com/en/", ""), (3, "http://shop.net/de/a", link("http://b.net/fr/blocked")), (4, "http://q.org/1", link("http://shop.net/de/a#x")),
        (5, "http://q.org/2", '<meta http-equiv="refresh" content="0; url=http://any.com/">'), (6, None, None), (7, "no scheme", ""), (8, "http://q.org/3", '<link href="/4" rel=canonical>'), (9, "http://q.org/4", link("http://b.net/es/")), (4, "http://q.org/1", ""),
        (10, "http://com", ""), (11, "http://example.com/EN/", ""),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.op9(df).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[2][2:] == ("example.com/en/", "block")
    assert got[3][2:] == (None, "block") and got[4][2:] == (None, "block") and got[5][2:] == (None, "allow") and got[8][3] == "block" and got[9][3] == "block"
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[10] == ("com", "", None, "allow") and got[11][2] == "com/"
    extra = spark.createDataFrame([("http://q.org/1", "http://fine.com/")], "source string, target string")
    assert url_filter.judge(df, redirects=extra).where("page_id = 3").first()["verdict"] == "allow"
    assert url_filter.op9(df.limit(0)).count() == 0


def test_many_rules_are_joined(spark):
    """600 rules, some equally long or for the same place; columns that clash with helpers; against the rule expression."""
    rng = np.random.default_rng(14)
    hosts, paths = ["com", "a.com", "b.a.com", "net", "x.net"], ["/", "/a", "/ab/", "/ab/c", "/é/", "/a/b/c/d"]
    rules = [(("allow", "block")[i % 2], hosts[i % 5] + paths[i % 6]) for i in range(7)] + [("block", f"h{i}.org/p{i}") for i in range(600)]
    urls = [f"http://{h}{p}{t}" for h in [*hosts, "b.a.com.org", "com.x.net", "zcom"] for p in paths for t in ("", "x?q", "/y#f")] + [f"https://www.h{i}.org/p{i}0" for i in rng.integers(0, 700, 40)] + [None, "nothing"]
    df = spark.createDataFrame([(i, u, "", 1, "s", "c") for i, u in enumerate(urls)], "page_id long, url string, html string, node_ int, spread_ string, sh_ string")
    long = {r["page_id"]: r for r in url_filter.judge(df.drop("sh_"), tuple(rules)).collect()}
    few = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, tuple(rules[:7])).collect()}

    def brute(url, rules):
        host, path = re.match(r"[^:]*://([^/?#]*)([^?#]*)", url or "").groups() if "://" in (url or "") else ("", "")
        fit = [(len(r), v == "allow", r, v) for v, r in rules for h, s, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
        return max(fit)[2:] if fit else (None, "allow")

    for i, u in enumerate(urls):
        assert (long[i]["rule"], long[i]["verdict"]) == brute(u, rules), u
        assert few[i] == brute(u, rules[:7]) and long[i]["node_"] == 1 and long[i]["spread_"] == "s"
    assert len(long) == len(urls) and len({r["rule"] for r in long.values()}) > 20


def test_warc_round_trip(spark, tmp_path):
    html = '<html><head><title>T &amp; t</title><meta name="d" content="c"><script>x("<p>")</script></head><body><p>One &lt;b&gt;<p>Two<br>three <a href="/l?a=1&amp;b=2">l</a><!-- no --></body></html>'
    df = spark.createDataFrame([(1, "http://a/", html, "x"), (2, None, None, "y"), (1, "http://a/", html, "x")], "page_id long, url string, html string, block string")
    made = warc.derive(warc.responses(df))
    rows = {(r["page_id"], r["record_type"]): r for r in made.collect()}
    assert made.count() == 6 and len(rows) == 4
    text, meta = rows[1, "conversion"], rows[1, "metadata"]
    assert text["block"] == "T & t\nOne <b>\nTwo\nthree l" and '"/l?a=1&b=2"' in meta["block"] and '"Title": "T & t"' in meta["block"]
    assert text["refers_to"] == meta["refers_to"] != text["record_id"] and text["source_digest"] == warc.digest(html.encode()) and "text/html" in text["source_headers"]
    assert text["block_digest"] == warc.digest(text["block"].encode()) and text["content_length"] == len(text["block"].encode()) and rows[2, "conversion"]["block"] == ""
    warc.write_warc(made.where("page_id = 1 and record_type = 'conversion'").dropDuplicates(["record_id"]).coalesce(1), str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert len(back) == 1 and back[0]["payload"] == text["block"] and back[0]["record_id"] == text["record_id"] and back[0]["refers_to"] == text["refers_to"]
    assert warc.op10(df.limit(0)).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_files_hold_any_block(spark, tmp_path, compression):
    """Blocks with record marks, line ends at their ends, NULs and no text; a file of many members; lengths that are no numbers."""
    import gzip

    blocks = ["", "WARC/1.0\r\nWARC-Type: fake\r\n\r\nx", "a\r\n\r\n", "\u0000é\u0000" * 50, "WARC/1.", "日本\n" * 3000, "x"]
    made = warc.derive(warc.responses(spark.createDataFrame([(i, f"http://h/{i}", "x") for i in range(len(blocks))], "page_id long, url string, html string"))).where("record_type = 'conversion'")
    pairs = spark.createDataFrame(list(enumerate(blocks)), "page_id long, b string")
    made = made.join(pairs, "page_id").withColumn("block", F.col("b")).withColumn("content_length", F.octet_length("b").cast("long")).repartition(2)
    warc.write_warc(made, str(tmp_path / "w"), compression)
    back = {r["target_uri"]: (r["payload"], r["record_type"]) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert back == {f"http://h/{i}": (b, "conversion") for i, b in enumerate(blocks)}
    record = lambda i, size, block: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {i}\r\nContent-Length: {size}\r\n\r\n{block}\r\n\r\n".encode()
    http = "HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.warc.gz").write_bytes(b"".join(gzip.compress(record(i, len(http) if i else "many", http)) for i in range(300)))
    rows = warc.read_warc(spark, str(tmp_path / "m")).collect()
    assert len(rows) == 300 and {r["http_headers"] for r in rows} == {"HTTP/1.1 200 OK\r\nA: b"} and {r["payload"].strip() for r in rows} == {"body"}


def test_pages_cost_what_their_length_costs():
    """Unclosed tags, comments, titles and attributes by the megabyte; and attributes in any order."""
    import time

    n = 1 << 20
    for page in ("<a " * (n // 3), "<script " * (n // 8), "<title>" * (n // 7), "<meta name=x " * (n // 13), "<!--" * (n // 4), "<" * n, "<a " + "b" * n + ">", "<p" + " " * n, "<meta " + "name= " * (n // 6) + ">", "<a href='" * (n // 9), "</script" + " " * n, " \n" * (n // 2)):
        began = time.process_time()
        warc.plain_text(page)
        warc.page_metadata("i", "t", "h", page, "d")
        assert time.process_time() - began < 5, page[:20]
    links = warc.page_metadata(None, None, "", """<META content='c&amp;d' name="k"><a class=x href=/u?a=1&amp;b>t</a><img src="i.png"><!-- <a href="no"> --><title>T</TITLE>""", "")
    assert '"Metas": [{"content": "c&d", "name": "k"}]' in links and '"Links": [{"path": "a", "url": "/u?a=1&b"}, {"path": "img", "url": "i.png"}]' in links and '"Title": "T"' in links
