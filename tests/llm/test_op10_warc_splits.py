"""WARC files in splits of any size, digests and charsets of sources, and pages against a tokenizer that goes letter by letter."""

import gzip
import random

import pytest

from quillstone.llm import warc


def record(i, block, more=""):
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{i}>\r\nWARC-Target-URI: http://h/{i}\r\n{more}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("split", [1_000, 7_000, 20_000, 1 << 20])
def test_every_split_gives_whole_records(spark, tmp_path, split):
    """Blocks hold marks, whole records and header look-alikes, and cross splits."""
    rng = random.Random(split)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    inner = record(999, b"HTTP/1.1 200 OK\r\n\r\nan archived archive", "X: y\r\n")
    want = {}
    (tmp_path / "w").mkdir()
    for f in range(3):
        body = b""
        for i in range(20 * f, 20 * f + 20):
            filler = bytes(rng.choice(b"abc <>\r\n") for _ in range(rng.choice((0, 40, 3000, 9000))))
            payload = filler + rng.choice((b"", b"WARC/1.0", b"WARC/1.", inner, b"WARC/1.0\r\nContent-Length: 5\r\n\r\n" * 3)) + filler[:500]
            want[f"<urn:{i}>"] = payload
            body += record(i, b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n" + payload)
        (tmp_path / "w" / f"f{f}.warc").write_bytes(body if f else body + b"junk after the last record")
        if f == 2:
            (tmp_path / "w" / "f2.warc").unlink()
            (tmp_path / "w" / "f2.warc.gz").write_bytes(gzip.compress(body[:50_000]) + gzip.compress(body[50_000:]))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        rows = warc.read_warc(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 60 and {r["record_id"]: r["payload"].encode() for r in rows} == want
    assert all(r["payload_digest"] == warc.digest(want[r["record_id"]]) and r["http_headers"].startswith("HTTP/1.1 200") for r in rows)


def test_digests_and_charsets_of_sources_are_kept(spark, tmp_path):
    page = "<html><title>café</title><p>naïve café</p></html>"
    latin, stated = page.encode("latin-1"), "sha1:STATEDBYTHECRAWLER"
    meta = b'<meta charset="windows-1251"><p>' + "Привет".encode("cp1251") + b"</p>"
    (tmp_path / "w").mkdir()
    blocks = [
        record(0, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n" + latin, f"WARC-Payload-Digest: {stated}\r\n"),
        record(1, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin1\r\n\r\n" + latin),
        record(2, b"HTTP/1.1 200 OK\r\n\r\n" + meta),
        record(3, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=no-such\r\n\r\n" + page.encode()),
    ]
    (tmp_path / "w" / "x.warc").write_bytes(b"".join(blocks))
    read = warc.read_warc(spark, str(tmp_path / "w"))
    made = {(r["refers_to"], r["record_type"]): r for r in warc.derive(read).collect()}
    text = lambda i: made[f"<urn:{i}>", "conversion"]
    assert text(0)["block"] == text(1)["block"] == text(3)["block"] == "café\nnaïve café" and text(2)["block"] == "Привет"
    assert text(0)["source_digest"] == stated and text(1)["source_digest"] == warc.digest(latin) and text(2)["source_digest"] == warc.digest(meta)
    assert "payload_digest" not in warc.derive(read).columns and "charset=ISO-8859-1" in text(0)["source_headers"]


BLOCKS = "p div section article header footer nav aside main ul ol li table tr h1 h2 h3 h4 h5 h6 blockquote pre form title head body html br hr".split()


def letter_by_letter(html):
    """The text of a page whose comments and dropped elements are closed, by states."""
    out, i, n = [], 0, len(html)
    while i < n:
        c = html[i]
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            out.append(" ")
            i = n if end < 0 else end + 3
        elif c == "<" and i + 1 < n and (html[i + 1].isascii() and html[i + 1].isalpha() or html[i + 1] in "/!?"):
            j, quote = i + 2, None
            while j < n:
                d = html[j]
                if quote:
                    if d == quote:
                        quote = None
                elif d == ">":
                    break
                elif d in "\"'" and html[:j].rstrip()[-1] == "=" and html.find(d, j + 1) >= 0:
                    quote = d
                j += 1
            if j >= n:
                out.append(c)
                i += 1
                continue
            name = ""
            for d in html[i + 1 : j].lstrip("/"):
                if d.isspace() or d in "/>":
                    break
                name += d.lower()
            i = j + 1
            if name in ("script", "style", "noscript", "template") and html[i - (j - i) - 1] != "/":
                close = html.lower().find(f"</{name}", i)
                while close >= 0 and html[close + 2 + len(name) :].lstrip()[:1] != ">":
                    close = html.lower().find(f"</{name}", close + 1)
                out.append(" ")
                i = n if close < 0 else html.index(">", close) + 1
            elif name in BLOCKS:
                out.append("\n")
        else:
            out.append(c)
            i += 1
    return "".join(out)


def test_plain_text_against_letters():
    rng = random.Random(6)
    pieces = [
        "text ", "a &lt; b", "café ", "1 < 2 ", "x > y ", "<p>", "</p>", '<p title="a>b">', "<a title='x<y' href=\"u\">", "</a>", "<br/>", "<BR>", "<div class=x data-y = 'q>r'>", "</div>", "<!-- c > <p> -->", "<script src='a>b'>if (a < b) {}</script>",
        "<style>p > a {}</style>", '<img alt="it\'s" src=\'s"t\'>', "<b>", "</b>", "<h2>", "<p don't>", "<tr><td>", "<?xml v='1>0'?>", "<!DOCTYPE html>", "\n", "<title>t</title>", "<pre>", "<section-x>", "<abbr>",
    ]
    import html as entities
    import re

    for _ in range(400):
        page = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        plain = re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[^\S\n]+", " ", entities.unescape(letter_by_letter(page)))).strip()
        assert warc.plain_text(page) == plain, page


def test_hostile_pages_cost_what_their_length_costs():
    import time

    for unit in ("<a href=\"", "<a href='x", "<script ", "<p title=", "<!--", "=\"'", "<a b='c' ", "< <p> =\"", "<style><"):
        start = time.perf_counter()
        warc.plain_text(unit * 60_000)
        warc.page_metadata("i", "t", "h", unit * 60_000, "d")
        assert time.perf_counter() - start < 8, unit
