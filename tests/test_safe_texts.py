"""Addresses, robots files, entities, stated times and hashes that are easy to get wrong."""

from __future__ import annotations

import html

import pytest
from pyspark.sql import functions as F

from tidemark.functions import identity as I
from tidemark.functions import text as X
from tidemark.functions import times as T
from tidemark.operators import robots as RB


def values(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_hosts_are_those_a_browser_asks(spark):
    asked = {
        r"https://evil.test\@example.com/x": "evil.test", r"https:\\evil.test\example.com": "evil.test", "https://a@b.com@evil.test/": "evil.test", "https://example.com:443/x": "example.com",
        "https://Example.COM?x@y": "example.com", "https://example.com#@evil.test": "example.com", "https://exa mple.com/": "", "https://example.com:x/": "", "https://[::1]:80/": "[::1]", "https:///x": "",
        "no url": "", "https://": "", "https://user:pass@news.example.com/@/x": "news.example.com", "https://example.com%2eevil.test/": "", "https://пример.испытание/": "пример.испытание", None: None,
    }
    assert values(spark, list(asked), X.host) == list(asked.values())
    allowed = values(spark, list(asked), lambda c: X.host_allowed(c, F.array(F.lit("example.com"))))
    assert [u for u, ok in zip(asked, allowed, strict=True) if ok] == ["https://example.com:443/x", "https://Example.COM?x@y", "https://example.com#@evil.test", "https://user:pass@news.example.com/@/x"]


def test_robots_patterns_are_no_regular_expressions(spark):
    body = "User-agent: *\nDisallow: /a\\E(b\nDisallow: /\\Q*$\nDisallow: /c\\E\\E[x\nDisallow: /(?i)d\nAllow: /\\Qy$"
    files = spark.createDataFrame([("h", 200, body)], "host string, status int, body string")
    paths = ["/a\\E(b", "/a(b", "/a\\E(bc", "/\\Qx", "/\\Qy", "/Q", "/c\\E\\E[x", "/D", "/(?i)d", "/"]
    asked = spark.createDataFrame([("h", p) for p in paths], "host string, path string")
    got = {r.path: r.allowed for r in RB.allowed(asked, RB.rules(files), "Crawler/1.0").collect()}
    assert [p for p in paths if not got[p]] == ["/a\\E(b", "/a\\E(bc", "/\\Qx", "/c\\E\\E[x", "/(?i)d"]


def test_entities_in_one_pass(spark):
    texts = ["&AMP;&Lt;&gT;", "&#38;lt;", "&amp;lt;", "&amp;#60;", "&#x26;#38;", "a&nbsp;b&middot;c", "&bogus; &; &#; &#x; &#xD800; &#1114112; &#0;", "&#128512;&#x1F600;", "&#00000000000065;", "no entity", "", None, "&quot;&apos;&hellip;&ndash;&mdash;&lsquo;&rsquo;&ldquo;&rdquo;", "&&amp;&"]
    want = ["&<>", "&lt;", "&lt;", "&#60;", "&#38;", "a b·c", "&bogus; &; &#; &#x; &#xD800; &#1114112; &#0;", "😀😀", "A", "no entity", "", None, "\"'…–—‘’“”", "&&&"]
    assert values(spark, texts, X.decode_entities) == want
    assert html.unescape("&#38;lt;") == "&lt;"
    assert values(spark, ["a\x85b\x9fc\x00d​e﻿f\tg"], X.plain_text) == ["a\x85b\x9fcdef g"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("2024-01-10 (a remark of far more than twenty-four characters) 10:05", "2024-01-10 10:05"), ("2024/1/2 () 9:30", "2024-01-02 09:30"), ("2024년 1월 2일(화) 09:30", "2024-01-02 09:30"), ("2024.01.02T09:30", "2024-01-02 09:30")]
    + [("2024-01-10 10:5", None), ("2024-01-10", None), ("24-01-10 10:05", None), ("2024-13-10 10:05", None), ("from 2024-01-10 (x) (y) 10:05", None)],
)
def test_stated_wall_times(spark, text, want):
    got = values(spark, [text], T.source_wall_time)[0]
    assert (got and got.strftime("%Y-%m-%d %H:%M")) == want


def test_hash_of_utf_16_units(spark):
    def plain(text):
        h, units = 2166136261, text.encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = (h ^ int.from_bytes(units[i : i + 2])) * 16777619 & 0xFFFFFFFF
        return f"{h:08x}"

    texts = ["", "a", "Épée", "한국어", "😀", "a😀b𝒳", "\U0010ffff", "￿"]
    assert values(spark, texts, I.fnv1a32) == [plain(t) for t in texts]
