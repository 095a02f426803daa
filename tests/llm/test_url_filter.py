from spanforge.llm.url_filter import Rule, filter_urls

RULES = (Rule("block", "bad.org", "/"), Rule("allow", "good.bad.org", "/ok/"), Rule("block", "x.net", "/es/"))
LINK = '<link rel="canonical" href="{}">'
PAGES = [
    (1, "http://WWW.Bad.org/a?q=1#f", ""),
    (2, "https://mirror.com/a", LINK.format("http://bad.org/a2")),
    (3, "http://bad.org/a2", None),
    (4, "http://far.com/1", '<meta http-equiv="refresh" content="0; url=https://mirror.com/a/">'),
    (5, "http://good.bad.org/ok/1", LINK.format("http://bad.org/a2")),
    (6, "http://clean.com/1", LINK.format("/2")),
    (7, "http://clean.com/2?utm_source=x", ""),
    (8, None, ""),
    (9, "no scheme", LINK.format("http://bad.org/a2")),
    (10, "http://x.net/es", ""),
    (11, "http://x.net/es/", ""),
    (12, "HTTP://", None),
    (12, "HTTP://", None),
    (None, "http://notbad.org/a", ""),
    (13, "ftp://Host.com:80/P?x://y", ""),
]


def test_rules_and_aliases(spark):
    df = spark.createDataFrame([(*p, "v") for p in PAGES], "page_id long, url string, html string, verdict string")
    rows = filter_urls(df, RULES).collect()
    assert len(rows) == len(PAGES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert got == {
        1: ("www.bad.org", "/a", "bad.org/", "block"),
        2: ("mirror.com", "/a", None, "block"),
        3: ("bad.org", "/a2", "bad.org/", "block"),
        4: ("far.com", "/1", None, "block"),
        5: ("good.bad.org", "/ok/1", "good.bad.org/ok/", "allow"),
        6: ("clean.com", "/1", None, "allow"),
        7: ("clean.com", "/2", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("x.net", "/es", None, "block"),
        11: ("x.net", "/es/", "x.net/es/", "block"),
        12: ("", "", None, "allow"),
        None: ("notbad.org", "/a", None, "allow"),
        13: ("host.com:80", "/P", None, "allow"),
    }


def test_long_chain_and_empty_table(spark):
    chain = [(i, f"http://s{i}.com/p", LINK.format(f"http://s{i + 1}.com/p")) for i in range(40)] + [(40, "http://s40.com/p", "")]
    df = spark.createDataFrame(chain, "page_id long, url string, html string")
    rules = (Rule("block", "s0.com", "/"),)
    assert {r["verdict"] for r in filter_urls(df, rules).collect()} == {"block"}
    assert filter_urls(df.filter("false"), rules).count() == 0
    assert filter_urls(df, ()).filter("verdict = 'block'").count() == 0
