import re

from pyspark.sql import functions as F

from chronoline.llm import url_filters as uf

URLS = [None, "", "no scheme example.net/en/", "http://a.example.net/en/1", "http://example.net/en", "HTTP://EXAMPLE.NET/en/x?y=/",
        "https://badexample.net/en/", "https://x.example.com/de/1#a://b", "https://example.com/DE/", "http://org/fr/", "http://x.org/fr",
        "http://x.org?/fr/", "http://net", "http://net/", "http://a.b.net/?q", "x://y://z.net/", "http://spam-farm.net/", "http://spam-farm.edu/x",
        "http://a.spam-farm.io/", "http://notspam-farm.io/", "http://x.io/viagra", "http://x.io/viagras", "http://x.io/wp-login.php",
        "http://x.io/wp-login.php?a", "http://ADULT-X.io/", "http://É.net/é/", "http://user@net:80/", "http://x.io/a\nb/warez/", "://net/"]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(-len(r), a == "allow", r, a) for r, a in uf.SITE_RULES for h, _, p in [r.partition("/")]
           if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    pats = [(a != "allow", p, a) for p, a in uf.PATTERN_RULES if url is not None and re.search(uf.pattern_rule(p, a).regex, low)]
    rule, pattern = min(fit, default=None), min(pats, default=None)
    return host, path, rule and rule[2], rule[3] if rule else pattern[2] if pattern else "allow", pattern and pattern[1]


def test_against_all_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(None, URLS[3], "x"), (3, URLS[3], "x")],
                                  "page_id long, url string, rule string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, r.pattern) for r in uf.filter_urls(pages, uf.rule_frame(spark)).collect()]
    want = [(i, *brute(u)) for i, u in enumerate(URLS)] + [(None, *brute(URLS[3])), (3, *brute(URLS[3]))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert uf.filter_urls(pages.where(F.lit(False)), uf.rule_frame(spark)).count() == 0


def test_rules_are_filed_under_a_token_every_fitting_url_holds():
    for kind, rules in ((uf.site_rule, uf.SITE_RULES), (uf.pattern_rule, uf.PATTERN_RULES)):
        for text, action in rules:
            rule = kind(text, action)
            for url in filter(None, URLS):
                host, path, *_ = brute(url)
                if re.search(rule.regex, host + path if rule.kind == "site" else url.lower()):
                    assert set(rule.literals) <= set(re.findall("[a-z0-9]+", url.lower())), (rule, url)
    assert uf.pattern_rule("*ad*", "block").literals == () and uf.pattern_rule("|http://x.*/ad^", "block").literals == ("http", "x", "ad")


def test_rarest_token_is_chosen(spark):
    urls = spark.createDataFrame([("u1", "en"), ("u2", "en"), ("u1", "net"), ("u1", "example"), ("u2", "example")], "url string, token string")
    index = {r.rule: r.token for r in uf.index_rules(urls, uf.rule_frame(spark, patterns=[("*", "allow")])).collect()}
    assert index["example.net/en/"] == "net" and index["org/fr/"] == "fr" and index["*"] == ""
