import random
import re

import pytest

from txnrisk.llm import urlfilter as U

SCHEMA = "page_id long, url string, html string, host string, rule string, template string, n string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "", "x", "x", "x", "x") for i, u in urls], SCHEMA)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule(host, path, rules):
    fit = [r for _, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fit, key=len, default=None)


URLS = [
    None, "", "no scheme", "http://", "http://ORG", "http://org/", "https://a.b.Org/x?y#z", "ftp://example.org/es/1", "x://www.example.org/en/12", "x://www.example.org/en/22",
    "x://notexample.org/es/3", "http://É.com/fr/1", "http://a.com/de/9#top", "http://a.com/de", "http://a.net/de/7?x=://q/", "http://a.net?x", "://b.com/fr/é", "http://org:80/x", "x://com/de/1", "x://a.com/de/1", "x://a.com/de/1",
]


def test_hosts_paths_and_rules(spark):
    rows = list(enumerate(URLS)) + [(None, "http://a.org/x"), (3, "http://")]
    found = U.judged(pages(spark, rows)).collect()
    verdicts = {r: v for v, r in U.RULES}
    want = sorted(((i, *split(u), rule(*split(u), U.RULES)) for i, u in rows), key=str)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in found), key=str) == want
    assert all(r.verdict == verdicts[r.rule] if r.rule else r.verdict in ("allow", "block") for r in found)


def test_templates_follow_labels(spark):
    rules = [("block", "a.net/spam/1"), ("allow", "a.net/news/1"), ("block", "b.net/spam/"), ("allow", "b.net/news/")]
    urls = [f"x://a.net/{kind}/{n}" for kind in ("spam", "news") for n in range(100, 300)] + [f"x://{h}.net/{kind}/{n}/" for h in "bc" for kind in ("spam", "news") for n in range(50)]
    found = {(r.host, r.path): r for r in U.judged(pages(spark, enumerate(urls)), rules).collect()}
    for path in ("/spam/250", "/spam/299"):
        assert found["a.net", path].rule is None and found["a.net", path].verdict == "block" and found["a.net", path].template == "/spam/<n>"
    assert found["a.net", "/news/250"].verdict == "allow"
    # A host without labels has the verdicts that its templates have elsewhere.
    assert (found["c.net", "/spam/7/"].verdict, found["c.net", "/news/7/"].verdict) == ("block", "allow")


def test_similar_and_rare_branches_are_merged(spark):
    rules = [("block", "a.net/t0/bad"), *(("allow", f"a.net/t{i}/ok") for i in range(40))]
    urls = [f"x://a.net/t{i}/ok" for i in range(40) for _ in range(3)] + ["x://a.net/t0/bad"] * 60 + [f"x://a.net/user{i}name/pic" for i in range(200)]
    found = {r.path: r.template for r in U.judged(pages(spark, enumerate(urls)), rules).collect()}
    assert found["/user7name/pic"].startswith("/*") and found["/t9/ok"].startswith("/*") and found["/t0/bad"].startswith("/t0")


@pytest.mark.parametrize("rules", [U.RULES, []])
def test_empty_and_without_labels(spark, rules):
    assert U.judged(pages(spark, []), rules).count() == 0
    assert {r.verdict for r in U.judged(pages(spark, [(1, "x://a.xyz/b"), (2, None)]), rules).collect()} == {"allow"}


def segments(path):
    out = []
    for s in path.split("/"):
        if s:
            form = "<n>" if re.fullmatch("[0-9]+", s) else re.sub(r"^[0-9]+", "<n>", s) if re.fullmatch(r"[0-9]+\.[A-Za-z]+", s) else "<x>" if re.fullmatch("[0-9a-fA-F-]{16,}", s) else "<long>" if len(s) > 48 else s
            out.append(form)
    return tuple(out) if len(out) <= U.DEPTH else (*out[: U.DEPTH], U.REST)


def brute(rows, rules):
    """The tree, the merges and the smoothing, page by page."""
    verdicts, split_rows, paths = {r: v for v, r in rules}, [], {}
    for page, url in rows:
        host, path = split(url)
        told = verdicts.get(rule(host, path, rules))
        key = (host, segments(path))
        split_rows.append((page, key, told))
        sums = paths.setdefault(key, [0, 0, 0])
        for i, x in enumerate((1, told == "block", told is not None)):
            sums[i] += x
    template = {key: () for key in paths}
    for level in range(U.DEPTH):
        kids = {}
        for key, sums in paths.items():
            if len(key[1]) > level:
                own = kids.setdefault((key[0], template[key]), {}).setdefault(key[1][level], [0, 0, 0])
                for i in range(3):
                    own[i] += sums[i]
        for key in paths:
            if len(key[1]) > level:
                node = kids[key[0], template[key]]
                n, b, k = node[key[1][level]]
                node_n, node_b, node_k = (sum(s[i] for s in node.values()) for i in range(3))
                name = key[1][level]
                if len(node) > U.MANY and n < node_n * U.SHARE:
                    name = U.ANY
                elif k and node_k - k:
                    share, rest = node_b / node_k, node_k - k
                    if abs(b / k - (node_b - b) / rest) <= U.SIGNIFICANT * (share * (1 - share) * (1 / k + 1 / rest)) ** 0.5:
                        name = U.ANY
                template[key] += (name,)
    for key in paths:
        if len(key[1]) > U.DEPTH:
            template[key] += (U.REST,)
    below, own = {}, {}
    for key, (_, b, k) in paths.items():
        for size in range(len(template[key]) + 1):
            sums = below.setdefault(template[key][:size], [0, 0])
            sums[0], sums[1] = sums[0] + b, sums[1] + k
        sums = own.setdefault((key[0], template[key]), [0, 0])
        sums[0], sums[1] = sums[0] + b, sums[1] + k
    purity = {(): None}
    for node in sorted(below, key=len):
        prior = purity[node[:-1]] if node else (below[()][0] + 1) / (below[()][1] + 2)
        purity[node] = (below[node][0] + U.PRIOR * prior) / (below[node][1] + U.PRIOR)
    out = []
    for page, key, told in split_rows:
        b, k = own[key[0], template[key]]
        p = (b + U.PRIOR * purity[template[key]]) / (k + U.PRIOR)
        out.append((page, "/" + "/".join(template[key]), told or ("block" if p > 0.5 else "allow"), round(p, 6)))
    return sorted(out, key=str)


def test_equals_a_plain_tree(spark):
    rng = random.Random(4)
    hosts = ["a.example.org", "b.example.com", "c.example.net", "example.org", "d.x.net"]
    tails = ["/{l}/{n}", "/{l}/{n}.html", "/{l}/{n}/", "/{l}/x{n}/y", "/{l}/1{n}", "/{l}/a/b/c/d/e", "/", "", "/0123456789abcdef0/{l}"]
    urls = [f"http://{rng.choice(hosts)}" + rng.choice(tails).format(l=rng.choice(["en", "es", "fr", "de"]), n=rng.randrange(300)) for _ in range(3_000)]
    rows = list(enumerate([*urls, None, "none"]))
    found = sorted(((r.page_id, r.template, r.verdict, r.purity) for r in U.judged(pages(spark, rows), U.RULES).collect()), key=str)
    want = brute(rows, U.RULES)
    assert [x[:3] for x in found] == [x[:3] for x in want]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(found, want, strict=True))


def test_rare_branches_stay_apart_by_their_labels_elsewhere(spark):
    rules = [("block", "b.net/de/"), ("allow", "b.net/fr/"), ("allow", "a.net/s1/")]
    urls = [f"x://a.net/s{i}/{n}" for i in range(60) for n in range(5)] + [f"x://a.net/de/{n}" for n in range(3)] + [f"x://b.net/{kind}/{n}" for kind in ("de", "fr") for n in range(60)]
    found = {(r.host, r.path): r for r in U.judged(pages(spark, enumerate(urls)), rules).collect()}
    assert (found["a.net", "/de/2"].template, found["a.net", "/de/2"].verdict) == ("/de/<n>", "block")
    assert (found["a.net", "/s7/2"].template, found["a.net", "/s7/2"].verdict) == ("/*/<n>", "allow")


def test_branches_that_differ_below_the_fourth_segment(spark):
    rules = [("block", "a.net/a/b/c/d/e/spam/1"), ("allow", "a.net/a/b/c/d/e/news/1")]
    urls = [f"x://a.net/a/b/c/d/e/{kind}/{n}" for kind in ("spam", "news") for n in range(100, 300)] + ["x://a.net/" + "z/" * 40 + "y"]
    found = {r.path: r for r in U.judged(pages(spark, enumerate(urls)), rules).collect()}
    assert (found["/a/b/c/d/e/spam/250"].verdict, found["/a/b/c/d/e/news/250"].verdict) == ("block", "allow")
    assert found["/a/b/c/d/e/spam/250"].template == "/a/b/c/d/e/spam/<n>"
    assert found["/" + "z/" * 40 + "y"].template == "/" + "z/" * 40 + "y"
