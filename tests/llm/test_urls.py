import random
import re

import pytest

from cellward.llm import urls


def brute(rows):
    """Rules, and the two propagations as plain loops."""
    parsed = []
    for page_id, url, html in rows:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
            path = rest[len(host) :]
            path = next((path[:i] for i, c in enumerate(path) if c in "?#"), path)
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h) + len(p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        parsed.append((page_id, host, path, *(max(fits)[1:] if fits else (None, None)), html))
    return parsed


ROWS = [
    (1, "http://www.Example.COM/en/1", None),
    (2, "http://example.com/en/1?x=/en/", '<a href="/x">'),
    (3, "https://a.b.net/es/3#top", '<a href="http://spam.org/a">x</a>'),
    (4, "https://a.b.net/fr/", ""),
    (5, "http://spam.org/p", "<a href='//bad.ORG/q'>"),
    (6, "http://bad.org/p", '<a HREF=https://a.b.net/x><a href="https://a.b.net">'),
    (7, None, None),
    (8, "nothing", "x"),
    (9, "http://notcom/en/", ""),
    (10, "ftp://x.com?q", ""),
    (11, "http://far.org/://x", '<a href="http://example.com/">'),
    (None, "http://www.example.com/en", ""),
    (1, "http://www.Example.COM/en/1", None),
    (12, "://", ""),
]


def scores_by_loops(links, seeds, rounds=400):
    """Trust and distrust of all hosts, by plain loops over the links (src, dst, number)."""
    out, into = {}, {}
    for s, d, n in links:
        out[s], into[d] = out.get(s, 0) + n, into.get(d, 0) + n
    hosts = {*seeds, *out, *into}
    t, b = ({h: seeds.get(h, (0, 0))[i] for h in hosts} for i in (0, 1))
    for _ in range(rounds):
        nt, nb = ({h: seeds.get(h, (0, 0))[i] for h in hosts} for i in (0, 1))
        for s, d, n in links:
            nt[d] += 0.85 * t[s] * n / out[s]
            nb[s] += 0.85 * b[d] * n / into[d]
        t, b = nt, nb
    return {h: (t[h], b[h]) for h in hosts}


def verdicts_by_loops(rows):
    """(page_id, host, path, rule, verdict) of all rows, without Spark."""
    parsed, pages, links = brute(rows), {}, {}
    for _, host, _, _, verdict, html in parsed:
        if not host:
            continue
        pages.setdefault(host, []).append(verdict)
        for dst in re.findall(r"""href[ \t\r\n]*=[ \t\r\n]*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'> \t\r\n]+)""", html or "", re.I):
            if dst.lower() != host:
                links[host, dst.lower()] = links.get((host, dst.lower()), 0) + 1
    for host, found in pages.items():
        above = host.partition(".")[2]
        if above and (above in pages or above.count(".") >= 2):
            for edge in ((host, above), (above, host)):
                links[edge] = links.get(edge, 0) + len(found)
    seeds = {h: (v.count("allow") / len(v), v.count("block") / len(v)) for h, v in pages.items()}
    scores = scores_by_loops([(*e, n) for e, n in links.items()], seeds)
    out = []
    for page_id, host, path, rule, verdict, _ in parsed:
        t, b = scores.get(host, (0, 0)) if host else (0, 0)
        out.append((page_id, host, path, rule, verdict or ("block" if b > 0.5 and b > t else "allow")))
    return out


def test_hosts_and_rules(spark):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, host string")
    got = urls.judge(pages).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=repr) == sorted(verdicts_by_loops(ROWS), key=repr)
    by = {r.page_id: r for r in got}
    assert by[6].verdict == "block" and by[6].distrust > 0.5  # it links to a host whose pages are all blocked
    assert by[11].distrust > 0  # and this one to a host some of whose pages are
    assert by[7].verdict == by[9].verdict == "allow"


def test_random_pages_against_loops(spark):
    rng = random.Random(4)
    names = [f"{p}{x}.site.{tld}" for p in ("", "www.", "m.") for x in "abc" for tld in ("com", "net", "org")] + ["example.com", "www.example.com"]
    rows = []
    for i in range(300):
        host = "hot.site.net" if i % 3 == 0 else rng.choice(names)
        html = "".join(f'<a href="//{rng.choice(names)}/x">' for _ in range(rng.randint(0, 1)))
        rows.append((i, f"https://{host}/{rng.choice(['en', 'es', 'fr', 'de'])}/{i}", html))
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    want = verdicts_by_loops(rows)
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(want)
    assert {x[4] for x in want if x[3] is None} == {"allow", "block"}  # both verdicts come from the method


def test_very_long_url_and_page(spark):
    rows = [(1, "http://a.org/" + "x" * 300_000 + "?q", "y" * 3_000_000 + '<a href="//b.net/">'), (2, "http://b.net/es/1", None)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got[1].path) == 300_001 and got[1].verdict == "block"  # its only link goes to a blocked host


@pytest.mark.parametrize("sent", [urls.SENT, 0])
def test_propagation_against_loops(spark, sent):
    links = [("a", "b", 2), ("a", "c", 1), ("b", "c", 4), ("c", "a", 1), ("d", "c", 5)]
    out, into = {}, {}
    for s, d, n in links:
        out[s], into[d] = out.get(s, 0) + n, into.get(d, 0) + n
    frame = spark.createDataFrame([(s, d, n / out[s], n / into[d]) for s, d, n in links], "src string, dst string, forth double, back double")
    seeds = {"a": (1.0, 0.0), "c": (0.25, 0.5)}
    got = urls.propagate(spark.createDataFrame([(h, *x) for h, x in seeds.items()], "host string, good double, bad double"), frame, sent=sent).collect()
    want = scores_by_loops(links, seeds)
    assert {r.host: (r.trust, r.distrust) for r in got} == {h: (pytest.approx(t, abs=1e-4), pytest.approx(b, abs=1e-4)) for h, (t, b) in want.items()}


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
