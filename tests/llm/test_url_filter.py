import random

import pytest

from ledgerline.llm.url_filter import Rule, judge_urls
from ledgerline.llm.queries import URL_RULES


def judge(spark, urls, labels=(), rules=URL_RULES, **settings):
    pages = spark.createDataFrame([(i, u, "?", "?", "?") for i, u in urls], "page_id long, url string, host string, template string, lex string")
    marks = spark.createDataFrame(list(labels), "page_id long, bad boolean")
    return judge_urls(pages, marks, rules, **settings)


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("HTTP://A.EXAMPLE.NET/en/1?q#f", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/EN/", "example.net", "/EN/", "net/", "block"),
        ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
        ("http://example.net", "example.net", "", None, "allow"),
        ("http://example.net?x=/en/", "example.net", "", None, "allow"),
        ("http://x.example.com/de/a", "x.example.com", "/de/a", "example.com/de/", "block"),
        ("http://x.example.com/de", "x.example.com", "/de", None, "allow"),
        ("http://y.org/fr/://z", "y.org", "/fr/://z", "org/fr/", "allow"),
        ("a://b://c.net/", "b:", "//c.net/", None, "allow"),
        ("no scheme.net/en/", "", "", None, "allow"),
        ("x\ny://h.org/fr/1\n2", "h.org", "/fr/1\n2", "org/fr/", "allow"),
        ("://", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    row = judge(spark, [(1, url)]).collect()[0]
    assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict)


def test_bad_branch_is_blocked_and_the_rest_kept(spark):
    urls = [(i, f"http://h.test/{'spam' if i % 4 == 0 else 'news'}/{i}.html") for i in range(400)] + [(1000, "http://h.test/spam/new.html"), (1001, "http://other.test/")]
    labels = [(i, i % 4 == 0) for i in range(0, 400)]
    found = {r["page_id"]: r for r in judge(spark, urls, labels, rules=[]).collect()}
    assert all(found[i]["verdict"] == ("block" if i % 4 == 0 else "allow") for i in range(400))
    assert found[0]["template"] == "/spam/*.html" and found[0]["branch"] == "/spam" and found[1001]["verdict"] == "allow"


def test_similar_branches_are_merged(spark):
    urls = [(i, f"http://h.test/{'ab'[i % 2]}/{i}") for i in range(200)]
    found = judge(spark, urls, [(i, i % 5 == 0) for i in range(200)], rules=[]).collect()
    assert {r["branch"] for r in found} == {"/"} and {r["verdict"] for r in found} == {"allow"}


def test_many_children_become_a_wildcard(spark):
    names = ["".join(chr(97 + int(d)) for d in str(i)) for i in range(100)]
    found = judge(spark, [(i, f"http://h.test/user/{n}/home") for i, n in enumerate(names)], rules=[]).collect()
    assert {r["template"] for r in found} == {"/user/*/home"}


def test_edges(spark):
    urls = [(None, "http://a.net/x"), (1, "http://a.net/x"), (1, "http://a.net/x"), (2, "http://h.test/" + "/".join("abcdefghijklmnop")), (3, "http://h.test/" + "q" * 100_000)]
    found = judge(spark, urls, [(None, True), (99, True), (2, None), (1, True), (1, False)], rules=[Rule("block", "a.net"), Rule("allow", "a.net")]).collect()
    assert len(found) == 5
    assert all(r["verdict"] == "block" for r in found if r["host"] == "a.net")
    assert {r["template"] for r in found if r["page_id"] == 2} == {"/a/b/c/d/e/f/g/h/i/j/k/l/m/n/o/p"}
    assert judge(spark, []).count() == 0


def plain(urls, labels, share=0.05, deviation=1.96):
    """(template, branch, share of bad labels) of each url, by walking each host's tree node by node."""
    worst = {}
    for page, bad in labels:
        worst[page] = worst.get(page, False) or bad
    rows = []
    for page, url in urls:
        host, _, path = url.split("://", 1)[1].partition("/")
        lex = tuple("*" if any(c.isdigit() for c in s) else s for s in path.split("/") if s)
        rows.append((page, host, lex, worst.get(page)))

    def differs(own, all_):
        rate = sum(all_) / len(all_) if all_ else 0
        return bool(all_) and abs(sum(own) - len(own) * rate) > deviation * (len(own) * rate * (1 - rate)) ** 0.5

    out = {}

    def walk(members, at, template, branch, purity):
        marks = [r[3] for r in members if r[3] is not None]
        children = {}
        for r in members:
            if len(r[2]) == at:
                out[r[0]] = (template, branch, purity)
            else:
                children.setdefault(r[2][at], []).append(r)
        merged = {}
        for name, own in children.items():
            stays = name == "*" or len(own) >= share * len(members) or differs([r[3] for r in own if r[3] is not None], marks)
            merged.setdefault(name if stays else "*", []).extend(own)
        for name, own in merged.items():
            mine = [r[3] for r in own if r[3] is not None]
            deeper = differs(mine, marks)
            walk(own, at + 1, (*template, name), (*template, name) if deeper else branch, (sum(mine) + 1) / (len(mine) + 5) if deeper else purity)

    for host in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == host]
        marks = [r[3] for r in own if r[3] is not None]
        walk(own, 0, (), (), (sum(marks) + 1) / (len(marks) + 5))
    return {page: ("/" + "/".join(t), "/" + "/".join(b), round(p, 9)) for page, (t, b, p) in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_tree_equals_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k)}" for k in range(26)] + [f"x{chr(97 + k)}" for k in range(26)]
    urls = []
    for page in range(1500):
        depth = rng.choice([0, 1, 2, 2, 3, 5, 9])
        path = [rng.choice(words if d == 0 else words[: 3 * d + 1]) if rng.random() < 0.8 else str(page) for d in range(depth)]
        urls.append((page, f"http://{rng.choice(['a', 'b'])}.test/{'/'.join(path)}"))
    bad = {w: rng.random() for w in words}
    labels = [(p, rng.random() < bad.get(u.split("/")[3], 0.1)) for p, u in urls if rng.random() < 0.7]
    found = {r["page_id"]: (r["template"], r["branch"], r["bad_share"]) for r in judge(spark, urls, labels, rules=[]).collect()}
    assert found == plain(urls, labels)
    assert len({f[1] for f in found.values()}) > 5


@pytest.mark.parametrize("sections", [8, 40, 90])
def test_a_bad_section_is_blocked_among_any_number_of_others(spark, sections):
    names = ["casino", *(f"s{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(sections))]
    urls = [(k, f"http://h.test/{names[k % len(names)]}/{chr(97 + k % 26)}{k}/page.html") for k in range(20 * len(names))]
    labels = [(k, k % len(names) == 0) for k in range(20 * len(names))]
    found = judge(spark, urls, labels, rules=[]).collect()
    assert {(r["verdict"], r["branch"]) for r in found if "/casino/" in r["path"]} == {("block", "/casino")}
    assert {r["verdict"] for r in found if "/casino/" not in r["path"]} == {"allow"}


def test_very_deep_paths_walk_together(spark):
    deep = "/".join(f"d{chr(97 + k % 26)}" for k in range(3000))
    found = judge(spark, [(1, f"http://h.test/{deep}/end"), (2, f"http://h.test/{deep}/other"), (3, f"http://h.test/{deep}")]).collect()
    assert {r["template"][-6:] for r in found} == {"dj/end", "/other", "/di/dj"}
