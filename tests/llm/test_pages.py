import collections
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from seriesforge.llm import html_layout, url_tree
from seriesforge.llm.queries_pages import RULES


def slow_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


URLS = [None, "", "no scheme", "http://", "http://ORG", "http://org/", "https://A.Org/x?y#z", "https://xorg/", "http://example.org/es/1", "http://example.org/es",
        "http://m.example.org/en/12/", "http://example.org/en/2", "http://a.com/fr/1", "http://a.com/de/1#f", "http://com/de/", "http://a.com?x=/de/",
        "http://a.com#://b.org/", "x://y://z.org/a", "http://ÄÖ.org/ü", "http://a.org:80/p", "http://a.com/de\n/1\n://"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)] + [(3, "http://org/"), (None, "http://org/")], "page_id long, url string")
    df = df.withColumns({"host": F.lit("clash"), "shape": F.lit(1), "key": F.lit(2)})
    labels = spark.createDataFrame([(1, True), (1, None), (None, True), (99, False)], "page_id long, bad boolean")
    got = url_tree.judge(df, labels, RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = "http://org/" if r.page_id is None or (r.page_id == 3 and r.host == "org") else URLS[r.page_id]
        host, path = slow_host_path(url)
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path), url
        assert r.rule == (max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else "block" if r.purity <= 0.5 else "allow")
    assert url_tree.judge(df.limit(0), labels, RULES).count() == 0


def slow_templates(rows):
    """rows: (host, segments, bad or None); template of each, level by level."""
    done = [""] * len(rows)
    for level in range(max(len(r[1]) for r in rows)):
        groups = collections.defaultdict(lambda: collections.defaultdict(list))
        for k, (host, segments, _) in enumerate(rows):
            if len(segments) > level:
                groups[host, done[k]][segments[level]].append(k)
        for (host, template), children in groups.items():
            total = sum(map(len, children.values()))
            named = {s: ks for s, ks in children.items() if len(ks) >= url_tree.MIN_URLS and len(ks) >= url_tree.MIN_SHARE * total}
            stats = {s: ([rows[k][2] for k in ks if rows[k][2] is not None]) for s, ks in named.items()}
            all_n, all_bad = sum(map(len, stats.values())), sum(map(sum, stats.values()))
            apart = set()
            for s, labelled in stats.items():
                n, b, m = len(labelled), sum(labelled), all_n - len(labelled)
                if n and m:
                    p = all_bad / all_n
                    if abs(b / n - (all_bad - b) / m) > url_tree.Z * math.sqrt(p * (1 - p) * (1 / n + 1 / m)):
                        apart.add(s)
            alike = sorted(set(named) - apart)
            for s, ks in children.items():
                name = "*" if s not in named else s if s in apart or len(alike) == 1 else f"({'|'.join(alike)})"
                for k in ks:
                    done[k] = f"{template}/{name}"
    return done


def test_templates_against_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for k in range(1500):
        host = rnd.choice(["a.net", "a.net", "b.net"])
        first = rnd.choice(["news", "news", "spam", "shop", f"rare{rnd.randrange(400)}"])
        second = rnd.choice(["x", "y", str(rnd.randrange(10_000)), f"{rnd.getrandbits(64):016x}"])
        label = None if rnd.random() < 0.4 else int(rnd.random() < (0.9 if first == "spam" else 0.1))
        rows.append((k, host, f"/{first}/{second}" + ("/" if k % 3 else ".html" if second not in "xy" else ""), label))
    df = spark.createDataFrame([(k, f"http://{h}{p}?q={k}") for k, h, p, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(k, bool(b)) for k, _, _, b in rows if b is not None], "page_id long, bad boolean")
    got = {r.page_id: r for r in url_tree.judge(df, labels, []).collect()}
    segments = [[re.sub(r"[0-9]+", "{n}", re.sub(r"^[0-9a-fA-F-]{16,}(?=\.|$)", "{hex}", s)) for s in p.split("/") if s] for _, _, p, _ in rows]
    expected = slow_templates([(h, s, b) for (_, h, _, b), s in zip(rows, segments)])
    assert [got[k].template for k in range(1500)] == expected
    everyone = [b for *_, b in rows if b is not None]
    for host in ("a.net", "b.net"):
        here = [b for _, h, _, b in rows if h == host and b is not None]
        share = (sum(here) + 10 * sum(everyone) / len(everyone)) / (len(here) + 10)
        for template in {t for t, r in zip(expected, rows) if r[1] == host}:
            own = [r[3] for t, r in zip(expected, rows) if t == template and r[1] == host and r[3] is not None]
            purity = 1 - (sum(own) + 10 * share) / (len(own) + 10)
            one = next(got[r[0]] for t, r in zip(expected, rows) if t == template and r[1] == host)
            assert one.purity == pytest.approx(purity) and one.verdict == ("block" if purity <= 0.5 else "allow")
    assert {r.verdict for r in got.values()} == {"allow", "block"}


def test_deep_paths(spark):
    df = spark.createDataFrame([(1, "http://h/" + "/".join("abcdefghij")), (2, "http://h/a")], "page_id long, url string")
    got = {r.page_id: r.template for r in url_tree.judge(df, spark.createDataFrame([], "page_id long, bad boolean"), []).collect()}
    assert got == {1: "/*" * url_tree.MAX_DEPTH, 2: "/*"}


@pytest.mark.parametrize("n,depth", [(400, 0), (9, 0), (9, 8)])
def test_small_branches_are_judged_on_large_hosts(spark, n, depth):
    """A bad branch of 20 urls is blocked beside n good ones of 20 each, as on a host of few, at any depth."""
    urls = [(f"http://h/{'d/' * depth}{'bad' if b == n else 'good' + chr(97 + b // 26) + chr(97 + b % 26)}/{k}", b == n) for b in range(n + 1) for k in range(20)]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, bad) for i, (_, bad) in enumerate(urls)], "page_id long, bad boolean")
    got = {r.page_id: r for r in url_tree.judge(df, labels, []).collect()}
    assert [got[i].verdict == "block" for i in range(len(urls))] == [bad for _, bad in urls]
    assert (url_tree.MANY in got[0].template) == (n > url_tree.LISTED) and got[len(urls) - 1].template.startswith("/d" * depth + "/bad")


PAGES = {
    "<p>One<p>Two <b>bold</b>,x<br>y": "One\n\nTwo bold,x\ny",
    "<h1>A  b</h1>text<div>c</div><div>d</div>": "A b\n\ntext\nc\nd",
    "<ul><li>a<li>b<ol start=3><li>c<li value=7>d<li>e</ol></ul>z": "- a\n- b\n  3. c\n  7. d\n  8. e\n\nz",
    "<ol><li>one<p>more</p></ol>": "1. one\n\n   more",
    "<table><tr><th>n<th>value<tr><td>long name<td>2<tr><td colspan=2>wide</table>": "n          value\nlong name  2\nwide",
    "<table>stray<td>a<td>b<tbody><tr><td>cc<td>d</table>": "stray\na   b\ncc  d",
    "<table><tr><td>x<table><tr><td>1<td>2</table><td>y</table>": "x     y\n\n1  2",
    "<pre>\n a\n   b\n</pre>c": " a\n   b\n\nc",
    "a &lt;b&gt; &amp;amp; &copy;<!-- no -->c": "a <b> &amp; ©c",
    "<style>.x{display:none} #y { visibility : hidden } i{color:red}</style><p class='a x'>no</p><p id=y>no<span style='visibility:visible'>yes</span></p><i>it</i>": "yes\n\nit",
    "<p hidden>no</p><p style='DISPLAY: none'>no</p><script>var a='<p>no</p>'</script><template>no</template>yes": "yes",
    "<head><title>no</title></head>yes": "yes", "<head><meta x>yes<p>more": "yes\n\nmore",
    "<details>no<summary>S</summary></details><details open><summary>T</summary>yes</details>": "S\nT\nyes",
    "<select><option>1<option selected>2</select>": "2", "1 < 2 <3": "1 < 2 <3", "</p>a</div></li>b": "ab", "": "", "<p>": "",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns", "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<a href=\"x>y\">in</a> <a href='unclosed>out": "in out",
    "<style>@media print{.a{display:none}} @media (max-width:9px){.a{display:none}.b{color:red}} @media screen, print {.c{display:none}}</style><i class=a>a</i> <i class=c>c</i>": "a",
    "<style>.x{display:none}</style><p class=x style='display:block'>in</p><p class=x>out": "in",
    "<style>.x{display:none!important} p#y{display:block}</style><p class=x id=y style='display:block'>out</p>in": "in",
    "<style>div.a .b > i.c{display:none} /* .z{display:none} */ p ~ b{display:none} a:hover{display:none}</style><div class='a k'><u><s class=b><i class=c>out</i><em><i class=c>in</i></em></s></u></div>"
    "<i class=c>too</i><b>b</b> <a class=z>z": "in\ntoob z",
    "<style>.a{display:none}.b{display:block}</style><p class='a b'>in<p class='b a'>in": "in\n\nin",
    "<style media=print>p{display:none}</style><p>in": "in", "<style>html .o, body > u{visibility:hidden}</style><b class=o>out</b><u>out<s style='visibility:visible'>in</s></u>": "in",
    "a<textarea>\n<b>two\nlines</textarea>c": "a<b>two\nlines c", "<svg><title>no</title><defs>no</defs><text>yes</text><text>more</text></svg>": "yes more",
    "<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>": "x=1",
    "<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>": "a  b  c\n   d  e\nf  g  h",
    "<table><tr><td>k<td rowspan=3>tall<td>1<tr><td>l<td>2<tr><td>m<td>3<tr><td>n<td>o<td>4</table>": "k  tall  1\nl        2\nm        3\nn  o     4",
    f"<table><tr><td>{'word ' * 14}<td>b<tr><td>c<td>d</table>": f"{('word ' * 12).strip()}  b\n{'word word'}\n{'c'.ljust(59)}  d",
    f"<table><tr><td>{'w' * 70}<td>b<tr><td>c<td>d</table>": f"{'w' * 70}  b\n{'c'.ljust(60)}  d",
    f"{'<ul><li>' * 150}x": "- " * 100 + "x", "<P>Up<DIV>per</DIV>": "Up\n\nper",
}


@pytest.mark.parametrize("page", PAGES)
def test_layout(page):
    assert html_layout.visible_text(page) == PAGES[page]


def random_page(rnd):
    """A page of nested elements, and its visible words in order."""
    words, hiding = [], [("hidden", ""), ("style='display:none'", ""), ("style='visibility:hidden'", ""), ("class=gone", ""), ("class='a gone'", ""), ("id=lost", "")]

    def part(depth, seen, inside):
        html = ""
        for _ in range(rnd.randint(1, 4)):
            kind = rnd.random()
            if kind < 0.4 or depth > 7:
                word = f"w{len(words)}x{rnd.randrange(1000)}" + ("&amp;" if rnd.random() < 0.1 else "")
                html += rnd.choice([" ", "\n", "<br>", "<!-- c --> "]) + word + " "
                words.append((word.replace("&amp;", "&"), seen))
                continue
            tag = rnd.choice(["div", "p", "section", "blockquote", "h2", "b", "i", "span", "a", "ul", "ol", "dl", "table", "details", "pre", "label"])
            if inside & {"p", "h2", "a", "pre", "label", "span", "b", "i"} and tag not in ("b", "i", "span"):
                tag = "span"
            extra, show = (rnd.choice(hiding)[0], False) if rnd.random() < 0.15 else ("", seen)
            within = inside | {tag}
            if tag in ("ul", "ol"):
                body = "".join(f"<li>{part(depth + 1, show, within - {'p'})}" + rnd.choice(["</li>", ""]) for _ in range(rnd.randint(1, 3)))
            elif tag == "dl":
                body = "".join(f"<dt>{part(depth + 2, show, within)}<dd>{part(depth + 1, show, within)}" for _ in range(2))
            elif tag == "table":
                if not show:
                    continue
                body = "".join("<tr>" + f"<td>{part(9, show, within)}" for _ in range(rnd.randint(1, 3)))
            elif tag == "details":
                body = f"<summary>{part(8, show, within)}</summary>"
                extra, body = (extra + " open", body + part(depth + 1, show, within)) if rnd.random() < 0.5 else (extra, body + part(depth + 1, False, within))
            else:
                body = part(depth + 1, show, within)
            html += f"<{tag} {extra}>{body}</{tag}>"
        return html

    body = part(0, True, set())
    return f"<html><head><title>no</title><style>.gone, #lost {{ display : none }} @media print {{ div {{ display: none }} }}</style></head><body>{body}</body></html>", [w for w, seen in words if seen]


def test_every_visible_word_in_order():
    rnd, seen = random.Random(11), 0
    for _ in range(400):
        page, words = random_page(rnd)
        got = re.findall(r"w\d+x\d+&?", html_layout.visible_text(page))
        assert got == words, page
        seen += len(words)
    assert seen > 4000


@pytest.mark.parametrize("page", ["<table>" + "<tr><td rowspan=9999 colspan=999>x" * 3000, "<style>" + "div " * 50 + "{display:none}</style>" + "<div>" * 5000 + "y", "<div>" * 20_000 + "x", '<a "' * 20_000, "<" * 50_000, "<table>" * 3000 + "y", "<ul><li>" * 5000 + "z",
                                  "<a b='" * 20_000 + ">", "<p>" * 50_000, "<!--" * 20_000, "<script>" * 20_000])
def test_odd_pages_take_little_time(page):
    start = time.process_time()
    html_layout.visible_text(page)
    assert time.process_time() - start < 5


def test_extract(spark):
    df = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (2, None), (3, ""), (None, "b" * 500_000)], "page_id long, html string").withColumn("text", F.lit("old"))
    got = html_layout.extract(df)
    assert got.columns == ["page_id", "html", "text"]
    assert sorted(((r.page_id, r.text) for r in got.collect()), key=repr) == sorted([(1, "a"), (1, "a"), (2, ""), (3, ""), (None, "b" * 500_000)], key=repr)
    assert html_layout.extract(df.limit(0)).count() == 0
