import random
from collections import Counter
from html.parser import HTMLParser

from terseflow.llm import site_templates as st


def page(i, body, host="a.test"):
    return (i, f"https://u@{host.upper()}:80/p{i}", f"<html><head><title>t</title></head><body><nav><ul><li>Home<li>About</ul></nav><div class='main'>{body}</div><footer><p>&copy; Site</footer></body></html>")


SCHEMA = "page_id long, url string, html string"


def test_elements_close_as_browsers_do():
    starts, ends, hashes = st.elements("<div><p>a<p>b<br>c</div><li>x<li>x")
    text = "<div><p>a<p>b<br>c</div><li>x<li>x"
    assert [text[a:b] for a, b in zip(starts, ends)] == ["<p>a", "<p>b<br>c", "<div><p>a<p>b<br>c</div>", "<li>x", "<li>x"]
    assert hashes[3] == hashes[4] and len(set(hashes)) == 4
    assert st.elements("<p  a=1 b='2'> x  y")[2] == st.elements('<P b="2" a=1>x y</p>')[2]
    assert st.elements("<script>if (a < b) '</p>'</script><p>q</p>")[0] == [0, 34]


def test_templates_equal_brute_force(spark):
    rows = [page(i, f"<p>Body {i}</p><p>Same</p>" if i % 2 else f"<p>Body {i}</p>") for i in range(12)] + [page(100 + i, f"<p>Other {i}</p>", "b.test") for i in range(3)]
    seen, pages = Counter(), Counter()
    for _, url, html in rows:
        host = url.split("@")[1].split(":")[0].lower()
        pages[host] += 1
        for h in set(st.elements(html)[2]):
            seen[host, h] += 1
    expected = {}
    for page_id, url, html in rows:
        host = url.split("@")[1].split(":")[0].lower()
        template = {h for h in st.elements(html)[2] if seen[host, h] >= 5}
        cut, n = st.without(html, lambda hs: [int(h) in template for h in hs.tolist()])
        expected[page_id] = (st.visible(cut), n)
    for limit in (10**6, -1):
        found = {r.page_id: (r.text, r.n_removed) for r in st.extract(spark.createDataFrame(rows, SCHEMA), broadcast_hashes=limit).collect()}
        assert found == expected
    assert expected[0] == ("Body 0", 3) and expected[1] == ("Body 1", 4)
    assert "Home" in expected[100][0] and expected[100][1] == 0


def test_edge_cases(spark):
    deep = "<div>" * 5000 + "x"
    rows = [(1, None, None), (2, "no url", ""), (3, None, "<p>only &amp; text"), (None, "http://h/", "<b>q"), (4, "http://h/", deep), (5, "http://h/", "a < b \" '<'"), (5, "http://h/", "a < b \" '<'")]
    found = st.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    texts = {(r.page_id, r.host): (r.text, r.n_removed) for r in found}
    assert len(found) == 7
    assert texts[1, ""] == (None, 0) and texts[2, ""] == ("", 0) and texts[3, ""] == ("only & text", 0)
    assert texts[None, "h"] == ("q", 0) and texts[4, "h"] == ("x", 0) and texts[5, "h"][0].startswith("a < b")
    assert st.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_extra_columns_are_left_aside(spark):
    rows = [(1, "http://h/", "<p>a</p>", "x", 1)]
    found = st.extract(spark.createDataFrame(rows, SCHEMA + ", host string, key int")).collect()
    assert [(r.page_id, r.host, r.text) for r in found] == [(1, "h", "a")]


def test_section_templates_of_a_large_host(spark):
    rows = [(i, f"http://big/{i}", f"<body><nav>Section {i % 50}</nav><p>Body {i}</p><footer>Foot {i % 75}</footer></body>") for i in range(300)]
    found = {r.page_id: (r.text, r.n_removed) for r in st.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    # 50 navs on 6 pages each go, 75 footers on 4 pages each stay
    assert found == {i: (f"Body {i}\nFoot {i % 75}", 1) for i in range(300)}


def test_unclosed_heads_and_noscripts():
    for head in ("<head><title>t</title>", "<head lang='>'><meta charset=x><!-- </head> -->\n<script>'<body>'</script><title>a <style> b</title><noscript><link></noscript>", "<HEAD><style>p{}</style><noscript>"):
        for rest in ("<body><p>a</p><p>b</p></body>", "<p>a</p><p>b</p>", "<noscript>x</noscript><p>a<p>b", "</head><body><p>a<p>b", "a<p>b</html>"):
            assert st.visible(f"<html>{head}{rest}") == "a\nb", (head, rest)
    assert st.visible("<p>a<noscript><p>b") == "a\nb" and st.visible("<p>a<noscript>x</noscript><noscript>b") == "a b"
    page = "<head><title>t</title><body><p>a</p><noscript><p>b</p>"
    starts, ends, _ = st.elements(page)
    assert {"<head><title>t</title>", "<p>a</p>", "<p>b</p>"} <= {page[a:b] for a, b in zip(starts, ends)}


def test_null_page_ids_lose_their_templates_at_every_size(spark):
    rows = [(None if i % 2 else i, *page(i, f"<p>Body {i}</p>")[1:]) for i in range(8)] + [(None, None, None), (None, "http://b/", "<nav>Home</nav>")]
    for limit in (10**6, -1):
        found = [(r.page_id, r.text, r.n_removed) for r in st.extract(spark.createDataFrame(rows, SCHEMA), broadcast_hashes=limit).collect()]
        assert sorted(found, key=str) == sorted([(None if i % 2 else i, f"Body {i}", 3) for i in range(8)] + [(None, None, 0), (None, "Home", 0)], key=str)


class Tree(HTMLParser):
    """An independent reading of pages whose tags are all closed: nested (tag, attributes, children)."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ("", (), [])
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = (tag, tuple(sorted((k, v or "") for k, v in attrs)), [])
        self.open[-1][2].append(node)
        if tag not in ("br", "img"):
            self.open.append(node)

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        if data.split():
            self.open[-1][2].append(" ".join(data.split()))


def subtrees(node):
    for child in node[2]:
        if not isinstance(child, str) and child[0] not in ("br", "img"):
            if child[0] not in ("html", "body"):
                yield repr(child)
            yield from subtrees(child)


def left_over(node, template):
    texts, n = [], 0
    for child in node[2]:
        if isinstance(child, str):
            texts.append(child)
        elif repr(child) in template:
            n += 1
        else:
            more, k = left_over(child, template)
            texts += more
            n += k
    return texts, n


def test_equals_another_parser(spark):
    rng = random.Random(4)

    def element(depth):
        tag = rng.choice(["div", "p", "section", "h2"] if depth else ["p", "h2"])
        inner = "".join(element(depth - 1) for _ in range(rng.randint(1, 3))) if depth and tag in ("div", "section") else f"{rng.choice('abcdef')} &amp; {rng.randrange(4)}<br>x"
        return f"<{tag}{rng.choice(['', ' class=k', ' id=1 class=z'])}>{inner}</{tag}>"

    rows = [(i, f"http://{'ab'[i % 2]}.test/{i}", f"<html><body>{''.join(element(2) for _ in range(4))}</body></html>") for i in range(60)]
    trees = {i: Tree(html).root for i, _, html in rows}
    for limit in (10**6, -1):
        found = {r.page_id: r for r in st.extract(spark.createDataFrame(rows, SCHEMA), broadcast_hashes=limit).collect()}
        some = 0
        for host in (0, 1):
            seen = Counter(t for i in trees if i % 2 == host for t in set(subtrees(trees[i])))
            template = {t for t, n in seen.items() if n >= st.MIN_PAGES}
            for i in trees:
                if i % 2 == host:
                    texts, n = left_over(trees[i], template)
                    some += n
                    assert found[i].n_removed == n and found[i].text.split("\n") == texts
        assert some > 20
