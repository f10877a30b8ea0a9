import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakevec.llm import html_text as h


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("no markup &amp; all", "no markup & all"),
        ("<body><nav>x</nav><article><h1>A&amp;B</h1><p>one <b>two<p>three  \n four<br>five</article><footer>f", "A&B one two three four five"),
        ("<article>a<div class='ad'>buy</div><aside>s</aside><form>f</form><script>1<p>2</script><style>p{}</style>b</article>c", "a b"),
        ("<div class=sidebar>s</div><div id='comments'>c</div><p>kept</p><div class='adventure'>also</div>", "kept also"),
        ("<article><p>body</p><article class='comment'>reader</article></article>", "body"),
        ("<p>unclosed <!-- note --> <i>x", "unclosed x"),
        ("<ul><li>one<li>two</ul>", "one two"),
        ("<article><p>body</p></article><ol class='comments'><li>reader</ol>", "body"),
        ("<article>a &lt;b&gt; &#233;&nbsp;c</article>", "a <b> é c"),
    ],
)
def test_main_text(html, text):
    assert h.main_text(h.parse(html), None) == text


def test_deep_nesting_does_not_recurse():
    assert h.main_text(h.parse("<div>" * 20_000 + "x"), set()) == "x"
    h.hashed(h.parse("<div>" * 20_000 + "x"))
    h.hashed(h.parse("<article><div>" + "<b>" * 20_000 + "x"))


def test_templates_go_and_copies_are_no_template(spark):
    rows = [(i, f"http://A.example/{i}", f"<body><div>Site notice of ours</div><div><p>story {i} here</p></div></body>") for i in range(20)]
    rows += [(100 + i, "http://b.example/x", "<body><div>same page</div></body>") for i in range(20)]
    rows += [(None, None, None), (7, "not a url", ""), (7, "not a url", "")]
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[3]["text"] == "story 3 here" and by[105]["text"] == "same page" and by[None]["text"] == "" and by[None]["n_chars"] == 0
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string, host string")).count() == 0


def test_articles_of_the_given_pages(spark):
    import html
    import re

    def plain(page):
        m = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S).group(1)
        return " ".join(x for x in (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)>", m)) if x)

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = h.op6(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages) and all(r["text"] == plain(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in got)
    # Without the counted boxes the adverts stay in the texts of all hosts with enough pages.
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    off = {r["page_id"]: r["text"] for r in h.extract(table, box_pages=2.0).collect()}
    n = {r["host"]: r["n"] for r in table.groupBy(h.host_of(table["url"]).alias("host")).agg(F.countDistinct("html").alias("n")).collect()}
    hosts = {r["page_id"]: r["host"] for r in table.select("page_id", h.host_of(table["url"]).alias("host")).collect()}
    assert all((off[r["page_id"]] != r["text"]) == (n[hosts[r["page_id"]]] >= 5) for r in got) and max(n.values()) >= 5


def extracted(spark, pages):
    rows = [(i, f"http://a.example/{i}", html) for i, html in enumerate(pages)]
    return [r["text"] for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_copies_of_a_page_do_not_hide_a_template(spark):
    pages = [f"<body><div>Site words of ours</div><div><p>story {i} here</p></div></body>" for i in range(20)]
    got = extracted(spark, pages + ["<body><div>Site words of ours</div><div><p>copied page</p></div></body>"] * 300)
    assert got == [f"story {i} here" for i in range(20)] + ["copied page"] * 300


def test_many_pages_are_a_template_on_a_large_host(spark):
    pages = [f"<body><div>{'Section words' if i < 120 else f'own line {i}'}</div><div><p>story {i} here</p></div></body>" for i in range(1500)]
    got = extracted(spark, pages)
    assert got[:120] == [f"story {i} here" for i in range(120)] and got[200] == "own line 200 story 200 here"


def test_equals_counting_of_whole_blocks(spark):
    """Blocks without telling names, against a plain count of equal strings and of names over the pages of each host."""
    rng = random.Random(4)
    said = ["we use small files here", "call us any day", "written by the team", "all rights kept"]
    pages = {}
    for i in range(400):
        host, blocks = f"h{rng.randrange(4)}.example", []
        for _ in range(rng.randint(0, 3)):
            blocks.append(("", rng.choice(said)))
        if rng.random() < (0.9 if host < "h2" else 0.2):
            blocks.append(("zone", f"offer {rng.randrange(10**6)}"))
        blocks.append(("story", " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))))
        rng.shuffle(blocks)
        pages[i] = (host, blocks)
    hosts = Counter(host for host, _ in pages.values())
    same, named, part, whole = Counter(), Counter(), Counter(), Counter()
    for host, blocks in pages.values():
        same.update({(host, *b) for b in blocks})
        whole[host] += sum(len(t) for _, t in blocks)
        for name in {n for n, _ in blocks if n}:
            named[host, name] += 1
            part[host, name] += sum(len(t) for n, t in blocks if n == name)

    def stays(host, name, text):
        if same[host, name, text] >= max(5, 0.1 * hosts[host]):
            return False
        return not (name and named[host, name] >= 0.5 * hosts[host] and part[host, name] / named[host, name] <= 0.2 * whole[host] / hosts[host])

    rows = [(i, f"https://{host}/{i}", "<body>" + "".join(f'<div class="{n}">{t}</div>' if n else f"<div>{t}</div>" for n, t in blocks)) for i, (host, blocks) in pages.items()]
    got = {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: " ".join(t for n, t in blocks if stays(host, n, t)) for i, (host, blocks) in pages.items()}
    assert got == want
    assert any("offer" in x for x in got.values()) and any("offer" not in x for x in got.values()) and not any(y in x for x in got.values() for y in said)


def test_nothing_is_cut_out_of_an_article(spark):
    """Links, spans and other inline elements that recur on all pages, in an article and in main."""
    for tag in ("article", "main"):
        pages = [f"<body><nav>menu</nav><{tag}><p>w{i} see <a href=x>here</a> for <span>more</span> about <kbd>keys</kbd> u{i}</p><ul><li><a>link</a> v{i}</ul></{tag}></body>" for i in range(20)]
        assert extracted(spark, pages) == [f"w{i} see here for more about keys u{i} link v{i}" for i in range(20)]
    pages = [f"<body><main>See <a>the manual</a> <span>print</span> and , w0x{i}</main></body>" for i in range(20)]
    assert extracted(spark, pages) == [f"See the manual print and , w0x{i}" for i in range(20)]


def test_the_lead_of_an_article_stays(spark):
    pages = [f'<body><div class="menu">go home</div><div class="post"><div class="lead">lead {i} w</div><div class="text">{" ".join(f"t{i}x{k}" for k in range(60))}</div></div></body>' for i in range(20)]
    assert extracted(spark, pages) == [f"lead {i} w " + " ".join(f"t{i}x{k}" for k in range(60)) for i in range(20)]


def test_headings_that_recur_stay(spark):
    pages = [f"<body><h2>{'Introduction' if i % 10 == 0 else f'Title {i}'}</h2><p>story {i} of <a>links</a></p><p>more {i}</p></body>" for i in range(100)]
    assert extracted(spark, pages)[:2] == ["Introduction story 0 of links more 0", "Title 1 story 1 of links more 1"]


@pytest.mark.parametrize("n", [100, 400])
def test_a_sentence_goes_whatever_the_size_of_its_host(spark, n):
    pages = [f"<body>{'<div>Read our rules here</div>' if i % 20 == 0 else ''}<div><p>story {i} with some words</p></div></body>" for i in range(n)]
    assert extracted(spark, pages) == [f"story {i} with some words" for i in range(n)]


def test_densest_block():
    def of(html):
        found, flat = h.densest(h.parse(html))
        return found and found.names, flat.tag

    assert of("<body><div class=wrap><div class=sidebar>s s</div><div class=content>words of it</div></div></body>")[0] == "content"
    assert of("<body><div class=ad>buy</div><div class=page><div class=sidebar>s</div><div class=inner>many words of text</div></div></body>")[0] == "inner"
    assert of("<body><p>one</p><p>two</p></body>") == (None, "body") and of("") == (None, "")
