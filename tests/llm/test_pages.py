import numpy as np

from tickloom.llm import main_text
from tickloom.llm.fm_index import SEPARATOR, FMIndex, repeated_windows


def texts(spark, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    return {r.page_id: r.text for r in main_text.extract(pages, **options).collect()}


def test_parts_of_a_page(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
    <body class="has-sidebar"><header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></ul></nav>
    <div id="sidebar">side</div><div class="cookie-notice">cookies</div><!-- <p>no</p> -->
    <article class="post has-comments"><h1>Title &amp; &#233;</h1><p>One <b>two</b>
    three&lt;four</p><div class="ad-slot">buy</div><form><label>mail</label></form><p>Five<br>six
    <section class="comments"><p>nice</p></section></article><aside>x</aside><footer>&copy; me</footer></body></html>"""
    assert texts(spark, [(1, "http://a/1", page)]) == {1: "Title & é One two three<four Five six"}


def test_article_inside_a_wrapper():
    content = lambda page: " ".join(t for k, t in main_text.blocks(page) if k == main_text.CONTENT)
    chrome = "<nav>menu</nav><div class='sidebar'><article>teaser</article></div><div class='related-posts'><article>more</article></div>"
    article = "<article><h1>Title</h1><p>body<form>mail</form><div class='ad-slot'>buy</div></article>"
    for wrap in ("<form id='aspnetForm' action='x'>{}</form>", "<div id='content-sidebar-wrap'>{}</div>",
                 "<div class='page-with-sidebar'>{}</div>", "<form><div class='page-with-sidebar'>{}</div></form>"):
        for inner in (article, article.replace("article", "main"), f"<main>{article}</main>"):
            assert content(f"<body><header>top</header>{wrap.format(chrome + inner)}<footer>end</footer></body>") == "Title body"
    assert content("<form><p>x</p></form><aside><article>a</article></aside><ol class='comment-list'><article>c</article></ol>"
                   "<div class='page-with-sidebar'><article class='teaser'>t</article><div hidden><main>h</main></div></div>"
                   "<form class='search-form'><main>s</main></form>") == ""
    assert content(f"{article}<div class='left-sidebar'><article>teaser</article></div>") == "Title body"
    assert content("<form><div class='left-sidebar'><article>teaser</article></div>" + article + "</form>") == "Title body"


def test_suffix_array_removes_what_pages_share(spark):
    chrome = "<div>Welcome to this very nice site of ours</div>"
    rows = [(i, f"http://h.example/{i}", f"{chrome}<p>w{i} alone says page {i}</p>") for i in range(40)]
    rows += [(100, "http://other.example/", f"{chrome}<p>alone here</p>"), (101, None, None), (102, "bad", ""),
             (103, "http://h.example/0", "<article>Welcome to this very nice site of ours</article>"), (0, *rows[0][1:])]
    want = {i: f"w{i} alone says page {i}" for i in range(40)}
    want |= {100: "Welcome to this very nice site of ours alone here", 101: "", 102: "",
             103: "Welcome to this very nice site of ours"}
    assert texts(spark, rows) == want
    assert texts(spark, rows, shard_pages=10) == want
    assert texts(spark, []) == {}


def test_runs_shared_across_shards(spark):
    """What two pages share goes, whichever shards of the host the pages are in."""
    notice = [" ".join(f"n{k}x{j}" for j in range(8)) for k in range(20)]
    rows = [(i, f"http://h.example/{i}", f"<div>{notice[i % 20]}</div><p>w{i} alone says page {i}</p>") for i in range(40)]
    rows += [(50, "http://other.example/", f"<p>{notice[0]}</p>"), (51, "http://h.example/51", "<p>a b c</p>")]
    want = {i: f"w{i} alone says page {i}" for i in range(40)} | {50: notice[0], 51: "a b c"}
    assert texts(spark, rows) == want
    assert texts(spark, rows, shard_pages=2) == want


def test_repeated_tokens_brute():
    rng = np.random.default_rng(5)
    for _ in range(30):
        tokens = rng.integers(0, 4, 120)
        page = np.sort(rng.integers(0, 5, 120))
        ends = np.append(page[1:] != page[:-1], True)
        tokens[ends] = 100 + np.arange(ends.sum())
        want = np.zeros(120, bool)
        for a in range(120 - 3):
            if any(page[a] != page[b] and (tokens[a:a + 4] == tokens[b:b + 4]).all() for b in range(120 - 3)):
                want[a:a + 4] = True
        assert np.array_equal(main_text.repeated_tokens(tokens, page, 4), want)


def test_fm_index_brute():
    rng = np.random.default_rng(7)
    for _ in range(30):
        parts = [rng.integers(2, 5, rng.integers(6, 20)) for _ in range(8)]
        symbols = np.concatenate([np.append(p, SEPARATOR) for p in parts])
        starts = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
        ends = starts + [len(p) for p in parts]
        index = FMIndex(symbols, 20)
        windows = [(s, tuple(symbols[s:s + 5])) for a, b in zip(starts, ends) for s in range(a, b - 4)]
        want = sorted(s for s, w in windows if sum(w == x for _, x in windows) > 1)
        assert sorted(repeated_windows(index, symbols, starts, ends, 5).tolist()) == want
