import html as entities
import re

from quern.llm import html

DATA = "/root/testdata/sf0.01"
LONG = "The cat of the house is in the garden with a dog and the dog was not in the house when we were there for it. " * 3


def article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1].replace("<br>", " ")
    blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_whole_pages(spark):
    rows = html.extract(spark.read.parquet(f"{DATA}/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    assert all(r.text == article(pages[r.page_id]) for r in rows)


def test_blocks():
    side = "<nav><a href='/x'>Home</a></nav><aside><p>{0}</p></aside><div class='cookie-notice'><p>{0}</p></div><form><p>{0}</p></form><div id=comments><p>{0}</p></div><footer>{0}</footer>".format(LONG)
    assert html.main_text(f"<body>{side}<div><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div></body>") == "\n".join([LONG.strip(), "Short one.", LONG.strip()])
    assert html.main_text(f"<main><h1>Title</h1><p>a &amp; b&nbsp;c<br>d</p>{side}</main>") == "Title\na & b c d"
    assert html.main_text(f"<p>{LONG}</p><p><a href=x>one two three four</a></p>") == LONG.strip()
    assert html.main_text("<article><script>if (a<b) { x('</p>') }</script><!-- <p>no</p> --><style>p{}</style><p>yes</article>") == "yes"


def test_odd_pages(spark):
    pages = [None, "", "plain words", "<p>un<b>closed", "<", "<a href='x>y'>link</a>", "<div>" * 3000 + "deep", "&lt;p&gt;", "<p>" + LONG * 500]
    rows = [(i, p, "old") for i, p in enumerate([*pages, pages[2]])]
    got = {r.id: r.text for r in html.extract(spark.createDataFrame(rows, "id int, html string, text string")).collect()}
    assert got[0] == got[1] == "" and got[2] == got[9] == "plain words" and got[3] == "unclosed" and got[6] == "deep"
    assert got[8] == (LONG * 500).strip()


RUSSIAN = "Кошка жила в доме у самой реки, и каждое утро она выходила в сад, чтобы посмотреть на птиц, которые прилетали из леса. " * 3


def test_pages_without_article():
    a, b = LONG.strip(), LONG + "More of it."
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Section {i}</a></li>" for i in range(20)) + "</ul>"
    page = f"<body>{menu}<div id=content><h2>Head</h2><p>{a}</p><p>Short line.</p><p>{b}</p></div>{menu}<p>Imprint</p></body>"
    assert html.main_text(page) == "\n".join(["Head", a, "Short line.", b])
    # a teaser in an article element doesn't take the place of the text
    got = html.main_text(f"<div id=content><p>{a}</p><p>{b}</p></div><article class=card><p>A teaser.</p></article>")
    assert a in got and b in got


def test_names_that_wrap_the_text():
    for name in ("has-search content", "product-form", "no-sidebar", "ad-free-content", "with-comments"):
        assert html.main_text(f"<div class='{name}'><p>{LONG}</p></div>") == LONG.strip(), name
    for name in ("cookie-notice", "comments", "comment-list", "site-footer", "ad", "sidebar-content", "related items"):
        assert html.main_text(f"<p>{LONG}</p><div class='{name}'><p>{LONG} again</p></div>") == LONG.strip(), name
    assert html.main_text(f"<p>{LONG}</p><div class='login-form'><p>Enter your name here.</p></div><p>{LONG}</p>") == "\n".join([LONG.strip()] * 2)


def test_neighbours_decide_in_articles_too():
    links = "<p><a href=x>One long list of links and more of them to look at</a> <a href=y>and another of the same kind here</a></p>"
    page = f"<article><p>{LONG}</p><p>Kept line.</p>{links}<p>Lost line.</p>{links}</article>"
    assert html.main_text(page) == f"{LONG.strip()}\nKept line."


def test_language_without_a_list():
    assert html.main_text(f"<ul><li><a href=x>Меню</a></ul><div><h1>Кошка</h1><p>{RUSSIAN}</p><p>{RUSSIAN}</p></div>") == "\n".join(["Кошка", RUSSIAN.strip(), RUSSIAN.strip()])


def test_hostile_pages_are_linear():
    import time

    for piece in ("<b c='", "<b c=\"'>", "<div>", "</span>", "<p>a", "<!--", "<script>", "<a '\"", "<div></p></span>"):
        start = time.process_time()
        html.main_text(piece * (300_000 // len(piece)))
        html.main_text("<span>" + piece * (300_000 // len(piece)) + ">")
        assert time.process_time() - start < 3, piece


def test_a_name_never_drops_the_whole_text():
    b = LONG + "More of it."
    names = "layout-with-sidebar,two-columns-sidebar,page-right-sidebar,content content--sidebar,entry ad,story-promo,layout-menu,article-sharing,single-post-sponsored,page-newsletter,wide-footer,ad,sidebar,comments".split(",")
    for name in names:
        assert html.main_text(f"<div class='{name}'><p>{LONG}</p><p>{b}</p></div>") == f"{LONG.strip()}\n{b}", name
        # a real side part inside goes, and so does the name where the text stands elsewhere
        assert html.main_text(f"<div class='{name}'><p>{LONG}</p><p>{b}</p><div class=cookie-notice><p>{LONG} cookies</p></div></div>") == f"{LONG.strip()}\n{b}", name
        assert html.main_text(f"<p>{LONG}</p><p>{b}</p><div class='{name}'><p>{LONG} aside</p></div>") == f"{LONG.strip()}\n{b}", name
    for tag in ("form", "fieldset", "dialog", "aside", "footer"):
        assert html.main_text(f"<{tag}><h1>Head</h1><p>{LONG}</p><p>{b}</p></{tag}>") == f"Head\n{LONG.strip()}\n{b}", tag
    assert html.main_text("<form action='.'>" + f"<div><p>{LONG}</p><p>{b}</p></div><div class=login><p>Your name please and your password here, or you will not get in.</p></div></form>") == f"{LONG.strip()}\n{b}"
    deep = "<div class=ad>" * 3000
    assert html.main_text(f"{deep}<p>{LONG}</p>") == LONG.strip()


FINNISH = "Kissa asui talossa joen rannalla, ja joka aamu se meni puutarhaan katsomaan lintuja, jotka lensivät metsästä. Koira seurasi sitä aina hiljaa perässä, vaikka se ei koskaan saanut lintua kiinni, mutta molemmat palasivat iloisina kotiin."


def test_stray_stop_words_of_another_language():
    assert html.main_text(f"<p>{FINNISH}</p><p>{FINNISH} se se.</p>") == f"{FINNISH}\n{FINNISH} se se."


def test_dense_blocks_between_good_ones():
    code = "<pre>" + "\n".join(f"value{i} = function{i}(argument{i}, other{i})" for i in range(40)) + "</pre>"
    dense = "Kernel scheduler latency histogram buckets, cgroup throttling counters, NUMA balancing migrations, hugepage compaction stalls, interrupt coalescing thresholds, PCIe bandwidth saturation, cache eviction rates, branch misprediction percentages."
    got = html.main_text(f"<div><p>{LONG}</p>{code}<p>{LONG}</p><p>{dense}</p></div>").split("\n")
    assert len(got) == 4 and got[1].startswith("value0 = ") and got[1].endswith("other39)") and got[3] == dense
    # the same beside a list of links isn't the text
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Section {i} of the whole site, with all that is in it and more</a></li>" for i in range(9)) + "</ul>"
    assert dense not in html.main_text(f"<div><p>{LONG}</p><p>{LONG}</p>{menu}<p>{dense}</p></div>")


def test_remarks_as_articles():
    nested = f"<article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><section><article><p>{LONG} says one</p></article><article><p>I agree.</p></article></section></article>"
    assert html.main_text(nested) == "\n".join(["Head", LONG.strip(), LONG.strip()])
    after = f"<main><article><h1>Head</h1><p>{LONG}</p></article><section><h2>2 Comments</h2><article><p>{LONG} says one</p></article><article><h4>Bob</h4><p>I agree.</p></article></section></main>"
    assert html.main_text(after) == f"Head\n{LONG.strip()}"
    # two articles without such a heading are two articles, and an article around the only article is none
    assert html.main_text(f"<article><p>{LONG}</p></article><article><p>{LONG} too</p></article>") == f"{LONG.strip()}\n{LONG.strip()} too"
    assert html.main_text(f"<article><article><p>{LONG}</p></article></article>") == LONG.strip()


def naive_two_passes(blocks):
    """The rules of both passes on blocks outside articles, told once more, by looking at every neighbour."""
    en = set(html.STOP_WORDS["en"])
    labels = []
    for text, linked in blocks:
        words, dense = re.findall(r"[^\W\d_]+", text.lower()), len("".join(text.split()))
        share, links = sum(w in en for w in words) / max(1, len(words)), linked / max(1, dense)
        if links > 0.5 or len(text) < 70 and linked:
            labels.append("bad")
        elif len(text) < 70:
            labels.append("short")
        elif links <= 0.25 and len(text) > 200:
            labels.append("good" if share >= 0.25 else "near" if share >= 0.12 else "long")
        else:
            labels.append("near" if share >= 0.12 else "bad")
    kept = []
    for i, (text, _) in enumerate(blocks):
        before = next((labels[j] for j in range(i - 1, -1, -1) if labels[j] in ("good", "bad")), None)
        after = next((labels[j] for j in range(i + 1, len(blocks)) if labels[j] in ("good", "bad")), None)
        near = [x for x in (before, after) if x]
        keep = labels[i] == "good" or labels[i] != "bad" and (not near or ("good" in near if labels[i] == "near" else "bad" not in near))
        kept += [text] if keep else []
    return "\n".join(kept)


def test_passes_against_naive_ones():
    import random

    rng = random.Random(4)
    stops, names = html.STOP_WORDS["en"], [f"{a}{b}word" for a in "bcdfgklm" for b in "aeiou"]
    for _ in range(300):
        blocks, page = [], ""
        for _ in range(rng.randint(1, 14)):
            share, n = rng.choice([0.0, 0.05, 0.2, 0.5]), rng.choice([2, 8, 20, 60])
            words = [rng.choice(stops) if rng.random() < share else rng.choice(names) for _ in range(n)]
            cut = rng.choice([0, 0, n // 5, n // 2, n])
            blocks.append((" ".join(words), len("".join(words[:cut]))))
            page += f"<p><a href=x>{' '.join(words[:cut])}</a> {' '.join(words[cut:])}</p>" if cut else f"<p>{' '.join(words)}</p>"
        blocks.append((LONG.strip(), 0))
        blocks.append((LONG.strip(), 0))
        page += f"<p>{LONG}</p><p>{LONG}</p>"
        if html.language_list(html.blocks_of(page)[0]) == frozenset(stops):
            assert html.main_text(page) == naive_two_passes(blocks)


def test_empty_table(spark):
    assert html.extract(spark.createDataFrame([], "id int, html string")).collect() == []
