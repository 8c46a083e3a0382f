import hashlib
import random
import re

import pytest

from lureframe.llm import html_text as H
from lureframe.llm import pii as P

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            yield f"{kind}:{m.start()}:{m.end()}"


def spans(df):
    from pyspark.sql import functions as F

    found = P.personal_spans(df)
    rows = found.select("doc_id", P.span_list(F.filter("spans", lambda s: s["base"])).alias("base"), P.span_list(F.col("spans")).alias("all")).collect()
    return {r["doc_id"]: (r["base"], r["all"]) for r in rows}


def test_base_spans_equal_brute_force(docs):
    rng = random.Random(1)
    parts = ["a", ".", "@", "-", "+", "1", "2", "4242", "(", ")", " ", "é", "😀", "192.168.1.1", "4111111111111111", "4111-1111 1111-1111", "a@b.co", "+1 (269) 555-3296", "300.1.1.1", "\n", "0"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(1500)]
    rows += [(9001, "1" * 60_000), (9002, "1 " * 30_000), (9003, "a" * 100_000), (9004, ".1" * 30_000), (9005, "+1" + "(" * 30_000), (9006, None), (9007, "")]
    got = spans(docs(rows))
    for i, text in rows:
        assert got[i][0] == ",".join(brute(text or "")), text and text[:80]
        assert set(got[i][0].split(",")) <= set(got[i][1].split(",")) | {""}


def test_looser_candidates_need_the_corpus_on_their_side(docs):
    rows = [(i, f"please call me on +1 (269) 555-{1000 + i} or mail me at joe.{i}@mail.com today") for i in range(300)]
    rows += [(1000 + i, f"please call me by phone: (269) 555-{2000 + i} any day") for i in range(60)]
    rows += [(2000, "order number 4111111111111112 and version 999.1.1.1")]
    got = spans(docs(rows))
    assert got[1000][0] == "" and got[1000][1] == "phone:25:39"
    assert got[2000] == ("", "")


def test_counts_of_each_kind_of_personal_data(docs, tmp_path):
    """Each count is of its own kind, whatever the number and the order of a text's spans."""
    from lureframe.llm.queries import QUERIES

    email, ip, card, phone = "a@b.co", "1.2.3.4", "4111111111111111", "+1 (269) 555-3296"
    texts = ["", "plain", email, ip, card, phone, f"{ip}; {ip}; {email}", f"{phone}, {card}, {phone}, {email}", f"{card}; 4111111111111112; 300.1.1.1; {ip}"]
    rows = [*enumerate(texts), (99, None), (2, phone), (None, email)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        base = ",".join(brute(text or ""))
        want.append((i, *(base.count(f"{k}:") for k in P.KINDS), hashlib.sha256(base.encode()).hexdigest()))
    got = QUERIES["op7_personal_data"](docs([]).sparkSession, str(tmp_path)).collect()
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], *(r[f"n_{k}"] for k in P.KINDS), r["base_sha256"])) for r in got)


def test_personal_data_of_odd_rows(odd, none):
    assert P.personal_spans(odd).count() == 9 and P.personal_spans(none).count() == 0


ARTICLE = "<h1>Head</h1><p>First <b>long</b> paragraph of the article, with &amp; and &#233;.</p><p>No.</p><div><p>Second\n long paragraph,  all of it text.</p><blockquote>Quoted words stay.</blockquote></div>"
TEXT = "Head\nFirst long paragraph of the article, with & and é.\nNo.\nSecond long paragraph, all of it text.\nQuoted words stay."
AROUND = [
    ("<nav><ul><li><a href='/'>Home</a></li><li>More</li></ul></nav>", "<footer>&copy; us</footer>"),
    ("<header><p>Site name that is long enough to look like text</p></header><div class='cookie-notice'>We use cookies, and this is a long text about them.</div>", "<aside><p>Other stories that you may like to read today</p></aside><section id='comments'><p>A reader says something long about the article here.</p></section>"),
    ("<script>var x = '<p>no</p>';</script><style>p{}</style><div role='navigation'>Menu</div>", "<form><label>Your mail</label><input></form><div class='ad'>Buy this now, it is cheap and good.</div><div id='sidebar'><p>Links and links</p></div>"),
]


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class='post'>{}</div>"])
def test_article_is_cut_out(around, wrap):
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{around[0]}{wrap.format(ARTICLE)}{around[1]}</body></html>"
    assert H.main_text(page) == TEXT


@pytest.mark.parametrize(
    ("html", "text"),
    [(None, ""), ("", ""), ("<p>", ""), ("plain words", "plain words"), ("<p>open <i>tags<p>and &lt;more", "open tags\nand <more"), ("<script>x", ""), ("<!-- c --><p>a</p><!-- open", "a"), ("<p>a<br>b</p>", "a b"), ("</div></p><p>x</p></body>", "x"), ("<head><title>t</title><body><p>late", "late"), ("<div class='page with-sidebar'><p>all in one</p><nav>x</nav></div>", "all in one")],
)
def test_broken_pages(html, text):
    assert H.main_text(html) == text


LONG = [f"Paragraph {i} of the body, " + "with a good many words that belong to the text, " * 4 for i in range(6)]
BODY = "".join(f"<p>{t}</p>" for t in LONG)
PLAIN = "\n".join(t.strip() for t in LONG)


@pytest.mark.parametrize("kind", ["article", "main"])
def test_a_teaser_is_not_the_article(kind):
    assert H.main_text(f"<body><div id='content'>{BODY}</div><{kind}><p>A short card.</p></{kind}></body>") == PLAIN


def test_content_outside_the_region_stays():
    lede = "This lede stands before the body and sums it up in a sentence that is as long as a paragraph of it, " * 2
    for tag in ("article", "div"):
        page = f"<body><div><h1>Title of it all</h1><p>{lede}</p></div><{tag}>{BODY}</{tag}><div><a href='/'>Home</a></div></body>"
        assert H.main_text(page) == f"Title of it all\n{lede.strip()}\n{PLAIN}"


@pytest.mark.parametrize("name", "social-effects legal-history related-work search-algorithms modal-logic socialism consent-in-medicine menu-design promontory header-2 entry-header has-sidebar no-sidebar".split())
def test_a_slug_is_no_furniture(name):
    inner = f"{BODY}<section id='{name}'><h2 id='{name}'>A part</h2><p class='{name}'>Short.</p></section>"
    for page in (f"<article>{inner}</article>", f"<div class='layout {name}'><article>{inner}</article></div><div>&copy; us</div>", f"<div class='{name}'>{inner}</div><div>&copy; us</div>"):
        assert H.main_text(f"<body>{page}</body>") == f"{PLAIN}\nA part\nShort."


def test_a_name_alone_deletes_no_text():
    footer = "<div>&copy; us</div>"
    for name in ("sidebar", "menu", "header"):
        assert H.main_text(f"<body><div class='{name}'><article>{BODY}</article></div>{footer}</body>") == PLAIN
        assert H.main_text(f"<body><div class='{name}'>{BODY}</div>{footer}</body>") == PLAIN
        assert H.main_text(f"<body><article>{BODY}<h2 class='{name}' id='{name}'>A part</h2><section id='{name}'><p class='{name}'>Short.</p></section></article></body>") == f"{PLAIN}\nA part\nShort."


@pytest.mark.parametrize("name", ["ad", "ads-2", "cookie-notice", "comments", "commentList", "sidebar-left", "site-footer", "related-posts"])
@pytest.mark.parametrize("wrap", ["article", "div"])
def test_named_furniture_stays_out(name, wrap):
    other = f"<div class='{name}'><p>Some other words that stand beside it all.</p><article><p>A card.</p></article></div>"
    assert H.main_text(f"<body>{other}<{wrap}>{BODY}</{wrap}></body>".replace("<article><p>A card.</p></article>", "" if wrap == "div" else "<article><p>A card.</p></article>")) == PLAIN
    assert H.main_text(f"<body><article><p>Tiny.</p></article><div class='{name}'>{'An advert is longer than it. ' * 9}</div></body>") == "Tiny."


def test_extract_keeps_every_row(spark):
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    rows = [(1, None, None, "x"), (None, "u", "<p>hi</p>", "x"), (2, "u", long, "x"), (3, "u", "", "x"), (3, "u", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in H.extract(df).collect()))
    whole = "\n".join(["word word"] * 20_000)
    assert got == [(0, "hi", 2), (1, "", 0), (2, whole, len(whole)), (3, "", 0), (3, "", 0)]
    assert H.extract(df.limit(0)).count() == 0


def test_digest_of_no_spans():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


PROSE = "The council met on Monday and talked for hours about the new bridge over the river, which many people want. " * 4


def test_a_form_around_the_page_is_no_furniture_and_small_forms_are():
    assert H.main_text(f"<body><form id=aspnetForm><div><p>{PROSE}</p><p>Second. {PROSE}</p></div></form></body>").count("council") == 8
    small = "<form class=s><input><p>Search this site</p></form>"
    assert H.main_text(f"<body><div>{small}</div><article><p>{PROSE}</p></article>{small}</body>") == PROSE.strip()


def test_the_head_of_an_article_stays_and_that_of_the_page_goes():
    page = f"<body><header><p>The site</p></header><article><header><h1>A title</h1><p>Its lede.</p></header><p>{PROSE}</p></article></body>"
    assert H.main_text(page) == f"A title\nIts lede.\n{PROSE.strip()}"


def test_hidden_elements_inside_a_line_do_not_end_it():
    assert H.main_text("<body><p>x <button>b</button> y<script>z</script>!</p></body>") == "x y!"


def test_many_open_elements_are_read_in_linear_time():
    import time

    start = time.perf_counter()
    assert H.main_text("<b>" * 20_000 + "<p>x y z</p>" * 2_000).count("x y z") == 2_000
    assert time.perf_counter() - start < 3


def test_pages_with_columns_of_other_kinds(spark):
    df = spark.createDataFrame([(1, "u", "<p>Some text here.</p>", 5, "x")], "page_id long, url string, html string, text int, n_chars string")
    assert [tuple(r) for r in H.extract(df).collect()] == [(1, "u", "Some text here.", 15)]
