"""Main text of pages of several shapes, and against a plain version on the given pages."""

import html
from html.parser import HTMLParser

from tesserae.llm import op13_extraction as op

SF = "/root/testdata/sf0.001"
PROSE = [
    "The first paragraph of the article, which is long enough, has commas, and says something.",
    "A second one follows, with a little more text, so that the container has many points.",
    "Short.",
    "The last paragraph ends it, after all, with one more sentence than there was before.",
]


class Plain(HTMLParser):
    """The text of the article element, block by block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.blocks.append([]) if tag in ("p", "h1") else self.blocks[-1].append(" " if tag == "br" else "")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.blocks.append([]) if tag in ("p", "h1", "article") else None

    def handle_data(self, data):
        if self.inside > 0:
            self.blocks[-1].append(data)


def test_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op.op13_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        plain = Plain()
        plain.feed(pages[r.page_id].html)
        plain.close()
        texts = [" ".join("".join(b).split()) for b in plain.blocks]
        assert r.text == "\n".join(t for t in texts if t) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def paragraphs():
    return "".join(f"<p>{html.escape(p)}</p>" for p in PROSE)


CLUTTER = {
    "menu": '<div class="main-menu"><a href="/a">A rather long entry, with a comma</a> <a href="/b">Another, long entry of a menu</a></div>',
    "nav": "<nav><ul><li><a href=/>Home, sweet home of this whole site</a></ul></nav>",
    "notice": '<div id="cookieNotice"><p>We use cookies, as everyone does, and ask, politely, whether you agree.</p></div>',
    "advert": '<div class="ad"><p>Buy this, buy that, and buy the other one, today, tomorrow, always.</p></div>',
    "side bar": '<div class="left sidebar"><p>About us, about them, about everyone, in a long, long text.</p></div>',
    "aside": "<aside><p>Read also, if you like, what others, who came before you, have read here.</p></aside>",
    "form": "<form><p>Your name, your address, your opinion, and all the rest of it, please.</p><input name=q></form>",
    "footer": "<footer><p>All rights reserved, in all countries, at all times, by all of us here.</p></footer>",
    "hidden": '<div style="display: none"><p>Nobody sees this, which is long, and has commas, as others do.</p></div>',
    "script": '<script>document.write("<p>written, by a script, and never part of the text</p>")</script>',
    "links": '<ul><li><a href="/1">One more story, of many</a><li><a href="/2">Two more stories, of many</a></ul>',
}
COMMENTS = '<section id="comments">' + "".join(f'<article class="comment"><p>I, reader {k}, liked it, very much, and write this, at length, to say so.</p></article>' for k in range(30)) + "</section>"


def test_clutter_goes_and_the_article_stays():
    inside = "<h1>Title &amp; more</h1>" + paragraphs()
    expected = "\n".join(["Title & more", *PROSE])
    shapes = {
        "article": "<body>{c}<article>{a}</article>{c}{r}</body>",
        "inside": "<body><main><article>{c}{a}{c}</article>{r}</main></body>",
        "containers": '<body class="has-sidebar"><div id=page>{c}<div class="content">{a}</div>{c}{r}</div></body>',
        "flat": "<body>{c}{a}{c}{r}</body>",
        "sections": "<body>{c}<article><header>{h}<p>By someone</p></header><section>{p}</section></article>{c}{r}</body>",
    }
    for name, shape in shapes.items():
        for what, clutter in CLUTTER.items():
            page = "<!DOCTYPE html><html><head><title>T</title><style>p {}</style></head>" + shape.format(c=clutter, a=inside, r=COMMENTS, h="<h1>Title &amp; more</h1>", p=paragraphs()) + "</html>"
            assert op.main_text(page) == expected, (name, what)


def test_blocks_and_markup():
    page = f"<article>{paragraphs()}<p>a&nbsp;&nbsp;b\n\t c<br>d<b>e</b><!-- no -->f &copy; &#233; &lt;p&gt;<p>next<ul><li>one<li>two <a href=x>link</a></ul><table><tr><td>u<td>v</table>bare<div>div</div>tail</article>"
    assert op.main_text(page).split("\n")[4:] == ["a b c def © é <p>", "next", "one", "two link", "u", "v", "bare", "div", "tail"]
    assert op.main_text("<article><p title='a > b' data-x=it's>kept, as <i>is</i></p><p>cut <a hre") == "kept, as is\ncut"
    assert op.main_text("<p>1 < 2 and 3 > 2 & so on; <3</p>") == "1 < 2 and 3 > 2 & so on; <3"
    assert op.main_text("<script>never ends <p>x</p>") == "" and op.main_text("") == "" and op.main_text("<nav><a href=/>x</a></nav>") == ""


def test_odd_rows(spark):
    long = "<article>" + "<p>Word, word and word again, for ever and ever.</p>" * 60_000 + "</article>"
    deep = "<div>" * 20_000 + "<p>Deep down, there is a text, which is found.</p>"
    rows = [(1, None, None, "x"), (None, "u", "<p>Same, same text, of a page that comes twice.</p>", None), (None, "u", "<p>Same, same text, of a page that comes twice.</p>", None), (2, "", long, "y"), (3, "d", deep, "z"), (4, "", "", "")]
    got = op.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(((r.page_id or 0, r.n_chars) for r in got.collect()))
    same, word, down = len("Same, same text, of a page that comes twice."), len("Word, word and word again, for ever and ever."), len("Deep down, there is a text, which is found.")
    assert found == [(0, same), (0, same), (1, 0), (2, 60_000 * (word + 1) - 1), (3, down), (4, 0)]
    assert op.extract(got.limit(0).selectExpr("page_id", "text as html")).collect() == []
