from almanac.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
<div id=main><div class="post"><h2>Title&nbsp;one</h2><p>First   paragraph, with <b>bold</b> and <a href="x">a link</a>, long enough to count as text.<p>Second paragraph &lt;here&gt;; it goes on, and on, for a while.
<div class="ad-slot">Buy!</div><p>Third one<br>after a break, with commas, and more words to read.</div></div>
<aside>Side</aside><form><input value=x><label>Name</label></form><section id="comments"><p>Nice post, thanks, really, I mean it.</p></section><footer>&copy; me</footer></body></html>"""


def test_page_without_an_article():
    assert H.content(PAGE) == (
        "Title one First paragraph, with bold and a link, long enough to count as text. Second paragraph <here>; it goes on, and on, for a while. "
        "Third one after a break, with commas, and more words to read."
    )


def test_article_is_whole():
    page = "<body><nav>menu</nav><article><h1>Head</h1><p>x<p><b>bold <i>it</b> y<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article><div>junk</div>"
    assert H.content(page) == "Head x bold it y one two c1 c2"


def test_references_and_odd_markup():
    assert H.content("<article>a &eacute;&#233;&#xe9; &zzz; 1 < 2 &amp;amp;<!-- <p>no</p> --> <![CDATA[kept]]>z") == "a ééé &zzz; 1 < 2 &amp; keptz"
    assert H.content("") == "" and H.content(None) == "" and H.content("<p>   </p>") == ""
    assert H.content("just text") == "just text"
    assert H.content("<div hidden>no</div><div aria-hidden='true'>no</div><p role=note>no</p><p>yes") == "yes"
    assert H.content("<article><script>if (a < b) '<p>'</script>ok<noscript>no</noscript><textarea>no</textarea>") == "ok"


def test_deep_and_long_pages():
    assert H.content("<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"
    assert len(H.content("<article>" + "<p>word word.</p>" * 20_000)) == 20_000 * 11 - 1


def test_query(spark):
    rows = [(1, "u", PAGE, 1), (2, None, None, 2), (None, "v", "", 3), (1, "u", PAGE, 1), (2**60 + 1, "w", "<article>é", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = H.extract(df).collect()
    assert len(out) == 5 and H.extract(df).columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["url"] or "", r["n_chars"]) for r in out)[-1] == (2**60 + 1, "w", 1)
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert H.extract(df.limit(0)).count() == 0


def test_paths_decide_where_nothing_is_marked():
    """No article, no class: link lists, short captions and an imprint go by their paths' ratios."""
    import random

    r = random.Random(4)
    say = lambda n: " ".join("".join(r.choice("abcdeilmnorst") for _ in range(r.randint(2, 9))) for _ in range(n)).capitalize()
    hits = 0
    for _ in range(40):
        paragraphs = [", ".join(say(r.randint(6, 14)) for _ in range(r.randint(3, 7))) + "." for _ in range(r.randint(4, 12))]
        links = "".join(f"<li><a href=/{i}>{say(2)}</a></li>" for i in range(r.randint(5, 15)))
        page = (
            f"<body><div><ul>{links}</ul></div><table><tr><td>{say(2)}</td><td>{say(1)}</td></tr></table>"
            f"<div><div>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div></div><div><ul>{links}</ul><span>{say(3)}</span></div></body>"
        )
        hits += H.content(page) == " ".join(paragraphs)
    assert hits >= 38


def test_doubtful_ids_of_sections_and_headings_stay():
    long = "Words, and more words, that go on; for a while, in this part of the text."
    page = (
        f"<article><h1>Head</h1><p>{long}</p><h2 id=related-work>Related work</h2><p>{long}</p>"
        f"<section id=discussion><h2 id=ad-hoc>Discussion</h2><p>{long}</p><p>{long}</p></section>"
        "<div class=related><ul><li><a href=1>One more</a><li><a href=2>Another</a></ul></div><div class='ad'>Buy now.</div><p>End.</p></article>"
    )
    assert H.content(page) == f"Head {long} Related work {long} Discussion {long} {long} End."


def test_comments_teasers_and_broken_quotes():
    long = "Words, and more words, that go on; for a while, in this part of the text."
    comments = f"<ol class=comment-list><li><article><p>{long}</p></article></ol><div id=user-reviews-comments><p>{long}</p></div>"
    teaser = "<article class=teaser><h3><a href=x>Other story</a></h3><p>Read on.</p></article>"
    assert H.content(f"<main><article><h1>Head</h1><p>{long}</p><p>{long}</p></article>{teaser}{comments}</main>") == f"Head {long} {long}"
    assert H.content('<article><p class="x>one</p><p>two</p></article>') == "one two"
    assert H.content("""<article><p title="a > b, 'c'">one</p><p data-x='<b>'>two</p><a title=don't>three</a></article>""") == "one two three"


def test_a_mark_around_most_of_the_page_does_not_count():
    long = "Words, and more words, that go on; for a while, in this part of the text."
    assert H.content(f"<div class=widget><p>{long}</p><p>{long}</p></div><div class=sidebar><p>{long}</p></div>") == f"{long} {long}"


def test_ratios_are_sums_over_blocks_of_a_path():
    found = H.blocks("<div><p>One, two.</p><p>Three <a href=x>four</a></p><h2>Five</h2></div>")
    flat = H.smooth([9 + 6, 9 + 6, 2 * 4])  # smoothing by hand: text a block is (9 + 6) / 2 and 4
    by = H.ratios(found)
    length = H.smooth([(9 + 6) / 2, (9 + 6) / 2, 4])
    marks = H.smooth([(1 + 2) / 2, (1 + 2) / 2, 1])
    p = [a * b for a, b in zip(length, marks, strict=True)]
    assert abs(by[("div", "p")] - (p[0] + p[1]) / 2) < 1e-9 and abs(by[("div", "h2")] - p[2]) < 1e-9 and len(flat) == 3
