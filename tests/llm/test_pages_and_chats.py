import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SMALL
from treekin.llm import chat, html_text
from treekin.shared import table

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=x>one</a></li><li><a>two</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy this now.</div><article><h1>The  title</h1><p><b>First &amp; second<br>line &lt;x&gt; caf&eacute;.<p>Be.</p><aside>Related reading.</aside>
<p>Third paragraph with <a href=y>a link</a> in it.</p><form><label>Mail</label><input></form><script>var t="</p>";</script><div class="comments"><p>Nice one!</p></div></article>
<div id="sidebar"><p>About us.</p></div><footer>&copy; me &middot; all rights</footer></body></html>"""
WANT = "The title\n\nFirst & second line <x> café.\n\nBe.\n\nThird paragraph with a link in it."


def test_page(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, None), (3, "u", "", ""), (4, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert got[1]["text"] == got[4]["text"] == WANT and got[1]["n_chars"] == len(WANT)
    assert (got[2]["text"], got[2]["n_chars"], got[3]["text"]) == ("", 0, "")
    assert html_text.extract(df.where("page_id < 0")).count() == 0


def test_prior_alone_extracts_the_page():
    assert html_text.main_text(PAGE, html_text.PRIOR) == WANT
    plain = "<body><p>A longer paragraph of plain text that stands alone.</p><p>And one more of them, as long as that.</p></body>"
    assert html_text.main_text(plain, html_text.PRIOR).count("\n\n") == 1


@pytest.mark.parametrize("page", ["<", "<p", "<p a='", "</p></div>", "<!-- x", "<script>", "<div>" * 30_000 + "x", "a&am", "<p>" * 20_000, "<a><b></a></b>" * 2000, "x" * 200_000, "<p class=\"" * 300])
def test_broken_pages(page):
    html_text.main_text(page, html_text.PRIOR)


def test_layout_names_and_quotes():
    page = """<body class="has-sidebar comments-open"><p title=it's>One plain paragraph of text.</p><article class=post-sidebar><header class="entry-header"><h1>Title</h1></header>
    <p>It's "quoted" & a < b.</p><div class='post-comments'>Great!</div></article></body>"""
    assert html_text.main_text(page, html_text.PRIOR) == "One plain paragraph of text.\n\nTitle\n\nIt's \"quoted\" & a < b."


def test_cut_off_pages_keep_what_is_there():
    cut = PAGE[: PAGE.index("in it.")]
    assert html_text.main_text(cut, html_text.PRIOR).startswith(WANT[:60])


#: Pages marked up by hand: (html, text kept).
HAND = [
    (
        """<body class="page comments-open"><div id="site-header"><h1>The Daily</h1></div><div class="main-menu"><a href=a>News</a> <a href=b>Sport</a></div>
        <main><h2>Findings</h2><section id="related-work"><p>Others have looked at the same question before.</p></section><p class="tags-intro">Three tags are used below.</p>
        <p>Let <math><mi>x</mi><mo>+</mo><mi>y</mi><annotation encoding="tex">x+y</annotation></math> be a number.</p><ul><li><a href=c>A list item that is a link</a></li><li>and one that is none</li></ul>
        <object data=z><p>The text of an object.</p></object><div class="review"><p>We review all of the methods here, one after the other, in the order of their age.</p></div>
        <div class="related"><ul><li><a href=d>More</a></li><li><a href=e>Even more</a></li></ul></div><div class="share-buttons"><a href=f>Share</a></div>
        <div class="post-comments"><p>I have read this with great interest, and I agree with all of it, as you may imagine.</p></div></main>
        <div class="cookie-notice"><p>We use cookies on this site to make it better for you.</p></div><div id="footer">All rights reserved.</div></body>""",
        "Findings\n\nOthers have looked at the same question before.\n\nThree tags are used below.\n\nLet x+y be a number.\n\nA list item that is a link\n\nand one that is none\n\nThe text of an object.\n\n"
        "We review all of the methods here, one after the other, in the order of their age.",
    ),
    (
        """<div class=wrapper><noscript>Please enable scripts.</noscript><div class=navbar><ul><li><a href=1>Home</a><li><a href=2>Shop</a></ul></div><div class="post-content">
        <h1>How to bake</h1><p>Take flour, water and salt, and mix them well.</p><div class="ad-slot">Buy our oven today, it is the best one.</div><p>Bake it.</p>
        <table><tr><td>Flour</td><td>500 g</td></tr></table><div class=newsletter-signup><p>Get our letter every week.</p></div></div><div class="sidebar"><p>About the author of this page.</p></div></div>""",
        "How to bake\n\nTake flour, water and salt, and mix them well.\n\nBake it.\n\nFlour\n\n500 g",
    ),
    (
        """<article class="left-sidebar"><header class="entry-header"><h1>On headers</h1><p class="header">A header of the article is its own.</p></header><div class=commentsPolicy>Comments policy: be kind.</div>
        <p>Text with <noscript>a fallback</noscript> in it.</p><aside>See also this.</aside><div style="display:none">Hidden.</div><div class="social-links"><a href=x>Follow us</a></div></article><p>Outside, a full sentence stands alone here.</p>""",
        "On headers\n\nA header of the article is its own.\n\nComments policy: be kind.\n\nText with a fallback in it.\n\nOutside, a full sentence stands alone here.",
    ),
]


@pytest.mark.parametrize("source", ["prior", "trained"])
def test_pages_marked_up_by_hand(spark, source):
    """Recall and precision of blocks, with names that are not what they seem."""
    weights = html_text.PRIOR if source == "prior" else html_text.trained_weights(table(spark, SMALL, "pages"))
    kept = right = wanted = 0
    for page, text in HAND:
        got, want = Counter(html_text.main_text(page, weights).split("\n\n")), Counter(text.split("\n\n"))
        kept, wanted, right = kept + sum(got.values()), wanted + sum(want.values()), right + sum((got & want).values())
    assert right >= 0.95 * wanted and right >= 0.95 * kept, (right, wanted, kept)


def test_classifier_on_held_out_pages(spark):
    """Labels by markup are told from the text alone, on pages that were not trained on."""
    pages = [r["html"] for r in table(spark, SMALL, "pages").orderBy("page_id").collect()] + [p for p, _ in HAND]
    counts = [sum((html_text.marked(p or "") for p in pages[k::2]), Counter()) for k in (0, 1)]
    w = html_text.train(counts[0])
    right = sum(n for (label, x), n in counts[1].items() if (np.array(x) @ w > 0) == label)
    assert right >= 0.9 * sum(counts[1].values()) and {label for label, _ in counts[1]} == {0, 1}


def test_training_takes_pages_of_any_length(spark):
    long = "<article>" + "<p>One more sentence of it.</p>" * 20_000 + "</article><nav><ul><li><a href=x>y</a></ul></nav>"
    df = spark.createDataFrame([(long,), (long,), ("",), (None,)], "html string")
    w = html_text.trained_weights(df)
    assert not np.allclose(w, html_text.PRIOR) and np.allclose(w, html_text.train(html_text.marked(long)))
    assert np.array_equal(html_text.trained_weights(df.where("html = ''")), html_text.PRIOR)


def test_page_query(spark, monkeypatch):
    df = spark.createDataFrame([(None, None, PAGE), (7, "u", PAGE), (7, "u", PAGE), (8, "v", None)], "page_id long, url string, html string")
    monkeypatch.setattr(html_text, "table", lambda *a: df)
    rows = sorted((tuple(r) for r in html_text.op8_html_extraction(spark, "").collect()), key=str)
    assert rows == sorted([(None, None, WANT, len(WANT)), (7, "u", WANT, len(WANT)), (7, "u", WANT, len(WANT)), (8, "v", "", 0)], key=str)


def energy(cost, edges, labels):
    return sum(max(0, c) if not x else max(0, -c) for c, x in zip(cost, labels, strict=True)) + sum(w for i, j, w in edges if labels[i] != labels[j])


def test_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(1, 9)
        cost = np.array([round(rng.uniform(-1, 1), 2) for _ in range(n)])
        edges = [(i, j, round(rng.uniform(0, 0.9), 2)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.4]
        best = min(energy(cost, edges, x) for x in itertools.product((False, True), repeat=n))
        assert abs(energy(cost, edges, html_text.cut(cost, edges)) - best) < 1e-6


def test_long_undecided_chains():
    n = 4000
    edges = [(i, i + 1, 0.4) for i in range(n - 1)]
    cost = np.array([0.3 if i % 2 else -0.2 for i in range(n)])
    assert all(html_text.cut(cost, edges))


def best_cost(roles, costs):
    """All role sequences, merges and inserts, by breadth over (state)."""
    states = {chat.START: 0.0}
    for role in roles:
        new: dict[int, float] = {}
        for s, c in states.items():
            for cost, to, _, _ in chat.choices(s, role, costs):
                new[to] = min(new.get(to, 1e9), c + cost)
        states = new
    return min(c + chat.ending(s, costs)[0] for s, c in states.items())


def legal(rendered):
    turns = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", rendered, re.S)
    assert "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns) == rendered
    roles = [r for r, _ in turns]
    if roles and roles[0] == "system":
        roles = roles[1:]
    return len(roles) % 2 == 0 and roles and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles))


def test_chats(spark):
    rng = random.Random(4)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "User ", "bot", "tool", None]), rng.choice(["hi", "", None, f"text {turn}\nmore"]), "x"))
    rows += [(99, i, "user" if i % 2 else "assistant", "same", "y") for i in range(3000)]
    rows += rows[:15]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = chat.format_chats(df).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert len(got) == len(rows)
        by: dict = {}
        for r in sorted(got, key=lambda r: r["place"]):
            by.setdefault(r["conv_id"], []).append(r)
        source: dict = {}
        for conv, turn, role, text, _ in rows:
            source.setdefault(conv, []).append((turn, (role is not None, role or ""), (text is not None, text or "")))
        for conv, mine in by.items():
            roles = [chat.role_number(name if has else None) for _, (has, name), _ in sorted(source[conv])]
            assert abs(sum(r["cost"] for r in mine) - best_cost(roles, chat.Costs())) < 1e-9
            assert legal("".join(r["piece"] for r in mine))


def test_chats_with_ids_of_other_types(spark):
    """Ids that are no numbers; few conversations over many partitions, one of them in all."""
    rows = [(c, t, "user" if t % 2 else "assistant", f"{c} {t}") for c, n in (("a", 3), ("b", 400), ("c", 1)) for t in range(n)] + [(None, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = chat.format_chats(df).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert Counter(r["conv_id"] for r in got) == {"a": 3, "b": 400, "c": 1, None: 1} and len({r["place"] for r in got}) == len(rows)
    for conv in ("a", "b", "c", None):
        mine = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["place"])
        assert [r["turn"] for r in mine] == sorted(t for c, t, _, _ in rows if c == conv) and legal("".join(r["piece"] for r in mine))
        assert abs(sum(r["cost"] for r in mine) - best_cost([chat.role_number(r) for c, _, r, _ in rows if c == conv], chat.Costs())) < 1e-9


def test_chat_query(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0, "user", "u"), (1, 1, "assistant", None)] * 2, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat, "table", lambda *a: df)
    rows = sorted(chat.op7_chat_formatting(spark, "").collect(), key=lambda r: r["place"])
    assert [(r["turn"], r["action"]) for r in rows] == [(0, "keep"), (0, "merge"), (1, "keep"), (1, "merge")] and legal("".join(r["piece"] for r in rows))


def test_clean_chats_stay(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string")
    rows = chat.format_chats(df).orderBy("place").collect()
    assert {r["action"] for r in rows} == {"keep"} and sum(r["cost"] for r in rows) == 0
    assert "".join(r["piece"] for r in rows) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert chat.format_chats(df.where("turn < 0")).count() == 0
