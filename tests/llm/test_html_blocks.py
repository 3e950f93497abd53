"""Main text through the decision tree: pages it was not grown from, the part that its features play, odd mark-up."""

import numpy as np
import pytest

from corvane.llm import html_blocks as H
from corvane.llm.html_training import training_pages

# Pages of other makes, with other texts; main blocks carry data-main.
HELD_OUT = [
    """<html><body class="single has-menu"><div class="wrapper"><div class="masthead"><a href=/>The Harbour Gazette</a></div><ul class="main-menu"><li><a href=/1>Ships</a></li><li><a href=/2>Tides
    and winds</a></li></ul><div class="story"><h1 data-main>Fog closes the port</h1><p data-main>For the third morning in a row no vessel left the port of Elmsby, as thick fog lay on the water from the lighthouse to the
    breakers' yard.</p><p data-main>"We wait," said the harbour master.</p><p data-main>Twelve freighters are at anchor outside, among them two that carry fruit and cannot wait for long.</p><div class="advert">Fresh fruit
    daily at the market hall, corner of King Street, from six in the morning.</div><p data-main>The forecast promises wind by Friday.</p></div><div class="related-stories"><a href=/a>When the light went out</a><a href=/b>A
    history of fog</a></div><div id="footer">Harbour Gazette Ltd, 4 Quay Road. All rights reserved.</div></div></body></html>""",
    """<form id="aspnetForm" method="post"><div><a href="/">Start</a> <a href="/kontakt">Kontakt</a> <a href="/hilfe">Hilfe und Fragen</a></div><h2 data-main>Der alte Garten</h2><p data-main>Hinter dem Haus lag ein Garten, in dem
    seit dreißig Jahren niemand mehr gegraben hatte, und doch blühte er in jedem Mai aufs Neue.</p><p data-main>Manche sagten, es liege an der Quelle. Andere sagten gar nichts, sondern kamen nachts mit dem Spaten.</p><p data-main>Gefunden wurde nie
    etwas.</p></form><footer>Gartenfreunde e.V. &middot; <a href=/i>Impressum</a></footer>""",
    """<main id="content"><nav><a href=/x>Recipes</a> &gt; <a href=/y>Soups</a></nav><article class="recipe"><header><h1 data-main>Onion soup</h1></header><p data-main>Cut six onions into thin rings and let them turn brown in butter, slowly, for the
    better part of an hour.</p><ul><li data-main>6 onions</li><li data-main>100 g butter</li><li data-main>1 litre of stock</li></ul><p data-main>Pour on the stock.</p><p data-main>Serve hot.</p></article><section id="comments"><h3>4 comments</h3><p>I
    burned the onions twice before I understood that slowly means slowly, but in the end it was the best soup we ever had in this house.</p><p>Lovely!</p></section></main><aside class="newsletter"><p>Sign up for one soup a week, straight to your
    inbox, and stop whenever you like.</p></aside>""",
    """<table><tr><td><a href=1>Index</a><br><a href=2>Volume two</a></td><td><p data-main>The second voyage began in April of 1768 with ninety-four men, eighteen months of provisions and a goat that had already been around the world once.</p><p
    data-main>It was an uneasy ship. The astronomer and the surgeon shared a cabin six feet long.</p></td></tr></table><p>Copyright 1998</p>""",
    """<div class="social-history-page"><div class="nav-top"><a href=/>Home</a></div><h1 data-main>Markets of the old town</h1><p data-main>Every Thursday the cloth merchants set up their tables between the church and the well, and by noon you could not
    hear your own voice.</p><p data-main>Prices were never written down.</p><div class="cookie-banner"><p>This site stores small files on your machine so that we know you when you come back. If you do not like that, you may leave or change your settings.</p>
    </div></div>""",
    """<body><article><h1 data-main>Kurz</h1><p data-main>Nein.</p><p data-main>Ja.</p><p data-main>Vielleicht später, wenn der Schnee weg ist.</p></article><div class="sidebar"><p>Der Autor lebt in den Bergen und schreibt selten, aber dann lange Briefe an Leute, die er nie
    gesehen hat und wohl nie sehen wird.</p></div></body>""",
    """<div><a href="/">front</a></div><div><a href="/p">previous</a></div><p data-main>I have kept bees for eleven years and been stung, by my own count, four hundred times, most of them deserved.</p><p data-main>A hive in June is sixty thousand opinions on one
    subject.</p><p data-main>Listen first.</p><p data-main>Then lift the lid, slowly, on a warm day with no wind, and never after rain, when all of them are at home and bored.</p><div><a href="/n">next</a></div><div>Copyright 2004, all rights reserved</div>""",
    """<body><div class="ad">Tyres half price. This week only.</div><article><h1 data-main>Carte postale</h1><p data-main>Il fait beau, la mer est froide et les crêpes sont trop chères, mais nous restons encore une semaine.</p><p data-main>Embrasse les enfants.</p></article><footer>&copy;
    cartes.example.org &middot; Écrire, c'est rester. Les cartes publiées ici ont été trouvées aux marchés de la région et appartiennent à ceux qui les ont reçues, ou à leurs enfants.</footer></body>""",
]


def scored(x, y):
    said = H.decide(H.train(), x)
    right = float((said & (y > 0)).sum())
    return right / max(1, said.sum()), right / y.sum()


def test_held_out_pages():
    precision, recall = scored(*H.labelled(HELD_OUT))
    assert precision >= 0.95 and recall >= 0.95, (precision, recall)


def test_further_pages_of_the_table():
    precision, recall = scored(*H.labelled(training_pages(first=1000)))
    assert precision >= 0.98 and recall >= 0.98, (precision, recall)


@pytest.mark.parametrize("group", [("words", "link_density"), ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "stops", "capitals", "kind", "upto")])
def test_words_and_links_decide(group):
    x, y = H.labelled(HELD_OUT)
    before = np.mean(H.decide(H.train(), x) == (y > 0))
    rng, wrong = np.random.default_rng(5), []
    for _ in range(20):
        mixed = x.copy()
        for name in group:
            k = H.FEATURES.index(name)
            mixed[:, k] = rng.permutation(mixed[:, k])
        wrong.append(np.mean(H.decide(H.train(), mixed) == (y > 0)))
    assert np.mean(wrong) < before - 0.08


def used(tree):
    return set() if len(tree) == 1 else {H.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])


def test_tree_uses_words_links_and_neighbours():
    names = used(H.train())
    assert H.FEATURES[H.train()[0]] == "link_density"
    assert names & {"words"} and names & {"words_before", "words_after"} and names & {"link_density_before", "link_density_after", "link_density_before_2"}


CASES = {
    "wrapper named for what is beside": (
        '<body><div class="page has-sidebar"><nav><a href=/>Home</a></nav><article><h1>The tower</h1><p>The tower was long gone when the first of them came up the road with a cart.</p><p>Nobody asked.</p></article></div></body>',
        "The tower\nThe tower was long gone when the first of them came up the road with a cart.\nNobody asked.",
    ),
    "article named for its subject": ('<article class="post social-science"><p>A survey of two hundred households says what people eat when nobody watches.</p><p>Bread.</p></article>', "A survey of two hundred households says what people eat when nobody watches.\nBread."),
    "post with comments": (
        '<div class="post-with-comments"><p>A survey of two hundred households says what people eat when nobody watches them at all.</p><p>It is mostly bread, with whatever lies next to it on the table in the evening.</p></div>',
        "A survey of two hundred households says what people eat when nobody watches them at all.\nIt is mostly bread, with whatever lies next to it on the table in the evening.",
    ),
    "custom element": ('<article><p>Before the icon there is a sentence of some length.</p><svg-icon name="x"></svg-icon><p>After it there is another sentence.</p></article>', "Before the icon there is a sentence of some length.\nAfter it there is another sentence."),
    "empty drawing": ('<article><p>Before the drawing there is a sentence.</p><svg viewBox="0 0 1 1"/><p>Between the drawings.</p><svg><path/></svg><p>After it.</p></article>', "Before the drawing there is a sentence.\nBetween the drawings.\nAfter it."),
    "unclosed frame": ("<article><p>Before the frame there is a sentence.</p><iframe src=x><p>After the frame there is one too.</p></article>", "Before the frame there is a sentence.\nAfter the frame there is one too."),
    "short block between long ones": (
        "<body><p>The first long paragraph of a page without any containers goes on for a while, so that it is clear what it is.</p><p>Yes.</p><p>The second long paragraph of a page without any containers goes on for a while, so that it is clear.</p></body>",
        "The first long paragraph of a page without any containers goes on for a while, so that it is clear what it is.\nYes.\nThe second long paragraph of a page without any containers goes on for a while, so that it is clear.",
    ),
    "quoted angle bracket": ('<article><p title="a > b">One &amp; two &lt;three&gt;\n\t and four.</p><p>Five.</p></article>', "One & two <three> and four.\nFive."),
}


@pytest.mark.parametrize("name", CASES)
def test_ordinary_pages(name):
    page, want = CASES[name]
    assert H.main_text(page, H.train())[0] == want


def test_long_page_and_odd_markup():
    long = "<body><nav><a href=/>Home</a></nav><article>" + "".join(f"<p>Paragraph {k} of a long page goes on for some words.</p>" for k in range(20_000)) + "</article><footer>The end of it all.</footer>"
    text, kept, found = H.main_text(long, H.train())
    assert (kept, found) == (20_000, 20_002) and text.startswith("Paragraph 0 of") and text.endswith("some words.")
    for odd in ("", " ", "<", "<>", "</", "<!--", "<p", "<script>", "&", "&#0;", "<a href='", "</div></div>", "<title>x", "\x00"):
        assert isinstance(H.main_text(odd, H.train())[0], str)
    assert H.main_text("<p>" * 50_000, H.train()) == ("", 0, 0)
    same = "<article>" + "<p>The same line again and again.</p>" * 3 + "</article>"  # repeated blocks all stay
    assert H.main_text(same, H.train())[0] == "\n".join(["The same line again and again."] * 3)
