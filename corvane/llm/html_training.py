"""The labelled table that the decision tree of ``html_blocks`` is grown from.

Pages are put together from paragraphs, things that stand beside a text, and layouts; main blocks carry ``data-main``.
Texts and parts take turns, so that neither their words nor one kind of mark-up goes with one label.
"""

from __future__ import annotations

_LONG = [
    "It rained for a week before anyone in the valley thought of asking where the water would go once the river was full, and by then it was late.",
    "Walking is slow enough to see things and fast enough to get somewhere before the evening, which is why I have never understood those who only run.",
    "Flour, water, salt and time are all you need for bread, and most of it is time. The rest is a hot oven and some patience. Do not open the door.",
    "Some pages have no marks for what is what, so the length of a block and the links in it and beside it have to tell the text from what stands around it.",
    "The bridge was built in two summers by forty people, none of whom had built a bridge before. It still stands, though nobody can quite say why it does.",
    "Les ponts de la ville ont été construits en pierre claire, puis repris en fer quand les trains sont arrivés dans la vallée, au siècle dernier.",
    "Der Fluss trat im Herbst über die Ufer, und die Leute trugen ihre Stühle auf den Dachboden. Im Winter holten sie die Stühle wieder herunter.",
    "El puerto quedó vacío cuando los barcos se hicieron grandes, y en los muelles crecieron la hierba y las historias de los que se habían quedado.",
    "we measured every well twice a day with a rope and a stone and wrote the depth on the wall of the mill so that all could read it and none had to ask",
    "The tower was long gone when the first of them came up the road with a cart of stones.",
    "Most of it is bread, with whatever lies next to it on the table.",
    "They say the sea gives and takes, but mostly it does neither.",
    "On trouve encore des sabots dans le grenier de la ferme.",
    "A page may go on for a while without any mark, so that it is only clear from its length what it is.",
    "In 1923 the clock stopped; it was 4:17. A smith, two masons and the priest went up to look. They came down with a pigeon, three eggs and no idea.",
]
_SHORT = ["It stopped.", "Yes.", "Then came the snow.", "Nobody knew.", "Bake it", "Two words", "One", "He went home before dawn.", "Enough!", "And so on, for years.", "À demain.", "Warum nicht?"]
_LINKED = [
    'See <a href=/o>our oven test</a> for more on heat and steam in small kitchens, which we wrote last year.',
    '<a href=/all>Every word of this one is a link in the text itself</a>',
    'Links: <a href=/1>one that is long enough to count for most of it</a>',
    'The <a href=/m>map of the valley</a> and the <a href=/w>list of all wells</a> hang in the town hall.',
]
_TITLES = ["Rain in the hills", "Bread", "On walking", "A page without frames", "Two boats", "Über Brücken", "What the Smith Saw", "el puerto"]

_MENUS = [
    "<nav><ul><li><a href=/>Home</a><li><a href=/n>News of the day</a><li><a href=/c>Contact us</a></ul></nav>",
    '<div id="menu"><a href=/>Home</a> <a href=/b>Blog</a> <a href=/p>Pictures and films</a></div>',
    "<p><a href=/>Home</a> | <a href=/a>About</a> | <a href=/w>Work</a></p>",
    '<ul class="nav-list"><li><a href=/>Start</a></li><li><a href=/s>Sport</a></li><li><a href=/k>Culture and books</a></li></ul>',
    "<header><div>The Daily Sheet</div><div><a href=/>Start</a> <a href=/s>Sport</a></div></header>",
    '<div><a href="/x">the,</a></div><div><a href="/y">weather</a></div><div><a href="/z">Log in or join</a></div>',
    "<nav><ul><li><a href=/q>and</a></li><li><a href=/r>no.</a></li></ul></nav>",
]
_ADS = [
    '<div class="ad">Buy two umbrellas and get a third one free today only.</div>',
    '<div class="ad">And thereby hangs a tale of shoes.</div>',
    '<div class="advert">Holidays at sea from nine euros a day, book now.</div>',
    '<div class="banner">Sale ends on Sunday, everything must go, visit our shop.</div>',
    '<div id="cookie-notice">We use cookies to make this site better, please accept them to go on.</div>',
    '<p class="notice">This site will be down for repairs on Monday from nine to ten, we are sorry.</p>',
    '<div class="ad">Nimm zwei. Zahl eins.</div>',
    '<div class="advert">Our spring sale has begun: coats, boots, hats and gloves from all makers at half the price until the end of the month, and whoever buys three pieces gets a fourth one free. Come in or call us, we are open every day from nine to six.</div>',
    '<div class="ad">La plus grande fête de la ville commence vendredi, avec de la musique, du vin et des jeux pour les enfants. Entrée libre. Venez tous, venez tôt, et apportez vos chaises, car les nôtres ne suffiront pas.</div>',
    '<div class="cookie-consent"><p>We and our partners store and read information on your device and process personal data, such as unique identifiers, for ads and content made for you. You may accept or refuse, and change your mind at any time. Some of this needs no consent.</p></div>',
    "",
]
_SIDES = [
    '<aside><p>Most read: <a href=/1>Ten cakes for a birthday</a></p><p>Subscribe to our letter and never miss a recipe again, it is free.</p></aside>',
    '<div class="sidebar"><h3>Tags</h3><a href=/t>shoes</a> <a href=/u>maps</a></div>',
    '<div class="related"><h4>More like this</h4><ul><li><a href=/x>Three ships</a></li><li><a href=/y>Why the well is deep</a></li></ul></div>',
    "<form action=/s><label>Search this site for words</label><button>Go</button></form>",
    '<div class="share">Tell your friends: <a href=/f>here</a> <a href=/g>there</a></div>',
    '<aside><h4>About the writer</h4><p>Ann has written about rivers, bridges and the people beside them for thirty years. She lives in the valley with two dogs and a boat that has never once been in the water, as she will tell you.</p></aside>',
    '<div class="promo"><p>Readers who join us this week get twelve issues for the price of six, a bag made of old sails, and our book of walks with maps, drawn by hand. Offer ends on Sunday at noon.</p></div>',
    '<div class="widget newsletter"><p>Our letter comes once a week and costs nothing. Leave your address and we will write to you.</p></div>',
    "",
]
_COMMENTS = [
    '<section class="comments"><p>Great recipe, I made it twice and my whole family loved it very much.</p><p>Thanks!</p></section>',
    '<div class="comments"><article><p>What a sad story this is, thank you for telling it. We cried for an hour.</p></article><article><p>Me too.</p></article></div>',
    '<div id="respond"><h3>Two replies</h3><p>I was there when it happened and it was not like this at all, the bridge was made of wood and nobody fell.</p></div>',
    '<ol class="comment-list"><li>First!</li><li>I do not agree with the second part, since the river was never that high, as my mother always said to us.</li></ol>',
    '<div class="comments"><p>We had the same in our village. First the road went, then the school, and then all at once the young people, until only the inn was left, and that burned down. What I want to say is that it is never the water alone.</p><p>So true.</p></div>',
    "",
    "",
]
_FOOTERS = [
    "<footer>&copy; 2020 The Valley Post &middot; All rights reserved, no part may be copied.</footer>",
    "<footer><a href=/i>Imprint</a> <a href=/p>Privacy</a></footer>",
    "<footer><p>Made with care by a small team of people in a small town by the sea, since many years and for many more.</p></footer>",
    "<footer>&copy; blog.example.org &middot; Made by the sea. Since long.</footer>",
    "<footer>&copy; m.example.net &middot; The words and pictures on these pages belong to those who made them and may be used by schools and libraries without asking. All others write to us first. We answer within a week or two, mostly.</footer>",
    "<footer>&copy; www.example.com &middot; Alle Texte und Bilder gehören uns und denen, die sie gemacht haben, und dürfen ohne Erlaubnis weder kopiert noch verändert noch verkauft werden, auch nicht in Teilen, und auch nicht übersetzt. Fragen. Antworten. Dank.</footer>",
    '<div class="footer"><p>Copyright 2019. All rights reserved.</p></div>',
    "<p><a href=/1>Next page of this site</a></p><p>Copyright 2019</p>",
    "",
]

# Where the parts go.  {inner}: something beside the text, within it.
_LAYOUTS = [
    "<body>{menu}{ad}<article>{text}</article>{comments}{side}{footer}</body>",
    "<body>{menu}{ad}<article>{title}{text}{more}</article>{comments}{footer}</body>",
    "<body>{menu}<article>{title}{text}</article>{side}{footer}</body>",
    "<body><main>{title}{text}{more}</main>{links}{footer}</body>",
    "<body>{menu}{ad}{title}{text}{more}{footer}</body>",
    "<body>{menu}<main>{text}{inner}{more}</main>{comments}{footer}</body>",
    '<body>{menu}{ad}<div class="content">{text}</div>{side}{comments}{footer}</body>',
    "<body>{menu}{text}{more}{footer}</body>",
    '<body><div class="page has-sidebar">{menu}<article>{text}</article>{side}</div>{footer}</body>',
    '<body>{menu}<article class="post social-science"><header>{title}</header><section>{text}</section>{inner}</article>{comments}{footer}</body>',
    '<body class="with-nav">{menu}<div class="post-with-comments">{text}{more}{comments}</div>{side}{footer}</body>',
    "<body>{menu}{ad}<div><div>{title}{text}</div></div>{side}{footer}</body>",
    "{menu}{ad}<article>{title}{text}{more}",
    "<body><article>{text}</article></body>",
    "<body>{text}{more}</body>",
    "<p data-main>{long}</p>{text}{footer}",
    '<body><form action="/">{menu}<div>{title}{text}{more}</div>{footer}</form></body>',
    '<body><form method="post" action="/page"><div class="all">{menu}{ad}<p data-main>{long}</p>{text}</div>{footer}</form></body>',
    '<body><div class="widget">{menu}{title}{text}{more}</div>{footer}</body>',
    '<body>{menu}<div id="search"><p data-main>{long}</p>{text}{more}</div></body>',
    '<body>{menu}<div class="social">{title}<p data-main>{long}</p>{text}</div>{plain}</body>',
    "<body>{links}<p data-main>{long}</p>{text}{more}{links}{plain}</body>",
    "<body>{menu}{ad}<article>{title}{text}</article>{footer}</body>",
    "<body><table><tr><td>{menu}</td></tr><tr><td>{text}</td></tr><tr><td>{footer}</td></tr></table></body>",
    '<body>{menu}<div id="main-content" class="menu-open">{title}{text}{more}</div>{side}{footer}</body>',
]
_PAGES_PER_LAYOUT = 40


def _text(k: int, n: int) -> str:
    """Some marked blocks; which are long, short or linked changes with ``k``."""
    out = []
    for i in range(n):
        turn = (k * 7 + i * 5) % 13
        if turn in (3, 8, 11):
            body = _SHORT[(k + i * 5) % len(_SHORT)]
        elif turn == 5:
            body = _LINKED[(k + i) % len(_LINKED)]
        else:
            body = " ".join(_LONG[(k * 3 + i + j) % len(_LONG)] for j in range(1 + (k + i) % 3))
        form = (k + 2 * i) % 9
        if form == 4:
            out.append(f"<ul><li data-main>{body}</li><li data-main>{_SHORT[(k + i) % len(_SHORT)]}</li></ul>")
        elif form == 6:
            out.append(f"<blockquote data-main>{body}</blockquote>")
        elif form == 7:
            out.append(f"<div data-main>{body}</div>")
        elif form == 8:
            out.append(f"<p data-main><b>{body}</b><br data-main>{_SHORT[(k + 3 * i) % len(_SHORT)]}</p>")
        else:
            out.append(f"<p data-main>{body}</p>")
    return "".join(out)


# Little text, so that a part beside it holds most of the words of the page.
_BRIEF = [
    '<article><p data-main>{0}</p><div class="comments"><p>{1}</p></div></article>',
    '<article><p data-main>{0}</p><div class="comments"><p>{1}</p></div><aside>Read on</aside></article>',
    '<article><p data-main>{0}</p></article><div id="comments"><p>{1}</p></div>',
    '<article><p data-main>{0}</p></article><p class="cookie-banner">{1}</p>',
]
_REMARKS = ["So true, thank you for it", "A neighbour writes that it was quite different in those days", "This site sets cookies", "We store cookies to count our readers"]


def _brief_pages(first: int) -> list[str]:
    return [page.format(_SHORT[(first + k) % len(_SHORT)], _REMARKS[(first + j + k) % len(_REMARKS)]) for j, page in enumerate(_BRIEF) for k in range(len(_REMARKS))]


def training_pages(first: int = 0) -> list[str]:
    """Labelled pages: every layout with parts and texts in turn, counted from ``first``."""
    out = []
    links = ["<p>{0}</p><p>{1}</p>", "<div>{1} {0}</div>", "<ul><li>{0}</li><li>{1}</li></ul>"]
    link = '<a href=/{0}>{0}</a>'.format
    plain = ["<p>Copyright 2019</p>", "<div>Printed from the web</div>", "<p>Page 2 of 7</p>", "<p>Copyright by the town, all rights reserved</p>", ""]
    for number, layout in enumerate(_LAYOUTS):
        for j in range(first, first + _PAGES_PER_LAYOUT):
            k = number * 5 + j * 11
            bare = "article" not in layout and "main" not in layout.split("{text}")[0] and "content" not in layout
            title = f"<h1 data-main>{_TITLES[k % len(_TITLES)]}</h1>"
            text = _text(k, 1 + (k + j) % 6)
            if bare:  # without any mark a lone short line cannot be told: such pages open with a long one
                text = f"<p data-main>{_LONG[k % len(_LONG)]}</p>" + text
            out.append(
                f"<head><title>{_TITLES[k % len(_TITLES)]}</title></head>"
                + layout.format(
                    menu=_MENUS[(k + j) % len(_MENUS)], ad=_ADS[(k + 2 * j) % len(_ADS)], side=_SIDES[(k + 3 * j) % len(_SIDES)], inner=_SIDES[(k + j) % (len(_SIDES) - 1)], comments=_COMMENTS[(k + j) % len(_COMMENTS)],
                    footer=_FOOTERS[(k + 4 * j) % len(_FOOTERS)], title=title, text=text, more=f"<p data-main>{_LONG[(k + 5) % len(_LONG)]}</p>", long=_LONG[(k + 2) % len(_LONG)], plain=plain[k % len(plain)],
                    links=links[k % len(links)].format(link("Older pages of this site"), link("Home")),
                )
            )
    return out + _brief_pages(first)
