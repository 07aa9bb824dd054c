"""Pages of many kinds: what stays and what goes, as a reader would have it."""

import pytest

from tagmill.llm.html_main import main_text, words_of

P = [f"This is sentence {k}, which goes on for a while, and then some more; it ends here. Another one follows, as is usual, and says more." for k in range(12)]
paras = lambda a, b: "".join(f"<p>{x}</p>" for x in P[a:b])
NAV = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">World</a></ul></nav>'
FOOT = "<footer><p>All rights reserved, by us. Contact us, if you like.</p></footer>"
COMMENT = '<article class="comment"><p>I, a reader, liked it a lot. It was good, and so on, and I said it.</p></article>'

#: name: page, what it says
PAGES = {
    "form around all": (f'<body><form id="aspnetForm" method="post"><input type="hidden">{NAV}<div class="c"><h1>Title here</h1>{paras(0, 6)}</div></form>{FOOT}', ["Title here", *P[:6]]),
    "form around an article": (f"<body><form>{NAV}<article><h1>Title here</h1>{paras(0, 3)}</article></form>", ["Title here", *P[:3]]),
    "sections of an article": (f"<body>{NAV}<article><section><h1>Title here</h1>{paras(0, 3)}</section><section>{paras(3, 9)}</section></article>{FOOT}", ["Title here", *P[:9]]),
    "divs of an article": (f"<body><article><div><h1>Title here</h1>{paras(0, 3)}</div><div>{paras(3, 9)}</div></article>", ["Title here", *P[:9]]),
    "comments in an article": (f'<body><article><h1>Title here</h1>{paras(0, 6)}<ol class="comment-list"><li>{COMMENT}<li>{COMMENT}</ol></article>', ["Title here", *P[:6]]),
    "comments in a main": (f'<body><main><h1>Title here</h1>{paras(0, 6)}<div class="user-comments"><p>{P[7]}</p></div></main>', ["Title here", *P[:6]]),
    "comments beside an article": (f'<body><article><h1>Title here</h1>{paras(0, 6)}</article><section id="comments-area">{COMMENT * 3}</section>', ["Title here", *P[:6]]),
    "cookie banner in a main": (f'<body><main><div class="cookie-banner"><p>{P[8]}</p></div><h1>Title here</h1>{paras(0, 6)}</main>', ["Title here", *P[:6]]),
    "advert in a main": (f'<body><main><h1>Title here</h1>{paras(0, 3)}<div class="ad-slot"><p>{P[8]}</p></div>{paras(3, 6)}</main>', ["Title here", *P[:6]]),
    "notice as prose": (f'<body><article><h1>Title here</h1>{paras(0, 3)}<div class="notice"><p>{P[3]}</p></div>{paras(4, 6)}</article>', ["Title here", *P[:6]]),
    "notice on top": (f'<body><div class="notice"><p>{P[8]}</p></div><article><h1>Title here</h1>{paras(0, 3)}</article>', ["Title here", *P[:3]]),
    "title in a header before": (f'<body><div class="page">{NAV}<header class="entry-header"><h1>Title here</h1></header><article>{paras(0, 4)}</article></div>', ["Title here", *P[:4]]),
    "title in a header within": (f'<body><article><header class="entry-header"><h1>Title here</h1></header>{paras(0, 4)}</article>', ["Title here", *P[:4]]),
    "site's own header": (f'<body><header class="site-header"><h1>The Daily Paper</h1>{NAV}</header><article>{paras(0, 4)}</article>', P[:4]),
    "frame with a telling name": (f'<body><div class="layout with-sidebar"><article><h1>Title here</h1>{paras(0, 3)}</article><div class="sidebar"><p>{P[8]}</p></div></div>', ["Title here", *P[:3]]),
    "no sidebar, no article": (f'<body><div class="content no-sidebar"><div><h1>Title here</h1>{paras(0, 6)}</div></div>{FOOT}', ["Title here", *P[:6]]),
    "aside in an article": (f"<body><article><h1>Title here</h1>{paras(0, 3)}<aside><p>{P[8]}</p></aside>{paras(3, 5)}</article>", ["Title here", *P[:5]]),
    "newsletter in an article": (f'<body><article><h1>Title here</h1>{paras(0, 3)}<div id="newsletterSignup"><p>{P[8]}</p></div>{paras(3, 5)}</article>', ["Title here", *P[:5]]),
    "share links": (f'<body><article><h1>Title here</h1><div class="share-buttons"><a href="/f">Share it</a> <a href="/t">Tell all</a></div>{paras(0, 5)}</article>', ["Title here", *P[:5]]),
    "related teasers": (f'<body><main><article><h1>Title here</h1>{paras(0, 6)}</article><div class="related-posts"><article class="teaser"><p>{P[8]}</p></article></div></main>', ["Title here", *P[:6]]),
    "teasers beside": (f'<body><article class="post"><h1>Title here</h1>{paras(0, 8)}</article><article class="teaser"><h2><a href="/x">Else</a></h2><p>{P[9][:60]}</p></article>', ["Title here", *P[:8]]),
    "two posts": (f"<body>{NAV}<div><article><h2>First one</h2>{paras(0, 3)}</article><article><h2>Second one</h2>{paras(3, 6)}</article></div>", ["First one", *P[:3], "Second one", *P[3:6]]),
    "role main": (f'<body>{NAV}<div role="main"><h1>Title here</h1>{paras(0, 4)}</div><div role="complementary"><p>{P[8]}</p></div>', ["Title here", *P[:4]]),
    "divs without names": (f"<body><div><a href='/'>One</a> <a href='/2'>Two</a></div><div><div>{paras(0, 3)}</div><div>{paras(3, 8)}</div></div>{FOOT}", P[:8]),
    "search form in an article": (f"<body><article><h1>Title here</h1><form><p>Find it, here.</p><input></form>{paras(0, 4)}</article>", ["Title here", *P[:4]]),
    "figures and quotes": (f"<body><article><h1>Title here</h1><figure><img><figcaption>A picture, seen.</figcaption></figure>{paras(0, 2)}<blockquote><p>{P[2]}</p></blockquote>{paras(3, 5)}</article>", ["Title here", "A picture, seen.", *P[:5]]),
    "tables and lists": (f"<body><main><h1>Title here</h1>{paras(0, 2)}<table><tr><th>a<td>1</table><ul><li>x<li>y</ul>{paras(2, 4)}</main>", ["Title here", *P[:2], "a", "1", "x", "y", *P[2:4]]),
    "footer of an article": (f"<body><article><h1>Title here</h1>{paras(0, 4)}<footer><p>Filed under this, and that.</p></footer></article>", ["Title here", *P[:4]]),
    "scripts and styles": (f"<body><article><h1>Title here</h1><script>var a = '<p>x</p>';</script><style>p {{}}</style>{paras(0, 2)}<noscript><p>{P[9]}</p></noscript></article>", ["Title here", *P[:2]]),
    "menu by name": (f'<body><div id="main-menu"><p>{P[8]}</p></div><div class="text"><h1>Title here</h1>{paras(0, 6)}</div>', ["Title here", *P[:6]]),
    "comment form": (f'<body><article><h1>Title here</h1>{paras(0, 4)}<div id="respond"><h3>Leave a reply</h3><form><p>Your mail, please.</p></form></div></article>', ["Title here", *P[:4]]),
    "popup by role": (f'<body><main><h1>Title here</h1>{paras(0, 4)}<div role="dialog"><p>{P[8]}</p></div></main>', ["Title here", *P[:4]]),
    "open comments in the name": (f'<body><article class="post comments-open"><h1>Title here</h1>{paras(0, 4)}</article>', ["Title here", *P[:4]]),
    "article body": (f'<body>{NAV}<div itemprop="articleBody">{paras(0, 4)}</div><div class="promo"><p>{P[8]}</p></div>', P[:4]),
    "main with a header": (f"<body><header>{NAV}</header><main><header><h1>Title here</h1></header>{paras(0, 4)}</main>", ["Title here", *P[:4]]),
    "breadcrumbs": (f'<body><main><ul class="breadcrumbs"><li>Home<li>News</ul><h1>Title here</h1>{paras(0, 4)}</main>', ["Title here", *P[:4]]),
    "nothing but a menu": (f"<body>{NAV}{FOOT}", []),
    "plain text": ("Only this, as it is", ["Only this, as it is"]),
    "aside that is the page": (f"<body><aside><h1>Title here</h1>{paras(0, 8)}</aside>{FOOT}", ["Title here", *P[:8]]),
    "pagination": (f'<body><article><h1>Title here</h1>{paras(0, 4)}<div class="pagination"><span>Page 1 of 2</span></div></article>', ["Title here", *P[:4]]),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_page(name):
    page, want = PAGES[name]
    assert main_text(page).split("\n") == (want or [""])


def test_words_of_names():
    assert words_of("no-sidebar withMenu cookieBanner ad_slot user-comments") == {"no", "with", "cookie", "banner", "ad", "slot", "user", "comments"}
