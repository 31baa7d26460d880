"""Small labelled table for the block classifier: invented pages, marked block by block.

A block's text starts with ``+`` where it belongs to the article and with ``-``
where it does not.  Words after the mark only matter by their number.
"""


def _w(n: int) -> str:
    return " ".join(["word"] * n)


def _p(*sizes: int, mark: str = "+") -> str:
    return "".join(f"<p>{mark}{_w(n)}.</p>" for n in sizes)


def _links(mark: str, *sizes: int) -> str:
    return "".join(f"<li><a href='/x'>{mark}{_w(n)}</a></li>" for n in sizes)


_MENU = f"<nav><ul>{_links('-', 1, 1, 2, 1)}</ul></nav>"
_FOOT = f"<footer><p>-&copy; {_w(6)}</p><a href='/t'>-{_w(2)}</a></footer>"

PAGES = [
    # article element, advert before it, few and many paragraphs, long and short
    f"{_MENU}<div class='ad'>-{_w(14)}.</div><article><h1>+{_w(7)}</h1>{_p(60, 45, 80)}</article>{_FOOT}",
    f"{_MENU}<div class='ad'>-{_w(3)}</div><article><h1>+{_w(3)}</h1>{_p(4, 2, 1, 12)}</article>{_FOOT}",
    f"{_MENU}<article><h1>+{_w(1)}</h1><p>+{_w(2)}</p></article>{_FOOT}",
    f"<article><h2>+{_w(4)}</h2><ul><li>+{_w(5)}</li><li>+{_w(3)}</li></ul><blockquote>+{_w(30)}</blockquote>"
    f"<table><tr><td>+{_w(1)}</td><td>+{_w(2)}</td></tr></table></article>{_FOOT}",
    # main element with sections; sidebar, share bar, notice and comments outside and inside
    f"<header><a href='/'>-{_w(2)}</a><p>-{_w(5)}</p></header><main><h1>+{_w(6)}</h1>{_p(35, 50)}"
    f"<aside><h3>-{_w(2)}</h3><p>-{_w(20)}.</p></aside>{_p(40)}<div class='share'>-{_w(2)}</div></main>"
    f"<section id='comments'><h3>-{_w(2)}</h3><div><p>-{_w(25)}.</p></div><div><p>-{_w(60)}.</p></div></section>{_FOOT}",
    f"<div class='cookie-notice'><p>-{_w(22)}.</p><button>{_w(1)}</button></div>{_MENU}<main><article><h1>+{_w(5)}</h1>"
    f"{_p(15, 8, 70)}<p>+<a href='/y'>{_w(3)}</a></p></article><div class='related'><h4>-{_w(2)}</h4>"
    f"<ul>{_links('-', 6, 8, 7)}</ul></div></main>{_FOOT}",
    f"<article><h1>+{_w(8)}</h1><div class='newsletter'><p>-{_w(12)}.</p></div>{_p(55, 30, 3)}"
    f"<footer><p>-{_w(9)}</p></footer></article><form><label>-{_w(2)}</label><p>-{_w(10)}</p></form>",
    f"<article><p>+<a href='/z'>{_w(9)}</a></p>{_p(25)}<p>+<a href='/z'>{_w(4)}</a> {_w(2)}</p></article>"
    f"<div class='sidebar'>{_p(30, 40, mark='-')}</div>",
    # no telling elements: long text among short link blocks
    f"<div><a href='/a'>-{_w(1)}</a></div><div><a href='/b'>-{_w(2)}</a></div><div><h1>+{_w(7)}</h1>{_p(65, 42, 18, 90)}</div>"
    f"<div><a href='/c'>-{_w(3)}</a></div><div>-{_w(4)}</div>",
    f"<div><ul>{_links('-', 1, 2, 1, 3)}</ul></div><div><h2>+{_w(5)}</h2>{_p(28, 33, 6, 47)}</div><div><ul>{_links('-', 4, 5, 6)}</ul></div>",
    f"<div>-{_w(3)}</div><div><a href='/a'>-{_w(12)}</a></div><table><tr><td><h1>+{_w(9)}</h1>{_p(120, 75, 22)}</td></tr></table>"
    f"<div><a href='/d'>-{_w(2)}</a> {_w(1)}</div><div>-{_w(5)}</div>",
    f"<div>{_p(50, 12, 35)}</div><div><a href='/e'>-{_w(7)}</a></div><div><a href='/f'>-{_w(9)}</a></div>",
    f"{_p(11, 24, 17)}{_FOOT}",
    f"{_p(30)}<div class='advert'><p>-{_w(30)}.</p></div>{_p(30)}<div class='promo'><p>-{_w(45)}.</p></div>",
    f"<div role='banner'><p>-{_w(4)}</p></div><div>{_p(20, 60)}</div><div role='contentinfo'><p>-{_w(15)}.</p></div>",
    # the article ends the page, or begins it; short and long last blocks
    f"{_MENU}<article><h1>+{_w(4)}</h1>{_p(40, 25)}</article>",
    f"<article><h1>+{_w(6)}</h1>{_p(9, 3)}</article>",
    f"<main><h1>+{_w(3)}</h1>{_p(80, 1)}</main>",
    f"<article><p>+{_w(2)}</p></article>",
    f"<main><h2>+{_w(2)}</h2><p>+{_w(4)}</p><p>+<a href='/g'>{_w(2)}</a></p></main>",
    f"<div><a href='/h'>-{_w(2)}</a></div><article><h1>+{_w(5)}</h1><p>+{_w(3)}</p></article><div>-{_w(6)}</div>",
    f"<div>-{_w(8)}</div><article>{_p(5, 70)}</article><div>-{_w(12)}</div>",
    f"<div>-{_w(2)}</div><div>-{_w(15)}</div><main><h1>+{_w(7)}</h1>{_p(22, 64)}</main><div>-{_w(9)}</div><div>-{_w(3)}</div>",
    f"<div>-{_w(4)} <a href='/i'>{_w(3)}</a></div><article><h2>+{_w(3)}</h2>{_p(14, 2, 33)}</article>",
    f"{_p(52, 20)}",
    f"<h1>+{_w(6)}</h1>{_p(31, 48, 16)}",
    f"<div><h1>+{_w(4)}</h1>{_p(90)}<p>+{_w(11)}</p></div>",
    # names of adverts and sidebars on the frame around everything
    f"<div class='overflow-hidden'>{_MENU}<h1>+{_w(5)}</h1>{_p(40, 40)}{_FOOT}</div>",
    f"<div class='layout sidebar-right'><div class='story'><h2>+{_w(4)}</h2>{_p(40, 40)}</div>"
    f"<div class='sidebar'>{_p(12, mark='-')}</div></div>",
    f"<form id='pageForm'>{_MENU}<div><h1>+{_w(6)}</h1>{_p(40, 35)}</div>{_FOOT}</form>",
    f"<form action='/'><h1>+{_w(3)}</h1>{_p(25, 60, 14)}<div class='newsletter'><p>-{_w(12)}</p></div></form>",
    f"<article class='tags-page'><h1>+{_w(4)}</h1>{_p(33, 42)}</article>",
    f"<div class='nav-open'>{_MENU}<main><h1>+{_w(5)}</h1>{_p(55, 12)}</main>{_FOOT}</div>",
    f"<div class='modal-open ads-enabled'><header><p>-{_w(3)}</p></header><div>{_p(38, 47)}</div>{_FOOT}</div>",
    f"<div class='sidebar-left'><article>{_p(20, 31)}<div class='promo'><p>-{_w(18)}</p></div></article></div>",
    f"<div class='widget-page'><h1>+{_w(8)}</h1>{_p(70, 66)}<ul><li>+{_w(4)}</li><li>+{_w(6)}</li></ul></div><section id='comments'>{_p(90, 80, mark='-')}</section>",
    f"<div class='menu-layout'><div class='sidebar-layout'><h1>+{_w(2)}</h1>{_p(44, 8, 2)}</div></div>",
    f"<article><h1>+{_w(5)}</h1><div class='search-history'>{_p(26)}</div>{_p(45)}</article>",
    f"<div class='post comments-open'><h1>+{_w(5)}</h1>{_p(29, 36)}</div><div class='comment-list'>{_p(27, mark='-')}</div>",
    f"<div>{_p(30, mark='+')}</div><div class='sidebar-right'><h1>+{_w(4)}</h1>{_p(40, 12)}</div>",
    f"<div class='nav-closed'>{_MENU}<article><h1>+{_w(7)}</h1>{_p(31, 28)}</article></div><div>{_p(45, mark='-')}</div>",
    f"{_p(27, 20)}<form><h1>+{_w(3)}</h1>{_p(40, 22)}</form>",
    f"<div class='sidebar-left'><div class='entry'>{_p(44, 21)}</div></div><div>{_p(31, 22)}</div>",
    # the same names, much text, no frame; and a frame with little text
    f"<h1>+{_w(4)}</h1>{_p(9)}<div class='sponsored'>{_p(60, 35, mark='-')}</div>",
    f"<article><p>+{_w(8)}</p></article><div class='advert'>{_p(90, mark='-')}</div>",
    f"<article><h1>+{_w(5)}</h1>{_p(10)}</article><form><p>-{_w(70)}</p></form>",
    f"<div class='cookie-wall'>{_p(50, 44, mark='-')}</div><main>{_p(16)}</main>{_FOOT}",
    f"{_p(7)}<div class='paywall'>{_p(20, 12, mark='-')}</div>",
    f"<main><h1>+{_w(6)}</h1>{_p(75, 40)}</main><div class='related'><article><h3>-{_w(4)}</h3><p>-{_w(14)}</p></article>"
    f"<article><h3>-{_w(5)}</h3><p>-{_w(12)}</p></article></div>{_FOOT}",
    f"<article><h1>+{_w(6)}</h1>{_p(62, 58)}</article><div class='teaser'><article>{_p(24, mark='-')}</article></div>",
    f"<div>{_p(66, 51)}</div><div class='promo'><header><p>-{_w(3)}</p></header>{_p(28, mark='-')}</div>",
    f"<div>{_p(50, 28)}</div><div class='promo'><article>{_p(30, 22, mark='-')}</article></div>",
    f"<article>{_p(30, 41)}</article><form><h1>-{_w(3)}</h1><p>-{_w(17)}</p></form>",
    # nothing but a paragraph or two; cards in article elements beside a longer text
    f"{_p(24)}", f"<div>{_p(16)}</div>", f"{_p(10, 13)}", f"<div><div>{_p(48)}</div></div>", f"{_MENU}<div>{_p(33)}</div>",
    f"<div><h1>+{_w(5)}</h1>{_p(85, 60, 44)}</div><article>{_p(21, mark='-')}</article>",
    f"<div><h1>+{_w(4)}</h1>{_p(52, 70)}</div><article>{_p(19, mark='-')}</article><article>{_p(14, mark='-')}</article>",
    f"<div>{_p(40, 61)}</div><div><a href='/n'>-{_w(3)}</a></div><div>-{_w(3)}</div>",
    f"<h1>+{_w(5)}</h1>{_p(88, 37, 42)}<div><a href='/n'>-{_w(2)}</a></div><div>-{_w(4)}</div>",
    f"<div>-{_w(3)}</div><div><a href='/n'>-{_w(14)}</a></div><div><h1>+{_w(6)}</h1>{_p(58, 49)}</div>",
    # the last block is the article's, short or after a link; or it is not, long or short
    f"<article>{_p(12)}<p>+<a href='/j'>{_w(9)}</a></p><p>+{_w(18)}</p></article>",
    f"<main>{_p(26)}<ul>{_links('+', 3, 6)}</ul><p>+{_w(5)}</p></main>",
    f"<article><p>+<a href='/k'>{_w(20)}</a></p>{_p(23)}</article>",
    f"<article><h1>+{_w(3)}</h1><p>+<a href='/k'>{_w(4)}</a></p>{_p(7)}</article>",
    f"<article>{_p(41, 6)}</article>",
    f"<article><h2>+{_w(4)}</h2>{_p(3)}</article>",
    f"<main>{_p(17)}<h3>+{_w(3)}</h3>{_p(5)}</main>",
    f"<div><h1>+{_w(5)}</h1>{_p(37, 19)}</div><div><a href='/l'>-{_w(3)}</a></div><div>-{_w(7)}</div>",
    f"<div>{_p(46, 29)}</div><div><a href='/m'>-{_w(2)}</a></div><div>-{_w(8)}</div>",
    f"<div>-{_w(6)}</div><main><h1>+{_w(4)}</h1>{_p(15, 6)}</main><div>-{_w(7)}</div>",
]
