"""Labelled pages that the extraction model is fitted on.

Each page is drawn from layouts of the kinds that sites use.  An element's ``data-y``
says whether its text is main text (1) or not (0); it holds for all below until another
one.  Words are invented, so only markup, lengths and positions can be learned.
"""

from __future__ import annotations

import random

_SYLLABLES = "an be ce do er fi gra hu in jo ka lo men nu on pre qui ra sto ti un ver wi xe you zu".split()

#: Openings of the element around an article, and of its inner body.
_AROUND = [
    "article", "article", "article", "article", "main", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"',
    'div class="article-body"', 'section class="story"', 'div id="main"', 'div role="main"', 'td class="text"',
    'article class="post hentry"', 'div itemprop="articleBody"', 'div class="page-body"', "div", "section",
]
_MENUS = ["nav", 'div class="nav"', 'ul class="menu"', 'div id="navigation"', 'div class="breadcrumbs"',
          'div class="topbar links"', 'nav role="navigation"', 'ol class="breadcrumb"', 'div class="menu main-menu"']
_HEADS = ["header", 'div class="header"', 'div id="masthead"', 'div class="site-header banner"', 'header role="banner"']
_FEET = ["footer", 'div class="footer"', 'div id="footer"', 'footer class="site-footer"', 'div class="copyright"',
         'div role="contentinfo"']
_SIDES = ["aside", 'div class="sidebar"', 'div id="sidebar"', 'aside class="widget"', 'div class="related"',
          'section class="related-posts"', 'div class="recommended"', 'div role="complementary"', 'div class="tags"',
          'div class="popular"', 'div class="author-box"', 'div class="share social"', 'td class="side"']
_NOTICES = ['div class="cookie-notice"', 'div id="cookie-banner"', 'div class="notice"', 'div class="alert"',
            'div role="alert"', 'div class="gdpr consent"', 'section class="newsletter"', 'div class="subscribe"',
            'div class="paywall message"', 'p class="disclaimer"', 'div role="dialog"', 'div class="popup modal"']
_ADS = ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div id="ad-top"', 'aside class="advertisement"',
        'div class="sponsored"', 'div class="promo"', 'ins class="adsbygoogle"', 'div class="banner-ad"']
_TALK = ['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="commentlist"',
         'div class="discussion"', 'div id="disqus_thread"', 'section id="responses"', 'div class="reader-comments"',
         'div class="replies"']
_ONE = ['div class="comment"', 'li class="comment"', 'article class="comment"', 'div class="reply"', "div", "div", "p", "p", "li", "li"]


class _Drawing:
    def __init__(self, seed: int) -> None:
        self.draw = random.Random(seed)
        self.plain = False  # text without sentences

    def word(self) -> str:
        return "".join(self.draw.choices(_SYLLABLES, k=self.draw.choice([1, 1, 2, 2, 3, 4])))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.draw.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        left, out = self.draw.randint(low, high), []
        while left > 0:
            size = left if self.plain else min(left, self.draw.randint(3, 18))
            end = "" if self.plain else self.draw.choices(".!?", [9, 1, 1])[0]
            out.append(self.words(size, size).capitalize() + end)
            left -= size
        return " ".join(out)

    def maybe(self, chance: float, make, *args) -> str:
        return make(*args) if self.draw.random() < chance else ""

    def boxed(self, opening: str, inside: str, label: int | None = None) -> str:
        mark = "" if label is None else f' data-y="{label}"'
        return f"<{opening}{mark}>{inside}</{opening.split()[0]}>"

    def links(self, low: int, high: int, item: str = "li") -> str:
        out = []
        for _ in range(self.draw.randint(low, high)):
            link = f'<a href="/{self.word()}">{self.words(1, 3)}</a>'
            out.append(f"<{item}>{link}</{item}>" if item else link)
        return "".join(out)

    def menu(self) -> str:
        opening = self.draw.choice(_MENUS)
        inner = self.links(2, 9)
        if opening[:2] not in ("ul", "ol"):
            inner = self.draw.choice([f"<ul>{inner}</ul>", self.links(2, 8, ""), " | ".join([self.links(1, 1, "")] * 4)])
        return self.boxed(opening, inner)

    def site_header(self) -> str:
        inside = self.draw.choice(["<h1>{}</h1>", '<a href="/"><img src="l.png">{}</a>', "<p>{}</p>", "<div>{}</div>"])
        return self.boxed(self.draw.choice(_HEADS), inside.format(self.words(1, 5)) + self.maybe(0.5, self.menu))

    def footer(self) -> str:
        text = self.draw.choice(["&copy; {}", "© 2024 {}", "{}", "<p>{}</p>", "<p>&copy; {}</p>", "<small>{}</small>"])
        inside = text.format(self.draw.choice([self.words(1, 8), f"{self.word()}.com &middot; {self.sentences(3, 25)}"]))
        return self.boxed(self.draw.choice(_FEET), inside + self.maybe(0.5, self.links, 1, 6, self.draw.choice(["", "li"])))

    def side(self) -> str:
        title = self.maybe(0.7, lambda: self.boxed(self.draw.choice(["h2", "h3", "h4"]), self.words(1, 4)))
        body = self.draw.choice(
            [lambda: f"<ul>{self.links(2, 8)}</ul>", lambda: f"<p>{self.sentences(5, 50)}</p>", lambda: self.links(2, 7, "")]
        )()
        return self.boxed(self.draw.choice(_SIDES), title + body, 0)

    def notice(self) -> str:
        text = self.sentences(4, 40)
        inside = self.draw.choice([text, f"<p>{text}</p>", f'{text} <a href="/x">{self.word()}</a>'])
        return self.boxed(self.draw.choice(_NOTICES), inside + self.maybe(0.4, lambda: f"<button>{self.word()}</button>"), 0)

    def advert(self) -> str:
        text = self.draw.choice([self.words(1, 10), self.sentences(4, 45)])
        inside = self.draw.choice([text, f"<p>{text}</p>", f'<a href="//ad">{text}</a>'])
        return "<!-- ad -->" * self.draw.randint(0, 1) + self.boxed(self.draw.choice(_ADS), inside, 0)

    def form(self) -> str:
        return f'<form action="/s" data-y="0"><label>{self.words(1, 6)}</label><input name="q"><button>{self.word()}</button></form>'

    def comments(self) -> str:
        kind, out = self.draw.choice(_ONE), []
        for _ in range(self.draw.randint(1, 6)):
            text = self.draw.choice([self.sentences(3, 70), f"<p>{self.sentences(3, 90)}</p>"])
            name = self.draw.choice(["<b>{}</b> ", '<span class="author">{}</span> ', "<cite>{}</cite>", ""])
            out.append(self.boxed(kind, name.format(self.words(1, 2)) + text))
        title = self.maybe(0.6, lambda: self.boxed(self.draw.choice(["h2", "h3"]), self.words(1, 3)))
        return self.boxed(self.draw.choice(_TALK), title + "".join(out) + self.maybe(0.3, self.form), 0)

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for _ in range(self.draw.randint(0, 3)):
            at = self.draw.randrange(len(words))
            tag = self.draw.choice(["b", "i", "em", "strong", 'a href="/y"', "span", "code"])
            words[at] = f"<{tag}>{words[at]}</{tag.split()[0]}>"
        return " ".join(words)

    def paragraph(self) -> str:
        text = self.inline(self.sentences(1, self.draw.choice([6, 30, 80, 150])))
        return self.draw.choices(
            [f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br><p>{self.sentences(1, 40)}</p>", f"<div>{text}</div>", f"{text}<br><br>"],
            [12, 2, 2, 2, 1],
        )[0]

    def extra(self) -> str:
        items = "".join(f"<li>{self.inline(self.sentences(2, 25))}</li>" for _ in range(self.draw.randint(1, 6)))
        cells = "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(3))
        return self.draw.choice(
            [f"<h2>{self.words(1, 7)}</h2>", f"<h3>{self.words(1, 7)}</h3>", f"<ul>{items}</ul>", f"<ol>{items}</ol>",
             f"<blockquote>{self.sentences(3, 40)}</blockquote>", f"<pre>{self.words(3, 30)}</pre>", f"<table>{cells}</table>",
             f'<figure><img src="a.jpg"><figcaption>{self.sentences(2, 15)}</figcaption></figure>']
        )

    def article(self) -> str:
        opening = self.draw.choice(_AROUND)
        title = f"<h1>{self.words(1, 14)}</h1>"
        byline = self.draw.choice(['<p class="byline" data-y="0">{}</p>', '<div class="meta" data-y="0">{}</div>', '<time data-y="0">{}</time>'])
        head = self.draw.choices([title, f"<header>{title}</header>", "", f"<h2>{self.words(1, 12)}</h2>"], [8, 2, 2, 1])[0]
        head += self.maybe(0.25, lambda: byline.format(self.words(1, 6)))
        body = []
        self.plain = self.draw.random() < 0.15
        for _ in range(self.draw.choice([1, 1, 2, 3, 5, 8, 14, 25, 40])):
            body.append(self.paragraph())
            body.append(self.maybe(0.2, self.extra))
            body.append(self.maybe(0.06, self.advert))
            body.append(self.maybe(0.04, self.side))
            body.append(self.maybe(0.03, self.form))
        self.plain = False
        tail = self.maybe(0.12, self.side) + self.maybe(0.12, self.comments)
        inner = head + "".join(body)
        if self.draw.random() < 0.25:
            inner = self.boxed(self.draw.choice(["div", 'div class="body"', 'div class="text"', "section"]), inner)
        made = self.boxed(opening, inner + tail, 1)
        return f"<table><tr>{made}</tr></table>" if opening.startswith("td") else made

    def page(self) -> str:
        before = [self.maybe(0.75, self.menu), self.maybe(0.5, self.site_header), self.maybe(0.35, self.notice),
                  self.maybe(0.5, self.advert), self.maybe(0.2, self.form)]
        after = [self.maybe(0.35, self.side), self.maybe(0.4, self.comments), self.maybe(0.3, self.advert),
                 self.maybe(0.15, self.notice), self.maybe(0.2, self.form), self.maybe(0.15, self.menu)]
        self.draw.shuffle(before)
        self.draw.shuffle(after)
        between = "".join(before) + self.maybe(0.15, self.side) + self.article() + "".join(after)
        if self.draw.random() < 0.4:
            box = self.draw.choice(["div", 'div class="wrapper"', 'div id="page"', 'div class="container"', "main"])
            between = self.boxed(box, between, 0)
        end = "</body></html>" if self.draw.random() < 0.7 else ""
        return (
            f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{self.words(2, 8)}</title>'
            f'<style>p{{margin:0}}</style><script>var t="</p>";</script></head><body data-y="0">{between}'
            + self.maybe(0.85, self.footer) + end
        )


def labelled_pages(count: int = 300, seed: int = 11) -> list[str]:
    """``count`` labelled pages, the same for a seed."""
    return [_Drawing(seed * 100_003 + i).page() for i in range(count)]
