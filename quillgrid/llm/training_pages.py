"""Generated web pages with known main text, to train the extraction model on.

Each page has an article, in one of many markups, and a random choice of menus, headers, footers, sidebars,
notices, adverts, forms and reader comments around, before, after or inside it. Elements that begin an area
carry ``itemprop="mark:1"`` (main text) or ``mark:0``, which the trainer reads and the features don't.
"""

from __future__ import annotations

import random

SYLLABLES = "an be chi de en fi ga he il jo ka le mo nu or pa que ri so tu un ve wa xi ye zo str pl ght ing tion ness é ü ñ".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        text = " ".join(self.word() for _ in range(self.r.randint(low, high)))
        return text[:1].upper() + text[1:]

    def sentence(self) -> str:
        text = self.words(3, 18)
        if self.r.random() < 0.3:
            text = text.replace(" ", ", ", 1)
        return text + self.r.choice(". . . ! ?".split())

    def prose(self, low: int = 1, high: int = 6) -> str:
        style = self.r.random()
        parts = [self.sentence() for _ in range(self.r.randint(low, high))]
        if style < 0.1:  # junk-like text is still the article's
            parts = [w + self.r.choice(["&amp;&amp;", "%%%", "###", "***", " | "]) for p in parts for w in p.split()]
        return " ".join(parts)

    def name(self, options: str) -> str:
        """An attribute with a telling token, a meaningless one, or none."""
        x = self.r.random()
        if x < 0.72:
            token = self.r.choice(options.split())
            token = self.r.choice([token, f"{token}-{self.word()}", f"{self.word()} {token}", f"{token}_{self.r.randint(1, 9)}", f"site-{token}"])
            return f' {self.r.choice(["class", "class", "id"])}="{token}"'
        return f' class="{self.word()}{self.r.randint(1, 99)}"' if x < 0.86 else ""

    def area(self, main: bool, tags: str, options: str, inside: str, bare: bool = False) -> str:
        tag = self.r.choice(tags.split())
        return f'<{tag} itemprop="mark:{int(main)}"{"" if bare else self.name(options)}>{inside}' + ("" if tag in ("p", "li") and self.r.random() < 0.3 else f"</{tag}>")

    def links(self, low: int, high: int, long: bool = False) -> str:
        one = lambda: f'<a href="/{self.word()}">{self.words(1, 9 if long else 2)}</a>'
        n = self.r.randint(low, high)
        form = self.r.random()
        if form < 0.7:
            return "<ul>" + "".join(f"<li>{one()}" + ("</li>" if self.r.random() < 0.8 else "") for _ in range(n)) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(one() for _ in range(n))

    def paragraph(self) -> str:
        r, text = self.r, self.prose()
        x = r.random()
        if x < 0.06:
            text = f"<b>{text}<br>"  # left open, as in the wild
            return f"<p>{text}"
        if x < 0.2:
            text = f'{self.prose(1, 2)} <a href="/{self.word()}">{self.words(1, 4)}</a> {text}'
        elif x < 0.3:
            text = f"{text} <em>{self.words(1, 3)}</em> {self.prose(1, 2)}"
        if r.random() < 0.12:
            text = self.words(1, 3) + "."
        return f"<p>{text}" + ("" if r.random() < 0.15 else "</p>")

    def extra(self) -> str:
        x = self.r.random()
        if x < 0.3:
            return f"<h2>{self.words(2, 8)}</h2>"
        if x < 0.5:
            return "<ul>" + "".join(f"<li>{self.prose(1, 2)}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>"
        if x < 0.65:
            return f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>"
        if x < 0.75:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 5))) + "</table>"
        if x < 0.85:
            return f"<pre>{self.words(5, 20)}</pre>"
        return f"<figure><img src=x><figcaption>{self.words(3, 12)}</figcaption></figure>"

    def article(self) -> str:
        r = self.r
        n = r.choice([1, 1, 2, 3, 4, 5, 8, 12, 20])
        body = [self.paragraph() for _ in range(n)]
        if r.random() < 0.45:
            for _ in range(r.randint(1, 3)):
                body.insert(r.randint(0, len(body)), self.extra())
        title = f"<h1>{self.words(2, 9)}</h1>" if r.random() < 0.8 else ""
        if title and r.random() < 0.15:
            title = f"<header>{title}</header>"
        if r.random() < 0.15:
            body = [f"<div>{self.prose(1, 4)}</div>" for _ in range(n)]
        if r.random() < 0.3:  # an intruder, closed off by the elements around it
            body.insert(r.randint(1, len(body)), self.intruder())
        inner = title + "".join(body)
        form = r.random()
        if form < 0.45:
            return self.area(True, "article", "post article entry story", inner, r.random() < 0.6)
        if form < 0.6:
            return f'<main{self.name("main content page")}>{self.area(True, "article div section", "article content post entry text", inner)}</main>'
        if form < 0.85:
            return self.area(True, "div section main td", "content article post entry story main body text", inner)
        return f'<div{self.name("wrapper page main container")}>{title and self.area(True, "div", "title headline", title, True)}{self.area(True, "div", "content body text entry", "".join(body))}</div>'

    def intruder(self) -> str:
        return self.r.choice([self.advert, self.newsletter, self.form, self.related, self.share, self.notice])()

    def advert(self) -> str:
        return self.area(False, "div div aside section p", "ad ads advert banner sponsor promo sponsored", self.r.choice([self.prose(1, 2), self.words(2, 12), f'<p>{self.prose(1, 2)}</p>', f'<a href="/x">{self.words(2, 8)}</a>']))

    def newsletter(self) -> str:
        return self.area(False, "form div section", "newsletter subscribe signup form search login contact", f"<p>{self.prose(1, 2)}</p><label>{self.words(1, 3)}</label><input name=q>{self.words(1, 2)}")

    def form(self) -> str:
        return self.area(False, "form", "search login contact form", f"{self.words(1, 6)}<label>{self.words(1, 3)}</label><input name=q><p>{self.words(1, 8)}</p>", self.r.random() < 0.5)

    def related(self) -> str:
        return self.area(False, "div aside section ul", "related sidebar more recommended popular widget", f"<h3>{self.words(1, 3)}</h3>{self.links(2, 7, True)}")

    def share(self) -> str:
        return self.area(False, "div", "share social sharing follow tags", self.links(2, 5))

    def menu(self) -> str:
        return self.area(False, "nav nav div ul", "nav menu navbar navigation breadcrumb", self.links(3, 10), self.r.random() < 0.4)

    def top(self) -> str:
        return self.area(False, "header header div", "header masthead top banner site", self.r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<a href=/>{self.words(1, 3)}</a>", f"<p>{self.words(2, 8)}</p>", ""]) + self.r.choice([self.links(2, 7), f"<p>{self.sentence()}</p>"]), self.r.random() < 0.4)

    def bottom(self) -> str:
        return self.area(False, "footer footer div", "footer foot bottom copyright legal", self.r.choice([f"&copy; {self.words(1, 4)} {self.prose(1, 3)}", f"<p>&copy; {self.prose(1, 3)}</p>", self.links(2, 8), f"<p>{self.prose(1, 2)}</p>{self.links(2, 6)}"]), self.r.random() < 0.5)

    def side(self) -> str:
        inner = "".join(self.r.choice([lambda: f"<h3>{self.words(1, 3)}</h3>", lambda: self.links(2, 8, True), lambda: f"<p>{self.prose(1, 3)}</p>", lambda: f"<div>{self.words(2, 12)}</div>"])() for _ in range(self.r.randint(1, 4)))
        return self.area(False, "aside aside div section", "sidebar side aside rail widget related", inner, self.r.random() < 0.3)

    def notice(self) -> str:
        return self.area(False, "div div section p aside dialog", "cookie consent notice alert popup modal gdpr", self.r.choice([f"<p>{self.prose(1, 3)}</p>", self.prose(1, 2)]) + self.r.choice(["", f"<button>{self.words(1, 2)}</button>", f"<a href=#>{self.words(1, 2)}</a>"]))

    def comments(self) -> str:
        r = self.r
        one = r.choice([lambda: f'<div class="comment"><p>{self.prose(1, 4)}</p></div>', lambda: f"<li>{self.words(1, 2)}: {self.prose(1, 3)}</li>", lambda: f"<p><b>{self.words(1, 2)}</b> {self.prose(1, 3)}</p>", lambda: f'<article class="comment"><h4>{self.words(1, 2)}</h4><p>{self.prose(1, 4)}</p></article>'])
        inner = r.choice(["", f"<h2>{self.words(1, 2)}</h2>", f"<h3>{self.words(1, 3)}</h3>"]) + "".join(one() for _ in range(r.randint(1, 6)))
        bare = self.name("comments comment replies discussion responses reader-comments disqus")
        tag = r.choice("section div div ol ul".split())
        return f'<{tag} itemprop="mark:0"{bare or " class=comments"}>{inner}</{tag}>'

    def page(self) -> str:
        r = self.r
        before = [self.menu] * (r.random() < 0.8) + [self.top] * (r.random() < 0.5) + [self.advert] * (r.random() < 0.6) + [self.notice] * (r.random() < 0.4) + [self.form] * (r.random() < 0.2)
        after = [self.side] * (r.random() < 0.45) + [self.comments] * (r.random() < 0.45) + [self.related] * (r.random() < 0.3) + [self.newsletter] * (r.random() < 0.25) + [self.share] * (r.random() < 0.2) + [self.advert] * (r.random() < 0.2) + [self.notice] * (r.random() < 0.1) + [self.form] * (r.random() < 0.15)
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.3:
            before.append(self.side)
        middle = "".join(f() for f in before) + self.article() + "".join(f() for f in after)
        if r.random() < 0.35:
            middle = f'<div{self.name("wrapper page container site wrap")}>{middle}</div>'
        tail = (self.bottom() if r.random() < 0.9 else "") + (self.notice() if r.random() < 0.1 else "")
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html>{head}<body>{middle}{tail}" + ("</body></html>" if r.random() < 0.7 else "")


def make_pages(n: int, seed: int = 7) -> list[str]:
    return [Maker(seed * 1_000_003 + k).page() for k in range(n)]
