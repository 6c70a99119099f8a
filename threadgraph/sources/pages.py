"""Articles and comments of HTML pages (S5-S11): a small document tree, selectors, and what to take from each platform.

Nothing is fetched; pages come as a table. They are parsed in Arrow batches, a page at a time. What a page doesn't have is null,
and ``problem`` says what an article lacks that every article of its platform has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import platform, tagesschau_header, zeit_time

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}}  # an element that a new one of its kind ends


@dataclass(eq=False)
class Element:
    tag: str
    attrs: dict[str, str]
    above: Element | None = None
    parts: list = field(default_factory=list)  # elements and texts, in order

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            part = stack.pop()
            if isinstance(part, str):
                out.append(part)
            elif part.tag not in ("script", "style") or part is self:
                stack += reversed(part.parts)
        return "".join(out)

    def within(self) -> list[Element]:
        """All elements below, in the order of the document."""
        out, stack = [], [p for p in reversed(self.parts) if isinstance(p, Element)]
        while stack:
            part = stack.pop()
            out.append(part)
            stack += [p for p in reversed(part.parts) if isinstance(p, Element)]
        return out

    def all(self, selector: str) -> list[Element]:
        return [e for e in self.within() if any(_matches(e, steps, self) for steps in _parsed(selector))]

    def first(self, selector: str) -> Element | None:
        return next(iter(self.all(selector)), None)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {})

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            self._end(CLOSES[tag], stop={"ul", "ol", "div", "article", "section"})
        made = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(made)
        if tag not in VOID:
            self.at = made

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._end({tag}, stop=set())

    def _end(self, tags: set[str], stop: set[str]):
        found = self.at
        while found is not self.root and found.tag not in tags and found.tag not in stop:
            found = found.above
        if found is not self.root and found.tag in tags:
            self.at = found.above

    def handle_data(self, data):
        self.at.parts.append(data)


def document(html: str | None) -> Element:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.root


@lru_cache(maxsize=512)
def _parsed(selector: str) -> list[list[tuple[bool, str, tuple]]]:
    """Alternatives; each a list of steps from the last one back: (whether it has to be the parent, tag, tests of attributes)."""
    out = []
    for alternative in selector.split(","):
        steps, child = [], False
        for token in re.findall(r">|[^\s>\[]*(?:\[[^\]]*\][^\s>\[]*)*", alternative):
            if token == ">":
                child = True
            elif token:
                tag = re.match(r"[\w-]*", token)[0]
                tests = [("class", "~", c) for c in re.findall(r"\.([\w-]+)", re.sub(r"\[[^\]]*\]", "", token))]
                tests += [("id", "=", c) for c in re.findall(r"#([\w-]+)", re.sub(r"\[[^\]]*\]", "", token))]
                tests += [(name, "=" if value else "", value.strip("\"'")) for name, value in re.findall(r"\[([\w-]+)=?([^\]]*)\]", token)]
                steps.append((child, "^" if token == ":scope" else tag, tuple(tests)))
                child = False
        out.append(steps[::-1])
    return out


def _is(e: Element, step: tuple, scope: Element) -> bool:
    _, tag, tests = step
    if tag == "^":
        return e is scope
    if tag and e.tag != tag:
        return False
    for name, how, value in tests:
        own = e.attrs.get(name)
        if own is None or (how == "=" and own != value) or (how == "~" and value not in own.split()):
            return False
    return True


def _matches(e: Element | None, steps: list, scope: Element) -> bool:
    if e is None or not _is(e, steps[0], scope):
        return False
    if len(steps) == 1:
        return True
    above, direct = e.above, steps[0][0]
    while above is not None:
        if _matches(above, steps[1:], scope):
            return True
        if direct:
            return False
        above = above.above
    return False


# --- articles -----------------------------------------------------------------------------------------------------------

#: Where each platform keeps an article's parts. For each field, places that are tried in turn; a place is a
#: selector, the attribute to take (empty: the text), and what joins the finds (None: the first one counts).
ARTICLE_PLACES = {
    "SueddeutscheScraper": {
        "title": [("header.sz-article__header h2 span", "", " "), ("article > header > h2", "", None)],
        "summary": [("div.sz-article-intro p", "", "\n\n"), ("div.sz-article__intro p", "", "\n\n")],
        "author": [("a.sz-article-byline__author-link", "", None)],
        "text": [("div.sz-article__body.sz-article-body p", "", " ")],
        "published": [("time.sz-article-header__time", "datetime", None), (".sz-article__header time", "datetime", None)],
    },
    "ZONScraper": {
        "title": [("article header h1", "", None)],
        "summary": [("article header div.summary", "", None)],
        "author": [('article header div.byline [itemprop="name"]', "", ", "), ('a[rel="author"] span[itemprop="name"]', "", None), ("span.metadata__source", "", None)],
        "text": [("article section h2, article section p", "", "\n\n"), ("article p.paragraph", "", "\n\n")],
        "published": [("article header time", "datetime", None)],
    },
    "WeltScraper": {
        "title": [(".c-headline", "", None)],
        "summary": [(".c-summary__intro", "", None)],
        "author": [(".c-author__by-line a", "", None), (".c-author__by-line", "", None)],
        "text": [(".c-article-text p", "", "\n\n")],
        "published": [(".c-publish-date", "datetime", None)],
    },
    "TagesschauScraper": {
        "title": [("div.meldungHead h1 span.headline", "", None)],
        "subtitle": [("div.meldungHead h1 span.dachzeile", "", None)],
        "summary": [("div.sectionZ div.modParagraph>p, div.sectionZ div.modParagraph>h2", "", None)],
        "author": [("div.sectionZ div.modParagraph p.autorenzeile", "", None)],
        "text": [("div.sectionZ div.modParagraph>p, div.sectionZ div.modParagraph>h2", "", "\n\n")],
        "published": [("div.meldungHead span.stand", "", None)],
    },
    "FAZScraper": {
        "title": [("span.atc-HeadlineEmphasisText, span.atc-HeadlineText", "", " - ")],
        "summary": [("p.atc-IntroText", "", None)],
        "author": [("span.atc-MetaAuthor", "", None)],
        "text": [("div.atc-Text p", "", "\n\n")],
        "published": [("time.atc-MetaTime", "title", None)],
    },
    "SPONScraper": {
        "title": [("main > article > header h2>span", "", " - ")],
        "summary": [("main > article > header div.leading-loose", "", None)],
        "author": [("main > article > header div > a", "title", ", "), ('meta[name="author"]', "content", None)],
        "text": [("main>article section p", "", "\n\n")],
        "published": [("time.timeformat", "datetime", None)],
    },
    "TAZScraper": {
        "title": [('article h1[itemprop="headline"]', "", None)],
        "summary": [('article p[itemprop="description"]', "", None)],
        "author": [('div[itemprop="author"] h4[itemprop="name"]', "", None)],
        "text": [("article p.article", "", "\n\n")],
        "published": [('li[itemprop="datePublished"]', "content", None)],
    },
}
#: Times of publication.
TIME_FORMATS = {
    "SueddeutscheScraper": "yyyy-MM-dd HH:mm:ss",
    "ZONScraper": "yyyy-MM-dd'T'HH:mm:ssXXX",
    "WeltScraper": "yyyy-MM-dd'T'HH:mm:ssXXX",
    "TagesschauScraper": "'Stand: 'dd.MM.yyyy HH:mm 'Uhr'",
    "FAZScraper": "dd.MM.yyyy HH:mm 'Uhr'",
    "SPONScraper": "yyyy-MM-dd HH:mm:ss",
    "TAZScraper": "yyyy-MM-dd'T'HH:mm:ssXXX",
}
NEEDED = ("title", "published")
FIELDS = ("title", "subtitle", "summary", "author", "text", "published")


def _taken(page: Element, places: list) -> str | None:
    for selector, attribute, glue in places:
        found = [(e.attrs.get(attribute, "") if attribute else e.text()).strip() for e in page.all(selector)]
        if found and (glue is not None or found[0]):
            return glue.join(found) if glue is not None else found[0]
    return None


def article_of(scraper: str, page: Element) -> dict[str, str | None]:
    own = {name: _taken(page, places) for name, places in ARTICLE_PLACES[scraper].items()}
    if scraper == "SueddeutscheScraper" and own["text"]:
        own["text"] = re.sub(r"\s+", " ", own["text"])
    elif scraper == "ZONScraper" and own["author"]:
        own["author"] = own["author"].replace("Quelle: ", "").strip()
    elif scraper == "SPONScraper":
        if own["author"]:
            own["author"] = own["author"].replace(", DER SPIEGEL", "")
        # The topic stands above the headline and is named last.
        parts = [e.text().strip() for e in page.all(ARTICLE_PLACES[scraper]["title"][0][0])]
        own["title"] = " - ".join(reversed(parts)) or None
    elif scraper == "TagesschauScraper":
        blocks = [e.text().strip() for e in page.all(ARTICLE_PLACES[scraper]["text"][0][0])]
        own["text"] = "\n\n".join(blocks[2:])  # after the summary and the author's line
        if own["author"]:
            own["author"] = own["author"].replace("Von ", "").split(",")[0]
    return own


def _in_batches(pages: DataFrame, schema: str, rows_of) -> DataFrame:
    """``rows_of`` (url, page, scraper, document) of each page of url, page, scraper, html, as rows of the schema."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
        of = dict(zip(names, (kinds[f.split(" ", 1)[1]] for f in schema.split(", ")), strict=True))
        for batch in batches:
            rows = []
            for url, page, scraper, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += rows_of(url, page, scraper, document(html))
            yield pa.RecordBatch.from_pydict({n: pa.array([r.get(n) for r in rows], k) for n, k in of.items()})

    return pages.mapInArrow(run, schema)


def articles(pages: DataFrame) -> DataFrame:
    """url, title, subtitle, summary, author, text, published_time, scraper, problem of pages (url, html) of known platforms."""

    def rows_of(url, _, scraper, page):
        own = article_of(scraper, page)
        missing = [n for n in NEEDED if not own.get(n)]
        return [{"url": url, "scraper": scraper, "problem": "no " + ", ".join(missing) if missing else None, **own}]

    known = pages.select("url", F.lit(0).cast("long").alias("page"), platform(F.col("url")).alias("scraper"), "html").where("scraper is not null")
    schema = "url string, scraper string, problem string, " + ", ".join(f"{f} string" for f in FIELDS)
    found = _in_batches(known, schema, rows_of)
    time = reduce(lambda other, p: F.when(F.col("scraper") == p[0], F.try_to_timestamp("published", F.lit(p[1]))).otherwise(other), TIME_FORMATS.items(), F.lit(None).cast("timestamp"))
    return found.select("url", *FIELDS[:-1], time.alias("published_time"), "scraper", "problem")


# --- comments -----------------------------------------------------------------------------------------------------------

COMMENT = "url string, comment_id string, username string, user_id string, at string, text string, reply_to string, recommended long, leseempfehlungen long, title string, ordinal array<long>"


def _said(e: Element | None) -> str | None:
    return None if e is None else e.text().strip()


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"\s*-?\d+\s*", text) else None


def _got(e: Element | None, name: str) -> str | None:
    return None if e is None else e.attrs.get(name)


def faz_rows(page: Element):
    """Comments and, below each, its answers."""
    for item in page.all("li.lst-Comments_Item-level1"):
        own = _faz(item.first("div.lst-Comments_CommentTextContainer"), None)
        yield own
        for answer in item.all("li.lst-Comments_Item-level2"):
            yield _faz(answer.first("div.lst-Comments_CommentTextContainer"), own.get("comment_id"))


def _faz(e: Element | None, parent: str | None) -> dict:
    if e is None:
        return {}
    author = e.first("a[data-author-name]")
    return {
        "comment_id": _got(e.first("ul[data-content-id]"), "data-content-id"),
        "username": _got(author, "data-author-name"),
        "user_id": _got(author, "data-author-login"),
        "at": _said(e.first("span.lst-Comments_CommentInfoDateText")),
        "text": " ".join(t.text() for t in e.all("p.lst-Comments_CommentTitle, p.lst-Comments_CommentText")),
        "reply_to": parent,
        "recommended": _number(_got(e.first("ul[data-empfehlen-value]"), "data-empfehlen-value")),
    }


def taz_rows(page: Element):
    """Threads from the last one back, each comment before its answers."""
    stack: list[tuple[str | None, Element]] = [(None, e) for e in page.all("div.sect_commentlinks > ul > li")]
    while stack:
        parent, e = stack.pop()
        yield {
            "comment_id": e.attrs.get("id"),
            "username": _said(e.first("a.author h4")),
            "user_id": _got(e.first("a.author"), "href"),
            "at": _got(e.first("time[datetime]"), "datetime"),
            "text": _said(e.first("div")),
            "reply_to": parent,
        }
        stack += [(e.attrs.get("id"), answer) for answer in e.all(":scope > ul.thread > li")]


def zeit_rows(page: Element):
    """Comments of the page itself, or of an answer list that was loaded later, which has no frame around it."""
    framed = page.first("#comments") is not None
    for e in page.all("#comments article" if framed else "article"):
        name = e.first(".comment-meta__name")
        link = e.first(".comment-meta__name a")
        origin = _got(e.first("div.comment__reactions a.comment__origin"), "href")
        yield {
            "comment_id": e.attrs.get("id"),
            "username": link.text() if link is not None else name.text() if name is not None else "",
            "user_id": _got(link, "href"),
            "at": (_said(e.first(".comment-meta__date")) or "").split("—")[-1].strip(),
            "text": "\n\n".join(p.text().strip() for p in e.all("div.comment__body p")),
            "reply_to": origin.split("#")[-1] if origin else None,
            "leseempfehlungen": _number(_said(e.first(".js-comment-recommendations"))),
        }


def tagesschau_rows(page: Element):
    for e in page.all("div#comments div.comment"):
        yield {
            "comment_id": _got(e.first("div.commentheader h3.title a"), "id"),
            "at": _said(e.first("div.commentheader div.submitted")),
            "text": _said(e.first("div.content")),
            "title": _said(e.first("div.commentheader h3.title")),
        }


ROWS_OF = {"FAZScraper": faz_rows, "TAZScraper": taz_rows, "ZONScraper": zeit_rows, "TagesschauScraper": tagesschau_rows}


def comments(pages: DataFrame, now: Column | None = None) -> DataFrame:
    """Comments of pages (url, page, html), in the order in which they are met: page, then place on it (``ordinal``).

    Columns as those of the JSON platforms. ``now`` is the time that "two hours ago" counts from; the current one by default.
    What has no id is no comment.
    """
    known = pages.select("url", F.col("page").cast("long").alias("page"), platform(F.col("url")).alias("scraper"), "html").where(F.col("scraper").isin(*ROWS_OF))

    def rows_of(url, page, scraper, tree):
        rows = ROWS_OF[scraper](tree)
        return [{"url": url, "ordinal": [page, k], **r} for k, r in enumerate(rows) if r.get("comment_id")]

    found = _in_batches(known, COMMENT, rows_of)
    scraper, at = platform(F.col("url")), F.col("at")
    header = tagesschau_header(at)
    time = (
        F.when(scraper == "FAZScraper", F.try_to_timestamp(at, F.lit("dd.MM.yyyy - HH:mm")))
        .when(scraper == "TAZScraper", F.try_to_timestamp(at, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
        .when(scraper == "ZONScraper", zeit_time(at, now if now is not None else F.current_timestamp()))
        .otherwise(header["timestamp"])
    )
    name = F.when(scraper == "TagesschauScraper", header["username"]).otherwise(F.col("username"))
    return found.withColumns({"timestamp": time, "username": name}).select("url", "comment_id", "username", "user_id", "timestamp", "text", "reply_to", "recommended", "leseempfehlungen", "title", "ordinal")


def more_pages(pages: DataFrame) -> DataFrame:
    """url, more: addresses of further comment pages and answer lists that pages (url, page, html) name and that aren't among them."""

    def rows_of(url, _, scraper, tree):
        if scraper == "ZONScraper":
            links = [_got(e, "data-url") for e in tree.all("#comments div.comment-section__body > div.comment__container a")]
            links += [_got(e, "href") for e in tree.all("ul.pager__pages li a")]
        elif scraper == "FAZScraper":
            following = _got(tree.first("[data-next-page-count]"), "data-next-page-count")
            links = [f"{url}#page={following}"] if _number(following) else []
        elif scraper == "TagesschauScraper":
            links = [_got(tree.first("div.modConComments h3.headline a"), "href")]
        elif scraper == "SueddeutscheScraper":
            links = [h for e in tree.all("div.sz-article-body__asset a.sz-teaser--article") if "leserdiskussion" in (h := e.attrs.get("href", ""))][:1]
        else:
            links = []
        return [{"url": url, "more": link} for link in links if link]

    known = pages.select("url", F.col("page").cast("long").alias("page"), platform(F.col("url")).alias("scraper"), "html").where("scraper is not null")
    return _in_batches(known, "url string, more string", rows_of).distinct()
