"""Platform payloads to articles and comments (S1-S12); nothing is fetched, payloads come as tables.

JSON payloads are parsed by schema, or, where replies nest without bound, in Arrow batches; what doesn't parse is null and reported
by status. HTML of any page goes through the standard library's parser here; ``pages`` has what platforms' own pages hold.
"""

from __future__ import annotations

from functools import reduce
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import GraphError
from ..storage import materialise
from .comments import conform

#: Platforms in the order in which they are tried, with the pattern a url must begin with.
PLATFORMS = {
    "SueddeutscheScraper": r"(https?://)?(www\.)?sueddeutsche\.de/.*",
    "ZONScraper": r"(https?://)?(www\.)?zeit\.de/.*",
    "WeltScraper": r"https?://(www\.)?welt\.de/.*",
    "TagesschauScraper": r"(https?://)?(www\.)?tagesschau\.de/.*",
    "FAZScraper": r"(https?://)?(www\.)?(m\.)?faz\.net/.*",
    "SPONScraper": r"(https?://)?(www\.)?spiegel\.de/.*",
    "TAZScraper": r"(https?://)?(www\.)?taz\.de/.*",
}
MONTHS = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")  # fixed values


def platform(url: Column) -> Column:
    """The first platform that deals with the url, or null."""
    return reduce(lambda other, p: F.when(url.rlike(f"^(?:{p[1]})"), p[0]).otherwise(other), reversed(list(PLATFORMS.items())), F.lit(None).cast("string"))


def prepared_url(url: Column) -> Column:
    """The url under which an article is kept; null without a platform."""
    whole = F.substring_index(url, "#", 1)
    found = platform(url)
    return F.when(found == "WeltScraper", whole).when(found == "FAZScraper", F.replace(whole, F.lit("https://m."), F.lit("https://"))).when(found.isNotNull(), url)


def backfill_urls(lines: DataFrame, column: str = "value") -> DataFrame:
    """Urls of the ``- url`` lines of list files."""
    text = F.col(column)
    return lines.where(text.startswith("-")).select(F.trim(F.substring(text, F.lit(2), F.length(text))).alias("url"))


def statused(articles: DataFrame, comments: DataFrame) -> DataFrame:
    """url, status of each article that was asked for: OK, NO_SCRAPER, NO_COMMENTS or SCRAPER_ERROR."""
    counts = comments.groupBy("url").agg(F.count(F.lit(1)).alias("_n"))
    joined = articles.join(counts, "url", "left")
    status = F.when(platform(F.col("url")).isNull(), "NO_SCRAPER").when(F.col("payload").isNull(), "SCRAPER_ERROR").when(F.coalesce("_n", F.lit(0)) == 0, "NO_COMMENTS").otherwise("OK")
    return joined.select("url", status.alias("status"))


def in_order(comments: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """``place`` within the article: by time, and by the order of arrival where times are equal."""
    return comments.withColumn("place", F.row_number().over(Window.partitionBy("url").orderBy("timestamp", ordinal)))


# --- JSON platforms -----------------------------------------------------------------------------------------------------

DISQUS = "struct<cursor:struct<hasNext:boolean,next:string>,response:array<struct<id:string,author:struct<username:string>,createdAt:string,raw_message:string,parent:string>>>"


def disqus(pages: DataFrame) -> DataFrame:
    """Comments of pages (url, page, payload) of a Disqus thread; white space is collapsed."""
    parsed = pages.withColumn("_p", F.from_json("payload", DISQUS)).select("url", "page", F.posexplode("_p.response").alias("at", "c"))
    return parsed.select(
        "url",
        F.col("c.id").alias("comment_id"),
        F.col("c.author.username").alias("username"),
        F.try_to_timestamp("c.createdAt").alias("timestamp"),
        F.regexp_replace("c.raw_message", r"\s+", " ").alias("text"),
        F.col("c.parent").alias("reply_to"),
        F.struct("page", "at").alias("ordinal"),
    )


WELT = "struct<comments:array<struct<id:string,user:struct<displayName:string,id:string>,created:string,contents:string,parentId:string,likes:bigint,recommended:bigint,childCount:bigint>>>"


def welt(pages: DataFrame) -> DataFrame:
    """Comments of pages (url, page, payload); one that comes again replaces the earlier one, in its place."""
    parsed = pages.withColumn("_p", F.from_json("payload", WELT)).select("url", "page", F.posexplode("_p.comments").alias("at", "c"))
    rows = parsed.select(
        "url",
        F.col("c.id").alias("comment_id"),
        F.col("c.user.displayName").alias("username"),
        F.col("c.user.id").alias("user_id"),
        F.coalesce(F.try_to_timestamp("c.created", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.try_to_timestamp("c.created", F.lit("yyyy-MM-dd'T'HH:mm:ss"))).alias("timestamp"),
        F.col("c.contents").alias("text"),
        F.col("c.parentId").alias("reply_to"),
        F.col("c.likes").alias("likes"),
        F.col("c.recommended").alias("recommended"),
        F.col("c.childCount").alias("num_replies"),
        F.struct("page", "at").alias("ordinal"),
    )
    own = [c for c in rows.columns if c not in ("url", "comment_id", "ordinal")]
    last = F.max_by(F.struct(*own), "ordinal").alias("_c")
    return rows.groupBy("url", "comment_id").agg(last, F.min("ordinal").alias("ordinal")).select("url", "comment_id", "_c.*", "ordinal")


#: Which counts of a reply's actions are kept, and as what.
ACTIONS = {"UpvoteActionSummary": "upvotes", "DownvoteActionSummary": "downvotes", "LoveActionSummary": "love"}
SPIEGEL = "url string, comment_id string, username string, user_id string, created string, text string, reply_to string, upvotes long, downvotes long, love long, ordinal array<long>"


def _responses(pages: DataFrame, schema: str, rows_of) -> DataFrame:
    """``rows_of`` (url, page, parent, response) of each payload of nested replies; what doesn't parse has none."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        import json

        import pyarrow as pa

        kinds = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
        for batch in batches:
            rows = []
            for url, page, parent, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    response = json.loads(payload or "null")
                except (ValueError, RecursionError):
                    continue
                if isinstance(response, dict):
                    rows += rows_of(url, page, parent, response)
            yield pa.RecordBatch.from_pydict({n: pa.array([r.get(n) for r in rows], kinds[f.split(" ", 1)[1]]) for n, f in zip(names, schema.split(", "), strict=True)})

    parent = F.col("parent") if "parent" in pages.columns else F.lit(None)
    return pages.select("url", F.col("page").cast("long").alias("page"), parent.cast("string").alias("parent"), "payload").mapInArrow(run, schema)


def _walk(response: dict, parent: str | None, path: list[int]):
    """(node, parent, path) of all replies below a response, however deep, each before its own replies; (None, parent, cursor) where
    a response goes on elsewhere."""
    stack = [(response, parent, path)]
    while stack:
        given, above, where = stack.pop()
        if where is None:  # a node that was put off
            yield given
            continue
        later = []
        for k, node in enumerate(given.get("nodes") or []):
            if not isinstance(node, dict):  # a gap in the list
                continue
            later.append(((node, above, [*where, k]), None, None))
            if isinstance(node.get("replies"), dict):
                later.append((node["replies"], node.get("id"), [*where, k]))
        if given.get("hasNextPage"):
            later.append(((None, above, given.get("endCursor")), None, None))
        stack += reversed(later)


def spiegel(pages: DataFrame) -> DataFrame:
    """Comments of pages (url, page, payload, and parent where a page goes on with the replies to a comment) of nested replies.

    A node without user or body is no comment, but its replies are, and answer it. Missing counts are 0.
    """

    def rows_of(url, page, parent, response):
        for node, above, path in _walk(response, parent, [page]):
            if node is None or node.get("user") is None or node.get("body") is None:
                continue
            counts = {a.get("__typename"): a.get("count") for a in node.get("action_summaries") or []}
            yield {
                "url": url,
                "comment_id": node.get("id"),
                "username": node["user"].get("username"),
                "user_id": node["user"].get("id"),
                "created": node.get("created_at"),
                "text": node["body"],
                "reply_to": above,
                "ordinal": path,
                **{name: counts.get(action) or 0 for action, name in ACTIONS.items()},
            }

    found = _responses(pages, SPIEGEL, rows_of)
    return found.select(*[F.try_to_timestamp("created").alias("timestamp") if c == "created" else c for c in found.columns])


def spiegel_more(pages: DataFrame) -> DataFrame:
    """url, parent, cursor of every list of replies in the pages that goes on elsewhere; of the pages' own lists, ``parent`` is null."""

    def rows_of(url, page, parent, response):
        return [{"url": url, "parent": above, "cursor": cursor} for node, above, cursor in _walk(response, parent, [page]) if node is None]

    return _responses(pages, "url string, parent string, cursor string", rows_of)


def payload_problems(pages: DataFrame) -> DataFrame:
    """url, page, problem of each payload that ``spiegel`` can't read: none at all, no JSON, JSON that is nested too deeply, or no object."""

    def run(batches):
        import json

        import pyarrow as pa

        for batch in batches:
            rows = []
            for url, page, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    problem = None if isinstance(json.loads(payload or "null"), dict) else "no object" if payload else "no payload"
                except ValueError:
                    problem = "no JSON"
                except RecursionError:
                    problem = "nested too deeply"
                if problem:
                    rows.append((url, page, problem))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], ["url", "page", "problem"])

    return pages.select("url", F.col("page").cast("long").alias("page"), "payload").mapInArrow(run, "url string, page long, problem string")


def crawled(payloads: DataFrame, first, more, key: list[str]) -> DataFrame:
    """The payloads that are reached from those where ``first`` holds, by what ``more`` of payloads (columns ``key``) names as next.

    A fixpoint: in each round only new payloads are read, and what they name is looked up among those not seen yet, until there are
    none; cycles and several ways to a payload are no matter. A payload that several rows hold comes with all of them; what is named
    but not there is left out. Each round is written to the shared folder, so there are as many rounds as the longest way has steps.
    """
    token = F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in key]), {"ignoreNullFields": "false"})
    known = materialise(payloads.withColumn("_key", token), "crawl-payloads")
    new = materialise(known.where(first), "crawl-round")
    reached, seen = new, new.select("_key")
    while not new.isEmpty():
        named = more(new.drop("_key")).select(token.alias("_key")).distinct().join(seen, "_key", "left_anti")
        new = materialise(known.join(named, "_key", "left_semi").select(*known.columns), "crawl-round")
        reached, seen = reached.union(new), seen.union(new.select("_key"))
    return reached.drop("_key")


# --- HTML platforms -----------------------------------------------------------------------------------------------------


class Elements(HTMLParser):
    """Title, headings, paragraphs, links and list depth of a page, as the parser meets them; tolerant of missing end tags."""

    BLOCKS = ("title", "h1", "h2", "p", "li")
    SILENT = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, int]] = []
        self.links: list[str] = []
        self._open: list[tuple[str, list[str]]] = []
        self._silent, self._depth = 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self._silent += 1
        if tag == "ul":
            self._depth += 1
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)
        if tag in self.BLOCKS:
            if tag == "p":  # a paragraph ends the one before
                self._close("p")
            self._open.append((tag, []))

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self._silent = max(0, self._silent - 1)
        if tag == "ul":
            self._depth = max(0, self._depth - 1)
        self._close(tag)

    def _close(self, tag):
        if any(t == tag for t, _ in self._open):
            while self._open:
                name, parts = self._open.pop()
                self.blocks.append((name, " ".join("".join(parts).split()), self._depth))
                if name == tag:
                    break

    def handle_data(self, data):
        if self._open and not self._silent:
            self._open[-1][1].append(data)

    def close(self):
        super().close()
        while self._open:
            name, parts = self._open.pop()
            self.blocks.append((name, " ".join("".join(parts).split()), self._depth))


PAGE = "url string, title string, heading string, text string, n_links long"


def parse_html(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, title, heading, text (paragraphs, one a line), n_links of each page; nulls where there is none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for where, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Elements()
                page.feed(source or "")
                page.close()
                first = lambda tag, page=page: next((t for name, t, _ in page.blocks if name == tag), None)
                text = "\n".join(t for name, t, _ in page.blocks if name == "p" and t)
                rows.append((where, first("title"), first("h1"), text or None, len(page.links)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            names, kinds = ("url", "title", "heading", "text", "n_links"), (pa.string(),) * 4 + (pa.int64(),)
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, PAGE)


def tagesschau_header(header: Column) -> Column:
    """(username, timestamp) of ``Am <day> um <time> von <name>``."""
    pattern = r"Am (.+) um (.+) von (.+)"
    at = F.concat_ws(" ", F.regexp_extract(header, pattern, 1), F.regexp_extract(header, pattern, 2))
    when = F.coalesce(F.try_to_timestamp(german_months(at), F.lit("d. MMMM yyyy HH:mm")), F.try_to_timestamp(at, F.lit("dd.MM.yyyy HH:mm")))
    return F.struct(F.regexp_extract(header, pattern, 3).alias("username"), when.alias("timestamp"))


def german_months(text: Column) -> Column:
    english = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
    return reduce(lambda out, m: F.replace(out, F.lit(m[0]), F.lit(m[1])), zip(MONTHS, english, strict=True), text)


def zeit_time(text: Column, now: Column) -> Column:
    """Time of a comment: a German date, or so many hours, minutes or days before ``now``; other units count as none."""
    pattern = r"vor (\d+) (\w+)"
    n = F.coalesce(F.try_to_number(F.regexp_extract(text, pattern, 1), F.lit("999999")).cast("int"), F.lit(0))
    unit = F.regexp_extract(text, r"(?U)" + pattern, 2)
    amount = lambda name: F.when(unit.startswith(name), n).otherwise(0)
    ago = now - F.make_interval(days=amount("Tag"), hours=amount("Stunde"), mins=amount("Minute"))
    dated = F.coalesce(F.try_to_timestamp(german_months(text), F.lit("d. MMMM yyyy, H:mm 'Uhr'")), F.try_to_timestamp(german_months(text), F.lit("d. MMMM yyyy")))
    return F.when(text.rlike(r"vor \d+"), ago).otherwise(dated)


def numbered(comments: DataFrame, articles: DataFrame, first_id: int = 1) -> DataFrame:
    """Comment rows with ids in order of article and place, as a store would hand them out."""
    from ..schema import dense_position

    joined = in_order(comments).join(articles.select("url", F.col("id").alias("article_id")), "url")
    placed = dense_position(joined, ["article_id", "place"], F.floor(F.col("article_id") / 64), "_p")
    return conform(placed.withColumn("id", F.col("_p") + first_id).withColumnRenamed("timestamp", "ts"))


def require_comments(status: DataFrame) -> None:
    bad = status.where("status <> 'OK'").limit(1).collect()
    if bad:
        raise GraphError(f"{bad[0]['url']}: {bad[0]['status']}")
