"""Main text of web pages by consensus of a host's pages.

Every page's containers are scored by the text that their own blocks hold, less link text. The share of each container is a vote for
its generalised path (tags with classes, digits blanked). Spark sums the votes per host; the best path wins, and with it all others whose
own text is a fair share of the host's. Then every page is extracted again: from the common ancestor of its containers on its host's
paths, or of its own best ones where the host's hold little of its text, and from the article or main element around it; without such an
element, the headline and the prose that stand beside the region belong to it. Within the region names hide advertising, comments and the
like, and what is mostly links, but no prose.

Markup is read as browsers read it, in one pass: a tag, comment or script that never ends takes the rest of the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, small_batches, written

# Elements by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style noscript template head title nav footer aside form button select option textarea iframe svg object canvas dialog menu audio video".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CONTAINERS = frozenset("article body center div main section td".split())
_BOILERPLATE = frozenset("ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer discussion disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted promotion reader-comments recommended related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar warning widget widgets".split())
#: Of these, the words that tell of boilerplate outside an article's text only: within it they may name any prose.
_SOFT = frozenset("banner breadcrumb breadcrumbs disclaimer footer form masthead notice recommended related search share sharing social tags toolbar warning".split())
#: Elements whose content is no markup.
_RAW = frozenset("script style title textarea iframe noembed noframes".split())
#: Hosts whose winning paths are broadcast, at most, and tasks that share a host's pages beyond that.
BROADCAST_HOSTS, SALTS = 20_000, 64
#: A path wins if it holds so much of the text; a host's paths count for a page if they hold so much of its text.
KEEP, LEAST = 0.1, 0.2
#: A name that starts with a boilerplate word is boilerplate if one of these ends it; one with a word of the second kind tells of a layout.
_HOLDERS = frozenset("area author bar block box buttons body count field form icons inner item items left links list meta posts right slot text unit wrap wrapper".split())
_STATES = frozenset("has have hide is no not show with without".split())
#: A covered element shows if so much of the page's text is outside all covered ones at most (a form: outside it).
_LITTLE, _FORM = 0.1, 0.5
_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
#: An open element of the first kind is closed by the start of one of the second.
_CLOSES = {"p": _BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}}
_SCOPES = frozenset("article aside body div footer form header main nav ol section table td th ul".split())
#: A path longer than that goes on from its digest.
_LONG_PATH = 512
_SPACE = re.compile(r"\s+")
_TAG_NAME = re.compile(r"[A-Za-z][^\t\n\f\r />]*+")
#: The end of a tag, or one attribute: name, value in double quotes, in single quotes, in none.
_ATTRIBUTE = re.compile(r"""[\t\n\f\r /]*+(?:(>)|([^\t\n\f\r />][^\t\n\f\r />=]*+)[\t\n\f\r ]*+(?:=[\t\n\f\r ]*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\t\n\f\r >]*+)))?+)""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.IGNORECASE) for tag in _RAW}
#: Numbers in character references: zeros in front, and numbers that are no character's.
_ZEROS, _BEYOND = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])"), re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
#: The end of a sentence; the start of a line that is no prose.
_SENTENCE, _RIGHTS = re.compile(r"[.!?\u2026\u3002][\"'\u2019\u201d\u00bb)\]]*$"), re.compile(r"(?i)\u00a9|\(c\)|copyright\b|all rights reserved")
#: A cover that names may hide within an article shows with so many words, or as a sentence.
_PROSE_WORDS = 4
_NAMES = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")


def _boilerplate(attrs: dict[str, str]) -> str | None:
    """The boilerplate word that a whole name of the class or id is, or that its last part is."""
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        parts = [x for x in _NAMES.split(name) if x]
        if not parts or not _STATES.isdisjoint(parts):
            continue
        if name in _BOILERPLATE:
            return name
        if parts[-1] in _BOILERPLATE:
            return parts[-1]
        if parts[0] in _BOILERPLATE and parts[-1] in _HOLDERS:
            return parts[0]
    return None


def characters(text: str) -> str:
    """text with its character references decoded; numbers that are no character's become U+FFFD, however long."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _BEYOND.sub("\ufffd", _ZEROS.sub(r"&#\1", text))
    return unescape(text)


class _Page:
    """Blocks of a page in order: (index of its container in paths, text, share of link text, whether it is a headline).

    Scripts, navigation and the like are hidden at once. Forms, and elements whose name or role tells of boilerplate, are
    covers: what they hold is kept until the whole page is known, as a layout may bear such a name (see finish).
    """

    def __init__(self):
        self.open: list[tuple[str, bool, int, int]] = []  # tag, hidden, container, cover
        # Places in open: of each tag, of scopes, of elements whose end tag may be left out. No step has to walk the open elements.
        self.where: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.closable: list[int] = []
        self.paths: list[str] = [""]
        self.parents: list[int] = [-1]
        self.tags: list[str] = [""]
        self.blocks: list[tuple[int, str, float, bool]] = []
        self.held: list[tuple[int, list[tuple[int, str, bool]], bool]] = []
        self.parts: list[tuple[int, str, bool]] = []  # cover, text, whether in a link
        self.headline = False
        self.covers: list[tuple[int, bool, int]] = [(-1, False, -1)]  # the cover around it, whether it is a form, the container around it if names alone hide it there (else -1); 0: none
        self.shown: set[int] = set()
        self.articles: list[int] = []  # covers that hold an article or main element at once
        self.in_link = 0
        self.hidden, self.container, self.cover = False, 0, 0

    def feed(self, page: str) -> None:
        """Read the page's markup, each character a fixed number of times."""
        at = begin = 0
        while (at := page.find("<", at)) >= 0:
            sign = page[at + 1 : at + 2]
            if sign in ("!", "?") and sign:
                self.handle_data(page[begin:at])
                end = page.find("-->", at + 2) + 2 if page.startswith("<!--", at) else page.find(">", at + 2)
                if page.startswith("<!--", at) and end < 2 or end < 0:
                    return
                at = begin = end + 1
            elif sign == "/":
                name = _TAG_NAME.match(page, at + 2)
                self.handle_data(page[begin:at])
                end = page.find(">", at + 2)
                if end < 0:
                    return
                if name:
                    self.handle_endtag(name[0].lower())
                at = begin = end + 1
            elif name := _TAG_NAME.match(page, at + 1):
                self.handle_data(page[begin:at])
                at = begin = self.start(page, name[0].lower(), name.end())
                if at < 0:
                    return
            else:
                at += 1
        self.handle_data(page[begin:])

    def start(self, page: str, tag: str, at: int) -> int:
        """A start tag whose name ends at this place; where the text goes on, -1 if it never does."""
        attrs: dict[str, str] = {}
        while True:
            m = _ATTRIBUTE.match(page, at)
            if not m:
                return -1
            at = m.end()
            if m[1]:
                break
            name = m[2].lower()
            if name not in attrs:
                attrs[name] = characters(m[m.lastindex] if m.lastindex > 2 else "")
        self.handle_starttag(tag, attrs)
        closed = page[at - 2] == "/"
        if tag in _RAW and not closed:
            end = _RAW_END[tag].search(page, at)
            return end.start() if end else -1
        if tag in _RAW:
            self.handle_endtag(tag)
        return at

    def flush(self) -> None:
        if self.parts:
            self.held.append((self.container, self.parts, self.headline))
        self.parts, self.headline = [], False

    def pop(self) -> None:
        tag = self.open.pop()[0]
        self.where[tag].pop()
        if tag in _SCOPES:
            self.scopes.pop()
        if tag in _CLOSES:
            self.closable.pop()
        if tag in _BLOCKS:
            self.flush()
        self.in_link -= tag == "a"
        self.hidden, self.container, self.cover = self.open[-1][1:] if self.open else (False, 0, 0)

    def unwanted(self, tag: str, attrs: dict[str, str]) -> bool:
        if tag in _HIDDEN and tag != "form" or tag == "header" and not self.where.get("article") and not self.where.get("main"):
            return True
        return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"

    def covering(self, tag: str, attrs: dict[str, str]) -> tuple[bool, int] | None:
        """Whether the cover that the element is stands for a form, and the container in which only its name hides it, or -1."""
        role = attrs.get("role", "").lower()
        if tag == "form" or role in _ROLES:
            return tag == "form" or role == "form", -1
        word = _boilerplate(attrs) if tag not in ("html", "body", "article", "main") else None
        return (False, self.container if word in _SOFT else -1) if word else None

    def handle_starttag(self, tag: str, given: dict[str, str]) -> None:
        if tag in _VOID:
            if tag in _BLOCKS:
                self.flush()
            elif tag == "br" and not self.hidden:
                self.parts.append((self.cover, " ", False))
            return
        for k in reversed(self.closable):  # one of a kind within a scope at most
            if self.scopes and k < self.scopes[-1]:
                break
            if tag in _CLOSES[self.open[k][0]]:
                while len(self.open) > k:
                    self.pop()
                break
        if tag in _BLOCKS:
            self.flush()
        hidden, container, cover = self.hidden or self.unwanted(tag, given), self.container, self.cover
        if not hidden and (kind := self.covering(tag, given)):
            self.covers.append((cover, *kind))
            cover = len(self.covers) - 1
        if tag in ("article", "main") and not hidden and _BOILERPLATE.isdisjoint(_NAMES.split(f"{given.get('class', '')} {given.get('id', '')}".lower())):
            self.articles.append(cover)
        if tag in _CONTAINERS and not hidden:
            names = sorted({_DIGITS.sub("#", c).replace(">", "") for c in given.get("class", "").lower().split()})
            path = f"{self.paths[container]}>{'.'.join([tag, *names])}"
            self.paths.append(path if len(path) <= _LONG_PATH else f"#{xxhash.xxh3_128_hexdigest(path)}")
            self.parents.append(container)
            self.tags.append(tag)
            container = len(self.paths) - 1
        self.where.setdefault(tag, []).append(len(self.open))
        if tag in _SCOPES:
            self.scopes.append(len(self.open))
        if tag in _CLOSES:
            self.closable.append(len(self.open))
        self.open.append((tag, hidden, container, cover))
        self.in_link += tag == "a"
        self.hidden, self.container, self.cover = hidden, container, cover

    def handle_endtag(self, tag: str) -> None:
        if not self.where.get(tag):
            return
        k = self.where[tag][-1]
        if self.scopes and self.scopes[-1] > k and tag not in _SCOPES and tag not in ("html", "head"):
            return
        while len(self.open) > k:
            self.pop()

    def handle_data(self, data: str) -> None:
        if data and not self.hidden:
            data = characters(data)
            self.parts.append((self.cover, data, self.in_link > 0))
            if self.where.get("h1") and not data.isspace():
                self.headline = True

    def lifted(self) -> set[int]:
        """Covers that are no boilerplate: those around the page's only articles, forms with most of its text, others with nearly all of it."""
        texts = [0] * len(self.covers)
        for _, parts, _ in self.held:
            for cover, text, link in parts:
                texts[cover] += 0 if link else len(text.strip())
        bare, total, inside = texts[0], sum(texts), list(texts)
        for k in range(len(texts) - 1, 0, -1):
            if self.covers[k][0] > 0:
                inside[self.covers[k][0]] += inside[k]
        found: set[int] = set()
        for cover in [] if 0 in self.articles else self.articles:
            while cover > 0 and cover not in found:
                found.add(cover)
                cover = self.covers[cover][0]
        for k in range(1, len(texts)):
            if inside[k] > _FORM * total and (self.covers[k][1] or bare < _LITTLE * total):
                found.add(k)
        return found

    def prose(self, region: list[bool]) -> set[int]:
        """Covers that names alone hide, within the region, and that hold prose rather than links."""
        texts, links = [[] for _ in self.covers], [0] * len(self.covers)
        for _, parts, _ in self.held:
            for cover, text, link in parts:
                texts[cover].append(text)
                links[cover] += len(text) if link else 0
        found: set[int] = set()
        for k, (_, _, around) in enumerate(self.covers):
            if around >= 0 and region[around]:
                text = _SPACE.sub(" ", "".join(texts[k])).strip()
                if links[k] <= len(text) / 2 and (text.count(" ") + 1 >= _PROSE_WORDS or _SENTENCE.search(text)):
                    found.add(k)
        return found

    def assembled(self, shown: set[int]) -> list[tuple[int, str, float, bool]]:
        """The blocks, with the text of these covers and of none."""
        seen, out = [True], []
        for k in range(1, len(self.covers)):
            seen.append(k in shown and seen[self.covers[k][0]])
        for container, parts, headline in self.held:
            text = _SPACE.sub(" ", "".join(x for cover, x, _ in parts if seen[cover])).strip()
            if text:
                out.append((container, text, min(1.0, sum(len(x) for cover, x, link in parts if link and seen[cover]) / len(text)), headline))
        return out

    def finish(self) -> _Page:
        while self.open:
            self.pop()
        self.flush()
        self.shown = self.lifted() if len(self.covers) > 1 else set()
        self.blocks = self.assembled(self.shown)
        return self


def parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    return page.finish()


def _worth(page: _Page) -> dict[int, float]:
    """The text that each container's own blocks hold, less link text."""
    own: dict[int, float] = {}
    for container, text, links, _ in page.blocks:
        own[container] = own.get(container, 0.0) + len(text) * (1 - links)
    return own


def votes(page: _Page) -> list[tuple[str, float, float]]:
    """(path, share, own) of containers that hold text: a block counts wholly for its container and a third for the one above; own
    is without these thirds. Best first."""
    held = _worth(page)
    scores = dict(held)
    for container, worth in held.items():
        if page.parents[container] > 0:
            scores[page.parents[container]] = scores.get(page.parents[container], 0.0) + worth / 3
    total, text = sum(scores.values()), sum(held.values())
    by_path: dict[str, tuple[float, float]] = {}
    for container, score in scores.items():
        if container and score:
            share, own = by_path.get(page.paths[container], (0.0, 0.0))
            by_path[page.paths[container]] = share + score / total, own + held.get(container, 0.0) / text
    return sorted(((p, *x) for p, x in by_path.items()), key=lambda x: (-x[1], x[0]))


def _down(page: _Page, marked) -> list[bool]:
    """Whether a container or one around it is marked. A container comes after those around it."""
    out: list[bool] = []
    for k, parent in enumerate(page.parents):
        out.append(marked(k) or parent >= 0 and out[parent])
    return out


def _up(page: _Page, values: list[float]) -> list[float]:
    """Each container's value and those of all within it, added up."""
    out = list(values)
    for k in range(len(out) - 1, 0, -1):
        out[page.parents[k]] += out[k]
    return out


def extract(html: str | None, paths: list[str] | None) -> str:
    """The main text by a host's paths, the best first, or by the page's own, or all there is if it has no container."""
    page = parsed(html)
    own = votes(page)
    if not own:
        return "\n\n".join(text for _, text, _, _ in page.blocks)
    count, held = len(page.paths), _worth(page)
    alone, text_in_all = {p: x for p, _, x in own}, sum(held.values())
    known = set(page.paths)

    def present(given: list[str]) -> list[str]:
        """Those on the page; a path around others (like body, from pages of another kind) only if it is the best or holds text itself."""
        on = {p for p in given if p in known}
        within = _up(page, [float(p in on) for p in page.paths])
        around_others = {p for k, p in enumerate(page.paths) if p in on and within[k] > 1}
        return [p for p in given if p in on and (p == given[0] or alone.get(p, 0.0) >= KEEP or p not in around_others)]

    won = set(present(list(paths))) if paths is not None and len(paths) else set()
    covered = _down(page, lambda k: page.paths[k] in won)
    if not won or sum(x for k, x in held.items() if covered[k]) < LEAST * text_in_all:
        won = set(present([own[0][0], *(p for p, _, x in own[1:] if x >= KEEP)]))
    full = _up(page, [held.get(k, 0.0) for k in range(count)])
    hit = [page.paths[k] in won and full[k] > 0 for k in range(count)]
    under_hit = _down(page, lambda k: hit[k])
    tops = {k for k in range(count) if hit[k] and not under_hit[page.parents[k]]}
    holds = _up(page, [float(k in tops) for k in range(count)])
    up = max(k for k in range(count) if holds[k] == len(tops))  # the common container farthest in
    article: list[int | None] = []  # the nearest article or main around a container, itself included
    for k, parent in enumerate(page.parents):
        article.append(k if page.tags[k] in ("article", "main") else article[parent] if parent >= 0 else None)
    if article[up] is not None:
        regions = {article[up]}
    elif page.tags[up] not in ("", "body", "html") or all(article[t] is None for t in tops):
        regions = {up}
    else:  # several under the body, some of them articles
        regions = {t if article[t] is None else article[t] for t in tops}
    in_region = _down(page, lambda k: k in regions)
    blocks = page.blocks
    if len(page.covers) > 1 and (more := page.prose([x and page.tags[k] not in ("", "body", "html") for k, x in enumerate(in_region)])):
        blocks = page.assembled(page.shown | more)
    # Around a region, the text that stands beside it (a title) comes along; without an article the prose next to it as well.
    beside: set[int] = set()
    for k in regions:
        while (k := page.parents[k]) > 0 and k not in beside:
            beside.add(k)
    beside = {k for k in beside if page.tags[k] != "body"}
    titled = any(headline and in_region[container] for container, _, _, headline in blocks)
    alone = all(article[k] is None for k in regions)
    # In a region that is no article, a side container that is mostly links stays out.
    text, linked = [0.0] * count, [0.0] * count
    for container, block, links, _ in blocks if alone else ():
        text[container] += len(block)
        linked[container] += len(block) * links
    text, linked, in_top = _up(page, text), _up(page, linked), _down(page, lambda k: k in tops)
    listed = _down(page, lambda k: linked[k] > text[k] / 2 and k not in regions and not holds[k] and not in_top[k])
    out = []
    for container, block, links, headline in blocks:
        if in_region[container]:
            wanted = not listed[container]
        elif links >= 0.5 or _RIGHTS.match(block):
            wanted = False
        else:
            wanted = container in beside or headline and not titled or alone and article[container] is None and bool(_SENTENCE.search(block))
        if wanted:
            out.append(block)
    return "\n\n".join(out)


@F.udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("own", T.DoubleType())])), useArrow=True)
def _votes(html):
    return votes(parsed(html))


@F.pandas_udf(T.StringType())
def _extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for html, paths in batches:
        yield pd.Series([extract(h, p) for h, p in zip(html, paths, strict=True)], dtype=object)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text for every row of pages(page_id, url, html).

    A null or empty html gives an empty text; pages of any length, depth and number of unclosed tags are taken whole, in time that grows with their length. Pages without a url, or with one that has no host, vote together. Ties go to the path that
    sorts first; repeated rows vote each; a page without a container gives all its visible blocks. Other columns are ignored; an
    empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    exact = lambda c: F.sum(F.round(c, 6).cast("decimal(20,6)"))
    cast = written(rows.select("host", F.explode(_votes("html")).alias("v")).groupBy("host", "v.path").agg(exact("v.share").alias("votes"), exact("v.own").alias("own")), "votes")
    best = cast.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("best"), (F.sum("own") * KEEP).alias("least"))
    fair = cast.join(best, "host").where((F.col("own") >= F.col("least")) | (F.col("path") == F.col("best")))
    order = F.array_sort(F.collect_list(F.struct((F.col("path") != F.col("best")).alias("later"), -F.col("votes").alias("v"), "path")))
    winners = written(fair.groupBy("host").agg(F.transform(order, lambda x: x["path"]).alias("paths")), "paths")  # at most 1 / KEEP and the best
    dropped(cast)
    # A host's paths are few: where there are so many hosts that they are not broadcast, a host's pages are dealt over SALTS tasks.
    if winners.count() > BROADCAST_HOSTS:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(winners.select("*", salt), ["host", "salt"], "left")
    else:
        joined = rows.join(F.broadcast(winners), "host", "left")
    return joined.select("page_id", "url", _extract("html", "paths").alias("text"))


def op8(pages: DataFrame) -> DataFrame:
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
