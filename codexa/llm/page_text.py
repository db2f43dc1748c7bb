"""Main text of web pages by a site style tree (operator 7).

Method. Pages are parsed into elements and the texts that hang directly on them. The pages of a host are merged into one tree: a branch is the path of element
names with class, id and role, generic containers without those also with their place among their like. For each branch the tree counts its presentations (sequences of
child elements) and its contents (texts). The importance of a node is the entropy of its contents, or of its presentations if it has none, over the
greatest entropy for as many occurrences; that of a branch is the mean over itself and all nodes below it, weighted by occurrences and characters and by DECAY for each level. It is set in
relation to the whole page's. Where few pages of the host hold the branch (w = pages / (pages + EVIDENCE)), the rest comes from the same path in the tree of all hosts together,
which is weighed in the same way against 1: pages of small hosts are judged by what the corpus shows of their branches. Branches of LEAST or less look
alike on pages that differ and are cut from each page of the host.

The tree comes with a prior for what repeats nowhere: elements and roles that are menus, headers, footers, asides or forms, and classes and ids that name one as a whole word or by a known
compound (`names_noise`; `no-sidebar` or `related-work` name none). On a page that has an article or main element the text is what stands inside. Forms, dialogs
and elements named by class or id are spared if what is left would be nothing or next to nothing of the page (`Page.text`). Inside an article, the tree cuts only branches with
class, id or role, and no headings: plain elements are its text, however often they occur. With prior=False the tree decides alone; with words=False no class or id is
looked at. Counts are merged by aggregation, so a host with a third of all pages never meets in one task.

Defined cases. Null or empty html: empty text. A page without a host is its own host ''. Elements deeper than DEPTH count as the branch at that depth; their text is
kept or cut like any other. Unclosed and misnested elements are closed where HTML closes them, head at the first element or text that belongs to the body; a tag or comment that
never ends hides what follows. A form or dialog around the article or the whole page does not hide it. Repeated rows alike. Empty table: no
rows. Further columns are left out.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .token_counts import groups
from .url_filter import host_and_path

DECAY, EVIDENCE, LEAST, DEPTH, SPARE = 0.9, 8, 0.85, 32, 0.2
#: Branches that are broadcast at once, eight bytes each; with more, pages are read in as many parts.
MAX_LOW = 2_000_000
MARKUP = re.compile(r"<(?:(!--)|(!\[CDATA\[)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]+|=)\s*(=?)\s*")
UNQUOTED = re.compile(r"[^\s>]*")
WORDS = frozenset
#: Fixed values of HTML.
VOID = WORDS("area base br col embed hr img input link meta source track wbr param".split())
RAW = WORDS("script style noscript template textarea title svg iframe object select".split())
INLINE = WORDS("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var".split())
CLOSED_BY = {"p": WORDS("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": WORDS(["li"]), "dt": WORDS(["dt", "dd"]), "dd": WORDS(["dt", "dd"]), "tr": WORDS(["tr"]), "td": WORDS(["td", "th", "tr"]), "th": WORDS(["td", "th", "tr"]), "option": WORDS(["option"])}
GENERIC, PLACES = WORDS(["div", "section"]), 8
#: The prior. Elements and roles that are noise wherever they stand, and those that are unless they hold the page's text.
FRAME = WORDS("html body main article".split())
HARD_TAGS, SOFT_TAGS = WORDS("nav header footer aside menu head".split()), WORDS("form button dialog".split())
HARD_ROLES, SOFT_ROLES = WORDS("navigation banner contentinfo complementary search".split()), WORDS("alert dialog form".split())
HEADINGS = WORDS("h1 h2 h3 h4 h5 h6".split())
#: Elements that may stand in head.
IN_HEAD = WORDS("base link meta title script style noscript template".split())
#: Class and id words that name noise as a whole, as the last of a compound, and as the first before one of the second.
REMARK = WORDS("ad ads advert adverts advertisement comment comments cookie cookies disqus newsletter promo replies respond sponsor sponsored".split())
WHOLE = REMARK | WORDS("alert banner breadcrumb breadcrumbs consent copyright disclaimer footer gdpr header masthead menu modal nav navbar navigation notice notices pager pagination popup related share sharing sidebar social subscribe topbar widget".split())
LAST = WORDS("ad ads advert advertisement banner breadcrumb breadcrumbs comments footer menu nav navbar navigation newsletter pagination popup sidebar".split())
FIRST_OF = WORDS("ad ads advert breadcrumb comment comments consent cookie cookies footer gdpr menu nav newsletter promo related share sidebar social sponsor sponsored subscribe widget".split())
SECOND_OF = WORDS("area articles bar block bottom box buttons consent container form icons inner item items left links list media message modal notice panel popup posts primary respond right secondary section signup slot stories thread top unit widget wrap wrapper".split())
OF_SITE, SITE_LAST = WORDS("copyright global guest legal main page privacy reader site top user visitor".split()), WORDS("bar comment header notice".split())
#: A compound with one of these says something about the page instead.
TURNED = WORDS("no not non without with has hide hides hidden on".split())
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_SPLIT = re.compile(r"[^a-z]+")


def names_noise(value: str) -> int:
    """Of a class or id: 0 if none of its names stands for noise, 1 if one does, 2 if for adverts, reader comments and the like."""
    most = 0
    for name in value.split():
        parts = [x for x in _SPLIT.split(name) if x]
        if not parts:
            continue
        if len(parts) == 1:
            hit = parts[0] in WHOLE
        else:
            hit = TURNED.isdisjoint(parts) and (parts[-1] in LAST or parts[0] in FIRST_OF and parts[1] in SECOND_OF or parts[0] in OF_SITE and parts[-1] in SITE_LAST)
        if hit:
            most = max(most, 1 if REMARK.isdisjoint(parts) else 2)
    return most


def _digest(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """(class, id and role, where the tag ends, whether it closes itself); the end is -1 for a tag that never ends."""
    named: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(page, at)
        if not m:
            end = page.find(">", at)
            return named, end + 1 if end >= 0 else -1, "/" in page[at:end]
        at, value = m.end(), ""
        if m[2]:
            quote = page[at : at + 1]
            if quote in ("'", '"') and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    end = page.find(">", at)
                    return named, end + 1 if end >= 0 else -1, False
                value, at = page[at + 1 : end], end + 1
            else:
                v = UNQUOTED.match(page, at)
                value, at = v[0], v.end()
        if (name := m[1].lower()) in ("class", "id", "role") and name not in named:
            named[name] = value.strip().lower()


#: The branch of a whole page, on all hosts.
PAGE = _digest("0 page")


class Page:
    """Elements of a page in the order in which they begin, and its texts with the elements they hang on. Element 0 is the page."""

    def __init__(self, page: str | None, host: str | None = "", known: dict | None = None):
        self.known = {} if known is None else known  # branches by parent and label, shared among pages
        self.parent, self.tag, self.depth, self.shape = [-1], [""], [0], [0]
        self.root = self._of(0, host or "")
        self.branch = [self._of(0, "page")]  # the paths are the same on all hosts
        self.labelled, self.hard, self.soft, self.wordy, self.inside = [False], [False], [False], [0], [False]
        self.texts: list[tuple[int, str]] = []
        self._read(page or "")

    def _of(self, branch: int, label: str) -> int:
        got = self.known.get((branch, label))
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[branch, label] = _digest(f"{branch} {label}")
        return got

    def _open(self, at: int, tag: str, named: dict[str, str], places: dict) -> int:
        label = f"{tag} {named}" if named else tag
        if tag in GENERIC and not named:
            place = places[at, tag] = places.get((at, tag), -1) + 1
            label = f"{tag} {min(place, PLACES)}"
        k = len(self.tag)
        self.shape[at] = hash((self.shape[at], len(label), self._of(1, label)))
        self.parent.append(at)
        self.tag.append(tag)
        self.depth.append(self.depth[at] + 1)
        self.branch.append(self._of(self.branch[at], label) if self.depth[at] < DEPTH else self.branch[at])
        self.shape.append(0)
        self.labelled.append(bool(named))
        role = named.get("role")
        wordy = max(names_noise(named.get("class", "")), names_noise(named.get("id", ""))) if named else 0
        reply = tag == "article" and (self.inside[at] or wordy == 2)  # a comment or teaser, no page's article
        frame = tag in FRAME and not reply
        self.hard.append(tag in HARD_TAGS or role in HARD_ROLES and not frame)
        self.soft.append(tag in SOFT_TAGS or role in SOFT_ROLES and not frame)
        self.wordy.append(0 if frame else wordy)
        self.inside.append(self.inside[at] or frame and tag in ("article", "main") or role == "main")
        return k

    def _read(self, page: str) -> None:
        stack, open_tags, places, text, at = [0], Counter(), {}, [], 0

        def flush() -> None:
            if text:
                joined = " ".join(entities.unescape("".join(text)).split())
                text.clear()
                if joined:
                    leave_head()
                    self.texts.append((stack[-1], joined))

        def leave_head() -> None:
            if self.tag[stack[-1]] == "head":  # the end of head may be left out
                open_tags["head"] -= 1
                stack.pop()

        def close(depth: int) -> None:
            flush()
            while len(stack) > depth:
                open_tags[self.tag[stack.pop()]] -= 1

        while at < len(page):
            m = MARKUP.search(page, at)
            if not m:
                text.append(page[at:])
                break
            text.append(page[at : m.start()])
            at = m.end()
            if m[1]:
                end = page.find("-->", at)
                at = end + 3 if end >= 0 else len(page)
                continue
            if m[2]:
                end = page.find("]]>", at)
                text.append(entities.escape(page[at : end if end >= 0 else len(page)]))
                at = end + 3 if end >= 0 else len(page)
                continue
            if not m[4]:
                end = page.find(">", at)
                at = end + 1 if end >= 0 else len(page)
                continue
            tag = m[4].lower()
            named, alone = {}, False
            if page[at : at + 1] == ">":
                at += 1
            else:
                named, at, alone = _attributes(page, at)
                if at < 0:
                    break
            if tag in INLINE:
                continue
            if m[3]:
                if open_tags[tag] > 0:
                    k = len(stack) - 1
                    while self.tag[stack[k]] != tag:
                        k -= 1
                    close(k)
                else:
                    flush()
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    text.append("\n")
                continue
            flush()
            if tag not in IN_HEAD:
                leave_head()
            if tag in RAW:
                if not (alone and tag == "svg"):
                    end = _END[tag].search(page, at)
                    at = end.end() if end else len(page)
                continue
            for k in range(len(stack) - 1, 0, -1):
                if tag in CLOSED_BY.get(self.tag[stack[k]], ()):
                    close(k)
                    break
                if self.tag[stack[k]] not in CLOSED_BY:
                    break
            stack.append(self._open(stack[-1], tag, named, places))
            open_tags[tag] += 1
        flush()

    def text(self, low: set[int] | np.ndarray, prior: bool = True, words: bool = True) -> str:
        """The main text; low: branches of low importance, mixed with the root.

        Forms, dialogs and named elements are cut if the text outside them is SPARE or more of what the sure elements leave. Otherwise those that hold more than half of that are
        kept (adverts and comments only if all would go), and if still nothing is left, also the sure elements around an article or main element.
        """
        n = len(self.tag)
        named = self.wordy if words else [0] * n
        by_tree = [False] * n
        for k in range(1, n):
            if (self.branch[k] ^ self.root) in low and self.tag[k] not in FRAME:
                by_tree[k] = not prior or not self.inside[k] or self.labelled[k] and self.tag[k] not in HEADINGS
        if not prior:
            return " ".join(t for _, t in self._left(by_tree))
        sure = self._left([x or y for x, y in zip(by_tree, self.hard, strict=True)])
        kept = self._left([x or y or z or w > 0 for x, y, z, w in zip(by_tree, self.hard, self.soft, named, strict=True)])
        total, left = sum(len(t) for _, t in sure), sum(len(t) for _, t in kept)
        if left < SPARE * total and not any(self.inside[k] for k, _ in kept):
            holds = [0] * n
            for k, t in sure:
                holds[k] += len(t)
            for k in range(n - 1, 0, -1):
                holds[self.parent[k]] += holds[k]
            spared = [2 * h > total for h in holds]
            kept = self._left([x or y or (z or w > 0) and not (f and (w < 2 or not left)) for x, y, z, w, f in zip(by_tree, self.hard, self.soft, named, spared, strict=True)])
        if not kept and any(self.inside[k] for k, _ in self.texts):
            around = [False] * n
            for k in range(n - 1, 0, -1):
                around[k] |= self.inside[k] and not self.inside[self.parent[k]]
                around[self.parent[k]] |= around[k]
            kept = self._left([(y or z or w > 0) and not f for y, z, w, f in zip(self.hard, self.soft, named, around, strict=True)])
        if any(self.inside[k] for k, _ in kept):
            kept = [(k, t) for k, t in kept if self.inside[k]]
        return " ".join(t for _, t in kept)

    def _left(self, cut: list[bool]) -> list[tuple[int, str]]:
        """The texts outside the elements that are cut."""
        gone = list(cut)
        for k in range(1, len(gone)):  # parents stand before their children
            gone[k] = gone[k] or gone[self.parent[k]]
        return [(k, t) for k, t in self.texts if not gone[k]]


def extract(page: str | None, low: set[int], host: str = "", prior: bool = True, words: bool = True) -> str:
    return Page(page, host).text(low, prior, words)


def count_page(page: Page, counts: Counter) -> None:
    """Adds a page to counts of (root, branch, kind, value, levels): kind 0 presentations, 1 contents, 2 a branch above (or itself) so many levels up, 3 pages, 4 characters."""
    root, above = page.root, {}
    for k, branch in enumerate(page.branch):
        if page.depth[k] <= DEPTH:
            counts[root, branch, 0, page.shape[k], 0] += 1
        if branch not in above:
            above[branch] = True
            counts[root, branch, 3, 0, 0] += 1
            up, levels = k, 0
            while up >= 0:
                counts[root, branch, 2, page.branch[up], levels] += 1
                up, levels = page.parent[up], levels + 1
                while up > 0 and page.depth[up] > DEPTH:
                    up = page.parent[up]
    for k, t in page.texts:
        counts[root, page.branch[k], 1, _digest(t), 0] += 1
        counts[root, page.branch[k], 4, 0, 0] += len(t)


def style_tree(pages: DataFrame) -> DataFrame:
    """root, branch, importance: the tree of each host (root: its digest); staged. pages(host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for a, b in groups(batch.column(1)):
                part, counts = batch.slice(a, b - a), Counter()
                for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    count_page(Page(page, host, known), counts)
                keys = np.array(list(counts), np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, i]) for i in range(5)), pa.array(list(counts.values()), pa.int64())], ["root", "branch", "kind", "value", "levels", "n"])

    rows = pages.mapInArrow(run, "root long, branch long, kind long, value long, levels long, n long")
    seen = stage(rows.groupBy("root", "branch", "kind", "value", "levels").agg(F.sum("n").alias("n")), "tree")
    host = _importance(seen, ["root"])
    all_hosts = _importance(stage(seen.groupBy("branch", "kind", "value", "levels").agg(F.sum("n").alias("n")), "tree"), [])
    weight = F.col("pages") / (F.col("pages") + EVIDENCE)
    behind = all_hosts.select("branch", (1 - weight * (1 - F.col("rel"))).alias("behind"))
    tree = host.join(behind, "branch")
    mixed = F.when(F.col("whole") > 0, weight * F.col("rel") + (1 - weight) * F.col("behind")).otherwise(1.0)  # a host whose pages are all alike keeps them
    return stage(tree.select("root", "branch", mixed.alias("importance")), "importance")


def _importance(seen: DataFrame, by: list[str]) -> DataFrame:
    """by, branch, pages, whole, rel: the importance of the whole page and, in relation to it, that of each branch, 1 at most."""
    total, spread = F.sum("n"), F.sum(F.col("n") * F.log("n"))
    kinds = seen.where("kind <> 2").groupBy(*by, "branch", "kind").agg(total.alias("n"), F.when(total > 1, 1 - spread / (total * F.log(total))).otherwise(1.0).alias("x"))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    node = kinds.groupBy(*by, "branch").agg(F.greatest(F.coalesce(of(1, "x"), of(0, "x")), F.lit(0.0)).alias("own"), (of(0, "n") + F.coalesce(of(4, "n"), F.lit(0))).alias("n"), of(3, "n").alias("pages"))
    node = stage(node, "nodes")
    below = seen.where("kind = 2").select(*by, "branch", F.col("value").alias("above"), "levels").join(node, [*by, "branch"])
    weight = F.col("n") * F.pow(F.lit(DECAY), F.col("levels"))
    whole = below.groupBy(*by, F.col("above").alias("branch")).agg((F.sum(weight * F.col("own")) / F.sum(weight)).alias("x"))
    whole = stage(whole, "whole")
    page = whole.where(F.col("branch") == PAGE).select(*by, F.col("x").alias("whole"))
    page = whole.join(page, by) if by else whole.withColumn("whole", F.lit(page.agg(F.max("whole")).first()[0]).cast("double"))
    rel = F.when(F.col("whole") > 0, F.least(F.col("x") / F.col("whole"), F.lit(1.0))).otherwise(1.0)
    return page.join(node.select(*by, "branch", "pages"), [*by, "branch"]).select(*by, "branch", "pages", "whole", rel.alias("rel"))


def page_text(pages: DataFrame, prior: bool = True, words: bool = True) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""
    host = host_and_path(F.col("url"))[0]
    rows = pages.select("page_id", "url", host.alias("host"), "html")
    low = style_tree(rows.select("host", "html")).where(F.col("importance") <= LEAST).where(F.col("branch") != PAGE).select("root", F.col("root").bitwiseXOR(F.col("branch")).alias("branch"))
    parts = -(-max(low.count(), 1) // MAX_LOW)
    kind = pages.schema["page_id"].dataType.simpleString()

    def part_of(i: int) -> DataFrame:
        mine = rows if parts == 1 else rows.where(F.pmod(F.xxhash64(F.coalesce("host", F.lit(""))), F.lit(parts)) == i)
        roots = mine.select(F.coalesce("host", F.lit("")).alias("host")).distinct() if parts > 1 else None
        few = low if roots is None else low.join(roots.mapInArrow(_roots, "root long"), "root", "left_semi")
        shared = pages.sparkSession.sparkContext.broadcast(np.sort(few.select("branch").toArrow().column(0).to_numpy()))  # MAX_LOW or so

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cut, known = set(shared.value.tolist()), {}
            for batch in batches:
                for a, b in groups(batch.column(3)):
                    part = batch.slice(a, b - a)
                    texts = [Page(h, host, known).text(cut, prior, words) for host, h in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return mine.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")

    out = part_of(0)
    for i in range(1, parts):
        out = out.union(part_of(i))
    return out


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_digest(f"0 {h or ''}") for h in batch.column(0).to_pylist()], pa.int64())], ["root"])


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text(table(spark, sf_dir, "pages"))
