"""Main text of web pages by structure and by a suffix array for each host.

A page is cut into blocks at block-level tags by one scan that takes time in proportion to the page, whatever its markup. Structure
decides where it is certain: nav, aside, footer, forms, a header outside the article, roles, scripts and styles go; so do
containers that are named as comments or adverts, or by a name made of page furniture throughout (share-box,
cookie-notice), inside an article or on a page without one. A container that one word of furniture names (related, alert, discussion) is in doubt: it goes if its structure says
so (half of its text in links, a form in it, or two like children under a word for comments), and else the host decides.
Nothing else inside an article goes, and no name on the article itself counts.

For that, what is in doubt and all outer blocks of a host's pages are laid end to end as token streams; a suffix array, by
doubling prefixes up to RUN tokens, finds runs that occur on two or more distinct pages, and all tokens that such runs cover
are boilerplate. A container in doubt goes if runs cover half of its tokens. On a page without an article, the unique runs of its
outer blocks that aren't furniture are the main text; so copies of such a page on one host leave nothing of each other.

Hosts with over PAGES pages are dealt out by hash, PAGES or so a group, so that no task holds a whole large host. The
suffix array finds the runs of a group; those that groups share are found by 64-bit hashes of all runs of the host, which
meet in a shuffle. Both ways give the same text; two runs of one host whose hashes collide by chance would count as one.

Defined results: null or empty html gives an empty text; pages with a null url form a host of their own; repeated rows
count as distinct pages only if their page_id differs, and no run goes from row to row; unclosed elements end with the page; a
tag that never ends is text, and so is all after it; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import save
from .textbytes import Spans

RUN = 8
PAGES = 256
SMALL_HOSTS = 100_000  # rows of large hosts up to which they are broadcast
# Elements and the words of class and id that mark page furniture
FURNITURE = frozenset("nav footer aside form menu dialog button".split())
SURE = frozenset("ad ads adsbygoogle advert adverts advertisement advertising sponsored comment comments disqus respond replies".split())
TALK = frozenset("discussion reactions responses feedback talk thread".split())
WORDS = SURE | TALK | frozenset(
    "alert banner breadcrumb breadcrumbs consent cookie cookies disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion related reply search share sharing sidebar signup skip social sponsor subscribe subscription toolbar warning widget".split()
)
PARTS = frozenset("area bar block box button buttons container content count footer form group header icon icons inner item items link links list main panel row section site top bottom left right widget wrap wrapper".split())
CONTAINERS = FURNITURE | frozenset("article main header section div ul ol dl table figure details blockquote body html head fieldset center".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = {n: re.compile(f"</{n}(?![a-z0-9:-])[^>]*>?", re.I) for n in "script style noscript template svg math iframe textarea select object canvas title".split()}
START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
TAG_END = re.compile("""(?:[^"'>=]++|=\\s*+"[^"]*+"|=\\s*+'[^']*+'|[="'])*+>""")  # quotes count after = only
HINT = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile("[a-z]+")
GONE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())


def hints(name: str, attributes: str, inside: bool) -> tuple[str, bool, bool]:
    """(what the names say, main content, a word for comments): `gone`, `doubt` or nothing. A header inside an article is part of it."""
    says, main, talk = "", False, False
    words = WORDS - {"header"} if inside else WORDS
    for m in HINT.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            role = value.lower().strip()
            main |= role in ("main", "article")
            says = "gone" if role in GONE_ROLES else says
            continue
        for token in re.sub("(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
            own = WORD.findall(token)
            found = [w for w in own if w in words]
            if not found:
                continue
            if len(own) > 1 and all(w in words or w in PARTS for w in own) or len(own) == 1 and own[0] in SURE:
                says = "gone"
            elif len(own) == 1:
                says, talk = says or "doubt", talk or own[0] in TALK
    return says, main, talk


class Doubt:
    """A container that one word names as furniture, and what its structure says."""

    def __init__(self, talk: bool):
        self.talk, self.all, self.linked, self.form, self.children = talk, 0, 0, False, Counter()

    def gone(self) -> bool:
        like = self.talk and max(self.children.values(), default=0) > 1
        return self.form or like or self.all > 0 and 2 * self.linked >= self.all


def blocks(page: str) -> tuple[list[tuple[str, bool, bool, int]], list[Doubt]]:
    """((text, inside the article, inside furniture, number of the container in doubt or -1) of each block, the containers in doubt)."""
    out: list[tuple[str, bool, bool, int]] = []
    doubts: list[Doubt] = []
    stack: list[tuple[str, bool, bool, int]] = []  # element, and the state around it
    inside, gone, doubt = False, False, -1
    open_: Counter[str] = Counter()
    parts: list[str] = []
    links = at = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((text, inside, gone, doubt))

    def add(part: str) -> None:
        if part:
            parts.append(part)
            if doubt >= 0:
                size = len(part.strip())
                doubts[doubt].all += size
                doubts[doubt].linked += size if links else 0

    while m := START.search(page, at):
        add(page[at : m.start()])
        if m[2] is None:
            comment = m[0] == "<!--"
            end = page.find("-->" if comment else ">", m.end())
            at = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        name, closing = m[2].lower(), bool(m[1])
        end = TAG_END.match(page, m.end())
        if end is None:  # it never ends
            at = m.start()
            break
        attributes, at = page[m.end() : end.end() - 1], end.end()
        if name in HIDDEN and not closing:
            if doubt >= 0 and name in ("textarea", "select"):
                doubts[doubt].form = True
            if name in ("script", "style") or not attributes.endswith("/"):
                close = HIDDEN[name].search(page, at)
                at = close.end() if close else len(page)
            continue
        if name in INLINE:
            links = max(0, links - 1 if closing else links + 1) if name == "a" else links
            continue
        flush()
        if doubt >= 0 and not closing:
            doubts[doubt].form |= name in ("form", "input", "button")
            if name == "article" or attributes.strip() and name in ("li", "div", "section"):
                doubts[doubt].children[name, attributes.strip()] += 1
        if name not in CONTAINERS:
            continue
        links = 0
        if closing:
            if open_[name]:
                while stack:
                    was, inside, gone, doubt = stack.pop()
                    open_[was] -= 1
                    if was == name:
                        break
        elif not attributes.endswith("/"):
            says, main, talk = hints(name, attributes, inside) if attributes and name not in ("body", "html", "main", "article") else ("", False, False)
            furniture = says == "gone" or name in FURNITURE or name == "head" or name == "header" and not inside
            stack.append((name, inside, gone, doubt))
            open_[name] += 1
            if says == "doubt" and not gone and doubt < 0 and not furniture:
                doubt = len(doubts)
                doubts.append(Doubt(talk))
            if name in ("article", "main") and not inside:
                doubt = -1  # a name around the article says nothing about it
            inside = inside or (main or name in ("article", "main")) and not furniture and not gone
            gone = gone or furniture
    add(page[at:])
    flush()
    return out, doubts


def runs(tokens: np.ndarray, page: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where runs of RUN tokens start that occur on two or more pages. Runs don't leave their row."""
    n = len(tokens)
    out = np.zeros(n, bool)
    if n < RUN:
        return out
    _, rank = np.unique(tokens, return_inverse=True)
    width = 1
    while width < RUN:  # ranks of prefixes twice as long, from pairs of ranks
        second = np.full(n, -1, np.int64)
        second[:-width] = rank[width:]
        order = np.lexsort((second, rank))
        new = np.ones(n, bool)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        width *= 2
    inside = np.flatnonzero(row[: n - RUN + 1] == row[RUN - 1 :])
    order = inside[np.lexsort((page[inside], rank[inside]))]  # the suffix array, down to RUN tokens
    if not len(order):
        return out
    first = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))
    last = np.append(first[1:], len(order)) - 1
    out[order[np.repeat(page[order][first] != page[order][last], last - first + 1)]] = True
    return out


def cover(start: np.ndarray) -> np.ndarray:
    """Which tokens lie in a run that starts where start is set."""
    edge = np.zeros(len(start) + 1, np.int64)
    at = np.flatnonzero(start)
    edge[at] += 1
    edge[at + RUN] -= 1
    return np.cumsum(edge[:-1]) > 0


def repeated(tokens: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Which tokens lie in a run of RUN tokens that occurs on two or more pages. Runs don't leave their page."""
    return cover(runs(tokens, page, page))


def run_hashes(words: list[str]) -> np.ndarray:
    """The hash of each run of RUN words: of its bytes, a space between words, which no word holds."""
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    n = max(0, len(ends) - RUN + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])
    return Spans(data).of(starts[:n], ends[RUN - 1 :]).view(np.int64) if n else np.zeros(0, np.int64)


def found_runs(ids: list, rows: list[list[str]]) -> list[np.ndarray]:
    """For each row of words, where runs start that two or more of the pages share."""
    number = {p: i for i, p in enumerate(dict.fromkeys(ids))}
    sizes = [len(w) for w in rows]
    codes: dict[str, int] = {}
    tokens = np.array([codes.setdefault(w, len(codes)) for words in rows for w in words], np.int64)
    start = runs(tokens, np.repeat(np.array([number[i] for i in ids], np.int64), sizes), np.repeat(np.arange(len(rows)), sizes))
    return np.split(start, np.cumsum(sizes)[:-1])


def result(ids: pa.Array, urls: pa.Array, main: list, rows: list[list[str]], free: list[list[bool]], starts: list[np.ndarray]) -> list[pa.Array]:
    """main: the parts of the article, each with the place of its tokens among the outer ones if it is in doubt; null without an article."""
    texts, covered = [], []
    for parts, words, flags, start in zip(main, rows, free, starts):
        hit = cover(start)
        covered.append(int(hit.sum()))
        if parts is None:
            texts.append(" ".join(w for w, f, h in zip(words, flags, hit) if f and not h))
        else:
            texts.append(" ".join(p["text"] for p in parts if not p["size"] or 2 * int(hit[p["start"] : p["start"] + p["size"]].sum()) < p["size"]))
    return [ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(covered, pa.int64())]


PART = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int64()), ("size", pa.int64())]))
PARSED = "main array<struct<text: string, start: long, size: long>>, outer array<string>, open array<boolean>"


def parsed(page: str) -> tuple[list[dict] | None, list[str], list[bool]]:
    """(parts of the article or None, outer tokens, which of these can be main text). Parts in doubt have their tokens among the outer ones."""
    found, doubts = blocks(page)
    verdict = [d.gone() for d in doubts]
    parts: list[dict] = []
    words: list[str] = []
    free: list[bool] = []
    whole = False
    last = -1  # the container in doubt that the last part came from
    for text, inside, gone, doubt in found:
        if doubt >= 0 and verdict[doubt]:
            gone = True
        own = text.split(" ")
        if inside and not gone:
            whole = True
            if doubt < 0:
                parts.append({"text": text, "start": 0, "size": 0})
                last = -1
                continue
            if doubt == last:
                parts[-1]["text"] += " " + text
                parts[-1]["size"] += len(own)
            else:
                parts.append({"text": text, "start": len(words), "size": len(own)})
            last = doubt
        elif inside:
            last = -1
        words += own
        free += [not gone] * len(own)
    return parts if whole else None, words, free


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_boilerplate) of each page; n_boilerplate: its outer tokens in repeated runs."""
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    counts = pages.select(host.alias("host")).groupBy("host").count().where(F.col("count") > PAGES).select("host", F.ceil(F.col("count") / PAGES).alias("groups"))
    large_hosts = counts.limit(SMALL_HOSTS + 1).count()
    keyed = pages.select("page_id", "url", "html", host.alias("host"))
    keyed = keyed.join(F.broadcast(counts) if large_hosts <= SMALL_HOSTS else counts, "host", "left")
    keyed = keyed.select("page_id", "url", "host", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("groups")), F.lit(0)).alias("group"), "html", F.col("groups").isNotNull().alias("large"))
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long, n_boilerplate long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                main, outer, open_ = map(list, zip(*(parsed(page or "") for page in part.column(4).to_pylist()))) if part.num_rows else ([], [], [])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(main, PART), pa.array(outer, pa.list_(pa.string())), pa.array(open_, pa.list_(pa.bool_()))], ["page_id", "url", "host", "group", "main", "outer", "open"])

    def scan(table: pa.Table) -> pa.Table:
        """(host, group, page, run): hashes of the runs of one page only, with a hash of it; and of those of several, each once, without."""
        rows, ids, keys = (table.column(c).to_pylist() for c in ("outer", "page_id", "key"))
        alone, shared = [], []
        for words, start in zip(rows, found_runs(ids, rows)):
            h = run_hashes(words)
            alone.append(np.unique(h[~start[: len(h)]]))
            shared.append(h[start[: len(h)]])
        many = np.unique(np.concatenate(shared))
        pages_ = pa.array(np.repeat(np.array(keys, np.int64), [len(h) for h in alone]))
        n = len(pages_) + len(many)
        same = [pa.repeat(table.column(c)[0], n) for c in ("host", "group")]
        return pa.table([*same, pa.concat_arrays([pages_, pa.nulls(len(many), pa.int64())]), pa.array(np.concatenate([*alone, many]))], names=["host", "group", "page", "run"])

    def judge(table: pa.Table, more: pa.Table | None = None) -> pa.Table:
        main, rows, free, ids = (table.column(c).to_pylist() for c in ("main", "outer", "open", "page_id"))
        starts = found_runs(ids, rows) if rows else []
        if more is not None and more.num_rows:
            elsewhere = more.column("run").to_numpy()
            for words, start in zip(rows, starts):
                h = run_hashes(words)
                start[: len(h)] |= np.isin(h, elsewhere)
        return pa.table(result(table.column("page_id"), table.column("url"), main, rows, free, starts), names=["page_id", "url", "text", "n_chars", "n_boilerplate"])

    cut_up = lambda rows: rows.drop("large").mapInArrow(cut, f"page_id {kind}, url string, host string, group long, {PARSED}")
    if not large_hosts:
        return cut_up(keyed).groupBy("host", "group").applyInArrow(lambda t: judge(t), schema)
    outer = cut_up(keyed.where("large")).select("host", "group", "page_id", F.xxhash64("page_id").alias("key"), "outer")
    found = save(outer.groupBy("host", "group").applyInArrow(scan, "host string, group long, page long, run long"), "html")
    low, high = F.min(F.coalesce("page", F.lit(-(1 << 63)))), F.max(F.coalesce("page", F.lit((1 << 63) - 1)))
    many = found.groupBy("host", "run").agg(low.alias("low"), high.alias("high")).where("low < high").select("host", "run")
    more = found.where("page is not null").join(many, ["host", "run"]).select("host", "group", "run").distinct()
    return cut_up(keyed).groupBy("host", "group").cogroup(more.groupBy("host", "group")).applyInArrow(judge, schema)
