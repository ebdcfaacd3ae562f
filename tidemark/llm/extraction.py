"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its tags and words with their path in the element tree;
a text of more than LABEL words is one token. Tokens that occur equally often
on every page of a host share an occurrence vector and form an equivalence
class. A class is valid when its tokens come in one order on the pages and
when it lies in one gap of another class; valid classes nested in each other
are the host's template. What the template leaves open are its slots: their
blocks are the text, less those in menus, headers, footers, sidebars, notices,
adverts, forms and comments, and only those of the article or main part where
the page marks one.

A null or empty page has the empty text; pages without a url form one host;
pages of hosts with fewer than `least` pages join those of the same registered
domain in one template, and where these are fewer too go by structure alone,
as nothing shows what such pages share; repeated rows are read as often as they
occur.
"""

from __future__ import annotations

import bisect
import json
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import near, slices
from tidemark.llm.markup import Piece, blocks, read
from tidemark.session import cut_lineage

SECOND_LEVEL = "ac|biz|co|com|edu|gob|gov|go|info|ltd|me|mil|ne|net|nom|or|org|plc|sch"
LABEL = 16  # a text of so many words is read word by word


def tokens(pieces: list[Piece]) -> list[tuple[str, int]]:
    """(token, number of the piece) in page order."""
    out = []
    for n, piece in enumerate(pieces):
        if piece.tag:
            out.append((f"{piece.path} <{piece.tag}>", n))
            continue
        words = piece.text.split()
        if len(words) > LABEL:
            out.append((f"{piece.path} #{xxhash.xxh3_64_hexdigest(' '.join(words))}", n))
        else:
            out.extend((f"{piece.path} {w}", n) for w in words)
    return out


def domain(host: Column) -> Column:
    """The registered domain: the last two labels, three after a second-level one such as co.uk; an address as a whole."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    return F.when(name.rlike(r"^[\d.]+$|^\["), name).otherwise(F.when(
        name.rlike(rf"\.({SECOND_LEVEL})\.[a-z][a-z]$"), F.regexp_extract(name, r"([^.]+\.[^.]+\.[^.]+)$", 1)).otherwise(
        F.regexp_extract(name, r"([^.]+\.[^.]+|[^.]*)$", 1)))


def with_host(pages: DataFrame, least: int) -> DataFrame:
    """The pages with the host whose template they share: of hosts with fewer than `least` pages, "*." and their registered domain."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    hosted = pages.select("page_id", "url", "html", host.alias("host"))
    large = hosted.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.xxhash64("host").alias("_large"))
    large = near(cut_lineage(large), F.lit(16))
    site = F.when(F.col("_large").isNotNull(), F.col("host")).otherwise(F.concat(F.lit("*."), domain(F.col("host"))))
    return hosted.join(large, F.xxhash64("host") == F.col("_large"), "left").select("page_id", "url", "html", site.alias("host"))


def vectors(pages: DataFrame) -> DataFrame:
    """Per host and token: pages, occurrences, a fingerprint of the occurrence vector, and the place on one page.

    The fingerprint adds up a hash of (page, occurrences); tokens of a batch of
    pages are added up before they leave the task. All tokens of a class have
    the same sample page, as they occur on the same pages.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            seen: dict[tuple[str, str], list] = {}
            for page_id, url, page, host in zip(*(batch.column(n).to_pylist() for n in range(4)), strict=True):
                number = xxhash.xxh3_64_intdigest(f"{page_id} {url}".encode())
                counted: dict[str, list[int]] = {}
                for place, (token, _) in enumerate(tokens(read(page or ""))):
                    if (entry := counted.get(token)) is None:
                        counted[token] = [1, place]
                    else:
                        entry[0] += 1
                for token, (n, place) in counted.items():
                    # one multiplication spreads page and count over 62 bits
                    mark = ((number ^ n * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 >> 2) & 0x3FFFFFFFFFFFFFFF
                    if (total := seen.get((host, token))) is None:
                        seen[host, token] = [1, n, mark >> 31, mark & 0x7FFFFFFF, number >> 1, place]
                    else:
                        total[0] += 1
                        total[1] += n
                        total[2] += mark >> 31
                        total[3] += mark & 0x7FFFFFFF
                        if number >> 1 < total[4]:
                            total[4:] = number >> 1, place
            if seen:
                columns = list(zip(*seen.values(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), *(pa.array(c, pa.int64()) for c in columns)],
                    names=["host", "token", "pages", "times", "high", "low", "sample", "place"])

    parts = pages.mapInArrow(work, "host string, token string, pages long, times long, high long, low long, sample long, place long")
    return parts.groupBy("host", "token").agg(
        *(F.sum(c).alias(c) for c in ("pages", "times", "high", "low")), F.min(F.struct("sample", "place")).alias("at"))


def classes(pages: DataFrame, least: int, support: float, smallest: int) -> DataFrame:
    """Equivalence classes by host as JSON: [[tokens in sample order], ...].

    Only tokens on a share of `support` of the host's pages count, so the list
    is bounded by the size of a page. One row per host.
    """
    seen = vectors(pages)
    hosts = pages.groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("_pages")).where(F.col("_pages") >= least)
    frequent = seen.where(F.col("pages") >= least).join(hosts, F.col("host") == F.col("_host")).where(
        F.col("pages") >= support * F.col("_pages"))
    grouped = frequent.groupBy("host", "_pages", "pages", "times", "high", "low").agg(
        F.array_sort(F.collect_list(F.struct(F.col("at.place").alias("place"), "token"))).alias("tokens"))
    large = grouped.where(F.size("tokens") >= smallest)
    # the outermost class comes first: it is on the most pages and opens them
    named = F.struct("pages", (-F.element_at("tokens", 1)["place"]).alias("opens"), F.col("tokens.token").alias("tokens"))
    return large.groupBy("host").agg(F.to_json(F.reverse(F.array_sort(F.collect_list(named)))).alias("classes"))


def places(found: list[tuple[str, int]], known: list[dict]) -> list[list[tuple[int, int]]]:
    """Per class the (token number, place) of its tokens' first occurrences on a page."""
    of = {token: (c, n) for c, one in enumerate(known) for n, token in enumerate(one["tokens"])}
    out: list[dict[int, int]] = [{} for _ in known]
    for place, (token, _) in enumerate(found):
        if (where := of.get(token)) is not None:
            out[where[0]].setdefault(where[1], place)
    return [sorted(one.items()) for one in out]


def in_order(first: list[int]) -> set[int]:
    """Numbers of the entries in a longest increasing run of places."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(first)
    for n, place in enumerate(first):
        k = bisect.bisect_left(tails, place)
        back[n] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(place)
            ends.append(n)
        else:
            tails[k], ends[k] = place, n
    out, n = set(), ends[-1] if ends else -1
    while n >= 0:
        out.add(n)
        n = back[n]
    return out


def gap(inner: list[int], outer: list[int]) -> tuple[int, int] | None:
    """(width, number) of the gap of `outer` that holds all of `inner`."""
    k = bisect.bisect_left(outer, inner[0])
    if k == 0 or k == len(outer) or bisect.bisect_left(outer, inner[-1]) != k:
        return None
    return outer[k] - outer[k - 1], k


def votes(pages: DataFrame) -> DataFrame:
    """What each page says of the classes of its host: tokens out of order, and in which gap a class lies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[dict]] = {}
        for batch in slices(batches, "html"):
            counted: Counter = Counter()
            for host, page, listed in zip(*(batch.column(batch.schema.names.index(c)).to_pylist()
                                            for c in ("host", "html", "classes")), strict=True):
                if listed is None:
                    continue
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = json.loads(listed)
                here = places(tokens(read(page or "")), known[host])
                for c, one in enumerate(here):
                    if not one:
                        continue
                    kept = in_order([p for _, p in one])
                    counted[host, c, -1, -1] += 1
                    for k, (n, _) in enumerate(one):
                        if k not in kept:
                            counted[host, c, -2, n] += 1
                    spots = [p for _, p in one]
                    around = [(g[0], o, g[1]) for o, other in enumerate(here) if o != c and len(other) > 1
                              and (g := gap([min(spots), max(spots)], sorted(p for _, p in other))) is not None]
                    if around:
                        _, outer, slot = min(around)
                        counted[host, c, outer, slot] += 1
            if counted:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in counted]), *(pa.array([k[n] for k in counted], pa.int32()) for n in (1, 2, 3)),
                     pa.array(list(counted.values()), pa.int64())], names=["host", "class", "kind", "number", "n"])

    return pages.mapInArrow(work, "host string, class int, kind int, number int, n long").groupBy(
        "host", "class", "kind", "number").agg(F.sum("n").alias("n"))


def templates(found: DataFrame, said: DataFrame) -> DataFrame:
    """The valid, nested classes by host as JSON: classes plus what their pages said."""
    told = said.groupBy("host").agg(F.to_json(F.collect_list(F.struct("class", "kind", "number", "n"))).alias("votes"))
    return found.join(told.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host")).select("host", "classes", "votes")


def valid(known: list[dict], said: list[dict], agreed: float) -> tuple[dict[str, int], dict[int, tuple[int, int]]]:
    """Template tokens with their class, and where each class is nested.

    A token that is out of order on more than 1 - agreed of the pages is
    taken out of its class; a class that is neither the outermost nor in one
    gap on a share of `agreed` of its pages is no part of the template.
    """
    seen = {v["class"]: v["n"] for v in said if v["kind"] == -1}
    astray = {(v["class"], v["number"]) for v in said if v["kind"] == -2 and v["n"] > (1 - agreed) * seen[v["class"]]}
    nested = {v["class"]: (v["kind"], v["number"]) for v in said
              if v["kind"] >= 0 and v["n"] >= agreed * seen[v["class"]]}
    outermost = 0
    return ({t: c for c, one in enumerate(known) if c == outermost or c in nested
             for n, t in enumerate(one["tokens"]) if (c, n) not in astray}, nested)


def main_blocks(page: str | None, template: dict[str, int]) -> list[dict]:
    """Blocks of the slots that hold the article: text and the slot they lie in."""
    pieces = read(page or "")
    found = tokens(pieces)
    of_piece: dict[int, list[bool]] = defaultdict(list)
    slots, slot = {}, -1
    for n, (token, piece) in enumerate(found):
        of_piece[piece].append(token in template)
        if token in template:
            slot = n
        slots[piece] = slot
    listed = [b for b in blocks(pieces) if not b.dropped]
    if not listed:
        return []
    # A block made of template words alone is part of the template. An article may hold such blocks, but
    # where they are most of it the pages are copies; and no page loses all its blocks to the template.
    ends = [*(b.begin for b in listed[1:]), len(pieces)]
    own = [b for b, end in zip(listed, ends, strict=True)
           if not (known := [k for n in range(b.begin, end) if not pieces[n].tag for k in of_piece.get(n, [])]) or not all(known)]
    region = max((b.region for b in own or listed), default=0)
    whole, kept = ([b for b in some if b.region == region] for some in (listed, own))
    if not kept or region and 2 * sum(len(b.text) for b in kept) < sum(len(b.text) for b in whole):
        kept = whole
    return [{"text": b.text, "path": b.path, "slot": slots.get(b.begin, -1)} for b in kept]


def extract(pages: DataFrame, *, least: int = 3, support: float = 0.8, smallest: int = 3, agreed: float = 0.95) -> DataFrame:
    """page_id, url, text, n_chars, slots of every row of `pages` (page_id, url, html).

    `support` is the share of a host's pages that a class must be on,
    `smallest` the tokens it must have. Templates go to the pages by
    broadcast while all of them are small, else by a join on the host.
    """
    hosted = with_host(pages, least)
    found = cut_lineage(classes(hosted, least, support, smallest))

    def to_pages(df: DataFrame) -> DataFrame:
        renamed = df.withColumnRenamed("host", "_host")
        right = near(renamed, sum(F.octet_length(c) for c in renamed.columns))
        return hosted.join(right, F.col("host") == F.col("_host"), "left").drop("_host")

    made = cut_lineage(templates(found, cut_lineage(votes(to_pages(found)))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[str, int]] = {}
        for batch in slices(batches, "html"):
            names = batch.schema.names
            texts, slots = [], []
            for host, page, listed, said in zip(*(batch.column(names.index(c)).to_pylist()
                                                  for c in ("host", "html", "classes", "votes")), strict=True):
                if listed is None or said is None:
                    template = {}
                elif (template := known.get(host)) is None:
                    if len(known) > 1000:
                        known.clear()
                    template = known[host] = valid(json.loads(listed), json.loads(said), agreed)[0]
                kept = main_blocks(page, template)
                texts.append("\n".join(b["text"] for b in kept))
                slots.append([b["slot"] for b in kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("page_id")), batch.column(names.index("url")), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array(slots, pa.list_(pa.int32()))],
                names=["page_id", "url", "text", "n_chars", "slots"])

    kind = dict(pages.dtypes)["page_id"]
    return to_pages(made).mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long, slots array<int>")
