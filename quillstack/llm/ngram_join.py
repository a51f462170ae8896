"""Exact Jaccard self-join of word shingle sets, by set relations.

Words are `[^\\x20\\x09-\\x0D]+` after A-Z is lower-cased; a set holds a document's distinct five-word shingles as 64-bit
hashes, or the whole sequence as one shingle if it is shorter. Two sets link when 100 * intersection >= 80 * union.

1.  Equal sets form a class; only its smallest document goes on. A copy's answers are its class's answers.
2.  Sets are ordered from rare to frequent shingles (the most frequent ones are counted, the rest rank as rare; any
    order gives the same links) and their prefixes go to index lists, one for each shingle.
3.  In each list the first set of each size class leads. Every set is compared with the leader that it shares most
    prefix shingles with. Sets that link with it become its followers, with their distance from it.
4.  Lists of up to LONG sets give their pairs of different components; these are few in any case. On longer lists come
    rounds, until they join next to nothing more, in which each component of links tries a few pairs with leaders drawn
    anew from its lists, so that large groups of near copies grow together without all their pairs. Lists that still
    hold two components or more are then cut into blocks by position, and pairs of blocks are skipped as a whole when no
    pair in them can reach the overlap that its sizes call for, or when all is in one component already.
5.  Answers of followers are derived from those of leaders: overlap of two leaders bounds, by the triangle inequality
    for Jaccard distances, the overlap of their followers. Only pairs that this leaves open are compared.

Defined results: null or empty text, or text without words, has an empty set and links with nothing; rows with a null
doc_id link with nothing and have a null component_id; repeated rows share a class; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Save, room, save
from .textbytes import Spans, mix, pieces, utf8

WORDS = 5
FREQUENT = 100_000  # rows of the table of the most frequent shingles
BUFFER = 1 << 21  # shingles that are counted together before the shuffle
SMALL_IDS = 500_000  # up to so many ids (8 MB) are broadcast to pick texts; beyond, a shuffled join does it
SMALL_PAIRS = 300_000  # so are up to so many pairs (20 MB)
SHARE = 2_000  # pairs of one leader that are compared in one task
SUBLIST = 20_000  # a list of a shingle with more sets is read in sublists of about so many
BLOCK = 32
LONG = 48
ROUNDS = 8
PAYS = 2_000  # rounds go on while they link one in so many sets
TRIES = 16  # pairs that a component tries in a round
FACTORS = (mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each document, end to end, and the offsets of the documents in them."""
    rows = len(offs) - 1
    body = FOLD[data[offs[0] : offs[-1]]]
    edge = offs - offs[0]
    solid = ~SPACE[body]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    cut = np.unique(edge[(edge > 0) & (edge < len(body))])
    begins[cut] = solid[cut]
    ends[cut - 1] = solid[cut - 1]
    at, to = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    word = Spans(body).of(at, to) if len(at) else np.zeros(0, np.uint64)
    first = np.searchsorted(at, edge)
    count = np.diff(first)
    doc = np.repeat(np.arange(rows), count)
    k = len(word) - width + 1
    hashes, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if k > 0:
        inside = doc[:k] == doc[width - 1 :]
        total = np.zeros(k, np.uint64)
        for j in range(width):
            total += word[j : j + k] * FACTORS[j]
        hashes, of = mix(total[inside]), doc[:k][inside]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = [mix((word[first[d] : first[d + 1]] * FACTORS[: count[d]]).sum(keepdims=True) + np.uint64(count[d]))[0] for d in short]
        hashes, of = np.append(hashes, np.array(whole, np.uint64)), np.append(of, short)
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
    bounds = np.searchsorted(of, np.arange(rows + 1))
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        hashes[lo:hi].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[fresh], np.searchsorted(of[fresh], np.arange(rows + 1))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def profiles(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, n, sig_a, sig_b), and rows (shingle, hits) for shingles that are frequent nearby."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        seen: set[int] = set()  # signatures in the buffer; of exact copies only one counts there

        def frequent() -> tuple[np.ndarray, np.ndarray]:
            every = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, int)
            hits = np.diff(np.append(first, len(every)))
            return every[first[hits >= 2]], hits[hits >= 2]

        def rows(ids: pa.Array, n: np.ndarray, a: np.ndarray, b: np.ndarray, shingle: np.ndarray, hits: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(shingle), pa.int64())
            blank = pa.nulls(len(n), pa.int64())
            columns = [(ids, none), (pa.array(n), none), (pa.array(a.view(np.int64)), none), (pa.array(b.view(np.int64)), none), (blank, pa.array(shingle.view(np.int64))), (blank, pa.array(hits.astype(np.int64)))]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in columns], ["doc_id", "n", "sig_a", "sig_b", "shingle", "hits"])

        for batch in batches:
            data, offs = utf8(batch.column(1))
            for lo, hi in pieces(offs):
                hashes, bounds = shingle_sets(data, offs[lo : hi + 1])
                a, b = sums(mix(hashes + FACTORS[5]), bounds), sums(mix(hashes * FACTORS[6]), bounds)
                fresh = np.zeros(hi - lo, bool)
                fresh[np.unique(a, return_index=True)[1]] = True
                fresh &= np.array([x not in seen for x in a.tolist()], bool)
                seen.update(a[fresh].tolist())
                own = hashes[np.repeat(fresh, np.diff(bounds))]
                held.append(own)
                size += len(own)
                found = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if size >= BUFFER:
                    found = frequent()
                    held, size, seen = [], 0, set()
                yield rows(batch.column(0).slice(lo, hi - lo), np.diff(bounds), a, b, *found)
        shingle, hits = frequent()
        empty = np.zeros(0, np.int64)
        yield rows(pa.nulls(0, pa.int64()), empty, empty, empty, shingle, hits)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, sig_a long, sig_b long, shingle long, hits long")


def needed(n):  # noqa: ANN001, ANN201
    """The least overlap with any linked set."""
    return (80 * n + 99) // 100


def prefixes(docs: DataFrame, frequent: np.ndarray, hits: np.ndarray) -> DataFrame:
    """(doc_id, n, prefix, part): the rarest shingles of each set, rarest first, and the sublists that they go to.

    frequent: hashes, from the least frequent on; hits: how often. Lists of over SUBLIST sets have sublists from 1 on.
    """
    order = np.argsort(frequent)
    known, rank, parts = frequent[order], order + 1, np.where(hits > SUBLIST, hits // SUBLIST + 1, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            dealt = mix(batch.column(0).to_numpy().view(np.uint64))
            for lo, hi in pieces(offs):
                hashes, bounds = shingle_sets(data, offs[lo : hi + 1])
                at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                high = np.where(known[at] == hashes, rank[at], 0) if len(known) else np.zeros(len(hashes), int)
                n = np.diff(bounds)
                length = np.where(n > 0, n - needed(n) + 1, 0)
                out, ranks = [], []
                for d in range(hi - lo):
                    part, own = high[bounds[d] : bounds[d + 1]], hashes[bounds[d] : bounds[d + 1]]
                    first = np.argsort(part, kind="stable")[: length[d]]  # rare ones are in the order of their hashes
                    out.append(own[first])
                    ranks.append(part[first])
                flat, of = np.concatenate(out).view(np.int64), np.concatenate(ranks)
                many = parts[np.maximum(of, 1) - 1] * (of > 0) if len(parts) else np.zeros(len(of), int)
                sub = np.where(many > 0, np.repeat(dealt[lo:hi], length) % np.maximum(many, 1).astype(np.uint64) + np.uint64(1), np.uint64(0))
                ends = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64))) for x in (flat, sub)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), *lists], ["doc_id", "n", "prefix", "part"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(run, "doc_id long, n long, prefix array<long>, part array<long>")


def listed(postings: DataFrame) -> DataFrame:
    """Keeps postings of lists with two or more sets, each with the leader of its size class in the list.

    The rows of a list, or of a sublist of a long one, come one after another, by size; only the last row and the leader
    are held between batches.
    """
    names = ["shingle", "part", "n", "doc_id", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row before, its leader, and whether it has gone out
        for batch in batches:
            if not batch.num_rows:
                continue
            s, t, n, d, p = (batch.column(x).to_numpy() for x in names)
            if last:
                s, t, n, d, p = (np.append(np.array([x], np.int64), y) for x, y in zip(last[:5], (s, t, n, d, p)))
            grade = np.floor(np.log(n) / np.log(1.25) + 1e-9)
            same = (s[1:] == s[:-1]) & (t[1:] == t[:-1])
            head = np.append([True], ~same | (grade[1:] != grade[:-1]))
            of = np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))
            lead = [x[of] for x in (d, n, p)]
            if last:
                mine = of == 0
                for x, y in zip(lead, last[5]):
                    x[mine] = y
            out = np.append(same, False) | np.append([False], same) | (t > 0)
            done = bool(last and last[6])
            if done:
                out[0] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (s, d, n, p, *lead)], ["shingle", "doc_id", "n", "pos", "leader", "leader_n", "leader_pos"])
            last = (s[-1], t[-1], n[-1], d[-1], p[-1], [x[-1] for x in lead], bool(out[-1]) or (len(s) == 1 and done))

    sorted_ = postings.repartition("shingle", "part").sortWithinPartitions("shingle", "part", "n", "doc_id")
    return sorted_.select(*names).mapInArrow(run, "shingle long, doc_id long, n long, pos long, leader long, leader_n long, leader_pos long")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents among ids (distinct)."""
    few = ids.limit(SMALL_IDS + 1).count() <= SMALL_IDS
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def compare(pairs: DataFrame, pool: DataFrame, size: int) -> DataFrame:
    """`size` pairs (a, b), a <> b -> distinct (a, b, n_a, n_b, overlap), from texts (doc_id, text).

    Each set of a pair travels once, to a share of b's pairs; a leader of many has many shares. Of several sets under one
    doc_id the most similar ones count.
    """
    wanted = pairs.select("a", "b", F.lit(0).cast("long").alias("share"))
    if size > SHARE:
        many = pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
        wanted = pairs.select("a", "b").join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), "shares").alias("share"))
    lead = wanted.select(F.col("b").alias("doc_id"), "b", "share").distinct().withColumn("a", F.lit(None).cast("long"))
    trips = wanted.select(F.col("a").alias("doc_id"), "b", "share", "a").union(lead.select("doc_id", "b", "share", "a"))
    names = ["a", "b", "n_a", "n_b", "overlap"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(3))
            for lo, hi in pieces(offs):
                hashes, bounds = shingle_sets(data, offs[lo : hi + 1])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(3)), lists], ["b", "share", "a", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders: list[np.ndarray] = []  # the sets of the current b, whose rows come first
        at: int | None = None
        best: tuple | None = None  # of the current pair
        for batch in batches:
            flat, bounds = batch.column(3).values.to_numpy().view(np.uint64), batch.column(3).offsets.to_numpy()
            a, b = batch.column(2).to_pylist(), batch.column(0).to_pylist()
            out: list[tuple] = []
            for i in range(batch.num_rows):
                own = flat[bounds[i] : bounds[i + 1]]
                if a[i] is None:
                    leaders = [*(leaders if at == b[i] else []), own.copy()]
                    at = b[i]
                    continue
                at = None
                for leader in leaders:
                    x, y = (own, leader) if len(own) <= len(leader) else (leader, own)
                    place = np.searchsorted(y, x)
                    place[place == len(y)] = 0
                    new = (a[i], b[i], len(own), len(leader), int(np.count_nonzero(y[place] == x)) if len(y) else 0)
                    if best and best[:2] == new[:2]:
                        if new[4] * (best[2] + best[3] - best[4]) > best[4] * (new[2] + new[3] - new[4]):
                            best = new
                        continue
                    if best:
                        out.append(best)
                    best = new
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in best], names)

    met = pool.join(F.broadcast(trips) if size <= SMALL_PAIRS else trips, "doc_id").select("b", "share", "a", "text").mapInArrow(sets, "b long, share long, a long, members array<long>")
    dealt = met.repartition("b", "share").sortWithinPartitions("b", "share", F.asc_nulls_first("a"))
    return dealt.mapInArrow(run, "a long, b long, n_a long, n_b long, overlap long")


LINKED = "100 * overlap >= 80 * (n_a + n_b - overlap)"
APART = "1 - overlap / (n_a + n_b - overlap)"
#: An overlap of {0} at most can link sets of {1} and {2} shingles.
REACHABLE = "9 * {0} >= 4 * ({1} + {2})"
#: So can {0} common shingles of both prefixes: of the set whose prefix ends first, the rest of its prefix isn't in the
#: other set. {1} and {2}: the sizes.
ENOUGH = "{0} + (80 * greatest({1}, {2}) + 99) div 100 - 1 >= (4 * ({1} + {2}) + 8) div 9"
#: Sizes that can link.
ALIKE = "5 * {0} >= 4 * {1} and 5 * {1} >= 4 * {0}"


def relabelled(rows: DataFrame, joined: DataFrame | None) -> DataFrame:
    """Rows after components have become parts of others: joined (component, whole)."""
    if joined is None:
        return rows
    return rows.join(joined, "component", "left").withColumn("component", F.coalesce("whole", "component")).select(rows.columns)


def bridged(label: DataFrame, links: DataFrame, keep: Save) -> DataFrame:
    """(component, whole), for components that become parts of others by links (a, b) of label (doc_id, component).

    Only components go through the rounds.
    """
    bridges = links.select("a", "b").join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").where("ca <> cb")
    return components(bridges.select(F.col("ca").alias("a"), F.col("cb").alias("b")), keep).toDF("component", "whole").where("component <> whole")


def tries(entries: DataFrame, turn: int) -> DataFrame:
    """Up to TRIES pairs (a, b) of each component, with the leaders of lists, drawn anew by hash each turn.

    Every other turn draws among the sets with the fewest rare shingles before the list's one: these lie in the middle of
    a group of near copies. Rows grow with the entries of open lists, whatever the size of a group.
    """
    grade = F.floor(F.log("n") / float(np.log(1.25)) + 0.5 * (turn // 2 % 2) + 1e-9).alias("grade")
    own = entries.select("shingle", grade, "doc_id", "component", "n", "rest")
    draw = F.pmod(F.xxhash64("doc_id", "shingle", F.lit(turn)), F.lit(1 << 56))
    if turn % 2 == 0:
        draw += (25 - F.floor(F.col("rest") * 25 / F.col("n"))) * (1 << 56)
    lead = own.groupBy("shingle", "grade").agg(*[F.min_by(c, draw).alias(f"lead_{c}") for c in ("doc_id", "component", "n", "rest")], F.min("component").alias("x"), F.max("component").alias("y"))
    met = own.join(lead.where("x <> y").drop("x", "y"), ["shingle", "grade"])
    met = met.where("component <> lead_component and " + ALIKE.format("n", "lead_n") + " and " + REACHABLE.format("least(rest, lead_rest)", "n", "lead_n"))
    met = met.groupBy("component", "doc_id", "lead_doc_id").agg(F.count("*").alias("shared"))
    pairs = met.select("component", "shared", F.least("doc_id", "lead_doc_id").alias("a"), F.greatest("doc_id", "lead_doc_id").alias("b"))
    weight = F.col("shared") * (1 << 40) + F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))  # a tie would try one more pair
    slot = F.pmod(F.xxhash64("a", "b", F.lit(turn)), F.lit(TRIES)).alias("slot")
    best = pairs.groupBy("component", slot).agg(F.max_by("a", weight).alias("a"), F.max_by("b", weight).alias("b"))
    return best.select("a", "b").where("a <> b")


ITEM = "struct(doc_id, component, rest, n, far, leader)"
FITS = "x.component <> y.component and " + ALIKE.format("x.n", "y.n")
PAIR = "struct(least(x.doc_id, y.doc_id) as a, greatest(x.doc_id, y.doc_id) as b, if(x.doc_id < y.doc_id, x, y) as x, if(x.doc_id < y.doc_id, y, x) as y)"


def ends() -> list[Column]:
    return [F.min("component").alias("c"), F.max("component").alias("d")]


def pairs_of(left: str, right: str, also: str) -> Column:
    return F.expr(f"inline(flatten(transform({left}, x -> transform(filter({right}, y -> {FITS} and {also}), y -> {PAIR}))))")


def short_pairs(short: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of different components that meet in lists of up to LONG sets and may link.

    All their common lists count, and as many of long lists as both are in (`longs`).
    """
    lists = short.groupBy("shingle").agg(F.collect_list(F.expr("struct(doc_id, component, n, longs)")).alias("items"), *ends()).where("c <> d")
    met = lists.select(pairs_of("items", "items", "x.doc_id < y.doc_id"))
    met = met.groupBy("a", "b").agg((F.count("*") + F.least(F.max("x.longs"), F.max("y.longs"))).alias("shared"), F.max("x.n").alias("n"), F.max("y.n").alias("m"), F.min("x.n").alias("least_n"), F.min("y.n").alias("least_m"))
    # several sets under one doc_id: its largest size raises the bound, its least one the need
    return met.where("n <> least_n or m <> least_m or " + ENOUGH.format("shared", "n", "m")).select("a", "b")


def long_pairs(long: DataFrame) -> DataFrame:
    """Pairs (a, b, far_a, far_b, lead_a, lead_b) of different components that meet in a long list and may link.

    A list is cut into blocks of about BLOCK sets of like size and like rest behind their position; pairs of blocks that
    can't reach the overlap, or hold one component only, are skipped whole.
    """
    mixed = long.groupBy("shingle").agg(*ends()).where("c <> d").select("shingle")
    placed = long.join(mixed, "shingle", "left_semi").withColumn("grade", F.floor(F.log("n") / float(np.log(1.12)))).withColumn("tier", F.floor(F.col("rest") * 25 / F.col("n")))
    largest = placed.groupBy("shingle", "component").count().groupBy("shingle").agg(F.max_by("component", "count").alias("main"))
    placed = placed.join(largest, "shingle").withColumn("main", F.col("component") == F.col("main"))
    size = placed.groupBy("shingle", "grade", "tier", "main").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = placed.join(size, ["shingle", "grade", "tier", "main"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))
    blocks = placed.groupBy("shingle", "grade", "tier", "main", "block")
    blocks = blocks.agg(F.collect_list(F.expr(ITEM)).alias("items"), F.max("rest").alias("rest"), F.min("n").alias("lo"), F.max("n").alias("hi"), *ends())
    left = blocks.selectExpr("shingle", "struct(grade, tier, main, block) as key", "items", "rest", "lo", "hi", "c", "d")
    right = left.toDF("shingle", *[f"{x}_b" for x in left.columns[1:]])
    open_ = "key <= key_b and (c <> d or c_b <> d_b or c <> c_b) and 5 * hi >= 4 * lo_b and 5 * hi_b >= 4 * lo and " + REACHABLE.format("least(rest, rest_b)", "lo", "lo_b")
    met = left.join(right, "shingle").where(open_).select(pairs_of("items", "items_b", REACHABLE.format("least(x.rest, y.rest)", "x.n", "y.n") + " and (key < key_b or x.doc_id < y.doc_id)"))
    return met.groupBy("a", "b").agg(F.min("x.far").alias("far_a"), F.min("y.far").alias("far_b"), F.min("x.leader").alias("lead_a"), F.min("y.leader").alias("lead_b"))


def derived(pairs: DataFrame, known: DataFrame, pool: DataFrame, keep: Save) -> DataFrame:
    """The links among pairs: those of their leaders are computed first; the others only where these leave them open."""
    leads = pairs.where("lead_a <> lead_b").select(F.least("lead_a", "lead_b").alias("a"), F.greatest("lead_a", "lead_b").alias("b")).distinct()
    leads = keep(leads.join(known, ["a", "b"], "left_anti"), "leads")
    answers = keep(compare(leads, pool, leads.count()), "answers")
    apart = answers.where(f"not ({LINKED})").select(F.col("a").alias("low"), F.col("b").alias("high"), F.expr(APART).alias("apart"))
    unsure = pairs.withColumn("low", F.least("lead_a", "lead_b")).withColumn("high", F.greatest("lead_a", "lead_b")).join(apart, ["low", "high"], "left")
    unsure = keep(unsure.where("apart is null or apart - far_a - far_b <= 0.2 + 1e-9").select("a", "b").join(answers.select("a", "b"), ["a", "b"], "left_anti"), "unsure")
    late = keep(compare(unsure, pool, unsure.count()), "late")
    return answers.where(LINKED).select("a", "b").union(late.where(LINKED).select("a", "b"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: the smallest doc_id that it reaches over links.

    Rows with a null doc_id have a null component_id. The tables between the steps are removed at the end.
    """
    with room(docs.sparkSession) as keep:
        return save(_components(docs, keep), "jaccard")


def _components(docs: DataFrame, keep: Save) -> DataFrame:
    rows = keep(profiles(docs), "profiles")
    counted = rows.where("shingle is not null").groupBy("shingle").agg(F.sum("hits").alias("hits"))
    top = counted.orderBy(F.desc("hits"), "shingle").limit(FREQUENT).toPandas()[::-1]  # at most FREQUENT rows
    frequent, hits = top["shingle"].to_numpy(np.int64).copy().view(np.uint64), top["hits"].to_numpy(np.int64)
    rows = rows.where("shingle is null").select("doc_id", "n", "sig_a", "sig_b")
    sig = ["n", "sig_a", "sig_b"]
    classes = rows.where("n > 0 and doc_id is not null").groupBy(*sig).agg(F.min("doc_id").alias("rep"))
    classed = keep(rows.join(classes, sig, "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "classes")
    copies = classed.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and(F.expr("doc_id <> rep")).alias("copy")).where("copy").select("doc_id")

    prefix = prefixes(docs, frequent, hits).where("n > 0").join(copies, "doc_id", "left_anti")
    postings = prefix.select("doc_id", "n", F.posexplode(F.arrays_zip("prefix", "part")).alias("pos", "p"))
    lists = keep(listed(postings.select(F.col("p.prefix").alias("shingle"), F.col("p.part").alias("part"), "n", "doc_id", F.col("pos").cast("long").alias("pos"))), "lists")

    stars = lists.where("doc_id <> leader and " + ALIKE.format("n", "leader_n") + " and " + REACHABLE.format("least(n - pos, leader_n - leader_pos)", "n", "leader_n"))
    stars = stars.groupBy("doc_id", "leader").agg(F.count("*").alias("shared"), F.max("n").alias("n"), F.max("leader_n").alias("leader_n")).where(ENOUGH.format("shared", "n", "leader_n"))
    stars = keep(stars.groupBy("doc_id").agg(F.max_by("leader", F.col("shared") * 1024 + F.pmod(F.xxhash64("leader"), F.lit(1024))).alias("leader")).toDF("a", "b"), "stars")
    ids = keep(lists.select("doc_id").distinct(), "ids")
    sized = ids.count()
    pool = keep(texts_of(docs, ids), "texts")
    tested = keep(compare(stars, pool, stars.count()), "tested")
    linked = tested.where(LINKED).select(F.col("a").alias("doc_id"), F.col("b").alias("leader"), F.expr(APART).alias("far"))
    follows = linked.join(linked.select(F.col("leader").alias("doc_id")).distinct(), "doc_id", "left_anti")  # a leader follows nobody
    first = components(linked.select(F.col("doc_id").alias("a"), F.col("leader").alias("b")), keep)
    member = ids.join(follows, "doc_id", "left").join(first.toDF("doc_id", "component"), "doc_id", "left")
    member = keep(member.select("doc_id", F.coalesce("leader", "doc_id").alias("leader"), F.coalesce("far", F.lit(0.0)).alias("far"), F.coalesce("component", "doc_id").alias("component")), "members")
    label = member.select("doc_id", "component")

    lists = lists.select("shingle", "doc_id", "n", (F.col("n") - F.col("pos")).alias("rest"))
    longs = keep(lists.groupBy("shingle").count().where(F.col("count") > LONG).select("shingle"), "longs")
    long = keep(lists.join(longs, "shingle", "left_semi").join(member, "doc_id"), "long")
    wide = keep(long.groupBy("doc_id").agg(F.count("*").alias("longs")), "wide")
    sized = wide.count()
    known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    short = lists.join(longs, "shingle", "left_anti").join(member.join(wide, "doc_id", "left").na.fill({"longs": 0}), "doc_id")
    near = keep(short_pairs(short).join(known, ["a", "b"], "left_anti"), "pairs")
    got = keep(compare(near, pool, near.count()), "tested")
    known = known.union(got.select("a", "b"))
    merged = keep(bridged(label, got.where(LINKED), keep), "merged")  # (component, whole): what has become of the first components
    for turn in range(ROUNDS if sized else 0):
        best = keep(tries(relabelled(long, merged), turn), "tries")
        many = best.count()
        if not many:
            break
        got = keep(compare(best, pool, many), "tested")
        known = known.union(got.select("a", "b"))
        links = got.where(LINKED)
        fresh = links.count()
        if fresh:
            joined = bridged(relabelled(label, merged), links, keep)
            before = merged.join(joined.toDF("whole", "now"), "whole", "left").select("component", F.coalesce("now", "whole").alias("whole"))
            merged = keep(before.union(joined), "merged")
        if fresh * PAYS < sized:
            break

    member = keep(relabelled(member, merged), "members")
    label = member.select("doc_id", "component")
    far = keep(long_pairs(relabelled(long, merged)).join(known, ["a", "b"], "left_anti"), "pairs")
    whole = label if far.isEmpty() else relabelled(label, bridged(label, derived(far, known, pool, keep), keep))
    out = classed.join(whole.withColumnRenamed("doc_id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
