"""N-gram Jaccard join: a blocked sparse product of documents by word shingles, pruned by bounds that follow from sizes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.components import connected_components
from cadenza.operators.joins import join_hot
from cadenza.plans.lineage import discard, store


@dataclass(frozen=True)
class NearCopies:
    """Documents link when 100 * |intersection| >= percent * |union| of their sets of ``k``-word shingles.

    ``block``: rows that one task compares with each other. ``common``: a shingle that begins more than so many
    documents' prefixes counts as common and goes last in the order; at most ``max_common`` are kept in memory for that.
    Neither changes the result. ``send_ids``: up to so many rows are broadcast, of dropped keys, or of candidates
    with each group that they are compared in (8 MB for 52,974 of these); more are joined by shuffle.
    """

    k: int = 5
    percent: int = 80
    block: int = 512
    common: int = 48
    max_common: int = 200_000
    send_ids: int = 1_000_000


MULT = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def prefix_length(n: np.ndarray | int, percent: int):
    """How many of a set's first shingles must be looked at.

    Two linked sets share at least percent of the larger one. With n - (that) + m first shingles of each, whichever of
    the two prefixes ends first holds m shared ones; m is half of what percent leaves, so few shared ones rule a set out.
    """
    return n - (n * percent + 99) // 100 + (n * ((100 - percent) // 2) + 99) // 100


def least_shared(n: Column, percent: int) -> Column:
    """How many shingles of its prefix a set shares with any set it links with: m of the smaller one it may be."""
    return F.greatest(F.lit(1), F.ceil(n * ((100 - percent) // 2) * percent / 10_000 - 1e-9))


def shingle_sets(texts: list[str | None], k: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles, text after text, and the number of each text.

    A shingle is a number of 63 bits: whether it is common, its length (long ones, which are rare, first), and a hash.
    Sorted numbers thus come in the order, common to all texts, in which prefixes are taken. Words are what ASCII white
    space parts, with A-Z lower-cased; a text of fewer than k words is one shingle; one without words is empty.
    """
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.encode("utf-8", "surrogatepass").lower().split() if t else []
        counts[i] = len(w)
        words += w
    if not words:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    size = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(words)) - starts[owner]
    full = place <= counts[owner] - k
    short = (counts[owner] < k) & (place == 0)
    with np.errstate(over="ignore"):
        at = np.flatnonzero(full)
        mixed = np.zeros(len(at), np.uint64)
        length = np.zeros(len(at), np.int64)
        for j in range(k):
            mixed = (mixed ^ h[at + j]) * MULT[j % 8]
            mixed ^= mixed >> np.uint64(29)
            length += size[at + j]
        lone = np.flatnonzero(short)
        extra, extra_size = np.zeros(len(lone), np.uint64), np.zeros(len(lone), np.int64)
        for x, i in enumerate(lone):
            own = words[i : i + counts[owner[i]]]
            extra[x] = int.from_bytes(hashlib.blake2b(b" ".join(own), digest_size=8, person=b"short").digest(), "little")
            extra_size[x] = sum(map(len, own))
    mixed, length = np.concatenate([mixed, extra]), np.concatenate([length, extra_size])
    who = np.concatenate([owner[at], owner[lone]])
    rank = (63 - np.minimum(length // 2, 63)).astype(np.uint64)
    tokens = ((rank << np.uint64(56)) | (mixed >> np.uint64(8))).astype(np.int64)
    if common is not None and len(common):
        spot = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        tokens = np.where(common[spot] == tokens, tokens | np.int64(1 << 62), tokens)
    order = np.lexsort((tokens, who))
    tokens, who = tokens[order], who[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (who[1:] != who[:-1])
    return tokens[new], np.bincount(who[new], minlength=len(texts)).astype(np.int64)


def _slices(batch: pa.RecordBatch, rows: int = 1000, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``rows`` rows whose texts (column 2) start within ``size`` bytes of each other, so that memory goes by bytes, not by rows."""
    starts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + rows, batch.num_rows, int(np.searchsorted(starts, starts[at] + size, "left"))))
        yield batch.slice(at, end - at)
        at = end


def _sets(rows: DataFrame, config: NearCopies, common: np.ndarray | None, whole: bool) -> DataFrame:
    """doc_id, text_id, node (63 bits that name the set; null: empty), n, and tokens: the whole set, or its prefix.

    Copies within a slice of a batch share a node, of which only the first carries tokens; the others have null.
    Columns of ``rows`` after the text follow as they are.
    """
    added = rows.columns[3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in _slices(big):
                flat, n = shingle_sets(batch.column(2).to_pylist(), config.k, common)
                ends = np.cumsum(n)
                plain = flat & ~np.int64(1 << 62)
                name = [None if not c else int.from_bytes(hashlib.blake2b(np.sort(plain[e - c : e]).tobytes(), digest_size=8).digest(), "little") >> 1 for c, e in zip(n, ends)]
                seen: set = set()
                fresh = np.array([x is not None and not (x in seen or seen.add(x)) for x in name], bool)
                take = np.where(fresh, n if whole else prefix_length(n, config.percent), 0)
                mask = np.arange(len(flat)) - np.repeat(ends - n, n) < np.repeat(take, n)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32)), pa.array(flat[mask]), mask=pa.array(~fresh))
                kept = [batch.column(3 + i) for i in range(len(added))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(name, pa.int64()), pa.array(n, pa.int64()), tokens, *kept], names=["doc_id", "text_id", "node", "n", "tokens", *added])

    return rows.mapInArrow(run, ", ".join(["doc_id bigint, text_id bigint, node bigint, n bigint, tokens array<bigint>", *(f"{c} {kind}" for c, kind in rows.dtypes[3:])]))


def _by_node(sets: DataFrame) -> DataFrame:
    """(node, n, tokens) with one row a node: its copies' tokens are the same."""
    return sets.where("tokens is not null and doc_id is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))


def overlaps(a: list[np.ndarray], b: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Intersection sizes of all sets of ``a`` by all of ``b``: a sparse product, block of columns after block.

    Only shingles on both sides make columns; each block is a dense 0/1 matrix of bounded size.
    """
    out = np.zeros((len(a), len(b)), np.int64)
    fa, fb = np.concatenate(a), np.concatenate(b)
    vocab = np.intersect1d(fa, fb)
    if not len(vocab):
        return out
    ra, rb = np.repeat(np.arange(len(a)), list(map(len, a))), np.repeat(np.arange(len(b)), list(map(len, b)))

    def cells(flat, rows):
        spot = np.minimum(np.searchsorted(vocab, flat), len(vocab) - 1)
        hit = vocab[spot] == flat
        order = np.argsort(spot[hit], kind="stable")
        return rows[hit][order], spot[hit][order]

    (rows_a, cols_a), (rows_b, cols_b) = cells(fa, ra), cells(fb, rb)
    for low in range(0, len(vocab), columns):
        part = []
        for rows, cols, n in ((rows_a, cols_a, len(a)), (rows_b, cols_b, len(b))):
            x, y = np.searchsorted(cols, [low, low + columns])
            m = np.zeros((n, min(columns, len(vocab) - low)), np.float32)
            m[rows[x:y], cols[x:y] - low] = 1
            part.append(m)
        out += (part[0] @ part[1].T).astype(np.int64)
    return out


def _linked(inter: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (na[:, None] + nb[None, :] - inter)


def forest(linked: np.ndarray, left: list, right: list) -> list[tuple]:
    """Links that connect what ``linked`` connects, fewer than rows and columns: one per newly reached node."""
    out, n, m = [], len(left), len(right)
    row_left = linked.any(1)
    col_left = linked.any(0)
    while row_left.any():
        i = int(row_left.argmax())
        row_left[i] = False
        rows = [i]
        while rows:
            fresh_cols: list[int] = []
            for r in rows:
                cols = np.flatnonzero(linked[r] & col_left)
                col_left[cols] = False
                out += [(left[r], right[c]) for c in cols]
                fresh_cols += cols.tolist()
            rows = []
            for c in fresh_cols:
                more = np.flatnonzero(linked[:, c] & row_left)
                row_left[more] = False
                out += [(left[r], right[c]) for r in more]
                rows += more.tolist()
    return out


_LINKS = "a bigint, b bigint"


def _link_table(pairs: list[tuple]) -> pa.Table:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _rows(table: pa.Table) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    column = table["tokens"].combine_chunks()
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return table["node"].to_pylist(), sets, np.array(list(map(len, sets)), np.int64)


def _compare(left, right, percent: int, same: bool) -> list[tuple]:
    """Links between two blocks of rows, or within one."""
    (ids_a, sets_a, na), (ids_b, sets_b, nb) = left, right
    if not ids_a or not ids_b:
        return []
    # No pair of these sizes can reach the bound: the smaller set is too small for the larger.
    possible = 100 * np.minimum(na[:, None], nb[None, :]) >= percent * np.maximum(na[:, None], nb[None, :])
    if same:
        possible &= ~np.eye(len(ids_a), dtype=bool)
    keep_a, keep_b = possible.any(1), possible.any(0)
    if not keep_a.any():
        return []
    ia, ib = np.flatnonzero(keep_a), np.flatnonzero(keep_b)
    inter = overlaps([sets_a[i] for i in ia], [sets_b[i] for i in ib])
    good = _linked(inter, na[ia], nb[ib], percent) & possible[np.ix_(ia, ib)]
    return forest(good, [ids_a[i] for i in ia], [ids_b[i] for i in ib])


def _whole_sets(rows: DataFrame, members: DataFrame, known: DataFrame, config: NearCopies) -> DataFrame:
    """(node, tokens, small, large), stored: each node of ``known`` once, with its whole set and its groups.

    One document speaks for each node. Its key takes the groups to the text, so the sets, which are far larger, need
    not be shuffled to find them. ``small`` has leaders of groups of up to ``block``, ``large`` those of others with their members.
    """
    is_small = F.col("members") <= config.block
    groups = known.groupBy("node").agg(F.collect_list(F.when(is_small, F.col("leader"))).alias("small"), F.collect_list(F.when(~is_small, F.struct("leader", "members"))).alias("large"))
    times = members.join(known.select("node").distinct(), "node", "left_semi").groupBy("node", "doc_id", "text_id").agg(F.count(F.lit(1)).alias("times"))
    least = times.groupBy("node").agg(F.min(F.struct("doc_id", "text_id", "times")).alias("s"))
    speaker = store(least.join(groups, "node").select("s.*", "small", "large"))
    side = F.broadcast(speaker) if known.count() <= config.send_ids else speaker

    def sets(which: str) -> DataFrame:
        found = _sets(rows.join(side.where(which), ["doc_id", "text_id"]), config, None, True)
        return found.where("tokens is not null").select("node", "tokens", "small", "large")

    whole = sets("times = 1")
    if not speaker.where("times > 1").isEmpty():
        # Rows that repeat the speaker's carry the same set.
        whole = whole.unionByName(sets("times > 1").groupBy("node").agg(*[F.first(c).alias(c) for c in ("tokens", "small", "large")]))
    whole = store(whole)
    discard(speaker)
    return whole


def _links(known: DataFrame, whole: DataFrame, config: NearCopies) -> tuple[DataFrame, list[DataFrame]]:
    """Links between the nodes of each group of ``known``, and the tables stored for them; ``whole`` has each node's tokens and groups."""
    percent, block = config.percent, config.block
    small = whole.select(F.explode("small").alias("leader"), "node", "tokens")

    def within(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        return _link_table(_compare(rows, rows, percent, True))

    links = small.groupBy("leader").applyInArrow(within, _LINKS)
    if known.where(F.col("members") > block).isEmpty():
        return links, []
    large = whole.select(F.explode("large").alias("group"), "node", "tokens")
    large = store(large.select("group.leader", "node", "group.members", (F.col("node") == F.col("group.leader")).alias("lead"), "tokens"))
    # Large groups first shrink: chunk by chunk all members are compared with the leader. What links with it is one
    # component and needs no comparison within. Distances are a metric, so a member at distance d from the leader
    # can only link with linked members whose own distance is at least d less the link distance.
    parts = F.ceil(F.col("members") / block).cast("int")
    lead = large.where("lead").select("leader", "node", "tokens", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("lead"))
    rest = large.where("not lead").select("leader", "node", "tokens", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), F.lit(False).alias("lead"))

    def to_leader(table: pa.Table) -> pa.Table:
        ids, sets, n = _rows(table)
        is_lead = table["lead"].to_numpy(zero_copy_only=False).astype(bool)
        first = int(is_lead.argmax())
        inter = np.array([np.intersect1d(sets[first], s, assume_unique=True).size for s in sets], np.int64)
        union = n[first] + n - inter
        out = {"leader": table["leader"], "node": table["node"], "n": pa.array(n), "far": pa.array(1 - inter / union), "linked": pa.array(100 * inter >= percent * union)}
        return pa.table(out).filter(pa.array(~is_lead))

    near = stored_near = store(lead.unionByName(rest).groupBy("leader", "part").applyInArrow(to_leader, "leader bigint, node bigint, n bigint, far double, linked boolean"))
    links = links.unionByName(near.where("linked").select(F.col("leader").alias("a"), F.col("node").alias("b")))
    reach = 1 - percent / 100 + 1e-9
    # Linked sets differ in size by less than one step of this scale, so only equal and neighbouring sizes meet.
    near = near.withColumn("size", F.floor(F.log(F.col("n")) / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.col("n").cast("int"))
    counts = store(near.where("not linked").groupBy("leader").agg(F.count(F.lit(1)).alias("n_open"), F.min("far").alias("nearest")))
    tagged = join_hot(near, counts, "leader").where(F.col("n_open").isNotNull() & (~F.col("linked") | (F.col("far") >= F.col("nearest") - reach)))
    # Cells of a group: open members by size and chunk, and linked members by size and salt.
    chunks = F.ceil(F.col("n_open") / block).cast("int")
    tagged = tagged.withColumn("own", F.when(~F.col("linked"), F.pmod(F.xxhash64("node"), chunks).cast("int")).otherwise(-1 - F.pmod(F.xxhash64("node", F.lit(1)), F.lit(64)).cast("int")))
    tagged = store(tagged.select("leader", "node", "size", "own"))
    # Open members meet the open members of their own and later cells; linked members meet every open cell.
    cells = store(tagged.select("leader", "size", "own").distinct())
    other = cells.select("leader", F.col("size").alias("size2"), F.col("own").alias("own2"))
    later = (F.col("own2") < 0) | (F.col("size2") > F.col("size")) | ((F.col("size2") == F.col("size")) & (F.col("own2") >= F.col("own")))
    pairs = cells.where("own >= 0").join(other, "leader").where((F.abs(F.col("size2") - F.col("size")) <= 1) & later)
    one = pairs.join(tagged, ["leader", "size", "own"]).withColumn("side", F.lit(0))
    two = pairs.join(tagged.withColumnsRenamed({"size": "size2", "own": "own2"}), ["leader", "size2", "own2"]).withColumn("side", F.lit(1))
    cell = ["leader", "size", "own", "size2", "own2"]
    both = one.select(*cell, "node", "side").unionByName(two.select(*cell, "node", "side")).join(large.select("leader", "node", "tokens"), ["leader", "node"])

    def across(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        left, right = _rows(table.filter(pa.array(side == 0))), _rows(table.filter(pa.array(side == 1)))
        found = []
        for at in range(0, len(right[0]), block):
            cut = tuple(x[at : at + block] for x in right)
            for up in range(0, len(left[0]), block):
                found += [(a, b) for a, b in _compare(tuple(x[up : up + block] for x in left), cut, percent, False) if a != b]
        return _link_table(found)

    return links.unionByName(both.groupBy(*cell).applyInArrow(across, _LINKS)), [large, stored_near, counts, tagged, cells]


def _grouped(docs: DataFrame, config: NearCopies) -> DataFrame:
    """(doc_id, text_id, node, n, first): a row for each row of ``docs``; first is the least (doc_id, text_id) that links reach, null for a null doc_id or no words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")
    sets = store(_sets(rows, config, None, False))
    members = store(sets.select("doc_id", "text_id", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"), "n"))
    # Stored, small as it is, since that frees its shuffle files: those of collect() would stay on disk to the end.
    counts = store(_by_node(sets).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > config.common))
    common = np.sort(np.array([r["token"] for r in counts.orderBy(F.desc("c"), "token").limit(config.max_common).select("token").collect()], np.int64))
    discard(sets, counts)
    nodes = store(_by_node(_sets(rows, config, common, False)))
    placed, standing = nodes.select("node", F.explode("tokens").alias("token")), None
    for _ in range(2):
        # Shingles of one node only, and nodes that share too few, leave; that may free more.
        shared = placed.join(placed.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token"), "token")
        held = shared.groupBy("node").agg(F.count(F.lit(1)).alias("held")).join(nodes.select("node", "n", F.size("tokens").alias("p")), "node")
        held = held.where(F.col("held") >= least_shared(F.col("n"), config.percent)).select("node", "n", (F.col("p") - F.col("held")).alias("alone"))
        before, standing = standing, store(shared.join(held, "node"))
        if before is not None:
            discard(before)
        placed = standing.select("node", "token")
    discard(nodes)
    leaders = standing.groupBy("token").agg(F.min(F.struct("alone", "n", "node")).alias("l")).select("token", F.col("l.node").alias("leader"))
    every = store(standing.select("token", "node").join(leaders, "token").select("leader", "node").distinct())
    discard(standing)
    sizes = every.groupBy("leader").agg(F.count(F.lit(1)).alias("members"))
    # A group of one has nothing to compare.
    known = store(join_hot(every, sizes, "leader").where("members > 1"))
    discard(every)
    whole = _whole_sets(rows, members, known, config)
    links, scratch = _links(known, whole, config)
    roots = connected_components(links)
    discard(whole, known, *scratch)
    own = members.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_id")).alias("least"))
    linked = store(own.join(roots, "node", "left"))
    firsts = store(linked.where("root is not null").groupBy("root").agg(F.min("least").alias("first")))
    by_node = store(join_hot(linked, firsts, "root").select("node", F.coalesce("first", "least").alias("first")))
    return join_hot(members, by_node, "node")


def near_copy_components(docs: DataFrame, config: NearCopies = NearCopies()) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the least doc_id that links reach.

    1. Documents of one set of shingles are one node, named by a hash of the set. 2. Shingles are ordered, long ones
    first, common ones last (those in many prefixes of a first pass); linked sets share shingles in their prefixes by
    that order, and a bound tells how many, so most nodes drop out. 3. A shingle's nodes meet under one leader: the
    node whose prefix holds the fewest shingles of its own. Nodes with the same leader form a group, and a blocked
    sparse product counts the overlaps within it; sizes and distances to the leader rule out pairs. Tasks return only
    as many links as connect what they found. 4. Components of the links, named by their least doc_id.

    Documents without words link with nothing and keep their own doc_id; a null doc_id has a null component and takes
    no part. Rows are documents: repeated rows are copies of each other, and rows that share a doc_id but differ in
    their sets are different documents, each with its own links. Other columns are ignored.
    """
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id"))
    return _grouped(docs, config).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def drop_near_copies(docs: DataFrame, config: NearCopies = NearCopies()) -> DataFrame:
    """``docs`` with one row of each component: that of its least doc_id (and least text hash, where ids repeat).

    Rows without words, and rows with a null doc_id, are copies of nothing and stay. Repeated rows are copies of each
    other; which of them stays goes by their other columns. Columns stay in their order, whatever their names. Only the
    keys of dropped rows travel: they are broadcast up to ``send_ids`` of them, and joined by shuffle beyond.
    """
    keys = store(_grouped(docs, config).where("first is not null").groupBy("doc_id", "text_id").agg(F.first("first").alias("first"), F.count(F.lit(1)).alias("times")))
    is_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_id") == F.col("first.text_id"))
    gone, again = store(keys.where(~is_first).select("doc_id", "text_id")), store(keys.where(is_first & (F.col("times") > 1)).select("doc_id", "text_id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"))

    def side(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() <= config.send_ids else table

    kept = rows.join(side(gone), ["doc_id", "text_id"], "left_anti")
    if again.isEmpty():
        return kept.select("row.*")
    simple = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant", "array<map", "struct"))]
    one = kept.join(side(again), ["doc_id", "text_id"], "left_semi").groupBy("doc_id", "text_id").agg(F.min_by("row", F.struct(*[F.col("row")[c] for c in simple])).alias("row"))
    return kept.join(side(again), ["doc_id", "text_id"], "left_anti").select("row.*").unionByName(one.select("row.*"))
