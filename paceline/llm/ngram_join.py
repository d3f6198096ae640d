"""Similarity join of documents on word n-grams, by prefix trees.

Every document is the set of its distinct n-grams, as 64-bit hashes (a document with fewer words has one, its
whole word sequence). Equal sets are one node. Two nodes link if 100 * |A and B| >= threshold * |A or B|.

1. The number of sets with each n-gram is counted over all documents. Blocks of documents send each part of the
   key space their distinct n-grams (40 bits of the hash, delta-coded); the part adds up and answers with a class
   of the count. Sets are ordered globally by (class, hash), rare n-grams first.
2. Linked sets share an n-gram among their first n - ceil(threshold * n) + 1. Only n-grams found in two sets or
   more can be shared, so all others are left out; a set without any is linked with nothing.
3. The sets of one such n-gram meet in a prefix tree that holds what they have of shared n-grams in global
   order. Each set walks the tree, sharing the overlap of common branches, and leaves a subtree when the overlap
   so far and the lengths that remain cannot reach the threshold.
4. The pairs found are confirmed on whole sets, and links are contracted to components.

An n-gram of more than ``HOT`` sets is first linked by comparing all its sets with its most central one (the set
of the commonest n-grams), and only sets of different components then walk its tree, in blocks of ``HOT`` sets
against each other, those of the largest component only against others, so a large group of near copies is neither
expanded into pairs nor met in one task. Where links
are counted, every two sets of one such component are compared as well, whole and in blocks of ``HOT`` against each
other, and only each set's number of links leaves the task.

Nulls, empties and ties: null and empty texts, and texts without words, have no n-grams, are linked with nothing
and are their own component. Copies and repeated rows share a node, whatever their number. A null doc_id counts
as the largest; a component of only such documents has a null component_id. An empty table gives no rows.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import block_rows, expand, forget, in_blocks, partitions, squeeze, stored, unused
from paceline.llm.components import components
from paceline.llm.grams import gram_hashes, in_groups, mix, word_hashes

HOT = 256
KEY_BITS = 40


def sets_of(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in in_groups(texts):
        words, start = word_hashes(texts[a:b])
        for i in range(b - a):
            w = words[start[i] : start[i + 1]]
            if 0 < len(w) < n:
                h = np.uint64(len(w))
                for x in w:
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x)
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.unique(gram_hashes(w, n)))
    return out


def node_of(grams: np.ndarray) -> int:
    """A set's identity: a 64-bit hash of its n-grams and their number."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.add.reduce(mix(grams)) + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


def distinct_sets(texts: list[str], n: int) -> tuple[list[int | None], dict[int, np.ndarray]]:
    """Each text's node (None without n-grams) and the set of every node."""
    nodes: list[int | None] = []
    found: dict[int, np.ndarray] = {}
    for s in sets_of(texts, n):
        node = node_of(s) if len(s) else None
        nodes.append(node)
        if node is not None:
            found.setdefault(node, s)
    return nodes, found


def block_keys(found: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a block's n-grams, sorted, and in how many of its sets each is."""
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([np.unique(s >> np.uint64(64 - KEY_BITS)) for s in found.values()])
    return np.unique(keys, return_counts=True)


def _bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    edges = (np.arange(parts + 1, dtype=np.float64) * (2.0**KEY_BITS / parts)).astype(np.uint64)
    return np.searchsorted(keys, edges)


def pack_keys(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes())


def unpack_keys(data: bytes) -> np.ndarray:
    raw = np.frombuffer(expand(data), np.uint8).reshape(5, -1).T
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :5] = raw
    return np.cumsum(wide.view("<u8")[:, 0], dtype=np.uint64)


def count_classes(dealt: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(block, part, classes): for the sorted keys of a block in a part, 0 if in one set, else by powers of 2**.5."""
    parts = partitions(dealt.sparkSession)

    def send(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        keys, count = block_keys(distinct_sets(list(block_rows(f)["text"]), n)[1])
        at = _bounds(keys, parts)
        rows = [
            (key[0], p, pack_keys(keys[a:b]), squeeze(np.minimum(count[a:b], 65535).astype("<u2").tobytes()))
            for p, (a, b) in enumerate(zip(at[:-1], at[1:]))
            if b > a
        ]
        return pd.DataFrame(rows, columns=["block", "part", "keys", "counts"])

    def answer(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        lists = [unpack_keys(x) for x in f["keys"]]
        counts = np.concatenate([np.frombuffer(expand(x), "<u2") for x in f["counts"]])
        every, place = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(every))
        rank = np.minimum(2 * np.log2(total), 255).astype(np.uint8)[place]
        ends = np.cumsum([len(x) for x in lists])
        data = [squeeze(x.tobytes()) for x in np.split(rank, ends[:-1])]
        return pd.DataFrame({"block": f["block"], "part": f["part"], "classes": data})

    sent = dealt.groupBy("block").applyInPandas(send, "block int, part int, keys binary, counts binary")
    return sent.groupBy("part").applyInPandas(answer, "block int, part int, classes binary"), parts


def ordered_sets(docs: DataFrame, n: int, threshold: int) -> DataFrame:
    """A row for each document: doc_id, text_hash, n_grams, node and, for the first of a node in a block that may have links,
    rest (n-grams past the prefix), central, shared (the prefix n-grams of more than one set, in global order, by
    the upper 32 bits of their hashes; n-grams of one set that agree in these count as part of rest) and grams (the
    whole set)."""
    dealt = in_blocks(docs, hashed=True)
    classes, parts = count_classes(dealt, n)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = block_rows(left)
        nodes, found = distinct_sets(list(left["text"]), n)
        keys, _ = block_keys(found)
        at = _bounds(keys, parts)
        rank = np.zeros(len(keys), np.uint8)
        for p, data in zip(right["part"], right["classes"]):
            rank[at[p] : at[p + 1]] = np.frombuffer(expand(data), np.uint8)
        rows, seen = [], set()
        for doc_id, text_hash, node in zip(left["doc_id"], left["text_hash"], nodes):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            grams = found[node] if node is not None else ()
            row = [doc_id, text_hash, len(grams), node, None, None, None, None]
            if node is not None and node not in seen:
                seen.add(node)
                r = rank[np.searchsorted(keys, grams >> np.uint64(64 - KEY_BITS))]
                order = np.argsort(r, kind="stable")
                size = len(grams) - -(-threshold * len(grams) // 100) + 1
                first = order[:size]
                shared = grams[first[r[first] > 0]]
                if len(shared):
                    brief = (shared >> np.uint64(32)).astype(np.uint32)
                    brief = brief[np.sort(np.unique(brief, return_index=True)[1])]
                    rest = len(grams) - size + len(shared) - len(brief)
                    row[4:] = [rest, float(r.mean()), brief.tobytes(), grams.tobytes()]
            rows.append(row)
        out = pd.DataFrame(rows, columns=["doc_id", "text_hash", "n_grams", "node", "rest", "central", "shared", "grams"])
        for c in ("doc_id", "node", "rest"):
            out[c] = pd.array(out[c].tolist(), dtype="Int64")
        return out

    schema = "doc_id long, text_hash long, n_grams long, node long, rest long, central double, shared binary, grams binary"
    return dealt.groupBy("block").cogroup(classes.groupBy("block")).applyInPandas(run, schema)


def needed(x: int, y: int, threshold: int) -> int:
    """The least overlap of sets of x and y n-grams that links them."""
    return -(-threshold * (x + y) // (100 + threshold))


class PrefixTree:
    """Sets of n-grams in global order as a tree whose edges are runs of n-grams without a branch.

    A tree node is (run, children, sets that end here, least and greatest set size below, greatest rest below,
    greatest number of n-grams from here down). items: (n-grams in order, set size, rest) of each set.
    """

    def __init__(self, items: list[tuple[tuple[int, ...], int, int]], threshold: int):
        self.items, self.threshold = items, threshold
        self.root = self._build(sorted(range(len(items)), key=lambda i: items[i][0]), 0) if items else None

    def _build(self, order: list[int], at: int) -> tuple:
        items = self.items
        one, two = items[order[0]][0], items[order[-1]][0]
        end = at
        while end < len(one) and end < len(two) and one[end] == two[end]:
            end += 1
        ends = [i for i in order if len(items[i][0]) == end]
        children, start = [], len(ends)  # what ends here sorts first
        for k in range(start + 1, len(order) + 1):
            if k == len(order) or items[order[k]][0][end] != items[order[start]][0][end]:
                children.append(self._build(order[start:k], end))
                start = k
        sizes = [items[i][1] for i in order]
        deep = max(len(items[i][0]) for i in order) - at
        return frozenset(one[at:end]), children, ends, min(sizes), max(sizes), max(items[i][2] for i in order), deep

    def search(self, size: int, rest: int, grams: frozenset[int]) -> Iterator[int]:
        """Sets whose overlap with the given one, with what remains of both, can reach the threshold."""
        t = self.threshold
        stack = [(self.root, 0)] if self.root else []
        while stack:
            (run, children, ends, low, high, most_rest, deep), overlap = stack.pop()
            if 100 * high < t * size or 100 * size < t * low:
                continue
            if overlap + deep + max(rest, most_rest) < needed(size, max(low, -(-t * size // 100)), t):
                continue
            overlap += len(run & grams)
            for i in ends:
                _, other, other_rest = self.items[i]
                if 100 * min(size, other) >= t * max(size, other):
                    if overlap + max(rest, other_rest) >= needed(size, other, t):
                        yield i
            stack += [(c, overlap) for c in children]


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    one, two = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"{c}_grams")) for c in "ab")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for x, y in zip(f["a_grams"], f["b_grams"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= threshold * (len(both) - common))
            yield f.loc[keep, ["a", "b"]]

    return pairs.join(one, "a").join(two, "b").mapInPandas(run, "a long, b long")


def may_link(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose sizes and shared prefixes leave a link possible."""
    names = ("n_grams", "rest", "shared")
    one, two = (sets.select(F.col("node").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in names]) for c in "ab")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for x, y, m, k, r, s in zip(f["a_shared"], f["b_shared"], f["a_n_grams"], f["b_n_grams"], f["a_rest"], f["b_rest"]):
                common = len(np.intersect1d(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), True))
                keep.append(common + max(r, s) >= needed(int(m), int(k), threshold))
            yield f.loc[keep, ["a", "b"]]

    near = f"100 * least(a_n_grams, b_n_grams) >= {threshold} * greatest(a_n_grams, b_n_grams)"
    return pairs.join(one, "a").join(two, "b").where(near).mapInPandas(run, "a long, b long")


def walk_trees(rows: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Distinct candidate pairs (a < b) of different components among the sets of each shared n-gram.

    rows: gram, node, component. The sets of an n-gram that more than HOT sets have are dealt into blocks of about HOT,
    those of its largest component apart from the others; two blocks meet in a task of their own unless both are of
    that component. So a large group that is one component costs a row for each set and block of others.
    """
    by = rows.groupBy("gram", "component").agg(F.count("*").alias("n"))
    shape = by.groupBy("gram").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"))
    big = F.col("n") > HOT
    cuts = lambda n: F.greatest(F.ceil(n / HOT), F.lit(1)).cast("int")
    shape = shape.select(
        "gram", F.when(big, F.col("top.component")).alias("base"), F.when(big, cuts(F.col("n") - F.col("top.n"))).otherwise(1).alias("others"),
        F.when(big, cuts(F.col("top.n"))).otherwise(0).alias("bases"),
    )
    spread = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    in_base = F.coalesce(F.col("component") == F.col("base"), F.lit(False))
    own = F.when(in_base, F.col("others") + spread(F.col("bases"))).otherwise(spread(F.col("others")))
    last = F.when(in_base, F.col("others")).otherwise(F.col("others") + F.col("bases")) - 1
    placed = rows.join(shape, "gram").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    met = placed.select("gram", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "component")
    full = met.join(sets.select("node", "n_grams", "rest", "shared"), "node")
    keys = ["gram", "low", "high"]
    sorted_ = full.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    columns = ["gram", "low", "high", "node", "component", "own", "n_grams", "rest", "shared"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for f in frames:
            pairs: list[tuple[int, int]] = []
            for row in zip(*[f[c].tolist() for c in columns]):
                if row[:3] != key:
                    pairs += pairs_of(held, key, threshold)
                    key, held = row[:3], []
                held.append(row[3:])
            yield pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(pairs_of(held, key, threshold), columns=["a", "b"], dtype="int64")

    return sorted_.select(*columns).mapInPandas(run, "a long, b long").distinct()


def pairs_of(held: list[tuple], key: tuple | None, threshold: int) -> list[tuple[int, int]]:
    """Candidate pairs of different components among the sets of one n-gram: (node, component, own block, size, rest,
    shared n-grams).

    A pair is found only at the first n-gram that the set of the lesser node shares with the other, so what stands
    before the n-gram can't be shared and the tree holds only what follows."""
    if len(held) < 2 or len({x[1] for x in held}) < 2:
        return []
    gram, one_block = key[0], key[1] == key[2]
    lists = [tuple(np.frombuffer(x[5], np.uint32).tolist()) for x in held]
    cut = [g.index(gram) for g in lists]
    heads = [frozenset(g[:k]) for g, k in zip(lists, cut)]
    if all(cut) and frozenset.intersection(*heads):
        return []
    tree = PrefixTree([(g[k:], x[3], x[4]) for g, k, x in zip(lists, cut, held)], threshold)
    out = []
    for (node, component, own, size, rest, _), g in zip(held, lists):
        grams = frozenset(g)
        for j in tree.search(size, rest, grams):
            other = held[j]
            if other[0] < node and other[1] != component and (one_block or other[2] != own) and heads[j].isdisjoint(grams):
                out.append((other[0], node))
    return out


def count_inside(labels: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """node, n_links: a node's links to others of its component, added up for each two blocks of about HOT sets.

    labels: node, component. Every two sets of a component meet once, so no pair is stored or counted twice.
    """
    size = labels.groupBy("component").agg(F.ceil(F.count("*") / HOT).cast("int").alias("cuts"))
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    met = labels.join(size, "component").withColumn("own", own).withColumn("other", other).select(
        "component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node"
    )
    full = met.join(sets.select("node", "grams"), "node")
    keys = ["component", "low", "high"]
    sorted_ = full.repartition(partitions(labels.sparkSession), *keys).sortWithinPartitions(*keys)
    columns = [*keys, "own", "node", "grams"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for f in frames:
            counts: list[tuple[int, int]] = []
            for row in zip(*[f[c].tolist() for c in columns]):
                if row[:3] != key:
                    counts += links_of(held, key, threshold)
                    key, held = row[:3], []
                held.append(row[3:])
            yield pd.DataFrame(counts, columns=["node", "n_links"], dtype="int64")
        yield pd.DataFrame(links_of(held, key, threshold), columns=["node", "n_links"], dtype="int64")

    return sorted_.select(*columns).mapInPandas(run, "node long, n_links long")


def links_of(held: list[tuple], key: tuple | None, threshold: int) -> list[tuple[int, int]]:
    """(node, links) of sets (own block, node, n-grams) that link: with each other if the key's blocks are one, else
    with sets of the other block."""
    if len(held) < 2:
        return []
    lists = [np.frombuffer(x[2], np.uint64) for x in held]
    size = np.array([len(x) for x in lists])
    _, column, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    row, often = np.repeat(np.arange(len(held)), size), count > 1
    kept = often[column]  # an n-gram of one set is in no overlap
    row, column = row[kept], (np.cumsum(often) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    own = np.array([x[0] for x in held])
    one, two = np.flatnonzero(own == key[1]), np.flatnonzero(own == key[2])
    common = np.zeros((len(one), len(two)))
    for start in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        has = np.zeros((len(held), 4096), np.float32)
        has[row[a:b], column[a:b] - start] = 1
        common += has[one] @ has[two].T
    link = 100 * common >= threshold * (size[one][:, None] + size[two][None, :] - common)
    if key[1] == key[2]:
        np.fill_diagonal(link, False)
        degree = link.sum(axis=1)
    else:
        degree = np.zeros(len(held), np.int64)
        degree[one], degree[two] = link.sum(axis=1), link.sum(axis=0)
    return [(x[1], int(n)) for x, n in zip(held, degree) if n]


def linked(docs: DataFrame, n: int, threshold: int, counted: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Every document (doc_id, text_hash, n_shingles, node, group: the smallest node reachable, null without
    n-grams) and, if counted, the confirmed links of each node that has any (node, n_links)."""
    whole = stored(ordered_sets(docs, n, threshold), "sets")
    every = stored(whole.select("doc_id", "text_hash", "n_grams", "node"), "documents")
    held = whole.where("shared is not null").groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("n_grams", "rest", "central", "shared", "grams")]
    )
    sets = stored(held, "nodes")
    forget(whole)
    rows = stored(_shared_rows(sets), "shared")
    size = rows.groupBy("gram").agg(F.count("*").alias("n"), F.max(F.struct("central", "node")).alias("top"))
    met = stored(size.where("n > 1"), "met")
    rows = stored(rows.join(met.select("gram"), "gram", "left_semi").select("gram", "node"), "shared")
    hot = stored(met.where(f"n > {HOT}"), "hot")
    star = rows.join(hot.select("gram", F.col("top.node").alias("pivot")), "gram").where("node <> pivot")
    near = star.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = stored(confirm(may_link(near, sets, threshold), sets, threshold), "links")
    labels = stored(components(links), "labels")
    inside = stored(count_inside(labels, sets, threshold), "inside") if counted else None
    every_label = sets.select("node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = rows.join(stored(every_label, "labels"), "node")
    found = stored(found.select("gram", "node", "component"), "shared")
    apart = found.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    found = found.join(stored(apart.select("gram"), "apart"), "gram", "left_semi")
    pairs = stored(walk_trees(found, sets, threshold), "pairs")
    across = stored(confirm(pairs, sets, threshold), "links")
    links = links.union(across)
    label = components(links).select("node", F.col("component").alias("group"))
    keyed = every.select("doc_id", "text_hash", F.col("n_grams").alias("n_shingles"), "node")
    grouped = keyed.join(label, "node", "left").withColumn("group", F.coalesce("group", "node"))
    grouped = stored(grouped, "grouped")
    forget(every, sets, pairs)
    if not counted:
        return grouped, None
    one = F.lit(1).cast("long").alias("n_links")
    ends = across.select(F.col("a").alias("node"), one).union(across.select("b", one)).union(inside)
    return grouped, ends.groupBy("node").agg(F.sum("n_links").alias("n_links"))


def join(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, node and n_links (confirmed links of the node to other nodes) of every
    document; linked texts share a component_id."""
    grouped, degree = linked(docs, n, threshold, counted=True)
    least = grouped.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    degree = stored(degree, "degree")
    out = grouped.join(stored(least, "least"), "group", "left").join(degree, "node", "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def _shared_rows(sets: DataFrame) -> DataFrame:
    """gram, node, central: a row for each n-gram in a set's shared prefix."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            lists = [np.frombuffer(x, np.uint32).astype(np.int64) for x in f["shared"]]
            n = [len(x) for x in lists]
            if n:
                yield pd.DataFrame({"gram": np.concatenate(lists), "node": np.repeat(f["node"].to_numpy(), n), "central": np.repeat(f["central"].to_numpy(), n)})

    return sets.select("node", "central", "shared").mapInPandas(run, "gram long, node long, central double")


def keep_one(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """One document of each component, the one of least doc_id, with all columns of docs. Documents without words
    all stay; rows of equal doc_id and text stay once."""
    grouped, _ = linked(docs, n, threshold)
    lead = grouped.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"))
    lead = lead.select("x.*").union(grouped.where("group is null").select("doc_id", "text_hash")).distinct()
    one, two, three = unused(docs.columns, "lead_id", "lead_hash", "own_hash")
    lead = stored(lead.toDF(one, two), "leads")
    keyed = docs.withColumn(three, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(one)) & (F.col(three) == F.col(two))
    return keyed.join(lead, same, "left_semi").dropDuplicates(["doc_id", three]).drop(three)
