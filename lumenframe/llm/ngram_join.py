"""N-gram Jaccard join: near-duplicate components by a prefix-tree join of shingle sets.

A document's set is its distinct shingles of n lower-cased words (a shorter
text is one shingle).  Two link when their sets' Jaccard similarity is at
least percent / 100.

1. Equal sets form a class; its least doc_id stands for it.
2. Shingles have one global order: unique first, then repeated, then frequent
   (by a merged sketch, so that any task orders alike), then by fingerprint.
   Linked sets share one of the first |s| - ceil(percent * |s| / 100) + 1
   shingles of each, and in the smaller set it is even one of the first |s| -
   ceil(2 * percent * |s| / (100 + percent)) + 1, the early ones; unique
   shingles can't be it and aren't sent.  Sizes fall into bands so wide that
   linked sets are in one band or in neighbouring ones: for each prefix shingle
   a set is tied to the least set that has it early, in its own band and in the
   band below, if such a set can be small enough and not too small for a link.
3. Components of these ties hold every link.  One of at most BLOCK shingles is
   joined by one task.  In a larger one, first each set meets its leader (the
   least it is tied to) and other sets of that leader, in blocks: near copies
   are connected by this already.  Then only prefix shingles whose sets are not
   all connected remain; the sets of each are joined by blocks and pairs of
   blocks, those of equal members once, and only sets that have the shingle
   early are stored.  So work follows candidates, and a large group of near
   copies costs what it has rows, not its pairs.
4. A task stores one block's sets in a trie, the commonest shingles first, so
   that sets share paths.  Each set of the other block walks down: the overlap
   with a path is counted once for all sets below it; a subtree ends where the
   overlap, with what is left of the path and of the walking set, can't reach
   the bound, or where all sets below are already connected with the walker.
   Only links that join two components are returned, so a group of copies
   gives as many rows as copies, never all pairs.

Null and wordless texts: an empty set, linked with nothing.  Rows without
doc_id: in no component (null).  Rows that share a doc_id are one document in
the links: each row has its own set and n_shingles, and all of them are in the
one component that their sets' links reach.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import LOWER, SPACE, U, WORDS, is_crowded, join_unique, longs, mix, own_columns, prefix_sums, save, spans, text_slices, windows, word_bounds, word_hashes
from lumenframe.llm.components import components
from lumenframe.llm.copies import once
from lumenframe.llm.repeats import each_window
from lumenframe.llm.sketch import BITS, counted, members, releasing

WORDS_PER_SHINGLE, PERCENT, FREQUENT = 4, 85, 32
BLOCK, PER_SET = 240_000, 100  # shingles in a block, each set counting as so many more


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the distinct shingles of each row, sorted within the row, and how many come before each row."""
    data = LOWER[data]
    starts, ends, bounds = word_bounds(data, offsets, SPACE)
    sums = prefix_sums(word_hashes(data, starts, ends), WORDS)
    counts = np.diff(bounds)
    at = windows(len(starts), bounds, n)
    row = np.searchsorted(bounds, at, "right") - 1
    short = np.flatnonzero((counts > 0) & (counts < n))
    values = np.concatenate([spans(sums, at, at + n, WORDS), spans(sums, bounds[short], bounds[short] + counts[short], WORDS)])
    row = np.concatenate([row, short])
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    if len(values):
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (row[1:] != row[:-1])])
        values, row = values[new], row[new]
    return values, np.searchsorted(row, np.arange(len(offsets)))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def set_classes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and two fingerprints of the whole set."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("doc_id")
            for i, j, data, offsets in text_slices(batch):
                values, bounds = shingles(data, offsets, n)
                one, two = _sums(mix(values), bounds), _sums(mix(values ^ U(0x5851F42D4C957F2D)), bounds)
                yield pa.record_batch([batch.column(at).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["doc_id", "n_shingles", "one", "two"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, one long, two long")


def prefix_rows(docs: DataFrame, n: int, percent: int, bits: int) -> DataFrame:
    """(token, doc, one, n, early): the shingles of each set's prefix that may be in another set; one: the set's fingerprint. Copies of a text have none."""
    docs, _, kept = once(docs, bits)

    def every(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in text_slices(kept(batch)):
            yield shingles(data, offsets, n)[0]

    twice, often = counted(docs, every, ((2, bits), (FREQUENT, bits - 4)))

    def run(batches):
        for batch in map(kept, batches):
            ids = longs(batch, "doc_id")
            for i, j, data, offsets in text_slices(batch):
                values, bounds = shingles(data, offsets, n)
                size = np.diff(bounds)
                row = np.repeat(np.arange(j - i), size)
                rank = twice(values).astype(np.int8)
                rank[rank > 0] += often(values[rank > 0])
                order = np.lexsort((values, rank, row))
                place = np.arange(len(values)) - bounds[row]
                prefix = size - -(-percent * size // 100) + 1
                first = size - -(-2 * percent * size // (100 + percent)) + 1
                chosen = np.flatnonzero((place < prefix[row]) & (rank[order] > 0))
                sent, early = order[chosen], place[chosen] < first[row[chosen]]
                one = _sums(mix(values), bounds).view(np.int64)
                yield pa.record_batch([pa.array(values[sent].view(np.int64)), pa.array(ids[i:j][row[sent]]), pa.array(one[row[sent]]), pa.array(size[row[sent]]), pa.array(early)], names=["token", "doc", "one", "n", "early"])

    return docs.mapInArrow(releasing(run), "token long, doc long, one long, n long, early boolean")


def band(n: str, percent: int) -> Column:
    """Sizes of linked sets are in one band or in neighbouring ones (the factor is beyond rounding)."""
    return F.floor(F.ln(F.col(n)) / (1.0001 * max(math.log(100 / percent), 1e-3)))


def ties(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): b has a prefix shingle in common with a, the least document that has it early, of b's band or of the band below. rows: token, band, doc, n, early."""
    early = lambda c: F.when(F.col("early"), F.col(c))
    zones = save(rows.groupBy("token", "band").agg(F.min(early("doc")).alias("lead"), F.min(early("n")).alias("least"), F.max(early("n")).alias("most"), F.count("*").alias("sets")), "zones")
    found, none = zones.where("lead IS NOT NULL"), F.lit(None).cast("long")
    own = found.select("token", "band", F.col("lead").alias("own"), "least", none.alias("lower"), none.alias("most"))
    below = found.select("token", (F.col("band") + 1).alias("band"), none.alias("own"), none.alias("least"), F.col("lead").alias("lower"), "most")
    leads = own.unionAll(below).groupBy("token", "band").agg(*[F.max(c).alias(c) for c in ("own", "least", "lower", "most")])
    met = join_unique(rows.select("token", "band", "doc", "n"), leads, ["token", "band"], crowded=is_crowded(zones, "sets"))
    lead = F.explode(F.array(F.expr("CASE WHEN least <= n THEN own END"), F.expr(f"CASE WHEN {percent} * n <= 100 * most THEN lower END")))
    return met.select(lead.alias("a"), F.col("doc").alias("b")).where("a <> b").distinct()


# --- the trie -------------------------------------------------------------------------------------------------


class Trie:
    """Ordered sets as paths, nodes with one child merged; leaves are numbered in order of their paths."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.order = np.array(sorted(range(len(sets)), key=lambda d: sets[d].astype(">u4").tobytes()), np.int64)
        self.sizes = sizes[self.order]
        paths = [sets[d] for d in self.order]
        ends = np.array([len(p) for p in paths])
        # (leaf that shows the path, first depth, last depth, first leaf below, parent); a leaf's last depth is its own end
        nodes: list[list[int]] = [[0, 0, 0, 0, -1]]
        closed: list[int] = [len(paths)]
        stack = [0]
        for leaf, path in enumerate(paths):
            shared = 0
            if leaf:
                before = paths[leaf - 1]
                m = min(len(before), len(path))
                different = np.flatnonzero(before[:m] != path[:m])
                shared = int(different[0]) if len(different) else m
            while len(stack) > 1 and nodes[stack[-1]][1] >= shared:
                closed[stack.pop()] = leaf
            top = stack[-1]
            if nodes[top][2] > shared:  # the path leaves within this node: split it
                show, first, last, low, parent = nodes[top]
                nodes.append([show, first, shared, low, parent])
                closed.append(len(paths))
                nodes[top][1], nodes[top][4] = shared, len(nodes) - 1
                closed[top] = leaf
                stack[-1] = len(nodes) - 1
            if len(path) > nodes[stack[-1]][2]:
                nodes.append([leaf, shared, len(path), leaf, stack[-1]])
                closed.append(len(paths))
                stack.append(len(nodes) - 1)
        t = np.array(nodes, np.int64)
        self.show, self.first, self.last, self.low, self.parent = t.T
        self.high = np.array(closed, np.int64)
        start = np.concatenate([[0], np.cumsum(ends)[:-1]])
        self.flat = np.concatenate(paths) if paths else np.zeros(0, np.int64)
        self.edge_start, self.edge_size = start[self.show] + self.first, self.last - self.first
        self.last_token = np.where(self.edge_size > 0, self.flat[np.maximum(start[self.show] + self.last - 1, 0)] if len(self.flat) else 0, -1)
        kids = np.argsort(self.parent, kind="stable")
        self.kids, self.kid_start = kids, np.searchsorted(self.parent[kids], np.arange(len(t) + 1))
        deepest = np.array([ends[a:b].max() if a < b else 0 for a, b in zip(self.low, self.high, strict=True)])
        self.rest, self.smallest = deepest - self.last, np.array([self.sizes[a:b].min() if a < b else 0 for a, b in zip(self.low, self.high, strict=True)])
        self.node_of = np.full(len(paths), 0)
        for node in np.argsort(self.last, kind="stable"):  # the deepest node that ends where the leaf does
            if node and self.low[node] < self.high[node]:
                below = np.arange(self.low[node], self.high[node])
                self.node_of[below[ends[below] == self.last[node]]] = node
        self.ending = np.argsort(self.node_of, kind="stable")
        self.ending_start = np.searchsorted(self.node_of[self.ending], np.arange(len(t) + 1))

    def linked(self, path: np.ndarray, size: int, other: np.ndarray, percent: int, mark: np.ndarray) -> np.ndarray:
        """Sets that link with the given one, of those marked in other (by number of the set); mark: the shingles of path."""
        open_leaves = np.concatenate([[0], np.cumsum(other[self.order])])
        nodes, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(nodes):
            kid_counts = self.kid_start[nodes + 1] - self.kid_start[nodes]
            overlap = np.repeat(overlap, kid_counts)
            nodes = self.kids[each_window(self.kid_start[nodes], kid_counts)]
            live = open_leaves[self.high[nodes]] > open_leaves[self.low[nodes]]
            nodes, overlap = nodes[live], overlap[live]
            if not len(nodes):
                break
            hit = mark[self.flat[each_window(self.edge_start[nodes], self.edge_size[nodes])]]
            overlap = overlap + np.add.reduceat(hit, np.cumsum(self.edge_size[nodes]) - self.edge_size[nodes], dtype=np.int64)
            left = len(path) - np.searchsorted(path, self.last_token[nodes], "right")
            most = overlap + np.minimum(left, self.rest[nodes])
            live = (100 + percent) * most >= percent * (size + self.smallest[nodes])
            nodes, overlap = nodes[live], overlap[live]
            here = self.ending_start[nodes + 1] - self.ending_start[nodes]
            leaves, shared = self.ending[each_window(self.ending_start[nodes], here)], np.repeat(overlap, here)
            found.append(self.order[leaves[(100 + percent) * shared >= percent * (size + self.sizes[leaves])]])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


class Groups:
    """Which sets are connected, by numbers that merge."""

    def __init__(self, of: np.ndarray):
        self.of = of.copy()
        self.members = {int(g): np.flatnonzero(of == g) for g in np.unique(of)} if len(np.unique(of)) < len(of) else {int(g): np.array([i]) for i, g in enumerate(of)}

    def merge(self, a: int, b: int) -> None:
        small, large = sorted((a, b), key=lambda g: len(self.members[g]))
        moved = self.members.pop(small)
        self.of[moved] = large
        self.members[large] = np.concatenate([self.members[large], moved])


def forest(docs: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], stored: np.ndarray, walking: np.ndarray, percent: int, connected: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets that join all linked of them: stored ones are in the trie, walking ones go through it; connected: groups to begin with."""
    values, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, U), np.zeros(0))
    by_count = np.lexsort((values, -counts))
    rank = np.empty(len(values), np.int64)
    rank[by_count] = np.arange(len(values))
    shared = counts > 1
    paths = []
    for s in sets:  # what one set alone has can't overlap
        at = np.searchsorted(values, s)
        paths.append(np.sort(rank[at[shared[at]]]))
    trie = Trie([paths[i] for i in stored], sizes[stored])
    groups, links = Groups(np.unique(docs if connected is None else connected, return_inverse=True)[1]), []
    mark = np.zeros(max(1, len(values)), bool)
    for w in walking:
        other = groups.of[stored] != groups.of[w]
        if not other.any():
            continue
        mark[paths[w]] = True
        for y in stored[trie.linked(paths[w], int(sizes[w]), other, percent, mark)]:
            if groups.of[y] != groups.of[w]:
                groups.merge(int(groups.of[y]), int(groups.of[w]))
                links.append((int(docs[w]), int(docs[y])))
        mark[paths[w]] = False
    return links


def block_links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) from rows (task, low, high, side, stored, doc, n, connected, tokens): sets of side 1, or else of side 0, walk through the stored ones of their task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc", "ascending"), ("n", "ascending")])
        docs, sizes, connected = (table[c].to_numpy() for c in ("doc", "n", "connected"))
        side = table["side"].to_numpy()
        tokens = [np.frombuffer(x, U) for x in table["tokens"].to_pylist()]
        stored = np.flatnonzero(table["stored"].to_numpy())
        walking = np.flatnonzero(side == side.max())
        links = forest(docs, sizes, tokens, stored, walking, percent, connected)
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return sets.groupBy("task", "low", "high").applyInArrow(run, "a long, b long")


def _parts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, `sets` and `parts`: in how many blocks of about BLOCK shingles the sets of each key fit."""
    return rows.groupBy(*keys).agg(F.ceil(F.sum(F.col("n") + PER_SET) / BLOCK).cast("int").alias("parts"), F.count("*").alias("sets"))


def _part(rows: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the block of each set, by its hash."""
    return join_unique(rows, parts.drop("sets"), keys, crowded=is_crowded(parts, "sets")).withColumn("part", F.pmod(F.xxhash64("doc", "one"), F.col("parts")).cast("int"))


def _leader_blocks(inside: DataFrame, tied: DataFrame) -> DataFrame:
    """Each set of a large component with its leader and others of that leader: (doc, one, n, connected, task, low, high, side)."""
    leaders = tied.groupBy(F.col("b").alias("doc")).agg(F.min("a").alias("task"))
    led = inside.join(leaders, "doc", "left").withColumn("task", F.coalesce("task", "doc"))
    parts = save(_parts(led, ["task"]), "parts")
    own = _part(led, parts, ["task"]).select("doc", "one", "n", "task", F.col("part").alias("low"))
    heads = inside.join(parts, inside["doc"] == parts["task"]).select("doc", "one", "n", "task", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("low"))
    return own.unionAll(heads).distinct().select("doc", "one", "n", F.col("doc").alias("connected"), "task", "low", F.col("low").alias("high"), F.lit(0).alias("side"), F.lit(True).alias("stored"))


def _shingle_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Sets under prefix shingles whose sets aren't all connected, by pairs of blocks. rows: token, band, doc, one, n, early, connected."""
    early_n = F.when(F.col("early"), F.col("n"))
    zones = save(rows.groupBy("token").agg(F.min(early_n).alias("least"), F.max(early_n).alias("most"), F.count("*").alias("sets")), "zones")
    crowded = is_crowded(zones, "sets")
    near = join_unique(rows, zones.where("least IS NOT NULL").drop("sets"), ["token"], crowded=crowded)
    rows = save(near.where(f"early OR (least <= n AND {percent} * n <= 100 * most)").drop("least", "most"), "near")
    signed = rows.groupBy("token").agg(
        F.min("connected").alias("c"), F.max("connected").alias("d"), F.count("*").alias("m"), F.sum(F.xxhash64("doc", "one", "early") % (1 << 40)).alias("x"), F.sum(F.xxhash64("one", "early", "doc") % (1 << 40)).alias("y")
    )
    open_tokens = signed.where("c < d").groupBy("m", "x", "y").agg(F.min("token").alias("token")).select("token")  # shingles of equal sets do once
    rows = save(join_unique(rows, open_tokens, ["token"], crowded=crowded), "open")
    parts = save(_parts(rows, ["token", "band"]), "parts")
    rows = save(_part(rows, parts, ["token", "band"]), "open-parts")
    blocks = rows.groupBy("token", "band", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(early_n).alias("early"))
    name = F.struct("band", "part")
    low = blocks.select("token", name.alias("low"), F.col("most").alias("low_most"), F.col("early").alias("low_early"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    high = blocks.select("token", name.alias("high"), F.col("least").alias("high_least"), F.col("early").alias("high_early"), "band")
    # between bands the smaller set, of the lower one, has the shingle early; within a band either may be the smaller
    fits = f"low.band < high.band AND {percent} * high_least <= 100 * low_early OR low.band = high.band AND coalesce(low_early, high_early) IS NOT NULL"
    pairs = low.join(high, ["token", "band"]).where(f"low <= high AND {percent} * high_least <= 100 * low_most AND ({fits})").select("token", "low", "high")
    stored = pairs.select("token", "low", "high", F.col("low").alias("block"), F.lit(0).alias("side"))
    walking = pairs.where("low < high").select("token", "low", "high", F.col("high").alias("block"), F.lit(1).alias("side"))
    each = rows.withColumn("block", name).join(stored.unionAll(walking), ["token", "block"]).where("side = 1 OR early OR low.band = high.band")
    trie = F.expr("side = 0 AND (early OR low <> high)")
    return each.select("doc", "one", "n", "connected", F.col("token").alias("task"), "low", "high", "side", trie.alias("stored"))


def candidate_sets(docs: DataFrame, inside: DataFrame, n: int, bits: int) -> DataFrame:
    """The rows of inside with their sets (tokens), each (doc, one) once."""
    wanted = members(inside, "doc", bits - 2)

    def run(batches):
        for batch in batches:
            ids = longs(batch, "doc_id")
            keep = np.flatnonzero(wanted(mix(ids.view(U))))
            if len(keep):
                part = batch.take(pa.array(keep))
                for i, j, data, offsets in text_slices(part):
                    values, bounds = shingles(data, offsets, n)
                    one = _sums(mix(values), bounds).view(np.int64)
                    sets = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pa.record_batch([pa.array(ids[keep][i:j]), pa.array(one), pa.array(sets, pa.binary())], names=["doc", "one", "tokens"])

    return docs.mapInArrow(releasing(run), "doc long, one long, tokens binary").join(inside, ["doc", "one"]).dropDuplicates(["doc", "one"])


def links(docs: DataFrame, classes: DataFrame, n: int, percent: int, bits: int) -> DataFrame:
    """(a, b): links between class representatives that join all linked classes; classes: (doc, one, n)."""
    rows = prefix_rows(docs, n, percent, bits).withColumn("band", band("n", percent)).join(classes.select("doc", "one"), ["doc", "one"], "left_semi").distinct()
    rows = save(rows, "prefixes")
    tied = save(ties(rows, percent), "ties")
    of = components(tied)
    inside = save(classes.join(of.toDF("doc", "component"), "doc"), "components")
    size = save(_parts(inside, ["component"]), "sizes")
    large = size.select("component", (F.col("parts") > 1).alias("large"))
    inside = save(join_unique(inside, large, ["component"], crowded=is_crowded(size, "sets")), "candidates")
    sets = save(candidate_sets(docs, inside, n, bits), "sets")
    zero = F.lit(0)
    found = block_links(sets.where("NOT large").select("doc", "n", F.col("doc").alias("connected"), F.col("component").alias("task"), zero.alias("low"), zero.alias("high"), zero.alias("side"), F.lit(True).alias("stored"), "tokens"), percent)
    large = inside.where("large").select("doc", "one", "n")
    if large.isEmpty():
        return found
    sets = sets.where("large").select("doc", "one", "tokens")
    near = save(block_links(_leader_blocks(large, tied).join(sets, ["doc", "one"]).drop("one"), percent), "near-links")
    groups = components(near).toDF("doc", "connected")
    connected = large.join(groups, "doc", "left").select("doc", "one", "n", F.coalesce("connected", "doc").alias("connected"))
    left = rows.drop("n").join(connected, ["doc", "one"])
    return found.unionAll(near).unionAll(block_links(_shingle_blocks(left, percent).join(sets, ["doc", "one"]).drop("one"), percent))


def near_duplicates(docs: DataFrame, n: int = WORDS_PER_SHINGLE, percent: int = PERCENT, bits: int = BITS) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id reachable by links, the document itself included."""
    docs = own_columns(docs, "doc_id", "text")
    known = docs.where("doc_id IS NOT NULL")
    rows = save(set_classes(docs, n), "set-names")
    key = ["n_shingles", "one", "two"]
    worded = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = save(worded.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes")
    crowded = is_crowded(classes, "rows")
    # sets that nobody else has, wordless ones too, stand under their own doc_id
    named = join_unique(worded, classes.drop("rows"), key, crowded=crowded).select("doc_id", "n_shingles", "rep")
    named = save(named.unionAll(rows.where("doc_id IS NOT NULL AND n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("rep"))), "named")
    several = save(named.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").select("doc_id", "a"), "several")
    edges = links(known, classes.select(F.col("rep").alias("doc"), "one", F.col("n_shingles").alias("n")), n, percent, bits)
    if not several.isEmpty():  # all sets of a document are in one component
        edges = edges.unionAll(join_unique(named, several, ["doc_id"]).select("a", F.col("rep").alias("b")).distinct())
    found = components(edges).toDF("rep", "component_id")
    out = join_unique(named, found, ["rep"], "left", crowded).select("doc_id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    return out.unionAll(rows.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql(source: str = "documents", n: int = WORDS_PER_SHINGLE, percent: int = PERCENT) -> str:
    """DuckDB SQL of near_duplicates over a table of that name."""
    return rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM {source}
), sets AS (
    SELECT DISTINCT doc_id, array_to_string(w[s + 1:s + {n}], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {n}, 0) + 1)) AS s FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
    SELECT a, b FROM pairs JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * i >= {percent} * (p.n + q.n - i)
), both_ways AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
)
SELECT w.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM words w LEFT JOIN sizes z USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = w.doc_id
"""


ORACLE_SQL = oracle_sql()
