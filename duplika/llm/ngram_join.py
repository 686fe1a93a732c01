"""N-gram Jaccard join by prefix trees, with the connected components of the links.

Each document is the set of its distinct word n-grams (64-bit hashes), in one global order: by the count of
the hash's cell in a sketch over all texts, so that common n-grams come last, then by the hash. Two sets
with enough in common share an n-gram among the first ``n - ceil(t n) + 1`` of each, the prefix.

1. Sets that are equal are one class from here on.
2. Prefix n-grams that two classes share are the first branches of the trees: each has the list of the classes that
   hold it, with the place where it stands in each.
3. Two sets whose first common n-gram stands at places p and q have no more in common than ``min(n - p, m - q)``, what
   still comes from there on. A class stays in a list only if one of another component there, of some size, can
   reach the overlap needed by that bound (``within_reach``). Lists of at most ``SHORT`` classes are looked at whole; of longer
   ones the bounds are aggregated by size, so a long list is never gathered.
4. In a round each class goes to one block of its longest list, with the class that has the n-gram earliest as a
   guest of all blocks of the list. Families of near copies contract to one component, and step 3 is repeated. Lists that
   are still beyond a block's size then have a few rounds more.
5. Then each list is a block; lists of the same classes are one, and lists beyond the bounded size of a block are dealt to
   a triangle of blocks, the exact way for families that are dense and yet not linked. Trees of the sets' beginnings tell
   which sets may link in a block, and only these come whole.
6. In a block the sets go into a prefix tree, where sets with the same beginning share a path. A probe walks the tree
   once, carrying the overlap of the path, and leaves a subtree when the elements still to come, in the probe or
   the subtree, cannot reach the overlap needed. All links come from there. Nothing is dropped, and no pairs leave a
   block but the links that join components.
7. The links' connected components are named by their smallest doc_id.

Cases: null counts as empty text; a text with fewer words than n is one n-gram of all its words; without words the
set is empty and links with nothing; equal rows share a component; doc_id names a document, so of rows that share one but
differ in text the text of one stands for it in links; rows with a null doc_id come back with a null component
and link nothing; an empty table gives no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, buffers, drop, list_parts, lists, lower_ascii, mix, powers, row_bounds, run_hashes, schema, slices, stage, whole_text, word_hashes, word_spans, workdir, _WORD
from ..operators.graph import components

N, PERCENT = 5, 75
SETS = schema("doc_id long, n_shingles long, sig_a long, sig_b long, prefix array<long>")
ORDERED = schema("doc_id long, elements array<long>")
BLOCKS = schema("token long, i int, j int, doc_id long, component long")
LINKS = schema("a long, b long")
SKETCH_BITS, _PARTS = 20, 16
#: Sets that meet in a block of the last step and of a round, and their n-grams in all.
CELL, ROUND_CELL, CELL_GRAMS = 256, 64, 1 << 20
#: Lists of so many classes are looked at whole.
SHORT = 64


# --- sets -----------------------------------------------------------------------


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text, in order of place, and the texts' offsets."""
    raw, offsets = buffers(texts)
    raw = lower_ascii(raw)
    starts, ends, rows = word_spans(raw, offsets)
    words, bound = word_hashes(raw, starts, ends), row_bounds(rows, len(texts))
    grams = run_hashes(words, n)
    inside = rows[: grams.size] == rows[n - 1 :] if grams.size else np.zeros(0, bool)
    count = np.diff(bound)
    short = np.flatnonzero((count > 0) & (count < n))
    if not short.size:
        size = np.maximum(count - n + 1, 0)
        return grams[inside], np.r_[0, np.cumsum(size)]
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    edge = np.r_[0, np.cumsum(size)]
    out = np.empty(int(edge[-1]), U64)
    is_short = np.zeros(out.size, bool)
    is_short[edge[short]] = True
    out[~is_short] = grams[inside]
    for i in short.tolist():
        own = words[bound[i] : bound[i + 1]]
        out[edge[i]] = mix(np.array([(own * powers(_WORD, own.size)).sum(dtype=U64) + U64(own.size << 32)], U64))[0]
    return out, edge


def _count(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in slices(batches):
            grams, _ = shingles(batch.column("text"), n)
            np.add(total, np.bincount((grams >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=total.size), out=total, casting="unsafe")
        packed = [pa.compress(part.tobytes(), "zstd", asbytes=True) for part in np.split(total, _PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_PARTS, dtype=np.int32)), pa.array(packed, pa.binary())], ["part", "cells"])

    return run


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << SKETCH_BITS) // _PARTS, np.int64)
    for batch in batches:
        for cells in batch.column("cells"):
            total += np.frombuffer(pa.decompress(cells.as_py(), total.size * 4, "zstd"), np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "cells"])


def count_sketch(texts: DataFrame, n: int) -> np.ndarray:
    """Occurrences of n-grams by the top bits of their hashes, over all texts; 2 ** SKETCH_BITS cells."""
    kind = "part int, cells binary"
    rows = texts.select("text").mapInArrow(_count(n), kind).groupBy("part").applyInArrow(_add, kind).collect()
    out = np.zeros((_PARTS, (1 << SKETCH_BITS) // _PARTS), np.int64)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["cells"], np.int64)
    # The order needs no more than these: larger counts are equal.
    return np.minimum(out.ravel(), 2**31 - 1).astype(np.int32)


def in_order(grams: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Distinct elements in the global order."""
    own = np.unique(grams)
    return own[np.argsort(sketch[(own >> U64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")]


def prefix_size(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + 1) if n else 0


def _signatures(sets: list[np.ndarray]) -> list[pa.Array]:
    """128 bits that tell sets apart."""
    a, b = [s.sum(dtype=U64) for s in sets], [mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64) for s in sets]
    return [pa.array(np.array(x, U64).view(np.int64)) for x in (a, b)]


def _column(sets: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    return lists(flat.view(np.int64), np.cumsum([0, *(s.size for s in sets)]), pa.int64())


def _sets(held, n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = held.value
        for batch in slices(batches):
            grams, edge = shingles(batch.column("text"), n)
            sets = [in_order(grams[i:j], sketch) for i, j in zip(edge.tolist(), edge[1:].tolist())]
            sizes = pa.array(np.array([s.size for s in sets], np.int64))
            heads = _column([s[: prefix_size(s.size, percent)] for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, *_signatures(sets), heads], SETS.names)

    return run


def _ordered(held, n: int):
    """Whole sets of the texts that have the signature asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = held.value
        for batch in slices(batches):
            grams, edge = shingles(batch.column("text"), n)
            sets = [in_order(grams[i:j], sketch) for i, j in zip(edge.tolist(), edge[1:].tolist())]
            right = np.logical_and.reduce([own.to_numpy() == batch.column(c).to_numpy() for own, c in zip(_signatures(sets), ("sig_a", "sig_b"))])
            own = [s for s, r in zip(sets, right.tolist()) if r]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pa.array(right)), _column(own)], ORDERED.names)

    return run


# --- the prefix tree --------------------------------------------------------------


class PrefixTree:
    """Ordered sets (arrays of ranks, ascending) with shared beginnings stored once.

    A set may be given by its first elements alone; ``total`` holds the whole sizes. A node holds a run of ranks, the
    sets that end there, and for its subtree the smallest whole size and the most elements after the run.
    """

    def __init__(self, sets: list[np.ndarray], total: np.ndarray):
        self.run, self.ends, self.children, self.least, self.most = [], [], [], [], []
        self.sets, self.total = sets, total
        self.roots: list[int] = []
        work = [(sorted((i for i in range(len(sets)) if sets[i].size), key=lambda i: sets[i].astype(">u4").tobytes()), 0, self.roots)]
        while work:  # without recursion: a tree is as deep as its longest set
            held, at, into = work.pop()
            i = 0
            while i < len(held):
                first, j = sets[held[i]], i + 1
                while j < len(held) and sets[held[j]][at] == first[at]:
                    j += 1
                last = sets[held[j - 1]]
                m = min(first.size, last.size)
                differ = np.flatnonzero(first[at:m] != last[at:m])
                end = at + int(differ[0]) if differ.size else m
                node = len(self.run)
                self.run.append(first[at:end])
                self.ends.append([x for x in held[i:j] if sets[x].size == end])
                self.children.append([])
                self.least.append(min(int(total[x]) for x in held[i:j]))
                self.most.append(max(int(total[x]) for x in held[i:j]) - end)
                into.append(node)
                rest = [x for x in held[i:j] if sets[x].size > end]
                if rest:
                    work.append((rest, end, self.children[node]))
                i = j

    def probe(self, member: np.ndarray, ranks: np.ndarray, n: int, percent: int) -> Iterator[int]:
        """Sets that reach ``percent`` similarity with the probe, or may do so where sets are given in part.

        ``member`` tells for each rank if the probe is known to have it; ``n`` is the probe's whole size.
        """
        work = [(r, 0) for r in self.roots]
        while work:
            node, overlap = work.pop()
            run = self.run[node]
            overlap += int(member[run].sum())
            for i in self.ends[node]:
                # Up to the smaller last rank both sides are known; of the rest, no more than either has can agree.
                known = min(ranks[-1], run[-1])
                mine, other = n - int(np.searchsorted(ranks, known, "right")), int(self.total[i]) - int(np.searchsorted(self.sets[i], known, "right"))
                if (100 + percent) * (overlap + min(mine, other)) >= percent * (n + int(self.total[i])):
                    yield i
            to_come = n - int(np.searchsorted(ranks, run[-1], "right"))
            if (100 + percent) * (overlap + min(to_come, self.most[node])) >= percent * (n + self.least[node]):
                work.extend((c, overlap) for c in self.children[node])


class _Union:
    """Components met in a block."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, c: int) -> int:
        self.parent.setdefault(c, c)
        while self.parent[c] != c:
            self.parent[c] = self.parent[self.parent[c]]
            c = self.parent[c]
        return c

    def join(self, a: int, b: int) -> None:
        self.parent[max(a, b)] = min(a, b)


def _ranked(sets: list[np.ndarray], order_key) -> tuple[list[np.ndarray], np.ndarray]:
    """Sets as ranks in the global order among the block's elements, and these elements."""
    every = order_key(np.concatenate(sets))
    by_value = np.argsort(every)
    held = every[by_value]
    return [np.sort(by_value[np.searchsorted(held, s)]) for s in sets], every


def block_links(ids: np.ndarray, component: np.ndarray, sets: list[np.ndarray], order_key, percent: int) -> list[tuple[int, int]]:
    """Links among the whole sets of a block that join different components; no more than span them."""
    apart = np.unique(component).size
    if apart < 2:
        return []
    ranks, every = _ranked(sets, order_key)
    tree, member, union, links = PrefixTree(ranks, np.array([r.size for r in ranks])), np.zeros(every.size, bool), _Union(), []
    for i, own in enumerate(ranks):
        member[own] = True
        for j in tree.probe(member, own, own.size, percent):
            a, b = union.root(int(component[i])), union.root(int(component[j]))
            if a != b:
                union.join(a, b)
                links.append((int(ids[i]), int(ids[j])))
        member[own] = False
        if len(links) == apart - 1:  # one component
            break
    return links


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with one (token, i, j) in a stream sorted by it; a block's rows are bounded."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("token", "i", "j")])
        cut = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, batch.num_rows]
        for a, b in zip(cut.tolist(), cut[1:].tolist()):
            now = tuple(key[:, a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _lists_of(table: pa.Table, column: str, kind) -> list[np.ndarray]:
    flat, edge = list_parts(table.column(column).combine_chunks())
    return [flat[a:b].view(kind) for a, b in zip(edge.tolist(), edge[1:].tolist())]


def may_link(component: np.ndarray, n: np.ndarray, heads: list[np.ndarray], order_key, percent: int, mask: int) -> np.ndarray:
    """Which sets of a block, given by their beginnings, may link with one of another component there.

    A pair that several blocks hold is left to the one with the list of its first common n-gram; ``mask`` has the
    bits of the n-grams whose lists the block stands for.
    """
    found = np.zeros(n.size, bool)
    ranks, every = _ranked(heads, order_key)
    bit = (U64(mask) >> (every & U64(63))) & U64(1) != 0
    tree, member = PrefixTree(ranks, n), np.zeros(every.size, bool)
    for i, own in enumerate(ranks):
        member[own] = True
        for j in tree.probe(member, own, int(n[i]), percent):
            if component[i] != component[j] and bit[ranks[j][member[ranks[j]].argmax()]]:
                found[i] = found[j] = True
        member[own] = False
    return found


def _survive(held, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            heads = _lists_of(cell, "head", U64)
            mask = cell.column("mask")[0].as_py() & (1 << 64) - 1
            alive = may_link(cell.column("component").to_numpy(), cell.column("n").to_numpy(), heads, lambda x: in_order(x, held.value), percent, mask)
            if alive.any():
                yield from cell.filter(pa.array(alive)).select(BLOCKS.names).combine_chunks().to_batches()

    return run


def _join_block(held, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            links = block_links(
                cell.column("doc_id").to_numpy(), cell.column("component").to_numpy(), _lists_of(cell, "elements", U64), lambda x: in_order(x, held.value), percent
            )
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    return run


# --- the join -----------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame, n: int = N, percent: int = PERCENT, cell: int = CELL, round_cell: int = ROUND_CELL, rounds: int = 4, folder: str | None = None
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row."""
    spark = docs.sparkSession
    home = folder or workdir(spark)
    folder = f"{home}/work"
    texts = whole_text(docs)
    held = spark.sparkContext.broadcast(count_sketch(texts, n))  # 4 MB
    sets = stage(texts.mapInArrow(_sets(held, n, percent), SETS), folder, "sets")
    full = sets.where("n_shingles > 0 and doc_id is not null")
    classes = stage(full.groupBy("sig_a", "sig_b", "n_shingles").agg(F.min("doc_id").alias("head")), folder, "classes")
    # A class speaks through its smallest doc_id; of classes with one doc_id (rows that differ in text) one speaks.
    voices = classes.groupBy(F.col("head").alias("doc_id")).agg(F.max(F.struct("sig_a", "sig_b", "n_shingles")).alias("v")).select("doc_id", "v.*")
    voices = stage(voices, folder, "voices")
    index = stage(_index(full.join(voices.hint("merge"), voices.columns, "left_semi")), folder, "index")

    found = spark.createDataFrame([], LINKS)
    alive = stage(within_reach(index.withColumn("component", F.col("doc_id")), percent), folder, "alive")
    drop(spark, f"{folder}/index")
    # The sets of what the lists hold, whole and in order. What grows with the corpus is never broadcast, however small it is.
    wanted = voices.join(alive.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "sig_a", "sig_b")
    whole = texts.join(wanted.hint("merge"), "doc_id").dropDuplicates(["doc_id", "text"])
    elements = stage(whole.mapInArrow(_ordered(held, n), ORDERED), folder, "elements")
    for i in range(rounds):
        if alive.isEmpty():
            break
        todo = alive.join(long, "token", "left_semi") if i else alive
        links = stage(_linked(_one_block_each(todo, i, round_cell), elements, held, percent), folder, f"links_{i}")
        if links.isEmpty():
            break
        found = found.unionByName(links)
        near = stage(components(found, folder, f"near_{i}"), folder, f"near_map_{i}")
        named = alive.drop("component").join(near, alive.doc_id == near.node, "left")
        named = named.withColumn("component", F.coalesce("component", "doc_id")).select(alive.columns)
        alive = stage(within_reach(named, percent), folder, f"alive_{i}")
        long = stage(alive.groupBy("token").count().where(F.col("count") > cell).select("token"), folder, f"long_{i}")
        if long.isEmpty():
            break
    heads = elements.select("doc_id", F.size("elements").cast("long").alias("n"), "elements")
    heads = heads.select("doc_id", "n", F.expr(f"slice(elements, 1, n - ({percent} * n + 99) div 100 + 1 + n div 20)").alias("head"))
    some = stage(_dealt(_blocks(alive, cell).join(heads.hint("merge"), "doc_id")).mapInArrow(_survive(held, percent), BLOCKS), folder, "some")
    links = stage(_linked(some, elements, held, percent), folder, "links")
    last = stage(components(found.unionByName(links), folder, "last"), folder, "last_map")
    named = classes.join(last, classes["head"] == last.node, "left").select("sig_a", "sig_b", "n_shingles", F.coalesce("component", "head").alias("component_id"))
    base = sets.select("doc_id", "n_shingles", "sig_a", "sig_b").join(named, ["sig_a", "sig_b", "n_shingles"], "left")
    named_rows = base.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    out = stage(named_rows, home, "components")
    drop(spark, folder)
    return out


def _index(sets: DataFrame) -> DataFrame:
    """``token, doc_id, n, pos, listed, shared``: the prefix n-grams that two rows or more hold.

    ``listed`` is the number of rows that hold the n-gram, ``shared`` the number of such n-grams of the row's document.
    """
    tokens = sets.select("doc_id", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    shared = sets.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("listed")).where("listed > 1")
    held = F.collect_list(F.struct("token", "pos", "listed")).alias("held")
    both = tokens.join(shared.hint("merge"), "token").groupBy("doc_id", "n").agg(held)
    return both.select("doc_id", "n", F.size("held").alias("shared"), F.explode("held").alias("h")).select("h.token", "doc_id", "n", "h.pos", "h.listed", "shared")


def within_reach(named: DataFrame, percent: int) -> DataFrame:
    """Rows of (token, doc_id, n, pos, listed, shared, component) whose list holds one of another component in reach.

    Sets of sizes n and m that meet at places p and q first can link only if
    ``(100 + percent) min(n - p, m - q) >= percent (n + m)``: each one's own bound is the largest size that its
    partner may have, and both sizes must be within the other's bound. Of the two, the one whose prefix ends first misses
    no more of the overlap than the elements after its prefix, so both have at least the rest among their shared n-grams;
    this is asked in short lists. Of a long list each row meets, by size, the largest
    bound and the largest bound of another component. Sizes beyond 512 go in steps of a 256th or less, with the
    least size of a step. ``listed`` bounds the length of the list.
    """
    rows = named.withColumn("bound", F.expr(f"({100 + percent} * (n - pos)) div {percent} - n"))
    own = F.struct(*[c for c in rows.columns if c != "token"])
    short = rows.where(F.col("listed") <= SHORT).groupBy("token").agg(F.collect_list(own).alias("list"))
    least = f"({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent} - ({percent} * greatest(x.n, y.n) + 99) div 100 + 1"
    pair = f"y.component <> x.component and y.n <= x.bound and x.n <= y.bound and least(x.shared, y.shared) >= {least}"
    near = f"filter(list, x -> exists(list, y -> {pair}))"
    short = short.select("token", F.explode(F.expr(near)).alias("x")).select("token", "x.*").select(named.columns)

    unit = F.pow(F.lit(2), F.greatest(F.floor(F.log2("n")) - 8, F.lit(0))).cast("long")
    rows = rows.where(F.col("listed") > SHORT).withColumn("size", F.col("n") - F.col("n") % unit)
    top = rows.groupBy("token", "size").agg(F.min("n").alias("least"), F.max(F.struct("bound", "component")).alias("top"))
    other = rows.join(top, ["token", "size"]).where("component <> top.component").groupBy("token", "size").agg(F.max("bound").alias("other"))
    sizes = top.join(other, ["token", "size"], "left").select("token", F.struct("least", "top", F.coalesce("other", F.lit(-1)).alias("other")).alias("s"))
    sizes = sizes.groupBy("token").agg(F.collect_list("s").alias("sizes"))
    in_reach = F.expr("exists(sizes, s -> s.least <= bound and if(s.top.component = component, s.other, s.top.bound) >= n)")
    return short.unionByName(rows.join(sizes, "token").where(in_reach).select(named.columns))


def _parts(cell: int) -> Column:
    """Blocks that a list of m sets and ``grams`` n-grams is dealt to."""
    return F.greatest(F.ceil(F.col("m") / cell), F.ceil(F.col("grams") / CELL_GRAMS)).cast("int")


def _one_block_each(alive: DataFrame, seed: int, cell: int) -> DataFrame:
    """``token, i, j, doc_id, component``: each class in one block of its longest list, beside a guest of all the list's blocks."""
    size = alive.groupBy("token").agg(F.count("*").alias("m"), F.sum("n").alias("grams"), F.min(F.struct("pos", "doc_id", "component")).alias("guest"))
    best = alive.join(size.withColumn("parts", _parts(cell)), "token").groupBy("doc_id", "component")
    best = best.agg(F.max(F.struct("m", "token", "parts", "guest")).alias("best")).select("doc_id", "component", "best.*")
    best = best.withColumn("i", F.pmod(F.xxhash64("doc_id", F.lit(seed)), "parts").cast("int"))
    guests = best.select("token", "i", F.col("guest.doc_id").alias("doc_id"), F.col("guest.component").alias("component"))
    return best.select("token", "i", "doc_id", "component").unionByName(guests).distinct().withColumn("j", F.lit(0))


def _blocks(alive: DataFrame, cell: int) -> DataFrame:
    """``token, i, j, doc_id, component, mask``: every list as a block; a list beyond a block's size as blocks of two parts each.

    Lists of the same classes are one block; ``mask`` has a bit of 64 for each of their n-grams.
    """
    size = alive.groupBy("token").agg(F.count("*").alias("m"), F.sum("n").alias("grams"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("same"))
    mask = F.bit_or(F.expr("shiftleft(1L, cast(token & 63 as int))")).alias("mask")
    once = size.groupBy("same", "m", "grams").agg(F.min("token").alias("token"), mask).select("token", "mask", _parts(cell).alias("parts"))
    rows = alive.join(once, "token").withColumn("own", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    small = rows.where("parts = 1").select("token", F.lit(0).alias("i"), F.lit(0).alias("j"), "doc_id", "component", "mask")
    long = rows.where("parts > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    long = long.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "component", "mask")
    return small.unionByName(long)


def _linked(blocks: DataFrame, elements: DataFrame, held, percent: int) -> DataFrame:
    """Links between components within blocks, by prefix trees."""
    return _dealt(blocks.join(elements.hint("merge"), "doc_id")).mapInArrow(_join_block(held, percent), LINKS)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose doc_id names its component; texts without words all stay."""
    found = near_duplicates(docs, n, percent).where("component_id = doc_id").select("doc_id").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    kept = rows.join(found, "doc_id", "left_semi").select("row").unionByName(rows.where("doc_id is null").select("row"))
    return kept.select("row.*")


def ngram_join_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
