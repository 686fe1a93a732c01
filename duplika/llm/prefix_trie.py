"""Prefix tree of conversations by partition refinement.

All conversations begin as one class, the root. Each round looks at one turn more and splits every active class by it;
each part is a node of the tree. A class of one sequence is retired: the rest of its turns are a chain of nodes without
a branch, written out at once. When no class is active, children's sums are folded back into their parents, deepest first.

Where the work is done: equal sequences first become one row with their number, so copies cost a row. Classes of over
``LOCAL_PATHS`` sequences or ``LOCAL_TURNS`` turns are split by Spark, one round a turn; all smaller ones are refined to
their end by tasks that take many classes at once as arrays, and hand up only the sums of their top. Turns are told by
SHA-256 of role and text, so a conversation is a row of 40 bytes a turn, whatever its texts. Ids of
equal sequences are joined into texts of at most 4,096 neighbouring ids before they are dealt, and digested as they pass.

Cases: rows without a conv_id belong to no conversation; a null turn comes first, rows of one turn follow in the order of
their digests; null role or text is empty; ``c % 5`` has the sign of c; rows that are repeated are turns of their own; a
conversation whose rebuilt form has no turn is a member of the root and ends there; an empty table has no node.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, list_parts, stage, workdir

#: A class of up to so many sequences and turns is refined by one task.
LOCAL_PATHS, LOCAL_TURNS = 256, 1 << 16
_NOTHING = hashlib.sha256(b"").hexdigest()
_TURNS = "array<struct<key:binary,bytes:bigint>>"

# --- rebuilt conversations ------------------------------------------------------------


def own_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: digest and bytes of each turn, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes")).alias("t")
    )
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return held.select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(own: DataFrame, stride: int = 5, most: int = 9) -> DataFrame:
    """``conv_id, turns``: the lead of conversation c - c % stride, then c's own turns after as many."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    lead = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("lead"))
    rows = own.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % stride).alias("base"), h.alias("h")).join(lead, "base", "left")
    first = F.slice(F.coalesce("lead", F.array().cast(_TURNS)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(first, rest).alias("turns"))


_PATHS = "path long, n long, ends string, keys array<binary>, bytes array<long>"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, ids in order, n, keys, bytes) sorted by digest and ids, as a row a digest."""
    digest, state, row = None, hashlib.sha256(), None
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if r["digest"] != digest:
                if row:
                    done.append(row | {"ends": state.hexdigest()})
                digest, state = r["digest"], hashlib.sha256(r["ids"].encode())
                row = {"path": r["first"], "n": r["n"], "keys": r["keys"], "bytes": r["bytes"]}
            else:
                state.update(f",{r['ids']}".encode())
                row["n"] += r["n"]
        if done:
            yield _paths(done)
    if row:
        yield _paths([row | {"ends": state.hexdigest()}])


def _paths(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.int64()), ("n", pa.int64()), ("ends", pa.string()), ("keys", pa.list_(pa.binary())), ("bytes", pa.list_(pa.int64()))]))


def paths(sequences: DataFrame) -> DataFrame:
    """``path, n, ends, keys, bytes``: each distinct sequence, by the smallest id that has it, with the digest of all its ids."""
    keys = F.transform("turns", lambda t: t["key"])
    rows = sequences.select("conv_id", keys.alias("keys"), F.transform("turns", lambda t: t["bytes"]).alias("bytes"), F.sha2(F.array_join(F.transform(keys, F.hex), ""), 256).alias("digest"))
    near = rows.groupBy("digest", F.shiftright("conv_id", 12).alias("chunk")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"), F.min("conv_id").alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("bytes").alias("bytes")
    )
    return near.repartition("digest").sortWithinPartitions("digest", "chunk").mapInArrow(_ends, _PATHS)


# --- refinement within a task -------------------------------------------------------------

_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, head boolean"
_KINDS = (*(pa.int64(),) * 7, pa.string(), pa.bool_())


def refine(group: np.ndarray, path: np.ndarray, n: np.ndarray, depth: np.ndarray, parent: np.ndarray, codes: np.ndarray, size: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes of many classes of sequences, tops included.

    Rows are sorted by (group, path); row i's turns are ``codes[at[i]:at[i + 1]]`` and their bytes; the first ``depth`` of them are
    shared by its group, whose top hangs under ``parent``. ``end`` of a node is the row that ends there, or -1.
    """
    length = np.diff(at)
    _, first, cls = np.unique(group, return_index=True, return_inverse=True)
    tops = first.size
    width = int(codes.max(initial=0)) + 1
    grow: dict[str, list[np.ndarray]] = {k: [] for k in ("conv", "depth", "up", "convs", "bytes", "end", "children", "leaves", "saved", "parent")}

    def put(**columns) -> None:
        for k, v in columns.items():
            grow[k].append(v)

    def level(lead: np.ndarray, convs: np.ndarray, d: np.ndarray, up: np.ndarray) -> None:
        """Nodes of one round; ``lead`` is each one's first row."""
        last = np.where(d > 0, size[np.minimum(at[lead] + np.maximum(d, 1) - 1, max(size.size - 1, 0))] if size.size else 0, 0)
        zero = np.zeros(lead.size, np.int64)
        put(conv=path[lead], depth=d, up=up, convs=convs, bytes=last, end=zero - 1, children=zero.copy(), leaves=zero.copy(), saved=(convs - 1) * last, parent=zero.copy())

    level(first, np.bincount(cls, n, tops).astype(np.int64), depth[first], np.full(tops, -1))
    live, d, total, levels = np.arange(path.size), depth.copy(), tops, [(0, tops)]
    base = 0  # number of the round's first node
    chains: list[tuple[int, int]] = []  # (row, node it hangs under)
    while live.size:
        members = np.bincount(cls - base, minlength=total - base)
        alone = members[cls - base] == 1
        chains += zip(live[alone].tolist(), cls[alone].tolist())
        ended = ~alone & (d[live] == length[live])
        grow["end"][-1][cls[ended] - base] = live[ended]
        go = ~alone & ~ended
        live, cls = live[go], cls[go]
        if not live.size:
            break
        _, lead, part = np.unique(cls * width + codes[at[live] + d[live]], return_index=True, return_inverse=True)
        d[live] += 1
        level(live[lead], np.bincount(part, n[live]).astype(np.int64), d[live[lead]], cls[lead])
        cls, base = part + total, total
        levels.append((total, total + lead.size))
        total += lead.size
    out = {k: np.concatenate(v) for k, v in grow.items()}
    # Retired classes: the tails of their one sequence.
    tails: dict[str, list[np.ndarray]] = {k: [] for k in ("conv", "depth", "convs", "end", "children", "leaves", "saved", "parent")}
    for row, node in chains:
        begin, stop = int(out["depth"][node]), int(length[row])
        if begin == stop:
            out["end"][node] = row
            continue
        k = stop - begin
        saved = np.cumsum(((n[row] - 1) * size[at[row] + begin : at[row] + stop])[::-1])[::-1]
        end, children, up = np.full(k, -1), np.ones(k, np.int64), np.full(k, path[row])
        end[-1], children[-1], up[0] = row, 0, out["conv"][node]
        for name, v in (("conv", np.full(k, path[row])), ("depth", np.arange(begin + 1, stop + 1)), ("convs", np.full(k, n[row])), ("end", end), ("children", children), ("leaves", np.ones(k, np.int64)), ("saved", saved), ("parent", up)):
            tails[name].append(v)
        out["children"][node] += 1
        out["leaves"][node] += 1
        out["saved"][node] += saved[0]
    # Fold back, deepest round first.
    for low, high in reversed(levels):
        mine = slice(low, high)
        out["leaves"][mine] = np.where(out["children"][mine] == 0, 1, out["leaves"][mine])
        up = out["up"][mine]
        hung = up >= 0
        for k, v in (("children", np.ones(high - low, np.int64)), ("leaves", out["leaves"][mine]), ("saved", out["saved"][mine])):
            np.add.at(out[k], up[hung], v[hung])
    out["parent"] = np.where(out["up"] >= 0, out["conv"][out["up"]], -1)
    out["parent"][:tops] = parent[first]
    head = np.zeros(total, bool)
    head[:tops] = True
    out["head"] = np.concatenate([head, *(np.zeros(x.size, bool) for x in tails["conv"])])
    return {k: out[k] if k == "head" else np.concatenate([out[k], *tails[k]]) for k in (*tails, "head")}


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (top, path, n, ends, depth, parent, keys, bytes) sorted by top and path; whole classes, many at once."""

    def nodes(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks().to_batches()[0]
        keys = rows.column("keys")
        at = keys.offsets.to_numpy().astype(np.int64)
        codes = keys.values.slice(at[0], at[-1] - at[0]).dictionary_encode().indices.to_numpy().astype(np.int64)
        num = lambda c: rows.column(c).to_numpy()
        made = refine(num("top"), num("path"), num("n"), num("depth"), num("parent"), codes, list_parts(rows.column("bytes"))[0], at - at[0])
        end = made["end"]
        ends = rows.column("ends").take(pa.array(np.where(end < 0, 0, end), mask=end < 0))
        names = ("conv", "depth", "parent", "convs", "children", "leaves", "saved")
        return pa.RecordBatch.from_arrays([*(pa.array(made[k].astype(np.int64)) for k in names), ends, pa.array(made["head"])], [c.split()[0] for c in _NODES.split(", ")])

    held: list[pa.RecordBatch] = []
    turns = 0
    for batch in batches:
        while batch.num_rows:
            top = batch.column("top").to_numpy()
            if held and held[-1].column("top")[-1].as_py() != top[0] and turns >= LOCAL_TURNS:
                yield nodes(pa.Table.from_batches(held))
                held, turns = [], 0
            # Up to the first border of two classes beyond the limit.
            upto = batch.column("keys").offsets.to_numpy()[1:].astype(np.int64) - batch.column("keys").offsets[0].as_py()
            borders = np.flatnonzero((top[1:] != top[:-1]) & (turns + upto[:-1] >= LOCAL_TURNS)) + 1
            take = int(borders[0]) if borders.size else batch.num_rows
            held.append(batch.slice(0, take))
            turns += int(upto[take - 1])
            batch = batch.slice(take)
    if held:
        yield nodes(pa.Table.from_batches(held))


# --- rounds ---------------------------------------------------------------------------------


def trie(sequences: DataFrame, folder: str | None = None, local_paths: int = LOCAL_PATHS, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """Nodes of the prefix tree of ``conv_id, turns``; ``ends`` is null where no sequence ends."""
    spark = sequences.sparkSession
    folder = folder or workdir(spark)
    whole = stage(paths(sequences), folder, "paths")
    root = whole.agg(F.min("path").alias("top"), F.sum("n").alias("n"), F.max(F.when(F.size("keys") == 0, F.col("ends"))).alias("ends")).first()
    if root.top is None:
        return spark.createDataFrame([], _NODES)
    node = "top long, depth long, parent long, n_convs long, bytes long, ends string"
    large = [spark.createDataFrame([(root.top, 0, None, root.n, 0, root.ends)], node)]  # the root
    live, small, depth = whole.withColumn("top", F.lit(root.top)), [], 0
    while not live.isEmpty():
        # Split every active class by its next turn.
        active = live.where(F.size("keys") > depth).withColumn("key", F.element_at("keys", depth + 1))
        parts = active.groupBy(F.col("top").alias("parent"), "key").agg(
            F.min("path").alias("child"), F.sum("n").alias("n_convs"), F.count("*").alias("members"), F.sum(F.size("keys") - depth).alias("turns"),
            F.first(F.element_at("bytes", depth + 1)).alias("last"), F.max(F.when(F.size("keys") == depth + 1, F.col("ends"))).alias("part_ends"),
        )
        big = (F.col("members") > 1) & ((F.col("members") > local_paths) | (F.col("turns") > local_turns))
        parts = stage(parts.withColumn("big", big), folder, f"parts_{depth}")
        moved = active.withColumnRenamed("top", "parent").join(parts.select("parent", "key", "child", "big"), ["parent", "key"])
        moved = stage(moved.select("path", "n", "ends", "keys", "bytes", F.col("child").alias("top"), "parent", "big"), folder, f"live_{depth + 1}")
        depth += 1
        small.append(moved.where("not big").select("top", "path", "n", "ends", F.lit(depth).cast("long").alias("depth"), "parent", "keys", "bytes"))
        large.append(parts.where("big").select(F.col("child").alias("top"), F.lit(depth).cast("long").alias("depth"), "parent", "n_convs", F.col("last").alias("bytes"), F.col("part_ends").alias("ends")))
        live = moved.where("big").drop("parent", "big")
    below = reduce(DataFrame.unionByName, small)
    local = stage(below.repartition("top").sortWithinPartitions("top", "path").mapInArrow(_local, _NODES), folder, "local")
    # Fold back: each large node's children are small tops and large nodes one deeper.
    heads = local.where("head").select("depth", "parent_conv_id", "n_leaves", "saved_tokens")
    folded: list[DataFrame] = []
    for d in range(depth, -1, -1):
        kids = heads.where(F.col("depth") == d + 1).drop("depth")
        if folded:
            kids = kids.unionByName(folded[-1].select(kids.columns))
        sums = kids.groupBy(F.col("parent_conv_id").alias("top")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        rows = large[d].join(sums, "top", "left").select(
            F.col("top").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"), "ends", F.lit(False).alias("head"),
        )
        folded.append(stage(rows, folder, f"folded_{d}"))
    for name in ("paths", *(f"{k}_{d}" for d in range(depth + 1) for k in ("live", "parts"))):
        drop(spark, f"{folder}/{name}")
    return reduce(DataFrame.unionByName, [local, *folded])


def trie_query(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    folder = workdir(spark)
    own = stage(own_turns(conversations), folder, "own")
    nodes = trie(rebuilt(own), folder)
    drop(spark, f"{folder}/own")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256"))


#: The same rows in SQL; crc32 is worked out bit by bit.
TRIE_SQL = """
WITH t AS (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS key, octet_length(encode(coalesce(text, ''))) AS n FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'k': key, 'n': n} ORDER BY turn NULLS FIRST, key) AS turns,
  (xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, (acc & 1) * 3988292384) END), 4294967295) % 9)::BIGINT AS h FROM t GROUP BY conv_id),
seqs AS (SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:o.h], o.turns[o.h + 1:]) AS turns FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
pre AS (SELECT conv_id, len(turns) AS size, turns, unnest(range(len(turns) + 1)) AS depth FROM seqs),
named AS (SELECT conv_id, size, depth, coalesce(turns[depth].n, 0) AS n, list_transform(turns[1:depth], lambda x: x.k) AS prefix FROM pre),
nodes AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n) AS saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256 FROM named GROUP BY prefix, depth),
kids AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (prefix)),
up AS (SELECT prefix[1:a] AS prefix, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(depth + 1)) AS a FROM full_nodes) GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, up.n_leaves, up.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN up USING (prefix) LEFT JOIN nodes p ON f.depth > 0 AND p.prefix = f.prefix[1:f.depth - 1]"""
