"""N-gram Jaccard join: size-aware, heavy and light sets apart.

A text's set holds its distinct shingles of WORDS words. Two sets link when 100 * |both| >= PERCENT * |either|, which asks
for an overlap that the two sizes fix. Small sets list all their subsets of that overlap's size: sets that share one are
linked, and nothing else has to be compared. Large sets scan inverted lists: each puts its rarest shingles, as many as a
partner cannot miss all of, on lists, and sets that meet on a list are compared in full. The boundary between small and
large is the size at which listing subsets costs more than scanning the lists that sets of that size really stand on.

How rare a shingle is, is counted exactly. Every set's shingles are shuffled once, packed, to cells of the key space; a cell
knows each shingle's sets, and returns only shingles that two sets or more have. A set with fewer of those than any partner
shares with it links with nothing and is done; few sets stay.

Large groups stay linear: copies of a text become one node first; on a list, each node is compared with a few centres only,
and what is thereby connected is not compared again. Last, nodes of different components that still meet on a list are
compared, all whose bitmaps leave an overlap possible, in blocks of a list, so no link between components is lost.

Shingles are 64-bit fingerprints of exact word sequences; two of one document's n shingles, or of a compared pair's, meet
by chance with probability below n^2 / 2^64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailglass.llm.common import WordTable, bounded, cut, held, mix64, scratch, slices, tidy, word_hashes
from mailglass.llm.components import connected_components

WORDS = 5
PERCENT = 80
#: Subsets of a set beyond this size are more than any scan; it bounds the cost table, not the sets.
MAX_SMALL = 24
#: Rounds against centres before all pairs that remain open are compared.
TURNS = 8
#: Nodes of a list in one block when its open pairs are compared.
BLOCK = 2048
#: Rows (about 70 bytes each) up to which a table of nodes is broadcast to pick their texts; beyond, texts are shuffled.
BROADCAST_NODES = 1_000_000
#: A text with more than this share of all rows is looked up by broadcast: there are at most 1 / HOT such texts.
HOT = 1 / 1000
#: Bits of a shingle that are shuffled behind its cell's, longs in a set's bitmap, entries a task holds back.
KEY_BITS, BITMAP, HELD = 40, 8, 1 << 20


def overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """Least overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def largest_partner(n: int, percent: int = PERCENT) -> int:
    return 100 * n // percent


def least_partner(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Each text's set as sorted distinct 64-bit fingerprints."""
    table = held("shingles", lambda: WordTable(word_hashes))
    split = [t.encode().lower().split() for t in texts]
    ids = table.ids([w for ws in split for w in ws])
    h = table.rows[0][ids] if len(ids) else np.zeros(0, np.uint64)
    n = max(0, len(h) - words + 1)
    s = np.zeros(n, np.uint64)
    for j in range(words):
        s = s * np.uint64(0x9E3779B97F4A7C15) + mix64(h[j : j + n], j)
    s = mix64(s)
    out, at = [], 0
    for ws in split:
        k = len(ws)
        if k >= words:
            out.append(np.unique(s[at : at + k - words + 1]))
        elif k:
            x = np.uint64(k)
            for j in range(k):
                x = mix64(np.array([x ^ h[at + j]]), j + 7)[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


# --- texts and nodes


def text_hashes() -> tuple[Column, Column]:
    """128 bits that tell texts apart."""
    t = F.coalesce("text", F.lit(""))
    return F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2")


def nodes_of(texts: DataFrame) -> DataFrame:
    """node, h1, h2, least (the smallest doc_id, which names the row that stands for the text), copies: a row per text."""
    found = texts.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    # In order of ids, so that the nodes of neighbouring rows compress well.
    return found.orderBy("least").withColumn("node", F.monotonically_increasing_id())


def chosen(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text: the text of each of the nodes. Repeated rows may bring a node twice."""
    c = nodes.select(F.col("h1").alias("_h"), F.col("least").alias("_id"), "node")
    c = F.broadcast(c) if c.count() <= BROADCAST_NODES else c
    d = docs.select("doc_id", "text", text_hashes()[0])
    return d.join(c, (F.col("h1") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")


def sliced_sets(batches: Iterator[pa.RecordBatch], words: int, most: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Nodes and their sets, a slice of (node, text) at a time, each node once in it."""
    for whole in batches:
        for b in slices(whole, 1, most):
            nodes, first = np.unique(b.column(0).to_numpy(), return_index=True)
            texts = b.column(1).take(pa.array(first)).to_pylist()
            yield nodes, shingle_sets([t or "" for t in texts], words)


# --- exact frequencies, and the shingles of each set's prefix that others share


def planes(x: np.ndarray, n: int) -> bytes:
    """The low n bytes of 64-bit numbers, all first bytes first: slowly varying bytes compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def numbers(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(n, -1).T
    return out.view(np.uint64).ravel()


PACKED = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("is_size", T.BooleanType()), T.StructField("keys", T.BinaryType()), T.StructField("nodes", T.BinaryType())])
SHARED = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("nodes", T.BinaryType()), T.StructField("keys", T.BinaryType()), T.StructField("values", T.BinaryType())])
LISTED = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("key", T.LongType()), T.StructField("times", T.LongType()), T.StructField("at", T.LongType())])
_ARROW = {"int": pa.int32(), "boolean": pa.bool_(), "bigint": pa.int64(), "binary": pa.binary()}
#: Stands for a shingle where the entry gives the size of the node's set.
SIZE = np.uint64(0xFFFFFFFFFFFFFFFF)


def record(schema: T.StructType, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, _ARROW[f.dataType.simpleString()]) for c, f in zip(columns, schema, strict=True)], names=schema.names)


def packed_shingles(texts: DataFrame, cell_bits: int, words: int) -> DataFrame:
    """Per slice of texts: for each cell its shingles with their nodes; and a row of all nodes' sizes."""
    slice_bytes = max(4 << 20, 256 << cell_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, sets in sliced_sets(batches, words, slice_bytes):
            size = np.array([len(s) for s in sets], np.uint64)
            keys = np.concatenate([*sets, np.zeros(0, np.uint64)])
            order = np.argsort(keys)
            keys, owners = keys[order], np.repeat(nodes, size.astype(np.int64))[order]
            at = np.searchsorted(keys >> np.uint64(64 - cell_bits), np.arange((1 << cell_bits) + 1, dtype=np.uint64))
            short = keys >> np.uint64(64 - cell_bits - KEY_BITS)
            full = np.flatnonzero(np.diff(at)).tolist()
            rows = [(c, False, planes(short[at[c] : at[c + 1]], KEY_BITS // 8), planes(owners[at[c] : at[c + 1]], 8)) for c in full]
            if len(nodes):
                rows.append((int(mix64(nodes[:1])[0] >> np.uint64(64 - cell_bits)), True, planes(size, 8), planes(nodes, 8)))
                yield record(PACKED, zip(*rows, strict=True))

    return texts.mapInArrow(tidy(run), PACKED)


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each cell, without the cell, from batches in order of it."""
    now, rows = None, []
    for b in batches:
        for cell, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if cell != now and rows:
                yield now, rows
                rows = []
            now = cell
            rows.append(row)
    if rows:
        yield now, rows


def shared_shingles(packed: DataFrame, cell_bits: int) -> DataFrame:
    """Shingles that two sets or more have, with each of their nodes and how many they are, packed by cell of the node.

    A task holds a cell at a time: a 2^cell_bits-th of all shingles, and all sets of one very frequent shingle (8 bytes each).
    """

    def deal(parts: list[tuple]) -> pa.RecordBatch:
        nodes, keys, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        cells = mix64(nodes) >> np.uint64(64 - cell_bits)
        order = np.argsort(cells, kind="stable")
        at = np.searchsorted(cells[order], np.arange((1 << cell_bits) + 1, dtype=np.uint64))
        nodes, keys, values = nodes[order], keys[order], values[order]
        full = np.flatnonzero(np.diff(at)).tolist()
        return record(SHARED, (full, *([planes(x[at[c] : at[c + 1]], n) for c in full] for x, n in ((nodes, 8), (keys, 8), (values, 8)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, waiting = [], 0
        for cell, rows in by_cell(batches):
            for _, sizes, nodes in (r for r in rows if r[0]):
                n = numbers(nodes, 8)
                out.append((n, np.full(len(n), SIZE), numbers(sizes, 8)))
            if parts := [r for r in rows if not r[0]]:
                keys = np.concatenate([numbers(r[1], KEY_BITS // 8) for r in parts])
                order = np.argsort(keys)
                keys = keys[order]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                times = np.diff(np.append(first, len(keys)))
                times = np.repeat(times, times)
                some = times > 1
                nodes = np.concatenate([numbers(r[2], 8) for r in parts])[order[some]]
                out.append((nodes, keys[some] | np.uint64(cell << KEY_BITS), times[some].astype(np.uint64)))
            waiting += sum(len(x[0]) for x in out[-1:])
            if waiting > HELD:
                yield deal(out)
                out, waiting = [], 0
        if out:
            yield deal(out)

    return packed.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(run), SHARED)


def prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """A row (node, n) per node, and rows (node, n, key, times, at) of its prefix's shared shingles: `at` is the shingle's
    place in the set's order, the rarest first. Sets with too few shared shingles for any partner have none."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        node, key, value = (np.concatenate([numbers(r[i], 8) for r in rows]) for i in range(3))
        is_size = key == SIZE
        who, first = np.unique(node[is_size], return_index=True)
        n = value[is_size][first].astype(np.int64)
        node, key, value = node[~is_size], key[~is_size], value[~is_size]
        order = np.lexsort((key, value, node))
        node, key, value = node[order], key[order], value[order].astype(np.int64)
        new = np.ones(len(node), bool)  # repeated rows bring an entry twice
        new[1:] = (node[1:] != node[:-1]) | (key[1:] != key[:-1])
        node, key, value = node[new], key[new], value[new]
        start = np.searchsorted(node, who)
        shared = np.searchsorted(node, who, side="right") - start
        of = np.repeat(np.arange(len(who)), shared)
        nth = np.arange(len(node)) - start[of]
        need = -(-percent * n // 100)
        some = nth <= (shared - need)[of]
        of, at = of[some], (n - shared)[of[some]] + nth[some]
        none = pa.nulls(len(who), pa.int64())
        cols = zip((who.view(np.int64), n, none, none, none), (who[of].view(np.int64), n[of], key[some].view(np.int64), value[some], at), strict=True)
        return record(LISTED, [pa.concat_arrays([a if isinstance(a, pa.Array) else pa.array(a), pa.array(b)]) for a, b in cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_cell(batches):
            yield settle(rows)

    return shared.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(run), LISTED)


# --- small sets


def subsets_of(n: int, percent: int = PERCENT) -> int:
    """Subsets that a set of n shingles lists, over all sizes of partners."""
    return sum(math.comb(n, overlap(n, m, percent)) for m in range(least_partner(n, percent), largest_partner(n, percent) + 1))


def boundary(sizes: dict[int, int], scans: dict[int, int], percent: int = PERCENT) -> int:
    """The size up to which, in all, listing subsets costs less than scanning. sizes: sets by size; scans: the lengths of
    all lists in the prefixes of sets of a size."""
    best, small, gain = 0, 0, 0
    for n in range(1, MAX_SMALL + 1):
        gain += scans.get(n, 0) - sizes.get(n, 0) * subsets_of(n, percent)
        if gain > best:
            best, small = gain, n
    return small


SUBSET = T.StructType([T.StructField("key", T.LongType()), T.StructField("less", T.BooleanType()), T.StructField("n", T.LongType()), T.StructField("node", T.LongType())])


def subset_keys(s: np.ndarray, small: int, percent: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Keys of all subsets of a small set: for each partner size, those of the overlap that the two sizes ask for; and
    whether the set is the smaller one."""
    n = len(s)
    for m in range(max(1, least_partner(n, percent)), min(small, largest_partner(n, percent)) + 1):
        rows = np.array(list(combinations(s.tolist(), overlap(n, m, percent))), np.uint64)
        yield mix64(mix64(rows, 3).sum(axis=1, dtype=np.uint64), 100 * min(n, m) + max(n, m)).view(np.int64), n <= m


def subset_links(sets: DataFrame, small: int, percent: int) -> DataFrame:
    """Links of small sets: on a subset's list each larger set links with the least smaller one, and the other way round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = np.asarray(s.values).view(np.uint64)
                for keys, less in subset_keys(s, small, percent):
                    yield record(SUBSET, (keys, [less] * len(keys), [len(s)] * len(keys), [node] * len(keys)))

    s = sets.filter(F.col("n") <= small).select("node", "shingles").mapInArrow(run, SUBSET)
    least = s.groupBy("key").agg(
        F.min(F.when(F.col("less"), F.col("node"))).alias("low_node"), F.min(F.when(~F.col("less"), F.col("node"))).alias("high_node"), F.min("n").alias("low"), F.max("n").alias("high")
    )
    # With one size on the list, all are linked; else only smaller with larger.
    other = F.when(F.col("low") == F.col("high"), F.col("low_node")).when(F.col("less"), F.col("high_node")).otherwise(F.col("low_node"))
    return s.join(least, "key").select(F.col("node").alias("a"), other.alias("b")).filter("a != b").distinct()


# --- large sets

SETS = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("bitmap", T.ArrayType(T.LongType()))])


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """node, n, shingles, bitmap of (node, text). Every shingle flips one of the bitmap's bits, so two sets differ in at
    least as many shingles as their bitmaps in bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, sets in sliced_sets(batches, words, 4 << 20):
            size = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
            bit = np.repeat(np.arange(len(sets)), size) * (64 * BITMAP) + (flat % np.uint64(64 * BITMAP)).astype(np.int64)
            marks = np.packbits(np.bincount(bit, minlength=64 * BITMAP * len(sets)).astype(np.uint8) & 1).view(np.int64)
            lists = lambda x, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.view(np.int64)))
            yield record(SETS, (nodes, size, lists(flat, np.append(0, np.cumsum(size))), lists(marks, BITMAP * np.arange(len(sets) + 1))))

    return texts.mapInArrow(tidy(run), SETS)


def possible(a: str, b: str, percent: int) -> Column:
    """By the sizes and bitmaps of the sets in columns n_a, bitmap_a and so on, whether a and b may link."""
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    differ = sum((F.bit_count(F.col(f"bitmap_{a}")[i].bitwiseXOR(F.col(f"bitmap_{b}")[i])) for i in range(BITMAP)), F.lit(0))
    need = F.ceil(F.lit(percent) * (n_a + n_b) / (100 + percent))
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (differ <= n_a + n_b - 2 * need)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, with all their columns."""
    x = pairs
    for c in ("a", "b"):
        x = x.join(sets.select(F.col("node").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in ("n", "shingles", "bitmap"))), c)
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return x.filter(possible("a", "b", percent) & ((100 + percent) * both >= percent * (F.col("n_a") + F.col("n_b")))).select(pairs.columns)


def centre_pairs(lists: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each node against a centre: of every band of sizes that may link, a list's centre is the node of the least hash, and of
    its lists' centres in other components a node takes the one of the least hash. So there is at most a pair a node."""
    rank = lambda c: F.xxhash64(F.lit(turn), F.col(c))
    x = lists.withColumn("band", F.floor(F.log("n") / math.log(100 / percent) + 0.5 * (turn % 2)).cast("int"))
    centre = x.groupBy("key", "band").agg(F.min_by(F.struct("node", "label"), rank("node")).alias("c"))
    j = x.join(centre, ["key", "band"]).filter("label != c.label")
    j = j.groupBy("node").agg(F.first("label").alias("label_a"), F.min_by("c", rank("c.node")).alias("c"))
    return j.select(F.col("node").alias("a"), F.col("c.node").alias("b"), "label_a", F.col("c.label").alias("label_b"))


def open_lists(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The lists, with each node's component, on which more than one component is left."""
    if labels is None:
        x = lists.withColumn("label", F.col("node"))
    else:
        x = lists.join(labels.withColumnRenamed("component", "_l"), "node", "left").withColumn("label", F.coalesce("_l", "node")).drop("_l")
    return x.join(x.groupBy("key").agg((F.min("label") != F.max("label")).alias("_open")).filter("_open").select("key"), "key", "left_semi")


def open_pairs(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of nodes of different components that meet on a list and may still link, by size, by position (what comes
    behind their first shared shingle must suffice) and by their bitmaps. A list is compared in blocks of BLOCK nodes."""
    lens = lists.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    x = lists.join(lens, "key").join(sets.select("node", "bitmap"), "node")
    side = lambda c: [F.col(k).alias(f"{k}_{c}") for k in ("node", "label", "n", "at", "bitmap")]
    a = x.select("key", F.pmod(F.xxhash64("node"), "blocks").alias("block"), *side("a"))
    b = x.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), *side("b"))
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    j = a.join(b, ["key", "block"]).filter((F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & ((100 + percent) * room >= percent * (F.col("n_a") + F.col("n_b"))) & possible("a", "b", percent))
    return j.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "label_a", "label_b").distinct()


def merged(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """labels after links between the components label_a and label_b. Only components are joined, not all links so far."""
    new = connected_components(found.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct())
    if labels is None:
        return new
    to = new.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    old = labels.join(to, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return cut(old.unionByName(new.join(labels, "node", "left_anti")))


def list_links(lists: DataFrame, sets: DataFrame, links: DataFrame | None, percent: int) -> DataFrame | None:
    """Labels (node, component) by links (small sets', if any) and by those between nodes that meet on lists, enough to connect
    all that is connected; None where there is nothing."""
    labels = connected_components(links) if links is not None else None
    for turn in range(TURNS + 1):
        still = cut(open_lists(lists, labels))
        if still.isEmpty():
            break
        pairs = cut(centre_pairs(still, percent, turn) if turn < TURNS else open_pairs(still, sets, percent))
        labels = merged(labels, cut(verified(pairs, sets, percent)))
    return labels


def links_of(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Sizes (node, n) of all nodes, and labels (node, component) of those that link."""
    cell_bits = min(18, max(6, (2 * docs.rdd.getNumPartitions()).bit_length()))
    found = cut(prefixes(shared_shingles(packed_shingles(chosen(docs, nodes), cell_bits, words), cell_bits), percent))
    sizes, lists = found.filter("key is null").select("node", "n").distinct(), found.filter("key is not null")
    live = lists.select("node").distinct()
    sets = cut(sets_of(chosen(docs, nodes.join(live, "node", "left_semi")), words).dropDuplicates(["node"]))
    cost = lists.filter(F.col("n") <= MAX_SMALL).groupBy("n").agg(F.countDistinct("node").alias("sets"), F.sum("times").alias("scanned")).collect()  # at most MAX_SMALL rows
    small = boundary({r["n"]: r["sets"] for r in cost}, {r["n"]: r["scanned"] for r in cost}, percent)
    links = cut(subset_links(sets, small, percent)) if small else None
    heavy = lists.filter(F.floor(100 * F.col("n") / percent) > small)  # others have met all their partners by subsets
    return sizes, list_links(heavy, sets, links, percent)


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links lead to, the document's own included.

    docs: doc_id, text. Null and empty texts have 0 shingles and stand alone. Texts of fewer than `words` words are one
    shingle, which only an equal sequence shares. Every row is a document: rows that share an id are judged each by its own
    text, repeated rows get equal results. Rows with a null id come back with a null component, though their texts connect
    others. Other columns are not read. Copies fall together before anything is compared.
    """
    spark = docs.sparkSession
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(spark):
        texts = cut(docs.select("doc_id", *text_hashes()))
        nodes = cut(nodes_of(texts))
        sizes, labels = links_of(docs, nodes, words, percent)
        named = nodes.join(sizes, "node")
        if labels is not None:
            # A component is named by its least document, not by its least node.
            name = labels.join(nodes, "node").groupBy("component").agg(F.min("least").alias("named"))
            named = named.join(labels.join(name, "component").select("node", "named"), "node", "left")
        else:
            named = named.withColumn("named", F.lit(None).cast("long"))
        named = cut(named.select("h1", "h2", "copies", F.col("n").alias("n_shingles"), F.coalesce("named", "least").alias("named")))
        rows = texts.count()
        hot = named.filter(F.col("copies") > rows * HOT).select("h1", "h2", F.struct("n_shingles", "named").alias("_hot"))
        x = texts.join(F.broadcast(hot), ["h1", "h2"], "left")  # at most 1 / HOT rows
        answer = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("named")).alias("component_id")
        some = x.filter("_hot is not null").select("doc_id", "_hot.*").select("doc_id", "n_shingles", answer)
        rest = x.filter("_hot is null").join(named.drop("copies"), ["h1", "h2"]).select("doc_id", "n_shingles", answer)
        return cut(some.unionByName(rest), keep=True)


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without the near copies: of each component the rows of the least doc_id stay. Rows with a null id stay."""
    gone = jaccard_components(docs, words, percent).filter("component_id != doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_NODES else gone
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
