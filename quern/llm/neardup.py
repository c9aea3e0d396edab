"""SimHash near-duplicate groups by a binary trie self-join.

Every document gets a fingerprint; equal ones are one node with its smallest document. Nodes meet in shards: a table is
a choice of bits, and a shard is what agrees in them. How many bits a table takes follows the logarithm of the number of
nodes, so that a shard stays small. In a shard the sorted fingerprints are a binary trie; pairs of its nodes are
traversed together, differing bits are added up, and a pair ends when they exceed the radius, or when all below it is
linked already. Stars are contracted until each node points to its smallest.

near_duplicates() links by bits alone and is exact: its tables are all choices of blocks that a pair within the radius
must agree in (pigeonhole). similar_groups() links by the similarity of sets of shingles: the trie join over wide
fingerprints proposes pairs, and each is verified on the whole sets before it is a link. Its radius is three standard
deviations beyond the mean distance at the least similarity and its tables miss a pair at that mean with probability
MISSED, so recall at the threshold is a stated estimate (measured in the tests) and there are no false links. A first
round verifies a spanning forest of what the shards of a few tables propose. In the second round, over all tables, the
nodes that have a partner of another group send their sets to the shard, which verifies the pairs as the trie join finds
them; what is one group by then is skipped, and a pair that agrees in several tables is of the first of them alone. So no
list of pairs is ever written, and a group that is linked early never becomes all its pairs.

A shard of over HOT rows is cut into pieces that meet two by two, so no task holds a large group.

Defined results: a null text is empty, a text without words has fingerprint zero and (similar_groups) equals any other
such; a null doc_id comes before all others; repeated rows are linked like any other (similar_groups: rows that share a
doc_id are one document); texts are read whole, however long; other columns are ignored, whatever their names; an empty
table gives an empty table.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.anchors import mixed
from quern.llm.common import buffers, column, id_back, keyed, lower_ascii, ranges, slices, written
from quern.shared import dropped, shared_path

SEED = 42
#: Node pairs that are traversed at once, and fingerprints of the shards that are taken together.
PAIRS, ROWS = 1 << 16, 100_000
#: similar_groups(): pairs of rows below a node pair up to which they are compared one by one, since its wide radius ends few
#: of them sooner. Such pairs that are compared at once.
LEAF, COMPARED = 1 << 10, 1 << 18
#: Rows of a shard beyond which it is cut into pieces, and one in how many nodes such shards are found by.
HOT, SAMPLED = 1 << 16, 64
#: similar_groups(): bits of a fingerprint, least bits of a table, the share of pairs at the least similarity that meet in no table.
WIDE, TABLE_BITS, MISSED = 256, 14, 0.005
#: Tables of the first round; rows with sets that the second takes together; bits of the filter of nodes whose sets are asked for.
FIRST_TABLES, SET_ROWS, FILTER_BITS = 4, 5_000, 1 << 23
#: Bits of a shard's number below its table's.
OWN_BITS = 52


def shingle_hashes(raw: bytes, size: int) -> list[int]:
    """XXH64 of the shingles of `size` words; of all words if there are fewer."""
    words = raw.split()
    if not words:
        return []
    one = b" ".join(words)
    if len(words) < size:
        return [xxhash.xxh64_intdigest(one, SEED)]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(lens + 1) - 1
    begin = end - lens
    x = xxhash.xxh64_intdigest
    return [x(one[a:b], SEED) for a, b in zip(begin[: len(words) - size + 1].tolist(), end[size - 1 :].tolist(), strict=True)]


def simhash(hashes: list[int] | np.ndarray, bits: int = 64) -> bytes:
    """A bit is set if it is in over half the hashes; words of 64 bits beyond the first come from mixing the hash."""
    if not len(hashes):
        return bytes(bits // 8)
    h = np.array(hashes, np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for plane in range(bits // 64):
            x = h if plane == 0 else mixed(h + np.uint64(plane))
            count = np.zeros(64, np.int64)
            for at in range(0, len(x), 1 << 14):
                count += np.unpackbits(x[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            out.append(np.packbits(count * 2 > len(x)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, shingle: int = 3, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, fp): the fingerprint of every whole text, as bytes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                at, data = buffers(column(part, "text"))
                raw = lower_ascii(data).tobytes()
                fps = [simhash(shingle_hashes(raw[a:b], shingle), bits) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([column(part, "k"), pa.array(fps, pa.binary())], ["k", "fp"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "k long, fp binary")


class Forest:
    """Union by the lesser number, for arrays of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while (self.parent[self.parent] != self.parent).any():
            self.parent = self.parent[self.parent]
        return self.parent

    def link(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links a to b and gives the links that joined two trees: a spanning forest of them."""
        used = []
        while len(a):
            root = self.roots()
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, low = np.maximum(x, y), np.minimum(x, y)
            np.minimum.at(self.parent, high, low)
            won = np.flatnonzero(self.parent[high] == low)
            won = won[np.unique(high[won], return_index=True)[1]]
            used.append((a[won], b[won]))
        self.roots()
        return tuple(np.concatenate([np.zeros(0, np.int64), *(u[side] for u in used)]) for side in (0, 1))


def compared(words: np.ndarray, al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of rows (al to ah, bl to bh) within the radius, and how many bits differ; words: those of 64 bits, by place. Of a part with itself, each pair once."""
    al, size = al.astype(np.int64), (ah - al).astype(np.int64)
    row = ranges(al, size)
    begin = np.where(np.repeat(al == bl, size), row + 1, np.repeat(bl, size))
    count = np.repeat(bh, size) - begin
    other = ranges(begin, count)
    half = (len(words) + 1) // 2
    bits = np.zeros(len(other), np.uint16)
    for word in words[:half]:
        bits += np.bitwise_count(np.repeat(word[row], count) ^ word[other])
    near = np.flatnonzero(bits <= radius)
    a, b, bits = np.repeat(row, count)[near], other[near], bits[near]
    for word in words[half:]:
        bits += np.bitwise_count(word[a] ^ word[b])
    near = bits <= radius
    return a[near], b[near], bits[near].astype(np.int64)


def trie_join(fp: np.ndarray, first: np.ndarray, radius: int, found, groups, leaf: int = 1) -> None:
    """Calls found(a, b, bits) with rows of one shard within the radius.

    fp: rows of bytes, sorted in each shard; first: where shards begin; groups(): arrays with a group for each row, as
    they are then. Rows that are of one group in any of them need not be found. leaf: pairs of rows below a node pair up to
    which the trie is not followed further.
    """
    n, width = fp.shape
    wide = np.ascontiguousarray(fp).view(">u8").astype(np.uint64)
    words = np.ascontiguousarray(wide.T)
    end = np.r_[first[1:], n]
    some = end - first > 1
    lo, hi = first[some].astype(np.int32), end[some].astype(np.int32)
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int16))]  # narrow: there may be a part for every level
    ones: dict[int, np.ndarray] = {}
    while stack:
        level, al, ah, bl, bh, error = stack.pop()
        below = (ah - al).astype(np.int64) * (bh - bl)
        few = below <= leaf
        if len(al) > PAIRS or len(al) > 1 and below[few].sum() > COMPARED:
            half = len(al) // 2
            stack += [(level, *(x[:half] for x in (al, ah, bl, bh, error))), (level, *(x[half:] for x in (al, ah, bl, bh, error)))]
            continue
        one = np.zeros(len(al), bool)
        for group in groups():
            change = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
            one |= (group[al] == group[bl]) & (change[ah - 1] == change[al]) & (change[bh - 1] == change[bl])
        few &= ~one
        if few.any():
            a, b, bits = compared(words, al[few], ah[few], bl[few], bh[few], radius)
            if len(a):
                found(a, b, bits)
        go = (below > leaf) & ~one
        al, ah, bl, bh, error = al[go], ah[go], bl[go], bh[go], error[go]
        if not len(al):
            continue
        if level == 8 * width:  # fingerprints that several nodes share: first a star, then what it has not made one group
            for x, y, u, v in zip(al[::-1].tolist(), ah[::-1].tolist(), bl[::-1].tolist(), bh[::-1].tolist(), strict=True):
                apart = np.bitwise_count(wide[x] ^ wide[u]).sum()
                for i in range(x, y):
                    other = np.arange(i + 1 if x == u else u + (i == x), v)
                    if i == x:
                        head = other if x == u else np.array([u])
                        found(np.full(len(head), x), head, np.full(len(head), apart))
                        if any((group[x:y] == group[x]).all() and (group[u:v] == group[x]).all() for group in groups()):
                            break
                    if i > x or x != u:
                        found(np.full(len(other), i), other, np.full(len(other), apart))
            continue
        if level not in ones:
            ones[level] = np.concatenate([np.zeros(1, np.int32), np.cumsum((fp[:, level >> 3] >> (7 - (level & 7))) & 1, dtype=np.int32)])
        sums = ones[level]
        am, bm = ah - (sums[ah] - sums[al]), bh - (sums[bh] - sums[bl])
        own = al == bl
        every = np.ones(len(al), bool)
        # the nearest last, which are taken first where this is cut
        out = [(al, am, bm, bh, error + 1, every), (am, ah, bl, bm, error + 1, ~own), (al, am, bl, bm, error, every), (am, ah, bm, bh, error, every)]
        kids = []
        for xl, xh, yl, yh, e, use in out:
            use = use & (xh > xl) & (yh > yl) & (e <= radius)
            kids.append((xl[use], xh[use], yl[use], yh[use], e[use]))
        stack.append((level + 1, *(np.concatenate([k[i] for k in kids]) for i in range(5))))


def block_tables(bits: int, radius: int, nodes: int) -> list[np.ndarray]:
    """Choices of bits of which a pair within the radius agrees in one at least: of so many blocks all but radius."""
    for blocks in range(radius + 1, bits + 1):
        cut = np.array_split(np.arange(bits), blocks)
        tables = [np.concatenate(c) for c in itertools.combinations(cut, blocks - radius)]
        if min(map(len, tables)) >= math.log2(max(nodes, 1)) - 6 or len(tables) > 500:
            return tables
    return tables


def bit_tables(bits: int, similarity: float, nodes: int) -> tuple[int, list[np.ndarray]]:
    """Radius, and choices of bits, for sets of that similarity: their fingerprints differ in a bit with probability acos(2s / (1 + s)) / pi."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = math.ceil(bits * p + 3 * math.sqrt(bits * p * (1 - p)))
    size = min(OWN_BITS, max(TABLE_BITS, math.ceil(math.log2(max(nodes, 1))) - 7))
    n = math.ceil(math.log(MISSED) / math.log(1 - (1 - p) ** size))
    rng = np.random.default_rng(SEED)
    return radius, [np.sort(rng.permutation(bits)[:size]) for _ in range(n)]


def _spread(tables: list[np.ndarray], names: list[str]):
    """mapInArrow: a row of each node for each table; the number of a shard is the table's and the bits'."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            _, data = buffers(column(batch, "fp"))
            bit = np.unpackbits(data.reshape(batch.num_rows, -1), axis=1)
            rest = [column(batch, c) for c in names]
            for t, places in enumerate(tables):
                packed = np.zeros((batch.num_rows, 8), np.uint8)
                own = np.packbits(bit[:, places], axis=1)
                packed[:, : own.shape[1]] = own
                value = packed.view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - len(places))
                yield pa.RecordBatch.from_arrays([pa.array((value | np.uint64(t << OWN_BITS)).astype(np.int64)), *rest], ["part", *names])

    return run


def shards(nodes: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """Nodes (node, fp and more) by shard, sorted. What a shard has beyond HOT rows is cut by hash into pieces, each pair of which is a shard."""
    names = nodes.columns
    kinds = ", ".join(f"{c} {t}" for c, t in nodes.dtypes)
    put = lambda df: df.mapInArrow(_spread(tables, names), f"part long, {kinds}")
    some = put(nodes.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0)).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    hot = written(some.where(F.col("n") * SAMPLED > HOT).select("part", F.ceil(F.col("n") * SAMPLED / HOT).cast("int").alias("pieces")), "hot")
    out = put(nodes)
    if not hot.isEmpty():
        own = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
        both = out.join(hot, "part", "left").withColumn("own", own).withColumn("other", F.explode(F.when(F.col("pieces").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.expr("sequence(0, pieces - 1)"))))
        piece = F.xxhash64("part", F.least("own", "other"), F.greatest("own", "other")).bitwiseAND(F.lit((1 << OWN_BITS) - 1))
        part = F.when(F.col("pieces").isNull(), F.col("part")).otherwise(F.shiftleft(F.shiftright("part", OWN_BITS), OWN_BITS).bitwiseOR(piece))
        out = both.select(part.alias("part"), *names)
    return out.repartition("part").sortWithinPartitions("part", "fp")


def by_shard(work, most: int = ROWS):
    """mapInArrow: work(rows) for whole shards together, about `most` rows at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = column(batch, "part").to_numpy()
            cut = int(np.searchsorted(part, part[-1], "left"))
            rows = sum(b.num_rows for b in held)
            if cut and rows + cut >= most:
                yield work(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, batch = [], batch.slice(cut)
            elif held and rows >= most and column(held[-1], "part")[-1].as_py() != int(part[0]):
                yield work(pa.Table.from_batches(held))
                held = []
            held.append(batch)
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def _read(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = t.column("part").to_numpy()
    _, data = buffers(t.column("fp"))
    return t.column("node").to_numpy(), data.reshape(len(part), -1), np.flatnonzero(np.r_[True, part[1:] != part[:-1]])


def _links(node: np.ndarray, used: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([np.zeros(0, np.int64), *(u[side] for u in used)]) for side in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["u", "v"])


def forest_links(radius: int, leaf: int = 1):
    """A spanning forest of each shard's pairs within the radius."""

    def work(t: pa.Table) -> pa.RecordBatch:
        node, fp, first = _read(t)
        forest, used = Forest(len(node)), []

        def found(a, b, bits):
            order = np.argsort(bits, kind="stable")
            used.append(forest.link(a[order], b[order]))

        trie_join(fp, first, radius, found, lambda: [forest.roots()], leaf)
        return _links(node, used)

    return by_shard(work)


class FirstTable:
    """Whether a shard's table is the first in which two rows agree."""

    def __init__(self, t: pa.Table, tables: list[np.ndarray]):
        _, data = buffers(t.column("fp"))
        self.wide = data.reshape(t.num_rows, -1).view(np.uint64)
        self.table = t.column("part").to_numpy() >> OWN_BITS
        bits = np.zeros((len(tables), self.wide.shape[1] * 64), np.uint8)
        for row, places in zip(bits, tables, strict=True):
            row[places] = 1
        self.masks = np.packbits(bits, axis=1).view(np.uint64)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        apart, own = self.wide[a] ^ self.wide[b], self.table[a]
        out = np.ones(len(a), bool)
        for t in range(int(own.max(initial=0))):
            out &= (own <= t) | ((apart & self.masks[t]) != 0).any(1)
        return out


def meeting(radius: int, tables: list[np.ndarray]):
    """The rows of each shard that have one of another group (label) within the radius that they agree with in no table before."""

    def work(t: pa.Table) -> pa.RecordBatch:
        node, fp, first = _read(t)
        label, here = t.column("label").to_numpy(), FirstTable(t, tables)
        sure = -1 - np.arange(len(node))  # becomes 0 for those that have one

        def found(a, b, bits):
            new = (label[a] != label[b]) & ((sure[a] != 0) | (sure[b] != 0))
            a, b = a[new], b[new]
            new = here.holds(a, b)
            sure[a[new]] = sure[b[new]] = 0

        trie_join(fp, first, radius, found, lambda: [label, sure], LEAF)
        kept = t.filter(pa.array(sure == 0)).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in kept.columns], kept.column_names)

    return by_shard(work)


def verified_links(radius: int, similarity: float, tables: list[np.ndarray]):
    """Links between groups (label) of each shard: a spanning forest of the pairs within the radius, of this table first, whose sets (items) have the similarity."""

    def work(t: pa.Table) -> pa.RecordBatch:
        node, fp, first = _read(t)
        here = FirstTable(t, tables)
        label = np.unique(t.column("label").to_numpy(), return_inverse=True)[1]
        items = t.column("items").combine_chunks()
        begin = items.offsets.to_numpy().astype(np.int64)
        size = np.diff(begin)
        values = np.unique(items.values.to_numpy()[begin[0] : begin[-1]], return_inverse=True)[1].astype(np.int32)
        begin = begin - begin[0]
        own = np.zeros(int(values.max(initial=-1)) + 1, bool)
        forest, used = Forest(int(label.max()) + 1), []

        def found(a, b, bits):
            n, m = size[a], size[b]
            root = forest.roots()
            new = (root[label[a]] != root[label[b]]) & (np.minimum(n, m) + 1e-9 >= np.maximum(n, m) * similarity)
            a, b, bits = a[new], b[new], bits[new]
            new = here.holds(a, b)
            a, b, bits = a[new], b[new], bits[new]
            if not len(a):
                return
            order = np.lexsort((bits, a))
            a, b = a[order], b[order]
            edge = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            for x, y in zip(edge.tolist(), np.r_[edge[1:], len(a)].tolist(), strict=True):
                one, root = a[x], forest.roots()
                other = b[x:y][root[label[b[x:y]]] != root[label[one]]]
                if not len(other):
                    continue
                mine = values[begin[one] : begin[one] + size[one]]
                own[mine] = True
                n = size[other]
                lead = np.cumsum(n) - n
                at = np.arange(int(n.sum())) + np.repeat(begin[other] - lead, n)
                both = np.bincount(np.repeat(np.arange(len(other)), n), own[values[at]], len(other))
                own[mine] = False
                other = other[both * (1 + similarity) + 1e-9 >= (n + size[one]) * similarity]
                if len(other):
                    forest.link(np.full(len(other), label[one]), label[other])
                    used.append((np.full(len(other), one), other))

        trie_join(fp, first, radius, found, lambda: [forest.roots()[label]], LEAF)
        return _links(node, used)

    return by_shard(work, SET_ROWS)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (u, v): the smallest node reachable, for all nodes that have an edge to a smaller one.

    Large stars and small stars by turns; every round is a written table, so a lost executor costs one round. Tables of
    rounds that are over are deleted.
    """
    spark = edges.sparkSession

    def put(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_path(spark, "edges")
        df.write.parquet(path)
        return spark.read.schema("u long, v long").parquet(path), path

    e, path = put(edges.where("u != v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct())
    while True:
        parents = e.select("v").distinct()
        if e.groupBy("u").count().where("count > 1").isEmpty() and e.join(parents.withColumnRenamed("v", "u"), "u", "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = e.union(e.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").selectExpr("v as u", "m as v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").selectExpr("v as u", "m as v")
        e, last = put(small.union(least.selectExpr("u", "m as v")).distinct())
        dropped(spark, path)
        path = last


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 64, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its fingerprint and the smallest doc_id that links of `radius` bits or fewer reach from it. Exact."""
    if bits % 64:
        raise ValueError("bits must be a multiple of 64")
    prints = written(fingerprints(docs, shingle, bits, id_col, text_col), "fingerprints")
    # written, so that the join below has a shuffle on both sides and Spark can split a fingerprint that many share
    nodes = written(prints.groupBy("fp").agg(F.min("k").alias("node")), "nodes")
    edges = shards(nodes, block_tables(bits, radius, nodes.count())).mapInArrow(forest_links(radius), "u long, v long")
    classes = nodes.join(components(edges), "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return prints.join(classes, "fp").select(id_back(name=id_col), "fp", id_back("component", "component_id"))


def shingle_sets(docs: DataFrame, row, schema: str, size: int, bits: np.ndarray | None = None) -> DataFrame:
    """docs (k, text, at); row(k, sets) gives the columns of schema, for the different hashes of each text's shingles, sorted.
    bits: only of documents whose place is set."""
    held = docs.sparkSession.sparkContext.broadcast(bits) if bits is not None else None  # FILTER_BITS bits

    def run(batches):
        for batch in batches:
            if held is not None:
                at = column(batch, "at").to_numpy()
                batch = batch.filter(pa.array(((held.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)))
            for part in slices(batch, "text"):
                at, data = buffers(column(part, "text"))
                raw = lower_ascii(data).tobytes()
                sets = [np.unique(np.array(shingle_hashes(raw[a:b], size), np.uint64)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(row(column(part, "k"), sets), names)

    names = [c.split()[0] for c in schema.split(", ")]
    return docs.mapInArrow(run, schema)


def place(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))


def marked(ids: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits with the places of ids (node) set."""
    words = ids.select(place(F.col("node")).alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
    found, held = words.toArrow(), np.zeros(FILTER_BITS // 64, np.uint64)  # at most FILTER_BITS / 64 rows
    held[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return held


def set_digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with the smallest doc_id that links reach from it; a link is a pair of sets of shingles with a Jaccard similarity of `similarity` or more."""
    texts = keyed(docs, id_col, text_col).withColumn("at", place(F.col("k")))

    def marks(k, sets):
        return [k, pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([simhash(s, WIDE) for s in sets], pa.binary())]

    def whole(k, sets):
        ends = pa.array(np.cumsum([0, *map(len, sets)], dtype=np.int32))
        return [k, pa.array([set_digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))]

    prints = written(shingle_sets(texts, marks, "k long, d binary, fp binary", shingle), "fingerprints")
    # equal sets are one node, which its smallest document stands for
    nodes = written(prints.groupBy("d").agg(F.min("k").alias("node"), F.first("fp").alias("fp")), "nodes")
    radius, tables = bit_tables(WIDE, similarity, nodes.count())

    def sets_of(some: DataFrame) -> DataFrame:
        """(node, items) of the nodes of a written table."""
        asked = some.select("node").distinct()
        own = nodes.select("node", "d").join(asked, "node", "left_semi")
        sets = shingle_sets(texts, whole, "k long, d binary, items array<long>", shingle, marked(asked))
        return sets.join(own, [sets["d"] == own["d"], sets["k"] == own["node"]], "left_semi").dropDuplicates(["k", "d"]).select(F.col("k").alias("node"), "items")

    # rows that share a doc_id are one document
    ids = prints.groupBy("k").agg(F.min("d").alias("one"), F.max("d").alias("other")).where("one != other").select("k")
    shared = prints.join(ids, "k", "left_semi").join(nodes.select("d", "node"), "d").select("k", "node").distinct()
    edges = shared.groupBy("k").agg(F.min("node").alias("u")).join(shared, "k").select("u", F.col("node").alias("v"))
    first = shards(nodes.select("node", "fp"), tables[:FIRST_TABLES]).mapInArrow(forest_links(radius, LEAF), "u long, v long")
    pairs = written(first.selectExpr("least(u, v) as u", "greatest(u, v) as v").where("u != v").distinct(), "proposed")
    sets = written(sets_of(pairs.selectExpr("explode(array(u, v)) as node")), "sets")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("items").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("items").alias("b")), "v")
    enough = F.size(F.array_intersect("a", "b")) * (1 + similarity) + 1e-9 >= (F.size("a") + F.size("b")) * similarity
    edges = written(edges.union(both.where(enough).select("u", "v")), "links")

    labelled = nodes.select("node", "fp").join(components(edges), "node", "left").select("node", "fp", F.coalesce("component", "node").alias("label"))
    met = written(shards(labelled, tables).mapInArrow(meeting(radius, tables), "part long, node long, fp binary, label long"), "meeting")
    with_sets = met.join(sets_of(met), "node").select("part", "node", "fp", "label", "items")
    more = with_sets.repartition("part").sortWithinPartitions("part", "fp").mapInArrow(verified_links(radius, similarity, tables), "u long, v long")
    edges = written(edges.union(more.distinct()), "links")
    classes = nodes.join(components(edges), "node", "left").select("d", F.coalesce("component", "node").alias("component"))
    return prints.select("k", "d").join(classes, "d").select(id_back(name=id_col), id_back("component", "component_id"))


def brute(texts: dict[int, str | None], shingle: int = 3, radius: int = 3) -> dict[int, tuple[str, int]]:
    """Fingerprint and component of every document, the slow way; for tests."""
    fps = {}
    for k, t in texts.items():
        raw = lower_ascii(np.frombuffer((t or "").encode(), np.uint8)).tobytes()
        words = [w for w in raw.translate(bytes(32 if c in b"\t\n\v\f\r" else c for c in range(256))).split(b" ") if w]
        grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        hs = [xxhash.xxh64_intdigest(g, SEED) for g in grams]
        fps[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    label = {k: k for k in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if (fps[a] ^ fps[b]).bit_count() <= radius and label[b] < label[a]:
                    label[a], changed = label[b], True
    return {k: (f"{fps[k]:016x}", label[k]) for k in texts}


def brute_similar(texts: dict[int, str | None], size: int = 5) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """The component of every document and the links, from the similarity of every pair; for tests."""
    sets = {k: set(shingle_hashes("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode(), size)) for k, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    label = {k: k for k in texts}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label, links
