"""Near-duplicate documents by SetSketch registers.

A document is its set of distinct word shingles (64-bit hashes). Register j of its sketch is
floor(OFFSET - log_BASE(x_j)) truncated to 16 bits, x_j the least of exponential variables that
every shingle draws for j: registers of a union are the larger of both, and two documents
agree in a register about as often as their Jaccard similarity. Documents with equal sets become
one node. Nodes that share a band of ``rows`` registers are candidates; the bands are so
many that a pair at the threshold misses all of them with a chance of ``miss`` at most. Candidates
are estimated jointly, by the likelihood of J given both set sizes and how many registers are
greater, equal and less, and those not far below the threshold are confirmed on the full sets.

No bucket is expanded into all pairs. Its members first meet its least node. Where that leaves
several components in a bucket, the members of the others meet all of the one with most members
there (the hub), and what still differs then meets what else is in the bucket but the hub. So any two
nodes that share a bucket end in one component or have been compared on their full sets; nothing
is capped. These comparisons are made between blocks of about BLOCK nodes, or fewer of large sets, whose sets travel
once for each block they meet, and give at most one link for each component of a block.

Nulls: a null text is empty; empty texts have n_shingles 0 and are linked with nothing; a null
id is never the least unless all are null. Fewer words than ``shingle`` count as one
shingle. Repeated rows share a node. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.graph import components
from skein.llm.skew import join_counted
from skein.llm.store import cut
from skein.llm.text import LOWER, blocks, mix, run_hashes, window_hashes, word_bounds

BASE, OFFSET, TOP = 1.001, 8192, 65535
#: Nodes up to this count (of 40 bytes) are sent to all executors; more are joined by shuffle.
BROADCAST_NODES = 200_000
#: An estimate may lie this much below the threshold: five standard deviations of 112 registers.
SLACK = 0.2
#: Nodes, and shingles of their sets, that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 256, 1 << 21
SMALL = 16


def n_bands(similarity: float, rows: int, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


def block_sets(data: np.ndarray, offs: np.ndarray, shingle: int, seed: int = 0) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offs)
    words = run_hashes(data, starts, ends, seed)
    runs = window_hashes(words, shingle, 1)
    out = []
    for s, e in zip(first[:-1], first[1:]):
        if e - s >= shingle:
            out.append(np.unique(runs[s : e - shingle + 1]))
        elif e > s:
            out.append(run_hashes(words, np.array([s]), np.array([e]), 2))
        else:
            out.append(words[:0])
    return out


def node_names(sets: list[np.ndarray], data: np.ndarray, offs: np.ndarray, shingle: int) -> list[bytes | None]:
    """128 bits that stand for each set; None for an empty one.

    Two sums over mixed shingle hashes; for small sets, where one shingle decides, the second sum is over hashes from
    words hashed anew.
    """
    small = [i for i, s in enumerate(sets) if 0 < len(s) <= SMALL]
    again = list(sets)
    if small:
        parts = [data[offs[i] : offs[i + 1]] for i in small]
        for i, s in zip(small, block_sets(np.concatenate(parts), np.cumsum([0, *map(len, parts)]), shingle, 3)):
            again[i] = s
    return [np.array([mix(s).sum(dtype=np.uint64), mix(t ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes() if len(s) else None for s, t in zip(sets, again)]


def registers(sets: list[np.ndarray], count: int) -> np.ndarray:
    """One row of registers for each set; of an empty set all are 0."""
    draw = np.random.default_rng(20240229)
    a, b = draw.integers(0, 1 << 63, (2, count), np.uint64)
    a = a * np.uint64(2) + np.uint64(1)
    full = [i for i, s in enumerate(sets) if len(s)]
    out = np.zeros((len(sets), count), np.uint16)
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    heads = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    least, buf = np.empty((len(full), count), np.uint64), np.empty_like(flat)
    for j in range(count):
        np.multiply(flat, a[j], out=buf)
        np.add(buf, b[j], out=buf)
        least[:, j] = np.minimum.reduceat(buf, heads)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
    with np.errstate(divide="ignore"):
        out[full] = np.clip(np.floor(OFFSET - np.log(x) / math.log(BASE)), 0, TOP).astype(np.uint16)
    return out


def estimate(greater: np.ndarray, equal: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 200) -> np.ndarray:
    """The J of greatest likelihood for each pair.

    With sizes a and b as shares u and v of a + b, register counts are multinomial with chances
    u - vJ (greater), v - uJ (less) and J (equal), as the base is close to 1.
    """
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(1e-6, 1, steps + 1)[None, :] * np.minimum(u / v, v / u)
    tiny = 1e-9
    like = greater[:, None] * np.log(np.maximum(u - v * j, tiny)) + less[:, None] * np.log(np.maximum(v - u * j, tiny)) + equal[:, None] * np.log(j)
    best = like.argmax(axis=1)
    return j[np.arange(len(best)), best]


def _sketch(shingle: int, count: int):
    def run(batches):
        for batch in batches:
            for x, y, data, offs in blocks(batch.column("text")):
                sets = block_sets(data, offs, shingle)
                regs = registers(sets, count)
                nodes = node_names(sets, data, offs, shingle)
                part = batch.slice(x, y - x)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("k1"), part.column("k2"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())],
                    ["doc_id", "k1", "k2", "n", "node", "regs"],
                )

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            for x, y, data, offs in blocks(batch.column("text")):
                sets = block_sets(data, offs, shingle)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(x, y - x), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "items"])

    return run


def _likely(least: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("regs_a", "regs_b"))
            n_a, n_b = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
            j = estimate((p > q).sum(1), (p == q).sum(1), (p < q).sum(1), n_a, n_b)
            yield batch.filter(pa.array(j >= least)).select(["a", "b"])

    return run


def _shared_counts(p: list[np.ndarray], q: list[np.ndarray], width: int = 1 << 13) -> np.ndarray:
    """Sizes of the intersections of every set of p with every set of q."""
    common = np.intersect1d(np.concatenate(p), np.concatenate(q))
    out = np.zeros((len(p), len(q)))
    for a in range(0, len(common), width):
        part = common[a : a + width]
        sides = []
        for sets in (p, q):
            dense = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
                at = np.minimum(np.searchsorted(part, s), len(part) - 1)
                dense[i, at[part[at] == s]] = 1
            sides.append(dense)
        out += sides[0] @ sides[1].T
    return out


def _compared(percent: int):
    """Links between rows of the two sides (side 2: of both) that lie in different components."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        side = rows.column("side").to_numpy()
        comp, node = rows.column("comp").to_pylist(), rows.column("node").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("items").to_pylist()]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        a, b = [], []
        if len(left) and len(right):
            both = _shared_counts([sets[i] for i in left], [sets[i] for i in right])
            n = np.array([len(s) for s in sets], np.float64)
            union = n[left][:, None] + n[right][None, :] - both
            root = {c: c for c in comp}

            def top(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for i, j in zip(*np.nonzero(100 * both >= percent * union)):
                x, y = top(comp[left[i]]), top(comp[right[j]])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(node[left[i]])
                    b.append(node[right[j]])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


class _Links:
    """Compares the full sets of groups of nodes; a set is made once."""

    def __init__(self, rows: DataFrame, reps: DataFrame, shingle: int, percent: int):
        self.rows, self.reps, self.shingle, self.percent = rows, reps, shingle, percent

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose estimate is not far below the threshold."""
        side = lambda x: self.reps.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
        # sets whose sizes alone rule the threshold out need no estimate
        sized = pairs.join(side("a"), "a").join(side("b"), "b").where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(self.percent) * F.greatest("n_a", "n_b"))
        return cut(sized.mapInArrow(_likely(self.percent / 100 - SLACK), pairs.select("a", "b").schema), "likely")

    def sets(self, nodes: DataFrame) -> DataFrame:
        needed = cut(self.reps.join(nodes.select("node").distinct(), "node", "left_semi").select("node", "least.*"), "needed")
        if needed.count() <= BROADCAST_NODES:
            needed = F.broadcast(needed)
        left = self.rows.select("text", "k1", "k2", F.col("doc_id").alias("own"))
        texts = left.join(needed, ["k1", "k2"]).where(F.col("own").eqNullSafe(F.col("doc_id"))).select("node", "text")
        return texts.mapInArrow(_sets(self.shingle), "node binary, items binary").dropDuplicates(["node"])

    def grouped(self, rows: DataFrame) -> DataFrame:
        """rows: g, i, j, side, node, comp; a task for each (g, i, j)."""
        rows = cut(rows, "blocks")
        found = rows.join(self.sets(rows), "node").groupBy("g", "i", "j").applyInArrow(_compared(self.percent), "a binary, b binary")
        return cut(found, "links")

    def across(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """left and right: g, node, comp; links between the two sides of each g."""
        left, right = cut(self.sized(left), "left"), cut(self.sized(right), "right")
        sizes = left.groupBy("g").agg(_blocks().alias("p"), F.count("*").alias("n_left")).join(right.groupBy("g").agg(_blocks().alias("q"), F.count("*").alias("n_right")), "g")
        sizes = cut(sizes, "sizes")
        own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        a = join_counted(left, sizes, ["g"], "n_left", left.count()).select("g", own(F.col("p")).alias("i"), every("q").alias("j"), F.lit(0).alias("side"), "node", "comp")
        b = join_counted(right, sizes, ["g"], "n_right", right.count()).select("g", every("p").alias("i"), own(F.col("q")).alias("j"), F.lit(1).alias("side"), "node", "comp")
        return self.grouped(a.unionByName(b))

    def within(self, rows: DataFrame) -> DataFrame:
        """rows: g, node, comp; links between any two of each g."""
        rows = cut(self.sized(rows), "within")
        sizes = cut(rows.groupBy("g").agg(_blocks().alias("p"), F.count("*").alias("n_rows")), "sizes")
        own = F.pmod(F.xxhash64("node"), F.col("p")).cast("int")
        each = join_counted(rows, sizes, ["g"], "n_rows", rows.count()).withColumn("o", own).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
        return self.grouped(each.select("g", F.least("o", "t").alias("i"), F.greatest("o", "t").alias("j"), F.lit(2).alias("side"), "node", "comp"))

    def sized(self, rows: DataFrame) -> DataFrame:
        return rows.select("g", "node", "comp").join(self.reps.select("node", F.col("n").alias("size")), "node")


def _blocks():
    """Blocks of a group: by its nodes, and by the shingles of their sets."""
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")


def _ordered(pairs: DataFrame, x, y) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b").distinct()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})


def _classes(texts: DataFrame, shingle: int, percent: int, rows: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """The sketch of each row, and each node's representative (least) and component (comp)."""
    bands = n_bands(percent / 100, rows, miss)
    kind = texts.schema["doc_id"].dataType.simpleString()
    sketches = cut(texts.select("doc_id", "k1", "k2", "text").mapInArrow(_sketch(shingle, bands * rows), f"doc_id {kind}, k1 long, k2 long, n long, node binary, regs binary"), "sketch")
    reps = sketches.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("least"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    reps = cut(reps, "reps")

    keys = F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(regs, {2 * rows * i + 1}, {2 * rows})")) for i in range(bands)])
    placed = reps.select("node", F.explode(keys).alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("centre")).where("size > 1")
    members = cut(placed.join(shared, "bucket"), "members")

    links_of = _Links(texts, reps, shingle, percent)
    stars = links_of.likely(_ordered(members, "node", "centre"))
    centres = stars.select(F.col("a").alias("g"), F.col("a").alias("node"), F.col("a").alias("comp")).distinct()
    links = links_of.across(centres, stars.select(F.col("a").alias("g"), F.col("b").alias("node"), F.col("b").alias("comp")))
    found = components(links)

    labelled = lambda rows: rows.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = cut(labelled(members.select("bucket", "node", "size").where("size > 2")), "placed")
    hubs = placed.groupBy("bucket", "comp").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("x"), F.count("*").alias("comps")).where("comps > 1")
    hubs = cut(hubs.select("bucket", F.col("x.comp").alias("g")), "hubs")
    mixed = cut(placed.join(hubs, "bucket").where("comp <> g"), "mixed")
    if not mixed.isEmpty():
        right = cut(mixed.select("g", "node", "comp").distinct(), "right")
        left = placed.select(F.col("comp").alias("g"), "node", "comp").distinct().join(right.select("g").distinct(), "g", "left_semi")
        links = links.unionByName(links_of.across(left, right))
        # what is in a bucket beside its hub; buckets with the same rest are one group
        alike = mixed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("comp").alias("p"), F.max("comp").alias("q"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(38,0)")).alias("y")).where("p <> q")
        alike = alike.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
        rest = cut(mixed.join(alike, "bucket", "left_semi").select(F.col("bucket").alias("g"), "node", "comp"), "rest")
        if not rest.isEmpty():
            links = links.unionByName(links_of.within(rest))
        found = components(links)

    return sketches, reps.select("node", "least").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, rows: int = 4, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable) and kept for each row of docs."""
    sketches, named = _classes(_keyed(docs, id_col, text_col), shingle, percent, rows, miss)
    least = named.groupBy("comp").agg(F.min("least.doc_id").alias("component_id"))
    ids = named.join(least, "comp").select("node", "component_id", F.lit(True).alias("known"))
    out = sketches.select("doc_id", "node", F.col("n").alias("n_shingles")).join(ids, "node", "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, rows: int = 4, miss: float = 1e-6) -> DataFrame:
    """The rows of docs, with all their columns, of one document of each component; empty texts stay."""
    keyed = _keyed(docs, id_col, text_col)
    sketches, named = _classes(keyed, shingle, percent, rows, miss)
    best = named.groupBy("comp").agg(F.min("least").alias("x")).select("x.k1", "x.k2", "x.doc_id", F.lit(True).alias("one"))
    empty = sketches.where("n = 0").select("k1", "k2", "doc_id", F.lit(False).alias("one")).distinct()
    kept = best.unionByName(empty).withColumnRenamed("doc_id", "kept_id")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows_ = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("own_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))
    out = rows_.join(kept, ["k1", "k2"]).where(F.col("own_id").eqNullSafe(F.col("kept_id")))
    # a row that is there several times, id and all, stays once
    order = Window.partitionBy("k1", "k2", "own_id").orderBy(F.lit(0))
    out = out.withColumn("nth", F.row_number().over(order)).where("nth = 1 or not one")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM d WHERE len(w) > 1)
       UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""
