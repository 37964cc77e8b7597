r"""Near-duplicate detection by b-bit MinHash, confirmed on full shingle sets.

1. One pass over the texts gives each document its number of distinct shingles of ``size`` words, a 128-bit hash
   of the set, and ``BANDS`` band keys of ``ROWS`` minima each. With ideal hash functions a pair at similarity 0.8 misses
   every band with probability 7e-6; README has the recall as measured. Documents with the same set form a class; only its smallest doc_id goes on.
2. Candidates: each class is tied to the smallest one in each of its buckets (a star, never all pairs);
   the connected components of these ties are candidate groups. All pairs that share a band lie within groups.
3. Within a group, the low ``BITS`` bits of the minima are packed; a pair's similarity is estimated from
   the equal positions, corrected for chance collisions; what reaches 0.8 less 4.5 standard deviations (about 3 in a
   million at 0.8 don't) is confirmed on the full sets (64-bit shingle hashes), unless the two are already connected.
   A task returns spanning ties only, so its output is linear.
4. Groups of more than ``BLOCK`` shingles are cut into blocks by hash. Each block gets the same few
   anchor documents, so the parts of a large group connect through them. Then each document outside the
   group's largest component (as a rule a few) is compared with the blocks that hold a document with one of its band
   keys. A pair that isn't yet connected always has a member outside that component, so of the pairs that share a band
   none is left out, whatever the group's size.
5. Components of all ties; a document is kept if it has the smallest doc_id.

Empty and null texts have an empty set and are linked with nothing. Rows without a doc_id are linked
with nothing and kept, with a null component. Repeated rows are copies; ids that repeat with other
texts are separate documents (classes with the same smallest id count as one). An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BANDS, ROWS, BITS, SIGNED = 30, 5, 4, 128
PERCENT, BLOCK, ANCHORS = 80, 131_072, 4
#: Words to a shingle: of op8's contract, and for corpora.
CONTRACT_SIZE, SIZE = 2, 5
#: Ties to a task while components are found: rounds over few ties don't write files for many partitions.
TIES_PER_TASK = 50_000
#: Tables of so many rows at most, as counted, are broadcast: then the ties of a hub needn't meet in one task.
BROADCAST_ROWS = 1_000_000
_RNG = np.random.default_rng(20)
_A = (_RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_ODD = _RNG.integers(0, 1 << 62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MARGIN = 4.5 * (0.8 * 0.2 / SIGNED) ** 0.5


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = CONTRACT_SIZE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `size` words (fewer words: all of them as one)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = max(1, min(size, len(w)))
    many = len(w) - size + 1
    h = w[:many]
    for k in range(1, size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + _mix(w[k : k + many])
    return np.unique(_mix(h + np.uint64(size - 1)))


def minima(s: np.ndarray) -> np.ndarray:
    """The minima of a set under all permutations."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(best, (low[at : at + 512, None] * _A + _B).min(0), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    parts = best.reshape(BANDS, ROWS).astype(np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(1 << 33)
    return _mix((_mix(parts) * _ODD).sum(1, dtype=np.uint64)).view(np.int64)


def packed(best: np.ndarray) -> np.ndarray:
    """The low bits of the first minima, 16 to a word."""
    low = (best[:SIGNED] & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarities of a packed signature to others, corrected for collisions."""
    x = many ^ one
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    x &= np.uint64(0x1111111111111111)
    same = SIGNED - np.bitwise_count(x).sum(1, dtype=np.int64)
    by_chance = 1 / (1 << BITS)
    return (same / SIGNED - by_chance) / (1 - by_chance)


class Ties:
    """Union-find over a block; the root is the smallest id."""

    def __init__(self, ids: list[int]):
        self.ids, self.up = ids, np.arange(len(ids))

    def tie(self, i: int, j: int) -> None:
        a, b = self.up[i], self.up[j]
        if a != b:
            if self.ids[a] > self.ids[b]:
                a, b = b, a
            self.up[self.up == b] = a


def link(i: int, among: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, sigs: np.ndarray, ties: Ties) -> None:
    """Ties i to each of `among` that it is similar to and not yet connected with."""
    among = among[(ties.up[among] != ties.up[i]) & (100 * np.minimum(sizes[among], sizes[i]) >= PERCENT * np.maximum(sizes[among], sizes[i]))]
    if not len(among):
        return
    est = estimate(sigs[i], sigs[among])
    near = est >= PERCENT / 100 - _MARGIN
    among = among[near][np.argsort(-est[near], kind="stable")]
    first = True
    while len(among):
        part = among[:4] if first else among[:512]
        among, first = among[len(part) :], False
        rows = np.concatenate([sets[j] for j in part])
        at = np.searchsorted(sets[i], rows)
        at[at == len(sets[i])] = 0
        ends = np.cumsum(sizes[part])
        both = np.add.reduceat((sets[i][at] == rows).astype(np.int64), np.concatenate([[0], ends[:-1]]))
        for j in part[100 * both >= PERCENT * (sizes[part] + sizes[i] - both)]:
            ties.tie(i, j)
        among = among[ties.up[among] != ties.up[i]]


def solve(ids: list[int], sets: list[np.ndarray], probes: int = 0, known: list[int] | None = None) -> Ties:
    """Connects a block. With probes, only the last `probes` documents are compared with the others, which
    are connected already where `known` agrees."""
    ties = Ties(ids)
    sizes = np.array([len(s) for s in sets])
    sigs = np.stack([packed(minima(s)) for s in sets])
    n = len(ids)
    if known is not None:
        firsts: dict[int, int] = {}
        for k, c in enumerate(known):
            ties.tie(firsts.setdefault(c, k), k)
    for i in range(n - probes, n) if probes else range(1, n):
        link(i, np.arange(n - probes if probes else i), sets, sizes, sigs, ties)
    return ties


def _signatures(documents: DataFrame, size: int) -> DataFrame:
    schema = "doc_id long, n long, h1 long, h2 long, bands array<bigint>"

    def run(batches):
        for b in common.portions(batches):
            n, h1, h2, bands = [], [], [], []
            for text in b.column("text"):
                s = shingles(text.as_py(), size)
                n.append(len(s))
                h1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                h2.append(int(np.bitwise_xor.reduce(_mix(s)).view(np.int64)) if len(s) else 0)
                bands.append(band_keys(minima(s)) if len(s) else np.zeros(0, np.int64))
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in bands])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *bands])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), flat], ["doc_id", "n", "h1", "h2", "bands"])

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) ties to (v, root): root is the smallest id of v's component; ids without ties don't occur.

    Alternates stars around larger and smaller neighbours until nothing changes; each round is cut.
    """
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = common.cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(edges)
    while seen[0]:
        tasks = -(-seen[0] // TIES_PER_TASK)  # follows the ties; more than there are partitions changes nothing
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = F.broadcast(least) if seen[0] <= BROADCAST_ROWS else least  # a row for each end of a tie at most
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(edges.join(least, F.col("a") == F.col("u")).select("a", F.col("m").alias("b"))).where("a != b").coalesce(2 * tasks).distinct().coalesce(tasks)
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        low = F.broadcast(low) if seen[0] <= BROADCAST_ROWS // 2 else low  # large has two rows for a tie at most
        small = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = common.cut(small.where("a != b").coalesce(2 * tasks).distinct().coalesce(tasks))
        now = state(edges)
        if now == seen:
            break
        seen = now
    # both ends of each tie, dealt by vertex as the joins to come need them
    return edges.select(F.explode(F.array("a", "b")).alias("v"), "b").groupBy("v").agg(F.min("b").alias("root"))


def _blocks(members: DataFrame, probing: bool, size: int) -> DataFrame:
    """Runs `solve` on each (gid, block): rows (rep, root)."""

    def run(batches):
        key, ids, sets, known, probes = None, [], [], [], 0

        def flush():
            if len(ids) < 2 or probing and not probes:
                return []
            ties = solve(ids, sets, probes, known if probing else None)
            return [(ids[k], ids[r]) for k, r in enumerate(ties.up) if ids[k] != ids[r]]

        def batch(rows):
            a, b = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        out = []
        for b in common.portions(batches):
            cols = [b.column(c).to_pylist() for c in ("gid", "block", "rep", "root", "role", "text")]
            for gid, block, rep, root, role, text in zip(*cols):
                if (gid, block) != key:
                    out += flush()
                    key, ids, sets, known, probes = (gid, block), [], [], [], 0
                elif probing and role and probes >= 256:  # probes come after the base, in portions
                    out += flush()
                    keep = len(ids) - probes
                    ids, sets, known, probes = ids[:keep], sets[:keep], known[:keep], 0
                ids.append(rep)
                sets.append(shingles(text, size))
                known.append(root)
                probes += role
            if len(out) >= 5000:
                yield batch(out)
                out = []
        out += flush()
        if out:
            yield batch(out)

    laid = members.select("gid", "block", "rep", "root", "role", "text").repartition("gid", "block").sortWithinPartitions("gid", "block", "role", "rep")
    return laid.mapInArrow(run, "a long, b long")


def _ties(documents: DataFrame, sigs: DataFrame, block: int, size: int) -> DataFrame | None:
    """(v, root) of all classes that are linked with another; v and root are smallest doc_ids of classes."""
    classes = sigs.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    keys = classes.select("rep", F.explode("bands").alias("key"))
    full = keys.groupBy("key").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("key").alias("k2"), "low")
    stars = keys.join(full, F.col("key") == F.col("k2")).select(F.col("rep").alias("a"), F.col("low").alias("b"))
    groups = components(stars).withColumnRenamed("root", "gid")
    sized = groups.join(classes.select("rep", "n").groupBy("rep").agg(F.max("n").alias("n")), F.col("v") == F.col("rep"))
    picks = [F.min(F.struct(F.xxhash64("rep", F.lit(k)), F.col("rep"))).getField("rep").alias(f"a{k}") for k in range(ANCHORS)]
    whole = sized.groupBy(F.col("gid").alias("g")).agg(F.ceil(F.sum("n") / block).cast("int").alias("nb"), F.array_distinct(F.array(*picks)).alias("anchors"))
    placed = sized.join(whole, F.col("gid") == F.col("g"))
    own = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")
    placed = placed.select("rep", "gid", "nb", own.alias("own"), (F.array_contains("anchors", F.col("rep")) & (F.col("nb") > 1)).alias("anchor"))
    texts = documents.select(F.col("doc_id").alias("id"), "text")
    texts = common.cut(texts.join(placed, F.col("id") == F.col("rep")).drop("id"))
    spread = F.when(F.col("anchor"), F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array("own"))
    first = _blocks(texts.withColumn("block", F.explode(spread)).withColumns({"root": F.lit(0).cast("long"), "role": F.lit(0)}), False, size)
    first = common.cut(first)
    roots = common.cut(components(first))
    large = texts.where("nb > 1").select("rep", "gid", "nb", "own").distinct().join(roots, F.col("rep") == F.col("v"), "left").select("rep", "gid", "nb", "own", F.coalesce("root", "rep").alias("root"))
    large = common.cut(large)
    counts = large.groupBy("gid", "root").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy(F.col("gid").alias("g")).agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    if not main.limit(1).count():
        return roots
    texts = texts.where("nb > 1").select("rep", "text").join(large.join(main, F.col("gid") == F.col("g")).select(F.col("rep").alias("id"), "gid", "nb", "own", "root", "main"), F.col("rep") == F.col("id"))
    base = texts.select("rep", "gid", F.col("own").alias("block"), "root", F.lit(0).alias("role"), "text")
    # the blocks to ask: those with a document under one of the probe's band keys
    held = keys.join(large.join(main, F.col("gid") == F.col("g")).select(F.col("rep").alias("id"), "gid", "own", (F.col("root") != F.col("main")).alias("asks")), F.col("rep") == F.col("id"))
    homes = held.select(F.col("gid").alias("g"), F.col("key").alias("k2"), F.col("own").alias("block")).distinct()
    asked = held.where("asks").join(homes, (F.col("gid") == F.col("g")) & (F.col("key") == F.col("k2"))).select(F.col("id").alias("probe_id"), "block").distinct()
    probe = texts.where("root != main").join(asked, F.col("rep") == F.col("probe_id")).select("rep", "gid", "block", "root", F.lit(1).alias("role"), "text")
    more = _blocks(base.unionByName(probe), True, size)
    tied = roots.select(F.col("v").alias("a"), F.col("root").alias("b"))
    return components(tied.unionByName(more))


def groups(documents: DataFrame, block: int = BLOCK, size: int = CONTRACT_SIZE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    sigs = common.cut(_signatures(documents, size))
    classes = sigs.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    roots = _ties(documents, sigs, block, size)
    known = classes.join(roots, F.col("rep") == F.col("v"), "left").where("copies > 1 OR root IS NOT NULL")
    known = known.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.coalesce("root", "rep").alias("class_root"))
    out = sigs.select("doc_id", "n", "h1", "h2").join(known, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    root = F.coalesce("class_root", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, block: int = BLOCK, size: int = SIZE) -> DataFrame:
    """documents, one of each group (that with the smallest doc_id); rows that repeat it stay."""
    gone = groups(documents, block, size).where("NOT kept").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
