"""Near-duplicate documents: banded MinHash, sequential Bayesian verification, exact confirmation, components.

1. A document is the set of 64-bit hashes of its word shingles. Documents with one set are one node: copies, however
   many, are collapsed before anything is compared.
2. Nodes with an equal band of MinHash values meet in a bucket. A pair at the threshold shares no band with a
   probability of (1 - threshold ** ROWS) ** BANDS, under 1e-5.
3. In each bucket the node that meets most others, the pivot, is paired with the others, so pairs grow with the bucket and not with its square.
   Pairs are compared by batches of signature values: after each batch a pair goes if the posterior probability (uniform
   prior) that it reaches the threshold is under MISS. What survives is confirmed on the full sets.
4. Components of confirmed links (large-star, small-star). Where members of one bucket are still in different components,
   those outside the largest are compared with the others of their pivot's group, in blocks of CHUNK by CHUNK: batches of
   signatures first; sets go only to the blocks where a pair survives, which is compared exactly, and only links that join
   something are returned. Of a group of over GROUP nodes
   only members are compared that have one of their rarest shingles in common, as two sets at the threshold do: a passage
   that very many documents share pairs none of them. So every pair of a bucket is compared, excluded or already joined.

Null, empty and blank texts have the empty set and no links: each is its own component. A null id is ignored in the
smallest id of a component. Rows that repeat are in one component. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weighbridge.llm import common

SHINGLE = 4
PER_CENT = 80
BANDS = 30
ROWS = 5
BATCH = 30
MISS = 1e-6
#: Nodes on a side of a block that is compared in memory, and nodes up to which a pivot's group is cut into blocks as it is.
CHUNK = 512
GROUP = 20_000
#: Ways to spread the rows of a pivot.
SALTS = 64
#: Characters of text that are hashed at once.
PIECE = 1 << 19
HASHER = common.Hasher()
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
FACTORS = common.mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_SEEDS = common.mixed(np.arange(1000, 1000 + 2 * BANDS * ROWS, dtype=np.uint64))
TIMES, PLUS = (_SEEDS[: BANDS * ROWS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_SEEDS[BANDS * ROWS :] >> np.uint64(32)).astype(np.uint32)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a text with fewer words is one shingle; none without words."""
    raw = [t.encode().translate(LOWER) for t in texts]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    blank = BLANK[data]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = HASHER.sums(data)
    words = HASHER.windows(sums, start, end - start)[0]
    upto = np.searchsorted(start, np.cumsum([len(r) + 1 for r in raw]))
    out, a = [], 0
    joined = words[: max(0, len(words) - width + 1)] * FACTORS[0]
    for k in range(1, width):
        joined = joined + words[k : k + len(joined)] * FACTORS[k]
    joined = common.mixed(joined)
    for z in upto.tolist():
        n = z - a
        if n >= width:
            out.append(np.unique(joined[a : z - width + 1]))
        elif n:
            short = int(np.sum(words[a:z] * FACTORS[:n], dtype=np.uint64)) + n
            out.append(common.mixed(np.array([short & (2**64 - 1)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        a = z
    return out


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    a = int(np.sum(common.mixed(found + np.uint64(0x51ED2701)), dtype=np.uint64))
    b = int(np.bitwise_xor.reduce(common.mixed(found ^ np.uint64(0x2545F4914F6CDD1D)))) if len(found) else 0
    return a - (1 << 63), ((b + len(found)) & (2**64 - 1)) - (1 << 63)


def signature(found: np.ndarray) -> np.ndarray:
    low = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 512):  # a block of values stays in the cache
        out = np.minimum(out, (low[a : a + 512, None] * TIMES + PLUS).min(axis=0))
    return out


def sig_bytes(sig: np.ndarray) -> np.ndarray:
    """A byte of each value, of all of its bits: the top bits of a least hash are zero for all long texts."""
    return (common.mixed(sig.astype(np.uint64) + TIMES) >> np.uint64(56)).astype(np.uint8)


def band_keys(sig: np.ndarray) -> np.ndarray:
    keyed = sig.reshape(BANDS, ROWS).astype(np.uint64) * FACTORS[:ROWS]
    return common.mixed(keyed.sum(axis=1, dtype=np.uint64) + FACTORS[10 : 10 + BANDS]).view(np.int64)


def least_matches(threshold: float, miss: float = MISS, batch: int = BATCH, total: int = BANDS * ROWS) -> dict[int, int]:
    """For each number n of compared values, the fewest matches with which a pair may still reach the threshold.
    Values are compared by one byte each, so unequal ones match with a probability of 1/256."""
    s = np.linspace(1e-6, 1 - 1e-6, 20001)
    q = s + (1 - s) / 256
    out = {}
    for n in range(batch, total + 1, batch):
        for m in range(n + 1):
            like = m * np.log(q) + (n - m) * np.log1p(-q)
            like = np.exp(like - like.max())
            if like[s >= threshold].sum() / like.sum() >= miss:
                out[n] = m
                break
    return out


def survivors(a: list[bytes], b: list[bytes], least: dict[int, int]) -> np.ndarray:
    """Which pairs of signatures are still in after the last batch."""
    x, y = (np.frombuffer(b"".join(z), np.uint8).reshape(-1, BANDS * ROWS) for z in (a, b))
    alive, found, at = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for n, m in least.items():
        found = found + (x[alive, at:n] == y[alive, at:n]).sum(axis=1)
        keep = found >= m
        alive, found, at = alive[keep], found[keep], n
    out = np.zeros(len(x), bool)
    out[alive] = True
    return out


def linked(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= per_cent * (len(a) + len(b) - both)


def _measure(key: str, text: str, width: int, kind: pa.DataType):
    schema = pa.schema([(key, kind), ("n_shingles", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, texts in common.blocks_of(batches, key, text, PIECE):
            rows = []
            for k, found in zip(keys, shingle_sets(texts, width), strict=True):
                if len(found):
                    sig = signature(found)
                    rows.append((k, len(found), *fingerprint(found), band_keys(sig), sig_bytes(sig).tobytes()))
                else:
                    rows.append((k, 0, None, None, None, None))
            yield common.batch(schema, rows)

    return run


def _sets(key: str, text: str, width: int):
    """Texts of candidate nodes to (node, sets); a row whose set isn't the node's, under a repeated id, is left out."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("node", "hi", "lo", text)]
            for a in range(0, b.num_rows, 64):
                nodes, hi, lo, texts = (c[a : a + 64] for c in columns)
                found = shingle_sets([t or "" for t in texts], width)
                yield common.batch(schema, [(n, s.tobytes()) for n, h, o, s in zip(nodes, hi, lo, found, strict=True) if (h, o) == fingerprint(s)])

    return run


def _own_sets(width: int):
    """Texts to (hi, lo, shingles): for rows that their id does not tell apart."""
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("shingles", pa.binary())])

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 64):
                found = shingle_sets([t or "" for t in b.column("_text").slice(a, 64).to_pylist()], width)
                yield common.batch(schema, [(*fingerprint(s), s.tobytes()) for s in found if len(s)])

    return run


def _sets_of(wanted: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """wanted(node, hi, lo, id), texts(of, _text) to (node, shingles). A class finds its text by its smallest id. Where that is
    null, or that of several classes, each of their texts is hashed once and meets its class by the fingerprint: n texts of
    one id are n sets, not n by n. Texts are joined by a shuffle at every size, so figures of small tables tell about large ones."""
    several = common.written(wanted.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select(F.col("id").alias("odd")), "odd")
    by_id = "node long, shingles binary"
    if several.isEmpty():
        return wanted.join(texts.hint("merge"), F.col("id") == F.col("of")).select("node", "hi", "lo", "_text").mapInArrow(_sets("node", "_text", width), by_id).dropDuplicates(["node"])
    odd = common.small(several, 64 + (several.agg(F.max(F.octet_length(F.col("odd").cast("string")))).first()[0] or 0))
    one = wanted.join(odd, F.col("id").eqNullSafe(F.col("odd")), "left_anti").join(texts.hint("merge"), F.col("id") == F.col("of"))
    plain = one.select("node", "hi", "lo", "_text").mapInArrow(_sets("node", "_text", width), by_id)
    own = texts.join(odd, F.col("of").eqNullSafe(F.col("odd")), "left_semi").select("_text").mapInArrow(_own_sets(width), "hi long, lo long, shingles binary").dropDuplicates(["hi", "lo"])
    rest = wanted.join(odd, F.col("id").eqNullSafe(F.col("odd")), "left_semi").join(own, ["hi", "lo"]).select("node", "shingles")
    return plain.unionByName(rest).dropDuplicates(["node"])


def _prune(threshold: float):
    least = least_matches(threshold)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array(survivors(b.column("sig_a").to_pylist(), b.column("sig_b").to_pylist(), least))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], schema=schema)

    return run


def _confirm(per_cent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("set_a"), b.column("set_b")
            keep = pa.array([linked(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64), per_cent) for i in range(b.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], schema=schema)

    return run


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, 256):
            c = b.slice(a, 256)
            found = [np.frombuffer(x, np.int64) for x in c.column("shingles").to_pylist()]
            n = np.array([len(x) for x in found], np.int64)
            at = pa.array(np.repeat(np.arange(len(n)), n))
            columns = [c.column(x).take(at) for x in ("pivot", "node", "root")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(n, n)), pa.array(np.concatenate([np.empty(0, np.int64), *found]))], ["pivot", "node", "root", "n", "part"])


def _prefixes(found: DataFrame, per_cent: int) -> DataFrame:
    """found(pivot, node, root, shingles) to (pivot, part, node, root): of each set the shingles (parts) that fewest sets of
    its pivot have, so many that two sets at the threshold share one. What very many documents have in common drops out."""
    rows = found.select("pivot", "node", "root", "shingles").mapInArrow(_explode, "pivot long, node long, root long, n long, part long")
    rows = common.written(rows, "exploded")
    often = rows.groupBy("pivot", "part").agg(F.count("*").alias("often")).where("often > 1")
    order = Window.partitionBy("pivot", "node").orderBy(F.coalesce("often", F.lit(1)), "part")
    ranked = rows.join(often, ["pivot", "part"], "left").withColumn("at", F.row_number().over(order))
    first = ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * per_cent / 100) + 1)
    return common.written(first.where("often > 1").select("pivot", "part", "node", "root"), "prefixes")


def _met(group: pa.Table, least: dict[int, int], per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a block, nodes outside the largest component (side 1) with nodes of the group (side 0), that are in
    different components, near enough in size, and still in after the last batch of signature values."""
    side = group.column("side").to_numpy()
    root, n = (group.column(c).to_numpy() for c in ("root", "n"))
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(side), -1)
    left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
    x, y = left[:, None], right[None, :]
    i, j = np.nonzero((root[x] != root[y]) & (100 * np.minimum(n[x], n[y]) >= per_cent * np.maximum(n[x], n[y])))
    i, j = left[i], right[j]
    found, at = np.zeros(len(i), np.int64), 0
    for upto, m in least.items():
        found = found + np.concatenate([np.zeros(0, np.int64), *((sig[i[c : c + 65536], at:upto] == sig[j[c : c + 65536], at:upto]).sum(axis=1) for c in range(0, len(i), 65536))])
        keep = found >= m
        i, j, found, at = i[keep], j[keep], found[keep], upto
    return i, j


def _wanted(least: dict[int, int], per_cent: int):
    """The nodes of a block that are in one of its pairs: only their sets are needed."""

    def run(group: pa.Table) -> pa.Table:
        return group.take(pa.array(np.unique(np.concatenate(_met(group, least, per_cent)))))

    return run


def _blocks(least: dict[int, int], per_cent: int):
    """The pairs of a block compared exactly; of the links found, those that join what is not yet joined are returned."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        i, j = _met(group, least, per_cent)
        if not len(i):
            return schema.empty_table()
        node, root, n = (group.column(c).to_numpy() for c in ("node", "root", "n"))
        raw = group.column("shingles").to_pylist()
        used = np.unique(np.concatenate([i, j]))
        place = np.full(len(node), -1)
        place[used] = np.arange(len(used))
        sets = [np.frombuffer(raw[k], np.uint64) for k in used]
        values, back, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(sets)), [len(z) for z in sets])
        both = np.zeros((len(used), len(used)), np.float32)
        shared = np.flatnonzero(often > 1)
        column = np.full(len(values), -1)
        column[shared] = np.arange(len(shared))
        column = column[back.reshape(-1)]
        for c in range(0, len(shared), 4096):  # counts under 2 ** 24 are exact
            own = (column >= c) & (column < c + 4096)
            dense = np.zeros((len(used), min(4096, len(shared) - c)), np.float32)
            dense[rows[own], column[own] - c] = 1
            both += dense @ dense.T
        k = both[place[i], place[j]].astype(np.int64)
        good = np.flatnonzero(100 * k >= per_cent * (n[i] + n[j] - k))
        parent: dict[int, int] = {}

        def top(z: int) -> int:
            while (up := parent.get(z, z)) != z:
                parent[z] = parent.get(up, up)
                z = up
            return z

        out = []
        for g in good.tolist():
            p, q = top(int(root[i[g]])), top(int(root[j[g]]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((int(node[i[g]]), int(node[j[g]])))
        return pa.Table.from_batches([common.batch(schema, out)])

    return run


def _rest(rows: DataFrame, sets: DataFrame, sig: DataFrame, per_cent: int) -> DataFrame:
    """rows(pivot, node, root): links between nodes of one pivot that are in different components."""
    by = rows.groupBy("pivot", "root").agg(F.count("*").alias("m"))
    by = by.groupBy("pivot").agg(F.sum("m").alias("all"), F.max_by("root", F.struct("m", "root")).alias("main"), F.max("m").alias("most"))
    by = common.written(by, "pivots")
    counted = common.small(by, 40)
    if counted is by:  # too many pivots to send around: a pivot's rows are spread
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(by.withColumn("salt", salts), ["pivot", "salt"]).drop("salt")
    else:
        rows = rows.join(counted, "pivot")
    rows = rows.withColumn("part", F.lit(0).cast("long"))
    small, large = rows.where(F.col("all") <= GROUP), rows.where(F.col("all") > GROUP)
    # of groups too large for blocks of all members, those that share one of their rarest shingles
    if not large.isEmpty():
        split = _prefixes(large.select("pivot", "node", "root").distinct().join(sets, "node"), per_cent)
        by = split.groupBy("pivot", "part", "root").agg(F.count("*").alias("m")).groupBy("pivot", "part").agg(F.sum("m").alias("all"), F.max_by("root", F.struct("m", "root")).alias("main"), F.max("m").alias("most")).where("all > most")
        small = small.unionByName(split.join(by, ["pivot", "part"]).select(*small.columns))
    across, down = F.ceil(F.col("all") / CHUNK), F.ceil((F.col("all") - F.col("most")) / CHUNK)
    mine = F.pmod(F.xxhash64("node"), across)
    right = small.select("pivot", "part", "node", "root", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), down - 1)).alias("i"), mine.alias("j"))
    left = small.where("root <> main").select("pivot", "part", "node", "root", F.lit(1).alias("side"), F.pmod(F.xxhash64("node"), down).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), across - 1)).alias("j"))
    cells = left.unionByName(right).join(sig, "node")
    least, cell = least_matches(per_cent / 100), ["pivot", "part", "i", "j"]
    # signatures first; sets go only to the blocks that have a pair with them
    wanted = common.written(cells.groupBy(*cell).applyInArrow(_wanted(least, per_cent), cells.schema.simpleString()[7:-1].replace(":", " ")), "wanted")
    return wanted.join(sets, "node").groupBy(*cell).applyInArrow(_blocks(least, per_cent), "a long, b long")


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """links(a, b) to (node, root): the smallest node reachable, for each node that has a link to another.
    Alternating large-star and small-star steps; each is written out, so a lost executor costs one step."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = common.written(edges, "links"), None
    for _ in range(limit):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))).where("u <> v").distinct()
        edges = common.written(small, "links")
        # a forest of stars that no longer changes
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, per_cent: int = PER_CENT) -> DataFrame:
    """Per row of docs: its key, n_shingles, component_id (smallest key of its component) and kept (its key is that)."""
    common.lean(docs.sparkSession)
    rows = docs.select(key, text)
    kind, sql = common.key_type(rows, key)
    measured = common.written(rows.mapInArrow(_measure(key, text, width, kind), f"`{key}` {sql}, n_shingles long, hi long, lo long, bands array<long>, sig binary"), "shingles")
    classes = measured.where("hi is not null").groupBy("hi", "lo").agg(F.min(key).alias("id"), F.max("n_shingles").alias("n"), F.min_by(F.struct("bands", "sig"), F.struct(F.col(key).isNull(), F.col(key))).alias("x"))
    nodes = common.written(classes.select(F.monotonically_increasing_id().alias("node"), "hi", "lo", "id", "n", "x.bands", "x.sig"), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = common.written(banded.join(shared, "band"), "met")
    # a node that meets many others is central in its group: most of the group links to it directly
    central = met.groupBy("node").agg(F.sum("n").alias("meets"))
    buckets = common.written(met.select("band", "node").join(central, "node").select("band", "node", "meets"), "buckets")

    def pivots_of(frame: DataFrame) -> DataFrame:
        return frame.groupBy("band").agg(F.max(F.struct("meets", "node")).alias("p")).select("band", F.col("p.node").alias("pivot"))

    wanted = buckets.select("node").distinct().join(nodes.select("node", "hi", "lo", "id"), "node")
    sets = common.written(_sets_of(common.written(wanted, "wanted"), rows.select(F.col(key).alias("of"), F.col(text).alias("_text")), width), "sets")
    sig = nodes.select("node", "sig")

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
        with_both = with_a.join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
        left = with_both.select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(per_cent / 100), "a long, b long")
        left = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
        left = left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
        return left.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(per_cent), "a long, b long")

    rest = common.written(buckets.join(pivots_of(buckets), "band").where("node <> pivot").select("band", "pivot", "node"), "rest")
    links = common.written(confirmed(rest.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()), "links")
    roots = components(links)
    labelled = rest.join(roots, "node", "left").select("band", "pivot", "node", F.coalesce("root", "node").alias("root"))
    mixed = labelled.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    # two nodes of one bucket have its pivot in common: each node is laid out once a pivot, not once a band
    still = common.written(labelled.join(mixed, "band").select("pivot", "node", "root").distinct(), "still")
    more = common.written(_rest(still, sets, nodes.select("node", "n", "sig"), per_cent), "links")
    if not more.isEmpty():
        roots = components(common.written(links.unionByName(more), "links"))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).distinct()
    member = nodes.join(roots, "node", "left").select("hi", "lo", "id", F.coalesce("root", "node").alias("root"))
    smallest = member.groupBy("root").agg(F.min("id").alias("component_id"))
    of = member.join(smallest, "root").select("hi", "lo", "component_id")
    out = measured.select(key, "n_shingles", "hi", "lo").join(of, ["hi", "lo"], "left")
    component = F.coalesce(F.col("component_id"), F.col(key))
    return out.select(key, "n_shingles", component.alias("component_id"), F.coalesce(component == F.col(key), F.col("hi").isNull()).alias("kept"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, per_cent: int = PER_CENT) -> DataFrame:
    """docs with one row of each group of near-duplicates, that with the smallest id; of equal rows one. A row with a null
    id stays. The columns are those of docs."""
    names = docs.columns
    docs, (key, text) = common.apart(docs, key, text)
    found = near_duplicates(docs, key, text, width, per_cent)
    found = common.written(found, "found")
    dropped = common.small(common.written(found.where(~F.col("kept")).select(key).distinct(), "dropped"), 16)
    out = docs.join(dropped, key, "left_anti").select(docs.columns)
    again = common.written(found.where("kept").groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key).dropna(), "repeated")
    if again.isEmpty():
        return out.toDF(*names)
    return out.join(again, key, "left_anti").select(docs.columns).unionByName(out.join(again, key, "left_semi").select(docs.columns).dropDuplicates([key, text])).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=SHINGLE)


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'),
         lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+{SHINGLE - 1}], ' ') AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - {SHINGLE - 1}))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= {PER_CENT} * (p.n + q.n - k)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id
"""
