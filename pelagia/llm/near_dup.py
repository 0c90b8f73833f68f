"""MinHash near-duplicates: SuperMinHash signatures, banding, verification, grouping.

SuperMinHash gives each element a random permutation of the slots; the element's
j-th choice competes with a value in [j, j + 1), so later choices stop mattering
once every slot has a smaller value. Slots of one signature are thus correlated
negatively, which lowers the variance of the estimate.

The plan, for N documents:
1. one pass over the texts: set size, set key, 8-bit slots and band keys of each;
2. documents with equal sets collapse to the smallest id (partial aggregation);
3. band buckets of more than one set; in each, every set meets the smallest id;
4. those pairs are verified on full shingle sets, streaming, hot centres salted;
5. links become components; buckets that still hold several components have
   their remaining pairs compared too, in bounded blocks with full sets, so that
   no link hides behind a bucket's centre;
6. components again, and back to all documents.

Nothing but counts of changed labels reaches the driver.

Cases: a null text or one without words has the empty set and no links. A doc_id
names one text: rows that repeat it repeat the text. Ties take
the smallest doc_id. Rows that repeat a doc_id are each returned. Rows with a
null doc_id take part in nothing and come back as their own class (component_id
null, kept true). An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.llm.common import bounded, freed, fresh_names, map_rows, mix64, settle
from pelagia.llm.line_dedup import frequent
from pelagia.llm.words import shingle_sets

SLOTS, ROWS = 128, 4
#: Members of a pair block when a bucket's remaining pairs are compared.
BLOCK = 1024
#: Members of one centre that one verifying group holds, about.
PER_GROUP = 512
#: A band with more than one in HOT of all rows isn't dealt to one task; bounds those bands.
HOT = 4096
#: Ids that a task's union-find holds, about.
NODES = 1 << 20
#: Marks that bound how many shingles a set shares with the others of a cell.
MARKS = 1 << 16

STEP = np.uint64(0x9E3779B97F4A7C15)


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS, limit: int = 1 << 19) -> np.ndarray:
    """Signatures, one row of ``slots`` values (choice number << 32 | random part) per set.

    All sets advance choice by choice together; a set stops early when its
    largest slot value is below the next choice. Empty sets keep the top value.
    """
    out = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    start = 0
    while start < len(sets):
        end, size = start, 0
        while end < len(sets) and (end == start or size + len(sets[end]) <= limit):
            size += len(sets[end])
            end += 1
        _fill(sets[start:end], out[start:end], slots)
        start = end
    return out


def _fill(sets: list[np.ndarray], out: np.ndarray, slots: int) -> None:
    lengths = np.array([len(s) for s in sets])
    x = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), lengths)
    chosen: list[np.ndarray] = []  # of each choice so far: where the permutation swapped
    flat = out.reshape(-1)
    for j in range(slots):
        if not len(x):
            return
        r = mix64(x + np.uint64((int(STEP) * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        slot = k
        for t in range(j - 1, -1, -1):  # undo the swaps: what stands at k after them
            slot = np.where(slot == chosen[t], t, slot)
        chosen.append(k)
        np.minimum.at(flat, owner * slots + slot, np.uint64(j << 32) | (r >> np.uint64(32)))
        open_set = out.max(1) >= np.uint64((j + 1) << 32)
        if not open_set[owner].all():
            keep = open_set[owner]
            x, owner, chosen = x[keep], owner[keep], [c[keep] for c in chosen]


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` slots; keys of different bands differ."""
    bands = signatures.reshape(len(signatures), -1, rows)
    h = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64) * STEP, bands.shape[:2])
    for k in range(rows):
        h = mix64(h ^ bands[:, :, k])
    return h.astype(np.int64)


def signed(df: DataFrame, width: int, slots: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key, slots8, bands (packed 64-bit keys) of every whole text."""

    def make():
        def step(batch):
            sets = shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()], width)
            sig = super_minhash(sets, slots)
            small = mix64(sig).astype(np.uint8)
            keys = band_keys(sig, rows)
            return {
                "doc_id": batch.column("doc_id"),
                "n_shingles": [len(s) for s in sets],
                "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "slots8": [r.tobytes() for r in small],
                "bands": [r.astype(">i8").tobytes() for r in keys],
            }

        return step

    return map_rows(df.select("doc_id", "text"), "doc_id long, n_shingles long, set_key binary, slots8 binary, bands binary", make)


def buckets_of(sets: DataFrame, bands: int, hot: int = HOT) -> DataFrame:
    """(band, id, centre) of the band buckets that more than one set falls into.

    Buckets with more than one in ``hot`` of all rows aren't dealt to a task each:
    their smallest ids are combined before a shuffle and broadcast back.
    """
    keys = F.expr(f"transform(sequence(0, {bands - 1}), i -> substring(bands, 8 * i + 1, 8))")
    rows = sets.select("id", F.explode(keys).alias("band")).withColumn("h1", F.xxhash64("band"))
    often = F.broadcast(settle(frequent(rows, hot)))  # at most ``hot`` hashes
    crowded = rows.join(often, "h1", "left_semi")
    ends = crowded.groupBy("band").agg(F.min("id").alias("centre"), F.max("id").alias("last"))
    w = Window.partitionBy("band")
    dealt = rows.join(often, "h1", "left_anti").withColumn("centre", F.min("id").over(w)).withColumn("last", F.max("id").over(w))
    columns = ["band", "id", "centre", "last"]
    # a band or, by a chance of 2 ** -64, a few for each of the hashes
    both = dealt.select(columns).unionByName(crowded.join(F.broadcast(ends), "band").select(columns))
    return both.where("centre <> last").select("band", "id", "centre")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (centre, id) with 100 * |A & B| >= percent * |A | B| on full shingle sets.

    Each centre's text meets its members' in a sorted stream; a centre with many
    members is dealt out over salted groups, its text going to each.
    """
    spark = pairs.sparkSession
    pairs = settle(pairs.distinct())
    groups = pairs.groupBy("centre").agg(F.ceil(F.count("*") / PER_GROUP).cast("int").alias("groups"))
    members = pairs.join(groups, "centre").select("id", "centre", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("salt"), F.lit(1).alias("side"))
    centres = groups.select(F.col("centre").alias("id"), "centre", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(0).alias("side"))
    wanted = members.unionByName(centres)
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("id IS NOT NULL")
    rows = texts.join(wanted.hint("shuffle_hash"), "id").select("centre", "salt", "side", "id", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "centre", "salt").sortWithinPartitions("centre", "salt", "side", "id")

    def run(batches):
        at, centre = None, None
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(4)]
            a, x = [], []
            for c, salt, side, i, s in zip(*cols, shingle_sets([(t or "").encode() for t in b.column(4).to_pylist()], width)):
                if side == 0:
                    at, centre = (c, salt), s
                elif at == (c, salt):
                    place = np.searchsorted(centre, s)
                    both = int((centre[np.minimum(place, len(centre) - 1)] == s).sum()) if len(centre) else 0
                    if both and 100 * both >= percent * (len(centre) + len(s) - both):
                        a.append(c)
                        x.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(x, pa.int64())], ["centre", "id"])

    return rows.mapInArrow(freed(run), "centre long, id long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach, for every linked id.

    Union-find inside each partition shrinks the links to trees, of about ``NODES`` ids at a time; smallest labels
    then travel along links and jump through their own label until none changes.
    """

    def trees_of(parent):
        nodes = list(parent)
        roots = [find(parent, x) for x in nodes]
        pairs = [(x, r) for x, r in zip(nodes, roots) if x != r]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    def find(parent: dict[int, int], x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def forest(batches):
        parent: dict[int, int] = {}
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p, q = find(parent, x), find(parent, y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
            if len(parent) > NODES:
                yield trees_of(parent)
                parent = {}
        yield trees_of(parent)

    # rebalanced, so that an id with very many links is split over tasks
    trees = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").hint("rebalance", F.col("b")).mapInArrow(freed(forest), "a long, b long").distinct())
    both = trees.unionByName(trees.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        heard = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        low = labels.join(heard.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("component").alias("was"), F.least("component", "m").alias("now"))
        jump = low.alias("l").join(labels.select(F.col("id").alias("now"), F.col("component").alias("far")), "now", "left")
        new = settle(jump.select("id", "was", F.least("now", "far").alias("component")))
        changed = new.where("was <> component").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels


def remaining_links(buckets: DataFrame, labels: DataFrame, slots8: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (centre, id) between members of one bucket that are in different components so far.

    Buckets are cut into blocks of about ``BLOCK`` members and compared block by block,
    each member with its full shingle set. Of the pairs that an upper bound of their
    intersection doesn't rule out, those likeliest by the 8-bit slots are verified
    first; once a pair links two components, no other pair of the two needs a look,
    so a cell gives fewer links than members.
    """
    marked = buckets.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # combined before the shuffle; one row a band meets its members, so the adaptive skew join can split a crowded one
    several = marked.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi AND n > 2").select("band", "n")
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).cast("int")
    open_ = settle(marked.join(several, "band").select("band", "n", block.alias("block"), "id", "component"))
    sets = docs.select(F.col("doc_id").alias("id"), "text").join(open_.select("id").distinct().join(slots8, "id").hint("shuffle_hash"), "id")

    def with_set(batches):
        for b in batches:
            packed = [s.tobytes() for s in shingle_sets([(t or "").encode() for t in b.column(1).to_pylist()], width)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(packed, pa.binary())], ["id", "slots8", "shingles"])

    sets = sets.select("id", "text", "slots8").mapInArrow(freed(with_set), "id long, slots8 binary, shingles binary")
    last = F.floor((F.col("n") - 1) / BLOCK).cast("int")
    cells = open_.withColumn("other", F.explode(F.sequence(F.lit(0), last))).select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component")
    cells = cells.join(sets, "id").select("band", "i", "j", "block", "id", "component", "slots8", "shingles")
    n = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(n, "band", "i", "j").sortWithinPartitions("band", "i", "j", "block", "id")

    def run(batches):
        key, rows = None, []

        def flush():
            links = compare_cell(key, rows, percent) if len(rows) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["centre", "id"])

        for b in batches:
            for band, i, j, *row in zip(*(b.column(k).to_pylist() for k in range(8))):
                if key != (band, i, j):
                    yield from flush()
                    key, rows = (band, i, j), []
                rows.append(row)
        yield from flush()

    return cells.mapInArrow(freed(run), "centre long, id long").distinct()


def compare_cell(key: tuple, rows: list, percent: int) -> list[tuple[int, int]]:
    """Verified links between components of a cell's (block, id, component, slots8, shingles) rows."""
    block, ids, comp = (np.array([r[k] for r in rows]) for k in range(3))
    sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    size = np.array([len(s) for s in sets])
    low = np.concatenate([s.astype(np.uint16) for s in sets])  # modulo MARKS
    begin = np.cumsum(size) - size
    marks = np.zeros(MARKS, bool)
    root = np.unique(comp, return_inverse=True)[1]
    links = []
    for r in range(len(rows) - 1):
        rest = np.arange(r + 1, len(rows))
        rest = rest[(root[rest] != root[r]) & ((block[rest] != block[r]) | (key[1] == key[2]))]
        rest = rest[100 * np.minimum(size[rest], size[r]) >= percent * np.maximum(size[rest], size[r])]
        if not len(rest):
            continue
        own = low[begin[r] : begin[r] + size[r]]
        marks[own] = True
        most = np.add.reduceat(marks[low[begin[r + 1] :]], begin[r + 1 :] - begin[r + 1], dtype=np.int64)[rest - r - 1]
        marks[own] = False
        # shingles that share a mark count as equal, so no pair at the threshold is ruled out
        most = np.minimum(most, np.minimum(size[rest], size[r]))
        rest = rest[100 * most >= percent * (size[rest] + size[r] - most)]
        same = (sig[rest] == sig[r]).sum(1)
        for k in rest[np.argsort(-same, kind="stable")].tolist():
            if root[k] == root[r]:
                continue
            place = np.searchsorted(sets[r], sets[k])
            both = int((sets[r][np.minimum(place, size[r] - 1)] == sets[k]).sum())
            if 100 * both >= percent * (size[r] + size[k] - both):
                links.append((int(min(ids[r], ids[k])), int(max(ids[r], ids[k]))))
                root[root == root[k]] = root[r]
    return links


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 75, slots: int = SLOTS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``df`` (doc_id, text, ...)."""
    bounded(df.sparkSession)
    base = settle(signed(df, width, slots, rows))
    classes = base.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("slots8").alias("slots8"), F.first("bands").alias("bands"))
    classes = settle(classes)
    buckets = settle(buckets_of(classes, slots // rows))
    first = settle(buckets.where("id <> centre").select("centre", "id").distinct())
    links = settle(verified(first, df, width, percent))
    labels = components(links.select(F.col("centre").alias("a"), F.col("id").alias("b")))
    more = settle(remaining_links(buckets, labels, classes.select("id", "slots8"), df, width, percent))
    if more.limit(1).count():
        links = settle(links.unionByName(more).distinct())
        labels = components(links.select(F.col("centre").alias("a"), F.col("id").alias("b")))
    of_set = classes.select("set_key", "id").join(labels, "id", "left").select("set_key", F.coalesce("component", "id").alias("of_set"))
    full = base.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key")).join(of_set, "set_key", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("of_set", "doc_id"))
    return full.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(df: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Rows of ``df`` whose document is the smallest id of its component; all columns stay."""
    (mark,) = fresh_names(df.columns, "kept")
    keep = near_duplicates(df, width, percent).where("kept").select(F.col("doc_id").alias(mark)).distinct()
    return df.join(keep, F.col("doc_id").eqNullSafe(F.col(mark)), "left_semi")
