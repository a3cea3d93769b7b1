"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

Each text gets `trees` labels of `depth` MinHash values. A tree is a prefix trie: its
labels in sorted order, where a node of the trie is a run of labels with a common prefix.
Matching starts at whole labels, and matched prefixes are shortened level by level:

* The least level is the longest prefix that reaches the target recall twice: by the chance
  that a pair at the threshold shares it in some tree, and as measured on the data, for
  `SAMPLE` texts (by a hash) against all texts, with signatures as the truth (`least_level`).
* Each node of that level arrives in one task (or its blocks do), sorted by label. The trie
  is walked from the deepest runs upwards: at each level the texts of a run that are not yet
  connected are linked where their signatures agree often enough. A prefix is shortened no
  further once all of its texts are connected (`_candidates`).

Connected candidates form a cluster, and within a cluster every pair of texts is compared
exactly on its sets of shingles.

Bounds: only one text of a group of equal texts takes part. Buckets and clusters above a
fixed size are cut into blocks and dealt out as pairs of blocks, so that no task holds a
whole hot group, and the kernels return one row per text and block pair, never pairs of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import workers
from marlstone.llm.names import fresh
from marlstone.llm.shingles import MinHash, as_bytes, mix64, shingle_hashes, slices
from marlstone.operators.components import connected_components
from marlstone.operators.skew import salted_join, total_of
from marlstone.plans.materialize import discard, materialize

TREES, DEPTH, WIDTH, THRESHOLD, RECALL = 16, 8, 5, 0.8, 0.999
#: Rows of a block of a bucket or cluster, and shingles of a block of a cluster.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 500_000
#: Standard deviations under the threshold at which a signature still passes.
SLACK = 4.0
#: Texts whose matches among all texts measure the recall of a level.
SAMPLE = 128


def expected_recall(similarity: float, level: int, trees: int = TREES) -> float:
    """The chance that a pair of this similarity shares a prefix of `level` values in some tree."""
    return 1 - (1 - similarity**level) ** trees


def least_matches(threshold: float, size: int) -> int:
    """Equal signature values that a pair at the threshold reaches but for chance."""
    return int(np.floor(size * threshold - SLACK * np.sqrt(size * threshold * (1 - threshold))))


def _sign(width: int):
    hasher = MinHash(TREES * DEPTH)
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("n_shingles", pa.int32()), ("sig", pa.binary()), ("mark", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in workers.batches("jaccard", batches):
            raw, offsets = as_bytes(batch.column(1))
            missing = np.asarray(batch.column(1).is_null())
            for a, b in slices(offsets, 1 << 20):
                own = offsets[a:b + 1] - offsets[a]
                part = raw[offsets[a]:offsets[b]]
                hashes, bounds = shingle_hashes(part, own, width)
                low = (hasher.signatures(hashes, bounds) & 0xFF).astype(np.uint8)
                text, counts = part.tobytes(), np.diff(bounds)
                gone = missing[a:b]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a),
                    pa.array([None if gone[i] else xxhash.xxh3_128_digest(text[own[i]:own[i + 1]]) for i in range(b - a)], pa.binary()),
                    pa.array(counts.astype(np.int32)),
                    pa.array([low[i].tobytes() for i in range(b - a)], pa.binary()),
                    batch.column(2).slice(a, b - a),
                ], schema=schema)

    return run


def _mark(text_col: str) -> Column:
    return F.unhex(F.md5(text_col))


def sign(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, node: digest of the text or null, n_shingles, sig: the low bytes of the
    labels of all trees, one after another, mark: a digest of the text that Spark can compute)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _mark(text_col).alias("mark")).mapInArrow(
        _sign(width), "doc_id long, node binary, n_shingles int, sig binary, mark binary")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def shared_levels(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each signature of `many`, the longest prefix that it shares with `one` in any tree."""
    same = (many == one).reshape(len(many), TREES, DEPTH)
    return np.logical_and.accumulate(same, axis=2).sum(axis=2).max(axis=1, initial=0)


def measured_recall(texts: DataFrame, threshold: float, sample: int = SAMPLE) -> tuple[int, list[float]]:
    """(pairs, recall of levels 1 to DEPTH): of all pairs of one of `sample` texts (the first
    by a hash) and any other text whose signatures agree in the threshold's share, how many
    share a prefix of that level. The sample is a stated query set against all rows."""
    worded = texts.filter("n_shingles > 0")
    share = int(min(1.0, 8 * sample / max(worded.count(), 1)) * (1 << 30))  # so that no task sends more than its share
    hashed = worded.select("node", "sig", F.pmod(F.xxhash64("node"), F.lit(1 << 30)).alias("h"))
    asked = hashed.filter(F.col("h") < share).orderBy("h", "node").limit(sample).collect()
    nodes, sigs = [bytes(r["node"]) for r in asked], [np.frombuffer(bytes(r["sig"]), np.uint8) for r in asked]
    least = threshold * TREES * DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DEPTH + 1, np.int64)
        for batch in batches:
            if batch.num_rows:
                many, node = _signatures(batch.column(1)), np.array(batch.column(0).to_pylist(), object)
                for own, sig in zip(nodes, sigs, strict=True):
                    near = np.flatnonzero(((many == sig).sum(axis=1, dtype=np.int32) >= least) & (node != own))
                    if len(near):
                        total += np.bincount(shared_levels(sig, many[near]), minlength=DEPTH + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DEPTH + 1), pa.int32()), pa.array(total)], names=["level", "n"])

    found = worded.select("node", "sig").mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(DEPTH + 1, np.int64)
    for r in found:
        count[r["level"]] = r["n"]
    pairs = int(count.sum())
    return pairs, [float(count[k:].sum() / pairs) if pairs else 1.0 for k in range(1, DEPTH + 1)]


def least_level(threshold: float, recall: float, measured: list[float]) -> int:
    """The longest prefix, shortened from whole labels, at which both the expected recall at
    the threshold and the measured one reach the target; 1 if none does."""
    for level in range(DEPTH, 1, -1):
        if expected_recall(threshold, level) >= recall and measured[level - 1] >= recall:
            return level
    return 1


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of equal leading `keys` columns from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _spread(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the first row of its component."""
    label = np.arange(len(linked), dtype=np.int32)
    while True:
        low = np.where(linked, label[None, :], np.int32(len(label))).min(axis=1, initial=len(label))
        low = np.minimum(low, label)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def trie_links(sig: np.ndarray, label: np.ndarray, level: int, least: int) -> list[tuple[int, int]]:
    """Links (row, row) of one trie node's texts, whose labels are sorted: runs of a common
    prefix are walked from whole labels up to `level`. In each run, texts are compared with
    those that nothing connects them to yet; a run whose texts are all connected is done."""
    n = len(sig)
    group = np.arange(n)
    common = np.logical_and.accumulate(label[1:] == label[:-1], axis=1).sum(axis=1)
    links: list[tuple[int, int]] = []
    done: set[tuple[int, int]] = set()
    for depth in range(label.shape[1], level - 1, -1):
        cuts = [0, *(np.flatnonzero(common < depth) + 1).tolist(), n] if depth > level else [0, n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a < 2 or (a, b) in done:
                continue
            done.add((a, b))
            rest = np.arange(a, b)
            while len(rest) and (group[rest] != group[rest[0]]).any():
                front = rest[group[rest] == group[rest[0]]].tolist()
                rest = rest[group[rest] != group[rest[0]]]
                while front and len(rest):
                    at = front.pop()
                    near = rest[(sig[rest] == sig[at]).sum(axis=1, dtype=np.int32) >= least]
                    if len(near):
                        old, first = np.unique(group[near], return_index=True)
                        links += [(at, i) for i in near[first].tolist()]
                        joined = np.isin(group[rest], old)
                        front += rest[joined].tolist()
                        group[np.isin(group, old)] = group[at]
                        rest = rest[~joined]
    return links


def _candidates(level: int, least: int):
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[bytes] = []
        right: list[bytes] = []
        for group in _groups(workers.batches("jaccard", batches), 3):
            node = group.column("node").to_pylist()
            if len(node) < 2:
                continue
            for i, j in trie_links(_signatures(group.column("sig")), _signatures(group.column("label")), level, least):
                left.append(node[i])
                right.append(node[j])
            if len(left) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], schema=schema)
                left, right = [], []
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], schema=schema)

    return run


def _block_pairs(df: DataFrame, blocks: Column) -> DataFrame:
    """Deal each row to the pairs (lo, hi) of blocks that its own block is part of."""
    own = F.pmod(F.xxhash64("node"), F.col("_n")).cast("int")
    return (df.withColumn("_n", blocks.cast("int")).withColumn("own", own)
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
            .withColumn("lo", F.least("own", "_other")).withColumn("hi", F.greatest("own", "_other")).drop("_n", "_other"))


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in workers.batches("jaccard", batches):
            raw, offsets = as_bytes(batch.column("text"))
            for a, b in slices(offsets, 1 << 20):
                hashes, bounds = shingle_hashes(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], width)
                sets = [np.unique(hashes[bounds[i]:bounds[i + 1]]).tobytes() for i in range(b - a)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("cluster"), part.column("node"), part.column("copies"), part.column("lots"), pa.array(sets, pa.binary())],
                    names=["cluster", "node", "copies", "lots", "shingles"])

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections; shingles with the same owners count as one column."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    size = np.diff(np.concatenate((first, [len(value)])))
    tag = mix64(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    mark = np.add.reduceat(tag[owner], first)
    shared = np.flatnonzero(size > 1)
    _, pick, weight = np.unique(mark[shared], return_index=True, return_counts=True)
    kind = np.float32 if max(len(s) for s in sets) < 1 << 24 else np.float64  # whole numbers stay exact
    out = np.zeros((m, m), kind)
    for a in range(0, len(pick), 1024):
        chosen = shared[pick[a:a + 1024]]
        n = size[chosen]
        row = np.concatenate([owner[first[c]:first[c] + k] for c, k in zip(chosen, n, strict=True)])
        grid = np.zeros((m, len(chosen)), kind)
        grid[row, np.repeat(np.arange(len(chosen)), n)] = 1
        out += (grid * weight[a:a + 1024].astype(kind)) @ grid.T
    return out


def _verify(threshold: float):
    schema = pa.schema([("node", pa.binary()), ("root", pa.binary()), ("texts", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(workers.batches("jaccard", batches), 3):
            node = group.column("node").to_pylist()
            first = [i for i, x in enumerate(node) if not i or x != node[i - 1]]  # a repeated row may bring a text twice
            if len(first) < 2:
                continue
            group, node = group.take(first), [node[i] for i in first]
            sets = [np.frombuffer(b, np.uint64) for b in group.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets], np.float64)
            shared = _overlaps(sets)
            linked = np.zeros(shared.shape, bool)
            for a in range(0, len(size), 128):  # in double precision, a few rows at a time
                both = shared[a:a + 128].astype(np.float64)
                union = size[a:a + 128, None] + size[None, :] - both
                linked[a:a + 128] = (both >= threshold * union - 1e-9) & (union > 0)
            np.fill_diagonal(linked, False)
            if group.column("lo")[0].as_py() != group.column("hi")[0].as_py():
                own = group.column("own").to_numpy()
                linked &= own[:, None] != own[None, :]
            copies = group.column("copies").to_numpy()
            root = _spread(linked)
            yield pa.RecordBatch.from_arrays([
                pa.array(node, pa.binary()), pa.array([node[r] for r in root], pa.binary()),
                pa.array(linked.sum(axis=1).astype(np.int64)), pa.array(linked @ copies.astype(np.int64)),
            ], schema=schema)

    return run


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                 width: int = WIDTH, recall: float = RECALL) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_texts, class_size.

    A link is a pair of documents whose sets of `width`-word shingles have a Jaccard
    similarity of `threshold` or more. class_id is the least doc_id of the documents
    connected by links, n_links the number of other documents linked to this one
    (copies of equal text included), n_texts the number of other texts linked to its
    text, class_size the number of documents of the class.

    Null text: a class of its own (class_id = doc_id, no links). Texts without words are
    linked to equal texts only. Repeated rows count as copies. A null doc_id takes part;
    class_id is null if all of its class lack one. Empty input gives an empty result.
    Other columns are not used, whatever their names.
    """
    signed, placed = _classes(docs, id_col, text_col, threshold, width, recall)
    placed = materialize(placed, "placed")
    heads = materialize(placed.groupBy("component").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("n")), "heads")
    placed = salted_join(placed, heads, ["component"], "n", total_of(heads, "n"), ["node"]).select(
        "node", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"))
    return signed.select("doc_id", "node").join(placed, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, width: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and a row for each text: node, mark, rep (its least doc_id), copies,
    component (of its class), texts and links."""
    signed = materialize(sign(docs, id_col, text_col, width), "signed")
    texts = materialize(
        signed.filter("node is not null").groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"),
             F.first("sig").alias("sig"), F.first("mark").alias("mark")), "texts")
    level = least_level(threshold, recall, measured_recall(texts, threshold)[1])

    label = lambda size: F.expr(f"substring(sig, tree * {DEPTH} + 1, {size})")
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    spots = texts.filter("n_shingles > 0").select("node", "sig", trees).select("node", "tree", F.xxhash64("tree", label(level)).alias("key"))
    shared = materialize(spots.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("size", F.col("n")), "shared")
    hits = salted_join(spots, shared, ["key"], "n", total_of(shared, "n"), ["node"]).join(texts.select("node", "sig"), "node")
    hits = hits.withColumn("label", label(DEPTH)).drop("tree")
    dealt = _block_pairs(hits, F.ceil(F.col("size") / BLOCK_ROWS)).select("key", "lo", "hi", "node", "sig", "label")
    candidates = (dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "label")
                  .mapInArrow(_candidates(level, least_matches(threshold, TREES * DEPTH)), "u binary, v binary").distinct())
    clusters = materialize(connected_components(candidates).withColumnRenamed("component", "cluster"), "clusters")
    discard(shared)

    members = materialize(clusters.join(texts.select("node", "mark", "copies", "n_shingles"), "node"), "members")
    weight = materialize(members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).withColumn(
        "lots", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")).drop("s"), "weight")
    members = salted_join(members, weight, ["cluster"], "n", total_of(weight, "n"), ["node"]).select("cluster", "node", "mark", "copies", "lots")
    # one row of each text: copies go before the shuffle, whatever their ids
    source = docs.select(_mark(text_col).alias("mark"), F.col(text_col).alias("text")).filter("text is not null").groupBy("mark").agg(F.first("text").alias("text"))
    sets = source.join(members, "mark").mapInArrow(_shingle_sets(width), "cluster binary, node binary, copies long, lots int, shingles binary")
    pairs = _block_pairs(sets, F.col("lots")).select(
        F.xxhash64("cluster").alias("c"), "lo", "hi", "own", "node", "copies", "shingles", "cluster")
    checked = materialize(
        pairs.repartition("c", "lo", "hi").sortWithinPartitions("c", "lo", "hi", "node")
        .mapInArrow(_verify(threshold), "node binary, root binary, texts long, links long"), "checked")
    discard(weight)

    classes = connected_components(checked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    totals = checked.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("links").alias("links"))
    placed = (texts.select("node", "mark", "rep", "copies").join(classes, "node", "left").join(totals, "node", "left")
              .withColumn("component", F.coalesce("component", "node")))
    return signed, placed


def oracle_sql(threshold: float = THRESHOLD, width: int = WIDTH) -> str:
    """The same over the view `documents`, for DuckDB: all pairs of texts that share a shingle."""
    return f"""
    with recursive texts as (select text, min(doc_id) as rep, count(*) as copies from documents where text is not null group by 1),
      listed as (select rep, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') as w from texts),
      shingles as materialized (select rep, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < {width} then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) end)) as s from listed),
      sizes as (select rep, count(*) as n from shingles group by 1),
      pairs as (select a.rep as x, b.rep as y, count(*) as c from shingles a join shingles b using (s) where a.rep < b.rep group by 1, 2),
      near as materialized (select x, y from pairs join sizes p on p.rep = x join sizes q on q.rep = y where c >= {threshold} * (p.n + q.n - c) - 1e-9),
      links as materialized (select x, y from near union all select y, x from near),
      reach(rep, other) as (select rep, rep from texts union select r.rep, l.y from reach r join links l on r.other = l.x),
      classes as (select rep, min(other) as class_id from reach group by 1),
      counts as (select x as rep, count(*) as n_texts, sum(copies) as linked from links join texts on rep = y group by 1),
      placed as (select text, class_id, copies, coalesce(n_texts, 0) as n_texts, coalesce(linked, 0) + copies - 1 as n_links,
        sum(copies) over (partition by class_id) as class_size from texts join classes using (rep) left join counts using (rep))
    select doc_id, coalesce(class_id, doc_id) as class_id, cast(coalesce(n_links, 0) as bigint) as n_links, cast(coalesce(n_texts, 0) as bigint) as n_texts,
      cast(coalesce(class_size, 1) as bigint) as class_size from documents left join placed using (text)"""


def near_duplicates_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """The documents, all columns, with one of each class of near duplicates left.

    The one with the least doc_id stays, and of texts that share it one; a null doc_id comes
    last, so a row without one goes only if its class has another that stays. Rows without
    text stay. Of repeated rows of one doc_id and text one stays; rows of one doc_id with
    texts of different classes are judged each by its own class.
    """
    placed = _classes(docs, id_col, text_col, threshold, width, RECALL)[1]
    order = F.struct(F.col("rep").isNull().alias("last"), "rep", "mark")
    mark, rep, head = fresh(docs.columns, "mark", "rep", "head")
    heads = placed.groupBy("component").agg(F.min(order).alias("head")).select(F.col("head.rep").alias(rep), F.col("head.mark").alias(head))
    worded = docs.filter(F.col(text_col).isNotNull()).withColumn(mark, _mark(text_col))
    kept = worded.join(heads, worded[id_col].cast("long").eqNullSafe(heads[rep]) & (worded[mark] == heads[head]), "left_semi")
    return kept.dropDuplicates([id_col, mark]).drop(mark).unionByName(docs.filter(F.col(text_col).isNull()))
