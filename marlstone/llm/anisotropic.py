"""Maximum inner product search by score-aware anisotropic quantisation.

Guo et al., "Accelerating Large-Scale Inference with Anisotropic Vector Quantization"
(2020). Vectors are coded with 16 centres per pair of dimensions. The loss weighs the
part of the residual that is parallel to the vector `eta` times the rest, as that part
changes the large inner products; codes are found by coordinate descent and centres by
the weighted least squares that the loss implies. A search adds up four-bit tables, two
codes to a byte, and scores on the original vectors, of each block, the best by their codes and
then all others whose code and error leave room for a score that is as large: a block's result is
exact, whatever its rows are.

Rows are parted by the nearest of a few hundred coarse centres, and a query is sent to the
parts whose centres have the largest inner product with it: as many as it takes for `PROBED` of
the nearest rows to lie in them, measured for up to `ASKED` queries by brute force over all rows. Parts are packed into blocks of
bounded size, a large one into several, and queries in blocks meet the blocks of rows through
an equi-join on the block's number.

All rows are indexed. Only the centres are fitted on a sample of at most `TRAIN_ROWS` rows, the first by a hash of the id.
Equal rows of one id are one entry with a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.plans.materialize import discard, materialize

TRAIN_ROWS, ROUNDS, SWEEPS, CENTRES, WIDTH = 20_000, 8, 2, 16, 2
#: Most rows of a block, and queries of one.
BLOCK, QUERIES = 16_384, 512
#: Most parts, and the rows that a part has on the average where there are fewer of them.
PARTS, PART_ROWS = 512, 4_096
#: Share of the nearest rows that must lie in the parts looked into, and the queries that it is measured for.
PROBED, ASKED = 0.99, 256
#: So many times the wanted number of a block's different vectors are scored first, to find how large a score must be.
AGAIN = 8
#: What stands for a null id where ids are numbers; null comes after all ids.
_NO_ID = np.iinfo(np.int64).max
#: Share of the norm from which an inner product counts as large; sets eta.
LARGE = 0.2
TOP = 20


def parallel_weight(dimension: int, large: float = LARGE) -> float:
    """eta of the paper, 1 at least."""
    return max(1.0, (dimension - 1) * large**2 / (1 - large**2))


@dataclass
class Codebook:
    """Centres (subspaces, 16, WIDTH) for vectors of one dimension (zero-padded to whole subspaces)."""

    centres: np.ndarray
    dimension: int
    eta: float

    @property
    def unit(self) -> float:
        """The largest part of a centre; four-byte tables hold products in units of it."""
        return float(np.abs(self.centres).max()) or 1.0

    def errors(self, vectors: np.ndarray, code: np.ndarray) -> np.ndarray:
        """For each vector a bound, in units of `unit`, of how far a scan with a query of norm 1 is off:
        the norm of what the code leaves, and the rounding of four-byte sums."""
        spaces = self.centres.shape[0]
        coded = self.centres[np.arange(spaces)[None, :], code] / self.unit
        with np.errstate(all="ignore"):
            left = np.sqrt(((self.split(vectors) / self.unit - coded)**2).sum((1, 2)))
            return left * (1 + 1e-9) + (spaces + 8) * 2.0**-23 * (np.sqrt((coded**2).sum((1, 2))) + left) + 1e-30

    def split(self, vectors: np.ndarray) -> np.ndarray:
        spaces = self.centres.shape[0]
        full = np.zeros((len(vectors), spaces * WIDTH))
        full[:, :vectors.shape[1]] = vectors
        return full.reshape(len(vectors), spaces, WIDTH)

    def codes(self, vectors: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
        """(rows, subspaces) codes that reduce the anisotropic loss coordinate by coordinate."""
        x = self.split(vectors)
        n, spaces, _ = x.shape
        squares = (x**2).sum(2)
        lam = (self.eta - 1) / np.maximum(squares.sum(1), 1e-30)
        code = np.empty((n, spaces), np.uint8)
        along, total = np.zeros((n, spaces)), np.zeros(n)
        for sweep in range(sweeps + 1):
            for m in range(spaces):
                # of x - c: its product with x, and its square, from the products of x and c
                product = x[:, m] @ self.centres[m].T
                own = squares[:, m, None] - product
                square = own - product + (self.centres[m] ** 2).sum(1)
                other = total - along[:, m] if sweep else np.zeros(n)
                code[:, m] = np.argmin(square + lam[:, None] * (other[:, None] + own) ** 2, axis=1)
                chosen = own[np.arange(n), code[:, m]]
                total += chosen - along[:, m]
                along[:, m] = chosen
        return code

    @staticmethod
    def fit(vectors: np.ndarray, rounds: int = ROUNDS, seed: int = 3, large: float = LARGE) -> Codebook:
        """Centres fitted on all rows given; fewer rows than centres repeat some of them."""
        rng = np.random.default_rng(seed)
        d = vectors.shape[1]
        spaces = -(-d // WIDTH)
        book = Codebook(np.zeros((spaces, CENTRES, WIDTH)), d, parallel_weight(d, large))
        x = book.split(vectors)
        book.centres = np.ascontiguousarray(x[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES)].transpose(1, 0, 2))
        lam = (book.eta - 1) / np.maximum((x**2).sum((1, 2)), 1e-30)
        for _ in range(rounds):
            code = book.codes(vectors, 1)
            picked = book.centres[np.arange(spaces)[None, :], code]
            along = ((x - picked) * x).sum(-1)
            for m in range(spaces):
                xm = x[:, m]
                other = along.sum(1) - along[:, m]
                right = xm * (1 + lam * (other + (xm**2).sum(1)))[:, None]
                total = lambda weights, own=code[:, m]: np.bincount(own, weights, CENTRES)
                count = total(None)
                left = count[:, None, None] * np.eye(WIDTH) + np.array(
                    [[total(lam * xm[:, i] * xm[:, j]) for j in range(WIDTH)] for i in range(WIDTH)]).transpose(2, 0, 1)
                some = np.flatnonzero(count)
                wanted = np.stack([total(right[:, i]) for i in range(WIDTH)], axis=1)
                book.centres[m, some] = np.linalg.solve(left[some], wanted[some][:, :, None])[:, :, 0]
                along[:, m] = ((xm - book.centres[m, code[:, m]]) * xm).sum(-1)
        return book


def nearest_centre(centres: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """For each vector the number of the centre at the least distance."""
    return np.argmax(vectors @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1).astype(np.int32)


def coarse_centres(vectors: np.ndarray, parts: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """`parts` centres by Lloyd's rounds; one that loses its vectors stays where it was."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), min(parts, len(vectors)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest_centre(centres, vectors)
        count = np.bincount(own, minlength=len(centres))
        total = np.stack([np.bincount(own, vectors[:, i], len(centres)) for i in range(vectors.shape[1])], axis=1)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def probes(centres: np.ndarray, asked: np.ndarray, which: np.ndarray, parts: np.ndarray, share: float = PROBED) -> int:
    """In how many parts, by the inner product with the centre, a query has to look so that
    they hold `share` of its nearest rows: `which` of the queries asked has one of them in which of the `parts`."""
    if not len(which):
        return len(centres)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")
    found = place[which, parts]
    return int(np.searchsorted(np.cumsum(np.bincount(found, minlength=len(centres))), share * found.size)) + 1


def _nearest_parts(asked: np.ndarray, numbers: np.ndarray, top: int):
    """(which, score, part) of the nearest of a task's rows to each query asked, but its own."""
    d = asked.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, part = np.zeros((len(asked), 0)), np.zeros((len(asked), 0), np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            made = asked @ batch.column("v").flatten().to_numpy().reshape(-1, d).T
            own = (batch.column("number").to_numpy() == numbers[:, None]) & (batch.column("copies").to_numpy() == 1)
            made[own | np.isnan(made)] = -np.inf
            score = np.concatenate([score, made], axis=1)
            part = np.concatenate([part, np.broadcast_to(batch.column("part").to_numpy(), made.shape)], axis=1)
            if score.shape[1] > top:
                best = np.argpartition(-score, top - 1, axis=1)[:, :top]
                score, part = np.take_along_axis(score, best, axis=1), np.take_along_axis(part, best, axis=1)
        which, at = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(score[which, at]), pa.array(part[which, at])], names=["which", "score", "part"])

    return run


def pack_codes(code: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte; (bytes, rows), so that a table is read row by row."""
    if code.shape[1] % 2:
        code = np.concatenate([code, np.zeros((len(code), 1), np.uint8)], axis=1)
    return np.ascontiguousarray((code[:, ::2] | (code[:, 1::2] << 4)).T)


def scan(book: Codebook, queries: np.ndarray, packed: np.ndarray) -> Iterator[np.ndarray]:
    """Approximate inner products of each query with the packed rows, in units of `book.unit`."""
    tables = np.einsum("nmw,mcw->nmc", book.split(queries), book.centres / book.unit).astype(np.float32)
    if tables.shape[1] % 2:
        tables = np.concatenate([tables, np.zeros_like(tables[:, :1])], axis=1)
    pairs = (tables[:, ::2, None, :] + tables[:, 1::2, :, None]).reshape(len(queries), -1, 256)
    for table in pairs:
        total = table[0][packed[0]]
        for k in range(1, len(packed)):
            total += table[k][packed[k]]
        yield total


def best(book: Codebook, rows: tuple, packed: np.ndarray, queries: tuple, top: int) -> tuple[np.ndarray, ...]:
    """(number of the query, vec_id, score, times) of the best rows of a block for each query,
    `top` rows with their repeats at least. rows are (ids, counts, numbers, vectors, the
    place of their vector among the different ones, and the errors of those), queries the first four.
    Different vectors are ranked by their codes. The first ones are scored, those that tie with the
    last of them too; then all whose upper bound reaches the score that is needed by then, so
    that none of the best is left out. The row equal to a query (of its number) counts once
    less: that is the query's own."""
    ids, counts, numbers, vectors, which, errors = rows
    out = []
    again = AGAIN * top + 1
    with np.errstate(all="ignore"):  # of what overflows nothing is known, so it is scored
        sizes = np.sqrt((queries[3]**2).sum(axis=1))
        for number, query, size, rough in zip(queries[2], queries[3], sizes, scan(book, queries[3] / sizes[:, None], packed), strict=True):
            some = np.arange(len(ids))
            times = counts - (numbers == number)
            if len(rough) > again:
                first = rough >= np.partition(rough, len(rough) - again)[len(rough) - again]
                known = np.flatnonzero(first[which] & (times > 0))
                score = (vectors[known] * query).sum(axis=1)
                order = np.argsort(-score)
                enough = np.searchsorted(np.cumsum(times[known][order]), top)
                if enough < len(order):
                    some = np.flatnonzero((first | ~(rough + errors < score[order[enough]] / size / book.unit))[which])
            some = some[times[some] > 0]
            score = (vectors[some] * query).sum(axis=1)
            order = np.lexsort((ids[some], -score))[:top]
            out.append((np.full(len(order), number), ids[some][order], score[order], times[some][order]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, copies): the different rows, without vectors that are null,
    empty, zero or hold null or non-finite components."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = kept.filter(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    return kept.groupBy("vec_id", "v").agg(F.count("*").alias("copies"))


def _number(*columns: str) -> Column:
    """A row's number: equal for equal ids and vectors, else different but for a clash of 64 bits."""
    return F.xxhash64(*columns)


def _pack(book: Codebook | None):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").fill_null(int(_NO_ID)).to_numpy()
        number = table.column("number").to_numpy()
        order = np.lexsort((number, ids))
        vectors = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        vectors = np.ascontiguousarray(vectors, np.float64)
        code, which, errors = b"", np.zeros(0, np.int64), np.zeros(0)
        if book:
            _, first, which = np.unique(vectors.view(f"V{vectors.strides[0]}").ravel(), return_index=True, return_inverse=True)
            codes = book.codes(vectors[first])
            code, errors = pack_codes(codes).tobytes(), book.errors(vectors[first], codes)
        data = [ids[order], table.column("copies").to_numpy()[order], number[order], vectors, which.astype(np.int64), errors]
        made = {"block": table.column("block")[:1]}
        made |= {name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("ids", "copies", "numbers", "vectors", "which", "errors"), data, strict=True)}
        return pa.table(made | {"codes": pa.array([code], pa.binary())})

    return run


def search(embeddings: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding",
           block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` its `top` nearest rows of
    `embeddings` by inner product, nearest first, ties to the smaller vec_id, null last.

    Every row of `embeddings` is a candidate but the query's own: one row of its id and
    vector. Rows that share an id are candidates and queries each on their own; equal query
    rows have equal results, each once a row. Fewer candidates than `top` give all of them.
    Vectors that are null, empty, zero or not finite take no part. An inner product needs
    equal dimensions: a query meets the candidates of its own. Without usable vectors the
    result is empty. Other columns are not used.
    """
    rows = materialize(usable(embeddings, id_col, vector_col).withColumn("number", _number("vec_id", "v")), "vectors")
    asked = materialize(usable(queries, id_col, vector_col).withColumn("number", _number("vec_id", "v")), "queries")
    found = None
    for row in asked.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():  # one row a dimension
        one = _search(rows.filter(F.size("v") == row["d"]), asked.filter(F.size("v") == row["d"]), row["d"], row["count"], top, block)
        if one is not None:
            found = one if found is None else found.unionByName(one)
    return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


def _search(rows: DataFrame, asked: DataFrame, d: int, n_asked: int, top: int, block: int) -> DataFrame | None:
    count = rows.count()
    # hashes under a bound first, about twice the sample's size, so that no task sends more than its share
    hashed = rows.select("v", F.xxhash64("vec_id", "number").alias("h"))
    some = hashed.filter(F.pmod("h", F.lit(1 << 30)) < int(min(1.0, 2 * TRAIN_ROWS / max(count, 1)) * (1 << 30)))
    sample = some.orderBy(F.pmod("h", F.lit(1 << 30)), "h").limit(TRAIN_ROWS).select("v").toPandas()
    if not len(sample):
        return None
    known = np.stack(sample["v"].to_list())
    book = Codebook.fit(np.unique(known, axis=0))
    centres = coarse_centres(known, int(np.clip(count // PART_ROWS, 1, PARTS)))

    def part(many: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column("v").flatten().to_numpy().reshape(-1, d)
                chosen = nearest_centre(centres, v)[:, None] if many == 1 else np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :many].astype(np.int32)
                made = pa.ListArray.from_arrays(np.arange(0, chosen.size + 1, chosen.shape[1], dtype=np.int32), pa.array(chosen.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "parts"])

        return run

    columns = "vec_id long, v array<double>, copies long, number long, parts array<int>"
    parted = materialize(rows.select("vec_id", "v", "copies", "number").mapInArrow(part(1), columns).withColumn("part", F.col("parts")[0]).drop("parts"), "parted")
    looked = 1
    if len(centres) > 1:
        queries = asked.select("v", "number", F.xxhash64("number").alias("h")).orderBy("h", "number").limit(ASKED).select("v", "number").toPandas()
        asking = np.stack(queries["v"].to_list())
        near = parted.select("v", "copies", "number", "part").mapInArrow(_nearest_parts(asking, queries["number"].to_numpy(), top), "which int, score double, part int")
        near = near.withColumn("_place", F.row_number().over(Window.partitionBy("which").orderBy(F.desc("score")))).filter(F.col("_place") <= top).select("which", "part").toPandas()
        looked = probes(centres, asking, near["which"].to_numpy(), near["part"].to_numpy())
    sizes = parted.groupBy("part").count().collect()  # a row a part, `PARTS` at most
    pieces, first = [], 0
    for row in sizes:
        n = -(-row["count"] // block)
        pieces.append((row["part"], first, n))
        first += n
    pieces = F.broadcast(rows.sparkSession.createDataFrame(pieces, "part int, first long, pieces long"))
    schema = "block long, ids binary, copies binary, numbers binary, vectors binary, which binary, errors binary, codes binary"
    placed = parted.join(pieces, "part").withColumn("block", F.col("first") + F.pmod(F.xxhash64("number"), F.col("pieces"))).select("vec_id", "v", "copies", "number", "block")
    index = materialize(placed.groupBy("block").applyInArrow(_pack(book), schema), "index")
    discard(parted)
    groups = max(1, -(-n_asked * looked // (len(centres) * QUERIES)))
    sought = (asked.select("vec_id", "v", "copies", "number").mapInArrow(part(looked), columns).withColumn("part", F.explode("parts")).join(pieces, "part")
              .withColumn("block", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("pieces") - 1))))
    grouped = (sought.select("vec_id", "v", "copies", "number", "block").withColumn("group", F.pmod(F.xxhash64("number"), F.lit(groups)))
               .groupBy("block", "group").applyInArrow(_pack(None), schema))
    sent = grouped.select("block", F.col("numbers").alias("asked"), F.col("vectors").alias("queries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, copies, numbers, vectors, which, errors, codes, asked, queries = (batch.column(c)[i].as_buffer() for c in names)
                block = (*(np.frombuffer(x, np.int64) for x in (ids, copies, numbers)), np.frombuffer(vectors).reshape(-1, d), np.frombuffer(which, np.int64), np.frombuffer(errors))
                found = best(book, block, np.frombuffer(codes, np.uint8).reshape(-1, int(block[4].max()) + 1),
                             (None, None, np.frombuffer(asked, np.int64), np.frombuffer(queries).reshape(-1, d)), top)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["number", "vec_id", "score", "times"])

    names = ("ids", "copies", "numbers", "vectors", "which", "errors", "codes", "asked", "queries")
    near = index.join(sent, "block").select(*names).mapInArrow(run, "number long, vec_id long, score double, times long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= top)
    # a row that stands for several equal ones takes that many places
    before = F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spread = near.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < top).select(
        "number", "vec_id", "score", F.explode(F.sequence(F.col("_before") + 1, F.least(F.col("_before") + F.col("times"), F.lit(top)))).alias("_rank")).withColumn("rank", F.col("_rank").cast("int"))
    once = asked.select("number", F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    return spread.join(once, "number").select("query_id", "rank", F.nullif("vec_id", F.lit(int(_NO_ID))).alias("vec_id"), "score")
