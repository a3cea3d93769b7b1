"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become ids of the tokenizers library with an end id; longer ones are cut into
pieces of one sequence's length. Whole-length pieces fill a sequence each. The others are
dealt to shards of bounded size. Every shard is a bin-packing problem that evolves on
several islands. An island's first population is packed in random orders, so that its
members differ; crossover injects whole well-filled bins of one parent into the other, drops
the bins that would repeat a piece, and best-fits the displaced pieces. After each epoch the
islands of a shard pass their elite on in a ring; a shard is done once it has the least
number of bins that any packing can have. At the end the shards' poorly filled bins are
dissolved and their pieces evolve again together.

Only lengths move in shuffles; ids stay where they were made.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import workers
from marlstone.llm.shingles import power_tables, as_bytes, mix64
from marlstone.plans.materialize import materialize

CAPACITY, END_ID = 4096, 1
SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4096, 2, 3, 40, 4
#: Bins filled less than this are dissolved at the end, once, and their pieces, which are few, evolve longer.
DISSOLVE, LAST_GENERATIONS = 0.99, 150
#: Most words that a task keeps with their ids, and the bytes of the longest one kept.
CACHE, LONGEST = 500_000, 64
_BYTES = np.random.default_rng(17).integers(0, 1 << 64, (2, 256), dtype=np.uint64)


class WordCoder:
    """Ids of texts by a tokenizers file that drops white space and lower-cases.

    Words between ASCII white space are looked up in a bounded table of the worker, by two
    64-bit hashes of their bytes and without making Python strings of known words; words of
    more than `LONGEST` bytes are encoded each time. New words of common letters and punctuation are encoded many at a time by the file's model
    behind a shorter pipeline that splits them in the same places, and told apart by their
    bytes; other words go through the file's own pipeline.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the library finds added tokens within texts, so words that may hold one take its own pipeline
        added = [re.escape(t.content.lower()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")
        self.plain = Tokenizer(Tokenizer.from_file(path).model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Punctuation("contiguous"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.sizes[i] = len(token.removesuffix("</w>"))
        # of known words, sorted by the first hash: both hashes and the place of the ids
        self.one, self.two, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Keep the words learnt first, most of which are the frequent ones."""
        kept = min(len(self.first) - 1, CACHE * 3 // 4)
        some = self.slot < kept
        self.one, self.two, self.slot = self.one[some], self.two[some], self.slot[some]
        self.first = self.first[:kept + 1].copy()
        self.flat = self.flat[:self.first[-1]].copy()

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the ids of each of these different words are; new ones are learnt."""
        raw, offsets = as_bytes(words)
        one, two = _word_hashes(raw, offsets)
        place = np.full(len(words), -1)
        if len(self.one):
            at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
            known = (self.one[at] == one) & (self.two[at] == two)
            place[known] = self.slot[at[known]]
        short = np.diff(offsets) <= LONGEST
        place[~short] = -1
        missing = np.flatnonzero(place < 0)
        if len(missing):
            place[missing] = self._learn(words.take(pa.array(missing)).to_pylist())
            new = missing[short[missing]]
            self.one, self.two = np.concatenate([self.one, one[new]]), np.concatenate([self.two, two[new]])
            self.slot = np.concatenate([self.slot, place[new]])
            order = np.argsort(self.one, kind="stable")
            self.one, self.two, self.slot = self.one[order], self.two[order], self.slot[order]
        return place

    def _learn(self, words: list[str]) -> np.ndarray:
        """Encode the words and keep their ids; returns where."""
        plain = np.array([bool(_EASY.fullmatch(w)) and ("<" not in w or not self.added.search(w.lower())) for w in words])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        spots = np.empty(len(words), np.int64)
        spots[order] = np.arange(len(words)) + len(self.first) - 1
        easy, other = [words[i] for i in np.flatnonzero(plain)], [words[i] for i in np.flatnonzero(~plain)]
        flat, first, total = [self.flat], [self.first], len(self.flat)
        groups = [" ".join(easy[i:i + 512]).lower() for i in range(0, len(easy), 512)]
        for a in range(0, len(groups), 32):
            part = groups[a:a + 32]
            for group, made in zip(part, self.plain.encode_batch_fast(part, add_special_tokens=False), strict=True):
                ids = np.array(made.ids, np.int32)
                size = np.fromiter(map(len, group.encode().split(b" ")), np.int64)
                flat.append(ids)
                first.append(total + np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(size)) + 1)
                total += len(ids)
        for a in range(0, len(other), 4096):
            for made in self.tokenizer.encode_batch_fast(other[a:a + 4096], add_special_tokens=False):
                flat.append(np.array(made.ids, np.int32))
                total += len(flat[-1])
                first.append(np.array([total]))
        self.flat, self.first = np.concatenate(flat), np.concatenate(first)
        return spots

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array, without special tokens; none for a null."""
        cut = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = cut.flatten().dictionary_encode()
        at = self._places(coded.dictionary)[coded.indices.to_numpy()]
        size = self.first[at + 1] - self.first[at]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[at] - ends + size, size)]
        if len(self.first) > CACHE:
            self._forget()
        bounds = np.concatenate(([0], ends))[cut.offsets.to_numpy() - cut.offsets[0].as_py()].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]  # noqa: B905


def _word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word: polynomials over two random tables of the byte values."""
    power, inverse = power_tables(len(raw) + 1)
    out = []
    for table in _BYTES:
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(table[raw] * power[:-1], out=total[1:])
        out.append(mix64((total[offsets[1:]] - total[offsets[:-1]]) * inverse[offsets[:-1]]))
    return out[0], out[1]


# Letters that lower-case and compose one by one and keep their number of bytes, and the
# ASCII punctuation but for the apostrophe, which the tokenizer's pattern treats apart.
_EASY = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f!-&(-/:-@\[-`{-~]+")


@lru_cache(maxsize=1)
def _coder(path: str | None) -> WordCoder:
    # a task has one core: the library's threads cost more time than they save
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return WordCoder(path)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids binary: little-endian unsigned 32-bit ids).

    A null or empty text is one piece that holds the end id only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in workers.batches("packing", batches, _coder.cache_clear):
            coder = coder or _coder(path)
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                doc, piece, start, length, ids = [], [], [], [], []
                for i, made in enumerate(coder.encode(part.column(1))):
                    made = np.append(made, end_id).astype("<u4")
                    for k, s in enumerate(range(0, len(made), capacity)):
                        cut = made[s:s + capacity]
                        doc.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(cut))
                        ids.append(cut.tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()),
                                                  pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                                                 names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary")


class Packing:
    """Bins of item numbers, each with its fill."""

    __slots__ = ("bins", "fills")

    def __init__(self, bins: list[list[int]], fills: list[int]):
        self.bins, self.fills = bins, fills

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then more uneven fills, which leave more room to close a bin."""
        return -len(self.bins), sum(f * f for f in self.fills) / capacity**2

    def best_fit(self, items: list[int], sizes: np.ndarray, capacity: int, ordered: bool = True) -> None:
        """Put the items, largest first if `ordered`, where they leave least room; open bins as needed."""
        room = sorted((capacity - f, i) for i, f in enumerate(self.fills) if f < capacity)
        length = sizes.tolist()
        for item in sorted(items, key=lambda i: (-length[i], i)) if ordered else items:
            size = length[item]
            k = bisect_left(room, (size, -1))
            if k < len(room):
                left, at = room.pop(k)
            else:
                left, at = capacity, len(self.bins)
                self.bins.append([])
                self.fills.append(0)
            self.bins[at].append(item)
            self.fills[at] += size
            if left > size:
                insort(room, (left - size, at))

    def labels(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int32)
        for b, items in enumerate(self.bins):
            out[items] = b
        return out

    @staticmethod
    def read(labels: np.ndarray, sizes: np.ndarray) -> Packing:
        bins: list[list[int]] = [[] for _ in range(int(labels.max()) + 1)]
        for item, b in enumerate(labels.tolist()):
            bins[b].append(item)
        return Packing(bins, np.bincount(labels, weights=sizes, minlength=len(bins)).astype(int).tolist())


def _without(parent: Packing, taken: set[int]) -> tuple[Packing, list[int]]:
    """The parent less the bins that hold a taken item, and those bins' other items."""
    bins, fills, loose = [], [], []
    for items, fill in zip(parent.bins, parent.fills, strict=True):
        if taken.isdisjoint(items):
            bins.append(list(items))
            fills.append(fill)
        else:
            loose += [i for i in items if i not in taken]
    return Packing(bins, fills), loose


def crossover(into: Packing, giver: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """`into` with a random half of the giver's better-filled bins injected whole."""
    order = np.argsort(-np.array(giver.fills), kind="stable")[:max(1, len(giver.fills) // 2)]
    chosen = [int(b) for b in order[rng.random(len(order)) < 0.5]] or [int(order[0])]
    taken = {i for b in chosen for i in giver.bins[b]}
    child, loose = _without(into, taken)
    child.bins += [list(giver.bins[b]) for b in chosen]
    child.fills += [giver.fills[b] for b in chosen]
    child.best_fit(loose, sizes, capacity)
    return child


def mutate(packing: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """Dissolve the emptiest bins and a few others, and best-fit their items again."""
    n = len(packing.bins)
    out = set(np.argsort(packing.fills, kind="stable")[:max(1, n // 50)].tolist()) | set(rng.integers(0, n, max(1, n // 50)).tolist())
    child = Packing([list(b) for i, b in enumerate(packing.bins) if i not in out], [f for i, f in enumerate(packing.fills) if i not in out])
    child.best_fit([x for i in out for x in packing.bins[i]], sizes, capacity)
    return child


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """Bins that every packing needs: all lengths together, and those over half a bin."""
    return max(-(-int(sizes.sum()) // capacity), int((sizes > capacity // 2).sum()))


def random_packing(sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """The items best-fitted in a random order."""
    made = Packing([], [])
    made.best_fit(rng.permutation(len(sizes)).tolist(), sizes, capacity, ordered=False)
    return made


def evolve(sizes: np.ndarray, capacity: int, seeds: list[np.ndarray], seed: int, generations: int = GENERATIONS,
           population: int = POPULATION) -> np.ndarray:
    """Bin numbers of the best packing found; stops where no packing can have fewer bins and
    what room is left lies in one of them. `seeds` are packings of earlier epochs; the
    population is filled up in random orders."""
    least = least_bins(sizes, capacity)
    done = lambda p: len(p.bins) <= least and sum(f < DISSOLVE * capacity for f in p.fills) <= 1
    rng = np.random.default_rng(seed)
    pool = [Packing.read(s, sizes) for s in seeds]
    key = lambda p: p.fitness(capacity)
    if not any(map(done, pool)):
        while len(pool) < population:
            pool.append(random_packing(sizes, capacity, rng))
        for _ in range(generations):
            a, b = rng.choice(len(pool), 2, replace=False)
            child = mutate(crossover(pool[a], pool[b], sizes, capacity, rng), sizes, capacity, rng)
            worst = min(range(len(pool)), key=lambda i: key(pool[i]))
            if key(child) > key(pool[worst]):
                pool[worst] = child
            if done(child):
                break
    return max(pool, key=key).labels(len(sizes))


def _evolve_shards(capacity: int, epoch: int, generations: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shard, island, sizes, own, guest in zip(*[batch.column(c).to_pylist() for c in ("shard", "island", "sizes", "own", "guest")], strict=True):
                size = np.array(sizes, np.int64)
                seeds = [np.frombuffer(s, np.int32) for s in (own, guest) if s]
                labels = evolve(size, capacity, seeds, (shard * 31 + island) * 31 + epoch, generations)
                out.append((labels.tobytes(), int(labels.max()) + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("island"), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int32())],
                names=["shard", "island", "own", "bins"])

    return run


def _pack_once(items: DataFrame, count: int, capacity: int, shard_size: int, islands: int, epochs: int, generations: int) -> DataFrame:
    """(item, length, shard, bin) of items (item, length), `count` of them."""
    shards = max(1, -(-count // shard_size))
    dealt = items.select("item", "length", F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard"))
    # at most about shard_size items meet in a row, as ids are unique and hashed
    problems = materialize(dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("neg"), "item"))).alias("items"))
                           .select("shard", "items", F.transform("items", lambda x: -x["neg"]).alias("sizes")), "problems")
    isles = problems.select("shard", "sizes", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    state = None
    for epoch in range(epochs):
        if state is None:
            ready = isles.withColumns({"own": F.lit(None).cast("binary"), "guest": F.lit(None).cast("binary")})
        else:
            guests = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("own").alias("guest"))
            ready = isles.join(state.select("shard", "island", "own"), ["shard", "island"]).join(guests, ["shard", "island"])
        ready = ready.repartition(-(-shards * islands // 8), "shard", "island")  # a task evolves about eight
        state = materialize(ready.mapInArrow(_evolve_shards(capacity, epoch, generations), "shard long, island int, own binary, bins int"), "islands")
    best = state.groupBy("shard").agg(F.min_by("own", F.struct("bins", "island")).alias("own"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, items_, own in zip(*[batch.column(c).to_pylist() for c in ("shard", "items", "own")], strict=True):
                labels = np.frombuffer(own, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["item"] for x in items_], pa.int64()), pa.array([-x["neg"] for x in items_], pa.int64()),
                     pa.array([shard] * len(items_), pa.int64()), pa.array(labels)], names=["item", "length", "shard", "bin"])

    return materialize(problems.join(best, "shard").select("shard", "items", "own").mapInArrow(unpack, "item long, length long, shard long, bin int"), "packed")


def place(pieces: DataFrame, capacity: int = CAPACITY, shard_size: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(item, sequence_id, offset) for pieces (item: unique long, length: 1 to capacity)."""
    full = pieces.filter(F.col("length") >= capacity).select("item", (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = pieces.filter(F.col("length") < capacity).select("item", "length")
    first = _pack_once(items, items.count(), capacity, shard_size, islands, epochs, GENERATIONS)
    fills = first.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    poor = fills.filter(F.col("fill") < DISSOLVE * capacity).select("shard", "bin")
    again = first.join(poor, ["shard", "bin"], "left_semi").select("item", "length")
    second = _pack_once(again, again.count(), capacity, shard_size, islands, epochs, LAST_GENERATIONS)
    # sequence numbers: shard and bin side by side; those of the second pass are odd
    number = lambda odd: (F.col("shard") * shard_size * 16 + F.col("bin")) * 2 + odd
    bins = (first.join(poor, ["shard", "bin"], "left_anti").select("item", "length", number(0).alias("sequence_id"))
            .unionByName(second.select("item", "length", number(1).alias("sequence_id"))))
    # a sequence has at most `capacity` pieces, so its rows may meet
    placed = bins.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("all")).select(
        "sequence_id", F.inline(F.transform("all", lambda x, i: F.struct(
            x["item"].alias("item"), F.aggregate(F.slice("all", 1, i), F.lit(0).cast("long"), lambda s, y: s + y["length"]).alias("offset")))))
    return placed.select("item", "sequence_id", "offset").unionByName(full)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                   capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every input row: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. The ids themselves come from `token_pieces`, which gives the same
    pieces; they are left out here so that they need not move.

    A null text counts as empty: a piece that holds the end id only. Repeated rows and
    rows with a null id are packed each on their own. Ties are broken by row number.
    Empty input gives an empty result. Other columns are not used.
    """
    made = token_pieces(docs, id_col, text_col, path, capacity, end_id)
    pieces = materialize(made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
                                     F.monotonically_increasing_id().alias("item")), "pieces")
    placed = place(pieces.select("item", "length"), capacity)
    return pieces.join(placed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
