"""Operators against plain loops on small inputs."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import anisotropic, jaccard_join, packing, png_media, quality, shingles, substring_dedup, url_trust

DOCS = "doc_id long, text string"


def _statistics(text: str) -> list[float]:
    data = text.encode()
    words = [w for w in __import__("re").split(r"[ \t\n\r\f\v]+", text) if w]
    count = lambda members: sum(b in members for b in data)
    chars, n, lines = max(len(text), 1), len(words), text.count("\n") + 1
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / max(n, 1)
    spread = max(sum(s * s for s in sizes) / max(n, 1) - mean**2, 0) ** 0.5
    upper, lower = count(quality._KINDS["upper"]), count(quality._KINDS["lower"])
    pairs = Counter(zip(words, words[1:], strict=False))
    repeated = (max(n - 1, 1) - len(pairs)) / max(n - 1, 1) if n > 1 else 0
    root = lambda a, b: (a / b) ** 0.5
    log = np.log1p
    return [log(n), log(lines), log(mean), log(spread), log(max(sizes)), root(upper, max(upper + lower, 1)), *[root(count(quality._KINDS[k]), chars) for k in (
        "digit", "symbol", "pipe", "loud", "stop")], log(len(set(words))) / log(max(n, 1)), log(n / lines), root(repeated, 1), root(sum(s == 1 for s in sizes if n), max(n, 1)),
        root(sum(w[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for w in words), max(n, 1))]


def test_quality_statistics_are_those_of_a_plain_loop():
    rng = random.Random(5)
    texts = ["", " \n ", "one", "A b A b", "x\ty\n\nz"] + ["".join(rng.choice("abcXYZ é漢0.!|# \n\t") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    raw, offsets = shingles.as_bytes(pa.array(texts))
    got = quality.statistics(raw, offsets)
    for text, row in zip(texts, got, strict=True):
        assert np.allclose(row, _statistics(text)), text


def test_a_class_with_few_rows_leans_on_the_pooled_covariance():
    rng = np.random.default_rng(2)
    many, few = rng.normal(0, 1, (500, 4)), rng.normal(3, 1, (3, 4))
    moments = lambda v: (float(len(v)), v.sum(0), v.T @ v)
    fit = lambda a, b: quality.Discriminant.fit(*[np.array(x) for x in zip(moments(a), moments(b), strict=True)])
    model = fit(many, few)
    assert np.isfinite(model.factors).all() and (model.score(rng.normal(0, 1, (50, 4))) < 0.5).mean() > 0.9
    steps = [fit(many, rng.normal(3, 1, (k, 4))).logdets[1] for k in range(1, 12)]
    assert max(abs(np.diff(steps))) < 1.5  # no jump where the class passes the number of statistics


def test_fit_takes_a_bounded_share_of_labels(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(4000)] + [(None, 1), (5, 3)], "doc_id long, quality int")
    assert quality.fit_labels(labels).count() == sum(__import__("zlib").crc32(str(k).encode()) % 4 != 2 for k in range(4000))
    assert 350 < quality.fit_labels(labels, fit_ids=500).count() < 650


def _pagerank(edges, good, bad, d=url_trust.DAMPING):
    hosts = sorted({h for e in edges for h in e[:2]} | set(good) | set(bad))
    at = {h: i for i, h in enumerate(hosts)}
    links = np.zeros((len(hosts), len(hosts)))
    for a, b, n in edges:
        links[at[a], at[b]] = n
    share = lambda m: m / np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
    out = []
    for seeds, m in ((good, share(links)), (bad, share(links.T))):
        start = np.zeros(len(hosts))
        for h, n in seeds.items():
            start[at[h]] = n
        out.append(np.linalg.solve(np.eye(len(hosts)) - d * m.T, (1 - d) * start))
    return {h: (out[0][i], out[1][i]) for h, i in at.items()}


@pytest.mark.parametrize("hub", [False, True])
def test_ranks_are_those_of_the_linear_system(spark, monkeypatch, hub):
    if hub:  # deal a hub's edges to several parts
        monkeypatch.setattr(url_trust, "LEAST_ROWS", 5)
        monkeypatch.setattr(url_trust, "MOST_HOT", 50)
    rng = random.Random(3)
    names = [f"h{i}" for i in range(60)]
    edges = {(a, b): float(rng.randint(1, 5)) for a, b in (rng.sample(names, 2) for _ in range(200))}
    edges |= {("h0", b): 1.0 for b in names[1:40]} | {(a, "h1"): 2.0 for a in names[20:]}
    edges = [(a, b, n) for (a, b), n in edges.items()]
    good, bad = {"h0": 3.0, "h5": 1.0}, {"h1": 2.0, "h7": 4.0, "alone": 1.0}
    seeds = spark.createDataFrame([(h, good.get(h, 0.0), bad.get(h, 0.0)) for h in {*good, *bad}], "host string, good double, bad double")
    got = {r.host: (r.trust, r.distrust) for r in url_trust.spread(spark.createDataFrame(edges, "src string, dst string, links double"), seeds).collect()}
    for host, (trust, distrust) in _pagerank(edges, good, bad).items():
        a, b = got.get(host, (0.0, 0.0))
        assert abs(a - trust) < 1e-4 and abs(b - distrust) < 1e-4


def test_the_first_of_equally_long_rules_wins(spark):
    pages = spark.createDataFrame([(1, "http://x.b.org/a/z", "")], "page_id long, url string, html string")
    rules = (("allow", "b.org/a"), ("block", "org/a/z"))
    for order, want in ((rules, ("b.org/a", "allow")), (rules[::-1], ("org/a/z", "block"))):
        row = url_trust.url_verdicts(pages, order).first()
        assert (row.rule, row.verdict) == want


def test_every_row_but_the_own_is_a_candidate(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [5.0, 0.0]), (2, [2.0, 0.0]), (None, [3.0, 0.0]), (0, [4.0, 0.0]), (0, [1.0, 0.0]), (3, [9.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in anisotropic.search(table, table.filter("vec_id = 0 and embedding[0] = 4")).orderBy("rank").collect()]
    assert got == [(1, 20.0), (None, 12.0), (2, 8.0), (0, 4.0), (0, 4.0), (1, 4.0)]
    twice = anisotropic.search(table, table.filter("vec_id = 0 and embedding[0] = 1")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in twice[::2]] == [(1, 5.0), (0, 4.0), (None, 3.0), (2, 2.0), (0, 1.0), (1, 1.0)] and twice[::2] == twice[1::2]
    assert anisotropic.search(table, table.filter("vec_id = 3")).isEmpty()


def test_quantised_search_finds_nearly_all_of_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, 16))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in anisotropic.search(table, table.filter("vec_id % 100 = 0")).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 3000, 100):
        order = np.argsort(-(vectors @ vectors[q]), kind="stable")
        hits += len(found[q] & set([i for i in order.tolist() if i != q][:20]))
    assert hits / (20 * 30) >= 0.95


def _plain_hash(image: np.ndarray) -> str:
    side, low = png_media.SIDE, png_media.LOW
    h, w = image.shape
    grid = np.repeat(image, -(-side // h), axis=0) if h < side else image
    cut = lambda n: [(i * n // side, (i + 1) * n // side) for i in range(side)]
    small = np.array([[grid[a:b, c:d].mean() for c, d in cut(w)] for a, b in cut(grid.shape[0])])
    wave = lambda k, x: np.cos(np.pi * k * (2 * x + 1) / (2 * side))
    made = [round(float(sum(small[y, x] * wave(u, y) * wave(v, x) for y in range(side) for x in range(side))), 6) for u in range(low) for v in range(low)]
    bits = "".join("1" if m > np.median(made[1:]) else "0" for m in made)
    return f"{int(bits, 2):016x}"


def test_png_features_by_a_plain_loop(spark):
    texts = ["", "a", "some words " * 300, "\n".join(f"line {k}" for k in range(9000))]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    media = {r.doc_id: bytes(r.media) for r in png_media.to_media(df).collect()}
    for r in png_media.media_features(png_media.to_media(df)).collect():
        payload = png_media.pad(texts[r.doc_id].encode())
        image = np.frombuffer(payload, np.uint8).reshape(-1, png_media.WIDTH)
        assert r.feature == _plain_hash(image)
        assert (r.media_sha256, r.media_bytes) == (hashlib.sha256(media[r.doc_id]).hexdigest(), len(media[r.doc_id]))


def test_substring_dedup_is_that_of_a_plain_loop(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgé漢") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(10, 80))) for _ in range(12)]
    texts = {}
    for k in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))] + [p for p in passages if rng.random() < 0.2]
        rng.shuffle(parts)
        texts[k] = "\n".join(parts)
    texts[60], texts[61] = texts[3], ""
    seen, spans = set(), defaultdict(list)
    for k in sorted(texts):
        data = texts[k].encode()
        starts = substring_dedup.chunk_starts(data)
        for a, b in zip(starts, [*starts[1:], len(data)], strict=False):
            if data[a:b] in seen:
                spans[k].append((a, b))
            seen.add(data[a:b])
    want = {}
    for k, text in texts.items():
        data, runs = text.encode(), []
        for a, b in spans[k]:
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        for a, b in reversed([r for r in runs if r[1] - r[0] >= substring_dedup.LEAST_RUN]):
            data = data[:a] + data[b:]
        want[k] = data.decode()
    out = substring_dedup.substring_dedup(spark.createDataFrame(list(texts.items()), DOCS)).collect()
    assert {r.doc_id: r.text for r in out} == want and sum(t != texts[k] for k, t in want.items()) > 10


def test_genetic_packing_beats_best_fit():
    # best fit puts two of the larger ones together and wastes the rest; 1640 + 2 * 1228 fills a bin
    sizes = np.array([1640] * 40 + [1228] * 80, np.int64)
    first = packing.Packing([], [])
    first.best_fit(list(range(120)), sizes, 4096)
    labels = packing.evolve(sizes, 4096, [], 1)
    fill = np.bincount(labels, weights=sizes)
    assert fill.max() <= 4096 and packing.least_bins(sizes, 4096) <= len(fill) < len(first.bins)


def test_populations_differ_and_evolve():
    rng = np.random.default_rng(6)
    sizes = rng.integers(20, 3500, 1500).astype(np.int64)
    pool = [packing.random_packing(sizes, 4096, rng) for _ in range(4)]
    assert len({tuple(map(tuple, p.bins)) for p in pool}) == 4
    evolved = int(packing.evolve(sizes, 4096, [], 1).max()) + 1
    assert evolved < min(len(p.bins) for p in pool)


def test_trie_walk_connects_what_all_pairs_connect():
    rng = np.random.default_rng(8)
    size = jaccard_join.TREES * jaccard_join.DEPTH
    for _ in range(40):
        base = rng.integers(0, 256, (4, size), dtype=np.uint8)
        sig = base[rng.integers(0, 4, 30)].copy()
        noise = rng.random(sig.shape) < rng.choice([0.02, 0.15, 0.3])
        sig[noise] = rng.integers(0, 256, int(noise.sum()), dtype=np.uint8)
        label = sig[:, :8].copy()
        order = np.lexsort(label.T[::-1])
        sig, label = sig[order], label[order]
        links = jaccard_join.trie_links(sig, label, 1, 83)
        near = (sig[:, None] == sig[None]).sum(axis=2) >= 83

        def groups(pairs, n=len(sig)):
            parent = list(range(n))

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in pairs:
                u, v = sorted((find(a), find(b)))
                parent[v] = u
            return [find(i) for i in range(n)]

        assert all(near[a, b] for a, b in links) and len(links) < len(sig)
        assert groups(links) == groups(zip(*np.nonzero(near), strict=True))


def test_recall_is_measured_on_the_data(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(40)]
    rows = []
    for k in range(400):
        words = list(base[k % 40])
        for _ in range(rng.randint(3, 9)):
            words[rng.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(words)))
    signed = jaccard_join.sign(spark.createDataFrame(rows, DOCS), "doc_id", "text", 5)
    pairs, recall = jaccard_join.measured_recall(signed, 0.8)
    assert pairs > 50, pairs
    assert recall == sorted(recall, reverse=True) and recall[3] > 0.99 > recall[7], recall


def test_near_copies_without_ids_meet_once(spark):
    """Rows without an id, and rows of one id, are paired by their texts, not by the id."""
    base = [f"w{i}" for i in range(60)]
    rows = [(None if k % 2 else 7, " ".join([*base, f"x{k}"])) for k in range(300)] + [(None, " ".join(base))] * 200
    out = jaccard_join.jaccard_join(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.class_id, r.n_texts, r.class_size) for r in out} == {(7, 300, 500)}
    assert Counter(r.n_links for r in out) == {499: 500}


def test_search_finds_the_nearest_in_tight_clusters_and_among_long_vectors(spark):
    rng = np.random.default_rng(8)
    clusters = rng.normal(size=(4, 16))[rng.integers(0, 4, 10_000)] + 0.02 * rng.normal(size=(10_000, 16))
    long = rng.normal(size=(10_000, 16)) * (rng.pareto(1.2, 10_000) + 0.1)[:, None]
    for vectors in (clusters, long):
        table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        found = defaultdict(set)
        for r in anisotropic.search(table, table.filter("vec_id % 100 = 0")).collect():
            found[r.query_id].add(r.vec_id)
        score = vectors[::100] @ vectors.T
        score[np.arange(100), np.arange(0, 10_000, 100)] = -np.inf
        near = np.argsort(-score, axis=1)[:, :20]
        assert sum(len(found[100 * k] & set(row.tolist())) for k, row in enumerate(near)) / 2000 >= 0.97


def test_a_block_gives_its_best_rows_whatever_their_codes(spark):
    rng = np.random.default_rng(9)
    for vectors in (rng.normal(size=(3, 8))[rng.integers(0, 3, 3000)] + 1e-3 * rng.normal(size=(3000, 8)), 1e-30 * rng.normal(size=(3000, 8)), 1e180 * rng.normal(size=(3000, 8))):
        book = anisotropic.Codebook.fit(vectors[:500] / np.abs(vectors).max())
        book.centres *= np.abs(vectors).max()
        code, ids = book.codes(vectors), np.arange(3000)
        rows = (ids, np.ones(3000, np.int64), ids, vectors, ids, book.errors(vectors, code))
        made = anisotropic.best(book, rows, anisotropic.pack_codes(code), (None, None, ids[:20], vectors[:20]), 20)
        with np.errstate(all="ignore"):
            score = (vectors[None, :20].transpose(1, 0, 2) * vectors[None]).sum(2)
        for q in range(20):
            want = [i for i in np.lexsort((ids, -score[q])).tolist() if i != q][:20]
            assert made[1][made[0] == q].tolist() == want
