"""The whole pipeline against plain loops over the same documents."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq

from marlstone.llm import quality, substring_dedup
from .test_brute_force import _statistics
from .test_operators import _brute_classes

SF = "/root/testdata/sf0.001"


def _table(name, *columns):
    return list(zip(*[c.to_pylist() for c in pq.read_table(f"{SF}/{name}.parquet", columns=list(columns)).columns], strict=True))


def _kept(docs, labels):
    """Documents that the discriminant, written out by density, takes for class 1."""
    x = {k: np.array(_statistics(t)) for k, t in docs.items()}
    rows = {c: np.array([x[k] for k, y in labels if y == c and k in x and zlib.crc32(str(k).encode()) % 4 != 2]) for c in (0, 1)}
    scatter = {c: (v - v.mean(0)).T @ (v - v.mean(0)) for c, v in rows.items()}
    n, d = {c: len(v) for c, v in rows.items()}, len(quality.FEATURES)
    pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
    scale = np.diag(np.sqrt(np.maximum(np.diag(pooled), 1e-6)))
    log = {}
    for c in (0, 1):
        w = (1 - quality.POOLING) * n[c] / max(n[c] + 2 * quality.POOLING * d, 1)
        cov = np.linalg.inv(scale) @ (w * scatter[c] / n[c] + (1 - w) * pooled) @ np.linalg.inv(scale)
        cov = scale @ ((1 - quality.RIDGE) * cov + quality.RIDGE * np.eye(d) * np.trace(cov) / d) @ scale
        inverse, logdet = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        log[c] = {k: -0.5 * (v - rows[c].mean(0)) @ inverse @ (v - rows[c].mean(0)) - 0.5 * logdet for k, v in x.items()}
    odds = np.log((n[1] + 1) / (n[0] + 1))
    score = {k: 1 / (1 + np.exp(-(quality.TEMPER * (log[1][k] - log[0][k]) + odds))) for k in docs}
    return {k: t for k, t in docs.items() if score[k] >= quality.THRESHOLD}


def _without_passages(docs):
    first, out = {}, {}
    for k in sorted(docs):
        lines = docs[k].split("\n")
        gone = set()
        for i, pair in enumerate(zip(lines, lines[1:], strict=False)):
            place = first.setdefault(pair, (k, i))
            if place != (k, i):
                gone |= {i + 1} if place == (k, i - 1) else {i, i + 1}
        out[k] = "\n".join(line for i, line in enumerate(lines) if i not in gone)
    return out


def _without_substrings(docs):
    seen, out = set(), {}
    for k in sorted(docs):
        data, runs = docs[k].encode(), []
        starts = substring_dedup.chunk_starts(data)
        for a, b in zip(starts, [*starts[1:], len(data)], strict=False):
            if data[a:b] in seen:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            seen.add(data[a:b])
        for a, b in reversed([r for r in runs if r[1] - r[0] >= substring_dedup.LEAST_RUN]):
            data = data[:a] + data[b:]
        out[k] = data.decode()
    return out


def test_the_pipeline_is_that_of_plain_loops(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = dict(_table("documents", "doc_id", "text"))
    kept = _kept(docs, _table("labels", "doc_id", "quality"))
    assert 0 < len(kept) < len(docs)
    lined = _without_passages(kept)
    assert lined != kept
    classes = _brute_classes(lined)
    least = {}
    for k in sorted(lined):  # texts without words are near duplicates of equal ones only
        least.setdefault(lined[k], k)
    single = {k: t for k, t in lined.items() if (classes[k][0] == k if t.split() else least[t] == k)}
    assert len(single) < len(lined)
    cut = _without_substrings(single)
    assert cut != single
    coder = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = {}
    for k, t in cut.items():
        ids = np.array(coder.encode(t, add_special_tokens=False).ids + [1], "<u4")
        want |= {(k, i): (s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes())) for i, s in enumerate(range(0, len(ids), 4096))}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for own in fill.values():
        assert np.cumsum([0, *[n for _, n in sorted(own)]])[:-1].tolist() == [o for o, _ in sorted(own)] and sum(n for _, n in own) <= 4096
    assert len(fill) <= -(-sum(r.length for r in rows) // 4096) + 1
