"""The pipeline's stages on a small corpus."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_llm_operators import FIELDS, odd_rows
from tidemark.llm.common import materialize


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf_dir), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == names, name
            docs = out
        counts.append(out.count())
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[4] <= counts[3]
    assert out.select("doc_id").distinct().count() == counts[4]


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_rows(spark, sf_dir, number):
    """Nulls, empty and long texts, repeated rows, further columns, and an empty table."""
    name, stage = corpus_pipeline.STAGES[number]
    docs = spark.createDataFrame(odd_rows(), FIELDS).withColumns({c: F.lit(7) for c in ("score", "root", "k", "near_key", "cuts", "piece", "rid", "y")})
    rows = stage(spark, docs, sf_dir).collect()
    none = stage(spark, docs.limit(0), sf_dir)
    assert none.count() == 0
    if name == "best_fit_packing":
        assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r[0] for r in odd_rows())
        return
    assert none.columns == docs.columns and all(len(r) == len(docs.columns) and r.score == 7 for r in rows)
    kept = [(r.doc_id, r.text) for r in rows]
    had = Counter((d, t) for d, t, *_ in odd_rows())
    if name == "simhash_near_dedup":
        assert (1, had and [t for d, t, *_ in odd_rows() if d == 1][0]) in kept and (2, odd_rows()[1][1]) not in kept
        assert sum(t is None or not t.split() for _, t in kept) == 1
    if name == "substring_dedup":
        assert Counter(d for d, _ in kept) == Counter(d for d, *_ in odd_rows())
        assert sum(t is None for _, t in kept) == sum(t is None for _, t, *_ in odd_rows())
    if name == "benchmark_decontamination":
        assert Counter(kept) == had
    if name == "quality_classifier":
        assert not Counter(kept) - had and len({n for _, n in Counter(k for k in kept if k == odd_rows()[1][:2]).items()} - {2}) == 0


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_equals_brute_force(spark, sf_dir):
    """All stages worked out with plain loops; the trained classifier is shared."""
    import re
    import zlib
    from collections import Counter

    import numpy as np
    from tidemark.llm import decontamination, quality_fm, simhash, stages, tokens
    from tidemark.llm.common import doc_crc

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = quality_fm.fit(quality_fm.labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_crc() % 4 != 2))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    scores = machine.score(quality_fm.featurize([t for _, t in rows], {}))
    rows = [r for r, s in zip(rows, scores) if s >= stages.QUALITY]

    # sampled tables reach a recall of 0.99 at similarity 0.8, so the groups found are held against all pairs
    scored = spark.createDataFrame(rows, "doc_id long, text string")
    root = {r.doc_id: r.root for r in simhash.similar_groups(scored, 0.8, 5).collect()}
    fps = simhash.wide_fingerprints([(t or "").encode() for _, t in rows], 5)
    shingles = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t in rows)]
    group, similar = list(range(len(rows))), []
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]).sum(axis=1) <= simhash.radius_for(0.8)).tolist():
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
        similar += [root[rows[i][0]] == root[rows[j][0]] for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    by_root = {}
    for i, r in enumerate(rows):
        assert group[i] == group[by_root.setdefault(root[r[0]], i)]
    assert len(similar) > 5 and sum(similar) >= 0.95 * len(similar)
    rows = [r for i, r in enumerate(rows) if by_root[root[r[0]]] == i]

    first, out = {}, []
    for d, t in rows:
        w = t.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) < d:
                gone[i : i + 50] = [True] * 50
        parts = re.split(rb"([\x20\x09-\x0D]+)", t.encode())  # words and white space in turn
        lead = parts[0] == b""
        spaced = [(parts[i], parts[i + 1] if i + 1 < len(parts) else b"") for i in range(2 * lead, len(parts), 2) if parts[i]]
        out.append((d, ((parts[1] if lead and len(parts) > 1 else b"") + b"".join(x + y for (x, y), g in zip(spaced, gone) if not g)).decode() if any(gone) else t))
    rows = out

    items = [decontamination._symbols(w) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if (w := decontamination.words_of(r.text))]

    def leaks(t):
        w = decontamination.words_of(t)
        s = decontamination._symbols(w)
        return any(decontamination.best_region(i, s)[0] <= decontamination.allowed_edits(len(i), 0.8) for i in items)

    rows = [r for r in rows if not leaks(r[1])]
    tok, want = tokens.tokenizer(tokens.default_path()), Counter()
    for d, t in rows:
        ids = tok.encode_bytes(t) + (1).to_bytes(4, "little")
        for k, a in enumerate(range(0, len(ids), 4 * 4096)):
            want[d, k, len(ids[a : a + 4 * 4096]) // 4, zlib.crc32(ids[a : a + 4 * 4096])] += 1
    got = Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want
