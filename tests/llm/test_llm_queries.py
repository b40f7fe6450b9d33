"""Every opN_ query over whole small tables: against its SQL, or against plain loops."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_llm_operators import check_packing, dedup, fingerprint, measures, PlainModel
from tidemark.llm import decontamination, language_id, quality_fm, queries, tokens
from tidemark.llm.common import doc_crc


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())


def run(spark, sf_dir, name):
    return queries.queries()[name](spark, sf_dir)


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "clicks", "clients"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = run(spark, sf_dir, name)
    columns = sorted(got.columns)
    want = c.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want.select(*columns).fetchall())


def test_op1(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_path())
    got = {r.doc_id: r.n_tokens for r in run(spark, sf_dir, "op1_separator_scan_tokens").collect()}
    assert got == {d: len(tok.encode(t or "", add_special_tokens=False).ids) for d, t in docs}


def test_op2(spark, sf_dir, docs):
    got = {r.doc_id: tuple(r)[1:6] for r in run(spark, sf_dir, "op2_quality_cascade").collect()}
    assert got == {d: measures(t) for d, t in docs}


def test_op3(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op3_simhash_dedup").collect()
    fps = np.array([fingerprint(t) for _, t in docs], dtype=np.uint64)
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == {d: int(f) for (d, _), f in zip(docs, fps)}
    least = [d for d, _ in docs]
    for _ in docs:
        new = [min(least[j] for j in np.flatnonzero(np.bitwise_count(fps ^ f) <= 4).tolist()) for f in fps]
        if new == least:
            break
        least = new
    assert {r.doc_id: r.component_id for r in rows} == {d: c for (d, _), c in zip(docs, least)}


def test_op4(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op4_language_id").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert {r.doc_id: r.held_out for r in rows} == {d: crc(d) % 5 == 0 for d, _ in docs}
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.95
    # the whole table against exact sets of n-grams, without a Bloom table
    seen, sizes, want = {}, Counter(), {}
    lang = {r.doc_id: r.lang for r in rows}

    def grams(t):
        w = b"".join(b" " + x for x in (t or "").lower().encode().translate(language_id._TO_SPACE).split()) + b" "
        return [w[i : i + 4] for i in range(len(w) - 3) if b" " not in w[i + 1 : i + 3]]

    for d, t in docs:
        if crc(d) % 5 and t is not None and lang[d] is not None:
            seen.setdefault(lang[d], set()).update(grams(t))
            sizes[lang[d]] += 1
    for d, t in docs:
        if not t or not any(map(str.isalpha, t)):
            want[d] = "und"
            continue
        hits = {x: sum(g in seen[x] for g in grams(t)) for x in sorted(seen)}
        want[d] = max(hits, key=lambda x: (hits[x], [-ord(c) for c in x])) if any(hits.values()) else max(sizes, key=sizes.get)
    assert np.mean([want[r.doc_id] == r.lang_pred for r in rows]) > 0.99


def test_op5(spark, sf_dir, docs):
    assert Counter(tuple(r) for r in run(spark, sf_dir, "op5_debruijn_dedup").collect()) == dedup(docs)


def test_op6(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op6_byte_shards").collect()
    total, end, slots, want = sum(len((t or "").encode()) + 1 for _, t in docs), 0, Counter(), set()
    for d, t in docs:
        size = len((t or "").encode()) + 1
        end += size
        shard = min(15, (2 * end - size) * 16 // (2 * total))
        want.add((d, size, zlib.crc32((t or "").encode()), "bytes", shard, slots[shard], None))
        slots[shard] += 1
    assert {tuple(r) for r in rows} == want and len(rows) == len(docs)


def test_op7(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op7_quality_fm").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert {r.doc_id: r.held_out for r in rows} == {d: crc(d) % 4 == 2 for d, _ in docs}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    # the same machine, its polynomial summed term by term
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = quality_fm.fit(quality_fm.labelled_sample(frame, spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_crc() % 4 != 2))
    text = dict(docs)
    for r in rows:
        f = quality_fm.featurize([text[r.doc_id]], {})
        i, x = f.index, f.value.astype(float)
        z = machine.w0 + float(machine.w[i] @ x)
        gram = (machine.v[i].astype(float) @ machine.v[i].astype(float).T) * np.outer(x, x)
        z += np.triu(gram, 1).sum()
        assert r.score == pytest.approx(1 / (1 + np.exp(-(machine.scale * z + machine.shift))), abs=1e-4)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([[(a > b) + 0.5 * (a == b) for a in good] for b in bad]) > 0.9


def test_op8(spark, sf_dir, docs):
    items = {r.item_id: decontamination.words_of(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = set()
    for d, t in docs:
        s = decontamination._symbols(decontamination.words_of(t))
        for i, w in items.items():
            if w and len(s) and decontamination.best_region(decontamination._symbols(w), s)[0] <= decontamination.allowed_edits(len(w), 0.8):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in run(spark, sf_dir, "op8_cgk_decontamination").collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_op9(spark, sf_dir, docs):
    plain = PlainModel([t for d, t in docs if crc(d) % 10])
    rows = {r.doc_id: tuple(r) for r in run(spark, sf_dir, "op9_backoff_lm").collect()}
    for d, t in docs:
        want = plain.row(t)
        assert rows[d][1:5] == (crc(d) % 10 == 0, *want[:3])
        assert rows[d][5:] == pytest.approx(want[3:])


def test_op10(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op10_sum_of_squares_packing").collect()
    tok, want = tokens.tokenizer(tokens.default_path()), Counter()
    for d, t in docs:
        ids = tok.encode_bytes(t or "") + (1).to_bytes(4, "little")
        for k, a in enumerate(range(0, len(ids), 4 * 4096)):
            want[d, k, a // 4, len(ids[a : a + 4 * 4096]) // 4, zlib.crc32(ids[a : a + 4 * 4096])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    n = check_packing(rows, 4096)
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1
