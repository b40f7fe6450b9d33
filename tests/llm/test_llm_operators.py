"""The operators against brute force, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontamination, language_id, language_model, packing, quality_fm, quality_rules, sharding, simhash, substring_dedup, token_counts, tokens
from tidemark.llm.common import Words, doc_crc

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(9000))
BASE = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))


def odd_rows():
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    return [
        (1, BASE, "en", "a", 10),
        (2, BASE, None, None, None),
        (2, BASE, None, None, None),
        (2, "other text of the same id", "fr", "b", 3),
        (3, None, None, "a", None),
        (4, "", "en", "a", 0),
        (5, " \n\t ", "en", "a", 4),
        (6, LONG, "en", "a", len(LONG)),
        (7, "a b c a b c a b c\nline\nline\n\nline", "en", "a", 9),
        (8, "word", "de", "a", 4),
        (None, BASE, "en", "a", 1),
        (None, None, None, None, None),
        (9, "Éa ñ 日本 12 &&& ### <b>", "es", "a", 9),
        (10, BASE + " tail words that differ here", "en", "a", 9),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    """Also with further columns whose names the operators use."""
    d = spark.createDataFrame(odd_rows(), FIELDS)
    return d.withColumns({n: F.lit(7) for n in ("score", "held_out", "size", "shard", "slot", "cuts", "fp", "_row", "_part", "rid", "kept", "_words", "root", "piece", "y")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], FIELDS)


def words(t):
    return (t or "").encode().split()


# token counts


def test_token_counts(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_path())
    tok.encode_special_tokens = True
    got = sorted((r.doc_id is not None, r.doc_id, r.n_tokens) for r in token_counts.document_token_counts(odd, tokens.default_path()).select("doc_id", "n_tokens").collect() if r.doc_id is not None)
    want = sorted((True, d, len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in odd_rows() if d is not None)
    assert got == want
    assert token_counts.document_token_counts(none, tokens.default_path()).count() == 0


@pytest.mark.parametrize("block", [1, 3, 4, 1000])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = []
    for name in ("a.bin", "b.bin"):
        ids = np.where(rng.random(60) < 0.2, 9, rng.integers(0, 9, 60)).astype("<u2")
        ids[:2] = 9
        (tmp_path / name).write_bytes(ids.tobytes())
        places = np.flatnonzero(ids == 9)
        want += [(name, k, int(n), True) for k, n in enumerate(np.diff(np.concatenate([[-1], places])) - 1)]
        if places[-1] < 59:
            want.append((name, len(places), int(59 - places[-1]), False))
    (tmp_path / "empty.bin").write_bytes(b"")
    got = token_counts.count_tokens(spark, f"file://{tmp_path}", end_id=9, width=2, block_tokens=block)
    assert sorted((r.file, r.nth, r.n_tokens, r.complete) for r in got.collect()) == sorted(want)


def test_token_files_refuse_what_they_cannot_hold(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    ids = tokens.tokenizer(tokens.default_path()).encode("some words here").tolist()
    for end, width in ((ids[1], 2), (49407, 1)):
        with pytest.raises(Exception, match="holds the end token|does not fit"):
            token_counts.write_token_files(docs, f"file://{tmp_path}/t{width}", tokens.default_path(), end_id=end, width=width).count()


def test_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_path())
    tok.encode_special_tokens = True
    mine = tokens.tokenizer(tokens.default_path())
    for t in ["I'm don't  é é <|endoftext|> a'b\x1cq\x1d ́x", "İstanbul ﬁ 12a3", "'LL 'S x''s '''d ×÷ ªº ß ẞ", "日本 🙂🙂 a🙂b", "", "a" * 300]:
        assert mine.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_cache_generations():
    made = []
    cache = tokens._Cache(lambda k: made.append(k) or k.encode(), 3)
    for key in "abcabcdefgabc":
        assert cache[key] == key.encode()
        assert len(cache) <= 3 and len(cache._old) <= 3
    assert made[:3] == ["a", "b", "c"] and len(made) < 13
    long = "x" * (tokens.CACHE_CHARS + 1)
    assert cache[long] == long.encode() and long not in cache


# quality rules


def measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = list(zip(w, w[1:], w[2:]))
    n, cover, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if n[g] > 1:
            cover |= {i, i + 1, i + 2}
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(cover)


def test_quality_rules(odd, none):
    got = quality_rules.judge(odd).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(odd_rows())
    for r in got:
        m = measures(r.text)
        assert tuple(r)[1:6] == m
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(none).count() == 0


def test_rule_order_never_changes_the_verdict(odd):
    rules = quality_rules.text_rules()
    a = quality_rules.judge(odd, rules=rules).select("doc_id", "text", "kept").collect()
    b = quality_rules.judge(odd, rules=rules[::-1]).select("doc_id", "text", "kept").collect()
    assert Counter(a) == Counter(b)


def test_the_sample_is_bounded(spark):
    docs = spark.range(20_000).select(F.col("id").cast("string").alias("text"), F.lit(1).alias("other"))
    got = quality_rules.sample_of(docs, rows=100)
    assert got.columns == ["text"] and got.count() == 100
    assert quality_rules.sample_of(docs.limit(30), rows=100).count() == 30
    assert "other" not in got._jdf.queryExecution().optimizedPlan().toString().split("Range")[0].replace("AS other", "")


def test_rules_are_ordered_by_what_is_left():
    rules = [quality_rules.Rule(n, None) for n in "abcd"]
    rejects = [[True, True, False, False]] * 6 + [[False, True, False, True]] * 2 + [[False, False, True, False]] * 3
    order = quality_rules.greedy_order(rules, [1.0, 2.0, 1.0, 1.0], rejects)
    # a: 6 a second; of the rows left c rejects 3, then b 2 at twice the cost of d's 2
    assert [r.name for r in order] == ["a", "c", "d", "b"]


def test_columns_of_like_names_stay(spark):
    d = spark.createDataFrame([(1, "a b c " * 40, 5, 6, 7, 8)], "doc_id long, text string, __words int, __h int, __near_key int, __cuts int")
    assert quality_rules.judge(d).select("__words", "__h").first() == (5, 6)
    assert simhash.keep_one(d).first() == d.first() and simhash.keep_similar(d).first() == d.first()
    assert substring_dedup.dedup_rows(d).first() == d.first()


# SimHash


def fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_on_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert Counter(r.fp & (1 << 64) - 1 for r in got) == Counter(fingerprint(t) for _, t, *_ in odd_rows())
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    assert by[(3, 0)] == by[(4, 0)] == by[(5, 0)] == 3
    assert len({r.component_id for r in got if r.fp & (1 << 64) - 1 == fingerprint(BASE)}) == 1
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({r.component_id for r in got})


def test_links_and_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 40)
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = []
    for f in fps[:3]:  # groups of many near copies, chained
        for _ in range(120):
            f = f ^ np.uint64(1 << int(rng.integers(64)))
            near.append(f)
    fps = np.unique(np.concatenate([fps, np.array(near, dtype=np.uint64), np.zeros(1, np.uint64)]))
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    from tidemark.llm.components import connected_components

    d = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for blocks in (6, 7):
        roots = {r.v: r.root for r in connected_components(simhash.links(d, 4, simhash.block_masks(blocks, 4))).collect()}
        mine = [roots.get(int(x), int(x)) for x in fps.view(np.int64)]
        groups, want = {}, {}
        for i, m in enumerate(mine):
            groups.setdefault(m, set()).add(i)
            want.setdefault(root(i), set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_bit_sliced_distances():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 130, dtype=np.uint64)
    fps[50:90] = fps[0] ^ (np.uint64(1) << rng.integers(0, 63, 40).astype(np.uint64))
    for radius in (0, 3, 4, 7):
        rows, lanes = simhash._lanes(simhash.within(fps, simhash.planes_of(fps), radius))
        got = {(a, b) for a, b in zip(rows.tolist(), lanes.tolist()) if b < len(fps)}
        want = {(i, j) for i in range(130) for j in range(130) if int(fps[i] ^ fps[j]).bit_count() <= radius}
        assert got == want


def test_wide_fingerprints_equal_brute_force():
    texts = [t.encode() for t in ("", "one", "one two three four five six", "ONE two three four five six", BASE, BASE + " x y z", "a b c d e f g h " * 40)]
    got = simhash.wide_fingerprints(texts, 5)
    salts = simhash.mix64(np.arange(1, 5, dtype=np.uint64))
    for t, fp in zip(texts, got):
        w = Words([t], lower=True).hash
        h = []
        for i in range(max(1, len(w) - 4) if len(w) else 0):
            x = np.zeros(1, np.uint64)
            for j in range(5):
                x = simhash.mix64(x + (w[i + j : i + j + 1] if i + j < len(w) else np.zeros(1, np.uint64)))
            h.append([int(simhash.mix64(x ^ s)[0]) for s in salts])
        for k in range(4):
            ones = [sum(x[k] >> b & 1 for x in h) for b in range(64)]
            assert int(fp[k]) == sum(1 << b for b in range(64) if 2 * ones[b] > len(h) or (h and 2 * ones[b] == len(h) and h[0][k] >> b & 1))
    assert simhash.wide_fingerprints([], 5).shape == (0, 4)


def edited(rng, w, share):
    return [f"e{rng.integers(1 << 30)}" if rng.random() < share else x for x in w]


def test_similar_texts_are_found(spark, odd, none):
    """Pairs of a five-word similarity of 0.8 to 0.9 are linked, unrelated ones and texts that share a third are not."""
    rng = np.random.default_rng(5)
    rows, near, apart = [], [], []
    for i in range(150):
        w = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(150, 600)))]
        v = edited(rng, w, 0.02)
        u = edited(rng, w, 0.12)
        sets = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (w, v, u)]
        similar = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(v)), (3 * i + 2, " ".join(u))]
        if similar >= 0.8:
            near.append((3 * i, 3 * i + 1))
        if len(sets[0] & sets[2]) / len(sets[0] | sets[2]) < 0.5:
            apart.append((3 * i, 3 * i + 2))
    root = {r.doc_id: r.root for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 50 and len(apart) > 50
    assert sum(root[a] == root[b] for a, b in near) >= 0.95 * len(near)
    assert not any(root[a] == root[b] for a, b in apart)
    assert len({root[3 * i] for i in range(150)}) == 150
    kept = simhash.keep_similar(odd).collect()
    assert Counter(r.doc_id for r in kept) == Counter([1, 2, 3, 6, 7, 8, 9])
    assert simhash.keep_similar(none).count() == 0 and simhash.keep_similar(odd).columns == odd.columns


def test_wide_links_equal_brute_force(spark, monkeypatch):
    """Large keys are cut into tiles, and sampled tables miss no pair of high similarity."""
    monkeypatch.setattr(simhash, "TILE", 40)
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(4):
        f = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
        for _ in range(150):
            g = f.copy()
            for b in rng.choice(256, 12, replace=False).tolist():
                g[b // 64] ^= np.uint64(1 << b % 64)
            rows.append(tuple(g.view(np.int64).tolist()))
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "node long, f0 long, f1 long, f2 long, f3 long")
    from tidemark.llm.components import connected_components

    found = simhash.links(d, 48, simhash.sampled_masks(len(rows), 0.8, 0.99), ("f0", "f1", "f2", "f3"), "node", sparse=False)
    assert all(r.u // 150 == r.v // 150 for r in found.collect())
    roots = {r.v: r.root for r in connected_components(found).collect()}
    assert [roots.get(i, i) for i in range(600)] == [150 * (i // 150) for i in range(600)]


# language identification


def test_language_id(spark, odd, none, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = doc_crc() % 5 == 0
    model = language_id.fit(docs.filter(~out))
    got = language_id.identify(docs, model, out).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == len(odd_rows())
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {"und"}
    assert language_id.identify(none, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, language_id.fit(none)).collect()} == {"und"}


def test_bloom_counts_are_corrected():
    codes = np.arange(5000, dtype=np.uint32)
    table = np.zeros((1, 1 << 15), dtype=np.uint64)
    for i, part in enumerate((codes[:4000], codes[4000:])):
        for cell in language_id.cells_of(part, 15):
            np.bitwise_or.at(table[0], cell, np.uint64(1 << i))
    m = language_id.Model(["x", "y"], 0, table)
    hits = np.bitwise_and.reduce([m.table[0][c] for c in language_id.cells_of(np.arange(10_000, 60_000, dtype=np.uint32), 15)])
    for i in (0, 1):
        assert abs(((hits >> np.uint64(i)) & np.uint64(1)).mean() - m.false[i]) < 0.003


def test_masks_hold_all_languages_of_an_ngram(spark, sf_dir):
    """Shares by the table equal those by sets of all n-grams of each language, frequent in it or not."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang").collect()
    train, test = docs[:150], docs[150:]
    model = language_id.fit(spark.createDataFrame(train, "text string, lang string"))
    sets = {x: set(language_id.grams([r.text for r in train if r.lang == x and r.text])[0].tolist()) for x in model.langs}
    assert set(model.langs) == {r.lang for r in train if r.lang and r.text}
    for r, lang, score in zip(test, *model.predict([r.text for r in test])):
        codes = language_id.grams([r.text or ""])[0].tolist()
        share = {x: sum(c in sets[x] for c in codes) / max(1, len(codes)) for x in model.langs}
        if sum(share.values()):
            assert share[lang] == pytest.approx(max(share.values()), abs=0.01)
            assert score == pytest.approx(share[lang] / sum(share.values()), abs=0.01)


def test_the_table_grows_with_the_corpus(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(lang, " ".join("".join(rng.choice(list(letters), 6)) for _ in range(400))) for lang, letters in (("aa", "abcdefghijk"), ("bb", "ijklmnopqrs")) for _ in range(20)]
    train = spark.createDataFrame(rows, "lang string, text string")
    model = language_id.fit(train, 12)
    assert model.bits > 12 and model.fill.max() <= language_id.MOST_FILL < language_id.filled(train, 12).fill.max()
    monkeypatch.setattr(language_id, "MOST_BITS", 12)
    with pytest.raises(ValueError, match="fills"):
        language_id.fit(train, 12)


def test_letters_decide_und(spark):
    model = language_id.fit(spark.createDataFrame([("some words here", "en")], "text string, lang string"))
    assert model.predict(["\u00bd \u00b2 \u2167", "12 _ !", "\u65e5", "some", None])[0] == ["und", "und", "en", "en", "und"]


# substring dedup


def dedup(rows):
    first, out = {}, []
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 49):
            g = tuple(w[i : i + 50])
            if d is not None and (g not in first or d < first[g]):
                first[g] = d
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if d is not None and first.get(tuple(w[i : i + 50]), d) < d:
                gone[i : i + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


def test_substring_dedup_odd_rows(odd, none):
    assert Counter(tuple(r) for r in substring_dedup.dedup_report(odd).collect()) == dedup([r[:2] for r in odd_rows()])
    assert substring_dedup.dedup_report(none).count() == 0
    out = substring_dedup.dedup_rows(odd)
    assert out.columns == odd.columns and out.count() == len(odd_rows())
    assert {r.text for r in out.filter("doc_id = 10").collect()} == {"tail words that differ here"} or out.filter("doc_id = 10").first().text != BASE


def run_rows(seed: int) -> list[tuple]:
    """Texts with runs of 1 to 20 words over and over, of many lengths and phases, between words of their own and shared passages."""
    r = random.Random(seed)
    shared = [[f"s{k}_{r.randint(0, 40)}" for _ in range(80)] for k in range(3)]
    cycles = [[f"c{k}_{j if j % 3 else 0}" for j in range(k)] for k in (1, 2, 2, 3, 5, 7, 12, 16, 17, 20)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(r.randint(1, 4)):
            c, n, a = r.choice(cycles), r.choice((20, 48, 49, 50, 51, 52, 64, 90, 150)), r.randint(0, 19)
            words += [c[(a + j) % len(c)] for j in range(n)]
            words += r.choice(([], [f"own{d}_{j}" for j in range(r.randint(1, 60))], shared[r.randint(0, 2)][r.randint(0, 20) :]))
        rows.append((d, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_runs_of_few_words(spark, seed):
    rows = run_rows(seed)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in substring_dedup.dedup_report(d).collect()) == dedup(rows)


def test_rows_of_a_run_do_not_grow_with_it(spark):
    count = {}
    for n in (500, 4000):
        rows = [(d, " ".join([f"own{d}_{j}" for j in range(60)] + ["a", "b"] * (n // 2) + [f"end{d}_{j}" for j in range(60)])) for d in range(20)]
        found = substring_dedup.occurrences(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "0L as rid", "text"))
        count[n] = found.count()
    assert count[500] == count[4000] < 20 * 60


def test_substring_dedup_branching_passages(spark):
    """Passages cut, joined and edited at random, with few words, so that k-mers repeat and branch."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 400, 700)]
    loops = ["x", "y"] * 60 + ["z"] * 120
    rows = []
    for d in range(60):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            source = loops if rng.random() < 0.15 else base
            a = int(rng.integers(0, len(source) - 60))
            part = source[a : a + int(rng.integers(40, 200))]
            if rng.random() < 0.5:
                part = [*part]
                part[int(rng.integers(len(part)))] = f"edit{d}"
            parts += part
        rows.append((int(rng.permutation(60)[0]) if d % 10 == 0 else d, " ".join(parts)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in substring_dedup.dedup_report(d).collect()) == dedup(rows)


def corpus_of_passages(seed, n=60):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 90, 900)]
    rows = []
    for d in range(n):
        parts = [f"own{d}x{k}" for k in range(int(rng.integers(0, 30)))]
        for _ in range(int(rng.integers(1, 4))):
            a = int(rng.integers(0, 600))
            part = base[a : a + int(rng.integers(30, 300))]
            if rng.random() < 0.3:
                part[int(rng.integers(len(part)))] = f"edit{d}"
            parts += part + [f"gap{d}x{k}" for k in range(int(rng.integers(0, 40)))]
        rows.append((d, " ".join(parts)))
    return rows + [(n + 1, rows[3][1]), (n + 2, rows[3][1]), (n + 3, rows[7][1] + " tail"), (n + 4, "lead " + rows[7][1])]


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_substring_dedup_equals_brute_force(spark, seed):
    rows = corpus_of_passages(seed)
    got = substring_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in got) == dedup(rows)


def test_paths_carry_the_result(spark, monkeypatch):
    """Without paths, or with another source of the paths, the result is another."""
    rows = corpus_of_passages(11)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    whole = substring_dedup.compact
    for broken in (lambda r: whole(r).limit(0), lambda r: whole(r).withColumn("source", F.lit(-1).cast("long"))):
        monkeypatch.setattr(substring_dedup, "compact", broken)
        try:
            assert Counter(tuple(r) for r in substring_dedup.dedup_report(d).collect()) != dedup(rows)
        finally:
            monkeypatch.setattr(substring_dedup, "compact", whole)


def test_copies_are_one_path_each(spark):
    """A group of whole copies costs one row a copy, and none of its windows is compared."""
    text = " ".join(f"w{i * i % 1009}" for i in range(700))
    d = spark.createDataFrame([(i, 0, text) for i in range(50)], "doc_id long, rid long, text string")
    occ = substring_dedup.occurrences(d)
    nodes = occ.groupBy("node").agg(F.min("doc_id").alias("least"), F.expr("min(around) = max(around)").alias("plain"))
    repeated = occ.join(nodes, "node")
    paths = substring_dedup.compact(repeated)
    assert paths.count() == 1 and paths.first().after + paths.first().before == 700
    pieces = substring_dedup.path_pieces(repeated, paths)
    assert pieces.count() == 50 and occ.count() > 50 * 20
    assert pieces.select(F.inline("ranges")).filter("first <= last").count() == 0


def test_kept_text_keeps_white_space():
    text = b"Head line\n\nsecond  line\tof it\n end "
    assert substring_dedup.kept_text(text, [{"s": 2, "t": 4}]) == b"Head line\n\nof it\n end "
    assert substring_dedup.kept_text(text, [{"s": 0, "t": 1}, {"s": 5, "t": 7}]) == b"line\n\nsecond  line\tof "
    assert substring_dedup.kept_text(b" a b ", [{"s": 0, "t": 2}]) == b" "


# sharding


def test_byte_shards(odd, none):
    got = sharding.byte_shards(odd, n_shards=4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in odd_rows())
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.byte_shards(none, n_shards=4).count() == 0


def test_byte_shards_equal_brute_force(odd):
    for n in (1, 3, 16):
        got = Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.byte_shards(odd, n_shards=n).collect())
        rows = sorted(((d is not None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t, *_ in odd_rows()))
        total, end, slots, want = sum(r[3] for r in rows), 0, Counter(), Counter()
        for known, d, crc, size in rows:
            end += size
            shard = min(n - 1, (2 * end - size) * n // (2 * total))
            want[d if known else None, size, crc, shard, slots[shard]] += 1
            slots[shard] += 1
        assert got == want


def test_byte_shards_are_contiguous_and_even(spark):
    rows = [(i // 3, "x" * (i * 37 % 200)) for i in range(3000)]
    got = sharding.byte_shards(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=8).collect()
    got.sort(key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 200


# quality classifier


def test_quality_fm(spark, odd, none, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    out = doc_crc() % 4 == 2
    machine = quality_fm.fit(quality_fm.labelled_sample(docs, labels, ~out))
    got = quality_fm.score(docs, machine, out).filter("held_out").join(labels, "doc_id").collect()
    hit = [(r.score >= 0.7) == bool(r.quality) for r in got]
    assert np.mean(hit) > 0.9
    rows = quality_fm.score(odd, machine).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert quality_fm.score(none, machine).count() == 0
    assert quality_fm.filter_rows(odd, machine).columns == odd.columns
    blank = quality_fm.fit(quality_fm.labelled_sample(docs, labels.limit(0), ~out))
    assert {round(r.score, 6) for r in quality_fm.score(odd, blank).collect()} == {0.5}


def test_sum_of_squares_identity():
    f = quality_fm.featurize(["a b c a", "", None, "x y"], {})
    m = quality_fm.Machine(0.1, np.zeros(quality_fm.SIZE, np.float32), np.random.default_rng(0).normal(0, 0.1, (quality_fm.SIZE, 4)).astype(np.float32))
    for r, z in enumerate(m.margin(f)):
        i = range(f.indptr[r], f.indptr[r + 1])
        pairs = sum(float(m.v[f.index[a]] @ m.v[f.index[b]]) * float(f.value[a] * f.value[b]) for a in i for b in i if a < b)
        assert abs(z - 0.1 - pairs) < 1e-4


# decontamination


def test_edited_items_are_found(spark, odd, none):
    rng = np.random.default_rng(3)
    items = [(i, " ".join(f"t{rng.integers(0, 900)}" for _ in range(int(rng.integers(8, 60))))) for i in range(60)]
    rows, want = [], set()
    for d in range(400):
        item = items[int(rng.integers(60))]
        w = item[1].split()
        for _ in range(int(rng.integers(0, int(0.2 * len(w)) + 1))):
            k, p = rng.integers(3), int(rng.integers(len(w)))
            if k == 0:
                w[p] = f"new{d}"
            elif k == 1:
                w.insert(p, f"new{d}")
            elif len(w) > 5:
                del w[p]
        if d % 4:
            rows.append((d, " ".join([f"f{rng.integers(0, 5000)}" for _ in range(80)] + w + ["End."])))
            want.add((d, item[0]))
        else:
            rows.append((d, " ".join(f"t{rng.integers(0, 900)}" for _ in range(150))))
    bench = spark.createDataFrame([*items, (99, None), (100, ""), (101, "  ")], "item_id long, text string")
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert pairs <= want
    assert len(pairs) >= 0.97 * len(want)
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(odd, bench).count() == 0
    assert decontamination.contaminated(odd, bench.limit(0)).count() == 0
    assert decontamination.decontaminate(odd, bench).count() == len(odd_rows())


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_recall_at_each_share_of_edits(share, monkeypatch):
    """Against every window, item by item; and without the walks' keys nothing is a candidate."""
    rng = np.random.default_rng(int(100 * share))
    items = [(i, " ".join(f"t{rng.integers(0, 400)}" for _ in range(int(rng.integers(6, 50))))) for i in range(50)]
    matcher = decontamination.Matcher(items, 0.8, 0.99)
    texts, want = [], []
    for k in range(300):
        item = items[k % 50]
        w = item[1].split()
        for _ in range(int(share * len(w))):
            p = int(rng.integers(len(w)))
            w[p : p + int(rng.integers(2))] = [f"t{rng.integers(0, 400)}"] if rng.random() < 0.7 or len(w) < 3 else []
        texts.append(" ".join([f"t{rng.integers(0, 400)}" for _ in range(60)] + w + [f"f{rng.integers(0, 900)}" for _ in range(60)]))
        s = decontamination._symbols(texts[-1].split())
        want.append({i for (i, t), (_, x, e) in zip(items, matcher.items) if decontamination.best_region(x, s)[0] <= e})
    got = [{r[0] for r in found} for found in matcher.scan_all(texts)]
    assert all(g <= w for g, w in zip(got, want))
    assert sum(map(len, got)) >= (1 if share == 0 else 0.97) * sum(map(len, want)) > 250 * (share < 0.2)
    assert got == [{r[0] for r in matcher.scan(t)} for t in texts]
    ids = np.array([matcher.vocabulary.get(x, -1) for x in " ".join(texts).split()])
    n = len(matcher.candidates(ids))
    matcher.need = np.maximum(1, matcher.need // 4)
    assert len(matcher.candidates(ids)) > n  # fewer shared keys asked for, more windows
    matcher.marks[:] = False
    assert not matcher.candidates(ids)


def test_walks_meet_again_after_an_edit():
    walks = decontamination.Walks(8, 100)
    a = np.arange(40)
    b = np.concatenate([a[:20], [77], a[20:]])
    at, keys = walks.keys(a, np.arange(40))
    at2, keys2 = walks.keys(b, np.arange(41))
    assert len(set(keys.tolist()) & set(keys2.tolist())) > 0.8 * len(set(keys.tolist()))
    straight = walks.keys(a, np.arange(40), range(8, 9))
    assert straight[0].tolist() == list(range(39))


def test_short_items_are_exact():
    matcher = decontamination.Matcher([(1, "one two"), (2, "one"), (3, "a b c d"), (4, "one")], 0.8, 0.99)
    got = matcher.scan_all(["zero one two", "a b c", "x a b c d", None, "two one", "one one two"])
    assert [[(r[0], r[1]) for r in found] for found in got] == [[(1, 1), (2, 1), (4, 1)], [], [(3, 1)], [], [(2, 1), (4, 1)], [(1, 1), (2, 0), (4, 0)]]


def test_best_region_is_exact():
    rng = np.random.default_rng(4)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    for _ in range(40):
        a, b = rng.integers(0, 4, 6).astype(np.uint64), rng.integers(0, 4, 12).astype(np.uint64)
        d, s, e = decontamination.best_region(a, b)
        assert d == min(distance(a.tolist(), b[i:j].tolist()) for i in range(13) for j in range(i, 13))
        assert d == distance(a.tolist(), b[s:e].tolist())


def test_decontaminate_decides_by_row(spark):
    """A contaminated row goes though its doc_id is null, and a clean one stays though it shares the doc_id of a contaminated one."""
    item = " ".join(f"q{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"before {item} after", "a"), (None, "all clean here", "b"), (7, f"x {item} y", "c"), (7, "clean as well", "d"), (8, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = decontamination.decontaminate(docs, bench)
    assert got.columns == docs.columns and sorted(r.lang for r in got.collect()) == ["b", "d", "e"]
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == len(rows)


# language model


class PlainModel:
    """The automaton as dictionaries: counts, arcs and failure arcs, walked token by token."""

    def __init__(self, texts):
        self.c, self.arcs = Counter(), {}
        for t in texts:
            w = tokens_of(t)
            self.c.update(tuple(w[max(0, i - k) : i + 1]) for i in range(len(w)) for k in (0, 1, 2) if i >= k)
        self.n = sum(c for g, c in self.c.items() if len(g) == 1)
        self.v = sum(len(g) == 1 for g in self.c)
        for g in self.c:
            if len(g) > 1 and self.c[g[:-1]] >= 2:
                self.arcs.setdefault(g[:-1], set()).add(g[-1])

    def unigram(self, w):
        return (self.c[(w,)] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def arc(self, state, w):
        return (self.c[(*state, w)] - 0.75) / self.c[state]

    def fail(self, state):
        out = self.arcs[state]
        return 0.75 * len(out) / self.c[state] / (1 - sum(self.p(state[1:], w) for w in out))

    def p(self, state, w, failures=True):
        if not state:
            return self.unigram(w)
        if w in self.arcs.get(state, ()):
            return self.arc(state, w)
        return (self.fail(state) if failures and state in self.arcs else 1.0) * self.p(state[1:], w, failures)

    def row(self, t, failures=True):
        w, state, log = tokens_of(t), (), 0.0
        for x in w:
            log += math.log10(self.p(state, x, failures))
            state = next(s for s in ((*state, x)[-2:], (x,), ()) if not s or self.c[s] >= 2)
        return len(w), sum(self.c[(x,)] > 0 for x in w), self.n, sum(math.log10(self.unigram(x)) for x in w), log


def tokens_of(t):
    return [*words("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")), None]


def check_model(docs, held):
    rows = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("h")).collect()
    plain = PlainModel([r.text for r in rows if not r.h])
    key = lambda r: (str(r[0]), r[1], *r[2:5], round(r[5], 6), round(r[6], 6))
    want = sorted(((r.doc_id, r.h, *plain.row(r.text)) for r in rows), key=key)
    got = sorted(map(tuple, language_model.score(docs, held).collect()), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [x for g in got for x in g[5:]] == pytest.approx([x for w in want for x in w[5:]])
    return plain


def test_language_model(spark, odd, none, monkeypatch):
    rows = [(i, " ".join(f"W{(i * k + k // 3) % 29}" for k in range(1, 60)) + f" x{i // 2} y{i // 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    check_model(docs, F.col("doc_id") % 5 == 0)
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 500)
    check_model(docs, F.col("doc_id") % 5 == 0)
    check_model(odd, F.lit(True))
    check_model(odd, F.col("score") == 8)
    assert language_model.score(none, F.lit(False)).count() == 0


def test_states_sum_to_one(spark):
    rows = [(i, " ".join(f"w{(i * k + k // 3) % 9}" for k in range(1, 40))) for i in range(30)]
    plain = check_model(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False))
    vocabulary = [g[0] for g in plain.c if len(g) == 1]
    unknown = ("never seen",)
    for context in [(), *((x,) for x in vocabulary if x), *((x, y) for x in vocabulary for y in vocabulary if x and y)]:
        assert sum(plain.p(context, w) for w in (*vocabulary, *unknown)) == pytest.approx(1)


def test_failure_arcs_are_paid(spark):
    rows = [(i, " ".join(f"w{(i * k + k // 3) % 61}" for k in range(1, 40))) for i in range(40)]
    plain = check_model(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 4 == 0)
    assert sum(plain.row(t)[4] != pytest.approx(plain.row(t, failures=False)[4]) for _, t in rows[::4]) > 5


def test_keys_are_ordered_exactly():
    """Also where keys differ only in bits that don't fit beside the place."""
    rng = np.random.default_rng(1)
    for bits in (60, 64):
        keys = rng.integers(0, 1 << 62, 5000, dtype=np.uint64) >> np.uint64(62 - bits + 2 if bits < 62 else 0)
        keys[1::2] = keys[::2] ^ np.uint64(1)
        keys[7::50] = keys[6]
        assert language_model.ordered(keys, bits).tolist() == np.argsort(keys, kind="stable").tolist()
        u, first, number = language_model.numbered(keys, bits)
        assert u.tolist() == sorted(set(keys.tolist())) and (keys[first] == u).all() and (u[number] == keys).all()
    assert language_model.numbered(np.empty(0, np.uint64))[0].size == 0


def test_the_state_is_carried_left_to_right():
    """A broken arc table or failure weight changes the score of the texts that pass it, and no other."""
    texts = [b"a b c a b d", b"a b c a b d", b"a d x"]
    block = language_model.Block.of(texts, np.array([False, False, True]))
    ask = lambda rows: language_model._table(language_model._ASKED, rows)
    replies = []

    def told(rows):
        for kind in {r[0] for r in rows}:
            t = ask([r for r in rows if r[0] == kind])
            run = {}

            class One:  # the grouped request, answered in place
                def groupBy(self, *_):
                    return self

                def applyInArrow(self, f, _):
                    run["out"] = f(t)

            language_model.answered(One())
            replies.extend(run["out"].to_pylist())

    told([r for k in (1, 2) for g in [language_model.Grams(block, k)] for r in language_model._ask(k, 0, g.keys, g.own(), None, 1)])
    distinct, total = next((r["distinct"], r["total"]) for r in replies if r["kind"] == 1)
    local = language_model.Local(block, replies, total, distinct)
    g = language_model.Grams(block, 3, local.after_state())
    told([*language_model._ask(3, 0, g.keys, g.own(), None, 1), *local.sums(0, 1, 1)])
    told(language_model.Local(block, replies, total, distinct).sums(0, 2, 1))
    local = language_model.Local(block, replies, total, distinct)
    whole = language_model.traverse(local)
    plain = PlainModel([t.decode() for t in texts[:2]])
    assert whole == pytest.approx([plain.row(t.decode())[4] for t in texts])
    local.fail = lambda order: np.zeros(len(local.state[order]))
    broken = language_model.traverse(local)
    assert whole[0] == pytest.approx(broken[0]) and whole[2] != pytest.approx(broken[2])


def test_model_grows_with_the_corpus(spark):
    """An n-gram counts however large the corpus is, and a text that occurs twice scores above one that occurs once."""
    docs = spark.createDataFrame([(0, "filler " * 1_500_000), (1, "rare pair of words"), (2, "rare pair of words"), (3, "other four single words")], "doc_id long, text string")
    got = {r.doc_id: r.score - r.base_score for r in language_model.score(docs, F.lit(False)).collect()}
    assert got[1] == pytest.approx(got[2]) and got[1] > got[3] > 0


def test_words_are_hashed_whole():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.choice(list(b"aB \n\xc3\xa9z"), size=int(n))) for n in rng.integers(0, 60, 200)] + [b"", b"x" * 9000, b"x" * 9001, b" ", b"x" * 8, b"x" * 16]
    for lower in (False, True):
        got = Words(texts, lower)
        flat = [w for t in texts for w in (t.lower() if lower else t).split()]
        assert got.count.tolist() == [len(t.split()) for t in texts]
        assert [got.data[a:b].tobytes() for a, b in zip(got.start, got.stop)] == flat
        by = {}
        for w, h in zip(flat, got.hash.tolist()):
            assert by.setdefault(w, h) == h
        assert len(set(by.values())) == len(by)


# packing


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(spark, odd, none):
    pieces = packing.pieces(odd, tokens.default_path(), capacity=256)
    rows = packing.pack(pieces, capacity=256).collect()
    tok = tokens.tokenizer(tokens.default_path())
    want = Counter()
    for d, t, *_ in odd_rows():
        ids = [*tok.encode(t or "").tolist(), 1]
        for k, a in enumerate(range(0, len(ids), 256)):
            want[d, k, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    n = check_packing(rows, 256)
    assert n <= math.ceil(sum(r.length for r in rows) / 256) + 1
    assert packing.pack(packing.pieces(none, tokens.default_path())).count() == 0


def test_packing_in_several_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(i, 0, 0, int(x), 0) for i, x in enumerate(rng.integers(1, 100, 3000))]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES), capacity=100, group_pieces=400).collect()
    assert len(got) == 3000
    alone = packing.sum_of_squares(np.sort([r[3] for r in rows])[::-1], 100)[0].max() + 1
    assert check_packing(got, 100) <= alone * 1.02


def test_sum_of_squares_choice():
    """Each placement is the best by the definition, worked out from scratch."""
    rng = np.random.default_rng(7)
    lengths = rng.integers(1, 21, 200)
    bins, offsets = packing.sum_of_squares(lengths, 20)
    fill = Counter()

    def squares(f):
        return sum(n * n for n in Counter(20 - x for x in f.values() if x < 20).values())

    for a, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        assert fill[b] == o
        options = []
        for k in [*fill, "new"]:
            if fill.get(k, 0) + a <= 20:
                options.append(squares(fill | Counter({k: fill.get(k, 0) + a})) if k != "new" else squares(Counter(fill) + Counter({k: a})))
        fill[b] += a
        assert squares(fill) == min(options)
