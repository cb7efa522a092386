"""Hard negatives, the Merkle manifest and language-model scores against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.llm import lm_trie, merkle, negatives, queries

# ---------------------------------------------------------------- hard negatives


def brute_negatives(rows):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] and None not in r[2]]
    out = []
    for a in {(i, label, tuple(v)) for i, label, v in rows if i % 5 == 0}:
        scored = [(i, label, sum(x * y for x, y in zip(a[2], v, strict=True))) for i, label, v in rows if i != a[0] and len(v) == len(a[2])]
        scored.sort(key=lambda r: (-r[2], r[0]))
        for p, _, ps in [r for r in scored if r[1] == a[1]][:5]:
            fit = [r for r in scored if r[1] != a[1] and 80 * ps <= 100 * r[2] <= 100 * ps][:5]
            out += [(a[0], p, k + 1, n, ps, ns) for k, (n, _, ns) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<bigint>").withColumns({"rank": F.lit("x"), "block": F.lit(1), "summary": F.lit(2)})
    return sorted(tuple(r) for r in negatives.hard_negatives(df, "vec_id % 5 = 0").collect())


def test_hard_negatives_with_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(3)), rng.integers(-3, 9, 7).tolist()) for i in range(150)]
    rows += [(200 + i, i % 2, rows[0][2]) for i in range(80)] + [rows[5], rows[5], (10, 1, rows[11][2])]
    rows += [(300, 1, None), (301, None, rows[1][2]), (None, 1, rows[1][2]), (302, 1, [1, None, 3, 4, 5, 6, 7]), (305, 1, []), (310, 1, [5, 5]), (311, 1, [4, 5]), (312, 0, [4, 5])]
    assert mined(spark, rows) == brute_negatives(rows)


def test_hard_negatives_of_an_empty_table(spark):
    assert mined(spark, []) == []


def test_big_components_stay_exact(spark):
    rows = [(i, i % 2, [2**29 + i, 3 - i, 2**27 * (i % 7)]) for i in range(40)]
    assert mined(spark, rows) == brute_negatives(rows)


@pytest.mark.parametrize("dim", [1, 3, 16, 64, 70])
def test_bounds_hold_and_levels_tighten(dim):
    rng = np.random.default_rng(dim)
    a, b = (rng.integers(-300, 300, (40, dim)) for _ in range(2))
    sa, sb = (negatives.summaries(x.astype(float)).astype(float) for x in (a, b))
    exact = a @ b.T
    widths = []
    for level in range(len(negatives.SEGMENTS)):
        low, high = negatives.level_bounds(sa, sb, dim, level)
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).mean())
    assert widths[1] <= widths[0] + 1


def test_searcher_skips_pairs_and_equals_a_sort(monkeypatch):
    monkeypatch.setattr(negatives, "TILE_ROWS", 64)
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (8, 64))
    v = centres[np.arange(1000) % 8] + rng.integers(-20, 20, (1000, 64))
    ids, labels = np.arange(1000), np.arange(1000) % 8
    summary = negatives.summaries(v.astype(float))
    s = negatives.Searcher(ids, labels, v, summary)
    low, high = np.full((20, 1), -negatives.WIDEST), np.full((20, 1), negatives.WIDEST)
    at, _, got, score = s.search(ids[:20], labels[:20], v[:20], summary[:20], low, high, True, 5)
    for i in range(20):
        want = sorted(((-int(v[i] @ v[j]), j) for j in ids if j != i and labels[j] == labels[i]))[:5]
        assert list(zip((-score[at == i]).tolist(), got[at == i].tolist(), strict=True)) == want
    assert s.scored < s.seen / 8
    s.scored = 0
    top = np.array([[int(v[i] @ v[i])] for i in range(20)])
    s.search(ids[:20], labels[:20], v[:20], summary[:20], top * 8 // 10, top, False, 5)
    assert s.scored < s.seen / 8


# ---------------------------------------------------------------- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute_way(levels, i):
    for below in levels[:-1]:
        a = i - i % 16
        yield below[a:i], below[i + 1 : a + 16]
        i //= 16


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    trees = {s: sorted(v, key=lambda x: x[:3]) for s, v in by.items()}
    levels = {s: brute_levels([x[2] for x in v]) for s, v in trees.items()}
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = brute_levels([levels[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(trees[s]):
            way = [*brute_way(levels[s], i), *brute_way(top, k)]
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node = leaf_of((*row[:4], row[4].translate({c: c + 32 for c in range(65, 91)}) if row[4] is not None else None)) if changed else leaf
            for left, right in way:
                node = h(*left, node, *right)
            out.append((row[0], leaf, levels[s][-1][0], top[-1][0], h(*["".join(a + b) for a, b in way]), node, node == top[-1][0]))
    return sorted(out, key=str)


def manifested(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"tree": F.lit(1), "place": F.lit(2), "height": F.lit(3)})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def test_manifest_of_odd_rows(spark, tmp_path):
    rows = [(i, f"s{i % 3}" if i % 4 else None, "en", 3, f"Text {i} Ä") for i in range(400)]
    rows += [(7, "s1", None, None, None), (7, "s1", "en", 3, "other"), (7, "s1", "en", 3, "other"), (None, "s1", "en", 1, "A"), (None, None, None, None, None), (2**53 + 1, "", "en", 0, ""), (5, "lone", "x", 1, "B" * 100_000), (6, "ä", "x", 1, "C")]
    rows += [(1000 + i, f"src{i}", "x", 1, "D") for i in range(40)]
    assert manifested(spark, rows, tmp_path) == brute_manifest(rows)


def test_manifest_over_several_rounds(spark, tmp_path):
    rows = [(i, "big" if i % 40 else "small", "en", 1, f"T{i}") for i in range(70_000)]
    assert manifested(spark, rows, tmp_path) == brute_manifest(rows)


@pytest.mark.parametrize("n", [0, 1])
def test_small_manifests(spark, tmp_path, n):
    rows = [(5, "s", "en", 1, "A")][:n]
    assert manifested(spark, rows, tmp_path) == brute_manifest(rows)


# ---------------------------------------------------------------- language model


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [*filter(None, low.split(" ")), None]


def brute_scores(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    n1, n2, n3 = Counter(), Counter(), Counter()
    for (i, text), out in zip(rows, held, strict=True):
        if i is not None and not out:
            w = words(text)
            n1.update(w)
            n2.update(zip(w, w[1:], strict=False))
            n3.update(zip(w, w[1:], w[2:], strict=False))
    total, k2, k3 = sum(n1.values()), lm_trie.K2, lm_trie.K3
    made = []
    for (i, text), out in zip(rows, held, strict=True):
        w, base, score = words(text), 0.0, 0.0
        for j, x in enumerate(w):
            p = (n1[x] + 0.1) / (total + 0.1 * (len(n1) + 1))
            base += math.log10(p)
            if j:
                p = (n2[(w[j - 1], x)] + k2 * p) / (n1[w[j - 1]] + k2)
            if j > 1:
                p = (n3[(w[j - 2], w[j - 1], x)] + k3 * p) / (n2[(w[j - 2], w[j - 1])] + k3)
            score += math.log10(p)
        made.append((i, out, len(w), sum(n1[x] > 0 for x in w), total, base, score))
    return made


def scored(spark, rows, tmp_path, parts=5):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit(1), "shard": F.lit(2), "score": F.lit(3)})
    df.repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    return [tuple(r) for r in queries.op13_lm_scores(spark, str(tmp_path)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]


def same_scores(got, want):
    def key(r):
        return str(r[:5]), round(r[5], 6), round(r[6], 2)

    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-9)
    # Both counts of a quotient are quantised to 0.03 %.
    assert all(abs(a[6] - b[6]) <= 3e-4 * a[2] for a, b in zip(got, want, strict=True))


def test_scores_equal_counting(spark, tmp_path):
    rng = np.random.default_rng(5)
    names = np.array(["alpha", "Beta", "beta", "ÄX", "äx", "of", "the", "x", "y", "-"])
    rows = [(i, " ".join(names[rng.integers(0, 10, rng.integers(0, 40))])) for i in range(300)]
    rows += [(i, "of the  Same\tline\n" * 30) for i in range(300, 360)] + [(7, "again of the"), (7, "again of the"), (None, "never learned words"), (None, None), (400, None), (401, ""), (402, " \n"), (2**53 + 1, "x y of")]
    rows += [(403, "of the x " * 20_000), (404, "one")]
    same_scores(scored(spark, rows, tmp_path), brute_scores(rows))


def test_no_rows_and_no_training_rows(spark, tmp_path):
    assert scored(spark, [], tmp_path / "a") == []
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    rows = [(i, "some words") for i in held]
    same_scores(scored(spark, rows, tmp_path / "b"), brute_scores(rows))


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    got = queries.op13_lm_scores(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > 0.9 * got[0] and got[1] > got[0]


@pytest.mark.parametrize("n,top", [(1, 1), (5, 5), (1000, 1200), (3000, 10**12), (70_000, 90_000)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n).astype(np.uint64))
    ef = lm_trie.EliasFano(values, top)
    assert (ef.access(np.arange(n)) == values).all()
    x = rng.integers(0, top, 2000).astype(np.uint64)
    assert (ef.successor(x) == np.searchsorted(values, x)).all()


@pytest.mark.parametrize("order", [2, 3])
def test_trie_finds_exactly_its_n_grams(order):
    rng = np.random.default_rng(order)
    grams = {tuple(g) for g in np.minimum(rng.zipf(1.5, (20_000, order)), 5000).tolist()}
    held = sorted(g for g in grams if hash(g) % 3)
    columns = [np.array(c, np.uint64) for c in zip(*held, strict=True)]
    trie = lm_trie.Trie(columns, np.arange(len(held)) % 60_000 + 1)
    code = {g: i % 60_000 + 1 for i, g in enumerate(held)}
    asked = sorted(grams | {(0,) * order, (5001,) * order})
    got = trie.find([np.array(c, np.uint64) for c in zip(*asked, strict=True)])
    assert [code.get(g, 0) for g in asked] == got.tolist()
    assert trie.nbytes < 8 * order * len(held)


def test_merged_counts_and_wide_ids():
    a = [np.array([2**40, 1, 2**40, 3], np.uint64), np.array([2**41, 5, 2**41, 2**41], np.uint64), np.array([7, 2**42, 7, 9], np.uint64)]
    columns, total = lm_trie.merged(a, np.array([1, 0, 4, 2]))
    assert [c.tolist() for c in columns] == [[3, 2**40], [2**41, 2**41], [9, 7]] and total.tolist() == [2, 5]


def test_packed_numbers():
    for values in ([], [0], [1, 2**63, 5], list(range(70_000))):
        assert lm_trie.unpack(lm_trie.pack(np.array(values, np.uint64))).tolist() == values


def test_a_value_is_found_by_few_lookups(monkeypatch):
    draw = np.random.default_rng(6)
    for top in (1 << 13, 1 << 20, 1 << 45):
        values = np.unique(draw.integers(0, top, 6000).astype(np.uint64))
        ef, low = lm_trie.EliasFano(values, top), lm_trie.EliasFano._lows
        first, second = ef.access_two(np.arange(len(values) - 1))
        assert (first == values[:-1]).all() and (second == values[1:]).all()
        looked = []
        monkeypatch.setattr(lm_trie.EliasFano, "_lows", lambda self, i, low=low, looked=looked: looked.append(len(i)) or low(self, i))
        assert (ef.place(values) == np.arange(len(values))).all()
        # A group of values with equal high bits holds one to two on average, and a hit ends the search.
        assert sum(looked) < 2 * len(values)
        other = np.setdiff1d(draw.integers(0, top, 6000).astype(np.uint64), values)
        assert (ef.place(other) == -1).all()
        monkeypatch.setattr(lm_trie.EliasFano, "_lows", low)
