"""The corpus operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import collections
import os
import struct
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from orbitframe.llm import ann, components, html_text, packing, quality_crf, quality_rules, secrets, sentencepiece_scan, simhash, substring, toxicity
from orbitframe.llm.common import Words

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, grp long, component_id long, label string"
TEXTS = [None, "", "   \n\t ", "one", "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p", "x a b c d e f g h i j k l m n o p q", "Ünï ✓ \U0001f600 word\x0bword\x1fnot split", "w " * 3000, "long" * 4000]


def odd_docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, i, 1, -5, "z") for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, TEXTS[4], "en", "s", 1, 1, 1, 1, ""), (4, "other text for the same id", "en", "s", 1, 1, 1, 1, "")]
    return spark.createDataFrame(rows, DOCS)


def small_docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# ------------------------------------------------------------------ words


def test_words_split_and_hash():
    texts = [t.encode() for t in TEXTS if t is not None]
    w = Words(texts)
    want = [(i, x) for i, t in enumerate(texts) for x in t.split()]
    assert w.doc.tolist() == [i for i, _ in want]
    assert len(set(w.hash.tolist())) == len({x for _, x in want})
    assert all(texts[d][p : p + len(x)] == x for (d, x), p in zip(want, w.place.tolist(), strict=True))


# ------------------------------------------------------------------ op8


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys, linked):
    up = list(range(len(keys)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


@pytest.mark.parametrize("words,budget", [(1, 3), (4, 40)])
def test_trie_walk(words, budget):
    draw = np.random.default_rng(5)
    for _ in range(12):
        n = int(draw.integers(2, 200))
        centre = draw.integers(0, 2**63, (4, words)).astype(np.uint64)
        bits = centre[draw.integers(0, 4, n)]
        for i in range(n):
            for p in draw.integers(0, 64 * words, draw.integers(0, 6 if words == 1 else 60)):
                bits[i, p // 64] ^= np.uint64(1) << np.uint64(p % 64)
        both = np.unique(np.column_stack([draw.integers(0, 3, n).astype(np.uint64), bits]), axis=0)
        group, bits = both[:, 0].astype(int), both[:, 1:].copy()
        got = simhash.trie_components(bits, group, budget, leaf=4, step=40)
        want = brute_components(group, lambda i, j: group[i] == group[j] and int(np.bitwise_count(bits[i] ^ bits[j]).sum()) <= budget)
        assert len(set(zip(got.tolist(), want, strict=True))) == len(set(want)) == len(set(got.tolist()))


@pytest.mark.parametrize("group_rows", [200_000, 2])
def test_simhash(spark, group_rows, monkeypatch):
    if group_rows == 2:
        real = simhash.hamming_components
        monkeypatch.setattr(simhash, "hamming_components", lambda *a: real(*a, group_rows=2))
    docs = small_docs(spark)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(prints, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    want = {d: (f"{p:016x}", rows[r][0]) for (d, _), p, r in zip(rows, prints, roots, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()} == want


def test_groups_are_split_until_they_fit(spark):
    """Fingerprints of one cluster: the first 40 bits are equal, so most keys of the first rounds separate nothing."""
    draw = np.random.default_rng(17)
    low = np.unique(draw.integers(0, 1 << 24, 500)).tolist()
    low += [x ^ (1 << int(draw.integers(24))) ^ (1 << int(draw.integers(24))) for x in low[:100]]
    prints = sorted({(0x5A5A5A5A5A << 24) | x for x in low})
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    table = spark.createDataFrame(rows, "doc_id long, f0 long")
    keys = simhash.exact_keys(["f0"], 3)
    got = simhash.hamming_components(table, ["f0"], 3, keys, group_rows=60).collect()
    roots = brute_components(prints, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    assert {r.f0: r.component_id for r in got} == {f: root for (_, f), root in zip(rows, roots, strict=True)}
    nodes = table.withColumn("node", F.col("f0"))
    sizes = [r["count"] for r in simhash.split_groups(nodes, ["f0"], keys, 3, 60).groupBy("slot", "key").count().collect()]
    assert max(sizes) <= 60


def test_simhash_odd_rows(spark):
    got = simhash.simhash_components(odd_docs(spark)).collect()
    assert len(got) == len(TEXTS) + 4
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.fingerprint, r.component_id))
    assert by[0] == by[1] == {("0" * 16, 0)} and by[2] == {("0" * 16, 0)}
    assert {c for _, c in by[5]} == {4} and by[None] == by[5]
    assert simhash.simhash_components(odd_docs(spark).limit(0)).count() == 0


def test_near_duplicates_catch_copies_and_leave_others(spark):
    draw = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    base = [" ".join(draw.choice(words, 200)) for _ in range(30)]
    near = []
    for t in base[:10]:
        w = t.split()
        w[17], w[90] = "changed", "too"
        near.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(base + near + base[:3])), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert all(got[30 + i] == i for i in range(10)) and all(got[40 + i] == i for i in range(3)) and all(got[i] == i for i in range(30))


def shingle_sets(rows, k=5):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return sets


def brute_near(rows, similarity=0.8):
    sets = shingle_sets(rows)
    roots = brute_components(rows, lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9)
    low = {}
    for (d, _), r in zip(rows, roots, strict=True):
        low[r] = min(low.get(r, d), d)
    return {d: low[r] for (d, _), r in zip(rows, roots, strict=True)}


def test_near_duplicates_lose_no_link(spark):
    draw = np.random.default_rng(9)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    # Pairs at or just above 0.8, long and short: 100 shingles of which 11 differ on each side, and 9 of which 1 does.
    for i in range(150):
        w = draw.choice(words, 104).tolist()
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(["x", "y"] + w[:-2] if i % 2 else w[:-11] + draw.choice(words, 11).tolist()))]
        w = draw.choice(words, 13).tolist()
        rows += [(1000 + 2 * i, " ".join(w)), (1001 + 2 * i, " ".join(w[:-1] + ["z"]))]
    rows += [(2000, ""), (2001, None), (2002, "One two"), (2003, "one TWO")]
    want = brute_near(rows)
    assert sum(want[1000 + 2 * i] == want[1001 + 2 * i] for i in range(150)) == 150
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_near_duplicates_link_nothing_below_the_similarity(spark):
    draw = np.random.default_rng(10)
    words = [f"w{i}" for i in range(5000)]
    base, hub, rows = draw.choice(words, 150).tolist(), draw.choice(words, 120).tolist(), []
    # A template with own endings (0.5 to 0.8), a chain of small shifts, and copies around one text that differ from each other.
    rows += [(i, " ".join(base[: 104 + i % 24] + draw.choice(words, 46 - i % 24).tolist())) for i in range(60)]
    long = draw.choice(words, 400).tolist()
    rows += [(100 + i, " ".join(long[10 * i : 10 * i + 104])) for i in range(10)]
    rows += [(200 + i, " ".join(hub[: 4 * i] + ["x"] * (i % 3) + hub[4 * i :])) for i in range(25)]
    sets = shingle_sets(rows)
    between = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(0.5 < j < 0.8 for j in between) > 500 and sum(j >= 0.8 for j in between) > 50
    want = brute_near(rows)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_odd_bins_bound_the_difference():
    draw = np.random.default_rng(11)
    ruled_out = 0
    for n, m, both in [(1000, 1000, 862), (1000, 800, 780), (300, 300, 259), (5000, 5000, 4300), (200, 3000, 190), (130, 140, 130)] * 10:
        h = draw.integers(0, 1 << 64, n + m - both, dtype=np.uint64)
        x, y = (simhash.odd_bins(s, 2 << (len(s) - 1).bit_length()).tobytes() for s in (h[:n], h[n - both :]))
        assert simhash.least_difference(x, y) <= n + m - 2 * both
        ruled_out += both == 862 and simhash.least_difference(x, y) > (n + m) / 9
    # Two sets of 1,000 with a similarity of 0.757, which 256 counts of four hashes each couldn't tell from 0.8.
    assert ruled_out == 10


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (None, 3), (200, 201)], "u long, v long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 200: 200, 201: 200}


# ------------------------------------------------------------------ op3


def brute_substring(rows, window):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("group_rows", [1_000_000, 500])
def test_substring(spark, group_rows):
    docs = small_docs(spark)
    got = substring.substring_dedup(docs, group_rows=group_rows)
    rows = sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept").collect())
    assert rows == brute_substring([(r.doc_id, r.text) for r in docs.collect()], 13)


def test_substring_odd_rows(spark):
    docs = odd_docs(spark)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.substring_dedup(docs).collect() if r.doc_id is not None)
    assert got == brute_substring([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], 13)
    lone = substring.substring_dedup(docs).filter("doc_id IS NULL").collect()
    assert [(r.n_words, r.n_removed) for r in lone] == [(16, 0)]
    assert substring.substring_dedup(docs.limit(0)).count() == 0


def test_substring_of_equal_rows(spark):
    """A third of all rows are equal in id and text: one is looked at, each keeps its own further columns."""
    draw = np.random.default_rng(23)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(draw.choice(words, 60)) for _ in range(40)]
    rows = [(i, t, {"n": str(i)}) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i] + " and " + texts[i + 1], {"n": "x"}) for i in range(20)]
    rows += [(50, "before " + texts[3] + " after", {"n": str(k)}) for k in range(30)]
    rows += [(None, texts[5], {"n": "no id"}), (60, None, {"n": "a"}), (60, None, {"n": "b"})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more map<string,string>")
    got = substring.substring_dedup(docs, carry=("more",)).collect()
    have = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got if r.doc_id is not None)
    assert have == brute_substring([(d, t) for d, t, _ in rows if d is not None], 13)
    assert sorted((r.doc_id, r.carry.more["n"]) for r in got if r.doc_id in (50, 60)) == sorted((d, m["n"]) for d, _, m in rows if d in (50, 60))
    assert {r.n_removed for r in got if r.doc_id == 50} == {60} and len(got) == len(rows)


def test_substring_keeps_layout(spark):
    rows = [(1, "a b\nc  d e"), (2, "x\n a b\nc  d e\n\ty z")]
    got = {r.doc_id: r.kept for r in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=4, layout=True).collect()}
    assert got == {1: "a b\nc  d e", 2: "x\n y z"}


# ------------------------------------------------------------------ op10


def brute_secrets(text):
    text = text or ""
    out = [(m.start(), "assign", m.end()) for m in secrets.ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), "access", m.end()) for m in secrets.ACCESS.finditer(text) if len(m.group()) >= 20]
    out += [(m.start(), "hex", m.end()) for m in secrets.HEX.finditer(text) if len(m.group()) >= 24]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[1])))


def test_secrets_against_plain_patterns():
    draw = np.random.default_rng(9)
    parts = ["password", "PassWord", "token", "api_key", "APIKEY", "secret", ":", "=", " ", "  ", '"', "'", "abc", "AKIA", "AKIAABCDEFGH", "0123456789abcdef", "deadbeef", "Z9", "é", "İ", "K", "_", "\n", "secrettoken"]
    for _ in range(5000):
        text = "".join(draw.choice(parts, draw.integers(1, 25)))
        assert secrets.find_secrets(text) == brute_secrets(text)


def test_checked_tokens_need_their_checksum():
    body = "Ab1" * 10
    good = "ghp_" + body + secrets.base62_crc(body)
    assert [s[1] for s in secrets.find_secrets(f"x {good} y")] == ["github"]
    assert secrets.find_secrets(f"x {good[:-1]}0 y") in ([], [(2, "github", 42)] if good[-1] == "0" else [])


def test_redaction(spark):
    rows = [(1, 'a token = "abcdef0123456789abcdef0123" b', "k"), (2, None, "k"), (3, "", None)]
    out = {r.doc_id: r.text for r in secrets.redacted(spark.createDataFrame(rows, "doc_id long, text string, kind string")).collect()}
    assert out == {1: 'a [secret]" b', 2: None, 3: ""}
    assert {r.doc_id: len(r.spans) for r in secrets.secret_spans(odd_docs(spark).limit(3)).collect()} == {0: 0, 1: 0, 2: 0}


# ------------------------------------------------------------------ op6


def test_packing(spark):
    path = packing.tokenizer_path("byte_bpe_50k.json")
    docs = odd_docs(spark)
    rows = packing.packed_documents(docs, path, length=256).collect()
    tokenizer = packing.encoder(path)
    want = collections.Counter()
    texts = collections.defaultdict(list)
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        texts[r.doc_id].append(ids)
        want[r.doc_id] += len(ids)
    got, sequences = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        parts = [ids[r.start : r.start + r.length] for ids in texts[r.doc_id] if len(ids) == r.doc_tokens]
        assert r.ids_crc32 in [zlib.crc32(struct.pack(f"<{len(p)}I", *p)) for p in parts]
        got[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= 256
    assert packing.packed_documents(docs.limit(0), path).count() == 0


def test_first_fit_decreasing_is_first_fit():
    sizes = np.random.default_rng(1).integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    free = []
    for i in np.argsort(-sizes, kind="stable"):
        at = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        if at == len(free):
            free.append(100)
        assert (bins[i], offsets[i]) == (at, 100 - free[at])
        free[at] -= sizes[i]


def test_rank_encoder_gives_the_tokenizers_ids():
    ids = packing.Ids(packing.tokenizer_path("byte_bpe_50k.json"))
    assert ids.ranks is not None
    draw = np.random.default_rng(4)
    for _ in range(200):
        text = "".join(draw.choice(list("ab'st 1 \n\té漢<|>.\x1c\x85\xa0\U0001f600"), 120))
        assert ids.encode(text).tolist() == ids.slow(text).tolist()


# ------------------------------------------------------------------ op7, op4


def test_grammar_scopes():
    lexicon = toxicity.Lexicon({})

    def kinds(text):
        return [round(x, 1) for x in toxicity.clause_matches(text.split(), lexicon)]

    assert kinds("you are an idiot") == [0, 4, 0, 0]
    assert kinds("an idiot") == [4, 0, 0, 0]
    assert kinds("not an idiot") == [0, 0, 4, 0]
    assert kinds("he said idiot") == [0, 0, 0, 4]
    assert kinds("kill the process") == [0, 0, 0, 0]
    assert kinds("i will kill you") == [0, 1, 0, 0]


def brute_kind(classes, i):
    """A hit's kind by the distances to what stands around it."""
    own = classes[i]

    def near(opener, before, after=0):
        return any(classes[j] == opener for j in range(max(0, i - before), min(len(classes), i + after + 1)))

    if own not in "IH" or (own == "H" and not near("T", 4, 4)):
        return "none"
    return "reported" if near("R", 12) else "negated" if near("N", 3) else "target" if near("T", 4, 4) else "plain"


def test_composed_grammar_against_distances():
    draw = np.random.default_rng(7)
    for _ in range(2000):
        classes = draw.choice(list(toxicity.CLASSES), draw.integers(0, 30), p=[0.6, 0.12, 0.08, 0.08, 0.06, 0.06]).tolist()
        got = toxicity.hit_kinds([toxicity.CLASSES.index(c) for c in classes])
        assert [toxicity.KINDS[k] for k in got] == [brute_kind(classes, i) for i in range(len(classes))]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for scores, label, cut, least in ((toxicity.toxicity(docs, labels), "toxic", 0.5, 0.93), (quality_crf.quality(docs, labels), "quality", 0.3, 0.97)):
        joined = scores.join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
        right = joined.agg(F.avg(((F.col("score") >= cut).cast("int") == F.col(label)).cast("int"))).first()[0]
        assert right >= least
        assert scores.count() == docs.count() and scores.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_classifiers_on_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(10)] + [(None, 1, 1), (3, None, None), (4, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    for run in (toxicity.toxicity, quality_crf.quality):
        assert run(docs, labels).count() == docs.count()
        assert run(docs, labels.limit(0)).filter("score IS NULL").count() == 0
        assert run(docs.limit(0), labels).count() == 0


def test_forward_backward_against_enumeration():
    draw = np.random.default_rng(0)
    unary, pair = draw.normal(size=7), draw.normal(size=(2, 2))
    doc = np.array([0, 0, 0, 1, 2, 2, 2])
    good, joint = quality_crf.marginals(unary, doc, pair)
    want, counts = np.zeros(7), np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        total, mass, pairs = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for code in range(2 ** len(at)):
            y = [code >> i & 1 for i in range(len(at))]
            p = np.exp(sum(unary[a] for a, v in zip(at, y, strict=True) if v) + sum(pair[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += p
            mass += p * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                pairs[a, b] += p
        want[at] = mass / total
        counts += pairs / total
    assert np.allclose(good, want) and np.allclose(joint, counts)


# ------------------------------------------------------------------ op2


def brute_counts(text):
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    text = text or ""
    w, lines = word.findall(text), [x for x in text.split("\n") if word.search(x)]
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_rule_counts(spark):
    for docs in (small_docs(spark), odd_docs(spark)):
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        got = sorted((tuple(r) for r in quality_rules.rule_counts(docs, ["doc_id"]).select("doc_id", *names).collect()), key=str)
        assert got == sorted(((r.doc_id, *brute_counts(r.text)) for r in docs.collect()), key=str)


def test_rules_are_native_and_total(spark):
    docs = odd_docs(spark)
    out = quality_rules.quality_rules(docs)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == docs.count() and out.filter("kept IS NULL OR (base_failed AND kept)").count() == 0
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ op5


def copied_vectors(distinct, copies, dim=64):
    """Structureless vectors; a group of copies holds a share of the rows, among other ids."""
    x = np.random.default_rng(12).standard_normal((distinct, dim)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.concatenate([x, np.repeat(x[:1], copies, axis=0)])
    ids = np.random.default_rng(13).permutation(len(x))
    return ids, x


def vector_rows(spark, ids, x):
    path = f"{tempfile.mkdtemp()}/v.parquet"
    pq.write_table(pa.table({"vec_id": ids.astype("int64"), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), path)
    return spark.read.parquet(path)


def recall_of(spark, ids, x, places, **how):
    """Recall against brute force for the queries at ``places``; scores and places must be right for all that is found."""
    rows = vector_rows(spark, ids, x)
    asked = rows.filter(F.col("vec_id").isin(ids[places].tolist()))
    got = collections.defaultdict(dict)
    for r in ann.nearest(rows, asked, **how).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    wide, place = x.astype(float), {int(v): i for i, v in enumerate(ids)}
    hits = 0
    for p in places:
        s = wide @ wide[p]
        best = [v for v in ids[np.lexsort([ids, -np.round(s, 9)])].tolist() if v != ids[p]][:20]
        found = got[int(ids[p])]
        assert sorted(found) == list(range(1, 21)) and int(ids[p]) not in {v for v, _ in found.values()}
        assert all(abs(score - s[place[v]]) < 1e-6 for v, score in found.values())
        hits += len(set(best) & {v for v, _ in found.values()})
    return hits / (20 * len(places))


@pytest.mark.parametrize("distinct", [500, 2000, 10_000])
def test_forest_recall(spark, distinct):
    """The query's own settings on structureless vectors."""
    ids, x = copied_vectors(distinct, 0)
    got = recall_of(spark, ids, x, np.arange(0, distinct, distinct // 100))
    print("recall over", distinct, got)
    assert got >= 0.9


def test_forest_of_many_parts(spark):
    """Leading bits, crowded parts and queries that start anew change no candidate."""
    ids, x = copied_vectors(1000, 300)
    x[:300] = x[0] + x[:300] * 1e-3
    places = np.arange(0, 1000, 37)
    rows = vector_rows(spark, ids, x)
    asked = rows.filter(F.col("vec_id").isin(ids[places].tolist()))

    def run(**how):
        return sorted(tuple(r) for r in ann.nearest(rows, asked, trees=16, wanted=0.5, **how).collect())

    assert run() == run(part_rows=20, shard_rows=50)


def test_forest_recall_beside_copies(spark):
    ids, x = copied_vectors(6000, 3000)
    places = np.arange(1, 101)
    got = recall_of(spark, ids, x, places)
    print("recall outside a group of a third of the rows:", got)
    assert got >= 0.9
    # A member of the group finds the smallest ids of its copies.
    assert recall_of(spark, ids, x, np.array([0, 6000, 8999])) == 1.0


def test_forest_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), k=20).collect()]
    assert sorted(got) == [(0, 1, 1, 1.0), (0, 2, 2, 0.5), (0, 3, 20, 0.0), (20, 1, 2, 0.5), (20, 2, 0, 0.0), (20, 3, 1, 0.0)]
    assert ann.nearest(df.limit(0), df).count() == 0


def test_forest_rows_that_repeat_an_id(spark):
    """The smallest vector of an id counts, of each length; doubles keep their precision."""
    rows = [(20, [3.0, 0.0]), (20, [1.0, 1e-9]), (20, [5.0]), (1, [2.0, 0.0]), (1, [4.0, 0.0]), (2, [1.0, 1e-9]), (3, [0.0, -1.0]), (4, [7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in ann.nearest(df, df.filter("vec_id = 20")).collect())
    assert got == [(1, 4, 35.0), (2, 1, 2.0), (3, 2, 1.0 + 1e-9 * 1e-9), (4, 3, -1e-9)]


def written_bytes(spark):
    """What the session's shuffles and staged tables have taken so far."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    staged = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    files = [os.path.join(d, f) for d, _, names in os.walk(staged) for f in names]
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) + sum(map(os.path.getsize, files))


def test_forest_is_neither_written_nor_exchanged(spark):
    """Trees and candidates are many times the vectors; what goes to disk stays in proportion to these."""
    ids, x = copied_vectors(6000, 0)
    rows = vector_rows(spark, ids, x)
    before = written_bytes(spark)
    assert ann.nearest(rows, rows.filter("vec_id % 20 = 0")).count() == 300 * 20
    assert 2 * x.nbytes < written_bytes(spark) - before < 4 * x.nbytes


# ------------------------------------------------------------------ op9


@pytest.mark.parametrize(
    "source,text",
    [
        (None, ""),
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a</div><div>b<br>c</div>", "a\nb\nc"),
        ("<ul><li>x<li>y<ol start=3><li>z</ol></ul>", "- x\n- y\n\n  3. z"),
        ("<table><tr><th>Name<th>Qty<tr><td>kiwi fruit<td>2</table>", "Name        Qty\nkiwi fruit  2"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("a<script>var x='<p>no</p>'</script><style>p{}</style><!-- no --> b", "a b"),
        ("<div style='display: none'>no</div><p hidden>no</p>yes", "yes"),
        ("<head><title>no</title></head><body>yes &amp; &lt;ok&gt;</body>", "yes & <ok>"),
        ("<pre>  a\n    b</pre>", "  a\n    b"),
        ("a <b>b</b>c <i> d</i>", "a bc d"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<p>a</i></b></div>b", "ab"),
    ],
)
def test_visible_text(source, text):
    assert html_text.visible_text(source) == text


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 5000 + "x" + "<table><tr><td>" * 300 + "y"
    assert set(html_text.visible_text(deep).split()) == {"x", "y"}
    pages = spark.createDataFrame([(1, "u", deep), (2, None, None), (None, "u", "<p>a")], "page_id long, url string, html string")
    assert html_text.extract_text(pages).count() == 3
    assert html_text.extract_text(pages.limit(0)).count() == 0


# ------------------------------------------------------------------ op1


@pytest.fixture(scope="module")
def pieces():
    return packing.tokenizer_path("piece_bpe_32k.model")


@pytest.mark.parametrize("chunk,search", [(40, 0), (97, 0), (200, 30)])
def test_chunks_encode_as_the_whole(spark, pieces, chunk, search):
    m = sentencepiece_scan.model(pieces)
    draw = np.random.default_rng(6)
    texts = [r.text for r in small_docs(spark).filter("length(text) < 2500").limit(60).collect()]
    texts += ["".join(draw.choice(list("abcdeé漢 \n▁0."), 300)) for _ in range(30)] + ["x" * 500, "ab" * 300, " " * 300, "the" * 200]
    raw = 0
    for t in texts:
        at = sentencepiece_scan.cuts(t, m, chunk, search)
        parts = [(t[max(0, a - m.longest - 1) : b + m.longest + 2], min(a, m.longest + 1), b - max(0, a - m.longest - 1)) for a, b in zip(at[:-1], at[1:], strict=True)]
        states = sentencepiece_scan.best_states([sentencepiece_scan.transfer(x, a, b, m, i == 0) for i, (x, a, b) in enumerate(parts)])
        ids = []
        for i, (x, a, b) in enumerate(parts):
            own, end = sentencepiece_scan.states(x, a, m), sentencepiece_scan.states(x, b, m)
            raw += len(own) > 1
            ids += sentencepiece_scan.between(x, own[states[i]], end[states[i + 1]], m, i == 0) if len(parts) > 1 else m.sp.encode(t)
        assert ids == m.sp.encode(t)
    assert raw > 20 or search


def test_encode_and_decode_documents(spark, pieces):
    docs = odd_docs(spark)
    m = sentencepiece_scan.model(pieces)
    encoded = sentencepiece_scan.encode_documents(docs, pieces, chunk=300, search=20)
    rows = sentencepiece_scan.decode_chunks(encoded, pieces).collect()
    ids = {(r.doc_id, r.key, r.chunk): list(r.ids) for r in encoded.collect()}
    by = collections.defaultdict(dict)
    for r in rows:
        by[(r.doc_id, r.key)][r.chunk] = (r.text, ids[(r.doc_id, r.key, r.chunk)])
    got = set()
    for (d, _), chunks in by.items():
        ordered = [chunks[c] for c in sorted(chunks)]
        got.add((d, "".join(t for t, _ in ordered), tuple(i for _, own in ordered for i in own)))
    assert got == {(r.doc_id, r.text or "", tuple(m.sp.encode(r.text or ""))) for r in docs.collect()}
    assert max(r.chunks for r in rows) > 5


def test_long_rows_that_repeat_are_all_encoded(spark, pieces):
    rows = [(1, "word " * 200), (1, "word " * 200), (1, "other " * 200), (2, "word " * 200), (None, "word " * 200), (None, "word " * 200)]
    out = sentencepiece_scan.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), pieces, chunk=300, search=20)
    first = collections.Counter(r.doc_id for r in out.filter("chunk = 0").collect())
    assert first == {1: 3, 2: 1, None: 2} and out.count() == sum(r.chunks for r in out.filter("chunk = 0").collect())


def test_states_by_a_tree(spark):
    """Products in a tree choose the path that one pass over all matrices chooses; only one is best."""
    draw = np.random.default_rng(11)
    rows, want = [], {}
    for key, n in (("a", 1), ("b", 7), ("c", 40)):
        sizes = [1, *draw.integers(1, 5, n - 1).tolist(), 1]
        own = [draw.normal(size=s) for s in zip(sizes[:-1], sizes[1:], strict=True)]
        states = sentencepiece_scan.best_states(own)
        want |= {(key, i): (states[i], states[i + 1]) for i in range(n)}
        rows += [(key, i, len(t), bytearray(t.tobytes())) for i, t in enumerate(own)] * 2
    df = spark.createDataFrame(rows, sentencepiece_scan.MATRIX)
    for fan in (64, 3):
        assert {(r.key, r.at): (r.from_state, r.to_state) for r in sentencepiece_scan.chosen_states(df, 40, fan).collect()} == want


def test_giant_texts_without_blanks(spark, pieces):
    m = sentencepiece_scan.model(pieces)
    rows = [(2**53 + 1, "ab" * 3000), (None, "thequickbrownfox" * 500), (3, "漢字" * 2000), (4, "x y " * 2000)]
    encoded = sentencepiece_scan.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), pieces, chunk=50, search=0)
    by = collections.defaultdict(dict)
    for r in encoded.collect():
        by[r.doc_id][r.chunk] = list(r.ids)
    assert {d: sum((c[i] for i in sorted(c)), []) for d, c in by.items()} == {d: m.sp.encode(t) for d, t in rows}


def test_max_plus_is_associative():
    draw = np.random.default_rng(8)
    a, b, c = draw.normal(size=(3, 4)), draw.normal(size=(4, 2)), draw.normal(size=(2, 5))
    assert np.allclose(sentencepiece_scan.max_plus(sentencepiece_scan.max_plus(a, b), c), sentencepiece_scan.max_plus(a, sentencepiece_scan.max_plus(b, c)))
