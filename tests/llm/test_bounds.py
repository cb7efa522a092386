"""Properties and bounds: layout of pages, long blanks, shards of ids in steps, the size of a fit."""

import random
import time
import tracemalloc

import numpy as np
import pytest

from orbitframe.llm import ann, html_text, packing, substring

# ------------------------------------------------------------------ op9


def test_wide_spans_keep_cells_in_their_columns():
    rows = "<tr><td colspan=300>wide<td>end</tr>" + "<tr>" + "".join(f"<td>c{i}" for i in range(301))
    first, second = html_text.visible_text(f"<table>{rows}</table>").split("\n")
    assert first.index("end") == second.index("c300")
    rows = "<tr><td rowspan=80>tall<td>r0</tr>" + "".join(f"<tr><td>r{i}</tr>" for i in range(1, 81))
    lines = html_text.visible_text(f"<table>{rows}</table>").split("\n")
    assert [line.index("r") for line in lines] == [6] * 80 + [0]
    assert html_text.visible_text("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == "a  b\n   c\n   d"
    assert html_text.visible_text("<table><tr><td colspan=999999999999999999999>a<td>b</table>") == "a  b"
    assert html_text.visible_text("<table><tr><td colspan=x>a<td rowspan=-1>b</table>") == "a  b"


def test_columns_wider_than_usual_align_where_that_is_cheap():
    long = "x" * 400
    lines = html_text.visible_text(f"<table><tr><td>{long}<td>b<tr><td>s<td>c</table>").split("\n")
    assert [line[402:] for line in lines] == ["b", "c"]
    many = "<tr><td>s<td>c" * 2000
    out = html_text.visible_text(f"<table><tr><td>{long}<td>b{many}</table>")
    assert len(out) < 2000 * (html_text.WIDEST + 10)


def slow_columns(rows):
    """Where each cell goes, on a grid of single places."""
    used, out = set(), []
    for r, cells in enumerate(rows):
        c, own = 0, []
        for across, down in cells:
            while (r, c) in used:
                c += 1
            used |= {(r + i, c + j) for i in range(down) for j in range(across)}
            own.append(c)
            c += across
        out.append(own)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_tables_against_a_grid_of_places(seed):
    """Cells of one column begin at one offset, in the order of their columns."""
    rnd = random.Random(seed)
    rows = [[(rnd.choice((1, 1, 1, 2, 3, 60)), rnd.choice((1, 1, 1, 2, 70))) for _ in range(rnd.randint(1, 6))] for _ in range(rnd.randint(1, 8))]
    source = "".join("<tr>" + "".join(f"<td colspan={a} rowspan={d}>w{r}q{i}{'z' * rnd.randint(0, 9)}" for i, (a, d) in enumerate(cells)) for r, cells in enumerate(rows))
    lines = html_text.visible_text(f"<table>{source}</table>").split("\n")
    offset = {}
    for r, own in enumerate(slow_columns(rows)):
        for i, c in enumerate(own):
            assert offset.setdefault(c, lines[r].index(f"w{r}q{i}")) == lines[r].index(f"w{r}q{i}")
    columns = sorted(offset)
    assert [offset[c] for c in columns] == sorted(set(offset.values()))


def random_page(rnd, depth, seen, shown):
    out = []
    for _ in range(rnd.randint(1, 4)):
        kind = rnd.choice(("text", "text", "div", "p", "ul", "span", "blockquote", "hidden", "script", "table", "pre"))
        if kind == "text" or depth == 0:
            word = f"w{len(seen)}"
            seen.append((word, shown))
            out.append(f" {word} ")
        elif kind == "script":
            out.append("<script>no</script>")
        elif kind == "hidden":
            out.append(f"<div hidden>{random_page(rnd, depth - 1, seen, False)}</div>")
        elif kind == "ul":
            out.append("<ul>" + "".join(f"<li>{random_page(rnd, depth - 1, seen, shown)}" for _ in range(rnd.randint(1, 3))) + "</ul>")
        elif kind == "table":
            row = lambda: "<tr>" + "".join(f"<td>{random_page(rnd, 0, seen, shown)}" for _ in range(rnd.randint(1, 3)))
            out.append("<table>" + "".join(row() for _ in range(rnd.randint(1, 3))) + "</table>")
        else:
            inner = random_page(rnd, depth - 1 if kind != "p" else 0, seen, shown)
            out.append(f"<{kind}>{inner}</{kind}>")
    return "".join(out)


@pytest.mark.parametrize("seed", range(40))
def test_every_visible_word_once_and_in_order(seed):
    seen = []
    source = random_page(random.Random(seed), 4, seen, True)
    words = [w for w in html_text.visible_text(source).split() if w not in ("-", "no")]
    assert words == [w for w, shown in seen if shown]


# ------------------------------------------------------------------ op6


def test_long_blanks_are_quick_and_equal():
    ids = packing.Ids(packing.tokenizer_path("byte_bpe_50k.json"))
    for run in (1, 299, 300, 301, 5000, 19_999):
        for blank in ("\n", " ", " \t"):
            text = ("word" + (blank * run)[:run]) * 3 + "end"
            assert ids.encode(text).tolist() == ids.slow(text).tolist()
    text = ("\n" * 19_999 + "a") * 30
    begin = time.time()
    ids.encode(text)
    assert time.time() - begin < 3
    # Looking for long blanks takes time in proportion to the text.
    begin = time.time()
    assert not ids.LONG_BLANK.search((" " * 299 + "a") * 30_000)
    assert time.time() - begin < 3


def test_plain_texts_are_not_searched_for_blanks(monkeypatch):
    ids, path = packing.Ids(packing.tokenizer_path("byte_bpe_50k.json")), packing.tokenizer_path("byte_bpe_50k.json")
    for before in (*range(0, 205, 7), 99, 100):
        for run in (298, 299, 300, 301, 399):
            text = "a" * before + " " * run + "b" * 150
            assert ids.ranked(text) == (not ids.LONG_BLANK.search(text))
    monkeypatch.setattr(packing.Ids, "LONG_BLANK", None)
    assert ids.ranked("some  plain\n\nwords " * 5000)
    # Tasks of a worker share what was made of the file.
    assert packing.worker_ids(path, True) is packing.worker_ids(path, True)



# ------------------------------------------------------------------ op5


@pytest.mark.parametrize("step", [1, 4, 1000, 1 << 40])
def test_ids_in_steps_spread_over_shards(step):
    part = ann.spread(np.arange(64_000, dtype=np.int64) * step, 4)
    assert np.bincount(part, minlength=4).min() > 15_000


def crowded_entries(trees=3, n=500):
    """Bit strings, some of which share many bits, and those of queries."""
    draw = np.random.default_rng(8)
    entries = draw.integers(0, 1 << 32, (trees, n), np.uint32)
    entries[:, :200] = (entries[:, :1] & np.uint32(0xFFFFF000)) | (entries[:, :200] & np.uint32(0xFFF))
    entries[:, 200:205] = np.uint32(0xFFFFFFFF)
    keys = np.concatenate([entries[:, ::7], np.full((trees, 1), 0xFFFFFFFF, np.uint32), draw.integers(0, 1 << 32, (trees, 50), np.uint32)], axis=1)
    return entries, keys


def shares(entries, keys, length):
    """(trees, entries, queries): whether an entry shares the first ``length`` bits."""
    shift = np.uint64(32 - length)
    return (entries.astype(np.uint64) >> shift)[:, :, None] == (keys.astype(np.uint64) >> shift)[:, None, :]


def test_sizes_equal_plain_counts():
    entries, keys = crowded_entries()
    got = np.concatenate([ann.shallow_sizes(entries, keys), ann.deep_sizes(entries, keys)])
    assert got.tolist() == [shares(entries, keys, length).sum(axis=(0, 1)).tolist() for length in range(1, 33)]


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_a_shard_scores_what_shares_a_prefix(kind):
    entries, keys = crowded_entries(140)
    draw = np.random.default_rng(9)
    x, asked, length = draw.standard_normal((500, 8)).astype(kind), draw.standard_normal((keys.shape[1], 8)), draw.integers(0, 33, keys.shape[1])
    x[250:260] = x[240:250] * (1e25 if kind == np.float32 else 1)
    counts = draw.integers(1, 4, 500)
    ids = draw.permutation(counts.sum())
    owner, score = np.repeat(np.arange(500), counts), np.array([np.add.reduce(x.astype(float) * v, axis=1) for v in asked])
    shard = ann.Shard(x, entries.copy(), ids, counts)
    low, size = shard.ranges(keys, length.astype(np.uint8))
    for i, v in enumerate(asked):
        same = np.flatnonzero(shares(entries, keys[:, i : i + 1], int(length[i])).any(axis=(0, 2))).tolist()
        assert size[i].any() == bool(same)
        if same:
            place = shard.places(low[i], size[i])
            assert place.tolist() == same
            best = sorted((-score[i, p], n) for p, n in zip(owner.tolist(), ids.tolist(), strict=True) if p in same and n != ids[0])[:20]
            got = ann._first(*shard.best(int(ids[0]), v, place, 20, -np.inf), 20)
            assert list(zip((-got[0]).tolist(), got[1].tolist(), strict=True)) == best


# ------------------------------------------------------------------ op3


def test_sorting_suffixes_holds_one_key_at_a_time():
    draw = np.random.default_rng(5)
    n, width = 50_000, 58
    codes = np.asfortranarray(draw.integers(0, 3, (n, width), np.uint8))
    codes[n // 2 :] = codes[: n - n // 2]
    doc = draw.integers(0, 9, n)
    tracemalloc.start()
    try:
        order, shared = substring.sorted_suffixes(codes, doc)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < n * width
    rows = [(codes[i].tobytes(), int(doc[i]), i) for i in range(n)]
    assert order.tolist() == [i for _, _, i in sorted(rows)]
    same = (codes[order][1:] == codes[order][:-1]).cumprod(axis=1).sum(axis=1)
    assert shared.tolist() == [0, *same.tolist()]


def test_packed_suffixes_come_back_by_place():
    draw = np.random.default_rng(6)
    codes, doc, place = draw.integers(0, 256, (400, 21), np.uint8), draw.integers(0, 2**60, 400), draw.permutation(9000)[:400]
    back = substring.unpack_suffixes(substring.pack_suffixes(codes, doc, place))
    order = np.argsort(place)
    assert [np.array_equal(a, b[order]) for a, b in zip(back, (codes, doc, place), strict=True)] == [True] * 3
