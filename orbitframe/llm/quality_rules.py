"""Quality rules whose thresholds come from quantile sketches per language and source.

Only DataFrame functions: the words of a text stay an array column and its repeated windows are found by sorting their
hashes within the row, so nothing but the counts is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Size of a sketch. Groups of up to as many rows are held exactly.
SKETCH_K = 4096
#: Ratios that have a fence, the least spread of each that counts, and the sides that are judged.
RULES = {"word_length": (1.0, "both"), "symbol_share": (0.03, "high"), "dup_line_share": (0.1, "high"), "repeat_share": (0.05, "high"), "mark_share": (0.05, "high"), "echo_share": (0.05, "high")}
QUARTILES = (0.25, 0.5, 0.75)


def _deleted(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def rule_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the counts of every whole text: n_words, word_chars, n_symbols, n_marks, n_lines, n_dup_lines,
    n_echoes (words equal to the one before), n_repeat_words (long). A null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: _deleted(x, WHITE) > 0)
    own = [f"keep{i}" for i in range(len(keep))]
    rows = rows.select(
        *own,
        F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "").alias("words"),
        lines.alias("lines"),
        _deleted(F.col("text"), WHITE).cast("long").alias("word_chars"),
        (F.length("text") - _deleted(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length("text") - _deleted(F.col("text"), "!?")).cast("long").alias("n_marks"),
    )
    w = F.col("words")
    last = F.size("words") - WINDOW
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    counts = ["word_chars", "n_symbols", "n_marks"]
    rows = rows.select(
        *own,
        *counts,
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda x, i: F.get(w, i - 1) == x)).cast("long").alias("n_echoes"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    counts += ["n_words", "n_lines", "n_echoes", "n_dup_lines"]
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    at = F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    rows = rows.select(*own, *counts, F.when(repeated, F.array_sort(at)).alias("s"))
    s = F.col("s")
    twin = F.filter("s", lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    rows = rows.select(*own, *counts, F.array_sort(F.transform(twin, lambda x: x["i"])).alias("p"))
    p = F.col("p")
    covered = F.transform("p", lambda x, i: F.coalesce(F.least(F.lit(WINDOW), F.get(p, i + 1) - x), F.lit(WINDOW)))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(*[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], *counts, F.coalesce(total, F.lit(0).cast("long")).alias("n_repeat_words"))


def _ratios() -> list[Column]:
    words = F.when(F.col("n_words") > 0, F.col("n_words")).cast("double")
    return [
        (F.col("word_chars") / words).alias("word_length"),
        (F.col("n_symbols") / words).alias("symbol_share"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(4))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_marks") / words).alias("mark_share"),
        (F.col("n_echoes") / words).alias("echo_share"),
    ]


def _fences(sketch: str, ratio: str, spread: float, width: float) -> list[Column]:
    low, high = (f"kll_sketch_get_quantile_double({sketch}, cast({q} as double))" for q in (QUARTILES[0], QUARTILES[-1]))
    apart = f"greatest({high} - {low}, cast({spread} as double))"
    cuts = {"low": f"{low} - {width} * {apart}", "high": f"{high} + {width} * {apart}"}
    return [F.when(F.col("rows") > 0, F.expr(cut)).alias(f"{ratio}_{side}") for side, cut in cuts.items()]


def thresholds(ratios: DataFrame, width: float = 4.0, least_rows: int = 100) -> DataFrame:
    """``(lang, source, <ratio>_low, <ratio>_high)``: quartiles widened by ``width`` times their distance, for every pair.

    Each pair has one sketch per ratio, built from per-task sketches; these are merged into one per language and one for
    all. A pair of fewer than ``least_rows`` rows uses its language's, a language of fewer uses the one for all."""
    build = [F.expr(f"kll_sketch_agg_double({r}, {SKETCH_K})").alias(r) for r in RULES]
    merge = [F.expr(f"kll_merge_agg_double({r}, {SKETCH_K})").alias(r) for r in RULES]
    pairs = staged(ratios.filter("n_words > 0").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"), *build), "sketches")
    langs = pairs.groupBy("lang").agg(F.sum("rows").alias("rows"), *merge)
    every = pairs.agg(F.sum("rows").alias("rows"), *merge)

    def fenced(df, suffix, keys):
        cuts = [c for r, (spread, _) in RULES.items() for c in _fences(r, r, spread, width)]
        named = df.select(*keys, "rows", *cuts)
        return named.select(*[F.col(k).alias(f"{k}{suffix}") for k in keys], *[F.col(c).alias(f"{c}{suffix}") for c in named.columns[len(keys) :]])

    a, b, overall = fenced(pairs, "_p", ["lang", "source"]), fenced(langs, "_l", ["lang"]), fenced(every, "_a", []).first()
    joined = a.join(b, F.col("lang_p").eqNullSafe(F.col("lang_l")))
    names = [f"{r}_{side}" for r in RULES for side in ("low", "high")]
    pick = [F.when(F.col("rows_p") >= least_rows, F.col(f"{n}_p")).when(F.col("rows_l") >= least_rows, F.col(f"{n}_l")).otherwise(F.lit(overall[f"{n}_a"])).alias(n) for n in names]
    return joined.select(F.col("lang_p").alias("t_lang"), F.col("source_p").alias("t_source"), *pick)


def quality_rules(docs: DataFrame, width: float = 4.0, least_rows: int = 100, least_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules)`` for every row.

    ``base_failed``: fewer than ``least_words`` words, or more than ``repeat_percent`` in a hundred words in repeated windows.
    Otherwise a text is kept if every ratio lies within the fences of its language and source (null is a value of its
    own). Ties with a fence are kept."""
    keep = ["doc_id", "lang", "source"]
    counts = staged(rule_counts(docs, keep), "counts")
    ratios = counts.select("*", *_ratios())
    cuts = thresholds(ratios, width, least_rows)
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    out = []
    for r, (_, sides) in RULES.items():
        broken = F.col(r) > F.col(f"{r}_high")
        out.append(F.when(broken | (F.col(r) < F.col(f"{r}_low")) if sides == "both" else broken, F.lit(r)))
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    judged = ratios.join(cuts, same, "left").withColumn("failed_rules", F.array_compact(F.array(*out))).withColumn("base_failed", base)
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "failed_rules")
