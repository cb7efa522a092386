"""Registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import ann, html_text, lm_trie, merkle, negatives, packing, quality_crf, quality_rules, secrets, sentencepiece_scan, simhash, substring, toxicity
from .common import held_out, id_crc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by chunk, and the hash of the text that they decode to."""
    path = packing.tokenizer_path("piece_bpe_32k.model")
    return sentencepiece_scan.round_trip(_table(spark, sf_dir, "documents"), path)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return out.withColumn("failed_rules", F.array_join("failed_rules", ","))


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_crf.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(_table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), packing.tokenizer_path("byte_bpe_50k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(_table(spark, sf_dir, "documents"))
    line = "concat_ws(':', s.kind, s.start, s.end)"
    base = F.expr("filter(spans, s -> s.kind IN ('assign', 'access', 'hex'))")

    def count(kind):
        return F.size(F.expr(f"filter(spans, s -> s.kind = '{kind}')")).cast("long").alias(f"n_{kind}")

    out = found.withColumn("base", base)
    digest = F.sha2(F.expr(f"array_join(transform(base, s -> {line}), ',')").cast("binary"), 256)
    return out.select("doc_id", count("assign"), count("access"), count("hex"), digest.alias("base_sha256"), F.expr(f"array_join(transform(spans, s -> {line}), ',')").alias("spans"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five negatives for each of the five positives of every anchor, on components in steps of 1/256."""
    rows = _table(spark, sf_dir, "embeddings").filter("NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    return negatives.hard_negatives(rows.select("vec_id", label.alias("label"), whole.alias("vector")), "vec_id % 100 = 0")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; those of every fifth id hash are folded from a text in lower case."""
    lowered = {"text": F.translate("text", CAPITALS, CAPITALS.lower())}
    return merkle.manifest(_table(spark, sf_dir, "documents"), FIELDS, lowered, id_crc() % 5 == 0)


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the nine tenths that aren't held out."""
    return lm_trie.lm_scores(_table(spark, sf_dir, "documents"), id_crc() % 10 == 0)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op5_hash_prefix_forest": op5_hash_prefix_forest,
    "op9_html_text": op9_html_text,
    "op2_quality_rules": op2_quality_rules,
    "op4_quality_crf": op4_quality_crf,
    "op3_substring_dedup": op3_substring_dedup,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op10_secrets": op10_secrets,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_lm_scores": op13_lm_scores,
    "pipeline": corpus_pipeline.run,
}

WORDS_SQL = r"""t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
 w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t)"""

OP3_SQL = f"""WITH {WORDS_SQL},
 g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM w, unnest(range(1, len(w) - 11)) r(i)),
 f AS (SELECT s, min(doc_id) AS low FROM g GROUP BY s),
 c AS (SELECT DISTINCT doc_id, i + k AS p FROM g JOIN f USING (s), range(0, 13) r(k) WHERE low < doc_id),
 e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
 k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM e ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
 SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""


def _op2_sql(width: float = 4.0, least_rows: int = 100) -> str:
    ratios = list(quality_rules.RULES)
    quarters = ", ".join(f"quantile_disc({r}, 0.25) AS {r}_a, quantile_disc({r}, 0.75) AS {r}_b" for r in ratios)
    cuts = []
    for r, (spread, _) in quality_rules.RULES.items():
        a, b = (f"CASE WHEN p.rows >= {least_rows} THEN p.{r}_{x} WHEN l.rows >= {least_rows} THEN l.{r}_{x} ELSE e.{r}_{x} END" for x in "ab")
        cuts.append(f"{a} - {width} * greatest({b} - {a}, {spread}) AS {r}_low, {b} + {width} * greatest({b} - {a}, {spread}) AS {r}_high")
    broken = [f"CASE WHEN {r} > {r}_high" + (f" OR {r} < {r}_low" if sides == "both" else "") + f" THEN '{r}' END" for r, (_, sides) in quality_rules.RULES.items()]
    return f"""WITH {WORDS_SQL},
 ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln FROM t),
 g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS s FROM w, unnest(range(1, len(w) - 3)) r(i)),
 h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
 rw AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM h, range(0, 5) r(k) GROUP BY doc_id),
 c AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '{quality_rules.SYMBOLS}', '')) AS n_symbols,
  length(text) - length(translate(text, '!?', '')) AS n_marks, len(ln) AS n_lines, len(ln) - len(list_distinct(ln)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echoes FROM w JOIN ln USING (doc_id) LEFT JOIN rw USING (doc_id)),
 r AS (SELECT *, word_chars / nullif(n_words, 0) AS word_length, n_symbols / nullif(n_words, 0) AS symbol_share, n_dup_lines / greatest(n_lines, 4) AS dup_line_share,
  n_repeat_words / nullif(n_words, 0) AS repeat_share, n_marks / nullif(n_words, 0) AS mark_share, n_echoes / nullif(n_words, 0) AS echo_share FROM c),
 pq AS (SELECT lang, source, count(*) AS rows, {quarters} FROM r WHERE n_words > 0 GROUP BY ALL), lq AS (SELECT lang, count(*) AS rows, {quarters} FROM r WHERE n_words > 0 GROUP BY ALL),
 eq AS (SELECT {quarters} FROM r WHERE n_words > 0),
 b AS (SELECT r.*, {", ".join(cuts)} FROM r LEFT JOIN pq p ON r.lang IS NOT DISTINCT FROM p.lang AND r.source IS NOT DISTINCT FROM p.source LEFT JOIN lq l ON r.lang IS NOT DISTINCT FROM l.lang CROSS JOIN eq e),
 j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, list_filter([{", ".join(broken)}], lambda x: x IS NOT NULL) AS bad FROM b)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(bad) = 0 AS kept, array_to_string(bad, ',') AS failed_rules FROM j"""


OP11_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, a.e AS key, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
 p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, key ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5)
 SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.key, p.n ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND p.key = s.key AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score) WHERE rank <= 5"""


def _field_sql(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR) || ':' || {name}::VARCHAR END"


def _merkle_sql(levels: int = 6) -> str:
    """Leaves, then ``levels`` levels of each source, then as many over the sources: enough for 16 ** levels rows of a source."""
    bit = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384::BIGINT) ELSE {0} >> 1 END"
    steps = ", ".join(f"c{k + 1} AS (SELECT i, {bit.format('v')} AS v FROM c{k})" for k in range(8))
    crc = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"
    parts, leaf = [f"c0 AS (SELECT i, i AS v FROM range(256) r(i)), {steps}, tb AS (SELECT list(v ORDER BY i) AS t FROM c8)"], " || ".join(map(_field_sql, FIELDS))
    capitals = f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')"
    low = leaf.replace(_field_sql("text"), _field_sql(capitals))
    parts.append(f"""d AS (SELECT coalesce('=' || source, '') AS tree, doc_id, sha256({leaf}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({low}) ELSE sha256({leaf}) END AS changed FROM documents, tb),
 s0 AS (SELECT tree, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
 w0 AS (SELECT tree, doc_id, leaf, changed, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, '' AS proof, changed AS f FROM d)""")

    def beside(a: str, b: str) -> None:
        run = "string_agg(h, '') OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN "
        parts.append(f"{b} AS (SELECT tree, i, n, {run}UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, {run}1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM {a})")

    def climb(a: str, siblings: str, b: str) -> None:
        folded = "CASE WHEN n > 1 THEN sha256(coalesce(l, '') || f || coalesce(r, '')) ELSE f END AS f"
        parts.append(f"{b} AS (SELECT x.* REPLACE (CASE WHEN n > 1 THEN i // 16 ELSE 0 END AS i, proof || coalesce(l, '') || coalesce(r, '') AS proof, {folded}) FROM {a} x JOIN {siblings} USING (tree, i))")

    def rise(a: str, b: str) -> None:
        parts.append(f"{b} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM (SELECT tree, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, CASE WHEN n > 1 THEN i // 16 ELSE 0 END AS i FROM {a} GROUP BY tree, n, CASE WHEN n > 1 THEN i // 16 ELSE 0 END))")

    for k in range(levels):
        rise(f"s{k}", f"s{k + 1}")
        beside(f"s{k}", f"g{k}")
        climb(f"w{k}", f"g{k}", f"w{k + 1}")
    parts.append(f"s{levels + 1} AS (SELECT 'all' AS tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, tree AS name FROM s{levels})")
    parts.append(f"t0 AS (SELECT tree, h, i, n FROM s{levels + 1}), u0 AS (SELECT w.* REPLACE ('all' AS tree, s.i AS i), s.h AS subroot FROM w{levels} w JOIN s{levels + 1} s ON w.tree = s.name)")
    for k in range(levels):
        rise(f"t{k}", f"t{k + 1}")
        beside(f"t{k}", f"q{k}")
        climb(f"u{k}", f"q{k}", f"u{k + 1}")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM u{levels} JOIN t{levels} USING (tree)"


#: The thresholds of op2 are exact up to SKETCH_K rows a group, which the check's scale doesn't reach.
ORACLES: dict[str, str] = {"op2_quality_rules": _op2_sql(), "op3_substring_dedup": OP3_SQL, "op11_hard_negatives": OP11_SQL, "op12_merkle_manifest": _merkle_sql()}
