"""The pipeline's stages, each on what its predecessor kept."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from orbitframe.llm import secrets, toxicity
from orbitframe.llm.common import maybe_in

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    docs, seen = source, [source]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    assert all(d.columns == source.columns for d in seen[:-1])
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen[:-1]]
    # Toxicity: exactly the documents that the fitted grammar rejects go.
    fitted = toxicity.fit_toxicity(source, spark.read.parquet(f"{DATA}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.toxicity_scores(source, *fitted).filter("score >= 0.5").collect()}
    assert set(texts[0]) - set(texts[1]) == rejected
    # Near duplicates: of equal texts one stays, the smallest id; nothing else changes.
    first = {}
    for d, t in sorted(texts[1].items()):
        first.setdefault(t, d)
    assert all(first[t] == d for d, t in texts[2].items()) and all(texts[2][d] == texts[1][d] for d in texts[2])
    # Passages: no window of fifty words starts in two documents.
    starts = collections.defaultdict(set)
    for d, t in texts[3].items():
        w = t.split()
        for i in range(len(w) - 49):
            starts[tuple(w[i : i + 50])].add(d)
    assert all(len(s) == 1 or texts[3][min(s)] == texts[2][min(s)] for s in starts.values())
    # Secrets: none is left, other texts stay as they were.
    assert all(not secrets.find_secrets(t) for t in texts[4].values())
    assert all(texts[4][d] == t for d, t in texts[3].items() if not secrets.find_secrets(t))
    assert {r.doc_id for r in seen[-1].collect()} == set(texts[4])


def test_null_rows_pass(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
    assert sorted(str(r.doc_id) for r in docs.collect()) in (["1", "2", "None"], ["1", "None"])


def test_rows_that_repeat_an_id_are_judged_apart(spark):
    def text(seed, n=120):
        return " ".join(f"w{seed}x{i}" for i in range(n))

    passage = text(9, 60)
    rows = [(1, text(1)), (7, text(1)), (7, text(2)), (7, text(3)), (7, text(2)), (7, text(2)), (3, passage), (8, f"{text(4)} {passage}"), (8, text(5)), (8, passage + " " + text(6)), (None, text(1)), (None, text(1))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")

    def shown(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    near = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert shown(near) == sorted([rows[i] for i in (0, 2, 3, 6, 7, 8, 9, 10, 11)], key=str)
    cut = corpus_pipeline.drop_repeated_passages(spark, docs.filter("doc_id IN (3, 8)"), DATA)
    assert [(d, t.strip()) for d, t in shown(cut)] == sorted([rows[6], (8, text(4)), rows[8], (8, text(6))], key=str)


def test_columns_of_any_name_pass_through(spark):
    names = ["n", "first", "row", "_null", "key", "doc", "kept", "n_words", "n_removed", "spans", "carry", "c0", "no_text", "hash", "component_id", "component_key", "score", "block", "_range", "_place", "_start"]
    rows = [(1, "one two three four five six seven", *[f"1{c}" for c in names]), (2, "one two three four five six seven", *[f"2{c}" for c in names]), (3, "password=abcdef123 other words stand here in this row", *[f"3{c}" for c in names]), (4, None, *[None for _ in names])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", *names], name
        for r in docs.collect():
            assert all(r[c] == (f"{r.doc_id}{c}" if r.doc_id != 4 else None) for c in names), name
    assert {1, 3} <= {r.doc_id for r in docs.collect()} and 2 not in {r.doc_id for r in docs.collect()}
    assert stage is not corpus_pipeline.pack_sequences and corpus_pipeline.pack_sequences(spark, docs, DATA).count() >= 2


def test_texts_that_stay_are_not_shuffled(spark):
    rows = [(i, f"only {i} " * 40) for i in range(300)] + [(1000 + i, f"only {i} " * 40) for i in range(5)] + [(7, "only 7 " * 40)] * 2 + [(None, "only 9 " * 40)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
        got = sorted(str(r.doc_id) for r in out.collect())
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == sorted([*map(str, range(300)), "None"])
    # Of the three reads of the texts each goes through a table of keys; the one without a join takes what the table rules out.
    assert plan.count("[maybe(pmod(xxhash64(md5(") == 3 and plan.count("Join ") == 2


def test_keys_of_a_table_are_all_found(spark):
    keys = spark.range(0, 30000, 3).selectExpr("md5(cast(id AS string)) AS row")
    maybe = maybe_in(keys, "row")
    found = {r.id for r in spark.range(30000).filter(maybe(F.md5(F.col("id").cast("string")))).collect()}
    assert set(range(0, 30000, 3)) <= found and len(found) < 13000
    assert not spark.range(100).filter(maybe_in(keys.limit(0), "row")(F.col("id").cast("string"))).count()
