"""The pipeline's stages on a small table: what goes, what stays, and that columns are kept."""

import hashlib
import random

import corpus_pipeline
from tallyspark.llm.simhash import one_of_each

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 7))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(80, 200)))) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [(300, rows[1][1] + " extra"), (400, None), (401, ""), (402, "12345 !!"), (403, rows[7][1] + " password: abcdefghijkl"), (7, rows[7][1]), (None, rows[9][1])]
    return [(d, t, "en" if (d or 0) % 3 else None, f"s{(d or 0) % 4}", None if t is None else len(t)) for d, t in rows]


def test_stages(spark, tmp_path):
    df = spark.createDataFrame(documents(), SCHEMA)
    docs, seen = df, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    language, near, secret, mixed, tokens = seen
    assert all(d.columns == df.columns for d in seen[:-1])
    assert {r.doc_id for r in language.collect()} >= set(range(120)) and language.where("doc_id IN (400, 401, 402)").count() == 0
    assert language.where("lang IS NULL").count() == 0
    kept = [r.doc_id for r in near.collect()]
    assert sorted(kept) == sorted(set(kept)) and set(range(120)) <= set(kept) and not {200 + i for i in range(20)} & set(kept) and None not in kept
    assert secret.count() == near.count() and secret.where("text LIKE '%abcdefghijkl%'").count() == 0
    assert set(r.doc_id for r in mixed.collect()) <= set(kept) and mixed.count() > 0
    assert tokens.count() == mixed.count()
    want = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect())
    assert sorted((r.doc_id, r.decoded_sha256) for r in tokens.collect()) == want


def test_one_of_each_keeps_one_row(spark):
    rows = [(5, "a b c d"), (3, "A B C D"), (3, "A B C D"), (None, "a b c d"), (9, ""), (8, None), (7, "other words stand here")]
    got = one_of_each(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int"))
    assert got.columns == ["doc_id", "text", "fp"] and sorted(r.doc_id for r in got.collect()) == [3, 7, 8]
    nulls = one_of_each(spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string"))
    assert nulls.count() == 1


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


def test_run_reads_documents(spark, tmp_path):
    spark.createDataFrame(documents(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "source_mixing", "byte_bpe"]


def test_the_last_stage_writes_the_tokenised_corpus(spark, tmp_path):
    from tallyspark.llm.bpe import decode_documents

    docs = spark.createDataFrame(documents(), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    counts = corpus_pipeline.run(spark, str(tmp_path))
    written = spark.read.parquet(counts.inputFiles()[0].rsplit("/", 1)[0])
    assert written.schema["ids"].dataType.simpleString() == "array<int>" and written.count() == counts.count() > 0
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((r.doc_id, digest(r.text)) for r in decode_documents(written).collect()) == sorted((r.doc_id, r.decoded_sha256) for r in counts.collect())
