"""The pipeline's stages against brute force, and the whole of it on awkward tables."""

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DATA
from tests.llm.test_text_operators import item_words, jaccard_classes

tokenizers = pytest.importorskip("public_tokenizers")


def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """Tables with documents of every awkward kind; one is a benchmark item with personal data around it."""
    place = tmp_path_factory.mktemp("tables")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    item = bench.first()["text"]
    own = docs.select("doc_id", "text", "lang", "source").withColumn("n_chars", F.char_length("text").cast("long")).withColumn("_hash", F.lit(7))
    prose = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60").select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("_hash", F.lit(8))
    extra = spark.createDataFrame([(50_000, f"{item} and mail to a.b@example.org", "en", "web", 1, 9), (50_001, "Write to a.b@example.org about this. " + " ".join(f"the word{k}" for k in range(30)), "en", "web", 1, 9)], own.schema)
    own.unionByName(prose).unionByName(extra).write.parquet(f"{place}/documents.parquet")
    bench.write.parquet(f"{place}/benchmark.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{place}/labels.parquet")
    return str(place)


def test_each_stage_on_its_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    bench = [item_words(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in bench for k in range(len(w) - 9)} | {tuple(w) for w in bench if 0 < len(w) < 10}
    sizes = {len(w) for w in windows}
    for name, stage in list(stages().items())[:-1]:
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns
        kept = [(r["doc_id"], r["text"]) for r in found.collect()]
        if name == "n-gram Jaccard join":
            assert sorted(map(str, (i for i, _ in kept))) == sorted(map(str, {c for _, c, _ in jaccard_classes([(i, t or "") for i, t in rows])}))
        elif name == "benchmark decontamination":
            def hit(t):
                w = item_words(t)
                return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

            assert sorted(map(str, kept)) == sorted(map(str, (r for r in rows if not hit(r[1])))) and (50_000, rows[-2][1]) not in kept
        elif name == "personal data":
            assert len(kept) == len(rows) and all("a.b@example.org" not in (t or "") for _, t in kept)
            assert found.where("n_chars <> char_length(text)").count() == 0
        else:
            assert set(map(str, kept)) <= set(map(str, rows))


def test_encoding_stage_round_trips(spark, folder):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = stages()["BPE encoding"](spark, docs, folder)
    expected = []
    for r in docs.collect():
        ids = model.encode(r["text"] or "", add_special_tokens=False).ids
        expected.append((r["doc_id"], len(ids), model.decode(ids, skip_special_tokens=False)))
    assert sorted(map(str, ((r["doc_id"], r["n_tokens"], r["decoded"]) for r in found.collect()))) == sorted(map(str, expected))


def test_the_whole_and_an_empty_table(spark, folder, tmp_path):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, folder)
    ids = {r["doc_id"] for r in found.collect()}
    assert 50_000 not in ids and ids <= {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for name in ("documents", "benchmark", "labels"):
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        (rows.limit(0) if name == "documents" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
