import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hustings.llm import common, jaccard, pii, queries, toxicity

INSULTS = ["clodpole", "numbnut", "wretch"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean and toxic documents, copies, near copies, personal data, nulls and a clashing column."""
    r = random.Random(9)
    vocab = ["".join(r.choice("aeiourstnlmd") for _ in range(r.randint(3, 8))) for _ in range(800)]
    docs, labels = [], []
    for i in range(300):
        words = [r.choice(vocab) for _ in range(r.randint(20, 60))]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(r.randint(0, len(words)), r.choice(INSULTS))
        docs.append(" ".join(words))
        labels.append((i, int(toxic)))
    clean = [t for t, (_, y) in zip(docs, labels) if not y]
    near = clean[3].split()
    near[5] = "other"
    docs += [clean[0], clean[0], " ".join(near), "write to jane@example.com and 10.0.0.1 " + " ".join(vocab[:30]), None, "", "short text"]
    rows = [(k, t, "en", "s", len(t) if t is not None else None, "x") for k, t in enumerate(docs)] + [(None, "no id here", None, None, None, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, t string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_take_effect(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "pii", "packing"]

    kept = corpus_pipeline.drop_toxic(spark, docs, corpus)
    model = toxicity.fit(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    assert kept.columns == columns and len(rejected) > 60
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in docs.collect() if r.doc_id not in rejected)

    one = corpus_pipeline.keep_one_of_each(spark, kept, corpus)
    found = jaccard.link(kept).collect()
    want = {r.component_id for r in found if r.doc_id is not None}
    ids = [r.doc_id for r in one.collect()]
    assert one.columns == columns and sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1
    assert not {300, 301, 302} & want and {304, 305, 306} <= want

    masked = corpus_pipeline.mask_personal_data(spark, one, corpus)
    texts = {r.doc_id: r for r in masked.collect()}
    assert masked.columns == columns and texts[303].text.startswith("write to <email> and <ip> ") and texts[303].n_chars == len(texts[303].text)
    assert all(not pii.fixed_spans(r.text or "") for r in texts.values())


def test_run_packs_what_is_kept(spark, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.byte_bpe())
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus)
    want = sorted((str(r.doc_id), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    got = corpus_pipeline.run(spark, corpus).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sorted((str(r.doc_id), r.n) for r in got) == want


def test_stages_start_on_collected_executors(spark, corpus, monkeypatch):
    docs, seen = spark.read.parquet(f"{corpus}/documents.parquet").limit(5).cache(), []
    monkeypatch.setattr(common, "tidy", lambda s: seen.append(s))
    for name, stage in corpus_pipeline.STAGES:
        seen.clear()
        stage(spark, docs, corpus)
        assert seen, name


def test_executors_collect_their_garbage(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    old = [b for b in beans if "Young" not in b.getName() and "Copy" != b.getName()]
    before = sum(b.getCollectionCount() for b in old)
    common.collect_garbage(spark)
    assert sum(b.getCollectionCount() for b in old) > before


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
