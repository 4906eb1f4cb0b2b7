"""The stages of the pipeline: what each keeps, over odd rows and columns, and the whole of it."""

import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quarry.llm import classifier, decontamination, mixing  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [
    (None, None, None, None), (None, "text of a null id", "en", "s"), (90_001, None, None, "s"), (90_002, "", "en", None), (90_003, "   \n\t", "en", "s"), (90_004, "word", "en", "s"),
    (90_005, "a sentence of enough words to be one, said twice in the table.", "en", "s"), (90_005, "a sentence of enough words to be one, said twice in the table.", "en", "s"),
    (2**53 + 1, "another sentence with a token=abcdefgh in it, said once only.", "en", "s"), (90_007, "b " * 40_000, "en", "s"),
]
#: Names that the operators use inside.
CLASHES = ("key", "w", "n_words", "n_hit", "items", "hit_items", "size", "bucket", "score", "quality", "quality_score", "spans", "found_spans", "secret_key", "rep", "same", "class_id", "chunk", "segment", "term", "is_positive")


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(*r, len(r[1] or "")) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    out = table.unionByName(odd).selectExpr("*", *(f"{i} as {c}" for i, c in enumerate(CLASHES)))
    return out.repartition(4).cache()


def shown(frame):
    return Counter(map(str, frame.collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_keeps_columns_and_reruns_agree(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    got = shown(out)
    assert got == shown(stage(spark, docs.repartition(3), SF))
    if name != "redact_secrets":
        assert not got - shown(docs) and got
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_what_stages_keep(spark, docs):
    rows = docs.collect()
    ids = lambda frame: Counter(r.doc_id for r in frame.collect())
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    scores = classifier.report(docs, labels).collect()
    assert ids(corpus_pipeline.quality(spark, docs, SF)) == Counter(r.doc_id for r in scores if r.predicted)
    hit = {r.doc_id for r in decontamination.report(docs, bench).collect() if r.contaminated}
    assert hit and ids(corpus_pipeline.decontaminate(spark, docs, SF)) == Counter(r.doc_id for r in rows if r.doc_id not in hit)
    once = ids(corpus_pipeline.near_duplicates(spark, docs, SF))
    assert once[90_005] == 1 and once[None] == 2 and all(once[i] == 1 for i in (90_001, 90_002, 90_003, 90_004, 90_007, 2**53 + 1))
    clean = {r.doc_id: r.text for r in corpus_pipeline.redact_secrets(spark, docs, SF).collect()}
    assert "<secret>" in clean[2**53 + 1] and clean[90_004] == "word" and clean[90_001] is None
    assert len(clean) == len({r.doc_id for r in rows})


def test_mix_holds_the_words_of_its_documents(spark, docs):
    space = re.compile(r"[^\x20\x09-\x0D]+")
    words, taken = Counter(), Counter()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).update(space.findall(r.text or ""))
        words[r.source] += len(space.findall(r.text or ""))
    for r in corpus_pipeline.mix(spark, docs, SF).collect():
        taken[r.source] += len(r.text.split(" "))
        assert len(r.text.split(" ")) <= mixing.BLOCK_WORDS
        if None not in texts or r.source != "s":  # words of a null id's text have no id to be found by
            assert set(r.text.split(" ")) <= set().union(*(texts[i] for i in r.doc_ids))
    goal = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(words.items()), "source string, source_size long")).collect()}
    assert all(abs(taken[s] - goal[s]) < 1.01 for s in words)


def test_whole_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["source", "shard", "slot", "block", "text", "doc_ids"]
    rows = out.collect()
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert rows and {i for r in rows for i in r.doc_ids} <= ids
