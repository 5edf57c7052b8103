"""The pipeline's stages, each against a plain version on the same input."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loamdex.llm import rule_ensemble
from tests.llm.data import SF, table
from tests.llm.test_chosen_path import brute as groups
from tests.llm.test_suffix_dedup import WINDOW


def kept_texts(rows):
    first, out = {}, {}
    data = [(r.doc_id, (r.text or "").encode()) for r in rows]
    for i, b in data:
        for s in range(len(b) - WINDOW + 1):
            key = b[s : s + WINDOW]
            first[key] = min(first.get(key, (i, s)), (i, s))
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - WINDOW + 1):
            if first[b[s : s + WINDOW]] < (i, s):
                gone[s : s + WINDOW] = b"\1" * WINDOW
        out[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "substrings", "mixture", "tokens"]
    docs = table(spark, "documents").withColumn("extra", F.lit(1))

    good = stages["quality"](spark, docs, SF).cache()
    wanted = {r.doc_id for r in rule_ensemble.classify(docs, table(spark, "labels")).filter("predicted = 1").collect()}
    assert tuple(good.columns) == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in good.collect()} == wanted and good.count() > 0

    single = stages["near_dedup"](spark, good, SF).cache()
    wanted = {i for i, _, _, kept in groups([(r.doc_id, r.text) for r in good.collect()]) if kept}
    assert tuple(single.columns) == corpus_pipeline.COLUMNS and {r.doc_id for r in single.collect()} == wanted

    rest = stages["substrings"](spark, single, SF).cache()
    assert tuple(rest.columns) == corpus_pipeline.COLUMNS
    assert {r.doc_id: r.text for r in rest.collect()} == kept_texts(single.collect())
    assert all(r.n_chars == len(r.text) for r in rest.collect())

    mixed = stages["mixture"](spark, rest, SF).cache()
    assert tuple(mixed.columns) == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in mixed.filter("text <> ''").collect()} == {r.doc_id for r in rest.filter("text <> ''").collect()}

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    counts = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in mixed.collect()}
    final = stages["tokens"](spark, mixed, SF)
    assert final.count() == mixed.count() and {r.doc_id: r.n_tokens for r in final.collect()} == counts


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_edge_cases(spark):
    """Nulls in every column, empty texts, ties, repeated rows, extra columns of clashing names, a very long text."""
    long = " ".join(f"w{i * 7919 % 10_007}" for i in range(60_000))
    text = " ".join(f"v{i}" for i in range(80))
    rows = [(None, None, None, None, None), (900_001, "", "en", "s", 0), (900_002, None, "fr", None, 0), (900_003, text, "en", "s", 1), (900_003, text, "en", "s", 1), (900_004, text, None, "s", 1),
            (None, text + " x", "en", "s", 1), (900_005, long, "en", "long", 1), (900_006, long + " y", "en", "long", 1)]
    edge = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit("x"), "kept": F.lit(1), "n_tokens": F.lit(None), "id": F.lit(2)})
    stages = dict(corpus_pipeline.STAGES)
    for name in ("near_dedup", "substrings", "mixture"):
        assert tuple(stages[name](spark, edge, SF).columns) == corpus_pipeline.COLUMNS
    key = lambda df: sorted((str(r.doc_id), (r.text or "")[:20]) for r in df.collect())
    single = stages["near_dedup"](spark, edge, SF)
    # A null id is one document of several rows here, so those that are near to nothing keep it.
    assert [k for k in key(single) if k[0] != "None"] == sorted([("900001", ""), ("900002", ""), ("900003", text[:20]), ("900003", text[:20]), ("900005", long[:20])])
    cut = {(r.doc_id, r.n_chars) for r in stages["substrings"](spark, edge, SF).collect() if r.doc_id is not None}
    assert {(900_001, 0), (900_002, 0), (900_003, len(text)), (900_004, 0)} <= cut
    assert [0 < n < len(long) for i, n in cut if i == 900_005] == [True]  # it repeats itself
    mixed = key(stages["mixture"](spark, edge, SF))
    assert {k for k in mixed if k[1]} == {k for k in key(edge) if k[1]} and len(mixed) >= len([k for k in key(edge) if k[1]])
    assert stages["tokens"](spark, edge, SF).count() == len(rows)
    good = stages["quality"](spark, table(spark, "documents").unionByName(edge.select(*corpus_pipeline.COLUMNS)).withColumn("score", F.lit("x")), SF)
    assert tuple(good.columns) == corpus_pipeline.COLUMNS and good.count() > 0
    for stage in stages.values():
        assert stage(spark, edge.limit(0), SF).count() == 0
