"""Text functions against literal values."""

import pytest
from pyspark.sql import functions as F

from loamdex.functions import chunking, markdown
from loamdex.functions import text as T
from loamdex.functions.stem import fold, porter


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_doc_id(spark):
    assert one(spark, T.doc_id(F.lit("confluence"), F.lit("p1"))) == "535ccfa1888c3eda6fe04f18dc4a9610ec1b7b47"


@pytest.mark.parametrize(("text", "wanted"), [("a   b\n\n\n\nc", "a b\n\nc"), ("  x\t\ty ", "x y")])
def test_white_space(spark, text, wanted):
    assert one(spark, T.strip_whitespace(F.lit(text))) == wanted


def test_outline_and_urls(spark):
    assert one(spark, T.heading_outline(F.lit("# A\n본문\n## B"))) == "# A\n## B"
    long = "https://example.test/" + "a" * 80
    assert one(spark, T.shorten_urls(F.lit(f"see {long}?q=1 end"))) == f"see {long[:40]}…{long[-15:]} end"
    assert one(spark, T.shorten_urls(F.lit("http://a.b/c?d=e x"))) == "http://a.b/c x"


def test_particles(spark):
    assert one(spark, T.normalize_words(F.lit("마트를 갔다, 나라"))) == "마트 갔다 나라"
    assert T.query_terms("마트를 a 휴가는!") == ["마트", "휴가"]
    assert one(spark, T.tokens(F.lit("사람으로서 Hello"))) == ["사람", "hello"]


def test_content_hash_is_over_json_lists(spark):
    import hashlib
    import json

    tags, path = ["b", 'a"x'], ["s", "t"]
    wanted = hashlib.sha256(("t" + "b" + json.dumps(sorted(tags)) + json.dumps(path)).encode()).hexdigest()
    assert one(spark, T.content_hash(F.lit("t"), F.lit("b"), F.array(*map(F.lit, tags)), F.array(*map(F.lit, path)))) == wanted


def test_markdown():
    assert markdown.to_markdown("<h2>A</h2><p>x <b>y</b></p><script>no</script><!-- no --><ol><li>a<li>b</ol>") == "## A\n\nx **y**\n\n1. a\n2. b"
    macro = '<ac:structured-macro ac:name="status"><ac:parameter ac:name="title">DONE</ac:parameter></ac:structured-macro>'
    assert markdown.to_markdown(macro) == "[DONE]"
    assert markdown.to_markdown('<ac:image><ri:attachment ri:filename="a.png"/></ac:image>') == "[Attachment: a.png]"
    assert markdown.to_markdown(None) is None
    assert markdown.fold_code("```\n1\n2\n3\n4\n```") == "```\n1\n2\n3\n… (+1 lines)\n```"
    assert markdown.shorten_tables("|a|\n|-|\n|1|\n") == "|a|\n| … 1행 생략 …"


def test_chunks_overlap_by_one_paragraph_at_least():
    paragraphs = ["a" * 300, "b" * 300, "c" * 30, "d" * 20, "e" * 400]
    made = chunking.pack("\n\n".join(paragraphs))
    a, b, c, d, e = paragraphs
    assert made == [a, f"{a}\n\n{b}", f"{b}\n\n{c}\n\n{d}", f"{c}\n\n{d}\n\n{e}"]
    assert chunking.pack("") == [] and chunking.pack("x" * 2000) == ["x" * 2000]


def test_sections_and_summary(spark):
    docs = spark.createDataFrame([(1, "# A\nx\n## B\ny"), (2, "plain"), (3, "")], "doc_id int, body string")
    rows = [tuple(r) for r in chunking.sections(docs).orderBy("doc_id", "section").collect()]
    assert rows == [(1, 0, "A", "x"), (1, 1, "B", "y"), (2, 0, None, "plain")]
    assert one(spark, chunking.summary(F.lit("리드.\n\n둘째 문단."))) == "리드."
    assert chunking.lead("One. " * 100, 12) == "One. One."


def test_stemmer():
    assert [porter(w) for w in ("caresses", "ponies", "motoring", "hopping", "relational", "generalizations", "sky")] == ["caress", "poni", "motor", "hop", "relat", "gener", "sky"]
    assert fold("Écran") == "ecran"


def test_rules_from_a_setting():
    assert T.parse_doc_type_rules("a:x|y, broken, b:, c:z") == (("a", ("x", "y")), ("c", ("z",)))


def test_texts_go_to_python_in_small_batches(spark):
    """Not as Arrow batches, which hold up to 10,000 texts and their copies."""
    rows = spark.createDataFrame([("a\n```\n1\n2\n3\n4\n```\n|h|\n|-|\n|1|",), (None,)], "v string")
    for made in (markdown.compress(F.col("v")), markdown.html_to_markdown(F.col("v")), markdown.adf_text(F.col("v"))):
        df = rows.select(made.alias("x"))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
        assert [r.x is None for r in df.collect()] == [False, True]


def small_batches(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_bodies_are_cut_into_chunks_in_small_batches(spark):
    docs = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, "")], "doc_id int, body string")
    made = chunking.chunks(docs)
    assert small_batches(made) and [tuple(r) for r in made.collect()] == [("1#0", 1, 0, "a\n\nb")]
    assert small_batches(docs.select(chunking.summary(F.col("body")).alias("x")))
