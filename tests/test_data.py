"""Ingest, clustering, evaluation, sources and streams."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from loamdex import service
from loamdex.operators import block_index, cluster, evaluate, extract, ingest, mining
from loamdex.sources import bronze, sinks


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_gate():
    for previous, seen, full in ((10, 0, True), (10, 4, False), (1, 0, False)):
        with pytest.raises(ingest.SafetyGateError):
            ingest.gate(previous, seen, full)
    for previous, seen, full in ((10, 5, False), (10, 1, True), (5, 1, False), (0, 0, False)):
        ingest.gate(previous, seen, full)


def test_merge(spark):
    stored = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.6), (3, "c", 0.7)], "doc_id int, content_hash string, static_score double")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "doc_id int, content_hash string")
    assert values(ingest.merge(stored, new), "doc_id", "status", "content_hash", "static_score") == [(1, "kept", "a", 0.5), (2, "skipped", "b", 0.6), (3, "updated", "x", 0.7), (4, "inserted", "d", None)]
    assert values(ingest.merge(stored, new, force=True), "doc_id", "status")[1] == (2, "updated")


def test_sync_of_page_folders(spark, tmp_path):
    bronze_dir, data = tmp_path / "bronze", str(tmp_path / "data")

    def page(space, name, title, body, meta=True):
        d = bronze_dir / space / name
        d.mkdir(parents=True, exist_ok=True)
        (d / "content.html").write_text(f"<title>{title}</title><p>{body}</p>")
        if meta:
            (d / "meta.json").write_text(json.dumps({"source_id": name, "title": title, "space_or_repo": space, "author": "Kim (deleted)", "updated_at": "2024-01-02T00:00:00Z", "tags": ["x"], "hierarchy": ["a", "b"]}))

    page("S", "1", "One", "first")
    page("S", "2", "Two", "second")
    page("S", "3", "Guide", "third", meta=False)
    assert service.sync(spark, "confluence", str(bronze_dir), data) == {"inserted": 3}
    page("S", "1", "One", "changed")
    (bronze_dir / "S" / "2" / "content.html").unlink()
    assert service.sync(spark, "confluence", str(bronze_dir), data, full=True) == {"updated": 1, "skipped": 1, "kept": 1, "deleted": 1}
    docs = spark.read.parquet(service.places(spark, data)("documents"))
    assert values(docs, "source_id", "title", "author", "doc_type") == [("1", "One", "Kim", None), ("3", "Guide", "", "guide")]
    assert docs.filter("source_id = '1'").first().body == "changed"


def test_sync_keeps_links_scores_chunks_and_index_up_to_date(spark, tmp_path):
    bronze_dir, data = tmp_path / "bronze", str(tmp_path / "data")

    def page(name, title, body, *to):
        d = bronze_dir / "S" / name
        d.mkdir(parents=True, exist_ok=True)
        links = "".join(f'<ac:link><ri:page ri:content-title="{t}" /></ac:link>' for t in to)
        (d / "content.html").write_text(f"<p>{body}</p>{links}")
        (d / "meta.json").write_text(json.dumps({"source_id": name, "title": title, "space_or_repo": "S", "updated_at": "2024-01-02T00:00:00Z"}))

    def state():
        docs = {r.doc_id: r for r in spark.read.parquet(service.places(spark, data)("documents")).collect()}
        name = {i: r.title for i, r in docs.items()}
        links = sorted((name[r.src], name[r.dst]) for r in spark.read.parquet(service.places(spark, data)("links")).collect())
        chunks = sorted(name[r.doc_id] for r in spark.read.parquet(f"{data}/chunks").collect())
        return {name[i]: r.static_score for i, r in docs.items()}, links, chunks

    def same_index():
        docs = spark.read.parquet(service.places(spark, data)("documents"))
        fresh, kept = block_index.build(docs), block_index.load(spark, service.places(spark, data)("index"))
        for table in ("blocks", "lengths", "totals"):
            rows = [sorted(map(tuple, getattr(x, table).select(getattr(fresh, table).columns).collect())) for x in (fresh, kept)]
            assert rows[0] == rows[1]

    page("1", "One", "apples and pears", "Two")
    page("2", "Two", "pears", "Three")
    page("3", "Three", "plums")
    service.sync(spark, "confluence", str(bronze_dir), data)
    scores, links, chunks = state()
    assert links == [("One", "Two"), ("Two", "Three")] and chunks == ["One", "Three", "Two"]
    assert min(scores.values()) > 0 and scores["Two"] > scores["One"]
    same_index()

    page("1", "One", "cherries", "Three")
    (bronze_dir / "S" / "2" / "content.html").unlink()
    service.sync(spark, "confluence", str(bronze_dir), data, full=True)
    scores, links, chunks = state()
    assert links == [("One", "Three")] and chunks == ["One", "Three"] and scores["Three"] > scores["One"]
    same_index()
    found = service.Service.open(spark, data).search("cherries")[0].collect()
    assert [r.title for r in found] == ["One"]


def test_one_writer_at_a_time(spark, tmp_path):
    with ingest.writer_lock(spark, str(tmp_path)):
        with pytest.raises(RuntimeError), ingest.writer_lock(spark, str(tmp_path)):
            pass
        with ingest.writer_lock(spark, str(tmp_path), stale=-1):  # what a dead writer has left is taken over
            pass
    with ingest.writer_lock(spark, str(tmp_path)):
        pass


def test_latency_of_many_searches_is_exact(spark):
    """Each latency once, in two batches: a sketch's quantiles would be off by some."""
    log = spark.range(40_000).select((F.col("id") * 7919 % 40_000 + 1).alias("latency_ms"), F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, CAST(id % 9 AS INT))").alias("ts"), "id")
    days = evaluate.add_days(evaluate.daily_latency(log.filter("id % 2 = 0")), evaluate.daily_latency(log.filter("id % 2 = 1")))
    assert evaluate.period_latency(days).collect() == [("all", 40_000, 20_000, 38_000)]
    assert sorted(r.n for r in days.collect()) == [4444] * 5 + [4445] * 4


def test_latency_of_stored_days(spark, tmp_path):
    import random

    r = random.Random(1)
    values = [(i % 30, int(r.expovariate(1 / 300)) if i % 7 else None) for i in range(60_000)]
    log = spark.createDataFrame(values, "d int, latency_ms long").withColumn("ts", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, d)"))
    first, second = (evaluate.daily_latency(log.filter(F.col("d") % 2 == i)) for i in (0, 1))
    again = evaluate.daily_latency(log.filter("d = 3").limit(0))
    evaluate.add_days(evaluate.add_days(first, second), again).write.parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    assert days.count() == 30
    for period, picked in ((None, range(30)), (F.when(F.dayofmonth("day") <= 10, "early"), range(10))):
        found = evaluate.period_latency(days, period).filter("period IS NOT NULL").first()
        exact = sorted(v for d, v in values if v is not None and d in picked)
        assert found.n == len(exact)
        for value, q in ((found.p50, 0.5), (found.p95, 0.95)):
            below, upto = (sum(v < value for v in exact) / len(exact), sum(v <= value for v in exact) / len(exact))
            assert below - 0.002 <= q <= upto + 0.002
    assert evaluate.period_latency(days.limit(0)).collect() == []


def test_a_writer_that_slept_is_refused(spark, tmp_path):
    path, table = str(tmp_path), str(tmp_path / "t")
    ingest.write_swapped(spark.range(1), table)
    first = ingest.WriterLease(spark, path, 3600.0)
    with pytest.raises(RuntimeError):
        ingest.WriterLease(spark, path, 3600.0)
    second = ingest.WriterLease(spark, path, -1.0)  # the first one's time is over
    assert second.number == first.number + 1
    ingest.write_swapped(spark.range(2), table, second)
    with pytest.raises(ingest.StaleWriter):
        ingest.write_swapped(spark.range(3), table, first)
    with pytest.raises(ingest.StaleWriter):
        first.renew()
    first.release()  # doesn't give away the second one's lease
    with pytest.raises(RuntimeError):
        ingest.WriterLease(spark, path, 3600.0)
    second.release()
    assert spark.read.parquet(table).count() == 2
    third = ingest.WriterLease(spark, path, 3600.0)
    assert third.number == second.number + 1
    third.release()


def test_a_lease_is_renewed_while_it_is_held(spark, tmp_path):
    import time

    with ingest.writer_lock(spark, str(tmp_path), stale=1.5):
        time.sleep(3)
        with pytest.raises(RuntimeError):
            ingest.WriterLease(spark, str(tmp_path), 1.5)


def test_publish_and_drafts(spark, tmp_path):
    for i in (1, 2):
        spark.range(i).write.mode("overwrite").parquet(str(tmp_path / "a" / "t"))
        sinks.publish(spark, str(tmp_path / "a"), str(tmp_path / "b"))
        assert spark.read.parquet(str(tmp_path / "b" / "t")).count() == i
    assert sinks.draft(spark.range(2)) == "- id: 0\n- id: 1\n"
    with pytest.raises(ValueError):
        sinks.draft(spark.range(3), most=2)


def test_git_files_and_commits(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "docs").mkdir(parents=True)
    (repo / "node_modules").mkdir()
    (repo / "README.md").write_text("intro\n# User guide\n")
    (repo / "docs" / "a.py").write_text("print(1)")
    (repo / "node_modules" / "b.md").write_text("no")
    (repo / "c.bin").write_text("no")
    rows = bronze.repo_files(spark, str(repo), "repo", "https://github.com/o/repo")
    assert values(rows, "source_id", "title", "doc_type", "url") == [
        ("repo:README.md", "User guide", "guide", "https://github.com/o/repo/blob/main/README.md"), ("repo:docs/a.py", "docs/a.py", "code", "https://github.com/o/repo/blob/main/docs/a.py"),
    ]
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=Ann", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "README.md")
    git("commit", "-qm", "feat: first")
    spark.dataSource.register(bronze.CommitSource)
    found = spark.read.format("git_commits").option("paths", str(repo)).load()
    assert values(found, "author", "subject") == [("Ann", "feat: first")]


def test_credentials():
    assert bronze.with_credentials("https://h/x", "t", "u") == "https://u:t@h/x"
    assert bronze.with_credentials("https://a@h/x", "t") == "https://a@h/x"
    assert bronze.with_credentials("git@h:x", "t") == "git@h:x"
    assert bronze.date_window("2024-01-01", None, 3) == 'lastmodified >= "2024-01-01"' and bronze.date_window(days=3) == 'lastmodified >= now("-3d")' and bronze.date_window() == ""


def test_components(spark):
    nodes = spark.range(12)
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(10, 11)], "a long, b long")
    assert values(cluster.clusters(nodes, edges), "id", "cluster") == sorted([*((i, 0) for i in range(9)), (9, None), (10, 10), (11, 10)], key=str)


def test_significance(spark):
    assert evaluate.mcnemar_p(0, 6) < 0.05 < evaluate.mcnemar_p(0, 5) and evaluate.least_discordant() == 6 and evaluate.mcnemar_p(0, 0) == 1
    a = spark.createDataFrame([(i, i < 3) for i in range(10)], "case_id int, hit boolean")
    b = spark.createDataFrame([(i, i >= 2) for i in range(10)], "case_id int, hit boolean")
    row = evaluate.mcnemar(a, b).first()
    assert (row.only_a, row.only_b) == (2, 7) and row.p == pytest.approx(evaluate.mcnemar_p(2, 7))


def test_term_conflicts(spark):
    rows = [("t", "one two three", "sql_comment", 1), ("t", "four five six", "sql_comment", 2), ("t", "seven eight", "definition_sentence", 3), ("t", "one two", "sql_comment", 4)]
    out = mining.term_entries(spark.createDataFrame(rows, "term string, definition string, source_type string, doc_id int")).first()
    assert out.definition == "one two three" and out.conflicts == ["four five six", "one two"] and out.n == 4


def test_extraction_retries(spark):
    calls = []

    def failing(kind, text):
        calls.append(kind)
        raise RuntimeError("down")

    docs = spark.createDataFrame([(1, "10:00:00\nAnn: we decided it")], "doc_id int, body string")
    good = extract.extract(docs).first()
    assert good.kind == "meeting" and good.result.segments[0].contains_decision and good.error is None
    assert extract.extract(docs, failing).first().error == "down"


def test_backfills_are_idempotent(spark):
    rows = spark.createDataFrame([(1, None, None, '{"created":"2024-01-01"}')], "doc_id int, created_at timestamp, updated_at timestamp, raw_meta string")
    once = ingest.backfill_dates(rows)
    assert once.collect() == ingest.backfill_dates(once).collect()
    assert once.first().created_at is not None and once.first().updated_at is None
    assert once.filter(F.col("updated_at").isNotNull()).count() == 0


def test_changes_are_written_by_as_many_tasks_as_read_them(spark, tmp_path):
    """The stream's changes once went through two tasks, whatever their size."""
    from pathlib import Path

    from loamdex.plans import registry
    from loamdex.session import shared_dir

    spark.range(400).selectExpr("id AS doc_id", "'s' AS source", "concat('t', id) AS text").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("changes-*"))
    rows = registry.queries()["w4_stream_merge"](spark, str(tmp_path))
    assert rows.count() == sum(1 for i in range(400) if i % 5 or i % 3)
    (made,) = set(folder.glob("changes-*")) - before
    assert len(list(made.glob("part-*"))) > 2


def test_distinct_questions_walk_a_document_without_python(spark):
    rows = [(1, 1, "how does payment work", "b"), (1, 0, "how does payment work today", "a"), (1, 2, "who owns the ledger", "c"), (1, 3, None, "d"), (2, 0, "how does payment work", "e"), (None, 0, "x y", "f")]
    kept = mining.distinct_questions(spark.createDataFrame(rows, "doc_id int, at int, question string, by string"))
    assert kept.columns == ["doc_id", "at", "question", "by"]
    assert "Python" not in (plan := kept._jdf.queryExecution().executedPlan().toString()) and "Pandas" not in plan
    assert values(kept, "doc_id", "at", "by") == [(1, 0, "a"), (1, 2, "c"), (1, 3, "d"), (2, 0, "e"), (None, 0, "f")]


def test_rare_words_are_counted_within_rows(spark):
    """Shuffled are words for their frequencies, words that meet these, what is left by document, and titles; two rows of a
    document are one text."""
    rows = [(1, "one", "alpha beta gamma delta one"), (2, "two", "alpha beta"), (2, "alpha", "gamma alpha gamma"), (3, "delta", "delta alpha beta gamma"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, title string, body string")
    made = mining.rare_term_queries(docs)
    # alpha is in three documents, as the others but delta (two); the title of one row keeps alpha out of document 2.
    assert values(made.select("doc_id", "query").distinct(), "doc_id", "query") == [(1, "delta alpha beta"), (3, "alpha beta gamma")]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Exchange hashpartitioning") <= 6
