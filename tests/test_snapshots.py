"""Tables by bucket behind one pointer."""

import pytest
from pyspark.sql import functions as F

from loamdex import cli, service
from loamdex.operators import ingest, snapshots
from loamdex.streaming import logs


def rows(spark, ids, mark="a"):
    return spark.createDataFrame([(i, f"{mark}{i}", f"text {mark} {i}", 0.5) for i in ids], "doc_id long, content_hash string, body string, static_score double")


def state(spark, path, number=None):
    return {r.doc_id: (r.content_hash, r.static_score) for r in snapshots.latest(spark, path, number).table("documents").collect()}


@pytest.fixture
def path(spark, tmp_path):
    where = str(tmp_path / "t")
    change = snapshots.Change(spark, where)
    change.put("documents", rows(spark, range(400)), ["doc_id"], 16)
    assert change.commit() == 1
    return where


def parts(spark, path):
    return snapshots.latest(spark, path).tables["documents"].parts


def test_a_batch_writes_the_buckets_that_it_touches(spark, path):
    before = parts(spark, path)
    assert len(before) == 16
    change = snapshots.Change(spark, path)
    # One row as it is, one changed, one new; keys of another type fall into the same buckets.
    batch = rows(spark, [7], "b").unionByName(rows(spark, [8, 1000])).withColumn("doc_id", F.col("doc_id").cast("int")).drop("static_score")
    stats = change.merge("documents", batch)
    assert state(spark, path)[7] == ("a7", 0.5)  # nothing takes effect before the commit
    change.commit()
    touched = {b for b, f in parts(spark, path).items() if before.get(b) != f}
    assert stats == {"skipped": 1, "updated": 1, "inserted": 1, "buckets": len(touched)} and len(touched) <= 2
    expected = {i: (f"a{i}", 0.5) for i in range(400)} | {7: ("b7", 0.5), 1000: ("a1000", None)}
    assert state(spark, path) == expected
    assert state(spark, path, 1) == {i: (f"a{i}", 0.5) for i in range(400)}
    found = snapshots.latest(spark, path).table("documents", among=spark.createDataFrame([(7,)], "doc_id int"))
    assert len({f.split("/")[-2] for f in found.inputFiles()}) == 1 and found.filter("doc_id = 7").count() == 1


def test_rows_leave_and_equal_ones_write_nothing(spark, path):
    change = snapshots.Change(spark, path)
    assert change.merge("documents", rows(spark, [1, 2])) == {"skipped": 2, "buckets": 0}
    assert change.next.tables == change.base.tables
    stats = change.merge("documents", rows(spark, [3, 500], "c"), gone=spark.createDataFrame([(3,), (4,), (9999,)], "doc_id long"))
    assert stats["deleted"] == 2 and stats["inserted"] == 1 and "updated" not in stats
    change.commit()
    assert state(spark, path) == {i: (f"a{i}", 0.5) for i in range(400) if i not in (3, 4)} | {500: ("c500", 0.5)}
    change = snapshots.Change(spark, path)
    change.merge("documents", rows(spark, []), gone=snapshots.latest(spark, path).table("documents"))
    change.commit()
    assert state(spark, path) == {} and parts(spark, path) == {}
    change = snapshots.Change(spark, path)
    assert change.merge("documents", rows(spark, [1]))["inserted"] == 1
    change.commit()
    assert state(spark, path) == {1: ("a1", 0.5)}


def test_keys_that_cant_be_merged(spark, path):
    for bad in (rows(spark, [1, 1]), rows(spark, [1]).withColumn("doc_id", F.lit(None).cast("long"))):
        with pytest.raises(ValueError, match="null or repeated"):
            snapshots.Change(spark, path).merge("documents", bad)
    with pytest.raises(ValueError, match="bucket"):
        snapshots.Change(spark, path).put("x", rows(spark, [1]).withColumn(snapshots.BUCKET, F.lit(1)), ["doc_id"])


def test_without_hashes_all_rows_are_written(spark, tmp_path):
    path = str(tmp_path)
    change = snapshots.Change(spark, path)
    change.put("links", spark.createDataFrame([(1, 2, "x"), (2, 3, None)], "src long, dst long, note string"), ["src", "dst"])
    change.commit()
    change = snapshots.Change(spark, path)
    assert change.merge("links", spark.createDataFrame([(1, 2), (5, 6)], "src long, dst long")) == {"updated": 1, "inserted": 1, "buckets": 1}
    change.commit()
    assert sorted(map(tuple, snapshots.latest(spark, path).table("links").collect())) == [(1, 2, "x"), (2, 3, None), (5, 6, None)]  # what the rows lack stays


@pytest.mark.parametrize("step", ["write", "rename"])
def test_a_writer_that_dies_leaves_the_last_state(spark, path, monkeypatch, step):
    change = snapshots.Change(spark, path)
    change.put("links", spark.createDataFrame([(1, 2)], "src long, dst long"), ["src"])
    change.merge("documents", rows(spark, [7], "b"))
    place = change.folder("index")
    spark.range(3).write.parquet(place)

    class Died(Exception):
        pass

    def die(*_):
        raise Died

    if step == "write":
        monkeypatch.setattr(snapshots._Files, "write", die)
    else:
        monkeypatch.setattr(snapshots.json, "dumps", die)
    with pytest.raises(Died):
        change.commit()
    monkeypatch.undo()
    found = snapshots.latest(spark, path)
    assert found.number == 1 and set(found.tables) == {"documents"} and found.folder("index") is None and state(spark, path)[7] == ("a7", 0.5)
    with ingest.writer_lock(spark, path) as lease:
        change = snapshots.Change(spark, path, lease)
        change.merge("documents", rows(spark, [8], "d"))
        spark.range(3).write.parquet(change.folder("index"))
        assert change.commit() == 3  # the dead writer's number is left out
    found = snapshots.latest(spark, path)
    assert state(spark, path)[8] == ("d8", 0.5) and spark.read.parquet(found.folder("index")).count() == 3
    assert not snapshots._Files(spark, path).fs.exists(snapshots._Files(spark, path).at(place.split(f"{path}/")[1]))  # its data was swept


def test_two_writers_of_one_base(spark, path):
    first, second = snapshots.Change(spark, path), snapshots.Change(spark, path)
    first.merge("documents", rows(spark, [1], "x"))
    second.merge("documents", rows(spark, [2], "y"))
    second.commit()
    with pytest.raises(ingest.StaleWriter):
        first.commit()
    assert state(spark, path)[1] == ("a1", 0.5) and state(spark, path)[2] == ("y2", 0.5)


def test_a_writer_without_its_lease_is_refused(spark, path):
    first = ingest.WriterLease(spark, path, 3600.0)
    change = snapshots.Change(spark, path, first)
    change.merge("documents", rows(spark, [1], "x"))
    second = ingest.WriterLease(spark, path, -1.0)
    with pytest.raises(ingest.StaleWriter):
        change.commit()
    assert state(spark, path)[1] == ("a1", 0.5)
    first.release()
    second.release()


def test_earlier_versions_go(spark, path):
    with ingest.writer_lock(spark, path) as lease:
        for i in range(3):
            change = snapshots.Change(spark, path, lease)
            change.merge("documents", rows(spark, [i], "z"))
            change.commit()
    files = snapshots._Files(spark, path)
    assert len([n for n in files.names("_versions") if n.endswith(".json")]) == 2
    named = {f for n in (3, 4) for f in snapshots.latest(spark, path, n).tables["documents"].parts.values()}
    assert set(files.names("_data")) == named
    assert [state(spark, path)[i][0] for i in range(4)] == ["z0", "z1", "z2", "a3"]


def test_streamed_batches_are_merged_once(spark, path, tmp_path):
    source = str(tmp_path / "in")
    columns = "doc_id long, content_hash string, body string, updated_at timestamp"
    batch = lambda *r: spark.createDataFrame([(i, h, h, None) for i, h in r], columns).withColumn("updated_at", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, cast(substr(content_hash, 2) as int))"))
    batch((1, "v1"), (1, "v3"), (1, "v2"), (900, "v1")).write.mode("append").parquet(source)

    def run():
        apply = logs.merge_into_buckets(path)
        stream = spark.readStream.schema(columns).parquet(source)
        stream.writeStream.foreachBatch(apply).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    run()
    assert snapshots.latest(spark, path).number == 2 and state(spark, path)[1] == ("v3", 0.5) and state(spark, path)[900] == ("v1", None)
    batch((1, "v3"), (900, "v1")).write.mode("append").parquet(source)
    run()
    assert snapshots.latest(spark, path).number == 2  # nothing new, nothing written
    batch((901, "v1")).write.mode("append").parquet(source)
    run()
    assert len(state(spark, path)) == 402


def test_tables_of_a_service_change_together(spark, tmp_path, monkeypatch):
    import json

    data, raw = str(tmp_path / "data"), tmp_path / "raw"

    def page(name, body):
        (raw / "S" / name).mkdir(parents=True, exist_ok=True)
        (raw / "S" / name / "content.html").write_text(f"<p>{body}</p>")
        (raw / "S" / name / "meta.json").write_text(json.dumps({"source_id": name, "title": f"Page {name}", "space_or_repo": "S"}))

    page("1", "apples")
    service.sync(spark, "confluence", str(raw), data)
    page("1", "cherries")
    monkeypatch.setattr(snapshots.Change, "commit", lambda self, keep=2: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        service.sync(spark, "confluence", str(raw), data)
    monkeypatch.undo()
    titles = lambda query: [r.title for r in service.Service.open(spark, data).search(query)[0].collect()]
    assert titles("apples") == ["Page 1"] and titles("cherries") == []  # documents and index are those of one state
    assert service.sync(spark, "confluence", str(raw), data) == {"updated": 1}
    assert titles("apples") == [] and titles("cherries") == ["Page 1"]
    service.Service.open(spark, data, settings=service.Settings(allow_reindex=True)).reindex(data)
    assert titles("cherries") == ["Page 1"]
    assert cli.health(spark, data) == {"documents": True, "index/blocks": True, "links": True, "chunks": True}
    docs = service.Service.open(spark, data).docs
    service.build(docs.withColumn("body", F.lit("plums")), data)
    assert titles("plums") == ["Page 1"] and titles("cherries") == []
