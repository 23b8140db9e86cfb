"""Streams over folders of JSON text."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from docspark.operators import events as E
from docspark.sources.tables import read
from docspark.streaming import files, sessions

D = "/root/testdata/sf0.001"


def event(i, kind="file.uploaded", at="2024-01-01T00:00:00Z"):
    own = {"file_type": "pdf", "storage_path": "p", "original_filename": f"{i}.pdf", "uploaded_by": "u"} if kind == "file.uploaded" else {"deleted_by": "u"}
    return json.dumps({"event_type": kind, "doc_id": str(i), "vault_id": "1", "timestamp": at, **own})


def test_events_letters_and_audit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join([event(1), event(2), event(2), "broken", event(3)[:20]]))
    (tmp_path / "in/b.txt").write_text("\n".join([event(4), event(4, "file.deleted", "2024-01-02T00:00:00Z")]))
    query = files.run(files.file_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), as_of="2024-02-01 00:00:00")
    query.awaitTermination()
    got = {r.doc_id: r.event_type for r in spark.read.parquet(str(tmp_path / "out/events")).collect()}
    assert got == {"1": "file.uploaded", "2": "file.uploaded", "3": None, "4": "file.deleted"} or got == {"1": "file.uploaded", "2": "file.uploaded", "4": "file.deleted"}
    letters = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/dead_letters")).collect()]
    assert sorted(x["original_event"] for x in letters) == sorted(["broken", event(3)[:20]]) and all(x["retry_count"] == 0 for x in letters)
    assert spark.read.parquet(str(tmp_path / "out/audit")).count() == 4  # the event that came twice counts once
    # A second start finds nothing new.
    files.run(files.file_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), as_of="2024-02-01 00:00:00").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/audit")).count() == 4
    # What comes again in a later batch is passed over, letters too.
    (tmp_path / "in/c.txt").write_text("\n".join([event(1), "broken", event(5)]))
    files.run(files.file_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), as_of="2024-02-01 00:00:00").awaitTermination()
    audit = spark.read.parquet(str(tmp_path / "out/audit")).collect()
    assert sorted(r.doc_id for r in audit) == ["1", "2", "4", "4", "5"]
    assert spark.read.text(str(tmp_path / "out/dead_letters")).count() == 2


def test_repeats_across_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, rows in (("a", [event(1), event(2)]), ("b", [event(1), event(1, "file.deleted"), event(3)])):
        (tmp_path / f"in/{name}.txt").write_text("\n".join(rows))
    stream = files.decoded(files.file_stream(spark, str(tmp_path / "in"), 1)).select("doc_id", "event_type")
    stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("once").collect())) == [("1", "file.deleted"), ("1", "file.uploaded"), ("2", "file.uploaded"), ("3", "file.uploaded")]


def segments(spark, tmp_path, parts=3):
    rows = read(spark, D, "segments").where("is_final").withColumn("end_s", F.col("start_s") + 2)
    for i in range(parts):
        # By time within each session, as they would come.
        rows.where((F.col("segment_index") >= 2 * i) & ((F.col("segment_index") < 2 * i + 2) | F.lit(i == parts - 1))).coalesce(1).write.mode("append").json(str(tmp_path / f"in{i}"))
    return rows


def test_live_batches_are_those_of_the_replay(spark, tmp_path):
    import os
    import shutil

    rows = segments(spark, tmp_path)
    (tmp_path / "in").mkdir()
    for i in range(3):
        for p in sorted((tmp_path / f"in{i}").glob("*.json")):
            to = shutil.copy(p, tmp_path / f"in/{i}-{p.name}")
            os.utime(to, (1_700_000_000 + 60 * i,) * 2)  # files are read by age
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    live = sessions.stream_claim_batches(stream, expire_ms=None)
    query = live.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    got, want = ({tuple(r) for r in df.collect()} for df in (spark.table("live"), sessions.claim_batches(rows)))
    # A session's last batch stays in its state until it expires.
    missing = want - got
    assert not got - want, (sorted(got - want)[:3], sorted(missing)[:3])
    assert len(missing) <= rows.select("session_id").distinct().count()


def test_pieces_of_sessions_are_the_whole(spark):
    """Sessions with pauses, bursts beyond the buffer and none, against one buffer for each; replayed in several groups."""
    import math
    import random

    rows, want = [], set()
    for session in range(12):
        rng, t, buffer = random.Random(session), 0.5, sessions.Buffer()
        for i in range(400):
            burst = session % 3 == 1 and 100 < i % 200 < 190 or session == 5
            t = round(t + (rng.choice([0.001, 0.002]) if burst else rng.choice([0.2, 0.7, 1.3, 2.0, 5, 9, 9.99, 10, 10.01, 30])), 3)
            text = "x" * rng.choice([0, 3, 10, 40])
            rows.append((session, i, t, text))
            want |= {(session, *r) for r in buffer.add(i, t, len(text))}
        want |= {(session, *r) for r in buffer.tick_to(math.inf)}
    df = spark.createDataFrame(rows, "session_id long, segment_index int, end_s double, text string")
    got = [tuple(r) for r in sessions.claim_batches(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len({r[-1] for r in want}) > 5  # the number of context segments does vary
    assert sessions.claim_batches(df.limit(0)).collect() == []


def test_one_session_of_all_rows_is_replayed_in_many_groups(spark):
    import math

    rows = read(spark, "/root/testdata/sf0.01", "segments").where("is_final").selectExpr("0L AS session_id", "event_id AS segment_index", "event_id * 1.7D + (event_id div 40) * 12 AS end_s", "text")
    buffer, want = sessions.Buffer(), []
    for r in sorted(rows.collect(), key=lambda r: r.segment_index):
        want += [(0, *x) for x in buffer.add(r.segment_index, r.end_s, len(r.text))]
    want += [(0, *x) for x in buffer.tick_to(math.inf)]
    assert sorted(tuple(r) for r in sessions.claim_batches(rows).collect()) == sorted(want)


def test_live_sessions_keep_texts_context_and_entities(spark, tmp_path):
    said = [(1, 0, 1.0, "invoice 12345 is due"), (1, 1, 2.0, "the total is right"), (1, 2, 30.0, "Total the is right"), (1, 3, 31.0, "order 777 too"), (1, 4, 60.0, None), (2, 0, 1.0, "hello there all of you"), (2, 1, 40.0, None)]
    df = spark.createDataFrame(said, "session_id long, segment_index int, end_s double, text string")
    for i, part in enumerate((df.where("segment_index < 2"), df.where("segment_index >= 2"))):
        part.coalesce(1).write.mode("append").json(str(tmp_path / f"in{i}"))
    import os
    import shutil

    (tmp_path / "in").mkdir()
    for i in range(2):
        for f in sorted((tmp_path / f"in{i}").glob("*.json")):
            os.utime(shutil.copy(f, tmp_path / f"in/{i}-{f.name}"), (1_700_000_000 + 60 * i,) * 2)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = sessions.stream_live_sessions(stream, expire_ms=None).writeStream.format("memory").queryName("spoken").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    one, two, other = sorted(spark.table("spoken").collect(), key=lambda r: (r.session_id, r.batch))
    assert (one.texts, one.context, one.entities, one.n_repeats) == (["invoice 12345 is due", "the total is right"], [], ["12345"], 0)
    assert (two.texts, two.context, two.entities, two.n_repeats) == (["order 777 too"], ["invoice 12345 is due", "the total is right"], ["12345", "777"], 1)
    assert other.texts == ["hello there all of you"] and other.fired_at == 3.0


def put(tmp_path, df, parts, folder="in"):
    """A file for each condition of `parts`, read in this order."""
    import os
    import shutil

    (tmp_path / folder).mkdir(exist_ok=True)
    for i, part in enumerate(parts):
        df.where(part).coalesce(1).write.json(str(tmp_path / f"{folder}-{i}"))
        for f in sorted((tmp_path / f"{folder}-{i}").glob("*.json")):
            os.utime(shutil.copy(f, tmp_path / f"{folder}/{i}-{f.name}"), (1_700_000_000 + 60 * i,) * 2)
    return str(tmp_path / folder)


SAID = "session_id long, segment_index int, end_s double, text string"


def live(spark, tmp_path, name, df, parts, **more):
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(put(tmp_path, df, parts, name))
    query = sessions.stream_live_sessions(stream, **more).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c-{name}"))
    return query


def finished(spark, query, name):
    query = query.trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return sorted(spark.table(name).collect(), key=lambda r: (r.session_id, r.batch)), query


def test_a_pause_of_minutes_keeps_claims_entities_and_context(spark, tmp_path):
    said = [(1, 0, 1.0, "invoice 12345 is due in march 2016"), (1, 1, 700.0, "so invoice 12345 is due in march 2016"), (1, 2, 1400.0, "order 777 was shipped to berlin"), (1, 3, 1500.0, None)]
    df = spark.createDataFrame(said, SAID)
    got, _ = finished(spark, live(spark, tmp_path, "paused", df, [f"segment_index = {i}" for i in range(4)], expire_ms=None), "paused")
    assert [(r.batch, r.texts, r.n_repeats) for r in got] == [(0, ["invoice 12345 is due in march 2016"], 0), (1, [], 1), (2, ["order 777 was shipped to berlin"], 0)]
    assert got[1].context == ["invoice 12345 is due in march 2016"] and got[2].entities == ["12345", "777"]


def test_stream_keeps_the_claims_that_dedup_claims_keeps(spark, tmp_path):
    from docspark.operators.claims import dedup_claims

    rows = read(spark, D, "segments").where("is_final").withColumn("end_s", F.col("start_s") + 2).select("session_id", "segment_index", "end_s", "text")
    last = rows.groupBy("session_id").agg((F.max("segment_index") + 1).alias("segment_index"), (F.max("end_s") + 10).alias("end_s")).withColumn("text", F.lit(None).cast("string"))
    df = rows.unionByName(last)
    want = sorted((r.session_id, r.text) for r in dedup_claims(rows.select("session_id", "segment_index", "text")).collect())
    got, _ = finished(spark, live(spark, tmp_path, "same", df, ["segment_index < 2", "segment_index >= 2"], expire_ms=None), "same")
    assert sorted((r.session_id, t) for r in got for t in r.texts) == want and 0 < len(want) < rows.count()
    assert sum(r.n_repeats for r in got) == rows.count() - len(want)


def test_state_of_a_trigger_does_not_grow_with_the_session(spark, tmp_path):
    """Six triggers of equal size: rows written to the state are as many in the last as in the second; sessions that ended leave none."""
    said = [(s, 10 * t + k, 60.0 * t + k, f"shipment {1000 * t + 100 * k + s} left harbour {chr(97 + k) * 5} {chr(97 + t) * 6}") for s in range(3) for t in range(6) for k in range(4)]
    df = spark.createDataFrame([*said, *[(s, 900, 9000.0, None) for s in range(3)]], SAID)
    _, query = finished(spark, live(spark, tmp_path, "steady", df, [*[f"segment_index div 10 = {t}" for t in range(6)], "segment_index = 900"], expire_ms=None), "steady")
    written = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
    total = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert len(written) == 7 and written[3] == written[4] == written[5]  # the context has been full since the third
    assert total[5] > total[1] and total[6] == 0


def test_a_silent_session_expires(spark, tmp_path):
    import time

    df = spark.createDataFrame([(1, 0, 1.0, "invoice 12345 is due"), (1, 1, 5.0, "invoice 12345 is due")], SAID)
    source = put(tmp_path, df, ["segment_index = 0"], "silent")
    stream = spark.readStream.schema(df.schema).json(source)
    query = sessions.stream_live_sessions(stream, expire_ms=3000).writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until = time.time() + 100
        while time.time() < until and not spark.table("silent").count():
            time.sleep(1)
        put(tmp_path, df, ["segment_index = 1"], "later")
        import os
        import shutil

        for f in (tmp_path / "later").glob("*.json"):
            shutil.copy(f, tmp_path / "silent/second.json")
        while time.time() < until and spark.table("silent").count() < 2:
            time.sleep(1)
    finally:
        query.stop()
    # What was unchecked went out with the expiry; what came after it met no memory of it.
    assert [(r.batch, r.texts, r.n_repeats) for r in spark.table("silent").collect()] == [(0, ["invoice 12345 is due"], 0)] * 2
    assert os.path.exists(tmp_path / "silent/second.json")


def test_flush(spark, tmp_path):
    rows = read(spark, D, "segments")
    rows.unionByName(rows.limit(5)).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).json(str(tmp_path / "in"))
    sessions_folder = str(tmp_path / "out")
    files.flush_segments(stream, sessions_folder).awaitTermination()
    assert spark.read.parquet(f"{sessions_folder}/segments").count() == rows.count()


def test_totals_end_behind_the_gap(spark, tmp_path):
    said = [(1, 1, "2024-01-01 10:00:00"), (1, 2, "2024-01-01 10:05:00"), (2, 1, "2024-01-01 10:06:00"), (1, 1, "2024-01-01 10:20:00"), (3, 5, "2024-01-01 20:00:00"), (3, 5, "2024-01-01 20:01:00")]
    df = spark.createDataFrame(said, "session_id long, speaker int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    source = put(tmp_path, df, ["ts < '2024-01-01 10:10'", "ts between '2024-01-01 10:10' and '2024-01-01 12:00'", "ts = '2024-01-01 20:00'", "ts = '2024-01-01 20:01'"])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(source)
    query = sessions.session_totals(stream, gap_s=3600).writeStream.format("memory").queryName("totals").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    got = [(r.session_id, r.segment_count, r.speaker_count, str(r.first_heard)[11:16], str(r.last_heard)[11:16], r.ended) for r in spark.table("totals").collect()]
    assert [g for g in got if g[0] == 1] == [(1, 2, 2, "10:00", "10:05", False), (1, 3, 2, "10:00", "10:20", False), (1, 3, 2, "10:00", "10:20", True)]
    assert sorted(g for g in got if g[0] == 2) == [(2, 1, 1, "10:06", "10:06", False), (2, 1, 1, "10:06", "10:06", True)]
    assert [g[1] for g in got if g[0] == 3 and not g[5]] == [1, 2]
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(rows) > rows[-1]  # two of three sessions have left


def test_encode_decode(spark):
    df = spark.createDataFrame([("file.deleted", "1", "2", "u", "2024-01-01 00:00:00")], "event_type string, doc_id string, vault_id string, deleted_by string, timestamp string")
    back = E.decode(E.encode(df, df.columns)).first()
    assert not back.malformed and back.doc_id == "1" and back.key == "2"
