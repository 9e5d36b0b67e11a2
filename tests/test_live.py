import json
import time

import pytest

from visionloom.streaming import live


def run(frame, out, ck, **trigger):
    q = frame.writeStream.outputMode("update").foreachBatch(lambda df, _: df.write.mode("append").parquet(str(out))).option("checkpointLocation", str(ck))
    return q.trigger(**trigger).start()


@pytest.fixture
def ends(spark):
    """Queries with timers would go on for the timers' sake; without batches of no data they end with their input."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def write(folder, name, rows):
    (folder / f".{name}").write_text("\n".join(json.dumps(r) for r in rows))
    (folder / f".{name}").rename(folder / name)


def test_a_bounded_tail_goes_on_after_a_restart(spark, ends, tmp_path):
    src, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()

    def go(most_bytes=1 << 20):
        rows = spark.readStream.schema("run_id long, arrival long, pos int, line string").json(str(src))
        q = run(live.bounded_tail(rows, 5, most_bytes), out, ck, availableNow=True)
        assert q.awaitTermination(150)

    lines = [{"run_id": i % 2, "arrival": i // 4, "pos": i % 4, "line": f"line {i}"} for i in range(40)]
    write(src, "a.json", lines[:24][::-1])  # in any order within a batch
    go()
    write(src, "b.json", lines[24:30])
    write(src, "c.json", [{"run_id": 7, "arrival": 0, "pos": 0, "line": "x" * 3000}])
    go()  # a new query from the same checkpoint
    rows = spark.read.parquet(str(out)).collect()
    last = {r["run_id"]: r for r in sorted(rows, key=lambda r: r["next"])}
    for run_id in (0, 1):
        mine = [x["line"] for x in lines[:30] if x["run_id"] == run_id]
        assert last[run_id]["next"] == 15 and last[run_id]["first"] == 10 and last[run_id]["lines"] == mine[-5:]
    assert last[7]["lines"] == ["x" * 3000] and not any(r["closed"] for r in rows)
    write(src, "d.json", [{"run_id": 0, "arrival": 99, "pos": k, "line": str(k) * 40} for k in range(4)])
    go(most_bytes=100)  # two lines of 40 bytes fit
    newest = max((r for r in spark.read.parquet(str(out)).collect() if r["run_id"] == 0), key=lambda r: r["next"])
    assert newest["lines"] == ["2" * 40, "3" * 40] and newest["next"] == 19 and newest["first"] == 17


def test_an_idle_run_is_closed(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    write(src, "a.json", [{"run_id": 1, "arrival": 0, "pos": 0, "line": "end"}])
    rows = spark.readStream.schema("run_id long, arrival long, pos int, line string").json(str(src))
    q = run(live.bounded_tail(rows, 5, idle_ms=500), out, tmp_path / "ck", processingTime="300 milliseconds")
    try:
        until = time.time() + 120
        while time.time() < until and not (out.exists() and spark.read.schema("closed boolean").parquet(str(out)).where("closed").count()):
            time.sleep(1)
    finally:
        q.stop()
    assert sorted((r["next"], r["closed"], tuple(r["lines"])) for r in spark.read.parquet(str(out)).collect()) == [(1, False, ("end",)), (1, True, ("end",))]


def test_the_newest_frame_wins_while_a_session_is_busy(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    order = {"a": [3, 1, 2, 7, 5, 9], "b": [1], "c": [4, 4, 4]}
    write(src, "1.json", [{"session": s, "frame_id": i, "payload": f"{s}{i}"} for s, ids in order.items() for i in ids])
    frames = spark.readStream.schema("session string, frame_id long, payload string").option("maxFilesPerTrigger", 1).json(str(src))
    q = run(live.latest_wins(frames, 1500), out, tmp_path / "ck", processingTime="200 milliseconds")
    try:
        until = time.time() + 120
        seen = lambda: {(r["session"], r["frame_id"]): r for r in spark.read.schema("session string, frame_id long, payload string, received long, dropped long").parquet(str(out)).collect()} if out.exists() else {}
        while time.time() < until and len(seen()) < 3:
            time.sleep(0.3)
        write(src, "2.json", [{"session": "a", "frame_id": i, "payload": f"a{i}"} for i in (8, 12, 11, 15)])
        while time.time() < until and ("a", 15) not in seen():
            time.sleep(0.3)
    finally:
        q.stop()
    got = seen()
    assert {k: r["payload"] for k, r in got.items()} == {("a", 9): "a9", ("b", 1): "b1", ("c", 4): "c4", ("a", 15): "a15"}

    def plain(ids):  # the same, one frame after another, with all of them there when the session is free
        newest, dropped, waits = -1, 0, False
        for i in ids:
            if i <= newest:
                dropped += 1
            else:
                dropped += waits
                newest, waits = i, True
        return dropped

    for s in order:
        first = got[s, max(order[s])]
        assert (first["received"], first["dropped"]) == (len(order[s]), plain(order[s]))
    assert (got["a", 15]["received"], got["a", 15]["dropped"]) == (10, 8)  # two of ten were taken
