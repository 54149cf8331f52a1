import datetime as dt

from gleaner.streaming import events


def test_counts_resume_and_drop_repeats(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    day = dt.datetime(2026, 1, 1)
    at = lambda i, h, v=1.0: (i, day + dt.timedelta(hours=h), "click", v)

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")

    def run():
        s = events.windowed_counts(events.read_log(spark, f"{tmp_path}/log", schema))
        events.run_to_end(s, f"{tmp_path}/out", f"{tmp_path}/state")
        return {r["start"].hour: (r["events"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r["start"].day == 1}

    arrive([at(1, 0), at(2, 0.5), at(2, 0.5), at(3, 1, 5.0)])
    run()
    arrive([at(4, 0.7), at(5, 10)])
    assert run() == {0: (3, 3.0), 1: (1, 5.0)}
    arrive([at(6, 0.1)])  # far too late
    assert run()[0] == (3, 3.0)


def test_a_replayed_and_a_cut_log_give_one_result_per_request(spark, tmp_path):
    import json
    import random
    import shutil

    from pyspark.sql import functions as F

    from gleaner.streaming import scoring_log as sl

    draw, log = random.Random(3), tmp_path / "log"
    log.mkdir()
    events = [{"request_id": f"r{draw.randrange(40)}", "seq": draw.randrange(6), "status": draw.choice(["pass", "fail", "error"]), "result": f"x{draw.randrange(3)}"} for _ in range(300)]
    lines = [json.dumps(e) for e in events]
    want: dict = {}
    for e in events:
        mine = (e["seq"], e["status"], e["result"])
        want[e["request_id"]] = max(want.get(e["request_id"], mine), mine)
    got = lambda: {r["request_id"]: (r["seq"], r["status"], r["result"]) for r in sl.results(spark, f"{tmp_path}/out").collect()}
    go = lambda: sl.follow(spark, str(log), f"{tmp_path}/out", f"{tmp_path}/state", 1)

    (log / "a").write_text("\n".join(lines[:120]) + "\n" + lines[120][:25])  # the run died in a line
    go()
    shutil.copytree(tmp_path / "state", tmp_path / "before")
    (log / "b").write_text("\n".join(lines[100:220]) + "\n\nnull\n{}\n")  # it begins again a little earlier
    (log / "c").write_text("\n".join(draw.sample(lines, 300)) + "\n")
    go()
    assert got() == want
    # A crash before the commit: the stream's state is that of before, and the same batches are written again.
    shutil.rmtree(tmp_path / "state")
    shutil.move(tmp_path / "before", tmp_path / "state")
    go()
    assert got() == want and sl.results(spark, f"{tmp_path}/out").count() == len(want)
    parsed = sl.parse(spark.read.text(str(log)))
    assert {(r["request_id"], r["seq"], r["status"], r["result"]) for r in sl.latest(parsed).collect()} == {(k, *v) for k, v in want.items()}
    assert [r["line"] for r in parsed.where("line <> '' AND line NOT IN ('null', '{}')").collect()] == [lines[120][:25]]
    planned = spark.createDataFrame([(f"r{k}",) for k in range(45)], "request_id string")
    assert {r["request_id"] for r in sl.open_requests(planned, parsed).collect()} == {f"r{k}" for k in range(45)} - {k for k, v in want.items() if v[1] != "error"}
