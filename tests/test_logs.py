"""Log folders read as watched lines."""

from datetime import datetime

from inkstrata.sources import logs
from inkstrata.streaming import jobs


def line(stamp, running, waiting):
    return f"INFO {stamp} [loggers.py:1] Engine 000: Avg prompt throughput: 1.0 tokens/s, Avg generation throughput: 12.5 tokens/s, Running: {running} reqs, Waiting: {waiting} reqs, GPU KV cache usage: 1%"


def folder(tmp_path, **texts):
    for job, (server, worker) in texts.items():
        (tmp_path / job).mkdir()
        if server is not None:
            (tmp_path / job / "server.log").write_text("\n".join(server))
        (tmp_path / job / "worker.log").write_text(worker)
    return str(tmp_path)


def test_jobs_that_hang_are_found_in_their_logs(spark, tmp_path):
    path = folder(
        tmp_path,
        hung=([line("05-01 10:00:00", 0, 0), "INFO: Application startup complete.", "noise", line("05-01 10:05:00", 2, 1), "INFO 05-0"], "x\nserver READY\n"),
        busy=([line("05-01 10:29:30", 2, 1)], "READY"),
        idle=([line("05-01 10:00:00", 3, 0), line("05-01 10:01:00", 0, 0)], "READY"),
        cold=([line("05-01 10:00:00", 3, 0)], "starting"),
        again=([line("05-01 10:00:00", 3, 0), "INFO: Application startup complete."], "READY"),
        torn=(["INFO 99-99 10:00:00 Avg generation throughput: 1 tokens/s, Running: 1 reqs, Waiting: 1 reqs", ""], "READY"),
        none=(None, "READY"),
    )
    got = logs.events(logs.lines(spark, path), 2024)
    rows = sorted((r.job, r.ts, r.kind, r.running, r.waiting, r.rate) for r in got.where("job = 'hung'").collect() if r.kind != "ready")
    assert rows == [("hung", datetime(2024, 5, 1, 10), "load", 0, 0, 12.5), ("hung", datetime(2024, 5, 1, 10, 5), "load", 2, 1, 12.5), ("hung", datetime(2024, 5, 1, 10, 5), "start", None, None, None)]
    assert {r.job for r in got.collect()} == {"hung", "busy", "idle", "cold", "again"}
    assert [(r.job, r.work) for r in jobs.stale(got, datetime(2024, 5, 1, 10, 30)).collect()] == [("hung", 3)]


def test_an_empty_folder(spark, tmp_path):
    path = folder(tmp_path, a=([""], ""))
    assert logs.events(logs.lines(spark, path), 2024).count() == 0
