"""The idempotent stream over two runs with a restart, late and replayed rows, against a fold in the order of arrival."""

from __future__ import annotations

import datetime

from tessera.streaming import events, idempotency

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2026, 1, 1)


def folded(batches):
    """(request, disposition, answered_by) by a fold over batches, each in the order of its times."""
    held, out = {}, []
    for batch in batches:
        for scope, key, request, digest, ts in sorted(batch, key=lambda r: (r[4], r[2])):
            k = (key or "").strip(" ")
            if not 16 <= len(k) <= 128:
                out.append((request, "refused", None))
                continue
            now = held.get((scope, k))
            if now is None or now[2] <= ts:
                held[scope, k] = now = (digest, request, ts + DAY)
                out.append((request, "stored", request))
            elif now[0] == digest:
                out.append((request, "replayed", now[1]))
            else:
                out.append((request, "conflict", None))
    return sorted(out)


def test_replay_over_two_runs(spark, tmp_path):
    key = "0123456789abcdef"
    at = lambda hours: START + datetime.timedelta(hours=hours)
    first = [("u", key, 1, "a", at(0)), ("u", key, 2, "a", at(1)), ("u", key, 3, "b", at(2)), ("v", key, 4, "b", at(2)), ("u", "short", 5, "a", at(3)), ("u", None, 6, "a", at(3)), ("u", f"  {key} ", 7, "a", at(23)), ("u", key + "x", 8, "a", at(5))]
    second = [("u", key, 9, "a", at(20)), ("u", key, 10, "b", at(24)), ("u", key, 11, "a", at(30)), ("u", key, 12, "b", at(47)), ("v", key, 13, "b", at(25)), ("u", "k" * 129, 14, "a", at(26))]
    third = [("u", key, 15, "b", at(90)), ("u", key + "x", 16, "c", at(91)), ("u", key, 17, "b", at(92))]
    schema = "scope string, key string, request long, hash string, ts timestamp"
    src, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for batch in (first, second, third):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        got = idempotency.run_into(spark, idempotency.respond(spark, events.source(spark, src), "2 days"), out, checkpoint)
    assert sorted((r.request, r.disposition, r.answered_by) for r in got.collect()) == folded([first, second, third])
    again = idempotency.run_into(spark, idempotency.respond(spark, events.source(spark, src), "2 days"), out, checkpoint)
    assert again.count() == len(first + second + third)  # nothing is answered twice
