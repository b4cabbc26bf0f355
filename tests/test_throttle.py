import datetime as dt
import random

from lectern.streaming.throttle import throttle

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key string, at timestamp, value string, opened int, cell int"


def plain(calls, gap):
    """One call after another."""
    out, now = [], {}
    for k, at, v in sorted((c for c in calls if c[1] is not None), key=lambda c: (c[1], c[2] or "")):
        span = now.get(k)
        if span is None or at >= span[1] + gap:
            span = now[k] = [k, at, at + gap, 0, None]
            out.append(span)
        span[3] += 1
        span[4] = v
    return sorted(map(str, map(tuple, out)))


def found(spark, calls, ms):
    rows = throttle(spark.createDataFrame([(*c, 1, 2) for c in calls], SCHEMA), "key", "at", "value", ms)
    return sorted(str(tuple(r)) for r in rows.collect())


def test_against_one_call_after_another(spark):
    rnd = random.Random(9)
    ms = lambda x: T0 + dt.timedelta(milliseconds=x)
    calls = [(k, ms(rnd.randint(0, 6000)), f"v{i:04}") for i in range(500) for k in ("a", rnd.choice("bc"))]
    calls += [("d", ms(80 * i), "at the very end") for i in range(40)] + [("e", ms(79 * i), f"{i}") for i in range(40)] + [("f", ms(500_000 * i), "far") for i in range(3)]
    calls += [(None, ms(5), "of no key"), (None, ms(6), "too"), ("g", None, "of no time"), ("h", ms(-500), "before"), ("h", ms(-430), "then"), ("h", ms(-415), "z")]
    calls += calls[:50]
    assert found(spark, calls, 80) == plain(calls, dt.timedelta(milliseconds=80))
    assert found(spark, [], 80) == []
