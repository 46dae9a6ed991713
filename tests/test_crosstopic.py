"""Cross-topic SQL and the as-of lookup."""

import datetime as dt
import random

from slidecast.operators.asof import asof_latest
from slidecast.plans.broker import run_channel
from slidecast.plans.spec import ChannelSpec, TopicSpec
from conftest import at, secs


def test_earlier_topic_is_seen_at_or_before(spark, events_of):
    # A at 1 (window ends 5); B at 1 and 6 (ends 5, 10). B reads A.
    ev = events_of([(1, 1, "a", 1.0), (1, 2, "b", 1.0), (6, 3, "b", 1.0)])
    ch = ChannelSpec("c", [
        TopicSpec("ta", "select count(*) as n from ta where event_type = 'a'", 5, 5, "c"),
        TopicSpec("tb", "select count(*) as n_b, (select count(*) from ta) as n_a_rows from tb", 5, 5, "c"),
    ])
    res = run_channel(ev, ch)["tb"]
    # a scalar subquery reads another table: the loop lane handles it
    got = {secs(r.window_end): (r.n_b, r.n_a_rows) for r in res.collect()}
    assert got == {5: (2, 2), 10: (1, 1)}


def test_later_topic_is_seen_strictly_before(spark, events_of):
    ev = events_of([(1, 1, "a", 1.0), (6, 2, "b", 1.0)])
    ch = ChannelSpec("c", [
        TopicSpec("tb", "select b.user_id, (select count(*) from ta) as other_n from tb b", 5, 5, "c"),
        TopicSpec("ta", "select * from ta", 5, 5, "c"),
    ])
    got = {(secs(r.window_end), r.user_id, r.other_n) for r in run_channel(ev, ch)["tb"].collect()}
    # at 5, ta (later in order) has not fired yet -> empty; at 10 it sees ta's window ending 5
    assert got == {(5, 1, 0), (10, 2, 1)}


def test_asof_matches_brute_force(spark):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    tgt = sorted({base + dt.timedelta(hours=rnd.randint(0, 24 * 6)) for _ in range(40)})
    cand = sorted({base + dt.timedelta(hours=rnd.randint(0, 24 * 6)) for _ in range(15)})
    tdf = spark.createDataFrame([(t,) for t in tgt], "e TIMESTAMP_NTZ")
    cdf = spark.createDataFrame([(c,) for c in cand], "e TIMESTAMP_NTZ")
    for inclusive in (True, False):
        got = {r.e: r.seen for r in asof_latest(tdf, "e", cdf, "e", "seen", inclusive).collect()}
        want = {t: max([c for c in cand if (c <= t if inclusive else c < t)], default=None) for t in tgt}
        assert got == want
    assert at(0) == dt.datetime(1970, 1, 1)
