"""The reference's example client, on this engine.

A channel with the two example topics (every record per short window, and a
grouped count per longer window) runs over a replayed event stream; two
subscribers print what they receive, one unsubscribes, then the channel is
stopped. Run: python examples/channel_example.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from slidecast.plans.delivery import console_listener, subscribe_stream  # noqa: E402
from slidecast.plans.spec import ChannelSpec, TopicSpec  # noqa: E402
from slidecast.session import get_spark, scratch_path  # noqa: E402
from slidecast.sources.replay import replay_stream, stage_replay  # noqa: E402
from slidecast.sources.tables import read_events  # noqa: E402
from slidecast.streaming.channel import Channel, list_channels  # noqa: E402


def main(sf_dir: str = "/root/testdata/sf0.001") -> None:
    spark = get_spark("local[4]", shuffle_partitions=4)
    channel = "tweets_channel"
    spec = ChannelSpec(channel, [
        TopicSpec("all_records", "select * from all_records", 3600, 3600, channel),
        TopicSpec("top_users", "select event_type, count(*) as n from top_users group by event_type order by n",
                  86400, 86400, channel),
    ], batch_interval=5)
    events = read_events(spark, sf_dir)
    source = replay_stream(spark, stage_replay(events, 4), events.schema)
    sink = scratch_path(spark, "example-sink")
    chan = Channel(spark, spec, sink, scratch_path(spark, "example-state"))
    started = chan.start(source, available_now=True)
    print("running channels:", list_channels(spark))
    for q in started:
        q.awaitTermination()
    subs = {t: subscribe_stream(spark, sink, channel, t, console_listener(5), scratch_path(spark, f"sub-{t}"))
            for t in ("all_records", "top_users")}
    for q in subs.values():
        q.processAllAvailable()
    subs["all_records"].stop()          # unsubscribe one handle only
    subs["top_users"].stop()
    chan.stop()
    print("running channels after stop:", list_channels(spark))


if __name__ == "__main__":
    main(*sys.argv[1:])
