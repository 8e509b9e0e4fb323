"""Streams with keyed state over several batches, against plain Python."""

import random

import pytest

from tidewater.streaming import state
from tidewater.streaming import windows as streams


@pytest.fixture
def feed(spark, tmp_path):
    """Writes batches as files and gives them as a stream of one file a batch, oldest first."""

    def made(batches, schema):
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n:03d}")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")

    return made


def test_upserts_by_url(feed):
    batches = [
        [("a", 5, "x"), ("b", 1, "y"), ("a", 7, "z"), (None, 1, "x"), ("c", None, "x"), ("c", 1, None)],
        [("a", 6, "old"), ("a", 7, "z"), ("b", 2, "y"), ("b", 3, "w")],
        [("a", 9, "z"), ("c", 4, "new")],
    ]
    got = streams.replay(state.url_upserts(feed(batches, "url string, at long, content string")), "append", "upserts").collect()
    assert sorted(map(tuple, got)) == sorted([
        ("a", 5, "x", "insert", 1), ("a", 7, "z", "update", 2), ("b", 1, "y", "insert", 1), ("a", 6, "old", "late", 2), ("a", 7, "z", "same", 2), ("b", 2, "y", "same", 1),
        ("b", 3, "w", "update", 2), ("a", 9, "z", "same", 2), ("c", 4, "new", "insert", 1),
    ])


def plain(commands, lease, tries):
    out, shards = [], {}
    for shard, _, at, action, item, priority, due, worker in sorted(commands, key=lambda c: (c[2], c[1])):
        held = shards.setdefault(shard, {})
        for k in sorted(k for k, x in held.items() if x["worker"] is not None and x["until"] <= at):
            x = held[k]
            out.append((shard, k, "dead" if x["tries"] >= tries else "expired", x["worker"], x["tries"], at, x["until"]))
            x["worker"] = None
            if x["tries"] >= tries:
                del held[k]
        if action == "add":
            held.setdefault(item, {"priority": priority, "due": due, "tries": 0, "worker": None, "until": None})
        if action == "claim":
            ready = sorted((x["priority"], x["due"], k) for k, x in held.items() if x["worker"] is None and x["due"] <= at)
            if ready:
                x = held[ready[0][2]]
                x.update(tries=x["tries"] + 1, worker=worker, until=at + lease)
                out.append((shard, ready[0][2], "leased", worker, x["tries"], at, x["until"]))
        if action == "done" and item in held and held[item]["worker"] == worker:
            x = held.pop(item)
            out.append((shard, item, "done", worker, x["tries"], at, x["until"]))
    return sorted(out)


def test_work_queue(feed):
    rng = random.Random(6)
    commands, at = [], 0
    for seq in range(400):
        at += rng.randint(0, 3)
        action = rng.choice(["add", "add", "claim", "claim", "done", "other"])
        commands.append((rng.randint(0, 2), seq, at, action, rng.randint(0, 25), rng.randint(1, 3), at + rng.randint(-5, 15), rng.randint(1, 4)))
    batches = [commands[i : i + 80] for i in range(0, 400, 80)]
    stream = feed(batches, "shard long, seq long, at long, action string, item long, priority long, due long, worker long")
    got = streams.replay(state.work_queue(stream, lease=12, tries=2), "append", "queue").collect()
    wanted = plain(commands, 12, 2)
    assert sorted(map(tuple, got)) == wanted and {w[2] for w in wanted} == {"leased", "expired", "dead", "done"}


def test_queue_query_against_plain_commands(spark, sf_dir):
    import pyarrow.parquet as pq

    from tidewater.plans import flows

    kinds = {"view": "add", "click": "claim"}
    commands = []
    for r in pq.read_table(f"{sf_dir}/events.parquet").to_pylist():
        at, i = int(r["ts"].replace(tzinfo=__import__("datetime").timezone.utc).timestamp() // 1), r["event_id"]
        commands.append((r["user_id"] % 16, i, at, kinds.get(r["event_type"], "done"), i % 50, i % 3, at + i % 600, i % 4))
    got = flows.stream_work_queue(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == plain(commands, 6 * 3600, 3) and len(got) > 100
