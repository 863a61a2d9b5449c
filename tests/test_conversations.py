import random
import re

import pytest
from pyspark.sql import functions as F

from lexiframe.operators import conversations as c
from lexiframe.operators.running import levels_for, running_sums
from lexiframe.streaming.conversations import keep_rolling_context, stream_rolling_context

WORDS = [f"w{i}" for i in range(30)]
IDS = {w: i + 4 for i, w in enumerate(WORDS)}


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([(i, w) for w, i in IDS.items()], "id int, token string").cache()


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def loop(rows, length, eos_roles=()):
    out, state = {}, {}
    for conv, turn, role, text in sorted(rows):
        session, ids, gone = state.get(conv, (0, [2], False))
        word = text.strip().lower()
        if gone or word in ("exit", "quit", ":q"):
            state[conv] = (session, ids, True)
            continue
        if word == "reset":
            state[conv] = (session + 1, [2], False)
            continue
        if not word:
            continue
        new = [IDS.get(t, 1) for t in re.sub("[^a-z0-9']+", " ", text.lower()).split()]
        ids = ids + new + ([3] if role in eos_roles else [])
        state[conv] = (session, ids, False)
        out[conv, turn] = (session, ids[-length:], len(ids), min(len(ids), length), len(ids) > length)
    return out


def got(df):
    return {
        (r.conv_id, r.turn): (r.session_id, r.ctx, r.total_tokens, r.effective_context, r.truncated) for r in df.collect()
    }


@pytest.fixture(scope="module")
def chat(spark):
    """One conversation holds most turns; resets, exits, blank and wordless turns occur."""
    rng = random.Random(11)
    rows = []
    for conv, n in ((0, 400), (1, 40), (2, 1), (3, 25), (4, 30)):
        for turn in range(n):
            draw = rng.random()
            if draw < 0.04:
                text = rng.choice(["reset", " Reset ", "RESET"])
            elif draw < 0.10:
                text = rng.choice(["", "  ", "...", "日本"])
            elif conv == 3 and turn == 17:
                text = " Quit "
            else:
                text = " ".join(rng.choice([*WORDS, "other"]) for _ in range(rng.choice([0, 1, 2, 3, 9, 20]))) or "?"
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("length,block", [(4, 1 << 16), (8, 9), (1, 20)])
def test_rolling_context_equals_loop(spark, vocab, chat, length, block):
    df = c.rolling_context(frame(spark, chat), vocab, length, eos_roles=("assistant",), block=block)
    assert got(df) == loop(chat, length, ("assistant",))


def test_stats_are_those_of_the_contexts(spark, vocab, chat):
    stats = c.conversation_stats(frame(spark, chat), vocab, 8, block=7).collect()
    expected = loop(chat, 8)
    assert {(r.conv_id, r.turn): (r.session_id, r.total_tokens, r.effective_context, r.truncated) for r in stats} == {
        k: (s, total, eff, cut) for k, (s, _, total, eff, cut) in expected.items()
    }
    assert all(r.context_window == 8 for r in stats)


def test_hand_made_conversation(spark, vocab):
    rows = [
        (0, 0, "user", "w0 w1"), (0, 1, "user", "  "), (0, 2, "user", "w2 w3 w4"), (0, 3, "user", "reset"), (0, 4, "user", "w5"),
    ]
    out = {k[1]: v for k, v in got(c.rolling_context(frame(spark, rows), vocab, 4)).items()}
    assert {t: (v[0], v[2], v[3], v[4]) for t, v in out.items()} == {
        0: (0, 3, 3, False), 2: (0, 6, 4, True), 4: (1, 2, 2, False),
    }
    assert out[4][1] == [2, 9]


def test_own_predicates(spark, vocab):
    rows = [(0, 0, "system", "w0"), (0, 1, "user", "w1"), (0, 2, "system", "w2"), (0, 3, "user", "w3"), (0, 4, "user", "end")]
    df = c.rolling_context(
        frame(spark, rows), vocab, 4, is_reset=F.col("role") == "system", is_exit=F.col("text") == "end"
    )
    assert {k[1]: v[:2] for k, v in got(df).items()} == {1: (1, [2, 5]), 3: (2, [2, 7])}


@pytest.mark.parametrize("block", [3, 10, 1000])
def test_running_sums(spark, block):
    df = spark.createDataFrame([(g, i * 3, i % 4) for g in (0, 1) for i in range(50)], "g int, o long, v long")
    out = running_sums(df, ["g"], "o", {"s": "v"}, block).collect()
    for r in out:
        assert r.s == sum(i % 4 for i in range(r.o // 3 + 1))
    assert (levels_for(df, "o", 1000), levels_for(df, "o", 20)) == (0, 1)
    assert levels_for(df.limit(0), "o") == 0


def test_stream_equals_batch_over_restarts(spark, vocab, chat, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = frame(spark, chat)
    for low, high in ((0, 1), (1, 20), (20, 1000)):
        part = rows.where((F.col("turn") >= low) & (F.col("turn") < high))
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        stream_rolling_context(stream, vocab, 8, out, eos_roles=("assistant",), block=20).awaitTermination()
    read = spark.read.parquet(f"{out}/contexts")
    assert read.count() == len(got(read))
    assert got(read) == loop(chat, 8, ("assistant",))


def test_stream_state_snapshots(spark, vocab, tmp_path, monkeypatch):
    """State read back from a snapshot and the changes after it."""
    from lexiframe.streaming import conversations as sc

    monkeypatch.setattr(sc, "SNAPSHOT_EVERY", 2)
    rows = [(conv, t, "user", f"w{(t + conv) % 30} w{t}") for conv in range(3) for t in range(5) if (conv, t) != (2, 3)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = frame(spark, rows)
    for turn in range(5):
        df.where(F.col("turn") == turn).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        stream_rolling_context(stream, vocab, 4, out).awaitTermination()
    assert got(spark.read.parquet(f"{out}/contexts")) == loop(rows, 4)


def test_state_store_equals_the_batch_after_a_restart(spark, tmp_path):
    """Many small batches, restarted half way; old versions of the state do not pile up."""
    rng = random.Random(6)
    rows = []
    for conv in range(4):
        for turn in range(24):
            text = rng.choice(["a frog hopped", "quiet", "", "reset", "one log under", "unknown words here"])
            rows.append((conv, turn, rng.choice(["user", "assistant"]), "exit" if (conv, turn) == (3, 15) else text))
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    words = ["<PAD>", "<UNK>", "<BOS>", "<EOS>", "a", "frog", "hopped", "quiet", "one", "log", "under"]
    vocab = spark.createDataFrame(list(enumerate(words)), "id int, token string")
    expected = c.rolling_context(turns, vocab, 6, eos_roles=("assistant",))
    source, out = str(tmp_path / "turns"), str(tmp_path / "out")
    settings = {
        "spark.sql.shuffle.partitions": "2", "spark.sql.streaming.minBatchesToRetain": "2",
        "spark.sql.streaming.stateStore.maintenanceInterval": "100ms",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for half in (range(12), range(12, 24)):
            for turn in half:
                turns.where(f"turn = {turn}").coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(source)
            keep_rolling_context(stream, vocab, 6, out, eos_roles=("assistant",)).awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.parquet(f"{out}/contexts")
    columns = ["conv_id", "session_id", "turn", "role", "ctx", "total_tokens", "effective_context", "truncated"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, expected.select(columns).collect()))
    versions = list((tmp_path / "out" / "checkpoint" / "state").rglob("*.delta"))
    assert 0 < len(versions) < 2 * 24
