"""Reply trees against a plain walk, and the round trip of the format."""

import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillcast.llm import chat

SCHEMA = ("tree struct<none:boolean,id:long>, node long, parent long, role string, text string, "
          "score double")


@pytest.fixture
def tree(spark):
    def build(rows):
        return spark.createDataFrame(
            [((False, t), n, p, r, x, s) for t, n, p, r, x, s in rows], SCHEMA)
    return build


def forest(seed, trees=4, size=40):
    rng = random.Random(seed)
    rows = []
    for t in range(trees):
        for n in range(rng.randrange(1, size)):
            parent = rng.randrange(max(0, n - 3), n) if n else None
            rows.append((t, n, parent, rng.choice(["user", "assistant"]), f"t{t}n{n}", rng.random()))
    return rows


def plain_paths(rows):
    """(tree, leaf) -> nodes from the root."""
    parent = {(t, n): p for t, n, p, *_ in rows}
    inner = {(t, p) for t, _, p, *_ in rows if p is not None}
    out = {}
    for t, n in parent:
        if (t, n) not in inner:
            path, at = [], n
            while at is not None:
                path.append(at)
                at = parent[t, at]
            out[t, n] = path[::-1]
    return out


def test_paths_of_bushy_and_deep_trees(tree):
    rows = forest(1) + [(9, n, n - 1 if n else None, "user", str(n), 0.0) for n in range(70)]
    got = {}
    for r in chat.ReplyPaths(tree(rows)).members.collect():
        got.setdefault((r.tree.id, r.leaf), []).append((-r.height, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == plain_paths(rows)


def test_best_branch_of_each_tree(tree):
    rows = forest(2)
    score = {(t, n): s for t, n, _, _, _, s in rows}
    paths = plain_paths(rows)
    best = {}
    for (t, leaf), path in paths.items():
        key = (-sum(score[t, n] for n in path), -len(path), leaf)
        best[t] = min(best.get(t, key), key)
    formatted = chat.ReplyPaths(tree(rows)).format(branches=1).collect()
    assert {r.tree.id: r.leaf for r in formatted} == {t: k[2] for t, k in best.items()}
    text = {(t, n): (r, x) for t, n, _, r, x, _ in rows}
    for r in formatted:
        turns = [text[r.tree.id, n] for n in paths[r.tree.id, r.leaf]]
        assert chat.read_turns(r.formatted) == turns
        assert "".join(r.formatted[s.start:s.start + s.length] for s in r.spans) == "".join(
            x for role, x in turns if role == "assistant")
    assert chat.ReplyPaths(tree(rows)).format(branches=None).count() == len(paths)


def test_cycles_orphans_and_repeats(tree):
    paths = chat.ReplyPaths(tree([
        (1, 1, None, "user", "root", 1.0), (1, 2, 1, "assistant", None, None),
        (1, 5, 6, "user", "in a cycle", 1.0), (1, 6, 5, "user", "in a cycle", 1.0),
        (1, 7, 6, "user", "below it", 1.0), (1, 8, 99, "user", "orphan", 9.0),
        (1, 9, 9, "user", "own parent", 0.5),
        (2, 1, None, "user", "b", 0.0), (2, 1, None, "user", "a", 0.0)]))
    assert {(r.tree.id, r.leaf) for r in paths.format(None).collect()} == {
        (1, 2), (1, 8), (1, 9), (2, 1)}
    assert {r.node for r in paths.unrooted.collect()} == {5, 6, 7}
    assert [chat.read_turns(r.formatted) for r in paths.format(None).collect() if r.tree.id == 2] == [
        [("user", "a"), ("user", "b")]]


def test_two_parents_of_one_message(tree):
    rows = [(1, 1, None, "user", "a", 0.0), (1, 2, None, "user", "b", 9.0),
            (1, 3, 2, "assistant", "c", 1.0), (1, 3, 1, "assistant", "c", 1.0)]
    got = chat.ReplyPaths(tree(rows)).format(None).collect()
    assert sorted([x for _, x in chat.read_turns(r.formatted)] for r in got) == [["a", "c", "c"], ["b"]]


@pytest.mark.parametrize("trunk", [20, 40])
def test_stored_rows_follow_the_messages(tree, monkeypatch, trunk):
    """A trunk with one reply to each message: its paths have a square of members."""
    rows = [(1, n, n - 1 if n else None, "user", "t", 1.0) for n in range(trunk)]
    rows += [(1, trunk + n, n, "assistant", "r", 0.0) for n in range(trunk)]
    stored = []

    def count(frame, label):
        made = snapshot(frame, label)
        stored.append(made.count())
        return made

    snapshot = chat.snapshot
    monkeypatch.setattr(chat, "snapshot", count)
    best = chat.ReplyPaths(tree(rows)).format().collect()
    assert [r.leaf for r in best] == [2 * trunk - 1] and max(stored) == 2 * trunk


@given(st.text(max_size=40))
def test_unescape_undoes_the_escape(text):
    escaped = text.replace("\\", "\\\\").replace("<|", "<\\|")
    assert "<|" not in escaped and chat.unescape(escaped) == text


def test_read_back_of_any_text(spark):
    said = [(1, 0, "sys\nt<|em", "a\\"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nx"),
            (1, 2, None, None), (None, 0, "assistant", "é\U0001f600\\n<"), (2, 0, "user", "")]
    frame = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r for r in chat.digests(
        chat.ReplyPaths(chat.as_tree(frame)).format()).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert rows[1].turns_sha256 == sha("".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in said if c == 1))
    assert rows[1].loss_sha256 == sha(said[1][3]) and rows[1].loss_chars == len(said[1][3])
    assert rows[None].loss_sha256 == sha(said[3][3]) and rows[2].n_turns == 1
    assert rows[2].loss_chars == 0 and len(rows) == 3
    assert chat.ReplyPaths(chat.as_tree(frame.limit(0))).format().count() == 0
    extra = frame.withColumn("tree", F.lit("x")).withColumn("score", F.lit(1))
    assert chat.ReplyPaths(chat.as_tree(extra)).format().count() == 3
