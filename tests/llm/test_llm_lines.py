"""Line dedup against a plain version."""

from collections import Counter

from tillcast.llm import lines

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(texts, min_docs, min_chars=1):
    split = [(t or "").split("\n") for t in texts]
    key = lambda x: x.strip(BLANKS).translate(LOWER)
    n = Counter(k for t in split for k in {key(x) for x in t})
    gone = {k for k, c in n.items() if c >= min_docs and len(k) >= min_chars}
    return [(len(t), sum(key(x) in gone for x in t), "\n".join(x for x in t if key(x) not in gone))
            for t in split]


def result(frame):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in frame.collect()}


TEXTS = [f"own {i}\n  SHARED line\t\nrare\n" + "common\n" * (i % 4) for i in range(12)] + [
    None, "", "shared LINE", "É common", "\x85shared line", "common\r", "\n\n\n", "shared line"]


def test_frequent_lines_go(docs):
    for batches, fanout in ((1, 2), (4, 2), (5, 3)):
        got = result(lines.drop_frequent_lines(docs(TEXTS), min_docs=3, batches=batches, fanout=fanout))
        assert got == dict(enumerate(plain(TEXTS, 3)))


def test_short_keys_stay(docs):
    got = result(lines.drop_frequent_lines(docs(TEXTS), min_docs=3, min_chars=7, batches=2))
    assert got == dict(enumerate(plain(TEXTS, 3, 7)))


def test_awkward_rows_and_columns(awkward):
    got = lines.drop_frequent_lines(awkward, min_docs=2, batches=2)
    assert got.columns == [*awkward.columns, "n_lines", "n_dropped"]
    rows = got.collect()
    assert len(rows) == 10
    # Equal rows count twice and both lose their lines; a null text stays null.
    assert [r.text for r in rows if r.doc_id == 4] == ["", ""]
    assert [r.text for r in rows if r.doc_id == 1] == [None]
    assert {(r.lines, r.row) for r in rows} == {(5, "r")}
    assert lines.drop_frequent_lines(awkward.limit(0)).count() == 0


def test_old_runs_are_not_shuffled(spark, docs):
    table = lines.line_table(docs(TEXTS), "doc_id", "text", 1, 1)
    runs = lines.LineRuns(spark, 3, fanout=1)
    runs.buckets = 4
    run = runs._write(table.groupBy("h1", "h2").count())
    plan = table.where("first").groupBy("h1", "h2").count().hint("merge").join(
        run.hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan"):]
    assert "SortMergeJoin" in physical and physical.count("Exchange hashpartitioning") == 1
