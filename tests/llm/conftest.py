import os

import pytest

SMALL = "/root/testdata/sf0.001"
# Workers import the package by name.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))),
     os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return SMALL


@pytest.fixture
def docs(spark):
    """Documents (doc_id, text) from texts or (id, text) pairs."""
    def build(rows):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame(pairs, "doc_id long, text string")
    return build


@pytest.fixture
def awkward(spark):
    """Rows of every awkward kind, with extra columns named like those the operators make."""
    long_text = " ".join(f"word{i % 977}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, "   \n\t"), (4, "One line\nTwo lines\n"), (4, "One line\nTwo lines\n"),
            (None, "no id at all"), (None, None), (7, long_text), (8, "a b"), (9, "<|im_end|> \\ <| é É")]
    names = "doc_id long, text string, row string, Words string, lines int, failures int, ids string, shard int"
    return spark.createDataFrame([(i, t, "r", "w", 5, 6, "i", 3) for i, t in rows], names)
