"""Quality rules: measurements against a plain version, policies and ablations by bits."""

import re

import pytest

from tillcast.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    again = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(again))


TEXTS = [None, "", "one", "a b c a b c a b c", "a b c d a b c", "x\nx\n x\n\n\n", "# $ | <tag> 50%",
         "a a a a", "é É b c", "a\x1cb a\x85b", "\t\x0b\x0c\r\n"]


def test_measurements(docs):
    rows = quality.ledger(docs(TEXTS)).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
           for r in rows}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_policies_differ_only_in_their_mask(docs):
    good = " ".join(f"word{i}" for i in range(60))
    loud = " ".join(f"LOUD{i}!!" for i in range(60))
    rows = {r.doc_id: r.failures for r in quality.ledger(docs([good, loud, "short"])).collect()}
    assert rows[0] == 0 and rows[1] & quality.BIT["shouting"] and rows[2] & quality.BIT["few_words"]
    assert {r.doc_id for r in quality.keep(docs([good, loud, "short"]), version=1).collect()} == {0, 1}
    assert {r.doc_id for r in quality.keep(docs([good, loud, "short"]), version=2).collect()} == {0}


def test_ablation(spark):
    bits = quality.BIT
    rows = spark.createDataFrame([(0,), (bits["few_words"],), (bits["few_words"] | bits["symbols"],),
                                  (bits["shouting"],)], "failures long")
    got = {r.rule: (r.n_rejected, r.n_only_by_this, r.n_kept, r.n_kept_without)
           for r in quality.ablation(rows).collect()}
    assert got["few_words"] == (2, 1, 1, 2) and got["symbols"] == (1, 0, 1, 1)
    assert got["shouting"] == (1, 1, 1, 2) and len(got) == len(quality.RULES)


def test_awkward_rows_and_columns(awkward):
    rows = quality.ledger(awkward)
    assert rows.columns[:len(awkward.columns)] == awkward.columns and rows.count() == 10
    assert quality.keep(awkward).columns == awkward.columns
    assert quality.keep(awkward.limit(0)).count() == 0


def test_clean_documents_stay(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.ledger(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id")
    base = quality.mask(quality.BASE)
    good = rows.where(f"quality = 1 AND failures & {base} = 0")
    bad = rows.where("quality = 0")
    assert good.where(quality.verdict(good.failures, 2)).count() == good.count() > 100
    assert bad.where(quality.verdict(bad.failures, 2)).count() < 0.1 * bad.count()


def test_policies_read_the_stored_ledger(spark, awkward, monkeypatch):
    rows = quality.stored(awkward)
    assert "text" not in rows.columns and rows.count() == awkward.count()
    assert {r.rules for r in rows.collect()} == {quality.RULES_VERSION}
    plan = rows.where(quality.verdict(rows.failures, 2, rows.rules))._jdf.queryExecution().toString()
    assert "quality_ledger" in plan and "regexp" not in plan
    monkeypatch.setattr(quality, "RULES_VERSION", 99)
    with pytest.raises(Exception, match="other rules"):
        rows.select(quality.verdict(rows.failures, 2, rows.rules)).collect()
    assert quality.keep(awkward).columns == awkward.columns
