"""Spelling variants against comparing all words with all words."""

import random
import zlib

from tillcast.llm import queries, spelling


def near(a, b):
    """Whether one letter put in, left out or replaced turns a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts):
    out = {}
    for word, n in counts.items():
        others = sorted((-m, o) for o, m in counts.items() if near(word, o))
        form = others[0][1] if others and -others[0][0] >= 5 * n else None
        out[word] = (form, n, len(others), counts.get(form))
    rows = {}
    for word, (form, n, n_near, form_n) in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        rows[word] = (form, root, n, n_near, form_n)
    return rows


def check(spark, counts):
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame).collect()}
    assert got == plain(counts)
    return got


def made(seed, letters, longest, size):
    rng = random.Random(seed)
    words = set()
    while len(words) < size:
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, longest)))
        words.add(word)
        for _ in range(rng.choice([0, 1, 3])):
            i = rng.randrange(len(word) + 1)
            word = rng.choice([word[:i] + rng.choice(letters) + word[i:], word[:i] + word[i + 1:],
                               word[:i] + rng.choice(letters) + word[i + 1:]])
            words.add(word or "x")
    return {w: rng.choice([1, 5, 25, 125, 7, 700]) for w in words}


def test_against_all_pairs(spark):
    got = check(spark, made(1, "abc", 7, 300) | made(2, "abcdefghéßÿ", 14, 400))
    assert any(r[0] for r in got.values()) and any(r[1] != r[0] and r[0] for r in got.values())


def test_doubled_letters_and_short_words(spark):
    check(spark, {w: i + 1 for i, w in enumerate(
        ["a", "b", "ab", "ba", "aa", "aaa", "aaaa", "hello", "helo", "hell", "ello", "helllo", "jello",
         "hellos", "shell", "ÿaaa", "aaaÿ", "éa", "ea"])})


def test_long_words_go_by_another_way(spark, monkeypatch):
    rng = random.Random(3)
    base = "".join(rng.choice("abcd") for _ in range(64))
    words = [base, base[:-1], base + "x", "x" + base, base[:30] + "q" + base[31:], base[:30] + base[31:],
             base[:30] + "r" + base[31:] + "x", base + "xy", "a" * 63, "a" * 64, "a" * 65, "a" * 66,
             "z" * 5000, "z" * 5001, "z" * 2500 + "y" + "z" * 2499]
    counts = {w: 6 ** (i % 4) for i, w in enumerate(words)}
    check(spark, counts)
    monkeypatch.setattr(spelling, "LONG", 4)
    check(spark, made(4, "ab", 9, 120))


def test_chains_of_forms(spark):
    words = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb", "bbbbbb", "bbbbbc", "bbbbcc"]
    got = check(spark, {w: 5 ** i for i, w in enumerate(words)})
    assert got["aaaaaa"][1] == "bbbbcc"


def test_awkward_rows(spark):
    kind = "word string, n long, near string, form int"
    rows = [(None, 5, "x", 1), ("", 3, "x", 1), ("a", 1, "x", 1), ("abc", 2, None, 2), ("abc", 3, "y", 3), ("abd", 25, "", 1)]
    got = {r.word: (r.form, r.n, r.n_near) for r in spelling.variants(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"": (None, 3, 0), "a": (None, 1, 0), "abc": ("abd", 5, 1), "abd": (None, 25, 1)}
    assert spelling.variants(spark.createDataFrame([], kind)).count() == 0


def test_words_of_the_query(spark, docs):
    texts = [(i, f"Straße_{i} ÀÉ×÷ÿabc don't {'Word' * (i % 5 + 2)} ABCÄdefgh x") for i in range(300)]
    import re
    expected = []
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                expected.append(run)
    got = [r.word for r in queries.spelt_words(docs([*texts, (None, None)])).collect() if len(r.word) >= 6]
    assert sorted(got) == sorted(expected)
    counted = spelling.count_words(spark.createDataFrame([(w,) for w in expected], "word string"))
    assert {r.word: r.n for r in counted.collect()} == {
        w: expected.count(w) for w in set(expected) if expected.count(w) >= 5}
