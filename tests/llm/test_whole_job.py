import random

import numpy as np

from gristmill.llm import main_content, near_duplicates, repeated_lines


def test_near_duplicates_with_evenly_spread_edits(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        words = [f"v{rng.randrange(10**6)}" for _ in range(200)]
        edited = [f"u{rng.randrange(10**6)}" if j % 5 == 2 else w for j, w in enumerate(words)]  # exactly 0.8 in common
        rows += [("chunk", f"a{i:02d}", " ".join(words)), ("chunk", f"b{i:02d}", " ".join(edited))]
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "kind string, key string, text string")).collect()}
    assert got == {("chunk", f"a{i:02d}", f"b{i:02d}") for i in range(60)}


def test_bands_follow_from_the_chosen_miss():
    few, many = (near_duplicates.bands_needed(2 / 3, near_duplicates.ROWS, m) for m in (0.3, 0.1))
    assert few < many
    assert near_duplicates.jaccard_of(0.8) <= 2 / 3 + 1e-12 and near_duplicates.rare_jaccard_of(0.8) < near_duplicates.jaccard_of(0.8)


def test_recall_of_evenly_spread_edits(spark):
    """A text that shares common words with all others, one word in five to seven replaced: 0.80 to 0.86."""
    rng = random.Random(3)
    rows, want = [], set()
    for i in range(300):
        words = [f"the{rng.randrange(20)}" if rng.random() < 0.4 else f"v{rng.randrange(10**6)}" for _ in range(180)]
        step = (5, 6, 7)[i % 3]
        edited = [f"u{rng.randrange(10**6)}" if j % step == 2 else w for j, w in enumerate(words)]
        rows += [("chunk", f"a{i:03d}", " ".join(words)), ("chunk", f"b{i:03d}", " ".join(edited))]
        want.add(("chunk", f"a{i:03d}", f"b{i:03d}"))
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "kind string, key string, text string")).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_longest_blocks_agree_with_brute_force(spark):
    rng = random.Random(5)
    notice = [f"notice {i}" for i in range(7)]
    pages = []
    for d in range(30):
        lines = [f"own {d} {i}" for i in range(3)] + (notice if d % 2 else notice[:5] if d % 4 else ["share this"]) + [f"end {d}"]
        pages.append((f"d{d}", 1, "\n--\n".join(lines) if rng.random() < 0.3 else "\n".join(lines)))
    keys = {d: [(n, x) for n, x in enumerate(t.split("\n"), 1) if x != "--"] for d, _, t in pages}
    docs_of = {}
    for d, rows in keys.items():
        for i in range(len(rows)):
            for j in range(i + 1, len(rows) + 1):
                docs_of.setdefault(tuple(x for _, x in rows[i:j]), set()).add(d)
    want = set()
    for d, rows in keys.items():
        reached = 0
        for i in range(len(rows)):
            fits = [j for j in range(i + 1, len(rows) + 1) if len(docs_of[tuple(x for _, x in rows[i:j])]) >= 6]
            if fits and fits[-1] > reached:
                reached = fits[-1]
                want.add((d, 1, rows[i][0], rows[reached - 1][0], reached - i, len(docs_of[tuple(x for _, x in rows[i:reached])])))
    df = spark.createDataFrame([*pages, pages[0], ("d1", 2, None)], "doc_id string, page int, text string")
    sources = spark.createDataFrame([(f"d{d}", "s") for d in range(30)], "doc_id string, source string")
    got = [tuple(r) for r in repeated_lines.longest_blocks(repeated_lines.identified_lines(df, sources)).drop("source").collect()]
    assert len(got) == len(set(got)) and set(got) == want and {w[4] for w in want} >= {5, 7}


class FarFromTheEnd:
    def scores(self, x, mask):
        return x[:, :, 2] - 0.99  # above 0 where 20 lines or more follow on the page


def test_windows_of_long_pages_keep_their_place_on_the_page():
    sizes = (700, 720, 400, 401, 5)
    found = main_content.label_pages(FarFromTheEnd(), [[f"line {i}" for i in range(n)] for n in sizes])
    for n, marks in zip(sizes, found):
        assert marks.tolist() == [i < n - 20 for i in range(n)]


def test_training_reads_long_pages_whole(monkeypatch):
    seen = []
    monkeypatch.setattr(main_content.BiLSTM, "gradients", lambda self, x, mask, y: seen.append(int((y * mask).sum())) or {})
    main_content.fit([["x"] * 900], [np.ones(900, np.int8)], epochs=1)
    assert sum(seen) >= 900


def test_every_order_of_a_class_is_near(spark):
    rng = random.Random(7)
    words = [f"w{i:03d}" for i in range(100)]
    other = rng.sample(words, 100)
    near = other[:95] + [f"x{i}" for i in range(5)]
    rows = [("chunk", k, " ".join(w)) for k, w in (("a", words), ("b", other), ("c", near))]
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "kind string, key string, text string")).collect()}
    assert got == {("chunk", "a", "b"), ("chunk", "a", "c"), ("chunk", "b", "c")}
