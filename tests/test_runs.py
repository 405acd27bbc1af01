from pyspark.sql import functions as F

from gristmill.operators import passages, runs


def test_waves_with_a_cycle_and_what_waits_behind_it(spark):
    tasks = spark.createDataFrame([("r", t) for t in "abcdef"] + [("q", "x")], "run string, task string")
    edges = spark.createDataFrame([("r", "b", "a"), ("r", "c", "b"), ("r", "c", "a"), ("r", "d", "e"), ("r", "e", "d"), ("r", "f", "e"), ("r", "a", "gone")], "run string, task string, needs string")
    got = {(r.run, r.task): r.wave for r in runs.waves(tasks, edges).collect()}
    assert got == {("r", "a"): 1, ("q", "x"): 1, ("r", "b"): 2, ("r", "c"): 3, ("r", "d"): 4, ("r", "e"): 4, ("r", "f"): 4}


def test_brief_agents_are_represented(spark):
    rows = [("r", "long", i, f"L{i}") for i in range(44)] + [("r", "brief", i, f"B{i}") for i in range(2)] + [("r", "long", 50, "L0")]
    got = [r.evidence for r in runs.round_robin(spark.createDataFrame(rows, "run string, agent string, ord int, evidence string")).orderBy("place").collect()]
    assert len(got) == 40 and got[:4] == ["B0", "L0", "B1", "L1"]


def compact_by_hand(sizes, budget, keep_last, long, kept):
    total, out = sum(sizes), [False] * len(sizes)
    for i in range(max(0, len(sizes) - keep_last)):
        if total <= budget:
            break
        if sizes[i] > long:
            out[i], total = True, total - (sizes[i] - kept)
    return out


def test_oldest_results_are_shortened_first(spark):
    cases = {"a": [3000] * 8, "b": [500, 4000, 100, 2000, 900, 901, 7000], "c": [10], "d": [5000, 5000]}
    rows = [(run, i, "x" * n) for run, sizes in cases.items() for i, n in enumerate(sizes)] + [("e", 0, None)]
    got = {(r.run, r.ord): r.shortened for r in runs.compacted(spark.createDataFrame(rows, "run string, ord int, text string"), 9000, 2).collect()}
    for run, sizes in cases.items():
        assert [got[run, i] for i in range(len(sizes))] == compact_by_hand(sizes, 9000, 2, 900, 600)
    assert got["e", 0] is False


def test_evidence_once_with_its_longest_text(spark):
    rows = [("D", "k1", 1, "short"), ("W", "u", 2, "web"), ("D", "k1", 3, "much longer"), ("D", "k0", 4, None)]
    got = {r.id: (r.key, r.text) for r in runs.deduplicated_evidence(spark.createDataFrame(rows, "prefix string, key string, ord int, text string")).collect()}
    assert got == {"D1": ("k1", "much longer"), "W1": ("u", "web"), "D2": ("k0", None)}


def test_chunks_keep_to_sections_and_sizes():
    rows = []
    for s in ("First", "Second"):
        rows.append((1, s, "heading", s))
        rows += [(1, " ".join(f"Word{i}x{j}" for j in range(60)) + ".", "text", s) for i in range(12)]
    found = passages.chunks_of(rows, 200, 40, 20)
    assert all(len(c["text"].split()) <= 260 for c in found) and {c["section"] for c in found} == {"First", "Second"}
    assert found[0]["text"].startswith("First") and sum("Word0x0" in c["text"] for c in found) >= 2
    assert passages.chunks_of([(1, "Only a heading", "heading", "x")]) == [] and passages.chunks_of([]) == []


def test_long_paragraphs_are_split_whole():
    text = " ".join(f"Sentence number {i} has some seven words." for i in range(200))
    pieces = passages.split_long(text, "text", 100)
    assert " ".join(pieces) == text and all(len(p.split()) <= 100 for p in pieces)
    assert passages.tail_of("One here. Two there are words. Three more.", 5) == "Three more."
    table = "\n".join(f"row {i} | {i}" for i in range(90))
    assert "\n".join(passages.split_long(table, "table", 50)) == table


def test_parts_break_at_headings(spark):
    rows = [("d", 1, 0, "Intro", "heading", "")] + [("d", 1, i, " ".join(["w"] * 200), "text", "") for i in range(1, 5)] + [("d", 1, 5, "Second", "heading", ""), ("d", 1, 6, " ".join(["w"] * 100), "text", "")]
    got = {r.ord: r.part for r in passages.parts(spark.createDataFrame(rows, "doc_id string, page int, ord int, text string, kind string, section string")).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3}


def test_furniture_needs_three_pages(spark):
    pages = [("d", p, f"Bulletin, page {p} of iv\nbody {p} text\nfooter of {p}") for p in range(1, 5)] + [("e", p, "Header\nx") for p in (1, 2)] + [("e", 3, None)]
    got = {(r.doc_id, r.key): r.n_pages for r in passages.furniture(spark.createDataFrame(pages, "doc_id string, page int, text string")).collect()}
    assert got == {("d", "bulletin, page # of #"): 4, ("d", "footer of #"): 4}
    assert passages.paragraphs(spark.createDataFrame(pages, "doc_id string, page int, text string").withColumn("section", F.lit(None).cast("string"))).where("doc_id = 'e'").count() == 4
