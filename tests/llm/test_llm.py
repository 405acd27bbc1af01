import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import leakage, main_content, mixing, near_duplicates, repeated_lines, sentences, speaker_turns

WORDS = [f"w{i}" for i in range(400)]


def near_records():
    rng = random.Random(4)
    rows = []
    for base in range(12):
        words = [rng.choice(WORDS) for _ in range(120)]
        for v in range(4):
            edited = list(words)
            for _ in range(v * 3):
                edited[rng.randrange(len(edited))] = rng.choice(WORDS)
            rows.append(("chunk" if base % 2 else "page", f"r{base:02d}{v}", " ".join(edited)))
    rows += [("chunk", "same1", "Equal, words here"), ("chunk", "same2", "words here equal"), ("chunk", "same1", "Equal, words here")]
    rows += [("chunk", "none", None), ("chunk", "empty", "..."), ("chunk", None, "w1 w2"), ("chunk", "one", "w1"), ("page", "long", " ".join(rng.choice(WORDS) for _ in range(30000)))]
    return rows


def brute_pairs(rows):
    bags = {(k, key): Counter(re.findall(r"[^\W_]+", t.lower())) for k, key, t in rows if key and t}
    found = set()
    for (k, a), x in bags.items():
        for (m, b), y in bags.items():
            if k == m and a < b and x and y and 2 * (x & y).total() >= 0.8 * (x.total() + y.total()):
                found.add((k, a, b))
    return found


def test_near_duplicates_agree_with_brute_force(spark):
    rows = near_records()
    df = spark.createDataFrame(rows, "kind string, key string, text string").withColumn("words", F.lit(1))
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(df).collect()}
    assert got == brute_pairs(rows)
    groups = {r.key: r.group_id for r in near_duplicates.near_duplicate_groups(df).collect()}
    assert groups["same1"] == groups["same2"] and "none" not in groups and "empty" not in groups
    for _, a, b in got:
        assert groups[a] == groups[b]


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates.near_duplicate_pairs(spark.createDataFrame([], "kind string, key string, text string")).count() == 0


def test_posterior_bound_rises_with_the_batch():
    bounds = [near_duplicates.fewest_agreeing(n, 2 / 3, 1 / 256) for n in (16, 32, 64, 128)]
    assert bounds == sorted(bounds) and 0 < bounds[1] < 32 * 2 / 3


def test_water_filling_clamps_and_redistributes():
    epochs = mixing.water_fill({"a": 100, "b": 1000, "c": 1000}, {"a": 0.5, "b": 0.25, "c": 0.25, "d": 0.0}, {"a": 2, "b": 5, "c": 5}, 1000)
    assert epochs == {"a": 2.0, "b": 0.4, "c": 0.4, "d": 0.0}
    assert mixing.water_fill({}, {"a": 1.0}, {"a": 3}, 10) == {"a": 0.0}


def test_mix_reaches_shares_within_caps(spark):
    rows = [(i, "ab"[i % 3 == 0], f"word {i} text of some words") for i in range(600)] + [(601, None, "x"), (602, "a", None), (603, "a", ""), (0, "b", "word 0 text of some words")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.6, 2), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    selection, report = mixing.mix(docs, targets)
    assert selection.agg(F.max("uses")).first()[0] <= 2 and selection.count() == selection.select("doc_id").distinct().count()
    shares = {r.source: r.actual_share for r in report.collect()}
    assert shares["none"] == 0 and abs(sum(shares.values()) - 1) < 1e-9 and abs(shares["b"] - 2 / 3) < 0.02
    empty, _ = mixing.mix(docs.limit(0), targets)
    assert empty.count() == 0


def web_page(rng, kind):
    """Lines of a page of an invented site, and which of them are the site's."""
    own = [f"{rng.choice('ABC')}ctivity around {rng.choice(WORDS)} rose by {rng.randrange(9)} percent in {rng.choice(WORDS)}, and {rng.choice(WORDS)} fell in most other districts." for _ in range(rng.randrange(3, 8))]
    links = ["Picked for you"] + [f"Report on {rng.choice(WORDS)} and {rng.choice(WORDS)}" for _ in range(3)]
    parts = [(["Skip to main content", "Fishing", "Boats and nets"], 1), ([f"Notes on {rng.choice(WORDS)} waters", *own, f"Remark of the {kind} desk alone"], 0), ([*links, "Harbour office", "House rules"], 1)]
    return [x for lines, _ in parts for x in lines], np.concatenate([np.full(len(lines), y) for lines, y in parts])


def test_labeller_learns_the_site_from_recurrence(spark):
    rng = random.Random(2)
    made = [(f"d{i}", "abc"[i % 3], *web_page(rng, "abc"[i % 3])) for i in range(160)]
    rows = [(d, 1, kind, "\n".join(lines)) for d, kind, lines, _ in made]
    df = spark.createDataFrame(rows, "doc_id string, page int, doc_type string, text string")
    model = main_content.train(df, 120)
    found = main_content.label_pages(model, [lines for _, _, lines, _ in made])
    right = np.concatenate([a == b for a, (_, _, _, b) in zip(found, made)])
    assert right.mean() > 0.97
    page = rows[130][3]
    dirty = spark.createDataFrame([("d", 1, page + "\n\n"), ("d", 1, page + "\n\n"), ("d", 2, None), ("d", 3, "")], "doc_id string, page int, text string")
    lines = main_content.boilerplate_lines(dirty, model)
    assert lines.count() == lines.distinct().count() == found[130].sum()
    kept = {r.page: r.text for r in main_content.main_content(dirty, model).collect()}
    assert made[130][2][4] in kept[1] and "House rules" not in kept[1] and kept[3] == ""


def test_long_pages_are_labelled_as_a_whole(monkeypatch):
    rng = random.Random(5)
    page = [x for i in range(90) for x in web_page(rng, "a")[0]]
    assert len(page) > 1000
    model = main_content.BiLSTM(4)
    x, mask = main_content._padded([main_content.block_vectors(page)])
    whole = model.scores(x, mask)[:, 0]
    assert np.allclose(model.scores_in_blocks(page, 100), whole, atol=1e-4)
    monkeypatch.setattr(main_content, "BLOCK", 300)
    assert (main_content.label_pages(model, [page, page[:5]])[0] == (whole > 0)).mean() > 0.999


def test_gradients_match_differences():
    model = main_content.BiLSTM(1)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, mask = main_content._padded([main_content.block_vectors(["Home", "A long line of text."]), main_content.block_vectors(["Data"])])
    y = np.array([[1, 1], [0, 0]], float)

    def loss():
        s = model.scores(x, mask)
        return ((np.log1p(np.exp(-np.abs(s))) + np.maximum(s, 0) - s * y) * mask).sum() / mask.sum()

    grad = model.gradients(x, mask, y)
    for k, at in (("hf", (1, 2)), ("xb", (3, 40)), ("cf", (5,)), ("o", (2, 0))):
        model.w[k][at] += 1e-2
        up = loss()
        model.w[k][at] -= 2e-2
        down = loss()
        model.w[k][at] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(float(grad[k][at]), rel=0.05, abs=2e-4)


def test_repeated_lines_agree_with_brute_force(spark):
    rng = random.Random(1)
    pages = []
    for d in range(30):
        lines = [f"own line {d} {i}" for i in range(4)] + ["Legal  NOTICE."] * (d % 2) + ["share this", "", "--"] * (d % 10 == 0)
        rng.shuffle(lines)
        pages.append((f"d{d}", 1, "\n".join(lines)))
    pages += [pages[0], ("d1", 2, None), ("d2", 2, "")]
    df = spark.createDataFrame(pages, "doc_id string, page int, text string")
    sources = spark.createDataFrame([(f"d{d}", "s") for d in range(30)], "doc_id string, source string")
    lines = repeated_lines.identified_lines(df, sources)
    got = {tuple(r) for r in repeated_lines.repeated_lines(lines).select("doc_id", "page", "line_no").collect()}
    want = {(d, p, i) for d, p, t in pages if t for i, x in enumerate(t.split("\n"), 1) if x == "Legal  NOTICE."}
    assert got == want


def test_leaks_agree_with_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    refs = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([5, 14, 30])))) for i in range(20)]
    docs = []
    for d in range(60):
        words = [rng.choice(WORDS) for _ in range(40)]
        part = refs[d % 20][1].split()
        if d % 3:
            words[10:10] = part[: 11 + d % 3]
        docs.append((d, ", ".join(words).upper() if d % 2 else " ".join(words)))
    docs += [(100, None), (101, "")]
    items = spark.createDataFrame([(i, None, t) for i, t in refs] + [(0, None, refs[0][1])], "item_id long, question string, reference string")
    found = leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), items)
    got = {(r.doc_id, r.item_id) for r in found.where("exact").collect()}
    grams = lambda t: {tuple(w[i : i + 12]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 11)}
    assert got == {(d, i) for d, t in docs for i, r in refs if grams(t) & grams(r)}
    monkeypatch.setattr(leakage, "INDEX_CHARS", 300)  # several indexes find the same
    found = leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert got == {(r.doc_id, r.item_id) for r in found.where("exact").collect()}


def test_turns_across_interruptions_and_noise(spark):
    text = "Transcript front matter\nCHAIR ORWELL: Um, good [laughter] morning.\nMODERATOR: Thanks.\nCHAIR ORWELL: Well, uh\n"
    pages = spark.createDataFrame([("d", 1, text), ("d", 1, text), ("d", 2, "yes indeed.\nQ (Ann Poe): What?\n"), ("e", 1, None)], "doc_id string, page int, text string")
    docs = spark.createDataFrame([("d", None), ("e", "")], "doc_id string, speaker string")
    got = [(r.turn_no, r.speaker, r.first_word, r.last_word) for r in speaker_turns.speaker_turns(pages, docs).orderBy("turn_no").collect()]
    assert got == [(1, "orwell", "good", "morning"), (2, "moderator", "thanks", "thanks"), (3, "orwell", "well", "indeed"), (4, "poe", "what", "what")]
    assert got == [tuple(r)[1:] for r in speaker_turns.turn_bounds(pages, docs).orderBy("turn_no").collect()]
    assert speaker_turns.turn_bounds(pages.limit(0), docs.limit(0)).count() == 0


def test_sentences(spark):
    rows = [(1, "The rate rose to 3.5 percent. Dr. Lee agreed (why?) quickly.\n\nHeading\n"), (2, None), (3, "  "), (4, "利率上升。市场平静。")]
    got = {}
    for r in sentences.split_sentences(spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")).orderBy("doc_id", "sent_no").collect():
        got.setdefault(r.doc_id, []).append(r.end_pos)
    assert got[1] == [29, 60, 69] and got[4] == [5, 10] and 2 not in got and 3 not in got


def ends(text, learned=sentences.NOTHING):
    out, start = [], 0
    for e in sentences.sentence_ends(text, learned):
        out.append(text[start:e].strip())
        start = e
    return out


LANGUAGES = {
    "en": ["Rates rose, cf. No. 3 of the list.", "“Not yet. We wait,” the Chair said.", "(Staff agreed.)", "Was it 3.5 percent?", "It closed at 5 p.m.", "Dr. Lee left."],
    "de": ["Am 3. März tagte der Rat, z. B. in Bonn.", "„Noch nicht. Wir warten“, sagte sie.", "Die Quote lag bei ca. 3,5 Prozent."],
    "fr": ["Le taux a atteint 3,5 %.", "« Rien ne presse. Attendons », a dit M. Petit.", "Pourquoi ?", "Cf. l'annexe n° 3, p. 4."],
    "es": ["El Sr. Vega votó en contra.", "¿Bastará?", "«Falta tiempo. Veremos», dijo en enero.", "Creció aprox. 3,5 %."],
    "hi": ["दर 3.5 प्रतिशत है।", "“अभी नहीं। देखें,” एक सदस्य ने कहा।", "क्या दर बढ़ेगी?"],
    "zh": ["利率上升（见表3.2。），贷款放缓。", "主席表示：“稳健。我们等待。”", "为什么？", "“会反弹吗？”有记者问道。"],
    "ja": ["金利は上がった（表2.9を参照。）ため、貸出も鈍化した。", "「回復するのか？」との質問が出た。", "なぜか？"],
}


@pytest.mark.parametrize("lang", sorted(LANGUAGES))
def test_sentences_of_a_language(lang):
    glue = "" if lang in ("zh", "ja") else " "
    assert ends(glue.join(LANGUAGES[lang])) == LANGUAGES[lang]


def test_statements_of_scripts_without_end_marks():
    statements = ["อัตราเงินเฟ้อขยายตัวร้อยละ 5.8 และสินเชื่อธนาคารทรงตัว", "ทำไมการส่งออกจึงอ่อนแอ", "รายงานฉบับที่ 47 ระบุว่าค่าจ้างแรงงานชะลอลง"]
    assert ends(" ".join(statements)) == statements
    assert ends("ខ្ញុំទៅផ្ទះ។ គាត់នៅទីនេះ។") == ["ខ្ញុំទៅផ្ទះ។", "គាត់នៅទីនេះ។"]


def test_long_quotations_headings_and_particles():
    quotation = "“" + " ".join(f"Part {i} was said." for i in range(60)) + "” she told them."
    assert ends(quotation + " They left.") == [quotation, "They left."]
    assert ends("Box 7. Rental inflation\n\nRents rose.") == ["Box 7. Rental inflation", "Rents rose."]
    assert ends("「回復した。」とても良い。") == ["「回復した。」", "とても良い。"]
    assert ends("「回復した。」と述べた。") == ["「回復した。」と述べた。"]


def test_abbreviations_and_words_are_learned(spark):
    texts = [f"They met, cf. abz. {i} of the record. Rates rose." for i in range(8)] + [f"{a}利率政策{b}。" for a in "甲乙丙丁戊己" for b in "子丑寅卯辰巳"] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert "abz" in sentences.learned_abbreviations(df) and "record" not in sentences.learned_abbreviations(df)
    words = sentences.learned_words(df)
    assert "利率政策" in words and "利率政" not in words
    got = {r.doc_id: r.n for r in sentences.split_sentences(df).groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert got[0] == 2 and len(got) == 44
