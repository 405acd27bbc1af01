"""Sentence ends in texts of mixed languages and scripts.

A blank line ends a sentence. Inside a paragraph the terminators form a lattice
whose edges are possible sentences, and the cheapest path is taken. No edge may
leave a closed quotation or parenthesis open, however long; a node's own cost
comes from the word before the terminator and the opening word after it. In
scripts written without spaces a dictionary word lattice cuts the text beside a
gap into words, and the final and opening words decide whether the gap ends a
sentence. Abbreviations that are never a sentence's last word are learned from
all documents: a word whose full stop is mostly followed by a small letter or a
digit. The words of the lattices are learned from all documents too: strings of
spaceless scripts whose neighbours vary on both sides. As many documents as there
are, at most MAX_LEARNED abbreviations and words can be learned.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.session import cut_lineage, release

# Words that are followed by a name or number and so never end a sentence.
LEADING_ABBREVIATIONS = frozenset(
    "dr prof mr mrs ms mme mlle sr sra dra st vs approx aprox no nos fig sec p pp art abs nr ca z b u a d h i e g "
    "i.e e.g u.a z.b bzw cf ex párr núm pág al vol vgl gov gen rev ed सं डॉ श्री".split()
)
# Abbreviations that may also be a sentence's last word: the opening word decides.
TRAILING_ABBREVIATIONS = frozenset("etc co inc corp ltd usw a.m p.m h min jr bros".split())
MONTH_ABBREVIATIONS = frozenset("jan feb mar apr jun jul aug sep sept oct nov dec janv févr juil déc ene abr ago dic okt dez".split())
ORDINAL_FOLLOWERS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember quartal halbjahr jahrhundert".split()
)
PAIRS = {"“": "”", "„": "“", "«": "»", "(": ")", "（": "）", "「": "」", "『": "』", "《": "》", "[": "]"}
CLOSERS = "”“’»)\\]」』）》\"'"
# Opening words that carry on a sentence after a closed quotation.
CJK_CONTINUES = ("と", "との", "という", "を", "に", "は", "が", "の", "も", "で", "ため", "から", "有记者", "有人", "一位", "，", "、", "；", "。")

# Words that begin like one of these particles.
CJK_WORDS = "とても ところ ところが とくに とりわけ ともに もし もう もっとも もちろん でも では では、 にもかかわらず がんばる はじめ はず のち".split()

# Thai dictionary: words that cannot end a statement, words that cannot open one, and other words of the domain.
THAI_OPEN_ENDED = "ร้อยละ ที่ ภายใน ใน ปี ฉบับที่ รายงาน และ หรือ ว่า ของ จาก โดย ระบุว่า คาดว่า ธนาคาร ไว้ที่ เป็น ประมาณ ราว".split()
THAI_CONTINUING = "และ หรือ แห่ง เดือน ต่อปี ต่อ ระบุว่า ว่า ที่ ของ จาก โดย ซึ่ง แต่ เพราะ ครั้ง บาท ล้าน คน ราย จุด เปอร์เซ็นต์".split()
THAI_WORDS = (
    "คณะกรรมการ คง อัตรา ดอกเบี้ย อัตราดอกเบี้ย ไว้ แห่งคาดว่า การ ลงทุน การลงทุน ที่อยู่อาศัย การบริโภค ภาค เอกชน ภาคเอกชน การส่งออก "
    "สินเชื่อ สินเชื่อธนาคาร ค่าจ้าง แรงงาน อัตราเงินเฟ้อ เงินเฟ้อ จะ ฟื้นตัว ขยายตัว ทรงตัว ชะลอลง ลดลง เล็กน้อย ปรับตัว ดีขึ้น ปีก่อน "
    "ทำไม จึง อ่อนแอ ผู้ว่าการ กล่าวว่า ยัง มี ความเสี่ยง"
).split()

ENDS = ".!?…।॥。！？｡။።؟۔។།"
TERMINATOR = re.compile(rf"[{ENDS}]+(?:[   ]?»|[{CLOSERS}])*")
BLANK_LINE = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")  # Thai, Lao, Burmese, Khmer
CJK = re.compile(r"[぀-ヿ㐀-鿿]")
LAST_WORD = re.compile(r"[^\s(\[“„«\"'’]+$")
OPENING = re.compile(r"[\s“„«(\[¿¡\"'「『（《•\-–—]*(.)", re.S)
FIRST_WORD = re.compile(r"\w+")
LIST_NUMBER = re.compile(r"^\W*(?:\d{1,3}|[A-Za-z]|[ivxlc]{1,5})$")

HEADING_LABEL = re.compile(r"^\W*[^\W\d_]+ \d{1,3}(?:\.\d{1,3})*$")
STOP = re.compile(r"(?<!\w)([^\W\d_]{1,12})\.(?=\s+[(\[«“„]?(\w))")

SPACELESS = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]+")
LONGEST_WORD, ONE_SIDED = 8, 0.7
SPLIT_COST = 10.0
LEARNED_SHARE, LEARNED_LEAST, MAX_LEARNED = 0.6, 5, 100_000


def words_by_lattice(text: str, words: frozenset[str], longest: int, learned: frozenset[str] = frozenset()) -> list[str]:
    """The cheapest segmentation of text: a dictionary word costs 1, a learned one 1.5, an unknown character 3."""
    n = len(text)
    best, back = [0.0] + [1e9] * n, [0] * (n + 1)
    for i in range(n):
        if best[i] + 3 < best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + 3, i
        for j in range(i + 1, min(n, i + longest) + 1):
            cost = 1.0 if text[i:j] in words else 1.5 if text[i:j] in learned else 3e9
            if best[i] + cost < best[j]:
                best[j], back[j] = best[i] + cost, i
    out, j = [], n
    while j:
        out.append(text[back[j] : j])
        j = back[j]
    return out[::-1]


_THAI_ALL = frozenset(THAI_OPEN_ENDED + THAI_CONTINUING + THAI_WORDS)
_THAI_LONGEST = max(map(len, _THAI_ALL))
_OPEN_ENDED, _CONTINUING = frozenset(THAI_OPEN_ENDED), frozenset(THAI_CONTINUING)
_CJK_ALL = frozenset([*CJK_CONTINUES, *CJK_WORDS])
_CJK_LONGEST = max(map(len, _CJK_ALL))


@dataclass(frozen=True)
class Learned:
    """What counts over all documents teach: abbreviations that end no sentence, and words of spaceless scripts."""

    abbreviations: frozenset[str] = frozenset()
    words: frozenset[str] = frozenset()


NOTHING = Learned()


def _unspaced_ends(text: str, learned: Learned) -> list[int]:
    """Ends of statements in a script that marks them by gaps: the words beside a gap, taken from a lattice over whole runs, decide."""
    runs = list(re.finditer(r"\S+", text))
    words = [words_by_lattice(r.group(), _THAI_ALL, max(_THAI_LONGEST, LONGEST_WORD), learned.words) for r in runs]
    ends = []
    for a, b, before, after in zip(runs, runs[1:], words, words[1:]):
        digits = a.group()[-1].isdigit() or b.group()[0].isdigit()
        marked = a.group()[-1] in ENDS and not b.group()[0].isdigit()
        if marked or not digits and before[-1] not in _OPEN_ENDED and after[0] not in _CONTINUING:
            ends.append(a.end())
    return ends + ([runs[-1].end()] if runs else [])


def _node_cost(text: str, m: re.Match, end: int, learned: Learned) -> float | None:
    """Cost of ending a sentence at the terminator m; None where no sentence can end."""
    rest = text[end:]
    mark = m.group()[: end - m.start()]
    closers = mark.lstrip(ENDS).strip()
    cjk = mark[0] in "。！？｡" or mark[0] == "…" and bool(CJK.search(text[max(0, m.start() - 3) : end + 3]))
    if not rest.strip():
        return 0.0
    spaced = rest[0].isspace()
    opening = OPENING.match(rest)
    first = opening.group(1) if opening else " "
    if cjk:
        if closers and closers[-1] in "）)":
            opened = text[: m.start()].rfind("（")
            return 0.0 if opened <= 0 or text[:opened].rstrip()[-1:] in "。！？…”」』" else 12.0
        if closers and not spaced and rest.startswith(CJK_CONTINUES):
            run = SPACELESS.match(rest)
            opens = words_by_lattice(run.group(), _CJK_ALL, max(_CJK_LONGEST, LONGEST_WORD), learned.words)[0] if run else rest[0]
            return 12.0 if opens in CJK_CONTINUES or not run else 0.0
        return 0.0 if not rest.lstrip().startswith(("，", "、", "；")) else 12.0
    nxt = rest.lstrip()[0]
    if nxt in ",;:—–-…" or first.islower():
        return None
    if mark[0] in "।॥။።؟۔។།":
        return 0.0
    if not spaced and not closers:
        # a missing space: only before a capital that follows a whole word or number
        before = LAST_WORD.search(text[: m.start()])
        whole = before and re.search(r"(?:[^\W\d_]{2,}|\d{2,}|%)$", before.group()) and "." not in before.group().rstrip("0123456789.")
        if not (first.isupper() and whole) or "/" in before.group() or before.group().startswith("www"):
            return None
    if closers or mark[0] in "!?" or len(mark) > 1:
        return 0.0
    before = LAST_WORD.search(text[: m.start()])
    word = re.split(r"(?<=[\w%]{2})[.!?…](?=[^\W\d_])", before.group())[-1] if before else ""  # after a missing space
    low = word.lower().strip("-–")
    low = low.rsplit("'", 1)[-1]
    follower = FIRST_WORD.match(rest.lstrip())
    follower = follower.group() if follower else ""
    if LIST_NUMBER.match(text[: m.start()].strip()):
        return None  # a list item's number
    if len(low) == 1 and low.isalpha() and word.isupper():
        return None  # an initial
    if low in MONTH_ABBREVIATIONS and first.isdigit():
        return None
    if low in TRAILING_ABBREVIATIONS:
        return 1.0
    if low in learned.abbreviations:
        return None
    if low in LEADING_ABBREVIATIONS and (low not in ("no", "a", "al") or word[0].isupper() or first.isdigit()):
        return None
    if low.isdigit() and len(low) <= 2 and follower.lower() in ORDINAL_FOLLOWERS:
        return None
    return 0.0


def _enclosed(text: str) -> tuple[list[int], list[int]]:
    """Beginnings and ends of the outermost closed quotations and parentheses, in order; marks without a partner count for nothing."""
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        if any(c == closer for closer, _ in reversed(stack)):
            while stack:
                closer, start = stack.pop()
                if closer == c:
                    spans.append((start, i))
                    break
        elif c == '"':
            stack.append(('"', i))
        elif c in PAIRS:
            stack.append((PAIRS[c], i))
    starts, stops = [], []
    for a, b in sorted(spans):
        if not stops or a > stops[-1]:
            starts.append(a)
            stops.append(b)
    return starts, stops


def _paragraph_ends(text: str, learned: Learned) -> list[int]:
    last = len(text.rstrip())
    starts, stops = _enclosed(text) if any(c in text for c in "“„«(（「『《[\"") else ([], [])
    heading = "\n" not in text and len(text) < 120 and text[last - 1] not in ENDS + CLOSERS
    ends = []
    for m in TERMINATOR.finditer(text):
        end = m.end()
        if "“" in m.group() and "„" not in text:  # it opens the next sentence
            end = m.start() + m.group().index("“")
        elif re.search(r"\s»$", m.group()) is None and m.group()[-1] in "\"'" and text[end : end + 1].isalnum():
            end = m.start() + len(m.group().rstrip("\"'"))
        at = bisect_right(starts, m.start()) - 1
        if at >= 0 and stops[at] >= end:
            continue  # the path can't leave a quotation open
        if heading and HEADING_LABEL.match(text[: m.start()]):
            continue
        cost = _node_cost(text, m, end, learned)
        # Nodes are passed one by one: ending here costs cost, going on SPLIT_COST less cost.
        if cost is not None and cost < SPLIT_COST - cost:
            ends.append(end)
    return ends if ends and ends[-1] == last else [*ends, last]


def sentence_ends(text: str | None, learned: Learned = NOTHING) -> list[int]:
    """End offsets (code points) of text's sentences in order; empty for null or blank text."""
    if not text or not text.strip():
        return []
    ends: list[int] = []
    start = 0
    for m in [*BLANK_LINE.finditer(text), None]:
        part = text[start : m.start() if m else len(text)]
        if part.strip():
            lead = len(part) - len(part.lstrip())
            body = part.strip()
            ends += [start + lead + e for e in (_unspaced_ends(body, learned) if len(UNSPACED.findall(body)) * 2 > len(body) else _paragraph_ends(body, learned))]
        start = m.end() if m else len(text)
    return ends


def _full_stops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of words with a full stop, and of those followed by a small letter or a digit."""
    seen: Counter = Counter()
    inside: Counter = Counter()

    def partial() -> pd.DataFrame:
        return pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64"), "inside": pd.Series([inside[w] for w in seen], dtype="int64")})

    for batch in batches:
        for text in batch["text"]:
            for word, following in STOP.findall(text or ""):
                seen[word.lower()] += 1
                inside[word.lower()] += following.islower() or following.isdigit()
        if len(seen) > 500_000:
            yield partial()
            seen.clear()
            inside.clear()
    yield partial()


def learned_abbreviations(documents: DataFrame) -> frozenset[str]:
    """Words whose full stop ends no sentence in at least LEARNED_SHARE of all their places, by counts over all documents.

    A word counts from LEARNED_LEAST places and from 1 / MAX_LEARNED of all full stops on: so at most MAX_LEARNED words can be learned.
    """
    counts = documents.select("text").mapInPandas(_full_stops, "word string, n long, inside long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"))
    counts = cut_lineage(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where((F.col("n") >= max(LEARNED_LEAST, total / MAX_LEARNED)) & (F.col("inside") >= LEARNED_SHARE * F.col("n"))).select("word").collect()
    release(counts)
    return frozenset(r.word for r in rows)


def _substrings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of all strings of 2 to LONGEST_WORD + 1 characters in runs of spaceless scripts."""
    seen: Counter = Counter()
    partial = lambda: pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})
    for batch in batches:
        for text in batch["text"]:
            for run in SPACELESS.findall(text or ""):
                seen.update(run[i:j] for i in range(len(run)) for j in range(i + 2, min(len(run), i + LONGEST_WORD + 1) + 1))
            if len(seen) > 1_000_000:
                yield partial()
                seen.clear()
    yield partial()


def learned_words(documents: DataFrame) -> frozenset[str]:
    """Strings of spaceless scripts that stand before and after varying characters, by counts over all documents.

    Where one longer string makes up most of a string's places, the string is a part of
    a word. Strings that end in an open-ended word or begin with a continuing one are
    left out: these particles are words of their own. A word counts from LEARNED_LEAST
    places and from 1 / MAX_LEARNED of all on.
    """
    counts = documents.select("text").mapInPandas(_substrings, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts.where(F.col("n") >= LEARNED_LEAST))
    total = counts.agg(F.sum("n")).first()[0] or 0
    longer = counts.where(F.length("word") >= 3)
    to_right = longer.groupBy(F.expr("left(word, length(word) - 1)").alias("word")).agg(F.max("n").alias("right"))
    to_left = longer.groupBy(F.expr("right(word, length(word) - 1)").alias("word")).agg(F.max("n").alias("left"))
    free = counts.where((F.length("word") <= LONGEST_WORD) & (F.col("n") >= total / MAX_LEARNED)).join(to_right, "word", "left").join(to_left, "word", "left")
    rows = free.where(F.greatest(F.coalesce("right", F.lit(0)), F.coalesce("left", F.lit(0))) <= ONE_SIDED * F.col("n")).select("word").collect()
    release(counts)
    particles = (tuple(THAI_OPEN_ENDED), (*THAI_CONTINUING, *CJK_CONTINUES))
    return frozenset(r.word for r in rows if not r.word.endswith(particles[0]) and not r.word.startswith(particles[1]))


def _ends_of_batches(learned: Learned):
    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ends": [sentence_ends(t, learned) for t in b["text"]]})

    return ends


def split_sentences(documents: DataFrame) -> DataFrame:
    """doc_id, sent_no (from 1), end_pos for every sentence; documents(doc_id, text) may repeat rows.

    Null and blank texts have no sentences; of unequal texts under one doc_id the smallest counts.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    ends = documents.select("doc_id", "text").mapInPandas(_ends_of_batches(Learned(learned_abbreviations(documents), learned_words(documents))), f"doc_id {kind}, ends array<int>")
    once = ends.groupBy("doc_id").agg(F.min("ends").alias("ends"))
    return once.select("doc_id", F.posexplode("ends").alias("at", "end_pos")).select("doc_id", (F.col("at") + 1).alias("sent_no"), "end_pos")
