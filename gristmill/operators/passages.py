"""Pages to sections and passages: furniture, headings, parts of even size, and chunks that keep to their section.

What depends on the order of a document's lines is a fold over one document; the
documents are spread over the cluster, and every fold is one pass over its rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import furniture_key

MAX_WORDS, MIN_WORDS, OVERLAP, PART_WORDS = 320, 80, 45, 600
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z(\"“])")
SKIPPED = ("contents", "table of contents")
FURNITURE_SHARE, FURNITURE_LEAST = 0.15, 3


def furniture(pages: DataFrame) -> DataFrame:
    """doc_id, key, n_pages: first and last lines of a document's pages that recur, but for numbers, on at least 15 % and three of them."""
    lines = pages.where(F.col("text").isNotNull()).groupBy("doc_id", "page").agg(F.min("text").alias("text"))
    filled = lines.select("doc_id", "page", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("lines")).where(F.size("lines") > 0)
    edges = F.array_distinct(F.array(furniture_key(F.element_at("lines", 1)), furniture_key(F.element_at("lines", -1))))
    keys = filled.select("doc_id", F.explode(edges).alias("key")).where("key <> ''").groupBy("doc_id", "key").agg(F.count("*").alias("n_pages"))
    sizes = lines.groupBy("doc_id").agg(F.count("*").alias("size"))
    return keys.join(sizes, "doc_id").where((F.col("n_pages") >= FURNITURE_LEAST) & (F.col("n_pages") >= FURNITURE_SHARE * F.col("size"))).select("doc_id", "key", "n_pages")


def paragraphs(pages: DataFrame) -> DataFrame:
    """doc_id, page, ord, text, kind, section: a document's lines in order without neighbours that repeat; short lines without an end mark are headings.

    section is the last heading before a line, its page's own section where there is none yet.
    """
    once = pages.where(F.col("text").isNotNull()).groupBy("doc_id", "page").agg(F.min("text").alias("text"), F.max("section").alias("page_section"))
    lines = once.select("doc_id", "page", "page_section", F.posexplode(F.split("text", "\n")).alias("ord", "text")).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where("text <> ''")
    order = Window.partitionBy("doc_id").orderBy("page", "ord")
    fresh = lines.withColumn("before", F.lag("text").over(order)).where(F.col("before").isNull() | (F.col("before") != F.col("text")))
    words = F.size(F.split("text", " "))
    heading = (words <= 12) & (F.length("text") <= 100) & ~F.col("text").rlike(r"[.,;:!?”\"]$") & ~F.col("text").contains("|") & F.col("text").rlike(r"^[\p{Lu}\d]")
    kind = F.when(F.col("text").contains(" | "), F.lit("table")).when(heading, F.lit("heading")).otherwise(F.lit("text"))
    named = fresh.withColumn("kind", kind)
    section = F.last(F.when((F.col("kind") == "heading") & ~F.col("text").rlike(r"(?i)continued"), F.col("text")), ignorenulls=True).over(order)
    return named.select("doc_id", "page", "ord", "text", "kind", F.coalesce(section, "page_section", F.lit("")).alias("section"))


def parts(rows: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, ord, part, n_words: paragraphs (doc_id, page, ord, text, kind) in parts of about part_words words.

    A part ends before a heading once it is 40 % full, and before what would overflow
    it once it is a quarter full.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, part, words = None, 1, 0
        for batch in batches:
            out = []
            for d, n, kind in zip(batch["doc_id"], batch["n_words"].tolist(), batch["kind"]):
                if d != doc:
                    doc, part, words = d, 1, 0
                elif words and (kind == "heading" and words >= 0.4 * part_words or kind != "heading" and words + n > part_words and words >= 0.25 * part_words):
                    part, words = part + 1, 0
                words += n
                out.append(part)
            yield batch[["doc_id", "page", "ord", "n_words"]].assign(part=out)

    sized = rows.select("doc_id", "page", "ord", "kind", F.size(F.split("text", " ")).alias("n_words"))
    ordered = sized.repartition("doc_id").sortWithinPartitions("doc_id", "page", "ord")
    return ordered.mapInPandas(fold, "doc_id string, page int, ord int, n_words int, part int")


def split_long(text: str, kind: str, most: int) -> list[str]:
    """A text in pieces of at most `most` words, cut between sentences, a table's between rows; a longer sentence is cut between words."""
    joint = "\n" if kind == "table" else " "
    out: list[str] = []
    held, size = [], 0
    for unit in text.split("\n") if kind == "table" else SENTENCE.split(text):
        words = unit.split()
        for piece in ([unit] if len(words) <= most else [" ".join(words[i : i + most]) for i in range(0, len(words), most)]):
            n = len(piece.split())
            if held and size + n > most:
                out.append(joint.join(held))
                held, size = [], 0
            held.append(piece)
            size += n
    return [*out, joint.join(held)] if held else out


def tail_of(text: str, most: int) -> str:
    """The last whole sentences of a text's last paragraph with at most `most` words together; none of a table."""
    last = text.split("\n\n")[-1]
    if "\n" in last.strip():
        return ""
    kept: list[str] = []
    for sentence in reversed(SENTENCE.split(last)):
        if sum(len(k.split()) for k in kept) + len(sentence.split()) > most:
            break
        kept.insert(0, sentence)
    return " ".join(kept)


def chunks_of(rows: list[tuple[int, str, str, str]], most: int = MAX_WORDS, least: int = MIN_WORDS, overlap: int = OVERLAP) -> list[dict]:
    """Chunks of one document's paragraphs (page, text, kind, section) in order: section, page_start, page_end, text.

    A chunk holds at most `most` words, the sentences repeated from the one before
    included, and keeps to one section; headings go with what follows them. Small chunks
    join the one before in their section, and what is only headings or a few words is left out.
    """
    pieces = [(page, piece, kind, section) for page, text, kind, section in rows if section.strip().lower() not in SKIPPED for piece in split_long(text, kind, most)]
    out: list[dict] = []
    held: list[tuple[int, str, str, str]] = []
    carried, words = "", 0

    def close(new_section: bool) -> None:
        nonlocal held, carried, words
        at = len(held)
        while at and held[at - 1][2] == "heading":
            at -= 1
        body, kept = held[:at], held[at:]
        if body:
            lead = next((x for x in body if x[2] != "heading"), body[0])
            text = "\n\n".join([carried] * bool(carried) + [x[1] for x in body])
            out.append({"section": lead[3], "page_start": body[0][0], "page_end": body[-1][0], "text": text, "real": any(x[2] != "heading" for x in body)})
        carried = "" if new_section or not body else tail_of(out[-1]["text"], overlap)
        held, words = kept, sum(len(x[1].split()) for x in kept)

    for piece in pieces:
        size = len(piece[1].split())
        changed = bool(held) and held[-1][3] != piece[3]
        if held and (changed or words + len(carried.split()) + size > most):
            close(changed)
        held.append(piece)
        words += size
    if held:
        close(True)
        if held:  # only headings are left
            out.append({"section": held[0][3], "page_start": held[0][0], "page_end": held[-1][0], "text": "\n\n".join(x[1] for x in held), "real": False})
    merged: list[dict] = []
    for c in out:
        size = len(c["text"].split())
        before = merged[-1] if merged else None
        if before and size < least and before["section"] == c["section"] and len(before["text"].split()) + size <= 1.3 * most:
            before["text"] += "\n\n" + c["text"]
            before["page_end"] = c["page_end"]
            before["real"] |= c["real"]
        else:
            merged.append(c)
    return [c for c in merged if c["real"] and len(c["text"].split()) >= 12]


def chunks(rows: DataFrame, most: int = MAX_WORDS, least: int = MIN_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, position, section, page_start, page_end, text of paragraphs (doc_id, page, ord, text, kind, section).

    Documents pass one after the other through sorted partitions; only the one being
    read is held.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, held = None, []

        def made() -> pd.DataFrame:
            rows = [(doc, i, c["section"], c["page_start"], c["page_end"], c["text"]) for i, c in enumerate(chunks_of(held, most, least, overlap))]
            return pd.DataFrame(rows, columns=["doc_id", "position", "section", "page_start", "page_end", "text"])

        for batch in batches:
            for d, *row in batch[["doc_id", "page", "text", "kind", "section"]].itertuples(index=False, name=None):
                if d != doc:
                    if held:
                        yield made()
                    doc, held = d, []
                held.append(tuple(row))
        if held:
            yield made()

    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", "page", "ord")
    return ordered.mapInPandas(fold, "doc_id string, position int, section string, page_start int, page_end int, text string")
