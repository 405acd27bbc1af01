"""Evaluation passages inside corpus documents, by the q-gram lemma.

Texts are compared as their words in lower case, joined by single spaces. A
passage of length L that stands in a document with at most k edits shares at
least L + 1 - q(k + 1) character q-grams with it, on neighbouring diagonals.
So each document's q-grams are looked up among those of all items, the hits are
counted in overlapping bands of diagonals, and only bands that reach the bound
of the item's shortest window are verified by banded alignment.

The items are a stated held-out set: their q-grams are broadcast in indexes of at
most INDEX_CHARS characters or so, and the documents are searched once for each.
Documents stay in their partitions; nothing of them is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W_]+")
Q, EDITS, MIN_WORDS = 16, 1, 12
INDEX_CHARS = 4_000_000  # an index holds about 30 bytes a character
BLOCK_CHARS = 400_000
_BASE = np.uint64(1_099_511_628_211)


def normal(text: str | None) -> str:
    return " " + " ".join(WORDS.findall(text.lower())) + " " if text else " "


def qgram_hashes(text: str) -> np.ndarray:
    """Polynomial hashes of all q-grams of text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(Q):
        out = out * _BASE + codes[k : k + n]
    return out


def word_windows(text: str) -> list[tuple[int, int]]:
    """Spans of every run of MIN_WORDS words of a normal text, with the spaces around it."""
    cuts = [i for i, c in enumerate(text) if c == " "]
    return [(cuts[i], cuts[i + MIN_WORDS] + 1) for i in range(len(cuts) - MIN_WORDS)]


def banded_distance(a: str, b: str, most: int) -> int:
    """Edit distance of a to the best prefix of b, or most + 1 if it is greater; only diagonals within most are filled."""
    if b.startswith(a):
        return 0
    far = most + 1
    row = {j: j for j in range(0, min(most, len(b)) + 1)}
    for i in range(1, len(a) + 1):
        new: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            d = min(row.get(j, far) + 1, new.get(j - 1, far) + 1)
            if j:
                d = min(d, row.get(j - 1, far) + (a[i - 1] != b[j - 1]))
            new[j] = min(d, far)
        row = new
        if not row or min(row.values()) > most:
            return far
    return min(row.values())


class ItemIndex:
    """The q-grams of all passages, sorted by hash, with each passage's bound."""

    def __init__(self, passages: list[tuple[int, str, str]]):
        self.keys = [(i, f) for i, f, _ in passages]
        self.texts = [t for _, _, t in passages]
        self.windows = [word_windows(t) for t in self.texts]
        self.spans = [np.array(w, np.int64) for w in self.windows]
        self.bound = np.array([max(1, min(b - a for a, b in w) + 1 - Q * (EDITS + 1)) for w in self.windows], np.int64)
        hashes = [qgram_hashes(t) for t in self.texts]
        gram = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        at = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.owner, self.at = owner[order], at[order]
        self.gram, first = np.unique(gram[order], return_index=True)
        self.first = np.append(first, len(gram))
        self.longest = max(map(len, self.texts), default=0)

    def verify(self, doc: str, passage: int, at: np.ndarray, diagonals: list[int]) -> tuple[int, bool] | None:
        """Fewest edits of a window on this band, and whether one stands word for word.

        at: sorted places of the band's hits in the passage. Only windows that hold as
        many of them as the lemma asks for are aligned, on the band's diagonals.
        """
        best, text, spans = EDITS + 1, self.texts[passage], self.spans[passage]
        shared = np.searchsorted(at, spans[:, 1] - Q, "right") - np.searchsorted(at, spans[:, 0])
        for a, b in spans[shared >= spans[:, 1] - spans[:, 0] + 1 - Q * (EDITS + 1)].tolist():
            for start in {max(0, a + d) for d in diagonals}:
                best = min(best, banded_distance(text[a:b], doc[start : start + b - a + EDITS], min(best, EDITS)))
                if not best:
                    return 0, True
        return (best, False) if best <= EDITS else None

    def search(self, docs: list[str]) -> Iterator[tuple[int, int, int, bool]]:
        """(document index, passage, edits, exact) of every verified band."""
        if not len(self.gram):
            return
        joined, starts = "\0".join(docs), np.cumsum([0] + [len(d) + 1 for d in docs])
        h = qgram_hashes(joined)
        at = np.searchsorted(self.gram, h)
        hit = np.flatnonzero((at < len(self.gram)) & (self.gram[np.minimum(at, len(self.gram) - 1)] == h))
        if not len(hit):
            return
        g = at[hit]
        n = self.first[g + 1] - self.first[g]
        pos = np.repeat(hit, n)
        entry = np.repeat(self.first[g], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        passage = self.owner[entry]
        doc = np.searchsorted(starts, pos, "right") - 1
        local = pos - starts[doc]
        place = self.at[entry]
        diagonal = local - place
        width = 4 * EDITS
        bands = (self.longest + len(joined)) // width + 2
        seen: set[tuple[int, int]] = set()
        for half in (0, width // 2):
            key = (doc * len(self.texts) + passage) * bands + (diagonal + self.longest + half) // width
            order = np.argsort(key, kind="stable")  # positions stay in order inside a band
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            count = np.diff(np.append(first, len(order)))
            for i in np.flatnonzero(count >= self.bound[passage[order[first]]]):
                hits = order[first[i] : first[i] + count[i]]
                d, p = int(doc[hits[0]]), int(passage[hits[0]])
                if (d, p) not in seen and (found := self.verify(docs[d], p, np.sort(place[hits]), np.unique(diagonal[hits]).tolist())):
                    if found[1]:
                        seen.add((d, p))
                    yield d, p, *found


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _searcher(index) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: ItemIndex = index.value
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), [normal(t) for t in batch["text"]]
            rows = []
            for a, b in _blocks(texts):
                rows += [(ids[a + d], *items.keys[p], e, x) for d, p, e, x in items.search(texts[a:b])]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "field", "edits", "exact"])

    return search


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, field, edits, exact: documents holding MIN_WORDS consecutive words of an item's question or reference.

    edits is the fewest edits (at most EDITS) of a verified window, exact whether
    one stands word for word. Repeated items and documents count once; passages of
    fewer words, and null texts, match nothing.
    """
    fields = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.create_map(F.lit("question"), F.col("question"), F.lit("reference"), F.col("reference"))).alias("field", "text"))
    fields = fields.where(F.length("text") > 2 * MIN_WORDS - 2).distinct()
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, field string, edits int, exact boolean"
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    chars = fields.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // INDEX_CHARS))
    found = spark.createDataFrame([], schema)
    for k in range(parts):
        part = fields if parts == 1 else fields.where(F.pmod(F.xxhash64("item_id", "field"), F.lit(parts)) == k)
        passages = [(r.item_id, r.field, t) for r in part.orderBy("item_id", "field", "text").toLocalIterator() if word_windows(t := normal(r.text))]
        if passages:
            found = found.unionByName(texts.mapInPandas(_searcher(spark.sparkContext.broadcast(ItemIndex(passages))), schema))
    return found.groupBy("doc_id", "item_id", "field").agg(F.min("edits").alias("edits"), F.max("exact").alias("exact"))
