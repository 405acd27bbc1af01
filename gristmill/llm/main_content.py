"""Main content of web pages by a recurrent block labeller.

A page is a sequence of blocks, its lines. Every block becomes a vector of its
place and shape (the tag path, as far as text keeps it) and of its hashed words;
a bidirectional LSTM in numpy reads the whole sequence and labels each block as
content or as the site's surroundings. It is trained on a bounded sample of pages
whose labels come from counts over all pages: lines that recur on documents of most
types, and do not stand before paragraphs, are the site's; long sentences, table
rows, the document's own title and lines that recur within few types are content;
short lines between lines of the site belong to it. A few words that any web page
uses for its controls help; what none of this decides is left out of the training
and goes by context. Every page is labelled whole, in its own partition, whatever
its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 1200  # bound of the labelled sample
WORD_BUCKETS, SHAPES, HIDDEN = 192, 20, 24
EPOCHS, BATCH, RATE, WORD_DROP = 5, 16, 0.006, 0.08
WINDOW, OVERLAP = 400, 40  # a longer page is trained on in overlapping windows
BLOCK = 5000  # a longer page is labelled in blocks that hand on the network's state
LEAST_DOCS = 5  # a line recurs from so many documents on
WORD = re.compile(r"[^\W_]+")
MARKS = re.compile(r"^[\s•›»·*⌕☰©>-]+|[\s›»]+$")

# Words of web pages in general: controls, notices and link lists, matched from a line's beginning.
CONTROL = re.compile(
    r"(?:skip to |home(?:$| [>|/»])|menu$|search(?:$|\b.{0,30}$)|share\b|print (?:this|page)|listen to |e-?mail this|cite this|you are here|tags?:|topics?:|filed under|last updated?"
    r"|page (?:last )?modified|was this page|back to top|accessibility|contact us|subscribe|sign up|follow us|rss\b|privacy|your privacy|terms of use|site ?map"
    r"|related (?:content|information|links)|see also$|read (?:next|more)|more (?:on|from) |(?:most|popular) (?:read|now)|trending|you may also like|further reading|accept|decline|reject"
    r"|allow |got it$|ok$|close$|continue$|no thanks|i agree|manage (?:cookies|preferences)|cookie settings|learn more)"
)
NOTICE = re.compile(r"\bcookies?\b|\byour inbox\b|\bon your device\b")
BULLET = re.compile(r"^\s*[•*·-]\s")
STOP_END = re.compile(r"[.!?][\"'”’)]*$")
SENTENCE_END = re.compile(r"[.!?:;][\"'”’)]*$")
UNKNOWN = -1


def plain(line: str) -> str:
    return MARKS.sub("", " ".join(line.split()).lower())


def line_key(line: str) -> str:
    """A line's letters in lower case: numbers, dates and marks may differ."""
    return "".join(c for c in line.lower() if c.isalpha())


def is_sentence(line: str) -> bool:
    return bool(STOP_END.search(line.strip())) and len(WORD.findall(line)) >= 12


def seed_labels(lines: list[str], facts: dict[str, tuple[int, int, float]] | None = None, n_types: int = 1, title: str | None = None) -> np.ndarray:
    """1 for the site's surroundings, 0 for content, UNKNOWN where neither is sure, of one page's non-blank lines.

    facts: of a line's key the number of documents and of their types that have it, and
    the share of its places right before a sentence.
    """
    n, facts, own = len(lines), facts or {}, line_key(title or "")
    out, words = np.full(n, UNKNOWN, np.int8), [len(WORD.findall(x)) for x in lines]
    for i, line in enumerate(lines):
        key, flat = line_key(line), plain(line)
        docs, types, before = facts.get(key, (1, 1, 0.0))
        if CONTROL.match(flat) and len(flat) < 120 or NOTICE.search(flat) and len(flat) < 300:
            out[i] = 1
        elif "|" in line and any(c.isdigit() for c in line.rsplit("|", 1)[1]) or is_sentence(line) and docs <= 2 or own and key == own:
            out[i] = 0
        elif docs >= LEAST_DOCS and types * 2 >= n_types and before < 0.25 and not BULLET.match(line):
            out[i] = 1
        elif docs >= 3 and before >= 0.5 and words[i] <= 12 or docs >= LEAST_DOCS and types * 3 <= n_types and words[i] >= 3:
            out[i] = 0
    known = np.flatnonzero(out != UNKNOWN)
    for a, b in zip([-1, *known.tolist()], [*known.tolist(), n]):
        run = range(a + 1, b)
        above, below = out[a] if a >= 0 else 1, out[b] if b < n else 1
        if not run:
            continue
        if above == 1 and below == 1 and a >= 0 and all(words[i] <= 16 and not STOP_END.search(lines[i].strip()) for i in run):
            out[a + 1 : b] = 1  # a list of links
        elif above == 0 and (all(BULLET.match(lines[i]) for i in run) or below == 0 and len(run) == 1):
            out[a + 1 : b] = 0
    return out


_SEEN: dict[str, int] = {}


def _bucket(word: str) -> int:
    if (b := _SEEN.get(word)) is None:
        if len(_SEEN) > 300_000:
            _SEEN.clear()
        b = _SEEN[word] = crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
    return b


def block_vectors(lines: list[str], drop: float = 0.0, rng: np.random.Generator | None = None, part: slice = slice(None)) -> np.ndarray:
    """Vectors of one page's non-blank lines, or a part of them: SHAPES values of place and form on the whole page, then hashed words of unit length."""
    n, first = len(lines), part.indices(len(lines))[0]
    lines = lines[part]
    out = np.zeros((len(lines), SHAPES + WORD_BUCKETS), np.float32)
    for j, line in enumerate(lines):
        i = first + j
        words = WORD.findall(line.lower())
        stripped = line.strip()
        letters = sum(c.isalpha() for c in stripped) or 1
        out[j, :SHAPES] = (
            1, min(i, 20) / 20, min(n - 1 - i, 20) / 20, i / n, min(len(words), 40) / 40, len(words) <= 3, 4 <= len(words) <= 12, len(words) > 25,
            bool(SENTENCE_END.search(stripped)), stripped.endswith("."), "|" in stripped, stripped.count("|") > 3, stripped[:1] in "•-*·", stripped[-1:] in "›»", ">" in stripped,
            sum(c.isupper() for c in stripped) / letters > 0.7, stripped[:1].isdigit(), sum(c.isdigit() for c in stripped) / max(1, len(stripped)), ":" in stripped, "(" in stripped,
        )
        if rng is not None and drop:
            words = [w for w, kept in zip(words, rng.random(len(words)) >= drop) if kept]
        if words:
            for at, w in enumerate(words[:3]):
                out[j, SHAPES + _bucket(f"{at}:{w}")] += 1  # the beginning, in order
            tail = [_bucket(w) for w in words]
            np.add.at(out[j, SHAPES:], tail, 1)
            out[j, SHAPES:] /= np.linalg.norm(out[j, SHAPES:])
    return out


class BiLSTM:
    """Bidirectional LSTM with one output per step; pages of different length are padded and masked."""

    def __init__(self, seed: int = 3):
        rng, d, h = np.random.default_rng(seed), SHAPES + WORD_BUCKETS, HIDDEN
        self.w = {}
        for k in "fb":
            self.w[f"x{k}"] = (rng.normal(size=(d, 4 * h)) / np.sqrt(24)).astype(np.float32)
            self.w[f"h{k}"] = (rng.normal(size=(h, 4 * h)) / np.sqrt(h)).astype(np.float32)
            self.w[f"c{k}"] = np.zeros(4 * h, np.float32)
            self.w[f"c{k}"][h : 2 * h] = 1
        self.w["o"] = (rng.normal(size=(2 * h, 1)) / np.sqrt(2 * h)).astype(np.float32)
        self.w["p"] = np.zeros(1, np.float32)

    def _run(self, k: str, x: np.ndarray, mask: np.ndarray, keep: list | None, state: list | None = None) -> np.ndarray:
        """Outputs in direction k; state (cell and output) is read at the beginning and written at the end."""
        steps, size, h = x.shape[0], x.shape[1], HIDDEN
        into = x @ self.w[f"x{k}"] + self.w[f"c{k}"]
        out = np.zeros((steps, size, h), np.float32)
        c, y = state if state else (np.zeros((size, h), np.float32), np.zeros((size, h), np.float32))
        for t in range(steps) if k == "f" else range(steps - 1, -1, -1):
            z = into[t] + y @ self.w[f"h{k}"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            g = np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            m = mask[t][:, None]
            c_new = m * (f * c + i * g)
            th = np.tanh(c_new)
            y_new = m * (o * th)
            if keep is not None:
                keep.append((t, i, f, o, g, c, th, y, m))
            c, y = c_new, y_new
            out[t] = y
        if state is not None:
            state[:] = c, y
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        both = np.concatenate([self._run(k, x, mask, None if keep is None else keep.setdefault(k, [])) for k in "fb"], axis=2)
        if keep is not None:
            keep["both"] = both
        return (both @ self.w["o"])[:, :, 0] + self.w["p"]

    def scores_in_blocks(self, lines: list[str], size: int) -> np.ndarray:
        """The scores of one page of any length: each direction hands its state from block to block, so they are those of the whole page."""
        both = []
        for k in "fb":
            state: list = []
            starts = range(0, len(lines), size)
            parts = {}
            for a in starts if k == "f" else reversed(starts):
                x = block_vectors(lines, part=slice(a, a + size))[:, None]
                parts[a] = self._run(k, x, np.ones(x.shape[:2], np.float32), None, state)
            both.append(np.concatenate([parts[a] for a in starts]))
        return (np.concatenate(both, axis=2) @ self.w["o"])[:, 0, 0] + self.w["p"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the loss over all steps whose label is known (0 or 1)."""
        keep: dict = {}
        p = 1 / (1 + np.exp(-np.clip(self.scores(x, mask, keep), -30, 30)))
        told = mask * (labels >= 0)
        d = ((p - labels) * told / max(1.0, told.sum())).astype(np.float32)
        grad = {"p": np.array([d.sum()], np.float32), "o": np.einsum("tbh,tb->h", keep["both"], d)[:, None]}
        d_both = d[:, :, None] * self.w["o"][:, 0]
        h = HIDDEN
        for n, k in enumerate("fb"):
            d_out = d_both[:, :, n * h : (n + 1) * h]
            dz_all, dw_h = np.zeros((*x.shape[:2], 4 * h), np.float32), np.zeros_like(self.w[f"h{k}"])
            dy, dc = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            for t, i, f, o, g, c, th, y, m in reversed(keep[k]):
                dy_t = (dy + d_out[t]) * m
                dc_t = (dc + dy_t * o * (1 - th * th)) * m
                dz = np.concatenate([dc_t * g * i * (1 - i), dc_t * c * f * (1 - f), dy_t * th * o * (1 - o), dc_t * i * (1 - g * g)], axis=1)
                dz_all[t] = dz
                dw_h += y.T @ dz
                dy, dc = dz @ self.w[f"h{k}"].T, dc_t * f
            grad[f"h{k}"] = dw_h
            flat = dz_all.reshape(-1, 4 * h)
            grad[f"x{k}"] = x.reshape(-1, x.shape[2]).T @ flat
            grad[f"c{k}"] = flat.sum(axis=0)
        return grad


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), SHAPES + WORD_BUCKETS), np.float32), np.zeros((steps, len(pages)), np.float32)
    for j, page in enumerate(pages):
        x[: len(page), j], mask[: len(page), j] = page, 1
    return x, mask


def windows(n: int) -> list[int]:
    """First lines of the overlapping windows over a page of n lines."""
    return [a for a in range(0, n, WINDOW - 2 * OVERLAP) if a == 0 or a + 2 * OVERLAP < n]


def fit(pages: list[list[str]], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 3) -> BiLSTM:
    """Train by Adam on whole pages, longer ones in windows whose vectors are those of the whole page."""
    rng, model = np.random.default_rng(seed), BiLSTM(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    pieces = [(i, a) for i, p in enumerate(pages) for a in windows(len(p))]
    for epoch in range(epochs):
        order = rng.permutation(len(pieces))
        order = order[np.argsort([min(len(pages[i]) - a, WINDOW) // 8 for i, a in (pieces[k] for k in order)], kind="stable")]
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for b in rng.permutation(len(batches)):
            x, mask = _padded([block_vectors(pages[i], WORD_DROP, rng)[a : a + WINDOW] for i, a in (pieces[k] for k in batches[b])])
            y = np.zeros(mask.shape, np.float32)
            for j, (i, a) in enumerate(pieces[k] for k in batches[b]):
                y[: len(labels[i][a : a + WINDOW]), j] = labels[i][a : a + WINDOW]
            step += 1
            rate = RATE * (0.5 if epoch >= epochs - 2 else 1.0)
            for k, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.w[k] = (model.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def label_pages(model: BiLSTM, pages: list[list[str]], size: int = 64) -> list[np.ndarray]:
    """Whether each non-blank line of each page belongs to the surroundings; every page is read whole."""
    out = [np.zeros(len(p), bool) for p in pages]
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    long = [i for i in order if len(pages[i]) > BLOCK]
    for i in long:
        out[i] = model.scores_in_blocks(pages[i], BLOCK) > 0
    order, j = order[: len(order) - len(long)], 0
    while j < len(order):
        part = order[j : j + size]
        while len(part) > 1 and len(part) * len(pages[part[-1]]) > size * WINDOW:  # long pages go in smaller batches
            part = part[: len(part) // 2]
        x, mask = _padded([block_vectors(pages[i]) for i in part])
        scores = model.scores(x, mask)
        for col, i in enumerate(part):
            out[i] = scores[: len(pages[i]), col] > 0
        j += len(part)
    return out


def _lines(text: str | None) -> tuple[list[int], list[str]]:
    found = [(i, x) for i, x in enumerate((text or "").split("\n"), 1) if x.strip()]
    return [i for i, _ in found], [x for _, x in found]


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, kind, text in zip(batch["doc"], batch["doc_type"], batch["text"]):
            lines = _lines(text)[1]
            rows += [(line_key(x), doc, kind, bool(y and is_sentence(y))) for x, y in zip(lines, [*lines[1:], None])]
        yield pd.DataFrame(rows, columns=["key", "doc", "doc_type", "before"])


def line_facts(pages: DataFrame, keys: list[str]) -> tuple[dict[str, tuple[int, int, float]], int]:
    """By key of a line the number of documents and of their types that have it and the share of its places before a sentence, counted over all pages; and the number of types."""
    spark = pages.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(k,) for k in sorted(set(keys))], "key string"))  # of at most TRAIN_PAGES pages
    held = pages.select(F.xxhash64("doc_id").alias("doc"), F.coalesce("doc_type", F.lit("")).alias("doc_type"), "text")
    each = held.mapInPandas(_places, "key string, doc long, doc_type string, before boolean").join(wanted, "key", "left_semi")
    by_doc = each.groupBy("key", "doc", "doc_type").agg(F.count("*").alias("n"), F.count_if("before").alias("before"))
    counts = by_doc.groupBy("key").agg(F.count_distinct("doc").alias("docs"), F.count_distinct("doc_type").alias("types"), (F.sum("before") / F.sum("n")).alias("share"))
    types = held.agg(F.count_distinct("doc_type")).first()[0]
    return {r.key: (r.docs, r.types, r.share) for r in counts.collect()}, types


def train(pages: DataFrame, most: int = TRAIN_PAGES, seed: int = 3) -> BiLSTM | None:
    """Fit the labeller on at most `most` pages, those with the smallest seeded hash; None where no page has lines.

    pages may name each document's doc_type and title.
    """
    for name in ("doc_type", "title"):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast("string"))
    drawn = pages.where(F.length("text") > 0).select("text", "title", F.xxhash64("doc_id", "page", F.lit(seed)).alias("u"))
    # Hashes first: a sort of whole rows would send `most` texts of every partition to the driver.
    last = drawn.select("u").orderBy("u").limit(most).agg(F.max("u")).first()[0]
    rows = drawn.where(F.col("u") <= F.lit(last)).orderBy("u", "text").limit(most).collect() if last is not None else []
    sample = [(x, r.title) for r in rows if (x := _lines(r.text)[1])]
    if not sample:
        return None
    facts, types = line_facts(pages, [line_key(x) for lines, _ in sample for x in lines])
    return fit([x for x, _ in sample], [seed_labels(x, facts, types, title) for x, title in sample], seed=seed)


_FITTED: dict[tuple, BiLSTM | None] = {}


def fitted_once(pages: DataFrame, *name: str) -> BiLSTM | None:
    """The model trained on pages, kept for this application under a name."""
    key = (pages.sparkSession.sparkContext.applicationId, *name)
    if key not in _FITTED:
        _FITTED[key] = train(pages)
    return _FITTED[key]


def boilerplate_lines(pages: DataFrame, model: BiLSTM | None = None) -> DataFrame:
    """doc_id, page, line_no: the non-blank lines of pages (doc_id, page, text) that are the site's surroundings.

    Lines count from 1, empty ones included. Pages ingested twice count once, null
    and empty texts have no lines; other columns are ignored.
    """
    once = pages.select("doc_id", "page", "text").where(F.col("text").isNotNull()).groupBy("doc_id", "page").agg(F.min("text").alias("text"))
    model = model or train(pages)
    kind = {f.name: f.dataType.simpleString() for f in once.schema}
    schema = f"doc_id {kind['doc_id']}, page {kind['page']}, line_no int"
    if model is None:
        return once.sparkSession.createDataFrame([], schema)
    shared = once.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbered = [_lines(t) for t in batch["text"]]
            marks = label_pages(shared.value, [x for _, x in numbered])
            picked = [np.array(n, np.int32)[m] if n else np.empty(0, np.int32) for (n, _), m in zip(numbered, marks)]
            sizes = [len(x) for x in picked]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].repeat(sizes).to_numpy(), "page": batch["page"].repeat(sizes).to_numpy(),
                "line_no": np.concatenate(picked) if picked else np.empty(0, np.int32),
            })

    return once.mapInPandas(apply, schema)


def main_content(pages: DataFrame, model: BiLSTM | None = None) -> DataFrame:
    """doc_id, page, text: each page's own lines, in order; a page without any keeps an empty text."""
    once = pages.select("doc_id", "page", "text").groupBy("doc_id", "page").agg(F.min("text").alias("text"))
    gone = boilerplate_lines(pages, model).groupBy("doc_id", "page").agg(F.collect_set("line_no").alias("gone"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: ~F.coalesce(F.array_contains("gone", (i + 1).cast("int")), F.lit(False)))
    return once.join(gone, ["doc_id", "page"], "left").select("doc_id", "page", F.array_join(lines, "\n").alias("text"))
