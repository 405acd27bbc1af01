"""Records that hold essentially the same text, by banded min-hashes and sequential Bayesian verification.

Records with the same words (with repetitions) form one class; only classes are
compared. A class's min-hashes over its words, each with the number of its
occurrence, are banded: classes that agree on a whole band are candidates. Order
plays no part. Items of more than half of a kind's records make unrelated texts
alike, so bands are made of the other, rarer ones; a class with few of them has
bands over all its items as well. The numbers of bands follow from the
probability of a miss allowed to a pair right at the asked similarity; above it
misses vanish quickly. Signatures over all words of the candidates are then
compared batch by batch, first in single bits, then in bytes, and a candidate is
dropped as soon as the posterior probability of the asked similarity is below
MISS. What survives is verified on all words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.session import cut_lineage, release, small_side

WORD = re.compile(r"[^\W_]+")
LEAST = 0.8  # twice the common words by the sum of both numbers of words
BAND_MISS, MISS = 0.1, 1e-3  # at the asked similarity itself: no band over all items agrees; dropped in a batch
RARE_MISS = 0.2  # no band over rarer items agrees, for edits spread evenly over a text that has half of them
HASHES = 256  # one-byte min-hashes of a signature
RARE_ROWS, ROWS = 8, 10  # how many make a band over the rarer words, over all words
COMMON = 0.5  # share of a kind's records that hold a common item (a word for the nth time)
FEW_RARE = 0.4  # a class with a smaller share of rarer items has bands over all of them as well
BATCH = 64  # bytes compared at a time after the bits
BAND_BITS = 48
CACHE_WORDS = 500_000
SIGNATURES = 2048  # whose bands are made at a time
_SEED = np.random.default_rng(20)
_A = _SEED.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_ROUND = np.arange(2 * HASHES, dtype=np.uint64) << np.uint64(54)
_NONE = np.uint64(2**64 - 1)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def jaccard_of(least: float) -> float:
    """The least Jaccard similarity of two bags of words (with occurrence numbers) at `least`."""
    return least / (2 - least)


def rare_jaccard_of(least: float, share: float = 0.5) -> float:
    """The Jaccard similarity of the rarer words of a pair at `least` where rarer words take the place of words chosen evenly.

    share is that of the rarer words in the text; more of them give a greater similarity.
    """
    return least * share / (share + 1 - least)


def bands_needed(similarity: float, rows: int, miss: float) -> int:
    """The fewest bands of `rows` drawn from HASHES min-hashes that all disagree at this similarity with probability miss or less."""
    agree = np.arange(HASHES + 1)
    chance = np.array([float(comb(HASHES, x)) for x in agree]) * similarity**agree * (1 - similarity) ** (HASHES - agree)
    none = 1 - np.array([comb(x, rows) / comb(HASHES, rows) for x in agree])
    bands = 1
    while (chance * none**bands).sum() > miss:
        bands += 1
    return bands


def fewest_agreeing(n: int, similarity: float, by_chance: float, miss: float = MISS) -> int:
    """The fewest of n agreeing parts with which `similarity` or more keeps a posterior probability of miss.

    Parts agree with the similarity itself, or else by chance; every similarity is equally likely before.
    """
    x = np.linspace(0.0, 1.0, 4001)[1:-1]
    agree = x + (1 - x) * by_chance
    for m in range(n + 1):
        log = m * np.log(agree) + (n - m) * np.log1p(-agree)
        p = np.exp(log - log.max())
        if p[x >= similarity].sum() / p.sum() >= miss:
            return m
    return n


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _Q
    return x ^ (x >> np.uint64(32))


def items_of(words: np.ndarray) -> np.ndarray:
    """A hash of every word with the number of its occurrence; words are sorted hashes."""
    at = np.arange(len(words))
    nth = at - np.maximum.accumulate(np.where(np.concatenate(([True], words[1:] != words[:-1])), at, 0))
    return _item(words, nth)


def _item(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(words) + nth.astype(np.uint64) * _P)


def signature(items: np.ndarray) -> np.ndarray:
    """One byte of each of HASHES min-hashes, filled round by round.

    In a round every item falls into one of HASHES bins; a bin keeps the least value of
    the first round that reaches it. Two sets agree in a bin with the probability of
    their Jaccard similarity, and a few rounds fill all bins. What HASHES rounds leave
    empty takes the least value over all items.
    """
    low = np.full(HASHES, _NONE)
    step = 1 + 6 * HASHES // len(items)
    for i in range(0, HASHES, step):
        part = slice(i, min(i + step, HASHES))
        x = items[:, None] * _A[part]  # items are mixed: the high bits of a product are a hash, the others a value
        np.minimum.at(low, (x >> np.uint64(56)).view(np.int64).ravel(), (((x << np.uint64(8)) >> np.uint64(10)) | _ROUND[part]).ravel())
        if low.max() != _NONE:
            break
    else:
        empty = np.flatnonzero(low == _NONE)
        low[empty] = _mixed(items[:, None] * _A[empty]).min(axis=0)
    return _mixed(low + _P).astype(np.uint8)


_ASCII = {c: chr(c).lower() if chr(c).isalnum() else " " for c in range(128)}


def words_in(text: str) -> list[str]:
    """Runs of letters or digits in lower case."""
    return text.translate(_ASCII).split() if text.isascii() else WORD.findall(text.lower())


class _Hashes(dict):
    """A 64-bit hash of every word asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = found = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return found


def _word_hashes(words: list[str], known: _Hashes) -> np.ndarray:
    """Sorted hashes of words."""
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    hashes.sort()
    return hashes


def _occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number of a kind's records in which a word occurs exactly n times, and under a null word the number of its records; partial sums."""
    counts: dict[int, Counter] = {}

    def partial() -> pd.DataFrame:
        rows = [(kind, word, n, records) for kind, found in counts.items() for (word, n), records in found.items()]
        return pd.DataFrame(rows, columns=["kind_id", "word", "n", "records"])

    for batch in batches:
        for kind, text in zip(batch["kind_id"].tolist(), batch["text"]):
            if words := Counter(words_in(text)):
                found = counts.setdefault(kind, Counter())
                found.update(words.items())
                found[None, 0] += 1
                if len(found) > CACHE_WORDS:
                    yield partial()
                    counts.clear()
    yield partial()


def common_items(named: DataFrame) -> dict[int, np.ndarray]:
    """By kind, the items in more than COMMON of its records: at most 1 / COMMON times the mean number of words of a record."""
    counts = named.select("kind_id", "text").mapInPandas(_occurrences, "kind_id int, word string, n int, records long")
    counts = cut_lineage(counts.groupBy("kind_id", "word", "n").agg(F.sum("records").alias("records")))
    sizes = counts.where("word is null").select("kind_id", F.col("records").alias("size"))
    # A word that occurs n times makes n items.
    items = counts.where("word is not null").select("kind_id", "word", "records", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("nth"))
    items = items.groupBy("kind_id", "word", "nth").agg(F.sum("records").alias("records"))
    rows = items.join(sizes, "kind_id").where(F.col("records") > COMMON * F.col("size")).select("kind_id", "word", "nth").toPandas()
    release(counts)
    known = _Hashes()
    items = lambda g: _item(np.array([known[w] for w in g["word"]], np.uint64), g["nth"].to_numpy())
    return {int(k): np.sort(items(g)) for k, g in rows.groupby("kind_id")}


def _sketch(common: dict[int, np.ndarray]):
    none = np.empty(0, np.uint64)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for batch in batches:
            rows = []
            for kind, key, text_id, kind_id, text in batch.itertuples(index=False, name=None):
                if not (words := words_in(text)):
                    continue
                hashes = _word_hashes(words, known)
                items = items_of(hashes)
                frequent = common.get(kind_id, none)
                at = np.searchsorted(frequent, items)
                rare = frequent[np.minimum(at, len(frequent) - 1)] != items if len(frequent) else np.ones(len(items), bool)
                name = _mixed(items.sum(keepdims=True) + np.array([kind_id & 0xFFFFFFFF], np.uint64) * _P + np.uint64(len(words)))
                of_rare = signature(items[rare]).tobytes() if rare.any() else b""
                rows.append((kind, key, text_id, int(name.view(np.int64)[0]), len(words), bool(np.count_nonzero(rare) < FEW_RARE * len(rare)), of_rare, signature(items).tobytes()))
            yield pd.DataFrame(rows, columns=["kind", "key", "text_id", "class_id", "n", "few_rare", "rare_sig", "sig"])

    return sketch


def sketched(records: DataFrame) -> DataFrame:
    """kind, key, text_id, class_id, n, few_rare, rare_sig, sig of records (kind, key, text), written once; texts stay where they are.

    Texts without words are in no class. A key with several texts is a member with
    each. A class is named by a hash of its kind and all its words, whatever their order.
    """
    named = records.where(F.col("key").isNotNull() & F.col("text").isNotNull()).select("kind", "key", F.xxhash64("kind", "text").alias("text_id"), F.hash("kind").alias("kind_id"), "text")
    schema = "kind string, key string, text_id long, class_id long, n int, few_rare boolean, rare_sig binary, sig binary"
    return cut_lineage(named.mapInPandas(_sketch(common_items(named)), schema))


def _bands(rare_bands: int, all_bands: int):
    rng = np.random.default_rng(21)
    family = []
    for n_bands, rows in ((rare_bands, RARE_ROWS), (all_bands, ROWS)):
        picks = np.stack([rng.choice(HASHES, rows, replace=False) for _ in range(n_bands)])
        family.append((picks, rng.integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1), rng.integers(1, 2**63, n_bands, dtype=np.uint64)))
    mask = np.uint64(2**BAND_BITS - 1)

    def of(sigs: pd.Series, kinds: np.ndarray, which: int) -> np.ndarray:
        picks, mix, number = family[which]
        bytes_ = np.frombuffer(b"".join(map(bytes, sigs)), np.uint8).reshape(-1, HASHES)
        own = number + kinds[:, None]
        for k in range(picks.shape[1]):
            own = own + bytes_[:, picks[:, k]] * mix[k]
        return (_mixed(_mixed(own)) & mask).view(np.int64)

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds = batch["kind_id"].to_numpy().astype(np.uint32).astype(np.uint64)
            for which, held in ((0, batch["rare_sig"].str.len().to_numpy() > 0), (1, batch["few_rare"].to_numpy(bool))):
                part, its = batch[held], kinds[held]
                for i in range(0, len(part), SIGNATURES):
                    few = part.iloc[i : i + SIGNATURES]
                    yield pd.DataFrame({"id": few["id"], "n": few["n"], "bands": list(of(few["sig" if which else "rare_sig"], its[i : i + SIGNATURES], which))})

    return bands


def _by_batches(similarity: float):
    """Compare the signatures of pairs BATCH bytes at a time; the posterior drops pairs after each batch."""
    least = {n: fewest_agreeing(n, similarity, 1 / 256) for n in range(BATCH, HASHES + 1, BATCH)}

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(map(bytes, batch[s])), np.uint8).reshape(-1, HASHES) for s in ("sig_a", "sig_b"))
            alive, matches = np.arange(len(batch)), np.zeros(len(batch), np.int64)
            for n, fewest in least.items():
                part = slice(n - BATCH, n)
                matches = matches + (x[alive, part] == y[alive, part]).sum(axis=1)
                kept = matches >= fewest
                alive, matches = alive[kept], matches[kept]
            yield batch[["a", "b"]].iloc[alive]

    return compare


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        similarity = []
        for a, b in zip(batch["text_a"], batch["text_b"]):
            x, y = words_in(a), words_in(b)
            similarity.append(2 * (Counter(x) & Counter(y)).total() / (len(x) + len(y)))
        yield batch[["a", "b"]].assign(similarity=np.array(similarity, float))


def class_links(records: DataFrame, sketches: DataFrame, least: float = LEAST, *used: DataFrame) -> DataFrame:
    """a, b, similarity: names of classes of one kind with different words at `least` or more, a < b.

    sketches are those of records, and tables given as used are deleted once read. Band rows hold 14 bytes or so: a band, a running
    number and the number of words, which alone bounds the similarity. One-bit
    min-hashes are compared first, whole signatures only for what they leave, and
    texts move only where a pair is left to be verified. A band that very many
    classes share is split by Spark's skew join.
    """
    similarity = jaccard_of(least)
    first = [F.first(c).alias(c) for c in ("kind", "n", "few_rare", "rare_sig", "sig")]
    whole = sketches.groupBy("class_id").agg(F.min("text_id").alias("text_id"), *first)
    classes = cut_lineage(whole.select(F.monotonically_increasing_id().alias("id"), F.hash("kind").alias("kind_id"), "class_id", "text_id", "n", "few_rare", "rare_sig", "sig"), *used)
    bands = _bands(bands_needed(rare_jaccard_of(least), RARE_ROWS, RARE_MISS), bands_needed(similarity, ROWS, BAND_MISS))
    banded = classes.select("id", "kind_id", "n", "few_rare", "rare_sig", "sig").mapInPandas(bands, "id long, n int, bands array<long>")
    rows = banded.select("id", "n", F.explode("bands").alias("band"))
    side = lambda k: rows.select("band", F.col("id").alias(k), F.col("n").alias(f"n_{k}"))
    may_reach = 2 * F.least("n_a", "n_b") >= least * (F.col("n_a") + F.col("n_b")) - 1e-9
    # Partitioned by one side only: the next join needs no further exchange.
    pairs = cut_lineage(side("a").join(side("b").hint("shuffle_hash"), "band").where((F.col("a") < F.col("b")) & may_reach).select("a", "b").repartition("a").dropDuplicates(["a", "b"]))
    bits = classes.select("id", "sig").mapInPandas(_low_bits, "id long, " + ", ".join(f"w{k} long" for k in range(HASHES // 64)))
    side = lambda k: bits.select(F.col("id").alias(k), *[F.col(f"w{i}").alias(f"w{i}_{k}") for i in range(HASHES // 64)])
    differ = sum((F.bit_count(F.col(f"w{i}_a").bitwiseXOR(F.col(f"w{i}_b"))) for i in range(HASHES // 64)), F.lit(0))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(differ <= HASHES - fewest_agreeing(HASHES, similarity, 0.5)).select("a", "b")
    near = cut_lineage(near, pairs)
    side = lambda k: classes.select(F.col("id").alias(k), F.col("sig").alias(f"sig_{k}"))
    pairs = cut_lineage(near.join(side("a"), "a").join(side("b"), "b").mapInPandas(_by_batches(similarity), "a long, b long"), near)
    named = classes.select("id", "class_id", "text_id")
    needed = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    needed = cut_lineage(named.join(small_side(needed), "id", "left_semi"), classes)
    texts = records.where(F.col("key").isNotNull()).select(F.xxhash64("kind", "text").alias("text_id"), "text").join(small_side(needed.select("text_id").distinct()), "text_id", "left_semi")
    texts = needed.join(texts.groupBy("text_id").agg(F.min("text").alias("text")), "text_id")
    side = lambda k: texts.select(F.col("id").alias(k), F.col("text").alias(f"text_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_verify, "a long, b long, similarity double").where(F.col("similarity") >= least)
    side = lambda k: needed.select(F.col("id").alias(k), F.col("class_id").alias(f"class_{k}"))
    links = both.join(side("a"), "a").join(side("b"), "b")
    x, y = F.least("class_a", "class_b"), F.greatest("class_a", "class_b")
    return cut_lineage(links.select(x.alias("a"), y.alias("b"), "similarity"), pairs, needed)


def _low_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lowest bit of every min-hash, packed into words."""
    for batch in batches:
        sigs = np.frombuffer(b"".join(map(bytes, batch["sig"])), np.uint8).reshape(-1, HASHES)
        words = np.packbits(sigs & 1, axis=1).view(np.int64)
        yield pd.DataFrame({"id": batch["id"]} | {f"w{k}": words[:, k] for k in range(words.shape[1])})


def near_duplicate_pairs(records: DataFrame, least: float = LEAST) -> DataFrame:
    """kind, key_a, key_b of every two records of one kind at `least` or more, the smaller key first.

    records(kind, key, text). Null keys, null texts and texts without words match
    nothing; repeated rows count once.
    """
    sketches = sketched(records)
    members = cut_lineage(sketches.select("kind", "key", "class_id").distinct())
    links = class_links(records, sketches, least, sketches).select("a", "b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    same = members.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    left = members.select("kind", F.col("key").alias("key_a"), F.col("class_id").alias("a"))
    right = members.select(F.col("kind").alias("kind_b"), F.col("key").alias("key_b"), F.col("class_id").alias("b"))
    pairs = both.unionByName(same).join(left, "a").join(right, "b").where("kind = kind_b and key_a < key_b")
    return pairs.select("kind", "key_a", "key_b").distinct()


def near_duplicate_groups(records: DataFrame, least: float = LEAST) -> DataFrame:
    """kind, key, group_id, n_links: one row per record; group_id is the smallest class of its connected classes.

    Labels shrink to the smallest neighbouring label, and to that label's own
    label, until none changes; every round is a join and an aggregation over links.
    """
    sketches = sketched(records)
    members = cut_lineage(sketches.select("kind", "key", "class_id").distinct())
    links = class_links(records, sketches, least, sketches).select("a", "b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    before = label = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, "a").select("a", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = step.join(step.select(F.col("a").alias("label"), F.col("label").alias("further")), "label", "left")
        new = cut_lineage(jump.select("a", F.least("label", F.coalesce("further", "label")).alias("label"), "old"), before)
        before, label = new, new.drop("old")
        if new.where("label <> old").isEmpty():
            break
    degree = both.groupBy(F.col("a").alias("class_id")).agg(F.count("*").alias("n_links"))
    named = members.join(label.withColumnRenamed("a", "class_id"), "class_id", "left").join(degree, "class_id", "left")
    return named.select("kind", "key", F.coalesce("label", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
