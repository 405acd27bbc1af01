"""Multi-line blocks repeated across one source's documents.

Every line becomes a 64-bit identifier of its letters and digits. The suffixes of
all pages' identifier sequences are named by prefix doubling, which builds the
suffix array of each source's concatenated lines without sorting it in one place:
after k rounds two suffixes have one name if their first 2**k lines are equal, and
a round is a join of names half a length apart and an aggregation over all rows.
Suffixes whose common prefix stands in too few of the source's documents leave the
rounds at once. The longest common prefixes that stand in enough documents are the
blocks; the lines they cover are the repeated ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.session import cut_lineage, release


def line_key(line: Column) -> Column:
    """Letters and digits of a line in lower case; empty for a line without any."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", "")


def identified_lines(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, page, source (name), lines: array of (line_no, lid); lines without letters or digits are left out.

    pages(doc_id, page, text), sources(doc_id, source). A page whose document has
    no source counts under the source ''. Null texts have no lines.
    """
    pages = pages.select("doc_id", "page", "text").where(F.col("text").isNotNull())
    named = pages.join(sources.select("doc_id", F.coalesce("source", F.lit("")).alias("source")), "doc_id", "left")
    ids = F.filter(
        F.transform(
            F.split("text", "\n"),
            lambda x, i: F.struct((i + 1).alias("line_no"), line_key(x).alias("key")),
        ),
        lambda x: x["key"] != "",
    )
    return named.select("doc_id", "page", F.coalesce("source", F.lit("")).alias("source"), ids.alias("keyed")).select(
        "doc_id", "page", "source",
        F.transform("keyed", lambda x: F.struct(x["line_no"].alias("line_no"), F.xxhash64(x["key"]).alias("lid"))).alias("lines"),
    )


def longest_blocks(lines: DataFrame, share: float = 0.2, least: int = 5) -> DataFrame:
    """source (hashed), doc_id, page, first_line, last_line, n_lines, n_docs: every place of a repeated block that can't be made longer there.

    A block's lines follow each other, lines without letters and digits left out,
    and the whole block stands in n_docs of the source's documents: at least share
    of them, and at least `least`. Blocks of 2, 4, 8, ... lines are made of two of
    half the length until none is repeated. A place where the longest of these has
    n lines begins repeated blocks of less than 2 n lines; all their lengths are then
    counted at once, so a block is counted wherever it stands in a longer one too.
    """
    once = lines.dropDuplicates(["doc_id", "page"])
    sizes = once.groupBy(F.xxhash64("source").alias("source")).agg(F.count_distinct("doc_id").alias("source_docs"))
    at = ["doc_id", "page", "at"]
    tables: list[DataFrame] = []

    def repeated(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("source", "key").agg(F.count_distinct("doc_id").alias("n_docs")).join(sizes, "source")
        kept = counts.where((F.col("n_docs") >= least) & (F.col("n_docs") >= F.col("source_docs") * share - 1e-9))
        tables.append(cut_lineage(rows.join(kept.select("source", "key", "n_docs"), ["source", "key"])))
        return tables[-1]

    each = once.select(F.xxhash64("source").alias("source"), "doc_id", "page", F.posexplode("lines").alias("at", "l"))
    each = each.select("source", *at, F.col("l.line_no").alias("line_no"), F.col("l.lid").alias("key"))
    numbers = repeated(each)
    levels = [numbers.select("source", *at, "key")]
    while True:
        half = 2 ** (len(levels) - 1)
        after = levels[-1].select("doc_id", "page", (F.col("at") - half).alias("at"), F.col("key").alias("more"))
        longer = repeated(levels[-1].join(after, at).select("source", *at, F.xxhash64("key", "more").alias("key")))
        if longer.isEmpty():
            break
        levels.append(longer.select("source", *at, "key"))
    bound = levels[0].select(*at, F.lit(1).alias("most"))
    for k, level in enumerate(levels[1:], 1):
        bound = bound.unionByName(level.select(*at, F.lit(2 ** (k + 1) - 1).alias("most")))
    bound = bound.groupBy(*at).agg(F.max("most").alias("most")).groupBy("doc_id", "page").agg(F.collect_list(F.struct("at", "most")).alias("starts"))
    ids = once.select(F.xxhash64("source").alias("source"), "doc_id", "page", F.transform("lines", lambda x: x["lid"]).alias("ids"))
    lengths = lambda x: F.sequence(F.lit(1), F.least(x["most"], F.size("ids") - x["at"]))
    block = lambda x, n: F.struct(x["at"].alias("at"), n.alias("n_lines"), F.xxhash64(n, F.slice("ids", x["at"] + 1, n)).alias("key"))
    tried = ids.join(bound, ["doc_id", "page"]).select("source", "doc_id", "page", F.explode(F.flatten(F.transform("starts", lambda x: F.transform(lengths(x), lambda n: block(x, n))))).alias("b"))
    found = repeated(tried.select("source", "doc_id", "page", "b.*"))
    places = found.groupBy("source", *at).agg(F.max("n_lines").alias("n_lines"), F.max_by("n_docs", "n_lines").alias("n_docs"))
    before = Window.partitionBy("doc_id", "page").orderBy("at")
    end = F.col("at") + F.col("n_lines")
    whole = places.withColumn("reached", F.lag(end).over(before)).where(F.col("reached").isNull() | (F.col("reached") < end))
    last = numbers.select("doc_id", "page", F.col("at").alias("end"), F.col("line_no").alias("last_line"))
    named = whole.withColumn("end", end - 1).join(last, ["doc_id", "page", "end"]).join(numbers.select(*at, F.col("line_no").alias("first_line")), at)
    out = cut_lineage(named.select("source", "doc_id", "page", "first_line", "last_line", "n_lines", "n_docs"))
    release(numbers, *tables)
    return out


def repeated_lines(lines: DataFrame, share: float = 0.2, least: int = 5) -> DataFrame:
    """doc_id, page, line_no of every line that a repeated block covers, each once; a line repeated alone is a block of one line."""
    blocks = longest_blocks(lines, share, least).groupBy("doc_id", "page").agg(F.collect_list(F.struct("first_line", "last_line")).alias("blocks"))
    inside = lambda n: F.exists("blocks", lambda b: (b["first_line"] <= n) & (n <= b["last_line"]))
    once = lines.dropDuplicates(["doc_id", "page"]).join(blocks, ["doc_id", "page"])
    return once.select("doc_id", "page", F.explode(F.filter(F.transform("lines", lambda x: x["line_no"]), inside)).alias("line_no"))


def without_repeated_lines(pages: DataFrame, lines: DataFrame, share: float = 0.2, least: int = 5) -> DataFrame:
    """doc_id, page, text, n_removed: each page once, its repeated blocks deleted, all else kept; lines are those of pages."""
    gone = repeated_lines(lines, share, least).groupBy("doc_id", "page").agg(F.collect_set("line_no").alias("gone"))
    once = pages.select("doc_id", "page", "text").dropDuplicates(["doc_id", "page"]).join(gone, ["doc_id", "page"], "left")
    whole = F.split("text", "\n")
    kept = F.filter(whole, lambda x, i: F.col("gone").isNull() | ~F.array_contains("gone", i + 1))
    return once.select("doc_id", "page", F.array_join(kept, "\n").alias("text"), (F.size(whole) - F.size(kept)).alias("n_removed"))
