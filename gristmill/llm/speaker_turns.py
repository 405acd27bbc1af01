"""Spoken transcripts into clean, ordered speaker turns.

SQL expressions take the label and the words of each line, a window carries the
last label forward over lines and page ends, marked noise is removed, and
consecutive lines of one speaker become a turn by their gaps-and-islands number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.session import cut_lineage, small_side

TIME = r"(?:[\(\[<]?\b\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?\b[\)\]>]?|<\d+h\d+m\d+s>)"
NAME = r"\p{Lu}[\p{L}'’-]+"
LABEL = (
    rf"^\s*(?:{TIME}\s*)?(?:>>\s*)?(?:{TIME}\s*)?("
    rf"Q \({NAME}(?: {NAME})*\)"
    r"|(?:The |THE )?(?:Moderator|MODERATOR)"
    rf"|(?:The |THE )?(?:Chair|CHAIR)(?:man|woman|MAN|WOMAN)?(?: {NAME}){{0,3}}"
    rf"|(?:MR|MS|MX|MRS|DR|Mr|Ms|Mx|Mrs|Dr)\. {NAME}(?: {NAME})?"
    rf"|{NAME}(?: {NAME}){{0,2}}(?:, (?:[\p{{Lu}}&][\p{{L}}'’&.-]*\s?)+)?"
    r")\s*(:|\.)(?=\s|$)"
)
# A full stop ends a label only after a title, a role or capitals throughout.
STOPPED = r"^(?:(?:The |THE )?(?:Chair|CHAIR|Moderator|MODERATOR)(?: .*)?|(?:MR|MS|MX|MRS|DR|Mr|Ms|Mx|Mrs|Dr)\. .*|[\p{Lu}'’ -]{4,})$"
MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)"
FURNITURE = (
    rf"(?i)^\s*(?:{MONTH} \d{{1,2}}, \d{{4}},?\s+(?:page \d+ of \d+|.*press conference)|page \d+(?: of \d+)?|\d+"
    r"|transcript of .*press conference.*|this transcript has been .*|final|preliminary)\s*$"
)
SOUND_NOTE = r"\[[^\]\n]*\]|\{[^}\n]*\}|<[^>\n]*>|\*[^*\n]+\*|\((?i:applause|laughter|laughs|inaudible|pause|crosstalk|noise|music|off mic|audio [^)]*|coughs?)\)"
HESITATION = r"(?i)^(?:u+h*m+|u+h+|e+r+m*|a+h+|h+m+|m+h*m+|e+h+)$"
FILLER_PHRASE = r"(?i)\b(?:you know|i mean|kind of|sort of),"
RESTART = r"(?i)\b([\p{L}'’-]+) -- \1\b"
EDGE_MARKS = r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$"


def _clean_words(text: Column) -> Column:
    """Words in lower case without marks at their ends; time marks, sound notes, hesitation sounds, filler phrases and restarts are left out."""
    bare = text
    for noise, instead in ((TIME, " "), (SOUND_NOTE, " "), (FILLER_PHRASE, " "), (RESTART, "$1")):
        bare = F.regexp_replace(bare, noise, instead)
    words = F.transform(F.regexp_extract_all(bare, F.lit(r"\S+"), 0), lambda w: F.regexp_replace(F.lower(w), EDGE_MARKS, ""))
    return F.filter(words, lambda w: (w != "") & ~w.rlike(HESITATION))


def transcript_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, line_no, label, words of every line that is no page furniture; label is carried forward, front matter dropped.

    pages(doc_id, page, text); pages ingested twice count once. Null texts have no lines.
    """
    once = pages.select("doc_id", "page", "text").where(F.col("text").isNotNull()).groupBy("doc_id", "page").agg(F.min("text").alias("text"))
    lines = once.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(~F.col("line").rlike(FURNITURE))
    found, mark = F.regexp_extract("line", LABEL, 1), F.regexp_extract("line", LABEL, 2)
    lines = lines.withColumns({"found": found, "mark": mark})
    label = F.when((F.col("found") != "") & ((F.col("mark") == ":") | F.col("found").rlike(STOPPED)), F.col("found"))
    lines = lines.withColumn("own", label)
    rest = F.when(F.col("own").isNull(), F.col("line")).otherwise(F.regexp_replace("line", LABEL, ""))
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    return (
        lines.select("doc_id", "page", "line_no", F.last("own", ignorenulls=True).over(order).alias("label"), _clean_words(rest).alias("words"))
        .where(F.col("label").isNotNull())
    )


def surname_of(label: Column) -> Column:
    """Surname of a label in lower case: 'moderator' for the moderator, null for the chair without a name."""
    named = F.regexp_replace(F.regexp_replace(label, r"^Q \(|\)$", ""), r",.*$", "")
    last = F.lower(F.regexp_extract(named, r"([\p{L}'’-]+)\s*$", 1))
    return F.when(last.rlike("^chair(man|woman)?$"), F.lit(None)).otherwise(last)


def spoken_lines(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, page, line_no, words, speaker, turn_no of every line with words: consecutive lines of one speaker have one turn number.

    docs(doc_id, speaker) names the chair where the transcript never does; null and
    empty speakers are allowed. Surnames with two letters exchanged are put right
    after the commonest spelling of the same letters in the whole collection. A
    transcript without labels has no turns; a turn without words is none.
    """
    lines = cut_lineage(transcript_lines(pages).withColumns({"surname": surname_of(F.col("label")), "is_chair": F.col("label").rlike("(?i)^(the )?chair")}))
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    spoken = lines.where("surname is not null and surname <> 'moderator'").select("doc_id", "is_chair", "surname")
    counts = spoken.groupBy("surname").agg(F.count("*").alias("n"))
    spelling = counts.groupBy(letters(F.col("surname")).alias("letters")).agg(F.max_by("surname", F.struct("n", "surname")).alias("right"))
    chairs = spoken.where("is_chair").groupBy("doc_id", "surname").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max_by("surname", F.struct("n", "surname")).alias("chair"))
    named = F.regexp_extract(F.regexp_replace(F.trim("speaker"), r",.*$", ""), r"([\p{L}'’-]+)\s*$", 1)
    from_docs = docs.groupBy("doc_id").agg(F.max(F.nullif(F.lower(named), F.lit(""))).alias("listed"))
    title = pages.select("doc_id", F.lower(F.regexp_extract("text", r"(?i)transcript of (?:chair )?(?:[\p{L}-]+ )?([\p{L}-]+)[’']s press conference", 1)).alias("t"))
    titled = title.where("t <> ''").groupBy("doc_id").agg(F.max("t").alias("titled"))
    known = (
        lines.where(F.size("words") > 0)
        .join(chairs, "doc_id", "left").join(titled, "doc_id", "left").join(from_docs, "doc_id", "left")
        .withColumn("said", F.coalesce("surname", "chair", "titled", "listed", F.lit("chair")))
        .withColumn("letters", letters(F.col("said")))
        .join(small_side(spelling), "letters", "left")
        .select("doc_id", "page", "line_no", "words", F.coalesce("right", "said").alias("speaker"))
    )
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    changed = F.coalesce((F.lag("speaker").over(order) != F.col("speaker")).cast("int"), F.lit(1))
    return known.withColumn("changed", changed).withColumn("turn_no", F.sum("changed").over(order).cast("int")).drop("changed")


def turn_bounds(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, turn_no, speaker, first_word, last_word of each turn; nothing of a turn but its two words is carried, however long it is."""
    at = F.struct("page", "line_no")
    g = spoken_lines(pages, docs).select("doc_id", "turn_no", "speaker", "page", "line_no", F.element_at("words", 1).alias("first"), F.element_at("words", -1).alias("last"))
    return g.groupBy("doc_id", "turn_no", "speaker").agg(F.min_by("first", at).alias("first_word"), F.max_by("last", at).alias("last_word"))


def speaker_turns(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, turn_no, speaker, words, first_word, last_word: each transcript's turns in order with their words."""
    at = F.struct("page", "line_no", "words")
    turns = spoken_lines(pages, docs).groupBy("doc_id", "turn_no", "speaker").agg(F.flatten(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["words"])).alias("words"))
    return turns.select("doc_id", "turn_no", "speaker", "words", F.element_at("words", 1).alias("first_word"), F.element_at("words", -1).alias("last_word"))
