"""Operator 8. Quality rules: base counts, and lines that too many documents of a host share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import SPACE, Scratch, fresh, sized, with_row_id

#: Base rules: least words, and the greatest percentage of words in repeated windows of WINDOW words.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A line is too frequent on a host if more than LEAST_DOCS and more than SHARE of the host's distinct documents have it.
LEAST_DOCS, SHARE = 10, 0.05
#: A document that lost lines is depleted with less than LEFT of its words.
LEFT = 0.3
SYMBOLS = "[#*$%&|<>]+"


def words_of(text: Column) -> Column:
    """Runs without ASCII white space, in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def has_word(text: Column) -> Column:
    return F.rlike(text, F.lit(r"[^\x20\x09-\x0D]"))


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), has_word)


def normal(line: Column) -> Column:
    """A line in lower case, with one space between words."""
    return F.trim(F.regexp_replace(F.lower(line), r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*", " "))


def repeated_words(words: Column, windows: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more; windows: the hash of each window in order.

    Sorted by hash, a repeated window has an equal neighbour. The positions of these,
    sorted, are summed up as a union of intervals.
    """
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(r: Column) -> Column:
        twice = F.filter(r, lambda x, k: F.coalesce(F.get(r, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(r, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    # A one-element array holds the sorted windows, so that they are sorted once.
    starts = F.transform(F.array(ranked), positions)[0]
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(starts, zero, lambda s, p: F.struct((s["n"] + p + width - F.greatest(s["end"], p)).alias("n"), (p + width).alias("end")), lambda s: s["n"])
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered)


def base_counts(df: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    words, lines, windows = (fresh(df, x) for x in ("words_of_text", "lines_of_text", "windows_of_text"))
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(words, words_of(t)).withColumn(lines, lines_of(t))
    slots = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.when(F.size(words) > WINDOW, F.transform(slots, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(windows, hashes)
    found = {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.regexp_replace(t, f"{SPACE}+", "")),
        "n_symbols": F.char_length(t) - F.char_length(F.regexp_replace(t, SYMBOLS, "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(F.col(words), F.col(windows)),
    }
    # One-row generators: a filter on the counts is not moved below them, where it would count again in each term.
    counts = F.struct(*[v.cast("long").alias(k) for k, v in found.items()])
    packed = fresh(df, "counts_of_text")
    rest = [c for c in df.columns if c not in (words, lines, windows)]
    df = df.withColumn(packed, F.explode(F.array(counts))).select(*rest, f"{packed}.*")
    return df.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def frequent_lines(df: DataFrame, text: str, host: Column, least: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """(host, line): hashes of normalised lines in too many distinct documents of a host.

    Documents with the same set of normalised lines are one document here, all others
    are distinct; near copies are left to the dedup stages. Counts are partial first, so
    a line of a third of all documents is a row for each task.
    """
    hashed = F.array_distinct(F.transform(lines_of(F.col(text)), lambda x: F.xxhash64(normal(x))))
    docs = df.select(host.alias("host"), hashed.alias("hashes")).where(F.size("hashes") > 0)
    docs = docs.select("host", "hashes", F.xxhash64(F.sort_array("hashes")).alias("doc"))
    hosts = docs.groupBy("host").agg(F.count_distinct("doc").alias("docs"))
    lines = docs.select("host", F.explode("hashes").alias("line"), "doc")
    lines = lines.groupBy("host", "line").agg(F.count_distinct("doc").alias("n"))
    lines = lines.where(F.col("n") > least)
    return lines.join(hosts, "host").where(F.col("n") > F.col("docs") * share).select("host", "line")


def judge(df: DataFrame, row: str, text: str, source: str, scratch: Scratch) -> DataFrame:
    """(row, lost, gone): words that a document loses with its frequent lines, and the hashes of these; only for documents that lose some."""
    host = F.coalesce(F.col(source).cast("string"), F.lit("\u0000"))
    frequent = scratch.write(frequent_lines(df, text, host))
    each = F.transform(lines_of(F.col(text)), lambda x: F.struct(F.xxhash64(normal(x)).alias("line"), F.size(words_of(x)).alias("n")))
    lines = df.select(row, host.alias("host"), F.explode(each).alias("l")).select(row, "host", "l.line", "l.n")
    lost = lines.join(sized(frequent, 64), ["host", "line"]).groupBy(row).agg(F.sum("n").alias("lost"), F.collect_set("line").alias("gone"))
    return scratch.write(lost)


def verdict(lost: Column) -> Column:
    left = F.col("n_words") - F.coalesce(lost, F.lit(0))
    depleted = lost.isNotNull() & (left < F.col("n_words") * LEFT)
    return ~F.col("base_failed") & ~depleted


def quality(df: DataFrame, text: str, source: str, scratch: Scratch | None = None, clean: bool = False) -> DataFrame:
    """df with the base counts, base_failed and kept; with clean, text loses its frequent lines where the document is kept.

    kept is false if a base rule fails, or if the document is depleted: without the lines
    that more than SHARE of the distinct documents of its host have (and more than
    LEAST_DOCS), it keeps less than LEFT of its words. A null
    or empty text has no word and fails. A null host is a host of its own. Repeated rows
    count as one document and are all judged alike. An empty table gives an empty one.
    Columns of df named like the new ones are replaced; df is a table as it was read.
    """
    scratch = scratch or Scratch(df.sparkSession, "quality")
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    df = df.drop(*[c for c in df.columns if c.lower() in made])
    row, lost, gone = fresh(df, "row_id"), fresh(df, "words_lost"), fresh(df, "lines_gone")
    numbered = with_row_id(df, row, scratch)
    losses = judge(numbered, row, text, source, scratch).withColumnsRenamed({"lost": lost, "gone": gone})
    out = base_counts(numbered, text).join(sized(losses, 64, array=gone), row, "left").withColumn("kept", verdict(F.col(lost)))
    if clean:
        rest = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(gone, F.xxhash64(normal(x))))
        out = out.withColumn(text, F.when(F.col("kept") & F.col(gone).isNotNull(), F.array_join(rest, "\n")).otherwise(F.col(text)))
    return out.select(*df.columns, *made)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs.select("doc_id", "text", "source"), "text", "source").drop("text", "source")


QUERIES = {"op8_quality": op8_quality}
ORACLE_SQL: dict[str, str] = {}
