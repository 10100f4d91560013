"""Operator 10. Personal data: base patterns, and contextual extraction bootstrapped from what they find."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import Scratch, fresh, inner, others, sized, with_row_id

KINDS = ("email", "ip", "card", "phone")
#: The kind of the spans that contexts find.
FOUND = "id"
#: Rounds of scoring; least score of a pattern that may find, and distinct instances of that score it must have.
ROUNDS, CONFIDENCE, SUPPORT = 5, 0.8, 3
#: Words before an identifier that make a pattern when none of them is a label (a word that ends in : or =).
WORDS_BEFORE = 3
#: Words after a label without an identifier by which such places are told apart.
WORDS_AFTER = 3

_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LABEL = re.compile(r"""[:=][ \t]*["']?(?=[^\s"'])""")
#: What may be an identifier: a run with digits, joined by single marks or spaces between digits.
_IDENTIFIER = re.compile(r"(?<![^\s\"'(:=])@?[A-Za-z0-9]+(?:[-_./@+]+[A-Za-z0-9]+|(?<=[0-9]) (?=[0-9])[0-9]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base kinds' spans in code points: leftmost matches that do not overlap within a kind; failing ones are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out["email"].append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) < 4 and int(x or "0") < 256 for x in (part.lstrip("0") for part in m[0].split("."))):
                out["ip"].append(m.span())
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out["phone"].append(m.span())
    return out


def spans_text(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def _last_words(text: str, line: int, start: int) -> list[str]:
    """The last words of text[line:start], more than are looked at: the window grows until it has them, so a long line is not split for each place."""
    width = 128
    while True:
        at = max(line, start - width)
        words = text[at:start].lower().split()
        if at == line:
            return words
        if len(words) > WORDS_BEFORE + 2:
            return words[1:]  # the first may be cut
        width *= 4


def _before(text: str, start: int) -> str | None:
    """The pattern of what stands before a place: its label, or else its last words; None without context."""
    words = _last_words(text, text.rfind("\n", 0, start) + 1, start)
    if not words:
        return None
    last = words[-1].rstrip("\"'(")
    if not last and len(words) > 1:
        last = words[-2]
    if last[-1:] in (":", "="):
        if last in (":", "="):
            words = [w for w in words if w.strip("\"'(:=")]
            return f"{words[-1]} {last}" if words else None
        return last.rpartition("(")[2]
    return " ".join(words[-WORDS_BEFORE:]) if len(words) >= WORDS_BEFORE else None


def occurrences(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, int, bool, bool]]:
    """(pattern, instance, start, end, seed, miss) for identifiers in context: base spans are seeds, others may be found.

    A label that no identifier follows is a miss and counts against its pattern: its
    instance is the hash of the next words of the line.
    """
    taken = sorted(s for k in KINDS for s in spans[k])
    out = []
    for start, end in taken:
        pattern = _before(text, start)
        if pattern:
            out.append((pattern, _instance(text[start:end]), start, end, True, False))
    at = 0
    seen = set()
    for m in _identifiers(text):
        start, end = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at < len(taken) and taken[at][0] < end:
            continue
        pattern = _before(text, start)
        if pattern:
            out.append((pattern, _instance(m[0]), start, end, False, False))
            seen.add(start)
    seeds = {s for s, _ in taken}
    for m in _LABEL.finditer(text):
        if m.end() not in seen and m.end() not in seeds:
            pattern = _before(text, m.end())
            if pattern:
                out.append((pattern, _after(text, m.end()), m.end(), m.end(), False, True))
    return out


def _after(text: str, start: int) -> int:
    """A hash of the next words of a place's line."""
    end = text.find("\n", start, start + 120)
    words = text[start : start + 120 if end < 0 else end].lower().split()[:WORDS_AFTER]
    return xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"), 7) - (1 << 63)


def _identifiers(text: str) -> Iterator[re.Match]:
    """Matches of _IDENTIFIER with at least four digits, or that begin with @; only looked for around digits and @."""
    end = 0
    token, seen, nothing = 0, 0, 0  # where the run of visible characters begins, how far it was looked at, before where no match begins
    for d in re.finditer("[0-9]+|@", text):
        if d.start() < end:
            continue
        start = d.start()
        while start > seen and not text[start - 1].isspace():
            start -= 1
        if start > seen or not seen:
            token = start
        seen = d.end()
        start = max(token, end, nothing)
        while start < d.end():
            m = _IDENTIFIER.search(text, start)
            if not m or m.start() > d.start():
                nothing = m.start() if m else len(text)
                break
            end = start = m.end()
            if sum("0" <= c <= "9" for c in m[0]) >= 4 or m[0][0] == "@" and len(m[0]) > 3:
                yield m


def _instance(value: str) -> int:
    """Identifiers are compared by a hash of their letters and digits, so no personal data leaves its row."""
    return xxhash.xxh64_intdigest("".join(c for c in value.lower() if c.isalnum()).encode(), 7) - (1 << 63)


_OCCURRENCE = pa.struct([("pattern", pa.string()), ("instance", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("miss", pa.bool_())])


def scan(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, the numbers of base spans, their text, its SHA-256 and the identifiers in context, for every row."""
    kept = df.select(*keep, text)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema)
    names = [*(f"n_{k}" for k in KINDS), "base", "base_sha256", "contexts"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for value in part.column(len(keep)).to_pylist():
                    value = value or ""
                    spans = base_spans(value)
                    base = spans_text(spans)
                    found = [dict(zip(("pattern", "instance", "start", "end", "seed", "miss"), x)) for x in occurrences(value, spans)]
                    rows.append((*(len(spans[k]) for k in KINDS), base, hashlib.sha256(base.encode()).hexdigest(), found))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(_OCCURRENCE)]
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], [*part.schema.names[: len(keep)], *names])

    fields = [*(f"n_{k} long" for k in KINDS), "base string, base_sha256 string, contexts array<struct<pattern:string,instance:long,start:int,end:int,seed:boolean,miss:boolean>>"]
    return kept.mapInArrow(work, f"{head}, {', '.join(fields)}")


def bootstrap(contexts: DataFrame, scratch: Scratch) -> DataFrame:
    """Patterns that may find identifiers, by scoring the graph of patterns and instances.

    contexts: (pattern, instance, seed, miss) of every occurrence. Seeds have the score 1, other
    instances the noisy-or of their patterns' scores; a pattern has the mean score of its
    distinct instances, each miss (a label without an identifier), told apart by the
    words after it, counting as an instance of score 0 and one such more for smoothing.
    Copies of a document add nothing: only distinct instances and misses count. After ROUNDS the patterns of at least
    CONFIDENCE are left that have SUPPORT distinct instances of at least CONFIDENCE: seeds, or found by other patterns in
    the rounds before, so what one pattern finds makes the next one known.
    """
    pairs = scratch.write(contexts.where("not miss").groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    # An identifier that is a seed anywhere is a seed everywhere.
    seeds = pairs.where("seed").select("instance").distinct().withColumn("known", F.lit(True))
    pairs = scratch.write(pairs.join(seeds, "instance", "left").select("pattern", "instance", F.coalesce("known", F.lit(False)).alias("seed")))
    misses = scratch.write(contexts.where("miss").groupBy("pattern").agg(F.count_distinct("instance").alias("misses")))
    # Without a seed a pattern scores what its instances get from others; without any other instance it finds nothing.
    scores = pairs.select("instance", F.col("seed").cast("double").alias("score")).distinct()
    for _ in range(ROUNDS):
        rated = pairs.join(scores, "instance").groupBy("pattern").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("n"), F.sum((F.col("score") >= CONFIDENCE).cast("long")).alias("seeds"))
        rated = rated.join(misses, "pattern", "left")
        rated = scratch.write(rated.select("pattern", "seeds", (F.col("mass") / (F.col("n") + F.coalesce("misses", F.lit(0)) + 1)).alias("weight")))
        doubt = F.sum(F.log1p(-F.least("weight", F.lit(0.999999))))
        scores = pairs.join(rated, "pattern").groupBy("instance").agg(F.max("seed").alias("seed"), doubt.alias("doubt"))
        scores = scores.select("instance", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("doubt")).alias("score"))
    return rated.where((F.col("weight") >= CONFIDENCE) & (F.col("seeds") >= SUPPORT)).select("pattern")


def find(df: DataFrame, row: str, text: str, keep: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(scanned rows, found): found has (row, added) with the sorted spans that contexts found, for rows that have any.

    row names a column that is unique for each row.
    """
    scanned = scratch.write(scan(df, text, [row, *keep]))
    contexts = scanned.select(row, F.explode("contexts").alias("c")).select(row, "c.*")
    patterns = scratch.write(bootstrap(contexts, scratch))
    open_ = contexts.where("not seed and not miss")
    hits = open_.join(sized(patterns, 200), "pattern").select(row, "start", "end").distinct()
    found = hits.groupBy(row).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("added"))
    return scanned, scratch.write(found)


def find_pii(df: DataFrame, text: str, keep: list[str], scratch: Scratch | None = None) -> DataFrame:
    """keep, n_email, n_ip, n_card, n_phone, base_sha256 and spans for every row of df.

    spans lists kind:start:end (code points, end exclusive) of the base kinds in their
    order and then of the kind id: identifiers that only their context shows. A null or
    empty text has no span and the digest of the empty string. Repeated rows stay; an
    empty table gives an empty one; columns not in keep are not read, and those in keep
    named like a new one, in any case, are replaced. df is a table as it was read.
    """
    scratch = scratch or Scratch(df.sparkSession, "pii")
    keep = others(keep, *(f"n_{k}" for k in KINDS), "base_sha256", "spans")
    plain, names, back = inner(df, keep, F.col(text).alias("__text"))
    row = "row_id"
    scanned, found = find(plain.withColumn(row, F.monotonically_increasing_id()), row, "__text", names, scratch)
    added = F.array_join(F.transform("added", lambda s: F.concat_ws(":", F.lit(FOUND), s["start"], s["end"])), ",")
    joined = scanned.join(sized(found, 64, array="added", item_bytes=48), row, "left")
    spans = F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif(added, F.lit("")))
    return joined.select(*back, *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"))


def redact(df: DataFrame, text: str, scratch: Scratch | None = None) -> DataFrame:
    """df with every span of personal data in text replaced by its kind in brackets; null texts stay null.

    df is a table as it was read; spans that overlap are replaced as one, by the first one's kind.
    """
    scratch = scratch or Scratch(df.sparkSession, "pii")
    row, more = fresh(df, "row_id"), fresh(df, "added_spans")
    numbered = with_row_id(df, row, scratch)
    _, found = find(numbered, row, text, [], scratch)
    joined = numbered.join(sized(found.withColumnRenamed("added", more), 64, array=more, item_bytes=48), row, "left")

    @F.pandas_udf("string")
    def clean(texts, extra):
        import pandas as pd

        out = []
        for value, spans in zip(texts, extra):
            if value is None:
                out.append(None)
                continue
            whole = base_spans(value)
            cuts = [(a, b, k) for k in KINDS for a, b in whole[k]]
            cuts += [] if spans is None else [(int(s["start"]), int(s["end"]), FOUND) for s in spans]
            parts, at = [], 0
            for a, b, kind in sorted(cuts):
                if a >= at:
                    parts += [value[at:a], f"[{kind.upper()}]"]
                at = max(at, b)
            out.append("".join([*parts, value[at:]]))
        return pd.Series(out, dtype=object)

    return joined.withColumn(text, clean(F.col(text), F.col(more))).select(*df.columns)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", ["doc_id"])


QUERIES = {"op10_pii": op10_pii}
ORACLE_SQL: dict[str, str] = {}
