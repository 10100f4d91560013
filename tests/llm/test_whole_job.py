"""Cases that earlier versions of the text operators left out."""

import random
import re
import time

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from skein.llm import html, linededup, pii, quality
from test_native_operators import distance


def table(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_near_dedup_stage_links_all_of_jaccard_four_fifths(spark, tmp_path):
    rnd = random.Random(21)
    texts = [None, "", " \n", "a b", "A  B", "a b c"]
    for _ in range(8):
        base = [f"w{rnd.randint(0, 4000)}" for _ in range(rnd.randint(40, 200))]
        texts.append(" ".join(base))
        for _ in range(12):
            words = list(base)
            for _ in range(rnd.randint(1, max(1, len(base) // 25))):
                words[rnd.randrange(len(words))] = f"v{rnd.randint(0, 4000)}"
            texts.append(" ".join(words))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                up = [up[j] if x == up[i] else x for x in up] if up[j] < up[i] else [up[i] if x == up[j] else x for x in up]
    df = table(spark, tmp_path / "d", [(i, t, "en", "h", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").select("doc_id").collect()}
    assert got == {i for i in range(len(texts)) if up[i] == i} and len(got) < len(texts) - 30
    assert corpus_pipeline.near_dedup(spark, df.where(F.lit(False)), "").count() == 0


def brute_removed(texts):
    """The lines that go, by row number: edit similarity in characters alone decides."""
    norm = lambda s: re.sub(r"[\x20\t\x0b\f\r]+", " ", re.sub("[1-9]", "0", re.sub(r"[!-/:-@\[-`{-~]+", "", s.lower()))).strip(" ")
    place = [(r, i, norm(s)) for r, text in enumerate(texts) for i, s in enumerate(text.split("\n")) if norm(s)]
    lines = list(dict.fromkeys(p[2] for p in place))
    root = {s: s for s in lines}
    for i, a in enumerate(lines):
        for b in lines[:i]:
            longer = max(len(a), len(b))
            if min(a.count(" "), b.count(" ")) >= 4 and abs(len(a) - len(b)) <= longer // 5 and root[a] != root[b] and distance(a, b) <= longer // 5:
                old, new = root[a], root[b]
                root = {s: new if r == old else r for s, r in root.items()}
    first, gone = {}, {}
    for r, i, s in place:
        if first.setdefault(root[s], (r, i)) != (r, i):
            gone.setdefault(r, []).append(i)
    return gone


def test_lines_of_edit_similarity_four_fifths_are_linked(spark, tmp_path):
    rnd = random.Random(22)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 8)))
    pool = [[word() for _ in range(n)] for n in (5, 5, 6, 8, 10, 10, 14, 20, 30, 45)]
    texts = ["alpha beta gamma delta epsilon\nalphx beta gamma deltx epsilon\none two\none twx"]
    for _ in range(60):
        lines = []
        for _ in range(2):
            words = list(rnd.choice(pool))
            for _ in range(rnd.randint(0, len(words) // 5)):
                at = rnd.randrange(len(words))
                words[at : at + 1] = rnd.choice([[word()], [words[at], word()], [], [words[at] + "q"]])
            lines.append(" ".join(words))
        texts.append("\n".join(lines))
    df = table(spark, tmp_path / "d", [(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.removed_lines for r in linededup.dedup_lines(df, "text").collect() if r.removed_lines}
    assert got == brute_removed(texts) and got[0] == [1]


def test_template_lines_of_distinct_documents_are_frequent(spark, tmp_path):
    template = [f"banner {k} " + " ".join(f"t{k}x{j}" for j in range(6)) for k in range(10)]
    rows = [(i, "\n".join([*template, " ".join(f"own{i}x{j}" for j in range(30))]), "h") for i in range(100)]
    df = table(spark, tmp_path / "d", rows + rows[:5], "doc_id long, text string, source string")
    found = quality.frequent_lines(df, "text", F.col("source"))
    want = {r[0] for r in spark.createDataFrame([(t,) for t in template], "t string").select(F.xxhash64("t")).collect()}
    assert {r.line for r in found.collect()} == want


def test_copies_of_a_label_without_identifier_weigh_once(spark, tmp_path):
    rows = [(i, f"customer {i} has tel: {'+1 (988) 555-%04d' % i if i % 3 else '988 555 %04d' % i} since 1999") for i in range(60)]
    rows += [(1000 + i, "for orders tel: see below on this page") for i in range(400)]
    df = table(spark, tmp_path / "d", rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find_pii(df, "text", ["doc_id"]).collect()}
    assert all("id:" in found[i] for i in range(0, 60, 3)) and not found[1000]


def test_found_identifiers_make_the_next_pattern_known(spark, tmp_path):
    code = lambda i: f"AB-{71000 + 37 * i}"
    rows = [(i, f"staff {i} email: user{i}@example.org today") for i in range(80)]
    rows += [(100 + i, f"staff {i} email: {code(i)} today") for i in range(10)]
    rows += [(200 + i, f"staff {i} badge: {code(i)} today") for i in range(10)] + [(300, "staff 9 badge: AB-99999 today"), (301, "door no: 88888 today")]
    found = {r.doc_id: r.spans for r in pii.find_pii(table(spark, tmp_path / "d", rows, "doc_id long, text string"), "text", ["doc_id"]).collect()}
    assert all("id:" in found[i] for i in [*range(100, 110), *range(200, 210), 300]) and not found[301]


def test_long_texts_without_blanks_and_long_numbers_take_linear_time():
    import time

    began = time.time()
    for text in ("a,1," * 60_000, "1,2222," * 40_000, "x@" * 60_000, "0" * 5000 + ".1.1.1 " + "z" * 300_000, "word " * 40_000 + "9999 " * 20_000):
        spans = pii.base_spans(text)
        pii.occurrences(text, spans)
    assert time.time() - began < 60
    assert pii.base_spans("0" * 5000 + "1.1.1.1")["ip"] == [(0, 5007)]


def test_pages_without_an_end_of_head_or_with_a_class_of_what_they_have_keep_their_text():
    prose = "This is the text of the article and it is long enough to be taken as it has many of the words that are in all of the texts of the language."
    assert html.extract(f"<html><head><title>t</title><body><p>{prose}</p></body></html>") == prose
    assert html.extract(f"<html><head><title>t<body><p>{prose}</p></body></html>") == prose
    assert html.extract(f"<div class='content has-sidebar'><article><p>{prose}</p></article></div>") == prose
    assert html.extract(f"<div class='sidebar'><p>{prose}</p></div><article><p>{prose} And more.</p></article>") == f"{prose} And more."


def test_a_form_around_the_page_is_not_apart_but_one_in_it_is():
    prose = "This is the text of the article and it is long enough to be taken as it has many of the words that are in all of the texts of the language."
    assert html.extract(f"<body><form id='main-form'><div><article><p>{prose}</p></article></div></form></body>") == prose
    assert html.extract(f"<article><p>{prose}</p><form><p>{prose} Subscribe.</p></form></article>") == prose
    assert html.extract(f"<form><p>{prose} Search.</p></form><article><p>{prose}</p></article>") == prose


def test_ends_that_match_nothing_take_linear_time():
    import time

    began = time.time()
    html.extract("<div>" * 50_000 + "</section>" * 50_000)
    html.extract("<b><div>" + "<i>" * 50_000 + "</b>" * 50_000)
    html.extract("<i>" * 50_000 + "<p>x</p>" * 50_000)
    html.extract("<title>" * 50_000)
    assert time.time() - began < 30


def test_kept_columns_may_be_named_like_new_ones(spark, tmp_path):
    from skein.llm import bpe, licenses, packing

    tokenizers = pytest.importorskip("public_tokenizers")
    names = ["doc_id", "license", "base", "n_chars", "n_email", "piece", "n_tokens", "word", "contexts", "row_id"]
    rows = [(1, "a", "b", 7, 7, 7, 7, "w", "c", 9, "mail a.b@c.org now. Permission is hereby granted")]
    df = table(spark, tmp_path / "d", rows, "doc_id long, license string, base string, n_chars long, n_email long, piece long, n_tokens long, word string, contexts string, row_id long, text string")
    found = pii.find_pii(df, "text", names).first()
    assert (found.n_email, found.base, found.contexts, found.row_id) == (1, "b", "c", 9)
    assert html.extract_pages(df, "text", names).columns == [n for n in names if n != "n_chars"] + ["text", "n_chars"]
    assert bpe.encode_decode(df, "text", tokenizers.path("byte_bpe_50k.json"), names).first().n_tokens != 7
    assert packing.pieces(df, "text", tokenizers.path("word_bpe_49k.json"), names).first().piece == 0
    assert licenses.scan_licenses(df, "text", names, {"own": "mail a b c org now permission"}).first().license == "own"


def test_flags_of_frequent_words_are_a_short_literal(spark):
    lines = spark.createDataFrame([("often " * 50 + f"seldom{i}",) for i in range(100)], "line string")
    flags = linededup.frequent_words(lines)
    found = {r.word: r.flag for r in spark.createDataFrame([("often",), ("seldom7",)], "word string").select("word", linededup._flagged(flags, F.xxhash64("word")).alias("flag")).collect()}
    assert found == {"often": True, "seldom7": False} and len(flags._jc.toString()) < 20_000


def test_all_distinct_words_of_a_line_vote_on_its_fingerprint(spark):
    lines = [" ".join(f"w{n}x{i}" for i in range(n)) + " twice twice" for n in (0, 3, 30, 31, 100, 509, 510, 511, 2000)]
    votes = F.expr("transform(array_distinct(split(line, ' ')), w -> xxhash64(xxhash64(w)))")
    df = spark.createDataFrame([(s,) for s in lines], "line string")
    for r in df.select(votes.alias("votes"), linededup.fingerprint(linededup.hashes(F.col("line"))).alias("print")).collect():
        assert r.print == sum(1 << k for k in range(63) if 2 * sum(v >> k & 1 for v in r.votes) > len(r.votes))


def test_lines_that_gaps_or_words_would_set_apart_are_compared_whole(spark):
    rnd = random.Random(23)
    for n in (20, 220):
        words = ["".join(rnd.choice("abcdefghij") for _ in range(10)) for _ in range(n)]
        a, b = " ".join(["anchor", *words]), " ".join([*(w[:4] + "z" + w[5:] if i % 2 else w[:4] + "y" + w[5:] for i, w in enumerate(words)), "anchor"])
        allowed = F.floor(F.char_length("a") * 0.2).cast("int")
        none = linededup.frequent_words(spark.createDataFrame([("",)], "line string").where("false"))
        found = spark.createDataFrame([(a, b)], "a string, b string").select(linededup.distance(F.col("a"), F.col("b"), none, allowed)).first()[0]
        assert found == distance(a, b) <= len(a) // 5


def test_fingerprints_in_generated_code_are_the_same(spark):
    sizes = (0, 1, 4, 30, 63, 64, linededup.FEW - 1, linededup.FEW, linededup.FEW + 1, 300, 700)
    lines = [(n, " ".join(f"w{n}x{i}" for i in range(n)) + " twice" * (n % 3)) for n in sizes] + [(-1, None)]
    df = spark.createDataFrame(lines, "n int, line string").select("n", linededup.hashes(F.col("line")).alias("words"))
    want = {r.n: r.print for r in df.select("n", F.when(F.col("words").isNotNull(), linededup.fingerprint(F.col("words"))).alias("print")).collect()}
    out = linededup.with_prints(df, "words", "print")
    assert out.columns == ["n", "print"] and {r.n: r.print for r in out.collect()} == want and want[-1] is None
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Project") > 8


def test_a_moved_word_does_not_make_long_lines_be_compared_whole(spark):
    rnd = random.Random(27)
    words = [f"{rnd.randint(0, 10**6)}q{i}" for i in range(9_000)]
    moved = [*words[:4000], words[4001], words[4000], *words[4002:]]
    moved[100], moved[8000] = "other", "new word"
    none = linededup.frequent_words(spark.createDataFrame([("",)], "line string").where("false"))
    a, b = " ".join(words), " ".join(moved)
    allowed = F.floor(F.char_length("a") * 0.2).cast("int")
    began = time.time()
    found = spark.createDataFrame([(a, b)], "a string, b string").select(linededup.distance(F.col("a"), F.col("b"), none, allowed)).first()[0]
    near = [i for i in range(9_000) if words[i] != moved[i]]
    assert near == [100, 4000, 4001, 8000] and 10 < found < 80
    # Frequent words cut no gaps: the whole lines, but for what they begin and end with.
    often = F.array(*[F.lit(-1).cast("long")] * (linededup.SLOTS // 64))
    same = [("a b", "a c b", 2), ("b a a", "a a", 2), ("a", "b", 1), ("a a", "a a", 0)]
    same += [("o " * 500 + "e", "o " * 500 + "c e", 2), ("o " * 500 + "o", "o " * 498 + "o", 4), ("b " + "o " * 500 + "e", "o " * 501 + "e", 1)]
    same += [(" ".join(["often"] * 20_000), " ".join(["often"] * 9_000 + ["once"] + ["often"] * 10_999), 3)]
    for x, y, want in same:
        got = spark.createDataFrame([(x, y)], "a string, b string").select(linededup.distance(F.col("a"), F.col("b"), often, F.lit(20_000))).first()[0]
        assert got == want
    # Each of the long pairs takes thousands of millions of steps as a whole.
    assert time.time() - began < 20


def test_near_dedup_stage_goes_through_simhash_and_loses_nothing_by_it(spark, tmp_path, monkeypatch):
    from skein.llm import shingles, simhash

    rnd = random.Random(24)
    base = [f"w{rnd.randint(0, 4000)}" for _ in range(400)]
    texts = [" ".join(base)]
    for changed in (1, 1, 1, 2, 8, 9, 200):
        words = list(base)
        for at in rnd.sample(range(0, 400, 2), changed):
            words[at] = f"v{rnd.randint(0, 4000)}"
        texts.append(" ".join(words))
    df = table(spark, tmp_path / "d", [(i, t, "en", "h", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    radii, close_pairs = [], simhash.close_pairs

    def noted(distinct, radius, *more):
        found = close_pairs(distinct, radius, *more)
        radii.append((radius, found.count()))
        return found

    monkeypatch.setattr(simhash, "close_pairs", noted)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").select("doc_id").collect()}
    assert got == {0, 7} and radii[0][0] == corpus_pipeline.NEAR_BITS and radii[0][1] >= 1
    plain = shingles.similar_texts(df, "doc_id", "text")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, shingles.similar_texts(df, "doc_id", "text", radius=64 // 8).collect()))
