"""Licenses, line dedup, quality rules, components and the pipeline against brute force."""

import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import common, licenses, linededup, quality, registry

PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone"


def table(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(path))
    return spark.read.parquet(str(path))


def has_python(df):
    plan = df._jdf.queryExecution().toString()
    return bool(re.search("Python|Arrow|Pandas", plan))


# 1. licenses


def test_licenses_against_brute_force(spark, tmp_path):
    t = licenses.TEMPLATES
    rows = [
        (1, "xx " * 30 + t["MIT-text"].replace("furnished", "given") + " yy" * 40), (2, None), (3, ""), (4, "license " * 3000), (5, "a b c " * 7 + t["GPL-text"].upper()),
        (6, "All rights, reserved"), (7, "Some words. Released under the  MIT\nLicense! More."), (8, "released under the license of MIT"), (9, t["Apache-2.0"] + " " + t["CC-BY-NC-4.0"]), (9, t["Apache-2.0"]),
    ]
    df = table(spark, tmp_path / "d", [(*r, "c") for r in rows], "doc_id long, text string, license string").drop("license")
    out = licenses.scan_licenses(df, "text", ["doc_id"])
    assert not has_python(out)
    want = []
    for i, text in rows:
        words = licenses._plain(text or "")
        for name, template in t.items():
            own = licenses._plain(template)
            half, k = (1 << max(2, (len(own) - 1).bit_length())) // 2, min(5, len(own))
            target = {tuple(own[a : a + k]) for a in range(len(own) - k + 1)}
            best = max(((len({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} & target) / len(target), -s) for s in range(0, len(words), half) for w in [words[s : s + 3 * half]]), default=(0, 0))
            if best[0] >= 0.8:
                want.append((i, name, best[0], -best[1]))
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert {(9, "Apache-2.0"), (1, "MIT-text"), (6, "Proprietary")} <= {w[:2] for w in want} and 8 not in {w[0] for w in want}
    assert licenses.scan_licenses(spark.createDataFrame([], "d long, text string"), "text", ["d"]).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(df, "text", ["doc_id"], {"bad": " - "})


def test_anchors_are_in_every_match():
    for text in licenses.TEMPLATES.values():
        words = licenses._plain(text)
        k = min(5, len(words))
        shingles = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
        bare = [s for s in shingles if not set(s) & set(licenses.anchors(licenses.TEMPLATES))]
        assert len(bare) < licenses.CONTAINMENT * len(shingles)


def test_bands_keep_the_bound_for_every_template():
    for text in licenses.TEMPLATES.values():
        words = licenses._plain(text)
        half, k = (1 << max(2, (len(words) - 1).bit_length())) // 2, min(licenses.SHINGLE, len(words))
        n = len({tuple(words[i : i + k]) for i in range(len(words) - k + 1)})
        need = -(-8 * n // 10)
        jaccard = need / (n + max(0, 3 * half - k + 1 - need))
        assert (1 - jaccard) ** licenses.bands_for(3 * half, k, [text]) <= licenses.MISS * (1 + 1e-9)


# 4. lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows):
    """The lines that go, by row number: edit similarity in characters alone decides, no fingerprint."""
    norm = lambda s: re.sub(r"[\x20\t\x0b\f\r]+", " ", re.sub("[1-9]", "0", re.sub(r"[!-/:-@\[-`{-~]+", "", s.lower()))).strip(" ")
    place = [(r, i, norm(s)) for r, text in enumerate(rows) for i, s in enumerate((text or "").split("\n")) if norm(s)]
    lines = list(dict.fromkeys(p[2] for p in place))
    up = {s: s for s in lines}

    def find(s):
        while up[s] != s:
            s = up[s]
        return s

    for i, a in enumerate(lines):
        for b in lines[:i]:
            longer = max(len(a), len(b))
            if min(len(a.split(" ")), len(b.split(" "))) >= 5 and abs(len(a) - len(b)) <= longer // 5 and find(a) != find(b) and distance(a, b) <= longer // 5:
                up[find(a)] = find(b)
    first = {}
    for r, i, s in place:
        first.setdefault(find(s), (r, i))
    gone = {}
    for r, i, s in place:
        if first[find(s)] != (r, i):
            gone.setdefault(r, []).append(i)
    return gone


def test_lines_against_brute_force(spark, tmp_path):
    rnd = random.Random(1)
    pool = [" ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()) + rnd.choice(["", "s", "ing"]) for _ in range(rnd.randint(1, 60))) for _ in range(12)]
    texts = [None, "", "\n\n", "a\na\nA.", "x " * 20000 + "\ny " * 3]
    for _ in range(40):
        lines = []
        for _ in range(rnd.randint(1, 6)):
            words = rnd.choice(pool).split(" ")
            if rnd.random() < 0.5 and len(words) > 3:
                words[rnd.randrange(len(words))] += "x"
            lines.append((" " if rnd.random() < 0.2 else "") + " ".join(words) + rnd.choice(["", "!", " 17"]))
        texts.append("\n".join(lines))
    texts += texts[5:8]
    df = table(spark, tmp_path / "d", [(i, t, 0, "r") for i, t in enumerate(texts)], "doc_id long, text string, row_id int, Removed_Lines string").coalesce(1)
    df.write.parquet(str(tmp_path / "one"))
    df = spark.read.parquet(str(tmp_path / "one"))
    order = {r.doc_id: i for i, r in enumerate(df.collect())}
    by_place = sorted(range(len(texts)), key=order.__getitem__)
    want = {by_place[r]: gone for r, gone in brute_lines([texts[i] for i in by_place]).items()}
    out = linededup.dedup_lines(df, "text")
    assert not has_python(out)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts) and {i: r.removed_lines for i, r in got.items() if r.removed_lines} == want
    for i, r in got.items():
        gone = set(want.get(i, []))
        assert r.text == (None if texts[i] is None else "\n".join(s for k, s in enumerate(texts[i].split("\n")) if k not in gone))
    assert linededup.dedup_lines(spark.createDataFrame([], "text string"), "text").count() == 0


# 8. quality


def brute_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_counts(spark, tmp_path):
    rnd = random.Random(2)
    texts = [None, "", " \n\t", PROSE, f"{PROSE}\n{PROSE}", f"{PROSE} x {PROSE} y\n\n{PROSE}", "a " * 100, "é# $x\x0by| z " * 30, "w " * 5000]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 200))) for _ in range(60)]
    df = table(spark, tmp_path / "d", [(i, t, None, 7) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int")
    out = quality.quality(df, "text", "source")
    assert not has_python(out)
    got = {r.doc_id: tuple(r)[-7:] for r in out.collect()}
    assert {k: v[:6] for k, v in got.items()} == {i: brute_counts(t) for i, t in enumerate(texts)}
    assert all(v[6] == (not v[5]) for v in got.values())
    assert quality.quality(spark.createDataFrame([], "text string, source string"), "text", "source").count() == 0


def test_frequent_lines_deplete_documents_but_copies_do_not(spark, tmp_path):
    common_line = "this Banner line is on very many pages of the host and " + PROSE
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"{own(i)}\n{common_line}", "h") for i in range(40)] + [(100, f"  {common_line.upper()}\nshort tail", "h"), (101, f"{common_line}", "other")]
    rows += [(200 + i, f"{own(999)}\n{own(998)}", "h") for i in range(60)]
    df = table(spark, tmp_path / "d", rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.quality(df, "text", "source", clean=True).collect()}
    assert [i for i, r in got.items() if not r.kept] == [100]
    assert got[3].text == own(3) and got[101].text == common_line and got[205].text == rows[-1][1]


# components


@pytest.mark.parametrize("order", ["up", "down", "random"])
def test_components(spark, order):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, x) for x in range(101, 160)] + [(200, 200), (300, 301), (301, 300), (300, 301)]
    names = {x: x for x in range(400)}
    if order == "down":
        names = {x: 400 - x for x in names}
    if order == "random":
        values = list(names)
        rnd.shuffle(values)
        names = dict(enumerate(values))
    links = spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a long, b long")
    got = {r.node: r.root for r in common.components(links, common.Scratch(spark, "test")).collect()}
    sets = [set(range(0, 20)), set(range(20, 40)), set(range(40, 60)), set(range(100, 160)), {300, 301}]
    assert set(got) == {names[x] for s in sets for x in s}
    assert all(len({got[names[x]] for x in s}) == 1 for s in sets) and len(set(got.values())) == len(sets)
    empty = spark.createDataFrame([], "a long, b long")
    assert common.components(empty, common.Scratch(spark, "test")).count() == 0


# pipeline


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables are not here")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == corpus_pipeline.COLUMNS, name
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        assert docs.where(F.char_length("text") != F.col("n_chars")).count() == 0
    assert seen[0] > seen[1] and seen == sorted(seen, reverse=True) and seen[3] == seen[4]
    assert docs.where(F.rlike("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"))).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in registry.queries()) == list(range(1, 11))
    assert [re.sub(" .*", "", name) for name, _ in corpus_pipeline.STAGES] == ["quality", "line", "SimHash", "personal", "best-fit"]


def test_joined_links_a_large_group_by_pairs_in_proportion_to_its_size(spark, tmp_path):
    n, compared = 2000, []
    rows = [(f, i, i % 10) for i in range(n) for f in (1, 2 + i % 7)] + [(9, -5, 0), (9, -4, 0), (10, -3, 50)]
    postings = spark.createDataFrame(rows, "feature int, node long, n int")

    def alike(pairs):
        compared.append(pairs.count())
        # Three nodes are like none but each other; all others are alike.
        return pairs.where("(a between 700 and 702) = (b between 700 and 702)")

    scratch = common.Scratch(spark, "joined")
    got = {r.node: r.root for r in common.joined(postings, lambda a, b: F.abs(a - b) < 20, alike, scratch).collect()}
    scratch.close()
    assert set(got) == {*range(n), -5, -4} and len(set(got.values())) == 3
    few = {700, 701, 702}
    assert len({got[i] for i in few}) == len({got[i] for i in range(n) if i not in few}) == 1 and got[-5] == got[-4]
    assert sum(compared) < 12 * n


def test_joined_compares_unlike_first_nodes_by_the_nearest_and_then_all(spark):
    n, compared = 1000, []
    # Of 0 to 999, all are like 0. 1000 to 1049 are like all of them but 0, 1050 is like 777 only, 1051 like none.
    rows = [(1, i, 1 if i == 777 else 2) for i in range(n)] + [(1, n + i, 3) for i in range(52)]
    postings = spark.createDataFrame(rows, "feature int, node long, n int")

    def alike(pairs):
        compared.append(pairs.count())
        return pairs.where("b < 1000 or b < 1050 and a between 1 and 999 or b = 1050 and a = 777")

    scratch = common.Scratch(spark, "joined")
    found = common.joined(postings, lambda a, b: F.abs(a - b) < 20, alike, scratch, apart=lambda a, b: F.abs(a - b))
    got = {r.node: r.root for r in found.collect()}
    scratch.close()
    assert set(got) == set(range(n + 51)) and len(set(got.values())) == 1
    assert sum(compared) < 8 * n


def test_blocks_know_their_places(spark):
    from skein.llm.linededup import blocks, hashes

    line = "ab cde f ghij ab cde kl mno p qr stu vwx yz"
    words, flags = line.split(" "), F.array(*[F.lit(0).cast("long")] * 512)
    found = spark.createDataFrame([(line,)], "line string").select(F.explode(blocks(F.col("line"), hashes(F.col("line")), flags)).alias("b")).select("b.*").collect()
    pairs = [F.hash(F.lit(1), *(F.xxhash64(F.lit(w)) for w in p)) for p in zip(words, words[1:])]
    known = list(zip(spark.range(1).select(*[p.alias(f"c{i}") for i, p in enumerate(pairs)]).first(), (sum(len(w) + 1 for w in words[:i]) for i in range(len(words)))))
    want = {h: at if [k[0] for k in known].count(h) == 1 else None for h, at in known}
    least = sorted(want)[:8]
    assert {r.feature: r["at"] for r in found} == {h: want[h] for h in least} and len(found) == 8


def test_flags_leave_every_shared_feature(spark):
    from skein.llm.common import flagged

    postings = spark.range(20_000).select((F.col("id") % 9_000 - 4_000).cast("int").alias("feature"), F.col("id").alias("node"))
    times = postings.groupBy("feature").count().where("count > 2")
    want = {r.node for r in postings.join(times, "feature", "left_semi").collect()}
    got = flagged(postings, times, "feature")
    found = {r.node for r in got.collect()}
    assert got.columns == postings.columns and want <= found and len(want) == 6_000 and len(found) < 6_100


def test_lines_without_broadcasts_are_the_same(spark, tmp_path, monkeypatch):
    rnd = random.Random(31)
    pool = [[f"w{rnd.randint(0, 500)}" for _ in range(n)] for n in (6, 9, 14, 25)]
    rows = [(i, " ".join(f"x{i}" if k == rnd.randrange(40) else w for k, w in enumerate(rnd.choice(pool)))) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    df, found, calls = spark.read.parquet(str(tmp_path / "d")), [], []
    for most in (common.CHAIN_BYTES, 0):
        for module in (common, linededup):
            monkeypatch.setattr(module, "CHAIN_BYTES", most)
            monkeypatch.setattr(module, "flagged", lambda *a, f=common.flagged: calls.append(a[2]) or f(*a))
        found.append({r.doc_id: r.removed_lines for r in linededup.dedup_lines(df, "text").collect()})
    assert found[0] == found[1] and sum(x is not None for x in found[0].values()) > 60 and {"feature", "h"} <= set(calls)


def test_joined_looks_for_others_by_zones_and_not_in_features_of_two(spark, monkeypatch):
    rnd = random.Random(32)
    sizes = [rnd.randint(10, 1000) for _ in range(150)]
    rows = [(1, i, n) for i, n in enumerate(sizes)] + [(2, i, sizes[i]) for i in range(20)]
    # Two nodes each, that fit but are unlike.
    rows += [(100 + i, 5_000 + 2 * i + k, 300) for i in range(200) for k in (0, 1)]
    postings = spark.createDataFrame(rows, "feature int, node long, n int")
    fits = lambda a, b: F.least(a, b) >= F.greatest(a, b) * 0.8
    alike = lambda pairs: pairs.where("b < 5000 and (a + b) % 7 = 0")
    held, write = [], common.Scratch.write

    def noted(self, df):
        found = write(self, df)
        held.append((set(df.columns), found.count()))
        return found

    monkeypatch.setattr(common.Scratch, "write", noted)
    up = list(range(150))
    for b in range(150):
        for a in range(b):
            if (a + b) % 7 == 0 and min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b]) and up[a] != up[b]:
                up = [up[a] if x == up[b] else x for x in up]
    for zone in (lambda n: F.floor(F.log(n) / F.log(F.lit(1.2625))),):
        held.clear()
        scratch = common.Scratch(spark, "joined")
        got = {r.node: r.root for r in common.joined(postings, fits, alike, scratch, chunk=32, zone=zone).collect()}
        scratch.close()
        assert set(got) == {i for i in range(150) if up.count(up[i]) > 1}
        assert len({(up[i], got[i]) for i in got}) == len({up[i] for i in got}) == len(set(got.values()))
        assert max(n for columns, n in held if "major" in columns and "times" in columns) <= 170


def test_documents_that_lose_no_line_are_not_dealt(spark):
    rows = spark.range(20_000).withColumn("text", F.lit("t"))
    touched, same = common.parted(rows, spark.range(0, 20_000, 4), "id")
    touched, same = [r.id for r in touched.collect()], [r.id for r in same.collect()]
    assert sorted(touched + same) == list(range(20_000)) and set(range(0, 20_000, 4)) <= set(touched) and len(same) > 14_000
    assert [x.count() for x in common.parted(rows, spark.range(0), "id")] == [0, 20_000]
