"""Sharding, BPE, packing, SimHash, cover trees, pages and personal data against brute force."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from skein.llm import bpe, covertree, html, packing, pii, sharding, simhash

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = ["", "a", " ", "\n\n  x", "<|endoftext|>", "a<|endoftext|> b" * 50, "héé  " * 200, "\x1c \x1dA" * 100, "日本語 テスト　x " * 100, "  " * 500, "a b  c  d " * 90, "'s 't don't I'll " * 80, "x" * 70000, "12 34\t\n\n\n 5 " * 300, "🙂 🙂🙂  " * 100, None]
LETTERS = ["a", "B", " ", "  ", "\n", "\t", "é", "É", "\xa0", "　", "'s", "<|endoftext|>", "9", "!", "\x1c", "ñ", "🙂", "́", "don't", "\r\n", "İ", "Σ", "½"]


def texts(seed, n, longest):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(1, longest))) for _ in range(n)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# 2. sharding


def jump(key, n):
    mask = (1 << 64) - 1
    key &= mask
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & mask
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one_and_moves_rows_only_into_the_new_shard():
    keys = np.r_[np.arange(-50, 3000), [2**63 - 1, -(2**63)]]
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]
    a, b = sharding.jump_hash(keys, 16), sharding.jump_hash(keys, 17)
    assert set(b[a != b]) == {16} and 0 < (a != b).mean() < 0.12
    with pytest.raises(ValueError):
        sharding.jump_hash(keys, 0)


def test_sharding_gives_gapless_slots(spark):
    rows = [(i % 150, "t", 5, "x") for i in range(300)] + [(None, None, None, None)] * 3
    got = sharding.assign_shards(frame(spark, rows, "k long, Shard string, rows_there int, slice string"), "k", 4).collect()
    assert len(got) == 303
    slots = defaultdict(list)
    for r in got:
        assert r.shard == jump(-1 if r.k is None else r.k, 4) and r.grown_shard in (r.shard, 4)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(frame(spark, [], "k long"), "k", 4).count() == 0


# 3. BPE


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), ",".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False)


def test_chunks_give_the_ids_of_the_whole_text(tokenizer):
    coder = bpe.ChunkCoder(public_tokenizers.path("byte_bpe_50k.json"))
    prose = "the quick brown fox, jumps over 13 lazy dogs.\nAnd then? " * 40
    for text in [*ODD, *texts(1, 400, 700), prose, "Other start. " + prose, prose]:
        n, ids, decoded = coder.code(text)
        assert (n, ids.decode(), decoded.decode()) == expected(tokenizer, text)
    assert coder.hits > 0  # the shared passage was encoded once


def test_cuts_depend_on_content():
    body = random.Random(2).randbytes(20000)
    a, b = bpe.cuts(body), bpe.cuts(b"something before" + body)
    assert a[-1] == len(body) and len({x + 16 for x in a} & set(b)) > 0.8 * len(a)
    assert bpe.cuts(b"") == [0] and max(np.diff([0, *bpe.cuts(b"a" * 100000)])) <= bpe.MAX_CHUNK


def test_bpe_rows(spark, tokenizer):
    rows = [(i, t, "n") for i, t in enumerate([*ODD, *ODD])]
    df = bpe.encode_decode(frame(spark, rows, "doc_id long, text string, n_tokens string"), "text", public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"], arrays=True)
    for r in df.collect():
        n, ids, decoded = expected(tokenizer, rows[r.doc_id][1])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert ",".join(map(str, r.ids)) == ids and r.decoded == decoded
    assert bpe.encode_decode(frame(spark, [], "a long, t string"), "t", public_tokenizers.path("byte_bpe_50k.json"), ["a"]).count() == 0


# 9. packing


def test_words_give_the_ids_of_the_whole_text():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, words = Tokenizer.from_file(path), packing.Words(path)
    for text in [t or "" for t in ODD] + texts(3, 500, 300):
        assert words.text(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_documents(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, t) for i, t in enumerate([*ODD, "word " * 300, "word " * 300])]
    df = packing.pieces(frame(spark, rows, "doc_id long, text string"), "text", path, ["doc_id"], capacity=256, ids=True)
    got = packing.pack(df, capacity=256).collect()
    check_packing(got, 256)
    whole, pieces = Tokenizer.from_file(path), defaultdict(dict)
    for r in got:
        pieces[r.doc_id][r.piece] = r
    for i, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            r, part = pieces[i][k], ids[at : at + 256]
            assert (r.start, r.length, r.ids, r.ids_crc32) == (at, len(part), part, zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
        assert len(pieces[i]) == k + 1


def test_packing_is_near_its_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND", 128)
    rnd = random.Random(4)
    sizes = [rnd.randint(1, 100) for _ in range(1000)] + [100] * 5
    df = frame(spark, [(x, "c") for x in sizes], "length long, offset string")
    got = packing.pack(df, capacity=100).collect()
    assert sorted(r.length for r in got) == sorted(sizes)
    assert check_packing(got, 100) <= 1.03 * sum(sizes) / 100 + 1
    assert packing.pack(frame(spark, [], "length long")).count() == 0
    with pytest.raises(Exception, match="lengths"):
        packing.pack(frame(spark, [(101,)], "length long"), capacity=100).count()


def test_evolution_beats_or_matches_best_fit():
    rnd = random.Random(5)
    for trial in range(5):
        sizes, rng = [rnd.randint(20, 60) for _ in range(120)], np.random.default_rng(trial)
        deme = packing.evolve(sizes, 100, packing.settle(sizes, 100, 4, rng), 12, rng)
        for bins in deme:
            assert sorted(x for b in bins for x in b) == list(range(120)) and all(sum(sizes[x] for x in b) <= 100 for b in bins)
        plain = packing.best_fit(sorted(range(120), key=lambda i: -sizes[i]), sizes, 100, [])
        assert len(deme[0]) <= len(plain)


def test_islands_beat_best_fit_and_elites_migrate(spark, tmp_path):
    from skein.llm.common import Scratch

    rnd = random.Random(6)
    sizes = [rnd.randint(30, 45) for _ in range(800)]
    plain = len(packing.best_fit(sorted(range(800), key=lambda i: -sizes[i]), sizes, 100, []))
    got = packing.pack(frame(spark, [(x,) for x in sizes], "length long"), capacity=100).collect()
    assert sorted(r.length for r in got) == sorted(sizes)
    assert -(-sum(sizes) // 100) <= check_packing(got, 100) < plain
    island = packing._islander(100, 0)
    items = frame(spark, [(0, d, False, i, x, None, None, None, None) for d in (0, 1) for i, x in enumerate(sizes)], packing._ISLAND_ROWS)
    state = Scratch(spark, "test").write(items.groupBy("grp", "deme").applyInArrow(island, packing._ISLAND_ROWS))
    state = state.groupBy("grp", "deme").applyInArrow(packing._islander(100, 1), packing._ISLAND_ROWS).collect()
    elite = {(r.deme, r.guest): {x.no: x.bins[0] for x in state if (x.deme, x.guest) == (r.deme, r.guest)} for r in state}
    assert elite[1, True] == elite[0, False] and elite[0, True] == elite[1, False]


def test_sizes_that_fit_badly_never_meet_in_one_group(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(packing, "ISLAND", 100)
    packed = packing._packed
    monkeypatch.setattr(packing, "_packed", lambda items, *rest: (seen.append(items.groupBy("grp").count().agg({"count": "max"}).first()[0]), packed(items, *rest))[1])
    got = packing.pack(frame(spark, [(52,)] * 1500, "length long"), capacity=100).collect()
    assert check_packing(got, 100) == len(got) == 1500
    assert len(seen) == 1 and seen[0] < 200


# 5. SimHash


def brute_fingerprint(text, k):
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_fingerprints():
    for t in [*ODD, "a B", "a b c d", "a b c d e", "Ünï code words here now", *texts(6, 40, 200)]:
        assert simhash.fingerprint(t) == brute_fingerprint(t, 4)


@pytest.mark.parametrize("tile", [1 << 15, 8])
def test_near_duplicates(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rnd = random.Random(7)
    base = [[rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 99)) for _ in range(120)] for _ in range(6)]
    rows = [(None, "null key"), (900, None), (901, ""), (902, " \n")]
    for i in range(60):
        words = list(base[i % 6])
        for _ in range(i % 4):
            words[rnd.randrange(len(words))] = "x"
        rows.append((i, " ".join(words)))
    rows += rows[4:8]
    got = simhash.near_duplicates(frame(spark, [(*r, 1) for r in rows], "doc_id long, text string, fingerprint int"), "doc_id", "text").collect()
    assert len(got) == len(rows)
    prints = {k: simhash.fingerprint(t) for k, t in rows if k is not None}
    want = groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(want.items())
    assert want[901] == 900 and len(set(want.values())) < 50
    assert simhash.near_duplicates(frame(spark, [], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_bit_slices_find_what_comparison_finds():
    rnd = random.Random(8)
    for radius in (0, 1, 3, 4, 7):
        values = set()
        for _ in range(12):
            b = rnd.getrandbits(64)
            for _ in range(rnd.randint(1, 30)):
                x = b
                for k in rnd.sample(range(64), rnd.randint(0, radius + 1)):
                    x ^= 1 << k
                values.add(x)
        v = np.array(sorted(values), np.uint64)
        bucket = np.sort(np.array([rnd.randint(0, 2) for _ in v]))
        of = dict(zip(v.tolist(), bucket.tolist()))
        a, b = simhash.bucket_links(v, bucket, radius)
        pairs = {frozenset(p) for p in zip(a.tolist(), b.tolist())}
        near = lambda x, y: (x ^ y).bit_count() <= radius and of[x] == of[y]
        assert all(near(*p) for p in pairs)
        assert groups(v.tolist(), near) == groups(v.tolist(), lambda x, y: frozenset((x, y)) in pairs)


def test_masks_leave_no_pair_out():
    rnd = random.Random(9)
    for rows, radius in ((10, 4), (10**7, 4), (10**10, 3)):
        masks = simhash.key_masks(rows, radius)
        for _ in range(300):
            x = sum(1 << k for k in rnd.sample(range(64), radius))
            assert any(not x & m for m in masks)


# 6. embeddings


def test_vectors_against_brute_force(spark):
    g = np.random.default_rng(10)
    base = g.normal(size=(4, 8))
    rows, i = [], 0
    for b, s in zip(base, (0.02, 0.08, 0.3, 1)):
        for _ in range(40):
            rows.append((i, (b + g.normal(size=8) * s).tolist(), i % 2))
            i += 1
    rows += [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [float("nan")] * 8, 0), (1003, [None] * 8, 0), (1004, rows[0][1], None), (1005, [1.0, 2.0], 0), (1006, [], 0), (1007, [1e-200 * x for x in rows[0][1]], 0)]
    good = {k: (np.array(v) / max(map(abs, v)), label) for k, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and any(v)}

    def linked(a, b):
        if a not in good or b not in good or good[a][1] != good[b][1] or len(good[a][0]) != len(good[b][0]):
            return False
        x, y = good[a][0], good[b][0]
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98

    keys = [r[0] for r in rows]
    want = groups(keys, linked)
    for block in (2048, 16):
        got = covertree.near_vectors(frame(spark, [(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, n_links int"), "vec_id", "embedding", "label", block=block).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {k: (sum(linked(k, x) for x in keys if x != k), want[k], want[k] == k) for k in keys}
    assert any(v > 5 for v in [r.n_links for r in got]) and covertree.near_vectors(frame(spark, [], "vec_id long, embedding array<float>, label int"), "vec_id", "embedding", "label").count() == 0


def test_cover_tree_invariants():
    g = np.random.default_rng(11)
    x = np.concatenate([c + g.normal(size=(80, 6)) * s for c, s in zip(g.normal(size=(4, 6)), (0.01, 0.1, 0.5, 1))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = covertree.CoverTree(x)
    assert sorted(t.order) == list(range(len(x)))
    for node, kids in enumerate(t.children):
        here = t.order[t.lo[node] : t.hi[node]]
        assert np.linalg.norm(x[here] - x[t.centre[node]], axis=1).max() <= t.radius[node] + 1e-6
        if kids:
            assert t.centre[kids[0]] == t.centre[node] and sum(t.hi[k] - t.lo[k] for k in kids) == len(here)
    close = x @ x.T >= 0.98
    np.fill_diagonal(close, False)
    counts, _, edges = covertree.dual(t, t, 0.98, True)
    assert (counts == close.sum(axis=1)).all() and all(close[a, b] for a, b in edges)


# 7. pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("just text", "just text"),
        ("<article><h1>T</h1><p><b>One.<br><p>Two &amp; <i>three</i>\n four</p></article><footer>&copy; x</footer>", "T\nOne.\nTwo & three four"),
        ("<nav><a href=/a>a</a></nav><header>h</header><main><p>Body <a href=b>link</a> text.</p><aside>s</aside><form>f</form><div class='cookie-notice'>c</div><section id=comments><p>reader</p></section></main>", "Body link text."),
        ("<article><p>a<script>var t='</p>';</script>b</p><style>p{}</style><ul><li>x<li>y</ul><table><tr><td>c<td>d</table></article>", "ab\nx\ny\nc\nd"),
        ("<p>a</p><p>b", "a\nb"), ("<article>&lt;p&gt; &#233;&eacute;</article>", "<p> éé"), ("<article><p>Of.</p></article><p>outside</p>", "Of."), ("<!-- c --><article>a<!-- b -->c</article", "ac"), ("<div class=ad>buy</div>", ""),
    ],
)
def test_pages(page, text):
    assert html.extract(page) == text


def test_block_rules_without_article():
    long = "the man of the house was in the garden and he had to go to the shop with his dog on a day that was as long as it was hot"
    page = f"<div><a href=1>Home</a> <a href=2>About us</a></div><div>{long}</div><div>Short.</div><div>{long}</div><div><a href=3>Next page</a></div>"
    assert html.extract(page) == f"{long}\nShort.\n{long}"


def test_page_rows(spark):
    rows = [(1, "u", None, "x"), (2, "u", "<p>é　a</p>" * 3, "y"), (2, "u", "<p>é　a</p>" * 3, "y")]
    got = html.extract_pages(frame(spark, rows, "page_id long, url string, html string, text string"), "html", ["page_id", "url"]).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, "", 0)] + [(2, "é a\né a\né a", 11)] * 2
    assert html.extract_pages(frame(spark, [], "page_id long, html string"), "html", ["page_id"]).count() == 0


# 10. personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = {}
    for kind, p in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(p, text):
            digits = re.sub(r"\D", "", m[0])
            luhn = sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and luhn) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out[kind].append(m.span())
    return out


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(12)
    parts = [*"ab.@-+ 1239450()%\n,", "@", "4111111111111111", "1.2.3.4", "a@b.c", "+1 (988) 555-2485", "é"]
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text)


def test_contexts_find_what_patterns_miss(spark, tmp_path):
    rows = [(i, f"customer {i} has tel: {'+1 (988) 555-%04d' % i if i % 3 else '988 555 %04d' % i} since 1999") for i in range(30)]
    rows += [(100, None), (101, ""), (102, "plain words only, version: 3"), (0, rows[0][1])]
    frame(spark, rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d")).withColumnRenamed("doc_id", "row_id")
    got = pii.find_pii(df, "text", ["row_id"]).collect()
    assert len(got) == len(rows)
    texts_of = dict(rows)
    for r in got:
        text = texts_of[r.row_id] or ""
        base = pii.spans_text(brute_spans(text))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
        more = [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "id"]
        assert more == (["988 555 %04d" % r.row_id] if r.row_id < 30 and r.row_id % 3 == 0 else [])
    clean = {r.row_id: r.text for r in pii.redact(df, "text").collect()}
    assert clean[0] == "customer 0 has tel: [ID] since 1999" and clean[1] == "customer 1 has tel: [PHONE] since 1999" and clean[100] is None
    assert pii.find_pii(frame(spark, [], "d long, text string"), "text", ["d"]).count() == 0
