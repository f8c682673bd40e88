"""Each operator against a brute-force version, an exact round trip or held-out accuracy; and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.llm import chat, decontam, hilbert, hostgraph, html_main, jaccard, packing, pii, quality, queries, simhash, token_orc
from tally.llm.tokens import Encoder

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp string, _words string, shard int"
WORDS = "alpha beta gamma delta omega sigma kappa theta lambda tau rho phi chi psi zeta".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, clashing column names."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t\x0b\x0c\r ", "en", "a", 7), (4, long, "en", "a", len(long)), (5, "for " * 500, "en", "b", 2000), (6, "é " * 3 + "漢字", "zh", None, 8)]
    rows += [(7, "same row", "en", "a", 8)] * 3 + [(None, prose(rng, 80), "de", "b", 400), (None, "no id", "de", "b", 5)]
    rows += [(10 + i, prose(rng, 60 + i), rng.choice(["en", "fr"]), f"s{i % 3}", 300) for i in range(30)]
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows], DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


# 1


def test_decontamination(spark, odd, empty):
    rng = random.Random(3)
    item = [f"w{i}" for i in range(30)]
    edited = [w if i % 6 else f"x{i}" for i, w in enumerate(item)]
    far = [w if i % 2 else f"x{i}" for i, w in enumerate(item)]
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, "too short"), (4, " ".join(WORDS))], "item_id long, text string")
    pad = lambda x: f"{prose(rng, 40)} {' '.join(x)}. {prose(rng, 40)}"
    docs = [(100, pad(item)), (101, pad(edited)), (102, pad(far)), (103, pad(item[:10])), (104, pad(item).upper()), (105, prose(rng, 200)), (100, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) == {(100, 1), (101, 1), (104, 1)} and got[100, 1] == 1.0
    assert got == {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs, bench, slice_bytes=50).collect()}
    # common seeds: the passage is found by its line of seeds alone
    assert {r.doc_id for r in decontam.contaminated(docs, bench, rare_least=0, rare_share=0).collect()} == {100, 101, 104}
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()) == [100, 102, 103, 105]
    assert decontam.drop_contaminated(odd, bench).count() == odd.count()
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(odd, bench.limit(0)).count() == 0


def test_alignment_is_smith_waterman():
    rng = random.Random(8)
    for _ in range(50):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(1, 12))] for _ in "ab")
        h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1][j + 1] = max(0, h[i][j] + (decontam.MATCH if x == y else decontam.MISMATCH), h[i][j + 1] + decontam.GAP, h[i + 1][j] + decontam.GAP)
        assert decontam.align(np.array(a), np.array(b))[0] == pytest.approx(max(map(max, h)))


def test_line_of_seeds_is_exact():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 200)
        hits = np.array([(0, rng.randint(0, 3), rng.randint(0, 900), 0) for _ in range(n)])
        off = hits[:, 2] - hits[:, 1]
        most = max(len(set(hits[(off >= o) & (off <= o + decontam.SLACK), 1])) for o in off)
        assert decontam.on_line(hits) == min(most, decontam.MIN_LINE)


def test_edited_copy_of_a_common_item(spark):
    """Verbatim copies elsewhere take nothing from an edited one that keeps two seeds."""
    item = [f"w{i}" for i in range(21)]
    edited = [f"x{i}" if i in (5, 9, 13, 17) else w for i, w in enumerate(item)]
    bench = spark.createDataFrame([(k, " ".join([*item, f"v{k}"][:21 + (k > 1)])) for k in range(1, 4)], "item_id long, text string")
    docs = spark.createDataFrame([(0, " ".join(["a", *edited, "b"]))] + [(k, " ".join(["a", *item, "b"])) for k in range(1, 51)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs, bench).collect()}
    assert got[0, 1] == pytest.approx((17 - 2) / 21, abs=1e-6)
    assert {d for d, k in got if k == 1} == set(range(51)) and decontam.drop_contaminated(docs, bench).count() == 0


def test_items_of_one_id(spark):
    one, two = "a b c d e f g h", "q r s t u v w x"
    bench = spark.createDataFrame([(1, one), (1, two)], "item_id long, text string")
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert sorted((r.doc_id, r.score) for r in decontam.contaminated(docs, bench).collect()) == [(1, 1.0), (2, 1.0)]


# 2


def test_chat(spark):
    tricks = [queries.TRAP, "", None, "\\", "\\\\###", "#####", "</turn></turn", "### User: \n", "a\\</turn>"]
    rng = random.Random(4)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool: x", None, "</turn>"]), rng.choice(tricks)))
    rows += [(50, 0, "user", "q"), (50, 1, "assistant", "a"), (51, 0, "assistant", "a"), (52, None, "user", "q"), (52, 1, "user", "r"), (None, 0, "user", "z"), (50, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit(1)).repartition(5)
    got = {r.conv_id: r for r in chat.digests(chat.segments(df)).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert not got[50].valid and not got[51].valid and not got[52].valid
    assert chat.digests(chat.segments(df.limit(0))).count() == 0
    one = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string")
    parts = chat.segments(one).collect()
    assert "".join(p.segment for p in parts) == "### System: s</turn>\n### User: q</turn>\n### Assistant: a</turn>\n" and parts[-1].valid
    assert [p.segment for p in parts if p.loss] == ["a"]


# 3


def test_quality(odd, empty):
    got = quality.judged(odd).collect()
    assert len(got) == odd.count()
    want = Counter()
    for doc_id, t in texts(odd):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = list(zip(w, w[1:], w[2:], strict=False))
        n = Counter(tri)
        cover = {i + k for i, x in enumerate(tri) if n[x] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        base = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        want[doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), base] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.judged(empty).count() == 0
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    clash = odd.withColumns({"n_words": F.lit("x"), "kept": F.lit(7)})
    assert quality.judged(clash, ["n_words", "kept", "lang"]).where("kept").count() == kept.count()
    assert quality.keep_good(clash).columns == clash.columns


def test_quality_order(odd):
    sample = quality.measured(odd)
    order = quality.cascade_order(sample, quality.rules())
    assert {k for k, *_ in order} == set(quality.rules())
    worth = [rate / sec for _, rate, sec in order]
    assert worth == sorted(worth, reverse=True)


# 4 and 9


@pytest.mark.parametrize("name,keep", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_is_exact(name, keep):
    rng = random.Random(1)
    bits = ["a", "B", "é", "e\u0301", " ", "  ", "\n", "\n\n", "\t", "1", "'s", "!", "<|endoftext|>", "<", "|", "Σ", "ß", "漢", "\u2003", "\x1c", "\x85", "\xa0", "😀", "İ", ".", ",", "foo", "x" * 70]
    samples = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(8000)]
    for most in (50, 300_000):
        e = Encoder(queries.tokenizer(name), keep, most)
        assert [x for i in range(0, len(samples), 50) for x in e.encode(samples[i : i + 50])] == e._whole(samples)


def test_orc_round_trip(spark, odd, empty, tmp_path):
    path, tok = f"{tmp_path}/ids", queries.tokenizer("word_bpe_49k.json")
    token_orc.write(odd, path, tok, block=1000)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_orc.digests(token_orc.read(spark, path)).collect()), key=lambda r: r[0])
    e = Encoder(tok, False)
    own = Counter()
    for doc_id, t in texts(odd):
        ids = e.encode([t or ""])[0] + (1).to_bytes(4, "little")
        own[doc_id, len(ids) // 4, zlib.crc32(ids)] += 1
    assert Counter(r[1:] for r in got) == own
    assert [r[0] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    ids = [r[1] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert token_orc.read(spark, path).where("doc_id = 4").agg(F.max("block")).first()[0] > 10
    token_orc.write(empty, f"{path}0", tok)
    assert token_orc.digests(token_orc.read(spark, f"{path}0")).count() == 0


def test_packing(odd, empty):
    tok = queries.tokenizer("byte_bpe_50k.json")
    e = Encoder(tok, True)
    rows = packing.packed(odd.coalesce(1), tok, window=128, shard_docs=20, shard_tokens=100_000).collect()
    whole = Counter()
    for doc_id, t in texts(odd):
        whole[doc_id, e.encode([t or ""])[0] + bytes(4)] += 1
    seqs = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1].tolist()] and sum(n for _, n in s) <= 128
    assert sum(sum(n for _, n in s) < 128 for s in seqs.values()) <= 4
    single = {k: v for k, v in whole.items() if k[0] not in (None, 7)}
    for doc_id, ids in single:
        own = sorted((r.start, bytes(r.ids), r.doc_tokens) for r in rows if r.doc_id == doc_id)
        assert b"".join(x for _, x, _ in own) == ids and own[0][2] == len(ids) // 4
    assert sum(r.length for r in rows) == sum(len(k[1]) // 4 * n for k, n in whole.items())
    assert packing.packed(empty, tok).count() == 0


def test_neighbours_are_bm25():
    docs = [["a", "b", "x"], ["a", "b", "y"], ["c", "x"], ["d"], ["e", "f"], ["g"], ["h"]]
    assert packing.Index(docs).neighbours(0).tolist()[0] in (0, 1) and set(packing.Index(docs).neighbours(0).tolist()) == {0, 1, 2}
    assert packing.Index(docs).neighbours(3).tolist() == []


def test_neighbours_of_long_documents():
    """All terms count: documents of hundreds of words against BM25 term by term."""
    rng = random.Random(31)
    vocab = [f"w{i}" for i in range(1500)]
    docs = [rng.choices(vocab, [1 / (i + 5) for i in range(1500)], k=rng.randint(200, 500)) for _ in range(60)]
    index, mean = packing.Index(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    for i in range(0, 60, 7):
        score = {}
        for j, d in enumerate(docs):
            tf = Counter(d)
            s = sum(max(0, np.log((60 - df[w] + 0.5) / (df[w] + 0.5))) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for w in set(docs[i]) if tf[w] and df[w] > 1)
            if s > 0:
                score[j] = s
        got = index.neighbours(i).tolist()
        assert set(got) == set(score)
        assert [score[j] for j in got] == pytest.approx(sorted(score.values(), reverse=True))


# 5


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark, odd, empty):
    rng = random.Random(6)
    bits = ["a.b@c.d", "x@y.z_foo@bar.com", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "00000000000000000001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+1", "é漢", " ", "\n", "12", ".", "-", "word", "99999999999999999999999.1.1.1"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(400)] + [(1000, "a" * 200_000), (1001, "1" * 50_000), (1002, "+" + "1 " * 30_000)]
    got = pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = dict(rows)
    assert all([(s.start, s.k, s.end) for s in r.base] == base_spans(want[r.doc_id]) for r in got) and len(got) == len(rows)
    assert pii.found(odd).count() == odd.count() and pii.found(empty).count() == 0
    masked = pii.mask(odd)
    assert masked.columns == odd.columns and masked.count() == odd.count()
    clash = spark.createDataFrame([(1, "me: a@b.cd", 2, "s", 3)], "doc_id long, text string, _id int, _spans string, _Hash int")
    assert [tuple(r) for r in pii.mask(clash).collect()] == [(1, "me: <EMAIL>", 2, "s", 3)]


def test_pii_bootstrap(spark):
    rng = random.Random(9)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(20)) + "0a"
    rows = [(i, f"see password={key()} there") for i in range(8)] + [(20, "my password=hunter2 ok"), (21, "note: nothing here"), (22, "note: other words"), (23, f"note: {key()}"), (24, "é mail me: joe@x.org now"), (20, "my password=hunter2 ok")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.k, s.value) for s in r.spans] for r in pii.found(df).collect()}
    assert got[20] == [(12, 4, "hunter2")] and got[21] == got[22] == got[23] == [] and got[24] == [(11, 0, "joe@x.org")]
    text = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert text[20] == "my password=<SECRET> ok" and text[24] == "é mail me: <EMAIL> now"


# 6


def brute_components(fps):
    u = sorted(set(fps))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(u):
        for b in u[:i]:
            if (a ^ b).bit_count() <= simhash.RADIUS:
                root[find(a)] = find(b)
    return {x: find(x) for x in u}


@pytest.mark.parametrize("groups,limit", [(6, 16_384), (7, 6), (8, 3)])
def test_links_and_components(spark, groups, limit):
    rng = random.Random(groups)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for base in fps[:4]:
        for _ in range(60):
            base ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.append(base)
    df = spark.createDataFrame([(simhash.signed(x),) for x in set(fps)], "fp long")
    named = {r.node: r.root for r in simhash.components(simhash.links(df, groups, limit)).collect()}
    got, want = {}, {}
    for x, r in brute_components(fps).items():
        got.setdefault(named.get(simhash.signed(x), simhash.signed(x)), set()).add(x)
        want.setdefault(r, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()}.__len__() == 1


def test_near_duplicates(odd, empty):
    import xxhash

    def slow(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))

    rows = texts(odd)
    root = brute_components([slow(t) for _, t in rows])
    least = {}
    for d, t in rows:
        r = root[slow(t)]
        least[r] = d if least.get(r) is None else min(x for x in (d, least[r]) if x is not None)
    want = Counter((d, simhash.signed(slow(t)), least[root[slow(t)]]) for d, t in rows)
    assert Counter(map(tuple, simhash.near_duplicates(odd).collect())) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert {7, 1} <= {r.doc_id for r in kept.collect()} and kept.where("doc_id = 7").count() == 1 and kept.where("doc_id IN (1, 2, 3)").count() == 1
    assert kept.where("doc_id IS NULL").count() == 2
    assert kept.count() == len({root[slow(t)] for _, t in rows})


def test_keep_one_without_ids(spark):
    """Documents are told apart by id and text; columns with the names that the operator would use stay."""
    rng = random.Random(12)
    a, b, c = (prose(rng, 90) for _ in range(3))
    rows = [(None, a), (None, a), (None, b), (5, b), (9, c), (9, a + " x"), (3, c)]
    df = spark.createDataFrame([(d, t, 1, "h", k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, _id int, _HASH string, first int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    root = brute_components([simhash.fingerprint(t) for _, t in rows])
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len({root[simhash.fingerprint(t)] for _, t in rows}) and (3, c) in got and (5, b) in got


@pytest.mark.parametrize("limit", [jaccard.MAX_GROUP, 4])
def test_jaccard_links(spark, empty, limit):
    """What word shingles of similarity 0.8 connect, by brute force, and the pipeline's stage on the same texts."""
    import corpus_pipeline as p

    rng = random.Random(21)
    rows = ["", None, "two words", "Two  WORDS", "a b c d e", "a b c d e f"]
    for _ in range(12):
        own = [f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 30, 120, 300]))]
        for k in range(8):
            rows.append(" ".join(w if rng.random() > k / 200 else f"x{rng.randrange(10**6)}" for w in own))
        rows.append(" ".join(own + [f"y{rng.randrange(900)}" for _ in range(len(own) // 4)]))
    line = " ".join(f"line{i}" for i in range(12))
    rows += [f"{line} {' '.join(f'z{rng.randrange(10**6)}' for _ in range(40))}" for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, fps = [grams(t) for t in rows], [simhash.fingerprint(t) for t in rows]
    near = lambda i, j: len(sets[i] | sets[j]) > 0 and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])

    def roots(link):
        up = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                if link(i, j):
                    a, b = up[i], up[j]
                    up = [min(a, b) if x in (a, b) else x for x in up]
        return up

    hashes = [r.h for r in df.orderBy("doc_id").select(simhash.text_hash(F.col("text")).alias("h")).collect()]
    edges = {frozenset((r.a, r.b)) for r in jaccard.links(df, limit).collect()}
    got = roots(lambda i, j: hashes[i] == hashes[j] or frozenset((hashes[i], hashes[j])) in edges)
    assert got == roots(lambda i, j: hashes[i] == hashes[j] or near(i, j))
    assert any(near(i, j) and (fps[i] ^ fps[j]).bit_count() > 4 for i in range(len(rows)) for j in range(i))
    if limit > 4:
        want = roots(lambda i, j: near(i, j) or (fps[i] ^ fps[j]).bit_count() <= 4)
        assert sorted(r.doc_id for r in p.near_dedup(spark, df, "").collect()) == sorted(set(want))
        assert p.near_dedup(spark, empty, "").count() == 0


# 7


def test_html_held_out():
    rng = random.Random(123)
    pages = [html_main.made_page(rng) for _ in range(200)]
    got = html_main.main_texts([p for p, _ in pages], html_main.model())
    assert sum(a == b for a, (_, b) in zip(got, pages, strict=True)) >= 196


def test_html_odd(spark):
    bad = ["", None, "plain & simple &amp; text", "<p>", "</p></div>", "<div " * 50, "<" * 1000, "<!-- open", "<script>x", "<div>" * 5000 + "deep", "<a href='>x", "&#x41;&bogus;" * 3, "<p>one<p>two</article></body>"]
    df = spark.createDataFrame([(i, None, h, "c") for i, h in enumerate(bad)] + [(0, None, "", "c")], "page_id long, url string, html string, text string")
    got = html_main.extracted(df).collect()
    assert len(got) == len(bad) + 1 and all(r.text is not None for r in got)
    assert {r.page_id: r.text for r in got}[2] == "plain & simple & text"
    assert html_main.extracted(df.limit(0)).count() == 0
    page = "<html><body><nav><a href=/>menu words here</a></nav><article><h1>A &lt;b&gt;</h1><p>one\n two<b>three</b> four<p>five &amp;amp; six</article><div class=comments><p>a reader says a lot of things</p></div><footer>&copy; me</footer>"
    assert html_main.main_texts([page], html_main.model()) == ["A <b>\none twothree four\nfive &amp; six"]


# 8


def test_curve_is_hilbert():
    n = 8
    at = {html: xyz for xyz in ((a, b, c) for a in range(n) for b in range(n) for c in range(n)) if (html := hilbert.curve_index(xyz, 3)) is not None}
    assert sorted(at) == list(range(n**3))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(n**3 - 1))


def test_shards(spark, odd, empty, tmp_path):
    rows = hilbert.placed(odd, shards=5).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == odd.count() and set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts(odd))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert hilbert.placed(empty).count() == 0
    hilbert.write(odd.drop("shard"), f"{tmp_path}/s", shards=5)
    assert spark.read.parquet(f"{tmp_path}/s").count() == odd.count()


# 10


def test_hosts_and_rules(spark):
    urls = ["http://A.Example.org/es/1", "https://x.example.org/en/12?q", "https://x.example.org/en/2#f", "http://b.com/fr/a", "http://b.com/de", "http://b.com/de/x", "http://org", "http://org/", "http://notorg/", "no scheme", None, "x://É.ORG/://", "http://h.net?a/b"]
    df = spark.createDataFrame([(i, u, None, 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host int")

    def slow(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for v, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, None)))

    for r in hostgraph.judged(df, queries.RULES).collect():
        host, path, rule, verdict = slow(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
    assert hostgraph.judged(df.limit(0), queries.RULES).count() == 0


def test_distrust_spreads(spark):
    link = lambda *hosts: "".join(f'<a class=x href="//{h}/p">x</a>' for h in hosts)
    pages = [(1, "http://bad.net/", ""), (2, "http://feeder.io/", link("bad.net")), (3, "http://good.org/", link("fine.io", "good.org")), (4, "http://fine.io/", link("far.io")), (5, "http://far.io/", None), (6, "http://mixed.org/", link("bad.net", "fine.io"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = [("block", "bad.net", "/"), ("allow", "org", "/")]
    got = {r.host: r for r in hostgraph.judged(df, rules).collect()}
    assert [got[h].verdict for h in ("bad.net", "feeder.io", "good.org", "fine.io", "far.io", "mixed.org")] == ["block", "block", "allow", "allow", "allow", "allow"]
    hosts = [p[1][7:-1] for p in pages]
    down, up = np.zeros((6, 6)), np.zeros((6, 6))
    edges = [(1, 0), (2, 3), (3, 4), (5, 0), (5, 3)]
    for a, b in edges:
        down[b, a] = 1 / sum(x == a for x, _ in edges)
        up[a, b] = 1 / sum(y == b for _, y in edges)
    t0, d0 = np.array([h.endswith(".org") for h in hosts], float), np.array([h == "bad.net" for h in hosts], float)
    f = hostgraph.FOLLOW
    t, d = (np.linalg.solve(np.eye(6) - f * m, (1 - f) * v) for m, v in ((down, t0), (up, d0)))
    for i, h in enumerate(hosts):
        assert (got[h].trust, got[h].distrust) == (pytest.approx(t[i], abs=1e-4), pytest.approx(d[i], abs=1e-4))


# all


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    got = con.execute(queries.oracle_sql()[name])
    cols = [x[0] for x in got.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == sorted(got.fetchall(), key=repr)


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = queries.table(spark, sf, "documents")
    names, want = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in quality.judged(docs).collect() if r.kept}
    root = brute_components([simhash.fingerprint(want[d]) for d in kept])
    least = {}
    for d in sorted(kept):
        least.setdefault(root[simhash.fingerprint(want[d])], d)
    bench = [(r.item_id, decontam.words_of(r.text)) for r in queries.table(spark, sf, "benchmark").collect()]
    clean = []
    for d in sorted(least.values()):
        w = decontam.words_of(want[d])
        vocab = {x: i for i, x in enumerate(set(w), 1)}
        b = np.array([vocab[x] for x in w])
        if not any(decontam.align(np.array([vocab.get(x, 0) for x in item]), b)[0] / len(item) >= decontam.THRESHOLD for _, item in bench):
            clean.append(d)
    for name, stage in p.STAGES[:-1]:
        docs = p.publish(stage(spark, docs, sf), name)
        assert docs.columns == names
    assert sorted(r.doc_id for r in docs.collect()) == clean
    rows = p.run(spark, sf).collect()
    e = Encoder(queries.tokenizer("byte_bpe_50k.json"), True)
    text = {r.doc_id: r.text for r in docs.collect()}
    for d in clean:
        own = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == d)
        assert b"".join(x for _, x in own) == e.encode([text[d]])[0] + bytes(4)
