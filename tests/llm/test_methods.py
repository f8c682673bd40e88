"""What the operators' methods promise beyond their queries' digests: recall, scores, fixed points, pruning, linear time."""

import gc
import random
import re
import time
import tracemalloc
import weakref
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tally.llm import chat, common, decontam, hilbert, hostgraph, html_main, jaccard, packing, pii, quality, queries, simhash, token_orc, tokens
from tally.llm.tokens import Encoder


def words(rng, n, of=400, head="w"):
    return [f"{head}{rng.randrange(of)}" for _ in range(n)]


# 1


@pytest.mark.parametrize("copies", [10, 30, 300])
def test_frequent_items_are_found(spark, copies):
    short, nine = "one two three four five", [f"n{i}" for i in range(9)]
    edited = " ".join([*nine[:4], "other", *nine[5:]])
    bench = spark.createDataFrame([(1, short), (2, " ".join(nine)), (None, "an item without any id")], "item_id long, text string")
    rows = [(i, f"x{i} y {short} z") for i in range(copies)] + [(1000 + i, f"x{i} {edited} z") for i in range(copies)] + [(5000, "has an item without any id in it")]
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    found = Counter((r.item_id, r.score) for r in got)
    assert found == {(1, 1.0): copies, (2, round(7.5 / 9, 6)): copies, (None, 1.0): 1}


def edits(rng, item):
    """Copies with edits of every kind, some of them beyond the threshold."""
    n, kind, every = len(item), rng.choice("rida-"), rng.choice([2, 3, 4, 5, 8])
    out = []
    for i, w in enumerate(item):
        hit = i % every == every - 1
        if hit and (kind == "r" or (kind == "a" and rng.random() < 0.5)):
            out.append("other")
        elif hit and kind in "ia":
            out += [w, f"more{rng.randrange(9)}"]
        elif not (hit and kind == "d"):
            out.append(w)
    return out if kind != "-" else item[rng.randrange(n // 2) :]


def test_recall_is_that_of_whole_alignment():
    rng = random.Random(11)
    common_words = words(rng, 30, 12, "c")  # pairs that many items share
    items = [[rng.choice(common_words) if rng.random() < 0.5 else f"v{rng.randrange(300)}" for _ in range(rng.choice([4, 5, 6, 7, 10, 25, 60]))] for _ in range(120)]
    known = decontam.Items([(i, " ".join(x)) for i, x in enumerate(items)])
    assert known.keys.size < sum(len(x) - 1 for x in items)  # some pairs are too common to be seeds
    n_found = 0
    for _ in range(250):
        i = rng.randrange(len(items))
        doc = [rng.choice(common_words) for _ in range(rng.randrange(30))] + edits(rng, items[i]) + words(rng, rng.randrange(30), 300, "v")
        want = set()
        for k, x in enumerate(items):
            vocab = {w: j for j, w in enumerate(x, 1)}
            s = decontam.align(np.array([vocab[w] for w in x]), np.array([vocab.get(w, 0) for w in doc]))[0]
            if s >= max(decontam.THRESHOLD * len(x), decontam.FLOOR) - 1e-6:
                want.add(k)
        got = {k for k, p, _ in decontam.passages(known, " ".join(doc)) if decontam.similarity(items[k], p.split(" "))[0] * len(items[k]) >= known.least[k]}
        assert got == want
        n_found += len(want)
    assert n_found > 150


# 3


def test_sample_reads_one_partition(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id")).alias("text"))
    rows.repartition(40).write.parquet(f"{tmp_path}/d")
    docs = spark.read.option("maxPartitionBytes", 1).parquet(f"{tmp_path}/d")
    assert quality.sampled(docs, 100).count() == 100
    long = spark.createDataFrame([(1, "x " * 100_000), (2, "short one"), (3, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in quality.sampled(long, 10).collect()) == [2, 3]


# 4


def test_lookup_skips_stripes(spark, tmp_path):
    docs = spark.range(30_000).select((F.col("id") * 3).alias("doc_id"), F.concat_ws(" ", F.lit("text"), F.col("id"), F.repeat(F.lit("more "), 20)).alias("text"))
    path = f"{tmp_path}/ids"
    token_orc.write(docs, path, queries.tokenizer("word_bpe_49k.json"))
    want = [3 * 7, 3 * 15_000, 3 * 29_999]
    df = token_orc.lookup(spark, path, [*want, 3 * 7 + 1])
    assert sorted(r.doc_id for r in df.collect()) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(doc_id", plan)
    # a row group is 2000 rows: an id within the range of its group but absent is told by the Bloom filter
    assert scanned_rows(token_orc.lookup(spark, path, want)) <= 3 * 2000
    assert scanned_rows(token_orc.lookup(spark, path, [3 * 7 + 1])) < 2000
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    kinds = set()
    for f in spark.read.orc(f"{path}/ids").inputFiles():
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        if reader.getStripes().size():
            footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
            kinds |= {footer.getStreams(i).getKind().toString() for i in range(footer.getStreamsCount())}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds


def scanned_rows(df):
    """Rows that the scan of the ids has handed over."""
    df = df.select("doc_id", "ids")
    plan = df._jdf.queryExecution()
    df._jdf.collectToPython()
    out, todo = 0, [plan.executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        elif name.startswith("Scan orc"):
            out += p.metrics().apply("numOutputRows").value()
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_unknown_tokenizer_encodes_whole(tmp_path):
    import json

    own = json.load(open(queries.tokenizer("byte_bpe_50k.json")))
    own["pre_tokenizer"]["add_prefix_space"] = True
    path = f"{tmp_path}/t.json"
    json.dump(own, open(path, "w"))
    e = Encoder(path, True)
    texts = ["two words, here", " x\n\ny", ""]
    assert not e.known and e.encode(texts) == e._whole(texts)
    assert Encoder(queries.tokenizer("byte_bpe_50k.json"), True).known


# 5


def test_contexts_find_unseen_identifiers(spark):
    """Identifiers of unknown form behind learnt contexts, among plain numbers elsewhere."""
    rng = random.Random(17)
    hexa = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(20)) + "0a"
    odd = lambda: f"{''.join(rng.choice('ghjkmnp') for _ in range(4))}{rng.randrange(100, 999)}"
    fill = lambda: " ".join(words(rng, rng.randint(1, 6), 3000, "q"))
    long = "l" + "abcdefghij" * 4
    rows, planted = [], set()

    def add(text, value=None, kind="secret"):
        rows.append((len(rows), text))
        if value:
            at = text.index(value)
            planted.add((len(rows) - 1, kind, at, at + len(value)))

    for _ in range(12):
        add(f"plain {fill().replace('q', 'z')} my key is {hexa()} ok")
        add(f"reach me at mail {rng.choice('abc')}{rng.randrange(999)}@example.org today")
        add(f"{long}={hexa()}")
        add(f"k: {hexa()}")
        add(f"the year was {rng.randrange(1900, 2000)} and more")
    known = len(rows)
    for _ in range(4):
        v = odd()
        add(f"so my key is {v} then", v)
    v = odd()
    add(f"{long}={v}", v)
    add("k: hunter", "hunter")
    v = "joe55@localhost.localdomain"
    add("reach me at mail joe@intern99.lan, please", None)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    names = pii.KINDS
    got = set()
    for r in pii.found(df).collect():
        base = {(s.start, s.end) for s in r.base}
        got |= {(r.doc_id, names[s.k], s.start, s.end) for s in r.spans if (s.start, s.end) not in base}
    unseen = {g for g in got if g[0] >= known}
    assert unseen == planted  # precision and recall 1 on what no base pattern or key seed names
    assert all(rows[g[0]][1].startswith(("plain", long, "k:")) for g in got - unseen) and len(got - unseen) == 36


def test_scores_of_the_graph(spark):
    """Confidences against a plain fixed point."""
    rng = random.Random(23)
    edges = {}
    for v in range(120):
        seed = rng.choice([-1, -1, 0, 4])
        for p in rng.sample(range(40), rng.randint(1, 3)):
            edges[f"p{p}", f"v{v}"] = seed if rng.random() < 0.9 else -1
    rows = [(p, v, s) for (p, v), s in edges.items()]
    got = {(r.pattern, r.k): (r.confidence, r.support) for r in pii.scored(spark.createDataFrame(rows, "pattern string, value string, seed int"), 1e-6).collect()}
    of, seeds = defaultdict(list), {v for _, v, s in rows if s >= 0}
    for p, v, s in rows:
        of[p].append((v, s))
    conf = {}
    for _ in range(400):
        doubt = defaultdict(lambda: 1.0)
        for p, v, s in rows:
            for k in (0, 4):
                if len(of[p]) > 1 and v not in seeds:
                    doubt[v, k] *= 1 - pii.DAMPING * conf.get((p, k), 0.0)
        conf = {(p, k): sum(1.0 if s == k else (1 - doubt[v, k] if s < 0 and v not in seeds and len(own) > 1 else 0.0) for v, s in own) / len(own) for p, own in of.items() for k in (0, 4)}
    for key, c in conf.items():
        assert got.get(key, (0.0, 0))[0] == pytest.approx(c, abs=1e-4)
        assert got.get(key, (0.0, 0))[1] == sum(s == key[1] for _, s in of[key[0]])


def test_many_mentions_take_linear_time(spark):
    texts = ["1.1.1.1 " * 60_000, "a@b.cd " * 60_000, "key=x1 " * 60_000, "1 " * 200_000, "k=" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert got[0] == "<IP> " * 60_000
    assert got[1] == "<EMAIL> " * 60_000
    assert time.perf_counter() - began < 120


# 6 and the pipeline


def test_pipeline_by_brute_force(spark, sf):
    """The stages that drop documents: what stays is what plain versions of all of them leave, near copies by both links."""
    import corpus_pipeline as p

    docs = queries.table(spark, sf, "documents")
    want = {r.doc_id: r.text for r in docs.collect()}
    kept = sorted(r.doc_id for r in quality.judged(docs).collect() if r.kept)
    sets, fps = {}, {}
    for d in kept:
        w = want[d].encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
        fps[d] = simhash.fingerprint(want[d])
    root = {d: d for d in kept}
    for i, a in enumerate(kept):
        for b in kept[:i]:
            both = len(sets[a] & sets[b])
            if (fps[a] ^ fps[b]).bit_count() <= simhash.RADIUS or 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root[a], root[b]))
                root = {d: x if r == y else r for d, r in root.items()}
    bench = [(r.item_id, decontam.words_of(r.text)) for r in queries.table(spark, sf, "benchmark").collect()]
    clean = []
    for d in sorted(set(root.values())):
        w = decontam.words_of(want[d])
        vocab = {x: i for i, x in enumerate(set(w), 1)}
        b = np.array([vocab[x] for x in w])
        if not any(decontam.align(np.array([vocab.get(x, 0) for x in item]), b)[0] / len(item) >= decontam.THRESHOLD for _, item in bench):
            clean.append(d)
    for name, stage in p.STAGES[:-1]:
        docs = p.publish(stage(spark, docs, sf), name)
    assert sorted(r.doc_id for r in docs.collect()) == clean


def test_keep_one_of_repeated_rows(spark):
    """Repeated rows, many of them, beside copies under other ids; a long list of ids is joined in another way."""
    text = lambda i: " ".join(words(random.Random(i), 40))
    rows = [(1, text(1))] * 50 + [(2, text(1)), (3, text(3)), (4, text(4)), (4, text(4)), (5, text(3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    few = common.MAX_BROADCAST
    for most in (few, 0):
        simhash.short.__defaults__ = (most,)
        assert sorted(r.doc_id for r in simhash.keep_one(df, more=jaccard.links(df)).collect()) == [1, 3, 4]
    simhash.short.__defaults__ = (few,)


@pytest.mark.parametrize("dealt", [7, 50, jaccard.DEALT])
def test_common_hashes_are_dealt_by_text(spark, dealt):
    """One passage in every text, so that its hashes are common: the same links however its rows are dealt, by brute force."""
    rng = random.Random(4)
    line, rows = words(rng, 30, head="line"), []
    for i in range(40):
        own = words(rng, 60, of=10**6)
        rows += [" ".join(line + own), " ".join(line + own[:-2] + words(rng, 2, of=10**6, head="x"))]
        rows.append(" ".join(line + words(rng, 3 if i % 2 else 25, of=10**6, head="y")))
    rows += rows[:60]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    docs = df.select(simhash.text_hash(F.col("text")).alias("h"), "text")
    often = jaccard.common(docs, len(rows), jaccard.BUCKETS)
    assert often.size >= 5
    most = jaccard.prefixes(jaccard.BUCKETS, often, 1 + len(rows) // dealt)
    dealt_to = docs.mapInArrow(most, "bucket long, salt long, part binary").where("salt > 0").select("salt").distinct().count()
    assert dealt_to == (1 if dealt == jaccard.DEALT else 1 + len(rows) // dealt)
    texts = {r.h: r.text.split() for r in docs.collect()}
    sets = {h: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for h, w in texts.items()}
    near = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]

    def roots(edges):
        root = {h: h for h in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return {h: find(h) for h in sets}

    assert len(near) > 40
    assert roots(near) == roots((r.a, r.b) for r in jaccard.links(df, dealt=dealt).collect())


def test_prefixes_hold_little_of_a_batch():
    """However long the batches are, a task holds about 2^18 hashes, and all of them arrive."""
    rng, known, most = np.random.default_rng(6), {}, (1 << 18) + 400
    texts = [" ".join(map(str, x)) for x in rng.integers(0, 10**5, (3000, 600)).tolist()] + [None, ""]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, j)), pa.array(texts[i:j], pa.string())], ["h", "text"]) for i, j in ((0, 2990), (2990, 3000), (3000, 3002))]
    n = got = total = 0
    tracemalloc.start()
    for b in jaccard.prefixes(256, np.empty(0, np.int64), 1)(iter(batches)):
        held = 0
        for bucket, salt, part in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            x = np.frombuffer(part, jaccard.PART)
            held += x.size
            total += int(((x["key"].astype(np.uint64) << np.uint64(8) | np.uint64(bucket)) * (x["h"] + 1).astype(np.uint64)).sum())
            assert salt == 0
        assert held <= most
        got += held
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = 0
    for h, t in enumerate(texts):
        s = jaccard.prefix(t, known)[1]
        n += s.size
        want += int((((s >> np.uint64(32)) << np.uint64(8) | s & np.uint64(255)) * np.uint64(h + 1)).sum())
    assert got == n > 2 * most
    assert total % 2**64 == want % 2**64
    assert peak < 60e6


def test_workers_keep_nothing_of_other_work():
    """A stage's Python workers serve the next stage: it doesn't carry the tokenizer and chunks of the one before."""
    path = queries.tokenizer("byte_bpe_50k.json")
    made = weakref.ref(tokens.encoder(path, True))
    assert tokens.encoder(path, True) is made()
    list(common.lean(lambda batches: batches, "encoders")(iter([])))
    assert made() is not None
    list(common.lean(jaccard.prefixes(256, np.empty(0, np.int64), 1))(iter([])))
    gc.collect()
    assert made() is None


def test_discard(spark):
    t = common.publish(spark.range(3), "x")
    path = t._published
    assert spark.read.parquet(path).count() == 3
    common.discard(t, None, spark.range(2))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


# 7


def test_html_takes_linear_time():
    for x in ("<a ", "<div class='", '<a ">"', "<!", "</b ", "<!-- ", "<svg>", "<p><object>" + "<b>" * 1000 + "<div></div>" * 1000):
        began = time.perf_counter()
        html_main.Page((x * (5_000_000 // len(x)))[:5_000_000] if len(x) < 20 else x * 50)
        assert time.perf_counter() - began < 10


def test_unclosed_elements_lose_no_text():
    read = lambda x: html_main.main_texts([x], html_main.model())[0]
    assert read("<p>one <svg/>two words.</p><p>more text is here.</p>") == "one two words.\nmore text is here."
    assert read("<p>one<svg><path d=''/></svg> two.</p>") == "one two."
    assert read("<div><noscript>x<p>y</div><p>after it all.</p>") == "after it all."
    assert read("<p>before it.</p><script>var x = '<p>no</p>'") == "before it."


def other_page(rng):
    """(html, blocks of main text) of layouts by hand that the generator of the training pages does not make: nested
    tables, builders' wrappers with meaningless classes, definition lists, figures, microdata."""
    vocab = "time house water people small great never under think story where point world still found again between light might every country plant father food keep city".split()
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."
    blocks = [say(rng.randint(12, 60)) for _ in range(rng.randint(3, 9))]
    title = say(rng.randint(4, 9))[:-1]
    links = lambda n: " ".join(f"<a href='/{i}'>{rng.choice(vocab)}</a>" for i in range(n))
    kind = rng.randrange(5)
    if kind == 0:
        body = f"<table><tr><td class='left menu'>{links(12)}</td><td><h2>{title}</h2>" + "".join(f"<p>{b}</p>" for b in blocks) + f"</td></tr><tr><td colspan=2 id=copyright>&copy; 2020 {links(4)}</td></tr></table>"
    elif kind == 1:
        body = f"<div id=nav-bar><ul>{''.join(f'<li>{links(1)}' for _ in range(8))}</ul></div><div class=x1><div class=x2><h1 itemprop=headline>{title}</h1><div itemprop=articleBody>" + "".join(f"<p class=x9>{b}" for b in blocks) + f"</div></div></div><div class='footer small'>{links(6)}</div>"
    elif kind == 2:
        body = f"<header><a href=/>Home</a> {links(5)}</header><main role=main><h1>{title}</h1>" + "".join(f"<section><p>{b}</p></section>" for b in blocks) + f"</main><aside class=related><h4>Related</h4>{links(6)}</aside><footer>{links(5)} &copy;</footer>"
    elif kind == 3:
        body = f"<div class='cookie-banner'>We use cookies. {links(1)}</div><div class=wrapper><div class='entry'><h1>{title}</h1>" + "".join(f"<blockquote><p>{b}</p></blockquote>" if i % 4 == 3 else f"<p>{b}</p>" for i, b in enumerate(blocks)) + f"</div><div id=comments><div class=comment><p>{say(20)}</p></div></div></div>"
    else:
        body = f"<nav>{links(9)}</nav><article><header><h1>{title}</h1></header>" + "".join(f"<div class=para>{b}</div>" for b in blocks) + f"</article><form action=/s><input name=q><button>Go</button></form><footer><p>{links(3)}</p></footer>"
    return f"<!doctype html><html><head><title>{title} - site</title></head><body>{body}</body></html>", [title, *blocks]


def test_html_of_other_layouts():
    rng = random.Random(5)
    made = [other_page(rng) for _ in range(150)]
    got = html_main.main_texts([p for p, _ in made], html_main.model())
    hit = miss = extra = 0
    for text, (_, blocks) in zip(got, made, strict=True):
        have, want = Counter(text.split("\n")), Counter(blocks)
        hit, miss, extra = hit + sum((have & want).values()), miss + sum((want - have).values()), extra + sum((have - want).values())
    assert hit / (hit + miss) >= 0.9 and hit / (hit + extra) >= 0.9


# 8


def test_files_are_pruned_in_every_dimension(spark, tmp_path):
    rng = random.Random(2)
    langs = [f"{a}{b}" for a in "abcdef" for b in "xyz"]
    rows = [(i, " ".join(words(rng, int(2 ** rng.uniform(2, 9)))), rng.choice(langs), f"s{rng.randrange(50):02d}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_bytes", F.octet_length("text"))
    hilbert.write(docs, f"{tmp_path}/curve", shards=16, files=8)
    docs.repartition(128, "doc_id").write.parquet(f"{tmp_path}/hash")

    def files(kind, column, lo, hi):
        n = read = 0
        for f in (tmp_path / kind).rglob("*.parquet"):
            m = pq.ParquetFile(f).metadata
            at = m.schema.names.index(column)
            s = [m.row_group(g).column(at).statistics for g in range(m.num_row_groups)]
            n, read = n + 1, read + any(x.min <= hi and x.max >= lo for x in s)
        return read / n

    for column, lo, hi in (("lang", "cx", "cx"), ("source", "s20", "s20"), ("n_bytes", 70, 120)):
        assert files("hash", column, lo, hi) > 0.95
        assert files("curve", column, lo, hi) < 0.5


def test_shards_keep_clashing_columns(spark, tmp_path):
    rows = [(None if i % 2 else 7, f"text {i}", "en", None, 5, "c", i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, curve string, slot int")
    hilbert.write(docs, f"{tmp_path}/s", shards=4)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert {"shard", "curve", "slot", "_shard", "_slot"} <= set(back.columns)
    assert sorted(r.slot for r in back.collect()) == list(range(200)) and {r.shard for r in back.collect()} == {5}
    parts = hilbert.placed(docs)  # rows of one id are dealt by their texts
    assert parts.count() == 200
    with pytest.raises(ValueError, match="cells"):
        hilbert.placed(docs, bits=6)


# 9


def test_windows_fill_in_rank_order():
    rng = random.Random(3)
    docs = [words(rng, rng.randint(5, 60), 150) for _ in range(80)]
    index, sizes, window = packing.Index(docs), [len(d) + 1 for d in docs], 64
    used = [0] * len(docs)
    sequences = list(packing.pack_shard(sizes, index, window))
    for row in sequences:
        (seed, at, n), rest = row[0], row[1:]
        assert at == used[seed]
        used[seed] += n
        rank = [j for j in index.neighbours(seed).tolist() if j != seed and used[j] < sizes[j]]
        for k, (i, start, take) in enumerate(rest):
            assert start == used[i]
            if k < len(rank):
                assert i == rank[k]
            used[i] += take
    assert used == sizes and sum(sum(n for *_, n in row) < window for row in sequences) <= 1


def test_little_padding(spark, sf):
    rows = packing.packed(queries.table(spark, sf, "documents").coalesce(1), queries.tokenizer("byte_bpe_50k.json")).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n for r in rows) / (1024 * len(rows)) > 0.99


# 2


def test_output_is_read_in_pieces():
    t, rng = chat.Template(), random.Random(9)
    bits = ["###", "</turn>", "\\", " ", "\n", "a", "Role ", ": ", "### User: ", "#", "<", "/turn>"]
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "x</turn>: \n", "", "tool", "### "]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(0, 5))]
        whole = "".join(t.head(r) + t.quote(x) + t.tail() for r, x in turns)
        reader, out, at = chat.Reader(t), [], 0
        while at < len(whole):
            n = rng.randint(1, 20)
            out += reader.feed(whole[at : at + n])
            at += n
        assert out + list(reader.feed("", True)) == turns
    with pytest.raises(ValueError, match="does not end"):
        list(chat.Reader(t).feed("### User: half", True))


# 10


def test_ring_of_hosts(spark):
    """Trust and distrust far from the seeds, against linear algebra."""
    n, f = 100, hostgraph.FOLLOW
    edges = spark.createDataFrame([(f"h{i:03d}", f"h{(i + 1) % n:03d}", 1.0) for i in range(n)], "src string, dst string, w double")
    seeds = spark.createDataFrame([("h000", 1.0, 0.0), ("h050", 0.0, 1.0)], "host string, trust0 double, distrust0 double")
    got = {r.host: r for r in hostgraph.spread(edges, seeds).collect()}
    for i in range(n):
        assert got[f"h{i:03d}"].trust == pytest.approx((1 - f) * f**i / (1 - f**n), abs=1e-6)
        assert got[f"h{i:03d}"].distrust == pytest.approx((1 - f) * f ** ((50 - i) % n) / (1 - f**n), abs=1e-6)


def test_links_of_long_pages(spark):
    pages = [(1, "http://a.io/", '<a title="x > y href=//no.io" href="//yes.io/p">t</a> <a data-href="//data.io" href=\'https://two.io\'>'), (2, "http://b.io/", "<a " * 400_000), (3, "http://c.io/", "<a h" * 300_000 + "<a href=//end.io>")]
    began = time.perf_counter()
    got = {(r.src, r.dst) for r in hostgraph.links(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {("a.io", "yes.io"), ("a.io", "two.io"), ("c.io", "end.io")}
    assert time.perf_counter() - began < 60


def test_new_words_are_encoded_by_the_model_alone(monkeypatch):
    """Letters are one piece to the byte-level splitter: only other chunks are put together, encoded and cut again."""
    rng, asked = random.Random(5), []
    e = Encoder(queries.tokenizer("byte_bpe_50k.json"), True)
    simple = e._simple
    monkeypatch.setattr(e, "_simple", lambda chunks: asked.extend(chunks) or simple(chunks))
    texts = [" ".join("".join(rng.choice("abcEzéßÀøÿñ") for _ in range(rng.randrange(1, 90))) for _ in range(60)) + ". 12 a1 it's x-y ª µm\nEnd" for _ in range(40)]
    whole = [np.array(x.ids, "<u4").tobytes() for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == whole
    assert asked and not any(re.fullmatch(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+", c) for c in asked)
