"""Near-duplicates, search, toxicity, site quality and the pipeline against plain versions and held-out labels."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import ann, neardup, site_quality, toxicity

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain_components(texts, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates(spark):
    """Chains of edits: neighbours are linked, ends are not, and some members are far from every centre."""
    rng = np.random.default_rng(3)
    texts, n = {}, 0
    for _ in range(6):
        words = [f"w{x}" for x in rng.integers(0, 500, 120)]
        for _ in range(14):
            texts[n] = " ".join(words)
            words = list(words)
            words[rng.integers(0, 120)] = f"z{n}"
            n += 1
    texts |= {n: None, n + 1: "", n + 2: "two words", n + 3: "TWO  words\n", n + 4: "other words", n + 5: "y " * 30_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("rep", F.lit(1))
    for percent in (85, 80):
        want, sizes = plain_components(texts, percent)
        got = {r["doc_id"]: r for r in neardup.near_duplicates(df, percent).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert {i: r["n_shingles"] for i, r in got.items()} == sizes
        assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    null = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in neardup.near_duplicates(null).collect()) == [(0, 0, True), (5, 5, True), (5, 5, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_large_bucket_of_alike_but_unlinked_texts(spark, monkeypatch):
    """Texts that share a part of three quarters, in pairs that are linked: the second pass meets them in small blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = np.random.default_rng(7)
    shared = [f"s{x}" for x in range(240)]
    texts = {}
    for i in range(60):
        own = [f"o{i}x{x}" for x in range(40)]
        texts[2 * i] = " ".join(shared + own)
        other = list(own)
        other[rng.integers(0, 40)] = "changed"
        texts[2 * i + 1] = " ".join(shared + other)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, _ = plain_components(texts, 85)
    assert len(set(want.values())) == 60
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 85).collect()} == want


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    for share in (0.95, 0.85, 0.5):
        for _ in range(20):
            both = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            rest = int(1000 * (1 - share) / share / 2)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, rest, dtype=np.uint64)])) for _ in range(2))
            for samples, bits, margin in (neardup.COARSE, neardup.FINE):
                x, y = (neardup.odd_sketch(neardup.signature(neardup.mix(s), samples), bits) for s in (a, b))
                differing = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
                assert differing <= neardup.differing_bits(share - margin, samples, bits)
                assert share > 0.5 or differing > neardup.differing_bits(0.8 - margin, samples, bits)


@pytest.mark.parametrize("block", [4096, 500])
def test_search(spark, monkeypatch, block):
    """Also where the table has several blocks, so that most are searched within a bound."""
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "QUERY_BLOCK", block // 20)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 24))
    x[10] = x[20] = x[30]
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)] + [(3000, None), (3001, [0.0] * 24), (3002, [float("nan")] * 24), (3003, [None] * 24), (3050, [1.0, 2.0]), (None, [1.0] * 24), (0, [float(v) for v in x[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.filter("vec_id % 50 = 0")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        hits += sum(r["score"] >= np.sort(s)[-5] - 1e-12 for r in own)
    assert hits / (60 * 5) >= 0.9
    assert not [r for r in got if r["query_id"] in (3000, 3050)]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in ann.nearest(few, few.filter("vec_id = 0")).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert ann.nearest(few.limit(0), few.limit(0)).count() == 0


@needs_data
def test_recall_on_embeddings(spark):
    """Recall at 5 against brute force, and the share of vectors that a query verifies."""
    df = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = n = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -9
        hits += len(got[ids[q]] & set(ids[np.argsort(-s)[:5]].tolist()))
        n += 5
    assert n and hits / n >= 0.9


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    docs, labels = [], []
    for i in range(600):
        words = [f"w{x}" for x in rng.integers(0, 300, 40)]
        if i % 3 == 0:
            words.insert(int(rng.integers(0, 40)), "Nasty!")
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    docs += [(1000, None), (1001, ""), (1002, "w1 " * 20_000 + "nasty"), (1, docs[1][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (None, 1), (2000, None), (2001, 7)], "doc_id long, label int")
    model = toxicity.learn(d, lab.filter("doc_id < 400"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    held = [i for i in range(400, 600)]
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in held]) > 0.95 and got[1002] > 0.5
    assert got[1000] == got[1001] and 0 <= got[1000] <= 1 and len(model[1]) < 5000
    assert toxicity.score(d.limit(0), toxicity.learn(d.limit(0), lab.limit(0))).count() == 0


def test_toxicity_matches_plain_ftrl(spark):
    """Features, training and scores against dictionaries and one coordinate at a time."""
    import math

    import xxhash

    mask, mul = (1 << 64) - 1, 0x9E3779B97F4A7C15
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, 12)) + (" Nasty!" if i % 3 == 0 else "") for i in range(90)]

    def plain_features(text):
        h = [xxhash.xxh3_64_intdigest(w.strip(toxicity.PUNCTUATION)) for w in text.lower().encode().split()]
        codes = list(h)
        for gap in (1, 2, 3):
            codes += [((h[i] * mul + gap) & mask) * mul & mask ^ h[i + gap] for i in range(len(h) - gap)]
        return sorted({(c * mul & mask) >> 42 for c in codes})

    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 90, 2)], "doc_id long, label int")
    bias, at, w = toxicity.learn(d, labels)
    order = sorted(range(0, 90, 2), key=lambda i: (xxhash.xxh3_64_intdigest(texts[i].encode()) >> 1, i % 3 == 0))
    z, n, b, bn = {}, {}, 0.0, 0.0
    f = toxicity.Ftrl()

    def weight(k):
        x = z.get(k, 0.0)
        return 0.0 if abs(x) <= f.l1 else (math.copysign(f.l1, x) - x) / ((f.beta + math.sqrt(n.get(k, 0.0))) / f.alpha + f.l2)

    for _ in range(4):
        for i in order:
            own = plain_features(texts[i])
            ws = {k: weight(k) for k in own}
            g = 1 / (1 + math.exp(-(b + sum(ws.values())))) - (i % 3 == 0)
            for k in own:
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / f.alpha
                z[k], n[k] = z.get(k, 0.0) + g - sigma * ws[k], n.get(k, 0.0) + g * g
            bn += g * g
            b -= 0.1 * g / (1 + math.sqrt(bn))
    want = {k: weight(k) for k in z if abs(z[k]) > f.l1}
    assert abs(bias - b) < 1e-6 and set(at.tolist()) == set(want) and len(want) > 3
    assert all(abs(x - want[k]) < 1e-5 for k, x in zip(at.tolist(), w.tolist(), strict=True))
    for r in toxicity.score(d, (bias, at, w)).collect():
        s = b + sum(want.get(k, 0.0) for k in plain_features(texts[r["doc_id"]]))
        assert abs(r["score"] - 1 / (1 + math.exp(-s))) < 1e-5


def test_site_quality_matches_plain(spark):
    """Evidence, both shrunk rates and posteriors, recomputed one by one; and sites decide where texts say nothing."""
    import math
    import re

    from tickloom.llm.quality_rules import text_counts

    rng = np.random.default_rng(2)
    docs, urls, label = [], [], {}
    for i in range(240):
        host, path = i % 6, (i // 6) % 2
        good = rng.random() < (0.9 if host < 3 else 0.1)
        words = [f"w{x}" for x in rng.integers(0, 200, 40)] + (["##"] * 6 if rng.random() < (0.1 if good else 0.5) else [])
        docs.append((i, " ".join(words), "s"))
        urls.append((f"http://H{host}.org/p{path}/{i}.html",))
        if i % 2:
            label[i] = int(good)
    d, pages = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(urls, "url string")
    got = {r["doc_id"]: r for r in site_quality.classify(d, pages, spark.createDataFrame(list(label.items()), "doc_id long, label int")).collect()}

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_alpha_words", "n_distinct_words")
    bins = {}
    for i, text, _ in docs:
        env = dict(zip(names, text_counts(text), strict=True))
        value = lambda e: (lambda a, b: eval(a, {}, env) / eval(b, {}, env) if eval(b, {}, env) else 0)(*e.split("/")) if "/" in e else eval(e, {}, env)
        bins[i] = {n: 0 if (v := value(e)) <= 0 else 1 + math.floor(math.log2(1 + v)) for n, e in site_quality.FEATURES.items()}
    ratio = {}
    for n in site_quality.FEATURES:
        kinds = {bins[i][n] for i in label}
        for k in kinds:
            p, q = ((sum(bins[i][n] == k and y == v for i, y in label.items()) + 2) / (sum(y == v for y in label.values()) + 2 * len(kinds)) for v in (1, 0))
            ratio[n, k] = math.log(p / q)
    evidence = {i: sum(ratio.get((n, b), 0.0) for n, b in bins[i].items()) for i in bins}
    odds = math.log((sum(label.values()) + 1) / (len(label) - sum(label.values()) + 1))
    p = {i: 1 / (1 + math.exp(-(e + odds))) for i, e in evidence.items()}
    host = {i: f"h{i % 6}.org" for i in p}
    path = {i: (host[i], f"p{i // 6 % 2}") for i in p}
    sums = lambda by: {k: (len(v), sum(v), sum(x * x for x in v)) for k in set(by.values()) for v in [[p[i] for i in p if by[i] == k]]}
    hosts, paths = sums(host), sums(path)
    rate = (sum(p.values()) + 1) / (len(p) + 2)

    def strength(groups, mean):
        own = [(g / n - mean(k), max(0.0, (s - g * g / n) / (n - 1)), n) for k, (n, g, s) in groups.items() if n > 1]
        between = sum(gap * gap - w / n for gap, w, n in own) / len(own)
        return 1000.0 if between <= 0 else min(1000.0, max(1.0, sum(w for _, w, _ in own) / len(own) / between))

    kh = strength(hosts, lambda k: rate)
    kp = strength(paths, lambda k: (hosts[k[0]][1] + kh * rate) / (hosts[k[0]][0] + kh))
    for i in p:
        (n, g, _), (m, q, _) = hosts[host[i]], paths[path[i]]
        hr = min(1 - 1e-6, max(1e-6, (max(0.0, g - p[i]) + kh * rate) / (n - 1 + kh)))
        pr = min(1 - 1e-6, max(1e-6, (max(0.0, q - p[i]) + kp * hr) / (m - 1 + kp)))
        want = 1 / (1 + math.exp(-(evidence[i] + math.log(pr / (1 - pr)))))
        r = got[i]
        assert abs(r["evidence"] - evidence[i]) < 1e-9 and abs(r["host_rate"] - hr) < 1e-9 and abs(r["path_rate"] - pr) < 1e-9 and abs(r["quality"] - want) < 1e-9
    plain = [i for i in p if not re.search("##", docs[i][1])]
    good, bad = ([got[i]["quality"] for i in plain if (i % 6 < 3) == v] for v in (True, False))
    assert 2 * (1 - np.mean(good)) < 1 - np.mean(bad)  # the same kind of text, on better and on worse hosts


@needs_data
def test_held_out_figures(spark):
    """Site quality on labels that it hasn't seen."""
    read = lambda n: spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{n}.parquet")
    labels = read("labels").select("doc_id", F.col("quality").alias("label"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    done = site_quality.classify(read("documents"), read("pages"), labels.filter(fold != 0))
    held = done.join(labels.filter(fold == 0), "doc_id").select("label", "kept").collect()
    assert np.mean([r["kept"] == bool(r["label"]) for r in held]) > 0.9


def test_site_quality_edges(spark):
    good = " ".join(f"word{i} and" for i in range(60))
    docs = [(i, good + str(i), "a", 1) for i in range(30)] + [(i, "### $$$ " * 60 + str(i), None, 1) for i in range(30, 60)] + [(60, None, "a", 1), (None, good, "b", 1), (1, good, "a", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, host int")
    pages = spark.createDataFrame([(f"http://H{i % 3}.org/en/{i}.html?q=1",) for i in range(40)] + [(None,), ("nonsense",), ("http://h.org/en/3",)], "url string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(0, 60, 2)] + [(None, 1), (4, None)], "doc_id long, label int")
    got = site_quality.classify(d, pages, labels).collect()
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert len(got) == len(docs) and all(kept[i] for i in range(30)) and not any(kept[i] for i in range(30, 60)) and kept[None]
    assert {r["host"] for r in got} == {"h0.org", "h1.org", "h2.org", "h.org", "source:a", "source:b", "source:"} - (set() if any(r["host"] == "h.org" for r in got) else {"h.org"})
    assert site_quality.classify(d, pages.limit(0), labels.limit(0)).count() == len(docs)
    assert site_quality.classify(d.limit(0), pages, labels).count() == 0


@needs_data
def test_pipeline_and_queries(spark):
    import corpus_pipeline
    from tickloom.llm.queries import queries

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (None, "some words for a row without an id", "en", "s", None), (9002, "", "en", "s", 0), (9003, "123", "en", "s", 3)], docs.schema)
    docs = docs.unionByName(odd)
    now, ids = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, DATA)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}", mode="overwrite")
        now = spark.read.parquet(path)
        ids.append({r["doc_id"] for r in now.select("doc_id").collect()})
    assert not {9001, 9002, 9003} & ids[0] and None in ids[0]
    want, _ = plain_components({r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in ids[0] - {None}}, 80)
    assert ids[1] - {None} == {i for i, c in want.items() if i == c}
    assert ids[2] == ids[1] and ids[3] <= ids[2] and now.filter("not parity or not round_trip").count() == 0
    assert set(queries()) == {"op1_chat_format", "op2_surrogates", "op3_quality_rules", "op4_toxicity", "op5_language_id", "op6_source_mix", "op7_nearest_vectors", "op8_near_duplicates", "op9_site_quality", "op10_sentencepiece", "op11_embedding_whitening", "op12_tokenizer_alignment", "op13_line_dedup"}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    """Of rows that are equal in id and text one stays, with or without an id; columns of any name keep their values."""
    import corpus_pipeline

    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text), (1, text), (None, text), (2, "other words that are quite unlike the first ones here"), (None, "a b c d e f g"), (None, "a b c d e f g"), (3, None), (4, ""), (1, "the same id with another text that is long enough to stay")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = ["_key", "_text_key", "count", "_size", "_pii", "_mix", "_spm", "_lang", "rep", "Text_key"]
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted({(1, text), (2, rows[3][1]), (0, "a b c d e f g"), (3, ""), (4, ""), (1, rows[8][1])})
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.identify_language, corpus_pipeline.mix, corpus_pipeline.replace_private_data):
        out = stage(spark, docs, "")
        own = [n for n in names if n in out.columns]
        assert set(out.columns) >= set(docs.columns) - {"_pii", "_mix", "_lang"} and all(r[n] == names.index(n) for r in out.collect() for n in own if n not in ("_pii", "_mix", "_lang"))
    assert corpus_pipeline.replace_private_data(spark, docs.drop("n_chars"), "").count() == len(rows)
    assert corpus_pipeline.tokenize(spark, docs, "").filter("parity and round_trip").count() == len(rows)
