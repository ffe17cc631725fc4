"""Cross-tokenizer alignment against a plain version that encodes whole texts and walks their tokens."""

import hashlib
from collections import Counter, defaultdict

import sentencepiece
from tokenizers import Tokenizer

from tickloom.llm import crosstok
from tickloom.llm.spm import MODEL_PATH, Spec

TEXTS = [
    "The quick brown fox", "the  quick   brown fox", "trailing blank ", "trailing blanks  ", " ", "  ", "\n", "a\n b \n\n c", "Ünïcödé straße жизнь 中文字 😀😀", None, "", "a▁b", "▁",
    "<|endoftext|> <s> </s> <0x41> <unk>", "tab\tand\xa0 hard blank  wide", "It's we'll 'twas I'm!! ##$$%% 12345.678 x=y", "nul\x00byte", "gap\x1cgap two", "gap\x1d after", "word" * 3000,
    "same words same words same words", "é combining ﬁ ligature", "one", "The quick brown fox",
]


def plain(rows):
    a, b = Tokenizer.from_file(crosstok.BYTE_LEVEL_PATH), sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    a.encode_special_tokens = True
    with open(MODEL_PATH, "rb") as f:
        table_b = crosstok.piece_bytes(Spec.parse(f.read()))
    table_a = crosstok.byte_level_bytes(a.get_vocab())
    out, counts = [], Counter()
    for doc, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if b"".join(table_a[i] for i in ids_a) != raw or b"".join(table_b[i] for i in ids_b) != raw:
            ids_a = ids_b = []
        ends = []
        for ids, table in ((ids_a, table_a), (ids_b, table_b)):
            at, found = 0, {}
            for k, i in enumerate(ids):
                at += len(table[i])
                found[at] = k
            ends.append(found)
        groups, links, x, y = [], [], 0, 0
        for at in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0][at] + 1, ends[1][at] + 1
            groups.append(",".join(map(str, ids_a[x:p])) + "|" + ",".join(map(str, ids_b[y:q])))
            links.append((ids_a[p - 1], ids_b[q - 1]))
            x, y = p, q
        counts.update(links)
        out.append((doc, len(ids_a), len(ids_b), groups, links))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    rows = [(d, n, m, len(g), len(ls), sha(g), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls)) for d, n, m, g, ls in out]
    return rows, {(*k, n, n == most[k[1]]) for k, n in counts.items()}


def found(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "z", i) for i, t in rows], "doc_id long, text string, `a.b` string, _row long").repartition(3)
    done, pairs = crosstok.align_documents(docs, **more)
    assert done.columns == ["doc_id", "a.b", "_row", "_align"]
    order = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    return sorted((tuple(r) for r in done.select("doc_id", "_align.*").select(*order).collect()), key=repr), {tuple(r) for r in pairs.collect()}


def test_texts_of_every_kind(spark):
    rows = [(None if i == 3 else i, t) for i, t in enumerate(TEXTS)]
    wanted, pairs = plain(rows)
    for frequent in (100_000, 5, 0):  # all counts sent; most joined; all joined
        got, got_pairs = found(spark, rows, frequent=frequent)
        assert got == sorted(wanted, key=repr) and got_pairs == pairs, frequent


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    done, pairs = crosstok.align_documents(docs, frequent=50)
    wanted, all_pairs = plain(rows)
    order = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    assert sorted(tuple(r) for r in done.select("doc_id", "_align.*").select(*order).collect()) == sorted(wanted)
    assert {tuple(r) for r in pairs.collect()} == all_pairs


def test_empty_table_and_spelled_groups(spark):
    assert found(spark, []) == ([], set())
    done, _ = crosstok.align_documents(spark.createDataFrame([(1, "two words"), (2, None)], "doc_id long, text string"), spell=True)
    r = {x.doc_id: x._align for x in done.collect()}
    assert hashlib.sha256(r[1].groups.encode()).hexdigest() == r[1].groups_sha256 and r[1].groups.count(";") == r[1].n_groups - 1 and r[2].groups == ""


def test_identity_map_and_forgetting(monkeypatch):
    a, b = [b"a", b" b", b"", b"c"], [b"", b"a", b"c", b" b", b"c"]
    assert crosstok.identity(a, b).tolist() == [1, 3, -1, 4]
    with open(crosstok.BYTE_LEVEL_PATH) as f, open(MODEL_PATH, "rb") as g:
        aligner = crosstok.Aligner(f.read(), g.read())
    before = aligner.align(["some words here", "a▁b", "more"])
    monkeypatch.setattr(crosstok, "REMEMBERED", 0)
    after = aligner.align(["some words here", "a▁b", "more"])
    assert before[1] == after[1] and all((x == y).all() for x, y in zip(before[::2], after[::2], strict=True))
    assert before[0][1].tolist() == [0, 0, 0]


def test_segments_join_to_the_text():
    for t in TEXTS:
        if t:
            parts = crosstok.segments(t)
            assert "".join(parts) == " " + t and all(p.startswith(" ") and (p != " " or t == "") for p in parts)
