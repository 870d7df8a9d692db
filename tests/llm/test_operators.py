"""Small tests of the other operators: brute force, exact round trips, held-out accuracy, and odd rows."""

import random
import zlib

import numpy as np

from tidewright.llm import decontaminate, langid, language_model, line_dedup, packing, quality, url_filter, warc


def test_quality_learns_and_handles_odd_rows(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(40)) if i % 2 else " ".join([word()] * 20 + ["!!", "##"] * 10)) for i in range(120)] + [(None, None), (500, ""), (501, "x " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as label", "0.5 as score")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(3, None), (5, 1), (5, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.score(docs, model, "q")
    assert out.columns == [*docs.columns, "q"]
    got = {r.doc_id: r.q for r in out.collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(80, 120)) and 0 <= got[500] == got[None] <= 1
    assert quality.train(docs, labels.limit(0)).score("x") == 1 / (1 + np.exp(-30))
    assert quality.score(docs.limit(0), model, "q").count() == 0


def test_dual_coordinate_descent_against_projected_gradient():
    """Both reach the least of |w|^2/2 + C sum max(0, 1 - y w x) over normed rows with a constant feature."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 30, 12)) for _ in range(80)]
    y = np.where([x.mean() + rng.normal(0, 3) > 14.5 for x in rows], 1.0, -1.0)
    r = rng.normal(0, 1, 30)
    dense = np.zeros((80, 31))
    for i, x in enumerate(rows):
        dense[i, x] = r[x] / np.sqrt((r[x] ** 2).sum())
        dense[i, 30] = 1
    cost = 0.5
    loss = lambda w: w @ w / 2 + cost * np.maximum(0, 1 - y * (dense @ w)).sum()
    w, b = quality.descend(rows, r, y, cost, 4000)
    q = (dense @ dense.T) * np.outer(y, y)
    alpha, step = np.zeros(80), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(60_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, cost)
    plain = dense.T @ (alpha * y)
    assert abs(loss(np.append(w, b)) - loss(plain)) < 0.01 * loss(plain) and loss(plain) < 0.9 * loss(np.zeros(31))


def test_longest_matches_against_substrings():
    rng = random.Random(2)
    text = "".join(rng.choice("ab ") for _ in range(300))
    a = langid.Automaton(text)
    for _ in range(100):
        q = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 40)))
        n = at = 0
        while at < len(q):
            size = 1
            while at + size < len(q) and q[at : at + size + 1] in text:
                size += 1
            at, n = at + size, n + 1
        assert a.phrases(q) == n


def test_langid(spark):
    rng = random.Random(3)
    parts = {"aa": "ka lo mi te".split(), "bb": "schu trei pfel gnor".split()}
    rows = [(i, " ".join("".join(rng.choices(parts[x], k=2)) for _ in range(30)), x) for i in range(60) for x in [("aa", "bb")[i % 2]]]
    docs = spark.createDataFrame([*rows, (100, None, "aa"), (101, "12 !", "aa"), (102, rows[0][1], None), (None, rows[1][1], "")], "doc_id long, text string, lang string").selectExpr("*", "1 as score")
    model = langid.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert all(got[i][0] == x for i, _, x in rows) and got[100] == got[101] == ("und", 0.0) and got[102][0] == "aa" and got[None][0] == "bb"
    assert langid.train(docs.limit(0)).predict("a b") == ("und", 0.0)
    null = spark.createDataFrame([(None, "ka lo mi", "aa"), (None, "schu trei", "bb"), (1, "ka ka", "aa")], "doc_id long, text string, lang string")
    assert langid.train(null).predict("kalo")[0] == "aa"


def test_langid_prediction_against_substrings():
    """The winner has the least sum over words of greedy longest matches, found by plain search, times log of its text's size."""
    rng = random.Random(12)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randrange(1, 7)))
    texts = [(x, " ".join(word(a) for _ in range(n))) for x, a, n in (("p", "abcde", 400), ("q", "cdefg", 40), ("r", "aegbx", 90))]
    model = langid.Model({x: (f" {' '.join(dict.fromkeys(t.split()))} ", len(t) + 1) for x, t in texts})
    for _ in range(60):
        text = " ".join(word(rng.choice(("abcde", "cdefg", "aegbx", "abcdefgxz"))) for _ in range(rng.randrange(1, 12)))
        costs = {}
        for x, t in texts:
            n = 0
            for w in text.split():
                q, at = f" {w} ", 0
                while at < len(q):
                    size = 1
                    while at + size < len(q) and q[at : at + size + 1] in f" {t} ":
                        size += 1
                    at, n = at + size, n + 1
            costs[x] = n * np.log2(2 + len(t) + 1)
        assert abs(costs[model.predict(text)[0]] - min(costs.values())) < 1e-9


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    own, enc, rng = Tokenizer.from_file(path), packing.Encoder(path), random.Random(4)
    texts = ["", None, "a <|endoftext|> b", "x<|startoftext|>y", "It's THE end, don't!!", "ß. größer 12a3 ...", "日本語 text", "a b", "é", "x\x01y", *("".join(rng.choice("abtheou'sd ,.!-19é\n") for _ in range(80)) for _ in range(200))]
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == own.encode(t or "", add_special_tokens=False).ids


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", 40)
    rows = [(i, "word " * (i * 7 % 90)) for i in range(150)] + [(7, "word " * 49), (None, None), (999, "long " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece")
    got = packing.pack(packing.pieces(docs, packing.default_tokenizer(), 64), 64).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert total == sum(len((t or "").split()) + 1 for _, t in rows) and len(by) <= 1.1 * total / 64 + 1
    assert sorted((r.start, r.length) for r in got if r.doc_id == 999) == [(i * 64, min(64, 301 - i * 64)) for i in range(5)]
    one = next(r for r in got if r.doc_id is None)
    assert one.length == 1 and one.ids_crc32 == zlib.crc32(b"\0\0\0\0")
    assert packing.pack(packing.pieces(docs.limit(0), packing.default_tokenizer())).count() == 0


def test_myers_against_dynamic_programming():
    rng = random.Random(5)
    for _ in range(200):
        p, t = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, n))] for n in (9, 15))
        row = [0] * (len(t) + 1)
        for i, w in enumerate(p):
            new = [i + 1]
            for j, x in enumerate(t):
                new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
            row = new
        assert decontaminate.myers(p, t)[0] == min(row)


def test_decontamination(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 1)
    item = "one two three four five six seven eight nine ten eleven twelve"
    near = item.upper().replace("FOUR", "4, and").replace(" ", "\n")
    rows = [(1, f"pre {near} post"), (2, item.replace("two", "x").replace("six", "y").replace("nine", "z")), (3, None), (4, ""), (None, f"a {item} b {item}"), (5, "w " * 40_000 + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id")
    items = spark.createDataFrame([(10, item), (11, ""), (12, None), (13, "one two"), (14, "something else that is not there at all")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(docs, items).collect()}
    assert got == {(1, 10): 2, (None, 10): 0, (5, 10): 0, (1, 13): 0, (None, 13): 0, (5, 13): 0}
    assert {r.item_id for r in decontaminate.matches(docs, items, 3).collect()} == {10}
    places = [decontaminate.Matcher([(1, item)]).find(f"{'a b c ' * k}{item} {item.replace('two', 'x')}")[0] for k in range(4)]
    assert places == [(1, 0, 3 * k) for k in range(4)]
    left = decontaminate.drop_matching(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4]
    assert decontaminate.matches(docs, items.limit(0)).count() == 0


def test_decontamination_against_brute_force(spark):
    """Every passage within the error budget of an item is found, at its least distance; nothing else is."""
    rng = random.Random(11)
    words = "a b c d e f g".split()
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate((1, 2, 3, 5, 6, 7, 11, 12, 13, 18, 24))]
    texts = []
    for i in range(120):
        x = rng.choices([*words, "h", "i", "j"], k=rng.randrange(0, 30))
        part = items[rng.randrange(len(items))][1].split()
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(part) + 1)
            part[k : k + rng.randrange(2)] = rng.choices(words, k=rng.randrange(2))
        at = rng.randrange(len(x) + 1)
        texts.append((i, " ".join(x[:at] + part + x[at:])))

    def least(p: list[str], t: list[str]) -> int:
        row = [0] * (len(t) + 1)
        for i, w in enumerate(p):
            new = [i + 1]
            for j, x in enumerate(t):
                new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    want = {(i, k, d) for i, t in texts for k, p in items if (d := least(p.split(), t.split())) <= len(p.split()) // 6}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(docs, benchmark).collect()} == want and len(want) > 50


def test_line_dedup(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MEMBERS_PER_SALT", 2)
    shared = "\n".join(f"shared line number {i} of the passage" for i in range(12))
    rows = [(i, f"own {i}\nmore of {i}\n{shared}\nend {i}") for i in range(6)] + [(20, None), (21, ""), (22, "a\na\na"), (0, f"own 0\nmore of 0\n{shared}\nend 0"), (None, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "2 as size")
    got = {r.doc_id: (r.text, r.lines_removed) for r in line_dedup.dedup(docs).collect()}
    assert got[0] == (rows[0][1], 0) and got[20] == (None, 0) and got[21] == ("", 0) and got[22] == ("a\na\na", 0)
    for i in range(1, 6):
        assert got[i][1] >= 6 and got[i][0].startswith(f"own {i}\n") and got[i][0].endswith(f"end {i}")
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_line_dedup_passages_against_brute_force(spark):
    rng = random.Random(8)
    line = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    passages = [[line(k) for k in sizes] for sizes in ((60,), (51,), (30, 25), (26, 26), (50, 1), (20, 0, 31), (15, 20, 20), (13, 13, 13, 13), (11,) * 5, (9, 9, 9, 9, 9, 9), (25, 25), (50,), (4, 60, 3))]
    texts = []
    for i in range(60):
        x: list[str] = []
        for p in rng.sample(passages, 3):
            x += [line(rng.randrange(1, 20)) for _ in range(rng.randrange(1, 4))] + p
        texts.append([*x, f"end {i}"])
    texts += [["w " * 60, "own", "w " * 60], ["v"] * 200]  # twice in one text; a run that overlaps itself
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    want, seen = [], {}
    for i, x in enumerate(texts):
        runs = {(a, b) for a in range(len(x)) for b in range(a + 1, min(a + 120, len(x)) + 1) if len(" ".join(x[a:b]).split()) > 50}
        gone = set()
        for a, b in sorted(runs | {(a, b) for a, b in line_dedup.chunks("\n".join(x)) if b - a >= 2 and len("\n".join(x[a:b])) >= 40}):
            d, stop = seen.setdefault(tuple(x[a:b]), (i, b))
            if (d, stop) != (i, b):
                gone.update(range(max(a, stop) if d == i else a, b))
        want.append(("\n".join(y for k, y in enumerate(x) if k not in gone), len(gone)))
    got = {r.doc_id: (r.text, r.lines_removed) for r in line_dedup.dedup(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    # rows of one id, null among them, with different texts; repeated rows; clashing names
    odd = [(5, texts[0] + ["five"]), (5, texts[1]), (5, texts[1]), (None, texts[2]), (None, texts[0] + ["none"]), (None, texts[2]), (1, ["first own"] + texts[1][2:]), (7, texts[0])]
    rows = spark.createDataFrame([(i, "\n".join(x)) for i, x in odd], "doc_id long, text string").selectExpr("*", "1 as row", "2 as id", "3 as n")
    hashed = {"\n".join(x): h for x, h in ((x, rows.sparkSession.createDataFrame([("\n".join(x),)], "t string").selectExpr("xxhash64(t) as h").first().h) for _, x in odd)}
    order = sorted({(i if i is not None else 1 << 62, hashed["\n".join(x)], tuple(x)) for i, x in odd})
    left, seen = {}, {}
    for i, h, x in order:
        runs = {(a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1) if len(" ".join(x[a:b]).split()) > 50}
        gone = set()
        for a, b in sorted(runs | {(a, b) for a, b in line_dedup.chunks("\n".join(x)) if b - a >= 2 and len("\n".join(x[a:b])) >= 40}):
            at, stop = seen.setdefault(tuple(x[a:b]), ((i, h), b))
            if (at, stop) != ((i, h), b):
                gone.update(range(max(a, stop) if at == (i, h) else a, b))
        left[i, x] = "\n".join(y for k, y in enumerate(x) if k not in gone)
    assert sorted((str(r.doc_id), r.text) for r in line_dedup.dedup(rows).collect()) == sorted((str(i), left[i if i is not None else 1 << 62, tuple(x)]) for i, x in odd)
    other = spark.createDataFrame([(1, "a " * 60), (None, "x\n" + "a " * 60), (None, "other\nlines")], "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.dedup(other).collect()) == ["a " * 60, "other\nlines", "x"]


def test_salvage():
    recs = [warc.record(str(i), f"http://x/{i}", b"payload %d " % i * 40, "d") for i in range(5)]
    for packed in ([warc.member(r) for r in recs], recs):
        whole = b"".join(packed)
        assert [x.headers["warc-record-id"] for x in warc.salvage(whole)] == [f"<urn:page:{i}>" for i in range(5)]
        a, b = len(packed[0]), len(packed[0]) + len(packed[1])
        broken = bytearray(whole)
        broken[(a + b) // 2] ^= 0xFF
        got = list(warc.salvage(bytes(broken)))
        assert [(g.start, g.end) for g in got if isinstance(g, warc.Gap)] == [(a, b)] and len(got) == 5
        cut_off = list(warc.salvage(whole[: len(whole) - 7] + b""))
        assert len([x for x in cut_off if isinstance(x, warc.Record)]) == 4 and isinstance(cut_off[-1], warc.Gap)
    long = np.random.default_rng(7).bytes(3 * warc.STEP)  # members that end within, at and after a step
    for n in (warc.STEP - 400, warc.STEP, len(long)):
        both = warc.member(warc.record("1", None, long[:n], "d")) + warc.member(recs[0])
        assert [len(x.block) > n for x in warc.salvage(both)] == [True, False]


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 60
    rows = [(3, "http://a", big), (1, "http://b\r\nx: y", big), (2, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", big), (1, "again", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest")
    warc.write(pages, str(tmp_path / "w"))
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(spark, str(tmp_path / "w")).collect()), key=repr)
    want = [(1, "response", None, 120)] * 2 + [(2, "revisit", 1, 120), (3, "revisit", 1, 120), (4, "response", None, 5), (5, "response", None, 5), (6, "response", None, 0), (None, "revisit", 1, 120)]
    assert got == sorted(want, key=repr)


def test_url_filter(spark):
    rows = [(1, "HTTP://A.Example.ORG/es/x?y"), (2, "http://example.org/en/12"), (3, None), (4, "no scheme"), (5, "http://x.com/fr"), (6, "http://x.com/fr/1"), (7, "http://x.com"), (8, "http://notexample.org/es/")]
    rows += [(100 + i, f"http://bad.com/de/{i}") for i in range(50)] + [(200, "http://bad.com/other/1"), (None, "http://bad.com/de/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as n")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[3][:3] == got[4][:3] == ("", "", None) and got[5][2] is None and got[6][2:] == ("com/fr/", "allow") and got[7][:2] == ("x.com", "") and got[8][2] == "org/"
    assert got[200][2:] == (None, "block") and got[None][3] == "block"
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_templates_that_differ_deep_down(spark, monkeypatch):
    """Sections of the fourth segment, below a segment that differs from url to url, are told apart; so are many even sections."""
    from tidewright.llm import common

    rules = {f"x.com/u{u}/blog/all/{kind}/": verdict for u in range(12) for kind, verdict in (("spam", "block"), ("ham", "allow"))}
    rules |= {f"y.com/s{k}/a": "block" if k % 3 == 0 else "allow" for k in range(60)}
    urls = [f"http://x.com/u{u}/blog/all/{kind}/{n}" for u in range(200) for kind in ("spam", "ham") for n in range(3)]
    urls += [f"http://y.com/s{k}/{c}{n}" for k in range(60) for n in range(30) for c in "ab"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for hot in (1000, 7):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        rows = url_filter.judge(pages, rules).collect()
        assert len(rows) == len(urls)
        for r in rows:
            want = "spam" in r.path if r.host == "x.com" else int(r.path.split("/")[1][1:]) % 3 == 0
            assert r.verdict == ("block" if want else "allow"), r


def test_recurrent_gradient_and_score(monkeypatch):
    monkeypatch.setattr(language_model, "LANES", 3)
    rng = np.random.default_rng(6)
    counts = np.full(language_model.VOCAB, -1.0)
    counts[:20] = 10
    p = language_model.initial(counts)
    docs = [np.append(rng.integers(1, 20, n), 0).astype(np.int32) for n in (40, 3, 0, 17, 5)]
    batch = language_model.score(p, docs)
    for d, s in zip(docs, batch, strict=True):  # one token at a time, the state never cut
        h, last, total = np.zeros((1, language_model.HIDDEN), dtype=np.float32), 0, 0.0
        for x in d:
            h = language_model.step(p, np.array([last]), h)[0]
            total += float(language_model.output(p, h, np.array([x]))[0][0])
            last = x
        assert abs(total - s) < 1e-3
    whole = np.concatenate([p[k].ravel() for k in language_model.shapes()]).astype(np.float32)
    t = language_model.Trainer(language_model.views(whole.copy()))
    ids, _, size = language_model._streams(docs, 3)
    assert len(ids) > 16  # one window that holds all, ends and lanes of different length included
    seen = []
    t._update = lambda full: seen.append(t.grad.astype(np.float64).copy())
    t._window(ids, size, np.zeros((3, language_model.HIDDEN), dtype=np.float32), np.zeros(3, dtype=np.int32), 1)
    loss = lambda flat: -language_model.score(language_model.views(flat.astype(np.float32)), docs).sum()
    monkeypatch.setattr(language_model, "WINDOW", 1000)
    for _ in range(12):  # along random directions, the derivative of the loss is the gradient's share
        way = rng.standard_normal(len(whole))
        step = 2e-3
        slope = (loss(whole + step * way) - loss(whole - step * way)) / (2 * step)
        assert abs(slope - seen[0] @ way) < 0.02 * np.abs(seen[0]).sum() ** 0.5 + 0.03 * abs(slope)
    same = [np.array([1, 2, 3, 4] * 60 + [0], dtype=np.int32)] * 40
    q = p
    for _ in range(4):
        q = language_model.train(q, same)
    assert language_model.score(q, same[:1])[0] > 0.7 * language_model.score(p, same[:1])[0]


def test_language_model_counts(spark):
    rows = [(1, "a b A"), (2, "b"), (3, None), (3, None), (4, "new a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as c")
    got = {r.doc_id: r for r in language_model.Model(docs.where("doc_id < 4")).score(docs).collect()}
    n, v = 4 + 4, 3  # words a, a, b, b and four ends
    assert got[1].train_tokens == n and got[1].n_tokens == 4 and got[4].n_known == 2
    assert abs(got[4].base_score - (np.log10(1) + np.log10(3) + np.log10(5) - 3 * np.log10(n + v + 1))) < 1e-9


def test_language_model_trains_on_every_document(spark, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 50)
    given, real = [], language_model.map_batches

    def seen(df, f, schema, *more):
        if schema == "p binary, n double":
            given.append(sorted(r.doc_id for r in df.collect()))
        return real(df, f, schema, *more)

    monkeypatch.setattr(language_model, "map_batches", seen)
    language_model.Model(spark.createDataFrame([(i, f"a b {i} " * 5) for i in range(200)], "doc_id long, text string"))
    assert len(given) == language_model.ROUNDS and sorted(sum(given, [])) == list(range(200))
