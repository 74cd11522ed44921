"""Every operator on text against plain Python, on the smallest tables and on awkward rows."""
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tripleframe.llm import iri_filter, languages, leaks, lines, near_literals, packing, quality, repeated_text, token_files, topk
from tripleframe.llm.queries import QUERIES, SQL, TOKENIZER
from tripleframe.llm.rows import send_package
from tripleframe.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
# Subjects are IRIs here; NULL in any column, empty, repeated, tied and very long texts, and columns with clashing names.
ROWS = [("http://e/a", "one two three four five six", "@en"), ("http://e/b", None, None), ("http://e/c", "", "@en"), (None, "no subject here at all", "@en"),
        ("http://e/d", "one two three four five six", "@en"), ("http://e/d", "one two three four five six", "@en"), ("http://e/d", "other text of d", None),
        ("http://e/e", LONG, "@en"), ("http://e/f", LONG + " tail", "@en"), ("http://e/g", "  \n \t ", None), ("http://e/h", "12 !! 34", "@de"), ("http://e/i", "x", "@de")]


@pytest.fixture(scope="module", autouse=True)
def sent(spark):
    send_package(spark)


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "s string, o string, o_type string")
    return df.withColumns({"k": F.lit("x"), "c": F.lit(1), "h": F.lit(None).cast("int"), "kept": F.lit(0), "score": F.lit("a"), "pos": F.lit(3)})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "s long, o string")


def repeats(texts, window=20):
    seen, out = set(), {}
    for k in sorted(texts):
        w = (texts[k] or "").encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            t = tuple(w[i:i + window])
            gone[i:i + window] |= t in seen
            seen.add(t)
        out[k] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeated_text(spark, docs, odd, empty):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op1_substring_dedup"](spark, SF).collect()}
    assert got == repeats(docs)
    rows = repeated_text.drop_repeats(odd).collect()
    assert len(rows) == len(ROWS)
    by = defaultdict(list)
    for r in rows:
        by[r.s].append(r)
    f = by["http://e/f"][0]
    assert (f.n_words, f.n_removed, f.o) == (40_001, 40_000, "tail") and list(zip(f.starts, f.ends, strict=True)) == [(0, 40_000)]
    assert by["http://e/b"][0].n_words == 0 and by["http://e/e"][0].n_removed > 0
    short = repeated_text.drop_repeats(odd, 4).where("s = 'http://e/d' and n_words = 6").collect()
    assert [(r.n_removed, r.o) for r in short] == [(6, ""), (6, "")]
    assert repeated_text.drop_repeats(empty).count() == 0


def connected(texts, width, percent=80):
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    up = {k: k for k in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in texts}


def test_near_literals(spark, docs, odd, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_minhash_near_dedup"](spark, SF).collect()}
    assert got == connected(docs, 2)
    # A ring of texts, each near the next only, so that links have to be found past the first member of a bucket.
    words = [f"v{i}" for i in range(400)]
    ring = {i: " ".join(words[12 * i:12 * i + 130]) for i in range(20)}
    got = {r.s: (r.n_shingles, r.component) for r in near_literals.near_literals(frame(spark, ring), 2).collect()}
    assert got == connected(ring, 2)
    rows = {(r.s, r.n_shingles): r for r in near_literals.near_literals(odd, 2).collect()}
    assert len(rows) == len(set(ROWS))
    assert rows["http://e/d", 5].component == "http://e/a" and not rows["http://e/d", 5].kept
    assert rows["http://e/f", rows_n(rows, "http://e/f")].component == "http://e/e"
    for s in "bcg":
        assert rows[f"http://e/{s}", 0].kept
    assert rows["http://e/i", 1].kept and rows[None, 4].component is None
    assert near_literals.near_literals(empty).count() == 0


def rows_n(rows, s):
    return next(n for t, n in rows if t == s)


def test_sketch_estimates_similarity():
    r = np.random.default_rng(3)
    for j in (0.3, 0.6, 0.8, 0.95):
        h = r.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
        n = int(2000 * (1 - j) / (1 + j))
        a, b = np.sort(h[:2000]), np.sort(h[n:2000 + n])
        both = near_literals.registers(np.concatenate([a, b]), np.array([0, 2000, 4000]))
        union = near_literals.registers(np.sort(h[:2000 + n]), np.array([0, 2000 + n]))
        assert (np.maximum(both[0], both[1]) == union[0]).all()  # registers can be merged
        got = near_literals.similarity(both[:1], both[1:], np.array([2000]), np.array([2000]))[0]
        assert abs(got - (2000 - n) / (2000 + n)) < 0.1


def line_repeats(texts, percent=80):
    seen, out = [], {}
    for k in sorted(texts):
        gone = []
        for j, line in enumerate((texts[k] or "").encode().split(b"\n")):
            s = frozenset(line.lower().split())
            if s and any(100 * len(s & t) >= percent * len(s | t) for t in seen):
                gone.append(j)
            if s:
                seen.append(s)
        out[k] = gone
    return out


def test_lines(spark, docs, odd, empty):
    want = line_repeats(docs)
    for r in QUERIES["op7_line_dedup"](spark, SF).collect():
        kept = b"\n".join(x for j, x in enumerate(docs[r.doc_id].encode().split(b"\n")) if j not in want[r.doc_id])
        assert (r.n_removed, r.kept_sha256) == (len(want[r.doc_id]), hashlib.sha256(kept).hexdigest())
    # Many variants of one line, most of them nearer to a later variant than to the first: needs the second round.
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(30)]
    many = {}
    for i in range(60):
        for j in rng.choice(30, 1 + i % 3, replace=False):
            base[j] = f"t{i}_{j}"
        many[i] = "\n".join([" ".join(base), "", f"own line {i} of its text"])
    got = {r.s: r.removed for r in lines.drop_repeated_lines(frame(spark, many)).collect()}
    assert got == line_repeats(many)
    rows = lines.drop_repeated_lines(odd).collect()
    assert len(rows) == len(ROWS)
    d = [r for r in rows if r.s == "http://e/d" and r.n_removed]
    assert len(d) == 2 and all(r.o == "" and r.n_lines == 1 for r in d)
    assert all(r.n_lines == 0 and r.o == "  \n \t " for r in rows if r.s == "http://e/g")
    assert lines.drop_repeated_lines(empty).count() == 0


def test_second_round(spark, monkeypatch):
    monkeypatch.setattr(lines, "EARLIEST", 1)
    monkeypatch.setattr(lines, "_SMALL", 4)
    words = [f"u{i}" for i in range(10)]
    texts = {i: " ".join(words[:9] + [f"z{i}"] if i % 2 else words[:7] + [f"y{i}", f"x{i}", f"z{i - 1}"]) for i in range(24)}
    got = {r.s: r.removed for r in lines.drop_repeated_lines(frame(spark, texts)).collect()}
    assert got == line_repeats(texts)


@pytest.mark.parametrize("apart", [True, False])
def test_second_round_tells_of_equal_lines(spark, monkeypatch, apart):
    """Lines that share rare words and differ in frequent ones, then one of them again: too many earlier candidates to meet it in the first round."""
    monkeypatch.setattr(lines, "EARLIEST", 1)
    monkeypatch.setattr(lines, "_SMALL", 4)
    rare = [f"r{i}" for i in range(53)]
    own = [[f"p{i}x{j}" for j in range(7)] for i in range(16)]
    texts = {i: " ".join(rare + w) for i, w in enumerate(own)} | {i: " ".join(rare + own[i - 4]) for i in range(16, 20)}
    texts[20] = " ".join(w for ws in own for w in ws * 200)
    want = line_repeats(texts)
    assert [i for i, gone in want.items() if gone] == [16, 17, 18, 19]
    df = frame(spark, texts)
    rows = df.repartition(21, "s") if apart else df.coalesce(1)
    if not apart:  # the first round sees every line apart from its equal, the second both in one batch
        first = lines._prefixes

        def prefixes(counts, percent, buckets, *only):
            run = first(counts, percent, buckets, *only)
            return run if only else lambda batches: (out for b in batches for i in range(b.num_rows) for out in run(iter([b.slice(i, 1)])))
        monkeypatch.setattr(lines, "_prefixes", prefixes)
    assert {r.s: r.removed for r in lines.drop_repeated_lines(rows).collect()} == want


def test_lines_of_repeated_rows(spark):
    """A row given twice is one literal, whose lines repeat nothing."""
    text = "seven words that no other row holds\nand a second line of it"
    rows = [("a", text), ("a", text), ("b", "some text of another row"), ("c", "and a second line of it")]
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, "s string, o string").repartition(4)).collect()
    assert sorted((r.s, r.n_lines, r.removed, r.o) for r in got) == [("a", 2, [], text)] * 2 + [("b", 1, [], rows[2][1]), ("c", 1, [0], "")]
    for kind, key in (("string", str), ("long", ord)):
        df = spark.createDataFrame([(key(s), o, len(o)) for s, o in rows], f"doc_id {kind}, text string, n_chars int")
        got = corpus_pipeline.line_dedup(spark, df, SF).collect()
        assert sorted(tuple(r) for r in got) == sorted([(key(s), o, len(o)) for s, o in rows[:3]] + [(key("c"), "", 0)])


def test_leaks(spark, docs, odd, empty):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_benchmark_decontamination"](spark, SF).collect()}
    assert {(d, i) for d, t in docs.items() for i, x in items.items() if x in t} <= got
    assert all(len(set(docs[d].lower().split()) & set(items[i].lower().split())) > len(set(items[i].split())) / 2 for d, i in got)
    item = "A train leaves Paris at 12 km from the old depot and Maria walks 12 km along the river to meet Peter there"
    texts = {1: "Some words. " + item.replace("12", "75").replace("Maria", "Olga").replace("Paris", "Rome") + ". More words.",
             2: item.replace("12 km from", "30 km from"), 3: "An unrelated text about trains and rivers that shares little with it", 4: item.upper().lower(), 5: None}
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short item"), (None, item)], "item int, o string")
    for limit in (leaks.LOCAL_WINDOWS, -1):  # the benchmark sent to tasks, and both sides shuffled
        got = {(r.s, r.item): r.same_values for r in leaks.leaks(frame(spark, texts), bench, local_windows=limit).collect()}
        assert got[1, 7] is False and (2, 7) not in got and (3, 7) not in got and all(i == 7 for _, i in got)
    assert leaks.leaks(odd, bench).count() == 0 and leaks.leaks(empty, bench).count() == 0
    assert leaks.leaks(odd, bench.where("false")).count() == 0


@pytest.mark.parametrize("limit", [leaks.LOCAL_WINDOWS, -1])
def test_leaks_of_numbers_and_names(spark, limit):
    """Windows that are placeholders mostly, names in lower case, and one of two equal numbers changed."""
    words = [f"word{i}" for i in range(59)]
    words[10] = words[40] = "12"
    ten = [w if i % 6 else "2" for i, w in enumerate(words)]
    items = {1: "What is 12 + 7 * 3?", 2: "11 12 13 14 15 16 17 18 19 20 21", 3: "by Anna Bert Carl Dora Emil Fritz Gerd Hans Inge", 4: " ".join(words), 5: " ".join(ten),
             6: "we count 1 2 3 4 5 6 7 8 9 10 11 12 and then slowly walk home along this very long road"}
    texts = {1: f"So: {items[1]} Tell me.", 2: f"table {items[2]} ends", 3: "Seen " + items[3].lower() + " there", 4: " ".join(w if i != 40 else "30" for i, w in enumerate(words)),
             5: " ".join(w if i != 36 else "3" for i, w in enumerate(ten)), 6: items[6].replace(" 5 ", " 77 ").replace("11", "88"), 7: "What is 12 * 7 + 3?", 8: "What is 12 + 7 * 4?", 9: "11 12 13 14 15 16 17 18 99 20 21 22".replace("11", "10"), 10: "by Anna Bert Carl Dora Emil Fritz Gerd Inge Hans".replace("Carl", "Karl")}
    bench = spark.createDataFrame(list(items.items()), "item int, o string")
    got = {(r.s, r.item): (r.windows, r.item_windows, r.same_values) for r in leaks.leaks(frame(spark, texts), bench, local_windows=limit, run=1000).collect()}
    assert got == {(1, 1): (1, 1, True), (2, 2): (4, 4, True), (3, 3): (3, 3, True), (4, 4): (36, 52, False), (5, 5): (44, 52, False), (6, 6): (7, 17, False)}


@pytest.mark.parametrize("limit", [leaks.LOCAL_WINDOWS, -1])
def test_leaks_of_long_runs(spark, limit):
    """Part of a long item, less than half of its windows."""
    words = [f"word{i}" for i in range(100)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item int, o string")
    texts = {1: " ".join(words[40:60]), 2: " ".join(words[40:59]), 3: " ".join(words[:15] + ["x"] + words[16:32])}
    got = [tuple(r) for r in leaks.leaks(frame(spark, texts), bench, local_windows=limit).collect()]
    assert got == [(1, 1, 13, 93, True)]


@pytest.mark.parametrize("kind", ["int", "string"])
@pytest.mark.parametrize("limit", [leaks.LOCAL_WINDOWS, -1])
def test_leaks_of_repeated_ids(spark, limit, kind):
    """Texts of one item id are judged each by itself."""
    words = [f"word{i}" for i in range(60)]
    one = 1 if kind == "int" else "one"
    bench = spark.createDataFrame([(one, " ".join(words[:18])), (one, " ".join(words[20:50])), (one, " ".join(words[:18]))], f"item {kind}, o string")
    texts = {1: " ".join(words[:18]), 2: " ".join(words[:11] + words[20:31]), 3: " ".join(words)}
    got = [tuple(r) for r in leaks.leaks(frame(spark, texts), bench, local_windows=limit).collect()]
    assert sorted(got) == [(1, one, 11, 11, True), (3, one, 11, 11, True), (3, one, 23, 23, True)]


def test_languages(spark, odd, empty):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_language_id"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)
    profiles = languages.learn_languages(odd)
    got = [(r.s, r.o_type) for r in languages.tag_literals(odd, profiles).collect()]
    assert len(got) == len(ROWS)
    assert all((t == "@und") == (s in ("http://e/b", "http://e/c", "http://e/g", "http://e/h")) for s, t in got)
    assert languages.tag_literals(empty, profiles).count() == 0
    none = languages.learn_languages(empty)
    assert {r.o_type for r in languages.tag_literals(odd, none).collect()} == {"@und"}


def test_bundles_are_sums_of_bound_trigrams():
    text = "Ab, cé ab"
    letter = lambda c: languages._letter(ord(c), 64, 1).astype(int)
    want = np.zeros(64)
    padded = " ab cé ab "
    for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
        if b != " ":
            want += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    got = languages.bundles([text, "", "123", text], 64, 1)
    assert (got[0] == want).all() and (got[3] == want).all() and not got[1].any() and not got[2].any()


def test_quality(spark, odd, empty):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = QUERIES["op3_quality_classifier"](spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)
    described = quality.describe(odd)
    some = spark.createDataFrame([("http://e/a", 1), ("http://e/a", 0), ("http://e/e", 1), ("http://e/h", 0), (None, 1), ("http://e/i", None)], "s string, quality int")
    assert quality.score_quality(described, quality.fit_quality(described, some)).count() == len(ROWS)
    flat = quality.fit_quality(described, some.where("false"))
    assert {r.score for r in quality.score_quality(described, flat).collect()} == {0.5}
    assert quality.score_quality(quality.describe(empty), flat).count() == 0


def test_pooling_is_isotonic():
    x, y = quality._pool(np.arange(5.0), np.array([1.0, 0, 2, 1, 5]), np.array([2.0, 2, 4, 4, 5]))
    assert (np.diff(y) > 0).all() and (np.diff(x) > 0).all() and y[-1] == 1


def test_tokens_equal_the_tokenizers_library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    texts = ["", " ", "a", " a  b ", "don't stop now \n\n x", "<|endoftext|> café 12,5 \U0001f600中文", "tab\tand space \x1c end", "x\x00y \x00z", "a" * 5000, LONG]
    ids, counts = encoder(TOKENIZER)(texts)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_packing(spark, docs, odd, empty):
    enc = encoder(TOKENIZER)
    rows = QUERIES["op8_packing"](spark, SF).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(by) == set(docs)
    for d, own in by.items():
        ids = np.append(enc([docs[d]])[0], 0).astype("<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack_literals(odd, TOKENIZER).agg(F.sum("length")).first()[0] == sum(len(enc([r[1] or ""])[0]) + 1 for r in ROWS)
    assert packing.pack_literals(empty, TOKENIZER).count() == 0


def test_balance_spreads_cost():
    n = np.random.default_rng(1).integers(1, 900, 3000)
    p = packing.balance(n, 1024)
    cost = defaultdict(float)
    for _, _, m, q, _ in p:
        cost[q] += m + m * m / 1024
    c = np.array(list(cost.values()))
    assert p[:, 2].sum() == n.sum() and len(p) < 1.45 * len(n)
    whole = np.array([x for q, x in cost.items() if p[p[:, 3] == q, 2].sum() == 1024])
    assert np.quantile(whole, 0.9) / np.quantile(whole, 0.1) < 1.6 and len(c) >= len(whole)


def test_token_files(spark, docs, odd, empty, tmp_path):
    enc = encoder(TOKENIZER)
    assert {r.doc_id: r.n_tokens for r in QUERIES["op9_token_counts"](spark, SF).collect()} == {d: len(enc([t])[0]) for d, t in docs.items()}
    written = token_files.write_token_files(odd, str(tmp_path / "odd"), TOKENIZER)
    counts = token_files.count_tokens(spark, written.select("path"), block_tokens=100)
    got = Counter((r.s, r.n_tokens) for r in written.join(counts, ["path", "ordinal"]).collect())
    assert got == Counter((s, len(enc([o or ""])[0])) for s, o, _ in ROWS)
    assert token_files.count_tokens(spark, token_files.write_token_files(empty, str(tmp_path / "none"), TOKENIZER).select("path")).count() == 0
    # By hand: blocks of three tokens, documents over several blocks, empty documents, and one that is not closed.
    ids = [5, 6, 7, 8, 9, 10, 11, 9999, 9999, 1, 9999, 2, 3, 4, 5, 6, 7]
    np.array(ids, "<u2").tofile(tmp_path / "a.bin")
    (tmp_path / "b.bin").write_bytes(b"")
    rows = token_files.count_tokens(spark, [str(tmp_path / "a.bin"), str(tmp_path / "b.bin"), str(tmp_path / "a.bin")], 9999, 3).orderBy("ordinal").collect()
    assert [(r.ordinal, r.start, r.n_tokens, r.closed) for r in rows] == [(0, 0, 7, True), (1, 8, 0, True), (2, 9, 1, True), (3, 11, 6, False)]


def test_top_k(spark):
    v = [(i, [float(x) for x in np.random.default_rng(i).normal(0, 0.3, 9 if i % 7 else 8)]) for i in range(60)]
    v += [(60, None), (61, [0.1, None]), (62, [float("nan")]), (63, [float("inf"), 1.0]), (64, []), (65, v[3][1]), (66, v[3][1]), (None, [1.0])]
    df = spark.createDataFrame(v, "s long, vector array<float>").withColumn("query", F.lit(1))
    good = {i: np.floor(64 * np.array(x, np.float32).astype(float)).astype(int) for i, x in v if i is not None and x is not None and None not in x and np.isfinite(x).all()}
    for args in ({}, {"shard": 7, "block": 2}):
        got = topk.top_k(df, df.where("s % 20 = 0"), 5, **args).orderBy("query", "rank").collect()
        want = []
        for q in sorted(i for i in good if i % 20 == 0):
            pad = lambda x: np.pad(x, (0, 9 - len(x)))
            score = sorted(((-int(pad(good[q]) @ pad(x)), i) for i, x in good.items() if i != q))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(score)]
        assert [tuple(r) for r in got] == want
    assert topk.top_k(df.where("false"), df, 5).count() == 0 and topk.top_k(df, df.where("false"), 5).count() == 0
    assert topk.top_k(df.where("s < 3"), df.where("s = 0"), 5).count() == 2


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    from oracle import compare, duck
    assert compare(spark, duck(SF), name, QUERIES[name], SQL[name], SF)[1] is None


def test_iris(spark):
    rows = [(1, "https://WWW.Example.com/en/x?y#z", 0), (2, "http://a.example.com/en/", 1), (3, "http://a.example.com", 0), (4, "x.net/es/", None), (5, None, None), (6, "http://b.net/es/q", 0),
            (7, "http://bad.org/a", 1), (7, "http://bad.org/a", 1), (None, "http://new.bad.org/?q=://e", 1), (8, "://", None)] + [(100 + i, f"http://bad.org/{i}", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "s long, o string, bad int").withColumns({"host": F.lit("?"), "level": F.lit(1)})
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block")]
    got = {(r.s, r.host, r.path, r.rule, r.verdict) for r in iri_filter.judge_iris(df, rules, iri_filter.host_reputation(df)).collect()}
    assert {(1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "a.example.com", "/en/", "example.com/en/", "block"), (3, "a.example.com", "", None, "allow"),
            (6, "b.net", "/es/q", "net/es/", "block"), (7, "bad.org", "/a", None, "block"), (4, "", "", None, "allow"), (5, "", "", None, "allow")} <= got
    none = iri_filter.host_reputation(df.where("false"))
    assert none.count() == 0 and iri_filter.judge_iris(df, rules, none).count() == len(rows) and iri_filter.judge_iris(df.where("false"), rules, none).count() == 0


def test_suffixes_of_several_labels(spark):
    """Sites under co.uk and github.io are strangers to each other, as those under com are."""
    rows = [(i, f"http://www.{'bad' if i % 2 else 'good'}{i // 80}.{tail}/{i}", i % 2) for tail in ("co.uk", "github.io") for i in range(160)]
    df = spark.createDataFrame(rows, "s long, o string, bad int")
    known = iri_filter.host_reputation(df)
    assert {(r.level, r.name) for r in known.collect() if r.level != "host"} == {("suffix", t) for t in ("co.uk", "github.io")} | {
        ("domain", f"{kind}{i}.{t}") for t in ("co.uk", "github.io") for kind in ("bad", "good") for i in (0, 1)}
    ask = spark.createDataFrame([(1, "http://new.bad0.co.uk"), (2, "http://other.co.uk"), (3, "http://new.good0.co.uk"), (4, "http://co.uk"), (5, "http://x.gov.zz")], "s long, o string")
    got = {r.s: (r.level, r.verdict) for r in iri_filter.judge_iris(ask, [], known).collect()}
    assert got == {1: ("domain", "block"), 2: ("suffix", "allow"), 3: ("domain", "allow"), 4: ("suffix", "allow"), 5: (None, "allow")}
    last = iri_filter.host_reputation(df, suffixes=())
    assert {r.name for r in last.where("level = 'suffix'").collect()} == {"uk", "io"}


def test_pipeline_stages(spark, docs):
    """Every stage against plain Python on its own input; and the columns it must return."""
    d = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"k": F.lit(1), "gone": F.lit("g"), "S": F.lit(None).cast("string")})
    extra = spark.createDataFrame([(9001, None, "en", "x", 0, 1, "g", None), (9002, "123 456", "en", "x", 7, 1, "g", None), (None, docs[1], None, None, None, 1, "g", None)], d.schema)
    d = d.unionByName(extra)
    out = corpus_pipeline.language(spark, d, SF)
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == d.columns and 9001 not in kept and 9002 not in kept and None in kept and len(kept) >= 0.98 * len(docs)
    one = lambda df: {-1 if r.doc_id is None else r.doc_id: r.text for r in df.collect()}
    out = corpus_pipeline.line_dedup(spark, d, SF)
    want = line_repeats(one(d))
    assert out.columns == d.columns and out.count() == d.count()
    for r in out.collect():
        t, k = one(d)[-1 if r.doc_id is None else r.doc_id], -1 if r.doc_id is None else r.doc_id
        assert r.text == (t if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in want[k]))
    out = corpus_pipeline.near_dedup(spark, d, SF)
    assert out.columns == d.columns and set(one(out)) == {k for k, (_, c) in connected(one(d), 5).items() if k == c}
    out = corpus_pipeline.decontaminate(spark, d, SF)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert out.columns == d.columns and not any(i in (r.text or "") for r in out.collect() for i in items)
    assert set(one(d)) - set(one(out)) <= {k for k, t in one(d).items() if t and any(i[:60] in t or i[-60:] in t for i in items)}
    assert corpus_pipeline.packing(spark, d, SF).select("doc_id").distinct().count() == d.select("doc_id").distinct().count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.where("false"), SF).count() == 0


def test_unknown_languages_go(spark, docs):
    """Gibberish and a language that no document is tagged with go; every clean document stays."""
    rng = np.random.default_rng(3)
    noise = {9100 + i: " ".join("".join(chr(a + c) for c in rng.integers(0, 26, rng.integers(2, 10))) for _ in range(60 + 20 * i)) for a in (97, 0x430) for i in range(a % 10, a % 10 + 5)}
    noise[9200] = ("Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Ahi quanto a dir qual era e cosa dura "
                   "questa selva selvaggia e aspra e forte che nel pensier rinova la paura! Tant'e amara che poco e piu morte; ma per trattar del ben ch'io vi trovai.")
    noise[9201] = "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Все смешалось в доме Облонских. Жена узнала, что муж был в связи."
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(k, t, None) for k, t in noise.items()] + [(9300, docs[1], None)], d.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, d.unionByName(extra), SF).collect()}
    assert kept == {*docs, 9300}


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and math.isclose(rows.agg(F.max("length")).first()[0], 1024)
