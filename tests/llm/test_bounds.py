"""What is held at once, and what must not be taken for equal."""
import subprocess
import sys

import numpy as np
import pytest

from tripleframe.llm import lines, near_groups, near_literals, packing, topk
from tripleframe.llm.queries import TOKENIZER
from tripleframe.llm.rows import send_package
from tripleframe.llm.tokens import encoder


@pytest.fixture(scope="module", autouse=True)
def sent(spark):
    send_package(spark)


def test_wide_alphabets_take_little_memory():
    """A text of a million characters of 20,000 letters."""
    code = ("import resource, numpy as np\nfrom tripleframe.llm import languages\n"
            "z = np.random.default_rng(1).zipf(1.2, 1_000_000) % 20_000\n"
            "v = languages.bundles([''.join(chr(0x4E00 + int(x)) for x in z)])\n"
            "assert v.any()\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=lines.__file__.split("/tripleframe/")[0])
    assert int(out.stdout) < 500


def test_special_tokens_have_their_ids(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> x <|endoftext|><|endoftext|>", "<|endoftext|", "no such thing", "two  spaces<|endoftext|>\n", ""]
    ids, counts = encoder(TOKENIZER, True)(texts)
    ends = np.cumsum(counts)
    for t, lo, hi in zip(texts, ends - counts, ends, strict=True):
        assert ids[lo:hi].tolist() == tok.encode(t, add_special_tokens=False).ids
    plain, _ = encoder(TOKENIZER)(texts[:1])
    assert 50256 in ids.tolist() and 50256 not in plain.tolist()
    rows = packing.pack_literals(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "s int, o string").coalesce(1), TOKENIZER).collect()
    got = {i: np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(rows, key=lambda r: r.start) if r.s == i]).tolist() for i in range(len(texts))}
    assert got == {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


def line_repeats(texts, percent=80):
    seen, out = [], {}
    for k in sorted(texts):
        gone = []
        for j, line in enumerate(texts[k].encode().split(b"\n")):
            s = frozenset(line.lower().split())
            if s and any(100 * len(s & t) >= percent * len(s | t) for t in seen):
                gone.append(j)
            if s:
                seen.append(s)
        out[k] = gone
    return out


def test_short_lines_that_nearly_agree(spark, monkeypatch):
    """Lines of two words that share one, more of them than 32 bits tell apart by chance, and longer ones that differ in one word."""
    texts = {i: "\n".join(f"common w{i}x{j}" for j in range(400)) for i in range(40)}
    texts[40] = "common w3x7\nw5x9 common\ncommon other"
    texts |= {50 + i: f"t0 t1 t2 t3 t4 t5 t6 t7 t8 n{i}" if i % 2 else f"t0 t1 t2 t3 t4 n{i} m{i} o{i} p{i} q{i}" for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "s int, o string").repartition(5, "s")
    want = {i: [] for i in range(40)} | line_repeats({k: t for k, t in texts.items() if k > 40}) | {40: [0, 1]}
    assert {r.s: r.removed for r in lines.drop_repeated_lines(df).collect()} == want
    monkeypatch.setattr(lines, "_SMALL", 3)
    assert {r.s: r.removed for r in lines.drop_repeated_lines(df).collect()} == want


def test_frequent_words_lose_no_pair(spark, monkeypatch):
    """Lines of few words, so that every prefix word has many lines, of all lengths and likenesses."""
    monkeypatch.setattr(lines, "_SMALL", 3)
    monkeypatch.setattr(lines, "EARLIEST", 2)
    rnd = np.random.default_rng(4)
    texts = {}
    for i in range(150):
        base = rnd.choice(90, int(rnd.choice([3, 5, 6, 9, 10, 12, 25, 40, 85])), replace=False)
        rows = [" ".join(f"w{x}" for x in np.where(rnd.random(len(base)) < 0.06, rnd.integers(0, 90, len(base)), base)) for _ in range(2)]
        texts[i] = "\n".join(rows)
    df = spark.createDataFrame(list(texts.items()), "s int, o string").repartition(7, "s")
    assert {r.s: r.removed for r in lines.drop_repeated_lines(df).collect()} == line_repeats(texts)


def test_near_literals_whose_buckets_stay_apart(spark, monkeypatch):
    """Members of one family, each near some of the others only: links have to be found past the members drawn."""
    rnd = np.random.default_rng(7)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for i in range(90):
        words = list(base)
        for at in rnd.choice(120, int(rnd.integers(2, 14)), replace=False):
            words[at] = f"e{rnd.integers(0, 3)}x{at}"
        texts[i] = " ".join(words)
    sets = {k: {tuple(t.split()[i:i + 2]) for i in range(119)} for k, t in texts.items()}
    up = {k: k for k in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in texts:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    want = {k: find(k) for k in texts}
    assert len(set(want.values())) > 3
    df = spark.createDataFrame(list(texts.items()), "s int, o string")
    for draws, few, block in ((2, 16, 512), (0, 2, 8), (0, 100, 8)):
        monkeypatch.setattr(near_groups, "DRAWS", draws)
        monkeypatch.setattr(near_groups, "FEW", few)
        monkeypatch.setattr(near_groups, "BLOCK", block)
        assert {r.s: r.component for r in near_literals.near_literals(df, 2).collect()} == want


def test_pairs_just_below_the_threshold_stay_in_their_task(spark, monkeypatch):
    """A family of which hardly two are linked: its pairs are held together on whole sets where they meet, and only links leave the task."""
    rnd = np.random.default_rng(8)
    base = [f"b{i}" for i in range(200)]
    texts = {}
    for i in range(150):
        words = list(base)
        for at in rnd.choice(200, 8, replace=False):
            words[at] = f"e{i}x{at}"
        texts[i] = " ".join(words)
    for i in range(150, 158):  # a few that are linked with one of them each
        texts[i] = texts[i - 150].replace("b7 ", f"f{i} ")
    sets = {k: {tuple(t.split()[i:i + 2]) for i in range(199)} for k, t in texts.items()}
    want = {k: k for k in texts}
    for a in texts:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                want[a] = min(want[a], want[b])
    assert len(set(want.values())) == 150
    asked = []

    def counted(pairs, *args):
        asked.append(pairs.count())
        return confirmed(pairs, *args)

    confirmed = near_literals.confirmed
    monkeypatch.setattr(near_literals, "confirmed", counted)
    monkeypatch.setattr(near_groups, "FEW", 2)
    monkeypatch.setattr(near_groups, "DRAWS", 0)
    df = spark.createDataFrame(list(texts.items()), "s int, o string")
    for block, whole in ((40, 1 << 20), (40, 10)):
        monkeypatch.setattr(near_literals, "BLOCK", block)
        monkeypatch.setattr(near_literals, "WHOLE", whole)
        asked.clear()
        assert {r.s: r.component for r in near_literals.near_literals(df, 2).collect()} == want
        assert (sum(asked) < 20 * len(texts)) == (whole > 10), asked


@pytest.mark.parametrize("scale", [3, 60, 1 << 12, 1 << 26])
@pytest.mark.parametrize("spread", [0, 6])
def test_a_block_of_queries_is_searched_at_once(scale, spread):
    """In single and double precision and in integers, with ties, own rows and repeated rows, and with lists that few candidates need."""
    rnd = np.random.default_rng(scale + spread)
    x = rnd.integers(-scale, scale + 1, (500, 16))
    x = x // (1 << np.minimum(spread * np.arange(16) // 8, 20))
    names = np.concatenate([np.arange(490), np.arange(10)])
    q, own = x[:40], np.arange(40)
    for n in (500, 20, 3, 0):
        at, cand, score = topk.search_shard(np.ascontiguousarray(x[:n].T), names[:n], q, own, 20)
        got = [[(int(s), int(names[c])) for c, s in zip(cand[at == i], score[at == i], strict=True)] for i in range(40)]
        full = q @ x[:n].T
        assert got == [sorted(((int(s), int(c)) for s, c in zip(full[i], names[:n], strict=True) if c != i), key=lambda r: (-r[0], r[1]))[:20] for i in range(40)]


def test_lines_are_taken_out_by_column_expressions(spark):
    """No Python worker beside those that found the lines; texts keep empty lines, and one of which all goes is empty."""
    from pyspark.sql import functions as F

    many = 20_000
    rows = [(0, "a\nb\n\nc\n", [1, 1]), (1, "a\nb", [1, 0]), (2, None, [0]), (3, "x\r\ny", None), (4, "", [0]), (5, "\n\n", [1]),
            (6, "\n".join(map(str, range(many))), list(range(1, many)))]
    df = spark.createDataFrame(rows, "s int, text string, gone array<long>").repartition(2)
    out = df.select("s", lines.without_lines(F.col("text"), F.col("gone")).alias("o"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.s: r.o for r in out.collect()} == {0: "a\n\nc\n", 1: "", 2: None, 3: "x\r\ny", 4: "", 5: "\n", 6: "0"}
