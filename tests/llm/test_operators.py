"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on the odd cases:
nulls, empty and long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import ann, chat, decontaminate, graph, lmscore, mixing, neardup, pii, quality, substring, urlfilter
from gridloom.llm import tokens as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, th long, key string, score double, spans string"


def words(text):
    return WORD.findall(text or "")


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{n % 3}" if n % 4 else None, None, 5, 6, "k", 0.5, "x") for n, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)


def text(rng, n, vocab=4000):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Nulls, empties, repeats, near copies, a shared passage and a long text."""
    rng = random.Random(4)
    base = text(rng, 120).split()
    near = list(base)
    near[60] = "changed"
    passage = text(rng, 60)
    out = [None, "", " \t\n", "one", "a b c d", " ".join(base), " ".join(near), " ".join(base), "é " * 40 + "ü"]
    out += [text(rng, 30) + " " + passage + "\n" + text(rng, 20), passage + " " + text(rng, 50), "the " * 80, text(rng, 20000)]
    return out + [text(rng, 90) for _ in range(6)]


def test_words_hash_and_split(odd):
    old, T._BLOCK = T._BLOCK, 4096
    try:
        w = T.words_of(pa.array(odd))
    finally:
        T._BLOCK = old
    seen = {}
    for i, t in enumerate(odd):
        got = [w.data[a:z].tobytes().decode() for a, z in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], strict=True)]
        assert got == words(t)
        for x, h in zip(got, w.hashes[w.first[i] : w.first[i + 1]], strict=True):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


# ------------------------------------------------------------------ 1
def test_leaks_with_changed_numbers_and_names(spark, odd):
    q = "Last year Martha bought 12 kg of apples for the market stall and sold every crate within 3 days."
    items = spark.createDataFrame([(1, q, 0), (2, None, 0), (3, "", 0), (4, q, 0), (5, "tiny pear", 0)], "item_id long, text string, doc_id int")
    changed = q.replace("Martha", "Nadine").replace("12", "1,500").replace("3", "9")
    mixed = q + " " + "nothing here repeats at all " * 3
    docs = frame(spark, [*odd, "x y z. " + q, changed, mixed, "a tiny pear b", q.lower().replace("apples", "pears")[:40]])
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.find_leaks(docs, items).collect()}
    n = len(odd)
    assert got == {(n, 1): True, (n, 4): True, (n + 1, 1): False, (n + 1, 4): False, (n + 2, 1): True, (n + 2, 4): True, (n + 3, 5): True}
    small = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items, max_windows=10).collect()}
    assert small == set(got)  # a benchmark in several blocks
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == n + 1
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), items).count() == 0


def test_inconsistent_slots_do_not_match():
    q = "Today Anna gave 5 red coins to Bert and later Anna gave 7 blue coins to Carl at noon."
    same = q.replace("Anna", "Zoe")
    torn = "Today Ann gave 5 red coins to Bob and later Eve gave 7 blue coins to Dan at noon."
    torn = torn.replace("Ann ", "Mia ")
    b = decontaminate.Benchmark([(1, q)])
    assert decontaminate.leaks(pa.array([same]), b) and not decontaminate.leaks(pa.array([torn]), b)


def test_alignment_by_occurrence():
    """Several versions of a question in one document are judged one by one."""
    q = "a baker sells {} rolls on the first day and {} rolls on the second day then buys {} bags of flour for the next week"
    b = decontaminate.Benchmark([(1, q.format(12, 30, 7))])
    sheet = ". ".join(q.format(*x) for x in ((41, 52, 63), (74, 85, 96), (17, 28, 39)))
    assert [x[:2] for x in decontaminate.leaks(pa.array([sheet]), b)] == [(0, 1)]
    assert decontaminate.leaks(pa.array([sheet + ". And " + q.format(12, 30, 7)]), b)[0][4]


def test_texts_and_items_that_repeat_themselves():
    """Both sides full of one window cost array work, and are judged as if they were not."""
    b = decontaminate.Benchmark([(1, "ha " * 60), (2, "so 5 we go 7 and then we go on to " * 12)])
    at = time.time()
    got = decontaminate.leaks(pa.array(["ha " * 20_000, "so 6 we go 8 and then we go on to " * 3_000, "ha ho " * 5_000]), b)
    assert time.time() - at < 4
    assert {(x[0], x[1], x[4]) for x in got} == {(0, 1, True), (1, 2, False)}
    some = ["ha " * 90, "so 5 we go 7 and then we go on to " * 9 + "so 5 we go 7", "ha ha ho " * 20]
    items = [(1, "ha " * 30), (2, "so 5 we go 7 and then we go on to " * 3), (3, "ha ha ha ho " * 6)]
    got = decontaminate.leaks(pa.array(some), decontaminate.Benchmark(items))
    assert {(x[0], x[1]): x[4] for x in got} == brute_leaks(some, items)


def test_verbatim_items_with_few_literals():
    """Arithmetic, tables and lists match word for word, and only word for word."""
    items = ["What is 12 + 30?", "Ann 12 kg Bob 15 kg Cid 9 kg Dan 31 kg Eve 44 kg"]
    b = decontaminate.Benchmark(list(enumerate(items)))
    got = decontaminate.leaks(pa.array([f"some words before: {x} and some after" for x in items] + ["What is 13 + 30?", "WHAT IS 12 + 30"]), b)
    assert {(x[0], x[1], x[4]) for x in got} == {(0, 0, True), (1, 1, True), (3, 0, True)}


def test_names_that_start_sentences():
    """A name counts as one at the start of a sentence; case and stops do not hide a verbatim copy."""
    q = "Tom has 5 apples. Tom buys 3 more. How many apples does Tom have now?"
    b = decontaminate.Benchmark([(1, q)])
    copies = [q.replace("Tom", "Sam"), q.lower(), q.upper(), q.replace(".", ""), "Tom has 5 pears. Ann sells 3 boxes. How many boxes are left?"]
    got = decontaminate.leaks(pa.array(copies), b)
    assert {(x[0], x[4]) for x in got} == {(0, False), (1, True), (2, True), (3, True)}


def brute_templates(t, typing):
    """(kind, value) of a text's template tokens, word by word."""
    D = decontaminate
    out, at = [], 0
    found = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", t)]
    lower = lambda w: "".join(c.lower() if c.isascii() else c for c in w)
    big = lambda w: "A" <= w[0] <= "Z" or "À" <= w[0] <= "Þ"
    fresh = [k == 0 or any(c in ".!?:\n" for c in t[found[k - 1][2] : a]) for k, (_, a, _) in enumerate(found)]
    inner = {lower(w) for (w, _, _), f in zip(found, fresh, strict=True) if big(w) and not f}
    small = {lower(w) for w, _, _ in found if not big(w)}
    for k, (w, _, _) in enumerate(found):
        kind = D.WORD
        if typing != "plain":
            if "0" <= w[0] <= "9":
                kind = D.NUMBER
            elif big(w) and (not fresh[k] or typing == "names" and lower(w) in inner and lower(w) not in small):
                kind = D.NAME
            elif k and at == D.NUMBER and lower(w) in D.UNITS:
                kind = D.UNIT
            if k and kind != D.WORD and kind == at:
                continue
        at = kind
        out.append((kind, lower(w)))
    return out


def brute_consistent(values):
    """Values that fill several slots meet one partner in most of them, on both sides; by counting pairs."""
    pair = collections.Counter(values)
    for side in (0, 1):
        often = collections.Counter(v[side] for v in values)
        again = [x for x, c in often.items() if c > 1]
        best = {x: max(c for v, c in pair.items() if v[side] == x) for x in again}
        if sum(best.values()) < decontaminate.CONSISTENT * sum(often[x] for x in again):
            return False
    return True


def brute_judge(pairs, d, b, total):
    """Whether any alignment that passes has equal values, from lists of matching positions; None if none passes."""
    D = decontaminate
    runs, ends = [], {}
    pairs = sorted(pairs)
    for i, j in pairs:
        near = [o for s in range(D.WINDOW) for o in ([i - j - s, i - j + s] if s else [i - j]) if o in ends and ends[o][-1][0] < i and ends[o][-1][1] < j]
        if near:
            run = ends.pop(near[0])
            run.append((i, j))
        else:
            runs.append(run := [(i, j)])
        ends[i - j] = run
    chains = []
    for run in runs:
        if chains and chains[-1][-1][0] < run[0][0] and chains[-1][-1][1] < run[0][1]:
            chains[-1] = chains[-1] + run
        else:
            chains.append(list(run))
    found = None
    for some in [*runs, *chains, pairs]:
        n = len({j for _, j in some})
        if n / total < D.COVERAGE and n < D.LONG:
            continue
        slots = {(i + k, j + k) for i, j in some for k in range(D.WINDOW) if d[i + k][0] != D.WORD}
        values = [(d[i][1], b[j][1]) for i, j in slots]
        if values and sum(x == y for x, y in values) < D.CONSISTENT * len(values) and not brute_consistent(values):
            continue
        found = bool(found) or all(x == y for x, y in values)
    return found


def brute_leaks(texts, items):
    """{(row, item): exact} by dictionaries of window tuples."""
    D, out = decontaminate, {}
    for typing in D.TYPINGS:
        mark = lambda x: x[1] if x[0] == D.WORD else x[0]
        docs, bench = ([brute_templates(x or "", typing) for x in xs] for xs in (texts, [x for _, x in items]))
        for r, d in enumerate(docs):
            for k, b in enumerate(bench):
                size = min(D.WINDOW, len(b))
                good = lambda w: sum(x[0] == D.WORD for x in w) >= min(D.LITERAL, size)  # noqa: B023, E731
                mine = [j for j in range(len(b) - size + 1) if good(b[j : j + size])] if b else []
                pairs = [(i, j) for i in range(len(d) - size + 1) for j in mine if list(map(mark, d[i : i + size])) == list(map(mark, b[j : j + size]))]
                if not pairs:
                    continue
                if size < D.WINDOW:
                    best = any(d[i : i + size] == b[j : j + size] for i, j in pairs)
                else:
                    best = brute_judge(pairs, d, b, len(mine))
                    if best is None:
                        continue
                out[r, items[k][0]] = out.get((r, items[k][0]), False) or best
    return out


def test_leaks_equal_brute_force():
    rng = random.Random(13)
    pool = "the cost of a red blue box is and then we buy sell for how many do remain in total Ann Bob Çelik 5 12 7 km kg days . ? :".split()
    make = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, make(rng.choice([3, 6, 9, 14, 30, 60]))) for k in range(40)]
    items += [(40 + k, items[k][1].replace("Ann", "Eve").replace("5", "9")) for k in range(10)] + [(50, ""), (51, "...")]
    texts = [None, "", make(400), *[make(30) for _ in range(60)]]
    for _ in range(80):
        x = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):
            if x:
                x[rng.randrange(len(x))] = rng.choice(pool)
        texts.append(" ".join([make(rng.randrange(9)), " ".join(x), make(rng.randrange(9)), " ".join(x[: len(x) // 2]), make(5)]))
    texts += [items[3][1] * 40, " ".join(x for _, x in items)]
    got = {(x[0], x[1]): x[4] for x in decontaminate.leaks(pa.array(texts), decontaminate.Benchmark(items))}
    want = brute_leaks(texts, items)
    assert got == want and 50 < len(want) < len(texts) * len(items) / 4


def test_hot_templates_stay_cheap(spark):
    """One template in every item and thousands of times in a text; null ids are reported as null."""
    items = [(k, f"What is the sum of the two numbers {k} and {k + 1} in this small exercise number {k} here {k % 7}?") for k in range(3000)]
    hot = " ".join(items[5][1] for _ in range(3000))
    b = decontaminate.Benchmark(items)
    part = "What is the sum of the two numbers 8 and " * 2000
    got = decontaminate.leaks(pa.array([part, "nothing"]), b)
    assert got == []
    few = decontaminate.Benchmark(items[:8])
    assert (0, 5, True) in {(x[0], x[1], x[4]) for x in decontaminate.leaks(pa.array([hot]), few)}
    one = frame(spark, [items[5][1]], [None])
    assert [r["doc_id"] for r in decontaminate.find_leaks(one, spark.createDataFrame(items[5:6], "item_id long, text string")).collect()] == [None]


# ------------------------------------------------------------------ 2
def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = ["<turn ", "</turn>\n", "\\", "<", "turn user>", "word", "é", "\n", " ctx>", "### "]
    rows, want = [], {}
    for conv in [None, *range(40)]:
        n = rng.randrange(1, 14)
        turns = [("system" if k == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", None, "odd <role>\\"]), None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randrange(0, 120)))) for k in range(n)]
        rows += [(conv, k, r, t, "x") for k, (r, t) in enumerate(turns)]
        want[conv] = turns
    rows.append((39, 99, "assistant", "long " * 5000, "x"))
    want[39].append(("assistant", "long " * 5000))
    rows += [(7, 50, "assistant", "again", "x")] * 2  # a repeated row is a turn of its own
    want[7] += [("assistant", "again")] * 2
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    w = chat.format_conversations(d, budget=60, history=20)
    assert w.groupBy("conv_id").count().filter("count > 1").count() > 5
    for r in chat.read_back(w).collect():
        turns = [(a or "", b or "") for a, b in want[r["conv_id"]]]
        loss = "".join(b for a, b in turns if a == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    key = lambda r: str(r["conv_id"])
    assert sorted(chat.format_and_read_back(d, 60, 20).collect(), key=key) == sorted(chat.read_back(w).collect(), key=key)
    for r in w.collect():  # windows keep the budget unless a single turn is above it, and start with the system turn
        turns = list(chat.parse(r["text"]))
        if want[r["conv_id"]][0][0] == "system":
            assert turns[0][0] == "system"
        fresh = [t for t in turns if not t[2]]
        cost = [len(chat._TOKEN.findall(t[1])) + 1 for t in turns]
        alone = len(fresh) == 1 and all(t[0] == "system" for t in turns if t[2])
        assert fresh and (sum(cost) <= 60 or alone)
    assert chat.read_back(chat.format_conversations(d.limit(0))).count() == 0
    one = chat.op2_chat_windows(spark, SF).filter("conv_id = -7").first()
    said = r"\### Assistant: </turn> ok"
    assert (one["n_turns"], one["loss_chars"], one["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


# ------------------------------------------------------------------ 3
def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:760] = x[3]  # equal vectors
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [None] * 16, 1), (2080, [], 1), (2100, [1.0, 2.0], 1), (None, [1.0] * 16, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for r in ann.nearest(d, F.pmod(F.col("vec_id"), F.lit(20)) == 0, k=20, shard_rows=400).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        order = sorted((i for i in range(1500) if i != q), key=lambda i: (-s[i], i))[:20]
        hit += len(set(order) & {i for i, _ in found})
        assert len(found) == 20 and all(abs(s[i] - v) < 1e-9 for i, v in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
    assert hit / (20 * len(got)) >= 0.95
    assert ann.nearest(d.limit(0), F.lit(True)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in ann.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]


def test_repeated_vector_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 5.0]), (1, [3.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.5, 9.0])]
    for part in (rows, rows[::-1]):
        d = spark.createDataFrame([(*r, "x") for r in part], "vec_id long, embedding array<float>, key string")
        got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(d, F.col("vec_id") == 0, k=4).orderBy("rank").collect()]
        assert got == [(0, 1, 3, 45.0), (0, 2, 1, 5.0), (0, 3, 2, 5.0)]  # asks with [0, 5]


def cloud(kind, n=8000, d=64):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(n, d))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind in ("norms", "clusters"):
        x = x if kind == "norms" else rng.normal(size=(80, d))[rng.integers(0, 80, n)] + 0.3 * x
        x = x / np.linalg.norm(x, axis=1, keepdims=True) * rng.lognormal(0, 0.3 if kind == "norms" else 1, (n, 1))
    if kind == "tight":  # far-off clusters below the degree of a node
        x = rng.normal(size=(n // 20, d))[np.arange(n) % (n // 20)] + 0.001 * x
    return x.astype(np.float32)


def test_scores_of_double_vectors_are_exact(spark):
    """Vectors given in double precision are neither rounded nor overflow."""
    rows = [(0, [0.1, 0.2]), (1, [0.3, 0.7]), (2, [1e30, 1e-9]), (3, [-1e30, 0.1 + 1e-12])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["score"] for r in ann.nearest(df, F.col("vec_id") == 0).collect()}
    assert got == {i: 0.1 * a + 0.2 * b for i, (a, b) in rows[1:]}


@pytest.mark.parametrize("kind", ["unit", "gaussian", "wide", "norms", "clusters", "tight"])
def test_recall_at_shard_size(kind):
    """The shipped settings on a full shard, with vectors of equal and of varying norms."""
    x = cloud(kind, d=256 if kind == "wide" else 64)
    ids = np.arange(len(x))
    bands = ann.build_shard(ids, ids, x)
    q = x[::40]
    got, keys, scores = ann.search_bands(bands, x.shape[1], q, 21)
    s = q.astype(float) @ x.astype(float).T
    kth = np.sort(-s, axis=1)[:, 20:21]
    recall = (-scores <= kth + 1e-9 * np.abs(kth)).mean()
    print(f"\n{kind}: recall {recall:.3f}, bands {len(bands)}, beams {sorted({b['beam'] for b in bands})}")
    assert recall >= 0.95 and (got == keys).all()
    assert np.allclose(scores, np.take_along_axis(s, got, 1), rtol=1e-12, atol=1e-12)


def test_every_node_can_be_reached():
    x = cloud("tight", 2000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = ann._reach(ann._links(x, 8), x, 7)
    seen = {7}
    front = [7]
    while front:
        front = [int(v) for u in front for v in links[u] if v >= 0 and v not in seen and not seen.add(int(v))]
    assert len(seen) == len(x)


# ------------------------------------------------------------------ 4
def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    r = quality.op4_quality_fm(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out")
    rows = r.select("quality", "predicted").collect()
    assert len(rows) > 50 and sum(x["quality"] == x["predicted"] for x in rows) / len(rows) >= 0.95
    kept = [x["predicted"] for x in rows if x["quality"] == 1]
    assert sum(kept) / len(kept) >= 0.98


def test_sum_of_squares_equals_pairs():
    rng = np.random.default_rng(1)
    size = quality.BUCKETS + quality.STATS
    m = quality.Machine(0.3, rng.normal(0, 0.1, size), rng.normal(0, 0.1, (size, quality.RANK)), np.zeros(quality.STATS), np.ones(quality.STATS))
    b, stats = rng.integers(0, quality.BUCKETS, 7), rng.normal(size=(1, quality.STATS))
    idx, val = np.r_[b, np.arange(quality.BUCKETS, size)], np.r_[np.full(7, 1 / 7), stats[0]]
    y = 0.3 + (m.weights[idx] * val).sum() + sum(m.factors[idx[i]] @ m.factors[idx[j]] * val[i] * val[j] for i in range(len(idx)) for j in range(i))
    assert abs(m.score(b, np.array([0, 7]), stats)[0] - 1 / (1 + np.exp(-y))) < 1e-5


def test_quality_odd_rows(spark, odd):
    docs = frame(spark, odd)
    none = spark.createDataFrame([], "doc_id long, quality int")
    m = quality.train(docs, none, F.lit(True))
    assert {r["s"] for r in quality.score(docs, m, name="s").select("s").collect()} == {0.5}
    lab = spark.createDataFrame([(i, i % 2, "z") for i in range(len(odd))] + [(None, 1, "z"), (3, None, "z")], "doc_id long, quality int, text string")
    m = quality.train(docs, lab, F.lit(True))
    s = quality.score(docs, m, name="s")
    assert s.columns == [*docs.columns, "s"] and s.filter("s >= 0 and s <= 1").count() == len(odd)
    assert quality.score(docs.limit(0), m, name="s").count() == 0


# ------------------------------------------------------------------ 5
def test_cascade_is_exact(spark):
    uni = spark.range(6000).select(F.concat(F.lit("host"), "id").alias("key"), "id")
    listed = uni.filter("id % 7 = 0").union(uni.filter("id = 14"))
    c = urlfilter.build_cascade(listed, uni, bits_per_key=3)
    assert len(c.levels) >= 3
    segmented = urlfilter.build_cascade(listed, uni, max_bits=3000)
    assert segmented.levels[0][1] == 3
    for cascade in (c, segmented):
        assert uni.filter((F.col("id") % 7 == 0) != cascade.contains(F.col("key"))).count() == 0
    empty = urlfilter.build_cascade(listed.limit(0), uni)
    assert uni.filter(empty.contains(F.col("key"))).count() == 0
    alone = urlfilter.build_cascade(listed, uni.limit(0))
    assert listed.filter(~alone.contains(F.col("key"))).count() == 0
    none = uni.limit(3).select(F.lit(None).cast("string").alias("key"))
    assert none.filter(urlfilter.build_cascade(listed.union(none.select("key", F.lit(1))), uni).contains(F.col("key"))).count() == 0


def test_urls_and_rules(spark):
    urls = ["HTTP://A.Example.COM/en/7?x", "http://example.com/en/8", "https://www.spam-farm.example.net/de/81#t", "http://x.net/de/", "ftp://org/es/", "http://borg/es/", None, "no scheme", "http://host", "http://É.com/en/1\nx", "a://b://c/d"]
    urls += ["https://m.cheap-pills.example.org/x", "https://cheap-pills.example.org", "https://notcheap-pills.example.org/x", "https://long.test/" + "p" * 100000, urls[0]]
    d = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, host string")
    uni = d.select(urlfilter.host_of(F.col("url")).alias("key"))
    domains = spark.createDataFrame([(x,) for x in urlfilter.BLOCKED_DOMAINS], "domain string")
    c = urlfilter.build_cascade(urlfilter.listed_hosts(uni, domains), uni)
    got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.filter_urls(d, c).collect()}
    assert got[0] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1] == ("example.com", "/en/8", "com/en/", "block")
    assert got[2] == ("www.spam-farm.example.net", "/de/81", "example.net/de/8", "block")
    assert got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("org/es/", "block") and got[5][2:] == (None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8][:2] == ("host", "")
    assert got[9][0] == "É.com" and got[10][:2] == ("b:", "//c/d")
    assert [got[k][3] for k in (11, 12, 13, 14)] == ["block", "block", "allow", "allow"] and len(got[14][1]) == 100001 and got[15] == got[0]
    assert urlfilter.filter_urls(d.limit(0), c).count() == 0


# ------------------------------------------------------------------ 6
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_base_spans_equal_plain_patterns():
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice(rng.choice(["0123456789. -", "+().0123456789 ", "ab@.-%1é", "@.@a1b", "4 -0000000000"])) for _ in range(rng.randrange(60)))
        want = []
        for k, p in PATTERNS.items():
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m[0])
                ok = k == "email" or (k == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (k == "card" and 16 <= len(digits) <= 19 and pii._luhn(digits)) or (k == "phone" and 8 <= len(digits) <= 15)
                want += [(k, m.start(), m.end())] if ok else []
        assert pii.base_spans(t) == want
    assert pii.base_spans("9" * 200000 + "." * 3 + "a" * 200000 + "@") == []  # linear


def test_contexts_discover_identifiers(spark, odd):
    rng = random.Random(3)
    known = [f"please mail to u{i}@mail.example.com now {text(rng, 5)}" for i in range(30)]
    unseen = "please mail to acct-77120-x now"
    docs = frame(spark, [*odd, *known, unseen, "room number 77120-x is free", f'token = "{"ab12" * 10}" end'])
    p = pii.find_patterns(docs)
    got = {r["doc_id"]: r for r in pii.annotate(docs, p).collect()}
    n = len(odd)
    assert got[n]["n_email"] == 1 and got[n + 30]["spans"] == "id:15:27" and got[n + 31]["spans"] == "" and got[n + 32]["spans"] == "secret:9:49"
    assert got[0]["spans"] == "" and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    many = {r["doc_id"]: r["spans"] for r in pii.annotate(docs, p, max_patterns=0).collect()}
    assert many == {k: r["spans"] for k, r in got.items()}
    masked = {r["doc_id"]: r for r in pii.mask(docs, p).collect()}
    assert masked[n]["text"].startswith("please mail to <email> now") and masked[n + 30]["text"] == "please mail to <id> now" and masked[0]["text"] is None
    assert pii.mask(docs, p).columns == docs.columns and pii.annotate(docs.limit(0), p).count() == 0


def test_spaced_phones_teach_their_context(spark):
    """Numbers with blanks seed the words before the whole number, not its own digits."""
    known = [f"you may call me at +1 (743) 555-38{i} soon" for i in range(10, 40)]
    assert pii.base_spans(known[0])[0][0] == "phone"
    docs = frame(spark, [*known, "you may call me at 743-555-1234 soon", "+1 743 555-1234 is short"])
    got = {r["doc_id"]: r["spans"] for r in pii.annotate(docs, pii.find_patterns(docs)).collect()}
    assert got[30] == "id:19:31" and "id" not in got[31]


def test_discovered_instances_support_patterns(spark):
    """A pattern with three seeds is accepted if other patterns discovered enough of its instances."""
    ids = [f"acct-77{i}-x" for i in range(4)]
    docs = frame(spark, [*[f"please mail to u{i}@mail.example.com now" for i in range(40)], *[f"please mail to {x} now" for x in ids], *[f"always reach under {x} then" for x in ids], *[f"always reach under v{i}@mail.example.com then" for i in range(3)], "always reach under zz-90210 then"])
    got = {r["doc_id"]: r["spans"] for r in pii.annotate(docs, pii.find_patterns(docs)).collect()}
    assert got[51] == "id:19:27"


def test_contexts_of_any_length():
    """Two whole words, however long they are and however many blanks lie between."""
    long = "w" * 500
    for t, want in ((f"mail{' ' * 70}to\n{' ' * 90}id-12345", "mail to"), (f"{long} (to) id-12345", f"{long} to"), ("to id-12345", ""), (f"one {'x' * 90}=id-12345", "")):
        assert [p for _, _, p in pii.candidates(t)] == [want]
    assert pii._pattern("x " + " " * 10**6 + "y", 10**6 + 2) == ""  # linear
    glued = "see it " + "a" * 80 + ":1.2.3.4"
    assert pii._pattern(glued, pii._token_start(glued, glued.index("1.2.3.4"))) == "see it"


def brute_patterns(texts):
    """The bootstrapping rule by dictionaries: (pattern, confidence)."""
    graph = {}
    for t in texts:
        base = sorted((a, z) for _, a, z in pii.base_spans(t or ""))
        found = [(a, z, p, re.fullmatch(r"[0-9a-f]{32,}", t[a:z]) is not None and bool(re.search("[a-f]", t[a:z]))) for a, z, p in pii.candidates(t or "") if not any(a < y and x < z for x, y in base)]
        end = 0
        for a, z in base:
            if a >= end:
                k = a
                while k > end and not t[k - 1].isspace():
                    k -= 1
                before = [x.strip(pii._STRIP).lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t[:k])[-2:]]
                found.append((a, z, " ".join(before) if len(before) == 2 and all(before) else "", True))
            end = max(end, z)
        for a, z, p, seed in found:
            if p:
                graph[p, t[a:z]] = graph.get((p, t[a:z]), False) or seed
    known, strong = {}, {}
    for _ in range(pii.ROUNDS):
        strong = {}
        for p in {x for x, _ in graph}:
            scores = [1.0 if seed else known.get(i, 0.0) for (x, i), seed in graph.items() if x == p]
            conf = sum(scores) / (len(scores) + pii.DAMPING)
            if conf >= pii.CONFIDENT and sum(c >= pii.CONFIDENT for c in scores) >= pii.SUPPORT:
                strong[p] = conf
        miss = collections.defaultdict(lambda: 1.0)
        for (p, i), seed in graph.items():
            if p in strong and not seed:
                miss[i] *= 1 - strong[p]
        known = {i: 1 - m for i, m in miss.items()}
    return strong


def test_bootstrapping_equals_brute_force(spark, odd):
    rng = random.Random(12)
    places = [(f"p{k}", f"q{k % 4}") for k in range(12)]
    seeds = [f"u{k}@mail.example.com" for k in range(30)] + [f"10.0.0.{k}" for k in range(9)]
    texts = [*odd]
    for _ in range(900):
        k = min(int(rng.expovariate(0.3)), 11)
        found = rng.choice(seeds) if rng.random() < 0.9 - 0.07 * k else f"n-{max(k - 5, 0)}-{rng.randrange(40)}"
        texts.append(f"{text(rng, 2)} {places[k][0]} {places[k][1]}: {found} {text(rng, 2)}")
    want = brute_patterns(texts)
    got = {r["pattern"]: r["confidence"] for r in pii.find_patterns(frame(spark, texts)).collect()}
    assert 2 <= len(want) < len(places)
    assert set(got) == {pii.pattern_hash(p) for p in want} and all(abs(got[pii.pattern_hash(p)] - c) < 1e-9 for p, c in want.items())


# ------------------------------------------------------------------ 7
def test_pseudo_likelihood(spark, odd):
    rng = random.Random(5)
    chain = []
    for _ in range(400):
        w, out = rng.randrange(40), []
        for _ in range(60):
            w = (w * 7 + rng.choice([1, 2])) % 40
            out.append(f"c{w}")
        chain.append(" ".join(out))
    docs = frame(spark, chain)
    voc, net = lmscore.fit(docs)
    natural, shuffled = chain[:40], [" ".join(rng.sample(t.split(), 60)) for t in chain[:40]]
    got = {r["doc_id"]: r for r in lmscore.score(frame(spark, natural + shuffled + odd), voc, net).collect()}
    a, b = (np.mean([got[i + s]["mean_log_prob"] for i in range(40)]) for s in (0, 40))
    assert a > b + 0.3 and a > -np.log(40) + 0.3  # better than frequencies alone
    assert got[80]["n_words"] == 0 and got[80]["log_prob"] == 0 and got[80]["mean_log_prob"] is None
    run, place = lmscore.padded(np.arange(20), np.array([0, 10, 10, 20]))
    every = []
    for k in range(lmscore.SIZE):
        run[place[7]] = k
        every.append(net.log_prob(run)[place[7]])
    assert abs(np.exp(every).sum() - 1) < 1e-3  # a distribution over words
    v, n = lmscore.fit(docs.limit(0))
    assert lmscore.score(docs.limit(0), v, n).count() == 0


def test_log_probabilities_equal_brute_force():
    """Each word from its neighbours in its own document, one at a time, in double precision; a gradient step lowers the loss."""
    rng = np.random.default_rng(11)
    net = lmscore.Network({k: rng.normal(0, 0.7, s).astype(np.float32) for k, s in lmscore.SHAPES.items()})
    first = np.array([0, 1, 1, 30, 33])
    ids = rng.integers(0, lmscore.SIZE, 33)
    run, place = lmscore.padded(ids, first)
    got = net.log_prob(run)[place]
    p = {k: v.astype(float) for k, v in net.p.items()}
    for a, z in zip(first[:-1], first[1:], strict=True):
        for i in range(a, z):
            near = [ids[j] if a <= j < z else lmscore.PAD for j in range(i - lmscore.REACH, i + lmscore.REACH + 1) if j != i]
            h = np.r_[np.tanh(p["embed"][near].sum(axis=0)), 1]
            want = 0
            for d in range(lmscore.DEPTH):
                below = lmscore.SIDE ** (lmscore.DEPTH - 1 - d)
                logits = p[f"tree{d}"].reshape(-1, lmscore.SIDE, lmscore.WIDTH + 1)[ids[i] // (below * lmscore.SIDE)] @ h
                want += logits[ids[i] // below % lmscore.SIDE] - np.log(np.exp(logits).sum())
            assert abs(got[i] - want) < 1e-4
    before, seen = got.mean(), {}
    for _ in range(20):
        net.train(run, seen, batch=16)
    assert net.log_prob(run)[place].mean() > before + 1


@pytest.mark.parametrize("seed", [1, 2])
def test_every_document_trains(spark, seed):
    """Even a corpus of one text trains the network, with the settings as they are."""
    _, net = lmscore.fit(frame(spark, [text(random.Random(seed), 200, 20)]))
    assert np.abs(net.p["tree0"][:, : lmscore.WIDTH]).max() > 0


def test_rare_words_have_their_own_probability(spark):
    """Words beyond the most frequent share an id, but not its probability."""
    slot = lambda x: int(T.words_of(pa.array([x])).hashes[0] >> T.U64(40)) % lmscore.TAIL
    rare = next(f"r{i}" for i in range(100000) if slot(f"r{i}") == slot("often"))
    head = " ".join(f"h{i}" for i in range(lmscore.HEAD))
    voc, net = lmscore.fit(frame(spark, [head] * 9 + ["often"] * 7 + [rare]))
    got = {r["doc_id"]: r for r in lmscore.score(frame(spark, ["often", rare, f"{rare} often h1", "often"], [1, 2, 3, 1]), voc, net).collect()}
    assert abs(got[1]["log_prob"] - got[2]["log_prob"] - np.log(7)) < 1e-6
    assert got[3]["n_words"] == 3 and abs(got[3]["mean_log_prob"] * 3 - got[3]["log_prob"]) < 1e-9


# ------------------------------------------------------------------ 8
def brute_dedup(texts, k):
    count = collections.Counter(tuple(w[j : j + k]) for w in map(words, texts) for j in range(len(w) - k + 1))
    out = []
    for t in texts:
        w = words(t)
        keep = [True] * len(w)
        for j in range(len(w) - k + 1):
            if count[tuple(w[j : j + k])] > 1:
                keep[j : j + k] = [False] * k
        out.append((len(w), keep.count(False), " ".join(x for x, y in zip(w, keep, strict=True) if y)))
    return out


def test_substrings_equal_brute_force(spark, odd):
    rng = random.Random(6)
    parts = [text(rng, rng.randrange(20, 90), 500) for _ in range(6)]
    mix = [" ".join(rng.choice(parts) if rng.random() < 0.5 else text(rng, 15, 500) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    loops = ["ab cd " * 60, "x " * 36, "x " * 34, "p q r s t u v " * 20]
    texts = [*odd, *mix, *loops]
    ids = [None, *range(1, len(texts) - 3), -(1 << 63), 5, 5]
    got = substring.dedup(frame(spark, texts, ids)).collect()
    want = [(i, *b) for i, b in zip(ids, brute_dedup(texts, substring.K), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert substring.dedup(frame(spark, texts).limit(0)).count() == 0


# ------------------------------------------------------------------ 9
def test_mix_meets_targets(spark, odd):
    rng = random.Random(7)
    texts = [*odd[:-8], *[text(rng, rng.randrange(5, 60)) for _ in range(300)]]
    docs = frame(spark, texts)
    docs = docs.union(docs.limit(5))
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(texts) + 5 and all(r["taken"] <= 2 * r["size"] for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["source_size"], r["target"]].append(r)
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(words(r["text"]))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, budget, target = set(names), 1.5 * sum(sizes.values()), {}
    while True:
        lam = budget / sum(weight[s] for s in left)
        full = {s for s in left if lam * weight[s] >= 2 * sizes[s]}
        if not full:
            target |= {s: lam * weight[s] for s in left}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        budget, left = budget - sum(2 * sizes[s] for s in full), left - full
    assert sorted(round(t, 6) for _, t in by) == sorted(round(t, 6) for t in target.values())
    for (_, t), rows in by.items():
        assert abs(sum(r["taken"] for r in rows) - t) <= max(r["size"] for r in rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()), key=str)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ 10
def brute_classes(texts, ids):
    bags = []
    for t in texts:
        w = words(t)
        bags.append(collections.Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])))
    up, sizes = list(range(len(texts))), [sum(b.values()) for b in bags]

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = sum(min(c, bags[j][k]) for k, c in bags[i].items() if k in bags[j])
            either = sizes[i] + sizes[j] - both
            if words(texts[i]) == words(texts[j]) or either and both >= 0.8 * either:
                up[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        best.setdefault(find(i), []).append(d)
    return [(d, min((x for x in best[find(i)] if x is not None), default=None), len(best[find(i)])) for i, d in enumerate(ids)]


def test_near_duplicates_equal_brute_force(spark, odd):
    rng = random.Random(8)
    base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
    ring = []
    for _ in range(90):  # copies around a missing original: links are sparse
        w = list(base)
        for _ in range(rng.choice([2, 3, 4])):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        ring.append(" ".join(w))
    heavy = ["a b c d e " * 40, "a b c d e " * 42, "a b c d e " * 20]
    texts = [*odd, *ring, *heavy, odd[5], odd[5], ring[0], "null one", "null one", "null two"]
    ids = [*range(len(texts) - 6), 5, None, None, None, None, -(1 << 63)]
    key = lambda r: str(r)
    old = neardup.CHUNK, neardup.SIGNATURES
    neardup.CHUNK, neardup.SIGNATURES = 40, 12
    try:
        got = sorted(map(tuple, neardup.near_duplicates(frame(spark, texts, ids)).collect()), key=key)
    finally:
        neardup.CHUNK, neardup.SIGNATURES = old
    assert got == sorted(brute_classes(texts, ids), key=key)
    assert got == sorted(map(tuple, neardup.near_duplicates(frame(spark, texts, ids)).collect()), key=key)  # in one block
    docs = frame(spark, texts, ids)
    docs = docs.union(docs.filter("doc_id = 0").withColumn("lang", F.lit("aa")))
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, c, _ in got if c is not None}) + 1
    assert [r["lang"] for r in kept.filter("doc_id = 0").collect()] == ["aa"]  # the least of equal ids and texts
    assert sorted(map(tuple, kept.collect()), key=key) == sorted(map(tuple, neardup.keep_one(docs.orderBy(F.desc("lang"))).collect()), key=key)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0 and neardup.keep_one(docs.limit(0)).count() == 0


def test_tied_pairs_of_single_nodes_are_compared(spark):
    """A bucket whose smallest node is unlike two equal ones: both are in a group, however small it is."""
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 256, (2, neardup.REGISTERS), dtype=np.uint8)
    nodes = spark.createDataFrame([(0, bytearray(sig[0])), (1, bytearray(sig[1])), (2, bytearray(sig[1]))], "node long, sig binary")
    star = spark.createDataFrame([(9, 0, 0, 0), (9, 0, 0, 1), (9, 0, 0, 2)], "bucket long, part int, hub long, node long")
    labels = spark.createDataFrame([], "node long, label long")
    tied = neardup.ties(star, labels, nodes)
    assert [tuple(r) for r in tied.collect()] in ([(1, 2)], [(2, 1)])
    assert sorted(r["node"] for r in neardup.groups(tied, labels, nodes).collect()) == [1, 2]
    hubs = spark.createDataFrame([(0, 1), (0, 2)], "hub long, node long")
    assert sorted(r["node"] for r in neardup.groups(tied, labels, nodes, hubs).collect()) == [1, 2]
    assert neardup.groups(tied, labels, nodes, hubs.union(spark.createDataFrame([(1, 2)], hubs.schema))).count() == 0  # compared already


def test_pairs_hidden_behind_other_hubs(spark):
    """Pairs of near copies in a large family of pages that share a third of their text: every bucket has a smaller, unlike node."""
    rng = random.Random(15)
    lines = [text(rng, 12, 10**6) for _ in range(60)]
    texts = []
    for _ in range(300):
        texts.append(" ".join([*rng.sample(lines, 24), text(rng, 150, 10**6)]))
    pairs = []
    for _ in range(50):
        w = " ".join([*rng.sample(lines, 24), text(rng, 150, 10**6)]).split()
        v = list(w)
        for _ in range(6):
            v[rng.randrange(len(v))] = f"x{rng.randrange(10**6)}"
        pairs += [" ".join(w), " ".join(v)]
    texts += pairs
    got = sorted(map(tuple, neardup.near_duplicates(frame(spark, texts)).collect()))
    assert got == sorted(brute_classes(texts, range(len(texts))))


def test_stars_over_batches(spark):
    """Buckets that lie across Arrow batches keep their smallest node, their first row and their parts."""
    rng = random.Random(16)
    rows = [(k, [rng.randrange(40), 100 + rng.randrange(1000)]) for k in range(600)]
    want = collections.defaultdict(list)
    for k, b in rows:
        for x in b:
            want[x].append(k)
    want = {(x, i // 4, min(m), k) for x, m in want.items() if len(m) > 1 for i, k in enumerate(sorted(m))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = [tuple(r) for r in neardup.stars(spark.createDataFrame(rows, "node long, bands array<long>"), 4).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and set(got) == want


def test_components_in_one_task_and_in_rounds(spark):
    rng = random.Random(10)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {x: find(x) for x in up if find(x) != x}
    e = spark.createDataFrame(pairs, "a long, b long")
    for most in (10**6, 40):
        assert {r["node"]: r["label"] for r in graph.components(e, most).collect()} == want
    assert graph.components(e.limit(0)).count() == 0


def test_bag_signatures_are_unbiased():
    rng = np.random.default_rng(9)
    off = []
    for _ in range(30):
        a = rng.integers(0, 7, 150)
        b = np.where(rng.random(150) < 0.7, a, rng.integers(0, 12, 150))
        h = rng.integers(0, 2**63, 150).astype(np.uint64)
        s = neardup.signatures(np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)], np.r_[h[a > 0], h[b > 0]], np.r_[a[a > 0], b[b > 0]], 2, 512)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.035


# ------------------------------------------------------------------ pipeline
def test_mixed_corpus_keeps_texts(spark):
    """The last stage gives whole documents, each row with its own copies."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("size", F.lit("x"))
    got = pipeline.mix(spark, docs, SF)
    assert got.columns[: len(docs.columns)] == docs.columns and "mix_size" in got.columns and got.count() > 0
    assert got.select(docs.columns).exceptAll(docs).count() == 0
    assert got.filter(mixing.size_of(F.col("text")) != F.col("mix_size")).count() == 0


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(1)).withColumn("th", F.lit("x"))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in pipeline.STAGES:
        before = docs.count()
        out = stage(spark, docs, SF)
        assert name == pipeline.STAGES[-1][0] or out.columns == docs.columns
        assert out.count() <= before
        if name == "quality_classifier":
            kept = {r["doc_id"] for r in out.select("doc_id").collect()}
            assert sum(q == 1 and d not in kept for d, q in labels.items()) == 0 and sum(q == 0 and d in kept for d, q in labels.items()) <= 2
        if name == "personal_data":
            assert out.filter(F.col("text").rlike(PATTERNS["email"])).count() == 0 and out.filter("n_chars <> length(text)").count() == 0
        docs = out.checkpoint()
    assert docs.filter("copies < 1").count() == 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def _odd_documents(spark):
    """Copies, nulls in every column, empty and very long texts, personal data, a leak, and repeated rows that differ in other columns."""
    rng = random.Random(17)
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    clean = docs.join(decontaminate.find_leaks(docs, bench), "doc_id", "left_anti")
    good = [r["text"] for r in clean.join(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1"), "doc_id").orderBy("doc_id").collect()]
    good = (good * 2)[:60]
    item = max((r["text"] for r in bench.collect()), key=len)
    rows = [(1, good[0], "en", "a", 1), (2, good[0], "de", "b", 1), (3, good[0], "aa", None, None), (3, good[0], "ab", "a", 1), (None, good[1], None, None, None)]
    rows += [(5, None, "en", "a", 0), (6, "", None, "b", 0), (7, " ".join(good[2:40]) * 3, "en", "a", 9), (8, good[40] + " " + item + " " + good[41], "en", "b", 9)]
    rows += [(9, good[42] + " write to someone.else@mail.example.com today", "en", "c", 9)] * 2
    rows += [(20 + k, good[43 + k], rng.choice(["en", "de"]), rng.choice(["a", "b", None]), 5) for k in range(12)]
    return spark.createDataFrame([(*r, "x", r[1], 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, th string, size string, rank int")


def test_stages_on_odd_rows(spark):
    """Each stage on nulls, empty and long texts, ties and repeated rows, in either order of the rows."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = _odd_documents(spark)
    out = {}
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        out[name] = sorted(map(tuple, got.collect()), key=str)
        assert out[name] == sorted(map(tuple, stage(spark, docs.orderBy(F.desc("lang")), SF).collect()), key=str)
    every = sorted(map(tuple, docs.collect()), key=str)
    quality = [r for r in out["quality_classifier"] if r[1]]
    assert sum(r[0] in (1, 2, 3, 7) for r in quality) == 5  # copies are scored alike, long texts too
    kept = {(r[0], r[2]) for r in out["near_duplicates"]}
    assert (1, "en") in kept and not {(2, "de"), (3, "aa"), (3, "ab")} & kept and (None, None) in kept
    assert sum(r[0] == 9 for r in out["near_duplicates"]) == 1 and sum(r[0] in (5, 6) for r in out["near_duplicates"]) == 1
    assert [r for r in every if r not in out["benchmark_decontamination"]] == [r for r in every if r[0] == 8]
    masked = {r[0]: r for r in out["personal_data"]}
    assert len(out["personal_data"]) == len(every) and "<email>" in masked[9][1] and masked[9][4] == len(masked[9][1]) and masked[5][1] is None
    mixed = pipeline.mix(spark, docs, SF)
    assert {"mix_size", "copies", "text", "rank"} <= set(mixed.columns) and mixed.filter("copies < 1 or mix_size > 0 and taken <> copies * mix_size").count() == 0


def test_whole_pipeline(spark, tmp_path):
    """``run`` over the smallest tables: what must go is gone, what is kept is whole; an empty table runs through."""
    pipeline = pytest.importorskip("corpus_pipeline")
    got = pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.columns[: len(docs.columns)] == docs.columns
    rows = got.collect()
    assert 0 < len(rows) < docs.count() and len({r["doc_id"] for r in rows}) == len(rows)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:  # masks apart, every text is whole
        parts = re.split(r"<(?:email|ip|card|phone|id|secret)>", r["text"])
        at = 0
        for x in parts:
            at = texts[r["doc_id"]].index(x, at) + len(x)
        assert texts[r["doc_id"]].startswith(parts[0]) and texts[r["doc_id"]].endswith(parts[-1])
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    assert len(bad & {r["doc_id"] for r in rows}) <= 2
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_low_weights_are_spread_over_ranges(spark):
    """Weights of a tenth put most keys far out; the order of keys is still dealt over many tasks, and exact."""
    n = 4000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"), F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("source"))
    got = mixing.mix_sources(docs.repartition(5), weight=F.lit(0.1)).collect()
    keys = {}
    for i in range(n):
        u = (int(hashlib.md5(f"{i}:17".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        keys[i] = -np.log(u) / 0.1
    for source in ("hot", "cold"):
        mine = [r for r in got if (r["doc_id"] % 10 < 9) == (source == "hot")]
        target, epochs = mine[0]["target"], int(mine[0]["target"] // mine[0]["source_size"])
        rest, taken = target - epochs * mine[0]["source_size"], set()
        for at, r in enumerate(sorted(mine, key=lambda r: keys[r["doc_id"]])):
            if at * 5 + 2.5 <= rest:
                taken.add(r["doc_id"])
        assert {r["doc_id"] for r in mine if r["copies"] > epochs} == taken
    same = docs.union(docs.filter("doc_id = 3").crossJoin(spark.range(3000)).select(docs.columns))  # one id on most rows
    assert mixing.mix_sources(same, weight=F.lit(0.1)).count() == n + 3000


def test_one_id_on_many_rows_is_one_training_row(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, text(rng, 40, 300 if i % 2 else 30)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    many = docs.union(docs.filter("doc_id = 7").crossJoin(spark.range(5000)).select("doc_id", "text"))
    a, b = (quality.train(d, labels, F.lit(True)) for d in (docs, many))
    assert (a.factors == b.factors).all() and a.bias == b.bias
    two = docs.union(spark.createDataFrame([(7, None), (7, "z")], docs.schema))
    assert (quality.train(two, labels, F.lit(True)).factors == quality.train(two.orderBy(F.desc("text")), labels, F.lit(True)).factors).all()
