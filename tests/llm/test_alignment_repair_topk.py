"""Conversation repair, exact top-k and tokenizer alignment against brute-force versions and on odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import crosstok, repair, topk

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, signature string, none int"


# ------------------------------------------------------------------ 11
def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute_repair(turns):
    """(cost, audit, repaired turns) by comparing whole audits; ``turns``: (role, text, fault)."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {}

    def visit(i, state):  # rows from the end, so that no recursion is deep
        found = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
        if i < len(turns):
            role, text, fault = turns[i]
            rest = best[i + 1]
            found.append((2 + rest[state][0], "D" + rest[state][1], rest[state][2]))
            if fault not in ("blank", "duplicate"):
                late = 5 if fault == "truncated" else 0
                for name in (role, "user", "assistant"):
                    to = after.get((state, name[:1]))
                    if to:
                        same = name is role
                        r = rest[to]
                        found.append((late + (0 if same else 1) + r[0], ("K" if same else "R") + r[1], ((name, text), *r[2])))
        return found

    for i in range(len(turns), -1, -1):
        base = {s: visit(i, s) for s in ("", "s", "u", "a")}
        best[i] = {s: min(((c, a) for c, a, _ in x), default=(10**9, "~")) for s, x in base.items()}
        best[i] = {s: next((f for f in base[s] if f[:2] == best[i][s]), (10**9, "~", ())) for s in base}
        for _ in range(4):
            for s in best[i]:
                for name in ("user", "assistant"):
                    to = after.get((s, name[0]))
                    if to and best[i][to][0] < 10**8:
                        c, a, t = best[i][to]
                        best[i][s] = min(best[i][s], (5 + c, "I" + a, ((name, ""), *t)), key=lambda x: x[:2])
    return best[0][""]


def brute_report(rows):
    convs = defaultdict(list)
    for r in brute_damage(rows):
        convs[r[0]].append(r[1:])
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(convs[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in turns:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        n = Counter(faults)
        numbers = {t for t, _, _ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(turns, turns[1:], strict=False))
        cost, audit, left = brute_repair([(r, t, f) for (_, r, t), f in zip(turns, faults, strict=True)])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest)
    return out


def spark_report(rows):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[c] for c in names) for r in rows}


def test_repairs_of_the_table_match(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = repair.op11_suffix_automaton(spark, SF).collect()
    assert len(got) == len({r["conv_id"] for r in rows})
    assert spark_report(got) == brute_report([tuple(r) for r in rows])


def test_odd_conversations_are_repaired(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "Yes.", "No! ", "and then", "ü?\x0b", "x" * 50_000 + ".", "...", "a:b\nc."]
    roles = ["user", "assistant", "system", "tool", None, "", "uncle", "Assistant"]
    rows = [(c if c % 7 else None, rng.choice([None, *range(9)]), rng.choice(roles[: 3 + c % 6]), rng.choice(texts), "x", 1) for c in range(60) for _ in range(rng.randrange(1, 9))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"line {t}.", "x", 1) for t in range(3000)] + [(101, 1, "user", "again.", "x", 1)] * 300
    rows += [(102, -(2**62), "user", "a.", "x", 1), (102, 2**62 - 5, "assistant", "b.", "x", 1)]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    assert spark_report(repair.report(repair.damage(df), df).collect()) == brute_report([r[:4] for r in rows])
    assert repair.report(df.limit(0)).count() == 0
    # every conversation's rows lost
    lost = next(c for c in range(200, 400) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    one = spark.createDataFrame([(lost, 1, "user", "hi.", "x", 1)], TURNS)
    empty = hashlib.sha256(b"").hexdigest()
    assert spark_report(repair.report(repair.damage(one), one).collect()) == {lost: (0, 0, 0, 0, 0, 0, "", empty)}


def test_repaired_turns_follow_the_grammar(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    turns = repair.repaired(repair.damage(rows)).collect()
    by = defaultdict(list)
    for r in turns:
        by[r["conv_id"]].append(r)
    for conv in by.values():
        conv.sort(key=lambda r: r["nth"])
        assert re.fullmatch("s?(ua)+", "".join(r["role"][0] for r in conv))
        assert all((r["edit"] == "I") == (r["text"] == "") for r in conv)


def test_nodes_are_shared_between_signatures():
    rng = random.Random(1)
    some = sorted({"".join(rng.choice("suaxUA-") for _ in range(rng.randrange(30))) + "uaua" * 5 for _ in range(400)}, key=lambda s: s[::-1])
    got = list(repair.solve(iter(some)))
    suffixes = {s[i:] for s in some for i in range(len(s))}
    assert sum(n for _, _, _, n in got) == len(suffixes)
    fault = {"-": "blank"}
    for s, cost, audit, _ in got:
        want = brute_repair([(x.lower(), ".", fault.get(x, "truncated" if x.isupper() else "")) for x in s])
        assert (cost, audit) == want[:2]


# ------------------------------------------------------------------ 12
def brute_top(rows, is_query, k):
    whole = {(i, tuple((int(x) * 1024 if abs(x) > 2**50 else int(np.floor(1024 * x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted({i for i, _ in whole if is_query(i)}):
        best = {}
        for i, v in whole:
            if i != q:
                best[i] = max([best.get(i, -(10**700))] + [sum(x * y for x, y in zip(w, v, strict=False)) for j, w in whole if j == q])
        for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.append((q, rank, i, min(max(s, -(2**63)), 2**63 - 1)))
    return out


@pytest.mark.parametrize("giant", [0.5, 1e6, 1e30])
def test_top_scores_match(spark, giant):
    rng = random.Random(5)
    vec = lambda n=6: [rng.choice([0.0, 0.0, rng.uniform(-1, 1), giant, -giant]) for _ in range(n)]
    rows = [(i, vec()) for i in range(120)] + [(i, [0.25] * 6) for i in range(120, 200)] + [(3, vec()), (3, vec()), (20, vec()), (7, rows7 := vec()), (7, rows7)]
    rows += [(300, []), (301, [0.5, None]), (302, [float("nan")]), (303, [float("inf")]), (304, None), (None, [1.0]), (305, vec(3)), (-40, vec()), (306, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, high string").repartition(3)
    want = brute_top(rows, lambda i: i % 20 == 0, 10)
    for block, group in ((50, 4), (1000, 1000)):
        got = topk.top_k(df, F.pmod(F.col("vec_id"), F.lit(20)) == 0, 10, block, group).collect()
        assert sorted(tuple(r) for r in got) == want
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    few = topk.top_k(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert len(few) == 2


# ------------------------------------------------------------------ 13
@pytest.fixture(scope="module")
def reference():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{crosstok.FILES}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=f"{crosstok.FILES}/piece_bpe_32k.model")


def brute_alignment(texts, reference):
    a_tok, b_tok = reference
    letters = {chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else None: b for b in range(256)}
    letters.pop(None)
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        a = a_tok.encode(" " + t, add_special_tokens=False).ids
        b = b_tok.encode(t)
        ab = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
        bb = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_tok.id_to_piece(i)]]
        whole = (" " + t).encode()
        if b"".join(ab) != whole or b"".join(bb) != whole:
            docs.append(None)
            continue
        spans = lambda x: [(sum(map(len, x[:k])), sum(map(len, x[: k + 1]))) for k in range(len(x))]
        sa, sb = spans(ab), spans(bb)
        links = [(a[i], b[j]) for i, (p, q) in enumerate(sa) for j, (r, s) in enumerate(sb) if p < s and r < q]
        ends = sorted({q for _, q in sa} & {q for _, q in sb})
        groups = [(",".join(str(i) for i, (_, q) in zip(a, sa, strict=True) if lo < q <= hi), ",".join(str(i) for i, (_, q) in zip(b, sb, strict=True) if lo < q <= hi)) for lo, hi in zip([0, *ends], ends, strict=False)]
        docs.append((len(a), len(b), groups, links))
    count = Counter(x for d in docs if d for x in set(d[3]))
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        digest = hashlib.sha256(";".join(f"{x}|{y}" for x, y in d[2]).encode()).hexdigest()
        out.append((d[0], d[1], len(d[2]), len(d[3]), sum(count[x] == top[x[0]] for x in d[3]), sum(count[x] for x in d[3]), digest))
    return out


ODD = [None, "", " ", "\n", "a", "  two  blanks ", "tab\tand\r\nline \x0b\x0c", "naïve café 東京 🙂 ok", "U+2581 ▁ inside", "<|endoftext|> <s> </s> <unk> <0x41>", "it's we'll they'RE 12,345.67 x^2", "a" * 3000, " " * 500, "é   　 x y", "the cat", "the cat", "\x00 nul", "🙂" * 40 + " the"]


def test_alignments_match(spark, reference):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()
    texts = ODD + [r["text"] for r in rows if r["text"] is not None and len(r["text"]) < 3000]
    df = spark.createDataFrame([(i if i % 5 else None, t, 1, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, row int, pairs string, key long").repartition(4)
    want = brute_alignment(texts, reference)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    for broadcast in (10**6, 0):
        got = crosstok.align_corpus(df, max_broadcast=broadcast).collect()
        assert sorted(tuple(r[c] for c in names) for r in got) == sorted(want)
        by_id = {r["doc_id"]: tuple(r[c] for c in names) for r in got if r["doc_id"] is not None}
        assert by_id == {i: w for i, w in enumerate(want) if i % 5}
    assert crosstok.align_corpus(df.limit(0)).count() == 0


def test_chunks_tokenize_like_whole_texts(spark, reference):
    a, b = crosstok.tokenizers(crosstok.FILES)
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        if not r["text"]:
            continue
        chunks = crosstok._CHUNK.split(b" " + r["text"].encode())
        assert [i for x in a.encode(chunks) for i in x] == reference[0].encode(" " + r["text"], add_special_tokens=False).ids
        assert [i for x in b.encode(chunks) for i in x] == reference[1].encode(r["text"])


def test_products_by_rows():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 3, (7, 9)) * (rng.random((7, 9)) < 0.4), rng.integers(0, 3, (9, 5)) * (rng.random((9, 5)) < 0.4)

    def csr(m):
        r, c = np.nonzero(m)
        return crosstok.Csr(np.searchsorted(r, np.arange(len(m) + 1)), c, m[r, c], m.shape[1])

    def dense(s, n):
        out = np.zeros((n, s.width), np.int64)
        out[np.repeat(np.arange(n), np.diff(s.start)), s.columns] = s.values
        return out

    assert (dense(csr(x).times(csr(y)), 7) == x @ y).all() and (dense(csr(x).transposed(), 9) == x.T).all()
    assert (csr(x).row_sizes_of_product(csr(y)) == (x != 0).astype(int) @ (y != 0).sum(axis=1)).all()
    a = crosstok.Aligned([[0, 1], [2]], [[0], [1, 1]], np.array([1, 2, 4]), np.array([3, 2]))
    assert a.n_groups == 2 and a.shared_group_links().columns.tolist() == [0, 0, 1, 2] and a.links.values.tolist() == [1, 2, 2, 2]
