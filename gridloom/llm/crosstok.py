"""Alignment of two tokenizers' tokens by sparse incidence products.

Both tokenizations of one text cover the same bytes, so each is an incidence matrix of tokens by bytes, held as hand-built CSR
arrays.  Gustavson's row products A * B' give the links: for each row (token of A) the columns (bytes) it holds select rows of B',
and equal columns (tokens of B) add up to the number of shared bytes.  Bytes where tokens of both end cut the tokens into groups;
the incidence of tokens by groups gives shared-group links by the same product.

No token of A crosses a blank that follows a visible ASCII character, and none of B (checked on its vocabulary), so a text is cut
there into chunks that tokenize alone; the chunks of a task are tokenized and multiplied once, all new ones of a slice of texts as one
block-diagonal matrix, and texts gather the rows of their chunks.

A pair of ids counts in how many documents it is linked.  Documents keep their distinct pairs with multiplicities in a stored
table; pairs are counted and their counts joined back, by broadcast up to ``MAX_BROADCAST_PAIRS``, else by a shuffle.

A is a byte-level BPE file, taken as ranks (ids in the order of merges, which is checked), B a sentencepiece model.

Edge cases: null and empty texts, and those whose joined token bytes differ from a blank and the text (a text that holds U+2581
itself), have no tokens: zeros and an empty digest; strings of special tokens are plain text; repeated rows and doc_ids are rows of
their own and count one by one, a null doc_id stays null; texts of any length are taken whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import tokens as T
from gridloom.llm.store import cut, table

FILES = "/opt/tokenizers"
MAX_BROADCAST_PAIRS = 2_000_000  # rows of 24 bytes
CACHED = 1 << 25  # bytes of chunks and tokens that a task keeps
TIMES = 27  # bits for a pair's multiplicity in one text
_CHUNK = re.compile(rb"(?<=[\x21-\x7e])(?= )")
#: fixed: the split of words before byte-level merges, as the vocabulary's format defines it
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: visible Latin-1 for itself, the rest from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Tokenizer A; ``bytes_of[id]``: the bytes of a token."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if word not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        made = [vocab["".join(m)] for m in pairs]
        if made != sorted(made) or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path}: ids of byte-level tokens must be in the order of merges")
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for word, i in ranks.items():
            self.bytes_of[i] = word
        self._core = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, chunks: list[bytes]) -> list[list[int]]:
        return [self._core.encode_ordinary(c.decode()) for c in chunks]


class Pieces:
    """Tokenizer B, which puts a blank before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._core = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = []
        for i in range(self._core.get_piece_size()):
            piece = self._core.id_to_piece(i)
            self.bytes_of.append(bytes([int(piece[3:5], 16)]) if self._core.is_byte(i) else piece.replace("▁", " ").encode())
            if re.search("[^▁]▁", piece):
                raise ValueError(f"{path}: the piece {piece!r} crosses the start of a word")

    def encode(self, chunks: list[bytes]) -> list[list[int]]:
        out = self._core.encode([c[1:].decode() for c in chunks], num_threads=1)
        return [x if len(c) > 1 else [self._core.piece_to_id("▁")] for c, x in zip(chunks, out, strict=True)]  # an empty text gets no blank


@lru_cache(maxsize=2)
def tokenizers(folder: str) -> tuple[ByteBpe, Pieces]:
    return ByteBpe(f"{folder}/byte_bpe_50k.json"), Pieces(f"{folder}/piece_bpe_32k.model")


def ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (n[i] numbers) for every i."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Csr:
    """A sparse matrix of ones (or counts) by rows: ``columns[start[i]:start[i + 1]]`` of row i."""

    def __init__(self, start: np.ndarray, columns: np.ndarray, values: np.ndarray | None = None, width: int | None = None):
        self.start, self.columns = start, columns
        self.values = np.ones(len(columns), np.int64) if values is None else values
        self.width = width if width is not None else int(columns.max(initial=-1)) + 1

    def transposed(self) -> Csr:
        row = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        by = np.argsort(self.columns, kind="stable")
        return Csr(np.searchsorted(self.columns[by], np.arange(self.width + 1)), row[by], self.values[by], len(self.start) - 1)

    def times(self, other: Csr) -> Csr:
        """Gustavson's product: each row gathers the other's rows that its columns name, then equal columns add up."""
        n = np.diff(other.start)[self.columns]
        take = ragged(other.start[self.columns], n)
        row = np.repeat(np.repeat(np.arange(len(self.start) - 1), np.diff(self.start)), n)
        key = row * max(other.width, 1) + other.columns[take]
        by = np.argsort(key, kind="stable")
        key, value = key[by], (np.repeat(self.values, n) * other.values[take])[by]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(value, new) if len(new) else value
        row, column = key[new] // max(other.width, 1), key[new] % max(other.width, 1)
        return Csr(np.searchsorted(row, np.arange(len(self.start))), column, total, other.width)

    def row_sizes_of_product(self, other: Csr) -> np.ndarray:
        """Entries that :meth:`times` gathers for each row (its symbolic phase), without the product."""
        n = np.diff(other.start)[self.columns]
        return np.add.reduceat(np.concatenate([n, [0]]), self.start[:-1]) * (np.diff(self.start) > 0) if len(self.start) > 1 else n


def incidence(lengths: np.ndarray) -> Csr:
    """Tokens by bytes, for tokens that lie end to end."""
    start = np.concatenate([[0], np.cumsum(lengths)])
    return Csr(start, np.arange(start[-1]), width=int(start[-1]))


class Aligned:
    """Tokens, links and groups of a list of byte strings that both tokenizers reproduce, as arrays over all of them.

    ``a``, ``b``: ids; ``a_of``, ``b_of``: the string of each token; ``a_group``, ``b_group``: the group (numbered through);
    ``links``: products of the incidence matrices (rows: tokens of A, columns: tokens of B, values: shared bytes).
    """

    def __init__(self, a: list[list[int]], b: list[list[int]], a_size: np.ndarray, b_size: np.ndarray):
        flat = lambda x: np.fromiter((i for y in x for i in y), np.int64)
        of = lambda x: np.repeat(np.arange(len(x)), [len(y) for y in x])
        self.a, self.b, self.a_of, self.b_of = flat(a), flat(b), of(a), of(b)
        by_byte = incidence(a_size[self.a]), incidence(b_size[self.b])
        ends = np.intersect1d(by_byte[0].start[1:], by_byte[1].start[1:], assume_unique=True)
        self.a_group, self.b_group = (np.searchsorted(ends, m.start[1:]) for m in by_byte)
        self.n_groups = len(ends)
        self.links = by_byte[0].times(by_byte[1].transposed())

    def groups(self) -> tuple[Csr, Csr]:
        """Tokens of A by groups, and groups by tokens of B."""
        a, b = (Csr(np.arange(len(g) + 1), g, width=self.n_groups) for g in (self.a_group, self.b_group))
        return a, b.transposed()

    def shared_group_links(self) -> Csr:
        """Tokens of A by tokens of B of the same group (quadratic in a group's tokens; see :meth:`Csr.row_sizes_of_product` for counts)."""
        a, b = self.groups()
        return a.times(b)


class _Chunks:
    """What a task knows of the chunks that it has met."""

    FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_shared", "ok")

    def __init__(self, folder: str):
        self.tok = tokenizers(folder)
        self.size = [np.array([len(x) for x in t.bytes_of]) for t in self.tok]
        n = [len(t.bytes_of) for t in self.tok]
        self.base = n[1]
        if (n[0] * n[1]) >> (63 - TIMES):
            raise ValueError("vocabularies too large for packed pairs")
        names = [[str(i) for i in range(k)] for k in n]
        # a token's text in a digest, by what follows it there
        self.words = np.array([x + "," for x in names[0]] + [x + "|" for x in names[0]] + [x + "," for x in names[1]] + [x + ";" for x in names[1]], object)
        self.clear()

    def clear(self):
        self.at: dict[bytes, int] = {}
        self.text: list[str] = []
        self.facts = np.zeros((0, len(self.FIELDS)), np.int64)
        self.pairs, self.first, self.held = np.zeros(0, np.int64), np.zeros(1, np.int64), 0

    def learn(self, chunks: list[bytes]):
        """Tokenize, align and keep chunks that are not known."""
        a, b = (t.encode(chunks) for t in self.tok)
        whole = [all(b"".join(map(t.bytes_of.__getitem__, x)) == c for t, x in zip(self.tok, (p, q), strict=True)) for c, p, q in zip(chunks, a, b, strict=True)]
        a, b = ([x if ok else [] for x, ok in zip(y, whole, strict=True)] for y in (a, b))
        got = Aligned(a, b, *self.size)
        n = len(chunks)
        count = lambda of, w=None: np.bincount(of, w, n).astype(np.int64)
        link_of = got.a_of[np.repeat(np.arange(len(got.a)), np.diff(got.links.start))]
        row, column = np.repeat(got.a, np.diff(got.links.start)), got.b[got.links.columns]
        left, right = got.groups()
        last_a, last_b = (np.concatenate([g[1:] != g[:-1], [True]]) if len(g) else np.zeros(0, bool) for g in (got.a_group, got.b_group))
        shared = left.row_sizes_of_product(right)
        self.facts = np.concatenate([self.facts, np.stack([count(got.a_of), count(got.b_of), count(got.b_of[last_b]), count(link_of), count(got.a_of, shared), np.array(whole)], axis=1)])
        self.pairs = np.concatenate([self.pairs, row * self.base + column])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(count(link_of))])
        word = np.concatenate([got.a + len(self.tok[0].bytes_of) * last_a, got.b + 2 * len(self.tok[0].bytes_of) + self.base * last_b])
        by = np.lexsort((np.repeat([0, 1], [len(got.a), len(got.b)]), np.concatenate([got.a_group, got.b_group])))
        words = self.words[word[by]].tolist()
        ends = np.concatenate([[0], np.cumsum(count(got.a_of) + count(got.b_of))]).tolist()
        self.text += ["".join(words[x:y]) for x, y in zip(ends, ends[1:], strict=False)]
        for c in chunks:
            self.at[c] = len(self.at)
        self.held += sum(map(len, chunks)) * 4 + 16 * len(words)

    def documents(self, texts: list[str | None]) -> Iterator[tuple]:
        """(facts..., digest, packed pairs) of each text."""
        if self.held > CACHED:
            self.clear()
        cut_up = [_CHUNK.split(b" " + t.encode()) if t else [] for t in texts]
        new = list(dict.fromkeys(c for d in cut_up for c in d if c not in self.at))
        if new:
            self.learn(new)
        for chunks in cut_up:
            at = np.array([self.at[c] for c in chunks], np.int64)
            if not len(at) or not self.facts[at, -1].all():
                yield 0, 0, 0, 0, 0, "", np.zeros(0, np.int64)
                continue
            kind, times = np.unique(at, return_counts=True)
            n = self.first[kind + 1] - self.first[kind]
            pair = self.pairs[ragged(self.first[kind], n)]
            by = np.argsort(pair, kind="stable")
            pair, weight = pair[by], np.repeat(times, n)[by]
            start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            packed = (pair[start] << TIMES) | np.add.reduceat(weight, start)
            digest = hashlib.sha256("".join([self.text[i] for i in at])[:-1].encode()).hexdigest()
            yield *(times @ self.facts[kind, :-1]).tolist(), digest, packed


_FACTS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")
_ALIGNED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64())] + [(c, pa.int64()) for c in _FACTS] + [("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64()))])


def alignments(docs: DataFrame, folder: str = FILES) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, n_shared (links within groups), groups_sha256 and pairs of every text.

    ``pairs``: the distinct linked id pairs in order, each ``(a * |B| + b) << TIMES`` plus its number of links.
    """

    def run(batches):
        known = _Chunks(folder)
        for whole in batches:
            for batch in T.slices(whole, "text", 2 << 20):
                rows = list(known.documents(batch.column("text").to_pylist()))
                cols = list(zip(*rows, strict=True))
                sizes = np.concatenate([[0], np.cumsum([len(x) for x in cols[-1]])])
                pairs = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(cols[-1])))
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.string()), pairs], schema=_ALIGNED)

    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return d.mapInArrow(run, "row long, doc_id long, " + ", ".join(f"{c} long" for c in _FACTS) + ", groups_sha256 string, pairs array<long>")


def _exploded(aligned: DataFrame) -> DataFrame:
    d = aligned.select("row", F.explode("pairs").alias("packed"))
    return d.select("row", F.shiftrightunsigned("packed", TIMES).alias("pair"), F.col("packed").bitwiseAND(F.lit((1 << TIMES) - 1)).alias("times"))


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """pair, documents (that hold it linked) and best (no pair of the same A id has more)."""
    n = _exploded(aligned).groupBy("pair").agg(F.count(F.lit(1)).alias("documents")).withColumn("a", F.floor(F.col("pair") / width))
    n = cut(n)
    top = n.groupBy("a").agg(F.max("documents").alias("most"))
    return n.join(top, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def align_corpus(docs: DataFrame, folder: str = FILES, max_broadcast: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared of every row of ``docs`` (doc_id, text)."""
    aligned = table(alignments(docs, folder))
    counts = cut(pair_counts(aligned, len(tokenizers(folder)[1].bytes_of)))
    small = counts.count() <= max_broadcast
    d = _exploded(aligned).join(F.broadcast(counts) if small else counts, "pair")
    sums = d.groupBy("row").agg(F.sum(F.col("times") * F.col("documents")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    out = aligned.drop("pairs").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", "n_shared")


def op13_incidence_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
