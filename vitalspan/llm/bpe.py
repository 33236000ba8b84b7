"""BPE encoding and decoding with a tokenization automaton.

The merges of a tokenizer file are compiled into a deterministic automaton whose arcs are labelled with tokens. It
starts as one state with a loop for every base symbol. Each merge (u, v) in turn adds its gadget: a new state after
w = uv that takes over the arcs of the state after v; the arc v of the state after u goes; and wherever u could be read,
so can w. The state reached depends on the last label only, so a row of the table says which labels may follow a label.

Done merge by merge, each gadget would touch a whole row and a whole column. The same table comes row by row: the row of
w = uv is that of v as it was when w came, and labels w' = u'v' that came later may follow it where u' could at their
time. Rows that are equal in the end are one state, and columns that are equal one class of labels, so the compiled
table has a bit for each state and class (11,500 by 13,700 for a vocabulary of 49,408: 20 MB). A second table, the tree
of the labels' bytes, tells which labels begin at a place.

A word of the pre-tokenizer is encoded by running the automaton over it: each prefix has one last label only, found by
table look-ups; the labels of the path are the tokens. Decoding emits the arc labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.common import give_back, is_word_level, pieces

#: Bytes that a worker may take to remember the tokens of words; beyond that it starts anew. About 100 go to an entry itself.
CACHED_BYTES, ENTRY_BYTES = 192 << 20, 180


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable, else one above 255."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Table:
    """The compiled automaton. Labels are numbered in the order in which they came.

    follows: a row of bits for each state, a bit for each class of labels; state: the state after each label (-1: a label that
    ends the word, or one that no path has); kind: each label's class; label: (bytes, ends a word, token id) of each."""

    follows: np.ndarray
    state: np.ndarray
    kind: np.ndarray
    label: list[tuple[bytes, bool, int]]


def compiled(vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> Table:
    """The table of the automaton. A label that two merges make isn't supported."""
    plain = {c: b for b, c in byte_symbols().items()}
    names = [c + end for c in plain for end in ("", suffix) if c + end in vocab]
    base = len(names)
    number = {t: i for i, t in enumerate(names)}
    left, right = [-1] * base, [-1] * base
    rules: dict[int, dict[int, int]] = {}  # label -> what may not follow it any more -> since when
    for u, v in merges:
        w = len(names)
        if u + v in number:
            raise ValueError(f"two merges make {u + v!r}")
        names.append(u + v)
        number[u + v] = w
        left.append(number[u])
        right.append(number[v])
        rules.setdefault(number[u], {})[number[v]] = w
    size, first = len(names), np.array(left)
    ends = np.array([t.endswith(suffix) for t in names])
    depth = np.zeros(size, int)
    for w in range(base, size):
        depth[w] = depth[left[w]] + 1
    # Columns stand by depth of the left spine, then by number, so a label stands after its left part and levels are slices.
    order = np.argsort(depth, kind="stable")
    place = np.argsort(order)
    head = place[first[order]]
    edge = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
    levels = [(int(s), int(e), order[s:e]) for s, e in zip(edge, edge[1:], strict=False)]
    by_left = np.argsort(first, kind="stable")
    begin = np.searchsorted(first[by_left], np.arange(size + 1))  # labels whose left part is b, in order: by_left[begin[b] : begin[b + 1]]
    at_birth: dict[int, np.ndarray] = {}  # rows as taken over, before the label's own rules
    alive, state = np.ones(size, bool), np.full(size, -1)
    rows: list[np.ndarray] = []
    states: dict[bytes, int] = {}
    for a in range(size):
        u, v = left[a], right[a]
        if a >= base:  # a label whose parts never stand side by side at its time is on no path: its text is spelt otherwise
            at = int(place[v])
            alive[a] = alive[u] and alive[v] and bool(at_birth[u][at >> 3] >> (7 - (at & 7)) & 1)
        if ends[a] or not alive[a]:
            continue
        row, may, own = np.zeros(size, bool), np.ones(size, bool), rules.get(a, {})
        if a < base:
            row[:base] = True
        else:
            inherited = np.unpackbits(at_birth[v], count=size)
            for b, time in rules.get(v, {}).items():  # the row of v when a came
                if time < a:
                    inherited[place[b]] = 0
        for b, time in own.items():  # labels that came later don't follow a if their left part, at their time, does no more
            starts = by_left[begin[b] : begin[b + 1]]
            may[place[starts[np.searchsorted(starts, time) :]]] = False
        for i, (s, e, numbers) in enumerate(levels):
            older = s + int(np.searchsorted(numbers, a))
            later = older
            if a >= base:
                row[s:older] = inherited[s:older]
                if i == depth[a]:
                    row[older], later = inherited[place[u]], older + 1
            if i:
                row[later:e] = row[head[later:e]] & may[later:e]
        at_birth[a] = np.packbits(row)
        row[[place[b] for b in own]] = False
        key = hashlib.blake2b(row.tobytes(), digest_size=16).digest()
        if key not in states:
            states[key] = len(rows)
            rows.append(np.packbits(row))
        state[a] = states[key]
    # Equal columns, told apart by 128 bits made from 64 rows at a time.
    marks = np.zeros((2, size), np.uint64)
    for i in range(0, len(rows), 64):
        some = np.zeros((64, size), np.uint8)
        some[: len(rows[i : i + 64])] = np.unpackbits(np.stack(rows[i : i + 64]), axis=1, count=size)
        bits = np.ascontiguousarray(np.packbits(some, axis=0).T).view(np.uint64).reshape(-1)
        for mark, by in zip(marks, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), strict=True):
            mark ^= bits
            mark *= np.uint64(by)
            mark ^= mark >> np.uint64(29)
    _, sample, kind = np.unique(marks.T, axis=0, return_index=True, return_inverse=True)
    follows = np.stack([np.packbits(np.unpackbits(r, count=size)[sample]) for r in rows]) if rows else np.zeros((0, 0), np.uint8)
    spelt = [(bytes(plain[c] for c in (t[: -len(suffix)] if e else t)), bool(e), vocab[t] if ok else -1) for t, e, ok in zip(names, ends, alive, strict=True)]
    return Table(follows, state, kind.reshape(-1)[place], spelt)


class Automaton:
    """Runs a compiled table. Tokens are ids; texts are bytes."""

    def __init__(self, table: Table):
        self.table = table
        self.rows = [r.tobytes() for r in table.follows]
        self.after = [self.rows[s] if s >= 0 else b"" for s in table.state]
        self.place = [(k >> 3, 128 >> (k & 7)) for k in table.kind.tolist()]
        self.ids = [i for _, _, i in table.label]
        # The tree of the labels' bytes: (node, byte) -> node; the label within a word and the one that ends it at each node.
        self.tree: dict[int, int] = {}
        self.inner, self.final = [-1], [-1]
        for n, (spelt, ends, i) in enumerate(table.label):
            if i < 0:
                continue
            node = 0
            for b in spelt:
                after = self.tree.get(node << 8 | b)
                if after is None:
                    after = self.tree[node << 8 | b] = len(self.inner)
                    self.inner.append(-1)
                    self.final.append(-1)
                node = after
            (self.final if ends else self.inner)[node] = n

    def encode(self, word: bytes) -> list[int]:
        """The labels of the only path that spells the word."""
        n, tree, place = len(word), self.tree, self.place
        last, come = [-1] * (n + 1), [0] * (n + 1)
        for j in range(n):
            if j and last[j] < 0:
                continue
            row, node = self.after[last[j]] if j else None, 0
            for i in range(j, n):
                node = tree.get(node << 8 | word[i])
                if node is None:
                    break
                label = self.inner[node] if i + 1 < n else self.final[node]
                if label >= 0:
                    if row is not None:
                        at, bit = place[label]
                        if not row[at] & bit:
                            continue
                    last[i + 1], come[i + 1] = label, j
        if n and last[n] < 0:
            raise ValueError(f"the vocabulary has no symbols for {word!r}")
        path = []
        while n > 0:
            path.append(self.ids[last[n]])
            n = come[n]
        return path[::-1]


class Known(dict):
    """What words were found to be; a new one is looked into once. Begins anew when it takes more than `limit` bytes."""

    def __init__(self, find, limit: int = CACHED_BYTES):
        super().__init__()
        self.find, self.limit, self.taken = find, limit, 0

    def __missing__(self, word: str):
        found = self.find(word)
        self.taken += 2 * len(word) + len(found) + ENTRY_BYTES
        if self.taken > self.limit:
            self.clear()
            self.taken = 2 * len(word) + len(found) + ENTRY_BYTES
        if self.taken <= self.limit:
            self[word] = found
        return found


class Words:
    """The normaliser, added tokens and pre-tokenizer of word-level byte BPE files: texts to words."""

    WORD = regex.compile(r"[\p{L}]+|[\p{N}]|'(?:s|t|re|ve|m|ll|d)|[^\s\p{L}\p{N}]+")
    #: The same in the faster module, for texts without characters on which its classes differ (`_learn`).
    FAST = re.compile(r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\s\w]|[_\x1c-\x1f])+")

    def __init__(self, source: str):
        self.source, spec = source, json.loads(source)
        if not is_word_level(spec):
            raise ValueError("this tokenizer's normaliser or pre-tokenizer isn't that of lower-casing word-level files")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.seen: set[str] = set()
        self.odd: set[str] = set()
        self.unlike: set[str] = set()
        from tokenizers import Regex, pre_tokenizers
        from tokenizers import Tokenizer as Library

        self.normaliser = Library.from_str(source).normalizer
        self.splitter = pre_tokenizers.Split(Regex(self.pattern), behavior="removed", invert=True)

    @staticmethod
    def normal(text: str) -> str:
        """Composed and lower-cased character by character; white space only parts words."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def _learn(self, new: set[str]) -> None:
        """Characters on which the faster module's classes differ, and those that texts leave to the library: marks and
        Hangul letters, which order and composition depend on, and all that it treats otherwise than Python's tables."""
        self.seen |= new
        for c in new:
            kind, n = unicodedata.category(c), self.normal(c)
            if kind[0] == "M" or kind == "Cn" or "\u1100" <= c <= "\u11ff" or any(unicodedata.combining(x) for x in n):
                self.odd.add(c)
            elif any(self.WORD.findall(self.normal(x)) != self._library_words(x) for x in (c, f"a{c}a", f"!{c}!", f"1{c}1")):
                self.odd.add(c)
            elif any(self.WORD.findall(self.normal(x)) != self.FAST.findall(self.normal(x)) for x in (c, f"a{c}a", f"!{c}!", f"1{c}1", f"{c}{c}", f"'{c}")):
                self.unlike.add(c)

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.FAST.findall(text.lower())
        here = set(text)
        new = here - self.seen
        if new:
            self._learn({c for c in new if c > "\x7f"})
        if not self.odd.isdisjoint(here):
            return self._library_words(text)
        return (self.FAST if self.unlike.isdisjoint(here) else self.WORD).findall(self.normal(text))

    def _library_words(self, text: str) -> list[str]:
        """The library's own normaliser and splitter."""
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normaliser.normalize_str(text))]

    def words(self, text: str) -> list[str]:
        """Words in order; added tokens are words of their own, in the case they have."""
        if self.split is None or "<" not in text:
            return self._words(text)
        out: list[str] = []
        for i, part in enumerate(self.split.split(text)):
            out += [part] if i % 2 else self._words(part)
        return out


class Tokenizer(Words):
    """Words around the automaton."""

    def __init__(self, source: str, table: Table | None = None):
        super().__init__(source)
        vocab = json.loads(source)["model"]["vocab"]
        self.automaton = Automaton(table or table_of(source))
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.labels = {str(i): t for i, t in self.names.items()}
        self.known = Known(self.ids_text)

    def ids_of(self, word: str) -> list[int]:
        if word in self.added:
            return [self.added[word]]
        return self.automaton.encode(word.encode())

    def ids_text(self, word: str) -> str:
        return " ".join(map(str, self.ids_of(word)))

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(text) for i in self.ids_of(w)]

    def decode(self, ids: list[int]) -> str:
        """The arc labels, joined as a tokenizer without a decoder joins them."""
        return " ".join(self.names[i] for i in ids if i in self.names)

    def digest(self, text: str) -> tuple[int, str, str]:
        """How many ids, the ids in decimals, and the labels decoded from them, both joined by spaces."""
        ids = " ".join(map(self.known.__getitem__, self.words(text)))
        each = ids.split(" ") if ids else []
        return len(each), ids, " ".join(map(self.labels.__getitem__, each))


_TABLES: dict[str, Table] = {}
_MADE: dict[str, Tokenizer] = {}


def _key(source: str) -> str:
    return hashlib.sha256(source.encode()).hexdigest()


def table_of(source: str) -> Table:
    """The compiled table of a tokenizer file; a process keeps the last one."""
    key = _key(source)
    if key not in _TABLES:
        model = json.loads(source)["model"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ", 1)) for m in model["merges"]]
        table = compiled(model["vocab"], merges, model["end_of_word_suffix"])
        _TABLES.clear()
        _TABLES[key] = table
        give_back()
    return _TABLES[key]


def tokenizer(source: str, table: Table | None = None) -> Tokenizer:
    """One for each worker and file."""
    key = _key(source)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Tokenizer(source, table)
    return _MADE[key]


def _sent(spark, path: str):
    """The file and its table, compiled once by the driver and sent to the workers: their size is that of a vocabulary."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    return spark.sparkContext.broadcast((source, table_of(source)))


def _mapped(docs: DataFrame, path: str, doc: str, text: str, schema: str, make) -> DataFrame:
    """make(tokenizer, texts) gives the columns after doc."""
    sent = _sent(docs.sparkSession, path)
    rows = docs.select(doc, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    fields = f"`{doc}` {dict(docs.dtypes)[doc]}, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(*sent.value)
        names = [doc, *[x.split()[0] for x in schema.split(", ")]]
        yield from pieces(batches, lambda b: pa.RecordBatch.from_arrays([b.column(0), *make(t, b.column(1))], names=names))

    return rows.mapInArrow(run, fields)


def bpe_encode(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc and ids (array<int>) of every row. Null and empty texts have no ids; texts of any length are encoded whole;
    rows are independent of each other, so repeated rows and null ids are kept as they are; other columns are ignored."""
    return _mapped(docs, path, doc, text, "ids array<int>", lambda t, texts: [pa.array([t.encode(x.as_py()) for x in texts], pa.list_(pa.int32()))])


def bpe_decode(encoded: DataFrame, path: str, doc: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc and text (arc labels) of every row; null ids count as none."""
    sent = _sent(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(*sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], names=[doc, "text"])

    return encoded.select(doc, ids).mapInArrow(run, f"`{doc}` {dict(encoded.dtypes)[doc]}, text string")


def bpe_digest(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 of every row, in one pass and without a shuffle."""

    def make(t: Tokenizer, texts: pa.Array) -> list[pa.Array]:
        n, a, b = [], [], []
        for x in texts:
            count, ids, labels = t.digest(x.as_py())
            n.append(count)
            a.append(hashlib.sha256(ids.encode()).hexdigest())
            b.append(hashlib.sha256(labels.encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return _mapped(docs, path, doc, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
