"""Byte-pair tokenization by an automaton compiled from the merges.

The merges are compiled in order. The automaton over tokens starts with one
state in which any base symbol may follow any other. The merge gadget of
(a, b) -> c splits the state behind a: the arc for b is taken out of it, the
state behind c is a copy of the one behind b, and every state with an arc for a
gets an arc for c. States are then the tokens themselves (plus the start), and
a text's tokenization is the only path of arcs that spells it, because exactly
one tokenization of each prefix survives the gadgets. Copies are kept as
references to the copied row or column with the number of the gadget, so
compiling takes one step a merge; rows are resolved into the transition table
when they are first used, and kept.

Encoding walks each pre-split word once from left to right: the state behind
each position is a table entry, and the arcs out of it are found in a trie of
the token spellings. Decoding emits the arc labels.

Defined results: a null text counts as empty and gives no tokens; texts of any
length are read whole; repeated rows each give a row; an empty table gives an
empty result; only named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import HELD, lean, send
#: Distinct words whose tokens a worker keeps (twice as many where it keeps no
#: labels); the table is emptied when it is full.
CACHE_WORDS = 450_000
#: Unicode white space, as the pre-tokenizer's pattern has it.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def char_class(prop: str, top: int) -> str:
    """Ranges of the characters up to ``top`` that have a Unicode property."""
    every = "".join(chr(c) for c in range(top + 1) if not 0xD800 <= c < 0xE000)
    return "".join(f"\\U{ord(m[0]):08x}-\\U{ord(m[-1]):08x}" for m in regex.findall(rf"\p{{{prop}}}+", every))


def word_pattern(top: int) -> re.Pattern:
    """The pre-tokenizer's pattern for texts whose characters go up to
    ``top``; the classes of short ranges are much faster."""
    letter, number = char_class("L", top), char_class("N", top)
    return re.compile(f"[{letter}]+|[{number}]|'s|'t|'re|'ve|'m|'ll|'d|[^{SPACES}{letter}{number}]+")


class Automaton:
    """The compiled merges. ``left``, ``right`` and ``made`` give each token's
    parts and the number of its gadget (0 for base symbols)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str = "</w>"):
        self.word_end = word_end
        self.labels = {i: t for t, i in vocab.items()}
        self.size = max(vocab.values(), default=-1) + 1
        symbols = byte_symbols()
        self.left, self.right = [-1] * self.size, [-1] * self.size
        self.made = [0] * self.size
        self.removed: dict[int, int] = {}  # arc a * size + b: the gadget that took it out
        spell: dict[int, tuple] = {}
        for b, s in enumerate(symbols):
            if s in vocab:
                spell[vocab[s]] = (b,)
            if word_end and s + word_end in vocab:
                spell[vocab[s + word_end]] = (b + 256,)
        for number, (a, b) in enumerate(merges, 1):
            self.gadget(vocab[a], vocab[b], vocab[a + b], number, spell)
        #: Arcs by spelling: tokens inside a word and tokens that end one.
        self.inner = {bytes(path): t for t, path in spell.items() if path[-1] < 256}
        self.final = {bytes((*path[:-1], path[-1] - 256)): t for t, path in spell.items() if path[-1] >= 256}
        if not word_end:
            self.final = self.inner
        self.longest, self.longest_end = (max(map(len, arcs), default=0) for arcs in (self.inner, self.final))
        self.table: dict[int, bool] = {}

    def gadget(self, a: int, b: int, c: int, number: int, spell: dict) -> None:
        """Take arc b out of the state behind a; copy the row of b and the
        column of a for c."""
        self.removed.setdefault(a * self.size + b, number)
        self.left[c], self.right[c], self.made[c] = a, b, number
        spell[c] = spell[a] + spell[b]

    def follows(self, x: int, y: int) -> bool:
        """Has the state behind token x an arc for token y? The row or column
        copy that made the arc is followed back to the base symbols; a gadget
        up to the moment of the copy may have taken it out."""
        key = x * self.size + y
        known = self.table.get(key)
        if known is not None:
            return known
        left, right, made, removed, size = self.left, self.right, self.made, self.removed, self.size
        now = 1 << 60  # gadgets numbered up to here have been applied
        found = True
        while True:
            if removed.get(x * size + y, 1 << 61) <= now:
                found = False
                break
            at_x, at_y = made[x], made[y]
            if at_x == 0 and at_y == 0:
                break
            if at_x > at_y:  # the row of x was copied from its right part, before the arc went
                x, now = right[x], at_x - 1
            elif at_y > at_x:  # the column of y was copied from its left part, after the arc went
                y, now = left[y], at_y
            else:  # x is y: the new row, then the new column
                x, y, now = right[x], left[y], at_x - 1
        self.table[key] = found
        return found

    def walk(self, word: bytes) -> list[int]:
        """Tokens of one pre-split word: the path of arcs that spells it,
        longest arcs first. A place has one state only, so a place that leads
        nowhere is never entered again."""
        n = len(word)
        whole = self.final.get(word)
        if whole is not None:
            return [whole]
        inner, final, table, size, follows, longest = self.inner, self.final, self.table, self.size, self.follows, self.longest
        out: list[int] = []
        ends: list[int] = []  # place behind each token taken
        dead: set[int] = set()
        at, reach = 0, n  # the next arc ends at `reach` or before
        while at < n:
            key = out[-1] * size if out else -1
            k = n if reach == n and n - at <= self.longest_end else min(reach, at + longest)
            found = -1
            if k == n:
                token = final.get(word[at:])
                if token is not None and (key < 0 or (table[key + token] if key + token in table else follows(out[-1], token))):
                    found = token
                else:
                    k = min(n - 1, at + longest)
            if found < 0:
                while k > at:
                    token = inner.get(word[at:k])
                    if token is not None and k not in dead and (key < 0 or (table[key + token] if key + token in table else follows(out[-1], token))):
                        found = token
                        break
                    k -= 1
            if found >= 0:
                out.append(found)
                ends.append(k)
                at, reach = k, n
            else:  # back to the place before, and on with a shorter arc
                dead.add(at)
                out.pop()
                ends.pop()
                reach = at - 1
                at = ends[-1] if ends else 0
        return out


class Table(dict):
    """Ids by word; a word that is asked for the first time is learnt."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word):
        return self.tokenizer.learn(word)


class Tokenizer:
    """A tokenizer file of the ``word_bpe`` kind: NFC, lower case, words cut by
    a pattern, byte-level symbols with a word-end mark."""

    def __init__(self, spec: str, keep_labels: bool = True):
        self.keep_labels = keep_labels
        made = json.loads(spec)
        model = made["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in made.get("added_tokens", ())}
        for text, i in self.special.items():
            self.automaton.labels[i] = text
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.patterns = [word_pattern(top) for top in (0xFF, 0xFFFF, sys.maxunicode)]
        self.labels: dict[str, bytes] = {}
        self.ids = Table(self)

    @classmethod
    def load(cls, path: str, keep_labels: bool = True) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            return cls(f.read(), keep_labels)

    def words(self, text: str) -> list[str]:
        """Normalised pre-split words; special tokens stand for themselves."""
        if self.split is None or not any(s in text for s in self.special):
            return self._words(text)
        out = []
        for i, piece in enumerate(self.split.split(text)):
            out += [piece] if i % 2 else self._words(piece)
        return out

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # no final sigma: each character is lowered by itself
                text = text.replace("Σ", "σ")
        text = text.lower()
        pattern = self.patterns[0]
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pattern = self.patterns[1 + (ASTRAL.search(text) is not None)]
        return pattern.findall(text)

    def learn(self, word: str) -> bytes:
        """A new word's tokens, into the tables."""
        tokens = [self.special[word]] if word in self.special else self.automaton.walk(word.encode("utf-8", errors="surrogatepass"))
        label = self.automaton.labels
        if self.keep_labels:
            self.labels[word] = " ".join([label[t] for t in tokens]).encode("utf-8")
        ids = self.ids[word] = b"".join([t.to_bytes(4, "little") for t in tokens])
        return ids

    def encode(self, text: str | None) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        self._room()
        return b"".join([*map(self.ids.__getitem__, self.words(text or ""))])

    def encode_and_decode(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids, and the labels that they emit (the decoded text, UTF-8)."""
        self._room()
        words = self.words(text or "")
        ids = b"".join([*map(self.ids.__getitem__, words)])
        return ids, b" ".join([*map(self.labels.__getitem__, words)])

    def _room(self) -> None:
        if len(self.ids) > CACHE_WORDS * (1 if self.keep_labels else 2):
            self.ids.clear()
            self.labels.clear()

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.automaton.labels[i] for i in ids)


def shared_tokenizer(spec, keep_labels: bool = True) -> Tokenizer:
    """The tokenizer of a broadcast file, compiled once in each worker and
    kept while the worker's tasks tokenize."""
    key = hash(spec.value), keep_labels
    if HELD.get("tokenizer", (None,))[0] != key:
        HELD["tokenizer"] = key, Tokenizer(spec.value, keep_labels)
    return HELD["tokenizer"][1]


def broadcast_spec(spark, path: str):
    """The tokenizer file's text (a few MB, whatever the corpus) for all workers."""
    with open(path, encoding="utf-8") as f:
        return send(spark, f.read())


def _encode(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared_tokenizer(spec)
        for b in lean(batches, keep="tokenizer"):
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                n, a, d = [], [], []
                for text in part.column(1):
                    ids, labels = tok.encode_and_decode(text.as_py())
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    d.append(hashlib.sha256(labels).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _tokens(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        tok = shared_tokenizer(spec)
        for b in lean(batches, keep="tokenizer"):
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                pairs = [tok.encode_and_decode(x.as_py()) for x in part.column(1)]
                ids = [np.frombuffer(p[0], dtype="<u4").astype(np.int32) for p in pairs]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([p[1].decode() for p in pairs], pa.string())],
                                                 names=["doc_id", "ids", "decoded"])
    return run


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every whole text."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_tokens(broadcast_spec(docs.sparkSession, tokenizer_path)), f"doc_id {kind}, ids array<int>, decoded string")


def token_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of tokens and digests of ids and decoded text of every document."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_encode(broadcast_spec(docs.sparkSession, tokenizer_path)), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe_automaton(spark, sf_dir):
    """Contract query: tokens of every document."""
    import public_tokenizers

    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
