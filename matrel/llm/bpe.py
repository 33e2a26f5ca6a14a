"""BPE encoding and decoding by an automaton over tokens.

The automaton starts with one state and a loop for every symbol. Each merge (u, v) -> w, in
order, adds its gadget: the state p behind u is copied without its arc v, arcs labelled u are
led to the copy, and wherever u may be read, w may be read too, leading to where v led from p.
All arcs of one label lead to the same state, so a state is named by a label, and it differs
from the state it was copied from by the arcs its gadgets took away. What is compiled is
therefore, per label, its two parts and the rank of its merge, and one table of removed arcs,
(label, label) -> rank. An arc x leaves the state behind t unless a gadget removed x, or a
label that x was built from before x existed, from that state or from one it was copied from
before the copy was made.

The accepted label sequences are exactly the BPE tokenizations, one for each word. The whole
transition table, states by labels, would have as many entries as there are pairs of tokens, so
the row of a state is kept as its difference from the row it was copied from, and the entries
that words ask for are kept expanded. Encoding steps through that table, one state for each
position of the word, without taking a step back; decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrel.llm.common import Memo, batches_of
from matrel.llm.tokens import LATIN_END, byte_alphabet

END_OF_WORD = "</w>"
_END = "\n"            # the end mark inside spelled words; no byte's stand-in is a line break
_NEVER = 1 << 40


class MergeAutomaton:
    """Arcs between labels (token ids), compiled from ordered merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.bits = max(vocab.values()).bit_length()
        size = max(vocab.values()) + 1
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [_NEVER] * size
        self.removed: dict[int, int] = {}
        products = {a + b for a, b in merges}
        made = {i for token, i in vocab.items() if token not in products}      # the symbols to begin with
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in made or u not in made or v not in made or not self._open(u, v, rank):
                continue                      # the arc is gone: this merge can never apply
            made.add(w)
            self.left[w], self.right[w], self.rank[w] = u, v, rank
            self.removed[u << self.bits | v] = rank
        self.spelled = {token.replace(END_OF_WORD, _END): i for token, i in vocab.items() if i in made}
        for token in list(self.spelled):      # beginnings that are no labels themselves
            for n in range(1, len(token)):
                self.spelled.setdefault(token[:n], -1)
        self.arcs = Memo(lambda key: self._open(key >> self.bits, key & (1 << self.bits) - 1), 1_000_000)

    def _open(self, t: int, x: int, now: int = _NEVER) -> bool:
        """Whether the arc x leaves the state behind t once the gadgets before rank ``now`` are in."""
        removed, left, right, rank, bits = self.removed, self.left, self.right, self.rank, self.bits
        copied = now
        while t >= 0:
            a, built, base = x, now, t << bits
            while a >= 0:
                r = removed.get(base | a)
                # a label doubled by its own gadget may not precede its double, hence <= built
                if r is not None and r < copied and r <= built:
                    return False
                built, a = rank[a], left[a]
            copied, t = rank[t], right[t]
        return True

    def path(self, word: str) -> list[int]:
        """Labels of the accepted path that spells the word (its end mark included).

        The positions are passed once, from left to right. Every beginning of a word is a word
        itself and has one tokenization, so one arc at most reaches each position: its label is
        the state there, and the table tells which labels leave it. Nothing is taken back, and
        the walk ends with the arc that reaches the end.
        """
        spelled, arcs, bits, size = self.spelled.get, self.arcs, self.bits, len(word)
        state, begin = [-1] * (size + 1), [0] * (size + 1)
        at = 0
        while size and state[size] < 0:
            base = state[at] << bits
            for end in range(at + 1, size + 1):
                label = spelled(word[at:end])
                if label is None:
                    break
                if label >= 0 and state[end] < 0 and (not at or arcs[base | label]):
                    state[end], begin[end] = label, at
            at += 1
            while at < size and state[at] < 0:
                at += 1
            if at == size and state[size] < 0:
                raise ValueError("the word has a symbol outside the vocabulary")
        out = []
        while size:
            out.append(state[size])
            size = begin[size]
        return out[::-1]


class WordTokenizer:
    """Texts to ids and back for vocabularies with word ends: lower case, white space dropped."""

    #: The word pattern that belongs to the vocabulary (fixed value).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.automaton = MergeAutomaton(model["vocab"], [tuple(m) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.words = regex.compile(self.PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.alphabet = byte_alphabet()
        self.word_ids = Memo(self._word)
        self.chunks = _Chunks(self._chunk)

    def _word(self, word: str) -> list[int]:
        return self.automaton.path("".join(map(self.alphabet.__getitem__, word.encode())) + _END)

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [i for word in self.words(text) for i in self.word_ids[word]]

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return [i for part in self.cut(text) for i in ([self.special[part]] if part in self.special else self._plain(part))]
        return self._plain(text)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        if chunk.isascii() and chunk.isalpha() and chunk.islower():
            ids = self.automaton.path(chunk + _END)       # a word as it stands
        else:
            ids = self._plain(chunk)
        return len(ids), "".join(f" {i}" for i in ids), " " + self.decode(ids) if ids else ""

    def rendered(self, text: str) -> tuple[int, str, str]:
        """Number of ids, decimal ids joined by spaces, decoded text."""
        if any(s in text for s in self.special):
            ids = self.encode(text)
            return len(ids), " ".join(map(str, ids)), self.decode(ids)
        # no word spans a space, so what lies between spaces is encoded and decoded by itself, once
        parts = list(map(self.chunks.__getitem__, text.split(" ")))
        counts, ids, labels = zip(*parts)
        self.chunks.trim()
        self.word_ids.trim()
        self.automaton.arcs.trim()
        return sum(counts), "".join(ids)[1:], "".join(labels)[1:]


class _Chunks(Memo):
    """Rendered chunks; capital letters and one mark behind a word go back to the word's own entry."""

    MARKS = frozenset(".,;:!?|")

    def __missing__(self, chunk: str) -> tuple[int, str, str]:
        if chunk and max(chunk) < LATIN_END:
            if chunk[-1] in self.MARKS and chunk[:-1].isalpha():
                (n, ids, labels), (m, more, mark) = self[chunk[:-1]], self[chunk[-1]]
                return n + m, ids + more, labels + mark
            if chunk.isascii() and chunk.isalpha() and not chunk.islower():
                return self[chunk.lower()]
        return super().__missing__(chunk)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, kept with its memos for the later tasks of the same worker."""
    return WordTokenizer(path)


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def _by_row(docs: DataFrame, columns: list[str], schema: str, row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = row()
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                rows = [work(*values) for values in zip(*batches_of(batch, *columns[1:]))]
                yield pa.RecordBatch.from_arrays([batch.column(0)] + [
                    pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = [f.split() for f in schema.split(", ")]
    names, types = ["doc_id"] + [f[0] for f in fields], [arrow[f[1]] for f in fields]
    return docs.select(*columns).mapInArrow(run, f"doc_id {kind}, {schema}")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids``: the token ids of each text; null counts as empty, an empty text has none."""
    path = path or default_path()
    docs = docs.withColumn("text", F.col("text").cast("string"))
    return _by_row(docs, ["doc_id", "text"], "ids array<int>", lambda: lambda text: (tokenizer(path).encode(text or ""),))


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``: the labels of the ids, joined by spaces; null ids give an empty text."""
    path = path or default_path()
    return _by_row(encoded, ["doc_id", "ids"], "text string", lambda: lambda ids: (tokenizer(path).decode(ids or []),))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each document, in one pass.

    Null text counts as empty and has no tokens. Repeated rows are encoded one by one, other
    columns are ignored, and an empty table gives an empty result.
    """
    path = path or default_path()

    def work():
        rendered = tokenizer(path).rendered

        def one(text):
            n, ids, decoded = rendered(text or "")
            return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

        return one

    docs = docs.withColumn("text", F.col("text").cast("string"))
    return _by_row(docs, ["doc_id", "text"], "n_tokens long, ids_sha256 string, decoded_sha256 string", work)
