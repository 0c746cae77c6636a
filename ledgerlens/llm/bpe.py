"""BPE encoding and decoding by backtracking over longest token matches.

The encoder walks a word from the left. An Aho-Corasick automaton over the vocabulary gives the longest token at
each place; a pair may stand only if merging its joined text would give that same pair, which a descent through the
merge tree decides (results are kept in a compatibility table). On a conflict the encoder takes the next shorter
token or steps back; places found to be dead ends are marked, so each is tried once and a word takes linear time.
The result is exactly that of applying the merges in rank order. Decoding gathers token bytes by an offset table.

Free style (Arrow batches in Python): the work is per row, without any shuffle; memory is bounded by one batch and
a bounded table of words seen.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, unused

END = "\ue000"
WORDS_KEPT = 150_000
PAIRS_KEPT = 200_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordBpe:
    """A byte-level BPE with word ends, read from a tokenizers file; encodes and decodes like that library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.special = spec["model"], {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.suffix = model["end_of_word_suffix"]
        vocab = model["vocab"]
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names[i] for i in range(max(names) + 1)]
        self.split_by_special = regex.compile("(" + "|".join(regex.escape(x) for x in self.special) + ")")
        pattern = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.words_of = regex.compile(pattern).findall
        self.symbols = str.maketrans({b: s for b, s in enumerate(byte_symbols())})

        merged = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        if any(later[2] <= earlier[2] for earlier, later in zip(merged, merged[1:], strict=False)):
            raise ValueError("token ids must rise with the rank of their merges")
        self.join = {(a, b): c for a, b, c in merged}
        n = len(self.names)
        self.left, self.right = list(range(n)), list(range(n))
        for a, b, c in merged:
            self.left[c], self.right[c] = a, b
        spelled = {t.removesuffix(self.suffix) + END if t.endswith(self.suffix) and t != self.suffix else t: i for t, i in vocab.items()}
        self.size = {i: len(t) for t, i in spelled.items()}
        self.matches = ahocorasick.Automaton()
        for t, i in spelled.items():
            self.matches.add_word(t, i)
        self.matches.make_automaton()
        self.shorter = {i: next((spelled[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in spelled), -1) for t, i in spelled.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.seen: dict[str, tuple[int, ...]] = {}

        blob = [f"{t} ".encode() for t in self.names]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in blob])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(blob), np.uint8)

    def stands(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens ``a`` and ``b`` side by side: no merge across their border would come first."""
        key = (a, b)
        if (known := self.compatible.get(key)) is None:
            if len(self.compatible) > PAIRS_KEPT:
                self.compatible.clear()
            known = self.compatible[key] = self._stands(a, b)
        return known

    def _stands(self, a: int, b: int) -> bool:
        bound = len(self.names) + 1
        while True:
            if (c := self.join.get((a, b))) is not None and c < bound:
                return False
            if a > b:
                bound, a = a, self.right[a]
                if a == bound:
                    bound, b = b + 1, self.left[b]
                    if b + 1 == bound:
                        return True
            else:
                bound, b = b + 1, self.left[b]
                if b + 1 == bound:
                    bound, a = a, self.right[a]
                    if a == bound:
                        return True

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one word, given as byte symbols and END."""
        n = len(word)
        longest = [-1] * (n + 1)
        for end, token in self.matches.iter(word):
            start = end + 1 - self.size[token]
            if longest[start] < 0 or self.size[token] > self.size[longest[start]]:
                longest[start] = token
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while token >= 0:
            last = out[-1] if out else -1
            while True:
                to = at + self.size[token]
                if not dead[to] and (last < 0 or self.stands(last, token)):
                    out.append(token)
                    at = to
                    token = longest[at] if at < n else -1
                    if token < 0 and at < n:
                        dead[at] = 1
                        token = out.pop()
                        at -= self.size[token]
                        last = out[-1] if out else -1
                        token = self.shorter[token]
                        if token >= 0:
                            continue
                    else:
                        break
                else:
                    token = self.shorter[token]
                    if token >= 0:
                        continue
                dead[at] = 1
                if not out:
                    raise ValueError("no tokens spell this word")
                token = out.pop()
                at -= self.size[token]
                last = out[-1] if out else -1
                token = self.shorter[token]
                while token < 0:
                    dead[at] = 1
                    if not out:
                        raise ValueError("no tokens spell this word")
                    token = out.pop()
                    at -= self.size[token]
                    last = out[-1] if out else -1
                    token = self.shorter[token]
        return tuple(out)

    def word(self, word: str) -> tuple[int, ...]:
        if (known := self.seen.get(word)) is None:
            if len(self.seen) >= WORDS_KEPT:
                self.seen.clear()
            known = self.merge(word.encode().decode("latin-1").translate(self.symbols) + END)
            if len(word) < 64:
                self.seen[word] = known
        return known

    def encode(self, text: str) -> np.ndarray:
        ids: list[int] = []
        for part in self.split_by_special.split(text) if "<|" in text else (text,):
            if (one := self.special.get(part)) is not None:
                ids.append(one)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            seen = self.seen
            for w in self.words_of(part.lower()):
                ids.extend(seen.get(w) or self.word(w))
        return np.array(ids, dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens joined by spaces, as the library gives it for a file without a decoder."""
        if not len(ids):
            return b""
        start = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - start
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        return self.blob[place][:-1].tobytes()


_READ: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One per worker process."""
    if path not in _READ:
        _READ[path] = WordBpe(path)
    return _READ[path]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add ``ids`` (array of long) for the whole text of every row; null counts as empty, an empty text has no ids.

    ``vocabulary`` is the path of the tokenizers file on every executor. An input column named ``ids`` is replaced.
    """

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def ids_of(texts):
        t = tokenizer(vocabulary)
        return texts.map(lambda x: t.encode(x or "").astype(np.int64))

    arrow_batches(docs.sparkSession)
    return docs.withColumn(ids, ids_of(F.col(text).cast("string")))


def decode(docs: DataFrame, vocabulary: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, the decoded ``ids`` of every row; null counts as no ids."""

    @F.pandas_udf(T.StringType())
    def text_of(rows):
        t = tokenizer(vocabulary)
        return rows.map(lambda x: t.decode(np.array([] if x is None else x, dtype="<u4")).decode())

    arrow_batches(docs.sparkSession)
    return docs.withColumn(text, text_of(F.col(ids)))


DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digests(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, ids: str | None = None) -> DataFrame:
    """Encode and decode in one pass; give counts and digests and, only if named, the ids (array of int).

    ``keep`` are the columns to carry (default: all but the text); those with the names of the results give way.
    Null and empty texts have no tokens; repeated rows each get theirs.
    """
    arrow_batches(docs.sparkSession)
    results = [*DIGESTS.names, *([ids] if ids else [])]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in results and (keep is not None or c != text)]
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        for batch in batches:
            n, first, second, every = [], [], [], [np.zeros(0, np.int32)]
            for x in batch.column(len(keep)):
                found = t.encode(x.as_py() or "")
                n.append(len(found))
                first.append(hashlib.sha256(found.tobytes()).hexdigest())
                second.append(hashlib.sha256(t.decode(found)).hexdigest())
                if ids:
                    every.append(found.astype(np.int32))
            made = [pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            if ids:
                made.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate(every))))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + made, names=[*keep, *DIGESTS.names, *([ids] if ids else [])])

    chosen = docs.select(*keep, F.col(text).cast("string").alias(unused(keep)))
    more = [T.StructField(ids, T.ArrayType(T.IntegerType()))] if ids else []
    return chosen.mapInArrow(run, T.StructType([*fields, *DIGESTS.fields, *more]))
