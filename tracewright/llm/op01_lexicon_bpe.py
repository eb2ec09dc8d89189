"""BPE encoding and decoding over a minimal acyclic transducer lexicon.

One pass counts the words of all documents; up to ``lexicon_size`` of the most frequent are merged once
on the driver and compiled into a minimal automaton with shared suffixes. Its arcs carry
outputs that add up to a word's number, and numbers address id lists. The automaton is one
file of arrays in the shared folder, shipped with ``addFile`` (a replacement executor fetches
it again) and memory-mapped by the workers. The second pass looks the distinct words of a
batch up in it, all words stepping through the arcs together; words it lacks are merged
exactly. The lexicon only saves work: ids don't depend on it.

The tokenizer file is one of a word-end BPE as the ``tokenizers`` library writes them; it is a
parameter, must be readable on all hosts, and is never copied.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import freed
from .scratch import Scratch, table

#: Most words in the lexicon, so the most that reach the driver; and steps of the counts' histogram per doubling.
LEXICON_SIZE = 65_536
STEPS = 16
CACHE_WORDS = 200_000
TEXT_CHUNK = 1 << 20
WORD_END = "</w>"
SHORT, NEVER = 48, 1 << 60
#: In these texts composition is settled and classes are the same in all versions of Unicode.
_UNUSUAL = re.compile("[^\x00-ɏ]")
_FAST = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return [chr(b) if b in keep else chr(256 + rest.index(b)) for b in range(256)]


class WordBpe:
    """Words, merges and token strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.letters = _byte_letters()
        #: left id and right id to rank and id of both together
        self._pair = {self.vocab[a] << 24 | self.vocab[b]: r << 24 | self.vocab[a + b] for r, (a, b) in enumerate(merges)}
        self._plain_ids = [self.vocab[c] for c in self.letters]
        self._end_ids = [self.vocab[c + WORD_END] for c in self.letters]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self._split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._back = {c: b for b, c in enumerate(self.letters)}

    @cached_property
    def _library(self):
        """Loaded by the first unusual text."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def words(self, text: str) -> list[str]:
        """The normalised words of a text; a special token is a word of its own, marked by a NUL before and after."""
        if self._split and "<|" in text:
            out: list[str] = []
            for i, part in enumerate(self._split.split(text)):
                out += [f"\0{part}\0"] if i % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not _UNUSUAL.search(text):
            return _FAST.findall(text.lower())
        pieces = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(self._back[c] for c in p).decode("utf-8") for p, _ in pieces]

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the lowest rank first, the leftmost of equals."""
        if word[0] == "\0" and word[1:-1] in self.special:
            return [self.special[word[1:-1]]]
        raw = word.encode("utf-8")
        ids = [self._plain_ids[b] for b in raw]
        ids[-1] = self._end_ids[raw[-1]]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        """A scan for the least rank at each step; ``index`` gives the leftmost."""
        get = self._pair.get
        ranks = [get(x << 24 | y, NEVER) for x, y in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != NEVER:
            i = ranks.index(low)
            ids[i] = low & 0xFFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 24 | ids[i], NEVER)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 24 | ids[i + 1], NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self._pair.get
        heap = [(m >> 24, i, m & 0xFFFFFF, x, y) for i, (x, y) in enumerate(zip(ids, ids[1:])) if (m := get(x << 24 | y)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, new, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (m := get(new << 24 | ids[after[j]])) is not None:
                    heapq.heappush(heap, (m >> 24, i, m & 0xFFFFFF, new, ids[after[j]]))
            if (k := before[i]) >= 0 and (m := get(ids[k] << 24 | new)) is not None:
                heapq.heappush(heap, (m >> 24, k, m & 0xFFFFFF, ids[k], new))
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray) -> str:
        """The file has no decoder, so tokens are joined by spaces, word ends and all."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def compile_lexicon(entries: Iterable[tuple[str, list[int]]]) -> bytes:
    """The minimal acyclic transducer of (word, ids), as one byte string of arrays."""
    entries = sorted((w.encode("utf-8"), ids) for w, ids in entries)
    register: dict[tuple, int] = {}
    arcs: list[tuple[tuple[int, int, int], ...]] = []  # of each state: (label, target, output)
    final: list[bool] = []
    words_below: list[int] = []
    # The path of the word before: per depth, whether a word ends there and the arcs closed so far.
    path: list[list] = [[False, []]]

    def close(depth: int, previous: bytes) -> None:
        while len(path) - 1 > depth:
            ends, out = path.pop()
            key = (ends, tuple(out))
            if key not in register:
                total, numbered = int(ends), []
                for label, target in out:
                    numbered.append((label, target, total))
                    total += words_below[target]
                register[key] = len(arcs)
                arcs.append(tuple(numbered))
                final.append(ends)
                words_below.append(total)
            path[-1][1].append((previous[len(path) - 1], register[key]))

    last = b""
    for word, _ in entries:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common, last)
        for _ in word[common:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0, last)
    ends, out = path[0]
    total, numbered = int(ends), []
    for label, target in out:
        numbered.append((label, target, total))
        total += words_below[target]
    root = len(arcs)
    arcs.append(tuple(numbered))
    final.append(ends)
    flat = [(s << 8 | label, target, add) for s, state in enumerate(arcs) for label, target, add in state]
    key, target, add = (np.array(c, np.int64) for c in (zip(*flat) if flat else ([], [], [])))
    ids = [np.asarray(i, np.uint32) for _, i in entries]
    first = np.cumsum([0, *map(len, ids)]).astype(np.int64)
    head = np.array([root, len(key), len(final), len(first)], np.int64)
    return b"".join(x.tobytes() for x in (head, key, target, add, first, np.array(final, np.int64), np.concatenate([np.zeros(0, np.uint32), *ids])))


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        self.root, n, states, firsts = (int(x) for x in raw[:32].view(np.int64))
        at = 32
        parts = []
        for size in (n, n, n, firsts, states):
            parts.append(raw[at : at + 8 * size].view(np.int64))
            at += 8 * size
        self.key, self.target, self.add, self.first, self.final = parts
        self.ids = raw[at:].view(np.uint32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where it is absent; all words step together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        state, number = np.full(len(words), self.root), np.zeros(len(words), np.int64)
        live = np.arange(len(words))
        depth = 0
        while len(live):
            over = size[live] == depth
            done = live[over]
            number[done[self.final[state[done]] == 0]] = -1
            live = live[~over]
            if not len(live) or not len(self.key):
                number[live] = -1
                break
            want = state[live] << 8 | text[begin[live] + depth]
            k = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[k] == want
            number[live[~hit]] = -1
            live, k = live[hit], k[hit]
            number[live] += self.add[k]
            state[live] = self.target[k]
            depth += 1
        return number


@lru_cache(maxsize=2)
def lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


class Encoder:
    """Encodes texts with a lexicon (or none); a bounded cache holds the words met."""

    def __init__(self, path: str, name: str | None):
        self.bpe = tokenizer(path)
        self.lexicon = lexicon(name) if name else None
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.bpe.words(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        new = [w for w in set().union(*split) if w not in cache] if split else []
        if self.lexicon is not None and new:
            lex, first, unseen = self.lexicon, self.lexicon.first, []
            for w, k in zip(new, lex.numbers([w.encode("utf-8") for w in new]).tolist()):
                if k < 0:
                    unseen.append(w)
                else:
                    cache[w] = lex.ids[first[k] : first[k + 1]].tobytes()
            new = unseen
        for w in new:
            cache[w] = np.asarray(self.bpe.merge(w), "<u4").tobytes()
        return [b"".join(map(cache.__getitem__, words)) for words in split]


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of about TEXT_CHUNK characters; null is empty."""
    first, texts, size = 0, [], 0
    for i in range(len(column)):
        texts.append(column[i].as_py() or "")
        size += len(texts[-1])
        if size >= TEXT_CHUNK or len(texts) >= 1000:
            yield first, texts
            first, texts, size = i + 1, [], 0
    if texts:
        yield first, texts


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = tokenizer(path), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for _, texts in _slices(batch.column("text")):
                for text in texts:
                    seen.update(bpe.words(text))
                if len(seen) > CACHE_WORDS:
                    yield flush()
        if seen:
            yield flush()

    return run


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON_SIZE) -> str | None:
    """Count all words, compile the most frequent, and ship the file; its name, None if there are no words.

    A histogram of the counts gives the least count of which at most ``size`` words have that or more; only these are
    collected, whatever the number of partitions.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexicon")
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(freed(_count(path)), "word string, n long")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n")).withColumn("step", F.floor(F.log2("n") * STEPS).cast("int"))
    counts = scratch.save(counts, "counts", free=True)
    total, least = 0, None
    for r in sorted(counts.groupBy("step").count().collect(), key=lambda r: -r.step):  # up to 64 * STEPS rows
        total += r["count"]
        if total > size:
            break
        least = r.step
    top = counts.where(F.col("step") >= least).select("word").collect() if least is not None else []
    scratch.close()
    if not top:
        return None
    bpe = tokenizer(path)
    data = compile_lexicon((r.word, bpe.merge(r.word)) for r in top)
    target = f"{scratch.root}.bin"
    where = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    for i in range(0, len(data), 1 << 20):
        out.write(bytearray(data[i : i + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(target)
    return target.rsplit("/", 1)[1]


def _encode(path: str, name: str | None, decoded: bool, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, name)
        for batch in batches:
            for first, texts in _slices(batch.column("bpe_text")):
                ids = encoder.encode(texts)
                part = batch.slice(first, len(texts))
                columns = [part.column(c) for c in keep] + [pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([encoder.bpe.decode(np.frombuffer(i, "<u4")) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*keep, "ids"] + ["decoded"] * decoded)

    return run


def _decode(path: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                text = [None if i is None else bpe.decode(np.frombuffer(i, "<u4")) for i in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(text, pa.string())], [*keep, "decoded"])

    return run


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False, lexicon_size: int = LEXICON_SIZE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) and, if asked, ``decoded``.

    Every whole text is encoded as the library does without added special tokens; a special
    token's string inside a text is that token. Null and empty texts have no ids and decode to
    an empty string. Rows may repeat; words of nearly equal counts are in the lexicon together or not at all; an empty table
    gives an empty result. ``keep`` names the columns to carry (doc_id by default); columns
    called ids or decoded cannot be carried.
    """
    path = path or default_path()
    keep = ["doc_id"] if keep is None else keep
    name = build_lexicon(docs, path, lexicon_size)
    texts = docs.select(*keep, F.col("text").cast("string").alias("bpe_text"))
    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.mapInArrow(freed(_encode(path, name, decoded, keep)), ", ".join(filter(None, [kinds, "ids binary"])) + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``decoded`` text of each ``ids``; null ids give null."""
    keep = ["doc_id"] if keep is None else keep
    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    return encoded.select(*keep, "ids").mapInArrow(_decode(path or default_path(), keep), f"{kinds}, decoded string")


def op1_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"), decoded=True)
    return out.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 AS bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
