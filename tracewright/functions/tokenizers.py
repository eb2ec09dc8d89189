"""Tokenizer files of three libraries, run in Arrow batches: ids and token strings that join to the text."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decode import by_bytes, by_ids, by_offsets

#: The word pattern of byte-level vocabularies given as ranks.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class FileTokenizer:
    """A tokenizer by its file: ``.json`` (tokenizers), ``.tiktoken`` (ranks) or ``.model`` (sentencepiece).

    Token strings come from the best source there is: offsets into the text, else the tokens' bytes, else ids decoded
    one by one. Strings of special tokens inside a text are ordinary text.
    """

    def __init__(self, path: str):
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(path)
            self._library.no_truncation()
            self._library.no_padding()
            self._library.encode_special_tokens = True
            self.encode = self._json
        elif path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
            self._library = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = self._ranks
        elif path.endswith(".model"):
            import sentencepiece

            self._library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = self._pieces
        else:
            raise ValueError(f"{path}: no tokenizer file (.json, .tiktoken or .model)")
        self._known: dict[int, str] = {}

    def _json(self, text: str) -> tuple[list[int], list[str]]:
        e = self._library.encode(text, add_special_tokens=False)
        pieces = by_offsets(text, e.offsets)
        return e.ids, by_ids(e.ids, lambda ids: self._library.decode(ids, skip_special_tokens=False), self._known) if pieces is None else pieces

    def _ranks(self, text: str) -> tuple[list[int], list[str]]:
        ids = self._library.encode_ordinary(text)
        return ids, by_bytes(self._library.decode_tokens_bytes(ids))

    def _pieces(self, text: str) -> tuple[list[int], list[str]]:
        ids = self._library.encode(text, num_threads=1)
        names = [(i, self._library.id_to_piece(i)) for i in ids]
        strings = by_bytes([bytes([int(n[3:5], 16)]) if self._library.is_byte(i) else n.replace("\u2581", " ").encode() for i, n in names])
        if strings and strings[0].startswith(" ") and not text.startswith(" "):  # the mark of a text's begin
            strings[0] = strings[0][1:]
        return ids, strings


@lru_cache(maxsize=4)
def resolve(path: str) -> FileTokenizer:
    return FileTokenizer(path)


def _run(path: str, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = resolve(path)
        for batch in batches:
            row, pos, ids, tokens = [], [], [], []

            def out() -> pa.RecordBatch:
                take = pa.array(row, pa.int64())
                return pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in keys), pa.array(pos, pa.int64()), pa.array(ids, pa.int64()), pa.array(tokens, pa.string())], [*keys, "pos", "id", "token"])

            for r, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    found, strings = tokenizer.encode(text)
                    row += [r] * len(found)
                    pos += range(len(found))
                    ids += found
                    tokens += strings
                if len(row) > 100_000:
                    yield out()
                    row, pos, ids, tokens = [], [], [], []
            if row:
                yield out()

    return run


def tokenize_file(texts: DataFrame, keys: list[str], path: str) -> DataFrame:
    """(keys, pos, id, token) of texts (keys, text) by the tokenizer file, which all hosts can read. Null and empty texts have none."""
    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    return texts.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(_run(path, keys), f"{kinds}, pos long, id long, token string")


def _run_lists(path: str, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = resolve(path)
        for batch in batches:
            texts, begin, ids, tokens, size = batch.column("text"), 0, [], [], 0
            for r in range(len(texts)):
                text = texts[r].as_py()
                found, strings = tokenizer.encode(text) if text else ([], [])
                ids.append(found)
                tokens.append(strings)
                size += len(found)
                if size > 100_000 or r == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(begin, len(ids)) for k in keys), pa.array(ids, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.string()))], [*keys, "ids", "list"])
                    begin, ids, tokens, size = r + 1, [], [], 0

    return run


def tokenize_lists(texts: DataFrame, keys: list[str], path: str) -> DataFrame:
    """(keys, ids, list): the same with one row a text, which keeps what belongs together in its row."""
    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    return texts.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(_run_lists(path, keys), f"{kinds}, ids array<bigint>, list array<string>")
