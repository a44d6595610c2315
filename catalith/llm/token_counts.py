"""Token counts of a byte-level BPE by a whole-token shortcut.

Byte-level BPE splits a text into pre-tokens and encodes each alone, so a text's count is the sum over its
pre-tokens. A pre-token that is itself a vocabulary string which provably encodes to one token counts 1 without any
merging; only the rest are merged, once for each distinct string and worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from catalith.llm.common import arrow_texts

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Distinct merged pre-tokens that a worker remembers; then it starts anew.
REMEMBERED = 400_000
#: Pre-tokens above this many characters aren't remembered.
LONG = 64
#: The pre-token pattern of this vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def prove_whole_tokens(path: str) -> tuple[frozenset[str], object, list[str]]:
    """The vocabulary strings that are one pre-token and encode alone as one token; the tokenizer; its special strings."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    split = regex.compile(PRE_TOKEN)
    strings = [s for s in tok.decode_batch([[i] for i in range(tok.get_vocab_size())], skip_special_tokens=False) if s and "�" not in s and s not in special]
    strings = [s for s in strings if (m := split.fullmatch(s)) and split.match(s).end() == len(s) and m]
    ids = tok.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, ids, strict=True) if len(e.ids) == 1), tok, special


class Counter:
    """Token counts of whole texts."""

    def __init__(self, path: str):
        self.whole, self.tok, special = prove_whole_tokens(path)
        self.find = regex.compile(PRE_TOKEN).findall
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.known: dict[str, int] = dict.fromkeys(self.whole, 1)

    def merged(self, piece: str) -> int:
        n = len(self.tok.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONG:
            if len(self.known) > len(self.whole) + REMEMBERED:
                self.known = dict.fromkeys(self.whole, 1)
            self.known[piece] = n
        return n

    def plain(self, text: str) -> int:
        known, total, rest = self.known, 0, []
        for p in self.find(text):
            n = known.get(p)
            if n is None:
                rest.append(p)
            else:
                total += n
        return total + sum(self.known.get(p) or self.merged(p) for p in rest)

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row's whole text.

    One row for each input row, repeated rows and null doc_ids too; a null text is empty and has no token; other
    columns are ignored. Special strings inside a text count as one token each, as the library's default has it.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            raw = arrow_texts(b.column("text")).to_pylist()
            n = [c.count(x.decode("utf-8", "replace")) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(step, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document under the 50k byte-level vocabulary."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
