"""Token counts: Arrow functions encode batches balanced by bytes and give back lengths only.

A text is cut before a run of blanks that follows another character. Where no piece of the
vocabulary holds a blank after another character, no merge crosses such a cut, so the parts
have the tokens of the whole text; the vocabulary is searched for such pieces when a worker
loads it. Equal parts are encoded once per worker and memory span.

Nulls count as empty; an empty text has no tokens; repeated rows are counted each; an empty
table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, by_bytes

#: What sentencepiece writes for a blank; in a text it counts as one.
BLANK = "▁"
_RUNS = re.compile(r" +[^ ]*")


def parts_of(text: str) -> list[str]:
    """The parts between safe cuts, each without its first blank; the last one is empty where a lone blank ends the text."""
    text = text.replace(BLANK, " ")
    if not text:
        return []
    if text[0] != " " and "  " not in text:
        return text.split(" ")
    return [part[1:] for part in _RUNS.findall(" " + text)]


class PieceEncoder:
    """Ids or lengths of parts by a sentencepiece model, remembered up to ``memo_chars`` characters."""

    def __init__(self, path: str, memo_chars: int = 8_000_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in pieces) and self.model.encode("a b") == self.model.encode("a") + self.model.encode("b")
        self.blank = self.model.encode("x ")[len(self.model.encode("x")) :]
        self.memo: dict[str, list[int] | int] = {}
        self.held, self.most = 0, memo_chars

    def learn(self, parts: set[str], shape: Callable) -> None:
        """Encode the parts not yet known in one call."""
        if self.held > self.most:
            self.memo, self.held = {}, 0
        new = [p for p in parts if p not in self.memo]
        ids = [i if p or not self.cuts else self.blank for p, i in zip(new, self.model.encode(new, num_threads=1), strict=True)]
        self.memo.update(zip(new, map(shape, ids), strict=True))
        self.held += sum(map(len, new))

    def cut(self, texts: list[str]) -> list[list[str]]:
        return [parts_of(t) if self.cuts else [t] for t in texts]

    def lengths(self, texts: list[str]) -> list[int]:
        cut = self.cut(texts)
        self.learn(set().union(*cut), len)
        known = self.memo.__getitem__
        return [sum(map(known, parts)) for parts in cut]


class JsonEncoder:
    """Lengths by a tokenizers file; whole texts, as its pre-tokenizer may look across blanks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch(texts, add_special_tokens=False)]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 2_000_000) -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit for every row; ``model`` is a .model or .json file on every worker."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or (PieceEncoder(model) if model.endswith(".model") else JsonEncoder(model))
            texts = [t or "" for t in batch.column(2).to_pylist()]
            counts: list[int] = []
            for start, end in by_bytes(texts, batch_chars):
                counts += encoder.lengths(texts[start:end])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    schema = rows.select("id", "n_bytes", F.lit(0).cast("long").alias("n_tokens")).schema
    counted = rows.mapInArrow(run, schema)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
