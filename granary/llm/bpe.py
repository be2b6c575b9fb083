"""BPE encoding and decoding through a table of distinct words.

A text is split at ASCII white space.  The tokenizer's normaliser and pre-tokenizer treat each such word by itself
(white space ends its pieces, and it composes with nothing), and its special tokens hold no white space, so a text's
ids are its words' ids one after another.  Each distinct word is encoded once in a task and kept with its ids and its
pieces in a table of bounded size; ids go back to the words' positions, and pieces are looked up by id for decoding.
"""

from __future__ import annotations

import hashlib
import os
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most distinct words that a task's table holds; it is emptied beyond that, which costs encoding anew and loses nothing.
TABLE_WORDS = 100_000
#: The same where a task has its worker's memory to itself and not, as in the pipeline, what earlier stages left.
ALONE_WORDS = 600_000
#: Words of more bytes are encoded where they stand and not kept.
LONG_WORD = 200


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTable:
    """Distinct words with their ids (little-endian 32-bit) and their decoded pieces."""

    def __init__(self, path: str, limit: int = TABLE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces = {i: p.encode() for p, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.limit, self.known = limit, {}
        special = self.tokenizer.get_added_tokens_decoder()
        plain = [i for i, t in special.items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        #: A special token is cut out before anything else is done to a text, so words around it are encoded by themselves.
        self.mark, self.mark_text = (plain[0], special[plain[0]].content) if plain else (None, "")
        self.specials = [t.content.encode() for t in special.values()]

    def _entries(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids' bytes, pieces' bytes) of each word: many words make one text, with marks between."""
        if self.mark is None or any(x in w for x in self.specials for w in words):
            texts = [[w] for w in words]
        else:
            texts = [words[at : at + 500] for at in range(0, len(words), 500)]
        out = []
        found = self.tokenizer.encode_batch_fast([self.mark_text.join([w.decode() for w in t]) for t in texts], add_special_tokens=False)
        for t, e in zip(texts, found):
            ids = e.ids
            raw, pieces = array("I", ids).tobytes(), [self.pieces[i] for i in ids]
            cuts = [i for i, x in enumerate(ids) if x == self.mark] if len(t) > 1 else []
            for a, b in zip([0, *[i + 1 for i in cuts]], [*cuts, len(ids)]):
                out.append((raw[4 * a : 4 * b], b" ".join(pieces[a:b])))
        return out

    def _learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.known and len(w) <= LONG_WORD]
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = [w for w in words if len(w) <= LONG_WORD]
        odd = [w for w in new if any(x in w for x in self.specials)]
        if odd:
            self.known.update(zip(odd, self._entries(odd)))
            new = [w for w in new if w not in self.known]
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            self.known.update(zip(part, self._entries(part)))

    def texts(self, texts: list[bytes | None]):
        """(ids' bytes, decoded text's bytes) of each text."""
        for at in range(0, len(texts), 500):
            split = [(t or b"").split() for t in texts[at : at + 500]]
            self._learn(set().union(*split))
            known = self.known
            for words in split:
                try:
                    entries = [known[w] for w in words]
                except KeyError:  # long words are not in the table
                    entries = [known[w] if len(w) <= LONG_WORD else self._entries([w])[0] for w in words]
                yield b"".join([e[0] for e in entries]), b" ".join([e[1] for e in entries if e[0]])


def _over(docs: DataFrame, path: str | None, schema: str, row, words: int = TABLE_WORDS) -> DataFrame:
    path = path or default_path()

    def run(batches):
        table = WordTable(path, words)
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            parts = (b.column(1).slice(at, 500).to_pylist() for at in range(0, b.num_rows, 500))
            cols = list(zip(*[row(i, d) for part in parts for i, d in table.texts(part)])) or [()] * (len(names) - 1)
            kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
            out = [pa.array(c, kinds[k.split()[1]]) for c, k in zip(cols, schema.split(", ")[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), *out], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids``: the token ids of each whole text, as the tokenizer gives them without special tokens added.

    A null text counts as an empty one, which has no ids; repeated rows get equal rows; an empty table gives none; a
    null doc_id stays null; other columns are not read.
    """

    def row(ids, _):
        a = array("I")
        a.frombytes(ids)
        return (a.tolist(),)

    return _over(docs, path, "doc_id long, ids array<int>", row)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``: ids joined to their pieces; null or empty ids give an empty text."""
    path = path or default_path()

    def run(batches):
        table = WordTable(path)
        for b in batches:
            texts = [b" ".join([table.pieces[i] for i in ids.as_py() or ()]).decode() for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, words: int = TABLE_WORDS) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each whole text, encoded and decoded in one pass
    with a table of at most so many words.

    Nulls, repeats, empty tables and other columns as in ``encode``.
    """

    def row(ids, decoded):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _over(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row, words)
