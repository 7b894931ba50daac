"""Packing by power-of-two decomposition (operator 10).

A document's ids (and the end id) are cut into pieces whose lengths are powers
of two: as many pieces of the longest length as fit, then the binary digits of
the rest, longest first.  Each piece is a sequence of its own, so no sequence
crosses documents and none is padded; sequences of one length form a bucket, and
``write_buckets`` lays them out so that batches of equal lengths are drawn from one
folder.  Packing itself is one narrow pass: nothing is shuffled.

Defined cases: a null text is an empty text and gives one piece, the end id
alone; repeated rows give their own pieces and sequences; a null doc_id is kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import sys
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table

MAX_TOKENS = 4096
END_ID = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
#: Sequence ids are (partition << SEQUENCE_BITS) + counter.
SEQUENCE_BITS = 40
#: Words up to this length are remembered, and at most so many of them.
CACHE_CHARS, CACHE_WORDS = 64, 350_000
#: Marks that may follow the letters of a word and are a token run of their own.
TAIL = ".,!?;:$%&*#|)"
#: White space by which str.split cuts but Unicode's White_Space property does not.
ODD_SPACE = "\x1c\x1d\x1e\x1f"


def power_of_two_lengths(n: int, longest: int = MAX_TOKENS) -> Iterator[int]:
    """The lengths of the pieces of ``n`` ids, longest first."""
    for _ in range(n // longest):
        yield longest
    n %= longest
    for bit in range(longest.bit_length() - 1, -1, -1):
        if n >> bit & 1:
            yield 1 << bit


#: Letters up to U+024F but for the dotted capital I, whose lower case is two characters.
PLAIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch


def bytes_as_chars() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def remember(cache: dict, key: str, value: bytes) -> None:
    """Adds to a cache; a full one first loses its younger half, as frequent words come early."""
    if len(cache) >= CACHE_WORDS:
        for k in list(cache)[CACHE_WORDS // 2 :]:
            del cache[k]
    cache[key] = value


@functools.cache  # a worker keeps what it has learnt for its next tasks
def word_encoder(path: str) -> Callable[[str], bytes]:
    """text -> little-endian 32-bit ids, as the tokenizer file gives them for the whole text.

    The vocabulary's pre-tokenizer drops white space and never joins what it
    separates, so ids of a text are those of its words in turn; each distinct
    word is encoded once per worker.
    """
    from array import array

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()

    def packed(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder != "little":
            out.byteswap()
        return out.tobytes()

    def whole(text: str) -> bytes:
        return packed(tok.encode(text, add_special_tokens=False).ids)

    model, byte_chars = tok.model, bytes_as_chars()

    def letters(stem: str) -> bytes:
        """Ids of a run of plain letters: what the whole pipeline makes of it, by the merges alone."""
        low = stem.lower()
        if not low.isascii():
            low = "".join(map(byte_chars.__getitem__, low.encode()))
        return packed([t.id for t in model.tokenize(low)])

    # what the short ways below rest on, tried on every plain letter: merges alone give a run's
    # ids, marks after letters are a run of their own, white space separates
    plain = [c for c in map(chr, range(0x41, 0x250)) if PLAIN(c)]
    runs = [*plain, *map("".join, zip(plain, plain[1:], strict=False)), "Word", "thonre", "École", "über", "ñandú", "straße"]
    trusted = all(letters(s) == whole(s) and whole(f"{s}.") == whole(s) + whole(".") for s in runs)
    apart = all(whole(f"{s} {s}!\n\t{s}") == whole(s) * 2 + whole("!") + whole(s) for s in ("a", "Word", "École", "1st"))

    class Stems(dict):
        def __missing__(self, stem: str) -> bytes:
            ids = letters(stem) if PLAIN(stem) else whole(stem)
            remember(self, stem, ids)
            return ids

    stems = Stems()

    class Words(dict):
        def __missing__(self, word: str) -> bytes:
            if len(word) > CACHE_CHARS:
                return whole(word)
            stem = word.rstrip(TAIL)
            if trusted and PLAIN(stem):  # letters and what follows them are apart for the pre-tokenizer
                tail = word[len(stem) :]
                ids = stems[stem.lower() if stem.isascii() else stem] + (stems[tail] if tail else b"")
            else:
                ids = whole(word)
            remember(self, word, ids)
            return ids

    words = Words()

    def encode(text: str) -> bytes:
        if not apart or any(c in text for c in ODD_SPACE):
            return whole(text)
        if text.isascii() and "<|" not in text:  # no special token can come of it
            text = text.lower()
        return b"".join(map(words.__getitem__, text.split()))

    return encode


def pack(docs: DataFrame, tokenizer: str, longest: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents (doc_id, text): SCHEMA.  ``tokenizer``: a tokenizers JSON file."""
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = word_encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << SEQUENCE_BITS
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text) + end if isinstance(text, str) else end
                n, start = len(ids) // 4, 0
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                view = memoryview(ids)
                for length in power_of_two_lengths(n, longest):
                    crc = zlib.crc32(view[4 * start : 4 * (start + length)])
                    rows.append((doc_id, start, length, crc, n, sequence, 0, length.bit_length() - 1))
                    start += length
                    sequence += 1
                if len(rows) >= 50_000:
                    yield frame(rows, names)
                    rows = []
        if rows:
            yield frame(rows, names)
        release()

    def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, SCHEMA)


def write_buckets(pieces: DataFrame, path: str, files: int = 64) -> None:
    """Pieces written by bucket, so that batches of one length are read from one folder; a bucket spreads over ``files`` tasks."""
    salt = F.pmod(F.xxhash64("sequence_id"), F.lit(files))
    pieces.repartition("bucket", salt).write.partitionBy("bucket").parquet(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op10_packing": op10_packing}
SQL: dict[str, str] = {}
