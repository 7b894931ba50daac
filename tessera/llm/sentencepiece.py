r"""SentencePiece encoding and decoding (operator 2).

An Aho-Corasick automaton over the vocabulary's pieces reads a text once; at
each position the output links give the pieces that end there, longest first, and
relax the best score of a segmentation up to that position (Viterbi).  Characters
that no piece covers become byte pieces, or the unknown piece where the
vocabulary has none.

The best segmentation is that of the pieces' scores, as for a unigram model.  No
piece holds a word mark behind another character (checked when the vocabulary is
read), so a segmentation never crosses the start of a word and each distinct word
is segmented once per worker; scores are summed in double precision.

Defined cases: a null text is an empty one and gives no ids; repeated rows are
encoded each; a null doc_id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
#: Added to the lowest score for a character without a piece.
UNKNOWN_PENALTY = 10.0
CACHE_CHARS, CACHE_WORDS = 64, 600_000
#: Rows and characters of an output batch.
BATCH_ROWS, BATCH_CHARS = 4_000, 16_000_000


class Vocabulary:
    """Pieces of a model file and the automaton over them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.bytes_of: list[bytes] = []  # what each id decodes to
        self.byte_ids: dict[int, int] = {}
        normal: dict[str, tuple[float, int]] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[value := int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i):
                self.bytes_of.append(b"")
            elif sp.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                if not sp.is_unused(i):
                    normal[piece] = (sp.get_score(i), i)
        self.lowest = min((s for s, _ in normal.values()), default=0.0) - UNKNOWN_PENALTY
        self.alphabet = set().union(*map(set, normal)) if normal else set()
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece crosses the start of a word")
        self.normalise = None if sp.normalize("a  ½ﬁ\tb ") == f"{MARK}a{MARK}{MARK}½ﬁ\tb{MARK}" else sp.normalize
        self._build(normal)

    def _build(self, normal: dict[str, tuple[float, int]]) -> None:
        """goto, failure and output links; at a node the piece that ends there: length, score, id."""
        self.goto: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, float, int] | None] = [None]
        for piece, (score, i) in normal.items():
            at = 0
            for c in piece:
                nxt = self.goto[at].get(c)
                if nxt is None:
                    nxt = self.goto[at][c] = len(self.goto)
                    self.goto.append({})
                    self.ends.append(None)
                at = nxt
            self.ends[at] = (len(piece), score, i)
        self.fail = [0] * len(self.goto)
        self.chain: list[tuple[tuple[int, float, int], ...]] = [()] * len(self.goto)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            # the output link: what ends here, then what ends at the longest suffix that is a node
            own = (self.ends[at],) if self.ends[at] else ()
            self.chain[at] = own + (self.chain[self.fail[at]] if at else ())
            for c, nxt in self.goto[at].items():
                back = self.fail[at]
                while back and c not in self.goto[back]:
                    back = self.fail[back]
                self.fail[nxt] = self.goto[back].get(c, 0) if at else 0
                queue.append(nxt)

    def segment(self, text: str) -> array:
        """Ids of a marked text: one pass with the automaton."""
        goto, fail, chain = self.goto, self.fail, self.chain
        best, came = [0.0], [None]
        state = 0
        for end, c in enumerate(text, 1):
            while state and c not in goto[state]:
                state = fail[state]
            state = goto[state].get(c, 0)
            top, via, single = None, None, False
            for length, score, i in chain[state]:
                score += best[end - length]
                single |= length == 1
                if top is None or score > top:
                    top, via = score, (length, i)
            if not single:
                score = best[end - 1] + self.lowest
                if top is None or score > top:
                    top, via = score, (1, self.unknown)
            best.append(top)
            came.append(via)
        out: list[int] = []
        at = len(text)
        while at:
            length, i = came[at]
            if i == self.unknown and self.byte_ids:
                out.extend(self.byte_ids[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass")))
            else:
                out.append(i)
            at -= length
        out.reverse()
        return array("i", out)


@functools.cache
def codec(path: str) -> tuple:
    """(encode: text -> array of ids, decode: ids -> text) of a model file; words are remembered per worker."""
    vocabulary = Vocabulary(path)
    parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    class Words(dict):
        def __init__(self, lead: str):
            self.lead = lead

        def __missing__(self, word: str) -> bytes:
            ids = vocabulary.segment(self.lead + word).tobytes()
            if len(word) <= CACHE_CHARS:
                if len(self) >= CACHE_WORDS:
                    self.clear()
                self[word] = ids
            return ids

    marked, plain = Words(MARK), Words("")
    simple = vocabulary.normalise is None and "\n" not in vocabulary.alphabet
    line_end = vocabulary.segment("\n").tobytes() if simple else b""

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if vocabulary.normalise or not simple or "  " in text or MARK in text:
            whole = vocabulary.normalise(text) if vocabulary.normalise else MARK + text.replace(" ", MARK)
            return b"".join(map(plain.__getitem__, parts.findall(whole)))
        out: list[bytes] = []
        for n, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if n:  # a new line has no mark in front
                out.append(line_end)
                out.append(plain[words[0]] if words[0] else b"")
                del words[0]
            out.extend(map(marked.__getitem__, words))
        return b"".join(out)

    pieces = vocabulary.bytes_of

    def decode(ids: list[int]) -> str:
        text = b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    return encode, decode


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array<int>), round_trip (the ids decode to the text) of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = codec(model)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            first, ids, offsets, same, chars = 0, [], [0], [], 0
            for n in range(len(texts)):
                text = texts[n].as_py() or ""
                ids.append(data := encode(text))
                offsets.append(offsets[-1] + len(data) // 4)
                same.append(decode(array("i", data).tolist()) == text)
                chars += len(text)
                if chars >= BATCH_CHARS or n - first + 1 >= BATCH_ROWS or n == len(texts) - 1:
                    values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(ids))])
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(first, n - first + 1), lists, pa.array(same)], ["doc_id", "ids", "round_trip"])
                    first, ids, offsets, same, chars = n + 1, [], [0], [], 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of encoded documents (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decode = codec(model)
        for batch in batches:
            texts = [decode(x) if x is not None else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), default_model()).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
SQL: dict[str, str] = {}
