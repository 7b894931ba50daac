"""Operator 11 against brute force over all windows, and its edge cases."""

import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix_dedup as sd
from tessera.llm import suffixes as sx
from tessera.llm.common import Scratch

DOC = "doc_id long, text string"


def brute(texts, length):
    """Per text: the maximal removed runs, and the rest."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone].astype(int)))
        out.append((len(t), [tuple(e) for e in edges.reshape(-1, 2).tolist()], bytes(b for b, g in zip(t, gone[:-1], strict=True) if not g)))
    return out


def plain(out):
    return sorted((r["doc_id"], r["n_bytes"], [(x["start"], x["stop"]) for x in r["removed"]], bytes(r["kept"]), r["n_removed"]) for r in out.collect())


def corpus(draw, n):
    """Texts that share passages, lines and periods, with copies whole and near."""
    words = ["".join(draw.choices("abcdefé\n", k=draw.randint(1, 9))) for _ in range(300)]
    prose = lambda k: " ".join(draw.choices(words, k=k))
    shared = [prose(k) for k in (12, 25, 40, 90)]
    texts = [prose(draw.randint(1, 90)) for _ in range(n)]
    for i in range(0, n, 2):
        at = draw.randint(0, len(texts[i]))
        texts[i] = texts[i][:at] + draw.choice(shared) + texts[i][at:]
    texts += [texts[3], texts[3], texts[4][:-1], "x" + texts[4], texts[5] + texts[5]]
    texts += ["a" * 900, "b" + "a" * 350, "ab" * 400, "abc" * 70, "z" * 200, "z" * 199, "", None, "é" * 130, "é" * 99]
    return texts


@pytest.mark.parametrize("length,most", [(200, 1024), (200, 2), (32, 1024), (57, 1)])
def test_against_brute_force(spark, length, most):
    texts = corpus(random.Random(length), 60)
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(7)
    got = plain(sd.deduplicated(docs, length, most))
    assert got == [(i, n, spans, kept, n - len(kept)) for i, (n, spans, kept) in enumerate(brute(texts, length))]


def test_rows_are_documents_of_their_own(spark):
    passage = " ".join(map(str, range(100)))
    docs = spark.createDataFrame([(None, passage), (7, passage), (7, passage), (7, "short"), (None, None)], DOC).selectExpr("*", "1 AS uid", "2 AS body", "3 AS key", "4 AS starts", "5 AS kept", "6 AS segment")
    out = sd.deduplicated(docs).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], len(r["removed"])) for r in out) == [(-1, 0, 0, 0), (-1, len(passage), len(passage), 1), (7, 5, 0, 0), (7, len(passage), len(passage), 1), (7, len(passage), len(passage), 1)]
    assert sd.deduplicated(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sd.deduplicated(docs, 20)


def test_texts_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(sx, "BLOCK", 700)
    monkeypatch.setattr(sd, "SORTED", 900)
    texts = corpus(random.Random(4), 30)
    texts.append("".join(t or "" for t in texts))
    whole = sorted((i, n, spans) for i, (n, spans, _) in enumerate(brute(texts, 200)))
    cut = [s for t in [t.encode() for t in texts if t] for s in sx.blocks([t], 200)]
    assert max(len(text) for text, *_ in cut) < 700 + 200
    got = plain(sd.deduplicated(spark.createDataFrame(list(enumerate(texts)), DOC), 200))
    assert [g[:3] for g in got] == whole


def test_equal_windows_have_equal_keys_and_every_window_is_in_one_segment():
    draw = random.Random(8)
    texts = [t.encode() for t in corpus(draw, 40) if t]
    keys, owners = {}, Counter()
    for text, ends, who, offset in sx.blocks(texts, 200):
        for start, n, key, inner in zip(*sx.segments(text, ends, 200), strict=True):
            at = int(np.searchsorted(ends, start, "right"))
            strings = [bytes(text[p : p + 200]) for p in range(start, start + n)]
            assert inner or len(set(strings)) == n
            for i, s in enumerate(strings):
                assert keys.setdefault(s, key) == key
                owners[who[at], start - int(np.r_[0, ends][at]) + offset[at] + i] += 1
    assert owners == Counter({(i, p): 1 for i, t in enumerate(texts) for p in range(len(t) - 199)})


@pytest.mark.parametrize("length", [40, 200, 37])
def test_deep_shallow_sorting(length):
    draw = random.Random(length)
    for _ in range(40):
        letters = draw.choices(range(256), k=draw.choice([1, 2, 3, 200]))
        text, starts, groups = b"", [], []
        for g in range(draw.randint(1, 6)):
            base = bytearray(draw.choices(letters, k=draw.randint(length, 400)))
            for _ in range(draw.randint(0, 3)):
                copy = bytearray(base)
                if draw.random() < 0.7:
                    copy[draw.randrange(len(copy))] ^= draw.choice([1, 255])
                starts += range(len(text), len(text) + len(copy) - length + 1)
                groups += [g] * (len(copy) - length + 1)
                text += bytes(copy)
        order, equal = sx.deep_shallow(np.frombuffer(text, np.uint8), np.array(starts, np.int64), np.array(groups, np.int64), length)
        strings = [(groups[i], text[starts[i] : starts[i] + length]) for i in order]
        assert strings == sorted(strings) and len(set(order.tolist())) == len(starts)
        assert equal.tolist() == [i > 0 and s == strings[i - 1] for i, s in enumerate(strings)]


def test_no_segments_table_is_needed_twice(spark):
    scratch = Scratch(spark, "t")
    rows = sd.Rows(spark.createDataFrame([(1, "q" * 300)], DOC), scratch)
    assert "Exchange" not in sd.cut(rows.table, 200)._jdf.queryExecution().executedPlan().toString()
    rows.drop()
