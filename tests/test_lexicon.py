"""The persisted index against SQLite's full-text engine, and what it reads."""

import os
import random
import re
import sqlite3
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import stem
from tessera.operators import lexicon
from tessera.sources import views as V

pick = random.Random(11)
WORDS = "connect connected connection relational Relations happily happy running runs café cafe Übermut über naïve 2024 v12 x straße analogies analogy possibly the and of to in is a".split()


def engine(rows):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(content, scope_path, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no full-text search")
    con.executemany("INSERT INTO t(rowid, content, scope_path) VALUES (?, ?, ?)", rows)
    return con


def test_scores_are_those_of_a_full_text_engine(spark, tmp_path):
    rows = [(i, " ".join(pick.choices(WORDS, k=pick.randint(0, 40))), pick.choice(["src/happy", "docs", "a_b"])) for i in range(300)]
    con = engine(rows)
    index = lexicon.build(spark.createDataFrame(rows, "id long, content string, scope_path string"), ("content", "scope_path"), str(tmp_path))
    for query in (["connection"], ["happiness", "relation"], ["cafés", "ubermut"], ["running", "the", "of"], ["v12", "2024"], ["absent"], ["analog", "src"]):
        want = dict(con.execute("SELECT rowid, -bm25(t) FROM t WHERE t MATCH ?", (" OR ".join(f'"{w}"' for w in query),)).fetchall())
        got = dict(index.scores(query).collect())
        assert set(got) == set(want)
        for i, v in want.items():
            assert got[i] == pytest.approx(v, rel=1e-6, abs=1e-9)


def test_rows_without_words_and_empty_tables(spark, tmp_path):
    schema = "id long, content string"
    index = lexicon.build(spark.createDataFrame([(1, None), (2, ""), (3, "one word"), (3, "one word")], schema), ("content",), f"{tmp_path}/a")
    assert dict(index.scores(["words"]).collect()).keys() == {3}
    assert lexicon.build(spark.createDataFrame([], schema), ("content",), f"{tmp_path}/b").scores(["word"]).count() == 0


def test_a_search_reads_its_terms_only(spark, tmp_path):
    rows = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 30))) for i in range(200)], "id long, content string")
    index = lexicon.build(rows, ("content",), str(tmp_path))
    plan = index.postings(["w7"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)
    files = index.postings(["w7"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len(files) == 1 and "bucket=" in files[0]["f"] and len(os.listdir(f"{tmp_path}/postings")) > 20


def test_an_index_is_made_once_and_again_when_its_table_changes(spark, tmp_path):
    made = []

    def rows():
        made.append(1)
        return spark.read.parquet(f"{tmp_path}/t").select("id", "content")

    write = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id long, content string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/t")
    write(["alpha", "beta"])
    for _ in range(2):
        index = lexicon.kept(spark, "test", [f"{tmp_path}/t"], rows, ("content",))
        assert {r.id for r in index.scores(["beta"]).collect()} == {1}
    assert len(made) == 1
    write(["beta", "beta", "gamma"])
    index = lexicon.kept(spark, "test", [f"{tmp_path}/t"], rows, ("content",))
    assert {r.id for r in index.scores(["beta"]).collect()} == {0, 1} and len(made) == 2


def test_snippets(spark):
    long = " ".join(f"w{i}" for i in range(50)) + " the Connections broke " + " ".join(f"v{i}" for i in range(50))
    rows = spark.createDataFrame([(1, long), (2, "connected, at last"), (3, None), (4, "nothing here")], "id long, content string")
    got = dict(rows.select("id", lexicon.snippet(F.col("content"), ["connection"], 5)).collect())
    assert got == {1: "...w49 the <mark>Connections</mark> broke v0...", 2: "<mark>connected</mark>, at last", 3: None, 4: "nothing here"}


@pytest.mark.parametrize("most", [4, 9, 32])
def test_snippets_are_those_of_a_full_text_engine(spark, most):
    draw = random.Random(most)
    seps = [" "] * 12 + [". ", ": ", ", ", ".\n", " - ", ".", "  ", "; "]
    rows = [(i, "".join(draw.choice(WORDS) + draw.choice(seps) for _ in range(draw.choice([0, 3, 9, 40, 90]))), "") for i in range(250)]
    rows += [(900, ". leading mark connection. And relations happily: running on " * 9, ""), (901, "  two spaces first. connection " * 8, "")]
    con = engine(rows)
    for query in (["connection"], ["relations", "happily", "cafe"], ["the", "of", "and", "running", "über"], ["v12", "straße"]):
        match = " OR ".join(f'"{w}"' for w in query)
        want = dict(con.execute(f"SELECT rowid, snippet(t, 0, '<mark>', '</mark>', '...', {most}) FROM t WHERE t MATCH ?", (match,)).fetchall())
        df = spark.createDataFrame(rows, "id long, content string, scope_path string").select("id", lexicon.snippet(F.col("content"), query, most).alias("s"))
        got = dict(df.collect())
        assert len(want) > 5 and {i: got[i] for i in want} == want


def test_searches_of_the_catalogue_read_no_texts(spark):
    d = "/root/testdata/sf0.001"
    from tessera.operators import search

    plan = search.lexical(V.memories(spark, d), V.memory_index(spark, d), ["thation"])._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan


def test_stems_of_long_lists_are_held_a_piece_at_a_time():
    """Words of a batch don't become Python's all at once, and pieces leave no seam."""
    said = [f"{pick.choice('abeiort')}{w}ing" for w in range(500)]
    lists = [pick.choices(said, k=pick.randint(0, 120)) for _ in range(3000)] + [None, [], said * 20]
    batch = pa.array(lists, pa.list_(pa.string()))
    for most in (64, 20_000, 10**9):
        assert stem.in_pieces(batch, most, False).to_pylist() == [None if ws is None else [stem.stem(w) for w in ws] for ws in lists]
        tallied = stem.in_pieces(batch, most, True).to_pylist()
        assert [sorted((t["term"], t["tf"]) for t in row) for row in tallied] == [sorted(Counter(map(stem.stem, ws or ())).items()) for ws in lists]
    del tallied
    tracemalloc.start()
    stem.in_pieces(batch, 20_000, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * 10**6  # some 190,000 words; as lists of words and dictionaries of Python they took 34 MB
