"""Operators on small fixtures, with expected values worked out by hand."""

import datetime as dt
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import language, score, text
from tessera.operators import conflicts, context, curate, evidence, lexicon, lifecycle, records, search, sessions
from tessera.sources import io

def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def one(spark, *columns, **values):
    return spark.createDataFrame([values]).select(*columns).first() if values else spark.range(1).select(*columns).first()


def test_decay_and_effective_score(spark):
    at = F.lit("2024-01-18 00:00:00").cast("timestamp_ntz")
    r = one(spark, score.decayed_strength(F.lit(1.0), F.lit(None).cast("timestamp_ntz"), at, now()).alias("a"), score.effective(F.lit(0.8), F.lit(0.5), F.lit(0.75)).alias("b"), score.reinforced_strength(F.lit(0.9)).alias("c"))
    assert r.a == pytest.approx(0.4966, abs=1e-4) and r.b == pytest.approx(0.5) and r.c == 1.0


def test_text_functions(spark):
    said = 'run `bun test` in src/stores/events.ts\n$ git commit -m x\nreact@18.2.0 numpy==1.26.4 ERR_TIMEOUT errno: 5 camelCase snake_case "é"'
    r = one(spark, *(f(F.col("t")).alias(n) for n, f in {"paths": text.file_paths, "codes": text.error_codes, "commands": text.commands, "versions": text.versions, "tokens": text.typed_tokens, "size": text.estimate_tokens}.items()), t=said)
    assert "src/stores/events.ts" in r.paths and r.codes == ["ERR_TIMEOUT", "5"]
    assert r.commands == ["git commit -m x", "bun test"]
    assert [(v.package, v.version) for v in r.versions] == [("react", "18.2.0"), ("numpy", "1.26.4")]
    assert ("camelCase", "identifier") in [(t.token, t.type) for t in r.tokens]
    assert one(spark, text.estimate_tokens(F.lit("   ")).alias("n")).n == 0
    assert one(spark, text.test_counts(F.lit("Tests: 10 passed, 2 failed, 12 total")).alias("t")).t.asDict() == {"passed": 10, "failed": 2, "skipped": 0, "total": 12}
    assert one(spark, text.test_counts(F.lit("3 passed, 1 failed in 5s")).alias("t")).t.total == 4


def rolling(said):
    """The key, character by character of UTF-16."""
    import re

    plain = re.sub(r"[\s\ufeff]+", " ", said.lower()).strip()
    raw = plain.encode("utf-16-be")
    units, h = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)], 0
    for c in units:
        h = (h * 31 + c + 2**31) % 2**32 - 2**31
    h, digits = abs(h), ""
    while h or not digits:
        digits, h = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + digits, h // 36
    prefix = plain[:32]
    while len(prefix.encode("utf-16-be")) > 64:
        prefix = prefix[:-1]
    return f"{prefix}_{len(units)}_{digits}"


def test_rolling_hash(spark):
    texts = ["hello world", "Hello   WORLD ", "", "a", "a🎉b", "x" * 100, "\u00a0tab\tand\nline\u2003", "🎉" * 40, "ÉCOLE straße", "Some content to hash " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = [r.k for r in rows.orderBy("id").select(text.rolling_hash(F.col("t")).alias("k")).collect()]
    assert got == [rolling(t) for t in texts]
    # worked out by hand: 97 * 31^2 + 98 * 31 + 99 and so on
    assert got[0] == got[1] == "hello world_11_to5x38" and got[2] == "_0_0" and got[3] == "a_1_2p" and got[4] == "a🎉b_4_yg5ro"


def test_search_terms_drop_stop_words(spark):
    assert one(spark, text.search_terms(F.lit("How do we handle the user's AND errors?")).alias("w")).w == ["handle", "user", "errors"]


def test_scope_match(spark):
    m = lambda *a: one(spark, language.scope_match(*map(F.lit, a)).alias("m")).m
    assert m("file", "a/b.ts", "file", "a/b.ts") == 1.0
    assert m("file", "src/auth/x.ts", "module", "auth") == 0.8
    assert m("module", "auth", "file", "src/auth/x.ts") == 0.6
    assert m("file", "src/a.ts", "file", "src/b.ts") == pytest.approx(0.2)
    assert m("global", "zz", "file", "q") == 0.1


EVENTS = "session_id long, event_id long, ts string, event_type string, content string, tool_name string, exit_code int"


def events(spark):
    rows = [
        (1, 1, "2024-01-01 10:00:00", "user_prompt", "Never use any casts in this code base.", None, None),
        (1, 2, "2024-01-01 10:00:10", "tool_output", "Error: cannot find module x\n at y", "bash", 1),
        (1, 3, "2024-01-01 10:00:20", "turn", "Fixed by installing the missing package.", None, None),
        (1, 4, "2024-01-01 10:01:00", "tool_output", "ok", "bash", 0),
        (1, 5, "2024-01-01 10:10:00", "tool_output", "Error: late failure\n", "bash", 2),
        (1, 6, "2024-01-01 10:30:00", "tool_output", "ok", "edit", 0),
        *((2, 10 + i, f"2024-01-01 11:00:0{i}", "turn", "We are using pytest for tests.", None, None) for i in range(3)),
        (2, 20, "2024-01-01 11:05:00", "user_prompt", "No, you should keep the helper in one place.", None, None),
    ]
    return spark.createDataFrame(rows, EVENTS).withColumn("ts", F.to_timestamp("ts"))


def test_curation(spark):
    e = events(spark)
    fix = curate.known_fixes(e).collect()
    assert [(r.error_id, r.success_id, r.signature, r.fix) for r in fix] == [(2, 4, "cannot find module x", "installing the missing package")]
    habits = curate.repeated_patterns(e).collect()
    assert [(r.phrase, r.n, r.confidence) for r in habits] == [("using pytest for tests.", 3, "medium")]
    found = {(r.content, r.severity) for r in curate.corrections(e).collect()}
    assert ("Never use any casts in this code base.", "must") in found and any(s == "should" for _, s in found)
    types = {r.object_type for r in curate.curated(e).collect()}
    assert types == {"known_fix", "constraint", "convention"}
    assert curate.session_candidates(e).filter("session_id = 2").count() <= 3


def test_realtime_extraction_is_stricter(spark):
    e = events(spark)
    long = spark.createDataFrame([(1, 1, "2024-01-01 10:00:00", "turn", "Always use the shared client because it must never open two connections.", None, None), (1, 2, "2024-01-01 10:00:01", "turn", "let me always check the shared client because it must never fail", None, None)], EVENTS).withColumn("ts", F.to_timestamp("ts"))
    assert [r.object_type for r in curate.realtime_candidates(long).collect()] == ["constraint"]
    assert curate.realtime_candidates(e.limit(0)).count() == 0


def test_merge_and_apply(spark):
    c = spark.createDataFrame([(1, "Use tabs for indentation in all files", "convention", "medium", 5), (2, "use tabs for indentation in all files", "convention", "high", 6), (3, "A new rule that nobody knew before", "constraint", "high", 7)], "candidate_id long, content string, object_type string, confidence string, event_id long")
    m = curate.merged(c)
    assert sorted(r.candidate_id for r in m.collect()) == [2, 3]
    known = spark.createDataFrame([(9, "Use tabs for indentation in all files!", "convention")], "id long, content string, object_type string")
    got = {r.candidate_id: (r.op, r.id, r.review_status) for r in curate.applied(m, known).collect()}
    assert got == {2: ("update", 9, None), 3: ("create", None, "approved")}


def test_facts(spark):
    rows = [(1, "Caroline", "I went to the museum yesterday. My field is counseling. I really love painting because it calms me. I got a dog.", "2023-05-09"), (2, "Mel", "Nothing here", None)]
    got = [(r.subject, r.predicate, r.object, str(r.date)) for r in curate.facts(spark.createDataFrame(rows, "message_id long, speaker string, content string, session_date string")).orderBy("nth").collect() if r.message_id == 1]
    assert got == [("Caroline", "went_to", "the museum yesterday", "2023-05-08"), ("Caroline", "attribute", "field: counseling", "2023-05-09"), ("Caroline", "likes", "painting", "2023-05-09")]


def test_progressive_pack(spark):
    rows = lambda kind, items: spark.createDataFrame([(i + 1, k, c, kind) for i, (k, c) in enumerate(items)], "rank int, id long, content string, object_type string")
    parts = {
        "constraint": rows("constraint", [(1, "Never commit secrets"), (2, "never commit SECRETS!"), (3, "Rules:"), (4, "Run the linter")]),
        "hot": rows("decision", [(1, "Never commit secrets"), (5, "Use parquet " * 200), (6, "Use parquet")]),
        "history": rows("decision", [(7, "Old decision")]),
    }
    found = context.candidates(parts)
    assert [r.id for r in context.progressive(found, "task").orderBy("place").collect()] == [1, 4, 6]
    assert [r.id for r in context.progressive(found, "deep", budget=5000).orderBy("place").collect()] == [1, 4, 5, 6, 7]
    assert [r.id for r in context.progressive(found, "minimal").orderBy("place").collect()] == [1, 4]
    assert [r.id for r in context.progressive(found, "task", project=["linter"]).orderBy("place").collect()] == [4]


def test_escalation_and_disclosure(spark):
    schema = "session_id long, query string, file string, previous_topic string, error_count int, events_since_checkpoint int, events_count int, last_disclosure_at timestamp_ntz"
    long_ago, just = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31, 23, 59, 30)
    rows = [(1, "Can you remind me what we decided?", None, None, 9, 0, 0, None), (2, None, "b.ts", "a.ts", 0, 20, 80, long_ago), (3, None, None, None, 4, 0, 0, None), (4, None, None, None, 0, 15, 80, long_ago), (5, None, None, None, 0, 15, 10, just), (6, "hello", "a", None, 0, 0, 0, None)]
    got = {r.session_id: (r.trigger, r.confidence, r.level) for r in context.escalation(spark.createDataFrame(rows, schema), now()).collect()}
    assert got == {1: ("explicit_query", 1.0, "deep"), 2: ("topic_shift", 0.7, "task"), 3: ("error_burst", 0.8, "deep"), 4: ("event_threshold", 0.5, "deep")}
    memories = spark.createDataFrame([(i, "constraint" if i == 7 else "decision", "active", dt.datetime(2024, 1, i)) for i in range(1, 12)], "id long, object_type string, status string, created_at timestamp_ntz")
    seen = spark.createDataFrame([(11,)], "id long")
    assert [r.id for r in context.disclosed(memories, seen, "minimal").orderBy("place").collect()] == [10, 9, 8]
    assert [r.id for r in context.disclosed(memories, seen, "minimal", "error_burst").orderBy("place").collect()] == [7, 10, 9]


def test_symbols(spark):
    code = "import x\nexport async function load(a) {\n}\nclass Store {\nexport type Id<T> = string\nconst limit = 3\n"
    py = "class A:\n    def run(self):\n        pass\ndef _hidden():\n    pass\n"
    got = {(r.name, r.kind, r.line, r.exported) for r in evidence.symbols(spark.createDataFrame([("a.ts", code), ("b.py", py)], "path string, text string")).collect()}
    assert got == {("load", "function", 2, True), ("Store", "class", 4, False), ("Id", "type", 5, True), ("limit", "variable", 6, False), ("A", "class", 1, True), ("run", "method", 2, True), ("_hidden", "function", 4, False)}


def test_lifecycle(spark):
    rows = [(1, 1, "create", "a", None), (1, 2, "supersede", None, None), (2, 1, "create", "b", None), (2, 3, "delete", None, None), (3, 1, "create", "c", None), (3, 2, "reject", None, 7.0), (3, 3, "verify", None, None)]
    changes = spark.createDataFrame(rows, "id long, version long, op string, content string, strength double").withColumns({"status": F.lit(None).cast("string"), "review_status": F.lit(None).cast("string")})
    got = {r.id: (r.content, r.status, r.review_status, r.strength) for r in lifecycle.current(changes, ["content", "status", "review_status", "strength"]).collect()}
    assert got == {1: ("a", "superseded", None, None), 3: ("c", "active", "rejected", 1.0)}
    made = lifecycle.created(spark.createDataFrame([(1, "x")], "id long, content string"), now()).first()
    assert (made.status, made.confidence, made.strength, made.last_verified_at) == ("active", "medium", 1.0, None)


def test_blobs_and_sessions(spark):
    e = spark.createDataFrame([(1, "x " * 3000), (2, "small"), (3, "x " * 3000)], "event_id long, content string")
    kept, blobs = lifecycle.split_blobs(e)
    assert blobs.count() == 1 and {r.event_id for r in kept.filter("content is null").collect()} == {1, 3}
    assert {r.content for r in lifecycle.with_content(kept, blobs).collect()} == {"x " * 3000, "small"}
    changes = spark.createDataFrame([(1, "start", "2024-01-01", None, "a"), (1, "end", "2024-01-02", "done", None), (2, "start", "2024-01-03", None, None)], "session_id long, op string, ts string, summary string, task string")
    rows = lifecycle.sessions(changes)
    assert lifecycle.current_session(rows, open_only=True).first().session_id == 2 and lifecycle.current_session(rows, 2).first().summary == "done"


def test_supersession_and_review(spark):
    pairs = spark.createDataFrame([(1, "old", "failed_attempt", 2, "new", "known_fix", 0.9), (3, "old", "decision", 4, "now changed", "decision", 0.95), (5, "a", "decision", 6, "b", "decision", 0.99), (7, "a", "failed_attempt", 8, "wrong", "failed_attempt", 0.7)], "old_id long, old_content string, old_object_type string, new_id long, new_content string, new_object_type string, similarity double")
    found = conflicts.supersessions(pairs)
    assert {(r.old_id, round(r.confidence, 4)) for r in found.collect()} == {(1, 0.9), (3, 0.9025)}
    assert {r.old_id for r in conflicts.auto_superseded(found).collect()} == {1, 3}


def test_superseded_holds_every_pair(spark, monkeypatch):
    monkeypatch.setattr(conflicts, "STRETCH", 3)
    words = [f"word{i}" for i in range(20)]
    pick = random.Random(3)
    rows = []
    for i in range(140):  # many copies, of several types, some of which say that something changed
        said = words[:19] if i % 3 else words
        rows.append((i, " ".join(said) + pick.choice(["", "", " no", "; it is NOW"]), pick.choice(["decision", "failed_attempt", "known_fix", "environment"])))
    memories = spark.createDataFrame(rows, "id long, content string, object_type string")
    old, new = (memories.toDF(*(f"{name}_{c}" for c in memories.columns)) for name in ("old", "new"))
    shared = text.jaccard(text.plain_words(F.col("old_content")), text.plain_words(F.col("new_content")))
    pairs = old.join(new, F.col("old_id") < F.col("new_id")).withColumn("similarity", shared)
    want = {(r.old_id, r.new_id, r.reason, round(r.confidence, 9)) for r in conflicts.auto_superseded(conflicts.supersessions(pairs)).collect()}
    got = [(r.old_id, r.new_id, r.reason, round(r.confidence, 9)) for r in conflicts.superseded(memories).collect()]
    assert len(got) == len(want) and set(got) == want and len(want) > 50 and len({r for _, _, r, _ in want}) == 3


def test_resolution(spark):
    found = spark.createDataFrame([(1, 10, "replace"), (2, 11, "keep_existing"), (3, 12, "reject_both")], "candidate_id long, existing_id long, resolution string")
    assert {(r.id, r.change) for r in conflicts.resolved(found).collect()} == {(10, "supersede"), (1, "approve"), (2, "reject"), (12, "retire"), (3, "reject")}


def test_export_import_and_transcripts(spark, tmp_path):
    m = spark.createDataFrame([(1, "c1", "decision", "src", "active", "high", "pending", ["e1"]), (2, "c2", "decision", "src", "retired", "low", "pending", [])], "id long, content string, object_type string, scope_path string, status string, confidence string, review_status string, evidenceEventIds array<string>")
    io.export_objects(m, f"{tmp_path}/out")
    back = io.import_objects(spark, f"{tmp_path}/out").collect()
    assert [(r.content, r.review_status, r.evidence) for r in back] == [("c1", "approved", ["e1"])]
    (tmp_path / "env.json").write_text(json.dumps({"version": "1.0.0", "objects": [{"content": "x", "objectType": "constraint"}, {"objectType": "decision"}]}))
    assert [(r.content, r.confidence, r.review_status) for r in io.import_objects(spark, f"{tmp_path}/env.json", envelope=True).collect()] == [("x", "medium", "pending")]
    lines = [{"timestamp": "2024-01-01T00:00:00Z", "message": {"usage": {"input_tokens": 1}}}, {"timestamp": "2024-01-02T00:00:00Z", "message": {"usage": {"input_tokens": 5000, "output_tokens": 2000, "cache_read_input_tokens": 1000, "cache_creation_input_tokens": 500}}}, {"timestamp": "2024-01-03T00:00:00Z", "isSidechain": True, "message": {"usage": {"input_tokens": 9}}}]
    (tmp_path / "t.jsonl").write_text("\n".join([*map(json.dumps, lines), "not json"]))
    r = io.context_usage(spark, f"{tmp_path}/t.jsonl").first()
    assert (r.tokens, r.percent, r.recommendation) == (8500, 4.3, "continue")


def test_conversation_benchmark(spark, tmp_path):
    item = {"sample_id": "c1", "conversation": {"speaker_a": "A", "speaker_b": "B", "session_1_date_time": "1:00 pm on 8 May, 2023", "session_1": {"0": {"speaker": "A", "text": "hi"}, "1": {"speaker": "B", "text": "yo"}, "10": {"speaker": "A", "text": ""}}}, "qa": [{"question": "q?", "answer": 5, "category": 2, "evidence": ["D1:3", "D1:4"]}]}
    (tmp_path / "l.json").write_text(json.dumps([item]))
    messages, questions = io.conversations(spark, f"{tmp_path}/l.json")
    assert [(r.session_id, r.nth, r.role, r.content) for r in messages.orderBy("nth").collect()] == [("c1_D1", 0, "user", "hi"), ("c1_D1", 1, "assistant", "yo")]
    q = questions.first()
    assert (q.question_id, q.answer, q.sessions) == ("c1_q0", "5", ["c1_D1"])


def test_files_and_rendering(spark, tmp_path):
    (tmp_path / "a.py").write_text("x\ny\n")
    assert io.source_files(spark, str(tmp_path), "*.py").first().text == "x\ny\n"
    pack = spark.createDataFrame([("grounded", 2, "decision", 'say "x"'), ("grounded", 1, "constraint", "never")], "tier string, id long, object_type string, content string")
    assert io.rendered(pack).first().text == 'Grounded:\n- [constraint] never\n- [decision] say "x"'
    assert json.loads(io.rendered(pack, "json").first().text)[1]["content"] == 'say "x"'
    assert '\\"x\\"' in io.rendered(pack, "yaml").first().text


def test_context_pack_keeps_constraints(spark):
    memories = spark.createDataFrame([(1, "c " * 100, "constraint", "active"), (2, "d " * 10, "decision", "active")], "id long, content string, object_type string, status string")
    ranked = memories.withColumn("rank", F.col("id").cast("int"))
    got = {(r.part, r.id) for r in search.context_pack(memories, ranked, 60).collect()}
    assert got == {("constraint", 1)}  # over budget, the rest stays out
    got = {(r.part, r.id) for r in search.context_pack(memories, ranked, 500).collect()}
    assert got == {("constraint", 1), ("relevant", 2)}


def test_tokens_and_lists(spark):
    m = spark.createDataFrame([(1, "call loadConfig with --force", "active"), (2, "snake_case_name v1.2.3", "active"), (3, "loadConfig", "retired")], "id long, content string, status string")
    index = search.token_index(m)
    assert {r.id for r in search.by_token(m, index, "LOADCONFIG").collect()} == {1}
    assert {r.id for r in search.by_token_part(m, index, "case").collect()} == {2}
    assert lexicon.postings(m, ("content",)).filter("term = 'loadconfig'").count() == 2


def test_episode_gap_is_strict(spark):
    rows = [(1, i, f"2024-01-01 00:0{m}:{s:02d}") for i, (m, s) in enumerate([(0, 0), (1, 0), (2, 1), (2, 2)])]
    e = spark.createDataFrame(rows, "session_id long, event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.episode for r in sessions.episodes(e).orderBy("event_id").collect()] == [1, 1, 2, 2]


def test_empty_store(spark):
    schema = "id long, content string, object_type string, status string, review_status string, created_at timestamp_ntz, last_verified_at timestamp_ntz, n_refs long, n_evidence long, confidence string"
    empty = spark.createDataFrame([], schema)
    assert records.quality_metrics(empty, now()).first().health == 100
    assert records.recommendations(records.quality_metrics(empty, now())).first().advice == ["no memories yet"]
    assert {r.n for r in records.status_counts(empty).collect()} == {0}


def test_stems(spark, tmp_path):
    from tessera.functions import stem

    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall filing file happy happi sky sky relational relat conditional condit digitizer digit operator oper feudalism feudal formaliti formal triplicate triplic hopeful hope goodness good revival reviv adjustment adjust adoption adopt probate probat rate rate controll control roll roll".split()
    assert [stem.stem(w) for w in pairs[::2]] == pairs[1::2]
    m = spark.createDataFrame([(1, "connecting services", "s"), (2, "connected", "s"), (3, "other words", "s")], "id long, content string, scope_path string")
    index = lexicon.build(m, ("content", "scope_path"), str(tmp_path))
    assert {r.id for r in index.scores(["Connection!"]).collect()} == {1, 2}
    assert index.scores(["missing"]).count() == index.scores(["..."]).count() == 0


def test_hooks(spark):
    from tessera.functions import hooks

    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "abcde")], "id long, content string")
    got = {r.id: (r.embedding, r.token_count) for r in hooks.with_token_counts(hooks.with_embeddings(rows, "content", lambda: lambda ts: [[len(t), 1.0] for t in ts], 2), "content", lambda: lambda t: len(t)).collect()}
    assert got == {1: ([2.0, 1.0], 2), 2: ([0.0, 1.0], 0), 3: ([5.0, 1.0], 5)}
    assert hooks.extracted(rows, lambda: lambda b: b[["id"]], "id long").count() == 3


def test_related_and_latest_vectors(spark):
    v = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(8)], "vec_id long, embedding array<float>")
    bases = spark.createDataFrame([(0, 1), (7, 2)], "id long, rank int")
    got = {(r.base, r.id) for r in search.related(bases, v, k=2).collect()}
    assert got == {(0, 1), (0, 2), (7, 6), (7, 5)}
    log = spark.createDataFrame([(1, 1, [1.0]), (1, 2, [2.0]), (2, 1, [1.0]), (2, 3, None)], "vec_id long, version long, embedding array<float>")
    assert [(r.vec_id, r.embedding) for r in search.latest_vectors(log).collect()] == [(1, [2.0])]


def in_time(df, seconds):
    began = time.monotonic()
    rows = df.collect()
    assert time.monotonic() - began < seconds
    return rows


def test_words_come_before_patterns():
    """A pattern's words are in whatever it matches, and what none can be told for has none."""
    said = {
        r"how\s+are\s+.*\s+named": ["HOW are  all of them named"], r"security|vulnerability|cve-": ["a CVE-1", "Security"], r"(?:fixed by|use .* instead)": ["Use that instead", "FIXED BY me"],
        r"trade-?off": ["tradeoff", "Trade-Off"], r"installed|package\.json": ["package.json", "INSTALLED"], r"what('s|s)?\s+wrong": ["What wrong", "what's wrong"], r"x{0,2}yz": ["yz", "xxyz"],
    }
    for pattern, texts in said.items():
        for t in texts:
            assert re.search(pattern, t, re.I) and any(w in t.lower() for w in text.needed(pattern)), (pattern, t)
    for pattern in (p for kind in (*(ps for ps, _ in language.INTENTS.values()), *language.EXTRACTION.values()) for p in kind):
        assert text.needed(pattern)
    assert text.needed(r"(a(b))") == text.needed(r"\w+|abc") == ()


def test_texts_without_a_patterns_words_are_not_searched(spark):
    """Searching these for ``how are .* named`` and ``use .* instead`` takes the square of their length."""
    long = spark.createDataFrame([(0, "how are " * 40_000), (1, "use " * 60_000), (2, None), (3, "li\u212ae, Like")], "id long, t string").coalesce(1)
    rows = in_time(long.select("id", language.intent(F.col("t")).alias("intent"), language.extraction(F.col("t")).alias("vote")).orderBy("id"), 20)
    assert [r["intent"] for r in rows] == ["general"] * 4
    assert [r["vote"] and r["vote"]["type"] for r in rows] == [None, None, None, "preference"]
    kelvin = spark.range(1).select(language.extraction(F.lit("li\u212ae")).alias("vote")).first()["vote"]
    assert kelvin is None  # only in lower case is it a word


def test_many_tokens_in_one_text(spark):
    """Equal tokens meet by a shuffle, not by lists that are read through for each token."""
    text_ = " ".join(f"--f{i % 25_000} E{i}" for i in range(50_000))
    rows = spark.createDataFrame([(1, text_), (2, "aB ab-c --F1 --f1 E1 1.2"), (3, None)], "id long, content string").coalesce(1)
    found = search.token_index(rows).cache()
    assert in_time(found.groupBy("id").count().orderBy("id"), 60)[0]["count"] == 75_000
    assert sorted((r["token"], r["type"]) for r in found.filter("id = 2").collect()) == [("--f1", "flag"), ("-c", "flag"), ("1.2", "version"), ("ab", "identifier"), ("e1", "error_code")]
