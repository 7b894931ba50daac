"""Operators 1, 2, 3, 6, 8 and 10 against plain Python, and their edge cases."""

import hashlib
import random
import re
import zlib
from array import array

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, html_text, packing, pii, secrets
from tessera.llm import sentencepiece as sp

DOC = "doc_id long, text string"
LONG = "word " * 60_000


def docs(spark, texts, extra=""):
    """Documents with clashing extra columns, repeated rows and a null id."""
    rows = [(i, t, "x", 1.5) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1.5), (None, texts[0], "x", 1.5)]
    return spark.createDataFrame(rows, DOC + ", spans string, score double")


# --- 1 -------------------------------------------------------------------------


def page(article, nav="menu", foot="foot"):
    return f"<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><div class='top'>{nav}</div><article>{article}</article><div>{foot}</div></body>"


def test_main_text_blocks_and_references(spark):
    html = page("<h1>A &amp; B&nbsp;c</h1><p>x  <b>y</b>z<br>w<p>&lt;tag&gt; &#233;&amp;lt;<ul><li>one<li>two</ul><div class='comments'>no</div><form>no</form><aside>no</aside>")
    rows = spark.createDataFrame([(1, "http://h.example/1", html, 9), (2, "odd", None, 9), (None, None, "", 9), (4, "u", "plain < text", 9)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html_text.extract(rows).collect()}
    assert got[1]["text"] == "A & B c\nx yz w\n<tag> é&lt;\none\ntwo"
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[None]["text"] == ""
    assert got[4]["text"] == "plain < text"


def test_chrome_within_a_block():
    parts = "<article><p><span class='ad'>Ad</span> one <a class=share>Share</a>two<script>x()</script></p><div>three<nav>menu</nav>four</div></article>"
    assert html_text.Page(parts).text(set()) == "one two\nthree\nfour"


@pytest.mark.parametrize("most", [1000, 0])
def test_templates_are_counted_per_host_and_deleted(spark, most):
    def bare(i, note):
        return f"<body><div class='x1'>{note}</div><div class='x2'><p>text {i}</p><p>shared passage</p></div><div class='x3'>bottom</div></body>"

    rows = [(i, f"https://a.example/{i}", bare(i, "welcome to a")) for i in range(8)]
    rows += [(100 + i, f"https://b.example/{i}", bare(100 + i, "welcome to a" if i == 0 else f"own {i}")) for i in range(4)]
    rows += [(200 + i, "https://c.example/", bare(200, "copy")) for i in range(9)]  # copies count as one page
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), most).collect()}
    assert got[3] == "text 3"  # of a page without an article, what recurs is template
    assert got[100].startswith("welcome to a\ntext 100")
    assert got[200] == "copy\ntext 200\nshared passage\nbottom"
    art = [(i, f"https://d.example/{i}", page(f"<p>text {i}</p><p>shared passage</p>")) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(art, "page_id long, url string, html string"), most).collect()}
    assert got[5] == "text 5\nshared passage"  # nothing inside an article goes for recurring


def test_pages_empty_and_long(spark):
    schema = "page_id long, url string, html string"
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = spark.createDataFrame([(1, "u", deep), (2, "u", "<p>" + LONG)], schema)
    got = {r["page_id"]: r for r in html_text.extract(rows).collect()}
    assert got[1]["text"] == "deep" and got[2]["n_chars"] == len(LONG) - 1


# --- 2 -------------------------------------------------------------------------

TEXTS = ["Hello world", "", "  two  spaces ", "naïve café\n\nline\ttab", "日本語 ☃ 🎉", "the theableble onereneation", "▁ mark", "a" * 300, None, LONG]


def test_pieces_are_the_best_segmentation(spark):
    import sentencepiece

    data = open(sp.default_model(), "rb").read()
    at = data.index(b"\x18\x02", data.rindex(b"tok_v0"))  # the trainer's model type: BPE -> unigram
    library = sentencepiece.SentencePieceProcessor(model_proto=data[:at] + b"\x18\x01" + data[at + 2 :])
    encode, decode = sp.codec(sp.default_model())
    words = "the of anti erning theableble onereneation thonre onhand a1b2 end.".split()
    pick = random.Random(1)
    for word in words:  # the library adds in single precision, which is exact for a word
        best = [library.piece_to_id(p) for p in library.nbest_encode_as_pieces(word, 2)[0]]  # the first of A* search
        assert array("i", encode(word)).tolist() == best
        assert decode(best) == word
    scores = {library.id_to_piece(i): library.get_score(i) for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    for _ in range(40):
        text = " ".join(pick.choices([*words, "Überraschung", "école", "x_y"], k=8))
        marked = "▁" + text.replace(" ", "▁")
        top = [0.0] + [float("-inf")] * len(marked)
        for end in range(1, len(marked) + 1):  # every piece at every place
            top[end] = max(top[i] + scores[marked[i:end]] for i in range(max(0, end - 20), end) if marked[i:end] in scores)
        assert sum(library.get_score(i) for i in array("i", encode(text))) == top[-1]


def test_encoding_round_trip(spark):
    out = sp.encode_documents(docs(spark, TEXTS), sp.default_model())
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 2
    back = {r["doc_id"]: r["text"] for r in sp.decode_documents(out, sp.default_model()).collect()}
    for i, t in enumerate(TEXTS):
        if "▁" not in (t or ""):  # a mark in the text can't be told from a space, as in the library
            assert back[i] == (t or "")
    assert all(r["round_trip"] for r in rows if "▁" not in (TEXTS[r["doc_id"] or 0] or ""))
    assert sp.encode_documents(spark.createDataFrame([], DOC), sp.default_model()).count() == 0


# --- 3 -------------------------------------------------------------------------


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    cards = ["4041894974608795", "4337166598464399", "4944-3394-9042-9605"]
    texts = [f"pay {c} now" for c in cards] + [
        "pay 4041894974608795 again", "4041894974608796 fails its check", "on 2024-02-29 and 29.02.2024 and 1 March 2024", "ip 10.0.0.1, not 300.1.1.1", "mail Ab.c9@mail.example.com.",
        "call +1 (988) 555-2485 or +49 30 1234567", "ssn 123-45-6789 and 000-12-3456", "iban DE89370400440532013000", None, "", "v1.2.3.4.5 1234567890123",
    ]
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs(spark, texts), "key").collect() if r["doc_id"] is not None}
    number = lambda s: re.sub(r"\D", "", s)
    for i, c in enumerate(cards):
        new = got[i]["pii_found"][0]["new"]
        assert new != c and luhn(number(new)) and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", c)
    assert got[3]["pii_found"][0]["new"] == got[0]["pii_found"][0]["new"]
    assert got[4]["text"] == texts[4] and got[11]["text"] is None and got[12]["text"] == ""
    days = [m["new"] for m in got[5]["pii_found"]]
    assert days[1] == ".".join(reversed(days[0].split("-"))) and days[0][:2] == "20" and days[0] != "2024-02-29"
    new = got[6]["pii_found"][0]["new"]
    assert all(int(p) < 256 for p in new.split(".")) and "300.1.1.1" in got[6]["text"]
    assert re.search(r"mail [A-Z][a-z]\.[a-z]\d@mail\.example\.com\.", got[7]["text"]) and "Ab.c9@" not in got[7]["text"]
    assert re.search(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} or \+49 \d\d \d{7}", got[8]["text"])
    assert "123-45-6789" not in got[9]["text"] and "000-12-3456" in got[9]["text"]
    iban = got[10]["pii_found"][0]["new"]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "DE89370400440532013000"
    other = pii.pseudonymise(docs(spark, texts), "other key").filter("doc_id = 0").first()
    assert other["pii_found"][0]["new"] != got[0]["pii_found"][0]["new"]


def test_pii_beside_other_groups(spark):
    texts = [
        "card 4111 1111 1111 1111 123 exp", "4111111111111111 12 times", "12 4111111111111111 exp", "4111-1111-1111-1111",
        "ES91 2100 0418 4502 0005 1332 BIC", "AT61 1904 3002 3457 3201 2024", "AT61 1904 3002 3457 3201 4111 1111 1111 1111", "call (415-555-2671)", "12 2024-02-29 1234", "4111 1111 1111 1112 123",
    ]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs(spark, texts), "key").collect() if r["doc_id"] is not None}
    same = re.sub(r"\D", "", got[3])
    assert same != "4" + "1" * 15 and luhn(same)
    spaced = " ".join(same[i : i + 4] for i in range(0, 16, 4))
    assert got[0] == f"card {spaced} 123 exp" and got[1] == f"{same} 12 times" and got[2] == f"12 {same} exp"
    assert "2100 0418" not in got[4] and got[4].startswith("ES") and got[4].endswith(" BIC")
    assert "1904 3002" not in got[5] and got[5].endswith(" 2024")
    assert "1904 3002" not in got[6] and got[6].endswith(" " + spaced)
    assert re.fullmatch(r"call \([2-9]\d\d-[2-9]\d\d-\d{4}\)", got[7]) and "415-555-2671" not in got[7]
    assert re.fullmatch(r"12 20\d\d-\d\d-\d\d 1234", got[8]) and "2024-02-29" not in got[8]
    assert got[9] == texts[9]


def test_permutations_are_bijections(spark):
    n = spark.range(84)
    pairs = n.select(pii.feistel("k", "t", F.floor(F.col("id") / 12), F.col("id") % 12, F.lit(7), F.lit(12)).alias("p")).select("p.l", "p.r").distinct()
    assert pairs.count() == 84
    texts = n.select(F.lpad(F.col("id").cast("string"), 2, "0").alias("t")).withColumn("p", pii.permuted("k", "t", F.col("t")))
    assert texts.select("p").distinct().count() == 84 and texts.filter(F.length("p") == 2).count() == 84
    days = spark.range(36525).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("d")).select(pii.other_day("k", F.col("d")).alias("p"))
    assert days.distinct().count() == 36525 and days.filter("year(p) not between 2000 and 2099").count() == 0


def test_pii_empty_table(spark):
    assert pii.pseudonymise(spark.createDataFrame([], DOC), "k").count() == 0


# --- 6 -------------------------------------------------------------------------


def test_examples_read_back(spark):
    probe = r"</s>[INST] ok [/INST]"
    odd = [r"\[INST] \\</s>", "", None, "ends with \\", probe, "[ROLE] [/ROLE][SYS]", "line\nbreak"]
    rows = [(1, i, ("system" if i == 0 else "user" if i % 2 else "assistant"), t, "z") for i, t in enumerate(odd)]
    rows += [(2, 0, "user", "only a question", "z"), (3, 0, "tool", "x [INST]", "z"), (3, 1, "assistant", "same", "z"), (3, 1, "assistant", "same", "z"), (3, None, None, "first", "z"), (None, 0, "assistant", "no id", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, target string")
    examples = chat.prefix_target(turns)
    got = {r["conv_id"]: r for r in chat.digests(examples).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=key)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    each = examples.filter("conv_id = 3").orderBy("target").collect()
    assert [e["trainable"] for e in each] == [True, True] and each[0]["formatted"] in each[1]["formatted"]
    assert all(e["formatted"][e["loss_start"] : e["loss_end"]] == "same" for e in each)
    assert chat.digests(chat.prefix_target(turns.limit(0))).count() == 0


# --- 8 -------------------------------------------------------------------------

BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20, 0),
    ("hex", re.compile(r"[0-9a-f]+"), 24, 0),
]


def brute(text):
    found = [(m.start(), k, n, m.end()) for k, (n, p, least, g) in enumerate(BASE) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(found))


def test_secrets_against_brute_force(spark):
    pick = random.Random(3)
    parts = ["password=", "Token : '", "API_KEY=", "apikey:", "secret=token:", "abcdef12", "AKIA", "ABCDEFGHIJKLMNOP12", "0123456789abcdef", "é🎉", " ", "\n", "x", "ghp_" + "a" * 36, "passwd\"= \"q.w/e+r=-"]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 14))) for _ in range(300)] + [None, "", "secret=token:abcdefg", LONG + "password=hunter22"]
    got = secrets.scan(docs(spark, texts)).select("doc_id", secrets.listed(F.filter("spans", lambda s: s["kind_order"] < 3)).alias("base"), secrets.listed(F.col("spans")).alias("all")).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert r["base"] == brute(texts[r["doc_id"] or 0])
    assert any("forge:" in r["all"] for r in got)
    assert secrets.scan(spark.createDataFrame([], DOC)).count() == 0


def test_many_spans_of_one_text_take_linear_time(spark):
    import time

    texts = ["".join(f"{i:024x} " for i in range(n)) + "password=hunter22 " * 500 for n in (1000, 64_000)]
    took = []
    for t in texts:
        began = time.time()
        got = secrets.scan(docs(spark, [t, "x"])).filter("doc_id = 0").select(secrets.listed(F.col("spans")).alias("all")).first()["all"]
        took.append(time.time() - began)
        assert got == brute(t)
    assert took[1] < took[0] + 10


def test_posting_lists_are_intersected(spark, monkeypatch):
    monkeypatch.setattr(secrets, "BLOCK_DOCS", 3)
    texts = ["pass word", "password=hunter22", "AKIA" + "A" * 16, "aki kia", "passwd: x", "nothing", "secret token apikey"] * 3
    indexed = secrets.index(docs(spark, texts))
    lists = secrets.postings(indexed)
    assert lists.select("block").distinct().count() > 1 and lists.filter("size(keys) > 9").count() == 0
    got = {r["key"]: r["asked"] for r in secrets.candidates(lists).collect()}
    by_key = {r["key"]: r["doc_id"] or 0 for r in indexed.collect()}
    want = {}
    for i, t in enumerate(texts):
        grams = {t.lower()[j : j + 3] for j in range(len(t) - 2)}

        def satisfied(q, grams=grams):
            return q in grams if isinstance(q, str) else (all if q[0] == "and" else any)(map(satisfied, q[1]))

        if asked := [n for n, r in enumerate(secrets.RULES) if (q := secrets.trigram_query(r.pattern)) is not None and satisfied(q)]:
            want[i] = asked
    assert {by_key[k]: a for k, a in got.items()} == want


def test_trigram_queries():
    query = secrets.trigram_query
    assert query(r"[0-9a-f]{24,}") is None
    assert secrets.leaves(query("AKIA[A-Z0-9]+")) == {"aki", "kia"}
    assert query("abcd") == ("and", frozenset({"abc", "bcd"}))
    assert query("(?:abc|x)y*") is None
    assert query("abc|abd") == ("or", frozenset({"abc", "abd"}))


# --- 10 ------------------------------------------------------------------------


def test_pieces_cover_each_document(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["", None, "Hello, World! don't", "a\x1cb <|endoftext|> x", "ΑΣ İ é", LONG, "one two three"]
    rows = packing.pack(docs(spark, texts), packing.default_tokenizer(), longest=1024).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: (r["start"], r["sequence_id"]))
        if i == 0:  # a repeated row
            assert len(own) == 2
            own = own[:1]
        assert sum(r["length"] for r in own) == len(ids) and all(r["doc_tokens"] == len(ids) for r in own)
        for r in own:
            part = array("I", ids[r["start"] : r["start"] + r["length"]]).tobytes()
            assert r["ids_crc32"] == zlib.crc32(part) and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
    assert packing.pack(spark.createDataFrame([], DOC), packing.default_tokenizer()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs(spark, texts), packing.default_tokenizer(), longest=1000)


def test_ids_are_the_tokenizers_on_odd_texts():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    encode = packing.word_encoder(packing.default_tokenizer())
    draw = random.Random(4)
    marks, spaces = packing.TAIL + "'\"-_/<>=@~`", " \n\t\xa0\u2003\u2028\x85\x1c\u200b\u180e\ufeff\u3000"
    letters = "abcdefghijklmnopqrstuvwxyzABCDEZ" * 2 + "éÉüßñÑŒœŠšİıĲǅǰŉÅÇ" + "\u0301\u0307\u0327" + "дЖяΣσςαאع日本語한" + "012" + "🎉ﬁ①²"
    known = ["<|endoftext|>", "<|startoftext|>", "don't", "It's", "'ll", "thonre", "straße", "İ!", "e\u0301.", "Σ."]

    def text():
        parts = []
        for _ in range(draw.randint(0, 5)):
            word = draw.choice(known) if draw.random() < 0.1 else "".join(draw.choices(letters, k=draw.randint(0, 6)))
            parts.append(word + "".join(draw.choices(marks, k=draw.choice((0, 0, 1, 2)))))
        return "".join(p + draw.choice(spaces) for p in parts)

    texts = ["İ!", *(text() for _ in range(50_000))]
    wrong = [t for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True) if array("I", e.ids).tobytes() != encode(t)]
    assert not wrong, wrong[:5]


def test_buckets_hold_pieces_of_one_length(spark, tmp_path):
    pieces = packing.pack(docs(spark, ["one two three", LONG, ""]), packing.default_tokenizer(), longest=1024)
    packing.write_buckets(pieces, f"{tmp_path}/buckets", files=4)
    back = spark.read.parquet(f"{tmp_path}/buckets")
    assert back.count() == pieces.count()
    assert back.filter("length <> shiftleft(1, bucket)").count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 4095, 4096, 4097, 100_000])
def test_power_of_two_lengths(n):
    parts = list(packing.power_of_two_lengths(n))
    assert sum(parts) == n and parts == sorted(parts, reverse=True) and all(p & (p - 1) == 0 and p <= 4096 for p in parts)
