"""Extraction, licenses, token counts, decontamination, packing and languages against plain versions."""

import html
import random
import re
import zlib

import numpy as np
import pytest

from coppice.llm import decontaminate, html_density, language, license_templates, packing, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")


# -- extraction

ARTICLE = ["Title of it", "First & long paragraph with many words in it, so that it is text.", "Second one, x < y, also long enough to be text."]


def page(wrap_open, wrap_close, before="", after=""):
    body = "".join(f"<p>{html.escape(x)}</p>" for x in ARTICLE[1:])
    return f"<html><head><title>no</title></head><body>{before}{wrap_open}<h1>{ARTICLE[0]}</h1>{body}{wrap_close}{after}</body></html>"


@pytest.mark.parametrize("junk", [
    "<nav><a href=/>Home</a><a href=/b>Blog</a></nav>", "<div class='cookie-notice'>We use cookies on this site, a long notice of many words indeed.</div>",
    "<aside>Side text</aside>", "<div id=sidebar><ul><li>a<li>b</ul></div>", "<form>Name <input></form>", "<script>if (a<b) p('</p>')</script>",
    "<style>p{}</style>", "<!-- <p>hidden</p> -->", "<footer>&copy; 2020</footer>", "<header><a href=/>Site</a></header>",
    "<div class='ad'>Buy now</div>", "<section class=comments><p>A reader says a lot about this, in many many words of text.</p></section>",
    "<div hidden>not shown</div>", "<svg><text>x</text></svg>",
])
@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<div class=post>", "</div>"), ("<main><div>", "</div></main>")])
def test_article_without_the_rest(junk, around):
    want = "\n".join(ARTICLE)
    assert html_density.main_text(page(*around, before=junk)) == want
    assert html_density.main_text(page(*around, after=junk)) == want


@pytest.mark.parametrize("around", [
    ("<form id=aspnetForm><article>", "</article></form>"), ("<form><div>", "</div></form>"), ("<aside><article>", "</article></aside>"),
    ("<form><nav><a href=/>Home</a></nav><main>", "</main><aside><article>A teaser</article></aside></form>"),
    ("<header><main>", "</main></header><footer>Foot</footer>"),
])
def test_wrappers_of_whole_articles_stay(around):
    assert html_density.main_text(page(*around)) == "\n".join(ARTICLE)
    side = "<aside><article>Teaser of another text</article></aside><form>Name</form>"
    assert html_density.main_text(page("<article>", "</article>", after=side)) == "\n".join(ARTICLE)


def test_anchors_inside_articles_stay():
    parts = ("<h2 id='related-work'>Related work</h2><section id='search-and-sorting'><p>Text of a section with quite a few words in it.</p></section>"
             "<p id='form-validation'>Validation of forms is text as well.</p><p class='related' id=x>Read on</p>")
    for tag in ("article", "main"):
        assert html_density.main_text(page(f"<{tag}>", f"{parts}</{tag}>")) == "\n".join([
            *ARTICLE, "Related work", "Text of a section with quite a few words in it.", "Validation of forms is text as well."])


def test_blocks_references_and_white_space():
    assert html_density.main_text("<p>a\n b&nbsp;&#x63;<br>d</p><ul><li>e<li>f</ul>") == "a b c d\ne\nf"
    assert html_density.main_text("<p title='a>b'>x</p>y &amp") == "x\ny &"
    assert html_density.main_text("a < b") == "a < b"
    assert html_density.main_text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"
    assert [html_density.main_text(x) for x in (None, "", "<p></p>", "<script>x")] == ["", "", "", ""]
    assert html_density.main_text("<p>" + "<b>" * 5000 + "deep") == "deep"


def test_pages_as_their_markup_says(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumnRenamed("page_id", "text").withColumnRenamed("text", "page_id")
    for r, source in zip(html_density.extract_articles(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect()):
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", source["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x) if "<br>" in x else x.replace("<b>", "")).split())
                  for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(x for x in blocks if x)
        assert r["n_chars"] == len(r["text"])


# -- licenses

def test_license_scan(spark):
    rows = [
        (1, "Licensed under CC BY-NC 4.0. All Rights\nReserved; cc by, CC BY cc by"),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "Licensed under the Apache License, Version 2.0."), (4, "licensed under the Apache License of 2 0"), (5, "under the MIT License"),
        (6, "Copyright (c) 2020 Some Body. All rights reserved."), (7, "copyright " + "x " * 9 + "all rights reserved"), (8, None), (9, ""),
        (None, "general public license"), (2, "accby by"),
    ]
    docs = spark.createDataFrame([(*r, "no") for r in rows], "doc_id long, text string, labels string")
    got = [tuple(r) for r in license_templates.scan_licenses(docs).collect()]
    assert got[0] == (1, 16, 5, 2, 14, "cc-by,reserved", "cc-by,cc-by-nc-4.0,reserved", 1.0)
    assert [(r[5], r[6], r[7]) for r in got[1:]] == [
        ("gpl", "gpl,gpl-3.0", 1.0), ("", "apache-2.0", 1.0), ("", "", 0.0), ("", "mit", 1.0), ("reserved", "copyright,reserved", 1.0),
        ("reserved", "reserved", 0.5), ("", "", 0.0), ("", "", 0.0), ("gpl", "gpl", 0.5), ("", "", 0.0)]
    assert got[7][1:5] == (0, 0, None, None)


def test_automata_as_expressions():
    r = random.Random(1)
    a = license_templates.compile_template("x", "a <<optional>>b <<optional>>c<<end>> d<<end>> <<any 0-2>> e")
    for _ in range(3000):
        words = [r.choice("abcde") for _ in range(r.randint(1, 8))]
        want = re.match(r"a (b (c )?d )?(\w ){0,2}e( |$)", " ".join(words) + " ")
        assert a.accepts([w.encode() for w in words], 0) == bool(want), words
    for bad in ("<<optional>>a<<end>> b", "a <<optional>>b", "a<<end>>", "a <<what>>"):
        with pytest.raises(ValueError):
            license_templates.compile_template("x", bad)


# -- token counts

def greedy(pieces, word):
    n = i = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        n, i = (n + 1, j) if j else (n + len(word[i].encode()), i + 1)
    return n


def test_longest_match_as_greedy():
    r = random.Random(2)
    for _ in range(60):
        pieces = {"".join(r.choice("abcé") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 25))}
        match = token_counts.LongestMatch(sorted(pieces), remember=3)
        for _ in range(60):
            word = "".join(r.choice("abcédx") for _ in range(r.randint(0, 14)))
            assert match.count_word(word) == greedy(pieces, word), (pieces, word)


def test_token_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = set(token_counts.vocabulary(path))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "n_chars")
    docs = docs.unionByName(spark.createDataFrame([(None, "a b"), (-1, None), (-2, ""), (-3, "日本 €")], "doc_id long, text string").selectExpr("*", "0L as n_chars"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = token_counts.count_tokens(docs, path).collect()
    assert len(got) == len(texts)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])
        assert (r["n_chars"], r["n_words"]) == (len(texts[r["doc_id"]]), len(words))
        assert r["n_tokens"] == sum(greedy(pieces, token_counts.START + w) for w in words)


# -- decontamination

def test_leaks_as_dynamic_programming(spark):
    r = random.Random(3)
    alphabet = "abcdefghij "
    items = [(i, "".join(r.choice(alphabet) for _ in range(r.randint(5, 120)))) for i in range(12)] + [(99, None), (98, " ")]
    rows = []
    for d in range(60):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 150)))
        for _ in range(r.randint(0, 2)):
            part = list(r.choice(items[:12])[1])
            for _ in range(r.randint(0, 7)):
                at = r.randrange(len(part))
                part[at] = r.choice(["", "X", part[at] + "y"])
            text = text[:40] + "".join(part).upper().replace(" ", "\n ") + text[40:]
        rows.append((d, text))
    rows += [(60, None), (61, ""), (62, items[0][1]), (62, items[0][1]), (None, items[1][1])]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")

    def distance(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, x in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
            row = new
        best = min(row[1:], default=len(p) + 1)
        return best, row.index(best, 1) if t else 0

    want = []
    for d, t in rows:
        n = decontaminate.normal(t)
        for i, item in items:
            if p := decontaminate.normal(item):
                if len(p) < 40:
                    if p == n:
                        want.append((d, i, 0, len(n)))
                elif n and (x := distance(p, n))[0] <= len(p) // 12:
                    want.append((d, i, *x))
    for block in (10_000, 150):
        got = decontaminate.find_leaks(docs, bench, chars_per_error=12, block_chars=block).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
        kept = decontaminate.keep_clean(docs, bench, chars_per_error=12, block_chars=block)
        assert kept.columns == docs.columns
        assert sorted((tuple(x)[:2] for x in kept.collect()), key=repr) == sorted((x for x in rows if x[0] not in {w[0] for w in want}), key=repr)
    assert any(w[2] for w in want)
    assert decontaminate.find_leaks(docs, bench.where("false")).count() == 0
    assert decontaminate.find_leaks(docs.where("false"), bench).count() == 0


# -- packing

def pieces_of(rows, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((d, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=repr)


def test_words_met_again_are_tokenised_once(monkeypatch):
    monkeypatch.setattr(packing.WordIds, "LIMIT", 100)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        words = packing.WordIds(f.read())
    texts = [" ".join(f"{c}word{i}" for i in range(n)).encode() for c, n in (("a", 40), ("b", 40), ("c", 20), ("d", 90))]
    plain, sent = [words.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts], []
    tokenizer = words.tokenizer

    class Counted:
        def encode_batch_fast(self, chunks, **options):
            sent.extend(chunks)
            return tokenizer.encode_batch_fast(chunks, **options)

    words.tokenizer = Counted()
    for i in (0, 1, 2, 0, 1, 3, 2, 1, 0):
        assert np.frombuffer(words.ids([texts[i]])[0], "<u4").tolist() == plain[i]
        if i == 3:
            assert len(sent) == 190  # no word twice, as 100 are remembered
    assert len(words.chunks) <= 100


@pytest.mark.parametrize("capacity, block", [(4096, None), (64, 2000)])
def test_packing(spark, capacity, block, monkeypatch):
    if block:
        monkeypatch.setattr(packing, "BLOCK_TOKENS", block)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60 if block else 200)
    extra = [(None, "Don't, stop. É!"), (-1, None), (-1, None), (-2, ""), (-3, "İ A. B,, <|endoftext|> x²")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).selectExpr("*", "0 as piece", "'x' as offset")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(docs, path, capacity).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == pieces_of([(r["doc_id"], r["text"]) for r in docs.collect()], capacity)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= capacity
    bound = -(-sum(r["length"] for r in got) // capacity)
    assert len(bins) <= bound * 1.05 + 1
    assert packing.pack_documents(docs.where("false"), path, capacity).count() == 0


def test_ids_with_added_tokens_in_all_spellings():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        words = packing.WordIds(f.read())
    tokenizer = Tokenizer.from_file(path)
    r = random.Random(9)
    parts = ["<|startoftext|>", "<|STARTOFTEXT|>", "<|EndOfText|>", "<|endoftext|>", "<|endoftext|", "<|", "|>", "a", "Don't", "É", "ß", " ", "\n", ".", ",", "12", "İ"]
    made = ["".join(r.choices(parts, k=r.randrange(1, 8))) for _ in range(4000)] + ["", "<|endoftext|>", "x<|ENDOFTEXT|>y<|endoftext|>Z"]
    got = words.ids([t.encode() for t in made])
    for text, ids in zip(made, got):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_ids_of_whole_columns():
    """Only distinct chunks become objects, and white space, nulls and stops stay where the tokenizer has them."""
    import tracemalloc

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        words = packing.WordIds(f.read())
    tokenizer = Tokenizer.from_file(path)
    r = random.Random(4)
    parts = ["a", "Be", "é", "É", "word", ".", ",", "..", ".,", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\u00a0", "<|endoftext|>", "'s", "7"]
    made = [None, "", " ", *("".join(r.choices(parts, k=r.randrange(1, 12))) for _ in range(3000)), "a.", "a. ", " a,", None]
    column = pa.array(["cut off", *made]).slice(1)
    for text, ids in zip(made, words.ids(column), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text
    assert words.ids(column.slice(0, 0)) == []
    long = b"two words, " * 50_000
    tracemalloc.start()
    words.ids([long])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(long)


def test_short_items_stand_as_words():
    pieces = decontaminate.Pieces(([("a", "two words"), ("b", "x" * 30 + " end"), ("c", "é"), ("d", "(k)")], 25, 40))
    find = lambda text: [(pieces.items[n][0], d, end) for n, d, end in pieces.find(text)]
    assert find("here two words, and two words") == [("a", 0, 14)]
    assert find("two wordsx and xtwo words") == [] and find("two word") == []
    assert find("two words") == [("a", 0, 9)] and find("y" + "x" * 30 + " end") == []
    assert find("cafe é") == [("c", 0, 6)] and find("café") == [] and find("a(k)b") == [("d", 0, 4)]


def test_sum_of_squares_rule():
    r = np.random.default_rng(4)
    for _ in range(30):
        capacity = int(r.integers(5, 40))
        lengths = r.integers(1, capacity + 1, 60)
        bins, offsets = packing.sum_of_squares(lengths, capacity)
        gaps, place = [], {}
        for i in np.argsort(-lengths, kind="stable"):
            square = lambda g: sum(g.count(x) ** 2 for x in set(g) if 0 < x < capacity)
            choices = [(square([*gaps[:b], g - lengths[i], *gaps[b + 1 :]]), 0, g) for b, g in enumerate(gaps) if g >= lengths[i]]
            best = min([*choices, (square([*gaps, capacity - lengths[i]]), 1, 0)])
            if best[1]:
                gaps.append(capacity - lengths[i])
            else:
                gaps[gaps.index(best[2])] -= lengths[i]
            place[i] = best[2] or capacity
        assert len(gaps) == bins.max() + 1
        assert all(capacity - offsets[i] == place[i] for i in place)


# -- languages

def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null").cache()
    model = language.fit_languages(docs.where("doc_id % 4 != 2"))
    found = language.identify(docs.where("doc_id % 4 = 2"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = sum(r["lang_pred"] == r["lang"] for r in found)
    assert right / len(found) > 0.97
    assert sum(r["accepted"] for r in found) / len(found) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_odd_rows(spark):
    train = spark.createDataFrame([(1, "the cat and the dog " * 9, "en"), (2, "der hund und die katze " * 9, "de"), (3, "x", None), (4, None, "fr"),
                                   (5, "the dog and the cat " * 9, "en")], "doc_id long, text string, lang string")
    model = language.fit_languages(train)
    assert list(model.dictionaries) == ["en", "de"]
    rows = [(1, "The cat, the dog!"), (None, "Der Hund und die Katze"), (3, None), (4, ""), (5, "12 + 3"), (1, "The cat, the dog!")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang_pred int")
    got = language.identify(docs, model).collect()
    assert [r["lang_pred"] for r in got] == ["en", "de", "und", "und", "und", "en"]
    assert got[0] == got[5]
    kept = language.keep_identified(docs, model)
    assert [r["text"] for r in kept.collect()] == [rows[0][1], rows[1][1], rows[5][1]] and kept.columns == docs.columns
    assert {r["lang_pred"] for r in language.identify(docs, language.fit_languages(train.where("false"))).collect()} == {"und"}
    assert language.identify(docs.where("false"), model).count() == 0
