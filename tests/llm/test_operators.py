"""Each operator against SQL, a library or brute force, and on nulls, empty texts, ties, repeated
rows, empty tables and clashing column names."""

import itertools
import random
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm.bpe_codec import bpe_digests, bpe_encode_decode
from tessera.llm.components import components
import tessera.llm.decontaminate as dc
from tessera.llm.decontaminate import decontaminate
from tessera.llm.embedding_dedup import embedding_dedup
from tessera.llm.hmm_lm import Model, Vocabulary, expected_counts, hmm_scores, log_likelihoods
from tessera.llm.html_text import extract_text, main_text
from tessera.llm.line_dedup import dropped_lines, line_dedup
from tessera.llm.ngram_join import ngram_jaccard_join, shingles
from tessera.llm.queries import ORACLE_SQL, QUERIES, URL_RULES
from tessera.llm.token_counts import token_counts
from tessera.llm.toxicity import GRAMMAR, INSULT, NEGATION, OTHER, REPORT, TARGET, THREAT, Lexicon, toxicity
from tessera.llm.url_filter import rules_table, url_filter
from tests.compare import duck, same

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  ", "a  b \n c", "<|endoftext|>x <|startoftext|>", "ΑΣ it's", "é ẞ \x1c y", "aaaaaaaaa aaaa", "word " * 30_000, "日本 😀!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "row", "hash", "class", 1) for i, t in enumerate(ODD)] + [(1, "", "a", "b", "c", 2), (3, ODD[3], "a", "b", "c", 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, row string, hash string, class string, pos int")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    same(QUERIES[name](spark, SF), duck(SF), ORACLE_SQL[name])


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_token_counts(docs):
    own = library(BYTES)
    for r in token_counts(docs, BYTES).collect():
        text = ODD[r.doc_id] or ""
        n = len(own.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)


def test_bpe(spark, docs):
    own = library(WORDS)
    for r in bpe_encode_decode(docs, WORDS).collect():
        ids = own.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == own.decode(ids, skip_special_tokens=False)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in table.collect()}
    for r in bpe_digests(table, WORDS).collect():
        ids = own.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.com/en/x?y"), (4, "https://www.example.com/en/"), (5, "ftp://x.net/fr/#a"), (6, "http://net"), (6, "http://net"), (7, "http://notexample.com/en/1"), (8, "http://example.org/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    found = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, rules_table(spark, URL_RULES)).collect())
    assert found[0] == (1, "", "", None, "allow") and found[2] == (3, "a.example.com", "/en/x", "example.com/en/", "block")
    assert found[3][3:] == ("www.example.com/en/", "allow") and found[4][3:] == ("net/fr/", "block") and found[5] == found[6] == (6, "net", "", None, "allow")
    assert found[7][3:] == ("com/", "allow") and found[8][3] is None
    assert url_filter(pages.limit(0), rules_table(spark, URL_RULES)).count() == 0
    assert url_filter(pages, rules_table(spark, [])).where("verdict = 'allow'").count() == len(rows)


def brute(texts):
    sets = [set(shingles(t or "").tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return sets, label


def test_ngram_join_on_chains(spark):
    """A group whose members are mostly too far from each other, linked in chains."""
    random = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = [None, "", "a b", "A  B", " ".join(base), " ".join(base)]
    now = list(base)
    for _ in range(60):
        now = list(now) if random.random() < 0.7 else list(base)
        for _ in range(1 + int(random.random() * 2)):
            now[random.integers(60)] = f"x{random.integers(40)}"
        texts.append(" ".join(now))
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"q{k}_{i}" for i in range(12)) for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets, label = brute(texts)
    found = {r.doc_id: r for r in ngram_jaccard_join(docs).collect()}
    assert [found[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [found[i].component_id for i in range(len(texts))] == label
    assert ngram_jaccard_join(docs.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i != 14] + [(7, 7), (20, 25), (None, 3)], "u bigint, v bigint")
    assert {r.node: r.comp for r in components(edges).collect()} == {i: 0 if i < 15 else 15 for i in range(31)}


def test_embeddings_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [0.0, 1.0]), (8, [None, 1.0]), (1, [1.0, 0.0]), (9, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = sorted(map(tuple, embedding_dedup(vectors).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert found[:3] == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False)] and found[3] == (3, 3, 1, False)
    assert all(f[1:] == (0, f[0], True) for f in found[4:])
    assert embedding_dedup(vectors.limit(0)).count() == 0


def test_line_dedup_edges(spark, docs):
    line = "one two three four five six seven eight nine"
    rows = [(1, f"{line}\nshort one\nshort one"), (2, f" {line.upper()} \nother words stand here alone"), (3, line.replace("five", "5")), (4, line.replace("five ", "")), (5, line.replace("five", "x").replace("two", "y")), (None, line), (6, None), (7, "")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("drop", F.lit("x"))
    found = {r.doc_id: r for r in line_dedup(table).collect()}
    assert len(found) == len(rows) and found[1].text == f"{line}\nshort one" and found[2].text == "other words stand here alone"
    assert found[3].line_dedup.emptied and found[4].line_dedup.emptied and not found[5].line_dedup.emptied
    assert found[None].text == line and found[6].text is None and found[6].line_dedup.n_lines == 0 and found[7].line_dedup.n_lines == 0
    assert line_dedup(docs).count() == docs.count() and line_dedup(docs.limit(0)).count() == 0


def test_pipeline_drops_short_lines(spark):
    """Equal lines of a few words, of one long word and of none, in and across documents."""
    import corpus_pipeline

    url = "https://example.org/" + "x" * 80
    rows = [
        (1, f"First here\n\nAll rights reserved.\n{url}\n\n\r\n日本語の文章です。"),
        (2, f"\n\r\nSecond here\n  all rights RESERVED. \n\nThird\nthird\n{url}"), (3, "日本語の文章です。\n\nown"),
        (4, f"All rights reserved.\n{url}"), (None, "First here"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text"))
    seen, expected = set(), {None: rows[-1][1]}
    for i, text in rows[:-1]:
        kept = []
        for line in text.split("\n"):
            key = line.strip(" ").lower()
            if not key.strip() or key not in seen:
                kept.append(line)
            seen.add(key)
        if "".join(kept).strip():
            expected[i] = "\n".join(kept)
    assert expected[2] == "\n\r\nSecond here\n\nThird" and expected[3] == "\nown" and 4 not in expected
    found = corpus_pipeline.drop_lines(spark, docs, "").collect()
    assert {r.doc_id: r.text for r in found} == expected and all(r.n_chars == len(r.text) for r in found)


def test_decontaminate_edges(spark, docs):
    long = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, long), (2, "tiny item"), (3, None), (4, "..."), (None, long), (1, "more words")], "item_id bigint, text string")
    table = spark.createDataFrame([(1, f"x {long} y Tiny-Item tiny item"), (2, "tiny"), (3, None), (1, "w1 w2 w3 w4 w5 w6 w7 W8!")], "doc_id bigint, text string")
    found = sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate(table, items).collect())
    assert found == [(1, 8, 8, ("1",), False), (1, 26, 24, ("1", "2"), True), (2, 1, 0, (), False), (3, 0, 0, (), False)]
    assert decontaminate(docs, items.limit(0)).where("n_items > 0").count() == 0
    assert decontaminate(docs.limit(0), items).count() == 0


def brute_hits(text, items, size=8):
    """Hit words and items of a text, by comparing every window with every place."""
    split = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()
    words, hit, names = split(text), set(), set()
    for name, item in items:
        own = split(item)
        n = min(size, len(own))
        for start in range(len(own) - n + 1) if n else ():
            for at in range(len(words) - n + 1):
                if words[at : at + n] == own[start : start + n]:
                    hit |= set(range(at, at + n))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


def test_decontaminate_against_brute_force(spark):
    """A small vocabulary, so that shingles repeat within and across windows; ids are strings, and
    columns clash with the operator's own names."""
    rng = random.Random(11)
    draw = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    items = [(f"i{k}", draw(rng.choice([1, 2, 3, 5, 8, 9, 14]))) for k in range(25)] + [("i0", draw(12)), ("x", "")]
    rows = [(f"d{k}", draw(rng.choice([0, 1, 3, 7, 8, 20, 200])), 1, 2, 3) for k in range(40)]
    rows += [(f"e{k}", draw(5) + ", " + items[k % 25][1].upper() + "; " + draw(5), 1, 2, 3) for k in range(25)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, id int, row int, places int")
    table = spark.createDataFrame(items, "item_id string, text string")
    for r in decontaminate(docs, table).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(text, items), r.doc_id


def test_embeddings_against_brute_force(spark):
    """Three lengths, scaled by very large and small numbers, around the threshold, over several blocks."""
    import tessera.llm.embedding_dedup as ed

    rng = np.random.default_rng(1)
    rows = []
    for width in (3, 64, 5):
        for base in rng.normal(size=(40, width)):
            for _ in range(rng.integers(1, 6)):
                near = base + rng.normal(size=width) * rng.choice([0, 0.2, 0.33]) * np.linalg.norm(base) / np.sqrt(width)
                rows.append((len(rows), (near * rng.choice([1, 2, 1e-200, 1e200])).tolist()))
    by_width, links, label = {}, np.zeros(len(rows), int), np.arange(len(rows))
    for i, v in rows:
        by_width.setdefault(len(v), []).append(i)
    for at in by_width.values():
        x = np.array([np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in at])
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= 0.95
        np.fill_diagonal(near, False)
        links[at] = near.sum(1)
        i, j = (np.array(at)[k] for k in np.nonzero(near))
        for _ in range(20):
            np.minimum.at(label, i, label[j])
    expected = [(i, links[i], label[i]) for i in range(len(rows))]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("id", F.lit(1)).withColumn("raw", F.lit("x"))
    before = ed.ALONE, ed.BLOCK_BYTES
    try:
        for ed.ALONE, ed.BLOCK_BYTES in (before, (4, 3000)):
            found = embedding_dedup(vectors).select("vec_id", "n_links", "component_id").collect()
            assert sorted(map(tuple, found)) == expected
    finally:
        ed.ALONE, ed.BLOCK_BYTES = before
    assert sum(links) > 100


def test_tiles_find_all_links():
    import tessera.llm.embedding_dedup as ed

    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 24))
    x[300:] = x[:400] + 0.06 * rng.normal(size=(400, 24))
    side = ed.Side(x, None)
    pairs = {(min(p, q), max(p, q)) for i, j in ed.tiles_linked(side, side, 0.95, True) for p, q in zip(side.order[i].tolist(), side.order[j].tolist(), strict=True)}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    assert pairs == set(zip(i.tolist(), j.tolist(), strict=True)) and len(pairs) >= 300


def test_words_by_batches():
    """Hashes against splitting with Python, over slices that cut long texts and long words."""
    import pyarrow as pa

    import tessera.llm.words as W

    rng = random.Random(4)
    texts = [None, "", "  ", "A b\tC", "x" * 3000, " " * 3000, "é ẞ 日本", "a\x00b \x1c c"]
    texts += ["".join(rng.choice("abc  \n.é") for _ in range(rng.choice([5, 100, 2000]))) for _ in range(40)]
    before = W.SLICE
    try:
        for W.SLICE in (before, 64, 1000):
            for separators, split in ((W.SPACE, lambda t: t.encode().lower().split()), (W.NOT_ALNUM, lambda t: t.encode().translate(dc.LOWER).split())):
                words = W.words_of(pa.array(["skipped", *texts], pa.string())[1:], separators)
                seen = {}
                for k, text in enumerate(texts):
                    own = range(int(words.first[k]), int(words.first[k + 1]))
                    assert [words.text(i, i + 1).lower() for i in own] == split(text or "")
                    for i in own:
                        assert seen.setdefault(words.text(i, i + 1).lower(), words.hashes[i]) == words.hashes[i]
                assert len(set(seen.values())) == len(seen)
    finally:
        W.SLICE = before


def test_line_dedup_of_repeated_ids_and_clashing_columns(spark):
    rows = [(1, "a b c d e f g h i"), (1, "a b c d x y z w v"), (2, "a b c d e f g h j"), (2, "z b c d x y z w v"), (3, "a b c d e f g h i\nown")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in ("line_dedup", "line_dedup_text", "line_dedup_drop", "row", "kept", "key", "drop"):
        table = table.withColumn(name, F.lit("mine"))
    out = line_dedup(table)
    assert out.columns == [c for c in table.columns if c != "line_dedup"] + ["line_dedup"]
    found = Counter((r.doc_id, r.text, r.row, r.line_dedup.n_dropped) for r in out.collect())
    assert found == Counter([(1, rows[0][1], "mine", 0), (1, rows[1][1], "mine", 0), (2, "", "mine", 1), (2, "", "mine", 1), (3, "own", "mine", 1)])


def test_line_dedup_against_brute_force(spark):
    """Words inserted, deleted and replaced at any place, of even and odd lengths."""
    rng = random.Random(8)
    lines = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(7, 11))]
        for _ in range(9):
            words, at = list(base), rng.randrange(len(base))
            words[at : at + rng.randint(0, 1)] = rng.choice([[], [f"n{rng.randint(0, 3)}"]])
            lines.append(" ".join(words))
    lines += ["one two", "one two", "One  two", "", " ", "one"]
    rng.shuffle(lines)

    def within(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    words = [line.strip(" ").lower().split(" ") for line in lines]
    dropped = {i for i, line in enumerate(lines) if line.strip() and any(lines[j].strip() and within(words[j], words[i]) for j in range(i))}
    docs = spark.createDataFrame([(k, "\n".join(lines[3 * k : 3 * k + 3])) for k in range(len(lines) // 3 + 1)], "doc_id bigint, text string")
    found = {(r.doc, r.pos) for r in dropped_lines(docs).collect()}
    assert found == {(i // 3, i % 3) for i in dropped} and len(found) > 40


def test_ids_of_other_types(spark):
    """Ids are strings in every operator that joins."""
    rows = [("b", "one two three four five six seven eight nine"), ("a", "one two three four five six seven eight nine"), (None, "x"), ("c", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = {r.doc_id: r.component_id for r in ngram_jaccard_join(docs).collect()}
    assert found == {"a": "a", "b": "a", "c": "c", None: None}
    vectors = spark.createDataFrame([("q", [1.0, 2.0]), ("p", [2.0, 4.0]), (None, [1.0, -2.0])], "vec_id string, embedding array<float>")
    assert {r.vec_id: (r.component_id, r.n_links) for r in embedding_dedup(vectors).collect()} == {"q": ("p", 1), "p": ("p", 1), None: (None, 0)}
    assert hmm_scores(docs).schema["doc_id"].dataType.simpleString() == "string" and hmm_scores(docs).count() == 4


def test_html():
    page = "<body><header><h1>Site</h1></header><div class='sidebar'><p>Side, text here.</p></div><div><h2>T &amp; x</h2><p>One, two,\n three. Long enough.<p>B<ul><li>i<li>j</ul><script>'</p>'</script></div><section id=comments><p>A long comment, really, longer than all the rest of this page.</p></section><form>f</form><footer>c</footer>"
    assert main_text(page) == "T & x\nOne, two, three. Long enough.\nB\ni\nj"
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""


def test_html_keeps_content_outside_the_largest_part():
    long = "A long paragraph, with commas, and full stops. It goes on, and on. " * 8
    own = " ".join(long.split())
    page = f"<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>The lead.</p><div><p>{long}</p><p>{long}</p></div></article><footer>c</footer></body>"
    assert main_text(page) == f"T\nThe lead.\n{own}\n{own}"
    page = f"<body><section><h2>One</h2><p>{long * 6}</p></section><section><h2>Two</h2><p>{long}</p></section><aside><p>{long}</p></aside></body>"
    assert main_text(page) == "One\n" + " ".join((long * 6).split()) + f"\nTwo\n{own}"
    page = f"<article><h1>Title</h1><p>Before, it says.</p><ul>{'<li>' + long}{'<li>' + long}</ul><p>After, it ends.</p></article>"
    assert main_text(page) == f"Title\nBefore, it says.\n{own}\n{own}\nAfter, it ends."
    page = f"<article><p>{long}</p><table><tr><td>{long * 9}<td>Small, but content. {long}</table></article>"
    assert main_text(page).startswith(own + "\n")


def labelled_pages():
    """Pages of several layouts, with the blocks that are their main text."""
    rng = random.Random(6)
    words = "time year people way day man thing woman life child world school state family student group country problem hand part".split()

    def prose(n):
        out = []
        while len(out) < n:
            own = [rng.choice(words) for _ in range(rng.randint(4, 14))]
            out += [" ".join(own).capitalize() + rng.choice([".", ".", "?", ", and so on."])]
        return " ".join(out)

    menu = "<ul>" + "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in words[:8]) + "</ul>"
    for k in range(60):
        title, lead, item = f"Title {k} of the page", f"A short lead {k}.", f"item {k}"
        texts = [prose(rng.randint(2, 9)) for _ in range(rng.randint(2, 7))]
        body = "".join(f"<p>{t}</p>" for t in texts)
        ad, note = "<div class='ad'>Buy now, it is cheap. Only today, for you!</div>", "<div id=cookie-banner><p>We use cookies, as all do. Accept?</p><button>OK</button></div>"
        comments = "<section id='comments'><h3>Comments</h3>" + "".join(f"<div class='comment-body'><p>{prose(4)}</p></div>" for _ in range(rng.randint(1, 9))) + "</section>"
        side = f"<div class='sidebar'><h4>Latest</h4><p>{prose(2)}</p>{menu}</div>"
        foot = "<footer><p>© 2024 Example, all rights reserved.</p></footer>"
        truth = [title, lead, *texts]
        article = f"<h1>{title}</h1><p class='lead'>{lead}</p>{body}"
        yield from [
            (f"<html><body><nav>{menu}</nav><article>{article}</article>{side}{comments}{foot}</body></html>", truth),
            (f"<body><div id=top>{menu}</div>{note}<div class='post'><div class='entry'>{article}{ad}</div>{comments}</div>{side}{foot}</body>", truth),
            (f"<body><form action='/page.aspx'><div class='menu'>{menu}</div><div class='content'>{article}</div>{foot}</form></body>", truth),
            (f"<body><nav>{menu}</nav><article>{article}<div class='news-alert'><p>{texts[0]}</p></div></article>{foot}</body>", [*truth, texts[0]]),
            (f"<body>{note}<div id='search-engines'>{article}</div>{ad}{foot}</body>", truth),
            (f"<body class='has-sidebar'><header><h2>Site</h2>{menu}</header><main><header><h1>{title}</h1></header><p>{lead}</p><section>{body}<ul><li>{item}</li><li>{item}</li></ul></section></main>{side}{foot}</body>", [title, lead, *texts, item, item]),
            (f"<body><table><tr><td class='nav'>{menu}</td><td><h1>{title}</h1><p>{lead}" + "".join(f"<p>{t}" for t in texts) + f"</td></tr></table><div class='related-posts'>{menu}</div></body>", truth),
            (f"<body><article><h1>{title}</h1><form class='newsletter'><p>Your mail, please. It is free.</p><input></form><p>{lead}</p><div><div>{body}</div></div><blockquote>{item}</blockquote></article>{side}</body>", [*truth, item]),
        ]


def test_html_on_labelled_pages():
    found = expected = both = 0
    worst = {}
    for k, (page, truth) in enumerate(labelled_pages()):
        own, wanted = Counter(main_text(page).split("\n")), Counter(truth)
        hit = sum(len(t) * n for t, n in (own & wanted).items())
        size = lambda c: sum(len(t) * n for t, n in c.items())
        found, expected, both = found + size(own), expected + size(wanted), both + hit
        sums = worst.setdefault(k % 8, [0, 0, 0])
        worst[k % 8] = [sums[0] + size(own), sums[1] + size(wanted), sums[2] + hit]
    assert both / found >= 0.95 and both / expected >= 0.95, worst
    assert all(h / f >= 0.9 and h / e >= 0.9 for f, e, h in worst.values()), worst


def test_html_edges(spark):
    assert main_text("<div>" * 30_000 + "<p>Deep, but here.") == "Deep, but here."
    assert main_text("plain text, no tags at all") == "plain text, no tags at all"
    assert main_text("</p></div>x<nav>a</nav>") == "x"
    pages = spark.createDataFrame([("k", None, "<p>a, b.</p>", 1), (None, "u", "", 2), ("k", "u", None, 3)], "page_id string, url string, html string, text int")
    assert sorted((r.page_id or "", r.text, r.n_chars) for r in extract_text(pages).collect()) == [("", "", 0), ("k", "", 0), ("k", "a, b.", 5)]
    assert extract_text(pages.limit(0)).count() == 0


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", "<article><p>Hello, you.</p></article>")], "page_id bigint, url string, html string")
    assert sorted((r.text, r.n_chars) for r in extract_text(pages).collect()) == [("", 0), ("Hello, you.", 11)]


def test_grammar_weighs_clauses():
    plain = GRAMMAR([(INSULT, 2.0)])
    assert GRAMMAR([(TARGET, 1.0), (INSULT, 2.0)]) > plain > GRAMMAR([(NEGATION, 1.0), (INSULT, 2.0)]) > 0
    assert GRAMMAR([(REPORT, 1.0), (INSULT, 2.0)]) < plain
    assert GRAMMAR([(THREAT, 1.0)]) == 0 < GRAMMAR([(THREAT, 1.0), (TARGET, 1.0)]) + GRAMMAR([(TARGET, 1.0), (THREAT, 1.0)])


def test_grammar_takes_targets_on_either_side():
    target, threat, insult, other = (TARGET, 1.0), (THREAT, 1.0), (INSULT, 2.0), (OTHER, 0.0)
    before, after = GRAMMAR([target, other, threat]), GRAMMAR([threat, other, target])
    assert before == after == 1.5 == GRAMMAR([target, threat, target])
    assert GRAMMAR([threat, other, threat, target]) == 2 * after
    assert GRAMMAR([threat, other, other, other, other, target]) == 0
    assert GRAMMAR([insult, target]) == GRAMMAR([target, insult]) == 1.5 * GRAMMAR([insult])
    assert GRAMMAR([(NEGATION, 1.0), threat, target]) == 0.4 * after and GRAMMAR([(REPORT, 1.0), threat, target]) == 0.5 * after
    own = Lexicon({})
    assert own.features("we will kill you")[2] > 0 and own.features("we will kill time") == (0, 0, 0)


def test_toxicity(spark, docs):
    clean = [(i, f"the word number {i} is fine here") for i in range(80)]
    bad = [(i, f"the word number {i} you are such an idiot and scum") for i in range(80, 120)]
    table = spark.createDataFrame(clean + bad, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i >= 80)) for i in range(120)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    found = toxicity(table, labels).collect()
    assert all(r.predicted == int(r.doc_id >= 80) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert toxicity(docs, labels.limit(0)).count() == docs.count() and toxicity(docs.limit(0), labels).count() == 0


def test_grammar_against_rules():
    """The cascade against the rules it stands for, on all short clauses."""
    weights = {INSULT: 2.0, THREAT: 1.0}
    for n in range(1, 6):
        for clause in itertools.product((OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT), repeat=n):
            total = 0.0
            for i, symbol in enumerate(clause):
                if symbol not in weights:
                    continue
                aimed = TARGET in clause[max(0, i - 5) : i] or TARGET in clause[i + 1 : i + 5]
                near = TARGET in clause[max(0, i - 4) : i] or TARGET in clause[i + 1 : i + 5]
                if symbol == THREAT and not near:
                    continue
                own = weights[symbol] * (1.5 if aimed else 1.0)
                own *= 0.4 if NEGATION in clause[max(0, i - 3) : i] else 1.0
                own *= 0.5 if REPORT in clause[max(0, i - 8) : i] else 1.0
                total += own
            assert np.isclose(GRAMMAR([(s, weights.get(s, 1.0)) for s in clause]), total), clause


def test_toxicity_on_held_out_rows(spark):
    """What no sample can teach by heart: recall and false alarms by language on held-out labels."""
    folder = "/root/testdata/sf0.1"
    labels, docs = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "documents"))
    found = toxicity(docs, labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "toxic").agg(F.sum("predicted").alias("hits"), F.count("*").alias("n")).collect()
    sums = {(r["lang"], r.toxic): (r.hits, r.n) for r in found}
    assert all(hits >= 0.8 * n for (_, toxic), (hits, n) in sums.items() if toxic), sums
    assert sum(h for (_, t), (h, _) in sums.items() if t) >= 0.93 * sum(n for (_, t), (_, n) in sums.items() if t), sums
    assert all(hits <= 0.03 * n for (_, toxic), (hits, n) in sums.items() if not toxic), sums


def test_toxicity_of_labels_of_one_kind_and_clashing_columns(spark):
    docs = spark.createDataFrame([("a", "you idiot", 1, 2), ("a", None, 1, 2), (None, "fine", 1, 2)], "doc_id string, text string, held_out int, score int")
    for label in (0, 1):
        labels = spark.createDataFrame([("a", label), ("a", label), (None, 1)], "doc_id string, toxic int")
        found = toxicity(docs, labels).collect()
        assert len(found) == 3 and all(0 <= r.score <= 1 for r in found) and max(found, key=lambda r: r.score).doc_id == "a"


def test_hmm_recursions():
    """Scaled recursions against sums over all paths."""
    from itertools import product

    random = np.random.default_rng(1)
    import tessera.llm.hmm_lm as lm

    model = Model(random.random(lm.STATES), random.random((lm.STATES, lm.STATES)), random.random((lm.STATES, Vocabulary.CLASSES)))
    sequence = np.array([3, 5, 3])
    total, moves = 0.0, np.zeros((lm.STATES, lm.STATES))
    for path in product(range(lm.STATES), repeat=3):
        p = model.start[path[0]] * model.by_class[3, path[0]]
        for t in (1, 2):
            p *= model.moves[path[t - 1], path[t]] * model.by_class[sequence[t], path[t]]
        total += p
        for t in (1, 2):
            moves[path[t - 1], path[t]] += p
    flat, first = np.concatenate([sequence[:1], sequence]), np.array([0, 1, 4])
    assert np.isclose(log_likelihoods(model, flat, first)[1], np.log(total))
    start, found, emits, score = expected_counts(model, sequence, np.array([0, 3]))
    assert np.allclose(found, moves / total) and np.isclose(start.sum(), 1) and np.isclose(emits.sum(), 3) and np.isclose(score, np.log(total))
    # in pieces, as a whole
    lengths = [1, 7, 8, 9, 40, 23, 16]
    flat, first = random.integers(0, 50, sum(lengths)), np.concatenate([[0], np.cumsum(lengths)])
    whole = log_likelihoods(model, flat, first), expected_counts(model, flat, first)
    before = lm.PIECE
    try:
        for lm.PIECE in (8, 3, 1):
            assert np.allclose(log_likelihoods(model, flat, first), whole[0])
            for x, y in zip(expected_counts(model, flat, first), whole[1], strict=True):
                assert np.allclose(x, y)
    finally:
        lm.PIECE = before
    assert np.isclose(whole[1][1].sum(), sum(lengths) - len(lengths)) and np.isclose(whole[1][0].sum(), len(lengths))


def _baum_welch(model, sequences):
    """Expected counts by plain recursions, a token at a time."""
    states, classes = model.by_class.shape[1], len(model.by_class)
    start, moves, emits, score = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes)), 0.0
    for seq in sequences:
        alpha, scale = [], []
        for t, c in enumerate(seq):
            now = (model.start if t == 0 else alpha[-1] @ model.moves) * model.by_class[c]
            scale.append(now.sum())
            alpha.append(now / scale[-1])
        beta = [np.ones(states)]
        for t in range(len(seq) - 1, 0, -1):
            beta.insert(0, model.moves @ (model.by_class[seq[t]] * beta[0]) / scale[t])
        start += alpha[0] * beta[0]
        for t, c in enumerate(seq):
            emits[:, c] += alpha[t] * beta[t]
            if t:
                moves += np.outer(alpha[t - 1], model.by_class[c] * beta[t] / scale[t]) * model.moves
        score += np.log(scale).sum()
    return start, moves, emits, score


def test_hmm_end_to_end_against_brute_force(spark, monkeypatch):
    """The trained model and every score against plain recursions over whole texts."""
    import pyarrow as pa

    import tessera.llm.hmm_lm as lm

    random = np.random.default_rng(3)
    lexicon = ["".join(random.choice(list("abcdeé"), random.integers(4, 9))) for _ in range(20_000)]
    # more words than have classes of their own
    some = lambda n: np.where(random.random(n) < 0.75, random.integers(0, 20_000, n), random.pareto(0.8, n).clip(0, 4000))
    texts = [" ".join(lexicon[int(i)] for i in some(random.integers(0, 110))) for _ in range(170)] + [None, "", " never\tSeen ", "A a"]
    rows = list(enumerate(texts))
    trains = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    split = lambda t: (t or "").lower().split()
    counts = Counter(w for i, t in rows if trains(i) for w in [*split(t), "\n"])
    kept, real = {}, lm.train

    def spy(training, vocabulary, **more):
        kept["vocabulary"], kept["model"] = vocabulary, real(training, vocabulary, **more)
        return kept["model"]

    monkeypatch.setattr(lm, "train", spy)
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    for frequent in (50, 1 << 18):
        found = {r.doc_id: r for r in lm.hmm_scores(table, frequent=frequent).collect()}
        assert set(found) == set(range(len(rows)))
        coded = {i: kept["vocabulary"].coded(pa.array([t or ""]))[2].tolist() for i, t in rows}
        learned = [coded[i] for i, _ in rows if trains(i)]
        model, before = lm.Model.first(np.concatenate(learned)), None
        for _ in range(lm.START_ROUNDS):
            model = lm.Model(*_baum_welch(model, learned)[:3])
        for _ in range(lm.ROUNDS):
            *new, score = _baum_welch(model, learned)
            model, score = lm.Model(*new), score / sum(map(len, learned))
            if before is not None and score - before < lm.SETTLED:
                break
            before = score
        for name in ("start", "moves", "by_class"):
            assert np.allclose(getattr(kept["model"], name), getattr(model, name), rtol=1e-5, atol=1e-9)
        # a class is one word's own, or shares its weight by counts plus one, and one for the unseen
        of = {w: c for i, t in rows for w, c in zip([*split(t), "\n"], coded[i], strict=True)}
        mass = Counter()
        for w, c in counts.items():
            mass[of[w]] += c + 1
        alone = {c for c in mass if c < lm.OWN or c == lm.OWN + lm.ENDINGS}
        assert all(sum(of[w] == c for w in counts) == 1 for c in alone) and any(c not in alone for c in mass)
        for i, t in rows:
            total, state = 0.0, None
            for w, c in zip([*split(t), "\n"], coded[i], strict=True):
                state = (model.start if state is None else state @ model.moves) * model.by_class[c]
                total += np.log10(state.sum()) + (0 if c in alone else np.log10((counts[w] + 1) / (mass[c] + 1)))
                state = state / state.sum()
            assert np.isclose(found[i].score, total, rtol=1e-5), (i, found[i].score, total)


def test_hmm_scores(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    rows = table.collect()
    split = lambda t: (t or "").encode().lower().split() + [b"\n"]
    counts = Counter(w for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for w in split(r.text))
    n, v = sum(counts.values()), len(counts)
    text = {(r.doc_id, len(split(r.text))): split(r.text) for r in rows}
    for frequent in (50, 1 << 18):  # most words meet their counts in the join, or none
        found = hmm_scores(table, frequent=frequent).collect()
        assert len(found) == len(rows)
        for r in found:
            words = text[r.doc_id, r.n_tokens]
            assert r.train_tokens == n and r.n_known == sum(counts[w] > 0 for w in words)
            assert np.isclose(r.base_score, sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert sum(r.score for r in found) > sum(r.base_score for r in found)
    assert hmm_scores(table.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_pipeline_drops_documents_with_one_passage(spark, tmp_path):
    """The stage's decisions against a search for each window of each item."""
    import corpus_pipeline

    items = [(k, " ".join(f"i{k}x{n}" for n in range(12))) for k in range(3)] + [(3, "short item")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    one, two = items[0][1].split(), items[1][1].split()
    rows = [
        (1, "clean words only"), (2, f"a {' '.join(one)} b"), (3, f"a {' '.join(one[2:10])} b"), (4, f"a {' '.join(one[2:9])} b"),
        (5, " ".join(one + two)), (6, "A short, item!"), (7, "short"), (8, None), (None, " ".join(one)), (9, f"x {' '.join(two).upper()}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split()) + " "
    windows = set()
    for _, text in items:
        words = plain(text).split()
        windows |= {plain(" ".join(words[i : i + 8])) for i in range(max(1, len(words) - 7))}
    expected = {i for i, t in rows if i is None or not any(w in plain(t) for w in windows)}
    assert expected == {1, 4, 7, 8, None}
    assert {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()} == expected


def test_nothing_else_imports_this_subpackage():
    import pathlib

    top = pathlib.Path(__file__).parents[2] / "tessera"
    assert not [p for p in top.rglob("*.py") if "llm" not in p.parts and "tessera.llm" in p.read_text()]


def test_ngram_join_among_many_apart(spark):
    """Near copies at distances around the threshold, more apart from the pivot than are listed
    pair by pair: the components equal those of a comparison of all pairs."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(60), rng.randint(0, 3)):
            words[at] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets, least = [set(shingles(t).tolist()) for _, t in rows], list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(rows)), 2):
            if least[i] != least[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                least[i] = least[j] = min(least[i], least[j])
                changed = True
    assert {r.doc_id: r.component_id for r in ngram_jaccard_join(docs).collect()} == dict(enumerate(least))
    assert len(set(least)) > 17


def test_ngram_join_leaves_members_without_partners(spark, monkeypatch):
    """Texts that share a passage, most with too much of their own to be linked to any: the elements
    in which those differ from their pivot are not compared, and no link of the others is lost."""
    from tessera.llm import ngram_join

    rows, real = [], ngram_join._differing

    def counted(*args):
        met, posted = real(*args)
        rows.append(posted.count())
        return met, posted

    monkeypatch.setattr(ngram_join, "_differing", counted)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join(passage + [f"o{k}_{i}" for i in range(20)]) for k in range(200)]
    texts += [t.replace("_19", "_x") for t in texts[:30]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    _, label = brute(texts)
    assert {r.doc_id: r.component_id for r in ngram_jaccard_join(docs).collect()} == dict(enumerate(label))
    assert len(set(label)) == 200
    # 60 texts have a partner; each differs from a pivot in some 50 elements
    assert sum(rows) <= 60 * 60


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_around_centres(spark, monkeypatch, seed):
    """Bounds so low that nearly all goes around pivots and centres chosen by a few members: the
    components equal those of a comparison of all pairs."""
    from tessera.llm import ngram_join

    monkeypatch.setattr(ngram_join, "LISTED", 2)
    monkeypatch.setattr(ngram_join, "CENTRED", 4)
    rng, texts = random.Random(seed), []
    for group in range(3):
        base = [f"w{group}_{i}" for i in range(30)] + [f"p{i}" for i in range(20)]
        for _ in range(50):
            words = list(base)
            for at in rng.sample(range(50), rng.randint(0, 4)):
                words[at] = rng.choice([f"x{rng.randint(0, 9)}", f"own{len(texts)}_{at}"])
            texts.append(" ".join(words[: rng.randint(40, 50)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    _, label = brute(texts)
    assert {r.doc_id: r.component_id for r in ngram_jaccard_join(docs).collect()} == dict(enumerate(label))
    assert len(set(label)) > 3
