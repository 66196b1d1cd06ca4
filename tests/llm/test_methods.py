"""The methods beside the base counts, odd inputs, and the queries against their SQL."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, oracle_rows, rows
from conftest import SMALL

from cadenza.llm import bpe, chat, factorisation, near_copies, oracles, pages, personal_data, quality_rules, queries, vectors


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_agrees_with_sql(spark, name):
    cols, got = rows(queries.QUERIES[name](spark, SMALL))
    want_cols, want = oracle_rows(connect(SMALL), oracles.ORACLES[name])
    assert cols == want_cols and got == want


PLAIN = lambda p: pages.extract(nodes := pages.parse(p), [True] * len(nodes))


@pytest.mark.parametrize("page,text", [
    ('<p>One two.</p><p class=x">Three.</p><p>Five.</p>', "One two.\nThree.\nFive."), ("<a href='it's'>x</a> y<p>z", "x y\nz"), ("<p title=it's>a</p><p>b</p>", "a\nb"),
    ("<audio src=x><p>a</p><button>b<p>c</p>", "a\nb\nc"), ("<div x/>hello<p>w</div>q", "hello\nw\nq"), ("<script>a<b</script>c<style>x", "c"), ("<svg/><p>a</p><svg><title>t</title></svg>b", "a\nb"),
    ("</3>a</>b <3 c", "ab <3 c"), ("<button>ok</button>text<select><option>a</select>m", "text m"), ("<!-->x<!--a--!>y", "xy"), ('<p a="x>y">z</p>', "z"), ('<p a="x>y<p>q', "y\nq"), ("<object><canvas>one<p>two</p>", "one\ntwo"),
])
def test_parser_drops_nothing_else(page, text):
    assert PLAIN(page) == text


@pytest.mark.parametrize("page", ["<button>" * 20_000, "<button><p>" * 10_000 + "</button>", "<a title='" * 20_000, "<" * 50_000, "<!--" * 20_000, "<p>" + "x " * 200_000])
def test_parser_is_linear_on_odd_pages(page):
    pages.parse(page)


#: Pages of other makers than the test data's and the training's, and their main texts.
OTHER_PAGES = [
    ("<!doctype html><html><head><title>River news</title><style>p{}</style></head><body><div id=masthead><a href=/>River news</a></div><div class='nav main-nav'><ul><li><a href=/a>Home</a><li><a href=/b>Sport</a><li><a href=/c>Weather</a></ul></div>"
     "<div class='story-body article-text'><h1>Bridge opens after two years</h1><p>The new bridge across the river opened on Monday, two years after the first pillars were set.</p><p>Mayor &amp; council walked across it first, followed by several hundred people.</p>"
     "<h2>What comes next</h2><ul><li>The old ferry will stop in May, the operator said.</li><li>A cycle path follows in autumn, if the weather allows.</li></ul></div>"
     "<div class='sidebar widget'><h3>Most read</h3><ul><li><a href=/1>Storm on Friday</a></li><li><a href=/2>Train delays</a></li></ul></div><div class=footer><p>&copy; River news. All rights reserved.</p></div></body></html>",
     "Bridge opens after two years\nThe new bridge across the river opened on Monday, two years after the first pillars were set.\nMayor & council walked across it first, followed by several hundred people.\nWhat comes next\nThe old ferry will stop in May, the operator said.\nA cycle path follows in autumn, if the weather allows."),
    ("<html><body><header><h1>Kitchen notes</h1><nav><a href=x>Recipes</a> <a href=y>About</a></nav></header><main><article><h1>Bread without kneading</h1><p>Mix flour, water, salt and a little yeast in a bowl, and let it stand overnight.</p>"
     "<blockquote><p>Time does the work, not the hands.</p></blockquote><p>In the morning, fold the dough twice and bake it in a hot pot for forty minutes.</p></article></main>"
     "<section class=comments><h2>Comments</h2><div class=comment><p>Worked well for me, thanks a lot!</p></div></section><form action=/s><p>Subscribe to our letter</p><input><button>Go</button></form><footer><p>Imprint and privacy</p></footer></body></html>",
     "Bread without kneading\nMix flour, water, salt and a little yeast in a bowl, and let it stand overnight.\nTime does the work, not the hands.\nIn the morning, fold the dough twice and bake it in a hot pot for forty minutes."),
    ("<body><div class=cookie-notice>We use cookies to make this site work. <button>Accept</button></div><div class=wrap><div class='post entry'><h2>Release 4.2</h2><p>This version mends three faults in the parser, and is twice as fast on long lines.</p>"
     "<table><tr><td>Old<td>12 s</tr><tr><td>New<td>6 s</tr></table><p>Thanks to all who sent reports, tests and patches.</p></div><aside class=related><h4>Related</h4><ul><li><a href=q>Release 4.1</a></ul></aside></div><div class='ad promo'>Buy two and get three, only today!</div></body>",
     "Release 4.2\nThis version mends three faults in the parser, and is twice as fast on long lines.\nOld\n12 s\nNew\n6 s\nThanks to all who sent reports, tests and patches."),
]


def test_pages_of_other_makers(spark):
    table = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(OTHER_PAGES)], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in pages.extract_pages(table).collect()}
    hit = sum(len(set(got[i]) & set(t.split("\n"))) for i, (_, t) in enumerate(OTHER_PAGES))
    assert hit / sum(map(len, got.values())) >= 0.9 and hit / sum(len(t.split("\n")) for _, t in OTHER_PAGES) >= 0.9


def test_many_special_tokens_take_linear_time():
    w = bpe.WordBpe(queries.vocabulary("word_bpe_49k.json"))
    assert len(w.parts("<|endoftext|>" * 30_000)) == 30_000


def iban_ok(code):
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


@pytest.mark.parametrize("least", [0.5, 0.7])
def test_account_numbers_checksums_and_context(spark, least):
    good = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NL91ABNA0417164300"]
    rng = random.Random(4)
    texts = []
    for i in range(60):
        code = rng.choice([*good, "DE89370400440532013001", "GB82 WEST 1234 5698 7654 33", "XX00AAAABBBB"])
        texts.append("lorem " * rng.randrange(4) + rng.choice(["IBAN ", "my Konto: ", "ibanez ", "subiban ", "", "bank " + "x " * 40]) + code + rng.choice(["", " account", " end"]))
    pattern = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
    want = []
    for i, t in enumerate(texts):
        spans, best = [], 0.0
        for m in pattern.finditer(t):
            if iban_ok(m[0].replace(" ", "")):
                near = (t[max(0, m.start() - 48) : m.start()] + " " + t[m.end() : m.end() + 48]).lower()
                score = 0.8 if re.search(r"(?<![^\W\d_])(?:iban|bank|account|konto|compte|cuenta)", near) else 0.5
                if score >= least:
                    spans.append(f"iban:{m.start()}:{m.end()}")
                    best = max(best, score)
        want.append((i, ",".join(spans)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = personal_data.personal_data(docs, personal_data.PersonalData(min_score=least)).collect()
    shown = [(r.doc_id, ",".join(s for s in r.spans.split(",") if s.startswith("iban"))) for r in sorted(got, key=lambda r: r.doc_id)]
    assert shown == want and any(s for _, s in want)


def test_base_spans_stay_whatever_their_score(spark):
    docs = spark.createDataFrame([(1, "so 1.2.3.4 it is")], "doc_id long, text string")
    assert personal_data.personal_data(docs, personal_data.PersonalData(min_score=0.9)).first().spans == "ip:3:10"


def test_many_spans_keep_their_places(spark):
    text = " ".join(f"a{i}@b{i}.org" for i in range(3000))
    got = personal_data.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_email == 3000 and got.spans == ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"\S+", text))


def distance(counts, shares):
    p, q = np.array(counts, float) / sum(counts), np.array(shares)
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
    return max(0.0, (kl(p) + kl(q)) / 2) ** 0.5


def test_distances_and_length_guards(spark):
    english = "the cat and the dog of this house are in the garden with a ball that is for you as it was by now "
    texts = [english * 3, english * 1, "zork blip " * 40, "1234567890 " * 40, "#### ---- " * 40, "Der Hund und die Katze sind in dem Garten, das ist nicht ein Haus. " * 4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.quality_rules(docs).collect():
        words = texts[r.doc_id].lower().split()
        best = min(distance([*(words.count(w) for w in ws), len(words) - sum(words.count(w) for w in ws)], quality_rules.word_reference(x, 0.40)) for x, ws in quality_rules.COMMON_WORDS.items())
        assert r.word_distance == pytest.approx(best, abs=2e-6)
        guarded = len(words) >= 60 and r.word_distance > 0.44 or len(texts[r.doc_id]) >= 200 and (r.class_distance is None or r.class_distance > 0.17)
        assert r.kept == (not r.base_failed and not guarded)


def test_scores_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    model = factorisation.QualityModel(bits=6, rank=3)
    fm = factorisation.FactorisationMachine(0.1, rng.standard_normal(64 + factorisation.STATS), rng.standard_normal((64 + factorisation.STATS, 3)) * 0.3)
    texts = ["One two two, three!", "", None, "x " * 500]
    got = {r.doc_id: r.score for r in factorisation.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), fm, model).collect()}
    for i, t in enumerate(texts):
        index, value = factorisation.features(t, 6)
        margin = fm.bias + sum(fm.w[a] * x for a, x in zip(index, value))
        margin += sum(fm.v[index[a]] @ fm.v[index[b]] * value[a] * value[b] for a in range(len(index)) for b in range(a))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-5)


def test_repeated_ids_send_one_row_to_the_driver(spark):
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(500)] + [(2, "fine words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert factorisation.quality_scores(docs, labels).count() == 501


def test_drop_near_copies_keeps_different_texts_of_one_id(spark):
    long = " ".join(f"w{i}" for i in range(40))
    data = [(1, long, "a", 1), (1, "quite another text of its own", "b", 2), (2, long, "c", 3), (2, long, "c", 3), (3, "only once " * 9, "d", 4), (3, "only once " * 9, "d", 4), (None, long, "e", 5), (4, None, "f", 6), (5, "", "g", 7), (5, "", "g", 7)]
    docs = spark.createDataFrame(data, "doc_id long, text string, __id string, __keep int")
    got = sorted(map(tuple, near_copies.drop_near_copies(docs).collect()), key=repr)
    assert got == sorted([data[0], data[1], data[4], *data[6:]], key=repr)


def test_empty_and_clashing_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, score string, `key` int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert factorisation.quality_scores(docs, labels).count() == 0
    assert near_copies.drop_near_copies(docs).columns == docs.columns and near_copies.drop_near_copies(docs).count() == 0
    assert bpe.encode_documents(docs, queries.vocabulary("word_bpe_49k.json")).count() == 0
    table = spark.createDataFrame([(1, "u", "<p>Some words, and then some more.</p>", "x"), (1, "u", "<p>Some words, and then some more.</p>", "x")], "page_id long, url string, html string, text string")
    assert pages.extract_pages(table.limit(0)).count() == 0 and pages.extract_pages(table).count() == 2
    talk = spark.createDataFrame([(1, 0, "user", "x " * 100_000, 5), (1, 1, "assistant", "y", 6), (1, 1, "assistant", "y", 6)], "conv_id long, turn long, role string, text string, n_turns int")
    path = queries.vocabulary("byte_bpe_50k.json")
    assert chat.format_conversations(talk.limit(0), path).count() == 0
    got = chat.format_conversations(talk, path).first()
    assert got.n_turns == 3 and got.loss_sha256 == hashlib.sha256(b"yy").hexdigest()
    points = spark.createDataFrame([(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 2), (1, [1.0, 0.1], 3)], "vec_id long, embedding array<float>, rank int")
    assert {(r.query_id, r.vec_id) for r in vectors.nearest_neighbours(points).collect()} == {(0, 1)}


def test_pipeline_equals_its_stages_by_hand(spark):
    """The whole pipeline on a small table with odd rows: what goes, what stays, what changes."""
    import corpus_pipeline as p

    fine = "The river runs through the town and the people of the town walk by it in the evening, for it is calm and cool there. "
    body = fine + "A new bridge was built in the year of the flood, and it is the pride of all who live on this side. Write to me@x.org now, it is for you and for us as well."
    data = [(1, body), (2, body), (3, None), (4, ""), (5, "short text"), (6, body.replace("calm", "quiet")), (7, "&&& ### " * 40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES[:2]:
        docs = stage(spark, docs, SMALL)
    assert [r.doc_id for r in docs.collect()] == [1]
    hidden = p.STAGES[2][1](spark, docs, SMALL)
    assert hidden.first().text == body.replace("me@x.org", "<email>") and hidden.first().n_chars == len(hidden.first().text)
    mixed = p.STAGES[3][1](spark, hidden, SMALL)
    tokens = p.STAGES[4][1](spark, mixed, SMALL).collect()
    assert mixed.count() == len(tokens) == 1 and tokens[0].n_tokens > 50


def test_slices_of_a_batch_go_by_rows_and_bytes():
    texts = ["a" * 10, None, "b" * 100, "c", "", "d" * 30, "e" * 30, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text_id", "text"])
    found = [x.column(2).to_pylist() for x in near_copies._slices(batch, 3, 40)]
    assert sum(found, []) == texts
    assert found == [["a" * 10, None, "b" * 100], ["c", "", "d" * 30], ["e" * 30, None]]
    assert list(near_copies._slices(batch.slice(0, 0))) == []
    assert [x.num_rows for x in near_copies._slices(batch, 8, 20)] == [3, 3, 1, 1]
