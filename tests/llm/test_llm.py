"""Each operator against a brute-force version, on tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from conftest import SMALL

from cadenza.llm import boosting, bpe, chat, factorisation, licences, mixing, near_copies, pages, personal_data, quality_rules, queries, vectors

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, spans string, kept int"


@pytest.fixture(scope="module")
def docs(spark):
    odd = [
        (-1, None), (-2, ""), (None, "a null id"), (-3, "One two"), (-4, "one  TWO\n"), (-4, "one  TWO\n"), (-5, "x" * 5_000), (-6, "a b " * 10_000), (-7, "1 2 3 4 5 6 7 8 " * 5 + "\n\na\na\n"),
        (-8, "é🎉 x@y.z call +1 (555) 555-5555 4111 1111-1111 1111 DE89 3704 0044 0532 0130 00 1.2.3.4.5.6.7.8 300.1.1.1"), (-9, "7" * 8_000), (-10, "Under the MIT License, CC BY-NC cc by nc\x1capache license version 2"),
        (-11, "Hello  World's CAFÉ <|endoftext|> 123 \n日本 🎉 x</w>y <|startoftext|> İ ΣΑΣ ﬁ \x00"),
    ]
    extra = spark.createDataFrame([(i, t, None, None, 1, "w", "s", 1) for i, t in odd], SCHEMA)
    base = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("*", "'w' words", "'s' spans", "1 kept")
    return base.unionByName(extra).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_quality_rules_base(docs, texts):
    want = []
    for i, t in texts:
        w = WORD.findall(t)
        grams = collections.defaultdict(list)
        for k in range(len(w) - 7):
            grams[tuple(w[k : k + 8])].append(k)
        covered = {p + j for g in grams.values() if len(g) > 1 for p in g for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed))
    got = quality_rules.quality_rules(docs)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert counted(got.select(*cols).collect()) == counted(want)
    assert got.where("kept and base_failed").count() == 0


def test_quality_rules_keep_clean_and_reject_junk(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = quality_rules.quality_rules(spark.read.parquet(f"{SMALL}/documents.parquet")).join(labels, "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in got if r.quality == 1)
    bad = [r.kept for r in got if r.quality == 0]
    assert sum(bad) <= 0.1 * len(bad)


def test_kept_rows_keep_clashing_columns(docs):
    kept = quality_rules.kept_rows(docs)
    assert kept.columns == docs.columns
    assert kept.where("kept = 1 and words = 'w'").count() == kept.count() == quality_rules.quality_rules(docs).where("kept").count()


def test_js_distance_limits(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(quality_rules.js_distance(F.array(F.lit(1.0), F.lit(0.0)), [0.0, 1.0]).alias("far"), quality_rules.js_distance(F.array(F.lit(3.0), F.lit(1.0)), [0.75, 0.25]).alias("same")).first()
    assert row.far == pytest.approx(1) and row.same == pytest.approx(0, abs=1e-6)


def spans_of(t):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))] if k == 2 else []
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in double) % 10 == 0 or k == 3 and 10 <= len(digits) <= 15:
                out.append((m.start(), k, ("email", "ip", "card", "phone")[k], m.end()))
    return sorted(out)


def test_personal_data_base(docs, texts):
    want = []
    for i, t in texts:
        s = spans_of(t)
        want.append((i, *[sum(x[1] == k for x in s) for k in range(4)], hashlib.sha256(",".join(f"{x[2]}:{x[0]}:{x[3]}" for x in s).encode()).hexdigest()))
    got = personal_data.personal_data(docs)
    assert counted(got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()) == counted(want)
    assert "iban:" in got.where("doc_id = -8").first().spans


def test_redaction_leaves_no_base_span(docs):
    done = personal_data.redact(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    assert all(not spans_of(r.text) for r in done.where("text is not null").collect())
    assert done.where("doc_id = -1 and text is null and spans = 's'").count() == 1


def components(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = WORD.findall(t.translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.fixture(scope="module")
def copies(spark, docs):
    rng = random.Random(1)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(120):
        w = base[:]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            w[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        rows.append((-100 - i, " ".join(w), None, None, 1, "w", "s", 1))
    return docs.unionByName(spark.createDataFrame(rows, SCHEMA)).cache()


@pytest.mark.parametrize("k,percent,block", [(3, 90, 512), (5, 80, 512), (3, 90, 32)])
def test_near_copies_match_all_pairs(copies, k, percent, block):
    rows = [(r.doc_id, r.text or "") for r in copies.collect() if r.doc_id is not None]
    got = near_copies.near_copy_components(copies, near_copies.NearCopies(k, percent, block=block))
    assert got.count() == copies.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.where("doc_id is not null").collect()} == components(rows, k, percent)
    assert got.where("doc_id is null and component_id is null").count() == 1


def test_near_copies_drop_all_but_one(copies):
    left = near_copies.drop_near_copies(copies)
    rows = [(r.doc_id, r.text or "") for r in copies.collect() if r.doc_id is not None]
    want = {c for i, (_, c) in components(rows, 5, 80).items()}
    assert {r.doc_id for r in left.collect() if r.doc_id is not None} == want and left.columns == copies.columns


def test_near_copies_of_nothing(spark):
    assert near_copies.near_copy_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mix_meets_budgets_and_reruns_agree(docs, texts):
    mixed = mixing.mix_documents(docs).collect()
    assert counted(mixed) == counted(mixing.mix_documents(docs).collect())
    assert collections.Counter((r.doc_id, r["size"]) for r in mixed) == collections.Counter((i, len(WORD.findall(t))) for i, t in texts)
    per = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in mixed:
        assert 0 <= r.taken <= 3 * r["size"]
        per[r.source][0] += r["size"]
        per[r.source][1] += r.taken
        per[r.source][2] = r.target
    for size, taken, target in per.values():
        assert abs(taken - target) <= 1 and target <= 3 * size + 1e-6
    assert sum(x[2] for x in per.values()) == pytest.approx(sum(x[0] for x in per.values()))


def test_targets_reshare_excess():
    got = mixing.source_targets([("a", 10), ("b", 1000), (None, 100)])
    assert got["a"][1] == pytest.approx(30) and got[None][1] == pytest.approx(300) and got["b"][1] == pytest.approx(780)


def test_mixed_rows_come_near_targets(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", f"s{i % 3}", 1) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mixed_rows(docs).withColumn("n", mixing.n_words(mixing.F.col("text"))).groupBy("source").agg({"n": "sum"}).collect()
    want = {r.source: r.target for r in mixing.mix_documents(docs).collect()}
    assert all(abs(r[1] - want[r.source]) <= 7 for r in got)


def test_licences_match_search(docs, texts):
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for i, t in texts:
        w, at = word.findall(t.translate(LOWER)), []
        for phrase, label in licences.PHRASES.items():
            p = phrase.split(" ")
            at += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
        want.append((i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    got = licences.licence_scan(docs)
    assert counted(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == counted(want)


def test_licence_passage_with_changes(spark):
    text = licences.TEMPLATES[0][1].replace("software without", "software product without")
    got = licences.licence_scan(spark.createDataFrame([(1, "intro words " + text)], "doc_id long, text string")).first()
    assert got.labels == "mit" and got.n_base == 0 and 0.7 <= got.score < 1


def test_classifier_on_held_out_rows(spark):
    big = SMALL.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    got = factorisation.quality_scores(spark.read.parquet(f"{big}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) >= 0.95


def test_classifier_identity_and_constant(docs, spark):
    rng = np.random.default_rng(0)
    w, v = rng.standard_normal(20), rng.standard_normal((20, 3))
    index, value = np.array([1, 4, 7, 9]), rng.standard_normal(4)
    pairs = sum(v[index[a]] @ v[index[b]] * value[a] * value[b] for a in range(4) for b in range(a))
    assert factorisation.FactorisationMachine(0.5, w, v).margins([(index, value)])[0] == pytest.approx(0.5 + w[index] @ value + pairs)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = factorisation.quality_scores(docs, none).collect()
    assert len(got) == docs.count() and len({r.score for r in got}) == 1


def test_page_text():
    page = "<nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>One  <b>two<br><p>Three&nbsp;four, five and six, seven eight nine ten eleven twelve.</p></article><div class='comments'><p>Nice post!</p></div><footer>&copy; x</footer>"
    nodes = pages.parse(page)
    text = pages.extract(nodes, pages.decode(nodes, pages.trained().margins(pages.features(nodes))))
    assert text == "A & B\nOne two\nThree four, five and six, seven eight nine ten eleven twelve."


def test_place_among_many_siblings():
    nodes = pages.parse("<article>" + "<p>One two three.</p>" * 100 + "</article>")
    x = pages.features(nodes)
    assert [x[i, 15] for i, n in enumerate(nodes) if n.tag == "p"] == pytest.approx([k / 100 for k in range(100)])
    assert all(nodes[c].place == k for n in nodes for k, c in enumerate(n.children))


def test_pages_match_their_articles(spark):
    import html

    table = spark.read.parquet(f"{SMALL}/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-3, "u", "<p"), (-4, "u", "<div " * 3000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.extract_pages(table.select("page_id", "url", "html").unionByName(odd)).collect()}
    for r in table.collect():
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", r.html.split("<article>")[1].split("</article>")[0])
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x) if "<br>" in x else re.sub("<[^>]*>", "", x)).split()) for x in parts]
        assert got[r.page_id].text == "\n".join(x for x in want if x)
    assert got[-1].text == got[-2].text == got[-3].text == ""


def test_decoder_never_contradicts():
    rng = random.Random(3)
    for _ in range(20):
        nodes = pages.parse(pages.training_page(rng))
        keep = pages.decode(nodes, np.array([rng.uniform(-1, 1) for _ in nodes]))
        assert all(not keep[i] or keep[n.parent] for i, n in enumerate(nodes) if i)


def test_boosted_trees_learn_an_interaction():
    x = np.random.default_rng(1).random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert (((boosting.BoostedTrees.fit(x, y, 20, 3).margins(x) > 0) == y).mean()) > 0.95


def test_vector_search_recall_and_scores(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding")
    rng = np.random.default_rng(5)
    same = [float(v) for v in rng.standard_normal(64)]
    odd = [(100_000, None), (100_100, [0.0] * 64), (100_200, [float("nan")] * 64), (100_300, [None] + [1.0] * 63), (100_400, [1.0, 2.0])] + [(200_000 + i, same) for i in range(30)]
    full = table.unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>"))
    config = vectors.VectorIndex(chunk_rows=64, list_rows=12)
    got = collections.defaultdict(list)
    for r in vectors.nearest_neighbours(full, 100, config).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    usable = {r.vec_id: np.array(r.embedding, float) for r in full.collect() if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding) and len(r.embedding) == 64}
    ids = np.array(sorted(usable))
    x = np.stack([usable[i] for i in ids])
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - usable[q]) ** 2).sum(1))
        best = [ids[i] for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hit, total = hit + len({v for v, _ in got[q]} & set(best)), total + len(best)
        assert all(abs(s - d[np.flatnonzero(ids == v)[0]]) < 1e-12 for v, s in got[q]) and [s for _, s in got[q]] == sorted(s for _, s in got[q])
    assert hit / total >= 0.9
    assert [v for v, _ in got[200_000]] == [200_000 + i for i in range(1, 11)]
    assert not {100_000, 100_100, 100_200, 100_300, 100_400} & set(got)


def test_chat_round_trip_and_mask(spark):
    odd = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (-2, 0, None, None), (-3, 0, "assistant", "🎉⁠⁠x <|turn|⁠> <⁠|turn|>日本é  "), (-3, 1, "assistant", ""), (-3, 1, "assistant", ""), (-3, 2, "user<|says|>", " <|over|>")], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(odd)
    turns = collections.defaultdict(list)
    for r in rows.collect():
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat.format_conversations(rows, queries.vocabulary("byte_bpe_50k.json"), with_text=True).collect()}
    assert set(got) == set(turns)
    for k, v in turns.items():
        whole = "".join(f"{a}\n{b}\n" for _, a, b in sorted(v))
        loss = "".join(b for _, a, b in sorted(v) if a == "assistant")
        assert got[k].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and got[k].n_turns == len(v)
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[k].loss_chars == len(loss) and got[k].formatted_chars == len(got[k].formatted)
    assert "</s>" not in got[-1].formatted and "[INST]" not in got[-1].formatted


def test_bpe_equals_the_library(docs, texts):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = []
    for i, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert counted(bpe.encode_documents(docs, path).collect()) == counted(want)


@pytest.mark.parametrize("seed", range(5))
def test_merges_equal_a_plain_loop(seed):
    rng = random.Random(seed)
    merges = {rng.randrange(6) << 20 | rng.randrange(6): (r, rng.randrange(6)) for r in range(15)}
    for n in range(1, 40):
        symbols = [rng.randrange(6) for _ in range(n)]
        plain = symbols[:]
        while True:
            best = min(((merges[a << 20 | b][0], i) for i, (a, b) in enumerate(zip(plain, plain[1:])) if a << 20 | b in merges), default=None)
            if best is None:
                break
            i = best[1]
            plain[i : i + 2] = [merges[plain[i] << 20 | plain[i + 1]][1]]
        assert bpe.merge_symbols(symbols, merges) == plain


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    assert p.run(spark, SMALL).count() == sizes[-1]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for f in (quality_rules.quality_rules, personal_data.personal_data, personal_data.redact, quality_rules.kept_rows, mixing.mix_documents, mixing.mixed_rows, licences.licence_scan):
        assert f(none).count() == 0
    assert vectors.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
