"""The operators against brute force, library results, and defined results for odd rows."""

import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from hammerlake.llm import audio, bpe, languages, licenses, paragraphs, piece_counts, queries, quotes, repeats, simhash, templates

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, uid long, g long, fp string"
LONG = "Somewhere a long passage repeats, word after word, without any end in sight. " * 40


def odd(spark):
    rows = [(1, None), (2, ""), (3, LONG), (3, LONG), (None, LONG), (4, "a b c"), (5, " \t\n"), (6, "A  B\x1cc Σς <|endoftext|> ▁ é"), (7, "x" * 5000)]
    return spark.createDataFrame([(i, t, None, None, None, "k", 0, 0, "f") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def brute_print(text):
    w = text.encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, docs, texts):
    prints = {i: brute_print(t) for i, t in texts.items()}
    want = roots(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def test_simhash_divides_hot_entries(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 12)
    prints = np.unique(np.concatenate([base ^ np.bitwise_xor.reduce(np.int64(1) << rng.integers(0, 63, (k, 12)), axis=0) for k in (1, 2, 3, 4, 5, 6)]))
    classes = spark.createDataFrame([(int(p), k) for k, p in enumerate(prints)], "fp long, rep long")
    monkeypatch.setattr(simhash, "HOT_ENTRY", 2)
    from hammerlake.llm.components import connected_components

    want = roots(range(len(prints)), [(a, b) for a, b in combinations(range(len(prints)), 2) if int(prints[a] ^ prints[b]).bit_count() <= 4])
    got = {r.node: r.component for r in connected_components(simhash.links(classes)).collect()}
    assert {k: got.get(k, k) for k in want} == want


def test_keep_one_of_odd_ids(spark):
    texts = [" ".join(hashlib.sha256(f"{k} {i}".encode()).hexdigest()[:6] for i in range(60)) for k in range(6)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (5, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[3]), (9, texts[4]), (None, None), (3, texts[5]), (2, texts[5])]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, other long")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(None, texts[0]), (5, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4]), (None, None), (2, texts[5])]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, want))


def test_covering():
    triples = simhash.covering_triples()
    assert len(triples) == 20 and all(any(set(t) <= set(f) for t in triples) for f in combinations(range(8), 4))


def test_repeats(docs, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    seen = Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    want = {}
    for i, b in raw.items():
        mark = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                mark[k : k + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~mark])
        spans = int(np.diff(np.concatenate([[0], mark.astype(int)])).clip(0).sum())
        want[i] = (len(b), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(repeats.remove_repeats(docs)).collect()} == want


def test_repeats_deals_out_hot_triggers(spark, monkeypatch):
    rng = np.random.default_rng(2)
    core = "".join(rng.choice(list("abcdefgh"), 260))
    rows = [(k, "".join(rng.choice(list("xyz"), 30)) + core[k % 7 :] + "".join(rng.choice(list("xyz"), 30))) for k in range(20)]
    seen = Counter(t[k : k + 200] for _, t in rows for k in range(len(t) - 199))
    want = {}
    for i, t in rows:
        mark = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            mark[k : k + 200] |= seen[t[k : k + 200]] > 1
        want[i] = mark.sum()
    for hot in (1, 4, 2048):
        monkeypatch.setattr(repeats, "HOT_TRIGGER", hot)
        assert {r.doc_id: r.n_removed for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_suffix_order(monkeypatch):
    rng = np.random.default_rng(9)
    parts = [bytes(rng.integers(0, 3, n).astype(np.uint8)) for n in (9, 4, 30, 12)]
    strings = [x[k : k + 4] for x in parts for k in range(len(x) - 3)]
    order, equal = repeats.suffix_order(parts, 4)
    assert [strings[k] for k in order] == sorted(strings)
    assert equal.tolist() == [k > 0 and strings[order[k]] == strings[order[k - 1]] for k in range(len(strings))]


def near_by_brute_force(paragraphs):
    """Clusters of word lists by key: sets of five words that share four fifths."""
    sets = {k: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for k, w in paragraphs.items()}
    by = {}
    for k, x in sets.items():
        for s in x:
            by.setdefault(s, []).append(k)
    met = {p for ks in by.values() for p in combinations(sorted(ks), 2)}
    want = roots(sets, [(a, b) for a, b in met if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    size = Counter(want.values())
    return {k: v for k, v in want.items() if size[v] > 1}


def clusters(found):
    return {(r.doc_id, r.para): (r.cluster_doc, r.cluster_para) for r in found.collect()}


def test_every_line_as_paragraph(spark, docs, texts):
    lines = {(i, k): w for i, t in texts.items() for k, line in enumerate(t.encode().lower().split(b"\n")) if (w := line.split())}
    assert clusters(paragraphs.near_paragraphs(docs, min_words=1)) == near_by_brute_force(lines)


def test_paragraphs(spark):
    rng = np.random.default_rng(6)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n))
    whole, wrapped, head = say(60), [say(8) for _ in range(5)], say(3)
    edited = whole.split()
    edited[-1] = "other"
    rows = [(1, f"{head}\n{whole}\n\n" + "\n".join(wrapped)), (2, f"{say(30)}\n{' '.join(edited)}"), (3, say(25) + "\n" + "\n".join(wrapped) + "\n" + say(60)), (4, "few words"), (5, "Few  words"), (6, say(50) + "\n" + head), (7, None), (None, whole)]
    # by hand: a long line, or shorter ones that have 20 words together; a shorter rest with its neighbour
    want = {(1, 0): (1, 0), (2, 1): (1, 0), (1, 3): (1, 3), (3, 1): (1, 3), (4, 0): (4, 0), (5, 0): (4, 0)}
    assert clusters(paragraphs.near_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert paragraphs.units([3, 60, 0, 8, 8, 8, 2, 25]) == [(0, 0, 63), (3, 63, 26), (7, 89, 25)]
    assert paragraphs.units([0, 4]) == [(1, 0, 4)] and paragraphs.units([30, 0, 19]) == [(0, 0, 30), (0, 0, 49)] and paragraphs.units([0]) == []
    assert paragraphs.units([2, 40, 3, 50, 12]) == [(0, 0, 45), (3, 45, 50), (3, 45, 62)]


def test_inconsistent_leaks_are_an_option(spark):
    """Re-parameterised items, and prose with an item's frame, in four languages; what either value of the option drops."""
    frames = ["The farmer keeps {a} cows and {b} pigs near the old barn and he buys {c} hens each spring", "Der Bauer hält {a} Kühe und {b} Schweine hinter dem alten Stall und kauft {c} Hühner im Frühling", "Le fermier garde {a} vaches et {b} cochons près de la vieille grange et achète {c} poules au printemps", "El granjero cuida {a} vacas y {b} cerdos cerca del viejo establo y compra {c} gallinas en primavera"]
    words = [("three", "nine", "seven"), ("drei", "neun", "sieben"), ("trois", "neuf", "sept"), ("tres", "nueve", "siete")]
    bench = spark.createDataFrame([(k, f.format(a=w[0], b=w[0], c=w[1])) for k, (f, w) in enumerate(zip(frames, words))], "item_id long, text string")
    rows, leaks = [], set()
    for k, (f, w) in enumerate(zip(frames, words)):
        rows += [(10 * k, f.format(a=w[2], b=w[2], c=12)), (10 * k + 1, f.format(a=4, b=4, c=w[2]).upper()), (10 * k + 2, f.format(a=4, b=w[2], c=2)), (10 * k + 3, f.replace("{b}", "{a} big").format(a=1, c=2)[: len(f) // 2])]
        leaks |= {10 * k, 10 * k + 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {x: {i for i, _ in rows} - {r.doc_id for r in templates.drop_leaked(docs, bench, x).collect()} for x in (True, False)}
    assert gone[False] == leaks  # precision 1
    assert gone[True] == leaks | {10 * k + 2 for k in range(4)}  # precision 0.67 if exchanged numbers that were equal make another question


def test_short_lines_are_a_kind_of_their_own(spark, docs, texts):
    """Brute force over all lines of fewer than twenty words; a line of ten in six documents between unlike lines."""
    lines = {(i, k): w for i, t in texts.items() for k, x in enumerate(t.encode().lower().split(b"\n")) if 0 < len(w := x.split()) < paragraphs.MIN_WORDS}
    found = paragraphs.duplicate_paragraphs(docs)
    assert clusters(found.where("kind = 'line'")) == near_by_brute_force(lines)
    assert clusters(found.where("kind = 'paragraph'")) == clusters(paragraphs.near_paragraphs(docs))
    said = "this very line of ten words stands in six documents"
    rows = [(k, "\n".join([" ".join(f"a{k}x{j}" for j in range(15)), said, " ".join(f"b{k}x{j}" for j in range(15))])) for k in range(6)]
    got = paragraphs.duplicate_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.para, r.words, r.kind, r.cluster_doc, r.removed) for r in got} == {(k, 1, 10, "line", 0, k > 0) for k in range(6)}


def test_short_paragraphs(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    lines = ["Chapter", "All rights reserved.", "chapter", "all  rights reserved.", "a b c d e", "A b c d e", "x x x x x", "x x x x x x x", "a b c d f", "", " ", "alone here", long, long + " thirteen", long[4:] + " on", "six words are in this line", "Six words are in this line"]
    texts = {i: "\n".join(line if k % 3 == i else "" for k, line in enumerate(lines)) for i in range(3)}
    want = near_by_brute_force({(k % 3, k): line.lower().split() for k, line in enumerate(lines) if line.split()})
    got = clusters(paragraphs.near_paragraphs(spark.createDataFrame([*texts.items()], "doc_id long, text string"), min_words=1))
    assert got and got == want


def test_passages_inside_paragraphs(spark, docs, texts):
    where, words = {}, {i: t.encode().lower().split() for i, t in texts.items()}
    for i, w in words.items():
        for k in range(len(w) - 59):
            where.setdefault(tuple(w[k : k + 60]), []).append((i, k))
    shared = {i for x in where.values() if len({i for i, _ in x}) > 1 for i, _ in x}
    found = paragraphs.repeated_passages(docs).collect()
    assert shared and len(shared & {r.doc_id for r in found}) >= 0.97 * len(shared)
    joined = {i: b" " + b" ".join(w) + b" " for i, w in words.items()}
    for r in found:  # what is reported does repeat: its first passage stands where it says, and so does its last
        w = words[r.doc_id][r.first : r.first + r.words]
        assert len(w) == r.words >= 32 and words[r.cluster_doc][r.cluster_first : r.cluster_first + 32] == w[:32]
        assert sum(x.count(b" " + b" ".join(w[-32:]) + b" ") for x in joined.values()) > 1
    assert any(not r.removed for r in found)


def test_minima_of_sets_that_cross_steps(monkeypatch):
    monkeypatch.setattr(paragraphs, "_STEP", 7)
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, paragraphs._PRIME, n) for n in (1, 20, 7, 3, 1, 40)]
    a, b = paragraphs._permutations(6)
    want = [[min((int(v) * int(p) + int(q)) % paragraphs._PRIME for v in s) for p, q in zip(a, b)] for s in sets]
    assert paragraphs._minima(sets, a, b).tolist() == want


def test_bpe(spark, docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = odd(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").unionByName(docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    given = {r.doc_id: r.text or "" for r in rows.collect()}
    for r in bpe.encode_decode(rows, path, texts_too=True).collect():
        ids = lib.encode(given[r.doc_id], add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (ids, lib.decode(ids, skip_special_tokens=False))


def test_token_counts(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = odd(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").unionByName(docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    given = {r.doc_id: r.text or "" for r in rows.collect()}
    for r in piece_counts.token_counts(rows, path).collect():
        n = len(lib.encode(given[r.doc_id], num_threads=1))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(given[r.doc_id].encode()), n > 4096)


def test_languages(spark, docs):
    model = languages.fit(docs)
    rows = languages.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    both = docs.where("lang = 'en'").limit(1).crossJoin(docs.where("lang = 'de'").limit(1).select(F.col("text").alias("t2"))).select("doc_id", F.concat_ws("\n", "text", "t2").alias("text"))
    assert {x.lang for x in languages.identify(both, model).first().languages} == {"en", "de"}
    assert {r.lang_pred for r in languages.identify(odd(spark).where("text is null or text = ''"), model).collect()} == {"und"}
    assert languages.fit(docs.where("false")).languages == []


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    text = "Some code.\n" + mit.replace("sublicense", "sublicence").upper() + "\nMore é.\nReleased under the MIT License."
    got = [(r.license, r.start, r.coverage) for r in licenses.scan_licenses(spark.createDataFrame([(1, text), (2, None), (3, "plain words only")], "doc_id long, text string")).collect()]
    assert [g[:2] for g in got] == [("MIT", 11), ("MIT-notice", text.index("Released"))] and 0.95 < got[0][2] < 1


def test_license_recall(spark):
    """Every template with some words changed, left out and put in, among other words, is found and no other where it stands."""
    rng, rows = np.random.default_rng(12), []
    say = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    names = [k for k, t in licenses.TEMPLATES.items() if len(t.split()) >= 15]
    for k, name in enumerate(names):
        w = licenses.TEMPLATES[name].split()
        for _ in range(max(1, len(w) // 25)):
            at = int(rng.integers(0, len(w)))
            w[at : at + 1] = [[], [say(1)], [w[at], say(1)]][int(rng.integers(0, 3))]
        rows.append((k, f"{say(30)} {' '.join(w)} {say(30)}"))
    found = [(r.doc_id, r.license) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    right = {(k, name) for k, name in enumerate(names)} & set(found)
    print(f"license recall {len(right) / len(names):.3f}, rows {len(found)}")
    assert len(right) >= 0.9 * len(names) and len(found) <= 1.2 * len(names)
    whole = [(k, t) for k, t in enumerate(licenses.TEMPLATES.values())]
    exact = licenses.scan_licenses(spark.createDataFrame(whole, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license, r.coverage) for r in sorted(exact, key=lambda r: r.doc_id)] == [(k, n, 1.0) for k, n in enumerate(licenses.TEMPLATES)]


def test_templates(spark):
    item = "A train leaves Berlin at 9 and drives 120 km in 3 hours before the driver Anna stops to rest for 20 minutes."
    other = item.replace("Berlin", "Madrid").replace("120", "340").replace("Anna", "Luis").replace("9", "7")
    mixed = "Anna and Bert met. Then Anna paid Bert 5 euros and Bert gave Anna 7 cents while they sat there."
    wrong = "Anna and Carl met. Then Dora paid Emil 5 euros and Finn gave Gerd 7 cents while they sat there."
    docs = spark.createDataFrame([(1, "Before. " + other + " After."), (2, "words " * 50), (3, None), (4, item), (4, item), (None, item), (5, wrong)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, mixed)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in templates.find_leaks(docs, bench).collect()}
    assert got == {(1, 1): False, (4, 1): True}
    assert templates.drop_leaked(docs.where("doc_id is not null"), bench).count() == 3
    assert templates.find_leaks(docs, bench.where("false")).count() == 0


def test_templates_find_any_case(spark):
    item = "In spring the driver Anna met Bert near the river Elbe, and they sold Carl 12 km of old Straße rope for 9 euros."
    cases = [item.upper(), item.title(), item.lower(), item.upper().replace("12", "15"), item.swapcase(), "Nothing of it stands here at all. " * 3]
    rows = [(k, f"Before it. {c} After it.") for k, c in enumerate(cases)]
    got = {r.doc_id: r.verbatim for r in templates.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True}


def test_templates_find_whole_passages_in_any_case(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    fold = lambda c: F.trim(F.regexp_replace(F.lower(F.upper(c)), r"[^\p{L}\p{N}]+", " "))
    cased = docs.withColumn("text", F.expr("case doc_id % 3 when 0 then upper(text) when 1 then initcap(text) else text end"))
    texts = {r.doc_id: f" {r.t} " for r in cased.select("doc_id", fold(F.col("text")).alias("t")).collect() if r.t}
    want = {(i, r.item_id) for r in bench.select("item_id", fold(F.col("text")).alias("t")).collect() for i, t in texts.items() if f" {r.t} " in t}
    assert any(i % 3 < 2 for i, _ in want) and {(r.doc_id, r.item_id) for r in templates.find_leaks(cased, bench).collect()} >= want


def test_templates_with_windows_that_repeat(spark):
    series = "2, 4, 8, 16, 32, 64"
    names = "we saw Anna Bert Carl Dora Emil Fritz there"
    frame = "take 3 parts of water and add 5 parts of salt, then stir."
    near = frame.replace("3", "7").replace("5", "9")
    rows = [(1, "The row " + series + " is known."), (2, "Then " + names + " again."), (3, f"{near} {frame} {near}"), (4, "The row 3, 9, 3, 9, 3, 9 is known."), (5, "The row 1, 1, 2, 1, 1, 2 is known.")]
    bench = spark.createDataFrame([(1, series), (2, names), (3, frame), (4, "5, 5, 6, 7, 7, 8")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in templates.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got[1, 1] and got[2, 2] and got[3, 3]
    assert (4, 4) not in got and (5, 4) in got and not got[5, 4]


def test_templates_with_other_parameters(spark):
    """Generated questions, each with values of its own at random, against slots that are compared word by word."""
    rng = np.random.default_rng(11)
    names, nouns = "Anna Ben Carl Dora Emil Frida Gerd Hanna".split(), "cows pigs hens apples stones".split()
    frame = "{} has {} {} on the farm near the river. {} gives {} {} more {}, and then they walk {} km to the mill. How many {} does {} have in the end after school?"
    fill = lambda a, b, n, x: frame.format(a, n[0], x, b, a, n[1], x, n[2], x, a)
    items, rows, want = [], [], set()
    for k in range(4):
        (a, b, c, d), x = rng.choice(names, 4, replace=False), nouns[k]
        items.append((k, fill(a, b, (3, 3, 9), x)))
        other = fill(c, d, rng.integers(10, 99, 3), x)
        wrong = other.replace(f"does {c} have", f"does {a} have").replace(f"gives {c} ", f"gives {b} ")
        rows += [(10 * k, f"Well. {other} Yes."), (10 * k + 1, items[-1][1].upper()), (10 * k + 2, wrong), (10 * k + 3, items[-1][1].replace("farm near the river", "hill under a tree").replace("walk", "ride"))]
        want |= {(10 * k, k), (10 * k + 1, k)}
    items += [(100, "What is 3 + 4 and 5 + 6 and 7 + 8 and 9 + 1?"), (101, "Anna has 12 apples. Ben gives her 5 more apples. How many apples does Anna have now in total after school?"), (102, "A farmer has 3 cows, 3 pigs and 9 hens on the farm near the river and the mill.")]
    rows += [(100, "Intro. " + items[4][1]), (101, items[5][1].replace("Anna", "Carl").replace("Ben", "Dora").replace("12", "40").replace("5", "9")), (102, "A farmer has 4 cows, 7 pigs and 2 hens on the farm near the river and the mill.")]
    got = {(r.doc_id, r.item_id): (r.verbatim, r.consistent) for r in templates.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert want | {(k, k) for k in (100, 101, 102)} <= set(got) and all(i == d // 10 or i == d for d, i in got)
    assert not any((10 * k + j, k) in got for k in range(4) for j in (2, 3))
    assert got[100, 100] == (True, True) and got[101, 101] == (False, True) and got[102, 102] == (False, False)


def test_templates_find_whole_passages(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {(i, r.item_id) for r in bench.collect() for i, t in texts.items() if r.text in t}
    assert want and {(r.doc_id, r.item_id) for r in templates.find_leaks(docs, bench).collect()} == want


def test_quotes(spark):
    rows = [(1, 0, "u", "The first message has words."), (1, 1, "a", "> The first message has words.\nAn answer with more words."), (1, 2, "u", "> > The first message has words.\n> An answer with more words.\nThird one here now."), (1, 3, "a", "> The first message has words.\nBack to the start."), (2, 0, "u", "> Third one here now.\nElsewhere."), (None, 0, "u", None)]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, k].reply_to for k in range(4)] == [None, 0, 1, 0]
    assert got[1, 2].own_text == "Third one here now." and got[2, 0].quoted_conv == 1 and got[1, 2].thread == 0
    assert (got[None, 0].own_text, got[None, 0].position) == (None, None)


def brute_links(rows):
    """(conv, turn) to (n_quotes, n_linked, reply_to): each passage is looked for in all earlier messages, one by one."""
    import re

    normal = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip()
    parsed, own = {}, {}
    for conv, turn, text in rows:
        passages, mine, before = [], [], 0
        for line in text.split("\n"):
            marks = re.match(r"^(?:[ \t]*>)*[ \t]?", line)[0]
            level, rest = marks.count(">"), line[len(marks) :]
            if level and level == before:
                passages[-1][1].append(rest)
            elif level:
                passages.append((level, [rest]))
            else:
                mine.append(rest)
            before = level
        parsed[conv, turn] = [(level, normal(" ".join(t))) for level, t in passages]
        text = "\n".join(mine).strip()
        own[conv, turn] = {normal(x) for x in [text, *text.split("\n"), *re.split(r"\n\s*\n", text)]}
    out, turns = {}, sorted(parsed)
    for conv, turn in turns:
        found = []
        linked = 0
        for level, p in parsed[conv, turn]:
            here = [t for c, t in turns if c == conv and t < turn and p in own[c, t]]
            there = len(p.split()) >= 4 and min(((c, t) for c, t in turns if p in own[c, t]), default=(conv, 0))[0] != conv
            found += [(level, -here[-1])] if here else []
            linked += bool(here or there)
        last = [t for c, t in turns if c == conv and t < turn]
        out[conv, turn] = (sum(p != "" for _, p in parsed[conv, turn]), linked, -min(found)[1] if found else (last[-1] if last else None))
    return out


def test_quotes_by_brute_force(spark):
    rng, rows = np.random.default_rng(13), []
    said = ["Yes.", "Sounds good", "We meet at the mill at noon", "The report has two parts\n\nand one of them is long", "No", "Nobody has seen the old bridge since May", "Thanks, fine"]
    for conv in range(6):
        texts = []
        for turn in range(12):
            text = str(rng.choice(said))
            for _ in range(int(rng.integers(0, 3))):
                source = str(rng.choice(said if rng.random() < 0.3 or not texts else texts)).split("\n")
                text = "\n".join([*(f"{'> ' * int(rng.integers(1, 3))}{x}" for x in source[:1]), text])
            texts.append("\n".join(x for x in text.split("\n") if not x.startswith(">")))
            rows.append((conv, turn, text))
    got = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.reply_to) for r in quotes.link_quotes(spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert got == brute_links(rows)


def test_runs_of_lines(spark):
    """Parts of a message, foreign mail with wrapped lines, and short passages that one other conversation has."""
    first = "one alpha\n\ntwo beta gamma\nthree\nfour delta"
    mail = "On Monday, Ann wrote:\n> one alpha two\n> beta gamma three four\n> delta\nAgreed."
    rows = [(1, 0, first), (1, 1, "unlike"), (1, 2, "> one alpha\n>\n> two beta gamma\nfirst two"), (1, 3, "> Two, beta gamma\n> three\n> four delta\nlast three"), (1, 4, "> three\n> one alpha\nno such run"), (1, 5, "> > two beta gamma\n> > three\n> unlike\nnested"), (1, 6, mail), (2, 0, "> first two\nshort but said once"), (3, 0, "> unlike\nx"), (4, 0, "unlike"), (5, 0, "> > three\n> > four delta\ny")]
    got = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.reply_to, r.quoted_conv) for r in quotes.link_quotes(spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 2] == (1, 1, 0, None) and got[1, 3] == (1, 1, 0, None) and got[1, 4] == (1, 0, 3, None)
    assert got[1, 5] == (2, 2, 1, None) and got[1, 6] == (1, 1, 0, None)
    assert got[2, 0] == (1, 1, None, 1) and got[3, 0] == (1, 0, None, None) and got[5, 0] == (1, 0, None, None)


def test_partial_quotes_by_brute_force(spark):
    """Replies that quote some lines in a row of an earlier message; all runs of all earlier messages are looked at. Recall is 1.

    Passages are compared by their words, so those of one conversation that only break lines elsewhere are one.
    """
    rng, rows, quoted, texts = np.random.default_rng(21), [], {}, {}
    for conv in range(4):
        for turn in range(15):
            lines = [" ".join(rng.choice(["a", "b", "c"], int(rng.integers(1, 3)))) for _ in range(int(rng.integers(1, 9)))]
            if turn:
                of = texts[conv, int(rng.integers(turn))]
                at = int(rng.integers(len(of)))
                quoted[conv, turn] = tuple(of[at : at + int(rng.integers(1, 6))])
            rows.append((conv, turn, "u", "\n".join([*("> " + x for x in quoted.get((conv, turn), ())), *lines])))
            texts[conv, turn] = lines

    def source(conv, turn):
        p = " ".join(quoted[conv, turn])
        breaks = [q for (c, _), q in quoted.items() if c == conv and " ".join(q) == p]
        has = lambda x: p == " ".join(x) or p in x or any(tuple(x[i : i + len(q)]) == q for q in breaks for i in range(len(x)))
        return max(t for t in range(turn) if has(texts[conv, t]))

    got = {(r.conv_id, r.turn): r.reply_to for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect() if r.turn}
    assert got == {k: source(*k) for k in quoted}


def test_odd_messages(spark):
    layout = "conv_id long, turn long, role string, text string, hash long, lines int"
    rows = [(1, 0, "u", "The first message has words.", 1, 1), (1, 0, "u", "The first message has words.", 1, 1), (1, 1, None, None, 1, 1), (1, 1, "a", "> The first message has words.\nok", 1, 1), (None, 3, "u", "> a", 1, 1), (2, None, "u", "", 1, 1), (3, 5, "u", "> " * 50 + "x " * 20000, 1, 1)]
    given = spark.createDataFrame(rows, layout)
    found = quotes.link_quotes(given).collect()
    assert len(found) == len(rows) and {r.reply_to for r in found if (r.conv_id, r.turn) == (1, 1)} == {0}
    assert sum(r.position is None for r in found) == 2 and quotes.link_quotes(given.where("false")).count() == 0
    assert quotes.as_mail(given).count() == len(rows)


def test_quotes_of_repeated_rows(spark):
    """Copies of a row are read one by one (their lines don't mix), and quotes are those of the first text of a turn, over gaps between turns."""
    said = [(1, 0, "u", "one alpha\ntwo beta"), (1, 0, "u", "an other text"), (1, 4, "a", "four gamma\n\nfive"), (1, 9, "u", "six"), (1, 9, "u", None), (1, 12, "a", "last"), (2, 3, "u", None), (2, 4, "a", "alone"), (None, 1, "u", "nowhere"), (3, None, "u", "no turn")]
    given = spark.createDataFrame(said + said, "conv_id long, turn long, role string, text string")
    mail = {(r.conv_id, r.turn, r.text) for r in quotes.as_mail(given).collect()}
    assert mail == {(1, 0, "one alpha\ntwo beta"), (1, 0, "an other text"), (1, 4, "> an other text\nfour gamma\n\nfive"), (1, 9, "> > an other text\n> four gamma\n> \n> five\nsix"), (1, 9, None), (1, 12, "> > four gamma\n> > \n> > five\n> six\nlast"), (2, 3, None), (2, 4, "alone"), (None, 1, "nowhere"), (3, None, "no turn")}
    got = quotes.link_quotes(quotes.as_mail(given)).collect()
    assert {(r.turn, r.n_quotes, r.n_linked, r.reply_to, r.thread) for r in got if r.conv_id == 1} == {(0, 0, 0, None, 0), (4, 1, 1, 0, 0), (9, 2, 2, 4, 0), (12, 2, 2, 9, 0)}
    assert sorted(r.position for r in got if r.conv_id == 1) == list(range(1, 13)) and [r.position for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.turn, r.own_text or ""))] == list(range(1, 13))
    once = spark.createDataFrame([(1, 0, "u", "one alpha"), (1, 1, "a", "> one alpha\nyes"), (1, 1, "a", "> one alpha\nyes")], "conv_id long, turn long, role string, text string")
    assert [(r.n_quotes, r.n_linked, r.reply_to, r.thread) for r in quotes.link_quotes(once).where("turn = 1").collect()] == [(1, 1, 0, 0)] * 2


def test_quotes_give_the_rows_of_their_sql(spark, tmp_path):
    """Over repeated rows, other texts of a turn, texts that are null or have no words, and gaps between turns."""
    import duckdb

    turns = spark.read.parquet(f"{SF}/conversations.parquet").withColumn("turn", F.col("turn") * 3)
    odd = turns.withColumn("text", F.when(F.col("turn") % 4 == 0, F.lit("--\n?")).when(F.col("turn") % 5 == 0, F.lit(None)).otherwise(F.col("text"))).withColumn("conv_id", F.col("conv_id") + 1000)
    more = turns.where("conv_id % 2 = 0").unionByName(turns.where("conv_id % 3 = 0").withColumn("text", F.reverse("text"))).unionByName(odd)
    turns.unionByName(more).write.parquet(f"{tmp_path}/conversations.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    answer = duckdb.sql(queries.ORACLE_SQL["op4_quotes"])
    got = queries.op4_quotes(spark, str(tmp_path)).select(*answer.columns)
    key = lambda r: [(x is not None, x) for x in r]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(answer.fetchall(), key=key)


def test_threads_over_jumps(spark):
    """Replies to turns before the last one are followed back to the first turn, through others that do so too."""
    rng, rows, up, root = np.random.default_rng(5), [], {}, {}
    for conv in range(3):
        for turn in range(60):
            back = None if turn == 0 or rng.random() < 0.1 else int(rng.integers(turn)) if rng.random() < 0.5 else turn - 1
            rows.append((conv, 2 * turn, "u", ("" if back is None else f"> words of {conv} number {back}\n") + f"words of {conv} number {turn}"))
            up[conv, turn], root[conv, turn] = back, turn if back is None else root[conv, back]
    got = {(r.conv_id, r.turn // 2): (r.thread // 2, r.position) for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    places = {k: 1 + sorted((root[x], x[1]) for x in root if x[0] == k[0]).index((root[k], k[1])) for k in root}
    assert got == {k: (root[k], places[k]) for k in root} and len(set(root.values())) > 3


def test_quotes_shuffle_texts_few_times(spark):
    """What is written for shuffles is a small multiple of the texts: each was dealt out over ten times before."""
    rng = np.random.default_rng(8)
    rows = [(conv, turn, "u", "\n".join(bytes(rng.integers(97, 123, 400, dtype=np.uint8)).decode() for _ in range(3))) for conv in range(60) for turn in range(8)]
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def wrote():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = wrote()
    assert len(quotes.link_quotes(quotes.as_mail(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()) == len(rows)
    assert 0 < sum(v for k, v in wrote().items() if k not in before) < 5 * sum(len(x[3]) for x in rows)


def tunes(seed, count, notes=64):
    rng, t = np.random.default_rng(seed), np.arange(256) / audio.RATE
    return [np.concatenate([20000 * np.sin(2 * np.pi * 220 * 2 ** (p / 12) * t) * np.hanning(256) for p in rng.integers(0, 24, notes)]) for _ in range(count)]


def pcm(x):
    return np.clip(x, -32768, 32767).astype("<i2").tobytes()


def test_audio(spark):
    rng = np.random.default_rng(4)
    a, b = tunes(4, 2, 80)
    noisy = np.concatenate([np.zeros(10 * audio.HOP), a]) + 400 * rng.standard_normal(len(a) + 10 * audio.HOP)
    odd = [(3, b""), (4, None), (None, pcm(a)), (5, pcm(a)), (5, pcm(a)), (200, b""), (300, pcm(tunes(5, 1)[0]))]
    rows = spark.createDataFrame([(100, pcm(a), 1), (1, pcm(noisy), 1), (2, pcm(b), 1), *[(i, x, 1) for i, x in odd]], "rec_id long, pcm binary, codes int")
    got = {(r.query_id, r.match_id): (r.offset, r.copies) for r in audio.match_recordings(rows).collect()}
    assert got == {(100, 1): (10 * audio.HOP, 1), (100, 5): (0, 2)}
    by_query = {r.query_id: (r.n_classes, r.n_recordings, r.best_id) for r in audio.matches_by_query(rows).collect()}
    assert by_query == {100: (2, 3, 5), 200: (0, 0, None), 300: (0, 0, None)}
    assert audio.matches_by_query(rows.where("false")).count() == 0


def test_audio_recall(spark):
    """Planted copies with noise that begin anywhere, against an alignment at every offset and phase."""
    rng, rows, pairs = np.random.default_rng(7), [], []
    for k, x in enumerate(tunes(8, 30)):
        rows.append((100 * k, pcm(x)))
        for j in range(1, 5):
            late = np.concatenate([50 * rng.standard_normal(int(rng.integers(0, 1500))), x[: int(rng.integers(10000, len(x)))]])
            rows.append((100 * k + j, pcm(late + (0.04 + 0.06 * j) * 20000 * rng.standard_normal(len(late)))))
    codes = {i: audio.fingerprint(np.frombuffer(p, "<i2")) for i, p in rows}

    def error(x, y):
        places = [(max(0, -d), min(len(x), len(y) - d), d) for d in range(-len(x) + 30, len(y) - 30)]
        return min(np.bitwise_count(x[lo:hi] ^ y[lo + d : hi + d]).mean() / 32 for lo, hi, d in places)

    for i, p in rows:
        if i % 100 == 0:
            phases = [audio.fingerprint(np.frombuffer(p, "<i2")[k:]) for k in audio.PHASES]
            pairs += [(i, i + j) for j in range(1, 5) if min(error(x, codes[i + j]) for x in phases) <= audio.MAX_BIT_ERROR]
    got = {(r.query_id, r.match_id) for r in audio.match_recordings(spark.createDataFrame(rows, "rec_id long, pcm binary")).collect()}
    recall = len(got & set(pairs)) / len(pairs)
    print(f"recall {recall:.3f} of {len(pairs)}")
    assert len(pairs) > 80 and recall >= 0.9 and not any(a // 100 != b // 100 for a, b in got)


def test_odd_rows_and_empty_tables(spark):
    rows = odd(spark)
    bench = spark.createDataFrame([(1, "words of a benchmark item here")], "item_id long, text string")
    model = languages.fit(rows)
    runs = {
        "simhash": (lambda d: simhash.near_duplicates(d), 9),
        "repeats": (lambda d: repeats.digest(repeats.remove_repeats(d)), 9),
        "bpe": (lambda d: bpe.encode_decode(d, public_tokenizers.path("word_bpe_49k.json")), 9),
        "counts": (lambda d: piece_counts.token_counts(d, public_tokenizers.path("piece_bpe_32k.model")), 9),
        "languages": (lambda d: languages.identify(d, model), 9),
        "licenses": (lambda d: licenses.scan_licenses(d), 0),
        "paragraphs": (lambda d: paragraphs.near_paragraphs(d), 2),
        "passages": (lambda d: paragraphs.repeated_passages(d), 2),
        "templates": (lambda d: templates.find_leaks(d, bench), 0),
    }
    for name, (run, n) in runs.items():
        assert run(rows).count() == n, name
        assert run(rows.where("false")).count() == 0, name
    assert repeats.strip_repeats(rows).columns == rows.columns


def test_odd_rows_in_pipeline_stages(spark):
    rows = odd(spark).withColumnsRenamed({"key": "row", "uid": "all", "g": "_nth"}).withColumn("lang", F.when(F.col("doc_id") == 6, "en"))
    bench = spark.createDataFrame([(1, "a b c d"), (None, "x"), (2, None)], "item_id long, text string")
    model = languages.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    stages = {"known": (lambda d: languages.keep_known(d, model), 6), "one": (simhash.keep_one, 5), "strip": (repeats.strip_repeats, 9), "leaks": (lambda d: templates.drop_leaked(d, bench), 9)}
    for name, (stage, n) in stages.items():
        assert stage(rows).columns == rows.columns, name
        assert stage(rows).count() == n and stage(rows.where("false")).count() == 0, (name, stage(rows).count())


def test_pipeline(spark, docs):
    done = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, done, SF)
        assert done.columns == docs.columns
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_queries_are_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
