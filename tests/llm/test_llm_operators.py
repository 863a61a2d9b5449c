"""The pipeline's operators against brute force, on small awkward inputs."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiframe.llm import decontaminate, jaccard, langid, main_text, packing, quality, repeats, token_files, tokens
from lexiframe.llm import toxicity, urls
from lexiframe.llm.components import connected_components
from lexiframe.llm.queries import URL_RULES
from lexiframe.session import let_workers_import, new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string, _text string, node long"


@pytest.fixture(scope="module")
def texts():
    """Random texts with copies, near copies, shared passages, repeats, nulls, empties and a long one."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ärger", "naïve,", "I'll", "<|endoftext|>", "42nd", "x\u00a0y", "日本"]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    out = [None, "", "   \n", "one", "One TWO three", "a b c d", "A B C D"]
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 160))]
        if i % 4 == 0:
            at, k = rng.randint(0, len(words)), rng.randint(0, 15)
            words[at:at] = passage[k : k + rng.randint(45, 70)]
        if i % 5 == 0:
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(rng.choice([" ", " ", "\n", "\t"]).join(words))
    out += [out[10], out[20], out[20], "same line\n" * 30, " ".join(["again and"] * 90)]
    out.append(" ".join(rng.choice(vocabulary) for _ in range(6000)) + " " + " ".join(passage))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    let_workers_import(spark)
    rows = [(3 * i, t, "en", "s", 1, "clash", "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_repetition_quality(docs, none, texts):
    got = by_id(quality.repetition_quality(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t in enumerate(texts):
        t = t or ""
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        runs = Counter(tuple(w[a : a + 8]) for a in range(len(w) - 7))
        inside = {a + k for a in range(len(w) - 7) if runs[tuple(w[a : a + 8])] > 1 for k in range(8)}
        failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
        assert got[3 * i][:6] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside), failed)
        assert not (failed and got[3 * i][6])
    assert got[3 * (len(texts) - 1)][6]
    assert quality.repetition_quality(none).count() == 0


def test_decontaminate(spark, docs, none, texts):
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    long_words = texts[-1].split()
    items = [(1, " ".join(long_words[100:125])), (2, "ONE"), (10, "one two, THREE"), (11, "one two, THREE"), (4, None), (5, ""), (6, "b c"), (None, "w1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_items(docs, bench)
    got = by_id(found.withColumn("n_hit", decontaminate.hit_words(F.col("hits"))), "n_words", "n_hit", "item_ids")
    for i, t in enumerate(texts):
        w, hit, names = words_of(t), set(), set()
        for item, text in items:
            v = words_of(text)
            size = min(10, len(v))
            wanted = {tuple(v[a : a + size]) for a in range(len(v) - size + 1)} if size else set()
            for a in range(len(w) - size + 1 if size else 0):
                if tuple(w[a : a + size]) in wanted:
                    hit.update(range(a, a + size))
                    names |= {str(item)} - {"None"}
        assert got[3 * i] == (len(w), len(hit), sorted(names)), (i, t)
    assert decontaminate.find_items(none, bench).count() == 0
    assert decontaminate.find_items(docs, bench.limit(0)).where("size(hits) > 0").count() == 0
    kept = decontaminate.drop_contaminated(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, v in got.items() if not v[1]}
    assert kept.columns == docs.columns


def test_substring_dedup(docs, none, texts):
    cut = repeats.remove_repeats(docs)
    assert cut.columns[: len(docs.columns)] == docs.columns and cut.where("_text <> 'clash'").isEmpty()
    got = by_id(cut, "n_words", "n_removed", "kept_sha256", "kept_text")
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for a in range(len(w) - 49):
            first.setdefault(tuple(w[a : a + 50]), i)
    removed = 0
    for i, w in enumerate(words):
        gone = {a + k for a in range(len(w) - 49) if first[tuple(w[a : a + 50])] < i for k in range(50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        removed += len(gone)
        assert got[3 * i][:3] == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), i
        assert got[3 * i][3] == (kept if gone else texts[i])
        if gone:
            ends = [k for k in gone if k + 1 not in gone]
            assert len(ends) >= 1
    assert removed > 500
    spans = {r.doc_id: r.spans for r in repeats.maximal_repeats(docs).collect()}
    assert {d: sum(s["end"] - s["start"] for s in v) for d, v in spans.items()} == {d: v[1] for d, v in got.items() if v[1]}
    assert repeats.remove_repeats(none).count() == 0


def test_jaccard_components(docs, none, texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[a : a + 4]) for a in range(max(len(w) - 3, 1))} if w else set())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = by_id(jaccard.similar_components(docs), "n_shingles", "component_id")
    assert got == {3 * i: (len(s), 3 * root(i)) for i, s in enumerate(sets)}
    assert sum(root(i) != i for i in range(len(sets))) >= 5
    assert jaccard.similar_components(none).count() == 0


def test_rows_that_share_an_id(spark):
    rows = [(None, "p q r s t"), (None, "p q r s t"), (7, "p q r s t"), (9, "p q r s t"), (9, "k l m n o"), (11, "k l m n o"), (9, "k l m n o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.similar_components(docs).collect()
    assert len(found) == 7 and {r.component_id for r in found} == {7}
    assert quality.repetition_quality(docs).where("doc_id is null").count() == 2
    assert repeats.remove_repeats(docs).count() == 7


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (100, 60), (60, 70), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 70: 50, 100: 50}


def test_hot_token_is_dealt_to_blocks(docs, monkeypatch):
    """The same components when every token's documents are compared in blocks of two."""
    expected = by_id(jaccard.similar_components(docs), "component_id")
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    assert by_id(jaccard.similar_components(docs), "component_id") == expected


def test_token_files(spark, docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_path())
    folder = new_path(spark, "tokens-test")
    shards = token_files.write_token_files(docs, folder).collect()
    got = by_id(token_files.read_token_files(spark, folder), "start", "n_tokens", "ids_crc32")
    at = 0
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[3 * i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert sum(r.n_tokens for r in shards) == at
    folder = new_path(spark, "tokens-test")
    token_files.write_token_files(docs.limit(0), folder)
    assert token_files.read_token_files(spark, folder).count() == 0


def test_optimal_boundaries():
    rng = np.random.default_rng(3)
    from itertools import combinations

    for _ in range(30):
        n = int(rng.integers(1, 8))
        lengths = np.sort(rng.choice(np.arange(1, 40), n, replace=False))
        counts = rng.integers(1, 9, n)
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))
        for k in (1, 2, 3, 8):
            best = min(cost([*b, lengths[-1]]) for m in range(min(k, n)) for b in combinations(lengths[:-1], m))
            bounds = packing.optimal_boundaries(lengths, counts, k)
            assert len(bounds) <= k and bounds[-1] == lengths[-1] and cost(bounds) == best
    assert packing.optimal_boundaries(np.array([]), np.array([]), 4) == []


def test_pack(spark, docs, none):
    lengths = packing.token_lengths(docs)
    rows = packing.pack(lengths, max_len=64, n_buckets=4, token_budget=256).collect()
    total = {r.doc_id: r.n_tokens for r in lengths.collect()}
    assert Counter({d: n for d, n in total.items()}) == sum((Counter({r.doc_id: r.n_tokens}) for r in rows), Counter())
    batches = {}
    for r in rows:
        assert 0 < r.n_tokens <= r.bucket <= 64 and r.start == 64 * r.piece
        batches.setdefault((r.bucket, r.batch), []).append(r.slot)
    for (bucket, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * bucket <= max(256, bucket)
        last = max(b for k, b in batches if k == bucket)
        assert batch == last or len(slots) == 256 // bucket
    assert packing.pack(packing.token_lengths(none)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, 0), (None, 3), (None, 3)], "doc_id long, n_tokens long")
    assert packing.pack(odd).count() == 2


def brute_viterbi(scores, penalty):
    value, paths = scores[0].copy(), [[k] for k in range(scores.shape[1])]
    for s in scores[1:]:
        top = int(value.argmax())
        new, kept = [], []
        for k in range(len(value)):
            stay = value[k] >= value[top] - penalty
            new.append((value[k] if stay else value[top] - penalty) + s[k])
            kept.append((paths[k] if stay else paths[top]) + [k])
        value, paths = np.array(new), kept
    return paths[int(value.argmax())]


def test_viterbi():
    rng = np.random.default_rng(1)
    table = -rng.integers(0, 5, (50, 3)).astype(np.float32)
    at = [rng.integers(0, 50, n) for n in (7, 0, 1, 30, 12)]
    for words, labels in zip(at, langid.viterbi(table, at, 3.0)):
        assert list(labels) == (brute_viterbi(table[words], 3.0) if len(words) else [])


def test_language_spans(spark, none):
    let_workers_import(spark)
    rows = [("the cat and the house is there with this", "en"), ("der hund und das haus ist nicht mit diesem", "de"), ("привет это дом и кот", "ru"), (None, "en"), ("x", None)]
    model = langid.learn_languages(spark.createDataFrame(rows * 5, "text string, lang string"))
    assert model.languages == ["de", "en", "ru"]
    cases = [(1, "the house and the cat"), (2, "das haus und der hund"), (3, "кот и дом"), (4, None), (5, "  "), (6, "12 %"), (7, "the cat is there with the house der hund und das haus ist nicht mit diesem hund")]
    docs = spark.createDataFrame(cases, "doc_id long, text string")
    got = by_id(langid.identify_languages(docs, model), "lang_pred", "score", "spans")
    assert [got[i][0] for i in range(1, 7)] == ["en", "de", "ru", "und", "und", "und"]
    assert got[3][1] == 1.0 and got[4][1:] == (0.0, [])
    assert [s["lang"] for s in got[7][2]] == ["en", "de"] and sum(s["n"] for s in got[7][2]) == 17
    assert langid.identify_languages(none, model).count() == 0
    empty = langid.learn_languages(docs.limit(0).withColumn("lang", F.lit("en")))
    assert {r.lang_pred for r in langid.identify_languages(docs, empty).collect()} == {"und"}


def test_toxicity(spark, none):
    let_workers_import(spark)
    rng = random.Random(2)
    plain = [f"word{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["grumbak", "grumbal", "idiot"]))
        rows.append((i, " ".join(words), int(toxic) if i % 31 else 1 - int(toxic)))
    labelled = spark.createDataFrame([*rows, (900, None, 1), (901, "x", None)], "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(labelled)
    tests = [(1, "worda grumbat grumbax wordb"), (2, "worda wordb wordc"), (3, None), (4, ""), (5, "You idiot, idiot clown wordc")]
    got = by_id(toxicity.score_toxicity(spark.createDataFrame(tests, "doc_id long, text string"), model), "score")
    assert got[1][0] >= 0.7 and got[5][0] >= 0.7 and max(got[2][0], got[3][0], got[4][0]) < 0.3
    assert all(0 <= v[0] <= 1 for v in got.values())
    nothing = toxicity.fit_toxicity(labelled.limit(0))
    assert toxicity.score_toxicity(none, nothing).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; T</title><style>p{{}}</style></head><body><nav><ul><li><a href="/a">menu one</a></li></ul></nav>
<div class="ad">Buy this now</div><div class="cookie-notice">We use cookies</div>{0}<div id="comments"><p>A reader says much about it all here</p></div>
<form><label>Mail</label><input></form><footer>&copy; somebody</footer></body></html>"""


def test_main_text(spark, none):
    body = '<article><h1>Head &lt;1&gt;</h1><p>First  line\nof <b>text</b> with words enough<p>Second &#228; part<br>goes on a while here<script>x()</script><!-- c --></article>'
    bare = "<div><p>First line of text with words enough to be found</p><p>Second part goes on a while here</p></div>"
    rows = [(1, "u", PAGE.format(body)), (2, None, None), (3, "u", ""), (4, "u", PAGE.format(bare)), (None, "u", "<article>open & <b>never closed"), (5, "u", "just text < here")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in main_text.extract_main_text(pages).collect()}
    expected = "Head <1>\nFirst line of text with words enough\nSecond ä part goes on a while here"
    assert got[1].text == expected and got[1].n_chars == len(expected)
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0
    assert got[4].text == "First line of text with words enough to be found\nSecond part goes on a while here"
    assert got[None].text == "open & never closed" and got[5].text == "just text < here"
    assert main_text.extract_main_text(pages.limit(0)).count() == 0


def test_main_text_takes_the_best_region():
    rng = random.Random(4)
    for _ in range(20):
        page = "".join(rng.choice(["<p>", "</p>", "<li>", "a b ", "c ", "<div>"]) for _ in range(12))
        tokens_ = list(main_text.events(page))
        value = [main_text._weight({}, k, n, d) * (len(t.split()) if k == "text" else 1) for k, n, d, t in tokens_]
        best = max([0.0, *(sum(value[i:j]) for i in range(len(value)) for j in range(i + 1, len(value) + 1))])
        text = main_text.main_text(page, {})
        assert (best > 0) == bool(text) and len(text.split()) * 0.5 >= best
        assert html.unescape(text) == text


def test_urls(spark):
    plain = [(i, f"https://good.example.net/en/{i}?x=1") for i in range(30)]
    odd = [(100, None), (101, "no scheme"), (102, "HTTP://A.Example.ORG"), (103, "http://x.example.org/es/1"), (104, "http://example.org/en/17"), (105, "http://example.com/de/a#b"), (106, "http://EXAMPLE.com/fr/"), (None, "://h/p://q"), (107, "http://notorg/"), (108, "http://example.com/en/a")]
    bad = [(200 + i, f"http://casino-win.example.net/{p}/{i}") for i, p in enumerate(["en", "fr"] * 10)]
    pages = spark.createDataFrame([*plain, *odd, *bad, plain[0]], "page_id long, url string")
    rows = urls.judge_urls(pages, URL_RULES).collect()
    assert len(rows) == 61
    got = {r.page_id: r for r in rows}
    assert [(got[i].host, got[i].path, got[i].rule) for i in (100, 101)] == [("", "", None)] * 2
    assert (got[102].host, got[102].path, got[102].rule) == ("a.example.org", "", None)
    assert (got[103].rule, got[103].verdict) == ("example.org/es/", "block")
    assert (got[104].rule, got[104].verdict) == ("example.org/en/1", "block")
    assert (got[105].path, got[105].rule, got[105].verdict) == ("/de/a", "com/de/", "block")
    assert (got[106].rule, got[106].verdict) == ("com/fr/", "allow")
    assert (got[None].host, got[None].path) == ("h", "/p://q") and got[107].rule is None
    assert {got[i].verdict for i in range(30)} == {"allow"} and got[0].template == "good.example.net/en/*"
    assert {got[200 + i].verdict for i in range(20)} == {"block"} and got[108].verdict == "allow"
    assert urls.judge_urls(pages.limit(0), URL_RULES).count() == 0
    given = spark.createDataFrame([(f"https://good.example.net/en/{i}?x=1", 0) for i in range(30)], "url string, good int")
    assert {r.verdict for r in urls.judge_urls(pages, URL_RULES, given).collect() if r.page_id in range(30)} == {"block"}


def test_words_are_encoded_in_groups():
    """The IDs are the tokenizer's own, also where it cuts a word of letters further."""
    from tokenizers import Tokenizer

    from lexiframe.llm.tokens import WordEncoder, default_path

    odd = [
        None, "", " \n\t", "it's DON'T 're !'s a,b 12ab", "a\x1cb \x00x x\x1c\x1d \x1e", "<|endoftext|> x<|y <| |>",
        "É é é Å \x85q  w", "İstanbul, ısı. ﬁn ß", "日本語、 中文 한국어. 한", "", "it's",
    ]
    texts = odd + [" ".join(t or "" for t in odd)] * 2 + [f"word{i} Ω{i} ωα{chr(97 + i % 26)}" for i in range(200)]
    tokenizer = Tokenizer.from_file(default_path())
    want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(WordEncoder(default_path()).encode_all(texts)) == want


def test_texts_are_decoded_in_slices():
    texts = pd.Series(["abc", None, "", "x" * 10, "ab", "cd", "e"], index=range(5, 12))
    for most in (1, 3, 5, 100):
        parts = list(langid.slices_of(texts, most))
        assert pd.concat(parts).equals(texts)
        assert all(sum(len(t or "") for t in p) <= most or sum(1 for t in p if t) == 1 for p in parts)
    assert list(langid.slices_of(pd.Series([], dtype=object))) == []
