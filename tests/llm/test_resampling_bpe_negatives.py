"""Importance resampling, byte-pair encoding and hard negatives against brute force and the library."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexiframe.llm import bpe, hard_negatives, resampling
from lexiframe.llm.tokens import default_path
from lexiframe.session import let_workers_import

DOCS = "doc_id long, text string, ids string, score string, _row long"
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- importance resampling ---


def brute_resample(rows, targets, percent, min_words, buckets, longest, seed):
    """(doc_id, n_features, weight, score, rank) of each row, in the order of ``rows``."""

    def features(text):
        words = ITEM_WORD.findall((text or "").translate(LOWER))
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    found = [features(t) for _, t in rows]
    source = Counter(b for _, f in found for b in f)
    target = Counter(b for t in targets for b in features(t)[1])
    all_source, all_target = sum(source.values()), sum(target.values())
    out = []
    for (doc_id, _), (_, f) in zip(rows, found):
        gain = [
            math.floor(1000 * math.log((target[b] + 1) * (all_source + buckets) / ((source[b] + 1) * (all_target + buckets))))
            for b in f
        ]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = [i for i, (n, _) in enumerate(found) if n >= min_words]
    order = sorted(able, key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0, i))
    for rank, i in enumerate(order[: percent * len(able) // 100], 1):
        out[i][4] = rank
    return [tuple(r) for r in out]


def documents(spark, rows):
    let_workers_import(spark)
    return spark.createDataFrame([(i, t, "clash", "clash", 7) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ärger", "NAÏVE", "x9", "日本", "don't"]
    made = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 50))) for _ in range(120)]
    made += [None, "", " \n", "...", made[3], made[3], " ".join(["w1"] * 5000)]
    return [(5 * i, t) for i, t in enumerate(made)] + [(None, made[7])] + [(10, made[2])] * 40


@pytest.mark.parametrize(("percent", "longest", "buckets"), [(10, 1, 10_000), (50, 1, 7), (100, 3, 500), (0, 2, 50), (37, 2, 50)])
def test_resampling_equals_brute_force(spark, rows, percent, longest, buckets):
    targets = ["w1 w2 w3 Ärger", None, "w4 w5 unseen words here", ""]
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    found = resampling.resample(documents(spark, rows), target, percent, 20, buckets, longest, 9).collect()
    expected = brute_resample(rows, targets, percent, 20, buckets, longest, 9)
    assert found[0].asDict().keys() == {"doc_id", "n_features", "weight", "score", "rank"}
    assert Counter(map(tuple, found)) == Counter(expected)


def test_resampling_without_documents_or_target(spark, rows):
    empty = spark.createDataFrame([], "text string")
    assert resampling.resample(documents(spark, []), empty).collect() == []
    found = resampling.resample(documents(spark, rows), empty).collect()
    assert Counter(map(tuple, found)) == Counter(brute_resample(rows, [], 10, 20, 10_000, 1, 2024))


def test_nth_smallest_by_bisection(spark):
    rng = random.Random(3)
    values = [rng.randint(-(10**12), 10**12) for _ in range(300)] + [5] * 200 + [2**63 - 1, -(2**62)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values)
    for n in (1, 2, 100, 150, 300, len(values)):
        assert resampling.nth_smallest(df, "v", n) == (ordered[n - 1], sum(v < ordered[n - 1] for v in values))


def test_all_rows_tied(spark):
    """One id and one text hold every row: exactly the due number is drawn."""
    found = resampling.resample(documents(spark, [(4, "a " * 30)] * 55), documents(spark, []).select("text"), 20).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 12)) and len(found) == 55


# --- byte-pair encoding ---


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(2)
    alphabet = "abcdefgh XYZ'sdtll0189.,!?-_\n\t\x0b\x1c\x00\x85  éÉßİıΣςσ́̈日本語한글ࠀ😀🇩🇪‍ﬁİǅ"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    made += ["it's they'LL 'sI'd''s", "a<|endoftext|>b <|startoftext|><|endoftext|> <|endoftext|", "<|ENDOFTEXT|>"]
    made += ["".join(chr(rng.randint(0x20, 0x24F)) for _ in range(40)) for _ in range(300)]
    made += ["".join(chr(rng.choice([*range(0x370, 0x600), *range(0x2000, 0x2070), 97, 32])) for _ in range(30)) for _ in range(300)]
    made += ["", " ", "hello", "x" * 3000, "internationalisation " * 40, "ÅÅÅ Å Å", "٣४ ½ ⅷ ²"]
    return made


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_the_library(strings, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    library, ours = Tokenizer.from_file(path), bpe.Bpe(path)
    for text in strings:
        ids = library.encode(text, add_special_tokens=False).ids
        found = ours.encode(text.encode())
        assert np.frombuffer(found, "<u4").tolist() == ids, text
        assert ours.decode(found) == library.decode(ids, skip_special_tokens=False), text


def test_merging_by_queue_equals_merging_by_scans():
    """Always joining the leftmost pair of the lowest rank, found anew each time, gives the same symbols."""
    model = bpe.Bpe(default_path())
    rng = random.Random(8)
    for _ in range(300):
        word = "".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 40)))
        symbols = [model.vocab[c] for c in word[:-1]] + [model.vocab[word[-1] + model.ends]]
        ids = list(symbols)
        while True:
            found = [(model.ranks.get(a * model.size + b), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
            pairs = [p for p in found if p[0] is not None]
            if not pairs:
                break
            rank, i = min(pairs)
            ids[i : i + 2] = [model.merged[rank]]
        assert model.merge(symbols) == ids


def test_encode_and_decode_columns(spark, strings):
    library = Tokenizer.from_file(default_path())
    texts = [None, *strings[-12:], strings[5], strings[5], "long " * 60_000]
    df = documents(spark, [(i if i % 5 else None, t) for i, t in enumerate(texts)])
    encoded = bpe.encode_texts(df)
    assert set(encoded.columns) == set(df.columns) and dict(encoded.dtypes)["ids"] == "binary"
    found = bpe.decode_ids(encoded, text="score").collect()
    assert len(found) == len(texts) and all(r["_row"] == 7 for r in found)
    for row in found:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids
        assert row["score"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.decode_ids(bpe.encode_texts(documents(spark, []))).collect() == []
    nothing = spark.createDataFrame([(None,), (np.array([0, 10**6], "<u4").tobytes(),)], "ids binary")
    assert [r["decoded"] for r in bpe.decode_ids(nothing).collect()] == ["", "!"]


def test_unknown_kinds_of_tokenizer_are_refused(tmp_path):
    import json

    spec = json.load(open(default_path()))
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Bpe(str(tmp_path / "t.json"))


# --- hard negatives ---


def brute_negatives(rows, every, n_positives, n_negatives, low, high, scale):
    able = [
        (i, y, [math.floor(scale * x) for x in v])
        for i, y, v in rows
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, y, v in able:
        if i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in able if j != i]
        positives = heapq.nsmallest(n_positives, ((-s, j) for s, j, z in scored if z == y))
        for p, j in positives:
            fitting = ((-s, k) for s, k, z in scored if z != y and low * -p <= 100 * s <= high * -p)
            for rank, (s, k) in enumerate(heapq.nsmallest(n_negatives, fitting), 1):
                out.append((i, j, rank, k, -p, -s))
    return out


VECTORS = "vec_id long, embedding array<float>, label int, anchor string, down long"


def vectors(spark, rows):
    let_workers_import(spark)
    return spark.createDataFrame([(i, v, y, "clash", 1) for i, y, v in rows], VECTORS).repartition(3)


@pytest.fixture(scope="module")
def points():
    rng = random.Random(4)
    made = []
    for i in range(400):
        v = [float(np.float32(rng.gauss(0.2, 0.3))) for _ in range(6)]
        made.append((i, rng.randrange(4), v))
    same = made[17][2]
    made += [(400 + i, rng.randrange(4), same) for i in range(150)]  # a third of all rows tie
    made += [(600 + i, 1, [0.0] * 6) for i in range(20)] + [(650, 2, [0.0] * 6)]
    made += [(700, 1, []), (701, 2, [0.5, 0.5]), (702, 1, [9.0] * 9), (703, None, same), (None, 1, same), (704, 1, None)]
    made += [(750, 1, [0.1, None, 0.2]), (751, 1, [float("nan")] * 6), (752, 1, [float("inf")] * 6), (-50, 3, same)]
    made += [(100, 0, same), (100, 2, made[100][2]), (800, 77, same)] + [made[33]] * 3
    return made


@pytest.mark.parametrize(("blocks", "args"), [
    ((512, 4096), (50, 5, 3, 50, 95, 256)),
    ((3, 16), (50, 5, 3, 50, 95, 256)),
    ((2, 7), (10, 2, 4, 0, 100, 16)),
])
def test_hard_negatives_equal_brute_force(spark, points, blocks, args):
    """Also with small blocks, so that every anchor's rows come from many of them."""
    found = hard_negatives.mine_hard_negatives(vectors(spark, points), *args, sizes=blocks)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, found.collect())) == Counter(brute_negatives(points, *args))


def test_hard_negatives_without_anchors_or_rows(spark, points):
    assert hard_negatives.mine_hard_negatives(vectors(spark, [])).collect() == []
    rest = [p for p in points if p[0] is not None and p[0] % 50]
    assert hard_negatives.mine_hard_negatives(vectors(spark, rest)).collect() == []


def test_scores_beyond_the_limit_are_an_error(spark):
    with pytest.raises(Exception, match="inner products"):
        hard_negatives.mine_hard_negatives(vectors(spark, [(0, 1, [1e20]), (1, 1, [1e20])])).collect()
