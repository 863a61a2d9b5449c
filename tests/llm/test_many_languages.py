"""Language ID with more languages than fit into a byte, and with columns named like its own."""

import numpy as np
import pytest

from lexiframe.llm import langid
from lexiframe.session import let_workers_import


def brute_viterbi(scores, penalty):
    """Best label of each word, ties to staying and then to the first language."""
    value, came = scores[0].astype(np.float64), []
    for row in scores[1:]:
        top = int(value.argmax())
        stay = value >= value[top] - penalty
        came.append(np.where(stay, np.arange(len(row)), top))
        value = np.maximum(value, value[top] - penalty) + row
    labels = [int(value.argmax())]
    for back in reversed(came):
        labels.append(int(back[labels[-1]]))
    return labels[::-1]


@pytest.mark.parametrize("languages", [1, 3, 256, 257, 300])
def test_viterbi_with_any_number_of_languages(languages):
    rng = np.random.RandomState(languages)
    scores = rng.randint(-8, 0, (40, languages)).astype(np.float32)
    scores[:20, languages - 1] += 5
    texts = [np.arange(20), np.arange(10, 40), np.array([39]), np.empty(0, np.int64)]
    found = langid.viterbi(scores, texts, 3.0)
    assert [list(map(int, f)) for f in found] == [brute_viterbi(scores[at], 3.0) if len(at) else [] for at in texts]
    assert int(found[0][0]) == languages - 1 or languages == 1


def test_a_column_of_the_result_s_inner_name_stays(spark):
    let_workers_import(spark)
    rows = [(1, "one two three", "en", "kept", "old"), (2, None, "en", "kept", "old")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _lang string, score string")
    found = langid.identify_languages(docs, langid.learn_languages(docs)).orderBy("doc_id").collect()
    assert [(r._lang, r.lang_pred, r.spans == []) for r in found] == [("kept", "en", False), ("kept", "und", True)]
