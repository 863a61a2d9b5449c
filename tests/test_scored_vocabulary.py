"""The sampling queries read the vocabulary of 5,000."""

import os

import pytest
from pyspark.sql import functions as F

from lexiframe.registry import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_words_after_rank_500_are_scored(spark):
    size = queries.vocab_of(spark, SF, 5000).count()
    assert size > 504
    found = queries.scored(spark, SF).agg(F.max("ctx_id").alias("c"), F.max("token_id").alias("t")).first()
    assert found.c == found.t == size - 1


def test_query_settings_reach_generation(spark):
    """Generation starts from words after rank 500 too, which were UNK with 500."""
    _, vocab = queries._model_rows(spark, SF, queries.SCORED_TOP_K)
    assert vocab.count() == queries.vocab_of(spark, SF, 5000).count()
