"""Weights of op1 where few pages are labelled."""

from lexiframe.llm import main_text
from lexiframe.session import let_workers_import


def test_labelled_pages_are_chosen_among_all_pages(spark):
    let_workers_import(spark)
    bare = [(i, f"<div><p>page {i} has no label</p></div>") for i in range(200)]
    labelled = [(1000, "<nav>menu here</nav><article><p>some good words</p></article>"), (1001, "<ul><li>x</li></ul><main><p>more words</p></main>")]
    odd = [(None, None), (1002, ""), (1003, "<article>a</article><article>b</article>"), (1000, labelled[0][1])]
    schema = "page_id long, html string"
    pages = spark.createDataFrame([*bare, *labelled, *odd], schema)
    expected = main_text.weights_of(spark.createDataFrame([*labelled, odd[-1]], schema))
    assert expected and main_text.weights_of(pages, 2) == expected
    assert len(main_text.weights_of(pages, 1)) < len(expected)
    assert main_text.weights_of(spark.createDataFrame(bare, schema)) == {}
