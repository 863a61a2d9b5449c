"""Paragraphs and CSV records that reach over the edges of input splits, against plain Python."""

import contextlib
import csv
import io
import random
import re

import pytest

from lexiframe.sources import corpus, stitching


@contextlib.contextmanager
def splits_of(spark, size):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def expected_paragraphs(data: bytes, least: int) -> list[str]:
    text = re.sub("\r\n?", "\n", data.decode("utf-8", "ignore"))
    return [p.strip() for p in re.split(r"\n\s*\n+", text) if len(p.strip()) > least]


def expected_lines(data: bytes, least: int) -> list[str]:
    text = re.sub("\r\n?", "\n", data.decode("utf-8", "ignore"))
    return [line.strip() for line in text.split("\n") if len(line.strip()) > least]


def random_text(rng, n_lines, blank, end):
    lines = []
    for _ in range(n_lines):
        if rng.random() < blank:
            lines.append(rng.choice(["", " ", "\t ", " ", "\x1c", "  "]))
        else:
            words = " ".join(rng.choice(["alpha", "Émile", "日本語", "x", "don't"]) for _ in range(rng.randint(1, 9)))
            lines.append(rng.choice(["", "  ", "　"]) + words + rng.choice(["", " ", "\t"]))
    data = end.join(lines).encode()
    return data.replace(b"alpha", b"al\xffpha", 1)


def write_files(folder, seed, blank, end):
    rng = random.Random(seed)
    contents = {}
    for name in ("a.txt", "b.txt", "c.txt"):
        contents[name] = random_text(rng, rng.choice([1, 20, 45]), blank, end)
    contents["e.txt"] = end.encode() * 3 + b"first after blank lines" + end.encode() * 2
    contents["f.txt"] = b""
    for name, data in contents.items():
        (folder / name).write_bytes(data)
    return contents


@pytest.mark.parametrize(("seed", "blank", "end"), [(1, 0.3, "\n"), (2, 0.3, "\r\n"), (3, 0.05, "\n"), (4, 0.0, "\r\n"), (5, 0.6, "\r"), (6, 0.02, "\n")])
def test_paragraphs_over_many_splits(spark, tmp_path, seed, blank, end):
    contents = write_files(tmp_path, seed, blank, end)
    paragraphs = {name: expected_paragraphs(data, 10) for name, data in contents.items()}
    either = {name: p if len(p) >= 10 else expected_lines(contents[name], 10) for name, p in paragraphs.items()}
    for size in (211, 10**8) if seed == 1 else (211,):
        with splits_of(spark, size):
            docs = corpus.read_paragraphs(spark, str(tmp_path)).orderBy("doc_id").collect()
            assert [r.text for r in docs] == [p for name in sorted(paragraphs) for p in paragraphs[name]]
            assert [r.doc_id for r in docs] == list(range(len(docs)))
            mixed = corpus.read_paragraphs_or_lines(spark, str(tmp_path)).orderBy("doc_id").collect()
            assert [r.text for r in mixed] == [p for name in sorted(either) for p in either[name]]
            assert [r.doc_id for r in mixed] == list(range(len(mixed)))


def test_a_file_without_blank_lines_is_read_by_many_tasks(spark, tmp_path):
    """Its one paragraph is counted by the lengths of its pieces and never put together for its lines."""
    lines = [f"line number {i} of a file without blank lines" for i in range(1500)]
    (tmp_path / "a.txt").write_bytes("\r\n".join(lines).encode())
    with splits_of(spark, 8000):
        found = corpus._paragraphs(spark, str(tmp_path), 10)
        assert found.splits.count() > 5 and found.whole.count() == 0
        assert found.pieces.selectExpr("max(length(value)) AS n").first().n <= 8100
        docs = corpus.read_paragraphs_or_lines(spark, str(tmp_path)).orderBy("doc_id").collect()
        assert [r.text for r in docs] == lines
        assert [r.text for r in corpus.read_paragraphs(spark, str(tmp_path)).collect()] == ["\n".join(lines)]


def test_first_unit_of_a_split_in_pieces(spark, tmp_path):
    """A long first paragraph leaves its task in pieces of a given size."""
    lines = [f"line {i}" for i in range(500)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n\nanother paragraph\n")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        records, extra = corpus._scan(spark, str(tmp_path))
        blank = records.selectExpr("file", "_split", "value", "length(trim(value)) = 0 AS _blank")
        rows = stitching.assemble(blank, extra, corpus._blank_breaks, piece_chars=300).collect()
        pieces = [r.value for r in rows if r._kind == stitching.PIECE]
        assert len(pieces) > 5 and max(map(len, pieces)) < 600
        assert "\n".join(pieces[:-1]) == "\n".join(lines) and pieces[-1] == "another paragraph"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_partition_columns_stay(spark, tmp_path):
    for lang, text in (("en", "one paragraph\n\nanother paragraph"), ("fr", "un paragraphe\n\nun autre encore")):
        (tmp_path / f"lang={lang}").mkdir()
        (tmp_path / f"lang={lang}" / "part.txt").write_text(text)
    with splits_of(spark, 20):
        rows = corpus.read_paragraphs(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.lang, r.text) for r in rows] == [
        ("en", "one paragraph"), ("en", "another paragraph"), ("fr", "un paragraphe"), ("fr", "un autre encore")
    ]


def records_of(data: bytes) -> list[str]:
    """The texts of a file, as a plain CSV reader gives them."""
    rows = list(csv.reader(io.StringIO(data.decode(), newline="")))
    at = rows[0].index("text")
    return [r[at] for r in rows[1:] if r and r[at] not in corpus.CSV_NULLS]


def random_csv(rng, n, end):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "text", "note"])
    parts = ["plain", "with, comma", 'a "quoted" word', "line" + end + "break", end, '"', '""', "Ünï 日本", "", "NA", "007", "'", end * 2 + "x"]
    for i in range(n):
        writer.writerow([i, rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randint(1, 4))), rng.choice(parts)])
        if rng.random() < 0.1:
            out.write(end)  # a blank line between records
    return out.getvalue().encode()


@pytest.mark.parametrize(("seed", "end"), [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_csv_records_over_many_splits(spark, tmp_path, seed, end):
    rng = random.Random(seed)
    contents = {f"{c}.csv": random_csv(rng, rng.choice([0, 5, 60]), end) for c in "abc"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data if name != "b.csv" else data.rstrip())
    expected = [t for name in sorted(contents) for t in records_of((tmp_path / name).read_bytes())]
    with splits_of(spark, 173):
        docs = corpus.read_csv_texts(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.text for r in docs] == expected
    assert [r.doc_id for r in docs] == list(range(len(docs)))


def test_csv_files_that_break_the_format_are_read_as_before(spark, tmp_path):
    """Quotes in unquoted values and mixed line ends: the one-task reader's rows, in their place."""
    files = {
        "a.csv": 'id,text\n1,"good\nvalue"\n2,other\n',
        "b.csv": 'id,text\n1,5" pipe\n2,"a\nb"\n3,12" disk\n',
        "c.csv": 'id,text\n1,"x\r\ny"\n2,z\n',
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data.encode())
    one_task = corpus._csv_values(corpus._csv_reader(spark, str(tmp_path / "b.csv"), True), "text").collect()
    mixed = corpus._csv_values(corpus._csv_reader(spark, str(tmp_path / "c.csv"), True), "text").collect()
    with splits_of(spark, 9):
        docs = corpus.read_csv_texts(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.text for r in docs] == ["good\nvalue", "other", *(r.text for r in one_task), *(r.text for r in mixed)]
    assert [r.doc_id for r in docs] == list(range(len(docs)))
