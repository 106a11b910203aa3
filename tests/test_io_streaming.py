"""CSV round trip, the required-column guard on CSV, and batch = stream."""

import os
import tempfile

import pytest

from tidings.catalog import SCORED_COLUMNS
from tidings.operators.score import analyze
from tidings.sources.csv_io import read_headlines_csv, read_headlines_folder, write_results_csv
from tidings.sources.news import news_items
from tidings.streaming.live import live_counts, live_scores


def test_csv_round_trip_with_quotes(spark):
    rows = [(1, 'He said "solar", then left', "01-02-2024"), (2, "line one\nline two, with comma", "x"),
            (3, "plain", None)]
    df = spark.createDataFrame(rows, ["doc_id", "Headline", "Date"])
    out = analyze(df)
    path = os.path.join(tempfile.mkdtemp(prefix="csv-"), "out")
    write_results_csv(out, path)
    back = read_headlines_csv(spark, path, schema=out.schema)
    assert sorted(back.collect()) == sorted(out.collect())


def test_csv_keeps_cells_as_they_are(spark):
    rows = [(1, "  lead and trail  "), (2, ""), (3, None), (4, 'q "x", y'), (5, "a\nb\r\nc"), (6, '""'), (7, "\t"), (8, "\u3000x "), (9, "\\"), (10, '"'), (11, " ")]
    df = spark.createDataFrame(rows, "doc_id long, Headline string")
    path = os.path.join(tempfile.mkdtemp(prefix="csv-"), "out")
    write_results_csv(df, path, max_records=3)
    assert sorted(tuple(r) for r in read_headlines_csv(spark, path, schema=df.schema).collect()) == rows
    one_line = df.filter("doc_id <> 5")
    write_results_csv(one_line, path + "2")
    assert read_headlines_csv(spark, path + "2", schema=df.schema, multi_line=False).count() == 10


def test_pandas_style_csv_reads(spark):
    d = tempfile.mkdtemp(prefix="csvin-")
    p = os.path.join(d, "in.csv")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write('Headline,Date,Headline link\n"Tata Power commissions 500MW solar plant",15-03-2024,/a\n'
                 '"ONGC reports ""record"" profit",20-03-2024,/b\n')
    df = read_headlines_csv(spark, p)
    assert df.count() == 2 and "Headline link" in df.columns


def test_a_folder_of_files_with_different_columns_is_read_by_name(spark, tmp_path):
    files = {
        "a.csv": 'Headline,Date,n\nGAIL loss,2021-02-03,1\n"two\nlines, here",2021-02-04,2\n',
        "b.csv": '\ufeffDate,Headline\n2021-02-05,NHPC wins\n2021-02-06,short\n2021-02-07\n',
        "c d.csv": 'n,Headline,Headline link,n\n7,"q ""x""",/l,8\n,"",/m,\n',
        "e.csv": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    rows, rejected = read_headlines_folder(spark, str(tmp_path))
    assert dict(rows.dtypes) == {"Headline": "string", "Date": "date", "n": "int", "Headline link": "string", "n.1": "int"}
    got = {(r["Headline"], str(r["Date"]), r["n"], r["Headline link"], r["n.1"]) for r in rows.collect()}
    assert got == {("GAIL loss", "2021-02-03", 1, None, None), ("two\nlines, here", "2021-02-04", 2, None, None),
                   ("NHPC wins", "2021-02-05", None, None, None), ("short", "2021-02-06", None, None, None), (None, "2021-02-07", None, None, None),
                   ('q "x"', "None", 7, "/l", 8), ("", "None", None, "/m", None)}
    assert rejected.count() == 0 and read_headlines_csv(spark, str(tmp_path)).count() == 7
    (tmp_path / "f.csv").write_text("Title,n\nx,1\n")
    with pytest.raises(ValueError, match="f.csv"):
        read_headlines_csv(spark, str(tmp_path))


def test_records_with_too_many_cells_are_set_aside_with_file_and_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Headline,n\nfine,1\nbad,2,3\n"has\nbreak",4\nbad,2,3\nshort\n"bad\ntoo",5,6,7\ntrailing,8,\n')
    (tmp_path / "b.csv").write_text("n,Headline\n1,fine\n9,8,bad\n")
    rows, rejected = read_headlines_folder(spark, str(tmp_path))
    assert sorted((r["Headline"], r["n"]) for r in rows.collect()) == sorted([("fine", 1), ("has\nbreak", 4), ("short", None), ("trailing", 8), ("fine", 1)], key=str) or \
        {(r["Headline"], r["n"]) for r in rows.collect()} == {("fine", 1), ("has\nbreak", 4), ("short", None), ("trailing", 8)}
    found = sorted((os.path.basename(r["file"]), r["line"], r["record"].strip()) for r in rejected.collect())
    assert found == [("a.csv", 3, "bad,2,3"), ("a.csv", 6, "bad,2,3"), ("a.csv", 8, '"bad\ntoo",5,6,7'), ("b.csv", 3, "9,8,bad")]
    with pytest.raises(Exception, match="more cells than columns"):
        read_headlines_csv(spark, str(tmp_path)).collect()


def test_missing_headline_column_fails_early(spark):
    d = tempfile.mkdtemp(prefix="csvbad-")
    p = os.path.join(d, "in.csv")
    with open(p, "w") as fh:
        fh.write("Title\nx\n")
    try:
        read_headlines_csv(spark, p)
    except ValueError:
        return
    raise AssertionError("expected ValueError")


def test_stream_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    batch = analyze(news_items(spark, sf)).select(*SCORED_COLUMNS)
    stream = live_scores(spark, sf).select(*SCORED_COLUMNS)
    assert sorted(stream.collect()) == sorted(batch.collect())
    counts = {(r.sentiment, r.esg_flag): r.n for r in live_counts(spark, sf).collect()}
    expect = {}
    for r in batch.collect():
        expect[(r.sentiment, r.esg_flag)] = expect.get((r.sentiment, r.esg_flag), 0) + 1
    assert counts == expect


def test_live_queries_resume_on_a_folder_table(spark):
    """The table is a folder of part files. A query that is stopped and started
    again on its checkpoint reads only what is new: scores are not repeated, and
    counts and the pivot go on."""
    import pyarrow.parquet as pq

    from tidings.operators.reports import company_sentiment_top
    from tidings.streaming.live import live_top_companies

    sf = "/root/testdata/sf0.001"
    table = pq.read_table(f"{sf}/documents.parquet")
    root = tempfile.mkdtemp(prefix="docs-stream-")
    folder = os.path.join(root, "documents.parquet")
    os.mkdir(folder)
    third = table.num_rows // 3
    paths = {k: (os.path.join(root, f"{k}-out"), os.path.join(root, f"{k}-ckpt")) for k in ("scores", "counts", "top")}
    for i in range(3):
        part = table.slice(i * third, third if i < 2 else table.num_rows - 2 * third)
        pq.write_table(part, os.path.join(folder, f"part-{i:04d}.parquet"))
        so_far = analyze(news_items(spark, root))
        scores = live_scores(spark, root, *paths["scores"]).select(*SCORED_COLUMNS)
        assert sorted(scores.collect(), key=str) == sorted(so_far.select(*SCORED_COLUMNS).collect(), key=str)
        counts = live_counts(spark, root, *paths["counts"])
        assert sum(r.n for r in counts.collect()) == so_far.count()
        live = sorted(tuple(r) for r in live_top_companies(spark, root, 6, *paths["top"]).collect())
        assert live == sorted(tuple(r) for r in company_sentiment_top(so_far).collect()) and len(live) == 6
