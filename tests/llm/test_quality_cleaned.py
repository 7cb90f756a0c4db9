from geolith.llm import quality


def test_boilerplate_lines_are_dropped_in_order(spark):
    body = " ".join(f"w{k}" for k in range(20))
    rows = [(k, f"first {k} {body}\n\nHOME  page \nlast {k}\nhome page", "h") for k in range(12)]
    rows += [(100, f"home page\n{body}", "other"), (101, None, "h"), (102, "home page", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.cleaned(docs).collect()}
    judged = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert got[3].cleaned_text == f"first 3 {body}\n\nlast 3" and got[3].kept
    assert got[100].cleaned_text == rows[12][1] and got[101].cleaned_text is None and got[102].cleaned_text == ""
    assert all((r.n_boilerplate_words, r.kept) == (judged[i].n_boilerplate_words, judged[i].kept) for i, r in got.items())
