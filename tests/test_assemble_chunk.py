"""Element assembly, upload check and chunking."""


from kbpipe.operators import assemble as A
from kbpipe.operators import chunk as C


def test_pdf_pages_crawl_and_upload_flavours(spark):
    pages = spark.createDataFrame(
        [(1, 0, " Page one "), (1, 1, ""), (1, 2, "Page two"), (2, 0, ""), (2, 1, "")],
        "doc_id bigint, page_no bigint, text string")
    crawl = {r["doc_id"]: r["text"] for r in A.assemble_pdf_pages(pages).collect()}
    assert crawl == {1: "Page one  Page two"}
    upload = {r["doc_id"]: r["text"] for r in A.assemble_pdf_upload(pages).collect()}
    assert upload == {1: " Page one \nPage two", 2: ""}


def test_sheet_cells(spark):
    cells = spark.createDataFrame(
        [(1, 0, 0, 0, "a"), (1, 0, 0, 1, "b"), (1, 0, 0, 2, "c"),
         (1, 0, 1, 0, "d"), (1, 0, 1, 1, None), (1, 0, 1, 2, "f"),
         (1, 0, 2, 0, None), (2, 0, 0, 0, None)],
        "doc_id bigint, sheet_no bigint, row_no bigint, col_no bigint, value string")
    got = {r["doc_id"]: r["text"] for r in A.assemble_cells(cells).collect()}
    assert got == {1: "a b c d f"}


def test_upload_name_check(spark):
    df = spark.createDataFrame([("report.pdf",), ("report.PDF",), ("report.docx",)], "filename string")
    assert [r["s"] for r in df.select(A.upload_status().alias("s")).collect()] == [200, 400, 400]


def test_chunk_min_length_boundary(spark):
    t40, t41 = "x" * 40, "y" * 41
    df = spark.createDataFrame([(1, f"{t40}\n\n{t41}\n\n  \n\n")], "doc_id bigint, text string")
    chunks = C.chunk_documents(df, "text")
    assert sorted(r["chunk"] for r in chunks.collect()) == [t40, t41]
    assert [r["chunk"] for r in C.indexable(chunks).collect()] == [t41]
    cnt = C.chunk_counts(chunks).first()
    assert (cnt["chunks_processed"], cnt["chunks_indexed"]) == (2, 1)


def test_parity_mode_gives_one_chunk(spark):
    df = spark.createDataFrame([(1, "First paragraph here.\n\nSecond one.")], "doc_id bigint, text string")
    out = C.chunk_documents(df, "text", redact_first=True).collect()
    assert [r["chunk"] for r in out] == ["First paragraph here. Second one."]


def test_names_reach_every_chunk(spark):
    df = spark.createDataFrame([(1, "Subject: John Smith asked.\n\nLater John Smith called back.")],
                               "doc_id bigint, text string")
    out = C.chunk_documents(df, "text").orderBy("chunk_no").collect()
    assert [r["chunk"] for r in out] == ["Subject: [NAME_REDACTED] asked.",
                                         "Later [NAME_REDACTED] called back."]


def test_two_level_concat_equals_single_join(spark):
    import random
    from kbpipe.operators.common import ordered_concat
    rng = random.Random(5)
    rows, expect = [], {}
    for key in range(6):
        items = []
        for pos in rng.sample(range(200), rng.randint(0, 40)):
            v = rng.choice([None, None, "", "a", "bb", "c c"])
            rows.append((key, pos, v))
            items.append((pos, v))
        vals = [v for _, v in sorted(items) if v is not None]
        if items:
            expect[key] = "|".join(vals) if vals else None
    df = spark.createDataFrame(rows, "k int, pos int, v string")
    got = {r["k"]: r["text"] for r in ordered_concat(df, "k", "pos", "v", "|", block=3).collect()}
    assert got == expect


def test_upload_keeps_documents_without_pages(spark):
    pages = spark.createDataFrame([(1, 0, "x")], "doc_id bigint, page_no bigint, text string")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    got = {r["doc_id"]: r["text"] for r in A.assemble_pdf_upload(pages, docs).collect()}
    assert got == {1: "x", 2: ""}


def test_keyword_joined_across_newline_still_found(spark):
    df = spark.createDataFrame([(1, "Kin\nContact: Zoe Taylor came.\n\nLater Zoe Taylor left.")],
                               "doc_id bigint, text string")
    out = [r["chunk"] for r in C.chunk_documents(df, "text").orderBy("chunk_no").collect()]
    assert out == ["Kin Contact: [NAME_REDACTED] came.", "Later [NAME_REDACTED] left."]
