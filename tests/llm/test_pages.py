"""Archives, the capture index and the pipeline."""

from __future__ import annotations

import base64
import glob
import gzip
import hashlib

import pytest

import corpus_pipeline
from famloom.llm import decontaminate, language_id, line_dedup, minhash, warc
from famloom.llm.common import table
from famloom.llm.token_files import new_folder

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    odd = [
        (1000, "http://a b.c/x\n", None),
        (1001, None, ""),
        (1002, "https://q.de:8080/?z=1", "é" * 9_000_000),
        (1003, "https://q.de:8080/?z=1", "é" * 9_000_000),
        (1003, "https://q.de:8080/?z=1", "é" * 9_000_000),
        (None, "http://www.x.de/", "same"),
        (1004, "http://x.de/", "same"),
    ]
    return table(spark, FOLDER, "pages").unionByName(spark.createDataFrame(odd, SCHEMA))


def by_force(pages, least=0):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first: dict[bytes, int] = {}
    for page, payload in rows:
        if page is not None and len(payload) >= least:
            first[payload] = min(first.get(payload, page), page)
    out = []
    for page, payload in rows:
        head = first.get(payload)
        copy = head is not None and head != page
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "revisit" if copy else "response", head if copy else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,ranges", [(0, True), (10, False)])
def test_archives_and_index(spark, pages, monkeypatch, least, ranges):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "SHARD_LINES", 20)
    if not ranges:
        monkeypatch.setattr(warc, "_arrow_reads", lambda path: False)
    path = new_folder(spark, "test")
    warc.write_archives(pages, path, least)
    warc.build_index(spark, path)
    lines = warc.lookup(spark, path, pages)
    found = warc.fetch(spark, path, lines).drop("url")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == by_force(pages, least)
    one = warc.lookup(spark, path, pages.filter("page_id = 1004")).collect()
    assert [r.page_id for r in one] == [1004]
    assert warc.lookup(spark, path, spark.createDataFrame([(5, "http://no.where/", "")], SCHEMA)).count() == 0
    archive = glob.glob(path.removeprefix("file:") + "/archives/part-*")[0]
    with gzip.open(archive) as file:
        assert file.read(8) == b"WARC/1.1"


def test_no_pages(spark, pages):
    path = new_folder(spark, "test")
    none = pages.filter("false")
    warc.write_archives(none, path)
    warc.build_index(spark, path)
    assert warc.fetch(spark, path, warc.lookup(spark, path, none)).count() == 0


def test_url_keys():
    assert warc.url_key("https://www.News.example.com:443/a?b=1#c") == "com,example,news)/a?b=1"
    assert warc.url_key("http://[bad") == "http://[bad"


def test_pipeline(spark):
    pieces = corpus_pipeline.run(spark, FOLDER)
    kept = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    docs = table(spark, FOLDER, "documents")
    items = table(spark, FOLDER, "benchmark")
    known = language_id.keep_identified(docs)
    after = line_dedup.drop_repeated_lines(known, drop_emptied=True, min_words=line_dedup.PASSAGE_WORDS)
    near = minhash.keep_one_of_each(after)
    want = {r.doc_id for r in decontaminate.drop_contaminated(near, items).select("doc_id").collect()}
    assert kept == want and 0 < len(kept) < docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "near_dedup", "decontamination", "packing",
    ]


def test_stages_keep_the_columns(spark):
    docs = table(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
