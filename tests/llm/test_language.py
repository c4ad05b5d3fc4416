import random

from bagtree.llm.language import declared_of, host_of, identify, train, visible_text
from pyspark.sql import functions as F
from tests.llm.helpers import DOCUMENTS

PAGES = "page_id long, url string, html string, host string"
SPOKEN = {"aa": "lorem ipsum dolor sit amet", "bb": "der die das und nicht ein", "cc": "que una para los por"}


def text(rng, language, words):
    return " ".join(rng.choice(SPOKEN[language].split()) for _ in range(words))


def model(spark):
    rng = random.Random(1)
    data = [(i, text(rng, lang, 60), lang.upper() if i % 2 else lang, "s", 1) for i, lang in enumerate(list(SPOKEN) * 20)]
    data += [(900, None, "aa", "s", 1), (901, "x", None, "s", 1), (902, "", "bb", None, None)]
    return train(spark.createDataFrame(data, DOCUMENTS))


def test_text_alone_and_odd_rows(spark):
    rng = random.Random(2)
    pages = [(i, f"http://h{i}.example.org/", f"<p>{text(rng, lang, 40)}</p>", "x") for i, lang in enumerate(list(SPOKEN) * 3)]
    pages += [(100, None, None, None), (101, "", "", ""), (102, "no address", "<script>der die das", "x"), (102, "no address", "<b>", "x")]
    pages += [(None, "http://1.2.3.4:80/x", "<html lang=cc>" + "<p>" * 10, "x"), (103, "ftp://u:p@H.Example.AA/", "x" * 200_000, "x")]
    got = identify(spark.createDataFrame(pages, PAGES), model(spark)).collect()
    assert len(got) == len(pages)
    by_id = {r.page_id: r for r in got}
    assert all(by_id[i].lang == lang for i, lang in enumerate(list(SPOKEN) * 3))
    assert all(r.lang in SPOKEN and 0 < r.probability <= 1 for r in got)
    assert by_id[100].text_lang is None and by_id[None].declared == "cc" and by_id[None].suffix == ""
    assert by_id[103].host == "h.example.aa" and by_id[103].suffix == "aa"


def test_evidence_decides_where_the_text_does_not(spark):
    """Pages without text: by their host, else their domain, else the declaration, all learned from the others' texts."""
    rng = random.Random(3)
    pages, number = [], 0
    for lang, host in (("aa", "one.big.org"), ("bb", "two.big.org"), ("cc", "www.small.cc")):
        for _ in range(40):
            pages.append((number, f"http://{host}/p", f"<html lang='{lang}'><p>{text(rng, lang, 30)}", ""))
            number += 1
    extra = [
        (900, "http://one.big.org/", "", ""), (901, "http://two.big.org/", "", ""), (902, "http://new.small.cc/", "", ""),
        (903, "http://elsewhere.org/", "<html lang=bb>", ""), (904, "http://elsewhere.cc/", "", ""),
    ]
    got = {r.page_id: r for r in identify(spark.createDataFrame(pages + extra, PAGES), model(spark)).collect()}
    assert [got[i].lang for i in range(900, 905)] == ["aa", "bb", "cc", "bb", "cc"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], PAGES)
    assert identify(empty, model(spark)).collect() == []
    untaught = train(spark.createDataFrame([], DOCUMENTS))
    got = identify(spark.createDataFrame([(1, "http://a.de/", "<p>x", "")], PAGES), untaught).collect()
    assert [(r.page_id, r.lang) for r in got] == [(1, None)]


def test_markup_and_addresses(spark):
    pages = [
        ('<HTML class="x" LANG="de-AT"><p>', "de"), ("<html xml:lang=fr>", "fr"), ("<html><meta http-equiv='Content-Language' content='es'>", "es"),
        ("<p lang=en>", ""), (None, ""),
    ]
    frame = spark.createDataFrame([(p, e) for p, e in pages], "html string, e string")
    assert all(r.d == r.e for r in frame.select(declared_of(F.col("html")).alias("d"), "e").collect())
    urls = [("https://A.b.example.com:80/x?y", "a.b.example.com"), ("http://h#x", "h"), ("mailto:x@y", ""), (None, "")]
    frame = spark.createDataFrame(urls, "url string, e string")
    assert all(r.h == r.e for r in frame.select(host_of(F.col("url")).alias("h"), "e").collect())


def test_visible_text():
    page = "<title>A</title><style>b{}</style><script>var c='<p>';</script><!-- d --><p class='e'>f &amp; g<br>h</p><script>i"
    assert visible_text(page).split() == ["A", "f", "&", "g", "h"]
    assert visible_text(None) == ""
