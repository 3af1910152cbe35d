"""Joined names are split by words that occur apart, however often the joined name itself occurs."""

from orrery.llm import url_filter


def test_joined_names_with_many_pages_and_subdomains(spark):
    rows = [(i, f"http://plain{i % 50}.net/de/{i}", f"<title>word{'abcdefghij'[i % 10]} other{'klmnopqrst'[i // 10 % 10]} text</title>") for i in range(3000)]
    rows += [(4000 + i, f"http://cheap-garden-tools{i}.com/en/{i}", None) for i in range(20)]
    rows += [(5000 + i, f"http://s{i % 10}.gardentools.org/xx/{i}", None) for i in range(200)]
    rows += [(6000 + i, f"http://cheapgardentools.org/xx/{i}", None) for i in range(200)]
    rows += [(7000 + i, f"http://example.org/cheapgardentools/{i}/cheapgardentools.html", None) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = url_filter.verdicts(pages).where("page_id between 5000 and 6999").select("verdict").distinct().collect()
    assert [r.verdict for r in found] == ["block"]


def test_kept_apart(spark):
    got = spark.createDataFrame([("cheap-pills.example.com",), ("news/big_day-7-x/joinedname7.html",), ("a-7",), ("",)], "t string")
    assert [r[0] for r in got.select(url_filter.kept_apart(got.t)).collect()] == [["cheap", "pills"], ["big", "day", "x"], [], []]
