"""Pages are parsed and handed on a few at a time."""

from pyspark.sql import functions as F

from newsdesk.operators import pages


def test_f15_pages_are_handed_on_a_few_at_a_time(spark):
    html = "<title>T</title><a href='/a'>one &amp; two</a><p>" + "word " * 9 + "</p>"
    got = pages.parse_pages(spark.range(0, 150, 1, 1).select(F.concat(F.lit("http://x/"), "id").alias("url"), F.when(F.col("id") != 3, html).alias("html")))
    rows = {r.url: r for r in got.collect()}
    assert len(rows) == 150 and rows["http://x/0"].links[0].text == "one & two" and rows["http://x/0"].body.startswith("word") and rows["http://x/3"].links == []
    assert pages.PAGES_TOGETHER < 150
