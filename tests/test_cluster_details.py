"""Details of clusters by distinct texts are those of whole texts."""

import datetime as dt

from pyspark.sql import functions as F

from newsdesk.operators import reports

DAY = dt.datetime(2026, 8, 1)


def test_f11_f13_details_are_those_of_whole_texts(spark, monkeypatch):
    """Clusters beyond the limit, with texts that open what the next one closes, blank summaries and late investors."""
    monkeypatch.setattr(reports, "WHOLE_REPORTS", 3)
    titles = ["Alpha完成5亿元A轮融资", "“Beta", "Gamma”获融资 5", "万元，由甲", "乙资本领投。其他", "平台", "", "投资方包括", "丙基金、丁基金；后记", 'Delta "Two" 完成B轮', None]
    summaries = ["由甲资本领投", "", None, "长" * 230 + "。尾", "跟投。又说；再说", "x" * 300]
    rows = []
    for c in range(60):
        for k in range(1 + c % 9):
            title, summary = titles[(c * 7 + k * (1 + c % 3)) % len(titles)], summaries[(c + k * (c % 4)) % len(summaries)]
            if c % 5 == 0:
                title, summary = titles[0], summaries[c % 6]
            rows.append((c, 100 * c + k, DAY + dt.timedelta(hours=k % 4), title, summary, f"s{k % 2}"))
    members = spark.createDataFrame(rows, "cluster_id long, content_id long, shown timestamp_ntz, title string, summary string, source_name string")
    one = F.struct("shown", "content_id", "title", "summary", "source_name", F.concat_ws("\n", "title", F.coalesce("summary", F.lit("")), F.lit("")).alias("_text"))
    listed = members.groupBy("cluster_id").agg(F.sort_array(F.collect_list(one), False).alias("m"))
    empty = F.array().cast("array<string>")
    want = reports._details(reports._whole(listed.select("cluster_id", "m", F.array_join("m._text", "\n").alias("t"), empty.alias("c"), empty.alias("i"))))
    assert sorted(map(repr, reports.cluster_detail(members).collect())) == sorted(map(repr, want.collect()))
