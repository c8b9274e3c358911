"""JSON of every article, those without a title or with a slash in it too."""

import json

from tarrafa import queries


def test_every_row_becomes_json(spark, tmp_path):
    data = [("https://x/1", None), ("https://x/2", "a/b \\ \"c\" \n é"), ("https://x/3", ""), ("https://x/4", "t")]
    spark.createDataFrame(data, "url string, title string").write.parquet(f"{tmp_path}/g1_articles.parquet")
    got = {r["url"]: json.loads(r["body"]) for r in queries.QUERIES["json_rows_all"](spark, str(tmp_path)).collect()}
    assert got == {u: {"title": t, "url": u} for u, t in data}
