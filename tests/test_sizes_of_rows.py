"""What a row costs: expressions that are not repeated and paths that stay short."""

from pyspark.sql import functions as F

from lotwise.operators import redaction
from lotwise.sources.html import label_map


def test_a_page_is_searched_once_for_each_group_of_its_labels(spark):
    page = "<li class='list-group-item'> <span class='badge'>A </span> 1</li><li class='list-group-item'> <span class='badge'>A </span> 2</li>"
    df = spark.createDataFrame([(page,)], "html string").select(label_map(F.col("html")).alias("m"))
    assert df.first()["m"] == {"A": "2"}
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 3


def test_values_of_json_have_short_names(spark):
    root = spark.createDataFrame([(1, '{"a":{"b":1},"c":[1,2]}')], "id long, text string").selectExpr("id", "text", "'' node", "'' parent", "0 pos", "cast(null as string) key", "'string' kind", "false quoted")
    level = redaction._parted(root).select(*redaction._COLUMNS)
    for depth in range(3):
        level = redaction._parted(redaction._opened(level, depth)).select(*redaction._COLUMNS)
    nodes = [r["node"] for r in level.collect()]
    assert len(nodes) == len(set(nodes)) == 3 and max(map(len, nodes)) <= 6
