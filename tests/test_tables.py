from pyspark.sql import functions as F

from sparkfolio.functions import tables as G


def run(spark, grid, column):
    return spark.createDataFrame([(grid,)], "g array<array<string>>").select(column(F.col("g")).alias("x")).first()[0]


def tidy(c):
    return G.rows_of(G.merge_columns(G.drop_repeated_columns(G.columns_of(G.clean(c)))))


def test_repeated_columns_and_wrapped_header(spark):
    grid = [["Province", "Value of", "Value of"], ["", "(PKR Million)", "(PKR Million)"], ["Sindh", "1,200", "1,200"], ["Punjab", "30", "30"]]
    assert run(spark, grid, lambda c: G.to_markdown(tidy(c))) == "| Province | Value of (PKR Million) |\n| --- | --- |\n| Sindh | 1,200 |\n| Punjab | 30 |"


def test_complementary_columns_merge(spark):
    grid = [["Head", "", "Figure"], ["", "a", "1"], ["", "b", "2"]]
    assert run(spark, grid, tidy) == [["Head", "Figure"], ["a", "1"], ["b", "2"]]


def test_text_only_table_keeps_its_body(spark):
    grid = [["Role", "Duty"], ["Lead", "Coordinate"], ["Staff", "Report"]]
    assert run(spark, grid, G.header_depth) == 1


def test_gate_and_empty_grids(spark):
    assert not run(spark, [["x"]], G.is_reliable)
    assert not run(spark, [], G.is_reliable)
    assert run(spark, [["a", "b"], ["1", "2"]], G.is_reliable)


def test_split_repeats_the_header(spark):
    table = "| h |\n| --- |\n" + "\n".join(f"| {i:03d} |" for i in range(20))
    parts = spark.createDataFrame([(table,)], "t string").select(G.split_markdown(F.col("t"), 60)).first()[0]
    assert all(p.startswith("| h |\n| --- |\n") and len(p) <= 60 for p in parts)
    assert [x for p in parts for x in p.split("\n")[2:]] == table.split("\n")[2:]
