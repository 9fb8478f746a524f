import pytest
from pyspark.sql import functions as F

from actlake.functions.text import CHATML, layer_from_key, parse_rid, render_chat


@pytest.mark.parametrize("rid,prefix,pid,cidx", [
    ("1|0", 0, 1, 0), ("1|2|3", 7, -1, 7), ("x|0", 3, -1, 3), (" 7 |+1", 0, 7, 1), ("", 5, -1, 5),
    (None, 2, -1, 2), ("1_0|2", 0, 10, 2), ("12|-3", 0, 12, -3), ("99999999999999999999|0", 4, -1, 4),
])
def test_parse_rid(spark, rid, prefix, pid, cidx):
    df = spark.createDataFrame([(rid, prefix)], "rid string, prefix_len int")
    p, c = parse_rid(F.col("rid"), F.col("prefix_len"))
    r = df.select(p.alias("p"), c.alias("c")).first()
    assert (r.p, r.c) == (pid, cidx)


def test_render_chat(spark):
    df = spark.createDataFrame([("hi", "there", None), ("q", "a", ""), ("q", "a", "sys")],
                               "p string, c string, s string")
    out = [r.t for r in df.select(render_chat("p", "c", F.col("s"), CHATML).alias("t")).collect()]
    assert out[0] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nthere"
    assert out[1] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na"
    assert out[2].startswith("<|im_start|>system\nsys<|im_end|>\n<|im_start|>user\nq")


def test_layer_from_key(spark):
    df = spark.createDataFrame([("layer_16",), ("layer_x",), ("other",), ("layer_007",), ("layer_",)], "k string")
    assert [r.l for r in df.select(layer_from_key("k").alias("l")).collect()] == [16, None, None, 7, None]


@pytest.mark.parametrize("n,expect", [
    (1, [0]), (4, [0, 1, 2, 3]), (5, [0, 1, 2, 3, 4]), (6, [0, 1, 5, 3, 4]), (100, [0, 1, 5, 25, 50, 75, 95, 99]),
])
def test_sample_positions_clamped_and_distinct(spark, n, expect):
    from actlake.operators.compare import sample_positions
    got = spark.createDataFrame([(n,)], "n long").select(sample_positions("n").alias("p")).first().p
    assert got == expect
