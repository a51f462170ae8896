from pyspark.sql import functions as F

from quillstack.functions import names as n
from quillstack.functions import texts as t


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[1]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[0] for v in values.values())], schema).select(column.alias("x")).first()["x"]


def test_media_type(spark):
    rows = spark.createDataFrame([("mp4",), (".JPG",), ("exe",), (None,)], "ext string")
    assert [r[0] for r in rows.select(n.media_type(F.col("ext"))).collect()] == ["video", "photo", "other", "other"]


def test_parse_name(spark):
    got = one(spark, n.parse_name(F.col("a"), [("clip", "editor")]), a=("abc-123 clip 2024_03_05 1280x720 1080p 4K.mp4", "string"))
    assert (got["date"], got["resolution"], got["code"], got["quality"], got["platform"]) == (None, "1280x720", "abc 123", "4K", "editor")
    got = one(spark, n.parse_name(F.col("a")), a=("a.b/IMG_20240305【x】1440p.x.jpg", "string"))
    assert (got["date"], got["resolution"], got["code"], got["quality"]) == ("20240305", "1440p", None, "1440p")
    got = one(spark, n.parse_name(F.col("a")), a=("2024年3月5 Clip-0123456 AB99 900×800", "string"))
    assert (got["date"], got["resolution"], got["code"], got["quality"]) == ("2024年3月5", "900×800", "AB99", "900×800")
    assert set(one(spark, n.parse_name(F.col("a")), a=(None, "string")).asDict().values()) == {None}
    assert one(spark, n.split_tokens(F.col("a")), a=(" one_two,three、a:b|【c】\u00a0d " + "x" * 41, "string")) == ["one", "two", "three", "a:b", "c", "d"]
    empty = one(spark, n.parse_name(F.col("a")), a=("plain", "string"))
    assert set(empty.asDict().values()) == {None}


def test_hash8_and_normalized_name(spark):
    assert one(spark, n.hash8_from_name(F.col("a")), a=("x_DEADBEEF.mp4", "string")) == "deadbeef"
    assert one(spark, n.hash8_from_name(F.col("a")), a=("x_deadbeefx.mp4", "string")) is None
    assert one(spark, n.hash8_from_name(F.col("a")), a=("lib/x0DEADBEEF", "string")) == "deadbeef"
    assert one(spark, n.hash8_from_name(F.col("a")), a=("deadbeef.cafebabe", "string")) == "deadbeef"
    assert one(spark, n.hash8_from_name(F.col("a")), a=(None, "string")) is None
    assert one(spark, n.is_normalized_name(F.col("a")), a=("VID_20240101_x_deadbeef.mp4", "string"))
    assert one(spark, n.is_normalized_name(F.col("a")), a=(None, "string")) is False


def test_slugs_and_rates(spark):
    rows = spark.createDataFrame([(3723.9,), (62.0,), (5.0,), (0.0,), (None,)], "d double")
    assert [r[0] for r in rows.select(n.duration_slug(F.col("d"))).collect()] == ["1h02m03s", "1m02s", "5s", "0s", "durNA"]
    assert one(spark, n.resolution_slug(F.col("a"), F.col("b")), a=("1920", "string"), b=("", "string")) == "resNA"
    assert one(spark, n.resolution_slug(F.col("a"), F.col("b")), a=(1920, "int"), b=(1080, "int")) == "1920x1080"
    assert one(spark, n.duration_slug(F.col("a")), a=("62.9", "string")) == "1m02s"
    assert one(spark, n.duration_slug(F.col("a")), a=("N/A", "string")) == "durNA"
    assert one(spark, n.parse_rate(F.col("a")), a=("24000/1001", "string")) == 23.976
    assert one(spark, n.parse_rate(F.col("a")), a=("10000/333", "string")) == 30.03
    assert one(spark, n.parse_rate(F.col("a")), a=("1/3", "string")) == 0.3333
    assert one(spark, n.parse_rate(F.col("a")), a=("1/2/3", "string")) is None
    assert one(spark, n.parse_rate(F.col("a")), a=("30000/1001", "string")) == 29.97
    assert one(spark, n.parse_rate(F.col("a")), a=("1/0", "string")) is None
    assert one(spark, n.parse_rate(F.col("a")), a=("25", "string")) == 25.0


def test_safe_component_and_source(spark):
    assert one(spark, n.safe_component(F.col("a")), a=(' ._a\x00b:  c' + "d" * 100, "string")) == "ab c" + "d" * 76
    assert one(spark, n.source_of_path(F.col("a")), a=("/review/x/y/z.mp4", "string")) == "review/x/y"
    assert one(spark, n.source_of_path(F.col("a")), a=("lib/x/z.mp4", "string")) == "lib"


def test_junk_tokens(spark):
    rows = spark.createDataFrame([("12345",), ("deadbeef00",), ("site.com",), ("2024-01-02",), ("a",), ("b" * 33,), ("word",), (None,)], "a string")
    assert [r[0] for r in rows.select(n.is_junk_token(F.col("a"))).collect()] == [True] * 6 + [False, True]


def test_date_key(spark):
    got = one(spark, n.date_key(F.col("m"), F.col("c")), m=(None, "timestamp"), c=("2024-05-06T07:08:09Z", "string"))
    assert tuple(got) == ("20240506_070809", "metadata")
    for text, key in (("on 2024-05-06", "20240506_000000"), ("2024:05:06 07:08", "20240506_070800"), ("20240506T07", "20240506_070000")):
        assert tuple(one(spark, n.date_key(F.col("m"), F.col("c")), m=(None, "timestamp"), c=(text, "string"))) == (key, "metadata")
    assert tuple(one(spark, n.date_key(F.col("m"), F.col("c")), m=(None, "timestamp"), c=("bad", "string"))) == ("NA", "none")


def test_sample_points(spark):
    at = lambda d, *how: one(spark, n.sample_points(F.col("d"), *how), d=(d, "double"))
    assert at(40.0) == [2.0, 20.0, 38.0]
    assert at(20.0) == [1.0, 10.0, 19.0]
    assert at(100.0) == [2.0, 26.0, 50.0, 74.0, 98.0]
    assert [len(at(d)) for d in (44.9, 45.0, 180.0, 600.0, 1800.0)] == [3, 5, 8, 12, 16]
    assert len(at(9000.0, 20)) == 18 and len(at(9000.0, 3, 4)) == 4
    assert at(0.0) == [0.0, 8.0, 15.0] and at(None) == []
    assert at(0.3, 1)[-1] == 0.05


def test_timed_segments_and_vtt(spark):
    long = "x" * 241
    json = f'[{{"start":0,"end":4,"text":"{long}"}},{{"start":5,"end":6,"text":"a<b"}},{{"start":9,"end":8,"text":"c"}},{{"start":1,"end":2,"text":" "}}]'
    got = one(spark, t.timed_segments(F.col("a")), a=(json, "string"))
    assert [s["text"] for s in got] == ["a<b"]
    assert one(spark, t.timed_segments(F.col("a")), a=("not json", "string")) in (None, [])
    vtt = one(spark, t.segments_to_vtt(t.timed_segments(F.col("a"))), a=(json, "string"))
    assert vtt == "WEBVTT\n\n1\n00:00:05.000 --> 00:00:06.000\na&lt;b\n"
    empty = one(spark, t.segments_to_vtt(t.timed_segments(F.col("a"))), a=("[]", "string"))
    assert empty.startswith("WEBVTT\n\n1\n00:00:00.000 --> 00:00:05.000")


def test_text_functions(spark):
    got = one(spark, t.strip_markup_tokens(F.col("a")), a=("<|en|> hi <|x|>there", "string"))
    assert (got["marks"], got["clean"]) == (["en", "x"], "hi there")
    got = one(spark, t.strip_markup_tokens(F.col("a")), a=("a\n <|x|> b <||>\u00a0c<|y|>", "string"))
    assert (got["marks"], got["clean"]) == (["x", "y"], "a b <||> c")
    assert one(spark, t.semantic_tokens(F.col("a")), a=("A _Bc- déf x", "string")) == ["bc", "déf"]
    assert one(spark, t.semantic_text(F.col("a"), F.col("b")), a=(" ", "string"), b=("y", "string")) == "y"
    assert one(spark, t.clean_filters(F.col("a"), ["x"]), a=('{"x":"1","y":"2"}', "string")) == {"x": "1"}
