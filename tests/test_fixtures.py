"""Hand-computed cases for each operator."""

import math

import pytest
from pyspark.sql import functions as F

from sieveloom.functions import numeric
from sieveloom.functions.text import tokens
from sieveloom.model import NOMINAL, NUMERIC, STRING, Attribute, Relation
from sieveloom.operators import binarize, crossval, infogain, keyed, vectorize
from sieveloom.operators.rank import Ranker, parse_range
from sieveloom.operators.select import AttributeSelection, remove
from sieveloom.operators.vectorize import VectorParams
from sieveloom.sources import arff
from sieveloom.streaming.vectors import vectorize_stream, windowed_word_counts

DEMO = """% a comment
@Relation demo
@attribute Class {pos,neg}
@ATTRIBUTE Size numeric [0,100]
@attribute Text string

@data
pos,5,'good good app'
neg,0,'bad app'
% another
pos,?,'good'
neg,7,?
"""


@pytest.fixture
def demo(spark, tmp_path):
    p = tmp_path / "demo.arff"
    p.write_text(DEMO)
    return arff.read_arff(spark, str(p), 0)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_arff_schema(demo):
    assert demo.name == "demo" and demo.class_name == "class"
    assert [(a.name, a.kind, a.labels, a.bounds) for a in demo.attributes] == [("class", NOMINAL, ("pos", "neg"), None), ("size", NUMERIC, (), (0.0, 100.0)), ("text", STRING, (), None)]
    assert rows(demo.frame, "class", "size", "text") == sorted([("pos", 5.0, "good good app"), ("neg", 0.0, "bad app"), ("pos", None, "good"), ("neg", 7.0, None)], key=repr)


def test_arff_sparse_rows_quotes_and_bad_values(spark, tmp_path):
    p = tmp_path / "s.arff"
    p.write_text("@relation 'a b'\n@attribute 'the class' {x,'y z'}\n@attribute n real\n@attribute s string\n@DATA\n{0 'y z',1 2.5}\n{}\nx,oops,\"a,\"\"b\"\"\"\nw,<NULL>,'it\\'s'\n")
    got = arff.read_arff(spark, str(p))
    assert got.name == "a b" and got.attributes[0].labels == ("x", "y z")
    assert rows(got.frame, "the class", "n", "s") == sorted([("y z", 2.5, ""), ("x", 0.0, ""), ("x", None, 'a,"b"'), (None, None, "it's")], key=repr)
    with pytest.raises(Exception, match="bad value"):
        arff.read_arff(spark, str(p), strict=True).frame.collect()


@pytest.mark.parametrize("line", ["@attribute", "@attribute a", "@attribute a date", "@attribute a numeric [x,2]"])
def test_arff_bad_attribute(line):
    with pytest.raises(ValueError):
        arff.parse_attribute(line)


def test_arff_round_trip_sparse(spark, demo, tmp_path):
    path = str(tmp_path / "out")
    model = vectorize.fit(demo, VectorParams(normalize=False, tf=False, idf=False))
    arff.write_sparse(model.transform(demo), path)
    back = arff.read_arff(spark, path, "class")
    assert [a.name for a in back.attributes] == ["class", "size", "app", "good", "bad"]
    assert rows(back.frame, "class", "size", "app", "good", "bad") == sorted([("pos", 5.0, 1.0, 1.0, 0.0), ("neg", 0.0, 1.0, 0.0, 1.0), ("pos", None, 0.0, 1.0, 0.0), ("neg", 7.0, 0.0, 0.0, 0.0)], key=repr)


def test_tokens(spark):
    df = spark.createDataFrame([(" a\tB b　c\u0085d  ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()] == [["a", "B", "b", "c", "d"], [], []]


def test_dictionary_and_vectors(demo):
    p = VectorParams(normalize=False)
    model = vectorize.fit(demo, p)
    assert rows(model.words, "attr_idx", "word", "df") == [(2, "app", 2), (3, "good", 2), (4, "bad", 1)]
    got = {(r.attr_idx, round(r.value, 6)) for r in model.word_entries(demo).collect()}
    assert got == {(2, 0.480453), (3, 0.480453), (4, 0.960906)}
    counts = vectorize.fit(demo, VectorParams(normalize=False, output_counts=True)).word_entries(demo)
    assert round(counts.where("attr_idx = 3").agg(F.max("value")).first()[0], 4) == 0.7615


def test_normalized_rows_have_the_average_length(demo):
    model = vectorize.fit(demo, VectorParams())
    average = model.average.first()[0]
    norms = model.word_entries(demo).groupBy("row_id").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("n")).collect()
    assert len(norms) == 3 and all(math.isclose(r.n, average) for r in norms)


def test_a_model_vectorizes_new_rows(spark, demo):
    model = vectorize.fit(demo, VectorParams(normalize=False, idf=False, tf=False))
    new = demo.with_frame(spark.createDataFrame([(99, "pos", 1.0, "good unseen")], "row_id long, class string, size double, text string"))
    assert rows(model.word_entries(new), "row_id", "attr_idx", "value") == [(99, 3, 1.0)]


@pytest.mark.parametrize("keep,want", [(2, 3), (5, 1), (4, 1), (1, 5)])
def test_vocabulary_threshold(spark, keep, want):
    counts = spark.createDataFrame([(0, "a", 5, 1), (0, "b", 3, 1), (0, "c", 3, 1), (0, "d", 1, 1)], "cls int, word string, cnt long, dc long")
    assert vectorize.thresholds(counts, VectorParams(words_to_keep=keep)).first().prune == want


def test_bad_parameters(demo):
    with pytest.raises(ValueError):
        VectorParams(words_to_keep=0)
    with pytest.raises(ValueError):
        vectorize.fit(Relation(demo.name, demo.attributes, demo.frame, "text"))
    with pytest.raises(ValueError):
        Attribute("a", "date")


def table(spark, cells):
    return spark.createDataFrame([(1, v, c, float(w)) for (v, c), w in cells.items()], "attr_idx int, value_idx int, cls int, weight double")


@pytest.mark.parametrize("cells,gain", [({(1, 0): 2, (0, 1): 2}, 1.0), ({(1, 0): 1, (1, 1): 1, (0, 0): 1, (0, 1): 1}, 0.0), ({(1, 0): 1, (0, 0): 1, (0, 1): 2}, 0.311278), ({(0, 0): 2, (0, 1): 2}, 0.0)])
def test_information_gain(spark, cells, gain):
    assert round(infogain.entropies(table(spark, cells)).first().gain, 6) == gain


def test_missing_merge(spark):
    cells = table(spark, {(0, 0): 2, (1, 1): 2, (None, 0): 1})
    got = {(r.value_idx, r.cls): r.weight for r in infogain.merge_missing(cells).collect()}
    assert got == {(0, 0): 2.5, (0, 1): 0.0, (1, 0): 0.5, (1, 1): 2.0}
    both = table(spark, {(0, 0): 1, (1, 1): 3, (0, None): 1, (None, None): 2})
    assert math.isclose(sum(r.weight for r in infogain.merge_missing(both).collect()), 7.0)
    none = table(spark, {(0, None): 1})
    assert infogain.merge_missing(none).count() == 0


def test_gain_is_bounded_by_class_entropy(demo):
    data = vectorize.fit(demo, VectorParams(normalize=False)).transform(demo)
    gains = infogain.info_gain(data).collect()
    assert len(gains) == 4 and all(-1e-9 <= r.gain <= 1 + 1e-9 for r in gains)
    with pytest.raises(ValueError):
        infogain.info_gain(Relation("r", demo.attributes, demo.frame).sparse())


def test_binarize(demo):
    data = vectorize.fit(demo, VectorParams(normalize=False)).transform(demo)
    out = binarize.binarize(data)
    assert [a.name for a in out.attributes] == ["class", "size_binarize"] and out.attributes[1].labels == ("0", "1")
    assert {r.value for r in out.entries.where("attr_idx > 0").collect()} == {1.0, None}


def test_explicit_zeros_binarize_to_one_but_are_not_projected(spark):
    frame = spark.createDataFrame([(1, "a", "w"), (2, "b", "w")], "row_id long, c string, t string")
    data = Relation("r", (Attribute("c", NOMINAL, ("a", "b")), Attribute("t", STRING)), frame, "c")
    vec = vectorize.fit(data, VectorParams(normalize=False)).transform(data)
    assert vec.entries.where("attr_idx = 1 AND value = 0").count() == 2
    assert binarize.binarize(vec).entries.where("attr_idx = 1 AND value = 1").count() == 2
    assert AttributeSelection().project(vec).where("new_idx = 0").count() == 0


def test_ranges():
    assert parse_range("1,3-5") == [0, 2, 3, 4] and parse_range(" 2 , 2-3") == [1, 2] and parse_range(None) == []
    for bad in ("0", "x", "3-1", "1-"):
        with pytest.raises(ValueError):
            parse_range(bad)
    with pytest.raises(ValueError):
        Ranker(exclude="9").excluded(3)


def test_ranking(spark):
    gains = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.1), (4, 0.0), (5, None)], "attr_idx int, gain double")
    ids = lambda df: [r.attr_idx for r in df.orderBy("rank").collect()]
    assert ids(Ranker().rank(gains)) == [1, 2, 3, 4]
    assert ids(Ranker(threshold=0.1).select(gains)) == [1, 2]
    assert ids(Ranker(threshold=0.4, num_to_select=3).select(gains)) == [1, 2, 3]
    assert ids(Ranker(exclude="2").select(gains)) == [2, 3, 4]


def test_selection_puts_the_class_last(demo):
    data = vectorize.fit(demo, VectorParams(normalize=False)).transform(demo)
    s = AttributeSelection(Ranker(num_to_select=2))
    assert [r.name for r in s.schema(data).orderBy("new_idx").collect()][-1] == "class"
    assert [r.name for r in AttributeSelection(Ranker(threshold=9.0)).schema(data).collect()] == ["class"]
    with pytest.raises(ValueError):
        AttributeSelection(Ranker(num_to_select=50)).selected(data)


def test_remove(demo):
    assert [a.name for a in remove(demo, [2, 0]).attributes] == ["text", "class"]
    dropped = remove(demo, [0], keep=False)
    assert [a.name for a in dropped.attributes] == ["size", "text"] and dropped.class_name is None
    with pytest.raises(ValueError):
        remove(demo, [7])


def test_folds(spark):
    assert crossval.fold_sizes(10, 3) == [(0, 4), (4, 3), (7, 3)]
    got = crossval.folds(spark.range(10).withColumnRenamed("id", "row_id"), 3, 1)
    assert [r["count"] for r in got.groupBy("test_fold").count().orderBy("test_fold").collect()] == [4, 3, 3]
    assert sorted(r.position for r in got.collect()) == list(range(10))
    for k in (1, 11):
        with pytest.raises(ValueError):
            crossval.folds(spark.range(10).withColumnRenamed("id", "row_id"), k, 1)


def test_argsort(spark):
    values = [0.0] * 31
    values[6], values[25], values[30] = 0.8904916402194916, 0.7793498372920848, 0.7793498372920848
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    order = [r.i for r in numeric.argsort(df, "v", "i").orderBy("position").collect()]
    assert order[-3:] == [25, 30, 6] and order[:3] == [0, 1, 2]
    arrays = spark.createDataFrame([([2.0, None, float("nan"), -1.0],)], "a array<double>")
    assert arrays.select(numeric.argsort_array(F.col("a"))).first()[0] == [3, 0, 1, 2]


def test_tolerant_comparison(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 5e-7), (2.0, 1.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    assert [tuple(r) for r in df.select(numeric.greater(a, b), numeric.smaller(a, b), numeric.greater_or_equal(a, b), numeric.equal(a, b)).collect()] == [(False, False, True, True), (True, False, True, False)]


def test_keyed(spark):
    df = spark.createDataFrame([(1, "A", "x"), (2, "a", "y"), (3, "b", "z")], "seq int, k string, v string")
    m = keyed.upsert(df, keyed.case_folded(F.col("k")), F.col("v"), F.col("seq"))
    assert rows(m, "key", "value", "n_inserts") == [("a", "y", 2), ("b", "z", 1)]
    keys = spark.createDataFrame([("a",), ("q",)], "key string")
    assert rows(keyed.find(m, keys), "key", "found") == [("a", True), ("q", False)]
    assert rows(keyed.delete(m, keys), "key") == [("b",)] and keyed.length(m).first().n == 2


def test_streams(spark, demo, tmp_path):
    model = vectorize.fit(demo, VectorParams(normalize=False, idf=False, tf=False))
    spark.createDataFrame([(7, "pos", 1.0, "good bad", 0)], "row_id long, class string, size double, text string, at int").withColumn("ts", F.timestamp_seconds("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, class string, size double, text string, at int, ts timestamp").parquet(str(tmp_path / "in"))
    out = vectorize_stream(model, demo.with_frame(stream))
    q = out.writeStream.format("memory").queryName("vec").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("vec"), "row_id", "attr_idx", "value") == [(7, 3, 1.0), (7, 4, 1.0)]
    q = windowed_word_counts(stream, "ts", "text").writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("wc"), "word", "n") == [("bad", 1), ("good", 1)]
    with pytest.raises(ValueError):
        vectorize_stream(vectorize.fit(demo), demo)


@pytest.mark.parametrize("partitions", ["4", "8"])
def test_positions_are_whole_over_many_rows(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        n = 20_000
        values = [(i, float(i * 7919 % 6007)) if i % 11 else (i, None) for i in range(n)]
        got = {r.i: r.position for r in numeric.argsort(spark.createDataFrame(values, "i long, v double").repartition(5), "v", "i").collect()}
        order = sorted(range(n), key=lambda i: (values[i][1] is None, values[i][1] or 0.0, i))
        assert [got[i] for i in order] == list(range(n))
        words = spark.createDataFrame([(i, f"w{i * 31 % 9973}" if i % 3 else None) for i in range(n)], "i long, w string").repartition(3)
        first = {}
        for i in range(n):
            if i % 3:
                first.setdefault(f"w{i * 31 % 9973}", len(first))
        assert {r.value: r.id for r in keyed.string_dictionary(words, "w", "i").collect()} == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
