"""The query catalogue: every operator as a named query, with its SQL.

Floats are rounded before they are compared, ranked or returned, so that
engines whose logarithms differ in the last digit agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.functions import numeric
from sieveloom.functions.numeric import DIGITS
from sieveloom.model import NOMINAL, NUMERIC, STRING, Attribute, Relation
from sieveloom.operators import binarize, crossval, infogain, keyed, rank, select, vectorize
from sieveloom.operators.vectorize import VectorParams
from sieveloom.sources import arff

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LANGS = ("de", "en", "es", "fr")
KEEP = 15
SEED = 7


def query(sql: str):
    """Register a query and its SQL under the function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, scan: DataFrame, key: str) -> DataFrame:
    """Deal rows to all cores where the scan has fewer partitions than there are
    cores (one small file); a large table is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else df


def labelled(spark: SparkSession, sf_dir: str, missing: bool = False) -> Relation:
    """Labelled documents: class ``quality``, ``lang``, ``n_chars``, ``text``."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lang = F.nullif(F.col("lang"), F.lit("es")) if missing else F.col("lang")
    frame = docs.join(labels, "doc_id").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("string").alias("quality"), lang.alias("lang"), F.col("n_chars").cast("double").alias("n_chars"), "text")
    frame = spread(frame, docs, "row_id")
    attributes = (Attribute("quality", NOMINAL, ("0", "1")), Attribute("lang", NOMINAL, LANGS), Attribute("n_chars", NUMERIC), Attribute("text", STRING))
    return Relation("documents", attributes, frame, "quality")


def nominal(spark: SparkSession, sf_dir: str, name: str) -> Relation:
    """``lineitem`` (class return flag, line status) or ``orders`` (class status, priority)."""
    if name == "lineitem":
        frame = table(spark, sf_dir, name).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_id"), "l_returnflag", "l_linestatus", "l_quantity")
        attributes = (Attribute("l_returnflag", NOMINAL, ("A", "N", "R")), Attribute("l_linestatus", NOMINAL, ("F", "O")), Attribute("l_quantity", NUMERIC))
        return Relation(name, attributes, frame, "l_returnflag")
    frame = table(spark, sf_dir, name).select(F.col("o_orderkey").alias("row_id"), "o_orderstatus", "o_orderpriority")
    attributes = (Attribute("o_orderstatus", NOMINAL, ("F", "O", "P")), Attribute("o_orderpriority", NOMINAL, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    return Relation(name, attributes, frame, "o_orderstatus")


def params(**changes) -> VectorParams:
    return replace(VectorParams(words_to_keep=KEEP, normalize=False), **changes)


def vectors(spark: SparkSession, sf_dir: str, **changes):
    data = labelled(spark, sf_dir)
    return vectorize.fit(data, params(**changes)).transform(data)


# ---- SQL building blocks ----------------------------------------------------------

_D = "d AS (SELECT d.doc_id AS row_id, quality::INT AS cls, lang, n_chars, text FROM documents d JOIN labels USING (doc_id))"
_TF = r"""tf AS (SELECT row_id, cls, word, count(*) AS tf FROM (SELECT row_id, cls, unnest(regexp_split_to_array(text, '[\t-\r\x{85}\p{Z}]+')) AS word FROM d) WHERE word <> '' GROUP BY ALL)"""


def _wc(per_class: bool = True) -> str:
    return f"wc AS (SELECT {'cls' if per_class else '0 AS cls'}, word, sum(tf)::BIGINT AS cnt, count(*) AS dc FROM tf GROUP BY ALL)"


def _prune(keep: int = KEEP, least: int = 1) -> str:
    return (
        f"prune AS (SELECT cls, greatest({least}, coalesce(max(CASE WHEN n = {keep} THEN cnt END), 0))::BIGINT AS prune "
        "FROM (SELECT cls, cnt, row_number() OVER (PARTITION BY cls ORDER BY cnt DESC) AS n FROM wc) GROUP BY cls)"
    )


_DICT = (
    "kept AS (SELECT word, min(cls) AS first_cls FROM wc JOIN prune USING (cls) WHERE cnt >= prune GROUP BY word), "
    "dict AS (SELECT (row_number() OVER (ORDER BY first_cls, word) + 2)::INT AS attr_idx, word, first_cls, df FROM kept JOIN (SELECT word, sum(dc)::BIGINT AS df FROM wc GROUP BY word) USING (word))"
)


def _vocabulary(per_class: bool = True, keep: int = KEEP, least: int = 1) -> str:
    return f"WITH {_D}, {_TF}, {_wc(per_class)}, {_prune(keep, least)}, {_DICT}"


def _values(counts: bool = False, tf: bool = True, idf: bool = True) -> str:
    v = "tf::DOUBLE" if counts else "1.0::DOUBLE"
    v = f"ln({v} + 1)" if tf else v
    v = f"{v} * ln((SELECT count(*) FROM d)::DOUBLE / df)" if idf else v
    return f"vec AS (SELECT row_id, cls, attr_idx, {v} AS value FROM tf JOIN dict USING (word))"


_SCALARS = (
    "scal AS (SELECT row_id, cls, 0 AS attr_idx, cls::DOUBLE AS value FROM d UNION ALL "
    "SELECT row_id, cls, 1, CASE lang WHEN 'de' THEN 0.0 WHEN 'en' THEN 1.0 WHEN 'es' THEN 2.0 WHEN 'fr' THEN 3.0 END FROM d UNION ALL "
    "SELECT row_id, cls, 2, n_chars::DOUBLE FROM d)"
)
_ALL = f"{_SCALARS}, entries AS (SELECT * FROM scal WHERE value <> 0 UNION ALL SELECT * FROM vec)"
_BASE = f"{_vocabulary()}, {_values()}, {_ALL}"
_BIN = "bin AS (SELECT row_id, cls, attr_idx, CASE WHEN attr_idx <= 1 THEN value ELSE 1.0 END AS value FROM entries)"
_ATTRS = "attrs AS (SELECT attr_idx FROM dict UNION ALL SELECT unnest([1, 2]))"
_CELLS = (
    "st AS (SELECT attr_idx, value::INT AS value_idx, cls, count(*)::DOUBLE AS weight FROM bin WHERE attr_idx <> 0 GROUP BY ALL), "
    "ch AS (SELECT cls, count(*)::DOUBLE AS total FROM d GROUP BY cls), "
    "cells AS (SELECT * FROM st UNION ALL SELECT a.attr_idx, 0, ch.cls, total - coalesce(s.taken, 0) FROM attrs a CROSS JOIN ch "
    "LEFT JOIN (SELECT attr_idx, cls, sum(weight) AS taken FROM st GROUP BY ALL) s ON s.attr_idx = a.attr_idx AND s.cls = ch.cls WHERE total - coalesce(s.taken, 0) <> 0)"
)


def _f(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} * ln({x}) ELSE 0 END"


def _gains(cells: str = "cells", by: str = "") -> str:
    return (
        f"parts AS (SELECT {by} attr_idx, 'c' AS part, sum(weight) AS w FROM {cells} GROUP BY {by} attr_idx, value_idx, cls UNION ALL SELECT {by} attr_idx, 'v', sum(weight) FROM {cells} GROUP BY {by} attr_idx, value_idx "
        f"UNION ALL SELECT {by} attr_idx, 'k', sum(weight) FROM {cells} GROUP BY {by} attr_idx, cls UNION ALL SELECT {by} attr_idx, 't', sum(weight) FROM {cells} GROUP BY {by} attr_idx), "
        f"ents AS (SELECT {by} attr_idx, (sum(CASE part WHEN 't' THEN {_f('w')} WHEN 'k' THEN -({_f('w')}) ELSE 0 END)) / (sum(CASE WHEN part = 't' THEN w END) * ln(2)) AS h_class, "
        f"(sum(CASE part WHEN 'v' THEN {_f('w')} WHEN 'c' THEN -({_f('w')}) ELSE 0 END)) / (sum(CASE WHEN part = 't' THEN w END) * ln(2)) AS h_cond FROM parts GROUP BY {by} attr_idx), "
        f"gains AS (SELECT {by} attr_idx, round(h_class - h_cond, {DIGITS}) AS gain FROM ents)"
    )


_GAINS = f"{_BASE}, {_BIN}, {_ATTRS}, {_CELLS}, {_gains()}"
_RANKED = f"{_GAINS}, ranked AS (SELECT attr_idx, gain AS merit, row_number() OVER (ORDER BY gain DESC, attr_idx) AS rank FROM gains)"


# ---- text vectorization -------------------------------------------------------------


@query(f"WITH {_D}, {_TF} SELECT * FROM tf")
def tokenize_counts(spark, sf_dir):
    return vectorize.token_counts(labelled(spark, sf_dir))


@query(f"WITH {_D}, {_TF}, {_wc()} SELECT * FROM wc")
def class_word_counts(spark, sf_dir):
    return vectorize.class_word_counts(labelled(spark, sf_dir), params())


@query(f"WITH {_D}, {_TF}, {_wc()}, {_prune()} SELECT * FROM prune")
def vocab_threshold_perclass(spark, sf_dir):
    return vectorize.thresholds(vectorize.class_word_counts(labelled(spark, sf_dir), params()), params())


@query(f"WITH {_D}, {_TF}, {_wc(False)}, {_prune()} SELECT * FROM prune")
def vocab_threshold_global(spark, sf_dir):
    p = params(per_class=False)
    return vectorize.thresholds(vectorize.class_word_counts(labelled(spark, sf_dir), p), p)


@query(f"{_vocabulary()} SELECT attr_idx, word, first_cls, df FROM dict")
def dictionary_perclass(spark, sf_dir):
    return vectorize.dictionary(vectorize.class_word_counts(labelled(spark, sf_dir), params()), params(), 3)


@query(f"{_vocabulary(False)} SELECT attr_idx, word, first_cls, df FROM dict")
def dictionary_global(spark, sf_dir):
    p = params(per_class=False)
    return vectorize.dictionary(vectorize.class_word_counts(labelled(spark, sf_dir), p), p, 3)


@query(f"{_vocabulary(True, 1000, 40)} SELECT attr_idx, word, first_cls, df FROM dict")
def dictionary_min_term_freq(spark, sf_dir):
    p = params(words_to_keep=1000, min_term_freq=40)
    return vectorize.dictionary(vectorize.class_word_counts(labelled(spark, sf_dir), p), p, 3)


@query(f"{_vocabulary()} SELECT word, df, (SELECT count(*) FROM d) AS n_rows FROM dict")
def doc_frequency(spark, sf_dir):
    model = vectorize.fit(labelled(spark, sf_dir), params())
    return model.words.select("word", "df").crossJoin(F.broadcast(model.n_rows))


def _vec_query(name: str, counts: bool, tf: bool, idf: bool) -> None:
    def run(spark, sf_dir):
        return vectors(spark, sf_dir, output_counts=counts, tf=tf, idf=idf).entries.select("row_id", "attr_idx", F.round("value", DIGITS).alias("value"))

    run.__name__ = name
    query(f"{_vocabulary()}, {_values(counts, tf, idf)}, {_ALL} SELECT row_id, attr_idx, round(value, {DIGITS}) AS value FROM entries")(run)


for _name, _counts, _t, _i in (("vec_binary", False, False, False), ("vec_counts", True, False, False), ("vec_tf", False, True, False), ("vec_idf", False, False, True), ("vec_tfidf", False, True, True), ("vec_counts_tfidf", True, True, True)):
    _vec_query(_name, _counts, _t, _i)


_NORMS = "norms AS (SELECT row_id, sqrt(sum(value * value)) AS norm FROM vec GROUP BY row_id), avgs AS (SELECT (SELECT sum(norm) FROM norms) / (SELECT count(*) FROM d) AS avg_len)"


@query(f"{_vocabulary()}, {_values()}, {_NORMS} SELECT round(avg_len, {DIGITS}) AS avg_len FROM avgs")
def avg_doc_length(spark, sf_dir):
    return vectorize.fit(labelled(spark, sf_dir), params()).average.select(F.round("avg_len", DIGITS).alias("avg_len"))


@query(f"{_vocabulary()}, {_values()}, {_NORMS} SELECT row_id, attr_idx, round(value * avg_len / norm, {DIGITS}) AS value FROM vec JOIN norms USING (row_id) CROSS JOIN avgs WHERE norm > 0 AND value <> 0")
def vec_normalized(spark, sf_dir):
    data = labelled(spark, sf_dir)
    return vectorize.fit(data, params(normalize=True)).word_entries(data).select("row_id", "attr_idx", F.round("value", DIGITS).alias("value"))


@query(f"{_BASE} SELECT row_id, e.attr_idx, CASE e.attr_idx WHEN 0 THEN cls::VARCHAR WHEN 1 THEN lang WHEN 2 THEN 'n_chars' ELSE word END AS shown FROM entries e JOIN d USING (row_id, cls) LEFT JOIN dict USING (attr_idx)")
def vec_display(spark, sf_dir):
    return vectors(spark, sf_dir).displayed().select("row_id", "attr_idx", "shown")


# ---- contingency, entropy, gain ------------------------------------------------------


@query(f"WITH {_D} SELECT cls, count(*)::DOUBLE AS total FROM d GROUP BY cls")
def class_histogram(spark, sf_dir):
    return infogain.class_histogram(labelled(spark, sf_dir).rows())


@query("SELECT (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END)::INT AS cls, count(*)::DOUBLE AS total FROM lineitem GROUP BY 1")
def class_histogram_nominal(spark, sf_dir):
    return infogain.class_histogram(nominal(spark, sf_dir, "lineitem").rows())


@query(f"{_BASE}, {_BIN} SELECT row_id, attr_idx, value FROM bin")
def binarize_entries(spark, sf_dir):
    return binarize.binarize(vectors(spark, sf_dir)).entries.select("row_id", "attr_idx", "value")


@query(f"{_BASE}, {_BIN}, {_ATTRS}, {_CELLS} SELECT * FROM cells")
def contingency_binary(spark, sf_dir):
    data = vectors(spark, sf_dir)
    own = binarize.binarize(data)
    table_ = own.attribute_table().where("attr_idx <> 0")
    return infogain.contingency(own.entries.where("attr_idx <> 0"), own.rows, table_)


_LINE = "SELECT 1 AS attr_idx, (CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END)::INT AS value_idx, (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END)::INT AS cls, count(*)::DOUBLE AS weight FROM lineitem GROUP BY ALL"
_ORDERS = "SELECT 1 AS attr_idx, (substring(o_orderpriority, 1, 1)::INT - 1)::INT AS value_idx, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END)::INT AS cls, count(*)::DOUBLE AS weight FROM orders GROUP BY ALL"


def _nominal_cells(spark, sf_dir, name):
    data = nominal(spark, sf_dir, name).sparse()
    table_ = data.attribute_table().where("attr_idx <> 0 AND kind = 'nominal'")
    return infogain.contingency(data.entries.where("attr_idx = 1"), data.rows, table_)


@query(_LINE)
def contingency_nominal(spark, sf_dir):
    return _nominal_cells(spark, sf_dir, "lineitem")


@query(f"WITH cells AS ({_LINE}), {_gains()} SELECT attr_idx, round(h_class, {DIGITS}) AS h_class FROM ents")
def entropy_class(spark, sf_dir):
    return infogain.entropies(_nominal_cells(spark, sf_dir, "lineitem")).select("attr_idx", F.round("h_class", DIGITS).alias("h_class"))


@query(f"WITH cells AS ({_ORDERS}), {_gains()} SELECT attr_idx, round(h_cond, {DIGITS}) AS h_conditional FROM ents")
def entropy_conditional(spark, sf_dir):
    return infogain.entropies(_nominal_cells(spark, sf_dir, "orders")).select("attr_idx", F.round("h_conditional", DIGITS).alias("h_conditional"))


@query(f"{_GAINS}, names AS (SELECT attr_idx, word AS name FROM dict UNION ALL SELECT 1, 'lang' UNION ALL SELECT 2, 'n_chars') SELECT attr_idx, name, gain FROM gains JOIN names USING (attr_idx)")
def infogain_words(spark, sf_dir):
    data = vectors(spark, sf_dir)
    return infogain.info_gain(data).join(data.attribute_table(), "attr_idx").select("attr_idx", "name", "gain")


@query(f"WITH cells AS ({_LINE}), {_gains()} SELECT attr_idx, gain FROM gains UNION ALL SELECT 2, 0.0")
def infogain_nominal(spark, sf_dir):
    return infogain.info_gain(nominal(spark, sf_dir, "lineitem").sparse(), binarize_numeric=False)


@query(f"WITH cells AS ({_ORDERS}), {_gains()} SELECT attr_idx, gain FROM gains")
def infogain_orders(spark, sf_dir):
    return infogain.info_gain(nominal(spark, sf_dir, "orders").sparse())


_MISS = (
    f"WITH {_D}, raw AS (SELECT 1 AS attr_idx, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'fr' THEN 3 END AS value_idx, cls, count(*)::DOUBLE AS weight FROM d GROUP BY ALL "
    "UNION ALL SELECT 2, CASE WHEN n_chars <> 0 THEN 1 ELSE 0 END, cls, count(*)::DOUBLE FROM d GROUP BY ALL)"
)


@query(
    f"{_MISS}, r AS (SELECT attr_idx, value_idx, sum(weight) AS r FROM raw WHERE value_idx IS NOT NULL GROUP BY ALL), "
    "c AS (SELECT attr_idx, cls, sum(weight) FILTER (value_idx IS NOT NULL) AS c, coalesce(sum(weight) FILTER (value_idx IS NULL), 0) AS m FROM raw GROUP BY ALL), "
    "s AS (SELECT attr_idx, sum(weight) AS s FROM raw WHERE value_idx IS NOT NULL GROUP BY ALL), "
    "cells AS (SELECT attr_idx, value_idx, cls, coalesce(weight, 0) + r / s * m AS weight FROM r JOIN c USING (attr_idx) JOIN s USING (attr_idx) LEFT JOIN raw USING (attr_idx, value_idx, cls)), "
    f"{_gains()} SELECT attr_idx, gain FROM gains"
)
def infogain_missing_merge(spark, sf_dir):
    return infogain.info_gain(labelled(spark, sf_dir, missing=True).sparse())


@query(f"{_MISS}, cells AS (SELECT attr_idx, coalesce(value_idx, -1) AS value_idx, cls, weight FROM raw), {_gains()} SELECT attr_idx, gain FROM gains")
def infogain_missing_separate(spark, sf_dir):
    return infogain.info_gain(labelled(spark, sf_dir, missing=True).sparse(), missing_merge=False)


# ---- ranking, selection, projection ----------------------------------------------------


@query(f"{_RANKED} SELECT * FROM ranked")
def rank_all(spark, sf_dir):
    return rank.Ranker().rank(infogain.info_gain(vectors(spark, sf_dir)))


@query(f"{_RANKED} SELECT * FROM ranked WHERE merit > 0.01")
def rank_threshold(spark, sf_dir):
    return rank.Ranker(threshold=0.01).select(infogain.info_gain(vectors(spark, sf_dir)))


@query(f"{_RANKED} SELECT * FROM ranked WHERE rank <= 5")
def rank_topk(spark, sf_dir):
    return rank.Ranker(num_to_select=5).select(infogain.info_gain(vectors(spark, sf_dir)))


@query(f"{_GAINS} SELECT attr_idx, gain AS merit, row_number() OVER (ORDER BY gain DESC, attr_idx) AS rank FROM gains WHERE attr_idx NOT IN (1, 3, 4, 5)")
def rank_exclude_range(spark, sf_dir):
    return rank.Ranker(exclude="2,4-6").rank(infogain.info_gain(vectors(spark, sf_dir)))


_SELECTED = f"{_RANKED}, sel AS (SELECT attr_idx, (rank - 1)::INT AS new_idx FROM ranked WHERE merit > 0.0 UNION ALL SELECT 0, (SELECT count(*) FROM ranked WHERE merit > 0.0)::INT)"


@query(f"{_SELECTED} SELECT row_id, new_idx, round(value, {DIGITS}) AS value FROM entries JOIN sel USING (attr_idx) WHERE value <> 0")
def select_project(spark, sf_dir):
    data = vectors(spark, sf_dir)
    return select.AttributeSelection(rank.Ranker(threshold=0.0)).project(data).select("row_id", "new_idx", F.round("value", DIGITS).alias("value"))


@query(f"{_SELECTED}, names AS (SELECT attr_idx, word AS name, 'numeric' AS kind FROM dict UNION ALL SELECT 0, 'quality', 'nominal' UNION ALL SELECT 1, 'lang', 'nominal' UNION ALL SELECT 2, 'n_chars', 'numeric') SELECT new_idx, name, kind FROM sel JOIN names USING (attr_idx)")
def select_schema(spark, sf_dir):
    return select.AttributeSelection(rank.Ranker(threshold=0.0)).schema(vectors(spark, sf_dir))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def customers(spark, sf_dir) -> Relation:
    frame = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_custkey").cast("double").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("double").alias("c_nationkey"), "c_acctbal", "c_mktsegment")
    attributes = (Attribute("c_custkey", NUMERIC), Attribute("c_name", STRING), Attribute("c_nationkey", NUMERIC), Attribute("c_acctbal", NUMERIC), Attribute("c_mktsegment", NOMINAL, SEGMENTS))
    return Relation("customer", attributes, frame, "c_mktsegment")


@query("SELECT c_custkey AS row_id, c_mktsegment, c_acctbal FROM customer")
def remove_keep(spark, sf_dir):
    return select.remove(customers(spark, sf_dir), [4, 3]).frame


@query("SELECT c_custkey AS row_id, c_custkey::DOUBLE AS c_custkey, c_nationkey::DOUBLE AS c_nationkey, c_mktsegment FROM customer")
def remove_drop(spark, sf_dir):
    return select.remove(customers(spark, sf_dir), [1, 3], keep=False).frame


def _embedded(spark, sf_dir) -> DataFrame:
    """Embeddings as sparse maps of their values above 0.1 in size."""
    kept = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x"))), lambda s: F.abs(s["x"]) > 0.1)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.map_from_entries(kept).alias("m"))


@query("SELECT vec_id, CASE WHEN abs(embedding[6]::DOUBLE) > 0.1 THEN embedding[6]::DOUBLE ELSE 0.0 END AS value FROM embeddings")
def sparse_lookup(spark, sf_dir):
    return _embedded(spark, sf_dir).select("vec_id", F.coalesce(F.try_element_at("m", F.lit(5)), F.lit(0.0)).alias("value"))


@query(f"{_BASE} SELECT row_id, round(coalesce(max(CASE WHEN attr_idx = 1 THEN value END), 0), {DIGITS}) AS a1, round(coalesce(max(CASE WHEN attr_idx = 3 THEN value END), 0), {DIGITS}) AS a3, round(coalesce(max(CASE WHEN attr_idx = 7 THEN value END), 0), {DIGITS}) AS a7 FROM entries GROUP BY row_id")
def sparse_to_dense(spark, sf_dir):
    return vectors(spark, sf_dir).dense([1, 3, 7]).select("row_id", *[F.round(c, DIGITS).alias(c) for c in ("a1", "a3", "a7")])


@query(f"{_BASE} SELECT d.row_id, round(coalesce(value, 0), {DIGITS}) AS value FROM d LEFT JOIN (SELECT row_id, value FROM entries WHERE attr_idx = 3) USING (row_id)")
def sparse_point_value(spark, sf_dir):
    return vectors(spark, sf_dir).lookup(3).select("row_id", F.round("value", DIGITS).alias("value"))


@query(f"WITH {_D}, {_SCALARS} SELECT row_id, attr_idx, value FROM scal WHERE value <> 0")
def dense_to_sparse(spark, sf_dir):
    return labelled(spark, sf_dir).sparse().entries.select("row_id", "attr_idx", "value")


@query("SELECT vec_id, count(*) FILTER (abs(x) > 0.1)::INT AS n_stored, string_agg(i, ',' ORDER BY i) FILTER (abs(x) > 0.1) AS ids FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT - 1 AS i FROM embeddings) GROUP BY vec_id")
def sparse_indices(spark, sf_dir):
    return _embedded(spark, sf_dir).select("vec_id", F.size("m").alias("n_stored"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("ids"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS position FROM part")
def argsort(spark, sf_dir):
    return numeric.argsort(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey").select("p_partkey", "position")


@query("SELECT vec_id, string_agg(i, ',' ORDER BY x, i) AS positions FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT - 1 AS i FROM embeddings) GROUP BY vec_id")
def argsort_arrays(spark, sf_dir):
    values = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(numeric.argsort_array(values), ",").alias("positions"))


@query("SELECT o_orderkey, a - b > 1e-6 AS gr, b - a > 1e-6 AS sm, (b - a < 1e-6) OR a >= b AS ge, a = b OR abs(a - b) < 1e-6 AS eq FROM (SELECT o_orderkey, o_totalprice / 1e6 AS a, (o_totalprice + (o_orderkey % 5 - 2) * 0.4) / 1e6 AS b FROM orders)")
def fuzzy_compare(spark, sf_dir):
    price = F.col("o_totalprice")
    a, b = price / 1e6, (price + (F.col("o_orderkey") % 5 - 2) * 0.4) / 1e6
    return table(spark, sf_dir, "orders").select("o_orderkey", numeric.greater(a, b).alias("gr"), numeric.smaller(a, b).alias("sm"), numeric.greater_or_equal(a, b).alias("ge"), numeric.equal(a, b).alias("eq"))


# ---- folds -------------------------------------------------------------------------------

_POS = f"pos AS (SELECT row_id, cls, row_number() OVER (ORDER BY md5('{SEED}-' || row_id), row_id) - 1 AS position FROM d)"
_FOLDS = f"{_POS}, sz AS (SELECT count(*) AS n, count(*) // 3 AS b, count(*) % 3 AS r FROM d), fold AS (SELECT row_id, cls, position, (CASE WHEN position < r * (b + 1) THEN position // (b + 1) ELSE r + (position - r * (b + 1)) // b END)::INT AS test_fold FROM pos, sz)"


@query(f"WITH {_D}, {_FOLDS} SELECT row_id, position, test_fold FROM fold")
def cv_folds(spark, sf_dir):
    return crossval.folds(labelled(spark, sf_dir).rows(), 3, SEED).select("row_id", "position", "test_fold")


@query(f"WITH {_D}, {_POS} SELECT row_id, position FROM pos")
def shuffle_order(spark, sf_dir):
    return numeric.shuffled_position(labelled(spark, sf_dir).rows(), "row_id", SEED).select("row_id", "position")


@query(f"WITH {_D}, {_FOLDS} SELECT row_id FROM fold WHERE test_fold <> 1")
def cv_train_split(spark, sf_dir):
    return crossval.train_split(labelled(spark, sf_dir).rows(), 3, 1, SEED).select("row_id")


_CV = (
    f"{_BASE}, {_BIN}, {_ATTRS}, {_FOLDS}, tr AS (SELECT f.fold, row_id, cls FROM fold, (SELECT unnest([0, 1, 2]) AS fold) f WHERE test_fold <> f.fold), "
    "st AS (SELECT fold, attr_idx, value::INT AS value_idx, b.cls, count(*)::DOUBLE AS weight FROM bin b JOIN tr USING (row_id) WHERE attr_idx <> 0 GROUP BY ALL), "
    "ch AS (SELECT fold, cls, count(*)::DOUBLE AS total FROM tr GROUP BY ALL), "
    "cells AS (SELECT * FROM st UNION ALL SELECT ch.fold, a.attr_idx, 0, ch.cls, total - coalesce(s.taken, 0) FROM attrs a CROSS JOIN ch "
    "LEFT JOIN (SELECT fold, attr_idx, cls, sum(weight) AS taken FROM st GROUP BY ALL) s ON s.attr_idx = a.attr_idx AND s.cls = ch.cls AND s.fold = ch.fold WHERE total - coalesce(s.taken, 0) <> 0), "
    f"{_gains(by='fold,')}, rk AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY gain DESC, attr_idx) AS rank FROM gains)"
)


@query(f"{_CV} SELECT attr_idx, count(*) AS n_folds, round(sum(gain), 6) AS sum_merit, sum(rank)::BIGINT AS sum_rank, round(sum(gain * gain), 6) AS sum_merit_sq, sum(rank * rank)::BIGINT AS sum_rank_sq FROM rk GROUP BY attr_idx")
def cv_rank_stats(spark, sf_dir):
    return crossval.cross_validate(vectors(spark, sf_dir), 3, SEED).select("attr_idx", "n_folds", "sum_merit", "sum_rank", "sum_merit_sq", "sum_rank_sq")


# ---- ordered map ---------------------------------------------------------------------------


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def _users(spark, sf_dir) -> DataFrame:
    return keyed.upsert(_events(spark, sf_dir), F.col("user_id"), F.col("event_type"), F.col("event_id"))


_KV = "kv AS (SELECT user_id AS key, arg_max(event_type, event_id) AS value, count(*) AS n_inserts FROM events GROUP BY user_id)"


@query(f"WITH {_KV} SELECT * FROM kv")
def kv_upsert(spark, sf_dir):
    return keyed.in_order(_users(spark, sf_dir), "key")


@query("SELECT lower(upper(event_type)) AS key, arg_max(event_id, event_id) AS value, count(*) AS n_inserts FROM events GROUP BY 1")
def kv_casefold(spark, sf_dir):
    return keyed.upsert(_events(spark, sf_dir), keyed.case_folded(F.upper("event_type")), F.col("event_id"), F.col("event_id"))


@query(f"WITH {_KV} SELECT c_custkey AS key, value, n_inserts, kv.key IS NOT NULL AS found FROM customer LEFT JOIN kv ON kv.key = c_custkey")
def kv_find(spark, sf_dir):
    return keyed.find(_users(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")))


@query(f"WITH {_KV} SELECT * FROM kv WHERE key NOT IN (SELECT user_id FROM events WHERE event_id % 50 = 0)")
def kv_delete(spark, sf_dir):
    return keyed.delete(_users(spark, sf_dir), _events(spark, sf_dir).where("event_id % 50 = 0").select(F.col("user_id").alias("key")))


@query(f"WITH {_KV} SELECT count(*) AS n FROM kv")
def kv_len(spark, sf_dir):
    return keyed.length(_users(spark, sf_dir))


@query("SELECT event_type AS value, row_number() OVER (ORDER BY min(event_id), event_type) - 1 AS id FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def string_dictionary(spark, sf_dir):
    return keyed.string_dictionary(_events(spark, sf_dir), "event_type", "event_id")


# ---- files -----------------------------------------------------------------------------------


@query("SELECT c_custkey::DOUBLE AS c_custkey, c_name, c_nationkey::DOUBLE AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def arff_roundtrip_dense(spark, sf_dir):
    from sieveloom.sources.scratch import scratch_path

    path = scratch_path(spark, "arff")
    arff.write_dense(customers(spark, sf_dir), path)
    return arff.read_arff(spark, path, "c_mktsegment").frame.drop("row_id")


_BINARY = f"{_vocabulary()}, {_values(False, False, False)}, {_ALL}, txt AS (SELECT row_id, attr_idx, attr_idx || ' ' || CASE attr_idx WHEN 0 THEN cls::VARCHAR WHEN 1 THEN CASE value WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END ELSE value::BIGINT::VARCHAR END AS t FROM entries)"


@query(f"{_BINARY} SELECT row_id, '{{' || string_agg(t, ',' ORDER BY attr_idx) || '}}' AS line FROM txt GROUP BY row_id")
def arff_sparse_export(spark, sf_dir):
    return arff.sparse_lines(vectors(spark, sf_dir, tf=False, idf=False))


@query("SELECT o_orderstatus, o_orderpriority FROM orders")
def arff_roundtrip_sparse(spark, sf_dir):
    from sieveloom.sources.scratch import scratch_path

    path = scratch_path(spark, "arff-sparse")
    arff.write_sparse(nominal(spark, sf_dir, "orders").sparse(), path)
    return arff.read_arff(spark, path, "o_orderstatus").frame.drop("row_id")


# ---- schemas, missing classes, no class --------------------------------------------------------

_SCHEMA = "SELECT 0 AS attr_idx, 'quality' AS name, 'nominal' AS kind UNION ALL SELECT 1, 'lang', 'nominal' UNION ALL SELECT 2, 'n_chars', 'numeric'"


@query(f"{_vocabulary()} {_SCHEMA} UNION ALL SELECT attr_idx, word, 'numeric' FROM dict")
def vec_schema(spark, sf_dir):
    return vectors(spark, sf_dir).attribute_table()


@query(f"{_vocabulary()} SELECT 0 AS attr_idx, 'quality' AS name UNION ALL SELECT 1, 'lang' UNION ALL SELECT 2, 'n_chars_binarize' UNION ALL SELECT attr_idx, word || '_binarize' FROM dict")
def binarize_schema(spark, sf_dir):
    return binarize.binarize(vectors(spark, sf_dir)).attribute_table().select("attr_idx", "name")


@query(
    f"WITH {_D}, e AS (SELECT CASE WHEN row_id % 5 = 0 THEN NULL ELSE cls END AS cls, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'fr' THEN 3 END AS v FROM d), "
    "n AS (SELECT v AS value_idx, cls, count(*)::DOUBLE AS n FROM e WHERE v IS NOT NULL AND cls IS NOT NULL GROUP BY ALL), "
    "r AS (SELECT v AS value_idx, count(cls)::DOUBLE AS r, (count(*) - count(cls))::DOUBLE AS u FROM e WHERE v IS NOT NULL GROUP BY v), "
    "c AS (SELECT cls, count(v)::DOUBLE AS c, (count(*) - count(v))::DOUBLE AS m FROM e WHERE cls IS NOT NULL GROUP BY cls), "
    "s AS (SELECT count(*) FILTER (v IS NOT NULL AND cls IS NOT NULL)::DOUBLE AS s, count(*) FILTER (v IS NULL AND cls IS NULL)::DOUBLE AS b FROM e), "
    "cells AS (SELECT 1 AS attr_idx, value_idx, cls, coalesce(n, 0) + r / s * m + c / s * u + coalesce(n, 0) / s * b AS weight FROM r CROSS JOIN c CROSS JOIN s LEFT JOIN n USING (value_idx, cls)), "
    f"{_gains()} SELECT attr_idx, gain FROM gains"
)
def infogain_missing_class(spark, sf_dir):
    data = labelled(spark, sf_dir, missing=True)
    frame = data.frame.withColumn("quality", F.when(F.col("row_id") % 5 != 0, F.col("quality")))
    return infogain.info_gain(replace(data, frame=frame).sparse()).where("attr_idx = 1")


@query("SELECT 0 AS new_idx, 'o_orderstatus' AS name, 'nominal' AS kind UNION ALL SELECT 1, 'o_orderpriority', 'nominal'")
def select_without_class(spark, sf_dir):
    """No class: the last attribute, which is nominal, is taken as one."""
    data = replace(nominal(spark, sf_dir, "orders"), class_name=None).sparse()
    return select.AttributeSelection(rank.Ranker()).schema(data)


@query("SELECT event_type AS key, count(*) AS n_inserts, row_number() OVER (ORDER BY event_type) - 1 AS position FROM events GROUP BY event_type")
def kv_in_order(spark, sf_dir):
    """Items of an ordered map with their place in an in-order walk."""
    items = keyed.upsert(_events(spark, sf_dir), F.col("event_type"), F.col("event_id"), F.col("event_id"))
    return numeric.with_position(items, [F.col("key")], "position").select("key", "n_inserts", "position")
