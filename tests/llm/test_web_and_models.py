"""URL filters, WARC derivatives, toxicity, the pipeline and the queries' SQL."""

import gzip
import hashlib
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveloom.llm import queries, toxicity, url_filter, warc
from tests.llm.helpers import DOCS, documents, rows
from tests.oracle import DATA, check, have_data

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "a.b.example.org", "/es/x/"), ("allow", "b.example.org", "/es/x/y"), ("block", "deep.co", "")]


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, None, default)
    return host, path, best[2], best[3]


def test_url_rules_equal_brute_force(spark):
    r = random.Random(1)
    hosts = ["org", "example.org", "x.example.org", "a.b.example.org", "b.example.org", "c.a.b.example.org", "notexample.org", "COM", "Q.com", "deep.co", "u.deep.co", "net", "com.net"]
    paths = ["", "/", "/es/", "/es", "/es/x/", "/es/x/y", "/es/x/yz?q", "/en/1", "/en/12#f", "/en/2", "/fr/1", "/de/", "?a/b://c", "#/es/"]
    urls = [f"{r.choice(['http', 'https', ''])}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(300)] + [None, "", "example.org/es/", "://", "http://", "http:///es/", "x://org"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    for n in (1, 5):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules, partitions=n).collect()}
        assert got == {i: judged(u, RULES) for i, u in enumerate(urls)}


def test_url_corner_cases(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, None)], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert rows(url_filter.judge(pages, none, default="block").select("page_id", "rule", "verdict")) == sorted([(1, None, "block"), (1, None, "block"), (None, None, "block")], key=repr)
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(RULES, none.schema)).count() == 0


HTML = "<!DOCTYPE html><html lang='en'><head><title>A &amp; B\n c</title><style>p{}</style></head><body><!-- no --><p>One  two<br>three &lt;b&gt; &#233;&#x41;&#38;lt; &bogus; &amp;amp;</p><script>var t='</p>';</script><a href=\"/x\">link</a><div>end</div></body></html>"


def test_warc_text_and_links(spark):
    pages = spark.createDataFrame([(1, "http://a/", HTML), (2, None, None), (3, "http://e/", ""), (4, "http://l/", "<p>" + "word " * 200000 + "</p>")], "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    got = {(r.page_id, r.warc_type): r for r in warc.derive(warc.responses_of_pages(pages)).collect()}
    assert len(got) == 8
    assert got[1, "conversion"].block == "One two\nthree <b> éA&lt; &bogus; &amp;\nlink\nend"
    meta = got[1, "metadata"].block.split("\r\n")
    assert meta[:3] == ["title: A & B c", "language: en", "http-status: 200"] and "outlink: /x" in meta and "source-header: Content-Type: text/html; charset=utf-8" in meta
    source = got[1, "metadata"].refers_to
    assert source == got[1, "conversion"].refers_to and uuid.UUID(source[10:-1]) and f"WARC-Refers-To: {source}" in got[1, "conversion"].headers
    assert got[2, "conversion"].block == "" and got[3, "conversion"].length == 0 and "WARC-Target-URI" not in got[2, "conversion"].headers
    assert got[4, "conversion"].length == 999999
    assert warc.derive(warc.responses_of_pages(pages.limit(0))).count() == 0


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_warc_files_round_trip(spark, tmp_path, compression):
    path = str(tmp_path / "w")
    derived = warc.derive(warc.responses_of_pages(spark.createDataFrame([(1, "http://a/", HTML), (2, "http://b/", "<p>x\r\n\r\ny</p>")], "page_id long, url string, html string")))
    warc.write_warc(derived, path, compression)
    back = warc.read_warc(spark, path, ("metadata", "conversion"))
    want = rows(derived.select("record_id", "warc_type", "target_uri", "refers_to", "block"))
    assert rows(back.select("record_id", "warc_type", "target_uri", "refers_to", "payload")) == want


def test_warc_responses_are_read(spark, tmp_path):
    body = b"HTTP/1.1 404 Not Found\r\nX: y\r\n\r\n<p>gone</p>"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: http://z/\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record.replace(b"uuid:1", b"uuid:2")))
    got = warc.read_warc(spark, str(tmp_path))
    assert got.count() == 2
    meta = warc.derive(got, extra=()).where("warc_type = 'metadata'").orderBy("refers_to").collect()
    assert meta[0].refers_to == "<urn:uuid:1>" and "http-status: 404" in meta[0].block and "source-header: X: y" in meta[0].block


def test_source_digests_and_headers_are_kept(spark, tmp_path):
    body = "<html><head><title>Caf\u00e9</title></head><body>na\u00efve</body></html>".encode("latin-1")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n" + body
    head = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{}>\r\nContent-Type: application/http\r\n{}Content-Length: {}\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(b"".join(head.format(i, extra, len(http)).encode() + http + b"\r\n\r\n" for i, extra in enumerate(["WARC-Payload-Digest: sha1:ABC\r\n", ""])))
    found = warc.derive(warc.read_warc(spark, str(tmp_path / "x.warc")), ()).collect()
    by = {(r.refers_to, r.warc_type): r for r in found}
    assert by["<urn:uuid:0>", "conversion"].source_digest == "sha1:ABC" and by["<urn:uuid:1>", "metadata"].source_digest == "sha256:" + hashlib.sha256(body).hexdigest()
    assert by["<urn:uuid:1>", "conversion"].block == "na\u00efve" and "title: Caf\u00e9\r\n" in by["<urn:uuid:0>", "metadata"].block
    assert "source-warc-header: warc-payload-digest: sha1:ABC\r\n" in by["<urn:uuid:0>", "metadata"].block
    assert "WARC-Source-Payload-Digest: sha1:ABC\r\n" in by["<urn:uuid:0>", "conversion"].headers


# ---- toxicity ----------------------------------------------------------------------


def labelled(n=400, seed=1):
    r = random.Random(seed)
    words = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 7 == 0
        text = [r.choice(words) for _ in range(40)] + [r.choice(["vile", "grobian" + r.choice(words)])] * (3 if toxic else 0)
        r.shuffle(text)
        docs.append((i, " ".join(text).capitalize() + "."))
        labels.append((i, int(r.random() < 0.8), int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled()
    frame = documents(spark, docs).withColumn("toxic", F.lit("clash")).withColumn("quality", F.lit("clash"))
    chain = toxicity.train(frame, spark.createDataFrame(labels[:280], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.toxic for r in toxicity.score(frame, chain).collect()}
    held = labels[280:]
    assert sum(got[i] == bool(t) for i, _, t in held) / len(held) >= 0.97
    kept = toxicity.drop_toxic(frame, chain)
    assert kept.columns == frame.columns and rows(kept.select("doc_id")) == sorted([(i,) for i, t in got.items() if not t], key=repr)


def test_later_models_read_out_of_fold_probabilities():
    r = np.random.default_rng(1)
    first = r.integers(0, 2, 600)
    texts = [f"{'low' if f else 'high'} n{i}" for i, f in enumerate(first)]
    chain = toxicity.Chain(texts, np.stack([first, first], axis=1))
    assert len(chain.links[0]) == 0 and len(chain.links[1]) == 1 and chain.links[1][0] > 0
    assert (chain.score(texts)[:, 1].round() == first).all()


def brute_scores(chain, text):
    """Probabilities by the definition: weights of the features that occur, and of earlier logits."""
    words = {w for raw in (text or "").lower().split() if (w := raw.strip(toxicity.MARKS))}
    features = {f for w in words for f in (w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n))}
    out = []
    for c in range(len(chain.bias)):
        z = chain.bias[c] + sum(chain.weights[f][c] for f in features if f in chain.weights)
        z += sum(link * np.log(p / (1 - p)) for link, p in zip(chain.links[c], np.clip(out, 1e-4, 1 - 1e-4), strict=True))
        out.append(1 / (1 + np.exp(-z)))
    return out


def test_chain_equals_brute_force(spark):
    docs, labels = labelled(120)
    docs += [(900 + i, f"(Word{i}) vile, GROBIANword{i}!") for i in range(20)]
    frame = documents(spark, [*docs, *docs[:5], (7, "zzz another text of an id")])
    chain = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    text, known = dict(docs), {i: (int(q == 0), t) for i, q, t in labels}
    same = toxicity.Chain([text[i] for i in sorted(known)], np.array([known[i] for i in sorted(known)]))
    assert chain.weights.keys() == same.weights.keys() and np.allclose(chain.bias, same.bias)
    for r in toxicity.score(frame.where("NOT contains(text, 'zzz')"), chain).collect():
        low, toxic = brute_scores(same, text[r.doc_id])
        assert abs(r.p_low_quality - low) < 2e-6 and abs(r.p_toxic - toxic) < 2e-6 and r.toxic == (round(toxic, 6) >= 0.5)


def test_training_rows_are_bounded(spark):
    frame = documents(spark, [(1, f"text {i}") for i in range(3000)] + [(2, "vile")])
    chain = toxicity.train(frame, spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int"), rows=2)
    assert len(chain.bias) == 2


def test_toxicity_corner_cases(spark):
    docs, labels = labelled(60)
    bad = [(None, 1, 1), (0, None, 1), (1, 1, None), (2, 1, 0), (2, 1, 1), (999, 1, 1)]
    frame = documents(spark, [*docs, (500, None), (501, ""), (None, "vile"), (3, "twice"), (3, "twice")])
    chain = toxicity.train(frame, spark.createDataFrame(labels + bad, "doc_id long, quality int, toxic int"))
    got = toxicity.score(frame, chain)
    assert got.count() == frame.count() and got.where("doc_id IN (500, 501) AND toxic").count() == 0
    empty = toxicity.train(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert rows(toxicity.score(frame.limit(1), empty).select("p_toxic", "p_low_quality")) == [(0.5, 0.5)]
    assert toxicity.score(spark.createDataFrame([], DOCS), chain).count() == 0
    assert toxicity.drop_toxic(spark.createDataFrame([], DOCS), chain).count() == 0


# ---- pipeline and queries --------------------------------------------------------------


def test_pipeline_keeps_columns_and_drops_copies(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(120)
    copies = [(1000 + i, docs[1][1]) for i in range(5)]
    frame = documents(spark, [*docs, *copies, (2000, None), (2001, "")])
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, seen = frame, {}
    for name, stage in corpus_pipeline.STAGES:
        before = at
        at = stage(spark, before, str(tmp_path))
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen[name] = at
        if name != "packing":
            assert at.columns == frame.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
    toxic = {i for i, _, t in labels if t}
    kept = {r.doc_id for r in seen["toxicity"].collect()}
    assert not toxic & kept and kept >= {i for i, _, t in labels if not t}
    assert seen["line_dedup"].count() == len(kept) and seen["line_dedup"].where("doc_id >= 1000 AND text <> ''").count() == 0
    assert seen["simhash_near_dedup"].where("doc_id >= 1001").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count() > 0


@pytest.mark.skipif(not have_data(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    check(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name])
