"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import base64
import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from keyloom.llm import bpe, exact_dedup, fuzzy_hash, html_extract, minhash, mixing, quality, secrets, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, keep_id long, id long, node long"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000


def docs(spark, rows):
    full = [(i, t, "en", s, len(t or ""), 1, True, 2, 3, 4) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


ROWS = [
    (1, None, "a"),
    (2, "", "a"),
    (3, "  \n\t ", None),
    (4, "one two", "b"),
    (5, "one two", "b"),
    (6, "one two three four five six seven", "b"),
    (6, "one two three four five six seven", "b"),
    (None, "one two", "c"),
    (None, None, None),
    (7, LONG, "c"),
    (8, LONG + "omega", "c"),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module", params=[ROWS, []], ids=["rows", "empty"])
def table(spark, request):
    return docs(spark, request.param).repartition(3), request.param


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(table, keep, monkeypatch):
    df, rows = table
    for limit, bits in ((0, 1 << 15), (50, 1)):  # all groups hot, and none; all rows marked as copies, and few
        monkeypatch.setattr("keyloom.llm.common.HOT_ROWS", limit)
        monkeypatch.setattr(exact_dedup, "ROW_BITS", bits)
        got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_plan(df, keep=keep).collect()]
        groups = collections.defaultdict(list)
        for i, t, _ in rows:
            groups[t or ""].append(i)
        best = {t: (min if keep == "smallest" else max)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
        want = [(i, best[t or ""], len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows]
        assert sorted(got, key=str) == sorted(want, key=str)
        kept = exact_dedup.exact_dedup(df, keep=keep)
        assert kept.columns == df.columns
        assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((best[t], t) for t in groups)


def test_near(table):
    df, rows = table
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()]
    assert len(got) == len(rows)
    by_id = {g[0]: g for g in got}
    if rows:
        assert by_id[1] == (1, 0, 1, True) and by_id[3] == (3, 0, 3, True)
        assert by_id[5] == (5, 1, 4, False) and by_id[4] == (4, 1, 4, True)
        assert by_id[8][2:] == (7, False) and by_id[6] == (6, 3, 6, True)
        assert (None, 1, None, True) in got
    left = minhash.drop_near_duplicates(df)
    assert left.columns == df.columns and left.count() == sum(g[3] for g in got)


def test_bpe(table):
    df, rows = table
    got = bpe.encode_table(df, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_toxicity(spark, table):
    df, rows = table
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (6, 0, None), (None, 0, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        got = toxicity.score_documents(df, given).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    left = toxicity.drop_toxic(df, labels)
    assert left.columns == df.columns


def test_fuzzy(table):
    df, rows = table
    got = fuzzy_hash.compare_edited(df).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -1), r[1] or ""))
    want = []
    for k, (i, t, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)


def test_mixing(table):
    df, rows = table
    got = mixing.mix_plan(df).collect()
    assert len(got) == len(rows)
    total = sum(len(words(t)) for _, t, _ in rows)
    assert sum(r.taken for r in got) <= total
    assert all(r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in got)
    assert sorted(r.size for r in got) == sorted(len(words(t)) for _, t, _ in rows)
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns


def test_quality(table):
    df, rows = table
    got = quality.score_quality(df).collect()
    assert len(got) == len(rows) and all(r.kept == (r.score >= 0.5) for r in got)


def test_secrets(table):
    df, rows = table
    got = secrets.scan(df).collect()
    assert len(got) == len(rows) and {r.spans for r in got} <= {""}


PAGES = [
    (1, "http://a.example/x", None),
    (2, "http://a.example/y", ""),
    (3, None, "<p>é&nbsp;b</p>"),
    (4, "http://b.example", "<html><body><nav>menu</nav><article><h1>T</h1><p>a<b>b</b> c<br>d<p>e &amp; f</article><footer>x</footer>"),
    (5, "http://b.example", "<html><body><nav>menu</nav><article><h1>T</h1><p>a<b>b</b> c<br>d<p>e &amp; f</article><footer>x</footer>"),
    (None, "not a url", "<div>" * 5000 + "deep" + "</div>" * 5000),
    (7, "http://b.example", "a < b <!-- open"),
    (8, "http://b.example", "<script>if (a</script x>var</script>" + "<p>long text</p>" * 3000),
]


@pytest.fixture(scope="module", params=[PAGES, []], ids=["rows", "empty"])
def pages(spark, request):
    return spark.createDataFrame(request.param, "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("host", F.lit("h")), request.param


def test_html(pages):
    df, rows = pages
    got = {r.page_id: r.text for r in html_extract.extract_text(df).collect()}
    assert len(got) == len(rows)
    if rows:
        assert got[1] == got[2] == ""
        assert got[3] == "é b" and got[4] == got[5] == "T ab c d e & f" and got[None] == "deep"
        assert got[8].endswith("long text") and got[8].count("long text") == 3000


@pytest.mark.parametrize("least", [0, 30])
def test_warc(pages, least):
    df, rows = pages
    got = [tuple(r) for r in warc.round_trip(df, least).collect()]
    top = collections.defaultdict(lambda: -1)
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top[h or ""], i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = i is None or len(b) < least or i == top[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else top[h or ""]))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ids_may_be_strings(spark):
    rows = [("b", "http://h/1", "<p>x</p>"), ("a/ü>", "http://h/2", "<p>x</p>"), (None, "http://h/3", "<p>x</p>"), ("c", "http://h/4", "<p>y</p>")]
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()), key=str)
    assert got == sorted([("a/ü>", "revisit", "b"), ("b", "response", None), (None, "response", None), ("c", "response", None)], key=str)
    texts = {f"k{i}": f"text {i} " * i for i in range(12)}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(3)
    order = sorted(texts, reverse=True)
    for r in fuzzy_hash.compare_edited(df).collect():
        t, after = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % 12]]
        cut = len(t) // 3
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()


#: Names that the operators use inside.
CLASHES = ["_h", "_s", "_t", "_r", "_many", "_label", "_text", "_toxicity", "_gone", "_at", "_source", "_plan", "_copy", "size", "source_size", "target", "repeats", "_size", "_k0", "_v", "_hot", "_place", "_places", "_row", "_bits", "h", "s", "n", "id", "node", "label", "kept", "keep_id"]


def test_columns_of_any_name_keep_their_values(spark):
    texts = [(i, f"{'copy ' * 7 if i % 3 == 0 else ''}word{i % 5} " + " ".join(f"w{i}x{k}" for k in range(12 * (i % 3))), "abc"[i % 3]) for i in range(60)]
    df = spark.createDataFrame([(i, t, s, *(f"{c}:{i}" for c in CLASHES)) for i, t, s in texts], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(60)], "doc_id long, toxic int")
    for left in (toxicity.drop_toxic(df, labels), exact_dedup.exact_dedup(df), minhash.drop_near_duplicates(df), mixing.mixed(df)):
        assert left.columns == df.columns
        rows = left.collect()
        assert rows and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in CLASHES)
    for made in (minhash.near_duplicates(df), fuzzy_hash.compare_edited(df), exact_dedup.exact_plan(df), mixing.mix_plan(df), quality.score_quality(df), secrets.scan(df), bpe.encode_table(df), toxicity.score_documents(df, labels)):
        assert made.count() == 60


def test_secrets_in_very_long_texts(spark):
    secret = "é password=abcdef123 " + "0a" * 20 + " 4111 1111 1111 1111 "
    text = ("ü word " * 200_000) + secret + ("more " * 200_000)
    (r,) = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 0, 1)
    found = [tuple(x.split(":")) for x in r.spans.split(",")]
    assert [text[int(a) : int(b)] for _, a, b in found] == ["password=abcdef123", "0a" * 20, "4111 1111 1111 1111"]


def test_labels_that_say_nothing(spark):
    """Ties and repeated rows: equal texts score alike, whatever their ids."""
    df = spark.createDataFrame([(i, "same words here") for i in range(20)] + [(5, "same words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert len({r.score for r in toxicity.score_documents(df, labels).collect()}) == 1
    assert len({(r.weak_label, r.score) for r in quality.score_quality(df).collect()}) == 1


@pytest.mark.parametrize("given", [ROWS, []], ids=["rows", "empty"])
def test_pipeline_of_odd_rows(spark, tmp_path, given):
    import corpus_pipeline

    docs(spark, given).withColumn("_text", F.lit("t")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {i for i, t, _ in given if words(t)}
    assert bool(got) == bool(given)
    assert all(r.n_tokens == len(r.ids) > 0 for r in got)
