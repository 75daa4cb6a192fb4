"""Url templates, SentencePiece coder, quality classifier and pipeline."""

import hashlib
import os
import re
import string
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from quillmark.llm import common, cotraining, pieces, queries_models, queries_text, url_templates
from quillmark.llm.url_templates import Rule

MODEL = public_tokenizers.path("piece_bpe_32k.model")
URLS = [
    None,
    "",
    "no scheme/path",
    "http://A.Example.NET/en/1?x#y",
    "http://example.net/de/5",
    "https://example.com/de/",
    "https://example.com/de",
    "ftp://x.org/fr/a/b/c/d/e/f",
    "http://notnet/x",
    "http://a.net",
    "http://a.net#x",
    "http://ÄB.net/ü?",
    "http://x.org://y.net/z",
    "http://anet/x",
    "http:///net/",
]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), path


def brute_rule(host, path):
    fit = [r for r in queries_models.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name)) if fit else None


def test_url_parts_and_rules(spark):
    rows = spark.createDataFrame([(i, u, "x", "t") for i, u in enumerate(URLS)], "page_id long, url string, host string, template string")
    got = {r.page_id: r for r in url_templates.judge(rows, queries_models.RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = brute_parts(u)
        rule = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule.name if rule else None), u
        assert got[i].verdict == (rule.verdict if rule else "allow") or rule is None
    assert url_templates.judge(rows.limit(0), queries_models.RULES).count() == 0


def test_templates_generalise_and_purity_decides(spark):
    rules = [Rule("block", "s.test", "/spam/9"), Rule("allow", "s.test", "/news/1")]
    urls = [f"http://s.test/spam/{i}" for i in range(1000)] + [f"http://s.test/news/{i}.html" for i in range(300)] + [f"http://t.test/{i}/{w}" for i, w in enumerate(["a", "b"] * 30)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_templates.judge(rows, rules).collect()}
    assert {r.template for i, r in got.items() if i < 1000} == {"/spam/#"}
    assert {r.template for i, r in got.items() if 1000 <= i < 1300} == {"/news/#.html"}
    assert {r.template for i, r in got.items() if i >= 1300} == {"/#/a", "/#/b"}
    assert got[5].verdict == "block" and got[5].rule is None
    assert got[1299].verdict == "allow" and got[1350].verdict == "allow"


def test_templates_without_labels(spark):
    """No evidence never rejects, however high the prior; agreeing branches speak for those without labels."""
    rules = [Rule("block", "s.test", "/a/x/"), Rule("block", "s.test", "/a/y/"), Rule("allow", "u.test", "/a/x/"), Rule("block", "u.test", "/a/y/")]
    urls = [f"http://s.test/a/{b}/{i}" for b in "xyz" for i in range(40)] + ["http://s.test/b/1", "http://t.test/a/z/1"]
    urls += [f"http://u.test/a/{b}/{i}" for b in "xyz" for i in range(6)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r.page_id]: r for r in url_templates.judge(rows, rules).collect()}
    assert len(got) == len(urls)
    assert all(got[f"http://s.test/a/z/{i}"].verdict == "block" and got[f"http://s.test/a/z/{i}"].rule is None for i in range(40))
    assert got["http://t.test/a/z/1"].purity >= 0.8
    assert {got[u].verdict for u in ("http://s.test/b/1", "http://t.test/a/z/1", "http://u.test/a/z/1")} == {"allow"}


def brute_judge(urls, bad, depth, fan, weight, reject, least, z):
    """Templates, merged steps and verdicts of urls without rules, in plain Python."""
    parts = []
    for u in urls:
        p = [x for x in brute_parts(u)[1].split("/") if x]
        parts.append(p if len(p) <= depth else [*p[: depth - 1], "/".join(p[depth - 1 :])])
    hosts = [brute_parts(u)[0] for u in urls]
    steps = [() for _ in urls]
    for level in range(depth):
        children = {}
        for h, s, p in zip(hosts, steps, parts):
            if len(p) > level:
                children.setdefault((h, s), set()).add(p[level])
        new = []
        for h, s, p in zip(hosts, steps, parts):
            if len(p) > level:
                own = children[h, s]
                shapes = {re.sub("[0-9]+", "#", x) for x in own}
                s += ((p[level] if len(own) <= fan else re.sub("[0-9]+", "#", p[level]) if len(shapes) <= fan else "*"),)
            new.append(s)
        steps = new

    def similar(k, b, all_k, all_b):
        share, others = all_b / max(all_k, 1), all_k - k
        gap = abs(b / max(k, 1) - (all_b - b) / max(others, 1))
        return k >= least and others >= least and gap <= z * (share * (1 - share) * (1 / max(k, 1) + 1 / max(others, 1))) ** 0.5

    def sums(keys):
        out = {}
        for key, x in zip(keys, bad):
            k, b = out.get(key, (0, 0))
            out[key] = (k + (x is not None), b + (x or 0))
        return out

    merged = steps
    for level in range(depth):
        branch = sums([(h, m[: level + 1]) if len(m) > level else None for h, m in zip(hosts, merged)])
        family = {}
        for key, (k, b) in branch.items():
            if key is not None:
                x = family.setdefault((key[0], key[1][:-1]), [0, 0])
                x[0], x[1] = x[0] + k, x[1] + b
        merged = [(*m[:level], "~", *m[level + 1 :]) if len(m) > level and similar(*branch[h, m[: level + 1]], *family[h, m[:level]]) else m for h, m in zip(hosts, merged)]
    pooled = sums(list(zip(hosts, merged)))
    known, n_bad = sum(k for k, _ in pooled.values()), sum(b for _, b in pooled.values())
    found = {}
    for (h, m), own in pooled.items():
        for level in reversed(range(depth)):
            if own[0]:
                break
            branch = {}
            for (h2, m2), (k, b) in pooled.items():
                if h2 == h and m2[:level] == m[:level]:
                    x = branch.setdefault(m2[: level + 1], [0, 0])
                    x[0], x[1] = x[0] + k, x[1] + b
            branch = {k: x for k, x in branch.items() if x[0]}
            total = [sum(x[i] for x in branch.values()) for i in (0, 1)]
            if len(branch) > 1 and all(similar(*x, *total) for x in branch.values()) or [k[-1:] for k in branch] == [("~",)]:
                own = tuple(total)
        found[h, m] = own[0], (own[1] + weight * n_bad / max(known, 1)) / (own[0] + weight)
    return [(list(m), *found[h, m], "block" if found[h, m][0] and found[h, m][1] >= reject else "allow") for h, m in zip(hosts, merged)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_templates_merge_and_purity_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    shares = {}
    urls, bad = [], []
    for _ in range(1500):
        h = f"h{rng.integers(4)}.test"
        p = [str(rng.choice(["a", "b", "c"])), str(rng.choice(["x", "y", f"{rng.integers(99)}", f"n{rng.integers(40)}"])), f"{rng.integers(30)}.html", "t", "u"][: rng.integers(0, 6)]
        urls.append(f"http://{h}/" + "/".join(p) + rng.choice(["", "?q", "#f"]))
        s = shares.setdefault((h, *p[:1]), rng.choice([0.05, 0.5, 0.97]))
        bad.append(None if rng.random() < 0.3 or (h, *p[:2])[1:] == ("c", "x") else float(rng.random() < s))
    rows = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(zip(urls, bad))], "page_id long, url string, own double")
    got = {r.page_id: r for r in url_templates.judge(rows, [], F.col("own"), depth=3, fan=6).collect()}
    want = brute_judge(urls, bad, 3, 6, 10.0, 0.8, 5, 1.96)
    assert len(got) == len(urls) and {w[3] for w in want} == {"allow", "block"}
    assert any("~" in w[0] for w in want)
    for i, (steps, known, purity, verdict) in enumerate(want):
        assert (got[i].merged, got[i].known, got[i].verdict) == (steps, known, verdict), urls[i]
        assert got[i].purity == pytest.approx(purity)


def test_some_pages_without_rule_are_judged_by_evidence(spark):
    out = queries_models.op1_url_filter(spark, "/root/testdata/sf0.01").filter("rule is null")
    assert out.filter("known > 0").count() > 0.9 * out.count()


PIECE_TEXTS = [None, "", " ", "\n", "  a  b\n\tc é", "<s> hi </s> <0x0A> <unk>", "漢字 かな 😀 \U0001f468", "Hello World, it's 12345 don't   indented      here", "x" * 300, "аб вгд ελλην", "a\x00b\xa0c　d", "====== //// oooo    ", "tab\t\tend\n\n\n"]


@pytest.mark.parametrize("most", [5, 100_000])
def test_pieces_equal_the_library(most):
    own, library = pieces.PieceCoder(MODEL, most), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for part in (PIECE_TEXTS, PIECE_TEXTS[::-1]):
        for t, x in zip(part, own.encode(part)):
            assert np.frombuffer(x, "<u4").tolist() == library.encode(t or ""), t
            assert own.decode(x) == (t or "")


def test_piece_frame(spark):
    rows = spark.createDataFrame([(i, t, "z") for i, t in enumerate(PIECE_TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.decoded for r in pieces.encode(rows, MODEL).collect()}
    assert got == {i: t or "" for i, t in enumerate(PIECE_TEXTS)}
    assert pieces.encode(rows.limit(0), MODEL).count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep string"


def labelled(spark, n=400):
    rng = np.random.default_rng(0)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        good = bool(rng.random() < 0.8)
        w = list(rng.choice(words, 80))
        text = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)
        docs.append((i, text, "en", f"{'s' if good or i % 7 == 0 else 't'}{i % 3}", len(text), "x"))
        if i % 2:
            labels.append((i, good))
    docs += [(1000, None, None, None, None, None), (1001, "", "en", "s1", 0, ""), (None, "a b", "en", "s1", 3, "")]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels + [(2, None), (None, True)], "doc_id long, good boolean"), docs


def test_cotraining_separates_held_out_rows(spark):
    docs, labels, rows = labelled(spark)
    model = cotraining.train(docs.withColumn("y", F.lit("own")), labels)
    scored = cotraining.score(docs, model)
    assert scored.columns == [*docs.columns, "p_text", "p_meta", "quality_score", "keep_"]
    got = {r.doc_id: r for r in scored.drop("keep").withColumnRenamed("keep_", "keep").collect()}
    assert len(got) == len(rows)
    wrong = [i for i, t, *_ in rows[:400] if got[i].keep == t.endswith("!!")]
    assert len(wrong) <= 2
    assert all(0 <= got[i].quality_score <= 1 for i in got)


def test_cotraining_without_labels_keeps_all(spark):
    docs, labels, rows = labelled(spark, 20)
    model = cotraining.train(docs, labels.limit(0))
    assert model is None and cotraining.score(docs.drop("keep"), model).filter("keep").count() == len(rows)


def test_pseudo_labels_come_from_all_unlabelled_rows(spark):
    docs, labels, rows = labelled(spark)
    docs = docs.drop("keep")
    told = labels.filter("doc_id is not null and good is not null")
    rng = np.random.default_rng(2)
    wt, wm = 3 * rng.normal(size=cotraining.TEXT_DIMS + 1), 3 * rng.normal(size=cotraining.META_DIMS + 1)
    free = [r for r in rows if r[0] is not None and not (r[0] < 400 and r[0] % 2)]
    views = cotraining.text_view(pa.array([r[1] for r in free])), cotraining.meta_view([r[3] for r in free], [r[2] for r in free], [r[4] for r in free])
    for taken in (set(), {0, 2, 4}):
        got = cotraining.surest(docs, told, wt, wm, taken, 20)
        for ids, x, w in zip(got, views, (wt, wm)):
            sure = np.abs(cotraining.share(cotraining.logit(x, w)) - 0.5)
            best = sorted((s for s, r in zip(sure, free) if s > cotraining.SURE and r[0] not in taken), reverse=True)[:20]
            at = {r[0]: s for s, r in zip(sure, free)}
            assert [at[i] for i in ids] == pytest.approx(best) and not taken & set(ids)


def test_cotraining_with_few_labels(spark):
    docs, labels, rows = labelled(spark)
    few = labels.filter("doc_id < 15")
    model = cotraining.train(docs.drop("keep"), few)
    assert model is not None and len({r.good for r in few.collect()} - {None}) == 2
    got = {r.doc_id: r.keep for r in cotraining.score(docs.drop("keep"), model).collect()}
    assert sum(got[i] == t.endswith("!!") for i, t, *_ in rows[:400]) <= 20


def test_pipeline_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf)
        rows = out.collect()
        assert out.columns == columns, name
        assert all(r.n_chars == len(r.text or "") for r in rows) or k in (0, 2)
        after = {r.doc_id: r.text for r in rows}
        assert set(after) <= set(before) and after != before, name
        if k in (0, 2):
            assert all(before[i] == t for i, t in after.items())
        sizes.append(len(rows))
        docs = spark.createDataFrame(rows, out.schema)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in docs.collect()}
    assert not [i for i in kept if labels.get(i) == 0]
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == kept


def test_pipeline_stages_take_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, "a b", "en", None, 3), (None, "a b", "en", "s", 3)]
    for rows in (odd, []):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, spark.createDataFrame(rows, schema), sf).collect()


CLASH = ["keep", "kept", "y", "_n", "_lines", "k1", "K2", "n_words", "removed", "n_lines", "c0", "comp", "p_text", "block_id", "pos", "h1"]


def test_pipeline_stages_carry_columns_of_any_name(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60")
    plain = {name: sorted(map(str, stage(spark, docs, sf).collect())) for name, stage in corpus_pipeline.STAGES}
    wide = docs.select("*", *(F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in CLASH))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, wide, sf)
        rows = out.collect()
        assert sorted(map(str, out.select(*(f"`{c}`" for c in (docs.columns if k < 4 else out.columns))).collect())) == plain[name], name
        if k < 4:
            assert out.columns == wide.columns
            assert all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in CLASH)


def test_pipeline_stages_carry_columns_of_any_type(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60")
    more = {
        "m": "map('id', doc_id)",
        "v": "parse_json(concat('{\"id\":', doc_id, '}'))",
        "a": "array(named_struct('x', map(doc_id, array(lang))))",
        "s": "array(named_struct('x', doc_id, 'y', array(lang)))",
        "b": "cast(source as binary)",
        "n": "null",
    }
    wide = docs.selectExpr("*", *(f"{e} AS {c}" for c, e in more.items()))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        plain = stage(spark, docs, sf).collect() if k == 2 else None
        rows = stage(spark, wide, sf)
        if k < 4:
            got = rows.selectExpr("*", "v::string AS said").collect()
            assert rows.columns == wide.columns and got, name
            assert all(r.m == {"id": r.doc_id} and r.said == f'{{"id":{r.doc_id}}}' and r.s[0].x == r.doc_id and r.a[0].x == {r.doc_id: [r.lang]} for r in got)
            assert plain is None or {r.doc_id for r in got} == {r.doc_id for r in plain}
        else:
            assert rows.count()


def test_other_results_outlive_a_pipeline_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lazy = [queries_text.QUERIES[q](spark, sf) for q in ("op4_substring_dedup", "op6_ngram_jaccard", "op9_line_dedup")]
    out = corpus_pipeline.run(spark, sf)
    assert [df.count() for df in lazy] == [docs.count()] * 3
    assert out.count() == out.count() > 0
    # A stage deletes what the stage before it made, and nothing else.
    with common.owned() as made:
        first = corpus_pipeline.lines(spark, docs, sf)
    rows = first.collect()
    corpus_pipeline.clear(spark)
    assert made and rows and [df.count() for df in lazy] == [docs.count()] * 3
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    assert not any(hadoop.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop.Path(p)) for p in made)


ALONE = """
import sys
from quillmark.session import local_session
import __spark_entry__ as entry
spark = local_session(2, 2, "2g")
assert spark.conf.get("spark.checkpoint.dir", None) is None
for q in ("op9_line_dedup", "op5_best_fit_packing", "op11_filter_audit"):
    assert entry.queries()[q](spark, "/root/testdata/sf0.001").count(), q
from quillmark.llm import common
print("ROOT", common.shared_root(spark))
"""


def test_queries_run_where_no_shared_folder_is_named(tmp_path):
    """A local session without spark.checkpoint.dir; its scratch is gone when the driver ends."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", ALONE], env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    root = done.stdout.split("ROOT file://")[1].strip()
    assert not os.path.isdir(f"{root}/quillmark") or not [f for _, _, names in os.walk(root) for f in names if f.endswith(".parquet")]


def test_near_duplicates_of_repeated_and_null_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(5, a), (5, b), (7, a + " more"), (None, b), (None, c), (None, c), (3, ""), (3, ""), (None, None), (9, "a b"), (9, "a b")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(5, a), (5, b), (None, c), (3, ""), (3, ""), (None, None), (9, "a b")], key=str)


def test_pipeline_stages_take_a_very_long_text(spark):
    sf = "/root/testdata/sf0.001"
    rng = np.random.default_rng(3)
    long = "\n".join(" ".join(f"w{x}" for x in rng.integers(0, 10**6, 12)) for _ in range(25_000))
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 20").union(spark.createDataFrame([(10**6, long, "en", "s", len(long)), (10**6 + 1, long + " x", "en", "s", len(long) + 2)], "doc_id long, text string, lang string, source string, n_chars long"))
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, sf).filter("doc_id >= 1000000")
        if name == "line_dedup":
            assert {r.doc_id: r.text for r in out.collect()} == {10**6: long, 10**6 + 1: long + " x"}
        elif name == "ngram_jaccard":
            assert [r.doc_id for r in out.collect()] == [10**6]
        elif name == "substring_dedup":
            assert {r.doc_id: r.text for r in out.collect()} == {10**6: "", 10**6 + 1: "x"}
        else:
            n = out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
            assert len(n) == 2 and all(r.n > 300_000 for r in n)


def test_a_piece_coder_takes_a_part_longer_than_its_index(monkeypatch):
    monkeypatch.setattr(pieces, "INDEX", 500)
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdefgh"), 4000)), "x" * 2000, "é" * 700 + "漢字😀" * 300]
    own, library = pieces.PieceCoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t, x in zip(texts, own.encode(texts)):
        assert np.frombuffer(x, "<u4").tolist() == library.encode(t)


def test_digest_of_decoded_texts(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries_models.op7_sentencepiece(spark, sf).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert got[r.doc_id].n_tokens == len(library.encode(r.text or ""))
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
