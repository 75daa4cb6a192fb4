"""Filter audit, secret scan and conversation trie against brute force."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillmark.llm import filter_audit, prefix_trie, secret_scan


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables over several partitions, so that runs cross boundaries."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute_audit(docs, labels):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in docs]
    least, good, toxic = {}, defaultdict(bool), defaultdict(bool)
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        good[i] |= q == 1
        toxic[i] |= x == 1
    fails = []
    for (i, t, lang), w in zip(docs, words):
        t = t or ""
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        fails.append((lang or "", i, {k for k, v in f.items() if v}))
    out = {}
    for part in {p for p, _, _ in fails}:
        own = [(i, f) for p, i, f in fails if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            gone = set()
            for step, k in enumerate(order, 1):
                hit = [n for n, (_, f) in enumerate(own) if k in f]
                here = [n for n in hit if n not in gone]
                gone |= set(here)
                shapley[k] += len(here)
                out[part, "".join(order), step] = [len(own) - len(gone), len(here), len(hit) - len(here), sum(own[n][1] == {k} for n in hit), sum(good[own[n][0]] for n in here if own[n][0] is not None), sum(toxic[own[n][0]] for n in here if own[n][0] is not None)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1.5, {"a": "b"}, 3) for r in docs], "doc_id long, text string, lang string, mask double, fp map<string,string>, part int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    got = filter_audit.audit(d, lab, F.col("lang")).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def test_audit_matches_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ab", "Cd", "e#", "x", "YZ", "äb"]) + str(rng.randrange(rng.choice([3, 400]))) for _ in range(rng.choice([0, 5, 99, 100, 130]))) for _ in range(30)]
    hot = " ".join(f"w{i}" for i in range(120))
    docs = [(rng.choice([None, *range(40)]), rng.choice([*texts, None, "", "\t \n", hot, hot, hot]), rng.choice(["en", "fr", None, ""])) for _ in range(300)]
    docs += [(i, hot, "en") for i in range(200)] + [(7, hot, "en")] * 5 + [(400, "Long " * 40_000, "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    assert audited(spark, docs, labels) == brute_audit(docs, labels)


def test_audit_of_colliding_fingerprints_and_long_runs(spark, monkeypatch):
    """All texts under one fingerprint: runs of several texts cross the boundaries interleaved by id."""
    rng = random.Random(1)
    docs = [(i, rng.choice("abc") * 3, "en") for i in range(120)]
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *a: F.lit(5).cast("long"))
    assert audited(spark, docs, [(1, 1, 0)]) == brute_audit(docs, [(1, 1, 0)])


def test_audit_of_an_empty_table(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    assert audited(spark, [(1, None, None)], []) == brute_audit([(1, None, None)], [])


def brute_base(t):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", t):
        out += [(m.start(), "assign", m.end())] * (len(m[2]) >= 12)
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[0], ["assign", "access", "hex"].index(x[1])))


def test_secret_base_spans_match_brute_force(spark):
    rng = random.Random(2)
    bits = ["password", "PassWd", "ſecret", "secret", "toKen", "API_KEY", "apikey", "=", ": ", '"', "'", " ", "\n", "é", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "deadbeef", "Zz9", "x.y-z", "token=short token:longenough1234"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(400)] + [None, "", "a" * 300_000, "token = 'abcdefabcdef0123' " * 3000]
    rows = [(i if i % 50 else None, t, "x", 1) for i, t in enumerate(texts)]
    rows += rows[:5]
    df = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, spans string, SPANS_ int"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert df.columns == ["doc_id", "text", "spans", "SPANS_", "spans__"]
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans__"] if s["kind"] != "random"] == brute_base(r.text or "")
    assert secret_scan.scan(df.limit(0).select("text"), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_secret_random_strings():
    words = secret_scan.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(3)
    of = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    for n in (20, 32, 64, 3000):
        key = of(string.ascii_letters + string.digits, n)
        assert secret_scan.spans(f"é see {key} there", words) == [(6, 3, 6 + n)]
    key = of(string.ascii_letters + string.digits + "-_", 43).strip("-_")
    assert secret_scan.spans(f"/home/people/documents/{of(string.ascii_letters + string.digits, 40)}.txt", words)
    assert (0, 3, len(key)) in secret_scan.spans(key, words)
    digest, number = hashlib.sha256(b"x").hexdigest(), "4929348385146306" * 2
    for harmless in ("3f2b8c1e-9d4a-4c7b-8e21-0a1b2c3d4e5f", digest.upper(), number, "internationalisation", "getUserAccountNameFromDatabase", "some-long-identifier-name-2023-final", "/usr/local/share/documents/report_final_version", "Donaudampfschifffahrtsgesellschaft"):
        assert [s for s in secret_scan.spans(f"x {harmless} y", words) if s[1] == 3] == []
    # Inside a fixed pattern's span nothing is told twice.
    assert [s[1] for s in secret_scan.spans(f"token={of(string.ascii_letters + string.digits, 30)}", words)] == [0]


def brute_trie(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - c % 100, [])[:h] + v[h:]
    nodes = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in kids[k])
    ends = {k: ",".join(map(str, sorted(c for c in v if len(full[c]) == len(k)))) for k, v in nodes.items()}
    return sorted((min(v), len(k), min(nodes[k[:-1]]) if k else -1, len(v), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, v in nodes.items())


def trie(spark, turns, parts=5):
    df = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, depth int, label string").repartition(parts)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.nodes(df).collect())


@pytest.mark.parametrize(("shard", "bundle"), [(512, 4096), (6, 16), (1, 1)])
def test_trie_matches_brute_force(spark, monkeypatch, shard, bundle):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "BUNDLE", bundle)
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    rng = random.Random(shard)
    turns = []
    for c in [*range(60), *range(100, 130), 205, 317, 318, 10**12]:
        if c != 200:
            turns += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ccc", "", None, "éé"])) for t in rng.choices([None, 0, 1, 2, 3, 7], k=rng.choice([1, 2, 5, 8]))]
    turns += [(c, t, "user", "same" * t) for c in range(400, 440) for t in range(3)]  # copies
    turns += [(777, t, "user", f"{t}") for t in range(300)] + [(778, t, "user", f"{t}") for t in range(250)]  # long ones
    turns += [(None, 1, "user", "x")] * 3 + turns[:7]
    assert trie(spark, turns) == brute_trie(turns)


def test_trie_of_short_and_empty_tables(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []
    short = [c for c in range(1000, 1100) if zlib.crc32(str(c).encode()) % 6 >= 3 and c % 100][:3]
    turns = [(c, 0, "user", "only") for c in short]  # shorter than their head, and no first conversation
    assert trie(spark, turns) == brute_trie(turns)
    assert trie(spark, turns)[0][:6] == (min(short), 0, -1, 3, 0, 1)
    turns += [(1000, 0, "user", "y" * 100_000), (1000, 1, None, None)]
    assert trie(spark, turns) == brute_trie(turns)


def test_trie_of_one_hot_conversation(spark, monkeypatch):
    """One conversation with most turns, and copies of the whole of it: many partitions share it."""
    monkeypatch.setattr(prefix_trie, "SHARD", 40)
    turns = [(c, t, "user", str(t % 7)) for c in (300, 301, 5) for t in range(900)] + [(c, 0, "user", "0") for c in range(10, 30)]
    assert trie(spark, turns) == brute_trie(turns)
